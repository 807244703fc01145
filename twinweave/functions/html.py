"""HTML text to a preorder list of nodes; a tolerant parser without recursion.

A node is (parent, kind, tag, attrs, text): parents come before children, kind
is ``element`` or ``text``, attrs map names to text.  Class and similar lists
are kept as words, a style as ``name: value;`` pairs.  Comments and declarations
are text nodes unless ``comments`` is False.  An end tag closes the nearest open
element of its name and all inside; one that fits none is ignored.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content, attributes that are lists of words.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split())
WORD_LISTS = frozenset("class accesskey dropzone rel rev accept-charset headers".split())

NODE = T.StructType([
    T.StructField("parent", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())])
NODES = T.ArrayType(NODE)


def parse_style(value: str) -> dict[str, str]:
    """Declarations of a style attribute; a value may hold colons."""
    out = {}
    for part in value.split(";"):
        name, colon, rest = part.partition(":")
        if colon and name.strip():
            out[name.strip()] = rest.strip()
    return out


def style_text(style: dict[str, str]) -> str:
    return " ".join(f"{k}: {v};" for k, v in style.items())


def normal_attribute(name: str, value: str | None) -> str:
    value = value or ""
    if name == "style":
        return style_text(parse_style(value))
    return " ".join(value.split()) if name in WORD_LISTS else value


class _Builder(HTMLParser):
    def __init__(self, comments: bool):
        super().__init__(convert_charrefs=True)
        self.comments = comments
        self.nodes: list[tuple] = [(-1, "element", "[document]", {}, None)]
        self.open = [0]
        self.pending: list[str] = []

    def _flush(self):
        if self.pending:
            text = "".join(self.pending).strip()
            self.pending = []
            if text:
                self.nodes.append((self.open[-1], "text", None, {}, text))

    def handle_starttag(self, tag, attrs):
        self._flush()
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen[k] = normal_attribute(k, v)
        self.nodes.append((self.open[-1], "element", tag, seen, None))
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]][2] == tag:
                del self.open[depth:]
                break

    def handle_data(self, data):
        self.pending.append(data)

    def _aside(self, data):
        self._flush()
        if self.comments and data.strip():
            self.nodes.append((self.open[-1], "text", None, {}, data.strip()))

    handle_comment = handle_decl = handle_pi = unknown_decl = _aside


def subtree(nodes: list, root: int) -> list:
    """The nodes below and with ``root``, renumbered."""
    number = {root: 0}
    out = [(-1, *nodes[root][1:])]
    for i in range(root + 1, len(nodes)):
        if nodes[i][0] in number:
            number[i] = len(out)
            out.append((number[nodes[i][0]], *nodes[i][1:]))
    return out


def parse_html(content: str | None, comments: bool = True) -> list:
    """Nodes from the body if there is one, else from the document."""
    b = _Builder(comments)
    b.feed(content or "")
    b.close()
    b._flush()
    body = next((i for i, n in enumerate(b.nodes) if n[2] == "body"), 0)
    return subtree(b.nodes, body)


def parse_fragment(content: str | None, comments: bool = True) -> list:
    """Nodes of the first element, [] if there is none."""
    nodes = parse_html(content, comments)
    first = next((i for i, n in enumerate(nodes) if n[0] == 0 and n[1] == "element"), None)
    return [] if first is None else subtree(nodes, first)


def as_rows(nodes: list) -> list[dict]:
    return [{"parent": p, "kind": k, "tag": t, "attrs": a, "text": x} for p, k, t, a, x in nodes]


@F.pandas_udf(NODES)
def html_nodes(content):
    import pandas as pd

    return pd.Series([as_rows(parse_html(c)) for c in content])
