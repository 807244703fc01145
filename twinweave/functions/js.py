"""JavaScript, TypeScript, JSX and TSX to a normalised syntax outline.

A tolerant hand-written reader: a tokenizer (comments, strings, templates,
regular expressions, JSX text) and one pass over the tokens with an explicit
stack.  It yields functions, classes, imports, control flow, calls and JSX
elements as a tree of (parent, type, value) in preorder, in which identifiers
are ``id0, id1, ...`` and literals ``lit0, ...`` by first appearance, with the
call graph as (caller, callee) pairs.  Unbalanced brackets are an error.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType([T.StructField("parent", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
FUNCTION = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("parameters", T.IntegerType()), T.StructField("node", T.IntegerType())])
CLASS = T.StructType([T.StructField("name", T.StringType()), T.StructField("methods", T.ArrayType(T.StringType()))])
IMPORT = T.StructType([T.StructField("source", T.StringType()), T.StructField("specifiers", T.ArrayType(T.StringType()))])
FLOW = T.StructType([T.StructField("type", T.StringType()), T.StructField("condition", T.StringType()), T.StructField("node", T.IntegerType())])
EDGE = T.StructType([T.StructField("caller", T.StringType()), T.StructField("callee", T.StringType())])
OUTLINE = T.StructType([
    T.StructField("nodes", T.ArrayType(NODE)), T.StructField("functions", T.ArrayType(FUNCTION)), T.StructField("classes", T.ArrayType(CLASS)),
    T.StructField("imports", T.ArrayType(IMPORT)), T.StructField("flow", T.ArrayType(FLOW)), T.StructField("edges", T.ArrayType(EDGE)),
    T.StructField("error", T.StringType())])

_TOKEN = re.compile(r"""
    (?P<space>\s+)
  | (?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
  | (?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)
  | (?P<number>0[xXbBoO][0-9a-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
  | (?P<name>[A-Za-z_$\#\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)
  | (?P<op>=>|\.\.\.|\?\.|===|!==|\*\*=?|&&=?|\|\|=?|\?\?=?|[=!<>+\-*/%&|^]=|\+\+|--|.)
""", re.X | re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")

# Words that are not identifiers, and those after which a slash begins a pattern.
KEYWORDS = frozenset(
    "await break case catch class const continue debugger default delete do else export extends finally for function if import in "
    "instanceof let new of return static super switch this throw try typeof var void while with yield async null undefined "
    "interface type enum implements public private protected readonly as".split())
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do".split())
FLOW_WORDS = {"for": "for_statement", "while": "while_statement", "if": "if_statement"}
CLOSER = {"(": ")", "[": "]", "{": "}"}


def tokens(code: str) -> list[tuple[str, str]]:
    """(kind, text), without white space and comments; kinds are string, number, name, op, regex."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(code):
        if code[i] == "/" and (m := _REGEX.match(code, i)) and _pattern_may_follow(out):
            out.append(("regex", m[0]))
        else:
            m = _TOKEN.match(code, i)
            if m.lastgroup not in ("space", "comment"):
                out.append((m.lastgroup, m[0]))
        i = m.end()
    return out


def _pattern_may_follow(out: list[tuple[str, str]]) -> bool:
    if not out:
        return True
    kind, text = out[-1]
    return text in _BEFORE_PATTERN if kind == "name" else kind == "op" and text not in (")", "]", "}", ">", "<")


def _matching(toks: list[tuple[str, str]]) -> dict[int, int]:
    """Place of the closing bracket for each opening one."""
    pairs, stack = {}, []
    for i, (kind, text) in enumerate(toks):
        if kind != "op":
            continue
        if text in CLOSER:
            stack.append(i)
        elif text in CLOSER.values():
            if not stack or CLOSER[toks[stack[-1]][1]] != text:
                raise ValueError(f"unbalanced {text}")
            pairs[stack.pop()] = i
    if stack:
        raise ValueError("unclosed " + toks[stack[-1]][1])
    return pairs


def _count_parameters(toks, pairs, lo: int, hi: int) -> int:
    """Commas at the top level between lo and hi, plus one; 0 for nothing."""
    n, i, any_token = 0, lo, False
    while i < hi:
        any_token = True
        if toks[i][1] == "," and i + 1 < hi:
            n += 1
        i = pairs.get(i, i) + 1
    return n + any_token


#: Words that begin a declaration of variables.
VARIABLES = ("var", "let", "const")


def is_content(kind: str) -> bool:
    """True for the node types that are content of a file when they stand at its
    top: functions, classes, variables, imports, exports and JSX."""
    return kind.endswith(("_declaration", "_function", "_expression")) and kind != "call_expression" or kind.startswith(("import_", "export_", "jsx_"))


class Outline:
    """Result of reading one file."""

    def __init__(self, code: str):
        self.toks = tokens(code)
        self.pairs = _matching(self.toks)
        self.nodes: list[list] = [[-1, "program", None]]
        self.functions: list[tuple] = []
        self.classes: list[tuple[str | None, list[str]]] = []
        self.imports: list[tuple[str, list[str]]] = []
        self.flow: list[tuple] = []
        self.edges: list[tuple[str, str]] = []
        self._ids: dict[str, str] = {}
        self._lits: dict[str, str] = {}
        self._anonymous = 0
        self._read()

    # what stands at a place

    def _is(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i] == ("op", text)

    def _word(self, i: int) -> str | None:
        return self.toks[i][1] if 0 <= i < len(self.toks) and self.toks[i][0] == "name" else None

    def _plain_name(self, i: int) -> str | None:
        w = self._word(i)
        return w if w and w not in KEYWORDS else None

    def _assigned_name(self, i: int) -> str | None:
        """The name that the expression starting at i is assigned to."""
        if self._word(i - 1) == "async":
            i -= 1
        return self._plain_name(i - 2) if self._is(i - 1, "=") or self._is(i - 1, ":") else None

    def _body_after(self, i: int) -> int | None:
        """The brace that begins a body after a closing bracket, past a type annotation."""
        if self._is(i, ":"):
            while i < len(self.toks) and not self._is(i, "{") and not self._is(i, "=>") and not self._is(i, ";"):
                i = self.pairs.get(i, i) + 1
        return i if self._is(i, "{") else None

    def _arrow_from(self, i: int) -> tuple[int, int] | None:
        """(parameters, first token of the body) if an arrow function begins at i."""
        if self._is(i, "(") and i in self.pairs:
            end = self.pairs[i] + 1
            if self._is(end, ":"):
                while end < len(self.toks) and not self._is(end, "=>") and self.toks[end][1] not in (";", ",", ")", "{", "}"):
                    end += 1
            return (_count_parameters(self.toks, self.pairs, i + 1, self.pairs[i]), end + 1) if self._is(end, "=>") else None
        return (1, i + 2) if self._plain_name(i) and self._is(i + 1, "=>") else None

    def _expression_end(self, i: int) -> int:
        """Where an expression body ends: the comma, semicolon or bracket after it."""
        while i < len(self.toks) and not (self.toks[i][0] == "op" and self.toks[i][1] in (",", ";", ")", "]", "}")):
            i = self.pairs.get(i, i) + 1
        return i

    # reading

    def _add(self, parent: int, kind: str, value: str | None = None) -> int:
        self.nodes.append([parent, kind, value])
        return len(self.nodes) - 1

    def _read(self) -> None:
        scopes: list[tuple[int, int, str | None, list[str] | None]] = [(len(self.toks), 0, None, None)]  # end, node, function, methods
        waiting: dict[int, tuple] = {}  # first token of a body -> its scope
        i = 0
        while i < len(self.toks):
            while len(scopes) > 1 and i >= scopes[-1][0]:
                scopes.pop()
            if i in waiting:
                scopes.append(waiting.pop(i))
            end, node, function, methods = scopes[-1]
            kind, text = self.toks[i]
            if kind == "name":
                i = self._name(i, text, node, function, methods, waiting)
                continue
            if kind in ("string", "number", "regex"):
                self._add(node, kind, self._lits.setdefault(text, f"lit{len(self._lits)}"))
            elif text == "(" and (arrow := self._arrow_from(i)):
                self._function(i, "arrow_function", self._assigned_name(i), arrow[0], arrow[1], node, waiting)
            elif text == "<" and self._jsx_follows(i):
                self._add(node, "jsx_fragment" if self._is(i + 1, ">") else "jsx_element", self._word(i + 1))
            i += 1

    def _jsx_follows(self, i: int) -> bool:
        before = self.toks[i - 1] if i else ("op", ";")
        starts = before[0] == "op" and before[1] not in (")", "]") or before[1] in ("return", "default")
        return starts and (self._word(i + 1) is not None or self._is(i + 1, ">"))

    def _function(self, i, kind, name, parameters, body, node, waiting) -> None:
        if name is None:
            name, self._anonymous = f"anon_func_{self._anonymous}", self._anonymous + 1
        new = self._add(node, kind, name)
        self.functions.append((name, kind, parameters, new))
        end = self.pairs[body] + 1 if self._is(body, "{") else self._expression_end(body)
        waiting[body] = (end, new, name, None)

    def _name(self, i, text, node, function, methods, waiting) -> int:
        if text == "function":
            star = self._is(i + 1, "*")
            own = self._plain_name(i + 1 + star)
            at = i + 1 + star + (own is not None)
            if self._is(at, "(") and (body := self._body_after(self.pairs[at] + 1)) is not None:
                before = self.toks[i - 2 if self._word(i - 1) == "async" else i - 1] if i else ("op", ";")
                statement = own is not None and (before[1] in (";", "}", "{", "export", "default") or i == 0 or before[0] != "op")
                count = _count_parameters(self.toks, self.pairs, at + 1, self.pairs[at])
                self._function(i, "function_declaration" if statement else "function_expression", own or self._assigned_name(i), count, body, node, waiting)
                return at + 1
        elif text == "class":
            name = self._plain_name(i + 1)
            at = i + 1
            while at < len(self.toks) and not self._is(at, "{"):
                at = self.pairs.get(at, at) + 1
            if at < len(self.toks):
                new = self._add(node, "class_declaration", name)
                own: list[str] = []
                self.classes.append((name, own))
                waiting[at] = (self.pairs[at] + 1, new, function, own)
                return at
        elif text == "import" and not self._is(i + 1, "(") and not self._is(i + 1, "."):
            return self._import(i, node)
        elif text == "export":
            self._export(i, node)
        elif text in VARIABLES and not self._is(i - 1, "("):
            self._add(node, "variable_declaration", None)
        elif text in FLOW_WORDS:
            at = i + 1 + (self._word(i + 1) == "await")
            if self._is(at, "("):
                condition = " ".join(t for _, t in self.toks[at + 1 : self.pairs[at]])
                new = self._add(node, FLOW_WORDS[text], None)
                self.flow.append((FLOW_WORDS[text], condition, new))
                body = self.pairs[at] + 1
                if self._is(body, "{"):
                    waiting[body] = (self.pairs[body] + 1, new, function, None)
        elif text not in KEYWORDS or methods is not None and self._is(i + 1, "("):
            return self._identifier(i, text, node, function, methods, waiting)
        elif text in ("true", "false"):
            self._add(node, text, self._lits.setdefault(text, f"lit{len(self._lits)}"))
        return i + 1

    def _identifier(self, i, text, node, function, methods, waiting) -> int:
        if arrow := self._arrow_from(i):
            self._function(i, "arrow_function", self._assigned_name(i), arrow[0], arrow[1], node, waiting)
            return i + 1
        if methods is not None and self._is(i + 1, "(") and (body := self._body_after(self.pairs[i + 1] + 1)) is not None:
            methods.append(text)
            count = _count_parameters(self.toks, self.pairs, i + 2, self.pairs[i + 1])
            self._function(i, "method_definition", text, count, body, node, waiting)
            return i + 2
        member = self._is(i - 1, ".") or self._is(i - 1, "?.")
        if self._is(i + 1, "("):
            callee = self._ids.get(text, text)  # the number only if the name was seen before
            self._add(node, "call_expression", callee)
            if function is not None:
                self.edges.append((function, callee))
        if not member:
            self._add(node, "identifier", self._ids.setdefault(text, f"id{len(self._ids)}"))
        return i + 1

    def _names_between(self, lo: int, hi: int) -> list[str]:
        return [t for k, (kind, t) in enumerate(self.toks[lo:hi], lo) if kind == "name" and t not in ("as", "type", "from") and self._word(k + 1) != "as"]

    def _import(self, i: int, node: int) -> int:
        end = i + 1
        while end < len(self.toks) and self.toks[end][0] != "string" and not self._is(end, ";"):
            end += 1
        if end < len(self.toks) and self.toks[end][0] == "string":
            self.imports.append((self.toks[end][1][1:-1], self._names_between(i + 1, end)))
            self._add(node, "import_statement", None)
        return end + 1

    def _export(self, i: int, node: int) -> None:
        self._add(node, "export_statement", None)
        if self._is(i + 1, "{") or self._is(i + 1, "*"):
            end = self.pairs.get(i + 1, i + 1)
            if self._word(end + 1) == "from" and end + 2 < len(self.toks) and self.toks[end + 2][0] == "string":
                self.imports.append((self.toks[end + 2][1][1:-1], self._names_between(i + 1, end)))

    def below(self, node: int) -> list[tuple]:
        """The subtree of a node as (parent, type, value), renumbered."""
        number, out = {node: 0}, [(-1, self.nodes[node][1], None)]
        for k in range(node + 1, len(self.nodes)):
            if self.nodes[k][0] in number:
                number[k] = len(out)
                out.append((number[self.nodes[k][0]], *self.nodes[k][1:]))
        return out


def parse_js(code: str | None) -> dict:
    """Fields of OUTLINE; on an error only ``error`` is set, the lists are empty."""
    empty = {"nodes": [], "functions": [], "classes": [], "imports": [], "flow": [], "edges": [], "error": None}
    try:
        o = Outline(code or "")
    except ValueError as e:
        return empty | {"error": str(e)}
    return empty | {
        "nodes": [dict(zip(("parent", "type", "value"), n)) for n in o.nodes],
        "functions": [dict(zip(("name", "kind", "parameters", "node"), f)) for f in o.functions],
        "classes": [{"name": n, "methods": m} for n, m in o.classes],
        "imports": [{"source": s, "specifiers": p} for s, p in o.imports],
        "flow": [dict(zip(("type", "condition", "node"), f)) for f in o.flow],
        "edges": [{"caller": a, "callee": b} for a, b in dict.fromkeys(o.edges)]}


@F.pandas_udf(OUTLINE)
def js_outline(content):
    import pandas as pd

    return pd.DataFrame([parse_js(c) for c in content], columns=OUTLINE.fieldNames())


def object_literal(code: str | None):
    """The object that a configuration file exports, read without running it:
    literals, arrays and objects; anything else becomes its text.  None if there
    is none or brackets do not balance."""
    try:
        toks = tokens(code or "")
        pairs = _matching(toks)
    except ValueError:
        return None
    at = next((k for k, t in enumerate(toks) if t == ("op", "{") and k and toks[k - 1][1] in ("=", "default", "(")), None)
    return None if at is None else _value(toks, pairs, at, pairs[at] + 1)


def _value(toks, pairs, lo: int, hi: int):
    if lo >= hi:
        return None
    kind, text = toks[lo]
    if pairs.get(lo) == hi - 1 and text in "{[":
        items, out = _split(toks, pairs, lo + 1, hi - 1), {} if text == "{" else []
        for a, b in items:
            if text == "[":
                out.append(_value(toks, pairs, a, b))
            elif b - a > 2 and toks[a + 1] == ("op", ":"):
                key = toks[a][1]
                out[key[1:-1] if toks[a][0] == "string" else key] = _value(toks, pairs, a + 2, b)
            elif b - a == 1:
                out[toks[a][1]] = toks[a][1]
        return out
    if hi - lo == 1:
        if kind == "string":
            return text[1:-1]
        if kind == "number":
            try:
                return float(text) if re.search(r"[.eE]", text) else int(text, 0)
            except ValueError:
                return text
        return {"true": True, "false": False, "null": None}.get(text, text)
    return "".join(t for _, t in toks[lo:hi])


def _split(toks, pairs, lo: int, hi: int) -> list[tuple[int, int]]:
    out, start, i = [], lo, lo
    while i < hi:
        if toks[i] == ("op", ","):
            out.append((start, i))
            start = i + 1
        i = pairs.get(i, i) + 1
    return [(a, b) for a, b in [*out, (start, hi)] if b > a]


@F.pandas_udf(T.StringType())
def config_json(content):
    """The exported object as JSON text; null where there is none."""
    import json

    import pandas as pd

    found = (object_literal(c) for c in content)
    return pd.Series([None if v is None else json.dumps(v) for v in found], dtype="object")
