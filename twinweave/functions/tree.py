"""Comparison of two node trees, iterative, and subtree similarity.

Nodes are (parent, kind, tag, attrs, text) in preorder.  Below a compared pair
children are aligned by matching blocks of their keys (kind, tag, attributes,
text); aligned children are compared, the others are missing or extra, each
counted once with all that is below it.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .html import parse_html, parse_style
from .similarity import ratio

ELEMENT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("attr", T.DoubleType()), T.StructField("text", T.DoubleType())])
ELEMENTS = T.ArrayType(ELEMENT)


def ignored(name: str, patterns: tuple[str, ...]) -> bool:
    """True for names in the list, or starting as a pattern that ends in ``*``."""
    return any(name.startswith(p[:-1]) if p.endswith("*") else name == p for p in patterns)


def values_equal(name: str, a: str, b: str) -> bool:
    """Attribute values as sets of words; styles as ordered declarations."""
    if name == "style":
        return list(parse_style(a).items()) == list(parse_style(b).items())
    return set(a.split()) == set(b.split())


def attribute_diff(a: dict, b: dict, ignore: tuple[str, ...] = ()) -> dict:
    """Names by outcome, and the share of equal ones (1 if there are none)."""
    a = {k: v for k, v in a.items() if not ignored(k, ignore)}
    b = {k: v for k, v in b.items() if not ignored(k, ignore)}
    both = [k for k in a if k in b]
    equal = [k for k in both if values_equal(k, a[k], b[k])]
    total = len(a.keys() | b.keys())
    return {
        "matching": equal, "different": [k for k in both if k not in set(equal)],
        "missing": [k for k in a if k not in b], "extra": [k for k in b if k not in a],
        "similarity": len(equal) / total if total else 1.0}


class _Tree:
    def __init__(self, nodes: list):
        self.nodes = nodes
        self.below: list[list[int]] = [[] for _ in nodes]
        for i, n in enumerate(nodes):
            if i:
                self.below[n[0]].append(i)
        self.keys = [(n[1], n[2], tuple(sorted(n[3].items())), n[4]) for n in nodes]

    def only_text(self, i: int) -> str | None:
        kids = self.below[i]
        return self.nodes[kids[0]][4] if len(kids) == 1 and self.nodes[kids[0]][1] == "text" else None


def compare_trees(left: list, right: list, ignore: tuple[str, ...] = ()) -> list[tuple]:
    """(kind, tag, score, attr, text) for each element; kinds are match,
    different, missing and extra."""
    if not left and not right:
        return []
    if not left:
        return [("extra", right[0][2], 0.0, None, None)]
    if not right:
        return [("missing", left[0][2], 0.0, None, None)]
    a, b = _Tree(left), _Tree(right)
    out: list[tuple] = []
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        if i < 0 or j < 0:
            t = a.nodes[i][2] if j < 0 else b.nodes[j][2]
            out.append(("missing" if j < 0 else "extra", t, 0.0, None, None))
            continue
        _, kind, tag, attrs, text = a.nodes[i]
        _, kind2, tag2, attrs2, text2 = b.nodes[j]
        if kind == "text" and kind2 == "text":
            r = ratio(text, text2)
            out.append(_element(None, 1.0, r))
        elif tag == "script" and tag2 == "script":
            out.append(("match", tag, 1.0, 1.0, None))
        elif kind == kind2 and (tag or "").lower() == (tag2 or "").lower():
            attr = attribute_diff(attrs, attrs2, ignore)["similarity"]
            x, y = a.only_text(i), b.only_text(j)
            both = x is not None and y is not None
            out.append(_element(tag, attr, ratio(x, y) if both else None))
            if not both:
                todo += reversed(_align(a, i, b, j))
        else:
            out.append(("different", tag, 0.0, 0.0, 0.0))
    return out


def _element(tag, attr: float, text: float | None) -> tuple:
    if attr == 1.0 and text in (None, 1.0):
        return ("match", tag, 1.0, attr, text)
    return ("different", tag, min(1.0, 0.5 * attr + 0.5 * (1.0 if text is None else text)), attr, text)


def _align(a: _Tree, i: int, b: _Tree, j: int) -> list[tuple[int, int]]:
    left, right = a.below[i], b.below[j]
    blocks = SequenceMatcher(None, [a.keys[k] for k in left], [b.keys[k] for k in right]).get_matching_blocks()
    out, x, y = [], 0, 0
    for at, to, n in blocks:
        out += [(left[k], -1) for k in range(x, at)] + [(-1, right[k]) for k in range(y, to)]
        out += [(left[at + k], right[to + k]) for k in range(n)]
        x, y = at + n, to + n
    return out


def subtree_similarity(left: list, right: list) -> float:
    """Similarity of two syntax trees given as (parent, type, value) in preorder:
    types differ 0; leaves equal 1, one without value 0.8, else 0; inner nodes
    the greedily best children over the larger number."""
    if not left or not right:
        return 1.0 if not left and not right else 0.0

    def children(nodes):
        out = [[] for _ in nodes]
        for i, n in enumerate(nodes):
            if i:
                out[n[0]].append(i)
        return out

    kids1, kids2 = children(left), children(right)
    known: dict[tuple[int, int], float] = {}
    todo = [(0, 0, False)]
    while todo:
        i, j, ready = todo.pop()
        if (i, j) in known:
            continue
        a, b = left[i], right[j]
        c1, c2 = kids1[i], kids2[j]
        if a[1] != b[1]:
            known[i, j] = 0.0
        elif not c1 and not c2:
            known[i, j] = 1.0 if a[2] == b[2] else 0.8 if a[2] is None or b[2] is None else 0.0
        elif not c1 or not c2:
            known[i, j] = 0.0
        elif not ready:
            todo.append((i, j, True))
            todo += [(x, y, False) for x in c1 for y in c2]
        else:
            free, total = list(c2), 0.0
            for x in c1:
                if not free:
                    break
                best = max(free, key=lambda y: known[x, y])
                if known[x, best] > 0:
                    total += known[x, best]
                    free.remove(best)
            known[i, j] = total / max(len(c1), len(c2))
    return known[0, 0]


def _nodes(rows) -> list:
    return [(r["parent"], r["kind"], r["tag"], dict(r["attrs"] or {}), r["text"]) for r in (rows if rows is not None else ())]


def tree_elements(ignore: tuple[str, ...] = ()):
    """Arrow function (left nodes, right nodes) -> elements."""

    @F.pandas_udf(ELEMENTS)
    def compare(left, right):
        import pandas as pd

        return pd.Series([
            [dict(zip(("kind", "tag", "score", "attr", "text"), e)) for e in compare_trees(_nodes(x), _nodes(y), ignore)]
            for x, y in zip(left, right)])

    return compare


@lru_cache(256)
def parsed_html(text: str | None) -> list:
    """The tree of a text; the last ones are kept for texts that stand in several pairs of a task."""
    return parse_html(text)


def compare_texts(ignore: tuple[str, ...] = ()):
    """For ``mapInArrow`` over (key, left text, right text): the key with each
    element of the comparison.  Texts are parsed and compared in one function, so
    that trees never leave it."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                owner, rows = [], []
                for k, (x, y) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    found = compare_trees(parsed_html(x), parsed_html(y), ignore)
                    owner += [k] * len(found)
                    rows += found
                kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner, pa.int32())), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))],
                    names=["key", "kind", "tag", "score", "attr", "text"])

    return run
