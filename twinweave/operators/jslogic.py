"""Comparison of script logic: functions, imports, classes, control flow, calls.

``documented`` mode compares what the descriptions promise (parameters, bodies,
imported names, methods, conditions); ``as_coded`` mode compares what the
original tool's normalised nodes really hold: names and types alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.js import js_outline
from ..functions.similarity import jaccard, ratio
from ..functions.tree import subtree_similarity

WEIGHTS = {"functions": 0.35, "imports": 0.15, "classes": 0.15, "control_flow": 0.15, "calls": 0.20}
JSX_WEIGHTS = {"structure": 0.6, "calls": 0.2, "bodies": 0.2}
DECLARED = ("function_declaration", "method_definition")


def call_graph_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of (caller, callee)."""
    return jaccard(a, b)


def function_similarity(names1: Column, names2: Column) -> Column:
    """As coded: each left function scores 1 if its name exists on the right, else
    0.7 (empty bodies agree), over the larger number."""
    n1, n2 = F.size(names1), F.size(names2)
    total = F.aggregate(names1, F.lit(0.0), lambda s, n: s + F.when(F.array_contains(names2, n), 1.0).otherwise(0.7))
    return F.when((n1 == 0) & (n2 == 0), 1.0).when((n1 == 0) | (n2 == 0), 0.0).otherwise(total / F.greatest(n1, n2)).cast("double")


def function_counts(names1: Column, names2: Column) -> Column:
    """As coded: a function whose name exists matches, any other is different (0.7);
    extra are right functions that no left one picks: its first namesake, else
    the first of all."""
    has = lambda n: F.array_contains(names2, n)
    matching = F.size(F.filter(names1, has))
    picked = F.array_distinct(F.transform(names1, lambda n: F.when(has(n), F.array_position(names2, n)).otherwise(F.lit(1))))
    some = F.size(names2) > 0
    return F.struct(
        F.when(some, matching).otherwise(0).alias("matching"), F.when(some, F.size(names1) - matching).otherwise(0).alias("different"),
        F.when(some, F.lit(0)).otherwise(F.size(names1)).alias("missing"), F.when(some, F.size(names2) - F.size(picked)).otherwise(0).alias("extra"))


def class_similarity(n1: Column, n2: Column) -> Column:
    """As coded: classes have no names, so each left one matches."""
    return F.when((n1 == 0) & (n2 == 0), 1.0).when((n1 == 0) | (n2 == 0), 0.0).otherwise(n1 / F.greatest(n1, n2)).cast("double")


def control_flow_similarity(types1: Column, types2: Column) -> Column:
    """As coded: left statements whose type exists on the right, over the larger number."""
    n1, n2 = F.size(types1), F.size(types2)
    hits = F.size(F.filter(types1, lambda t: F.array_contains(types2, t)))
    return F.when((n1 == 0) & (n2 == 0), 1.0).when((n1 == 0) | (n2 == 0), 0.0).otherwise(hits / F.greatest(n1, n2)).cast("double")


def weighted(scores: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    return sum((weights[n] * c for n, c in scores.items()), F.lit(0.0)).cast("double")


def as_coded_score(a: Column, b: Column) -> Column:
    """Score struct of two outlines by names and types alone."""
    names = lambda o: F.transform(F.filter(o["functions"], lambda f: f["kind"].isin(*DECLARED)), lambda f: f["name"])
    types = lambda o: F.transform(o["flow"], lambda f: f["type"])
    parts = {
        "functions": function_similarity(names(a), names(b)), "imports": F.lit(1.0),
        "classes": class_similarity(F.size(a["classes"]), F.size(b["classes"])),
        "control_flow": control_flow_similarity(types(a), types(b)), "calls": call_graph_jaccard(a["edges"], b["edges"])}
    return F.struct(*(c.alias(n) for n, c in parts.items()), weighted(parts).alias("similarity"), function_counts(names(a), names(b)).alias("counts"))


_COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("matching", "different", "missing", "extra")])
SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in (*WEIGHTS, "bodies", "structure")] + [T.StructField("counts", _COUNTS)])


def best_matches(left: list, right: list, score) -> tuple[float, dict]:
    """Sum of each left item's best score over the larger number, and the counts
    of best scores above 0.8, above 0.5 and below; extra are right items that are
    nobody's first best."""
    if not left or not right:
        return (1.0 if not left and not right else 0.0), {"matching": 0, "different": 0, "missing": len(left), "extra": len(right)}
    total, chosen, counts = 0.0, set(), {"matching": 0, "different": 0, "missing": 0, "extra": 0}
    for x in left:
        values = [score(x, y) for y in right]
        best = max(values)
        total += best
        chosen.add(values.index(best))
        counts["matching" if best > 0.8 else "different" if best > 0.5 else "missing"] += 1
    counts["extra"] = len(right) - len(chosen)
    return total / max(len(left), len(right)), counts


def documented_scores(a: dict, b: dict) -> dict:
    """All parts of two outlines (as dicts) with bodies, parameters and conditions."""
    tree = {id(o): [(n["parent"], n["type"], n["value"]) for n in o["nodes"]] for o in (a, b)}
    bodies: dict[tuple, list] = {}

    def body(o, node) -> list:
        key = (id(o), node)
        if key not in bodies:
            nodes, number, out = tree[id(o)], {node: 0}, [(-1, tree[id(o)][node][1], None)]
            for k in range(node + 1, len(nodes)):
                if nodes[k][0] in number:
                    number[k] = len(out)
                    out.append((number[nodes[k][0]], *nodes[k][1:]))
            bodies[key] = out
        return bodies[key]

    known: dict[tuple, float] = {}

    def same_body(x, y) -> float:
        key = (x["node"], y["node"])
        if key not in known:
            known[key] = subtree_similarity(body(a, x["node"]), body(b, y["node"]))
        return known[key]

    def functions(x, y) -> float:
        signature = 0.0 if x["name"] != y["name"] else 1.0 if x["parameters"] == y["parameters"] else 0.5
        return 0.3 * signature + 0.7 * same_body(x, y)

    def sets(p, q) -> float:
        return len(set(p) & set(q)) / len(set(p) | set(q)) if set(p) | set(q) else 1.0

    def methods(x, y) -> float:
        return (sum(m in y["methods"] for m in x["methods"]) / max(len(x["methods"]), len(y["methods"])) if x["methods"] or y["methods"] else 1.0) if x["name"] == y["name"] else 0.0

    def flow(x, y) -> float:
        return 0.3 * ratio(x["condition"], y["condition"]) + 0.7 * same_body(x, y) if x["type"] == y["type"] else 0.0

    declared = lambda o: [f for f in o["functions"] if f["kind"] in DECLARED]
    score, counts = best_matches(declared(a), declared(b), functions)
    edges = [{(e["caller"], e["callee"]) for e in o["edges"]} for o in (a, b)]
    top = [[(-1, "program", None)] + [(0, n["type"], None) for n in o["nodes"] if n["parent"] == 0] for o in (a, b)]
    return {
        "functions": score, "counts": counts,
        "imports": best_matches(a["imports"], b["imports"], lambda x, y: sets(x["specifiers"], y["specifiers"]) if x["source"] == y["source"] else 0.0)[0],
        "classes": best_matches(a["classes"], b["classes"], methods)[0],
        "control_flow": best_matches(a["flow"], b["flow"], flow)[0],
        "calls": (len(edges[0] & edges[1]) / len(edges[0] | edges[1]) if edges[0] and edges[1] else 0.0) if edges[0] or edges[1] else 1.0,
        "bodies": greedy_bodies(a["functions"], b["functions"], same_body), "structure": subtree_similarity(*top)}


def greedy_bodies(left: list, right: list, same_body) -> float:
    """Components in order, each with the best body still free, over the larger number."""
    if not left or not right:
        return 1.0 if not left and not right else 0.0
    free, total = list(right), 0.0
    for x in left:
        if not free:
            break
        best = max(free, key=lambda y: same_body(x, y))
        total += same_body(x, best)
        free.remove(best)
    return total / max(len(left), len(right))


def _plain(value):
    """Rows of Arrow batches as plain dicts and lists."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if hasattr(value, "__len__") and not isinstance(value, str) else value


@F.pandas_udf(SCORES)
def outline_scores(a, b):
    import pandas as pd

    rows = [documented_scores(_plain(x), _plain(y)) for x, y in zip(a.to_dict("records"), b.to_dict("records"))]
    return pd.DataFrame(rows, columns=SCORES.fieldNames())


def compare_scripts(pairs: DataFrame, key: str = "pair_key", a: str = "original_content", b: str = "modified_content", kind: str = "file_type",
                    as_coded: bool = False) -> DataFrame:
    """``key, similarity, functions, imports, classes, control_flow, calls, counts, error``.

    Each text is read once.  In documented mode a pair with an unreadable side has
    similarity 0 and says so; jsx files are 0.6 structure, 0.2 calls, 0.2 bodies.
    As coded, unreadable files are empty, and any two jsx files are alike.
    """
    read = pairs.select(key, kind, js_outline(a).alias("x"), js_outline(b).alias("y"))
    error = F.coalesce("x.error", "y.error")
    if as_coded:
        s = read.select(key, kind, as_coded_score(F.col("x"), F.col("y")).alias("s"), error.alias("error"))
        return s.select(key, F.when(F.col(kind) == "jsx", 1.0).otherwise(F.col("s.similarity")).alias("similarity"), *(f"s.{n}" for n in WEIGHTS), "s.counts", "error")
    s = read.select(key, kind, error.alias("error"), outline_scores("x", "y").alias("s"))
    score = F.when(F.col(kind) == "jsx", weighted({n: F.col(f"s.{n}") for n in JSX_WEIGHTS}, JSX_WEIGHTS)).otherwise(weighted({n: F.col(f"s.{n}") for n in WEIGHTS}))
    return s.select(key, F.when(F.col("error").isNotNull(), 0.0).otherwise(score).alias("similarity"), *(f"s.{n}" for n in WEIGHTS), "s.counts", "error")
