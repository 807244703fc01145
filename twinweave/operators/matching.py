"""Pairing the files of two projects: a cascade of joins.

Left and right are tables with pair_id, file_type, path (and content where a
step reads it).  Every step takes what the steps before left over:

  exact path -> fuzzy file name -> structure -> folder context -> content (css)

Equi-joins on (pair_id, file_type) carry all similarity joins; a native bound on
lengths stands in the join condition, the score is computed once per remaining
pair.  The greedy one-to-one choice within a group is inherently sequential: left
paths in order, each takes the best right path still free.  It runs per group on
candidate rows (three columns), which are only those above the threshold: a
candidate below it neither matches nor uses up a file, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import css as css_functions
from ..functions import js as js_functions
from ..functions import tree as tree_functions
from ..functions.paths import basename, common_prefix, parent, parts
from ..functions.similarity import length_band, ratio_possible, ratio_udf
from ..storage import written

GROUP = ["pair_id", "file_type"]
FUZZY, STRUCTURE, CONTEXT, CONTENT = 0.75, 0.5, 0.5, 0.6



def exact_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files with the same path on both sides."""
    keys = [*GROUP, "path"]
    return left.select(keys).join(right.select(keys), keys).select(
        *GROUP, F.col("path").alias("original"), F.col("path").alias("modified"), F.lit(1.0).alias("score"))


def remaining(files: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Anti-join: the files of one side that no match has."""
    used = matches.select(*GROUP, F.col(side).alias("path")).distinct()
    return files.join(used, [*GROUP, "path"], "left_anti")


def blocked_pairs(left: DataFrame, right: DataFrame, condition: Column | None = None, text: str | None = None, threshold: float | None = None) -> DataFrame:
    """Pairs within (pair_id, file_type); columns of the sides are l and r structs.

    With the name of a column and a threshold also within bands of its length,
    which loses no pair whose ratio may reach the threshold; so the files of a
    large project are dealt by length to several tasks.
    """
    a = left.select(*GROUP, F.struct(*left.columns).alias("l"))
    b = right.select(*GROUP, F.struct(*right.columns).alias("r"))
    keys = GROUP
    if text is not None:
        band = lambda side: length_band(F.coalesce(F.col(f"{side}.{text}"), F.lit("")), threshold)
        a = a.withColumn("band", F.explode(F.array(*(band("l") + k for k in (-1, 0, 1)))))
        b, keys = b.withColumn("band", band("r")), [*GROUP, "band"]
    pairs = a.join(b, keys).select(*GROUP, "l", "r")
    return pairs if condition is None else pairs.where(condition)


def greedy(candidates: DataFrame, threshold: float) -> DataFrame:
    """One-to-one choice among (original, modified, score) by group.

    Ties go to the smallest path on the right; candidates must be positive.
    """
    schema = T.StructType([f for f in candidates.select(*GROUP, "original", "modified", "score").schema])

    def choose(frame):
        frame = frame.sort_values(["original", "score", "modified"], ascending=[True, False, True], kind="stable")
        left = frame["original"].to_numpy()
        right = frame["modified"].to_numpy()
        used, done, rows = set(), None, []
        for k in range(len(frame)):
            if left[k] != done and right[k] not in used:
                used.add(right[k])
                done = left[k]
                rows.append(k)
        return frame.iloc[rows]

    return (candidates.where((F.col("score") >= threshold) & (F.col("score") > 0)).select(*GROUP, "original", "modified", "score")
            .groupBy(*GROUP).applyInPandas(choose, schema))


def greedy_native(candidates: DataFrame, threshold: float) -> DataFrame:
    """The same choice as one fold over each group's sorted candidates, in Catalyst."""
    rows = candidates.where((F.col("score") >= threshold) & (F.col("score") > 0))
    lists = rows.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct(
        "original", (-F.col("score")).alias("minus"), "modified"))).alias("c"))
    kind = "array<struct<original: string, minus: double, modified: string>>"
    chosen = F.aggregate(
        "c", F.array().cast(kind),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["original"] == x["original"]) | (y["modified"] == x["modified"])), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select(*GROUP, F.explode(chosen).alias("m")).select(*GROUP, "m.original", "m.modified", (-F.col("m.minus")).alias("score"))


def scored(pairs: DataFrame, score: Column) -> DataFrame:
    """The score stands once, under a name, so that an Arrow function runs once."""
    return pairs.select(*GROUP, F.col("l.path").alias("original"), F.col("r.path").alias("modified"), score.alias("score"))


def fuzzy_candidates(left: DataFrame, right: DataFrame, threshold: float = FUZZY) -> DataFrame:
    a, b = basename(F.col("l.path")), basename(F.col("r.path"))
    sides = (f.select(*GROUP, "path", basename(F.col("path")).alias("name")) for f in (left, right))
    pairs = blocked_pairs(*sides, ratio_possible(a, b, threshold), "name", threshold)
    # names repeat across folders: the ratio is computed once per pair of names
    named = pairs.select(*GROUP, "l", "r", a.alias("a"), b.alias("b"))
    scores = named.select("a", "b").distinct().select("a", "b", ratio_udf("a", "b").alias("score"))
    return named.join(scores, ["a", "b"]).select(*GROUP, F.col("l.path").alias("original"), F.col("r.path").alias("modified"), "score")


def content_candidates(left: DataFrame, right: DataFrame, threshold: float = CONTENT) -> DataFrame:
    a, b = F.coalesce(F.col("l.content"), F.lit("")), F.coalesce(F.col("r.content"), F.lit(""))
    css = F.col("file_type") == "css"
    return scored(blocked_pairs(left.where(css).select(*GROUP, "path", "content"), right.where(css).select(*GROUP, "path", "content"),
                                ratio_possible(a, b, threshold), "content", threshold), ratio_udf(a, b))


def rule_count(content: Column) -> Column:
    """Number of opening braces, a stand-in for the number of rules."""
    return F.length(content) - F.length(F.replace(content, F.lit("{"), F.lit("")))


def size_gate(n1: Column, n2: Column) -> Column:
    """False for two files of fewer than two nodes, unless each has exactly one."""
    return (n1 >= 2) | (n2 >= 2) | ((n1 == 1) & (n2 == 1))


def _html_score(a: str, b: str) -> float:
    elements = tree_functions.compare_trees(tree_functions.parsed_html(a), tree_functions.parsed_html(b))
    return sum(e[2] for e in elements) / len(elements) if elements else 0.0


@lru_cache(256)
def _parsed_js(text: str) -> dict:
    """A file is in as many candidate pairs as there are files to meet: the last outlines are kept."""
    return js_functions.parse_js(text)


def _script_score(a: str, b: str) -> float:
    x, y = _parsed_js(a), _parsed_js(b)
    if x["error"] or y["error"]:
        return 0.0
    n1, n2 = (sum(n["parent"] == 0 and js_functions.is_content(n["type"]) for n in o["nodes"]) for o in (x, y))
    if n1 < 2 and n2 < 2 and not (n1 == 1 and n2 == 1):
        return 0.0
    return tree_functions.subtree_similarity(*([(n["parent"], n["type"], n["value"]) for n in o["nodes"]] for o in (x, y)))


def _css_score(a: str, b: str) -> float:
    from .css import similarity_of_texts

    return similarity_of_texts(a, b)


_SCORES: dict[str, Callable[[str, str], float]] = {"html": _html_score, "css": _css_score, "js": _script_score, "jsx": _script_score}


@F.pandas_udf(T.DoubleType())
def structure_score(kind, a, b):
    """Score of two texts of one file type; 0 for types without a structure."""
    import pandas as pd

    return pd.Series([_SCORES[k](x or "", y or "") if k in _SCORES else 0.0 for k, x, y in zip(kind, a, b)], dtype="float64")


def structure_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    texts = (F.coalesce(F.col(f"{s}.content"), F.lit("")) for s in "lr")
    big_enough = (F.col("file_type") != "css") | size_gate(*map(rule_count, texts))
    pairs = blocked_pairs(left.select(*GROUP, "path", "content"), right.select(*GROUP, "path", "content"), big_enough)
    return scored(pairs, structure_score("file_type", "l.content", "r.content"))


def folder_score(a: Column, b: Column) -> Column:
    """Shared leading folders over the larger depth, the file name included."""
    pa, pb = parts(a), parts(b)
    up = lambda p: F.slice(p, F.lit(1), F.size(p) - 1)
    return common_prefix(up(pa), up(pb)) / F.greatest(F.size(pa), F.size(pb))


def context_candidates(left: DataFrame, right: DataFrame, matched: DataFrame) -> DataFrame:
    """0.7 of the folder score plus 0.3 of the matched neighbours' share.

    Neighbours are counted once per pair of folders, not per pair of files: the
    matches of a group that begin with both folders' paths.
    """
    sides = [f.select(*GROUP, "path", parent(F.col("path")).alias("dir")) for f in (left, right)]
    pairs = blocked_pairs(*sides, folder_score(F.col("l.path"), F.col("r.path")) > 0)
    folders = pairs.select(*GROUP, F.col("l.dir").alias("a"), F.col("r.dir").alias("b")).distinct()
    hits = folders.join(matched.select(*GROUP, "original", "modified"), GROUP).where(
        F.startswith("original", "a") & F.startswith("modified", "b")).groupBy(*GROUP, "a", "b").agg(F.count("*").alias("hits"))
    totals = matched.groupBy(*GROUP).agg(F.count("*").alias("total"))
    named = pairs.select(*GROUP, "l", "r", F.col("l.dir").alias("a"), F.col("r.dir").alias("b"))
    named = named.join(hits, [*GROUP, "a", "b"], "left").join(totals, GROUP, "left")
    score = 0.7 * folder_score(F.col("l.path"), F.col("r.path")) + 0.3 * F.coalesce("hits", F.lit(0)) / (F.coalesce("total", F.lit(0)) + 1)
    return scored(named, score)


def cascade(left: DataFrame, right: DataFrame, native: bool = False, as_coded: bool = False) -> DataFrame:
    """``pair_id, file_type, original, modified, score, match_type`` of all matches.

    ``as_coded`` lets an original that was matched by structure match once more
    by context, as the original tool does.
    """
    def choose(candidates: DataFrame, threshold: float) -> DataFrame:
        # each step is used by several later ones: it is written once, not planned again
        return written((greedy_native if native else greedy)(candidates, threshold), "matches")

    exact = written(exact_join(left, right), "matches")
    l1, r1 = remaining(left, exact, "original"), remaining(right, exact, "modified")
    fuzzy = choose(fuzzy_candidates(l1, r1), FUZZY)
    l2, r2 = remaining(l1, fuzzy, "original"), remaining(r1, fuzzy, "modified")
    structure = choose(structure_candidates(l2, r2), STRUCTURE)
    so_far = exact.unionByName(fuzzy).unionByName(structure)
    l3, r3 = remaining(l2, structure, "original"), remaining(r2, structure, "modified")
    context = choose(context_candidates(l2 if as_coded else l3, r3, so_far), CONTEXT)
    content = choose(content_candidates(remaining(l3, context, "original"), remaining(r3, context, "modified")), CONTENT)
    tagged = [m.withColumn("match_type", F.lit(n)) for m, n in (
        (exact, "exact"), (fuzzy, "fuzzy"), (structure, "fuzzy+structure"), (context, "contextual"), (content, "content"))]
    out = tagged[0]
    for m in tagged[1:]:
        out = out.unionByName(m)
    return out


def unmatched(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """Files of either side that no match has: pair_id, file_type, side, path."""
    sides = ((left, "original"), (right, "modified"))
    a, b = (remaining(f, matches, s).select(*GROUP, F.lit(s).alias("side"), "path") for f, s in sides)
    return a.unionByName(b)
