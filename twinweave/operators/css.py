"""Comparison of stylesheets: outer joins over declaration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.css import css_declarations, normalize_keyframe_value, normalize_value, parse_css, resolve_vars
from ..functions.similarity import py_round
from ..storage import written

MATCHING, PARTIAL = 0.9, 0.3


def declaration_table(sheets: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """``key`` with one row per declaration; of repeated ones the last counts."""
    rows = sheets.select(key, F.explode(css_declarations(content)).alias("d")).select(key, "d.*")
    same = [key, "scope", "scope_key", "selector", "prop"]
    return rows.groupBy(*same).agg(F.max_by(F.struct("value", "important", "ord"), "ord").alias("v")).select(*same, "v.*")


def rule_diff(left: DataFrame, right: DataFrame, keys: list[str], scope: str = "rule") -> DataFrame:
    """One row per ``keys`` (and scope_key): matching, different, missing, extra,
    partial and total selectors and the similarity.

    Selectors are trimmed and made small; of selectors that then collide the
    last one counts.  A selector's similarity is its share of equal values.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col("scope") == scope).withColumn("sel", F.lower(F.trim("selector")))
        last = rows.groupBy(*keys, "scope_key", "sel").agg(F.max_by("selector", "ord").alias("selector"))
        rows = rows.join(last, [*keys, "scope_key", "sel", "selector"])
        return rows.select(*keys, "scope_key", "sel", "prop", normalize_value(F.col("value")).alias(name))

    by = [*keys, "scope_key"]
    both = side(left, "a").join(side(right, "b"), [*by, "sel", "prop"], "full")
    selectors = both.groupBy(*by, "sel").agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count("*").alias("props"))
    shared = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    sim = F.when(shared, F.col("equal") / F.col("props"))
    totals = selectors.withColumn("sim", sim).groupBy(*by).agg(
        F.count_if(F.col("sim") >= MATCHING).alias("matching"),
        F.coalesce(F.sum(F.when((F.col("sim") >= PARTIAL) & (F.col("sim") < MATCHING), F.col("sim"))), F.lit(0.0)).alias("partial"),
        F.count_if(F.col("n_right") == 0).alias("missing"), F.count_if(F.col("n_left") == 0).alias("extra"), F.count("*").alias("total"))
    return totals.select(
        *by, "matching", (F.col("total") - F.col("matching") - F.col("missing") - F.col("extra")).alias("different"), "missing", "extra", "partial", "total",
        ((F.col("matching") + F.col("partial")) / F.col("total")).alias("similarity"))


def selector_details(left: DataFrame, right: DataFrame, keys: list[str], scope: str = "rule") -> DataFrame:
    """Per shared selector the properties that match, are missing, or are extra."""
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col("scope") == scope).withColumn("sel", F.lower(F.trim("selector")))
        return rows.groupBy(*keys, "scope_key", "sel", "prop").agg(normalize_value(F.max_by("value", "ord")).alias(name))

    both = side(left, "a").join(side(right, "b"), [*keys, "scope_key", "sel", "prop"], "full")
    pick = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("prop"))))
    grouped = both.groupBy(*keys, "scope_key", "sel").agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"), pick(F.col("a") == F.col("b")).alias("matching_props"),
        pick(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("different_props"),
        pick(F.col("b").isNull()).alias("missing_props"), pick(F.col("a").isNull()).alias("extra_props"))
    return grouped.where("n_left > 0 and n_right > 0").drop("n_left", "n_right")


def keyframes_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: matching (shared names), different (of these), missing, extra."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where("scope = 'keyframes'").select(*keys, F.col("scope_key").alias("name"), F.col("selector").alias("step"), "prop",
                                                       normalize_keyframe_value(F.col("value")).alias(name))

    both = side(left, "a").join(side(right, "b"), [*keys, "name", "step", "prop"], "full")
    steps = both.groupBy(*keys, "name", "step").agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("differs"))
    names = steps.groupBy(*keys, "name").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"),
                                              F.count_if("differs").alias("step_differences"), F.count("*").alias("total_steps"))
    shared = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    return names.groupBy(*keys).agg(
        F.count_if(shared).alias("matching_keyframes"), F.count_if(shared & (F.col("step_differences") > 0)).alias("different_keyframes"),
        F.count_if(F.col("n_right") == 0).alias("missing_keyframes"), F.count_if(F.col("n_left") == 0).alias("extra_keyframes"))


def condition_diff(left: DataFrame, right: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """Media or supports conditions: shared ones with their rule diff, the others
    as missing or extra.  Not part of the score."""
    sides = [df.where(F.col("scope") == scope).select(*keys, "scope_key").distinct().withColumn(n, F.lit(True)) for df, n in ((left, "in_left"), (right, "in_right"))]
    state = F.when(F.col("in_left") & F.col("in_right"), "matching").when(F.col("in_left"), "missing").otherwise("extra")
    both = sides[0].join(sides[1], [*keys, "scope_key"], "full").select(*keys, "scope_key", state.alias("state"))
    return both.join(rule_diff(left, right, keys, scope), [*keys, "scope_key"], "left")


def compare_stylesheets(pairs: DataFrame, key: str = "pair_key", left: str = "original_content", right: str = "modified_content") -> DataFrame:
    """``key, css_similarity, matching, different, missing, extra`` for each pair of
    texts; two texts without rules are alike."""
    sides = [declaration_table(pairs.select(key, F.col(c).alias("content")), key) for c in (left, right)]
    diff = rule_diff(*sides, [key]).drop("scope_key")
    zero = F.lit(0).cast("long")
    return pairs.select(key).join(diff, key, "left").select(
        key, F.coalesce("similarity", F.lit(1.0)).alias("css_similarity"), *(F.coalesce(c, zero).alias(c) for c in ("matching", "different", "missing", "extra")))


def stylesheet_details(pairs: DataFrame, key: str = "pair_key", left: str = "original_content", right: str = "modified_content") -> DataFrame:
    """``key, media, supports, keyframes, selectors``: conditions with their state and
    rule counts, counts of keyframes, and the properties of shared selectors;
    empty lists and nulls where a pair has none."""
    sides = [written(declaration_table(pairs.select(key, F.col(c).alias("content")), key), "declarations") for c in (left, right)]
    out = pairs.select(key)
    for scope in ("media", "supports"):
        entry = F.struct(F.col("scope_key").alias("condition"), "state", "matching", "different", "missing", "extra", "similarity")
        out = out.join(condition_diff(*sides, [key], scope).groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias(scope)), key, "left")
    frames = keyframes_diff(*sides, [key])
    out = out.join(frames.select(key, F.struct(*(c for c in frames.columns if c != key)).alias("keyframes")), key, "left")
    entry = F.struct(F.col("sel").alias("selector"), "matching_props", "different_props", "missing_props", "extra_props")
    return out.join(selector_details(*sides, [key]).groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("selectors")), key, "left")


def summary_text(matching, different, missing, extra):
    return F.format_string("%d matching, %d different, %d missing, %d extra selectors", matching, different, missing, extra)


def similarity_of_texts(a: str, b: str) -> float:
    """The score of two texts, for joins that compare many candidates in one task."""
    def table(text: str) -> dict[str, dict[str, str]]:
        rows = parse_css(text)
        variables = {r[3]: r[4] for r in rows if r[0] == "var"}
        out: dict[str, tuple[str, dict[str, str]]] = {}
        for scope, _, selector, prop, value, _, _ in rows:
            if scope == "rule":
                low = selector.strip().lower()
                if low not in out or out[low][0] != selector:
                    out[low] = (selector, {})
                out[low][1][prop] = plain_value(resolve_vars(value, variables))
        return {k: v for k, (_, v) in out.items()}

    x, y = table(a), table(b)
    names = x.keys() | y.keys()
    if not names:
        return 1.0
    score = 0.0
    for n in x.keys() & y.keys():
        sim = sum(x[n].get(p) == v for p, v in y[n].items()) / len(x[n].keys() | y[n].keys())
        score += 1.0 if sim >= MATCHING else sim if sim >= PARTIAL else 0.0
    return py_round(score / len(names), 2)


def plain_value(value: str) -> str:
    import re

    v = value.strip().lower().rstrip(";")
    if re.fullmatch("#[0-9a-f]{3}", v):
        return "#" + "".join(c * 2 for c in v[1:])
    pixels = re.fullmatch(r"([0-9]*\.?[0-9]+)px", v)
    return str(float(pixels[1])) if pixels else v


def selector_similarity(a, b):
    """Share of equal normalised values among all properties of two maps; a missing
    one counts as the empty value, no properties as 1."""
    from pyspark.sql import Column

    def normal(m: Column) -> Column:
        return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(F.trim(e["key"])), normalize_value(e["value"]))))

    x, y = normal(a), normal(b)
    props = F.array_union(F.map_keys(x), F.map_keys(y))
    value = lambda m, k: F.coalesce(m[k], F.lit(""))
    return F.when(F.size(props) == 0, F.lit(1.0)).otherwise(F.size(F.filter(props, lambda k: value(x, k) == value(y, k))) / F.size(props)).cast("double")
