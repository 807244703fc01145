"""Reports: project against project, and one file pair.

The plan of a project comparison is: files of both sides -> matches (cascade) ->
one comparison per matched pair by type -> type, overall and summary scores ->
JSON.  Tables that several later parts use (matches, pair scores, class
comparisons) are written once to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.js import config_json
from ..functions.similarity import round2, round3, verdict
from ..functions.tree import compare_texts
from ..operators import classes, css, jsonconfig, jslogic, matching, scores
from ..storage import written

KEY = ["pair_id", "file_type", "original", "modified"]


@dataclass
class Comparison:
    """All tables of a comparison; each has pair_id."""

    matches: DataFrame
    unmatched: DataFrame
    pairs: DataFrame
    elements: DataFrame
    selectors: DataFrame
    sheets: DataFrame
    scripts: DataFrame
    hybrids: DataFrame
    configs: DataFrame
    theme: DataFrame
    types: DataFrame
    overall: DataFrame


def with_contents(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("pair_id", "file_type", F.col("path").alias("original"), F.col("content").alias("original_content"))
    b = right.select("pair_id", "file_type", F.col("path").alias("modified"), F.col("content").alias("modified_content"))
    return matches.join(a, ["pair_id", "file_type", "original"]).join(b, ["pair_id", "file_type", "modified"]).withColumn("pair_key", F.struct(*KEY))


def tree_comparison(pairs: DataFrame, key: str = "pair_key", a: str = "original_content", b: str = "modified_content", ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of each pair: key, kind, tag, score, attr, text."""
    # parsing and aligning cost far more than the bytes suggest by which adaptive
    # execution would merge partitions; a stated number keeps all cores at work
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    schema = f"`key` {pairs.schema[key].dataType.simpleString()}, kind string, tag string, score double, attr double, text double"
    rows = pairs.select(F.col(key).alias("key"), a, b).repartition(parts).mapInArrow(compare_texts(ignore), schema)
    return rows.select(F.col("key").alias(key), "kind", "tag", "score", "attr", "text")


def tree_scores(elements: DataFrame, key: str = "pair_key") -> DataFrame:
    """Mean score and counts of a pair's elements, by both names of the outcome."""
    kinds = {"match": "matching", "different": "different", "missing": "missing", "extra": "extra"}
    return elements.groupBy(key).agg(F.avg("score").alias("similarity"), *(F.count_if(F.col("kind") == k).alias(n) for k, n in kinds.items()))


def compare_projects(left: DataFrame, right: DataFrame, as_coded: bool = False, all_files: tuple[DataFrame, DataFrame] | None = None) -> Comparison:
    """Compares file tables (pair_id, file_type, path, content).

    ``all_files`` are both sides with files of any type, in which configuration
    files are looked for.  As coded, configurations do not enter the overall score.
    """
    keep = lambda d: written(d, "report")
    theme_of = lambda f: f.where("file_type = 'tailwind_config'").select("pair_id", "path", config_json("content").alias("config"))
    theme = theme_of(left).alias("a").join(theme_of(right).alias("b"), "pair_id").select(
        "pair_id", F.col("a.path").alias("original"), F.col("b.path").alias("modified"),
        F.when(F.col("a.config").isNotNull() & F.col("b.config").isNotNull(), classes.config_similarity(F.col("a.config"), F.col("b.config"))).otherwise(
            F.when(F.col("a.config").isNull() & F.col("b.config").isNull(), 1.0).otherwise(0.0)).alias("config_similarity"))
    left, right = (keep(f.where("file_type <> 'tailwind_config'")) for f in (left, right))
    # a file that could not be read (null) is like no other: it matches nothing and counts as unmatched
    matches = keep(matching.cascade(*(f.where("content is not null") for f in (left, right)), as_coded=as_coded))
    unmatched = keep(matching.unmatched(left, right, matches))
    joined = keep(with_contents(matches, left, right))

    elements = keep(tree_comparison(joined.where("file_type = 'html'")))
    html = tree_scores(elements).select("pair_key", "similarity")
    sheets = keep(css.compare_stylesheets(joined.where("file_type = 'css'")))
    details = keep(css.stylesheet_details(joined.where("file_type = 'css'")))
    scripts = keep(jslogic.compare_scripts(joined.where("file_type in ('js', 'jsx')"), as_coded=as_coded))
    found = html.unionByName(sheets.select("pair_key", F.col("css_similarity").alias("similarity"))).unionByName(scripts.select("pair_key", "similarity"))
    pairs = keep(joined.drop("original_content", "modified_content").join(found, "pair_key"))

    count = lambda c: classes.class_counts(joined.select("pair_key", "file_type", F.col(c).alias("content")), ["pair_key"])
    sides = [keep(count(c)) for c in ("original_content", "modified_content")]
    hybrids = classes.compare_with_impacts(*sides, ["pair_key"])
    hybrids = keep(hybrids.select("pair_key.*", "*").drop("pair_key"))

    configs = keep(jsonconfig.config_scores(*(all_files or (left, right))))
    return Comparison(
        matches, unmatched, pairs, elements.select("pair_key.*", "*").drop("pair_key"), sheets.select("pair_key.*", "*").drop("pair_key"),
        details.select("pair_key.*", "*").drop("pair_key"),
        scripts.select("pair_key.*", "*").drop("pair_key"), hybrids, configs, theme, scores.type_scores(pairs, unmatched),
        scores.overall_scores(pairs, unmatched, hybrids, None if as_coded else configs))


def project_report(c: Comparison) -> DataFrame:
    """``pair_id, report``: one JSON document a pair, numbers rounded as shown."""
    types = c.types.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct(
        "file_type", round3("similarity").alias("similarity"), verdict(F.col("similarity")).alias("prediction"), "matched", "unmatched"))).alias("types"))
    matched = c.pairs.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct(
        "file_type", "original", "modified", "match_type", round2("score").alias("match_score"), round2("similarity").alias("similarity")))).alias("matched_files"))
    missing = c.unmatched.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("side", "file_type", "path"))).alias("unmatched_files"))
    stats = scores.similarity_stats(c.hybrids, ["pair_id"])
    stats = stats.select("pair_id", F.struct(*(x for x in stats.columns if x != "pair_id")).alias("classes"))
    summary = [
        scores.element_totals(c.elements, ["pair_id"]), scores.column_totals(c.selectors, ["pair_id"]),
        scores.column_totals(c.scripts.select("pair_id", "counts.*"), ["pair_id"])]
    sheets = c.sheets.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct(
        "original", "modified", "media", "supports", "keyframes", "selectors"))).alias("stylesheets"))
    metrics = scores.metric_means(c.scripts, ["pair_id"], tuple(jslogic.WEIGHTS))
    metrics = metrics.select("pair_id", F.struct(*jslogic.WEIGHTS).alias("script_metrics"))
    out = c.overall
    for t in (types, matched, missing, stats, sheets, metrics, c.configs):
        out = out.join(t, "pair_id", "left")
    for name, t in zip(("elements", "selectors", "functions"), summary):
        out = out.join(t.select("pair_id", F.struct(*(x for x in t.columns if x != "pair_id")).alias(name)), "pair_id", "left")
    theme = c.theme.groupBy("pair_id").agg(F.avg("config_similarity").alias("theme_similarity"))
    out = out.join(theme, "pair_id", "left")
    return out.select("pair_id", F.to_json(F.struct(
        round3("overall_similarity").alias("overall_similarity"), verdict(F.col("overall_similarity")).alias("prediction"), "files", "types", "matched_files",
        "unmatched_files", "classes", F.coalesce("theme_similarity", F.lit(0.0)).alias("config_similarity"), "elements", "selectors", "stylesheets", "functions", "script_metrics",
        F.struct("package_similarity", "tsconfig_similarity").alias("json_similarity"))).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document a line, in a folder for each pair."""
    reports.select("pair_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("pair_id").text(path)


def compact(reports: DataFrame) -> DataFrame:
    """The short answer: overall score and prediction from the stored document."""
    get = lambda k: F.get_json_object("report", f"$.{k}")
    return reports.select("pair_id", get("overall_similarity").cast("double").alias("overall_similarity"), get("prediction").alias("prediction"), get("types").alias("types"))


def summary_text(**counts: Column) -> Column:
    """The counts by outcome and their sum: ``equal 3, changed 1, left only 0, right only 2 of 6``."""
    shown = [F.concat(F.lit(name.replace("_", " ") + " "), F.coalesce(n, F.lit(0)).cast("string")) for name, n in counts.items()]
    total = sum((F.coalesce(n, F.lit(0)) for n in counts.values()), F.lit(0))
    return F.concat(F.concat_ws(", ", *shown), F.lit(" of "), total.cast("string"))


def class_text(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, text``: the classes of each markup file as lines of name, count and line numbers, for printing."""
    rows = classes.class_lines(files, keys)
    line = F.format_string("%-32s %6d  %s", F.col("class"), F.col("n"), F.array_join(F.col("lines").cast("array<string>"), " "))
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))


def file_pair_report(pair: DataFrame) -> DataFrame:
    """One row per ``pair_id`` for single files: columns html1, html2, css1, css2,
    jsx1, jsx2, js1, js2, each null where not given."""
    def texts(kind: str) -> DataFrame:
        return pair.select("pair_id", F.lit(kind).alias("file_type"), F.col(f"{kind}1").alias("original_content"), F.col(f"{kind}2").alias("modified_content")).where(
            "original_content is not null and modified_content is not null")

    html = tree_scores(tree_comparison(texts("html"), "pair_id"), "pair_id")
    html = html.select("pair_id", F.col("similarity").alias("html_similarity"), summary_text(
        equal=F.col("matching"), changed=F.col("different"), left_only=F.col("missing"), right_only=F.col("extra")).alias("html_summary"))
    sheet = css.compare_stylesheets(texts("css"), "pair_id").select("pair_id", "css_similarity")
    out = pair.select("pair_id").join(html, "pair_id", "left").join(sheet, "pair_id", "left")
    for kind in ("jsx", "js"):
        out = out.join(jslogic.compare_scripts(texts(kind), "pair_id").select("pair_id", F.col("similarity").alias(f"{kind}_similarity")), "pair_id", "left")
    files = {n: F.col(f"{n}_similarity") for n in scores.FILE_WEIGHTS}
    plain = scores.weighted_positive({n: F.col(f"{n}_similarity") for n in ("html", "jsx", "css")})
    return out.withColumn("weighted_similarity", scores.weighted_positive(files, scores.FILE_WEIGHTS)).withColumn("overall_similarity", plain).withColumn("prediction", verdict(plain))


def text_report(reports: DataFrame) -> DataFrame:
    """``pair_id, text``: a plain-text version of a file pair's report."""
    shown = lambda c: F.concat(F.format_number(100 * F.coalesce(c, F.lit(0.0)), 2), F.lit("%"))
    return reports.select("pair_id", F.concat_ws(
        "\n", F.concat(F.lit("Pair "), F.col("pair_id").cast("string"), F.lit(": "), shown(F.col("overall_similarity")), F.lit(" alike")),
        F.concat(F.lit("HTML: "), shown(F.col("html_similarity")), F.lit(" "), F.coalesce("html_summary", F.lit(""))),
        F.concat(F.lit("JSX: "), shown(F.col("jsx_similarity"))), F.concat(F.lit("CSS: "), shown(F.col("css_similarity"))),
        F.concat(F.lit("JS: "), shown(F.col("js_similarity")))).alias("text"))
