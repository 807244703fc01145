"""Aggregation of pair scores to file types, projects and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import HIGH, verdict_level
from .classes import is_soft

GROUP = ["pair_id", "file_type"]
FILE_WEIGHTS = {"html": 0.3, "jsx": 0.3, "js": 0.4}
PACKAGE_FILES, TSCONFIG_FILES = 2, 1


def type_scores(pairs: DataFrame, unmatched: DataFrame) -> DataFrame:
    """``pair_id, file_type, matched, unmatched, similarity, level``: the sum of
    similarities over all files, unmatched ones counting 0."""
    m = pairs.groupBy(*GROUP).agg(F.sum("similarity").alias("total"), F.countDistinct("original", "modified").alias("matched"))
    u = unmatched.groupBy(*GROUP).agg(F.count("*").alias("unmatched"))
    zero = F.lit(0).cast("long")
    rows = m.join(u, GROUP, "full").select(*GROUP, F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("matched", zero).alias("matched"), F.coalesce("unmatched", zero).alias("unmatched"))
    score = F.coalesce(F.try_divide("total", F.col("matched") + F.col("unmatched")), F.lit(0.0))
    return rows.select(*GROUP, "matched", "unmatched", score.alias("similarity"), verdict_level(score).alias("level"))


def overall_scores(pairs: DataFrame, unmatched: DataFrame, hybrids: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """``pair_id, files, overall_similarity, level``: mean over matched pairs, files
    unmatched (0), class comparisons and, if given, configuration files, of which
    package.json counts as two and tsconfig.json as one."""
    rows = pairs.select("pair_id", F.col("similarity").alias("s")).unionByName(unmatched.select("pair_id", F.lit(0.0).alias("s"))).unionByName(
        hybrids.select("pair_id", F.col("hybrid_similarity").alias("s")))
    if configs is not None:
        for column, n in (("package_similarity", PACKAGE_FILES), ("tsconfig_similarity", TSCONFIG_FILES)):
            rows = rows.unionByName(configs.where(F.col(column).isNotNull()).select("pair_id", F.explode(F.array_repeat(F.col(column), n)).alias("s")))
    out = rows.groupBy("pair_id").agg(F.count("*").alias("files"), F.avg("s").alias("overall_similarity"))
    return out.withColumn("level", verdict_level(F.col("overall_similarity")))


def similarity_stats(hybrids: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, set mean, frequency mean, median, share of 0.9 and more, mean weighted
    by classes, and the mean without trivial changes, of class comparisons."""
    soft = F.avg(F.when(is_soft(F.col("changes")), F.col("hybrid_similarity"))) if "changes" in hybrids.columns else F.avg("hybrid_similarity")
    one = F.lit(1.0)
    mean = F.coalesce(F.avg("hybrid_similarity"), F.lit(0.0))
    return hybrids.groupBy(*keys).agg(
        mean.alias("mean_hybrid"), F.coalesce(F.avg("set_similarity"), one).alias("mean_set"), F.coalesce(F.avg("frequency_similarity"), one).alias("mean_frequency"),
        F.coalesce(F.median("hybrid_similarity"), one).alias("median_hybrid"),
        F.coalesce(F.avg((F.col("hybrid_similarity") >= 0.9).cast("double")), one).alias("share_high"),
        F.coalesce(F.try_divide(F.sum(F.col("hybrid_similarity") * F.col("n_classes")), F.sum("n_classes")), one).alias("weighted_hybrid"),
        F.coalesce(soft, mean).alias("soft_hybrid"))


def config_mean(similarities: DataFrame, column: str = "config_similarity") -> DataFrame:
    """Mean of configuration similarities; 0 for none."""
    return similarities.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("config_similarity"), F.count(column).alias("n_configs"))


def element_totals(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of element outcomes (column kind), with their total."""
    kinds = ("match", "different", "missing", "extra")
    return elements.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def column_totals(rows: DataFrame, keys: list[str], columns: tuple[str, ...] = ("matching", "different", "missing", "extra")) -> DataFrame:
    """Sums of selector or function counts, with the total of all four."""
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in columns]
    total = sum((F.coalesce(F.sum(c), F.lit(0).cast("long")) for c in columns), F.lit(0).cast("long"))
    return rows.groupBy(*keys).agg(*sums, total.alias("total"))


def metric_means(rows: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Means of script metrics over the pairs that have them."""
    return rows.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns))


def weighted_positive(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Mean of the scores above 0, weighted and renormalised; 0 for none."""
    weights = weights or {n: 1.0 for n in scores}
    positive = {n: F.coalesce(c > 0, F.lit(False)) for n, c in scores.items()}
    top = sum((F.when(positive[n], c * weights[n]).otherwise(0.0) for n, c in scores.items()), F.lit(0.0))
    low = sum((F.when(positive[n], F.lit(weights[n])).otherwise(0.0) for n in scores), F.lit(0.0))
    return F.when(low > 0, top / low).otherwise(0.0).cast("double")


def is_high(score: Column) -> Column:
    return score >= HIGH
