"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weight's share of all words, at most ``MAX_EPOCHS``
times its own; what is over goes to the others by weight.  Whole epochs of a
source come first; the rest is a weighted sample without replacement: each
document has the exponential key ``-ln(u) / weight`` (u from a digest of its
id), and in order of keys every document is taken that fits what is still
missing of the target, any other is passed over.  At last one document is added,
left out or exchanged for another, if that brings the source nearer: of all
sizes the pair that comes nearest, then the smallest sizes.

The weight is the document's quality: a column that the caller names, else the
share of five rules on the text that it keeps (``quality_weight``).

Three levels keep a source with a third of all rows out of a single task:

* keys are cut into ``BUCKETS`` ranges whose sizes are added up by source; all
  documents of the buckets below the one in which the target falls are taken;
* the documents of that bucket are passed in order;
* what is then missing is less than one document.  Of the later ones, no more of
  a size can fit than its size goes into what is missing, so only the buckets
  that hold so many are passed in order.

Documents with the same key and size are one class with a count; a class that is
taken in part is dealt to its rows by running counts over the table's partitions.

Defined cases: a null text has size 0; documents of size 0 are in whole epochs
alone; null is a source of its own, last in order; repeated rows are documents
of their own; a null id has the key of its text; a null, negative or non-finite
weight counts as the least weight; an empty table gives an empty table; columns
not named are ignored.  The targets are computed over one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BUCKETS = 4096
LEAST_WEIGHT = 0.05


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Share of five rules that a text of ``size`` words keeps: 50 to 100,000 words; 3 to 10
    characters a word; four fifths of them letters or non-ASCII; a mark of
    ``#{}<>|`` on a tenth of the words at most; seven tenths of the lines distinct."""
    text = F.coalesce(text, F.lit(""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    letters = F.length(F.regexp_replace(text, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", ""))
    marks = F.length(text) - F.length(F.translate(text, "#{}<>|", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    rules = (size.between(50, 100_000), (solid >= 3 * size) & (solid <= 10 * size) & (size > 0), (5 * letters >= 4 * solid) & (solid > 0),
             (10 * marks <= size) & (size > 0), (10 * F.size(F.array_distinct(lines)) >= 7 * F.size(lines)) & (F.size(lines) > 0))
    kept = sum((r.cast("int") for r in rules[1:]), rules[0].cast("int"))
    return F.greatest(F.lit(LEAST_WEIGHT), kept / F.lit(5.0))


def uniform(key: Column, text: Column) -> Column:
    """In (0, 1), from 52 bits of the MD5 digest of the key's text, or of the document's if the key is null."""
    bits = F.conv(F.substr(F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("null "), text), F.lit(""))), F.lit(1), F.lit(13)), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``src, source_size, target`` from ``src, source_size`` (src: "=" before the name, empty for null).

    One row a source: the rank and the share are windows over that small table.
    Sources are capped in order of (cap / weight) until a common level for the
    others lies below their caps, which is where repeated sharing ends.
    """
    order = W.orderBy(F.col("src") == "", "src")
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") - 1) % len(weights)))
    ranked = ranked.withColumn("cap", max_epochs * F.col("source_size").cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    every = W.partitionBy()
    lower = W.orderBy("level", "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("level", "rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = ranked.withColumn(
        "share", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(lower), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source in this order whose cap is above the common level fixes that level
    ranked = ranked.withColumn("common", F.min(F.when(F.col("level") >= F.col("share"), F.struct("level", "rank", "share"))).over(every)["share"])
    return ranked.select("src", "source_size", F.when(F.col("level") < F.col("common"), F.col("cap")).otherwise(
        F.coalesce(F.col("weight") * F.col("common"), F.col("cap"))).alias("target"))


def _pass(batches):
    """Rows sorted by source and key: each class of documents is taken as often as it fits."""
    import pyarrow as pa

    now, room = None, 0
    for b in batches:
        out: list[tuple] = []
        for src, start, es, size, n in zip(*(c.to_pylist() for c in b.columns)):
            if src != now:
                now, room = src, start
            m = min(n, room // size)
            if m > 0:
                room -= m * size
                out.append((src, es, size, n, m))
        if out:
            yield pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                *(pa.array([x[k] for x in out], pa.int64()) for k in (2, 3, 4))], names=["src", "es", "size", "n", "m"])


def _in_order(candidates: DataFrame) -> DataFrame:
    """``src, es, size, n, m`` of the classes taken (m of n documents), from documents ``src, room, es, size``."""
    classes = candidates.groupBy("src", "room", "es", "size").agg(F.count("*").alias("n")).select("src", "room", "es", "size", "n")
    return classes.repartition("src").sortWithinPartitions("src", "es", "size").mapInArrow(_pass, "src string, es double, size long, n long, m long")


def _nearest(sizes):
    """The exchange that brings one source nearest; rows are its distinct sizes."""
    import numpy as np
    import pandas as pd

    sizes = sizes.sort_values("size", kind="stable")
    miss = float(sizes["missing"].iloc[0])
    free = sizes[sizes["free_es"].notna()]
    used = sizes[sizes["used_es"].notna()]
    u = np.concatenate([[0], free["size"].to_numpy(np.int64)])
    t = np.concatenate([[0], used["size"].to_numpy(np.int64)])
    want = miss + t  # the size to add for each one that is left out
    at = np.searchsorted(u, want)
    options = [(abs(miss - int(u[k] - x)), int(u[k] - x), int(u[k]), int(x))
               for x, a in zip(t.tolist(), at.tolist()) for k in (a - 1, a) if 0 <= k < len(u)]
    _, _, add, drop = min(options)
    out = []
    if add != drop:
        if add:
            out.append((sizes["src"].iloc[0], float(free.loc[free["size"] == add, "free_es"].iloc[0]), add, 1))
        if drop:
            out.append((sizes["src"].iloc[0], float(used.loc[used["size"] == drop, "used_es"].iloc[0]), drop, -1))
    return pd.DataFrame(out, columns=["src", "es", "size", "d"])


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS, row: str | None = None, weight: str | None = None) -> DataFrame:
    """``key, size, source_size, target, taken, copies`` for every row: copies is
    how often the mix has the document, taken its size times that; and the
    column ``row`` of the documents if it is named.  ``weight`` names a column
    of quality weights."""
    carried = [] if row is None else [F.col(row).alias("own")]
    given = F.lit(None).cast("double") if weight is None else F.col(weight).cast("double")
    docs = documents.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("t"), given.alias("given"), *carried)
    docs = docs.withColumn("size", n_words(F.col("t")))
    if weight is None:
        quality = quality_weight(F.col("t"), F.col("size"))
    else:
        fine = F.col("given").isNotNull() & ~F.isnan("given") & (F.col("given") < float("inf"))
        quality = F.when(fine, F.greatest(F.lit(LEAST_WEIGHT), F.col("given"))).otherwise(F.lit(LEAST_WEIGHT))
    docs = docs.select(
        "k", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"), "size",
        (-F.log(uniform(F.col("k"), F.col("t"))) / quality).alias("es"), F.monotonically_increasing_id().alias("row"), *(["own"] if carried else []))
    # 1 - exp(-key) grows with the key, so buckets follow the order of keys
    docs = docs.withColumn("bucket", F.floor((1 - F.exp(-F.col("es"))) * buckets).cast("int"))
    # the text is read once; from here on row numbers are fixed and rows narrow
    docs = written(docs, "sizes")

    goal = targets(docs.groupBy("src").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", F.nullif("source_size", F.lit(0)))), F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = written(goal.withColumn("whole", F.floor("rest").cast("long")), "targets")

    # the bucket of each source in which the running sum passes what is left to take
    sums = docs.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
    edges = sums.join(goal, "src").where(F.col("below") + F.col("words") > F.col("whole")).groupBy("src").agg(F.min(F.struct("bucket", "below")).alias("e"))
    goal = goal.join(edges, "src", "left").select(
        *goal.columns, F.coalesce("e.bucket", F.lit(-1)).alias("edge"), (F.col("whole") - F.coalesce("e.below", F.lit(0))).alias("room"))
    goal = written(goal, "edges")
    some = docs.where("size > 0").join(goal.select("src", "edge", "room"), "src")
    inside = written(_in_order(some.where("bucket = edge and size <= room")), "inside")

    # later buckets, as far as they hold documents that may still fit
    def less(goal: DataFrame, classes: DataFrame) -> DataFrame:
        words = classes.groupBy("src").agg(F.sum(F.col("m") * F.col("size")).alias("words"))
        return goal.join(words, "src", "left").withColumn("room", F.col("room") - F.coalesce("words", F.lit(0))).drop("words")

    goal = written(less(goal, inside), "room")
    later = docs.where("size > 0").join(goal.select("src", "edge", "room"), "src").where("bucket > edge and size <= room")
    held = later.groupBy("src", "room", "size", "bucket").agg(F.count("*").alias("n"))
    sooner = W.partitionBy("src", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("sooner", F.coalesce(F.sum("n").over(sooner), F.lit(0))).where("sooner < floor(room / size)").select("src", "size", "bucket")
    after = written(_in_order(later.join(held, ["src", "size", "bucket"])), "after")
    goal = written(less(goal, after).withColumn("missing", F.col("room") + (F.col("rest") - F.col("whole"))), "missing")

    # one document more, less or another
    classes = inside.union(after)
    base = F.col("bucket") < F.col("edge")
    state = docs.where("size > 0").join(goal.select("src", "edge", "missing"), "src").join(classes, ["src", "es", "size"], "left")
    sizes = state.groupBy("src", "missing", "size").agg(
        F.min(F.when(~base & (F.col("m").isNull() | (F.col("m") < F.col("n"))), F.col("es"))).alias("free_es"),
        F.max(F.when(base | (F.col("m") > 0), F.col("es"))).alias("used_es"))
    swaps = written(sizes.groupBy("src").applyInPandas(_nearest, "src string, es double, size long, d long"), "swaps")

    # classes that are not wholly taken or wholly left: how many of each partition's rows
    touched = classes.select("src", "es", "size", "m", F.lit(0).cast("long").alias("d")).unionByName(swaps.withColumn("m", F.lit(0).cast("long"))).groupBy("src", "es", "size").agg(
        F.sum("m").alias("m"), F.sum("d").alias("d"))
    rows = docs.join(touched, ["src", "es", "size"]).join(goal.select("src", "edge"), "src").select(
        "src", "es", "size", "m", "d", "row", base.alias("base"), F.shiftright("row", 33).alias("part"))
    one = ["src", "es", "size"]
    parts = rows.groupBy(*one, "part", "m", "d", "base").agg(F.count("*").alias("n"))
    share = F.when(F.col("base"), F.sum("n").over(W.partitionBy(*one))).otherwise(F.col("m")) + F.col("d")
    parts = parts.select(*one, "part", (share - F.sum("n").over(W.partitionBy(*one).orderBy("part")) + F.col("n")).alias("quota"))
    nth = F.row_number().over(W.partitionBy(*one, "part").orderBy("row"))
    dealt = rows.withColumn("nth", nth).join(parts, [*one, "part"]).select(F.col("row").alias("r"), (F.col("nth") <= F.col("quota")).alias("chosen"))

    out = docs.join(goal.select("src", "source_size", "target", "epochs", "edge"), "src").join(dealt, F.col("row") == F.col("r"), "left")
    fraction = F.coalesce("chosen", base & (F.col("size") > 0))
    out = out.withColumn("copies", F.col("epochs") + fraction.cast("long"))
    return out.select(F.col("k").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
                      *([F.col("own").alias(row)] if carried else []))
