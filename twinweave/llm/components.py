"""Connected components by alternating large-star and small-star rounds.

Every round is a handful of joins and min-aggregations over the edge table; the
edges are written to the shared folder between rounds.  No round collects edges
to the driver.  A hub is only ever reduced by a partial aggregation: a node with
more than ``1 / SHARE`` of the edges meets its minimum by a broadcast of at most
``2 * SHARE`` rows (edges stand in both directions), so that its edges stay where
they are; the other nodes' edges are dealt by node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, work_dir, written


#: Nodes that a task holds at once while it contracts edges.
HELD = 500_000
#: A node with more than this part of all edges is not dealt to one task.
SHARE = 1000


def _contract(batches):
    """Union-find over runs of one partition's edges: a star forest in their place."""
    import numpy as np
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x] = top
            x = p
        return top

    def stars():
        rows = [(k, root(k)) for k in up]
        up.clear()
        for i in range(0, len(rows), 100_000):
            part = np.array(rows[i : i + 100_000], dtype=np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > HELD:
            yield from stars()
    yield from stars()


def _with_minimum(edges: DataFrame, minima: DataFrame, total: int) -> DataFrame:
    """``u, v, m`` for edges ``u, v`` and minima ``u, m, n`` (n edges of the node), out of ``total`` edges in one direction."""
    heavy = F.broadcast(minima.where(F.col("n") * SHARE > total).select("u", "m"))
    light = minima.where(F.col("n") * SHARE <= total).select("u", "m")
    dealt = edges.join(heavy.select("u"), "u", "left_anti").join(light, "u")
    return edges.join(heavy, "u").select("u", "v", "m").union(dealt.select("u", "v", "m"))


def components(edges: DataFrame, left: str, right: str, link: Callable | None = None) -> DataFrame:
    """``node long, root long`` for every node that has an edge.

    ``root`` is the smallest node of the component.  Null ends and loops are
    ignored, repeated edges count once; an empty table gives an empty table.

    With ``link``, a function from batches of ``edges`` to batches of their two
    longs ``left`` and ``right`` (never null), a partition's edges are found and
    contracted by one Python worker; a function after a function takes two.
    """
    spark = edges.sparkSession
    path = work_dir(spark, "edges")
    if link is None:
        e = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
        e = e.where("u is not null and v is not null and u <> v")
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_contract, "u long, v long")
    else:
        e = edges.mapInArrow(lambda batches: _contract(b.select([left, right]) for b in link(batches)), "u long, v long")
    e = written(e, "edges", path)
    before, total = None, e.count()
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_minimum(both, low, total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_minimum(large, parent, total).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new_path = work_dir(spark, "edges")
        e = written(small.where("u <> v").distinct(), "edges", new_path)
        remove(spark, path)
        path = new_path
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before, total = now, now[0]
