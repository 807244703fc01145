"""Near-duplicate embeddings by E8 lattice hashing.

In each of several tables a vector is projected at random to eight dimensions,
shifted, and decoded to the nearest point of the E8 lattice, its cell; the
``PROBES`` neighbouring lattice points nearest to the projection are further
cells in which it is compared.  Two vectors meet in a cell if it is the own cell
of one of them at least.  Every pair that meets is verified by its cosine in
double precision.

A key may join several lattice points (``points``), each of a projection of its
own, which are probed one at a time.  More points make cells smaller, and more
``tables`` make up for the recall.  Both are parameters and do not depend on the
input.  Share of the pairs at a cosine of 0.9 exactly (the worst that count)
that meet, and chance meetings of vectors without likeness, both measured over
drawn pairs (``tests/llm/test_lattice_settings.py``):

====== ====== =========== =====================
points tables pairs found chance, each table
====== ====== =========== =====================
1      6      0.997       1 pair of 100
2      14     0.985       1 of 13,000
3      30     0.950       1 of 1,500,000
====== ====== =========== =====================

Equal vectors are one class, known by a number given to their digest; ids only
name components in the end.  A cell does not yield its pairs: it yields for
each class the number of vectors newly linked to it, and a spanning forest.  A
pair that meets in several cells is counted in the first, which both sides know
from their cells.  A cell with more than ``BLOCK`` classes is dealt to several
tasks, each taking two of its blocks: the comparisons of a dense cluster are
quadratic in its different vectors, because ``n_links`` counts them all.

Defined cases: null, zero and empty vectors and those with null or non-finite
components link with nothing; vectors of different lengths never link; vectors
with a null id link and count as any other, but name no component (one without
any id is null); repeated rows, and rows that share an id but not the vector,
are vectors of their own; an empty table gives an empty table; columns not named
are ignored.  Ids must be numbers.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

THRESHOLD = 0.9
POINTS = 1
TABLES = 6
PROBES = 2
SCALE = 0.7
BLOCK = 2048
SEED = 20240


def neighbours():
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    import numpy as np

    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    half = [[-0.5 if n >> k & 1 else 0.5 for k in range(8)] for n in range(256) if n.bit_count() % 2 == 0]
    return np.array(whole + half, float)


def nearest_point(x):
    """The nearest E8 point of each row: the nearer of those of D8 and of D8 + 1/2."""
    import numpy as np

    def d8(y):
        near = np.rint(y)
        odd = near.sum(axis=1) % 2 != 0
        off = y - near
        rows, worst = np.arange(len(y)), np.abs(off).argmax(axis=1)
        step = np.zeros_like(near)
        step[rows, worst] = np.where(off[rows, worst] >= 0, 1.0, -1.0)
        return near + step * odd[:, None]

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _number(points, table: int):
    """64-bit hash of a table and lattice points given as (n, 8 * points) doubled whole numbers."""
    import numpy as np

    h = np.full(len(points), (0x9E3779B97F4A7C15 * (table + 1)) & (2**64 - 1), np.uint64)
    for c in np.rint(points * 2).astype(np.int64).view(np.uint64).T:
        h = (h ^ c) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def cells(unit, points: int = POINTS, tables: int = TABLES, probes: int = PROBES):
    """(n, tables, 1 + probes * points) cell numbers of unit vectors, own cell first."""
    import numpy as np

    roots = neighbours()
    out = []
    for t in range(tables):
        rng = np.random.default_rng([SEED, t, unit.shape[1]])
        own, best = [], []
        for _ in range(points):
            x = unit @ (rng.normal(size=(unit.shape[1], 8)) / math.sqrt(8) / SCALE) + rng.uniform(-1, 1, 8)
            p = nearest_point(x)
            # |x - p - r|^2 differs between neighbours r by -2 (x - p) r alone
            order = np.argsort(-((x - p) @ roots.T), axis=1, kind="stable")[:, :probes]
            own.append(p)
            best.append(p[:, None, :] + roots[order])
        keys = [_number(np.concatenate(own, axis=1), t)]
        for k in range(points):
            for q in range(probes):
                keys.append(_number(np.concatenate([best[k][:, q] if m == k else own[m] for m in range(points)], axis=1), t))
        out.append(np.stack(keys, axis=1))
    return np.stack(out, axis=1)


def _identify(kind: str):
    """Rows ``vec_id, v`` with the digest of a usable vector (else null) and its components as bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # a null is not a number, -0 is 0
                ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                digests: list = []
                for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    v = flat[start:end]
                    usable = end > start and np.isfinite(v).all() and v.any()
                    digests.append((hashlib.blake2b(v.tobytes(), digest_size=16).digest(), v.tobytes()) if usable else (None, None))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in digests], pa.binary()), pa.array([x[1] for x in digests], pa.binary())], names=["vec_id", "d", "v"])

    return run


def _unit(vectors: list, kind: str):
    """Unit vectors, from bytes, in double precision; scaled first, so that no square overflows."""
    import numpy as np

    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: list):
    import numpy as np

    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        yield np.nonzero(sizes == size)[0]


def _hash(kind: str, points: int, tables: int):
    """``class, v`` with the cells of each vector: own first, table by table."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width = tables * (1 + PROBES * points)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                vectors = part.column(1).to_pylist()
                codes = np.zeros((len(vectors), width), np.int64)
                for rows in _by_length(vectors):
                    codes[rows] = cells(_unit([vectors[r] for r in rows], kind), points, tables).view(np.int64).reshape(len(rows), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * width), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "codes"])

    return run


def _first_meeting(codes, i, j, width: int):
    """(whether the pairs i, j of rows meet, cell of their first meeting): that of the first table, smallest cell."""
    import numpy as np

    keys = codes.reshape(len(codes), -1, width)
    met = np.zeros(len(i), bool)
    first = np.zeros(len(i), np.int64)
    for t in range(keys.shape[1]):
        a, b = keys[i, t], keys[j, t]
        one, two = (b == a[:, :1]).any(axis=1), (a == b[:, :1]).any(axis=1)
        own = np.where(one & two, np.minimum(a[:, 0], b[:, 0]), np.where(one, a[:, 0], b[:, 0]))
        first = np.where((one | two) & ~met, own, first)
        met |= one | two
    return met, first


def _verify(kind: str, threshold: float, width: int):
    """Classes sorted by dealt block pair: the links of each, and a spanning forest."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(at, parts):
            """(class, root, newly linked vectors) of the classes of one dealt block pair."""
            classes, count, half, codes = (np.concatenate([p[k] for p in parts]) for k in range(4))
            vectors = [v for p in parts for v in p[4]]
            n = len(vectors)
            total = np.zeros(n, np.int64)
            label = np.arange(n)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for own in _by_length(vectors):
                x = _unit([vectors[k] for k in own], kind)
                for lo in range(0, len(own), 512):
                    a, b = np.nonzero(x[lo : lo + 512] @ x.T >= threshold)
                    a += lo
                    ok = a < b
                    a, b = own[a[ok]], own[b[ok]]
                    if at[1] != at[2]:  # two blocks: pairs inside one are another task's
                        ok = half[a] != half[b]
                        a, b = a[ok], b[ok]
                    met, first = _first_meeting(codes, a, b, width)
                    us.append(a[met])
                    vs.append(b[met])
                    counted = met & (first == at[0])
                    np.add.at(total, a[counted], count[b[counted]])
                    np.add.at(total, b[counted], count[a[counted]])
            u, v = np.concatenate(us), np.concatenate(vs)
            while len(u):
                low = np.minimum(label[u], label[v])
                new = label.copy()
                np.minimum.at(new, u, low)
                np.minimum.at(new, v, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            some = np.nonzero((total > 0) | (label != np.arange(n)))[0]
            return pa.RecordBatch.from_arrays([pa.array(classes[some]), pa.array(classes[label[some]]), pa.array(total[some])], names=["class", "root", "links"])

        now, held, size = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            cuts = [0, *(np.nonzero((place[1:] != place[:-1]).any(axis=1))[0] + 1).tolist(), len(place)]
            numbers = [b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5)]
            codes = b.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(place), -1)
            vectors = b.column(7).to_pylist()
            for lo, hi in zip(cuts, cuts[1:]):
                at = tuple(place[lo].tolist())
                if at != now:
                    if size > 1:
                        yield links(now, held)
                    now, held, size = at, [], 0
                held.append((*(x[lo:hi] for x in numbers), codes[lo:hi], vectors[lo:hi]))
                size += hi - lo
        if size > 1:
            yield links(now, held)

    return run


def near_embeddings(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    points: int = POINTS, tables: int = TABLES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    # vectors travel as they are stored; their cosines are taken in doubles
    single = embeddings.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    rows = written(rows.mapInArrow(_identify(kind), "vec_id long, d binary, v binary"), "vectors")
    classes = rows.where("d is not null").groupBy("d").agg(F.any_value("v").alias("v"), F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = classes.select(F.monotonically_increasing_id().alias("class"), "v", "low", "n", "d")
    width = 1 + PROBES * points
    coded = written(classes.mapInArrow(_hash(kind, points, tables), "class long, v binary, low long, n long, d binary, codes array<long>"), "cells")
    met = coded.select("class", F.explode(F.array_distinct("codes")).alias("key"))
    # cells by size: one member needs no comparing, more than a block of them are dealt to several tasks
    sizes = met.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    dealt = met.join(sizes, "key").withColumn("parts", F.ceil(F.col("size") / BLOCK))
    dealt = dealt.withColumn("half", F.pmod(F.xxhash64("class"), F.col("parts")))
    dealt = dealt.select("class", "key", "half", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("class", "key", "half", F.least("half", "other").alias("s"), F.greatest("half", "other").alias("t"))
    full = dealt.join(coded, "class").select("key", "s", "t", "class", "n", "half", "codes", "v")
    found = full.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t").mapInArrow(_verify(kind, threshold, width), "class long, root long, links long")
    found = written(found, "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.where("class <> root"), "class", "root")
    named = (coded.select("class", "d", "low", "n").join(links, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
             .select("d", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root")))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.select("d", "n_links", "root").join(lows, "root").select("d", "n_links", "component_id", F.lit(True).alias("usable"))
    out = rows.select("vec_id", "d").join(named, "d", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
