"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins.  Cyclic boosting visits the features in
turn and adds a shallow tree over one feature's bins, shrunk, to that feature's
lookup table; then the pairs of features whose coarse grids still explain most
of the residual get tables the same way.  A score is the logistic function of
the sum of one table entry per feature and pair: vectorised additions.

The model is fitted by the driver on at most ``MAX_LABELLED`` labelled rows (the
bound is this parameter; the rows with the smallest hash of doc_id are taken);
every document is scored.  Inputs are statistics of the whole text alone.

Defined cases: a null text is the empty text; of labels that disagree on a
document the mean counts, 0.5 as good; labels with a null doc_id or quality are
not used; without labels every score is 0.5; every input row gives one row;
a text of any length is measured whole; columns not named are ignored; an empty
table gives an empty table.  Ids must be numbers, as labels have them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import small_table

MAX_LABELLED = 20_000
BINS = 32
GRID = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15
RIDGE = 1.0
THRESHOLD = 0.3

FEATURES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "stops", "pipes", "bangs", "other_bytes",
    "distinct_words", "top_word", "repeated_lines", "words_a_line", "long_words", "words_a_stop")

#: Bytes of each class whose share of a text is a feature.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\/=+_`", b".,;:?", b"|", b"!", bytes(range(128, 256)), b"\n")


def _class_table():
    import numpy as np

    table = np.zeros((256, len(_CLASSES)))
    for k, members in enumerate(_CLASSES):
        table[list(members), k] = 1
    return table


def features(texts: list) -> "object":
    """(n, features) array for whole texts."""
    from collections import Counter

    import numpy as np

    table = _class_table()
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text in zip(out, texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        upper, digits, symbols, stops, pipes, bangs, other, lines = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ table
        words = data.split()
        m = len(words)
        counts = Counter(words)
        parts = [x for x in data.split(b"\n") if x]
        row[:] = (
            math.log1p(m), n / max(m, 1), upper / n, digits / n, symbols / n, stops / n, pipes / n, bangs / n, other / n,
            len(counts) / max(m, 1), max(counts.values(), default=0) / max(m, 1), 1 - len(set(parts)) / max(len(parts), 1),
            math.log1p(m / (lines + 1)), sum(v for k, v in counts.items() if len(k) > 15) / max(m, 1), math.log1p(m / (stops + 1)))
    return out


@dataclass
class Model:
    cuts: list = field(default_factory=list)  # of each feature
    base: float = 0.0
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (feature, feature, grid)
    coarse: list = field(default_factory=list)  # coarse bin of each bin

    def bins(self, x):
        import numpy as np

        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)

    def score(self, x):
        import numpy as np

        z = np.full(len(x), self.base)
        if self.cuts:
            b = self.bins(x)
            for f, t in enumerate(self.tables):
                z += t[b[:, f]]
            for f, g, grid in self.pairs:
                z += grid[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(g, h):
    """Best place to cut a row of bins in two, and its gain."""
    import numpy as np

    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax()) if len(gain) else -1
    return k, (gain[k] if k >= 0 else 0.0)


def _leaf(g, h) -> float:
    return -g.sum() / (h.sum() + RIDGE)


def tree_1d(g, h, depth: int = 2):
    """Values of a shallow tree over one feature's bins."""
    import numpy as np

    k, gain = _cut(g, h) if depth else (-1, 0.0)
    if gain <= 1e-12:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([tree_1d(g[: k + 1], h[: k + 1], depth - 1), tree_1d(g[k + 1 :], h[k + 1 :], depth - 1)])


def tree_2d(g, h, depth: int = 2):
    """Values of a shallow tree over a pair's grid; each cut is along the better axis."""
    import numpy as np

    best = (0.0, 0, -1)
    if depth:
        for axis in (0, 1):
            k, gain = _cut(g.sum(axis=1 - axis), h.sum(axis=1 - axis))
            best = max(best, (gain, axis, k))
    gain, axis, k = best
    if gain <= 1e-12:
        return np.full(g.shape, _leaf(g, h))
    parts = [(g[: k + 1], h[: k + 1]), (g[k + 1 :], h[k + 1 :])] if axis == 0 else [(g[:, : k + 1], h[:, : k + 1]), (g[:, k + 1 :], h[:, k + 1 :])]
    return np.concatenate([tree_2d(a, b, depth - 1) for a, b in parts], axis=axis)


def fit(x, y) -> Model:
    """Cyclic boosting of one table per feature, then of the strongest pairs'."""
    import numpy as np

    if not len(y):
        return Model()
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    m = Model(base=math.log(rate / (1 - rate)))
    m.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    b = m.bins(x)
    n_bins = [len(c) + 1 for c in m.cuts]
    m.tables = [np.zeros(n) for n in n_bins]
    m.coarse = [np.arange(n) * GRID // max(n, GRID) for n in n_bins]
    z = np.full(len(y), m.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(x.shape[1]):
            g, h = slopes()
            step = RATE * tree_1d(np.bincount(b[:, f], g, n_bins[f]), np.bincount(b[:, f], h, n_bins[f]))
            m.tables[f] += step
            z += step[b[:, f]]

    def grid(f, g_, values):
        return np.bincount(m.coarse[f][b[:, f]] * GRID + m.coarse[g_][b[:, g_]], values, GRID * GRID).reshape(GRID, GRID)

    g, h = slopes()
    gains = sorted(((-float((grid(i, j, g) ** 2 / (grid(i, j, h) + RIDGE)).sum()), i, j) for i in range(x.shape[1]) for j in range(i)))
    m.pairs = [(i, j, np.zeros((GRID, GRID))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in m.pairs:
            g, h = slopes()
            step = RATE * tree_2d(grid(i, j, g), grid(i, j, h))
            table += step
            z += step[m.coarse[i][b[:, i]], m.coarse[j][b[:, j]]]
    return m


def learnable(doc_id):
    """False on the fold that is held out: crc32 of the id's text is divisible by 5."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def _measure(batches):
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(features(part.column(1).to_pylist())), pa.list_(pa.float64()))], names=["k", "x"])


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          max_labelled: int = MAX_LABELLED) -> Model:
    import numpy as np

    spark = documents.sparkSession
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("double").alias("y")).where(
        "k is not null and y is not null").where(learnable(F.col("k")))
    chosen = known.orderBy(F.xxhash64("k"), "k", "y").limit(max_labelled).collect()  # bounded by the parameter
    votes: dict[int, list[float]] = {}
    for r in chosen:
        votes.setdefault(r.k, []).append(r.y)
    if not votes:
        return Model()
    ids = F.broadcast(small_table(spark, [(k,) for k in votes], "k long"))  # at most max_labelled ids
    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).join(ids, "k")
    measured = rows.mapInArrow(_measure, "k long, x array<double>").groupBy("k").agg(F.min("x").alias("x")).collect()
    measured.sort(key=lambda r: r.k)
    x = np.array([r.x for r in measured], float).reshape(-1, len(FEATURES))
    y = np.array([float(np.mean(votes[r.k]) >= 0.5) for r in measured])
    return fit(x, y)


def _scored(model, n_keep: int, own: list[int]):
    """Rows whose second column is text: the others, with the score in its place.  Of the ``n_keep`` kept
    columns those with numbers in ``own`` are the text, which travels to Python once."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = model.value.score(features(part.column(1).to_pylist()))
                others = iter(part.columns[2:])
                kept = [part.column(1) if n in own else next(others) for n in range(n_keep)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), *kept], names=["k", "score", *(f"c{n}" for n in range(n_keep))])

    return run


def quality_scores(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                   max_labelled: int = MAX_LABELLED, keep: tuple[str, ...] = (), model: Model | None = None) -> DataFrame:
    """``key, held_out, score, predicted`` for every row, and the columns ``keep`` of the
    documents.  Without a model one is trained on these documents."""
    if model is None:
        model = train(documents, labels, key, text, max_labelled=max_labelled)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own = [n for n, c in enumerate(keep) if c == text and documents.schema[c].dataType == StringType()]
    carried = [F.col(c).alias(f"c{n}") for n, c in enumerate(keep) if n not in own]
    rows = documents.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), *carried)
    schema = ["k long", "score double", *(f"c{n} {documents.schema[c].dataType.simpleString()}" for n, c in enumerate(keep))]
    out = rows.mapInArrow(_scored(shared, len(keep), own), ", ".join(schema))
    return out.select(F.col("k").alias(key), F.coalesce(~learnable(F.col("k")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"c{n}").alias(c) for n, c in enumerate(keep)))
