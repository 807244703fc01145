"""Benchmark decontamination with an Aho-Corasick automaton.

Benchmark items and documents are normalised to words (``common.alnum_words``).
Each word of the benchmark's vocabulary is a number, written as three symbols of
128 (each place has symbols of its own, so matches begin at words, and no node of
the automaton has many children); any other word is three symbols that no
pattern has.  So one pass over a document's words finds every occurrence of
every window, and a match's position is a word number, which maps to the
original text's characters.

Memory.  An automaton for windows of at most about ``BLOCK_NODES`` words (up to
three nodes of some 60 bytes each) is held by a Python worker, and only one at a time.  A benchmark whose
windows fit makes one block, whose results are made in the pass that scans.  A
larger one is cut into pieces of ``PIECE`` windows that are dealt to blocks; each block is
a pass of its own over the rows, which leaves only the hits, and releases its
items before the next; then the hits of a row are put together.  Results are the
same.

Defined cases: a null or word-less text has no words and is not contaminated; an
item without words has no windows; items with a null id count as hits but are
not named; repeated items count once; a text of any length is scanned whole;
every input row, repeated or not, gives one row; columns not named are ignored
unless ``keep`` asks for them (a kept column must not have the name of a result).
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import alnum_words, ascii_lower, written

WINDOW = 13
BLOCK_NODES = 500_000
PIECE = 4096

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RUNS = "array<struct<a: int, b: int, start: int, end: int>>"
_RESULTS = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, "
            "hit_spans array<struct<start: int, end: int>>")
#: The automaton in use stays in a Python worker from task to task.
_built: dict[str, tuple] = {}


def windows(words: list, size: int = WINDOW) -> list[tuple]:
    """All runs of ``size`` words; the whole item if it is shorter; none for no words."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _symbols(n: int) -> str:
    """Three symbols for the n-th word, the first place's symbols first; 2,097,152 words have one."""
    return chr(1 + (n >> 14)) + chr(129 + (n >> 7 & 127)) + chr(257 + (n & 127))


def build(items: list[tuple], size: int = WINDOW):
    """(automaton, symbols of each known word); a match yields (words, item numbers)."""
    import ahocorasick

    symbols: dict[bytes, str] = {}
    owners: dict[str, list[int]] = {}
    for n, (_, text) in enumerate(items):
        for w in windows([symbols.setdefault(x, _symbols(len(symbols))) for x in alnum_words(text or "")], size):
            who = owners.setdefault("".join(w), [])
            if not who or who[-1] != n:
                who.append(n)
    auto = ahocorasick.Automaton()
    while owners:
        key, who = owners.popitem()
        auto.add_word(key, (len(key) // 3, tuple(who)))
    if len(auto):
        auto.make_automaton()
        return auto, symbols
    return None, symbols


def _kept(key: str, items: list[tuple], size: int):
    if key not in _built:
        _built.clear()
        _built[key] = build(items, size)
    return _built[key]


def scan(text: str | None, auto, symbols) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, merged runs of hit words as [start, end), numbers of items found)."""
    words = alnum_words(text or "")
    if auto is None or not words:
        return len(words), [], set()
    get = symbols.get
    runs: list[tuple[int, int]] = []
    found: set[int] = set()
    for last, (n, who) in auto.iter("".join([get(w, "\0\0\0") for w in words])):
        found.update(who)
        end = last // 3 + 1
        runs.append((end - n, end))
    return len(words), merged(runs), found


def merged(runs: list[tuple]) -> list[tuple]:
    """Runs that touch as one; what follows a run's ends is taken from the runs that have them."""
    out: list[tuple] = []
    for r in sorted(runs):
        if out and r[0] <= out[-1][1]:
            if r[1] > out[-1][1]:
                out[-1] = (out[-1][0], r[1], *out[-1][2:-1], *r[3:])
        else:
            out.append(r)
    return out


def _spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of words with their code-point spans of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(a, b, at[a][0], at[b - 1][1]) for a, b in runs]


def _arrow(columns: list, names: list, counts: list, runs: list, items: list):
    """A batch of results, from merged runs and sorted item names."""
    import pyarrow as pa

    hit = [sum(r[1] - r[0] for r in x) for x in runs]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays([
        *columns, pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, counts)], pa.bool_()), pa.array(items, pa.list_(pa.string())),
        pa.array([[{"start": r[2], "end": r[3]} for r in x] for x in runs], spans)],
        names=[*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans"])


def _scanned(bench, key: str, size: int, batches, place: int | None = None):
    """Batches whose last column is text: (other columns, words, runs with spans, item names) of up to 1024 rows
    at once.  With a ``place`` that column is the text, and one of the others too."""
    items = bench.value
    auto, symbols = _kept(key, items, size)
    names = [i for i, _ in items]
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            counts, all_runs, all_items = [], [], []
            for text in part.column(part.num_columns - 1 if place is None else place).to_pylist():
                n, runs, found = scan(text, auto, symbols)
                counts.append(n)
                all_runs.append(_spans(text, runs) if runs else [])
                all_items.append(sorted({names[x] for x in found} - {None}))
            yield part.columns[:-1] if place is None else part.columns, counts, all_runs, all_items


def _whole(bench, key: str, n_keep: int, size: int, place: int | None):
    """Results of the rows, where all items are one block."""

    def run(batches):
        for columns, counts, runs, items in _scanned(bench, key, size, batches, place):
            yield _arrow(columns, [f"k{i}" for i in range(n_keep)], counts, runs, items)

    return run


def _hits(bench, key: str, first: bool, size: int):
    """One block's hits by row; the first block has all rows."""

    def run(batches):
        import pyarrow as pa

        runs_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("a", "b", "start", "end")]))
        for columns, counts, runs, items in _scanned(bench, key, size, batches):
            some = [k for k in range(len(counts)) if first or runs[k]]
            yield pa.RecordBatch.from_arrays([
                columns[0].take(pa.array(some, pa.int64())), pa.array([counts[k] for k in some], pa.int64()),
                pa.array([[dict(zip(("a", "b", "start", "end"), r)) for r in runs[k]] for k in some], runs_type),
                pa.array([items[k] for k in some], pa.list_(pa.string()))], names=["row", "n_words", "runs", "items"])

    return run


def _together(batches):
    """``row, n_words`` and the lists of runs and items of all blocks as results."""
    for b in batches:
        d = b.to_pydict()
        yield _arrow([b.column(0)], ["row"], d["n_words"], [merged([(r["a"], r["b"], r["start"], r["end"]) for r in x]) for x in d["runs"]],
                     [sorted(set(x)) for x in d["items"]])


def _pieces(benchmark: DataFrame, item_id: str, item_text: str, size: int, piece: int) -> DataFrame:
    """``i, t, nodes``: distinct runs of ``piece`` windows of each item, with the nodes that they need at most."""
    words = F.filter(F.split(ascii_lower(F.col(item_text).cast("string")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), words.alias("w")).where(F.size("w") > 0).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)), F.lit(piece))
    cut = items.select("i", "w", F.explode(starts).alias("at")).select("i", F.slice("w", F.col("at"), piece + size - 1).alias("w"))
    nodes = F.greatest(F.size("w") - size + 1, F.lit(1)) * F.least(F.size("w"), F.lit(size))
    return cut.select("i", F.array_join("w", " ").alias("t"), nodes.cast("long").alias("nodes"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_nodes: int = BLOCK_NODES, piece: int = PIECE) -> DataFrame:
    """The ``keep`` columns of each document with ``n_words, n_hit, n_items,
    items_sha256, contaminated`` (a twentieth of its words or more are hit),
    ``items`` (ids found) and ``hit_spans`` (characters of the original text)."""
    spark = documents.sparkSession
    bench = _pieces(benchmark, item_id, item_text, window, piece)
    total = bench.agg(F.sum("nodes")).first()[0] or 0
    keep_schema = [f"k{n} {documents.schema[c].dataType.simpleString()}" for n, c in enumerate(keep)]
    df = documents.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)), F.col(text).cast("string").alias("text"))

    def shared(rows: DataFrame):
        return spark.sparkContext.broadcast(sorted(((r.i, r.t) for r in rows.select("i", "t").collect()), key=str))

    if total <= block_nodes:
        # a kept text travels to Python once
        place = keep.index(text) if text in keep and documents.schema[text].dataType == StringType() else None
        rows = df if place is None else df.drop("text")
        found = rows.mapInArrow(_whole(shared(bench), uuid.uuid4().hex, len(keep), window, place), ", ".join([*keep_schema, _RESULTS]))
    else:
        # dealt by a hash, so twice as many blocks as needed if all were equally full
        bench, n_blocks = written(bench, "benchmark"), -(-2 * total // block_nodes)
        df = written(df.withColumn("row", F.monotonically_increasing_id()), "rows")
        hits = None
        for n in range(n_blocks):
            items = shared(bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == n))
            one = written(df.select("row", "text").mapInArrow(_hits(items, uuid.uuid4().hex, n == 0, window),
                                                              f"row long, n_words long, runs {_RUNS}, items array<string>"), "hits")
            items.destroy()
            hits = one if hits is None else hits.union(one)
        lists = hits.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
        found = df.drop("text").join(lists.mapInArrow(_together, f"row long, {_RESULTS}"), "row")
    return found.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)),
                        "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans")
