"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 fingerprint bits are three segments of 23, 23 and 18 bits.  Of two or
fewer differing bits at least one segment has none (pigeonhole), and the segment
after it has at most two.  So each fingerprint gets, for each segment, keys of
that segment's bits with the codeword numbers near the next segment.

The codeword numbers come from the perfect binary (23, 12, 7) Golay code: all
codewords within distance 4 of the 23-bit word, which are one, or six if the
nearest is at distance 3.  Two words within distance 2 always share one: if the
nearest codeword of either is within 2 it is within 4 of the other; else the
nearest codeword of the word half way is within 3 + 1 of both.

Only distinct fingerprints get keys.  A bucket never yields all its pairs, but a
spanning forest of its links, found exactly: in small buckets by comparing, in
large ones by the words one bit away from each fingerprint (two fingerprints
link if and only if they share such a word or are one bit apart).

Defined cases: null and white-space texts have fingerprint 0; rows with a null
doc_id count as texts but never name a component; repeated rows are returned as
often; a text of any length is one fingerprint; an empty table gives an empty
table; columns not named are ignored.  Ids must be numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import space_words, written
from .components import components

SHINGLE = 3
SEED = 42
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SMALL = 512
LARGE = 4096


def fingerprint(text: str | None) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest

    words = space_words(text or "")
    n = len(words)
    if n == 0:
        return 0
    if n <= SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - SHINGLE] + 1).tolist()]
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
    m = len(hashes)
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > m
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            f = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            # a row key, if there is one, is the third column
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f), *part.columns[2:]], names=["doc_id", "fp", "row"][: part.num_columns])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; and the long column ``row`` if it is named."""
    carried = [] if row is None else [F.col(row).cast("long").alias("row")]
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"), *carried)
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long" + (", row long" if carried else ""))


def golay_tables():
    """(remainder of the high 12 bits, six error patterns for each syndrome)."""
    import numpy as np

    def remainder(w: int) -> int:
        for bit in range(22, 10, -1):
            if w >> bit & 1:
                w ^= _GENERATOR << (bit - 11)
        return w

    high = np.array([remainder(h << 11) for h in range(4096)], np.uint32)
    unit = [remainder(1 << i) for i in range(23)]
    nearest = {0: 0}
    for i in range(23):
        nearest[unit[i]] = 1 << i
        for j in range(i):
            nearest[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                nearest[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    patterns = np.zeros((2048, 6), np.uint32)
    for s, e in nearest.items():
        near = {e}
        if e.bit_count() == 3:
            near |= {p for i in range(23) if (p := 1 << i ^ nearest[s ^ unit[i]]).bit_count() == 4}
        patterns[s] = (sorted(near, key=int.bit_count) * 6)[:6]
    return high, patterns


_tables = None


def codeword_numbers(words):
    """(n, 6) numbers of the codewords within distance 4 of 23-bit words; repeats fill up."""
    global _tables
    if _tables is None:
        _tables = golay_tables()
    high, patterns = _tables
    return (words[:, None] ^ patterns[high[words >> 11] ^ (words & 2047)]) >> 11


def keys_of(fps):
    """(n, 18) keys of unsigned fingerprints; repeats fill up."""
    import numpy as np

    parts = [((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.uint32) for a, n in SEGMENTS]
    out = []
    for k in range(3):
        near = codeword_numbers(parts[(k + 1) % 3]).astype(np.uint64)
        out.append(np.uint64(k << 35) | parts[k].astype(np.uint64)[:, None] << np.uint64(12) | near)
    return np.concatenate(out, axis=1)


def _keys(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 4096):
            fps = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            keys = np.sort(keys_of(fps.view(np.uint64)), axis=1)
            new = np.ones(keys.shape, bool)
            new[:, 1:] = keys[:, 1:] != keys[:, :-1]
            rows = np.nonzero(new)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(fps[rows])], names=["key", "fp"])


def _settle(n: int, u, v):
    """Smallest index in the component of each of n nodes, for edges u, v."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(fps, third: int = 2):
    """Edges (as two arrays of fingerprints) of a spanning forest of the links
    at two bits or fewer among distinct unsigned fingerprints; ``third`` is the
    segment that tells the members of a very large bucket apart."""
    import numpy as np

    fps = np.sort(fps)
    n = len(fps)
    if n <= SMALL:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
        u, v = np.nonzero(np.triu(near, 1))
    elif n > LARGE:
        a, size = SEGMENTS[third]
        # split once more by codeword numbers; the links of a part are the links of the whole
        numbers = codeword_numbers(((fps >> np.uint64(a)) & np.uint64((1 << size) - 1)).astype(np.uint32))
        flat, owner = numbers.ravel(), np.repeat(np.arange(n), 6)
        order = np.argsort(flat, kind="stable")
        cuts = np.nonzero(np.diff(flat[order]))[0] + 1
        us, vs = [], []
        for part in np.split(owner[order], cuts):
            part = np.unique(part)
            if len(part) > 1:
                x, y = _shared(fps[part])
                us.append(part[x])
                vs.append(part[y])
        u, v = (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))
    else:
        u, v = _shared(fps)
    label = _settle(n, u, v)
    own = np.nonzero(label != np.arange(n))[0]
    return fps[own], fps[label[own]]


def _shared(fps):
    """Index pairs of fingerprints that share a word at distance one or less."""
    import numpy as np

    masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    us, vs = [], []
    words = (fps[:, None] ^ masks).ravel()
    owner = np.repeat(np.arange(len(fps)), 65)
    order = np.argsort(words, kind="stable")
    words, owner = words[order], owner[order]
    same = np.nonzero(words[1:] == words[:-1])[0]
    us.append(owner[same])
    vs.append(owner[same + 1])
    return np.concatenate(us), np.concatenate(vs)


def _link(batches):
    """Rows sorted by key: a forest of each key's fingerprints."""
    import numpy as np
    import pyarrow as pa

    held_key, held = None, []

    def edges(parts):
        u, v = zip(*parts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64))], names=["u", "v"])

    def close(key, members, out):
        if len(members) > 1:
            u, v = forest(members, ((int(key) >> 35) + 2) % 3)
            if len(u):
                out.append((u, v))

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
        out: list = []
        for a, z in zip(cuts, cuts[1:]):
            if held_key is not None and keys[a] == held_key:
                held.append(fps[a:z])
            else:
                if held and (len(held) > 1 or len(held[0]) > 1):
                    close(held_key, np.concatenate(held), out)
                held_key, held = keys[a], [fps[a:z]]
        held = [np.concatenate(held)]
        if out:
            yield edges(out)
    out = []
    if held:
        close(held_key, held[0], out)
    if out:
        yield edges(out)


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` for every row.

    If a column of unique row keys is named, also that column and
    ``component_row``: of the component's rows with the smallest doc_id (null
    last) the smallest key.

    Text is read once; what is shuffled is fingerprints (16 bytes a document)
    and keys of distinct fingerprints (at most 18 of 16 bytes).
    """
    fps = written(fingerprints(documents, key, text, row), "fingerprints")
    lows = [F.min("doc_id").alias("low")]
    if row is not None:
        lows.append(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    classes = fps.groupBy("fp").agg(*lows)
    keys = classes.select("fp").mapInArrow(_keys, "key long, fp long")
    roots = components(keys.repartition("key").sortWithinPartitions("key"), "u", "v", _link)
    more = [] if row is None else ["first"]
    classes = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", *more, F.coalesce("root", "fp").alias("root"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"), *(F.min(c).alias("component_first") for c in more))
    named = classes.join(lows, "root").select(F.col("fp").alias("f"), "component_id", *(F.col("component_first.row").alias("component_row") for _ in more))
    return fps.join(named, F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *([F.col("row").alias(row), "component_row"] if more else []))
