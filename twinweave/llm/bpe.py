"""Token counts by heap-and-linked-list byte-pair merging, and piece splitting.

A text is split at added special tokens, then into pieces by the tokenizer's
published pattern.  Texts whose characters all lie in a range where Python's
``re`` agrees with that pattern's Unicode classes take a short pattern; others
take the pattern itself.

Defined cases: null is the empty text; an empty text has no tokens; a text of any
length is counted whole, piece by piece, and a piece in time n log n; every input
row gives one row, repeated ones too; an empty table gives an empty table;
columns not named are ignored; ids may be of any type.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]")

#: Pieces remembered by a Python worker; beyond it the memory starts anew.
CACHE = 500_000


def is_plain(text: str) -> bool:
    return not _OTHER.search(text)


def split_pieces(text: str) -> list[str]:
    if is_plain(text):
        return _PLAIN.findall(text)
    import regex

    return regex.findall(PATTERN, text)


def byte_symbols() -> list[str]:
    """The vocabulary's printable stand-in for each byte: printable Latin-1 bytes
    stand for themselves, the others take code points from 256 in byte order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    """Merge ranks of a byte-level BPE file; counts without emitting identifiers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number: dict[str, int] = {}
        self.first = [number.setdefault(s, len(number)) for s in byte_symbols()]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = number.setdefault(a + b, len(number))
            self.ranks.setdefault(number.setdefault(a, len(number)) << 32 | number.setdefault(b, len(number)), len(self.made))
            self.made.append(made)
        special = sorted((t["content"] for t in spec.get("added_tokens", []) if t.get("special")), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache = _Counts(self)

    def count_piece(self, piece: bytes) -> int:
        """Initial symbols minus merges: a heap holds the ranks of adjacent pairs,
        a linked list the symbols that are left."""
        n = len(piece)
        if n < 2:
            return n
        rank_of, made = self.ranks.get, self.made
        sym = [self.first[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if sym[i] < 0 or j >= n or rank_of(sym[i] << 32 | sym[j]) != rank:
                continue  # one side was merged meanwhile
            sym[i], sym[j] = made[rank], -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(sym[i] << 32 | sym[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(sym[h] << 32 | sym[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return n - merges

    def count(self, text: str) -> int:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        if self.special and (found := self.special.findall(text)):
            return len(found) + sum(sum(map(cache.__getitem__, split_pieces(x))) for x in self.special.split(text))
        return sum(map(cache.__getitem__, split_pieces(text)))


class _Counts(dict):
    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        n = self.merger.count_piece(piece.encode("utf-8", "replace"))
        if len(piece) < 64:
            self[piece] = n
        return n


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One for each file and Python worker, kept from task to task."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def _count(path: str):
    def run(batches):
        import pyarrow as pa

        m = merger(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n_bytes, n_tokens = [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    n_bytes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                    n_tokens.append(m.count(text))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                                                 names=["k", "n_bytes", "n_tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row."""
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    out = rows.mapInArrow(_count(tokenizer_path), f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
