"""Token identifiers in bit-packed files.

File: packed blocks of ``BLOCK_IDS`` identifiers, each id in the fewest bits the
vocabulary needs; then, compressed, the table of documents (ids and starts) and
the block offsets; then a tail that says where they are.  Any run of ids is
read by its blocks alone.

Documents are range-partitioned and sorted by id and a digest of the text; so a
doc_id with any number of rows is dealt to several tasks unless its texts are
equal too.  A task writes the files of its range under names of their own, each
of at most about ``FILE_IDS`` ids, and returns one row for each file.  The starts
of files are prefix sums over those rows.

Defined cases: null text is empty (only the end id is written); null ids come
first; rows of one id are kept, in order of their texts' digests (XXH64); a text
of any length is one run of ids; an empty table writes no file; columns not
named are ignored.  Ids must be numbers.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE, byte_symbols, is_plain, split_pieces
from .common import file_system, give_back, make_dirs, number_of_parts, small_table, work_dir

BLOCK_IDS = 1 << 16
END_ID = 2
FILE_IDS = 1 << 26
_TAIL = "<QQQQI8s"  # place and size of the tables, ids, documents, bits
_MAGIC = b"TWTOKEN1"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids, bits: int) -> bytes:
    """Little-endian bit packing of an unsigned array."""
    import numpy as np

    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int):
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    wide = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (wide.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    def __init__(self, stream, bits: int):
        self.out, self.bits = stream, bits
        self.rest: list = []
        self.n_rest = self.at = self.n_ids = 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.known: list[int] = []
        self.starts: list[int] = []

    def add(self, doc_id, ids) -> None:
        import numpy as np

        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= BLOCK_IDS:
            joined = np.concatenate(self.rest)
            whole = len(joined) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, BLOCK_IDS):
                self._block(joined[i : i + BLOCK_IDS])
            self.rest, self.n_rest = [joined[whole:]], len(joined) - whole

    def _block(self, ids) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        import numpy as np

        if self.n_rest:
            self._block(np.concatenate(self.rest))
        self.offsets.append(self.at)
        tables = zlib.compress(b"".join([
            np.array(self.docs, "<i8").tobytes(), np.array(self.known, "u1").tobytes(),
            np.array(self.starts, "<i8").tobytes(), np.array(self.offsets, "<i8").tobytes()]), 1)
        self.out.write(tables + struct.pack(_TAIL, self.at, len(tables), self.n_ids, len(self.docs), self.bits, _MAGIC))
        self.out.close()


class Reader:
    """Random access to a file by id positions or by document."""

    def __init__(self, file):
        import numpy as np

        self.file = file
        at, size, self.n_ids, n_docs, self.bits, magic = struct.unpack(
            _TAIL, file.read_at(struct.calcsize(_TAIL), file.size() - struct.calcsize(_TAIL)))
        if magic != _MAGIC:
            raise ValueError("not a token file")
        tables = zlib.decompress(file.read_at(size, at))
        self.docs = np.frombuffer(tables, "<i8", n_docs)
        self.known = np.frombuffer(tables, "u1", n_docs, 8 * n_docs)
        self.starts = np.frombuffer(tables, "<i8", n_docs, 9 * n_docs)
        self.offsets = np.frombuffer(tables, "<i8", -1, 17 * n_docs)
        self.cached: tuple[int, object] = (-1, None)

    def block(self, k: int):
        if self.cached[0] != k:
            data = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            self.cached = (k, unpack(data, min(BLOCK_IDS, self.n_ids - k * BLOCK_IDS), self.bits))
        return self.cached[1]

    def ids(self, start: int, n: int):
        """``n`` ids from position ``start``; reads only the blocks they lie in."""
        import numpy as np

        if n <= 0:
            return np.zeros(0, np.uint32)
        parts = []
        for k in range(start // BLOCK_IDS, (start + n - 1) // BLOCK_IDS + 1):
            b = self.block(k)
            parts.append(b[max(0, start - k * BLOCK_IDS) : start + n - k * BLOCK_IDS])
        return np.concatenate(parts)

    def length(self, doc: int) -> int:
        end = self.starts[doc + 1] if doc + 1 < len(self.starts) else self.n_ids
        return int(end - self.starts[doc])


#: The printable stand-in of each byte, by its number.
_SHOWN = dict(enumerate(byte_symbols()))


class Encoder:
    """The library's ids of a text; pieces of plain texts are remembered.

    The library cuts a text into the same pieces and encodes each by itself, so
    the ids of the pieces in a row are the ids of the text.  Texts with special
    tokens or characters outside the plain range go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = _Ids(self.tokenizer)

    def ids(self, text: str):
        import numpy as np

        if any(s in text for s in self.special) or not is_plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.cache) > CACHE:
            self.cache.clear()
        return np.frombuffer(b"".join(map(self.cache.__getitem__, split_pieces(text))), np.uint32)


class _Ids(dict):
    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model

    def __missing__(self, piece: str) -> bytes:
        # the library's model takes a piece byte by byte in printable form
        shown = piece.encode("utf-8").decode("latin-1").translate(_SHOWN)
        data = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(piece) < 64:
            self[piece] = data
        return data


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(folder: str, tokenizer_path: str, end_id: int, file_ids: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        e = encoder(tokenizer_path)
        bits, end = bits_for(max(e.vocabulary, end_id + 1)), np.array([end_id], np.uint32)
        store, path = file_system(folder)
        shard, name, writer, files = TaskContext.get().partitionId(), "", None, []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                    if writer is None:
                        name = f"tokens-{uuid.uuid4().hex}.bin"
                        writer = Writer(store.open_output_stream(f"{path}/{name}", compression=None), bits)
                    writer.add(doc, np.concatenate([e.ids(text or ""), end]))
                    if writer.n_ids >= file_ids:
                        writer.close()
                        files.append((shard, len(files), name, writer.n_ids, len(writer.docs)))
                        writer = None
        if writer is not None:
            writer.close()
            files.append((shard, len(files), name, writer.n_ids, len(writer.docs)))
        e.cache.clear()  # from task to task it saves next to nothing
        give_back()
        if files:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*files), kinds)], names=["shard", "nth", "file", "n_ids", "n_docs"])

    return run


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, parts: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files; ``shard, nth, file, n_ids, n_docs`` of each, (shard, nth) in order of ids."""
    make_dirs(folder)
    t = F.col(text).cast("string")
    rows = documents.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("h"), t.alias("t"))
    parts = parts or number_of_parts(documents.sparkSession, rows, "t")
    ordered = rows.repartitionByRange(parts, "k", "h").sortWithinPartitions("k", "h")
    kinds = "shard long, nth long, file string, n_ids long, n_docs long"
    # one row a file comes to the driver; as a table, each task would write one more file for it
    shards = ordered.mapInArrow(_write(folder, tokenizer_path, end_id, file_ids), kinds).collect()
    return small_table(documents.sparkSession, shards, kinds)


def _read(folder: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        store, path = file_system(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = Reader(store.open_input_file(f"{path}/{name}"))
                for lo in range(0, len(r.docs), 4096):
                    hi = min(lo + 4096, len(r.docs))
                    n = [r.length(d) for d in range(lo, hi)]
                    crc = [zlib.crc32(r.ids(int(r.starts[d]), n[d - lo]).astype("<u4").tobytes()) for d in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.docs[lo:hi], pa.int64(), mask=r.known[lo:hi] == 0), pa.array(r.starts[lo:hi] + np.int64(base), pa.int64()),
                         pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    spark = shards.sparkSession
    rows = sorted(shards.collect(), key=lambda r: (r.shard, r.nth))  # one row a file
    starts, total = [], 0
    for r in rows:
        starts.append((r.file, total))
        total += r.n_ids
    table = small_table(spark, starts, "file string, base long")
    return table.repartition(max(1, len(starts)), "file").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_written_and_read(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Query form: all documents to files, and back from them."""
    folder = work_dir(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, folder, tokenizer_path), folder)
