"""Shared pieces of the operators: words and file systems.

Tables and files that must outlive an executor go to the shared work folder
(``twinweave.storage``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import remove, shared_base, work_dir, written  # noqa: F401

#: Separators of the two word rules, as bytes; ASCII capitals become small.
_SPACES = b" \t\n\x0b\x0c\r"
_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALNUM_TABLE = bytes(LOWER_ASCII[c] if LOWER_ASCII[c] in _KEPT else 32 for c in range(256))
SPACE_TABLE = bytes(32 if c in _SPACES else LOWER_ASCII[c] for c in range(256))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum_words(text: str) -> list[bytes]:
    """Words of ASCII digits, letters (made small) and all non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split()


def space_words(text: str) -> list[bytes]:
    """Words between ASCII white space, ASCII capitals made small."""
    return text.encode("utf-8", "surrogatepass").translate(SPACE_TABLE).split()


def ascii_lower(col):
    """Column with A-Z made small and nothing else changed."""
    from pyspark.sql import functions as F

    return F.translate(col, _UPPER, _LOWER)


def give_back() -> None:
    """Returns memory that this process freed to the system, where the C library can; a
    Python worker waits for its next task with what it needs alone."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """The driver's rows as a table.  They go to the JVM as Arrow data: from a list, ``createDataFrame`` sends them
    through a Python worker of every task slot, with a daemon beside those of the operators, which stay in memory."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds), StructType.fromDDL(schema))


def file_system(uri: str):
    """(file system, path) for a URI of any store that pyarrow can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_dirs(uri: str) -> None:
    store, path = file_system(uri)
    store.create_dir(path, recursive=True)


#: Parts at most: the driver plans, and reads a row of, each.
MAX_PARTS = 50_000


def number_of_parts(spark: SparkSession, df: DataFrame, column: str, mb: int = 24) -> int:
    """Parts of about ``mb`` MB each of the text or binary ``column``; larger ones
    beyond ``MAX_PARTS`` (about 1.2 TB at the default size)."""
    from pyspark.sql import functions as F

    total = df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0
    return min(MAX_PARTS, max(int(spark.sparkContext.defaultParallelism), -(-total // (mb << 20)), 1))
