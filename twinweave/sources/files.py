"""File tables: project_id, path, file_type, content.

Archives are read through Spark's binary files (any store), one archive a row;
their members are listed by an Arrow function, so no archive is unpacked to
disk.
"""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import category, file_type, is_boilerplate, is_hidden

MEMBERS = "project_id string, path string, content binary"
#: What reading a damaged, encrypted or unknown member raises.
DAMAGED = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, NotImplementedError, RuntimeError, EOFError, OSError)
#: Bytes of members that are handed on at once; a larger member goes alone.
BATCH = 16 << 20


def members(data: bytes):
    """(path, content) of an archive's files, one after the other; none if it is
    not an archive.  A member that cannot be read has null content and the others
    are read all the same.  Paths that would leave the archive's root are skipped."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except DAMAGED:
        return
    with archive:
        for info in archive.infolist():
            path = info.filename.replace("\\", "/").lstrip("/")
            if not info.is_dir() and ".." not in path.split("/"):
                try:
                    content = archive.read(info)
                except DAMAGED:
                    content = None
                yield path, content


def _unzip(batches):
    import pyarrow as pa

    def batch(project, found):
        paths, contents = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array([project] * len(paths), pa.string()), pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["project_id", "path", "content"])

    for b in batches:
        for k in range(b.num_rows):
            project, held, size = b.column(0)[k].as_py(), [], 0
            for member in members(b.column(1)[k].as_py() or b""):
                held.append(member)
                size += len(member[1] or b"")
                if size >= BATCH:
                    yield batch(project, held)
                    held, size = [], 0
            if held:
                yield batch(project, held)


def read_text(content):
    """UTF-8 text; other bytes are read leniently instead of failing."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def typed(files: DataFrame) -> DataFrame:
    """Adds the file type; drops files of other types and boilerplate files."""
    rows = files.withColumn("file_type", file_type(F.col("path"))).where("file_type is not null")
    return rows.where(~is_boilerplate(F.col("path")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All members of the archives that a path or pattern names; project_id is the
    archive's file name without ``.zip``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return from_archives(raw.select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("project_id"), "content"))


def from_archives(archives: DataFrame) -> DataFrame:
    rows = archives.select("project_id", "content").mapInArrow(_unzip, MEMBERS)
    return rows.select("project_id", "path", read_text(F.col("content")).alias("content"))


def _read_files(batches):
    import pyarrow as pa
    from pyarrow import fs

    for b in batches:
        for path, uri in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            store, place = fs.FileSystem.from_uri(uri)
            with store.open_input_file(place) as f:
                data = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], names=["path", "content"])


def read_directory(spark: SparkSession, path: str, project_id: str) -> DataFrame:
    """All files below a directory, with paths relative to it.

    Spark's own listing leaves out names that begin with a dot or an underscore,
    which projects have (``_app.js``); so names are listed through the file
    system, and executors read the files.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = found.makeQualified(root).toString().rstrip("/") + "/"
    names, listing = [], found.listFiles(root, True)
    while listing.hasNext():
        uri = listing.next().getPath().toString()
        names.append((uri.removeprefix(base), uri.replace("file:/", "file:///", 1) if not uri.startswith("file://") else uri))
    listed = spark.createDataFrame(sorted(names), "path string, uri string").repartition(max(1, min(len(names) // 64, 256)))
    rows = listed.mapInArrow(_read_files, "path string, content binary")
    return rows.select(F.lit(project_id).alias("project_id"), "path", read_text(F.col("content")).alias("content"))


def by_extension(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files with one of the extensions, without hidden ones."""
    low = F.lower("path")
    test = F.lit(False)
    for e in extensions:
        test = test | F.endswith(low, F.lit(e))
    return files.where(test & ~is_hidden(F.col("path")))


def by_category(files: DataFrame) -> DataFrame:
    """The wider classification, without hidden files and other kinds."""
    return files.withColumn("category", category(F.col("path"))).where(F.col("category").isNotNull() & ~is_hidden(F.col("path")))


def assets(files: DataFrame) -> DataFrame:
    """Content digest of each file, to find equal files of any type."""
    return files.select("project_id", "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))


def sides(files: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The typed files of the original and of the modified project of each pair."""
    rows = typed(files)
    out = []
    for column in ("original_id", "modified_id"):
        p = pairs.select("pair_id", F.col(column).alias("project_id"))
        out.append(rows.join(p, "project_id").select("pair_id", "file_type", "path", "content"))
    return out[0], out[1]
