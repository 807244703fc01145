"""The shared work folder and tables written to it.

Work that must outlive an executor (cut lineage, written archives) goes below
``spark.checkpoint.dir``, which all executors share.  Only where that setting
is absent and all work is in one process (tests) a local folder is made.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_local_base: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []
#: Of work folders that are tables: a weak reference of the JVM to the listing of files that every plan over the table holds.
_listings: dict[str, object] = {}
#: py4j tells the JVM once a second which objects Python dropped.
_DROP_S = 1.2


def shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return re.sub(r"^file:/+", "file:///", base.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_base:
        _local_base[app] = tempfile.mkdtemp(prefix="twinweave-")
        atexit.register(shutil.rmtree, _local_base[app], True)
    return "file://" + _local_base[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; removed when the driver ends."""
    path = f"{shared_base(spark)}/twinweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def made() -> int:
    """How many work folders were made so far."""
    return len(_made)


def release(numbers: Iterable[int]) -> set[int]:
    """Removes the tables among the work folders with these numbers that no plan
    reads any more, neither a DataFrame that someone holds nor one made from it
    nor a view or cache, and returns their numbers.  Folders that are no tables stay."""
    tables = [n for n in numbers if _made[n][1] in _listings and _made[n][0].sparkContext._jsc is not None]  # else that session was stopped
    if tables:
        gc.collect()  # plans that only dropped DataFrames hold go first
        time.sleep(_DROP_S)
        for _ in range(2):  # what Spark itself cleans up after the first holds more
            _made[tables[0]][0]._jvm.System.gc()
            time.sleep(_DROP_S / 10)
    unread = {n for n in tables if _listings[_made[n][1]].get() is None}
    for n in unread:
        remove(*_made[n])
        del _listings[_made[n][1]]
    return unread


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may already be gone, or this store out of reach; the others are still tried
            continue


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: lineage is cut, and a
    lost executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = path or work_dir(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    plan = table._jdf.queryExecution().analyzed()
    if any(path == p for _, p in _made) and plan.nodeName().startswith("LogicalRelation"):
        _listings[path] = spark._jvm.java.lang.ref.WeakReference(plan.relation().location())
    return table
