"""``spark.read.format("zip_project")``: archives as a data source.

One input partition an archive; rows are (project_id, path, file_type, content).
"""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import BOILERPLATE, CONFIG_NAME, TYPES
from .files import members


def type_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    if name == CONFIG_NAME:
        return "tailwind_config"
    return None if path.endswith(BOILERPLATE) else TYPES.get(os.path.splitext(name)[1].lower())


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            data = f.read()
        project = os.path.basename(partition.value).removesuffix(".zip")
        for path, content in members(data):
            kind = type_of(path)
            if kind:
                yield project, path, kind, None if content is None else content.decode("utf-8", "replace")


class ZipProject(DataSource):
    """For archives on a file system that every executor mounts; archives in other
    stores are read by ``files.read_archives``."""

    @classmethod
    def name(cls):
        return "zip_project"

    def schema(self):
        return "project_id string, path string, file_type string, content string"

    def reader(self, schema):
        return _Reader(self.options["path"].removeprefix("file://"))
