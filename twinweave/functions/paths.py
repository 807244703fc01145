"""Path projections and the classification of files, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each file type and names that are set apart.
TYPES = {".html": "html", ".css": "css", ".jsx": "jsx", ".tsx": "jsx", ".js": "js", ".ts": "js"}
CONFIG_NAME = "tailwind.config.js"
BOILERPLATE = "next-env.d.ts"
CATEGORIES = {
    "html": (".html", ".htm"),
    "js": (".js", ".jsx", ".ts", ".tsx"),
    "css": (".css", ".scss", ".sass"),
    "config": (".config.js", ".json"),
}


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def parent(path: Column) -> Column:
    """The folder of a path, '' for files at the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Last extension in small letters; '' for names without one or with only a leading dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def file_type(path: Column) -> Column:
    """Type of a file, null for files that are skipped.  The config name is
    tested before its extension, so such files have a type of their own."""
    ext = extension(path)
    out = F.when(basename(path) == CONFIG_NAME, "tailwind_config")
    for suffix, kind in TYPES.items():
        out = out.when(ext == suffix, kind)
    return out


def category(path: Column) -> Column:
    """The wider classification: the first category one of whose suffixes fits."""
    low = F.lower(basename(path))
    tests = [(reduce(lambda a, b: a | b, (F.endswith(low, F.lit(s)) for s in suffixes)), kind) for kind, suffixes in CATEGORIES.items()]
    first, *rest = tests
    out = F.when(first[0], first[1])
    for test, kind in rest:
        out = out.when(test, kind)
    return out


def is_hidden(path: Column) -> Column:
    """A leading dot in the name of the file or of one of its folders."""
    return F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")) & ~p.isin(".", ".."))


def is_boilerplate(path: Column) -> Column:
    return F.endswith(path, F.lit(BOILERPLATE))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, False)
    return F.when(first_off == 0, F.size(same)).otherwise(first_off - 1).cast("int")
