"""Comparison of utility classes in markup, and of their configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import html_nodes
from ..functions.similarity import jaccard, multiset_jaccard
from ..storage import written

# Fixed value: attributes that hold classes.
_MARKUP = r'(?:class|className)\s*=\s*"([^"]+)"'
#: The theme keys that count as extensions.
THEME_KEYS = ("colors", "spacing", "fontSize", "borderRadius", "boxShadow", "fontFamily", "screens")


def markup_classes(content: Column) -> Column:
    """Classes in ``class="..."`` or ``className="..."``, in order, repeats included."""
    lists = F.transform(F.regexp_extract_all(content, F.lit(_MARKUP), F.lit(1)), lambda s: F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "))
    return F.array_remove(F.flatten(F.coalesce(lists, F.array().cast("array<array<string>>"))), "")


def class_lines(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Keys with class and the numbers of the lines on which it stands."""
    # text up to each attribute tells its line; the pieces between attributes have the newlines
    pieces = F.split(F.col(content), _MARKUP.replace("([^\"]+)", "[^\"]+"), -1)
    found = F.regexp_extract_all(F.col(content), F.lit(_MARKUP), F.lit(0))
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    steps = files.select(*keys, found.alias("found"), pieces.alias("pieces"))
    # newlines up to each attribute: a running sum over the row, before rows are made of it
    steps = steps.select(*keys, "found", F.transform(F.arrays_zip("found", F.slice("pieces", F.lit(1), F.size("found")).alias("piece")), lambda x: F.struct(
        newlines(x["piece"]).alias("before"), newlines(x["found"]).alias("inside"))).alias("steps"))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("lines"))
    lines = F.aggregate("steps", start, lambda a, s: F.struct(
        (a["line"] + s["before"] + s["inside"]).alias("line"), F.concat(a["lines"], F.array(a["line"] + s["before"])).alias("lines")), lambda a: a["lines"])
    rows = steps.select(*keys, F.explode(F.arrays_zip("found", lines.alias("line"))).alias("x"))
    rows = rows.select(*keys, F.col("x.line").alias("line"), F.explode(markup_classes(F.col("x.found"))).alias("class"))
    return rows.groupBy(*keys, "class").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line")).alias("lines"))


def html_classes(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Keys with class, count and the elements (tag and attributes) that carry it."""
    nodes = files.select(*keys, F.explode(html_nodes(content)).alias("node")).where("node.kind = 'element' and node.attrs['class'] is not null")
    at = F.concat(F.lit("<"), F.col("node.tag"), F.coalesce(F.concat(F.lit(" "), F.array_join(F.transform(
        F.map_entries("node.attrs"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), " ")), F.lit("")), F.lit(">"))
    rows = nodes.select(*keys, at.alias("at"), F.explode(F.split("node.attrs.class", " ")).alias("class")).where("class <> ''")
    return rows.groupBy(*keys, "class").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("at")).alias("locations"))


def class_counts(files: DataFrame, keys: list[str], content: str = "content", file_type: str = "file_type") -> DataFrame:
    """Keys, class and count for html and jsx files; other types have none."""
    html = html_classes(files.where(F.col(file_type) == "html"), keys, content).select(*keys, "class", "n")
    jsx = files.where(F.col(file_type) == "jsx").select(*keys, F.explode(markup_classes(F.col(content))).alias("class"))
    return html.unionByName(jsx.groupBy(*keys, "class").agg(F.count("*").alias("n")))


def compare_counts(left: DataFrame, right: DataFrame, keys: list[str], item: str = "class") -> DataFrame:
    """One row per ``keys`` that has an item on either side: set, frequency and
    hybrid similarity, shared and own items, and the sum of maxima as weight."""
    return _compared(merged_counts(left, right, keys, item), keys)


def compare_with_impacts(left: DataFrame, right: DataFrame, keys: list[str], item: str = "class") -> DataFrame:
    """:func:`compare_counts` with :func:`impact_lists`; counts are merged once."""
    both = written(merged_counts(left, right, keys, item), "merged")
    return _compared(both, keys).join(_impacts(both, keys, item), keys, "left")


def _compared(both: DataFrame, keys: list[str]) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0)).cast("double")
    grouped = both.groupBy(*keys).agg(
        F.sum(F.least("a", "b")).alias("low"), F.sum(F.greatest("a", "b")).alias("high"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"), F.count("*").alias("total"),
        F.count_if(F.col("b") == 0).alias("only_original"), F.count_if(F.col("a") == 0).alias("only_modified"))
    return grouped.select(
        *keys, ratio(F.col("low"), F.col("high")).alias("frequency_similarity"), ratio(F.col("shared"), F.col("total")).alias("set_similarity"),
        (0.5 * ratio(F.col("low"), F.col("high")) + 0.5 * ratio(F.col("shared"), F.col("total"))).alias("hybrid_similarity"),
        "shared", "only_original", "only_modified", F.col("total").alias("n_classes"))


def count_map(items: Column) -> Column:
    """Item -> number of times it stands in an array, inside the row."""
    kinds = F.array_distinct(items)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(items, lambda x: x == k)).cast("long")))


def compare_maps(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """As :func:`compare_counts`, for pairs whose counts are two map columns: nothing
    is exploded or shuffled."""
    x, y = F.map_keys(a), F.map_keys(b)
    frequency, sets = multiset_jaccard(F.col(a), F.col(b)), jaccard(x, y)
    rows = pairs.where((F.size(x) > 0) | (F.size(y) > 0))
    rows = rows.select(*keys, frequency.alias("frequency_similarity"), sets.alias("set_similarity"), F.size(F.array_intersect(x, y)).cast("long").alias("shared"),
                       F.size(x).cast("long").alias("n1"), F.size(y).cast("long").alias("n2"))
    return rows.select(*keys, "frequency_similarity", "set_similarity", (0.5 * F.col("frequency_similarity") + 0.5 * F.col("set_similarity")).alias("hybrid_similarity"), "shared",
                       (F.col("n1") - F.col("shared")).alias("only_original"), (F.col("n2") - F.col("shared")).alias("only_modified"), (F.col("n1") + F.col("n2") - F.col("shared")).alias("n_classes"))


def merged_counts(left: DataFrame, right: DataFrame, keys: list[str], item: str = "class") -> DataFrame:
    """Full outer merge by item: counts a and b, 0 where absent."""
    a = left.select(*keys, item, F.col("n").alias("a"))
    b = right.select(*keys, item, F.col("n").alias("b"))
    zero = F.lit(0).cast("long")
    return a.join(b, [*keys, item], "full").select(*keys, item, F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))


def change_impact(left: DataFrame, right: DataFrame, keys: list[str], item: str = "class") -> DataFrame:
    """Items whose counts differ, with the difference."""
    return _changes(merged_counts(left, right, keys, item))


def _changes(both: DataFrame) -> DataFrame:
    return both.withColumn("count_diff", F.abs(F.col("a") - F.col("b"))).where("count_diff > 0")


def impact_lists(left: DataFrame, right: DataFrame, keys: list[str], item: str = "class") -> DataFrame:
    """The changes of each ``keys`` as one list, greatest first, equal ones by name."""
    return _impacts(merged_counts(left, right, keys, item), keys, item)


def _impacts(both: DataFrame, keys: list[str], item: str) -> DataFrame:
    rows = _changes(both)
    packed = F.sort_array(F.collect_list(F.struct((-F.col("count_diff")).alias("minus"), F.col(item).alias("class"), F.col("a").alias("original"), F.col("b").alias("modified"))))
    return rows.groupBy(*keys).agg(F.transform(packed, lambda x: F.struct(x["class"], x["original"], x["modified"], (-x["minus"]).alias("count_diff"))).alias("changes"))


def is_soft(changes: Column) -> Column:
    """False for pairs whose whole change is one class that differs by one."""
    return ~F.coalesce((F.size(changes) == 1) & (changes[0]["count_diff"] == 1), F.lit(False))


_OBJECT = "map<string,string>"


def theme_extensions(config: Column) -> Column:
    """Extension key -> JSON text, from theme and theme.extend of a JSON config;
    of two objects the keys are merged, else the extension wins."""
    def value(path: str) -> Column:
        return F.get_json_object(config, path)

    entries = []
    for k in THEME_KEYS:
        top, ext = value(f"$.theme.{k}"), value(f"$.theme.extend.{k}")
        both = F.to_json(F.map_concat(
            F.map_filter(F.from_json(top, _OBJECT), lambda q, _: ~F.array_contains(F.map_keys(F.from_json(ext, _OBJECT)), q)), F.from_json(ext, _OBJECT)))
        objects = F.startswith(top, F.lit("{")) & F.startswith(ext, F.lit("{"))
        entries.append(F.struct(F.lit(k).alias("key"), F.when(objects, both).otherwise(F.coalesce(ext, top)).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def config_similarity(a: Column, b: Column) -> Column:
    """Mean of the Jaccard similarity of extension keys and, for each shared key,
    that of its subkeys (or 0 and 1 for values that are not objects)."""
    x, y = theme_extensions(a), theme_extensions(b)
    shared = F.array_intersect(F.map_keys(x), F.map_keys(y))

    def one(k: Column) -> Column:
        objects = F.startswith(x[k], F.lit("{")) & F.startswith(y[k], F.lit("{"))
        keys = lambda m: F.coalesce(F.json_object_keys(m[k]), F.array().cast("array<string>"))
        return F.when(objects, jaccard(keys(x), keys(y))).otherwise((x[k] == y[k]).cast("double"))

    total = F.aggregate(F.transform(shared, one), jaccard(F.map_keys(x), F.map_keys(y)), lambda s, v: s + v)
    return (total / (F.size(shared) + 1)).cast("double")


class Analyzers:
    """Named comparison functions, each from two tables to one; a plug-in surface."""

    def __init__(self):
        self.known = {}

    def register(self, name: str, compare) -> None:
        self.known[name] = compare

    def run_all(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """Results of all analyzers under one another, with the analyzer's name."""
        results = [compare(left, right, keys).withColumn("analyzer", F.lit(n)) for n, compare in sorted(self.known.items())]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
