"""Comparison of package.json and tsconfig.json, on JSON text columns.

Null results mean that a section is absent from both sides; they are kept, not
counted as 0.  Text that is not JSON counts as the empty object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, parts
from ..functions.similarity import fuzzy_string, jaccard, ratio_udf
from ..storage import written

# Entries that every project has, section weights, metadata keys.
BOILERPLATE_PACKAGES = ("react", "react-dom", "next")
BOILERPLATE_SCRIPTS = ("dev", "build", "start", "lint")
META_KEYS = ("name", "version", "description", "keywords", "author")
WEIGHTS = {"dependencies": 0.5, "devDependencies": 0.2, "peerDependencies": 0.05, "scripts": 0.05, "meta": 0.05, "config": 0.05}

_MAP = "map<string,string>"


def object_map(text: Column) -> Column:
    """Top-level entries of a JSON object as text; empty for anything else."""
    return F.coalesce(F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("{")), text), _MAP), F.create_map().cast(_MAP))


def normalize_version(v: Column) -> Column:
    return F.regexp_replace(F.trim(v), r"^[\^~><= ]+", "")


def version_score(a: Column, b: Column) -> Column:
    """Equal 1; as many numeric parts (two or more), only the last differing and by
    one, 0.3; else 0."""
    x, y = normalize_version(a), normalize_version(b)
    numbers = lambda v: F.transform(F.filter(F.split(v, r"\."), lambda p: p.rlike(r"^[0-9]+$")), lambda p: p.cast("long"))
    p, q = numbers(x), numbers(y)
    head = lambda n: F.slice(n, F.lit(1), F.size(n) - 1)
    close = (F.size(p) == F.size(q)) & (F.size(p) >= 2) & (head(F.when(F.size(p) >= 2, p)) == head(F.when(F.size(q) >= 2, q))) & (
        F.abs(F.element_at(F.when(F.size(p) >= 1, p), -1) - F.element_at(F.when(F.size(q) >= 1, q), -1)) == 1)
    return F.when(x == y, 1.0).when(F.coalesce(close, F.lit(False)), 0.3).otherwise(0.0).cast("double")


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def dependency_similarity(a: Column, b: Column) -> Column:
    """0.3 of the Jaccard similarity of names without boilerplate, 0.7 of the mean
    version score of shared names; names alone where none is shared."""
    plain = F.array(*map(F.lit, BOILERPLATE_PACKAGES))
    keys = jaccard(F.array_except(F.map_keys(a), plain), F.array_except(F.map_keys(b), plain))
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.when(F.size(shared) == 0, keys).otherwise(0.3 * keys + 0.7 * mean(F.transform(shared, lambda k: version_score(a[k], b[k])))).cast("double")


def own_scripts(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*BOILERPLATE_SCRIPTS))


def script_table(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, script_similarity``: 0.6 of the names' Jaccard similarity and 0.4 of the
    mean text ratio of shared scripts.  Texts are compared in rows, so that the
    Arrow function sees one column of pairs."""
    base = pairs.select(key, own_scripts(F.col(a)).alias("x"), own_scripts(F.col(b)).alias("y"))
    shared = base.select(key, "x", "y", F.explode(F.array_intersect(F.map_keys("x"), F.map_keys("y"))).alias("k"))
    texts = shared.select(key, F.col("x")[F.col("k")].alias("p"), F.col("y")[F.col("k")].alias("q"))
    scored = texts.select(key, "p", "q", ratio_udf("p", "q").alias("r"))
    one_empty = (F.col("p") == "") != (F.col("q") == "")
    means = scored.groupBy(key).agg(F.avg(F.when(one_empty, 0.0).otherwise(F.col("r"))).alias("commands"))
    names = base.select(key, jaccard(F.map_keys("x"), F.map_keys("y")).alias("names"))
    return names.join(means, key, "left").select(key, F.coalesce(0.6 * F.col("names") + 0.4 * F.col("commands"), F.col("names")).alias("script_similarity"))


def metadata_similarity(a: Column, b: Column) -> Column:
    """Mean over five keys: lists by Jaccard similarity, else equality of non-empty text."""
    def one(k: str) -> Column:
        x, y = a[k], b[k]
        lists = F.startswith(x, F.lit("[")) & F.startswith(y, F.lit("["))
        items = lambda v: F.transform(F.from_json(v, "array<string>"), lambda s: F.lower(F.trim(F.coalesce(s, F.lit("")))))
        p, q = (F.lower(F.trim(F.coalesce(v, F.lit("")))) for v in (x, y))
        return F.when(F.coalesce(lists, F.lit(False)), jaccard(items(x), items(y))).otherwise(((p == q) & (p != "")).cast("double"))

    return mean(F.array(*map(one, META_KEYS)))


def is_config_key(k: Column) -> Column:
    return F.endswith(k, F.lit("Config")) | k.isin("browserslist", "jest")


def config_keys(m: Column) -> Column:
    return F.filter(F.map_keys(m), is_config_key)


def config_block_table(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, config_similarity`` for pairs with a config block on either side: the
    mean over shared blocks (objects and lists by Jaccard similarity, else the
    text ratio), 1 if none is shared."""
    base = pairs.select(key, F.col(a).alias("x"), F.col(b).alias("y")).where((F.size(config_keys(F.col("x"))) > 0) | (F.size(config_keys(F.col("y"))) > 0))
    shared = base.select(key, "x", "y", F.explode(F.array_intersect(config_keys(F.col("x")), config_keys(F.col("y")))).alias("k"))
    values = shared.select(key, F.coalesce(F.col("x")[F.col("k")], F.lit("")).alias("p"), F.coalesce(F.col("y")[F.col("k")], F.lit("")).alias("q"))
    values = values.select(key, "p", "q", ratio_udf("p", "q").alias("r"))
    both = lambda c: F.startswith("p", F.lit(c)) & F.startswith("q", F.lit(c))
    keys = lambda c: F.map_keys(object_map(F.col(c)))
    items = lambda c: F.from_json(c, "array<string>")
    score = F.when(both("{"), jaccard(keys("p"), keys("q"))).when(both("["), jaccard(items("p"), items("q"))).otherwise(F.col("r"))
    means = values.select(key, score.alias("s")).groupBy(key).agg(F.avg("s").alias("m"))
    return base.select(key).join(means, key, "left").select(key, F.coalesce("m", F.lit(1.0)).alias("config_similarity"))


def weighted_sections(sections: dict[str, Column]) -> tuple[Column, Column]:
    """(score, weight of dependencies): the weights of absent sections go to the
    dependencies; the mean is over present ones, null if there are none."""
    moved = sum((F.when(c.isNull(), F.lit(WEIGHTS[n])).otherwise(0.0) for n, c in sections.items() if n != "dependencies"), F.lit(WEIGHTS["dependencies"]))
    weights = {n: moved if n == "dependencies" else F.lit(WEIGHTS[n]) for n in sections}
    top = sum((F.coalesce(c * weights[n], F.lit(0.0)) for n, c in sections.items()), F.lit(0.0))
    low = sum((F.when(c.isNotNull(), weights[n]).otherwise(0.0) for n, c in sections.items()), F.lit(0.0))
    return F.when(low > 0, top / low), moved


def package_similarity(pairs: DataFrame, key: str = "pair_id", a: str = "original", b: str = "modified") -> DataFrame:
    """``key, package_similarity`` and the similarity of each section, from two
    package.json texts."""
    maps = pairs.select(key, object_map(F.col(a)).alias("x"), object_map(F.col(b)).alias("y"))
    x, y = F.col("x"), F.col("y")
    absent = lambda k: ~F.map_contains_key(x, k) & ~F.map_contains_key(y, k)
    sides = {k: (object_map(x[k]), object_map(y[k])) for k in ("dependencies", "devDependencies", "peerDependencies", "scripts")}
    rows = maps.select(
        key, "x", "y", sides["scripts"][0].alias("sx"), sides["scripts"][1].alias("sy"), absent("scripts").alias("no_scripts"),
        *(F.when(~absent(k), dependency_similarity(*sides[k])).alias(k) for k in ("dependencies", "devDependencies", "peerDependencies")),
        F.when(F.arrays_overlap(F.array_union(F.map_keys(x), F.map_keys(y)), F.array(*map(F.lit, META_KEYS))), metadata_similarity(x, y)).alias("meta"))
    rows = rows.join(script_table(rows, key, "sx", "sy"), key).join(config_block_table(rows, key, "x", "y"), key, "left")
    rows = rows.withColumn("scripts", F.when(~F.col("no_scripts"), F.col("script_similarity")))
    score, weight = weighted_sections({n: F.col({"config": "config_similarity"}.get(n, n)) for n in WEIGHTS})
    return rows.select(key, score.alias("package_similarity"), "dependencies", "devDependencies", "peerDependencies", "scripts", "meta",
                       F.col("config_similarity").alias("config"), weight.alias("dependencies_weight"))


def flatten_json(rows: DataFrame, keys: list[str], text: str, levels: int = 6) -> DataFrame:
    """Keys with dotted path and text of each leaf; empty objects vanish.

    One plan takes ``levels`` levels; while some object is deeper, what is left is
    written and goes through another."""
    now = rows.select(*keys, F.explode(object_map(F.col(text))).alias("path", "value"))
    nested = F.coalesce(F.startswith("value", F.lit("{")), F.lit(False))
    done = None
    while True:
        for _ in range(levels):
            leaves = now.where(~nested)
            done = leaves if done is None else done.unionByName(leaves)
            now = now.where(nested).select(*keys, "path", F.explode(object_map(F.col("value"))).alias("k", "value")).select(
                *keys, F.concat_ws(".", "path", "k").alias("path"), "value")
        now = written(now, "nested")
        if now.isEmpty():
            return done


def tsconfig_similarity(pairs: DataFrame, key: str = "pair_id", a: str = "original", b: str = "modified") -> DataFrame:
    """``key, tsconfig_similarity``: share of all flattened compiler options whose
    trimmed small text is equal; 1 if there are none."""
    sides = []
    for column, name in ((a, "l"), (b, "r")):
        options = pairs.select(key, object_map(F.col(column))["compilerOptions"].alias("o"))
        sides.append(flatten_json(options, [key], "o").select(key, "path", F.lower(F.trim(F.coalesce("value", F.lit("none")))).alias(name)))
    both = sides[0].join(sides[1], [key, "path"], "full").groupBy(key).agg((F.count_if(F.col("l") == F.col("r")) / F.count("*")).alias("s"))
    return pairs.select(key).join(both, key, "left").select(key, F.coalesce("s", F.lit(1.0)).alias("tsconfig_similarity"))


def find_file(files: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """For each ``keys`` the file of that name nearest to the root, then by path."""
    hits = files.where(basename(F.col("path")) == name)
    return hits.groupBy(*keys).agg(F.min_by(F.struct("path", "content"), F.struct(F.size(parts(F.col("path"))), "path")).alias("f")).select(*keys, "f.*")


def config_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """``pair_id, package_similarity, tsconfig_similarity`` of two file tables; null
    where a file is absent from either side."""
    out = None
    for name, compare in (("package.json", package_similarity), ("tsconfig.json", tsconfig_similarity)):
        a, b = (find_file(f, name, ["pair_id"]).select("pair_id", F.col("content").alias(c)) for f, c in ((left, "original"), (right, "modified")))
        found = compare(a.join(b, "pair_id")).select("pair_id", compare.__name__)
        out = found if out is None else out.join(found, "pair_id", "full")
    return out


def compiler_options_similarity(a: Column, b: Column) -> Column:
    """Of two option maps: 0.6 of the names' Jaccard similarity and 0.4 of the mean
    agreement of shared options (equal 1, else 0.7); names alone if none is shared."""
    names = jaccard(F.map_keys(a), F.map_keys(b))
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    agreement = mean(F.transform(shared, lambda k: F.when(F.lower(a[k]) == F.lower(b[k]), 1.0).otherwise(0.7)))
    return F.when(F.size(shared) == 0, names).otherwise(0.6 * names + 0.4 * agreement).cast("double")


def include_exclude_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the included and excluded patterns of two tsconfig maps."""
    none = F.array().cast("array<string>")

    def patterns(m: Column) -> Column:
        return F.concat(*(F.coalesce(F.from_json(m[k], "array<string>"), none) for k in ("include", "exclude")))

    return jaccard(patterns(a), patterns(b))


def paths_extends_table(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, paths_similarity``: mean of the path names' Jaccard similarity (1 unless
    both sides have some) and of the text similarities of baseUrl and extends."""
    def side(column: str, name: str) -> list[Column]:
        options = object_map(F.col(column)["compilerOptions"])
        return [F.map_keys(object_map(options["paths"])).alias(f"{name}p"), F.coalesce(options["baseUrl"], F.lit("")).alias(f"{name}b"),
                F.coalesce(F.col(column)["extends"], F.lit("")).alias(f"{name}e")]

    rows = pairs.select(key, *side(a, "x"), *side(b, "y"))
    rows = rows.select("*", ratio_udf("xb", "yb").alias("rb"), ratio_udf("xe", "ye").alias("re"))
    names = F.when((F.size("xp") > 0) & (F.size("yp") > 0), jaccard(F.col("xp"), F.col("yp"))).otherwise(1.0)
    texts = [fuzzy_string(F.col(f"x{c}"), F.col(f"y{c}"), F.col(f"r{c}")) for c in "be"]
    return rows.select(key, ((names + texts[0] + texts[1]) / 3).alias("paths_similarity"))
