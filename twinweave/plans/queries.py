"""Registered queries of the comparison operators, with their SQL where SQL has
the operation.  Inline fixtures are VALUES lists that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import css as css_functions
from ..functions import paths
from ..functions.html import html_nodes
from ..functions.js import js_outline
from ..functions.similarity import jaccard, multiset_jaccard, ratio_possible, ratio_udf, verdict_level
from ..operators import classes, css, jsonconfig, jslogic, matching, scores
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values}")


# --- multisets of tags on neighbouring pages -----------------------------------

_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(1))).alias("t"))
    return pages.select("page_id", F.lower("t").alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def neighbours(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of the pages that have a next page, and of that page under their id."""
    after = counts.withColumn("page_id", F.col("page_id") - 1)
    ids, next_ids = counts.select("page_id").distinct(), after.select("page_id").distinct()
    return counts.join(next_ids, "page_id", "left_semi"), after.join(ids, "page_id", "left_semi")


_TAGS_SQL = f"""tags AS (SELECT page_id, lower(t) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_TAG}', 1)) AS t FROM pages) GROUP BY ALL),
ids AS (SELECT DISTINCT page_id FROM tags), pairs AS (SELECT a.page_id FROM ids a JOIN ids b ON b.page_id = a.page_id + 1),
merged AS (SELECT coalesce(x.page_id, y.page_id) AS page_id, coalesce(x.tag, y.tag) AS tag, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b
  FROM (SELECT t.* FROM tags t JOIN pairs USING (page_id)) x
  FULL JOIN (SELECT p.page_id, t.tag, t.n FROM tags t JOIN pairs p ON t.page_id = p.page_id + 1) y ON x.page_id = y.page_id AND x.tag = y.tag),
sims AS (SELECT page_id, CAST(sum(least(a, b)) AS DOUBLE) / sum(greatest(a, b)) AS frequency_similarity,
    CAST(count(*) FILTER (a > 0 AND b > 0) AS DOUBLE) / count(*) AS set_similarity,
    0.5::DOUBLE * (CAST(sum(least(a, b)) AS DOUBLE) / sum(greatest(a, b))) + 0.5::DOUBLE * (CAST(count(*) FILTER (a > 0 AND b > 0) AS DOUBLE) / count(*)) AS hybrid_similarity,
    count(*) FILTER (a > 0 AND b > 0) AS shared, count(*) FILTER (b = 0) AS only_original, count(*) FILTER (a = 0) AS only_modified, count(*) AS n_classes
  FROM merged GROUP BY page_id)"""
_LEVEL_SQL = "CASE WHEN {0} >= 0.75 THEN 'high' WHEN {0} >= 0.4 THEN 'moderate' ELSE 'low' END"


def hybrids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its neighbour: one join of small maps; counting stays in the row."""
    tags = table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.transform(F.regexp_extract_all("html", F.lit(_TAG), F.lit(1)), F.lower).alias("t"))
    maps = tags.where(F.size("t") > 0).select("page_id", classes.count_map(F.col("t")).alias("m"))
    return classes.compare_maps(maps.join(maps.select((F.col("page_id") - 1).alias("page_id"), F.col("m").alias("m2")), "page_id"), ["page_id"], "m", "m2")


@query(f"WITH {_TAGS_SQL} SELECT *, {_LEVEL_SQL.format('hybrid_similarity')} AS level FROM sims")
def tag_multiset_similarity(spark, sf_dir):
    return hybrids(spark, sf_dir).withColumn("level", verdict_level(F.col("hybrid_similarity")))


@query(f"WITH {_TAGS_SQL} SELECT page_id, tag, a, b, abs(a - b) AS count_diff FROM merged WHERE a <> b")
def change_impact(spark, sf_dir):
    return classes.change_impact(*neighbours(tag_counts(spark, sf_dir)), ["page_id"], "tag")


@query(f"""WITH {_TAGS_SQL}, soft AS (SELECT page_id, count(*) = 1 AND max(abs(a - b)) = 1 AS trivial FROM merged WHERE a <> b GROUP BY page_id)
SELECT page_id % 7 AS pair_id, avg(hybrid_similarity) AS mean_hybrid, avg(set_similarity) AS mean_set, avg(frequency_similarity) AS mean_frequency,
  median(hybrid_similarity) AS median_hybrid, avg(CASE WHEN hybrid_similarity >= 0.9 THEN 1.0::DOUBLE ELSE 0 END) AS share_high,
  sum(hybrid_similarity * n_classes) / sum(n_classes) AS weighted_hybrid,
  coalesce(avg(hybrid_similarity) FILTER (NOT coalesce(trivial, false)), avg(hybrid_similarity)) AS soft_hybrid
FROM sims LEFT JOIN soft USING (page_id) GROUP BY 1""")
def similarity_stats(spark, sf_dir):
    sides = neighbours(tag_counts(spark, sf_dir))
    rows = classes.compare_with_impacts(*sides, ["page_id"], "tag")
    return scores.similarity_stats(rows.withColumn("pair_id", F.col("page_id") % 7), ["pair_id"])


def _derived(spark, sf_dir):
    """Pages as matched files: similarities from tags; every fifth is left unmatched."""
    rows = hybrids(spark, sf_dir).select(
        (F.col("page_id") % 7).alias("pair_id"), F.element_at(F.array(*map(F.lit, ("html", "css", "js", "jsx"))), (F.col("page_id") % 4 + 1).cast("int")).alias("file_type"),
        "page_id", F.col("page_id").cast("string").alias("original"), F.col("page_id").cast("string").alias("modified"),
        F.col("hybrid_similarity").alias("similarity"))
    return rows.where("page_id % 5 <> 0"), rows.where("page_id % 5 = 0").select("pair_id", "file_type", F.lit("original").alias("side"), F.col("original").alias("path"))


_DERIVED_SQL = _TAGS_SQL + """, rows AS (SELECT page_id % 7 AS pair_id, (['html', 'css', 'js', 'jsx'])[page_id % 4 + 1] AS file_type, page_id, hybrid_similarity AS similarity FROM sims)"""


@query(f"""WITH {_DERIVED_SQL}, t AS (SELECT pair_id, file_type, count(*) FILTER (page_id % 5 <> 0) AS matched, count(*) FILTER (page_id % 5 = 0) AS unmatched,
  coalesce(sum(similarity) FILTER (page_id % 5 <> 0), 0) / count(*) AS similarity FROM rows GROUP BY ALL) SELECT *, {_LEVEL_SQL.format('similarity')} AS level FROM t""")
def type_score(spark, sf_dir):
    return scores.type_scores(*_derived(spark, sf_dir))


@query(f"""WITH {_DERIVED_SQL}, s AS (SELECT pair_id, CASE WHEN page_id % 5 <> 0 THEN similarity ELSE 0 END AS s FROM rows
  UNION ALL SELECT page_id % 7, hybrid_similarity FROM sims
  UNION ALL SELECT pair_id, s FROM (VALUES (0, 0.5::DOUBLE), (0, 0.5::DOUBLE), (0, 0.25::DOUBLE), (1, 1.0::DOUBLE), (1, 1.0::DOUBLE), (2, 0.125::DOUBLE)) AS c(pair_id, s)),
t AS (SELECT pair_id, count(*) AS files, avg(s) AS overall_similarity FROM s GROUP BY pair_id) SELECT *, {_LEVEL_SQL.format('overall_similarity')} AS level FROM t""")
def overall_score(spark, sf_dir):
    configs = fixture(spark, "(VALUES (0L, 0.5D, 0.25D), (1L, 1.0D, CAST(NULL AS DOUBLE)), (2L, CAST(NULL AS DOUBLE), 0.125D)) AS t(pair_id, package_similarity, tsconfig_similarity)")
    pairs = hybrids(spark, sf_dir).withColumn("pair_id", F.col("page_id") % 7)
    return scores.overall_scores(*_derived(spark, sf_dir), pairs, configs)


@query(f"""WITH {_TAGS_SQL}, k AS (SELECT page_id % 7 AS pair_id, CASE WHEN b = 0 THEN 'missing' WHEN a = 0 THEN 'extra' WHEN a = b THEN 'match' ELSE 'different' END AS kind FROM merged)
SELECT pair_id, count(*) AS total, count(*) FILTER (kind = 'match') AS match, count(*) FILTER (kind = 'different') AS different,
  count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'extra') AS extra FROM k GROUP BY pair_id""")
def summary_totals(spark, sf_dir):
    rows = classes.merged_counts(*neighbours(tag_counts(spark, sf_dir)), ["page_id"], "tag")
    kind = F.when(F.col("b") == 0, "missing").when(F.col("a") == 0, "extra").when(F.col("a") == F.col("b"), "match").otherwise("different")
    return scores.element_totals(rows.select((F.col("page_id") % 7).alias("pair_id"), kind.alias("kind")), ["pair_id"])


@query("""WITH c AS (SELECT page_id, unnest(string_split_regex(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' ')) AS class
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?:class|className)\\s*=\\s*"([^"]+)"', 1)) AS x FROM pages))
SELECT page_id, class, count(*) AS n FROM c WHERE class <> '' GROUP BY page_id, class""")
def class_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(classes.markup_classes(F.col("html"))).alias("class")).groupBy("page_id", "class").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id, string_split_regex(html, '(?:class|className)\\s*=\\s*"[^"]+"') AS pieces, regexp_extract_all(html, '(?:class|className)\\s*=\\s*"([^"]+)"', 1) AS found FROM pages),
e AS (SELECT page_id, unnest(string_split(found[i], ' ')) AS class, 1 + list_sum(list_transform(pieces[1:i], lambda s: length(s) - length(replace(s, chr(10), '')))) AS line FROM p, unnest(range(1, len(found) + 1)) AS u(i))
SELECT page_id, class, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM e WHERE class <> '' GROUP BY page_id, class""")
def class_line_numbers(spark, sf_dir):
    rows = classes.class_lines(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")), ["page_id"])
    return rows.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query("""WITH e AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(substr(html, strpos(html, '<body')), '(?s)<!--.*?-->|<script.*?</script>', '', 'g'), '<([a-z0-9]+) class="[^"]*"')) AS tag FROM pages)
SELECT page_id, regexp_extract(tag, '"([^"]*)"', 1) AS class, count(*) AS n, string_agg(tag || '>', ',' ORDER BY tag) AS locations FROM e GROUP BY 1, 2""")
def class_locations(spark, sf_dir):
    rows = classes.html_classes(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")), ["page_id"])
    return rows.withColumn("locations", F.array_join("locations", ","))


# --- files and joins ------------------------------------------------------------

_PATHS = """(VALUES ('src/App.JSX'), ('a/b.tsx'), ('x.ts'), ('next-env.d.ts'), ('lib/tailwind.config.js'), ('tailwind.config.js'), ('s.css'), ('i.html'), ('i.htm'),
  ('m.mjs'), ('.css'), ('d.x/readme'), ('style.scss'), ('a.json'), ('.git/x.js'), ('p/.hid.html'), ('vite.config.js')) AS t(path)"""


@query(f"""WITH t AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base FROM {_PATHS}), e AS (SELECT *, lower(regexp_extract(base, '^.+(\\.[^.]*)$', 1)) AS ext FROM t)
SELECT path, CASE WHEN base = 'tailwind.config.js' THEN 'tailwind_config' WHEN ext = '.html' THEN 'html' WHEN ext = '.css' THEN 'css' WHEN ext IN ('.jsx', '.tsx') THEN 'jsx'
    WHEN ext IN ('.js', '.ts') THEN 'js' END AS file_type,
  CASE WHEN regexp_matches(lower(base), '\\.(html|htm)$') THEN 'html' WHEN regexp_matches(lower(base), '\\.(js|jsx|ts|tsx)$') THEN 'js'
    WHEN regexp_matches(lower(base), '\\.(css|scss|sass)$') THEN 'css' WHEN regexp_matches(lower(base), '\\.(config\\.js|json)$') THEN 'config' END AS category,
  regexp_matches(path, '(^|/)\\.[^/]') AS hidden, path LIKE '%next-env.d.ts' AS boilerplate FROM e""")
def classify_files(spark, sf_dir):
    p = F.col("path")
    return fixture(spark, _PATHS).select(p, paths.file_type(p).alias("file_type"), paths.category(p).alias("category"), paths.is_hidden(p).alias("hidden"), paths.is_boilerplate(p).alias("boilerplate"))


def _page_files(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]*/?", ""), "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select(F.lit(0).alias("pair_id"), F.coalesce(paths.file_type(path), F.lit("other")).alias("file_type"), path.alias("path"), (F.col("page_id") % 2).alias("side"))
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


_PAGES_SQL = """f AS (SELECT page_id % 2 AS side, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/?', ''), '[?#].*$', '') AS path FROM pages),
g AS (SELECT side, path, CASE WHEN lower(path) LIKE '%_.html' THEN 'html' ELSE 'other' END AS file_type FROM f)"""


@query(f"WITH {_PAGES_SQL} SELECT 0 AS pair_id, a.file_type, a.path AS original, b.path AS modified, 1.0::DOUBLE AS score FROM g a JOIN g b ON a.path = b.path AND a.side = 0 AND b.side = 1")
def exact_path_join(spark, sf_dir):
    return matching.exact_join(*_page_files(spark, sf_dir))


@query(f"""WITH {_PAGES_SQL} SELECT 0 AS pair_id, file_type, CASE WHEN side = 0 THEN 'original' ELSE 'modified' END AS side, path FROM g
WHERE path NOT IN (SELECT a.path FROM g a JOIN g b ON a.path = b.path AND a.side = 0 AND b.side = 1)""")
def unmatched_files(spark, sf_dir):
    left, right = _page_files(spark, sf_dir)
    return matching.unmatched(left, right, matching.exact_join(left, right))


def _part_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    rows = names.select(F.lit(0).alias("pair_id"), F.lit("css").alias("file_type"), F.concat(F.lit("parts/"), F.col("p_name")).alias("path"), F.col("p_name").alias("content"))
    return rows.where("content < 'm'"), rows.where("content >= 'm'")


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS original, b.p_name AS modified FROM n a JOIN n b ON a.p_name < 'm' AND b.p_name >= 'm'
  AND 2.0 * least(length(a.p_name), length(b.p_name)) >= 0.75 * (length(a.p_name) + length(b.p_name))""")
def blocked_candidates(spark, sf_dir):
    left, right = _part_names(spark, sf_dir)
    pairs = matching.blocked_pairs(left, right, ratio_possible(F.col("l.content"), F.col("r.content"), matching.FUZZY))
    return pairs.select(F.col("l.content").alias("original"), F.col("r.content").alias("modified"))


def _ratio_sql(pairs: str) -> str:
    """CTEs of the Ratcliff-Obershelp ratio of the pairs (a, b) of a table: an
    interval of both texts yields its longest common block (of equal ones the
    first of a, then of b) and the intervals before and after it."""
    return f"""blocks(a, b, alo, ahi, blo, bhi, k) AS (
  SELECT DISTINCT a, b, CAST(0 AS BIGINT), length(a), CAST(0 AS BIGINT), length(b), CAST(0 AS BIGINT) FROM {pairs}
  UNION ALL SELECT a, b, s.alo, s.ahi, s.blo, s.bhi, s.k FROM (
    SELECT a, b, unnest([{{'alo': alo, 'ahi': -best.i, 'blo': blo, 'bhi': -best.j, 'k': best.k}}, {{'alo': best.k - best.i, 'ahi': ahi, 'blo': best.k - best.j, 'bhi': bhi, 'k': 0}}]) AS s
    FROM (SELECT *, list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: {{
        'k': len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))), 'i': -i, 'j': -j}})))) AS best FROM blocks)
    WHERE best.k > 0)),
ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * sum(k) / (length(a) + length(b)) END AS score FROM blocks GROUP BY a, b)"""


def _greedy_sql(threshold: float) -> str:
    """Each left name in order takes the best right name that is still free."""
    return f"""WITH RECURSIVE names AS (SELECT DISTINCT p_name FROM part), pairs AS (SELECT x.p_name AS a, y.p_name AS b FROM names x JOIN names y ON x.p_name < 'm' AND y.p_name >= 'm'),
{_ratio_sql('pairs')},
lefts AS (SELECT a, row_number() OVER (ORDER BY a) AS n, list({{'score': score, 'b': b}} ORDER BY score DESC, b) AS c FROM ratios WHERE score >= {threshold} GROUP BY a),
walk(n, used, a, x) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS STRUCT(score DOUBLE, b VARCHAR))
  UNION ALL SELECT n, CASE WHEN x IS NULL THEN used ELSE list_append(used, x.b) END, a, x
  FROM (SELECT l.n, l.a, w.used, list_filter(l.c, lambda y: NOT list_contains(w.used, y.b))[1] AS x FROM walk w JOIN lefts l ON l.n = w.n + 1))
SELECT 0 AS pair_id, 'css' AS file_type, 'parts/' || a AS original, 'parts/' || x.b AS modified, x.score AS score FROM walk WHERE x IS NOT NULL"""


@query(_greedy_sql(0.4))
def fuzzy_filename_match(spark, sf_dir):
    return matching.greedy(matching.fuzzy_candidates(*_part_names(spark, sf_dir), threshold=0.4), 0.4)


@query(_greedy_sql(0.4))
def greedy_fold(spark, sf_dir):
    return matching.greedy_native(matching.fuzzy_candidates(*_part_names(spark, sf_dir), threshold=0.4), 0.4)


@query(_greedy_sql(0.3))
def content_match(spark, sf_dir):
    return matching.greedy(matching.content_candidates(*_part_names(spark, sf_dir), threshold=0.3), 0.3)


_FILES = """(VALUES ('a', 'src/main.css', 'src/style.css'), ('b', 'main.css', 'style.css'), ('c', 'src/ui/a.css', 'src/ui/b.css'), ('d', 'src/ui/a.css', 'src2/ui/b.css'),
  ('e', 'x/y/z/a.css', 'x/y/b.css')) AS t(id, l, r)"""


@query(f"""WITH t AS (SELECT id, string_split(l, '/') AS a, string_split(r, '/') AS b FROM {_FILES})
SELECT id, CAST((SELECT count(*) FROM unnest(range(1, least(len(a), len(b)))) AS u(i) WHERE a[1:i] = b[1:i]) AS DOUBLE) / greatest(len(a), len(b)) AS folder_score FROM t""")
def contextual_score(spark, sf_dir):
    return fixture(spark, _FILES).select("id", matching.folder_score(F.col("l"), F.col("r")).alias("folder_score"))


# --- baskets ----------------------------------------------------------------------

_BASKETS = "b AS (SELECT l_suppkey AS k, l_partkey % 50 AS item, count(*) AS n FROM lineitem GROUP BY ALL)"


def _baskets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("item")).groupBy("k", "item").agg(F.count("*").alias("n"))
    maps = rows.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("m"))
    return maps.join(maps.select((F.col("k") - 1).alias("k"), F.col("m").alias("m2")), "k")


@query(f"""WITH {_BASKETS}, ks AS (SELECT DISTINCT k FROM b), p AS (SELECT x.k FROM ks x JOIN ks y ON y.k = x.k + 1)
SELECT p.k, CAST(count(*) FILTER (two = 2) AS DOUBLE) / count(*) AS similarity FROM p JOIN (SELECT p.k, item, count(*) AS two FROM p JOIN b ON b.k IN (p.k, p.k + 1) GROUP BY ALL) u USING (k) GROUP BY p.k""")
def basket_set_jaccard(spark, sf_dir):
    return _baskets(spark, sf_dir).select("k", jaccard(F.map_keys("m"), F.map_keys("m2")).alias("similarity"))


@query(f"""WITH {_BASKETS}, ks AS (SELECT DISTINCT k FROM b), p AS (SELECT x.k FROM ks x JOIN ks y ON y.k = x.k + 1),
u AS (SELECT p.k, item, sum(n) FILTER (b.k = p.k) AS n1, sum(n) FILTER (b.k = p.k + 1) AS n2 FROM p JOIN b ON b.k IN (p.k, p.k + 1) GROUP BY ALL)
SELECT k, CAST(sum(least(coalesce(n1, 0), coalesce(n2, 0))) AS DOUBLE) / sum(greatest(coalesce(n1, 0), coalesce(n2, 0))) AS similarity FROM u GROUP BY k""")
def basket_multiset_jaccard(spark, sf_dir):
    return _baskets(spark, sf_dir).select("k", multiset_jaccard(F.col("m"), F.col("m2")).alias("similarity"))


@query("""WITH e AS (SELECT conv_id, role AS caller, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS callee FROM conversations),
s AS (SELECT DISTINCT conv_id, caller, callee FROM e WHERE callee IS NOT NULL), ids AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT a.conv_id FROM ids a JOIN ids b ON b.conv_id = a.conv_id + 1),
u AS (SELECT p.conv_id, caller, callee, count(*) AS two FROM p JOIN s ON s.conv_id IN (p.conv_id, p.conv_id + 1) GROUP BY ALL)
SELECT p.conv_id, coalesce(CAST(count(*) FILTER (two = 2) AS DOUBLE) / nullif(count(two), 0), 1.0) AS similarity FROM p LEFT JOIN u USING (conv_id) GROUP BY p.conv_id""")
def call_graph_jaccard(spark, sf_dir):
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    edges = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.get("t", i - 1)["role"].alias("caller"), F.get("t", i)["role"].alias("callee"))))
    none = F.array().cast("array<struct<caller:string,callee:string>>")
    rows = rows.select("conv_id", F.when(F.size("t") > 1, edges).otherwise(none).alias("e"))
    return rows.join(rows.select((F.col("conv_id") - 1).alias("conv_id"), F.col("e").alias("f")), "conv_id").select("conv_id", jslogic.call_graph_jaccard(F.col("e"), F.col("f")).alias("similarity"))


# --- JSON configuration --------------------------------------------------------------

_VERSIONS = """(VALUES (1, '^1.2.3', '1.2.3'), (2, '1.2.3', '1.2.4'), (3, '1.2.3', '1.3.3'), (4, '1.2.3', '1.2.5'), (5, '~2', '>=2'), (6, '2', '3'),
  (7, '1.x.4', '1.y.5'), (8, 'latest', 'next'), (9, '', ''), (10, '1.0', '1.1')) AS t(id, a, b)"""


def _version_sql(a: str, b: str) -> str:
    """Score of two version texts as an expression."""
    x, y = (f"regexp_replace(trim({c}), '^[\\^~><= ]+', '')" for c in (a, b))
    p, q = (f"list_transform(list_filter(string_split({v}, '.'), lambda s: regexp_matches(s, '^[0-9]+$')), lambda s: CAST(s AS BIGINT))" for v in (x, y))
    return f"CAST(CASE WHEN {x} = {y} THEN 1.0 WHEN len({p}) = len({q}) AND len({p}) >= 2 AND ({p})[1:-2] = ({q})[1:-2] AND abs(({p})[-1] - ({q})[-1]) = 1 THEN 0.3 ELSE 0.0 END AS DOUBLE)"


@query(f"SELECT id, {_version_sql('a', 'b')} AS score FROM {_VERSIONS}")
def version_score(spark, sf_dir):
    return fixture(spark, _VERSIONS).select("id", jsonconfig.version_score(F.col("a"), F.col("b")).alias("score"))


_DEPENDENCIES = """(VALUES (1, 0, 'react', '18.0.0'), (1, 0, 'lodash', '4.0.0'), (1, 1, 'react', '18.0.0'), (1, 1, 'axios', '1.0.0'), (2, 0, 'a', '1.2.3'), (2, 1, 'a', '1.2.4'),
  (3, 0, 'a', '1'), (3, 1, 'b', '1'), (4, 0, 'next', '1'), (4, 1, 'next', '1'), (5, 0, 'a', '1.0.0'), (5, 0, 'b', '1.0.0'), (5, 1, 'a', '^1.0.0'), (5, 1, 'c', '2')) AS t(id, side, name, version)"""


@query(f"""WITH d AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.name, y.name) AS name, x.version AS a, y.version AS b
  FROM (SELECT * FROM {_DEPENDENCIES} WHERE side = 0) x FULL JOIN (SELECT * FROM {_DEPENDENCIES} WHERE side = 1) y ON x.id = y.id AND x.name = y.name),
s AS (SELECT *, name IN ('react', 'react-dom', 'next') AS plain FROM d),
g AS (SELECT id, coalesce(CAST(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND NOT plain) AS DOUBLE) / nullif(count(*) FILTER (NOT plain), 0), 1.0) AS keys,
  avg({_version_sql('a', 'b')}) FILTER (a IS NOT NULL AND b IS NOT NULL) AS versions FROM s GROUP BY id)
SELECT id, CAST(CASE WHEN versions IS NULL THEN keys ELSE 0.3 * keys + 0.7 * versions END AS DOUBLE) AS similarity FROM g""")
def dependency_similarity(spark, sf_dir):
    rows = fixture(spark, _DEPENDENCIES)
    entries = lambda side: F.map_from_entries(F.collect_list(F.when(F.col("side") == side, F.struct("name", "version"))))
    maps = rows.groupBy("id").agg(entries(0).alias("a"), entries(1).alias("b"))
    return maps.select("id", jsonconfig.dependency_similarity(F.col("a"), F.col("b")).alias("similarity"))


_PACKAGES = """(VALUES (1, '{"dependencies":{"a":"1.0.0"}}', '{"dependencies":{"a":"1.0.0"}}'), (2, '{}', '{}'), (3, 'not json', '{"x":1}'),
  (4, '{"name":"p","keywords":["a","b"],"scripts":{"dev":"x","t":"jest"}}', '{"name":"p","keywords":["b","c"],"scripts":{"dev":"y","t":"jest"}}'),
  (5, '{"devDependencies":{"a":"1.0.0"},"eslintConfig":{"r":1}}', '{"devDependencies":{"b":"1.0.0"},"eslintConfig":{"r":2,"s":1}}'),
  (6, '{"dependencies":{"a":"1.2.3","react":"18"},"peerDependencies":{"p":"1"}}', '{"dependencies":{"a":"1.2.4","b":"2","react":"18"}}')) AS t(id, a, b)"""


def _jaccard_sql(x: str, y: str) -> str:
    return f"(CASE WHEN len({x}) + len({y}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct({x} || {y})) END)"


#: Command texts that differ are left null here: the fixture has none.
@query(f"""WITH f AS (SELECT id, CASE WHEN json_valid(a) THEN a ELSE '{{}}' END AS a, CASE WHEN json_valid(b) THEN b ELSE '{{}}' END AS b FROM {_PACKAGES}),
k AS (SELECT id, a, b, k, coalesce(json_keys(a, '$.' || k), []) AS x, coalesce(json_keys(b, '$.' || k), []) AS y FROM f, unnest(['dependencies', 'devDependencies', 'peerDependencies', 'scripts']) AS u(k)
  WHERE json_exists(a, '$.' || k) OR json_exists(b, '$.' || k)),
own AS (SELECT *, list_filter(x, lambda n: n NOT IN ('react', 'react-dom', 'next', 'dev', 'build', 'start', 'lint')) AS p, list_filter(y, lambda n: n NOT IN ('react', 'react-dom', 'next', 'dev', 'build', 'start', 'lint')) AS q FROM k),
e AS (SELECT id, k, n, a ->> ('$.' || k || '.' || n) AS v, b ->> ('$.' || k || '.' || n) AS w FROM own, unnest(list_intersect(CASE WHEN k = 'scripts' THEN p ELSE x END, CASE WHEN k = 'scripts' THEN q ELSE y END)) AS u(n)),
m AS (SELECT id, k, avg(CASE WHEN k <> 'scripts' THEN {_version_sql('v', 'w')} WHEN v = w THEN 1.0::DOUBLE END) AS inner_score FROM e GROUP BY id, k),
sections AS (
  SELECT id, k, CASE WHEN inner_score IS NULL THEN {_jaccard_sql('p', 'q')} WHEN k = 'scripts' THEN 0.6::DOUBLE * {_jaccard_sql('p', 'q')} + 0.4::DOUBLE * inner_score
    ELSE 0.3::DOUBLE * {_jaccard_sql('p', 'q')} + 0.7::DOUBLE * inner_score END AS s FROM own LEFT JOIN m USING (id, k)
  UNION ALL SELECT id, 'meta', avg(CASE WHEN json_type(a, '$.' || n) = 'ARRAY' AND json_type(b, '$.' || n) = 'ARRAY' THEN {_jaccard_sql("CAST(json_extract(a, '$.' || n) AS VARCHAR[])", "CAST(json_extract(b, '$.' || n) AS VARCHAR[])")}
    WHEN lower(trim(a ->> n)) = lower(trim(b ->> n)) AND trim(a ->> n) <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    FROM f, unnest(['name', 'version', 'description', 'keywords', 'author']) AS u(n) GROUP BY id HAVING bool_or(json_exists(a, '$.' || n) OR json_exists(b, '$.' || n))
  UNION ALL SELECT id, 'config', coalesce(avg({_jaccard_sql("json_keys(a, '$.' || n)", "json_keys(b, '$.' || n)")}) FILTER (json_exists(a, '$.' || n) AND json_exists(b, '$.' || n)), 1.0)
    FROM f, unnest(list_distinct(json_keys(a) || json_keys(b))) AS u(n) WHERE n LIKE '%Config' OR n IN ('browserslist', 'jest') GROUP BY id),
w(k, w) AS (VALUES ('dependencies', 0.5::DOUBLE), ('devDependencies', 0.2), ('peerDependencies', 0.05), ('scripts', 0.05), ('meta', 0.05), ('config', 0.05)),
weights AS (SELECT f.id, w.k, s, CASE WHEN w.k <> 'dependencies' THEN w.w ELSE w.w + (SELECT coalesce(sum(v.w), 0) FROM w v WHERE v.k <> 'dependencies' AND v.k NOT IN (SELECT z.k FROM sections z WHERE z.id = f.id)) END AS w
  FROM f CROSS JOIN w LEFT JOIN sections ON sections.id = f.id AND sections.k = w.k)
SELECT id, round(sum(s * w) / nullif(sum(w) FILTER (s IS NOT NULL), 0), 9) AS package_similarity FROM weights GROUP BY id""")
def package_score(spark, sf_dir):
    rows = fixture(spark, _PACKAGES)
    return jsonconfig.package_similarity(rows, "id", "a", "b").select("id", F.round("package_similarity", 9).alias("package_similarity"))


_TSCONFIGS = """(VALUES (1, '{"compilerOptions":{"strict":true,"target":"ES6"}}', '{"compilerOptions":{"strict":true,"target":"es6","jsx":"preserve"}}'), (2, '{}', '{}'),
  (3, '{"compilerOptions":{"paths":{"a":"x","b":"y"},"e":{}}}', '{"compilerOptions":{"paths":{"a":"x","b":"z"}}}'), (4, '{"compilerOptions":{"a":1}}', '{}')) AS t(id, a, b)"""


@query(f"""WITH l AS (SELECT id, side, fullkey, lower(trim(atom ->> '$')) AS v FROM (SELECT id, side, unnest(j) AS r FROM (
    SELECT id, side, (SELECT list({{'k': fullkey, 'a': atom}}) FROM json_tree(j, '$.compilerOptions') WHERE atom IS NOT NULL) AS j
    FROM (SELECT id, 0 AS side, a AS j FROM {_TSCONFIGS} UNION ALL SELECT id, 1, b FROM {_TSCONFIGS}))), LATERAL (SELECT r.k AS fullkey, r.a AS atom)),
m AS (SELECT coalesce(x.id, y.id) AS id, x.v AS a, y.v AS b FROM (SELECT * FROM l WHERE side = 0) x FULL JOIN (SELECT * FROM l WHERE side = 1) y ON x.id = y.id AND x.fullkey = y.fullkey)
SELECT t.id, coalesce(s, 1.0) AS tsconfig_similarity FROM {_TSCONFIGS} LEFT JOIN (SELECT id, CAST(count(*) FILTER (a = b) AS DOUBLE) / count(*) AS s FROM m GROUP BY id) q ON q.id = t.id""")
def tsconfig_score(spark, sf_dir):
    return jsonconfig.tsconfig_similarity(fixture(spark, _TSCONFIGS), "id", "a", "b")


@query("""WITH e AS (SELECT event_id, json_keys(props) AS k FROM events)
SELECT a.event_id, CASE WHEN len(list_distinct(a.k || b.k)) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(a.k, b.k)) AS DOUBLE) / len(list_distinct(a.k || b.k)) END AS similarity
FROM e a JOIN e b ON b.event_id = a.event_id + 1""")
def json_key_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.map_keys(jsonconfig.object_map(F.col("props"))).alias("k"))
    return rows.join(rows.select((F.col("event_id") - 1).alias("event_id"), F.col("k").alias("k2")), "event_id").select("event_id", jaccard(F.col("k"), F.col("k2")).alias("similarity"))


_SCRIPTS = """(VALUES (1, 'dev'), (1, 'test'), (2, 'lint'), (3, 'build'), (3, 'deploy')) AS t(id, name)"""


@query(f"SELECT id, name FROM {_SCRIPTS} WHERE name NOT IN ('dev', 'build', 'start', 'lint')")
def script_keys(spark, sf_dir):
    maps = fixture(spark, _SCRIPTS).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.lit("x")))).alias("m"))
    return maps.select("id", F.explode(F.map_keys(jsonconfig.own_scripts(F.col("m")))).alias("name"))


_META = """(VALUES (1, '{"name":"p","version":"1","author":" Me "}', '{"name":"P","version":"2","author":"me"}'), (2, '{}', '{}'), (3, '{"description":""}', '{"description":""}')) AS t(id, a, b)"""


@query(f"""SELECT id, CAST((SELECT count(*) FROM unnest(['name', 'version', 'description', 'keywords', 'author']) AS u(k)
  WHERE lower(trim(a ->> k)) = lower(trim(b ->> k)) AND trim(a ->> k) <> '') AS DOUBLE) / 5 AS similarity FROM {_META}""")
def metadata_score(spark, sf_dir):
    rows = fixture(spark, _META).select("id", jsonconfig.object_map(F.col("a")).alias("a"), jsonconfig.object_map(F.col("b")).alias("b"))
    return rows.select("id", jsonconfig.metadata_similarity(F.col("a"), F.col("b")).alias("similarity"))


# Pairs of theme configurations whose comparison is known.
_THEMES = """(VALUES (1, '{"theme":{"extend":{"colors":{"primary":1},"spacing":{"72":1},"fontSize":{"xxl":1}}}}', '{"theme":{"extend":{"colors":{"primary":1,"secondary":2},"fontSize":{"xxl":1},"borderRadius":{"xl":1}}}}'),
  (2, '{"theme":{"extend":{"colors":{},"spacing":{}}}}', '{"theme":{"extend":{"colors":{},"spacing":{}}}}'), (3, '{"theme":{"extend":{"colors":{}}}}', '{"theme":{"extend":{"spacing":{}}}}'),
  (4, '{"theme":{"extend":{"colors":{},"spacing":{},"fontSize":{}}}}', '{"theme":{"extend":{"colors":{}}}}'), (5, '{}', '{}'), (6, '{"theme":{"colors":{"a":1},"extend":{"colors":{"b":1}}}}', '{"theme":{"colors":{"a":2,"b":3}}}')) AS t(id, a, b)"""


@query(f"""WITH k AS (SELECT id, side, key, (SELECT list_distinct(coalesce(json_keys(j, '$.theme.' || key), []) || coalesce(json_keys(j, '$.theme.extend.' || key), []))) AS subs
  FROM (SELECT id, 0 AS side, a AS j FROM {_THEMES} UNION ALL SELECT id, 1, b FROM {_THEMES}), unnest(['colors', 'spacing', 'fontSize', 'borderRadius', 'boxShadow', 'fontFamily', 'screens']) AS u(key)
  WHERE json_exists(j, '$.theme.' || key) OR json_exists(j, '$.theme.extend.' || key)),
m AS (SELECT coalesce(x.id, y.id) AS id, x.key IS NOT NULL AND y.key IS NOT NULL AS in_both,
  CASE WHEN len(list_distinct(x.subs || y.subs)) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(x.subs, y.subs)) AS DOUBLE) / len(list_distinct(x.subs || y.subs)) END AS s
  FROM (SELECT * FROM k WHERE side = 0) x FULL JOIN (SELECT * FROM k WHERE side = 1) y ON x.id = y.id AND x.key = y.key),
g AS (SELECT id, CAST(count(*) FILTER (in_both) AS DOUBLE) / count(*) AS keys, coalesce(sum(s) FILTER (in_both), 0) AS total, count(*) FILTER (in_both) AS n FROM m GROUP BY id)
SELECT t.id, coalesce((keys + total) / (n + 1), 1.0) AS similarity FROM {_THEMES} LEFT JOIN g ON g.id = t.id""")
def config_extension_similarity(spark, sf_dir):
    return fixture(spark, _THEMES).select("id", classes.config_similarity(F.col("a"), F.col("b")).alias("similarity"))


# --- CSS ---------------------------------------------------------------------------------

_CSS_VALUES = """(VALUES (1, ' #FFF; '), (2, '10px'), (3, '0'), (4, '0px'), (5, '1.50px'), (6, '1rem'), (7, 'RED'), (8, '1px 2px'), (9, '.5px'), (10, '#abcd'), (11, '10.0px'), (12, '2.00'), (13, '+5px'), (14, '-0.250EM'), (15, '.5'), (16, '-3.0%'), (17, '1.5.2px')) AS t(id, v)"""


@query(f"""WITH a AS (SELECT id, regexp_replace(lower(trim(v)), ';+$', '') AS v, replace(lower(trim(v)), ' ', '') AS c FROM {_CSS_VALUES})
SELECT id, CASE WHEN regexp_matches(v, '^#[0-9a-f]{{3}}$') THEN regexp_replace(v, '([0-9a-f])', '\\1\\1', 'g') WHEN regexp_matches(v, '^[0-9]*\\.?[0-9]+px$') THEN CAST(CAST(replace(v, 'px', '') AS DOUBLE) AS VARCHAR) ELSE v END AS value,
  CASE WHEN regexp_matches(c, '^#([0-9a-f]{{3}}|[0-9a-f]{{4}})$') THEN regexp_replace(c, '([0-9a-f])', '\\1\\1', 'g') WHEN n IS NULL THEN c
    WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) || unit ELSE CAST(n AS VARCHAR) || unit END AS keyframe_value
FROM (SELECT *, TRY_CAST(regexp_replace(c, '[a-z%]*$', '') AS DOUBLE) AS n, regexp_extract(c, '[a-z%]*$') AS unit FROM a)""")
def css_value_normalize(spark, sf_dir):
    v = F.col("v")
    return fixture(spark, _CSS_VALUES).select("id", css_functions.normalize_value(v).alias("value"), css_functions.normalize_keyframe_value(v).alias("keyframe_value"))


_SELECTORS = """(VALUES ('#a .b'), ('ul li'), ('a:hover'), ('p::before'), ('.x.y[href]'), ('div > span'), ('*'), ('#i#j')) AS t(s)"""


@query(f"""SELECT s, CAST(100 * len(regexp_extract_all(s, '#[\\w-]+')) + 10 * (len(regexp_extract_all(s, '\\.[\\w-]+')) + len(regexp_extract_all(s, '\\[[^\\]]+\\]')) + len(regexp_extract_all(s, ':[\\w-]+')))
  + len(regexp_extract_all(s, '(?:^|[\\s>+~])[A-Za-z][\\w-]*')) + len(regexp_extract_all(s, '::[\\w-]+')) AS INTEGER) AS specificity FROM {_SELECTORS}""")
def css_specificity(spark, sf_dir):
    return fixture(spark, _SELECTORS).select("s", css_functions.specificity(F.col("s")).alias("specificity"))


# Pairs of stylesheets whose comparison is known.
_SHEETS = """(VALUES (1, '.foo { color: #fff; }', '.foo { color: #ffffff; }'), (2, '.foo { color: #fff; } .bar { margin: 0; }', '.foo { color: #fff; }'),
  (3, '.foo { color: #fff; }', '.foo { color: #fff; } .bar { margin: 0; }'), (4, '.foo { color: #fff; margin: 0; }', '.foo { color: #fff; padding: 1rem; }'),
  (5, '', '.foo { }'), (6, '@media (min-width: 600px) { .foo { color: red; } }', '@media (min-width: 600px) { .foo { color: red; } }'),
  (7, '.foo { color: #fff; } /* c */', '.foo{color:#fff;}'), (8, '.a {x:1;} .b {y:2;}', '.b {y:2;} .a {x:1;}'),
  (9, '.foo { color: #fff; } .foo { margin: 0; }', '.foo { color: #fff; margin: 0; }'), (10, '@import url(a.css); .foo { color: #fff; }', '.foo { color: #fff; }'),
  (11, ':root { --c: red } .a { color: var(--c) }', ':root { --c: red } .a { color: red }')) AS t(id, a, b)"""


_SHEETS_SQL = f"""t AS (SELECT id, side, regexp_replace(regexp_replace(regexp_replace(css, '/[*].*?[*]/', '', 'g'), '@media[^{{]*[{{]([^{{}}]*[{{][^{{}}]*[}}])*\\s*[}}]', '', 'g'), '@import[^;]*;', '', 'g') AS css
  FROM (SELECT id, 0 AS side, a AS css FROM {_SHEETS} UNION ALL SELECT id, 1, b FROM {_SHEETS})),
r AS (SELECT id, side, lower(trim(split_part(x, '{{', 1))) AS sel, split_part(rtrim(x, '}}'), '{{', 2) AS body FROM (SELECT id, side, unnest(regexp_extract_all(css, '[^{{}}]+[{{][^{{}}]*[}}]')) AS x FROM t)),
d AS (SELECT id, side, sel, trim(split_part(p, ':', 1)) AS prop, trim(split_part(p, ':', 2)) AS v FROM (SELECT id, side, sel, unnest(string_split(body, ';')) AS p FROM r) WHERE trim(p) <> ''),
e AS (SELECT d.id, d.side, d.sel, d.prop, coalesce(root.v, d.v) AS v FROM d LEFT JOIN d root ON root.id = d.id AND root.side = d.side AND root.sel = ':root' AND d.v = 'var(' || root.prop || ')'),
n AS (SELECT id, side, sel, prop, CASE WHEN regexp_matches(v, '^#[0-9a-f]{{3}}$') THEN regexp_replace(v, '([0-9a-f])', '\\1\\1', 'g') ELSE v END AS v FROM e)"""


@query(f"""WITH {_SHEETS_SQL},
m AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.sel, y.sel) AS sel, count(x.v) AS l, count(y.v) AS r, CAST(count(*) FILTER (x.v = y.v) AS DOUBLE) / count(*) AS s
  FROM (SELECT * FROM n WHERE side = 0) x FULL JOIN (SELECT * FROM n WHERE side = 1) y ON x.id = y.id AND x.sel = y.sel AND x.prop = y.prop GROUP BY 1, 2),
c AS (SELECT id, sum(CASE WHEN l = 0 OR r = 0 OR s < 0.3 THEN 0.0::DOUBLE WHEN s >= 0.9 THEN 1.0 ELSE s END) / count(*) AS similarity, count(*) FILTER (l > 0 AND r > 0 AND s >= 0.9) AS matching,
  count(*) FILTER (l > 0 AND r > 0 AND s < 0.9) AS different, count(*) FILTER (r = 0) AS missing, count(*) FILTER (l = 0) AS extra FROM m GROUP BY id)
SELECT t.id, round(coalesce(similarity, 1.0), 9) AS css_similarity, coalesce(matching, 0) AS matching, coalesce(different, 0) AS different, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra
FROM {_SHEETS} LEFT JOIN c ON c.id = t.id""")
def css_rule_diff(spark, sf_dir):
    rows = fixture(spark, _SHEETS).select("id", "a", "b")
    return css.compare_stylesheets(rows, "id", "a", "b").withColumn("css_similarity", F.round("css_similarity", 9))


@query(f"""WITH {_SHEETS_SQL},
m AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.sel, y.sel) AS selector, coalesce(x.prop, y.prop) AS prop, x.v AS a, y.v AS b
  FROM (SELECT * FROM n WHERE side = 0) x FULL JOIN (SELECT * FROM n WHERE side = 1) y ON x.id = y.id AND x.sel = y.sel AND x.prop = y.prop)
SELECT id, selector, coalesce(string_agg(prop, ',' ORDER BY prop) FILTER (a = b), '') AS matching_props, coalesce(string_agg(prop, ',' ORDER BY prop) FILTER (a <> b), '') AS different_props,
  coalesce(string_agg(prop, ',' ORDER BY prop) FILTER (b IS NULL), '') AS missing_props, coalesce(string_agg(prop, ',' ORDER BY prop) FILTER (a IS NULL), '') AS extra_props
FROM m GROUP BY id, selector HAVING count(a) > 0 AND count(b) > 0""")
def css_selector_details(spark, sf_dir):
    rows = fixture(spark, _SHEETS)
    sides = [css.declaration_table(rows.select("id", F.col(c).alias("content")), "id") for c in ("a", "b")]
    found = css.selector_details(*sides, ["id"])
    return found.select("id", F.col("sel").alias("selector"), *(F.array_join(c, ",").alias(c) for c in ("matching_props", "different_props", "missing_props", "extra_props")))


_CONDITIONS = """(VALUES (1, '@media (a) { .x { p: q } .y { r: s } } @media (b) { .x { p: q } }', '@media (a) { .x { p: q } .z { r: s } } @media (c) { .x { p: q } }'),
  (2, '@supports (d: e) { .x { p: q } } .x { p: q }', '@supports (d: e) { .x { p: t } } @media (a) { .x { p: q } }')) AS t(id, a, b)"""


@query(f"""WITH c AS (SELECT id, side, unnest(regexp_extract_all(css, '@(?:media|supports)[^{{]*[{{](?:[^{{}}]*[{{][^{{}}]*[}}])*\\s*[}}]')) AS x FROM (SELECT id, 0 AS side, a AS css FROM {_CONDITIONS} UNION ALL SELECT id, 1, b FROM {_CONDITIONS})),
k AS (SELECT id, side, regexp_extract(x, '@(\\w+)', 1) AS scope, trim(regexp_extract(x, '@\\w+\\s*([^{{]*)', 1)) AS condition, regexp_extract_all(substr(x, strpos(x, '{{') + 1), '([^{{}}]+)[{{]', 1) AS sels FROM c),
r AS (SELECT id, side, scope, condition, list_transform(sels, lambda v: trim(v)) AS sels FROM k)
SELECT coalesce(x.id, y.id) AS id, coalesce(x.scope, y.scope) AS scope, coalesce(x.condition, y.condition) AS condition,
  CASE WHEN y.id IS NULL THEN 'missing' WHEN x.id IS NULL THEN 'extra' ELSE 'matching' END AS state,
  CAST(len(list_distinct(coalesce(x.sels, []) || coalesce(y.sels, []))) AS BIGINT) AS total,
  CAST(len(list_filter(coalesce(x.sels, []), lambda v: NOT list_contains(coalesce(y.sels, []), v))) AS BIGINT) AS missing,
  CAST(len(list_filter(coalesce(y.sels, []), lambda v: NOT list_contains(coalesce(x.sels, []), v))) AS BIGINT) AS extra
FROM (SELECT * FROM r WHERE side = 0) x FULL JOIN (SELECT * FROM r WHERE side = 1) y ON x.id = y.id AND x.scope = y.scope AND x.condition = y.condition""")
def css_conditions(spark, sf_dir):
    rows = fixture(spark, _CONDITIONS)
    sides = [css.declaration_table(rows.select("id", F.col(c).alias("content")), "id") for c in ("a", "b")]
    kinds = [css.condition_diff(*sides, ["id"], scope).withColumn("scope", F.lit(scope)) for scope in ("media", "supports")]
    return kinds[0].unionByName(kinds[1]).select("id", "scope", F.col("scope_key").alias("condition"), "state", "total", "missing", "extra")


_KEYFRAMES = """(VALUES (1, '@keyframes k { from { left: 0 } to { left: 10.0px } }', '@keyframes k { from { left: 0 } to { left: 10px } }'),
  (2, '@keyframes k { from { left: 0 } } @keyframes z { to { a: b } }', '@keyframes k { from { left: 1px } } @keyframes y { to { a: b } }')) AS t(id, a, b)"""


@query(f"""WITH f AS (SELECT id, side, regexp_extract(x, '@keyframes\\s+([^\\s{{]+)', 1) AS name, regexp_extract_all(substr(x, strpos(x, '{{') + 1), '[^{{}}]+[{{][^{{}}]*[}}]') AS steps
  FROM (SELECT id, side, unnest(regexp_extract_all(css, '@keyframes[^{{]*[{{](?:[^{{}}]*[{{][^{{}}]*[}}])*\\s*[}}]')) AS x
    FROM (SELECT id, 0 AS side, a AS css FROM {_KEYFRAMES} UNION ALL SELECT id, 1, b FROM {_KEYFRAMES}))),
p AS (SELECT id, side, name, trim(split_part(s, '{{', 1)) AS step, trim(split_part(split_part(rtrim(s, '}} '), '{{', 2), ':', 1)) AS prop,
    trim(split_part(split_part(rtrim(s, '}} '), '{{', 2), ':', 2)) AS v FROM (SELECT id, side, name, unnest(steps) AS s FROM f)),
v AS (SELECT *, coalesce(CAST(TRY_CAST(regexp_replace(v, '[a-z%]+$', '') AS DOUBLE) AS VARCHAR) || regexp_extract(v, '[a-z%]*$'), v) AS value FROM p),
m AS (SELECT coalesce(x.id, y.id) AS id, coalesce(x.name, y.name) AS name, bool_or(x.id IS NOT NULL) AS l, bool_or(y.id IS NOT NULL) AS r, bool_or(x.value IS DISTINCT FROM y.value) AS differs
  FROM (SELECT * FROM v WHERE side = 0) x FULL JOIN (SELECT * FROM v WHERE side = 1) y ON x.id = y.id AND x.name = y.name AND x.step = y.step AND x.prop = y.prop GROUP BY 1, 2)
SELECT id, count(*) FILTER (l AND r) AS matching_keyframes, count(*) FILTER (l AND r AND differs) AS different_keyframes, count(*) FILTER (NOT r) AS missing_keyframes,
  count(*) FILTER (NOT l) AS extra_keyframes FROM m GROUP BY id""")
def css_keyframes_diff(spark, sf_dir):
    rows = fixture(spark, _KEYFRAMES)
    sides = [css.declaration_table(rows.select("id", F.col(c).alias("content")), "id") for c in ("a", "b")]
    return css.keyframes_diff(*sides, ["id"])


@query("""WITH r AS (SELECT page_id, unnest(regexp_extract_all(css, '[^{}]+[{][^{}]*[}]')) AS x FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1)) AS css FROM pages)),
d AS (SELECT page_id, trim(split_part(x, '{', 1)) AS selector, unnest(string_split(split_part(rtrim(x, '}'), '{', 2), ';')) AS p FROM r)
SELECT DISTINCT page_id, 'rule' AS scope, selector, trim(split_part(p, ':', 1)) AS prop, trim(split_part(p, ':', 2)) AS value, p LIKE '%!important%' AS important FROM d WHERE p LIKE '%:%'""")
def css_parse(spark, sf_dir):
    sheets = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<style[^>]*>(.*?)</style>"), F.lit(1))).alias("content"))
    return css.declaration_table(sheets, "page_id").select("page_id", "scope", "selector", "prop", "value", "important")


# --- trees and scripts ----------------------------------------------------------------------

@query("""WITH b AS (SELECT page_id, regexp_replace(substr(html, strpos(html, '<body')), '(?s)<!--.*?-->|<script.*?</script>', '', 'g') AS html FROM pages WHERE html IS NOT NULL),
t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM b)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag""")
def html_tree_nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.explode(html_nodes("html")).alias("n"))
    return rows.where("n.kind = 'element'").groupBy("page_id", F.col("n.tag").alias("tag")).agg(F.count("*").alias("n"))


@query()
def html_tree_compare(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    pairs = pages.join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("html2")), "page_id")
    return report.tree_scores(report.tree_comparison(pairs, "page_id", "html", "html2"), "page_id")


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS code FROM pages),
p AS (SELECT page_id, len(regexp_extract_all(code, '"[^"]*"')) AS strings, regexp_replace(code, '"[^"]*"', '""', 'g') AS code FROM c),
n AS (SELECT page_id, strings, regexp_extract_all(code, '[A-Za-z_$][A-Za-z_$0-9]*') AS names, len(regexp_extract_all(code, '\\b[0-9]+')) AS numbers, len(regexp_extract_all(code, '[A-Za-z_$][A-Za-z_$0-9]*[(]')) AS calls FROM p)
SELECT page_id, CAST(1 + strings + numbers + calls + len(names) AS INTEGER) AS nodes, CAST(len(list_filter(names, lambda x: x = 'function')) AS INTEGER) AS functions, CAST(NULL AS VARCHAR) AS error FROM n""")
def page_scripts(spark, sf_dir):
    code = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("c"))
    return code.select("page_id", js_outline("c").alias("o")).select("page_id", F.size("o.nodes").alias("nodes"), F.size("o.functions").alias("functions"), "o.error")


@query()
def text_similarity(spark, sf_dir):
    """Pairs of benchmark texts with a ratio of 0.4 or more, each text against all others within the reach of its length."""
    items = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("pair_id"), F.lit("text").alias("file_type"), "item_id", "text")
    near = (F.col("l.item_id") < F.col("r.item_id")) & ratio_possible(F.col("l.text"), F.col("r.text"), 0.4)
    pairs = matching.blocked_pairs(items, items, near, "text", 0.4).select("l.item_id", F.col("r.item_id").alias("other_id"), F.col("l.text").alias("x"), F.col("r.text").alias("y"))
    parts = 2 * spark.sparkContext.defaultParallelism
    return pairs.repartition(parts, "item_id", "other_id").select("item_id", "other_id", ratio_udf("x", "y").alias("score")).where("score >= 0.4")


_NAMES = """(VALUES (1, 'f,g', 'f,h', 2, 1, 'if,for', 'if,if'), (2, '', '', 0, 0, '', ''), (3, 'f', '', 1, 0, 'while', ''), (4, 'a,b,c', 'c,b,a', 3, 3, 'if,for,while', 'for')) AS t(id, l, r, c1, c2, k1, k2)"""


def _lists(spark):
    split = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ",")).alias(c)
    return fixture(spark, _NAMES).select("id", split("l"), split("r"), "c1", "c2", split("k1"), split("k2"))


_LISTS_SQL = f"""n AS (SELECT id, c1, c2, list_filter(string_split(l, ','), lambda x: x <> '') AS l, list_filter(string_split(r, ','), lambda x: x <> '') AS r,
  list_filter(string_split(k1, ','), lambda x: x <> '') AS k1, list_filter(string_split(k2, ','), lambda x: x <> '') AS k2 FROM {_NAMES})"""


@query(f"""WITH {_LISTS_SQL} SELECT id, CAST(CASE WHEN len(l) = 0 AND len(r) = 0 THEN 1.0 WHEN len(l) = 0 OR len(r) = 0 THEN 0.0
  ELSE (SELECT sum(CASE WHEN list_contains(r, x) THEN 1.0 ELSE 0.7 END) FROM unnest(l) AS u(x)) / greatest(len(l), len(r)) END AS DOUBLE) AS similarity FROM n""")
def function_best_match(spark, sf_dir):
    return _lists(spark).select("id", jslogic.function_similarity(F.col("l"), F.col("r")).alias("similarity"))


@query(f"""WITH {_LISTS_SQL} SELECT id, CAST(CASE WHEN len(k1) = 0 AND len(k2) = 0 THEN 1.0 WHEN len(k1) = 0 OR len(k2) = 0 THEN 0.0
  ELSE CAST(len(list_filter(k1, lambda x: list_contains(k2, x))) AS DOUBLE) / greatest(len(k1), len(k2)) END AS DOUBLE) AS similarity FROM n""")
def control_flow_similarity(spark, sf_dir):
    return _lists(spark).select("id", jslogic.control_flow_similarity(F.col("k1"), F.col("k2")).alias("similarity"))


@query(f"SELECT id, CAST(CASE WHEN c1 = 0 AND c2 = 0 THEN 1.0 WHEN c1 = 0 OR c2 = 0 THEN 0.0 ELSE CAST(c1 AS DOUBLE) / greatest(c1, c2) END AS DOUBLE) AS similarity FROM {_NAMES}")
def class_similarity(spark, sf_dir):
    return _lists(spark).select("id", jslogic.class_similarity(F.col("c1"), F.col("c2")).alias("similarity"))


_CODE = """(VALUES (1, 'function f(a) { g(1); } function h(b) { if (b) k(2); } class A { }', 'function f(a) { g(1); } function m(b) { while (b) k(2); } class B { }'),
  (2, '', ''), (3, 'function f() { }', ''), (4, 'for (;;) { } function p() { q(); r(); }', 'function p() { q(); s(); } if (1) { } for (;;) { } class C { } class D { }'),
  (5, '', 'function z() { y(); } function x() { }')) AS t(id, a, b)"""
_CODE_SQL = f"""c AS (SELECT id, a, b FROM {_CODE}), p AS (SELECT id, {', '.join(f'''
  regexp_extract_all({x}, 'function\\s+(\\w+)\\s*[(]', 1) AS {x}_names, len(regexp_extract_all({x}, 'class\\s+\\w+')) AS {x}_classes, regexp_extract_all({x}, '\\b(if|for|while)\\s*[(]', 1) AS {x}_flow,
  list_distinct(flatten(list_transform(regexp_extract_all({x}, 'function\\s+\\w+\\s*[(][^)]*[)]\\s*[{{{{][^}}}}]*[}}}}]'), lambda f: list_transform(list_filter(regexp_extract_all(substr(f, strpos(f, '{{')), '(\\w+)[(]', 1),
    lambda n: n NOT IN ('if', 'for', 'while')), lambda n: regexp_extract(f, 'function\\s+(\\w+)', 1) || '>' || n)))) AS {x}_edges''' for x in 'ab')} FROM c),
s AS (SELECT *, CASE WHEN len(a_names) = 0 AND len(b_names) = 0 THEN 1.0::DOUBLE WHEN len(a_names) = 0 OR len(b_names) = 0 THEN 0.0::DOUBLE
    ELSE list_sum(list_transform(a_names, lambda n: CASE WHEN list_contains(b_names, n) THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)) / greatest(len(a_names), len(b_names)) END AS functions,
  CASE WHEN a_classes = 0 AND b_classes = 0 THEN 1.0::DOUBLE WHEN a_classes = 0 OR b_classes = 0 THEN 0.0::DOUBLE ELSE a_classes::DOUBLE / greatest(a_classes, b_classes) END AS classes,
  CASE WHEN len(a_flow) = 0 AND len(b_flow) = 0 THEN 1.0::DOUBLE WHEN len(a_flow) = 0 OR len(b_flow) = 0 THEN 0.0::DOUBLE
    ELSE len(list_filter(a_flow, lambda n: list_contains(b_flow, n)))::DOUBLE / greatest(len(a_flow), len(b_flow)) END AS control_flow,
  CASE WHEN len(a_edges) = 0 AND len(b_edges) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a_edges, b_edges))::DOUBLE / len(list_distinct(a_edges || b_edges)) END AS calls,
  len(list_filter(a_names, lambda n: list_contains(b_names, n))) AS hits,
  len(list_distinct(list_transform(a_names, lambda n: CASE WHEN list_contains(b_names, n) THEN list_position(b_names, n) ELSE 1 END))) AS picked FROM p),
n AS (SELECT *, CASE WHEN len(b_names) > 0 THEN hits ELSE 0 END AS matching, CASE WHEN len(b_names) > 0 THEN len(a_names) - hits ELSE 0 END AS different,
  CASE WHEN len(b_names) > 0 THEN 0 ELSE len(a_names) END AS missing, CASE WHEN len(b_names) > 0 THEN len(b_names) - picked ELSE 0 END AS extra FROM s)"""


def _scripts(spark):
    return jslogic.compare_scripts(fixture(spark, _CODE).withColumn("file_type", F.lit("js")), "id", "a", "b", as_coded=True)


@query(f"""WITH {_CODE_SQL} SELECT id, round(functions, 9) AS functions, round(classes, 9) AS classes, round(control_flow, 9) AS control_flow, round(calls, 9) AS calls,
  round(0.35::DOUBLE * functions + 0.15::DOUBLE + 0.15::DOUBLE * classes + 0.15::DOUBLE * control_flow + 0.2::DOUBLE * calls, 9) AS similarity,
  CAST(matching AS INTEGER) AS matching, CAST(different AS INTEGER) AS different, CAST(missing AS INTEGER) AS missing, CAST(extra AS INTEGER) AS extra FROM n""")
def script_scores(spark, sf_dir):
    return _scripts(spark).select("id", *(F.round(c, 9).alias(c) for c in ("functions", "classes", "control_flow", "calls", "similarity")), "counts.*")


@query(f"""WITH {_CODE_SQL} SELECT id % 2 AS part, CAST(sum(matching) AS BIGINT) AS matching, CAST(sum(different) AS BIGINT) AS different, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(extra) AS BIGINT) AS extra,
  CAST(sum(matching + different + missing + extra) AS BIGINT) AS total, round(avg(functions), 9) AS functions, round(avg(classes), 9) AS classes, round(avg(control_flow), 9) AS control_flow, round(avg(calls), 9) AS calls
FROM n GROUP BY 1""")
def script_totals(spark, sf_dir):
    rows = _scripts(spark).select((F.col("id") % 2).alias("part"), "functions", "classes", "control_flow", "calls", "counts.*")
    means = scores.metric_means(rows, ["part"], ("functions", "classes", "control_flow", "calls"))
    means = means.select("part", *(F.round(c, 9).alias(c) for c in means.columns if c != "part"))
    return scores.column_totals(rows, ["part"]).join(means, "part")


_PARTS = """(VALUES (1, 1.0, 1.0, 1.0, 1.0, 1.0), (2, 0.5, 0.25, 0.0, 1.0, 0.75), (3, 0.0, 0.0, 0.0, 0.0, 0.0)) AS t(id, f, i, c, k, g)"""


@query(f"SELECT id, round(CAST(0.35 * f + 0.15 * i + 0.15 * c + 0.15 * k + 0.20 * g AS DOUBLE), 9) AS js_score, round(CAST(0.6 * f + 0.2 * g + 0.2 * i AS DOUBLE), 9) AS jsx_score FROM {_PARTS}")
def js_file_score(spark, sf_dir):
    d = lambda c: F.col(c).cast("double")
    js = jslogic.weighted(dict(zip(jslogic.WEIGHTS, map(d, "fickg"))))
    jsx = jslogic.weighted({"structure": d("f"), "calls": d("g"), "bodies": d("i")}, jslogic.JSX_WEIGHTS)
    return fixture(spark, _PARTS).select("id", F.round(js, 9).alias("js_score"), F.round(jsx, 9).alias("jsx_score"))


_SCORES = """(VALUES (1, 1.0, 0.5, 0.0), (2, 0.0, 0.0, 0.0), (3, 0.8, 0.6, 0.4), (4, CAST(NULL AS DOUBLE), 0.75, CAST(NULL AS DOUBLE)), (5, 0.4, 0.4, 0.4)) AS t(id, html, jsx, js)"""


@query(f"""WITH s AS (SELECT id, CAST(html AS DOUBLE) AS h, CAST(jsx AS DOUBLE) AS x, CAST(js AS DOUBLE) AS j FROM {_SCORES}),
w AS (SELECT id, (CASE WHEN h > 0 THEN h * 0.3 ELSE 0 END + CASE WHEN x > 0 THEN x * 0.3 ELSE 0 END + CASE WHEN j > 0 THEN j * 0.4 ELSE 0 END) AS t,
  (CASE WHEN h > 0 THEN 0.3 ELSE 0 END + CASE WHEN x > 0 THEN 0.3 ELSE 0 END + CASE WHEN j > 0 THEN 0.4 ELSE 0 END) AS b,
  (SELECT avg(v) FROM unnest([h, x, j]) AS u(v) WHERE v > 0) AS m FROM s)
SELECT id, round(CASE WHEN b > 0 THEN t / b ELSE 0 END, 9) AS weighted, round(coalesce(m, 0), 9) AS plain, {_LEVEL_SQL.format('round(coalesce(m, 0), 9)')} AS level FROM w""")
def pair_overall_weighted(spark, sf_dir):
    parts = {n: F.col(n).cast("double") for n in ("html", "jsx", "js")}
    plain = F.round(scores.weighted_positive(parts), 9)
    return fixture(spark, _SCORES).select("id", F.round(scores.weighted_positive(parts, scores.FILE_WEIGHTS), 9).alias("weighted"), plain.alias("plain"), verdict_level(plain).alias("level"))


_PROJECT = """(VALUES ('o', 'index.html', '<body><div class="a b"><p>Hi</p></div></body>'), ('m', 'index.html', '<body><div class="a b"><p>Hi</p></div><p>new</p></body>'),
  ('o', 'css/main.css', '.a{color:#fff} .b{margin:0}'), ('m', 'css/mains.css', '.a{color:#ffffff}'), ('o', 'js/app.js', 'function f(a){ g(a); } function g(){}'),
  ('m', 'js/app.js', 'function f(b){ g(b); }'), ('o', 'ui/Button.jsx', 'function Button(){ return <p className="x y">a</p>; }'), ('m', 'ui/Buttons.jsx', 'function Button(){ return <p className="x z">a</p>; }'),
  ('o', 'old.css', '.q{a:b}'), ('o', 'package.json', '{"dependencies":{"a":"1.0.0"}}'), ('m', 'package.json', '{"dependencies":{"a":"1.0.1"}}')) AS t(project_id, path, content)"""


@query()
def project_comparison(spark, sf_dir):
    from ..sources.files import sides

    files = fixture(spark, _PROJECT)
    pairs = fixture(spark, "(VALUES (1, 'o', 'm')) AS t(pair_id, original_id, modified_id)")
    everything = tuple(files.where(F.col("project_id") == p).withColumn("pair_id", F.lit(1)) for p in ("o", "m"))
    return report.project_report(report.compare_projects(*sides(files, pairs), all_files=everything))
