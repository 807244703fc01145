"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, lattice, license_templates, licenses, mixing, quality, simhash, tokenfile, warc

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(rows.union(extra))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hit_spans")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), templates=license_templates.public_templates())


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_embeddings(table(spark, sf_dir, "embeddings"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.tokens_written_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_decontaminate, op3_warc, op4_token_counts, op5_quality, op6_simhash, op7_licenses, op8_lattice, op9_mix, op10_token_file)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|/TURN\]|NEXT\])"

_OP1 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, length(regexp_replace(role, '{_CONTROL}', '\1\2\\\3', 'g')) AS role_chars,
    length(regexp_replace(text, '{_CONTROL}', '\1\2\\\3', 'g')) AS chars,
    coalesce(role = lag(role) OVER w, false) AS goes_on
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars + CASE WHEN goes_on THEN 6 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 4 ELSE 20 + role_chars END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""

_OP2 = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM items, unnest(range(1, greatest(2, len(w) - 11))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
hits AS (
  SELECT d.doc_id, i, d.n, wins.item FROM (
    SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
    FROM words, sizes, unnest(range(1, greatest(1, len(w) - n + 2))) AS u(i)) d
  JOIN wins ON wins.win = d.win AND wins.n = d.n),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)"""

_OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, x in license_templates.public_templates().items() for v in x)
_OP7 = rf"""
WITH templates(license_id, text) AS (VALUES {_TEMPLATE_ROWS}),
wordings AS (SELECT *, row_number() OVER () AS n FROM templates),
t AS (SELECT DISTINCT n, license_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
      FROM (SELECT n, license_id, {_WORDS} AS w FROM wordings), unnest(range(1, greatest(1, len(w) - 3))) AS u(i)),
sizes AS (SELECT n, count(*) AS n_template FROM t GROUP BY n),
d AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
      FROM (SELECT doc_id, {_WORDS} AS w FROM documents), unnest(range(1, greatest(1, len(w) - 3))) AS u(i)),
counted AS (SELECT doc_id, license_id, n, count(*) AS n_matched FROM d JOIN t USING (s) GROUP BY doc_id, license_id, n)
SELECT doc_id, license_id, n_matched, n_template, CAST(n_matched AS DOUBLE) / n_template AS containment
FROM counted JOIN sizes USING (n) WHERE CAST(n_matched AS DOUBLE) / n_template >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, license_id ORDER BY n_matched DESC, n_template) = 1"""

_OP8 = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) x ON x.a = vec_id
  LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) y ON y.a = vec_id"""

_OP9 = r"""
WITH RECURSIVE texts AS (SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
counts AS (SELECT *, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS solid, length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS letters,
    length(t) - length(regexp_replace(t, '[#{}<>|]', '', 'g')) AS marks, list_filter(str_split(t, chr(10)), lambda x: x <> '') AS lines
  FROM texts),
docs AS (SELECT doc_id, source, size, -ln(u) / greatest(0.05::DOUBLE, (CAST(size BETWEEN 50 AND 100000 AS INT)
    + CAST(size > 0 AND solid BETWEEN 3 * size AND 10 * size AS INT) + CAST(solid > 0 AND 5 * letters >= 4 * solid AS INT)
    + CAST(size > 0 AND 10 * marks <= size AS INT) + CAST(len(lines) > 0 AND 10 * len(list_distinct(lines)) >= 7 * len(lines) AS INT)) / 5.0::DOUBLE) AS es
  FROM counts),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CAST(1 + (rank - 1) % 3 AS DOUBLE) AS weight, 3 * CAST(source_size AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS level FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s3),
s5 AS (SELECT *, (SELECT arg_min(share, level) FROM s4 WHERE level >= share) AS common FROM s4),
goal AS (SELECT source, rank, source_size, CASE WHEN level < common THEN cap ELSE coalesce(weight * common, cap) END AS target FROM s5),
g2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goal),
g3 AS (SELECT *, target - epochs * source_size AS rest FROM g2),
-- in order of keys every document is taken that fits what is still missing
numbered AS (SELECT d.*, rank, row_number() OVER (PARTITION BY rank ORDER BY es, size, doc_id) AS nth FROM docs d JOIN g3 ON d.source IS NOT DISTINCT FROM g3.source WHERE size > 0),
walk(rank, nth, room, fits) AS (
  SELECT rank, CAST(0 AS BIGINT), CAST(floor(rest) AS BIGINT), false FROM g3
  UNION ALL SELECT w.rank, n.nth, CASE WHEN n.size <= w.room THEN w.room - n.size ELSE w.room END, n.size <= w.room
  FROM walk w JOIN numbered n ON n.rank = w.rank AND n.nth = w.nth + 1),
state AS (SELECT n.*, fits FROM numbered n JOIN walk USING (rank, nth)),
missing AS (SELECT rank, min(room) + any_value(rest) - floor(any_value(rest)) AS missing FROM walk JOIN g3 USING (rank) GROUP BY rank),
-- one more, one less or an exchange
adds AS (SELECT DISTINCT rank, size FROM state WHERE NOT fits UNION SELECT rank, 0 FROM g3),
drops AS (SELECT DISTINCT rank, size FROM state WHERE fits UNION SELECT rank, 0 FROM g3),
best AS (SELECT rank, a.size AS added, x.size AS dropped FROM adds a JOIN drops x USING (rank) JOIN missing USING (rank)
  QUALIFY row_number() OVER (PARTITION BY rank ORDER BY abs(missing - (a.size - x.size)), a.size - x.size, a.size, x.size) = 1),
ends AS (SELECT s.*, row_number() OVER (PARTITION BY rank, fits, size ORDER BY es, doc_id) AS low, row_number() OVER (PARTITION BY rank, fits, size ORDER BY es DESC, doc_id DESC) AS high FROM state s),
taken AS (SELECT doc_id, es, size, rank, CASE WHEN fits THEN CASE WHEN high = 1 AND size = dropped AND added <> dropped THEN 0 ELSE 1 END
  ELSE CASE WHEN low = 1 AND size = added AND added <> dropped THEN 1 ELSE 0 END END AS more FROM ends JOIN best USING (rank)),
every AS (SELECT doc_id, rank, size, more FROM taken
  UNION ALL SELECT doc_id, rank, size, 0 FROM docs d JOIN g3 ON d.source IS NOT DISTINCT FROM g3.source WHERE size = 0)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (epochs + more) AS BIGINT) AS taken, CAST(epochs + more AS BIGINT) AS copies
FROM every JOIN g3 USING (rank)"""

ORACLES = {"op1_chat_format": _OP1, "op2_decontaminate": _OP2, "op3_warc": _OP3, "op7_licenses": _OP7, "op8_lattice": _OP8, "op9_mix": _OP9}
