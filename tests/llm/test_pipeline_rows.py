"""The pipeline decides by row: ids may be null or repeated."""

import corpus_pipeline
from twinweave.llm import components, quality, tokenfile
from twinweave.llm.queries import tokenizer_path

from .test_operators import slow_fingerprint


def words(tag):
    return " ".join(f"{tag}{i}" for i in range(40))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_dedup_keeps_one_row_a_group(spark, sf):
    rows = [(None, words("a"), "en", "s", 1), (None, words("b"), "en", "s", 2), (None, words("b"), "en", "s", 2), (7, words("c"), "en", "s", 3),
            (7, words("d"), "en", "s", 4), (9, words("c"), "en", "s", 5), (None, words("d"), "en", "s", 6), (None, None, None, None, None), (3, "", "en", "s", 0)]
    fps = {slow_fingerprint(words(t)) for t in "abcd"}
    assert all((x ^ y).bit_count() > 2 for x in fps for y in fps | {0} if x != y)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[i] for i in (0, 1, 3, 4, 8)], key=str)


def test_filter_decides_by_row(spark, sf, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.quality, "train", lambda *a, **k: Fixed())
    rows = [(None, "good", "en", "s", 1), (None, "bad", "en", "s", 2), (5, "good", "en", "s", 3), (5, "bad", "en", "s", 4), (5, "good", "en", "s", 3)]
    got = corpus_pipeline.quality_filter(spark, spark.createDataFrame(rows, SCHEMA), sf)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([r for r in rows if r[1] == "good"], key=str)


class Fixed:
    """A classifier that accepts the text "good" by its measured length in words and characters."""

    def score(self, features):
        import numpy as np

        return np.array([1.0 if list(x) == GOOD else 0.0 for x in features])


GOOD = list(next(iter(corpus_pipeline.quality.features(["good"]))))


def test_mixture_counts_each_row(spark, sf):
    rows = [(None, words(f"w{i}"), "en", "st"[i % 2], i) for i in range(20)] + [(5, words("x"), "en", "s", 20), (5, words("y"), "en", "t", 21)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = [tuple(r) for r in corpus_pipeline.mixture(spark, docs, sf).collect()]
    copies = [r.copies for r in corpus_pipeline.mixing.mix(docs).collect()]
    assert len(got) == sum(copies) and set(got) <= set(rows) and max(map(got.count, got)) <= 3


def to_python(plan):
    """How many columns each MapInArrow of a plan is sent."""
    own = [plan.child().output().size()] if plan.nodeName() == "MapInArrow" else []
    return own + [n for i in range(plan.children().size()) for n in to_python(plan.children().apply(i))]


def test_text_travels_to_python_once(spark, sf):
    rows = [(1, words("a"), "en", "s", 1), (2, None, "en", "s", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    scored = corpus_pipeline.quality_filter(spark, docs, sf)
    assert to_python(scored._jdf.queryExecution().analyzed()) == [len(docs.columns) + 1]  # and the id
    clean = corpus_pipeline.decontamination(spark, docs, sf)
    assert to_python(clean._jdf.queryExecution().analyzed()) == [len(docs.columns)]
    assert sorted(map(tuple, clean.collect())) == rows
    kept = corpus_pipeline.quality.quality_scores(docs, docs.selectExpr("doc_id", "1 as quality"), keep=("n_chars", "text", "source"))
    assert sorted((r.n_chars, r.text, r.source) for r in kept.where("score >= 0").collect()) == [(1, words("a"), "s"), (2, None, "s")]


def in_a_row(plan):
    """Whether a MapInArrow takes its rows straight from another, so that a task keeps two Python workers."""
    below = plan
    while plan.nodeName() == "MapInArrow" and below.children().size() == 1:
        below = below.children().apply(0)
        if below.nodeName() == "MapInArrow":
            return True
        if below.nodeName() not in ("Project", "Filter"):
            break
    return any(in_a_row(plan.children().apply(i)) for i in range(plan.children().size()))


def test_dedup_takes_one_worker_a_task(spark, sf, monkeypatch):
    plans, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, *a: plans.append(df._jdf.queryExecution().analyzed()) or write(df, *a))
    near = words("a") + " " + words("b")
    docs = spark.createDataFrame([(n, f"{near} {t}", "en", "s", n) for n, t in enumerate(("", "x", "y", words("c")))], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect())
    fps = [slow_fingerprint(r.text) for r in docs.orderBy("doc_id").collect()]
    assert plans and not any(map(in_a_row, plans))
    assert got[0] == 0 and all(any((fps[n] ^ f).bit_count() <= 2 for f in fps[:n]) for n in set(range(4)) - set(got))


def test_own_tables_take_no_workers(spark, sf, tmp_path, monkeypatch):
    """``createDataFrame`` of a list runs an RDD of Python's; its workers would stay beside those of the stages."""
    docs = spark.createDataFrame([(n, words(f"w{n}"), "en", "s", n) for n in range(9)], SCHEMA)
    labels = docs.selectExpr("doc_id", "doc_id % 2 as quality")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert quality.train(docs, labels).cuts
    assert tokenfile.tokens_written_and_read(docs, tokenizer_path()).count() == 9
    none = tokenfile.write_tokens(docs.limit(0), f"file://{tmp_path}/t", tokenizer_path())
    assert none.columns == ["shard", "nth", "file", "n_ids", "n_docs"] and none.count() == 0
