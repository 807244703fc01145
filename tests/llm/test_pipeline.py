"""Each stage of the pipeline against a plain version over the same input."""

import math
import re
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
from xxhash import xxh64_intdigest

import corpus_pipeline
from twinweave.llm import quality
from twinweave.llm.common import written
from twinweave.llm.queries import tokenizer_path

from .test_operators import brute_components, brute_contamination, plain_mix, slow_fingerprint


def digest(text):
    n = xxh64_intdigest((text or "").encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def test_stages(spark, sf):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    d = written(docs, "t")
    first = written(stages[0](spark, d, sf), "t")
    good = {r.doc_id for r in quality.quality_scores(d, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good

    second = written(stages[1](spark, first, sf), "t")
    rows = sorted(first.collect(), key=lambda r: r.doc_id)
    fps = [slow_fingerprint(r.text) for r in rows]
    label = brute_components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in second.collect()) == [rows[k].doc_id for k in range(len(rows)) if label[k] == k]

    third = written(stages[2](spark, second, sf), "t")
    clean = []
    for r in second.collect():
        n, hit, _ = brute_contamination(r.text, bench)
        if not (hit and 20 * hit >= n):
            clean.append(r)
    assert sorted(third.collect()) == sorted(clean)

    fourth = written(stages[3](spark, third, sf), "t")
    assert fourth.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.quality_scores(third, labels, model=quality.train(docs, labels)).collect()}
    given, size = [], {}
    for r in third.collect():
        u = (int(md5(str(r.doc_id).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        size[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        given.append((-math.log(u) / max(0.05, scores[r.doc_id]), size[r.doc_id], r.source))
    times = Counter(fourth.collect())
    assert set(times) <= set(third.collect())
    assert sorted((size[r.doc_id], n) for r, n in times.items()) == sorted((s, n) for s, _, n in plain_mix(given) if n)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    last = stages[4](spark, fourth, sf).collect()
    start, want = 0, []
    for r in sorted(fourth.collect(), key=lambda r: (r.doc_id, digest(r.text))):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in last) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, last))


CLASHES = "n_words long, contaminated string, items string, score double, predicted int, source_size long, copies int, row_key int, n int, fp long, k string, t string"


def test_awkward_rows(spark, sf):
    """Null, empty, repeated and very long rows, ids with several texts, and columns named as results are."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None, None, None, None), (None, "a b c d", "en", "s", 7), (None, "a b c d", "en", "s", 7), (None, "one two three four five", "en", "s", 7),
            (2, "", "en", None, 0), (2, "", "en", None, 0), (2, long, "en", "s", 1), (5, long + " more", "en", "t", 1)]
    rows = [(*r, *(str(i) if i in (1, 2, 10, 11) else i for i in range(12))) for r in rows]
    rows = [(*r[:8], float(r[8]), *r[9:]) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        assert set(map(tuple, got.collect())) <= set(rows), name
    clean = sorted(map(tuple, stages["benchmark decontamination"](spark, docs, sf).collect()), key=str)
    assert clean == sorted(rows, key=str)  # none of them has a benchmark passage
    alone = sorted(map(tuple, stages["SimHash near-dedup"](spark, docs, sf).collect()), key=str)
    assert alone == sorted([rows[0], rows[1], rows[3], rows[6]], key=str)
    assert stages["token-ID / binary output"](spark, docs, sf).count() == len(rows)
