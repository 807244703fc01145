"""overall_score counts the class comparison of every page pair."""

from collections import Counter

from twinweave.plans import queries


def test_every_page_pair(spark, sf):
    pages = [(r.page_id, r.hybrid_similarity) for r in queries.hybrids(spark, sf).collect()]
    files, total = Counter({0: 3, 1: 2, 2: 1}), Counter({0: 1.25, 1: 2.0, 2: 0.125})
    for page, s in pages:
        files[page % 7] += 2
        total[page % 7] += s + (s if page % 5 else 0.0)
    got = {r.pair_id: r for r in queries.overall_score(spark, sf).collect()}
    assert {k: r.files for k, r in got.items()} == dict(files)
    assert all(abs(r.overall_similarity - total[k] / files[k]) < 1e-9 for k, r in got.items())
