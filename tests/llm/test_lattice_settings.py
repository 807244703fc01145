"""Recall of the lattice keys at the least cosine that links, for each setting that the module states."""

import re

import numpy as np
import pytest

from twinweave.llm import lattice

STATED = [(int(a), int(b), float(c)) for a, b, c in re.findall(r"^(\d) +(\d+) +(0\.\d+) ", lattice.__doc__, re.M)]


def pairs(n, size, seed, cosine):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, size))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def meetings(points, tables, cosine, n=4000, size=64):
    a, b = (lattice.cells(x, points, tables) for x in pairs(n, size, points, cosine))
    codes = np.concatenate([a, b]).view(np.int64).reshape(2 * n, -1)
    return lattice._first_meeting(codes, np.arange(n), np.arange(n) + n, 1 + lattice.PROBES * points)[0].mean()


@pytest.mark.parametrize("points,tables,stated", STATED)
def test_recall(points, tables, stated):
    assert stated >= 0.9
    assert meetings(points, tables, 0.9) >= stated - 0.01


def test_settings_are_stated():
    assert [x[0] for x in STATED] == [1, 2, 3] and STATED[0][:2] == (lattice.POINTS, lattice.TABLES)


@pytest.mark.parametrize("points,tables,stated", STATED)
def test_against_all_pairs(spark, monkeypatch, points, tables, stated):
    """Ids that are null, shared by several vectors or repeated; rows in are rows out."""
    monkeypatch.setattr(lattice, "BLOCK", 30)
    rng = np.random.default_rng(points)
    base = rng.normal(size=(25, 32))
    near = [(base[i % 25] + rng.normal(size=32) * 0.12).tolist() for i in range(150)]
    ids = [None if i % 7 == 0 else i // 2 if i % 3 == 0 else i for i in range(150)]
    rows = [(k, v, "c", 1) for k, v in zip(ids, near)] + [(ids[3], near[3], "c", 1), (None, near[1], "c", 1), (1, [1.0, 0.0], "c", 1), (1, [0.0, 1.0], "c", 1), (None, [-0.0, 1.0], "c", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class string, key int")
    got = [tuple(r) for r in lattice.near_embeddings(df, points=points, tables=tables).collect()]
    assert len(got) == len(rows)
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) for r in rows]
    link = [[j for j in range(len(rows)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    total = sum(map(len, link))
    assert 0.9 * total <= sum(r[1] for r in got) <= total
    label = list(range(len(rows)))
    for i, js in enumerate(link):
        for j in js:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    low = {}
    for i, r in enumerate(rows):
        low[label[i]] = min((x for x in (low.get(label[i]), r[0]) if x is not None), default=None)
    want = sorted(((r[0], low[label[i]]) for i, r in enumerate(rows)), key=str)
    assert sorted(((r[0], r[2]) for r in got), key=str) == want
    assert all(r[3] == (r[0] == r[2]) for r in got)
