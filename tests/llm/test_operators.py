"""Each operator against a brute-force version, a round trip, or held-out labels,
on the smallest tables and on rows made to be awkward."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from twinweave.llm import bpe, chat, components, decontaminate, lattice, licenses, mixing, quality, simhash, tokenfile, warc
from twinweave.llm.common import alnum_words
from twinweave.llm.queries import QUERIES, tokenizer_path

AWKWARD = [
    None, "", " ", "\n\t\r\x0b\x0c", "a", "a b", "Hello  world \n\n x", "it's we'LL they're", "<|endoftext|>", "a<|endoftext|><|endoftext|> b",
    "x" * 5000, "ab " * 4000, "naïve façade — “quoted” 漢字 🙂🙂 é", "1234567 ¼ ²    \x1c\x1d\x85z", "�‍퟿", "'s't're'", "   lead", "trail   ",
    "tab\tand\r\nnewline\n", "aaaaaaaaaaaaaaaaaaaaa", "¡Ñandú! ÄÖÜß", "a" * 70 + " " + "b" * 70]


def docs_frame(spark, texts, **extra):
    """Rows with names that the operators use inside as further columns."""
    return spark.createDataFrame(
        [(i, t, "row", 1.0, i) for i, t in enumerate(texts)], "doc_id long, text string, row string, es double, k long")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


# --- 1 chat -----------------------------------------------------------------

def conversations():
    rng = random.Random(1)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "[\\INST]", "<\\\\/s>", "[NEXT]", "[ROLE]", "[/TURN]", "<s>", "hi", "\n", "é🙂", "<", "[", "]", "$1", ""]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 12) if conv else 700):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool[ROLE]", None])
            rows.append((conv if conv != 5 else None, turn if conv != 7 else None, role, rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(6)))])))
    return rows + rows[900:905]


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df, chunk=16)).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].loss_text == "".join(t for r, t in turns if r == "assistant")
    assert chat.read_chat(chat.format_chat(df.limit(0))).count() == 0


def test_chat_crowded_turns(spark):
    """Many rows without a turn or of one turn, one very long text, equal rows, and columns named as inside."""
    rng = random.Random(3)
    rows = [(1, rng.choice([None, 0, 1]), rng.choice(["user", "assistant"]), f"t{rng.randrange(50)} </s>") for _ in range(900)]
    rows += [(2, 0, "assistant", "long [INST] " * 100_000), (None, None, None, None), (1, None, "user", "t1 </s>")]
    df = spark.createDataFrame([(*r, "piece", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, piece string, t int, row int")
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    for chunk in (16, 100_000):
        got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_chat(chat.format_chat(df, chunk=chunk)).collect()}
        assert got == want


def test_chat_merges_adjacent_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "system", "d")], "conv_id long, turn long, role string, text string")
    r = chat.format_chat(df).first()
    assert r.formatted == "<s>[INST]a[NEXT]b[/INST]c</s>[ROLE]system[/ROLE]d[/TURN]"
    assert [r.formatted[s.start : s.start + s.len] for s in r.loss_spans] == ["c"]


# --- 2 decontamination --------------------------------------------------------

def brute_contamination(text, items, size=13):
    words = alnum_words(text or "")
    hit, found = set(), set()
    for name, item in items:
        for w in decontaminate.windows(alnum_words(item or ""), size):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    if name is not None:
                        found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_nodes,piece", [(500_000, 4096), (150, 3)])
def test_decontamination(spark, block_nodes, piece):
    rng = random.Random(2)
    vocab = ["a", "B", "é", "c3", "dd"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, say(20)), (2, "b a"), (10, say(13)), (3, None), (4, ""), (5, "!!"), (None, "a a a"), (2, "b a")]
    texts = [*AWKWARD, *(say(rng.randrange(60)) for _ in range(40)), "x, " + items[0][1].replace(" ", "--") + " y", items[2][1].upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs_frame(spark, texts), bench, block_nodes=block_nodes, piece=piece).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, hit, found = brute_contamination(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.n_items) == (n, hit, found, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(len(alnum_words(t[s.start : s.end])) for s in r.hit_spans) == hit
    none = decontaminate.decontaminate(docs_frame(spark, texts), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(texts)


def test_more_words_than_code_points():
    """A kernel with over 1,114,111 distinct words; the last one is found."""
    words = [f"w{i}" for i in range(1_200_000)]
    auto, symbols = decontaminate.build([(1, " ".join(words))], 1)
    assert len(set(symbols.values())) == len(words)
    assert decontaminate.scan("x w1199999 W0 y w1200000", auto, symbols) == (5, [(1, 3)], {0})


def test_a_block_is_within_memory():
    """A full block is built in a process of its own; its growth is measured."""
    import subprocess
    import sys

    code = """
import random, resource
from twinweave.llm import decontaminate as d
rng = random.Random(1)
items, nodes = [], 0
while nodes < d.BLOCK_NODES:
    w = [f"word{rng.randrange(300_000)}" for _ in range(500)]
    items.append((len(items), " ".join(w)))
    nodes += (len(w) - 12) * 13
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
auto, number = d.build(items)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 300 << 10  # KiB


# --- 3 WARC -------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, f"http://h{i % 3}.Example.com:80/a/{i % 7}?q=1#f", ["x" * 200, "short", None, "é\r\n\r\n" * 40, f"own {i}" * 30][i % 5]) for i in range(60)]
    rows += [(100, None, "x" * 200), (101, "not a url \r\n é", "y" * 99), (101, "not a url \r\n é", "y" * 99), (None, "http://a/", "x" * 200)]
    pages = spark.createDataFrame([(*r, "key", "file", 1, "payload") for r in rows], "page_id long, url string, html string, key string, file string, offset long, payload string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(spark, pages).collect())
    first = {}
    for i, _, h in rows:
        if i is not None and h and len(h.encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first.get(h) if h in first and first[h] != i else None
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want)
    assert warc.archive_and_read(spark, pages.limit(0)).count() == 0


def test_warc_look_up(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://b.a.org/{i:03}", f"p{i}") for i in range(50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    top = warc.build_index(warc.write_archives(pages, folder), folder, 3)
    keys = spark.createDataFrame([("org,a,b)/007",), ("org,a,b)/none",), (None,), ("org,a,b)/049",)], "key string")
    found = warc.read_records(warc.look_up(keys, folder, top, 3), folder, 3).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in found) == [(7, b"p7"), (49, b"p49")]


# --- 4 and 10 tokens -----------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_counts(spark, sf, tokenizer):
    df = documents(spark, sf).select("doc_id", "text").union(docs_frame(spark, AWKWARD).selectExpr("-1 - doc_id", "text"))
    texts = by_id(df, "text")
    got = by_id(bpe.token_counts(df, tokenizer_path()), "n_bytes", "n_tokens", "over_limit")
    assert len(got) == len(texts)
    for i, (t,) in texts.items():
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 1024), repr(t)[:80]


def test_token_files(spark, sf, tokenizer):
    df = documents(spark, sf).select("doc_id", "text").union(docs_frame(spark, AWKWARD).selectExpr("-1 - doc_id", "text"))
    got = by_id(tokenfile.tokens_written_and_read(df, tokenizer_path()), "start", "n_tokens", "ids_crc32")
    at = 0
    for i, (t,) in sorted(by_id(df, "text").items()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)[:80]
        at += len(ids)
    assert tokenfile.tokens_written_and_read(df.limit(0), tokenizer_path()).count() == 0


def test_token_files_of_one_id(spark, tokenizer, tmp_path):
    """Rows of one id, null ids, several files a task, and columns named like results."""
    texts = [f"text {i} of many " * (i % 9) for i in range(60)] + [None, "", "same", "same"]
    rows = [([None, 7, 7, 8][i % 4], t, "f", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string, n long, h long").repartition(3)
    folder = f"file://{tmp_path}/t"
    shards = tokenfile.write_tokens(df, folder, tokenizer_path(), parts=3, file_ids=50)
    assert shards.count() > 6
    got = [tuple(r) for r in tokenfile.read_tokens(shards, folder).collect()]

    def digest(t):
        from xxhash import xxh64_intdigest

        n = xxh64_intdigest((t or "").encode(), 42)
        return n - (1 << 64) if n >> 63 else n

    at, want = 0, []
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1]))):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_packing(bits, tmp_path):
    from pyarrow import fs

    rng = np.random.default_rng(bits)
    parts = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 70_000, 5, 65_530, 3)]
    store = fs.LocalFileSystem()
    w = tokenfile.Writer(store.open_output_stream(str(tmp_path / "f")), bits)
    for k, p in enumerate(parts):
        w.add(None if k == 1 else k, p)
    w.close()
    r = tokenfile.Reader(store.open_input_file(str(tmp_path / "f")))
    whole = np.concatenate(parts)
    assert (r.ids(0, r.n_ids) == whole).all() and (r.ids(65_000, 1_000) == whole[65_000:66_000]).all()
    assert [r.length(d) for d in range(6)] == [len(p) for p in parts] and list(r.known) == [1, 0, 1, 1, 1, 1]


# --- 5 quality -----------------------------------------------------------------

def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    s = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in s) / len(s)
    good, bad = [r.score for r in s if r.quality == 1], [r.score for r in s if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("held-out accuracy", right, "AUC", auc)
    assert right > 0.9 and auc > 0.9
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in s)


def test_quality_awkward(spark):
    docs = docs_frame(spark, AWKWARD)
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, 1), (6, None), (None, 1), (8, 0), (12, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = quality.quality_scores(docs, some).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


# --- 6 SimHash -----------------------------------------------------------------

def brute_components(n, linked):
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = label[a], label[b]
                if x != y:
                    label = [min(x, y) if c in (x, y) else c for c in label]
    return label


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hs = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_simhash(spark, sf):
    df = documents(spark, sf).select("doc_id", "text").union(docs_frame(spark, AWKWARD).selectExpr("1000000 + doc_id", "text"))
    base = documents(spark, sf).first().text
    words = base.split(" ")
    near = [" ".join(w if k != j else "zz" for k, w in enumerate(words)) for j in range(0, len(words), 7)]
    df = df.union(spark.createDataFrame([(2_000_000 + k, t) for k, t in enumerate(near)], "doc_id long, text string"))
    texts = sorted(by_id(df, "text").items())
    fps = [slow_fingerprint(t) for _, (t,) in texts]
    label = brute_components(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = by_id(simhash.near_duplicates(df), "fingerprint", "component_id")
    assert len(got) == len(texts)
    for k, (i, _) in enumerate(texts):
        assert got[i] == (f"{fps[k]:016x}", texts[label[k]][0])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 20_000, dtype=np.uint32)
    for _ in range(3):
        y = x ^ (np.uint32(1) << rng.integers(0, 23, len(x), dtype=np.uint32)) ^ (np.uint32(1) << rng.integers(0, 23, len(x), dtype=np.uint32))
        a, b = simhash.codeword_numbers(x), simhash.codeword_numbers(y)
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()
    assert set(np.unique([len(set(r)) for r in simhash.codeword_numbers(x).tolist()])) == {1, 6}


@pytest.mark.parametrize("n,third", [(50, 0), (2000, 1), (9000, 2)])
def test_forest_of_a_bucket(n, third):
    rng = np.random.default_rng(n)
    fps = np.unique(rng.integers(0, 1 << 16, n, dtype=np.uint64) << np.uint64(20 * third))
    u, v = simhash.forest(fps, third)
    assert len(u) < len(fps) and (np.bitwise_count(u ^ u) == 0).all()
    up = {int(x): int(x) for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        up[root(a)] = root(b)
    near = {}
    for x in fps.tolist():
        for i in range(64):
            for j in range(i, 64):
                y = x ^ (1 << i) ^ (1 << j) if i != j else x ^ (1 << i)
                if y in up and n <= 2000:
                    assert root(x) == root(y)
        near[root(x)] = 1
    assert len(near) >= 1


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(200)]
    edges += [(7, 7), (None, 3), edges[0]]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r.node: r.root for r in components.components(df, "a", "b").collect()} == {x: root(x) for x in list(up)}
    assert components.components(df.limit(0), "a", "b").count() == 0


# --- 7 licenses ------------------------------------------------------------------

def test_licenses(spark):
    rng = random.Random(7)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "the", "license"]) for _ in range(n))
    texts = [*AWKWARD]
    for name, t in licenses.TEMPLATES.items():
        words = t.split()
        for drop in (0, 1, 2, 3):
            kept = list(words)
            for _ in range(drop):
                kept[rng.randrange(len(kept))] = "changed"
            texts.append(filler(rng.randrange(40)) + "\n" + " ".join(kept).upper() + "\n" + filler(rng.randrange(40)))
    df = docs_frame(spark, texts)
    got = {(r.doc_id, r.license_id, r.n_matched, r.n_template) for r in licenses.license_scan(df).collect()}

    def sh(t):
        w = alnum_words(t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for i, t in enumerate(texts):
        for name, template in licenses.TEMPLATES.items():
            if len(sh(t) & sh(template)) >= 0.8 * len(sh(template)):
                want.add((i, name, len(sh(t) & sh(template)), len(sh(template))))
    assert got == want and len({x[1] for x in got}) == len(licenses.TEMPLATES)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_license_recall(spark):
    """Altered and cut-up templates of all lengths at a containment of 0.8 or more: how many the bands retrieve."""
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    templates = {f"t{k}": " ".join(say(5 + 2 * k)) for k in range(60)}
    texts = []
    for t in templates.values():
        words = t.split()
        for _ in range(4):  # single words changed
            w = list(words)
            for _ in range(max(1, len(w) // 40)):
                w[rng.choice([0, -1, rng.randrange(len(w))])] = "changed"
            texts.append(" ".join(say(30) + w + say(30)))
        pieces = [words[i : i + 5] for i in range(len(words) - 4)]  # every shingle for itself
        rng.shuffle(pieces)
        texts.append(" ".join(x for p in pieces for x in (*p, *say(3))))
    got = {(r.doc_id, r.license_id) for r in licenses.license_scan(docs_frame(spark, texts), templates=templates).collect()}

    def sh(t):
        w = alnum_words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(i, n) for i, t in enumerate(texts) for n, x in templates.items() if len(sh(t) & sh(x)) >= 0.8 * len(sh(x))}
    assert got <= want and len(want) > 150
    print("recall", len(got) / len(want))
    assert len(got) >= 0.9 * len(want)


# --- 8 lattice --------------------------------------------------------------------

def test_lattice(spark, sf, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 40)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 64))
    rows = [(i, (base[i % 30] + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.3])).astype("f4").tolist()) for i in range(300)]
    rows += [(400 + k, rows[0][1]) for k in range(5)] + [(405, [2 * x for x in rows[0][1]])]
    rows += [(500, None), (501, []), (502, [0.0] * 64), (503, [float("nan")] + [1.0] * 63), (504, [None] + [1.0] * 63), (505, [1.0, 2.0]), (506, [1.0, 2.1]), (507, [1e30] * 64), (508, [float("inf")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    link = {i: [j for j in ids if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.9] for i in ids}
    got = {r.vec_id: r for r in lattice.near_embeddings(df).collect()}
    assert len(got) == len(rows)
    total, found = sum(map(len, link.values())), sum(r.n_links for r in got.values())
    assert 0.97 * total <= found <= total
    for i, _ in rows:
        assert got[i].n_links <= len(link.get(i, []))
        assert got[i].kept == (got[i].component_id == i) and got[i].component_id <= i
        if i not in link:
            assert got[i].n_links == 0 and got[i].kept
    assert lattice.near_embeddings(df.limit(0)).count() == 0


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 8)) * 3
    p = lattice.nearest_point(x)
    assert (((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - p[:, None] - lattice.neighbours()) ** 2).sum(2) + 1e-9).all()


# --- 9 mixing ---------------------------------------------------------------------

def test_mixing(spark, sf):
    df = documents(spark, sf)
    rows = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, [0, 0, r.target, r.source_size])
        sizes[r.source][0] += r.size
        sizes[r.source][1] += r.taken
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
    names = sorted(sizes)
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    total = sum(v[0] for v in sizes.values())
    capped, goal = set(), {}
    while True:
        left = total - sum(3 * sizes[n][0] for n in capped)
        free = [n for n in names if n not in capped]
        goal = {n: left * weight[n] / sum(weight[m] for m in free) for n in free} | {n: 3 * sizes[n][0] for n in capped}
        over = {n for n in free if goal[n] > 3 * sizes[n][0]}
        if not over:
            break
        capped |= over
    for n in names:
        size, taken, target, stated = sizes[n]
        assert stated == size and target == pytest.approx(goal[n])
    off = {n: abs(sizes[n][1] - sizes[n][2]) / sizes[n][2] for n in names}
    assert all(x <= 0.05 for x in off.values()), off  # a source has some ten documents here
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def plain_mix(rows):
    """(size, target, copies) of each of rows (key, size, source) with the keys' order given, one source after the other."""
    names = sorted({r[2] for r in rows}, key=lambda n: (n is None, n or ""))
    own = {n: sorted(r[:2] for r in rows if r[2] == n) for n in names}
    size = {n: sum(x[1] for x in own[n]) for n in names}
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    capped = set()
    while True:
        left = sum(size.values()) - sum(3 * size[n] for n in capped)
        share = {n: left * weight[n] / sum(weight[m] for m in names if m not in capped) for n in names if n not in capped}
        over = {n for n in share if share[n] > 3 * size[n]}
        if not over:
            break
        capped |= over
    out = []
    for n in names:
        target = share.get(n, 3.0 * size[n])
        epochs = int(target // size[n]) if size[n] else 0
        missing = target - epochs * size[n]
        state = []
        for es, x in own[n]:
            fits = 0 < x <= missing
            missing -= x * fits
            state.append([es, x, fits])
        free, used = [x for _, x, f in state if not f and x], [x for _, x, f in state if f]
        add, drop = min(((u, t) for u in {0, *free} for t in {0, *used}), key=lambda p: (abs(missing - (p[0] - p[1])), p[0] - p[1], *p))
        if add != drop:
            for want, flag, order in ((add, False, state), (drop, True, state[::-1])):
                if want:
                    hit = next(x for x in order if x[1] == want and x[2] == flag)
                    hit[2] = None
            for x in state:
                if x[2] is None:
                    x[2] = x[1] == add  # added and dropped sizes differ
        out += [(x, round(target, 6), epochs + bool(f)) for _, x, f in state]
    return sorted(out)


@pytest.mark.parametrize("seed,buckets", [(1, 4096), (2, 4), (3, 1)])
def test_mixing_plain(spark, seed, buckets):
    """Many equal rows, null ids and sources, one hot source."""
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        n = rng.choice([0, 1, 2, 5, 30, 31, 200, 3000])
        rows.append((rng.choice([None, i, 7, 8]), rng.choice([" ".join(["word"] * n), None if n == 5 else "x " * n]), rng.choice(["a", "a", "a", "b", "", None, "é"])))
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, buckets=buckets, row="text").collect()
    assert len(got) == 450
    given = {}
    for r in df.select("doc_id", "source", mixing.n_words(df.text).alias("n"), (-mixing.F.log(mixing.uniform(df.doc_id, df.text)) / mixing.quality_weight(
            df.text, mixing.n_words(df.text))).alias("es")).collect():
        given.setdefault(r.source, []).append((r.es, r.n, r.source))
    want = plain_mix([x for v in given.values() for x in v])
    assert sorted((r["size"], round(r.target, 6), r.copies) for r in got) == want
    assert all(r.taken == r["size"] * r.copies for r in got)


def test_mixing_given_weight(spark):
    rows = [(i, "a b c d", "s", w) for i, w in enumerate([0.9, None, float("nan"), -1.0, float("inf"), 0.0] * 20)] + [(1000 + i, "w " * 40, "t", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = mixing.mix(df, weight="weight").join(df.select("doc_id", "source", "weight"), "doc_id").where("source = 't'").collect()
    assert len(got) == 40 and abs(sum(r.taken for r in got) - got[0].target) <= 40
    assert mixing.mix(df, weight="weight").count() == len(rows)


def test_mixing_awkward(spark):
    rows = [(i, t, [None, "a", "b", "", "A"][i % 5]) for i, t in enumerate(AWKWARD * 3)] + [(None, "x y", "a"), (None, None, None), (0, "one", "z"), (0, "one", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    empty = mixing.mix(df.where("text is null")).collect()
    assert all(r.target == 0 and r.taken == 0 for r in empty)


# --- all ---------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_encoder_forgets_after_a_task(tmp_path, monkeypatch):
    """A Python worker that waits for its next task holds no pieces of the last one."""
    import pyarrow as pa
    from pyspark import TaskContext

    class Task:
        def partitionId(self):
            return 0

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Task()))
    texts = [f"text {i} of many" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(range(300), pa.int64()), pa.array(texts)], names=["k", "h", "t"])
    found = list(tokenfile._write(f"file://{tmp_path}", tokenizer_path(), 2, 1 << 20)(iter([batch])))
    assert found[0].column(4).to_pylist() == [300]
    assert not tokenfile.encoder(tokenizer_path()).cache


def test_token_tasks_write_token_files_alone(spark, tmp_path):
    """Beside its token files a task writes nothing: the row of each goes to the driver."""
    df = docs_frame(spark, ["one text", "another", "a third one"])
    shards = tokenfile.write_tokens(df, f"file://{tmp_path}/t", tokenizer_path(), parts=2).collect()
    assert sorted(os.listdir(f"{tmp_path}/t")) == sorted(r.file for r in shards) and sum(r.n_docs for r in shards) == df.count()
