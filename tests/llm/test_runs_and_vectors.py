"""Periodic runs, whitening and byte-level removal of repeats, each against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from datavitals.llm import periodic_runs, suffix_dedup, whitening
from datavitals.llm.queries import QUERIES
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.001"

# periodic runs


def plain_runs(w, repeats=4, shortest=6):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            own = w[i:i + size]
            if size >= max(shortest, repeats * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_words():
    rng = np.random.default_rng(3)
    for t in range(600):
        w = rng.integers(0, rng.integers(1, 4), rng.integers(0, 90))
        if t % 2:
            unit, at = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, len(w) + 1)
            w = np.concatenate([w[:at], np.tile(unit, rng.integers(2, 8)), unit[: rng.integers(0, len(unit) + 1)], w[at:]])
        assert [tuple(r) for r in periodic_runs.find_runs(w).tolist()] == plain_runs(w.tolist())
        assert [tuple(r) for r in periodic_runs.find_runs(w, 5, 2).tolist()] == plain_runs(w.tolist(), 5, 2)


def test_wavelet_tree_answers_ranges():
    rng = np.random.default_rng(4)
    values = rng.permutation(200)
    tree = periodic_runs.WaveletTree(values)
    low, high = np.sort(rng.integers(0, 201, (2, 500)), axis=0)
    after, most = rng.integers(-1, 200, 500), rng.integers(0, 260, 500)
    got = tree.successor(low, high, after, most)
    for a, b, x, m, g in zip(low, high, after, most, got, strict=True):
        assert g == min((v for v in values[a:b] if x < v <= m), default=-1)


def test_blocks_of_every_level_have_ranks():
    word = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2, 9])
    _, ranks, counts = periodic_runs.ranks_by_doubling(word)
    for k, (rank, count) in enumerate(zip(ranks, counts, strict=True)):
        blocks = [tuple(word[i:i + 2**k]) + (() if i + 2**k <= len(word) else (-i,)) for i in range(len(word))]
        for i, a in enumerate(blocks):
            assert count[i] == blocks.count(a)
            assert [rank[i] == rank[j] for j in range(len(word))] == [a == b for b in blocks]


def test_runs_of_awkward_texts(docs, clashing, nothing):
    for df in (docs, clashing):
        got = sorted((r["id"] is None, r["id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(df).collect())
        want = []
        for id, text, _, _ in TEXTS:
            words = (text or "").split()
            found = plain_runs(words) if len(words) < 1000 else [(0, 30_000, 977)]  # the long text repeats 977 words
            want.append((id is None, id, found, plain_collapse(words, found)))
        assert got == sorted(want)
    assert periodic_runs.periodic_runs(nothing).count() == 0


def test_runs_stay_within_texts(spark):
    many = [(i, "a b " * (i % 7) + "x" * (i % 2)) for i in range(300)]
    got = {r["id"]: [tuple(x) for x in r["runs"]] for r in periodic_runs.periodic_runs(spark.createDataFrame(many, "doc_id long, text string").repartition(2)).collect()}
    assert got == {i: plain_runs(t.split()) for i, t in many}


def test_periodic_runs_as_registered(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    planted = 0
    for d in docs:
        words = [w.decode() for w in (d["text"] or "").encode().split()]
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs, row = plain_runs(words), got[d["doc_id"]]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        assert (row["n_runs"], (row["start"], row["length"], row["period"])) == (len(runs), best)
        assert row["exponent_milli"] == (None if not runs else 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert planted > 5 and len(got) == len(docs)


# whitening


def whole(v, scale=64, offset=1_000_000):
    return np.floor(np.asarray(v, np.float64) * scale).astype(object) + offset


@pytest.mark.parametrize("kind", ["any", "identity", "low rank", "pairs", "close", "diagonal", "one", "two"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(6)
    d = {"one": 1, "two": 2}.get(kind, 48)
    a = rng.normal(size=(3 * d, 5 if kind == "low rank" else d)) @ (rng.normal(size=(5, d)) if kind == "low rank" else np.eye(d))
    c = a.T @ a / len(a)
    if kind == "identity":
        c = np.eye(d)
    if kind in ("pairs", "close"):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        c = q @ np.diag(np.repeat(np.arange(d // 2, 0, -1.0), 2) if kind == "pairs" else 1 + 1e-9 * np.arange(d, 0, -1)) @ q.T
        c = (c + c.T) / 2
    if kind == "diagonal":
        c = np.diag(np.repeat([3.0, 1.0, 2.0], 16))
    values, vectors = whitening.leading_components(c, 32)
    assert len(values) == (5 if kind == "low rank" else min(32, d))
    assert np.allclose(values, np.linalg.eigvalsh(c)[::-1][: len(values)], rtol=1e-12, atol=1e-14 * values[0])
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
    assert np.abs(c @ vectors.T - vectors.T * values).max() < 1e-13 * values[0]


def test_sturm_counts():
    rng = np.random.default_rng(7)
    diag, off = rng.normal(size=9), rng.normal(size=8)
    off[3] = 0
    t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    at = np.linspace(-6, 6, 101)
    assert (whitening.below(diag, off, at) == (np.linalg.eigvalsh(t)[:, None] < at).sum(axis=0)).all()


def check_whitened(found, kept, most=32):
    """Found rows of (id, component) against eigh over exact covariances of the kept vectors."""
    x = np.array([whole(v) for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == n * rank
    for c in range(rank):
        rows = sorted((r for r in found if r["component"] == c + 1), key=lambda r: r["id"])
        want = centred @ vectors[:, c] / np.sqrt(values[c])
        got = np.array([r["whitened"] for r in rows])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
        assert abs(rows[0]["explained"] / (values[c] / values.sum()) - 1) < 1e-9
        assert {r["n"] for r in rows} == {n} and rows[0]["identity_error"] < 1e-9
        assert [int(r["deviation"]) for r in rows] == [sum(int(n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(8)
    good = [(i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0.5]).tolist()) for i in range(80)]
    good += [(80, good[0][1]), (81, [1.5, 2.5])]  # a repeated vector and a short one
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (92, [float("nan")] + [0.0] * 5), (93, [float("inf")] + [0.0] * 5), (94, [1e300] + [0.0] * 5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in good + bad], "vec_id long, embedding array<double>, n int, id int").repartition(5)
    kept = [(i, v + [0.0] * (6 - len(v))) for i, v in good]
    check_whitened(whitening.whiten(df).collect(), kept)
    check_whitened(whitening.whiten(df, most=3).collect(), kept, 3)
    assert whitening.whiten(df.where("vec_id >= 90")).count() == 0
    assert whitening.whiten(df.where("vec_id = 5").union(df.where("vec_id = 5"))).count() == 0  # no variance
    assert whitening.whiten(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e7, 1e11])
def test_whitening_of_large_entries(spark, size):
    rng = np.random.default_rng(9)
    good = [(i, (size * rng.normal(size=4) * [4, 3, 2, 1] + 3 * size).tolist()) for i in range(60)]
    found = whitening.whiten(spark.createDataFrame(good, "vec_id long, embedding array<double>").repartition(3)).collect()
    if size > 1e10:
        assert all(r["identity_error"] < 1e-6 for r in found) and len(found) == 240
    else:
        check_whitened(found, good)


def test_whitening_as_registered(spark):
    found = [r.asDict() | {"id": r["vec_id"]} for r in QUERIES["op12_embedding_whitening"](spark, SF).collect()]
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    check_whitened(found, kept)


# repeats


def plain_removal(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = True
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]])))
    return out


def removed(df, **how):
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.without_repeats(df, **how).orderBy("id").collect()]


@pytest.mark.parametrize("length, letters", [(2, 26), (9, 4), (24, 2), (40, 26), (400, 26)])
@pytest.mark.parametrize("most_contexts", [100_000, 3])
def test_repeats_of_patched_texts(spark, length, letters, most_contexts):
    rng = np.random.default_rng(length)
    draw = lambda n: bytes(rng.integers(97, 97 + letters, int(n)).astype(np.uint8)).decode()
    sources = [draw(rng.integers(1, 5 * length)) for _ in range(8)]
    texts = []
    for _ in range(90):
        parts = [draw(rng.integers(0, 2 * length))]
        for _ in range(rng.integers(0, 3)):
            own = sources[rng.integers(8)]
            i, j = sorted(rng.integers(0, len(own) + 1, 2))
            parts += [own[i:j], draw(rng.integers(0, 2 * length))]
        texts.append("".join(parts))
    texts += [None, "", "a" * (3 * length), "ab" * length, texts[0], texts[0], texts[1].replace("a", "é")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert removed(df, length=length, most_contexts=most_contexts) == plain_removal([(t or "").encode() for t in texts], length)


def test_merging_refines_the_interleave():
    rng = np.random.default_rng(11)
    core = rng.integers(0, 5, 300)
    after = rng.integers(0, 2, (300, 16)).astype(np.uint8) * 255
    after[::3, :9] = after[0, :9]
    order, common, of_core = suffix_dedup.interleave(core, after)
    keys = [(core[i], bytes(after[i])) for i in order]
    assert keys == sorted(keys)
    assert all((of_core[i] == of_core[i - 1]) == (keys[i][0] == keys[i - 1][0]) for i in range(1, 300))
    for i in range(300):
        if i == 0 or keys[i][0] != keys[i - 1][0]:
            assert common[i] == -1
        else:
            a, b = keys[i][1], keys[i - 1][1]
            assert common[i] == next((k for k in range(16) if a[k] != b[k]), 16)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(12)
    passage = bytes(rng.integers(0, 3, 700).astype(np.uint8))
    texts = [bytes(rng.integers(0, 3, k).astype(np.uint8)) + passage + bytes(rng.integers(0, 3, 500).astype(np.uint8)) for k in (0, 13, 900)]
    seen = []
    for k, t in zip((0, 13, 900), texts, strict=True):
        found = suffix_dedup.anchors(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 400, 200, 8)
        anchor = {at - o: at - k for _, at, low, high in found.tolist() for o in range(low, high + 1)}
        assert sorted(anchor) == list(range(len(t) - 399))  # every window has one
        seen.append([anchor[k + i] for i in range(301)])
    assert seen[0] == seen[1] == seen[2]


def test_repeats_of_awkward_texts(docs, clashing, nothing):
    want = sorted(zip([t[0] or -1 for t in TEXTS], plain_removal([(t[1] or "").encode() for t in TEXTS], 50), strict=True))
    for df in (docs, clashing):
        found = suffix_dedup.without_repeats(df, length=50).collect()
        assert sorted((r["id"] or -1, (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in found) == want
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_suffix_dedup_as_registered(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op13_suffix_dedup"](spark, SF).orderBy("doc_id").collect()
    want = plain_removal([(d["text"] or "").encode() for d in docs], 400)
    assert [tuple(r)[:4] for r in got] == [(d["doc_id"], *w[:3]) for d, w in zip(docs, want, strict=True)]
    assert [r["kept_sha256"] for r in got] == [hashlib.sha256(w[3]).hexdigest() for w in want]
    assert sum(w[1] for w in want) > 0


def test_many_copies_of_a_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COPIES", 3)
    rng = np.random.default_rng(13)
    draw = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    hot = draw(90)
    texts = [hot] * 40 + [draw(30) + hot[10:60] + draw(30) for _ in range(6)] + [draw(50)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    docs = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("d1"), F.lit(0).alias("d2"), F.col("text").cast("binary").alias("text"))
    parts, many = suffix_dedup.dealt(docs)
    assert many.count() == 1 and parts.groupBy("d1", "part").count().agg(F.max("count")).first()[0] <= 8
    assert parts.count() == len(texts)
    assert removed(df, length=40) == plain_removal([t.encode() for t in texts], 40)


def test_a_megabyte_of_one_letter(spark):
    df = spark.createDataFrame([(1, "a" * 1_200_000), (2, "b" * 399), (3, "a" * 400)], "doc_id long, text string")
    got = suffix_dedup.without_repeats(df).select("id", "n_bytes", "n_removed", F.length("kept").alias("kept")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1_200_000, 1_200_000, 0), (2, 399, 0, 399), (3, 400, 400, 0)]


def test_the_query_shows_the_text_that_is_left(spark, tmp_path):
    words = lambda k, n: " ".join(f"w{k}x{(k * 7919 + i * 104729) % 99991}" for i in range(n))
    passage = words(99, 60)
    assert len(passage) > 400
    rows = [(1, words(1, 30) + " " + passage + " " + words(2, 30)), (2, words(3, 40) + " " + passage), (3, words(4, 90)), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op13_suffix_dedup"](spark, str(tmp_path)).collect()}
    for doc in (1, 2):
        assert passage not in got[doc]["text"] and got[doc]["n_removed"] >= len(passage)
    assert got[3]["text"] == rows[2][1] and got[4]["text"] == "" and got[3]["n_removed"] == 0
    for r in got.values():
        assert r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() and len(r["text"]) == r["n_bytes"] - r["n_removed"]


def test_short_passages_that_repeat_across_documents_are_counted(spark, tmp_path):
    """Passages of 50 words and under 400 bytes stay by the 400-byte rule; n_shared tells the documents that have one."""
    draw = random.Random(13)
    text = lambda n: [f"{draw.choice('bdfgklmnprst')}{draw.choice('aeiou')}{draw.randrange(1000)}" for _ in range(n)]
    rows, planted = [], set()
    for i in range(60):
        passage = text(50 + i % 12)
        assert len(" ".join(passage)) < 400
        for k in (0, 1):
            before = text(draw.randrange(80))
            words = before + passage + text(draw.randrange(80))
            rows.append((1000 * k + i, draw.choice([" ", "\n", "\t"]).join(words)))
            planted.add(1000 * k + i)
    rows += [(5000 + i, " ".join(text(draw.randrange(200)))) for i in range(60)]
    own = " ".join(text(52))
    rows += [(6000, own + " . " + own), (6001, None), (6002, " ".join(text(20) * 4)), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_suffix_dedup"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["n_shared"]} == planted
    assert all(r["n_removed"] == 0 for r in got)
    copies = spark.createDataFrame([(1, own), (2, own), (3, " ".join(text(60)))], "doc_id long, text string")
    assert {r["id"]: r["n_shared"] > 0 for r in suffix_dedup.without_repeats(copies, words=50).collect()} == {1: True, 2: True, 3: False}
