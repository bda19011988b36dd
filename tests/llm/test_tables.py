"""Operators across rows: near duplicates, vector search, url reputation, mixing, and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from datavitals.llm import maxscore, mixing, neighbours, simhash, url_reputation
from datavitals.llm.components import components
from datavitals.llm.queries import ORACLES, QUERIES, RULES
from tests.llm.conftest import TEXTS, rows

# near duplicates


def brute_components(fps, most_bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps[a + 1:]) <= most_bits) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, text, _, _ in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("É A b") == plain_fingerprint("É a B") != simhash.fingerprint("é a b")


def test_triples_hit_every_four_positions():
    from itertools import combinations

    assert len(simhash.TRIPLES) == len(set(simhash.TRIPLES)) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


@pytest.mark.parametrize("block", [1024, 7])
def test_links_lose_nothing(spark, block):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = list(rng.integers(0, 2**64, 300, dtype=np.uint64))
    for c in centres:  # clusters of all widths, some chained
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            fps.append(c ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0)))
    fps = np.unique(np.array(fps, np.uint64))
    expected = brute_components(fps)
    got = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), block=block).collect()
    by = {r["fp"]: r["root"] for r in got}
    assert len(got) == len(fps)
    pairs = {(by[int(f)], e) for f, e in zip(fps.view(np.int64), expected, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_near_duplicates(spark, docs, clashing, nothing):
    got = simhash.near_duplicates(docs)
    fps = np.array([plain_fingerprint(t) for _, t, _, _ in TEXTS], np.uint64)
    roots = brute_components(fps)
    least = {}
    for (i, _, _, _), root in zip(TEXTS, roots, strict=True):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    expected = sorted(((i, f"{int(f):016x}", least.get(r)) for (i, _, _, _), f, r in zip(TEXTS, fps, roots, strict=True)), key=repr)
    assert rows(got) == expected
    assert rows(simhash.near_duplicates(clashing)) == expected
    assert simhash.near_duplicates(nothing).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (-5, 300), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == -5 for i in (100, 200, 300, -5))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    data = [(i, (rng.normal(0, 1, 24) * rng.uniform(0.5, 2)).astype("float32").tolist()) for i in range(900)]
    data += [(i, data[3][1]) for i in range(900, 960)]  # equal vectors
    data += [(40, data[40][1]), (960, None), (961, []), (962, [float("nan")] * 24), (963, [float("inf")] + [0.0] * 23), (964, [None] * 24), (980, [0.0] * 24), (None, data[0][1])]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).repartition(4)


def usable(data, zero):
    good = [(i, v) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    return np.array([i for i, _ in good]), np.array([v for _, v in good], float)


@pytest.mark.parametrize("block_rows,block_queries", [(8192, 4096), (200, 10)])
def test_exact_search(vectors, block_rows, block_queries):
    data, df = vectors
    ids, v = usable(data, True)
    whole = np.floor(256 * v).astype(np.int64)
    expected = []
    for q in np.unique(ids[ids % 50 == 0]):
        scores = whole @ whole[ids == q][0]
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:5]
        expected += [(int(q), k + 1, int(ids[i]), int(scores[i])) for k, i in enumerate(best)]
    got = maxscore.top_scores(df, F.col("id") % 50 == 0, block_rows=block_rows, block_queries=block_queries)
    assert rows(got) == sorted(expected, key=repr)


def test_exact_search_of_huge_and_few(spark):
    data = [(0, [1e300, 2.0]), (1, [1e15, -3.0]), (2, [-7.0]), (50, [3.0, 1e9]), (3, [-1.7e308, 0.001])]
    got = maxscore.top_scores(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    best = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert best[0, 1] == 2**63 - 1 and best[50, 2] == -7 * 256 * 3 * 256 and best[0, 3] == -(2**63) and len(got) == 8
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert maxscore.top_scores(empty, F.col("id") % 50 == 0).count() == 0
    assert neighbours.nearest(empty, F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block_rows,block_queries", [(8192, 4096), (300, 20)])
def test_nearest(vectors, block_rows, block_queries):
    data, df = vectors
    ids, v = usable(data, False)
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, block_rows=block_rows, block_queries=block_queries).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.unique(ids[ids % 20 == 0]):
        scores = (v * v[ids == q][0]).sum(axis=1)
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 21))
        assert all(np.isclose(s, scores[ids == i][0]) for _, i, s in own)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
        hits += len({i for _, i, _ in own} & set(ids[best].tolist()))
        total += 20
    assert hits / total >= 0.9


def test_chi_square():
    assert np.isclose(neighbours.chi_square(15.507, 8), 0.95, atol=1e-4)
    assert np.isclose(neighbours.quantile(0.5, 2), 2 * np.log(2))


# urls


def test_urls(spark):
    urls = [
        "http://a.org/x", "HTTPS://WWW.Example.COM/en/1?q#f", "https://www.example.com/de/", "https://m.example.com/en/", "https://m.example.com/en", "http://example.com",
        "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/", "ftp://É.Net/es/#", "no scheme", None, "", "http://", "a://b://c/d", "http://notexample.com/en/", "http://x.net/es/1",
    ]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("id", F.lit(2)).withColumn("n", F.lit(3))
    got = {r["id"]: r for r in url_reputation.judge_urls(df, RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("a.org", "/x", None), ("www.example.com", "/en/1", "www.example.com/en/"), ("www.example.com", "/de/", "com/"), ("m.example.com", "/en/", "example.com/en/"),
        ("m.example.com", "/en", "com/"), ("example.com", "", None), ("x.net", "/es/1", "net/es/"), ("x.net", "/fr/", "net/fr/"), ("x.net", "/de/", None),
        ("É.net", "/es/", "net/es/"), ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("b:", "//c/d", None), ("notexample.com", "/en/", "com/"), ("x.net", "/es/1", "net/es/")]
    assert {got[i]["verdict"] for i in (6, 7, 3)} == {"block"} and {got[i]["verdict"] for i in (0, 1, 2)} == {"allow"}
    assert url_reputation.judge_urls(df.limit(0), RULES).count() == 0


def test_reputation(spark):
    bad = [(i, f"http://bad.net/{'es' if i % 2 else 'fr'}/{i}") for i in range(200)] + [(900, "http://bad.net/de/1"), (901, "http://new.org/de/1")]
    good = [(1000 + i, f"http://h{i}.com/de/{i}") for i in range(50)]
    got = {r["id"]: r["verdict"] for r in url_reputation.judge_urls(spark.createDataFrame(bad + good, "page_id long, url string"), RULES).collect()}
    assert got[900] == "block" and got[901] == "allow"


# mixing


def test_mixing(spark, docs, clashing, nothing):
    got = mixing.shares(docs).collect()
    assert len(got) == len(TEXTS)
    sizes, order = {}, ["a", "b", "c", "d", None]
    for _, text, _, source in TEXTS:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    weights = {s: 1 + k % 3 for k, s in enumerate(order)}
    whole, capped = sum(sizes.values()), set()
    while True:  # share, stop at the limits, share the excess again
        left, w = whole - sum(3 * sizes[s] for s in capped), sum(weights[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weights[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert np.isclose(r["target"], target[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["emitted"] <= 3
    assert rows(mixing.shares(clashing)) == rows(mixing.shares(docs)) == sorted((tuple(r) for r in got), key=repr)
    assert mixing.shares(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["emitted"] for r in got)
    assert mixing.mix(clashing).count() == mixed.count()


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(8)
    data = [(i, " ".join(["w"] * int(min(5000, rng.lognormal(4, 1.2)))), f"s{min(i % 7, 3)}") for i in range(4000)]
    got = mixing.shares(spark.createDataFrame(data, "doc_id long, text string, source string"), rows_per_part=200).collect()
    taken, target = {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["emitted"]
        target[r["source"]] = r["target"]
    # sizes go up and down once in each part, and on a monotone run systematic sampling errs by one document at most
    largest, rows_of = max(r["size"] for r in got), {s: sum(r["source"] == s for r in got) for s in target}
    assert all(abs(taken[s] - target[s]) <= 2 * largest * -(-rows_of[s] // 200) for s in target)
    assert all(abs(taken[s] / target[s] - 1) < 0.1 for s in target)


# everything together


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*expected.columns)
    assert rows(got) == sorted(expected.fetchall(), key=repr)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "simhash_dedup":
            fps = np.array([plain_fingerprint(r["text"]) for r in docs.collect()], np.uint64)
            assert len(set(brute_components(fps))) == len(fps) <= before
        if name == "personal_data":
            assert docs.where(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.example\.com")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    assert rows(whole.select("doc_id", "piece", "start", "length", "ids_crc32")) == rows(last.select("doc_id", "piece", "start", "length", "ids_crc32"))


def test_pipeline_of_awkward_rows(spark, clashing, nothing):
    for table in (clashing.withColumn("n_chars", F.length("text")), nothing.withColumn("n_chars", F.lit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "unused")
            assert out.count() >= 0 and (name == "best_fit_packing" or out.columns == table.columns)


def test_domains_without_ports_and_under_suffixes_of_several_labels(spark):
    hosts = {"www.a.co.uk": ("a.co.uk", "co.uk"), "b.co.uk:80": ("b.co.uk", "co.uk"), "x.uk.com": ("x.uk.com", "uk.com"), "co.uk": ("co.uk", "co.uk"),
             "www.example.com:8080": ("example.com", "com"), "example.com:": ("example.com", "com"), "taco.uk": ("taco.uk", "uk"), "": ("", "")}
    table = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = table.select("host", *url_reputation.domain_and_suffix(F.col("host"), url_reputation.SUFFIXES)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == hosts
    # every ruled page of a.co.uk is blocked; of b.co.uk nothing is known
    urls = [f"http://h{i % 9}.a.co.uk/bad/{i}" for i in range(900)] + [f"http://h{i % 9}.c{i % 40}.co.uk/good/{i}" for i in range(900)]
    urls += ["http://new.a.co.uk/x", "http://new.b.co.uk/x", "http://h1.a.co.uk:8080/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    made = url_reputation.judge_urls(pages, [("block", "a.co.uk/bad/"), ("allow", "uk/good/")])
    assert [r["verdict"] for r in made.where("id >= 1800").orderBy("id").collect()] == ["block", "allow", "block"]


def test_what_each_stage_makes_of_awkward_rows(spark, docs):
    table = docs.withColumn("n_chars", F.length("text"))
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"]) for r in df.collect())
    kept = {i for i, t, _, _ in TEXTS if t and any(c.isalpha() for c in t)}
    found = stage["language_id"](spark, table, "unused")
    assert {r["doc_id"] for r in found.collect()} <= kept and found.where("doc_id IN (1, 2)").count() == 3
    single = stage["simhash_dedup"](spark, table, "unused")
    fps = {}
    for i, t, _, _ in sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0)):
        fps.setdefault(plain_fingerprint(t), i)
    names = list(fps)
    roots = brute_components(np.array(names, np.uint64))
    least = {}
    for fp, root in zip(names, roots, strict=True):
        own = (fps[fp] is None, fps[fp] or 0)
        least[root] = min(least.get(root, own), own)
    assert ids(single) == sorted((none, None if none else i) for none, i in least.values())
    clean = stage["personal_data"](spark, table, "unused")
    assert ids(clean) == ids(table)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean.collect())
    mixed = stage["source_mixing"](spark, table, "unused")
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(n for i, n in counts.items() if i != 2) <= 3 and counts.get(2, 0) <= 6
    packed = stage["best_fit_packing"](spark, table, "unused")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {t[0] for t in TEXTS}
    assert packed.where("start = 0 AND piece = 0").count() == len(TEXTS)
