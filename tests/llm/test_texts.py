"""Operators on single texts: languages, secrets, personal data, quality, packing."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from datavitals.llm import language_id, packing, pii, quality, secret_scan
from datavitals.llm.queries import vocabulary
from tests.llm.conftest import LONG, TEXTS, rows

EN = "the river and the hill were there when they went with that other thing in the thick weather"
DE = "der fluss und die hügel waren schon da als sie mit dem anderen ding durch das dichte wetter gingen"


def joined(spans, order):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order.index(x[0]))))


# language


@pytest.fixture(scope="module")
def language_model(spark):
    labelled = [(i, " ".join(np.random.default_rng(i).permutation((EN if i % 2 else DE).split())), "en" if i % 2 else "de", "s") for i in range(40)]
    labelled += [(50, None, "en", "s"), (51, "unlabelled", None, "s"), (52, "", "de", "s")]
    return language_id.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string, source string"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def test_languages(spark, docs, clashing, nothing, language_model):
    made = language_id.identify(docs.select("doc_id", "text"), language_model)
    by_text = {t: (lang, score) for t, (_, lang, score) in ((r["text"], (r["doc_id"], r["lang_pred"], r["score"])) for r in language_id.identify(
        docs.select("doc_id", "text"), language_model, keep=["doc_id", "text"]).collect())}
    assert language_model.languages == ["de", "en"]
    assert by_text[TEXTS[0][1]][0] == "en" and by_text[TEXTS[3][1]][0] == "de"
    for blank in (None, "", " \t\n ", "***!!! 1234 ###"):
        assert by_text[blank] == ("und", 0.0)
    assert all(0 <= score <= 1 for _, score in by_text.values())
    assert made.count() == len(TEXTS)
    assert rows(language_id.identify(clashing.select("doc_id", "text"), language_model)) == rows(made)
    assert language_id.identify(nothing.select("doc_id", "text"), language_model).count() == 0
    empty = language_id.train(nothing, vocabulary("byte_bpe_multi_50k.tiktoken"))
    assert {r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), empty).collect()} == {"und"}


def test_words_have_letters():
    assert language_id.words_of("² ½ m² 12 Ⅳ über-all_中") == ["m²", "über", "all", "中"]


def test_forward_sums_every_segmentation():
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"abcabcab"]
    table = np.random.default_rng(3).random((len(pieces) + 1, 2)) * 0.1
    table[-1] = 0
    lattice = language_id.Lattice(pieces)

    def brute(word, lang):
        if not word:
            return 1.0
        return sum(table[i, lang] * brute(word[len(p):], lang) for i, p in enumerate(pieces) if word.startswith(p))

    words = [b"a", b"abc", b"abcabcabc", b"cab", b"xyz"]
    got = language_id.log_probabilities(words, lattice, table)
    assert np.allclose(got, [[np.log(brute(w, lang)) for lang in (0, 1)] for w in words])
    long = language_id.log_probabilities([b"abc" * 40], lattice, table)
    assert np.isfinite(long).all()


def test_pieces_of_any_length_count():
    """Pieces of more than eight bytes, found by hash: forward sums and expected counts as over all segmentations."""
    long = [b" abcabcab", b"abcabcabcabc", b" abcabcabcabc", b"bcabcabcab"]
    pieces = sorted([bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", *long], key=lambda p: (len(p), p))
    table = np.random.default_rng(4).random((len(pieces) + 1, 1)) * 0.1
    table[-1] = 0
    lattice = language_id.Lattice(pieces)

    def ways(word):
        if not word:
            yield ()
        for i, p in enumerate(pieces):
            if word.startswith(p):
                yield from ((i, *rest) for rest in ways(word[len(p):]))

    for word in (b" abcabcabcabc", b" abcabcabd", b"xbcabcabcabx"):
        found = [(w, float(np.prod(table[list(w), 0]))) for w in ways(word)]
        total = sum(p for _, p in found)
        assert np.isclose(language_id.log_probabilities([word], lattice, table)[0, 0], np.log(total))
        want = np.zeros(len(table))
        for w, p in found:
            np.add.at(want, list(w), p / total)
        used = language_id.expected_counts(lattice.rows(language_id.letters_of([word], len(word))), np.array([1.0]), table[:, 0])
        assert np.allclose(used, want)
    assert len(language_id.read_pieces(vocabulary("byte_bpe_multi_50k.tiktoken"))) == 50_256


def test_unlearned_scripts_lose_to_the_background(spark, language_model):
    texts = ["Мой дядя самых честных правил когда не в шутку занемог", "中文字符 没有 空格", "xqzjv kwpqx zzvqk jjxwq qqkzv", "the river and the hill were there", "das ding und der fluss"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_id.identify(df, language_model, names=("lang_pred", "score", "gain")).collect()}
    assert all(found[i]["gain"] < 0 for i in (0, 1, 2)) and all(found[i]["gain"] > 0 for i in (3, 4))
    clash = df.withColumn("score", F.lit("old")).withColumn("id", F.lit(1))
    assert language_id.identify(clash, language_model).select("score").schema["score"].dataType.simpleString() == "double"


def test_expected_counts():
    pieces = [bytes([b]) for b in range(256)] + [b"ab"]
    table = np.full(len(pieces) + 1, 0.01)
    table[-1] = 0
    lattice = language_id.Lattice(pieces)
    letters = language_id.letters_of([b"ab", b"ab"], 2)
    used = language_id.expected_counts(lattice.rows(letters), np.array([1.0, 3.0]), table)
    whole = 4 * 0.01 / (0.01 + 0.0001)
    assert np.isclose(used[256], whole) and np.isclose(used[ord("a")], 4 - whole)


# secrets


def secret_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_secrets(spark, docs, clashing, nothing):
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    got = secret_scan.find_secrets(docs, ranks)
    expected = sorted((i or -1, hashlib.sha256(joined(secret_base(t or ""), ["assign", "access", "hex"]).encode()).hexdigest()) for i, t, _, _ in TEXTS)
    assert sorted((r["id"] or -1, r["base_sha256"]) for r in got.collect()) == expected
    assert rows(secret_scan.find_secrets(clashing, ranks)) == rows(got)
    assert secret_scan.find_secrets(nothing, ranks).count() == 0


@pytest.mark.parametrize("text,found", [
    ("key q7Zp0Vx2Lk9RtW4mYb8Nc3Hd here", ["random"]),
    ("sum 9e107d9d372bb6826bd81d3542a419d6 md5", ["hex"]),  # a digest: a base span, not a random one
    ("id 123e4567-e89b-12d3-a456-426614174000 uuid", []),
    ("some_long_identifier_name_42_here and path/to/some/file/v2/index", []),
    ("secret=token:abcdefgh", []),  # the first match fails its length and is not tried again
    ("ToKeN : 'abc.def-123'", ["assign"]),
    ("to\u212aen=abcdefgh \u017fecret=abcdefgh", []),
    ("a" * 200_000, ["hex"]),
])
def test_secret_kinds(text, found):
    own = secret_scan.base_spans(text)
    encode = secret_scan.byte_encoding(vocabulary("byte_bpe_50k.tiktoken")).encode_ordinary
    assert [k for k, _, _ in own + secret_scan.random_spans(text, own, encode, 20, 2.0)] == found


def random_texts(text):
    own = secret_scan.base_spans(text)
    encode = secret_scan.byte_encoding(vocabulary("byte_bpe_50k.tiktoken")).encode_ordinary
    return [text[s:e] for _, s, e in secret_scan.random_spans(text, own, encode, 20, 2.0)]


@pytest.mark.parametrize("before", [
    "application/settings/production/connection_signature=", "services/integration/webhooks/incoming/", "password-reset/confirm/account/", "see https://hooks.example.com/services/integration/webhooks/incoming/",
    "users/123e4567-e89b-12d3-a456-426614174000/settings/", "commit/9E107D9D372BB6826BD81D3542A419D6/settings/", "commit/9e107d9d372bb6826bd81d3542a419d6/settings/"])
@pytest.mark.parametrize("secret", ["q7Zp0Vx2Lk9RtW4mYb8N", "q7Zp0Vx2Lk9RtW4mYb8Nc3Hd", "q7Zp0Vx2Lk9RtW4mYb8Nc3HdJ5sKf1Gz"])
def test_secrets_glued_to_words(before, secret):
    got = random_texts(f"a {before}{secret}/environment/configuration b")
    assert len(got) == 1 and secret in got[0]
    assert random_texts(f"a {before}environment/configuration2/settings b") == []


@pytest.mark.parametrize("secret", ["xkqzhjtwvbrnpfdgmzqx", "XkQzHjTwVbRnPfDgMzQxWkLpBvCs", "xkqz-hjtw-vbrn-pfdg-mzqx", "XKQZH-7JTWV-BRN4P-FDGMZ-QX2WK"])
@pytest.mark.parametrize("before", ["", "connection_signature=", "services/integration/webhooks/incoming/"])
def test_secrets_of_letters_and_groups(before, secret):
    got = random_texts(f"a {before}{secret} b")
    assert len(got) == 1 and secret in got[0]


@pytest.mark.parametrize("text", [
    "internationalizationconfiguration", "getElementsByClassNameAndAttribute", "MAXIMUM_NUMBER_OF_CONNECTIONS_PER_HOST", "state-of-the-art-machine-learning-methods",
    "9E107D9D372BB6826BD81D3542A419D6", "123E4567-E89B-12D3-A456-426614174000", "12345678901234567890123", "2024-01-15-17-30-00-2024-01-16", "-" * 50 + "=" * 50])
def test_words_and_known_forms_are_no_secrets(text):
    assert random_texts(f"a {text} b") == []


def test_dense_stretches():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        ends = np.cumsum(rng.integers(2, 30, 14))
        parts = [(int(e) - int(n), int(e)) for e, n in zip(ends, np.diff(ends, prepend=0) - 1, strict=True)]
        weights = [int(w) for w in rng.integers(-9, 8, 14)]
        heavy = [(a, b) for a in range(14) for b in range(a, 14) if parts[b][1] - parts[a][0] >= 20 and sum(weights[a : b + 1]) > 0]
        got = secret_scan.dense(parts, weights, 20)
        assert all(x[1] < y[0] for x, y in zip(got, got[1:]))
        assert set(got) <= {(parts[a][0], parts[b][1]) for a, b in heavy}
        for a, b in heavy:  # nothing heavy is passed over
            assert any(s < parts[b][1] and parts[a][0] < e for s, e in got)
            assert a < b or any(s <= parts[a][0] and parts[b][1] <= e for s, e in got)


# personal data


def luhn(d):
    return sum(int(x) if i % 2 == 0 else 2 * int(x) - 9 * (int(x) > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def personal_base(t):
    only = lambda s: re.sub("[^0-9]", "", s)
    sp = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    sp += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    sp += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    return sp + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(only(m[0])) <= 15]


AWKWARD = [
    "a..b@c.d x@y.z_w@v.u .@a.b a@b..c a@.b a@b. %@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.0 1.2.3", "é😀 1.2.3.4 a@b.co",
    "4111-1111 1111-1111 4111  1111 1111 1111 41111111111111111111 -4111111111111111- 4111111111111111 ", "+1 212 555 0100) +1+1 2125550100 ++49 (30) 1234-5678.",
    "+1 2125550100 4111111111111111", "1 " * 9000, "9" * 30_000, "a." * 9000 + "@" + "b." * 9000 + "c", "call (212) 555-0199 ssn 219-45-6789 order 100-20-3000",
    "konto DE89370400440532013000 jo (at) example (dot) com", "",
]


def test_personal_data(spark, docs, clashing, nothing):
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list("0123456789.+-@ ()aZ_%é"), 60)) for _ in range(300)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(AWKWARD + noise)], "doc_id long, text string")
    got = {r["id"]: r for r in pii.find_personal(table).collect()}
    for i, t in enumerate(AWKWARD + noise):
        assert got[i]["base"] == joined(personal_base(t), list(pii.BASE)), t[:200]
        assert got[i]["base_sha256"] == hashlib.sha256(got[i]["base"].encode()).hexdigest()
        assert set(filter(None, got[i]["base"].split(","))) <= set(got[i]["spans"].split(","))
    found = pii.find_personal(docs)
    assert sorted((r["id"] or -1, r["base"]) for r in found.collect()) == sorted((i or -1, joined(personal_base(t or ""), list(pii.BASE))) for i, t, _, _ in TEXTS)
    assert rows(pii.find_personal(clashing)) == rows(found)
    assert pii.find_personal(nothing).count() == 0


def test_personal_data_in_dense_texts(spark):
    """Thousands of spans in a text, over many runs: places, overlaps and redaction as in one walk."""
    line = "é mail bob.x@example.com, call +1 (555) 123-4567 or (555) 312-9876 or 219-45-6789 from 10.1.2.3; "
    table = spark.createDataFrame([(i, line * n) for i, n in enumerate((1, 255, 256, 257, 2000))], "doc_id long, text string")
    found = {r["id"]: r for r in pii.find_personal(table).collect()}
    one = found[0]["spans"].split(",")
    assert len(one) >= 4
    for i, text in table.collect():
        assert found[i]["base"] == joined(personal_base(text), list(pii.BASE))
        moved = [(k, int(s) + at, int(e) + at) for at in range(0, len(text), len(line)) for k, s, e in (x.split(":") for x in one)]
        assert found[i]["spans"] == joined(moved, list(pii.KINDS))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert clean[0].startswith("é mail <EMAIL>, call <PHONE>") and clean[0].endswith("from <IP>; ")
    assert all(clean[i] == clean[0] * (len(text) // len(line)) for i, text in table.collect())


def test_weak_supervision_finds_good_labelers():
    rng, patterns = np.random.default_rng(1), {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        v = tuple(int(x) for x in (np.where(rng.random(3) < 0.85, 1, -1) * (1 if truth else -1))) + (int(rng.choice([-1, 0, 1])),)
        patterns[v] = patterns.get(v, 0) + 1
    counted = sorted((0, v, n) for v, n in patterns.items())
    posterior = dict(zip([v for _, v, _ in counted], pii.aggregate_votes(counted), strict=True))
    assert posterior[1, 1, 1, 0] > 0.9 > 0.1 > posterior[-1, -1, -1, 0]
    model = pii.train(counted)
    assert min(model.yes[:3]) > 5 * abs(model.yes[3]) and pii.train([]).intercepts[0] < 0


def test_redaction(spark, docs, nothing):
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect() if r["doc_id"] is not None}
    assert clean[10] == "mail <EMAIL> or <PHONE>, ip <IP> and 999.1.1.1, card <CARD>."
    assert clean[7] == LONG and clean[5] is None and clean[4] == ""
    assert pii.redact(nothing).count() == 0 and pii.redact(docs).columns == docs.columns


# quality


@pytest.fixture(scope="module")
def network(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = [(i, " ".join(word() + ("!!" if i % 3 == 0 else "") for _ in range(60))) for i in range(150)]
    labels = [(i, int(i % 3 != 0)) for i in range(150)] + [(0, None), (900, 1), (3, 0)]
    docs = spark.createDataFrame(texts + [(3, texts[3][1])], "doc_id long, text string")
    return quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), usable=F.col("id") % 5 != 1), texts


def test_quality(spark, docs, clashing, nothing, network):
    net, texts = network
    tables = quality.responses(net)
    held = [(quality.score(net, tables, t) >= 0.5) == (i % 3 != 0) for i, t in texts if i % 5 == 1]
    assert np.mean(held) > 0.9
    scored = quality.rate(docs.select("doc_id", "text"), net)
    assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == len(TEXTS)
    assert rows(quality.rate(clashing.select("doc_id", "text"), net)) == rows(scored)
    assert quality.rate(nothing.select("doc_id", "text"), net).count() == 0
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.rate(docs.select("doc_id", "text"), none).collect()} == {0.5}


def test_chunks_cover_the_whole_text(network):
    net, _ = network
    tables = quality.responses(net)
    raw = (" ".join(["abc"] * 5000) + " !!x!!").encode()
    data = quality.padded(net, raw)
    best, _ = quality.halves(net, tables, data)
    plain = np.stack([sum(tables[k][data[p + k]] for k in range(net.width)) for p in range(0, len(data) - net.width + 1, quality.STRIDE)]) + net.bias
    assert np.allclose(best.max(axis=0), plain.max(axis=0), atol=1e-4)
    assert len(best) == -(-len(raw) // (net.chunk // 2))


def test_filters_see_every_byte_position(network):
    net, _ = network
    tables = quality.responses(net)
    for raw in (b"abcdefgh" * 9, b"the river and the hill were there", bytes(range(33, 127))):
        data = quality.padded(net, raw)
        best, _ = quality.halves(net, tables, data)
        for p in range(len(raw) - net.width + 1):
            assert (best.max(axis=0) >= sum(tables[k][raw[p + k]] for k in range(net.width)) + net.bias - 1e-4).all()


# packing


def test_packing(spark, docs, clashing, nothing):
    from tokenizers import Tokenizer

    path, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    extra = docs.unionByName(spark.createDataFrame([(20, "a <|endoftext|> b  \n c", "en", "a")], docs.schema))
    got = packing.pack_documents(extra, path, ranks, with_ids=True).collect()
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(path), {}, {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in [(t[0], t[1]) for t in TEXTS if t[0] != 2] + [(20, "a <|endoftext|> b  \n c")]:
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == ids
        assert all(r["length"] == 1024 for r in own[1:])
    assert len(by_doc[2]) == 2
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert rows(packing.pack_documents(clashing, path, ranks).select("id", "piece", "ids_crc32")) == rows(packing.pack_documents(docs, path, ranks).select("id", "piece", "ids_crc32"))
    assert packing.pack_documents(nothing, path, ranks).count() == 0


@pytest.mark.parametrize("text", ["a" + " " * 1_500_000 + "b", "\n \n" * 200_000, "x" * 300_000])
def test_tokens_of_very_long_runs(text):
    encoder = packing.Encoder(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    assert encoder.encode(text).tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("docs_cap,cost_cap", [(1024, 1024 * 1024), (3, 1024 * 1024), (1024, 1024 * 1024 // 2)])
def test_plan_holds_every_capacity(rule, docs_cap, cost_cap):
    lengths = np.random.default_rng(4).integers(1, 700, 3000)
    counts = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True)), strict=True))
    sequences, ranks = {}, {}
    for length, first, end, sequence, many, offset, repeat in packing.plan(counts, 1024, docs_cap, cost_cap, rule):
        ranks.setdefault(length, []).append((first, end))
        assert end - first == many * repeat
        for k in range(many):
            sequences.setdefault(sequence + k, []).extend((offset + j * length, length) for j in range(repeat))
    for length, spans in ranks.items():
        assert sorted(spans)[0][0] == 0 and sorted(spans)[-1][1] == counts[length]
        assert all(a[1] == b[0] for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        sizes = [n for _, n in own]
        assert sum(sizes) <= 1024 and len(sizes) <= docs_cap and sum(n * n for n in sizes) <= cost_cap
    if docs_cap == 1024 and cost_cap == 1024 * 1024:
        assert len(sequences) <= 1.01 * lengths.sum() / 1024 + 1


PLANTED = {
    # kind: text with a cue word, text without one, counter-example, of a number i
    "ssn": (lambda i: f"her ssn {123 + i}-{10 + i % 80}-{2000 + 37 * i} is", lambda i: f"then {123 + i}-{10 + i % 80}-{2000 + 37 * i} came",
            lambda i: f"order {100 + i}-{10 + i % 80}-{3000 + 41 * i} shipped"),
    "iban": (lambda i: f"iban DE{10 + i}{37040044053201300 + i * 97:018d} please", lambda i: f"went FR{10 + i}{20041010050500013 + i * 89:018d} so",
             lambda i: f"serial QX{10 + i}ABCDEFGH{i % 10}JKLM end"),
    "tel": (lambda i: f"call ({212 + i}) 555-{1207 + 31 * i} now", lambda i: f"and ({312 + i}) 555-{2308 + 29 * i} too",
            lambda i: f"invoice (800) 555-{1000 + i}"),
    "mail": (lambda i: f"mail jo{i} (at) site{i} (dot) org today", lambda i: f"then kim{i} [at] corp{i} [dot] net said",
             lambda i: f"page ..x{i} (at) no (dot) yes"),
}


def planted_table(spark, kinds, texts):
    rows, want = [], []
    for kind in kinds:
        for form in (0, 1, 2):
            for i in range(60):
                rows.append((1_000_000 + len(rows), PLANTED[kind][form](i)))
                want.append((kind, form))
    made = spark.createDataFrame([*rows, *texts], "doc_id long, text string").repartition(4)
    found = {r["id"]: r["spans"] for r in pii.find_personal(made).collect()}
    return {(kind, form): sum(found[r[0]].startswith(kind) for r, w in zip(rows, want, strict=True) if w == (kind, form)) for kind, form in want}


def test_planted_personal_data_is_found_in_any_corpus(spark):
    corpus = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for kinds, texts in ((PLANTED, corpus), (PLANTED, []), (["ssn"], corpus)):
        found = planted_table(spark, kinds, texts)
        for kind in kinds:
            assert found[kind, 0] >= 54 and found[kind, 1] >= 54 and found[kind, 2] <= 6, (found, len(texts))


def test_votes_count_by_kind():
    """A labeler that never says yes to a kind does not speak against it, however it votes on others."""
    others = [(0, (1, 1, 0, 0), 5000), (0, (-1, 0, -1, 0), 3000), (4, (1, 1, 1, 0), 4000)]
    for more in ([], others):
        for n in (1, 31, 100_000):
            patterns = sorted([(1, (1, 0, 0, 0), n), (1, (1, -1, -1, 0), max(1, n // 10)), *more])
            posterior = dict(zip([(k, v) for k, v, _ in patterns], pii.aggregate_votes(patterns), strict=True))
            assert posterior[1, (1, 0, 0, 0)] > 0.8 and posterior[1, (1, -1, -1, 0)] < 0.4


def test_features_move_the_odds_both_ways_within_bounds():
    weights = pii.shape_weights([(5, 3, 7, 5000.0, 10.0), (5, 3, 8, 10.0, 5000.0), (5, 0, 2, 3.0, 1.0), (5, 0, 3, 3.0, 1.0)])
    at = lambda k, f, v: weights[(k * pii.FEATURES + f) * pii.VALUES + v]
    assert at(5, 3, 7) == pii.MOST_SHAPE == -at(5, 3, 8) and abs(at(5, 0, 2)) < 1e-9 and at(1, 0, 0) == 0


def test_operators_as_registered_on_the_small_tables(spark):
    """The queries themselves: their columns, their held-out rows, one row a document."""
    import zlib

    from datavitals.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for name, of, remainder in (("op1_language_id", 5, 0), ("op8_quality", 3, 1)):
        found = {r["doc_id"]: r for r in QUERIES[name](spark, sf).collect()}
        assert set(found) == {d["doc_id"] for d in docs}
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % of == remainder) and 0 <= r["score"] <= 1 for i, r in found.items())
    for name in ("op3_secret_scan", "op4_simhash_dedup", "op6_personal_data"):
        assert sorted(r["doc_id"] for r in QUERIES[name](spark, sf).select("doc_id").collect()) == sorted(d["doc_id"] for d in docs)
    packed = QUERIES["op2_best_fit_packing"](spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert packed <= 1024


def plain_score(net, text):
    """The network position by position: filters over every byte, half-chunks, chunks of two, mean and largest, logistic."""
    raw = (text or "").encode()
    half = net.chunk // 2
    size = max(1, -(-len(raw) // half)) * half
    data = raw + bytes(size + net.width - 1 - len(raw))
    best = []
    for h in range(0, size, half):
        inside = [sum(net.embedding[data[p + k]].astype(float) @ net.filters.reshape(net.width, 4, -1)[k].astype(float) for k in range(net.width)) for p in range(h, h + half)]
        best.append(np.maximum(np.max(inside, axis=0) + net.bias, 0))
    chunks = [np.maximum(a, b) for a, b in zip(best, best[1:], strict=False)] or best
    z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.head + net.offset
    return 1 / (1 + np.exp(-z))


QUALITY_TEXTS = [("the river and hill were there " * (1 + i % 5))[: 40 + 31 * i] if i % 2 else ("zx9 !! qq " * (1 + i % 6))[: 25 + 29 * i] for i in range(16)]


def small_network(rounds):
    return quality.fit(QUALITY_TEXTS, [i % 2 for i in range(16)], 3, rounds, 0.01, 5, 4, 64)


def test_whole_scores_against_brute_force():
    net = small_network(3)
    tables = quality.responses(net)
    for text in [None, "", "a", "x" * 31, "y" * 32, "z" * 33, *QUALITY_TEXTS, "é中" * 100]:
        assert abs(quality.score(net, tables, text) - plain_score(net, text)) < 1e-5


def test_first_step_goes_down_the_numeric_gradient():
    net, moved = small_network(0), small_network(1)  # one batch: the step's signs are those of the gradient

    def loss(n):
        p = np.array([plain_score(n, t) for t in QUALITY_TEXTS])
        y = np.arange(16) % 2
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    rng, right, seen = np.random.default_rng(6), 0, 0
    for name in ("head", "bias", "filters", "embedding"):
        value, step = getattr(net, name), np.asarray(getattr(moved, name), float) - np.asarray(getattr(net, name), float)
        used = np.flatnonzero(step.ravel() != 0)
        for at in rng.permutation(used)[:12]:
            ends = []
            for d in (1e-3, -1e-3):
                held = value.copy()
                held.ravel()[at] += d
                setattr(net, name, held)
                ends.append(loss(net))
            setattr(net, name, value)
            slope = (ends[0] - ends[1]) / 2e-3
            if abs(slope) > 1e-4:
                seen, right = seen + 1, right + (np.sign(step.ravel()[at]) == -np.sign(slope))
    assert seen >= 20 and right >= 0.95 * seen
