"""Personal data in texts: fixed patterns, and spans that weak labelers agree on.

Base spans come from fixed patterns with fixed checks and always stay. Other candidates are looser shapes: telephone
numbers without a country code, social security numbers, bank account numbers and spelt-out mail addresses. Every candidate, base spans
included, is voted on by labelers that say yes, no or nothing: the strict form (regex), a list of known area
codes, mail domains and issuer digits (gazetteer), and cue words before the span (context), besides a check for worn-out
digits. Expectation-maximisation over the counts of vote patterns estimates, kind by kind and without any
labels, how often each labeler says yes and objects to personal data and to other spans; its posteriors then train a span classifier,
and candidates it accepts become spans if they overlap no base span.

A labeler that says nothing is no evidence against a span, as some can never say yes to a kind; that it could have objected and did not
speaks for it. Estimates start from stated chances, which keep at least half the weight however many candidates there are, and both truths are
taken as equally likely, so that a text is judged much alike in any corpus. The classifier is linear in the log-odds: to each kind's
weights of votes it adds what the posteriors teach about spans themselves: length, separators, number of different digits, and the
words on both sides, hashed.

Everything runs on built-in functions. Positions come from the lengths of matches and of what lies between
them, so they are code points, the end exclusive. Patterns with repeated groups are written as runs of a character
class over a text of equal length whose stray dots and separators have been replaced, which finds
the same spans without recursion on very long runs. What the driver sees is the counts of vote patterns, at most
3^4 for each kind, and those of features, at most 80. In spelt-out mail addresses the name has up to 64 characters.

A null text is an empty one, with no spans. Repeated rows are searched each; an empty table gives an empty result and a
classifier that accepts nothing; extra columns are ignored (`find_personal`) or go along (`redact`)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, numbered_name, pick, staged

BASE = ("email", "ip", "card", "phone")
MORE = ("tel", "ssn", "iban", "mail")
KINDS = BASE + MORE
LABELERS = 4
FEATURES, VALUES = 5, 16   # length, separators, different digits, word before, word after

# Chances before any data, for the strict form, the gazetteer, the context and worn digits: of a yes, and of an objection, if a span is personal and if not
YES = ((0.6, 0.3), (0.4, 0.15), (0.4, 0.1), (0.1, 0.1))
NO = ((0.01, 0.3),) * LABELERS
STRENGTH = 100   # spans that these chances count for, for either truth; the spans of a kind count for no more in all
MOST_SHAPE = 1.0   # most that one feature may add to the log-odds, either way

LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
STRAY_DOT = rf"\.(?![{LABEL}])|(?<![{LABEL}])\."
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++\.[{LABEL}.]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
STRAY_GAP = r"[ -](?![0-9])|(?<![0-9])[ -]"
CARD = r"[0-9][0-9 -]{13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TEL = r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
MAIL = rf"(?<![{LABEL}._])[{LABEL}._]{{1,64}} ?[(\[](?:at|AT)[)\]] ?[{LABEL}]{{1,63}}(?: ?[(\[](?:dot|DOT)[)\]] ?|\.)[A-Za-z]{{2,24}}"

# Gazetteers: telephone area codes that name no subscriber region, common mail hosts, bank countries
TOLL_FREE = ("800", "833", "844", "855", "866", "877", "888", "900")
MAIL_HOSTS = ("gmail", "yahoo", "hotmail", "outlook", "icloud", "aol", "gmx", "web", "proton", "example")
BANK_LANDS = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CUES = ("call", "phone", "tel", "mobile", "fax", "contact", "mail", "ssn", "social security", "iban", "account", "card", "visa",
        "anruf", "telefon", "konto", "appel", "téléphone", "compte", "llama", "teléfono", "cuenta", "tarjeta")
COUNTER_CUES = ("order", "invoice", "version", "page", "isbn", "issn", "serial", "part no", "model", "ticket", "doi", "rfc")

MATCH = "struct<s:int,e:int,t:string>"
SPAN = "struct<s:int,o:int,e:int,v:array<int>,base:boolean>"
EACH = 256
SEEN = 32  # characters before a span that the context labeler sees


def held_as(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once: an expression named inside a lambda is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column) -> Column:
    """An array as an array of arrays of EACH elements; an empty one as one empty run. Takes a column or a lambda's variable."""
    last = F.greatest(F.floor((F.size(items) - 1) / EACH), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * EACH + 1, EACH))


def walk(items: Column, start: Column, kind: str, step: Callable, near: Callable | None = None) -> Column:
    """Go through an array from the left: (pos, out), where step(pos, item, near) gives the next pos and an array to add to out.

    Arrays grow by copying, and a place in a text is found by counting from its start, so both would be quadratic in
    texts with very many spans. Here a run of EACH elements fills an array of its own, and near(pos, run) is
    computed once for the run: a part of the text, say."""
    def run(held, part):
        around = near(held["pos"], part) if near else F.lit(0)

        def through(own):
            def one(so_far, item):
                pos, more = step(so_far["pos"], item, own)
                return F.struct(pos.alias("pos"), F.concat(so_far["out"], more).alias("out"))

            return F.aggregate(part, F.struct(held["pos"].alias("pos"), F.array().cast(f"array<{kind}>").alias("out")), one)

        return held_as(held_as(around, through), lambda made: F.struct(made["pos"].alias("pos"), F.concat(held["out"], F.array(made["out"])).alias("out")))

    first = F.struct(start.cast("int").alias("pos"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return held_as(items, lambda whole: F.aggregate(runs(whole), first, run, lambda held: F.struct(held["pos"].alias("pos"), F.flatten(held["out"]).alias("out"))))


def spans_of(text: Column, pattern: str, when: Column) -> Column:
    """Matches from the left without overlap, as (s, e, t); none where `when` fails, which costs less than the pattern."""
    none = F.array().cast(f"array<{MATCH}>")
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(pos, x, _):
        s = pos + F.length(x["between"])
        e = s + F.length(x["found"])
        return F.coalesce(e, pos), F.when(x["found"].isNull(), none).otherwise(F.array(F.struct(s.alias("s"), e.alias("e"), x["found"].alias("t"))))

    made = walk(F.arrays_zip(between.alias("between"), found.alias("found")), F.lit(0), MATCH, step)["out"]
    return F.coalesce(F.when(when, made), none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    figures = F.filter(F.split(F.reverse(number), ""), lambda x: x != "")
    worth = F.transform(figures, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def said(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, value: Column, before: Column) -> Column:
    """What the four labelers say of a span: 1 for personal data, -1 against, 0 for nothing."""
    never, number = F.lit(False), digits(value)
    low = F.lower(before)
    cue, counter = low.rlike("|".join(CUES)), low.rlike("|".join(COUNTER_CUES))
    context = said(cue & ~counter, counter & ~cue)
    worn = said(never, value.rlike(r"([0-9])\1{6}|0123456|1234567|[0-9] ?000 ?000"))
    if kind in ("email", "mail"):
        strict = said(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._+-]*(@| ?[(\[]).*[A-Za-z]{2,}$"), value.rlike(r"\.\.|^[._%+-]"))
        host = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z0-9-]+$", 1))
        known = said(host.isin(*MAIL_HOSTS), F.lower(value).rlike("noreply|no-reply|postmaster|webmaster"))
    elif kind == "ip":
        strict = said(value.rlike(r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$"), value.rlike(r"(^|\.)0[0-9]"))
        known = said(never, value.rlike(r"^(0|10|127|255|192\.168|169\.254)\."))
    elif kind == "card":
        strict = said(F.length(number).isin(15, 16), F.length(number) == 14)
        known = said(number.rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6)"), number.rlike("^[0189]"))
    elif kind in ("phone", "tel"):
        strict = said(value.rlike(r"^(\+[0-9]{1,3} ?)?(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"), value.rlike(r"^[0-9]{3}\.[0-9]{3}\."))
        area = F.substring(F.when(F.length(number) > 10, F.substring(number, -10, 10)).otherwise(number), 1, 3)
        known = said(area.rlike("^[2-9]") & ~area.isin(*TOLL_FREE), area.isin(*TOLL_FREE) | area.rlike("^[01]"))
    elif kind == "ssn":
        strict = said(value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), value.rlike(r"^(000|666|9)|-00-|-0000$"))
        known = said(never, value.isin("078-05-1120", "219-09-9999", "123-45-6789"))
    else:
        strict = said(F.length(value).between(15, 34) & (F.length(number) >= 10), F.length(number) < 8)
        known = said(F.substring(value, 1, 2).isin(*BANK_LANDS), ~F.substring(value, 1, 2).isin(*BANK_LANDS))
    return F.array(strict, known, context, worn)


def word_number(word: Column) -> Column:
    """A word hashed to 1 to 15; 0 if there is none."""
    return F.when(word == "", 0).otherwise(F.pmod(F.xxhash64(F.lower(word)), F.lit(VALUES - 1)).cast("int") + 1)


def features(value: Column, before: Column, after: Column) -> Column:
    """Numbers 0 to 15 that describe a span: length, separators, different digits, and the words on both sides."""
    marks = sum(F.when(value.contains(mark), 1 << i).otherwise(0) for i, mark in enumerate("-. ("))
    figures = F.size(F.array_distinct(F.filter(F.split(digits(value), ""), lambda x: x != "")))
    return F.array(
        F.least(F.floor(F.length(value) / 3), F.lit(VALUES - 1)).cast("int"), marks, figures,
        word_number(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*+$", 1)), word_number(F.regexp_extract(after, r"^[^\p{L}]*+(\p{L}+)", 1)))


def spans_with_votes(text: Column, kind: str, found: Column) -> Column:
    def span(m, near):
        before = F.substring(near["text"], F.greatest(m["s"] - near["at"] - (SEEN - 1), F.lit(1)), F.least(m["s"], F.lit(SEEN)))
        after = F.substring(near["text"], m["e"] - near["at"] + 1, F.lit(SEEN))
        seen = F.concat(votes(kind, m["t"], before), features(m["t"], before, after))
        return F.struct(m["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), m["e"].alias("e"), seen.alias("v"), F.lit(kind in BASE).alias("base"))

    def judged(part):
        at = F.greatest(F.get(part, F.lit(0))["s"] - SEEN, F.lit(0))
        near = F.struct(at.alias("at"), F.substring(text, at + 1, F.get(part, F.size(part) - 1)["e"] - at + SEEN).alias("text"))
        return held_as(near, lambda own: F.transform(part, lambda m: span(m, own)))

    good = F.filter(found, lambda m: valid(kind, m["t"]))
    return held_as(good, lambda whole: F.flatten(F.transform(runs(whole), judged))).cast(f"array<{SPAN}>")


def candidates(text: Column) -> Column:
    """All candidate spans with their votes, as an array in the order of start, kind and end."""
    has = lambda p: text.rlike(p)
    at = text.contains("@")
    numbers = F.regexp_replace(text, STRAY_GAP, "x")
    where = {
        "email": spans_of(F.regexp_replace(text, STRAY_DOT, "_"), EMAIL, at),
        "ip": spans_of(text, IP, has(r"[0-9]\.[0-9]")),
        "card": spans_of(numbers, CARD, has(r"[0-9][0-9 -]{13}")),
        "phone": spans_of(text, PHONE, has(r"\+[0-9]")),
        "tel": spans_of(text, TEL, has(r"[0-9]{3}[ .-][0-9]{4}")),
        "ssn": spans_of(text, SSN, has(r"-[0-9]{2}-")),
        "iban": spans_of(text, IBAN, has(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}")),
        "mail": spans_of(text, MAIL, has(r"[(\[](?:at|AT)[)\]]")),
    }
    out = [spans_with_votes(text, kind, found) for kind, found in where.items()]
    return F.array_sort(F.concat(*out))


@dataclass
class SpanModel:
    intercepts: list[float]
    yes: list[float]             # of each labeler, over all kinds seen
    no: list[float]
    kinds: list[float] | None = None   # by kind, labeler and vote (-1, 0, 1)
    shape: list[float] | None = None   # by kind, feature and value

    def accepts(self, span: Column) -> Column:
        def weight(table: list[float], at: Column) -> Column:
            return F.element_at(F.array(*[F.lit(float(w)) for w in table]), at + 1)

        z = weight(self.intercepts, span["o"])
        for j in range(LABELERS if self.kinds else 0):
            z = z + weight(self.kinds, (span["o"] * LABELERS + j) * 3 + F.element_at(span["v"], j + 1) + 1)
        if self.shape:
            for f in range(FEATURES):
                z = z + weight(self.shape, (span["o"] * FEATURES + f) * VALUES + F.element_at(span["v"], LABELERS + f + 1))
        return z >= 0


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


Chances = list[tuple[float, float, float, float]]


def weights_of(chances: Chances) -> tuple[float, list[float], list[float]]:
    """Log-odds of a span without votes, and what each labeler's yes and objection add to them. `chances` has for each labeler
    those of a yes, then of an objection, if a span is personal and if not; a yes never counts against, nor an objection for."""
    silent = [max(0.0, math.log((1 - n1) / (1 - n0))) for _, _, n1, n0 in chances]
    yes = [max(0.0, math.log(y1 / y0)) for y1, y0, _, _ in chances]
    no = [min(0.0, math.log(n1 / n0)) - s for (_, _, n1, n0), s in zip(chances, silent, strict=True)]
    return sum(silent), yes, no


def evidence(v: tuple[int, ...], chances: Chances) -> float:
    """Log-odds that a span with these votes is personal."""
    base, yes, no = weights_of(chances)
    return base + sum(yes[j] if vote == 1 else no[j] if vote == -1 else 0.0 for j, vote in enumerate(v))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> dict[int, Chances]:
    """Expectation-maximisation over vote patterns (kind, votes, count): each kind's chances for each labeler, shrunk to YES and
    NO. A kind's spans together weigh STRENGTH at most, as much as the stated chances do for either truth."""
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        scale = min(1.0, STRENGTH / sum(n for _, n in own))
        chances: Chances = [(*YES[j], *NO[j]) for j in range(LABELERS)]
        for _ in range(rounds):
            held = [(v, scale * n * p, scale * n * (1 - p)) for (v, n), p in zip(own, [sigmoid(evidence(v, chances)) for v, _ in own], strict=True)]
            totals = STRENGTH + sum(a for _, a, _ in held), STRENGTH + sum(b for _, _, b in held)

            def chance(j: int, vote: int, before: tuple[float, float], held=held, totals=totals) -> tuple[float, float]:
                return tuple((STRENGTH * before[t] + sum(h[1 + t] for h in held if h[0][j] == vote)) / totals[t] for t in (0, 1))

            chances = [(*chance(j, 1, YES[j]), *chance(j, -1, NO[j])) for j in range(LABELERS)]
        out[kind] = chances
    return out


def aggregate_votes(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40) -> list[float]:
    """The posterior of each vote pattern."""
    found = reliabilities(patterns, rounds)
    return [sigmoid(evidence(v, found[k])) for k, v, _ in patterns]


def train(patterns: list[tuple[int, tuple[int, ...], int]]) -> SpanModel:
    """The classifier's weights of votes, kind by kind; a kind without spans is not accepted."""
    model = SpanModel([-1.0] * len(KINDS), [0.0] * LABELERS, [0.0] * LABELERS, [0.0] * (len(KINDS) * LABELERS * 3))
    found = reliabilities(patterns)
    for kind, chances in found.items():
        model.intercepts[kind], yes, no = weights_of(chances)
        for j in range(LABELERS):
            at = (kind * LABELERS + j) * 3
            model.kinds[at:at + 3] = [no[j], 0.0, yes[j]]
            model.yes[j] += yes[j] / len(found)
            model.no[j] += no[j] / len(found)
    return model


def pattern_number(span: Column) -> Column:
    """A span's kind and votes as one number from 0."""
    out = span["o"]
    for j in range(LABELERS):
        out = out * 3 + F.element_at(span["v"], j + 1) + 1
    return out


def learn(found: DataFrame) -> SpanModel:
    """Train the classifier on the votes and features in a column `found`."""
    spans = found.select(F.explode("found").alias("x"))
    counted = spans.groupBy("x.o", F.slice("x.v", 1, LABELERS).alias("v")).agg(F.count("*").alias("n"))
    patterns = sorted((r["o"], tuple(r["v"]), r["n"]) for r in counted.collect())  # at most kinds x 3^labelers rows
    model = train(patterns)
    if not patterns:
        return model
    # what the posteriors teach about the spans themselves
    table = [0.0] * (len(KINDS) * 3**LABELERS)
    for (k, v, _), p in zip(patterns, aggregate_votes(patterns), strict=True):
        at = k
        for vote in v:
            at = at * 3 + vote + 1
        table[at] = p
    posterior = F.element_at(F.array(*[F.lit(p) for p in table]), pattern_number(F.col("x")) + 1)
    each = F.posexplode(F.slice("x.v", LABELERS + 1, FEATURES)).alias("f", "value")
    sums = spans.select("x.o", posterior.alias("p"), each).groupBy("o", "f", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    model.shape = shape_weights([(r["o"], r["f"], r["value"], r["yes"], r["no"]) for r in sums.collect()])  # at most kinds x features x values rows
    return model


def shape_weights(sums: list[tuple[int, int, int, float, float]]) -> list[float]:
    """Log-odds of each value of a feature, from sums of posteriors (kind, feature, value, personal, not). Shrunk: STRENGTH spans of
    either truth are taken to have the value as often as all spans do, and none moves the odds by more than MOST_SHAPE."""
    out = [0.0] * (len(KINDS) * FEATURES * VALUES)
    totals: dict[tuple[int, int], list[float]] = {}
    for k, f, _, yes, no in sums:
        held = totals.setdefault((k, f), [0.0, 0.0])
        held[0], held[1] = held[0] + yes, held[1] + no
    for k, f, value, yes, no in sums:
        all_yes, all_no = totals[k, f]
        share = STRENGTH * (yes + no) / (all_yes + all_no)
        w = math.log((yes + share) / (all_yes + STRENGTH)) - math.log((no + share) / (all_no + STRENGTH))
        out[(k * FEATURES + f) * VALUES + value] = max(-MOST_SHAPE, min(MOST_SHAPE, w))
    return out


def accepted(found: Column, model: SpanModel) -> Column:
    """Base spans, and accepted candidates that overlap none of them. `found` is a column, in the order of starts."""
    none = F.array().cast(f"array<{SPAN}>")

    def forward(reach, x, _):  # base spans that start earlier
        keep = x["base"] | (model.accepts(x) & (x["s"] >= reach))
        return F.when(x["base"], F.greatest(reach, x["e"])).otherwise(reach), F.when(keep, F.array(x)).otherwise(none)

    def backward(ahead, x, _):  # base spans that start later
        return F.when(x["base"], F.least(ahead, x["s"])).otherwise(ahead), F.when(x["base"] | (x["e"] <= ahead), F.array(x)).otherwise(none)

    clear = walk(found, F.lit(0), SPAN, forward)["out"]
    clear = F.reverse(walk(F.reverse(clear), F.lit(2**31 - 1), SPAN, backward)["out"])
    return F.when(F.exists(found, lambda x: ~x["base"]), clear).otherwise(found)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def number_of(found: Column, kind: int) -> Column:
    return F.size(F.filter(found, lambda x: x["base"] & (x["o"] == kind))).cast("long")


def find_personal(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, number of base spans of each kind, base and all spans as kind:start:end joined by commas."""
    rows = pick(df, id=id, text=text).select("id", F.coalesce("text", F.lit("")).alias("text"))
    found = staged(rows.select("id", candidates(F.col("text")).alias("found")), "spans")
    model = learn(found)
    base = F.filter("found", lambda x: x["base"])
    number = [number_of(F.col("found"), k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    out = found.select("id", *number, joined(base).alias("base"), joined(accepted(F.col("found"), model)).alias("spans"))
    return out.withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256))


def redact(df: DataFrame, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The table with every span of personal data replaced by its kind in angle brackets, all else as it was.

    `n_chars` names a column with the text's length, which follows."""
    rows = numbered(df)
    at = numbered_name(df, text)
    found = staged(rows.withColumn("found", F.coalesce(candidates(F.col(at)), F.array().cast(f"array<{SPAN}>"))), "spans")
    spans = accepted(F.col("found"), learn(found.select("found")))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    body = F.col(at)

    def step(pos, x, near):
        gap = F.substring(near["text"], pos - near["at"] + 1, x["s"] - pos)
        return F.greatest(pos, x["e"]), F.when(x["s"] >= pos, F.array(gap, F.element_at(names, x["o"] + 1))).otherwise(F.array().cast("array<string>"))

    def near(pos, part):
        return F.struct(pos.alias("at"), F.substring(body, pos + 1, F.greatest(F.get(part, F.size(part) - 1)["s"] - pos, F.lit(0))).alias("text"))

    cut = walk(F.col("spans"), F.lit(0), "string", step, near)
    clean = held_as(cut, lambda held: F.concat(F.array_join(held["out"], ""), F.substring(body, held["pos"] + 1, F.length(body))))
    touched = F.size("spans") > 0
    # the new text in a column of its own, so that its length is that of the text made
    made = found.withColumn("spans", spans).withColumn("clean", F.when(touched, clean).otherwise(body))
    columns = []
    for name, own in zip(df.columns, rows.columns, strict=True):
        kind = rows.schema[own].dataType
        new = F.col("clean") if own == at else F.when(touched, F.length("clean").cast(kind)).otherwise(F.col(own)) if name == n_chars else F.col(own)
        columns.append(new.alias(own))
    return made.select(*columns).toDF(*df.columns)
