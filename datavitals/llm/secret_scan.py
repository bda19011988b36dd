"""Secrets in texts: fixed patterns, and strings that a tokenizer cannot compress.

A byte-pair vocabulary covers natural words and identifiers with few tokens, and random strings with
many. A run of key characters, 20 or longer and with a letter in it, is reported as `random` if it has
fewer than `most_ratio` characters per token. Words glued to a secret (NAME=VALUE, paths, links) would
raise its ratio, so a run that passes is cut at `/ = - _ +`, and stretches of its parts that have
fewer characters per token, and `shortest` characters, are reported by themselves. Base spans, known digests (hexadecimal parts of 32, 40,
56, 64, 96 or 128) and UUIDs are taken out of a run first.

Joints are not counted, neither as characters nor as tokens, so that identifiers pass if their words compress;
they count only in a whole run that has digits and a word of letters and digits or another joint than `_ - / .`.
Digits alone are a number, not a secret.

Base patterns match from the left without overlap, each kind by itself; a match that fails its length
is dropped and not tried again. Spans are in code points, the end exclusive; the span of an
assignment is the whole match.

A null text is an empty one, with no spans. Repeated rows are scanned each; an empty table gives an
empty result; extra columns are ignored."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import byte_encoding, map_text, pick

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more among all runs
WORDS = ("password", "passwd", "secret", "token", "key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
DIGEST = re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}", re.IGNORECASE)
UUID = re.compile(r"(?<![a-z0-9])[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![a-z0-9])", re.ASCII | re.IGNORECASE)
PART = re.compile(r"[A-Za-z0-9]+")
IDENTIFIER = re.compile(r"([A-Za-z]+|[0-9]+)([_./-]+([A-Za-z]+|[0-9]+))*")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def dense(parts: list[tuple[int, int]], weights: list[float], shortest: int) -> list[tuple[int, int]]:
    """Stretches of whole parts, `shortest` characters long at least, whose weights add up to more than zero.

    Each is the heaviest one around: it grows to the right as long as a heavier one ends within `shortest`
    characters of its end. No two overlap, and the time is linear."""
    found, at = [], 0
    while at < len(parts):
        heaviest, total, open_, before = None, 0.0, at, 0.0  # weights before part j, the next part to begin with, weights before that
        low = first = None
        for j in range(at, len(parts)):
            total += weights[j]
            while open_ <= j and parts[j][1] - parts[open_][0] >= shortest:
                if low is None or before <= low:
                    low, first = before, open_
                before += weights[open_]
                open_ += 1
            if low is not None and total > low and (heaviest is None or total - low > heaviest[0]):
                if heaviest and first > heaviest[2]:
                    break
                heaviest = (total - low, first, j)
            elif heaviest and (total <= low or parts[j][1] - parts[heaviest[2]][1] >= shortest):
                break
        if heaviest is None:
            break
        found.append((parts[heaviest[1]][0], parts[heaviest[2]][1]))
        at = heaviest[2] + 1
    return found


def unknown(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What base spans, UUIDs and digests leave of the run from start to end."""
    known = [(max(s, start), min(e, end)) for s, e in taken[bisect_left(taken, start, key=lambda x: x[1]) : bisect_left(taken, end, key=lambda x: x[0])]]
    known += [m.span() for m in UUID.finditer(text, start, end)]
    known += [m.span() for m in PART.finditer(text, start, end) if DIGEST.fullmatch(m[0])]
    left = []
    for s, e in [*sorted(known), (end, end)]:
        if s > start:
            left.append((start, s))
        start = max(start, e)
    return left


def random_spans(text: str, taken: list[tuple[str, int, int]], encode, shortest: int, most_ratio: float) -> list[tuple[str, int, int]]:
    found = []
    if not any(len(w) >= shortest for w in text.split()):
        return found

    def wanted(s: int, e: int) -> bool:
        return e - s >= shortest and any(c.isalpha() for c in text[s:e])

    merged = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    for m in RUN.finditer(text):
        if len(m[0]) < shortest:
            continue
        for start, end in unknown(text, *m.span(), merged):
            run = text[start:end].strip("=-/")
            start = text.index(run, start, end)
            end = start + len(run)
            if not wanted(start, end):
                continue
            parts = [p.span() for p in PART.finditer(text, start, end)]
            weights = [most_ratio * len(encode(text[s:e])) - (e - s) for s, e in parts]
            mixed = any(c.isdigit() for c in run) and not IDENTIFIER.fullmatch(run)
            if mixed and len(run) / len(encode(run)) < most_ratio:
                found.append(("random", start, end))
            else:
                found += [("random", s, e) for s, e in dense(parts, weights, shortest) if wanted(s, e)]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find_secrets(df: DataFrame, ranks: str, id: str = "doc_id", text: str = "text", shortest: int = 20, most_ratio: float = 2.0) -> DataFrame:
    """One row per document: spans found, and the number of each kind.

    `base` holds the base spans alone, `spans` all of them, as kind:start:end joined by commas."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField("base", T.StringType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def begin():
        encode = byte_encoding(ranks).encode_ordinary

        def work(texts):
            rows = []
            for text in texts:
                own = base_spans(text or "")
                more = random_spans(text or "", own, encode, shortest, most_ratio)
                base = joined(own)
                kinds = [k for k, _, _ in own + more]
                rows.append((*[kinds.count(k) for k in KINDS], base, hashlib.sha256(base.encode()).hexdigest(), joined(own + more)))
            return list(zip(*rows, strict=True)) if rows else [[] for _ in fields]

        return work

    return map_text(pick(df, id=id, text=text), "text", fields, begin, ["id"])
