"""Language identification by unigram piece models, summed over every segmentation.

Each language has a probability for every piece of a fixed public vocabulary (all its byte pieces, and every
single byte, so that any text can be cut). A word's probability is the sum
over all ways to cut it into pieces, which a forward pass computes left to right; expectation-
maximisation with the matching backward pass learns the probabilities. A text's score in a language
is the sum of its words' log-probabilities, and the answer is the language with the highest
posterior under equal priors. How far that language beats a background in which all pieces are equally likely tells texts in no learned
language (other scripts, keyboard noise) from the rest: the posterior alone compares learned languages only.

Words are runs of letters, lower-cased, with a space before them; a run of more than 32 letters
continues as further words. Ties go to the smaller language code. A text that is null, empty or without letters
is `und` with score 0. Rows are judged one by one: repeated rows get the same answer, an empty table
gives an empty result, and extra columns are ignored whatever their names."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import map_text, pick

CODED = 8   # bytes that fit in a number; longer pieces are looked up by hash and compared
FACTOR = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 16
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    found = re.findall(r"[^\W\d_]{1,32}", text.lower()) if text else []
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]  # not of signs like ² or ½ alone


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces, with every single byte, by length."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(line.split()[0]) for line in lines if line.strip()}
    return sorted(pieces | {bytes([b]) for b in range(256)}, key=lambda p: (len(p), p))


def rolled(pieces: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of equally long pieces, one a row."""
    code = np.zeros(len(pieces), np.uint64)
    for column in pieces.T:
        code = code * FACTOR + column.astype(np.uint64) + np.uint64(1)
    return code


class Lattice:
    """Where each piece of the vocabulary occurs in words of one length, as row numbers of the probability table.

    Pieces are found by number, up to eight bytes, or by rolling hash, and then their bytes are compared. Of pieces of
    equal hash, which the comparison would tell apart, one could be missed; the vocabularies at hand have none."""

    def __init__(self, pieces: list[bytes]):
        self.none = len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(len(p), []).append(i)
        self.known = {}
        for size, own in by_size.items():
            if size <= CODED:
                codes, spelt = np.array([int.from_bytes(pieces[i], "big") for i in own], np.uint64), None
            else:
                spelt = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(len(own), size)
                codes = rolled(spelt)
            order = np.argsort(codes, kind="stable")
            self.known[size] = codes[order], np.array(own, np.int32)[order], None if spelt is None else spelt[order]

    def rows(self, letters: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length k that the vocabulary has, a table over (start, word) of row numbers; `none` where no piece starts."""
        out, code = {}, letters.astype(np.uint64)
        hashed = code + np.uint64(1)
        for k in range(1, letters.shape[0] + 1):
            if 1 < k <= CODED:
                code = (code[:-1] << np.uint64(8)) | letters[k - 1 :].astype(np.uint64)
            if k > 1:
                hashed = hashed[:-1] * FACTOR + letters[k - 1 :].astype(np.uint64) + np.uint64(1)
            if k not in self.known:
                continue
            codes, numbers, spelt = self.known[k]
            sought = code if k <= CODED else hashed
            at = np.minimum(np.searchsorted(codes, sought), len(codes) - 1)
            hit = codes[at] == sought
            if spelt is not None and hit.any():
                start, word = np.nonzero(hit)
                seen = letters[start[:, None] + np.arange(k), word[:, None]]
                hit[start, word] = (seen == spelt[at[start, word]]).all(axis=1)
            if k == 1 or hit.any():
                out[k] = np.where(hit, numbers[at], self.none).astype(np.int32)
        return out


def forward(rows: dict[int, np.ndarray], table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward sums (position by word by language, rescaled along the way) and the log of what was scaled out."""
    size, n = rows[1].shape
    longest = max(rows)
    alpha = [np.ones((n, table.shape[1]))]
    logs = np.zeros((n, table.shape[1]))
    for i in range(1, size + 1):
        total = alpha[i - 1] * table[rows[1][i - 1]]
        for k, at in rows.items():
            if 1 < k <= i:
                total += alpha[i - k] * table[at[i - k]]
        alpha.append(total)
        if i % 16 == 0:
            for j in range(max(0, i - longest + 1), i):
                alpha[j] = alpha[j] / total
            logs += np.log(total)
            alpha[i] = np.ones_like(total)
    return alpha, logs


def by_length(words: list[bytes]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def letters_of(words: list[bytes], size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size).T)


def log_probabilities(words: list[bytes], lattice: Lattice, table: np.ndarray) -> np.ndarray:
    """The log-probability of each word in each language, over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    for size, group in by_length(words).items():
        step = max(1, CHUNK // size)
        for start in range(0, len(group), step):
            part = group[start : start + step]
            alpha, logs = forward(lattice.rows(letters_of([words[i] for i in part], size)), table)
            out[part] = np.log(alpha[-1]) + logs
    return out


def expected_counts(rows: dict[int, np.ndarray], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How often each piece is used over all segmentations of the words, weighted by their probability.

    Here words have at most 129 bytes and one language, so a plain scale per position suffices."""
    size, n = rows[1].shape
    longest = max(rows)
    alpha, beta = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    alpha[0] = beta[size] = 1.0
    scale = np.ones((size + 1, n))
    for i in range(1, size + 1):
        running = np.ones(n)
        for k in range(1, min(longest, i) + 1):
            running = running * scale[i - k + 1] if k > 1 else running
            if k in rows:
                alpha[i] += alpha[i - k] * table[rows[k][i - k]] * running
        scale[i] = 1.0 / alpha[i]
        alpha[i] = 1.0
    # alpha is 1 everywhere after scaling; beta takes the same scales, so a piece's share is alpha * p * scales * beta
    used = np.zeros(len(table))
    for i in range(size - 1, -1, -1):
        running = np.ones(n)
        for k in range(1, min(longest, size - i) + 1):
            running = running * scale[i + k]
            if k not in rows:
                continue
            share = table[rows[k][i]] * running * beta[i + k]
            beta[i] += share
            used += np.bincount(rows[k][i], weights=share * counts, minlength=len(table))
    return used


def learn_pieces(words: list[bytes], counts: np.ndarray, lattice: Lattice, rounds: int, smoothing: float) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation, the last row zero."""
    chunks = []
    for size, group in by_length(words).items():
        step = max(1, CHUNK // size)
        for start in range(0, len(group), step):
            part = group[start : start + step]
            chunks.append((lattice.rows(letters_of([words[i] for i in part], size)), counts[part]))
    used = np.zeros(lattice.none + 1)
    for rows, weight in chunks:  # to begin with, every occurrence counts
        for table in rows.values():
            used += np.bincount(table.ravel(), weights=np.broadcast_to(weight, table.shape).ravel(), minlength=len(used))
    for _ in range(rounds + 1):
        used[-1] = 0
        table = used + smoothing
        table[-1] = 0
        table /= table.sum()
        used = np.zeros(len(table))
        for rows, weight in chunks:
            used += expected_counts(rows, weight, table)
    used[-1] = 0
    table = used + smoothing
    table[-1] = 0
    return table / table.sum()


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[bytes]
    table: np.ndarray  # pieces + 1 rows, a column for each language


def train(labelled: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", lang: str = "lang",
          rows_per_language: int = 300, most_rows: int = 6000, longest_text: int = 20_000,
          rounds: int = 3, smoothing: float = 0.01) -> LanguageModel:
    """Learn one piece model for each language of the labelled rows.

    The fit reads a bounded sample: for each language the rows with the smallest hash, at most
    `rows_per_language`, at most `most_rows` over all, of texts of up to `longest_text` characters.
    Each language is learned in a task of its own."""
    rows = pick(labelled, id=id, text=text, lang=lang).where("lang is not null and text is not null and length(text) between 1 and " f"{longest_text}")
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pieces = read_pieces(vocabulary)
    if not sizes:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    each = max(1, min(rows_per_language, most_rows // len(sizes)))
    # a threshold on the hash leaves a little more than the wanted rows, which a window then cuts exactly
    rate = F.lit(1.0)
    for name, n in sizes.items():
        rate = F.when(F.col("lang") == name, min(1.0, 1.5 * each / n + 20 / n)).otherwise(rate)
    few = rows.where((F.pmod(F.col("h"), F.lit(1_000_003)) / 1_000_003.0) <= rate)
    order = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1_000_003)), "h", "id")
    chosen = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("lang", "text")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        counts: dict[str, int] = {}
        for body in group["text"]:
            for w in words_of(body):
                counts[w] = counts.get(w, 0) + 1
        words = [b" " + w.encode("utf-8", "replace") for w in counts]
        lattice = Lattice(pieces)
        table = learn_pieces(words, np.array(list(counts.values()), float), lattice, rounds, smoothing)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "p": [table[:-1].tolist()]})

    learned = sorted(chosen.groupBy("lang").applyInPandas(learn, "lang string, p array<double>").collect())
    table = np.zeros((len(pieces) + 1, len(learned)))
    for j, row in enumerate(learned):
        table[:-1, j] = row["p"]
    return LanguageModel([r["lang"] for r in learned], pieces, table)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None,
             names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its posterior probability to every row, and under a third name how far the language beats
    equally likely pieces, in nats a byte. A column of the input with one of these names gives way to the result."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.table))  # pieces times languages, whatever the input
    fields = [T.StructField(n, T.StringType() if i == 0 else T.DoubleType()) for i, n in enumerate(names)]

    def begin():
        languages, pieces, table = shared.value
        lattice = Lattice(pieces)
        if len(names) > 2:  # the background is one more model, in the last column
            even = np.append(np.full(len(pieces), 1 / len(pieces)), 0.0)
            table = np.column_stack([table, even])

        def work(texts):
            seen: dict[str, int] = {}
            held = [[seen.setdefault(w, len(seen)) for w in words_of(body)] for body in texts]
            spelt = [b" " + w.encode("utf-8", "replace") for w in seen]
            logs, sizes = log_probabilities(spelt, lattice, table), np.array([len(w) for w in spelt])
            langs, scores, gains = [], [], []
            for own in held:
                if not own or not languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    gains.append(0.0)
                    continue
                whole = logs[own].sum(axis=0)
                total = whole[: len(languages)]
                best = int(total.argmax())
                langs.append(languages[best])
                scores.append(min(1.0, float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())))
                gains.append(float((total[best] - whole[-1]) / sizes[own].sum()))
            return [langs, scores, gains][: len(names)]

        return work

    return map_text(df, text, fields, begin, [c for c in df.columns if c != text and c not in names] if keep is None else keep)
