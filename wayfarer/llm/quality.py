"""Quality: a linear-chain conditional random field labels each line good or bad.

A line is described by counts over its bytes and by the same counts of the
lines before and after it.  Training takes whole labelled documents whose
lines all carry the document's label (weak labels) and maximises the
conditional likelihood.  A document's score is the mean of its lines' marginal
probabilities of being good, weighted by their lengths, from one
forward-backward pass over all of its lines.

Defined results: null and empty texts are one empty line; repeated rows are
scored alike; with no labelled row, or with one class only, the score is the
share of label 1 (0.5 without labels).  Extra columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled documents that the field is fitted on, about.
TRAIN_ROWS = 2500


def _class(text: str = "", *more: range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*map(ord, text), *(x for r in more for x in r)]] = True
    return out


_UPPER = _class("", range(65, 91))
_LETTER = _class("", range(65, 91), range(97, 123), range(128, 256))
_DIGIT = _class("", range(48, 58))
_STOP = _class(".,;:'\"-()")
_SHOUT = _class("!?")
_SIGN = _class("#$%&*|<>=@~^_+\\/{}[]`")
NAMES = ("size", "letters", "capitals", "digits", "stops", "shouts", "signs", "wide", "words", "word_length", "repeated", "distinct", "seen", "capital_start", "stop_end", "marked_words")


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lines of each row, bytes of every line."""
    n, total = len(off) - 1, len(raw)
    # a line ends after a line feed or with its row; a row has one line at least
    cut = np.zeros(total + 1, bool)
    cut[1:] = raw == 10
    cut[off] = False
    inner = np.flatnonzero(cut)
    start = np.sort(np.concatenate([off[:-1], inner]), kind="stable")
    lines = np.bincount(np.searchsorted(off[:-1], inner, "right") - 1, minlength=n) + 1
    first = np.zeros(n + 1, np.int64)
    np.cumsum(lines, out=first[1:])
    # empty rows share their offset with the next row: rebuild starts row by row
    if (np.diff(off) == 0).any():
        start = np.empty(first[-1], np.int64)
        start[first[:-1]] = off[:-1]
        other = np.ones(first[-1], bool)
        other[first[:-1]] = False
        start[other] = inner
    end = np.empty_like(start)
    end[:-1] = start[1:]
    end[first[1:] - 1] = off[1:]
    size = end - start

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(total + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c

    x = np.zeros((len(start), len(NAMES)), np.float64)
    whole = np.maximum(size, 1)
    letters = count(_LETTER[raw])
    span = lambda c: c[end] - c[start]
    x[:, 0] = np.log1p(size)
    x[:, 1] = span(letters) / whole
    x[:, 2] = span(count(_UPPER[raw])) / np.maximum(span(letters), 1)
    for k, table in ((3, _DIGIT), (4, _STOP), (5, _SHOUT), (6, _SIGN)):
        x[:, k] = span(count(table[raw])) / whole
    x[:, 7] = span(count(raw >= 128)) / whole
    words = C.Words(raw, off)
    of = np.searchsorted(start, words.start, "right") - 1
    if (size == 0).any():  # the last of the lines that start at one place is the one that has bytes
        of = np.minimum(of, len(start) - 1)
    number = np.bincount(of, minlength=len(start))
    some = np.maximum(number, 1)
    x[:, 8] = np.log1p(number)
    x[:, 9] = np.bincount(of, words.end - words.start, minlength=len(start)) / some
    if len(of) > 1:
        again = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
        x[:, 10] = np.bincount(of[1:][again], minlength=len(start)) / some
    key = C.mix(words.hash ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, one = np.unique(key, return_index=True)
    x[:, 11] = np.bincount(of[one], minlength=len(start)) / some
    row = np.repeat(np.arange(n), lines)
    h = C.text_hash(raw, C.EXACT, start, np.where((size > 0) & (raw[np.maximum(end - 1, 0)] == 10), end - 1, end)) if total else np.zeros(len(start), np.uint64)
    _, one = np.unique(C.mix(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    x[:, 12] = 1
    x[one, 12] = 0
    if len(of):
        at = np.searchsorted(of, np.arange(len(start)))
        has = number > 0
        x[has, 13] = _UPPER[raw[words.start[at[has]]]]
        x[has, 14] = raw[words.end[at[has] + number[has] - 1] - 1] == 46
        last = raw[words.end - 1]
        x[:, 15] = np.bincount(of[_SIGN[last] | _SHOUT[last]], minlength=len(start)) / some
    return x, lines, size


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its row; a constant last."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    end = np.cumsum(lines)
    before[end - lines] = 0
    after[end - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


class Chain:
    """Two-state linear-chain field; rows of all lengths advance together, position by position."""

    def __init__(self, weight: np.ndarray, bend: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weight, self.bend, self.mean, self.scale = weight, bend, mean, scale

    def marginals(self, x: np.ndarray, lines: np.ndarray, pairs: bool = False):
        """Probability that each line is good; with ``pairs`` also the log normaliser and expected transitions."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weight
        order = np.argsort(-lines, kind="stable")
        begin = (np.cumsum(lines) - lines)[order]
        length = lines[order]
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        alpha, beta = np.empty((len(x), 2)), np.zeros((len(x), 2))
        alpha[begin] = emit[begin]
        for t in range(1, len(active)):
            at = begin[: active[t]] + t
            a = alpha[at - 1]
            alpha[at] = emit[at] + np.logaddexp(a[:, :1] + self.bend[0], a[:, 1:] + self.bend[1])
        for t in range(len(active) - 1, 0, -1):
            at = begin[: active[t]] + t
            b = beta[at] + emit[at]
            beta[at - 1] = np.logaddexp(self.bend[:, 0] + b[:, :1], self.bend[:, 1] + b[:, 1:])
        both = alpha + beta
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        if not pairs:
            return p
        z = np.repeat(np.logaddexp(both[np.cumsum(lines) - lines, 0], both[np.cumsum(lines) - lines, 1]), lines)
        inner = np.ones(len(x), bool)
        inner[np.cumsum(lines) - lines] = False
        at = np.flatnonzero(inner)
        right = beta[at] + emit[at] - z[at, None]
        return p, np.exp(alpha[at - 1][:, :, None] + self.bend[None] + right[:, None, :])

    @staticmethod
    def fit(x: np.ndarray, lines: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.08, shrink: float = 1e-3) -> Chain:
        mean, scale = x.mean(0), x.std(0)
        mean[-1], scale[-1] = 0, 1
        scale[scale < 1e-9] = 1
        z = (x - mean) / scale
        chain = Chain(np.zeros(z.shape[1]), np.zeros((2, 2)), mean, scale)
        target = np.repeat(y, lines).astype(float)
        m = v = 0.0
        good = np.repeat(y, np.maximum(lines - 1, 0))
        seen = np.zeros((2, 2))
        seen[0, 0], seen[1, 1] = (good == 0).sum(), (good == 1).sum()
        for k in range(1, rounds + 1):
            p, pair = chain.marginals(z, lines, pairs=True)
            g = np.concatenate([z.T @ (target - p), (seen - pair.sum(0)).ravel()]) / len(lines)
            g -= shrink * np.concatenate([chain.weight, chain.bend.ravel()]) * 10
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
            chain.weight = chain.weight + step[:-4]
            chain.bend = chain.bend + step[-4:].reshape(2, 2)
        return chain

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, lines, size = line_features(raw, off)
        p = self.marginals((with_neighbours(x, lines) - self.mean) / self.scale, lines)
        row, w = np.repeat(np.arange(len(lines)), lines), size + 1.0
        return np.bincount(row, p * w, minlength=len(lines)) / np.bincount(row, w, minlength=len(lines))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = C.flatten(batch.column("text"))
        for i, j in C.steps(off):
            x, lines, _ = line_features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            at = np.concatenate([[0], np.cumsum(lines)]) * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column("y")[i:j], C.list_array(x.ravel(), at)], ["y", "x"])


class QualityModel:
    """fit() learns from labelled documents; score() adds a column to documents, in place of one of its name."""

    def __init__(self, train_rows: int = TRAIN_ROWS, seed: int = 29):
        self.train_rows, self.seed, self.chain, self.prior = train_rows, seed, None, 0.5

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityModel:
        """``labels``: (doc_id, y) with y in 0, 1.  Takes about ``train_rows`` of them, half of each class, drawn by a hash of the id."""
        labels = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
        n = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.prior = n.get(1, 0) / sum(n.values()) if n else 0.5
        draw = F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1_000_000))
        share = {y: int(1_000_000 * min(1.0, self.train_rows / 2 / k)) for y, k in n.items()}
        limit = F.when(F.col("y") == 1, share.get(1, 0)).otherwise(share.get(0, 0))
        # a bounded sample of ids: its expected size is train_rows
        rows = C.small_batches(docs).select("doc_id", "text").join(F.broadcast(labels.where(draw <= limit)), "doc_id").select("y", "text")
        got = rows.mapInArrow(C.trimmed(_described), "y int, x array<double>").toArrow()
        y = got.column("y").to_numpy()
        if len(np.unique(y)) < 2:
            return self
        x, at = C.flatten_list(got.column("x"))
        lines = np.diff(at) // len(NAMES)
        x = x.reshape(-1, len(NAMES))
        # the rows come in any order: sort them so that reruns add up alike
        key = np.lexsort((x[at[:-1] // len(NAMES), 0], x[at[:-1] // len(NAMES), 1], lines, y))
        pick = np.concatenate([np.arange(at[i] // len(NAMES), at[i + 1] // len(NAMES)) for i in key])
        x, lines, y = x[pick], lines[key], y[key]
        self.chain = Chain.fit(with_neighbours(x, lines), lines, y)
        return self

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        if self.chain is None:
            return docs.withColumn(name, F.lit(float(self.prior)))
        chain = self.chain

        @F.arrow_udf("double")
        def scan(column: pa.Array) -> pa.Array:
            raw, off = C.flatten(column)
            got = [chain.score(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in C.steps(off)]
            C.trim()
            return pa.array(np.concatenate(got) if got else np.zeros(0))

        return docs.withColumn(name, scan("text"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from ids of remainders other than 0."""
    scored = scored_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", (C.crc_mod(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scored_documents(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """The documents with their quality in the column ``name``."""
    known = labels.where(C.crc_mod(5) != 0).select("doc_id", F.col("quality").alias("y"))
    return QualityModel().fit(docs, known).score(docs, name)
