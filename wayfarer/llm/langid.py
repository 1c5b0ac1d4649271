"""Language identification with a string kernel.

Kernel: blended spectrum with presence.  For each n-gram length the normalised
number of distinct byte n-grams that two texts share, averaged over lengths.
Nyström: landmarks drawn from the training rows span the feature space, with
K(landmarks, landmarks)^(-1/2) as the map.  On it, one ridge regression per
language against the rest, in closed form.  A batch of texts is scored with
matrix products: presence x landmarks, then x coefficients.

n-grams are compared through a hash of 20 bits for each length; only those that
occur in some landmark can count.  The commonest of these are columns of the
matrix products, the others meet the few landmarks that hold them through a
list, so that every n-gram counts.

Defined results: null texts and texts without any letter give ``und`` with
score 0; repeated rows give the same; without training rows every text gives
``und`` with score 0; with one language that one.  Extra columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Training texts per language, about; landmarks in all; bytes of a training text that is drawn at all.
TRAIN_EACH, LANDMARKS = 250, 120
LENGTHS = (1, 2, 3, 4)
BITS = 20
#: Columns of the matrix products; n-grams rarer among the landmarks are looked up in lists.
COLUMNS = 24_000


def grams(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every length: hashes of all n-grams, row after row, and how many each row has."""
    low = raw.copy()
    upper = (raw >= 65) & (raw <= 90)
    low[upper] += 32
    low[C.IS_SPACE[raw]] = 32
    wide = low.astype(np.uint32)
    ends = np.zeros(len(raw) + 1, bool)
    ends[off[1:]] = True
    whole = np.ones(len(raw), bool)
    code = np.zeros(len(raw), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            yield np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
            continue
        code = code[:m] * np.uint32(0x01000193) + wide[n - 1 :]
        if n > 1:  # not across the end of a row
            whole = whole[:m] & ~ends[n - 1 : n - 1 + m]
        if n in LENGTHS:
            h = (code ^ np.uint32(n * 0x5BD1E995 % 2**32)) * np.uint32(0x9E3779B1)
            yield (h >> np.uint32(32 - BITS))[whole], np.maximum(np.diff(off) - n + 1, 0)


class LanguageModel:
    """fit() learns from (text, lang) rows; predict() adds the columns lang_pred and score."""

    def __init__(self, each: int = TRAIN_EACH, landmarks: int = LANDMARKS, ridge: float = 1e-2, seed: int = 5):
        self.each, self.most, self.ridge, self.seed = each, landmarks, ridge, seed
        self.languages: list[str] = []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "column"}  # large, and made again in each worker

    def _columns(self) -> np.ndarray:
        """Number of each length's hash among the landmarks' n-grams, -1 for others."""
        if "column" not in self.__dict__:
            self.column = np.full((len(LENGTHS), 1 << BITS), -1, np.int32)
            for k, value in enumerate(self.value):
                self.column[k, value] = np.arange(len(value), dtype=np.int32)
        return self.column

    def _kernel(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Kernel values between rows and landmarks: one matrix product per length, and the lists of rare n-grams."""
        n, many = len(off) - 1, self.landmarks
        out = np.zeros((n, many))
        for k, (h, size) in enumerate(grams(raw, off)):
            dense, (begin, owner, weight) = self.dense[k], self.lists[k]
            x, sizes, rows, rare = np.zeros((n, len(dense)), np.float32), np.zeros(n), [], []
            end, column = np.cumsum(size), self._columns()[k]
            for i in np.flatnonzero(size):
                s = np.sort(h[end[i] - size[i] : end[i]])
                fresh = np.empty(len(s), bool)
                fresh[0] = True
                np.not_equal(s[1:], s[:-1], out=fresh[1:])
                s = s[fresh]
                sizes[i] = len(s)
                at = column[s]
                x[i, at[(at >= 0) & (at < len(dense))]] = 1
                more = at[at >= len(dense)]
                rare.append(more - len(dense))
                rows.append(np.full(len(more), i))
            shared = (x @ dense).astype(np.float64) if len(dense) else np.zeros((n, many))
            if rare and len(begin) > 1:
                r, row = np.concatenate(rare), np.concatenate(rows)
                long = begin[r + 1] - begin[r]
                total = np.cumsum(long)
                post = np.repeat(begin[r] - (total - long), long) + np.arange(total[-1] if len(total) else 0)
                shared += np.bincount(np.repeat(row, long) * many + owner[post], weight[post], minlength=n * many).reshape(n, many)
            out += shared / np.sqrt(np.maximum(sizes, 1))[:, None]
        return out / len(LENGTHS)

    def fit(self, docs: DataFrame) -> LanguageModel:
        """``docs``: (doc_id, text, lang).  Takes about ``each`` texts of each language, drawn by a hash of the id."""
        docs = C.small_batches(docs).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
        n = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not n:
            return self
        draw = F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1_000_000))
        share = docs.sparkSession.createDataFrame([(k, int(1_000_000 * min(1.0, self.each / v))) for k, v in n.items()], "lang string, share int")
        # a bounded sample: its expected size is each x languages
        rows = docs.join(F.broadcast(share), "lang").where(draw <= F.col("share")).select("text", "lang", "doc_id").toPandas()
        rows = rows.sort_values(["lang", "doc_id", "text"], kind="stable").reset_index(drop=True)
        self.languages = sorted(rows["lang"].unique())
        y = np.array([self.languages.index(v) for v in rows["lang"]])
        raw, off = C.flatten(pa.array(rows["text"], pa.string()))
        # landmarks: the same number of each language, spread over its rows
        per = max(1, self.most // len(self.languages))
        pick = np.concatenate([np.flatnonzero(y == c)[np.linspace(0, (y == c).sum() - 1, min(per, (y == c).sum())).astype(int)] for c in range(len(self.languages))])
        found: list[list[np.ndarray]] = [[np.unique(h) for h, _ in grams(raw[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))] for i in pick]
        self.landmarks, self.value, self.dense, self.lists = len(pick), [], [], []
        self.__dict__.pop("column", None)
        for k in range(len(LENGTHS)):
            every = np.concatenate([f[k] for f in found])
            owner = np.repeat(np.arange(len(found)), [len(f[k]) for f in found])
            weight = np.repeat([1 / np.sqrt(max(len(f[k]), 1)) for f in found], [len(f[k]) for f in found])
            value, which, times = np.unique(every, return_inverse=True, return_counts=True)
            rank = np.empty(len(value), np.int64)
            rank[np.argsort(-times, kind="stable")] = np.arange(len(value))
            number, wide = rank[which], min(len(value), COLUMNS // len(LENGTHS))
            self.value.append(value[np.argsort(rank)])
            dense = np.zeros((wide, len(pick)), np.float32)
            common = number < wide
            dense[number[common], owner[common]] = weight[common]
            self.dense.append(dense)
            order = np.argsort(number[~common], kind="stable")
            begin = np.concatenate([[0], np.cumsum(np.bincount(number[~common] - wide, minlength=len(value) - wide))]).astype(np.int64)
            self.lists.append((begin, owner[~common][order], weight[~common][order]))
        k_all = np.concatenate([self._kernel(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in C.steps(off, 1 << 18)])
        k_mm = k_all[pick]
        values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))
        z = np.concatenate([k_all @ root, np.ones((len(k_all), 1))], axis=1)
        # one against the rest, classes weighing alike
        w = (1 / np.bincount(y, minlength=len(self.languages)))[y]
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        gram = z.T @ (z * w[:, None]) + self.ridge * np.eye(z.shape[1])
        beta = np.linalg.solve(gram, z.T @ (target * w[:, None]))
        self.coefficient, self.constant = root @ beta[:-1], beta[-1]
        return self

    def decide(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and its share (a softmax of the regressions' values) of each row."""
        v = 4 * (self._kernel(raw, off) @ self.coefficient + self.constant)
        e = np.exp(v - v.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)

    def column_of(self, text: Column) -> Column:
        """struct(lang_pred, score) of a text column."""
        if not self.languages:
            return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        model = self

        @F.arrow_udf("struct<lang_pred string, score double>")
        def scan(column: pa.Array) -> pa.Array:
            raw, off = C.flatten(column)
            got = [model.decide(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in C.steps(off, 1 << 18)]
            C.trim()
            c = np.concatenate([g[0] for g in got]) if got else np.zeros(0, int)
            s = np.concatenate([g[1] for g in got]) if got else np.zeros(0)
            return pa.StructArray.from_arrays([pa.array(np.array(model.languages, object)[c], pa.string()), pa.array(s)], ["lang_pred", "score"])

        lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
        got = scan(text)
        return F.struct(F.when(lettered, got["lang_pred"]).otherwise("und").alias("lang_pred"), F.when(lettered, got["score"]).otherwise(0.0).alias("score"))


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from ids of remainders other than 0."""
    known = docs.select("doc_id", "text", "lang").where(C.crc_mod(5) != 0)
    model = LanguageModel().fit(known)
    got = docs.select("doc_id", (C.crc_mod(5) == 0).alias("held_out"), model.column_of(F.col("text")).alias("got"))
    return got.select("doc_id", "held_out", "got.lang_pred", "got.score")
