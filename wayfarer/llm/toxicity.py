"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Three disjoint parts of the labelled rows teach the three parts of the model:
the first gives the lexicon (log-odds of letter runs), the second the trees,
the third the isotonic map from tree probability to score.  So no part is
fitted on rows that another has already memorised.

Texts are scanned whole, once, by an Arrow function that counts over the byte
buffer; trees and calibration run inside the JVM.

Defined results: null and empty texts get the score of an all-zero feature
row; null ids count as remainder 0; repeated rows are scored alike; with no
labelled row, or with one class only, the score is the share of label 1 (0.5
without labels).  Extra columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that the model is fitted on, about, and the entries that its lexicon may have.
TRAIN_ROWS = 9000
LEXICON = 2000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[33, 63]] = True
_MARK = np.zeros(256, bool)
_MARK[[x for x in range(33, 127) if not (_LETTER[x] or _DIGIT[x])]] = True
_SWAP = np.zeros(256, bool)
_SWAP[[*map(ord, "013457@$*#!")]] = True
# fixed values: second-person pronouns of English, German, French and Spanish
SECOND_PERSON = ("you", "your", "yours", "yourself", "ye", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "tu", "te", "toi", "vous", "votre", "vos", "ton", "ta", "tes", "usted", "ustedes", "ti", "tus", "vosotros")
NAMES = ("lexicon_rate", "lexicon_weight", "lexicon_hits", "lexicon_strongest", "second_person_rate", "lexicon_near_second_person", "capital_rate", "capital_word_rate", "shout_rate", "mark_rate", "digit_rate", "obfuscated_rate", "stretched_rate", "log_words", "word_length")


def _hash_of(words: tuple[str, ...]) -> np.ndarray:
    raw, off = C.flatten(pa.array(words))
    return np.sort(C.Words(raw, off, gap=~_LETTER).hash)


_SECOND = _hash_of(SECOND_PERSON)


def _find(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def features(raw: np.ndarray, off: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The dense features of each row."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    runs = C.Words(raw, off, gap=~_LETTER)
    tokens = C.Words(raw, off, hashed=False)
    row = runs.row
    words = np.maximum(runs.count, 1)
    at = _find(runs.hash, table)
    hit = np.flatnonzero(at >= 0)
    w = weight[at[hit]] if len(hit) else np.zeros(0)
    hits = np.bincount(row[hit], minlength=n)
    out[:, 0] = hits / words
    out[:, 1] = np.bincount(row[hit], w, minlength=n) / words
    out[:, 2] = np.log1p(hits)
    np.maximum.at(out[:, 3], row[hit], w)
    second = np.flatnonzero(_find(runs.hash, _SECOND) >= 0)
    out[:, 4] = np.bincount(row[second], minlength=n) / words
    if len(second) and len(hit):
        k = np.searchsorted(second, hit)
        near = np.zeros(len(hit), bool)
        for side in (np.minimum(k, len(second) - 1), np.maximum(k - 1, 0)):
            near |= (row[second[side]] == row[hit]) & (np.abs(second[side] - hit) <= 6)
        out[:, 5] = np.bincount(row[hit[near]], minlength=n) / np.maximum(hits, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c

    upper, letter, digit, mark = count(_UPPER[raw]), count(_LETTER[raw]), count(_DIGIT[raw]), count(_MARK[raw])
    span = lambda c: np.diff(c[off])
    letters, size = np.maximum(span(letter), 1), np.maximum(np.diff(off), 1)
    out[:, 6] = span(upper) / letters
    long = runs.end - runs.start
    shouted = (long >= 3) & (upper[runs.end] - upper[runs.start] == long)
    out[:, 7] = np.bincount(row[shouted], minlength=n) / words
    out[:, 8] = span(count(_SHOUT[raw])) / size
    out[:, 9] = span(mark) / size
    out[:, 10] = span(digit) / size
    # obfuscation: a stand-in sign between two letters of one token
    swap = np.zeros(len(raw), bool)
    if len(raw) > 2:
        swap[1:-1] = _SWAP[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
    swapped = count(swap)
    odd = swapped[tokens.end] > swapped[tokens.start]
    out[:, 11] = np.bincount(tokens.row[odd], minlength=n) / np.maximum(tokens.count, 1)
    same = np.zeros(len(raw), bool)
    if len(raw) > 2:
        same[2:] = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & _LETTER[raw[2:]]
    stretched = count(same)
    odd = stretched[runs.end] > stretched[runs.start]
    out[:, 12] = np.bincount(row[odd], minlength=n) / words
    out[:, 13] = np.log1p(runs.count)
    out[:, 14] = np.bincount(row, long, minlength=n) / words
    return out


def feature_column(text: Column, table: np.ndarray, weight: np.ndarray) -> Column:
    """array<double> of the features of a text column."""

    @F.arrow_udf("array<double>")
    def scan(column: pa.Array) -> pa.Array:
        raw, off = C.flatten(column)
        got = [features(raw[off[i] : off[j]], off[i : j + 1] - off[i], table, weight) for i, j in C.steps(off)]
        x = np.concatenate(got) if got else np.zeros((0, len(NAMES)))
        C.trim()
        return C.list_array(x.ravel(), np.arange(len(x) + 1) * len(NAMES))

    return scan(text)


def _seen_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = C.flatten(batch.column("text"))
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for i, j in C.steps(off):
            runs = C.Words(raw[off[i] : off[j]], off[i : j + 1] - off[i], gap=~_LETTER)
            for k in range(j - i):
                h = np.unique(runs.hash[runs.first[k] : runs.first[k + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), y[i + k], np.int64))], ["h", "y"])


class ToxicityModel:
    """fit() learns from labelled rows; score() adds the column ``score`` to documents."""

    def __init__(self, train_rows: int = TRAIN_ROWS, lexicon: int = LEXICON, trees: int = 25, depth: int = 4, seed: int = 17):
        self.train_rows, self.most, self.trees, self.depth, self.seed = train_rows, lexicon, trees, depth, seed
        self.table, self.weight, self.model, self.steps = np.zeros(0, np.uint64), np.zeros(0), None, None
        self.prior = 0.5

    def fit(self, docs: DataFrame, labels: DataFrame) -> ToxicityModel:
        """``labels``: (doc_id, y) with y in 0, 1.  Takes about ``train_rows`` of them, drawn by a hash of the id."""
        spark = docs.sparkSession
        labels = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
        n = labels.count()
        draw = F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(1_000_000))
        chosen = labels.where(draw < int(1_000_000 * min(1.0, self.train_rows / max(n, 1))) + (n <= self.train_rows))
        # a bounded sample of ids: its expected size is train_rows
        rows = C.small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        part = F.pmod(F.xxhash64("doc_id", F.lit(self.seed + 1)), F.lit(10))
        rows = C.keep(rows.withColumn("part", part).repartition(6), "toxicity_train")
        seen = {(r["first"], r["y"]): r["n"] for r in rows.groupBy((F.col("part") < 4).alias("first"), "y").agg(F.count(F.lit(1)).alias("n")).collect()}
        ones, total = sum(v for k, v in seen.items() if k[1] == 1), sum(seen.values())
        self.prior = ones / total if total else 0.5
        if not all(seen.get((half, y), 0) >= 2 for half in (True, False) for y in (0, 1)):
            return self
        n1, n0 = seen[True, 1], seen[True, 0]
        words = rows.where("part < 4").select("text", "y").mapInArrow(C.trimmed(_seen_words), "h long, y long").groupBy("h").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
        odds = F.log((F.col("a") + 0.25) / (n1 + 0.5)) - F.log((F.col("n") - F.col("a") + 0.25) / (n0 + 0.5))
        top = words.where("a >= 2").withColumn("w", odds).where("w >= 1.2").orderBy(F.desc(F.col("w") * F.sqrt("a")), "h").limit(self.most).toPandas()
        h = top["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.table, self.weight = h[order], top["w"].to_numpy(float)[order]
        x = C.cut(rows.where("part >= 4").select("part", F.col("y").cast("double").alias("label"), feature_column(F.col("text"), self.table, self.weight).alias("f")))
        x = x.select("part", "label", array_to_vector("f").alias("features"))
        trees, held = x.where("part < 8"), x.where("part >= 8")
        if trees.select("label").distinct().count() < 2:
            return self
        self.model = GBTClassifier(maxIter=self.trees, maxDepth=self.depth, minInstancesPerNode=5, stepSize=0.2, subsamplingRate=0.8, seed=self.seed, maxBins=32).fit(trees)
        p = self.model.transform(held).select(vector_to_array("probability")[1].alias("p"), "label")
        if held.count():
            iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(p)
            self.steps = (np.array(iso.boundaries), np.array(iso.predictions))
        return self

    def _calibrated(self, p: Column) -> Column:
        """Linear between the isotonic boundaries, drawn a little towards the tree probability so that ties keep its order."""
        if self.steps is None or not len(self.steps[0]):
            return p
        x, y = (a.tolist() for a in self.steps)
        out = F.lit(y[-1])
        for x0, y0, x1, y1 in reversed(list(zip(x, y, x[1:], y[1:], strict=False))):
            out = F.when(p < x1, F.lit(y0) + (p - x0) / max(x1 - x0, 1e-12) * (y1 - y0)).otherwise(out)
        return F.when(p < x[0], y[0]).otherwise(out) * 0.98 + p * 0.02

    def score(self, docs: DataFrame) -> DataFrame:
        if self.model is None:
            return docs.withColumn("score", F.lit(float(self.prior)))
        # the model's own columns have names that no table has
        names = {k: f"_tox_{k}" for k in ("features", "rawPrediction", "probability", "prediction")}
        model = self.model.copy({self.model.getParam(f"{k}Col"): v for k, v in names.items()})
        with_x = docs.withColumn(names["features"], array_to_vector(feature_column(F.col("text"), self.table, self.weight)))
        p = vector_to_array(F.col(names["probability"]))[1]
        score = F.least(F.greatest(self._calibrated(F.col("_tox_p")), F.lit(0.0)), F.lit(1.0))
        return model.transform(with_x).withColumn("_tox_p", p).withColumn("score", score).drop(*names.values(), "_tox_p")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from ids of remainders other than 1."""
    known = labels.where(C.crc_mod(3) != 1).select("doc_id", F.col("toxic").alias("y"))
    own = docs.select("doc_id", "text")
    scored = ToxicityModel().fit(own, known).score(own)
    return scored.select("doc_id", (C.crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
