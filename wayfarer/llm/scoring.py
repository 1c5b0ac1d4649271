"""LM scoring with a weighted backoff automaton.

Smoothed n-grams of order two.  A state is a word that has been read, or the
root; its arcs are the 2-grams of all training words that occur twice or more
(absolute discounting), its failure arc leads to the root and pays a weight
that makes the history's distribution sum to one; the root's arcs are the
training words, with add-one smoothing and one share for all unknown words.
A traversal goes through a text from left to right and carries its state: a
word without an arc there follows the failure arc, pays, and tries again from
the root.  Tasks traverse many stretches of texts side by side, each beginning
in the state that the word before it leads to.

Counting, discounting and backoff weights are shuffles over all training
documents, so the model grows with the corpus.  What a task holds is bounded:
the ``heads`` most frequent words, the ``arcs`` most frequent 2-grams of these,
and a filter of fixed size.  What a traversal can't decide (other words, other
2-grams that the filter lets pass) gets its weight by a shuffle join of hashes:
a 2-gram's weight there is what its arc adds to the failure arc and the root's
arc, which the traversal or another row has paid.  Scores don't depend on the
two bounds.

2-grams travel to their count as sorted, difference-coded pairs of head
numbers; only pairs with a rarer word travel as hashes.

Defined results: null and empty texts are one end token; repeated rows are
scored one by one; without training documents N = V = 0, every token is
unknown and scores log10(1) = 0.  Extra columns pass unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Bounds of what is broadcast: words, at most 2**20, and 2-grams; and how often these occur at least, at any size of the corpus.
HEADS, ARCS, HOT = 400_000, 3_000_000, 3
#: Tokens, and 2-grams, whose counts one task gathers before it passes them on.
BUFFER, PAIR_BUFFER = 3_000_000, 2_000_000
#: Counted 2-grams of a partition, about.
PAIRS = 1_500_000
#: 64-bit words of the filter of 2-grams, as a power of two; positions of a stretch.
FILTER, LANE = 21, 64
END = np.uint64(0x0E5D0E5D0E5D0E5D)
DISCOUNT, LEAST = 0.6, 2
ROOT, TAIL = -2, -1
BITS = 20


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each row, its end token last, and the rows' offsets."""
    words = C.Words(raw, off)
    n = len(off) - 1
    at = words.first + np.arange(n + 1)
    out = np.full(at[-1], END, np.uint64)
    out[np.arange(len(words.hash)) + np.repeat(np.arange(n), words.count)] = words.hash
    return out, at


def _tables(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _gathered(batches: Iterator[pa.RecordBatch], codes) -> Iterator[pa.RecordBatch]:
    """Counts of codes(raw, offsets), summed over a buffer at a time."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        raw, off = C.flatten(batch.column("text"))
        for i, j in C.steps(off):
            got = codes(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            held.append(got)
            size += len(got)
            if size >= BUFFER:
                yield _tables(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
    if size:
        yield _tables(*np.unique(np.concatenate(held), return_counts=True))


def _at_least(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` rows reach, from a histogram over quarter powers of two."""
    bucket = F.floor(F.log2("n") * 4).cast("int")
    bars = {r["b"]: (r["k"], r["low"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).collect()}
    total, low = 0, 1 << 62
    for b in sorted(bars, reverse=True):
        if total + bars[b][0] > most:
            break
        total, low = total + bars[b][0], bars[b][1]
    return low


def _place(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    at[table[at] != values] = -1
    return at


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Hash of the 2-gram u v."""
    return C.mix(C.mix(u) * np.uint64(3) + v)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes: what is small in most of them takes little room."""
    return zlib.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


class Lexicon:
    """Numbers of the heads, the most frequent first."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        rank = np.lexsort((words, -counts))
        #: By number: hash and count.
        self.word, self.count = words[rank], counts[rank]
        order = np.argsort(self.word)
        self.sorted, self.number = self.word[order], order.astype(np.int64)

    def ids(self, tok: np.ndarray) -> np.ndarray:
        at = _place(tok, self.sorted)
        return np.where(at >= 0, self.number[at] if len(self.number) else TAIL, TAIL)


def _pairs_out(lexicon, parts: int):
    """Counts of 2-grams, gathered over a buffer at a time and dealt out by partition: (part, kind, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, held, size = lexicon.value, [], 0

        def out() -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = lex.ids(u), lex.ids(v)
            both = (a >= 0) & (b >= 0)
            code, n = np.unique((a[both].astype(np.uint64) << np.uint64(BITS)) | b[both].astype(np.uint64), return_counts=True)
            part, rows = (C.mix(code) % np.uint64(parts)).astype(np.int64), []
            for k in np.unique(part):
                at = part == k
                rows.append((int(k), 0, b"".join(len(x).to_bytes(4, "little") + x for x in (_packed(np.diff(code[at], prepend=np.uint64(0))), _packed(n[at])))))
            u, v = u[~both], v[~both]
            h, one, n = np.unique(pair_hash(u, v), return_index=True, return_counts=True)
            part = (h % np.uint64(parts)).astype(np.int64)
            for k in np.unique(part):
                at = part == k
                rows.append((int(k), 1, np.stack([u[one[at]], v[one[at]], n[at].astype(np.uint64)]).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "data"])

        for batch in batches:
            raw, off = C.flatten(batch.column("text"))
            for i, j in C.steps(off):
                tok, at = tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                first = np.zeros(len(tok), bool)
                first[at[:-1]] = True
                k = np.flatnonzero(~first)
                held.append((tok[k - 1], tok[k]))
                size += len(k)
                if size >= PAIR_BUFFER:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _pairs_in(lexicon, norm: float):
    """Summed counts n, of 2-grams that occur often enough: with numbers u and v and the weight beside a failure for heads, with hashes h, a and v for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, code, many, rare = lexicon.value, [], [], []
        for batch in batches:
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if kind:
                    rare.append(np.frombuffer(data, np.uint64).reshape(3, -1))
                    continue
                size = int.from_bytes(data[:4], "little")
                code.append(np.cumsum(_unpacked(data[4 : 4 + size]), dtype=np.uint64))
                many.append(_unpacked(data[8 + size :]))
        names = ["h", "n", "u", "rest", "a", "v"]
        if code:
            key, where = np.unique(np.concatenate(code), return_inverse=True)
            n = np.bincount(where, np.concatenate(many).astype(float)).astype(np.int64)
            key, n = key[n >= LEAST], n[n >= LEAST]
            u, v = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
            rest = np.log10((n - DISCOUNT) / lex.count[u]) - np.log10((lex.count[v] + 1) / norm)
            for s in range(0, len(n), 100_000):
                c = slice(s, s + 100_000)
                size = len(n[c])
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.array(n[c]), pa.array(u[c].astype(np.int32)), pa.array(rest[c]), pa.nulls(size, pa.int64()), pa.array(v[c])], names)
        if rare:
            u, v, n = np.concatenate(rare, axis=1)
            h, one, where = np.unique(pair_hash(u, v), return_index=True, return_inverse=True)
            n = np.bincount(where, n.astype(float)).astype(np.int64)
            one, h, n = one[n >= LEAST], h[n >= LEAST], n[n >= LEAST]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.float64()), pa.array(u[one].view(np.int64)), pa.array(v[one].view(np.int64))], names)

    return run


class Automaton:
    """What every task holds: states and arcs of the heads, and the filter of all other 2-grams."""

    def __init__(self, lexicon: Lexicon, norm: float, fail: np.ndarray, key: np.ndarray, arc: np.ndarray, bits: np.ndarray):
        self.lexicon, self.fail, self.bits = lexicon, fail, bits
        self.root = np.log10((lexicon.count + 1) / norm)
        order = np.argsort(key)
        #: Arcs, by state and word.
        self.key, self.arc = key[order], arc[order]

    def traverse(self, tok: np.ndarray, at: np.ndarray):
        """Per row: tokens, known heads, base and model log10 as far as arcs and heads go; words and 2-grams to be looked up, with their offsets."""
        n, size = len(at) - 1, np.diff(at)
        row = np.repeat(np.arange(n), size)
        ids = self.lexicon.ids(tok)
        known = ids >= 0
        base = np.bincount(row[known], self.root[ids[known]], minlength=n).astype(float)
        # stretches of LANE positions, the longest first
        many = -(-size // LANE)
        lane_row = np.repeat(np.arange(n), many)
        start = at[lane_row] + (np.arange(len(lane_row)) - np.repeat(np.cumsum(many) - many, many)) * LANE
        length = np.minimum(at[lane_row + 1] - start, LANE)
        order = np.argsort(-length, kind="stable")
        lane_row, start, length = lane_row[order], start[order], length[order]
        state = np.where(start == at[lane_row], ROOT, ids[start - 1])
        score = np.zeros(len(start))
        missed = np.zeros(len(tok), bool)
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t, "left"))
            place = start[:m] + t
            word, now = ids[place], state[:m]
            arc = np.full(m, -1, np.int64)
            may = np.flatnonzero((now >= 0) & (word >= 0))
            arc[may] = _place(now[may] << BITS | word[may], self.key)
            hit = arc >= 0
            paid = np.where(now >= 0, self.fail[now], 0.0) + np.where(word >= 0, self.root[word], 0.0) if len(self.root) else np.zeros(m)
            score[:m] += np.where(hit, self.arc[arc], paid) if len(self.arc) else paid
            missed[place[~hit & (now != ROOT)]] = True
            state[:m] = word
        model = np.bincount(lane_row, score, minlength=n).astype(float)
        k = np.flatnonzero(missed)
        h = pair_hash(tok[k - 1], tok[k])
        passed = (self.bits[h >> np.uint64(64 - FILTER)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)
        away, place = np.concatenate([tok[~known], h[passed]]), np.concatenate([row[~known], row[k[passed]]])
        order = np.argsort(place, kind="stable")
        return size, np.bincount(row[known], minlength=n).astype(np.int64), base, model, away[order], np.searchsorted(place[order], np.arange(n + 1))


class BackoffModel:
    """fit() counts over all training documents; score() adds up every text.

    ``heads`` and ``arcs`` bound what is broadcast, never the model.
    """

    def __init__(self, heads: int = HEADS, arcs: int = ARCS):
        self.heads, self.arcs = min(heads, 1 << BITS), arcs

    def fit(self, docs: DataFrame) -> BackoffModel:
        sc, text = docs.sparkSession.sparkContext, C.small_batches(docs).select("text")
        found = text.mapInArrow(C.trimmed(lambda it: _gathered(it, lambda raw, off: tokens(raw, off)[0])), "h long, n long")
        counts = C.keep(found.groupBy("h").agg(F.sum("n").alias("n")), "counts")
        row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.total, self.distinct = int(row["n"]), int(row["v"])
        self.norm = float(self.total + self.distinct + 1)
        # at most ``heads`` rows
        top = counts.where(F.col("n") >= _at_least(counts, self.heads)).toArrow()
        lexicon = Lexicon(top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy())
        shared, parts = sc.broadcast(lexicon), C.parts_for(self.total, PAIRS)
        dealt = text.mapInArrow(C.trimmed(_pairs_out(shared, parts)), "part int, kind int, data binary")
        grams = dealt.repartition(parts, "part").mapInArrow(C.trimmed(_pairs_in(shared, self.norm)), "h long, n long, u int, rest double, a long, v long")
        grams = C.keep(grams, "pairs")
        pairs = self._weigh(counts, grams, lexicon, shared)
        inner = grams.where("u is not null")
        # at most ``arcs`` rows
        hot = inner.where(F.col("n") >= max(HOT, _at_least(inner, self.arcs))).select("u", "v", "rest").toArrow()
        root = np.log10((lexicon.count + 1) / self.norm)
        v = hot.column("v").to_numpy()
        arc = hot.column("rest").to_numpy() + root[v]
        key = hot.column("u").to_numpy().astype(np.int64) << BITS | v
        del hot, v
        # at most 2 ** FILTER rows
        bars = pairs.groupBy(F.shiftrightunsigned("h", 64 - FILTER).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b")).toArrow()
        bits = np.zeros(1 << FILTER, np.uint64)
        bits[bars.column("i").to_numpy()] = bars.column("b").to_numpy().view(np.uint64)
        self.model = Automaton(lexicon, self.norm, self.fail, key, arc, bits)
        return self

    def _weigh(self, counts: DataFrame, grams: DataFrame, lexicon: Lexicon, numbered) -> DataFrame:
        """Failure weights of the heads, and (h, base, model): what each word and 2-gram adds to a text's scores where the automaton doesn't know it.  Returns the 2-grams' part."""
        spark, seen = counts.sparkSession, F.col("n") - DISCOUNT
        names = pa.table({"u": pa.array(np.arange(len(lexicon.word)), pa.int32()), "a": lexicon.word.view(np.int64)})
        uni = counts.select("h", "n", F.log10((F.col("n") + 1) / F.lit(self.norm)).alias("base"))
        of_heads = grams.where("u is not null").select("u", "n", F.log10(seen).alias("log"), "rest")
        # sums of arcs and of what the root would give: rest is log10(seen / count) less log10 of the root's arc
        heads = of_heads.groupBy("u").agg(F.sum(seen).alias("s"), F.sum(F.pow(F.lit(10.0), F.col("log") - F.col("rest"))).alias("q"))
        # the name of a head's number, ``heads`` rows at most; its count turns q into probabilities
        heads = heads.join(F.broadcast(spark.createDataFrame(names)), "u").join(uni.select(F.col("h").alias("a"), F.col("n").alias("of")), "a").select("a", "s", (F.col("q") / F.col("of")).alias("q"))
        tail = grams.where("u is null").select("h", "a", "v", "n").join(uni.select(F.col("h").alias("v"), F.col("base").alias("word")), "v")
        tail = C.keep(tail.select("h", "a", "n", "word"), "rare_pairs")
        others = tail.groupBy("a").agg(F.sum(seen).alias("s"), F.sum(F.pow(F.lit(10.0), "word")).alias("q"))
        sums = heads.unionByName(others).groupBy("a").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
        uni = uni.join(sums, uni.h == sums.a, "left")
        left, lower = F.greatest(1 - F.col("s") / F.col("n"), F.lit(1e-9)), F.greatest(1 - F.col("q"), F.lit(1e-9))
        uni = C.keep(uni.select("h", "n", "base", F.coalesce(F.log10(left / lower), F.lit(0.0)).alias("fail")), "words")
        low = int(lexicon.count.min()) if len(lexicon.count) else 1 << 62
        got = uni.where(F.col("n") >= low).select("h", "fail").toArrow()
        at = lexicon.ids(got.column("h").to_numpy().view(np.uint64))
        self.fail = np.zeros(len(lexicon.word))
        self.fail[at[at >= 0]] = got.column("fail").to_numpy()[at >= 0]
        shared = spark.sparkContext.broadcast(self.fail)

        def less_failure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word = numbered.value.word
            for b in batches:
                u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(pair_hash(word[u], word[v]).view(np.int64)), pa.array(b.column("rest").to_numpy() - shared.value[u])], ["h", "model"])

        inner = grams.where("u is not null").select("u", "v", "rest").mapInArrow(C.trimmed(less_failure), "h long, model double")
        rare = tail.join(uni.select(F.col("h").alias("a"), F.col("n").alias("of"), "fail"), "a")
        rare = rare.select("h", (F.log10(seen / F.col("of")) - F.col("word") - F.col("fail")).alias("model"))
        none = F.lit(None).cast("double").alias("base")
        # only words have a base; those that the automaton knows are never looked up
        words = uni.where(F.col("n") < low).select("h", "base", (F.col("base") + F.col("fail")).alias("model"))
        pairs = inner.unionByName(rare)
        self.weights = words.unionByName(pairs.select("h", none, "model"))
        return pairs.select("h")

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score."""
        shared = docs.sparkSession.sparkContext.broadcast(self.model)
        others = [f for f in docs.schema.fields if f.name != "text"]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, uid = shared.value, TaskContext.get().partitionId() << 36
            for batch in batches:
                raw, off = C.flatten(batch.column("text"))
                for i, j in C.steps(off):
                    size, known, base, model, away, away_at = m.traverse(*tokens(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                    own = [batch.column(f.name)[i:j] for f in others]
                    more = [pa.array(np.arange(uid, uid + j - i)), pa.array(size), pa.array(known), pa.array(base), pa.array(model), C.list_array(away.view(np.int64), away_at)]
                    uid += j - i
                    yield pa.RecordBatch.from_arrays(own + more, [f.name for f in others] + ["_uid", "_size", "_known", "_base", "_model", "_away"])

        schema = T.StructType([*others, *(T.StructField(n, t) for n, t in (("_uid", T.LongType()), ("_size", T.LongType()), ("_known", T.LongType()), ("_base", T.DoubleType()), ("_model", T.DoubleType()), ("_away", T.ArrayType(T.LongType()))))])
        part = C.keep(C.small_batches(docs).mapInArrow(C.trimmed(scan), schema), "traversed")
        away = part.select("_uid", F.explode("_away").alias("h")).join(self.weights, "h")
        away = away.groupBy("_uid").agg(F.count("base").alias("_more"), F.coalesce(F.sum("base"), F.lit(0.0)).alias("_base_more"), F.sum("model").alias("_model_more"))
        more = part.drop("_away").join(away, "_uid", "left")
        known = F.col("_known") + F.coalesce("_more", F.lit(0))
        unknown = (F.col("_size") - known) * F.log10(F.lit(1 / self.norm))
        return more.select(
            *(f.name for f in others),
            F.col("_size").alias("n_tokens"),
            known.alias("n_known"),
            F.lit(self.total).cast("long").alias("train_tokens"),
            (F.col("_base") + F.coalesce("_base_more", F.lit(0.0)) + unknown).alias("base_score"),
            (F.col("_model") + F.coalesce("_model_more", F.lit(0.0)) + unknown).alias("score"),
        )


def lm_score(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document; learns from ids of remainders other than 2."""
    docs = docs.select("doc_id", "text", (C.crc_mod(7) == 2).alias("held_out"))
    return BackoffModel().fit(docs.where(~F.col("held_out"))).score(docs)
