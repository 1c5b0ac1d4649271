"""Phrase collocation mining with count tries.

A task gathers the words of a language into shards of bounded size.  A shard's
trie counts all word sequences of up to ``DEPTH`` words within pieces of text:
level after level, the nodes of a level are the distinct (parent, word), sorted,
and a node's count is how often its sequence occurs.  The trie is cut into
ranges of prefixes and each range is serialised on its own, words as ranks in
the range's sorted dictionary.

A range's segments of all shards meet in one task, which merges them level after
level: equal (merged parent, word) become one node whose count is the sum.  What
a range holds is bounded, for its limits are quantiles of a sample of the text;
the sample decides where ranges are cut, never what is counted.  Limits are
numbers made of the leading bits of all words of a sequence, so that a range can
be cut below a frequent word, pair or triple.  A node whose sequences lie in one
range is complete there and goes on if it occurs often enough; the few that a
limit cuts through go on with the counts of each of their ranges and are added.

What is left, the sequences that occur ``least`` times or more, is a trie as a
table.  Its levels are walked from short to long: a node takes the counts of its
left parts from its parent, and those of its right parts from the node that its
suffix link names, the same words without the first.  Cuts are then weighed in
decimals of 38 digits.  A sequence that a longer one of the same count holds is
dropped: of all longer ones that hold it, one is longer by a word and occurs as
often, so it is enough that children and suffix links offer their counts.

Words travel as 64-bit hashes beside their bytes, which go with each first word.
Two words of one hash are noticed where they meet, and everything is counted
again under another hash.

Defined results: null and empty texts have no words; a null language is ``und``
and counts together with a language of that name; equal rows count each; an
empty table gives no rows.  Extra columns aren't carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

DEPTH, LEAST, TOP = 5, 100, 2000
#: Words of a shard; bytes of text for a range, about; sampled sequences for a range; ranges at most, which bounds what is broadcast.
SHARD, RANGE_BYTES, SAMPLES, RANGES = 1 << 20, 6 << 20, 64, 1 << 17
#: Texts sampled for the ranges' limits at least.
SAMPLED_ROWS = 2000
#: Leading bits of each word that a limit is made of.
_BITS = (20, 14, 12, 10, 8)
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_GAP = np.zeros(256, bool)
_GAP[list(_BREAKS + b" \t")] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(_BREAKS)] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# -- words -----------------------------------------------------------------


class Scan:
    """Words of some rows: hash, place and piece of each."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, seed: int):
        words = C.Words(raw, off, gap=_GAP, seed=seed)
        self.hash = np.maximum(words.hash, np.uint64(1))  # 0 ends a sequence
        self.start, self.end, self.row = words.start, words.end, words.row
        breaks = np.cumsum(_BREAK[raw])
        self.piece = breaks[self.start] + self.row if len(self.start) else self.start


def limits_of(seq: np.ndarray) -> np.ndarray:
    """The number that places each sequence of hashes [word, row] among the ranges: ascending as the sequences are."""
    out, left = np.zeros(seq.shape[1], np.uint64), 64
    for h, bits in zip(seq, _BITS, strict=False):  # sequences may be shorter
        left -= bits
        out |= (h >> np.uint64(64 - bits)) << np.uint64(left)
    return out


def sequences(hashes: np.ndarray, piece: np.ndarray, depth: int) -> np.ndarray:
    """[word, row]: the words that follow each word in its piece, itself first; 0 behind the piece's end."""
    n = len(hashes)
    out = np.zeros((depth, n), np.uint64)
    for d in range(depth):
        same = piece[: n - d] == piece[d:] if d else np.ones(n, bool)
        out[d, : n - d] = np.where(same, hashes[d:], 0)
    return out


# -- tries -----------------------------------------------------------------


class Trie:
    """Level by level, in order of the words' ranks: the rank, parent and count of each node.  Level 0 is the root."""

    def __init__(self, words: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def counted(cls, seq: np.ndarray) -> Trie:
        """The trie of sequences [word, row] of hashes; 0 ends one."""
        words = np.unique(seq)
        words = words[words != 0]
        ranks = [np.searchsorted(words, h).astype(np.int64) for h in seq]
        at = np.zeros(seq.shape[1], np.int64)
        rows = np.arange(seq.shape[1])
        levels = []
        for d in range(len(seq)):
            rows = rows[seq[d][rows] != 0]
            key = (at[rows] << 32) | ranks[d][rows]
            node, which, count = np.unique(key, return_inverse=True, return_counts=True)
            at[rows] = which
            levels.append((node & 0xFFFFFFFF, node >> 32, count))
        return cls(words, levels)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """One trie with the counts of all: a merge of sorted levels, whose nodes know their merged parents."""
        words = np.unique(np.concatenate([t.words for t in tries]))
        rank = [np.searchsorted(words, t.words) for t in tries]
        above: list[np.ndarray] = [np.zeros(1, np.int64)] * len(tries)
        levels = []
        for d in range(max(len(t.levels) for t in tries)):
            parts = [(above[i][t.levels[d][1]] << 32) | rank[i][t.levels[d][0]] for i, t in enumerate(tries)]
            key = np.concatenate(parts)
            count = np.concatenate([t.levels[d][2] for t in tries])
            order = np.argsort(key, kind="stable")  # runs that are sorted already
            key, count = key[order], count[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            which = np.empty(len(key), np.int64)
            which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            ends = np.cumsum([0, *(len(p) for p in parts)])
            above = [which[ends[i] : ends[i + 1]] for i in range(len(parts))]
            node = key[first]
            levels.append((node & 0xFFFFFFFF, node >> 32, np.add.reduceat(count, first) if len(first) else count[:0]))
        return cls(words, levels)

    def to_bytes(self) -> bytes:
        """Words, then of each level ranks, numbers of children and counts, in as few bytes a number as hold them."""
        parts = [np.array([len(self.words), len(self.levels)], "<i4").tobytes(), self.words.astype("<u8").tobytes()]
        for d, (rank, _, count) in enumerate(self.levels):
            nodes = len(rank)
            kids = np.bincount(self.levels[d + 1][1], minlength=nodes) if d + 1 < len(self.levels) else np.zeros(0, np.int64)
            parts += [_short(rank), _short(kids), _short(count)]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Trie:
        n, depth = np.frombuffer(data, "<i4", 2).tolist()
        words = np.frombuffer(data, "<u8", n, 8).astype(np.uint64)
        at, levels, kids = 8 + 8 * n, [], None
        for _ in range(depth):
            rank, at = _long(data, at)
            below, at = _long(data, at)
            count, at = _long(data, at)
            parent = np.repeat(np.arange(len(kids)), kids) if kids is not None else np.zeros(len(rank), np.int64)
            levels.append((rank, parent, count))
            kids = below
        return cls(words, levels)

    @property
    def firsts(self) -> list[int]:
        """Hashes of the words of the first level."""
        return self.words[self.levels[0][0]].tolist()

    def paths(self, d: int, nodes: np.ndarray) -> np.ndarray:
        """Hashes [word, node] from the root to nodes of level ``d`` (from 0)."""
        out = np.zeros((d + 1, len(nodes)), np.uint64)
        for k in range(d, -1, -1):
            rank, parent, _ = self.levels[k]
            out[k] = self.words[rank[nodes]]
            nodes = parent[nodes]
        return out


def _short(x: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << (8 * w))
    return np.array([len(x), width], "<i4").tobytes() + x.astype(f"<u{width}").tobytes()


def _long(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = np.frombuffer(data, "<i4", 2, at).tolist()
    return np.frombuffer(data, f"<u{width}", n, at + 8).astype(np.int64), at + 8 + n * width


# -- shards ----------------------------------------------------------------


class _Gathered:
    """Words of one language that aren't in a shard yet."""

    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.pieces: list[np.ndarray] = []
        self.size = self.next = 0
        self.bytes: dict[int, bytes] = {}

    def add(self, scan: Scan, some: np.ndarray, text: bytes) -> None:
        h, piece = scan.hash[some], scan.piece[some]
        self.hashes.append(h)
        self.pieces.append(piece + self.next)
        self.next += int(piece[-1]) + 1
        self.size += len(h)
        value, first = np.unique(h, return_index=True)
        for v, k in zip(value.tolist(), some[first].tolist(), strict=True):
            if v not in self.bytes:
                self.bytes[v] = text[scan.start[k] : scan.end[k]].translate(_LOWER)


def _segments(depth: int, limits: np.ndarray, seed: int, shard: int):
    """Shards of a task's texts, as segments of ranges: (lang, part, words, trie, spelled)."""

    def cut(lang: str, some: _Gathered) -> Iterator[dict]:
        seq = sequences(np.concatenate(some.hashes), np.concatenate(some.pieces), depth)
        part = np.searchsorted(limits, limits_of(seq), "right")
        order = np.argsort(part, kind="stable")
        part, seq = part[order], seq[:, order]
        ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
        begin = 0
        for end in ends.tolist():
            trie = Trie.counted(seq[:, begin:end])
            # the words that begin a sequence here, in the order of the first level
            spelled = [some.bytes[h] for h in trie.firsts]
            yield {"lang": lang, "part": int(part[begin]), "words": end - begin, "trie": trie.to_bytes(), "spelled": spelled}
            begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Gathered] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, some in held.items():
                for row in cut(lang, some):
                    yield pa.RecordBatch.from_pylist([row], _SEGMENT)
            held.clear()

        for batch in batches:
            raw, off = C.flatten(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for i, j in C.steps(off):
                piece = raw[off[i] : off[j]]
                scan, text = Scan(piece, off[i : j + 1] - off[i], seed), piece.tobytes()
                if len(scan.hash):
                    lang = code[i:j][scan.row]
                    for k in np.unique(lang).tolist():
                        held.setdefault(names[k], _Gathered()).add(scan, np.flatnonzero(lang == k), text)
                if sum(x.size for x in held.values()) >= shard:
                    yield from flush()
        yield from flush()

    return run


_SEGMENT = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("words", pa.int64()), ("trie", pa.binary()), ("spelled", pa.list_(pa.binary()))])
_NODES = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.int64())), ("f", pa.int64()), ("word", pa.binary()), ("clash", pa.bool_())])


def _merge(depth: int, limits: np.ndarray, least: int):
    """Nodes of one range: those that occur often enough, and the counts so far of those that a limit cuts through.

    The words of the range are a node without a path.
    """

    def run(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        tries = [Trie.from_bytes(x.as_py()) for x in table.column("trie")]
        spelled: dict[int, bytes] = {}
        clash = False
        for t, names in zip(tries, table.column("spelled"), strict=True):
            for h, name in zip(t.firsts, names.as_py(), strict=True):
                clash |= spelled.setdefault(h, name) != name
        trie = Trie.merged(tries)
        del tries
        total = int(table.column("words").to_numpy().sum())
        out = [pa.Table.from_pylist([{"lang": lang, "path": [], "f": total, "word": None, "clash": clash}], _NODES)]
        used = 64
        for d in range(min(depth, len(trie.levels))):
            used -= _BITS[d] if d < len(_BITS) else 0
            count = trie.levels[d][2]
            path = trie.paths(d, np.arange(len(count)))
            low = limits_of(path)
            high = low | np.uint64((1 << used) - 1)
            keep = (count >= least) | (np.searchsorted(limits, low, "right") != np.searchsorted(limits, high, "right"))
            n = int(keep.sum())
            if not n:
                continue
            flat = np.ascontiguousarray(path[:, keep].T).reshape(-1).view(np.int64)
            words = [spelled[h] for h in path[0, keep].tolist()] if d == 0 else [None] * n
            out.append(pa.Table.from_arrays([pa.array([lang] * n, pa.string()), C.list_array(flat, np.arange(n + 1) * (d + 1)), pa.array(count[keep]), pa.array(words, pa.binary()), pa.array([False] * n)], schema=_NODES))
        return pa.concat_tables(out)

    return run


def _sampled(depth: int, seed: int):
    """Numbers that place the sequences of a task's texts among ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = C.flatten(batch.column("text"))
            for i, j in C.steps(off):
                scan = Scan(raw[off[i] : off[j]], off[i : j + 1] - off[i], seed)
                seq = sequences(scan.hash, scan.piece, depth)
                # one of eight, wherever it stands
                x = limits_of(seq)
                yield pa.RecordBatch.from_arrays([pa.array(x[C.mix(seq[0] + np.arange(len(x), dtype=np.uint64)) % np.uint64(8) == 0].view(np.int64))], ["x"])

    return run


def _limits(texts: DataFrame, depth: int, ranges: int, seed: int, rows: int, size: int) -> np.ndarray:
    """At most ``ranges - 1`` ascending limits, quantiles over a sample of texts: ``SAMPLED_ROWS``, or what gives ``SAMPLES`` sequences a range."""
    if ranges < 2:
        return np.zeros(0, np.uint64)
    wanted = max(SAMPLED_ROWS, ranges * SAMPLES * 8 * 6 * rows / size)  # one of eight words, of some six bytes
    some = texts.sample(min(1.0, wanted / rows), seed=17)
    # numbers beyond 2**63 are negative as longs; the quantiles of flipped ones are in the right order
    x = some.mapInArrow(C.trimmed(_sampled(depth, seed)), "x long").select(F.col("x").bitwiseXOR(F.lit(-(2**63)).cast("long")).alias("x"))
    points = [(k + 1) / ranges for k in range(ranges - 1)]
    found = x.agg(F.percentile_approx("x", points, max(10_000, ranges * 4)).alias("q")).first()["q"]
    return np.unique(np.array(found or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def frequent(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, shard: int = SHARD, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Sequences that occur ``least`` times or more in a language, and words of languages.

    (lang, path, f, word), word for paths of one word; (lang, n).
    """
    texts = C.small_batches(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")))
    rows, size = C.text_size(texts)
    ranges = min(RANGES, -(-size // range_bytes))
    for seed in range(8):
        limits = _limits(texts.select("text"), depth, ranges, seed, rows, size)
        segments = texts.mapInArrow(C.trimmed(_segments(depth, limits, seed, shard)), "lang string, part long, words long, trie binary, spelled array<binary>")
        nodes = segments.groupBy("lang", "part").applyInArrow(_merge(depth, limits, least), "lang string, path array<long>, f long, word binary, clash boolean")
        # the word of a path of one word is the same in every range, or there is a clash
        summed = nodes.groupBy("lang", "path").agg(F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("_last"), F.max("clash").alias("clash"))
        kept = C.keep(summed.where((F.col("f") >= least) | (F.size("path") == 0)).withColumn("clash", F.col("clash") | F.coalesce(F.col("word") != F.col("_last"), F.lit(False))).drop("_last"), "sequences")
        if not kept.where("clash").limit(1).count():
            return kept.where("size(path) > 0").drop("clash"), kept.where("size(path) = 0").select("lang", F.col("f").alias("n"))
    raise RuntimeError("words of one hash under every seed")


#: floor(1000 * a * n / (l * r)); counts of up to 17 digits.
SCORE = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


# -- walks -----------------------------------------------------------------


def with_parts(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Nodes (lang, path, f, word) of at least two words beside the counts of their left and right parts: (lang, path, a, left, right, words), both by the number of words cut off."""
    level = nodes.where("size(path) = 1").select("lang", "path", "f", F.array().cast("array<long>").alias("left"), F.array().cast("array<long>").alias("right"), F.array("word").alias("words"))
    out = None
    for d in range(2, depth + 1):
        up = level.select("lang", F.col("path").alias("parent"), F.array_append("left", F.col("f")).alias("left"), F.col("words").alias("_words"))
        link = level.select("lang", F.col("path").alias("suffix"), F.array_prepend("right", F.col("f")).alias("right"), F.element_at("words", -1).alias("_last"))
        here = nodes.where(F.size("path") == d).select("lang", "path", "f", F.slice("path", 1, d - 1).alias("parent"), F.slice("path", 2, d - 1).alias("suffix"))
        level = here.join(up, ["lang", "parent"]).join(link, ["lang", "suffix"])
        level = C.cut(level.select("lang", "path", "f", "left", "right", F.array_append("_words", F.col("_last")).alias("words")))
        out = level if out is None else out.unionByName(level)
    return out.withColumnRenamed("f", "a")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, depth: int = DEPTH, share: int = 100, **more) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language of ``docs`` (text, lang)."""
    nodes, sizes = frequent(docs, depth, least, **more)
    found = with_parts(nodes, depth)
    # what holds a phrase and is longer by a word offers its count to it
    offers = found.select("lang", F.slice("path", 1, F.size("path") - 1).alias("path"), "a").unionByName(found.select("lang", F.slice("path", 2, F.size("path") - 1).alias("path"), "a"))
    most = offers.where("size(path) > 1").groupBy("lang", "path").agg(F.max("a").alias("most"))
    alone = found.join(most, ["lang", "path"], "left").where(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * share))
    # n of a language goes to its rows by a join of its own: there are as many as languages
    rows = alone.join(sizes, "lang")
    cut = F.transform(F.sequence(F.lit(1), F.size("left")), lambda k: F.struct(k.alias("k"), F.element_at("left", k).alias("l"), F.element_at("right", k).alias("r")))
    cuts = rows.select("lang", "path", "words", "a", "n", F.explode(cut).alias("c")).select("lang", "path", "words", "a", "n", "c.k", "c.l", "c.r")
    cuts = cuts.withColumn("score", F.expr(SCORE))
    best = cuts.groupBy("lang", "path").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "words")).alias("b")).select("lang", "b.*")
    phrase = F.array_join(F.transform("words", lambda w: w.cast("string")), " ")
    best = best.select("lang", phrase.alias("phrase"), "a", "l", "r", "n", "score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the first of each share of a language, then the first of these
    near = best.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("_k") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
