"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token ids.  A document longer than a sequence is cut, its first
piece taking the remainder; full pieces are sequences of their own and only
shorter ones are packed.  These fall into shards of bounded size by a hash of
their number.  A shard's lengths go to several islands.  On an island,
packings (sets of bins) evolve: crossover injects the other parent's whole
well-filled bins, removes the bins that hold duplicates, and puts displaced
documents back by best fit; mutation empties badly filled bins.  After each
epoch an island's elite moves to its neighbour.  The best packing of a shard's
islands is kept.

An island is one row of a DataFrame with one shard's lengths, so evolution is
a scan over rows and migration is a join.  Tokenizing splits texts by the
tokenizer's own pattern, on code point arrays, and asks the tokenizer once for
each distinct piece of a buffer that it has not met before.

Defined results: null text is empty; every document, empty ones too, has the
separator id and so a piece; repeated rows are documents of their own; an
empty table gives no pieces.  Extra columns are not carried along.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY, SEPARATOR = 1024, 2
#: Pieces of a shard, about; islands of a shard; epochs; generations of an epoch; packings of an island.
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 20_000, 2, 2, 6, 4
#: A bin filled less than this share is packed once more, with those of other shards.
FILLED = 0.99
#: Distinct pieces that a task remembers before it forgets them all.
REMEMBERED = 600_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- tokens ---------------------------------------------------------------

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)
# fixed values: white space of Unicode
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# fixed values: the contractions that the tokenizer's pattern names
_SHORT = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _classes() -> np.ndarray:
    """Class of each code point of the first plane; unsure where Unicode versions may differ."""
    out = np.full(0x10000, _UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    for x in range(0x10000):
        now = unicodedata.category(chr(x))
        if now == old(chr(x)) and now not in ("Cn", "Cs"):
            out[x] = _LETTER if now[0] == "L" else _NUMBER if now[0] == "N" else _OTHER
    out[list(_WHITE)] = _SPACE
    return out


class Encoder:
    """Ids of texts, with a memory of pieces."""

    def __init__(self, path: str):
        # tasks are what runs side by side; the library's threads would each hold memory of their own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Literals that the tokenizer takes out of texts before anything else.
        self.literals = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        #: Tables of (hash, first id, ids), sorted by hash: all that is remembered, and what came lately.
        self.tables = [(np.zeros(0, np.uint64), none, none)] * 2
        self.pool = np.zeros(1 << 20, np.uint32)
        self.size = 0

    def _learn(self, value: np.ndarray, pieces: list[str]) -> None:
        """Asks the tokenizer for new pieces, a few at a time: what it returns is large."""
        count = np.zeros(len(pieces), np.int64)
        begin = np.zeros(len(pieces), np.int64)
        for k in range(0, len(pieces), 2048):
            for i, e in enumerate(self.tokenizer.encode_batch_fast(pieces[k : k + 2048], add_special_tokens=False), k):
                ids = e.ids
                count[i], begin[i] = len(ids), self.size
                if self.size + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
                self.pool[self.size : self.size + len(ids)] = ids
                self.size += len(ids)
        late = _joined(self.tables[1], (value, begin, count))
        self.tables[1] = late
        if len(late[0]) > 60_000:
            self.tables = [_joined(self.tables[0], late), (np.zeros(0, np.uint64), begin[:0], begin[:0])]

    def _recalled(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each piece, -1 for those not remembered."""
        begin, count = np.full((2, len(value)), -1, np.int64)
        for known, b, c in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = known[at] == value
                begin[hit], count[hit] = b[at[hit]], c[at[hit]]
        return begin, count

    def _starts(self, cp: np.ndarray, kind: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pattern begins a match."""
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[off] = True
        space = kind == _SPACE
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 255, kind[:-1]
        before[first[:-1]] = 255
        start = before != kind
        # the last white space before other text is left to it: a blank joins it, any other stands alone
        ahead = np.zeros(n, bool)
        ahead[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
        start |= ahead
        joined = np.flatnonzero(ahead & (cp == 32)) + 1
        start[joined] = False
        for i in np.flatnonzero((cp == 39) & start):
            end = min(i + 3, off[np.searchsorted(off, i, "right")])
            text = "".join(map(chr, cp[i:end]))
            short = next((s for s in _SHORT if text.startswith(s)), None)
            if short:
                start[i + 1 : i + len(short)] = False
                if i + len(short) < n:
                    start[i + len(short)] = True
        return np.flatnonzero(start)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row, and the rows' offsets."""
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        text = raw.tobytes()
        cp = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        cp_off = np.searchsorted(byte, off)
        kind = np.where(cp < 0x10000, self.classes[np.minimum(cp, 0xFFFF)], _UNSURE).astype(np.uint8)
        start = byte[self._starts(cp, kind, cp_off)]
        end = np.append(start[1:], len(raw))
        h = C.text_hash(raw, C.EXACT, start, end)
        value, one, which = np.unique(h, return_index=True, return_inverse=True)
        begin, count = self._recalled(value)
        new = np.flatnonzero(begin < 0)
        if len(new):
            if len(self.tables[0][0]) + len(new) > REMEMBERED:
                self.forget()
                new = np.arange(len(value))
            self._learn(value[new], [text[start[k] : end[k]].decode("utf-8", "replace") for k in one[new]])
            begin, count = self._recalled(value)
        count, begin = count[which], begin[which]
        total = np.cumsum(count)
        ids = self.pool[np.repeat(begin - (total - count), count) + np.arange(total[-1])]
        row_at = np.append(0, total)[np.searchsorted(start, off)]
        # rows with a code point of unsure class or with a literal, as the tokenizer itself splits them
        odd = np.searchsorted(cp_off, np.flatnonzero(kind == _UNSURE), "right") - 1
        for x in self.literals:
            odd = np.append(odd, np.searchsorted(off, [m.start() for m in re.finditer(re.escape(x), text)], "right") - 1)
        odd = np.unique(odd).astype(np.int64)
        if len(odd):
            parts = [ids[row_at[i] : row_at[i + 1]] for i in range(n)]
            for i in odd:
                whole = text[off[i] : off[i + 1]].decode("utf-8", "replace")
                parts[i] = np.array(self.tokenizer.encode(whole, add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            row_at = np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, row_at


def _joined(a: tuple, b: tuple) -> tuple:
    value, begin, count = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.argsort(value)
    return value[order], begin[order], count[order]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, until its task ends: workers wait beside those that work, and a tokenizer is large."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """The pieces of all documents (doc_id, text), numbered (uid) without repetition."""
    path = path or tokenizer_path()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:
            _encoders.clear()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, uid = encoder(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            raw, off = C.flatten(batch.column("text"))
            doc_id = batch.column("doc_id")
            for i, j in C.steps(off, 1 << 20):
                ids, at = tokens.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                size = np.diff(at) + 1
                many = -(-size // capacity)
                row = np.repeat(np.arange(j - i), many)
                number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                head = size - (many - 1) * capacity
                start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
                length = np.where(number == 0, head[row], capacity)
                own = np.empty(len(ids) + j - i, "<u4")
                own_at = at + np.arange(j - i + 1)
                own[own_at[1:] - 1] = separator
                keep = np.ones(len(own), bool)
                keep[own_at[1:] - 1] = False
                own[keep] = ids
                data, place = memoryview(own.tobytes()), (own_at[row] + start) * 4
                crc = [zlib.crc32(data[a : a + 4 * b]) for a, b in zip(place.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_id[i:j].take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.arange(uid, uid + len(row)))], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
                uid += len(row)

    return C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.trimmed(scan), PIECES)


# -- grouping genetic algorithm ------------------------------------------


class Packing:
    """Bins of item numbers with their free space; free classes are the bits of one number."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def copy(self) -> Packing:
        out = Packing(self.lengths, self.capacity)
        out.bins, out.free = list(self.bins), list(self.free)
        return out

    def insert(self, items: list[int]) -> None:
        """Best fit: each item to the fullest bin that it fits."""
        at: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, room in enumerate(self.free):
            at[room].append(b)
            mask |= 1 << room
        touched = set()
        for x in items:
            size = self.lengths[x]
            able = mask >> size
            if able:
                room = size + (able & -able).bit_length() - 1
                b = at[room].pop()
                if not at[room]:
                    mask ^= 1 << room
                if b not in touched:
                    self.bins[b] = list(self.bins[b])
                    touched.add(b)
                self.bins[b].append(x)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([x])
                self.free.append(0)
                touched.add(b)
            self.free[b] = room - size
            if room > size:
                at[room - size].append(b)
                mask |= 1 << (room - size)

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then a more uneven filling."""
        return -len(self.bins), sum((self.capacity - f) ** 2 for f in self.free)

    def drop(self, gone: list[bool]) -> list[int]:
        """Removes bins and returns their items."""
        out = [x for b, items in enumerate(self.bins) if gone[b] for x in items]
        self.bins = [items for b, items in enumerate(self.bins) if not gone[b]]
        self.free = [f for b, f in enumerate(self.free) if not gone[b]]
        return out


def _longest_first(p: Packing, items: list[int]) -> list[int]:
    return sorted(items, key=lambda x: (-p.lengths[x], x))


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """``a`` with well-filled bins of ``b`` injected whole."""
    order = np.argsort(b.free, kind="stable")
    half = order[: max(1, len(order) // 2)]
    chosen = half[rng.random(len(half)) < 0.5]
    brought = {x for k in chosen for x in b.bins[k]}
    child = a.copy()
    displaced = child.drop([not brought.isdisjoint(items) for items in child.bins])
    child.bins += [list(b.bins[k]) for k in chosen]
    child.free += [b.free[k] for k in chosen]
    child.insert(_longest_first(child, [x for x in displaced if x not in brought]))
    return child


def mutate(p: Packing, rng: np.random.Generator, share: float = 0.06) -> None:
    """Empties the worst bins and some others, and puts their items back."""
    n = len(p.bins)
    gone = rng.random(n) < share / 2
    gone[np.argsort(p.free, kind="stable")[n - max(1, int(n * share)) :]] = True
    p.insert(_longest_first(p, p.drop(gone.tolist())))


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """One epoch of an island: the bin of each item in the best packing found.  ``seeds``: packings to begin with."""
    rng = np.random.default_rng(seed)
    size = lengths.tolist()
    people: list[Packing] = []
    for bin_of in seeds:
        p = Packing(size, capacity)
        order = np.argsort(bin_of, kind="stable")
        p.bins = [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1)] if len(order) else []
        p.free = [capacity - sum(size[x] for x in items) for items in p.bins]
        people.append(p)
    while len(people) < population:
        p = Packing(size, capacity)
        noise = rng.normal(0, 0.15 * capacity * bool(people), len(size)) if len(size) else []
        p.insert(np.argsort(-(lengths + noise), kind="stable").tolist())
        people.append(p)
    for _ in range(generations):
        people.sort(key=Packing.fitness, reverse=True)
        children = []
        for k in range(max(1, population // 2)):
            child = crossover(people[k % len(people)], people[int(rng.integers(len(people)))], rng)
            mutate(child, rng)
            children.append(child)
        people = sorted(people + children, key=Packing.fitness, reverse=True)[:population]
    best = max(people, key=Packing.fitness)
    out = np.zeros(len(size), np.int32)
    for b, items in enumerate(best.bins):
        out[items] = b
    return out


def _epoch(rows: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """Every island (a row: shard, island, lengths, elite, guest) one epoch further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                seeds = [np.array(r[k], np.int64) for k in ("elite", "guest") if r[k] is not None]
                bin_of = evolve(lengths, seeds, (r["shard"] * 31 + r["island"]) * 31 + epoch, capacity)
                filled = np.bincount(bin_of, lengths)
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([r["lengths"]], pa.list_(pa.int32())), pa.array([bin_of.tolist()], pa.list_(pa.int32())), pa.array([len(filled)], pa.int64()), pa.array([float((filled**2).sum())])], ["shard", "island", "lengths", "elite", "bins", "even"])

    return C.cut(rows.select("shard", "island", "lengths", "elite", "guest").mapInArrow(C.trimmed(run), "shard long, island int, lengths array<int>, elite array<int>, bins long, even double"))


def _evolved(groups: DataFrame, first: DataFrame, islands: int, epochs: int, capacity: int) -> DataFrame:
    """(shard, uid, length, bin): the best packing of each shard's items (length, uid).  ``first``: (shard, elite), a packing to begin with, or null."""
    none = F.lit(None).cast("array<int>")
    state = groups.join(first, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.transform("items", lambda x: x["length"]).alias("lengths"), "elite", none.alias("guest"))
    state = state.repartition("shard", "island")
    for epoch in range(epochs):
        if epoch:
            guest = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("elite").alias("guest"))
            state = state.select("shard", "island", "lengths", "elite").join(guest, ["shard", "island"])
        state = _epoch(state, epoch, capacity)
    best = state.groupBy("shard").agg(F.max_by("elite", F.struct(-F.col("bins"), F.col("even"), -F.col("island"))).alias("elite"))
    item = F.explode(F.arrays_zip(F.transform("items", lambda x: x["uid"]).alias("uid"), F.transform("items", lambda x: x["length"]).alias("length"), F.col("elite").alias("bin")))
    return groups.join(best, "shard").select("shard", item.alias("i")).select("shard", "i.uid", "i.length", "i.bin")


def packed(all_pieces: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, shard: int = SHARD) -> DataFrame:
    """``all_pieces`` (uid, length, ...) with sequence_id and offset in place of uid; pieces are read more than once.

    Shards evolve apart; then the bins that each has filled badly meet those of other shards, bin by bin, and evolve once more from where they are.
    """
    short = all_pieces.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length"))
    n = short.count()
    # about ``shard`` rows each, whatever the documents: the shard is a hash of the piece's number
    piece_shard = F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-n // shard))))
    groups = C.cut(short.groupBy(piece_shard.alias("shard")).agg(F.array_sort(F.collect_list(F.struct("length", "uid"))).alias("items")))
    items = C.keep(_evolved(groups, groups.select("shard", F.lit(None).cast("array<int>").alias("elite")), islands, epochs, capacity), "shards")
    bins = items.groupBy("shard", "bin").agg(F.sum("length").alias("filled"), F.count(F.lit(1)).alias("k"))
    bad = C.cut(bins.where(F.col("filled") < FILLED * capacity).select("shard", "bin", "k"))
    again = max(1, -(-int(bad.agg(F.sum("k")).first()[0] or 0) // shard))
    meet = F.pmod(F.xxhash64("shard", "bin"), F.lit(again))
    loose = items.join(bad, ["shard", "bin"]).select(meet.alias("shard"), F.struct("length", "uid", F.xxhash64("shard", "bin").alias("b")).alias("x"))
    groups = C.cut(loose.groupBy("shard").agg(F.array_sort(F.collect_list("x")).alias("items")))
    begun = groups.select("shard", F.transform("items", lambda x: x["b"]).alias("elite"))
    regrouped = _evolved(groups, begun, islands, 1, capacity)
    place = lambda df, kind: df.select("uid", "length", (F.col("shard") * (1 << 21) + F.col("bin") * 2 + kind).alias("sequence_id"))
    items = place(items.join(bad, ["shard", "bin"], "left_anti"), 0).unionByName(place(regrouped, 1))
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    items = items.select("uid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    own = all_pieces.columns
    rest = [F.col(c) for c in own if c != "uid"]
    # full pieces number their sequences below zero, so that the two kinds never meet
    full = all_pieces.where(F.col("length") >= capacity).select(*rest, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(all_pieces.where(F.col("length") < capacity).join(items, "uid").select(*rest, "sequence_id", "offset"))


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every piece of every document with its place."""
    return packed(C.keep(pieces(docs, path), "pieces"))
