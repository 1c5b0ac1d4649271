"""Removal of repeated substrings with suffix arrays and common-prefix interval trees.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller id.  Equal strings are brought together by an anchor:
the piece of ``GRAM`` bytes with the smallest hash inside the string, which
equal strings share.  Neighbouring strings of a document mostly share their
anchor, so an anchor stands for a stretch of text, its context.

1. A fixed-size bit filter of the anchors that occur in more than one document,
   built by counting packed anchor hashes over all documents.
2. Hashes of the distinct contexts of anchors that pass the filter meet by
   anchor, with the smallest and greatest id of their documents.  An anchor with
   one context needs no more: beyond its smallest id the context goes whole.
   Anchors with several contexts enter a second filter, and only their contexts'
   bytes travel.  These form an enhanced suffix array for each anchor; a stack
   scan over its common prefixes enumerates the interval tree, and every interval
   of at least ``LENGTH`` common bytes whose left extensions differ is a maximal
   repeat, with all of its occurrences.  (What one and the same byte precedes
   everywhere is part of the longer repeat one byte to the left.)  These verdicts
   belong to contexts, not to places.
3. An anchor with more distinct contexts than a task should hold is resolved
   string by string instead, by a grouped minimum over their hashes.
4. Places of contexts join the verdicts; a row has those of one context and one
   buffer, so that a passage of very many documents is many rows.  Documents with
   greater ids than the verdict's are marked.
5. The marks of a document meet its text again, and overlapping marks merge.

The filter only saves work: a saturated filter lets anchors of one document
pass, and these mark nothing.

Defined results: null text is empty; rows with a null id are left whole and
count for no other; rows that share an id never remove from each other;
repeated rows are treated alike; an empty table gives no rows.  Extra columns
are carried along by ``without_repeats``; columns beginning with ``_rep`` are
reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 50, 24
#: Bits of the filter of shared anchors.
FILTER_BITS = 1 << 26
#: Contexts that one suffix array takes, about; distinct contexts of an anchor from which strings are resolved one by one.
BLOCK, CROWD = 5_000, 60_000
#: Contexts, places or marks that a task gathers before it passes them on.
BUFFER = 200_000
#: Anchors that a partition counts, about.
PART = 1_000_000
_PLACE = np.uint64((1 << 24) - 1)


class Anchors:
    """Anchors of the strings of some rows: hash, row, first string's start, bytes and hash of the context."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        n = len(raw)
        if n < LENGTH:
            self.hash, self.context = np.zeros((2, 0), np.uint64)
            self.row, self.start, self.size, self.begin = np.zeros((4, 0), np.int64)
            return
        c = C.prefix_hash(raw, C.EXACT)
        _, down = C.powers(n + 1)
        h = C.mix((c[GRAM:] - c[:-GRAM]) * down[: n - GRAM + 1])
        # the smallest hash of LENGTH - GRAM + 1 neighbours, the leftmost of equal ones
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, want = 1, LENGTH - GRAM + 1
        while width * 2 <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: n - LENGTH + 1], least[want - width : want - width + n - LENGTH + 1])
        at = (least & _PLACE).astype(np.int64)
        row = np.searchsorted(off, np.arange(n - LENGTH + 1), "right") - 1
        good = np.arange(LENGTH, n + 1) <= off[row + 1]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(change & good)
        # a stretch ends where the next begins or strings stop fitting
        stop = np.flatnonzero(np.append(~good[1:] | change[1:], True) & good)
        # the smallest hashes of windows are small numbers: mixed again, they fill filters and partitions evenly
        self.hash, self.row, self.start, self.size = C.mix(h[at[start]]), row[start], start - off[row[start]], stop - start + LENGTH
        self.begin = start
        self.context = C.span_hash(c, start, start + self.size)


def _pieces(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Steps over the rows: (bytes, offsets, first row, bytes left out before).  Rows too long for one step come in overlapping parts."""
    most = 8 << 20
    for i, j in C.steps(off):
        if off[j] - off[i] <= most:
            yield raw[off[i] : off[j]], off[i : j + 1] - off[i], i, 0
        else:  # one long row
            for s in range(0, int(off[j] - off[i]), most):
                part = raw[off[i] + s : min(off[i] + s + most + LENGTH - 1, off[j])]
                yield part, np.array([0, len(part)]), i, s


def _packed_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def pack() -> pa.RecordBatch:
            h = np.concatenate(held)
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, part = h[order], part[order]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            data = [h[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(h)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), pa.array(data, pa.binary())], ["part", "h"])

        for batch in batches:
            raw, off = C.flatten(batch.column("text"))
            for part, at, _, _ in _pieces(raw, off):
                found = Anchors(part, at)
                order = np.lexsort((found.row, found.hash))
                h, row = found.hash[order], found.row[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h = h[fresh]  # once for each row; of many rows, two say enough
                third = np.zeros(len(h), bool)
                third[2:] = (h[2:] == h[1:-1]) & (h[1:-1] == h[:-2])
                held.append(h[~third])
                size += len(held[-1])
                if size >= 2 * PART:
                    yield pack()
                    held, size = [], 0
        if size:
            yield pack()

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the bit filter: the anchors of these parts that come more than once."""
    blocks = [np.frombuffer(x, np.uint64) for batch in batches for x in batch.column("h").to_pylist()]
    if not blocks:
        return
    h = np.sort(np.concatenate(blocks))
    bit = np.unique(h[1:][h[1:] == h[:-1]] >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)
    word, first = np.unique(bit >> 6, return_index=True)
    mask = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first) if len(bit) else np.zeros(0, np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["w", "m"])


def _fewest(a: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal contexts made one; of an anchor's distinct contexts the first two, which say enough."""
    order = np.lexsort((c, a))
    a, c, low, high, size = (x[order] for x in (a, c, low, high, size))
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])) if len(a) else order
    if not len(new):
        return a, c, low, high, size
    a, c, low, high, size = a[new], c[new], np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), size[new]
    third = np.zeros(len(a), bool)
    third[2:] = a[2:] == a[:-2]
    return tuple(x[~third] for x in (a, c, low, high, size))


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed context hashes of whole anchors -> verdicts of anchors with one context (kind 0), filter words of the others (kind 1: a, c)."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for data in batch.column("h").to_pylist():
            x = np.frombuffer(data, np.int64).reshape(5, -1)
            held.append((x[0], x[1], x[2], x[2] + x[3], x[4]))
            size += x.shape[1]
        if size >= 4 * PART:  # what an anchor of very many contexts leaves is two of them
            held = [_fewest(*(np.concatenate(y) for y in zip(*held, strict=True)))]
            size = len(held[0][0])
    if not held:
        return
    a, c, low, high, long = _fewest(*(np.concatenate(y) for y in zip(*held, strict=True)))
    twin = np.zeros(len(a), bool)
    same = a[1:] == a[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    whole = np.flatnonzero(~twin & (high > low))
    names = ["kind", "a", "c", "start", "end", "m"]
    zero = np.zeros(len(whole), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero.astype(np.int32), a[whole], c[whole], zero, long[whole], low[whole])], names)
    bit = np.unique(a[twin].view(np.uint64) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)
    word, first = np.unique(bit >> 6, return_index=True)
    mask = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), first).view(np.int64) if len(bit) else word
    zero = np.zeros(len(word), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero.astype(np.int32) + 1, word, mask, zero, zero, zero)], names)


def intervals(lcp: np.ndarray, least: int, doc: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Interval tree of a suffix array, by a scan with a stack: (common bytes, first rank, last rank, smallest id).

    ``lcp[i]``: common prefix of ranks i-1 and i; only intervals of ``least`` or more count.  ``left``: the byte
    before each suffix, -1 where there is none; intervals with one and the same byte throughout are left out.
    """
    out: list[tuple[int, int, int, int]] = []
    high = np.append(lcp[1:] >= least, False)
    edge = np.flatnonzero(np.diff(high.astype(np.int8), prepend=0))
    common, ids, before = lcp.tolist(), doc.tolist(), left.tolist()
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        # ranks a .. b lie together
        stack: list[tuple[int, int, int, int, int]] = []  # common bytes, first rank, smallest id, smallest and greatest byte before
        for i in range(a, b + 1):
            low = common[i + 1] if i < b else -1
            first, m, x, y = i, ids[i], before[i], before[i]
            # intervals that end here take in what was found last, and become it
            while stack and stack[-1][0] >= max(low, 0):
                size, lb, m2, x2, y2 = stack.pop()
                first, m, x, y = lb, min(m, m2), min(x, x2), max(y, y2)
                if size == low:
                    break
                if x < 0 or x != y:
                    out.append((size, first, i, m))
            if low >= 0:
                stack.append((low, first, m, x, y))
    return out


def maximal_repeats(texts: list[bytes], docs: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of the maximal repeats among ``texts``: (text, offset, bytes, smallest id of the repeat)."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    many = np.maximum(size - least + 1, 0)
    which = np.repeat(np.arange(len(texts)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    rest = size[which] - offset
    wide = -(-int(size.max(initial=least)) // 8) * 8
    flat = np.frombuffer(b"".join(texts) + b"\0" * wide, np.uint8)
    at = begin[which] + offset
    table = flat[at[:, None] + np.arange(wide)]
    table[np.arange(wide)[None, :] >= rest[:, None]] = 0
    keys = table.view(">u8")
    order = np.lexsort(tuple(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)))
    table, which, offset, rest, at = table[order], which[order], offset[order], rest[order], at[order]
    differ = table[1:] != table[:-1]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), wide)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(rest[1:], rest[:-1]))
    left = np.where(offset > 0, flat[np.maximum(at - 1, 0)].astype(np.int64), -1)
    found = intervals(lcp, least, docs[which], left)
    if not found:
        return (np.zeros(0, np.int64),) * 4
    common, first, last, m = (np.array(x, np.int64) for x in zip(*found, strict=True))
    each = last - first + 1
    rank = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return which[rank], offset[rank], np.repeat(common, each), np.repeat(m, each)


def _verdicts(a: np.ndarray, low: np.ndarray, high: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end, id): bytes of each distinct context that go from documents beyond the id.

    Contexts come sorted by anchor, with the smallest and greatest id of their documents.
    """
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    count = np.diff(np.append(first, len(a)))
    several = np.repeat(np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first), count)
    size = np.array([len(t) for t in texts], np.int64)
    # a context that is there with a smaller id goes whole
    own = np.flatnonzero(high > low)
    out = [(own, np.zeros(len(own), np.int64), size[own], low[own])]
    mixed = np.flatnonzero(several & np.repeat(count > 1, count))
    if len(mixed):
        which, offset, common, m = maximal_repeats([texts[k] for k in mixed], low[mixed])
        k = mixed[which]
        hit = high[k] > m
        out.append((k[hit], offset[hit], (offset + common)[hit], m[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _merged(u: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals sorted by owner and start: (owner, start, end, place of its first)."""
    if not len(u):
        return u, s, e, u
    part = np.concatenate([[0], np.cumsum(u[1:] != u[:-1])])
    base = part * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + base)
    new = np.ones(len(u), bool)
    new[1:] = s[1:] + base[1:] > reach[:-1]
    k = np.flatnonzero(new)
    return u[k], s[k], np.maximum.reduceat(e + base, k) - base[k], k


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor and hash -> verdicts (kind 0: a, c, start, end, id), or single strings (kind 1: a, c, start, hash, id)."""
    names = ["kind", "a", "c", "start", "end", "m"]
    held: list[tuple] = []
    size, crowd = 0, None

    def verdicts(rows: list[tuple]) -> pa.RecordBatch:
        a, c, low, high = (np.concatenate([r[k] for r in rows]) for k in range(4))
        k, start, end, m = _verdicts(a, low, high, [t for r in rows for t in r[4]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(len(k), np.int32), a[k], c[k], start, end, m)], names)

    def strings(r: tuple) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(r[4]), np.uint8)
        long = np.array([len(t) for t in r[4]], np.int64)
        many = long - LENGTH + 1
        row = np.repeat(np.arange(len(long)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = (np.cumsum(long) - long)[row] + at
        h = C.span_hash(C.prefix_hash(raw, C.EXACT), begin, begin + LENGTH).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ones(len(row), np.int32), r[0][row], r[1][row], at, h, r[2][row])], names)

    for row in _distinct(batches):
        a = row[0][0]
        if crowd is not None and crowd == a:
            yield strings(row)
            continue
        crowd = None
        if held and held[-1][0][0] != a and size >= BLOCK:
            yield verdicts(held)
            held, size = [], 0
        held.append(row)
        size += len(row[0])
        # an anchor that is too much for one task: all of its contexts leave as strings
        if size > CROWD and sum(len(r[0]) for r in held if r[0][0] == a) > CROWD:
            crowd = a
            yield from (strings(r) for r in held if r[0][0] == a)
            held = [r for r in held if r[0][0] != a]
            size = sum(len(r[0]) for r in held)
    if held:
        yield verdicts(held)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of one anchor (a, c, low, high, texts), equal contexts made one; a run goes on where a batch or a stretch of it ends."""
    last: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(x).to_numpy() for x in ("a", "c", "low", "high")] + [batch.column("ctx").to_pylist()]
        if last is not None:
            cols = [np.concatenate([x, y]) if k < 4 else x + y for k, (x, y) in enumerate(zip(last, cols, strict=True))]
        a, c, low, high, text = cols
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
        cols = [a[new], c[new], np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), [text[k] for k in new]]
        last = [x[-1:] for x in cols]  # more of this context may follow
        cols = [x[:-1] for x in cols]
        if not len(cols[0]):
            continue
        edge = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]])).tolist()
        for i, j in zip(edge, [*edge[1:], len(cols[0])], strict=True):
            yield tuple(x[i:j] for x in cols)
    if last is not None:
        yield tuple(last)


def _words(words: DataFrame) -> np.ndarray:
    """A filter out of its 64-bit words (w, m): FILTER_BITS / 64 rows at most reach the driver, whatever the input."""
    found = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return table


def _filter(rows: DataFrame) -> np.ndarray:
    """A filter out of its bits ``bit``."""
    return _words(rows.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("m")))


def _passes(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, sub, s, e): starts and ends of the marks of every document that has any; ``sub`` tells texts of one id apart."""
    spark = docs.sparkSession
    rows = C.small_batches(docs).where(f"doc_id is not null and octet_length(text) >= {LENGTH}").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _sub())
    _, size = C.text_size(docs)
    parts = C.parts_for(size // 17, PART)
    packed = rows.select("text").mapInArrow(C.trimmed(_packed_anchors(parts)), "part int, h binary").repartition(parts, "part")
    words = packed.mapInArrow(C.trimmed(_several), "w long, m long")
    shared = spark.sparkContext.broadcast(_words(words))
    shift = np.uint64(64 - FILTER_BITS.bit_length() + 1)

    def anchors(batch: pa.RecordBatch, table: np.ndarray):
        """Anchors that pass a filter: (bytes of the step, anchors, places, rows of the batch, bytes left out before)."""
        raw, off = C.flatten(batch.column("text"))
        for part, at, i, skipped in _pieces(raw, off):
            found = Anchors(part, at)
            k = np.flatnonzero(_passes(table, found.hash >> shift))
            if len(k):
                yield part, found, k, found.row[k] + i, skipped

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct contexts of a buffer by their hashes, packed by partition."""
        held: list[tuple] = []
        size = 0

        def pack() -> pa.RecordBatch:
            a, c, low, high, long = (np.concatenate(x) for x in zip(*held, strict=True))
            a, c, low, high, long = _fewest(a, c, low, high, long)
            part = ((a.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            every, part = np.stack([a, c, low, high - low, long])[:, order], part[order]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            data = [every[:, i:j].tobytes() for i, j in zip(edge, [*edge[1:], len(part)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), pa.array(data, pa.binary())], ["part", "h"])

        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            for _, found, k, row, _ in anchors(batch, shared.value):
                held.append((found.hash[k].view(np.int64), found.context[k].view(np.int64), doc[row], doc[row], found.size[k]))
                size += len(k)
                if size >= 2 * BUFFER:
                    yield pack()
                    held, size = [], 0
        if size:
            yield pack()

    kinds = rows.mapInArrow(C.trimmed(hashes), "part int, h binary").repartition(parts, "part")
    kinds = C.keep(kinds.mapInArrow(C.trimmed(_kinds), "kind int, a long, c long, start long, end long, m long"), "kinds")
    several = spark.sparkContext.broadcast(_words(kinds.where("kind = 1").select(F.col("a").alias("w"), F.col("c").alias("m"))))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct contexts of a buffer: (a, c, low, high, ctx)."""
        held: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            a, c, low, high, n = (np.concatenate([h[x] for h in held]) for x in range(5))
            data = np.concatenate([h[5] for h in held])
            begin = np.cumsum(n) - n
            order = np.lexsort((c, a))
            a, c = a[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
            one = order[new]
            to = np.append(0, np.cumsum(n[one]))
            ctx = data[np.repeat(begin[one] - to[:-1], n[one]) + np.arange(to[-1])]
            ctx = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(ctx)])
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(c[new]), pa.array(np.minimum.reduceat(low[order], new)), pa.array(np.maximum.reduceat(high[order], new)), ctx], ["a", "c", "low", "high", "ctx"])

        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            for part, found, k, row, _ in anchors(batch, several.value):
                a, c, d = found.hash[k].view(np.int64), found.context[k].view(np.int64), doc[row]
                order = np.lexsort((c, a))
                new = np.flatnonzero(np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])]))
                one = k[order[new]]
                n = found.size[one]
                to = np.append(0, np.cumsum(n))
                data = part[np.repeat(found.begin[one] - to[:-1], n) + np.arange(to[-1])]
                held.append((a[order[new]], c[order[new]], np.minimum.reduceat(d[order], new), np.maximum.reduceat(d[order], new), n, data))
                size += len(one)
                if size >= BUFFER:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()

    met = rows.mapInArrow(C.trimmed(contexts), "a long, c long, low long, high long, ctx binary")
    met = met.repartition(C.parts_for(size, 16 << 20), "a").sortWithinPartitions("a", "c")
    found = C.keep(met.mapInArrow(C.trimmed(_resolved), "kind int, a long, c long, start long, end long, m long"), "verdicts")
    strings = found.where("kind = 1").select("a", "c", "start", F.col("end").alias("h"), "m")
    least = strings.groupBy("h").agg(F.min("m").alias("m"))
    single = strings.drop("m").join(least, "h").select("a", "c", "start", (F.col("start") + LENGTH).alias("end"), "m")
    verdict = F.struct("start", "end", "m")
    whole = kinds.where("kind = 0").select("a", "c", "start", "end", "m")
    verdicts = C.keep(found.where("kind = 0").select("a", "c", "start", "end", "m").unionByName(whole).unionByName(single).groupBy("a", "c").agg(F.collect_list(verdict).alias("v")), "resolved")
    told = spark.sparkContext.broadcast(_filter(verdicts.select(F.col("c").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("bit"))))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of contexts that may have a verdict, those of a context and buffer in one row: (a, c, doc_id, sub, at)."""
        held: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            a, c, doc, sub, at = (np.concatenate([h[x] for h in held]) for x in range(5))
            order = np.lexsort((c, a))
            a, c = a[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])]))
            to = np.append(new, len(a))
            lists = [C.list_array(x[order], to) for x in (doc, sub, at)]
            return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(c[new]), *lists], ["a", "c", "doc_id", "sub", "at"])

        for batch in batches:
            doc, sub = batch.column("doc_id").to_numpy(), batch.column("sub").to_numpy()
            for _, found, k, row, skipped in anchors(batch, shared.value):
                hit = _passes(told.value, found.context[k] & np.uint64(FILTER_BITS - 1))
                k, row = k[hit], row[hit]
                held.append((found.hash[k].view(np.int64), found.context[k].view(np.int64), doc[row], sub[row], (found.start[k] + skipped).astype(np.int32)))
                size += len(k)
                if size >= BUFFER:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()

    places = rows.mapInArrow(C.trimmed(occurrences), "a long, c long, doc_id array<long>, sub array<int>, at array<int>")
    marks = places.join(verdicts, ["a", "c"]).mapInArrow(C.trimmed(_marks), "doc_id long, sub int, start int, end int")
    return marks.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "end")).alias("v"))


def _sub():
    """32 bits of the text's hash: rows that share an id but not a text are told apart by it."""
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("sub")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the documents beyond each verdict's id, overlapping ones of a buffer made one."""
    held: list[np.ndarray] = []
    size = 0

    def emit() -> pa.RecordBatch:
        doc, sub, s, e = np.concatenate(held, axis=1)
        order = np.lexsort((s, sub, doc))
        doc, sub, s, e = doc[order], sub[order], s[order], e[order]
        owner = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])]))
        _, s2, e2, k = _merged(owner, s, e)
        return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(sub[k].astype(np.int32)), pa.array(s2.astype(np.int32)), pa.array(e2.astype(np.int32))], ["doc_id", "sub", "start", "end"])

    for batch in batches:
        doc, to = C.flatten_list(batch.column("doc_id"))
        sub, _ = C.flatten_list(batch.column("sub"))
        at, _ = C.flatten_list(batch.column("at"))
        v, v_to = C.flatten_list_structs(batch.column("v"))
        # every place of a row with every verdict of its context
        places, many = np.diff(to), np.diff(v_to)
        each = np.repeat(many, places)
        p = np.repeat(np.arange(len(doc)), each)
        q = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(v_to[:-1], places), each)
        hit = doc[p] > v["m"][q]
        p, q = p[hit], q[hit]
        held.append(np.stack([doc[p], sub[p].astype(np.int64), at[p] + v["start"][q], at[p] + v["end"][q]]))
        size += len(p)
        if size >= BUFFER:
            yield emit()
            held, size = [], 0
    if size:
        yield emit()


def _cut_out(text: pa.Array, marks: pa.Array) -> pa.Array:
    raw, off = C.flatten(text)
    gone = np.zeros(len(raw) + 1, np.int32)
    v, at = C.flatten_list_structs(marks)
    base = np.repeat(off[:-1], np.diff(at))
    np.add.at(gone, v["start"] + base, 1)
    np.add.at(gone, v["end"] + base, -1)
    out = np.cumsum(gone[:-1]) > 0
    count = np.append(0, np.cumsum(out))
    # a run begins at a removed byte after a kept one, or with its row
    head = np.zeros(len(raw) + 1, bool)
    head[off[:-1]] = True
    before = np.append(False, out[:-1]) if len(out) else out
    runs = np.append(0, np.cumsum(out & (head[:-1] | ~before)))
    kept = raw[~out]
    to = off - count[off]
    data = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))])
    return pa.StructArray.from_arrays([pa.array(np.diff(off)), pa.array(np.diff(count[off]).astype(np.int64)), pa.array(np.diff(runs[off]).astype(np.int64)), data], ["n_bytes", "n_removed", "n_spans", "kept"])


def _with_cuts(docs: DataFrame) -> DataFrame:
    marks = _found(docs).select(F.col("doc_id").alias("_rep_id"), F.col("sub").alias("_rep_s"), F.col("v").alias("_rep_v"))
    rows = docs.withColumn("_rep_sub", _sub())
    rows = rows.join(marks, (rows.doc_id == F.col("_rep_id")) & (F.col("_rep_sub") == F.col("_rep_s")), "left")
    cut = F.arrow_udf(_cut_out, "struct<n_bytes long, n_removed long, n_spans long, kept binary>")
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    return rows.withColumn("_rep", cut("text", F.coalesce("_rep_v", none))).drop("_rep_id", "_rep_s", "_rep_sub", "_rep_v")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    got = _with_cuts(docs.select("doc_id", "text"))
    return got.select("doc_id", "_rep.n_bytes", "_rep.n_removed", "_rep.n_spans", F.sha2("_rep.kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of the text, for all of its rows.

    A character of which some bytes went is taken out whole; rows that nothing
    was removed from keep their text, null included.
    """
    got = _with_cuts(docs)
    text = F.when(F.col("_rep.n_removed") == 0, F.col("text")).otherwise(F.arrow_udf(_decoded, "string")("_rep.kept"))
    return got.withColumn("text", text).select(*docs.columns)


def _decoded(column: pa.Array) -> pa.Array:
    return pa.array([v.decode("utf-8", "ignore") if v is not None else None for v in column.to_pylist()], pa.string())
