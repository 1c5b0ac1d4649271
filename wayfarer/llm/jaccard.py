"""N-gram Jaccard self-join with signature trees.

Documents with equal shingle sets are one class.  Two classes that are similar
share a shingle among the first of each, in any common order of shingles (the
prefix principle), so classes meet under the shingles of their prefixes.  The
order puts frequent shingles last: a sketch of fixed size, counted over all
documents, ranks shingles by powers of two of their frequency, so that common
passages key nothing.  The sketch moves work, never results.

1. Star links: under each key every class is checked against the smallest and
   the largest one.  The links found give first components.
2. Signature trees: only keys under which different components meet go on.
   The members of a key form a tree whose nodes hold the OR of their token
   bitmaps, their range of sizes and the tokens that share a bit at most.  A
   dual traversal drops node pairs whose greatest possible overlap is too small
   for their sizes, and pairs of nodes inside one component.  What is left at
   the rows is compared by wider bitmaps in the same task.
3. A task returns no list of pairs but a few spanning forests of them, so never
   more than a small multiple of its members.  The forests' pairs are compared
   exactly: those that are similar join components, the others are refuted.
   Keys that had more pairs, and where components still meet, take another
   round, without the refuted pairs and with more forests, until none is left.

Similar classes meet in 1 or 2 unless a chain of links already joins them, and
every pair that 2 leaves is joined or refuted in 3; so components are exact.

Classes are told apart by 128 bits: two hashes of the set, where the second
only enters the name of a class whose first hash another class shares.

Defined results: null and blank texts have an empty set and no links, their
component is their own id; rows with a null id have a null component and no
links; repeated rows are one class; an empty table gives no rows.  An id names
one text: rows that share an id but not a text count as different documents.
Extra columns aren't carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, PERCENT = 5, 80
#: Cells of the frequency sketch: a power of two between these, about one for 32 shingles.
CELLS_LEAST, CELLS_MOST = 1 << 18, 1 << 24
CHUNK = 1 << 15
#: Bits of a token bitmap in trees; of the widest one that goes to a key; children of a tree node; levels; members of a block.
BITS, UNIT_BITS, FAN, LEVELS, BLOCK = 2048, 4096, 8, 4, 1024
#: Forests that a key returns in the first round, and so many times more in each later one; by the last, no block has more pairs.
FORESTS, ROUNDS = 8, 8
#: Keys of a partition, about, and how many of them a task gathers at a time before it passes them on.
KEYS, BUFFER = 2_000_000, 200_000
#: Bits of the filter for the classes whose sets are wanted.
FILTER_BITS = 1 << 24


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n elements has with a similar one."""
    return -(-n * percent // 100)


def _set_keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    c = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(C.mix(values), out=c[0, 1:])
    np.cumsum(C.mix(values ^ np.uint64(0xA5A5A5A5DEADBEEF)), out=c[1, 1:])
    n = np.diff(at).astype(np.uint64)
    return tuple(C.mix((x[at[1:]] - x[at[:-1]]) ^ n).view(np.int64) for x in c)


def class_names(values: np.ndarray, at: np.ndarray, clashing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of each set's class, and the second hash.  ``clashing``: sorted first hashes that unlike sets share."""
    a, b = _set_keys(values, at)
    if len(clashing):
        hit = np.isin(a, clashing)
        a = np.where(hit, C.mix(a.view(np.uint64) ^ C.mix(b.view(np.uint64))).view(np.int64), a)
    return a, b


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = C.flatten(batch.column("text"))
    for i, j in C.steps(off):
        yield i, j, *C.shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], width)


# -- classes and sketch -------------------------------------------------------


def _measure(docs: DataFrame, width: int, cells: int, clashing: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, cid, cid2) of every row, and the sketch's counts."""
    shift = np.uint64(64 - cells.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(cells, np.int64)
        names = ["doc_id", "n", "cid", "cid2", "chunk", "counts"]
        for batch in batches:
            for i, j, values, at in _sets(batch, width):
                count += np.bincount((values >> shift).astype(np.int64), minlength=cells)
                a, b = class_names(values, at, clashing)
                none = np.diff(at) == 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j].cast(pa.int64()), pa.array(np.diff(at)), pa.array(a, mask=none), pa.array(b, mask=none), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names)
        rows = [(k, zlib.compress(part.astype("<u4").tobytes(), 1)) for k, part in enumerate(count.reshape(-1, CHUNK)) if part.any()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), pa.int64()) for _ in range(4)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

    both = C.keep(docs.select("doc_id", "text").mapInArrow(C.trimmed(run), "doc_id long, n long, cid long, cid2 long, chunk int, counts binary"), "measured")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.astype("<i8").tobytes(), 1) for v in total.values()], pa.binary())], ["chunk", "counts"])

    # cells / CHUNK rows, whatever the input
    chunks = both.where("chunk is not null").select("chunk", "counts").repartition(12, "chunk").mapInArrow(C.trimmed(add), "chunk int, counts binary").collect()
    sketch = np.zeros(cells, np.int64)
    for r in chunks:
        sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return both.where("chunk is null").drop("chunk", "counts"), sketch


def _levels(sketch: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequency level of each cell, 0 for the usual ones; and the count where level 1 begins."""
    usual = int(max(16, 4 * sketch.mean()))
    return np.ceil(np.log2(np.maximum(sketch / usual, 1))).astype(np.uint8), usual


# -- keys -----------------------------------------------------------------


def bitmap(values: np.ndarray, bits: int) -> bytes:
    """Token bitmap of a set; a narrower one of the same set is this one folded."""
    out = np.zeros(bits, bool)
    out[(C.mix(values ^ np.uint64(0x51ED270B)) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def fine_bits(n: int) -> int:
    """Bits of the bitmap that a pair is looked at with: four to eight for each element."""
    return max(BITS, 1 << (4 * n - 1).bit_length())


def _keyed(docs: DataFrame, width: int, percent: int, level: np.ndarray, usual: int, parts: int, clashing: np.ndarray) -> DataFrame:
    """Prefix keys of every class, packed by partition: (part, keys)."""
    spark = docs.sparkSession
    # one byte a cell: CELLS_MOST bytes at most
    shared = spark.sparkContext.broadcast(level)
    shift = np.uint64(64 - len(level).bit_length() + 1)
    crowd = int(np.ceil(np.log2(max(KEYS / 16 / usual, 1))))  # from this level on a key is dealt over several partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lev, seen = shared.value, set()
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            every = np.concatenate(held, axis=1)
            key, cid, _ = every
            more = np.maximum(lev[(key >> shift).astype(np.int64)].astype(np.int64) - crowd, 0)
            salt = C.mix(cid) & ((np.uint64(1) << more.astype(np.uint64)) - np.uint64(1))
            part = (C.mix(key + salt) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            every, part = every[:, order], part[order]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            data = [every[:, a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(part)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), pa.array(data, pa.binary())], ["part", "keys"])

        for batch in batches:
            for _, _, values, at in _sets(batch, width):
                n = np.diff(at)
                cid, _ = class_names(values, at, clashing)
                fresh = [k for k in np.flatnonzero(n) if not (cid[k] in seen or seen.add(cid[k]))]
                lv = lev[(values >> shift).astype(np.int64)]
                long = n - required(n, percent) + 1
                for k in fresh:
                    s, v = values[at[k] : at[k + 1]], lv[at[k] : at[k + 1]]
                    usually = s[v == 0]
                    if len(usually) < long[k]:
                        usually = s[np.lexsort((s, v))]
                    key = usually[: long[k]]
                    held.append(np.stack([key, np.full(len(key), cid[k]).view(np.uint64), np.full(len(key), n[k], np.uint64)]))
                    size += len(key)
                if size >= BUFFER:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return docs.where("doc_id is not null").select("text").mapInArrow(C.trimmed(run), "part int, keys binary")


def _met(keyed: DataFrame, percent: int, level: np.ndarray, usual: int, parts: int) -> DataFrame:
    """Members of keys with more than one class (kind 0: key, cid, n), and star pairs (kind 1: cid, cid)."""
    shared = keyed.sparkSession.sparkContext.broadcast(level)
    shift = np.uint64(64 - len(level).bit_length() + 1)
    crowd = int(np.ceil(np.log2(max(KEYS / 16 / usual, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[np.ndarray] = []
        for batch in batches:
            blocks += [np.frombuffer(x, np.uint64).reshape(3, -1) for x in batch.column("keys").to_pylist()]
        if not blocks:
            return
        key, cid, n = np.concatenate(blocks, axis=1)
        order = np.lexsort((cid, key))
        key, cid, n = key[order], cid[order].view(np.int64), n[order].view(np.int64)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
        key, cid, n = key[fresh], cid[fresh], n[fresh]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        several = np.repeat(size > 1, size) | (shared.value[(key >> shift).astype(np.int64)] > crowd)
        low, high = np.repeat(first, size), np.repeat(first + size - 1, size)
        pairs = []
        for end in (low, high):
            m = n[end]
            near = (np.arange(len(key)) != end) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
            pairs.append(np.stack([np.minimum(cid, cid[end])[near], np.maximum(cid, cid[end])[near]]))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        k = np.flatnonzero(several)
        names = ["kind", "a", "b", "n"]
        for s in range(0, len(k), 100_000):
            at = k[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(key[at].view(np.int64)), pa.array(cid[at]), pa.array(n[at])], names)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(pairs.shape[1], np.int32)), pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], names)

    return keyed.repartition(parts, "part").mapInArrow(C.trimmed(run), "kind int, a long, b long, n long")


# -- signature trees ------------------------------------------------------


def tree_pairs(unit: np.ndarray, block: np.ndarray, cid: np.ndarray, component: np.ndarray, n: np.ndarray, bitmap: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, of one unit and different components, that may be similar.  Rows come sorted by unit.

    ``block`` tells the two sides of a unit apart: where it has two, only pairs across count.
    All units' trees are built and traversed together, a level at a time.
    """
    total = len(unit)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((cid, n, component, unit))
    words = bitmap[order].view(np.uint64)
    size, comp, side, of = n[order], component[order], block[order], unit[order]
    pop = np.bitwise_count(words).sum(1, dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    lengths = np.diff(np.append(first, total))
    crossing = np.repeat(np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first), lengths)
    place = np.arange(total) - np.repeat(first, lengths)
    # level 0: rows; a node of level k covers FAN**k neighbouring rows of its unit
    levels = [{"bits": words, "low": size, "high": size, "shared": size - pop, "c0": comp, "c1": comp, "rows": np.arange(total)}]
    for k in range(1, LEVELS + 1):
        new = place % FAN**k == 0
        below = levels[-1]
        start = np.flatnonzero(new)
        child = np.searchsorted(below["rows"], start)
        levels.append({
            "bits": np.bitwise_or.reduceat(below["bits"], child, axis=0),
            "low": np.minimum.reduceat(below["low"], child),
            "high": np.maximum.reduceat(below["high"], child),
            "shared": np.maximum.reduceat(below["shared"], child),
            "c0": np.minimum.reduceat(below["c0"], child),
            "c1": np.maximum.reduceat(below["c1"], child),
            "begin": child,
            "end": np.append(child[1:], len(below["low"])),
            "rows": start,
        })
    a = b = np.arange(len(levels[-1]["low"]))
    for k in range(LEVELS, -1, -1):
        x = levels[k]
        low = np.maximum(x["low"][a], x["low"][b])
        keep = (x["high"][a] * 100 >= low * percent) & (x["high"][b] * 100 >= low * percent)
        keep &= ~((x["c0"][a] == x["c1"][a]) & (x["c0"][b] == x["c1"][b]) & (x["c0"][a] == x["c0"][b]))
        a, b, low = a[keep], b[keep], low[keep]
        kept = np.zeros(len(a), bool)
        for s in range(0, len(a), 1 << 15):
            p, q = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
            both = np.bitwise_count(x["bits"][p] & x["bits"][q]).sum(1, dtype=np.int64)
            most = both + np.minimum(x["shared"][p], x["shared"][q])
            kept[s : s + (1 << 15)] = most * 100 >= low[s : s + (1 << 15)] * percent
        a, b = a[kept], b[kept]
        if k == 0:
            break
        # children of both nodes, each unordered pair once
        ca, cb = x["end"][a] - x["begin"][a], x["end"][b] - x["begin"][b]
        each = ca * cb
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(cb, each)
        na, nb = np.repeat(x["begin"][a], each) + at // np.maximum(wide, 1), np.repeat(x["begin"][b], each) + at % np.maximum(wide, 1)
        once = na <= nb if k > 1 else na < nb
        a, b = na[once], nb[once]
    good = (comp[a] != comp[b]) & (~crossing[a] | (side[a] != side[b]))
    # at the rows, the bound for the pair itself: what one has outside the other's bits is not shared
    a, b = a[good], b[good]
    fits = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 15):
        p, q = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
        o = np.minimum(size[p] - np.bitwise_count(words[p] & ~words[q]).sum(1, dtype=np.int64), size[q] - np.bitwise_count(words[q] & ~words[p]).sum(1, dtype=np.int64))
        fits[s : s + (1 << 15)] = o * 100 >= (size[p] + size[q] - o) * percent
    return order[a[fits]], order[b[fits]]


def forests(x: np.ndarray, y: np.ndarray, rank: np.ndarray, nodes: int, many: int) -> np.ndarray:
    """Edges (x, y) of ``many`` spanning forests, each of what the ones before left, those of smallest ``rank`` first.

    Ranks are distinct, so every tree's smallest edge outwards belongs to the forest, and all are taken at once.
    """
    left, taken = np.arange(len(x)), []
    for _ in range(many):
        if not len(left):
            break
        e, name, chosen = left, np.arange(nodes), []
        while True:
            p, q = name[x[e]], name[y[e]]
            across = p != q
            e, p, q = e[across], p[across], q[across]
            if not len(e):
                break
            order = np.argsort(rank[e])
            e, p, q = e[order], p[order], q[order]
            end, other, of = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([np.arange(len(e))] * 2)
            order = np.lexsort((of, end))
            first = order[np.flatnonzero(np.diff(end[order], prepend=-1))]
            chosen.append(np.unique(e[of[first]]))
            up = np.arange(nodes)
            up[end[first]] = other[first]
            mutual = up[up] == np.arange(nodes)
            up[mutual] = np.minimum(up[mutual], np.flatnonzero(mutual))
            while not np.array_equal(up, up[up]):
                up = up[up]
            name = up[name]
        if not chosen:
            break
        taken += chosen
        left = np.setdiff1d(left, np.concatenate(chosen), assume_unique=True)
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _wide_enough(a: np.ndarray, b: np.ndarray, n: np.ndarray, maps: list[bytes], percent: int) -> np.ndarray:
    """Whether the bitmaps of rows a and b, as wide as the narrower of both, let them be similar."""
    size = np.array([len(m) for m in maps], np.int64)
    width = np.minimum(size[a], size[b])
    fits = np.ones(len(a), bool)
    for w in np.unique(width[width > BITS // 8]):
        at = np.flatnonzero(width == w)
        rows, where = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        words = np.stack([_folded(np.frombuffer(maps[r], np.uint8), w) for r in rows]).view(np.uint64)
        p, q = where[: len(at)], where[len(at) :]
        for s in range(0, len(at), 1 << 14):
            k = slice(s, s + (1 << 14))
            u, v = words[p[k]], words[q[k]]
            i, j = n[a[at[k]]], n[b[at[k]]]
            o = np.minimum(i - np.bitwise_count(u & ~v).sum(1, dtype=np.int64), j - np.bitwise_count(v & ~u).sum(1, dtype=np.int64))
            fits[at[k]] = o * 100 >= (i + j - o) * percent
    return fits


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of the unordered pair."""
    return C.mix(C.mix(np.minimum(a, b).view(np.uint64)) + np.maximum(a, b).view(np.uint64))


def _tree_forests(members: DataFrame, percent: int, many: int) -> DataFrame:
    """Pairs (a, b) of classes: ``many`` spanning forests of those that may be similar in each key; and (key) where there are more.

    ``members``: (key, g, cid, n, component, bitmap, refuted) of keys where components meet, ``g`` members each;
    ``refuted`` are classes that a member is known not to be similar to.
    """
    rows = members.withColumn("blocks", F.when(F.col("g") > BLOCK, F.ceil(F.col("g") * 2 / BLOCK)).otherwise(1).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int"))
    # a block meets every block of its key once, itself included
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = [F.col("key"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    rows = rows.select(*unit, F.col("own").alias("block"), "cid", "component", "n", "bitmap", "refuted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        given = np.zeros(0, np.uint64)  # pairs that this task has already returned

        def found(parts: list) -> pa.RecordBatch:
            nonlocal given
            key, i, j, block, cid, comp, n = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:7])
            maps, no = ([m for x in parts for m in x[k]] for k in (7, 8))
            narrow = np.stack([_folded(np.frombuffer(m, np.uint8), BITS // 8) for m in maps])
            unit = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            a, b = tree_pairs(unit, block, cid, comp, n, narrow, percent)
            fits = _wide_enough(a, b, n, maps, percent)
            a, b = a[fits], b[fits]
            refuted = [_pair_hash(np.full(len(x), cid[k]), np.array(x, np.int64)) for k, x in enumerate(no) if x]
            h = _pair_hash(cid[a], cid[b])
            if refuted:
                new = ~np.isin(h, np.concatenate(refuted))
                a, b, h = a[new], b[new], h[new]
            # nodes: the components of a unit
            _, node = np.unique(np.stack([unit, comp]), axis=1, return_inverse=True)
            order = np.argsort(h, kind="stable")
            a, b, h = a[order], b[order], h[order]
            e = forests(node[a], node[b], np.arange(len(a)), int(node.max()) + 1, many)
            more = np.ones(len(a), bool)
            more[e] = False
            more = np.unique(key[a[more]])
            _, one = np.unique(h[e], return_index=True)
            e = e[one]
            e = e[~np.isin(h[e], given)]
            given = np.concatenate([given, h[e]])[-BUFFER:]
            low, high = np.minimum(cid[a[e]], cid[b[e]]), np.maximum(cid[a[e]], cid[b[e]])
            pad = [np.zeros(len(more), np.int64), np.zeros(len(e), np.int64)]
            of = np.arange(len(e) + len(more)) < len(e)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([low, pad[0]]), mask=~of), pa.array(np.concatenate([high, pad[0]]), mask=~of), pa.array(np.concatenate([pad[1], more]), mask=of)], ["a", "b", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "i", "j", "block", "cid", "component", "n")]
            cols += [batch.column(c).to_pylist() for c in ("bitmap", "refuted")]
            # the last unit may go on in the next batch
            key, i, j = cols[:3]
            end = len(key)
            while end and (key[end - 1], i[end - 1], j[end - 1]) == (key[-1], i[-1], j[-1]):
                end -= 1
            if end:
                yield found([*held, tuple(c[:end] for c in cols)])
                held = []
            held.append(tuple(c[end:] for c in cols))
        if held:
            yield found(held)

    sorted_rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_rows.mapInArrow(C.trimmed(run), "a long, b long, key long").distinct()


# -- exact comparison -----------------------------------------------------


def _folded(z: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(z.reshape(-1, width), axis=0) if len(z) > width else z


def _of_classes(wanted: DataFrame, docs: DataFrame, width: int, column: str, kind: str, make, clashing: np.ndarray) -> DataFrame:
    """(cid, n, ``column``) of the classes ``wanted`` (cid, rep), computed from their representatives' texts, perhaps with some others."""
    # a filter of fixed size, FILTER_BITS / 64 rows at most: it saves work, what it lets pass besides does no harm
    bit = F.col("cid").bitwiseXOR(F.col("rep")).bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = wanted.select(bit.alias("bit"))
    words = rows.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("m")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id").to_numpy()
            for i, j, values, at in _sets(batch, width):
                cid, _ = class_names(values, at, clashing)
                b = ((cid ^ doc[i:j]) & (FILTER_BITS - 1)).astype(np.uint64)
                hit = (shared.value[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
                k = np.flatnonzero(hit & (np.diff(at) > 0))
                n = np.diff(at)[k]
                yield pa.RecordBatch.from_arrays([pa.array(cid[k]), pa.array(n), make([values[at[x] : at[x + 1]] for x in k])], ["cid", "n", column])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(C.trimmed(run), f"cid long, n long, {column} {kind}")


def _bounded(percent: int):
    """Whether two sets may be similar, from their bitmaps: what one has outside the other's bits is not shared."""

    def run(n: pa.Array, x: pa.Array, m: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, a, q, b in zip(n.to_pylist(), x.to_pylist(), m.to_pylist(), y.to_pylist(), strict=True):
            u, v = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            w = min(len(u), len(v))  # the place in a wider map is the place in a narrower one, modulo its width
            u, v = (_folded(z, w) for z in (u, v))
            o = min(p - int(np.bitwise_count(u & ~v).sum()), q - int(np.bitwise_count(v & ~u).sum()))
            out.append(o * 100 >= (p + q - o) * percent)
        return pa.array(out, pa.bool_())

    return run


class Comparison:
    """Exact comparison of pairs of classes: by bitmaps first, then by the sets themselves, which are read from the texts once."""

    def __init__(self, docs: DataFrame, reps: DataFrame, maps: DataFrame, width: int, percent: int, clashing: np.ndarray):
        self.docs, self.reps, self.maps = docs, reps, maps
        self.width, self.percent, self.clashing = width, percent, clashing
        self.sets: DataFrame | None = None

    def _fetch(self, close: DataFrame) -> DataFrame:
        """(cid, s) of the classes in ``close``, and of those compared before."""
        ids = close.select(F.col("a").alias("cid")).union(close.select("b")).distinct()
        new = ids if self.sets is None else ids.join(self.sets.select("cid"), "cid", "left_anti")
        new = C.cut(new.join(self.reps, "cid"))
        if self.sets is not None and not new.limit(1).count():
            return self.sets

        def lists(sets: list[np.ndarray]) -> pa.Array:
            return C.list_array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64), np.append(0, np.cumsum([len(s) for s in sets])))

        more = _of_classes(new, self.docs, self.width, "s", "array<long>", lists, self.clashing)
        more = C.keep(more.join(new.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "sets")
        self.sets = more if self.sets is None else self.sets.unionByName(more)
        return self.sets

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are similar, as edges (u, v)."""
        left = self.maps.select(F.col("cid").alias("a"), F.col("n").alias("p"), F.col("m").alias("x"))
        right = self.maps.select(F.col("cid").alias("b"), F.col("n").alias("q"), F.col("m").alias("y"))
        may = F.arrow_udf(_bounded(self.percent), "boolean")
        close = C.cut(pairs.join(left, "a").join(right, "b").where(may("p", "x", "q", "y")).select("a", "b"))
        sets = self._fetch(close)
        left = sets.select(F.col("cid").alias("a"), F.col("s").alias("x"))
        right = sets.select(F.col("cid").alias("b"), F.col("s").alias("y"))
        both = close.join(left, "a").join(right, "b")
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("t"))
        return C.cut(both.where(F.col("o") * 100 >= (F.col("t") - F.col("o")) * self.percent).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _meeting(members: DataFrame, label: DataFrame) -> DataFrame:
    """``members`` (key, cid, n) of keys where components meet, with ``component`` and ``g``; of keys with the same members, one."""
    rows = members.join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    seen = [F.sum(F.shiftright(F.xxhash64("cid", F.lit(k)), 24)).alias(f"s{k}") for k in (1, 2, 3)]
    several = rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("g"), *seen)
    several = several.where("c0 <> c1").groupBy("g", "s1", "s2", "s3").agg(F.min("key").alias("key"))
    return C.cut(rows.join(several.select("key", "g"), "key"))


def _classes(docs: DataFrame, width: int, cells: int) -> tuple[DataFrame, np.ndarray, DataFrame, np.ndarray]:
    """The measured rows, the sketch, (cid, rep) of every class with an id, and the first hashes that unlike sets share."""
    clashing = np.zeros(0, np.int64)
    while True:
        measured, sketch = _measure(docs, width, cells, clashing)
        kinds = C.cut(measured.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("cid2").alias("low"), F.max("cid2").alias("high")))
        # 64-bit clashes: none below some 10**9 classes, a handful at 10**10
        odd = kinds.where("low <> high").select("cid").toArrow().column("cid").to_numpy()
        if not len(odd):
            return measured, sketch, kinds.where("rep is not null").select("cid", "rep"), clashing
        clashing = np.union1d(clashing, odd)


def similar(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    docs = C.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, size = C.text_size(docs)
    cells = int(min(max(1 << int(np.ceil(np.log2(max(size / 6 / 32, 1)))), CELLS_LEAST), CELLS_MOST))
    measured, sketch, reps, clashing = _classes(docs, width, cells)
    level, usual = _levels(sketch)
    parts = C.parts_for(int(sketch.sum() * (100 - percent) // 100), KEYS // 4)
    keyed = _keyed(docs, width, percent, level, usual, parts, clashing)
    met = C.keep(_met(keyed, percent, level, usual, parts), "met")
    members = met.where("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("cid"), "n")
    stars = C.cut(met.where("kind = 1").select("a", "b").distinct())
    inside = members.select("cid").distinct().join(reps, "cid")
    maps = _of_classes(inside, docs, width, "m", "binary", lambda sets: pa.array([bitmap(s, fine_bits(len(s))) for s in sets], pa.binary()), clashing)
    maps = C.keep(maps.dropDuplicates(["cid"]), "bitmaps")
    compare = Comparison(docs, reps, maps, width, percent, clashing)
    label = C.components(compare.linked(stars))
    fold = F.arrow_udf(lambda m: pa.array([_folded(np.frombuffer(x, np.uint8), min(len(x), UNIT_BITS // 8)).tobytes() for x in m.to_pylist()], pa.binary()), "binary")
    narrow = maps.select("cid", fold("m").alias("bitmap"))
    no, rest = None, members
    for turn in range(ROUNDS):
        rest = _meeting(rest.select("key", "cid", "n"), label)
        found = rest.join(narrow, "cid")
        found = found.withColumn("refuted", F.lit(None).cast("array<long>")) if no is None else found.join(no, "cid", "left")
        trees = C.cut(_tree_forests(found, percent, FORESTS ** (turn + 1)))
        pairs = trees.where("key is null").select("a", "b")
        if not pairs.limit(1).count():
            break
        links = compare.linked(pairs)
        label = C.merged(label, links)
        more = trees.where("key is not null").select("key").distinct()
        if not more.limit(1).count():
            break
        rest = rest.join(more, "key", "left_semi")
        away = pairs.join(links.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti")
        refuted = C.cut(away if turn == 0 else refuted.unionByName(away))
        no = refuted.groupBy(F.col("a").alias("cid")).agg(F.collect_list("b").alias("refuted"))
    else:
        raise RuntimeError("rounds of forests did not end")
    classes = reps.join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = classes.join(smallest, "component").select("cid", "component_id")
    out = measured.join(named, "cid", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
