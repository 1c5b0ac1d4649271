"""Product codes of vectors by Lloyd's rounds that keep heaps of bounds.

Vectors become whole numbers (floor of 1024 times each component) and fall into
four parts; each part position has a codebook of up to 256 entries.  A block of
vectors is one row of a table.  For every entry of a codebook, its block keeps
a heap of the parts assigned to it, keyed by lower minus upper bound: the
distance to the second nearest entry less that to the nearest, at the time the
part was last compared, plus what the entry's drift was then.  When entries
move, the bounds of all parts of an entry drift by the same amount: by how far
the entry itself moved and by how far any other moved at most.  A round pops
the parts whose key the cumulative drift has passed, compares these with all
entries exactly, in whole numbers, and pushes them onto their new entry's heap;
what stays in the heaps is not touched.

A block also names by how much it changed the sums and counts of entries.  A
round reads only these, adds them up in partial sums and brings at most
``entries * (dimension + 4)`` numbers to the driver, which knows the sums of
before; the codebooks go to the tasks with the next round.  Each round's blocks
are a table in the shared folder and the table before it is dropped once the
new one is whole.

Defined results: vectors that are null or hold null or non-finite components
are dropped.  Codebooks begin with the smallest ids, of equal ones with the
smallest components, null ids last; with fewer vectors than entries there are
fewer entries.  Repeated rows count each for itself.  Vectors shorter than the
longest, or of a length that four doesn't divide, are filled up with zeros; an
empty one is zero.  Components beyond ``MOST`` raise an error, as distances
could no longer be exact.  An empty table gives no rows.  Extra columns aren't
carried along.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block at most; rows that one step compares with all entries.
BLOCK, STEP = 4096, 1024
#: Largest whole component in size: squared distances of 4096 such components stay below 2**63.
MOST = 1 << 24
#: Distances are rounded to 53 bits; bounds that are closer than this are compared anew.
SLACK = 1e-5


class Codebooks:
    """Entries [part, entry, component], the drift of each entry's heap so far, and how often entries were replaced."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.drift = np.zeros(entries.shape[:2])
        self.round = 0

    def replaced(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Every used entry becomes the floor of its parts' mean; heaps drift by what entries moved."""
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = np.floor_divide(sums[used], counts[used][:, None])
        out = Codebooks(entries)
        way = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(2))
        order = np.sort(way, 1)
        first, second = order[:, -1:], order[:, -2:-1] if way.shape[1] > 1 else np.zeros_like(order[:, -1:])
        others = np.where(np.arange(way.shape[1]) == way.argmax(1)[:, None], second, first)
        out.drift = self.drift + way + others
        out.round = self.round + 1
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def compared(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, of equally near ones the first, and the distance to the second nearest less that to it."""
    n, k = len(x), len(entries)
    best, gap = np.zeros(n, np.int64), np.full(n, np.inf)
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # products of floats are exact below 2**53, those of whole numbers below 2**63
    kind = np.float64 if 4 * x.shape[1] * largest * largest < 1 << 53 else np.int64
    e = entries.astype(kind)
    norm = (e * e).sum(1)
    for i in range(0, n, STEP):
        part = x[i : i + STEP].astype(kind)
        # without the row's own square, which doesn't change the order
        d = norm[None, :] - 2 * (part @ e.T)
        b = d.argmin(1)
        at = np.arange(len(part))
        own = (part * part).sum(1)
        near = (d[at, b] + own).astype(np.float64)
        best[i : i + STEP] = b
        if k > 1:
            d[at, b] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
            gap[i : i + STEP] = np.sqrt((d.min(1) + own).astype(np.float64)) - np.sqrt(near)
    return best, gap


def distances(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its entry."""
    d = x.astype(np.int64) - entries[code]
    return (d * d).sum(1)


class Heaps:
    """Heaps of one part position: keys and rows in heap order, one entry's after the other, and where each begins."""

    def __init__(self, key: np.ndarray, row: np.ndarray, at: np.ndarray):
        self.key, self.row, self.at = key, row, at

    @classmethod
    def made(cls, code: np.ndarray, key: np.ndarray, k: int) -> Heaps:
        """Ascending keys are in heap order."""
        order = np.lexsort((key, code))
        at = np.zeros(k + 1, np.int32)
        np.cumsum(np.bincount(code, minlength=k), out=at[1:])
        return cls(key[order], order.astype(np.uint16), at)

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, dict[int, list]]:
        """Rows whose key the drift has passed, and what is left of the heaps that lost some."""
        full = np.flatnonzero(self.at[1:] > self.at[:-1])
        touched = full[self.key[self.at[full]] <= drift[full] + SLACK]  # the root is the least
        rows, left = [], {}
        for e in touched.tolist():
            heap = self.heap(e)
            limit = drift[e] + SLACK
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
            left[e] = heap
        return np.array(rows, np.int64), left

    def heap(self, e: int) -> list[tuple[float, int]]:
        a, b = self.at[e], self.at[e + 1]
        return list(zip(self.key[a:b].tolist(), self.row[a:b].tolist(), strict=True))

    def pushed(self, left: dict[int, list], code: np.ndarray, key: np.ndarray, rows: np.ndarray) -> Heaps:
        """With the popped rows on the heaps of their entries of now."""
        for e, kk, r in zip(code.tolist(), key.tolist(), rows.tolist(), strict=True):
            if e not in left:
                left[e] = self.heap(e)
            heapq.heappush(left[e], (kk, r))
        keys, numbers, size = [], [], np.diff(self.at)
        for e in range(len(size)):
            if e in left:
                heap = left[e]
                keys.append(np.array([h[0] for h in heap], np.float64))
                numbers.append(np.array([h[1] for h in heap], np.uint16))
                size[e] = len(heap)
            elif size[e]:
                keys.append(self.key[self.at[e] : self.at[e + 1]])
                numbers.append(self.row[self.at[e] : self.at[e + 1]])
        at = np.zeros(len(self.at), np.int32)
        np.cumsum(size, out=at[1:])
        return Heaps(np.concatenate(keys), np.concatenate(numbers), at)


class Block:
    """Some vectors: components [row, part, component], codes [part, row], heaps of each part position."""

    def __init__(self, x: np.ndarray, code: np.ndarray | None = None, heaps: list[Heaps] | None = None):
        self.x, self.code, self.heaps = x, code, heaps
        self.scanned = 0

    def assign(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """Brings codes up to date; the changes of entries' sums [part, entry, component] and counts."""
        n, parts, width = self.x.shape
        k = books.entries.shape[1]
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        if self.code is None:
            self.code, self.heaps = np.zeros((parts, n), np.uint8), []
            for p in range(parts):
                best, gap = compared(self.x[:, p], books.entries[p])
                self.code[p] = best
                self.heaps.append(Heaps.made(best, gap + books.drift[p][best], k))
                np.add.at(sums[p], best, self.x[:, p].astype(np.int64))
                counts[p] += np.bincount(best, minlength=k)
            self.scanned = n * parts
            return sums, counts
        self.scanned = 0
        for p in range(parts):
            rows, left = self.heaps[p].pop(books.drift[p])
            if not len(rows):
                continue
            self.scanned += len(rows)
            x = self.x[rows, p]
            best, gap = compared(x, books.entries[p])
            was = self.code[p][rows].astype(np.int64)
            self.code[p][rows] = best
            self.heaps[p] = self.heaps[p].pushed(left, best, gap + books.drift[p][best], rows)
            moved = was != best
            x = x[moved].astype(np.int64)
            np.subtract.at(sums[p], was[moved], x)
            np.add.at(sums[p], best[moved], x)
            counts[p] += np.bincount(best[moved], minlength=k) - np.bincount(was[moved], minlength=k)
        return sums, counts


def _changes(sums: np.ndarray, counts: np.ndarray) -> bytes:
    """Entries that changed: their number, names, counts and sums."""
    hit = np.flatnonzero(counts.reshape(-1).astype(bool) | sums.any(2).reshape(-1))
    flat = sums.reshape(-1, sums.shape[2])[hit]
    return np.concatenate([[len(hit)], hit, counts.reshape(-1)[hit], flat.reshape(-1)]).astype("<i8").tobytes()


def _packed(block: Block, books: Codebooks, head: list, names: list[str]) -> pa.RecordBatch:
    sums, counts = block.assign(books)
    most = int(np.abs(block.x).max(initial=0))
    x = block.x.astype("<i2" if most < 1 << 15 else "<i4")
    heaps = block.heaps
    body = [
        pa.array([x.dtype.itemsize], pa.int32()),
        *(pa.array([v.tobytes()], pa.binary()) for v in (x, block.code, np.concatenate([h.key for h in heaps]).astype("<f8"), np.concatenate([h.row for h in heaps]).astype("<u2"), np.concatenate([h.at for h in heaps]).astype("<i4"))),
        pa.array([block.scanned], pa.int64()),
        pa.array([_changes(sums, counts)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays([*head, *body], [*names, "width", "x", "code", "key", "row", "at", "scanned", "moved"])


_HEAD = ["vec_ids", "labels"]


def _first(books: Codebooks):
    """Cuts a task's vectors into blocks and compares them all."""
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                flat, at = C.flatten_list(part.column("x"))
                size = np.diff(at)
                x = np.zeros((len(size), parts * width), np.int64)
                row = np.repeat(np.arange(len(size)), size)
                x[row, np.arange(len(flat)) - at[row]] = flat
                head = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in (part.column("vec_id"), part.column("label"))]
                yield _packed(Block(x.reshape(-1, parts, width)), books, head, _HEAD)

    return run


def _opened(batch: pa.RecordBatch, i: int, parts: int, k: int, width: int) -> Block:
    take = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    x = take("x", f"<i{batch.column('width')[i].as_py()}").reshape(-1, parts, width)
    n = len(x)
    key, row, at = take("key", "<f8"), take("row", "<u2"), take("at", "<i4").reshape(parts, k + 1)
    return Block(x, take("code", np.uint8).reshape(parts, n).copy(), [Heaps(key[p * n : (p + 1) * n], row[p * n : (p + 1) * n], at[p]) for p in range(parts)])


def _again(books: Codebooks):
    """Pops what the drift has passed in every block."""
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                head = [batch.column(c).slice(i, 1) for c in _HEAD]
                yield _packed(_opened(batch, i, parts, k, width), books, head, _HEAD)

    return run


def _summed(parts: int, k: int, width: int):
    """Changes of a partition's blocks in one: (place, value), the counts behind the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * k, width + 1), np.int64)
        for batch in batches:
            for cell in batch.column("moved"):
                data = np.frombuffer(cell.as_buffer(), "<i8")
                m = int(data[0])
                hit = data[1 : 1 + m]
                total[hit, width] += data[1 + m : 1 + 2 * m]
                total[hit, :width] += data[1 + 2 * m :].reshape(m, width)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)[place])], ["place", "value"])

    return run


def _coded(books: Codebooks):
    """(vec_id, label, code, error) of all vectors."""
    parts, k, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _opened(batch, i, parts, k, width)
                error = sum(distances(block.x[:, p], books.entries[p], block.code[p]) for p in range(parts))
                text = np.ascontiguousarray(block.code.T).tobytes().hex()
                code = [text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)]
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in _HEAD)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the vectors that count: ``x`` array<long>."""
    e = F.col("embedding")
    good = e.isNotNull() & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(e, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(good).select("vec_id", "label", whole.alias("x"))


class Fit:
    """The rounds' outcome: a table of blocks, the codebooks and how many parts each round compared."""

    def __init__(self, blocks: DataFrame | None, books: Codebooks | None, scanned: list[int]):
        self.blocks, self.books, self.scanned = blocks, books, scanned


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Fit:
    """Codebooks after ``rounds`` rounds, and all vectors assigned to them."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits")
    rows = whole_vectors(vectors, scale)
    size = rows.agg(F.max(F.size("x")).alias("dim"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).first()
    if size["dim"] is None:
        return Fit(None, None, [])
    if (size["most"] or 0) > MOST:
        raise ValueError(f"components times {scale} beyond {MOST}: distances would not be exact")
    width = max(1, -(-size["dim"] // parts))
    # as many rows as the codebook has entries, whatever the input
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    table = np.zeros((len(start), parts * width), np.int64)
    for i, r in enumerate(start):
        table[i, : len(r["x"])] = r["x"]
    books = Codebooks(np.ascontiguousarray(table.reshape(len(start), parts, width).transpose(1, 0, 2)))
    k = len(start)
    schema = f"vec_ids array<long>, labels array<{rows.schema['label'].dataType.simpleString()}>, width int, x binary, code binary, key binary, row binary, at binary, scanned long, moved binary"
    blocks, path = C.keep_at(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "x").mapInArrow(C.trimmed(_first(books)), schema), "blocks")
    sums, counts, scanned = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64), []
    for _ in range(rounds):
        scanned.append(int(blocks.agg(F.sum("scanned")).first()[0] or 0))
        part = blocks.select("moved").mapInArrow(_summed(parts, k, width), "place long, value long")
        change = np.zeros(parts * k * (width + 1), np.int64)
        for place, value in part.groupBy("place").agg(F.sum("value").alias("value")).collect():  # one row for each number of the codebooks at most
            change[place] = value
        change = change.reshape(parts, k, width + 1)
        sums, counts = sums + change[:, :, :width], counts + change[:, :, width]
        books = books.replaced(sums, counts)
        before = path
        blocks, path = C.keep_at(blocks.mapInArrow(C.trimmed(_again(books)), schema), "blocks")
        C.drop(vectors.sparkSession, before)
    scanned.append(int(blocks.agg(F.sum("scanned")).first()[0] or 0))
    return Fit(blocks, books, scanned)


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all vectors (vec_id, embedding, label) that count."""
    found = fit(vectors, parts, entries, rounds, scale)
    if found.blocks is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    label = found.blocks.schema["labels"].dataType.elementType.simpleString()
    rows = found.blocks.mapInArrow(C.trimmed(_coded(found.books)), f"vec_id long, label {label}, code string, error long")
    # a label's total is summed where its rows are first; the join's other side is as large as there are labels
    total = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    both = rows.join(total, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(found.books.digest()).alias("codebooks_sha256"))
