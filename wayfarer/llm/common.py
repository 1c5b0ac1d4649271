"""Helpers shared by the corpus operators: shared storage and vectorised text scanning.

Texts reach Python as Arrow arrays.  ``flatten`` exposes one array as a byte
buffer with offsets, and everything after that is numpy over the buffer, so no
Python object is made per document, word or shingle.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer document is a step of its own.
STEP_BYTES = 1 << 19

#: Rows of an Arrow batch: a text may be long, and every worker holds some batches.
BATCH_ROWS = 2000

# what a worker frees goes back to the machine instead of staying in a pool of its own
pa.set_memory_pool(pa.system_memory_pool())

_libc = ctypes.CDLL(None)


def trim() -> None:
    """Gives the heap that this process has freed back to the machine, where the C library can."""
    gc.collect()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which leaves no freed heap in its worker: workers are used again and wait beside those that work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            _powers2.clear()
            trim()

    return wrapped


SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_rng = np.random.default_rng(20240229)
_SYMBOL = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: A number per byte; A-Z share theirs with a-z.
FOLDED = _SYMBOL.copy()
FOLDED[65:91] = _SYMBOL[97:123]
EXACT = _SYMBOL


def folded(seed: int) -> np.ndarray:
    """``FOLDED``, or the numbers of another hash."""
    if not seed:
        return FOLDED
    return mix(FOLDED + np.uint64(seed)) | np.uint64(1)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}
#: Second modulus and base.  Words exist that no base tells apart modulo 2**64; a prime has none such.
_PRIME, _BASE2 = 2**31 - 1, 1_103_515_245
_powers2: dict[int, np.ndarray] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches were made ``BATCH_ROWS`` rows long, unless someone has set their length."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":  # Spark's default
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wayfarer-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``keep``, with the table's path, for ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``keep_at`` wrote, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """A small intermediate result, written and read back: a reliable checkpoint would run its last stage twice."""
    return keep(df, "cut")


def text_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text: sizes the partitionings, never selects rows."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts_for(size: int, each: int, least: int = 12) -> int:
    """As many partitions as it takes for ``each`` to be about the share of one."""
    return max(least, -(-size // each))


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(off: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, one row at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse, modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[size] = np.stack(both)
    p = _powers[size]
    return p[0, :n], p[1, :n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers2(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the second base and of its inverse, modulo the prime."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers2:
        _powers2.clear()
        both = np.ones((2, size), np.uint64)
        for x, base in zip(both, (_BASE2, pow(_BASE2, -1, _PRIME)), strict=True):
            have, step = 1, base
            while have < size:  # what is there, times the power that follows it
                x[have : 2 * have] = x[:have] * np.uint64(step) % np.uint64(_PRIME)
                have, step = 2 * have, step * step % _PRIME
        _powers2[size] = both.astype(np.uint32)
    p = _powers2[size]
    return p[0, :n], p[1, :n]


def prefix_hash(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo 2**64, for spans below 1,024 bytes: one entry more than bytes."""
    up, _ = powers(len(raw) + 1)
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each bytes range, whatever its place."""
    _, down = powers(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def text_hash(raw: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes ranges of any length: that modulo 2**64 and another modulo a prime, mixed."""
    prime = np.uint64(_PRIME)
    up, down = powers2(len(raw) + 1)
    c = np.zeros(len(raw) + 1, np.uint64)
    # in place, as texts come in large steps
    x = np.take(table >> np.uint64(34), raw, out=c[1:])
    x *= up[: len(raw)]
    x %= prime
    np.cumsum(x, out=x)
    second = (c[end] - c[start]) % prime * down[start] % prime
    del c, x
    return mix(span_hash(prefix_hash(raw, table), start, end) + second)


class Words:
    """Words (maximal runs of other bytes than ``gap``, ASCII white space at first) of some rows, in order."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, hashed: bool = True, gap: np.ndarray = IS_SPACE, seed: int = 0):
        n = len(raw)
        word = ~gap[raw]
        first = np.zeros(n + 1, bool)
        first[off] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        start = word & (first[:-1] | ~before)
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        end = word & (first[1:] | ~after)
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        #: Index of the first word of each row, and one past the last.
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.hash = text_hash(raw, folded(seed), self.start, self.end) if hashed else None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


_Q = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one after the other, and the offset of each row's.

    A row with fewer words than ``width`` has its whole word sequence as its one
    shingle; a row without words has none.
    """
    words = Words(raw, off)
    w, first, count = words.hash, words.first, words.count
    total = len(w)
    size = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    acc = np.zeros(total, np.uint64)
    if total >= width:
        s = w[: total - width + 1].copy()
        for k in range(1, width):
            s = s * _Q + w[k : total - width + 1 + k]
        acc[: total - width + 1] = mix(s)
    pick = np.repeat(first[:-1] - at[:-1], size) + np.arange(at[-1])
    out = acc[pick] if total else np.zeros(0, np.uint64)
    for i in np.flatnonzero((count > 0) & (count < width)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in w[first[i] : first[i + 1]]:
                h = h * _Q + x
            out[at[i]] = mix(np.array([h ^ np.uint64(int(count[i]) * 0x5851F42D4C957F2D % 2**64)], np.uint64))[0]
    kept, sizes = [], np.zeros(len(count), np.int64)
    for i in range(len(count)):
        s = np.unique(out[at[i] : at[i + 1]])
        kept.append(s)
        sizes[i] = len(s)
    at2 = np.zeros(len(count) + 1, np.int64)
    np.cumsum(sizes, out=at2[1:])
    return (np.concatenate(kept) if kept else np.zeros(0, np.uint64)), at2


def crc_mod(n: int, column: str = "doc_id"):
    """crc32 of the id's decimal text modulo ``n``; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def list_array(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow list column out of flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v): a row (id, component) for each id, component the smallest id reachable.

    Alternates hooking to the smallest neighbour with pointer jumping.  Every
    round is a shuffle of the edges and of the labels, and none gathers a
    component in one task: neighbours meet in a partial minimum.
    """
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    for _ in range(rounds):
        # the smallest label next to an id, offered to the id and to its root
        near = both.join(label.select(F.col("id").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        offer = label.join(near, label.id == near.u).select("id", "component", F.least("component", "c").alias("c"))
        hook = offer.groupBy(F.col("component").alias("root")).agg(F.min("c").alias("h"))
        step = cut(offer.join(hook, offer.component == hook.root).select("id", F.least("c", "h").alias("component"), F.col("component").alias("was")))
        if not step.where("component <> was").limit(1).count():
            return label
        up = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        label = cut(step.join(up, "component", "left").select("id", F.least("component", F.coalesce("top", "component")).alias("component")))
    raise RuntimeError("components did not settle")


def merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """Components ``label`` (id, component) after ``edges`` (u, v) were added: only what the new edges touch is worked on."""
    name = label.select(F.col("id").alias("x"), F.col("component").alias("c"))
    ends = edges
    for end in ("u", "v"):
        ends = ends.join(name.withColumnRenamed("x", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    lifted = components(ends.where("u <> v"))
    lone = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct().join(label, "id", "left_anti")
    rows = label.unionByName(lone.select("id", F.col("id").alias("component")))
    top = lifted.select(F.col("id").alias("component"), F.col("component").alias("top"))
    return cut(rows.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component")))


def flatten_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, and the offset of each row's."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    at = np.asarray(column.offsets).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return (values[at[0] : at[-1]], at - at[0]) if len(at) else (values, np.zeros(1, np.int64))


def flatten_list_structs(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Fields of a column of lists of structs of numbers, without nulls, and the offset of each row's."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    at = np.asarray(column.offsets).astype(np.int64)
    inner = column.values.slice(at[0], at[-1] - at[0]) if len(at) else column.values
    fields = inner.flatten()
    return {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(column.type.value_type, fields, strict=True)}, at - at[0]
