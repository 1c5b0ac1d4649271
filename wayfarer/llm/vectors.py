"""Embedding near-dedup with int8 tile products and rigorous error bounds.

Vectors are scaled to length one and quantised to int8 with a scale each; the
length of the difference is kept, rounded up.  For two vectors the exact
cosine lies within e_a*|q_b| + |q_a|*e_b + e_a*e_b of the product of their
quantised forms, so a pair whose product plus bound stays below the threshold
cannot reach it.  Only the other pairs are computed again, in double
precision from the original components, and decide alone.

Equal vectors of a label are one representative with a count, so groups of
copies don't multiply.  Representatives are dealt into tiles of bounded size
within their label.  A pair of tiles is one unit of work, and what travels to
it are the int8 codes: it names the vectors that are in a possible pair.  Only
these meet once more, with their original components, and each unit returns
links per vector and edges of a spanning forest, never its pairs.

Vectors are scaled by powers of two before anything is squared, which changes
no cosine, so that large and small components neither overflow nor vanish.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, a null id or another number of
components, link with nothing; the component of a null id is null and it isn't
kept; repeated rows (same id) are copies of each other; an empty table gives no
rows.  Extra columns aren't carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common as C

THRESHOLD = 0.98
#: Vectors of a tile, about.
TILE = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the quantised vector, bound of the error's length) of unit vectors."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q.astype(np.float64) * scale[:, None]
    slack = 1e-12 * x.shape[1]
    return q, scale, np.linalg.norm(back, axis=1) * (1 + 1e-12), np.linalg.norm(x - back, axis=1) + slack


def candidates(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose exact cosine may reach the threshold."""
    (qa, sa, na, ea), (qb, sb, nb, eb) = a, b
    # products of int8 codes are whole numbers that float32 holds exactly up to 2**24, float64 beyond
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = qa.astype(kind) @ qb.astype(kind).T
    value = product * sa[:, None] * sb[None, :]
    bound = ea[:, None] * nb[None, :] + na[:, None] * eb[None, :] + ea[:, None] * eb[None, :] + 1e-9
    return np.nonzero(value + bound >= threshold)


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what isn't joined yet."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component of each lies between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives with their quantised form in place of their components."""
    names = ["label", "dim", "tile", "tiles", "rep"]
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            q, scale, length, error = quantise(_units(_matrix(part.column("x").to_pylist())))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale), pa.array(length), pa.array(error)], [*names, "q", "scale", "length", "error"])


def _possible(threshold: float, kind: pa.DataType):
    """Of each unit, the vectors in a pair that may reach the threshold: (label, dim, tile, other, rep, side)."""

    def side(r: dict, k: str) -> tuple:
        e = r[k]
        q = np.frombuffer(b"".join(v["q"] for v in e), np.int8).reshape(len(e), -1)
        return (q, *(np.array([v[c] for v in e]) for c in ("scale", "length", "error")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                i, j = candidates(side(r, "a"), side(r, "b"), threshold)
                if r["tile"] == r["other"]:
                    i, j = i[i < j], j[i < j]
                    hits = [(np.union1d(i, j), "a", 0)]
                else:
                    hits = [(np.unique(i), "a", 0), (np.unique(j), "b", 1)]
                for at, k, s in hits:
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([r["label"]] * n, kind), *(pa.array(np.full(n, r[c], np.int64)) for c in ("dim", "tile", "other")), pa.array([r[k][x]["rep"] for x in at], pa.int64()), pa.array(np.full(n, s, np.int32))], ["label", "dim", "tile", "other", "rep", "side"])

    return run


def _compared(threshold: float):
    """Links per vector (u, -1, n) and edges (u, v, 0) of a forest among the vectors of one unit."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, ids, many = (table.column(c).to_numpy() for c in ("side", "rep", "many"))
        x = scaled(_matrix(table.column("x").to_pylist()))
        norm = np.sqrt((x * x).sum(1))
        form = quantise(x / norm[:, None])
        within = not side.any()
        a = np.arange(len(ids)) if within else np.flatnonzero(side == 0)
        b = a if within else np.flatnonzero(side == 1)
        i, j = candidates(tuple(f[a] for f in form), tuple(f[b] for f in form), threshold)
        i, j = a[i], b[j]
        if within:
            i, j = i[i < j], j[i < j]
        # the original components again, in double precision, a stretch at a time
        good = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 14):
            k = slice(s, s + (1 << 14))
            good[k] = (x[i[k]] * x[j[k]]).sum(1) / (norm[i[k]] * norm[j[k]]) >= threshold
        i, j = i[good], j[good]
        links = np.bincount(i, many[j], minlength=len(ids)) + np.bincount(j, many[i], minlength=len(ids))
        hit = np.flatnonzero(links)
        edges = np.array(_forest(len(ids), i, j), np.int64).reshape(-1, 2)
        u = np.concatenate([ids[hit], ids[edges[:, 0]]])
        v = np.concatenate([np.full(len(hit), -1), ids[edges[:, 1]]])
        n = np.concatenate([links[hit].astype(np.int64), np.zeros(len(edges), np.int64)])
        kind = np.concatenate([np.zeros(len(hit), np.int32), np.ones(len(edges), np.int32)])
        return pa.table({"u": pa.array(u.astype(np.int64)), "v": pa.array(v.astype(np.int64)), "n": pa.array(n), "kind": pa.array(kind)})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.coalesce(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).withColumn("ok", F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine)
    # doubles of one value: 0.0 and -0.0 are the same component
    clean = F.transform("x", lambda v: v + F.lit(0.0))
    rows = rows.select("vec_id", "label", F.when(F.col("ok"), clean).alias("x"), F.when(F.col("ok"), F.xxhash64(clean)).alias("h"), F.when(F.col("ok"), F.xxhash64(clean, F.lit(1))).alias("h2"))
    rows = C.keep(rows, "vectors")
    keys = ["label", "h", "h2"]

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        return pa.array([np.array(v, np.float64).tobytes() for v in column.to_pylist()], pa.binary())

    reps = rows.where("h is not null").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("x").alias("x"))
    reps = C.keep(reps.select(*keys, "rep", "many", F.size("x").cast("long").alias("dim"), packed("x").alias("x")), "representatives")
    sizes = C.cut(reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("tiles")))
    of = reps.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    kind = of.schema["label"].dataType
    schema = T.StructType([T.StructField("label", kind), *(T.StructField(c, T.LongType()) for c in ("dim", "tile", "tiles", "rep")), T.StructField("q", T.BinaryType()), *(T.StructField(c, T.DoubleType()) for c in ("scale", "length", "error"))])
    codes = of.select("label", "dim", "tile", "tiles", "rep", "x").mapInArrow(C.trimmed(_codes), schema)
    # a tile: about ``tile`` vectors, as one row
    entry = F.array_sort(F.collect_list(F.struct("rep", "q", "scale", "length", "error")))
    tiled = C.keep(codes.groupBy("label", "dim", "tile").agg(entry.alias("e"), F.first("tiles").alias("tiles")), "tiles")
    # both sides name the whole unit, so that no tile gathers all others
    unit = ["label", "dim", "tile", "other"]
    left = tiled.select("label", "dim", "tile", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("other"), F.col("e").alias("a"))
    right = tiled.select("label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile"))).alias("first"), F.col("tile").alias("other"), F.col("e").alias("b")).withColumnRenamed("first", "tile")
    units = int(sizes.agg(F.sum(F.col("tiles") * (F.col("tiles") + 1) / 2)).first()[0] or 0)
    parts = C.parts_for(units, 4)
    pairs = left.repartition(parts, *unit).join(right.repartition(parts, *unit).hint("shuffle_hash"), unit)
    schema = T.StructType([T.StructField("label", kind), *(T.StructField(c, T.LongType()) for c in ("dim", "tile", "other", "rep")), T.StructField("side", T.IntegerType())])
    may = C.keep(pairs.select(*unit, "a", "b").mapInArrow(C.trimmed(_possible(threshold, to_arrow_type(kind))), schema), "possible")
    whole = may.join(reps.select("label", "dim", "rep", "many", "x"), ["label", "dim", "rep"])
    found = C.keep(whole.groupBy(*unit).applyInArrow(_compared(threshold), "u long, v long, n long, kind int"), "links")
    links = found.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    label = C.components(found.where("kind = 1").select("u", "v")).select(F.col("id").alias("rep"), "component")
    # the smallest id of a component is the smallest of its representatives, each the smallest of its copies
    named = reps.select(*keys, "rep", "many").join(links, "rep", "left").join(label, "rep", "left")
    named = named.select(*keys, (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", *keys).join(named, keys, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
