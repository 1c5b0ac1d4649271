"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Rows fall into blocks of their source by a hash.  A source's target fixes how
often each of its blocks is taken: whole rounds over all blocks, then a part
round over the blocks of a hashed order, those left out that do not fit any
more, and rows of the blocks left out that bring the words nearest to the
target.  These block takes are quotas; the
tree splits them between the two halves of the output shards, level by level,
each split a draw from the multivariate hypergeometric distribution (source
after source, by inverse distribution function at a hashed uniform number).
Every shard then owns a range of each source's permuted block takes, disjoint
from the others', and its rows are shuffled within the shard.

DataFrame functions only.  Tables of blocks and quotas have at most
``BLOCKS`` rows a source; rows meet their block in a join on (source, block),
so a source with a third of all rows is spread over its blocks.  All draws are
hashes of ids, so reruns agree.

Defined results: null text has size 0; a null source is a source, last in
order; sources of size 0 have target 0; repeated rows are rows of their own,
taken alike; an empty table gives an empty mix.  Extra columns are carried along by ``mix``; columns beginning
with ``_mix`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
#: Blocks a source at most, and rows that a block has about, as long as that is fewer blocks.
BLOCKS, BLOCK_ROWS = 4096, 64
#: Rows of a last block among which those are chosen that bring the words nearest to the target.
CHOICE = 256
WORD = r"[^\x20\x09-\x0D]+"


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("_mix_size", size).withColumn("_mix_key", F.xxhash64("doc_id", "_mix_size", F.lit(seed)))


def _targets(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """A row per source: rank, size, target, blocks, whole rounds and words left for the part round."""
    sources = rows.groupBy("source").agg(F.sum("_mix_size").alias("words"), F.count(F.lit(1)).alias("rows"))
    # windows over one row per source
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("w", weight).withColumn("most", F.col("words") * F.lit(float(cap)))
    # a source is full below the level at which its weight reaches its cap: the level that uses up the total decides
    by_level = Window.orderBy(F.col("most") / F.col("w"), "rank")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (F.sum("words").over(whole) * F.lit(float(share)) - before) / rest)
    open_level = F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(whole)
    sources = sources.withColumn("target", F.least("most", F.coalesce(open_level, F.lit(float("inf"))) * F.col("w")))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words") + 1e-12)).otherwise(0).cast("int")
    blocks = F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK_ROWS))).cast("int")
    sources = sources.withColumn("rounds", rounds).withColumn("blocks", blocks)
    return sources.select("source", "rank", "words", "target", "rounds", "blocks", F.greatest(F.col("target") - F.col("rounds") * F.col("words"), F.lit(0.0)).alias("left"))


def _log_factorial(n: str) -> str:
    """ln n! of a SQL expression: a product for small n, Stirling's series beyond."""
    small = f"aggregate(sequence(1, greatest(cast({n} as int), 1)), 0D, (s, i) -> s + ln(i))"
    return f"(case when {n} < 16 then {small} else ({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046727D + 1D / (12D * {n}) - 1D / (360D * {n} * {n} * {n}) end)"


def _hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """SQL for a draw: how many of ``draws`` out of ``total`` are among its ``good``, at uniform ``u``."""
    lf = _log_factorial
    spread = f"(8 * sqrt({draws} * ({good} / {total}) * (1 - {good} / {total}) * ({total} - {draws}) / greatest({total} - 1, 1D)) + 2)"
    low = f"cast(greatest(0D, {draws} - ({total} - {good}), floor({draws} * {good} / {total} - {spread})) as bigint)"
    high = f"cast(least({draws}, {good}, ceil({draws} * {good} / {total} + {spread})) as bigint)"
    x = "cast(x as double)"
    log = f"{lf(good)} - {lf(x)} - {lf(f'({good} - {x})')} + {lf(f'({total} - {good})')} - {lf(f'({draws} - {x})')} - {lf(f'({total} - {good} - {draws} + {x})')} - {lf(total)} + {lf(draws)} + {lf(f'({total} - {draws})')}"
    step = f"(s, x) -> if(s.p >= {u}, s, named_struct('p', s.p + exp({log}), 'x', x))"
    return f"if({total} <= 0, 0L, aggregate(sequence({low}, {high}), named_struct('p', -1e-300D, 'x', {low}), {step}, s -> s.x))"


def _split(quotas: DataFrame, level: int, seed: int) -> DataFrame:
    """Each node (node, q) as its two children: half of its block takes each, sources drawn in order."""
    u = f"(cast(pmod(xxhash64(node, i, {level}, {seed}), 1000000007) as double) + 0.5D) / 1000000007D"
    draw = _hypergeometric("a.total", "cast(element_at(q, i) as double)", "a.slots", u)
    state = "named_struct('slots', a.slots - cast(d as double), 'total', a.total - cast(element_at(q, i) as double), 'out', concat(a.out, array(d)))"
    # the draw is named by an inner transform, so that it is evaluated once
    step = f"(a, i) -> element_at(transform(array({draw}), d -> {state}), 1)"
    total = "aggregate(q, 0L, (s, x) -> s + x)"
    left = f"aggregate(sequence(1, size(q)), named_struct('slots', floor({total} / 2D) + 0D, 'total', {total} + 0D, 'out', cast(array() as array<bigint>)), {step}, a -> a.out)"
    halves = quotas.where(F.size("q") > 0).select("node", "q", F.expr(left).alias("l"))
    pair = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("l").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "l", lambda a, b: a - b).alias("q"))))
    return C.cut(halves.select(pair.alias("h")).select("h.node", "h.q"))


def _best_start() -> str:
    """SQL for the descending walk over ``items`` that ends nearest to ``need``: (distance, first item, reach).

    A walk takes each item that is no larger than what is still needed or, with reach 2, than twice that.
    """
    walk = "aggregate(slice(items, k, size(items)), need, (g, x) -> if(x.s <= g * {r}, g - x.s, g))"
    tries = [f"transform(sequence(1, size(items)), k -> named_struct('d', abs({walk.format(r=r)}), 'k', k, 'r', {r}))" for r in (1, 2)]
    return f"array_min(concat({', '.join(tries)}, array(named_struct('d', abs(need), 'k', size(items) + 1, 'r', 1))))"


def _picks() -> str:
    """SQL for the items that the best walk takes."""
    start = "named_struct('g', need, 'out', cast(array() as array<struct<o: bigint, _mix_key: bigint, doc_id: bigint, s: bigint>>))"
    return f"aggregate(slice(items, best.k, size(items)), {start}, (a, x) -> if(x.s <= a.g * best.r, named_struct('g', a.g - x.s, 'out', concat(a.out, array(x))), a), a -> a.out)"


def _plan(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, shards: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(measured rows, sources, takes, last rows): takes has the shards of each block's takes, last rows the keys taken from last blocks."""
    rows = C.keep(_measured(docs, seed).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "_mix_size", "_mix_key"), "measured")
    sources = C.cut(_targets(rows, weights, share, cap))
    placed = rows.join(sources, rows.source.eqNullSafe(sources.source)).select("rank", "blocks", "left", "rounds", "_mix_size", "_mix_key", "doc_id")
    placed = placed.withColumn("block", F.pmod("_mix_key", F.col("blocks")))
    blocks = placed.groupBy("rank", "block").agg(F.sum("_mix_size").alias("size"), F.first("left").alias("left"), F.first("rounds").alias("rounds"))
    order = F.xxhash64("rank", "block", F.lit(seed + 1))
    in_order = F.array_sort(F.collect_list(F.struct(order.alias("o"), "block", "size")))  # at most BLOCKS items
    taken = F.expr("aggregate(a, named_struct('g', left + 1e-6, 'out', cast(array() as array<int>)), (s, x) -> if(x.size <= s.g, named_struct('g', s.g - x.size, 'out', concat(s.out, array(cast(x.block as int)))), s))")
    part = blocks.groupBy("rank").agg(F.first("left").alias("left"), in_order.alias("a")).select("rank", taken.alias("t"))
    part = C.cut(part.select("rank", "t.out", F.greatest(F.col("t.g") - 1e-6, F.lit(0.0)).alias("need")))
    blocks = blocks.join(part, "rank").withColumn("part", F.array_contains("out", F.col("block").cast("int")).cast("int")).drop("out")
    # what is still needed comes from rows of the other blocks: all rows that fit of the richest in them, and some of one last block
    open_blocks = blocks.where("part = 0").select("rank", "block", "need")
    rest = placed.select("rank", "block", "_mix_size", "_mix_key", "doc_id").join(open_blocks, ["rank", "block"]).where("_mix_size > 0 and _mix_size <= 2 * need")
    rest = rest.groupBy("rank", "block", "_mix_key", "doc_id").agg(F.sum("_mix_size").alias("s"), F.first("need").alias("need"))
    fits = F.col("s") <= F.col("need")
    mass = rest.groupBy("rank", "block").agg(F.first("need").alias("need"), F.coalesce(F.sum(F.when(fits, F.col("s"))), F.lit(0)).alias("mass"), F.min(F.when(~fits, F.col("s"))).alias("over"))
    by_mass = Window.partitionBy("rank").orderBy(F.col("mass").desc(), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most BLOCKS rows
    by_over = Window.partitionBy("rank").orderBy(F.col("over").asc_nulls_last(), "block")
    source = Window.partitionBy("rank")
    mass = mass.withColumn("run", F.sum("mass").over(by_mass)).withColumn("enough", F.sum("mass").over(source) >= F.col("need"))
    mass = mass.withColumn("last", F.when(F.col("enough"), (F.col("run") >= F.col("need")) & (F.col("run") - F.col("mass") < F.col("need"))).otherwise(F.row_number().over(by_over) == 1))
    mass = mass.withColumn("all", ~F.col("last") & (~F.col("enough") | (F.col("run") < F.col("need")))).where(F.col("last") | F.col("all"))
    mass = C.cut(mass.withColumn("need", F.col("need") - F.coalesce(F.sum(F.when(F.col("all"), F.col("mass"))).over(source), F.lit(0))).select("rank", "block", "last", "all", "need", "mass"))
    blocks = C.cut(blocks.drop("need").join(mass.select("rank", "block", F.lit(True).alias("last")), ["rank", "block"], "left").withColumn("last", F.coalesce("last", F.lit(False))))
    # rows of the last block: those that fit, large ones at the end, but for the last few, which are chosen to end near the target
    rest = rest.withColumnRenamed("need", "most").join(mass, ["rank", "block"])
    every = rest.where(F.col("all") & (F.col("s") <= F.col("most"))).select("rank", "block", "_mix_key", "doc_id")
    near = rest.where("last").select("rank", "block", "_mix_key", "doc_id", "s", "need")
    in_block = Window.partitionBy("rank", "block").orderBy(F.col("s") * 8 > F.col("need"), "_mix_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_block = Window.partitionBy("rank", "block")
    near = near.withColumn("run", F.sum("s").over(in_block)).withColumn("at", F.count(F.lit(1)).over(in_block))
    near = near.withColumn("p", F.coalesce(F.max(F.when(F.col("run") <= F.col("need"), F.col("at"))).over(of_block), F.lit(0)))
    near = near.withColumn("whole", F.col("at") <= F.col("p") - CHOICE // 4).where(F.col("at") <= F.col("p") + CHOICE - CHOICE // 4)
    near = near.withColumn("need", F.col("need") - F.coalesce(F.max(F.when(F.col("whole"), F.col("run"))).over(of_block), F.lit(0)))
    open_rows = F.struct((-F.col("s")).alias("o"), "_mix_key", "doc_id", "s")
    choice = near.where(~F.col("whole")).groupBy("rank", "block").agg(F.first("need").alias("need"), F.array_sort(F.collect_list(open_rows)).alias("items"))  # CHOICE items at most
    choice = choice.withColumn("best", F.expr(_best_start())).select("rank", "block", F.explode(F.expr(_picks())).alias("x"))
    chosen = choice.select("rank", "block", "x._mix_key", "x.doc_id").unionByName(near.where("whole").select("rank", "block", "_mix_key", "doc_id")).unionByName(every)
    # one entry for every take of a block, in a permuted order of its source
    count = F.col("rounds") + F.col("part") + F.col("last").cast("int")
    takes = blocks.where(count > 0).select("rank", "block", F.explode(F.sequence(F.lit(1), count)).alias("round"), ((F.col("last")) & (F.col("round") == count)).alias("partly"))
    permuted = Window.partitionBy("rank").orderBy(F.xxhash64("rank", "block", "round", F.lit(seed + 2)), "block", "round")
    takes = takes.withColumn("at", F.row_number().over(permuted) - 1)
    quotas = takes.groupBy("rank").agg(F.count(F.lit(1)).alias("k"))
    quotas = sources.select("rank").join(quotas, "rank", "left").select("rank", F.coalesce("k", F.lit(0)).cast("long").alias("k"))
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "k"))).alias("a")).select(F.lit(0).cast("long").alias("node"), F.transform("a", lambda x: x["k"]).alias("q"))
    level = 1
    while 1 << level <= shards:
        tree = _split(tree, level, seed + 3)
        level += 1
    owned = tree.select("node", F.posexplode("q").alias("rank", "k"))
    through = Window.partitionBy("rank").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per shard
    owned = owned.withColumn("end", F.sum("k").over(through)).where("k > 0")
    owned = owned.select("rank", F.col("node").alias("shard"), F.explode(F.sequence(F.col("end") - F.col("k"), F.col("end") - 1)).alias("at"))
    placed_takes = takes.join(owned, ["rank", "at"]).groupBy("rank", "block").agg(F.collect_list(F.when(~F.col("partly"), F.struct("shard", "round"))).alias("takes"), F.max(F.when(F.col("partly"), F.struct("shard", "round"))).alias("part_take"))
    return rows, sources, C.cut(placed_takes), C.cut(chosen)


def _taken(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, shards: int, seed: int, texts: bool = True) -> DataFrame:
    """``docs``, or their ids and sizes only, with their source's figures and an array of their takes (shard, round)."""
    measured, sources, takes, chosen = _plan(docs, weights, share, cap, shards, seed)
    named = sources.select(F.col("source").alias("_mix_source"), F.col("rank").alias("_mix_rank"), F.col("words").alias("_mix_words"), F.col("target").alias("_mix_target"), F.col("blocks").alias("_mix_blocks"))
    rows = _measured(docs, seed) if texts else measured
    rows = rows.join(named, rows.source.eqNullSafe(F.col("_mix_source"))).withColumn("_mix_block", F.pmod("_mix_key", F.col("_mix_blocks")))
    t = takes.select(F.col("rank").alias("_mix_rank"), F.col("block").alias("_mix_block"), F.col("takes").alias("_mix_takes"), F.col("part_take").alias("_mix_part"))
    c = chosen.select(F.col("rank").alias("_mix_r"), F.col("_mix_key").alias("_mix_k"), F.col("doc_id").alias("_mix_d"), F.lit(True).alias("_mix_extra"))
    rows = rows.join(t, ["_mix_rank", "_mix_block"], "left")
    rows = rows.join(c, (F.col("_mix_rank") == F.col("_mix_r")) & (F.col("_mix_key") == F.col("_mix_k")) & F.col("doc_id").eqNullSafe(F.col("_mix_d")), "left").drop("_mix_r", "_mix_k", "_mix_d")
    whole = F.coalesce("_mix_takes", F.expr("cast(array() as array<struct<shard: bigint, round: int>>)"))
    return rows.withColumn("_mix_takes", F.when(F.col("_mix_extra"), F.array_append(whole, F.col("_mix_part"))).otherwise(whole))


def _shards(docs: DataFrame, shards: int | None) -> int:
    if shards is None:
        _, size = C.text_size(docs)
        shards = C.parts_for(size * 2, 32 << 20, 8)
    return 1 << max(0, (shards - 1).bit_length())


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int | None = None, seed: int = 11) -> DataFrame:
    """The mixed rows, columns of ``docs`` only: each as often as it is taken, in shards (partitions), shuffled within them."""
    n = _shards(docs, shards)
    rows = _taken(docs, weights, share, cap, n, seed)
    rows = rows.select(*docs.columns, F.explode("_mix_takes").alias("_mix_take"), "_mix_key")
    rows = rows.withColumn("_mix_shard", F.col("_mix_take.shard")).withColumn("_mix_order", F.xxhash64("_mix_key", "_mix_take", F.lit(seed)))
    return rows.repartition(n, "_mix_shard").sortWithinPartitions("_mix_shard", "_mix_order").select(*docs.columns)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int | None = None, seed: int = 11) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    rows = _taken(docs.select("doc_id", "source", "text"), weights, share, cap, _shards(docs, shards), seed, texts=False)
    n: Column = F.size("_mix_takes")
    return rows.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_words").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * n).cast("long").alias("taken"))
