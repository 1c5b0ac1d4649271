"""Transfers between trips kept up to date while delay updates stream in.

The state is a table with the earliest trip of every line for each halt, null
where none is left; each micro-batch reads the table of the batch before and
writes its own, so a batch that is repeated after a failure gives the same
table.  A batch looks up only what its updates touch: the halts of trips whose
delay changed, the halts whose trip was one of these, and the halts that now
reach one of these earlier than the trip they had.  What a batch changed is
written beside the state, as a log: the first state and the log, replayed in
order, give every later state.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delays import delayed
from ..operators.triptransfers import as_of, line_pairs, numbered
from ..plans.network import Network
from ..storage import cut, shared_dir
from .delays import SCHEMA

_HALT = ["from_trip", "from_idx", "to_line", "to_idx", "travel_time"]
_GOAL = ["ready", "to_trip", "dep"]


@dataclass
class Replacements:
    """Tables of a followed stream: ``state(k)`` after batch k (-1: before the first), ``log`` of what batches changed."""

    spark: SparkSession
    home: str
    batches: int

    def state(self, batch: int | None = None) -> DataFrame:
        """(from_trip, from_idx, to_line, to_idx, travel_time, ready, to_trip, dep)"""
        return self.spark.read.parquet(f"{self.home}/state/{self.batches - 1 if batch is None else batch}")

    def log(self) -> DataFrame:
        """The state's columns and ``batch``."""
        parts = [self.spark.read.parquet(f"{self.home}/log/{k}").withColumn("batch", F.lit(k)) for k in range(self.batches)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def replayed(self) -> DataFrame:
        """The last state out of the first one and the log."""
        rows = self.state(-1).withColumn("batch", F.lit(-1))
        rows = rows.unionByName(self.log()) if self.batches else rows
        return rows.groupBy(*_HALT).agg(F.max_by(F.struct(*_GOAL), "batch").alias("g")).select(*_HALT, *(F.col(f"g.{c}").alias(c) for c in _GOAL))


class _Follower:
    def __init__(self, net: Network, lines: DataFrame, home: str, seed: DataFrame | None, caps: dict[str, int], bucket: int):
        self.net, self.home, self.caps, self.bucket, self.batches = net, home, caps, bucket, 0
        self.number = cut(numbered(net.events, lines))
        self.planned = cut(net.events.join(self.number, "trip"))
        self.pairs = cut(line_pairs(net, self.planned))
        none = self.planned.sparkSession.createDataFrame([], "trip long, first_idx long, delay long, reveal_time long")
        delays = none if seed is None else seed.select("trip", "first_idx", "delay", F.lit(None).cast("long").alias("reveal_time"))
        delays.write.parquet(f"{home}/delays/-1")
        self._found(self._ready(self._events(delays)), self._board(self._events(delays))).write.parquet(f"{home}/state/-1")

    def _events(self, delays: DataFrame, trips: DataFrame | None = None) -> DataFrame:
        """Events of ``trips``, or of all, as late as they are."""
        own = self.planned if trips is None else self.planned.join(trips, "trip", "left_semi")
        late = delayed(own.select("trip", "idx", "stop", "arr", "dep", "n"), delays.select("trip", "first_idx", "delay"), **self.caps)
        return late.join(self.number, "trip")

    def _ready(self, events: DataFrame) -> DataFrame:
        off = events.where("idx > 0").select(F.col("trip").alias("from_trip"), F.col("idx").alias("from_idx"), F.col("line").alias("from_line"), "arr")
        return off.join(self.pairs, ["from_line", "from_idx"]).select(*_HALT, (F.col("arr") + F.col("travel_time") + F.col("wait")).alias("ready"))

    def _board(self, events: DataFrame) -> DataFrame:
        return events.where("idx < n - 1").select(F.col("line").alias("to_line"), F.col("idx").alias("to_idx"), "no", F.col("trip").alias("to_trip"), "dep")

    def _found(self, ready: DataFrame, board: DataFrame) -> DataFrame:
        return as_of(ready, board, ["to_line", "to_idx"], "ready", "dep", ["dep", "no", "to_trip"], self.bucket).select(*_HALT, *_GOAL)

    def take(self, updates: DataFrame, batch: int) -> None:
        spark = updates.sparkSession
        known, state = spark.read.parquet(f"{self.home}/delays/{batch - 1}"), spark.read.parquet(f"{self.home}/state/{batch - 1}")
        # of a trip's updates, those known before among them, the one revealed last counts
        last = F.max_by(F.struct("first_idx", "delay", "reveal_time"), F.struct(F.coalesce("reveal_time", F.lit(-(2**62))), "first_idx", "delay"))
        both = known.unionByName(updates.select(*known.columns)).groupBy("trip").agg(last.alias("u")).select("trip", "u.*")
        both.write.mode("overwrite").parquet(f"{self.home}/delays/{batch}")
        delays = spark.read.parquet(f"{self.home}/delays/{batch}")
        old = known.select("trip", F.struct("first_idx", "delay").alias("old"))
        changed = cut(delays.join(old, "trip", "left").where("old is null or old.first_idx <> first_idx or old.delay <> delay").select("trip"))
        events = cut(self._events(delays, changed))
        board = self._board(events)
        # halts of late trips have other times to be ready at; halts of others are affected through their goals
        own = self._ready(events)
        rest = state.join(changed.select(F.col("trip").alias("from_trip")), "from_trip", "left_anti")
        lost = rest.join(changed.select(F.col("trip").alias("to_trip")), "to_trip", "left_semi").select(*_HALT, "ready")
        sooner = rest.join(board.select("to_line", "to_idx", F.col("dep").alias("_new")), ["to_line", "to_idx"]).where("_new >= ready and (dep is null or _new <= dep)").select(*_HALT, "ready")
        affected = cut(own.select(*_HALT, "ready").unionByName(lost).unionByName(sooner).distinct())
        now = self._found(affected, self._board(self._events(delays)))
        now.write.mode("overwrite").parquet(f"{self.home}/log/{batch}")
        found = spark.read.parquet(f"{self.home}/log/{batch}")
        state.join(found.select(*_HALT), _HALT, "left_anti").unionByName(found).write.mode("overwrite").parquet(f"{self.home}/state/{batch}")
        self.batches = max(self.batches, batch + 1)


def follow_transfers(spark: SparkSession, net: Network, lines: DataFrame, folder: str, files: int = 1, seed: DataFrame | None = None, bucket: int = 7200, **caps: int) -> Replacements:
    """Follows update files (trip, first_idx, delay, reveal_time) of ``folder``, ``files`` in a micro-batch in order of their writing.

    ``seed``: delays (trip, first_idx, delay) known before the stream begins; ``caps``: as of ``delayed``.
    """
    home = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    follower = _Follower(net, lines, home, seed, caps, bucket)
    updates = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)
    query = updates.writeStream.foreachBatch(follower.take).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return Replacements(spark, home, follower.batches)

