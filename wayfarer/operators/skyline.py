"""Pareto sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def skyline(rows: DataFrame, keys: Sequence[str], criteria: Sequence[str]) -> DataFrame:
    """Distinct rows of each key that no other row of the key beats or equals in every criterion and beats in one (smaller is better).

    Two criteria take one sort and a running minimum; more take an anti join within the key.
    """
    if len(criteria) != 2:  # there the running minimum drops equal rows as well
        rows = rows.dropDuplicates([*keys, *criteria])
    if len(criteria) == 1:
        return rows.withColumn("_least", F.min(criteria[0]).over(Window.partitionBy(*keys))).where(F.col(criteria[0]) == F.col("_least")).drop("_least")
    if len(criteria) == 2:
        order = Window.partitionBy(*keys).orderBy(*criteria).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_least", F.min(criteria[1]).over(order)).where(F.col("_least").isNull() | (F.col(criteria[1]) < F.col("_least"))).drop("_least")
    other = rows.select(*(F.col(c).alias(f"_{c}") for c in [*keys, *criteria]))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    no_worse = [F.col(f"_{c}") <= F.col(c) for c in criteria]
    better = F.lit(False)
    for c in criteria:
        better = better | (F.col(f"_{c}") < F.col(c))
    condition = better
    for part in [*same, *no_worse]:
        condition = condition & part
    return rows.join(other, condition, "left_anti")


def merged_front(bag: DataFrame, rows: DataFrame, keys: Sequence[str], criteria: Sequence[str]) -> DataFrame:
    """The Pareto set of ``bag`` and ``rows`` with a column ``fresh``: whether a row came from ``rows`` and nothing in ``bag`` is as good.

    Two criteria take one sort of both tables together, in which rows of the bag come before equal ones; more compare a key's
    rows with its front alone, not with each other.
    """
    columns = [*keys, *criteria]
    if len(criteria) == 2:
        both = bag.select(*columns, F.lit(False).alias("fresh")).unionByName(rows.select(*columns, F.lit(True).alias("fresh")))
        order = Window.partitionBy(*keys).orderBy(*criteria, "fresh").rowsBetween(Window.unboundedPreceding, -1)
        return both.withColumn("_least", F.min(criteria[1]).over(order)).where(F.col("_least").isNull() | (F.col(criteria[1]) < F.col("_least"))).drop("_least")
    both = bag.select(*columns, F.lit(False).alias("fresh")).unionByName(rows.select(*columns, F.lit(True).alias("fresh")))
    return both.groupBy(*keys).applyInArrow(_front_of(list(criteria)), both.schema)


def _front_of(criteria: list[str]):
    """A function of one group of ``merged_front``, for grouped Arrow tables: the rows that none before them in order of criteria is as good as."""

    def front(table: pa.Table) -> pa.Table:
        values = np.column_stack([table.column(c).to_numpy() for c in criteria])
        order = np.lexsort((table.column("fresh").to_numpy(), *reversed(values.T)))
        kept = []
        while len(order):
            kept.append(order[0])
            order = order[(values[order] < values[order[0]]).any(axis=1)]  # what it beats or equals goes, itself included
        return table.take(pa.array(kept))

    return front
