"""Places of rows in a global order, from totals of each partition: no task sees more than its own range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, written


def placed(rows: DataFrame, order: list[str], size: Column | None = None, name: str = "placed") -> DataFrame:
    """rows as a written table, with `row`, each one's number from 0 in the order (nulls first), and `before`, the sum of `size` (a long; None: no such column) over all rows before it.

    Rows are dealt by ranges of the order and written with their range's number; the ranges' totals are summed up (a row for each range),
    and running sums within a range start there. Rows that are equal in the order may take each other's place: name enough columns.
    The columns part, row, before, row0 and before0 are this function's own. A hot value of the first columns is dealt by the later ones.
    """
    ranged = written(rows.repartitionByRange(partitions(rows), *order).withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    sums = {"row": F.lit(1)} | ({} if size is None else {"before": size})
    totals = ranged.groupBy("part").agg(*[F.sum(x).alias(c) for c, x in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in sums])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({c: F.coalesce(F.sum(x).over(within), F.lit(0)) for c, x in sums.items()})
    at = own.join(F.broadcast(start), "part")  # as many rows as ranges
    out = written(at.select(*rows.columns, *[(F.col(c) + F.col(f"{c}0")).alias(c) for c in sums]), name)
    discard(ranged)
    return out
