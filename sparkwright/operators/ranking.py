"""Places in a total order within keys, without sorting a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.sources.shared import settle

_ROW_BITS = 33


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with the place (from 1) of each row among the rows of its keys in ``order``, which must be total.

    Rows are dealt by ranges of keys and order, so that a key with most of the
    rows is spread over many tasks; a row's place is that in its range and the
    number of rows of its key in the ranges before, of which there are as many
    as partitions.  The sorted rows are written once, as places must not change
    between the two.
    """
    whole = [*map(F.col, keys), *order]
    placed = settle(df.repartitionByRange(*whole).sortWithinPartitions(*whole).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"_part": F.shiftrightunsigned("_at", _ROW_BITS), "_row": F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_at")
    parts = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.col("_row") - F.col("_first") + F.col("_start") + 1
    return placed.join(F.broadcast(starts) if parts.count() <= 100_000 else starts, same).select(*df.columns, place.cast("int").alias(name))
