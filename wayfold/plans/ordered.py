"""Rows numbered through in an order, in as many tasks as there are ranges; nothing is gathered to be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfold.sources.scratch import stored


def ranged(df: DataFrame, *order: str, path: str | None = None) -> DataFrame:
    """``df`` in ranges of ``order``, stored, with ``_range`` (in order) and ``_in_range`` (a row's place there)."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    spread = spread.withColumns({"_range": F.shiftright("_m", 33), "_in_range": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    return stored(spread, "ranged", path)


def range_begins(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """``_range, _begin``: how many rows (or how much ``weight``) stand before each range: a row for each range."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = rows.groupBy("_range").agg(size.alias("n"))
    return sizes.select("_range", F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))


def numbered(df: DataFrame, *order: str, name: str = "ord", path: str | None = None) -> DataFrame:
    """``df`` with each row's number from 0 in ``order`` (total, or equal rows are numbered as they come)."""
    rows = ranged(df, *order, path=path)
    out = rows.join(F.broadcast(range_begins(rows)), "_range").withColumn(name, F.col("_begin") + F.col("_in_range"))
    return out.drop("_range", "_in_range", "_begin")
