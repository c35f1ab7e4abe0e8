"""Orderings (O1, O2, P22): 1-based positions in a total order, computed without
moving the data into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, col: str, out: str = "pos", materialize: bool = True) -> DataFrame:
    """Distinct values of ``col`` with their 1-based position in ascending order.

    A range-partitioned sort spreads the values over tasks; each row's position
    is its index inside its sorted partition plus the number of values in the
    partitions before it.  Only the per-partition counts (one row per partition)
    are ordered as a whole.  The distinct values are checkpointed first (one
    distributed pass over ``df``), so the sort's sampling pass and the offset
    join read that small list instead of recomputing the input."""
    vals = df.select(col).distinct()
    if materialize:
        from vesselflow.operators.membership import materialize as _m
        vals = _m(vals)
    s = (vals.orderBy(col)
           .withColumn("_mid", F.monotonically_increasing_id())
           .withColumn("_part", F.spark_partition_id()))
    parts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    parts = parts.withColumn("_off", F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = s.join(F.broadcast(parts.select("_part", "_first", "_off")), "_part")
    return j.select(col, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("int").alias(out))
