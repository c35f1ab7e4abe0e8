"""Table preview / profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list | None = None, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Rows, missing values and distinct values per column, computed in one
    aggregation pass and returned as one row per column.

    Exact distinct counts over k columns make Spark expand each row k times before
    the (pre-aggregated) shuffle; ``exact=False`` uses HyperLogLog sketches
    (relative error ``rsd``) that merge map-side with no per-value shuffle -- the
    form to use on a very large table."""
    cols = columns or df.columns
    distinct = F.count_distinct if exact else (lambda c: F.approx_count_distinct(c, rsd))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count(F.col(c)).alias(f"_c{i}"), distinct(F.col(c)).alias(f"_d{i}")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', _c{i}, _d{i}" for i, c in enumerate(cols))
    return one.selectExpr("_n", f"stack({len(cols)}, {stack}) as (column_name, _cnt, n_distinct)") \
              .select("column_name", F.col("_n").alias("n_rows"), (F.col("_n") - F.col("_cnt")).alias("n_missing"),
                      "n_distinct")


def preview(df: DataFrame, n: int = 10, order_by: list | None = None) -> DataFrame:
    """O3: the first ``n`` rows after a total order (a limit only where it is the feature)."""
    return df.orderBy(*(order_by or df.columns)).limit(n)
