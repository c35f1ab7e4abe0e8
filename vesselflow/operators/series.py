"""Monthly series and the deterministic counterfactual.

Series are long tables ``(series_id, date, y)``; many series (fleet x zone x
measure) are fitted in one plan, each fit being a grouped aggregate.  Windows are
partitioned by ``series_id`` and hold one row per month, so a task holds one
series -- bounded by the calendar, not by the pings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.functions import month_sequence


def month_spine(series: DataFrame, fill: float | None = 0.0, key: str = "series_id",
                date: str = "date", value: str = "y") -> DataFrame:
    """Every month between a series' first and last month; missing months get
    ``fill`` (``None`` keeps them missing).  Months are generated per series from
    its own min/max (one row per series), then joined to the observations."""
    bounds = series.groupBy(key).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    spine = bounds.select(key, F.explode(month_sequence(F.col("_lo"), F.col("_hi"))).alias(date))
    j = spine.join(series, [key, date], "left")
    if fill is not None:
        j = j.withColumn(value, F.coalesce(F.col(value), F.lit(float(fill))))
    return j


def time_index(series: DataFrame, key: str = "series_id", date: str = "date", out: str = "t") -> DataFrame:
    """1..n in date order within each series."""
    return series.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(date)))


def season_index(t: str = "t", n_seasons: int = C.N_SEASONS, duration: int = C.SEASON_DURATION):
    """Season of the structural model (30 seasons of 2 steps)."""
    return F.pmod(F.floor((F.col(t) - 1) / F.lit(duration)), F.lit(n_seasons)).cast("int")


def flag_periods(series: DataFrame, pre: tuple, post: tuple, date: str = "date") -> DataFrame:
    """M3: rows in the pre and the post period (inclusive bounds); other rows in neither."""
    d = F.col(date)
    return (series.withColumn("in_pre", d.between(F.to_date(F.lit(pre[0])), F.to_date(F.lit(pre[1]))))
                  .withColumn("in_post", d.between(F.to_date(F.lit(post[0])), F.to_date(F.lit(post[1])))))


def completeness(series: DataFrame, expected: dict | None = None, key: str = "series_id") -> DataFrame:
    """Rows per series next to the expected count (the analysed code fails on a mismatch)."""
    n = series.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    if expected:
        m = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
        n = n.withColumn("n_expected", F.try_element_at(m, F.col(key)))
    return n


def expected_counts(series: DataFrame, expected: dict, key: str = "series_id") -> DataFrame:
    """(check, n_rows, n_expected, complete) for the counts that the analysed code fixes by hand: ``cpue_pair`` counts
    both fleets' CPUE months together, ``area_series`` each area series apart; any other name is a series of its own.
    A series without an expected count is left out; an expected one without rows has 0 rows and is not complete."""
    names = series.select(key).where(F.col(key).isNotNull())
    check = F.when(F.col(key).startswith("cpue_"), "cpue_pair").otherwise(F.col(key))
    kind = F.when(F.col(key).startswith("area_"), "area_series").otherwise(check)
    counts = names.groupBy(check.alias("check"), kind.alias("_kind")).agg(F.count(F.lit(1)).alias("n_rows"))
    want = series.sparkSession.createDataFrame(sorted(expected.items()), "_want string, n_expected long")
    j = F.broadcast(want).join(counts, F.col("_want") == F.col("_kind"), "left")
    return j.select(F.coalesce("check", "_want").alias("check"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
                    "n_expected", (F.coalesce("n_rows", F.lit(0)) == F.col("n_expected")).alias("complete"))


def require_expected(counts: DataFrame) -> None:
    """An error that names every incomplete check (one row a check is read)."""
    wrong = [f"{r['check']}: {r['n_rows']} rows, expected {r['n_expected']}" for r in counts.where(~F.col("complete")).collect()]
    if wrong:
        raise ValueError("series of unexpected length: " + "; ".join(sorted(wrong)))


def gap_runs(series: DataFrame, first: str, last: str, key: str = "series_id", date: str = "date", value: str = "y") -> DataFrame:
    """Runs of months with and without a known value, per series, against the calendar ``first`` .. ``last``:
    (series_id, first_month, last_month, n_months, present).

    A month is present when it has a row with a value; several rows of a month are one month, rows outside the calendar are not
    looked at, and a series known by its name alone is one run of missing months.  Months of a run share the difference of their
    number and their rank among the months of the same kind; both windows are per series, bounded by the calendar."""
    month = F.trunc(F.col(date), "month")
    months = F.explode(month_sequence(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month")))
    found = series.groupBy(key, month.alias("month")).agg(F.count(value).alias("_n"))
    calendar = found.select(key).distinct().select(key, months.alias("month"))
    j = calendar.alias("c").join(found.alias("f"), F.col(f"c.{key}").eqNullSafe(F.col(f"f.{key}")) & (F.col("c.month") == F.col("f.month")), "left")
    j = j.select(f"c.{key}", "c.month", (F.coalesce("_n", F.lit(0)) > 0).alias("present"))
    number = F.year("month") * 12 + F.month("month")
    rank = F.row_number().over(Window.partitionBy(key, "present").orderBy("month"))
    return (j.withColumn("_run", number - rank).groupBy(key, "present", "_run")
             .agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("n_months"))
             .select(key, "first_month", "last_month", "n_months", "present"))


def linear_counterfactual(series: DataFrame, z: float = 1.96, key: str = "series_id",
                          y: str = "y", t: str = "t") -> DataFrame:
    """M4: per series, least squares of y on the time index over the pre period;
    prediction, interval (+-z residual sd), point effect, and cumulative effect
    over the post period (W5).  The fit is a window aggregate per series (one
    partition per series, bounded by the calendar) -- no join back."""
    w_all = Window.partitionBy(key)
    pre_y = F.when(F.col("in_pre"), F.col(y))
    pre_t = F.when(F.col("in_pre"), F.col(t).cast("double"))
    j = (series.withColumn("_b", F.regr_slope(pre_y, pre_t).over(w_all))
               .withColumn("_a", F.regr_intercept(pre_y, pre_t).over(w_all)))
    pred = F.col("_a") + F.col("_b") * F.col(t)
    j = j.withColumn("pred", pred)
    j = j.withColumn("_sd", F.stddev_samp(F.when(F.col("in_pre"), F.col(y) - F.col("pred"))).over(w_all))
    j = (j.withColumn("lower", F.col("pred") - F.lit(z) * F.col("_sd"))
          .withColumn("upper", F.col("pred") + F.lit(z) * F.col("_sd"))
          .withColumn("effect", F.when(F.col("in_post"), F.col(y) - F.col("pred"))))
    w = Window.partitionBy(key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("cum_effect", F.when(F.col("in_post"), F.sum("effect").over(w)))
    return j.drop("_a", "_b", "_sd")


def impact_summary(fitted: DataFrame, key: str = "series_id", y: str = "y") -> DataFrame:
    """M6: post-period averages and totals of actual, predicted and effect, and the
    relative effect (total effect / total prediction)."""
    post = fitted.where(F.col("in_post"))
    return post.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_post"),
        F.avg(y).alias("actual_avg"), F.avg("pred").alias("pred_avg"), F.avg("effect").alias("effect_avg"),
        F.sum(y).alias("actual_sum"), F.sum("pred").alias("pred_sum"), F.sum("effect").alias("effect_sum"),
        F.try_divide(F.sum("effect"), F.sum("pred")).alias("rel_effect"))
