"""Raw ping cleaning (P1-P6): names, numeric repair, ids, timestamps, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesselflow import constants as C
from vesselflow.functions import id_text


def rename_raw(raw: DataFrame, renames: dict = C.RAW_RENAMES) -> DataFrame:
    """Spanish headers to English names (unknown columns untouched)."""
    return raw.withColumnsRenamed({k: v for k, v in renames.items() if k in raw.columns})


def repair_number(x) -> Column:
    """Numeric text with a decimal comma, units or stray symbols -> double;
    text without a leading number -> missing."""
    s = F.regexp_replace(F.trim(F.col(x) if isinstance(x, str) else x), ",", ".")
    num = F.regexp_extract(s, r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)", 0)
    return F.when(num != "", num).try_cast("double")


def repair_numbers(df: DataFrame, cols: dict) -> DataFrame:
    """P2 over several columns ``{raw_name: clean_name}``; adds ``n_unparsed`` per
    row (count of non-empty inputs that did not parse)."""
    bad = F.lit(0)
    for raw, out in cols.items():
        df = df.withColumn(out, repair_number(raw))
        bad = bad + F.when(F.col(out).isNull() & (F.trim(F.col(raw)) != ""), 1).otherwise(0)
    return df.withColumn("n_unparsed", bad)


def parse_timestamp(df: DataFrame, raw: str = "raw_date", fmt: str = C.RAW_TIMESTAMP_FORMAT,
                    out: str = "date") -> DataFrame:
    """Text timestamp -> timestamp (missing when malformed) and its parts."""
    ts = F.try_to_timestamp(F.col(raw), F.lit(fmt))
    return (df.withColumn(out, ts).withColumn("year", F.year(out)).withColumn("month", F.month(out))
              .withColumn("day", F.dayofmonth(out)))


def file_name_from_path(path: Column) -> Column:
    """Base name of the source file without its extension (scan paths are URIs:
    percent-escapes are decoded, a literal '+' is kept)."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    decoded = F.try_url_decode(F.regexp_replace(base, r"\+", "%2B"))
    return F.regexp_replace(F.coalesce(decoded, base), r"\.[^.]*$", "")


def row_ids(df: DataFrame, group: str = "file_name", out: str = "id") -> DataFrame:
    """P5: dense 1..n per ``group`` in input order, computed without a per-group
    window over the rows.  Each input partition is sorted locally by (group, input
    order) -- no shuffle -- so a group's rows are contiguous there; per (group,
    partition) counts form a small table whose running offsets give every row its
    number.  A file holding a third of all rows is still spread over its input splits.

    Rows of a raw scan carry ``source_file`` and ``source_block``, the first byte of their split.  Then a row's
    number is its place in its split after the rows of the file's earlier bytes, and does not depend on how the scan was cut or
    which task read it."""
    if {"source_file", "source_block"} <= set(df.columns):
        return _ids_by_byte(df, group, out)
    d = (df.withColumn("_seq", F.monotonically_increasing_id())
           .sortWithinPartitions(group, "_seq")
           .withColumn("_mid", F.monotonically_increasing_id())
           .withColumn("_part", F.spark_partition_id()))
    parts = d.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    parts = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), "_first", "_off")
    j = d.join(parts, d[group].eqNullSafe(parts["_group"]) & (d["_part"] == parts["_p"])).drop("_group", "_p")     # a missing file keeps its rows
    return j.withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1) \
            .drop("_seq", "_mid", "_part", "_first", "_off")


def _ids_by_byte(df: DataFrame, group: str, out: str) -> DataFrame:
    d = df.withColumn("_mid", F.monotonically_increasing_id())          # a split's rows follow each other in one task
    parts = d.groupBy(group, "source_file", "source_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(group).orderBy("source_file", "source_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("_group"), F.col("source_file").alias("_f"), F.col("source_block").alias("_b"), "_first",
                         F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    same = d[group].eqNullSafe(parts["_group"]) & (d["source_file"] == parts["_f"]) & (d["source_block"] == parts["_b"])
    return d.join(parts, same).withColumn(out, F.col("_off") + F.col("_mid") - F.col("_first") + 1).drop("_group", "_f", "_b", "_mid", "_first", "_off")


def preprocess(raw: DataFrame, file_col: str | None = None, with_ids: bool = True) -> DataFrame:
    """P1-P6 on a raw ping table: English names, repaired speed/direction, text RNP,
    parsed timestamp and parts, provenance ``file_name``, per-file row id."""
    df = rename_raw(raw)
    df = repair_numbers(df, {"raw_speed": "speed", "raw_direction": "direction"})
    df = df.withColumn("RNP", id_text("RNP"))
    df = parse_timestamp(df)
    if file_col:
        df = df.withColumn("file_name", file_name_from_path(F.col(file_col)))
    if with_ids:
        df = row_ids(df)
    return df.drop("raw_speed", "raw_direction", "raw_date", "source_block")
