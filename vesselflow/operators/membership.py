"""Name-list membership.

Lists are one-column DataFrames.  Joins are null-safe so a missing name behaves
as in the analysed code: ``x %in% list`` is never missing, ``!x %in% list``
keeps missing names.  A list is broadcast only after its row count is checked;
lists derived from large tables are checkpointed first, so the count is cheap and
the list is computed once for every consumer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow.functions import split_first, trim_ws

MAX_BROADCAST_BYTES = 64 << 20
# Bytes reckoned for a row whose text is not measured (a list whose row count is fixed by construction).
ROW_BYTES = 256


def name_list(df: DataFrame, col: str = "vessel_name", normalise: bool = False) -> DataFrame:
    """Distinct names.  ``normalise=True`` cuts at the first '(' and trims;
    the analysed code computes that split but keeps the unsplit name (default)."""
    c = F.col(col)
    if normalise:
        c = trim_ws(split_first(c)[0])
    return df.select(c.alias("vessel_name")).distinct()


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage into the session's checkpoint folder (shared storage on a
    cluster; survives executor loss)."""
    from vesselflow.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def bounded(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only behind a bound in bytes: measured over the list, or ``known_rows``
    rows when its size is fixed by construction (a slice of k positions).  Larger lists
    join by shuffle."""
    if known_rows is not None:
        size = known_rows * ROW_BYTES
    else:
        text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
        row = sum(text, F.lit(16 * len(df.columns)))
        size = df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= max_bytes else df


def _key(names: DataFrame, col: str) -> DataFrame:
    return names.select(F.col(names.columns[0]).alias("_name")).distinct() if names.columns[0] != "_name" \
        else names


def keep_in(df: DataFrame, names: DataFrame, col: str = "vessel_name", check: bool = True,
            known_rows: int | None = None) -> DataFrame:
    """Rows whose name is in the list (a missing name never matches)."""
    n = _key(names, col)
    n = bounded(n, known_rows=known_rows) if check else n
    return df.join(n, df[col].eqNullSafe(n["_name"]), "left_semi")


def drop_in(df: DataFrame, names: DataFrame, col: str = "vessel_name", check: bool = True) -> DataFrame:
    """Rows whose name is not in the list; missing names are kept."""
    n = _key(names, col)
    n = bounded(n) if check else n
    return df.join(n, df[col].eqNullSafe(n["_name"]), "left_anti")


def flag_in(df: DataFrame, names: DataFrame, col: str = "vessel_name", out: str = "revi",
            yes: str = "Yes", no: str = "No", check: bool = True) -> DataFrame:
    """Two-way label by membership (never missing)."""
    n = _key(names, col).withColumn("_hit", F.lit(True))
    n = bounded(n) if check else n
    j = df.join(n, df[col].eqNullSafe(n["_name"]), "left")
    return j.withColumn(out, F.when(F.col("_hit"), yes).otherwise(no)).drop("_name", "_hit")


def difference(a: DataFrame, b: DataFrame, col: str = "vessel_name") -> DataFrame:
    """Names in ``a`` but not in ``b`` (null-safe)."""
    return drop_in(a.select(col).distinct(), b, col)
