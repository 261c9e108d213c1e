"""Shared helpers: key handling, chunking of long series, order-preserving row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laglake.functions.timecols import micro_index, minute_index

DEFAULT_CHUNK_STEPS = 4096


def as_keys(key) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)


def qc(name: str) -> Column:
    """Column by exact name (dots, spaces and brackets in channel names are not struct paths)."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_not_null(cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & qc(c).isNotNull()
    return cond


def with_minutes(df: DataFrame, ts: str, name: str = "m") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, minute_index(ts))


def with_micros(df: DataFrame, ts: str, name: str) -> DataFrame:
    return df.withColumn(name, micro_index(qc(ts)))


MINUTE = 60_000_000  # microseconds


def chunk_of(m: Column | str, width: int) -> Column:
    """floor(m / width) for BIGINT m of any sign, computed exactly: m - pmod(m, width) is a multiple
    of width, so the division has no rounding even for microsecond counts near 2^53."""
    m = F.col(m) if isinstance(m, str) else m
    w = F.lit(int(width)).cast("long")
    return F.floor((m - F.pmod(m, w)) / w).cast("long")


def ordered_row_number(df: DataFrame, keys: list[str], order: str | list, chunk: str | None = None,
                       name: str = "rn", count_name: str | None = "n") -> DataFrame:
    """0-based position of each row inside its key group ordered by ``order`` (and the group size).

    Without ``chunk`` this is one window over the key. With a ``chunk`` column (monotone in
    ``order``) it is skew-safe: per-chunk counts are aggregated (partial aggregation), turned
    into prefix offsets on that small table, and added to a row_number inside (key, chunk), so
    a hot key never sits in a single task."""
    if chunk is None:
        w = Window.partitionBy(*keys)
        out = df.withColumn(name, F.row_number().over(w.orderBy(order)) - 1)
        if count_name:
            out = out.withColumn(count_name, F.count(F.lit(1)).over(w))
        return out
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(order)) - 1)
    # both branches read ``local``; when the input carries no column the count branch prunes,
    # Spark reuses the input's shuffle for both (see windows.make_windows)
    counts = local.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_cnt"))
    wk = Window.partitionBy(*keys).orderBy(chunk)
    offsets = counts.select(
        *keys, chunk,
        F.coalesce(F.sum("_cnt").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        *( [F.sum("_cnt").over(Window.partitionBy(*keys)).alias(count_name)] if count_name else [] ),
    )
    out = local.join(offsets, on=[*keys, chunk], how="inner")
    return out.withColumn(name, F.col("_base") + F.col("_local")).drop("_base", "_local")
