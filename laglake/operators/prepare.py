"""Cleaning: drop incomplete rows, de-duplicate, cast the date, strip by time, shrink types,
project the used columns."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laglake.functions.timecols import as_ntz, strftime_to_spark
from laglake.operators.common import all_not_null, as_keys, qc
from laglake.spec import DatasetSpec, StripTime


def drop_incomplete(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with a NULL in ``cols`` (default: every column). NaN is a value, not a gap,
    so this is a conjunction of IS NOT NULL rather than ``na.drop`` (which drops NaN too)."""
    return df.where(all_not_null(cols or df.columns))


def dedupe_key(df: DataFrame, key, order_cols=None) -> DataFrame:
    """One row per key; the survivor is the row with the smallest remaining columns (in column
    order). Also removes whole-row duplicates. A hash aggregate with map-side partial min, so a
    hot key is combined before the shuffle instead of gathered in one task."""
    keys = as_keys(key)
    others = [c for c in (order_cols or df.columns) if c not in keys]
    if not others:
        return df.select(*[qc(k) for k in keys]).distinct()
    agg = df.groupBy(*[qc(k) for k in keys]).agg(F.min(F.struct(*[qc(c).alias(f"c{i}") for i, c in enumerate(others)])).alias("_s"))
    return agg.select(*[qc(k) for k in keys], *[F.col("_s")[f"c{i}"].alias(c) for i, c in enumerate(others)])


_BIG_ENDIAN = ["%Y-%m-%d", "%Y-%m-%d %H", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S"]
_UNIT = {"%Y-%m-%d": timedelta(days=1), "%Y-%m-%d %H": timedelta(hours=1),
         "%Y-%m-%d %H:%M": timedelta(minutes=1), "%Y-%m-%d %H:%M:%S": timedelta(seconds=1)}


#: Strftime directives of a timestamp's parts, in the order of the parts.
_PARTS = (("%Y", 1900), ("%m", 1), ("%d", 1), ("%H", 0), ("%M", 0), ("%S", 0))


def strip_bounds(strip: StripTime) -> tuple[str, str]:
    """Both bounds as text in the strip's format. A bound's numbers are read as consecutive parts of a timestamp from the
    first part that the format can start at: the year, or the hour for a time of day."""
    have = [d for d, _ in _PARTS if d in strip.format]
    first = 0 if "%Y" in have else 3
    if not have or first == 3 and "%H" not in have:
        raise ValueError("strip format needs %Y or %H")

    def text(bound) -> str:
        parts = [v for _, v in _PARTS]
        parts[first:first + len(bound)] = bound
        return datetime(*parts).strftime(strip.format)

    return text(strip.start), text(strip.end)


def strip_time(df: DataFrame, ts: str, strip: StripTime) -> DataFrame:
    """Keep rows whose formatted timestamp lies in [start, end] (inclusive, text comparison).
    For big-endian formats an equivalent typed range is added so the scan can prune."""
    lo, hi = strip_bounds(strip)
    cond = F.date_format(qc(ts), strftime_to_spark(strip.format)).between(lo, hi)
    if strip.format in _BIG_ENDIAN:
        lo_t = datetime.strptime(lo, strip.format)
        hi_t = datetime.strptime(hi, strip.format) + _UNIT[strip.format]
        cond = (qc(ts) >= F.lit(lo_t).cast("timestamp_ntz")) & (qc(ts) < F.lit(hi_t).cast("timestamp_ntz")) & cond
    return df.where(cond)


_INT_TYPES = [("int8", 127, -128), ("int16", 32767, -32768), ("int32", 2147483647, -2147483648),
              ("int64", 9223372036854775807, -9223372036854775808)]
_SPARK_TYPE = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float"}
FLOAT32_MAX = 3.4028234663852886e38


def shrink_plan(df: DataFrame) -> DataFrame:
    """Per column: kind, min, max and the narrowest type (strict bounds: min > lo and max < hi
    for integers; float32 when |values| fit). Strings stay strings (Parquet dictionary-encodes
    them). One aggregate over all columns, exploded to one row per column."""
    ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    floats = (T.FloatType, T.DoubleType)
    specs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ints):
            specs.append((f.name, "int"))
        elif isinstance(f.dataType, floats):
            specs.append((f.name, "float"))
        elif isinstance(f.dataType, T.StringType):
            specs.append((f.name, "string"))
    num = [n for n, k in specs if k != "string"]
    stats = df.agg(*[F.min(qc(n)).cast("double").alias(f"mn_{i}") for i, n in enumerate(num)],
                   *[F.max(qc(n)).cast("double").alias(f"mx_{i}") for i, n in enumerate(num)])
    rows = []
    for n, k in specs:
        if k == "string":
            rows.append(F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("kind"),
                                 F.lit(None).cast("double").alias("min_value"),
                                 F.lit(None).cast("double").alias("max_value"), F.lit("string").alias("to_type")))
            continue
        i = num.index(n)
        mn, mx = F.col(f"mn_{i}"), F.col(f"mx_{i}")
        if k == "int":
            to = F.lit("int64")
            for name, hi, lo in reversed(_INT_TYPES):
                to = F.when((mn > F.lit(float(lo))) & (mx < F.lit(float(hi))), F.lit(name)).otherwise(to)
        else:
            to = F.when((mn > F.lit(-FLOAT32_MAX)) & (mx < F.lit(FLOAT32_MAX)), F.lit("float32")).otherwise(F.lit("float64"))
        rows.append(F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("kind"), mn.alias("min_value"),
                             mx.alias("max_value"), to.alias("to_type")))
    return stats.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def shrink_types(df: DataFrame) -> DataFrame:
    """Apply ``shrink_plan`` (its single row of statistics reaches the driver, not the data)."""
    plan = {r["column_name"]: r["to_type"] for r in shrink_plan(df).collect()}
    return df.select(*[qc(c).cast(_SPARK_TYPE[plan[c]]).alias(c) if plan.get(c) in _SPARK_TYPE else qc(c)
                       for c in df.columns])


def parse_date(df: DataFrame, spec: DatasetSpec) -> F.Column:
    """The date column as TIMESTAMP_NTZ: text is parsed with ``spec.time_format`` (strftime or Spark
    pattern) when given, else cast leniently (unparsable text becomes NULL instead of failing)."""
    c = qc(spec.date)
    if isinstance(df.schema[spec.date].dataType, T.StringType):
        if spec.time_format:
            fmt = strftime_to_spark(spec.time_format) if "%" in spec.time_format else spec.time_format
            return F.to_timestamp_ntz(c, F.lit(fmt))
        return c.try_cast("timestamp_ntz")
    return as_ntz(c)


def unread_dates(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The rows of ``df`` with a date that isn't null but can't be read; ``prepare`` drops them."""
    return df.where(qc(spec.date).isNotNull() & parse_date(df, spec).isNull())


def prepare(df: DataFrame, spec: DatasetSpec, null_scope: str = "all", strip: StripTime | None = None,
            shrink: bool = False) -> DataFrame:
    """Null drop -> key de-duplication -> date cast -> time strip -> used-column projection.

    ``null_scope='all'`` tests every input column for NULL before projecting (reference
    behaviour, reads all columns); ``'used'`` projects first so the scan is pruned. Rows whose date
    can't be read are dropped; ``unread_dates`` lists them."""
    if null_scope not in ("all", "used"):
        raise ValueError("null_scope must be all|used")
    used = list(spec.used_columns)
    d = df.select(*[qc(c) for c in used]) if null_scope == "used" else df
    d = d.withColumn(spec.date, parse_date(d, spec))   # first, so that a date that can't be read is dropped like a null one
    d = drop_incomplete(d)
    keys = [k for k in (spec.segment, spec.date) if k]
    d = dedupe_key(d, keys)
    strip = strip or spec.strip_time
    if strip is not None:
        d = strip_time(d, spec.date, strip)
    d = d.select(*[qc(c) for c in used])
    return shrink_types(d) if shrink else d
