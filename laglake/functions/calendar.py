"""Calendar features (cyclical encodings) on a TIMESTAMP_NTZ column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECONDS_PER_DAY = 24 * 60 * 60
SECONDS_PER_YEAR = 365.2425 * SECONDS_PER_DAY
TWO_PI = 2 * math.pi


def cyclical_pattern(df: DataFrame, ts: str, resample: int = 5) -> DataFrame:
    """hour_sin/cos on minute-of-day in ``resample`` steps over a day; day_* on the ISO weekday
    (Monday = 1) over 7; month_* on the month over 12."""
    steps_per_day = 24 * (60 / resample)
    slot = (F.hour(ts) * 60 + F.minute(ts)) / F.lit(float(resample))
    wd = F.weekday(ts) + 1
    mo = F.month(ts)
    return df.select(
        "*",
        F.sin(slot / steps_per_day * TWO_PI).alias("hour_sin"),
        F.cos(slot / steps_per_day * TWO_PI).alias("hour_cos"),
        F.sin(wd / F.lit(7.0) * TWO_PI).alias("day_sin"),
        F.cos(wd / F.lit(7.0) * TWO_PI).alias("day_cos"),
        F.sin(mo / F.lit(12.0) * TWO_PI).alias("month_sin"),
        F.cos(mo / F.lit(12.0) * TWO_PI).alias("month_cos"),
    )


def time_encode(df: DataFrame, ts: str) -> DataFrame:
    """Epoch-second cycles over a day and a 365.2425-day year. The day pair is added only when
    the data spans more than one day-of-month value, the year pair only when it spans more
    than one month (one small aggregate decides)."""
    n = df.agg(F.count_distinct(F.dayofmonth(ts)).alias("d"), F.count_distinct(F.month(ts)).alias("m")).first()
    unix = F.unix_timestamp(F.col(ts).cast("timestamp_ntz")).cast("double")
    cols = ["*"]
    if n["d"] > 1:
        cols += [F.cos(unix * (TWO_PI / SECONDS_PER_DAY)).alias("day_cos"),
                 F.sin(unix * (TWO_PI / SECONDS_PER_DAY)).alias("day_sin")]
    if n["m"] > 1:
        cols += [F.cos(unix * (TWO_PI / SECONDS_PER_YEAR)).alias("month_cos"),
                 F.sin(unix * (TWO_PI / SECONDS_PER_YEAR)).alias("month_sin")]
    return df.select(*cols)
