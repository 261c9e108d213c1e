"""Series views derived from the driver's TPC-H-like tables (identical definitions live in the
DuckDB oracle as CTEs).

D6   lineitem: daily sum(l_quantity) per returnflag||linestatus (6 series)
D1   lineitem: daily sum(l_quantity), one series
H5   events:   hourly avg(value) per event_type (5 series, some hours missing)
WIDE lineitem: daily sum(l_quantity), sum(l_extendedprice), avg(l_discount) per D6 key
USERD events:  daily avg(value) per user_id (many short, gappy series)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.functions.timecols import floor_to_step
from laglake.session import ensure_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day(c: str) -> F.Column:
    return F.to_date(F.col(c)).cast("timestamp_ntz")


def d6(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("segment"), _day("l_shipdate").alias("ts"))
              .agg(F.sum("l_quantity").alias("qty")))


def d1(spark, sf_dir) -> DataFrame:
    """Rolled up from D6, so a plan that reads both aggregates lineitem once."""
    return d6(spark, sf_dir).groupBy("ts").agg(F.sum("qty").alias("qty"))


def h5(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("segment"), floor_to_step("ts", 60).alias("ts"))
              .agg(F.avg("value").alias("value")))


def wide(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("segment"), _day("l_shipdate").alias("ts"))
              .agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"),
                   F.avg("l_discount").alias("disc")))


def userd(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("segment"), floor_to_step("ts", 1440).alias("ts"))
              .agg(F.avg("value").alias("value")))


# SQL twins used by the oracle (DuckDB dialect).
SQL_VIEWS = {
    "D6": "SELECT l_returnflag || l_linestatus AS segment, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, "
          "SUM(l_quantity) AS qty FROM lineitem GROUP BY 1, 2",
    "D1": "SELECT CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, SUM(l_quantity) AS qty FROM lineitem GROUP BY 1",
    "H5": "SELECT event_type AS segment, date_trunc('hour', ts) AS ts, AVG(value) AS value FROM events GROUP BY 1, 2",
    "WIDE": "SELECT l_returnflag || l_linestatus AS segment, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, "
            "SUM(l_quantity) AS qty, SUM(l_extendedprice) AS price, AVG(l_discount) AS disc FROM lineitem GROUP BY 1, 2",
    "USERD": "SELECT user_id AS segment, date_trunc('day', ts) AS ts, AVG(value) AS value FROM events GROUP BY 1, 2",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named series views."""
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    if not names:
        return "WITH " + sql.lstrip().lstrip(",").lstrip() if sql.lstrip().startswith(",") else sql
    return f"WITH {ctes}{'' if sql.lstrip().startswith(',') else chr(10)}{sql}"
