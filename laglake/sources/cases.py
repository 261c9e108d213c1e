"""Experiment case table source (the reference keeps it in a spreadsheet; here CSV or Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cases(spark: SparkSession, path: str, selected=None, case_col: str = "Case") -> DataFrame:
    """Read the case table (header CSV with inferred types, or Parquet) and keep the ``selected``
    case ids when given."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.where(F.col(case_col).isin(list(selected))) if selected is not None else df
