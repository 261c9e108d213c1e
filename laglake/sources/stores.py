"""Parquet sinks / sources for windows, raw splits, scaler records, rejects, predictions, metrics, and a store of runs.

A store of runs takes appends that may be repeated. Each run's rows lie in their own folder, and a run counts once its name is in the
manifest, which is written after the rows. A run that is appended again is skipped if it is in the manifest; if an earlier attempt
broke off, its folder is written anew. Readers go by the manifest, so they see whole runs only."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_windows(windows: DataFrame, path: str, dataset: str | None = None, mode: str = "append",
                  sort_within=("segment", "ts")) -> str:
    """Append window rows partitioned by (dataset, split): later reads prune to one split. Rows are
    sorted by (segment, date) inside each task (no shuffle), which keeps Parquet min / max
    statistics tight for later filters."""
    w = windows if dataset is None else windows.withColumn("dataset", F.lit(dataset))
    cols = [c for c in (sort_within or ()) if c in w.columns]
    if cols:
        w = w.sortWithinPartitions(*cols)
    w.write.mode(mode).partitionBy("dataset", "split").parquet(path)
    return path


def read_windows(spark: SparkSession, path: str, dataset: str | None = None, split: str | None = None,
                 schema=None) -> DataFrame:
    """Read a window store; pass the ``schema`` when the store may hold no file yet."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=None,
                single_file: bool = False, sort_within=None) -> str:
    """Generic sink for raw splits (partition by split), scaler stats (json), rejects (append),
    predictions and metrics (csv with header, one file: the table is one row per model).
    ``sort_within``: order rows (e.g. segment, date) inside each task before writing."""
    d = df.coalesce(1) if single_file else df
    if sort_within:
        d = d.sortWithinPartitions(*sort_within)
    w = d.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    getattr(w, fmt)(path)
    return path


RUNS = "run string, n_rows long, schema string"


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, n_rows, schema) of the store's whole runs, one row each."""
    try:
        found = spark.read.schema(RUNS).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], RUNS)
    return found.dropDuplicates(["run"])


def append_run(df: DataFrame, path: str, run: str, partition_by=(), sort_within=None) -> bool:
    """Appends ``df`` as the run ``run``; False if the store already has that run, whose rows then stay as they are."""
    spark = df.sparkSession
    if not committed_runs(spark, path).where(F.col("run") == run).isEmpty():
        return False
    at = f"{path}/rows/run={run}"
    d = df.sortWithinPartitions(*sort_within) if sort_within else df
    w = d.write.mode("overwrite")   # what a broken attempt left goes
    (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    n = spark.read.schema(df.schema).parquet(at).count()
    spark.createDataFrame([(run, n, df.schema.json())], RUNS).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def read_runs(spark: SparkSession, path: str, runs=None) -> DataFrame:
    """Rows of the store's whole runs (or of those named), with their ``run``. Runs may differ in columns; missing ones are null."""
    from functools import reduce

    from pyspark.sql.types import StructType
    known = {r["run"]: StructType.fromJson(json.loads(r["schema"])) for r in committed_runs(spark, path).collect()}   # one row per run
    missing = set(runs or ()) - set(known)
    if missing:
        raise ValueError(f"no run {sorted(missing)} in the store")
    wanted = sorted(known if runs is None else set(runs))
    if not wanted:
        raise ValueError(f"no whole run in the store {path}")
    by_schema: dict[str, list[str]] = {}
    for r in wanted:
        by_schema.setdefault(known[r].json(), []).append(r)
    parts = []
    for r in by_schema.values():   # runs of one schema are one scan
        schema = StructType([*known[r[0]].fields]).add("run", "string")
        parts.append(spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/run={x}" for x in r]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
