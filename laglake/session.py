"""Session helpers: a tuned local session for tests/bench, the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "laglake",
                  extra: dict | None = None) -> SparkSession:
    """Session used by tests and bench. On a cluster, pass the cluster's master and let
    spark-defaults supply ``spark.checkpoint.dir``."""
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("LAGLAKE_DRIVER_MEMORY", "16g")))
    if master:
        b = b.master(master)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Calendar features and CSV timestamp parsing depend on the session zone; pin it."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str | None:
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    try:
        jd = spark.sparkContext._jsc.sc().getCheckpointDir()
        return jd.get() if jd.isDefined() else None
    except Exception:  # noqa: BLE001 - no JVM context (e.g. a remote session)
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; create a private one only in local mode (tests). Elsewhere
    executors couldn't read each other's files there, so an unset folder raises."""
    d = checkpoint_dir(spark)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master or 'the cluster'} share")
        d = tempfile.mkdtemp(prefix="laglake-ckpt-")
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:  # noqa: BLE001
            spark.conf.set("spark.checkpoint.dir", d)
        return d
    try:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/laglake/{_run_name(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _run_name(spark: SparkSession) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "-", spark.conf.get("spark.app.id", "run"))


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables this application wrote; call it once their results are consumed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/laglake/{_run_name(spark)}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str = "state"):
    """Write ``df`` as Parquet under the shared scratch folder and read it back: lineage is cut
    (the result survives executor loss) and, unlike an eager ``checkpoint()``, the input is
    computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cluster_conf(input_bytes: int, executor_cores: int = 1000 * 4, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized from the input volume for a cluster run (apply with ``SparkSession.builder.config``
    or ``spark.conf.set``): enough shuffle partitions that each holds ~``target_partition_bytes``
    (AQE then coalesces small ones and splits skewed ones), scan splits of the same size, and
    AQE skew handling for hot keys. Example: 100 TB -> ~400 000 shuffle partitions."""
    parts = max(executor_cores * 2, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.session.timeZone": "UTC",
    }
