"""Zero-shot assembly of window tables from several datasets, and a keyed shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laglake.operators.expand import union_all


def assemble_zero_shot(target: DataFrame, sources: dict, target_name: str = "target",
                       shapes: dict | None = None) -> DataFrame:
    """Target contributes its (complete) test windows, every source its train and val windows;
    rows are tagged with ``dataset``. All inputs carry (segment, ts, split, x, y). ``shapes`` maps
    dataset -> (lag, channels, ahead) and must agree."""
    if shapes and len({tuple(s) for s in shapes.values()}) > 1:
        raise ValueError(f"window shapes differ across datasets: {shapes}")
    parts = [target.where(F.col("split") == "test").withColumn("dataset", F.lit(target_name))]
    for name, w in sources.items():
        parts.append(w.where(F.col("split").isin("train", "val")).withColumn("dataset", F.lit(name)))
    cols = ["dataset", "segment", "ts", "split", "x", "y"]
    return union_all([p.select(*cols) for p in parts])


def shuffle_windows(windows: DataFrame, keys, seed: int = 941) -> DataFrame:
    """Deterministic shuffle: order by a seeded hash of the window key, so x and y stay paired.
    A range-partitioned sort; no row moves through the driver."""
    return windows.orderBy(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))
