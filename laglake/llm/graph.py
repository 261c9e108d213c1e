"""Connected components by smallest labels with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laglake.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``edges`` (a, b).

    A round takes the smallest label among a node and its neighbours, then the label's own label, and so needs about as many
    rounds as the logarithm of the longest path. Each round's labels are written to the shared folder, which
    cuts the lineage and leaves both sides of every join as plain shuffles that AQE can split where a label is hot."""
    both = materialize(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                         .select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        near = materialize(labels.withColumn("old", F.col("label")).unionByName(seen).groupBy("node")
                           .agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialize(near.join(jump, "label").select("node", F.col("further").alias("label"), "old"), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
