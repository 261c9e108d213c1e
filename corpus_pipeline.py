"""Corpus pipeline: toxic documents go, one document of each group of near copies stays, repeated passages are cut, sources are
mixed to their target weights, and what is left is packed into sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame and works on all rows its predecessor kept. All but the
last return the columns of ``documents`` (and any further columns as they are).

Defined results: an empty table passes through every stage as an empty one. A document of which the passage stage leaves nothing stays as
an empty text. Byte spans are cut exactly; a character cut in two goes with the span. ``n_chars`` follows the
text. The mix repeats rows, so ids can occur up to three times after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laglake.llm import bestfit_packing, mix_sources, ngram_join, suffix_dedup, toxicity
from laglake.session import materialize


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic are rejected; the model learns from the labelled rows of ``docs``."""
    return toxicity.without_toxic(docs, toxicity.corpus_model(spark, docs, sf_dir))


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, a similarity of 0.8: the smallest id of each component stays."""
    return ngram_join.representatives(docs)


def passages_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of 100-byte strings are cut out of the texts."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = suffix_dedup.suffix_dedup(docs, carry=rest, decode=True)
    columns = []
    for c in docs.columns:
        value = F.col(c) if c in ("doc_id", "text") else F.col("rest")[c]
        if c == "n_chars":
            value = F.when(F.size("spans") == 0, value).otherwise(F.length("text"))
        columns.append(value.cast(docs.schema[c].dataType).alias(c))
    return found.select(*columns)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 by source, at most three times a source's words; each document as often as the mix takes it."""
    return mix_sources.expand(mix_sources.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return bestfit_packing.bestfit_packing(docs, bestfit_packing.default_tokenizer())


STAGES = [("toxicity", toxic_removed), ("ngram_jaccard_join", near_copies_removed), ("suffix_dedup", passages_removed),
          ("mix_sources", sources_mixed), ("bestfit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. Each stage's result is written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage's classifier, passage search or packing can be expressed in SQL; tests hold them against plain versions.
ORACLE_SQL = None
