"""Mixing sources to target weights: words per source, repetition rates, whole copies plus one hash-seeded
Bernoulli copy with probability equal to the rate's fraction. DataFrame functions only.

Targets. Sources in code point order (null last) get the weights in turn. Each is owed its weight's share of
all words but at most ``max_rate`` times its own; what a capped source can't take is reshared by weight among
the others until none is above its cap. This water level has a closed form: order sources by cap / weight;
with the first k capped, the level is (all words - their caps) / (weights of the rest), and k is the first
for which the next source stays below its cap.

Defined results: a null text has size 0; a null source is a source of its own; sources without words have
target 0 and take nothing. The coin depends only on the id and the seed, so equal ids get equal copies
(null ids toss as the text 'null'). An empty table gives an empty result.

Scale: per-source totals aggregate map-side. The closed form runs over one row per source. The totals
are joined back by hash join only below ``broadcast_rows`` sources (counted first); beyond that Spark's shuffle join
with AQE skew splitting is left to decide. A hot source is never grouped by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, fresh, table

WEIGHTS = (5, 2, 1)
MAX_RATE = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def coin(id_col: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of md5(id:seed): 52 bits, exact in a double."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """``sizes``: (source, size) rows. Gives source, source_size, weight and target, a row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("cap", (max_rate * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (per.withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
           .withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
           .withColumn("all_words", F.sum("source_size").over(everything).cast("double")))
    level = (F.col("all_words") - F.col("cap_before")) / F.col("weight_from")
    first = F.struct(F.row_number().over(order).alias("at"), level.alias("level"))
    per = per.withColumn("first", F.when(level <= F.col("cap") / F.col("weight"), first))
    per = per.withColumn("level", F.min("first").over(everything)["level"])
    return per.select("source", "source_size", "weight",
                      F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_rate: int = MAX_RATE, seed: int = 7,
        broadcast_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every input row with a last column ``_mix``: struct(size, source_size, target, rate, copies). Copies aren't expanded. If the input
    has a column of that name, the result's name gets underscores (``fresh``); no input column is changed."""
    found, own, name = fresh("_source_totals", docs.columns), fresh("_words", docs.columns), fresh("_mix", docs.columns)
    sizes = docs.select(F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    targets = source_targets(sizes, weights, max_rate).select(F.struct("source", "source_size", "target").alias(found))
    if sizes.select("source").distinct().count() <= broadcast_rows:
        targets = F.broadcast(targets)
    out = docs.withColumn(own, words_in(F.col(text_col)))
    out = out.join(targets, F.col(source_col).eqNullSafe(F.col(found)["source"]), "left")
    size, target = F.col(found)["source_size"], F.col(found)["target"]
    rate = F.when(size > 0, F.least(target / size, F.lit(float(max_rate)))).otherwise(0.0)
    copies = F.floor(rate) + (coin(F.col(id_col), seed) < rate - F.floor(rate)).cast("int")
    fields = [F.col(own).alias("size"), size.alias("source_size"), target.alias("target"), rate.alias("rate"), copies.cast("long").alias("copies")]
    return out.select(*docs.columns, F.struct(*fields).alias(name))


def expand(mixed: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as the mix takes it, with the input's columns."""
    *keep, name = mixed.columns
    copies = F.array_repeat(F.lit(True), F.col(name)["copies"].cast("int"))
    return mixed.where(F.col(name)["copies"] > 0).withColumn(name, F.explode(copies)).select(*keep)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1, at most 3 times a source's words, over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = mix(docs)
    return m.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target",
                    (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


#: DuckDB: the level is found by trying every number of capped sources.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, encode(source) NULLS LAST) AS k FROM s),
lv AS (SELECT a.k, (3 * any_value(a.source_size))::DOUBLE / any_value(a.weight) AS bound,
         ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(3 * b.source_size) FILTER (b.k < a.k), 0)::DOUBLE)
           / (sum(b.weight) FILTER (b.k >= a.k)) AS level
       FROM o a CROSS JOIN o b GROUP BY a.k),
w AS (SELECT arg_min(level, k) AS level FROM lv WHERE level <= bound),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(level * weight, (3 * source_size)::DOUBLE)) AS target FROM s CROSS JOIN w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
        ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':7'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
