"""The registered queries on driver tables, and the pipeline against plain versions of its stages."""

import os
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from laglake.llm import mix_sources, toxicity
from laglake.llm.queries import QUERIES
from oracle_check import canon, duck
from test_pairs import brute_components, brute_spans

SF = os.environ.get("LAGLAKE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver test tables not present")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    fn, sql = QUERIES[name]
    df = fn(spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if sql:
        found = duck(SF).execute(sql)
        assert canon(df.columns, rows) == canon([c[0] for c in found.description], found.fetchall())


def test_suffix_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op4_suffix_dedup"][0](spark, SF).collect()}
    for i, kept, spans in brute_spans(docs, 100):
        assert (got[i].n_bytes - got[i].n_removed, got[i].n_spans) == (len(kept), len(spans))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    before = [[(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for df in seen[:-1]]
    m = toxicity.corpus_model(spark, docs, SF)
    bad = {r.doc_id for r in toxicity.toxicity(docs, m).where("predicted = 1").collect()}
    assert {i for i, _ in before[1]} == {i for i, _ in before[0]} - bad
    assert Counter(i for i, _ in before[2]) == Counter({i: 1 for i, _, c in brute_components(before[1]) if i == c})
    cut = {i: kept.decode("utf-8", "ignore") for i, kept, _ in brute_spans(before[2], 100)}
    assert {i: t or "" for i, t in before[3]} == cut and len(before[3]) == len(before[2])
    copies = {r.doc_id: r["_mix"].copies for r in mix_sources.mix(seen[3]).collect()}
    assert Counter(i for i, _ in before[4]) == Counter({i: n for i, n in copies.items() if n})
    assert all(df.columns == columns for df in seen[:-1])
    assert seen[-1].groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == seen[-1].count()


def test_stages_pass_empty_tables_and_odd_rows(spark, docs, nothing):
    for some in (nothing, docs):
        df = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, df, SF)
        assert (out.count() == 0) == (some is nothing)

