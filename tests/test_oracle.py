"""Every registered query against its DuckDB twin on the smallest driver tables (sf0.001).
The full sf0.01 comparison is ``python tests/oracle_check.py``."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as E
from oracle_check import canon, duck

SF = os.environ.get("LAGLAKE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver test tables not present")

from laglake.plans.queries import QUERIES as CORE  # noqa: E402

QUERIES = {name: E.queries()[name] for name in CORE}
SQL = {name: sql for name, sql in E.oracle_sql().items() if name in CORE}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["split", "n_windows", "first_ts", "last_ts"]
    assert {r["split"] for r in rows} == {"train", "val", "test"}


def test_registry_complete():
    assert set(SQL) <= set(QUERIES)
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only == {"select_lambda", "zero_shot_eval", "predict_t2v", "zero_shot_experiment", "single_dataset_experiment", "stored_model_eval", "fit_shared_multi"}


#: Fits that raise where no series has a training window, as in the smallest tables; they run on the next larger ones.
FITS = {"predict_t2v", "single_dataset_experiment", "stored_model_eval", "zero_shot_eval", "zero_shot_experiment"}
LARGER = str(Path(SF).with_name("sf0.01"))


@pytest.mark.skipif(Path(SF).name != "sf0.001", reason="larger tables have training windows")
def test_fits_without_training_windows_raise(spark):
    with pytest.raises(ValueError, match="no training windows"):
        QUERIES["single_dataset_experiment"](spark, SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, LARGER if name in FITS else SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert len(cols) > 0
        return
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    c1, m1 = canon(cols, rows)
    c2, m2 = canon(dcols, res.fetchall())
    assert c1 == c2
    assert m1 == m2, (list((m1 - m2).items())[:3], list((m2 - m1).items())[:3])
