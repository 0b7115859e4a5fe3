"""Driver contract: entry(), queries(), oracle_sql(); a sample of oracle checks."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["ip_country", "total_transactions", "fraud_count", "fraud_rate"]


def test_every_oracle_has_a_query():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) > 100


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


@pytest.mark.parametrize("key", ["join_ip_country_asof", "win_device_freq_1h", "agg_country_fraud",
                                 "split_stratified", "eval_roc_auc", "thr_grid_recall80",
                                 "prepare_features_commerce", "f_one_hot", "dq_validate_commerce"])
def test_oracle_sample(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    sdf = E.queries()[key](spark, SF0001)
    cols = sorted(sdf.columns)
    a = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=str)
    cur = con.execute(E.oracle_sql()[key])
    dcols = [c[0] for c in cur.description]
    assert sorted(dcols) == cols
    b = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall()), key=str)
    assert a == b
