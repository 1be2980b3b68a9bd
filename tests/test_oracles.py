"""Registered queries against their DuckDB oracles on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from editrisk.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tests.oracle_compare import digest

FAST = ["frequency", "join_frequency", "log_scale", "group_mean", "join_group_aggregate", "impute_median",
        "cum_unique", "cum_mean", "prev_value", "time_since_previous", "session_agg", "value_risk_topk",
        "corpus_statistics", "describe_all", "roc_auc", "pr_auc_interpolated", "roc_curve_100",
        "most_frequent_tag", "bad_word_ratio", "comment_word_max", "ordered_split", "load_revisions",
        "feature_pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    q, sql = entry.queries()[name], entry.oracle_sql()[name]
    sdf = q(spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_an_entry(spark):
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
