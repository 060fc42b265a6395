"""A sample of registered queries against their SQL; the whole set is run by the driver."""

import math

import duckdb
import pytest

from oracles import ORACLES
from tests.conftest import SF
from tidemark.plans.catalog import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = ["price_scan_tickers", "fundamentals_tidy", "macd", "rule_signals", "walk_forward_folds", "feature_matrix",
          "sector_rank_normalised", "labels_median", "momentum_book", "permutation_test", "random_null_summary",
          "selective_accuracy", "sentiment_feature", "news_payloads"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float):
        return None if v is None or math.isnan(v) else round(v, 5) + 0.0
    return str(v) if not isinstance(v, (int, bool)) else v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = REGISTRY[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(_plain(v) for v in r) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, (int, float)) for x in a) else all(
            x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) for x, y in zip(a, b))


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(REGISTRY)
