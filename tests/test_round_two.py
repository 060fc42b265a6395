"""Missing values, doubled rows, layouts and run folders."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import by, close_bars, day
from tidemark import session
from tidemark.functions.normal import normal_cdf, normal_quantile
from tidemark.operators import direction, evaluation, features, indicators, models, montecarlo, ranks, rules
from tidemark.plans import walk_forward
from tidemark.sources import tables


def test_doubled_bars_count_once(spark):
    bars = close_bars(spark, {"A": [100 + i for i in range(40)]}).withColumn("delivered", F.lit(2))
    doubled = bars.union(bars.where(F.col("date") > F.lit(day(30))).withColumn("close", F.col("close") * 3)
                         .withColumn("delivered", F.lit(1)))
    want = indicators.technical_frame(tables.load_prices(bars.drop("delivered"))).orderBy("date").collect()
    assert indicators.technical_frame(tables.load_prices(doubled, ingest="delivered")).orderBy("date").collect() == want


def test_no_real_value_has_no_p_value(spark):
    null = spark.createDataFrame([(i, float(i)) for i in range(20)], "draw int, sharpe double")
    real = spark.createDataFrame([(None,)], "sharpe double")
    got = montecarlo.locate_in_null(null, real, ["sharpe"]).first()
    assert got["p_value"] is None and got["real"] is None
    found = montecarlo.locate_in_null(null, spark.createDataFrame([(18.5,)], "sharpe double"), ["sharpe"]).first()
    assert found["p_value"] == pytest.approx(2 / 21) and found["percentile"] == pytest.approx(95)


def test_null_groups_are_ranked(spark):
    rows = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), (None, "c", 5.0), (None, "d", 3.0)], "g string, ticker string, v double")
    got = by(ranks.ranked(rows, ["g"], "v", ["ticker"]), "ticker")
    assert {t: (r["n"], r["avg_rank"]) for t, r in got.items()} == {"a": (2, 1.0), "b": (2, 2.0), "c": (2, 2.0), "d": (2, 1.0)}
    assert ranks.hash_positions(rows, ["g"]).count() == 4


def test_dates_without_returns_are_no_long_short_dates(spark):
    d = [dt.date(2020, 1, 31), dt.date(2020, 2, 29)]
    rows = [(d[0], t, s, s / 10) for t, s in (("A", 1.0), ("B", 2.0), ("C", 3.0))] + [(d[1], t, 1.0, None) for t in "ABC"]
    pairs = spark.createDataFrame(rows, "rebalance_date date, ticker string, score double, ret double")
    got = evaluation.long_short(pairs).collect()
    assert [r["rebalance_date"] for r in got] == [d[0]] and got[0]["spread"] == pytest.approx(0.2)


def _matrix(spark, dates, names):
    rows = [(dt.date(2020, 1 + k, 28), f"T{i}", float((i * 7 + k * 3) % 11), float(i % 5), int((i * 7 + k) % 11 > 5))
            for k in range(dates) for i in range(names)]
    df = spark.createDataFrame(rows, "rebalance_date date, ticker string, mom_1m double, roe double, label int")
    return df.select("rebalance_date", "ticker", "mom_1m", "roe"), df.select("rebalance_date", "ticker", "label")


def test_without_a_fold_there_are_no_scores(spark):
    matrix, labels = _matrix(spark, 2, 6)
    got = walk_forward.walk_forward_scores(matrix, labels)
    assert got.columns == ["rebalance_date", "ticker", "score"] and got.count() == 0


@pytest.mark.parametrize("kind", ["rf", "xgb"])
def test_scores_do_not_depend_on_the_input_layout(spark, kind):
    matrix, labels = _matrix(spark, 2, 120)
    train = matrix.join(labels, ["rebalance_date", "ticker"])
    stats = {"n": 240, "ones": train.agg(F.sum("label")).first()[0], "seen": {"mom_1m": 240, "roe": 240}}
    scores = []
    for n in (1, 6):
        rows = session.training_layout(train.repartition(n), features.KEYS)
        model = models.Ranker(kind, {}).fit(rows, ["mom_1m", "roe"], stats)
        scores.append([r["score"] for r in model.score(train).orderBy("rebalance_date", "ticker").collect()])
    assert scores[0] == scores[1]


def test_forecast_needs_training_rows(spark):
    panel = indicators.direction_panel(close_bars(spark, {"A": [100 + i % 7 for i in range(60)]}))
    before = set(spark.sparkContext._jsc.getPersistentRDDs())
    with pytest.raises(ValueError):
        direction.forecast_latest(panel, "logistic", as_of=day(35))
    assert direction.forecast_latest(panel, as_of=day(50)).first()["as_of"] <= day(50)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_normal_distribution(spark):
    from statistics import NormalDist
    z = [-9.0, -3.2, -1.0, -1e-9, 0.0, 0.5, 1.96, 4.0, 8.0, 20.0]
    df = spark.createDataFrame([(x,) for x in z] + [(None,)], "z double")
    got = [r[0] for r in df.select(normal_cdf(F.col("z"))).collect()]
    assert got[:-1] == pytest.approx([NormalDist().cdf(x) for x in z], abs=1e-14) and got[-1] is None
    p = [1e-6, 0.025, 0.5, 0.9, 0.999999]
    df = spark.createDataFrame([(x,) for x in p] + [(0.0,), (1.0,), (None,)], "p double")
    got = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert got[:5] == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-9) and got[5:] == [None] * 3


def test_unmatched_sentences_are_whole(spark):
    same = "x" * 80
    rows = spark.createDataFrame([(same + "1", False), (same + "2", False), (same + "2", False), ("ok", True)], "sentence string, matched boolean")
    assert by(rules.unmatched_examples(rows), "sentence").keys() == {same + "1", same + "2"}
    assert [r["count"] for r in rules.unmatched_examples(rows, 1).collect()] == [2]


def test_a_run_can_be_ended(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "stage_dir", lambda s: str(tmp_path))
    assert session.stage(spark.range(3).toDF("a"), "t").count() == 3
    assert os.listdir(session.run_dir(spark))
    session.end_run(spark)
    assert not os.path.exists(session.run_dir(spark))
