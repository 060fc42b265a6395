import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import by
from tidemark import schemas
from tidemark.operators import evaluation, features, models, montecarlo, selection
from tidemark.plans import books, walk_forward

QUALITY = {"AAA": 3.0, "BBB": 2.0, "CCC": 1.0, "DDD": 0.0}
DATES = [d.date() for d in pd.date_range("2018-01-31", periods=14, freq="ME")]


@pytest.fixture(scope="module")
def world(spark):
    """Four tickers with constant monthly returns of quality * 5 %, and a market at 5 %."""
    px = [(t, d, 100.0 * (1 + q * .05) ** k) for t, q in {**QUALITY, "SPY": 1.0}.items() for k, d in enumerate(DATES)]
    bars = spark.createDataFrame(px, "ticker string, date date, close double")
    cells = [(d, t, *[0.0] * 12, q, *[0.0] * 3) for d in DATES for t, q in QUALITY.items()]
    names = schemas.FEATURES
    matrix = spark.createDataFrame(cells, "rebalance_date date, ticker string, " + ", ".join(f"{c} double" for c in names))
    labels = spark.createDataFrame([(d, t, int(q * .05 > .075)) for d in DATES for t, q in QUALITY.items()],
                                   "rebalance_date date, ticker string, label int")
    scores = matrix.select("rebalance_date", "ticker", F.col("roe").alias("score"))
    return bars.cache(), matrix.cache(), labels.cache(), scores.cache(), names.index("roe")


def test_fixture_marks_the_right_feature(world):
    _, matrix, *_ = world
    assert matrix.select(F.max("roe")).first()[0] == 3.0


def test_top_n_and_ties(spark):
    d = DATES[0]
    s = spark.createDataFrame([(d, "A", .9), (d, "C", .5), (d, "B", .5), (d, "Z", None)],
                              "rebalance_date date, ticker string, score double")
    assert {r.ticker for r in selection.top_n(s, 2).collect()} == {"A", "B"}
    assert {r.ticker for r in selection.top_n(s, 9).collect()} == {"A", "B", "C", "Z"}


def test_turnover_by_hand(spark):
    w = [(DATES[0], "A", .5), (DATES[0], "B", .5), (DATES[1], "A", .5), (DATES[1], "C", .5), (DATES[2], "C", 1.0)]
    df = spark.createDataFrame(w, "rebalance_date date, ticker string, weight double")
    got = by(selection.turnover(df), "rebalance_date")
    assert [got[d].turnover for d in DATES[:3]] == pytest.approx([1.0, 1.0, 1.0])


def test_best_names_are_held_net_of_costs(world):
    bars, _, _, scores, _ = world
    free = books.book_streams(scores, bars, books.SelectionConfig(top_n=2, cost=0.0)).orderBy("entry_date").collect()
    paid = books.book_streams(scores, bars, books.SelectionConfig(top_n=2, cost=.01)).orderBy("entry_date").collect()
    assert len(free) == 13 and all(r.net == pytest.approx(.125) for r in free)
    assert paid[0].net == pytest.approx(.115) and paid[1].net == pytest.approx(.125)
    assert all(r.benchmark == pytest.approx(.075) and r.market == pytest.approx(.05) for r in free)


def test_market_is_optional(world):
    bars, _, _, scores, _ = world
    rows = books.book_streams(scores, bars.where("ticker <> 'SPY'")).collect()
    assert all(r.market is None and r.net is not None for r in rows)


def test_picks_without_a_price_are_left_out(spark, world):
    bars, _, _, scores, _ = world
    ghost = scores.unionByName(spark.createDataFrame([(d, "GONE", 99.0) for d in DATES], scores.schema))
    rows = books.book_streams(ghost, bars, books.SelectionConfig(top_n=2, cost=0.0)).collect()
    assert all(r.gross == pytest.approx(.15) for r in rows)


def test_perfect_scores_have_perfect_quality(world):
    bars, _, labels, scores, _ = world
    scored = evaluation.scored_labels(scores, labels)
    got = {r.metric: r.value for r in evaluation.ranking_metrics(scored, 2).collect()}
    assert got == {"precision_at_n": 1.0, "mean_auc": 1.0, "base_rate": .5, "n_folds": 14.0}
    pairs = evaluation.scored_returns(scores, bars)
    ic = evaluation.information_summary(evaluation.information_by_date(pairs)).first()
    assert ic.mean_ic == pytest.approx(1.0) and ic.n_periods == 13
    ls = evaluation.long_short(pairs).collect()
    assert len(ls) == 13 and all(r.spread == pytest.approx(.15) for r in ls)


def test_report_bundle(world):
    bars, _, labels, scores, _ = world
    rep = books.selection_report(scores, labels, bars, books.SelectionConfig(top_n=2))
    m = by(rep["metrics"], "series")
    assert m["strategy"].cumulative_return > m["benchmark"].cumulative_return > m["market"].cumulative_return
    assert rep["win_rate"].first().win_rate == 1.0 and rep["yearly"].count() == 2
    assert rep["avg_turnover"].first().avg_turnover == pytest.approx(1 / 13)


def test_robustness_bundle(world):
    bars, _, labels, scores, _ = world
    r = books.robustness(scores, labels, bars, (10, 50))
    grid = by(r["grid"], "top_n", "cost")
    assert len(grid) == 9 and grid[3, .002].cumulative_return < grid[3, 0.0].cumulative_return
    assert [x.n_trials for x in r["deflated"].orderBy("n_trials").collect()] == [10, 50]


@pytest.mark.parametrize("kind", ["logistic", "gbm", "rf", "xgb"])
def test_rankers_order_rows_and_take_nulls(spark, kind):
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal(2 * y - 1, .5)), float(rng.normal()) if i % 9 else None, None, y)
            for i, y in enumerate([0, 1] * 40)]
    df = spark.createDataFrame(rows, "a double, b double, never double, label int")
    small = {} if kind == "logistic" else {"numTrees": 10} if kind == "rf" else {"maxIter": 10}
    model = models.Ranker(kind, small).fit(df, ["a", "b", "never"])
    got = model.score(df).groupBy("label").agg(F.avg("score").alias("s")).orderBy("label").collect()
    assert got[1].s > .6 > .4 > got[0].s
    again = model.score(df.select("label", "b", "never", "a")).agg(F.sum("score")).first()[0]
    assert again == pytest.approx(model.score(df).agg(F.sum("score")).first()[0])


def test_ranker_contract(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, None)], "a double, label int")
    assert {r.score for r in models.Ranker("logistic").fit(df, ["a"]).score(df).collect()} == {1.0}
    zeros = df.withColumn("label", F.lit(0))
    assert {r.score for r in models.Ranker("gbm").fit(zeros, ["a"]).score(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        models.Ranker("svm")
    with pytest.raises(RuntimeError):
        models.Ranker("rf").score(df)


def test_walk_forward_picks_the_best(world):
    _, matrix, labels, _, _ = world
    scores = walk_forward.walk_forward_scores(matrix, labels, "logistic", options={"maxIter": 20}).cache()
    assert scores.select("rebalance_date").distinct().count() == 11
    assert {r.ticker for r in selection.top_n(scores, 1).collect()} <= {"AAA"}


def test_long_label_horizons_are_embargoed(world):
    _, matrix, labels, _, _ = world
    future = labels.withColumn("label", F.when(F.col("rebalance_date") >= F.lit(DATES[1]), 1 - F.col("label"))
                               .otherwise(F.col("label")))
    few = matrix.where(F.col("rebalance_date") <= F.lit(DATES[3]))
    s = walk_forward.walk_forward_scores(few, future, "logistic", 3, horizon_months=3, options={"maxIter": 20})
    best = s.orderBy(F.col("score").desc()).first()
    assert best.ticker == "AAA"  # only the first date's labels are known by the fourth


def _folds(spark, signal):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        y = rng.permutation([1] * 5 + [0] * 5)
        s = y * signal + rng.normal(0, 1, 10)
        rows += [(dt.date(2015, 1, 1) + dt.timedelta(days=30 * k), f"T{i}", float(s[i]), int(y[i])) for i in range(10)]
    return spark.createDataFrame(rows, "rebalance_date date, ticker string, score double, label int")


def test_permutation_tells_signal_from_noise(spark):
    p = lambda x: montecarlo.permutation_test(montecarlo.permutation_draws(_folds(spark, x), 3, 100)).first()
    good, bad = p(1.5), p(0.0)
    assert good.p_mean_auc < .02 and good.p_precision < .02 and bad.p_mean_auc > .05
    assert abs(good.null_mean_auc - .5) < .02 and good.n_permutations == 100


def test_permutation_uses_every_cell_split(spark, monkeypatch):
    """Small cells force the boundary path; the drawn subsets stay the same."""
    scored = _folds(spark, .5)
    rows = lambda: sorted(map(tuple, montecarlo.permutation_draws(scored, 3, 20).collect()))
    one = rows()
    monkeypatch.setattr(montecarlo, "ROWS_PER_CELL", 2)
    assert np.allclose(rows(), one)


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(0)
    v = [(i, float(x)) for i, x in enumerate(rng.normal(.02, .05, 120))]
    df = spark.createDataFrame(v, "k int, ret double")
    mean = np.mean([x for _, x in v])
    b = montecarlo.bootstrap_mean(df, "ret", "k", draws=400).first()
    assert b.mean_lo < mean < b.mean_hi and abs(b.mean_median - mean) < .002
    bb = montecarlo.block_bootstrap(df, "ret", "k", draws=400).first()
    iid = montecarlo.block_bootstrap(df, "ret", "k", draws=400, block=1).first()
    assert bb.block_size == 5 and iid.block_size == 1
    assert bb.ann_sharpe_lo < bb.ann_sharpe_median < bb.ann_sharpe_hi
    assert montecarlo.block_bootstrap(df.limit(1), "ret", "k", draws=10).first().ann_return_median is None


def test_deflation_separates_skill_from_luck(spark):
    rng = np.random.default_rng(1)
    mk = lambda mu: spark.createDataFrame([(float(x),) for x in rng.normal(mu, .04, 130)], "net double")
    good, bad = (montecarlo.deflated_sharpe(mk(mu), None, [2, 50]).orderBy("n_trials").collect() for mu in (.03, 0.0))
    assert good[1].dsr > .95 > .5 > bad[1].dsr and good[0].dsr >= good[1].dsr
    assert montecarlo.deflated_sharpe(mk(.03), None, [1]).first().sr0 == 0.0


def test_sharpe_moments_match_numpy(spark):
    x = np.random.default_rng(2).normal(.01, .05, 90)
    m = montecarlo.sharpe_moments(spark.createDataFrame([(float(v),) for v in x], "net double")).first()
    z = (x - x.mean()) / x.std()
    assert m.sharpe == pytest.approx(x.mean() / x.std(ddof=1))
    assert m.skew == pytest.approx((z ** 3).mean()) and m.kurtosis == pytest.approx((z ** 4).mean())


def test_probabilities_match_the_normal_distribution(spark):
    import math
    from statistics import NormalDist
    x = np.random.default_rng(5).normal(.02, .05, 80)
    row = montecarlo.deflated_sharpe(spark.createDataFrame([(float(v),) for v in x], "net double"), None, [40]).first()
    sr, nd, g = x.mean() / x.std(ddof=1), NormalDist(), 0.5772156649015329
    sr0 = math.sqrt(1 / 79) * ((1 - g) * nd.inv_cdf(1 - 1 / 40) + g * nd.inv_cdf(1 - 1 / (40 * math.e)))
    z = (x - x.mean()) / x.std()
    k, s = (z ** 4).mean(), (z ** 3).mean()
    want = nd.cdf((sr - sr0) * math.sqrt(79) / math.sqrt(1 - s * sr + (k - 1) / 4 * sr * sr))
    assert row.sr0 == pytest.approx(sr0) and row.dsr == pytest.approx(want)


def test_random_picks_are_distinct_and_uniform(spark):
    c = spark.createDataFrame([(DATES[0], f"T{i}") for i in range(7)] + [(DATES[1], f"T{i}") for i in range(2)],
                              "rebalance_date date, ticker string")
    picks = montecarlo.random_picks(c, 3, 1400).toPandas()
    sizes = picks.groupby(["rebalance_date", "draw"]).ticker.nunique().groupby("rebalance_date").agg(["min", "max"])
    assert sizes.values.tolist() == [[3, 3], [2, 2]]
    share = picks[picks.rebalance_date == DATES[0]].ticker.value_counts() / 1400
    assert len(share) == 7 and (share - 3 / 7).abs().max() < .05


def test_null_location_and_histogram(spark):
    null = spark.createDataFrame([(float(i),) for i in range(100)], "sharpe double")
    real = spark.createDataFrame([(90.0,)], "sharpe double")
    loc = montecarlo.locate_in_null(null, real, ["sharpe"]).first()
    assert loc.percentile == 90.0 and loc.p_value == pytest.approx(11 / 101)
    h = montecarlo.histogram(null, "sharpe", 90.0).collect()
    assert sum(r.n for r in h) == 100 and sum(r.holds_real for r in h) == 1
    q = montecarlo.quantile_summary(null, ["sharpe"]).first()
    assert q.p50 == pytest.approx(49.5) and q.p5 == pytest.approx(np.quantile(range(100), .05))


def test_long_short_splits_ties_exactly(spark):
    rows = [(DATES[0], f"T{i:02d}", 1.0 if i < 15 else float(i), i / 100) for i in range(30)]
    got = evaluation.long_short(spark.createDataFrame(
        rows, "rebalance_date date, ticker string, score double, ret double"), .2).first()
    assert got.long_ret == pytest.approx(np.mean([i / 100 for i in range(24, 30)]))
    assert 0 <= got.short_ret <= .14


# ---- predictions -------------------------------------------------------------------------------

def _preds(spark, probs, actual):
    return spark.createDataFrame([("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(p), a)
                                  for i, (p, a) in enumerate(zip(probs, actual))],
                                 "ticker string, date date, prob_up double, actual int")


def test_brier_reliability_and_ece(spark):
    assert evaluation.prediction_summary(_preds(spark, [.8, .2, .6, .4], [1, 0, 1, 0])).first().brier == pytest.approx(.10)
    p = _preds(spark, [.9, .9, .9, .1, .1, .1], [1, 1, 0, 0, 0, 0])
    t = by(evaluation.reliability(p), "bin")
    assert t[9].n == 3 and t[9].frac_up == pytest.approx(2 / 3) and set(t) == {1, 9}
    want = .5 * abs(.9 - 2 / 3) + .5 * .1
    assert evaluation.calibration_error(p).first().ece == pytest.approx(want)


def test_bin_edges_are_the_binary_ones(spark):
    probs = [.1, .2, .3, .6, .7, .8, 1.0, 0.0]
    got = sorted((r.bin, r.n) for r in evaluation.reliability(_preds(spark, probs, [1] * 8)).collect())
    want = pd.Series(np.clip(np.digitize(probs, np.linspace(0, 1, 11)[1:-1]), 0, 9)).value_counts().sort_index()
    assert got == list(zip(want.index, want.values))


def test_selective_accuracy_keeps_the_confident(spark):
    p = _preds(spark, [.95, .05, .9, .1, .55, .45, .52, .48], [1, 0, 1, 0, 0, 1, 0, 1])
    t = by(evaluation.selective_accuracy(p), "coverage")
    assert t[1.0].accuracy == .5 and t[.4].n == 3 and t[.4].accuracy == 1.0
    assert t[.4].edge_vs_base == pytest.approx(.5)
    grouped = by(evaluation.selective_accuracy(p, ["ticker"]), "coverage")
    assert grouped[.4].accuracy == 1.0


def test_selective_accuracy_counts_tied_rows_exactly(spark):
    rng = np.random.default_rng(0)
    probs, actual = rng.choice([.2, .5, .8], 500), rng.integers(0, 2, 500)
    t = by(evaluation.selective_accuracy(_preds(spark, probs, actual.tolist())), "coverage")
    assert [t[c].n for c in (1.0, .8, .6, .4, .2)] == [500, 400, 300, 200, 100]
    hit = (probs >= .5).astype(int) == actual
    assert t[1.0].accuracy == pytest.approx(hit.mean())


def test_pooled_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    p, a = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    pos, neg = p[a == 1], p[a == 0]
    want = ((pos[:, None] > neg).sum() + .5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert evaluation.pooled_auc(_preds(spark, p, a.tolist())).first().auc == pytest.approx(want)
    assert evaluation.pooled_auc(_preds(spark, [.2, .3], [1, 1])).first().auc is None


def test_ablation_reports_both_variants(world):
    _, matrix, *_ = world
    got = books.ablation(matrix, "roe", lambda m: m.select("rebalance_date", "ticker"))
    assert {r[0] for r in got.select("variant").distinct().collect()} == {"with_roe", "without_roe"}
    only = books.ablation(matrix.drop("roe"), "roe", lambda m: m.select("ticker"))
    assert {r[0] for r in only.select("variant").distinct().collect()} == {"without_roe"}


def test_paired_reports_tell_what_a_column_adds(spark, world):
    bars, matrix, labels, *_ = world

    def score(m):  # quality where it is there, else the wrong way round
        return m.select("rebalance_date", "ticker", (F.col("roe") if "roe" in m.columns else F.ascii("ticker").cast("double")).alias("score"))

    config = books.SelectionConfig(top_n=1)
    got = by(books.paired_reports(books.ablation(matrix, "roe", score), "roe", labels, bars, config), "section", "key", "metric")
    alone = by(books.report_table(books.selection_report(score(matrix), labels, bars, config)), "section", "key", "metric")
    assert set(got) >= set(alone) and len(got) > 20
    for k, r in got.items():
        assert r.with_value == (alone[k].value if k in alone else None)
        assert r.difference == (r.with_value - r.without_value if None not in (r.with_value, r.without_value) else None)
    assert got["metrics", "strategy", "cumulative_return"].difference > 0
    assert got["metrics", "market", "cumulative_return"].difference == 0


@pytest.mark.parametrize("spread", [1.0, 1e-9])
def test_pooled_auc_of_bunched_probabilities(spark, spread):
    """Many distinct values within a billionth are cut like any others; a missing probability takes no part."""
    rng = np.random.default_rng(1)
    p, a = .5 + spread * (rng.random(4000) - .5), rng.integers(0, 2, 4000)
    pos, neg = p[a == 1], p[a == 0]
    want = ((pos[:, None] > neg).sum() + .5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    frame = _preds(spark, p, a.tolist())
    odd = frame.limit(5).withColumn("prob_up", F.lit(None).cast("double"))
    assert evaluation.pooled_auc(frame.unionByName(odd)).first().auc == pytest.approx(want, abs=1e-12)


def test_candidates_skip_the_first_dates(world):
    _, matrix, *_ = world
    assert selection.candidates(matrix, 3).select("rebalance_date").distinct().count() == 11
    assert features.feature_columns(matrix) == schemas.FEATURES
