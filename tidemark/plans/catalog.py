"""The registered queries: every operator on the driver's tables."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas, session
from tidemark.functions.numeric import rounded
from tidemark.operators import (asof, backtest, direction, evaluation, features, folds, fundamentals, indicators, metrics, models,
                                montecarlo, ranks, rules, selection, sentiment)
from tidemark.operators.selection import DATE
from tidemark.plans import books, walk_forward
from tidemark.sources import market_views as views, news, sinks, tables, ticker_files

AS_OF = "2000-01-31"
POSITIVE, NEGATIVE = ("purchase", "signup"), ("error",)
SURE, REST = 0.875, 0.125  # sums of these are exact in binary
CONFIG = books.SelectionConfig(market=views.MARKET)


class Market:
    """Lazy views of one data directory. What several branches of a query read is staged."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = session.prepare(spark), sf_dir

    @cached_property
    def tasks(self) -> int:
        """Partitions of bars by ticker."""
        return views.bar_tasks(self.spark, self.dir)

    @cached_property
    def raw(self) -> DataFrame:
        return views.bars(self.spark, self.dir, self.tasks)

    @cached_property
    def bars(self) -> DataFrame:
        """Total-return bars, staged by ticker, so that no branch shuffles them by ticker again."""
        return session.stage_bucketed(tables.load_prices(self.raw), "bars", "ticker", ["ticker", "date"], self.tasks, dealt=True)

    @cached_property
    def calendar(self) -> DataFrame:
        return session.stage(features.rebalance_calendar(self.bars), "calendar")

    @cached_property
    def fundamentals(self) -> DataFrame:
        return fundamentals.tidy(views.statements(self.spark, self.dir))

    @cached_property
    def sectors(self) -> DataFrame:
        return tables.load_sectors(views.sectors(self.spark, self.dir))

    @cached_property
    def matrix(self) -> DataFrame:
        return session.stage(features.feature_matrix(self.bars, self.fundamentals, self.calendar), "matrix")

    @cached_property
    def labels(self) -> DataFrame:
        returns = session.stage(features.forward_returns(self.bars, self.calendar), "forward")
        return session.stage(features.relative_labels(returns), "labels")

    @cached_property
    def scores(self) -> DataFrame:
        return session.stage(books.momentum_scores(self.bars, self.calendar), "scores")

    @cached_property
    def scored(self) -> DataFrame:
        return session.stage(evaluation.scored_labels(self.scores, self.labels), "scored")

    @cached_property
    def pairs(self) -> DataFrame:
        return session.stage(evaluation.scored_returns(self.scores, self.bars), "pairs")

    @cached_property
    def streams(self) -> DataFrame:
        return books.book_streams(self.scores, self.bars, CONFIG)

    @cached_property
    def headlines(self) -> DataFrame:
        return views.headlines(self.spark, self.dir)

    @cached_property
    def scored_headlines(self) -> DataFrame:
        return sentiment.scored_headlines(self.headlines, sentiment.lexicon_column(
            POSITIVE, NEGATIVE, sure=SURE, rest=REST))

    @cached_property
    def supplier_ticks(self) -> DataFrame:
        """Ticks of the tickers that have bars."""
        n = views.table(self.spark, self.dir, "supplier").agg(F.count("*")).scalar()
        user = F.substring("ticker", 2, 20).cast("bigint")
        return views.ticks(self.spark, self.dir).withColumn(
            "ticker", F.concat(F.lit("S"), (user % n).cast("string")))

    @cached_property
    def intraday(self) -> DataFrame:
        return tables.intraday_bars(self.supplier_ticks)

    @cached_property
    def panel(self) -> DataFrame:
        return indicators.direction_panel(self.raw)

    @cached_property
    def predictions(self) -> DataFrame:
        """Percentile of mom_20 inside each date as the probability; actual is the 5-day direction."""
        rows = session.stage(self.panel.where(F.col("mom_20").isNotNull() & F.col("label").isNotNull())
                             .select("ticker", "date", "mom_20", "label"), "panel")
        p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.round(F.col("avg_rank") / F.col("n"), 4)))
        return session.stage(ranks.ranked(rows, ["date"], "mom_20", ["ticker"]).select(
            "ticker", "date", p.alias("prob_up"), F.col("label").alias("actual")), "predictions")

    @cached_property
    def daily(self) -> DataFrame:
        return backtest.walk_forward_daily(self.raw)

    @cached_property
    def audited(self) -> DataFrame:
        return rules.audited_sentences(rules.recommendations(rules.month_end_snapshots(self.raw)))


REGISTRY: dict = {}


# Results of pure arithmetic on given numbers come out as they are.
EXACT = {"price_scan", "price_scan_tickers"}


def query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(Market(spark, sf_dir))
        return out if f.__name__ in EXACT else rounded(out)
    run.__name__, run.__doc__ = f.__name__, f.__doc__
    REGISTRY[f.__name__] = run
    return f


# ---- sources -----------------------------------------------------------------------------------

@query
def price_scan(m):
    return tables.load_prices(m.raw, start="1996-01-01", end="2000-12-31")


@query
def price_scan_tickers(m):
    wanted = m.sectors.where(F.col("sector") == "ASIA")
    return tables.load_prices(m.raw, wanted).select("ticker", "date", "close", "volume")


@query
def historical_bars(m):
    return tables.historical_bars(m.raw, months=24)


@query
def intraday_bars(m):
    return m.intraday


@query
def last_ingested_bar(m):
    """One price per (ticker, day) out of many quotes: the last one ingested."""
    quotes = views.table(m.spark, m.dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("ingest"))
    return tables.last_per_day(quotes, "ingest")


@query
def last_bars(m):
    return tables.last_rows(m.raw, 5).select("ticker", "date", "close")


@query
def history_status(m):
    return tables.history_status(m.raw, 530)


@query
def sector_scan(m):
    return m.sectors


@query
def news_payloads(m):
    return news.parse_payloads(views.news_payloads(m.spark, m.dir))


@query
def statement_items(m):
    return fundamentals.pick_items(views.statement_items(m.spark, m.dir))


@query
def fundamentals_tidy(m):
    return m.fundamentals


@query
def fundamentals_ttm(m):
    return fundamentals.with_ttm(m.fundamentals).select("ticker", "period_end", "ttm_net_income")


# ---- indicators --------------------------------------------------------------------------------

@query
def moving_averages(m):
    return indicators.add_returns(indicators.add_moving_averages(m.raw)).select(
        "ticker", "date", "sma20", "sma50", "sma200", "ret")


@query
def macd(m):
    return indicators.add_macd(m.raw).select("ticker", "date", "macd", "macd_signal", "macd_hist")


@query
def adx(m):
    return indicators.add_adx(m.raw).select("ticker", "date", "plus_di", "minus_di", "adx14")


@query
def cross_events(m):
    df = indicators.add_cross_event(indicators.add_moving_averages(m.raw))
    return df.where(F.col("cross_event") != "none").select("ticker", "date", "cross_event")


@query
def latest_cross_event(m):
    return indicators.latest_cross_event(indicators.add_moving_averages(m.raw))


@query
def deduplicated_technical_frame(m):
    """Each bar delivered twice, first with a wrong close: the later delivery counts."""
    late = m.raw.withColumn("delivered", F.lit(2))
    early = m.raw.withColumn("close", F.col("close") * 2).withColumn("delivered", F.lit(1))
    bars = tables.load_prices(early.unionByName(late), ingest="delivered")
    return indicators.technical_frame(bars.repartition(m.tasks, "ticker"))


@query
def technical_frame(m):
    return indicators.technical_frame(tables.load_prices(m.raw))


@query
def indicator_snapshot(m):
    return indicators.latest_snapshot(m.raw, m.intraday)


@query
def indicator_snapshot_basic(m):
    return indicators.latest_snapshot(m.raw, basic=True).select(
        "ticker", "date", "latest_close", "sma20", "sma50", "sma200", "close_above_sma20", "cross_event", "adx")


@query
def intraday_stats(m):
    return indicators.intraday_stats(m.intraday)


@query
def latest_quotes(m):
    return indicators.latest_quotes(m.intraday, m.raw)


@query
def direction_panel(m):
    return m.panel


# ---- rules -------------------------------------------------------------------------------------

@query
def rule_signals(m):
    return rules.rule_signals(m.raw).select("ticker", "date", "score", "raw_signal", "position")


@query
def recommendations(m):
    quotes = indicators.latest_quotes(m.intraday, m.raw).select("ticker", "change_percent")
    snap = indicators.latest_snapshot(m.raw, m.intraday).join(quotes, "ticker", "left")
    return rules.recommendations(snap).select(
        "ticker", "score", "signal", "risk_level", "trend_strength",
        F.array_join("reasons", " / ").alias("reasons"), F.array_join("warnings", " / ").alias("warnings"))


@query
def month_end_recommendations(m):
    return rules.recommendations(rules.month_end_snapshots(m.raw)).select(
        "ticker", "date", "score", "signal", "risk_level", F.size("reasons").alias("n_reasons"),
        F.size("warnings").alias("n_warnings"))


@query
def explanation_audit(m):
    return rules.audit_by_label(m.audited)


@query
def explanation_audit_totals(m):
    return rules.audit_totals(m.audited)


# ---- backtests ---------------------------------------------------------------------------------

@query
def backtest_summary(m):
    return backtest.summary(m.raw)


@query
def backtest_trades(m):
    return backtest.trades(backtest.daily_strategy(rules.rule_signals(m.raw)))


@query
def backtest_equity(m):
    return backtest.daily_strategy(rules.rule_signals(m.raw)).select(
        "ticker", "date", "market_return", "strategy_return", "strategy_equity", "buy_hold_equity", "drawdown")


@query
def walk_forward_folds(m):
    return backtest.walk_forward_folds(m.daily)


@query
def walk_forward_overall(m):
    return backtest.walk_forward_overall(m.daily)


@query
def walk_forward_means(m):
    return backtest.walk_forward_means(backtest.walk_forward_folds(m.daily))


@query
def walk_forward_overlapping(m):
    """Step shorter than the test window: days repeat across folds."""
    daily = backtest.walk_forward_daily(m.raw, train=126, test=63, step=21)
    return backtest.walk_forward_folds(daily).select(
        "ticker", "fold", "test_start", "test_end", "n_days", "n_trades", "strategy_cumulative_return")


@query
def metric_bundle(m):
    daily = indicators.add_returns(m.raw)
    return metrics.metric_bundle(daily, ["ticker"], "date", risk_free=0.02)


# ---- point-in-time matrix ----------------------------------------------------------------------

@query
def rebalance_calendar(m):
    return features.rebalance_calendar(m.raw)


@query
def price_on_date(m):
    return asof.price_at(m.bars, m.calendar, 0)


@query
def price_next_day(m):
    return asof.price_at(m.bars, m.calendar, 1)


@query
def feature_matrix(m):
    return features.feature_matrix(m.bars, m.fundamentals, m.calendar)


@query
def feature_matrix_sentiment(m):
    s = sentiment.sentiment_feature(m.scored_headlines, m.calendar, 40)
    return features.with_sentiment(m.matrix, s).select(DATE, "ticker", "mom_1m", "sentiment")


@query
def feature_coverage(m):
    return tables.coverage(m.matrix, schemas.FEATURES)


@query
def fundamental_coverage(m):
    return tables.fundamental_coverage(tables.coverage(m.matrix, schemas.FEATURES))


@query
def rank_normalised(m):
    return features.normalise(m.matrix, "rank")


@query
def zscore_normalised(m):
    return features.normalise(m.matrix, "zscore")


@query
def sector_rank_normalised(m):
    return features.normalise(m.matrix, "rank", sectors=m.sectors)


@query
def sector_zscore_normalised(m):
    return features.normalise(m.matrix, "zscore", columns=["mom_1m", "roe", "pb"], sectors=m.sectors).select(
        DATE, "ticker", "mom_1m", "roe", "pb")


@query
def forward_returns(m):
    return features.forward_returns(m.bars, m.calendar)


@query
def forward_returns_next_day(m):
    return features.forward_returns(m.bars, m.calendar, horizon_months=3, lag=1)


@query
def labels_median(m):
    return m.labels


@query
def labels_mean(m):
    return features.relative_labels(features.forward_returns(m.bars, m.calendar), "mean")


# ---- portfolio ---------------------------------------------------------------------------------

@query
def top_picks(m):
    return selection.equal_weights(selection.top_n(m.scores, 3))


@query
def latest_picks(m):
    return selection.latest_picks(session.stage(selection.equal_weights(selection.top_n(m.scores, 3)), "weights"))


@query
def turnover(m):
    return selection.turnover(session.stage(selection.equal_weights(selection.top_n(m.scores, 5)), "weights"))


@query
def candidates(m):
    return selection.candidates(features.feature_matrix(m.bars, None, m.calendar), 6)


@query
def portfolio_streams(m):
    return m.streams


@query
def portfolio_streams_next_day(m):
    return books.book_streams(m.scores, m.bars, books.SelectionConfig(top_n=5, lag=1, market=views.MARKET))


@query
def momentum_book(m):
    return books.book_metrics(session.stage(m.streams, "streams"))


@query
def average_turnover(m):
    return selection.average_turnover(m.streams)


# ---- evaluation --------------------------------------------------------------------------------

@query
def ranking_metrics(m):
    return evaluation.ranking_metrics(m.scored, 3)


@query
def auc_by_date(m):
    return evaluation.auc_by_date(m.scored)


@query
def precision_by_date(m):
    return evaluation.precision_by_date(m.scored, 5)


@query
def win_rate(m):
    return evaluation.win_rate(m.streams)


@query
def yearly_breakdown(m):
    return evaluation.yearly_breakdown(m.streams)


@query
def information_by_date(m):
    return evaluation.information_by_date(m.pairs)


@query
def information_summary(m):
    return evaluation.information_summary(evaluation.information_by_date(m.pairs))


@query
def long_short(m):
    return evaluation.long_short(m.pairs)


@query
def permutation_draws(m):
    return montecarlo.permutation_draws(m.scored, 3)


@query
def permutation_test(m):
    return montecarlo.permutation_test(montecarlo.permutation_draws(m.scored, 3))


@query
def bootstrap_auc(m):
    aucs = session.stage(evaluation.auc_by_date(m.scored), "aucs")
    return montecarlo.bootstrap_mean(aucs, "auc", DATE)


@query
def block_bootstrap(m):
    streams = session.stage(m.streams, "streams")
    return montecarlo.block_bootstrap(streams, "net", "entry_date")


@query
def plain_bootstrap(m):
    streams = session.stage(m.streams, "streams")
    return montecarlo.block_bootstrap(streams, "net", "entry_date", block=1)


@query
def sharpe_moments(m):
    return montecarlo.with_psr(montecarlo.sharpe_moments(m.streams), 0.0).drop("psr")


@query
def probabilistic_sharpe(m):
    return montecarlo.with_psr(montecarlo.sharpe_moments(m.streams), 0.0).select("n", "sharpe", "psr")


@query
def sensitivity_grid(m):
    return books.robustness(m.scores, m.labels, m.bars)["grid"]


@query
def deflated_sharpe(m):
    return books.robustness(m.scores, m.labels, m.bars)["deflated"]


@query
def deflated_sharpe_inputs(m):
    """Everything the deflated Sharpe is made of, without the normal distribution."""
    return books.robustness(m.scores, m.labels, m.bars)["deflated"].select(
        "n_trials", "n", "sr", "skew", "kurtosis", "trial_variance")


def _null(m):
    cells = selection.candidates(session.stage(
        features.feature_matrix(m.bars, None, m.calendar).select(*features.KEYS), "cells"), 13)
    periods = evaluation.holding_periods(m.scores)
    returns = session.stage(asof.period_returns(m.bars, periods).select(
        "ticker", "entry_date", "exit_date", "ret"), "returns")
    return montecarlo.random_null(cells, returns, 3)


@query
def random_null(m):
    return _null(m)


@query
def random_null_summary(m):
    return montecarlo.quantile_summary(_null(m), ["ann_return", "sharpe"])


@query
def located_in_null(m):
    null = session.stage(_null(m), "null")
    real = montecarlo.null_statistics(m.streams.withColumn("draw", F.lit(-1)))
    return montecarlo.locate_in_null(null, real, ["ann_return", "sharpe"])


@query
def null_histogram(m):
    draws = montecarlo.permutation_draws(m.scored, 3).where(F.col("draw") >= 0)
    return montecarlo.histogram(session.stage(draws, "draws"), "mean_auc")


# ---- direction ---------------------------------------------------------------------------------

@query
def direction_baseline(m):
    return direction.per_stock_baseline(m.panel)


@query
def direction_baseline_summary(m):
    return evaluation.prediction_summary(direction.per_stock_baseline(m.panel), ["ticker"])


@query
def direction_latest(m):
    return direction.forecast_latest(m.panel)


@query
def prediction_summary(m):
    return evaluation.prediction_summary(m.predictions)


@query
def prediction_auc(m):
    return evaluation.pooled_auc(m.predictions)


@query
def prediction_auc_by_ticker(m):
    return evaluation.pooled_auc(m.predictions, ["ticker"])


@query
def reliability(m):
    return evaluation.reliability(m.predictions)


@query
def calibration_error(m):
    return evaluation.calibration_error(m.predictions)


@query
def selective_accuracy(m):
    return evaluation.selective_accuracy(m.predictions)


# ---- sentiment ---------------------------------------------------------------------------------

@query
def headlines_in_window(m):
    return sentiment.headlines_in_window(m.headlines, m.calendar).select(DATE, "ticker", "published_at", "seq")


@query
def signed_scores(m):
    return m.scored_headlines.select("seq", "ticker", "signed")


@query
def softmax_scores(m):
    logits = F.array(F.col("value") / 20, F.lit(1.0), (F.col("event_id") % 7).cast("double"))
    names = {0: "positive", 1: "negative", 2: "neutral"}
    dist = sentiment.softmax_distribution("logits", names)
    e = views.table(m.spark, m.dir, "events").where(F.col("value").isNotNull())
    return e.select("event_id", logits.alias("logits")).withColumn("_d", dist).select(
        "event_id", sentiment.signed_score("_d").alias("signed"), F.col("_d")[2]["label"].alias("third_label"),
        F.col("_d")[2]["score"].alias("third_score"))


@query
def sentiment_feature(m):
    return sentiment.sentiment_feature(m.scored_headlines, m.calendar, 40)


@query
def ticker_sentiment(m):
    return sentiment.ticker_sentiment(m.scored_headlines, AS_OF)


@query
def newest_headlines(m):
    return sentiment.newest_headlines(m.scored_headlines, AS_OF).select(
        "ticker", "recency", "published_at", "text", "signed", "url", "seq")


@query
def market_mood(m):
    return sentiment.market_mood(sentiment.ticker_sentiment(m.scored_headlines, AS_OF))


@query
def classifier_scores(m):
    """The same lexicon as an injected Python classifier, fed Arrow batches."""
    def make():
        table, sure, rest = {"positive": POSITIVE, "negative": NEGATIVE}, SURE, REST

        def classify(texts):
            out = []
            for t in texts:
                side = next((k for k, words in table.items() if t in words), None)
                p, n, z = {"positive": (sure, rest, rest), "negative": (rest, sure, rest), None: (.1, .1, .8)}[side]
                out.append([{"label": "positive", "score": p}, {"label": "negative", "score": n},
                            {"label": "neutral", "score": z}])
            return out
        return classify
    dist = sentiment.scorer(make)("text")
    return sentiment.scored_headlines(m.headlines, dist).groupBy("ticker").agg(
        sentiment.mean_score().alias("sentiment"), F.count("*").alias("n_headlines"))


# ---- models ------------------------------------------------------------------------------------

@query
def walk_forward_logistic(m):
    ranked = session.stage(features.normalise(m.matrix, "rank"), "ranked")
    return walk_forward.walk_forward_scores(ranked, m.labels, "logistic", calendar=m.calendar)


@query
def per_stock_logistic(m):
    return direction.per_stock_logistic(m.panel)


# ---- streams -----------------------------------------------------------------------------------

def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it emitted, as a table."""
    spark = stream.sparkSession
    base = session.run_dir(spark)
    tag = uuid.uuid4().hex
    q = (stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
         .option("path", f"{base}/stream-{tag}").option("checkpointLocation", f"{base}/stream-{tag}-state").start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/stream-{tag}")


FILES = 4


def _as_stream(df: DataFrame, name: str, time: str, batches: int = 6) -> DataFrame:
    """A file stream over a staged copy of ``df`` that delivers it in the order of ``time``: one stretch of time
    after another is written, as FILES files, and a micro-batch takes so many."""
    staged = session.stage(df, name)
    shares = [i / batches for i in range(1, batches)]
    cuts = staged.agg(F.percentile_approx(time, F.array(*map(F.lit, shares)), F.lit(1000))).first()[0] or []
    path = f"{session.run_dir(df.sparkSession)}/{name}-stream-{uuid.uuid4().hex}"
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = staged if low is None else staged.where(F.col(time) > F.lit(low))
        part = part if high is None else part.where(F.col(time) <= F.lit(high))
        part.repartition(FILES).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


@query
def stream_bars(m):
    from tidemark.streaming.bars import closed_bars
    return _drain(closed_bars(_as_stream(views.ticks(m.spark, m.dir), "ticks", "ts")))


@query
def stream_sentiment(m):
    from tidemark.streaming.sentiment import trailing_sentiment
    return _drain(trailing_sentiment(_as_stream(m.scored_headlines, "headlines", "published_at")))


@query
def stream_sink(m):
    """Scored headlines through a sink keyed by batch, each batch delivered twice."""
    path = f"{session.run_dir(m.spark)}/sink-{uuid.uuid4().hex}"
    write = sinks.batch_sink(path)

    def twice(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        write(batch, batch_id)

    stream = _as_stream(m.scored_headlines, "headlines", "published_at")
    (stream.writeStream.foreachBatch(twice).trigger(availableNow=True)
     .option("checkpointLocation", f"{path}-state").start().awaitTermination())
    return sinks.read_batches(m.spark, path, stream.schema).groupBy("ticker").agg(
        F.count("*").alias("n_headlines"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"))


@query
def stream_positions(m):
    from tidemark.streaming.positions import held_positions
    scores = rules.rule_signals(m.raw).select("ticker", "date", "score")
    return _drain(held_positions(_as_stream(scores, "daily_scores", "date")))


# ---- model queries -----------------------------------------------------------------------------

def _ranked(m) -> DataFrame:
    return session.stage(features.normalise(m.matrix, "rank"), "ranked")


@query
def latest_scores_gbm(m):
    """Scores of the newest cross-section from the boosted ranker, with its default settings."""
    return walk_forward.latest_scores(_ranked(m), m.labels, "gbm")


@query
def latest_scores_rf(m):
    return walk_forward.latest_scores(_ranked(m), m.labels, "rf")


@query
def latest_scores_xgb(m):
    return walk_forward.latest_scores(_ranked(m), m.labels, "xgb")


@query
def selection_run_logistic(m):
    """The whole chain with a learned ranker: walk-forward scores, book, metrics."""
    scores = walk_forward.walk_forward_scores(_ranked(m), m.labels, "logistic", calendar=m.calendar)
    return books.book_metrics(session.stage(books.book_streams(scores, m.bars, CONFIG), "streams"))


@query
def selection_report(m):
    """All figures of the momentum book: metrics, ranking, years, turnover, information, long and short legs."""
    return books.report_table(books.selection_report(m.scores, m.labels, m.bars, CONFIG))


def _ablation(m) -> DataFrame:
    s = sentiment.sentiment_feature(m.scored_headlines, m.calendar, 40)
    matrix = session.stage(features.with_sentiment(_ranked(m), s), "with_sentiment")
    return books.ablation(matrix, "sentiment", lambda x: walk_forward.walk_forward_scores(
        x, m.labels, "logistic", calendar=m.calendar), lambda x: walk_forward.ablated_scores(
        x, m.labels, "sentiment", calendar=m.calendar))


@query
def sentiment_ablation(m):
    """Every date scored with and without the sentiment column."""
    return _ablation(m)


@query
def sentiment_ablation_report(m):
    """Both books' figures and their differences."""
    return books.paired_reports(_ablation(m), "sentiment", m.labels, m.bars, CONFIG)


@query
def pooled_direction(m):
    """Pooled calibrated forecasts at sampled dates, summarised."""
    got = direction.pooled_walk_forward(m.panel, "logistic")
    return evaluation.prediction_summary(got)


@query
def pooled_direction_latest(m):
    return direction.forecast_latest(session.stage(m.panel, "panel"), "logistic", calibrate=True)


@query
def training_spans(m):
    return walk_forward.training_spans(m.matrix, m.labels)


@query
def training_spans_expanding(m):
    """Folds that train on every date before theirs."""
    return walk_forward.training_spans(m.matrix, m.labels, train_window=None)


def _quarter_labels(m) -> DataFrame:
    returns = session.stage(features.forward_returns(m.bars, m.calendar, 3, 1), "forward")
    return session.stage(features.relative_labels(returns), "labels")


@query
def training_spans_quarter(m):
    """Labels of three months: the newest dates of a window are not known yet."""
    return walk_forward.training_spans(m.matrix, _quarter_labels(m), horizon_months=3)


@query
def training_spans_quarter_expanding(m):
    return walk_forward.training_spans(m.matrix, _quarter_labels(m), train_window=None, horizon_months=3)


@query
def fold_statistics(m):
    """Exact medians, and means and deviations after imputation, that the folds of a ranker use."""
    return walk_forward.fold_statistics(m.matrix, m.labels)


@query
def fold_statistics_quarter_expanding(m):
    return walk_forward.fold_statistics(m.matrix, _quarter_labels(m), ["roe", "mom_12m", "debt_to_equity"],
                                        train_window=None, horizon_months=3)


@query
def pooled_spans(m):
    """What the pooled direction model trains on at each prediction date."""
    panel = session.stage(m.panel, "panel")
    return folds.pooled_spans(panel, direction.sampled_dates(panel), direction.feature_names(panel))


# ---- sinks -------------------------------------------------------------------------------------

def _sink_path(m) -> str:
    return f"{session.run_dir(m.spark)}/sink-{uuid.uuid4().hex}"


@query
def bars_round_trip(m):
    """Bars delivered in two overlapping parts, the second one twice: stored once each."""
    path, bars = _sink_path(m), session.stage(m.raw, "raw")
    sinks.write_bars(bars.where("date < DATE '1996-07-01'").withColumn("close", F.col("close") + 1), path)
    for _ in range(2):
        sinks.merge_bars(bars.where("date < DATE '1995-01-01'"), path)
        sinks.merge_bars(bars.where("date >= DATE '1995-01-01'"), path)
    return sinks.read_bars(m.spark, path, bars.schema)


@query
def summary_csv_round_trip(m):
    path, table = _sink_path(m), session.stage(tables.history_status(m.raw, 530), "status")
    for _ in range(2):
        sinks.write_summary_csv(table, path)
    return m.spark.read.schema(table.schema).csv(path, header=True)


@query
def sectors_json_round_trip(m):
    path, table = _sink_path(m), session.stage(m.sectors, "sectors")
    for _ in range(2):
        sinks.write_json(table, path)
    return m.spark.read.schema(table.schema).json(path)


@query
def ticker_file_report(m):
    """Bars as one file per ticker, some with an unreadable date or close, read back: what each file holds."""
    path = _sink_path(m)
    day = F.dayofmonth("date")
    text = m.raw.select(*[F.col(c).cast("string").alias(c) for c in schemas.BARS.fieldNames()], day.alias("day"))
    text = text.withColumn("date", F.when(F.col("day") == 13, "no date").otherwise(F.col("date")))
    text = text.withColumn("close", F.when(F.col("day") == 21, "n/a").otherwise(F.col("close")))
    ticker_files.write_ticker_files(text, path, dealt=True)
    rows = ticker_files.price_rows(m.spark, path)
    good = ticker_files.bars_of(rows).groupBy("ticker").agg(
        F.count("close").alias("n_closes"), F.sum("close").alias("total_close"), F.min("date").alias("first_date"))
    return ticker_files.file_report(rows).drop("first_problem").join(good, "ticker", "left")


@query
def ticker_file_bars(m):
    """Two tickers out of a folder of one file per ticker: the filter opens only their files."""
    path = _sink_path(m)
    ticker_files.write_ticker_files(m.raw, path, dealt=True)
    rows = ticker_files.price_rows(m.spark, path)
    return ticker_files.bars_of(rows.where(F.col("ticker").isin("S1", "S7")))


# ---- calibration -------------------------------------------------------------------------------

def _levels(m) -> DataFrame:
    """Given scores in hundredths: what a calibrator of each part is fitted on."""
    rows = m.predictions.select("ticker", "date", (F.floor(F.col("prob_up") * 100) / 100).alias("score"), F.col("actual").alias("label"))
    return models.score_levels(models.with_part(rows, ["date", "ticker"], 3), ["part", "score"])


@query
def calibration_parts(m):
    """Rows and positives of the parts that calibrators are fitted on."""
    return _levels(m).groupBy("part").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.count("*").alias("n_levels"))


@query
def calibrated_isotonic(m):
    return models.calibrated_levels(_levels(m), 3, "isotonic")


@query
def calibrated_sigmoid(m):
    return models.calibrated_levels(_levels(m), 3, "sigmoid")


# ---- further checks ----------------------------------------------------------------------------

@query
def located_histogram(m):
    """Where the real mean AUC stands among those of permuted labels."""
    draws = session.stage(montecarlo.permutation_draws(m.scored, 3), "draws")
    return montecarlo.located_histogram(draws.where("draw >= 0"), "mean_auc", draws.where("draw < 0"))


@query
def aligned_positions(m):
    """Positions decided on every fifth day of a month, held on all trading days."""
    decided = rules.rule_signals(m.raw).where(F.dayofmonth("date") % 5 == 0).select("ticker", "date", "position")
    return metrics.align_positions(m.raw.select("ticker", "date", "close"), decided, ["ticker"])


@query
def timestamps_in_utc(m):
    """Event times written with offsets of several zones, and some that cannot be read, by day in UTC."""
    offset = F.element_at(F.array(F.lit("+00:00"), F.lit("+05:30"), F.lit("-08:00")), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.when(F.col("event_id") % 50 == 7, "no time").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), offset))
    told = views.table(m.spark, m.dir, "events").select("event_id", text.alias("text"))
    return told.select(tables.utc_date("text").alias("date"), tables.utc_timestamp("text").alias("at")).groupBy("date").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
