"""Short-horizon direction forecasts: per stock, pooled, and the latest call."""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark import session
from tidemark.operators import folds, indicators, logistic
from tidemark.operators.folds import embargo_days
from tidemark.operators.models import CalibratedRanker, Ranker, training_stats

GBM_ITERATIONS = 200


def feature_names(panel: DataFrame) -> list[str]:
    return [c for c in indicators.DIRECTION_FEATURES if c in panel.columns]


def baseline_probability():
    """Momentum persistence: up if the 10-day momentum is positive."""
    return F.when(F.col("mom_10") > 0, 1.0).otherwise(0.0)


def complete_rows(panel: DataFrame) -> DataFrame:
    """Warm rows (every feature known) with their position in the ticker's history."""
    warm = panel.dropna(subset=feature_names(panel))
    return warm.withColumn("_i", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def per_stock_baseline(panel: DataFrame, step: int = 5, min_train: int = 120) -> DataFrame:
    """Baseline predictions at every ``step``-th warm row from ``min_train`` on."""
    rows = complete_rows(panel)
    return rows.where((F.col("_i") >= min_train) & ((F.col("_i") - min_train) % step == 0)
                      & F.col("label").isNotNull()).select(
        "ticker", "date", baseline_probability().alias("prob_up"), F.col("label").alias("actual"))


def per_stock_logistic(panel: DataFrame, horizon: int = 5, train: int = 252, step: int = 5,
                       min_train: int = 120) -> DataFrame:
    """Walk-forward logistic forecasts of each stock from its own history.

    A stock's rows (bounded by the calendar) form one group; Spark spreads the stocks. Training
    rows end ``horizon`` rows before the predicted one.
    """
    names = feature_names(panel)
    out = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()),
                        T.StructField("prob_up", T.DoubleType()), T.StructField("actual", T.IntegerType())])

    def ridge_logit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Coefficients (intercept last) minimising log-loss + |w|^2 / 2, by Newton steps."""
        a = np.hstack([x, np.ones((len(x), 1))])
        penalty = np.append(np.ones(x.shape[1]), 0.0)
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -35, 35)))
            hessian = (a.T * (p * (1 - p))) @ a + np.diag(penalty + 1e-12)
            move = np.linalg.solve(hessian, a.T @ (p - y) + penalty * w)
            w -= move
            if np.abs(move).max() < 1e-10:
                break
        return w

    def forecasts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x, y = pdf[names].to_numpy("float64"), pdf["label"].to_numpy("float64")
        got = []
        for i in range(min_train, len(pdf), step):
            hi = i - horizon
            lo = max(0, hi - train)
            if np.isnan(y[i]) or hi - lo < min_train:
                continue
            xs, ys = x[lo:hi], y[lo:hi]
            if ys.min() == ys.max():
                prob = float(ys[0])
            else:
                mean, std = xs.mean(axis=0), xs.std(axis=0)
                std[std == 0] = 1.0
                w = ridge_logit((xs - mean) / std, ys)
                prob = 1.0 / (1.0 + math.exp(-float(((x[i] - mean) / std) @ w[:-1] + w[-1])))
            got.append((pdf["ticker"].iat[0], pdf["date"].iat[i], prob, int(y[i])))
        return pd.DataFrame(got, columns=["ticker", "date", "prob_up", "actual"])

    return (complete_rows(panel).select("ticker", "date", "label", *names)
            .groupBy("ticker").applyInPandas(forecasts, out))


def sampled_dates(panel: DataFrame, step: int = 21, start=None) -> DataFrame:
    """Every ``step``-th distinct date of the panel from ``start``."""
    dates = panel.select("date").distinct()
    if start is not None:
        dates = dates.where(F.col("date") >= F.lit(str(start)).cast("date"))
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1
    return dates.withColumn("_k", k).where(F.col("_k") % step == 0).select("date")


def _model(kind: str, calibrate: bool, method: str, options: dict | None):
    options = dict(options or {})
    if kind == "gbm":
        options = {"maxIter": GBM_ITERATIONS, **options}
    return CalibratedRanker(kind, method, options) if calibrate else Ranker(kind, options)


def _training_rows(panel: DataFrame, names, day, horizon: int, years: int) -> DataFrame:
    d = F.lit(day).cast("date")
    return panel.where((F.col("date") <= F.date_sub(d, embargo_days(horizon)))
                       & (F.col("date") >= F.date_sub(d, int(365 * years)))).dropna(subset=[*names, "label"])


def pooled_walk_forward(panel: DataFrame, kind: str = "logistic", horizon: int = 5, step: int = 21, years: int = 3,
                        min_train: int = 200, start=None, calibrate: bool = True, method: str = "sigmoid",
                        options: dict | None = None, parallel: int = 8) -> DataFrame:
    """One model per sampled date on all stocks' rows of the trailing window, then a prediction for
    every stock on that date. Training sets of all dates are counted at once (``folds.pooled_spans``); only that row per
    date comes to the driver, and dates without enough rows or a second class are left out. Logistic models of all
    dates, and their calibration curves, are fitted together (``logistic``); for other kinds, isotonic steps or options of
    the estimator a few dates run at a time and each writes its predictions."""
    spark = panel.sparkSession
    names = feature_names(panel)
    staged = session.stage(panel.select("ticker", "date", "label", *names), "direction_panel")
    spans = folds.pooled_spans(staged, sampled_dates(staged, step, start), names, horizon, years)
    spans = spans.where((F.col("n_train") >= min_train) & F.col("n_positive").between(F.lit(1), F.col("n_train") - 1))
    spans = spans.orderBy("date").collect()
    if kind == "logistic" and not options and (method == "sigmoid" or not calibrate):
        return _together(staged, names, spans, calibrate)
    out = f"{session.run_dir(spark)}/direction-{uuid.uuid4().hex}"

    def one(k: int) -> bool:
        day, n = spans[k]["date"], spans[k]["n_train"]
        train = _training_rows(staged, names, day, horizon, years)
        stats = {"n": n, "ones": spans[k]["n_positive"], "seen": dict.fromkeys(names, n)}
        train = session.training_layout(train, ["ticker", "date"]).persist()
        try:
            fitted = _model(kind, calibrate, method, options).fit(train, names, stats)
            now = staged.where((F.col("date") == F.lit(day)) & F.col("label").isNotNull()).dropna(subset=names)
            (fitted.score(now).select("ticker", "date", F.col("score").alias("prob_up"), F.col("label").alias("actual"))
             .write.parquet(f"{out}/fold={k}"))
        finally:
            train.unpersist()
        return True

    with ThreadPoolExecutor(parallel) as pool:
        wrote = any(list(pool.map(one, range(len(spans)))))
    if not wrote:
        return spark.createDataFrame([], "ticker string, date date, prob_up double, actual int")
    return spark.read.parquet(out).select("ticker", "date", "prob_up", "actual")


def _together(panel: DataFrame, names: list[str], spans: list, calibrate: bool) -> DataFrame:
    """Predictions of the logistic models of all ``spans``; calibrated ones are the mean over parts, each model's curve fitted on
    the part it did not see."""
    parts = [max(2, min(3, s["n_positive"], s["n_train"] - s["n_positive"])) for s in spans]
    parts = [k if calibrate and min(s["n_positive"], s["n_train"] - s["n_positive"]) >= 2 else 1 for k, s in zip(parts, spans, strict=True)]
    each = [(s, k, part if k > 1 else -1) for s, k in zip(spans, parts, strict=True) for part in range(k)]
    models = logistic.Models(names, logistic.day_numbers([s["train_start"] for s, _, _ in each]),
                             logistic.day_numbers([s["train_end"] for s, _, _ in each]), np.array([k for _, k, _ in each]),
                             np.array([part for _, _, part in each]), np.zeros((len(each), len(names))))
    rows = logistic.training_rows(panel.dropna(subset=names), names)
    models = logistic.fit(rows, models)
    now = panel.where(F.col("label").isNotNull()).dropna(subset=names)
    scored = logistic.score(now, [s["date"] for s, _, _ in each], models, "date", logistic.fit_curves(rows, models))
    return scored.select("ticker", "date", F.col("score").alias("prob_up"), F.col("label").alias("actual"))


def latest_rows(panel: DataFrame, as_of=None) -> DataFrame:
    warm = panel.dropna(subset=feature_names(panel))
    return indicators.latest(warm if as_of is None else warm.where(F.col("date") <= F.lit(as_of).cast("date")))


def forecast_latest(panel: DataFrame, kind: str = "baseline", horizon: int = 5, years: int = 3, as_of=None,
                    calibrate: bool = False, method: str = "sigmoid", options: dict | None = None) -> DataFrame:
    """P(up) and direction at each stock's newest warm row up to ``as_of``, from the baseline or one pooled
    model. A model without a single training row, or with one class only, is an error."""
    last = latest_rows(panel, as_of)
    if kind == "baseline":
        scored = last.withColumn("prob_up", baseline_probability())
    else:
        names = feature_names(panel)
        day = as_of or panel.agg(F.max("date")).first()[0]
        train = _training_rows(panel, names, day, horizon, years)
        stats = training_stats(train, names)
        if stats["ones"] in (0, stats["n"]):
            raise ValueError("no training rows of both classes before the forecast")
        train = session.training_layout(train, ["ticker", "date"]).persist()
        try:
            fitted = _model(kind, calibrate, method, options).fit(train, names, stats)
        finally:
            train.unpersist()
        scored = fitted.score(last).withColumnRenamed("score", "prob_up")
    return scored.select("ticker", F.col("date").alias("as_of"), "prob_up",
                         F.when(F.col("prob_up") >= 0.5, "up").otherwise("down").alias("direction"))
