"""Per-ticker indicators as window functions.

All frames take daily bars with one row per (ticker, date), so a ticker's window is bounded by the
calendar. Everything is causal: a row depends on its own and earlier rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas
from tidemark.functions.ewm import Ewm, block_length, smooth, span_alpha, with_blocks
from tidemark.functions.numeric import full_window, safe_div



def by_date():
    """A ticker's rows in calendar order."""
    return Window.partitionBy("ticker").orderBy("date")


MACD = (12, 26, 9)
ADX_WINDOW = 14

# Fixed values: (look-back, skip) in trading days of the momentum features.
MOMENTUM_WINDOWS = {"mom_1m": (21, 0), "mom_3m": (63, 0), "mom_6m": (126, 0), "mom_12m": (252, 21)}
VOLATILITY_WINDOW = 21
REVERSAL_WINDOW = 5
HIGH_WINDOW = 252
INTRADAY_RETURNS = 78


def _trailing(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def rolling_mean(c: str, n: int) -> Column:
    return full_window(F.avg(c).over(_trailing(n)), F.count(c).over(_trailing(n)), n)


def rolling_std(c: str, n: int) -> Column:
    return full_window(F.stddev_samp(c).over(_trailing(n)), F.count(c).over(_trailing(n)), n)


def with_trailing_max(df: DataFrame, c: str, n: int, out: str, fan: int = 4) -> DataFrame:
    """Add the largest value of the last ``n`` rows. Maxima of 1, 4, 16, ... rows are each made of ``fan`` shifted ones of the step
    before, and the last step lets its shifts overlap: some 13 values a row for 252 rows, where a sliding frame looks at all 252."""
    done = 1
    df = df.withColumn(out, F.col(c))
    while done < n:
        covers = min(n, done * fan)
        shifts = sorted({min(k * done, covers - done) for k in range(1, fan)})
        df = df.withColumn(out, F.greatest(out, *[F.lag(out, k).over(by_date()) for k in shifts]))
        done = covers
    return df


def change(n: int = 1, skip: int = 0) -> Column:
    """Return from ``n`` rows ago to ``skip`` rows ago."""
    now = F.col("close") if skip == 0 else F.lag("close", skip).over(by_date())
    return safe_div(now, F.lag("close", n).over(by_date())) - 1


def add_moving_averages(bars: DataFrame, windows=(20, 50, 200)) -> DataFrame:
    schemas.require(bars, "close")
    return bars.select("*", *[rolling_mean("close", n).alias(f"sma{n}") for n in windows])


def add_returns(bars: DataFrame) -> DataFrame:
    schemas.require(bars, "close")
    return bars.withColumn("ret", change())


def _has_range(df: DataFrame) -> bool:
    return {"high", "low"} <= set(df.columns)


def _add_smoothed(bars: DataFrame, macd, adx: int | None) -> DataFrame:
    """MACD and ADX together, so that both share the windows and the sort."""
    schemas.require(bars, "close")
    adx = adx if _has_range(bars) else None
    alphas = [span_alpha(s) for s in macd] if macd else []
    if adx:
        alphas.append(1.0 / adx)
    df = with_blocks(bars, block_length(alphas))
    first: list[Ewm] = []
    second: list[Ewm] = []
    if macd:
        # Averages are linear, so the first close is taken off: a flat start gives an exact 0.
        df = df.withColumn("_centred", F.col("close") - F.first("close").over(
            by_date().rowsBetween(Window.unboundedPreceding, 0)))
        fast, slow, signal = (span_alpha(s) for s in macd)
        first += [Ewm("_fast", "_centred", fast), Ewm("_slow", "_centred", slow)]
        second.append(Ewm("macd_signal", "macd", signal))
    if adx:
        prev = F.lag("close").over(by_date())
        up = F.col("high") - F.lag("high").over(by_date())
        down = F.lag("low").over(by_date()) - F.col("low")
        df = df.select(
            "*",
            F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                       F.abs(F.col("low") - prev)).alias("_range"),
            F.when((up > down) & (up > 0), up).otherwise(0.0).alias("_up"),
            F.when((down > up) & (down > 0), down).otherwise(0.0).alias("_down"))
        first += [Ewm(f"_s{c}", c, 1.0 / adx, adx) for c in ("_range", "_up", "_down")]
        second.append(Ewm(f"adx{adx}", "_dx", 1.0 / adx, adx, gaps=True))
    df = smooth(df, first)
    if macd:
        df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    if adx:
        plus, minus = (100 * safe_div(c, "_s_range") for c in ("_s_up", "_s_down"))
        df = df.withColumn("plus_di", plus).withColumn("minus_di", minus)
        total = F.col("plus_di") + F.col("minus_di")
        df = df.withColumn("_dx", 100 * safe_div(F.abs(F.col("plus_di") - F.col("minus_di")), total))
    df = smooth(df, second)
    if adx:  # rounding may lift a mean of numbers up to 100 just above it
        df = df.withColumn(f"adx{adx}", F.when(
            F.col(f"adx{adx}").isNotNull(), F.least(F.col(f"adx{adx}"), F.lit(100.0))))
    keep = list(bars.columns)
    if macd:
        df = df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
        keep += ["macd", "macd_signal", "macd_hist"]
    if adx:
        keep += ["plus_di", "minus_di", f"adx{adx}"]
    return df.select(*keep)


def add_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return _add_smoothed(bars, (fast, slow, signal), None)


def add_adx(bars: DataFrame, window: int = ADX_WINDOW) -> DataFrame:
    """ADX, +DI and -DI; NULL columns when the bars have no high and low."""
    if not _has_range(bars):
        return _no_adx(bars, window)
    return _add_smoothed(bars, None, window)


def add_macd_adx(bars: DataFrame, macd=MACD, window: int = ADX_WINDOW) -> DataFrame:
    out = _add_smoothed(bars, macd, window)
    return out if _has_range(bars) else _no_adx(out, window)


def _no_adx(df: DataFrame, window: int) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select("*", none.alias("plus_di"), none.alias("minus_di"), none.alias(f"adx{window}"))


def cross_flag() -> Column:
    """Golden / death cross between the previous row and this one, from sma50 and sma200."""
    p50, p200 = F.lag("sma50").over(by_date()), F.lag("sma200").over(by_date())
    return (F.when((p50 <= p200) & (F.col("sma50") > F.col("sma200")), "golden_cross")
            .when((p50 >= p200) & (F.col("sma50") < F.col("sma200")), "death_cross")
            .otherwise("none"))


def add_cross_event(df: DataFrame) -> DataFrame:
    """The cross event as seen on each row; ``not_enough_data`` before two rows have both means."""
    schemas.require(df, "sma50", "sma200")
    both = F.when(F.col("sma50").isNotNull() & F.col("sma200").isNotNull(), 1)
    seen = F.count(both).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("cross_event", F.when(seen < 2, "not_enough_data").otherwise(cross_flag()))


def latest(df: DataFrame, date: str = "date") -> DataFrame:
    """The last row of each ticker, by aggregation."""
    rest = [c for c in df.columns if c != "ticker"]
    return (df.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.col(date)).alias("_row"))
            .select("ticker", *[F.col("_row")[c].alias(c) for c in rest]))


def latest_cross_event(df: DataFrame) -> DataFrame:
    return latest(add_cross_event(df).select("ticker", "date", "cross_event"))


def technical_frame(bars: DataFrame) -> DataFrame:
    """All technical features per (ticker, date). ``bars`` holds one row of each; ``load_prices`` with an
    ingest column sees to that."""
    keep = [c for c in ("high", "low") if c in bars.columns]
    base = bars.select("ticker", "date", *keep, "close").where(F.col("close").isNotNull())
    plain = base.select(
        "*", change().alias("_ret"),
        *[change(n, skip).alias(name) for name, (n, skip) in MOMENTUM_WINDOWS.items()],
        change(REVERSAL_WINDOW).alias("reversal_5d"))
    plain = with_trailing_max(plain, "close", HIGH_WINDOW, "_high").withColumn("high_52w", F.col("close") / F.col("_high")).drop("_high")
    risk = plain.withColumn("volatility", rolling_std("_ret", VOLATILITY_WINDOW))
    scaled = F.when(F.col("volatility") > 0, F.col("mom_12m") / F.col("volatility"))
    # Windows by date come first: the smoothed columns sort by (ticker, block, date).
    smoothed = add_macd_adx(risk.withColumn("mom_risk_adj", scaled))
    return smoothed.withColumnRenamed(f"adx{ADX_WINDOW}", "adx").select(
        "ticker", "date", "close", *schemas.TECHNICAL_FEATURES)


def intraday_stats(bars_5m: DataFrame, returns: int = INTRADAY_RETURNS) -> DataFrame:
    """Return over the intraday window and deviation of its last returns, both in percent. The
    input is folded bars, so a ticker holds a bounded number of rows."""
    w = Window.partitionBy("ticker").orderBy("bar_start")
    r = safe_div("close", F.lag("close").over(w)) - 1
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("bar_start").desc()))
    rows = bars_5m.select("ticker", "bar_start", "close", r.alias("_r"), back.alias("_back"))
    first, last = F.min_by("close", "bar_start"), F.max_by("close", "bar_start")
    return rows.groupBy("ticker").agg(
        last.alias("last_price"), F.max("bar_start").alias("last_bar"),
        (100 * (safe_div(last, first) - 1)).alias("intraday_return_percent"),
        (100 * F.stddev_samp(F.when(F.col("_back") <= returns, F.col("_r")))).alias("intraday_volatility_percent"))


def latest_quotes(bars_5m: DataFrame, daily: DataFrame) -> DataFrame:
    """Last intraday price against the previous daily close (the second last bar, or the only one)."""
    now = bars_5m.groupBy("ticker").agg(F.max_by("close", "bar_start").alias("latest_price"),
                                        F.max("bar_start").alias("as_of"))
    day = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    before = (daily.where(F.col("close").isNotNull()).withColumn("_rn", F.row_number().over(day))
              .where(F.col("_rn") <= 2).groupBy("ticker")
              .agg(F.max_by("close", "_rn").alias("previous_close")))
    change_ = F.when(F.col("previous_close") != 0, F.col("latest_price") - F.col("previous_close"))
    return (now.join(before, "ticker", "left").withColumn("change", change_)
            .withColumn("change_percent", 100 * safe_div("change", "previous_close")))


def snapshots(bars: DataFrame, basic: bool = False) -> DataFrame:
    """The indicator snapshot as of every bar. ``basic`` leaves out MACD, ADX and the SMA gap."""
    df = add_returns(add_moving_averages(bars))
    df = add_cross_event(df)
    none = F.lit(None).cast("double")
    if basic:
        df = df.select("*", *[none.alias(c) for c in ("macd", "macd_signal", "macd_hist", "plus_di", "minus_di",
                                                      "adx14", "_gap")])
    else:
        df = add_macd_adx(df).withColumn(
            "_gap", 100 * safe_div(F.col("sma50") - F.col("sma200"), "sma200"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return df.select(
        "ticker", "date", F.col("close").alias("latest_close"), F.lag("close").over(by_date()).alias("previous_close"),
        "sma20", "sma50", "sma200",
        *[yes(F.col("close") > F.col(f"sma{n}")).alias(f"close_above_sma{n}") for n in (20, 50, 200)],
        "cross_event", F.col("_gap").alias("sma_gap_percent"),
        F.col("macd").alias("macd_line"), "macd_signal", "macd_hist",
        yes(F.col("macd") > F.col("macd_signal")).alias("macd_bullish"),
        F.col("adx14").alias("adx"), "plus_di", "minus_di",
        yes(F.col("adx14") >= 25).alias("adx_trending"), yes(F.col("adx14") < 20).alias("adx_ranging"),
        F.count("*").over(by_date().rowsBetween(Window.unboundedPreceding, 0)).alias("n_bars"))


def latest_snapshot(bars: DataFrame, intraday: DataFrame | None = None, basic: bool = False) -> DataFrame:
    """One snapshot row per ticker, with the intraday fields when 5-minute bars are given."""
    snap = latest(snapshots(bars, basic))
    none = F.lit(None).cast("double")
    if intraday is None:
        return snap.select("*", none.alias("intraday_return_percent"), none.alias("intraday_volatility_percent"))
    stats = intraday_stats(intraday).select("ticker", "intraday_return_percent", "intraday_volatility_percent")
    return snap.join(stats, "ticker", "left")


DIRECTION_FEATURES = ["ret_1", "ret_2", "ret_3", "ret_5", "ret_10", "mom_10", "mom_20", "vol_10", "vol_20",
                      "macd_hist", "close_sma20", "close_sma50", "adx_14"]


def direction_features(bars: DataFrame) -> DataFrame:
    """Features of the short-horizon direction model; ``adx_14`` only when the bars have a range."""
    has_adx = _has_range(bars)
    base = bars.select("ticker", "date", *(["high", "low"] if has_adx else []), "close")
    lags = base.select("*", *[change(k).alias(f"ret_{k}") for k in (1, 2, 3, 5, 10)],
                       change(10).alias("mom_10"), change(20).alias("mom_20"),
                       *[(safe_div("close", rolling_mean("close", n)) - 1).alias(f"close_sma{n}") for n in (20, 50)])
    rolled = lags.select("*", *[rolling_std("ret_1", n).alias(f"vol_{n}") for n in (10, 20)])
    out = _add_smoothed(rolled, MACD, ADX_WINDOW)
    if has_adx:
        out = out.withColumnRenamed(f"adx{ADX_WINDOW}", "adx_14")
    return out.select("ticker", "date", "close", *[c for c in DIRECTION_FEATURES if has_adx or c != "adx_14"])


def direction_label(horizon: int) -> Column:
    """1 if the close ``horizon`` bars ahead is higher, NULL where it is not known yet."""
    if horizon < 1:
        raise ValueError("horizon must be >= 1")
    ahead = F.lead("close", horizon).over(by_date())
    return F.when(ahead.isNotNull() & F.col("close").isNotNull(),
                  (safe_div(ahead, "close") - 1 > 0).cast("int"))


def direction_panel(bars: DataFrame, horizon: int = 5) -> DataFrame:
    return direction_features(bars).withColumn("label", direction_label(horizon))
