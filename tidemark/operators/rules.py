"""The rule signal, the recommendation built from a snapshot, and the audit of its sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import sign_of
from tidemark.operators import indicators

by_date = indicators.by_date

# Thresholds of trend strength (ADX) and crossover strength (gap in percent).
ADX_WEAK, ADX_STRONG, ADX_VERY_STRONG = 20, 25, 40
GAP_MODERATE, GAP_STRONG = 2.0, 5.0

# The sentences of a recommendation. %s stands for an inserted value.
TEXT = {
    "sma20_above": "The latest price is above the 20-day moving average, suggesting short-term strength.",
    "sma20_below": "The latest price is below the 20-day moving average, suggesting short-term weakness.",
    "sma50_above": "The latest price is above the 50-day moving average, supporting a positive medium-term trend.",
    "sma50_below": "The latest price is below the 50-day moving average, suggesting medium-term caution.",
    "sma200_above": "The latest price is above the 200-day moving average, indicating a stronger long-term trend.",
    "sma200_below": "The latest price is below the 200-day moving average, indicating long-term weakness.",
    "gap": " The SMA50/SMA200 gap is about %s%%, indicating a %s signal.",
    "golden_strong": "A strong Golden Cross was detected: SMA50 crossed decisively above SMA200.",
    "golden_moderate": "A Golden Cross was detected, where SMA50 crossed above SMA200.",
    "golden_marginal": "A marginal Golden Cross was detected: SMA50 only just crossed above SMA200, "
                       "so treat this bullish signal with some caution.",
    "death_strong": "A strong Death Cross was detected: SMA50 crossed decisively below SMA200.",
    "death_moderate": "A Death Cross was detected, where SMA50 crossed below SMA200.",
    "death_marginal": "A marginal Death Cross was detected: SMA50 only just crossed below SMA200, "
                      "so this bearish signal is weak.",
    "macd_up_hist": "MACD is above its signal line with a positive histogram, confirming bullish momentum.",
    "macd_up": "MACD is above its signal line, suggesting momentum is turning bullish.",
    "macd_down_hist": "MACD is below its signal line with a negative histogram, confirming bearish momentum.",
    "macd_down": "MACD is below its signal line, suggesting momentum is turning bearish.",
    "intraday_up": "Recent intraday movement is positive at approximately %s%%.",
    "intraday_down": "Recent intraday movement is negative at approximately %s%%.",
    "adx_amplify": "ADX is high at about %s (%s trend), amplifying the %s signal — "
                   "the move has conviction behind it.",
    "adx_balanced": "ADX is high at about %s (%s trend), but the other indicators are balanced, "
                    "so there is no clear direction for it to confirm.",
    "adx_weak": "ADX is low at about %s (weak / range-bound), so the move lacks conviction "
                "and the trend signals are less reliable here.",
    "adx_moderate": "ADX is moderate at about %s, a developing rather than a strong trend.",
    "warn_di": "ADX confirms a strong trend, but its direction (+DI vs -DI) disagrees with "
               "the other indicators, so the signal is less certain.",
    "warn_move": "The stock has moved more than 3% from the previous close, so short-term volatility may be high.",
    "warn_intraday": "Intraday volatility appears high, so the recommendation should be treated carefully.",
    "warn_history": "There is not enough data to detect long-term moving-average crossover events reliably.",
    "warn_range": "ADX indicates a weak / range-bound market, so trend-following signals carry extra risk.",
    "disclaimer": "This output is for educational and decision-support purposes only. "
                  "It is not guaranteed financial advice and should not be used as the only basis for "
                  "trading decisions.",
}


# ---- backtest signal ---------------------------------------------------------------------------

def add_rule_score(df: DataFrame) -> DataFrame:
    """Score, raw signal and held position per bar. ``df`` needs sma20/50/200, MACD and ADX."""
    c = F.col
    cross = indicators.cross_flag()
    directional = (
        sign_of(c("close") > c("sma20"), c("close") < c("sma20"))
        + sign_of(c("close") > c("sma50"), c("close") < c("sma50"))
        + sign_of(c("close") > c("sma200"), c("close") < c("sma200"))
        + sign_of(cross == "golden_cross", cross == "death_cross", 2)
        + sign_of(c("macd") > c("macd_signal"), c("macd") < c("macd_signal")))
    df = df.withColumn("_dir", directional)
    lean = F.signum("_dir")
    amplified = (c("_dir") + F.when(c("adx14") >= ADX_STRONG, lean).otherwise(0)
                 + F.when(c("adx14") >= ADX_VERY_STRONG, lean).otherwise(0))
    damped = F.when(c("adx14") < ADX_WEAK, amplified / 2).otherwise(amplified)
    return df.withColumn("score", F.bround(damped).cast("int")).drop("_dir")


def add_position(df: DataFrame) -> DataFrame:
    """Buy at >= 3, sell at <= -3, otherwise keep the last decision; in cash at the start."""
    raw = F.when(F.col("score") >= 3, "Buy").when(F.col("score") <= -3, "Sell").otherwise("Hold")
    decided = F.when(F.col("raw_signal") == "Buy", 1).when(F.col("raw_signal") == "Sell", 0)
    held = F.last(decided, ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("raw_signal", raw).withColumn("position", F.coalesce(held, F.lit(0)))


def rule_signals(bars: DataFrame) -> DataFrame:
    """Bars -> indicators -> score, signal and position; the default position function."""
    return add_position(add_rule_score(indicators.add_macd_adx(indicators.add_moving_averages(bars))))


# ---- recommendation ----------------------------------------------------------------------------

def fixed(c, digits: int) -> Column:
    """``digits`` decimals, ties to even, keeping the sign of a value that rounds to zero."""
    c = F.col(c) if isinstance(c, str) else c
    body = F.format_string(f"%.{digits}f", F.bround(F.abs(c), digits))
    return F.when(c < 0, F.concat(F.lit("-"), body)).otherwise(body)


def trend_strength(adx="adx") -> Column:
    a = F.col(adx) if isinstance(adx, str) else adx
    return (F.when(a.isNull(), "unknown").when(a >= ADX_VERY_STRONG, "very strong")
            .when(a >= ADX_STRONG, "strong").when(a >= ADX_WEAK, "moderate").otherwise("weak"))


def crossover_strength(gap="sma_gap_percent") -> Column:
    g = F.abs(F.col(gap) if isinstance(gap, str) else gap)
    return (F.when(g >= GAP_STRONG, "strong").when(g >= GAP_MODERATE, "moderate")
            .when(g.isNotNull(), "marginal").otherwise("moderate"))


def recommendations(snapshot: DataFrame) -> DataFrame:
    """Score, signal, risk, reasons and warnings from snapshot rows.

    Uses ``change_percent`` and the intraday fields when they are there. Unlike the backtest
    score, a missing moving average counts as "below" and crosses are scaled by their gap.
    """
    c = F.col
    none = F.lit(None).cast("double")
    optional = [x for x in ("change_percent", "intraday_return_percent", "intraday_volatility_percent")
                if x not in snapshot.columns]
    df = snapshot.select("*", *[none.alias(x) for x in optional])
    df = df.withColumn("_cross", crossover_strength()).withColumn("trend_strength", trend_strength())
    golden, death = c("cross_event") == "golden_cross", c("cross_event") == "death_cross"
    size = F.when(c("_cross") == "strong", 3).when(c("_cross") == "moderate", 2).otherwise(1)
    has_macd = c("macd_line").isNotNull() & c("macd_hist").isNotNull()
    move = c("intraday_return_percent")
    before = (
        sum((F.when(c(f"close_above_sma{n}"), 1).otherwise(-1) for n in (20, 50, 200)), F.lit(0))
        + F.when(golden, size).when(death, -size).otherwise(0)
        + F.when(has_macd, F.when(c("macd_bullish"), 1).otherwise(-1)).otherwise(0)
        + F.when(move > 1, 1).when(move < -1, -1).otherwise(0))
    df = df.withColumn("_before", before).withColumn("_lean", F.signum("_before").cast("int"))
    high = c("trend_strength").isin("strong", "very strong")
    boost = F.when(c("trend_strength") == "very strong", 2).when(high, 1).otherwise(0)
    df = df.withColumn("score", (c("_before") + boost * c("_lean")).cast("int"))

    t = {k: F.lit(v) for k, v in TEXT.items()}
    gap = F.when(c("sma_gap_percent").isNotNull(),
                 F.format_string(TEXT["gap"], fixed("sma_gap_percent", 2), c("_cross"))).otherwise("")
    crossed = lambda kind: F.concat(
        F.when(c("_cross") == "strong", t[f"{kind}_strong"])
        .when(c("_cross") == "marginal", t[f"{kind}_marginal"]).otherwise(t[f"{kind}_moderate"]), gap)
    adx = fixed("adx", 0)
    reasons = F.array(
        *[F.when(c(f"close_above_sma{n}"), t[f"sma{n}_above"]).otherwise(t[f"sma{n}_below"]) for n in (20, 50, 200)],
        F.when(golden, crossed("golden")).when(death, crossed("death")),
        F.when(has_macd & c("macd_bullish"),
               F.when(c("macd_hist") > 0, t["macd_up_hist"]).otherwise(t["macd_up"]))
        .when(has_macd, F.when(c("macd_hist") < 0, t["macd_down_hist"]).otherwise(t["macd_down"])),
        F.when(move > 1, F.format_string(TEXT["intraday_up"], fixed(move, 2)))
        .when(move < -1, F.format_string(TEXT["intraday_down"], fixed(move, 2))),
        F.when(high & (c("_lean") != 0), F.format_string(
            TEXT["adx_amplify"], adx, c("trend_strength"),
            F.when(c("_lean") > 0, "bullish").otherwise("bearish")))
        .when(high, F.format_string(TEXT["adx_balanced"], adx, c("trend_strength")))
        .when(c("trend_strength") == "weak", F.format_string(TEXT["adx_weak"], adx))
        .when(c("trend_strength") == "moderate", F.format_string(TEXT["adx_moderate"], adx)))

    risks = {
        "warn_move": F.abs("change_percent") > 3,
        "warn_intraday": c("intraday_volatility_percent") > 0.8,
        "warn_history": c("cross_event") == "not_enough_data",
        "warn_range": c("adx_ranging"),
    }
    di_side = F.when(c("plus_di") > c("minus_di"), 1).otherwise(-1)
    disagrees = (high & (c("_lean") != 0) & c("plus_di").isNotNull() & c("minus_di").isNotNull()
                 & (di_side != c("_lean")))
    warnings = F.array(F.when(disagrees, t["warn_di"]), *[F.when(cond, t[k]) for k, cond in risks.items()])
    n_risks = sum((F.when(cond, 1).otherwise(0) for cond in risks.values()), F.lit(0))
    risk = F.when(n_risks >= 2, "High").when(n_risks == 1, "Medium").otherwise("Low")
    signal = (F.when(c("score") >= 3, F.when(c("risk_level") == "High", "Watch with caution").otherwise("Watch / Buy"))
              .when(c("score") >= 1, "Hold / Watch").when(c("score") <= -3, "Sell / Avoid").otherwise("Hold"))
    return (df.withColumn("reasons", F.array_compact(reasons))
            .withColumn("warnings", F.array_compact(warnings))
            .withColumn("risk_level", risk).withColumn("signal", signal)
            .withColumn("disclaimer", t["disclaimer"])
            .drop("_cross", "_before", "_lean", *optional))


# ---- audit -------------------------------------------------------------------------------------

# Tolerances between a stated (rounded) number and the indicator.
TOLERANCE_WHOLE, TOLERANCE_CENTS = 0.55, 0.05


def month_end_snapshots(bars: DataFrame, last_months: int = 24, min_bars: int = 220) -> DataFrame:
    """Snapshots at each ticker's last bar of a month, for its last ``last_months`` months."""
    month = F.trunc("date", "month")
    newest = Window.partitionBy("ticker", month).orderBy(F.col("date").desc())
    by_month = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    snap = indicators.snapshots(bars)
    return (snap.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") == 1)
            .withColumn("_m", F.row_number().over(by_month)).where(F.col("_m") <= last_months)
            .where(F.col("n_bars") >= min_bars)
            .withColumn("change_percent", 100 * (F.try_divide("latest_close", "previous_close") - 1))
            .drop("_rn", "_m"))


def audited_sentences(recommended: DataFrame) -> DataFrame:
    """One row per emitted sentence with the claim it makes (``label``) and whether it holds.

    The claim is read back from the words and checked against the indicator values, not against
    the rules that wrote the sentence.
    """
    c = F.col
    s = c("sentence")
    rows = recommended.select("*", F.posexplode("reasons").alias("position", "sentence"))
    stated = lambda pattern: F.regexp_extract(s, pattern, 1).try_cast("double")
    claim = F.struct

    def made(label, ok):
        lab = F.lit(label) if isinstance(label, str) else label
        return claim(F.lit(True).alias("matched"), F.coalesce(ok, F.lit(False)).alias("ok"), lab.alias("label"))

    out = None

    def rule(cond, value):
        nonlocal out
        out = F.when(cond, value) if out is None else out.when(cond, value)

    for n in (20, 50, 200):
        mentions = s.contains(f"{n}-day moving average") & ~s.contains("SMA")
        gone = c("latest_close").isNull() | c(f"sma{n}").isNull()
        rule(mentions & gone, made(f"sma{n}_missing_value", F.lit(False)))
        rule(mentions & s.contains("above"), made(f"sma{n}_above", c("latest_close") > c(f"sma{n}")))
        rule(mentions & s.contains("below"), made(f"sma{n}_below", c("latest_close") < c(f"sma{n}")))
    rule(s.contains("Golden Cross"), made("golden_cross", F.lower("cross_event").startswith("golden")))
    rule(s.contains("Death Cross"), made("death_cross", F.lower("cross_event").startswith("death")))
    gap = stated(r"gap is about ([-\d.]+)%")
    rule(s.contains("SMA50/SMA200 gap") & (gap.isNull() | c("sma_gap_percent").isNull()),
         made("gap_missing_value", F.lit(False)))
    rule(s.contains("SMA50/SMA200 gap"),
         made("sma_gap_value", F.abs(F.abs("sma_gap_percent") - F.abs(gap)) <= TOLERANCE_CENTS))
    rule(s.contains("MACD is above its signal line"), made(
        "macd_above", (c("macd_line") > c("macd_signal"))
        & (~s.contains("positive histogram") | (F.coalesce("macd_hist", F.lit(0.0)) > 0))))
    rule(s.contains("MACD is below its signal line"), made(
        "macd_below", (c("macd_line") < c("macd_signal"))
        & (~s.contains("negative histogram") | (F.coalesce("macd_hist", F.lit(0.0)) < 0))))
    level = stated(r"about (\d+(?:\.\d+)?)")
    strength = trend_strength()
    band = (F.when(s.contains("high at about"), strength.isin("strong", "very strong")
                   & s.contains(F.concat(F.lit("("), strength, F.lit(" trend)"))))
            .when(s.contains("low at about"), strength == "weak").otherwise(strength == "moderate"))
    rule(s.startswith("ADX is") & (level.isNull() | c("adx").isNull()), made("adx_missing_value", F.lit(False)))
    rule(s.startswith("ADX is"),
         made("adx_band_and_value", (F.abs(c("adx") - level) <= TOLERANCE_WHOLE) & band))
    moved = stated(r"approximately ([-\d.]+)%")
    if "intraday_return_percent" in recommended.columns:
        actual = c("intraday_return_percent")
        rule(s.contains("intraday movement") & (moved.isNull() | actual.isNull()),
             made("intraday_missing_value", F.lit(False)))
        rule(s.contains("intraday movement"), made(
            "intraday_value", ((actual > 0) == s.contains("positive")) & (F.abs(actual - moved) <= TOLERANCE_CENTS)))
    else:
        rule(s.contains("intraday movement"), made("intraday_missing_value", F.lit(False)))
    verdict = out.otherwise(claim(F.lit(False).alias("matched"), F.lit(False).alias("ok"),
                                  F.lit("UNMATCHED").alias("label")))
    return (rows.withColumn("_v", verdict)
            .select("ticker", "date", "position", "sentence", "_v.matched", "_v.ok", "_v.label"))


def audit_by_label(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy("label").agg(
        F.count("*").alias("n_sentences"), F.count_if("matched").alias("n_checkable"),
        F.count_if("ok").alias("n_correct"))


def audit_totals(sentences: DataFrame) -> DataFrame:
    n, m, ok = F.count("*"), F.count_if("matched"), F.count_if("ok")
    first = F.col("position") == 0
    return sentences.agg(
        F.count_if(first).alias("n_recommendations"), n.alias("n_sentences"), m.alias("n_checkable"),
        F.coalesce(F.try_divide(m, n), F.lit(0.0)).alias("coverage"), ok.alias("n_correct"),
        F.coalesce(F.try_divide(ok, m), F.lit(0.0)).alias("accuracy"))


def audit_violations(sentences: DataFrame) -> DataFrame:
    return sentences.where(F.col("matched") & ~F.col("ok")).select("ticker", "date", "label", "sentence")


def unmatched_examples(sentences: DataFrame, n: int | None = None) -> DataFrame:
    """Sentences without a checkable claim and how often they occur; the ``n`` most common if asked for."""
    found = sentences.where(~F.col("matched")).groupBy("sentence").count()
    return found if n is None else found.orderBy(F.col("count").desc(), "sentence").limit(n)
