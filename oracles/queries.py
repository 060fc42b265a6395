"""One SQL text per registered query."""

from oracles.views import W, build, change, draw, lag, mean

ORACLES: dict[str, str] = {}


def oracle(name, sql, needs="", doubles=""):
    """Doubles are rounded as the queries round them, and a rounded minus zero is zero."""
    cols = doubles.split()
    if cols:
        fixed = ", ".join(f"CASE WHEN round({c}, 6) = 0 THEN 0.0::DOUBLE ELSE round({c}, 6) END AS {c}" for c in cols)
        sql = f"SELECT * REPLACE ({fixed}) FROM ({sql})"
    ORACLES[name] = build(sql, *needs.split())


OHLC = "open high low close adj_close"
FUND = ("net_income total_revenue total_equity total_debt shares_outstanding ttm_net_income roe net_margin "
        "debt_to_equity earnings_growth_yoy")
TECH = "mom_1m mom_3m mom_6m mom_12m reversal_5d mom_risk_adj high_52w volatility macd adx"
FEATS = TECH + " pe pb roe earnings_growth net_margin debt_to_equity"

# ---- sources ----
oracle("price_scan", "SELECT * FROM adj WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", "adj")
oracle("price_scan_tickers", """SELECT ticker, date, close, volume FROM adj
       WHERE ticker IN (SELECT ticker FROM sector_of WHERE sector = 'ASIA')""", "adj sector_of")
oracle("historical_bars", """SELECT * FROM bars WHERE date > (SELECT max(date) FROM bars) - INTERVAL 24 MONTHS""",
       "bars", OHLC)
oracle("intraday_bars", "SELECT * FROM bars5", "bars5", "open high low close")
oracle("last_ingested_bar", """
    SELECT concat('S', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date,
           arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close
    FROM lineitem GROUP BY ALL""", "", "close")
oracle("last_bars", """SELECT ticker, date, close FROM bars
       QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 5""", "bars", "close")
oracle("history_status", """
    SELECT ticker, count(close) AS n_bars, min(date) AS first_date, max(date) AS last_date,
           CASE WHEN count(close) >= 530 THEN 'OK'
                ELSE 'ERROR: need at least 530 rows, got ' || count(close) END AS status
    FROM bars GROUP BY ticker""", "bars")
oracle("sector_scan", "SELECT * FROM sector_of", "sector_of")
oracle("news_payloads", """
    SELECT event_id AS seq, concat('U', user_id) AS ticker, date_trunc('second', ts) AS published_at,
           event_type AS text, 'provider' AS source, 'https://news.example/' || event_id AS url FROM events""")
oracle("statement_items", """
    SELECT ticker, period_end, freq,
           CASE WHEN freq = 'quarterly' AND quarter(period_end) % 2 = 0 THEN net_income
                WHEN freq = 'quarterly' THEN net_income - 1
                ELSE net_income END AS net_income,
           CASE WHEN freq = 'annual' OR quarter(period_end) % 2 = 0 THEN total_revenue END AS total_revenue,
           total_equity,
           CASE WHEN freq = 'annual' OR quarter(period_end) % 2 = 1 THEN total_debt END AS total_debt,
           NULL::DOUBLE AS shares_outstanding FROM statements""", "statements",
       "net_income total_revenue total_equity total_debt shares_outstanding")
oracle("fundamentals_tidy", "SELECT * FROM fundamentals", "fundamentals", FUND)
oracle("fundamentals_ttm", "SELECT ticker, period_end, ttm_net_income FROM filings", "filings", "ttm_net_income")

# ---- indicators ----
oracle("moving_averages", f"SELECT ticker, date, sma20, sma50, sma200, {change(1)} AS ret FROM sma", "sma",
       "sma20 sma50 sma200 ret")
oracle("macd", "SELECT ticker, date, macd, macd_signal, macd_hist FROM bars_ema", "bars_ema",
       "macd macd_signal macd_hist")
oracle("adx", "SELECT ticker, date, plus_di, minus_di, adx14 FROM bars_ema", "bars_ema", "plus_di minus_di adx14")
CROSS = "CASE WHEN seen200 < 2 THEN 'not_enough_data' ELSE flag END AS cross_event"
oracle("cross_events", f"SELECT * FROM (SELECT ticker, date, {CROSS} FROM crossed) WHERE cross_event <> 'none'", "crossed")
oracle("latest_cross_event", f"""SELECT ticker, date, {CROSS} FROM crossed
       QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""", "crossed")
oracle("technical_frame", "SELECT * FROM tech", "tech", "close " + TECH)
SNAP = ("latest_close previous_close sma20 sma50 sma200 sma_gap_percent macd_line macd_signal macd_hist adx plus_di "
        "minus_di intraday_return_percent intraday_volatility_percent")
oracle("indicator_snapshot", "SELECT * FROM latest", "latest", SNAP)
oracle("indicator_snapshot_basic", """
    SELECT ticker, date, latest_close, sma20, sma50, sma200, close_above_sma20, cross_event, NULL::DOUBLE AS adx
    FROM snap QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""", "snap",
       "latest_close sma20 sma50 sma200 adx")
oracle("intraday_stats", "SELECT * FROM intraday", "intraday",
       "last_price intraday_return_percent intraday_volatility_percent")
oracle("latest_quotes", "SELECT * FROM quotes", "quotes", "latest_price previous_close change change_percent")
oracle("direction_panel", "SELECT * FROM panel", "panel",
       "close ret_1 ret_2 ret_3 ret_5 ret_10 mom_10 mom_20 vol_10 vol_20 macd_hist close_sma20 close_sma50 adx_14")

# ---- rules ----
oracle("rule_signals", "SELECT ticker, date, score, raw_signal, position FROM signals", "signals")


def recommended(src, texts):
    """Score, risk and signal from snapshot rows, and the sentences as text."""
    adx_text = "(CASE WHEN adx >= 40 THEN 'very strong' ELSE 'strong' END)"
    gap = """CASE WHEN sma_gap_percent IS NULL THEN '' ELSE printf(
        ' The SMA50/SMA200 gap is about %.2f%%, indicating a %s signal.', sma_gap_percent, gap) END"""
    reasons = f"""concat_ws(' / ',
      CASE WHEN close_above_sma20 THEN 'The latest price is above the 20-day moving average, suggesting short-term strength.'
           ELSE 'The latest price is below the 20-day moving average, suggesting short-term weakness.' END,
      CASE WHEN close_above_sma50 THEN 'The latest price is above the 50-day moving average, supporting a positive medium-term trend.'
           ELSE 'The latest price is below the 50-day moving average, suggesting medium-term caution.' END,
      CASE WHEN close_above_sma200 THEN 'The latest price is above the 200-day moving average, indicating a stronger long-term trend.'
           ELSE 'The latest price is below the 200-day moving average, indicating long-term weakness.' END,
      CASE WHEN cross_event = 'golden_cross' THEN (CASE gap
             WHEN 'strong' THEN 'A strong Golden Cross was detected: SMA50 crossed decisively above SMA200.'
             WHEN 'marginal' THEN 'A marginal Golden Cross was detected: SMA50 only just crossed above SMA200, so treat this bullish signal with some caution.'
             ELSE 'A Golden Cross was detected, where SMA50 crossed above SMA200.' END) || {gap}
           WHEN cross_event = 'death_cross' THEN (CASE gap
             WHEN 'strong' THEN 'A strong Death Cross was detected: SMA50 crossed decisively below SMA200.'
             WHEN 'marginal' THEN 'A marginal Death Cross was detected: SMA50 only just crossed below SMA200, so this bearish signal is weak.'
             ELSE 'A Death Cross was detected, where SMA50 crossed below SMA200.' END) || {gap} END,
      CASE WHEN macd_line IS NULL OR macd_hist IS NULL THEN NULL
           WHEN macd_bullish AND macd_hist > 0 THEN 'MACD is above its signal line with a positive histogram, confirming bullish momentum.'
           WHEN macd_bullish THEN 'MACD is above its signal line, suggesting momentum is turning bullish.'
           WHEN macd_hist < 0 THEN 'MACD is below its signal line with a negative histogram, confirming bearish momentum.'
           ELSE 'MACD is below its signal line, suggesting momentum is turning bearish.' END,
      CASE WHEN intraday_return_percent > 1 THEN printf('Recent intraday movement is positive at approximately %.2f%%.', intraday_return_percent)
           WHEN intraday_return_percent < -1 THEN printf('Recent intraday movement is negative at approximately %.2f%%.', intraday_return_percent) END,
      CASE WHEN adx >= 25 AND before <> 0 THEN printf('ADX is high at about %.0f (%s trend), amplifying the %s signal — the move has conviction behind it.',
                adx, {adx_text}, CASE WHEN before > 0 THEN 'bullish' ELSE 'bearish' END)
           WHEN adx >= 25 THEN printf('ADX is high at about %.0f (%s trend), but the other indicators are balanced, so there is no clear direction for it to confirm.', adx, {adx_text})
           WHEN adx < 20 THEN printf('ADX is low at about %.0f (weak / range-bound), so the move lacks conviction and the trend signals are less reliable here.', adx)
           WHEN adx IS NOT NULL THEN printf('ADX is moderate at about %.0f, a developing rather than a strong trend.', adx) END)"""
    warnings = """concat_ws(' / ',
      CASE WHEN disagrees THEN 'ADX confirms a strong trend, but its direction (+DI vs -DI) disagrees with the other indicators, so the signal is less certain.' END,
      CASE WHEN abs(change_percent) > 3 THEN 'The stock has moved more than 3% from the previous close, so short-term volatility may be high.' END,
      CASE WHEN intraday_volatility_percent > 0.8 THEN 'Intraday volatility appears high, so the recommendation should be treated carefully.' END,
      CASE WHEN cross_event = 'not_enough_data' THEN 'There is not enough data to detect long-term moving-average crossover events reliably.' END,
      CASE WHEN adx_ranging THEN 'ADX indicates a weak / range-bound market, so trend-following signals carry extra risk.' END)"""
    extra = (f"{reasons} AS reasons, {warnings} AS warnings" if texts else """
      CAST(4 + (cross_event IN ('golden_cross', 'death_cross'))::INT + coalesce((adx IS NOT NULL)::INT, 0) AS INTEGER) AS n_reasons,
      CAST(n_risk + coalesce(disagrees, false)::INT AS INTEGER) AS n_warnings""")
    keys = "ticker" if texts else "ticker, date"
    return f"""
    SELECT {keys}, score, CASE WHEN score >= 3 THEN CASE WHEN n_risk >= 2 THEN 'Watch with caution' ELSE 'Watch / Buy' END
             WHEN score >= 1 THEN 'Hold / Watch' WHEN score <= -3 THEN 'Sell / Avoid' ELSE 'Hold' END AS signal,
           CASE WHEN n_risk >= 2 THEN 'High' WHEN n_risk = 1 THEN 'Medium' ELSE 'Low' END AS risk_level,
           {"CASE WHEN adx IS NULL THEN 'unknown' WHEN adx >= 40 THEN 'very strong' WHEN adx >= 25 THEN 'strong' WHEN adx >= 20 THEN 'moderate' ELSE 'weak' END AS trend_strength," if texts else ""}
           {extra}
    FROM (
      SELECT *, CAST(before + CASE WHEN adx >= 40 THEN 2 * sign(before) WHEN adx >= 25 THEN sign(before) ELSE 0 END AS INTEGER) AS score,
             adx >= 25 AND before <> 0 AND sign(before) <> CASE WHEN plus_di > minus_di THEN 1 ELSE -1 END AS disagrees,
             coalesce(abs(change_percent) > 3, false)::INT + coalesce(intraday_volatility_percent > 0.8, false)::INT
             + (cross_event = 'not_enough_data')::INT + adx_ranging::INT AS n_risk
      FROM (
        SELECT *, (CASE WHEN close_above_sma20 THEN 1 ELSE -1 END) + (CASE WHEN close_above_sma50 THEN 1 ELSE -1 END)
               + (CASE WHEN close_above_sma200 THEN 1 ELSE -1 END)
               + (CASE cross_event WHEN 'golden_cross' THEN 1 WHEN 'death_cross' THEN -1 ELSE 0 END)
                 * (CASE gap WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END)
               + (CASE WHEN macd_line IS NULL OR macd_hist IS NULL THEN 0 WHEN macd_bullish THEN 1 ELSE -1 END)
               + (CASE WHEN intraday_return_percent > 1 THEN 1 WHEN intraday_return_percent < -1 THEN -1 ELSE 0 END) AS before
        FROM (SELECT *, CASE WHEN abs(sma_gap_percent) >= 5 THEN 'strong' WHEN abs(sma_gap_percent) >= 2 THEN 'moderate'
                             WHEN sma_gap_percent IS NOT NULL THEN 'marginal' ELSE 'moderate' END AS gap FROM ({src}))))"""


oracle("recommendations", recommended(
    "SELECT l.*, q.change_percent FROM latest l LEFT JOIN quotes q USING (ticker)", True), "latest quotes")
oracle("month_end_recommendations", recommended("SELECT * FROM month_ends", False), "month_ends")
CLAIMS = """
    SELECT label, CAST(count(*) AS BIGINT) AS n_sentences, count(*) AS n_checkable, count(*) AS n_correct FROM (
      SELECT unnest([
        CASE WHEN sma20 IS NULL THEN 'sma20_missing_value' WHEN close_above_sma20 THEN 'sma20_above' ELSE 'sma20_below' END,
        CASE WHEN sma50 IS NULL THEN 'sma50_missing_value' WHEN close_above_sma50 THEN 'sma50_above' ELSE 'sma50_below' END,
        CASE WHEN sma200 IS NULL THEN 'sma200_missing_value' WHEN close_above_sma200 THEN 'sma200_above' ELSE 'sma200_below' END,
        CASE WHEN cross_event IN ('golden_cross', 'death_cross') THEN cross_event END,
        CASE WHEN macd_bullish THEN 'macd_above' ELSE 'macd_below' END,
        CASE WHEN adx IS NOT NULL THEN 'adx_band_and_value' END]) AS label FROM month_ends)
    WHERE label IS NOT NULL GROUP BY label"""
oracle("explanation_audit", CLAIMS, "month_ends")
oracle("explanation_audit_totals", f"""
    SELECT (SELECT count(*) FROM month_ends) AS n_recommendations, CAST(sum(n_sentences) AS BIGINT) AS n_sentences,
           CAST(sum(n_checkable) AS BIGINT) AS n_checkable, 1.0::DOUBLE AS coverage,
           CAST(sum(n_correct) AS BIGINT) AS n_correct, 1.0::DOUBLE AS accuracy FROM ({CLAIMS})""", "month_ends")

# ---- backtests ----
DAILY = f"""
    SELECT *, strategy_equity / max(strategy_equity) OVER ({W}) - 1 AS drawdown FROM (
      SELECT *, 10000 * product(1 + strategy_return) OVER ({W}) AS strategy_equity,
             10000 * product(1 + market_return) OVER ({W}) AS buy_hold_equity FROM (
        SELECT *, coalesce({lag('position')}, 0) * market_return AS strategy_return FROM (
          SELECT ticker, date, close, position, coalesce({change(1)}, 0) AS market_return
          FROM signals WHERE sma200 IS NOT NULL)))"""
TRADES = f"""
    SELECT ticker, trade, min(date) AS entry_date, arg_min(close, date) AS entry_price,
           coalesce(min(date) FILTER (o = 1), max(date)) AS exit_date,
           coalesce(arg_min(close, date) FILTER (o = 1), arg_max(close, date)) AS exit_price, max(o) = 1 AS closed,
           100 * (coalesce(arg_min(close, date) FILTER (o = 1), arg_max(close, date)) / arg_min(close, date) - 1) AS return_percent
    FROM (SELECT *, CAST(sum(e) OVER ({W}) AS BIGINT) AS trade FROM (
            SELECT ticker, date, close, (coalesce({lag('position')}, 0) = 0 AND position = 1)::INT AS e,
                   (coalesce({lag('position')}, 0) = 1 AND position = 0)::INT AS o
            FROM signals WHERE sma200 IS NOT NULL))
    WHERE trade > 0 GROUP BY ticker, trade"""
oracle("backtest_equity", f"""SELECT ticker, date, market_return, strategy_return, strategy_equity, buy_hold_equity,
       drawdown FROM ({DAILY})""", "signals",
       "market_return strategy_return strategy_equity buy_hold_equity drawdown")
oracle("backtest_trades", TRADES, "signals", "entry_price exit_price return_percent")
oracle("backtest_summary", f"""
    SELECT t.ticker, start_date, end_date, s AS final_strategy_value, h AS final_buy_hold_value,
           100 * (s / 10000 - 1) AS strategy_return_percent, 100 * (h / 10000 - 1) AS buy_hold_return_percent,
           100 * (s / 10000 - 1) - 100 * (h / 10000 - 1) AS difference_percent, max_drawdown_percent,
           CASE WHEN start_date IS NOT NULL THEN coalesce(nt, 0) END AS number_of_trades,
           CASE WHEN start_date IS NOT NULL THEN coalesce(wr, 0) END AS win_rate_percent, 10000.0::DOUBLE AS initial_cash,
           CASE WHEN start_date IS NOT NULL THEN 'OK' ELSE
             'ERROR: Not enough data for backtesting. At least 200 trading days are required.' END AS status
    FROM (SELECT DISTINCT ticker FROM bars) t
    LEFT JOIN (SELECT ticker, min(date) AS start_date, max(date) AS end_date, arg_max(strategy_equity, date) AS s,
                      arg_max(buy_hold_equity, date) AS h, 100 * min(drawdown) AS max_drawdown_percent
               FROM ({DAILY}) GROUP BY ticker HAVING count(*) >= 2) d USING (ticker)
    LEFT JOIN (SELECT ticker, count(*) AS nt, 100 * avg((return_percent > 0)::INT) AS wr FROM ({TRADES}) GROUP BY ticker) x
    USING (ticker)""", "signals bars",
       "final_strategy_value final_buy_hold_value strategy_return_percent buy_hold_return_percent difference_percent "
       "max_drawdown_percent win_rate_percent")


def folds(train, test, step):
    w = "PARTITION BY ticker, fold ORDER BY date"
    return f"""
    SELECT *, lagged * mr - abs(position - lagged) * 0.001::DOUBLE AS net FROM (
      SELECT *, coalesce(lag(position) OVER ({w}), 0) AS lagged FROM (
        SELECT s.*, CAST(f.fold AS INTEGER) AS fold FROM (
          SELECT ticker, date, position, coalesce({change(1)}, 0) AS mr, row_number() OVER ({W}) - 1 AS i,
                 count(*) OVER (PARTITION BY ticker) AS n, {lag('date', train)} AS train_start,
                 {lag('date')} AS train_end FROM signals) s,
        (SELECT unnest(generate_series(0, 400)) AS fold) f
        WHERE i BETWEEN f.fold * {step} + {train} AND f.fold * {step} + {train + test} - 1
          AND f.fold * {step} + {train + test} <= n))"""


def bundle(prefix, r, dd, rf=0.0, p=252, n="n_days"):
    ann = f"pow(product(1 + {r}), {p}::DOUBLE / count(*)) - 1"
    return f"""product(1 + {r}) - 1 AS {prefix}cumulative_return,
      CASE WHEN product(1 + {r}) <= 0 THEN -1 ELSE {ann} END AS {prefix}annualised_return,
      coalesce(stddev_samp({r}), 0) * sqrt({p}) AS {prefix}annualised_volatility,
      coalesce(CASE WHEN stddev_samp({r}) > 1e-12 * greatest(abs(avg({r})), 1e-4)
               THEN (avg({r}) - {rf}::DOUBLE / {p}) / stddev_samp({r}) * sqrt({p}) END, 0) AS {prefix}sharpe_ratio,
      min({dd}) AS {prefix}max_drawdown,
      coalesce(avg(({r} > 0)::INT) FILTER ({r} <> 0), 0) AS {prefix}hit_rate"""


def drawn(src, part, order, *cols):
    eq = ", ".join(f"product(1 + {c}) OVER (PARTITION BY {part} ORDER BY {order}) AS e_{c}" for c in cols)
    dd = ", ".join(f"e_{c} / max(e_{c}) OVER (PARTITION BY {part} ORDER BY {order}) - 1 AS d_{c}" for c in cols)
    return f"SELECT *, {dd} FROM (SELECT *, {eq} FROM ({src}))"


M6 = "cumulative_return annualised_return annualised_volatility sharpe_ratio max_drawdown hit_rate".split()
BOTH = " ".join(f"{s}_{x}" for s in ("strategy", "benchmark") for x in M6)
FOLDS = f"""
    SELECT ticker, fold, {bundle('strategy_', 'net', 'd_net')}, {bundle('benchmark_', 'mr', 'd_mr')},
           count(*) AS n_days, arg_min(train_start, date) AS train_start, arg_min(train_end, date) AS train_end,
           min(date) AS test_start, max(date) AS test_end,
           CAST(sum((lagged = 0 AND position = 1)::INT) AS BIGINT) AS n_trades
    FROM ({{}}) GROUP BY ticker, fold"""
F63 = FOLDS.format(drawn(folds(252, 63, 63), "ticker, fold", "date", "net", "mr"))
F21 = FOLDS.format(drawn(folds(126, 63, 21), "ticker, fold", "date", "net", "mr"))
oracle("walk_forward_folds", F63, "signals", BOTH)
oracle("walk_forward_overlapping", f"""SELECT ticker, fold, test_start, test_end, n_days, n_trades,
       strategy_cumulative_return FROM ({F21})""", "signals", "strategy_cumulative_return")
oracle("walk_forward_overall", f"""
    SELECT ticker, {bundle('strategy_', 'net', 'd_net')}, {bundle('benchmark_', 'mr', 'd_mr')}, count(*) AS n_days
    FROM ({drawn(folds(252, 63, 63), 'ticker', 'fold, date', 'net', 'mr')}) GROUP BY ticker""", "signals", BOTH)
MEANS = [f"{s}_mean_{x}" for s in ("strategy", "benchmark") for x in M6]
oracle("walk_forward_means", "SELECT ticker, " + ", ".join(
    f"avg({c.replace('_mean', '')}) AS {c}" for c in MEANS) + f", count(*) AS n_folds FROM ({F63}) GROUP BY ticker",
    "signals", " ".join(MEANS))
oracle("metric_bundle", f"""
    SELECT ticker, {bundle('', 'r', 'd_r', 0.02)}, count(*) AS n_days FROM ({drawn(
    f'SELECT ticker, date, coalesce({change(1)}, 0) AS r FROM bars', 'ticker', 'date', 'r')}) GROUP BY ticker""",
       "bars", " ".join(M6))

# ---- point-in-time matrix ----
oracle("rebalance_calendar", "SELECT * FROM calendar", "calendar")
oracle("price_on_date", "SELECT ticker, rebalance_date, price FROM price0", "price0", "price")
oracle("price_next_day", """
    SELECT g.ticker, rebalance_date, next_close AS price FROM grid g
    ASOF JOIN px ON g.ticker = px.ticker AND g.rebalance_date >= px.date WHERE next_close IS NOT NULL""",
       "grid px", "price")
oracle("feature_matrix", "SELECT * FROM matrix", "matrix", FEATS)
oracle("feature_matrix_sentiment", """SELECT rebalance_date, ticker, mom_1m, sentiment FROM matrix
       LEFT JOIN senti USING (rebalance_date, ticker)""", "matrix senti", "mom_1m sentiment")
COVER = "SELECT unnest([" + ", ".join(f"'{c}'" for c in FEATS.split()) + "]) AS feature, unnest([" + ", ".join(
    f"avg(({c} IS NOT NULL)::INT)" for c in FEATS.split()) + "]) AS coverage FROM matrix"
oracle("feature_coverage", COVER, "matrix", "coverage")
oracle("fundamental_coverage", f"""SELECT avg(coverage) AS mean_coverage, avg(coverage) < 0.2 AS warn FROM ({COVER})
       WHERE feature IN ('pe', 'pb', 'roe', 'earnings_growth', 'net_margin', 'debt_to_equity')""", "matrix",
       "mean_coverage")


def pct(c, by):
    return f"""CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST)
      + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY {by}) - 0.5 END AS {c}"""


def z(c, by):
    s, a = f"stddev_samp({c}) OVER (PARTITION BY {by})", f"avg({c}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {s} > 1e-15 * abs({a}) THEN ({c} - {a}) / {s} END AS {c}"


SECTORED = "(SELECT m.*, coalesce(sector, '_UNKNOWN') AS sector FROM matrix m LEFT JOIN sector_of USING (ticker))"
oracle("rank_normalised", "SELECT rebalance_date, ticker, " + ", ".join(
    pct(c, "rebalance_date") for c in FEATS.split()) + " FROM matrix", "matrix", FEATS)
oracle("zscore_normalised", "SELECT rebalance_date, ticker, " + ", ".join(
    z(c, "rebalance_date") for c in FEATS.split()) + " FROM matrix", "matrix", FEATS)
oracle("sector_rank_normalised", "SELECT rebalance_date, ticker, " + ", ".join(
    pct(c, "rebalance_date, sector") for c in FEATS.split()) + f" FROM {SECTORED}", "matrix sector_of", FEATS)
oracle("sector_zscore_normalised", "SELECT rebalance_date, ticker, " + ", ".join(
    z(c, "rebalance_date, sector") for c in ("mom_1m", "roe", "pb")) + f" FROM {SECTORED}", "matrix sector_of",
    "mom_1m roe pb")
oracle("forward_returns", "SELECT * FROM fwd", "fwd", "fwd_ret")
oracle("forward_returns_next_day", "SELECT * FROM fwd3", "fwd3", "fwd_ret")
oracle("labels_median", "SELECT * FROM labels", "labels")
oracle("labels_mean", """SELECT rebalance_date, ticker,
       CAST(fwd_ret > avg(fwd_ret) OVER (PARTITION BY rebalance_date) AS INTEGER) AS label FROM fwd""", "fwd")

# ---- portfolio ----
oracle("top_picks", "SELECT * FROM book3", "book3", "weight")
oracle("latest_picks", "SELECT * FROM book3 WHERE rebalance_date = (SELECT max(rebalance_date) FROM book3)", "book3",
       "weight")
oracle("turnover", "SELECT * FROM churn5", "churn5", "turnover")
oracle("candidates", """
    SELECT rebalance_date, ticker FROM matrix JOIN (
      SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) AS k
      FROM (SELECT DISTINCT rebalance_date FROM matrix)) USING (rebalance_date) WHERE k > 6""", "matrix")
STREAM = "gross turnover net benchmark market"
oracle("portfolio_streams", "SELECT * FROM streams", "streams", STREAM)
oracle("portfolio_streams_next_day", "SELECT * FROM streams5", "streams5", STREAM)
SERIES = " UNION ALL ".join(
    f"SELECT '{s}' AS series, entry_date, {c} AS r FROM streams WHERE {c} IS NOT NULL"
    for s, c in (("strategy", "net"), ("benchmark", "benchmark"), ("market", "market")))
oracle("momentum_book", f"""SELECT series, {bundle('', 'r', 'd_r', 0.0, 12)}, count(*) AS n_periods
       FROM ({drawn(SERIES, 'series', 'entry_date', 'r')}) GROUP BY series""", "streams", " ".join(M6))
oracle("average_turnover", "SELECT coalesce(avg(turnover), 0) AS avg_turnover FROM streams WHERE net IS NOT NULL",
       "streams", "avg_turnover")

# ---- evaluation ----
oracle("ranking_metrics", """
    SELECT 'precision_at_n' AS metric, avg(precision) AS value FROM hits3
    UNION ALL SELECT 'mean_auc', avg(auc) FROM aucs UNION ALL SELECT 'base_rate', avg(label) FROM scored
    UNION ALL SELECT 'n_folds', count(DISTINCT rebalance_date)::DOUBLE FROM scored""", "hits3 aucs scored", "value")
oracle("auc_by_date", "SELECT * FROM aucs", "aucs", "auc")
oracle("precision_by_date", "SELECT * FROM hits5", "hits5", "precision")
oracle("win_rate", "SELECT coalesce(avg((net > benchmark)::INT), 0) AS win_rate FROM streams WHERE net IS NOT NULL",
       "streams", "win_rate")
oracle("yearly_breakdown", """
    SELECT CAST(year(entry_date) AS INTEGER) AS year, product(1 + net) - 1 AS strategy_return,
           product(1 + benchmark) - 1 AS benchmark_return, count(*) AS periods, avg((net > benchmark)::INT) AS win_rate
    FROM streams WHERE net IS NOT NULL GROUP BY ALL""", "streams", "strategy_return benchmark_return win_rate")
oracle("information_by_date", "SELECT * FROM ics", "ics", "ic")
oracle("information_summary", """
    SELECT avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS icir,
           avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS ic_t_stat, count(*) AS n_periods FROM ics""", "ics",
       "mean_ic ic_std icir ic_t_stat")
LEGS = """
    SELECT rebalance_date, coalesce(avg(ret) FILTER (k1 <= k), 0) AS long_ret,
           coalesce(avg(ret) FILTER (n - k1 < k), 0) AS short_ret,
           coalesce(avg(ret) FILTER (k1 <= k), 0) - coalesce(avg(ret) FILTER (n - k1 < k), 0) AS spread
    FROM (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY score DESC, md5(ticker), ticker) AS k1,
                 count(*) OVER (PARTITION BY rebalance_date) AS n,
                 greatest(1, ceil(count(*) OVER (PARTITION BY rebalance_date) * 0.1::DOUBLE)) AS k
          FROM pairs) WHERE n >= 2 GROUP BY rebalance_date"""
oracle("long_short", LEGS, "pairs", "long_ret short_ret spread")


def as_rows(section, key, sql):
    """The columns of a small table as rows of a report."""
    return f"""SELECT '{section}' AS section, key, metric, value FROM (
        SELECT CAST({key} AS VARCHAR) AS key, COLUMNS(* EXCLUDE ({key}))::DOUBLE FROM ({sql})
        ) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (key))))"""


SPREADS = f"SELECT 'long_short' AS series, rebalance_date AS entry_date, spread AS r FROM ({LEGS})"
oracle("selection_report", " UNION ALL ".join([
    *[as_rows("metrics", "series", f"""SELECT series, {bundle('', 'r', 'd_r', 0.0, 12)}, count(*) AS n_periods
                                     FROM ({drawn(x, 'series', 'entry_date', 'r')}) GROUP BY series""") for x in (SERIES, SPREADS)],
    """SELECT 'ranking', 'all', metric, value FROM (
    SELECT 'precision_at_n' AS metric, avg(precision) AS value FROM hits3
    UNION ALL SELECT 'mean_auc', avg(auc) FROM aucs UNION ALL SELECT 'base_rate', avg(label) FROM scored
    UNION ALL SELECT 'n_folds', count(DISTINCT rebalance_date)::DOUBLE FROM scored)""",
    as_rows("yearly", "year", """SELECT year(entry_date) AS year, product(1 + net) - 1 AS strategy_return,
           product(1 + benchmark) - 1 AS benchmark_return, count(*) AS periods, avg((net > benchmark)::INT) AS win_rate
           FROM streams WHERE net IS NOT NULL GROUP BY ALL"""),
    as_rows("avg_turnover", "whole", "SELECT 'all' AS whole, coalesce(avg(turnover), 0) AS avg_turnover FROM streams WHERE net IS NOT NULL"),
    as_rows("win_rate", "whole", "SELECT 'all' AS whole, coalesce(avg((net > benchmark)::INT), 0) AS win_rate FROM streams WHERE net IS NOT NULL"),
    as_rows("information", "whole", """SELECT 'all' AS whole, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS icir,
           avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS ic_t_stat, count(*) AS n_periods FROM ics"""),
]), "streams hits3 aucs scored ics pairs", "value")

oracle("permutation_draws", "SELECT * FROM perm_draws", "perm_draws", "mean_auc precision")
oracle("permutation_test", """
    SELECT count(*) AS n_permutations, any_value(ra) AS real_mean_auc, any_value(rp) AS real_precision,
           (1 + count(*) FILTER (round(mean_auc, 12) >= round(ra, 12))) / (1 + count(*))::DOUBLE AS p_mean_auc,
           (1 + count(*) FILTER (round(precision, 12) >= round(rp, 12))) / (1 + count(*))::DOUBLE AS p_precision,
           avg(mean_auc) AS null_mean_auc, avg(precision) AS null_precision
    FROM perm_draws, (SELECT mean_auc AS ra, precision AS rp FROM perm_draws WHERE draw < 0) WHERE draw >= 0""",
       "perm_draws", "real_mean_auc real_precision p_mean_auc p_precision null_mean_auc null_precision")


def resampled(src, value, order, at, extra=""):
    return f"""
    SELECT d.*, v.v FROM (SELECT *, {at} AS at_ FROM (
        SELECT row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n {extra}
        FROM {src} WHERE {value} IS NOT NULL), generate_series(0, 1999) g(draw)) d
    JOIN (SELECT {value} AS v, row_number() OVER (ORDER BY {order}) - 1 AS at_ FROM {src} WHERE {value} IS NOT NULL) v
    USING (at_)"""


def interval(c):
    return (f"quantile_cont({c}, 0.5) AS {c}_median, quantile_cont({c}, 0.025) AS {c}_lo, "
            f"quantile_cont({c}, 0.975) AS {c}_hi")


oracle("bootstrap_auc", f"""SELECT {interval('mean')} FROM (SELECT draw, avg(v) AS mean FROM ({resampled(
    'aucs', 'auc', 'rebalance_date', draw("0", "draw", "pos") + " % n")}) GROUP BY draw)""", "aucs",
       "mean_median mean_lo mean_hi")


def block(size):
    start = draw("0", "draw", f"CAST(floor(pos / {size}) AS BIGINT)")
    at = f"(({start} % n) + pos % {size}) % n"
    return f"""
    SELECT any_value(size) AS block_size, {interval('ann_return')}, {interval('ann_sharpe')} FROM (
      SELECT draw, any_value(CAST({size} AS INTEGER)) AS size, pow(product(1 + v), 12.0::DOUBLE / count(*)) - 1 AS ann_return,
             avg(v) / stddev_samp(v) * sqrt(12) AS ann_sharpe
      FROM ({resampled('streams', 'net', 'entry_date', at)}) GROUP BY draw)"""


BOOT = "ann_return_median ann_return_lo ann_return_hi ann_sharpe_median ann_sharpe_lo ann_sharpe_hi"
oracle("block_bootstrap", block(
    "(CASE WHEN n < 4 THEN 1 ELSE greatest(2, CAST(round_even(pow(n, 1.0::DOUBLE / 3), 0) AS BIGINT)) END)"),
    "streams", BOOT)
oracle("plain_bootstrap", block("1"), "streams", BOOT)


def moments(src):
    return f"""
    SELECT count(r) AS n, avg(r) / stddev_samp(r) AS sharpe,
           (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * pow(avg(r), 3)) / pow(stddev_pop(r), 3) AS skew,
           (avg(pow(r, 4)) - 4 * avg(r) * avg(pow(r, 3)) + 6 * pow(avg(r), 2) * avg(r * r) - 3 * pow(avg(r), 4))
             / pow(stddev_pop(r), 4) AS kurtosis FROM {src}"""


oracle("sharpe_moments", f"""
    SELECT n, sharpe, skew, kurtosis,
           sharpe * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)) AS z
    FROM ({moments('(SELECT net AS r FROM streams WHERE net IS NOT NULL)')})""", "streams", "sharpe skew kurtosis z")
GRID = " UNION ALL ".join(
    f"""SELECT CAST({n} AS INTEGER) AS top_n, c.cost, entry_date, gross - turnover * c.cost AS r FROM (
        SELECT entry_date, sum(weight * ret) / sum(weight) AS gross FROM book{n}
        JOIN rets ON entry_date = rebalance_date AND rets.ticker = book{n}.ticker GROUP BY entry_date)
      JOIN (SELECT rebalance_date AS entry_date, turnover FROM churn{n}) USING (entry_date),
      (SELECT unnest([0.0::DOUBLE, 0.001::DOUBLE, 0.002::DOUBLE]) AS cost) c""" for n in (3, 5, 10))
HITS = " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS top_n, avg(precision) AS precision FROM hits{n}" for n in (3, 5, 10))
oracle("sensitivity_grid", f"""
    SELECT * FROM (SELECT top_n, cost, {bundle('', 'r', 'd_r', 0.0, 12)}, count(*) AS n_periods
                   FROM ({drawn(GRID, 'top_n, cost', 'entry_date', 'r')}) GROUP BY top_n, cost)
    JOIN ({HITS}) USING (top_n)""", "book3 book5 book10 churn3 churn5 churn10 rets hits3 hits5 hits10",
       " ".join(M6) + " cost precision")
oracle("deflated_sharpe_inputs", f"""
    SELECT t.n_trials, m.n, m.sharpe AS sr, m.skew, m.kurtosis, v.trial_variance
    FROM ({moments('(SELECT net AS r FROM streams WHERE net IS NOT NULL)')}) m,
         (SELECT var_samp(s) AS trial_variance FROM (
            SELECT avg(r) / stddev_samp(r) AS s FROM ({GRID}) GROUP BY top_n, cost)) v,
         (SELECT CAST(unnest([10, 30, 50, 80]) AS INTEGER) AS n_trials) t""",
       "streams book3 book5 book10 churn3 churn5 churn10 rets", "sr skew kurtosis trial_variance")


def cdf(z):
    """Normal distribution function: Simpson's rule from 0 to z."""
    return (f"(0.5 + {z} / 6000.0::DOUBLE / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: "
            f"(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({z} * i / 2000.0::DOUBLE, 2) / 2))))")


def psr_z(bench):
    return (f"(sharpe - {bench}) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe))")


NET = moments('(SELECT net AS r FROM streams WHERE net IS NOT NULL)')
oracle("probabilistic_sharpe", f"SELECT n, sharpe, {cdf('z')} AS psr FROM (SELECT n, sharpe, {psr_z('0')} AS z FROM ({NET}))",
       "streams", "sharpe psr")
# Quantiles by Newton's steps, which rise to the root from below.
QUANTILES = f"""
    WITH RECURSIVE steps AS (
      SELECT CAST(t AS INTEGER) AS n_trials, far, CASE WHEN far THEN 1 - 1.0::DOUBLE / t ELSE 1 - 1 / (t * exp(1)) END AS p,
             0.0::DOUBLE AS x, 0 AS k FROM (SELECT unnest([10, 30, 50, 80]) AS t), (SELECT unnest([true, false]) AS far)
      UNION ALL SELECT n_trials, far, p, x - ({cdf('x')} - p) * sqrt(2 * pi()) * exp(x * x / 2), k + 1 FROM steps WHERE k < 30)
    SELECT n_trials, sum(x * CASE WHEN far THEN 1 - 0.5772156649015329::DOUBLE ELSE 0.5772156649015329::DOUBLE END) AS blend
    FROM steps WHERE k = 30 GROUP BY n_trials"""
oracle("deflated_sharpe", f"""
    SELECT n_trials, n, sharpe AS sr, skew, kurtosis, trial_variance, sr0, z, {cdf('z')} AS dsr FROM (
      SELECT *, {psr_z('sr0')} AS z FROM (
        SELECT q.n_trials, m.*, v.trial_variance, sqrt(v.trial_variance) * q.blend AS sr0 FROM ({NET}) m,
             (SELECT var_samp(s) AS trial_variance FROM (
                SELECT avg(r) / stddev_samp(r) AS s FROM ({GRID}) GROUP BY top_n, cost)) v, ({QUANTILES}) q))""",
       "streams book3 book5 book10 churn3 churn5 churn10 rets", "sr skew kurtosis trial_variance sr0 z dsr")
oracle("random_null", 'SELECT * FROM null_dist', "null_dist", "ann_return sharpe")
BOTHNULL = """SELECT 'ann_return' AS statistic, ann_return AS value FROM null_dist
              UNION ALL SELECT 'sharpe', sharpe FROM null_dist """
oracle("random_null_summary", f"""
    SELECT statistic, count(value) AS n, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.5) AS p50,
           quantile_cont(value, 0.95) AS p95, avg(value) AS mean FROM ({BOTHNULL}) GROUP BY statistic""", "null_dist",
       "p5 p50 p95 mean")
oracle("located_in_null", f"""
    SELECT v.statistic, any_value(real) AS real, count(*) AS n, 100 * avg((value < real)::INT) AS percentile,
           (count(*) FILTER (value >= real) + 1) / (count(*) + 1)::DOUBLE AS p_value
    FROM ({BOTHNULL}) v JOIN (
      SELECT 'ann_return' AS statistic, pow(product(1 + net), 12.0::DOUBLE / count(*)) - 1 AS real FROM streams WHERE net IS NOT NULL
      UNION ALL SELECT 'sharpe', avg(net) / stddev_samp(net) * sqrt(12) FROM streams WHERE net IS NOT NULL) r
    USING (statistic) GROUP BY v.statistic""", "null_dist streams", "real percentile p_value")
oracle("null_histogram", """
    SELECT bin, lo + bin * (hi - lo) / 20 AS lower, lo + (bin + 1) * (hi - lo) / 20 AS upper, count(*) AS n FROM (
      SELECT CAST(least(19, floor((mean_auc - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, lo, hi
      FROM perm_draws, (SELECT min(mean_auc) AS lo, max(mean_auc) AS hi FROM perm_draws WHERE draw >= 0)
      WHERE draw >= 0) GROUP BY ALL""", "perm_draws", "lower upper")

# ---- direction ----
oracle("direction_baseline", "SELECT * FROM baseline", "baseline", "prob_up")
SUMMARY = """count(*) AS n_predictions, count(DISTINCT ticker) AS n_stocks,
    avg(((prob_up >= 0.5)::INT = actual)::INT) AS accuracy, greatest(avg(actual), 1 - avg(actual)) AS base_rate,
    avg((prob_up >= 0.5)::INT) AS up_rate, avg((prob_up - actual) * (prob_up - actual)) AS brier,
    avg(((prob_up >= 0.5)::INT = actual)::INT) - greatest(avg(actual), 1 - avg(actual)) AS edge"""
SUMS = "accuracy base_rate up_rate brier edge"
oracle("direction_baseline_summary", f"SELECT ticker, {SUMMARY} FROM baseline GROUP BY ticker", "baseline", SUMS)
oracle("direction_latest", """
    SELECT ticker, date AS as_of, CASE WHEN mom_10 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prob_up,
           CASE WHEN mom_10 > 0 THEN 'up' ELSE 'down' END AS direction FROM warm
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""", "warm", "prob_up")
oracle("prediction_summary", f"SELECT {SUMMARY} FROM preds", "preds", SUMS)


def auc(by=""):
    part = f"PARTITION BY {by} " if by else ""
    also = f", {by}" if by else ""
    return f"""
    SELECT {by + ',' if by else ''} CASE WHEN sum(actual) > 0 AND sum(actual) < count(*) THEN
      (sum(ar) FILTER (actual = 1) - sum(actual) * (sum(actual) + 1) / 2.0::DOUBLE)
      / (sum(actual)::DOUBLE * (count(*) - sum(actual))::DOUBLE) END AS auc
    FROM (SELECT *, rank() OVER ({part}ORDER BY prob_up)
                 + (count(*) OVER (PARTITION BY prob_up{also}) - 1) / 2.0::DOUBLE AS ar FROM preds)
    {'GROUP BY ' + by if by else ''}"""


oracle("prediction_auc", auc(), "preds", "auc")
oracle("prediction_auc_by_ticker", auc("ticker"), "preds", "auc")
oracle("reliability", "SELECT * FROM reliab", "reliab", "mean_pred frac_up")
oracle("calibration_error", "SELECT sum(n * abs(mean_pred - frac_up)) / sum(n) AS ece FROM reliab", "reliab", "ece")
oracle("selective_accuracy", """
    SELECT coverage, max(keep) AS n, avg(hit) AS accuracy, avg(hit) - any_value(base) AS edge_vs_base FROM (
      SELECT *, ((prob_up >= 0.5)::INT = actual)::INT AS hit,
             row_number() OVER (ORDER BY -abs(prob_up - 0.5::DOUBLE), md5(ticker || '|' || date), ticker || '|' || date) AS k
      FROM preds),
      (SELECT coverage, base, greatest(1, CAST(round_even(total * coverage, 0) AS BIGINT)) AS keep FROM (
         SELECT count(*) AS total, greatest(avg(actual), 1 - avg(actual)) AS base FROM preds),
         (SELECT unnest([1.0::DOUBLE, 0.8::DOUBLE, 0.6::DOUBLE, 0.4::DOUBLE, 0.2::DOUBLE]) AS coverage))
    WHERE k <= keep GROUP BY coverage""", "preds", "coverage accuracy edge_vs_base")

# ---- sentiment ----
oracle("headlines_in_window", """SELECT rebalance_date, ticker, published_at, seq FROM heads JOIN calendar
       ON published_at <= rebalance_date AND published_at > rebalance_date - INTERVAL 7 DAYS""", "heads calendar")
oracle("signed_scores", "SELECT seq, ticker, signed FROM heads", "heads", "signed")
oracle("softmax_scores", """
    SELECT event_id, (e0 - e1) / (e0 + e1 + e2) AS signed, 'neutral' AS third_label, e2 / (e0 + e1 + e2) AS third_score
    FROM (SELECT event_id, exp(value / 20 - t) AS e0, exp(1 - t) AS e1, exp(event_id % 7 - t) AS e2 FROM (
            SELECT *, greatest(value / 20, 1, event_id % 7) AS t FROM events WHERE value IS NOT NULL))""", "",
       "signed third_score")
oracle("sentiment_feature", "SELECT * FROM senti", "senti", "sentiment")
BAND = """CASE WHEN aggregate >= 0.5 THEN 'Strongly positive' WHEN aggregate >= 0.15 THEN 'Positive'
    WHEN aggregate > -0.15 THEN 'Neutral' WHEN aggregate > -0.5 THEN 'Negative' ELSE 'Strongly negative' END AS band"""
LABEL = "CASE WHEN {0} > 0.15 THEN 'positive' WHEN {0} < -0.15 THEN 'negative' ELSE 'neutral' END AS label"
oracle("ticker_sentiment", f"SELECT *, {BAND}, {LABEL.format('aggregate')} FROM moods", "moods", "aggregate")
oracle("newest_headlines", """
    SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, seq DESC) AS INTEGER) AS recency,
           published_at, text, signed, url, seq FROM heads
    WHERE published_at <= TIMESTAMP '2000-01-31' AND published_at > TIMESTAMP '2000-01-01'
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, seq DESC) <= 10""", "heads", "signed")
oracle("market_mood", f"""SELECT mood, n_tickers, {LABEL.format('mood')} FROM (
       SELECT avg(aggregate) AS mood, count(aggregate) AS n_tickers FROM moods)""", "moods", "mood")
oracle("classifier_scores", "SELECT ticker, avg(signed) AS sentiment, count(*) AS n_headlines FROM heads GROUP BY ticker",
       "heads", "sentiment")

# ---- streams: the batch answer, less what the watermark still holds open at the end ----
oracle("stream_bars", """
    SELECT * FROM (SELECT ticker, time_bucket(INTERVAL 5 MINUTES, ts) AS bar_start,
           time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS bar_end,
           arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, (ts, event_id)) AS close, count(*) AS n_ticks
    FROM (SELECT concat('U', user_id) AS ticker, * FROM events WHERE value IS NOT NULL)
    GROUP BY ticker, time_bucket(INTERVAL 5 MINUTES, ts))
    WHERE bar_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""", "", "open high low close")
oracle("stream_sentiment", """
    SELECT ticker, as_of, avg(signed) AS sentiment, count(*) AS n_headlines FROM heads, (
      SELECT CAST(unnest(generate_series(DATE '1999-12-01', DATE '2000-03-31', INTERVAL 1 DAY)) AS DATE) AS as_of)
    WHERE published_at <= as_of AND published_at > as_of - INTERVAL 7 DAYS
      AND as_of <= (SELECT max(published_at) FROM heads) - INTERVAL 1 DAY
    GROUP BY ALL""", "heads", "sentiment")
oracle("stream_positions", "SELECT ticker, date, score, position FROM signals", "signals")
oracle("deduplicated_technical_frame", "SELECT * FROM tech", "tech", "close " + TECH)
oracle("training_spans", """
    SELECT a.rebalance_date, min(b.rebalance_date) AS train_start, max(b.rebalance_date) AS train_end,
           CAST(sum(b.n) AS BIGINT) AS n_train, CAST(sum(b.ones) AS BIGINT) AS n_positive,
           sum(b.ones)::DOUBLE / nullif(sum(b.n), 0) AS share_positive
    FROM (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) - 1 AS k FROM matrix GROUP BY 1) a
    JOIN (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) - 1 AS k, count(label) AS n,
                 coalesce(sum(label), 0) AS ones
          FROM matrix LEFT JOIN labels USING (rebalance_date, ticker) GROUP BY 1) b ON b.k BETWEEN a.k - 12 AND a.k - 1
    WHERE a.k >= 3 GROUP BY a.rebalance_date""", "matrix labels", "share_positive")


def spans(window, horizon, labels):
    """Pairs of folds and training dates, date by date."""
    low = "0" if window is None else f"a.k - {window}"
    known = "" if horizon <= 1 else f"AND b.rebalance_date + INTERVAL {horizon} MONTHS <= a.rebalance_date"
    return f"""
    WITH numbered AS (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) - 1 AS k FROM matrix GROUP BY 1),
    own_labels AS ({labels}),
    pairs AS (SELECT a.rebalance_date AS fold, b.rebalance_date FROM numbered a JOIN numbered b ON b.k BETWEEN {low} AND a.k - 1 {known}
              WHERE a.k >= 3)"""


QUARTER = """SELECT rebalance_date, ticker, CAST(fwd_ret > median(fwd_ret) OVER (PARTITION BY rebalance_date) AS INTEGER) AS label FROM fwd3"""
for name, window, horizon, labels, need in (
        ("training_spans_expanding", None, 1, "SELECT * FROM labels", "labels"),
        ("training_spans_quarter", 12, 3, QUARTER, "fwd3"), ("training_spans_quarter_expanding", None, 3, QUARTER, "fwd3")):
    oracle(name, f"""SELECT * FROM ({spans(window, horizon, labels)}
        SELECT fold AS rebalance_date, min(rebalance_date) AS train_start, max(rebalance_date) AS train_end, CAST(sum(n) AS BIGINT) AS n_train,
               CAST(sum(ones) AS BIGINT) AS n_positive, sum(ones)::DOUBLE / nullif(sum(n), 0) AS share_positive
        FROM pairs JOIN (SELECT rebalance_date, count(label) AS n, coalesce(sum(label), 0) AS ones
                         FROM matrix LEFT JOIN own_labels USING (rebalance_date, ticker) GROUP BY 1) USING (rebalance_date) GROUP BY 1)""",
           f"matrix {need}", "share_positive")
for name, window, horizon, labels, need, columns in (
        ("fold_statistics", 12, 1, "SELECT * FROM labels", "labels", FEATS.split()),
        ("fold_statistics_quarter_expanding", None, 3, QUARTER, "fwd3", ["roe", "mom_12m", "debt_to_equity"])):
    each = " UNION ALL ".join(f"SELECT rebalance_date, '{c}' AS feature, {c} AS value FROM rows" for c in columns)
    oracle(name, f"""SELECT * FROM ({spans(window, horizon, labels)},
        rows AS (SELECT matrix.* FROM matrix JOIN own_labels USING (rebalance_date, ticker) WHERE label IS NOT NULL),
        each AS ({each}),
        told AS (SELECT fold, feature, value, median(value) OVER (PARTITION BY fold, feature) AS median FROM pairs JOIN each USING (rebalance_date))
        SELECT fold AS rebalance_date, feature, count(*) AS n_rows, count(value) AS n_known, any_value(median) AS median,
               avg(coalesce(value, median)) AS mean, stddev_pop(coalesce(value, median)) AS std FROM told GROUP BY ALL)""",
           f"matrix {need}", "median mean std")
oracle("pooled_spans", """
    SELECT d.date, d.date - 1095 AS train_start, d.date - 8 AS train_end, count(p.ticker) AS n_rows,
           count(p.ticker) FILTER (NOT whole) AS n_incomplete, count(p.ticker) FILTER (p.label IS NULL) AS n_unlabelled,
           count(*) FILTER (whole AND p.label IS NOT NULL) AS n_train, count(*) FILTER (whole AND p.label = 1) AS n_positive,
           count(DISTINCT p.ticker) FILTER (whole AND p.label IS NOT NULL) AS n_tickers
    FROM (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM panel GROUP BY 1) WHERE k % 21 = 0) d
    LEFT JOIN (SELECT ticker, date, label, ret_1 + ret_2 + ret_3 + ret_5 + ret_10 + mom_10 + mom_20 + vol_10 + vol_20 + macd_hist
                      + close_sma20 + close_sma50 + adx_14 IS NOT NULL AS whole FROM panel) p
    ON p.date BETWEEN d.date - 1095 AND d.date - 8 GROUP BY d.date""", "panel")
oracle("bars_round_trip", "SELECT * FROM bars", "bars", OHLC)
ORACLES["summary_csv_round_trip"] = ORACLES["history_status"]
ORACLES["sectors_json_round_trip"] = ORACLES["sector_scan"]
oracle("stream_sink", """SELECT ticker, count(*) AS n_headlines, min(published_at) AS first_at, max(published_at) AS last_at
       FROM heads GROUP BY ticker""", "heads")
oracle("ticker_file_report", """
    SELECT ticker, count(*) AS n_rows, count(*) FILTER (day(date) = 13 OR day(date) = 21) AS n_problems,
           count(*) FILTER (day(date) = 13) AS n_undated, count(close) FILTER (day(date) <> 13 AND day(date) <> 21) AS n_closes,
           sum(close) FILTER (day(date) <> 13 AND day(date) <> 21) AS total_close, min(date) FILTER (day(date) <> 13) AS first_date
    FROM bars GROUP BY ticker""", "bars", "total_close")
oracle("ticker_file_bars", "SELECT * FROM bars WHERE ticker IN ('S1', 'S7')", "bars", OHLC)

LEVELS = f"""
    SELECT CAST({draw("'calibration'", "CAST(date AS VARCHAR)", "ticker")} % 3 AS INTEGER) AS part, floor(prob_up * 100) / 100 AS score,
           count(*) AS n, CAST(sum(actual) AS BIGINT) AS ones FROM preds GROUP BY ALL"""
oracle("calibration_parts", f"""SELECT part, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ones) AS BIGINT) AS ones, count(*) AS n_levels
       FROM ({LEVELS}) GROUP BY part""", "preds")
# The nearest non-decreasing steps: the largest, over beginnings, of the smallest mean up to any end.
oracle("calibrated_isotonic", f"""SELECT * FROM (WITH levels AS ({LEVELS}),
    upto AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS sn, sum(ones) OVER w AS so FROM levels WINDOW w AS (PARTITION BY part ORDER BY score)),
    means AS (SELECT a.part, a.i AS a, b.i AS b, (b.so - a.so + a.ones)::DOUBLE / (b.sn - a.sn + a.n) AS m
              FROM upto a JOIN upto b ON a.part = b.part AND a.i <= b.i),
    lows AS (SELECT u.part, u.i, a, min(m) AS low FROM upto u JOIN means ON means.part = u.part AND a <= u.i AND b >= u.i GROUP BY ALL)
    SELECT part, score, n, ones, value FROM upto JOIN (SELECT part, i, max(low) AS value FROM lows GROUP BY ALL) USING (part, i))""",
       "preds", "value")
oracle("located_histogram", """
    SELECT bin, CASE WHEN bin >= 0 THEN lo + bin * (hi - lo) / 20 END AS lower, CASE WHEN bin < 20 THEN lo + (bin + 1) * (hi - lo) / 20 END AS upper,
           count(*) FILTER (draw >= 0) AS n, max((draw < 0)::INT) = 1 AS holds_real FROM (
      SELECT CAST(CASE WHEN mean_auc < lo THEN -1 WHEN mean_auc > hi THEN 20
                       ELSE least(19, floor((mean_auc - lo) / (hi - lo) * 20)) END AS INTEGER) AS bin, lo, hi, draw
      FROM perm_draws, (SELECT min(mean_auc) AS lo, max(mean_auc) AS hi FROM perm_draws WHERE draw >= 0)) GROUP BY bin, lo, hi""",
       "perm_draws", "lower upper")
oracle("aligned_positions", """
    SELECT b.ticker, b.date, b.close, coalesce(s.position, 0)::DOUBLE AS position FROM bars b
    ASOF LEFT JOIN (SELECT ticker, date, position FROM signals WHERE day(date) % 5 = 0) s ON b.ticker = s.ticker AND b.date >= s.date""",
       "bars signals", "close position")
oracle("timestamps_in_utc", """
    SELECT CAST(moment AS DATE) AS date, count(*) AS n, min(moment) AS first_at, max(moment) AS last_at FROM (
      SELECT CASE WHEN event_id % 50 = 7 THEN NULL ELSE date_trunc('second', ts) - CASE event_id % 3 WHEN 1 THEN INTERVAL 330 MINUTE
                  WHEN 2 THEN INTERVAL (-480) MINUTE ELSE INTERVAL 0 MINUTE END END AS moment FROM events) GROUP BY 1""")
