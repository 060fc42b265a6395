"""Common table expressions the oracles are built from, in order of dependence."""

W = "PARTITION BY ticker ORDER BY date"


def mean(c, n):
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {over} = {n} THEN avg({c}) {over} END"


def std(c, n):
    over = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {over} = {n} THEN stddev_samp({c}) {over} END"


def lag(c, n=1):
    return f"lag({c}, {n}) OVER ({W})"


def change(n, skip=0):
    now = "close" if skip == 0 else lag("close", skip)
    return f"{now} / nullif({lag('close', n)}, 0) - 1"


def smoothed(src):
    """MACD and ADX by the recursion itself, one row index at a time."""
    return f"""
    SELECT ticker, date, ef - es AS macd, sg AS macd_signal, (ef - es) - sg AS macd_hist,
           CASE WHEN i >= 13 THEN 100 * p / nullif(atr, 0) END AS plus_di,
           CASE WHEN i >= 13 THEN 100 * m / nullif(atr, 0) END AS minus_di,
           CASE WHEN nd >= 14 THEN ax END AS adx14
    FROM {src}_rec
    """


def recursion(src):
    a, b, s, w = "(2.0::DOUBLE/13)", "(2.0::DOUBLE/27)", "(0.2::DOUBLE)", "(1.0::DOUBLE/14)"
    rows = f"SELECT ticker, date, high, low, close, row_number() OVER ({W}) - 1 AS i FROM {src}"
    rec = f"""
    SELECT ticker, date, i, high, low, close, close AS ef, close AS es, 0.0::DOUBLE AS sg, high - low AS atr,
           0.0::DOUBLE AS p, 0.0::DOUBLE AS m, NULL::DOUBLE AS ax, 0 AS nd
    FROM {src}_rows WHERE i = 0
    UNION ALL
    SELECT ticker, date, i, high, low, close, ef, es, sg + {s} * ((ef - es) - sg), atr, p, m,
           CASE WHEN dx IS NULL THEN ax WHEN nd = 0 THEN dx ELSE ax + {w} * (dx - ax) END,
           CASE WHEN dx IS NULL THEN nd ELSE nd + 1 END
    FROM (
      SELECT *, CASE WHEN i >= 13 THEN
               100 * abs(100 * p / nullif(atr, 0) - 100 * m / nullif(atr, 0))
               / nullif(100 * p / nullif(atr, 0) + 100 * m / nullif(atr, 0), 0) END AS dx
      FROM (
        SELECT x.ticker, x.date, x.i, x.high, x.low, x.close,
               r.ef + {a} * (x.close - r.ef) AS ef, r.es + {b} * (x.close - r.es) AS es, r.sg,
               r.atr + {w} * (greatest(x.high - x.low, abs(x.high - r.close), abs(x.low - r.close)) - r.atr) AS atr,
               r.p + {w} * ((CASE WHEN x.high - r.high > r.low - x.low AND x.high - r.high > 0
                             THEN x.high - r.high ELSE 0 END) - r.p) AS p,
               r.m + {w} * ((CASE WHEN r.low - x.low > x.high - r.high AND r.low - x.low > 0
                             THEN r.low - x.low ELSE 0 END) - r.m) AS m,
               r.ax, r.nd
        FROM {src}_rec r JOIN {src}_rows x ON x.ticker = r.ticker AND x.i = r.i + 1))
    """
    return rows, rec


VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {}


def view(name, sql, *deps):
    VIEWS[name] = (sql, deps)


view("line", """
    SELECT concat('S', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date,
           CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS BIGINT) AS step,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, max(CAST(round(l_tax * 100) AS BIGINT)) AS spread
    FROM lineitem GROUP BY ALL""")
view("walk", f"""
    SELECT *, round(100 * exp(0.006::DOUBLE * sum(step) OVER ({W})), 3) AS close FROM line""", "line")
view("opened", f"SELECT *, coalesce(lag(close) OVER ({W}), close) AS open FROM walk", "walk")
view("bars", """
    SELECT ticker, date, open, 
           (CAST(round(greatest(open, close) * 1000) AS BIGINT) * (400 + spread) // 400) / 1000.0::DOUBLE AS high,
           (CAST(round(least(open, close) * 1000) AS BIGINT) * (400 - spread) // 400) / 1000.0::DOUBLE AS low, close,
           round(close * pow(0.98::DOUBLE, datediff('day', date, DATE '2001-12-31') / 365.25::DOUBLE), 3) AS adj_close,
           volume, 0.0::DOUBLE AS dividends, 0.0::DOUBLE AS stock_splits
    FROM opened""", "opened")
view("adj", """
    SELECT ticker, date, open * (adj_close / nullif(close, 0)) AS open, high * (adj_close / nullif(close, 0)) AS high,
           low * (adj_close / nullif(close, 0)) AS low, close * (adj_close / nullif(close, 0)) AS close, adj_close,
           volume, dividends, stock_splits FROM bars""", "bars")
for src in ("bars", "adj"):
    rows, rec = recursion(src)
    view(f"{src}_rows", rows, src)
    view(f"{src}_rec", rec, f"{src}_rows")
    view(f"{src}_ema", smoothed(src), f"{src}_rec")

view("sma", f"""
    SELECT *, {mean('close', 20)} AS sma20, {mean('close', 50)} AS sma50, {mean('close', 200)} AS sma200
    FROM bars""", "bars")
view("crossed", f"""
    SELECT *, count(sma200) OVER ({W}) AS seen200,
           CASE WHEN {lag('sma50')} <= {lag('sma200')} AND sma50 > sma200 THEN 'golden_cross'
                WHEN {lag('sma50')} >= {lag('sma200')} AND sma50 < sma200 THEN 'death_cross' ELSE 'none' END AS flag
    FROM sma""", "sma")
view("ind", """
    SELECT c.*, CASE WHEN seen200 < 2 THEN 'not_enough_data' ELSE flag END AS cross_event,
           macd, macd_signal, macd_hist, plus_di, minus_di, adx14
    FROM crossed c JOIN bars_ema e USING (ticker, date)""", "crossed", "bars_ema")

view("lean", """
    SELECT *, (CASE WHEN close > sma20 THEN 1 WHEN close < sma20 THEN -1 ELSE 0 END)
         + (CASE WHEN close > sma50 THEN 1 WHEN close < sma50 THEN -1 ELSE 0 END)
         + (CASE WHEN close > sma200 THEN 1 WHEN close < sma200 THEN -1 ELSE 0 END)
         + (CASE flag WHEN 'golden_cross' THEN 2 WHEN 'death_cross' THEN -2 ELSE 0 END)
         + (CASE WHEN macd > macd_signal THEN 1 WHEN macd < macd_signal THEN -1 ELSE 0 END) AS dir
    FROM ind""", "ind")
view("rated", """
    SELECT *, CAST(CASE WHEN adx14 < 20 THEN round_even(dir / 2.0, 0)
         ELSE dir + (CASE WHEN adx14 >= 25 THEN sign(dir) ELSE 0 END)
                  + (CASE WHEN adx14 >= 40 THEN sign(dir) ELSE 0 END) END AS INTEGER) AS score
    FROM lean""", "lean")
view("signals", f"""
    SELECT *, CASE WHEN score >= 3 THEN 'Buy' WHEN score <= -3 THEN 'Sell' ELSE 'Hold' END AS raw_signal,
           CAST(coalesce(last_value(CASE WHEN score >= 3 THEN 1 WHEN score <= -3 THEN 0 END IGNORE NULLS)
                OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS position
    FROM rated""", "rated")

# ---- intraday ----
view("supplier_ticks", """
    SELECT concat('S', user_id % (SELECT count(*) FROM supplier)) AS ticker, ts, value AS price, event_id AS seq
    FROM events""")
view("bars5", """
    SELECT ticker, time_bucket(INTERVAL 5 MINUTES, ts) AS bar_start,
           time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS bar_end,
           arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, (ts, seq)) AS close, count(*) AS n_ticks
    FROM supplier_ticks
    WHERE price IS NOT NULL AND ts > (SELECT max(ts) FROM supplier_ticks) - INTERVAL 5 DAYS
    GROUP BY ALL""", "supplier_ticks")
view("intraday", """
    SELECT ticker, arg_max(close, bar_start) AS last_price, max(bar_start) AS last_bar,
           100 * (arg_max(close, bar_start) / nullif(arg_min(close, bar_start), 0) - 1) AS intraday_return_percent,
           100 * stddev_samp(CASE WHEN back <= 78 THEN r END) AS intraday_volatility_percent
    FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY bar_start), 0) - 1 AS r,
                 row_number() OVER (PARTITION BY ticker ORDER BY bar_start DESC) AS back FROM bars5)
    GROUP BY ticker""", "bars5")
view("previous", """
    SELECT ticker, arg_max(close, rn) AS previous_close
    FROM (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars)
    WHERE rn <= 2 GROUP BY ticker""", "bars")
view("quotes", """
    SELECT i.ticker, last_price AS latest_price, last_bar AS as_of, previous_close,
           last_price - nullif(previous_close, 0) + 0 * previous_close AS change,
           100 * (last_price - nullif(previous_close, 0)) / nullif(previous_close, 0) AS change_percent
    FROM intraday i LEFT JOIN previous USING (ticker)""", "intraday", "previous")
view("snap", f"""
    SELECT ticker, date, close AS latest_close, {lag('close')} AS previous_close, sma20, sma50, sma200,
           coalesce(close > sma20, false) AS close_above_sma20, coalesce(close > sma50, false) AS close_above_sma50,
           coalesce(close > sma200, false) AS close_above_sma200, cross_event,
           100 * (sma50 - sma200) / nullif(sma200, 0) AS sma_gap_percent, macd AS macd_line, macd_signal, macd_hist,
           coalesce(macd > macd_signal, false) AS macd_bullish, adx14 AS adx, plus_di, minus_di,
           coalesce(adx14 >= 25, false) AS adx_trending, coalesce(adx14 < 20, false) AS adx_ranging,
           count(*) OVER ({W}) AS n_bars
    FROM ind""", "ind")
view("latest", """
    SELECT s.*, i.intraday_return_percent, i.intraday_volatility_percent
    FROM (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) s
    LEFT JOIN intraday i USING (ticker)""", "snap", "intraday")
view("month_ends", """
    SELECT *, 100 * (latest_close / nullif(previous_close, 0) - 1) AS change_percent,
           NULL::DOUBLE AS intraday_return_percent, NULL::DOUBLE AS intraday_volatility_percent
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS m
          FROM (SELECT * FROM snap QUALIFY row_number() OVER (
                PARTITION BY ticker, date_trunc('month', date) ORDER BY date DESC) = 1))
    WHERE m <= 24 AND n_bars >= 220""", "snap")

# ---- fundamentals ----
view("fin_lines", """
    SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
           CAST(round(l_discount * 100) AS BIGINT) AS off, CAST(round(l_tax * 100) AS BIGINT) AS tax,
           CAST(l_quantity AS BIGINT) AS qty, CAST(round(p_retailprice * 100) AS BIGINT) AS retail
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
view("fin_periods", """
    SELECT k, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTHS - INTERVAL 1 DAY AS DATE) AS period_end,
           'quarterly' AS freq, sum(price) AS price, sum(price * (100 - off) - 150 * qty * retail) AS income,
           sum(price * tax) AS debt
    FROM fin_lines GROUP BY ALL
    UNION ALL
    SELECT k, CAST(date_trunc('year', date) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE), 'annual',
           sum(price), sum(price * (100 - off) - 150 * qty * retail), sum(price * tax)
    FROM fin_lines GROUP BY ALL""", "fin_lines")
view("statements", """
    SELECT concat('S', k) AS ticker, period_end, freq, income::DOUBLE / 10000 AS net_income,
           price::DOUBLE / 100 AS total_revenue, 1000 * s_acctbal AS total_equity, debt::DOUBLE / 1000 AS total_debt,
           CASE WHEN k % 7 <> 0 THEN 1e6 * (1 + k % 10) END AS shares_outstanding
    FROM fin_periods JOIN supplier ON s_suppkey = k""", "fin_periods")
view("ratios", """
    SELECT *, ttm_net_income / nullif(total_equity, 0) AS roe, net_income / nullif(total_revenue, 0) AS net_margin,
           total_debt / nullif(total_equity, 0) AS debt_to_equity,
           (net_income - prior) / nullif(abs(prior), 0) AS earnings_growth_yoy
    FROM (SELECT *,
            CASE WHEN freq = 'annual' THEN net_income
                 WHEN count(net_income) OVER f4 = 4 THEN sum(net_income) OVER f4 END AS ttm_net_income,
            CASE WHEN freq = 'annual' THEN lag(net_income) OVER f ELSE lag(net_income, 4) OVER f END AS prior
          FROM statements
          WINDOW f AS (PARTITION BY ticker, freq ORDER BY period_end),
                 f4 AS (PARTITION BY ticker, freq ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    """, "statements")
view("fundamentals", """
    SELECT ticker, period_end, CAST(period_end + INTERVAL 60 DAYS AS DATE) AS available_date, net_income,
           total_revenue, total_equity, total_debt, shares_outstanding, ttm_net_income, roe, net_margin,
           debt_to_equity, earnings_growth_yoy
    FROM ratios QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY freq DESC) = 1""", "ratios")
view("filings", """
    SELECT * REPLACE (coalesce(ttm_net_income, CASE WHEN count(net_income) OVER f = 4
                               THEN sum(net_income) OVER f END) AS ttm_net_income)
    FROM fundamentals
    WINDOW f AS (PARTITION BY ticker ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", "fundamentals")
view("sector_of", """
    SELECT concat('S', s_suppkey) AS ticker, trim(r_name) AS sector
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE s_suppkey % 11 <> 0""")

# ---- matrix ----
view("spans", "SELECT ticker, min(date) AS first, max(date) AS last FROM adj GROUP BY ticker", "adj")
view("calendar", """
    SELECT d AS rebalance_date FROM (
      SELECT CAST(unnest(generate_series(date_trunc('month', (SELECT min(first) FROM spans)),
                  (SELECT max(last) FROM spans), INTERVAL 1 MONTH)) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS d)
    WHERE d <= (SELECT max(last) FROM spans)
      AND (SELECT count(*) FROM spans WHERE first <= d AND d <= last)
          >= greatest(1, least(10, (SELECT count(*) FROM spans)))""", "spans")
view("tech0", f"""
    SELECT a.ticker, a.date, close, macd, adx14 AS adx, {change(1)} AS r1, {change(21)} AS mom_1m,
           {change(63)} AS mom_3m, {change(126)} AS mom_6m, {change(252, 21)} AS mom_12m,
           {change(5)} AS reversal_5d,
           close / max(close) OVER ({W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS high_52w
    FROM (SELECT adj.*, macd, adx14 FROM adj JOIN adj_ema USING (ticker, date)) a""", "adj", "adj_ema")
view("tech1", f"SELECT *, {std('r1', 21)} AS volatility FROM tech0", "tech0")
view("tech", """
    SELECT ticker, date, close, mom_1m, mom_3m, mom_6m, mom_12m, reversal_5d,
           CASE WHEN volatility > 0 THEN mom_12m / volatility END AS mom_risk_adj, high_52w, volatility, macd, adx
    FROM tech1""", "tech1")
view("grid", "SELECT ticker, first, last, rebalance_date FROM spans, calendar", "spans", "calendar")
view("cells", """
    SELECT g.rebalance_date, t.* EXCLUDE (date) FROM grid g ASOF JOIN tech t
    ON g.ticker = t.ticker AND g.rebalance_date >= t.date""", "grid", "tech")
view("filing_of", """
    SELECT rebalance_date, ticker, arg_max(f, (available_date, period_end)) AS f FROM (
      SELECT c.rebalance_date, c.ticker, f.available_date, f.period_end, f FROM cells c
      JOIN filings f ON f.ticker = c.ticker AND f.available_date <= c.rebalance_date) GROUP BY ALL""",
     "cells", "filings")
view("matrix", """
    SELECT c.rebalance_date, c.ticker, mom_1m, mom_3m, mom_6m, mom_12m, reversal_5d, mom_risk_adj, high_52w,
           volatility, macd, adx,
           CASE WHEN f.ttm_net_income > 0 AND f.shares_outstanding > 0
                THEN close * f.shares_outstanding / f.ttm_net_income END AS pe,
           CASE WHEN f.total_equity > 0 AND f.shares_outstanding > 0
                THEN close * f.shares_outstanding / f.total_equity END AS pb,
           f.roe AS roe, f.earnings_growth_yoy AS earnings_growth, f.net_margin AS net_margin,
           f.debt_to_equity AS debt_to_equity
    FROM cells c LEFT JOIN filing_of USING (rebalance_date, ticker)""", "cells", "filing_of")
view("px", """
    SELECT ticker, date, close, lead(date) OVER w AS next_date, lead(close) OVER w AS next_close FROM adj
    WINDOW w AS (PARTITION BY ticker ORDER BY date)""", "adj")
view("price0", """
    SELECT g.ticker, rebalance_date, close AS price FROM grid g
    ASOF JOIN px ON g.ticker = px.ticker AND g.rebalance_date >= px.date
    WHERE rebalance_date BETWEEN first AND last""", "grid", "px")


def forward(months, lag_):
    price = "close" if lag_ == 0 else "next_close"
    inside = "q.at BETWEEN q.first AND q.last" if lag_ == 0 else "next_close IS NOT NULL"
    one = lambda at: f"""(  -- noqa: E731
      SELECT q.ticker, q.rebalance_date, {price} AS price
      FROM (SELECT ticker, first, last, rebalance_date, CAST({at} AS DATE) AS at FROM grid) q
      ASOF JOIN px ON q.ticker = px.ticker AND q.at >= px.date WHERE {inside})"""
    return f"""
    SELECT a.rebalance_date, a.ticker, b.price / a.price - 1 AS fwd_ret
    FROM {one('rebalance_date').replace('  -- noqa: E731', '')} a
    JOIN {one(f'rebalance_date + INTERVAL {months} MONTHS').replace('  -- noqa: E731', '')} b
    USING (rebalance_date, ticker) WHERE a.price <> 0"""


view("fwd", forward(1, 0), "grid", "px")
view("fwd3", forward(3, 1), "grid", "px")
view("labels", """
    SELECT rebalance_date, ticker, CAST(fwd_ret > median(fwd_ret) OVER (PARTITION BY rebalance_date) AS INTEGER) AS label
    FROM fwd""", "fwd")

# ---- portfolio ----
view("mom", f"SELECT ticker, date, {change(252, 21)} AS score FROM adj", "adj")
view("scores", """
    SELECT g.rebalance_date, g.ticker, score FROM grid g
    ASOF JOIN mom ON g.ticker = mom.ticker AND g.rebalance_date >= mom.date WHERE score IS NOT NULL""", "grid", "mom")


def weights(n, name="scores"):
    return f"""
    SELECT rebalance_date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY rebalance_date) AS weight
    FROM (SELECT * FROM {name} QUALIFY row_number() OVER (
          PARTITION BY rebalance_date ORDER BY score DESC NULLS LAST, ticker) <= {n})"""


for n in (3, 5, 10):
    view(f"book{n}", weights(n), "scores")
view("periods", """
    SELECT entry_date, exit_date FROM (
      SELECT rebalance_date AS entry_date, lead(rebalance_date) OVER (ORDER BY rebalance_date) AS exit_date
      FROM (SELECT DISTINCT rebalance_date FROM scores)) WHERE exit_date IS NOT NULL""", "scores")


def returns(lag_):
    price = "close" if lag_ == 0 else "next_close"
    inside = "q.at BETWEEN q.first AND q.last" if lag_ == 0 else "next_close IS NOT NULL"
    side = lambda at: f"""(SELECT q.ticker, entry_date, exit_date, {price} AS price FROM (  -- noqa: E731
        SELECT ticker, first, last, entry_date, exit_date, {at} AS at FROM spans, periods) q
        ASOF JOIN px ON q.ticker = px.ticker AND q.at >= px.date WHERE {inside})""".replace("  -- noqa: E731", "")
    return f"""
    SELECT ticker, entry_date, exit_date, b.price / a.price - 1 AS ret
    FROM {side('entry_date')} a JOIN {side('exit_date')} b USING (ticker, entry_date, exit_date)
    WHERE a.price <> 0"""


view("rets", returns(0), "spans", "periods", "px")
view("rets1", returns(1), "spans", "periods", "px")


def turnover(book):
    return f"""
    SELECT rebalance_date, sum(abs(d)) AS turnover FROM (
      SELECT coalesce(n.rebalance_date, o.rebalance_date) AS rebalance_date, coalesce(n.ticker, o.ticker) AS ticker,
             coalesce(n.weight, 0) - coalesce(o.weight, 0) AS d
      FROM {book} n FULL JOIN (
        SELECT exit_date AS rebalance_date, ticker, weight FROM {book} JOIN periods ON entry_date = rebalance_date) o
      ON n.rebalance_date = o.rebalance_date AND n.ticker = o.ticker)
    GROUP BY rebalance_date"""


for n in (3, 5, 10):
    view(f"churn{n}", turnover(f"book{n}"), f"book{n}", "periods")


def streams(book, churn, rets, cost):
    return f"""
    SELECT p.entry_date, p.exit_date, g.gross, CASE WHEN g.gross IS NOT NULL THEN c.turnover END AS turnover,
           g.gross - c.turnover * {cost}::DOUBLE AS net, coalesce(u.benchmark, 0) AS benchmark, u.market
    FROM periods p
    LEFT JOIN (SELECT entry_date, sum(weight * ret) / sum(weight) AS gross
               FROM {book} JOIN {rets} ON entry_date = rebalance_date AND {rets}.ticker = {book}.ticker
               GROUP BY entry_date) g USING (entry_date)
    LEFT JOIN (SELECT rebalance_date AS entry_date, turnover FROM {churn}) c USING (entry_date)
    LEFT JOIN (SELECT entry_date, avg(ret) FILTER (ticker <> 'S0') AS benchmark,
                      max(ret) FILTER (ticker = 'S0') AS market FROM {rets} GROUP BY entry_date) u USING (entry_date)"""


view("streams", streams("book3", "churn3", "rets", 0.001), "periods", "book3", "rets", "churn3")
view("streams5", streams("book5", "churn5", "rets1", 0.001), "periods", "book5", "rets1", "churn5")
view("scored", "SELECT s.*, label FROM scores s LEFT JOIN labels USING (rebalance_date, ticker)", "scores", "labels")
view("pairs", """
    SELECT s.rebalance_date, s.ticker, s.score, r.ret FROM scores s
    JOIN periods p ON p.entry_date = s.rebalance_date
    LEFT JOIN rets r ON r.entry_date = s.rebalance_date AND r.ticker = s.ticker""", "scores", "periods", "rets")
view("label_ranks", """
    SELECT *, rank() OVER (PARTITION BY rebalance_date ORDER BY score)
              + (count(*) OVER (PARTITION BY rebalance_date, score) - 1) / 2.0::DOUBLE AS ar
    FROM scored WHERE label IS NOT NULL""", "scored")
view("aucs", """
    SELECT rebalance_date, CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN
           (sum(ar) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
           / (sum(label) * (count(*) - sum(label)))::DOUBLE END AS auc
    FROM label_ranks GROUP BY rebalance_date""", "label_ranks")
view("hits3", """
    SELECT s.rebalance_date, avg(label) AS precision FROM scored s
    JOIN book3 USING (rebalance_date, ticker) WHERE label IS NOT NULL GROUP BY ALL""", "scored", "book3")
view("hits5", """
    SELECT s.rebalance_date, avg(label) AS precision FROM scored s
    JOIN book5 USING (rebalance_date, ticker) WHERE label IS NOT NULL GROUP BY ALL""", "scored", "book5")
view("hits10", """
    SELECT s.rebalance_date, avg(label) AS precision FROM scored s
    JOIN book10 USING (rebalance_date, ticker) WHERE label IS NOT NULL GROUP BY ALL""", "scored", "book10")
view("ics", """
    SELECT rebalance_date, count(*) AS n_pairs, corr(s, r) AS ic FROM (
      SELECT rebalance_date, score, ret,
        rank() OVER (PARTITION BY rebalance_date ORDER BY score)
          + (count(*) OVER (PARTITION BY rebalance_date, score) - 1) / 2.0::DOUBLE AS s,
        rank() OVER (PARTITION BY rebalance_date ORDER BY ret)
          + (count(*) OVER (PARTITION BY rebalance_date, ret) - 1) / 2.0::DOUBLE AS r
      FROM pairs WHERE score IS NOT NULL AND ret IS NOT NULL)
    GROUP BY rebalance_date
    HAVING count(*) >= 3 AND count(DISTINCT score) > 1 AND count(DISTINCT ret) > 1""", "pairs")


def draw(*parts):
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15)) AS BIGINT)"


view("permuted", f"""
    SELECT draw, rebalance_date, ar, score, ticker, pick,
           CASE WHEN draw < 0 THEN label ELSE CAST(row_number() OVER (
             PARTITION BY draw, rebalance_date ORDER BY {draw('0', 'draw', 'rebalance_date', 'ticker')}, ticker)
             <= sum(label) OVER (PARTITION BY draw, rebalance_date) AS INTEGER) END AS y
    FROM (SELECT l.*, b.ticker IS NOT NULL AS pick, unnest(generate_series(-1, 99)) AS draw
          FROM label_ranks l LEFT JOIN book3 b USING (rebalance_date, ticker))""", "label_ranks", "book3")
view("perm_draws", """
    SELECT CAST(draw AS INTEGER) AS draw, avg(auc) AS mean_auc, avg(precision) AS precision FROM (
      SELECT draw, rebalance_date, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN
             (sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE)
             / (sum(y) * (count(*) - sum(y)))::DOUBLE END AS auc,
             avg(y) FILTER (pick) AS precision
      FROM permuted GROUP BY ALL) GROUP BY draw""", "permuted")

# Floyd's sampling of three distinct positions out of n, spelled out.
view("numbered", """
    SELECT rebalance_date, ticker, row_number() OVER (PARTITION BY rebalance_date ORDER BY md5(ticker), ticker) - 1 AS pos,
           count(*) OVER (PARTITION BY rebalance_date) AS n
    FROM matrix WHERE rebalance_date IN (
      SELECT rebalance_date FROM (SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) - 1 AS k
                                  FROM (SELECT DISTINCT rebalance_date FROM matrix)) WHERE k >= 13)""", "matrix")
view("floyd", f"""
    SELECT draw, rebalance_date, n, p0, p1,
           CASE WHEN h2 % n IN (p0, p1) THEN n - 1 ELSE h2 % n END AS p2 FROM (
      SELECT *, CASE WHEN h1 % (n - 1) = p0 THEN n - 2 ELSE h1 % (n - 1) END AS p1 FROM (
        SELECT *, h0 % (n - 2) AS p0 FROM (
          SELECT draw, rebalance_date, n, {draw('0', 'draw', 'rebalance_date', '0')} AS h0,
                 {draw('0', 'draw', 'rebalance_date', '1')} AS h1, {draw('0', 'draw', 'rebalance_date', '2')} AS h2
          FROM (SELECT DISTINCT rebalance_date, n FROM numbered), generate_series(0, 499) g(draw))))""", "numbered")
view("null_books", """
    SELECT draw, f.rebalance_date, ticker, 1.0::DOUBLE / 3 AS weight
    FROM floyd f JOIN numbered m ON m.rebalance_date = f.rebalance_date AND m.pos IN (p0, p1, p2)""", "floyd", "numbered")
view("null_dates", """
    SELECT rebalance_date, lead(rebalance_date) OVER (ORDER BY rebalance_date) AS exit_date
    FROM (SELECT DISTINCT rebalance_date FROM numbered)""", "numbered")
view("null_streams", """
    SELECT g.draw, g.entry_date, gross - turnover * 0.001::DOUBLE AS net FROM (
      SELECT draw, entry_date, sum(weight * ret) / sum(weight) AS gross
      FROM null_books b JOIN null_dates d USING (rebalance_date)
      JOIN rets r ON r.entry_date = b.rebalance_date AND r.exit_date = d.exit_date AND r.ticker = b.ticker
      GROUP BY ALL) g
    JOIN (SELECT draw, rebalance_date AS entry_date, sum(abs(d)) AS turnover FROM (
            SELECT draw, rebalance_date, ticker, sum(w) AS d FROM (
              SELECT draw, rebalance_date, ticker, weight AS w FROM null_books
              UNION ALL SELECT draw, exit_date, ticker, -weight FROM null_books JOIN null_dates USING (rebalance_date)
              WHERE exit_date IS NOT NULL) GROUP BY ALL) GROUP BY ALL) t USING (draw, entry_date)""",
     "null_books", "null_dates", "rets")
view("null_dist", """
    SELECT CAST(draw AS INTEGER) AS draw, pow(product(1 + net), 12.0::DOUBLE / count(*)) - 1 AS ann_return,
           avg(net) / stddev_samp(net) * sqrt(12) AS sharpe
    FROM null_streams GROUP BY draw HAVING count(*) >= 2""", "null_streams")

# ---- direction ----
view("panel0", f"""
    SELECT a.ticker, a.date, close, {change(1)} AS ret_1, {change(2)} AS ret_2, {change(3)} AS ret_3,
           {change(5)} AS ret_5, {change(10)} AS ret_10, {change(10)} AS mom_10, {change(20)} AS mom_20,
           macd_hist, close / nullif({mean('close', 20)}, 0) - 1 AS close_sma20,
           close / nullif({mean('close', 50)}, 0) - 1 AS close_sma50, adx14 AS adx_14,
           CAST(lead(close, 5) OVER ({W}) / nullif(close, 0) - 1 > 0 AS INTEGER) AS label
    FROM (SELECT bars.*, macd_hist, adx14 FROM bars JOIN bars_ema USING (ticker, date)) a""", "bars", "bars_ema")
view("panel", f"""
    SELECT ticker, date, close, ret_1, ret_2, ret_3, ret_5, ret_10, mom_10, mom_20, {std('ret_1', 10)} AS vol_10,
           {std('ret_1', 20)} AS vol_20, macd_hist, close_sma20, close_sma50, adx_14, label FROM panel0""", "panel0")
view("warm", """
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM panel
    WHERE ret_1 + ret_2 + ret_3 + ret_5 + ret_10 + mom_10 + mom_20 + vol_10 + vol_20 + macd_hist + close_sma20
          + close_sma50 + adx_14 IS NOT NULL""", "panel")
view("baseline", """
    SELECT ticker, date, CASE WHEN mom_10 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prob_up, label AS actual
    FROM warm WHERE i >= 120 AND (i - 120) % 5 = 0 AND label IS NOT NULL""", "warm")
view("preds", """
    SELECT ticker, date, greatest(0.05::DOUBLE, least(0.95::DOUBLE, round(
             (rank() OVER (PARTITION BY date ORDER BY mom_20) + (count(*) OVER (PARTITION BY date, mom_20) - 1) / 2.0::DOUBLE)
             / count(*) OVER (PARTITION BY date), 4))) AS prob_up, label AS actual
    FROM panel WHERE mom_20 IS NOT NULL AND label IS NOT NULL""", "panel")
view("reliab", """
    SELECT bin, count(*) AS n, avg(prob_up) AS mean_pred, avg(actual) AS frac_up FROM (
      SELECT *, CAST((prob_up >= 0.1::DOUBLE)::INT + (prob_up >= 0.2::DOUBLE)::INT
               + (prob_up >= 0.30000000000000004::DOUBLE)::INT + (prob_up >= 0.4::DOUBLE)::INT
               + (prob_up >= 0.5::DOUBLE)::INT + (prob_up >= 0.6000000000000001::DOUBLE)::INT
               + (prob_up >= 0.7000000000000001::DOUBLE)::INT + (prob_up >= 0.8::DOUBLE)::INT
               + (prob_up >= 0.9::DOUBLE)::INT AS INTEGER) AS bin FROM preds) GROUP BY bin""", "preds")

# ---- sentiment ----
view("heads", """
    SELECT concat('S', user_id % (SELECT count(*) FROM supplier)) AS ticker, ts - INTERVAL 24 YEARS AS published_at,
           event_type AS text, props AS url, event_id AS seq,
           CASE event_type WHEN 'purchase' THEN 0.75::DOUBLE WHEN 'signup' THEN 0.75::DOUBLE
                WHEN 'error' THEN -0.75::DOUBLE ELSE 0.0::DOUBLE END AS signed FROM events""")
view("senti", """
    SELECT rebalance_date, ticker, avg(signed) AS sentiment FROM heads JOIN calendar
    ON published_at <= rebalance_date AND published_at > rebalance_date - INTERVAL 40 DAYS GROUP BY ALL""",
     "heads", "calendar")
view("moods", """
    SELECT ticker, avg(signed) AS aggregate, count(*) AS n_total FROM heads
    WHERE published_at <= TIMESTAMP '2000-01-31' AND published_at > TIMESTAMP '2000-01-01' GROUP BY ticker""", "heads")


def build(final, *needs):
    """``final`` with every view it needs in front, in order of definition."""
    wanted, todo = set(), list(needs)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo.extend(VIEWS[name][1])
    ctes = [f"{name} AS ({VIEWS[name][0]})" for name in VIEWS if name in wanted]
    return f"WITH RECURSIVE {', '.join(ctes)} {final}" if ctes else final
