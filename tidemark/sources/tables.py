"""Scans and the cleaning every scan applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemark import schemas
from tidemark.functions.numeric import safe_div, to_number

# Column names of the per-ticker price files.
PRICE_FILE_COLUMNS = {
    "Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close",
    "Adj Close": "adj_close", "Volume": "volume", "Dividends": "dividends",
    "Stock Splits": "stock_splits",
}


def normalise_ticker(c) -> Column:
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def utc_date(c: str) -> Column:
    """Calendar day, in UTC, of a timestamp text that may carry any offset; NULL if unreadable."""
    return F.to_date(F.try_to_timestamp(F.col(c)))


def utc_timestamp(c: str) -> Column:
    return F.try_to_timestamp(F.col(c))


def keep_tickers(df: DataFrame, tickers=None) -> DataFrame:
    """``tickers`` is a list (becomes a pushed ``IN`` filter) or a DataFrame (a semi join)."""
    if tickers is None:
        return df
    if isinstance(tickers, DataFrame):
        return df.join(tickers.select(normalise_ticker("ticker").alias("ticker")), "ticker", "left_semi")
    return df.where(F.col("ticker").isin([t.upper().strip() for t in tickers]))


def date_window(df: DataFrame, start=None, end=None, date: str = "date") -> DataFrame:
    """Inclusive on both sides; an absent bound is open."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(str(start)).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(str(end)).cast("date"))
    return df


def drop_missing_close(df: DataFrame) -> DataFrame:
    return schemas.require(df, "close").where(F.col("close").isNotNull())


def last_per_day(df: DataFrame, ingest: str, keys=("ticker", "date")) -> DataFrame:
    """One bar per key: the last one ingested. An aggregate, so duplicates meet on the map side
    and a key with very many of them never reaches one task as a group."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.col(ingest)).alias("_row"))
            .select(*keys, *[F.col("_row")[c].alias(c) for c in rest if c != ingest]))


def total_return_basis(df: DataFrame) -> DataFrame:
    """Scale OHLC by adj_close/close; volume stays a share count."""
    if "adj_close" not in df.columns:
        return df
    factor = safe_div("adj_close", "close")
    return df.select([(F.col(c) * factor).alias(c) if c in ("open", "high", "low", "close") else F.col(c)
                      for c in df.columns])


def read_price_files(spark: SparkSession, path: str) -> DataFrame:
    """One csv per ticker; the ticker is the file name. Unreadable dates and numbers become NULL
    and such rows are dropped."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in PRICE_FILE_COLUMNS])
    raw = spark.read.csv(path, header=True, schema=text, mode="PERMISSIVE", enforceSchema=False)
    raw = raw.withColumn("ticker", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))
    named = raw.select(
        normalise_ticker("ticker").alias("ticker"), utc_date("Date").alias("date"),
        *[to_number(c).alias(n) for c, n in PRICE_FILE_COLUMNS.items() if c != "Date"])
    return schemas.conform(named.where(F.col("date").isNotNull()), schemas.BARS)


def load_prices(bars: DataFrame, tickers=None, start=None, end=None, adjust: bool = True,
                ingest: str | None = None) -> DataFrame:
    """Price scan: wanted tickers, priced rows, total-return basis, date window.

    The window applies before any indicator, so it is pushed into the scan. ``ingest`` names the column
    that orders deliveries: of several priced rows of a ticker and day the last delivered stays. Without it
    the table must hold one row per ticker and day.
    """
    df = drop_missing_close(keep_tickers(date_window(bars, start, end), tickers))
    if ingest:
        df = last_per_day(df, ingest)
    return total_return_basis(df) if adjust else df


def historical_bars(bars: DataFrame, months: int | None = None, days: int | None = None, as_of=None) -> DataFrame:
    """The trailing ``months`` or ``days`` up to ``as_of`` (default: the table's last date)."""
    end = F.lit(str(as_of)).cast("date") if as_of else bars.agg(F.max("date")).scalar()
    first = F.add_months(end, -months) if months else F.date_sub(end, days or 0)
    return drop_missing_close(bars).where((F.col("date") > first) & (F.col("date") <= end))


def intraday_bars(ticks: DataFrame, minutes: int = 5, days: int = 5, as_of=None) -> DataFrame:
    """OHLC bars of ``minutes`` over the last ``days``. Ticks fold into bars by partial
    aggregation; afterwards a ticker holds at most ``days * 1440 / minutes`` rows."""
    end = F.lit(str(as_of)).cast("timestamp") if as_of else ticks.agg(F.max("ts")).scalar()
    order = F.struct("ts", "seq")
    first = end - F.make_dt_interval(F.lit(days))
    return (
        ticks.where(F.col("price").isNotNull() & (F.col("ts") > first) & (F.col("ts") <= end))
        .groupBy("ticker", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"),
             F.min("price").alias("low"), F.max_by("price", order).alias("close"),
             F.count("*").alias("n_ticks"))
        .select("ticker", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"),
                "open", "high", "low", "close", "n_ticks")
    )


def load_sectors(table: DataFrame, tickers=None, fresh: DataFrame | None = None) -> DataFrame:
    """Ticker -> sector without blanks. Cached entries win; ``fresh`` fills only missing tickers."""
    def clean(df: DataFrame) -> DataFrame:
        s = F.trim("sector")
        return (df.select(normalise_ticker("ticker").alias("ticker"), s.alias("sector"))
                .where(s.isNotNull() & (s != "") & (F.lower(s) != "nan"))
                .groupBy("ticker").agg(F.max("sector").alias("sector")))

    known = clean(table)
    if fresh is not None:
        known = known.unionByName(clean(fresh).join(known, "ticker", "left_anti"))
    return keep_tickers(known, tickers)


def last_rows(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """The last ``n`` bars of each ticker (Spark limits each map task's groups to ``n`` rows
    before the shuffle)."""
    w = Window.partitionBy("ticker").orderBy(F.col(date).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def history_status(bars: DataFrame, min_bars: int) -> DataFrame:
    """One row per ticker saying whether its history is long enough."""
    return (
        bars.groupBy("ticker").agg(F.count("close").alias("n_bars"),
                                   F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        .withColumn("status", F.when(F.col("n_bars") >= min_bars, F.lit("OK")).otherwise(
            F.concat(F.lit(f"ERROR: need at least {min_bars} rows, got "), F.col("n_bars").cast("string"))))
    )


def coverage(df: DataFrame, columns) -> DataFrame:
    """Share of non-NULL cells per column, one pass for all columns."""
    wide = df.agg(*[F.coalesce(F.avg(F.col(c).isNotNull().cast("double")), F.lit(0.0)).alias(c)
                    for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage")) for c in columns])
    return wide.select(F.inline(pairs))


def fundamental_coverage(coverage_table: DataFrame, warn_below: float = 0.20) -> DataFrame:
    fund = coverage_table.where(F.col("feature").isin(schemas.FUNDAMENTAL_FEATURES))
    return fund.agg(F.avg("coverage").alias("mean_coverage")).withColumn(
        "warn", F.col("mean_coverage") < warn_below)


def complete_cases(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))
