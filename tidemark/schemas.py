"""Table contracts. Missing values are NULL everywhere; NaN is turned into NULL at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


_TYPES = {"STRING": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(),
          "DOUBLE": T.DoubleType(), "BIGINT": T.LongType()}


def _struct(spec: str) -> T.StructType:
    pairs = (field.split() for field in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BARS = _struct(
    "ticker STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "adj_close DOUBLE, volume BIGINT, dividends DOUBLE, stock_splits DOUBLE"
)
STATEMENT_ITEMS = _struct("ticker STRING, period_end DATE, freq STRING, label STRING, value DOUBLE")
STATEMENTS = _struct(
    "ticker STRING, period_end DATE, freq STRING, net_income DOUBLE, total_revenue DOUBLE, "
    "total_equity DOUBLE, total_debt DOUBLE, shares_outstanding DOUBLE"
)
FUNDAMENTALS = _struct(
    "ticker STRING, period_end DATE, available_date DATE, net_income DOUBLE, total_revenue DOUBLE, "
    "total_equity DOUBLE, total_debt DOUBLE, shares_outstanding DOUBLE, ttm_net_income DOUBLE, "
    "roe DOUBLE, net_margin DOUBLE, debt_to_equity DOUBLE, earnings_growth_yoy DOUBLE"
)
SECTORS = _struct("ticker STRING, sector STRING")
HEADLINES = _struct("ticker STRING, published_at TIMESTAMP, text STRING, source STRING, url STRING")
TICKS = _struct("ticker STRING, ts TIMESTAMP, price DOUBLE, seq BIGINT")

DISTRIBUTION = _struct("label STRING, score DOUBLE")

RAW_ITEMS = ["net_income", "total_revenue", "total_equity", "total_debt", "shares_outstanding"]
RATIOS = ["ttm_net_income", "roe", "net_margin", "debt_to_equity", "earnings_growth_yoy"]

TECHNICAL_FEATURES = [
    "mom_1m", "mom_3m", "mom_6m", "mom_12m", "reversal_5d", "mom_risk_adj", "high_52w",
    "volatility", "macd", "adx",
]
FUNDAMENTAL_FEATURES = ["pe", "pb", "roe", "earnings_growth", "net_margin", "debt_to_equity"]
FEATURES = TECHNICAL_FEATURES + FUNDAMENTAL_FEATURES


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN compares greater than every number in Spark, so it may not travel past the sources."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in floats else F.col(c)
                      for c in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto ``schema``: columns in order and cast, absent ones as NULL."""
    have = set(df.columns)
    return nulls_for_nan(df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]))


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
