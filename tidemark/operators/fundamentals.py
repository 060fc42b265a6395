"""Point-in-time fundamentals: statements -> tidy rows with trailing figures, ratios and the date
from which they may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import schemas
from tidemark.functions.numeric import safe_div, to_number

REPORTING_LAG_DAYS = 60

# Statement labels in order of preference for each item.
LABELS = {
    "net_income": ["Net Income", "Net Income Common Stockholders", "NetIncome"],
    "total_revenue": ["Total Revenue", "Operating Revenue", "TotalRevenue"],
    "total_equity": ["Stockholders Equity", "Total Stockholder Equity", "Common Stock Equity",
                     "Total Equity Gross Minority Interest"],
    "total_debt": ["Total Debt", "Net Debt"],
}


def _trailing_sum(c: str, order: str, n: int, *by: str) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, F.sum(c).over(w))


def pick_items(items: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Long label/value statements -> one row per (ticker, period_end, freq).

    The preferred label is chosen per statement (ticker and frequency), as a provider's statement
    has one row per label; statements without a net-income row are dropped.
    """
    entries = [F.struct(F.lit(item).alias("item"), F.lit(label).alias("label"), F.lit(i).alias("preference"))
               for item, labels in LABELS.items() for i, label in enumerate(labels)]
    match = F.filter(F.array(*entries), lambda e: e["label"] == F.col("label"))
    known = items.select("ticker", "period_end", "freq", "value", F.inline(match).alias("item", "_l", "preference")
                         ).drop("_l")
    chosen = known.groupBy("ticker", "freq", "item").agg(F.min("preference").alias("preference"))
    kept = known.join(chosen, ["ticker", "freq", "item", "preference"], "left_semi")
    wide = kept.groupBy("ticker", "period_end", "freq").agg(*[
        F.max(F.when(F.col("item") == item, F.col("value"))).alias(item) for item in LABELS])
    has_income = chosen.where(F.col("item") == "net_income")
    wide = wide.join(has_income, ["ticker", "freq"], "left_semi")
    if shares is not None:
        wide = wide.join(shares.select("ticker", "shares_outstanding"), "ticker", "left")
    return schemas.conform(wide, schemas.STATEMENTS)


def coerced(statements: DataFrame) -> DataFrame:
    """Numbers from whatever the provider sent (text becomes NULL); no ``freq`` means quarterly."""
    schemas.require(statements, "ticker", "period_end")
    have = set(statements.columns)
    freq = F.coalesce("freq", F.lit("quarterly")) if "freq" in have else F.lit("quarterly")
    return schemas.nulls_for_nan(statements.select(
        "ticker", F.col("period_end").cast("date").alias("period_end"), freq.alias("freq"),
        *[(to_number(c) if c in have else F.lit(None).cast("double")).alias(c) for c in schemas.RAW_ITEMS]))


def with_ratios(statements: DataFrame) -> DataFrame:
    """Trailing income, ratios and growth, each frequency with its own look-back.

    Windows are per (ticker, freq): a company's reporting periods.
    """
    w = Window.partitionBy("ticker", "freq").orderBy("period_end")
    annual = F.col("freq") == "annual"
    rolled = _trailing_sum("net_income", "period_end", 4, "ticker", "freq")
    df = statements.withColumn(
        "ttm_net_income", F.when(annual, F.col("net_income")).otherwise(rolled)
    ).withColumn(
        "_prior", F.when(annual, F.lag("net_income", 1).over(w)).otherwise(F.lag("net_income", 4).over(w)))
    return (
        df.withColumn("roe", safe_div("ttm_net_income", "total_equity"))
        .withColumn("net_margin", safe_div("net_income", "total_revenue"))
        .withColumn("debt_to_equity", safe_div("total_debt", "total_equity"))
        .withColumn("earnings_growth_yoy", safe_div(F.col("net_income") - F.col("_prior"), F.abs("_prior")))
        .drop("_prior"))


def tidy(statements: DataFrame, reporting_lag_days: int = REPORTING_LAG_DAYS) -> DataFrame:
    """One row per (ticker, period_end), a quarterly row winning over an annual one, usable from
    ``period_end + reporting_lag_days``."""
    df = with_ratios(coerced(statements))
    rest = [c for c in df.columns if c not in ("ticker", "period_end", "freq")]
    one = (df.groupBy("ticker", "period_end")
           .agg(F.max_by(F.struct(*rest), (F.col("freq") == "quarterly").cast("int")).alias("_row"))
           .select("ticker", "period_end", F.date_add("period_end", reporting_lag_days).alias("available_date"),
                   *[F.col("_row")[c].alias(c) for c in rest]))
    return schemas.conform(one, schemas.FUNDAMENTALS)


def with_ttm(fundamentals: DataFrame) -> DataFrame:
    """Keep a given ``ttm_net_income``; where it is missing use the sum of the last four rows."""
    rolled = _trailing_sum("net_income", "period_end", 4, "ticker")
    given = F.col("ttm_net_income") if "ttm_net_income" in fundamentals.columns else F.lit(None).cast("double")
    return fundamentals.withColumn("ttm_net_income", F.coalesce(given, rolled))


def valuation_columns(price="close") -> dict[str, Column]:
    """Valuation and quality features of a row that has a price and the current filing."""
    c = F.col
    cap = F.when(c("shares_outstanding") > 0, c(price) * c("shares_outstanding"))
    return {
        "pe": F.when(c("ttm_net_income") > 0, cap / c("ttm_net_income")),
        "pb": F.when(c("total_equity") > 0, cap / c("total_equity")),
        "roe": c("roe"),
        "earnings_growth": c("earnings_growth_yoy"),
        "net_margin": c("net_margin"),
        "debt_to_equity": c("debt_to_equity"),
    }
