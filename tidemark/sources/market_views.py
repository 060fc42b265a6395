"""The driver's warehouse tables seen as market data (bars, statements, sectors, ticks, news).

Every view is a distributed aggregation of the given tables. A ticker is a supplier; its daily
price is a walk whose step is an exact integer, and prices are kept to three decimals so that
equal prices are equal bit for bit in any engine.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark import schemas

MARKET = "S0"

#: Line items behind the bars of one task. A window over bars takes about 1 KB a row, so a task holds some 200 MB.
TASK_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ticker(c) -> F.Column:
    return F.concat(F.lit("S"), c.cast("string"))


def bar_tasks(spark: SparkSession, sf_dir: str, task_rows: int = TASK_ROWS) -> int:
    """Partitions that bars are dealt over by ticker: one per ``task_rows`` line items, and for small tables up to one per
    core. Shuffled bars are so small that partitions sized by their bytes would give a task millions of rows."""
    rows = table(spark, sf_dir, "lineitem").count()  # from the footers
    cores = spark.sparkContext.defaultParallelism
    return max(1, math.ceil(rows / task_rows), min(cores, 10 * rows // task_rows))


def bars(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Daily bars. Line items collapse to one row per (ticker, date) before any window runs, so a
    ticker's window holds at most one row per calendar day however many line items it has. They come dealt by ticker over
    ``tasks`` partitions (default: ``bar_tasks``), in which later windows by ticker run without another shuffle."""
    daily = (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", F.to_date("l_shipdate").alias("date"),
                (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("step"),
                F.col("l_quantity").cast("bigint").alias("quantity"), F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"))
        .groupBy("l_suppkey", "date")
        .agg(F.sum("step").alias("step"), F.sum("quantity").alias("volume"), F.max("tax").alias("spread"))
        .withColumn("ticker", _ticker(F.col("l_suppkey")))
        .repartition(tasks or bar_tasks(spark, sf_dir), "ticker")
    )
    w = Window.partitionBy("ticker").orderBy("date")
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.col("date")) / F.lit(365.25)
    priced = (
        daily
        .withColumn("walk", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("close", F.round(100 * F.exp(0.006 * F.col("walk")), 3))
        .withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    )
    # A quarter of the tax rate above and below, in whole thousandths.
    priced = (priced.withColumn("_top", F.round(F.greatest("open", "close") * 1000).cast("bigint"))
              .withColumn("_bottom", F.round(F.least("open", "close") * 1000).cast("bigint")))
    return priced.select(
        "ticker", "date", "open",
        (F.expr("_top * (400 + spread) div 400") / 1000.0).alias("high"),
        (F.expr("_bottom * (400 - spread) div 400") / 1000.0).alias("low"),
        "close",
        F.round(F.col("close") * F.pow(F.lit(0.98), age), 3).alias("adj_close"),
        "volume",
        F.lit(0.0).alias("dividends"), F.lit(0.0).alias("stock_splits"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly and annual statements. Money adds up in exact integers, then becomes double."""
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part").select("p_partkey", cents("p_retailprice").alias("retail")),
              F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_suppkey", F.to_date("l_shipdate").alias("date"),
            cents("l_extendedprice").alias("price"),
            cents("l_discount").alias("off"), cents("l_tax").alias("tax"),
            F.col("l_quantity").cast("bigint").alias("quantity"), "retail")
    )
    quarters = lines.groupBy("l_suppkey", F.trunc("date", "quarter").alias("quarter")).agg(
        F.sum("price").alias("price"),
        F.sum(F.col("price") * (100 - F.col("off")) - 150 * F.col("quantity") * F.col("retail")).alias("income"),
        F.sum(F.col("price") * F.col("tax")).alias("debt"),
    )
    years = quarters.groupBy("l_suppkey", F.trunc("quarter", "year").alias("year")).agg(
        F.sum("price").alias("price"), F.sum("income").alias("income"), F.sum("debt").alias("debt"))
    periods = (
        quarters.select("l_suppkey", F.last_day(F.add_months("quarter", 2)).alias("period_end"),
                F.lit("quarterly").alias("freq"), "price", "income", "debt")
        .unionByName(years.select(
            "l_suppkey", F.last_day(F.add_months("year", 11)).alias("period_end"),
            F.lit("annual").alias("freq"), "price", "income", "debt"))
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    key = F.col("l_suppkey")
    joined = periods.join(supplier, key == F.col("s_suppkey")).select(
        _ticker(key).alias("ticker"), "period_end", "freq",
        (F.col("income") / F.lit(10000.0)).alias("net_income"),
        (F.col("price") / F.lit(100.0)).alias("total_revenue"),
        (1000 * F.col("s_acctbal")).alias("total_equity"),
        (F.col("debt") / F.lit(1000.0)).alias("total_debt"),
        F.when(key % 7 != 0, 1e6 * (1 + key % 10)).alias("shares_outstanding"),
    )
    return schemas.conform(joined, schemas.STATEMENTS)


def statement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statements as a long label/value table, as a provider would deliver them: most
    items under their first label, some under an alternative, some under both."""
    st = statements(spark, sf_dir)
    odd = F.quarter("period_end") % 2 == 1
    pairs = F.array(
        F.struct(F.when(odd, "Net Income Common Stockholders").otherwise("Net Income").alias("label"),
                 F.col("net_income").alias("value")),
        F.struct(F.when(odd, "Net Income").alias("label"), (F.col("net_income") - 1).alias("value")),
        F.struct(F.when(odd, "Operating Revenue").otherwise("Total Revenue").alias("label"),
                 F.col("total_revenue").alias("value")),
        F.struct(F.lit("Common Stock Equity").alias("label"), F.col("total_equity").alias("value")),
        F.struct(F.when(odd, "Total Debt").otherwise("Net Debt").alias("label"),
                 F.col("total_debt").alias("value")),
    )
    return (st.select("ticker", "period_end", "freq", F.inline(pairs))
            .where(F.col("label").isNotNull()))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with its region; some come with a blank sector, as providers deliver them."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(_ticker(F.col("s_suppkey")).alias("ticker"),
                F.when(F.col("s_suppkey") % 11 == 0, F.lit("  ")).otherwise(F.trim("r_name")).alias("sector"))
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("double").alias("price"),
        F.col("event_id").alias("seq"),
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as headlines, moved 24 years back so that they fall inside the bars' calendar."""
    n_suppliers = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    return table(spark, sf_dir, "events").select(
        _ticker(F.col("user_id") % n_suppliers).alias("ticker"),
        (F.col("ts").cast("timestamp") - F.expr("INTERVAL 24 YEARS")).alias("published_at"),
        F.col("event_type").alias("text"),
        F.lit("events").alias("source"),
        F.col("props").alias("url"),
        F.col("event_id").alias("seq"),
    )


def news_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events wrapped as provider JSON: even ids in the flat schema, odd ids nested."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    url = F.concat(F.lit("https://news.example/"), F.col("event_id").cast("string"))
    flat = F.to_json(F.struct(
        F.col("event_type").alias("title"),
        F.unix_seconds("at").alias("providerPublishTime"), url.alias("link")))
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    nested_struct = F.to_json(F.struct(F.struct(
        F.col("event_type").alias("title"), stamp.alias("pubDate"),
        F.struct(url.alias("url")).alias("canonicalUrl")).alias("content")))
    nested_text = F.to_json(F.struct(F.struct(
        F.col("event_type").alias("title"), stamp.alias("displayTime"),
        url.alias("clickThroughUrl")).alias("content")))
    kind = F.col("event_id") % 4
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.when(kind % 2 == 0, flat).when(kind == 1, nested_struct).otherwise(nested_text).alias("payload"))
