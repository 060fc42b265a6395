"""Sinks. Raw prices stay raw; the adjusted layer is always derived, so it is never applied twice. Each can be
written again with the same rows and holds them once: a failed and repeated delivery leaves no trace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark import session


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite", years: str = "static") -> None:
    """Raw bars by year, sorted inside each file so that ticker filters skip row groups. With ``years`` dynamic only
    the years of ``bars`` are replaced."""
    (bars.withColumn("year", F.year("date"))
     .repartition("year", F.pmod(F.xxhash64("ticker"), F.lit(64)))
     .sortWithinPartitions("year", "ticker", "date")
     .write.mode(mode).option("partitionOverwriteMode", years).partitionBy("year").parquet(path))


def read_bars(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Bars as they were written; filters on ``year`` read only these folders."""
    typed = T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])
    return spark.read.schema(typed).parquet(path).select(*schema.names)


def merge_bars(bars: DataFrame, path: str) -> None:
    """Put delivered bars, one per ticker and date, in place of stored ones of that ticker and date; all others stay.

    Only the years of the delivery are read and replaced. Replaced years are built aside first, so the
    table is never read while it is written, and a repeated delivery ends at the same rows.
    """
    spark = bars.sparkSession
    new = session.stage(bars, "delivery")
    years = [r[0] for r in new.select(F.year("date")).distinct().collect()]  # a few numbers
    typed = T.StructType([*bars.schema.fields, T.StructField("year", T.IntegerType())])
    stored = spark.read.schema(typed).parquet(path).where(F.col("year").isin(years)).select(*bars.columns)
    kept = stored.join(new.select("ticker", "date"), ["ticker", "date"], "left_anti")
    write_bars(session.stage(kept.select(*bars.columns).union(new), "merged"), path, years="dynamic")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch replaces the folder of its own id, so a batch that is run again after a
    failure is stored once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path))

    return write


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    typed = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    return spark.read.schema(typed).parquet(path).select(*schema.names)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_summary_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
