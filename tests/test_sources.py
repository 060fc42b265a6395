import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import by, calendar, close_bars, day
from tidemark import schemas, session
from tidemark.sources import news, sinks, tables

CSV = """Date,Open,High,Low,Close,Adj Close,Volume,Dividends,Stock Splits
2021-03-12 00:00:00-05:00,10,11,9,10,9.5,100,0,0
2021-03-15 00:00:00-04:00,10,11,9,,9.5,100,0,0
not a date,10,11,9,10,9.5,100,0,0
2021-03-16 00:00:00-04:00,20,22,18,20,20,nan,0,0
"""


@pytest.fixture()
def price_dir(tmp_path):
    (tmp_path / "QQ.csv").write_text(CSV)
    (tmp_path / "rr.csv").write_text(CSV)
    return str(tmp_path)


def test_price_files(spark, price_dir):
    df = tables.read_price_files(spark, price_dir)
    assert df.schema == schemas.BARS or df.columns == schemas.BARS.fieldNames()
    assert {r.ticker for r in df.collect()} == {"QQ", "RR"} and df.count() == 6
    got = by(tables.load_prices(df, [" qq "]), "date")
    assert set(got) == {dt.date(2021, 3, 12), dt.date(2021, 3, 16)}
    first = got[dt.date(2021, 3, 12)]
    assert first.close == pytest.approx(9.5) and first.high == pytest.approx(11 * .95) and first.volume == 100
    assert got[dt.date(2021, 3, 16)].volume is None


def test_offsets_become_utc(spark):
    df = spark.createDataFrame([("2021-03-12 14:30:00-05:00",), ("2021-03-15 14:30:00-04:00",), ("x",)], "t string")
    got = [r[0] for r in df.select(tables.utc_timestamp("t").cast("string")).collect()]
    assert got == ["2021-03-12 19:30:00", "2021-03-15 18:30:00", None]
    assert [r[0] for r in df.select(tables.utc_date("t")).collect()] == [
        dt.date(2021, 3, 12), dt.date(2021, 3, 15), None]


def test_windows_are_inclusive_and_pushed(spark, tmp_path):
    sinks.write_bars(schemas.conform(close_bars(spark, {"A": range(1, 40), "B": range(1, 40)}), schemas.BARS),
                     str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars"))
    got = tables.date_window(tables.keep_tickers(back, ["A"]), day(3), day(5))
    assert sorted(r.close for r in got.collect()) == [4, 5, 6]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(ticker,A)" in plan.replace(" ", "") and "GreaterThanOrEqual(date" in plan


def test_no_adjusted_close_leaves_prices(spark):
    bars = close_bars(spark, {"A": [1, 2]})
    assert tables.load_prices(bars).collect() == bars.collect()
    zero = spark.createDataFrame([("A", day(0), 0.0, 5.0)], "ticker string, date date, close double, adj_close double")
    assert tables.total_return_basis(zero).first().close is None


def test_last_duplicate_wins(spark):
    df = spark.createDataFrame([("A", day(0), 1.0, 1), ("A", day(0), 2.0, 3), ("A", day(0), 3.0, 2)],
                               "ticker string, date date, close double, seq int")
    assert [tuple(r) for r in tables.last_per_day(df, "seq").collect()] == [("A", day(0), 2.0)]


def test_history_status_last_rows_and_coverage(spark):
    bars = close_bars(spark, {"A": range(10), "B": range(3)})
    st = by(tables.history_status(bars, 5), "ticker")
    assert st["A"].status == "OK" and st["B"].status.endswith("got 3")
    assert tables.last_rows(bars, 2).count() == 4
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0)], "pe double, pb double")
    got = {r.feature: r.coverage for r in tables.coverage(df, ["pe", "pb"]).collect()}
    assert got == {"pe": 1.0, "pb": .5}
    assert tables.fundamental_coverage(tables.coverage(df, ["pe", "pb"])).first().warn is False
    assert tables.historical_bars(bars, days=3).groupBy("ticker").count().first()["count"] == 3


def test_sectors_merge(spark):
    old = spark.createDataFrame([("a", "Tech"), ("B", "nan"), ("C", " ")], schemas.SECTORS)
    new = spark.createDataFrame([("A", "Other"), ("B", "Energy"), ("C", None)], schemas.SECTORS)
    got = {r.ticker: r.sector for r in tables.load_sectors(old, fresh=new).collect()}
    assert got == {"A": "Tech", "B": "Energy"}
    assert tables.load_sectors(old, ["B"], new).count() == 1


def test_news_payloads(spark):
    rows = [
        (1, '{"title":"Flat","providerPublishTime":1600000000,"link":"http://a"}'),
        (2, '{"content":{"title":"Nested","pubDate":"2020-09-13T12:26:40Z","canonicalUrl":{"url":"http://b"}}}'),
        (3, '{"content":{"title":"Text","displayTime":"2020-09-13T12:26:40Z","clickThroughUrl":"http://c"}}'),
        (4, '{"content":{"pubDate":"2020-09-13T12:26:40Z"}}'), (5, '{"title":"No time"}'),
        (6, '{"content":{"title":"No url","pubDate":"2020-09-13T12:26:40Z"}}')]
    got = by(news.parse_payloads(spark.createDataFrame(rows, "seq int, payload string")), "seq")
    assert set(got) == {1, 2, 3, 6}
    assert [got[i].url for i in (1, 2, 3, 6)] == ["http://a", "http://b", "http://c", ""]
    assert len({got[i].published_at for i in got}) == 1 and got[2].text == "Nested"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.5)], "ticker string, x double")
    sinks.write_summary_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_table(df, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["ticker"] == "A"
    assert spark.read.json(str(tmp_path / "j")).first()["x"] == spark.read.parquet(str(tmp_path / "p")).first()["x"]


def test_nan_never_passes_the_source(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "close double, k int")
    assert schemas.nulls_for_nan(df).first().close is None
    assert schemas.empty(spark, schemas.FUNDAMENTALS).count() == 0
    with pytest.raises(ValueError):
        schemas.require(df, "ticker")


def test_staged_tables_live_in_the_named_folder(spark, tmp_path):
    df = session.stage(spark.range(3).withColumn("d", F.lit(1.5)), "three")
    assert df.count() == 3 and spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert calendar(spark, "2020-01-31").count() == 1
