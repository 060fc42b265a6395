"""One file per ticker as a source, and bars staged by ticker."""

import datetime as dt

from tests.conftest import by, calendar, close_bars, day, range_bars
from tidemark import schemas, session
from tidemark.operators import asof, features, indicators
from tidemark.sources import tables, ticker_files
from pyspark.sql.datasource import EqualTo, GreaterThan, In

HEADER = "Date,Open,High,Low,Close,Adj Close,Volume,Dividends,Stock Splits\n"
GOOD = HEADER + "2021-03-12 00:00:00-05:00,10,11,9,10,9.5,100,0,0\n\n2021-03-15,1,2,1,2,2,nan,,0\n"
BAD = HEADER + ("not a date,10,11,9,10,9.5,100,0,0\n2021-03-16,20,22,18,n/a,20,5,0,0\n2021-03-17,20,22\n"
                '2021-03-18,1,2,1,2,2,"1,000",0,0\n,1,2,1,2,2,3,0,0\n2021-03-19,1,2,1,2,2,1e3,0,0\n')


def _folder(tmp_path):
    (tmp_path / "good.csv").write_text(GOOD)
    (tmp_path / " bad .csv").write_text(BAD)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text(HEADER)
    (tmp_path / "short.csv").write_text("Close,Date\n5,2021-03-12\n")
    (tmp_path / "readme.txt").write_text("no prices")
    return str(tmp_path)


def test_rows_and_problems(spark, tmp_path):
    rows = ticker_files.price_rows(spark, _folder(tmp_path)).cache()
    got = by(rows, "ticker", "row")
    assert {k: v.problem for k, v in got.items()} == {
        ("GOOD", 1): None, ("GOOD", 2): None, ("SHORT", 1): None, ("BAD", 1): "date", ("BAD", 2): "close",
        ("BAD", 3): "columns", ("BAD", 4): "volume", ("BAD", 5): "date", ("BAD", 6): None}
    assert got["GOOD", 2].volume is None and got["BAD", 6].volume == 1000 and got["SHORT", 1].close == 5.0
    report = by(ticker_files.file_report(rows), "ticker")
    assert tuple(report["BAD"]) == ("BAD", 6, 5, 2, 1) and tuple(report["GOOD"]) == ("GOOD", 2, 0, 0, None)
    bars = ticker_files.bars_of(rows)
    assert bars.schema == schemas.BARS and bars.count() == 7
    rows.unpersist()


def test_same_rows_as_the_text_scan(spark, tmp_path):
    (tmp_path / "QQ.csv").write_text(GOOD.replace("\n\n", "\n"))
    (tmp_path / "rr.csv").write_text(HEADER + "2021-03-16 20:00:00-05:00,20,22,18,20,20,7,0,0\n")
    path = str(tmp_path)
    theirs = sorted(map(repr, tables.read_price_files(spark, path).collect()))
    assert theirs == sorted(map(repr, ticker_files.bars_of(ticker_files.price_rows(spark, path)).collect())) and len(theirs) == 3


def test_filters_choose_files(spark, tmp_path):
    path = _folder(tmp_path)
    rows = ticker_files.price_rows(spark, "file://" + path, target_bytes=1)
    assert rows.rdd.getNumPartitions() == 5
    one = rows.where("ticker = 'GOOD' and close > 5")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1
    none = rows.where("ticker = 'NOBODY'")
    assert none.count() == 0
    reader = ticker_files.TickerFilesReader(path, 1)
    date = GreaterThan(("date",), dt.date(2021, 1, 1))
    assert list(reader.pushFilters([In(("ticker",), ("GOOD", "BAD")), date, EqualTo(("ticker",), "BAD")])) == [date]
    assert [p.files for p in reader.partitions()] == [[("BAD", path + "/ bad .csv")]]
    whole = ticker_files.TickerFilesReader(path, 1 << 20).partitions()
    assert [t for t, _ in whole[0].files] == ["BAD", "BARE", "EMPTY", "GOOD", "SHORT"] and len(whole) == 1


def test_written_files_come_back(spark, tmp_path):
    bars = schemas.conform(close_bars(spark, {"A": [1, 2.5, 3], "B/C D": [4]}), schemas.BARS)
    ticker_files.write_ticker_files(bars, str(tmp_path / "out"))
    rows = ticker_files.price_rows(spark, str(tmp_path / "out"))
    assert sorted(map(repr, ticker_files.bars_of(rows).collect())) == sorted(map(repr, bars.collect()))
    assert rows.where("problem is not null").count() == 0


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning(ticker" in x]


def test_bars_by_ticker_are_not_shuffled_again(spark):
    flat = {t: [100 + (i * k) % 13 for i in range(80)] for k, t in enumerate("ABCDEF", 1)}
    bars = range_bars(spark, flat)
    staged = session.stage_bucketed(bars, "bars", "ticker", ["ticker", "date"], 4)
    assert sorted(map(repr, staged.collect())) == sorted(map(repr, bars.collect()))
    dates = calendar(spark, "2020-01-31", "2020-02-29", "2020-03-10")
    plain = session.stage(bars, "bars")
    for run in (indicators.technical_frame, lambda b: features.forward_returns(b, dates),
                lambda b: asof.period_returns(b, spark.createDataFrame([(day(3), day(40))], "entry_date date, exit_date date"))):
        assert _exchanges(run(plain)) and not _exchanges(run(staged))
        assert sorted(map(repr, run(plain).collect())) == sorted(map(repr, run(staged).collect()))
