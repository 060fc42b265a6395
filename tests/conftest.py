import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark import session
    s = session.build("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stages"))})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def day(i, start=dt.date(2020, 1, 1)):
    return start + dt.timedelta(days=i)


def close_bars(spark, series, start=dt.date(2020, 1, 1)):
    """Close-only bars from {ticker: [closes]}, one per calendar day."""
    rows = [(t, day(i, start), float(c)) for t, closes in series.items() for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def range_bars(spark, series, half=0.5, start=dt.date(2020, 1, 1)):
    rows = [(t, day(i, start), c + half, c - half, float(c)) for t, closes in series.items()
            for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double")


def calendar(spark, *dates):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in dates], "rebalance_date date")


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
