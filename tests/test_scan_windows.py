"""Windows of bars up to a day per symbol: what comes out, and what the scan skips."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from barframe import fixtures as fx
from barframe.schema import DAILY
from barframe.sources.readers import MONTH_TYPE, month_of, read_bars, scan_window, scan_windows, write_bars, write_bars_by_month
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("months") / "bars")
    write_bars_by_month(fx.mixed_bars(spark, SF), path)
    return read_bars(spark, path, MONTH_TYPE)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_equals_one_scan_per_window(spark, stored):
    """Each window, of dates or times and several to a symbol, is what ``scan_window`` gives for it alone."""
    for kind, days in (("date", ["1994-03-31", "1996-11-01"]), ("timestamp_ntz", ["1994-03-31 00:00:00", "1997-02-03 11:30:00"])):
        symbols = [r[0] for r in stored.select("symbol").distinct().orderBy("symbol").limit(4).collect()]
        listed = [(s, d) for s in symbols for d in days[: 1 + symbols.index(s) % 2]]
        wanted = spark.createDataFrame(listed, "symbol string, as_of string").withColumn("as_of", F.col("as_of").cast(kind))
        got = rows(scan_windows(stored, wanted.union(wanted), "3mo"))
        want = []
        for symbol, day in listed:
            alone = scan_window(stored.drop("month"), "3mo", F.lit(day).cast(kind)).where(F.col("symbol") == symbol)
            want += rows(alone.select("symbol", "interval", "ts", "open", "high", "low", "close", "volume", F.lit(day).cast(kind).alias("as_of")))
        assert got == sorted(want) and got


def test_bars_of_one_interval_keep_its_name(spark, tmp_path):
    daily = fx.supplier_daily(spark, SF)
    write_bars(daily, str(tmp_path / "daily"))
    back = read_bars(spark, str(tmp_path / "daily"))
    assert rows(back.select(daily.columns)) == rows(daily)


def test_odd_lists(spark, stored):
    """Nothing for rows without symbol or day, for unknown symbols and for empty lists or bars."""
    wanted = spark.createDataFrame([(None, dt.date(1996, 1, 1)), ("1", None), ("nobody", dt.date(1996, 1, 1))], "symbol string, as_of date")
    assert scan_windows(stored, wanted, "1y").count() == 0
    assert scan_windows(stored, wanted.limit(0), "1y").count() == 0
    known = spark.createDataFrame([("1", dt.date(1996, 1, 1))], "symbol string, as_of date")
    assert scan_windows(stored.where("false"), known, "1y").count() == 0
    # extra columns with clashing names do no harm
    clash = known.withColumns({"ts": F.lit(1), "interval": F.lit("x"), "_end": F.lit(2), "month": F.lit(3)})
    assert rows(scan_windows(stored, clash, "1y")) == rows(scan_windows(stored, known, "1y"))
    assert scan_windows(stored, known, "1y").count() > 0


def test_scan_skips_partitions(spark, stored):
    wanted = spark.createDataFrame([("1", dt.date(1996, 3, 1)), ("2", dt.date(1996, 4, 1))], "symbol string, as_of date")
    found = scan_windows(stored.where(F.col("interval") == DAILY), wanted, "1mo")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan(spark, found)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in text.splitlines() if "FileScan" in line and "interval" in line)
    partition = re.search(r"PartitionFilters: \[(.*)\], PushedFilters", scan).group(1)
    # bounds of the months by subqueries, and of the moments on the rows of the files left
    assert "month" in partition and "ubquery" in partition
    data = re.search(r"DataFilters: \[(.*?)\], Format", scan).group(1)
    assert "ts" in data and "ubquery" in data
    months = [r[0] for r in found.select(month_of("ts")).distinct().collect()]
    assert min(months) >= 1995 * 12 + 11 and max(months) <= 1996 * 12 + 3
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
