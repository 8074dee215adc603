"""Bars of arriving trades: equal to the batch, closed once over restarts, late trades counted."""

import os

import pytest
from pyspark.sql import functions as F

from barframe.operators.resample import bars_from_trades, weekly_from_daily
from barframe.schema import BAR, DAILY, HOURLY, WEEKLY
from barframe.sources.readers import read_bars
from barframe.streaming.bars import TRADES_TYPE, bars_from_stream, land_bars, late_trades

SF = "/root/testdata/sf0.001"


def columns():
    return {"symbol": F.col("event_type"), "ts": F.col("ts"), "price": F.col("value"), "volume": F.lit(1.0)}


def rows(df):
    return sorted(tuple(r) for r in df.select(*BAR).collect())


@pytest.fixture(scope="module")
def trades(spark):
    return spark.read.parquet(f"{SF}/events.parquet").where("value is not null")


def land(trades, folder, turn):
    """One more file, later than the ones before."""
    out = folder / f"part{turn}"
    trades.coalesce(1).write.parquet(str(out))
    for file in sorted(out.glob("*.parquet")):
        target = folder / "in" / f"{turn}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_000_000 + turn, 1_000_000 + turn))


def run(spark, trades, folder, interval, wait="1 hour"):
    source = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    bars = bars_from_stream(source, **columns(), order=F.col("event_id"), interval=interval, wait=wait)
    query = land_bars(bars, str(folder / "out"), str(folder / f"check_{interval}"))
    assert query.awaitTermination(300)
    return read_bars(spark, str(folder / "out"), TRADES_TYPE)


@pytest.mark.parametrize("interval", [HOURLY, DAILY, WEEKLY])
def test_equals_batch(spark, trades, tmp_path, interval):
    """Files in order of time, in two runs of one checkpoint: all bars but the open ones, each once."""
    cuts = trades.select(F.expr("percentile_approx(ts, array(0.3, 0.6))")).first()[0]
    land(trades.where(F.col("ts") < cuts[0]), tmp_path, 1)
    land(trades.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), tmp_path, 2)
    first = rows(run(spark, trades, tmp_path, interval))
    land(trades.where(F.col("ts") >= cuts[1]), tmp_path, 3)
    landed = run(spark, trades, tmp_path, interval)
    got = rows(landed)
    batch = bars_from_trades(trades, **columns(), order=[F.col("event_id")], interval=HOURLY if interval == HOURLY else DAILY)
    whole = rows(weekly_from_daily(batch) if interval == WEEKLY else batch)
    assert 0 < len(first) < len(got) < len(whole)
    assert set(first) <= set(got)
    last = max(r[2] for r in got)
    assert got == [r for r in whole if r[2] <= last]
    # what is open ends less than the wait and a bar before the last trade
    assert len({r[2] for r in whole if r[2] > last}) <= 3
    assert late_trades(trades, F.col("event_type"), F.col("ts"), landed, interval).count() == 0


def test_late_trades_are_left_out_and_counted(spark, trades, tmp_path):
    middle = trades.select(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    early = F.col("ts") < F.lit(middle)
    held_back = early & (F.col("event_id") % 11 == 0)
    land(trades.where(early & ~held_back), tmp_path, 1)
    land(trades.where(~early), tmp_path, 2)
    run(spark, trades, tmp_path, DAILY)
    land(trades.where(held_back), tmp_path, 3)
    landed = run(spark, trades, tmp_path, DAILY)
    on_time = trades.where(~held_back)
    last = max(r[2] for r in rows(landed))
    want = rows(bars_from_trades(on_time, **columns(), order=[F.col("event_id")]))
    assert rows(landed) == [r for r in want if r[2] <= last]
    late = late_trades(trades, F.col("event_type"), F.col("ts"), landed)
    expected = trades.where(held_back).groupBy(F.col("event_type"), F.to_date("ts").cast("timestamp_ntz")).count()
    assert sorted(map(tuple, late.select("symbol", "ts", "n_late").collect())) == sorted(map(tuple, expected.collect()))
    assert late.count() > 0


def test_odd_rows(spark):
    """No symbol or time: no bar. A missing price or volume counts as in the batch. Repeated trades count twice. Empty: no bars."""
    odd = spark.createDataFrame(
        [("a", "2024-01-05 10:00:00", 2.0, 1), ("a", "2024-01-05 10:00:00", 2.0, 1), ("a", "2024-01-05 11:00:00", None, 2), ("a", None, 9.0, 3), (None, "2024-01-05 10:00:00", 9.0, 4)],
        "event_type string, ts string, value double, event_id int",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    got = bars_from_stream(odd, **columns(), order=F.col("event_id"), interval=WEEKLY).collect()
    assert [(r.symbol, str(r.ts), r.open, r.high, r.low, r.close, r.volume, r.n_trades) for r in got] == [("a", "2024-01-05 00:00:00", 2.0, 2.0, 2.0, None, 3.0, 3)]
    assert bars_from_stream(odd.limit(0), **columns(), order=F.col("event_id")).count() == 0
    clash = odd.withColumns({"symbol": F.lit("x"), "traded": F.lit(1), "key": F.lit(2), "span": F.lit(3)})
    assert bars_from_stream(clash, **columns(), order=F.col("event_id"), interval=WEEKLY).collect() == got


def test_the_session_zone_moves_no_bar(spark, trades):
    """Times without a zone fall into the same days and hours wherever the session is."""
    found = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found.append([rows(bars_from_stream(trades, **columns(), order=F.col("event_id"), interval=i)) for i in (HOURLY, WEEKLY)])
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == found[1]
