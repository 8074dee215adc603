"""Bars from trades as they arrive: closed once, in event time, with late trades counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barframe.schema import BAR, DAILY, HOURLY, SERIES, WEEKLY

# interval -> (length, distance of its first start from 1970-01-01, a Thursday; weeks start on Saturdays)
GRID = {HOURLY: ("1 hour", "0 seconds"), DAILY: ("1 day", "0 seconds"), WEEKLY: ("7 days", "2 days")}


def _clock(ts: Column) -> Column:
    """What the clock shows at ``ts``, as a moment of UTC: watermarks take no times without a zone, and hours of a zone's changes
    stay apart."""
    local = ts.cast("timestamp_ntz")
    seconds = F.unix_date(local.cast("date")).cast("bigint") * 86400 + F.hour(local) * 3600 + F.minute(local) * 60
    return F.timestamp_seconds(seconds + F.extract(F.lit("SECOND"), local))


def _grid(clock: str, interval: str) -> Column:
    length, offset = GRID[interval]
    return F.window(clock, length, startTime=offset)


def _bar_time(start: str, interval: str) -> Column:
    """A bar's time: its start, or for weeks the Friday that closes them."""
    days = F.lit(6 if interval == WEEKLY else 0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=days, secs=F.unix_seconds(start))


def bars_from_stream(
    trades: DataFrame,
    symbol: Column,
    ts: Column,
    price: Column,
    volume: Column,
    order: Column,
    interval: str = DAILY,
    wait: str = "1 day",
) -> DataFrame:
    """Closed bars of a stream of trades, and ``n_trades``, the number of trades each is made of.

    A bar is given once, when trades ``wait`` past its end have been seen; trades that arrive for it
    after that are left out (``late_trades`` counts them). Hourly, daily and Saturday-to-Friday weekly bars
    have the values that ``bars_from_trades`` and ``weekly_from_daily`` give for the same trades; ``order`` must order
    the trades of one bar fully. Trades without symbol or time are in no bar; a missing price or volume counts as in the batch form.

    State is one row per open bar, so it grows with symbols and ``wait``, not with trades; trades are combined
    before the exchange. On a batch table it gives all bars.
    """
    ticks = trades.select(
        symbol.cast("string").alias("symbol"),
        _clock(ts).alias("traded"),
        price.cast("double").alias("price"),
        volume.cast("double").alias("volume"),
        order.alias("key"),
    ).where("symbol is not null and traded is not null")
    return (
        ticks.withWatermark("traded", wait)
        .groupBy("symbol", _grid("traded", interval).alias("span"))
        .agg(
            F.min_by("price", "key").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "key").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_trades"),
        )
        .withColumns({"interval": F.lit(interval), "ts": _bar_time("span.start", interval)})
        .select(*BAR, "n_trades")
    )


#: What ``read_bars`` must be told of landed bars.
TRADES_TYPE = "n_trades bigint"


def land_bars(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take all trades that have arrived, append the bars they close to ``path``, and end.

    Files are partitioned by interval. Started again with the same ``checkpoint`` (a shared folder, one per interval) it goes on where it
    ended, also after a failure; each bar is written once.
    """
    writer = bars.writeStream.format("parquet").outputMode("append").partitionBy("interval")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_trades(trades: DataFrame, symbol: Column, ts: Column, landed: DataFrame, interval: str = DAILY) -> DataFrame:
    """Trades that came too late for a closed bar: (symbol, interval, ts, n_late), bars without any left out.

    ``trades`` are all that have arrived, as a batch; ``landed`` the bars written so far. A bar counts as closed
    if it is not after the last landed one. Both are counted per bar before they meet; only the time of the last bar, one row, is sent
    to all.
    """
    mine = landed.where(F.col("interval") == interval)
    last = mine.agg(F.max("ts")).scalar()
    arrived = (
        trades.select(symbol.cast("string").alias("symbol"), _clock(ts).alias("traded"))
        .where("symbol is not null and traded is not null")
        .groupBy("symbol", _grid("traded", interval).alias("span"))
        .agg(F.count(F.lit(1)).alias("n_arrived"))
        .select("symbol", F.lit(interval).alias("interval"), _bar_time("span.start", interval).alias("ts"), "n_arrived")
        .where(F.col("ts") <= last)
    )
    n_late = F.col("n_arrived") - F.coalesce("n_trades", F.lit(0))
    joined = arrived.join(mine.select(*SERIES, "ts", "n_trades"), [*SERIES, "ts"], "left")
    return joined.select(*SERIES, "ts", n_late.alias("n_late")).where("n_late > 0")
