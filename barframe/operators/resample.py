"""Bars from trades, and weekly bars from daily ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.operators.series import opened, sealed
from barframe.schema import BAR, DAILY, HOURLY, WEEKLY

WEEKLY_NOTE = "weekly bars resampled from daily"


def bars_from_trades(
    trades: DataFrame,
    symbol: Column,
    ts: Column,
    price: Column,
    volume: Column,
    order: list[Column],
    interval: str = DAILY,
) -> DataFrame:
    """Open, high, low, close and volume per symbol and day or hour.

    ``order`` must order the trades of one bar fully. All aggregates combine on the map side, so
    a symbol with most of the trades costs no more than one row per map task and bar. A single
    numeric ``order`` keeps the aggregation in a hash table; several are compared as a struct,
    for which Spark sorts.
    """
    grid = {"_day": ts.cast("date")} | ({"_hour": F.hour(ts)} if interval == HOURLY else {})
    ticks = trades.select(
        symbol.alias("symbol"),
        *[c.alias(n) for n, c in grid.items()],
        price.cast("double").alias("price"),
        volume.cast("double").alias("volume"),
        (order[0] if len(order) == 1 else F.struct(*order)).alias("key"),
    )
    start = F.col("_day").cast("timestamp_ntz")
    if interval == HOURLY:
        start = start + F.make_dt_interval(F.lit(0), F.col("_hour"))
    return (
        ticks.groupBy("symbol", *grid)
        .agg(
            F.min_by("price", "key").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "key").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumns(
            {
                "symbol": F.col("symbol").cast("string"),
                "interval": F.lit(interval),
                "ts": start,
            }
        )
        .select(*BAR)
    )


def week_ending(ts: Column | str) -> Column:
    """The Friday that closes the Saturday-to-Friday week."""
    return F.next_day(F.date_sub(ts, 1), "FRI").cast("timestamp_ntz")


def _weeks(daily: DataFrame) -> DataFrame:
    """Weekly bars and n_days, the number of daily bars in each."""
    return (
        daily.groupBy("symbol", week_ending("ts").alias("week"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_days"),
        )
        .withColumnRenamed("week", "ts")
        .withColumn("interval", F.lit(WEEKLY))
        .select(*BAR, "n_days")
    )


def weekly_from_daily(daily: DataFrame) -> DataFrame:
    """Weekly bars; weeks without a bar do not appear."""
    return _weeks(daily).select(*BAR)


def with_weekly_fallback(
    bars: DataFrame, min_weekly: int = 20, min_daily: int = 80, shared: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Replace thin native weekly bars by resampled daily ones.

    Returns the bars and a (symbol, note) table of the symbols it was done for. Daily bars are
    combined into weeks where they lie; what a symbol has is counted over its weekly rows, of
    which there are some 52 a year, so no bars are joined and no task gets all daily bars of a symbol.
    With ``shared`` a query over both tables makes the weekly rows once, whole; else each is read for its own columns.
    """
    native = bars.filter(F.col("interval") == WEEKLY).select(*BAR, F.lit(0).cast("bigint").alias("n_days"))
    made = _weeks(bars.filter(F.col("interval") == DAILY))
    own = Window.partitionBy("symbol")
    weekly = made.unionByName(native).withColumn("_named", F.col("symbol"))
    rest = [c for c in weekly.columns if c not in ("symbol", "n_days")]
    weekly = (sealed(weekly, rest, "_bar") if shared else weekly).select(
        "*",
        F.sum("n_days").over(own).alias("n_daily"),
        F.count(F.when(F.col("n_days") == 0, 1)).over(own).alias("n_weekly"),
    )
    thin = (F.col("n_weekly") < min_weekly) & (F.col("n_daily") >= min_daily)
    chosen = weekly.filter(F.when(F.col("n_days") > 0, thin).otherwise(~thin))
    kept = bars.filter(F.col("interval").isNull() | (F.col("interval") != WEEKLY)).select(*BAR)
    named = weekly.filter(thin)
    if shared:  # the name is read from the sealed rows too, as a filter on symbol, as joins add, would make them anew
        chosen, named = opened(chosen, rest, "_bar"), opened(named, rest, "_bar")
    notes = named.select(F.col("_named").alias("symbol")).distinct().withColumn("note", F.lit(WEEKLY_NOTE))
    return kept.unionByName(chosen.select(*BAR)), notes


def period_start(interval: Column, as_of: Column, days: int) -> Column:
    """First moment a scan for ``days`` bars has to read."""
    reach = F.when(interval == HOURLY, 40).otherwise(int(days * 1.5 + 30))
    return F.date_sub(as_of.cast("date"), reach).cast("timestamp_ntz")
