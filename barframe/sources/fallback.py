"""Choosing between two bar sources, and what to say about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.tickers import is_six_digit
from barframe.schema import BAR, DAILY, HOURLY, SERIES, WEEKLY


#: A series' bars are dealt over so many parts when they meet a list of series.
PARTS = 16


def of_series(bars: DataFrame, listed: DataFrame) -> DataFrame:
    """Bars of the listed series. The list is repeated for each part, so a long series is no task of its own."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    dealt = bars.withColumn("_part", F.pmod(F.xxhash64("ts"), F.lit(PARTS)).cast("int"))
    return dealt.join(listed.withColumn("_part", parts), [*SERIES, "_part"], "left_semi").drop("_part")


def choose_source(
    preferred: DataFrame, requested: DataFrame, fallback: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Bars of the preferred source where it has any for a (symbol, interval), else the fallback's.

    ``requested`` lists the wanted (symbol, interval) pairs. The second source has no hourly bars
    of six-digit codes; without ``fallback`` the preferred one is that source. Returns bars and
    a (symbol, interval, notes) table.
    """
    wanted = requested.select(*SERIES).distinct()
    no_hourly = is_six_digit("symbol") & (F.col("interval") == HOURLY)
    first = of_series(preferred.select(*BAR), wanted)
    if fallback is None:
        bars = first.filter(~no_hourly)
        have = bars.groupBy(*SERIES).agg(F.lit(1).alias("rank"))
    else:
        second = of_series(fallback.select(*BAR).filter(~no_hourly), wanted)
        # one row per pair and source, so neither source's bars meet in a window
        have = (
            first.groupBy(*SERIES)
            .agg(F.lit(1).alias("rank"))
            .unionByName(second.groupBy(*SERIES).agg(F.lit(2).alias("rank")))
            .groupBy(*SERIES)
            .agg(F.min("rank").alias("rank"))
        )
        use_second = have.filter("rank = 2").select(*SERIES)
        bars = first.unionByName(of_series(second, use_second))
    rank, missing = F.col("rank"), F.col("rank").isNull()
    fell_back = F.lit(fallback is not None) & (missing | (rank == 2))
    notes = F.array_compact(
        F.array(
            F.when(fell_back, "fell back"),
            F.when(missing & no_hourly, "no hourly bars"),
            F.when(missing & ~no_hourly, "no valid data"),
        )
    )
    return bars, wanted.join(have, SERIES, "left").select(*SERIES, notes.alias("notes"))


def merge_notes(by_interval: DataFrame, weekly: DataFrame) -> DataFrame:
    """One ordered list of distinct notes per symbol: daily, weekly, its resampling, hourly.

    ``by_interval`` comes from ``choose_source``, ``weekly`` (symbol, note) from
    ``with_weekly_fallback``: at most four rows per symbol.
    """
    place = F.when(F.col("interval") == DAILY, 0).when(F.col("interval") == WEEKLY, 1).otherwise(3)
    rows = by_interval.select("symbol", place.alias("place"), "notes").unionByName(
        weekly.select("symbol", F.lit(2).alias("place"), F.array("note").alias("notes"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("place", "notes")))
    return rows.groupBy("symbol").agg(ordered.alias("n")).select(
        "symbol", F.array_distinct(F.flatten("n.notes")).alias("notes")
    )


def instrument_info(symbols: DataFrame, instruments: DataFrame) -> DataFrame:
    """Name (long, short or local name, else the ticker), PE and PB of each symbol."""
    joined = symbols.select("symbol").distinct().join(instruments, "symbol", "left")

    def text(c: str):
        return F.when(F.col(c) != "", F.col(c))

    return joined.select(
        "symbol",
        F.coalesce(
            text("long_name"), text("short_name"), text("local_name"), F.upper(F.trim("symbol"))
        ).alias("name"),
        "pe",
        "pb",
    )
