"""Landed tables in, result tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from barframe.operators.resample import period_start
from barframe.schema import (
    BAR,
    BAR_SCHEMA,
    DAILY,
    DEFAULT_PERIOD_BARS,
    HOURLY,
    PERIOD_BARS,
)

MONTH = "month"
MONTH_TYPE = f"{MONTH} int"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Any format Spark reads. CSV and JSON keep text; ``clean_bars`` gives it types."""
    if fmt == "csv":
        options = {"header": "true"} | options
    return spark.read.format(fmt).options(**options).load(path)


def read_bars(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """Bars written by ``write_bars``, with ``more`` columns as "name type".

    The types are named, as Spark would take a folder ``interval=1d`` for the number 1.0 where it finds no other interval.
    """
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in BAR_SCHEMA]
    return spark.read.schema(", ".join([*columns, *more])).parquet(path)


def scan_window(bars: DataFrame, period: str, as_of: Column) -> DataFrame:
    """Bars a look-back period can need, up to ``as_of``; the bounds reach the file scan.

    An ``as_of`` that is a date includes its whole day.
    """
    days = PERIOD_BARS.get(period, DEFAULT_PERIOD_BARS)
    hourly = F.col("interval") == HOURLY
    start = {
        True: period_start(F.lit(HOURLY), as_of, days),
        False: period_start(F.lit(DAILY), as_of, days),
    }
    if isinstance(bars.select(as_of.alias("as_of")).schema["as_of"].dataType, DateType):
        late = F.col("ts") < F.date_add(as_of, 1).cast("timestamp_ntz")
    else:
        late = F.col("ts") <= as_of.cast("timestamp_ntz")
    return bars.filter(
        late & ((hourly & (F.col("ts") >= start[True])) | (~hourly & (F.col("ts") >= start[False])))
    )


def month_of(ts: Column | str) -> Column:
    """Months since the year 0: the partition a bar lies in."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def scan_windows(bars: DataFrame, wanted: DataFrame, period: str) -> DataFrame:
    """Bars that a look-back ``period`` can need, up to each symbol's own ``as_of``; with the column ``as_of``.

    ``wanted`` has (symbol, as_of), dates (whole days) or times, one row per wanted window: a symbol may have
    several. Repeated rows count once; rows without a symbol or an as_of, and symbols without bars, give
    nothing.

    First and last moment of all windows, one row, are found before the bars are read and skip files, and whole
    partitions where the bars have a column ``month`` (``write_bars_by_month``); months between that no
    window needs are skipped too where Spark sends the list of windows to the scan. Bars then meet their windows by (symbol,
    month), so a key has at most a month of one symbol's bars.
    """
    days = PERIOD_BARS.get(period, DEFAULT_PERIOD_BARS)
    if isinstance(wanted.schema["as_of"].dataType, DateType):
        end = F.date_add("as_of", 1).cast("timestamp_ntz")
    else:  # one microsecond later, so that the moment itself is included
        end = F.col("as_of").cast("timestamp_ntz") + F.expr("interval '0.000001' second")
    windows = (
        wanted.select("symbol", "as_of").dropna().distinct().withColumns(
            {
                "_hourly_from": period_start(F.lit(HOURLY), F.col("as_of"), days),
                "_from": period_start(F.lit(DAILY), F.col("as_of"), days),
                "_end": end,
            }
        )
    )
    first = F.least("_hourly_from", "_from")
    reach = windows.agg(F.min(first).alias("first"), F.max("_end").alias("end"))
    low, high = reach.select("first").scalar(), reach.select("end").scalar()
    near = bars.where((F.col("ts") >= low) & (F.col("ts") < high))
    if MONTH in bars.columns:
        near = near.where(F.col(MONTH).between(month_of(low), month_of(high)))
    else:
        near = near.withColumn(MONTH, month_of("ts"))
    months = F.explode(F.sequence(month_of(first), month_of("_end")))
    start = F.when(F.col("interval") == HOURLY, F.col("_hourly_from")).otherwise(F.col("_from"))
    return (
        near.join(windows.withColumn(MONTH, months), ["symbol", MONTH])
        .where((F.col("ts") >= start) & (F.col("ts") < F.col("_end")))
        .select(*BAR, "as_of")
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a result as Parquet, for bars partitioned by interval."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_table(bars.select(*BAR), path, ["interval"], mode)


def write_bars_by_month(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars partitioned by interval and month, so that a scan of some months reads no others; ``read_bars`` with MONTH_TYPE reads them."""
    write_table(bars.select(*BAR, month_of("ts").alias(MONTH)), path, ["interval", MONTH], mode)


def save_bars_table(bars: DataFrame, table: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Bars as a table of the catalog: partitioned by interval, bucketed by symbol and sorted by time within a symbol.

    Reads of some intervals skip the others' files, and windows over series need no exchange. Every bucket is
    written by one task, as a file per interval. A bucket is read by one task too: where a single
    symbol holds much of all bars, ``write_bars`` suits better.
    """
    dealt = bars.select(*BAR).repartition(buckets, "symbol")
    writer = dealt.write.mode(mode).partitionBy("interval").bucketBy(buckets, "symbol").sortBy("symbol", "ts")
    writer.saveAsTable(table)


def read_bars_table(spark: SparkSession, table: str, intervals: list[str] | None = None) -> DataFrame:
    """Bars of such a table, of all intervals or of those named."""
    bars = spark.table(table).select(*BAR)
    return bars.where(F.col("interval").isin(intervals)) if intervals else bars
