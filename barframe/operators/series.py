"""Framing: give every bar its place in its series and a window key of bounded size.

Indicators are ordered work per series, and one series may hold a large share of all bars. A frame
adds to the bars

* ``n_bars``  bars in the series, ``pos`` the bar's 1-based place in it
* ``seg``     segment number; windows run per (symbol, interval, seg)
* ``step``    1-based place in the segment, 0 or less on copied lead-in rows
* ``blk``     block of 512 rows within the segment, used by the exponential means

``tail_frame`` keeps the last n bars per series, so a series is one short segment.
``segment_frame`` keeps all bars and cuts long series into segments of bounded length, each
led in by copies of the bars before it, so that no task holds a whole long series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.rolling import BLOCK, KEY
from barframe.schema import DAILY, HOURLY, SERIES, WEEKLY

SEGMENT_ROWS = 4096
# longest look-back of any indicator chain: a 120-bar mean; 60 + 20 + 1 for the volume thresholds
LEAD_IN = 160
SALTS = 32
# calendar days per counting bucket: some 50 to 200 bars each
BUCKET_DAYS = {DAILY: 64, WEEKLY: 448, HOURLY: 8}
# buckets per span of time in the first round of a cut: at most 4,096 daily, weekly or hourly bars of a series
SPAN_BUCKETS = 64


def top_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    spread: list[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """First ``n`` rows per key in ``order``, ranked in two rounds.

    Spark already cuts each map task to n rows per key before the exchange. The salted first
    round spreads what is left of a hot key over tasks by a hash of the ``spread`` columns, so the
    last one sees at most salts * n.
    """
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    plain = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        .withColumn(rank, F.row_number().over(salted))
        .filter(F.col(rank) <= n)
        .withColumn(rank, F.row_number().over(plain))
        .filter(F.col(rank) <= n)
        .drop("_salt")
    )


def tail_bars(bars: DataFrame, keep: int | dict[str, int], salts: int = SALTS) -> DataFrame:
    """Last bars of each series; ``keep`` is one number or one per interval.

    Bars of an interval that has no number raise an error.
    """
    return _tail(bars, keep, salts).drop("_back")


def _tail(bars: DataFrame, keep: int | dict[str, int], salts: int) -> DataFrame:
    """The last bars in two rounds; the first ranks them within spans of time dealt over ``salts``.

    Most series lie in one span or two, so the first round already leaves what its interval keeps, and little more
    is sorted and exchanged again. A long series still spreads, and its last round sees at most salts * n bars.
    """
    if isinstance(keep, int):
        most, limit = keep, F.lit(keep)
    else:
        most = max(keep.values())
        limit = F.raise_error(F.concat(F.lit("no number of bars to keep for interval "), "interval")).cast("int")
        for interval, n in keep.items():
            limit = F.when(F.col("interval") == interval, n).otherwise(limit)
    spans = Window.partitionBy(*SERIES, "_span").orderBy(F.desc("ts"))
    whole = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
    return (
        bars.withColumn("_span", F.pmod(F.floor(_bucket() / SPAN_BUCKETS), F.lit(salts)))
        .withColumn("_back", F.row_number().over(spans))
        .filter(F.col("_back") <= limit)
        .withColumn("_back", F.row_number().over(whole))
        .filter((F.col("_back") <= most) & (F.col("_back") <= limit))
        .drop("_span")
    )


def tail_frame(bars: DataFrame, keep: int | dict[str, int], salts: int = SALTS) -> DataFrame:
    whole = Window.partitionBy(*SERIES)
    out = _tail(bars, keep, salts).withColumn("n_bars", F.count(F.lit(1)).over(whole))
    out = out.withColumn("pos", F.col("n_bars") - F.col("_back") + 1)
    return out.drop("_back").withColumns(
        {
            "seg": F.lit(0),
            "n_segs": F.lit(1),
            "step": F.col("pos"),
            "blk": F.floor((F.col("pos") - 1) / BLOCK).cast("int"),
        }
    )


def _bucket(ts: Column | str = "ts") -> Column:
    days = F.lit(8)
    for interval, n in BUCKET_DAYS.items():
        days = F.when(F.col("interval") == interval, n).otherwise(days)
    return F.floor(F.datediff(ts, F.lit("1970-01-01").cast("date")) / days)


def _counts(bars: DataFrame, ts: Column | str) -> DataFrame:
    return bars.groupBy(*SERIES, _bucket(ts).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def segment_map(bars: DataFrame, rows: int = SEGMENT_ROWS, lead_in: int = LEAD_IN, ts: Column | str = "ts") -> DataFrame:
    """Per (series, time bucket): bar counts before it, and the segments that need its bars.

    Built from counts alone, so it has one row per 50 to 200 bars. ``ts`` is the time of a bar.
    """
    by_time = Window.partitionBy(*SERIES).orderBy("bucket")
    series = Window.partitionBy(*SERIES)
    counts = _counts(bars, ts)
    before = F.coalesce(
        F.sum("cnt").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = counts.withColumns({"before": before, "n_bars": F.sum("cnt").over(series)})
    placed = placed.withColumn("slot", F.floor(F.col("before") / rows))
    opens = F.coalesce(F.col("slot") > F.lag("slot").over(by_time), F.lit(True))
    placed = placed.withColumn("opens", opens)
    placed = placed.withColumn(
        "seg", F.sum(F.col("opens").cast("int")).over(by_time).cast("int") - 1
    ).withColumn("n_segs", F.sum(F.col("opens").cast("int")).over(series).cast("int"))
    first = F.max(F.when(F.col("opens"), F.col("before"))).over(by_time)
    placed = placed.withColumn("seg_before", first)
    start = F.struct(F.col("seg"), F.col("seg_before"))
    later = F.collect_list(F.when(F.col("opens"), start)).over(by_time.rowsBetween(1, lead_in))
    own_end = F.col("before") + F.col("cnt")
    needed = F.filter(later, lambda s: s["seg_before"] - own_end < lead_in)
    return placed.select(
        *SERIES,
        "bucket",
        "n_bars",
        "n_segs",
        F.concat(F.array(start), needed).alias("segs"),
        F.col("seg").alias("own_seg"),
    )


def sealed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The columns as one array of one struct, which the optimiser does not take apart.

    Two uses of a table that read different columns of it make Spark compute it twice, each with its own columns; sealed
    columns travel together, so both uses share one exchange.
    """
    packed = F.array(F.struct(*columns)).alias(name)
    return df.select(*[c for c in df.columns if c not in columns], packed)


def opened(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The columns of ``sealed`` again."""
    return df.select(*[c for c in df.columns if c != name], *[F.element_at(name, 1)[c].alias(c) for c in columns])


def segment_frame(
    bars: DataFrame,
    rows: int = SEGMENT_ROWS,
    lead_in: int = LEAD_IN,
    block: int = BLOCK,
    several_only: bool = False,
    shared: bool = False,
) -> DataFrame:
    """Frame of all bars. ``several_only`` leaves out series that fit one segment.

    With ``shared`` the frames of all series and of the long ones read the bars by one exchange. Buckets are then told from
    the sealed bars too: what makes the bars, weeks of them and their counts reads the same columns under the same filters, and is run once.
    """
    carried, ts = [c for c in bars.columns if c not in SERIES], "ts"
    if shared:
        bars = sealed(bars, carried, "_bar")
        ts = F.element_at("_bar", 1)["ts"]
    where = segment_map(bars, rows, lead_in, ts)
    if several_only:
        where = where.filter(F.col("n_segs") > 1)
    out = bars.withColumn("bucket", _bucket(ts)).join(where, [*SERIES, "bucket"])
    if shared:
        out = opened(out, carried, "_bar")
    return _led_in(out.drop("bucket"), block)


def _led_in(out: DataFrame, block: int) -> DataFrame:
    """Bars with the segments that need them, once for each."""
    out = (
        out.withColumn("_s", F.explode("segs"))
        .withColumns({"seg": F.col("_s.seg"), "_seg_before": F.col("_s.seg_before")})
        .withColumn("_lead", (F.col("own_seg") < F.col("seg")).cast("int"))
        .drop("_s", "segs", "own_seg")
    )
    by_time = Window.partitionBy(*KEY).orderBy("ts")
    segment = Window.partitionBy(*KEY)
    out = out.withColumn(
        "step", F.row_number().over(by_time) - F.sum("_lead").over(segment)
    ).withColumn("pos", F.col("_seg_before") + F.col("step"))
    return out.withColumn("blk", F.floor((F.col("step") - 1) / block).cast("int")).drop(
        "_lead", "_seg_before"
    )


def split_frames(bars: DataFrame, rows: int = SEGMENT_ROWS, lead_in: int = LEAD_IN, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The frames of series of at most ``rows`` bars, and of longer ones, from one exchange of the bars.

    A short series is dealt out whole, as its one segment, which its windows then run on without another exchange; a long one by
    buckets of time. The list of long series, at most one for each ``rows`` bars, is sent to all tasks.
    """
    carried = [c for c in bars.columns if c not in SERIES]
    # An interval that is the same for all bars would be left out of the windows' keys but not of the exchange's, so it is read from the
    # sealed bars; never null by its form, as a filter that a join adds to one of the uses would make the bars anew for it.
    ts, interval = F.element_at("_bar", 1)["ts"], F.coalesce(F.element_at("_bar", 1)["interval"], F.lit(""))
    bars = bars.where(" and ".join(f"{c} is not null" for c in SERIES))
    bars = sealed(bars, [*carried, "interval"], "_bar").select("symbol", interval.alias("interval"), "_bar")
    lengths = _counts(bars, ts).groupBy(*SERIES).agg(F.sum("cnt").alias("_length"))
    long_ones = lengths.where(F.col("_length") > rows)
    # a number of the bucket that is not 0, which stands for the segment of a short series
    number = (F.col("bucket") * 2 + 1).cast("int")
    dealt = bars.withColumn("bucket", _bucket(ts))
    dealt = dealt.join(F.broadcast(long_ones), SERIES, "left")
    dealt = dealt.select(*SERIES, "_bar", F.coalesce(F.when(F.col("_length").isNotNull(), number), F.lit(0)).alias("seg"))
    dealt = dealt.repartition(*SERIES, "seg")

    series = Window.partitionBy(*KEY)
    short = dealt.withColumns({"pos": F.row_number().over(series.orderBy(ts.asc_nulls_last())).cast("bigint"), "n_bars": F.count(F.lit(1)).over(series)})
    # asked of the place too: a filter by seg alone would go below the exchange, which then were no longer one for both. A bar without a
    # time has no place, but counts, as it does in the map of segments
    short = short.where(F.when((F.col("seg") == 0) & ts.isNotNull(), F.col("pos")) > 0)
    short = opened(short, carried, "_bar").withColumns(
        {"n_segs": F.lit(1), "step": F.col("pos"), "blk": F.floor((F.col("pos") - 1) / block).cast("int")}
    )

    where = segment_map(bars, rows, lead_in, ts).where(F.col("n_bars") > rows)
    where = where.withColumn("_number", number).drop("bucket")
    several = dealt.withColumnRenamed("seg", "_number").join(where, [*SERIES, "_number"]).drop("_number")
    return short, _led_in(opened(several, carried, "_bar"), block)
