"""The driver's test tables read as market data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.operators.resample import bars_from_trades
from barframe.schema import DAILY, HOURLY, STATEMENT_ITEMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined_key(*parts: tuple[str, int]) -> Column:
    """Whole numbers of at most the given digits as one number in their order.

    A decimal, unlike a struct, can be compared within a hash aggregation. Neighbours that fit a
    bigint together are joined as such first.
    """
    groups: list[tuple[str, int]] = []
    for sql, digits in parts:
        sql = f"cast({sql} as bigint)"
        if groups and groups[-1][1] + digits <= 18:
            before, width = groups[-1]
            groups[-1] = (f"({before} * {10**digits}L + {sql})", width + digits)
        else:
            groups.append((sql, digits))
    key = f"cast({groups[0][0]} as decimal(38,0))"
    for sql, digits in groups[1:]:
        key = f"cast({key} * cast('1{'0' * digits}' as decimal({digits + 1},0)) + {sql} as decimal(38,0))"
    return F.expr(key)


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: unit price and quantity of each shipped line."""
    return bars_from_trades(
        table(spark, sf_dir, "lineitem"),
        F.col("l_suppkey"),
        F.col("l_shipdate"),
        F.col("l_extendedprice") / F.col("l_quantity"),
        F.col("l_quantity"),
        [
            _joined_key(
                ("l_orderkey", 12),
                ("l_linenumber", 1),
                ("l_partkey", 11),
                ("round(l_extendedprice * 100)", 10),
                ("l_quantity", 3),
            )
        ],
    )


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day per supplier, (symbol, as_of): of its line with the highest price, the latest of several."""
    dearest = F.max(F.struct(F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_shipdate").cast("date").alias("day")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(dearest.alias("line"))
    return lines.select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("line.day").alias("as_of"))


def nation_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per nation: order totals, one unit of volume per order."""
    sales = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return bars_from_trades(
        sales,
        F.col("c_nationkey"),
        F.col("o_orderdate"),
        F.col("o_totalprice"),
        F.lit(1.0),
        [F.col("o_orderkey")],
    )


def event_bars(spark: SparkSession, sf_dir: str, interval: str = HOURLY) -> DataFrame:
    """Hourly or daily bars per event type: event values, one unit of volume per event."""
    return bars_from_trades(
        table(spark, sf_dir, "events"),
        F.col("event_type"),
        F.col("ts"),
        F.col("value"),
        F.lit(1.0),
        [_joined_key(("unix_micros(cast(ts as timestamp))", 17), ("event_id", 18))],
        interval,
    )


def mixed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of suppliers, daily and hourly bars of event types."""
    return (
        supplier_daily(spark, sf_dir)
        .unionByName(event_bars(spark, sf_dir, DAILY))
        .unionByName(event_bars(spark, sf_dir, HOURLY))
    )


# --- raw, dirty rows --------------------------------------------------------


def raw_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event bars as text, each sent twice; some copies are spoilt.

    The second copy, later in order, has another close. By the hour of day its number or date is
    unreadable, infinite, not a number or missing, so that the first copy must win.
    """
    bars = event_bars(spark, sf_dir)
    text = bars.select(
        "symbol",
        "interval",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").cast("string").alias("volume"),
        F.lit(1).cast("bigint").alias("ingest_seq"),
    )
    hour = F.substring("date", 12, 2)
    later = text.withColumns(
        {
            "date": F.when(hour == "01", "not a date")
            .when(hour == "02", F.concat("date", F.lit("+08:00")))
            .when(hour == "07", F.translate("date", "-", "/"))
            .when(hour == "08", F.regexp_replace("date", r"^(\d+)-(\d+)-(\d+)", "$1$2$3"))
            .when(hour == "09", F.regexp_replace("date", r"^(\d+)-(\d+)-(\d+)", "$2/$3/$1"))
            .otherwise(F.col("date")),
            "open": F.when(hour == "03", "12,5").when(hour == "10", "1.5d").otherwise(F.col("open")),
            "high": F.when(hour == "04", "Infinity").otherwise(F.col("high")),
            "low": F.when(hour == "05", "NaN").otherwise(F.col("low")),
            "close": F.when(hour == "06", None).otherwise(F.lit("7.25")),
            "ingest_seq": F.lit(2).cast("bigint"),
        }
    )
    return text.unionByName(later).withColumnsRenamed(
        {
            "date": "时间",
            "open": "开盘",
            "high": "最高",
            "low": "最低",
            "close": "收盘",
            "volume": "成交量(手)",
        }
    )


# --- companies --------------------------------------------------------------


def supplier_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as instruments: five kinds of six-digit codes by turn."""
    s = table(spark, sf_dir, "supplier")
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in ("60", "68", "00", "30", "83")]),
        F.pmod("s_suppkey", F.lit(5)).cast("int") + 1,
    )
    turn = F.pmod("s_suppkey", F.lit(4))
    return s.select(
        F.col("s_suppkey").cast("string").alias("symbol"),
        F.concat(
            F.lit(" "), prefix, F.lpad(F.pmod("s_suppkey", F.lit(10000)).cast("string"), 4, "0")
        ).alias("ticker"),
        F.when(turn == 0, F.col("s_name")).alias("long_name"),
        F.when(turn <= 1, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias(
            "short_name"
        ),
        F.when(turn <= 2, F.concat(F.lit("L"), F.col("s_suppkey").cast("string"))).alias(
            "local_name"
        ),
        (F.col("s_acctbal") / 100).alias("pe"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 1000).alias("pb"),
    )


def nation_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sector per nation, led by its first supplier; some have none."""
    leaders = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k"))
    return (
        table(spark, sf_dir, "nation")
        .join(leaders, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select(F.col("n_name").alias("sector"), F.col("k").cast("string").alias("symbol"))
    )


def supplier_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements per supplier, (symbol, period_end, item, value).

    Odd suppliers file under the second names of items.
    """
    lines = table(spark, sf_dir, "lineitem")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 2))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sold = cents * F.round((1 - F.col("l_discount")) * 100).cast("bigint")
    quarters = lines.groupBy("l_suppkey", end.alias("period_end")).agg(
        (F.sum(sold) / 10000).alias("revenue"),
        ((F.sum(sold) - F.sum(cents) * 90) / 10000).alias("net_income"),
    )
    balance = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey"),
        F.col("s_acctbal").alias("equity"),
        (F.col("s_acctbal") * 0.5).alias("liabilities"),
        (F.col("s_acctbal") * 2).alias("assets"),
    )
    wide = quarters.join(balance, F.col("l_suppkey") == F.col("s_suppkey"))
    odd = F.pmod("l_suppkey", F.lit(2)) == 1
    items = F.array(
        *[
            F.struct(
                F.when(odd, names[-1]).otherwise(names[0]).alias("item"), F.col(c).alias("value")
            )
            for c, names in STATEMENT_ITEMS.items()
        ]
    )
    return wide.select(
        F.col("l_suppkey").cast("string").alias("symbol"), "period_end", F.explode(items).alias("i")
    ).select("symbol", "period_end", "i.item", "i.value")


def wide_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements as filed: a row per supplier and item, a column per period, headed by its last day."""
    long = supplier_statements(spark, sf_dir).withColumn("period_end", F.col("period_end").cast("string"))
    return long.groupBy("symbol", "item").pivot("period_end").agg(F.max("value"))


def event_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("id"),
        F.col("props").alias("title"),
        F.col("ts").alias("published_at"),
        F.col("user_id").cast("string").alias("source"),
        F.concat(F.lit("/item/"), F.col("event_id").cast("string")).alias("url"),
    )
