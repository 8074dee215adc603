"""From raw rows to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.functions.numeric import to_finite
from barframe.schema import HEADER_ALIASES, PRICES, SERIES


def rename_headers(raw: DataFrame) -> DataFrame:
    """Localised or capitalised headers to ours; several headers for one column are coalesced."""
    sources: dict[str, list[str]] = {}
    for name in raw.columns:
        target = HEADER_ALIASES.get(name, name.lower())
        sources.setdefault(target, []).append(name)
    return raw.select(
        *[
            (F.coalesce(*[F.col(f"`{n}`") for n in names]) if len(names) > 1 else F.col(f"`{names[0]}`")).alias(t)
            for t, names in sources.items()
        ]
    )


#: Written forms of a day, as pattern and ISO text. Month first where both orders could be meant.
DAY_FORMS = (
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3"),
    (r"^(1[3-9]|2\d|3[01])[/.-](\d{1,2})[/.-](\d{4})(?!\d)", "$3-$2-$1"),
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?!\d)", "$3-$1-$2"),
)


def wall_clock(text: Column | str) -> Column:
    """Text to a time without zone: an offset is dropped, the clock reading kept.

    Days are year-month-day with ``-``, ``/``, ``.`` or as eight digits, else month/day/year, or day/month/year where the
    first number is above 12.
    """
    bare = F.trim(text)
    for pattern, iso in DAY_FORMS:
        bare = F.regexp_replace(bare, pattern, iso)
    timed = F.regexp_replace(bare, r"(:\d{2}(\.\d+)?)\s*(Z|[+-]\d{2}:?\d{2})$", "$1")
    timed = F.regexp_replace(timed, r"^(\d{4}-\d{1,2}-\d{1,2})\s*(Z|[+-]\d{2}:?\d{2})$", "$1")
    return F.when(timed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), timed).try_cast("timestamp_ntz")


def clean_bars(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One finite bar per (symbol, interval, ts): of several the one with the largest ``order``.

    ``raw`` has text columns symbol, interval, date and the five numbers, under any known header.
    Rows lacking a time or a number are dropped. The choice among copies is an aggregation, so
    copies are combined before the exchange and no key's copies gather in one task. ``order`` must differ
    between copies of a bar: of equal ones any may win.
    """
    named = rename_headers(raw)
    bars = named.select(
        *SERIES,
        wall_clock(F.col("date").cast("string")).alias("ts"),
        *[to_finite(c).alias(c) for c in PRICES],
        order,
    ).dropna("any", subset=["ts", *PRICES])
    return bars.groupBy(*SERIES, "ts").agg(*[F.max_by(c, order).alias(c) for c in PRICES])


def rejected_bars(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """The rows that ``clean_bars`` leaves out, as they came (under our headers), with a ``reason``.

    The reason names the columns without a readable date or a finite number, joined by ``|``, or is ``superseded`` for a copy that a later
    one replaced. With ``clean_bars`` each row of ``raw`` is counted once, if ``order`` differs between copies of a bar.
    """
    named = rename_headers(raw)
    read = {"date": wall_clock(F.col("date").cast("string")), **{c: to_finite(c) for c in PRICES}}
    faults = F.array_compact(F.array(*[F.when(v.isNull(), c) for c, v in read.items()]))
    rows = named.withColumns({"_ts": read["date"], "_faults": faults})
    whole = rows.where(F.size("_faults") == 0)
    # the winner of a bar is found by an aggregation, combined before the exchange
    winners = whole.groupBy(*SERIES, "_ts").agg(F.max(order).alias("_winner"))
    replaced = whole.join(winners, [*SERIES, "_ts"]).where(~F.col(order).eqNullSafe(F.col("_winner")))
    faulty = rows.where(F.size("_faults") > 0).withColumn("reason", F.array_join("_faults", "|"))
    return faulty.select(*named.columns, "reason").unionByName(replaced.select(*named.columns, F.lit("superseded").alias("reason")))
