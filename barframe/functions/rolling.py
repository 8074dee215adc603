"""Rolling and exponential means over a framed series (see ``operators.series``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barframe.functions.numeric import col

# A frame's rows are grouped by KEY and ordered by ROW; the block number leads the order so that
# one sort serves both the whole-segment windows and the per-block ones.
KEY = ["symbol", "interval", "seg"]
ROW = ["blk", "ts"]
BLOCK = 512

BY_ROW = "partition by symbol, interval, seg order by blk, ts"
SO_FAR = f"({BY_ROW} rows between unbounded preceding and current row)"
WHOLE = f"({BY_ROW} rows between unbounded preceding and unbounded following)"
STEP_BACK = f"({BY_ROW})"
BY_BLOCK = "partition by symbol, interval, seg order by blk"
IN_BLOCK = (
    "(partition by symbol, interval, seg, blk order by ts"
    " rows between unbounded preceding and current row)"
)


def last_rows(n: int) -> str:
    return f"({BY_ROW} rows between {n - 1} preceding and current row)"


def ordered() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy(*ROW)


def rolling(agg, c: Column | str, n: int, min_periods: int) -> Column:
    """``agg`` over the last ``n`` bars, NULL below ``min_periods`` non-null values."""
    frame = ordered().rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) >= min_periods, agg(col(c)).over(frame))


def alpha_of_span(span: int) -> float:
    return 2.0 / (span + 1.0)


def rows_lost_after(alpha: float, rows: int) -> int:
    """How many blocks of ``rows`` back a value's weight is below the smallest double."""
    return int(745.0 / (-math.log1p(-alpha) * rows)) + 2


def number(x: float) -> str:
    return f"{x!r}D"


def decayed(alpha: float, steps: str) -> str:
    return f"power({number(1 - alpha)}, {steps})"


def ewm_columns(
    df: DataFrame, means: dict[str, tuple[str, float, str]], block: int = BLOCK
) -> DataFrame:
    """Add unadjusted exponential means ``{output: (input, alpha, is_seed)}``.

    y[t] = (1 - a) y[t-1] + a x[t], where the row for which ``is_seed`` holds counts fully.
    Spark has no such function. Within a block of rows it is a running sum of scaled terms; the
    last value of each earlier block of the segment is folded in after. No row is read twice and
    no Python runs. A segment starts from zero: ``operators.indicators`` adds what earlier
    segments hand over. NULL inputs count as absent and may only lead.
    """
    lookback = max(rows_lost_after(a, block) for _, a, _ in means.values())
    earlier = f"({BY_BLOCK} range between {lookback} preceding and 1 preceding)"
    tick = f"cast(pmod(step - 1, {block}) as double)"
    df = df.selectExpr(
        "*",
        f"{tick} as _tick",
        *[
            f"{x} * if({seed}, 1D, {number(a)}) * {decayed(a, '-' + tick)} as _w_{y}"
            for y, (x, a, seed) in means.items()
        ],
    )
    df = df.selectExpr(
        "*",
        *[
            f"sum(_w_{y}) over {IN_BLOCK} * {decayed(a, '_tick')} as _l_{y}"
            for y, (_, a, _) in means.items()
        ],
    ).drop(*[f"_w_{y}" for y in means])
    fields = ", ".join(f"'{y}', _l_{y}" for y in means)
    df = df.selectExpr(
        "*",
        f"collect_list(if(step > 0 and _tick = {block - 1}, named_struct({fields}), null))"
        f" over {earlier} as _ends",
    )
    folded = {
        y: f"aggregate(_ends, 0D, (acc, e) -> acc * {number((1 - a) ** block)} + coalesce(e.{y}, 0D))"
        for y, (_, a, _) in means.items()
    }
    return df.selectExpr(
        "*",
        *[
            f"_l_{y} + if(size(_ends) = 0, 0D, {folded[y]} * {decayed(a, '_tick + 1')}) as {y}"
            for y, (_, a, _) in means.items()
        ],
    ).drop("_tick", "_ends", *[f"_l_{y}" for y in means])


def exponential_mean(
    frame: DataFrame, column: str, output: str, alpha: float, min_periods: int = 1, block: int = BLOCK
) -> DataFrame:
    """Exponential mean of one column of a single-segment frame, seeded by its first value."""
    df = frame.selectExpr(
        "*",
        f"min(if({column} is null, null, pos)) over {WHOLE} as _seed",
        f"count({column}) over {SO_FAR} as _seen",
    )
    df = ewm_columns(df, {output: (column, alpha, "pos = _seed")}, block)
    return df.withColumn(
        output, F.when(F.col("_seen") >= min_periods, F.col(output))
    ).drop("_seed", "_seen")
