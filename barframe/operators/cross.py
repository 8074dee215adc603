"""Across intervals and across symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barframe.operators.indicators import latest_history
from barframe.operators.scoring import add_score
from barframe.schema import DAILY, HOURLY, VIEW_INTERVALS, VIEWS, WEEKLY, bars_kept

MIN_BARS = 20


def last_bars(history: DataFrame) -> DataFrame:
    """The last bar of each series with its indicators."""
    return history.filter(F.col("pos") == F.col("n_bars"))


def _interval_columns(over: WindowSpec | None = None) -> list[Column]:
    """Score, availability and a few last values for each interval, over a symbol's scored last bars."""

    def pick(interval: str, column: str) -> Column:
        found = F.max(F.when(F.col("interval") == interval, F.col(column)))
        return found if over is None else found.over(over)

    columns = []
    for interval, name in ((DAILY, "daily"), (WEEKLY, "weekly"), (HOURLY, "hourly")):
        columns.append(pick(interval, "score").alias(f"score_{name}"))
        columns.append((pick(interval, "n_bars") >= MIN_BARS).alias(f"has_{name}"))
    for name, interval, fields in (
        ("hourly", HOURLY, ("close", "rsi", "macd_hist", "vol_ratio")),
        ("weekly", WEEKLY, ("close", "rsi", "macd_hist", "ma20")),
    ):
        columns += [pick(interval, f).alias(f"{name}_{f}") for f in fields]
    return columns


def scores_by_interval(history: DataFrame) -> DataFrame:
    """One row per symbol: score, availability and a few last values for each interval."""
    return add_score(last_bars(history)).groupBy("symbol").agg(*_interval_columns())


def with_interval_scores(scored: DataFrame) -> tuple[DataFrame, list[str]]:
    """Scored last bars, three a symbol at most, each with its symbol's ``scores_by_interval``; the names added."""
    out = scored.select("*", *_interval_columns(Window.partitionBy("symbol")))
    return out, out.columns[len(scored.columns) :]


def composite(by_interval: DataFrame, views: str | list[str], carried: list[str] | None = None) -> DataFrame:
    """Weighted mean of the interval scores a view uses, over those with enough bars; a row per symbol and view.

    A view that asks for hourly bars and lacks them falls back to daily alone. ``carried`` names
    columns that stay.
    """

    def row(view: str) -> str:
        _, daily, weekly, hourly = VIEWS[view]
        uses = VIEW_INTERVALS[view]
        return (
            f"named_struct('view', '{view}', 'daily', {daily}D, 'weekly', {weekly}D, 'hourly', {hourly}D,"
            f" 'uses_w', {str(WEEKLY in uses).lower()}, 'uses_h', {str(HOURLY in uses).lower()})"
        )

    names = [views] if isinstance(views, str) else dict.fromkeys(views)
    rows = ", ".join(row(v) for v in names)
    df = by_interval.selectExpr("*", f"explode(array({rows})) as _v").selectExpr(
        "*",
        "coalesce(has_daily, false) as _d",
        "_v.uses_w and coalesce(has_weekly, false) as _w",
        "_v.uses_h and coalesce(has_hourly, false) as _h",
    )
    df = df.selectExpr(
        "*",
        "if(_v.uses_h and not _h, 1D, _v.daily) as w_daily",
        "_v.weekly as w_weekly",
        "if(_v.uses_h and not _h, 0D, _v.hourly) as w_hourly",
    )
    parts = (("_d", "daily"), ("_w", "weekly"), ("_h", "hourly"))
    weight = " + ".join(f"if({a}, w_{n}, 0D)" for a, n in parts)
    points = " + ".join(f"if({a}, score_{n} * w_{n}, 0D)" for a, n in parts)
    plain = " + ".join(f"if({a}, score_{n}, 0)" for a, n in parts)
    count = " + ".join(f"cast({a} as int)" for a, _ in parts)
    return df.selectExpr(
        "symbol",
        "_v.view as view",
        *(carried or []),
        *[f"if({a}, score_{n}, null) as score_{n}" for a, n in parts],
        "w_daily",
        "w_weekly",
        "w_hourly",
        f"coalesce(try_divide({points}, if({weight} > 0, {weight}, null)),"
        f" try_divide(cast({plain} as double), cast({count} as double)), 0D) as composite_score",
        *[f"if(_h, hourly_{f}, null) as hourly_{f}" for f in ("close", "rsi", "macd_hist", "vol_ratio")],
        *[f"if(_v.uses_w, weekly_{f}, null) as weekly_{f}" for f in ("close", "rsi", "macd_hist", "ma20")],
    )


def sector_heatmap(bars: DataFrame, sectors: DataFrame, period: str = "1mo") -> DataFrame:
    """Score and trend of each sector's leading symbol, best first.

    ``sectors`` (sector, symbol) has one row per sector. Only the leaders' bars are read on; whether
    the leaders are broadcast is left to Spark, which knows their size. A sector without 20 bars
    of its leader gets score 0.
    """
    leaders = sectors.select("symbol").filter("symbol is not null").distinct()
    daily = bars.filter(F.col("interval") == DAILY).join(leaders, "symbol", "left_semi")
    history = latest_history(daily, bars_kept(period)[DAILY])
    aligned = "close > ma20 and ma5 > ma10 and ma10 > ma20"
    scored = (
        add_score(last_bars(history))
        .filter(F.col("n_bars") >= MIN_BARS)
        .selectExpr(
            "symbol",
            "score",
            f"case when {aligned} then 'strong' when close > ma20 then 'up'"
            " when close < ma20 then 'down' else 'range' end as trend",
            "n_bars",
        )
    )
    return (
        sectors.join(scored, "symbol", "left")
        .selectExpr(
            "sector",
            "symbol as code",
            "coalesce(score, 0) as score",
            "coalesce(trend, 'no_data') as trend",
            "coalesce(n_bars, 0) as bars",
        )
        .orderBy(F.desc("score"), "sector")
    )
