"""Tables made from the analysis for display and for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.tickers import market_colors
from barframe.operators.latest import LOOKBACK
from barframe.operators.pivots import add_levels, last_items
from barframe.operators.series import top_per_key
from barframe.operators.signals import fired
from barframe.schema import DEFAULT_PERIOD_BARS, PERIOD_BARS, PRICES, SERIES

HOURLY_CHART_BARS = 200


def hot_tags(analysis: DataFrame) -> DataFrame:
    tags = fired(
        ("vpa_signal = 'attack'", "attack"),
        ("money_status = 'inflow'", "inflow"),
        ("trend in ('strong_bull', 'bull')", "uptrend"),
        ("macd_divergence = 'top'", "top_divergence"),
    )
    return analysis.selectExpr(*SERIES, "mode", f"{tags} as tags")


def risk_messages(analysis: DataFrame) -> DataFrame:
    risks = fired(
        ("macd_divergence = 'top'", "macd_top_divergence"),
        ("rsi_divergence = 'top'", "rsi_top_divergence"),
        ("rsi > 80D", "rsi_overbought"),
        ("vpa_signal = 'heavy_drop'", "heavy_drop"),
    )
    return analysis.selectExpr(*SERIES, "mode", f"{risks} as risks")


def score_vector(analysis: DataFrame) -> DataFrame:
    """Long table (dimension, score) of the five scores."""
    wide = analysis.selectExpr(
        *SERIES,
        "mode",
        "trend_score as trend",
        "vpa_score as volume_price",
        "rsi_score + bias_score as momentum",
        "money_score as money",
        "total_score as total",
    )
    return wide.unpivot(
        [*SERIES, "mode"],
        ["trend", "volume_price", "momentum", "money", "total"],
        "dimension",
        "score",
    )


def readings(analysis: DataFrame) -> DataFrame:
    """Plain words for each indicator."""
    return analysis.selectExpr(
        *SERIES,
        "mode",
        "case when ma5 > ma10 and ma10 > ma20 then 'bull_order'"
        " when ma5 < ma10 and ma10 < ma20 then 'bear_order' else 'mixed' end as short_trend",
        "if(price > ma60, 'above_ma60', 'below_ma60') as long_trend",
        "if(macd_hist > 0, 'red', 'green') as macd_side",
        "case when vol_ratio > 1.2D then 'heavy' when vol_ratio < 0.8D then 'thin'"
        " else 'normal' end as volume_word",
        "case when rsi > 70D then 'overbought' when rsi < 30D then 'oversold'"
        " else 'neutral' end as rsi_word",
        "if(abs(bias) > 8D, 'stretched', 'normal') as bias_word",
        "case when cmf > 0 then 'inflow' when cmf < 0 then 'outflow' else 'balanced' end"
        " as cmf_word",
        "case when mfi > 80D then 'overheated' when mfi < 20D then 'oversold'"
        " else 'healthy' end as mfi_word",
    )


CHART_COLUMNS = ["ma5", "ma20", "ma60", "vol_ma20", "macd", "macd_signal", "macd_hist", "rsi"]


def _drawn(bars: DataFrame) -> DataFrame:
    """Rise flag and the market's colour for it."""
    up = F.col("close") >= F.col("open")
    colors = market_colors("symbol")
    return bars.withColumns(
        {"is_up": up, "bar_color": F.when(up, colors["up"]).otherwise(colors["down"])}
    )


def chart_feed(history: DataFrame, period: str) -> DataFrame:
    """Last bars of each series as drawn: flags, colours, indicators, support and resistance.

    The levels come from the same bars, so the bars of a period (at most 1260) are gathered per
    series, given their levels and spread out again; the history is computed once.
    """
    n = PERIOD_BARS.get(period, DEFAULT_PERIOD_BARS)
    columns = ["pos", "ts", *PRICES, *CHART_COLUMNS]
    gathered = ", ".join(f"{c!r}, {c}" for c in columns)
    rows = (
        history.filter(F.col("pos") > F.col("n_bars") - max(n, LOOKBACK))
        .groupBy(*SERIES)
        .agg(F.expr(f"sort_array(collect_list(named_struct({gathered})))").alias("bars"))
    )
    rows = add_levels(rows.withColumn("tail", F.expr(last_items("bars", LOOKBACK))))
    shown = rows.selectExpr(
        *SERIES, "support", "resistance", f"explode({last_items('bars', n)}) as bar"
    ).select(*SERIES, "support", "resistance", *[f"bar.{c}" for c in columns if c != "pos"])
    colors = market_colors("symbol")
    return _drawn(shown).withColumn(
        "hist_color", F.when(F.col("macd_hist") >= 0, colors["up"]).otherwise(colors["down"])
    )


def hourly_chart_feed(history: DataFrame) -> DataFrame:
    recent = history.filter(F.col("pos") > F.col("n_bars") - HOURLY_CHART_BARS)
    return _drawn(recent.select(*SERIES, "ts", *PRICES, "ma5", "ma20"))


def report_context(
    analysis: DataFrame,
    composite: DataFrame | None = None,
    fundamentals: DataFrame | None = None,
    news: DataFrame | None = None,
    names: DataFrame | None = None,
    trend: DataFrame | None = None,
) -> DataFrame:
    """One JSON text per symbol and mode with all that a written report draws on.

    ``analysis`` may be ``deep_insight(...).latest``, whose rows bring view, scores and the hourly and weekly readings along;
    else ``composite`` adds them. ``names`` (symbol, name, ...) and ``trend`` (symbol and the words of ``fundamentals.trend_summary``) hold one row per
    symbol. The newest four periods of ``fundamentals`` (symbol, period, ...) and the first five items of
    ``news`` (symbol, rank, ...) are gathered into arrays per symbol, cut before they are gathered.
    """
    if fundamentals is not None:
        fundamentals = top_per_key(
            fundamentals, ["symbol"], [F.desc("period")], 4, ["period"], "_rank"
        ).drop("_rank")
    if news is not None:
        news = news.filter("rank <= 5")
    df = analysis.select(*SERIES, "mode", F.struct(*[c for c in analysis.columns]).alias("analysis"))
    parts = ["analysis"]
    if composite is not None:
        packed = F.struct(*[c for c in composite.columns if c != "symbol"]).alias("scores")
        df = df.join(composite.select("symbol", packed), "symbol", "left")
        parts.append("scores")
    for name, table in (("instrument", names), ("trend", trend)):
        if table is not None:
            df = df.join(table.select("symbol", F.struct(*[c for c in table.columns if c != "symbol"]).alias(name)), "symbol", "left")
            parts.append(name)
    for name, table in (("fundamentals", fundamentals), ("news", news)):
        if table is not None:
            fields = [c for c in table.columns if c != "symbol"]
            rows = table.groupBy("symbol").agg(
                F.sort_array(F.collect_list(F.struct(*fields))).alias(name)
            )
            df = df.join(rows, "symbol", "left")
            parts.append(name)
    return df.select(*SERIES, "mode", F.to_json(F.struct(*parts)).alias("context"))
