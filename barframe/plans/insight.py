"""End-to-end plans: everything the engine says about all symbols of a bars table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from barframe.operators.analysis import MIN_BARS, RECORD, analyze_rows, pattern_record
from barframe.operators.cross import composite, last_bars, scores_by_interval, with_interval_scores
from barframe.operators.indicators import latest_history
from barframe.operators.resample import with_weekly_fallback
from barframe.operators.scoring import add_score
from barframe.operators.signals import (
    add_behavior,
    add_dip_entry,
    add_structured_signals,
    add_trade_triggers,
)
from barframe.schema import DAILY, VIEWS, bars_kept
from barframe.sources.readers import scan_window


@dataclass(frozen=True)
class Insight:
    """Lazy result tables; nothing runs until one is used."""

    history: DataFrame
    latest: DataFrame
    analysis: DataFrame
    signals: DataFrame
    composite: DataFrame
    notes: DataFrame


def deep_insight(
    bars: DataFrame,
    view: str = "short",
    mode: str = "short",
    period: str | None = None,
    as_of: Column | None = None,
    instruments: DataFrame | None = None,
) -> Insight:
    """Analysis, signals and blended score of every symbol for one view and trade mode."""
    period = period or VIEWS[view][0]
    if as_of is not None:
        bars = scan_window(bars, period, as_of)
    bars, notes = with_weekly_fallback(bars, shared=True)
    # hourly bars keep 320 whatever the period
    history = latest_history(bars, bars_kept(period))
    latest = _latest(history, view, mode, instruments)
    analysis = latest.filter(f"n_bars >= {MIN_BARS}").select(*RECORD, "behavior", "dip")
    signals = latest.select("symbol", "interval", "ts", "structured_signals", "triggers")
    return Insight(history, latest, analysis, signals, composite(scores_by_interval(history), view), notes)


def _latest(history: DataFrame, view: str, mode: str, instruments: DataFrame | None) -> DataFrame:
    """All of it in one row for each symbol that has daily bars, from one pass over the last bars.

    A symbol's intervals, one row each by then, meet in a window over the symbol.
    """
    signals = ["structured_signals", "triggers"]
    rows = add_trade_triggers(add_structured_signals(pattern_record(history, 1)))
    rows, scores = with_interval_scores(add_score(rows))
    daily = rows.filter(f"interval = '{DAILY}'")
    record = analyze_rows(daily, [mode], instruments, ["n_bars", *signals, *scores])
    told = add_dip_entry(add_behavior(record))
    return composite(told, view, [c for c in told.columns if c not in ("symbol", *scores)])


def top_scores(bars: DataFrame, period: str = "1y", n: int = 10) -> DataFrame:
    """The n best scored series: read bars, cut, compute, score, rank."""
    history = latest_history(bars, bars_kept(period))
    return (
        add_score(last_bars(history))
        .selectExpr("symbol", "interval", "ts", "close", "score", "n_bars")
        .orderBy("score", "symbol", ascending=[False, True])
        .limit(n)
    )
