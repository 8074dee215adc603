"""Ticker expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barframe.functions.numeric import col
from barframe.schema import DOWN_GREEN, UP_RED


def clean_ticker(ticker: Column | str) -> Column:
    return F.upper(F.trim(col(ticker)))


def is_six_digit(ticker: Column | str) -> Column:
    return clean_ticker(ticker).rlike("^[0-9]{6}$")


def normalize_ticker(ticker: Column | str) -> Column:
    """Six-digit codes get their exchange suffix; all else is only trimmed and upper-cased."""
    t = clean_ticker(ticker)
    board = F.substring(t, 1, 2)
    return (
        F.when(is_six_digit(ticker) & board.isin("60", "68"), F.concat(t, F.lit(".SS")))
        .when(is_six_digit(ticker) & board.isin("00", "30"), F.concat(t, F.lit(".SZ")))
        .otherwise(t)
    )


def market_colors(ticker: Column | str) -> Column:
    """struct(up, down): the six-digit market paints rises red."""
    home = is_six_digit(ticker)
    return F.struct(
        F.when(home, UP_RED).otherwise(DOWN_GREEN).alias("up"),
        F.when(home, DOWN_GREEN).otherwise(UP_RED).alias("down"),
    )
