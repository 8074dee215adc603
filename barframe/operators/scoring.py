"""The 0-100 score of a bar."""

from __future__ import annotations

from pyspark.sql import DataFrame


def add_score(df: DataFrame) -> DataFrame:
    """Score of each row's bar; rows of a history or of ``latest_rows``.

    Series of 10 to 19 bars have no indicators, so the neutral defaults count: 15 for the RSI and
    10 for a rise. Shorter ones score 0.
    """
    rules = [
        "if(close > ma20, 20, 0)",
        "if(ma20 > ma60, 15, 0)",
        "if(ma5 > ma10 and ma10 > ma20, 15, 0)",
        "case when vol_ratio > 1.2D then 10 when vol_ratio < 0.8D then 4 else 0 end",
        "if(macd > macd_signal, 15, 0)",
        "case when rsi >= 45D and rsi <= 70D then 15 when rsi < 35D then 8 else 0 end",
        "if(cmf > 0, 10, 0)",
        "if(close > prev_close, 10, 0)",
        "if(adx >= 25D, 5, 0)",
    ]
    return df.selectExpr(
        "*",
        "case when n_bars < 10 then 0"
        " when n_bars < 20 then 15 + if(close > prev_close, 10, 0)"
        f" else greatest(0, least(100, {' + '.join(rules)})) end as score",
    )
