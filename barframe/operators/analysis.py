"""The analysis record: snapshot, classes, scores, levels, stop, target and position size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.text import fixed, percent
from barframe.operators.latest import latest_rows
from barframe.operators.pivots import add_concentration, add_divergences, add_levels
from barframe.operators.signals import (
    CHANGE,
    add_candle_patterns,
    add_price_patterns,
    add_volume_price_signals,
)
from barframe.schema import DEFAULT_MODE, SERIES, TRADE_MODES

MIN_BARS = 20

# latest value, else last known one, else this
SNAPSHOT = {
    "ma5": "coalesce(ma5, close)",
    "ma10": "coalesce(ma10, close)",
    "ma20": "coalesce(ma20, close)",
    "ma60": "coalesce(ma60, ma20, close)",
    "ma120": "coalesce(ma120, ma60, ma20, close)",
    "vol_ma20": "coalesce(vol_ma20, volume)",
    "vol_ratio": "coalesce(known_vol_ratio, 1D)",
    "vol_ratio_high": "coalesce(vol_ratio_high, 1.5D)",
    "vol_ratio_low": "coalesce(vol_ratio_low, 0.8D)",
    "rsi": "coalesce(known_rsi, 50D)",
    "bias": "coalesce(known_bias, 0D)",
    "adx": "coalesce(known_adx, 20D)",
    "plus_di": "coalesce(known_plus_di, 25D)",
    "minus_di": "coalesce(known_minus_di, 25D)",
    "cmf": "coalesce(known_cmf, 0D)",
    "mfi": "coalesce(known_mfi, 50D)",
    "macd": "coalesce(macd, 0D)",
    "macd_signal": "coalesce(macd_signal, 0D)",
    "macd_hist": "coalesce(macd_hist, 0D)",
    "atr": "if(coalesce(atr, 0D) <= 0, 0.02D * close, atr)",
}


def mode_of(mode: str | None) -> str:
    return mode if mode in TRADE_MODES else DEFAULT_MODE


def with_modes(df: DataFrame, modes: list[str]) -> DataFrame:
    """Each row once per trade mode, with the mode's parameters."""
    rows = ", ".join(
        "named_struct('mode', '{}', 'atr_mult', {}D, 'rsi_ob', {}D, 'rsi_os', {}D)".format(
            m, *TRADE_MODES[m]
        )
        for m in dict.fromkeys(mode_of(m) for m in modes)
    )
    return df.selectExpr("*", f"explode(array({rows})) as _m").select(*df.columns, "_m.*")


def pattern_record(history: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """Latest bar of every long enough series with levels, divergences, patterns and signals."""
    df = latest_rows(history).filter(F.col("n_bars") >= min_bars)
    df = add_concentration(add_divergences(add_levels(df)))
    return add_price_patterns(add_candle_patterns(add_volume_price_signals(df)))


def _classes(df: DataFrame) -> DataFrame:
    bull, bear = "ma5 > ma10 and ma10 > ma20", "ma5 < ma10 and ma10 < ma20"
    money_notes = [
        f"concat('CMF=', {fixed('cmf', 2)}, case when cmf > 0.1D then ' inflow'"
        " when cmf < -0.1D then ' outflow' else ' neutral' end)",
        f"case when mfi >= 40D and mfi <= 70D then concat('MFI=', {fixed('mfi', 1)}, ' mild')"
        f" when mfi > 80D then concat('MFI=', {fixed('mfi', 1)}, ' overheated')"
        f" when mfi < 25D then concat('MFI=', {fixed('mfi', 1)}, ' oversold') end",
        "case obv_divergence when 'bottom' then 'OBV bottom divergence'"
        " when 'top' then 'OBV top divergence' end",
    ]
    money = [
        "case when cmf > 0.1D then 8 when cmf < -0.1D then 2 else 5 end",
        "case when mfi >= 40D and mfi <= 70D then 5 when mfi > 80D then -1"
        " when mfi < 25D then 2 else 0 end",
        "case obv_divergence when 'bottom' then 4 when 'top' then -4 else 0 end",
    ]
    trend = [
        "if(price > ma20, 8, 0)",
        "if(price > ma60, 8, 0)",
        f"if({bull}, 8, 0)",
        "case when adx >= 25D and plus_di > minus_di then 6"
        " when adx >= 25D and plus_di < minus_di then -3 else 0 end",
    ]
    vpa = (
        "case when change > 0 and vol_ratio > vol_ratio_high then {}"
        " when change < 0 and vol_ratio < vol_ratio_low and price > ma20 then {}"
        " when change > 0 and vol_ratio < vol_ratio_low then {}"
        " when change < 0 and vol_ratio > vol_ratio_high then {} else {} end"
    )
    rsi = (
        "case when rsi >= rsi_os and rsi <= rsi_ob then {} when rsi > rsi_ob then {}"
        " else {} end"
    )
    bias = "case when abs(bias) <= 5D then {} when abs(bias) <= 8D then {} else {} end"
    ratio = fixed("vol_ratio", 2)
    return df.selectExpr(
        "*",
        "if(adx >= 25D, 'strong', 'weak') as trend_strength",
        f"case when {bull} and price > ma60 and plus_di >= minus_di"
        " then if(adx >= 25D, 'strong_bull', 'bull')"
        f" when {bear} and price < ma60 and minus_di > plus_di"
        " then if(adx >= 25D, 'strong_bear', 'bear')"
        " when price >= ma20 then 'range_up' else 'range_down' end as trend",
        f"greatest(0, least(30, {' + '.join(trend)})) as trend_score",
        vpa.format("'attack'", "'low_vol_pullback'", "'up_low_vol'", "'heavy_drop'", "'neutral'")
        + " as vpa_signal",
        vpa.format(20, 15, 6, 2, 10) + " as vpa_score",
        vpa.format(
            f"concat('up, ratio ', {ratio}, ' > ', {fixed('vol_ratio_high', 2)})",
            f"concat('pullback, ratio ', {ratio}, ' < ', {fixed('vol_ratio_low', 2)})",
            "'rise without volume'",
            "'panic selling'",
            f"concat('ratio ', {ratio}, ' within range')",
        )
        + " as vpa_detail",
        rsi.format("'healthy'", "'overbought'", "'oversold'") + " as rsi_status",
        rsi.format(15, 5, 8) + " as rsi_score",
        bias.format("'normal'", "'moderate'", "'severe'") + " as bias_status",
        bias.format(10, 6, 2) + " as bias_score",
        "case when cmf > 0.1D then 'inflow' when cmf < -0.1D then 'outflow' else 'balanced' end"
        " as money_status",
        f"array_join(array_compact(array({', '.join(money_notes)})), '；') as money_detail",
        f"greatest(0, least(20, {' + '.join(money)})) as money_score",
    )


def _risk(df: DataFrame) -> DataFrame:
    df = df.selectExpr(
        "*",
        "least(support * 0.98D, price - atr_mult * atr) as _stop",
        "greatest(resistance * 0.99D, price + 2.2D * atr) as _target",
    ).selectExpr(
        "*",
        "if(_stop >= price, price - atr_mult * atr, _stop) as stop_loss",
        "if(_target <= price, price + 2.2D * atr, _target) as take_profit",
    )
    df = df.selectExpr(
        "*",
        "greatest(price - stop_loss, price * 0.004D) as _risk",
        "greatest(take_profit - price, price * 0.006D) as _reward",
    )
    return df.selectExpr(
        "*",
        "if(_risk > 0, _reward / _risk, 0D) as risk_reward",
        "if(_risk > 0, least(try_divide(0.02D, _risk / price), 0.5D), 0D) as position_size",
        "greatest(0, least(100, trend_score + vpa_score + rsi_score + bias_score + money_score))"
        " as total_score",
    ).drop("_stop", "_target", "_risk", "_reward")


def _status(df: DataFrame) -> DataFrame:
    by_score = (
        "case when total_score >= 75 then {} when total_score >= 60 then {}"
        " when total_score >= 45 then {} else {} end"
    )
    size = percent("position_size")
    return df.selectExpr(
        "*",
        by_score.format("'strong_long'", "'cautious_long'", "'watch'", "'avoid'") + " as status",
        by_score.format(
            f"concat('buy in parts, at most ', {size})",
            f"concat('follow with about ', {size})",
            "'wait for a breakout or a key level'",
            "'defend, take little part'",
        )
        + " as advice",
        by_score.format("'success'", "'info'", "'warning'", "'error'") + " as action_color",
    )


RECORD = [
    *SERIES,
    "ts",
    "mode",
    "atr_mult",
    "price",
    "change",
    "volume",
    "vol_ma20",
    "vol_ratio",
    "pe",
    "pb",
    "chip_concentration",
    "ma5",
    "ma10",
    "ma20",
    "ma60",
    "ma120",
    "trend",
    "trend_strength",
    "adx",
    "plus_di",
    "minus_di",
    "macd",
    "macd_signal",
    "macd_hist",
    "rsi",
    "bias",
    "rsi_status",
    "bias_status",
    "vpa_signal",
    "vpa_detail",
    "cmf",
    "mfi",
    "obv_divergence",
    "money_status",
    "money_detail",
    "stop_loss",
    "take_profit",
    "support",
    "resistance",
    "risk_reward",
    "position_size",
    "status",
    "advice",
    "action_color",
    "trend_score",
    "vpa_score",
    "rsi_score",
    "bias_score",
    "money_score",
    "total_score",
    "atr",
    "vp_signals",
    "volume_means",
    "candle_patterns",
    "price_patterns",
    "macd_divergence",
    "rsi_divergence",
]


def analyze(
    history: DataFrame,
    modes: list[str] | None = None,
    instruments: DataFrame | None = None,
    short_series: bool = False,
) -> DataFrame:
    """Analysis record of every series of at least 20 bars, once per trade mode.

    ``history`` comes from ``indicators.latest_history``. ``instruments`` may give pe and pb by
    symbol. With ``short_series`` shorter series have a row too and a column ``n_bars`` is added, by which
    ``signals.add_behavior`` and ``signals.add_dip_entry`` say that there is not enough data.
    """
    rows = pattern_record(history, 1 if short_series else MIN_BARS)
    return analyze_rows(rows, modes, instruments, ["n_bars"] if short_series else [])


def analyze_rows(
    rows: DataFrame,
    modes: list[str] | None = None,
    instruments: DataFrame | None = None,
    carried: list[str] | None = None,
) -> DataFrame:
    """The record of ``pattern_record``'s rows; ``carried`` names columns of theirs that stay."""
    df = rows.withColumn("change", F.expr(CHANGE))
    kept = [c for c in df.columns if c not in SNAPSHOT and not c.startswith("known_")]
    # every right-hand side reads the columns as they were, so the order is of no matter
    df = df.selectExpr(*kept, "close as price", *[f"{sql} as {c}" for c, sql in SNAPSHOT.items()])
    if instruments is None:
        df = df.selectExpr("*", "cast(null as double) as pe", "cast(null as double) as pb")
    else:
        df = df.join(instruments.select("symbol", "pe", "pb"), "symbol", "left")
    df = with_modes(df, modes or [DEFAULT_MODE])
    return _status(_risk(_classes(df))).select(*RECORD, *(carried or []))
