"""Pattern and signal rules. Each adds one column and reads only its own row.

Rules that need only lagged columns work on every bar of a history as well as on ``latest_rows``;
price patterns read ``tail`` and so only the latter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from barframe.functions.text import fixed
from barframe.operators.pivots import field, last_items, mean

CHANGE = "try_divide(close - prev_close, prev_close) * 100D"


def fired(*rules: tuple[str, str]) -> str:
    """Array of the labels of all rules that hold, in order."""
    items = ", ".join(f"if({rule}, '{label}', null)" for rule, label in rules)
    return f"array_compact(array({items}))"


def add_volume_price_signals(df: DataFrame) -> DataFrame:
    rules = fired(
        (f"{CHANGE} > 0 and vol_ratio > 1.2D", "vol_up"),
        (f"{CHANGE} < 0 and vol_ratio > 1.2D", "vol_down"),
        ("vol_ratio_min3 > 1.2D", "vol_up_3"),
        (f"{CHANGE} > 0 and vol_ratio < 0.8D", "up_on_low_vol"),
        (f"{CHANGE} < 0 and vol_ratio > 1.2D", "down_on_high_vol"),
    )
    means = ", ', ', ".join(
        f"'MA{n}=', coalesce({fixed(f'vol_ma{n}', 0)}, 'nan')" for n in (5, 10, 20)
    )
    return df.selectExpr(
        "*",
        f"if(pos < 3, cast(array() as array<string>), {rules}) as vp_signals",
        f"if(pos < 3, null, concat({means})) as volume_means",
    )


def add_volume_price_texts(df: DataFrame) -> DataFrame:
    """``vp_texts``: each of ``vp_signals`` in words, rises and falls on volume with change and ratio, then the volume means."""
    figures = f"concat({fixed(CHANGE, 2)}, '%, ratio ', {fixed('vol_ratio', 2)}, ')')"
    words = (
        f"case s when 'vol_up' then concat('up on volume (change ', {figures})"
        f" when 'vol_down' then concat('down on volume (change ', {figures})"
        " when 'vol_up_3' then 'volume up for three bars, strong momentum'"
        " when 'up_on_low_vol' then 'up on thin volume, weak advance'"
        " when 'down_on_high_vol' then 'down on heavy volume, selling pressure' end"
    )
    return df.selectExpr("*", f"array_compact(array_append(transform(vp_signals, s -> {words}), volume_means)) as vp_texts")


def add_candle_patterns(df: DataFrame) -> DataFrame:
    body = "abs(close - open)"
    rules = fired(
        (
            f"{body} > 0 and least(open, close) - low > 2D * {body}"
            f" and high - greatest(open, close) < {body}",
            "hammer",
        ),
        (
            "close > open and prev_close < prev_open and close > prev_open and open < prev_close",
            "bull_engulf",
        ),
        (
            "close < open and prev_close > prev_open and open > prev_close and close < prev_open",
            "bear_engulf",
        ),
    )
    return df.selectExpr(
        "*", f"if(pos < 2, cast(array() as array<string>), {rules}) as candle_patterns"
    )


def slope(array: str, n: int) -> str:
    """Least-squares slope of n values against 0..n-1."""
    centre = (n - 1) / 2
    weight = sum((i - centre) ** 2 for i in range(n))
    return (
        f"aggregate(transform({array}, (x, i) -> (i - {centre}D) * x), 0D, (acc, x) -> acc + x)"
        f" / {weight}D"
    )


PATTERN_BARS, SLOPE_BARS = 30, 15
#: Of columns _mean, _top and _bottom of the bars, slopes _hs and _ls of highs and lows, and percent moves _m20 and _m5.
PRICE_RULES = fired(
    ("_mean > 0 and (_top - _bottom) / _mean < 0.08D", "box"),
    ("_hs < 0 and _ls > 0", "triangle"),
    ("abs(_m20) > 10D and abs(_m5) < 4D", "flag"),
)


def add_price_patterns(latest: DataFrame, lookback: int = PATTERN_BARS) -> DataFrame:
    df = latest.selectExpr("*", f"{last_items('tail', lookback)} as _t")
    df = df.selectExpr(
        "*",
        f"{field('_t', 'high')} as _h",
        f"{field('_t', 'low')} as _l",
        f"{field('_t', 'close')} as _c",
    ).selectExpr(
        "*",
        f"{mean('_c')} as _mean",
        "array_max(_h) as _top",
        "array_min(_l) as _bottom",
        f"{slope(last_items('_h', SLOPE_BARS), SLOPE_BARS)} as _hs",
        f"{slope(last_items('_l', SLOPE_BARS), SLOPE_BARS)} as _ls",
        *[
            f"try_divide(close - get(_c, size(_c) - {n}), get(_c, size(_c) - {n})) * 100D as _m{n}"
            for n in (20, 5)
        ],
    )
    return df.selectExpr(
        "*",
        f"if(n_bars < {lookback}, cast(array() as array<string>), {PRICE_RULES}) as price_patterns",
    ).drop("_t", "_h", "_l", "_c", "_mean", "_top", "_bottom", "_hs", "_ls", "_m20", "_m5")


def add_structured_signals(df: DataFrame) -> DataFrame:
    """array<struct(type, name, strength)>"""

    def signal(kind: str, name: str, strength: str) -> str:
        return (
            f"named_struct('type', '{kind}', 'name', '{name}',"
            f" 'strength', cast({strength} as double))"
        )

    heavy = "least(1D, vol_ratio / 2D)"
    items = [
        f"case when {CHANGE} > 0 and vol_ratio > 1.2D then {signal('bullish', 'vol_up', heavy)}"
        f" when {CHANGE} < 0 and vol_ratio > 1.2D then {signal('bearish', 'vol_down', heavy)}"
        f" when {CHANGE} > 0 and vol_ratio < 0.8D then {signal('neutral', 'up_low_vol', '0.4')}"
        f" when {CHANGE} < 0 and vol_ratio < 0.8D then {signal('bullish', 'down_low_vol', '0.6')}"
        " end",
        f"if(close > ma20, {signal('bullish', 'above_ma20', '0.7')},"
        f" {signal('bearish', 'below_ma20', '0.7')})",
        f"case when macd > macd_signal then {signal('bullish', 'macd_golden', '0.8')}"
        f" when macd < macd_signal then {signal('bearish', 'macd_dead', '0.8')} end",
    ]
    return df.selectExpr(
        "*",
        "if(n_bars < 20 or pos < 3,"
        " cast(array() as array<struct<type: string, name: string, strength: double>>),"
        f" array_compact(array({', '.join(items)}))) as structured_signals",
    )


def add_trade_triggers(df: DataFrame) -> DataFrame:
    aligned = "ma5 > ma10 and ma10 > ma20"
    was = "prev_ma5 > prev_ma10 and prev_ma10 > prev_ma20"
    rules = fired(
        ("close > prev_high20", "breakout20"),
        ("close > ma20 and vol_ratio < 0.8D", "pullback_ma20"),
        ("vol_ratio > 1.5D and close > prev_close", "ignition"),
        (f"{aligned} and not coalesce({was}, false)", "ma_alignment"),
    )
    return df.selectExpr(
        "*", f"if(n_bars < 20 or pos < 20, cast(array() as array<string>), {rules}) as triggers"
    )


def _too_short(analysis: DataFrame) -> str:
    return "n_bars < 20" if "n_bars" in analysis.columns else "false"


def add_behavior(analysis: DataFrame) -> DataFrame:
    """Big-money behaviour: struct(behavior, confidence, description); unknown for a series under 20 bars."""

    def found(name: str, confidence: float, text: str) -> str:
        return (
            f"named_struct('behavior', '{name}', 'confidence', {confidence}D,"
            f" 'description', '{text}')"
        )

    held = "chip_concentration = 'concentrated'"
    quiet = "abs(change) < 2D and vol_ratio > 0.8D and vol_ratio < 1.5D and cmf > 0.05D"
    return analysis.selectExpr(
        "*",
        f"case when {_too_short(analysis)} then {found('unknown', 0.0, 'insufficient data')}"
        f" when {quiet} and {held}"
        f" then {found('accumulation', 0.7, 'quiet price and mild inflow')}"
        f" when change < 0 and vol_ratio < 0.8D and cmf > -0.1D and {held}"
        f" then {found('washout', 0.75, 'falling on thin volume')}"
        " when change > 0 and vol_ratio > 1.2D and cmf > 0.1D and rsi > 50D and macd_hist > 0"
        f" then {found('markup', 0.85, 'rising on volume with inflow')}"
        " when vol_ratio > 1.5D and (abs(change) < 1D or change < 0) and cmf < -0.05D"
        " and obv_divergence = 'top'"
        f" then {found('distribution', 0.8, 'heavy volume without progress')}"
        f" else {found('watch', 0.5, 'no clear action')} end as behavior",
    )


def add_dip_entry(analysis: DataFrame) -> DataFrame:
    """Grade a sharp fall as an entry: struct(score, action, reason, position, stop, target).

    Reads ``atr_mult`` of the row's trade mode.
    """
    near, short = "(price - support) / price * 100D", _too_short(analysis)
    parts = [
        "if(vol_ratio < 0.8D, 30, -20)",
        "case when _near > 0 and _near < 3D then 30 when _near < 0 then -40 else 10 end",
        "case when rsi < 30D then 20 when rsi < 40D then 10 else 0 end",
        "if(cmf > 0, 15, -10)",
    ]
    reasons = [
        "if(vol_ratio < 0.8D, 'thin volume', 'heavy volume')",
        f"case when _near > 0 and _near < 3D then concat('near support ', {fixed('support', 2)},"
        f" ' (', {fixed('_near', 1)}, '%)')"
        " when _near < 0 then 'below support' else 'far from support' end",
        f"case when rsi < 30D then concat('RSI=', {fixed('rsi', 1)}, ' oversold')"
        f" when rsi < 40D then concat('RSI=', {fixed('rsi', 1)}, ' near oversold') end",
        "if(cmf > 0, 'CMF positive', 'CMF negative')",
    ]
    df = analysis.selectExpr("*", f"{near} as _near", "change > -2D as _mild")
    df = df.selectExpr(
        "*",
        f"if({short} or _mild, 0, greatest(0, least(100, {' + '.join(parts)}))) as _points",
        f"case when {short} then 'insufficient data' when _mild then 'fall too small'"
        f" else array_join(array_compact(array({', '.join(reasons)})), '；') end as _why",
    )
    grade = "case when _points >= 70 then {} when _points >= 50 then {} else {} end"
    fields = {
        "score": "_points",
        "action": grade.format("'active'", "'cautious'", "'none'"),
        "reason": "_why",
        "suggested_position": grade.format("0.05D", "0.02D", "0D"),
        "stop_loss": grade.format(
            "price - atr_mult * atr", "price - atr_mult * atr * 0.8D", "null"
        ),
        "target": grade.format(
            "price + atr_mult * atr * 1.5D", "price + atr_mult * atr * 1.2D", "null"
        ),
    }
    packed = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return df.selectExpr("*", f"named_struct({packed}) as dip").drop(
        "_near", "_mild", "_points", "_why"
    )
