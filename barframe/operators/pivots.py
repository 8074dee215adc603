"""Levels, divergences and concentration, read from the ``tail`` array of ``latest_rows``.

The array holds at most 80 bars, so these are expressions over one row and need no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

LEVEL_REACH, LEVEL_PIVOTS, LEVEL_FALLBACK = 5, 3, 20
DIVERGENCE_BARS, DIVERGENCE_REACH, DIVERGENCE_MIN = 30, 2, 10
CHIP_BARS = 20
CHIP_CLASS = (
    "case when _mean = 0 then 'average'"
    " when volume_cv < 0.5D and range_place > 0.3D and range_place < 0.7D then 'concentrated'"
    " when volume_cv > 1D then 'dispersed' else 'neutral' end"
)


def last_items(array: str, n: int) -> str:
    return f"slice({array}, greatest(size({array}) - {n - 1}, 1), {n})"


def field(array: str, name: str) -> str:
    return f"transform({array}, x -> x.{name})"


def total(array: str) -> str:
    return f"aggregate({array}, 0D, (acc, x) -> acc + x)"


def mean(array: str) -> str:
    return f"try_divide({total(array)}, cast(size({array}) as double))"


def _peaks(values: str, reach: int, pick: str) -> str:
    """0-based places whose value is the extreme of the ``reach`` values on either side."""
    width = 2 * reach + 1
    around = f"slice({values}, i - {reach - 1}, {width})"
    return (
        f"if(size({values}) < {width}, cast(array() as array<int>),"
        f" filter(sequence({reach}, size({values}) - {reach + 1}),"
        f" i -> {values}[i] = {pick}({around})))"
    )


def add_levels(latest: DataFrame) -> DataFrame:
    """Support and resistance: the mean of the last three low and high pivots."""
    df = latest.selectExpr("*", f"{field('tail', 'high')} as _h", f"{field('tail', 'low')} as _l")
    df = df.selectExpr(
        "*",
        f"{_peaks('_h', LEVEL_REACH, 'array_max')} as _hp",
        f"{_peaks('_l', LEVEL_REACH, 'array_min')} as _lp",
    )

    def level(values: str, places: str, pick: str) -> str:
        picked = f"transform({last_items(places, LEVEL_PIVOTS)}, i -> {values}[i])"
        return (
            f"if(size({places}) > 0, {mean(picked)},"
            f" {pick}({last_items(values, LEVEL_FALLBACK)}))"
        )

    return df.selectExpr(
        "*",
        f"{level('_l', '_lp', 'array_min')} as support",
        f"{level('_h', '_hp', 'array_max')} as resistance",
    ).drop("_h", "_l", "_hp", "_lp")


def add_divergences(latest: DataFrame, indicators: tuple[str, ...] = ("macd", "rsi", "obv")) -> DataFrame:
    """``<indicator>_divergence``: top, bottom or none over the last 30 bars.

    Bars without the indicator are left out before pivots are looked for.
    """
    recent = last_items("tail", DIVERGENCE_BARS)
    df = latest.selectExpr(
        "*",
        *[f"filter({recent}, x -> x.{c} is not null) as _b_{c}" for c in indicators],
    )
    df = df.selectExpr("*", *[f"{field(f'_b_{c}', 'close')} as _p_{c}" for c in indicators])
    df = df.selectExpr(
        "*",
        *[
            f"{_peaks(f'_p_{c}', DIVERGENCE_REACH, pick)} as _{k}_{c}"
            for c in indicators
            for k, pick in (("hi", "array_max"), ("lo", "array_min"))
        ],
    )

    def crossed(c: str, k: str, price: str, indicator: str) -> str:
        places = f"_{k}_{c}"
        first, second = (f"get({places}, size({places}) - {n})" for n in (2, 1))
        return (
            f"size({places}) >= 2 and get(_p_{c}, {second}) {price} get(_p_{c}, {first})"
            f" and get(_b_{c}, {second}).{c} {indicator} get(_b_{c}, {first}).{c}"
        )

    out = df.selectExpr(
        "*",
        *[
            f"case when size(_b_{c}) < {DIVERGENCE_MIN} then 'none'"
            f" when {crossed(c, 'hi', '>', '<=')} then 'top'"
            f" when {crossed(c, 'lo', '<', '>=')} then 'bottom'"
            f" else 'none' end as {c}_divergence"
            for c in indicators
        ],
    )
    return out.drop(*[f"_{k}_{c}" for c in indicators for k in ("b", "p", "hi", "lo")])


def add_concentration(latest: DataFrame) -> DataFrame:
    """Volume spread and price place over the last 20 bars."""
    df = latest.selectExpr("*", f"{last_items('tail', CHIP_BARS)} as _t")
    df = df.selectExpr(
        "*",
        f"{field('_t', 'volume')} as _v",
        f"array_max({field('_t', 'high')}) as _top",
        f"array_min({field('_t', 'low')}) as _low",
    ).selectExpr("*", f"{mean('_v')} as _mean")
    squares = "transform(_v, x -> (x - _mean) * (x - _mean))"
    df = df.selectExpr(
        "*",
        f"try_divide(sqrt(try_divide({total(squares)}, size(_v) - 1D)), _mean) as volume_cv",
        "if(_top = _low, 0.5D, try_divide(close - _low, _top - _low)) as range_place",
    )
    return df.selectExpr("*", f"{CHIP_CLASS} as chip_concentration").drop("_t", "_v", "_top", "_low", "_mean")
