"""The indicator columns, computed level by level over a framed series.

Every window here has the key (symbol, interval, seg), so one exchange serves all. A window
operator copies its whole input row, column by column; finished columns are therefore packed into
one struct per level, which is copied at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.rolling import (
    BLOCK,
    SO_FAR,
    STEP_BACK,
    WHOLE,
    BY_ROW,
    alpha_of_span,
    decayed,
    ewm_columns,
    last_rows,
    number,
    rows_lost_after,
)
from barframe.operators.series import (
    LEAD_IN,
    SALTS,
    SEGMENT_ROWS,
    segment_frame,
    split_frames,
    tail_frame,
)
from barframe.schema import BAR, PRICES, SERIES

MIN_BARS = 20

AVERAGES = ["ma5", "ma10", "ma20", "ma60", "ma120"]
VOLUMES = ["vol_ma5", "vol_ma10", "vol_ma20", "vol_ratio", "vol_ratio_high", "vol_ratio_low"]
DIRECTIONS = ["atr", "plus_di", "minus_di", "adx"]
STATEFUL = ["obv", "obv_ma20", "rsi", "macd", "macd_signal", "macd_hist"]
INDICATORS = [*AVERAGES, *VOLUMES, *DIRECTIONS, "bias", "cmf", "mfi", *STATEFUL]
# what the rules read from earlier bars
CONTEXT = ["prev_ma5", "prev_ma10", "prev_ma20", "prev_high20", "vol_ratio_min3"]
PLACE = ["pos", "n_bars", "step", "seg", "blk"]

RSI_ALPHA = 1.0 / 14.0
A9, A12, A26 = alpha_of_span(9), alpha_of_span(12), alpha_of_span(26)
STATES = {"up": RSI_ALPHA, "down": RSI_ALPHA, "e9": A9, "e12": A12, "e26": A26}


def _pack(name: str, columns: list[str]) -> str:
    return f"named_struct({', '.join(f'{c!r}, {c}' for c in columns)}) as {name}"


def _strength(gain: str, loss: str) -> str:
    """100 - 100 / (1 + gain / loss), clipped to 0..100, NULL where loss is 0."""
    value = f"100D - try_divide(100D, 1D + try_divide({gain}, {loss}))"
    return f"if({value} is null, null, least(greatest({value}, 0D), 100D))"


def _lagged(column: str, *offsets: int) -> list[str]:
    """Earlier values of a short windowed sum, 0 before the first bar."""
    return [f"coalesce(lag({column}, {n}) over {STEP_BACK}, 0D) as {column}_{n}" for n in offsets]


def _joined(column: str, *offsets: int) -> str:
    """A short windowed sum and its earlier values: the sum over a longer window."""
    return " + ".join([column, *[f"{column}_{n}" for n in offsets]])


MOVES = [
    "gain",
    "loss",
    "signed",
    "tr",
    "plus_dm",
    "minus_dm",
    "flow",
    "inflow",
    "outflow",
    "close_moved",
    "volume_moved",
]


def _bar_moves(df: DataFrame) -> DataFrame:
    """What one bar and the bar before it give."""
    before = [f"lag({c}) over {STEP_BACK} as prev_{c}" for c in PRICES]
    anchor = f"first(close) over {SO_FAR} as anchor"
    typical = "(high + low + close) / 3D"
    was = "(prev_high + prev_low + prev_close) / 3D"
    return df.selectExpr("*", *before, anchor).selectExpr(
        "*",
        "if(prev_close is null, null, greatest(close - prev_close, 0D)) as gain",
        "if(prev_close is null, null, greatest(prev_close - close, 0D)) as loss",
        "coalesce(signum(close - prev_close), 0D) * volume as signed",
        "greatest(abs(high - low), abs(high - prev_close), abs(low - prev_close)) as tr",
        "if(high - prev_high > prev_low - low and high - prev_high > 0D, high - prev_high, 0D)"
        " as plus_dm",
        "if(prev_low - low > high - prev_high and prev_low - low > 0D, prev_low - low, 0D)"
        " as minus_dm",
        "try_divide((close - low) - (high - close), high - low) * volume as flow",
        f"if({typical} > {was}, {typical} * volume, 0D) as inflow",
        f"if({typical} < {was}, abs({typical} * volume), 0D) as outflow",
        "if(close <> prev_close, pos, null) as close_moved",
        "if(volume <> prev_volume, pos, null) as volume_moved",
        "close - anchor as shift",
    )


def _states(df: DataFrame, block: int, keep: list[str]) -> DataFrame:
    """OBV and exponential means counted from the segment's start, packed into ``state``.

    The signal line is a mean of a difference of means of the close. A mean of a mean is a
    combination of two plain means, so with the 9-, 12- and 26-bar means of the close all of MACD
    follows. They are taken of the close less the segment's first close, which makes an
    unmoving price exactly 0.
    """
    packed = [c for c in keep if c not in ("gain", "loss", "shift", "signed")]
    df = df.selectExpr(
        *SERIES, "ts", *PLACE, "gain", "loss", "shift", "signed", "anchor", _pack("rest", packed)
    )
    first_delta = "seg = 0 and pos = 2"
    df = ewm_columns(
        df,
        {
            "up": ("gain", RSI_ALPHA, first_delta),
            "down": ("loss", RSI_ALPHA, first_delta),
            "e9": ("shift", A9, "false"),
            "e12": ("shift", A12, "false"),
            "e26": ("shift", A26, "false"),
        },
        block,
    )
    return df.selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        f"sum(signed) over {SO_FAR} - sum(if(step <= 0, signed, 0D)) over {WHOLE} as obv",
        _pack("state", ["anchor", *STATES]),
        "rest",
    )


def _rolled(df: DataFrame, extra: list[str]) -> DataFrame:
    """Rolling means and sums.

    A frame is recomputed for every row, so long frames are put together from short ones: 20 bars
    are four frames of 5, 60 are three of 20, 120 are two of 60. Only additions are used, so nothing cancels and a
    sum of zeros is exactly 0.
    """
    seven = ["tr", "plus_dm", "minus_dm", "inflow", "outflow"]
    with_obv = "obv" in extra
    df = df.selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        "rest",
        "rest.close as close",
        "rest.volume as volume",
        f"sum(rest.close) over {last_rows(5)} as c5",
        f"sum(rest.volume) over {last_rows(5)} as v5",
        f"coalesce(sum(rest.flow) over {last_rows(5)}, 0D) as f5",
        f"cast(count(rest.flow) over {last_rows(5)} as double) as nf5",
        *[f"sum(rest.{c}) over {last_rows(7)} as {c}7" for c in seven],
        *([f"sum(obv) over {last_rows(5)} as obv5"] if with_obv else []),
        f"max(rest.close_moved) over {SO_FAR} as close_moved",
        f"max(rest.volume_moved) over {SO_FAR} as volume_moved",
        f"max(rest.high) over ({BY_ROW} rows between 20 preceding and 1 preceding) as high20",
    )
    df = df.selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        "rest",
        "close",
        "volume",
        "high20",
        "pos - coalesce(close_moved, 1) + 1 as close_run",
        "pos - coalesce(volume_moved, 1) + 1 as volume_run",
        "c5",
        "v5",
        *_lagged("c5", 5, 10, 15),
        *_lagged("v5", 5, 10, 15),
        *_lagged("f5", 5, 10, 15),
        *_lagged("nf5", 5, 10, 15),
        *[x for c in seven for x in _lagged(f"{c}7", 7)],
        *[f"{c}7" for c in seven],
        "f5",
        "nf5",
        *([*_lagged("obv5", 5, 10, 15), "obv5"] if with_obv else []),
    ).selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        "rest",
        "close",
        "volume",
        "high20",
        "close_run",
        "volume_run",
        *[f"{x}5" for x in "cv"],
        *[f"{_joined(f'{x}5', 5)} as {x}10" for x in "cv"],
        *[f"{_joined(f'{x}5', 5, 10, 15)} as {x}20" for x in ("c", "v", "f", "nf")],
        *[f"{_joined(f'{c}7', 7)} as {c}14" for c in seven],
        *([f"{_joined('obv5', 5, 10, 15)} as obv20"] if with_obv else []),
    )

    def mean(total: str, n: int, c: str, value: str | None = None) -> str:
        seen = f"least(pos, {n})"
        # an unchanged value is its own mean, free of rounding
        flat = f"{c}_run >= {seen}"
        return f"if(pos < {max(2, n // 2)}, null, if({flat}, {value or c}, {total} / {seen}))"

    # a level's code beyond 8,000 bytes is run interpreted, so what no later window reads waits for the level after
    waits = ["close_run", "volume_run", "v5", "v10", "v20", "f20", "nf20", "tr14", "inflow14", "outflow14", "high20"]
    waits += ["obv20"] if with_obv else []
    df = df.selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        "rest",
        *waits,
        *[f"{mean(f'c{n}', n, 'close')} as ma{n}" for n in (5, 10, 20)],
        "c20",
        "close",
        "volume",
        f"{mean('v20', 20, 'volume')} as vol_ma20",
        "if(pos < 5, null, try_divide(100D * plus_dm14, tr14)) as plus_di",
        "if(pos < 5, null, try_divide(100D * minus_dm14, tr14)) as minus_di",
    )
    done = ["ma5", "ma10", "ma20", "vol_ma5", "vol_ma10", "vol_ma20", "atr", "plus_di", "minus_di", "cmf", "mfi"]
    done += ["bias", "prev_high20"] + (["obv_ma20"] if with_obv else [])
    df = df.selectExpr(
        "*",
        "try_divide(volume, vol_ma20) as vol_ratio",
        "try_divide(abs(plus_di - minus_di), plus_di + minus_di) * 100D as dx",
    ).selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        "rest",
        # of columns alone, so that a query that needs a few gets the struct taken apart
        _pack("waits", waits),
        "ma5",
        "ma10",
        "ma20",
        "vol_ma20",
        "plus_di",
        "minus_di",
        "c20",
        "vol_ratio",
        "dx",
        # the ratio moves around 1, so squares are taken from there
        "vol_ratio - 1D as off",
        "(vol_ratio - 1D) * (vol_ratio - 1D) as off2",
    )
    df = df.selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        "rest",
        "waits",
        "ma5",
        "ma10",
        "ma20",
        "vol_ma20",
        "plus_di",
        "minus_di",
        "vol_ratio",
        "c20",
        *_lagged("c20", 20, 40),
        f"coalesce(sum(off) over {last_rows(5)}, 0D) as r5",
        f"coalesce(sum(off2) over {last_rows(5)}, 0D) as q5",
        f"cast(count(off) over {last_rows(5)} as double) as n5",
        f"coalesce(sum(dx) over {last_rows(7)}, 0D) as d7",
        f"cast(count(dx) over {last_rows(7)} as double) as nd7",
        f"if(count(vol_ratio) over {last_rows(3)} = 3,"
        f" min(vol_ratio) over {last_rows(3)}, null) as vol_ratio_min3",
        *[f"lag(ma{n}) over {STEP_BACK} as prev_ma{n}" for n in (5, 10, 20)],
    ).selectExpr(
        "* except (waits)",
        "waits.close_run as close_run",
        *[f"{mean(f'waits.v{n}', n, 'waits.volume', 'rest.volume')} as vol_ma{n}" for n in (5, 10)],
        "if(pos < 5, null, waits.tr14 / least(pos, 14)) as atr",
        "if(pos < 5 or waits.nf20 < 5D, null, try_divide(waits.f20, waits.v20)) as cmf",
        f"if(pos < 5, null, {_strength('waits.inflow14', 'waits.outflow14')}) as mfi",
        "try_divide(rest.close - ma20, ma20) * 100D as bias",
        "if(pos > 20, waits.high20, null) as prev_high20",
        *(["if(pos < 5, null, waits.obv20 / least(pos, 20)) as obv_ma20"] if with_obv else []),
    )
    df = df.selectExpr(f"* except ({', '.join(done)})", _pack("done", done))
    df = df.withColumn("c60", F.expr(_joined("c20", 20, 40))).selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        "rest",
        "done",
        "vol_ratio",
        "vol_ratio_min3",
        "prev_ma5",
        "prev_ma10",
        "prev_ma20",
        "close_run",
        "c60",
        *_lagged("c60", 60),
        *[x for c in "rqn" for x in (f"{c}5", *_lagged(f"{c}5", 5, 10, 15))],
        *[x for c in ("d7", "nd7") for x in (c, *_lagged(c, 7))],
    )
    df = df.selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        "rest",
        _pack("done", ["done", "prev_ma5", "prev_ma10", "prev_ma20", "vol_ratio_min3"]),
        "vol_ratio",
        "close_run",
        "c60",
        f"{_joined('c60', 60)} as c120",
        *[f"{_joined(f'{c}5', 5, 10, 15)} as {c}20" for c in "rqn"],
        f"{_joined('d7', 7)} as d14",
        f"{_joined('nd7', 7)} as nd14",
    ).selectExpr(
        "* except (close_run, c60, c120, d14, nd14)",
        f"{mean('c60', 60, 'close', 'rest.close')} as ma60",
        f"{mean('c120', 120, 'close', 'rest.close')} as ma120",
        "if(nd14 < 5D, null, d14 / nd14) as adx",
    )
    df = df.selectExpr("*", *[x for c in "rqn" for x in _lagged(f"{c}20", 20, 40)])
    df = df.selectExpr("*", *[f"{_joined(f'{c}20', 20, 40)} as {c}60" for c in "rqn"])
    df = df.selectExpr(
        "*",
        "if(n60 < 20D, null, r60 / n60) as centre",
        "if(n60 < 20D, null, sqrt(greatest((q60 - r60 * r60 / n60) / (n60 - 1D), 0D))) as spread",
    )
    return df.selectExpr(
        *SERIES,
        "ts",
        *PLACE,
        *extra,
        *[f"rest.{c} as {c}" for c in [*PRICES, "prev_close", "prev_open"]],
        *[f"done.done.{c} as {c}" for c in done],
        "ma60",
        "ma120",
        "vol_ratio",
        "coalesce(1D + centre + spread, 1.5D) as vol_ratio_high",
        "greatest(coalesce(1D + centre - spread, 0.8D), 0.3D) as vol_ratio_low",
        "adx",
        *[f"done.{c} as {c}" for c in ("vol_ratio_min3", "prev_ma5", "prev_ma10", "prev_ma20")],
    )


def _signal_line() -> str:
    """Mean over 9 bars of the 12-bar mean less the 26-bar mean, from three plain means."""

    def mean_of_mean(a: float, e: str) -> str:
        d, d9 = 1 - a, 1 - A9
        return f"{number(A9 * d / (d - d9))} * {e} - {number(a * d9 / (d - d9))} * e9"

    return f"({mean_of_mean(A12, 'e12')}) - ({mean_of_mean(A26, 'e26')})"


def _finish(df: DataFrame, stateful: bool, handed: dict[str, str] | None = None, carried: list[str] | None = None) -> DataFrame:
    """Output columns; ``handed`` gives what earlier segments add to each state, ``carried`` names columns that stay."""
    names = [c for c in INDICATORS if stateful or c not in STATEFUL]
    if stateful:
        add = handed or {}
        df = df.selectExpr(
            *[c for c in df.columns if c not in ("state", "obv", "obv_ma20")],
            *[f"{c} + {add['obv']} as {c}" if add else c for c in ("obv", "obv_ma20")],
            *[f"state.{k} + {add[k]} as {k}" if add else f"state.{k} as {k}" for k in STATES],
        )
        df = df.selectExpr(
            "*",
            f"if(pos <= 14, null, {_strength('up', 'down')}) as rsi",
            "e12 - e26 as macd",
            f"{_signal_line()} as macd_signal",
            f"e12 - e26 - ({_signal_line()}) as macd_hist",
        )
    enough = f"n_bars >= {MIN_BARS}"
    return df.selectExpr(
        *BAR,
        *PLACE,
        "prev_close",
        "prev_open",
        *[f"if({enough}, {c}, null) as {c}" for c in [*names, *CONTEXT]],
        *(carried or []),
    )


REST = [*PRICES, "prev_close", "prev_open", *MOVES]


def add_indicators(frame: DataFrame) -> DataFrame:
    """Indicators of a frame whose series are one segment each (``tail_frame``)."""
    return _finish(_rolled(_states(_bar_moves(frame), BLOCK, REST), ["obv", "state"]), True)


def latest_history(bars: DataFrame, keep: int | dict[str, int], salts: int = SALTS) -> DataFrame:
    """Indicators over the last ``keep`` bars of each series.

    The exponential means and OBV start at the first kept bar, so the cut comes first.
    """
    return add_indicators(tail_frame(bars, keep, salts))


def _carried(df: DataFrame, segment_rows: int) -> DataFrame:
    """State handed to each segment by all earlier ones: one short row per segment."""
    ends = df.selectExpr(
        "*", f"row_number() over {STEP_BACK} = count(1) over {WHOLE} as last_row"
    ).filter("last_row")
    lookback = max(rows_lost_after(a, max(1, segment_rows // 2)) for a in STATES.values())
    by_seg = "partition by symbol, interval order by seg"
    ends = ends.selectExpr(
        *SERIES,
        "seg",
        "cast(step as double) as rows",
        f"sum(obv) over ({by_seg} rows between unbounded preceding and 1 preceding) as c_obv",
        f"collect_list(named_struct('rows', cast(step as double), 'anchor', state.anchor,"
        f" {', '.join(f'{k!r}, coalesce(state.{k}, 0D)' for k in STATES)}))"
        f" over ({by_seg} rows between {lookback} preceding and 1 preceding) as past",
    )
    # the close means are kept as levels: anchor + mean of the close less the anchor
    level = {k: "end.anchor" if k.startswith("e") else "0D" for k in STATES}
    step = ", ".join(
        f"{k!r}, {level[k]} + end.{k}"
        f" + coalesce(acc.{k} - {level[k]}, 0D) * {decayed(a, 'end.rows')}"
        for k, a in STATES.items()
    )
    start = ", ".join(f"{k!r}, cast(null as double)" for k in STATES)
    return ends.filter("seg > 0").selectExpr(
        *SERIES,
        "seg",
        "c_obv",
        f"aggregate(past, named_struct({start}), (acc, end) -> named_struct({step})) as c",
    )


def full_history(
    bars: DataFrame,
    stateful: bool = True,
    segment_rows: int = SEGMENT_ROWS,
    lead_in: int = LEAD_IN,
    block: int = BLOCK,
    known: list[str] | None = None,
    split: bool = False,
) -> DataFrame:
    """Indicators over every bar of every series, however long.

    ``stateful=False`` leaves out OBV, RSI and MACD, which saves the pass that hands state from
    segment to segment. ``known`` names indicators whose last value up to each bar, from however far back, comes along
    as ``known_<name>``; only series of several segments are read twice for it. So does ``whole``: whether the bar's series is one segment.
    With ``known`` or ``split`` a series that is one segment is dealt out whole, by one exchange in place of two; long series are a plan of their own.
    """
    if not stateful:
        if known:
            raise ValueError("last known values are handed on with the state")
        moves = _bar_moves(segment_frame(bars, segment_rows, lead_in, block))
        packed = moves.selectExpr(*SERIES, "ts", *PLACE, _pack("rest", REST))
        return _finish(_rolled(packed, []), False).filter("step > 0")
    if known or split:
        single, long_ones = (_bar_moves(frame) for frame in split_frames(bars, segment_rows, lead_in, block))
    else:
        long_ones = _bar_moves(segment_frame(bars, segment_rows, lead_in, block, several_only=True, shared=True))
    carry = _carried(_states(long_ones, block, ["close"]), segment_rows)
    handed = {"obv": "coalesce(c_obv, 0D)"}
    for k, a in STATES.items():
        level = "state.anchor" if k.startswith("e") else "0D"
        handed[k] = f"coalesce((c.{k} - {level}) * {decayed(a, 'cast(step as double)')}, 0D)"

    # what needs no state is looked for before it is handed on: a level of its own keeps the code of both short
    early = [c for c in known or [] if c not in STATEFUL]

    def finished(moves: DataFrame, of_several: bool = True) -> DataFrame:
        panel = _rolled(_states(moves, block, REST), ["obv", "state"])
        if early:
            own = f"step > 0 and n_bars >= {MIN_BARS}"
            panel = panel.selectExpr("*", *[f"last(if({own}, {c}, null), true) over {SO_FAR} as known_{c}" for c in early])
        if of_several:
            panel = panel.join(carry, [*SERIES, "seg"], "left")
        return _finish(panel, True, handed if of_several else None, [f"known_{c}" for c in early]).filter("step > 0")

    if not known and not split:
        return finished(_bar_moves(segment_frame(bars, segment_rows, lead_in, block, shared=True)))
    # nothing is handed on to series of one segment
    single, several = finished(single, of_several=False), finished(long_ones)
    if not known:
        return single.union(several)

    def with_known(panel: DataFrame) -> DataFrame:
        return panel.selectExpr("*", *[f"last({c}, true) over {SO_FAR} as known_{c}" for c in known if c not in early])

    before = _known_before(several, known)
    several = with_known(several).join(before, [*SERIES, "seg"], "left")
    several = several.withColumns({f"known_{c}": F.coalesce(f"known_{c}", f"_before_{c}") for c in known})
    single = with_known(single)
    # a literal tells them apart, so that a filter by it leaves out the others' plan
    return single.withColumn("whole", F.lit(True)).union(several.select(single.columns).withColumn("whole", F.lit(False)))


def _known_before(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What was last known of the columns before each segment: one row per segment."""
    ends = rows.groupBy(*SERIES, "seg").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in columns])
    by_seg = "(partition by symbol, interval order by seg rows between unbounded preceding and 1 preceding)"
    return ends.selectExpr(*SERIES, "seg", *[f"last({c}, true) over {by_seg} as _before_{c}" for c in columns])
