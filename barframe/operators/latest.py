"""One row per series: its last bar, the last known indicator values and the last 80 bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions.rolling import SO_FAR
from barframe.operators.indicators import CONTEXT, INDICATORS
from barframe.schema import PRICES, SERIES

LOOKBACK = 80
# indicators that may be NULL on the last bar though an earlier bar has a value
GAPPED = ["vol_ratio", "rsi", "bias", "adx", "plus_di", "minus_di", "cmf", "mfi"]
TAIL = ["high", "low", "close", "volume", "macd", "rsi", "obv"]


def latest_rows(history: DataFrame) -> DataFrame:
    """Collapse ``indicators.latest_history`` to its last bars.

    The group is the last 80 bars of a series, never more, and lies on one task already, so this
    adds no exchange. Columns: the last bar's, ``known_*`` for the gapped indicators, and ``tail``,
    an array of the last bars, oldest first.
    """
    columns = ["ts", "pos", "n_bars", *PRICES, "prev_close", "prev_open", *INDICATORS, *CONTEXT]
    known = [f"known_{c}" for c in GAPPED]
    rows = history.selectExpr(
        *SERIES,
        *columns,
        *[f"last(if(n_bars < 20, null, {c}), true) over {SO_FAR} as known_{c}" for c in GAPPED],
    ).filter(f"pos > n_bars - {LOOKBACK}")
    last = ", ".join(f"{c!r}, {c}" for c in [*columns, *known])
    tail = ", ".join(f"{c!r}, {c}" for c in ["pos", *TAIL])
    grouped = rows.groupBy(*SERIES).agg(
        F.expr(f"max_by(named_struct({last}), pos)").alias("last"),
        F.expr(f"sort_array(collect_list(named_struct({tail})))").alias("tail"),
    )
    return grouped.select(*SERIES, "last.*", "tail")


