"""Indicators of newly landed bars from the state of the earlier ones, which are not read again.

Of all earlier bars a series keeps two things: its state, one row with the number of its bars, OBV and the exponential means at
the last one; and its last ``LEAD_IN`` bars, which is as far as any rolling column looks back. New bars are one more segment
behind them, led in by the kept bars and handed the state, as ``full_history`` hands it from segment to segment;
so the rows equal those that all bars would give. The work grows with the new bars and the number of series, not with the history.

New bars must be later than all earlier ones of their series; earlier ones raise an error. Series without new bars keep
their state, series without a state start at their first bar. As in ``full_history`` a row has indicators if its series has
20 bars or more, counted up to the last new bar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barframe.functions.rolling import BLOCK, decayed
from barframe.operators import indicators as ind
from barframe.operators.series import LEAD_IN, SALTS, SEGMENT_ROWS, segment_frame, tail_bars
from barframe.schema import BAR, SERIES

LEVELS = [k for k in ind.STATES if k.startswith("e")]


@dataclass(frozen=True)
class PanelState:
    """ends: (symbol, interval, last_ts, n, obv, up, down, e9, e12, e26), a row per series, means of the close as levels.
    tail: its last bars."""

    ends: DataFrame
    tail: DataFrame

    def write(self, path: str) -> None:
        self.ends.write.mode("errorifexists").parquet(f"{path}/ends")
        self.tail.write.mode("errorifexists").parquet(f"{path}/tail")

    @staticmethod
    def read(spark: SparkSession, path: str) -> PanelState:
        return PanelState(spark.read.parquet(f"{path}/ends"), spark.read.parquet(f"{path}/tail"))


def _last(rows: DataFrame) -> DataFrame:
    """Each series' state, from rows that bear it at their own bar."""
    values = ", ".join(f"'{c}', {c}" for c in ["ts", "pos", "obv", *ind.STATES])
    last = rows.groupBy(*SERIES).agg(F.expr(f"max_by(named_struct({values}), pos)").alias("e"))
    return last.selectExpr(*SERIES, "e.ts as last_ts", "cast(e.pos as bigint) as n", "e.obv as obv", *[f"e.{k} as {k}" for k in ind.STATES])


def state_of(bars: DataFrame, segment_rows: int = SEGMENT_ROWS, block: int = BLOCK, salts: int = SALTS) -> PanelState:
    """The state that a whole history leaves."""
    moved = ind._bar_moves(segment_frame(bars, segment_rows, 1, block, shared=True))
    states = ind._states(moved, block, ["close"])
    long_ones = ind._bar_moves(segment_frame(bars, segment_rows, 1, block, several_only=True, shared=True))
    carry = ind._carried(ind._states(long_ones, block, ["close"]), segment_rows)
    at_end = states.withColumn("_most", F.max("step").over(Window.partitionBy(*SERIES, "seg"))).where("step = _most")
    ends = _levels(at_end.join(carry, [*SERIES, "seg"], "left"))
    return PanelState(_last(ends), tail_bars(bars, LEAD_IN, salts).select(*BAR))


def _handed() -> dict[str, str]:
    """What the state before a segment adds to each of its means and to OBV."""
    handed = {"obv": "coalesce(c_obv, 0D)"}
    for k, a in ind.STATES.items():
        level = "state.anchor" if k in LEVELS else "0D"
        handed[k] = f"coalesce((c.{k} - {level}) * {decayed(a, 'cast(step as double)')}, 0D)"
    return handed


def _levels(rows: DataFrame) -> DataFrame:
    """OBV and means of rows with their segment's state and what was handed to it, as levels."""
    add = _handed()
    means = [f"state.{k} + {add[k]}{' + state.anchor' if k in LEVELS else ''} as {k}" for k in ind.STATES]
    return rows.selectExpr(*SERIES, "ts", "pos", f"obv + {add['obv']} as obv", *means)


def extend(state: PanelState, new_bars: DataFrame) -> tuple[DataFrame, PanelState]:
    """The indicator rows of the new bars, and the state that includes them."""
    ends = state.ends
    touched = new_bars.select(*BAR).join(ends.select(*SERIES, "last_ts", "n"), SERIES, "left")
    late = F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))
    stale = F.raise_error(F.concat(F.lit("a bar is not later than the state of "), "symbol")).cast("timestamp_ntz")
    touched = touched.withColumn("ts", F.when(late, F.col("ts")).otherwise(stale))
    wanted = new_bars.select(*SERIES).distinct()
    lead = state.tail.select(*BAR).join(wanted, SERIES, "left_semi").withColumn("_lead", F.lit(1))
    fresh = touched.withColumn("_lead", F.lit(0))
    rows = fresh.select(*BAR, "_lead").unionByName(lead.select(*BAR, "_lead")).join(ends.select(*SERIES, "n"), SERIES, "left")
    series = Window.partitionBy(*SERIES)
    by_time = series.orderBy("ts")
    framed = rows.withColumns({"seg": F.when(F.col("n").isNull(), 0).otherwise(1), "n": F.coalesce("n", F.lit(0).cast("long"))})
    framed = framed.withColumns(
        {
            "step": F.row_number().over(by_time) - F.sum("_lead").over(series),
            "n_bars": F.col("n") + F.count(F.when(F.col("_lead") == 0, 1)).over(series),
        }
    )
    framed = framed.withColumns({"pos": F.col("n") + F.col("step"), "blk": F.floor((F.col("step") - 1) / BLOCK).cast("int")})
    moved = ind._bar_moves(framed.drop("n", "_lead"))
    panel = ind._rolled(ind._states(moved, BLOCK, ind.REST), ["obv", "state"])
    means = ", ".join(f"'{k}', {k}" for k in ind.STATES)
    before = ends.selectExpr(*SERIES, "obv as c_obv", f"named_struct({means}) as c")
    panel = panel.join(before, SERIES, "left")
    out = ind._finish(panel, True, _handed()).filter("step > 0")
    return out, _merged(state, panel.filter("step > 0"), new_bars)


def _merged(state: PanelState, panel: DataFrame, new_bars: DataFrame) -> PanelState:
    ends = _last(_levels(panel))
    kept = state.ends.join(ends.select(*SERIES), SERIES, "left_anti")
    tail = tail_bars(state.tail.select(*BAR).unionByName(new_bars.select(*BAR)), LEAD_IN)
    return PanelState(ends.unionByName(kept.select(*ends.columns)), tail.select(*BAR))
