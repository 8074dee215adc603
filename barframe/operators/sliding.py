"""Extremes, means and deviations over the last n bars, for any n, at a cost per bar that does not grow with n.

The series is cut into blocks of n bars. A bar's last n bars are the bars of its own block so far and the last bars of the block before, so
two running states meet: one kept forwards since the block's first bar, and one kept backwards from the block's end, taken n - 1 bars ago. States
are (count, mean, sum of squared deviations, least, greatest); merging two adds and compares and never subtracts sums, so no
digits cancel.

Rows are a panel with a place ``pos`` in their series. Segments are at least four times as long as the longest window, each led in
by copies of that many rows: all windows run on one exchange, and a series of any length is dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from barframe.operators.running import BY_POS, PART, overlapped, without_copies
from barframe.operators.series import SEGMENT_ROWS

STATS = ("max", "min", "mean", "std", "count")


def _state(c: str, over: str) -> str:
    return (
        f"named_struct('n', cast(count({c}) over {over} as double), 'mean', avg({c}) over {over},"
        f" 'm2', coalesce(var_pop({c}) over {over} * count({c}) over {over}, 0D),"
        f" 'min', min({c}) over {over}, 'max', max({c}) over {over})"
    )


def _merged(stat: str, new: str, old: str) -> str:
    """A figure of two states; the old one may be null."""
    count, past = f"({new}.n + coalesce({old}.n, 0D))", f"coalesce({old}.n, 0D)"
    apart = f"({old}.mean - {new}.mean)"
    if stat in ("min", "max"):
        return f"{'least' if stat == 'min' else 'greatest'}({new}.{stat}, {old}.{stat})"
    if stat == "count":
        return f"cast({count} as bigint)"
    if stat == "mean":
        return f"case when {past} = 0D then {new}.mean when {new}.n = 0D then {old}.mean else {new}.mean + {apart} * {past} / {count} end"
    between = f"coalesce({apart} * {apart} * {new}.n * {past} / {count}, 0D)"
    # equal values deviate by nothing, whatever their means' last digits
    level = f"greatest({new}.max, {old}.max) = least({new}.min, {old}.min)"
    return f"case when {count} < 2D then null when {level} then 0D else sqrt(({new}.m2 + coalesce({old}.m2, 0D) + if({past} = 0D, 0D, {between})) / ({count} - 1D)) end"


def add_windows(
    panel: DataFrame,
    columns: list[str],
    windows: list[int],
    stats: tuple[str, ...] = ("max", "min"),
    min_periods: int = 1,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Columns ``<column>_<stat><n>`` over the last n bars of each, for all columns, windows and stats (``STATS``).

    NULLs are left out; with fewer than ``min_periods`` values a figure is NULL, a count aside. The deviation is that of a sample.
    """
    unknown = set(stats) - set(STATS)
    if unknown or min(windows) < 1:
        raise ValueError(f"no such stats or windows: {sorted(unknown)}, {windows}")
    # dealt by segment once: windows by block would ask for an exchange of their own
    rows = overlapped(panel, max(windows), max(segment_rows, 4 * max(windows))).repartition("symbol", "interval", "_part")
    out = []
    for n in dict.fromkeys(windows):
        block = f"{PART}, floor((pos - 1) / {n})"
        so_far = f"({block} order by pos rows between unbounded preceding and current row)"
        to_end = f"({block} order by pos desc rows between unbounded preceding and current row)"
        rows = rows.selectExpr("*", *[f"{_state(c, w)} as _{k}_{c}" for c in columns for k, w in (("new", so_far), ("end", to_end))])
        # a block's last bar needs its own block alone
        rows = rows.selectExpr(
            "*", *[f"if(pmod(pos, {n}) = 0, null, lag(_end_{c}, {n - 1}) over ({BY_POS})) as _old_{c}" for c in columns]
        )
        named = {f"{c}_{s}{n}": (_merged(s, f"_new_{c}", f"_old_{c}"), c, s) for c in columns for s in stats}
        enough = {c: f"{_merged('count', f'_new_{c}', f'_old_{c}')} >= {min_periods}" for c in columns}
        figures = [f"{sql if s == 'count' else f'if({enough[c]}, {sql}, null)'} as {name}" for name, (sql, c, s) in named.items()]
        gone = {f"_{k}_{c}" for k in ("new", "end", "old") for c in columns}
        rows = rows.selectExpr(*[x for x in rows.columns if x not in gone], *figures)
        out += named
    return without_copies(rows).select(*panel.columns, *out)
