"""DuckDB SQL giving the same rows as the queries of ``__spark_entry__``.

Written apart from the Spark side: plain frames for rolling means, a recursion for exponential
means, window pivots in place of arrays.
"""

from __future__ import annotations

R = "round({0}, 4) AS {0}"  # replaced by half-up steps at the end
BAR_OUT = (
    "symbol, interval, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(open, 4) AS open,"
    " round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close,"
    " round(volume, 4) AS volume"
)
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"

OHLC = (
    "arg_min(price, k) AS open, max(price) AS high, min(price) AS low,"
    " arg_max(price, k) AS close, CAST(sum(qty) AS DOUBLE) AS volume"
)
F1 = f"""f1 AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, '1d' AS interval,
         CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, {OHLC}
  FROM (SELECT *, l_extendedprice / l_quantity AS price, l_quantity AS qty,
               row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k
        FROM lineitem) GROUP BY 1, 2, 3)"""
F2 = f"""f2 AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS symbol, '1d' AS interval,
         CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, {OHLC}
  FROM (SELECT c_nationkey, o_orderdate, o_totalprice AS price, 1.0 AS qty, o_orderkey AS k
        FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2, 3)"""


def _events(name: str, interval: str, grid: str) -> str:
    return f"""{name} AS (
  SELECT event_type AS symbol, '{interval}' AS interval,
         CAST(date_trunc('{grid}', ts) AS TIMESTAMP) AS ts, {OHLC}
  FROM (SELECT event_type, ts, value AS price, 1.0 AS qty, row(ts, event_id) AS k FROM events)
  GROUP BY 1, 2, 3)"""


F3 = _events("f3", "60m", "hour")
F3D = _events("f3d", "1d", "day")
MIXED = [F1, F3, F3D, "mixed AS (FROM f1 UNION ALL FROM f3d UNION ALL FROM f3)"]

WEEK = "CAST(ts AS DATE) + CAST((12 - dayofweek(ts)) % 7 AS INTEGER)"


def weekly(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT symbol, '1wk' AS interval, CAST({WEEK} AS TIMESTAMP) AS ts, arg_min(open, ts) AS open,
         max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
  FROM {source} GROUP BY symbol, {WEEK})"""


def query(ctes: list[str], final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


# --- indicators ---------------------------------------------------------------


def tail(source: str, keep: str | None) -> str:
    cut = f"WHERE back <= {keep}" if keep else ""
    return f"""kept AS MATERIALIZED (
  SELECT * EXCLUDE (back), row_number() OVER (PARTITION BY symbol, interval ORDER BY ts) AS pos,
         count(*) OVER (PARTITION BY symbol, interval) AS n_bars
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, interval ORDER BY ts DESC) AS back
        FROM {source}) {cut})"""


O = "PARTITION BY symbol, interval ORDER BY ts"


def fr(n: int) -> str:
    return f"({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, c: str, n: int, k: int) -> str:
    return f"CASE WHEN count({c}) OVER {fr(n)} >= {k} THEN {agg}({c}) OVER {fr(n)} END"


RECURSION = """ew AS MATERIALIZED (
  SELECT symbol, interval, pos, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS sig,
         CAST(NULL AS DOUBLE) AS up, CAST(NULL AS DOUBLE) AS down
  FROM moves WHERE pos = 1
  UNION ALL
  SELECT m.symbol, m.interval, m.pos, e.e12 * 11 / 13 + m.close * 2 / 13,
         e.e26 * 25 / 27 + m.close * 2 / 27,
         e.sig * 0.8 + 0.2 * ((e.e12 * 11 / 13 + m.close * 2 / 13)
                              - (e.e26 * 25 / 27 + m.close * 2 / 27)),
         CASE WHEN m.pos = 2 THEN m.gain ELSE e.up * 13 / 14 + m.gain / 14 END,
         CASE WHEN m.pos = 2 THEN m.loss ELSE e.down * 13 / 14 + m.loss / 14 END
  FROM ew e JOIN moves m ON m.symbol = e.symbol AND m.interval = e.interval AND m.pos = e.pos + 1)"""

MOVES = f"""lagged AS (
  SELECT *, lag(close) OVER ({O}) AS pc, lag(high) OVER ({O}) AS ph, lag(low) OVER ({O}) AS pl,
         lag(open) OVER ({O}) AS po FROM kept),
moves AS MATERIALIZED (
  SELECT *, greatest(close - pc, 0) + 0 * pc AS gain, greatest(pc - close, 0) + 0 * pc AS loss,
    coalesce(sign(close - pc), 0) * volume AS signed,
    CASE WHEN pc IS NULL THEN abs(high - low)
         ELSE greatest(abs(high - low), abs(high - pc), abs(low - pc)) END AS tr,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm,
    CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
    ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS flow,
    CASE WHEN (high + low + close) / 3 > (ph + pl + pc) / 3
         THEN (high + low + close) / 3 * volume ELSE 0 END AS inflow,
    CASE WHEN (high + low + close) / 3 < (ph + pl + pc) / 3
         THEN (high + low + close) / 3 * volume ELSE 0 END AS outflow
  FROM lagged)"""

ROLLED = f"""rolled AS (
  SELECT *, {", ".join(f"{roll('avg', 'close', n, max(2, n // 2))} AS ma{n}" for n in (5, 10, 20, 60, 120))},
    {", ".join(f"{roll('avg', 'volume', n, max(2, n // 2))} AS vol_ma{n}" for n in (5, 10, 20))},
    sum(signed) OVER ({O}) AS obv,
    {roll("avg", "tr", 14, 5)} AS atr, nullif({roll("sum", "tr", 14, 5)}, 0) AS tr14,
    {roll("sum", "pdm", 14, 5)} AS p14, {roll("sum", "mdm", 14, 5)} AS m14,
    {roll("sum", "flow", 20, 5)} AS f20, nullif({roll("sum", "volume", 20, 5)}, 0) AS v20,
    {roll("sum", "inflow", 14, 5)} AS i14, nullif({roll("sum", "outflow", 14, 5)}, 0) AS o14,
    CASE WHEN pos > 20 THEN max(high) OVER ({O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS high20
  FROM moves),
ratios AS (
  SELECT *, volume / nullif(vol_ma20, 0) AS vol_ratio, 100 * p14 / tr14 AS plus_di,
    100 * m14 / tr14 AS minus_di, f20 / v20 AS cmf,
    least(greatest(100 - 100 / (1 + i14 / o14), 0), 100) + 0 * (i14 / o14) AS mfi,
    (close - ma20) / nullif(ma20, 0) * 100 AS bias FROM rolled),
directed AS (
  SELECT *, abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) * 100 AS dx FROM ratios),
joined AS (
  SELECT d.*, {roll("avg", "vol_ratio", 60, 20)} + {roll("stddev_samp", "vol_ratio", 60, 20)} AS vh,
    {roll("avg", "vol_ratio", 60, 20)} - {roll("stddev_samp", "vol_ratio", 60, 20)} AS vl,
    {roll("avg", "dx", 14, 5)} AS adx_, {roll("avg", "obv", 20, 5)} AS obv20,
    {roll("min", "vol_ratio", 3, 3)} AS vr3, {", ".join(f"lag(ma{n}) OVER ({O}) AS pma{n}" for n in (5, 10, 20))}
  FROM directed d)"""

_PANEL_COLUMNS = {
    **{f"ma{n}": f"ma{n}" for n in (5, 10, 20, 60, 120)},
    **{f"vol_ma{n}": f"vol_ma{n}" for n in (5, 10, 20)},
    "vol_ratio": "vol_ratio",
    "vol_ratio_high": "coalesce(vh, 1.5)",
    "vol_ratio_low": "greatest(coalesce(vl, 0.8), 0.3)",
    "obv": "obv",
    "obv_ma20": "obv20",
    "bias": "bias",
    "atr": "atr",
    "plus_di": "plus_di",
    "minus_di": "minus_di",
    "adx": "adx_",
    "cmf": "cmf",
    "mfi": "mfi",
    "prev_high20": "high20",
    "vr3": "vr3",
    **{f"pma{n}": f"pma{n}" for n in (5, 10, 20)},
}
_STATE_COLUMNS = {
    "rsi": "CASE WHEN j.pos > 14 THEN least(greatest(100 - 100 / (1 + up / nullif(down, 0)), 0), 100)"
    " + 0 * (up / nullif(down, 0)) END",
    "macd": "e12 - e26",
    "macd_signal": "sig",
    "macd_hist": "e12 - e26 - sig",
}


def panel(bars: list[str], source: str, keep: str | None = None, stateful: bool = True) -> list[str]:
    enough = "CASE WHEN n_bars >= 20 THEN {} END AS {}"
    cols = dict(_PANEL_COLUMNS) | (_STATE_COLUMNS if stateful else {})
    picked = ", ".join(enough.format(v, k) for k, v in cols.items())
    join = (
        "JOIN ew ON ew.symbol = j.symbol AND ew.interval = j.interval AND ew.pos = j.pos"
        if stateful
        else ""
    )
    final = f"""panel AS MATERIALIZED (
  SELECT j.symbol, j.interval, j.ts, j.pos, n_bars, open, high, low, close, volume,
         pc AS prev_close, po AS prev_open, {picked} FROM joined j {join})"""
    return [*bars, tail(source, keep), MOVES, *([RECURSION] if stateful else []), ROLLED, final]


def full(*columns: str, stateful: bool = False, bars=(F1, "f1")) -> str:
    out = ", ".join(R.format(c) for c in columns)
    return query(panel([bars[0]], bars[1], None, stateful), f"SELECT symbol, {TS}, {out} FROM panel")


SCORE = """CAST(CASE WHEN n_bars < 10 THEN 0
  WHEN n_bars < 20 THEN 15 + CASE WHEN close > prev_close THEN 10 ELSE 0 END
  ELSE least(100, CASE WHEN close > ma20 THEN 20 ELSE 0 END + CASE WHEN ma20 > ma60 THEN 15 ELSE 0 END
     + CASE WHEN ma5 > ma10 AND ma10 > ma20 THEN 15 ELSE 0 END
     + CASE WHEN vol_ratio > 1.2 THEN 10 WHEN vol_ratio < 0.8 THEN 4 ELSE 0 END
     + CASE WHEN macd > macd_signal THEN 15 ELSE 0 END
     + CASE WHEN rsi BETWEEN 45 AND 70 THEN 15 WHEN rsi < 35 THEN 8 ELSE 0 END
     + CASE WHEN cmf > 0 THEN 10 ELSE 0 END + CASE WHEN close > prev_close THEN 10 ELSE 0 END
     + CASE WHEN adx >= 25 THEN 5 ELSE 0 END) END AS BIGINT)"""


def fired(*rules: tuple[str, str]) -> str:
    """Text of the labels of all rules that hold."""
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for r, n in rules) + ")"


CHANGE = "((close - prev_close) / prev_close * 100)"
VP = fired(
    (f"{CHANGE} > 0 AND vol_ratio > 1.2", "vol_up"),
    (f"{CHANGE} < 0 AND vol_ratio > 1.2", "vol_down"),
    ("vr3 > 1.2", "vol_up_3"),
    (f"{CHANGE} > 0 AND vol_ratio < 0.8", "up_on_low_vol"),
    (f"{CHANGE} < 0 AND vol_ratio > 1.2", "down_on_high_vol"),
)
VP_FIGURES = f"printf('%.2f%%, ratio %.2f)', {CHANGE}, vol_ratio)"
VP_WORDS = ", ".join(
    f"CASE WHEN {rule} THEN {text} END"
    for rule, text in (
        (f"{CHANGE} > 0 AND vol_ratio > 1.2", f"'up on volume (change ' || {VP_FIGURES}"),
        (f"{CHANGE} < 0 AND vol_ratio > 1.2", f"'down on volume (change ' || {VP_FIGURES}"),
        ("vr3 > 1.2", "'volume up for three bars, strong momentum'"),
        (f"{CHANGE} > 0 AND vol_ratio < 0.8", "'up on thin volume, weak advance'"),
        (f"{CHANGE} < 0 AND vol_ratio > 1.2", "'down on heavy volume, selling pressure'"),
    )
)
VOLUME_MEANS = " || ', ' || ".join(
    f"'MA{n}=' || coalesce(printf('%.0f', vol_ma{n}), 'nan')" for n in (5, 10, 20)
)
CANDLES = fired(
    (
        "abs(close - open) > 0 AND least(open, close) - low > 2 * abs(close - open)"
        " AND high - greatest(open, close) < abs(close - open)",
        "hammer",
    ),
    (
        "close > open AND prev_close < prev_open AND close > prev_open AND open < prev_close",
        "bull_engulf",
    ),
    (
        "close < open AND prev_close > prev_open AND open > prev_close AND close < prev_open",
        "bear_engulf",
    ),
)
TRIGGERS = fired(
    ("close > prev_high20", "breakout20"),
    ("close > ma20 AND vol_ratio < 0.8", "pullback_ma20"),
    ("vol_ratio > 1.5 AND close > prev_close", "ignition"),
    (
        "ma5 > ma10 AND ma10 > ma20 AND NOT coalesce(pma5 > pma10 AND pma10 > pma20, false)",
        "ma_alignment",
    ),
)
STRUCTURED = f"""
SELECT symbol, {TS}, CAST(row_number() OVER (PARTITION BY symbol, interval, panel.ts ORDER BY ord) - 1 AS BIGINT) AS place,
       type, name, round(strength, 4) AS strength
FROM panel, LATERAL (
  SELECT 1 AS ord, t.type, t.name, t.strength FROM (SELECT
     CASE WHEN {CHANGE} > 0 AND vol_ratio > 1.2 THEN 'bullish' WHEN {CHANGE} < 0 AND vol_ratio > 1.2 THEN 'bearish'
          WHEN {CHANGE} > 0 AND vol_ratio < 0.8 THEN 'neutral' WHEN {CHANGE} < 0 AND vol_ratio < 0.8 THEN 'bullish' END AS type,
     CASE WHEN {CHANGE} > 0 AND vol_ratio > 1.2 THEN 'vol_up' WHEN {CHANGE} < 0 AND vol_ratio > 1.2 THEN 'vol_down'
          WHEN {CHANGE} > 0 AND vol_ratio < 0.8 THEN 'up_low_vol' WHEN {CHANGE} < 0 AND vol_ratio < 0.8 THEN 'down_low_vol' END AS name,
     CASE WHEN vol_ratio > 1.2 THEN least(1.0, vol_ratio / 2) WHEN {CHANGE} > 0 THEN 0.4 ELSE 0.6 END AS strength) t
  WHERE t.type IS NOT NULL
  UNION ALL SELECT 2, CASE WHEN close > ma20 THEN 'bullish' ELSE 'bearish' END,
                   CASE WHEN close > ma20 THEN 'above_ma20' ELSE 'below_ma20' END, 0.7
  UNION ALL SELECT 3, CASE WHEN macd > macd_signal THEN 'bullish' ELSE 'bearish' END,
                   CASE WHEN macd > macd_signal THEN 'macd_golden' ELSE 'macd_dead' END, 0.8
            WHERE macd <> macd_signal)
WHERE pos >= 3 AND n_bars >= 20"""

# --- latest bar -----------------------------------------------------------------

KEEP = "CASE interval WHEN '1d' THEN 272 WHEN '1wk' THEN 60 ELSE 320 END"
S = "PARTITION BY symbol, interval"


def _level(c: str, pick: str, name: str) -> str:
    return f"""{name} AS (
  SELECT symbol, interval, coalesce((coalesce(max({c}) FILTER (is_pivot AND nth = 3), 0)
           + coalesce(max({c}) FILTER (is_pivot AND nth = 2), 0) + max({c}) FILTER (is_pivot AND nth = 1))
           / least(count(*) FILTER (is_pivot), 3), {pick}({c}) FILTER (back < 20)) AS {name}
  FROM (SELECT *, row_number() OVER ({S}, is_pivot ORDER BY ts DESC) AS nth
        FROM (SELECT *, n_bars - pos AS back,
                     {c} = {pick}({c}) OVER ({O} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
                     AND pos - greatest(n_bars - 80, 0) > 5 AND n_bars - pos >= 5 AS is_pivot
              FROM panel WHERE pos > n_bars - 80))
  GROUP BY symbol, interval)"""


def _divergence(ind: str) -> str:
    return f"""div_{ind} AS (
  SELECT symbol, interval, CASE
      WHEN max(m) < 10 THEN 'none'
      WHEN max(close) FILTER (hi AND nh = 1) > max(close) FILTER (hi AND nh = 2)
       AND max({ind}) FILTER (hi AND nh = 1) <= max({ind}) FILTER (hi AND nh = 2) THEN 'top'
      WHEN max(close) FILTER (lo AND nl = 1) < max(close) FILTER (lo AND nl = 2)
       AND max({ind}) FILTER (lo AND nl = 1) >= max({ind}) FILTER (lo AND nl = 2) THEN 'bottom'
      ELSE 'none' END AS {ind}_divergence
  FROM (SELECT *, row_number() OVER ({S}, hi ORDER BY ts DESC) AS nh,
               row_number() OVER ({S}, lo ORDER BY ts DESC) AS nl
        FROM (SELECT symbol, interval, ts, close, {ind}, count(*) OVER ({S}) AS m,
                count(*) OVER w = 5 AND close = max(close) OVER w AS hi,
                count(*) OVER w = 5 AND close = min(close) OVER w AS lo
              FROM panel WHERE pos > n_bars - 30 AND {ind} IS NOT NULL
              WINDOW w AS ({O} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)))
  GROUP BY symbol, interval)"""


def _up_to(bars: int) -> str:
    """For each bar (cut) the bars of its window."""
    return f"(SELECT p.*, t.pos AS cut FROM panel p JOIN panel t ON p.symbol = t.symbol AND p.pos BETWEEN t.pos - {bars - 1} AND t.pos)"


def _divergence_at(ind: str) -> str:
    c = "PARTITION BY symbol, cut"
    return f"""div_{ind} AS (
  SELECT symbol, cut, CASE
      WHEN max(m) < 10 THEN 'none'
      WHEN max(close) FILTER (hi AND nh = 1) > max(close) FILTER (hi AND nh = 2)
       AND max({ind}) FILTER (hi AND nh = 1) <= max({ind}) FILTER (hi AND nh = 2) THEN 'top'
      WHEN max(close) FILTER (lo AND nl = 1) < max(close) FILTER (lo AND nl = 2)
       AND max({ind}) FILTER (lo AND nl = 1) >= max({ind}) FILTER (lo AND nl = 2) THEN 'bottom'
      ELSE 'none' END AS {ind}_divergence
  FROM (SELECT *, row_number() OVER ({c}, hi ORDER BY pos DESC) AS nh, row_number() OVER ({c}, lo ORDER BY pos DESC) AS nl
        FROM (SELECT symbol, cut, pos, close, {ind}, count(*) OVER ({c}) AS m,
                count(*) OVER w = 5 AND close = max(close) OVER w AS hi,
                count(*) OVER w = 5 AND close = min(close) OVER w AS lo
              FROM {_up_to(30)} WHERE {ind} IS NOT NULL
              WINDOW w AS ({c} ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)))
  GROUP BY symbol, cut)"""


LEVELS_AT = f"""levels AS (
  SELECT symbol, cut AS pos,
    coalesce((coalesce(max(low) FILTER (lo AND nl = 3), 0) + coalesce(max(low) FILTER (lo AND nl = 2), 0) + coalesce(max(low) FILTER (lo AND nl = 1), 0)) / nullif(count(*) FILTER (lo AND nl <= 3), 0), min(low) FILTER (pos > cut - 20)) AS support,
    coalesce((coalesce(max(high) FILTER (hi AND nh = 3), 0) + coalesce(max(high) FILTER (hi AND nh = 2), 0) + coalesce(max(high) FILTER (hi AND nh = 1), 0)) / nullif(count(*) FILTER (hi AND nh <= 3), 0), max(high) FILTER (pos > cut - 20)) AS resistance
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, cut, hi ORDER BY pos DESC) AS nh,
               row_number() OVER (PARTITION BY symbol, cut, lo ORDER BY pos DESC) AS nl
        FROM (SELECT symbol, cut, pos, low, high, count(*) OVER w = 11 AND high = max(high) OVER w AS hi,
                count(*) OVER w = 11 AND low = min(low) OVER w AS lo
              FROM {_up_to(80)}
              WINDOW w AS (PARTITION BY symbol, cut ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)))
  GROUP BY symbol, cut)"""


CHIP = f"""chip AS (
  SELECT *, CASE WHEN mean = 0 THEN 'average' WHEN volume_cv < 0.5 AND range_place > 0.3 AND range_place < 0.7
                 THEN 'concentrated' WHEN volume_cv > 1 THEN 'dispersed' ELSE 'neutral' END AS chip_concentration
  FROM (SELECT symbol, interval, avg(volume) AS mean, stddev_samp(volume) / nullif(avg(volume), 0) AS volume_cv,
          CASE WHEN max(high) = min(low) THEN 0.5
               ELSE (max(close) FILTER (pos = n_bars) - min(low)) / (max(high) - min(low)) END AS range_place
        FROM panel WHERE pos > n_bars - 20 GROUP BY symbol, interval))"""

PATTERNS = f"""patterns AS (
  SELECT symbol, interval, {fired(
    ("mean > 0 AND (top - bottom) / mean < 0.08", "box"),
    ("hs < 0 AND ls > 0", "triangle"),
    ("abs((c - c20) / c20 * 100) > 10 AND abs((c - c5) / c5 * 100) < 4", "flag"),
  )} AS price_patterns
  FROM (SELECT symbol, interval, max(n_bars) AS n, max(high) AS top, min(low) AS bottom, avg(close) AS mean,
          regr_slope(high, pos) FILTER (pos > n_bars - 15) AS hs, regr_slope(low, pos) FILTER (pos > n_bars - 15) AS ls,
          max(close) FILTER (pos = n_bars) AS c, max(close) FILTER (pos = n_bars - 19) AS c20,
          max(close) FILTER (pos = n_bars - 4) AS c5
        FROM panel WHERE pos > n_bars - 30 GROUP BY symbol, interval)
  WHERE n >= 30)"""


def _known(c: str, default: str) -> str:
    return f"coalesce(k_{c}, {default}) AS {c}"


GAPPED = ("vol_ratio", "rsi", "bias", "adx", "plus_di", "minus_di", "cmf", "mfi")
RECORD = f"""last_rows AS (
  SELECT * FROM (SELECT *, {", ".join(f"last_value({c} IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k_{c}" for c in GAPPED)}
                 FROM panel) WHERE pos = n_bars AND n_bars >= 20),
snap AS (
  SELECT symbol, interval, ts, close AS price, {CHANGE} AS change, volume, coalesce(vol_ma20, volume) AS vol_ma20,
    coalesce(ma5, close) AS ma5, coalesce(ma10, close) AS ma10, coalesce(ma20, close) AS ma20,
    coalesce(ma60, ma20, close) AS ma60, coalesce(ma120, ma60, ma20, close) AS ma120,
    vol_ratio_high, vol_ratio_low, {_known("vol_ratio", "1")}, {_known("rsi", "50")}, {_known("bias", "0")},
    {_known("adx", "20")}, {_known("plus_di", "25")}, {_known("minus_di", "25")}, {_known("cmf", "0")},
    {_known("mfi", "50")}, macd, macd_signal, macd_hist,
    CASE WHEN coalesce(atr, 0) <= 0 THEN close * 0.02 ELSE atr END AS atr,
    {VP} AS vp_signals, {VOLUME_MEANS} AS volume_means, {CANDLES} AS candle_patterns
  FROM last_rows),
full_record AS (
  SELECT snap.*, s.support, r.resistance, dm.macd_divergence, dr.rsi_divergence, dob.obv_divergence,
         c.volume_cv, c.range_place, c.chip_concentration, coalesce(p.price_patterns, '') AS price_patterns
  FROM snap JOIN support s USING (symbol, interval) JOIN resistance r USING (symbol, interval)
  JOIN div_macd dm USING (symbol, interval) LEFT JOIN div_rsi dr USING (symbol, interval)
  JOIN div_obv dob USING (symbol, interval) JOIN chip c USING (symbol, interval)
  LEFT JOIN patterns p USING (symbol, interval))"""

LATEST = [
    _level("low", "min", "support"),
    _level("high", "max", "resistance"),
    _divergence("macd"),
    _divergence("rsi"),
    _divergence("obv"),
    CHIP,
    PATTERNS,
    RECORD,
]


def record(bars=(F1, "f1")) -> list[str]:
    return [*panel([bars[0]], bars[1], KEEP), *LATEST]


MODES = """modes AS (SELECT * FROM (VALUES ('trend', 2.5, 80, 20), ('short', 1.5, 75, 25),
  ('ultra_short', 1.2, 70, 30), ('swing', 2.0, 85, 15)) t(mode, m, ob, os))"""

CODES = """codes AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_suppkey % 4 AS turn,
    (['60', '68', '00', '30', '83'])[CAST(s_suppkey % 5 AS INTEGER) + 1]
      || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS ticker, s_name,
    s_acctbal / 100 AS pe, CASE WHEN s_acctbal > 0 THEN s_acctbal / 1000 END AS pb FROM supplier)"""

BULL, BEAR = "ma5 > ma10 AND ma10 > ma20", "ma5 < ma10 AND ma10 < ma20"


def _vpa(a, b, c, d, e) -> str:
    return f"""CASE WHEN change > 0 AND vol_ratio > vol_ratio_high THEN {a}
  WHEN change < 0 AND vol_ratio < vol_ratio_low AND price > ma20 THEN {b}
  WHEN change > 0 AND vol_ratio < vol_ratio_low THEN {c}
  WHEN change < 0 AND vol_ratio > vol_ratio_high THEN {d} ELSE {e} END"""


ANALYSIS = [
    CODES,
    MODES,
    f"""classed AS (
  SELECT f.*, m.*, i.pe, i.pb, CASE WHEN adx >= 25 THEN 'strong' ELSE 'weak' END AS trend_strength,
    CASE WHEN {BULL} AND price > ma60 AND plus_di >= minus_di THEN CASE WHEN adx >= 25 THEN 'strong_bull' ELSE 'bull' END
         WHEN {BEAR} AND price < ma60 AND minus_di > plus_di THEN CASE WHEN adx >= 25 THEN 'strong_bear' ELSE 'bear' END
         WHEN price >= ma20 THEN 'range_up' ELSE 'range_down' END AS trend,
    greatest(0, least(30, CASE WHEN price > ma20 THEN 8 ELSE 0 END + CASE WHEN price > ma60 THEN 8 ELSE 0 END
      + CASE WHEN {BULL} THEN 8 ELSE 0 END + CASE WHEN adx >= 25 AND plus_di > minus_di THEN 6
        WHEN adx >= 25 AND plus_di < minus_di THEN -3 ELSE 0 END)) AS trend_score,
    {_vpa("'attack'", "'low_vol_pullback'", "'up_low_vol'", "'heavy_drop'", "'neutral'")} AS vpa_signal,
    {_vpa(20, 15, 6, 2, 10)} AS vpa_score,
    {_vpa("printf('up, ratio %.2f > %.2f', vol_ratio, vol_ratio_high)", "printf('pullback, ratio %.2f < %.2f', vol_ratio, vol_ratio_low)", "'rise without volume'", "'panic selling'", "printf('ratio %.2f within range', vol_ratio)")} AS vpa_detail,
    CASE WHEN rsi BETWEEN os AND ob THEN 'healthy' WHEN rsi > ob THEN 'overbought' ELSE 'oversold' END AS rsi_status,
    CASE WHEN rsi BETWEEN os AND ob THEN 15 WHEN rsi > ob THEN 5 ELSE 8 END AS rsi_score,
    CASE WHEN abs(bias) <= 5 THEN 'normal' WHEN abs(bias) <= 8 THEN 'moderate' ELSE 'severe' END AS bias_status,
    CASE WHEN abs(bias) <= 5 THEN 10 WHEN abs(bias) <= 8 THEN 6 ELSE 2 END AS bias_score,
    CASE WHEN cmf > 0.1 THEN 'inflow' WHEN cmf < -0.1 THEN 'outflow' ELSE 'balanced' END AS money_status,
    greatest(0, least(20, CASE WHEN cmf > 0.1 THEN 8 WHEN cmf < -0.1 THEN 2 ELSE 5 END
      + CASE WHEN mfi BETWEEN 40 AND 70 THEN 5 WHEN mfi > 80 THEN -1 WHEN mfi < 25 THEN 2 ELSE 0 END
      + CASE obv_divergence WHEN 'bottom' THEN 4 WHEN 'top' THEN -4 ELSE 0 END)) AS money_score,
    concat_ws('；', printf('CMF=%.2f', cmf) || CASE WHEN cmf > 0.1 THEN ' inflow' WHEN cmf < -0.1 THEN ' outflow' ELSE ' neutral' END,
      CASE WHEN mfi BETWEEN 40 AND 70 THEN printf('MFI=%.1f mild', mfi) WHEN mfi > 80 THEN printf('MFI=%.1f overheated', mfi)
           WHEN mfi < 25 THEN printf('MFI=%.1f oversold', mfi) END,
      CASE obv_divergence WHEN 'bottom' THEN 'OBV bottom divergence' WHEN 'top' THEN 'OBV top divergence' END) AS money_detail,
    least(support * 0.98, price - m * atr) AS stop0, greatest(resistance * 0.99, price + 2.2 * atr) AS target0
  FROM full_record f CROSS JOIN modes m LEFT JOIN codes i USING (symbol)),
placed AS (
  SELECT *, CASE WHEN stop0 >= price THEN price - m * atr ELSE stop0 END AS stop_loss,
    CASE WHEN target0 <= price THEN price + 2.2 * atr ELSE target0 END AS take_profit FROM classed),
sized AS (
  SELECT *, greatest(price - stop_loss, price * 0.004) AS risk, greatest(take_profit - price, price * 0.006) AS reward,
    greatest(0, least(100, trend_score + vpa_score + rsi_score + bias_score + money_score)) AS total_score FROM placed),
analysis AS MATERIALIZED (
  SELECT *, CASE WHEN risk > 0 THEN reward / risk ELSE 0 END AS risk_reward,
    CASE WHEN risk > 0 THEN least(0.02 / (risk / price), 0.5) ELSE 0 END AS position_size,
    CASE WHEN total_score >= 75 THEN 'strong_long' WHEN total_score >= 60 THEN 'cautious_long'
         WHEN total_score >= 45 THEN 'watch' ELSE 'avoid' END AS status,
    CASE WHEN total_score >= 75 THEN 'success' WHEN total_score >= 60 THEN 'info'
         WHEN total_score >= 45 THEN 'warning' ELSE 'error' END AS action_color FROM sized)""",
]


def analysis(final: str) -> str:
    return query([*record(), *ANALYSIS], final)


_A_TEXT = """trend trend_strength chip_concentration rsi_status bias_status vpa_signal obv_divergence money_status
status action_color vp_signals candle_patterns price_patterns macd_divergence rsi_divergence""".split()
_A_INT = "trend_score vpa_score rsi_score bias_score money_score total_score".split()
_A_DOUBLE = """price change volume vol_ma20 vol_ratio pe pb ma5 ma10 ma20 ma60 ma120 adx plus_di minus_di macd
macd_signal macd_hist rsi bias cmf mfi stop_loss take_profit support resistance risk_reward position_size atr""".split()

NEAR = "((price - support) / price * 100)"
DIP = f"""dips AS (
  SELECT symbol, mode, price, atr, m, CASE WHEN change > -2 THEN 0 ELSE greatest(0, least(100,
      CASE WHEN vol_ratio < 0.8 THEN 30 ELSE -20 END
      + CASE WHEN {NEAR} > 0 AND {NEAR} < 3 THEN 30 WHEN {NEAR} < 0 THEN -40 ELSE 10 END
      + CASE WHEN rsi < 30 THEN 20 WHEN rsi < 40 THEN 10 ELSE 0 END + CASE WHEN cmf > 0 THEN 15 ELSE -10 END)) END AS score,
    CASE WHEN change > -2 THEN 'fall too small' ELSE concat_ws('；',
      CASE WHEN vol_ratio < 0.8 THEN 'thin volume' ELSE 'heavy volume' END,
      CASE WHEN {NEAR} > 0 AND {NEAR} < 3 THEN printf('near support %.2f (%.1f%%)', support, {NEAR})
           WHEN {NEAR} < 0 THEN 'below support' ELSE 'far from support' END,
      CASE WHEN rsi < 30 THEN printf('RSI=%.1f oversold', rsi) WHEN rsi < 40 THEN printf('RSI=%.1f near oversold', rsi) END,
      CASE WHEN cmf > 0 THEN 'CMF positive' ELSE 'CMF negative' END) END AS reason
  FROM analysis)"""

BEHAVIOR = (
    "SELECT symbol, b AS behavior, CAST(CASE b WHEN 'accumulation' THEN 0.7 WHEN 'washout' THEN 0.75"
    " WHEN 'markup' THEN 0.85 WHEN 'distribution' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence"
    " FROM (SELECT symbol, CASE WHEN abs(change) < 2 AND vol_ratio > 0.8 AND vol_ratio < 1.5 AND cmf > 0.05"
    " AND chip_concentration = 'concentrated' THEN 'accumulation'"
    " WHEN change < 0 AND vol_ratio < 0.8 AND cmf > -0.1 AND chip_concentration = 'concentrated' THEN 'washout'"
    " WHEN change > 0 AND vol_ratio > 1.2 AND cmf > 0.1 AND rsi > 50 AND macd_hist > 0 THEN 'markup'"
    " WHEN vol_ratio > 1.5 AND (abs(change) < 1 OR change < 0) AND cmf < -0.05 AND obv_divergence = 'top'"
    " THEN 'distribution' ELSE 'watch' END AS b FROM analysis WHERE mode = 'short')"
)
DIP_OUT = (
    "SELECT symbol, mode, CAST(score AS BIGINT) AS score,"
    " CASE WHEN score >= 70 THEN 'active' WHEN score >= 50 THEN 'cautious' ELSE 'none' END AS action, reason,"
    " CAST(CASE WHEN score >= 70 THEN 0.05 WHEN score >= 50 THEN 0.02 ELSE 0 END AS DOUBLE) AS suggested_position,"
    " round(CASE WHEN score >= 70 THEN price - m * atr WHEN score >= 50 THEN price - m * atr * 0.8 END, 4) AS stop_loss,"
    " round(CASE WHEN score >= 70 THEN price + m * atr * 1.5 WHEN score >= 50 THEN price + m * atr * 1.2 END, 4) AS target"
    " FROM dips"
)
#: Every nation as of its own 5th, 15th, 25th and last bar.
CUTS = """cuts AS (
  SELECT * EXCLUDE (bar, cut, n) REPLACE (symbol || '@' || cut AS symbol)
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, interval ORDER BY ts) AS bar FROM f2)
  CROSS JOIN (VALUES ('5', 5), ('15', 15), ('25', 25), ('last', NULL)) t(cut, n) WHERE n IS NULL OR bar <= n)"""
CUT = record((f"{F2},\n{CUTS}", "cuts"))
EARLY = record((f"{F2},\nearly AS (FROM f2 WHERE ts < TIMESTAMP '1995-03-01')", "early"))

RECORD_AT = RECORD.split("full_record AS")[0].replace("WHERE pos = n_bars AND n_bars >= 20", "WHERE n_bars >= 20 AND pos >= 20").replace(
    "symbol, interval, ts, close AS price", "symbol, interval, ts, pos, close AS price"
)
#: The record as of every bar: the window of each bar is joined, its pivots are found, and the latest-bar rules follow.
PANEL_RECORD = [
    *panel([F1], "f1"),
    LEVELS_AT,
    *[_divergence_at(i) for i in ("macd", "rsi", "obv")],
    f"""chip AS (
  SELECT *, CASE WHEN mean = 0 THEN 'average' WHEN volume_cv < 0.5 AND range_place > 0.3 AND range_place < 0.7
                 THEN 'concentrated' WHEN volume_cv > 1 THEN 'dispersed' ELSE 'neutral' END AS chip_concentration
  FROM (SELECT symbol, pos, avg(volume) OVER w AS mean, stddev_samp(volume) OVER w / nullif(avg(volume) OVER w, 0) AS volume_cv,
          CASE WHEN max(high) OVER w = min(low) OVER w THEN 0.5
               ELSE (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) END AS range_place
        FROM panel WINDOW w AS ({O} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))),
patterns AS (
  SELECT symbol, pos, CASE WHEN pos < 30 THEN '' ELSE {fired(
    ("mean > 0 AND (top - bottom) / mean < 0.08", "box"),
    ("hs < 0 AND ls > 0", "triangle"),
    ("abs((close - c20) / c20 * 100) > 10 AND abs((close - c5) / c5 * 100) < 4", "flag"),
  )} END AS price_patterns
  FROM (SELECT symbol, pos, close, max(high) OVER w AS top, min(low) OVER w AS bottom, avg(close) OVER w AS mean,
          regr_slope(high, pos) OVER t AS hs, regr_slope(low, pos) OVER t AS ls,
          lag(close, 19) OVER o AS c20, lag(close, 4) OVER o AS c5
        FROM panel WINDOW w AS ({O} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
          t AS ({O} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), o AS ({O})))""",
    RECORD_AT
    + """full_record AS (
  SELECT snap.*, l.support, l.resistance, coalesce(dm.macd_divergence, 'none') AS macd_divergence,
         coalesce(dr.rsi_divergence, 'none') AS rsi_divergence, coalesce(dob.obv_divergence, 'none') AS obv_divergence,
         c.volume_cv, c.range_place, c.chip_concentration, p.price_patterns
  FROM snap JOIN levels l USING (symbol, pos) JOIN chip c USING (symbol, pos) JOIN patterns p USING (symbol, pos)
  LEFT JOIN div_macd dm ON dm.symbol = snap.symbol AND dm.cut = snap.pos
  LEFT JOIN div_rsi dr ON dr.symbol = snap.symbol AND dr.cut = snap.pos
  LEFT JOIN div_obv dob ON dob.symbol = snap.symbol AND dob.cut = snap.pos)""",
    *ANALYSIS,
]

# --- across intervals -------------------------------------------------------------

COMPOSITE_WEIGHTS = """views AS (SELECT * FROM (VALUES ('ultra_short', 0.3, 0.0, 0.7, false, true),
  ('short', 0.6, 0.0, 0.4, true, true), ('mid_long', 0.7, 0.3, 0.0, true, false)) t(view, wd0, ww, wh0, uses_w, uses_h))"""
COMPOSITE = f"""scored AS (SELECT *, {SCORE} AS score FROM panel WHERE pos = n_bars),
wide AS (
  SELECT symbol, {", ".join(f"max({c}) FILTER (interval = '{i}') AS {n}_{c}" for n, i in (("d", "1d"), ("w", "1wk"), ("h", "60m")) for c in ("score", "n_bars", "close", "rsi", "macd_hist", "vol_ratio", "ma20"))}
  FROM scored GROUP BY symbol),
offered AS (
  SELECT *, coalesce(d_n_bars >= 20, false) AS d, uses_w AND coalesce(w_n_bars >= 20, false) AS w,
    uses_h AND coalesce(h_n_bars >= 20, false) AS h FROM wide CROSS JOIN views),
weighted AS (
  SELECT *, CASE WHEN uses_h AND NOT h THEN 1.0 ELSE wd0 END AS wd, CASE WHEN uses_h AND NOT h THEN 0.0 ELSE wh0 END AS wh FROM offered),
summed AS (
  SELECT *, CAST(d AS INT) * wd + CAST(w AS INT) * ww + CAST(h AS INT) * wh AS ws,
    CASE WHEN d THEN d_score * wd ELSE 0 END + CASE WHEN w THEN w_score * ww ELSE 0 END + CASE WHEN h THEN h_score * wh ELSE 0 END AS pts,
    CASE WHEN d THEN d_score ELSE 0 END + CASE WHEN w THEN w_score ELSE 0 END + CASE WHEN h THEN h_score ELSE 0 END AS plain,
    CAST(d AS INT) + CAST(w AS INT) + CAST(h AS INT) AS n FROM weighted)
"""
AS_OF_FIELDS = "score n_bars close rsi macd_hist vol_ratio ma20".split()
AS_OF = f"""scored AS (
  SELECT *, {SCORE} AS score, ts + CASE interval WHEN '60m' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END AS known
  FROM (SELECT * REPLACE (pos AS n_bars, {", ".join(f"CASE WHEN pos >= 20 THEN {c} END AS {c}" for c in AS_OF_FIELDS[3:])}) FROM panel)),
wide AS (
  SELECT d.symbol, d.ts, {", ".join(f"{n}.{c} AS {n}_{c}" for n in "dwh" for c in AS_OF_FIELDS)}
  FROM (FROM scored WHERE interval = '1d') d
  ASOF LEFT JOIN (FROM scored WHERE interval = '1wk') w ON d.symbol = w.symbol AND d.known >= w.known
  ASOF LEFT JOIN (FROM scored WHERE interval = '60m') h ON d.symbol = h.symbol AND d.known >= h.known),
"""
COMPOSITE_OUT = (
    "view, CASE WHEN d THEN d_score END AS score_daily, CASE WHEN w THEN w_score END AS score_weekly,"
    " CASE WHEN h THEN h_score END AS score_hourly, CAST(wd AS DOUBLE) AS w_daily, CAST(ww AS DOUBLE) AS w_weekly,"
    " CAST(wh AS DOUBLE) AS w_hourly, round(CAST(coalesce(CASE WHEN ws > 0 THEN pts / ws END,"
    " plain / nullif(n, 0), 0) AS DOUBLE), 4) AS composite_score,"
    + ", ".join(
        f"round(CASE WHEN h THEN h_{c} END, 4) AS hourly_{c}"
        for c in ("close", "rsi", "macd_hist", "vol_ratio")
    )
    + ", "
    + ", ".join(
        f"round(CASE WHEN uses_w THEN w_{c} END, 4) AS weekly_{c}"
        for c in ("close", "rsi", "macd_hist", "ma20")
    )
)
THIN = """thin AS (SELECT symbol FROM {0} GROUP BY symbol
  HAVING count(*) FILTER (interval = '1wk') < 20 AND count(*) FILTER (interval = '1d') >= 80)"""


def _insight(view: str, mode: str, daily: int, weeks: int) -> str:
    """Record, behaviour, dip, signals, blended score and note of the daily bars of each symbol."""
    keep = f"CASE interval WHEN '1d' THEN {daily} WHEN '1wk' THEN {weeks} ELSE 320 END"
    last = "pos = n_bars AND n_bars >= 20 AND interval = '1d'"
    bars = [
        *MIXED,
        THIN.format("mixed"),
        weekly("(FROM mixed WHERE interval = '1d' AND symbol IN (FROM thin))", "w"),
        "daily_weekly AS (FROM mixed UNION ALL FROM w)",
    ]
    dips = DIP.replace("FROM analysis)", "FROM analysis WHERE interval = '1d')")
    behavior = BEHAVIOR.replace("mode = 'short'", "mode = 'short' AND interval = '1d'")
    signals = STRUCTURED.replace("pos >= 3 AND n_bars >= 20", last)
    return query(
        [*panel(bars, "daily_weekly", keep), *LATEST, *ANALYSIS, dips, COMPOSITE_WEIGHTS, COMPOSITE],
        f"""SELECT a.symbol, s.view, a.mode, {TS}, CAST(total_score AS BIGINT) AS total_score, status, trend,
  {", ".join(R.format(c) for c in ("price", "stop_loss", "take_profit"))}, b.behavior, d.score AS dip_score, d.action AS dip_action,
  t.triggers, g.signals, CASE WHEN s.d THEN d_score END AS score_daily, CASE WHEN s.w THEN w_score END AS score_weekly,
  CASE WHEN s.h THEN h_score END AS score_hourly,
  round(CAST(coalesce(CASE WHEN ws > 0 THEN pts / ws END, plain / nullif(s.n, 0), 0) AS DOUBLE), 4) AS composite_score,
  CASE WHEN a.symbol IN (FROM thin) THEN 'weekly bars resampled from daily' END AS note
FROM analysis a JOIN ({behavior}) b USING (symbol)
JOIN (SELECT symbol, mode, score, action FROM ({DIP_OUT})) d USING (symbol, mode)
JOIN (SELECT symbol, {TRIGGERS} AS triggers FROM panel WHERE {last}) t USING (symbol)
JOIN (SELECT symbol, string_agg(name, '|' ORDER BY place) AS signals FROM ({signals}) GROUP BY symbol) g USING (symbol)
JOIN summed s ON s.symbol = a.symbol AND s.view = '{view}' WHERE a.interval = '1d' AND a.mode = '{mode}'""",
    )


# --- fundamentals -----------------------------------------------------------------

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
STATEMENTS = f"""lines AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, q AS period_end, sold / 10000 AS revenue,
         (sold - cents * 90) / 10000 AS net_income, s_acctbal AS equity,
         s_acctbal * 0.5 AS liabilities, s_acctbal * 2 AS assets
  FROM (SELECT l_suppkey, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS q,
          CAST(sum({CENTS} * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) AS sold,
          CAST(sum({CENTS}) AS DOUBLE) AS cents FROM lineitem GROUP BY 1, 2)
  JOIN supplier ON l_suppkey = s_suppkey),
ttm AS (
  SELECT * FROM (SELECT symbol, min(period_end) OVER w AS period_start, period_end, sum(revenue) OVER w AS revenue,
      sum(net_income) OVER w AS net_income, count(*) OVER w AS n, equity, liabilities, assets,
      row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS back
    FROM lines WINDOW w AS (PARTITION BY symbol ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
  WHERE n = 4),
ratios AS (SELECT *, net_income / nullif(equity, 0) * 100 AS roe, liabilities / nullif(assets, 0) * 100 AS debt_ratio FROM ttm)"""


def _growth(c: str) -> str:
    return f"""CASE WHEN count({c}) < 2 THEN 'insufficient' WHEN coalesce(bool_and(g_{c} > 0), false) THEN 'growing'
  WHEN bool_or(g_{c} > 0) AND bool_or(g_{c} < 0) THEN 'unstable' ELSE 'declining' END AS {c}_trend"""


def _summary(order: str, direction: str) -> str:
    newest, oldest = ("arg_max", "arg_min") if order == "chronological" else ("arg_min", "arg_max")
    return f"""SELECT symbol, {_growth("revenue")}, {_growth("net_income")},
  CASE WHEN count(roe) < 2 THEN 'insufficient' WHEN {newest}(roe, period_end) > {oldest}(roe, period_end) THEN 'up'
       WHEN {newest}(roe, period_end) < {oldest}(roe, period_end) THEN 'down' ELSE 'flat' END AS roe_trend, '{order}' AS "order"
FROM (SELECT *, (revenue - lag(revenue) OVER o) / nullif(lag(revenue) OVER o, 0) AS g_revenue,
             (net_income - lag(net_income) OVER o) / nullif(lag(net_income) OVER o, 0) AS g_net_income
      FROM ratios WHERE back <= 4 WINDOW o AS (PARTITION BY symbol ORDER BY period_end {direction})) GROUP BY symbol"""


def _fixed(c: str) -> str:
    return f"coalesce(printf('%.2f', {c}), 'N/A') AS {c}"


HOME = "regexp_full_match(symbol, '[0-9]{6}')"
CHART = """CASE WHEN close >= open THEN '#16a34a' ELSE '#dc2626' END AS bar_color, close >= open AS is_up"""
OHLCV = ", ".join(R.format(c) for c in ("open", "high", "low", "close", "volume"))

ORACLES = {
    "clean_bars": query(
        [F3],
        "SELECT symbol, interval, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(open, 4) AS open,"
        " round(high, 4) AS high, round(low, 4) AS low,"
        " round(CASE WHEN hour(ts) IN (1, 3, 4, 5, 6, 10) THEN close ELSE 7.25 END, 4) AS close,"
        " round(volume, 4) AS volume FROM f3",
    ),
    "rejected_bars": query(
        [F3],
        "SELECT symbol, interval, CASE hour(ts) WHEN 1 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date,"
        " CAST(CASE WHEN hour(ts) IN (1, 3, 4, 5, 6, 10) THEN 2 ELSE 1 END AS BIGINT) AS ingest_seq,"
        " CASE hour(ts) WHEN 1 THEN 'date' WHEN 3 THEN 'open' WHEN 10 THEN 'open' WHEN 4 THEN 'high' WHEN 5 THEN 'low'"
        " WHEN 6 THEN 'close' ELSE 'superseded' END AS reason FROM f3",
    ),
    "ticker_normalize": query(
        [CODES],
        "SELECT symbol, ticker || CASE WHEN left(ticker, 2) IN ('60', '68') THEN '.SS'"
        " WHEN left(ticker, 2) IN ('00', '30') THEN '.SZ' ELSE '' END AS ticker,"
        " '#dc2626' AS up_color, '#16a34a' AS down_color FROM codes",
    ),
    "source_fallback": query(
        [F1],
        "SELECT symbol, interval, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(open, 4) AS open,"
        " round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close,"
        " round(CASE WHEN CAST(symbol AS BIGINT) % 4 = 1 THEN volume * 2 ELSE volume END, 4) AS volume"
        " FROM f1 WHERE CAST(symbol AS BIGINT) % 4 <> 3",
    ),
    "source_notes": query(
        [CODES],
        "SELECT symbol, '1d' AS interval, CASE CAST(symbol AS BIGINT) % 4 WHEN 1 THEN 'fell back'"
        " WHEN 3 THEN 'fell back|no valid data' ELSE '' END AS notes FROM codes"
        " UNION ALL SELECT ticker, '60m', 'fell back|no hourly bars' FROM (SELECT DISTINCT ticker FROM codes)",
    ),
    "merged_notes": query(
        [CODES],
        "SELECT symbol, CASE CAST(symbol AS BIGINT) % 4 WHEN 1 THEN 'fell back|weekly bars resampled from daily'"
        " WHEN 3 THEN 'fell back|no valid data' ELSE 'weekly bars resampled from daily' END AS notes FROM codes"
        " UNION ALL SELECT ticker, 'fell back|no hourly bars' FROM (SELECT DISTINCT ticker FROM codes)",
    ),
    "instrument_info": query(
        [CODES],
        "SELECT symbol, CASE turn WHEN 0 THEN s_name WHEN 1 THEN 'S' || symbol WHEN 2 THEN 'L' || symbol"
        " ELSE symbol END AS name, round(pe, 4) AS pe, round(pb, 4) AS pb FROM codes",
    ),
    "daily_bars": query([F1], f"SELECT {BAR_OUT} FROM f1"),
    "nation_bars": query([F2], f"SELECT {BAR_OUT} FROM f2"),
    "hourly_bars": query([F3], f"SELECT {BAR_OUT} FROM f3"),
    "weekly_bars": query([F1, weekly("f1", "w")], f"SELECT {BAR_OUT} FROM w"),
    "weekly_fallback": query(
        [F1, weekly("f1", "w")],
        f"SELECT {BAR_OUT} FROM (FROM f1 UNION ALL SELECT symbol, interval, ts, open, high, low, close,"
        " volume + CASE WHEN CAST(symbol AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS volume FROM w)",
    ),
    "bars_tail": query(
        [
            *MIXED,
            tail("mixed", "CASE interval WHEN '1d' THEN 110 WHEN '1wk' THEN 52 ELSE 320 END"),
        ],
        f"SELECT {BAR_OUT} FROM kept",
    ),
    "scan_window": query(
        MIXED,
        f"SELECT {BAR_OUT} FROM mixed WHERE ts < TIMESTAMP '2001-07-01' AND ts >= TIMESTAMP '2001-06-30'"
        " - CASE interval WHEN '60m' THEN INTERVAL 40 DAY ELSE INTERVAL 408 DAY END",
    ),
    "scan_windows": query(
        [
            F1,
            "days AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS as_of FROM lineitem QUALIFY row_number()"
            " OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_shipdate DESC) = 1)",
        ],
        f"SELECT {BAR_OUT}, strftime(as_of, '%Y-%m-%d') AS as_of FROM f1 JOIN days USING (symbol)"
        " WHERE ts < as_of + INTERVAL 1 DAY AND ts >= as_of - INTERVAL 165 DAY",
    ),
    "ma_set": full("ma5", "ma10", "ma20", "ma60", "ma120"),
    "volume_ratio": full(
        "vol_ma5", "vol_ma10", "vol_ma20", "vol_ratio", "vol_ratio_high", "vol_ratio_low"
    ),
    "obv": full("obv", "obv_ma20"),
    "rsi": full("rsi", stateful=True),
    "bias": full("bias"),
    "atr": full("atr"),
    "adx": full("plus_di", "minus_di", "adx"),
    "cmf": full("cmf"),
    "mfi": full("mfi"),
    "macd": full("macd", "macd_signal", "macd_hist", stateful=True),
    "flat_bars": full("plus_di", "minus_di", "cmf", "mfi", "rsi", stateful=True, bars=(F2, "f2")),
    "hourly_panel": full("ma20", "vol_ratio", "rsi", "macd_hist", stateful=True, bars=(F3, "f3")),
    "score_panel": query(panel([F1], "f1"), f"SELECT symbol, {TS}, {SCORE} AS score FROM panel"),
    "panel_increment": query(
        panel([F1], "f1"),
        f"SELECT symbol, {TS}, pos, "
        + ", ".join(R.format(c) for c in "ma120 vol_ratio_high adx mfi obv obv_ma20 rsi macd macd_signal macd_hist".split())
        + " FROM panel WHERE ts >= TIMESTAMP '1997-06-01'",
    ),
    "candle_patterns": query(
        panel([F1], "f1", stateful=False),
        f"SELECT symbol, {TS}, {CANDLES} AS candle_patterns FROM panel",
    ),
    "vp_signals": query(
        panel([F1], "f1", stateful=False),
        f"SELECT symbol, {TS}, CASE WHEN pos < 3 THEN '' ELSE {VP} END AS vp_signals,"
        f" CASE WHEN pos >= 3 THEN {VOLUME_MEANS} END AS volume_means FROM panel",
    ),
    "vp_texts": query(
        panel([F1], "f1", stateful=False),
        f"SELECT symbol, {TS}, CASE WHEN pos < 3 THEN '' ELSE concat_ws('|', {VP_WORDS}, {VOLUME_MEANS}) END AS vp_texts FROM panel",
    ),
    "triggers": query(
        panel([F1], "f1", stateful=False),
        f"SELECT symbol, {TS}, CASE WHEN pos < 20 THEN '' ELSE {TRIGGERS} END AS triggers FROM panel",
    ),
    "structured_signals": query(panel([F1], "f1"), STRUCTURED),
    "divergence_panel": query(
        [*panel([F1], "f1"), *[_divergence_at(i) for i in ("macd", "rsi", "obv")]],
        f"SELECT p.symbol, {TS}, coalesce(macd_divergence, 'none') AS macd_divergence,"
        " coalesce(rsi_divergence, 'none') AS rsi_divergence, coalesce(obv_divergence, 'none') AS obv_divergence FROM panel p"
        + "".join(f" LEFT JOIN div_{i} ON div_{i}.symbol = p.symbol AND div_{i}.cut = p.pos" for i in ("macd", "rsi", "obv")),
    ),
    "levels_panel": query(
        [*panel([F1], "f1", stateful=False), LEVELS_AT],
        f"SELECT symbol, {TS}, round(support, 4) AS support, round(resistance, 4) AS resistance"
        " FROM panel JOIN levels USING (symbol, pos)",
    ),
    "long_windows": query(
        [F2],
        f"SELECT symbol, {TS}, "
        + ", ".join(
            f"round(CASE WHEN row_number() OVER ({O}) >= 20 THEN {f} OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END, 4)"
            f" AS {name}{n}"
            for n in (250, 1000)
            for f, name in (("max(high)", "high_max"), ("min(low)", "low_min"), ("stddev_samp(close)", "close_std"), ("close / avg(close)", "close_to_mean"))
        )
        + " FROM f2",
    ),
    "behavior_panel": query(
        PANEL_RECORD,
        BEHAVIOR.replace("SELECT symbol,", f"SELECT symbol, {TS},", 1).replace("(SELECT symbol,", "(SELECT symbol, ts,")
        + f" UNION ALL SELECT symbol, {TS}, 'unknown', CAST(0 AS DOUBLE) FROM panel WHERE pos < 20",
    ),
    "dip_entry_panel": query(
        [*PANEL_RECORD, DIP.replace("SELECT symbol, mode", "SELECT symbol, ts, mode")],
        DIP_OUT.replace("SELECT symbol, mode", f"SELECT symbol, {TS}, mode")
        + f" UNION ALL SELECT symbol, {TS}, mode, 0, 'none', 'insufficient data', CAST(0 AS DOUBLE), NULL, NULL"
        " FROM panel CROSS JOIN modes WHERE pos < 20",
    ),
    "risk_panel": query(
        PANEL_RECORD,
        f"SELECT symbol, {TS}, mode, trend, status, CAST(total_score AS BIGINT) AS total_score, chip_concentration, price_patterns,"
        " candle_patterns, vp_signals, "
        + ", ".join(R.format(c) for c in ("stop_loss", "take_profit", "risk_reward", "position_size", "rsi", "adx"))
        + " FROM analysis",
    ),
    "support_resistance": query(
        record(),
        "SELECT symbol, round(support, 4) AS support, round(resistance, 4) AS resistance FROM full_record",
    ),
    "divergence": query(
        record(), "SELECT symbol, macd_divergence, rsi_divergence, obv_divergence FROM full_record"
    ),
    "chip": query(
        record(),
        "SELECT symbol, round(volume_cv, 4) AS volume_cv, round(range_place, 4) AS range_place,"
        " chip_concentration FROM full_record",
    ),
    "chip_flat": query(
        record((F2, "f2")),
        "SELECT symbol, round(volume_cv, 4) AS volume_cv, round(range_place, 4) AS range_place,"
        " chip_concentration FROM full_record",
    ),
    "price_patterns": query(record(), "SELECT symbol, price_patterns FROM full_record"),
    "score_latest": query(
        panel([F2], "f2", KEEP),
        f"SELECT symbol, {TS}, n_bars, {SCORE} AS score FROM panel WHERE pos = n_bars",
    ),
    "score_short": query(
        panel([F2, "early AS (FROM f2 WHERE ts < TIMESTAMP '1995-03-01')"], "early", KEEP),
        f"SELECT symbol, n_bars, {SCORE} AS score FROM panel WHERE pos = n_bars",
    ),
    "analysis": analysis(
        f"SELECT symbol, {TS}, mode, CAST(m AS DOUBLE) AS atr_mult, {', '.join(_A_TEXT)},"
        f" {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _A_INT)},"
        f" {', '.join(R.format(c) for c in _A_DOUBLE)} FROM analysis"
    ),
    "analysis_text": analysis(
        "SELECT symbol, mode, vpa_detail, money_detail, CASE status"
        " WHEN 'strong_long' THEN printf('buy in parts, at most %.0f%%', position_size * 100)"
        " WHEN 'cautious_long' THEN printf('follow with about %.0f%%', position_size * 100)"
        " WHEN 'watch' THEN 'wait for a breakout or a key level'"
        " ELSE 'defend, take little part' END AS advice FROM analysis"
    ),
    "behavior": analysis(BEHAVIOR),
    "behavior_short": query(
        [*EARLY, *ANALYSIS],
        f"{BEHAVIOR} UNION ALL SELECT symbol, 'unknown', CAST(0 AS DOUBLE) FROM panel WHERE pos = n_bars AND n_bars < 20",
    ),
    "dip_entry": query([*record(), *ANALYSIS, DIP], DIP_OUT),
    "dip_entry_short": query(
        [*EARLY, *ANALYSIS, DIP],
        f"{DIP_OUT} UNION ALL SELECT symbol, mode, 0, 'none', 'insufficient data', CAST(0 AS DOUBLE), NULL, NULL"
        " FROM panel CROSS JOIN modes WHERE pos = n_bars AND n_bars < 20",
    ),
    "score_cuts": query(
        panel([F2, CUTS], "cuts", KEEP),
        f"SELECT symbol, n_bars, {SCORE} AS score FROM panel WHERE pos = n_bars",
    ),
    "behavior_cuts": query(
        [*CUT, *ANALYSIS],
        f"{BEHAVIOR} UNION ALL SELECT symbol, 'unknown', CAST(0 AS DOUBLE) FROM panel WHERE pos = n_bars AND n_bars < 20",
    ),
    "dip_entry_cuts": query(
        [*CUT, *ANALYSIS, DIP],
        f"{DIP_OUT} UNION ALL SELECT symbol, mode, 0, 'none', 'insufficient data', CAST(0 AS DOUBLE), NULL, NULL"
        " FROM panel CROSS JOIN modes WHERE pos = n_bars AND n_bars < 20",
    ),
    "composite": query(
        [
            *panel(
                [
                    *MIXED,
                    THIN.format("mixed"),
                    weekly("(FROM mixed WHERE interval = '1d' AND symbol IN (FROM thin))", "w"),
                    "daily_weekly AS (FROM mixed UNION ALL FROM w)",
                ],
                "daily_weekly",
                KEEP,
            ),
            COMPOSITE_WEIGHTS,
            COMPOSITE,
        ],
        f"SELECT symbol, {COMPOSITE_OUT} FROM summed",
    ),
    "composite_panel": query(
        [
            *panel(
                [*MIXED, weekly("(FROM mixed WHERE interval = '1d')", "w"), "daily_weekly AS (FROM mixed UNION ALL FROM w)"],
                "daily_weekly",
            ),
            COMPOSITE_WEIGHTS,
            AS_OF + COMPOSITE[COMPOSITE.index("offered AS (") :],
        ],
        f"SELECT symbol, {TS}, {COMPOSITE_OUT} FROM summed",
    ),
    "stored_bars": query(MIXED, f"SELECT {BAR_OUT} FROM mixed"),
    "insight_ultra_short": _insight("ultra_short", "ultra_short", 50, 52),
    "insight_short": _insight("short", "short", 110, 52),
    "insight_mid_long": _insight("mid_long", "trend", 272, 60),
    "sector_heatmap": query(
        panel([F1], "f1", "50"),
        f"""SELECT n_name AS sector, CAST(k AS VARCHAR) AS code, coalesce(score, 0) AS score,
  coalesce(trend, 'no_data') AS trend, coalesce(n_bars, 0) AS bars
FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1) ON n_nationkey = s_nationkey
LEFT JOIN (SELECT symbol, n_bars, {SCORE} AS score, CASE WHEN close > ma20 AND ma5 > ma10 AND ma10 > ma20 THEN 'strong'
             WHEN close > ma20 THEN 'up' WHEN close < ma20 THEN 'down' ELSE 'range' END AS trend
           FROM panel WHERE pos = n_bars AND n_bars >= 20) s ON s.symbol = CAST(k AS VARCHAR)""",
    ),
    "fundamental_ttm": query(
        [STATEMENTS],
        "SELECT symbol, strftime(period_start, '%Y-%m-%d') AS period_start,"
        " strftime(period_end, '%Y-%m-%d') AS period_end,"
        f" {', '.join(R.format(c) for c in ('revenue', 'net_income', 'roe', 'debt_ratio'))} FROM ratios",
    ),
    "fundamental_reported": query(
        [STATEMENTS],
        "SELECT symbol, strftime(period_end, '%Y-%m-%d') AS period_end, round(revenue, 4) AS revenue,"
        " round(net_income, 4) AS net_income, round(net_income / nullif(equity, 0) * 100, 4) AS roe,"
        " CAST(NULL AS DOUBLE) AS gross_margin, round(liabilities / nullif(assets, 0) * 100, 4) AS debt_ratio FROM (SELECT *, row_number() OVER (PARTITION BY symbol"
        " ORDER BY period_end DESC) AS back FROM lines) WHERE back <= 4",
    ),
    "fundamental_summary": query(
        [STATEMENTS],
        _summary("chronological", "ASC") + "\nUNION ALL\n" + _summary("reported", "DESC"),
    ),
    "fundamental_text": query(
        [STATEMENTS],
        "SELECT symbol, strftime(period_end, '%Y-%m') AS period,"
        f" {', '.join(_fixed(c) for c in ('revenue', 'net_income', 'roe', 'debt_ratio'))} FROM ratios WHERE back <= 4",
    ),
    "news_top5": "SELECT event_type AS symbol, rank, props AS title, CAST(user_id AS VARCHAR) AS source,"
    " '/item/' || event_id AS url, strftime(ts, '%Y-%m-%d %H:%M') AS time FROM (SELECT *, row_number() OVER"
    " (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 5",
    "hot_tags": analysis(
        "SELECT symbol, mode, "
        + fired(
            ("vpa_signal = 'attack'", "attack"),
            ("money_status = 'inflow'", "inflow"),
            ("trend IN ('strong_bull', 'bull')", "uptrend"),
            ("macd_divergence = 'top'", "top_divergence"),
        )
        + " AS tags FROM analysis"
    ),
    "risk_messages": analysis(
        "SELECT symbol, mode, "
        + fired(
            ("macd_divergence = 'top'", "macd_top_divergence"),
            ("rsi_divergence = 'top'", "rsi_top_divergence"),
            ("rsi > 80", "rsi_overbought"),
            ("vpa_signal = 'heavy_drop'", "heavy_drop"),
        )
        + " AS risks FROM analysis"
    ),
    "score_vector": analysis(
        "\nUNION ALL ".join(
            f"SELECT symbol, mode, '{name}' AS dimension, CAST({c} AS BIGINT) AS score FROM analysis"
            for name, c in (
                ("trend", "trend_score"),
                ("volume_price", "vpa_score"),
                ("momentum", "rsi_score + bias_score"),
                ("money", "money_score"),
                ("total", "total_score"),
            )
        )
    ),
    "readings": analysis(
        f"""SELECT symbol, mode, CASE WHEN {BULL} THEN 'bull_order' WHEN {BEAR} THEN 'bear_order' ELSE 'mixed' END AS short_trend,
  CASE WHEN price > ma60 THEN 'above_ma60' ELSE 'below_ma60' END AS long_trend,
  CASE WHEN macd_hist > 0 THEN 'red' ELSE 'green' END AS macd_side,
  CASE WHEN vol_ratio > 1.2 THEN 'heavy' WHEN vol_ratio < 0.8 THEN 'thin' ELSE 'normal' END AS volume_word,
  CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_word,
  CASE WHEN abs(bias) > 8 THEN 'stretched' ELSE 'normal' END AS bias_word,
  CASE WHEN cmf > 0 THEN 'inflow' WHEN cmf < 0 THEN 'outflow' ELSE 'balanced' END AS cmf_word,
  CASE WHEN mfi > 80 THEN 'overheated' WHEN mfi < 20 THEN 'oversold' ELSE 'healthy' END AS mfi_word FROM analysis"""
    ),
    "chart_feed": query(
        record(),
        f"""SELECT symbol, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts,
  {", ".join(f"round(p.{c}, 4) AS {c}" for c in ("open", "high", "low", "close", "volume", "ma5", "ma20", "ma60", "vol_ma20", "macd", "macd_signal", "macd_hist", "rsi"))},
  {CHART.replace("close", "p.close").replace("open", "p.open")},
  CASE WHEN p.macd_hist >= 0 THEN '#16a34a' ELSE '#dc2626' END AS hist_color,
  round(f.support, 4) AS support, round(f.resistance, 4) AS resistance
FROM panel p LEFT JOIN full_record f USING (symbol, interval) WHERE p.pos > p.n_bars - 90""",
    ),
    "hourly_chart_feed": query(
        panel([F3], "f3", KEEP, False),
        f"SELECT symbol, {TS}, {OHLCV}, round(ma5, 4) AS ma5, round(ma20, 4) AS ma20, {CHART}"
        " FROM panel WHERE pos > n_bars - 200",
    ),
    "report_context": query(
        [*record((F3D, "f3d")), *ANALYSIS],
        "SELECT a.symbol, mode, trend, status, rsi_status, CAST(total_score AS BIGINT) AS total_score,"
        f" {', '.join(R.format(c) for c in ('price', 'stop_loss', 'take_profit'))}, n_news, first_title, first_time"
        " FROM analysis a LEFT JOIN (SELECT event_type AS symbol, least(n, 5) AS n_news, props AS first_title,"
        " strftime(ts, '%Y-%m-%d %H:%M') AS first_time FROM (SELECT *,"
        " row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS k,"
        " count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k = 1) i ON i.symbol = a.symbol",
    ),
    "top_scores": query(
        panel([F1], "f1", KEEP),
        f"SELECT symbol, interval, {TS}, round(close, 4) AS close, {SCORE} AS score, n_bars"
        " FROM panel WHERE pos = n_bars ORDER BY 5 DESC, symbol LIMIT 10",
    ),
}

ORACLES["report_full"] = f"""
SELECT i.symbol, i.mode, i.view, i.trend, i.status, i.total_score, i.score_daily, i.score_weekly, i.score_hourly, i.price, i.stop_loss,
  i.take_profit, i.composite_score, c.hourly_close, c.hourly_vol_ratio, c.weekly_close, c.weekly_ma20, n.name,
  s.revenue_trend, s.net_income_trend, s.roe_trend, t.n_periods, t.first_period, t.first_revenue, w.n_news, w.first_title
FROM ({ORACLES["insight_short"]}) i
JOIN (SELECT * FROM ({ORACLES["composite"]}) WHERE view = 'short') c USING (symbol)
LEFT JOIN ({ORACLES["instrument_info"]}) n USING (symbol)
LEFT JOIN (SELECT * FROM ({ORACLES["fundamental_summary"]}) WHERE "order" = 'reported') s USING (symbol)
LEFT JOIN (SELECT symbol, count(*) AS n_periods, min(period) AS first_period, arg_min(revenue, period) AS first_revenue
           FROM ({ORACLES["fundamental_text"]}) GROUP BY symbol) t USING (symbol)
LEFT JOIN (SELECT event_type AS symbol, least(count(*), 5) AS n_news, arg_max(props, (ts, -event_id)) AS first_title
           FROM events GROUP BY event_type) w USING (symbol)"""


def _half_up(sql: str) -> str:
    """``round(x, 4)`` spelled out as the Spark side does it."""
    while (at := sql.find("round(")) >= 0 and sql.find(", 4)", at) >= 0:
        depth, i = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if depth == 0:
                break
            i += 1
        inner = sql[at + 6 : i]
        if not inner.endswith(", 4"):
            sql = sql[:at] + "ROUND" + sql[at + 5 :]
            continue
        sql = f"{sql[:at]}floor(CAST(({inner[:-3]}) AS DOUBLE) * 10000 + 0.5) / 10000{sql[i + 1 :]}"
    return sql


ORACLES["fundamental_wide"] = ORACLES["fundamental_ttm"]  # the same statements in another form
ORACLES = {name: _half_up(sql) for name, sql in ORACLES.items()}
