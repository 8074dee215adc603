import datetime as dt

import pytest
from pyspark.sql import functions as F

from barframe.functions.numeric import clip, labels, points, to_finite
from barframe.functions.tickers import market_colors, normalize_ticker
from barframe.operators import fundamentals as fund
from barframe.operators import signals as sig
from barframe.operators.analysis import analyze, mode_of
from barframe.operators.clean import clean_bars
from barframe.operators.cross import composite, scores_by_interval, sector_heatmap
from barframe.operators.indicators import latest_history
from barframe.operators.news import epoch_to_time, latest_news
from barframe.operators.resample import bars_from_trades, weekly_from_daily, with_weekly_fallback
from barframe.plans.insight import deep_insight
from barframe.schema import BAR_SCHEMA, TRADE_MODES, bars_kept, sector_leaders, trade_modes, views
from barframe.sources.fallback import choose_source, instrument_info
from barframe.sources.readers import read_table, scan_window, write_bars
from tests import series_data as sd


def test_tickers(spark):
    codes = [" 600036 ", "688981", "002594", "300274", "830001", "aapl", "6000361"]
    got = spark.createDataFrame([(c,) for c in codes], "t string").select(
        normalize_ticker("t"), market_colors("t")["up"]
    )
    assert [tuple(r) for r in got.collect()] == [
        ("600036.SS", "#dc2626"),
        ("688981.SS", "#dc2626"),
        ("002594.SZ", "#dc2626"),
        ("300274.SZ", "#dc2626"),
        ("830001", "#dc2626"),
        ("AAPL", "#16a34a"),
        ("6000361", "#16a34a"),
    ]


def test_numeric_helpers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("-Infinity",), (None,)], "v string")
    assert [r[0] for r in df.select(to_finite("v")).collect()] == [1.5, None, None, None, None]
    row = spark.range(1).select(
        clip(F.lit(120.0), 0, 100),
        clip(F.lit(None).cast("double"), 0, 100),
        points((F.lit(True), 3), (F.lit(None).cast("boolean"), 5)),
        labels((F.lit(True), "a"), (F.lit(False), "b"), (F.lit(None).cast("boolean"), "c")),
    ).first()
    assert tuple(row) == (100.0, None, 3, ["a"])


def test_clean_bars(spark):
    cols = "symbol string, interval string, `日期` string, Date string, `开盘` string, `最高` string, `最低` string, `收盘` string, `成交量(股)` string, ingest_seq long"
    rows = [
        ("s", "1d", "2024-01-02", None, "1", "2", "0.5", "1.5", "10", 1),
        ("s", "1d", None, "2024-01-02", "1", "2", "0.5", "1.6", "11", 2),
        ("s", "1d", "2024-01-03 09:30:00+08:00", None, "1", "2", "0.5", "1.5", "10", 3),
        ("s", "1d", "2024-13-03", None, "1", "2", "0.5", "1.5", "10", 4),
        ("s", "1d", "2024-01-04", None, "1", "inf", "0.5", "1.5", "10", 5),
        ("s", "1d", "2024-01-05", None, "1", "2", "bad", "1.5", "10", 6),
        ("s", "1d", "2024-01-06", None, "1", "2", "1", "1.5", None, 7),
        ("s", "1d", "2024/1/9", None, "1", "2", "1", "1.5", "10", 8),
        ("s", "1d", "20240110", None, "1", "2", "1", "1.5", "10", 9),
        ("s", "1d", "01/11/2024 09:30", None, "1", "2", "1", "1.5", "10", 10),
        ("s", "1d", "31/01/2024", None, "1", "2", "1", "1.5", "10", 11),
        ("s", "1d", "2024-02-01", None, "1", "2", "1", "1.5d", "10", 12),
    ]
    got = clean_bars(spark.createDataFrame(rows, cols)).orderBy("ts").collect()
    assert [(r.ts, r.close, r.volume) for r in got] == [
        (dt.datetime(2024, 1, 2), 1.6, 11.0),
        (dt.datetime(2024, 1, 3, 9, 30), 1.5, 10.0),
        (dt.datetime(2024, 1, 9), 1.5, 10.0),
        (dt.datetime(2024, 1, 10), 1.5, 10.0),
        (dt.datetime(2024, 1, 11, 9, 30), 1.5, 10.0),
        (dt.datetime(2024, 1, 31), 1.5, 10.0),
    ]


def test_bars_and_weeks(spark):
    trades = spark.createDataFrame(
        [
            (1, dt.datetime(2024, 1, 5, 9, 30), 10.0, 1.0, 1),  # Friday
            (1, dt.datetime(2024, 1, 5, 15, 0), 12.0, 2.0, 2),
            (1, dt.datetime(2024, 1, 6, 9, 0), 9.0, 4.0, 3),  # Saturday opens the next week
            (1, dt.datetime(2024, 1, 8, 9, 0), 11.0, 8.0, 4),
        ],
        "s int, t timestamp_ntz, p double, q double, id int",
    )
    args = [F.col("s"), F.col("t"), F.col("p"), F.col("q"), [F.col("id")]]
    hourly = bars_from_trades(trades, *args, "60m").orderBy("ts").collect()
    assert [r.ts.hour for r in hourly] == [9, 15, 9, 9]
    daily = bars_from_trades(trades, *args)
    weekly = weekly_from_daily(daily).orderBy("ts").collect()
    assert [(r.ts, r.open, r.high, r.low, r.close, r.volume) for r in weekly] == [
        (dt.datetime(2024, 1, 5), 10.0, 12.0, 10.0, 12.0, 3.0),
        (dt.datetime(2024, 1, 12), 9.0, 11.0, 9.0, 11.0, 12.0),
    ]


def test_sources(spark, tmp_path):
    def some(symbol, interval="1d", n=3):
        return sd.bars(symbol, sd.walk(n, 1), interval=interval)

    a = spark.createDataFrame(some("A") + some("600001", "60m"), BAR_SCHEMA)
    b = spark.createDataFrame(some("B") + some("A") + some("600002", "60m"), BAR_SCHEMA)
    wanted = spark.createDataFrame(
        [("A", "1d"), ("B", "1d"), ("C", "1d"), ("600001", "60m"), ("600002", "60m")],
        "symbol string, interval string",
    )
    bars, notes = choose_source(a, wanted, b)
    assert bars.count() == 9
    assert {r.symbol: r.notes for r in notes.collect()} == {
        "A": [],
        "B": ["fell back"],
        "C": ["fell back", "no valid data"],
        "600001": [],
        "600002": ["fell back", "no hourly bars"],
    }
    bars, notes = choose_source(b, wanted)
    assert {r.symbol for r in bars.collect()} == {"A", "B"}
    assert {r.symbol: r.notes for r in notes.collect()}["600002"] == ["no hourly bars"]

    path = str(tmp_path / "bars")
    write_bars(a, path)
    assert read_table(spark, path).filter("interval = '60m'").count() == 3
    recent = scan_window(a, "1mo", F.lit("2020-01-02").cast("date"))
    assert recent.filter("interval = '1d'").count() == 2

    info = spark.createDataFrame(
        [("A", "", "Short", None, 1.0, None)],
        "symbol string, long_name string, short_name string, local_name string, pe double, pb double",
    )
    names = {r.symbol: (r.name, r.pe) for r in instrument_info(wanted, info).collect()}
    assert names["A"] == ("Short", 1.0) and names["B"] == ("B", None)


def candle(o, h, l, c, po, pc):
    return (5, o, h, l, c, po, pc)


def test_candles(spark):
    rows = [
        candle(10.0, 10.6, 8.0, 10.5, 10.0, 10.0),  # hammer
        candle(9.0, 11.0, 8.9, 10.5, 10.0, 9.5),  # engulfs a fall
        candle(10.5, 10.6, 8.0, 9.0, 9.5, 10.0),  # engulfs a rise
        candle(10.0, 10.0, 10.0, 10.0, 10.0, 10.0),
    ]
    df = spark.createDataFrame(
        rows, "pos int, open double, high double, low double, close double, prev_open double, prev_close double"
    )
    got = [r.candle_patterns for r in sig.add_candle_patterns(df).collect()]
    assert got == [["hammer"], ["bull_engulf"], ["bear_engulf"], []]


def test_row_rules(spark):
    df = spark.createDataFrame(
        [
            (10.5, 10.0, 1.3, 1.25, 10.0, 1.0, 0.5, 9.9, 9.8, 9.7, 10.4),
            (9.5, 10.0, 1.6, None, 10.0, 0.5, 0.5, 9.9, 9.8, 9.7, 10.4),
            (10.5, 10.0, 0.5, 0.5, 10.0, 0.1, 0.5, 9.7, 9.8, 9.9, None),
            (10.5, 10.0, None, None, None, None, None, None, None, None, None),
        ],
        "close double, prev_close double, vol_ratio double, vol_ratio_min3 double, ma20 double,"
        " macd double, macd_signal double, prev_ma5 double, prev_ma10 double, prev_ma20 double,"
        " prev_high20 double",
    ).selectExpr(
        "*", "30 as pos", "30 as n_bars", "12D as ma5", "11D as ma10",
        "112.5D as vol_ma5", "113.5D as vol_ma10", "cast(null as double) as vol_ma20",
    )
    got = sig.add_trade_triggers(sig.add_structured_signals(sig.add_volume_price_signals(df))).collect()
    assert [r.vp_signals for r in got] == [
        ["vol_up", "vol_up_3"],
        ["vol_down", "down_on_high_vol"],
        ["up_on_low_vol"],
        [],
    ]
    assert got[0].volume_means == "MA5=112, MA10=114, MA20=nan"  # halves go to the even number
    assert [[(s.type, s.name, round(s.strength, 2)) for s in r.structured_signals] for r in got] == [
        [("bullish", "vol_up", 0.65), ("bullish", "above_ma20", 0.7), ("bullish", "macd_golden", 0.8)],
        [("bearish", "vol_down", 0.8), ("bearish", "below_ma20", 0.7)],
        [("neutral", "up_low_vol", 0.4), ("bullish", "above_ma20", 0.7), ("bearish", "macd_dead", 0.8)],
        [("bearish", "below_ma20", 0.7)],
    ]
    assert [r.triggers for r in got] == [
        ["breakout20"],
        [],
        ["pullback_ma20", "ma_alignment"],
        [],
    ]


def test_dip_and_behavior(spark):
    df = spark.createDataFrame(
        [
            ("deep", 10.0, -5.0, 0.5, 25.0, 9.8, 0.2, 0.5, 1.5, 1.0, "concentrated", "none"),
            ("mild", 10.0, -1.9, 0.5, 25.0, 9.8, 0.2, 0.5, 1.5, 1.0, "neutral", "none"),
            ("half", 10.0, -5.0, 0.5, 35.0, 9.0, -0.2, 0.5, 1.5, 1.0, "neutral", "none"),
            ("lost", 10.0, -5.0, 1.6, 50.0, 11.0, -0.2, 0.5, 1.5, 1.0, "neutral", "top"),
            ("gain", 10.0, 5.0, 1.6, 55.0, 9.0, 0.2, 0.5, 1.5, 1.0, "neutral", "none"),
            ("calm", 10.0, 1.0, 1.0, 55.0, 9.0, 0.2, 0.5, 1.5, 1.0, "concentrated", "none"),
        ],
        "symbol string, price double, change double, vol_ratio double, rsi double, support double,"
        " cmf double, atr double, atr_mult double, macd_hist double, chip_concentration string,"
        " obv_divergence string",
    )
    got = {r.symbol: r for r in sig.add_behavior(sig.add_dip_entry(df)).collect()}
    assert {k: (r.dip.score, r.dip.action) for k, r in got.items()} == {
        "deep": (95, "active"),
        "mild": (0, "none"),
        "half": (40, "none"),
        "lost": (0, "none"),
        "gain": (0, "none"),
        "calm": (0, "none"),
    }
    assert got["deep"].dip.stop_loss == pytest.approx(9.25)
    assert got["deep"].dip.target == pytest.approx(11.125)
    assert got["deep"].dip.reason == (
        "thin volume；near support 9.80 (2.0%)；RSI=25.0 oversold；CMF positive"
    )
    assert {k: r.behavior.behavior for k, r in got.items()} == {
        "deep": "washout",
        "mild": "watch",
        "half": "watch",
        "lost": "distribution",
        "gain": "markup",
        "calm": "accumulation",
    }


def plain_levels(series):
    recent = series[-80:]
    n = len(recent)
    highs, lows = [r[4] for r in recent], [r[5] for r in recent]
    res = [highs[i] for i in range(5, n - 5) if highs[i] == max(highs[i - 5 : i + 6])]
    sup = [lows[i] for i in range(5, n - 5) if lows[i] == min(lows[i - 5 : i + 6])]
    return (
        sum(sup[-3:]) / len(sup[-3:]) if sup else min(lows[-20:]),
        sum(res[-3:]) / len(res[-3:]) if res else max(highs[-20:]),
    )


def plain_divergence(prices, values):
    pairs = [(p, x) for p, x in zip(prices[-30:], values[-30:]) if x is not None]
    if len(pairs) < 10:
        return "none"

    def pivots(pick):
        return [
            pairs[i] for i in range(2, len(pairs) - 2)
            if pairs[i][0] == pick(p for p, _ in pairs[i - 2 : i + 3])
        ][-2:]

    hi, lo = pivots(max), pivots(min)
    if len(hi) == 2 and hi[1][0] > hi[0][0] and hi[1][1] <= hi[0][1]:
        return "top"
    if len(lo) == 2 and lo[1][0] < lo[0][0] and lo[1][1] >= lo[0][1]:
        return "bottom"
    return "none"


def test_levels_divergences_and_risk(spark):
    rows = []
    for i in range(40):
        rows += sd.bars(f"w{i:02d}", sd.walk(20 + 5 * i, 100 + i), seed=i)
    rows += sd.bars("flat", [10.0] * 60, [5.0] * 60, spread=0)
    df = spark.createDataFrame(rows, BAR_SCHEMA)
    got = {r.symbol: r for r in analyze(latest_history(df, 300)).collect()}
    seen = set()
    assert len(got) == 41
    for symbol, r in got.items():
        series = [x for x in rows if x[0] == symbol]
        assert (r.support, r.resistance) == pytest.approx(plain_levels(series))
        ind = sd.compute(series)
        close = [x[6] for x in series]
        for name in ("macd", "rsi", "obv"):
            want = plain_divergence(close, [x[name] for x in ind])
            assert r[f"{name}_divergence"] == want, (symbol, name)
            seen.add(want)
        assert r.stop_loss < r.price < r.take_profit
        assert 0 < r.position_size <= 0.5 and 0 <= r.total_score <= 100
    assert seen == {"top", "bottom", "none"}
    assert got["flat"].chip_concentration == "concentrated" and got["flat"].rsi == 50.0
    assert got["flat"].atr == pytest.approx(0.2)


def test_weekly_fallback_composite_and_heatmap(spark):
    rows = sd.bars("a", sd.walk(200, 1)) + sd.bars("b", sd.walk(200, 2))
    rows += sd.bars("b", sd.walk(25, 3), interval="1wk")
    rows += sd.bars("b", sd.walk(30, 4), interval="60m")
    rows += sd.bars("c", sd.walk(15, 5))
    bars, notes = with_weekly_fallback(spark.createDataFrame(rows, BAR_SCHEMA))
    assert [r.symbol for r in notes.collect()] == ["a"]
    assert bars.filter("interval = '1wk'").groupBy("symbol").count().orderBy("symbol").collect()[1][1] == 25
    scores = scores_by_interval(latest_history(bars, bars_kept("1y"))).persist()
    s = {r.symbol: r for r in scores.collect()}
    c = {(r.symbol, r["view"]): r.composite_score
         for v in ("short", "mid_long", "ultra_short") for r in composite(scores, v).collect()}
    assert c["a", "short"] == s["a"].score_daily
    assert c["b", "short"] == pytest.approx(0.6 * s["b"].score_daily + 0.4 * s["b"].score_hourly)
    assert c["b", "ultra_short"] == pytest.approx(0.3 * s["b"].score_daily + 0.7 * s["b"].score_hourly)
    assert c["a", "mid_long"] == pytest.approx(0.7 * s["a"].score_daily + 0.3 * s["a"].score_weekly)
    assert c["c", "short"] == 0.0 and s["c"].score_daily in (15, 25)
    sectors = spark.createDataFrame([("x", "a"), ("y", "c"), ("z", None)], "sector string, symbol string")
    heat = sector_heatmap(bars, sectors).collect()
    assert [(h.sector, h.bars) for h in heat][0] == ("x", 50)
    assert {h.trend for h in heat if h.sector != "x"} == {"no_data"}


def test_deep_insight(spark):
    rows = sd.bars("a", sd.walk(200, 1)) + sd.bars("a", sd.walk(40, 2), interval="60m")
    out = deep_insight(spark.createDataFrame(rows, BAR_SCHEMA), "short", "swing",
                       as_of=F.lit("2020-07-18").cast("date"))
    row = out.analysis.first()
    assert row.mode == "swing" and row.dip.action in ("active", "cautious", "none")
    assert out.composite.first()["view"] == "short"
    assert out.signals.count() == 1 and out.notes.first().symbol == "a"
    whole, blended = out.latest.first(), out.composite.first()
    assert whole.total_score == row.total_score and whole.dip == row.dip
    assert {c: whole[c] for c in out.composite.columns} == blended.asDict()
    # a series under 20 bars has a row, but no analysis
    short = deep_insight(spark.createDataFrame(sd.bars("b", sd.walk(12, 3)), BAR_SCHEMA))
    assert short.analysis.count() == 0
    assert short.latest.first().behavior.behavior == "unknown" and short.latest.first().triggers == []


def test_fundamentals(spark):
    def q(symbol, month, item, value):
        return (symbol, dt.date(2023 + month // 12, month % 12 + 1, 1), item, value)

    rows = []
    for i, m in enumerate((2, 5, 8, 11, 14)):
        rows += [q("a", m, "Total Revenue", 10.0 + i), q("a", m, "Net Income", 1.0)]
        rows += [q("a", m, "Stockholders Equity", 50.0), q("a", m, "Total Assets", 0.0)]
        rows += [q("b", m, "Revenue", None if i == 1 else 5.0)]
    lines = fund.statement_lines(
        spark.createDataFrame(rows, "symbol string, period_end date, item string, value double")
    )
    ttm = fund.trailing_year(lines).orderBy("symbol", "period_end").collect()
    assert [(r.symbol, r.revenue) for r in ttm] == [("a", 46.0), ("a", 50.0), ("b", 15.0), ("b", 15.0)]
    assert ttm[0].roe == pytest.approx(8.0) and ttm[0].debt_ratio is None
    assert ttm[0].period_start == dt.date(2023, 3, 1) and ttm[0].period_end == dt.date(2023, 12, 1)
    figures = spark.createDataFrame(
        [("g", 1, 1.0, 5.0, 2.0), ("g", 2, 2.0, 4.0, 2.0), ("g", 3, 3.0, 6.0, 2.0),
         ("f", 1, 2.0, None, 1.0), ("f", 2, 2.0, 1.0, 3.0)],
        "symbol string, m int, revenue double, net_income double, roe double",
    ).selectExpr("*", "make_date(2024, m, 1) as period_end")
    got = {r.symbol: tuple(r)[1:] for r in fund.trend_summary(figures).collect()}
    assert got == {"g": ("growing", "unstable", "flat"), "f": ("declining", "insufficient", "up")}
    back = {r.symbol: tuple(r)[1:] for r in fund.trend_summary(figures, "reported").collect()}
    assert back == {"g": ("declining", "unstable", "flat"), "f": ("declining", "insufficient", "down")}
    wide = spark.createDataFrame([("a", "Net Income", 1.0, 2.0)], "symbol string, item string, `2024-03-31` double, `2024-06-30` double")
    assert sorted(r.value for r in fund.melt_statements(wide).collect()) == [1.0, 2.0]
    many = wide.unionByName(spark.createDataFrame([("b", "Net Income", None, 3.0), ("b", "Revenue", None, None)], wide.schema))
    of_b = [r for r in fund.melt_statements(many).collect() if r.symbol == "b"]
    assert sorted((r["item"], str(r.period_end), r.value) for r in of_b) == [("Net Income", "2024-06-30", 3.0), ("Revenue", "2024-06-30", None)]


def test_news(spark):
    rows = [("s", i, f"t{i}", 1700000000 + i, None, "u") for i in range(8)] + [("s", 99, "none", 0, "p", None)]
    news = spark.createDataFrame(rows, "symbol string, id long, title string, at long, source string, url string")
    got = latest_news(news.withColumn("published_at", epoch_to_time(F.col("at")))).orderBy("rank").collect()
    assert [r.title for r in got] == ["t7", "t6", "t5", "t4", "t3"]
    assert got[0].time == "2023-11-14 22:13" and got[0].source == ""


def test_dimensions(spark):
    assert trade_modes(spark).count() == len(TRADE_MODES) == 4
    assert views(spark).count() == 3 and sector_leaders(spark).count() == 31
    assert bars_kept("1y") == {"1d": 272, "1wk": 60, "60m": 320}
    assert bars_kept("nonsense") == bars_kept("1y") and mode_of("odd") == "short"
