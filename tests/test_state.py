"""Increments, stored tables, as-of scores and running pivots: equal to the whole history at any cut."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barframe import fixtures as fx
from barframe.operators import running
from barframe.operators.analysis import analyze
from barframe.operators.asof import composite_panel, last_known
from barframe.operators.cross import composite, scores_by_interval
from barframe.operators.increments import PanelState, extend, state_of
from barframe.operators.indicators import CONTEXT, INDICATORS, full_history, latest_history
from barframe.operators.latest import GAPPED, latest_rows
from barframe.operators.pivots import add_divergences, add_levels
from barframe.operators.record_panel import analysis_panel
from barframe.operators.resample import weekly_from_daily
from barframe.operators.signals import add_behavior, add_dip_entry
from barframe.schema import BAR_SCHEMA, DAILY, HOURLY
from barframe.sources.readers import read_bars_table, save_bars_table
from tests import series_data as sd
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"
CUTS = ["1992-03-01", "1995-06-01", "1998-01-01"]
END = "2999-01-01"


def day(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("state") / "bars")
    fx.mixed_bars(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def in_order(df):
    return df.toPandas().sort_values(["symbol", "interval", "ts"]).reset_index(drop=True)


def test_increments_equal_the_whole_panel(spark, bars, tmp_path):
    """History up to the first cut, then three landings, the state written and read in between. Hourly series start later than
    the first cut, so they have no state at first."""
    some = bars.where("symbol in ('1', '2', '7') or interval = '60m'")
    want = in_order(full_history(some).where(F.col("ts") >= day(CUTS[0])))
    state, parts = state_of(some.where(F.col("ts") < day(CUTS[0])), segment_rows=50), []
    for k, (a, b) in enumerate(zip(CUTS, [*CUTS[1:], END])):
        state.write(f"{tmp_path}/{k}")
        state = PanelState.read(spark, f"{tmp_path}/{k}")
        rows, state = extend(state, some.where((F.col("ts") >= day(a)) & (F.col("ts") < day(b))))
        parts.append(rows.toPandas())
    got = pd.concat(parts).sort_values(["symbol", "interval", "ts"]).reset_index(drop=True)
    assert len(got) == len(want) > 1000
    columns = ["symbol", "interval", "ts", "pos", "close", *INDICATORS, *CONTEXT]
    pd.testing.assert_frame_equal(got[columns], want[columns], check_dtype=False, rtol=1e-9, atol=1e-9)
    whole = state_of(some)
    a, b = (s.ends.toPandas().sort_values(["symbol", "interval"]).reset_index(drop=True) for s in (state, whole))
    pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False, rtol=1e-9, atol=1e-9)
    assert state.tail.exceptAll(whole.tail).isEmpty() and whole.tail.exceptAll(state.tail).isEmpty()


def test_increment_reads_no_old_bars_and_refuses_them(spark, bars, tmp_path):
    old, new = (bars.where(F.col("interval") == DAILY).where(c) for c in (F.col("ts") < day(CUTS[1]), F.col("ts") >= day(CUTS[1])))
    state_of(old).write(str(tmp_path / "state"))
    new.write.parquet(str(tmp_path / "new"))
    state = PanelState.read(spark, str(tmp_path / "state"))
    rows, after = extend(state, spark.read.parquet(str(tmp_path / "new")))
    for df in (rows, after.ends, after.tail):
        text = plan(spark, df)
        assert "state-bars" not in text and str(tmp_path) in text and "/bars" not in text
    with pytest.raises(Exception, match="not later"):
        extend(state, old.limit(3))[0].collect()
    nothing, same = extend(state, new.limit(0))
    assert nothing.isEmpty() and same.ends.exceptAll(state.ends).isEmpty() and same.ends.count() == state.ends.count()


def test_stored_bars_need_no_exchange(spark, bars):
    """Windows over a table bucketed by symbol run where its buckets are read, of one interval's files."""
    save_bars_table(bars, "stored_bars_of_a_test", buckets=4)
    try:
        daily = read_bars_table(spark, "stored_bars_of_a_test", [DAILY])
        assert daily.exceptAll(bars.where(F.col("interval") == DAILY)).isEmpty() and daily.count() > 0
        text = plan(spark, analyze(latest_history(daily, 272), ["short"]))
        assert "Exchange" not in text and "Bucketed: true" in text
        scans = [line for line in text.splitlines() if "FileScan" in line]
        assert scans and all("PartitionFilters: [isnotnull(interval" in s or "PartitionFilters: [interval" in s for s in scans)
        assert "Exchange hashpartitioning" in plan(spark, analyze(latest_history(bars, 272), ["short"]))
    finally:
        spark.sql("DROP TABLE stored_bars_of_a_test")


def test_composite_panel_is_the_composite_as_of_each_bar(spark, bars):
    """Bars cut behind a daily one, weeks that are not over left out, give the panel's row of that day."""
    some = bars.where("symbol in ('1', 'click', 'view', 'purchase')")
    whole = some.unionByName(weekly_from_daily(some.where(F.col("interval") == DAILY)))
    views = ["short", "mid_long"]
    panel = composite_panel(whole, views).toPandas()
    assert not panel.duplicated(["symbol", "ts", "view"]).any()
    days = sorted(panel.ts.unique())
    for at in (3, 14, 40, len(days) // 2, len(days) - 1):
        end = F.lit(str(days[at] + pd.Timedelta(days=1))).cast("timestamp_ntz")
        known = F.col("ts") + F.make_dt_interval(F.lit(0), F.when(F.col("interval") == HOURLY, 1).otherwise(24)) <= end
        want = composite(scores_by_interval(latest_history(whole.where(known), 10**6)), views).toPandas()
        got = panel[panel.ts <= days[at]].sort_values("ts").groupby(["symbol", "view"]).tail(1)
        # of symbols whose daily bar is the newest one known
        today = got[got.ts == days[at]].sort_values(["symbol", "view"]).reset_index(drop=True)
        want = want[want.symbol.isin(today.symbol)].sort_values(["symbol", "view"]).reset_index(drop=True)
        assert len(today) == len(want) > 0
        pd.testing.assert_frame_equal(today[want.columns], want, check_dtype=False, rtol=1e-6, atol=1e-6)


def test_last_known_over_spans(spark):
    rows = [("a", d, k, v) for d, k, v in ((0, 0, 1), (1, 1, None), (40, 1, None), (41, 0, 2), (41, 1, None), (400, 1, None))]
    rows += [("b", 5, 1, None), ("b", 300, 0, 7), ("b", 301, 1, None)]
    df = spark.createDataFrame(rows, "k string, d int, kind int, v int").withColumn("t", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")))
    for span in (1, 7, 1000):
        found = {(r["k"], r["d"], r["kind"]): r["v"] for r in last_known(df, ["k"], ["t", "kind"], ["v"], span).collect()}
        assert found == {
            ("a", 0, 0): 1, ("a", 1, 1): 1, ("a", 40, 1): 1, ("a", 41, 0): 2, ("a", 41, 1): 2, ("a", 400, 1): 2,
            ("b", 5, 1): None, ("b", 300, 0): 7, ("b", 301, 1): 7,
        }


def test_composite_panel_makes_bars_and_weeks_once(spark):
    """Of bars that come from trades: daily ones, their weeks and the counts of both read the same exchanges."""
    bars = fx.supplier_daily(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        panel = composite_panel(bars.unionByName(weekly_from_daily(bars)), "short")
        text = plan(spark, panel)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("FileScan") == 1


def test_composite_panel_has_no_range_join(spark, bars):
    text = plan(spark, composite_panel(bars, "short"))
    assert "NestedLoop" not in text and "Cartesian" not in text and "SinglePartition" not in text


@pytest.mark.parametrize("segment_rows", [90, 4096])
def test_running_pivots_equal_the_latest_rule_at_each_cut(spark, segment_rows):
    rows = sd.bars("a", sd.walk(230, 1)) + sd.bars("b", sd.walk(130, 2)) + sd.bars("f", [5.0] * 60, [1.0] * 60, spread=0)
    df = spark.createDataFrame(rows, BAR_SCHEMA)
    panel = running.add_levels(running.add_divergences(full_history(df), segment_rows=segment_rows), segment_rows).toPandas()
    found = {(r.symbol, r.pos): r for r in panel.itertuples()}
    assert len(found) == 420
    # the bars up to each cut, as series of their own
    early = [(f"{s}@{cut}", *r[1:]) for cut in (20, 35, 79, 81, 91, 95, 119, 130, 200, 230) for s in "abf" for r in [x for x in rows if x[0] == s][:cut]]
    latest = latest_rows(latest_history(spark.createDataFrame(early, BAR_SCHEMA), 10**6))
    for r in add_levels(add_divergences(latest)).collect():
        mine = found[r["symbol"][0], r["pos"]]
        for c in ("macd_divergence", "rsi_divergence", "obv_divergence"):
            assert getattr(mine, c) == r[c], (r["symbol"], c)
        assert abs(mine.support - r["support"]) < 1e-9 and abs(mine.resistance - r["resistance"]) < 1e-9


@pytest.mark.parametrize("segment_rows", [90, 4096])
def test_analysis_panel_equals_the_analysis_at_each_cut(spark, segment_rows):
    """Walks, a flat series, one whose volume stops (its ratios stay the last known ones over segment borders) and a short one."""
    quiet = [100.0 + i % 7 if i < 60 else 0.0 for i in range(230)]
    rows = sd.bars("a", sd.walk(230, 1)) + sd.bars("q", sd.walk(230, 3), quiet) + sd.bars("f", [5.0] * 60, [1.0] * 60, spread=0) + sd.bars("s", sd.walk(12, 4))
    history = full_history(spark.createDataFrame(rows, BAR_SCHEMA))
    modes = ["short", "trend"]
    panel = add_dip_entry(add_behavior(analysis_panel(history, modes, short_series=True, segment_rows=segment_rows)))
    found = {(r["symbol"], r["n_bars"], r["mode"]): r for r in panel.collect()}
    assert len(found) == 2 * len(rows)
    early = [(f"{s}@{cut}", *r[1:]) for cut in (5, 12, 19, 20, 29, 30, 60, 91, 119, 170, 230) for s in "aqfs" for r in [x for x in rows if x[0] == s][:cut]]
    latest = analyze(latest_history(spark.createDataFrame(early, BAR_SCHEMA), 10**6), modes, short_series=True)
    checked = 0
    for r in add_dip_entry(add_behavior(latest)).collect():
        mine = found[r["symbol"][0], r["n_bars"], r["mode"]]
        for c in panel.columns:
            if c == "symbol":
                continue
            if isinstance(r[c], float):
                assert mine[c] == pytest.approx(r[c], rel=1e-7, abs=1e-9), (r["symbol"], c)
            elif c != "dip":
                assert mine[c] == r[c], (r["symbol"], c)
        assert (mine["dip"]["action"], mine["dip"]["score"]) == (r["dip"]["action"], r["dip"]["score"])
        checked += 1
    assert checked == 2 * len({e[0] for e in early})


def test_patterns_of_every_bar_share_one_exchange(spark, bars):
    """Over a table that is read, all of them run on the one exchange by segment."""
    spark.createDataFrame([], full_history(bars).schema).write.mode("overwrite").saveAsTable("panel_of_a_test")
    try:
        text = plan(spark, running.add_patterns(spark.table("panel_of_a_test")))
        assert text.count("Exchange") == text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    finally:
        spark.sql("DROP TABLE panel_of_a_test")


def test_known_values_of_the_history_equal_the_as_of_join(spark):
    """Long gaps over the history's own segments: the last known values come along from however far back."""
    quiet = [100.0 + i % 7 if i < 60 else 0.0 for i in range(230)]
    flat = [*sd.walk(60, 5), *[7.0] * 170]
    rows = sd.bars("a", sd.walk(230, 1)) + sd.bars("q", sd.walk(230, 3), quiet) + sd.bars("f", flat, spread=0) + sd.bars("s", sd.walk(12, 4))
    df = spark.createDataFrame(rows, BAR_SCHEMA)
    known = [f"known_{c}" for c in GAPPED]
    plain = full_history(df, segment_rows=40)
    want = last_known(plain.withColumns({f"known_{c}": F.col(c) for c in GAPPED}), ["symbol", "interval"], ["ts"], known)
    got = full_history(df, segment_rows=40, known=GAPPED)
    want, got = (x.select("symbol", "pos", *known).orderBy("symbol", "pos").toPandas() for x in (want, got))
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)
    assert (got.known_vol_ratio.notna() & plain.orderBy("symbol", "pos").toPandas().vol_ratio.isna()).any()


def test_series_of_one_segment_keep_the_exchange_of_their_indicators(spark, bars):
    """Their levels and patterns run on it; only the panel's rows of longer series are dealt anew."""
    text = plan(spark, analysis_panel(full_history(bars, known=GAPPED), ["short"]))
    windows = [line for line in text.splitlines() if "Window [" in line and "_mid_low" in line]
    assert len(windows) == 2
    assert ", seg#" in windows[0] and "_part#" not in windows[0].split("], [")[1]
    assert "_part#" in windows[1]


def test_record_of_single_and_several_segments_equals_the_plain_panel(spark):
    """Series of one, just one, two and three segments of the history."""
    quiet = [100.0 + i % 7 if i < 60 else 0.0 for i in range(230)]
    rows = sd.bars("a", sd.walk(130, 1)) + sd.bars("e", sd.walk(100, 6)) + sd.bars("q", sd.walk(230, 3), quiet) + sd.bars("s", sd.walk(12, 4))
    df = spark.createDataFrame(rows, BAR_SCHEMA)
    history = full_history(df, segment_rows=100, known=GAPPED)
    parts = {(r["symbol"], r["whole"]) for r in history.select("symbol", "whole").distinct().collect()}
    assert parts == {("a", False), ("e", True), ("q", False), ("s", True)}
    got, want = (
        add_dip_entry(add_behavior(analysis_panel(h, ["short", "trend"], short_series=True, segment_rows=n))).orderBy("symbol", "n_bars", "mode").toPandas()
        for h, n in ((history, 90), (full_history(df), 4096))
    )
    assert len(got) == 2 * len(rows) and list(got.columns) == list(want.columns)
    numbers = list(want.select_dtypes("number").columns)
    pd.testing.assert_frame_equal(got[numbers], want[numbers], rtol=1e-9, atol=1e-9)
    rest = [c for c in want.columns if c not in numbers and c != "dip"]
    pd.testing.assert_frame_equal(got[rest].astype(str), want[rest].astype(str))


@pytest.mark.parametrize("known", [None, GAPPED])
def test_short_series_dealt_whole_equal_the_plain_history(spark, known):
    """Series of one, just one, two and six segments, of two intervals; bars without a symbol or a time are left out."""
    rows = sd.bars("a", sd.walk(230, 1)) + sd.bars("b", sd.walk(41, 2)) + sd.bars("e", sd.walk(40, 6)) + sd.bars("s", sd.walk(12, 4)) + sd.bars("a", sd.walk(60, 5), interval="60m")
    nullable = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BAR_SCHEMA)
    df = spark.createDataFrame(rows + [(None, *rows[0][1:]), (*rows[0][:2], None, *rows[0][3:])], nullable)
    want = in_order(full_history(df, segment_rows=40, block=16))
    got = in_order(full_history(df, segment_rows=40, block=16, split=True, known=known))
    assert len(got) == len(want) == len(rows)
    columns = ["symbol", "interval", "ts", "pos", "n_bars", "close", *INDICATORS, *CONTEXT]
    pd.testing.assert_frame_equal(got[columns], want[columns], rtol=1e-12, atol=1e-12)


def test_short_series_are_exchanged_once(spark, bars):
    """Between the bars and their record there is one exchange of them, for long series too; only the latter are dealt again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # of a table, and of trades: whether the interval is a column or the same for all, bars are made and dealt once
        for given, scans in ((bars, 2), (fx.supplier_daily(spark, SF), 1), (fx.mixed_bars(spark, SF), 3)):
            for df in (full_history(given, known=GAPPED), full_history(given, split=True)):
                text = plan(spark, df)
                made = [line for line in text.splitlines() if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]
                assert len(made) == 1 and text.count("FileScan") == scans
        only_short = plan(spark, full_history(bars, known=GAPPED).where("whole"))
        # by bucket and by series for the list of long ones, and the bars
        assert only_short.count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bars_and_panels_are_computed_once(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = sd.bars("a", sd.walk(60, 1)) + sd.bars("a", sd.walk(60, 2), interval="60m")
    spark.createDataFrame(rows, BAR_SCHEMA).write.parquet(path)
    bars = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # counts by bucket, and the bars of all and of long series by one exchange
        assert plan(spark, full_history(bars)).count("FileScan") == 2
        assert plan(spark, analysis_panel(full_history(bars, known=GAPPED), ["short"])).count("FileScan") == 2
        # rows and what their spans leave behind come from one exchange
        assert plan(spark, composite_panel(bars, "short")).count("FileScan") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
