"""What the physical plans must and must not hold."""

import pytest

from barframe.operators.analysis import analyze
from barframe.operators.cross import composite, scores_by_interval
from barframe.operators.indicators import full_history, latest_history
from barframe.operators.resample import with_weekly_fallback
from barframe.operators.series import tail_bars
from barframe.plans.insight import deep_insight
from barframe.schema import BAR_SCHEMA, VIEWS, bars_kept
from tests import series_data as sd


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "bars")
    rows = sd.bars("a", sd.walk(120, 1)) + sd.bars("b", sd.walk(120, 2))
    spark.createDataFrame(rows, BAR_SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
        return df._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_analysis_needs_two_exchanges(spark, bars):
    """One by series and salt for the cut, one by series for all the rest."""
    text = plan(spark, analyze(latest_history(bars, bars_kept("1y")), ["short", "trend"]))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("Exchange") == 2
    assert "WindowGroupLimit" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_python_and_no_single_partition(spark, bars):
    for df in (full_history(bars), analyze(latest_history(bars, 100))):
        text = plan(spark, df)
        for word in ("Python", "Pandas", "InArrow", "SinglePartition", "Scan ExistingRDD"):
            assert word not in text, word


def test_columns_are_pruned(spark, bars):
    text = plan(spark, full_history(bars, stateful=False).select("symbol", "ts", "ma5"))
    reads = [line for line in text.splitlines() if "ReadSchema" in line]
    assert reads and all("volume" not in r and "high" not in r for r in reads)


def test_long_history_windows_are_keyed_by_segment(spark, bars):
    text = plan(spark, full_history(bars, stateful=False))
    windows = [line for line in text.splitlines() if "Window [" in line]
    # windows over a whole series only see its table of bucket counts
    whole = [line for line in windows if ", seg#" not in line]
    assert len(windows) - len(whole) >= 5
    assert all(any(c in line for c in ("cnt#", "slot#", "opens#", "bucket#")) for line in whole), whole


def test_views_share_one_set_of_windows(spark, bars):
    scores = scores_by_interval(latest_history(bars, bars_kept("1y")))
    all_views, one = plan(spark, composite(scores, list(VIEWS))), plan(spark, composite(scores, "short"))
    for node in ("Window [", "Exchange", "FileScan"):
        assert all_views.count(node) == one.count(node) > 0, node


def test_weekly_fallback_joins_no_bars(spark, bars):
    text = plan(spark, with_weekly_fallback(bars)[0])
    assert "Join" not in text
    # daily bars by symbol and week, then weekly rows by symbol
    assert text.count("Exchange hashpartitioning") == 2


def test_insight_reads_the_bars_once(spark, bars):
    """No more scans than the bars and their weekly rollup need, and one more exchange than the analysis."""
    text, bare = plan(spark, deep_insight(bars).latest), plan(spark, with_weekly_fallback(bars)[0])
    assert text.count("FileScan") == bare.count("FileScan") > 0
    alone = plan(spark, analyze(latest_history(with_weekly_fallback(bars)[0], bars_kept("3mo"))))
    assert text.count("Exchange hashpartitioning") == alone.count("Exchange hashpartitioning") + 1
    assert text.count("Window [") > 0 and "Join" not in text


def test_notes_and_latest_make_the_weekly_rows_once(spark, bars):
    """The join of both scans no more than the last bars alone; Spark adds a filter on the joined side's symbol."""
    out = deep_insight(bars)
    text, alone = plan(spark, out.latest.join(out.notes, "symbol", "left")), plan(spark, out.latest)
    assert text.count("FileScan") == alone.count("FileScan") > 0
    assert "ReusedExchange" in text


def test_first_round_of_a_cut_keeps_what_its_interval_does(spark, bars):
    """Its own number for each interval is asked for before the bars are exchanged a second time."""
    text = plan(spark, tail_bars(bars, bars_kept("3mo")))
    first, second = text.rindex("Exchange hashpartitioning"), text.index("Exchange hashpartitioning")
    assert first > second
    assert "no number of bars to keep" in text[second:first]
