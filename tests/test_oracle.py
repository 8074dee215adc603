"""Every query with a DuckDB counterpart gives the same rows."""

import pytest

import __spark_entry__ as entry
from tests.check_oracle import differences, duck

SF_DIR = "/root/testdata/sf0.001"
# one of each family; tests/check_oracle.py runs them all
NAMES = [
    "clean_bars",
    "rejected_bars",
    "ticker_normalize",
    "source_fallback",
    "source_notes",
    "instrument_info",
    "weekly_fallback",
    "stored_bars",
    "bars_tail",
    "scan_window",
    "scan_windows",
    "volume_ratio",
    "obv",
    "macd",
    "flat_bars",
    "panel_increment",
    "divergence_panel",
    "levels_panel",
    "behavior_panel",
    "dip_entry_panel",
    "risk_panel",
    "long_windows",
    "score_panel",
    "structured_signals",
    "triggers",
    "score_short",
    "analysis",
    "dip_entry",
    "dip_entry_short",
    "behavior_short",
    "composite",
    "composite_panel",
    "insight_short",
    "sector_heatmap",
    "fundamental_ttm",
    "fundamental_wide",
    "fundamental_summary",
    "fundamental_reported",
    "news_top5",
    "score_vector",
    "chart_feed",
    "report_context",
    "report_full",
    "vp_signals",
    "vp_texts",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(got) > 0
    assert differences(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {n for n in entry.queries() if n not in entry.CORPUS_QUERIES}
    assert own <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_short_and_long_series_at_every_size(spark, sf):
    d = f"/root/testdata/sf{sf}"
    con = duck(d)
    for name, short in (("score_cuts", "n_bars < 20"), ("behavior_cuts", "behavior = 'unknown'"), ("dip_entry_cuts", "reason = 'insufficient data'")):
        rows = entry.queries()[name](spark, d)
        assert differences(rows.toPandas(), con.execute(entry.oracle_sql()[name]).df()) is None, name
        symbols = rows.select("symbol").distinct().count()
        assert symbols == 100 and rows.where(short).select("symbol").distinct().count() == 50, name


def test_each_raw_row_is_clean_or_rejected(spark):
    """A row with several faults is one reject; a repeated good row beside a later one is superseded."""
    from barframe.operators.clean import clean_bars, rejected_bars

    good = ("a", "1d", "2024-01-02", "1", "2", "1", "1.5", "10")
    rows = [(*good, 1), (*good, 2), ("a", "1d", "soon", "x", "2", "1", "1", "1", 3), ("b", "1d", None, "1", "2", "1", "NaN", "1", 1)]
    raw = spark.createDataFrame(rows, "symbol string, interval string, Date string, Open string, high string, low string, close string, volume string, ingest_seq long")
    out = rejected_bars(raw)
    assert sorted((r["ingest_seq"], r["reason"]) for r in out.collect()) == [(1, "date|close"), (1, "superseded"), (3, "date|open")]
    assert clean_bars(raw).count() + out.count() == len(rows)
    assert rejected_bars(raw.limit(0)).count() == 0
