"""Windows of any length beside plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from barframe.operators.sliding import add_windows
from tests.test_plans import plan

SCHEMA = "symbol string, interval string, pos long, x double"


def panel(spark, lengths, gaps=0.0, seed=5):
    rng = random.Random(seed)
    rows = [(s, "1d", k + 1, None if rng.random() < gaps else 1e6 + rng.gauss(0, 1)) for s, n in lengths.items() for k in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("gaps, segment_rows", [(0.0, 4096), (0.3, 40), (0.95, 40)])
def test_windows_beside_loops(spark, gaps, segment_rows):
    """Windows of one bar, of some, and longer than a series; borders of blocks and segments; gaps; large means."""
    rows, df = panel(spark, {"a": 230, "b": 37, "c": 1}, gaps)
    windows = [1, 3, 10, 37, 300]
    got = add_windows(df, ["x"], windows, ("max", "min", "mean", "std", "count"), 2, segment_rows).collect()
    assert len(got) == len(rows)
    series = {s: [r[3] for r in rows if r[0] == s] for s in "abc"}
    for r in got:
        for n in windows:
            have = [v for v in series[r["symbol"]][max(0, r["pos"] - n) : r["pos"]] if v is not None]
            assert r[f"x_count{n}"] == len(have)
            if len(have) < 2:
                assert [r[f"x_{s}{n}"] for s in ("max", "min", "mean", "std")] == [None] * 4
                continue
            assert (r[f"x_max{n}"], r[f"x_min{n}"]) == (max(have), min(have))
            assert r[f"x_mean{n}"] == pytest.approx(statistics.fmean(have), rel=1e-13)
            assert r[f"x_std{n}"] == pytest.approx(statistics.stdev(have), rel=1e-6, abs=1e-9)


def test_equal_values_deviate_by_nothing_and_empty_tables_stay_empty(spark):
    df = spark.range(1, 101).selectExpr("'a' as symbol", "'1d' as interval", "id as pos", "0.1D as x", "'kept' as blk")
    got = add_windows(df, ["x"], [7, 50], ("std", "mean"))
    assert got.columns == [*df.columns, "x_std7", "x_mean7", "x_std50", "x_mean50"]
    assert got.where((F.col("pos") > 1) & ((F.col("x_std7") != 0) | (F.col("x_std50") != 0))).isEmpty()
    assert add_windows(df.limit(0), ["x"], [7]).count() == 0
    with pytest.raises(ValueError):
        add_windows(df, ["x"], [0])
    with pytest.raises(ValueError):
        add_windows(df, ["x"], [5], ("median",))


def test_all_windows_share_one_exchange_and_no_frame_has_their_length(spark):
    _, df = panel(spark, {"a": 10})
    text = plan(spark, add_windows(df, ["x"], [250, 1000], ("max", "std")))
    assert text.count("Exchange") == 1 and "Join" not in text
    # frames are running ones, or the offset of a lag
    frames = [part.split(")")[0] for part in text.split("specifiedwindowframe(RowFrame, ")[1:]]
    assert {f for f in frames if "unboundedpreceding" not in f} <= {"-249, -249", "-999, -999"}
