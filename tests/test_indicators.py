import math
import random

import pytest
from pyspark.sql import functions as F

from barframe.functions.rolling import exponential_mean, rolling
from barframe.operators.indicators import INDICATORS, full_history, latest_history
from barframe.operators.series import segment_frame, tail_bars, tail_frame, top_per_key
from barframe.schema import BAR_SCHEMA
from tests import series_data as sd


@pytest.fixture(scope="module")
def rows():
    return sd.catalogue()


@pytest.fixture(scope="module")
def frame(spark, rows):
    mixed = list(rows)
    random.Random(3).shuffle(mixed)
    return spark.createDataFrame(mixed, BAR_SCHEMA)


def by_series(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), []).append(r)
    return {k: sorted(v, key=lambda r: r[2]) for k, v in out.items()}


def close(a, b, scale):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= 1e-9 * max(scale, abs(b))


def check(result, expected):
    got = {(r["symbol"], r["interval"], r["ts"]): r for r in result.collect()}
    assert len(got) == sum(len(v) for v in expected.values())
    wrong = []
    for (symbol, interval), want in expected.items():
        for w in want:
            g = got[(symbol, interval, w["ts"])]
            for c in INDICATORS:
                x = g[c]
                assert x is None or math.isfinite(x)
                scale = 1e4 if c == "obv_ma20" else 100.0
                if not close(x, w[c], scale):
                    wrong.append((symbol, interval, w["ts"], c, x, w[c]))
    assert not wrong, wrong[:5]


def test_full_history_against_plain_loops(frame, rows):
    expected = {k: sd.compute(v) for k, v in by_series(rows).items()}
    check(full_history(frame), expected)


def test_small_segments_give_the_same(frame, rows):
    """Series cut into many segments and blocks: state and lead-in must be handed on exactly."""
    expected = {k: sd.compute(v) for k, v in by_series(rows).items()}
    check(full_history(frame, segment_rows=200, block=32), expected)


def test_cut_comes_before_indicators(frame, rows):
    expected = {k: sd.compute(v[-100:]) for k, v in by_series(rows).items()}
    check(latest_history(frame, 100, salts=3), expected)


def test_unmoving_price_is_exact(frame):
    flat = latest_history(frame, 500).filter("symbol = 'flat' and pos > 60").agg(
        F.max(F.abs(F.col("ma20") - F.col("close"))),
        F.max(F.abs("macd")),
        F.max(F.abs("macd_signal")),
        F.count("rsi"),
        F.count("plus_di"),
        F.max("vol_ratio_high"),
    )
    assert tuple(flat.first()) == (0.0, 0.0, 0.0, 0, 0, 1.0)


def test_segments_are_bounded_and_whole(frame, rows):
    seg = segment_frame(frame, rows=200, lead_in=160)
    assert seg.filter("step > 0").count() == len(rows)
    assert seg.filter("step > 0").select("symbol", "interval", "pos").distinct().count() == len(rows)
    most = seg.groupBy("symbol", "interval", "seg").count().agg(F.max("count")).first()[0]
    assert most <= 200 + 160 + 2 * 64
    short = seg.filter("step <= 0").groupBy("symbol", "interval", "seg").count()
    starts = seg.filter("step = 1 and seg > 0").select("symbol", "interval", "seg", "pos")
    lacking = starts.join(short, ["symbol", "interval", "seg"], "left").filter(
        "coalesce(count, 0) < least(160, pos - 1)"
    )
    assert lacking.count() == 0


def test_tail_keeps_the_last(frame, rows):
    got = {(r.symbol, r.interval): r.n for r in
           tail_bars(frame, {"1d": 25, "1wk": 7}).groupBy("symbol", "interval").agg(F.count("*").alias("n")).collect()}
    for key, series in by_series(rows).items():
        assert got[key] == min(len(series), 7 if key[1] == "1wk" else 25)


def test_top_per_key_with_a_hot_key(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id) as k", "id")
    top = top_per_key(df, ["k"], [F.desc("id")], 4, ["id"], salts=5).filter("k = 0").collect()
    assert sorted(r.id for r in top) == [4989, 4992, 4995, 4998]
    assert sorted(r["rank"] for r in top) == [1, 2, 3, 4]


def test_helpers(spark):
    rows = sd.bars("s", sd.walk(1200, 9))
    df = tail_frame(spark.createDataFrame(rows, BAR_SCHEMA), 5000).withColumn(
        "x", F.when(F.col("pos") > 3, F.col("close"))
    )
    df = df.withColumn("std5", rolling(F.stddev_samp, "x", 5, 3))
    got = exponential_mean(df, "x", "y", 0.3, 4).orderBy("pos").collect()
    want = sd.ewm([None] * 3 + [r[6] for r in rows][3:], 0.3)
    assert [g.y is None for g in got[:8]] == [True] * 6 + [False] * 2
    assert max(abs(g.y - w) for g, w in zip(got[6:], want[6:])) < 1e-10
    assert got[4].std5 is None and got[5].std5 is not None
