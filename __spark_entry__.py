
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barframe import fixtures as fx
from barframe.functions.tickers import market_colors, normalize_ticker
from barframe.operators import fundamentals as fund
from barframe.operators import outputs as out
from barframe.operators import running
from barframe.operators import signals as sig
from barframe.operators.analysis import analyze, pattern_record
from barframe.operators.asof import composite_panel
from barframe.operators.clean import clean_bars, rejected_bars
from barframe.operators.cross import composite, last_bars, scores_by_interval, sector_heatmap
from barframe.operators.increments import extend, state_of
from barframe.operators.indicators import full_history, latest_history
from barframe.operators.latest import GAPPED
from barframe.operators.news import latest_news
from barframe.operators.record_panel import analysis_panel
from barframe.operators.resample import weekly_from_daily, with_weekly_fallback
from barframe.operators.scoring import add_score
from barframe.operators.series import tail_bars
from barframe.operators.sliding import add_windows
from barframe.plans.insight import deep_insight, top_scores
from barframe.schema import BAR, DAILY, HOURLY, TRADE_MODES, VIEWS, bars_kept
from barframe.sources.fallback import choose_source, instrument_info, merge_notes
from barframe.sources.readers import read_bars_table, save_bars_table, scan_window, scan_windows
from oracle_queries import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

MODES = list(TRADE_MODES)
PERIOD = "1y"


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as the oracle gives them: doubles to 4 places, times and arrays as text.

    Halves are rounded up by the same steps as in the oracle, so equal doubles give equal results.
    """
    forms = {
        "double": "floor({0} * 10000D + 0.5D) / 10000D as {0}",
        "int": "cast({0} as bigint) as {0}",
        "timestamp_ntz": "date_format({0}, 'yyyy-MM-dd HH:mm:ss') as {0}",
        "date": "date_format({0}, 'yyyy-MM-dd') as {0}",
        "array<string>": "array_join({0}, '|') as {0}",
    }
    kinds = dict(df.dtypes)
    return df.selectExpr(*[forms.get(kinds[c], "{0}").format(c) for c in columns or df.columns])


def entry(spark: SparkSession) -> DataFrame:
    return top_scores(fx.supplier_daily(spark, "/root/testdata/sf0.001"), PERIOD)


# --- sources, cleaning, bars ------------------------------------------------


def q_clean_bars(spark, d):
    return shown(clean_bars(fx.raw_event_rows(spark, d)), *BAR)


def q_rejected_bars(spark, d):
    """The raw rows that cleaning leaves out, each with its reason."""
    return rejected_bars(fx.raw_event_rows(spark, d)).select("symbol", "interval", "date", "ingest_seq", "reason")


def q_ticker_normalize(spark, d):
    codes = fx.supplier_codes(spark, d)
    return codes.select(
        "symbol",
        normalize_ticker("ticker").alias("ticker"),
        market_colors("ticker")["up"].alias("up_color"),
        market_colors("ticker")["down"].alias("down_color"),
    )


def _two_sources(spark, d):
    """Suppliers by turn are in the first source, the second, both or neither.

    Wanted are daily bars of all and hourly bars of the coded ones.
    """
    bars = fx.supplier_daily(spark, d)
    turn = F.pmod(F.col("symbol").cast("bigint"), F.lit(4))
    requested = fx.supplier_codes(spark, d).select("symbol", F.lit(DAILY).alias("interval")).unionByName(
        fx.supplier_codes(spark, d).select(F.trim("ticker").alias("symbol"), F.lit(HOURLY).alias("interval"))
    )
    second = bars.withColumn("volume", F.col("volume") * 2)
    return choose_source(bars.filter(turn.isin(0, 2)), requested, second.filter(turn.isin(1, 2)))


def q_source_fallback(spark, d):
    return shown(_two_sources(spark, d)[0], *BAR)


def q_source_notes(spark, d):
    return shown(_two_sources(spark, d)[1])


def q_notes(spark, d):
    """Notes of both intervals, and of the weekly bars made from the daily ones."""
    bars, notes = _two_sources(spark, d)
    _, weekly = with_weekly_fallback(bars)
    return shown(merge_notes(notes, weekly))


def q_instrument_info(spark, d):
    codes = fx.supplier_codes(spark, d)
    return shown(instrument_info(codes.select("symbol"), codes))


def q_daily_bars(spark, d):
    return shown(fx.supplier_daily(spark, d))


def q_nation_bars(spark, d):
    return shown(fx.nation_daily(spark, d))


def q_hourly_bars(spark, d):
    return shown(fx.event_bars(spark, d))


def q_weekly_bars(spark, d):
    return shown(weekly_from_daily(fx.supplier_daily(spark, d)))


def q_weekly_fallback(spark, d):
    daily = fx.supplier_daily(spark, d)
    native = weekly_from_daily(daily).withColumn("volume", F.col("volume") + 1)
    even = F.pmod(F.col("symbol").cast("bigint"), F.lit(2)) == 0
    bars, _ = with_weekly_fallback(daily.unionByName(native.filter(even)))
    return shown(bars)


def q_bars_tail(spark, d):
    return shown(tail_bars(fx.mixed_bars(spark, d), bars_kept("3mo")))


def q_scan_window(spark, d):
    return shown(scan_window(fx.mixed_bars(spark, d), "1y", F.lit("2001-06-30").cast("date")))


def q_scan_windows(spark, d):
    """Three months of every supplier's bars, up to the day of its dearest line."""
    return shown(scan_windows(fx.supplier_daily(spark, d), fx.supplier_days(spark, d), "3mo"), *BAR, "as_of")


def q_stored_bars(spark, d):
    """All bars by way of a bucketed table of the catalog, read back by interval."""
    name = f"bars_{uuid.uuid4().hex}"
    save_bars_table(fx.mixed_bars(spark, d), name, buckets=8)
    return shown(read_bars_table(spark, name, [DAILY, HOURLY]))


# --- indicators over all bars -----------------------------------------------


def _panel(*columns: str, stateful: bool = False, bars=fx.supplier_daily) -> Query:
    def query(spark, d):
        return shown(full_history(bars(spark, d), stateful), "symbol", "ts", *columns)

    return query


def q_long_windows(spark, d):
    """Extremes, mean and deviation over the last 250 and 1,000 daily bars of every nation."""
    panel = full_history(fx.nation_daily(spark, d), False).select("symbol", "interval", "ts", "pos", "high", "low", "close")
    rows = add_windows(panel, ["high", "low", "close"], [250, 1000], ("max", "min", "mean", "std"), min_periods=20)
    # means of cents lie on halves of the last place shown; the close's ratio to them does not
    rows = rows.withColumns({f"close_to_mean{n}": F.col("close") / F.col(f"close_mean{n}") for n in (250, 1000)})
    return shown(rows, "symbol", "ts", *[f"{c}{n}" for n in (250, 1000) for c in ("high_max", "low_min", "close_std", "close_to_mean")])


def q_score_panel(spark, d):
    panel = full_history(fx.supplier_daily(spark, d))
    return shown(add_score(panel), "symbol", "ts", "score")


#: Bars from this day on have landed after a state was made of the earlier ones.
LANDED = "1997-06-01"


def q_panel_increment(spark, d):
    """Indicators of the bars that landed last, from the state of all earlier ones."""
    bars = fx.supplier_daily(spark, d)
    landed = F.col("ts") >= F.lit(LANDED).cast("timestamp_ntz")
    rows, _ = extend(state_of(bars.where(~landed)), bars.where(landed))
    return shown(rows, "symbol", "ts", "pos", "ma120", "vol_ratio_high", "adx", "mfi", "obv", "obv_ma20", "rsi", "macd", "macd_signal", "macd_hist")


def q_candle_patterns(spark, d):
    panel = full_history(fx.supplier_daily(spark, d), False)
    return shown(sig.add_candle_patterns(panel), "symbol", "ts", "candle_patterns")


def q_vp_signals(spark, d):
    panel = full_history(fx.supplier_daily(spark, d), False)
    return shown(sig.add_volume_price_signals(panel), "symbol", "ts", "vp_signals", "volume_means")


def q_vp_texts(spark, d):
    """Volume-price signals in words, with change and ratio, of every daily bar."""
    panel = full_history(fx.supplier_daily(spark, d), False)
    return shown(sig.add_volume_price_texts(sig.add_volume_price_signals(panel)), "symbol", "ts", "vp_texts")


def q_triggers(spark, d):
    panel = full_history(fx.supplier_daily(spark, d), False)
    return shown(sig.add_trade_triggers(panel), "symbol", "ts", "triggers")


def q_structured_signals(spark, d):
    panel = sig.add_structured_signals(full_history(fx.supplier_daily(spark, d)))
    signals = panel.select("symbol", "ts", F.posexplode("structured_signals").alias("place", "s"))
    return shown(signals.select("symbol", "ts", "place", "s.type", "s.name", "s.strength"))


def q_divergence_panel(spark, d):
    """Divergences of every daily bar of every supplier."""
    panel = running.add_divergences(full_history(fx.supplier_daily(spark, d)))
    return shown(panel, "symbol", "ts", "macd_divergence", "rsi_divergence", "obv_divergence")


def q_levels_panel(spark, d):
    """Support and resistance of every daily bar of every supplier."""
    return shown(running.add_levels(full_history(fx.supplier_daily(spark, d), False)), "symbol", "ts", "support", "resistance")


def _record_panel(spark, d, modes=MODES):
    return analysis_panel(full_history(fx.supplier_daily(spark, d), known=GAPPED), modes, short_series=True)


def q_behavior_panel(spark, d):
    """Big-money behaviour as of every daily bar of every supplier."""
    a = sig.add_behavior(_record_panel(spark, d, ["short"]))
    return shown(a.select("symbol", "ts", "behavior.behavior", "behavior.confidence"))


def q_dip_entry_panel(spark, d):
    """Dip entry as of every daily bar of every supplier, by all trade modes."""
    return shown(sig.add_dip_entry(_record_panel(spark, d)).select("symbol", "ts", "mode", "dip.*"))


def q_risk_panel(spark, d):
    """Scores, stop, target and position size as of every daily bar from a supplier's 20th on."""
    a = analysis_panel(full_history(fx.supplier_daily(spark, d), known=GAPPED), MODES)
    return shown(
        a, *"symbol ts mode trend status total_score stop_loss take_profit risk_reward position_size".split(),
        *"chip_concentration price_patterns candle_patterns vp_signals rsi adx".split(),
    )


# --- latest bar -------------------------------------------------------------


def _history(spark, d, bars=fx.supplier_daily):
    return latest_history(bars(spark, d), bars_kept(PERIOD))


def _pattern(*columns: str, bars=fx.supplier_daily) -> Query:
    def query(spark, d):
        return shown(pattern_record(_history(spark, d, bars)), "symbol", *columns)

    return query


def q_score_latest(spark, d):
    return shown(
        add_score(last_bars(_history(spark, d, fx.nation_daily))), "symbol", "ts", "n_bars", "score"
    )


def q_score_short(spark, d):
    """Nations early on: series below 10, below 20 and above 20 bars."""
    early = fx.nation_daily(spark, d).filter(F.col("ts") < F.lit("1995-03-01").cast("timestamp_ntz"))
    return shown(add_score(last_bars(latest_history(early, bars_kept(PERIOD)))), "symbol", "n_bars", "score")


def _nation_cuts(spark, d):
    """All bars of every nation, as of its own 5th, 15th, 25th and last bar: short and long series at every size.

    A nation has at most one bar a day, so the window is bounded by the calendar.
    """
    numbered = fx.nation_daily(spark, d).withColumn("bar", F.row_number().over(Window.partitionBy("symbol", "interval").orderBy("ts")))
    cuts = F.array(*[F.struct(F.lit(str(n or "last")).alias("name"), F.lit(n).cast("int").alias("n")) for n in (5, 15, 25, None)])
    each = numbered.withColumn("cut", F.explode(cuts)).where("cut.n is null or bar <= cut.n")
    return each.withColumn("symbol", F.concat_ws("@", "symbol", "cut.name")).drop("bar", "cut")


def q_score_cuts(spark, d):
    history = latest_history(_nation_cuts(spark, d), bars_kept(PERIOD))
    return shown(add_score(last_bars(history)), "symbol", "n_bars", "score")


def _analysis(spark, d, modes=MODES):
    info = fx.supplier_codes(spark, d).select("symbol", "pe", "pb")
    return analyze(_history(spark, d), modes, info)


def q_analysis(spark, d):
    a = _analysis(spark, d)
    texts = ["volume_means", "vpa_detail", "money_detail", "advice", "interval"]
    return shown(a.drop(*texts))


def q_analysis_text(spark, d):
    return shown(_analysis(spark, d), "symbol", "mode", "vpa_detail", "money_detail", "advice")


def q_behavior(spark, d):
    a = sig.add_behavior(_analysis(spark, d, ["short"]))
    return shown(a.select("symbol", "behavior.behavior", "behavior.confidence"))


def q_dip_entry(spark, d):
    return shown(sig.add_dip_entry(_analysis(spark, d)).select("symbol", "mode", "dip.*"))


def _early_analysis(spark, d, modes):
    """Nations early on, those with less than 20 bars too."""
    early = fx.nation_daily(spark, d).filter(F.col("ts") < F.lit("1995-03-01").cast("timestamp_ntz"))
    return analyze(latest_history(early, bars_kept(PERIOD)), modes, short_series=True)


def q_behavior_short(spark, d):
    a = sig.add_behavior(_early_analysis(spark, d, ["short"]))
    return shown(a.select("symbol", "behavior.behavior", "behavior.confidence"))


def q_dip_entry_short(spark, d):
    return shown(sig.add_dip_entry(_early_analysis(spark, d, MODES)).select("symbol", "mode", "dip.*"))


def _cut_analysis(spark, d, modes):
    return analyze(latest_history(_nation_cuts(spark, d), bars_kept(PERIOD)), modes, short_series=True)


def q_behavior_cuts(spark, d):
    a = sig.add_behavior(_cut_analysis(spark, d, ["short"]))
    return shown(a.select("symbol", "behavior.behavior", "behavior.confidence"))


def q_dip_entry_cuts(spark, d):
    return shown(sig.add_dip_entry(_cut_analysis(spark, d, MODES)).select("symbol", "mode", "dip.*"))


# --- across intervals and symbols -------------------------------------------


def q_composite(spark, d):
    bars, _ = with_weekly_fallback(fx.mixed_bars(spark, d))
    history = latest_history(bars, bars_kept(PERIOD))
    return shown(composite(scores_by_interval(history), list(VIEWS)))


def q_composite_panel(spark, d):
    """The blended score as of every daily bar of suppliers and event types, by all views."""
    bars = fx.mixed_bars(spark, d)
    weeks = weekly_from_daily(bars.where(F.col("interval") == DAILY))
    return shown(composite_panel(bars.unionByName(weeks), list(VIEWS)))


INSIGHT_MODES = {"ultra_short": "ultra_short", "short": "short", "mid_long": "trend"}


def _insight(view: str) -> Query:
    """The whole flow for every symbol with daily bars: record, signals, blended score and note."""

    def query(spark, d):
        info = fx.supplier_codes(spark, d).select("symbol", "pe", "pb")
        out = deep_insight(fx.mixed_bars(spark, d), view, INSIGHT_MODES[view], instruments=info)
        return shown(
            out.latest.join(out.notes, "symbol", "left").selectExpr(
                *"symbol view mode ts total_score status trend price stop_loss take_profit".split(),
                "behavior.behavior as behavior",
                "dip.score as dip_score",
                "dip.action as dip_action",
                "triggers",
                "transform(structured_signals, s -> s.name) as signals",
                *"score_daily score_weekly score_hourly composite_score note".split(),
            )
        )

    return query


def q_sector_heatmap(spark, d):
    return shown(sector_heatmap(fx.supplier_daily(spark, d), fx.nation_sectors(spark, d)))


# --- fundamentals and news --------------------------------------------------


def _ttm(spark, d, last_n=None):
    return fund.trailing_year(fund.statement_lines(fx.supplier_statements(spark, d)), last_n)


def q_fundamental_ttm(spark, d):
    return shown(_ttm(spark, d).drop("gross_margin"))


def q_fundamental_wide(spark, d):
    """Trailing-year figures of statements that come as items by periods."""
    lines = fund.statement_lines(fund.melt_statements(fx.wide_statements(spark, d)))
    return shown(fund.trailing_year(lines).drop("gross_margin"))


def q_fundamental_reported(spark, d):
    lines = fund.statement_lines(fx.supplier_statements(spark, d))
    share = "try_divide({}, {}) * 100D as {}"  # there is no gross margin: it comes out null
    reports = lines.selectExpr(
        "symbol",
        "period_end as period",
        "revenue",
        "net_income",
        share.format("net_income", "equity", "roe"),
        share.format("liabilities", "assets", "debt_ratio"),
    )
    return shown(fund.reported_figures(reports))


def q_fundamental_summary(spark, d):
    figures = _ttm(spark, d, 4)
    chronological = fund.trend_summary(figures).withColumn("order", F.lit("chronological"))
    return chronological.unionByName(
        fund.trend_summary(figures, "reported").withColumn("order", F.lit("reported"))
    )


def q_fundamental_text(spark, d):
    return fund.figures_text(_ttm(spark, d, 4))


def q_news_top5(spark, d):
    return shown(latest_news(fx.event_news(spark, d)))


# --- output tables ----------------------------------------------------------


def _output(make) -> Query:
    def query(spark, d):
        return shown(make(_analysis(spark, d)).drop("interval"))

    return query


def q_chart_feed(spark, d):
    return shown(out.chart_feed(_history(spark, d), "3mo").drop("interval"))


def q_hourly_chart_feed(spark, d):
    return shown(out.hourly_chart_feed(_history(spark, d, fx.event_bars)).drop("interval"))


def q_report_context(spark, d):
    """Of event types, whose news bear the same symbols; fields read back from the text."""
    history = _history(spark, d, lambda spark, d: fx.event_bars(spark, d, DAILY))
    context = out.report_context(analyze(history, MODES), news=latest_news(fx.event_news(spark, d)))
    whole = ("total_score",)
    doubles = ("price", "stop_loss", "take_profit")

    def field(path: str):
        return F.get_json_object("context", f"$.{path}")

    return shown(
        context.select(
            "symbol",
            "mode",
            *[field(f"analysis.{c}").alias(c) for c in ("trend", "status", "rsi_status")],
            *[field(f"analysis.{c}").cast("bigint").alias(c) for c in whole],
            *[field(f"analysis.{c}").cast("double").alias(c) for c in doubles],
            F.json_array_length(field("news")).alias("n_news"),
            field("news[0].title").alias("first_title"),
            field("news[0].time").alias("first_time"),
        )
    )


def q_report_full(spark, d):
    """The context of the short view in full, for suppliers and event types: record, view, scores, hourly and weekly readings, name, four
    periods of figures, their trend, and news; fields read back from the text."""
    info = instrument_info(fx.supplier_codes(spark, d).select("symbol"), fx.supplier_codes(spark, d))
    latest = deep_insight(fx.mixed_bars(spark, d), "short", "short", instruments=info).latest
    figures = _ttm(spark, d, 4)
    context = out.report_context(
        latest,
        fundamentals=fund.figures_text(figures),
        news=latest_news(fx.event_news(spark, d)),
        names=info,
        trend=fund.trend_summary(figures, "reported"),
    )

    def field(path: str, kind: str = "string"):
        return F.get_json_object("context", f"$.{path}").cast(kind).alias(path.split(".")[-1])

    doubles = "price stop_loss take_profit composite_score hourly_close hourly_vol_ratio weekly_close weekly_ma20".split()
    return shown(
        context.select(
            "symbol",
            "mode",
            *[field(f"analysis.{c}") for c in ("view", "trend", "status")],
            *[field(f"analysis.{c}", "bigint") for c in ("total_score", "score_daily", "score_weekly", "score_hourly")],
            *[field(f"analysis.{c}", "double") for c in doubles],
            field("instrument.name"),
            *[field(f"trend.{c}") for c in ("revenue_trend", "net_income_trend", "roe_trend")],
            F.json_array_length(F.get_json_object("context", "$.fundamentals")).cast("bigint").alias("n_periods"),
            field("fundamentals[0].period").alias("first_period"),
            field("fundamentals[0].revenue").alias("first_revenue"),
            F.json_array_length(F.get_json_object("context", "$.news")).cast("bigint").alias("n_news"),
            field("news[0].title").alias("first_title"),
        )
    )


def q_top_scores(spark, d):
    return shown(top_scores(fx.supplier_daily(spark, d), PERIOD))


try:  # the corpus operators are a part of their own, which may be absent
    from barframe.llm.queries import ORACLES as CORPUS_ORACLES
    from barframe.llm.queries import QUERIES as CORPUS_QUERIES

    import corpus_pipeline
except ModuleNotFoundError as e:
    if e.name not in ("barframe.llm", "barframe.llm.queries", "corpus_pipeline"):
        raise
    CORPUS_QUERIES, CORPUS_ORACLES = {}, {}
else:
    CORPUS_QUERIES = CORPUS_QUERIES | {"pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        CORPUS_ORACLES = CORPUS_ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}


def queries() -> dict[str, Query]:
    return CORPUS_QUERIES | {
        "clean_bars": q_clean_bars,
        "rejected_bars": q_rejected_bars,
        "ticker_normalize": q_ticker_normalize,
        "source_fallback": q_source_fallback,
        "source_notes": q_source_notes,
        "merged_notes": q_notes,
        "instrument_info": q_instrument_info,
        "daily_bars": q_daily_bars,
        "nation_bars": q_nation_bars,
        "hourly_bars": q_hourly_bars,
        "weekly_bars": q_weekly_bars,
        "weekly_fallback": q_weekly_fallback,
        "bars_tail": q_bars_tail,
        "scan_window": q_scan_window,
        "scan_windows": q_scan_windows,
        "stored_bars": q_stored_bars,
        "ma_set": _panel("ma5", "ma10", "ma20", "ma60", "ma120"),
        "volume_ratio": _panel(
            "vol_ma5", "vol_ma10", "vol_ma20", "vol_ratio", "vol_ratio_high", "vol_ratio_low"
        ),
        "obv": _panel("obv", "obv_ma20", stateful=True),
        "rsi": _panel("rsi", stateful=True),
        "bias": _panel("bias"),
        "atr": _panel("atr"),
        "adx": _panel("plus_di", "minus_di", "adx"),
        "cmf": _panel("cmf"),
        "mfi": _panel("mfi"),
        "macd": _panel("macd", "macd_signal", "macd_hist", stateful=True),
        "flat_bars": _panel("plus_di", "minus_di", "cmf", "mfi", "rsi", stateful=True, bars=fx.nation_daily),
        "hourly_panel": _panel("ma20", "vol_ratio", "rsi", "macd_hist", stateful=True, bars=fx.event_bars),
        "panel_increment": q_panel_increment,
        "long_windows": q_long_windows,
        "score_panel": q_score_panel,
        "candle_patterns": q_candle_patterns,
        "vp_signals": q_vp_signals,
        "vp_texts": q_vp_texts,
        "triggers": q_triggers,
        "structured_signals": q_structured_signals,
        "divergence_panel": q_divergence_panel,
        "levels_panel": q_levels_panel,
        "behavior_panel": q_behavior_panel,
        "dip_entry_panel": q_dip_entry_panel,
        "risk_panel": q_risk_panel,
        "support_resistance": _pattern("support", "resistance"),
        "divergence": _pattern("macd_divergence", "rsi_divergence", "obv_divergence"),
        "chip": _pattern("volume_cv", "range_place", "chip_concentration"),
        "chip_flat": _pattern("volume_cv", "range_place", "chip_concentration", bars=fx.nation_daily),
        "price_patterns": _pattern("price_patterns"),
        "score_latest": q_score_latest,
        "score_short": q_score_short,
        "analysis": q_analysis,
        "analysis_text": q_analysis_text,
        "behavior": q_behavior,
        "dip_entry": q_dip_entry,
        "behavior_short": q_behavior_short,
        "dip_entry_short": q_dip_entry_short,
        "score_cuts": q_score_cuts,
        "behavior_cuts": q_behavior_cuts,
        "dip_entry_cuts": q_dip_entry_cuts,
        "composite": q_composite,
        "composite_panel": q_composite_panel,
        "sector_heatmap": q_sector_heatmap,
        **{f"insight_{view}": _insight(view) for view in VIEWS},
        "fundamental_ttm": q_fundamental_ttm,
        "fundamental_wide": q_fundamental_wide,
        "fundamental_reported": q_fundamental_reported,
        "fundamental_summary": q_fundamental_summary,
        "fundamental_text": q_fundamental_text,
        "news_top5": q_news_top5,
        "hot_tags": _output(out.hot_tags),
        "risk_messages": _output(out.risk_messages),
        "score_vector": _output(out.score_vector),
        "readings": _output(out.readings),
        "chart_feed": q_chart_feed,
        "hourly_chart_feed": q_hourly_chart_feed,
        "report_context": q_report_context,
        "report_full": q_report_full,
        "top_scores": q_top_scores,
    }


def oracle_sql() -> dict[str, str]:
    return ORACLES | CORPUS_ORACLES
