"""Statements to trailing-year figures, ratios and a trend summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barframe.functions.numeric import ratio
from barframe.functions.text import fixed
from barframe.operators.series import top_per_key
from barframe.schema import STATEMENT_ITEMS

FIGURES = ["revenue", "net_income", "roe", "gross_margin", "debt_ratio"]


def melt_statements(wide: DataFrame, item: str = "item") -> DataFrame:
    """Items by periods, as filed, to (symbol, item, period_end, value).

    A table of many symbols has the periods of all: one for which a symbol has no value at all is none of its own and left
    out, other gaps are kept. The window holds the items of one statement and has the key by which
    ``statement_lines`` groups, so both share an exchange.
    """
    periods = [c for c in wide.columns if c not in ("symbol", item)]
    long = wide.unpivot(["symbol", item], periods, "period_end", "value").withColumn(
        "period_end", F.col("period_end").try_cast("date")
    )
    filed = F.count("value").over(Window.partitionBy("symbol", "period_end"))
    return long.withColumn("_filed", filed).filter("_filed > 0").drop("_filed")


def statement_lines(statements: DataFrame) -> DataFrame:
    """One row per (symbol, period_end), a column per item.

    A statement names an item in one of two ways; the first name a symbol uses at all is read,
    so a gap under it stays a gap. Everything is aggregated per key and period first.
    """
    names = [n for aliases in STATEMENT_ITEMS.values() for n in aliases]
    wanted = statements.filter(F.col("item").isin(names))
    per_period = wanted.groupBy("symbol", "period_end").agg(
        *[F.max(F.when(F.col("item") == n, F.col("value"))).alias(f"_v_{i}") for i, n in enumerate(names)],
        *[F.max(F.col("item") == n).alias(f"_has_{i}") for i, n in enumerate(names)],
    )
    series = Window.partitionBy("symbol")
    used = per_period.withColumns(
        {f"_has_{i}": F.max(f"_has_{i}").over(series) for i in range(len(names))}
    )
    columns = []
    for item, aliases in STATEMENT_ITEMS.items():
        value = F.lit(None).cast("double")
        for alias in reversed(aliases):
            i = names.index(alias)
            value = F.when(F.col(f"_has_{i}"), F.col(f"_v_{i}")).otherwise(value)
        columns.append(value.alias(item))
    return used.select("symbol", "period_end", *columns)


def trailing_year(lines: DataFrame, last_n: int | None = None) -> DataFrame:
    """Four-quarter sums with ROE and debt ratio, for every quarter that has three before it.

    A missing quarter value counts 0. The ratios use the newest quarter's balance.
    """
    year = Window.partitionBy("symbol").orderBy("period_end").rowsBetween(-3, 0)
    out = lines.select(
        "symbol",
        F.min("period_end").over(year).alias("period_start"),
        "period_end",
        *[F.coalesce(F.sum(c).over(year), F.lit(0.0)).alias(c) for c in ("revenue", "net_income")],
        F.count(F.lit(1)).over(year).alias("_n"),
        "equity",
        "liabilities",
        "assets",
    ).filter("_n = 4")
    out = out.select(
        "symbol",
        "period_start",
        "period_end",
        "revenue",
        "net_income",
        (ratio(F.col("net_income"), F.col("equity")) * 100).alias("roe"),
        F.lit(None).cast("double").alias("gross_margin"),
        (ratio(F.col("liabilities"), F.col("assets")) * 100).alias("debt_ratio"),
    )
    return out if last_n is None else newest_periods(out, last_n)


def newest_periods(figures: DataFrame, n: int = 4) -> DataFrame:
    return top_per_key(
        figures, ["symbol"], [F.desc("period_end")], n, ["period_end"], "_rank"
    ).drop("_rank")


def reported_figures(reports: DataFrame) -> DataFrame:
    """Newest four reports as (symbol, period_end, figures); absent columns become NULL."""
    have = {c: F.col(c).cast("double") for c in FIGURES if c in reports.columns}
    return newest_periods(
        reports.select(
            "symbol",
            F.col("period").cast("date").alias("period_end"),
            *[have.get(c, F.lit(None).cast("double")).alias(c) for c in FIGURES],
        )
    )


def trend_summary(figures: DataFrame, order: str = "chronological") -> DataFrame:
    """Per symbol: revenue and net income growth and the ROE's direction.

    ``order='reported'`` compares from the newest report to the oldest, as listed.
    """
    newest_first = order == "reported"
    by = F.desc("period_end") if newest_first else F.asc("period_end")
    past = Window.partitionBy("symbol").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    steps = figures.select(
        "symbol",
        "period_end",
        "roe",
        *[
            (ratio(F.col(c) - F.last(c, True).over(past), F.last(c, True).over(past))).alias(f"_{c}")
            for c in ("revenue", "net_income")
        ],
        "revenue",
        "net_income",
    )
    # a period without the figure makes no step
    steps = steps.withColumns(
        {f"_{c}": F.when(F.col(c).isNotNull(), F.col(f"_{c}")) for c in ("revenue", "net_income")}
    )
    held = F.when(F.col("roe").isNotNull(), F.col("period_end"))
    first, last = F.min_by("roe", held), F.max_by("roe", held)
    if newest_first:
        first, last = last, first

    def growth(c: str):
        g = F.col(f"_{c}")
        return (
            F.when(F.count(c) < 2, "insufficient")
            .when(F.coalesce(F.bool_and(g > 0), F.lit(False)), "growing")
            .when(F.bool_or(g > 0) & F.bool_or(g < 0), "unstable")
            .otherwise("declining")
        )

    return (
        steps.groupBy("symbol")
        .agg(
            growth("revenue").alias("revenue_trend"),
            growth("net_income").alias("net_income_trend"),
            F.when(F.count("roe") < 2, "insufficient")
            .when(last > first, "up")
            .when(last < first, "down")
            .otherwise("flat")
            .alias("roe_trend"),
        )
    )


def figures_text(figures: DataFrame) -> DataFrame:
    """Table for display: period label and two decimals or N/A."""
    shown = ["revenue", "net_income", "roe", "debt_ratio"]
    return figures.selectExpr(
        "symbol",
        "date_format(period_end, 'yyyy-MM') as period",
        *[f"coalesce({fixed(c, 2)}, 'N/A') as {c}" for c in shown],
    )
