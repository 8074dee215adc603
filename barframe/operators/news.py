"""News per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.operators.series import top_per_key


def epoch_to_time(seconds: Column) -> Column:
    """Provider epoch to a zone-free UTC time; 0 and NULL mean no time."""
    return F.when(
        seconds != 0,
        F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")),
    )


def latest_news(news: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """Newest ``n`` items per symbol; ``key`` settles equal times."""
    ranked = top_per_key(
        news, ["symbol"], [F.desc_nulls_last("published_at"), F.asc(key)], n, [key], "rank"
    )
    return ranked.select(
        "symbol",
        "rank",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "source", "url")],
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm"), F.lit("")).alias("time"),
    )
