"""Mixing sources to target weights by entropy balancing.

Sources share a budget of words by weight; no target exceeds max_copies times its source. Documents get
rates that stay as near to 1 as the targets allow, in the sense of relative entropy: the
rate of a document of x words (x in means of its source) is min(max_copies, exp(a * x)), where a is the source's
multiplier in the convex dual. Newton's method finds all multipliers at once, on one row per
(source, size): documents are aggregated to those before anything else, so a hot source costs one row per
size. Rates become whole copies by rounding their running sum over the sizes; what the
rounding left over is then made up by whole documents no longer than it, which halves it at least each time.
Copies of one (source, size) are dealt in the order of the documents' hashes, so reruns agree.

Null texts have size 0. The null source is one source, last in order. A document of no words is taken once and adds
nothing; a source of no words has target 0. Rows that repeat are documents of their own. Extra
columns are carried along as they are. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.common import checkpointed, numbered, word_count

WEIGHTS = (5, 2, 1)
STEPS = 6
ROUNDS = 12
TOLERANCE = 1e-9
MENDS = 6
#: Rates are rounded to such parts, so that sums taken in another order give the same copies.
PARTS = 10**9


def source_key(source: str) -> Column:
    """Orders by code point, null last; never null."""
    return F.when(F.col(source).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source)))


def targets(cells: DataFrame, weights: Sequence[float], share: float, max_copies: int) -> DataFrame:
    """Rows (key, source_size, documents, target): weights are dealt in turn over the sources by name.

    The excess over max_copies times a source goes to the others by weight until none is above. Sources
    that stop so are those with the least of size / weight; running sums over that order tell which.
    One row per source is ranked in one task.
    """
    sources = cells.groupBy("key").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")
    )
    by_name = Window.orderBy("key")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    sources = sources.withColumn("most", max_copies * F.col("source_size")).withColumn(
        "stops_at", F.col("most") / F.col("weight")
    )
    by_stop = Window.orderBy("stops_at", "key")
    up_to, after = by_stop.rowsBetween(Window.unboundedPreceding, 0), by_stop.rowsBetween(1, Window.unboundedFollowing)
    everywhere = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sources.withColumn("budget", F.sum("source_size").over(everywhere) * share)
        .withColumn("stopped_size", F.sum("most").over(up_to))
        .withColumn("open_weight", F.coalesce(F.sum("weight").over(after), F.lit(0.0)))
        .withColumn("stops", F.col("stopped_size") + F.col("stops_at") * F.col("open_weight") <= F.col("budget"))
    )
    stopped = F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everywhere), F.lit(0))
    open_weight = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everywhere)
    return sources.withColumn("level", (F.col("budget") - stopped) / open_weight).select(
        "key",
        "source_size",
        "documents",
        F.when(F.col("stops"), F.col("most").cast("double"))
        .otherwise(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
        .alias("target"),
    )


def balanced(cells: DataFrame, max_copies: int) -> DataFrame:
    """Cells with their rate.

    Newton's step is taken on the logarithm of the words that the rates give, kept inside the interval that
    is known to hold the root, and halved where a step would leave it.
    """
    of_source = Window.partitionBy("key")
    words = F.col("n") * F.col("size")
    source_size = F.nullif(F.col("source_size"), F.lit(0))
    cells = cells.withColumn("x", F.col("size") * F.col("documents") / source_size)
    settled = (F.col("source_size") == 0) | (F.col("target") >= max_copies * F.col("source_size"))
    least_x = F.min(F.when(F.col("size") > 0, F.col("x"))).over(of_source)
    cells = (
        cells.withColumn("settled", settled)
        .withColumn("low", -700 / least_x)
        .withColumn("high", math.log(max_copies) / least_x)
        .withColumn("a", F.log(F.col("target") / source_size) / F.sum(words * F.col("x")).over(of_source) * source_size)
        .withColumn("off", F.lit(1.0))
    )
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            power = F.col("a") * F.col("x")
            tilt = F.exp(F.least(power, F.lit(math.log(max_copies))))
            inside = F.when(power < math.log(max_copies), F.col("x")).otherwise(0.0)
            cells = cells.withColumn("got", F.sum(words * tilt).over(of_source)).withColumn(
                "slope", F.sum(words * tilt * inside).over(of_source)
            )
            gap = F.log(F.col("got")) - F.log("target")
            cells = (
                cells.withColumn("gap", gap)
                .withColumn("high", F.when(F.col("gap") >= 0, F.least("high", "a")).otherwise(F.col("high")))
                .withColumn("low", F.when(F.col("gap") <= 0, F.greatest("low", "a")).otherwise(F.col("low")))
                .withColumn("next", F.when(F.col("slope") > 0, F.col("a") - F.col("gap") * F.col("got") / F.col("slope")))
            )
            fits = (F.col("next") >= F.col("low")) & (F.col("next") <= F.col("high"))
            halved = (F.col("low") + F.col("high")) / 2
            cells = cells.withColumn("off", F.abs("gap")).withColumn(
                "a", F.when(F.col("off") <= TOLERANCE, F.col("a")).when(fits, F.col("next")).otherwise(halved)
            )
        cells = checkpointed(cells.drop("got", "slope", "gap", "next"))
        if (cells.where(~F.col("settled")).agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    tilted = F.exp(F.least(F.col("a") * F.col("x"), F.lit(math.log(max_copies))))
    rate = F.when(F.col("source_size") == 0, 1.0).when(F.col("settled"), float(max_copies)).otherwise(tilted)
    return cells.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate))


def copies_by_size(cells: DataFrame, max_copies: int) -> DataFrame:
    """Cells with the number of copies that their documents give together."""
    by_size = Window.partitionBy("key").orderBy("size")
    parts = F.round(F.col("rate") * PARTS).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    up_to = F.sum(F.col("parts")).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.floor((F.col("up_to") + PARTS // 2) / PARTS).cast("long")
    cells = cells.withColumn("parts", parts).withColumn("up_to", up_to).withColumn("whole", whole)
    cells = cells.withColumn("copies", F.col("whole") - F.coalesce(F.lag("whole").over(by_size), F.lit(0)))
    cells = cells.withColumn("copies", F.greatest(F.lit(0), F.least("copies", max_copies * F.col("n"))))
    of_source = Window.partitionBy("key")
    longest_first = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(MENDS):
        cells = cells.withColumn("due", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(of_source))
        spare = F.when(F.col("due") > 0, max_copies * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("due"))
        cells = cells.withColumn("spare", F.when(fits, spare).otherwise(0))
        before = F.coalesce(F.sum(F.col("spare") * F.col("size")).over(longest_first), F.lit(0))
        room = F.floor((F.abs("due") - before) / F.greatest("size", F.lit(1)))
        change = F.greatest(F.lit(0), F.least("spare", room)) * F.signum("due").cast("long")
        cells = cells.withColumn("change", change).withColumn("copies", F.col("copies") + F.col("change"))
    return cells


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    max_copies: int = 2,
    carried: Column | None = None,
) -> DataFrame:
    """Rows (id, row, size, source_size, target, copies), one per document."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        source_key(source_col).alias("key"),
        word_count(F.col(text_col)).alias("size"),
        (F.lit(None) if carried is None else carried).alias("row"),
    )
    if carried is None:
        rows = checkpointed(rows)
    cells = rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))
    cells = checkpointed(cells)
    cells = cells.join(targets(cells, weights, share, max_copies), "key")
    cells = copies_by_size(balanced(cells, max_copies), max_copies)
    cells = checkpointed(cells.select("key", "size", "n", "source_size", "target", F.col("copies").alias("cell_copies")))
    each = numbered(rows, ["key", "size"], ["id", "text_hash"], facts=cells)
    extra = (F.col("place") < F.col("cell_copies") % F.col("n")).cast("long")
    return each.select(
        "id", "row", "size", "source_size", "target", (F.floor(F.col("cell_copies") / F.col("n")) + extra).alias("copies")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as many times as it is taken."""
    taken = mix(docs, carried=F.struct("*"), **options).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
