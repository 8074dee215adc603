"""What several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many edges of 16 bytes are few.
FEW_EDGES = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. If the session names none, one is chosen in local mode, as in tests; on a cluster,
    whose machines share no folder unless told, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and cut from their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read from it, which takes less room than a checkpoint."""
    folder = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sent_if_small(df: DataFrame, rows: int = 250_000) -> DataFrame:
    """The rows, marked for broadcast if there are no more than so many; joins shuffle them otherwise.

    For checkpointed rows of a few numbers or hashes each, some 50 bytes.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(rate: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo rate; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % rate


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "place",
    slices: int = 256,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Each row's place within its key, from 0. Keys must not be null. facts: a row for each key, added to its rows.

    A key's rows are dealt over slices by the hash of the order columns, counted per slice, and
    numbered within; so no task gets all rows of a frequent key.
    """
    keys = list(keys)
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if facts is not None:
        before = before.join(facts, keys)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    placed = dealt.withColumn("_row", F.row_number().over(inside) - 1).join(before, [*keys, "_slice"])
    return placed.withColumn(name, F.col("_before") + F.col("_row")).drop("_slice", "_before", "_row")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of the links: root is the smallest node that it is connected to.

    Alternating large-star and small-star steps: each is an aggregation and a join on the node, and
    the number of rounds grows with the logarithm of the longest path. Every round is checkpointed. Edges that are few
    lie in few partitions, and the minima are sent to them: with hundreds of shuffle partitions, a round's exchanges would
    else leave far more on disk than the edges take.
    """

    def state(edges: DataFrame) -> tuple:
        mixed = F.xxhash64("u", "v").cast("decimal(20,0)")
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())

    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = checkpointed(edges)
    now, seen = state(edges), None
    while now != seen:
        few = now[0] <= FEW_EDGES
        sent = F.broadcast if few else lambda minima: minima
        parts = 1 + now[0] // 50_000
        edges = edges.coalesce(parts) if few else edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if few else large.distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(lower), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(lower.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(edges.coalesce(parts) if few else edges)
        now, seen = state(edges), now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
