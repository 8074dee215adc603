"""Exact copies: rows are grouped by the 128-bit hash of their text, and bytes are compared inside groups.

Hashes and ids are counted first. The hashes that occur more than once set bits in a filter of fixed size (``FILTER_ROWS`` rows
of 4 KB, 16 MB, whatever the data), which is sent to all tasks. Rows whose bit is not set are alone: their texts stay where they
are. Texts of the other rows are aggregated by (hash, text), combined before the shuffle, so that a large group costs one text a
task; this is the comparison of bytes. A hash with more than one text (a collision) makes as many groups. A bit set by another
hash costs the traffic of a row, never a result; with more repeated hashes than the filter has bits (2^27) most texts travel.
Rows whose bit is set meet their groups over slices of each hash by their id, against groups of a third of all rows; their texts
go along only if some hash has two. The plan is the same at every size.

Null texts count as empty, and empty texts are copies of each other. Null ids lose to all others; a group
of null ids alone has keep_id null. Of rows that repeat id and text one stays. Very long texts are hashed and compared whole.
Extra columns are carried along as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.common import checkpointed

SLICES = 16
FILTER_ROWS = 4096
#: Bits of one row of a bitmap, as Spark's bitmap functions make them.
ROW_BITS = 32768


def _row(carried: Column, docs: DataFrame, id_col: str, text_col: str, normalize) -> DataFrame:
    text = normalize(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.unhex(F.md5(text.cast("binary"))).alias("hash"),
        F.pmod(F.xxhash64(id_col), F.lit(SLICES)).alias("slice"),
        carried.alias("row"),
    )


def _sliced(df: DataFrame) -> DataFrame:
    return df.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLICES - 1).cast("long"))))


def _place(rows: int) -> tuple[Column, Column]:
    """Row of the filter and bit in it, of a hash."""
    mixed = F.xxhash64("hash")
    return F.pmod(mixed, F.lit(rows)), F.pmod(F.shiftright(mixed, 32), F.lit(ROW_BITS))


def _filter(hashes: DataFrame, rows: int) -> DataFrame:
    """Rows (part, bits) with a bit set for every hash; at most so many rows of 4 KB."""
    part, bit = _place(rows)
    return hashes.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _marked(docs: DataFrame, bits: DataFrame, rows: int) -> DataFrame:
    """The rows with ``may_repeat``: whether the bit of their hash is set."""
    part, bit = _place(rows)
    placed = docs.withColumns({"part": part, "bit": bit}).join(F.broadcast(bits), "part", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
    return placed.withColumn("may_repeat", F.coalesce(is_set, F.lit(False))).drop("part", "bit", "bits")


def same(text: Column) -> Column:
    return text


def copy_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalize=same,
    carried: Column | None = None,
    filter_rows: int = FILTER_ROWS,
) -> DataFrame:
    """Rows (id, row, keep_id, group_size, kept), one per document; row is the carried column.

    keep: whether the smallest or the largest id of a group stays. normalize: what is done to a text
    before it is compared. filter_rows: the filter's size in rows of 4 KB.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = _row(F.lit(None) if carried is None else carried, docs, id_col, text_col, normalize)
    by_id = rows.groupBy("hash", "id").agg(F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(by_id.groupBy("hash").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1"))
    ids_repeat = not repeated.where("most > 1").isEmpty()
    rows = _marked(rows, checkpointed(_filter(repeated.select("hash"), filter_rows)), filter_rows)
    found = rows.where("may_repeat")
    texts = found.groupBy("hash", "text").agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id"))
    # a text goes along only where its hash has several
    of_hash = Window.partitionBy("hash")
    groups = checkpointed(
        texts.withColumn("texts", F.count(F.lit(1)).over(of_hash))
        .where("group_size > 1")
        .select("hash", F.when(F.col("texts") > 1, F.col("text")).alias("g_text"), "keep_id", "group_size")
    )
    collided = not groups.where("g_text is not null").isEmpty()
    dealt = _sliced(groups).select(F.col("hash").alias("g_hash"), F.col("slice").alias("g_slice"), "g_text", "keep_id", "group_size")
    its_own = (F.col("hash") == F.col("g_hash")) & (F.col("slice") == F.col("g_slice"))
    if collided:
        its_own = its_own & (F.col("g_text").isNull() | (F.col("g_text") == F.col("text")))
    else:
        found = found.drop("text")
    joined = found.join(dealt, its_own, "left")
    in_group = F.col("group_size").isNotNull()
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    if ids_repeat:
        # the hash of the text tells the groups of a hash apart
        again = Window.partitionBy("hash", "slice", "id", F.xxhash64("g_text")).orderBy("slice")
        stays = stays & (F.row_number().over(again) == 1)
    one = F.lit(1).cast("long")
    met = joined.select(
        "id",
        "row",
        F.when(in_group, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", one).alias("group_size"),
        (~in_group | stays).alias("kept"),
    )
    alone = rows.where("not may_repeat")
    return met.union(alone.select("id", "row", F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents with one of each group of copies."""
    return copy_groups(docs, id_col, text_col, keep, carried=F.struct("*")).where("kept").select("row.*")
