"""A Merkle manifest of a table, with a proof for every row, whose leaves find their places by bitmap rank.

No group is sorted. The ids of a group are bits: each task ors the bits of its rows into 64-bit words, and
the tasks' words are merged by (group, word), so that only words with a bit take room. A directory counts
the rows ahead of each word: of the containers (runs of words) before it in the group, and of the words before it in
its container. A row's rank is its word's count plus the popcount of the word's bits below its own.

Ranks are coordinates: a level's nodes lie in slots keyed by (group, rank // 2^bits), 1024 by default, and one aggregation puts each key's
digests into an array whose places are the rank's last bits. A task folds an array up to ten levels, and its top
goes to the next array; so a thousand times fewer rows travel in each round, however large a group is. Proofs come down
the same way: a slot array gets the path of its top, and hands each place its own.

A leaf is H of the given columns, each `-` if null, else the number of its UTF-8 bytes, `:`, and the value. H is the
lowercase hex sha256, digests entering as hex text. While a group has several nodes every two consecutive ones become
their H, the last alone if it has no partner; the groups' tops, ordered by group (null first), are
folded likewise.

Null ids come before all others. Rows with the same id, and null ids, are ordered by a hash of their leaf, so that repeated
rows have defined places; those rows are the only ones that are sorted, dealt over slices. Empty and very long texts
are values like any other; extra columns are not read. An empty table gives no rows. Ids are whole numbers. The
groups' tops, one row per group, are ranked in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.common import checkpointed, numbered

FOLD = 10
CONTAINERS = 2**20

PATH = "array<struct<sibling: string, left: boolean>>"
Path = list[dict]


def leaf_text(columns: Sequence[Column]) -> Column:
    """What the leaf is the H of."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def digest_of(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def fold(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of a slot array, from the given one up."""
    levels = [nodes]
    for _ in range(height):
        last = levels[-1]
        levels.append([digest_of("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def path_in(levels: list[list[str]], place: int) -> Path:
    """The siblings from a place of the lowest level to the array's top; null where a node has no partner."""
    path = []
    for level in levels[:-1]:
        other = place ^ 1
        path.append({"sibling": level[other] if other < len(level) else None, "left": other < place})
        place >>= 1
    return path


def folded(node: str, path: Path) -> str:
    """The root that a node and its siblings give."""
    for step in path:
        other = step["sibling"] or ""
        node = digest_of(other + node if step["left"] else node + other)
    return node


def height_of(nodes: int, bits: int) -> int:
    """Levels that an array of 2^bits places folds, of a group with so many nodes."""
    return min(bits, (nodes - 1).bit_length())


def ranks(leaves: DataFrame) -> DataFrame:
    """The rows (g, id, leaf, tie, ...) with `rank`, from 0, and `nodes`, the rows of their group g, which is not null."""
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    marked = leaves.withColumns({"_word": F.shiftright("id", 6), "_bit": F.when(F.col("id").isNotNull(), bit)})
    words = marked.groupBy("g", "_word").agg(F.bit_or("_bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    words = checkpointed(words)
    ends = words.agg(F.min("_word").alias("a"), F.max("_word").alias("b")).first()
    # a container has 1024 words, or more where the ids span so much that there were too many containers
    span = (ends["b"] - ends["a"] + 1) if ends["a"] is not None else 1
    shift = max(10, (span // CONTAINERS).bit_length())
    words = words.withColumn("_container", F.coalesce(F.shiftright("_word", shift), F.lit(-(2**62)).cast("long")))
    group = Window.partitionBy("g")
    ahead = group.orderBy("_container").rowsBetween(Window.unboundedPreceding, -1)
    directory = words.groupBy("g", "_container").agg(F.sum("n").alias("n"))
    directory = directory.select(
        "g", "_container", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("n").over(group).alias("nodes")
    )
    inside = Window.partitionBy("g", "_container").orderBy("_word").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(directory, ["g", "_container"])
    words = words.select(
        F.col("g").alias("w_g"),
        F.col("_word").alias("w_word"),
        (F.col("_ahead") + F.col("_before")).alias("first"),
        F.coalesce(F.bit_count("bits") < F.col("n"), F.lit(True)).alias("repeats"),
        "bits",
        "nodes",
    )
    words = checkpointed(words)
    its = (marked["g"] == words["w_g"]) & marked["_word"].eqNullSafe(words["w_word"])
    placed = marked.join(words, its)
    below = F.expr("cast(bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int))) as bigint)")
    kept = [*leaves.columns, "nodes", "rank"]
    once = placed.where("not repeats").withColumn("rank", F.col("first") + below).select(kept)
    if words.where("repeats").isEmpty():
        return once
    twice = _among_repeats(placed.where("repeats")).withColumn("rank", F.col("first") + F.col("_place"))
    return once.unionByName(twice.select(kept))


def _among_repeats(rows: DataFrame) -> DataFrame:
    """Each row's place in its word, by id, then a hash of the leaf, then the leaf; null ids have a word of their own.

    Equal rows are counted, so that they take neighbouring places whatever their order is.
    """
    rows = rows.withColumns({"_w": F.coalesce("_word", F.lit(-(2**62)).cast("long")), "_id": F.coalesce("id", F.lit(0).cast("long"))})
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64("leaf"), F.lit(256)))
    word, deal = ["g", "_w"], ["g", "_w", "_id", "_deal"]
    kinds = rows.groupBy(*deal, "leaf").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*word).orderBy("_id", "_deal").rowsBetween(Window.unboundedPreceding, -1)
    deals = kinds.groupBy(*deal).agg(F.sum("_n").alias("_n"))
    deals = deals.select(*deal, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"))
    within = Window.partitionBy(*deal).orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("_within", F.coalesce(F.sum("_n").over(within), F.lit(0))).drop("_n").join(deals, deal)
    placed = numbered(rows, [*deal, "leaf"], ["tie"], "_equal", facts=kinds)
    return placed.withColumn("_place", F.col("_earlier") + F.col("_within") + F.col("_equal"))


def _slots(rows: DataFrame, value: Column, bits: int) -> DataFrame:
    """Slot arrays: rows (g, key, nodes, slots), the slots ordered by rank."""
    entry = F.struct(F.col("rank"), value.alias("value"))
    keyed = rows.groupBy("g", F.shiftright("rank", bits).alias("key"))
    return keyed.agg(F.first("nodes").alias("nodes"), F.array_sort(F.collect_list(entry)).alias("slots"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows, one at a time: a slot array may be some 100 KB."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _tops(arrays: DataFrame, bits: int) -> DataFrame:
    """The folded tops of slot arrays whose values are digests: rows (g, rank, nodes, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            top = fold([s["value"] for s in r["slots"]], height_of(r["nodes"], bits))[-1][0]
            yield pa.RecordBatch.from_pylist([{"g": r["g"], "rank": r["key"], "nodes": -(-r["nodes"] // 2**bits), "value": top}])

    return arrays.mapInArrow(run, "g string, rank long, nodes long, value string")


def _paths_down(arrays: DataFrame, paths: DataFrame, bits: int) -> DataFrame:
    """The paths of each place of slot arrays, given those of the arrays' tops: rows (g, key, path, subroot)."""
    kind = pa.list_(pa.struct([("sibling", pa.string()), ("left", pa.bool_())]))
    schema = pa.schema([("g", pa.string()), ("key", pa.int64()), ("path", kind), ("subroot", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            levels = fold([s["value"] for s in r["slots"]], height_of(r["nodes"], bits))
            rows = [
                {"g": r["g"], "key": s["rank"], "path": path_in(levels, place) + r["path"], "subroot": r["subroot"]}
                for place, s in enumerate(r["slots"])
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return arrays.join(paths, ["g", "key"]).mapInArrow(run, f"g string, key long, path {PATH}, subroot string")


def _folded_up(arrays: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of the levels above the given one, and the groups' tops: rows (g, value)."""
    rounds: list[DataFrame] = []
    tops = checkpointed(_tops(arrays, bits))
    while not tops.where("nodes > 1").isEmpty():
        rounds.append(checkpointed(_slots(tops.where("nodes > 1"), F.col("value"), bits)))
        tops = checkpointed(_tops(rounds[-1], bits).unionByName(tops.where("nodes = 1")))
    return rounds, tops.select("g", "value")


def _handed_down(rounds: list[DataFrame], paths: DataFrame, bits: int) -> DataFrame:
    """The paths of the lowest arrays, from those of the groups' tops."""
    for level in reversed(rounds):
        lower = paths.join(level.select("g").distinct(), "g", "left_anti")
        paths = checkpointed(_paths_down(level, paths, bits).unionByName(lower))
    return paths


def manifest(
    rows: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    tampered: dict[str, Column] | None = None,
    where: Column | None = None,
    bits: int = FOLD,
) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof_sha256, folded_root, verified), one per row.

    tampered: columns that have another value where `where` holds; folded_root is the root that the leaf of those
    values gives with the original siblings, verified whether it equals the root. proof_sha256 is H of the siblings,
    level by level, left to right.
    """
    text = leaf_text([F.col(c) for c in columns]).cast("binary")
    changed = leaf_text([(tampered or {}).get(c, F.col(c)) for c in columns]).cast("binary")
    group = F.concat(F.lit("1"), F.col(group_col).cast("string"))
    leaves = rows.select(
        F.coalesce(group, F.lit("0")).alias("g"),
        F.col(id_col).cast("long").alias("id"),
        F.sha2(text, 256).alias("leaf"),
        F.when(F.lit(False) if where is None else where, F.sha2(changed, 256)).alias("changed"),
        F.monotonically_increasing_id().alias("tie"),
    )
    arrays = checkpointed(_slots(ranks(checkpointed(leaves)), F.struct("id", "leaf", "changed"), bits))
    digests = F.transform("slots", lambda s: F.struct(s["rank"].alias("rank"), s["value"]["leaf"].alias("value")))
    rounds, subroots = _folded_up(arrays.withColumn("slots", digests), bits)

    # the groups' tops are one more group, whose paths lead to the root
    by_group, every = Window.orderBy("g"), Window.partitionBy()
    places = {"rank": F.row_number().over(by_group).cast("long") - 1, "nodes": F.count(F.lit(1)).over(every)}
    ranked = checkpointed(subroots.withColumns(places))
    bottom = checkpointed(_slots(ranked.withColumn("g", F.lit("")), F.col("value"), bits))
    upper, top = _folded_up(bottom, bits)
    root = top.first()
    root = root["value"] if root else ""
    start = top.select("g", F.lit(0).cast("long").alias("key"), F.expr(f"cast(array() as {PATH})").alias("path"), F.col("value").alias("subroot"))
    paths = _handed_down([bottom, *upper], start, bits).select(F.col("key").alias("rank"), "path")
    paths = ranked.join(paths, "rank").select("g", F.lit(0).cast("long").alias("key"), "path", F.col("value").alias("subroot"))
    paths = _handed_down(rounds, checkpointed(paths), bits)
    text, schema = pa.string(), [("id", pa.int64())]
    schema = pa.schema(schema + [(c, text) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            levels = fold([s["value"]["leaf"] for s in r["slots"]], height_of(r["nodes"], bits))
            rows = []
            for place, s in enumerate(r["slots"]):
                v, path = s["value"], path_in(levels, place) + r["path"]
                again = folded(v["changed"] or v["leaf"], path)
                proof = digest_of("".join(p["sibling"] or "" for p in path))
                rows.append((v["id"], v["leaf"], r["subroot"], root, proof, again, again == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return arrays.join(paths, ["g", "key"]).mapInArrow(
        run, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
