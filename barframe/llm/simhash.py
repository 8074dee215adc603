"""SimHash near-duplicates, found by anchor points of a covering code.

The 64 bits of a fingerprint are cut into two blocks of 23 bits and a rest of 18. Anchors are the words of
the product of two binary Golay codes [23, 12] (perfect, covering radius 3) and, on the rest, the
code of the zero word alone (covering radius 18). Every fingerprint has one nearest anchor. If two
fingerprints differ in at most d bits, split d1 and d2 over the two blocks, the nearest anchor of the one
lies within 3 + d1 and 3 + d2 of the other; so each fingerprint is copied to every anchor within covering
radius plus threshold, the threshold being shared between the blocks (61 anchors for d = 2, on average),
and compared there with the fingerprints that are at home. Each pair meets exactly once: at the home of
its smaller fingerprint.

Documents with equal fingerprints are compared once. Of different fingerprints at most 2,080 lie
within 2 bits of any one, so links stay in proportion however large a group of copies is.

Null texts have no words and fingerprint zero, and so have empty texts; they link like any other. A null
id counts as a document; a group's id is its smallest id that is not null. Repeated rows give repeated
rows. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from barframe.llm.common import checkpointed, components

SEED = 42
BLOCK = 23
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
RADIUS = 3
ROWS = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.array([xxh64_intdigest(b" ".join(p), SEED) for p in parts], dtype="<u8")
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        octets = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, text_hash, fp): fp as a signed 64-bit number, text_hash to tell rows of one id apart."""
    given = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")
    )
    schema = T.StructType(given.schema.fields[:2] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["id", "text_hash", "fp"])

    return given.mapInArrow(run, schema)


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    left = words.astype(np.int64).copy()
    for bit in range(BLOCK - 1, 10, -1):
        left ^= ((left >> bit) & 1) * (GOLAY << (bit - 11))
    return left


def _anchor_table(max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the differences that lead to an anchor within the radius plus max_bits, and how
    much of max_bits each one takes; rows are padded with differences that take too much."""
    flips = [
        sum(1 << b for b in bits) for k in range(RADIUS + max_bits + 1) for bits in combinations(range(BLOCK), k)
    ]
    flips = np.array(flips, dtype=np.int64)
    taken = np.maximum(0, np.bitwise_count(flips).astype(np.int64) - RADIUS)
    of = _syndromes(flips)
    order = np.argsort(of, kind="stable")
    flips, taken, of = flips[order], taken[order], of[order]
    start = np.searchsorted(of, np.arange(2049))
    place = np.arange(len(of)) - start[of]
    shape = (2048, int(place.max()) + 1)
    differences, costs = np.zeros(shape, dtype=np.int64), np.full(shape, max_bits + 1, dtype=np.int64)
    differences[of, place], costs[of, place] = flips, taken
    return differences, costs


def anchors(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Rows (anchor, fp), for every anchor within reach. With max_bits 0: the home anchor alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differences, costs = _anchor_table(max_bits)
        low = (1 << BLOCK) - 1
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
            for at in range(0, len(every), ROWS):
                fp = every[at : at + ROWS]
                blocks = [(fp & np.uint64(low)).astype(np.int64), ((fp >> np.uint64(BLOCK)) & np.uint64(low)).astype(np.int64)]
                kinds = [_syndromes(b) for b in blocks]
                row, i, j = np.nonzero(costs[kinds[0]][:, :, None] + costs[kinds[1]][:, None, :] <= max_bits)
                # the 12 leading bits of a code word tell it
                first = (blocks[0][row] ^ differences[kinds[0][row], i]) >> 11
                second = (blocks[1][row] ^ differences[kinds[1][row], j]) >> 11
                anchor = ((second << 12) | first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row].view("<i8"))], ["anchor", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor int, fp long")


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Rows (a, b): pairs of different fingerprints, a < b, that differ in at most max_bits bits."""
    home = anchors(nodes, 0).select("anchor", F.col("fp").alias("a"))
    near = anchors(nodes, max_bits).select("anchor", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return home.join(near, "anchor").where(close).select("a", "b")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """Rows (id, text_hash, fp, root, component_id, links), one per document.

    root is the smallest fingerprint of the group, component_id its smallest id, links the number of
    other fingerprints that the document's own is linked to.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("id")))
    found = checkpointed(links(nodes, max_bits))
    degree = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    grouped = components(found).withColumnRenamed("node", "fp").join(nodes, "fp").join(degree, "fp")
    smallest = grouped.groupBy("root").agg(F.min("id").alias("group_id"))
    linked = grouped.join(smallest, "root").select("fp", "root", "group_id", "links")
    classes = checkpointed(
        nodes.join(linked, "fp", "left").select(
            "fp",
            F.coalesce("root", "fp").alias("root"),
            F.coalesce("group_id", "id").alias("component_id"),
            F.coalesce("links", F.lit(0)).alias("links"),
        )
    )
    return marked.join(classes, "fp").select("id", "text_hash", "fp", "root", "component_id", "links")


def hex_digits(number) -> F.Column:
    """16 lowercase hex digits of a 64-bit number."""
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id stays.

    Of rows with that same id the one with the smallest text hash stays; of equal rows one.
    Null ids come after all others.
    """
    groups = near_groups(docs, id_col, text_col, shingle, max_bits)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    chosen = groups.groupBy("root").agg(first.alias("first")).select("first.id", "first.text_hash")
    packed = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.struct("*").alias("_row")
    )
    same = packed["_id"].eqNullSafe(chosen["id"]) & (packed["_hash"] == chosen["text_hash"])
    kept = packed.join(chosen, same, "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.select("_row.*")
