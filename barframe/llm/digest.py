"""Similarity digests of improbable features.

Every window of WIDTH bytes has an entropy. How often each entropy value occurs over all windows of all
documents is counted first; the rarer a window's value, the better its rank. A window is a
feature if it has the best rank (of equals the first) in at least POPULAR of the runs of RUN windows
that hold it. Short texts have features of narrower windows and shorter runs, by SCALES; the lengths of
neighbouring scales overlap, so that a text and its edited form have at least one scale in common. Each width is
ranked over all documents. Features by scale and in text order fill Bloom filters of FILTER bits, with at most FULL features each; the chain of
filters is the fingerprint, in base64.

The likeness of two fingerprints is the mean, over the filters of the shorter chain, of the best overlap
with a filter of the other: common bits beyond those that chance would give, as a share of the most that
could be. Equal fingerprints have likeness 1; a chain without features and one with, 0.

Null texts count as empty; an empty text has an empty fingerprint. A text of fewer bytes than the narrowest window is one feature.
A scale without popular windows has the best-ranked one. Extra columns are not read; an empty table gives no rows.

For texts with a neighbour: documents go in order of descending id (null ids last, equal ids by
text hash, equal rows in any order), in ranges cut at quantiles of the id; each range gets a copy of the
first document after it, so that one pass over sorted ranges sees every document with its next.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import checkpointed

WIDTH = 64
RUN = 64
POPULAR = 16
FILTER = 2048
FULL = 160
HASHES = 5
#: Width of windows, run, and the lengths of texts in bytes, from and to, that have features of it. A run is a fourth of
#: the windows at most, and a fourth of the run makes a window popular.
SCALES = ((4, 4, 4, 64), (16, 8, 32, 600), (WIDTH, RUN, 300, None))
#: Entropy values are kept in so many steps from 0 to the most that a window can have.
LEVELS = 1000
#: Texts are worked on in parts of so many bytes, with overlaps.
PART = 1 << 20

#: Bits of a window's place, below its rank.
_PLACE = 40
#: Widths up to this count equal bytes by comparing all neighbours.
_NARROW = 16
_COUNT = np.arange(WIDTH + 1, dtype=np.float64)
#: What the k-th equal byte adds to the sum of k * log2(k).
_GAIN = np.diff(_COUNT * np.log2(np.maximum(_COUNT, 1)), prepend=0.0)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _levels(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The entropy level of every window, by what leaves and what enters as it slides."""
    n = len(data)
    # equal bytes among the last width, and among the next width, the byte itself included
    if width <= _NARROW:
        before, after = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)
        for k in range(1, min(width, n)):
            equal = data[k:] == data[:-k]
            before[k:] += equal
            after[:-k] += equal
    else:
        order = np.argsort(data, kind="stable")
        key = data[order].astype(np.int64) * (2 * n + 4 * width) + order
        place = np.arange(n)
        before, after = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        end = np.searchsorted(key, key + width)
        after[order] = end - place
        # those that a byte has out of reach behind it are those whose reach ends at it or before
        before[order] = place - np.cumsum(np.bincount(end, minlength=n + 1))[:n] + 1
    change = _GAIN[before]
    change[width:] -= _GAIN[after[: n - width]]
    total = np.cumsum(change)[width - 1 :]
    entropy = np.log2(width) - total / width
    return np.clip(np.rint(entropy * (LEVELS / np.log2(width))), 0, LEVELS).astype(np.int64)


def _parts(data: np.ndarray, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(1, len(data) - overlap), PART):
        yield at, data[at : at + PART + overlap]


def level_counts(data: np.ndarray) -> np.ndarray:
    """How many windows of the text have each level, by scale."""
    found = np.zeros((len(SCALES), LEVELS + 1), dtype=np.int64)
    for row, (width, *_) in zip(found, SCALES):
        for _, part in _parts(data, width - 1):
            if len(part) >= width:
                row += np.bincount(_levels(part, width), minlength=LEVELS + 1)
    return found


def ranks(counts: np.ndarray) -> np.ndarray:
    """0 for the rarest level of a scale; levels that never occurred are the rarest, of equals the lower."""
    out = np.empty(len(counts), dtype=np.int64)
    out[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    return out


def _popular(rank: np.ndarray, run: int = RUN, popular: int = POPULAR) -> np.ndarray:
    """Places of the windows that win at least that many runs; the best one if none does."""
    n = len(rank)
    key = (rank << _PLACE) | np.arange(n)
    runs = max(1, n - run + 1)
    best, have = key, 1
    while have < min(run, n):
        step = min(have, min(run, n) - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    wins = np.bincount(best[:runs] & ((1 << _PLACE) - 1), minlength=n)
    found = np.nonzero(wins >= popular)[0]
    return found if len(found) else np.array([int(key.argmin())])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.array([pow(int(_BASE), k, 1 << 64) for k in range(WIDTH)], dtype=np.uint64)


def _feature_hashes(data: np.ndarray, rank_of: np.ndarray) -> np.ndarray:
    """Hashes of the features in text order."""
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    if len(data) < SCALES[0][0]:
        return _mixed(np.array([np.sum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)])], dtype=np.uint64))
    out = []
    for rank_at, (width, run, least, below) in zip(rank_of, SCALES):
        if len(data) < least or (below is not None and len(data) >= below):
            continue
        rank = np.concatenate([rank_at[_levels(p, width)] for _, p in _parts(data, width - 1) if len(p) >= width])
        windows = np.lib.stride_tricks.sliding_window_view(data, width)
        its_run = max(1, min(run, len(rank) // 4))
        found = _popular(rank, its_run, max(1, its_run // 4))
        for at in range(0, len(found), 4096):
            some = windows[found[at : at + 4096]].astype(np.uint64) + np.uint64(1)
            out.append(_mixed((some * _POWERS[:width]).sum(axis=1, dtype=np.uint64)))
    return np.concatenate(out)


def filters(data: bytes, rank_of: np.ndarray) -> np.ndarray:
    """The chain: one row of FILTER bits, as bytes, for every FULL features."""
    hashes = _feature_hashes(np.frombuffer(data, dtype=np.uint8), rank_of)
    chain = -(-len(hashes) // FULL)
    bits = np.zeros((chain, FILTER), dtype=bool)
    row = np.arange(len(hashes)) // FULL
    for k in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def chain_of(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, FILTER // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    ones_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    scores = []
    for row in a:
        ones = int(np.bitwise_count(row).sum(dtype=np.int64))
        common = np.bitwise_count(b & row).sum(axis=1, dtype=np.int64)
        chance = ones * ones_b / FILTER
        most = np.minimum(ones, ones_b)
        scores.append(float(np.max(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1))))
    return float(np.mean(scores))


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of every level by scale, by its count over all windows of all documents."""
    given = docs.select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SCALES), LEVELS + 1), dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += level_counts(np.frombuffer((t.as_py() or "").encode("utf-8", "replace"), dtype=np.uint8))
        scale, level = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(scale), pa.array(level), pa.array(total[scale, level])], ["scale", "level", "n"])

    counted = given.mapInArrow(run, "scale long, level long, n long").groupBy("scale", "level").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(SCALES), LEVELS + 1), dtype=np.int64)
    for r in counted.collect():  # LEVELS + 1 rows a scale at most
        counts[r["scale"], r["level"]] = r["n"]
    return np.stack([ranks(c) for c in counts])


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the following text, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def in_ranges(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """Rows (id, text, turn, guest), sorted within partitions so that every document is followed by its next.

    guest marks the copy of the first document after a range, and of the very first after the last.
    """
    given = docs.select(
        F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tie")
    )
    cuts = sorted(set(given.select(F.col("id").cast("double").alias("x")).approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.2 / ranges))) or [0.0]
    split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="x", outputCol="range", handleInvalid="keep")
    # null ids come last of all; ranges count from the largest ids
    dealt = split.transform(given.withColumn("x", F.coalesce(F.col("id").cast("double"), F.lit(-float("inf")))))
    dealt = dealt.withColumn("turn", (len(cuts) + 1 - F.col("range")).cast("int"))
    dealt = dealt.withColumn("turn", F.when(F.col("id").isNull(), len(cuts) + 2).otherwise(F.col("turn")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("back"), "tie")).alias("first")
    heads = checkpointed(dealt.groupBy("turn").agg(first).select("turn", "first.back", "first.tie"))
    turns = sorted(r["turn"] for r in heads.select("turn").collect())  # as many as ranges
    goes_to = {t: turns[i - 1] for i, t in enumerate(turns)}
    if not goes_to:
        return dealt.select("id", "text", "tie", "turn", F.lit(False).alias("guest"))
    to = F.create_map(*[F.lit(x) for pair in goes_to.items() for x in pair])
    heads = heads.select(F.col("turn").alias("h_turn"), F.col("back").alias("h_back"), F.col("tie").alias("h_tie"))
    is_head = (
        (F.col("turn") == F.col("h_turn")) & F.bitwise_not("id").eqNullSafe(F.col("h_back")) & (F.col("tie") == F.col("h_tie"))
    )
    guests = dealt.join(F.broadcast(heads), is_head, "left_semi").dropDuplicates(["turn"])
    guests = guests.select("id", "text", "tie", to[F.col("turn")].alias("turn"), F.lit(True).alias("guest"))
    both = dealt.select("id", "text", "tie", "turn", F.lit(False).alias("guest")).union(guests)
    return both.repartition("turn").sortWithinPartitions("turn", "guest", F.desc_nulls_last("id"), "tie")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one per document."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(rarity(docs, text_col))
    ordered = in_ranges(docs, id_col, text_col, ranges)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([ordered.schema["id"]] + [T.StructField(n, k) for n, k in zip(names[1:], kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = sent.value
        held = None  # the document whose next one is still to come
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                chain = filters(text.encode("utf-8", "replace"), rank_of)
                if held is not None:
                    its_id, its_text, its_chain = held
                    new = edited(its_text, text).encode("utf-8", "replace")
                    new_chain = filters(new, rank_of)
                    values = (
                        its_id,
                        len(its_text),
                        hashlib.sha256(new).hexdigest(),
                        text_of(its_chain),
                        text_of(new_chain),
                        likeness(its_chain, new_chain),
                        likeness(its_chain, chain),
                    )
                    for column, v in zip(rows, values):
                        column.append(v)
                held = None if batch.column(4)[i].as_py() else (batch.column(0)[i].as_py(), text, chain)
            columns = [pa.array(c, type=t) for c, t in zip(rows, [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ordered.mapInArrow(run, schema)
