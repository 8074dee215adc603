"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Documents are tokenized where they lie; only the lengths of their pieces matter for packing, and there are
at most as many lengths as a sequence has tokens. So the instance is a table of counts by length, bounded
whatever the corpus, which the driver solves:

* Reduction: from the longest length down, a sequence is fixed for good if its contents provably dominate
  all others that hold this length: nothing else fits; one piece fills the rest exactly; at most one more
  piece fits, then the longest; at most two more fit and the longest single one is as long as any two, or
  the two longest of all that may go as first and as second fit together.
* Best fit: what is left goes, longest first, into the fullest sequence that has room. Sequences of equal
  contents are handled as one entry with a count.

The pieces are then numbered within their length (a frequent length is dealt over slices) and find their
sequence and offset by binary search in the plan, whose size is bounded as well.

Null and empty texts give one piece of the end id alone. Null ids and rows that repeat are
documents of their own. Extra columns are not read by ``pack``. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from barframe.llm.common import checkpointed, numbered

LIMIT = 2048
END = 0
#: Texts with such characters, or the special token's string, take the slower library.
RARE = re.compile("[^\x00-ӿ]|<[|]endoftext[|]>")


@lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str):
    """Text to ids, as the tokenizer file gives them without special tokens added.

    ranks_path holds the same vocabulary for a library that is several times faster; texts of
    common characters go there, all others to the tokenizer file's own.
    """
    slow = Tokenizer.from_file(path)
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if RARE.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def piece_bounds(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the limit."""
    first = (n - 1) % limit + 1
    return [(0, first), *((at, limit) for at in range(first, n, limit))]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = T.LongType()
    schema = T.StructType(
        [given.schema["id"], T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, long) for c in ("start", "length", "ids_crc32")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                for k, (at, n) in enumerate(piece_bounds(len(ids), limit)):
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return given.mapInArrow(run, schema)


class Counts:
    """How many pieces of each length are left; lengths ascending."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def give(self, length: int) -> None:
        if length not in self.n:
            self.lengths.insert(bisect_left(self.lengths, length), length)
        self.n[length] = self.n.get(length, 0) + 1

    def longest_up_to(self, room: int) -> int | None:
        at = bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else None

    def shortest(self, k: int) -> int | None:
        """The tokens of the k shortest pieces, if there are as many."""
        total = 0
        for length in self.lengths:
            many = min(k, self.n[length])
            total, k = total + many * length, k - many
            if not k:
                return total
        return None


def dominating(left: Counts, length: int, limit: int) -> tuple[int, ...] | None:
    """What goes with one piece of this length, already taken from left, so that no other choice can be better."""
    room = limit - length
    longest = left.longest_up_to(room)
    if longest is None:
        return ()
    if longest == room:
        return (longest,)
    two, three = left.shortest(2), left.shortest(3)
    if two is None or two > room:
        return (longest,)
    if three is not None and three <= room:
        return None
    # one or two more fit: all pairs (a, b), a >= b, a + b <= room
    best, top_second = 0, 0
    for b in left.lengths:
        if 2 * b > room:
            break
        a = left.longest_up_to(room - b)
        if a < b or (a == b and left.n[b] < 2):
            continue
        best, top_second = max(best, a + b), b
    if longest >= best:
        return (longest,)
    alone = longest == top_second and left.n[longest] < 2
    if not alone and longest + top_second <= room:
        return (longest, top_second)
    return None


def reduced(counts: dict[int, int], limit: int) -> tuple[list[tuple[tuple[int, ...], int]], Counts]:
    """Sequences that are fixed, as (lengths, how many), and the pieces that are left."""
    left = Counts(counts)
    fixed: list[tuple[tuple[int, ...], int]] = []
    above = limit + 1
    while (length := left.longest_up_to(above - 1)) is not None:
        above = length
        while left.n.get(length):
            left.take(length, 1)
            with_it = dominating(left, length, limit)
            left.give(length)
            if with_it is None:
                break
            # the choice holds until one of its lengths runs out
            need = Counter((length, *with_it))
            many = min(left.n[x] // k for x, k in need.items())
            for x, k in need.items():
                left.take(x, k * many)
            fixed.append(((length, *with_it), many))
    return fixed, left


def best_fit(left: Counts, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, into the sequence with the least room that is enough."""
    rooms: list[int] = []
    at_room: dict[int, list[list]] = {}

    def put(contents: tuple[int, ...], many: int, room: int) -> None:
        if room not in at_room:
            at_room[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        at_room[room].append([contents, many])

    for length in reversed(left.lengths):
        n = left.n[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, contents, many = limit, (), None
            else:
                room = rooms[at]
                contents, many = at_room[room].pop()
                if not at_room[room]:
                    del at_room[room]
                    del rooms[at]
            each = room // length
            full = n // each if many is None else min(many, n // each)
            if full:
                put(contents + (length,) * each, full, room - each * length)
                n -= full * each
            if many is None:
                if n and n < each:
                    put((length,) * n, 1, limit - n * length)
                    n = 0
            elif many > full:
                some = 0
                if n < each and n:
                    put(contents + (length,) * n, 1, room - n * length)
                    some, n = 1, 0
                if many > full + some:
                    put(contents, many - full - some, room)
    return [(contents, many) for groups in at_room.values() for contents, many in groups]


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths of their pieces in order, how many of them)."""
    fixed, left = reduced(counts, limit)
    return fixed + best_fit(left, limit)


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """One entry for each pattern and length in it, ordered by length and place: the first place of that
    length that it takes, how many a sequence takes, its first sequence, the offset of the first."""
    rows, taken, base = [], {}, 0
    for contents, many in planned:
        offset = 0
        for length in dict.fromkeys(contents):
            each = contents.count(length)
            rows.append((length, taken.get(length, 0), each, base, offset))
            taken[length] = taken.get(length, 0) + each * many
            offset += each * length
        base += many
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, **paths: str) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset), one per piece."""
    cut = checkpointed(pieces(docs, id_col, text_col, limit, **paths))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, limit)))
    kept = cut.columns
    placed = numbered(cut, ["length"], ["id", "piece", "ids_crc32"])
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        starts = np.searchsorted(table["length"], np.arange(limit + 2))
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            place = batch.column("place").to_numpy(zero_copy_only=False)
            entry = np.empty(len(length), dtype=np.int64)
            for k in np.unique(length):
                here = length == k
                first = table["first"][starts[k] : starts[k + 1]]
                entry[here] = starts[k] + np.searchsorted(first, place[here], side="right") - 1
            within = place - table["first"][entry]
            each = table["each"][entry]
            sequence = table["sequence"][entry] + within // each
            offset = table["offset"][entry] + within % each * length
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return placed.mapInArrow(run, schema)
