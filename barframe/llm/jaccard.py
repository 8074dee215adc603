"""Documents whose sets of word shingles are alike: Jaccard join by token-combination prefixes.

A token is the 64-bit hash of a shingle, and a set its sorted distinct tokens; documents of one set are one node. Two sets
that are alike enough share so many tokens that, whatever order all sets are read in, the first token that both have
lies in the first p = n - t + 1 of either, t being the overlap that a set of n tokens needs; and the first k lie
in the first p + k - 1. So sets meet under tokens of such prefixes, rare tokens leading the order.

* Tokens are counted over all documents, in windows somewhat longer than the prefix; those in more than `rare`
  windows are the frequent class, which leaves the front of the order. The threshold doubles while that class exceeds
  `most_frequent` tokens, so what is sent to tasks is bounded.
* A plain set finds its p rare tokens within its window; no more than `rare` plain sets meet under any of
  them. They are compared with each other and with all other sets that hold the token.
* Crowded sets, the rest, consist largely of frequent tokens: large families of near copies, and texts made of shared
  passages. Their tokens are counted whole. Prefixes are extended by one token, and indexed under single tokens
  of the rare class and pairs of tokens of the frequent one. Sets of `long` tokens or more would have too many pairs; they,
  and those down to what can be like them, are indexed under single tokens instead. Each crowded set
  is compared with that one of its key that has the fewest rare tokens, the least edited of a family; then, under keys that
  hold several components, with the sets of other components; so a family costs a comparison a set, not
  one a pair, and no link between components is lost.
* Candidates must pass the positional bound. The rest are verified on whole sets: each with its first partner, and pairs
  that are still apart after that. Sets travel only for nodes that are in a candidate pair; a Bloom filter of fixed
  size, 2 bits a node, tells tasks which documents to read again (a false hit costs traffic, never a row).

Null texts, empty ones and those without words have an empty set and are linked with nothing, each its own component.
A null id counts as a document; a component's id is its smallest id that is not null. Repeated rows give
repeated rows. Very long texts are taken whole. Extra columns are not read. An empty table gives no rows. Sets, and shingles
in them, are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from barframe.llm.common import checkpointed, components, sent_if_small

MULTIPLIER = 0x9E3779B97F4A7C15
FLUSH = 200_000
BLOOM_BITS = 2**27
LEADING = 22
LAST = 2**24 - 1
#: Tokens are counted by their leading 40 bits.
COUNTED = 24


@dataclass(frozen=True)
class Settings:
    size: int = 5
    percent: int = 80
    rare: int = 16
    most_frequent: int = 2**22
    long: int = 128

    def needed(self, n: int) -> int:
        """The overlap that a set of n tokens has with any set like it, at least."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.needed(n) + 1

    def window(self, n: int) -> int:
        p = self.prefix(n)
        return min(n, p + max(32, p // 4))

    def alone(self, n: int) -> bool:
        """No other set can be like one of n tokens: of all others, one with a token more is the likest."""
        return 100 * n < self.percent * (n + 1) and (n < 2 or 100 * (n - 1) < self.percent * n)

    def possible(self, a: str, b: str) -> Column:
        """Whether two sets that meet at these places (size * 2^24 + place) can share enough."""
        at, n = F.col, lambda c: F.shiftright(c, 24)
        left = F.least(*[n(c) - at(c).bitwiseAND(LAST) for c in (a, b)])
        return left * (100 + self.percent) >= self.percent * (n(a) + n(b))

    def alike(self, shared: int, a: int, b: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A number for each byte, that of its lower case for A-Z; 0 for what separates words.
OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
OF_BYTE[65:91] = OF_BYTE[97:123]
OF_BYTE[[9, 10, 11, 12, 13, 32]] = 0


def _powers(of: int, n: int) -> np.ndarray:
    """1, of, of^2, ... modulo 2^64."""
    factors = np.full(n, of, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class TokenSets:
    """The sets of many texts at once. A word's hash is a polynomial of its bytes' numbers, a shingle's one of its words'
    hashes. Bytes are taken in pieces that end between words."""

    def __init__(self, size: int, piece: int = 2**17) -> None:
        self.size, self.piece = size, piece
        self._grow(2 * piece)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(MULTIPLIER, n), _powers(pow(MULTIPLIER, -1, 2**64), n)

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word."""
        if len(data) > len(self.up):
            self._grow(len(data))
        numbers = OF_BYTE[np.frombuffer(data, dtype=np.uint8)]
        inside = numbers != 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate([[0] * bool(inside[0]), edges, [len(data)] * bool(inside[-1])]).astype(np.int64)
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, dtype=np.uint64), starts
        numbers *= self.up[: len(data)]
        sums = np.add.reduceat(numbers, starts) * self.down[starts]
        return mixed(sums + (ends - starts).astype(np.uint64)), starts

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(data) <= 2 * self.piece:
            return self._words(data) if data else (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
        found, at = [], 0
        while at < len(data):
            end = at + self.piece
            while end < len(data) and OF_BYTE[data[end - 1]]:
                end += 1
            hashes, starts = self._words(data[at:end])
            found.append((hashes, starts + at))
            at = end
        return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])

    def of(self, texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
        """For each text its set of shingles, ascending; one shingle of all words where there are fewer than size."""
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held < self.piece):
                held += len(texts[end] or b"") + 1
                end += 1
            yield from self._sets([t or b"" for t in texts[at:end]])
            at = end

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        of_word, starts = self.words(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(starts, ends)
        total = np.full(max(len(of_word) - self.size + 1, 0), self.size, dtype=np.uint64)
        for i in range(self.size):
            total += of_word[i : i + len(total)] * self.up[i + 1]
        shingles = mixed(total).view(np.int64)
        first = 0
        for end in last.tolist():
            n = end - first
            if n >= self.size:
                found = np.sort(shingles[first : end - self.size + 1])
                same = found[1:] == found[:-1]
                yield np.concatenate([found[:1], found[1:][~same]]) if same.any() else found
            elif n:
                whole = (of_word[first:end] * self.up[1 : n + 1]).sum(dtype=np.uint64) + np.uint64(n)
                yield mixed(np.array([whole])).view(np.int64)
            else:
                yield np.empty(0, dtype=np.int64)
            first = end


def tokens(text: str | None, size: int = 5) -> np.ndarray:
    """The set of one text."""
    return next(TokenSets(size).of([None if text is None else text.encode()]))


Emit = Callable[[np.ndarray, int], tuple[np.ndarray, ...] | None]


def _over_texts(docs: DataFrame, rules: Settings, make: Callable[[], Emit], schema: str, wanted=None) -> DataFrame:
    """What `make()` emits, some rows per document, of each document's set and key; docs have columns rk and text.
    wanted: a Bloom filter of the keys to look at. An emitted pair (values, None) is one list."""
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, emit, rows, held = TokenSets(rules.size), make(), [], 0
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(hit(wanted.value, batch.column(0).to_numpy(zero_copy_only=False))))
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            for key, found in zip(batch.column(0).to_pylist(), sets.of(texts)):
                out = emit(found, key)
                if out is not None:
                    rows.append(out)
                    held += len(found)
                if held >= FLUSH:
                    yield _batch(rows, kind)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, kind)

    return docs.select("rk", "text").mapInArrow(run, kind)


def _batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    arrays = []
    for column, parts in zip(kind.fields, zip(*rows)):
        if isinstance(column.dataType, T.ArrayType):
            offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p[0] for p in parts]))))
        else:
            arrays.append(pa.array(np.concatenate(parts)))
    return pa.RecordBatch.from_arrays(arrays, kind.names)


def bloom(keys: DataFrame) -> np.ndarray:
    """A filter of 64-bit hashes (column rk): 2 bits each in BLOOM_BITS, whatever their number is."""
    bit = F.explode(F.array(F.col("rk").bitwiseAND(BLOOM_BITS - 1), F.shiftrightunsigned("rk", 32).bitwiseAND(BLOOM_BITS - 1)))
    bits = keys.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    found = bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words.view(np.uint64)


def hit(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys, found = keys.astype(np.int64).view(np.uint64), True
    for bit in (keys & np.uint64(BLOOM_BITS - 1), (keys >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)):
        found = found & ((words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


@dataclass(frozen=True)
class Frequent:
    """Leading bits of tokens, ascending, and the power of two of how many sets hold each."""

    tokens: np.ndarray
    classes: np.ndarray
    #: by a token's leading bits: whether any frequent token has them
    leading: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        leading = np.zeros(2**LEADING, dtype=bool)
        leading[self._leading(self.tokens)] = True
        object.__setattr__(self, "leading", leading)

    @staticmethod
    def _leading(tokens: np.ndarray) -> np.ndarray:
        return tokens.view(np.uint64) >> np.uint64(64 - LEADING)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """A class for each token; 0 for rare ones."""
        tokens = counted(tokens)
        classes = np.zeros(len(tokens), dtype=np.int64)
        maybe = np.flatnonzero(self.leading[self._leading(tokens)])
        if len(maybe):
            asked = tokens[maybe]
            at = np.minimum(np.searchsorted(self.tokens, asked), len(self.tokens) - 1)
            classes[maybe] = np.where(self.tokens[at] == asked, self.classes[at], 0)
        return classes


def counted(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.int64(COUNTED)) << np.int64(COUNTED)


def frequent(rows: DataFrame, rules: Settings) -> Frequent:
    """The frequent class of tokens, at most most_frequent: rows hold a column token, cut to what is counted."""
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.rare)
    counts = checkpointed(counts.select("token", F.floor(F.log2("n")).cast("int").alias("power")))
    sizes = {r["power"]: r["n"] for r in counts.groupBy("power").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = min(sizes, default=0)
    while sum(n for power, n in sizes.items() if power >= least) > rules.most_frequent:
        least += 1
    found = counts.where(F.col("power") >= least).toArrow()
    names, powers = found["token"].to_numpy(), found["power"].to_numpy().astype(np.int64)
    order = np.argsort(names)
    return Frequent(names[order], powers[order])


def _placed(n: int, places: np.ndarray) -> np.ndarray:
    """Size and place in one number; a place of 2^24 or more counts as the last below, which only weakens the bound."""
    return (np.int64(n) << np.int64(24)) + np.minimum(places, LAST).astype(np.int64)


def _plain_rows(rules: Settings, common) -> Callable[[], Emit]:
    """(key, node, at, crowded): a set's rare tokens within its prefix."""

    def make() -> Emit:
        def emit(found: np.ndarray, _: int):
            n = len(found)
            if not n or rules.alone(n):
                return None
            rare, crowded = _front(found, rules, common.value)
            m = len(rare)
            return rare, np.full(m, node_of(found)), _placed(n, np.arange(m)), np.full(m, crowded)

        return emit

    return make


def _front(found: np.ndarray, rules: Settings, common: Frequent) -> tuple[np.ndarray, bool]:
    """The rare tokens of a set's prefix, and whether the set is crowded: its window has fewer of them than a prefix needs."""
    n = len(found)
    p = rules.prefix(n)
    window = found[: rules.window(n)]
    rare = window[common.of(window) == 0]
    if len(rare) >= p:
        return rare[:p], False
    return found[common.of(found) == 0][:p], True


def node_of(found: np.ndarray) -> np.int64:
    return np.uint64(xxh64_intdigest(found.tobytes())).astype(np.int64)


def marked(docs: DataFrame, rules: Settings, common) -> DataFrame:
    """Rows (id, rk, n, node, crowded), one per document; node is null for an empty set."""
    schema = T.StructType([docs.schema["id"], *T.StructType.fromDDL("rk long, n long, node long, crowded boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = TokenSets(rules.size)
        for batch in batches:
            sizes, nodes, crowded = [], [], []
            for found in sets.of(batch.column(2).cast(pa.large_binary()).to_pylist()):
                n = len(found)
                sizes.append(n)
                nodes.append(int(node_of(found)) if n else None)
                crowded.append(bool(n) and not rules.alone(n) and _front(found, rules, common.value)[1])
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(crowded, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.select("id", "rk", "text").mapInArrow(run, schema)


def sets_of(docs: DataFrame, nodes: DataFrame, rules: Settings, common) -> DataFrame:
    """Rows (node, crowded, tokens) for the given nodes, rk telling a document of each. There may be more: false hits of
    the filter, and a document that stands in several rows."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(nodes.select("rk")))

    def make() -> Emit:
        def emit(found: np.ndarray, _: int):
            if not len(found) or rules.alone(len(found)):
                return None
            return np.array([node_of(found)]), np.array([_front(found, rules, common.value)[1]]), (found, None)

        return emit

    return _over_texts(docs, rules, make, "node long, crowded boolean, tokens array<long>", wanted)


def _crowded_rows(sets: DataFrame, rules: Settings, common) -> DataFrame:
    """(key, node, at, rank) for sets of which many consist of frequent tokens: the rare tokens of the prefix, and pairs
    of frequent ones of the prefix extended by a token; or single ones for long sets and those that may be like them.
    Sets with fewer rare tokens rank first: in a family of copies, the least edited."""
    kind = T.StructType.fromDDL("key long, node long, at long, rank long")

    def rows(node: int, found: np.ndarray):
        n, classes = len(found), common.value.of(found)
        p = rules.prefix(n)
        order = np.lexsort((found, classes))[: p + 1]
        front, often = found[order].view(np.uint64), np.flatnonzero(classes[order] > 0)
        singles = np.flatnonzero(classes[order][:p] == 0)
        if 100 * n >= rules.percent * rules.long:
            singles = np.arange(min(p, len(order)))
        keys, at = [mixed(front[singles] + np.uint64(1))], [singles]
        if n < rules.long and len(often) > 1:
            i, j = np.triu_indices(len(often), 1)
            first, second = often[i], often[j]
            first, second = first[first < p], second[first < p]
            keys.append(mixed(mixed(front[first]) * np.uint64(MULTIPLIER) + front[second]))
            at.append(second - 1)
        keys, at = np.concatenate(keys), np.concatenate(at)
        odd = min(int((classes == 0).sum()), 2**22)
        rank = (odd << 40) + (int(node) % 2**64 >> 24)
        return keys.view(np.int64), np.full(len(keys), np.int64(node)), _placed(n, at), np.full(len(keys), rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for node, found in zip(batch.column(0).to_numpy(), _lists(batch.column(1))):
                out.append(rows(node, found))
                held += len(out[-1][0])
                if held >= FLUSH:
                    yield _batch(out, kind)
                    out, held = [], 0
            if out:
                yield _batch(out, kind)

    return sets.mapInArrow(run, kind)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def verified(pairs: DataFrame, sets: DataFrame, rules: Settings) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""
    wanted = pairs.sparkSession.sparkContext.broadcast(bloom(pairs.select(F.explode(F.array("a", "b")).alias("rk"))))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hit(wanted.value, batch.column(0).to_numpy())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                rules.alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))
                for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = sets.select("node", "tokens").mapInArrow(needed, "node long, tokens array<long>").dropDuplicates(["node"])
    b = of.select(F.col("node").alias("b"), F.col("tokens").alias("of_b"))
    a = of.select(F.col("node").alias("a"), F.col("tokens").alias("of_a"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def _with_roots(rows: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """The rows with the root of a node; a node without links is its own."""
    found = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(found, node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, root) after more links (a, b): only what they join is counted anew, root by root, not all links."""
    apart = _with_roots(_with_roots(links, roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b")
    grown = components(apart, "root_a", "root_b")
    new = grown.join(roots, "node", "left_anti")
    onto = grown.select(F.col("node").alias("root"), F.col("root").alias("onto"))
    moved = roots.join(onto, "root", "left").select("node", F.coalesce("onto", "root").alias("root"))
    return checkpointed(moved.unionByName(new))


def resolved(pairs: DataFrame, sets: DataFrame, rules: Settings, roots: DataFrame | None = None) -> DataFrame:
    """Rows (node, root) of the nodes that alike pairs connect, beside what ``roots`` has connected: each node's first
    partner is verified, then all pairs that are still apart."""
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = checkpointed(verified(first, sets, rules))
    roots = components(links) if roots is None else joined_roots(roots, links)
    rest = _with_roots(_with_roots(pairs, roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b")
    rest = checkpointed(rest.select("a", "b").join(first, ["a", "b"], "left_anti"))
    return roots if rest.isEmpty() else joined_roots(roots, checkpointed(verified(rest, sets, rules)))


def _as_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def plain_pairs(rows: DataFrame, rules: Settings) -> DataFrame:
    """Pairs a < b of plain sets, and of a plain and a crowded one, that meet under a token and can be alike.

    No token has more plain sets than the rare class allows, so lists of them are short.
    """
    # none is null; a join asks for that, and where it is said both branches read one exchange
    rows = rows.where("key is not null and node is not null and at is not null")
    plain, crowded = rows.where("not crowded").drop("crowded"), rows.where("crowded").drop("crowded")
    before = Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    lists = {"x_node": F.collect_list("node").over(before), "x_at": F.collect_list("at").over(before)}
    among = plain.withColumns(lists).where(F.size("x_node") > 0)
    among = among.select("node", "at", F.inline(F.arrays_zip("x_node", "x_at")))
    across = plain.join(crowded.select("key", F.col("node").alias("x_node"), F.col("at").alias("x_at")), "key")
    met = among.unionByName(across.select("node", "at", "x_node", "x_at"))
    met = met.where(F.col("node") != F.col("x_node"))
    # of two prefixes, the one that ends first has all common tokens up to there in the other: what is shared is at
    # most the tokens shared by the prefixes and the rest behind one of them
    n, x_n = F.shiftright("at", 24), F.shiftright("x_at", 24)
    sides = [F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")]
    found = met.select(*sides, (n + x_n).alias("total"), F.greatest(n, x_n).alias("larger"), rules.possible("at", "x_at").alias("possible"))
    found = found.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("m"), F.max("total").alias("total"), F.max("larger").alias("larger"), F.bool_or("possible").alias("possible")
    ).where("possible")
    most = F.col("m") + F.ceil(F.col("larger") * rules.percent / 100) - 1
    return found.where(most * (100 + rules.percent) >= rules.percent * F.col("total")).select("a", "b")


def crowded_index(crowd: DataFrame, rules: Settings) -> DataFrame:
    """Rows (key, node, at, c_node, c_at) for the keys that several crowded sets share, c being the first by rank."""
    each = crowd.select(F.explode("tokens").alias("token"))
    each = each.select(F.shiftleft(F.shiftright("token", COUNTED), COUNTED).alias("token"))
    common = crowd.sparkSession.sparkContext.broadcast(frequent(each, rules))
    rows = _crowded_rows(crowd.select("node", "tokens"), rules, common)
    best = [F.min_by(c, "rank").alias(f"c_{c}") for c in ("node", "at")]
    first = rows.groupBy("key").agg(*best, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.drop("rank").join(first, "key")


def crowded_rest(shared: DataFrame, roots: DataFrame, rules: Settings) -> DataFrame:
    """Pairs of crowded sets that meet under a key, can be alike and have different roots."""
    rooted = _with_roots(shared.drop("c_node", "c_at"), sent_if_small(roots), "node", "root")
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    # only rows of keys that hold several components are written again
    rooted = checkpointed(rooted.join(sent_if_small(checkpointed(several)), "key", "left_semi"))
    other = rooted.select("key", *[F.col(c).alias(f"x_{c}") for c in ("node", "at", "root")])
    met = rooted.join(other, "key").where("x_node < node and x_root <> root").where(rules.possible("at", "x_at"))
    return _as_pairs(met)


def near_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Settings = Settings()) -> DataFrame:
    """Rows (id, n_shingles, component_id), one per document."""
    spark = docs.sparkSession
    given = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).alias("text")
    )

    def window() -> Emit:
        def emit(found: np.ndarray, _: int):
            return None if not len(found) or rules.alone(len(found)) else (counted(found[: rules.window(len(found))]),)

        return emit

    common = spark.sparkContext.broadcast(frequent(_over_texts(given, rules, window, "token long"), rules))
    marks = checkpointed(marked(given, rules, common))
    nodes = marks.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("rk").alias("rk"), F.max("crowded").alias("crowded"))
    nodes = checkpointed(nodes)

    rows = _over_texts(given, rules, _plain_rows(rules, common), "key long, node long, at long, crowded boolean")
    pairs = checkpointed(plain_pairs(rows, rules))
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(met, "node", "left_semi").where("not crowded").union(nodes.where("crowded"))
    sets = checkpointed(sets_of(given, wanted, rules, common))

    shared = checkpointed(crowded_index(checkpointed(sets.where("crowded").dropDuplicates(["node"])), rules))
    star = shared.where("node <> c_node").where(rules.possible("at", "c_at"))
    star = checkpointed(star.select(F.col("c_node").alias("a"), F.col("node").alias("b")).distinct())
    roots = resolved(pairs.union(star), sets, rules)
    rest = checkpointed(crowded_rest(shared, roots, rules).join(star, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        roots = resolved(rest, sets, rules, roots)

    grouped = roots.join(nodes, "node").select("node", "root", "id")
    smallest = grouped.groupBy("root").agg(F.min("id").alias("least"))
    of_node = nodes.select("node", "id").join(grouped.join(smallest, "root").select("node", "least"), "node", "left")
    of_node = checkpointed(of_node.select("node", F.coalesce("least", "id").alias("component_id")))
    return marks.join(of_node, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
