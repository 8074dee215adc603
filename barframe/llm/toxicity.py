"""Toxic spans by a linear-chain conditional random field of two tags.

Documents carry labels, tokens do not; so a bounded sample of labelled documents is tagged first: token
features (the word and its beginnings) are picked greedily, each time the one that covers the most toxic
documents not yet covered, if it occurs in almost no clean document. Tokens with a picked feature in a
toxic document are toxic. The field is trained on segments of those documents by gradient steps on the
exact likelihood (forward-backward), with hashed features.

Every whole text is then scored: forward-backward marginals of all its tokens, for a
block of documents at a time. The document's score is the chance that at least one of its few most likely toxic
tokens is toxic; runs of tokens with marginals of a half or more are the offending spans.

Bounds: ``sample`` documents of each label, of at most ``sample_chars`` characters each, are learned from, by at most
``segments`` segments of SEGMENT tokens with toxic tokens, as many close to them and as many clear ones; they
and the model (2^18 weights) are all that is sent to or from the driver. Rows without label, text or id
teach nothing; of several labels of an id the largest counts. Without toxic examples every score is low.
Null and empty texts are scored as texts without tokens. Repeated rows are scored alike. Extra columns are carried
along. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 18
BEGINNINGS = (3, 4, 5, 6, 7, 8)
SEGMENT = 48
#: Beyond the cover, a feature must occur in so many toxic documents.
SURE = 8
#: At most so many segments with toxic tokens, and so many of either kind without, are trained on if ``segments`` is not given.
SEGMENTS = 2000
#: Of the most likely tokens so many make the score.
TOP = 3
#: Tokens are runs of ASCII letters and of bytes above them, ASCII letters in lower case.
TOKEN = re.compile("[A-Za-z\x80-\U0010ffff]+")
_KEPT = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Odds are kept between this and its inverse.
TINY = 1e-30


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().translate(_KEPT).split()


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings where they are shorter."""
    text = word.decode("utf-8", "replace")
    return [b"=" + word, *(b"^" + text[:k].encode() for k in BEGINNINGS if len(text) > k)]


def hashed(word: bytes) -> list[int]:
    return [crc32(f) & ((1 << BITS) - 1) for f in features(word)]


def picked_features(toxic: list[set[bytes]], clean: list[set[bytes]]) -> set[bytes]:
    """A greedy cover of the toxic documents by features that occur in almost no clean one, and all
    features that tell toxic documents as well as those of the cover do."""
    least = max(2, len(toxic) // 200)
    frequent = {w for w, n in Counter(w for doc in toxic for w in doc).items() if n >= least}
    begun = Counter(f for doc in toxic for f in {f for w in doc for f in features(w)[1:]})
    able = {b"=" + w for w in frequent} | {f for f, n in begun.items() if n >= least}
    known: dict[bytes, list[bytes]] = {}

    def found_in(doc: set[bytes]) -> set[bytes]:
        for w in doc:
            if w not in known:
                known[w] = [f for f in features(w) if f in able]
        return {f for w in doc for f in known[w]}

    in_toxic: dict[bytes, set[int]] = {}
    for i, doc in enumerate(toxic):
        for f in found_in(doc):
            in_toxic.setdefault(f, set()).add(i)
    in_clean = Counter(f for doc in clean for f in found_in(doc))
    # in proportion, a feature may occur in one clean document for every twenty-five toxic ones
    ratio = max(1, len(clean)) / max(1, len(toxic))
    good = {f: docs for f, docs in in_toxic.items() if in_clean[f] <= len(docs) * ratio / 25}
    chosen: set[bytes] = set()
    left, open_docs = dict(good), set(range(len(toxic)))
    while open_docs and left:
        best = max(left, key=lambda f: (len(left[f] & open_docs), len(left[f]), len(f), f))
        covered = left.pop(best) & open_docs
        if len(covered) < least:
            break
        chosen.add(best)
        open_docs -= covered
        left = {f: docs for f, docs in left.items() if len(docs & open_docs) >= least}
    sizes = sorted(len(good[f]) for f in chosen)
    usual = sizes[len(sizes) // 2] / 2 if sizes else len(toxic) + 1
    return chosen | {f for f, docs in good.items() if len(docs) >= max(usual, least, SURE)}


def _step(odds: np.ndarray, own: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Odds of toxic after a token, from those before it: the two-tag recursion as one fraction."""
    return own * (trans[0, 1] + odds * trans[1, 1]) / (trans[0, 0] + odds * trans[1, 0])


class Field:
    """Weights of hashed features for the toxic tag, and of transitions (from, to); clean starts and clean
    tokens weigh 0."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans
        self.known: dict[bytes, float] = {}

    def own(self, word: bytes) -> float:
        """The token's odds by its features alone."""
        if (score := self.known.get(word)) is None:
            if len(self.known) >= 500_000:
                self.known.clear()
            score = float(np.exp(np.clip(self.weights[hashed(word)].sum(), -30, 30)))
            self.known[word] = score
        return score

    def marginals(self, documents: list[list[bytes]]) -> list[np.ndarray]:
        """Of each token, the chance of toxic given its whole document."""
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        lengths = np.array([len(documents[i]) for i in order], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.fromiter((self.own(w) for i in order for w in documents[i]), dtype=np.float64, count=int(starts[-1]))
        trans = np.exp(self.trans)
        ahead, back = np.empty_like(flat), np.ones_like(flat)
        longest = int(lengths[0]) if len(lengths) else 0
        # documents that have a token t are the first ones
        alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
        odds = None
        for t in range(longest):
            at = starts[: alive[t]] + t
            own = flat[at]
            odds = own if t == 0 else _step(odds[: alive[t]], own, trans)
            odds = np.clip(odds, TINY, 1 / TINY)
            ahead[at] = odds
        # behind: what the tokens after one say, as odds toxic against clean
        behind = np.ones(len(lengths))
        for t in range(longest - 2, -1, -1):
            n = alive[t + 1]
            at = starts[:n] + t
            after = np.clip(flat[at + 1] * behind[:n], TINY, 1 / TINY)
            behind[:n] = (trans[1, 0] + trans[1, 1] * after) / (trans[0, 0] + trans[0, 1] * after)
            back[at] = behind[:n]
        both = ahead * back
        chances = both / (1 + both)
        out: list[np.ndarray] = [np.empty(0)] * len(documents)
        for k, i in enumerate(order):
            out[i] = chances[starts[k] : starts[k + 1]]
        return out


def _segments(docs: list[tuple[list[bytes], list[int]]]) -> tuple[list[list[bytes]], list[list[int]]]:
    words, tags = [], []
    for w, t in docs:
        for at in range(0, len(w), SEGMENT):
            words.append(w[at : at + SEGMENT])
            tags.append(t[at : at + SEGMENT])
    return words, tags


def train(
    examples: list[tuple[str, int]], steps: int = 40, rate: float = 1.0, decay: float = 1e-4, segments: int = SEGMENTS
) -> Field:
    """examples: (text, 0 or 1). At most ``segments`` segments with toxic tokens, close ones and those without are trained on."""
    toxic = [t for t in (tokens(text) for text, y in examples if y) if t]
    clean = [t for t in (tokens(text) for text, y in examples if not y) if t]
    chosen = picked_features([set(t) for t in toxic], [set(t) for t in clean])
    verdict: dict[bytes, int] = {}

    def tag(word: bytes) -> int:
        if word not in verdict:
            verdict[word] = int(any(f in chosen for f in features(word)))
        return verdict[word]

    words, tags = _segments([(t, [tag(w) for w in t]) for t in toxic] + [(t, [0 * tag(w) for w in t]) for t in clean])
    # segments with toxic tokens, those without whose tokens share a feature with toxic ones, and others
    suspect = {f for w, y in verdict.items() if y for f in features(w)}
    alike = {w: not suspect.isdisjoint(features(w)) for w in verdict} if suspect else {}
    marked = [i for i, t in enumerate(tags) if any(t)]
    clear = [i for i, t in enumerate(tags) if not any(t)]
    close = [i for i in clear if any(alike.get(w) for w in words[i])]
    keep = [x for part in (marked, close, clear) for x in part[:: max(1, -(-len(part) // segments))]]
    weights, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    if not keep:
        return Field(weights - 8, trans)
    n, longest = len(keep), max(len(words[i]) for i in keep)
    real = np.zeros((n, longest), dtype=bool)
    gold = np.zeros((n, longest), dtype=np.int64)
    number: dict[bytes, int] = {}
    kind = np.zeros((n, longest), dtype=np.int64)
    for r, i in enumerate(keep):
        real[r, : len(words[i])] = True
        gold[r, : len(words[i])] = tags[i]
        kind[r, : len(words[i])] = [number.setdefault(w, len(number)) for w in words[i]]
    # the features of each distinct word, flat
    each = [hashed(w) for w in number]
    of_word = np.repeat(np.arange(len(each)), [len(f) for f in each])
    feature = np.concatenate([np.array(f) for f in each])
    first = np.concatenate([[0], np.cumsum([len(f) for f in each])[:-1]])
    length = real.sum(axis=1)
    seen, seen_trans = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8)
    pair = real[:, 1:]
    gold_trans = np.zeros((2, 2))
    np.add.at(gold_trans, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
    for _ in range(steps):
        own = np.exp(np.clip(np.add.reduceat(weights[feature], first), -30, 30))[kind]
        power = np.exp(trans)
        # scaled forward and backward messages of both tags
        local = np.stack([np.ones_like(own), own], axis=2)
        ahead, back = np.empty_like(local), np.ones_like(local)
        ahead[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            x = (ahead[:, t - 1] @ power) * local[:, t]
            ahead[:, t] = x / x.sum(axis=1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            x = (back[:, t + 1] * local[:, t + 1]) @ power.T
            x /= x.sum(axis=1, keepdims=True)
            back[:, t] = np.where((t + 1 < length)[:, None], x, 1.0)
        both = ahead * back
        chance = both[..., 1] / both.sum(axis=2)
        joint = ahead[:, :-1, :, None] * power * (back * local)[:, 1:, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        error = np.where(real, gold - chance, 0.0)
        by_word = np.bincount(kind.ravel(), error.ravel(), len(number))
        slope = np.bincount(feature, by_word[of_word], 1 << BITS) / n - decay * weights
        slope_trans = (gold_trans - joint[pair].sum(axis=0)) / n - decay * trans
        slope_trans[0, 0] = 0.0
        seen += slope**2
        seen_trans += slope_trans**2
        weights += rate * slope / np.sqrt(seen)
        trans += rate * slope_trans / np.sqrt(seen_trans)
    return Field(weights, trans)


def score(chances: np.ndarray) -> float:
    """That at least one of the few most likely tokens is toxic; 0 without tokens."""
    most = np.partition(chances, len(chances) - TOP)[-TOP:] if len(chances) > TOP else chances
    return float(1 - np.prod(1 - most))


def spans(text: str, chances: np.ndarray) -> list[tuple[int, int]]:
    """Offsets (from, to) in characters of runs of toxic tokens."""
    found: list[tuple[int, int]] = []
    joined = False
    for m, p in zip(TOKEN.finditer(text), chances):
        if p < 0.5:
            joined = False
        elif joined:
            found[-1] = (found[-1][0], m.end())
        else:
            found.append(m.span())
            joined = True
    return found


def learn(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 2000,
    sample_chars: int = 20_000,
    segments: int = SEGMENTS,
) -> Field:
    """The field, trained on ``sample`` documents of each label that hash first. usable: which ids may teach."""
    label = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if usable is not None:
        label = label.where(usable)
    label = label.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    short = docs.where(F.length(text_col).between(1, sample_chars)).select(F.col(id_col).alias("id"))
    at_hand = label.join(short, "id", "left_semi")
    order = [F.xxhash64("id"), F.col("id")]
    some = at_hand.where("y = 0").orderBy(*order).limit(sample).union(at_hand.where("y = 1").orderBy(*order).limit(sample))
    given = docs.where(F.length(text_col).between(1, sample_chars)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # of rows with the same id one teaches
    texts = given.join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = texts.orderBy("id").collect()
    return train([(r["text"], r["y"]) for r in rows], segments=segments)


def scored(docs: DataFrame, field: Field, text_col: str = "text", carried: Column | None = None) -> DataFrame:
    """Rows (row, score, spans): row is the carried column, spans the offending offsets in characters."""
    given = docs.select(F.col(text_col).alias("text"), (F.struct("*") if carried is None else carried).alias("row"))
    span = T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])
    schema = T.StructType([given.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    sent = docs.sparkSession.sparkContext.broadcast((field.weights.astype(np.float32), field.trans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t.as_py() or "" for t in part.column(0)]
                chances = model.marginals([tokens(t) for t in texts])
                found = [spans(t, p) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, chances)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1),
                        pa.array([score(p) for p in chances], pa.float64()),
                        pa.array([[{"from": a, "to": b} for a, b in f] for f in found], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                    ],
                    ["row", "score", "spans"],
                )

    return given.mapInArrow(run, schema)

