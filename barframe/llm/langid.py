"""Language by multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts: every task counts into one array per language, and the arrays
are added up by (language, bucket). The log-probabilities, one row per language, are sent
to the tasks; their size is languages times buckets, and more than MOST_LANGUAGES are refused. A text's
score is the sum over its n-grams, taken for many texts at once: the n-grams of a block are hashed in numpy,
and the matrix is read at those buckets alone and summed by text.

n-grams are of lower-cased code points, 1 to 3 long, with each run of other characters than letters as
one space. The answer is the most probable language (of equals the first by name), its score the posterior
probability; "und" with score 0 for null texts, texts without a letter, and if nothing was learned.
Null languages teach nothing. Repeated rows are scored alike. Extra columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barframe.llm.common import checkpointed

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 128
UND = "und"
#: Characters that are scored at once, so that temporary arrays stay small.
BLOCK = 1 << 20
OTHERS = re.compile(r"[\W\d_]+")
#: Word characters that are neither letters nor digits, such as fractions and Roman numerals, to spaces.
NUMERALS = {ord(c): " " for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
#: Odd multipliers of the hash, one for each place in an n-gram.
MULTIPLIERS = tuple(np.uint32(m) for m in (2654435761, 2246822519, 3266489917))


def _plain(text: str) -> str:
    words = OTHERS.sub(" ", text.lower())
    if not words.replace(" ", "").isalpha():
        words = OTHERS.sub(" ", words.translate(NUMERALS))
    return f" {words.strip()} "


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _blocks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in blocks of some BLOCK characters, as (number of the text, part); the parts of a longer text overlap, so
    that every n-gram starts in the first BLOCK characters of one part."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        plain = _plain(text)
        for at in range(0, len(plain), BLOCK):
            if size >= BLOCK:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            part = plain[at : at + BLOCK + max(ORDERS) - 1]
            numbers.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, parts


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block and order of n-grams: which texts its parts are of, where those start, and the bucket of the
    n-gram at each character; BUCKETS where none of that part starts."""
    for numbers, parts in _blocks(texts):
        points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), dtype="<u4")
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        beyond = np.concatenate([np.arange(a + BLOCK, b) for a, b in zip(starts, ends) if b - a > BLOCK] or [starts[:0]])
        for n in ORDERS:
            mixed = np.full(len(points), n, dtype=np.uint32)
            for k in range(n):
                mixed[: len(points) - k] ^= points[k:]
                mixed *= MULTIPLIERS[k]
                mixed ^= mixed >> np.uint32(15)
            found = (mixed & np.uint32(BUCKETS - 1)).astype(np.int32)
            found[beyond] = BUCKETS
            for k in range(1, n):
                found[np.maximum(ends - k, starts)] = BUCKETS
            yield np.array(numbers), starts, found


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (lang, bucket, n) over all texts; bucket -1 counts the documents."""
    given = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one array for each language, written out when there are many
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                some = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some - 1, pa.int32()), pa.array(n[some])], ["lang", "bucket", "n"]
                )
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                if lang not in held:
                    if len(held) >= 64:
                        yield from out()
                    held[lang] = np.zeros(BUCKETS + 1, dtype=np.int64)
                own = batch.column(1).take(pa.array(np.nonzero(langs == lang)[0])).to_pylist()
                held[lang][0] += len(own)
                for _, _, found in buckets([t or "" for t in own]):
                    held[lang][1:] += np.bincount(found, minlength=BUCKETS + 1)[:BUCKETS]
        yield from out()

    partial = given.mapInArrow(run, "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """languages by name; matrix: log-probabilities, a row for each; prior: of each language."""

    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def posteriors(self, texts: list[str]) -> np.ndarray:
        total = np.tile(self.prior, (len(texts), 1))
        for numbers, starts, found in buckets(texts):
            for k in range(len(self.languages)):
                sums = np.add.reduceat(self.matrix[k][found], starts, dtype=np.float64)
                np.add.at(total[:, k], numbers, sums)
        total -= total.max(axis=1, keepdims=True)
        odds = np.exp(total)
        return odds / odds.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        able = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if able:
            chances = self.posteriors([texts[i] for i in able])
            best = chances.argmax(axis=1)
            for i, row, b in zip(able, chances, best):
                langs[i], scores[i] = self.languages[b], float(row[b])
        return langs, scores


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.5) -> Model:
    found = checkpointed(counts(docs, lang_col, text_col))
    languages = sorted(r[0] for r in found.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: their matrix is too large to send to all tasks")
    n = np.zeros((len(languages), BUCKETS + 1))
    for part in found.toArrow().to_batches():
        lang = np.searchsorted(np.array(languages), np.array(part.column("lang").to_pylist(), dtype=str))
        n[lang, part.column("bucket").to_numpy() + 1] = part.column("n").to_numpy()
    # the last bucket stands for no n-gram at all
    matrix = np.zeros((len(languages), BUCKETS + 1), dtype=np.float32)
    if not languages:
        return Model(languages, matrix, np.zeros(0))
    seen = n[:, 1:] + smoothing
    matrix[:, :-1] = np.log(seen / seen.sum(axis=1, keepdims=True))
    return Model(languages, matrix, np.log((n[:, 0] + 1) / (n[:, 0] + 1).sum()))


def identify(docs: DataFrame, model: Model, text_col: str = "text", carried: Column | None = None) -> DataFrame:
    """Rows (row, lang_pred, score); row is the carried column."""
    given = docs.select(F.col(text_col).alias("text"), (F.struct("*") if carried is None else carried).alias("row"))
    schema = T.StructType([given.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.matrix, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                langs, scores = own.predict([t.as_py() for t in part.column(0)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"]
                )

    return given.mapInArrow(run, schema)
