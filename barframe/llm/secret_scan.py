"""Secret scans: a random forest takes the false positives out of candidate strings.

Candidates are runs of 16 or more of the characters that keys and tokens are made of, and right after a name like key
or token and an assignment any 8 or more characters but spaces, quotes and separators. The forest judges them by
length, changes between character classes, the share of digits, capitals and different characters, the share
that dictionary words cover (words of four letters or more that at least DICTIONARY documents of the
corpus have, counted over all documents), the path, and whether a word follows. It is trained on labelled findings, of
each label a bounded sample that hashes first (``sample`` rows).

Where no one has judged the findings, what stands before them labels some: those set to a name like key or token are
secrets, those of dictionary words or plain digits without such a name are not; all others stay without a label.
The flags of that context (CONTEXT) are no features, so the forest has to tell secrets by themselves. Without findings
of both labels, those with a label get it as score, all others 0.5.

Null texts have no candidates. Repeated rows give their findings each. A null path counts as empty.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.common import checkpointed

_NAMES = "key|token|secret|passw|pwd|auth|bearer|credential"
#: What sets a value, on the way to it.
_SETS = r"[=:]\s{0,2}[\"'`]?"
#: The value of a name like key or token; the short look back comes first, as it fails fast.
_NAMED = rf"(?<={_SETS})(?<=(?i:{_NAMES})[\w.-]{{0,20}}[\"'`]?\s{{0,2}}{_SETS})[^\s\"'`<>,;]{{8,}}"
CANDIDATE = rf"{_NAMED}|(?<![\p{{L}}\p{{N}}+/_-])[A-Za-z0-9+/_-]{{16,}}={{0,2}}(?![\p{{L}}\p{{N}}=])"
LETTERS = "[A-Za-z]{4,}"
DICTIONARY = 3
#: Where one class of characters follows another.
CHANGE = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
NAMES = f"(?i)({_NAMES})"
TRIAL_PATH = r"(?i)(test|example|sample|mock|doc)"
FEATURES = [
    "length", "changes", "digits", "capitals", "variety", "hex", "covered",
    "path_depth", "path_trial", "path_kind", "after_word",
]
#: From these come labels, so the forest does not see them.
CONTEXT = ["before_name", "before_sets", "before_quote", "after_quote"]
#: A candidate that dictionary words cover to this share is taken for words.
WORDS = 0.5


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Rows (id, start, candidate, path, before, after): start counts characters, before and after are
    what stands next to it on the way to the neighbouring candidates, up to 40 characters."""
    found = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"),
        F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0)).alias("found"),
    ).where("size(found) > 0")
    # a number for each row, so that repeated rows are told apart
    between = found.withColumn("row", F.monotonically_increasing_id()).withColumn("between", F.split("text", CANDIDATE))
    each = between.select("id", "row", "path", "between", F.posexplode("found").alias("k", "candidate"))
    each = each.select(
        "id", "row", "path", "k", "candidate",
        F.get("between", F.col("k")).alias("left"),
        F.get("between", F.col("k") + 1).alias("right"),
    )
    earlier = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.sum(F.length("left") + F.length("candidate")).over(earlier)
    return each.select(
        "id", (F.coalesce(passed, F.lit(0)) + F.length("left")).alias("start"), "candidate", "path",
        F.right("left", F.lit(40)).alias("before"), F.left("right", F.lit(40)).alias("after"),
    )


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word): of at least DICTIONARY documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(LETTERS.replace("A-Z", "")), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DICTIONARY).select("word")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """The findings with FEATURES and CONTEXT."""
    c = F.col("candidate")
    length = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / length
    kinds = found.select("candidate").distinct()
    runs = kinds.select("candidate", F.explode(F.regexp_extract_all(F.lower(c), F.lit(LETTERS), F.lit(0))).alias("word"))
    covered = runs.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("in_words"))
    covered = covered.withColumnRenamed("candidate", "c_candidate")
    flag = lambda text, pattern: F.rlike(text, F.lit(pattern)).cast("double")
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    return found.join(covered, c == F.col("c_candidate"), "left").select(
        *found.columns,
        length.cast("double").alias("length"),
        (F.regexp_count(c, F.lit(CHANGE)) / length).alias("changes"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("capitals"),
        (F.size(F.array_distinct(F.split(c, ""))) / length).alias("variety"),
        flag(c, "^([0-9a-f]+|[0-9A-F]+)$").alias("hex"),
        (F.coalesce("in_words", F.lit(0)) / length).alias("covered"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        flag(F.col("path"), TRIAL_PATH).alias("path_trial"),
        F.pmod(F.xxhash64(F.regexp_extract("path", r"([^./]*)$", 1)), F.lit(8)).cast("double").alias("path_kind"),
        flag(before, NAMES).alias("before_name"),
        flag(before, r"([=:]\s*[\"'`]?|(?i:bearer)\s+)$").alias("before_sets"),
        flag(before, r"[\"'`]$").alias("before_quote"),
        flag(after, r"^[\"'`]").alias("after_quote"),
        flag(after, r"^\s+\p{L}+").alias("after_word"),
    )


def judged(features: DataFrame, labelled: DataFrame, sample: int = 10_000, trees: int = 20, depth: int = 6) -> DataFrame:
    """The findings with score: the forest's share for label 1. labelled: rows with FEATURES and label 0, 1 or null.

    If not both labels occur, there is no forest: score is the findings' own label where they have one, or else 0.5.
    """
    order = F.xxhash64("candidate", "before", "after")
    some = checkpointed(
        labelled.where("label = 1").orderBy(order).limit(sample).union(labelled.where("label = 0").orderBy(order).limit(sample))
    )
    shares = some.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
    if not shares["n"] or shares["share"] in (0.0, 1.0):
        own = F.col("label").cast("double") if "label" in features.columns else F.lit(None).cast("double")
        return features.withColumn("score", F.coalesce(own, F.lit(0.5)))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=42, probabilityCol="_chances"
    )
    model = forest.fit(assemble.transform(some.withColumn("label", F.col("label").cast("double"))))
    out = model.transform(assemble.transform(features))
    return out.withColumn("score", vector_to_array("_chances")[1]).select(*features.columns, "score")


def assigned_value() -> Column:
    """A label where no one has judged the findings, from CONTEXT: 1 for values that are set to a name like key or token,
    quoted or not; 0 for words and plain digits without one; null where neither or both speak."""
    set_to_name = (F.col("before_name") + F.col("before_sets")) == 2
    plain = (F.col("covered") >= WORDS) | (F.col("digits") == 1)
    return F.when(set_to_name & ~plain, 1).when(~set_to_name & plain, 0).cast("int")


def scan(docs: DataFrame, labels: Column | None = None, **names: str) -> DataFrame:
    """Rows (id, start, candidate, path, before, after, FEATURES, CONTEXT, score) of all findings."""
    features = checkpointed(described(findings(docs, **names), dictionary(docs, names.get("text_col", "text"))))
    labelled = features.withColumn("label", assigned_value() if labels is None else labels)
    return judged(labelled, labelled).drop("label")
