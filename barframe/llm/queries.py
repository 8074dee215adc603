"""One query for each corpus operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barframe.llm import digest, exact_dedup, jaccard, langid, line_dedup, manifest, mixing, packing, secret_scan, simhash, toxicity, url_filter, whitening
from barframe.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, d, "documents"), shingle=3, max_bits=2)
    return groups.select(
        F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "links"
    )


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return url_filter.judge(pages, url_filter.rule_table(spark, RULES)).withColumnRenamed("id", "page_id")


OP2_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, RULES))}),
parsed AS (
  SELECT page_id, position('://' IN url) AS start, substr(url, position('://' IN url) + 3) AS rest FROM pages
), judged AS (
  SELECT page_id,
    CASE WHEN start > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN start > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parsed
)
SELECT page_id, host, path,
  (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r
   WHERE (j.host = r.host OR suffix(j.host, '.' || r.host)) AND starts_with(j.path, r.path)) AS rule,
  coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r
   WHERE (j.host = r.host OR suffix(j.host, '.' || r.host)) AND starts_with(j.path, r.path)), 'allow') AS verdict
FROM judged j
"""


def op3_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(table(spark, d, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"),
        "score", (F.col("score") >= 0.5).alias("kept"),
    )


def toxic_field(spark: SparkSession, docs: DataFrame, d: str) -> toxicity.Field:
    return toxicity.learn(docs, table(spark, d, "labels"), usable=fold(5) != 0)


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    scored = toxicity.scored(
        docs, toxic_field(spark, docs, d), carried=F.struct("doc_id", held_out.alias("held_out"))
    )
    return scored.select("row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op5_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    groups = exact_dedup.copy_groups(table(spark, d, "documents"), keep="largest", carried=sha)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("row").alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
       doc_id = max(doc_id) OVER copies AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))
"""


def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    cleaned = line_dedup.without_repeated_lines(table(spark, d, "documents"), smallest=4)
    return cleaned.select(
        F.col("id").alias("doc_id"), "lines", "dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text"
    )


def op7_langid(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = langid.learn(docs.where(fold(3) != 1))
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    return langid.identify(docs, model, carried=F.struct("doc_id", held_out.alias("held_out"))).select(
        "row.*", "lang_pred", "score"
    )


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    taken = mixing.mix(table(spark, d, "documents"))
    return taken.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def op10_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return digest.digests(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def op11_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_manifest(spark: SparkSession, d: str) -> DataFrame:
    made = manifest.manifest(table(spark, d, "documents"), tampered={"n_chars": F.col("n_chars") + 1}, where=fold(7) == 0)
    return made.withColumnRenamed("id", "doc_id")


def op13_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.near_sets(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_langid": op7_langid,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_fingerprint": op10_fingerprint,
    "op11_whitening": op11_whitening,
    "op12_manifest": op12_manifest,
    "op13_ngram_join": op13_ngram_join,
}

ORACLES = {"op2_url_filter": OP2_SQL, "op5_exact_dedup": OP5_SQL}
