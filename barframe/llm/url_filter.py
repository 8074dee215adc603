"""URL rules by a sort-merge range join over reversed hosts.

A rule (host, path) fits its host and all hosts below it, for paths that start with its own. In the canonical
key of a host its labels are reversed (``com.example.www``), so the hosts above it are the key's beginnings;
each judged (host, path) is set beside those of them that carry rules, found by an equal join. There a rule is
an interval of keys: everything that starts with its path. Intervals of one host are nested or apart.

* A sweep over the ends of the intervals counts how many are open: a rule's depth.
* A sweep over rules and judged paths in key order keeps the stack: the last rule opened at each depth. One that is
  still open at a judged path is a beginning of it; the deepest of those is the longest rule of that host.

The longest rule of all hosts wins; of equal length the one of the longer host; of rules that are given twice
"block" wins. Equal (host, path) are judged once. A host with many paths is dealt over slices, each
with all rules of the host.

A null url, or one without ``://``, has empty host and path. Without a fitting rule the verdict is the default. Null
ids and repeated rows are judged as they are. Extra columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: host and path of an allow or block list, and its verdict
Rule = tuple[str, str, str]

#: So many judged paths of a host make a slice.
SLICE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _depths(rules: DataFrame) -> DataFrame:
    """Rules with their depth: how many rules of the host open at or before them and are still open."""
    # the byte 0xFF is in no UTF-8 text: with it, an end comes after everything that starts with the path
    path = F.col("path").cast("binary")
    ends = rules.select("node", "path", F.concat(path, F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("opens"))
    starts = rules.select("node", "path", path.alias("key"), F.lit(1).alias("opens"))
    sweep = Window.partitionBy("node").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    counted = starts.union(ends).withColumn("depth", F.sum("opens").over(sweep))
    return rules.join(counted.where("opens = 1").select("node", "path", "depth"), ["node", "path"])


def verdicts(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, path, rule, verdict) of those different (host, path) that a rule fits."""
    rules = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(reversed_host(F.translate("host", UPPER, LOWER)).alias("node"), "path")
        .agg(F.max("verdict").alias("verdict"), F.min(F.translate("host", UPPER, LOWER)).alias("rule_host"))
    )
    deep = _depths(rules)
    labels = F.size(F.split("node", r"\."))
    most = deep.agg(F.max(labels), F.max("depth")).first()
    most_labels, most_depth = most[0] or 0, most[1] or 0
    key = F.split(reversed_host(F.col("host")), r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.least(F.size("key"), F.lit(max(1, most_labels)))),
        lambda k: F.array_join(F.slice("key", 1, k), "."),
    )
    nodes = rules.select("node").distinct()
    met = (
        targets.withColumn("key", key)
        .select("host", "path", F.explode(above).alias("node"))
        .join(nodes, "node")
        .withColumn("hashed", F.xxhash64("host", "path"))
    )
    slices = met.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices"))
    last = (F.col("slices") - 1).cast("int")
    dealt_rules = deep.join(slices, "node").select(
        "node",
        F.explode(F.sequence(F.lit(0), last)).alias("slice"),
        F.lit(None).cast("string").alias("host"),
        "path",
        F.struct("rule_host", "path", "verdict").alias("rule"),
        "depth",
    )
    dealt = met.join(slices, "node").select(
        "node",
        F.pmod("hashed", "slices").cast("int").alias("slice"),
        "host",
        "path",
        F.lit(None).cast(dealt_rules.schema["rule"].dataType).alias("rule"),
        F.lit(None).cast("bigint").alias("depth"),
    )
    # at equal keys the rule comes first, as it fits
    sweep = Window.partitionBy("node", "slice").orderBy(F.col("path").cast("binary"), F.col("rule").isNull())
    so_far = sweep.rowsBetween(Window.unboundedPreceding, 0)
    events = dealt_rules.union(dealt)
    stack = [
        F.last(F.when(F.col("depth") == k, F.col("rule")), ignorenulls=True).over(so_far).alias(f"open{k}")
        for k in range(1, most_depth + 1)
    ]
    swept = events.select("host", "path", "rule", *stack).where("rule is null")
    fitting = [
        F.when(F.startswith(F.col("path"), F.col(f"open{k}.path")), F.col(f"open{k}")) for k in range(most_depth, 0, -1)
    ]
    deepest = F.coalesce(*fitting) if fitting else F.lit(None).cast(dealt_rules.schema["rule"].dataType)
    found = swept.withColumn("found", deepest).where("found is not null")
    text = F.concat("found.rule_host", "found.path")
    ranked = F.struct(
        F.length(text).alias("length"), F.length("found.rule_host").alias("host_length"), text.alias("rule"), F.col("found.verdict").alias("verdict")
    )
    return found.groupBy("host", "path").agg(F.max(ranked).alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one per page; rule is null where the default holds."""
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = verdicts(parsed.select("host", "path").distinct(), rules).select(
        F.col("host").alias("v_host"), F.col("path").alias("v_path"), "rule", "verdict"
    )
    same = (F.col("host") == F.col("v_host")) & (F.col("path") == F.col("v_path"))
    return parsed.join(judged, same, "left").select(
        "id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
