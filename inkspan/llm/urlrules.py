"""URL rules by hash prefix, in DataFrame functions only.

Every URL is expanded into expressions, one for each suffix of its host and
each prefix of its path that a rule can have.  An expression's SHA-256 meets
the rules' by an equi-join on the first four bytes; then the full digest has to
agree.  Of the rules that fit, the longest decides.

A rule fits its host and all subdomains, if the URL's path starts with the
rule's.  Ties in length (which need two rules of one text) are block first.

Edge cases: a null URL or one without "://" has an empty host and path and no
rule; URLs without a fitting rule get the default verdict; repeated rows come
back as often as they came; null page_ids are kept; an empty table or rule
table works; of the pages only the key and url are read, so other columns can
have any names; letters other than A-Z keep their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Rules are broadcast up to so many bytes (their texts, digests and some for each row); a larger table is shuffled, with the hot expressions of the URLs salted.
BROADCAST_BYTES, RULE_BYTES = 32 << 20, 160
SALTS = 32


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table of rules."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = ALLOW) -> DataFrame:
    """key, url, host, path, rule and verdict of every row."""
    spark = pages.sparkSession
    rules = (
        rules.select(lower_ascii(F.coalesce("rule_host", F.lit(""))).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "rule_verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # block sorts after allow
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", _short(F.col("full")))
    )
    labels_of = F.size(F.split("rule_host", r"\.", -1))
    facts = rules.agg(F.coalesce(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + RULE_BYTES), F.lit(0)).alias("bytes"), F.collect_set(F.length("rule_path")).alias("lengths"), F.collect_set(labels_of).alias("labels")).first()
    urls = pages.select(F.col(key).alias("key"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths, counts = (F.array(*(F.lit(int(n)).cast("int") for n in sorted(facts[k]))) if facts[k] else F.array().cast("array<int>") for k in ("lengths", "labels"))
    labels = F.split("host", r"\.", -1)
    # only suffixes and prefixes as long as some rule's, so a host of thousands of labels has few
    suffixes = F.transform(F.filter(counts, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))
    # a first expression that fits no rule keeps every row, and counts it
    met = urls.select("key", "url", "host", "path", F.posexplode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))), F.when(F.col("host") != "", expressions).otherwise(F.filter(expressions, lambda x: F.lit(False))))).alias("i", "x"))
    met = met.withColumn("digest", _digest(F.col("x.host"), F.col("x.path"))).withColumn("head", _short(F.col("digest")))
    if facts["bytes"] <= BROADCAST_BYTES:
        joined = met.join(F.broadcast(rules), F.col("head") == F.col("short"), "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = met.withColumn("own_salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).withColumn("head", F.coalesce("head", F.xxhash64("key", "url")))
        joined = met.join(salted, (F.col("head") == F.col("short")) & (F.col("own_salt") == F.col("salt")), "left")
    fits = F.when(F.col("digest") == F.col("full"), F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")))
    best = joined.groupBy("key", "url", "host", "path").agg(F.max(fits).alias("best"), F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("times"))
    rows = best.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return rows.select(F.col("key").alias(key), "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
