"""The registered queries of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.sources.tables import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.htmltext import extract_pages

    return extract_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.decontaminate import find_leaks

    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.licenses import scan_licenses

    found = scan_licenses(_documents(spark, sf_dir))
    return found.select("doc_id", "start", "end", "license", "template", "saving", F.array_join("lacks", " ").alias("lacks"), F.array_join("beyond", " ").alias("beyond"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.fingerprints import fingerprints

    return fingerprints(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.idfiles import token_files

    return token_files(_documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.ngramjoin import components

    return components(_documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.quality import resample

    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The rules of the URL query: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkspan.llm.urlrules import judge_urls, rule_table

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rests),
urls AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM parts),
fits AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) f USING (n)
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_license_scans": op4_license_scans,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_token_files": op6_token_files,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_rules": op9_url_rules,
    "op10_toxicity": op10_toxicity,
}

ORACLES = {"op9_url_rules": OP9_SQL}
