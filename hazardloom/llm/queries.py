"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontamination, grammar, html_extract, mixing, near_dedup, oracles, periodic_runs, quality_rules, scoring, sharding,
    suffix_dedup, url_filter, vector_codes, warc,
)
from .shared import read

#: Fixed rules of the URL query: host, path, action.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(read(spark, sf_dir, "documents"))


def op4_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(read(spark, sf_dir, "pages"), rules)


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op8_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(read(spark, sf_dir, "documents"))


def op9_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.encode_and_read(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"))


def op11_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periodic_tails(read(spark, sf_dir, "documents"))
    return periodic_runs.summary(periodic_runs.find(docs))


def op12_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    codebooks = vector_codes.fit(vectors)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, codebooks))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks.digest()))


def op13_tree_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_extract.main_text(html_extract.extract(pages, html_extract.fit(pages)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_line_frequency, op2_pivotal_mix, op3_bloom_lm, op4_prefix_decontamination, op5_url_rules, op6_warc_salvage,
        op7_bagminhash, op8_sparse_suffixes, op9_repair_ids, op10_hilbert_shards,
        op11_kruskal_runs, op12_orchard_codes, op13_tree_extract, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
