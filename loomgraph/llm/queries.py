"""The registered queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).withColumn("too_long", F.col("longest_repeat") > 200).drop("longest_repeat")


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k_search

    return top_k_search(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), digest=True)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, as_text, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_passages=False)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    places = F.transform("base", lambda b: b["at"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), "base_labels", "labels", "score"
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_top_k_search": op2_top_k_search,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_mix_sources": op6_mix_sources,
    "op7_simhash": op7_simhash,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_source_divergence": op12_source_divergence,
    "op13_license_scan": op13_license_scan,
}
