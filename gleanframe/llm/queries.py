"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles
from . import (code_bounds, context_trees, fingerprints, jaccard, mixing, pieces, prefix_forest, quality, repeats, secrets, sharding,
               spelling, urls)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_divergence_quality": oracles.quality_sql(), "op11_reduced_alphabet": oracles.spelling_sql()}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op4_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = sharding.shard_documents(documents(spark, folder))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                          F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                          F.col("curve").alias("curve_index"))


@query
def op7_block_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix_sources(mixing.document_words(documents(spark, folder)))
    return mix.rows.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_summaries(documents(spark, folder))


#: The contract's rules.
URL_RULES = (urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
             urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"))


@query
def op3_url_boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES)


@query
def op5_grammar_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, folder))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")


@query
def op6_chunk_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_likeness(documents(spark, folder))


@query
def op1_divergence_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_quality(documents(spark, folder))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@query
def op10_count_tree_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, folder))


@query
def op8_context_tree_weighting(spark: SparkSession, folder: str) -> DataFrame:
    return context_trees.score_documents(documents(spark, folder))


@query
def op2_run_length_index(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, folder)).drop("spans")


@query
def op11_reduced_alphabet(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder), damage=97)


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


@query
def op12_adaptive_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return code_bounds.code_vectors(embeddings(spark, folder)).rows


@query
def op13_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_forest.nearest(embeddings(spark, folder))
