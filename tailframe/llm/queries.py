"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brownlm, lexrank, mixing, quality, secretscan, sharding, simhash, tokencount, urlfilter, variants, vecdedup, wrapper
from .common import read_table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brownlm.score_texts(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"), urlfilter.RULES, keep=["page_id"])


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    weights = quality.train(documents, read_table(spark, sf_dir, "labels"))
    return quality.judge(documents, weights, keep=["doc_id"])


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can say: the counts and the base rules, with the prior's weights."""
    judged = quality.judge(read_table(spark, sf_dir, "documents"), quality.prior().tolist(), keep=["doc_id"])
    return judged.drop("content_share", "kept")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(read_table(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(secretscan.find_secrets(read_table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe_round_trip, op3_brown_lm, op4_url_filter, op5_vector_dedup, op6_line_quality, quality_base_rules, op7_main_text, op8_source_mix, op9_feistel_shards, op10_simhash, op11_secret_scan, op12_lexical_search, op13_spelling_variants, pipeline)}

ORACLES = {
    "op4_url_filter": urlfilter.oracle(),
    "op5_vector_dedup": vecdedup.oracle(),
    "quality_base_rules": quality.base_oracle(),
    "op8_source_mix": mixing.oracle(),
    "op11_secret_scan": secretscan.oracle(),
    "op12_lexical_search": lexrank.oracle(),
    "op13_spelling_variants": variants.oracle(),
}
