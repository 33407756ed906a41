"""A corpus from raw documents to token ids: quality rules, SimHash near-dedup, mixing sources
to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tailframe.llm import bpe, mixing, quality, simhash
from tailframe.llm.common import read_table, stored
from tailframe.llm.queries import tokenizer_path
from tailframe.plans.storage import scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose content share is too low go, null and empty texts among
    them. Equal rows share their fate; columns stay as they are; an empty table gives an empty one."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (null ids come last; of
    equal ids any one). Null and empty texts are one group. Columns stay as they are; an empty table
    gives an empty one."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. A null source is a source, a
    null text has size 0, documents of one id share their fate. Columns stay as they are; an empty
    table gives an empty one."""
    return mixing.mixed_rows(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids and digests of the ids and of the text decoded from them. A null text has
    no ids; documents are independent; an empty table gives an empty one."""
    return bpe.round_trip(docs, tokenizer_path(), keep=["doc_id", "source"], with_ids=True)


STAGES = [("quality", quality_rules), ("simhash", simhash_dedup), ("mix", mix_sources), ("bpe", encode_bpe)]

#: The first stage fits a model and the second hashes with XXH64: not for SQL. tests/llm compares
#: run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage stores for itself is deleted when its result stands."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
