"""The corpus pipeline: stages over the documents table, each written and read again.

Rows with unknown language go first, then documents that the quality rules reject, then
all but one document of each group of near duplicates; personal data is replaced by
pseudonyms (with the key that the session names in spark.tidemark.pseudonyms.key) and what
is left is packed into training sequences. Every stage but the last returns the columns of
its input.

Null texts and texts without a letter have no language and go in the first stage; rows that
share a doc_id are judged each by its own text; exact copies count as near duplicates. An
empty table goes through all stages and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, language, linerules, packing, pii
from tidemark.llm.common import saved, small_batches, table
from tidemark.llm.queries import fold, tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(docs.where(fold(3) != 1)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linerules.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage, with whole texts sent to Python workers in small batches, in its session from then on."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language identification", lean(identify_language)),
    ("quality rules", lean(quality_rules)),
    ("near duplicates", lean(near_duplicates)),
    ("pseudonyms", lean(pseudonyms)),
    ("packing", lean(pack)),
]

#: A trained model, set similarity, keyed permutations and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
