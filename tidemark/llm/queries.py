"""The training-data queries, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import brown, jaccard, language, linerules, merkle, packing, pieces, pii, quality, toxicity, urlfilters, vectors, whitening
from tidemark.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(table(spark, sf_dir, "documents"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"), fold(7) == 2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) == 0)


def language_model(spark: SparkSession, sf_dir: str) -> language.Model:
    return language.fit(table(spark, sf_dir, "documents").where(fold(3) != 1))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"), language_model(spark, sf_dir))
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilters.judge(urlfilters.page_captures(pages), urlfilters.page_entries(pages))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(3) == 1)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.fifth())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_jaccard": op2_jaccard,
    "op3_lines": op3_lines,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_brown": op5_brown,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_pieces": op8_pieces,
    "op9_vectors": op9_vectors,
    "op10_urls": op10_urls,
    "op11_toxicity": op11_toxicity,
    "op12_merkle": op12_merkle,
    "op13_whitening": op13_whitening,
}

ORACLES = {"op3_lines": linerules.oracle(), "op10_urls": urlfilters.ORACLE, "op12_merkle": merkle.oracle()}
