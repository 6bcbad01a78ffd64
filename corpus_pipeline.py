"""From raw documents to packed training sequences: quality rules, language ID, near-duplicate removal, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm import langid, near, packing, quality, secret_scan
from boutline.llm.common import fresh_path

LEAST_SCORE = 0.25


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality.keep_good(docs)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or with under LEAST_SCORE of n-grams that any learned language holds, go. Learned from the labelled rows
    that the stage is given; where none is labelled, only documents without letters go."""
    return langid.keep_known(docs, langid.fit(docs, F.lit(True)), LEAST_SCORE)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return near.keep_first(docs, near.SHINGLE, near.PERCENT)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked and n_chars is counted again."""
    return secret_scan.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences of 4096."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", good_texts), ("language_id", known_languages), ("near_dedup", one_of_each), ("secret_scan", without_secrets), ("packing", packed)]

ORACLE_SQL = None  # language ID, near duplicates and packing have no SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
