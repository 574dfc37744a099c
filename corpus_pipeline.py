"""A corpus pipeline over documents: language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import jaccard, langid, packing, substring
from strata.llm._common import stored
from strata.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if less than this share of its n-grams belongs to any one language.
MIN_SCORE = 0.3
#: Near-duplicates: word n-grams, and similarity as a fraction.
NGRAM, NUM, DEN = 5, 8, 10
END_ID = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; those without letters or evidence of a language go."""
    model = langid.train(docs, F.lit(True))
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of least doc_id. Rows without words, or id, stay."""
    return jaccard.drop_near_copies(docs, NGRAM, NUM, DEN).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that come earlier; those of which nothing is left go, and those
    without such passages stay unchanged."""
    found = substring.remove_repeats(docs, carry=("lang", "source", "n_chars"), as_is=True)
    changed = F.col("n_removed") > 0
    left = found.where(~changed | (F.col("n_removed") < F.col("n_words")))
    return left.withColumn("n_chars", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))).withColumnRenamed("kept", "text").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents with their ids."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), END_ID)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("packing", pack)]

#: Language ID and tokenising can't be written in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage{i}")
    return docs
