"""The queries of this subpackage for the driver: opN_<name>(spark, sf_dir) and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, chat, jaccard, langid, neardup, packing, shards, substring, topk, warc
from strata.llm._common import shared_dir
from strata.llm.tokens import vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), 2)
    return pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset"), "tier", "step_group")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.crawl_records(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical_url", "ts", "refers_to", "outcome", "status", warc.header_lines(F.col("headers")).alias("header_lines"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), 3, 9, 10)


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/shards"
    shards.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder, 0)
    return shards.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.train(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_neardup, op2_packing, op3_substring_dedup, op4_revisits, op5_jaccard, op6_token_shards, op7_maxscore, op8_language, op9_bpe, op10_chat)}
ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": substring.ORACLE, "op4_revisits": warc.ORACLE, "op5_jaccard": jaccard.ORACLE, "op7_maxscore": topk.ORACLE}
