"""Queries of the operators for language-model text."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.functions.tokens import VOCABULARIES, vocabulary_path
from weirgate.llm.broken_pairs import broken_pairs
from weirgate.llm.byte_bpe import encode_documents
from weirgate.llm.garbled import garbled_values
from weirgate.llm.junk_pages import junk_pages
from weirgate.llm.leakage import leaked
from weirgate.llm.pii import personal_information
from weirgate.llm.token_budget import token_budget
from weirgate.llm.visual_form import look_alike_classes, look_alike_pairs, visual_form
from weirgate.sources.tables import table


def p1_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget(table(spark, d, "mmlu_csv_alpaca"), vocabulary_path("piece_bpe_32k.model"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "mmlu_csv_alpaca").select(F.lit("mmlu_csv_alpaca").alias("table_name"), F.col("row_id").alias("row_key"), F.col("instruction").alias("question"), F.col("output").alias("answer"))
    asked = table(spark, d, "fineval_qa_finance").select(F.lit("fineval_qa_finance").alias("table_name"), F.col("qa_id").alias("row_key"), "question", "answer")
    return broken_pairs(pairs.unionByName(asked))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "work_item").select(F.lit("work_item").alias("table_name"), F.col("record_id").alias("row_key"), F.posexplode("messages").alias("turn", "m")).select("table_name", "row_key", "turn", F.col("m.content").alias("text"))
    pairs = table(spark, d, "mmlu_csv_alpaca").select(F.lit("mmlu_csv_alpaca").alias("table_name"), F.col("row_id").alias("row_key"), F.lit(0).alias("turn"), F.col("instruction").alias("text"))
    return personal_information(items.unionByName(pairs))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("table_name", "row_key", "turn", F.explode("types").alias("pii_type")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d).select("table_name", "row_key", "turn", "redacted").distinct()


def _visible_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts whose visual form problem 4 asks for: exam questions, and first messages."""
    exam = table(spark, d, "cmmlu_education").select(F.lit("cmmlu_education").alias("table_name"), F.col("row_no").alias("key"), F.col("question").alias("text"))
    items = table(spark, d, "work_item").select(F.lit("work_item").alias("table_name"), F.col("record_id").alias("key"), F.try_element_at("messages", F.lit(1))["content"].alias("text"))
    return exam.unionByName(items)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(_visible_texts(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_classes(_visible_texts(spark, d))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    exam = table(spark, d, "cmmlu_education").select(F.lit("cmmlu_education").alias("table_name"), F.col("row_no").alias("key"), F.lit(0).alias("turn"), F.col("question").alias("text"))
    items = table(spark, d, "work_item").select(F.lit("work_item").alias("table_name"), F.col("record_id").alias("key"), F.posexplode("messages").alias("turn", "m")).select("table_name", "key", "turn", F.col("m.content").alias("text"))
    return exam.unionByName(items).select("table_name", "key", "turn", visual_form(F.col("text")).alias("form")).distinct()


def _read_for_leaks(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "mmlu_csv_alpaca").select(F.lit("mmlu_csv_alpaca").alias("table_name"), F.col("row_id").alias("row_key"), F.col("instruction").alias("text"))
    docs = table(spark, d, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_key"), "text")
    return pairs.unionByName(docs)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(_read_for_leaks(spark, d), table(spark, d, "fineval_mcq_finance"))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Also passages with one letter changed, added or left out."""
    return leaked(_read_for_leaks(spark, d), table(spark, d, "fineval_mcq_finance"), unbroken=False)


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    exam = table(spark, d, "cmmlu_education")
    values = exam.select(F.col("row_no").alias("key"), F.explode(F.create_map(F.lit("question"), F.col("question"), F.lit("answer"), F.col("answer"))).alias("field", "text"))
    return garbled_values(values)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_restored(spark, d).select(F.col("key").alias("row_no"), "field").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"), "doc_id", "text", vocabulary_path("byte_bpe_50k.tiktoken"), importlib.import_module(VOCABULARIES).PATTERN)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return junk_pages(table(spark, d, "documents")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_classes": p4_classes, "p4_forms": p4_forms, "p6_found": p6_found, "p6_near": p6_near, "p7_found": p7_found, "p7_restored": p7_restored, "p10_found": p10_found, "p1_token_budget": p1_token_budget, "p8_ids": p8_ids}
ORACLES: dict[str, str] = {}
