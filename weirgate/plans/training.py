"""Queries of the general operators for training data: p5 (quantities) and p9 (packing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirgate.functions.tokens import vocabulary_path
from weirgate.operators.packing import balance, fill_rates, pack
from weirgate.operators.quantities import quantities
from weirgate.sources.tables import table

#: The vocabulary in which documents are sized.
SIZE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quantities(table(spark, d, "work_item"), table(spark, d, "units"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "pack_profile"), vocabulary_path(SIZE_VOCABULARY))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_rates(p9_pack(spark, d), table(spark, d, "pack_profile"))


def p9_balance(spark: SparkSession, d: str) -> DataFrame:
    return balance(p9_pack(spark, d))


QUERIES = {"p5_found": p5_found, "p9_pack": p9_pack, "p9_fill": p9_fill, "p9_balance": p9_balance}
ORACLES: dict[str, str] = {}
