"""Parquet tables of a data folder, and the helpers that every query on them shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_per_key(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row per key. Rows delivered again are equal but for their load time, so any of them serves.

    ``first`` is combined before the shuffle, which carries only ``cols``.
    """
    return df.groupBy(key).agg(*[F.first(c).alias(c) for c in cols])


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the folder of spark.checkpoint.dir.

    Where the session names none, a folder of this machine serves sessions that run on this machine alone, and is deleted
    at the end; on a cluster it would be lost or unseen, so there it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="weirgate-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, limit: int) -> list:
    """The rows of a table that is small by definition; more than ``limit`` rows are an error, never cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows")
    return rows


#: The spellings of a domain.
DOMAINS = {"medical": ["medical", "医疗"], "legal": ["legal", "法律"], "finance": ["finance", "金融"], "education": ["education", "教育"]}


def domain_name(col: Column) -> Column:
    """A domain in its one spelling; other values in lower case, missing ones ``unknown``."""
    low = F.lower(F.trim(col))
    out = F.when(low.isNull() | (low == ""), F.lit("unknown"))
    for name, spellings in DOMAINS.items():
        out = out.when(low.isin(spellings), F.lit(name))
    return out.otherwise(low)


def language_name(col: Column) -> Column:
    """A language tag reduced to its first subtag in lower case; missing ones ``unknown``."""
    low = F.regexp_extract(F.lower(F.trim(col)), r"^[a-z]+", 0)
    return F.when(low.isNull() | (low == ""), F.lit("unknown")).otherwise(low)


def source_file(col: Column) -> Column:
    """The file name of a source: no folder, no ``#row``, lower case; missing ones ``unknown``."""
    low = F.lower(F.trim(F.regexp_replace(F.regexp_replace(col, r"#.*$", ""), r"^.*[/\\]", "")))
    return F.when(low.isNull() | (low == ""), F.lit("unknown")).otherwise(low)
