"""The record of the curation pipeline: one row per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in ("stage", "code", "level", "message")])
ISSUES = T.ArrayType(ISSUE)
SPLIT = T.StructType([T.StructField(n, T.StringType()) for n in ("instruction", "input", "output")])
META = T.StructType([T.StructField(n, T.StringType()) for n in ("format", "department", "title", "doc_id", "question_type", "exam_type", "exam_subject", "answer_raw", "answer_idx")] + [T.StructField("split", SPLIT)])
#: Columns of a work item. Stages add columns of their own: sections, doc_type, clause_tree, domain_score, ...
WORK_ITEM = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("messages", MESSAGES), T.StructField("meta", META), T.StructField("issues", ISSUES), T.StructField("status", T.StringType()), T.StructField("drop_reason", T.StringType())])


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def issue(stage: str, code: str, level: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), F.lit(level).alias("level"), text.alias("message"))


def issue_if(condition: Column, one: Column) -> Column:
    """An array of one issue, or none."""
    return F.when(condition, F.array(one)).otherwise(no_issues())


def with_issues(df: DataFrame, *more: Column) -> DataFrame:
    """``df`` with arrays of issues appended in order."""
    return df.withColumn("issues", F.concat(F.coalesce("issues", no_issues()), *[F.coalesce(m, no_issues()) for m in more]))


def contents(role: str | None = None) -> Column:
    """The contents of all messages, or of one role."""
    ms = F.col("messages") if role is None else F.filter("messages", lambda m: m["role"] == role)
    return F.transform(ms, lambda m: F.coalesce(m["content"], F.lit("")))


def all_text() -> Column:
    return F.array_join(contents(), "\n")


def map_contents(df: DataFrame, change) -> DataFrame:
    """``change`` applied to the content of every message."""
    return df.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), change(m["content"]).alias("content"))))


def count_matches(texts: Column, pattern: str) -> Column:
    """Matches of a Java pattern in all texts of an array."""
    return F.aggregate(texts, F.lit(0), lambda a, t: a + F.regexp_count(t, F.lit(pattern)))
