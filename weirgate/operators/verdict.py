"""Keep or drop, and the forms in which rows leave the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.schema import all_text


def drop_reason(min_len: int = 10, max_len: int = 2000, cutoff: float = 0.4) -> Column:
    """The first reason that holds: an issue that drops, a low score, too short, too long; null for rows that stay."""
    dropped = F.filter(F.coalesce("issues", F.array().cast("array<struct<stage:string,code:string,level:string,message:string>>")), lambda i: i["level"] == "drop")
    length = F.length(all_text())
    return (
        F.when(F.size(dropped) > 0, F.coalesce(F.nullif(F.try_element_at(dropped, F.lit(1))["message"], F.lit("")), F.lit("不合格")))
        .when(F.coalesce("domain_score", F.lit(1.0)) < cutoff, F.lit("结构/领域质量分过低"))
        .when(length < min_len, F.lit("长度过短"))
        .when(length > max_len, F.lit("长度过长"))
    )


def judge(df: DataFrame, min_len: int = 10, max_len: int = 2000, cutoff: float = 0.4) -> DataFrame:
    if "domain_score" not in df.columns:
        df = df.withColumn("domain_score", F.lit(None).cast("double"))
    df = df.withColumn("drop_reason", drop_reason(min_len, max_len, cutoff))
    return df.withColumn("status", F.when(F.col("drop_reason").isNull(), "kept").otherwise("dropped"))


def alpaca(df: DataFrame, leak_answer: bool = False) -> DataFrame:
    """instruction, input, output, source. A split kept in ``meta`` wins; else the first question, the later turns and
    the last answer. ``leak_answer``: the later turns hold the last answer once more, as the format once had it."""
    full = lambda role: F.filter(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"]), lambda c: c.isNotNull() & (c != ""))
    question, answer = F.coalesce(F.try_element_at(full("user"), F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(full("assistant"), F.lit(-1)), F.lit(""))
    rest = F.slice("messages", F.lit(2), F.greatest(F.size("messages") - (1 if leak_answer else 2), F.lit(0)))
    turns = F.array_join(F.filter(F.transform(rest, lambda m: m["content"]), lambda c: c.isNotNull() & (c != "")), "\n")
    later = F.when((F.size("messages") > 2) & (F.size(full("user")) > 0), turns).otherwise("")
    split = F.col("meta")["split"] if "meta" in df.columns and "split" in [f.name for f in df.schema["meta"].dataType.fields] else F.lit(None).cast("struct<instruction:string,input:string,output:string>")
    kept = split["instruction"].isNotNull()
    return df.select(
        F.when(kept, split["instruction"]).otherwise(question).alias("instruction"),
        F.when(kept, F.coalesce(split["input"], F.lit(""))).otherwise(later).alias("input"),
        F.when(kept, F.coalesce(F.nullif(split["output"], F.lit("")), answer)).otherwise(answer).alias("output"),
        "source",
    )


def sharegpt(df: DataFrame) -> DataFrame:
    return df.select("messages", "source")


def write_outputs(df: DataFrame, folder: str, slug: str, form: str = "alpaca") -> str:
    """The kept rows as JSON lines in ``folder/<slug>_<form>.jsonl`` (a folder of parts), in order of record_id."""
    kept = df.where("status = 'kept'")
    rows = (alpaca if form == "alpaca" else sharegpt)(kept.orderBy("record_id"))
    path = f"{folder}/{slug}_{form}.jsonl"
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def stage_stats(df: DataFrame) -> DataFrame:
    """Issues of each stage, and rows with at least one of level ``cleaned``."""
    each = df.select("record_id", F.explode("issues").alias("i")).select("record_id", "i.stage", "i.level")
    per_row = each.groupBy("stage", "record_id").agg(F.count("*").alias("n"), F.max((F.col("level") == "cleaned").cast("int")).alias("cleaned"))
    return per_row.groupBy("stage").agg(F.sum("n").alias("issues"), F.sum("cleaned").cast("long").alias("cleaned_rows"))


def reason_histogram(df: DataFrame) -> DataFrame:
    return df.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows by id, with up to four warnings or drops in 200 characters: a report, limited by nature."""
    loud = F.slice(F.filter("issues", lambda i: i["level"].isin("warning", "drop")), 1, 4)
    return df.orderBy("record_id").limit(rows).select("record_id", "source", "status", F.coalesce("drop_reason", F.lit("")).alias("drop_reason"), F.substring(F.array_join(F.transform(loud, lambda i: i["message"]), "；"), 1, 200).alias("notes"))


def compare_expected(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, outcome of a full join: match, mismatch, missing_actual, missing_expected. Columns: key, value."""
    a, e = actual.select(key, F.col("value").alias("actual"), F.lit(True).alias("_a")), expected.select(key, F.col("value").alias("expected"), F.lit(True).alias("_e"))
    both = a.join(e, key, "full_outer")
    return both.select(key, F.when(F.col("_a").isNull(), "missing_actual").when(F.col("_e").isNull(), "missing_expected").when(F.col("actual").eqNullSafe(F.col("expected")), "match").otherwise("mismatch").alias("outcome"))


def round_robin(df: DataFrame, group: str, order: str, number: int) -> DataFrame:
    """The first ``number`` rows taken from the groups in turn: a sample by design."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", turn).orderBy("turn", group).limit(number)


def spread_sample(df: DataFrame, order: str) -> DataFrame:
    """The first, the last and three rows between, at quarters of the order: a sample by design.

    The wanted values are exact percentiles of ``order``, computed without ordering the table in one task.
    """
    wanted = df.agg(F.percentile(F.col(order), F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("w"))
    values = [int(v) for v in wanted.first()["w"] or []]
    return df.where(F.col(order).isin(values))


def status_by_class(df: DataFrame, group: str, status: str, known: list[str]) -> DataFrame:
    """Rows of each class by status, one column for each known status."""
    counted = df.groupBy(group).pivot(status, known).agg(F.count(F.lit(1)))
    return counted.select(group, *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("long").alias(s) for s in known])


def first_match(docs: DataFrame, shortest: int, longest: int, word: str) -> DataFrame:
    """The first document by id with a length in bounds that holds a word: a pick by design."""
    fits = F.length("text").between(shortest, longest) & F.contains("text", F.lit(word))
    return docs.where(fits).orderBy("doc_id").limit(1)


def head_merge(parts: list[DataFrame], key: str, number: int) -> DataFrame:
    """The first rows of each part by key, part after part: a merge of samples by design."""
    from functools import reduce

    heads = [p.orderBy(key).limit(number).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), heads)
