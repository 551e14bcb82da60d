"""Files of many layouts as raw records: JSON, JSON lines, CSV in UTF-8 or GBK, and plain texts.

Every record is a JSON document in a VARIANT column with its file and its place, so that one chain of conditions can
normalise all layouts. What cannot be read is reported, not raised.
"""

from __future__ import annotations

import csv
import io
import json
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirgate.sources.tables import durable

RAW = "file_no int, file string, place long, raw variant"


def dense_ids(df: DataFrame, *order: str, name: str = "record_id") -> DataFrame:
    """``df`` with ids 0, 1, ... in the given order, without ordering the table in one task."""
    ordered = durable(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in ordered.groupBy("_part").count().collect()}  # one row per partition
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    if not offsets:
        return ordered.drop("_part").withColumn(name, F.lit(0).cast("long"))
    table = F.create_map(*[x for p, o in offsets for x in (F.lit(p), F.lit(o).cast("long"))])
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ordered.withColumn(name, (table[F.col("_part")] + local).cast("long")).drop("_part")


def _json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    if not lines:
        whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("text"))
        value = F.try_parse_json("text")
        many = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
        return whole.select("text", F.posexplode(many).alias("place", "raw")).select(F.col("place").cast("long"), "raw", F.when(F.col("raw").isNull(), F.col("text")).alias("bad"))
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("text"), (F.monotonically_increasing_id()).alias("place")).where(F.trim("text") != "")
    return text.select("place", F.try_parse_json("text").alias("raw"), "text").select("place", "raw", F.when(F.col("raw").isNull(), F.col("text")).alias("bad"))


def decoded(data: bytes) -> str:
    """Bytes as text by the first code that reads them: UTF-8 with or without mark, then GBK."""
    for code in ("utf-8-sig", "gbk"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor GBK")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per row, headers in lower case. A file is decoded as a whole, as its code must be known first."""

    def rows(batches):
        for pdf in batches:
            out = []
            for data in pdf["content"]:
                try:
                    reader = csv.reader(io.StringIO(decoded(bytes(data)), newline=""))
                    head = [h.strip().lower() for h in next(reader, [])]
                    out += [(i, json.dumps({h: v for h, v in zip(head, r)}, ensure_ascii=False), None) for i, r in enumerate(reader) if any(r)]
                except (ValueError, csv.Error) as e:
                    out.append((0, None, str(e)[:120]))
            yield pd.DataFrame(out, columns=["place", "text", "bad"])

    read = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "place long, text string, bad string")
    return read.select("place", F.try_parse_json("text").alias("raw"), "bad")


def _txt(spark: SparkSession, path: str) -> DataFrame:
    """A file of JSON lines in disguise, or one document: ``{"document": text}``."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    parsed = F.transform(lines, lambda x: F.try_parse_json(x))
    is_json = (F.size(lines) > 0) & F.forall(parsed, lambda v: v.isNotNull())
    document = F.array(F.try_parse_json(F.to_json(F.struct(F.col("value").alias("document")))))
    return whole.select(F.posexplode(F.when(is_json, parsed).otherwise(document)).alias("place", "raw")).select(F.col("place").cast("long"), "raw", F.lit(None).cast("string").alias("bad"))


def read_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, skipped): file_no, file, place, raw of every record in order of ``paths``; file, reason of what failed."""
    frames = []
    refused = []
    for number, path in enumerate(paths):
        name, kind = PurePosixPath(path).name, PurePosixPath(path).suffix.lower()
        make = {".json": lambda s, p: _json(s, p, False), ".jsonl": lambda s, p: _json(s, p, True), ".csv": _csv, ".txt": _txt}.get(kind)
        if make is None:
            refused.append((name, f"不支持的格式：{kind}"))
            continue
        frames.append(make(spark, path).select(F.lit(number).alias("file_no"), F.lit(name).alias("file"), "place", "raw", "bad"))
    skipped = spark.createDataFrame(refused, "file string, reason string")
    if not frames:
        return spark.createDataFrame([], "file_no int, file string, place long").withColumn("raw", F.try_parse_json(F.lit(None).cast("string"))), skipped
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    bad = every.where("bad is not null").select("file", F.substring("bad", 1, 120).alias("reason"))
    return every.where("raw is not null").drop("bad"), skipped.unionByName(bad)


def pasted(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Pasted texts, cut at empty lines, as documents in order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_no int, text string")
    cut = df.select("file_no", F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")).alias("place", "document"))
    return cut.select("file_no", F.concat(F.lit("paste_"), F.col("file_no").cast("string")).alias("file"), F.col("place").cast("long"), F.try_parse_json(F.to_json(F.struct("document"))).alias("raw"))
