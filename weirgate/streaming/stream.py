"""The row-local part of the pipeline on a stream, with exact duplicates dropped under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.operators.dedup import streaming_distinct
from weirgate.operators.verdict import judge
from weirgate.plans.pipeline import generic_clean, run_stages


def curate_stream(stream: DataFrame, domain: str, preset: str | None = None, time: str = "created_at", late: str = "1 hour", **limits) -> DataFrame:
    """A stream of work items cleaned, run through a preset, judged, and rid of exact duplicates of kept rows.

    Near duplicates depend on all earlier rows and stay a batch job; call ``curate`` on the written rows.
    """
    judged = judge(run_stages(generic_clean(stream), domain, preset), **limits).where("status = 'kept'")
    texts = judged.withColumn("text", F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), " "))
    return streaming_distinct(texts, time, late).drop("text", "norm_hash")
