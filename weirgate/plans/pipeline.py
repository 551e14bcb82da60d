"""The pipeline: read, normalise, clean, run a preset's stages, judge, drop duplicates, write, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.functions.tables import DOMAIN_LABELS, PRESETS
from weirgate.functions.text import clean_texts
from weirgate.operators.dedup import dedupe
from weirgate.operators.deid import deid, put_contents
from weirgate.operators.generators import generate
from weirgate.operators.normalize import normalize, work_items
from weirgate.operators.stages import STAGES
from weirgate.operators.verdict import judge, reason_histogram, stage_stats, write_outputs
from weirgate.schema import contents, issue, with_issues
from weirgate.sources.readers import read_files
from weirgate.sources.tables import durable


def domain_slug(label: str) -> str:
    """The domain of a label or name; anything unknown is ``generic``."""
    slug = DOMAIN_LABELS.get(label, label)
    return slug if any(d == slug for d, _ in PRESETS) else "generic"


def preset_names(domain: str | None = None) -> list[str]:
    return [name for d, name in PRESETS if domain in (None, d)]


def find_preset(domain: str, name: str | None = None) -> tuple[list[str], str]:
    """(stages, mode) of a preset of a domain: the named one, else its first; no domain has only a score of 0."""
    own = [(n, p) for (d, n), p in PRESETS.items() if d == domain_slug(domain)]
    stages, mode = next((p for n, p in own if n == name), own[0][1])
    return stages, mode


def generic_clean(items: DataFrame) -> DataFrame:
    """Every content cleaned, with an issue for each that changes."""
    df = items.withColumn("_old", contents()).withColumn("_new", clean_texts("_old"))
    changed = F.filter(F.zip_with("_old", "_new", lambda a, b: a != b), lambda x: x)
    df = with_issues(df, F.transform(changed, lambda _: issue("generic_clean", "text.rewritten", "cleaned", "通用文本清洗")))
    return put_contents(df.drop("_old"), "_new")


def run_stages(items: DataFrame, domain: str, preset: str | None = None, disabled: set[str] = frozenset()) -> DataFrame:
    """The stages of a preset in order. An unknown kind of stage is a KeyError."""
    stages, mode = find_preset(domain, preset)
    slug = domain_slug(domain)
    for kind in stages:
        if kind in disabled:
            continue
        items = deid(items, slug) if kind == "deid" else STAGES[kind](items, slug, mode)
    return items


def curate(items: DataFrame, domain: str, preset: str | None = None, min_len: int = 10, max_len: int = 2000, cutoff: float = 0.4, dedup: bool = True) -> DataFrame:
    """Work items with status and reason. Duplicates are sought among the kept rows only."""
    done = durable(judge(run_stages(generic_clean(items), domain, preset), min_len, max_len, cutoff))
    if not dedup:
        return done
    kept = done.where("status = 'kept'").select(F.col("record_id").alias("id"), F.array_join(contents(), " ").alias("text"))
    verdicts = dedupe(kept).where("verdict <> 'kept'").select(F.col("id").alias("record_id"), F.concat(F.lit("去重:"), "verdict").alias("dup"))
    return done.join(verdicts, "record_id", "left").withColumn("drop_reason", F.coalesce("drop_reason", "dup")).withColumn("status", F.when(F.col("drop_reason").isNull(), "kept").otherwise("dropped")).drop("dup")


@dataclass
class Result:
    """All rows, what was skipped, the reasons, the issues by stage, and where the kept rows were written."""

    rows: DataFrame
    skipped: DataFrame
    reasons: DataFrame
    stages: DataFrame
    written: str | None

    def summary(self) -> str:
        n = {r["status"]: r["n"] for r in self.rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
        lines = [f"共 {sum(n.values())} 条，保留 {n.get('kept', 0)} 条，丢弃 {n.get('dropped', 0)} 条"]
        lines += [f"  - {r['drop_reason']}：{r['n']}" for r in self.reasons.orderBy("drop_reason").collect()]
        return "\n".join(lines)


def run_pipeline(spark: SparkSession, domain: str, paths: list[str], out: str | None = None, preset: str | None = None, form: str = "alpaca", **limits) -> Result:
    records, refused = read_files(spark, paths)
    slug = domain_slug(domain)
    document = F.try_variant_get("raw", "$.document", "string")
    if slug in ("medical", "legal"):
        texts = records.where(document.isNotNull()).select(F.struct("file_no", "file", "place").alias("key"), document.alias("text"))
        made = generate(texts, slug).select("key.*", F.try_parse_json(F.to_json(F.struct("instruction", "input", "output"))).alias("raw"))
        records = records.where(document.isNull()).unionByName(made.select("file_no", "file", "place", "raw"))
    items, unknown = normalize(records)
    rows = curate(work_items(items), domain, preset, **limits)
    written = write_outputs(rows, out, slug, form) if out else None
    return Result(rows, refused.unionByName(unknown), reason_histogram(rows), stage_stats(rows), written)
