"""De-identification by tables: plain patterns, patterns after an anchor, and names judged by their surroundings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions import tables as R
from weirgate.functions.text import java_pattern
from weirgate.schema import ISSUES, contents, count_matches, issue, issue_if, map_contents, with_issues


def bare(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, java_pattern(pattern), replacement)


def anchored_pattern(anchors: list[str], pattern: str, excluded: list[str] = (), beginnings: list[str] = ()) -> str:
    """Groups 1 and 2: the anchor and the value. Excluded values and beginnings are kept out by looking ahead."""
    either = lambda words: "|".join(map(re.escape, words))
    ahead = f"(?!{either(beginnings)})" if beginnings else ""
    exact = f"(?!(?:{either(excluded)})(?![一-龥]))" if excluded else ""
    return rf"({'|'.join(anchors)})\s*[:：]?\s*{exact}{ahead}({pattern})"


def _report(df: DataFrame, name: str, level: str, n: Column) -> DataFrame:
    """The issue of a group that was found ``n`` times."""
    count = n.cast("string")
    if level == "cleaned":
        return with_issues(df, issue_if(n > 0, issue("deid", f"deid.{name}", level, F.concat(F.lit(f"脱敏 {name}："), count, F.lit(" 处")))))
    return with_issues(df, issue_if(n > 0, issue("deid", f"deid.{name}.annotate", level, F.concat(F.lit(f"疑似 {name} 待人工确认："), count, F.lit(" 处")))))


def _groups(df: DataFrame, bare_groups, anchored_groups) -> DataFrame:
    """Groups in order, each on the text that the ones before have changed."""
    rules = [(name, pattern, new, level) for name, pattern, new, level in bare_groups]
    rules += [(name, anchored_pattern(anchors, pattern, excluded, beginnings), f"$1：{new}", level) for name, anchors, pattern, new, level, excluded, beginnings in anchored_groups]
    for name, pattern, new, level in rules:
        p = java_pattern(pattern)
        df = _report(df, name, level, count_matches(contents(), p))
        if level == "cleaned":
            df = map_contents(df, lambda t, p=p, r=new: F.regexp_replace(t, p, r))
    return df


_NAME = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(R.COMPOUND_SURNAMES)}|[{R.SURNAMES}])[一-龥]{{1,2}}(?=$|[\s，。；：、,.!?！？])")
_NO_NAME = re.compile(rf"{'|'.join(R.NOT_NAMES)}|.*(?:{'|'.join(R.NOT_NAME_ENDINGS)})")
_CUE = re.compile("|".join([*R.NAME_SUFFIXES, *R.NAME_TRIGGERS]))
_BRACKETS = [("((", "))"), ("【", "】"), ("（", "）"), ("[", "]")]


def hide_names(text: str) -> tuple[str, bool, list[str]]:
    """(text with sure names replaced, whether any was, doubtful names). Sure: a title or a trigger stands near.

    A word counts as bracketed if some pair opens anywhere before it and closes anywhere after it, so for each pair its
    first opening and its last closing bracket say it for every word of the text.
    """
    reach = [(text.find(a) + len(a), text.rfind(b)) for a, b in _BRACKETS if a in text and b in text]
    doubtful: list[str] = []

    def seen(m: re.Match) -> str:
        lo, hi = m.span()
        if _NO_NAME.fullmatch(m[0]) or any(first <= lo < last for first, last in reach):
            return m[0]
        if _CUE.search(text, max(0, lo - R.NAME_WINDOW), hi + R.NAME_WINDOW):
            return "[姓名]"
        doubtful.append(m[0])
        return m[0]

    new = _NAME.sub(seen, text)
    return new, new != text, doubtful


@F.pandas_udf(T.StructType([T.StructField("contents", T.ArrayType(T.StringType())), T.StructField("issues", ISSUES)]))
def _names(rows: pd.Series) -> pd.DataFrame:
    out = []
    for texts in rows:
        new, issues = [], []
        for t in texts if texts is not None else []:
            t, changed, doubtful = hide_names(t or "")
            new.append(t)
            issues += [("deid", "deid.patient_name_lowconf", "annotated", f"疑似姓名待人工确认：{w}") for w in doubtful]
            if changed:
                issues.append(("deid", "deid.patient_name", "cleaned", "患者姓名脱敏"))
        out.append((new, [dict(zip(("stage", "code", "level", "message"), i)) for i in issues]))
    return pd.DataFrame(out, columns=["contents", "issues"])


_KEPT = [re.compile(p) for p in R.LEGAL_KEPT]
#: (name, pattern, replacement, level) of legal texts in order, anchored ones with the anchor in their replacement.
_LEGAL = [(name, re.compile(p), new, level) for name, p, new, level in R.BARE] + [(name, re.compile(anchored_pattern(anchors, p, excluded, beginnings)), rf"\1：{new}", level) for name, anchors, p, new, level, excluded, beginnings in R.LEGAL_ANCHORED]


def hide_legal(text: str) -> tuple[str, list[int]]:
    """The text without what legal groups replace, and how often each was found outside of a case number, document number,
    date or court. Each group reads the text that the ones before have changed."""
    found = []
    for _, pattern, new, level in _LEGAL:
        kept = [m.span() for p in _KEPT for m in p.finditer(text)]
        hits = [m for m in pattern.finditer(text) if not any(lo < m.end() and m.start() < hi for lo, hi in kept)]
        found.append(len(hits))
        if level == "cleaned":
            for m in reversed(hits):
                text = text[: m.start()] + m.expand(new) + text[m.end() :]
    return text, found


@F.pandas_udf(T.StructType([T.StructField("contents", T.ArrayType(T.StringType())), T.StructField("found", T.ArrayType(T.ArrayType(T.IntegerType())))]))
def _legal(rows: pd.Series) -> pd.DataFrame:
    done = [[hide_legal(t or "") for t in r] if r is not None else [] for r in rows]
    return pd.DataFrame({"contents": [[t for t, _ in r] for r in done], "found": [[f for _, f in r] for r in done]})


def _nth(k: int):
    return lambda values: values[k]


def put_contents(df: DataFrame, column: str) -> DataFrame:
    """The messages with their contents taken from an array column, which is dropped."""
    return df.withColumn("messages", F.zip_with("messages", column, lambda m, t: F.struct(m["role"].alias("role"), t.alias("content")))).drop(column)


def deid(df: DataFrame, domain: str) -> DataFrame:
    """The de-identification of a domain. Null contents read as empty; null messages stay null."""
    if domain == "legal":
        df = df.withColumn("_done", _legal(contents())).withColumn("_new", F.col("_done.contents"))
        for k, (name, _, _, level) in enumerate(_LEGAL):
            count = F.transform("_done.found", _nth(k))
            df = _report(df, name, level, F.aggregate(count, F.lit(0), lambda a, n: a + n))
        return put_contents(df.drop("_done"), "_new")
    df = _groups(df, R.BARE, R.MEDICAL_ANCHORED[:3] if domain == "medical" else [])
    if domain != "medical":
        return df
    df = _groups(df, [R.INSTITUTION], R.MEDICAL_ANCHORED[3:])
    df = df.withColumn("_found", _names(contents())).withColumn("_new", F.col("_found.contents"))
    df = with_issues(df, F.col("_found.issues").cast(ISSUES)).drop("_found")
    return put_contents(df, "_new")
