"""Domain stages: sections, terms, units, marks, kinds and structure of legal texts, completeness and quality.

Every stage maps a DataFrame of work items to another and appends to ``issues``. Stages add only narrow dependencies;
none shuffles.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.functions import tables as R
from weirgate.functions.text import arabic_number, java_pattern, java_replacement, strip
from weirgate.schema import all_text, contents, count_matches, issue, issue_if, map_contents, with_issues

_ALIASES = sorted(((a, name) for name, many in R.SECTIONS.items() for a in many), key=lambda x: -len(x[0]))
_HEADER = re.compile(rf"(?<![A-Za-z0-9一-龥])[【\[（(]?\s*({'|'.join(re.escape(a) for a, _ in _ALIASES)})(?:[】\]）)\s:：])+", re.I)
_CANON = {a.lower(): name for a, name in reversed(_ALIASES)}
_ORDER = [n for n in R.SECTIONS if n not in R.UNORDERED_SECTIONS]


def split_sections(text: str) -> list[tuple[str, str]]:
    """(section, body) of every header in order; text before the first header belongs to none."""
    heads = [(_CANON[m[1].lower()], m.start(), m.end()) for m in _HEADER.finditer(text)]
    return [(n, text[hi : heads[i + 1][1] if i + 1 < len(heads) else len(text)]) for i, (n, _, hi) in enumerate(heads)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("body", T.StringType())])))
def sections_of(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n, "body": b} for n, b in split_sections(t)] if t else [] for t in texts], dtype="object")


def section(df: DataFrame) -> DataFrame:
    """Sections of the first message: ``sections`` (the last of equal names wins), ``section_order``, the text rebuilt.

    Fewer than two headers leave the text; fewer than two different ones are noted, as is each step back in the order.
    """
    first = F.coalesce(F.try_element_at("messages", F.lit(1))["content"], F.lit(""))
    df = df.withColumn("_blocks", sections_of(first))
    names = F.transform("_blocks", lambda b: b["name"])
    two = F.size("_blocks") >= 2
    rebuilt = F.array_join(F.transform("_blocks", lambda b: F.concat(F.lit("【"), b["name"], F.lit("】\n"), strip(b["body"]))), "\n\n")
    last = F.filter("_blocks", lambda b, i: ~F.exists(F.slice("_blocks", i + 2, F.greatest(F.size("_blocks"), F.lit(1))), lambda c: c["name"] == b["name"]))
    place = lambda c: F.array_position(F.array(*map(F.lit, _ORDER)), c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_names"), F.lit(1))), lambda i: F.struct(F.try_element_at("_names", i).alias("a"), F.try_element_at("_names", i + 1).alias("b")))
    back = F.filter(pairs, lambda p: (place(p["a"]) > place(p["b"])) & (place(p["b"]) > 0))
    df = df.withColumn("_names", names).withColumn("section_violations", back)
    df = with_issues(
        df,
        issue_if(F.size(F.array_distinct("_names")) < 2, issue("section", "structure.incomplete", "annotated", "病历缺少可识别的结构化小节")),
        F.transform("section_violations", lambda p: issue("section", "structure.order", "warning", F.concat(F.lit("小节顺序异常："), p["a"], F.lit(" -> "), p["b"]))),
    )
    df = df.withColumn("messages", F.when(two, F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, rebuilt).otherwise(m["content"]).alias("content")))).otherwise(F.col("messages")))
    return df.withColumn("sections", F.when(two, F.map_from_entries(F.transform(last, lambda b: F.struct(b["name"], b["body"]))))).withColumn("section_order", F.col("_names")).drop("_blocks", "_names")


def expand(text: Column, words: dict[str, str], edge: str) -> Column:
    """Words replaced where no letter of ``edge`` touches them, longest first."""
    for w in sorted(words, key=lambda w: (-len(w), w)):
        text = F.regexp_replace(text, rf"(?<![{edge}]){re.escape(w)}(?![{edge}])", words[w])
    return text


def terminology(df: DataFrame, domain: str) -> DataFrame:
    """Typing errors, abbreviations, and how often a dose is taken."""
    # each error is sought in what the ones before have left: a corrected word is no error any more
    for wrong, right in {"medical": R.MEDICAL_TYPOS, "legal": R.LEGAL_TYPOS}.get(domain, {}).items():
        holds, said = F.lit(wrong), issue("terminology", "term.typo", "cleaned", f"错字：{wrong}→{right}")
        df = with_issues(df, F.transform(F.filter(contents(), lambda t: F.contains(t, holds)), lambda _: said))  # noqa: B023
        df = map_contents(df, lambda t: F.replace(t, holds, F.lit(right)))  # noqa: B023
    if domain != "medical":
        return df
    for words, edge, code, label in ((R.ABBREVIATIONS, "A-Za-z", "term.abbrev", "缩写展开"), (R.FREQUENCIES, "A-Za-z0-9", "term.latin", "频次换算")):
        pattern = rf"(?<![{edge}])(?:{'|'.join(sorted(words, key=lambda w: -len(w)))})(?![{edge}])"
        n = count_matches(contents(), pattern)
        df = with_issues(df, issue_if(n > 0, issue("terminology", code, "cleaned", F.concat(F.lit(f"{label}："), n.cast("string"), F.lit(" 处")))))
        df = map_contents(df, lambda t, w=words, e=edge: expand(t, w, e))
    return df


_UNIT_OF = {a: name for name, aliases in R.UNIT_ALIASES.items() for a in aliases if a != name}
_ANY_UNIT = rf"(?<!\w)\d+(?:\.\d+)?\s*(?:{'|'.join(re.escape(a) for a in sorted(_UNIT_OF, key=len, reverse=True))})(?!\w)"


def canonical_units(text: Column) -> Column:
    """Aliases of units after a number brought to one name.

    One pattern tells whether a text holds any alias; only then is it rewritten, by one pattern a unit.
    """
    new = text
    for name in R.UNIT_ALIASES:
        other = "|".join(re.escape(a) for a in sorted(_UNIT_OF, key=len, reverse=True) if _UNIT_OF[a] == name)
        if other:
            new = F.regexp_replace(new, java_pattern(rf"(?<!\w)(\d+(?:\.\d+)?\s*)(?:{other})(?!\w)"), f"$1{name}")
    return F.when(text.rlike(java_pattern(_ANY_UNIT)), new).otherwise(text)


def _joined_sections(names: list[str]) -> Column:
    body = F.array_join(F.filter(F.array(*[F.try_element_at("sections", F.lit(n)) for n in names]), lambda b: b.isNotNull() & (b != "")), "\n")
    return F.when(F.col("sections").isNull() | (body == ""), all_text()).otherwise(body)


def implausible_doses(text: Column) -> Column:
    """An issue for each number with a unit outside its range."""
    units = sorted({a for many in R.UNIT_ALIASES.values() for a in many} | set(R.COMPOSED_UNITS), key=lambda a: (-len(a), a))
    pattern = rf"(\d+(?:\.\d+)?)\s*({'|'.join(map(re.escape, units))})"
    whole, value, unit = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (0, 1, 2))
    hits = F.arrays_zip(whole.alias("whole"), value.alias("value"), unit.alias("unit"))
    # bound by a lambda: else the text would be searched again for every rule
    found = F.transform(F.array(hits), lambda h: F.concat(*[_out_of_range(h, low, high, code, "剂量/数值可疑：", name) for name, low, high, code in R.DOSES]))
    return found[0]


def _out_of_range(hits: Column, low: float, high: float, code: str, label: str, unit: str | None = None) -> Column:
    """An issue for each of ``hits`` (whole, value, and unit where one is asked for) outside the range."""
    outside = lambda h: (h["value"].cast("double") < low) | (h["value"].cast("double") > high)
    bad = F.filter(hits, lambda h: outside(h) if unit is None else (h["unit"] == unit) & outside(h))
    return F.transform(bad, lambda h: issue("units", code, "warning", F.concat(F.lit(label), h["whole"])))


def abnormal_labs(text: Column) -> Column:
    """An issue for each laboratory value outside its range."""
    out = []
    for label, pattern, low, high, code in R.LABS:
        hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("value"))
        out.append(_out_of_range(hits, low, high, code, f"{label} 异常："))
    return F.concat(*out)


def units(df: DataFrame) -> DataFrame:
    """Unit names, then doses and laboratory values out of range."""
    if "sections" not in df.columns:
        df = df.withColumn("sections", F.lit(None).cast("map<string,string>"))
    df = map_contents(df, canonical_units)
    return with_issues(df, implausible_doses(_joined_sections(R.DOSE_SECTIONS)), abnormal_labs(_joined_sections(R.LAB_SECTIONS)))


def marks(df: DataFrame, rules: list[tuple[str, str]], stage: str) -> DataFrame:
    """Marks rewritten in order; one issue for each rule and message in which it matches, even without a change."""
    for pattern, new in rules:
        p = java_pattern(pattern)
        n = count_matches(contents(), p)
        df = with_issues(df, issue_if(n > 0, issue(stage, f"{stage}.normalized", "cleaned", F.concat(F.lit("规范化："), n.cast("string"), F.lit(" 处")))))
        df = map_contents(df, lambda t, p=p, r=java_replacement(new): F.regexp_replace(t, p, r))
    return df


def doc_type_of(text: Column) -> Column:
    out = F.lit("其他")
    for name, needed, barred in reversed(R.DOC_TYPES):
        hit = reduce(lambda a, b: a & b, [text.rlike(java_pattern(p)) for p in needed] + [~text.rlike(p) for p in barred])
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def doc_type(df: DataFrame) -> DataFrame:
    df = df.withColumn("doc_type", doc_type_of(all_text()))
    return with_issues(df, issue_if(F.col("doc_type") != "其他", issue("doc_type", "doc.type", "annotated", F.concat(F.lit("文书类型："), "doc_type"))))


def canonical_citations(text: Column) -> Column:
    for pattern, new in R.CITATION_FORMS:
        text = F.regexp_replace(text, java_pattern(pattern), java_replacement(new))
    return text


def citations_of(texts: Column) -> Column:
    """Distinct citations of all texts in order."""
    pattern = java_pattern("|".join(f"(?:{p})" for p in R.CITATIONS))
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))))


_PARTS = sorted(((a, n) for n, many in R.LEGAL_PARTS.items() for a in many), key=lambda x: -len(x[0]))
TREE = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("node_id", "parent_id", "depth")] + [T.StructField(n, T.StringType()) for n in ("kind", "raw", "text")]))


def clause_tree(text: str) -> list[dict]:
    """The marked lines of a document as nodes in order, each with its parent; unmarked lines join the node before.

    Lines before the first mark belong to no node. Node 0 is the document.
    """
    nodes: list[dict] = []
    path: list[tuple[int, int]] = [(-1, 0)]  # level, node
    for line in filter(None, map(str.strip, text.splitlines())):
        for kind, pattern in R.HIERARCHY:
            if m := re.match(pattern, line):
                level = R.LEVELS[kind]
                while path[-1][0] >= level:
                    path.pop()
                nodes.append({"node_id": len(nodes) + 1, "parent_id": path[-1][1], "depth": len(path), "kind": kind, "raw": m[1], "text": line})
                path.append((level, len(nodes)))
                break
        else:
            if nodes:
                nodes[-1]["text"] += "\n" + line
    return nodes


def parts_of(text: str) -> dict[str, list[str]]:
    """Lines by the part that their beginning names, the longest alias first."""
    out: dict[str, list[str]] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        for alias, name in _PARTS:
            if line.startswith(alias):
                out.setdefault(name, []).append(line)
                break
    return out


@F.pandas_udf(TREE)
def _trees(texts: pd.Series) -> pd.Series:
    return pd.Series([clause_tree(t) if t else [] for t in texts], dtype="object")


def clause_trees(text: Column | str) -> Column:
    """The clause tree of each text, with the number of each node in digits (``no``); none for null and empty texts."""
    return F.transform(_trees(text), lambda n: F.struct(n["node_id"].alias("node_id"), n["parent_id"].alias("parent_id"), n["depth"].alias("depth"), n["kind"].alias("kind"), arabic_number(n["raw"]).alias("no"), n["raw"].alias("raw"), n["text"].alias("text")))


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def legal_parts(texts: pd.Series) -> pd.Series:
    return pd.Series([parts_of(t) if t else {} for t in texts], dtype="object")


def legal_structure(df: DataFrame) -> DataFrame:
    """Citations in one form and listed, the clause tree and the parts of the first message."""
    df = map_contents(df, canonical_citations)
    first = F.try_element_at("messages", F.lit(1))["content"]
    return df.withColumn("citations", citations_of(contents())).withColumn("clause_tree", clause_trees(first)).withColumn("parts", legal_parts(first))


def _case_history_qc(df: DataFrame) -> DataFrame:
    has = lambda n: F.map_contains_key(F.coalesce("sections", F.create_map().cast("map<string,string>")), n)
    body = lambda n: F.coalesce(F.try_element_at("sections", F.lit(n)), F.lit(""))
    missing = F.array_compact(F.array(*[F.when(~has(n), F.lit(n)) for n in R.REQUIRED_SECTIONS]))
    df = df.withColumn("missing_required", missing).withColumn("structure_score", reduce(lambda a, b: a + b, [F.when(has(n), w).otherwise(0) for n, w in R.SECTION_WEIGHTS.items()]))
    said = F.array_join(contents("assistant"), " ")
    orphans = [issue_if(~has(n) & reduce(lambda a, b: a | b, [F.contains(said, F.lit(a)) for a in R.SECTIONS[n]]), issue("completeness_qc", "clinical.orphan_ref", "warning", f"回答引用了缺失的小节：{n}")) for n in _ORDER]
    elsewhere = [issue_if(has("诊断") & has("现病史") & F.contains(body("诊断"), F.lit(k)) & ~F.contains(body("现病史"), F.lit(k)), issue("completeness_qc", "qc.diag_not_in_hpi", "warning", f"诊断疾病未出现在现病史：{k}")) for k in R.DISEASES]
    short = [issue_if(has(n) & (F.length(strip(body(n))) < 2), issue("completeness_qc", "qc.section_too_short", "warning", f"必需小节内容过短：{n}")) for n in R.REQUIRED_SECTIONS]
    return with_issues(
        df,
        issue_if(F.size("missing_required") > 0, issue("completeness_qc", "clinical.missing_required", "drop", F.concat(F.lit("临床信息不完整（缺失："), F.array_join("missing_required", "、"), F.lit("）")))),
        *orphans,
        *elsewhere,
        issue_if(has("主诉") & (F.length(strip(body("主诉"))) < 4), issue("completeness_qc", "qc.zhusu_too_short", "warning", "主诉缺少时长或主要症状")),
        *short,
    )


def _checks(spec) -> tuple[list[Column], Column]:
    patterns, needed, _, _ = spec
    hits = {k: all_text().rlike(java_pattern(p)) for k, p in patterns.items()}
    return list(hits.values()), reduce(lambda a, b: a & b, [hits[k] for k in needed])


def completeness_qc(df: DataFrame, domain: str) -> DataFrame:
    """What a complete text must hold; ``checks_ok`` and ``checks_all`` count the checks by pattern."""
    if domain == "medical":
        if "sections" not in df.columns:
            df = df.withColumn("sections", F.lit(None).cast("map<string,string>"))
        return _case_history_qc(df)
    by_type = R.LEGAL_CHECKS if domain == "legal" else {None: {"finance": R.FINANCE_CHECKS, "education": R.EDUCATION_CHECKS}[domain]}
    ok, total, found = F.lit(0), F.lit(0), []
    for kind, spec in by_type.items():
        here = F.lit(True) if kind is None else F.col("doc_type") == kind
        hits, passed = _checks(spec)
        ok = ok + F.when(here, reduce(lambda a, b: a + b, [h.cast("int") for h in hits])).otherwise(0)
        total = total + F.when(here, len(hits)).otherwise(0)
        found.append(issue_if(here & ~passed, issue("completeness_qc", "qc.missing_all", "drop" if spec[2] else "warning", spec[3])))
    df = df.withColumn("checks_ok", ok).withColumn("checks_all", total)
    return with_issues(df, *found)


def section_score(score: Column, missing: Column) -> Column:
    """0.6 of the weight of present sections and 0.4 for none missing, to three places as Python rounds them."""
    whole = sum(R.SECTION_WEIGHTS.values())
    table = [F.lit(round(0.6 * s / whole + 0.4 * (1.0 - m), 3)) for m in (0, 1) for s in range(whole + 1)]
    return F.element_at(F.array(*table), score + missing.cast("int") * (whole + 1) + 1)


def quality_score(df: DataFrame, mode: str) -> DataFrame:
    """``domain_score`` between 0 and 1."""
    if mode == "pair":
        spoke = lambda role: F.exists(contents(role), lambda t: strip(t) != "")
        return df.withColumn("domain_score", F.when(spoke("user") & spoke("assistant"), 0.9).otherwise(0.2))
    if mode == "sections":
        return df.withColumn("domain_score", section_score(F.col("structure_score"), F.size("missing_required") > 0))
    if mode == "regex":
        share = F.try_divide(F.col("checks_ok"), F.col("checks_all"))
        return df.withColumn("domain_score", F.coalesce(F.round(0.6 * share + 0.4 * (share > 0).cast("int"), 3), F.lit(0.0)))
    return df.withColumn("domain_score", F.lit(0.0))


STAGES = {
    "section": lambda df, domain, mode: section(df),
    "terminology": lambda df, domain, mode: terminology(df, domain),
    "units": lambda df, domain, mode: units(df),
    "marker_norm": lambda df, domain, mode: marks(df, R.LEGAL_MARKS if domain == "legal" else R.EDUCATION_MARKS if domain == "education" else [], "marker_norm"),
    "numeric": lambda df, domain, mode: marks(df, R.FINANCE_MARKS, "numeric"),
    "doc_type": lambda df, domain, mode: doc_type(df),
    "legal_structure": lambda df, domain, mode: legal_structure(df),
    "completeness_qc": lambda df, domain, mode: completeness_qc(df, domain),
    "quality_score": lambda df, domain, mode: quality_score(df, mode),
}
