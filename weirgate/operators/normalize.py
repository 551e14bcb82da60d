"""Raw records of any known layout as work items.

One chain of conditions on the keys of a record, in a fixed order of priority. A record gives one work item, several
(cases with many questions), or none, which is reported. Missing values and JSON nulls read as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.functions import tables as R
from weirgate.functions.text import strip
from weirgate.schema import MESSAGES, META, no_issues

_ITEM = "struct<messages:array<struct<role:string,content:string>>,meta:" + META.simpleString() + ">"


def _at(raw: Column, key: str, kind: str = "string") -> Column:
    path = f"$['{key}']"
    return F.try_variant_get(raw, path, kind)


def _text(raw: Column, *keys: str) -> Column:
    """The first of ``keys`` that holds something, trimmed; of a list the first element."""
    one = lambda k: F.nullif(strip(F.coalesce(F.try_element_at(_at(raw, k, "array<string>"), F.lit(1)), _at(raw, k))), F.lit(""))
    return F.coalesce(*[one(k) for k in keys], F.lit(""))


def _has(raw: Column, key: str) -> Column:
    return _at(raw, key, "variant").isNotNull()


def _turns(question: Column, answer: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("user", strip(question)), turn("assistant", strip(answer)))


def _meta(form: str, split: tuple[Column, Column, Column] | None = None, **more: Column) -> Column:
    null = F.lit(None).cast("string")
    parts = split or (null, null, null)
    whole = F.struct(*[p.alias(n) for p, n in zip(parts, ("instruction", "input", "output"))])
    keep = F.when(parts[0].isNotNull() & (parts[0] != ""), whole) if split else F.lit(None).cast("struct<instruction:string,input:string,output:string>")
    return F.struct(*[(F.lit(form) if f.name == "format" else keep if f.name == "split" else more.get(f.name, null)).alias(f.name) for f in META.fields])


def _one(messages: Column, meta: Column) -> Column:
    return F.array(F.struct(messages.cast(MESSAGES).alias("messages"), meta.cast(META).alias("meta")))


def options_text(raw: Column) -> Column:
    """Options ``A. text`` by line: a map in order of its keys, a list by its places; blank ones are left out."""
    line = lambda k, v: F.when(strip(v) != "", F.concat(k, F.lit(". "), strip(v)))
    by_key = lambda key: F.array_join(F.array_compact(F.transform(F.array_sort(F.map_entries(_at(raw, key, "map<string,string>"))), lambda e: line(e["key"], e["value"]))), "\n")
    by_place = lambda key: F.array_join(F.array_compact(F.transform(_at(raw, key, "array<string>"), lambda v, i: line(F.char(F.lit(65) + i), v))), "\n")
    return F.coalesce(by_key("option"), by_place("option"), by_key("options"), by_place("options"), F.lit(""))


def answer_letters(text: Column) -> Column:
    """The distinct capital letters of an answer in order, or the trimmed answer where there is none."""
    letters = F.array_join(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit("[A-Z]"), F.lit(0))), "")
    return F.when(letters != "", letters).otherwise(strip(text))


def _exam(raw: Column) -> Column:
    kind = _text(raw, "question_type")
    known = F.create_map(*[F.lit(x) for p in R.QUESTION_TYPES.items() for x in p])
    label = F.when(kind == "", F.lit("题")).otherwise(F.coalesce(known[kind], kind))
    info = lambda k: F.nullif(strip(F.try_variant_get(raw, f"$.meta_info.{k}", "string")), F.lit(""))
    subjects = F.nullif(F.array_join(F.try_variant_get(raw, "$.meta_info.subjects", "array<string>"), ","), F.lit(""))
    head = F.concat_ws("；", *[F.nullif(_text(raw, k), F.lit("")) for k in ("exam_type", "exam_class", "exam_subject")], F.concat(F.lit("src:"), info("src")), F.concat(F.lit("subjects:"), subjects), F.concat(F.lit("group:"), info("group")))
    options = options_text(raw)
    question = F.concat(F.when(head != "", F.concat(F.lit("["), head, F.lit("] "))).otherwise(""), label, F.lit("："), _text(raw, "question"), F.when(options != "", F.concat(F.lit("\n"), options)).otherwise(""))
    index, plain = _text(raw, "answer_idx"), _text(raw, "answer")
    letters = answer_letters(F.when(index != "", index).otherwise(plain))
    why = F.when(index != "", F.when(plain.rlike("^[A-Za-z]+$"), F.lit("")).otherwise(plain)).otherwise(_text(raw, "explanation", "Explanation", "solution", "解析"))
    answer = F.concat(F.lit("答案:"), letters, F.when(why != "", F.concat(F.lit("\n解析:"), why)).otherwise(""))
    return _one(_turns(question, answer), _meta("cmb_exam", question_type=kind, exam_type=_text(raw, "exam_type"), exam_subject=_text(raw, "exam_subject"), answer_raw=plain, answer_idx=index))


def _clinic(raw: Column) -> Column:
    title, description = _text(raw, "title"), _text(raw, "description")
    pairs = _at(raw, "QA_pairs", "array<struct<question:string,solution:string,answer:string>>")
    said = lambda p: strip(F.coalesce(F.nullif(p["solution"], F.lit("")), p["answer"], F.lit("")))
    asked = lambda p: strip(F.coalesce(p["question"], F.lit("")))
    whole = F.filter(pairs, lambda p: (asked(p) != "") & (said(p) != ""))
    background = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(description, F.lit("")))
    item = lambda p: F.struct(
        _turns(F.concat_ws("\n", F.nullif(background, F.lit("")), asked(p)), said(p)).cast(MESSAGES).alias("messages"),
        _meta("cmb_clin", (asked(p), background, said(p)), title=title, doc_id=_text(raw, "id")).cast(META).alias("meta"),
    )
    return F.transform(whole, item)


def _alpaca(raw: Column, keys: tuple[str, str, str], form: str) -> Column:
    ask, given, answer = (_text(raw, k) for k in keys)
    question = F.when(given != "", F.concat(ask, F.lit("\n\n"), given)).otherwise(ask)
    return _one(_turns(question, answer), _meta(form, (ask, given, answer)))


def _columns_mcq(raw: Column) -> Column:
    options = F.array_join(F.array_compact(F.array(*[F.when(_text(raw, k) != "", F.concat(F.lit(f"{k.upper()}. "), _text(raw, k))) for k in "abcdef"])), "\n")
    answer = F.upper(_text(raw, "answer"))
    question = F.concat_ws("\n", F.nullif(_text(raw, "question"), F.lit("")), F.nullif(options, F.lit("")))
    return _one(_turns(question, F.concat(F.lit("答案:"), F.when(answer != "", answer).otherwise("见解析"))), _meta("mcq_csv", answer_raw=answer))


def _columns_qa(raw: Column) -> Column:
    ask, answer = _text(raw, "ask", "question"), _text(raw, "answer", "answers")
    where, title = _text(raw, "department"), _text(raw, "title")
    notes = F.concat_ws("；", F.concat(F.lit("科室："), F.nullif(where, F.lit(""))), F.concat(F.lit("标题："), F.nullif(title, F.lit(""))))
    question = F.concat(F.when(notes != "", F.concat(F.lit("（"), notes, F.lit("）\n"))).otherwise(""), ask)
    return F.when((ask != "") & (answer != ""), _one(_turns(question, answer), _meta("toyhom", (ask, F.when(notes != "", notes).otherwise(""), answer), department=where, title=title))).otherwise(F.array().cast(f"array<{_ITEM}>"))


def _dialogue(raw: Column) -> Column:
    listed = F.coalesce(_at(raw, "messages", "array<struct<role:string,content:string>>"), F.try_variant_get(raw, "$", "array<struct<role:string,content:string>>"))
    kept = F.transform(F.filter(listed, lambda m: m["role"].isin("user", "assistant")), lambda m: F.struct(m["role"].alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    return _one(kept, _meta("sharegpt"))


def _chain(raw: Column, table: bool) -> Column:
    has = lambda *ks: reduce(lambda a, b: a | b, [_has(raw, k) for k in ks])
    every = lambda *ks: reduce(lambda a, b: a & b, [_has(raw, k) for k in ks])
    ask, said = has("ask", "question"), has("answer", "answers", "response")
    simple = _one(_turns(_text(raw, "ask", "question"), _text(raw, "response", "answer", "answers")), _meta("generic_qa"))
    law_text, law_sum = _text(raw, "article", "law_article"), _text(raw, "summary")
    law = _one(_turns(F.concat(F.lit(R.LAW_SUMMARY + "\n\n"), law_text), law_sum), _meta("law_summary", (F.lit(R.LAW_SUMMARY), law_text, law_sum)))
    if table:
        return F.when(has("instruction", "output"), _alpaca(raw, ("instruction", "input", "output"), "alpaca")).when(has("指令", "输出"), _alpaca(raw, ("指令", "输入", "输出"), "alpaca_cn")).when(every("question", "answer", "a", "b", "c", "d"), _columns_mcq(raw)).when(ask & said, _columns_qa(raw))
    is_list = lambda p: F.try_variant_get(raw, p, "array<variant>").isNotNull()
    return (
        F.when(is_list("$") | is_list("$.messages"), _dialogue(raw))
        .when(is_list("$.QA_pairs"), _clinic(raw))
        .when(_has(raw, "question") & has("question_type", "option", "options", "answer_idx"), _exam(raw))
        .when(has("instruction", "output"), _alpaca(raw, ("instruction", "input", "output"), "alpaca"))
        .when(has("指令", "输出"), _alpaca(raw, ("指令", "输入", "输出"), "alpaca_cn"))
        .when(ask & said, simple)
        .when(has("article", "law_article") & _has(raw, "summary"), law)
    )


def long_table(rows: DataFrame) -> DataFrame:
    """A table of one turn per row as dialogues: by id in order of first appearance, turns in order of rows.

    ``rows``: file_no, file, place, id, role, content. Turns of other roles than user and assistant are left out.
    """
    turn = F.struct("place", "role", F.coalesce("content", F.lit("")).alias("content"))
    grouped = rows.groupBy("file_no", "file", "id").agg(F.min("place").alias("place"), F.sort_array(F.collect_list(turn)).alias("turns"))
    kept = F.filter("turns", lambda t: t["role"].isin("user", "assistant"))
    return grouped.select("file_no", "file", "place", F.lit(0).alias("sub"), F.transform(kept, lambda t: F.struct(t["role"].alias("role"), strip(t["content"]).alias("content"))).alias("messages"), _meta("sharegpt").cast(META).alias("meta"))


def normalize(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work items without ids, skipped). ``records``: file_no, file, place, raw as ``read_files`` gives them."""
    tabular = F.lower("file").endswith(".csv")
    long = tabular & _has(F.col("raw"), "role") & _has(F.col("raw"), "content")
    keyed = records.where(long).select("file_no", "file", "place", F.coalesce(_at(F.col("raw"), "id"), _at(F.col("raw"), "对话id"), F.lit("")).alias("id"), _at(F.col("raw"), "role").alias("role"), _at(F.col("raw"), "content").alias("content"))
    rest = records.where(~long | F.isnull(long)).withColumn("items", F.when(tabular, _chain(F.col("raw"), True)).otherwise(_chain(F.col("raw"), False)))
    spread = rest.select("file_no", "file", "place", F.posexplode("items").alias("sub", "item")).select("file_no", "file", "place", "sub", "item.messages", "item.meta")
    skipped = rest.where("items is null or size(items) = 0").select("file", F.concat(F.lit("无法识别结构 #"), F.col("place").cast("string")).alias("reason"))
    return spread.unionByName(long_table(keyed)), skipped


def work_items(items: DataFrame) -> DataFrame:
    """Items with dense ids in order of file, row and part, and the columns of a work item."""
    from weirgate.sources.readers import dense_ids

    numbered = dense_ids(items, "file_no", "place", "sub")
    return numbered.select("record_id", F.concat("file", F.lit("#"), F.col("record_id").cast("string")).alias("source"), "messages", "meta", no_issues().alias("issues"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("drop_reason"))


def dialogues(turns: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of one turn each as one row per dialogue, in the order of turns."""
    window = Window.partitionBy(key)
    turn = F.struct(order, "role", "content")
    return turns.withColumn("_first", F.min(order).over(window)).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
