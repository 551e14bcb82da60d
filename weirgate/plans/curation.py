"""Queries of the curation operators, with SQL that gives the same rows.

Where the tables hold no text of a domain, it is composed from their columns on both sides; the SQL then takes the
expected value from the parts instead of running the patterns again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.functions import tables as R
from weirgate.functions.text import arabic_number, clean_text, fold_blanks, norm_text, strip, strip_markup
from weirgate.operators import dedup, deid, generators, normalize, stages, verdict
from weirgate.schema import META, count_matches, no_issues
from weirgate.sources.tables import durable, one_per_key, table

#: Python's blanks as a class of the SQL engine's patterns.
_B = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{_B}+|{_B}+\\z', '', 'g')"


def _items(df: DataFrame, key: str, user: Column, assistant: Column) -> DataFrame:
    """Work items of one question and answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.select(F.col(key).alias("record_id"), F.concat(F.lit("t#"), F.col(key).cast("string")).alias("source"), F.array(turn("user", user), turn("assistant", assistant)).alias("messages"), F.lit(None).cast(META).alias("meta"), no_issues().alias("issues"))


def _user() -> Column:
    return F.col("messages")[0]["content"]


def _codes() -> Column:
    return F.array_join(F.transform("issues", lambda i: i["code"]), ",")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- text
@query(rf"""SELECT doc_id, {_strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^' || '" + _B[1:-1] + "' || ']+', '<URL>', 'g'), '<[^>]{1,50}>', ' ', 'g'), '\\[\\p{Nd}+\\]|【\\p{Nd}+】|\\(\\p{Nd}+\\)', ' ', 'g'), '[ \\t\\x{3000}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS clean FROM documents""")
def doc_strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fold_blanks(strip_markup(F.col("text"))).alias("clean"))


@query()
def doc_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("clean"))


_NORM = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', '', 'g')"


@query(f"SELECT doc_id, sha1({_NORM}) AS hash FROM documents")
def doc_norm_sha1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha1(norm_text(F.coalesce("text", F.lit(""))).cast("binary")).alias("hash"))


@query("SELECT n, CASE n WHEN 0 THEN '零' ELSE han END AS han, n::VARCHAR AS arabic FROM (SELECT o_orderkey % 1000 AS n, list_extract(['','一百','二百','三百','四百','五百','六百','七百','八百','九百'], (o_orderkey % 1000 // 100 + 1)::BIGINT) || CASE WHEN o_orderkey % 100 BETWEEN 1 AND 9 AND o_orderkey % 1000 > 99 THEN '零' ELSE '' END || list_extract(['','十','二十','三十','四十','五十','六十','七十','八十','九十'], (o_orderkey % 100 // 10 + 1)::BIGINT) || list_extract(['','一','二','三','四','五','六','七','八','九'], (o_orderkey % 10 + 1)::BIGINT) AS han FROM orders)")
def number_arabic(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 1000
    pick = lambda words, at: F.element_at(F.array(*[F.lit(w) for w in words]), (at + 1).cast("int"))
    ones = ["", *"一二三四五六七八九"]
    han = F.concat(pick(["", *[x + "百" for x in ones[1:]]], F.floor(n / 100)), F.when((n % 100).between(1, 9) & (n > 99), "零").otherwise(""), pick(["", "十", *[x + "十" for x in ones[2:]]], F.floor(n % 100 / 10)), pick(ones, n % 10))
    df = table(spark, d, "orders").select(n.alias("n"), F.when(n == 0, "零").otherwise(han).alias("han"))
    return df.select("n", "han", arabic_number(F.col("han")).alias("arabic"))


# ---------------------------------------------------------------- duplicates and verdict
@query(f"SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY {_NORM}) AS is_dup FROM documents")
def doc_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.exact_duplicates(rows).select(F.col("id").alias("doc_id"), (F.col("id") != F.col("first_id")).alias("is_dup"))


@query(f"""WITH n AS (SELECT min(doc_id) AS id, {_NORM} AS norm FROM documents GROUP BY 2),
s AS (SELECT id, CASE WHEN length(norm) < 2 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm)), lambda i: substring(norm, i, 2))) END AS p FROM n)
SELECT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.id < b.id AND least(len(a.p), len(b.p)) >= 0.92::DOUBLE * greatest(len(a.p), len(b.p)) - 1e-9
WHERE len(list_intersect(a.p, b.p))::DOUBLE / (len(a.p) + len(b.p) - len(list_intersect(a.p, b.p))) >= 0.92::DOUBLE""")
def doc_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.near_pairs(dedup.first_rows(rows, dedup.exact_duplicates(rows))).select("id_a", "id_b")


@query()
def doc_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedupe(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return verdict.judge(_items(docs, "doc_id", F.coalesce("text", F.lit("")), F.lit("答")))


_REASON = "CASE WHEN length(coalesce(text, '')) + 2 < 10 THEN '长度过短' WHEN length(coalesce(text, '')) + 2 > 2000 THEN '长度过长' END"


@query(f"SELECT doc_id, {_REASON} AS drop_reason FROM documents")
def doc_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select(F.col("record_id").alias("doc_id"), "drop_reason")


@query(f"SELECT {_REASON} AS drop_reason, count(*) AS n FROM documents WHERE {_REASON} IS NOT NULL GROUP BY 1")
def drop_reason_hist(spark: SparkSession, d: str) -> DataFrame:
    return verdict.reason_histogram(_judged(spark, d))


# ---------------------------------------------------------------- normalisation
@query(f"SELECT row_id, CASE WHEN any_value(input_) <> '' THEN any_value(ask) || chr(10) || chr(10) || any_value(input_) ELSE any_value(ask) END AS question, any_value(answer) AS answer FROM (SELECT row_id, {_strip('coalesce(instruction, chr(0))')} AS ask0, {_strip('coalesce(instruction, ' + chr(39) * 2 + ')')} AS ask, {_strip('coalesce(input, ' + chr(39) * 2 + ')')} AS input_, {_strip('coalesce(output, ' + chr(39) * 2 + ')')} AS answer FROM mmlu_csv_alpaca) GROUP BY row_id")
def alpaca_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "mmlu_csv_alpaca"), "row_id", "instruction", "input", "output")
    return _normalized(rows, "row_id", "instruction", "input", "output")


def _normalized(rows: DataFrame, key: str, *cols: str, file: str = "t.jsonl") -> DataFrame:
    """key, question, answer by way of a JSON record and the chain of layouts."""
    raw = F.try_parse_json(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    records = rows.select(F.lit(0).alias("file_no"), F.lit(file).alias("file"), F.col(key).alias("place"), raw.alias("raw"))
    items, _ = normalize.normalize(records)
    return items.select(F.col("place").alias(key), F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


#: One row a key of the finance questions, nulls read as empty.
_ASKED = f"(SELECT qa_id, any_value({_strip("coalesce(question, '')")}) AS q, any_value({_strip("coalesce(answer, '')")}) AS a FROM fineval_qa_finance GROUP BY qa_id)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "fineval_qa_finance"), "qa_id", "question", "answer")
    return rows.select("qa_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


@query(f"SELECT qa_id, q AS question, a AS answer FROM {_ASKED}")
def generic_qa_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(_asked(spark, d), "qa_id", "question", "answer")


@query(f"SELECT qa_id, {_strip("'" + R.LAW_SUMMARY + "' || chr(10) || chr(10) || q")} AS question, a AS answer FROM {_ASKED}")
def law_summary_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(_asked(spark, d).withColumnsRenamed({"question": "article", "answer": "summary"}), "qa_id", "article", "summary")


@query(f"SELECT qa_id, '（科室：科' || (qa_id % 5) || CASE WHEN qa_id % 3 = 0 THEN '' ELSE '；标题：题' || (qa_id % 7) END || '）' || chr(10) || q AS question, a AS answer FROM {_ASKED} WHERE q <> '' AND a <> ''")
def csv_qa_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("qa_id")
    rows = _asked(spark, d).withColumn("department", F.concat(F.lit("科"), (k % 5).cast("string"))).withColumn("title", F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("题"), (k % 7).cast("string"))))
    return _normalized(rows.withColumnRenamed("question", "ask"), "qa_id", "department", "title", "ask", "answer", file="t.csv")


@query(f"SELECT row_id, CASE WHEN i <> '' THEN a || chr(10) || chr(10) || i ELSE a END AS question, o AS answer FROM (SELECT row_id, any_value({_strip("coalesce(instruction, '')")}) a, any_value({_strip("coalesce(input, '')")}) i, any_value({_strip("coalesce(output, '')")}) o FROM mmlu_csv_alpaca GROUP BY row_id)")
def alpaca_cn_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "mmlu_csv_alpaca"), "row_id", "instruction", "input", "output")
    return _normalized(rows.withColumnsRenamed({"instruction": "指令", "input": "输入", "output": "输出"}), "row_id", "指令", "输入", "输出")


_TURNS = f"(SELECT record_id, i - 1 AS turn, m[i].role AS role, {_strip("coalesce(m[i].content, '')")} AS content FROM (SELECT record_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT record_id, any_value(messages) AS m FROM work_item GROUP BY record_id)))"


def _item_turns(spark: SparkSession, d: str) -> DataFrame:
    items = one_per_key(table(spark, d, "work_item"), "record_id", "messages")
    return items.select("record_id", F.posexplode("messages").alias("turn", "m")).select("record_id", "turn", "m.role", F.coalesce("m.content", F.lit("")).alias("content"))


@query(f"SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY turn) - 1 AS turn, role, content FROM {_TURNS} WHERE role IN ('user', 'assistant')")
def sharegpt_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Half of the records as objects with ``messages``, half as bare lists."""
    whole = normalize.dialogues(_item_turns(spark, d), "record_id", "turn")
    raw = F.when(F.col("record_id") % 2 == 0, F.to_json(F.struct("messages"))).otherwise(F.to_json("messages"))
    records = whole.select(F.lit(0).alias("file_no"), F.lit("t.jsonl").alias("file"), F.col("record_id").alias("place"), F.try_parse_json(raw).alias("raw"))
    items, _ = normalize.normalize(records)
    return items.select(F.col("place").alias("record_id"), F.posexplode("messages").alias("turn", "m")).select("record_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content")


@query(f"SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY turn) - 1 AS turn, role, content FROM {_TURNS} WHERE role IN ('user', 'assistant')")
def long_csv_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = _item_turns(spark, d)
    raw = F.try_parse_json(F.to_json(F.struct(F.col("record_id").cast("string").alias("id"), "role", "content")))
    records = rows.select(F.lit(0).alias("file_no"), F.lit("t.csv").alias("file"), (F.col("record_id") * 100_000 + F.col("turn")).alias("place"), raw.alias("raw"))
    items, _ = normalize.normalize(records)
    turns = items.select(F.floor(F.col("place") / 100_000).alias("record_id"), F.posexplode("messages").alias("turn", "m"))
    return turns.select("record_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content")


@query(f"""SELECT item_id, '题：' || {_strip('question')} || CASE WHEN options IS NULL OR len(o) = 0 THEN '' ELSE chr(10) || array_to_string(o, chr(10)) END AS question,
'答案:' || upper(answer) || CASE WHEN explanation IS NULL OR {_strip('explanation')} = '' THEN '' ELSE chr(10) || '解析:' || {_strip('explanation')} END AS answer
FROM (SELECT *, list_filter(list_transform(options, lambda v, i: CASE WHEN {_strip('v')} <> '' THEN chr((64 + i)::INT) || '. ' || {_strip('v')} END), lambda x: x IS NOT NULL) AS o FROM fineval_mcq_finance)""")
def exam_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fineval_mcq_finance").withColumn("question_type", F.lit(""))
    return _normalized(rows, "item_id", "question", "options", "answer", "explanation", "question_type")


@query(f"""WITH t AS (SELECT row_no, any_value(question) q, any_value(a) a, any_value(b) b, any_value(c) c, any_value(d) d, any_value(answer) ans FROM cmmlu_education GROUP BY row_no),
s AS (SELECT row_no, {_strip('q')} q, {_strip('a')} a, {_strip('b')} b, {_strip('c')} c, {_strip('d')} d, {_strip('ans')} ans FROM t)
SELECT row_no, concat_ws(chr(10), nullif(coalesce(q, ''), ''), nullif(concat_ws(chr(10), 'A. ' || nullif(a, ''), 'B. ' || nullif(b, ''), 'C. ' || nullif(c, ''), 'D. ' || nullif(d, '')), '')) AS question, '答案:' || coalesce(nullif(upper(ans), ''), '见解析') AS answer FROM s""")
def mcq_normalize(spark: SparkSession, d: str) -> DataFrame:
    names = ("question", "a", "b", "c", "d", "answer")
    rows = one_per_key(table(spark, d, "cmmlu_education"), "row_no", *names)
    return _normalized(rows.select("row_no", *[F.coalesce(c, F.lit("")).alias(c) for c in names]), "row_no", *names, file="t.csv")


@query("SELECT l_orderkey, l_linenumber, '标题' || l_orderkey || chr(10) || 'q' || l_linenumber AS question, 's' || l_quantity::INT AS answer FROM lineitem WHERE l_quantity::INT % 7 <> 0")
def clinic_pairs_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_orderkey is not null")
    said = F.when(F.col("l_quantity").cast("int") % 7 != 0, F.concat(F.lit("s"), F.col("l_quantity").cast("int").cast("string"))).otherwise("")
    pair = F.struct(F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("question"), said.alias("solution"))
    grouped = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", pair.alias("p")))).alias("ps"))
    record = F.struct(F.concat(F.lit("标题"), F.col("l_orderkey").cast("string")).alias("title"), F.transform("ps", lambda x: x["p"]).alias("QA_pairs"))
    records = grouped.select(F.lit(0).alias("file_no"), F.lit("t.jsonl").alias("file"), F.col("l_orderkey").alias("place"), F.try_parse_json(F.to_json(record)).alias("raw"))
    items, _ = normalize.normalize(records)
    return items.select(F.col("place").alias("l_orderkey"), F.regexp_extract(F.col("messages")[0]["content"], r"q(\d+)$", 1).cast("int").alias("l_linenumber"), F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


@query("SELECT record_id, any_value(len(messages))::BIGINT AS turns, any_value(list_sum(list_transform(messages, lambda m: length(coalesce(m.content, '')))))::BIGINT AS chars, any_value(messages[1].role) AS first_role FROM work_item WHERE len(messages) > 0 GROUP BY record_id")
def dialogues_from_turns(spark: SparkSession, d: str) -> DataFrame:
    items = one_per_key(table(spark, d, "work_item"), "record_id", "messages")
    turns = items.select("record_id", F.posexplode("messages").alias("turn", "m")).select("record_id", "turn", "m.role", "m.content")
    whole = normalize.dialogues(turns, "record_id", "turn")
    return whole.select("record_id", F.size("messages").cast("long").alias("turns"), F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(F.coalesce(m["content"], F.lit("")))).alias("chars"), F.col("messages")[0]["role"].alias("first_role"))


@query("""WITH w AS (SELECT record_id, any_value(messages) m FROM work_item GROUP BY record_id), x AS (SELECT record_id, m, list_filter(list_transform(list_filter(m, lambda t: t.role = 'user'), lambda t: t.content), lambda c: c IS NOT NULL AND c <> '') u, list_filter(list_transform(list_filter(m, lambda t: t.role = 'assistant'), lambda t: t.content), lambda c: c IS NOT NULL AND c <> '') a FROM w)
SELECT record_id, coalesce(u[1], '') AS instruction, CASE WHEN len(m) > 2 AND len(u) > 0 THEN array_to_string(list_filter(list_transform(m[2:len(m)-1], lambda t: t.content), lambda c: c IS NOT NULL AND c <> ''), chr(10)) ELSE '' END AS input, coalesce(a[len(a)], '') AS output FROM x""")
def alpaca_export(spark: SparkSession, d: str) -> DataFrame:
    items = one_per_key(table(spark, d, "work_item"), "record_id", "messages").withColumn("source", F.col("record_id").cast("string"))
    out = verdict.alpaca(items)
    return out.select(F.col("source").cast("long").alias("record_id"), "instruction", "input", "output")


# ---------------------------------------------------------------- de-identification
@query(r"""SELECT row_id, any_value(len(list_filter(regexp_extract_all(coalesce(instruction, ''), '\p{Nd}+[Xx]?'), lambda x: regexp_full_match(x, '\p{Nd}{17}[\p{Nd}Xx]|\p{Nd}{18}[Xx]'))))::BIGINT AS id_cards,
any_value(len(list_filter(regexp_extract_all(coalesce(instruction, ''), '\p{Nd}+'), lambda x: regexp_full_match(x, '1[3-9]\p{Nd}{9}'))))::BIGINT AS phones,
any_value(len(regexp_extract_all(coalesce(instruction, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')))::BIGINT AS emails FROM mmlu_csv_alpaca GROUP BY row_id""")
def deid_bare_counts(spark: SparkSession, d: str) -> DataFrame:
    from weirgate.functions.text import java_pattern

    rows = one_per_key(table(spark, d, "mmlu_csv_alpaca"), "row_id", "instruction")
    text = F.array(F.coalesce("instruction", F.lit("")))
    return rows.select("row_id", *[count_matches(text, java_pattern(p)).cast("long").alias(n) for (_, p, _, _), n in zip(R.BARE, ("id_cards", "phones", "emails"))])


@query("""SELECT k AS c_custkey, '（2021）京01民初' || k || '号 原告王小明，电话[手机号]，立案（2021）沪' || (13800000000 + k) || '号，住址：朝阳路' || (k % 900) || '号' AS text, 'deid.phone,deid.party_name.annotate,deid.address.annotate' AS codes FROM (SELECT c_custkey AS k FROM customer)""")
def deid_legal(spark: SparkSession, d: str) -> DataFrame:
    """Numbers inside case numbers stay, anchored names and addresses are noted only."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("（2021）京01民初"), k.cast("string"), F.lit("号 原告王小明，电话"), (F.lit(13800000000) + k).cast("string"), F.lit("，立案（2021）沪"), (F.lit(13800000000) + k).cast("string"), F.lit("号，住址：朝阳路"), (k % 900).cast("string"), F.lit("号"))
    out = deid.deid(_items(table(spark, d, "customer"), "c_custkey", text, F.lit("好")), "legal")
    return out.select(F.col("record_id").alias("c_custkey"), _user().alias("text"), _codes().alias("codes"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '（患者张伟，' || c_custkey || '岁）' ELSE '（注）患者[姓名]，' || c_custkey || '岁' END AS text FROM customer")
def deid_brackets(spark: SparkSession, d: str) -> DataFrame:
    """A name inside brackets stays."""
    k = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("（患者张伟，"), k, F.lit("岁）"))).otherwise(F.concat(F.lit("（注）患者张伟，"), k, F.lit("岁")))
    out = deid.deid(_items(table(spark, d, "customer"), "c_custkey", text, F.lit("好")), "medical")
    return out.select(F.col("record_id").alias("c_custkey"), _user().alias("text"))


@query("SELECT c_custkey, '病历号：[病历号]，医保卡号：[医保卡号]，余额' || c_nationkey AS text FROM customer")
def deid_anchored(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("病历号 MR-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("，医保卡号:YB"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("，余额"), F.col("c_nationkey").cast("string"))
    return deid.deid(_items(table(spark, d, "customer"), "c_custkey", text, F.lit("好")), "medical").select(F.col("record_id").alias("c_custkey"), _user().alias("text"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '患者[姓名]，男。' WHEN 1 THEN '服用何首乌，患者好转。' ELSE '今日天气晴朗，' || ['赵','钱','孙','李'][(c_custkey % 4 + 1)::BIGINT] || '一。' END AS text, CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END::BIGINT AS doubtful FROM customer")
def deid_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(*map(F.lit, "赵钱孙李")), (k % 4 + 1).cast("int")), F.lit("一"))
    text = F.when(k % 3 == 0, F.concat(F.lit("患者"), name, F.lit("，男。"))).when(k % 3 == 1, "服用何首乌，患者好转。").otherwise(F.concat(F.lit("今日天气晴朗，"), name, F.lit("。")))
    out = deid.deid(_items(table(spark, d, "customer"), "c_custkey", text, F.lit("好")), "medical")
    return out.select(F.col("record_id").alias("c_custkey"), _user().alias("text"), F.size(F.filter("issues", lambda i: i["code"] == "deid.patient_name_lowconf")).cast("long").alias("doubtful"))


# ---------------------------------------------------------------- stages
@query("SELECT p_partkey, '高血压患者，心率 ' || p_size || '，每日2次 口服，DMX保留，2型糖尿病' AS text, 'term.typo,term.abbrev,term.latin' AS codes FROM part")
def term_expand(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("高血圧患者，HR "), F.col("p_size").cast("string"), F.lit("，bid po，DMX保留，T2DM"))
    out = stages.terminology(_items(table(spark, d, "part"), "p_partkey", text, F.lit("好")), "medical")
    return out.select(F.col("record_id").alias("p_partkey"), _user().alias("text"), _codes().alias("codes"))


@query("SELECT l_orderkey, l_linenumber, '剂量 ' || q || 'mg 与 ' || q || ' mL，服' || q || '毫升后' AS text, (CASE WHEN q * 60 > 2000 OR q * 60 < 0.01 THEN 1 ELSE 0 END)::BIGINT AS warnings FROM (SELECT *, l_quantity::INT AS q FROM lineitem)")
def unit_canonical(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("剂量 "), q.cast("string"), F.lit("毫克 与 "), q.cast("string"), F.lit(" ml，服"), q.cast("string"), F.lit("毫升后")).alias("t"), F.concat((q * 60).cast("string"), F.lit("mg ")).alias("dose"))
    return df.select("l_orderkey", "l_linenumber", stages.canonical_units(F.col("t")).alias("text"), F.size(stages.implausible_doses(F.col("dose"))).cast("long").alias("warnings"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN q / 4.0 < 3.9 OR q / 4.0 > 6.1 THEN 1 ELSE 0 END + CASE WHEN q * 5 < 110 OR q * 5 > 160 THEN 1 ELSE 0 END)::BIGINT AS abnormal FROM (SELECT *, l_quantity::INT AS q FROM lineitem)")
def lab_check(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    text = F.concat(F.lit("空腹血糖："), (q / 4).cast("string"), F.lit("mmol/l；HGB "), (q * 5).cast("string"), F.lit(" g/L"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(stages.abnormal_labs(text)).cast("long").alias("abnormal"))




def _histories(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    diagnosis, history = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit("诊断：高血压"), k, F.lit("\n"))), F.concat(F.lit("现病史：头晕"), k, F.lit("天\n"))
    text = F.concat(F.lit("前言\n主诉：胸闷"), k, F.lit("天\n"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(diagnosis, history)).otherwise(F.concat(history, diagnosis)))
    return stages.section(_items(table(spark, d, "orders"), "o_orderkey", text, F.lit("治疗：休息")))


@query("""SELECT o_orderkey, '胸闷' || o_orderkey || '天' AS complaint, CASE WHEN o_orderkey % 5 <> 0 THEN '高血压' || o_orderkey END AS diagnosis, '头晕' || o_orderkey || '天' AS history, (CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 1 ELSE 0 END)::BIGINT AS steps_back FROM orders""")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    body = lambda n: strip(F.try_element_at("sections", F.lit(n)))
    return _histories(spark, d).select(F.col("record_id").alias("o_orderkey"), body("主诉").alias("complaint"), body("诊断").alias("diagnosis"), body("现病史").alias("history"), F.size("section_violations").cast("long").alias("steps_back"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '临床信息不完整（缺失：诊断）' END AS drop_message, CASE WHEN o_orderkey % 5 = 0 THEN 0.15 ELSE 0.663 END::DOUBLE AS score, (CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END)::BIGINT AS elsewhere FROM orders""")
def qc_sections(spark: SparkSession, d: str) -> DataFrame:
    out = stages.quality_score(stages.completeness_qc(_histories(spark, d), "medical"), "sections")
    dropped = F.filter("issues", lambda i: i["level"] == "drop")
    return out.select(F.col("record_id").alias("o_orderkey"), F.try_element_at(dropped, F.lit(1))["message"].alias("drop_message"), F.col("domain_score").alias("score"), F.size(F.filter("issues", lambda i: i["code"] == "qc.diag_not_in_hpi")).cast("long").alias("elsewhere"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '缺少带单位的数值指标' END AS drop_message, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM customer")
def qc_patterns(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("营收增长"), (F.col("c_nationkey") + 1).cast("string"), F.lit(".5%"))).otherwise("没有任何指标")
    out = stages.quality_score(stages.completeness_qc(_items(table(spark, d, "customer"), "c_custkey", text, F.lit("好")), "finance"), "regex")
    return out.select(F.col("record_id").alias("c_custkey"), F.try_element_at(F.filter("issues", lambda i: i["level"] == "drop"), F.lit(1))["message"].alias("drop_message"), F.col("domain_score").alias("score"))


@query("""SELECT c_custkey, ['判决书','合同','法规','其他'][(c_custkey % 4 + 1)::BIGINT] AS doc_type, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '判决书必备要素缺失' ELSE '' END WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN '合同必备要素缺失' ELSE '' END WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN '法规必备要素缺失' ELSE '' END ELSE '' END AS messages,
CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 0.88 ELSE 1.0 END WHEN 1 THEN 0.88 WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 0.6 ELSE 0.8 END ELSE 0.0 END::DOUBLE AS score FROM customer""")
def qc_legal_types(spark: SparkSession, d: str) -> DataFrame:
    """What a legal text must hold, by its kind."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    short = F.col("c_custkey") % 3 == 0
    judgment = F.concat(F.lit("北京人民法院 判决书 案号"), n, F.when(short, "").otherwise(" 原告甲"), F.lit(" 2021年3月4日 判决如下"))
    contract = F.concat(F.lit("甲方与乙方"), F.when(short, "").otherwise("约定租金"), n, F.lit("元，第三条，签订"))
    contract = F.when(short, F.concat(F.lit("甲方与乙方"), n, F.lit("，第三条，签订"))).otherwise(F.concat(F.lit("甲方与乙方约定租金"), n, F.lit("元，第三条")))
    statute = F.concat(F.lit("第三条 办法"), n, F.when(short, "").otherwise("，自公布之日起施行"))
    text = F.when(k % 4 == 0, judgment).when(k % 4 == 1, contract).when(k % 4 == 2, statute).otherwise(F.concat(F.lit("普通文字"), n))
    items = stages.doc_type(_items(table(spark, d, "customer"), "c_custkey", text, F.lit("好")))
    out = stages.quality_score(stages.completeness_qc(items, "legal"), "regex")
    return out.select(F.col("record_id").alias("c_custkey"), "doc_type", F.array_join(F.transform(F.filter("issues", lambda i: i["stage"] == "completeness_qc"), lambda i: i["message"]), "；").alias("messages"), F.col("domain_score").alias("score"))


@query("SELECT row_id, any_value(CASE WHEN " + _strip("coalesce(instruction, '')") + " <> '' AND " + _strip("coalesce(output, '')") + " <> '' THEN 0.9 ELSE 0.2 END)::DOUBLE AS score FROM mmlu_csv_alpaca GROUP BY row_id")
def quality_pair(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "mmlu_csv_alpaca"), "row_id", "instruction", "output")
    return stages.quality_score(_items(rows, "row_id", F.col("instruction"), F.col("output")), "pair").select(F.col("record_id").alias("row_id"), F.col("domain_score").alias("score"))


@query("SELECT n_nationkey, '第' || n_nationkey || '条 与第三款' AS law, 'A. 甲' || chr(10) || 'B. 乙' || chr(10) || '答案:B' AS exam, '增长' || n_nationkey || '%，1-2' AS finance FROM nation")
def marks_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("第 "), k, F.lit(" 条 与第 三 款")).alias("law"), F.lit("A、甲\nB) 乙\n正确选项是：B").alias("exam"), F.concat(F.lit("增长"), k, F.lit("％，1–2")).alias("finance"))
    out = nations.select("id")
    for c, rules in (("law", R.LEGAL_MARKS), ("exam", R.EDUCATION_MARKS), ("finance", R.FINANCE_MARKS)):
        done = stages.marks(_items(nations, "id", F.col(c), F.lit("x")), rules, "marker_norm").select(F.col("record_id").alias("id"), _user().alias(c))
        out = out.join(done, "id")
    return out.select(F.col("id").cast("int").alias("n_nationkey"), "law", "exam", "finance")


@query("SELECT n_nationkey, ['判决书','裁定书','调解书','合同','司法解释','法规','其他'][n_nationkey % 7 + 1] AS doc_type FROM nation")
def doc_type_detect(spark: SparkSession, d: str) -> DataFrame:
    texts = ["某人民法院民事判决书 判决如下", "某人民法院民事裁定书", "民事调解书 调解如下", "甲方与乙方", "最高人民法院关于适用", "第三条 规定", "普通文字"]
    pick = F.element_at(F.array(*map(F.lit, texts)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", stages.doc_type_of(pick).alias("doc_type"))


@query("SELECT n_nationkey, '（2023）最高法民终' || (n_nationkey + 1) || '号|《民法典》|第' || (n_nationkey + 1) || '条' AS citations FROM nation")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("n_nationkey") + 1).cast("string")
    text = F.concat(F.lit("见( 2023 )最高法民终 "), n, F.lit(" 号，依《民法典》第"), n, F.lit("条，又见《民法典》。"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(stages.citations_of(F.array(stages.canonical_citations(text))), "|").alias("citations"))


@query("SELECT n_nationkey, node_id, parent_id, kind, no FROM nation, (VALUES (1, 0, '章', '1'), (2, 1, '条', '1'), (3, 2, '项', '1'), (4, 1, '条', '12')) AS t(node_id, parent_id, kind, no)")
def clause_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("引言\n第一章 总则\n第一条 内容"), F.col("n_nationkey").cast("string"), F.lit("\n（一）分项\n第十二条 其他"))
    trees = table(spark, d, "nation").select("n_nationkey", F.explode(stages.clause_trees(text)).alias("n"))
    return trees.select("n_nationkey", "n.node_id", "n.parent_id", "n.kind", "n.no")


@query("SELECT n_nationkey, '原告：张三' || n_nationkey AS party, '本院认为理由成立' || n_nationkey AS reason FROM nation")
def legal_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("某某\n原告：张三"), k, F.lit("\n  本院认为理由成立"), k)
    parts = table(spark, d, "nation").select("n_nationkey", stages.legal_parts(text).alias("p"))
    return parts.select("n_nationkey", F.col("p")["当事人"][0].alias("party"), F.col("p")["本院认为"][0].alias("reason"))


# ---------------------------------------------------------------- generators
@query("SELECT o_orderkey AS key, '主诉：胸闷' || o_orderkey || '天' || chr(10) || '诊断：冠心病' AS output FROM orders WHERE o_orderkey % 4 <> 0")
def gen_medical(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("主诉：胸闷"), k.cast("string"), F.lit("天\n"), F.when(k % 4 != 0, "诊断：冠心病").otherwise("随访：无"))
    return generators.generate(table(spark, d, "orders").select(k.alias("key"), text.alias("text")), "medical").select("key", "output")


@query("""SELECT n_nationkey AS key, CASE n_nationkey % 3 WHEN 0 THEN '甲方：公司' || n_nationkey || chr(10) || '乙方：商行' || chr(10) || '标的/价款：租金每月' || n_nationkey || '元' || chr(10) || '关键条款：第一条 交付'
WHEN 1 THEN '文书类型：判决书' || chr(10) || '案号：（2021）京' || n_nationkey || '号' || chr(10) || '当事人：原告张三' || chr(10) || '判决：判决如下：支持' ELSE '第1条要点：内容' || n_nationkey || chr(10) || '第2条要点：其他' END AS output FROM nation""")
def gen_legal(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    contract = F.concat(F.lit("甲方：公司"), n, F.lit("\n乙方：商行\n租金每月"), n, F.lit("元。\n第一条 交付。"))
    judgment = F.concat(F.lit("某人民法院民事判决书\n（2021）京"), n, F.lit("号\n原告：张三\n判决如下：支持"))
    statute = F.concat(F.lit("第一条 内容"), n, F.lit("\n第二条 其他"))
    text = F.when(k % 3 == 0, contract).when(k % 3 == 1, judgment).otherwise(statute)
    return generators.generate(table(spark, d, "nation").select(k.alias("key"), text.alias("text")), "legal").select("key", "output")


# ---------------------------------------------------------------- whole tables
def _documents(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(spark, d, "documents").where("doc_id is not null"), "doc_id", "text")


@query()
def documents_sections(spark: SparkSession, d: str) -> DataFrame:
    blocks = _documents(spark, d).select("doc_id", F.posexplode(stages.sections_of("text")).alias("place", "b"))
    return blocks.select("doc_id", "place", "b.name", "b.body")


@query()
def documents_clauses(spark: SparkSession, d: str) -> DataFrame:
    trees = _documents(spark, d).select("doc_id", F.explode(stages.clause_trees("text")).alias("n"))
    return trees.select("doc_id", "n.node_id", "n.parent_id", "n.kind", "n.no")


@query()
def documents_citations(spark: SparkSession, d: str) -> DataFrame:
    found = _documents(spark, d).select("doc_id", stages.citations_of(F.array(stages.canonical_citations(F.col("text")))).alias("citations"))
    return found.where(F.size("citations") > 0).select("doc_id", F.posexplode("citations").alias("place", "citation"))


@query()
def documents_doc_type(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", stages.doc_type_of(F.col("text")).alias("doc_type"))


@query()
def documents_parts(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.explode(stages.legal_parts("text")).alias("part", "lines"))


def _drawn(spark: SparkSession, d: str, domain: str) -> DataFrame:
    return generators.generate(_documents(spark, d).select(F.col("doc_id").alias("key"), "text"), domain)


@query()
def documents_gen_medical(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d, "medical").select("key", "output")


@query()
def documents_gen_legal(spark: SparkSession, d: str) -> DataFrame:
    return _drawn(spark, d, "legal").select("key", "output")


def _curated(items: DataFrame, domain: str, preset: str) -> DataFrame:
    """Items through all stages. They are cut from how they were made, as the pipeline's are by their ids: the optimizer
    would write the text's expressions into every stage again, a plan of megabytes that the driver holds many times."""
    from weirgate.plans.pipeline import curate

    return curate(durable(items), domain, preset).select("record_id", "status", "drop_reason", "domain_score", _codes().alias("codes"))


@query()
def documents_curated(spark: SparkSession, d: str) -> DataFrame:
    """The pairs drawn from legal documents, curated as the pipeline does."""
    pairs = _drawn(spark, d, "legal")
    return _curated(_items(pairs, "key", F.concat_ws("\n", "instruction", "input"), F.col("output")), "legal", "legal_cn")


@query()
def work_item_curated(spark: SparkSession, d: str) -> DataFrame:
    """Every work item from the start, as a case history."""
    rows = one_per_key(table(spark, d, "work_item").where("record_id is not null"), "record_id", "source", "messages")
    return _curated(rows.withColumn("meta", F.lit(None).cast(META)).withColumn("issues", no_issues()), "medical", "medical_cn")


# ---------------------------------------------------------------- reports
@query("SELECT i.stage AS stage, count(*) AS issues, count(DISTINCT CASE WHEN i.level = 'cleaned' THEN record_id END) AS cleaned_rows FROM (SELECT record_id, unnest(issues) AS i FROM (SELECT record_id, any_value(issues) AS issues FROM work_item GROUP BY record_id)) GROUP BY 1")
def stage_stats(spark: SparkSession, d: str) -> DataFrame:
    return verdict.stage_stats(one_per_key(table(spark, d, "work_item"), "record_id", "issues"))


@query("""SELECT record_id, source, status, coalesce(drop_reason, '') AS drop_reason, left(array_to_string(list_transform(list_filter(issues, lambda i: i.level IN ('warning', 'drop'))[1:4], lambda i: i.message), '；'), 200) AS notes
FROM (SELECT record_id, any_value(source) source, any_value(status) status, any_value(drop_reason) drop_reason, any_value(issues) issues FROM work_item GROUP BY record_id) ORDER BY record_id LIMIT 20""")
def preview20(spark: SparkSession, d: str) -> DataFrame:
    return verdict.preview(one_per_key(table(spark, d, "work_item"), "record_id", "source", "status", "drop_reason", "issues"))


@query("SELECT coalesce(a.k, e.k) AS k, CASE WHEN a.k IS NULL THEN 'missing_actual' WHEN e.k IS NULL THEN 'missing_expected' WHEN a.v IS NOT DISTINCT FROM e.v THEN 'match' ELSE 'mismatch' END AS outcome FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 3 <> 0) e ON a.k = e.k")
def expected_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("value"))
    changed = orders.where("k % 3 <> 0").withColumn("value", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("value")))
    return verdict.compare_expected(orders.where("k % 5 <> 0"), changed, "k")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 100")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return verdict.round_robin(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 100).select("source", "doc_id")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'A') AS answer FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def lookup_left_join(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_mktsegment")
    joined = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(answers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("A")).alias("answer"))


@query("SELECT row_no, letter FROM (SELECT row_no, substring('ABCD', (row_no % 4 + 1)::BIGINT, 1) AS letter FROM cmmlu_education) GROUP BY ALL")
def index_letter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cmmlu_education").select("row_no", F.substring(F.lit("ABCD"), (F.col("row_no") % 4 + 1).cast("int"), F.lit(1)).alias("letter")).distinct()


@query(r"SELECT row_id FROM mmlu_csv_alpaca WHERE instruction IS NOT NULL GROUP BY row_id HAVING NOT bool_or(regexp_matches(instruction, '(?m)^[A-D]\. '))")
def without_options(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mmlu_csv_alpaca").where(F.col("instruction").isNotNull() & ~F.col("instruction").rlike(r"(?m)^[A-D]\. ")).select("row_id").distinct()


@query("SELECT source AS file FROM (SELECT DISTINCT lower(trim(regexp_replace(regexp_replace(source, '#.*$', ''), '^.*[/' || chr(92) || chr(92) || ']', ''))) AS source FROM mmlu_csv_alpaca) WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) AND source <> ''")
def files_missing(spark: SparkSession, d: str) -> DataFrame:
    from weirgate.sources.tables import source_file

    named = table(spark, d, "mmlu_csv_alpaca").select(source_file(F.col("source")).alias("file")).distinct().where("file <> 'unknown'")
    have = table(spark, d, "documents").select(F.col("source").alias("file")).where("file is not null").distinct()
    return named.join(have, "file", "left_anti")


@query("SELECT coalesce(meta.format, 'none') AS format, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'dropped') AS dropped FROM (SELECT record_id, any_value(meta) AS meta, any_value(status) AS status FROM work_item GROUP BY record_id) GROUP BY 1")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "work_item"), "record_id", "meta", "status").select(F.coalesce("meta.format", F.lit("none")).alias("format"), "status")
    return verdict.status_by_class(rows, "format", "status", ["pending", "kept", "dropped"])


@query("SELECT doc_id, text FROM documents WHERE length(text) BETWEEN 200 AND 2000 AND contains(text, '违约') ORDER BY doc_id LIMIT 1")
def first_document(spark: SparkSession, d: str) -> DataFrame:
    return verdict.first_match(table(spark, d, "documents").select("doc_id", "text"), 200, 2000, "违约")


@query("SELECT doc_id, 0 AS part FROM (SELECT doc_id FROM documents WHERE source = 'lesson_notes.txt' ORDER BY doc_id LIMIT 10) UNION ALL SELECT doc_id, 1 AS part FROM (SELECT doc_id FROM documents WHERE source = 'crawl_misc.txt' ORDER BY doc_id LIMIT 10)")
def head_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return verdict.head_merge([docs.where(F.col("source") == s).select("doc_id") for s in ("lesson_notes.txt", "crawl_misc.txt")], "doc_id", 10)
