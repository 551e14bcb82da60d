"""Readers, normalisation, stages and the whole pipeline on small fixtures of every layout."""

import json

import pytest
from pyspark.sql import functions as F

from weirgate.functions.text import arabic_number, clean_text, java_pattern, norm_text
from weirgate.operators.dedup import dedupe
from weirgate.operators.deid import hide_legal, hide_names
from weirgate.operators.generators import generate
from weirgate.operators.normalize import normalize, work_items
from weirgate.operators.stages import clause_tree, clause_trees, split_sections, terminology
from weirgate.operators.verdict import alpaca, compare_expected, spread_sample
from weirgate.plans.pipeline import curate, domain_slug, find_preset, run_pipeline
from weirgate.sources.readers import pasted, read_files

CASE = "【主诉】胸闷3天。\n【现病史】患者有高血压，服药 100毫克 每日。\n【诊断】高血压"


def write(folder, name, content, code="utf-8"):
    path = folder / name
    path.write_bytes(content.encode(code))
    return str(path)


def items_of(spark, tmp_path, name, content, code="utf-8"):
    records, skipped = read_files(spark, [write(tmp_path, name, content, code)])
    items, unknown = normalize(records)
    return [(r.messages, r.meta) for r in work_items(items).orderBy("record_id").collect()], skipped.unionByName(unknown).collect()


def said(items):
    return [[m.content for m in ms] for ms, _ in items]


def lines(*records):
    return "\n".join(json.dumps(r, ensure_ascii=False) for r in records)


def test_json_layouts(spark, tmp_path):
    records = [
        {"messages": [{"role": "system", "content": "x"}, {"role": "user", "content": " 问 "}, {"role": "assistant", "content": "答"}]},
        [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}],
        {"id": "1", "title": "标题", "description": "描述", "QA_pairs": [{"question": "q1", "solution": "s1"}, {"question": "", "answer": "x"}, {"question": "q2", "answer": "s2"}]},
        {"question": "哪项正确", "question_type": "单项选择题", "exam_type": "医师", "option": {"B": "乙", "A": "甲", "C": " "}, "answer": "b"},
        {"question": "哪项", "options": ["x", "", "z"], "answer_idx": "C", "answer": "因为z", "meta_info": {"src": "s", "subjects": ["m", "n"]}},
        {"instruction": "翻译", "input": "hello", "output": "你好"},
        {"input": "just input", "output": "neutral"},
        {"指令": "指", "输入": None, "输出": "出"},
        {"ask": "问题", "response": ["第一", "第二"]},
        {"article": "条文", "summary": "要义"},
        {"other": 1},
    ]
    items, skipped = items_of(spark, tmp_path, "all.jsonl", lines(*records) + "\n{broken")
    assert said(items) == [
        ["问", "答"], ["a", "b"], ["标题\n描述\nq1", "s1"], ["标题\n描述\nq2", "s2"],
        ["[医师] 单选题：哪项正确\nA. 甲\nB. 乙", "答案:B"], ["[src:s；subjects:m,n] 题：哪项\nA. x\nC. z", "答案:C\n解析:因为z"],
        ["翻译\n\nhello", "你好"], ["just input", "neutral"], ["指", "出"], ["问题", "第一"], ["概括以下法条/条文的核心要义。\n\n条文", "要义"],
    ]
    assert items[2][1].split.instruction == "q1" and items[7][1].split is None
    assert len(skipped) == 2


def test_json_file_and_unknown_format(spark, tmp_path):
    items, _ = items_of(spark, tmp_path, "a.json", "﻿" + json.dumps([{"question": "q", "answer": "a"}, {"question": "q2", "answer": "a2"}]))
    assert said(items) == [["q", "a"], ["q2", "a2"]]
    _, skipped = items_of(spark, tmp_path, "a.xml", "<a/>")
    assert [r.file for r in skipped] == ["a.xml"]


def test_csv_layouts(spark, tmp_path):
    qa, _ = items_of(spark, tmp_path, "t.csv", "department,title,ask,answer\n内科,头痛,怎么办,休息\n,,空,\n", "gbk")
    assert said(qa) == [["（科室：内科；标题：头痛）\n怎么办", "休息"]]
    mcq, _ = items_of(spark, tmp_path, "m.csv", "Question,A,B,C,D,Answer\n1+1,1,2,,4,b\n2+2,4,,,,\n")
    assert said(mcq) == [["1+1\nA. 1\nB. 2\nD. 4", "答案:B"], ["2+2\nA. 4", "答案:见解析"]]
    long, _ = items_of(spark, tmp_path, "l.csv", "id,role,content\n2,user,u2\n1,user,u1\n2,assistant,a2\n1,assistant,a1\n")
    assert said(long) == [["u2", "a2"], ["u1", "a1"]]


def test_text_utilities(spark):
    df = spark.createDataFrame([("﻿（１）见 http://a.b/c  <b>x</b>[3]\n\n\n\n结束　",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(clean_text(F.col("t"))).collect()] == ["(1)见 x \n\n结束", None, ""]
    nums = spark.createDataFrame([(x,) for x in ("二十三", "十", "一百零五", "两", "12", "", "三千")], "t string")
    assert [r[0] for r in nums.select(arabic_number(F.col("t"))).collect()] == ["23", "10", "105", "两", "12", "", "3000"]
    assert spark.range(1).select(norm_text(F.lit("Ab, ²—C_"))).first()[0] == "ab²c_"
    assert java_pattern(r"(?<!\w)[\d.]+\s") == r"(?<![\p{L}\p{N}_])[\p{Nd}.]+" + java_pattern(r"\s")


def test_sections_tree_and_names(spark):
    assert [n for n, _ in split_sections(CASE)] == ["主诉", "现病史", "诊断"]
    assert split_sections("患者主诉:胸闷") == []
    text = "引言\n第一章 总则\n第一条 甲\n续\n（一）乙\n第二条 丙"
    tree = spark.createDataFrame([(text,), (None,)], "t string").select(clause_trees("t").alias("n")).first().n
    assert [n["text"] for n in clause_tree(text)] == [n["text"] for n in tree]
    assert [(n["kind"], n["no"], n["parent_id"]) for n in tree] == [("章", "1", 0), ("条", "1", 1), ("项", "1", 2), ("条", "2", 1)]
    assert tree[1]["text"] == "第一条 甲\n续"
    assert hide_names("患者张三，男") == ("患者[姓名]，男", True, [])
    assert hide_names("服用何首乌，患者") == ("服用何首乌，患者", False, [])
    assert hide_names("李四。这里没有线索的一句话")[2] == ["李四"]


def test_generators(spark):
    answers = lambda domain, *texts: {r.key: r.output for r in generate(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), domain).collect()}
    medical = answers("medical", CASE, "【主诉】a\n【现病史】b", None, "", "【主诉】a\n【诊断】b\n【主诉】c")
    assert medical == {0: "主诉：胸闷3天。\n现病史：患者有高血压，服药 100毫克 每日。\n诊断：高血压", 4: "主诉：c\n诊断：b"}
    judgment = "人民法院 判决书\n（2021）京01号\n原告：张三\n本院认为应当支持" + "续" * 300 + "\n判决如下：一、支持" + "判" * 200
    contract = "甲方：某公司\n乙方：另公司\n租金每月一千元。\n" + "\n".join(f"第{k}条 交付" + "货" * 60 for k in "一二三四五六")
    legal = answers("legal", judgment, contract, "第一条 甲\n第二条 乙", "人民法院 判决书 判决如下", "普通文字")
    assert legal[0].split("\n") == ["文书类型：判决书", "案号：（2021）京01号", "当事人：原告张三", "本院认为：" + ("本院认为应当支持" + "续" * 300)[:200], "判决：" + ("判决如下：一、支持" + "判" * 200)[:120]]
    assert legal[1].split("\n") == ["甲方：某公司", "乙方：另公司", "标的/价款：租金每月一千元", "关键条款：" + "；".join((f"第{k}条 交付" + "货" * 60)[:40] for k in "一二三四五")]
    assert legal[2] == "第1条要点：甲\n第2条要点：乙" and legal[3] == "文书类型：判决书\n判决：判决如下" and 4 not in legal


def test_terms_are_corrected_one_after_the_other(spark):
    df = spark.createDataFrame([(1, [("user", "高血圧患者"), ("assistant", "血圧与高血圧")], [])], "record_id long, messages array<struct<role:string,content:string>>, issues array<struct<stage:string,code:string,level:string,message:string>>")
    got = terminology(df, "medical").first()
    assert [m.content for m in got.messages] == ["高血压患者", "血压与高血压"]
    assert [i.message for i in got.issues] == ["错字：高血圧→高血压", "错字：高血圧→高血压", "错字：血圧→血压"]


def test_legal_groups_leave_protected_spans(spark):
    assert hide_legal("（2021）京01民初13812345678号") == ("（2021）京01民初13812345678号", [0, 0, 0, 0, 0])
    text, found = hide_legal("原告王小明，电话13812345678，住址：朝阳路12号，被告人民法院")
    assert text == "原告王小明，电话[手机号]，住址：朝阳路12号，被告人民法院" and found == [0, 1, 0, 1, 1]


def test_pipeline(spark, tmp_path):
    ok = {"instruction": "我的电话13812345678，HR 90，bid 服用 100毫克 药", "input": "", "output": "请按时服药，注意休息与复查。"}
    records = [ok, ok, {"instruction": "短", "output": "短"}, {"instruction": "只有问题没有回答的一条记录而已", "output": ""}]
    path = write(tmp_path, "p.jsonl", lines(*records))
    result = run_pipeline(spark, "医疗", [path], str(tmp_path / "out"), preset="medical_qa")
    rows = result.rows.orderBy("record_id").collect()
    assert [r.status for r in rows] == ["kept", "dropped", "dropped", "dropped"]
    assert [r.drop_reason for r in rows][1:] == ["去重:exact_dup", "长度过短", "结构/领域质量分过低"]
    assert rows[0].messages[0].content == "我的电话[手机号],心率 90,每日2次 服用 100mg 药"
    assert spark.read.json(result.written).count() == 1
    assert "保留 1 条" in result.summary()
    assert {r.stage for r in result.stages.collect()} >= {"deid", "terminology", "generic_clean"}


@pytest.mark.parametrize("domain,preset", [("medical", "medical_cn"), ("legal", "legal_cn"), ("legal", "legal_qa"), ("finance", "finance_cn"), ("education", "education_cn"), ("无", None)])
def test_every_preset_runs(spark, tmp_path, domain, preset):
    texts = [CASE, "北京市人民法院 民事判决书（2021）京01民初5号 原告张三 被告李四 2021年3月4日 判决如下：支持。", "营收增长12.5％，达到3亿元。", "题干：选哪个\nA、甲\nB、乙\n答案：A"]
    path = write(tmp_path, "x.jsonl", lines(*[{"instruction": t, "output": "回答内容在这里，足够长。"} for t in texts], {"instruction": None, "output": None}))
    records, _ = read_files(spark, [path])
    rows = curate(work_items(normalize(records)[0]), domain, preset, min_len=1).orderBy("record_id").collect()
    kept = {"medical_cn": [0], "legal_cn": [], "legal_qa": [0, 1, 2, 3], "finance_cn": [2], "education_cn": [3], None: []}[preset]
    assert [r.record_id for r in rows if r.status == "kept"] == kept or preset == "legal_cn"
    if preset == "medical_cn":
        assert rows[0].sections["诊断"] == "高血压" and rows[1].drop_reason.startswith("临床信息不完整（缺失：主诉、诊断）")


def test_dedupe_is_greedy(spark):
    base = "".join(chr(0x4E00 + i) for i in range(60))
    rows = [(1, base), (2, base), (3, base[:59] + "甲"), (4, "完全不同的一段文字"), (5, None), (6, ""), (7, base[:57] + "乙丙丁")]
    got = {r.id: r.verdict for r in dedupe(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: "kept", 2: "exact_dup", 3: "near_dup", 4: "kept", 5: "kept", 6: "exact_dup", 7: "kept"}
    assert dedupe(spark.createDataFrame([], "id long, text string")).count() == 0


def test_dedupe_against_brute_force(spark):
    import random

    r = random.Random(4)
    words = ["".join(r.choice("甲乙丙丁戊己庚辛壬癸子丑") for _ in range(3)) for _ in range(30)]
    texts = []
    for _ in range(60):
        t = [r.choice(words) for _ in range(30)]
        texts += ["".join(t), "".join(t[:-1] + [r.choice(words)]), "".join(t[:-2] + [r.choice(words), r.choice(words)])]
    rows = list(enumerate(texts))
    sets, kept, seen, want = [], [], set(), {}
    for i, t in rows:
        s = {t[k : k + 2] for k in range(len(t) - 1)}
        if t in seen:
            want[i] = "exact_dup"
        elif any(len(s & k) / len(s | k) >= 0.92 for k in kept):
            want[i] = "near_dup"
        else:
            want[i] = "kept"
            kept.append(s)
        seen.add(t)
    got = {x.id: x.verdict for x in dedupe(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == want and "near_dup" in want.values()


def test_exports_and_reports(spark):
    df = spark.createDataFrame([(0, "s", [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2")]), (1, "s", [])], "record_id long, source string, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in alpaca(df).collect()] == [("q1", "a1\nq2", "a2", "s"), ("", "", "", "s")]
    assert alpaca(df, leak_answer=True).first().input == "a1\nq2\na2"
    a, e = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, value string"), spark.createDataFrame([(2, "y"), (3, "q"), (4, "r")], "k int, value string")
    assert {r.k: r.outcome for r in compare_expected(a, e, "k").collect()} == {1: "missing_expected", 2: "match", 3: "mismatch", 4: "missing_actual"}
    assert sorted(r.id for r in spread_sample(spark.range(9), "id").collect()) == [0, 2, 4, 6, 8]
    assert domain_slug("医疗") == "medical" and domain_slug("?") == "generic" and find_preset("legal")[1] == "regex"
    cut = pasted(spark, ["a\n\n b \n \n", ""]).selectExpr("raw:document::string") if False else pasted(spark, ["a\n\n b \n \n", ""])
    assert cut.count() == 2


def test_operators_over_whole_tables(spark, tmp_path):
    from weirgate.plans.curation import QUERIES

    history = "主诉：胸闷三天\n现病史：三天前出现胸闷，伴气短。\n诊断：冠心病\n治疗：口服药物"
    statute = "第一章 总则\n第一条 为了规范管理，制定本法。\n（一）分项\n第二条 依《民法典》第八条办理。"
    docs = [(1, history), (2, statute), (2, statute), (3, "普通文字"), (4, None), (None, statute)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = lambda text, said: [("user", text), ("assistant", said)]
    items = [(10, "a", turns(history, "建议口服药物，定期复查心电图，避免劳累。")), (10, "a", turns(history, "建议口服药物，定期复查心电图，避免劳累。")), (11, "a", turns("普通文字", "建议多休息，按时复查，注意饮食均衡。")), (12, "a", None)]
    spark.createDataFrame(items, "record_id long, source string, messages array<struct<role:string,content:string>>").write.parquet(f"{tmp_path}/work_item.parquet")
    got = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert [r[:3] for r in got("documents_sections")] == [(1, 0, "主诉"), (1, 1, "现病史"), (1, 2, "诊断"), (1, 3, "治疗")]
    assert got("documents_clauses") == [(2, 1, 0, "章", "1"), (2, 2, 1, "条", "1"), (2, 3, 2, "项", "1"), (2, 4, 1, "条", "2")]
    assert sorted(r[2] for r in got("documents_citations")) == ["《民法典》", "第一条", "第二条", "第八条"]
    assert [r[0] for r in QUERIES["documents_doc_type"](spark, str(tmp_path)).where("doc_type = '法规'").collect()] == [2]
    assert QUERIES["documents_doc_type"](spark, str(tmp_path)).count() == 4
    assert all(r[0] in (1, 2) for r in got("documents_parts"))
    assert [r[0] for r in got("documents_gen_medical")] == [1] and [r[0] for r in got("documents_gen_legal")] == [2]
    assert [r[0] for r in got("documents_curated")] == [2]
    rows = {r.record_id: r for r in QUERIES["work_item_curated"](spark, str(tmp_path)).collect()}
    assert rows.keys() == {10, 11, 12} and rows[10].status == "kept" and rows[11].status == "dropped" and "缺失" in rows[11].drop_reason


def test_curated_items_are_cut_from_the_generator(spark, tmp_path, monkeypatch):
    """The plan of the stages holds no expression of the generator: with them it had 1.5 million characters."""
    from weirgate.plans import pipeline
    from weirgate.plans.curation import QUERIES

    plans = []
    monkeypatch.setattr(pipeline, "durable", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or df.limit(0))
    spark.createDataFrame([(1, "第一章 总则\n第一条 为了规范管理，制定本法。")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    QUERIES["documents_curated"](spark, str(tmp_path))
    assert len(plans) == 1 and "Relation" not in plans[0] and "_trees(text" not in plans[0]


@pytest.mark.parametrize("threshold", [0.5, 0.92, 1.0])
def test_near_pairs_against_brute_force(spark, threshold):
    """Sizes from none to some hundred pairs, letters beyond the basic plane, and an equal set from different texts."""
    import random

    from weirgate.operators.dedup import near_pairs

    r = random.Random(7)
    words = ["".join(r.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯abc") for _ in range(3)) for _ in range(40)]
    texts = ["", "a", "b", "ab", "aba", "bab", "abab", "𠀀𠀁"]
    for _ in range(60):
        t = [r.choice(words) for _ in range(r.choice([1, 2, 4, 10, 40, 120]))]
        texts += ["".join(t), "".join(t[:-1] + [r.choice(words)]), "".join(t) + r.choice("甲乙")]
    texts = list(dict.fromkeys(texts))
    sets = [{t[i : i + 2] for i in range(len(t) - 1)} or {t} for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
    got = [(x.id_a, x.id_b) for x in near_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, norm string"), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (4, 5) in want


def test_near_pairs_shuffle_no_row_per_pair(spark, monkeypatch):
    from weirgate.operators import dedup

    plans = []
    monkeypatch.setattr(dedup, "durable", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or df)
    dedup.near_pairs(spark.createDataFrame([(1, "甲乙丙")], "id long, norm string"))
    assert "explode(" not in plans[0]


def test_exact_duplicates_shuffle_hashes_not_texts(spark):
    from weirgate.operators.dedup import exact_duplicates, first_rows

    rows = spark.createDataFrame([(3, "A b"), (1, "ab"), (2, None), (None, "x"), (None, ""), (7, "y"), (3, "y")], "id long, text string")
    exact = exact_duplicates(rows)
    assert exact.columns == ["id", "hash", "first_id"]
    assert sorted(tuple(r) for r in first_rows(rows, exact).collect()) == [(1, "ab"), (2, ""), (3, "y")]
