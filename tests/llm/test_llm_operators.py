"""Operators for language-model text: edge cases, exact comparisons and held-out accuracy."""

import random
import re
import unicodedata

import numpy as np
import pytest

from weirgate.functions.tokens import vocabulary_path
from weirgate.llm import broken_pairs as bp
from weirgate.llm import garbled, junk_pages, junk_training, leakage, pii, pii_training, token_budget, visual_form
from weirgate.llm.byte_bpe import byte_bpe, encode_documents

PUBLIC = pytest.importorskip("public_tokenizers")
BPE = vocabulary_path("byte_bpe_50k.tiktoken")
PIECES = vocabulary_path("piece_bpe_32k.model")


def mixed(r, n):
    ranges = [(32, 127), (97, 123), (0x4E00, 0x9FFF), (0x80, 0x2000), (0x1F300, 0x1F600), (9, 14)]
    return "".join(chr(r.randrange(*r.choice(ranges))) for _ in range(n))


# ---------------------------------------------------------------- 8
def test_byte_bpe_equals_the_library():
    import tiktoken

    from weirgate.functions.tokens import byte_ranks

    lib = tiktoken.Encoding("t", pat_str=PUBLIC.PATTERN, mergeable_ranks=byte_ranks(BPE), special_tokens={})
    mine = byte_bpe(BPE, PUBLIC.PATTERN)
    r = random.Random(1)
    texts = [mixed(r, r.randrange(0, 300)) for _ in range(400)] + ["".join(r.choice("abcdeths ") for _ in range(200)) for _ in range(200)] + ["a" * 3000, " " * 999, "<|endoftext|>", "\x00", "👩‍⚕️"]
    for t in texts:
        assert mine.encode(t) == lib.encode_ordinary(t)


def test_encode_documents_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " ", 5), (1, "答 a", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode_documents(df, "doc_id", "text", BPE, PUBLIC.PATTERN)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got.collect())[:4] == [(0, 1), (1, 0), (1, 3), (2, 0)]
    assert encode_documents(df.limit(0), "doc_id", "text", BPE, PUBLIC.PATTERN).count() == 0


# ---------------------------------------------------------------- 1
@pytest.fixture(scope="module")
def trie():
    return token_budget.DoubleArray.build(token_budget.unigram_pieces(PIECES))


def brute_viterbi(trie, pieces, text):
    best = [(0.0, 0)] + [(float("-inf"), 0)] * len(text)
    for i, c in enumerate(text):
        s, n = best[i]
        options = [(i + len(p), s + w, n + 1) for p, w in pieces.items() if text.startswith(p, i)]
        if c not in pieces:
            w = len(c.encode())
            options.append((i + 1, s + token_budget.BYTE_SCORE * w, n + w))
        for j, v, k in options:
            if v > best[j][0]:
                best[j] = (v, k)
    return best[-1][1]


def test_viterbi_against_brute_force(trie):
    pieces = {"a": -1.0, "b": -2.0, "ab": -2.5, "abc": -2.6, "c": -3.0, "▁": -0.5, "▁a": -1.2, "中": -2.0}
    small = token_budget.DoubleArray.build(pieces)
    r = random.Random(3)
    texts = ["".join(r.choice("abc▁中é文") for _ in range(r.randrange(1, 30))) for _ in range(300)]
    assert list(small.counts(texts)) == [brute_viterbi(small, pieces, t) for t in texts]


def test_estimate_is_close_on_other_texts(trie):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["The claimant may waive the balance within 30 days of default, unless both sides sign.", "存款准备金率对自由现金流的影响，应如何解读？", "Mixed 中英 text with 12345 digits, naïve café and 😀 signs.", "a" * 500, "中" * 3000] * 3
    cut = token_budget.cutter(trie)
    mine = [int(trie.counts(token_budget.segments_of(t, cut)).sum()) for t in texts]
    real = [len(sp.encode(t)) for t in texts]
    assert abs(sum(mine) - sum(real)) < 0.05 * sum(real)


def test_token_budget_edges(spark):
    schema = "row_id long, instruction string, source string, lang string, domain string, n_tokens string"
    rows = [(1, "你好", "data/A.csv#1", "ZH", "医疗", "x"), (1, "你好", "data/A.csv#1", "ZH", "医疗", "y"), (2, None, None, None, None, None), (3, "", "a.CSV", "zh-CN", "medical", None), (None, "x", "a.csv", "zh", "medical", None)]
    got = {(r.source, r.lang, r.domain): (r.n_docs, r.n_empty, r.n_tokens) for r in token_budget.token_budget(spark.createDataFrame(rows, schema), PIECES).collect()}
    assert got == {("a.csv", "zh", "medical"): (2, 1, 3), ("unknown", "unknown", "unknown"): (1, 1, 0)}
    assert token_budget.token_budget(spark.createDataFrame([], schema), PIECES).count() == 0


# ---------------------------------------------------------------- 10
PROSE = "患者自述近两个月反复出现头晕，伴有乏力，休息后缓解。建议先完善血常规，再根据结果决定是否用药。"


@pytest.mark.parametrize(
    "text,junk",
    [
        (PROSE * 3, False),
        (None, False),
        ("", False),
        (" \n ", False),
        ("护膝 包邮 | 护膝 正品 | 护膝 新款 | 血压计 现货 | 护膝 特价 | 血压计 批发 | 护膝 官方", True),
        ("护膝价格、护膝 厂家、护膝批发、护膝图片、护膝 报价、护膝官网、护膝 代理、护膝哪里买", True),
        ("\n".join(f"* [学习机{x}](http://a{i}.example/item/{i})" for i, x in enumerate("价格 厂家 批发 图片".split())), True),
        ("http://a.example/1 http://b.example/2 www.c.test/3 http://d.test/4", True),
        (PROSE * 4 + "\n参考：\nhttp://a.example/1\nhttp://b.example/2", False),
        ("第一章 向量运算……1\n第二章 化学平衡……10\n第三章 电磁感应……23\n第四章 生态系统……34", False),
        ("指标\t本期\t上期\n流动比率\t43.93\t87.59\n净利率\t27.41\t78.68\n毛利率\t8.67\t15.22", False),
        ("1. Explain how the ratio relates to osmosis.\n2. Describe what the margin means for probability.", False),
        ("study lamp cheap, study lamp sale, best price study lamp, study lamp near me, study lamp original, sale study lamp", True),
        (PROSE * 2000, False),
    ],
)
def test_junk(text, junk):
    assert (junk_pages.junk_shares([text])[0] > 0.5) == junk


def by_pieces_alone(text):
    """The share that comes out if each piece is judged by its own measures, without the moves of the model."""
    pieces = junk_pages.measured([text])
    m = junk_pages.model()
    alone = junk_pages.Model(m.first, 0 * m.moves, m.emit)
    junk = [s in junk_pages.JUNK for s in (alone.scores(pieces.measures) + np.log(np.exp(m.first))).argmax(1)]
    return float((pieces.visible * junk).sum() / pieces.visible.sum())


#: Lists of which some pieces say little by themselves: the pieces around them decide.
WEAK_TAGS = "血压计 现货 | 血压计 送礼 | 理财课 正品 | 筋膜枪 送礼 | 足浴盆 轻便 | 护眼台灯 正品 | 筋膜枪 厂家直销 | 足浴盆 官方 | 足浴盆 现货 | 血压计 批发 | 足浴盆 新款 | 真皮公文包 特价"
WEAK_LINKS = "\n".join(x for i in range(12) for x in (f"http://a{i}.example/item/{i}", f"https://www.b{i}.test/go/{i}", "甲乙丙丁戊己庚辛壬癸子丑"[i] + "站入口"))


def test_neighbours_decide_where_a_piece_says_little():
    assert list(junk_pages.junk_shares([WEAK_TAGS, WEAK_LINKS])) == [1.0, 1.0]
    assert by_pieces_alone(WEAK_TAGS) < 0.5


def test_pages_are_judged_alike_alone_and_together():
    texts = [WEAK_LINKS, PROSE, None, "", WEAK_TAGS, PROSE * 50, "x"]
    together = junk_pages.junk_shares(texts)
    assert [junk_pages.junk_shares([t])[0] for t in texts] == list(together)


def test_the_model_is_fitted_from_pages():
    texts = [PROSE * k for k in range(1, 30)] + [WEAK_LINKS, WEAK_TAGS] * 10
    first, last = (junk_training.fit(texts, rounds=k, say=lambda s: None) for k in (1, 4))
    score = lambda m: sum(junk_training.log_likelihood(t, m) for t in texts)
    assert score(last) >= score(first) and not np.allclose(np.exp(last.moves), junk_training.prior()[1])


def test_junk_pages_edges(spark):
    bad = "http://a.example/1 http://b.example/2 http://c.test/3"
    df = spark.createDataFrame([(1, bad, "x"), (1, bad, "y"), (2, None, ""), (3, PROSE, "")], "doc_id long, text string, junk string")
    assert [r.doc_id for r in junk_pages.junk_pages(df).collect()] == [1]
    assert junk_pages.junk_pages(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 4
def test_visual_mapping_is_final():
    m = visual_form.visual_mapping()
    visual_form.check_mapping(m)
    run = visual_form.transducer()
    r = random.Random(5)
    for _ in range(500):
        t = mixed(r, 40) + "éх²"
        assert run(run(t)) == run(t)
    with pytest.raises(ValueError):
        visual_form.check_mapping({**m, "Q": "q"})
    with pytest.raises(ValueError):
        visual_form.check_mapping({**m, "é": "e"})


@pytest.mark.parametrize("a,b,same", [("ＡＢＣ１２", "ABC12", True), ("café", "café", True), ("a b　c", "a b c", True), ("Се​о", "Ceo", True), ("ﬁnd ⽅", "find 方", True), ("e​́", "é", True), ("m²", "m2", False), ("café", "cafe", False), ("ABC", "aBC", False), ("a b", "a  b", False), ("Ω", "Q", False), ("Ω", "Ω", True), ("µ", "μ", True), ("正确", "正 确", False)])
def test_visual_form(a, b, same):
    run = visual_form.transducer()
    assert (run(a) == run(b)) == same


def test_look_alike_pairs(spark):
    schema = "table_name string, key long, text string, form int"
    rows = [("t", 1, "ＡＢ", 0), ("t", 2, "AB", 0), ("t", 3, "AB", 0), ("u", 4, "AB", 0), ("t", 5, None, 0), ("t", 6, "​", 0), ("t", 7, " ", 0), ("t", 1, "ＡＢ", 9), ("t", None, "АВ", 0)]
    got = sorted(tuple(r) for r in visual_form.look_alike_pairs(spark.createDataFrame(rows, schema)).collect())
    assert got == [("t", 1, 2), ("t", 1, 3)]
    assert visual_form.look_alike_pairs(spark.createDataFrame([], schema)).count() == 0
    classes = {(r.table_name, r.key): (r.n_texts, r.n_keys) for r in visual_form.look_alike_classes(spark.createDataFrame(rows, schema)).collect()}
    assert classes == {("t", 1): (2, 3), ("t", 2): (2, 3), ("t", 3): (2, 3), ("u", 4): (1, 1)}
    assert visual_form.look_alike_classes(spark.createDataFrame([], schema)).count() == 0


def test_one_pass_equals_clusters_taken_one_by_one():
    m = visual_form.visual_mapping()
    run = visual_form.transducer()
    r = random.Random(21)
    some = [*"aeoАеｅ，Ω℃　\u200b\u00ad", "\u0301", "\u0308", "\u0323", "é", "方"]
    for _ in range(2000):
        t = "".join(r.choice(some) for _ in range(r.randrange(1, 12)))
        clusters = re.findall("[^\u0301\u0308\u0323\u200b\u00ad](?:[\u200b\u00ad]*[\u0301\u0308\u0323])*|.", t, re.S)
        plain = [unicodedata.normalize("NFC", "".join(m.get(x, x) for x in c)) for c in clusters]
        assert run(t) == "".join(m.get(p, p) if len(p) == 1 else p for p in plain), ascii(t)


# ---------------------------------------------------------------- 6
def brute_leaks(texts, items):
    out = set()
    for n, t in enumerate(texts):
        a = "".join(map(chr, leakage.plain(t or "")))
        for i, q in items:
            b = "".join(map(chr, leakage.plain(q)))
            least = -(-len(b) // 2)
            if b and any(b[k : k + least] in a for k in range(len(b) - least + 1)):
                out.add((n, i))
    return out


def test_leaks_against_brute_force():
    r = random.Random(6)
    word = lambda: "".join(r.choice("甲乙丙丁戊abcdeXYZ0123，。 -") for _ in range(r.randrange(30, 90)))
    items = [(i, word()) for i in range(25)]
    texts: list = [None, "", "短"]
    for _ in range(300):
        q = r.choice(items)[1]
        n = len(q)
        lo = r.randrange(0, n // 2)
        piece = q[lo : lo + r.randrange(n // 3, n)]
        texts.append(word() + (piece.upper() if r.random() < 0.5 else "，".join(piece)) + word())
    for edits in (0, 1):
        got = set(leakage.Items(items, 0.5, edits).leaks(texts))
        assert got == brute_leaks(texts, items) and len(got) > 50


def edited(r, q, edits):
    q = list(q)
    for _ in range(edits):
        k = r.randrange(len(q))
        q[k : k + r.choice((0, 1))] = r.choice(["", "z", "zz"])
    return "".join(q)


@pytest.mark.parametrize("edits", [1, 2])
def test_repeated_sampling_reaches_the_recall(edits):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(i, word(80)) for i in range(10)]
    index = leakage.Items(items, 0.5, edits, unbroken=False)
    texts = [word(40) + edited(r, items[k % 10][1][5:50], edits) + word(30) for k in range(200)]
    # brute force: some passage of 40 letters within the edits
    true = {(n, n % 10) for n, t in enumerate(texts) if any(leakage.within_edits(items[n % 10][1][i : i + 40], t, edits) for i in range(41))}
    got = set(index.leaks(texts))
    assert len(true) > 150 and got <= true and len(got & true) >= 0.95 * len(true)


def test_one_round_misses_edited_windows_that_all_rounds_find():
    r = random.Random(11)
    h = leakage.WindowHash(16, 2)
    a = np.array([r.randrange(1, 60000) for _ in range(16 * 500)], np.uint32)
    b = a.copy()
    for k in range(500):
        for _ in range(2):
            b[16 * k + r.randrange(16)] = 7
    starts = np.arange(500) * 16
    met = [h(leakage.mixed(a), starts, k) == h(leakage.mixed(b), starts, k) for k in range(h.rounds)]
    assert h.rounds > 3 and met[0].mean() < 0.8 and np.any(met, axis=0).mean() > 0.95
    same = [h(leakage.mixed(a), starts, k) == h(leakage.mixed(a.copy()), starts, k) for k in range(h.rounds)]
    assert all(x.all() for x in same)


def test_edits_apart_against_brute_force():
    r = random.Random(12)
    for limit in (0, 1, 2):
        rows = [[r.randrange(3) for _ in range(7)] for _ in range(300)]
        texts = [([*row] if r.random() < 0.5 else [r.randrange(3) for _ in range(7)]) + [r.randrange(3) for _ in range(limit)] for row in rows]
        for t in texts:
            if r.random() < 0.5:
                t.insert(r.randrange(7), t.pop(r.randrange(7)))
        distance = lambda a, b: distance_table(a, b)[-1][-1]

        def distance_table(a, b):
            d = [list(range(len(b) + 1))]
            for i, x in enumerate(a, 1):
                d.append([i])
                for j, y in enumerate(b, 1):
                    d[i].append(min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y)))
            return d

        want = [min(distance(a, t[:n]) for n in range(len(t) + 1)) <= limit for a, t in zip(rows, texts)]
        assert list(leakage.edits_apart(np.array(rows), np.array(texts), limit)) == want


def test_a_short_item_changes_nothing_for_the_others():
    r = random.Random(13)
    word = lambda n: "".join(r.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(n))
    items = [(i, word(60)) for i in range(5)]
    both = leakage.Items([*items, (99, "xy")], 0.5, 1)
    alone = leakage.Items(items, 0.5, 1)
    assert [(g.window, g.stride) for g in both.groups[1:]] == [(g.window, g.stride) for g in alone.groups]
    assert both.leaks([word(30), "a x b", items[2][1][:30]]) == [(1, 99), (2, 2)]


def test_leaked_edges(spark):
    q = "已知保证金比例为13.73%，不考虑所得税，芷墟重机追加29753万元"
    rows = spark.createDataFrame([("t", 1, "前文" + q[:24] + "后文", 0), ("t", 1, "前文" + q[:24] + "后文", 1), ("t", 2, None, 0), ("t", 3, "", 0), ("t", None, q, 0), ("u", 4, "长" * 50000 + q, 0)], "table_name string, row_key long, text string, item_id int")
    items = spark.createDataFrame([(7, q), (8, None), (9, "？！"), (None, "x")], "item_id long, question string")
    assert sorted(tuple(r) for r in leakage.leaked(rows, items).collect()) == [("t", 1, 7), ("u", 4, 7)]
    assert sorted(tuple(r) for r in leakage.leaked(rows, items, block=1).collect()) == [("t", 1, 7), ("u", 4, 7)]
    near = spark.createDataFrame([("t", 1, "前文" + q[:12] + "错" + q[12:24] + "后文")], "table_name string, row_key long, text string")
    assert leakage.leaked(near, items).count() == 0 and leakage.leaked(near, items, unbroken=False).count() == 1
    assert leakage.leaked(rows, items.limit(0)).count() == 0 and leakage.leaked(rows.limit(0), items).count() == 0


# ---------------------------------------------------------------- 7
def test_round_trips():
    t = "决定产量的主要因素是，光合作用"
    for name, chain in garbled.CHAINS.items():
        g = garbled.garble(t, chain)
        back = garbled.restore(g, chain) if g else None
        if name != "gbk as cp932":  # cp932 has two codes for some characters, so a near form may come back
            assert back in (None, t), name
        if all(c in ("utf-8", "latin-1", "cp1252", "cp1251", "mac-roman") for p in chain for c in p):
            assert back == t, name


def test_garbled_values(spark):
    clean = [f"在海拔{n}米的河谷种植水稻，决定产量的主要因素是" for n in range(20)] + ["学习光合作用时，首先应当归纳要点", "答案：C"]
    whole = clean[0].encode().decode("latin-1")
    part = "在海拔5米的" + "河谷".encode().decode("cp1252", "replace") + "种植水稻"
    lossy = "学习光合作用时，首先".encode("gbk").decode("utf-8", "replace")
    gb = "决定产量的主要因素是".encode().decode("gb18030", "replace")
    right = ["词语“锟铻”“鏖战”的读音", "São Lindo 试验站，Ã 与 õ 为地名", "naïve café ²", "希腊字母 α、β 与 Я", "苎麻"]
    rows = [(i, "question", t, "z") for i, t in enumerate([*clean, *right])] + [(100, "question", whole, ""), (101, "answer", lossy, ""), (102, "answer", gb, ""), (103, "question", None, ""), (104, "question", "", ""), (100, "question", whole, "again"), (None, "answer", whole, "")]
    got = {r.key: (r.field, r.original) for r in garbled.garbled_values(spark.createDataFrame(rows, "key long, field string, text string, chain string")).collect()}
    assert got == {100: ("question", clean[0]), 101: ("answer", None), 102: ("answer", "决定产量的主要因素是")}
    assert part
    assert garbled.garbled_values(spark.createDataFrame([], "key long, field string, text string")).count() == 0


# ---------------------------------------------------------------- 2
@pytest.mark.parametrize(
    "question,answer,defect",
    [
        ("问？", None, "empty"),
        ("问？", "​", "empty"),
        ("问？", "答案：", "empty"),
        ("问？", "（略）", "empty"),
        ("1+1？", "2", None),
        ("记号？", "√", None),
        ("哪项正确？", "答案:B", None),
        ("如何理解细胞分裂？\nA. 甲\nB. 乙", "您的问题是：如何理解细胞分裂？", "copied"),
        ("如何理解细胞分裂？\nA. 甲\nB. 乙", "如何理解细胞分裂？ A. 甲 B. 乙\n如何理解细胞分裂？ A. 甲 B. 乙", "copied"),
        ("如何理解细胞分裂？", "题干问“如何理解细胞分裂？”，它是细胞增殖的方式。", None),
        ("如何理解？", "抱歉，我无法回答这个问题。", "refusal"),
        ("如何理解？", "出租方表示抱歉，但这不影响其承担维修义务。", None),
        ("Why?", "The tenant said sorry, but the premium still has to be paid.", None),
        ("Why is it?", "I'm sorry, but I can't help with that.", "refusal"),
        ("如何理解？", "Die Quote sinkt, sobald der Aufwand steigt, deshalb sollte man beide Werte prüfen.", "other_language"),
        ("请把下面这句话译成英文：你好吗，今天天气怎样。", "How are you today, and how is the weather where you are?", None),
        ("净利率的英文缩写？", "NIM", None),
        ("如何理解？", "有三个方面需要说明。第一，先看条件。第二，再看结果。", "truncated"),
        ("如何理解？", "有二个方面需要说明。第一，先看条件。第二，再看结果。", None),
        ("如何理解？", "课堂活动分26步：导入、归纳要点、展示，难点放在细胞分裂。", None),
        ("如何理解？", "先看条件，再看结果（如概率统计", "truncated"),
        ("如何理解？", "先看条件，", "truncated"),
        (None, "先看条件，再看结果。", None),
    ],
)
def test_pair_rules(question, answer, defect):
    assert bp.pair_rules(question, answer)[0] == defect


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        ("如何理解这个概念？", "यह उत्तर हिन्दी में लिखा गया है और पूरा है।", "other_language"),
        ("如何理解这个概念？", "यह उत्तर हिन्दी में लिखा गया है और पूरा है", "other_language"),
        ("How is this term to be understood?", "התשובה הזאת כתובה בעברית והיא שלמה.", "other_language"),
        ("如何理解这个概念？", "এই উত্তরটি বাংলায় লেখা হয়েছে এবং সম্পূর্ণ।", "other_language"),
        ("How is this term to be understood?", "Այս պատասխանը գրված է հայերեն և ամբողջական է։", "other_language"),
        ("यह उत्तर हिन्दी में लिखा गया है और पूरा है?", "התשובה הזאת כתובה בעברית והיא שלמה.", "other_language"),
        ("यह उत्तर हिन्दी में लिखा गया है और पूरा है?", "आप कैसे हैं, आज मौसम कैसा है, सब ठीक है.", None),
        ("请把下面这句话翻译成印地语：你好吗，今天天气怎样。", "आप कैसे हैं, आज मौसम कैसा है, सब ठीक है.", None),
        ("How is this term to be understood?", "𝐓𝐡𝐢𝐬 𝐢𝐬 𝐭𝐡𝐞 𝐚𝐧𝐬𝐰𝐞𝐫 𝐢𝐧 𝐛𝐨𝐥𝐝 𝐥𝐞𝐭𝐭𝐞𝐫𝐬.", None),
    ],
)
def test_answers_in_other_scripts(question, answer, defect):
    assert bp.pair_rules(question, answer)[0] == defect


def test_broken_pairs_by_neighbours(spark):
    names = "甲乙丙丁戊己庚辛"
    rows = [("t", i, "问题是什么？", f"{names[i % 8]}方提交了材料，应当在{i}日内处理完毕。", 0) for i in range(64)]
    rows += [("t", 100, "问题是什么？", "甲方提交了材料，应当在9日内处理完毕", 0), ("t", 101, "问题是什么？", "甲方提交了材料，应当在9日内处", 0), ("t", 101, "问题是什么？", "甲方提交了材料，应当在9日内处", 1), ("t", 102, "问题是什么？", "甲", 0), ("t", None, "问", None, 0), ("t", 103, None, "乙方提交了材", 0)]
    df = spark.createDataFrame(rows, "table_name string, row_key long, question string, answer string, defect int")
    assert sorted(tuple(r) for r in bp.broken_pairs(df).collect()) == [("t", 101, "truncated")]
    assert bp.broken_pairs(df.limit(0)).count() == 0


def test_an_unknown_end_is_sound_unless_words_tell(spark):
    r = random.Random(31)
    ends = ["可以减少病害", "有利于恢复地力", "应当留意水温", "需要补充氮肥", "会影响产量"]
    rows = [("t", i, "轮作有什么用？", f"{r.choice(['玉米', '小麦', '大豆', '油菜'])}{r.choice(['轮作', '间作', '套种'])}{r.choice(ends)}。农户的收入{r.choice(['上升', '稳定'])}。We keep the field of the village fallow.") for i in range(200)]
    asked = [
        ("t", 1000, "轮作有什么用？", "轮作可以减少病害。同时也能改善墒情"),  # a full sentence that no other answer holds
        ("t", 1001, "轮作有什么用？", "轮作可以减少病害。同时也能改善墒情的"),
        ("t", 1002, "What for?", "It rests the soil. Neighbours then reuse plots of the"),
        ("t", 1003, "What for?", "It rests the soil. Neighbours then like that vil"),
        ("t", 1004, "What for?", "It rests the soil. Neighbours then like that canal"),
    ]
    # 的 and the are used often and end nothing
    df = spark.createDataFrame(rows + asked, "table_name string, row_key long, question string, answer string")
    assert sorted(x.row_key for x in bp.broken_pairs(df).collect()) == [1001, 1002, 1003]


def test_shortened_versions_over_many_ranges(spark):
    r = random.Random(41)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))
    known, last = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    k = spark.createDataFrame([(w, 1, 0) for w in known], "text string, stops long, goes_on long").repartition(7)
    got = bp.shortened_versions(k, spark.createDataFrame([(w,) for w in last], "text string")).collect()
    # the next known text in order decides; a known text itself is followed by the one after it
    want = {w: (int(w in known), next((x for x in known if x > w), "").startswith(w)) for w in last}
    assert {x.text: (x.stops, x.shortened) for x in got if x.text not in known} == {w: v for w, v in want.items() if w not in known}
    assert len(got) == len(last) and bp.shortened_versions(k, k.limit(0).select("text")).count() == 0


def test_length_limits_do_not_depend_on_the_size_of_a_table(spark):
    r = random.Random(5)
    word = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
    cut = [word(40) for _ in range(8)]
    answers = [*cut, *[word(n) for n in (31, 35, 44, 49)], *[word(70)] * 8]
    for copies in (1, 10):
        rows = [("t", k * 100 + i, "问题是什么？", a) for k in range(copies) for i, a in enumerate(answers)]
        got = bp.broken_pairs(spark.createDataFrame(rows, "table_name string, row_key long, question string, answer string")).collect()
        assert sorted((x.row_key, x.defect) for x in got) == [(k * 100 + i, "truncated") for k in range(copies) for i in range(len(cut))]


# ---------------------------------------------------------------- 3
def test_tagger_on_composed_texts():
    r = random.Random(99)
    carriers = ["如何理解细胞分裂？", "The margin rises when the ratio falls.", "案卷804656中出租方仅提交转账凭证，后果如何？"]
    made = [pii_training.composed(carriers, r) for _ in range(800)]
    found = pii.tagger().spans([t for t, _ in made])
    good = sum(len(set(s) & set(f)) for (_, s), f in zip(made, found))
    assert good >= 0.9 * sum(len(s) for _, s in made) and good >= 0.9 * sum(map(len, found))


#: Sentences with names, places and frames of none of which the training holds; what stands in brackets is to be found.
HELD_OUT = [
    "昨天{赵敏}把钥匙落在前台了。", "值班的{王芳}说，下午四点再来。", "班长{陈晓明}已经收齐作业。", "我姐{刘佳宁}在杭州上班。", "快递小哥{孙强}一早就来过。", "被保险人{黄志远}申请理赔。",
    "面试官{马丽}让他下周复试。", "外婆{林秀英}今年八十岁。", "队长{司马青}率先冲线。", "联系{阿依古丽·买买提}取号。", "The nurse, {Emma Watson}, took notes.", "Our coach {Daniel Craig} resigned.", "Invoice prepared by {Lucy Heartfield}.", "{Hassan Ali} wrote the foreword.",
    "有问题发{li.wei88@163.com}给我。", "My personal mail is {tom.h@gmail.com}, write any time.", "投稿请至{editor@news-daily.org}。", "想退货找{13912345678}这个号。", "夜间急诊拨{010-65123456}。", "You can reach the desk under {(212) 736-5000}.", "传真：{0571-87654321}。",
    "开户时填的是{11010519491231002X}。", "换证后号码{440524198001010014}。", "Her passport, {E12345678}, expires in May.", "房子在{朝阳路56号}旁边。", "他搬去{中关村大街27号1101室}了。", "The shop is at {221 Baker Street}.", "新店开在{解放西路188号}。",
]
NOTHING = ["何时可以停药？", "张力性头痛与周边环境有关。", "谢谢你的回答，很有帮助。", "他在清华大学读过两年书。", "The Royal Bank of Scotland raised rates.", "订单号20240518123456已发货。", "血压120/80，心率72。", "Chapter 12 covers Fourier series.", "白术、黄连各三钱。", "依《道路交通安全法》第76条处理。", "版本 3.12.4 修复了若干问题。", "关于高血压的用药，程序如下。"]


def test_tagger_on_names_and_frames_it_was_not_trained_on():
    frames = "|".join([*pii_training.ROLES, *sum(pii_training.LEADS.values(), [])])
    assert not [t for t in HELD_OUT[:9] if re.search(f"(?:{frames})" + r"\{", t)]
    texts = [t.replace("{", "").replace("}", "") for t in HELD_OUT]
    found = pii.tagger().spans(texts)
    right = [t[t.index("{") + 1 : t.index("}")] in {x[a:b] for a, b, _ in f} for t, x, f in zip(HELD_OUT, texts, found)]
    assert sum(right) >= 0.75 * len(right), [t for t, r in zip(HELD_OUT, right) if not r]
    assert sum(map(bool, pii.tagger().spans(NOTHING))) <= 1


def test_network_learns_and_gradients_hold():
    r = random.Random(1)
    made = [pii_training.composed(["普通的一句话"], r) for _ in range(300)]
    losses = []
    pii_training.train(made, passes=2, say=lambda s: losses.append(float(re.search(r": ([\d.]+)", s)[1])))
    assert losses[1] < losses[0]


def test_redaction_edges(spark):
    long = "没有个人信息的一句话。" * 3000 + "我叫张伟，电话13812345678。"
    rows = [(1, "我叫郑枕书，邮箱：q123456@mail.example。订单流水 2025020776890279352 已核对。", "x"), (2, None, ""), (3, "", ""), (4, long, "")]
    df = spark.createDataFrame(rows, "id int, text string, types string")
    got = {r.id: r for r in pii.personal_information(df).collect()}
    assert got[1].redacted == "我叫[PERSON_NAME]，邮箱：[EMAIL]。订单流水 2025020776890279352 已核对。" and got[1].types == ["email", "person_name"]
    assert got[2].redacted is None and got[2].types == [] and got[3].redacted == "" and got[4].types == ["person_name", "phone"]
    assert got[4].redacted == long.replace("张伟", "[PERSON_NAME]").replace("13812345678", "[PHONE]")
    assert pii.personal_information(df.limit(0)).count() == 0


def test_windows_are_reconciled():
    text = "，".join(["说明文字abc"]) + "x" * 200 + " 联系 q345678@mail.example 谢谢 " + "y" * 200
    assert [k for *_, k in pii.tagger().spans([text])[0]] == ["email"]


# ---------------------------------------------------------------- queries
def test_queries_run_on_a_fixture(spark, tmp_path):
    from weirgate.llm import catalog

    one = spark.createDataFrame([(1, "如何理解？", None, "答案:A", "a.csv#1", "zh", "医疗")], "row_id long, instruction string, input string, output string, source string, lang string, domain string")
    one.write.parquet(f"{tmp_path}/mmlu_csv_alpaca.parquet")
    spark.createDataFrame([(1, "问", "答")], "qa_id long, question string, answer string").write.parquet(f"{tmp_path}/fineval_qa_finance.parquet")
    spark.createDataFrame([(1, "题目")], "item_id long, question string").write.parquet(f"{tmp_path}/fineval_mcq_finance.parquet")
    spark.createDataFrame([(1, "题", "A")], "row_no long, question string, answer string").write.parquet(f"{tmp_path}/cmmlu_education.parquet")
    spark.createDataFrame([(1, [("user", "你好")])], "record_id long, messages array<struct<role:string,content:string>>").write.parquet(f"{tmp_path}/work_item.parquet")
    spark.createDataFrame([(1, "文", "zh", "a.csv", "医疗")], "doc_id long, text string, lang string, source string, domain string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = {"p2_found": ["table_name", "row_key", "defect"], "p3_found": ["table_name", "row_key", "turn", "pii_type"], "p4_found": ["table_name", "key_a", "key_b"], "p6_found": ["table_name", "row_key", "item_id"], "p7_found": ["row_no", "field"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"]}
    for name, f in catalog.QUERIES.items():
        df = f(spark, str(tmp_path))
        assert df.columns == columns.get(name, df.columns), name
        df.collect()
