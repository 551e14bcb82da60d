"""Training of the tagger of ``pii``: labelled spans, and the network with its gradients in numpy.

Labelled texts are composed by rule: values (names, hosts, roads, numbers) are drawn at random from characters, syllables
and common names, and stand in frames put together from cues, roles, deeds and ends around sentences of a bounded
sample of documents (``SAMPLE``). No value or frame is taken from the tables that the tagger is judged on.
Run ``python -m weirgate.llm.pii_training FOLDER`` to train with documents.parquet in FOLDER and write the model.
"""

from __future__ import annotations

import multiprocessing
import random
import re
import sys

import numpy as np

from weirgate.llm.pii import _END, COMPOUND, FAMILY, LABELS, STRIDE, TYPES, WEIGHTS, WINDOW, Tagger, inference_tables, seen

#: Documents of the sample, composed texts, sizes of the network, passes, windows of a shard, learning rate, shards of a step (a process each).
SAMPLE, COMPOSED, EMBED, HIDDEN, PASSES, STEP, RATE, WORKERS = 4000, 36000, 24, 40, 8, 40, 8e-3, 8
#: Shares of Han characters, in names and elsewhere, that are read as unknown, so that context decides. The second keeps
#: an unknown character from being the sign of a name.
UNKNOWN, UNKNOWN_ELSEWHERE = 0.35, 0.12

#: Characters of given names, common English names, syllables of invented ones.
GIVEN = "伟芳娜敏静丽磊军洋勇艳杰娟涛明超秀英华玉兰霞刚桂辉玲鹏飞红丹萍建志斌宇浩轩梓涵子怡欣悦博雅俊思雨婷佳琪晨曦若汐诺依晓天瑞嘉凯帆琳莉倩颖峰亮宏德仁义福海波毅坚新荣光庆春洁雪梦彤睿泽皓翔凡"
MINORITY = "阿依古丽买提江艾力木沙吐尔逊娜孜扎西卓玛次仁旦增巴特格日其那仁图雅热合曼帕提玛迪力亚克"
EN_FIRST = "James Robert Michael David William Richard Thomas Charles Daniel Matthew Anthony Mark Steven Andrew Joshua Kevin Brian Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Betty Sandra Ashley Kimberly Emily Donna Priya Arjun Wei Yuki Fatima Omar Chloe Sofia Mateo Olga Dmitri Aisha Kwame Ingrid Lars Hana Pierre".split()
EN_LAST = "Johnson Williams Jones Garcia Miller Davis Rodriguez Martinez Wilson Anderson Taylor Moore Jackson Martin Lee Perez Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Raman Kowalski Okafor Petrov Tanaka Haddad Schmidt Rossi Dubois O'Brien".split()
ONSETS, VOWELS, CODAS = "b br c ch d dr f fl g gr h j k l m n p pr qu r s sh st t th tr v w z".split(), "a e i o u ai ea ee ia ie oa ou".split(), "b ck d f g l ll m n nd nt r rd rk rn s sk st t th x".split()
#: Cues, roles, deeds and ends that frames are put together from.
CUES = {
    "person_name": "姓名 名字 署名 负责人 当班 值班人 填表人 收款人 开户人 称呼".split(),
    "email": "邮件 电子邮箱 信箱 e-mail 邮址 抄送 发件箱 备用邮箱 邮箱地址".split(),
    "phone": "电话 手机 手机号码 座机 热线 联系电话 传真 家庭电话 紧急电话 号码".split(),
    "id_number": "身份证 证件号 护照 护照号码 身份证件 证件 居民身份证 公民身份号码 本人证件 旧身份证".split(),
    "street_address": "地址 住址 住所 收货地址 通讯地址 户籍 送货地址 门牌 居所 户口所在地".split(),
}
LEADS = {
    "person_name": "我是 本人 这里是 叫 是 找 是 叫 我乃 请找 请转告 麻烦叫一下 由 经 替 代 受 与 和 跟 通知 询问 拜访".split(),
    "email": "写信到 写到 发邮件给 邮件发给 报告传到 简历投 材料发往 通知我用 回复到 转发给".split(),
    "phone": "请拨 拨打 致电 打给 呼叫 短信发至 回电 联系我 加我 我的号是 打我手机 有事拨".split(),
    "id_number": "实名登记 持证 我的证是 办理用的是 证件登记为 核对的是 凭 身份核验".split(),
    "street_address": "住 住于 家住 家在 搬到 寄往 送到 送往 位于 租住 上门到 老家在 邮寄至 老宅在".split(),
}
ROLES = "被告 病人 学员 考生 客户 债务人 债权人 证人 业主 租客 投诉人 申请人 被申请人 上诉人 同事 邻居 家长 学生 当事人 委托人 受害人 房东 房客 老师 护士 医师 经办人 签收人 收货人 寄件人 监护人 担保人 股东 会员 用户 乘客 住户 村民 职工 亲属 丈夫 妻子 儿子 女儿 母亲 父亲 队友 室友 店主 司机 代理人 报名人 领取人 付款人 持卡人 户主 发件人 预约人 陪护 顾客 买家 卖家 提问者 作者 患者 原告 家属 同学 收件人 联系人".split()
TITLES = "先生 女士 小姐 老师 医生 大夫 律师 教授 主任 经理 师傅 阿姨 同志 法官".split()
DEEDS = "辩称 说 表示 提出 来电 咨询 称 认为 要求 同意 拒绝 提交材料 到场 签收 来访 转达 补充说 已付款 已到账 未到 请假 留言 主张 陈述 告知 回复 确认 投诉 报名 预约 登记 委托 代办 写道 问 催过 提醒 汇报 证实 领取 办理 的记录 的档案 的病历 的成绩 的父亲 转账 复诊 就诊 申请 起诉 到庭 在场 介绍 推荐 刚到 已离开 签过字 让我问 托我带话 说过 想知道 自述 反映 描述 起床后头痛 住院 出院 于昨日到院 在场作证 与对方协商 向法院起诉 将款项退回 把材料交来 被通知 因病请假".split()
ENDS = ["", "", "，", "。", "；", "，谢谢", "即可", "就行", "都可以", "为准", "，", "。", "（常用）", " ", "，请查收", "收", "门口", "附近", "，勿外传", "上", "里"]
LINKS = ["：", ":", " ", "", "是", "为", "：", "改为", "：", "（"]
NOT_PERSONS = "谢谢 多谢 您好 大家好 安静 高兴 温柔 明白 常见 何时 何种 何处 方法 方程 方向 程序 程度 高度 高血压 关节炎 江河 林地 马上 安全 常规 于是 金额 花生 黄豆 黄连 白术 白芷 何首乌 当归 苗期 水稻 华东 温度 季节 童话 游戏 许可 许多 周边 周期 张力 王牌 万元 孙子 公司 银行 出租方 承运人 保证人 用人单位 肩周炎 成本 成果 管理 连续 单位 单价 解析 应当 应收 石油 田地 毛利率 牛顿 时间 时候 路程 陆地 严重 计划 施工 汤剂 金融 齐全 康复 余额 元素 顾问 平均 和解 明显 谈判 项目 祝福 席位 强度 盛夏 钟表 支付 经济 房屋 宗旨 宣传 包括 左侧 全部 班级 景气 龙头 司法 印章 白天 台阶 从而 通常 边界 尚未 农业 别人 充分 连带 习惯 容量 向量 古诗 易错 终止 居民 步骤 都是 满足 国家 文言 广泛 东部 利率 师生 关于 肖像".split()
EN_LEADS = {
    "person_name": ["This is {}", "Regards, {}", "Signed {}", "ask {}", "Contact person: {}", "on behalf of {}", "Attn. {}", "written by {}", "Dear {},", "Witness {} was present", "{} here", "{} speaking", "my brother {} agrees", "the tenant, {}, says", "Yours, {}", "Recipient {}", "between {} and the bank", "reported by {}", "Name: {}", "I, {}, confirm", "patient {} was seen", "Mr. {}", "Dr. {}", "Ms {} called", "his name was {}", "his friend {} left", "contact {}", "{} asked", "met {} yesterday"],
    "email": ["Mail {} for details", "E-mail: {}", "my inbox is {}", "Send it via {}", "({})", "cc {}", "address the letter to {}", "forward to {}", "email {} today", "use {} instead", "my mail: {}"],
    "phone": ["Ring {} after six", "Mobile {}", "Fax {}", "Tel. {}", "my cell is {}", "text {}", "dial {}", "number: {}", "phone me on {}", "landline {}", "WhatsApp {}"],
    "id_number": ["Identity no. {}", "Document {}", "my card says {}", "Passport {}", "passport no. {}", "identity card: {}", "ID card {}", "registered under {}", "holder of {}", "SSN {}"],
    "street_address": ["Deliver to {}", "home: {}", "Ship the parcel to {}", "We moved to {}", "Visit us at {}", "living at {}", "resident of {}", "mail goes to {}", "post it to {}", "my flat is {}", "located at {}"],
}
#: Roles and deeds of English frames, and cues with what stands between them and a value.
EN_ROLES = "teacher clerk buyer seller landlord driver manager student lawyer neighbour doctor customer member borrower guest author cousin uncle daughter plaintiff claimant agent trainer".split()
EN_DEEDS = ["said so", "called", "agrees", "has signed", "left early", "paid", "asked again", "was seen", "is waiting", "wants a copy", "states that", "will reply", "thinks so", "moved out", "signed it"]
EN_CUES = {"email": "e-mail inbox mail".split(), "phone": "tel mobile cell fax line hotline number phone".split(), "id_number": "passport card identity document ID permit".split(), "street_address": "home residence flat office place house shop".split()}
EN_PREPOSITIONS = {"person_name": "by to from for with of".split(), "email": "at to via".split(), "phone": "on at under to".split(), "id_number": "as under with".split(), "street_address": "at to in from near".split()}
EN_ROADS = "Street St Road Rd. Rd Lane Ln Avenue Ave Close Terrace Drive Court Way Square Boulevard Crescent Place".split()
COMPANY, EN_COMPANY = "能源 科技 食品 银行 集团 医药 公司 物流 证券 保险 重工 传媒 电子 医院 学校 实业 大学 中学 学院 出版社".split(), "Holdings Bank Energy Clinic University Group Ltd Foods Motors Partners Insurance Institute".split()
ROADS, TOWNS = "路 街 巷 弄 大道 胡同 大街 里 村 南路 北路 东街 西路 新村 横街".split(), "市 区 县 镇 省 新区 乡".split()
ORDERS = "订单号 货号 条形码 运单 流水号 工单 案卷号 发票号 门诊号 批号 编号 合同编号 票号 预订号 档案号 样品号 留言第 记录第".split()
EN_ORDERS = "Order Invoice Ticket Parcel Booking Reference Batch Record Serial File".split()


def _level_one() -> str:
    """The frequent characters of the standard set, by rule."""
    return "".join(bytes([hi, lo]).decode("gb2312", "ignore") for hi in range(0xB0, 0xD8) for lo in range(0xA1, 0xFF))


HAN = _level_one()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _wide(r: random.Random, s: str, share: float = 0.12) -> str:
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in s) if r.random() < share else s


def _han(r: random.Random, low: int, high: int) -> str:
    return "".join(r.choice(HAN) for _ in range(r.randint(low, high)))


def _invented_word(r: random.Random) -> str:
    return "".join(r.choice(ONSETS) + r.choice(VOWELS) + (r.choice(CODAS) if r.random() < 0.5 else "") for _ in range(r.choice((1, 2, 2, 3)))).capitalize()


def _counted(n: int) -> str:
    """A number under 1000 in Chinese."""
    d = "零一二三四五六七八九"
    h, t, u = n // 100, n // 10 % 10, n % 10
    out = d[h] + "百" if h else ""
    if t:
        out += ("" if t == 1 and not h else d[t]) + "十"
    elif h and u:
        out += "零"
    return out + (d[u] if u else "") or "一"


def _english_name(r: random.Random) -> str:
    first = r.choice(EN_FIRST) if r.random() < 0.5 else _invented_word(r)
    last = r.choice(EN_LAST) if r.random() < 0.5 else _invented_word(r)
    return r.choice([f"{first} {last}"] * 6 + [f"{first} {r.choice('ABCDEFGHJKLMNPRST')}. {last}", f"{first[0]}. {last}"])


def _name(r: random.Random, english: bool) -> str:
    if english:
        return _english_name(r)
    if r.random() < 0.08:
        part = lambda: "".join(r.choice(MINORITY) for _ in range(r.randint(2, 4)))
        return f"{part()}·{part()}"
    given = "".join(r.choice(HAN if r.random() < 0.4 else GIVEN) if r.random() < 0.75 else chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(r.choice((1, 1, 2, 2, 2))))
    return (r.choice(COMPOUND) if r.random() < 0.15 else r.choice(FAMILY)) + given


def _email(r: random.Random) -> str:
    word = lambda: r.choice([_invented_word(r), r.choice(EN_FIRST), r.choice(EN_LAST).replace("'", "")]).lower()
    local = r.choice([lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + _digits(r, r.randint(2, 9)), lambda: f"{word()}.{word()}", lambda: f"{word()}_{_digits(r, 2)}", lambda: f"{word()}{_digits(r, r.randint(0, 4))}", lambda: f"{word()}-{word()}", lambda: _digits(r, r.randint(6, 10))])() + r.choice(["", "", "", "+" + word()])
    tld = r.choice("com com com cn net org edu io test example invalid info".split() + ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 7)))])
    host = ".".join([word() + r.choice(["", "", _digits(r, 2), "-" + word()]) for _ in range(r.choice((1, 1, 2)))] + [tld])
    s = r.choice([f"{local}@{host}"] * 4 + [f"{local} @ {host}", f"{local} [at] {host}", f"{local}（at）{host.replace('.', ' dot ')}", f"{local}(at){host}", f"{local}@{host}".upper(), f"{local}@{host}".upper(), f"{local}{' at '}{host.replace('.', ' dot ')}"])
    return _wide(r, s)


def _phone(r: random.Random, english: bool) -> str:
    if english and r.random() < 0.7:
        a, b, c = r.randrange(200, 990), r.choice((555, r.randrange(200, 990))), _digits(r, 4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"{a} {b} {c}", f"+44 20 {_digits(r, 4)} {c}", f"+1-{a}-{b}-{c}"])
    m = "1" + r.choice("3456789") + _digits(r, 9)
    land = "0" + _digits(r, r.choice((2, 3)))
    s = r.choice([m, m, m, f"{m[:3]} {m[3:7]} {m[7:]}", f"{m[:3]}-{m[3:7]}-{m[7:]}", f"{m[:3]}.{m[3:7]}.{m[7:]}", f"+86 {m}", f"+86-{m}", f"{land}-{_digits(r, r.choice((7, 8)))}", f"({land}) {_digits(r, 8)}转{_digits(r, 2)}", f"({land}){_digits(r, 7)}", "".join("零一二三四五六七八九"[int(c)] for c in m)])
    return _wide(r, s)


def _id_number(r: random.Random, english: bool) -> str:
    y, mo, d = r.randrange(1935, 2015), r.randrange(1, 13), r.randrange(1, 29)
    area, tail = r.choice("1234569") + _digits(r, 5), _digits(r, 3) + r.choice("0123456789Xx")
    return _wide(r, r.choice([f"{area}{y}{mo:02}{d:02}{tail}"] * 3 + [f"{area} {y}{mo:02}{d:02} {tail}", f"{area}-{y}{mo:02}{d:02}-{tail}", f"{area}{y % 100:02}{mo:02}{d:02}{tail[:3]}", r.choice("EGPSD") + _digits(r, 8), "E" + r.choice("ABCDEFG") + _digits(r, 7)] + [f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"] * english))


def _address(r: random.Random, english: bool) -> str:
    if english:
        road = _invented_word(r) if r.random() < 0.5 else r.choice([*EN_LAST, *"Oak Elm Park Church Station Mill North High Lake".split()])
        flat = r.choice([f"Flat {r.randrange(1, 60)}, ", f"Apt {r.randrange(1, 60)}, ", f"Unit {r.randrange(1, 60)}, "]) if r.random() < 0.4 else ""
        return f"{flat}{r.randrange(1, 2000)} {road} {r.choice(EN_ROADS)}" + (f", {_invented_word(r)}" if r.random() < 0.3 else "")
    town = "".join(_han(r, 1, 3) + r.choice(TOWNS) for _ in range(r.choice((0, 0, 1, 1, 2))))
    n, road = r.randrange(1, 900), _han(r, 1, 3) + r.choice(ROADS)
    return town + r.choice([f"{road}{n}号", f"{road}{_counted(n)}号", f"{road}{n}号{r.randrange(1, 31)}栋{r.randrange(100, 2500)}室", f"{road}{n % 99 + 1}弄{n % 19 + 1}号{r.randrange(100, 999)}", f"{road}{n % 12 + 1}组{n % 89 + 1}号", f"{road}{n}号{r.randrange(1, 9)}单元{r.randrange(100, 999)}", f"{road}{n}号{r.randrange(1, 30)}楼"])


def invented(kind: str, r: random.Random, english: bool) -> str:
    """An invented value of a type."""
    return {"person_name": lambda: _name(r, english), "email": lambda: _email(r), "phone": lambda: _phone(r, english), "id_number": lambda: _id_number(r, english), "street_address": lambda: _address(r, english)}[kind]()


def trap(r: random.Random, english: bool) -> str:
    """Something that looks like personal information and is none."""
    n = lambda: _digits(r, r.randint(5, 20))
    if english:
        return r.choice([lambda: f"{r.choice(EN_ORDERS)} {r.choice(['no. ', '', '#', 'ref '])}{n()}{r.choice(['', '-' + _digits(r, 4)])}.", lambda: f"{_invented_word(r)} {r.choice(EN_COMPANY)} reports growth.", lambda: f"Version {r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)} is out.", lambda: f"See cell {r.choice('ABCDEFG')}{r.randint(1, 99)}@{_invented_word(r)}.", lambda: f"They met in {_invented_word(r)} on Tuesday.", lambda: f"The {_invented_word(r)} Act applies.", lambda: f"Read {r.choice(['Chapter', 'Page', 'Table', 'Step'])} {r.randint(1, 99)}.", lambda: "The " + r.choice("tenant plaintiff patient buyer lender recipient".split()) + r.choice([" called.", ", as agreed, left.", " here."]), lambda: f"{r.choice(['Street', 'Road'])} view mode is on."])()
    return r.choice([lambda: f"{r.choice(ORDERS)}{r.choice(['：', ' ', '', '为'])}{n()}{r.choice(['', '-' + _digits(r, 3), '号', ' 已发'])}", lambda: f"{_han(r, 2, 3)}{r.choice(COMPANY)}{r.choice(DEEDS)}", lambda: f"依《{_han(r, 2, 3)}{r.choice(TOWNS)}{_han(r, 2, 4)}{r.choice(['条例', '办法', '规定', '细则'])}》第{r.randint(1, 99)}条", lambda: f"版本{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda: f"见第{r.randint(1, 30)}{r.choice(['号楼', '号附件', '号表', '页', '章'])}{_han(r, 0, 2)}", lambda: f"{r.choice('ABCDEFG')}{r.randint(1, 99)}@{_han(r, 2, 3)}", lambda: f"@{_han(r, 2, 4)} 看一下", lambda: f"药用{r.choice(NOT_PERSONS)}、{r.choice(NOT_PERSONS)}与{r.choice(NOT_PERSONS)}", lambda: f"{_han(r, 2, 2)}定律", lambda: f"前往{_han(r, 2, 3)}{r.choice(TOWNS)}", lambda: f"{r.choice(ROLES)}{r.choice(['', r.choice(NOT_PERSONS)])}{r.choice(DEEDS)}", lambda: f"{r.choice(ORDERS)}{n()}中{r.choice(ROLES)}{r.choice(DEEDS)}", lambda: r.choice(NOT_PERSONS) + r.choice(ENDS), lambda: r.choice(["\n", " "]).join(f"{c}. {r.choice([*NOT_PERSONS, _han(r, 2, 4), f'{r.randint(1, 99)}%'])}" for c in "ABCD")])()


def _like_a_name(carrier: str, r: random.Random) -> str:
    """A piece of ordinary text that begins like a family name, if the carrier has one."""
    some = [k for k, c in enumerate(carrier) if c in FAMILY]
    return carrier[(k := r.choice(some)) : k + r.choice((2, 3))] if some else ""


def _piece(carrier: str, r: random.Random) -> str:
    """A short piece of ordinary text."""
    at = r.randrange(max(1, len(carrier) - 3))
    return carrier[at : at + r.randint(1, 4)].replace("{", "").replace("}", "")


def frame(kind: str, r: random.Random, english: bool, carrier: str) -> str:
    """What stands before and after a value, with {} in its place."""
    if english:
        end = r.choice([".", ".", ",", ", thanks.", ";", " please.", "", ". ", "?"])
        if kind == "person_name" and r.random() < 0.5:
            return r.choice([f"{r.choice(['The', 'Our', 'My', 'His', 'the', 'our'])} {r.choice(EN_ROLES)}{r.choice([' {} ', ', {}, ', ' {}, '])}{r.choice(EN_DEEDS)}", f"{{}}{r.choice([' ', ', '])}{r.choice(EN_DEEDS)}", f"{r.choice(EN_DEEDS)} {r.choice(EN_PREPOSITIONS[kind])} {{}}"]) + end
        if kind != "person_name" and r.random() < 0.6:
            return r.choice(["", "", "My ", "Her ", "The ", "Reach us "]) + r.choice([r.choice(EN_CUES[kind]) + r.choice([": ", " is ", " ", " no. ", " no.: ", " number ", " reads "]), r.choice([*EN_DEEDS, "I am", "they wrote", "it went", "please go"]) + f" {r.choice(EN_PREPOSITIONS[kind])} "]) + "{}" + end
        return r.choice(EN_LEADS[kind]) + end
    if kind == "person_name" and r.random() < 0.75:
        role = r.choice([r.choice(ROLES)] * 4 + [r.choice(LEADS[kind])] * 2 + ["", _piece(carrier, r), _piece(carrier, r) + r.choice(ROLES)])
        mark = r.choice(["", "", "", "", "：", " ", "（", "、"])
        deed = r.choice([r.choice(DEEDS)] * 4 + [_piece(carrier, r), r.choice("来让已曾也于在和与向把被因将都还请对从") + _piece(carrier, r), r.choice(TITLES), r.choice(TITLES) + r.choice(DEEDS), r.choice(["同学", "女士", "先生"]) + r.choice(DEEDS) + "："])
        return role + mark + "{}" + ("）" if mark == "（" else "") + r.choice([deed, deed, deed + "，", "，", "；", "。", "：", ""])
    lead = r.choice([r.choice(CUES[kind]) + r.choice(LINKS)] * 3 + [r.choice(LEADS[kind])] * 3 + [_han(r, 1, 3) + r.choice(CUES[kind]), "（", "", _piece(carrier, r)])
    return r.choice(["", "", "我的", "其", "备用", "可以", "请", "有事", "如需"]) + lead + "{}" + ("）" if lead.endswith("（") else "") + r.choice(ENDS)


Example = tuple[str, list[tuple[int, int, str]]]


def composed(carriers: list[str], r: random.Random) -> Example:
    """A text of one to three values in frames and traps around a carrier sentence, with its spans."""
    text, spans = "", []
    english = r.random() < 0.4
    carrier = r.choice(carriers)
    order = ["carrier", *(["value"] * r.choice((1, 1, 2))), *(["trap"] * r.choice((0, 0, 1, 1, 2)))]
    r.shuffle(order)
    for what in order:
        if what == "carrier":
            text += carrier
        elif what == "trap":
            text += trap(r, english)
        else:
            kind = r.choice([*TYPES, "person_name", "person_name"])
            head, tail = frame(kind, r, english, carrier).split("{}")
            if kind == "person_name" and not english and r.random() < 0.15:  # the same frame without a person
                text += head + r.choice(["", r.choice(NOT_PERSONS), _like_a_name(carrier, r)]) + tail
                continue
            value = invented(kind, r, english)
            spans.append((len(text) + len(head), len(text) + len(head) + len(value), kind))
            text += head + value + tail
        text += r.choice(["，", "。", "；", "\n", " ", "", ""] if not english else [" ", " ", "\n"])
    return text, spans


def windows_of(example: Example) -> list[tuple[str, list[int]]]:
    """The windows of a text as the tagger cuts it, with their labels."""
    text, spans = example
    s, labels = seen(text), [0] * len(text)
    for lo, hi, kind in spans:
        b = 1 + 2 * TYPES.index(kind)
        labels[lo:hi] = [b] + [b + 1] * (hi - lo - 1)
    out = []
    for m in _END.finditer(text):
        if m[0].strip():
            for lo in range(m.start(), max(m.start() + 1, m.end() - (WINDOW - STRIDE)), STRIDE):
                hi = min(lo + WINDOW, m.end())
                out.append((s[lo:hi], labels[lo:hi]))
    return out


class Network:
    """Embedding, two LSTMs, a linear layer and CRF transitions, with Adam."""

    def __init__(self, letters: str, seed: int = 3):
        r = np.random.default_rng(seed)
        n, k = len(letters) + 2, len(LABELS)
        f = lambda *s, by: (r.standard_normal(s) / np.sqrt(by)).astype(np.float32)
        self.letters = letters
        self.p = {"emb": f(n, EMBED, by=EMBED), "wx": f(2, EMBED, 4 * HIDDEN, by=EMBED), "wh": f(2, HIDDEN, 4 * HIDDEN, by=HIDDEN), "b": np.zeros((2, 4 * HIDDEN), np.float32), "wo": f(2 * HIDDEN, k, by=2 * HIDDEN), "bo": np.zeros(k, np.float32), "moves": np.zeros((k + 1, k), np.float32)}
        self.p["b"][:, HIDDEN : 2 * HIDDEN] = 1.0
        for i in range(k + 1):  # an inside label follows its own type only
            for j in range(2, k, 2):
                if i not in (j, j - 1):
                    self.p["moves"][i, j] = -8.0
        self.m = {a: np.zeros_like(v) for a, v in self.p.items()}
        self.v = {a: np.zeros_like(v) for a, v in self.p.items()}
        self.t = 0

    def gradient(self, codes: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch and its gradients."""
        p, (n, T) = self.p, codes.shape
        place = np.arange(T)
        mask = place < lengths[:, None]
        flip = np.where(mask, lengths[:, None] - 1 - place, place)
        both = np.stack([codes, np.take_along_axis(codes, flip, 1)])
        x = p["emb"][both]  # 2, n, T, E
        pre = np.einsum("dnte,dek->dtnk", x, p["wx"], optimize=True) + p["b"][:, None, None]
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        hs, cs, gs = [h], [c], []
        H = HIDDEN
        for t in range(T):
            a = pre[:, t] + h @ p["wh"]
            g = np.concatenate([1 / (1 + np.exp(-a[..., : 3 * H])), np.tanh(a[..., 3 * H :])], -1)
            c = g[..., H : 2 * H] * c + g[..., :H] * g[..., 3 * H :]
            h = g[..., 2 * H : 3 * H] * np.tanh(c)
            hs.append(h), cs.append(c), gs.append(g)
        out = np.stack(hs[1:], 1)  # 2, T, n, H
        feats = np.concatenate([out[0], np.take_along_axis(out[1], flip.T[:, :, None], 0)], -1)
        scores = feats @ p["wo"] + p["bo"]
        loss, dscores, dmoves = self._crf(scores, labels, lengths, mask)
        grad = {"wo": np.einsum("tnf,tnk->fk", feats, dscores), "bo": dscores.sum((0, 1)), "moves": dmoves}
        dfeats = dscores @ p["wo"].T
        dback = np.zeros_like(out[1])
        np.put_along_axis(dback, flip.T[:, :, None].repeat(H, 2), dfeats[..., H:], 0)
        dout = np.stack([dfeats[..., :H], dback])
        dh, dc = np.zeros_like(h), np.zeros_like(c)
        da = np.empty_like(pre)
        dwh = np.zeros_like(p["wh"])
        for t in range(T - 1, -1, -1):
            g, tc = gs[t], np.tanh(cs[t + 1])
            dh = dh + dout[:, t]
            dc = dc + dh * g[..., 2 * H : 3 * H] * (1 - tc * tc)
            i, f, o, u = (g[..., k * H : (k + 1) * H] for k in range(4))
            d = np.concatenate([dc * u * i * (1 - i), dc * cs[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], -1)
            da[:, t] = d
            dwh += np.einsum("dnh,dnk->dhk", hs[t], d, optimize=True)
            dh, dc = d @ p["wh"].transpose(0, 2, 1), dc * f
        grad["wh"], grad["b"] = dwh, da.sum((1, 2))
        grad["wx"] = np.einsum("dnte,dtnk->dek", x, da, optimize=True)
        demb = np.zeros_like(p["emb"])
        np.add.at(demb, both.reshape(-1), np.einsum("dtnk,dek->dnte", da, p["wx"], optimize=True).reshape(-1, EMBED))
        demb[0] = 0
        grad["emb"] = demb
        return loss, grad

    def apply(self, grad: dict[str, np.ndarray], rate: float) -> None:
        """A step of Adam."""
        self.t += 1
        norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = (self.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)

    def _crf(self, scores, labels, lengths, mask):
        """Mean negative log-likelihood of the labels and its gradients, by forward and backward sums."""
        moves, (T, n, K) = self.p["moves"], scores.shape
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + moves[-1]
        for t in range(1, T):
            new = lse(alpha[t - 1][:, :, None] + moves[None, :-1], 1) + scores[t]
            alpha[t] = np.where(mask[:, t][:, None], new, alpha[t - 1])
        total = lse(alpha[-1], 1)
        for t in range(T - 2, -1, -1):
            new = lse(moves[None, :-1] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[:, t + 1][:, None], new, 0)
        at = mask.T[:, :, None]
        prob = np.exp(alpha + beta - total[None, :, None]) * at
        d = prob
        dm = np.zeros_like(moves)
        for t in range(1, T):
            pair = np.exp(alpha[t - 1][:, :, None] + moves[None, :-1] + (scores[t] + beta[t])[:, None, :] - total[:, None, None])
            dm[:-1] += (pair * mask[:, t][:, None, None]).sum(0)
        dm[-1] = prob[0].sum(0)
        rows = np.arange(n)
        gold = scores[0][rows, labels[:, 0]] + moves[-1, labels[:, 0]]
        np.add.at(dm, (-1, labels[:, 0]), -1)
        for t in range(T):
            w = mask[:, t]
            d[t][rows[w], labels[w, t]] -= 1
            if t:
                gold = gold + w * (scores[t][rows, labels[:, t]] + moves[labels[:, t - 1], labels[:, t]])
                np.add.at(dm, (labels[w, t - 1], labels[w, t]), -1)
        return float((total - gold).mean()), (d / n).astype(np.float32), (dm / n).astype(np.float32)


def _shard(net: Network, params: dict[str, np.ndarray], part) -> tuple[int, float, dict[str, np.ndarray]]:
    net.p = params
    return len(part[0]), *net.gradient(*part)


def train(examples: list[Example], seed: int = 3, passes: int = PASSES, step: int = STEP, workers: int = WORKERS, say=print) -> Network:
    """A network fitted to the windows of ``examples``. The gradient of a step is the mean over shards of ``step`` windows each."""
    r = random.Random(seed)
    data = [w for e in examples for w in windows_of(e)]
    data = list({(w, tuple(y)) for w, y in data})
    data.sort()
    count: dict[str, int] = {}
    for w, _ in data:
        for c in set(w):
            count[c] = count.get(c, 0) + 1
    letters = "".join(sorted(c for c, n in count.items() if n >= 4))
    net = Network(letters, seed)
    code = {c: i + 2 for i, c in enumerate(letters)}
    names = {2 * TYPES.index("person_name") + 1, 2 * TYPES.index("person_name") + 2}

    def coded(batch):
        lengths = np.array([len(w) for w, _ in batch])
        codes, labels = np.zeros((len(batch), lengths.max()), np.int64), np.zeros((len(batch), lengths.max()), np.int64)
        for i, (w, y) in enumerate(batch):
            elsewhere = r.choice((0.0, 0.0, 2 * UNKNOWN_ELSEWHERE))
            codes[i, : len(w)] = [1 if r.random() < ((UNKNOWN if v in names else elsewhere) if "一" <= c <= "鿿" else 0.01) else code.get(c, 1) for c, v in zip(w, y)]
            labels[i, : len(w)] = y
        return codes, labels, lengths

    blank = Network("", seed)
    pool = multiprocessing.get_context("spawn").Pool(workers) if workers > 1 else None
    try:
        for epoch in range(passes):
            r.shuffle(data)
            chunks = [sorted(data[i : i + step * 200], key=lambda x: len(x[0])) for i in range(0, len(data), step * 200)]
            shards = [c[i : i + step] for c in chunks for i in range(0, len(c), step)]
            r.shuffle(shards)
            steps = [shards[i : i + workers] for i in range(0, len(shards), workers)]
            total = 0.0
            for k, group in enumerate(steps):
                jobs = [(blank, net.p, coded(b)) for b in group]
                parts = pool.starmap(_shard, jobs, chunksize=1) if pool else [_shard(*j) for j in jobs]
                size = sum(n for n, _, _ in parts)
                at = k + epoch * len(steps)
                net.apply({key: sum(n / size * g[key] for n, _, g in parts) for key in net.p}, RATE * min(1, (at + 1) / 60) * (1 - at / (passes * len(steps))) ** 0.8)
                total += sum(n * loss for n, loss, _ in parts)
            say(f"pass {epoch + 1}: {total / len(data):.4f} a window, {len(data)} windows, {len(letters)} characters")
    finally:
        if pool:
            pool.terminate()
    return net


def tagger_of(net: Network) -> Tagger:
    p = net.p
    return Tagger(net.letters, *inference_tables(p["emb"], p["wx"], p["wh"], p["b"]), p["wo"], p["bo"], p["moves"])


def save(net: Network, path=WEIGHTS) -> None:
    np.savez_compressed(path, letters=np.array(net.letters), **{k: v.astype(np.float16) for k, v in net.p.items()})


def carriers_of(folder: str, sample: int = SAMPLE, seed: int = 5) -> list[str]:
    """Sentences and lines of documents without a role, title or long number in them."""
    import pyarrow.parquet as pq

    r = random.Random(seed)
    docs = [t for t in pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    r.shuffle(docs)
    person = re.compile("|".join([*ROLES, *TITLES, "@", r"\d{7}"]))
    return [s.strip()[:80] for t in docs[:sample] for s in re.split(r"(?<=[。？！\n])", t)[:6] if 4 < len(s.strip()) and not person.search(s)]


def train_all(folder: str, number: int = COMPOSED, say=print) -> Network:
    carriers, r = carriers_of(folder), random.Random(17)
    return train([composed(carriers, r) for _ in range(number)], say=say)


if __name__ == "__main__":
    save(train_all(sys.argv[1]))
