"""The tables that drive the domain stages. They must equal the agreed word lists and patterns."""

from __future__ import annotations

COUNT = "[一二三四五六七八九十百零0-9]+"

# ---- de-identification: (id, pattern, replacement, level), then anchored (id, anchors, pattern, replacement, level, excluded values, excluded beginnings)
BARE = [
    ("id_card", r"(?<!\d)\d{17}[\dXx](?!\d)", "[身份证号]", "cleaned"),
    ("phone", r"(?<!\d)1[3-9]\d{9}(?!\d)", "[手机号]", "cleaned"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[邮箱]", "cleaned"),
]
PLACE = r"[一-龥]{1,15}[0-9]{1,6}[号室栋]?[一-龥0-9A-Za-z]{0,8}"
INSTITUTION = ("institution", r"[一-龥]{2,15}(?:医院|卫生院|医疗中心|门诊部|诊所)", "[机构]", "annotated")
MEDICAL_ANCHORED = [
    ("medical_record", ["病历号", "病案号", "住院号", "门诊号", "就诊号", "床号", "档案号"], "[A-Za-z0-9-]{4,}", "[病历号]", "cleaned", [], []),
    ("medical_insurance", ["医保卡号", "医保号", "社保号", "医保编码", "医保卡"], "[A-Z0-9-]{6,}", "[医保卡号]", "cleaned", [], []),
    ("treatment_card", ["就诊卡号", "就诊编号", "诊疗卡号"], "[A-Za-z0-9-]{4,}", "[就诊卡号]", "cleaned", [], []),
    ("address", ["地址", "住址", "家庭住址", "联系地址", "居住地"], PLACE, "[地址]", "annotated", [], []),
    ("doctor_name", ["医生", "医师", "主治医师", "主任医师", "教授", "护士", "接诊"], "[一-龥]{2,3}", "[医生姓名]", "annotated", [], ["该", "应该", "应", "需要", "要", "会", "想", "怀疑", "可能", "认为", "治疗", "建议", "判断", "如何", "怎样", "怎么", "如", "经", "为"]),
]
LEGAL_ANCHORED = [
    ("party_name", ["原告", "被告", "上诉人", "被上诉人", "申请人", "被申请人", "委托诉讼代理人", "辩护人", "第三人"], "[一-龥]{2,3}", "[当事人]", "annotated", ["诉称", "辩称", "认为", "依法", "请求", "应当", "起诉", "上诉", "申请", "某", "在", "于", "系", "称", "主张", "到庭", "应诉", "某某"], ["该", "应该", "应", "请", "请求", "主张", "辩称", "认为", "诉称", "依法", "提出", "提起", "上诉", "申请", "到庭", "应诉", "承担", "所谓", "某", "称", "系"]),
    ("address", ["住址", "地址", "住所地", "居住地", "住所"], PLACE, "[住址]", "annotated", [], []),
]
LEGAL_KEPT = [r"法释〔20\d{2}〕\d+号", r"国发〔20\d{2}〕\d+号", r"司发〔20\d{2}〕\d+号", r"〔20\d{2}〕\d+号", r"\d{4}[年.\-]\d{1,2}[月.\-]\d{1,2}日?", r"二〇\d{2}年\d{1,2}月\d{1,2}日", r"[（(]20\d{2}[）)]最高法[^，。\s]{0,14}?\d+号", r"[（(]20\d{2}[）)]?[^，。\s]{0,16}?\d+号", "人民法院", "民初", "刑初", "民终", "刑终"]
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳唐罗薛"
COMPOUND_SURNAMES = ["欧阳", "上官", "司马", "诸葛", "东方", "独孤", "皇甫", "尉迟", "公孙", "慕容", "司徒", "司空", "夏侯", "长孙", "令狐", "宇文", "赫连", "呼延", "端木", "百里"]
NAME_TRIGGERS = ["患者", "病人", "男", "女", "岁", "入院", "门诊", "住院", "家属", "就诊"]
NAME_SUFFIXES = ["先生", "女士", "老人", "孩子", "同志"]
NOT_NAMES = ["青霉素", "阿司匹林", "丹参", "白术", "茯苓", "甘草", "人参", "当归", "白芍", "黄芪", "麻黄", "桂枝", "半夏", "西洋参", "何首乌", "川贝母", "黄连", "黄柏", "陈皮", "红花", "佩兰", "青蒿"]
NOT_NAME_ENDINGS = ["素", "酶", "胺", "醇", "碱", "酸盐", "内酯", "霉素", "沙星", "替尼", "那韦", "酮", "酚", "苷"]
NAME_WINDOW = 6

# ---- sections of a case history: name and aliases, in order; 医嘱 has no place in the order
SECTIONS = {
    "患者基本信息": ["患者基本信息", "基本信息", "患者信息"],
    "主诉": ["主诉", "chief complaint", "cc"],
    "现病史": ["现病史", "病程描述", "history of present illness", "hpi"],
    "既往史": ["既往史", "past medical history", "pmh"],
    "个人史": ["个人史", "personal history"],
    "月经婚育史": ["月经婚育史", "月经史", "婚育史"],
    "家族史": ["家族史", "family history", "fh"],
    "过敏史": ["过敏史", "药物过敏史", "allergy history"],
    "手术史": ["手术史", "手术外伤史", "operative history"],
    "输血史": ["输血史", "transfusion history"],
    "用药史": ["用药史", "药物史", "medication history"],
    "生命体征": ["生命体征", "vital signs", "体温", "脉搏", "呼吸", "血压"],
    "体格检查": ["体格检查", "查体", "体检", "physical exam"],
    "辅助检查": ["辅助检查", "辅助检查结果", "实验室检查", "lab exam"],
    "诊断": ["诊断", "初步诊断", "诊断意见", "出院诊断", "impression"],
    "治疗": ["治疗", "治疗方案", "处方", "治疗意见"],
    "护理记录": ["护理记录", "护理", "nursing record"],
    "会诊记录": ["会诊记录", "会诊", "consultation"],
    "出院小结": ["出院小结", "出院记录", "discharge summary"],
    "随访": ["随访", "随访记录", "follow-up"],
    "医嘱": ["医嘱", "长期医嘱", "临时医嘱"],
}
UNORDERED_SECTIONS = {"医嘱"}

# ---- terms
MEDICAL_TYPOS = {"高血圧": "高血压", "血圧": "血压", "糖尿现": "糖尿病", "肝功素": "肝功能", "心律不齐": "心律不齐", "心肌梗赛": "心肌梗死", "蜜度": "密度"}
LEGAL_TYPOS = {"违约拖": "违约金", "损害陪偿": "损害赔偿", "违约责任义务": "违约责任"}
ABBREVIATIONS = {"COPD": "慢性阻塞性肺疾病", "DM": "糖尿病", "T2DM": "2型糖尿病", "HTN": "高血压", "BP": "血压", "HR": "心率", "WBC": "白细胞计数", "RBC": "红细胞计数", "PLT": "血小板", "Hb": "血红蛋白", "ALT": "丙氨酸氨基转移酶", "AST": "天冬氨酸氨基转移酶", "BMI": "体质指数", "HGB": "血红蛋白", "ECG": "心电图", "CXR": "胸部X线", "CT": "计算机断层扫描", "MRI": "磁共振成像"}
FREQUENCIES = {"qd": "每日1次", "bid": "每日2次", "tid": "每日3次", "qid": "每日4次", "q8h": "每8小时1次", "q12h": "每12小时1次", "q6h": "每6小时1次", "po": "口服", "iv": "静脉注射", "im": "肌肉注射", "sig": "用法"}

# ---- units: canonical name and aliases; plausible ranges of doses and laboratory values
UNIT_ALIASES = {
    "mL": ["ml", "ML", "毫升", "㎖"],
    "μg": ["ug", "μg", "微克", "µg", "mcg"],
    "mg": ["mg", "毫克", "公丝"],
    "g": ["g", "克"],
    "kg": ["kg", "千克"],
    "次/分": ["bpm", "次/分钟"],
    "mmHg": ["mmhg", "毫米汞柱"],
    "次/日": ["次/日", "每日几次"],
    "%": ["%", "％"],
    "mmol/L": ["mmol/l", "mmol/L", "millimol/L"],
    "mol/L": ["mol/l", "mol/L"],
    "U/L": ["u/L", "u/l", "U/L"],
    "×10^9/L": ["×10^9/L", "×10⁹/L", "x10^9/L", "10^9/L"],
}
COMPOSED_UNITS = ["mg/kg", "mg/kg/次/日"]
DOSES = [("mg/kg", 0.001, 100.0, "dose.implausible_high"), ("mg", 0.01, 2000.0, "dose.implausible_high"), ("μg", 0.1, 5000.0, "dose.implausible_high"), ("mL", 1.0, 1000.0, "dose.implausible_high"), ("次/分", 20.0, 250.0, "vital.implausible")]
LABS = [
    ("WBC", r"WBC\s*(\d+(?:\.\d+)?)\s*×?\s*10\^?9\s*/?\s*L", 3.5, 9.5, "lab.wbc.abnormal"),
    ("PLT", r"PLT\s*(\d+(?:\.\d+)?)\s*×?\s*10\^?9\s*/?\s*L", 100.0, 300.0, "lab.plt.abnormal"),
    ("Hb", r"HGB?\s*(\d+(?:\.\d+)?)\s*g\s*/\s*L", 110.0, 160.0, "lab.hb.abnormal"),
    ("空腹血糖", r"(?:空腹血糖|血糖)\s*[:：\s]*(\d+(?:\.\d+)?)\s*mmol\s*/\s*l", 3.9, 6.1, "lab.glu.abnormal"),
    ("ALT", r"ALT\s*(\d+(?:\.\d+)?)\s*U\s*/\s*l", 5.0, 40.0, "lab.alt.abnormal"),
]
DOSE_SECTIONS, LAB_SECTIONS = ["现病史", "诊断", "治疗", "医嘱"], ["辅助检查", "体格检查", "现病史"]

# ---- completeness and quality of case histories
REQUIRED_SECTIONS, SECTION_WEIGHTS, LEAST_STRUCTURE = ["主诉", "诊断"], {"主诉": 2, "现病史": 2, "既往史": 1, "过敏史": 1, "手术史": 1, "体格检查": 2, "辅助检查": 2, "诊断": 3, "治疗": 1, "医嘱": 1}, 4
DISEASES = ["高血压", "糖尿病", "冠心病", "急性心肌梗死", "心梗", "脑梗死", "脑出血", "肺炎", "阑尾炎", "胆结石", "肾结石", "胃癌", "肺癌", "肝硬化"]

# ---- marks of law, education and finance texts: (pattern, replacement)
LEGAL_MARKS = [
    (rf"第\s*({COUNT})\s*条", r"第\1条"),
    (rf"第\s*({COUNT})\s*款", r"第\1款"),
    (rf"第\s*({COUNT})\s*项", r"第\1项"),
    (rf"第\s*({COUNT})\s*编", r"第\1编"),
    (rf"第\s*({COUNT})\s*章", r"第\1章"),
    (rf"第\s*({COUNT})\s*节", r"第\1节"),
    (r"[（(]\s*(20\d{2})\s*[）)]\s*(最高法[^，。\s]{0,14}?)\s*(\d+)\s*号", r"（\1）\2\3号"),
]
EDUCATION_MARKS = [(r"(?m)^\s*([A-D])\s*[、.．)）】]\s*", r"\1. "), (r"答案[：:]\s*([A-D])", r"答案:\1"), (r"参考答案\s*([A-D])", r"答案:\1"), (r"正确选项(?:是)?\s*[：:]?\s*([A-D])", r"答案:\1"), ("题干[：:]", "题目:"), ("例题[：:]", "题目:")]
FINANCE_MARKS = [("％", "%"), ("[－–—]", "-")]
CITATION_FORMS = [(r"[（(]\s*(20\d{2})\s*[）)]\s*(最高法[^，。\s]{0,14}?)\s*(\d+)\s*号", r"（\1）\2\3号"), (r"[（(]\s*(20\d{2})\s*[）)]\s*(最高检[^，。\s]{0,14}?)\s*(\d+)\s*号", r"（\1）最高检\3号")]
CITATIONS = [r"法释〔20\d{2}〕\d+号", r"国发〔20\d{2}〕\d+号", r"司发〔20\d{2}〕\d+号", r"〔20\d{2}〕\d+号", r"\d{4}[年.\-/]\d{1,2}[月.\-/]\d{1,2}日?", r"二〇\d{2}年\d{1,2}月\d{1,2}日", r"[（(]20\d{2}[）)]最高法[^，。\s]{0,14}?\d+号", r"[（(]20\d{2}[）)]最高检[^，。\s]{0,14}?\d+号", r"[（(]20\d{2}[）)]?[^，。\s]{0,16}?\d+号", r"《[^》]{2,30}》", rf"第{COUNT}条"]

# ---- kinds of legal documents, in order: (name, all of, none of); parts; hierarchy marks
DOC_TYPES = [("判决书", ["人民法院", "判决书", "判决如下"], []), ("裁定书", ["人民法院", "裁定书"], []), ("调解书", ["调解书", "调解协议|调解如下"], []), ("合同", ["甲方", "乙方"], ["判决", "裁定", "调解"]), ("司法解释", ["法释〔|最高人民法院关于"], []), ("法规", [rf"第{COUNT}条"], ["判决", "裁定", "调解", "甲方"])]
LEGAL_PARTS = {
    "文书类型": ["民事判决书", "刑事判决书", "行政判决书", "民事裁定书", "刑事裁定书", "行政裁定书", "调解书", "判决书", "裁定书", "决定书"],
    "案号": ["案号"],
    "法院": ["人民法院", "中级人民法院", "高级人民法院"],
    "当事人": ["原告", "被告", "上诉人", "被上诉人", "申请人", "被申请人", "第三人"],
    "委托诉讼代理人": ["委托诉讼代理人", "诉讼代理人", "委托代理人", "辩护人"],
    "案由": ["案由", "纠纷一案"],
    "事实与理由": ["事实与理由", "事实和理由"],
    "本院认为": ["本院认为", "本院经审理认为", "本院经审查认为"],
    "判决主文": ["判决如下", "裁定如下", "判决主文"],
    "尾部": ["审判长", "审判员", "人民陪审员", "书记员"],
}
NUMBER = "([一二三四五六七八九十百零0-9]{1,6})"
HIERARCHY = [
    ("编", rf"^\s*第\s*{NUMBER}\s*编"),
    ("章", rf"^\s*第\s*{NUMBER}\s*章"),
    ("节", rf"^\s*第\s*{NUMBER}\s*节"),
    ("条", rf"^\s*第\s*{NUMBER}\s*条"),
    ("款", rf"^\s*第\s*{NUMBER}\s*款"),
    ("项", r"^\s*[（(]\s*([一二三四五六七八九十]+)\s*[）)]"),
    ("num", r"^\s*([一二三四五六七八九十]+)[、.]"),
    ("num", r"^\s*\(\s*(\d{1,2})\s*\)\s*"),
]
LEVELS = {"编": 0, "章": 1, "节": 2, "条": 3, "款": 4, "项": 5, "num": 6}

# ---- completeness by pattern: checks, the ones required, whether failing drops, and the reason
_DATE = r"(?:\d{4}|[〇零一二三四五六七八九]{2,4})\s*年\s*(?:\d{1,2}|[一二三四五六七八九十]{1,2})\s*月"
_DAY = _DATE + r"\s*(?:\d{1,2}|[一二三四五六七八九十]{1,3})\s*日"
LEGAL_CHECKS = {
    "判决书": ({"has_case_no": r"案号|[（(]\d{4}[）)]|\d{4}[年.\-]\d+号", "has_party": "原告|被告|上诉人|被上诉人|申请人", "has_court": "人民法院", "has_date": _DAY, "has_ejudgment": "判决如下"}, ["has_case_no", "has_party", "has_court", "has_date", "has_ejudgment"], True, "判决书必备要素缺失"),
    "合同": ({"has_party_a": "甲方", "has_party_b": "乙方", "has_subject": "标的|价款|金额|租金", "has_clause": rf"第{COUNT}条", "has_sign": "签署|签字|生效|签订"}, ["has_party_a", "has_party_b", "has_subject"], False, "合同必备要素缺失"),
    "法规": ({"has_article": rf"第{COUNT}条", "has_org": "发布|施行|会议通过|委员会|主席令", "has_date": _DAY}, ["has_article", "has_org"], False, "法规必备要素缺失"),
    "司法解释": ({"has_docno": "法释〔|最高人民法院关于", "has_article": rf"第{COUNT}条", "has_date": _DATE}, ["has_docno", "has_article"], False, "司法解释必备要素缺失"),
}
FINANCE_CHECKS = ({"has_metric": r"\d+(?:\.\d+)?%|\d[\d,]*(?:\.\d+)?[万亿]元|\d+(?:\.\d+)?[%％]", "has_unit": "%|元|万元|亿元|倍|%点|bp|‰"}, ["has_metric", "has_unit"], True, "缺少带单位的数值指标")
EDUCATION_CHECKS = ({"has_options": r"(?m)^\s*[A-D]\s*\.", "has_answer": r"答案[：:]\s*[A-D]"}, ["has_options", "has_answer"], True, "缺少选项或答案")

# ---- labels of question types; instruction of law summaries
QUESTION_TYPES = {"单项选择题": "单选题", "考试单选题": "单选题", "单项选择": "单选题", "多项选择题": "多选题", "多选题": "多选题", "多项选择": "多选题", "填空题": "填空题", "填空": "填空题", "问答题": "问答题", "简答题": "简答题", "名词解释": "名词解释", "论述题": "论述题", "qb": "填空题", "qa": "问答题", "qas": "问答题"}
LAW_SUMMARY = "概括以下法条/条文的核心要义。"

# ---- presets: domain, name, stages, how completeness and quality are judged
PRESETS = {
    ("medical", "medical_cn"): (["deid", "section", "terminology", "units", "completeness_qc", "quality_score"], "sections"),
    ("medical", "medical_qa"): (["deid", "terminology", "units", "quality_score"], "pair"),
    ("legal", "legal_cn"): (["deid", "terminology", "marker_norm", "doc_type", "legal_structure", "completeness_qc", "quality_score"], "regex"),
    ("legal", "legal_qa"): (["deid", "terminology", "marker_norm", "quality_score"], "pair"),
    ("finance", "finance_cn"): (["numeric", "terminology", "completeness_qc", "quality_score"], "regex"),
    ("finance", "finance_qa"): (["numeric", "terminology", "quality_score"], "pair"),
    ("education", "education_cn"): (["marker_norm", "terminology", "completeness_qc", "quality_score"], "regex"),
    ("education", "education_qa"): (["marker_norm", "terminology", "quality_score"], "pair"),
    ("generic", "generic"): (["quality_score"], "none"),
}
DOMAIN_LABELS = {"医疗": "medical", "法律": "legal", "金融": "finance", "教育": "education"}
