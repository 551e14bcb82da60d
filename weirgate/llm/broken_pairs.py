"""Question and answer pairs whose answer is empty, copied, a refusal, in another language, or cut off.

The first four follow from the pair itself. Whether an answer without a final stop is cut off is told by the corpus:
its last clause is sorted among all clauses of all answers, numbers masked, and compared with its neighbours. If it is a
shortened version of others, and not known as an end, it is cut; if others end like it, it is whole. Where neighbours
tell nothing, its last word is sorted among all words: a shortened word, or one that hardly ever ends a sentence, is cut.
Answers at a length where unfinished answers pile up (a length limit) are taken as cut as well; all others are sound.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.sources.tables import durable

#: Longest answer of one clause that may be a bare term; letters of an end that are compared, the longer first.
TERM, ENDINGS = 8, (8, 4)
#: A length is a limit where unfinished answers end in at least so many different clauses, and are so many times those of
#: the lengths around it. Neither depends on how often the same rows stand in a table.
SPIKE_CLAUSES, SPIKE_TIMES = 5, 8
#: A word tells an end from a cut from so many uses on; it ends no sentence if it stands at the end of fewer than one in so many.
USES, ONE_IN = 20, 100

#: Labels before an answer, placeholders for none, labels before a copied question.
_LABEL = re.compile(r"^\W*(?:答案|答|回答|解答|答复|输出|answer|the answer is|response|output|a|reply)\s*(?:是|为|is)?\s*[:：]\s*", re.I)
_PLACEHOLDERS = frozenset("null none nil nan na n/a n.a. 无 空 略 暂无 没有 未知 未填写 待补充 待填写 待定 同上 tbd todo empty undefined missing unknown blank placeholder 无答案 暂无答案 无内容 见解析 omitted".split()) - {"unknown", "没有", "同上", "见解析"}
_ASKED = re.compile(r"^(?:(?:您|你)?(?:的)?(?:原)?(?:问题|题目|提问|题干|原题|题|问)(?:是|为|如下|问)*|q|question|the question is|your question(?: is| was)?|you asked|question asked|prompt|instruction|query|user)*$", re.I)

#: How answers decline.
_REFUSES = re.compile(
    r"^\W*(?:很|非常|十分|实在|真的)?(?:抱歉|对不起|不好意思|遗憾|很遗憾)[^。！]{0,40}(?:无法|不能|不便|不方便|不宜|不予|没有[^。]{0,4}权限|超出|不可以|办不到|帮不上|不支持|难以)"
    r"|^\W*恕(?:我)?(?:不能|无法|不便|难)"
    r"|^\W*(?:我|本人|本助手|本模型|这里|此处)(?:暂时|目前|现在)?(?:没有|无法|不能|不便|不方便|不会|不予|不可以|帮不)[^。！]{0,14}(?:上忙|给出|提供|回答|协助|讨论|处理|回应|解答|权限|作答|帮)"
    r"|^\W*作为[^，。]{0,14}(?:模型|助手|AI|人工智能)[^。]{0,16}(?:不能|无法|不便|不会|不应|没有)"
    r"|^\W*(?:基于|根据|出于|按照|由于|鉴于)[^。]{0,16}(?:规范|政策|规定|原则|要求|限制)[^。]{0,12}(?:不作|不予|不能|无法|不便|拒绝)"
    r"|^\W*(?:这|该|此)[^。，]{0,10}(?:问题|内容|请求|话题)[^。]{0,8}(?:不便|无法|不能|不予|超出)[^。]{0,8}(?:讨论|回答|回应|提供|协助|范围|处理)"
    r"|^\W*(?:这|此|该|关于)[^。]{0,16}(?:我|本人)[^。，]{0,4}(?:帮不上|帮不了|无能为力|不方便|无法|不能|不便)(?:[^。]{0,4}(?:回答|提供|给出|处理|讨论|协助|忙|解答|回应|作答)|[，。])"
    r"|^\W*(?:i\s?(?:'|’)?\s?a?m|we are|i am)\s+(?:really |very |so |truly )?(?:sorry|afraid)\b[^.!]{0,60}\b(?:can ?not|can(?:'|’)t|unable|won(?:'|’)t|not able|couldn(?:'|’)t|don(?:'|’)t)"
    r"|^\W*(?:sorry|apologies|unfortunately|regrettably|i apologi[sz]e)\b[^.!]{0,60}\b(?:can ?not|can(?:'|’)t|unable|won(?:'|’)t|not able|no answer|outside|beyond|decline|don(?:'|’)t|isn(?:'|’)t something)"
    r"|^\W*as an? [^,.]{0,24}(?:model|assistant|ai)\b[^.]{0,30}(?:can ?not|can(?:'|’)t|unable|not able|won(?:'|’)t|don(?:'|’)t|do not)"
    r"|^\W*i\s+(?:must|have to|need to|will have to)\s+(?:decline|refuse)"
    r"|^\W*i(?:\s+(?:can ?not|can(?:'|’)t|won(?:'|’)t|will not|am unable|am not able|do not|don(?:'|’)t)|(?:'|’)m (?:unable|not able))\b[^.]{0,30}\b(?:answer|respond|help|assist|provide|discuss|comply|give|share|comment|fulfil)"
    r"|^\W*(?:this|that|it)(?: is|(?:'|’)s) (?:not something|nothing) (?:that )?(?:i|we)\b"
    r"|^\W*(?:this|that|the) (?:request|question|topic|content)[^.]{0,30}(?:outside|beyond|against|cannot be|can(?:'|’)t be|not something i)",
    re.I,
)

#: Frequent words by language, and which language a question asks for.
_WORDS = {
    "en": set("the of and to is in that for with as on was are by this be it from at which an or its so may when if has have not but".split()),
    "es": set("el la los las de que y en se para por del con un una es cuando antes depende este esta su".split()),
    "de": set("der die das und ist nicht sollte man ein eine wenn sich mit den dem zu auf für deshalb sobald werden wird von".split()),
    "fr": set("le la les des et est une un dans pour que qui il sont du ce cette avec sur quand avant il faut de se".split()),
    "it": set("il lo la gli di che e un una per con del della è sono quando prima si questo questa".split()),
    "pt": set("o a os as de que e em um uma para com do da é são quando antes se este esta".split()),
    "nl": set("de het een en van is niet dat op te voor met zijn wordt als".split()),
}
_ASKS_FOR = [("en", re.compile(r"(?:译|翻)[^。，]{0,6}(?:英文|英语)|用(?:英文|英语)|(?:in|into) english", re.I)), ("zh", re.compile(r"(?:译|翻)[^。，]{0,6}(?:中文|汉语)|用(?:中文|汉语)|(?:in|into) chinese", re.I)), ("ja", re.compile(r"日文|日语|(?:in|into) japanese", re.I)), ("fr", re.compile(r"法文|法语|(?:in|into) french", re.I)), ("de", re.compile(r"德文|德语|(?:in|into) german", re.I)), ("ru", re.compile(r"俄文|俄语|(?:in|into) russian", re.I)), ("es", re.compile(r"西班牙|(?:in|into) spanish", re.I)), ("ko", re.compile(r"韩文|韩语|(?:in|into) korean", re.I))]
#: Scripts of languages an answer may be asked for in, by the name ``language`` gives them.
_ASKS_FOR_SCRIPT = {"devanagari": re.compile(r"印地|梵[文语]|尼泊尔[文语]|马拉地|\b(?:hindi|sanskrit|nepali|marathi|devanagari)\b", re.I), "hebrew": re.compile(r"希伯来|意第绪|\b(?:hebrew|yiddish)\b", re.I), "bengali": re.compile(r"孟加拉|\b(?:bengali|bangla)\b", re.I), "tamil": re.compile(r"泰米尔|\btamil\b", re.I), "georgian": re.compile(r"格鲁吉亚|\bgeorgian\b", re.I), "armenian": re.compile(r"亚美尼亚|\barmenian\b", re.I)}
_OPTIONS = re.compile(r"\n\s*[AＡ]\s*[.．、:：)）].*", re.S)
_MAIL = re.compile(r"(?<![A-Za-z0-9._+\-Ａ-Ｚａ-ｚ０-９＿．])[A-Za-z0-9._+\-Ａ-Ｚａ-ｚ０-９＿．]+\s?(?:@|＠|\[at\]|[(（]at[)）])\s?[A-Za-z0-9._\-Ａ-Ｚａ-ｚ０-９．]+(?:\s(?:dot|\[dot\])\s[A-Za-z0-9]+)*", re.I)


_NO_LETTER = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """Letters and digits only, one width, lower case."""
    return _NO_LETTER.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


_SCRIPTS = [
    ("zh", re.compile("[\u3400-\u4dbf\u4e00-\u9fff]")),
    ("ja", re.compile("[\u3040-\u30ff\uff66-\uff9f]")),
    ("ko", re.compile("[\uac00-\ud7a3]")),
    ("latin", re.compile(r"[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\uff21-\uff3a\uff41-\uff5a]")),
    ("ru", re.compile("[\u0400-\u0481\u048a-\u052f]")),
    ("ar", re.compile("[\u0620-\u064a\u066e-\u06d3]")),
    ("th", re.compile("[\u0e01-\u0e30\u0e40-\u0e46]")),
    ("el", re.compile("[\u0370-\u03ff]")),
]
#: Letters that no pattern above takes. They count by the first word of their Unicode name, so that each script is one of its own.
_REST = re.compile(r"[^\W\d_" + "".join(p.pattern[1:-1] for _, p in _SCRIPTS) + "]")
_NAMED = {"CJK": "zh", "IDEOGRAPHIC": "zh", "HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "LATIN": "latin", "CYRILLIC": "ru", "ARABIC": "ar", "THAI": "th", "GREEK": "el"}


def _scripts(text: str) -> Counter[str]:
    if text.isascii():
        return Counter(latin=len(_SCRIPTS[3][1].findall(text)))
    out = Counter({k: n for k, p in _SCRIPTS if (n := len(p.findall(text)))})
    for c in unicodedata.normalize("NFKC", "".join(_REST.findall(text))):
        if c.isalpha():
            name = unicodedata.name(c, "other").split(" ")[0]
            out[_NAMED.get(name, name.lower())] += 1
    return out


def _latin_language(text: str) -> str:
    words = re.findall(r"[a-zà-ÿ]+", text.lower())
    hits = {k: sum(w in v for w in words) for k, v in _WORDS.items()}
    best = max(hits, key=lambda k: (hits[k], k == "en"))
    return best if hits[best] >= 2 and hits[best] > hits["en"] else "en"


def language(text: str) -> str | None:
    """The language that most of a text is written in; None where there is too little to tell."""
    n = _scripts(text)
    if n["ja"] >= 3 and n["ja"] * 8 >= n["zh"] + n["ja"]:
        return "ja"
    weigh = {k: v * (3 if k in ("zh", "ko") else 1) for k, v in n.items() if k != "ja"}
    if not weigh:
        return None
    best = max(weigh, key=lambda k: (weigh[k], k))
    if best == "latin":
        return _latin_language(text) if n["latin"] >= 12 and len(text.split()) >= 3 else None
    return best if weigh[best] >= 12 else None


def other_language(question: str, answer: str) -> bool:
    said = language(_LABEL.sub("", answer))
    if said is None:
        return False
    for code, asks in _ASKS_FOR:
        if asks.search(question):
            return said != code
    if said in _ASKS_FOR_SCRIPT and _ASKS_FOR_SCRIPT[said].search(question):
        return False
    stem = _MAIL.sub("", _OPTIONS.sub("", question))
    own = language(stem)
    n = _scripts(stem)
    mixed = {"zh"} if n["zh"] >= 6 else set()
    if n["latin"] >= 25:
        mixed.add(_latin_language(stem))
    return own is not None and said != own and said not in mixed


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if len(_NO_LETTER.sub("", answer)) > 40:  # longer than any label with a placeholder
        return False
    bare = _LABEL.sub("", unicodedata.normalize("NFKC", answer)).strip()
    core = "".join(c for c in bare if unicodedata.category(c)[0] in "LNS")
    if not core or all(not c.isalnum() and unicodedata.category(c) != "Sc" for c in core) and not re.search(r"[√×±≤≥≠=+<>]", core):
        return True
    return re.sub(r"[\s()\[\]{}<>（）【】「」。.…_—-]+$|^[\s()\[\]{}<>（）【】「」。.…_—-]+", "", bare).lower() in _PLACEHOLDERS


def is_copied(question: str, answer: str) -> bool:
    """Whether nothing but the question stands in the answer, once or more, with or without options and label."""
    whole, stem, said = letters(question), letters(_OPTIONS.sub("", question)), letters(answer)
    if len(stem) < 4 or len(said) < 4:
        return False
    rest, times = said, 0
    for part in (whole, stem):
        times += rest.count(part)
        rest = rest.replace(part, "\n")
    if times:
        return bool(_ASKED.match(rest.replace("\n", "").strip("0123456789"))) and "答案" not in rest
    head = re.split(r"[:：]\s*", answer, maxsplit=1)
    for s in {said, letters(head[1]) if len(head) == 2 and _ASKED.match(letters(head[0])) else said}:
        if len(s) >= 8 and len(s) * 2 >= len(stem) and (s in whole or (len(s) % 2 == 0 and s[: len(s) // 2] == s[len(s) // 2 :] and s[: len(s) // 2] in whole)):
            return True
    return False


_STEPS = {c: i for i, c in enumerate("零一二三四五六七八九十")} | {"两": 2}
_ENGLISH = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten".split())}
_ANNOUNCED = re.compile(r"^[^。.\n]{0,16}?(?:(?:共|有|分|为|以下|如下|下列|是)\s*(?:为|成|以下|如下)?\s*(?P<zh>[一二两三四五六七八九十]|\d{1,2})\s*(?:个|大|方面|种)?(?:方面|条|点|步|项|部分|要点|步骤|原因|阶段)[^。.:：\n，]{0,8}[。:：\n]|\b(?P<en>\d{1,2}|two|three|four|five|six|seven|eight|nine|ten)\s+(?:items|points|steps|reasons|parts|things|aspects|ways|stages|factors)\b[^.:\n]{0,24}[.:\n])", re.I)
_MARKS = [re.compile(r"第([一二三四五六七八九十]{1,2})(?=[，,、：: ])"), re.compile(r"(?:^|[\n。.;；:： ])\s*[(（]?(\d{1,2})\s*[.、)）．]\s*(?=\S)"), re.compile(r"(?:^|[\n。；])\s*[(（]?([一二三四五六七八九十])[、)）.]"), re.compile(r"\b(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)(?:ly)?\b[, ]", re.I)]
_ORDINALS = {w: i for i, w in enumerate("zeroth first second third fourth fifth sixth seventh eighth ninth tenth".split())}


def fewer_than_announced(answer: str) -> bool:
    """Whether an answer announces a number of points at its start and numbers fewer."""
    m = _ANNOUNCED.match(answer)
    if not m:
        return False
    raw = (m["zh"] or m["en"]).lower()
    wanted = int(raw) if raw.isdigit() else _STEPS.get(raw) or _ENGLISH.get(raw, 0)
    rest = answer[m.end() - 1 :]
    given = 0
    for mark in _MARKS:
        at = 0
        for x in mark.findall(rest):
            n = int(x) if x.isdigit() else _STEPS.get(x) or _ORDINALS.get(x.lower(), 0)
            at = n if n == at + 1 else at
        given = max(given, at)
    return (given > 0 or len(rest.strip(" 。.:：\n")) == 0) and given < wanted


_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_ITEM = re.compile(r"(^|\n)\s*(?:[(（]?\d{1,2}[.、)）．]|[-*•])[ \t]*")
_STOP = re.compile(r"([。！？!?；;\n]+|\.(?=\s|$))|([，,、：:])")
_CLOSED = re.compile(r"[。！？!?…]\s*[”’\"')）】」』]*\s*$|\.\s*[”’\"')）】」』]*\s*$")


def clauses(answer: str) -> tuple[list[tuple[str, bool]], str]:
    """((clause, ends with a stop), ...) and the unfinished rest, numbers masked and list marks taken off."""
    text = unicodedata.normalize("NFKC", answer)
    text = _NUMBER.sub("0", _ITEM.sub("\n", text)).strip(" \t")
    out, at = [], 0
    for m in _STOP.finditer(text):
        clause = text[at : m.start()].strip()
        at = m.end()
        if clause:
            out.append((clause, m[1] is not None))
    return out, text[at:].strip()


def pair_rules(question: str | None, answer: str | None) -> tuple[str | None, str | None, bool]:
    """(defect, unfinished last clause, it is the whole answer) from the pair alone."""
    if is_empty(answer):
        return "empty", None, False
    asked = question or ""
    if asked and is_copied(asked, answer):
        return "copied", None, False
    body = _LABEL.sub("", answer)
    if _REFUSES.search(body):
        return "refusal", None, False
    if asked and other_language(asked, answer):
        return "other_language", None, False
    if fewer_than_announced(body):
        return "truncated", None, False
    if _CLOSED.search(body):
        return None, None, False
    plain = unicodedata.normalize("NFKC", body).rstrip()
    if re.fullmatch(r"[A-Fa-f](?:[\s,、A-Fa-f]*)", plain.strip()) or re.fullmatch(r"[A-Fa-f][.、:)]\s*[^。，,]{1,24}", plain.strip()):
        return None, None, False
    known, rest = clauses(body)
    opened = max(plain.rfind(a) - plain.rfind(b) for a, b in ("()", "《》", "“”", "【】", "「」"))
    if (opened > 0 and plain[-1] not in ")》”】」") or plain[-1] in ",、:：;；(“《" or (not rest and re.search(r"\n\s*\d{1,2}[.、)]?\s*$", body)):
        return "truncated", None, False
    if not rest:
        return None, None, False
    return None, rest, not known


_LATIN_WORD = re.compile(r"[^\W\d_]+$")


def last_words(clause: str) -> list[str]:
    """What a clause ends with, the most telling first: the last word, or the last two characters and the last one in Chinese."""
    end = clause.rstrip("0123456789 .%\"'”’)）")
    if not end:
        return []
    if "\u3040" <= end[-1] <= "\u9fff":
        return [end[-2:], end[-1]] if len(end) > 1 else [end]
    m = _LATIN_WORD.search(end)
    return [m[0].lower()] if m else []


_WORDS_OF = re.compile("[\u3040-\u9fff]|[^\\W\\d_\u3040-\u9fff]+")


def words_of(clause: str) -> list[str]:
    """All words of a clause as ``last_words`` takes them: Latin words, Chinese characters, and pairs of neighbours."""
    units = _WORDS_OF.findall(clause.lower())
    return units + [a + b for a, b in zip(units, units[1:]) if "\u3040" <= a <= "\u9fff" and "\u3040" <= b <= "\u9fff"]


def _neighbours(batches):
    """Rows by text in order; for each last one, how often it is known and whether the next known text goes on from it.

    Last ones wait for the next known text only while each is the beginning of the next row, so few ever wait. Those that
    still wait at the end of a partition are marked ``open``; a row of kind ``first`` gives the first known text of it.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    columns = ["text", "stops", "goes_on", "shortened", "kind", "part"]
    waiting: list[tuple[str, int, int]] = []
    first = None
    for pdf in batches:
        out = []
        for text, stops, goes, last in zip(pdf["text"], pdf["stops"], pdf["goes_on"], pdf["is_last"]):
            out += [(*w, False, "told", part) for w in waiting if not text.startswith(w[0])]
            waiting = [w for w in waiting if text.startswith(w[0])]
            if stops + goes:
                first = text if first is None else first
                out += [(*w, True, "told", part) for w in waiting]
                waiting = []
            if last:
                waiting.append((text, stops, goes))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([(*w, False, "open", part) for w in waiting] + [(first, 0, 0, False, "first", part)], columns=columns)


def shortened_versions(known: DataFrame, last: DataFrame) -> DataFrame:
    """text, stops, goes_on, shortened for each text of ``last``, sorted among those of ``known`` (text, stops, goes_on).

    Distinct texts are sorted by their whole length in ranges of equal size, so no beginning is too frequent for a task. What
    waits at the end of a range is compared with the first known text of the ranges after it: a row for each range.
    """
    both = known.withColumn("is_last", F.lit(False)).unionByName(last.select("text", F.lit(0).cast("long").alias("stops"), F.lit(0).cast("long").alias("goes_on"), F.lit(True).alias("is_last")))
    both = both.groupBy("text").agg(F.sum("stops").alias("stops"), F.sum("goes_on").alias("goes_on"), F.max("is_last").alias("is_last"))
    ordered = both.repartitionByRange("text").sortWithinPartitions("text")
    told = durable(ordered.mapInPandas(_neighbours, "text string, stops long, goes_on long, shortened boolean, kind string, part int"))
    after = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # a row a partition
    firsts = told.where("kind = 'first'").select("part", F.first("text", ignorenulls=True).over(after).alias("next"))
    opened = told.where("kind = 'open'").join(F.broadcast(firsts), "part").withColumn("shortened", F.coalesce(F.startswith("next", F.col("text")), F.lit(False)))
    columns = ["text", "stops", "goes_on", "shortened"]
    return told.where("kind = 'told'").select(*columns).unionByName(opened.select(*columns))


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """table_name, row_key, defect of every pair whose answer is defective.

    ``pairs``: table_name, row_key, question, answer. A null answer is ``empty``; a null question alone is no defect, its
    answer is still judged by itself; rows without a key are left out. Rows delivered again count once; equal answers are judged alike; an empty table
    gives no rows; other columns are ignored. Clauses and words are counted before they are shuffled, distinct ones are sorted
    in ranges of equal size, and no group is held in one task's memory.
    """
    pairs = pairs.where("row_key is not null")
    kinds = "table_name string, row_key long, defect string, rest string, alone boolean, size int"

    def rules(batches):
        for pdf in batches:
            got = [(*pair_rules(q, a), len(a or "")) for q, a in zip(pdf["question"], pdf["answer"])]
            yield pd.concat([pdf[["table_name", "row_key"]].reset_index(drop=True), pd.DataFrame(got, columns=["defect", "rest", "alone", "size"], dtype="object")], axis=1).astype({"alone": "bool", "size": "int32"})

    def count(batches):
        for pdf in batches:
            stops, goes = Counter(), Counter()
            for a in pdf["answer"]:
                for c, stop in clauses(_LABEL.sub("", a))[0]:
                    (stops if stop else goes)[c] += 1
            keys = list(stops.keys() | goes.keys())
            yield pd.DataFrame({"clause": keys, "stops": [stops[k] for k in keys], "goes_on": [goes[k] for k in keys]}).astype({"clause": "object", "stops": "int64", "goes_on": "int64"})

    # kept once: filters on what it holds would else send every use through the rules again
    judged = durable(pairs.select("table_name", "row_key", "question", "answer").mapInPandas(rules, kinds).where("defect is not null or rest is not null").distinct())
    counted = pairs.where("answer is not null").select("answer").mapInPandas(count, "clause string, stops long, goes_on long")
    counted = durable(counted.groupBy("clause").agg(F.sum("stops").alias("stops"), F.sum("goes_on").alias("goes_on")))  # used by the sort and both lengths of endings
    open_ends = judged.where("defect is null and rest is not null").select("table_name", "row_key", "rest", "alone", "size")

    told = shortened_versions(counted.withColumnRenamed("clause", "text"), open_ends.select(F.col("rest").alias("text")).distinct()).withColumnRenamed("text", "clause")
    for n in ENDINGS:
        ends = counted.groupBy(F.right("clause", F.lit(n)).alias("ending")).agg(F.sum("stops").alias(f"stops_{n}"), F.sum("goes_on").alias(f"goes_on_{n}"))
        told = told.withColumn("ending", F.right("clause", F.lit(n))).join(ends, "ending", "left").drop("ending")

    def count_words(batches):
        for pdf in batches:
            uses, ends = Counter(), Counter()
            for clause, stops, goes in zip(pdf["clause"], pdf["stops"], pdf["goes_on"]):
                for w in words_of(clause):
                    uses[w] += stops + goes
                for w in last_words(clause):
                    ends[w] += stops
            yield pd.DataFrame({"text": list(uses), "stops": [ends[w] for w in uses], "goes_on": [uses[w] - ends[w] for w in uses]}).astype({"text": "object", "stops": "int64", "goes_on": "int64"})

    @F.pandas_udf("array<string>")
    def ending(rests: pd.Series) -> pd.Series:
        return pd.Series([last_words(r) for r in rests], dtype="object")

    told = told.withColumn("ends", ending("clause"))
    words = counted.mapInPandas(count_words, "text string, stops long, goes_on long").groupBy("text").agg(F.sum("stops").alias("stops"), F.greatest(F.sum("goes_on"), F.lit(0)).alias("goes_on"))
    asked = told.select(F.explode("ends").alias("text")).distinct()
    of_words = shortened_versions(words, asked)
    for k in (0, 1):
        of = of_words.select(F.col("text").alias(f"word_{k}"), F.col("stops").alias(f"word_stops_{k}"), (F.col("stops") + F.col("goes_on")).alias(f"word_uses_{k}"), F.col("shortened").alias(f"word_cut_{k}"))
        told = told.withColumn(f"word_{k}", F.get("ends", F.lit(k))).join(of, f"word_{k}", "left")
    # answers of how many lengths break off at a word; with complete clauses before it only, as bare terms are whole
    stuck = open_ends.where("not alone").select("rest", "size").distinct().join(told.select(F.col("clause").alias("rest"), "word_0"), "rest").groupBy("word_0").agg(F.countDistinct("size").alias("stuck"))
    told = told.join(stuck, "word_0", "left")
    # the longer word decides if it is used often enough; a word that is never used but begins others is cut off, and so is
    # one that many answers end with and no complete clause ever uses
    seldom = lambda k: F.col(f"word_stops_{k}") * ONE_IN < F.col(f"word_uses_{k}")
    used = lambda k: F.coalesce(F.col(f"word_uses_{k}") >= USES, F.lit(False))
    told = told.withColumn("no_end", F.when((F.col("word_uses_0") == 0) & F.col("word_cut_0") & (F.size("ends") == 1), F.lit(True)).when((F.coalesce("word_uses_0", F.lit(0)) == 0) & (F.col("stuck") >= SPIKE_CLAUSES), F.lit(True)).when(used(0), seldom(0)).when(used(1), seldom(1)).otherwise(F.lit(False)))

    sizes = open_ends.groupBy("size").agg(F.count("*").alias("n"), F.countDistinct("rest").alias("different"))  # one row per length
    around = Window.orderBy("size").rangeBetween(-10, 10)
    limits = sizes.withColumn("near", (F.sum("n").over(around) - F.col("n")) / 20).where((F.col("different") >= SPIKE_CLAUSES) & (F.col("n") >= SPIKE_TIMES * F.col("near"))).select("size", F.lit(True).alias("at_limit"))

    # the longest known ending decides; like: whether it is one of whole answers
    seen = [F.coalesce(F.col(f"stops_{n}") + F.col(f"goes_on_{n}") > 0, F.lit(False)) for n in ENDINGS]
    like = [seen[i] & ~F.greatest(F.lit(False), F.lit(False), *seen[:i]) & (F.col(f"stops_{n}") > 0) & (F.col(f"stops_{n}") >= F.col(f"goes_on_{n}")) for i, n in enumerate(ENDINGS)]
    cut = (
        F.when(F.col("alone") & (F.length("rest") <= TERM), F.lit(False))
        .when((F.col("stops") > 0) & (F.col("stops") * 10 >= F.col("goes_on")), F.lit(False))
        .when(F.col("shortened") | (F.col("goes_on") > 0), F.lit(True))
        .when(F.greatest(*like), F.lit(False))
        .otherwise(F.coalesce(F.col("at_limit"), F.lit(False)) | F.coalesce(F.col("no_end"), F.lit(False)))
    )
    by_corpus = open_ends.join(told, open_ends["rest"] == told["clause"], "left").join(F.broadcast(limits), "size", "left").where(cut).select("table_name", "row_key", F.lit("truncated").alias("defect"))
    return judged.where("defect is not null").select("table_name", "row_key", "defect").unionByName(by_corpus).distinct()
