"""Personal information in free text: names, e-mail addresses, phone and identity numbers, street addresses.

A character-level bidirectional LSTM with CRF transitions labels every character. Texts are cut at ends of sentences
and at wide commas; longer stretches are covered by overlapping windows, each decoded by itself and reconciled over the whole stretch: a
character's label comes from the window in which it lies farthest from an edge. Windows are keyed by what the model
sees of them, so that equal windows are decoded once. An exact check of form follows (digits of a number, parts of an
address); it only removes spans. The model is trained in numpy by ``pii_training`` and stored beside this module.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ["person_name", "email", "phone", "id_number", "street_address"]
LABELS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
WINDOW, STRIDE, BATCH, MEMO = 96, 64, 256, 400_000
WEIGHTS = Path(__file__).with_name("pii_model.npz")

#: Chinese family names of one and of two characters.
FAMILY = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗丁宣邓郁单杭洪包诸左石崔吉龚程邢裴陆荣翁荀羊甄曲封储靳段富巫乌焦巴弓牧山谷车侯全班仰秋仲伊宫宁仇栾暴甘厉戎祖武符刘景詹束龙叶幸司韶黎薄印白怀蒲台从鄂索咸籍赖卓蔺屠蒙池乔阴胥苍双闻莘党翟谭贡劳姬申扶堵冉宰郦雍桑桂牛寿通边扈燕冀浦尚农温别庄晏柴瞿阎充慕连茹习艾鱼容向古易慎戈廖庾终居衡步都耿满弘匡国文寇广东欧沃利师巩聂关荆肖"
COMPOUND = "欧阳 慕容 令狐 端木 司徒 上官 诸葛 司马 夏侯 东方 皇甫 尉迟 公孙 宇文 长孙 轩辕 钟离 鲜于 闾丘 申屠 太史 澹台 公冶 濮阳 淳于 单于".split()

_END = re.compile(r"[^\n。！？，；]*(?:[。！？，；]+|\n+|$)")


@lru_cache(maxsize=1)
def narrow() -> dict[int, int]:
    """Wide and unusual forms of characters by their ordinary one; every digit reads 0. Lengths stay."""
    out: dict[int, int] = {}
    for cp in (*range(0x30, 0x3A), *range(0xA0, 0x3100), *range(0xFE00, 0x10000)):
        c = unicodedata.normalize("NFKC", chr(cp))
        if len(c) == 1 and c != chr(cp):
            out[cp] = ord(c)
        if len(c) == 1 and unicodedata.category(c) == "Nd":
            out[cp] = ord("0")
    out |= dict.fromkeys((0x2000, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000, 0xA0), ord(" "))
    return out


def seen(text: str) -> str:
    """What the model sees of a text, character by character."""
    return text.translate(narrow())


class Tagger:
    """The trained model. ``letters``: characters with codes from 2 on; 0 is padding and 1 any other."""

    def __init__(self, letters: str, tables: np.ndarray, recurrent: np.ndarray, out: np.ndarray, bias: np.ndarray, moves: np.ndarray):
        self.code = {ord(c): i + 2 for i, c in enumerate(letters)}
        self.tables, self.recurrent, self.out, self.bias, self.moves = tables, recurrent, out, bias, moves
        self.hidden = recurrent.shape[1]
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Tagger:
        with np.load(path) as z:
            emb, wx, wh, b = (z[k].astype(np.float32) for k in ("emb", "wx", "wh", "b"))
            return cls(str(z["letters"]), *inference_tables(emb, wx, wh, b), z["wo"].astype(np.float32), z["bo"].astype(np.float32), z["moves"].astype(np.float32))

    def _decode(self, windows: list[str]) -> list[bytes]:
        """Labels of windows of about equal lengths (Viterbi; of equal labels the first)."""
        n, lengths = len(windows), np.fromiter(map(len, windows), np.int64, len(windows))
        longest = int(lengths.max())
        forward = np.zeros((n, longest), np.int32)
        code = self.code
        for k, w in enumerate(windows):
            forward[k, : len(w)] = [code.get(ord(c), 1) for c in w]
        place = np.arange(longest)
        flip = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)
        both = np.stack([forward, np.take_along_axis(forward, flip, 1)])
        h, c = np.zeros((2, n, self.hidden), np.float32), np.zeros((2, n, self.hidden), np.float32)
        states = np.empty((2, longest, n, self.hidden), np.float32)
        H = self.hidden
        gates, looked, inner = (np.empty((2, n, k * H), np.float32) for k in (4, 4, 1))
        for t in range(longest):  # buffers are filled again at each step
            np.matmul(h, self.recurrent, out=gates)
            for d in (0, 1):
                np.take(self.tables[d], both[d, :, t], axis=0, out=looked[d], mode="clip")
            gates += looked
            np.tanh(gates, out=gates)
            sigmoid = gates[..., : 3 * H]
            sigmoid *= 0.5
            sigmoid += 0.5
            c *= gates[..., H : 2 * H]
            np.multiply(gates[..., :H], gates[..., 3 * H :], out=inner)
            c += inner
            np.tanh(c, out=inner)
            np.multiply(gates[..., 2 * H : 3 * H], inner, out=states[:, t])
            h = states[:, t]
        back = np.take_along_axis(states[1], flip.T[:, :, None], 0)
        scores = states[0] @ self.out[:H] + back @ self.out[H:] + self.bias
        best, came = scores[0] + self.moves[-1], np.zeros((longest, n, len(LABELS)), np.int8)
        inside = place[:, None] < lengths[None, :]
        for t in range(1, longest):
            through = best[:, :, None] + self.moves[None, :-1]
            came[t] = through.argmax(1)
            best = np.where(inside[t][:, None], through.max(1) + scores[t], best)
        label, out = best.argmax(1), np.zeros((longest, n), np.int8)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            out[t] = label
            label = np.where(inside[t] & (t > 0), came[t][rows, label], label)
        return [out[: lengths[k], k].tobytes() for k in range(n)]

    def learn(self, windows: set[str]) -> None:
        """Decode the windows that are not known yet."""
        new = sorted(windows - self.memo.keys(), key=len)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = sorted(windows, key=len)
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            self.memo.update(zip(part, self._decode(part)))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, type) of the personal information in each text, in order, without overlap."""
        cuts = []
        for t in texts:
            s = seen(t)
            parts = []
            for m in _END.finditer(t):  # the widths of the text itself tell commas of lists from those of numbers
                if m[0].strip():
                    for lo in range(m.start(), max(m.start() + 1, m.end() - (WINDOW - STRIDE)), STRIDE):
                        parts.append((lo, s[lo : min(lo + WINDOW, m.end())]))
            cuts.append((s, parts))
        self.learn({w for _, parts in cuts for _, w in parts})
        out = []
        for (s, parts), t in zip(cuts, texts):
            if not any(any(self.memo[w]) for _, w in parts):
                out.append([])
                continue
            labels, depth = np.zeros(len(s), np.int8), np.full(len(s), -1, np.int16)
            for lo, w in parts:
                d = np.minimum(np.arange(len(w)), np.arange(len(w))[::-1]).astype(np.int16)
                new = d > depth[lo : lo + len(w)]
                labels[lo : lo + len(w)][new] = np.frombuffer(self.memo[w], np.int8)[new]
                depth[lo : lo + len(w)][new] = d[new]
            out.append([x for x in _joined(labels) if sound(t[x[0] : x[1]], x[2], t[max(0, x[0] - 6) : x[0]], t[x[1] : x[1] + 4])])
        return out


def inference_tables(emb: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input tables and recurrent weights with the three sigmoid gates halved, so that one tanh serves all gates."""
    hidden = wh.shape[1]
    scale = np.concatenate([np.full(3 * hidden, 0.5, np.float32), np.ones(hidden, np.float32)])
    return np.stack([(emb @ wx[d] + b[d]) * scale for d in (0, 1)]), wh * scale


def _joined(labels: np.ndarray) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    at = 0
    while at < len(labels):
        if not labels[at]:
            at += 1
            continue
        kind = (labels[at] - 1) // 2
        end = at + 1
        while end < len(labels) and labels[end] == 2 * kind + 2:
            end += 1
        out.append((at, end, TYPES[kind]))
        at = end
    return out


_HAN_DIGITS = str.maketrans("零〇一二三四五六七八九", "00123456789")


#: Capitalised words that stand in no name.
_NO_FIRST = set("The A An If In On At This That These Those It No Not Yes True False What Which Who How Why When Where Dear My Our Your His Her Their For From And Or But So As To Of By With Please".split())


def sound(span: str, kind: str, before: str = "", after: str = "") -> bool:
    """Whether a span has the form of its type."""
    s = unicodedata.normalize("NFKC", span)
    digits = re.sub(r"\D", "", s.translate(_HAN_DIGITS)) if kind in ("phone", "id_number") else ""
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9]\s?(?:@|\[at\]|\(at\)|\bat\b)\s?[A-Za-z0-9\-]+\s?(?:\.|\bdot\b|\[dot\]|\(dot\))\s?[A-Za-z]", s, re.I))
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"\d", before[-1:] + after[:1])
    if kind == "id_number":
        if re.search(r"[0-9A-Za-z]", before[-1:]) or re.search(r"\d", after[:1]):
            return False
        bare = re.sub(r"[\s\-]", "", s).upper()
        if m := re.fullmatch(r"\d{6}(\d{4})(\d\d)(\d\d)\d{3}[\dX]", bare) or re.fullmatch(r"\d{6}(\d\d)(\d\d)(\d\d)\d{3}", bare):
            return 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31 and (len(m[1]) == 2 or 1880 <= int(m[1]) <= 2035)
        return bool(re.fullmatch(r"[A-Z]{1,2}\d{7,8}", bare) or re.fullmatch(r"\d{3}-\d\d-\d{4}", s.strip()))
    if kind == "street_address":
        return 4 <= len(s) <= 80 and bool(re.search(r"[\d一二三四五六七八九十百零]+\s*(?:号|弄|组|栋|室|单元)|\d+\w?[,\s]+(?:[A-Z][A-Za-z'’]*\.?\s)+[A-Z]\w+", s))
    # options of a question and parts of addresses are no persons
    if re.search(r"(?:^|\n)\s?[A-FＡ-Ｆ][.．、:：)）]\s*$", before) or re.search(r"\b(?:Street|Road|Avenue|Lane|Drive|Court)\b", s):
        return False
    if "一" <= s[:1] <= "龥" and "·" not in s and s[0] not in FAMILY and s[:2] not in COMPOUND:
        return False
    if s[:1].isascii() and (re.search(r"[A-Za-z]$", before) or re.match(r"[A-Za-z]", after) or not _NO_FIRST.isdisjoint(s.replace(".", "").split())):
        return False
    return bool(re.fullmatch(r"[一-龥]{2,4}|[一-龥]+(?:·[一-龥]+)+|(?:[A-Z]\.|[A-Z][A-Za-z'’\-]*)(?:\s+(?:[A-Z]\.|[A-Z][A-Za-z'’\-]*)){1,3}", s.strip()))


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger.load()


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    for lo, hi, kind in reversed(spans):
        text = text[:lo] + f"[{kind.upper()}]" + text[hi:]
    return text


def redact(text: Column) -> Column:
    """struct<text, types>: each text with typed placeholders, and the distinct types in order. Null stays null."""

    @F.pandas_udf("struct<text string, types array<string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = iter(tagger().spans([t for t in texts if t]))
        rows = []
        for t in texts:
            spans = next(found) if t else []
            rows.append((redacted(t, spans) if spans else t, sorted({k for _, _, k in spans})))
        return pd.DataFrame(rows, columns=["text", "types"], dtype="object")

    return run(text)


def personal_information(rows: DataFrame) -> DataFrame:
    """rows with ``redacted`` and ``types``, which replace columns of these names.

    ``text`` may be null or empty, which stays as it is and has no types. An empty table gives no rows.

    Every row is handled by itself, from its whole text; repeated rows come out as often as they occur.
    """
    kept = [c for c in rows.columns if c not in ("redacted", "types")]
    found = rows.select(*kept, redact(F.col("text")).alias("_personal"))
    return found.select(*kept, F.col("_personal.text").alias("redacted"), F.col("_personal.types").alias("types"))
