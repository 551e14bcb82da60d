"""Quantities recorded in different units, brought to one unit per kind.

Conversions are edges of a graph with affine functions. The shortest composition from every unit to the canonical unit
of its kind is computed once, every cycle is checked, and the texts' mentions are equi-joined with the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.sources.tables import bounded_rows

Affine = tuple[Fraction, Fraction]  # x -> a x + b

#: Unit, unit, factor, offset (first = factor * x + offset, in the second unit). The last of each kind is canonical.
CONVERSIONS = [
    ("kg", "g", "1000", "0"), ("斤", "g", "500", "0"), ("lb", "kg", "0.45359237", "0"), ("lb", "g", "453.59237", "0"), ("斤", "kg", "0.5", "0"), ("g", "mg", "1000", "0"), ("mg", "μg", "1000", "0"),
    ("L", "dL", "10", "0"), ("dL", "mL", "100", "0"), ("L", "mL", "1000", "0"),
    ("°F", "°C", "5/9", "-160/9"), ("°C", "0.1 °C", "10", "0"), ("°F", "0.1 °C", "50/9", "-1600/9"),
    ("kPa", "mmHg", "7.50062", "0"),
    ("mg/dL", "mmol/L", "1/18", "0"), ("mmol/L", "0.1 mmol/L", "10", "0"),
    ("ft", "in", "12", "0"), ("in", "cm", "2.54", "0"), ("in", "mm", "25.4", "0"), ("m", "cm", "100", "0"), ("cm", "mm", "10", "0"), ("m", "mm", "1000", "0"),
]
#: The canonical unit of each kind.
CANONICAL = {"mass": "μg", "volume": "mL", "temperature": "0.1 °C", "pressure": "mmHg", "glucose": "0.1 mmol/L", "length": "mm"}
#: Spellings besides those of the unit table.
SPELLINGS = {
    "μg": ["ug", "mcg", "μg", "微克", "microgram", "micrograms"],
    "mg": ["mg", "毫克", "milligram", "milligrams"],
    "g": ["g", "gm", "克", "gram", "grams"],
    "kg": ["kg", "kgs", "千克", "公斤", "kilo", "kilos", "kilogram", "kilograms"],
    "斤": ["斤", "市斤"],
    "lb": ["lb", "lbs", "磅", "pound", "pounds"],
    "mL": ["ml", "cc", "毫升", "millilitre", "millilitres", "milliliter", "milliliters"],
    "L": ["l", "升", "公升", "litre", "litres", "liter", "liters"],
    "dL": ["dl", "分升"],
    "°C": ["°c", "摄氏度", "degrees celsius", "degree celsius", "celsius", "度", "c"],
    "°F": ["°f", "华氏度", "degrees fahrenheit", "degree fahrenheit", "fahrenheit", "f"],
    "mmHg": ["mmhg", "mm hg", "毫米汞柱"],
    "kPa": ["kpa", "千帕"],
    "mmol/L": ["mmol/l"],
    "mg/dL": ["mg/dl"],
    "mm": ["mm", "毫米", "millimetre", "millimetres", "millimeter", "millimeters"],
    "cm": ["cm", "cms", "厘米", "公分", "centimetre", "centimetres", "centimeter", "centimeters"],
    "m": ["m", "米", "metre", "metres", "meter", "meters"],
    "in": ["in", "inch", "inches", "英寸"],
    "ft": ["ft", "foot", "feet", "英尺"],
}


def _apply_after(f: Affine, g: Affine) -> Affine:
    return g[0] * f[0], g[0] * f[1] + g[1]


def compositions(edges: Iterable[tuple[str, str, str, str]], targets: Iterable[str]) -> dict[tuple[str, str], Affine]:
    """(unit, target) -> the affine function along a shortest path. A cycle that does not return every value is an error."""
    graph: dict[str, list[tuple[str, Affine]]] = {}
    for a, b, factor, offset in edges:
        k, c = Fraction(factor), Fraction(offset)
        graph.setdefault(a, []).append((b, (k, c)))
        graph.setdefault(b, []).append((a, (1 / k, -c / k)))
    out: dict[tuple[str, str], Affine] = {}
    for target in targets:
        if target not in graph:
            continue
        to: dict[str, Affine] = {target: (Fraction(1), Fraction(0))}
        queue = deque([target])
        while queue:
            v = queue.popleft()
            for u, f in graph[v]:
                back = (1 / f[0], -f[1] / f[0])  # u -> v
                new = _apply_after(back, to[v])
                if u not in to:
                    to[u] = new
                    queue.append(u)
                elif to[u] != new:
                    raise ValueError(f"conversions of {u} to {target} contradict each other")
        out |= {(u, target): f for u, f in to.items()}
    return out


def spelling_key(s: str) -> str:
    """Units are compared in lower case without width, blanks and the two signs for micro. Only a lone M or G keeps its case."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s)).strip()
    return s if s in ("M", "G") else s.lower()


def unit_table(units: list[tuple[str, list[str | None] | None, str | None]]) -> list[tuple[str, str, float, float]]:
    """(spelling, kind, factor, offset) for every known spelling. ``units``: name, aliases, kind (null: not a quantity)."""
    functions = compositions(CONVERSIONS, CANONICAL.values())
    kind_of = {u: kind for (u, target), _ in functions.items() for kind, t in CANONICAL.items() if t == target}
    spelled: dict[str, str] = {spelling_key(s): u for u, many in SPELLINGS.items() for s in many}
    for name, aliases, kind in units:
        base = spelled.get(spelling_key(name), name)
        if kind is None or kind_of.get(base) != kind:
            continue
        for s in [name, *(aliases or [])]:
            if s and s.strip():
                spelled.setdefault(spelling_key(s), base)
    return [(s, kind_of[u], float(functions[u, CANONICAL[kind_of[u]]][0]), float(functions[u, CANONICAL[kind_of[u]]][1])) for s, u in spelled.items()]


_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
_PLACES = {"十": 10, "百": 100, "千": 1000, "万": 10000}
_HAN = "[零〇一二两三四五六七八九十百千万]"
_ARABIC = r"(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?:\s*[×xX*]\s*10\s*\^\s*-?\d+)?"
_NUMBER = rf"(?:{_ARABIC}|{_HAN}+(?:点{_HAN}+)?)"


_GLUCOSE = ("mmol/l", "mg/dl")
_DEGREES = frozenset(spelling_key(s) for u in ("°C", "°F") for s in (u, *SPELLINGS[u]))
#: Letters that are written directly before a number as its label, and those of glucose.
_LABELS = re.compile(r"(?<![A-Za-z])(?:W|WT|BW|H|HT|T|TEMP|BT|P|[SD]?BP|GLU|GLUC|GLUCOSE|[FRPN]?B[GS]|[FP]PG)$", re.I)
_SUGAR = re.compile(r"(?<![A-Za-z])(?:GLU|GLUC|GLUCOSE|SUGAR|[FRPN]?B[GS]|[FP]PG|is|was|of|at|to|and|or|from|about)$", re.I)


def number_value(s: str) -> float | None:
    """A number in digits (commas, powers of ten) or Chinese numerals; None where it is none, or far too long for one."""
    s = s.strip()
    if len(s) > 40:
        return None
    if m := re.fullmatch(r"([\d,]*(?:\.\d+)?)(?<=\d)(?:\s*[×xX*]\s*10\s*\^\s*(-?\d+))?", s):
        return float(Fraction("0" + m[1].replace(",", "")) * Fraction(10) ** int(m[2] or 0))
    whole, _, part = s.partition("点")
    if not any(c in _PLACES for c in whole):
        value = float("".join(str(_DIGITS[c]) for c in whole)) if whole and all(c in _DIGITS for c in whole) else None
    else:
        total = section = digit = 0
        last = 1
        for c in whole:
            if c in _DIGITS:
                digit = _DIGITS[c]
                last = 1 if digit == 0 else last
            elif c == "万":
                total, section, digit, last = (total + section + digit) * 10000, 0, 0, 10000
            else:
                section, digit, last = section + (digit or 1) * _PLACES[c], 0, _PLACES[c]
        value = float(total + section + digit * (last // 10 if last >= 100 and digit else 1))
    if value is not None and part:
        if not all(c in _DIGITS for c in part):
            return None
        value += float("0." + "".join(str(_DIGITS[c]) for c in part))
    return value


class Mentions:
    """Finds (spelling, value) of every measured quantity in a text."""

    def __init__(self, spellings: Iterable[str]):
        known = sorted(spellings, key=lambda s: (-len(s), s))
        unit = "|".join(re.escape(s).replace(r"\ ", r"\s?") for s in known)
        pressure = "|".join(re.escape(s).replace(r"\ ", r"\s?") for s in known if s in ("mmhg", "mm hg", "毫米汞柱", "kpa", "千帕"))
        rate = r"(?!\s*[/／每]|\^|[A-Za-z]|(?<=[A-Za-z])[0-9])"
        stop = r"(?<![Nn]o\.)(?<![A-Za-z](?=\.))"  # a full stop after a letter ends a sentence, it is no decimal point
        before = rf"(?<!\d)(?<!\d[.,])(?<!\d[-+–:/])(?<!{_HAN})(?<!{_HAN}-){stop}"  # no start within a number: long runs stay linear
        pair = rf"(?P<hi>{_NUMBER})\s*/\s*(?P<lo>{_NUMBER})\s*"
        height = rf"(?P<h1>{_NUMBER})\s*(?:(?P<m>米|m(?=\d\d(?!\d)))\s*(?P<h2>\d{{1,2}}(?![\d.])|{_HAN}{{1,3}})(?:\s*(?:厘米|公分|cm|CM))?(?!\s*[月日年岁天次]|{_HAN})|(?P<ft>英尺|feet|foot|ft|')\s*(?P<h3>{_NUMBER})\s*(?:英寸|inches|inch|in\b|\"|''|寸)?)"
        label = rf"(?:[(\[]\s*(?P<u2>{unit})\s*[)\]]|(?<=[^\W\d])/(?P<u3>{unit})(?=\s*[:=])|\b[Ii]n\s+(?P<u4>{unit})(?=\s*[:=]))\s*(?:[:=]|is|为|是)?\s*(?:(?P<lhi>{_NUMBER})\s*/\s*)?(?P<n2>{_NUMBER})(?:\s*(?:{unit})(?![A-Za-z]))?"
        self.find = re.compile(rf"{label}|{before}(?:{pair}(?P<up>{pressure}){rate}|{height}|(?P<n1>{_NUMBER})\s*(?P<u1>{unit}){rate})", re.I)
        self.not_glucose = re.compile(r"(胆固醇|甘油三酯|尿酸|尿素|肌酐|血钾|血钠|血钙|血氯|胆红素|乳酸|[Cc]holesterol|[Tt]riglyceride|[Cc]reatinine|[Uu]rea|[Uu]ric|[Pp]otassium|[Ss]odium|[Cc]alcium|[Ll]actate)[^,;。，；]{0,12}$")

    @staticmethod
    def plain(text: str) -> str:
        """One width and one kind of blank; raised digits stay apart from ordinary ones."""
        text = text.replace("²", "^2").replace("³", "^3").replace("⁄", "/")
        text = re.sub(r"(?<=\d)，(?!\d{3}(?!\d))", ", ", text)  # between numbers, unless it marks thousands
        text = re.sub("[­​-‏⁠﻿]", "", text)
        return unicodedata.normalize("NFKC", text).replace("∕", "/").replace("㏄", "cc").replace("μ", "μ")

    def __call__(self, text: str) -> Iterator[tuple[str, float]]:
        text = self.plain(text)
        end = 0
        for m in self.find.finditer(text):
            g = m.groupdict()
            out: list[tuple[str, str]] = []
            last, end, sign = end, m.end(), 1
            if g["up"]:
                out = [(g["up"], g["hi"]), (g["up"], g["lo"])]
            elif g["h1"]:
                yield from self.height(g)
                continue
            elif g["n2"]:
                u = g["u2"] or g["u3"] or g["u4"]
                out = [(u, g["lhi"])] if g["lhi"] else []
                out.append((u, g["n2"]))
            elif g["u1"] and self.meant(text, m) and (sign := self.sign(text, m, last)):
                out = [(g["u1"], g["n1"])]
            for u, n in out:
                key = spelling_key(u)
                if key in _GLUCOSE and (self.not_glucose.search(text[: m.start()]) or g["u1"] and self.other_substance(text, m)):
                    continue
                if (v := number_value(n)) is not None:
                    yield key, sign * v

    @staticmethod
    def height(g: dict[str, str | None]) -> Iterator[tuple[str, float]]:
        a = number_value(g["h1"])
        if g["ft"]:
            b = number_value(g["h3"])
            if a is not None and b is not None:
                yield "in", a * 12 + b
            return
        b = number_value(g["h2"])
        if a is not None and b is not None:
            one = len(g["h2"]) == 1
            yield "cm", a * 100 + (b * 10 if one else b)

    @staticmethod
    def sign(text: str, m: re.Match, last: int) -> int:
        """-1 after a minus, 1 after anything else, 0 where the number belongs to a name or ends a range. ``last``: end of the mention before.

        Only temperatures are below zero next to a word or at the start of an item; before others a dash there is a dash.
        """
        at = m.start()
        dash = text[at - 1 : at] in ("-", "−")
        prior = text[max(0, at - 12) : at - 1 if dash else at]
        if re.search("[A-Za-z]$", prior) and not (dash and last == at - 1) and not _LABELS.search(prior):
            if not ("." in m["n1"] or len(m["n1"]) > 1 and m.end("n1") == m.start("u1")):
                return 0
        if not dash or last and not text[last : at - 1].strip():
            return 1
        if re.search(r"\d\s+$", prior):
            return 0
        degrees = spelling_key(m["u1"]) in _DEGREES
        return -1 if degrees or not prior or re.search(r"[ \t,:;=(\[<>~≤≥≈。、]$", prior) else 1

    def other_substance(self, text: str, m: re.Match) -> bool:
        """Whether what stands next to the number names something else than glucose."""
        prior = text[max(0, m.start() - 40) : m.start()]
        near = prior.rstrip(",-−+")
        if re.search("[A-Za-z]$", near) and prior != prior.rstrip():
            return False
        return near != prior and bool(self.not_glucose.search(near)) or bool(re.search("[A-Za-z]$", near)) and not _SUGAR.search(near)

    def meant(self, text: str, m: re.Match) -> bool:
        """Whether a short or ambiguous unit stands for a measured quantity here."""
        u, after, prior = m["u1"], text[m.end() :], text[max(0, m.start() - 8) : m.start()]
        if u in ("M", "G", "In"):
            return False
        if u in "CcFf":
            return u in "CF" and bool(re.search(r"(temperature|fever|体温|烧|发热|量了)", text[max(0, m.start() - 24) : m.start()], re.I)) and not re.match(r"\w", after)
        if u.lower() == "in":
            return not re.match(r"\s*[A-Za-z]", after) or bool(re.match(r"\s*(?:tall|high|long|wide|in height)", after))
        if u == "度":
            return bool(re.search(r"(体温|烧|发热|量了|℃)", text[max(0, m.start() - 10) : m.start()])) and not after.startswith("数")
        if re.match(r"(斤|克|升|米|磅|度)", u) and re.match(r"(?:斤|克|升|米|度)?(?:计较|拉|级|高|线|字|粉|饭)", after):
            return False
        if u in ("g", "克", "毫克", "mg") and re.search(r"每(?:公斤|千克|kg|100|升|毫升)\S{0,3}$", prior):
            return False
        return not re.match(r"\s*(?:per\b|一(?:公斤|千克)体重)", after)


def quantities(messages: DataFrame, units: DataFrame) -> DataFrame:
    """record_id, turn, quantity, amount of every quantity stated in the messages, in the common unit of its kind.

    ``messages``: record_id, messages (array of role, content); ``units``: name, aliases, quantity, at most 1000 rows.
    Null or empty messages and contents give no rows; equal mentions in one turn give one row; repeated keys count once;
    rows without a key are left out, other columns ignored. Amounts are rounded half up.
    """
    spark: SparkSession = messages.sparkSession
    known = unit_table([(r["name"], r["aliases"], r["quantity"]) for r in bounded_rows(units.where("name is not null").select("name", "aliases", "quantity"), 1000)])
    spellings = [s for s, *_ in known]
    turns = messages.where("record_id is not null").select("record_id", F.posexplode("messages").alias("turn", "message")).select("record_id", F.col("turn").cast("int"), F.col("message.content").alias("content"))
    turns = turns.where(F.col("content").rlike(r"[0-9０-９零〇一二两三四五六七八九十百千]"))

    def scan(batches):
        find = Mentions(spellings)
        for pdf in batches:
            rows = [(r, t, u, v) for r, t, c in zip(pdf["record_id"], pdf["turn"], pdf["content"]) for u, v in find(c)]
            yield pd.DataFrame(rows, columns=["record_id", "turn", "unit", "value"]).astype({"record_id": "int64", "turn": "int32", "unit": "object", "value": "float64"})

    mentions = turns.mapInPandas(scan, "record_id long, turn int, unit string, value double")
    table = spark.createDataFrame(known, "unit string, quantity string, factor double, offset double")
    amount = F.floor(F.col("value") * F.col("factor") + F.col("offset") + 0.5 + 1e-9).cast("long").alias("amount")
    return mentions.join(F.broadcast(table), "unit").select("record_id", "turn", "quantity", amount).distinct()
