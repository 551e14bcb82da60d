"""String functions shared by all stages."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's blanks as a Java character class, and its word characters.
BLANK = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD = r"[\p{L}\p{N}_]"

#: Addresses, tags and reference marks taken out of text; signs of a wrong decoding and their share.
URL, TAG, MARK = r"https?://\S+", r"<[^>]{1,50}>", r"\[\d+\]|【\d+】|\(\d+\)"
DAMAGED, DAMAGED_SHARE = "Ã¤Ââ€˜�", 0.08


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect, with Python's Unicode meaning of \\w, \\d and \\s."""
    out, at, inside = "", 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            n = pattern[at + 1]
            plain = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": BLANK[1:-1]}
            if n in plain:
                out += plain[n] if inside else f"[{plain[n]}]"
            elif n in "WDS":
                out += f"[^{plain[n.lower()]}]"
            elif n == "Z":
                out += r"\z"
            else:
                out += c + n
            at += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "[":
            out += "\\"
        elif c == "]":
            inside = False
        out += c
        at += 1
    return out


def java_replacement(replacement: str) -> str:
    """A Python replacement in Java's dialect."""
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, java_pattern(pattern), java_replacement(replacement))


def strip(text: Column) -> Column:
    """Blanks of all kinds off both ends."""
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def strip_markup(text: Column) -> Column:
    """Addresses, tags and reference marks become blanks. (An address's own placeholder is a tag, so it goes as well.)"""
    return sub(sub(sub(text, URL, "<URL>"), TAG, " "), MARK, " ")


def fold_blanks(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "[ \t\u3000]+", " "), "\n{3,}", "\n\n"))


def repaired(text: str) -> str:
    """A byte order mark taken off; text read as Latin-1 read again as UTF-8 where many signs are damaged."""
    text = text.lstrip("\ufeff")
    if text and sum(c in DAMAGED or "\ue000" <= c <= "\uf8ff" for c in text) > DAMAGED_SHARE * len(text):
        try:
            return text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
    return text


def _clean(text: str) -> str:
    text = repaired(text)
    for pattern, new in ((URL, "<URL>"), (TAG, " "), (MARK, " ")):
        text = re.sub(pattern, new, text)
    text = unicodedata.normalize("NFKC", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub("[ \t\u3000]+", " ", text)).strip()


def clean_text(text: Column) -> Column:
    """Repair, markup, compatibility form, blanks; null stays null. Spark has no NFKC, so this is one Arrow function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _clean(t) for t in texts], dtype="object")

    return run(text)


def clean_texts(texts: Column) -> Column:
    """``clean_text`` of every element of an array."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [None if t is None else _clean(t) for t in r] for r in rows], dtype="object")

    return run(texts)


def norm_text(text: Column) -> Column:
    """Lower case, word characters only: the form in which texts are compared."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def bigrams(text: Column) -> Column:
    """The set of pairs of neighbouring characters; a shorter text is its own only member.

    Characters are split once and zipped with their neighbours; a substring per place would be quadratic. They are bound
    by an outer lambda: otherwise the whole expression of the text would be evaluated again for every use.
    """

    def pairs(chars: Column) -> Column:
        n = F.size(chars)
        zipped = F.zip_with(F.slice(chars, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.concat(x, y))
        return F.when(n < 2, F.array(F.array_join(chars, ""))).otherwise(F.array_distinct(zipped))

    return F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), pairs)[0]


def arabic_number(text: Column) -> Column:
    """Chinese numerals with tens, hundreds and thousands as digits; digits stay; anything else stays as it is."""
    digit = lambda c: F.instr(F.lit("零一二三四五六七八九"), c) - 1
    place = lambda c: F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"), F.lit(True).alias("ok"))

    def step(a: Column, c: Column) -> Column:
        d, p = digit(c).cast("long"), place(c).cast("long")
        return F.struct(
            F.when(p.isNotNull(), a["total"] + F.when(a["last"] == 0, F.lit(1)).otherwise(a["last"]) * p).otherwise(a["total"]).cast("long").alias("total"),
            F.when(p.isNotNull(), F.lit(0)).when(d >= 0, d).otherwise(a["last"]).cast("long").alias("last"),
            (a["ok"] & (p.isNotNull() | (d >= 0))).alias("ok"),
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = F.aggregate(chars, start, step)
    return F.when(text.rlike(r"^\p{Nd}+$") | (text == ""), text).when(value["ok"], (value["total"] + value["last"]).cast("string")).otherwise(text)
