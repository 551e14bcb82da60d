"""One form for texts that look the same.

A mapping from character sequences to what a reader sees is built by rule from the Unicode tables, checked for
conflicts and compiled to a longest-match transducer over grapheme clusters (a character with its combining marks).
One pass brings widths, kinds of blank, composed accents, radicals, ligatures and look-alike letters to one form and
drops characters that are not seen. Case, accents, raised digits, other letters and the number of blanks stay.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.sources.tables import durable

#: Letters of other scripts that look like Latin ones (Cyrillic, Greek, then their Latin twins).
LOOK_ALIKES = [
    ("АВЕЅІЈКМНОРСТУХԌԚԜѴ", "ABESIJKMHOPCTYXGQWV"),
    ("аеѕіјорсухһԁԛԝѵӏ", "aesijopcyxhdqwvl"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("οϳ", "oj"),
]
#: Other characters seen as the same.
SEEN_AS = {"µ": "μ", "Ω": "Ω", "‐": "-", "‑": "-", "℃": "°C", "℉": "°F", "\t": " "}
#: Ranges of characters that are not seen, and of compatibility characters that look like their parts.
UNSEEN = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF)]
SAME_PARTS = [(0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0x3371, 0x33DF), (0xFB00, 0xFB06)]


def visual_mapping() -> dict[str, str]:
    """Character sequence -> its visual form, closed under itself."""
    twins = {a: b for many, latin in LOOK_ALIKES for a, b in zip(many, latin, strict=True)}
    unseen = {chr(c) for lo, hi in UNSEEN for c in range(lo, hi + 1)}
    parts = {c for lo, hi in SAME_PARTS for c in range(lo, hi + 1)}
    out: dict[str, str] = {**dict.fromkeys(unseen, ""), **twins, **SEEN_AS}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        c = chr(cp)
        if c in out:
            continue
        kind = unicodedata.decomposition(c)
        if unicodedata.category(c) == "Zs":
            out[c] = " "
        elif kind.startswith(("<wide>", "<narrow>")) or (kind.startswith("<") and cp in parts):
            out[c] = unicodedata.normalize("NFKC", c)
        elif kind and not kind.startswith("<"):
            whole = unicodedata.normalize("NFC", c)
            split = unicodedata.normalize("NFD", c)
            if whole != c:
                out[c] = whole
            if len(split) > 1:
                base = twins.get(split[0], split[0])
                seen = unicodedata.normalize("NFC", base + split[1:])
                out[split] = seen
                if seen != whole:
                    out[c] = seen
    step = lambda s: "".join(out.get(x, x) for x in s)
    for k in list(out):
        for _ in range(4):
            new = out.get(out[k], step(out[k])) if out[k] != k else out[k]
            if new == out[k]:
                break
            out[k] = new
    return {k: v for k, v in out.items() if k != v}


def check_mapping(mapping: dict[str, str]) -> None:
    """Raise unless the forms are final and no visible difference is lost: case, raised digits, marks over letters."""
    for k, v in mapping.items():
        if any(c in mapping for c in v):
            raise ValueError(f"the form of {k!r} is mapped again")
        if len(k) == len(v) == 1:
            if unicodedata.category(k) in ("Lu", "Ll") and unicodedata.category(v) in ("Lu", "Ll") and k.isupper() != v.isupper():
                raise ValueError(f"{k!r} changes its case")
            if unicodedata.decomposition(k).startswith(("<super>", "<sub>", "<font>", "<circle>")):
                raise ValueError(f"{k!r} is seen as raised or styled")
        marks = lambda s: sum(unicodedata.category(x) == "Mn" for x in unicodedata.normalize("NFD", s))
        if v and marks(k) != marks(v) and not unicodedata.decomposition(k).startswith("<"):
            raise ValueError(f"{k!r} loses a mark")


class _Forms(dict):
    """Grapheme cluster -> its form; clusters with marks are added when they are first seen."""

    def __init__(self, mapping: dict[str, str]):
        super().__init__({k: v for k, v in mapping.items() if len(k) == 1})
        self.mapping, self.longest = mapping, max(map(len, mapping))

    def __missing__(self, cluster: str) -> str:
        """Longest matches from left to right; what is no key is composed by the rules of Unicode."""
        s, at, out = "".join(self.get(c, c) for c in cluster), 0, ""
        while at < len(s):
            n = next((n for n in range(min(self.longest, len(s) - at), 1, -1) if s[at : at + n] in self.mapping), 1)
            out += self.mapping.get(s[at : at + n], s[at : at + n])
            at += n
        out = unicodedata.normalize("NFC", out)
        if len(cluster) <= 4:
            self[cluster] = out
        return out


class Transducer:
    """One pass from left to right over a text: an automaton stops at the longest cluster that can change (a character with
    its marks, or a character that is a key), the table gives its form, and everything between is copied."""

    def __init__(self, mapping: dict[str, str]):
        check_mapping(mapping)
        self.forms = _Forms(mapping)
        unseen = "".join(re.escape(k) for k, v in mapping.items() if not v)
        marks = re.escape("".join(map(chr, (c for c in range(0x300, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))))))
        keys = re.escape("".join(k for k in mapping if len(k) == 1))
        self.marked = re.compile(f"[{marks}{unseen}]").search
        self.step = re.compile(f"[^{marks}{unseen}](?:[{unseen}]*[{marks}])+|[{keys}]").sub
        self.unmarked_step = re.compile(f"[{keys}]").sub  # the same automaton where no character is more than a cluster of its own

    def __call__(self, text: str) -> str:
        if text.isascii() and "\t" not in text:
            return text
        forms = self.forms
        return (self.step if self.marked(text) else self.unmarked_step)(lambda m: forms[m[0]], text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer(visual_mapping())


def visual_form(text: Column) -> Column:
    """The visual form of each text; null stays null, an empty text empty. Applying it twice changes nothing more."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        run = transducer()
        return pd.Series([run(t) if t is not None else None for t in texts], dtype="object")

    return form(text)


def _hashed(rows: DataFrame) -> DataFrame:
    """table_name, key, form, raw: hashes of the form and of the characters of each visible text, kept once."""

    @F.pandas_udf("struct<form binary, raw binary>")
    def hashes(texts: pd.Series) -> pd.DataFrame:
        run, out = transducer(), []
        for t in texts:
            form = run(t) if t else ""
            digest = lambda x: hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()
            out.append((digest(form), digest(t)) if form.strip(" ") else (None, None))
        return pd.DataFrame(out, columns=["form", "raw"], dtype="object")

    seen = rows.where("text is not null and key is not null").select("table_name", "key", hashes(F.col("text")).alias("h"))
    return durable(seen.select("table_name", "key", "h.form", "h.raw").where("form is not null").distinct())


def look_alike_classes(rows: DataFrame) -> DataFrame:
    """table_name, key, class_id, n_texts, n_keys: one row a key and class of texts that look the same.

    ``rows``: table_name, key, text. ``class_id`` is a hash of the visual form, ``n_texts`` counts the different texts of the
    class and ``n_keys`` its distinct keys by text. Null keys, null texts and texts of nothing visible are left out; repeated
    rows count once; other columns are ignored; an empty table gives no rows.
    """
    hashed = _hashed(rows)
    by_text = hashed.groupBy("table_name", "form", "raw").agg(F.count("*").alias("n"))
    classes = by_text.groupBy("table_name", "form").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_keys"))
    return hashed.select("table_name", "key", "form").distinct().join(classes, ["table_name", "form"]).select("table_name", "key", F.lower(F.hex("form")).alias("class_id"), "n_texts", "n_keys")


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """table_name, key_a, key_b (key_a < key_b) of texts of one table that differ in characters but look the same.

    ``rows``: table_name, key, text. Null keys, null texts and texts of nothing visible are never paired; equal texts are no pair;
    repeated rows count once; other columns are ignored; an empty table gives no rows. Only hashes are shuffled. Different
    texts of one form are paired first, and the pairs of texts then widened to the keys of each side, so that no two
    keys of equal texts ever meet, however often a text is repeated.
    """
    hashed = _hashed(rows)
    texts = hashed.select("table_name", "form", "raw").distinct()
    a, b = texts.withColumnRenamed("raw", "raw_a"), texts.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, ["table_name", "form"]).where("raw_a <> raw_b")
    left = hashed.select("table_name", "form", F.col("raw").alias("raw_a"), F.col("key").alias("key_a"))
    right = hashed.select("table_name", "form", F.col("raw").alias("raw_b"), F.col("key").alias("key_b"))
    return pairs.join(left, ["table_name", "form", "raw_a"]).join(right, ["table_name", "form", "raw_b"]).where("key_a < key_b").select("table_name", "key_a", "key_b").distinct()
