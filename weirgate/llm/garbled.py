"""Text that was decoded in a wrong character encoding, found and restored.

Chinese has no blanks, so the words of the clean corpus are its single characters and pairs of neighbours. Every
distinct clean word is sent through every chain of wrong decodings; the forms that come out are joined, by hash, with
the tokens (all stretches of matching lengths) of values that hold unusual characters. A value whose stretch is covered
by forms of one chain is garbled. The original is taken back through the chain and kept only if it gives the same
garbled text again; where characters were lost there is none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chains of (written in, read in).
CHAINS: dict[str, list[tuple[str, str]]] = {
    "utf-8 as latin-1": [("utf-8", "latin-1")],
    "utf-8 as cp1252": [("utf-8", "cp1252")],
    "utf-8 as cp1251": [("utf-8", "cp1251")],
    "utf-8 as mac-roman": [("utf-8", "mac-roman")],
    "utf-8 as cp437": [("utf-8", "cp437")],
    "utf-8 as koi8-r": [("utf-8", "koi8-r")],
    "utf-8 as gb18030": [("utf-8", "gb18030")],
    "utf-8 as gbk": [("utf-8", "gbk")],
    "utf-8 as big5": [("utf-8", "big5")],
    "utf-8 as cp932": [("utf-8", "cp932")],
    "utf-8 as euc-kr": [("utf-8", "cp949")],
    "gbk as latin-1": [("gbk", "latin-1")],
    "gbk as cp1252": [("gbk", "cp1252")],
    "gbk as cp1251": [("gbk", "cp1251")],
    "gbk as utf-8": [("gbk", "utf-8")],
    "gbk as big5": [("gbk", "big5")],
    "gbk as cp932": [("gbk", "cp932")],
    "gbk as euc-kr": [("gbk", "cp949")],
    "big5 as gbk": [("big5", "gbk")],
    "big5 as latin-1": [("big5", "latin-1")],
    "utf-8 as latin-1, twice": [("utf-8", "latin-1")] * 2,
    "utf-8 as cp1252, twice": [("utf-8", "cp1252")] * 2,
    "gbk as latin-1, then utf-8 as latin-1": [("gbk", "latin-1"), ("utf-8", "latin-1")],
    "gbk as utf-8, then utf-8 as gbk": [("gbk", "utf-8"), ("utf-8", "gbk")],
    "gbk as utf-8, then utf-8 as gb18030": [("gbk", "utf-8"), ("utf-8", "gb18030")],
    "gbk as utf-8, then utf-8 as latin-1": [("gbk", "utf-8"), ("utf-8", "latin-1")],
    "gbk as utf-8, then utf-8 as cp1252": [("gbk", "utf-8"), ("utf-8", "cp1252")],
}
#: Single characters that clean text of other scripts may hold; letters of Latin-1 and signs.
OTHER_WORDS = "".join(map(chr, range(0xA1, 0x100))) + "“”‘’—–…‰μΩαβγ№≤≥≠"
_SINGLE_BYTE = {"latin-1", "cp1252", "cp1251", "mac-roman", "cp437", "koi8-r"}


def _read(data: bytes, code: str) -> str:
    """Bytes that a one-byte code leaves undefined stay as control characters; others become U+FFFD."""
    if code in _SINGLE_BYTE:
        return data.decode(code, "surrogateescape").translate({0xDC00 + b: b for b in range(0x80, 0x100)})
    return data.decode(code, "replace")


def _write(text: str, code: str) -> bytes | None:
    out = b""
    if code not in _SINGLE_BYTE:
        try:
            return text.encode(code)
        except UnicodeError:
            return None
    for c in text:
        try:
            out += c.encode(code)
        except UnicodeError:
            if not 0x80 <= ord(c) < 0x100:
                return None
            out += bytes([ord(c)])
    return out


def garble(text: str, chain: list[tuple[str, str]]) -> str | None:
    for written, read in chain:
        data = _write(text, written)
        if data is None:
            return None
        text = _read(data, read)
    return text


def restore(text: str, chain: list[tuple[str, str]]) -> str | None:
    """The original of a stretch, if nothing was lost: garbling it again gives the stretch.

    Where a code has two byte sequences for one character (cp932), a near form of the original can pass this check.
    """
    out = text
    for written, read in reversed(chain):
        data = _write(out, read)
        if data is None or "�" in out:
            return None
        try:
            out = data.decode(written)
        except UnicodeError:
            return None
    return out if garble(out, chain) == text else None


@lru_cache(maxsize=1)
def usual() -> frozenset[str]:
    """Characters that say nothing of a wrong decoding: ASCII, the most frequent Han characters by standard, marks and widths."""
    han = {bytes([hi, lo]).decode("gb2312", "ignore") for hi in range(0xB0, 0xD8) for lo in range(0xA1, 0xFF)}
    marks = set("，。、；：？！“”‘’（）《》〈〉【】「」『』…—·～〔〕")
    return frozenset(map(chr, range(0x80))) | han | marks | set(map(chr, range(0xFF01, 0xFF5F))) | set("   　")


_RUN = re.compile(r"[^\x00-\x7f]+")
#: Stretches up to this length are words of their own, as lost bytes may join their characters.
SHORT_RUN = 8


def words_of(text: str) -> set[str]:
    """Single characters and pairs of neighbours in the stretches outside ASCII, and short stretches as a whole."""
    runs = _RUN.findall(text)
    return {w for run in runs for i in range(len(run)) for w in (run[i], run[i : i + 2])} | {r for r in runs if len(r) <= SHORT_RUN}


def forms_of(word: str) -> list[tuple[str, str]]:
    """(form, chain) for every chain that changes the word into at least two characters, one of them unusual.

    Forms of one lost character, and of lost characters alone, tell nothing and are left out.
    """
    out = []
    for name, chain in CHAINS.items():
        form = garble(word, chain)
        if form and form != word and len(form) >= 2 and not usual().issuperset(form) and len(set(form)) + (word in OTHER_WORDS) >= 2:
            out.append((form, name))
    return out


def _unusual(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        known = usual()
        return pd.Series([t is not None and not known.issuperset(t) for t in texts], dtype="bool")

    return holds(text)


def judge(text: str, found: list[tuple[int, str, str]]) -> tuple[str | None, str | None]:
    """(chain, original) of a value with the forms (place, form, chain) found in it; (None, None) if it is sound.

    The chain whose forms cover most characters wins, ties by name. Its forms must cover three characters, or all of
    a stretch, with an unusual one among them. Lost characters beside covered ones belong to the stretch.
    """
    best: tuple[int, str, list[bool]] | None = None
    for chain in sorted({c for _, _, c in found}):
        covered = [False] * len(text)
        for at, form, c in found:
            if c == chain:
                covered[at : at + len(form)] = [True] * len(form)
        n = sum(covered)
        if best is None or n > best[0]:
            best = n, chain, covered
    if best is None:
        return None, None
    n, chain, covered = best
    rare = sum(c and t not in usual() for c, t in zip(covered, text))
    whole = any(all(covered[m.start() : m.end()]) for m in _RUN.finditer(text))
    if not rare or (n < 3 and not whole):
        return None, None
    out, at = "", 0
    whole_text = restore(text, CHAINS[chain])
    if whole_text is not None and whole_text != text:
        return chain, whole_text
    for lo, hi in _covered_spans(text, covered):
        back = restore(text[lo:hi], CHAINS[chain])
        if back is None:
            return chain, None
        out += text[at:lo] + back
        at = hi
    return chain, out + text[at:]


def _covered_spans(text: str, covered: list[bool]) -> list[tuple[int, int]]:
    """Covered stretches, joined with what lies between and beside them as far as it is unusual."""
    strange = [c or (ord(t) > 127 and t not in usual()) for c, t in zip(covered, text)]
    out: list[tuple[int, int]] = []
    for m in re.finditer("1+", "".join("01"[s] for s in strange)):
        if any(covered[m.start() : m.end()]):
            out.append(m.span())
    return out


def garbled_values(values: DataFrame) -> DataFrame:
    """key, field, text, chain, original of every garbled value.

    ``values``: key (long), field, text. ``original`` is null where it cannot be recovered. Null, empty and ASCII
    values are sound; values without a key are left out; repeated rows count once; an empty table gives no rows; other columns are ignored. Rare but right
    characters are no form of a clean word and so stay sound. Words, forms and tokens are spread over the cluster;
    each is made distinct before it is joined, and a token joins at most one form per word and chain.
    """
    # work in Python is dealt out by number: adaptive plans would put small inputs into one or two tasks
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = values.where("key is not null and text is not null and text rlike '[^\\\\x00-\\\\x7f]'").select("key", "field", "text").distinct().repartition(tasks).withColumn("odd", _unusual(F.col("text")))

    def words(batches):
        for pdf in batches:
            found: set[str] = set().union(*map(words_of, pdf["text"]))
            yield pd.DataFrame({"word": sorted(found)}, dtype="object")

    def forms(batches):
        for pdf in batches:
            rows = [(f, c) for w in pdf["word"] for f, c in forms_of(w)]
            yield pd.DataFrame(rows, columns=["form", "chain"], dtype="object").drop_duplicates()

    spark = values.sparkSession
    clean = marked.where("not odd").select("text").mapInPandas(words, "word string").unionByName(spark.createDataFrame([(c,) for c in OTHER_WORDS], "word string")).distinct()
    table = clean.repartition(tasks).mapInPandas(forms, "form string, chain string").distinct()
    longest = max(len(f) for w in ("啊啊", "，。") for f, _ in forms_of(w)) + 6

    def tokens(batches):
        known = usual()
        for pdf in batches:
            rows = []
            for k, f, t in zip(pdf["key"], pdf["field"], pdf["text"]):
                if len(rows) > 100_000:
                    yield tokens_of(rows)
                    rows = []
                strange = [c not in known for c in t]
                for lo in range(len(t) - 1):
                    seen = False
                    for hi in range(lo + 1, min(len(t), lo + longest) + 1):
                        seen = seen or strange[hi - 1]
                        if hi - lo >= 2 and seen and (t[lo] > "\x7f"):
                            rows.append((k, f, lo, t[lo:hi]))
                rows += [(k, f, m.start(), m[0]) for m in _RUN.finditer(t) if len(m[0]) > longest]
            yield tokens_of(rows)

    def tokens_of(rows):
        return pd.DataFrame(rows, columns=["key", "field", "place", "form"]).astype({"key": "int64", "place": "int32", "field": "object", "form": "object"})

    odd = marked.where("odd").select("key", "field", "text")
    hits = odd.mapInPandas(tokens, "key long, field string, place int, form string").join(table, "form")
    per_value = hits.groupBy("key", "field").agg(F.collect_list(F.struct("place", "form", "chain")).alias("found"))

    @F.pandas_udf("struct<chain string, original string>")
    def verdict(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, [(h["place"], h["form"], h["chain"]) for h in hs]) for t, hs in zip(texts, found)], columns=["chain", "original"], dtype="object")

    # a key may hold several texts in different deliveries: each is judged by the forms that lie at their places in it
    return odd.join(per_value, ["key", "field"]).withColumn("v", verdict("text", "found")).select("key", "field", "text", "v.*").where("chain is not null")
