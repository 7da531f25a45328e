"""Problem 2: one form for texts that look the same but are stored in different characters.

Each token (a run of letters, marks and digits) gets the intersection of the resolved script sets of
its letters. An empty intersection is a mixed-script token: it is rewritten in Latin where every
foreign letter has a Latin look-alike, else in the script with the most letters of its own that can
spell it. A token of one script whose letters all have a Latin look-alike is a whole-script
confusable and is rewritten in Latin. What remains is normalised: width, font, small and radical forms, composition, blanks,
invisible marks and the project's own replacement list, closed over chains and cycles.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Look-alikes of Latin letters, by script. Left: the letter; right: Latin.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝѵӏАВЕЗКМНОРСТХУІЈЅҮԌԛԜѴӀ", "aeopcyxijshdqwvlABE3KMHOPCTXYIJSYGqWVI", strict=True))
CYRILLIC.pop("З")
GREEK = dict(zip("οναιρυγκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹͿ", "ovaipuykABEZHIKMNOPTYXcjCJ", strict=True))
for _x in "αικυγ":
    GREEK.pop(_x)
GREEK |= {"ν": "v", "ι": "i"}
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U"}
LATIN = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʋ": "u", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
CHEROKEE = dict(zip("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦᏧ", "DRTiAJEWMHYGZbRWVSLCPKd", strict=True))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲭ", "HIKMNOoPpCcTYXx", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
# Kana that look like Han characters.
KANA = {"ニ": "二", "ハ": "八", "ロ": "口", "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ー": "一", "へ": "へ"}
KANA.pop("へ")
# Radical supplement forms without a decomposition.
RADICAL = dict(zip("⺄⺌⺍⺕⺗⺝⺟⺠⺩⺪⺫⺬⺮⺷⺹⺼⻁⻄⻅⻆⻑⻘⻝⻤", "乙小小彐心月母民王疋罒示竹羊耂肉虎西见角長青食鬼", strict=True))
# Marks that cannot be told apart, each group with the kept mark first.
MARKS = ["··・ㆍ･∙⋅‧•ᆞ", "--‐‑–−﹣－⁃‒˗", "''’‘ʼ＇′`´ˈʹ", '""“”„‟＂〃″', "::：∶ː꞉", "//／⁄∕", "~~～∼〜˜", "〈〈〈⟨", "〉〉〉⟩", "。。｡", "||｜∣ǀ", ",,，‚", "**＊∗", "○○◯"]
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￻\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_KINDS = {"<wide>", "<narrow>", "<font>", "<small>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}
_EAST = frozenset({"Hani", "Hira", "Kana", "Hang", "Bopo"})
_RESOLVED = {"HAN": frozenset({"Hani", "Jpan", "Kore", "Hanb"}), "HIR": frozenset({"Hira", "Jpan"}), "KAT": frozenset({"Kana", "Jpan"}), "HAG": frozenset({"Hang", "Kore"})}


def _form(ch: str) -> str:
    """One character in its plain form: width, font, radical and mark forms undone."""
    if ch in RADICAL:
        return RADICAL[ch]
    if ch in _TO_LATIN:  # lunate sigma and others: a look-alike goes before a compatibility form
        return ch
    if ch in "…‥":
        return "..." if ch == "…" else ".."
    kind = unicodedata.category(ch)
    if kind == "Zs" or ch == "\t":
        return " "
    d = unicodedata.decomposition(ch)
    tag = d.split(" ", 1)[0] if d.startswith("<") else ""
    if tag in _KINDS:
        out = unicodedata.normalize("NFKC", ch)
        if len(out) == 1 or tag not in ("<compat>",):
            return out
    return ch


class _Table(dict):
    """translate() table of plain forms, filled on demand."""

    def __init__(self, extra: dict[str, str] | None = None):
        super().__init__()
        extra = extra or {}
        self.extra = {a: b for a, b in extra.items() if len(a) == 1}
        self.runs = {a: b for a, b in extra.items() if len(a) > 1}
        self.run = re.compile("|".join(map(re.escape, sorted(self.runs, key=lambda a: (-len(a), a))))) if self.runs else None
        self.ascii = any(a.isascii() for a in extra)

    def __missing__(self, cp: int):
        ch = _form(chr(cp))
        chain: list[str] = []
        while ch not in chain:
            chain.append(ch)
            nxt = _MARK.get(ch) or self.extra.get(ch)
            if nxt is None or nxt == ch:
                break
            ch = _form(nxt) if len(nxt) == 1 else nxt
        else:  # a cycle: all its members take its least form
            ch = min(chain[chain.index(ch) :])
        self[cp] = ch
        return ch


_MARK = {c: g[0] for g in MARKS for c in g[1:] if c != g[0]}


def _script(ch: str) -> frozenset | None:
    """Resolved script set of a letter; None for what every script shares."""
    cp = ord(ch)
    if cp < 0x250 or ch in LATIN or 0x1E00 <= cp < 0x1F00:
        return frozenset({"Latn"}) if ch.isalpha() else None
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return frozenset({"Grek"}) if ch.isalpha() else None
    if 0x400 <= cp < 0x530:
        return frozenset({"Cyrl"})
    if 0x530 <= cp < 0x590:
        return frozenset({"Armn"})
    if 0x13A0 <= cp < 0x1400 or 0xAB70 <= cp < 0xABC0:
        return frozenset({"Cher"})
    if 0x2C80 <= cp < 0x2D00:
        return frozenset({"Copt"}) if ch.isalpha() else None
    if 0xA4D0 <= cp < 0xA4F8:
        return frozenset({"Lisu"})
    if 0x3040 <= cp < 0x30A0:
        return _RESOLVED["HIR"]
    if 0x30A0 <= cp < 0x3100:
        return _RESOLVED["KAT"]
    if 0xAC00 <= cp < 0xD7B0 or 0x1100 <= cp < 0x1200 or 0x3130 <= cp < 0x3190:
        return _RESOLVED["HAG"]
    if 0x3400 <= cp < 0xA000 or 0xF900 <= cp < 0xFB00 or cp >= 0x20000:
        return _RESOLVED["HAN"]
    return None


_TO_LATIN = CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC | LISU | LATIN
_FROM_LATIN = {"Cyrl": {v: k for k, v in CYRILLIC.items()}, "Grek": {v: k for k, v in GREEK.items()}, "Armn": {v: k for k, v in ARMENIAN.items()}, "Cher": {v: k for k, v in CHEROKEE.items()}, "Copt": {v: k for k, v in COPTIC.items()}, "Lisu": {v: k for k, v in LISU.items()}}
#: Only tokens with one of these letters can be confusable.
_SUSPECT = re.compile("[ɑɡıɩʋᴄᴏᴠ-ᴢꜱͰ-֏ἀ-῿Ꭰ-ᏽⲀ-⳿ꓐ-ꓷ]|[" + "".join(KANA) + "]")
_TOKEN = re.compile(r"\w+")


def _token(tok: str) -> str:
    """One token in the script that can spell it."""
    if not _SUSPECT.search(tok):
        return tok
    sets = [(c, s) for c in tok if (s := _script(c)) is not None]
    kana = [c for c, s in sets if s is _RESOLVED["KAT"] or c == "ー"]
    if kana and all(c in KANA for c in kana) and any(s is _RESOLVED["HAN"] for _, s in sets) and not any(s is _RESOLVED["HIR"] for _, s in sets):
        return "".join(KANA.get(c, c) for c in tok)
    west = [(c, s) for c, s in sets if not (s & {"Jpan", "Kore", "Hanb", "Hang"})]
    if not west:
        return tok
    shared = frozenset.intersection(*[s for _, s in west])
    if shared == {"Latn"} and not any(c in LATIN for c, _ in west):
        return tok
    # Latin first: it spells the token if each foreign letter has a Latin look-alike (mixed or whole-script).
    if all(s == {"Latn"} or c in _TO_LATIN for c, s in west):
        return "".join(_TO_LATIN.get(c, c) for c in tok)
    if not shared:  # mixed, and some letter exists only in another script: that script takes the look-alikes
        own: dict[str, int] = {}
        for c, s in west:
            if c not in _TO_LATIN and s != {"Latn"}:
                own[next(iter(s))] = own.get(next(iter(s)), 0) + 1
        for name in sorted(own, key=lambda n: (-own[n], n)):
            back = _FROM_LATIN.get(name, {})
            out = [c if s is None or name in s else back.get(_TO_LATIN.get(c, c)) for c, s in ((c, _script(c)) for c in tok)]
            if None not in out:
                return "".join(out)
    return tok


def plain_form(text: str, forms: _Table) -> str:
    """The one form of ``text``: equal results look the same.

    Entries of the list with several characters are replaced first, the longest at each place.
    """
    if forms.run is not None:
        text = forms.run.sub(lambda m: forms.runs[m.group()], text)
    if text.isascii() and not forms.ascii:
        return text.translate(forms) if "`" in text or "\t" in text or "\r" in text else text
    t = INVISIBLE.sub("", text).replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace(" ", "\n")
    t = unicodedata.normalize("NFC", t).translate(forms)
    t = unicodedata.normalize("NFC", t).translate(forms)
    if _SUSPECT.search(t):
        t = _TOKEN.sub(lambda m: _token(m.group()), t)
    return t


def replacement_list(unicode_map: DataFrame, most: int = 20_000) -> dict[str, str]:
    """src -> tgt of the project's list: nulls, blanks and rows that change nothing left out.

    The list is one of characters and short runs; ``most`` is checked. Empty sources are left out. Of several targets for one src the first in code order is taken.
    """
    rows = unicode_map.where("src is not null and tgt is not null and src <> tgt").groupBy("src").agg(F.min("tgt").alias("tgt")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the replacement list is no character list")
    return {r[0]: r[1] for r in rows if r[0]}


def plain_column(col: Column, extra: dict[str, str]) -> Column:
    """Column of plain forms; null stays null, blank texts are kept as they are but for their forms."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forms = _Table(extra)
        for s in batches:
            yield pd.Series([None if x is None else plain_form(x, forms) for x in s], dtype=object)

    return run(col)


def consistent_text(df: DataFrame, text: str, unicode_map: DataFrame, out: str = "plain") -> DataFrame:
    """``df`` with the consistent form of column ``text`` as column ``out``. Null texts stay null."""
    return df.withColumn(out, plain_column(F.col(text), replacement_list(unicode_map)))


def _forms(df: DataFrame, key: str, text: str, unicode_map: DataFrame) -> DataFrame:
    """(id, form, raw): digests of the consistent form and of the text as it stands."""
    d = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))
    p = consistent_text(d, "t", unicode_map).where(F.length(F.trim("plain")) > 0)
    return p.select("id", F.unhex(F.md5("plain")).alias("form"), F.unhex(F.md5("t")).alias("raw"))


def lookalike_classes(df: DataFrame, key: str, text: str, unicode_map: DataFrame) -> DataFrame:
    """(id, class_id, spelling_id, spellings): rows whose form has two or more spellings.

    class_id is the least id of the form, spelling_id the least id of the very same string, spellings
    their number; so a class of any size costs one row for each of its rows. Null texts, null ids and
    texts in which nothing visible is left are in no class.
    """
    h = _forms(df, key, text, unicode_map)
    spelt = h.groupBy("form", "raw").agg(F.min("id").alias("spelling_id"))
    forms = spelt.groupBy("form").agg(F.min("spelling_id").alias("class_id"), F.count(F.lit(1)).alias("spellings")).where("spellings > 1")
    return h.join(spelt, ["form", "raw"]).join(forms, "form").select("id", "class_id", "spelling_id", "spellings")


def lookalikes(df: DataFrame, key: str, text: str, unicode_map: DataFrame, part: int = 2000) -> DataFrame:
    """(rec_id_a, rec_id_b): rows whose texts look the same but differ as strings, smaller id first.

    Classes are found on 128-bit digests, so no long text is shuffled. Only forms with two or more
    spellings take part in the final join; rows of one spelling are never paired with each other. One
    side of a form is split into parts of about ``part`` rows, so a hot form is spread over many tasks.
    Null texts relate nothing; nor do null ids or texts in which nothing visible is left. The classes
    themselves come from :func:`lookalike_classes`.
    """
    h = _forms(df, key, text, unicode_map)
    several = h.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).where("lo <> hi").select("form", "parts")
    live = h.join(several, "form")
    a = live.select("form", F.col("id").alias("a"), F.col("raw").alias("ra"), F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    b = live.select("form", F.col("id").alias("b"), F.col("raw").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["form", "part"]).where("ra <> rb and a < b").select(F.col("a").alias("rec_id_a"), F.col("b").alias("rec_id_b"))
