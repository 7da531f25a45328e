"""Text normalisation: Korean and Japanese runs, CJK compatibility forms, punctuation, entry markers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze_blanks

_JAMO = r"[\x{1100}-\x{11FF}\x{3131}-\x{318E}\x{A960}-\x{A97C}\x{D7B0}-\x{D7FB}\x{FFA0}-\x{FFDC}]"
_KANA = r"[\x{FF65}-\x{FF9F}]"
# Marks that look alike, found and kept.
SIMILAR = {"‧": "·", "・": "·", "･": "·", "ㆍ": "·", "ᆞ": "·", "∙": "·", "⋅": "·", "‐": "-", "‑": "-", "–": "-", "—": "-", "―": "-", "−": "-", "“": '"', "”": '"', "‟": '"', "‘": "'", "’": "'", "∶": ":", "…": "..."}
# Radicals, variants and marks that no decomposition unifies, found and kept.
UNIFIED = dict([
    "‧·", "⺋㔾", "⺖忄", "⺘扌", "⺞歺", "⺡氵", "⺣灬", "⺤爫", "⺨犭", "⺩𤣩", "⺫罒", "⺭礻", "⺮𥫗", "⺯糹", "⺰纟", "⺲罒", "⺴⺳", "⺷𦍌", "⺼月", "⺾艹",
    "⻂衤", "⻃覀", "⻈讠", "⻊𧾷", "⻌辶", "⻏阝", "⻑長", "⻒镸", "⻔门", "⻖阝", "⻗雨", "ム厶", "㦳㘽", "䎛㖈", "内內", "呑吞", "尙尚", "岀出", "敻夐", "爲為",
    "耈耇", "蔿蒍", "説說", "飮飲", "龺𠦝", "︰：", "﹐，", "﹑、", "﹔；", "﹕：", "﹖？", "﹗！", "𠑗㒨", "𣔕𠓲", "𤈎㶷", "𤑕爋", "𤧩𤦼", "𧅄虁", "𧥙𣁀", "𧢮䚕",
])


def _singles(keep) -> tuple[str, str]:
    """Characters of the basic plane with a one-character compatibility form, as (found, kept) strings."""
    a, b = [], []
    for cp in (*range(0xA0, 0xD800), *range(0xF900, 0xFFF0), *range(0x2F800, 0x2FA20)):
        ch = chr(cp)
        if keep(cp, ch):
            out = unicodedata.normalize("NFKC", ch)
            if len(out) == 1 and out != ch:
                a.append(ch)
                b.append(out)
    return "".join(a), "".join(b)


#: CJK compatibility ideographs and radicals: Unicode's own decompositions and the fixed values.
CJK = tuple(a + b for a, b in zip(_singles(lambda cp, ch: 0xF900 <= cp < 0xFB00 or 0x2F00 <= cp < 0x2FE0 or cp >= 0x2F800 or cp in (0x2E9F, 0x2EF3, 0x3038)), ("".join(UNIFIED), "".join(UNIFIED.values())), strict=True))
#: Punctuation with a one-character compatibility form.
MARKS = _singles(lambda cp, ch: unicodedata.category(ch)[0] == "P")


def nfkc_runs(c: Column, cls: str) -> Column:
    """NFKC of the runs of a class only; texts without such characters never leave the JVM."""
    import re as _re

    pattern = _re.compile(_re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u%04X" % int(m[1], 16), cls) + "+")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else pattern.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t))

    return F.when(c.rlike(cls), run(F.when(c.rlike(cls), c))).otherwise(c)


def korean(c: Column) -> Column:
    """Jamo and half-width Hangul composed run by run."""
    return nfkc_runs(c, _JAMO)


def japanese(c: Column) -> Column:
    """Half-width kana and its marks composed run by run."""
    return nfkc_runs(c, _KANA)


def cjk(c: Column) -> Column:
    """Compatibility ideographs and radicals in their unified form."""
    return F.translate(c, *CJK)


def punctuation(c: Column) -> Column:
    """Punctuation in its plain form, look-alike marks unified, the ellipsis as three dots."""
    c = F.translate(c, *MARKS)
    ones = {a: b for a, b in SIMILAR.items() if len(b) == 1}
    c = F.translate(c, "".join(ones), "".join(ones.values()))
    for a, b in SIMILAR.items():
        if len(b) > 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize(c: Column, is_start: bool = True) -> Column:
    """The whole normalisation in its fixed order: blanks, Korean, Japanese, CJK, marks, entry marker, blanks."""
    c = punctuation(cjk(japanese(korean(squeeze_blanks(c)))))
    if is_start:
        c = F.regexp_replace(c, r"^○\s*", "")
    return squeeze_blanks(c)
