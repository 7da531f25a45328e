"""Text folding and blank handling shared by the training-data operators."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as Java regex; the set equals Python's ``\s``.
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"

# Written forms of one Chinese character, left to right: form found, form kept.
VARIANTS = {
    "為": "爲", "鎮": "鎭", "岩": "巖", "户": "戶", "戸": "戶", "啟": "啓", "畆": "畝", "畞": "畝", "既": "旣",
    "真": "眞", "值": "値", "値": "値", "温": "溫", "録": "錄", "录": "錄", "緑": "綠", "绿": "綠", "说": "說", "説": "說",
    "税": "稅", "脱": "脫", "悦": "悅", "鋭": "銳", "強": "强", "產": "産", "衞": "衛", "卫": "衛", "峯": "峰", "羣": "群",
    "裏": "裡", "線": "綫", "污": "汚", "汙": "汚", "踴": "踊", "髙": "高", "敎": "教", "靑": "青", "淸": "清", "歷": "歷",
    "暦": "曆", "歴": "歷", "舘": "館", "迹": "跡", "蹟": "跡", "猪": "猪", "豬": "猪", "黑": "黑", "黒": "黑", "冰": "氷",
    "竜": "龍", "楽": "樂", "滝": "瀧", "沢": "澤", "栄": "榮", "桜": "櫻", "斉": "齊", "来": "來", "黄": "黃", "横": "橫",
    "觀": "觀", "観": "觀", "顔": "顏", "倶": "俱", "麪": "麵", "寕": "寧", "甯": "寧", "寗": "寧", "塩": "鹽", "盬": "鹽",
    "鉄": "鐵", "銕": "鐵", "銭": "錢", "薬": "藥", "疎": "疏", "疏": "疏", "囬": "回", "囘": "回", "畧": "略", "崗": "岡",
    "鷄": "雞", "鶏": "雞", "亀": "龜", "囯": "國", "国": "國", "处": "處", "処": "處", "号": "號", "尔": "爾", "称": "稱",
}
VARIANTS = {a: b for a, b in VARIANTS.items() if a != b}


class _Fold(dict):
    """translate() table filled on demand: letters and digits stay in lower case, all else goes."""

    def __missing__(self, cp: int):
        ch = chr(cp)
        ch = VARIANTS.get(ch, ch)
        kind = unicodedata.category(ch)
        out = (VARIANTS.get(ch, ch).lower() if kind[0] in "LN" else None) if ch != "〇" else ch
        self[cp] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Letters and digits only, compatibility forms and case folded, character variants unified."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.translate(_FOLD)


def trim_blank(c: Column) -> Column:
    """Strip blanks of every kind from both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(c: Column) -> Column:
    """Null where nothing but blanks is left."""
    t = trim_blank(c)
    return F.when(F.length(t) > 0, t)


def source_name(c: Column) -> Column:
    """Corpus name without blanks around it, in lower case; blank gives null."""
    return F.lower(blank_to_null(c))


def bit_map(df: DataFrame, bits: int) -> np.ndarray:
    """Map of 2 ** bits bits as bytes, on where column ``bit`` says so; Spark joins the bits word by word."""
    words = df.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, bit & 63)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype="<i8")
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out.view(np.uint8)
