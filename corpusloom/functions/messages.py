"""Dates written in words and chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the language codes used in prompts.
LANGUAGES = {"hj": "Hanja", "cc": "Classical Chinese", "ko": "Korean", "oko": "Old Korean", "zh": "Chinese", "en": "English", "ja": "Japanese"}

_LUNAR = r"^\s*(\S+?)\s*(\d+)년\s*(?:(윤)\s*)?(\d{1,2})월\s*(?:\(윤(\d)\)\s*)?_?\s*(?:(\d{1,2})일)?"


def lunar_date(c: Column) -> Column:
    """Date id ``king_year년_MM월(윤b)_DD일`` of a lunar date in words; an unknown day is ``??``; null where it is no date."""
    t = F.regexp_replace(c, "_", " ")
    part = lambda k: F.nullif(F.regexp_extract(t, _LUNAR, k), F.lit(""))
    leap = F.when(part(3).isNotNull(), F.lit("1")).otherwise(F.coalesce(part(5), F.lit("0")))
    return F.concat(part(1), F.lit("_"), part(2), F.lit("년_"), F.lpad(part(4), 2, "0"), F.lit("월(윤"), leap, F.lit(")_"), F.coalesce(F.lpad(part(6), 2, "0"), F.lit("??")), F.lit("일"))


def solar_like_id(c: Column) -> Column:
    """Date id ``YYYY-MM-b-DD`` of ``1623년 윤3월 5일`` and the like; null where a part is missing."""
    p = r"(\d{3,})년\s*(윤)?\s*(\d{1,2})월\s*(\d{1,2})일"
    part = lambda k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    return F.concat(F.lpad(part(1), 4, "0"), F.lit("-"), F.lpad(part(3), 2, "0"), F.lit("-"), F.when(part(2).isNull(), "0").otherwise("1"), F.lit("-"), F.lpad(part(4), 2, "0"))


def year(c: Column) -> Column:
    """Year of three or more digits before 년; null where there is none."""
    return F.nullif(F.regexp_extract(c, r"(\d{3,})년", 1), F.lit("")).cast("int")


def _language(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def translation_messages(src: Column, tgt: Column, lang_src: Column, lang_tgt: Column) -> Column:
    """Chat messages of a translation example as JSON: user asks, assistant answers."""
    ask = F.concat(F.lit("Translate the following text from "), _language(lang_src), F.lit(" into "), _language(lang_tgt), F.lit(".\n"), _language(lang_src), F.lit(": "), src, F.lit("\n"), _language(lang_tgt), F.lit(": "))
    msg = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when(ask.isNotNull() & tgt.isNotNull(), F.to_json(F.array(msg("user", ask), msg("assistant", tgt))))


def prompt_messages(src: Column, lang_src: Column, lang_tgt: Column, ref: Column | None = None, lang_ref: Column | None = None) -> Column:
    """Chat messages with the question alone as JSON; with a reference translation to go by where one is given."""
    a, b = _language(lang_src), _language(lang_tgt)
    if ref is None:
        ask = [F.lit("Translate the following text from "), a, F.lit(" into "), b, F.lit(".\n"), a, F.lit(": "), src]
    else:
        r = _language(lang_ref)
        ask = [F.lit("Translate the following text from "), a, F.lit(" into "), b, F.lit(", based on the reference translation in "), r, F.lit(".\n"), a, F.lit(": "), src, F.lit("\n"), r, F.lit(": "), ref]
    ask = F.concat(*ask, F.lit("\n"), b, F.lit(": "))
    return F.when(ask.isNotNull(), F.to_json(F.array(F.struct(F.lit("user").alias("role"), ask.alias("content")))))


def sharegpt_to_roles(c: Column) -> Column:
    """JSON list of from/value turns as JSON list of role/content turns."""
    m = F.create_map(F.lit("human"), F.lit("user"), F.lit("gpt"), F.lit("assistant"), F.lit("system"), F.lit("system"))
    turns = F.from_json(c, "array<struct<from:string,value:string>>")
    return F.to_json(F.transform(turns, lambda x: F.struct(F.coalesce(F.try_element_at(m, x["from"]), x["from"]).alias("role"), x["value"].alias("content"))))


def roles_to_sharegpt(c: Column) -> Column:
    """The inverse of :func:`sharegpt_to_roles`."""
    m = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    turns = F.from_json(c, "array<struct<role:string,content:string>>")
    return F.to_json(F.transform(turns, lambda x: F.struct(F.coalesce(F.try_element_at(m, x["role"]), x["role"]).alias("from"), x["content"].alias("value"))))


def chat_tokens(turns: Column, each: Column) -> Column:
    """Tokens of a chat: those of its turns, three for each turn and three for the answer."""
    return each + F.size(turns) * 3 + 3
