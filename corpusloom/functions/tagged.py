"""Inline-tagged text ``<▪name>text</▪name>`` and token labels.

An item is a struct (text, name); name is null outside tags. Tags do not nest. Empty tags vanish.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PUNC_RUN, characters

SIGN = "▪"
_OPEN, _CLOSE = f"<{SIGN}", f"</{SIGN}"
#: A tagged stretch or a stretch without tags.
_ITEM = f"(?s)<{SIGN}([^>]+)>(.*?)</{SIGN}\\1>|((?:(?!</?{SIGN}).)+)"
_ITEMS = "array<struct<text:string,name:string>>"


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def to_items(c: Column) -> Column:
    """Items of a tagged text, in order; null where tags are broken or the text is null."""
    names = F.regexp_extract_all(c, F.lit(_ITEM), F.lit(1))
    inner = F.regexp_extract_all(c, F.lit(_ITEM), F.lit(2))
    plain = F.regexp_extract_all(c, F.lit(_ITEM), F.lit(3))
    z = F.arrays_zip(names.alias("n"), inner.alias("i"), plain.alias("p"))
    items = F.transform(z, lambda x: F.struct(F.when(x["n"] != "", x["i"]).otherwise(x["p"]).alias("text"), F.when(x["n"] != "", x["n"]).alias("name")))
    return F.when(is_valid(c), F.filter(items, lambda x: x["text"] != "")).cast(_ITEMS)


def from_items(items: Column) -> Column:
    """Tagged text of items."""
    return F.array_join(F.transform(items, lambda x: F.when(x["name"].isNull(), x["text"]).otherwise(F.concat(F.lit(_OPEN), x["name"], F.lit(">"), x["text"], F.lit(_CLOSE), x["name"], F.lit(">")))), "")


def is_valid(c: Column) -> Column:
    """Whether every sign belongs to a matching pair of tags; null for null."""
    pairs = F.regexp_count(c, F.lit(f"(?s)<{SIGN}([^>]+)>(?:(?!</?{SIGN}).)*?</{SIGN}\\1>"))
    return F.when(c.isNotNull(), F.regexp_count(c, F.lit(SIGN)) == pairs * 2)


def plain_text(c: Column) -> Column:
    """Text without its tags."""
    return F.regexp_replace(c, f"</?{SIGN}[^>]+>", "")


def names(c: Column) -> Column:
    """Names of the opening tags, in order, with repeats."""
    return F.regexp_extract_all(c, F.lit(f"<{SIGN}([^>]+)>"), F.lit(1))


def to_iob(items: Column) -> Column:
    """Characters with their B-/I-/O label: array of (token, tag)."""
    def one(x: Column) -> Column:
        ch = characters(x["text"])
        return F.transform(ch, lambda t, i: F.struct(t.alias("token"), F.when(x["name"].isNull(), F.lit("O")).when(i == 0, F.concat(F.lit("B-"), x["name"])).otherwise(F.concat(F.lit("I-"), x["name"])).alias("tag")))

    return F.flatten(F.transform(items, one))


_SPAN = "\u0001([^\u0002]*)\u0002([^\u0001\u0003]*)|\u0003([^\u0001\u0003]+)"


def from_iob(pairs: Column) -> Column:
    """Items of labelled characters: B- opens, I- goes on with the open item whatever its own label, a stray I- is plain.

    One pass writes the tokens with control signs where an item begins; the signs U+0001 to U+0003 must
    not be tokens themselves.
    """
    def step(acc: Column, x: Column) -> Column:
        opens = x["tag"].startswith("B-")
        goes = x["tag"].startswith("I-") & acc["open"]
        begins = F.concat(F.lit("\u0001"), F.substring(x["tag"], 3, 1000), F.lit("\u0002"), x["token"])
        plain = F.when(acc["open"] | (acc["out"] == ""), F.concat(F.lit("\u0003"), x["token"])).otherwise(x["token"])
        return F.struct(F.concat(acc["out"], F.when(opens, begins).when(goes, x["token"]).otherwise(plain)).alias("out"), (opens | goes).alias("open"))

    empty = F.struct(F.lit("").alias("out"), F.lit(False).alias("open"))
    signed = F.aggregate(pairs, empty, step)["out"]

    def parts(c: Column) -> Column:
        got = [F.regexp_extract_all(c, F.lit(_SPAN), F.lit(k)).alias(n) for k, n in ((1, "n"), (2, "t"), (3, "p"))]
        return F.transform(F.arrays_zip(*got), lambda x: F.struct(F.when(x["p"] != "", x["p"]).otherwise(x["t"]).alias("text"), F.when(x["p"] == "", x["n"]).alias("name"))).cast(_ITEMS)

    return let(signed, parts)


def relabel(c: Column, mapping: dict[str, str], keep_unmapped: bool = True) -> Column:
    """Tags renamed by a map; others kept, or unwrapped."""
    for a, b in mapping.items():
        c = F.regexp_replace(c, f"(</?{SIGN}){a}>", f"$1\u0001{b}>")
    if not keep_unmapped:
        c = F.regexp_replace(c, f"</?{SIGN}[^>\u0001]+>", "")
    return F.replace(c, F.lit("\u0001"), F.lit(""))


def prefix_labels(c: Column, prefix: Column) -> Column:
    """Every label with a prefix and an underscore before it."""
    return F.regexp_replace(c, F.lit(f"(</?{SIGN})"), F.concat(F.lit("$1"), prefix, F.lit("_")))


def collapse_labels(c: Column, label: str = "other") -> Column:
    """All labels as one."""
    return F.regexp_replace(c, f"(</?{SIGN})[^>]+>", f"$1{label}>")


def wrap_punctuation(c: Column) -> Column:
    """Runs of punctuation wrapped as items named punc."""
    return F.regexp_replace(c, f"({PUNC_RUN}+)", f"<{SIGN}punc>$1</{SIGN}punc>")


def drop_punctuation(c: Column) -> Column:
    """Items named punc left out, text and all."""
    return F.regexp_replace(c, f"(?s)<{SIGN}punc>.+?</{SIGN}punc>", "")


def strip_inner_punctuation(items: Column) -> Column:
    """Items without the punctuation inside them; emptied items vanish."""
    out = F.transform(items, lambda x: F.struct(F.regexp_replace(x["text"], PUNC_RUN + "+", "").alias("text"), x["name"].alias("name")))
    return F.filter(out, lambda x: x["text"] != "")


def map_items(items: Column, fn) -> Column:
    """Apply a text function to each item's text; emptied items vanish."""
    return F.filter(F.transform(items, lambda x: F.struct(fn(x["text"]).alias("text"), x["name"].alias("name"))), lambda x: x["text"] != "")


#: One character and the punctuation after it.
_AFTER = f"(?s)((?!{PUNC_RUN}).)({PUNC_RUN}*)"


def punctuation_after(c: Column) -> Column:
    """Array of (token, mark): each character that is no punctuation with the run that follows it; leading punctuation is left out."""
    z = F.arrays_zip(F.regexp_extract_all(c, F.lit(_AFTER), F.lit(1)).alias("t"), F.regexp_extract_all(c, F.lit(_AFTER), F.lit(2)).alias("m"))
    return F.transform(z, lambda x: F.struct(x["t"].alias("token"), x["m"].alias("mark")))


def punctuation_iob(c: Column, labels: dict[str, str]) -> Column:
    """Array of (token, tag): B-label where a known run follows the character, else O."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map().cast("map<string,string>")
    return F.transform(punctuation_after(c), lambda x: F.struct(x["token"].alias("token"), F.coalesce(F.concat(F.lit("B-"), F.try_element_at(known, x["mark"])), F.lit("O")).alias("tag")))


def restore_punctuation(pairs: Column, marks: dict[str, str]) -> Column:
    """Text of labelled characters with the marks of their labels put back."""
    known = F.create_map(*[F.lit(x) for kv in marks.items() for x in kv])
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["token"], F.coalesce(F.try_element_at(known, F.substring(x["tag"], 3, 1000)), F.lit("")))), "")


def reduce_run(c: Column) -> Column:
    """A run of punctuation as one of , ? 。 by majority (ties: ? before 。 before ,); empty where none of them occurs."""
    q, e, m = F.regexp_count(c, F.lit("[?？]")), F.regexp_count(c, F.lit("[。.!！｡．]")), F.regexp_count(c, F.lit("[,，、;；:：·]"))
    return F.when(F.greatest(q, e, m) == 0, F.lit("")).when(q == F.greatest(q, e, m), F.lit("?")).when(e == F.greatest(e, m), F.lit("。")).otherwise(F.lit(","))


def reduce_punctuation(c: Column) -> Column:
    """Plain text with every run of punctuation reduced; leading punctuation goes."""
    return F.array_join(F.transform(punctuation_after(c), lambda x: F.concat(x["token"], reduce_run(x["mark"]))), "")


def reduce_items(items: Column) -> Column:
    """Items named punc reduced; those with no mark left vanish."""
    out = F.transform(items, lambda x: F.struct(F.when(x["name"] == "punc", reduce_run(x["text"])).otherwise(x["text"]).alias("text"), x["name"].alias("name")))
    return F.filter(out, lambda x: x["text"] != "")


def transfer_punctuation(items: Column, text: Column) -> Column:
    """Items of a text without punctuation with the punctuation of ``text`` put in.

    ``text`` must hold the same characters; a run after the last character of an entity goes outside it.
    """
    return let(punctuation_after(text), lambda after: _transfer(items, text, after))


def _transfer(items: Column, text: Column, after: Column) -> Column:
    lead = F.regexp_extract(text, f"^{PUNC_RUN}+", 0)
    empty = F.expr(f"cast(struct(0 as n, cast(array() as {_ITEMS}) as out) as struct<n:int,out:{_ITEMS}>)")

    def step(acc: Column, x: Column) -> Column:
        size = F.length(x["text"])
        part = F.slice(after, acc["n"] + 1, size)
        body = F.array_join(F.transform(part, lambda y, i: F.concat(y["token"], F.when(i < size - 1, y["mark"]).otherwise(F.lit("")))), "")
        tail = F.coalesce(F.try_element_at(part, size)["mark"], F.lit(""))
        item = lambda t, n: F.struct(t.alias("text"), n.cast("string").alias("name"))
        return F.struct((acc["n"] + size).cast("int").alias("n"), F.concat(acc["out"], F.array(item(body, x["name"]), item(tail, F.lit(None)))).alias("out"))

    out = F.aggregate(items, empty, step)["out"]
    first = F.array(F.struct(lead.alias("text"), F.lit(None).cast("string").alias("name")))
    return F.filter(F.concat(first, out), lambda x: x["text"] != "")


def encode_labels(pairs: Column, ids: dict[str, int]) -> Column:
    """Label ids of the tags; unknown tags are null."""
    known = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    return F.transform(pairs, lambda x: F.try_element_at(known, x["tag"]))


def decode_labels(ids: Column, labels: list[str]) -> Column:
    """Tags of label ids."""
    arr = F.array(*[F.lit(x) for x in labels])
    return F.transform(ids, lambda i: F.try_element_at(arr, i + 1))


def spans_to_items(text: Column, spans: Column) -> Column:
    """Items of a text with (start, end, tag) spans that do not overlap, sorted by start; empty spans vanish."""
    s = F.array_sort(spans)
    empty = F.expr(f"cast(struct(0 as n, cast(array() as {_ITEMS}) as out) as struct<n:int,out:{_ITEMS}>)")
    item = lambda t, n: F.struct(t.alias("text"), n.cast("string").alias("name"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["n"] + 1, x["start"] - acc["n"])
        body = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        return F.struct(x["end"].cast("int").alias("n"), F.concat(acc["out"], F.array(item(gap, F.lit(None)), item(body, x["tag"]))).alias("out"))

    done = F.aggregate(s, empty, step)
    tail = F.array(item(F.substring(text, done["n"] + 1, F.length(text)), F.lit(None)))
    return F.filter(F.concat(done["out"], tail), lambda x: x["text"] != "")


def tag_census(c: Column, tags: list[str]) -> Column:
    """Which of the tag names open somewhere in a marked-up text, in the given order."""
    arr = F.array(*[F.when(c.rlike(f"<{t}[\\s>/]"), F.lit(t)) for t in tags])
    return F.filter(arr, lambda x: x.isNotNull())
