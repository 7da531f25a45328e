"""String, regex and array functions as Spark columns. A null text gives null unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Python's Unicode white space, written so that Java and RE2 agree on it.
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
#: Punctuation, separators, bar, line feed and tab.
PUNC = r"[\p{P}\p{Z}|\n\t]"
#: The same without the signs that do not punctuate.
PUNC_RUN = r"[\p{P}\p{Z}|\n\t&&[^【】〔〕#&@※]]"
#: Hangul: syllables, jamo of all blocks, half-width forms and enclosed forms.
HANGUL = "[\\x{AC00}-\\x{D7A3}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{A960}-\\x{A97F}\\x{D7B0}-\\x{D7FF}\\x{3200}-\\x{321E}\\x{FFA0}-\\x{FFDC}]"


def squeeze_blanks(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def remove_blanks(c: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(c, WS + "+", "")


def blank_to_null(c: Column) -> Column:
    """Null where the text holds nothing but white space."""
    return F.when(~c.rlike(f"^{WS}*$"), c)


def has_punctuation(c: Column) -> Column:
    """Whether any punctuation stands in the text; null counts as none."""
    return F.coalesce(c.rlike(PUNC), F.lit(False))


def remove_punctuation(c: Column) -> Column:
    """Text without punctuation, separators, bars, line feeds and tabs."""
    return F.regexp_replace(c, PUNC + "+", "")


def remove_characters(c: Column, chars: str) -> Column:
    """Text without the listed characters."""
    return F.translate(c, chars, "")


def runs(c: Column, cls: str) -> Column:
    """Maximal runs inside and outside a character class, in order."""
    neg = f"[^{cls[1:]}" if not cls.startswith("[^") else f"[{cls[2:]}"
    return F.regexp_extract_all(c, F.lit(f"({cls}+|{neg}+)"), F.lit(1))


def punctuation_runs(c: Column) -> Column:
    """Maximal runs of punctuation."""
    return F.regexp_extract_all(c, F.lit(PUNC_RUN + "+"), F.lit(0))


def characters(c: Column) -> Column:
    """Code points of the text, in order."""
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def char_ngrams(c: Column, n: int) -> Column:
    """Overlapping n-grams of code points; none for texts shorter than n."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))


def is_hangul(c: Column) -> Column:
    """Whether any Hangul character stands in the text."""
    return c.rlike(HANGUL)


def class_share(c: Column, cls: str) -> Column:
    """Share of the characters that belong to a class; null for empty texts."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, f"[^{cls[1:-1]}]", "")) / F.length(c))


def keep_han_like(c: Column, also: str = "〇") -> Column:
    """Whether a character is neither control, mark, digit, Latin case letter, punctuation, symbol nor separator."""
    out = r"[\p{Cc}\p{Cf}\p{Lu}\p{Ll}\p{Lm}\p{Mn}\p{Nd}\p{No}\p{P}\p{S}\p{Z}]"
    return ~c.rlike(out) | c.isin(list(also))


def contains_multiset(c: Column, part: Column) -> Column:
    """Whether every character of ``part`` stands in ``c`` at least as often."""
    ch = F.array_distinct(characters(part))
    times = lambda t, x: F.length(t) - F.length(F.replace(t, x, F.lit("")))
    return F.forall(ch, lambda x: times(part, x) <= times(c, x))


def last_part(c: Column, sep: str) -> Column:
    """What follows the last separator; the whole text where there is none."""
    return F.element_at(F.split(c, sep, -1), -1)


def parent_id(c: Column) -> Column:
    """Id without its last underscore part."""
    return F.regexp_replace(c, "_[^_]*$", "")


def strip_lead(c: Column, pattern: str) -> Column:
    """Text without the leading numbering or marker the pattern describes."""
    return F.regexp_replace(c, "^(?:" + pattern + ")", "")


def truncate_words(c: Column, n: int) -> Column:
    """The first n blank-separated words, joined with single blanks."""
    return F.array_join(F.slice(F.split(squeeze_blanks(c), " "), 1, n), " ")


def query_value(c: Column, key: str) -> Column:
    """Decoded value of a query-string key; null where it is missing."""
    return F.url_decode(F.parse_url(c, F.lit("QUERY"), F.lit(key)))


def words_of_number(c: Column) -> Column:
    """Number in words of magnitude: 1.2 thousand, 3.4 million, below a thousand as it is."""
    n = c.cast("double")
    say = lambda unit, name: F.concat(F.format_string("%.1f", n / unit), F.lit(" " + name))
    return F.when(n.isNull(), None).when(n < 1e3, c.cast("string")).when(n < 1e6, say(1e3, "thousand")).when(n < 1e9, say(1e6, "million")).when(n < 1e12, say(1e9, "billion")).otherwise(say(1e12, "trillion"))


def python_list(c: Column) -> Column:
    """Array of a list literal such as ['a', 'b']; null where it is none."""
    return F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>")


def escape_edges(c: Column, sign: str = "␣") -> Column:
    """Blanks at both ends made visible, inner text unchanged."""
    n = lambda p: F.length(F.regexp_extract(c, p, 0))
    return F.concat(F.repeat(F.lit(sign), n("^ +")), F.trim(c), F.when(F.length(F.trim(c)) > 0, F.repeat(F.lit(sign), n(" +$"))).otherwise(F.lit("")))


def _category(ch: str | None) -> str | None:
    return None if not ch else unicodedata.category(ch[0])


def unicode_category(c: Column) -> Column:
    """General category of the first character; Spark has no native function, so Arrow batches of distinct characters."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        for s in batches:
            for x in s.unique():
                seen.setdefault(x, _category(x))
            yield s.map(seen)

    return run(c)


def character_names(c: Column) -> Column:
    """Unicode names of all characters of a label, joined with underscores."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "_".join(unicodedata.name(x, "UNKNOWN").title().replace(" ", "") for x in t))

    return run(c)


def map_distinct(df: DataFrame, col: str, fn: Column, out: str) -> DataFrame:
    """Apply a costly column to the distinct values once and join the result back (null stays null)."""
    d = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn(out, fn)
    return df.join(d, col, "left")
