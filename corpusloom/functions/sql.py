"""The text functions as SQL functions: temporary SQL UDFs that Catalyst inlines, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_WS = r"[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]"
_P = r"[\\p{P}\\p{Z}|\\n\\t]"
FUNCTIONS = {
    "squeeze_blanks": ("t string", "string", f"trim(regexp_replace(t, '{_WS}+', ' '))"),
    "remove_blanks": ("t string", "string", f"regexp_replace(t, '{_WS}+', '')"),
    "blank_to_null": ("t string", "string", f"case when not t rlike '^{_WS}*$' then t end"),
    "remove_punctuation": ("t string", "string", f"regexp_replace(t, '{_P}+', '')"),
    "has_punctuation": ("t string", "boolean", f"coalesce(t rlike '{_P}', false)"),
    "parent_id": ("t string", "string", "regexp_replace(t, '_[^_]*$', '')"),
    "plain_text": ("t string", "string", "regexp_replace(t, '</?▪[^>]+>', '')"),
    "unit_hash": ("k string", "double", "cast(conv(substr(sha2(concat(k, '/42'), 256), 1, 13), 16, 10) as double) / 4503599627370496D"),
    "hash_split": ("k string", "string", "case when k is null then null when unit_hash(k) < 0.8 then 'train' when unit_hash(k) < 0.9 then 'valid' else 'test' end"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; the names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {kind} return {body}")
    return list(FUNCTIONS)
