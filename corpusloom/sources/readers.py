"""Readers and writers by file type, line formats, audited writes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def file_type(path: str) -> str:
    """Type by the last suffix, compression suffixes aside."""
    name = re.sub(r"\.(zst|zstd|gz|bz2)$", "", path.rstrip("/").rsplit("/", 1)[-1])
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, JSON lines, a JSON array, CSV or TSV (with or without byte-order mark), or plain text."""
    kind = file_type(path)
    r = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return r.parquet(path)
    if kind == "jsonl":
        return r.json(path)
    if kind == "json":
        return r.option("multiLine", True).json(path)
    if kind in ("csv", "tsv"):
        df = r.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).option("escape", '"').csv(path)
        return df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if kind in ("txt", "text"):
        return spark.read.text(path)
    raise ValueError(f"no reader for {path}")


def write_any(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write by suffix; Parquet is compressed with zstd, JSON and CSV keep non-ASCII characters."""
    w, kind = df.write.mode(mode), file_type(path)
    if kind == "parquet":
        w.option("compression", "zstd").parquet(path)
    elif kind == "jsonl":
        w.option("ignoreNullFields", False).json(path)
    elif kind in ("csv", "tsv"):
        w.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("escape", '"').csv(path)
    elif kind in ("txt", "text"):
        w.text(path)
    else:
        raise ValueError(f"no writer for {path}")


def write_audited(df: DataFrame, path: str, mode: str = "errorifexists") -> dict:
    """Write and report rows and an order-free checksum, observed during the write itself."""
    o = Observation()
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    write_any(df.observe(o, F.count(F.lit(1)).alias("rows"), F.sum(F.pmod(digest, F.lit(1 << 31))).alias("checksum")), path, mode)
    return o.get


def sample_sidecar(df: DataFrame, key: str, n: int = 100, seed: int = 42) -> DataFrame:
    """The n rows with the least hashes, in order of key: the deterministic sample beside a table."""
    return df.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")), 256), key).limit(n).orderBy(key)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file one record."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def interleaved_pairs(lines: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, row_idx, src, tgt) of texts whose odd lines are source and even lines target."""
    x = lines.select(doc, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    g = x.groupBy(doc, F.floor(F.col("pos") / 2).alias("row_idx"))
    return g.agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("line"))).alias("src"), F.max(F.when(F.col("pos") % 2 == 1, F.col("line"))).alias("tgt"))


def tab_pairs(lines: DataFrame, text: str) -> DataFrame:
    """(text, label) of lines with one tab; lines without a tab have a null label."""
    p = F.split(text, "\t", 2)
    return lines.select(F.element_at(p, 1).alias("text"), F.try_element_at(p, F.lit(2)).alias("label"))


def partitioned_jsonl(df: DataFrame, path: str, by: str = "split") -> None:
    """One folder of JSON lines per value."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def parallel_lines(df: DataFrame, src: str, tgt: str, lang_src: str, lang_tgt: str, split: str, key: str) -> DataFrame:
    """(split, direction, side, key, line): line files of both directions as one table, white space squeezed."""
    sq = lambda c: F.trim(F.regexp_replace(c, r"[\s\p{Z}\x0b\x1c-\x1f\x85]+", " "))
    d = df.where(F.col(src).isNotNull() & F.col(tgt).isNotNull())
    one = lambda a, b: F.concat(F.col(a), F.lit("-"), F.col(b))
    rows = F.array(*[F.struct(one(a, b).alias("direction"), F.lit(s).alias("side"), sq(F.col(t)).alias("line")) for a, b, x, y in ((lang_src, lang_tgt, src, tgt), (lang_tgt, lang_src, tgt, src)) for s, t in (("src", x), ("tgt", y))])
    return d.select(F.col(split).alias("split"), F.col(key).alias("key"), F.explode(rows).alias("r")).select("split", "r.direction", "r.side", "key", "r.line").where("direction is not null")


def nested_counts_json(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: counts as a JSON object with keys "a-b-c", sorted (a report: one entry per group)."""
    e = F.array_sort(F.collect_list(F.struct(F.concat_ws("-", *keys).alias("key"), F.col(value).alias("value"))))
    return df.agg(F.to_json(F.map_from_entries(e)).alias("json"))
