"""Filters, assertions and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_in(c: Column, values: list) -> Column:
    """Negated membership that keeps nulls."""
    return ~F.coalesce(c.isin(values), F.lit(False))


def presence_mismatch(a: Column, b: Column) -> Column:
    """Whether exactly one of two values is missing."""
    return a.isNull() != b.isNull()


def parts_within(c: Column, allowed: list[str], sep: str = "-") -> Column:
    """Whether all parts of a delimited value are allowed; null stays null."""
    return F.size(F.array_except(F.split(c, sep), F.array(*[F.lit(x) for x in allowed]))) == 0


def length_window(length: Column, most: int, least: int = 1, extra: int = 0) -> Column:
    """Whether a length, in whatever unit the caller counts (tokens, characters), is in a window; ``extra``
    is added for special tokens. Null lengths are out."""
    return F.coalesce((length >= least) & (length + extra <= most), F.lit(False))


def best_of(df: DataFrame, by: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of the greatest score of each group, of equals the least by ``ties``: one aggregate, no window.
    Null scores lose against all others."""
    rest = [c for c in df.columns if c not in (*by, *ties, score)]
    low = F.coalesce(-F.col(score), F.lit(float("inf")))
    g = df.groupBy(*by).agg(F.min(F.struct(low.alias("_low"), *ties, score, *rest)).alias("_s"))
    return g.select(*[F.col(c) if c in by else F.col(f"_s.{c}") for c in df.columns])


def contaminated(df: DataFrame, group: str, bad: Column) -> DataFrame:
    """Rows of groups in which any row is bad. Bad groups are found first, so no group is held by a task."""
    return df.join(df.where(F.coalesce(bad, F.lit(False))).select(group).distinct(), group, "left_semi")


def clean_groups(df: DataFrame, group: str, bad: Column) -> DataFrame:
    """Rows of groups without a bad row; rows without a group stay if they are not bad."""
    ok = df.where(~F.coalesce(bad, F.lit(False)))
    return ok.join(df.where(F.coalesce(bad, F.lit(False))).select(group).distinct(), group, "left_anti")


def unique_keys_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once (null keys go)."""
    return df.join(df.where(F.col(key).isNotNull()).groupBy(key).count().where("count = 1").select(key), key, "left_semi")


def mixed_null_groups(df: DataFrame, group: str, col: str) -> DataFrame:
    """Groups that have both null and other values in a column."""
    g = df.groupBy(group).agg(F.count(col).alias("present"), F.count(F.lit(1)).alias("rows"))
    return g.where("present between 1 and rows - 1")


def leaves(df: DataFrame, key: str, parent: Column) -> DataFrame:
    """Rows whose id is no other row's parent."""
    return df.join(df.select(parent.alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def expect_unique(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and whether the key is unique and never null."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).withColumn("ok", F.col("rows") == F.col("keys"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) of the columns that have nulls: one scan, then one row per column."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.unpivot([], list(df.columns), "column", "nulls").where("nulls > 0")


def retention(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Per group: rows before, rows after, per cent kept (groups without a name are a group)."""
    a, b = before.groupBy(by).agg(F.count(F.lit(1)).alias("before")), after.groupBy(by).agg(F.count(F.lit(1)).alias("after"))
    j = a.join(b.withColumnRenamed(by, "_k"), F.col(by).eqNullSafe(F.col("_k")), "left").drop("_k")
    return j.select(by, "before", F.coalesce("after", F.lit(0)).alias("after"), (F.coalesce("after", F.lit(0)) / F.col("before") * 100).alias("kept"))


def running_share(df: DataFrame, value: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Running sum and running per cent of the whole over an aggregated table (one row per key)."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*(by or []))
    return df.withColumn("running", F.sum(value).over(w)).withColumn("running_percent", F.col("running") / F.sum(value).over(every) * 100)
