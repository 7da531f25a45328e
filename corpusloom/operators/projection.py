"""Column naming, null handling and value maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null


def suffix_columns(df: DataFrame, suffix: str, but: tuple[str, ...] = ()) -> DataFrame:
    """Every column name with a suffix, so that two sides of a join never clash."""
    return df.toDF(*[c if c in but else f"{c}_{suffix}" for c in df.columns])


def prefix_columns(df: DataFrame, prefix: str, but: tuple[str, ...] = ()) -> DataFrame:
    """Every column name with a prefix."""
    return df.toDF(*[c if c in but else f"{prefix}_{c}" for c in df.columns])


def drop_where(df: DataFrame, unwanted) -> DataFrame:
    """Without the columns whose name satisfies the predicate."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not unwanted(c)])


def canonical_columns(df: DataFrame) -> DataFrame:
    """Columns in order of name, those of the meta family last."""
    return df.select(*sorted((c for c in df.columns if not c.startswith("meta")), key=str), *sorted(c for c in df.columns if c.startswith("meta")))


def composite_key(*cols: Column, sep: str = "|") -> Column:
    """Parts joined by a separator; a null part gives a null key."""
    return F.concat(*[x for c in cols for x in (F.lit(sep), c.cast("string"))][1:])


def prefer(first: str, second: str, df: DataFrame) -> DataFrame:
    """Priority merge of two columns with the name of the one that was taken."""
    return df.withColumn("text", F.coalesce(first, second)).withColumn("taken_from", F.when(F.col(first).isNotNull(), F.lit(first)).when(F.col(second).isNotNull(), F.lit(second)))


def null_columns_where(df: DataFrame, cols: list[str], bad: Column) -> DataFrame:
    """A group of columns made null on the rows that satisfy a predicate (null counts as not)."""
    return df.withColumns({c: F.when(~F.coalesce(bad, F.lit(False)), F.col(c)) for c in cols})


def first_by_rarity(df: DataFrame, cols: list[str], last: str, out: str) -> DataFrame:
    """First value that is not null, columns in order of how few values they have, ``last`` at the end.

    One small aggregate decides the order, so the plan depends on the data.
    """
    n = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    order = sorted((c for c in cols if c != last), key=lambda c: (n[c], c)) + [last]
    return df.withColumn(out, F.coalesce(*order))


def merge_labelled(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    """The columns' values as one sorted string "name: value | name: value", nulls left out."""
    arr = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in cols])
    return df.withColumn(out, F.array_join(F.array_sort(F.filter(arr, lambda x: x.isNotNull())), " | "))


def drop_if_equal(df: DataFrame, a: str, b: str) -> DataFrame:
    """Without column ``b`` if it equals ``a`` on every row, nulls included."""
    same = df.agg(F.bool_and(F.col(a).eqNullSafe(F.col(b)))).first()[0]
    return df.drop(b) if same is not False else df


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all."""
    n = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if n[c]])


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Blank strings of every string column as null."""
    return df.withColumns({c: blank_to_null(F.col(c)) for c, t in df.dtypes if t == "string"})


def map_values(c: Column, mapping: dict[str, str], keep: bool = False) -> Column:
    """Values through a map; others become null, or stay."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    got = F.try_element_at(m, c)
    return F.coalesce(got, c) if keep else got


def padded_ids(df: DataFrame, order: list[str], prefix: str, out: str = "id") -> DataFrame:
    """Ids U01, U02, ... in the given order, as wide as the number of rows.

    Ranks come from a range partitioning and the partitions' sizes, so no task sorts the whole table;
    only one number per partition reaches the driver. Rows must be distinct on ``order``.
    """
    ranked, total = global_rank(df, order, "_rn")
    return ranked.withColumn(out, F.concat(F.lit(prefix), F.lpad(F.col("_rn").cast("string"), len(str(max(1, total))), "0"))).drop("_rn")


def global_rank(df: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """Rank from 1 over all rows: dense within range partitions, shifted by the sizes of those before."""
    parts = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    from ..session import cut

    held = cut(parts, "ranked")  # fixed partitions: sizes and ranks see the same rows
    sizes = {r[0]: r[1] for r in held.groupBy("_part").count().collect()}
    at, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, at))
        at += sizes[p]
    base = F.broadcast(df.sparkSession.createDataFrame(rows or [(0, 0)], "_part int, _base long"))
    w = Window.partitionBy("_part").orderBy(*order)
    return held.join(base, "_part").withColumn(out, F.col("_base") + F.row_number().over(w)).drop("_part", "_base"), at


def coalesce_update(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Keyed update: values of ``new`` that are not null overwrite; unknown keys change nothing."""
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = old.join(n, key, "left")
    return j.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns])


def any_of(preds: list[Column]) -> Column:
    """Disjunction in which null counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in preds], F.lit(False))
