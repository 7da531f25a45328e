"""Splits, deduplication, leakage removal and sampling. All choices hang on hashes of keys, never on row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(key: Column, seed: int = 42) -> Column:
    """Uniform number in [0, 1) from the SHA-256 digest of ``key/seed``."""
    return F.conv(F.substring(F.sha2(F.concat(key.cast("string"), F.lit(f"/{seed}")), 256), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def hash_split(key: Column, shares: dict[str, float] | None = None, seed: int = 42) -> Column:
    """Split of a record by its key alone; null keys have none."""
    shares = shares or {"train": 0.8, "valid": 0.1, "test": 0.1}
    u, top, out = unit(key, seed), 0.0, None
    names = list(shares)
    for n in names[:-1]:
        top += shares[n]
        out = F.when(u < top, n) if out is None else out.when(u < top, n)
    last = F.lit(names[-1]) if out is None else out.otherwise(names[-1])
    return F.when(key.isNotNull(), last)


def two_level_split(book: Column, record: Column) -> Column:
    """Records of held-out books (half of all) get the split's second form, e.g. test2."""
    first = hash_split(record)
    return F.when(hash_split(book, {"a": 0.5, "b": 0.5}) == "b", F.concat(first, F.lit("2"))).otherwise(first)


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row of each group: the least by ``order``. A min over a struct, so it is combined before the shuffle."""
    rest = [c for c in df.columns if c not in by and c not in order]
    g = df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_s")) if not _has_map(df) else None
    return g.select(*[F.col(c) if c in by else F.col(f"_s.{c}") for c in df.columns])


def _has_map(df: DataFrame) -> bool:
    return any("map<" in t for _, t in df.dtypes)


def text_digest(texts: list[str]) -> Column:
    """Digest of several texts; null where one is null."""
    return F.sha2(F.concat(*[x for c in texts for x in (F.length(c).cast("string"), F.lit(":"), F.col(c))]), 256)


def dedup_within(df: DataFrame, split: str, texts: list[str], key: str, seed: int = 42) -> DataFrame:
    """First row by hash of each text inside each split. Rows without split, or without text, vanish.

    The shuffle key is a digest of the texts, not the texts.
    """
    ok = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (split, *texts)]))
    d = ok.withColumn("_digest", text_digest(texts)).withColumn("_u", F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")), 256))
    rest = [c for c in df.columns if c != split]
    g = d.groupBy(split, "_digest").agg(F.min_by(F.struct(*rest), F.struct("_u", key)).alias("_s"))
    return g.select(*[F.col(c) if c == split else F.col(f"_s.{c}") for c in df.columns])


def drop_leaks(df: DataFrame, split: str, texts: list[str], held: str, cleaned: list[str]) -> DataFrame:
    """Rows of the cleaned splits go if their text occurs in the held split; all other rows stay.

    The table is read twice: for the digests of the held split and for the rows, of which those outside
    the cleaned splits, or with a null text, have no digest and meet nothing.
    """
    digest = text_digest(texts)
    h = df.where(F.col(split) == held).select(digest.alias("_digest")).where("_digest is not null").distinct()
    return df.withColumn("_digest", F.when(F.col(split).isin(cleaned), digest)).join(h, "_digest", "left_anti").drop("_digest")


def hygiene(df: DataFrame, split: str, text: str, key: str, length: Column | None = None, most: int = 2048) -> DataFrame:
    """Dedup inside splits, then no text of train in valid or test, none of valid in test: one shuffle on a digest.

    Equal to the three steps one after the other for the plain splits train, valid and test: of each
    text only the rows of its strongest split (test before valid before train) stay, and of these the
    first by hash. Other splits are only deduplicated. Null split or text: the row goes. With ``length``,
    in whatever unit the caller counts, rows without 0 < length <= most go last.
    """
    rank = F.when(F.col(split) == "test", 0).when(F.col(split) == "valid", 1).when(F.col(split) == "train", 2)
    d = df.where(F.col(split).isNotNull() & F.col(text).isNotNull())
    plain = F.col(split).isin("train", "valid", "test")
    d = d.withColumn("_g", F.when(plain, F.lit("")).otherwise(F.col(split))).withColumn("_digest", F.sha2(F.col(text), 256)).withColumn("_u", F.sha2(F.concat(F.col(key).cast("string"), F.lit("/42")), 256))
    g = d.groupBy("_g", "_digest").agg(F.min_by(F.struct(*df.columns), F.struct(F.coalesce(rank, F.lit(0)), "_u", key)).alias("_s"))
    out = g.select("_s.*")
    return out if length is None else out.where((length > 0) & (length <= most))


def merge_answers(df: DataFrame, answers: DataFrame, keys: list[str], answer: str, out: str, label: str = r"^(?:답|A):\s*") -> DataFrame:
    """``df`` with the answers joined back as column ``out``: the label before an answer goes, answers that
    begin with a Latin letter are blanked. Of several answers to the same keys the least counts."""
    a = F.regexp_replace(answer, label, "")
    few = answers.select(*keys, F.when(~a.rlike("^[A-Za-z]"), a).alias(out)).groupBy(*keys).agg(F.min(out).alias(out))
    return df.join(few, keys, "left")


def stratified(df: DataFrame, by: list[str], key: str, n: int, first: Column | None = None) -> DataFrame:
    """At most n rows of each stratum in hash order; rows with ``first`` true come before and are all kept.

    Top-n by window is computed with partial limits per task (WindowGroupLimit), so a huge stratum is
    cut down before the shuffle.
    """
    u = F.sha2(F.concat(F.col(key).cast("string"), F.lit("/42")), 256)
    f = F.coalesce(first, F.lit(False)) if first is not None else F.lit(False)
    d = df.withColumn("_u", u).withColumn("_f", f)
    w = Window.partitionBy(*by).orderBy(F.desc("_f"), "_u", key)
    top = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    if first is None:
        return top.drop("_u", "_f", "_rn")
    more = d.where("_f").withColumn("_rn", F.lit(0))
    return top.where("not _f").unionByName(more).drop("_u", "_f", "_rn")


def mixture(df: DataFrame, group: str, key: str, quotas: dict[str, int]) -> DataFrame:
    """Fixed numbers of rows per group, in hash order; groups without a quota go."""
    q = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    d = df.where(F.col(group).isin(list(quotas))).withColumn("_u", F.sha2(F.concat(F.col(key).cast("string"), F.lit("/42")), 256))
    w = Window.partitionBy(group).orderBy("_u", key)
    most = max(quotas.values(), default=0)
    return d.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= most) & (F.col("_rn") <= F.try_element_at(q, F.col(group)))).drop("_u", "_rn")


def fraction(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Rows whose hash falls below the share."""
    return df.where(unit(F.col(key), seed) < share)


def shard(key: Column, k: int, seed: int = 42) -> Column:
    """Shard number 0 .. k-1 by hash: even without a global order."""
    return F.floor(unit(key, seed) * k).cast("int")


def previous_and_new(prev: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Union of two result tables without empty contents; of the same key the previous one stays."""
    both = prev.where(F.col(content).isNotNull()).withColumn("_p", F.lit(0)).unionByName(new.where(F.col(content).isNotNull()).withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_p")]
    g = both.groupBy(*keys).agg(F.min(F.struct("_p", *rest)).alias("_s"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_s.{c}") for c in both.columns if c != "_p"])


def alignment_rules(df: DataFrame, link_id: str, data_id: str, text: str, targets: list[str], sentinels: list[str], titles: tuple[str, str] | None = None) -> DataFrame:
    """Target side nulled, all columns of ``targets``, where a rule is broken; each rule sees what those before left.

    In order: link id and data id differ; the link id occurs more than once; the text has a sentinel;
    text or data id is there without the other; source and target ``titles`` differ but for blanks.
    Ids and titles that are null break no rule by themselves.
    """
    n = df.where(F.col(link_id).isNotNull()).groupBy(link_id).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(n, link_id, "left")
    found = reduce(lambda a, b: a | b, [F.col(text).contains(x) for x in sentinels], F.lit(False))
    rules = [F.col(link_id) != F.col(data_id), F.col("_n") > 1, found, F.col(text).isNull() != F.col(data_id).isNull()]
    if titles:
        rules.append(F.col(titles[1]) != F.regexp_replace(titles[0], r"[\s\p{Z}]+", ""))
    for bad in rules:
        d = d.withColumn("_bad", F.coalesce(bad, F.lit(False)))
        d = d.withColumns({c: F.when(~F.col("_bad"), F.col(c)) for c in targets})
    return d.select(*df.columns)
