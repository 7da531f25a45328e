"""Problem 1: mixing sources to target weights by Poisson replication.

For a source with C characters, share s and at most m repeats the mean number of copies is
``s * T / C``, where T is the largest total at which no source needs more than m copies of its
records on average. Each record draws its number of copies by inverting the distribution of
min(Poisson(lambda), m) at a uniform number hashed from its key, with lambda solved so that the
mean is met exactly. Rows are exploded by their counts, texts with them, and put in a global random order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import blank_to_null, source_name

#: Targets are one row for each source; a list longer than this is refused, never cut off.
MOST_TARGETS = 100_000


def capped_mean(lam: float, m: int) -> float:
    """Mean of min(Poisson(lam), m)."""
    p, below, mean = math.exp(-lam), 0.0, 0.0
    for k in range(m):
        mean += k * p
        below += p
        p *= lam / (k + 1)
    return mean + m * max(0.0, 1.0 - below)


def solve_rate(mean: float, m: int) -> float:
    """Poisson rate whose minimum with m has this mean; infinite where every record takes m copies."""
    if mean >= m * (1 - 1e-9):
        return math.inf
    lo, hi = 0.0, 1.0
    while capped_mean(hi, m) < mean and hi < 700:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, m) < mean else (lo, mid)
    return (lo + hi) / 2


def thresholds(lam: float, m: int) -> list[float]:
    """Cumulative P(min(Poisson, m) <= k) for k = 0 .. m-1."""
    if math.isinf(lam):
        return [0.0] * m
    out, p, c = [], math.exp(-lam), 0.0
    for k in range(m):
        c += p
        out.append(min(1.0, c))
        p *= lam / (k + 1)
    return out


def unit_hash(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the MD5 digest of key and seed: the same on every engine and run."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def current_records(pairs: DataFrame) -> DataFrame:
    """rec_id, source, lang, chars: the latest delivery of each key2 with any text.

    A record delivered again is one record, else it could come more often than max_repeat allows.
    Rows without key2 stand for themselves. Null or blank text_src has no characters and is left out.
    """
    d = pairs.select("rec_id", "key2", "loaded_at", source_name(F.col("meta_corpus")).alias("source"), F.lower(blank_to_null(F.col("lang_src"))).alias("lang"), F.length("text_src").alias("chars"), blank_to_null(F.col("text_src")).isNotNull().alias("full"))
    d = d.where("full").withColumn("k", F.coalesce("key2", F.concat(F.lit("\0"), F.col("rec_id").cast("string"))))
    best = d.groupBy("k").agg(F.max_by(F.struct("rec_id", "source", "lang", "chars"), F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))), "rec_id")).alias("r"))
    return best.select("k", "r.*")


def plan(records: DataFrame, targets: DataFrame) -> tuple[list[dict], float]:
    """Rate of every target: one small aggregate, as many rows as there are targets."""
    t = targets.select(source_name(F.col("meta_corpus")).alias("source"), F.lower(blank_to_null(F.col("lang_src"))).alias("lang"), "target_share", "max_repeat")
    t = t.where("source is not null and lang is not null and target_share > 0 and max_repeat > 0").groupBy("source", "lang").agg(F.sum("target_share").alias("share"), F.min("max_repeat").alias("most"))
    have = records.groupBy("source", "lang").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("records"))
    rows = [r.asDict() for r in t.join(have, ["source", "lang"], "left").orderBy("source", "lang").limit(MOST_TARGETS + 1).collect()]
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    live = [r for r in rows if r["chars"]]
    whole = sum(r["share"] for r in live)
    total = min((r["most"] * r["chars"] / (r["share"] / whole) for r in live), default=0.0)
    for r in rows:
        r["mean"] = r["share"] / whole * total / r["chars"] if r["chars"] else 0.0
        r["rate"] = solve_rate(r["mean"], r["most"]) if r["mean"] else 0.0
    return rows, total


def copies(pairs: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """(k, rec_id, source, lang, chars, n): how often each record comes; n >= 1 only.

    Records are found once and written to the shared folder; the thresholds of all targets are a small
    table joined to them (a broadcast of at most ``MOST_TARGETS`` rows).
    """
    rec = cut(current_records(pairs), "records")
    rows, _ = plan(rec, targets)
    steps = [(r["source"], r["lang"], thresholds(r["rate"], r["most"])) for r in rows if r["mean"] > 0]
    table = F.broadcast(pairs.sparkSession.createDataFrame(steps, "source string, lang string, steps array<double>"))
    n = F.expr("size(filter(steps, x -> u >= x))")
    d = rec.withColumn("u", unit_hash(F.col("k"), seed)).join(table, ["source", "lang"]).withColumn("n", n)
    return d.where("n > 0").select("k", "rec_id", "source", "lang", "chars", "n"), rows


def mixture(pairs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(rec_id, copy_no, source, lang, chars, place, text_src): the mixture in a global random order.

    ``place`` is a 63-bit hash of record and copy; the rows are sorted by it across all partitions,
    texts and all. Rows without rec_id stand in no mixture. Sources without a target are left out; targets
    without records reach nothing and their shares go to the others in proportion; an empty target
    list gives an empty mixture.
    """
    c, _ = copies(pairs, targets, seed)
    out = c.join(pairs.select("rec_id", "text_src"), "rec_id")
    out = out.select("k", "rec_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "source", "lang", F.col("chars").cast("long").alias("chars"), "text_src")
    place = F.shiftrightunsigned(F.xxhash64("k", "copy_no", F.lit(seed)), 1)
    return out.select("rec_id", "copy_no", "source", "lang", "chars", place.alias("place"), "text_src").orderBy("place", "rec_id", "copy_no")


def shares(pairs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Report by target: wanted share, mean and greatest repeats, records used, characters, share reached."""
    c, rows = copies(pairs, targets, seed)
    got = c.groupBy("source", "lang").agg(F.sum(F.col("chars") * F.col("n")).alias("mixed_chars"), F.count(F.lit(1)).alias("used_records"), F.max("n").alias("most_copies"))
    plan_df = pairs.sparkSession.createDataFrame([(r["source"], r["lang"], r["share"], int(r["most"]), int(r["records"] or 0), float(r["mean"])) for r in rows], "source string, lang string, target_share double, max_repeat int, records long, mean_copies double")
    few = plan_df.join(got, ["source", "lang"], "left")
    every = F.sum("mixed_chars").over(Window.partitionBy())
    return few.select("source", "lang", "target_share", "max_repeat", "records", "mean_copies", F.coalesce("used_records", F.lit(0)).alias("used_records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("mixed_chars", F.lit(0)).alias("mixed_chars"), F.coalesce(F.col("mixed_chars") / every, F.lit(0.0)).alias("reached_share"))
