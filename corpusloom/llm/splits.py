"""Problem 3: splits that keep related records together.

Related records are joined through entry ids and days. Components come from random-mate
contraction: in every round each vertex draws a coin from a hash of its name and the round; a
vertex with tails moves into its smallest neighbour with heads; contracted edges are made distinct
and written to the shared folder. When no edge is left the labels are unwound from the last round
to the first. Every step is a SQL join or a pre-aggregated groupBy. What reaches the driver is bounded:
one row for each split, hash bucket, and group or id above a fixed share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, drop_cut
from .common import blank_to_null


def entry_key(c: Column) -> Column:
    """Entry id without blanks around it, in lower case, a leading w written as k; blank gives null."""
    return F.regexp_replace(F.lower(blank_to_null(c)), "^w", "k")


def _moves(edges: DataFrame, rnd: int) -> DataFrame:
    """(v, to): vertices with tails and their smallest neighbour with heads."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(rnd)), F.lit(2))
    return both.where((coin("a") == 0) & (coin("b") == 1)).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to"))


def _contract(edges: DataFrame, rnd: int) -> DataFrame:
    m = _moves(edges, rnd)
    ma, mb = m.toDF("a", "ta"), m.toDF("b", "tb")
    e = edges.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
    return e.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 400) -> DataFrame:
    """(v, label) for each vertex of the undirected edges (a, b); equal label = same component.

    Null ends are dropped; loops keep their vertex. An empty edge table gives an empty result.
    """
    edges = edges.where("a is not null and b is not null")
    verts = edges.select(F.col("a").alias("v")).unionAll(edges.select(F.col("b").alias("v")))
    cur = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels = []
    while not cur.isEmpty():
        if len(levels) == max_rounds:
            raise RuntimeError("contraction did not end")
        levels.append(cur)
        cur = cut(_contract(cur, len(levels)), "edges")
    drop_cut(cur)
    final = None
    for r in range(len(levels), 0, -1):
        m = _moves(levels[r - 1], r)
        if final is None:
            step = m.select("v", F.col("to").alias("label"))
        else:
            f = final.toDF("to", "later")
            step = final.unionAll(m.join(f, "to", "left").select("v", F.coalesce("later", "to").alias("label")))
        new = cut(step, "labels")
        if final is not None:
            drop_cut(final)
        final = new
    for e in levels:
        drop_cut(e)
    if final is None:
        return verts.distinct().select("v", F.col("v").alias("label"))
    return verts.distinct().join(final, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def _edges(aligned: DataFrame) -> DataFrame:
    return aligned.select(
        F.concat(F.lit("i:"), entry_key(F.col("meta_data_id_hj"))).alias("a"), F.concat(F.lit("d:"), blank_to_null(F.col("date_id"))).alias("b")
    ).distinct()


def related_entries(pairs: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row per entry id of ``pairs``: id, component label, rows, characters, splits seen.

    Records are summed up per id before any join, so an id with a third of all rows is one row here.
    """
    ids = pairs.select(
        entry_key(F.col("meta_data_id_hj")).alias("id"), F.col("split"), F.coalesce(F.length("text_src"), F.lit(0)).alias("chars")
    ).where("id is not null")
    per = ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    comp = components(_edges(aligned)).where("v like 'i:%'").select(F.expr("substring(v, 3)").alias("id"), "label")
    return per.join(comp, "id", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("i:"), "id")))


def broken_groups(pairs: DataFrame, aligned: DataFrame) -> DataFrame:
    """(group_id): related groups whose records stand in two or more different non-null splits."""
    g = related_entries(pairs, aligned).groupBy("label").agg(F.min("id").alias("group_id"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return g.where("lo <> hi").select("group_id")


def assign_splits(pairs: DataFrame, aligned: DataFrame, targets: DataFrame, big_share: float = 0.002, buckets: int = 1024, most_splits: int = 1000) -> DataFrame:
    """(rec_id, group_id, split_new): every record with a split near the target shares, groups whole.

    A record without an entry id is a group of its own. Groups with at least ``big_share`` of all
    rows (at most 1/big_share of them, so they fit the driver) go first, each to the split with the
    most room left; the others follow in hash order and are cut at the cumulative weights that fill
    the rest. Cumulative weights come from ``buckets`` hash buckets (summed on the driver, fixed
    number) plus a running sum inside each bucket, so no task sees all groups. Empty or null targets
    give null splits; equal shares are kept in the order of the split's name; more than
    ``most_splits`` targets are refused. Records without id get their split without any join; ids
    above ``big_share`` are joined by broadcast, so that no key of a shuffled join is hot.
    """
    spark = pairs.sparkSession
    rel = cut(related_entries(pairs, aligned), "related")
    groups = rel.groupBy("label").agg(F.min("id").alias("group_id"), F.sum("rows").alias("rows"))
    alone = pairs.select("rec_id", entry_key(F.col("meta_data_id_hj")).alias("id"))
    solo = alone.where("id is null").select(F.concat(F.lit("r:"), F.col("rec_id").cast("string")).alias("group_id"), F.lit(1).cast("long").alias("rows"), "rec_id", F.lit(True).alias("solo"))
    allg = cut(groups.select("group_id", "rows", F.lit(None).cast("long").alias("rec_id"), F.lit(False).alias("solo")).unionAll(solo).withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets))), "groups")
    shares = [(r[0], float(r[1])) for r in targets.where("split is not null and target_share > 0").groupBy("split").agg(F.sum("target_share")).orderBy("split").limit(most_splits + 1).collect()]
    if len(shares) > most_splits:
        raise ValueError(f"more than {most_splits} splits")
    total = allg.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    norm = sum(s for _, s in shares) or 1.0
    want = {n: s / norm * total for n, s in shares}
    least = max(2, int(big_share * total))
    big = allg.where(F.col("rows") >= least).orderBy(F.desc("rows"), "group_id").collect()
    room, placed = dict(want), []
    for g in big:
        name = max(sorted(room), key=lambda n: room[n]) if room else None
        if name is not None:
            room[name] -= g["rows"]
        placed.append((g["group_id"], name))
    small = allg.where(F.col("rows") < least)
    sums = {r[0]: r[1] for r in small.groupBy("bucket").agg(F.sum("rows")).collect()}
    base, at = [], 0
    for b in range(buckets):
        base.append((b, at))
        at += sums.get(b, 0)
    left = {n: max(0.0, v) for n, v in room.items()}
    scale = at / (sum(left.values()) or 1.0)
    cuts, up = [], 0.0
    for n in sorted(left):
        up += left[n] * scale
        cuts.append((n, up))
    offsets = F.element_at(F.array(*[F.lit(x) for _, x in base]), (F.col("bucket") + 1).cast("int"))
    w = Window.partitionBy("bucket").orderBy(F.xxhash64(F.col("group_id"), F.lit(7)), "group_id").rowsBetween(Window.unboundedPreceding, 0)
    mid = offsets + F.sum("rows").over(w) - F.col("rows") / 2
    pick = F.lit(None)
    if cuts:  # the first split whose cumulative weight is reached, the last one at most
        below = F.size(F.filter(F.lit([top for _, top in cuts[:-1]] or [float("inf")]), lambda top: top < F.col("mid")))
        pick = F.element_at(F.lit([n for n, _ in cuts]), below + 1)
    chosen = small.withColumn("mid", mid).select("group_id", pick.cast("string").alias("split_new"), "rec_id", "solo")
    bigdf = F.broadcast(spark.createDataFrame(placed, "group_id string, split_big string"))  # at most 1 / big_share rows
    named = rel.join(groups.select("label", "group_id"), "label").join(chosen.where("not solo").select("group_id", "split_new"), "group_id", "left").join(bigdf, "group_id", "left")
    by_id = cut(named.select("id", "group_id", F.coalesce("split_big", "split_new").alias("split_new"), (F.col("rows") >= least).alias("hot")), "ids")
    hot = F.broadcast(by_id.where("hot").select("id", F.col("group_id").alias("hot_group"), F.col("split_new").alias("hot_split"), "hot"))  # at most 1 / big_share ids
    known = alone.where("id is not null").join(hot, "id", "left")
    found = known.where("hot").select("rec_id", F.col("hot_group").alias("group_id"), F.col("hot_split").alias("split_new"))
    found = found.unionAll(known.where("hot is null").join(by_id.where("not hot"), "id").select("rec_id", "group_id", "split_new"))
    return found.unionAll(chosen.where("solo").select("rec_id", "group_id", "split_new"))


def split_shares(pairs: DataFrame, assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, records, share): shares reached by the assignment."""
    n = assigned.groupBy(F.col("split_new").alias("split")).agg(F.count(F.lit(1)).alias("records"))
    t = targets.where("split is not null").groupBy("split").agg(F.sum("target_share").alias("target_share"))
    few = t.join(n, "split", "full")  # one row for each split: the window below sees only these
    every = F.sum(F.coalesce("records", F.lit(0))).over(Window.partitionBy())
    return few.select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / every).alias("share"))
