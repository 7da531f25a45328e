"""Problem 8: filling fixed-capacity containers with items.

Items of the same size are interchangeable, so the packing is computed on the histogram of sizes,
which has at most as many entries as the capacity, however many documents there are. On it the
Martello-Toth reduction fixes sets of at most three items that dominate every other set holding the
largest item; the rest is packed best fit, largest first. Whole groups of equal sets are handled at
once. Documents then get their places by their rank among the documents of their size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import ByteBpe

SALT = 64


class Sizes:
    """Sorted multiset of sizes."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if s > 0 and c > 0}
        self.order = sorted(self.n)

    def take(self, s: int, m: int) -> None:
        self.n[s] -= m
        if self.n[s] == 0:
            del self.n[s]
            self.order.pop(bisect.bisect_left(self.order, s))

    def at_most(self, r: int) -> int | None:
        i = bisect.bisect_right(self.order, r)
        return self.order[i - 1] if i else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out

    def best_pair(self, r: int) -> tuple[int, int] | None:
        """Pair a >= b of items with the greatest sum of at most r; of equals the one with the largest a."""
        best, lo = None, 0
        hi = bisect.bisect_right(self.order, r) - 1
        lo = 0
        while lo <= hi:
            a, b = self.order[hi], self.order[lo]
            if a + b > r:
                hi -= 1
                continue
            if lo < hi or self.n[a] > 1:
                if best is None or (a + b, a) > (best[0] + best[1], best[0]):
                    best = (a, b)
            lo += 1
        return best

    def between(self, b: int, a: int, most: int = 2) -> int:
        """Items strictly between the sizes b and a, counted up to ``most``."""
        n = 0
        for i in range(bisect.bisect_right(self.order, b), bisect.bisect_left(self.order, a)):
            n += self.n[self.order[i]]
            if n >= most:
                return n
        return n


Pattern = tuple[int, tuple[tuple[int, int], ...]]


def reduce_sizes(sizes: Sizes, cap: int) -> list[Pattern]:
    """Fix dominating sets; ``sizes`` keeps what could not be fixed. (how often, ((size, how many), ...))."""
    fixed: list[Pattern] = []
    todo = list(sizes.order)

    def fix(m: int, *items: int) -> None:
        c: dict[int, int] = {}
        for x in items:
            c[x] = c.get(x, 0) + 1
        fixed.append((m, tuple(sorted(c.items(), reverse=True))))
        for x, k in c.items():
            sizes.take(x, m * k)

    for s in reversed(todo):
        while sizes.n.get(s):
            r = cap - s
            sizes.n[s] -= 1  # the item itself is out while partners are sought
            gone = sizes.n[s] == 0
            if gone:
                sizes.order.pop(bisect.bisect_left(sizes.order, s))
            one = sizes.at_most(r)
            small = sizes.smallest(3)
            pair = sizes.best_pair(r) if one is not None and len(small) > 1 and s + small[0] + small[1] <= cap else None
            two_more = len(small) > 1 and small[0] + small[1] <= r
            three_more = len(small) > 2 and sum(small) <= r
            gap = sizes.between(pair[1], pair[0]) if pair and pair[0] == one else 2
            if gone:
                bisect.insort(sizes.order, s)
            sizes.n[s] = sizes.n.get(s, 0) + 1
            times = lambda *xs: min(sizes.n[x] // xs.count(x) for x in set(xs))
            if one is None:
                fix(sizes.n[s], s)
            elif s + one == cap or not two_more:
                fix(times(s, one), s, one)
            elif not three_more and pair is not None and one >= pair[0] + pair[1]:
                fix(1, s, one)
            elif not three_more and pair is not None and pair[0] == one and gap < 2:
                fix(1, s, *pair)
            else:
                break
    return fixed


def best_fit(sizes: Sizes, cap: int) -> list[Pattern]:
    """Best fit, largest first, whole groups of equal containers at once; sizes is used up."""
    rooms: list[int] = []  # sorted room left
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(room: int, m: int, items: tuple[int, ...]) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((m, items))

    for s in reversed(list(sizes.order)):
        q = sizes.n[s]
        while q:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                k = min(cap // s, q)
                m, rest = divmod(q, k)
                put(cap - k * s, m, (s,) * k)
                if rest:
                    put(cap - rest * s, 1, (s,) * rest)
                q = 0
                break
            room = rooms[i]
            m, items = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            use = min(m, q)
            if m > use:
                put(room, m - use, items)
            put(room - s, use, (*items, s))
            q -= use
    out: list[Pattern] = []
    for g in groups.values():
        for m, items in g:
            c: dict[int, int] = {}
            for x in items:
                c[x] = c.get(x, 0) + 1
            out.append((m, tuple(c.items())))
    return out


def pack_sizes(counts: dict[int, int], cap: int) -> list[Pattern]:
    """Containers for a histogram of sizes, none above ``cap``."""
    s = Sizes(counts)
    return reduce_sizes(s, cap) + best_fit(s, cap)


def document_sizes(docs: DataFrame, tokenizer: ByteBpe | None = None) -> DataFrame:
    """(doc_id, tokens): whole texts through the tokenizer's fast path."""
    tk = tokenizer or ByteBpe()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) == 0:
                continue
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [tk.count(t) for t in b["text"]]})

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, tokens long")


def _places(patterns: list[Pattern]) -> tuple[list[tuple], int]:
    """(size, rank from, rank to, containers' first number, per container) of each part of a pattern."""
    at: dict[int, int] = {}
    out, first = [], 0
    for m, parts in patterns:
        for s, k in parts:
            lo = at.get(s, 0)
            at[s] = lo + m * k
            out.append((s, lo, lo + m * k, first, k))
        first += m
    return out, first


def fill_containers(docs: DataFrame, specs: DataFrame, tokenizer: ByteBpe | None = None, most_specs: int = 10_000) -> DataFrame:
    """(spec_id, container, doc_id, piece_no, from_token, tokens): every token of every document in one container.

    A text longer than a container gives full containers of its own and one rest that is packed with
    the others; any other text stays whole. Texts without tokens and null texts are in no container.
    Capacities that are null or not positive are left out, more than ``most_specs`` are refused; of repeated spec ids the largest counts.
    """
    spark = docs.sparkSession
    want = [(r[0], r[1]) for r in specs.where("capacity_tokens > 0 and spec_id is not null").groupBy("spec_id").agg(F.max("capacity_tokens")).orderBy("spec_id").limit(most_specs + 1).collect()]
    if len(want) > most_specs:
        raise ValueError(f"more than {most_specs} capacities")
    sized = cut(document_sizes(docs, tokenizer).where("tokens > 0"), "sizes")
    out = None
    for spec, cap in want:
        rest = sized.select("doc_id", F.expr(f"tokens div {cap}").alias("full"), (F.col("tokens") % cap).alias("size"))
        own = rest.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))
        own = own.select(F.lit(spec).alias("spec_id"), F.concat_ws(".", F.lit("f"), "doc_id", "piece_no").alias("container"), "doc_id", "piece_no", (F.col("piece_no") * cap).alias("from_token"), F.lit(cap).cast("long").alias("tokens"))
        small = rest.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
        per = small.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))  # at most capacity x SALT rows
        hist = {r[0]: r[1] for r in per.groupBy("size").agg(F.sum("n")).collect()}
        places, _ = _places(pack_sizes(hist, cap))
        base = per.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
        ranked = small.withColumn("rn", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id")) - 1)
        ranked = ranked.join(base, ["size", "salt"]).select("doc_id", "full", "size", (F.col("base") + F.col("rn")).alias("rank"))
        by: dict[int, list] = {}
        for s, lo, hi, first, k in places:
            by.setdefault(s, []).append((lo, hi, first, k))
        slots = spark.createDataFrame(list(by.items()), "size long, slots array<struct<lo:long,hi:long,first:long,k:long>>")
        if len(places) <= 200_000:  # bounded by the patterns, not by the documents
            slots = F.broadcast(slots)
        x = ranked.join(slots, "size").withColumn("s", F.expr("filter(slots, x -> x.lo <= rank and rank < x.hi)[0]"))
        packed = x.select(F.lit(spec).alias("spec_id"), F.concat_ws(".", F.lit("p"), F.expr("s.first + (rank - s.lo) div s.k")).alias("container"), "doc_id", F.col("full").alias("piece_no"), (F.col("full") * cap).alias("from_token"), F.col("size").alias("tokens"))
        both = own.unionAll(packed)
        out = both if out is None else out.unionAll(both)
    if out is None:
        return spark.createDataFrame([], "spec_id int, container string, doc_id long, piece_no long, from_token long, tokens long")
    return out


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, pieces, tokens, least_containers, fill): how full the containers are."""
    per = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    g = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    s = specs.groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    return g.join(s, "spec_id").select("spec_id", "capacity_tokens", "containers", "pieces", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("tokens") / F.col("containers") / F.col("capacity_tokens")).alias("fill"))
