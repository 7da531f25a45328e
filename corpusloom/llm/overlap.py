"""Problem 5: the same or nearly the same records across splits.

Texts are folded and grouped into classes of the same wording; all further work is on one text of
each class. No pair within the bound of ``WRONG`` can be missed:

1. Passages. An evaluation text of n code points has at most k = ``most_edits(n)`` edits to any
   partner, so of k + 1 disjoint passages one stands unchanged in the partner, moved by at most k
   (pigeonhole). Of the text's cells of ``CELL`` code points the k + 1 rarest become passages, each
   prolonged over the cells left out behind it. How rare a cell is comes from counts over all
   evaluation texts in a table of fixed size; a wrong count costs time, never a pair.
2. Shards. A passage belongs to the least fingerprint of the three-point windows at its start. Every
   window of every training text is looked at: it has a least fingerprint too, and runs of windows
   with the same one are stretches that only the shard of that fingerprint can match. Windows that
   begin no passage at all, or none of an evaluation text of such a size at such a place that the
   bound allows the pair (two bit maps of fixed size, without false negatives), are left out before
   the shuffle. So each piece of a training text goes to one shard, and work grows with the texts,
   not with texts times shards.
3. Scan. Each shard builds one Aho-Corasick automaton over its passages and runs it over its
   stretches. A match counts where the parts before and behind it and the parities of 128 classes of code points
   (an edit changes at most two) agree with the bound.
4. Coverage. Matched intervals are merged per evaluation and training text; pairs with any coverage
   are confirmed by bags of code points and the exact bounded edit distance.

Hot fingerprints are split on both sides: the stretches into r parts, the passages into c parts, and
each part meets each. No limit is set on passages, stretches or pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut
from .common import bit_map, fold, source_name
from .rolling import Prints, codes, mix

CELL, LONGEST, GRAM = 6, 9, 3
WRONG = 0.12
#: Bits of the fingerprint that number the counts of cells, and the map of windows that begin a passage.
RARITY_BITS, KNOWN_BITS = 20, 26
#: Bits of the map of windows that begin a passage of a class of sizes in a class of places.
NEAR_BITS = 28
#: Least size of each class of sizes, and how far the places of one class lie apart, as twice the place less the size.
SIZES = np.unique([int(1.13**i) for i in range(177)])
WIDTHS = np.maximum(2, (0.13 * SIZES).astype(np.int64))
#: Passages of one shard, about; its automaton takes some 100 bytes for each.
SHARD = 300_000
#: Rows of one fingerprint above which it is split.
HOT = 200_000


def most_edits(n: int) -> int:
    """Most edits between a text of n code points and any partner; a partner has at most n / (1 - WRONG)."""
    return int(WRONG * n / (1 - WRONG) + 1e-9)


def cells(n: int) -> tuple[int, int]:
    """(number, stride) of the cells of a text of n code points: at least one more than its edits; none where it has none."""
    k = most_edits(n)
    p = max(k + 1, n // CELL) if k else 0
    return p, n // max(1, p)


def start_window(n: int) -> int:
    """Length of the window that names the shard of a passage of a text of n code points."""
    return min(CELL, cells(n)[1])


#: Greatest length of a training text that a passage with such a start window can match; every length for whole cells.
REACH = {q: max(n + most_edits(n) for n in range(8, 999) if start_window(n) == q) for q in sorted({start_window(n) for n in range(8, 999)})}


class Joined:
    """Many texts as one array of code points, a break after each, with the fingerprints of all windows."""

    def __init__(self, texts: list[str]):
        self.text = "\0".join(texts) + "\0"
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.owner = np.repeat(np.arange(len(texts)), self.size + 1)
        self.end = self.start + self.size
        self.arr = codes(self.text)
        self.prints = Prints(self.arr)
        self.gram = self.prints.windows(GRAM)

    def windows(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, fingerprints) of the windows of q code points that lie inside one text."""
        at = np.arange(max(0, len(self.arr) - q + 1))
        at = at[at + q <= self.end[self.owner[at]]]
        return at, self.prints.at(at, at + q)

    def least(self, at: np.ndarray, q: int) -> np.ndarray:
        """Least fingerprint of the ``GRAM`` windows in the windows of q at these places."""
        out = self.gram[at]
        for i in range(1, q - GRAM + 1):
            out = np.minimum(out, self.gram[at + i])
        return out


def signature(text: str) -> np.ndarray:
    """Two 64-bit words: parities of the counts of 128 classes of code points."""
    x = mix(codes(text).astype(np.uint64)) & np.uint64(127)
    return np.packbits((np.bincount(x.astype(np.int64), minlength=128) & 1).astype(np.uint8)).view(np.int64)


def signatures(j: Joined) -> np.ndarray:
    """:func:`signature` of many texts at once."""
    x = (mix(j.arr.astype(np.uint64)) & np.uint64(127)).astype(np.int64)
    inside = np.ones(len(x), dtype=bool)
    inside[j.end] = False
    n = np.bincount((j.owner * 128 + x)[inside], minlength=128 * len(j.size)).reshape(len(j.size), 128)
    return np.packbits((n & 1).astype(np.uint8), axis=1).view(np.int64)


def choose(n: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """(place, length) of the k + 1 passages of a text of n code points, given the counts of its cells."""
    p, step = cells(n)
    kept = np.sort(np.argsort(counts, kind="stable")[: most_edits(n) + 1]) * step
    ends = np.append(kept[1:], n)
    return [(a, min(b - a, LONGEST)) for a, b in zip(kept.tolist(), ends.tolist(), strict=True)] if p else []


def size_class(n: np.ndarray) -> np.ndarray:
    """Class of each size; grows with the size."""
    return np.maximum(0, np.searchsorted(SIZES, n, "right") - 1)


def near_bit(h: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bit of a window with this fingerprint in a class of sizes and a class of places."""
    return (mix(h ^ mix((sizes.astype(np.uint64) << np.uint64(32)) + places.astype(np.uint64))) >> np.uint64(64 - NEAR_BITS)).astype(np.int64)


def near_passage(near: np.ndarray, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a window at this place of a training text of n code points may begin a passage of a partner.

    With at most k edits the sizes differ by k at most; so do the edits before a passage and those behind
    it together, and with them twice the place less the size.
    """
    k = (WRONG * n / (1 - WRONG) + 1e-9).astype(np.int64)
    out, lo, hi, skew = np.zeros(len(h), dtype=bool), size_class(n - k), size_class(n + k), 2 * at - n
    for i in range(int((hi - lo).max(initial=-1)) + 1):
        c = np.minimum(lo + i, hi)
        first, last = (skew - k) // WIDTHS[c], (skew + k) // WIDTHS[c]
        for x in range(int((last - first).max(initial=-1)) + 1):
            rest = np.flatnonzero(~out & (lo + i <= hi) & (first + x <= last))
            bit = near_bit(h[rest], c[rest], first[rest] + x)
            out[rest] = (near[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    return out


def _parts(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for i in range(0, len(whole), rows):
            yield whole.iloc[i : i + rows]


def _count_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    for b in _parts(batches):
        _, h = Joined(b["folded"].tolist()).windows(CELL)
        n += np.bincount((h >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(n))
    some = np.flatnonzero(n)
    yield pd.DataFrame({"bucket": some.astype(np.int32), "n": n[some]})


_ROW = "key int, text string, cid long, size int, at int, s1 long, s2 long"


def _passages(rarity):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: np.ndarray = rarity.value
        for b in _parts(batches):
            j = Joined(b["folded"].tolist())
            sig, out, at = signatures(j), [], []
            for i, n in enumerate(j.size.tolist()):
                p, step = cells(n)
                if not p:
                    continue
                c = j.start[i] + np.arange(p) * step
                h = j.prints.at(c, c + min(step, CELL))
                for a, m in choose(n, seen[(h >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]):
                    out.append((i, a, j.text[j.start[i] + a : j.start[i] + a + m]))
                    at.append((j.start[i] + a, start_window(n)))
            if out:
                i, a, text = zip(*out, strict=True)
                i, (where, q) = np.array(i), np.array(at).T
                key = np.zeros(len(where), dtype=np.uint64)
                for x in REACH:
                    key[q == x] = j.least(where[q == x], x)
                first = j.prints.at(where, where + q)
                a, n = np.array(a, dtype=np.int64), j.size[i]
                sizes = size_class(n)
                yield pd.DataFrame({"key": (key >> np.uint64(33)).astype(np.int32), "text": text, "cid": b["cid"].to_numpy()[i], "size": n.astype(np.int32), "at": a.astype(np.int32), "s1": sig[i, 0], "s2": sig[i, 1], "bit": (first >> np.uint64(64 - KNOWN_BITS)).astype(np.int32), "near": near_bit(first, sizes, (2 * a - n) // WIDTHS[sizes]).astype(np.int32)})

    return run


def _stretches(known, near=None):
    """Stretches of windows that are in the map ``known`` and, where it is given, in the map ``near``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits: np.ndarray = known.value
        for b in _parts(batches):
            j = Joined(b["folded"].tolist())
            sig, ids = signatures(j), b["cid"].to_numpy()
            for q, reach in REACH.items():
                at, h = j.windows(q)
                bit = (h >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
                ok = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                if q < CELL:
                    ok &= j.size[j.owner[at]] <= reach
                at, h = at[ok], h[ok]
                if near is not None:
                    own = j.owner[at]
                    at = at[near_passage(near.value, h, at - j.start[own], j.size[own])]
                if len(at) == 0:
                    continue
                key, own = j.least(at, q), j.owner[at]
                new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
                lo, i = at[new], own[new]
                hi = np.minimum(at[np.r_[new[1:], len(at)] - 1] + LONGEST, j.end[i])
                text = [j.text[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pd.DataFrame({"key": (key[new] >> np.uint64(33)).astype(np.int32), "text": text, "cid": ids[i], "size": j.size[i].astype(np.int32), "at": (lo - j.start[i]).astype(np.int32), "s1": sig[i, 0], "s2": sig[i, 1]})

    return run


class Shard:
    """Aho-Corasick automaton over the passages of a shard, with the evaluation texts that hold each."""

    def __init__(self, rows: pd.DataFrame):
        import ahocorasick

        which, texts = pd.factorize(rows["text"])
        order = np.lexsort((rows["at"].to_numpy(), which))
        self.which, self.at = which[order].astype(np.int64), rows["at"].to_numpy(dtype=np.int64)[order]
        self.place = (self.which << 32) + self.at
        self.cid, self.size, self.s1, self.s2 = (rows[c].to_numpy()[order] for c in ("cid", "size", "s1", "s2"))
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(texts):
            self.machine.add_word(t, i)
        if len(texts):
            self.machine.make_automaton()

    def scan(self, rows: pd.DataFrame) -> pd.DataFrame:
        """(e, t, size, at, length): matches that the bound on edits allows."""
        texts = rows["text"].tolist()
        found = np.array(list(self.machine.iter("\0".join(texts))) if len(self.length) else [], dtype=np.int64).reshape(-1, 2)
        start = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        row = np.searchsorted(start, found[:, 0], "right") - 1
        n = rows["size"].to_numpy(dtype=np.int64)[row]
        k = (WRONG * n / (1 - WRONG) + 1e-9).astype(np.int64)
        at = rows["at"].to_numpy(dtype=np.int64)[row] + found[:, 0] - self.length[found[:, 1]] + 1 - start[row]
        base = found[:, 1] << 32
        lo, hi = np.searchsorted(self.place, base + np.maximum(0, at - k)), np.searchsorted(self.place, base + at + k, "right")
        out = []
        edge = np.r_[0, np.flatnonzero(np.diff(np.cumsum(hi - lo) // 2_000_000)) + 1, len(lo)]
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):  # blocks of bounded size
            c = hi[x:y] - lo[x:y]
            p = np.repeat(lo[x:y], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            r, off = np.repeat(row[x:y], c), np.repeat(at[x:y], c)
            size = rows["size"].to_numpy(dtype=np.int64)[r]
            most = (WRONG * np.maximum(size, self.size[p]) + 1e-9).astype(np.int64)
            # Edits before the passage move it, edits behind it move the text's end: both together are within the bound.
            moved = np.abs(off - self.at[p]) + np.abs(size - off - self.size[p] + self.at[p])
            ok = (moved <= most) & (rows["cid"].to_numpy()[r] != self.cid[p])
            p, r, most = p[ok], r[ok], most[ok]
            ok = np.bitwise_count(rows["s1"].to_numpy()[r].view(np.uint64) ^ self.s1[p].view(np.uint64)).astype(np.int64) + np.bitwise_count(rows["s2"].to_numpy()[r].view(np.uint64) ^ self.s2[p].view(np.uint64)) <= 2 * most
            p, r = p[ok], r[ok]
            out.append(pd.DataFrame({"e": self.cid[p], "t": rows["cid"].to_numpy()[r], "size": self.size[p], "at": self.at[p].astype(np.int32), "length": self.length[self.which[p]].astype(np.int32)}))
        return pd.concat(out).drop_duplicates()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one partition: first its passages, then its stretches."""
    held, shard = [], None
    for b in batches:
        where = b["place"].to_numpy()
        b = b.assign(size=(where & 0x7FFFFFFF).astype(np.int32), at=(where >> 31 & 0x7FFFFFFF).astype(np.int32))
        mine = where >> 62 == 0
        if mine.any():
            held.append(b[mine])
        if not mine.all():
            if shard is None:
                if not held:
                    continue
                shard, held = Shard(pd.concat(held)), []
            yield shard.scan(b[~mine])


def scan_shards(passages: DataFrame, stretches: DataFrame) -> DataFrame:
    """(e, t, size, at, length): every match of a passage in a stretch, each shard by one automaton.

    Passages and stretches of a fingerprint meet in one partition, sorted so that the passages come
    first; stretches are streamed past the automaton. Fingerprints with more than ``HOT`` rows (or four
    times a partition's share) are split: r parts of stretches times c parts of passages.
    """
    spark = passages.sparkSession
    n_p, n_s = passages.count(), stretches.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n_p // SHARD), -(-n_s // (10 * SHARD)))
    bound = max(HOT, 4 * (n_p + n_s) // parts)  # at most parts / 2 fingerprints have more
    both = [x.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("key", F.ceil(F.col("n") / bound).cast("int").alias(c)) for x, c in ((stretches, "r"), (passages, "c"))]
    hot = spark.createDataFrame(both[0].join(both[1], "key", "full").select("key", F.coalesce("r", F.lit(1)), F.coalesce("c", F.lit(1))).collect(), "key int, r int, c int")
    fixed, every = lambda n: F.pmod(F.xxhash64("cid"), F.coalesce(F.col(n), F.lit(1))).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    row = lambda kind: ["key", "text", "cid", F.expr(f"shiftleft({kind}L, 62) | shiftleft(bigint(at), 31) | size").alias("place"), "s1", "s2"]
    p = passages.join(F.broadcast(hot), "key", "left").select(*row(0), fixed("c").alias("in_c"), every("r").alias("in_r"))
    s = stretches.join(F.broadcast(hot), "key", "left").select(*row(1), every("c").alias("in_c"), fixed("r").alias("in_r"))
    both = p.unionByName(s).select(F.pmod(F.xxhash64("key", "in_c", "in_r"), F.lit(parts)).cast("int").alias("part"), "text", "cid", "place", "s1", "s2")
    both = both.repartitionById(parts, "part").sortWithinPartitions("place").drop("part")
    return both.mapInPandas(_scan, "e long, t long, size int, at int, length int")


def distance_at_most(a: str, b: str, k: int) -> int:
    """Edit distance of a and b, or k + 1 where it is greater: furthest-reaching points on diagonals."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    n, m = len(a), len(b)
    far = {}

    def slide(i: int, j: int) -> int:
        step = 32
        while i < n and j < m:
            if a[i : i + step] == b[j : j + step]:
                i, j = min(i + step, n), min(j + step, m)
                d = min(n - i, m - j)
                if d <= 0:
                    return min(i, n)
            elif step > 1 and a[i] == b[j]:
                step = max(1, step // 4)
                if step == 1:
                    while i < n and j < m and a[i] == b[j]:
                        i, j = i + 1, j + 1
                    return i
            else:
                return i
        return i

    if n == m and a == b:
        return 0
    far[0] = slide(0, 0)
    if far[0] >= n and m == n:
        return 0
    for e in range(1, k + 1):
        new = {}
        for d in range(-e, e + 1):  # d = j - i
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            i = slide(i, i + d)
            new[d] = i
            if i >= n and i + d >= m:
                return e
        far = new
    return k + 1


def _bags(texts: pd.Series, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each text's bag, bags): counts of 256 classes of the windows of q code points."""
    which, each = pd.factorize(texts)
    j = Joined(each.tolist())
    at, h = j.windows(q)
    n = np.bincount(j.owner[at] * 256 + (h & np.uint64(255)).astype(np.int64), minlength=256 * len(each))
    return which, n.reshape(len(each), 256)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _parts(batches, 4000):
        k = (WRONG * np.maximum(b["e_text"].str.len(), b["t_text"].str.len()).to_numpy() + 1e-9).astype(np.int64)
        ok = np.ones(len(b), dtype=bool)
        for q in (1, 2):  # an edit takes away and adds at most q windows
            (i, x), (j, y) = _bags(b["e_text"], q), _bags(b["t_text"], q)
            ok &= np.abs(x[i] - y[j]).sum(axis=1) <= 2 * q * k
        out = []
        for e, t, et, tt, c, m in zip(*(b[c][ok] for c in ("e", "t", "e_text", "t_text", "coverage")), k[ok].tolist(), strict=True):
            if (d := distance_at_most(et, tt, m)) <= m:
                out.append((e, t, d, c))
        yield pd.DataFrame(out, columns=["e", "t", "edits", "coverage"])


def _folded(pairs: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(fold)

    d = pairs.where("rec_id is not null and split is not null and text_src is not null").select("rec_id", (F.col("split") == "train").alias("train"), run("text_src").alias("folded"))
    return d.where(F.length("folded") > 0)


def text_classes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): rec_id, train, cid; and cid, folded, role (1 train, 2 evaluation, 3 both).

    A class is named by the least rec_id of its records. Rows without split or without letters and
    digits, or without rec_id, belong to no class.
    """
    base = cut(_folded(pairs).select("rec_id", "train", F.unhex(F.md5("folded")).alias("digest"), "folded"), "folded")
    cls = base.groupBy("digest").agg(F.min("rec_id").alias("cid"), F.max(F.col("train").cast("int")).alias("a"), F.max((~F.col("train")).cast("int")).alias("b"))
    cls = cut(cls.select("digest", "cid", (F.col("a") + 2 * F.col("b")).cast("tinyint").alias("role")), "classes")
    members = base.select("rec_id", "train", "digest").join(cls.select("digest", "cid"), "digest").select("rec_id", "train", "cid")
    texts = base.select(F.col("rec_id").alias("cid"), "folded").join(cls.select("cid", "role"), "cid")
    return members, texts


def near_classes(texts: DataFrame) -> DataFrame:
    """(e, t, edits, coverage): evaluation class and another training class of nearly the same text.

    ``coverage`` is the part of the evaluation text in the passages found unchanged near their places.
    """
    sc = texts.sparkSession.sparkContext
    texts = cut(texts, "texts")
    ev, tr = texts.where("role in (2, 3)").select("cid", "folded"), texts.where("role in (1, 3)").select("cid", "folded")
    seen = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    counted = ev.mapInPandas(_count_windows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    passages = cut(ev.mapInPandas(_passages(sc.broadcast(seen)), _ROW + ", bit int, near int"), "passages")
    known, near = (sc.broadcast(bit_map(passages.select(F.col(c).alias("bit")), n)) for c, n in (("bit", KNOWN_BITS), ("near", NEAR_BITS)))
    stretches = cut(tr.mapInPandas(_stretches(known, near), _ROW), "stretches")
    merged = scan_shards(passages, stretches).groupBy("e", "t").agg(F.collect_set(F.struct("at", "length")).alias("at"), F.first("size").alias("size"))
    cand = merged.select("e", "t", (F.expr("aggregate(at, 0, (n, x) -> n + x.length)") / F.col("size")).alias("coverage"))
    x = cand.join(texts.select(F.col("cid").alias("e"), F.col("folded").alias("e_text")), "e")
    x = x.join(texts.select(F.col("cid").alias("t"), F.col("folded").alias("t_text")), "t")
    out = cut(x.select("e", "t", "e_text", "t_text", "coverage").mapInPandas(_verify, "e long, t long, edits int, coverage double"), "near")
    for t in (texts, passages, stretches):
        drop_cut(t)
    return out


def cross_split(pairs: DataFrame) -> DataFrame:
    """(rec_id_a, rec_id_b): a train row and a row of another split with nearly the same text_src.

    Pairs of classes are expanded through membership only here, as the result asks for rows. Null
    splits, null and blank texts pair with nothing.
    """
    members, texts = text_classes(pairs)
    members = cut(members, "members")
    near = near_classes(texts).select("e", "t")
    tr = members.where("train").select(F.col("cid").alias("t"), F.col("rec_id").alias("x"))
    ev = members.where("not train").select(F.col("cid").alias("e"), F.col("rec_id").alias("y"))
    same = tr.join(ev, F.col("t") == F.col("e")).select("x", "y")
    other = near.join(tr, "t").join(ev, "e").select("x", "y")
    return same.unionAll(other).select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b"))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """(split, source, overlapping, records): evaluation rows that come again in train, per split and source."""
    found = cross_split(pairs)
    ids = found.select(F.col("rec_id_a").alias("rec_id")).unionAll(found.select(F.col("rec_id_b").alias("rec_id"))).distinct().withColumn("hit", F.lit(1))
    d = pairs.where("split is not null and split <> 'train'").select("rec_id", "split", source_name(F.col("meta_corpus")).alias("source"))
    return d.join(ids, "rec_id", "left").groupBy("split", "source").agg(F.count("hit").alias("overlapping"), F.count(F.lit(1)).alias("records"))
