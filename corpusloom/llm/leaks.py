"""Problem 9: evaluation texts leaking into training text, by greedy string tiling.

Seeds are Karp-Rabin fingerprints of the items' windows of q code points, a Spark table; documents
are folded (letters and digits only, forms unified) and their windows joined to it by fingerprint.
Windows in no item go before the join, by a bit map of fixed size without false negatives; a table of
seeds of checked size is joined where the windows are, a larger one by a shuffle. A document
with enough of an item's seeds is tiled: the longest matches not yet covered are marked again and
again, so reordered passages count too. Tiles that follow each other with a few wrong characters
between them form passages; the two longest passages decide how much of the item stands there.
Whether a document holds an item depends on these two alone, never on the other items.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import bit_map, fold
from .rolling import Prints, codes

Q, TILE, KNOWN_BITS, BATCH_CHARS = 8, 5, 24, 1_000_000
#: Seeds with nothing near them on their diagonal say nothing about a passage: fewest of a band.
BAND, GAP, REACH = 3, 12, 8

_FREE = re.compile(b"\0+")


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct seeds of each item with their first place and their number."""
    for b in batches:
        for i, t in zip(b["iid"].tolist(), b["item"], strict=True):
            h, at = np.unique(Prints(codes(t)).windows(min(Q, len(t))), return_index=True)
            yield pd.DataFrame({"h": h.view(np.int64), "bit": (h >> np.uint64(64 - KNOWN_BITS)).astype(np.int32), "q": min(Q, len(t)), "iid": i, "place": at.astype(np.int32), "n": len(h)})


class Documents:
    """Folded documents as one array, with the windows that may be seeds."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.size + 1) - self.size - 1
        self.owner = np.repeat(np.arange(len(texts)), self.size + 1)
        self.arr = codes("\0".join(texts) + "\0")
        self.prints = Prints(self.arr)

    def windows(self, bits: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(fingerprints, documents, places) for each size of seeds."""
        for q in sizes:
            h = self.prints.windows(q)
            bit = (h >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
            at = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            d = self.owner[at]
            yield h[at].view(np.int64), d, at - self.start[d]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, Documents]]:
    """Folded documents in blocks of about ``BATCH_CHARS`` code points."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b["doc_id"].tolist(), b["text"], strict=True):
            if f := fold(t):
                ids.append(i)
                texts.append(f)
                held += len(f)
            if held >= BATCH_CHARS:
                yield np.array(ids), Documents(texts)
                ids, texts, held = [], [], 0
    if ids:
        yield np.array(ids), Documents(texts)


def _windows(known, sizes: list[int]):
    """Windows of documents that may be seeds, as rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, docs in _blocks(batches):
            for h, d, at in docs.windows(known.value, sizes):
                yield pd.DataFrame({"h": h, "doc_id": ids[d], "at": at.astype(np.int32)})

    return run


def in_bands(diag: np.ndarray, at: np.ndarray, n: int, size: int, seeds: float, least: float) -> np.ndarray | None:
    """Places of the seeds that stand with others on a band of diagonals; nothing where they are less
    than the part ``seeds`` of an item's n seeds, or where the two bands that cover most of its ``size``
    code points, ``REACH`` around each seed, cannot make up the part ``least``. A passage lies on one
    band; seeds scattered over stock phrases lie on many."""
    place = at - diag
    order = np.lexsort((at, diag))
    band = np.empty(len(at), dtype=np.int64)
    band[order] = np.cumsum(np.r_[0, np.diff(diag[order]) > GAP])  # a band ends where no seed follows within GAP diagonals
    keep = np.bincount(band)[band] >= min(BAND, seeds * n)
    if keep.sum() < seeds * n:
        return None
    order = np.lexsort((place, band))
    step = np.diff(place[order], append=place[order[-1]])
    step[np.r_[np.diff(band[order]) != 0, True]] = Q + 2 * REACH
    cover = np.minimum(size, np.bincount(band[order], np.minimum(step, Q + 2 * REACH)))
    return at[keep] if np.sort(cover)[-2:].sum() >= least * size else None


def matches(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, place in a, place in b) of at least ``least`` code points."""
    q = min(least, len(a))
    if q == 0 or len(b) < q:
        return []
    ha, hb = Prints(a).windows(q), Prints(b).windows(q)
    order = np.argsort(ha, kind="stable")
    lo, hi = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(hb)), n)
    i = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    s = np.lexsort((j, j - i))
    i, j = i[s], j[s]
    if len(i) == 0:
        return []
    new = np.flatnonzero(np.r_[True, (np.diff(j) != 1) | (np.diff(j - i) != 0)])
    size = np.diff(np.r_[new, len(i)]) + q - 1
    return list(zip(size.tolist(), i[new].tolist(), j[new].tolist(), strict=True))


def tiles(a: np.ndarray, b: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: longest matches first, nothing covered twice in a or in b."""
    heap = [(-n, i, j) for n, i, j in matches(a, b, least)]
    heapq.heapify(heap)
    ua, ub = bytearray(len(a)), bytearray(len(b))
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        if ua.find(1, i, i + n) >= 0 or ub.find(1, j, j + n) >= 0:
            both = bytes(map(max, ua[i : i + n], ub[j : j + n]))
            for m in _FREE.finditer(both):  # what is left of the match comes up again with its own length
                x, y = m.span()
                if y - x >= least:
                    heapq.heappush(heap, (x - y, i + x, j + x))
            continue
        ua[i : i + n] = ub[j : j + n] = b"\1" * n
        out.append((i, j, n))
    return out


def passages(found: list[tuple[int, int, int]], gap: int = 8, wrong: float = 0.16) -> list[tuple[int, int, int, int]]:
    """Tiles joined over a few wrong characters: (item from, item to, doc from, doc to), longest first."""
    done = []
    cur = None
    for i, j, n in sorted(found, key=lambda x: x[1]):
        if cur is not None:
            gi, gj = i - cur[1], j - cur[3]
            bad = cur[4] + max(gi, gj)
            if 0 <= gi <= gap and 0 <= gj <= gap and bad <= wrong * (i + n - cur[0]) + 1:
                cur = [cur[0], i + n, cur[2], j + n, bad]
                continue
            done.append(cur)
        cur = [i, i + n, j, j + n, 0]
    if cur is not None:
        done.append(cur)
    return sorted(((c[0], c[1], c[2], c[3]) for c in done), key=lambda c: (c[0] - c[1], c))


def two_passages(item: np.ndarray, doc: np.ndarray) -> tuple[float, int]:
    """Part of the item in its two longest passages in the document, and their number."""
    p = passages(tiles(item, doc))[:2]
    if not p:
        return 0.0, 0
    mark = np.zeros(len(item), dtype=bool)
    for c in p:
        mark[c[0] : c[1]] = True
    return float(mark.mean()), len(p)


def near(doc: np.ndarray, places: np.ndarray, around: int) -> np.ndarray:
    """The parts of a document within ``around`` of the places, with a break between parts."""
    mark = np.zeros(len(doc) + 1, dtype=np.int32)
    np.add.at(mark, np.maximum(0, places - around), 1)
    np.add.at(mark, np.minimum(len(doc), places + around), -1)
    inside = np.cumsum(mark)[:-1] > 0
    cut = np.flatnonzero(np.diff(inside.astype(np.int8)) == -1) + 1
    out = doc.copy()
    out[cut[cut < len(out)]] = 0
    inside[cut[cut < len(out)]] = True
    return out[inside]


def held_part(doc: np.ndarray, item: np.ndarray, diag: np.ndarray, at: np.ndarray, n: int, least: float, seeds: float) -> tuple[float, int] | None:
    """(part of the item in its two longest passages, their number) where it is at least ``least``."""
    places = in_bands(diag, at, n, len(item), seeds, least)
    if places is None:
        return None
    part, k = two_passages(item, near(doc, places, 2 * Q + len(item) // 4))
    return (part, k) if part >= least else None


def _verify(least: float, seeds: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, i, n, diag, at, text, item in zip(*(b[c] for c in ("doc_id", "iid", "n", "diag", "at", "text", "item")), strict=True):
                got = held_part(codes(fold(text)), codes(item), np.asarray(diag), np.asarray(at), n, least, seeds)
                if got:
                    out.append((d, i, *got))
            yield pd.DataFrame(out, columns=["doc_id", "iid", "coverage", "n_passages"])

    return run


class Index:
    """All seeds and items, where they are few enough for a broadcast."""

    def __init__(self, seeds: pd.DataFrame, items: pd.DataFrame):
        self.iid = items["iid"].to_numpy()
        self.items = items["item"].tolist()
        order = np.argsort(self.iid)
        self.iid, self.items = self.iid[order], [self.items[i] for i in order]
        seeds = seeds.sort_values("h", kind="stable")
        self.h, first = np.unique(seeds["h"].to_numpy(), return_index=True)
        self.first = np.append(first, len(seeds))
        self.item, self.place = np.searchsorted(self.iid, seeds["iid"].to_numpy()), seeds["place"].to_numpy()
        self.n = np.bincount(self.item, minlength=len(self.iid))

    def search(self, docs: Documents, found, least: float, seeds: float) -> Iterator[tuple[int, int, float, int]]:
        """(document, item's id, part, passages); ``found`` gives the windows that may be seeds."""
        pairs, diags, ats = [], [], []
        for h, d, at in found:
            k = np.searchsorted(self.h, h)
            k[k == len(self.h)] = 0
            ok = np.flatnonzero(self.h[k] == h) if len(self.h) else np.zeros(0, np.int64)
            n = self.first[k[ok] + 1] - self.first[k[ok]]
            src = np.repeat(self.first[k[ok]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at[ok], n)
            pairs.append(np.repeat(d[ok], n) * len(self.iid) + self.item[src])
            diags.append(at - self.place[src])
            ats.append(at)
        if not pairs:
            return
        pair, diag, at = np.concatenate(pairs), np.concatenate(diags), np.concatenate(ats)
        u, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        enough = n >= np.maximum(1, seeds * self.n[u % len(self.iid)])
        keep = np.flatnonzero(enough[which])
        keep = keep[np.argsort(which[keep], kind="stable")]
        edge = np.r_[0, np.cumsum(n[enough])]
        for p, x, y in zip(u[enough].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            d, i = divmod(p, len(self.iid))
            s = docs.start[d]
            got = held_part(docs.arr[s : s + docs.size[d]], codes(self.items[i]), diag[keep[x:y]], at[keep[x:y]], int(self.n[i]), least, seeds)
            if got:
                yield d, int(self.iid[i]), *got


def _search(index, known, sizes: list[int], least: float, seeds: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, docs in _blocks(batches):
            out = [(ids[d], *x) for d, *x in index.value.search(docs, docs.windows(known.value, sizes), least, seeds)]
            yield pd.DataFrame(out, columns=["doc_id", "iid", "coverage", "n_passages"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, least: float = 0.5, seeds: float = 0.18, most: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, coverage, n_passages): documents that hold at least ``least`` of an item.

    ``least`` is the part of the item's letters and digits in at most two passages; ``seeds`` the part
    of its seeds a document needs to be tiled at all. Null and empty texts and rows without id hold nothing and are held
    nowhere; items of the same wording are each reported; documents that come again are each reported.
    Up to ``most`` seeds are broadcast and the documents are read once; beyond that seeds and windows
    are joined as Spark tables and only candidates' texts are read again. Both ways give the same rows.
    """
    sc = docs.sparkSession.sparkContext

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(fold)

    named = cut(items.where("item_id is not null and text is not null").select("item_id", folded("text").alias("item")).where("length(item) > 0"), "items")
    each = named.groupBy("item").agg(F.min("item_id").alias("iid"))  # items of the same wording are searched once
    table = cut(each.mapInPandas(_seeds, "h long, bit int, q int, iid long, place int, n int"), "seeds")
    sizes = sorted(r[0] for r in table.select("q").distinct().collect())  # at most Q
    d = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    known = sc.broadcast(bit_map(table, KNOWN_BITS))
    if table.count() <= most:
        index = sc.broadcast(Index(table.select("h", "iid", "place").toArrow().to_pandas(), each.toArrow().to_pandas()))
        found = d.mapInPandas(_search(index, known, sizes, least, seeds), "doc_id long, iid long, coverage double, n_passages int")
    else:
        hits = d.mapInPandas(_windows(known, sizes), "h long, doc_id long, at int").join(table, "h")
        pairs = hits.groupBy("doc_id", "iid").agg(F.first("n").alias("n"), F.collect_list(F.struct((F.col("at") - F.col("place")).alias("diag"), "at")).alias("hits"))
        cand = pairs.where(F.size("hits") >= F.greatest(F.lit(1.0), F.lit(seeds) * F.col("n"))).select("doc_id", "iid", "n", F.col("hits.diag").alias("diag"), F.col("hits.at").alias("at"))
        found = cand.join(d, "doc_id").join(each, "iid").mapInPandas(_verify(least, seeds), "doc_id long, iid long, coverage double, n_passages int")
    return found.join(each, "iid").join(named, "item").select("doc_id", "item_id", "coverage", "n_passages")
