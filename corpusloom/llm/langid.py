"""Problem 10: languages of documents and of their stretches, by prediction by partial matching.

For each language a byte-level context tree of order ``ORDER`` holds the counts of a bounded sample
of labelled documents. Frozen, with escape method C, it gives every byte of a text an exact code
length: ``count / (total + distinct)`` in the longest context known, after the escapes of the longer
ones. The trees of all languages are laid out as hash tables over (context, byte) windows, so a
batch of documents is scored with a few array operations a byte. Sentences get the language path of
least total length, where a change of language costs ``SWITCH`` bits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK

ORDER, SWITCH, TRAIN_SWITCH, NOISE = 4, 30.0, 12.0, 0.3
LANGS = ("hj", "ko", "zh", "en", "ja")
# Codes that name a language.
CODES = {
    "hj": "hj", "lzh": "hj", "cc": "hj", "och": "hj", "zh-classical": "hj", "ko": "ko", "kor": "ko", "korean": "ko", "zh": "zh", "zho": "zh", "chi": "zh",
    "cmn": "zh", "chinese": "zh", "en": "en", "eng": "en", "english": "en", "ja": "ja", "jpn": "ja", "jp": "ja", "japanese": "ja",
}
#: A sentence for this purpose: up to an end mark with what closes after it, or a line break.
_PIECE = re.compile(r"[^。．.!?！？…\n]*(?:[。．.!?！？…]+[\"”’」』)）〕\]》〉']*[^\S\n]*|\n\s*|$)")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def named_language(c: Column) -> Column:
    """Language a code names; null where it names none."""
    t = F.lower(F.regexp_replace(c, BLANK, ""))
    m = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.coalesce(F.element_at(m, t), F.element_at(m, F.regexp_replace(t, "[-_].*$", "")))


class Table:
    """Index of 64-bit keys: one probe, then a sorted list for keys whose slot is taken."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        at = self._at(keys)
        self.slot[at] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.slot[at] != np.arange(len(keys)))
        order = np.argsort(keys[lost])
        self.over, self.over_at = keys[lost][order], lost[order].astype(np.int32)

    def _at(self, q: np.ndarray) -> np.ndarray:
        return ((q * _MUL) >> self.shift).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not there."""
        if len(self.keys) == 0:
            return np.full(len(q), -1, dtype=np.int32)
        i = self.slot[self._at(q)]
        bad = np.flatnonzero((i < 0) | (self.keys[i] != q))
        if len(bad):
            i[bad] = -1
            if len(self.over):
                k = np.searchsorted(self.over, q[bad])
                k[k == len(self.over)] = 0
                ok = self.over[k] == q[bad]
                i[bad[ok]] = self.over_at[k[ok]]
        return i


def windows(b: np.ndarray, order: int) -> np.ndarray:
    """Byte i with the ``order`` bytes before it as one number; bytes before the start are 0."""
    w = b.astype(np.uint64)
    for k in range(1, order + 1):
        w[k:] |= b[:-k].astype(np.uint64) << np.uint64(8 * k)
    return w


def _without_noise(raw: list, data: list[np.ndarray], docs: list[np.ndarray], k: int) -> list:
    """Windows and counts of each language without those that are another language's in the wrong place."""
    keys = np.unique(np.concatenate([w for w, _ in raw]))
    share = np.zeros((len(keys), len(raw)), dtype=np.float32)
    for j, (d, doc) in enumerate(zip(data, docs, strict=True)):
        w, n = np.unique(np.unique(windows(d, k) << np.uint64(24) | doc) >> np.uint64(24), return_counts=True)
        share[np.searchsorted(keys, w), j] = n / (int(doc[-1]) + 1)
    keep = share >= NOISE * share.max(axis=1, keepdims=True)
    out = []
    for j, (w, c) in enumerate(raw):
        ok = keep[np.searchsorted(keys, w), j] if int(docs[j][-1]) >= 3 else np.ones(len(w), dtype=bool)
        out.append((w[ok], c[ok]))
    return out


class Trees:
    """Context trees of several languages with frozen counts.

    ``texts`` gives the documents of each language, some of them wrongly labelled. Windows of three
    bytes and more that a language's documents hold far less often than another language's do (less
    than ``NOISE`` of the greatest share of documents) count as label noise and are left out.
    """

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs = tuple(x for x in LANGS if texts.get(x)) or ("en",)
        self.order = order
        n = len(self.langs)
        data, docs = [], []
        for x in self.langs:
            raw = [(t + "\n").encode("utf-8", "ignore") for t in texts.get(x, ["a"])]
            data.append(np.frombuffer(b"".join(raw), dtype=np.uint8))
            docs.append(np.repeat(np.arange(len(raw), dtype=np.uint64), [len(r) for r in raw]))
        self.win, self.bits, self.ctx, self.esc = [], [], [], []
        for k in range(order + 1):
            seen = []
            raw = [np.unique(windows(d, k), return_counts=True) for d in data]
            if k >= 2:
                raw = _without_noise(raw, data, docs, k)
            for w, c in raw:
                if len(w) == 0:
                    none = np.zeros(0, dtype=np.int64)
                    seen.append((w, c, w, none, none))
                    continue
                cx, first = np.unique(w >> np.uint64(8), return_index=True)
                distinct = np.diff(np.r_[first, len(w)])
                total = np.add.reduceat(c, first)
                seen.append((w, c, cx, total, distinct))
            keys = np.unique(np.concatenate([s[0] for s in seen]))
            cks = np.unique(np.concatenate([s[2] for s in seen]))
            esc = np.zeros((len(cks), n), dtype=np.float32)
            for j, (_, _, cx, total, distinct) in enumerate(seen):
                esc[np.searchsorted(cks, cx), j] = -np.log2(distinct / (total + distinct))
            own = np.searchsorted(cks, keys >> np.uint64(8))
            low = self._lower(keys, k)
            bits = esc[own] + low
            for j, (w, c, cx, total, distinct) in enumerate(seen):
                at = np.searchsorted(cx, w >> np.uint64(8))
                bits[np.searchsorted(keys, w), j] = -np.log2(c / (total[at] + distinct[at]))
            self.win.append(Table(keys))
            self.bits.append(bits.astype(np.float32))
            self.ctx.append(Table(cks))
            self.esc.append(esc)

    def _lower(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths in the contexts shorter than k; 8 bits below the empty one."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), 8.0, dtype=np.float32)
        return self._score(keys & np.uint64((1 << (8 * k)) - 1), k - 1)

    def _score(self, w: np.ndarray, k: int) -> np.ndarray:
        i = self.win[k].find(w)
        out = self.bits[k][i]
        miss = np.flatnonzero(i < 0)
        if len(miss):
            c = self.ctx[k].find(w[miss] >> np.uint64(8))
            e = self.esc[k][c]
            e[c < 0] = 0
            out[miss] = e + self._lower(w[miss], k)
        return out

    def code_lengths(self, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each piece of bytes (given by its start) in each language."""
        out = np.zeros((len(starts), len(self.langs)), dtype=np.float64)
        for lo in range(0, len(starts), 20_000):
            s = starts[lo : lo + 20_000]
            end = int(starts[lo + 20_000]) if lo + 20_000 < len(starts) else len(b)
            back = min(self.order, int(s[0]))
            w = windows(b[int(s[0]) - back : end], self.order)[back:]
            out[lo : lo + 20_000] = np.add.reduceat(self._score(w, self.order), s - s[0], axis=0, dtype=np.float64)
        return out


_BRACKETS = re.compile(r"[(（〔\[《〈「『][^)）〕\]》〉」』]*[)）〕\]》〉」』]")
_HANGUL, _HAN_RUN = re.compile("[가-힣]"), re.compile("[\u3400-\u9fff\uf900-\ufaff々〇]+")


def plain(piece: str) -> str:
    """A sentence as the trees see it: compatibility forms unified; in a sentence written in Hangul the
    words in Chinese characters are left out, as nouns in other letters say nothing about its language."""
    if piece.isascii():
        return piece
    if not unicodedata.is_normalized("NFKC", piece):
        piece = unicodedata.normalize("NFKC", piece)
    if _HANGUL.search(piece) and _HAN_RUN.search(piece):
        bare = _BRACKETS.sub("", piece)
        n = len(_HANGUL.findall(bare))
        if n >= 3 and n * 4 >= sum(map(len, _HAN_RUN.findall(bare))):
            return _HAN_RUN.sub("", piece)
    return piece


def pieces(text: str) -> list[str]:
    """The text cut after end marks and line breaks; nothing is lost."""
    return [p for p in _PIECE.findall(text) if p] or ([text] if text else [])


def best_path(bits: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each piece on the path of least total length."""
    low = bits.argmin(axis=1)
    if (low == low[0]).all():
        return low
    n, m = bits.shape
    cost, back = bits[0].copy(), np.zeros((n, m), dtype=np.int8)
    stay = np.arange(m)
    for i in range(1, n):
        j = int(cost.argmin())
        move = cost[j] + switch
        back[i] = np.where(cost <= move, stay, j)
        cost = np.minimum(cost, move) + bits[i]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(cost.argmin())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def split_bits(model: Trees, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """Pieces of each text and their code lengths."""
    cut = [pieces(t) for t in texts]
    raw = [[plain(p).encode("utf-8", "ignore") or b" " for p in ps] for ps in cut]
    flat = [x for r in raw for x in r]
    if not flat:
        return [(ps, np.zeros((0, len(model.langs)))) for ps in cut]
    size = np.fromiter((len(x) for x in flat), dtype=np.int64, count=len(flat))
    bits = model.code_lengths(np.frombuffer(b"".join(flat), dtype=np.uint8), np.cumsum(size) - size)
    out, at = [], 0
    for ps in cut:
        out.append((ps, bits[at : at + len(ps)]))
        at += len(ps)
    return out


def train(sample: list[tuple[str, str]]) -> Trees:
    """Trees from (language, text) rows some of whose labels are wrong.

    Each half of the sample is relabelled, sentence by sentence, by trees of the other half; sentences
    that keep their document's label or agree within a document of another language teach that
    language in the final trees.
    """
    halves = [sample[::2], sample[1::2]]
    clean: dict[str, dict[int, list[str]]] = {}
    for part, (mine, other) in enumerate((halves, halves[::-1])):
        by: dict[str, list[str]] = {}
        for lang, t in other:
            by.setdefault(lang, []).append("".join(map(plain, pieces(t))))
        m = Trees(by)
        for i, (ps, bits) in enumerate(split_bits(m, [t for _, t in mine])):
            if ps:
                for p, k in zip(ps, best_path(bits, TRAIN_SWITCH), strict=True):
                    clean.setdefault(m.langs[k], {}).setdefault(2 * i + part, []).append(plain(p))
    return Trees({k: ["".join(p) for p in v.values()] for k, v in clean.items()})


def labelled_sample(docs: DataFrame, per_language: int = 160, longest: int = 6000) -> list[tuple[str, str]]:
    """(language, text) of about ``per_language`` documents of each named language, chosen by a hash of the id.

    Bounded: documents of at most ``longest`` characters, a share of each language that gives
    ``per_language`` on average. Only the fitting is bounded; every document is labelled.
    """
    d = docs.where("doc_id is not null and text is not null").select("doc_id", named_language(F.col("lang")).alias("named"), F.length("text").alias("n"), "text").where("named is not null and n between 20 and %d" % longest)
    n = {r[0]: r[1] for r in d.groupBy("named").count().collect()}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    take = F.lit(False)
    for lang, k in sorted(n.items()):
        take = take | ((F.col("named") == lang) & (u < int(1_000_000 * min(1.0, per_language / k)) + 1))
    rows = d.where(take).select("doc_id", "named", "text").limit(2 * per_language * len(LANGS)).collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0] * 0x9E3779B1 % (1 << 32), r[0]))]


def _label(model_ref):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Trees = model_ref.value
        for b in batches:
            out = []
            texts = ["" if t is None else t for t in b["text"]]
            for (ps, bits), doc, named, t in zip(split_bits(model, texts), b["doc_id"], b["named"], texts, strict=True):
                if not t.strip():
                    continue
                path = best_path(bits)
                change = np.flatnonzero(np.diff(path)) + 1
                edge = [0, *change.tolist(), len(ps)]
                size = {}
                rows = []
                at = 0
                for x, y in zip(edge[:-1], edge[1:], strict=True):
                    part = "".join(ps[x:y])
                    lang = model.langs[path[x]]
                    total = bits[x:y].sum(axis=0)
                    rel = (total - total.min()) / max(1, y - x) / 8
                    conf = float(2.0 ** -rel[path[x]] / np.sum(2.0**-rel))
                    lead = len(part) - len(part.lstrip()) if at else 0
                    rows.append((at + lead, at + len(part), lang, conf))
                    size[lang] = size.get(lang, 0) + len(part)
                    at += len(part)
                main = max(sorted(size), key=lambda k: size[k])
                for r in rows:
                    out.append((doc, *r, len(rows), main, named))
            yield pd.DataFrame(out, columns=["doc_id", "start_at", "end_at", "lang", "confidence", "stretches", "main", "named"])

    return run


def stretches(docs: DataFrame, per_language: int = 160) -> DataFrame:
    """One row for each stretch of one language: doc_id, start_at, end_at, lang, confidence, stretches, main, named.

    ``main`` is the language of most characters, ``named`` the one the label names (null if none).
    Null and blank texts have no stretch. Without any labelled document all is called en.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(train(labelled_sample(docs, per_language)))
    d = docs.select("doc_id", "text", named_language(F.col("lang")).alias("named")).where("doc_id is not null and text is not null")
    return d.mapInPandas(_label(model), "doc_id long, start_at int, end_at int, lang string, confidence double, stretches int, main string, named string")


def mislabelled(docs: DataFrame) -> DataFrame:
    """(doc_id, start_at, lang) of documents without a right label or with several languages."""
    return stretches(docs).where("named is null or named <> main or stretches > 1").select("doc_id", "start_at", "lang")
