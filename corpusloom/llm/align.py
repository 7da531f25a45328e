"""Problem 4: sentence alignment in bilingual documents.

Every text is read once and written as its lines' distinct tokens, numbers and counts, a thousand
records to a block of flat arrays. Translation tables are estimated by expectation-maximisation: every
iteration is one Spark job whose tasks return expected counts of their rows, summed by token pair, over
all records and every token seen more than once; frequent tokens are worked by matrix products, the
others pair by pair. Lines of both sides then become bit sets: bit k of a source line's expected set is
on where one of its tokens translates to token k.
Competitive linking takes the best pair of lines anywhere in the record, strikes out the tokens the
pair explains on both sides, and goes on with what is left of the lines; so lines may be reordered,
several lines may share one partner, and lines without a partner stay alone.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import _Fold, fold
from .rolling import codes

_NOTE = re.compile(r"[\[(〔（［][^\])〕）］\n]*[\])〕）］]")
_HAN_NUM = re.compile("[〇一二三四五六七八九十百千]+")
_DIGIT = {c: i for i, c in enumerate("〇一二三四五六七八九")}
_POWER = {"十": 10, "百": 100, "千": 1000}
_NUM = re.compile(r"\d[\d,]*")
_RUN = (",", "，", "、", "､")
_SYLLABLE = re.compile("[가-힣㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+")
#: Largest translation table held with a cell for every pair of tokens; larger ones hold the pairs that occur.
CELLS = 1 << 24
_BLOCK = 4096
#: Cells of a row that matrix products work through while single cells take one.
_PRODUCT = 120


def han_number(s: str) -> int:
    """Value of a Chinese numeral below ten thousand; plain digit strings are read by place."""
    if not any(c in _POWER for c in s):
        return int("".join(str(_DIGIT[c]) for c in s))
    total, d = 0, None
    for c in s:
        if c in _POWER:
            total += (1 if d is None else d) * _POWER[c]
            d = None
        else:
            d = _DIGIT[c]
    return total + (d or 0)


def tokens(line: str, side: str) -> tuple[list[str], list[int]]:
    """(tokens, numbers) of a line: characters of hj, syllables of oko, words and word ends of en."""
    if not line.isascii() and not unicodedata.is_normalized("NFKC", line):
        line = unicodedata.normalize("NFKC", line)
    bare = _NOTE.sub(" ", line)
    if side == "hj":
        t = fold(bare)
        nums = [han_number(x) for x in _HAN_NUM.findall(t)]
        return list(_HAN_NUM.sub("", t)), nums
    nums = []
    for x in _NUM.findall(bare):
        try:
            nums.append(int(x.replace(",", "")))
        except ValueError:
            pass
    if side == "oko":
        return _SYLLABLE.findall(bare), nums
    out = []
    for w in _WORD.findall(bare):
        lw = w.lower()
        out.append(lw)
        if w[0].isupper() and len(lw) > 4:
            out += ["^" + lw[:3], lw[-3:] + "$"]
    return out, nums


@lru_cache(1 << 17)
def token_id(w: str) -> int:
    """Number of a token: the code point of a character, a 56-bit hash of anything longer."""
    return ord(w) if len(w) == 1 else int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=7).digest()) | 1 << 56


Line = tuple[list[int], list[int], int]


class _FoldLines(_Fold):
    """The table of :func:`fold`, with line breaks kept."""


_LINES = _FoldLines({10: "\n"})
_TOP = 0x110000
_NUMERAL, _SYLLABLES = np.zeros(_TOP, dtype=bool), np.zeros(_TOP, dtype=bool)
_NUMERAL[[ord(c) for c in "〇一二三四五六七八九十百千"]] = True
for _lo, _hi in ("가힣", "㐀鿿"):
    _SYLLABLES[ord(_lo) : ord(_hi) + 1] = True
_WORD_OR_BREAK = re.compile(_WORD.pattern + "|\n")
_han_value = lru_cache(1 << 16)(han_number)


@lru_cache(1 << 17)
def _word_ids(w: str) -> tuple[int, ...]:
    """Numbers of the tokens of an English word."""
    return tuple(map(token_id, tokens(w, "en")[0]))


def _small(x) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    x = np.asarray(x)
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def read_lines(texts: list[str], name: str) -> dict[str, np.ndarray]:
    """Lines of many texts at once, as :func:`tokens` reads them one by one.

    t: lines a text; w: distinct tokens; l: distinct tokens a line; c, n: place in w and count of each; xl:
    distinct numbers a line; x: these; f: flags a line, 1: not blank, 2: it runs on.
    """
    lines = "\n".join(texts).split("\n")
    ends = [x.rstrip()[-1:] for x in lines]
    flags = np.array([(e != "") + 2 * (e in _RUN) for e in ends], dtype=np.uint8)
    bare = "\n".join([x if x.isascii() or unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x) for x in lines])
    bare = _NOTE.sub(" ", bare)
    if name == "hj":
        bare = bare.translate(_LINES)
    arr = codes(bare)
    line = np.cumsum(arr == 10)
    nums = set()
    for m in (_HAN_NUM if name == "hj" else _NUM).finditer(bare):
        try:
            v = _han_value(m[0]) if name == "hj" else int(m[0].replace(",", ""))
        except ValueError:
            continue
        if v < 1 << 62:
            nums.add((int(line[m.start()]), v))
    nums = np.array(sorted(nums), dtype=np.int64).reshape(-1, 2)
    if name == "en":
        which, words = pd.factorize(np.array(_WORD_OR_BREAK.findall(bare), dtype=object))
        ids = [() if w == "\n" else _word_ids(w) for w in words]
        size = np.array([len(x) for x in ids], dtype=np.int64)
        vocabulary, flat = np.unique(np.array([w for x in ids for w in x], dtype=np.int64), return_inverse=True)
        of = np.cumsum(np.array([w == "\n" for w in words], dtype=bool)[which]) if len(which) else np.zeros(0, dtype=np.int64)
        n = size[which]
        line, code = np.repeat(of, n), flat[_ranges((np.cumsum(size) - size)[which], n)]
    else:
        keep = _SYLLABLES[arr] if name == "oko" else ~_NUMERAL[arr] & (arr != 10)
        arr, line = arr[keep], line[keep]
        there = np.zeros(_TOP, dtype=bool)
        there[arr] = True
        vocabulary = np.flatnonzero(there)
        place = np.zeros(_TOP, dtype=np.int32)
        place[vocabulary] = np.arange(len(vocabulary))
        code = place[arr]
    key, n = np.unique(line * len(vocabulary) + code, return_counts=True)
    line, code = np.divmod(key, max(1, len(vocabulary)))
    count = lambda x: _small(np.bincount(x, minlength=len(lines)))
    return {"t": _small([x.count("\n") + 1 for x in texts]), "w": vocabulary.astype(np.int64), "l": count(line), "c": _small(code), "n": _small(n), "xl": count(nums[:, 0]), "x": nums[:, 1], "f": flags}


def text_lines(text: str, name: str) -> list[Line]:
    """(distinct tokens, distinct numbers, flags) of each line; flag 1: not blank, 2: it runs on."""
    d = read_lines([text], name)
    ends, nums = np.cumsum(d["l"], dtype=np.int64), np.cumsum(d["xl"], dtype=np.int64)
    return list(zip([x.tolist() for x in np.split(d["w"][d["c"]], ends[:-1])], [x.tolist() for x in np.split(d["x"], nums[:-1])], d["f"].tolist(), strict=True))


#: Columns of one side in the table of lines: a block of texts as :func:`read_lines` gives it; the ids of the records are with the hj side.
_SIDE = "{0} binary"


def _packed(d: dict[str, np.ndarray]) -> bytes:
    x = pickle.dumps(d)
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _unpacked(x: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(pa.decompress(memoryview(x)[8:], int.from_bytes(x[:8], "little"), codec="zstd"))


def _read(name: str, rows: int = 1000, chars: int = 400_000):
    """Blocks of records as their lines' tokens, small enough for an executor to hold many; ``rec_id`` is the first one's."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            size = whole["text_hj"].str.len().to_numpy() + whole["side"].str.len().to_numpy()
            for _, b in whole.groupby(np.maximum.accumulate(np.maximum(np.arange(len(whole)) // rows, np.cumsum(size) // chars)) if len(whole) else []):
                h = read_lines(b["text_hj"].tolist(), "hj") | {"id": b["rec_id"].to_numpy()}
                yield pd.DataFrame({"rec_id": b["rec_id"].iloc[:1], "h": [_packed(h)], "k": [_packed(read_lines(b["side"].tolist(), name))]})

    return run


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, dict]]:
    """Both sides of each block of :func:`_read`."""
    for b in batches:
        for h, k in zip(b["h"], b["k"], strict=True):
            yield _unpacked(h), _unpacked(k)


def _starts(sizes: np.ndarray) -> np.ndarray:
    """First place of each run of so many, and the end of the last."""
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _places(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word in a sorted array, -1 where it is not there."""
    i = np.searchsorted(known, words)
    i[i == len(known)] = 0
    return np.where(known[i] == words, i, -1) if len(known) else np.full(len(words), -1)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first .. first + size - 1 of each pair, one after the other."""
    at = np.cumsum(size) - size
    return np.repeat(first - at, size) + np.arange(size.sum())


class Lexicon:
    """Which tokens explain which, without the commonest tokens: pairs of places, in order of the first."""

    def __init__(self, src: np.ndarray, tgt: np.ndarray, cells: np.ndarray, counts: np.ndarray, rare_src: np.ndarray, rare_tgt: np.ndarray, least: float = 0.05, lift: float = 5.0):
        self.n_src, self.n_tgt = len(src), len(tgt)
        k, h = np.divmod(cells, max(1, len(src)))
        by_h, by_k = np.bincount(h, counts, len(src)), np.bincount(k, counts, len(tgt))
        by_chance = by_h[h] * by_k[k] / max(counts.sum(), 1e-9)
        good = (counts >= least * np.maximum(by_h[h], 1e-9)) | (counts >= least * np.maximum(by_k[k], 1e-9)) | ((counts >= lift * by_chance) & (counts >= 2.0))
        good &= rare_src[h] & rare_tgt[k]
        self.src, self.tgt, self.rare_src, self.rare_tgt = src, tgt, rare_src, rare_tgt
        h, k = h[good], k[good]
        self.explained, self.start = k[np.argsort(h, kind="stable")], _starts(np.bincount(h, minlength=len(src)))


class Bits:
    """Bit sets of a block's lines, as 64-bit words: own tokens, and the tokens expected on the other side.

    Only the block's tokens have bits; a number is three bits, the same on both sides, numbered by record.
    """

    def __init__(self, h: dict, k: dict, lex: Lexicon):
        sides = []
        for d, known, rare in ((h, lex.src, lex.rare_src), (k, lex.tgt, lex.rare_tgt)):
            place = _places(known, d["w"])
            place[place >= 0] = np.where(rare[place[place >= 0]], place[place >= 0], -1)
            bit = np.where(place >= 0, np.cumsum(place >= 0) - 1, -1)
            line = np.repeat(np.arange(len(d["l"])), d["l"])
            ok = bit[d["c"]] >= 0
            sides.append((place[place >= 0], line[ok], bit[d["c"]][ok], len(d["l"]), _starts(d["t"])))
        (w_h, line_h, bit_h, n_h, self.h), (w_k, line_k, bit_k, n_k, self.k) = sides
        local = np.full(lex.n_tgt, -1)
        local[w_k] = np.arange(len(w_k))
        size = lex.start[w_h + 1] - lex.start[w_h]
        x, y = np.repeat(np.arange(len(w_h)), size), local[lex.explained[_ranges(lex.start[w_h], size)]]
        x, y = x[y >= 0], y[y >= 0]
        rec = [np.repeat(np.repeat(np.arange(len(d["t"])), d["t"]), d["xl"]) for d in (h, k)]
        both, values = np.concatenate(rec), np.unique(np.r_[h["x"], k["x"]], return_inverse=True)[1]
        key, at = np.unique(both * (len(values) + 1) + values, return_inverse=True)
        key //= len(values) + 1
        number = (np.arange(len(key)) - np.searchsorted(key, key))[at]
        self.own_h, self.expected_h = self._lines(h, line_h, bit_h, len(w_h), x, y, len(w_k), number[: len(rec[0])], number)
        self.own_k, self.expected_k = self._lines(k, line_k, bit_k, len(w_k), y, x, len(w_h), number[len(rec[0]) :], number)
        self.n_h, self.n_k = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (self.own_h, self.own_k))

    @staticmethod
    def _set(shape: tuple[int, int], row: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Rows with these bits on, each named once."""
        out = np.zeros(shape, dtype=np.uint64)
        np.add.at(out.reshape(-1), row * shape[1] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        return out

    def _lines(self, d, line, bit, n_own, x, y, n_other, number, numbers):
        n, own_words, other_words = len(d["l"]), -(-n_own // 64), -(-n_other // 64)
        own = self._set((n, own_words), line, bit)
        expects = self._set((n_own, other_words), x, y)
        other = np.zeros((n, other_words), dtype=np.uint64)
        if len(line):
            new = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            step = max(1, (1 << 22) // max(1, other_words))  # tokens at once
            edge = np.r_[new[np.r_[True, np.diff(new // step) > 0]], len(line)]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                mine = new[(new >= lo) & (new < hi)]
                other[line[mine]] = np.bitwise_or.reduceat(expects[bit[lo:hi]], mine - lo, axis=0)
        extra = np.zeros((n, int(numbers.max()) // 21 + 1 if len(numbers) else 0), dtype=np.uint64)
        if len(number):
            np.add.at(extra.reshape(-1), np.repeat(np.arange(n), d["xl"]) * extra.shape[1] + number // 21, np.uint64(7) << (3 * (number % 21)).astype(np.uint64))
        return np.concatenate([own, extra], axis=1), np.concatenate([other, extra], axis=1)

    def candidates(self, least: float, most: int = 1 << 22) -> tuple[np.ndarray, ...]:
        """(hj line, side line, lesser share): pairs of lines of a record with a share of ``least``, best first."""
        n, m = np.diff(self.h), np.diff(self.k)
        first, out = _starts(n * m), []
        step = max(1, most // (self.own_h.shape[1] + self.own_k.shape[1] + 1))
        for lo in range(0, max(1, int(first[-1])), step):
            p = np.arange(lo, min(lo + step, int(first[-1])))
            rec = np.searchsorted(first, p, "right") - 1
            i, j = np.divmod(p - first[rec], m[rec])
            a, b = self.h[rec] + i, self.k[rec] + j
            ok = (self.n_h[a] > 0) & (self.n_k[b] > 0)
            a, b, i, j, rec = a[ok], b[ok], i[ok], j[ok], rec[ok]
            f = np.bitwise_count(self.own_h[a] & self.expected_k[b]).sum(axis=1, dtype=np.int64) / self.n_h[a]
            g = np.bitwise_count(self.own_k[b] & self.expected_h[a]).sum(axis=1, dtype=np.int64) / self.n_k[b]
            ok = (f >= least) | (g >= least)
            a, b, i, j, rec, f, g = (x[ok] for x in (a, b, i, j, rec, f, g))
            out.append((rec, 0.65 * np.maximum(f, g) + 0.35 * np.minimum(f, g) - 0.03 * np.abs(i / n[rec] - j / m[rec]), a, b, np.minimum(f, g)))
        rec, score, a, b, low = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((b, a, -score, rec))
        return a[order], b[order], low[order]


def link_block(h: dict, k: dict, lex: Lexicon, least: float = 0.4, both: float = 0.15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, hj line, side line): linked lines of a block's records by competitive linking.

    A piece of a divided line that keeps few tokens of its own goes with its neighbour: where the
    neighbour's partner explains most of it, or where the text itself runs on over the line break.
    """
    x = Bits(h, k, lex)
    a, b, low = x.candidates(least)
    # A pair whose lines have no other candidate is judged as it stands.
    single = (np.bincount(a, minlength=len(x.n_h))[a] == 1) & (np.bincount(b, minlength=len(x.n_k))[b] == 1)
    out = list(zip(*(c[single & (low >= both)].tolist() for c in (a, b)), strict=True))
    whole = lambda rows: lru_cache(None)(lambda i: int.from_bytes(rows[i].tobytes(), "little"))
    own_a, exp_a, own_b, exp_b = map(whole, (x.own_h, x.expected_h, x.own_k, x.expected_k))
    na, nb = x.n_h.tolist(), x.n_k.tolist()
    used_a, used_b = {}, {}
    for i, j in zip(a[~single].tolist(), b[~single].tolist(), strict=True):
        free_a, free_b = own_a(i) & ~used_a.get(i, 0), own_b(j) & ~used_b.get(j, 0)
        f = (free_a & exp_b(j)).bit_count() / max(free_a.bit_count(), 0.4 * na[i])
        g = (free_b & exp_a(i)).bit_count() / max(free_b.bit_count(), 0.4 * nb[j])
        if max(f, g) >= least and min(f, g) >= both:
            used_a[i] = used_a.get(i, 0) | own_a(i) & exp_b(j)
            used_b[j] = used_b.get(j, 0) | own_b(j) & exp_a(i)
            out.append((i, j))
    mine: dict[int, list[int]] = {}
    for i, j in out:
        mine.setdefault(j, []).append(i)
    linked = np.zeros(len(nb), dtype=bool)
    linked[list(mine)] = True
    flags = k["f"].tolist()
    rec = np.repeat(np.arange(len(k["t"])), k["t"])
    alone = np.flatnonzero(~linked & (k["f"] & 1 == 1))
    for j, lo, hi in zip(alone.tolist(), x.k[rec[alone]].tolist(), x.k[rec[alone] + 1].tolist(), strict=True):
        before, after = mine.get(j - 1) if j > lo else None, mine.get(j + 1) if j + 1 < hi else None
        runs_on = j > lo and flags[j - 1] != 1
        runs_out = flags[j] != 1
        share = lambda i: (own_b(j) & exp_a(i)).bit_count() / nb[j] if nb[j] else 0.0  # noqa: B023, E731
        near = [(share(i) + (1.0 if (n == 0 and runs_on) or (n == 1 and runs_out) else 0.0), i) for n, y in enumerate((before, after)) for i in (y or ())]
        if near:
            v, i = max(near, key=lambda y: (y[0], -y[1]))
            if v >= 0.75:
                out.append((i, j))
                if runs_out or runs_on:
                    mine[j] = [i]
    i, j = np.array(out, dtype=np.int64).reshape(-1, 2).T
    return rec[j], i - x.h[rec[j]], j - x.k[rec[j]]


def _block(lines: list[Line]) -> dict[str, np.ndarray]:
    """One text's lines as a block."""
    w, c = np.unique(np.array([t for x in lines for t in x[0]], dtype=np.int64), return_inverse=True)
    return {"t": np.array([len(lines)]), "w": w, "c": c, "l": np.array([len(x[0]) for x in lines]), "x": np.array([v for x in lines for v in x[1]], dtype=np.int64), "xl": np.array([len(x[1]) for x in lines]), "f": np.array([x[2] for x in lines], dtype=np.uint8)}


def link_lines(hj: list[Line], side: list[Line], lex: Lexicon) -> list[tuple[int, int]]:
    """Linked (hj line, side line) pairs of one record."""
    _, i, j = link_block(_block(hj), _block(side), lex)
    return list(zip(i.tolist(), j.tolist(), strict=True))


class Pairs:
    """Training pairs of a block: each hj line with the lines of the other side near its proportional
    place, one more to each side."""

    def __init__(self, h: dict, k: dict):
        self.h, self.k = h, k
        self.h_ptr, self.k_ptr = _starts(h["l"]), _starts(k["l"])
        n, m = h["t"].astype(np.int64), k["t"].astype(np.int64)
        rec = np.repeat(np.arange(len(n)), n)
        place = (np.arange(len(rec)) - (np.cumsum(n) - n)[rec] + 0.5) * m[rec] / n[rec]
        first = (np.cumsum(m) - m)[rec]
        self.lo = first + np.maximum(0, (place - 1.3).astype(np.int64))
        self.hi = first + np.minimum(m[rec], (place + 1.3).astype(np.int64) + 1)

    def pairs_of(self) -> tuple[np.ndarray, np.ndarray]:
        """(first pair, number of pairs) of each line of the other side."""
        line = np.arange(len(self.k["l"]))
        first = np.searchsorted(self.hi, line, "right")
        return first, np.searchsorted(self.lo, line, "right") - first

    def seen(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Distinct tokens of each side and the number of pairs that have them."""
        h, k, words = self.h, self.k, len(self.k["w"])
        # The pairs of a line are a range, and both its ends grow with the line: each token adds what is new of it.
        order = np.argsort(k["c"], kind="stable")
        line, c = np.repeat(np.arange(len(k["l"])), k["l"])[order], k["c"][order]
        first, size = self.pairs_of()
        lo, hi = first[line], (first + size)[line]
        before = np.r_[0, np.where(c[1:] == c[:-1], hi[:-1], 0)][: len(c)]
        n = np.bincount(c, np.maximum(0, hi - np.maximum(lo, before)), words).astype(np.int64)
        return {"h": (h["w"], np.bincount(h["c"], minlength=len(h["w"]))), "k": (k["w"][n > 0], n[n > 0])}

    def known(self, src: np.ndarray, tgt: np.ndarray, dense: np.ndarray) -> None:
        """Tokens by place in ``src`` and ``tgt``, unknown ones left out; those of ``dense`` places apart."""
        def put(d, place, ptr):
            i = place[d["c"]]
            ok = i >= 0
            return i[ok], d["n"][ok].astype(np.float32), _starts(ok)[ptr]

        self.hs = put(self.h, _places(src, self.h["w"]), self.h_ptr)
        place = _places(tgt, self.k["w"])
        column = np.full(len(tgt) + 1, -1)
        column[dense] = np.arange(len(dense))
        self.ks = put(self.k, np.where(column[place] < 0, place, -1), self.k_ptr)
        self.kd = put(self.k, column[place], self.k_ptr)

    def dense(self, t: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """Sum over the pairs of the times of each token of ``t``'s rows by those of each hj token, over what explains it."""
        total = np.zeros(t.shape)
        step = max(1, most // sum(t.shape))
        (h, hn, hp), (k, kn, kp) = self.hs, self.kd
        for x in range(0, len(self.lo), step):
            y = min(x + step, len(self.lo))
            a = np.zeros((y - x, t.shape[1]), dtype=np.float32)
            a[np.repeat(np.arange(y - x), np.diff(hp[x : y + 1])), h[hp[x] : hp[y]]] = hn[hp[x] : hp[y]]
            first, last = self.lo[x], self.hi[y - 1]
            b = np.zeros((last - first + 1, t.shape[0]), dtype=np.float32)
            b[np.repeat(np.arange(1, len(b)), np.diff(kp[first : last + 1])), k[kp[first] : kp[last]]] = kn[kp[first] : kp[last]]
            np.cumsum(b, axis=0, out=b)
            w = b[self.hi[x:y] - first] - b[self.lo[x:y] - first]
            w /= np.maximum(a @ t.T, 1e-12)
            total += w.T @ a
        return total

    def cells(self, width: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(cells, times of their hj tokens, times of the other token): a row for each token of a pair that
        is not dense, with as many cells as the pair has hj tokens; in parts of about ``most`` cells, by
        number of hj tokens and then by token, so that a part's cells lie close together."""
        (h, hn, hp), (k, kn, kp) = self.hs, self.ks
        order = np.argsort(_small(k), kind="stable")
        line = np.repeat(np.arange(len(kp) - 1), np.diff(kp))[order]
        first, n = self.pairs_of()
        of, pair = np.repeat(order, n[line]), _ranges(first[line], n[line])
        n_h = np.diff(hp)
        order = np.argsort(_small(n_h)[pair], kind="stable")
        of, pair = of[order], pair[order]
        ends = np.cumsum(np.bincount(n_h[pair], minlength=1)).tolist()
        place = np.zeros(len(n_h), dtype=np.int64)
        for size in np.unique(n_h[n_h > 0]).tolist():
            own = np.flatnonzero(n_h == size)
            if size >= len(ends) or ends[size] == ends[size - 1]:
                continue
            place[own] = np.arange(len(own))
            tokens_of = hp[own][:, None] + np.arange(size)
            rows, times = h[tokens_of], hn[tokens_of]
            step = max(1, most // size)
            for x in range(ends[size - 1], ends[size], step):
                y = min(x + step, ends[size])
                at = rows.take(place[pair[x:y]], axis=0)
                at += (k[of[x:y]] * width)[:, None]
                yield at, times.take(place[pair[x:y]], axis=0), kn[of[x:y]]


def _count_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of training pairs with a token, for each side; the number of pairs has the token -1."""
    for h, k in _blocks(batches):
        pairs = Pairs(h, k)
        for side, (w, n) in pairs.seen().items():
            yield pd.DataFrame({"side": side, "w": np.r_[w, -1], "n": np.r_[n, len(pairs.lo)]})


def estimate(lines: DataFrame, rounds: int = 4) -> Lexicon:
    """Translation table from all records and all tokens that more than one training pair has.

    ``lines`` is a table of :func:`_read`. Expected counts are summed by the tasks, then by cell of the
    table; numbers are matched by value.
    """
    sc = lines.sparkSession.sparkContext
    seen = lines.mapInPandas(_count_tokens, "side string, w long, n long").groupBy("side", "w").agg(F.sum("n").alias("n")).where("n > 1 or w = -1").toArrow().to_pandas()
    pairs = int(seen["n"][seen["w"] == -1].max()) if len(seen) else 0
    (src, n_src), (tgt, n_tgt) = ((x["w"].to_numpy(dtype=np.int64), x["n"].to_numpy()) for x in (seen[(seen["side"] == c) & (seen["w"] != -1)].sort_values("w") for c in "hk"))
    cells, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    if len(src) and len(tgt):
        full = len(src) * len(tgt) <= CELLS
        if full:
            cells = np.arange(len(src) * len(tgt))
        else:
            cells = np.sort(lines.mapInPandas(_cells(src, tgt), "cell long").distinct().toArrow()["cell"].to_numpy())
        # Rows of frequent tokens are worked whole, by matrix products, where that costs less than their cells.
        dense = np.flatnonzero(n_tgt / pairs * (n_src.sum() / pairs) * _PRODUCT >= len(src)) if full else np.zeros(0, dtype=np.int64)
        keys = sc.broadcast((src, tgt, None if full else cells, dense))
        counts = np.ones(len(cells), dtype=np.float32)
        h = cells % len(src)
        for _ in range(rounds):
            table = sc.broadcast((counts / np.maximum(np.bincount(h, counts, len(src)), 1e-9)[h]).astype(np.float32))
            part = lines.mapInPandas(_expect(table, keys), "block int, c binary")
            counts = np.zeros(len(cells), dtype=np.float32)
            for block, c in part.groupBy("block").applyInPandas(_add_blocks, "block int, c binary").collect():
                c = np.frombuffer(c, dtype=np.float32)
                counts[block * _BLOCK : block * _BLOCK + len(c)] = c
            table.unpersist()
        keys.unpersist()
    return Lexicon(src, tgt, cells, counts, n_src <= 0.12 * pairs, n_tgt <= 0.4 * pairs)


def _add_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Sum of the tasks' counts for one block of cells."""
    total = np.sum([np.frombuffer(c, dtype=np.float32) for c in rows["c"]], axis=0, dtype=np.float64)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "c": [total.astype(np.float32).tobytes()]})


def _cells(src: np.ndarray, tgt: np.ndarray):
    """Pairs of tokens that occur together, each once a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for h, k in _blocks(batches):
            pairs = Pairs(h, k)
            pairs.known(src, tgt, np.zeros(0, dtype=np.int64))
            for at, *_ in pairs.cells(len(src), 1 << 20):
                yield pd.DataFrame({"cell": np.unique(at)})

    return run


def _expect(table, keys):
    """Expected counts of a task's pairs, in blocks of cells."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t: np.ndarray = table.value
        src, tgt, cells, dense = keys.value
        total = np.zeros(len(t))
        rows = t.reshape(len(tgt), len(src))[dense] if len(dense) else None
        products = 0.0
        for h, k in _blocks(batches):
            pairs = Pairs(h, k)
            pairs.known(src, tgt, dense)
            if len(dense):
                products += pairs.dense(rows)
            for at, hn, kn in pairs.cells(len(src)):
                if cells is not None:
                    at = np.searchsorted(cells, at)
                w = t.take(at)
                w *= hn
                w *= (kn / np.maximum(w @ np.ones(w.shape[1], dtype=np.float32), 1e-12))[:, None]
                np.add.at(total, at.reshape(-1), w.reshape(-1).astype(np.float64))
        if len(dense):
            total.reshape(len(tgt), len(src))[dense] += rows * products
        for lo in range(0, len(total), 64 * _BLOCK):  # 64 blocks to a batch
            blocks = [(i // _BLOCK, total[i : i + _BLOCK]) for i in range(lo, min(len(total), lo + 64 * _BLOCK), _BLOCK)]
            blocks = [(i, c.astype(np.float32).tobytes()) for i, c in blocks if c.any()]
            if blocks:
                yield pd.DataFrame(blocks, columns=["block", "c"])

    return run


def linked_lines(aligned: DataFrame, side: str, column: str) -> DataFrame:
    """(rec_id, side, hj_no, side_no) for every record that has both texts.

    Null texts and rows without rec_id give no row; blank lines have numbers but are linked to nothing; a record whose lines
    share nothing gives no row.
    """
    rows = aligned.where(F.col("rec_id").isNotNull() & F.col("text_hj").isNotNull() & F.col(column).isNotNull()).select("rec_id", "text_hj", F.col(column).alias("side"))
    lines = cut(rows.mapInPandas(_read(side), f"rec_id long, {_SIDE.format('h')}, {_SIDE.format('k')}"), "lines")
    lex = aligned.sparkSession.sparkContext.broadcast(estimate(lines))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = lex.value
        for h, k in _blocks(batches):
            rec, i, j = link_block(h, k, model)
            yield pd.DataFrame({"rec_id": h["id"][rec], "side": side, "hj_no": i.astype(np.int32), "side_no": j.astype(np.int32)})

    return lines.mapInPandas(run, "rec_id long, side string, hj_no int, side_no int")


def aligned_lines(aligned: DataFrame) -> DataFrame:
    """Both sides of all records."""
    return linked_lines(aligned, "oko", "text_oko").unionAll(linked_lines(aligned, "en", "text_en"))
