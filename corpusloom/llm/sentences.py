"""Problem 7: sentence boundaries across languages and scripts.

A text gives places where a sentence may end: end marks with what closes after them, line breaks,
wide blanks, final particles, and the place before a mark that opens an entry. Whole spans between
such places are scored jointly: how long the span is, how it opens, how it closes and whether its
quotations are balanced; semi-Markov dynamic programming takes the best sequence of spans.

What openings and closings look like is learned from the corpus itself: counts at boundaries that
are sure (ends of texts, end marks followed by a separator where the text uses separators) against
counts at all places of the same kind. Features are hashed into tables of fixed size, summed over
all texts by Spark, so the model does not grow with the corpus.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: At least the greatest length term: 0.3 * log(4 / 3).
LONGEST = 0.1
OPEN, CLOSE = "「『“‘〈《（(〔［[", "」』”’〉》）)〕］]"
_PAIR = dict(zip(CLOSE, OPEN, strict=True))
_MARKS = "。．｡.！？!?…‥"
# The other characters with the Unicode property Sentence_Terminal, of all scripts.
_MARKS += "".join(c for c in regex.findall(r"\p{SB=STerm}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))) if c not in _MARKS)
_ENTRY = "○◯●◎〇"
# Particles that close a sentence of classical Chinese.
PARTICLES = "矣焉也云哉耳乎"


class _Scripts(dict):
    """translate() table of script signs, filled on demand: h Han, k kana, g Hangul, l the alphabets that
    end sentences with a full stop, a all other letters."""

    def __missing__(self, cp: int) -> str | None:
        c = chr(cp)
        out = "h" if 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF else "k" if 0x3040 <= cp <= 0x30FA else "g" if 0xAC00 <= cp <= 0xD7A3 else "l" if c.isalpha() and (cp < 0x600 or 0x10A0 <= cp < 0x1100 or 0x1E00 <= cp < 0x2000) and cp not in (0xAA, 0xB5, 0xBA) else "a" if c.isalpha() else None
        self[cp] = out
        return out


_SCRIPTS = _Scripts()


def kind_of(text: str) -> str:
    """ja, ko, en (alphabets with full stops), any (other scripts) or han, by the letters of the text."""
    signs = text.translate(_SCRIPTS)
    han, kana, hangul, latin, other = (signs.count(x) for x in "hkgla")
    if other > han + kana + hangul + latin:
        return "any"
    if kana * 8 > han + kana and kana * 2 > latin:
        return "ja"
    if hangul > latin and hangul * 2 > han:
        return "ko"
    return "en" if latin > han else "han"


# English abbreviations; the first never end a sentence, the others may.
NEVER_LAST = "dr mr mrs ms prof lt gen col capt sgt rev hon st vol vols no nos fig figs cf pp ch sec ed eds p b d c e.g i.e viz vs approx ca".split()
MAY_LAST = "etc esq a.m p.m co inc ltd jr sr cent u.s al".split()
_NUMERAL = re.compile("[0-9０-９][0-9０-９,.]*|[一二三四五六七八九十百千]+")


class Place:
    """A place where a sentence may end."""

    __slots__ = ("end", "nxt", "how", "sep", "close", "open", "depth")

    def __init__(self, end: int, nxt: int, how: str, sep: str, close: str, opening: str, depth: int):
        self.end, self.nxt, self.how, self.sep, self.close, self.open, self.depth = end, nxt, how, sep, close, opening, depth


def _first(text: str, at: int, kind: str) -> str:
    """How a sentence opens, numbers written as #."""
    while at < len(text) and text[at] in OPEN + "\"'" + _ENTRY:
        at += 1
    if kind in ("en", "ko"):
        m = re.compile(r"\S+").match(text, at)
        return _word(m.group(), kind) if m else ""
    return _NUMERAL.sub("#", text[at : at + 8])[:2]


def _word(w: str, kind: str) -> str:
    w = _NUMERAL.sub("#", w)
    return w[:3] if kind == "ko" else w.strip(".,;:!?\"'()")


def _last(text: str, end: int, kind: str) -> str:
    """What closes before the marks that end at ``end``."""
    k = end
    while k > 0 and (text[k - 1] in CLOSE + "\"'"):
        k -= 1
    j = k
    while j > 0 and text[j - 1] in _MARKS:
        j -= 1
    marks = text[j:k]
    tag = "…" if marks[:1] in "…‥" or len(marks) >= 3 else ""
    if len(marks) == 2 and marks in ("……", ".."):
        tag = "……"
    if kind == "en":
        i = j
        while i > 0 and not text[i - 1].isspace() and j - i < 24:
            i -= 1
        return _NUMERAL.sub("#", text[i:j].lstrip("\"'([{")) + tag
    if kind == "ko":
        return text[max(0, j - 1) : j] + tag
    return text[max(0, j - 2) : j] + tag


_SPECIAL = {
    k: re.compile("[" + re.escape(_MARKS) + "]+|[" + re.escape(OPEN + CLOSE + "\"'＂") + "]|[○◯●◎]" + more)
    for k, more in (("han", rf"|\s+|[{PARTICLES}]"), ("ja", r"|\s+"), ("ko", r"|\s*[\n\u2028\u2029\u3000]\s*|\s\s+"), ("en", r"|\s*[\n\u2028\u2029\u3000]\s*|\s\s+"), ("any", r"|\s*[\n\u2028\u2029\u3000]\s*|\s\s+"))
}
_GO_ON = "、，,；;：:،؛"


def places(text: str, kind: str) -> list[Place]:
    """All places where a sentence may end, in order; the last is the end of the text.

    One pass over the characters that matter: marks, quotations and brackets, separators, entry
    marks and final particles. Quotations are followed on a stack, so each place knows how many are
    open and, behind a closing one, what stands before its opening.
    """
    n = len(text.rstrip())
    if n == 0:
        return []
    out: list[Place] = []
    stack: list[tuple[str, int]] = []
    done = 0

    def quote(i: int) -> int:
        """Follow the quotation sign at i; place of the opening it closes, or -1."""
        c = text[i]
        if c in OPEN:
            stack.append((c, i))
        elif c in _PAIR:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == _PAIR[c]:
                    at = stack[k][1]
                    del stack[k:]
                    return at
        else:
            before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
            top = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), -1)
            if c == "'" and before.isalnum() and after.isalnum() and kind == "en":
                return -1
            if top >= 0 and not (before.isspace() and not after.isspace()):
                at = stack[top][1]
                del stack[top:]
                return at
            if top < 0 and not after.isspace():
                stack.append((c, i))
        return -1

    for m in _SPECIAL[kind].finditer(text, 0, n):
        i, j = m.span()
        if i < done:
            continue
        c = text[i]
        if c in _MARKS:
            end, opened, closes = j, -1, False
            while end < n and (text[end] in _PAIR or text[end] in "\"'＂"):
                held = len(stack)
                at = quote(end)
                if len(stack) >= held:
                    if len(stack) > held:
                        stack.pop()  # it opens something behind the mark; followed again below
                    break
                opened, closes, end = at, True, end + 1
            done = end
            ascii_next = j < n and text[j].isascii() and text[j].isalnum()
            number = j - i == 1 and c in ".．" and j < n and text[j].isdigit() and i > 0 and text[i - 1].isdigit()
            letter = j - i == 1 and c == "." and end == j and ascii_next and i > 0 and text[i - 1].isascii()
            if number or letter or text[j : j + 1] in _GO_ON and j < n or text[end : end + 1] in _GO_ON and end < n:
                continue
            how = "e" if c in "…‥" or j - i >= 3 else "m"
            close = _last(text, end, kind)
            if closes:
                last = text[end - 1]
                how = "b" if last in "）)〕］]" else "q"
                if how == "q":
                    close = last + text[max(0, opened - 2) : max(0, opened)]
            out.append(_make(text, end, how, close, kind, len(stack), n))
        elif c.isspace():
            if i > 0 and not (out and out[-1].end == i):
                run = m.group()
                how = "n" if "\n" in run or "\u2028" in run or "\u2029" in run else "w" if "\u3000" in run or len(run) > 1 else "s"
                out.append(_make(text, i, how, _last(text, i, kind), kind, len(stack), n))
        elif c in "○◯●◎":
            if i > 0 and not (out and out[-1].nxt == i):
                out.append(_make(text, i, "o", _last(text, i, kind), kind, len(stack), n))
        elif c in PARTICLES and kind == "han" and c not in OPEN:
            if j < n and not text[j].isspace() and text[j] not in _MARKS and text[j] not in CLOSE and text[j] not in _GO_ON:
                out.append(_make(text, j, "p", text[max(0, i - 1) : j], kind, len(stack), n))
        else:
            quote(i)
    lead = len(text) - len(text.lstrip())
    out = [p for p in out if lead < p.end < n]
    out.append(Place(n, n, "z", "", _last(text, n, kind), "", len(stack)))
    return out


def _make(text: str, end: int, how: str, close: str, kind: str, depth: int, n: int) -> Place:
    nxt = end
    while nxt < n and text[nxt].isspace():
        nxt += 1
    e = end
    while e > 0 and text[e - 1].isspace():
        e -= 1
    return Place(e, nxt, how, text[end:nxt] + ("○" if text[nxt : nxt + 1] in _ENTRY[:4] else ""), close, _first(text, nxt, kind), depth)


def marked(ps: list[Place], length: int) -> bool:
    """Whether the text writes end marks: one in 120 characters at least, outside quotations."""
    return sum(p.how in "mqbe" and p.depth == 0 for p in ps) * 120 >= length or any(p.how == "m" and p.depth == 0 for p in ps)


def spaced(ps: list[Place]) -> bool:
    """Whether the text sets a separator after its sentences."""
    m = [p for p in ps[:-1] if p.how == "m" and p.depth == 0]
    return len(m) >= 2 and sum(bool(p.sep) for p in m) >= 0.9 * len(m)


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "ignore")) % BUCKETS


def observe(text: str, counts: Counter) -> None:
    """Add a text's sure boundaries and its background to the counts (kind, table, feature); None sums all."""
    kind = kind_of(text)
    ps = places(text, kind)
    if not ps:
        return
    use_marks, sep = marked(ps, len(text)), spaced(ps)

    def add(table: str, feature: str) -> None:
        counts[kind, table, feature] += 1
        counts[kind, table, None] += 1

    lead = len(text) - len(text.lstrip())
    if use_marks or kind == "han":
        add("open+", _first(text, lead, kind))
        add("open1+", _first(text, lead, kind)[:1])
    last = 0
    for p in ps:
        if p.depth:
            continue
        strong = "\n" in p.sep or "　" in p.sep or "  " in p.sep or "○" in p.sep
        if p.how in "mebq":
            group = p.how if p.how in "qe" else "m"
            add(f"close{group}", p.close)
            sure = strong or (p.how in "qeb" and sep and bool(p.sep) and kind in ("han", "ja")) or (p.how == "m" and kind in ("han", "ja", "any"))
            if sure:
                add(f"close{group}+", p.close)
                if p.open:
                    add("open+", p.open)
                    add("open1+", p.open[:1])
                size = p.end - last
                counts[kind, "size+", "#%d" % min(40, int(4 * math.log2(max(1, size))))] += 1
                last = p.nxt
        elif p.how == "z" and use_marks and text[p.end - 1] in _MARKS + CLOSE + "\"'":
            group = "q" if text[p.end - 1] in "」』”’\"'" else "e" if text[p.end - 1] in "…‥" else "m"
            if group != "q":
                add(f"close{group}", p.close)
                add(f"close{group}+", p.close)
    raw = counts.setdefault(("raw", kind), Counter())
    if kind in ("en", "ko"):
        raw.update(text.split())
    else:
        t = _NUMERAL.sub("#", text)
        raw.update(map(operator.add, t, t[1:]))


def hashed(counts: Counter) -> Counter:
    """Counts by slot instead of feature: -1 for all, the size itself for sizes."""
    out: Counter = Counter()
    for key in [k for k in counts if k[0] == "raw"]:
        kind = key[1]
        for w, n in counts.pop(key).items():
            f = _word(w, kind) if kind in ("en", "ko") else w
            for table, x in (("open", f), ("open1", f[:1])):
                out[kind, table, _slot(x)] += n
                out[kind, table, -1] += n
    for (kind, table, f), n in counts.items():
        out[kind, table, -1 if f is None else int(f[1:]) if table == "size+" else _slot(f)] += n
    return out


class Model:
    """Log odds of openings and closings and the length term."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        self.c = counts
        self.memo: dict[tuple, float] = {}
        self.sizes: dict[str, dict[int, float]] = {}

    def ratio(self, kind: str, table: str, feature: str, k: float = 2.0) -> float:
        key = (kind, table, feature)
        got = self.memo.get(key)
        if got is None:
            s = _slot(feature)
            n_sure, n_all = self.c.get((kind, table + "+", -1), 0), self.c.get((kind, table, -1), 0)
            r = max(1e-6, min(1.0, n_sure / n_all)) if n_all else 1.0
            a, b = self.c.get((kind, table + "+", s), 0), self.c.get((kind, table, s), 0)
            k = max(k, 1 / r) if table.startswith("close") else k
            got = max(-4.0, min(4.0, math.log((a + k * r) / (max(a, b) * r + k * r)))) if n_all else 0.0
            self.memo[key] = got
        return got

    def opening(self, kind: str, feature: str) -> float:
        if not feature:
            return 0.0
        full = self.ratio(kind, "open", feature)
        return full if kind == "en" else 0.6 * full + 0.4 * self.ratio(kind, "open1", feature[:1])

    def length(self, kind: str, size: int) -> float:
        memo = self.sizes.setdefault(kind, {})
        got = memo.get(size)
        if got is None:
            at = min(40, int(4 * math.log2(max(1, size))))
            near = sum(self.c.get((kind, "size+", at + d), 0) * w for d, w in ((-2, 0.5), (-1, 1), (0, 1), (1, 1), (2, 0.5)))
            best = max((self.c.get((kind, "size+", x), 0) for x in range(41)), default=0) * 3 + 1
            got = memo[size] = max(-2.0, 0.3 * math.log((near + 0.5) / best))
        return got

    def boundary(self, p: Place, kind: str, use_marks: bool, sep: bool, wide: bool) -> float:
        """Log odds that a sentence ends at this place."""
        if p.how == "z":
            return 0.0
        o = self.opening(kind, p.open)
        strong = "\n" in p.sep or "　" in p.sep or "  " in p.sep or "○" in p.sep
        lower = p.open[:1].islower() and kind == "en"
        if p.how == "o":
            return 5.0
        if p.how == "m":
            if kind in ("han", "ja", "any"):
                return 6.0
            base = 4.0 + self.ratio(kind, "closem", p.close) + 0.5 * max(-3.0, o)
            if kind == "en":
                w = p.close.lower()
                base -= 5.0 if w in NEVER_LAST or (len(w) == 1 and w.isalpha()) else 2.5 if w in MAY_LAST or (len(w) == 2 and w[1] == ".") or re.fullmatch("(\\w\\.)+\\w", w) else 0.0
            return base + (2.0 if strong else 0.0) - (5.0 if lower else 0.0)
        if p.how == "b":
            return 2.5 + 0.5 * o + (2.0 if strong else 0.0) - (5.0 if lower else 0.0) if kind in ("en", "ko") else (1.0 if p.sep else -3.0) + o
        if p.how in "qe":
            extra = 2.0 if p.sep and (sep or strong) else -2.5 if sep and not p.sep else 0.0
            if p.how == "q" and kind in ("han", "ja"):
                base = 1.0 + 2.0 * self.ratio(kind, "closeq", p.close) + 0.5 * o + extra
            else:
                base = 2.0 + (1.2 * self.ratio(kind, "closee", p.close) if p.how == "e" else 0.0) + 0.7 * o + extra
            if kind == "ko" and p.how == "q":
                base -= 3.0
            return base - (6.0 if lower else 0.0)
        if p.how == "n":
            return (2.5 + 0.7 * o) if not use_marks and kind in ("han", "ja") else -4.0 + 0.5 * o
        if p.how == "w":
            return (2.5 + 0.7 * o) if not use_marks and kind in ("han", "ja") else -3.0 + 0.5 * o
        if p.how == "s":
            return (1.5 + o + (2.0 if p.close[-1:] in PARTICLES else 0.0)) if not use_marks and kind in ("han", "ja") else -5.0
        if p.how == "p":
            return -6.0 if use_marks else (-2.0 if wide else 1.5) + o
        return 0.0


def ends(text: str, model: Model) -> list[int]:
    """End of each sentence: code points up to and including its last non-blank one."""
    kind = kind_of(text)
    ps = places(text, kind)
    if not ps:
        return []
    use_marks, sep = marked(ps, len(text)), spaced(ps)
    wide = any(p.how in "nws" for p in ps)
    lead = len(text) - len(text.lstrip())
    score = [model.boundary(p, kind, use_marks, sep, wide) for p in ps]
    best: list[float] = []
    back: list[int] = []
    high: list[float] = []  # the greatest of 0 and best so far
    length, sizes = model.length, model.sizes.setdefault(kind, {})
    start, depth, sure = [p.nxt for p in ps], [p.depth for p in ps], [x >= 5.0 and p.depth == 0 for x, p in zip(score, ps, strict=True)]
    for j, p in enumerate(ps):
        top, arg, end, d = -math.inf, -1, p.end, p.depth
        for i in range(j - 1, -1, -1):
            if high[i] + LONGEST <= top:
                break  # no span from here or before scores more
            size = end - start[i]
            if size > 0:
                n = sizes.get(size)
                v = best[i] + (length(kind, size) if n is None else n)
                if d != depth[i]:
                    v -= 6.0 * min(2, abs(d - depth[i]))
                if v > top:
                    top, arg = v, i
                if sure[i]:
                    break  # no span reaches over a place as sure as this
        else:
            if end > lead:
                v = length(kind, end - lead) - 6.0 * min(2, d)
                if v > top:
                    top, arg = v, -1
        best.append(top + score[j] if top > -math.inf else -1e9)
        back.append(arg)
        high.append(max(0.0, best[-1], high[-1] if high else 0.0))
    out, j = [], len(ps) - 1
    while j >= 0:
        out.append(ps[j].end)
        j = back[j]
    return out[::-1]


def learn(texts: DataFrame) -> Model:
    """Counts of all texts; the collected table has at most a fixed number of slots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        total: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                observe(t, c)
            if sum(len(v) for k, v in c.items() if k[0] == "raw") > 400_000:
                total.update(hashed(c))
                c.clear()
        total.update(hashed(c))
        yield pd.DataFrame([(k, f, s, n) for (k, f, s), n in total.items()], columns=["kind", "feature", "slot", "n"])

    rows = texts.where("text is not null").select("text").mapInPandas(run, "kind string, feature string, slot int, n long")
    got = rows.groupBy("kind", "feature", "slot").agg(F.sum("n").alias("n")).where("n > 1 or slot < 0").toArrow().to_pandas()
    return Model({(k, f, s): n for k, f, s, n in zip(got["kind"], got["feature"], got["slot"], got["n"], strict=True)})


def sentence_ends(texts: DataFrame) -> DataFrame:
    """(text_id, end_at): one row for each sentence. Null and blank texts and rows without text_id have none."""
    model = texts.sparkSession.sparkContext.broadcast(learn(texts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            out = [(i, e) for i, t in zip(b["text_id"], b["text"], strict=True) for e in ends(t, m)]
            yield pd.DataFrame(out, columns=["text_id", "end_at"])

    return texts.where("text_id is not null and text is not null").select("text_id", "text").mapInPandas(run, "text_id long, end_at int")


def sentences(texts: DataFrame) -> DataFrame:
    """(text_id, sent_no, start_at, end_at, sentence): the sentences themselves, numbered from 0."""
    e = sentence_ends(texts)
    per = e.groupBy("text_id").agg(F.array_sort(F.collect_list("end_at")).alias("ends"))  # sentences of one text
    d = texts.select("text_id", "text").join(per, "text_id").select("text_id", "text", F.posexplode("ends").alias("sent_no", "end_at"), "ends")
    prev = F.when(F.col("sent_no") == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest(F.col("sent_no"), F.lit(1))))
    part = F.expr("substring(text, prev + 1, end_at - prev)")
    d = d.withColumn("prev", prev).withColumn("part", part).withColumn("sentence", F.regexp_replace("part", r"^[\s\p{Z}]+", ""))
    return d.select("text_id", "sent_no", (F.col("end_at") - F.length("sentence")).alias("start_at"), "end_at", "sentence")
