"""Problem 6: token budget per source and language.

A text is normalised and pre-split as its tokenizer does; every distinct piece is tokenized once;
the lengths are joined with the pieces' frequencies in each document, which gives exact totals.
Two kinds of tokenizers are covered: byte-level BPE vocabularies of public tokenizers, and unigram
vocabularies given as a table of pieces with log probabilities.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import blank_to_null, source_name

#: Folder of vocabulary files, where the environment does not name another.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
#: A piece in more than 1 / HEAD of all rows of frequencies is joined by broadcast; there are fewer than HEAD.
HEAD = 4096
#: Pre-splitting of the byte-level vocabularies: contractions, letters, digits, marks, blanks.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Byte-level BPE from a vocabulary file of ranks."""

    def __init__(self, name: str = "byte_bpe_multi_50k.tiktoken", folder: str = TOKENIZERS):
        self.path = os.path.join(folder, name)
        self._enc = None

    def __getstate__(self):
        return {"path": self.path, "_enc": None}

    @property
    def encoding(self):
        if self._enc is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._enc = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self._split = __import__("regex").compile(SPLIT)
        return self._enc

    def pieces(self, text: str) -> list[str]:
        """The tokenizer's own pre-splitting; the pieces joined give the text."""
        self.encoding  # noqa: B018
        return self._split.findall(text)

    def length(self, piece: str) -> int:
        """Tokens of one piece."""
        return len(self.encoding._encode_single_piece(piece.encode("utf-8", "replace")))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return len(self.encoding.encode_ordinary(text))


class Unigram:
    """Unigram tokenizer of a piece table: the segmentation of greatest total log probability.

    Normalisation is NFKC with runs of blanks as one; a word starts with the blank sign. A character
    in no piece is one unknown token. Pre-splitting is at blanks and around characters that stand in
    no piece of two or more characters: no token can reach over these, so totals stay exact.
    """

    UNKNOWN = 10.0

    def __init__(self, pieces: dict[str, float]):
        self.score = {p: s for p, s in pieces.items() if p}
        self.longest = max((len(p) for p in self.score), default=1)
        self.low = min(self.score.values(), default=0.0) - self.UNKNOWN
        inner = {c for p in self.score if len(p) > 1 for c in p}
        self.inner = "".join(sorted(inner - {"▁"}))
        self._inner = frozenset(inner | {"▁"})
        self._re = None

    def __getstate__(self):
        return self.__dict__ | {"_re": None}

    def pieces(self, text: str) -> list[str]:
        if self._re is None:
            cls = re.escape(self.inner)
            self._re = re.compile(f"▁?[{cls}]+|▁?[^▁{cls}]|▁" if cls else "▁?[^▁]|▁", re.S)
        words = unicodedata.normalize("NFKC", text).split()
        out = self._re.findall("▁" + "▁".join(words)) if words else []
        # A single character outside all longer pieces is one token, known or not: one piece stands for all of them.
        return [p if len(p) > 1 or p in self._inner else "\0" for p in out]

    def length(self, piece: str) -> int:
        n = len(piece)
        best = [0.0] + [float("-inf")] * n
        count = [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                s = self.score.get(piece[i:j])
                if s is None:
                    if j - i > 1:
                        continue
                    s = self.low
                v = best[i] + s
                if v > best[j]:
                    best[j], count[j] = v, count[i] + 1
        return count[n]

    def count(self, text: str) -> int:
        return sum(self.length(p) for p in self.pieces(text))


def unigram_from(vocab: DataFrame, most: int = 1_000_000) -> Unigram:
    """Tokenizer of a vocab_piece table (checked to be of a vocabulary's size); piece 0 is the unknown one."""
    rows = vocab.where("piece is not null and piece_id <> 0").groupBy("piece").agg(F.max("score").alias("score")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the piece table is no vocabulary")
    return Unigram({r[0]: r[1] for r in rows})


def piece_frequencies(df: DataFrame, key: str, text: str, tokenizer) -> DataFrame:
    """(key, piece, n): distinct pieces of each document with their frequency there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, ps, ns = [], [], []
            for i, t in zip(b[key], b[text], strict=True):
                for p, n in Counter(tokenizer.pieces(t)).items():
                    ids.append(i)
                    ps.append(p)
                    ns.append(n)
            if ids:
                yield pd.DataFrame({key: ids, "piece": ps, "n": ns})

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} long, piece string, n long")


def piece_lengths(pieces: DataFrame, length: Callable[[str], int]) -> DataFrame:
    """``pieces`` with the tokens of each piece, which must be distinct: each is tokenized once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) == 0:
                continue
            yield b.assign(tokens=[length(p) for p in b["piece"]])

    return pieces.select("piece", "documents").mapInPandas(run, "piece string, documents long, tokens long")


def token_counts(df: DataFrame, key: str, text: str, tokenizer) -> DataFrame:
    """(key, tokens): exact number of tokens of each document; null and blank texts have 0.

    Rows without key are left out; keys that repeat are summed. Texts are pre-split once: the
    frequencies are written to the shared folder. A stock piece is one row per document; pieces in more
    than 1 / ``HEAD`` of these rows are joined by broadcast, so no key of the shuffled join is hot.
    """
    freq = cut(piece_frequencies(df, key, text, tokenizer), "pieces")
    each = freq.groupBy("piece").agg(F.count(F.lit(1)).alias("documents"))
    least = freq.count() // HEAD
    lengths = cut(piece_lengths(each, tokenizer.length).select("piece", "documents", "tokens"), "lengths")
    head = F.broadcast(lengths.where(F.col("documents") > least).select("piece", F.col("tokens").alias("head_tokens")))
    x = freq.join(head, "piece", "left")
    tail = lengths.where(F.col("documents") <= least).select("piece", "tokens")
    parts = x.where("head_tokens is not null").select(key, (F.col("n") * F.col("head_tokens")).alias("m"))
    parts = parts.unionAll(x.where("head_tokens is null").join(tail, "piece").select(key, (F.col("n") * F.col("tokens")).alias("m")))
    got = parts.groupBy(key).agg(F.sum("m").alias("tokens"))
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(got, key, "left").select(key, F.coalesce("tokens", F.lit(0)).alias("tokens"))


def token_totals(texts: DataFrame, tokenizer) -> DataFrame:
    """Totals by source, language and domain (nulls are groups of their own), the whole in the shares' base."""
    n = token_counts(texts, "text_id", "text", tokenizer)
    d = texts.select("text_id", source_name(F.col("meta_corpus")).alias("source"), F.lower(blank_to_null(F.col("lang"))).alias("lang"), blank_to_null(F.col("meta_domain")).alias("domain"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    g = d.join(n, "text_id").groupBy("source", "lang", "domain")
    return g.agg(F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
