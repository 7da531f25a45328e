"""Evaluation metrics as algebraic aggregates over hypothesis and reference columns."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tagged import punctuation_after, to_items
from ..functions.text import PUNC_RUN, char_ngrams


def tokens_13a(c: Column) -> Column:
    """Tokens of the 13a scheme: marks and symbols apart, periods and commas apart unless between digits."""
    c = F.regexp_replace(c, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x != "")


def tokens_char(c: Column) -> Column:
    """Characters without white space: the scheme for scripts without blanks."""
    return F.regexp_extract_all(F.regexp_replace(c, r"[\s\p{Z}]+", ""), F.lit("(?s)."), F.lit(0))


def _statistics(order: int):
    """Arrow function of hypothesis and reference tokens: lengths, clipped matches and totals of all orders.

    Counting the n-grams of a pair is linear here; as a higher-order expression it would compare all
    n-grams with all others, and exploding them would shuffle every n-gram of the corpus.
    """
    names = ["hyp_len", "ref_len", *[f"{x}{n}" for n in range(1, order + 1) for x in "mt"]]

    @F.pandas_udf("struct<" + ",".join(f"{n}:int" for n in names) + ">")
    def run(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(h, r, strict=True):
            x, y = list(x), list(y)
            row = [len(x), len(y)]
            for n in range(1, order + 1):
                a, b = Counter(zip(*[x[i:] for i in range(n)], strict=False)), Counter(zip(*[y[i:] for i in range(n)], strict=False))
                row += [sum((a & b).values()), max(0, len(x) - n + 1)]
            out.append(row)
        return pd.DataFrame(out, columns=names, dtype="int32")

    return run


def bleu_statistics(df: DataFrame, hyp: str, ref: str, tokens=tokens_char, order: int = 4) -> DataFrame:
    """Per row: clipped matches m1..m4, totals t1..t4 and both lengths. A null hypothesis is an empty one; rows without reference go."""
    d = df.where(F.col(ref).isNotNull())
    s = d.withColumn("_s", _statistics(order)(tokens(F.coalesce(hyp, F.lit(""))), tokens(F.col(ref))))
    return s.select(*df.columns, "_s.*")


def bleu_of_sums(order: int = 4) -> Column:
    """Corpus BLEU of summed statistics (0 where an order has no match)."""
    logs = sum((F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in range(1, order + 1)), F.lit(0.0)) / order
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    ok = F.col("hyp_len") > 0
    for n in range(1, order + 1):
        ok = ok & (F.col(f"m{n}") > 0)
    return F.when(ok, 100 * brevity * F.exp(logs)).otherwise(0.0)


def corpus_bleu(df: DataFrame, by: list[str], hyp: str, ref: str, tokens=tokens_char, order: int = 4) -> DataFrame:
    """BLEU and number of rows per group: one aggregate of per-row statistics."""
    s = bleu_statistics(df, hyp, ref, tokens, order)
    cols = ["hyp_len", "ref_len", *[f"{x}{n}" for n in range(1, order + 1) for x in "mt"]]
    g = s.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("rows"))
    return g.select(*by, bleu_of_sums(order).alias("bleu"), "rows")


def _resampled(names: list[str], samples: int):
    """Sums of the statistics over all rows (sample 0) and over each resample, a row for each sample and task."""
    top = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])  # Poisson distribution of mean one
    step = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((samples + 1, len(names))), 0
        for whole in batches:
            for b in (whole.iloc[i : i + 500] for i in range(0, len(whole), 500)):
                x, h = b[names].to_numpy(dtype=np.float64), b["_k"].to_numpy(dtype=np.int64).view(np.uint64)[:, None] + step
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
                total[0] += x.sum(axis=0)
                total[1:] += np.searchsorted(top, u, side="right").T.astype(np.float64) @ x
                rows += len(b)
        if rows:
            yield pd.DataFrame(total, columns=names).assign(sample=np.arange(samples + 1))

    return run


def paired_bootstrap(df: DataFrame, key: str, a: str, b: str, ref: str, samples: int = 2000, tokens=tokens_char, seed: int = 42) -> DataFrame:
    """(bleu_a, bleu_b, p_value): how often resampling turns the difference of two systems round.

    Each row draws how often it occurs in a sample from a Poisson distribution of mean one, hashed
    from its key and the sample's number. The tasks sum the weighted statistics; no sample is materialised.
    """
    d = df.where(F.col(key).isNotNull())
    names = ["hyp_len", "ref_len", *[f"{x}{n}" for n in range(1, 5) for x in "mt"]]
    for prefix, hyp in (("a", a), ("b", b)):
        d = bleu_statistics(d, hyp, ref, tokens).withColumnsRenamed({n: f"{prefix}_{n}" for n in names})
    names = [f"{p}_{n}" for p in "ab" for n in names]
    x = d.select(F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("_k"), *names)
    g = x.mapInPandas(_resampled(names, samples), "sample int, " + ", ".join(f"{n} double" for n in names))
    g = g.groupBy("sample").agg(*[F.sum(n).alias(n) for n in names])
    g = g.select("sample", _bleu_named("a").alias("bleu_a"), _bleu_named("b").alias("bleu_b"))
    real = g.agg(F.max(F.when(F.col("sample") == 0, F.col("bleu_a"))).alias("bleu_a"), F.max(F.when(F.col("sample") == 0, F.col("bleu_b"))).alias("bleu_b"), F.collect_list(F.when(F.col("sample") > 0, F.col("bleu_a") - F.col("bleu_b"))).alias("_d"))
    diff = F.col("bleu_a") - F.col("bleu_b")
    worse = F.size(F.filter("_d", lambda v: F.abs(v - diff) >= F.abs(diff)))
    return real.select("bleu_a", "bleu_b", ((worse + 1) / (F.size("_d") + 1)).alias("p_value"))


def _bleu_named(p: str) -> Column:
    logs = sum((F.log(F.col(f"{p}_m{n}") / F.col(f"{p}_t{n}")) for n in range(1, 5)), F.lit(0.0)) / 4
    ok = F.least(*[F.col(f"{p}_m{n}") for n in range(1, 5)]) > 0
    brevity = F.when(F.col(f"{p}_hyp_len") >= F.col(f"{p}_ref_len"), 1.0).otherwise(F.exp(1 - F.col(f"{p}_ref_len") / F.col(f"{p}_hyp_len")))
    return F.when(ok, 100 * brevity * F.exp(logs)).otherwise(0.0)


def entity_spans(df: DataFrame, key: str, tagged: str) -> DataFrame:
    """(key, start, end, label) of the tagged stretches of a text."""
    items = to_items(F.col(tagged))

    @F.pandas_udf("array<int>")
    def running(sizes: pd.Series) -> pd.Series:
        return sizes.map(np.cumsum)

    ends = running(F.transform("_i", lambda x: F.length(x["text"])))
    d = df.select(key, items.alias("_i")).where(F.size("_i") > 0).withColumn("_e", ends)
    d = d.select(key, F.explode(F.arrays_zip(F.col("_i").alias("i"), F.col("_e").alias("e"))).alias("x")).where("x.i.name is not null")
    return d.select(key, (F.col("x.e") - F.length("x.i.text")).alias("start"), F.col("x.e").alias("end"), F.col("x.i.name").alias("label"))


def span_f1(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 per label and weighted by support, from exact spans."""
    on = [key, "start", "end", "label"]
    r, h = ref.distinct(), hyp.distinct()
    tp = r.join(h, on, "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("tp"))
    g = r.groupBy("label").agg(F.count(F.lit(1)).alias("support")).join(h.groupBy("label").agg(F.count(F.lit(1)).alias("found")), "label", "full").join(tp, "label", "left").na.fill(0)
    p, q = F.col("tp") / F.col("found"), F.col("tp") / F.col("support")
    g = g.withColumn("precision", F.when(F.col("found") > 0, p).otherwise(0.0)).withColumn("recall", F.when(F.col("support") > 0, q).otherwise(0.0))
    g = g.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("found") + F.col("support"))).otherwise(0.0))
    every = g.agg(F.sum("support").alias("support"), F.sum("found").alias("found"), F.sum("tp").alias("tp"), *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")])
    cols = ["label", "support", "found", "tp", "precision", "recall", "f1"]
    return g.select(*cols).unionByName(every.withColumn("label", F.lit("weighted")).select(*cols))


def confusion(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """(ref, hyp, n) of rows where both are known."""
    return df.where(F.col(ref).isNotNull() & F.col(hyp).isNotNull()).groupBy(F.col(ref).alias("ref"), F.col(hyp).alias("hyp")).agg(F.count(F.lit(1)).alias("n"))


def weighted_scores(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """(n, accuracy, precision, recall, f1): scores of the labels weighted by their numbers in ``ref``.

    All from the confusion counts, so only as many rows as pairs of labels leave the first aggregate.
    A label that is never found has precision 0. Rows with a null label are left out.
    """
    c = confusion(df, ref, hyp)
    side = lambda name, n: c.groupBy(F.col(name).alias("label")).agg(F.sum("n").alias(n))
    hit = c.where("ref = hyp").select(F.col("ref").alias("label"), F.col("n").alias("tp"))
    g = side("ref", "support").join(side("hyp", "found"), "label", "left").join(hit, "label", "left").na.fill(0)
    p, q = F.when(F.col("found") > 0, F.col("tp") / F.col("found")).otherwise(0.0), F.col("tp") / F.col("support")
    f = 2 * F.col("tp") / (F.col("support") + F.col("found"))
    mean = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return g.agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), mean(p).alias("precision"), mean(q).alias("recall"), mean(f).alias("f1"))


def agreement(df: DataFrame, ref: str, hyp: str, low: int, high: int) -> DataFrame:
    """(n, accuracy, kappa): quadratic-weighted kappa of integer grades, from sums alone."""
    r, h = F.col(ref).cast("double"), F.col(hyp).cast("double")
    d = df.where(F.col(ref).between(low, high) & F.col(hyp).between(low, high))
    g = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(r == h, 1.0).otherwise(0.0)).alias("accuracy"), F.sum((r - h) * (r - h)).alias("o"), F.sum(r * r).alias("rr"), F.sum(h * h).alias("hh"), F.sum(r).alias("rs"), F.sum(h).alias("hs"))
    chance = F.col("rr") + F.col("hh") - 2 * F.col("rs") * F.col("hs") / F.col("n")
    return g.select("n", "accuracy", (1 - F.col("o") / chance).alias("kappa"))


def ruzicka(a: Column, b: Column) -> Column:
    """Similarity of the character counts of two marks: sum of the least over sum of the greatest counts."""
    ch = F.array_distinct(F.concat(char_ngrams(a, 1), char_ngrams(b, 1)))
    n = lambda t, x: F.length(t) - F.length(F.replace(t, x, F.lit("")))
    lo = F.aggregate(ch, F.lit(0), lambda acc, x: acc + F.least(n(a, x), n(b, x)))
    hi = F.aggregate(ch, F.lit(0), lambda acc, x: acc + F.greatest(n(a, x), n(b, x)))
    return F.when(hi > 0, lo / hi).otherwise(1.0)


def mean_ruzicka(df: DataFrame, ref: Column, hyp: Column) -> DataFrame:
    """(positions, unlike, similarity): mean over the positions where the reference has marks, times 100.

    A position is a character that is no punctuation; its mark is the run after it. Records whose other
    characters differ have no positions in common: they are counted in ``unlike`` and left out.
    """
    bare = lambda c: F.regexp_replace(c, f"{PUNC_RUN}+", "")
    marks = lambda c: F.transform(punctuation_after(c), lambda x: x["mark"])
    d = df.select(ref.alias("r"), hyp.alias("h")).where("r is not null and h is not null").select("r", "h", (bare(F.col("r")) == bare(F.col("h"))).alias("same"))
    both = F.filter(F.arrays_zip(marks(F.col("r")).alias("r"), marks(F.col("h")).alias("h")), lambda x: x["r"] != "")
    d = d.select("same", F.explode_outer(F.when(F.col("same"), both)).alias("x"))
    d = d.select("same", ruzicka(F.col("x.h"), F.col("x.r")).alias("s"), F.col("x").isNotNull().alias("at"))
    return d.agg(F.count_if("at").alias("positions"), F.count_if(~F.col("same")).alias("unlike"), (100 * F.avg(F.when(F.col("at"), F.col("s")))).alias("similarity"))
