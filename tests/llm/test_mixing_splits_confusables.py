import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import confusables, mixing, splits

PAIR = "rec_id long, key2 string, split string, lang_src string, text_src string, meta_corpus string, meta_data_id_hj string, loaded_at timestamp, label string, n int, id string, group_id string, k string"
ALIGNED = "rec_id long, date_id string, text_hj string, meta_data_id_hj string, plain string, form string, a string, b string, label string"
TARGET = "meta_corpus string, lang_src string, target_share double, max_repeat int, source string"


def pair(i, text="甲乙丙", corpus="x", lang="hj", key="", split="train", entry=None):
    return (i, key or f"k{i}", split, lang, text, corpus, entry, None, "clash", 1, "clash", "clash", "clash")


def test_capped_mean_and_rate():
    for m in (1, 2, 4):
        for mean in (0.1, 0.7, m * 0.9):
            assert mixing.capped_mean(mixing.solve_rate(mean, m), m) == pytest.approx(mean, abs=1e-9)
    assert mixing.solve_rate(3, 3) == float("inf")
    assert mixing.thresholds(float("inf"), 2) == [0.0, 0.0]


def test_mixture_reaches_shares_and_caps(spark):
    rows = [pair(i, "字" * 50, "A " if i % 3 else "b") for i in range(6000)] + [pair(7000, None, "a"), pair(7001, " 　", "a"), pair(7002, "字", None), (None,) * 13]
    rows += [pair(9000, "字" * 50, "a", key="k1")]  # delivered again
    t = spark.createDataFrame([("a", "hj", 0.5, 2, "clash"), ("b", "hj", 0.3, 3, None), ("none", "hj", 0.2, 3, None), (None, None, None, None, None)], TARGET)
    p = spark.createDataFrame(rows, PAIR)
    got = mixing.mixture(p, t).collect()
    n = Counter(r.rec_id for r in got)
    assert max(n.values()) <= 3 and not {7000, 7001, 7002, None} & set(n)
    assert not {1, 9000} <= set(n)
    assert len({(r.rec_id, r.copy_no) for r in got}) == len(got)
    assert [r.place for r in got] == sorted(r.place for r in got)
    rep = {r.source: r for r in mixing.shares(p, t).collect()}
    assert rep["a"].reached_share == pytest.approx(0.5 / 0.8, abs=0.03) and rep["b"].reached_share == pytest.approx(0.3 / 0.8, abs=0.03)
    assert rep["none"].reached_share == 0.0 and rep["a"].most_copies <= 2 and rep["b"].most_copies <= 3
    assert mixing.mixture(p.limit(0), t).count() == 0 and mixing.mixture(p, t.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(f"v{rng.randrange(300)}", f"v{rng.randrange(300)}") for _ in range(220)] + [("hub", f"h{i}") for i in range(200)] + [("x", "x"), (None, "y"), ("v1", "v2"), ("v1", "v2")]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        if a and b:
            par[find(a)] = find(b)
    got = {r.v: r.label for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got) == {v for e in edges if None not in e for v in e}
    want, have = {}, {}
    for v in got:
        want.setdefault(find(v), set()).add(v)
        have.setdefault(got[v], set()).add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_broken_groups_and_assignment(spark):
    p = [pair(1, entry="kab_1", split="train"), pair(2, entry=" WAB_1 ", split="test"), pair(3, entry="kab_2", split="train"), pair(4, entry="kab_3", split="valid"), pair(5, entry=None, split="train"), pair(6, entry=" ", split="test"), pair(7, entry="kab_4", split=None), pair(8, entry="kab_4", split="test")]
    p += [pair(100 + i, entry="big") for i in range(300)] + [pair(1000 + i, entry=f"e{i}") for i in range(900)]
    a = [(1, "d1", "x", "kab_2", "", "", "", "", ""), (2, " d1 ", None, "KAB_3", "", "", "", "", ""), (3, None, "x", "kab_1", "", "", "", "", ""), (4, " ", "x", "kab_2", "", "", "", "", ""), (None,) * 9]
    pdf, adf = spark.createDataFrame(p, PAIR), spark.createDataFrame(a, ALIGNED)
    assert {r.group_id for r in splits.broken_groups(pdf, adf).collect()} == {"kab_1", "kab_2"}
    t = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1), (None, None)], "split string, target_share double")
    got = splits.assign_splits(pdf, adf, t).collect()
    assert sorted(r.rec_id for r in got) == sorted(r[0] for r in p)
    of = {}
    for r in got:
        of.setdefault(r.group_id, set()).add(r.split_new)
    assert all(len(s) == 1 for s in of.values())
    share = Counter(r.split_new for r in got)
    assert share["train"] / len(got) == pytest.approx(0.8, abs=0.02) and share["test"] / len(got) == pytest.approx(0.1, abs=0.02)
    assert {r.group_id for r in got if r.rec_id in (3, 4)} == {"kab_2"}
    rep = splits.split_shares(pdf, splits.assign_splits(pdf, adf, t), t).collect()
    assert sum(r.records for r in rep) == len(p)
    assert splits.broken_groups(pdf.limit(0), adf.limit(0)).count() == 0
    assert splits.assign_splits(pdf.limit(0), adf, t).count() == 0


def form(x, extra=None):
    return confusables.plain_form(x, confusables._Table(extra or {}))


def test_plain_form():
    assert form("ＡＢＣ１２３，") == "ABC123,"
    assert form("é") == "é" and form("가") == "가"
    assert form("來⼈｡") == "來人。" and form("a​b﻿­") == "ab" and form("a b　c") == "a b c"
    assert form("pаypаl") == "paypal" and form("ОСТРОВ А") != "ОСТРОВ А"[:0]
    assert form("СЕХ") == "CEX"  # a whole-script confusable
    assert form("Москвa") == "Москва"  # Latin a in a Cyrillic word
    assert form("二ニ") == "二二" and form("カタカナ") == "カタカナ"
    assert form("x\ny") != form("x y") and form("1") != form("l") and form("①") != form("1")
    assert form("§", {"§": "$", "$": "€"}) == "€" and form("p", {"p": "q", "q": "p"}) in ("p", "q")


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_plain_form_is_idempotent(x):
    assert form(form(x)) == form(x)


def test_lookalikes(spark):
    rows = [(1, None, "甲乙。", None, "c", "c", "c", "c", "c"), (2, None, "甲乙｡", None, "c", "c", "c", "c", "c"), (3, None, "甲乙。", None, "c", "c", "c", "c", "c"), (4, None, "甲丙。", None, "c", "c", "c", "c", "c"), (5, None, None, None, "c", "c", "c", "c", "c"), (6, None, "", None, "c", "c", "c", "c", "c"), (7, None, "​", None, "c", "c", "c", "c", "c"), (8, None, "甲\n乙。", None, "c", "c", "c", "c", "c"), (9, None, "長" * 50_000, None, "c", "c", "c", "c", "c"), (10, None, "⾧" * 50_000, None, "c", "c", "c", "c", "c"), (None, None, "甲乙｡", None, "c", "c", "c", "c", "c")]
    m = spark.createDataFrame([("〇", None), (None, "-"), ("a", "a")], "src string, tgt string")
    d = spark.createDataFrame(rows, ALIGNED)
    got = {tuple(r) for r in confusables.lookalikes(d, "rec_id", "text_hj", m).collect()}
    assert got == {(1, 2), (2, 3), (9, 10)}
    assert confusables.lookalikes(d.limit(0), "rec_id", "text_hj", m.limit(0)).count() == 0


def test_long_lists_are_used_or_refused_whole(spark, monkeypatch):
    n = 10_050
    p = spark.createDataFrame([(i, f"k{i}", f"c{i}", "hj", "x" * 5, None) for i in range(n)], "rec_id long, key2 string, meta_corpus string, lang_src string, text_src string, loaded_at timestamp")
    t = spark.createDataFrame([(f"c{i}", "hj", 1.0, 2) for i in range(n)], "meta_corpus string, lang_src string, target_share double, max_repeat int")
    got = mixing.mixture(p, t)
    assert got.groupBy("source").count().where("count = 2").count() == n and got.where("text_src <> 'xxxxx'").count() == 0
    monkeypatch.setattr(mixing, "MOST_TARGETS", 10)
    with pytest.raises(ValueError):
        mixing.mixture(p, t)
    a = spark.createDataFrame([], "meta_data_id_hj string, date_id string")
    q = spark.createDataFrame([(1, None, "train", "x")], "rec_id long, meta_data_id_hj string, split string, text_src string")
    shares = spark.createDataFrame([(f"s{i}", 1.0) for i in range(1001)], "split string, target_share double")
    with pytest.raises(ValueError):
        splits.assign_splits(q, a, shares)
    assert splits.assign_splits(q, a, shares, most_splits=2000).count() == 1


def test_hot_and_missing_ids_get_one_split(spark):
    rows = [(i, "k1", "train", "x") for i in range(300)] + [(1000 + i, None, "train", "x") for i in range(300)] + [(2000 + i, f"w{i % 40 + 2}", "test", "x") for i in range(200)] + [(None, None, None, None)]
    p = spark.createDataFrame(rows, "rec_id long, meta_data_id_hj string, split string, text_src string")
    a = spark.createDataFrame([("k2", "d"), ("K3 ", "d ")], "meta_data_id_hj string, date_id string")
    t = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split string, target_share double")
    got = splits.assign_splits(p, a, t)
    assert got.count() == len(rows)
    per = {r.group_id: r.n for r in got.where("group_id is not null").groupBy("group_id").agg(F.countDistinct("split_new").alias("n")).collect()}
    assert set(per.values()) == {1} and len(per) == 1 + 300 + 39
    ids = {r.rec_id: r.group_id for r in got.collect()}
    assert ids[2000] == ids[2001] == "k2" and ids[0] == "k1" and ids[1000] == "r:1000"


def test_look_alikes_of_other_scripts_lists_with_cycles_and_runs():
    assert form("ϹοсА") == form("CocA") == "CocA"
    for x, y in (("Ꭺpple", "Apple"), ("ⲟpen", "open"), ("ꓮB", "AB"), ("ꓚꓳꓠ", "CON"), ("ᎠᎡ", "DR")):
        assert form(x) == y
    assert form("甲", {"甲": "乙", "乙": "甲"}) == form("乙", {"甲": "乙", "乙": "甲"})
    assert form("甲x", {"甲": "乙", "乙": "丙", "丙": "乙"}) == form("丙x", {"甲": "乙", "乙": "丙", "丙": "乙"})
    assert form("(三)月", {"(三)": "三", "(": "["}) == "三月" and form("a(b", {"(": "["}) == "a[b"


def test_look_alike_classes_and_hot_forms(spark):
    forms = ["Ａ甲", "A甲", "A\u200b甲"]
    rows = [(i, forms[i % 3]) for i in range(60)] + [(100, "乙"), (101, "乙"), (102, None), (103, "\u200b"), (None, "A甲")]
    d = spark.createDataFrame(rows, "rec_id long, t string")
    m = spark.createDataFrame([], "src string, tgt string")
    c = confusables.lookalike_classes(d, "rec_id", "t", m).collect()
    assert len(c) == 60 and {r.class_id for r in c} == {0} and {r.spelling_id for r in c} == {0, 1, 2} and {r.spellings for r in c} == {3}
    got = [tuple(r) for r in confusables.lookalikes(d, "rec_id", "t", m, part=7).collect()]
    assert len(got) == len(set(got)) == 3 * 20 * 20 and all(a < b and a % 3 != b % 3 for a, b in got)
