import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.operators import hygiene, metrics, projection, quality
from corpusloom.plans.pipeline import Stage, build
from corpusloom.sources import html, readers
from corpusloom.streaming import incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dedup_and_leaks(spark):
    rows = [(1, "train", "a"), (2, "test", "a"), (3, "train", "b"), (4, "valid", "b"), (5, None, "a"), (6, "train", "c"), (7, "train", "c"), (8, "train2", "a"), (9, "train", None)]
    d = frame(spark, rows, "k long, split string, text string")
    got = hygiene.hygiene(d, "split", "text", "k").collect()
    kept = {(r.split, r.text) for r in got}
    assert kept == {("test", "a"), ("valid", "b"), ("train", "c"), ("train2", "a")} and len(got) == 4
    steps = hygiene.drop_leaks(hygiene.drop_leaks(hygiene.dedup_within(d, "split", ["text"], "k"), "split", ["text"], "test", ["train", "valid"]), "split", ["text"], "valid", ["train"])
    assert {(r.k, r.split) for r in steps.collect()} == {(r.k, r.split) for r in got}
    assert hygiene.hygiene(d.limit(0), "split", "text", "k").count() == 0


def test_split_is_a_function_of_the_key(spark):
    d = spark.range(4000).select(F.col("id"), hygiene.hash_split(F.col("id")).alias("s"))
    n = {r[0]: r[1] for r in d.groupBy("s").count().collect()}
    assert n["train"] / 4000 == pytest.approx(0.8, abs=0.03)
    assert d.repartition(7).exceptAll(d).count() == 0


def test_stratified_and_top_up(spark):
    d = spark.range(100).select("id", F.pmod("id", F.lit(3)).alias("g"), (F.col("id") < 20).alias("prev"))
    assert [r[1] for r in hygiene.stratified(d, ["g"], "id", 5).groupBy("g").count().collect()] == [5, 5, 5]
    got = hygiene.stratified(d, ["g"], "id", 10, F.col("prev"))
    assert got.where("prev").count() == 20 and got.groupBy("g").count().agg(F.min("count")).first()[0] == 10
    assert hygiene.stratified(d, ["g"], "id", 3, F.col("prev")).count() == 20


def test_ids_widen(spark):
    ids = lambda n: sorted(r.id2 for r in projection.padded_ids(spark.range(n), ["id"], "U", "id2").collect())
    assert ids(9)[0] == "U1" and ids(10)[0] == "U01" and ids(10)[-1] == "U10" and ids(0) == []


def test_join_update_ignores_unknown_and_null(spark):
    old = frame(spark, [(1, "a"), (2, "b")], "k int, v string")
    new = frame(spark, [(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert {tuple(r) for r in projection.coalesce_update(old, new, "k", ["v"]).collect()} == {(1, "a"), (2, "x")}


def test_nulls_in_predicates(spark):
    d = frame(spark, [("a",), (None,), ("b",)], "c string")
    assert d.where(quality.not_in(F.col("c"), ["a"])).count() == 2


def test_bleu(spark):
    d = frame(spark, [("x", "abcdef", "abcdef"), ("y", "", "abcd"), ("z", "abcdxx", "abcdef"), ("w", "zzzz", "abcd"), ("v", None, "abcd")], "g string, h string, r string")
    got = {r.g: r.bleu for r in metrics.corpus_bleu(d, ["g"], "h", "r").collect()}
    assert got["x"] == pytest.approx(100) and got["y"] == got["w"] == got["v"] == 0
    p = (4 / 6 * 3 / 5 * 2 / 4 * 1 / 3) ** 0.25 * 100
    assert got["z"] == pytest.approx(p)


def test_bootstrap(spark):
    d = spark.range(60).select("id", F.lit("甲乙丙丁戊己庚辛").alias("ref"), F.lit("甲乙丙丁戊己庚辛").alias("a"), F.lit("甲乙丙丁戊己庚壬").alias("b"))
    r = metrics.paired_bootstrap(d, "id", "a", "b", "ref", 40).first()
    assert r.bleu_a == pytest.approx(100) and r.bleu_b < 100 and r.p_value > 0


def test_span_f1(spark):
    a = frame(spark, [(1, "x<▪n>1</▪n>y<▪m>2</▪m>"), (2, None)], "k int, t string")
    b = frame(spark, [(1, "x<▪n>1</▪n>y2")], "k int, t string")
    got = {r.label: (r.precision, r.recall) for r in metrics.span_f1(metrics.entity_spans(a, "k", "t"), metrics.entity_spans(b, "k", "t"), "k").collect()}
    assert got["n"] == (1.0, 1.0) and got["m"] == (0.0, 0.0) and got["weighted"][1] == 0.5


def test_html_errors_are_values(spark):
    d = frame(spark, [(1, "<div class='a'>x<b>y</b></div><p>z"), (2, None)], "k long, h string")
    got = html.page_records(d, "k", "h", ["div.a", "b"]).collect()
    assert {(r.k, r.selector, r.text) for r in got if r.error is None} == {(1, "b", "y"), (1, "div.a", "xy")}
    assert [r.k for r in got if r.error] == [2]


@pytest.mark.parametrize("name", ["t.parquet", "t.jsonl", "t.csv", "t.tsv"])
def test_round_trip_of_files(spark, tmp_path, name):
    d = frame(spark, [(1, "甲\"乙"), (2, "a b")], "k int, v string")
    report = readers.write_audited(d, str(tmp_path / name))
    assert report["rows"] == 2
    assert {tuple(r) for r in readers.read_any(spark, str(tmp_path / name), "k int, v string").collect()} == {(1, "甲\"乙"), (2, "a b")}


def test_other_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfx,y\n1,2\n")
    assert readers.read_any(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_any(spark, str(tmp_path / "b.csv")).columns == ["x", "y"]
    assert readers.whole_files(spark, str(tmp_path)).count() == 2
    assert readers.file_type("x/y.jsonl.zst") == "jsonl" and readers.file_type("x") == ""


def test_stream_runs_once_over_new_files(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    step = lambda d: d.withColumn("v", F.col("v") * 2)
    frame(spark, [(1, 1)], "k int, v int").write.parquet(src)
    incremental.run_available(spark, src, "k int, v int", step, out, ck)
    frame(spark, [(2, 5)], "k int, v int").write.mode("append").parquet(src)
    incremental.run_available(spark, src, "k int, v int", step, out, ck)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == {(1, 2), (2, 10)}


def test_pipeline_expectations(spark):
    src = {"raw": frame(spark, [(1, "a"), (2, None)], "k int, v string")}
    ok = build([Stage("clean", ["raw"], lambda d: d.where("v is not null"), {"v is there": F.col("v").isNotNull()})], src)
    assert ok["clean"].count() == 1
    bad = build([Stage("clean", ["raw"], lambda d: d, {"v is there": F.col("v").isNotNull()})], src)
    with pytest.raises(Exception, match="v is there"):
        bad["clean"].collect()
    with pytest.raises(KeyError):
        build([Stage("x", ["nothing"], lambda d: d)], {})


def test_profiles_without_columns_of_interest(spark):
    d = frame(spark, [(1, None), (2, None)], "k int, v string")
    assert [tuple(r) for r in quality.null_profile(d).collect()] == [("v", 2)]
    assert projection.drop_all_null(d).columns == ["k"]
    assert projection.drop_if_equal(d.withColumn("w", F.col("v")), "v", "w").columns == ["k", "v"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_bootstrap_and_oov_mass_are_whole(spark):
    r = entry.queries()["met_bootstrap"](spark, "/root/testdata/sf0.001").first()
    assert abs(r.p_value * 2001 - round(r.p_value * 2001)) < 1e-6 and r.p_value < 1 / 61
    o = entry.queries()["met_oov_thresholds"](spark, "/root/testdata/sf0.001").collect()
    assert {x.threshold for x in o} == {100.0, 99.99, 99.9, 99.0, 95.0, 90.0}
    few = {(x.l1, x.l2, float(x.threshold), x.oov) for x in entry.queries()["met_oov_mass"](spark, "/root/testdata/sf0.001").collect()}
    assert few == {(x.l1, x.l2, x.threshold, x.oov) for x in o if x.threshold in (90.0, 99.0, 100.0)}


def test_ruzicka_compares_marks_place_by_place(spark):
    d = frame(spark, [("甲，乙。丙", "甲。乙，丙"), ("。甲，，乙。", "甲，乙。"), ("甲。", "乙。"), ("甲乙", "甲，乙"), (None, "甲"), ("", "")], "ref string, hyp string")
    r = metrics.mean_ruzicka(d, F.col("ref"), F.col("hyp")).first()
    assert (r.positions, r.unlike) == (4, 1) and r.similarity == pytest.approx(100 * (0 + 0 + 0.5 + 1) / 4)


def test_alignment_rules(spark):
    rows = [(1, "a", "a", "x", "t", "t"), (2, "b", "c", "x", "t", "t"), (3, "d", "d", "x", "t", "t"), (4, "d", None, None, "t", "t"), (5, "e", "e", "x 원문 빠짐", "t", "t"), (6, "f", "f", None, "t", "t"), (7, "g", "g", "x", "t t", "tt"), (8, "h", "h", "x", "t", "u"), (9, None, "i", "x", None, "t"), (10, "j", None, "x", "t", "t")]
    d = frame(spark, rows, "k int, link string, data string, text string, title string, title_ko string")
    got = hygiene.alignment_rules(d, "link", "data", "text", ["data", "text", "title_ko"], ["원문 빠짐", "원문 결락"], ("title", "title_ko")).collect()
    assert {r.k for r in got if r.text} == {1, 7, 9} and all(r.data is None and r.title_ko is None for r in got if not r.text)
    assert [r.title for r in sorted(got, key=lambda r: r.k)] == [r[4] for r in rows]


def test_fixed_forms_of_radicals_and_marks(spark):
    from corpusloom.functions import normalize as nm

    pairs = [("⺋", "㔾"), ("⺩", "𤣩"), ("⺮", "𥫗"), ("⻖", "阝"), ("ム", "厶"), ("爲", "為"), ("𧥙", "𣁀"), ("⼧", "宀"), ("〸", "十"), ("樂", "樂"), ("福", "福"), ("﹐", "，")]
    marks = [("‟", '"'), ("—", "-"), ("―", "-"), ("∶", ":"), ("ᆞ", "·"), ("！", "!"), ("｡", "。"), ("…", "...")]
    d = spark.createDataFrame([(a, b, "c") for a, b in pairs] + [(a, b, "m") for a, b in marks], "a string, b string, kind string")
    got = d.withColumn("x", F.when(F.col("kind") == "c", nm.cjk(F.col("a"))).otherwise(nm.punctuation(F.col("a")))).where("x <> b").collect()
    assert got == []


def test_mapped_rows_and_leaks_with_nulls(spark):
    from corpusloom.streaming import incremental as inc

    t = spark.createDataFrame([(1, "5"), (2, None), (3, "x"), (4, "")], "k long, s string")
    got = {r.id: (r.content, r.error) for r in inc.mapped(t, "k", "s", lambda s: str(int(s) + 1), "m").collect()}
    assert got[1] == ("6", None) and got[2] == (None, "ValueError: no text") and got[3][0] is None and got[3][1].startswith("ValueError")
    again = inc.mapped(t, "k", "s", len, "m", inc.mapped(t, "k", "s", lambda s: str(int(s) + 1), "m"))
    assert {r.id for r in again.collect()} == {2, 3, 4}
    d = spark.createDataFrame([(1, "train", "a"), (2, "test", "a"), (3, "train", None), (4, None, "a"), (5, "train", "b")], "k long, split string, s string")
    assert {r.k for r in hygiene.drop_leaks(d, "split", ["s"], "test", ["train", "valid"]).collect()} == {2, 3, 4, 5}
    w = metrics.weighted_scores(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), (None, "a")], "r string, h string"), "r", "h").first()
    assert (w.n, w.accuracy, w.recall) == (4, 0.5, 0.5) and abs(w.precision - (2 * 0.5 + 0.5) / 4) < 1e-9
