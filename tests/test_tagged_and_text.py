from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import messages, normalize, tagged, text

ITEM = st.tuples(st.text("甲乙ab, 。1", min_size=1, max_size=4), st.sampled_from([None, "per", "loc"]))


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("x")).first()[0]


def merged(items):
    out = []
    for t, n in items:
        if out and n is None and out[-1][1] is None:
            out[-1] = (out[-1][0] + t, None)
        else:
            out.append((t, n))
    return out


def test_item_round_trips(spark):
    @given(st.lists(st.lists(ITEM, max_size=5), min_size=20, max_size=20))
    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    def check(rows):
        rows = [merged(r) for r in rows]
        d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, items array<struct<text:string,name:string>>")
        x = d.select("i", "items", tagged.from_items(F.col("items")).alias("t"))
        x = x.select("i", "items", tagged.to_items(F.col("t")).alias("back"), tagged.from_iob(tagged.to_iob(F.col("items"))).alias("iob"))
        for r in x.collect():
            assert r["back"] == r["items"]
            assert r["iob"] == r["items"]

    check()


def test_tag_edge_cases(spark):
    assert one(spark, None, tagged.to_items) is None
    assert one(spark, "<▪a>x</▪b>", tagged.is_valid) is False
    assert one(spark, "<▪a>x", tagged.to_items) is None
    assert one(spark, "<▪a></▪a>y", lambda c: tagged.from_items(tagged.to_items(c))) == "y"
    assert one(spark, "a<▪x>b</▪x>", tagged.plain_text) == "ab"
    stray = [("甲", "I-x"), ("乙", "B-x"), ("丙", "I-y"), ("丁", "O")]
    got = one(spark, stray, tagged.from_iob, "array<struct<token:string,tag:string>>")
    assert [tuple(x) for x in got] == [("甲", None), ("乙丙", "x"), ("丁", None)]


def test_reduction(spark):
    for run, want in (("。,", "。"), (",,?", ","), ("《", ""), ("?。", "?"), ("", "")):
        assert one(spark, run, tagged.reduce_run) == want
    once = one(spark, "a, b?? c。", tagged.reduce_punctuation)
    assert once == "a,b?c。" and one(spark, once, tagged.reduce_punctuation) == once


def test_blanks(spark):
    for raw, want in (("a　b", "a b"), (" a\x1cb\x0b", "a b"), ("", ""), (None, None)):
        assert one(spark, raw, text.squeeze_blanks) == want
    for raw, want in (("", None), (" ", None), ("　\n", None), ("x", "x"), (None, None)):
        assert one(spark, raw, text.blank_to_null) == want


def test_punctuation_runs(spark):
    assert one(spark, "甲,乙。?丙【丁】 #戊", text.punctuation_runs) == [",", "。?", " "]


def test_normalize(spark):
    assert one(spark, "○ ｶﾞ가　來…", normalize.normalize) == "ガ가 來..."
    assert one(spark, None, normalize.normalize) is None


def test_dates(spark):
    assert one(spark, "가가_9년_10월(윤0)_21일", messages.lunar_date) == "가가_9년_10월(윤0)_21일"
    assert one(spark, "세종 3년 윤4월", messages.lunar_date) == "세종_3년_04월(윤1)_??일"
    assert one(spark, "1623년 윤3월 5일", messages.solar_like_id) == "1623-03-1-05" and one(spark, "x", messages.year) is None


def test_sql_functions(spark):
    from corpusloom.functions import sql
    from corpusloom.operators.hygiene import hash_split

    sql.register(spark)
    r = spark.sql("select squeeze_blanks(' a　 b ') as a, blank_to_null(' ') as b, remove_punctuation('a, b。') as c, plain_text('<▪n>1</▪n>') as d, parent_id('a_b_c') as e").first()
    assert tuple(r) == ("a b", None, "ab", "1", "a_b")
    d = spark.range(50).select(F.expr("hash_split(cast(id as string))").alias("x"), hash_split(F.col("id")).alias("y"))
    assert d.where("x <> y").count() == 0
