"""Text functions, tagged text, dates, messages, dataset hygiene, metrics and corpus reports over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import messages as ms
from ..functions import normalize as nm
from ..functions import tagged as tg
from ..functions import text as tx
from ..operators import hygiene as hy
from ..operators import metrics as mt
from ..operators import quality as q
from ..sources import html as ht
from ..streaming import incremental as inc
from .registry import query

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
P = r"[\p{P}\p{Z}|\n\t]"
SPLIT = "case when u < 0.8 then 'train' when u < 0.9 then 'valid' else 'test' end"
U = "(('0x' || substr(sha256({k} || '/42'), 1, 13))::bigint / 4503599627370496.0)"

# ---- string functions


@query("txt_squeeze", f"select text_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) as text from mono_text")
def _(t):
    return t("mono_text").select("text_id", tx.squeeze_blanks(F.col("text")).alias("text"))


@query("txt_remove_blanks", f"select text_id, regexp_replace(text, '{WS}+', '', 'g') as text from mono_text")
def _(t):
    return t("mono_text").select("text_id", tx.remove_blanks(F.col("text")).alias("text"))


@query("txt_has_punctuation", f"select rec_id, coalesce(regexp_matches(text_src, '{P}'), false) as punctuated from parallel_pair")
def _(t):
    return t("parallel_pair").select("rec_id", tx.has_punctuation(F.col("text_src")).alias("punctuated"))


@query("txt_remove_punctuation", f"select rec_id, regexp_replace(text_src, '{P}+', '', 'g') as bare, translate(text_src, '。，、', '') as listed from parallel_pair")
def _(t):
    return t("parallel_pair").select("rec_id", tx.remove_punctuation(F.col("text_src")).alias("bare"), tx.remove_characters(F.col("text_src"), "。，、").alias("listed"))


@query("txt_runs", r"select text_id, len(regexp_extract_all(text, '([0-9]+|[^0-9]+)'))::int as runs from mono_text where text is not null")
def _(t):
    return t("mono_text").where("text is not null").select("text_id", F.size(tx.runs(F.col("text"), "[0-9]")).alias("runs"))


@query("txt_punctuation_runs", f"select run, count(*) as n from (select unnest(regexp_extract_all(translate(text, '【】〔〕#&@※', 'xxxxxxxx'), '{P}+')) as run from mono_text) group by run")
def _(t):
    return t("mono_text").select(F.explode(tx.punctuation_runs(F.col("text"))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


@query("txt_char_frequency", "select lang, c, count(*) as n from (select lang, unnest(regexp_extract_all(text, '(?s).')) as c from mono_text) group by all")
def _(t):
    return t("mono_text").select("lang", F.explode(tx.characters(F.col("text"))).alias("c")).groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n"))


@query("txt_char_ngrams", "select g, count(*) as n from (select unnest(list_transform(range(1, length(hj)), lambda i: substr(hj, i, 2))) as g from glossary where length(hj) >= 2) group by g")
def _(t):
    return t("glossary").select(F.explode(tx.char_ngrams(F.col("hj"), 2)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("txt_category")
def _(t):
    c = t("mono_text").select(F.explode(tx.characters(F.col("text"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("category", tx.unicode_category(F.col("c"))).groupBy("category").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chars"))


@query("txt_is_hangul", r"select doc_id, regexp_matches(text, '[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{D7B0}-\x{D7FF}\x{3200}-\x{321E}\x{FFA0}-\x{FFDC}]') as hangul from documents")
def _(t):
    return t("documents").select("doc_id", tx.is_hangul(F.col("text")).alias("hangul"))


@query("txt_han_like_chars", r"select c, count(*) as n from (select unnest(regexp_extract_all(text_src, '(?s).')) as c from parallel_pair) where not regexp_matches(c, '[\p{Cc}\p{Cf}\p{Lu}\p{Ll}\p{Lm}\p{Mn}\p{Nd}\p{No}\p{P}\p{S}\p{Z}]') or c = '〇' group by c")
def _(t):
    c = t("parallel_pair").select(F.explode(tx.characters(F.col("text_src"))).alias("c")).where(tx.keep_han_like(F.col("c")))
    return c.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query("txt_multiset_containment", "select rec_id, list_bool_and(list_transform(list_distinct(regexp_extract_all(text_oko, '[0-9]')), lambda x: length(text_oko) - length(replace(text_oko, x, '')) <= length(text_cko) - length(replace(text_cko, x, '')))) as held from aligned_corpus where text_oko is not null and text_cko is not null and regexp_matches(text_oko, '[0-9]')")
def _(t):
    a = t("aligned_corpus").where("text_oko is not null and text_cko is not null").where(F.col("text_oko").rlike("[0-9]"))
    return a.select("rec_id", tx.contains_multiset(F.col("text_cko"), F.regexp_replace("text_oko", "[^0-9]", "")).alias("held"))


@query("txt_slices", "select rec_key, left(rec_key, 4) as head, right(rec_key, 5) as tail, string_split(rec_key, '_')[-1] as last, regexp_replace(rec_key, '_[^_]*$', '') as parent from aligned_corpus")
def _(t):
    k = F.col("rec_key")
    return t("aligned_corpus").select("rec_key", F.expr("left(rec_key, 4)").alias("head"), F.expr("right(rec_key, 5)").alias("tail"), tx.last_part(k, "_").alias("last"), tx.parent_id(k).alias("parent"))


@query("txt_strip_lead", r"select rec_id, regexp_replace(text_src, '^(?:\[?[0-9]+\]?\s*|○\s*)', '') as text from parallel_pair")
def _(t):
    return t("parallel_pair").select("rec_id", tx.strip_lead(F.col("text_src"), r"\[?[0-9]+\]?\s*|○\s*").alias("text"))


@query("txt_url_parts", "select rec_id, string_split(meta_url_hj, '/')[3] as host, regexp_extract(meta_url_hj, '/([^/]+)$', 1) as page from aligned_corpus where meta_url_hj is not null")
def _(t):
    u = F.col("meta_url_hj")
    return t("aligned_corpus").where("meta_url_hj is not null").select("rec_id", F.parse_url(u, F.lit("HOST")).alias("host"), F.regexp_extract(u, "/([^/]+)$", 1).alias("page"))


@query("txt_query_value", "select p_partkey, p_name as decoded from part")
def _(t):
    u = F.concat(F.lit("https://example.invalid/v?id=1&name="), F.url_encode("p_name"))
    return t("part").select("p_partkey", tx.query_value(u, "name").alias("decoded"))


@query("txt_words_of_number")
def _(t):
    return t("documents").groupBy("lang").agg(F.sum("n_chars").alias("chars")).withColumn("words", tx.words_of_number(F.col("chars")))


@query("txt_truncate_words", f"select text_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g')), ' '), 1, 12), ' ') as head from mono_text")
def _(t):
    return t("mono_text").select("text_id", tx.truncate_words(F.col("text"), 12).alias("head"))


@query("txt_escape_edges", "select text_id, repeat('␣', length(regexp_extract(text, '^ +'))) || trim(text, ' ') || case when length(trim(text, ' ')) > 0 then repeat('␣', length(regexp_extract(text, ' +$'))) else '' end as shown from mono_text where text is not null")
def _(t):
    return t("mono_text").where("text is not null").select("text_id", tx.escape_edges(F.col("text")).alias("shown"))


@query("txt_python_list", "select gloss_id, [hj, ko] as parts from glossary where hj is not null and ko is not null")
def _(t):
    lit = F.concat(F.lit("['"), "hj", F.lit("', '"), "ko", F.lit("']"))
    return t("glossary").where("hj is not null and ko is not null").select("gloss_id", tx.python_list(lit).alias("parts"))


@query("txt_prune_nulls", "select rec_id, list_filter([text_oko, text_cko, text_en], lambda x: x is not null) as texts from aligned_corpus")
def _(t):
    return t("aligned_corpus").select("rec_id", F.array_compact(F.array("text_oko", "text_cko", "text_en")).alias("texts"))


# ---- normalisation


@query("norm_full")
def _(t):
    return t("aligned_corpus").select("rec_id", nm.normalize(F.col("text_hj")).alias("text_hj"))


@query("norm_runs")
def _(t):
    return t("aligned_corpus").select("rec_id", nm.korean(F.col("text_hj")).alias("korean"), nm.japanese(F.col("text_hj")).alias("japanese"))


_A, _B = (x.replace("'", "''") for x in nm.CJK)


@query("norm_cjk", f"select rec_id, translate(text_hj, '{_A}', '{_B}') as text_hj from aligned_corpus")
def _(t):
    return t("aligned_corpus").select("rec_id", nm.cjk(F.col("text_hj")).alias("text_hj"))


_MA, _MB = (x.replace("'", "''") for x in nm.MARKS)
_ONES = {a: b for a, b in nm.SIMILAR.items() if len(b) == 1}
_SA, _SB = ("".join(_ONES).replace("'", "''"), "".join(_ONES.values()).replace("'", "''"))


@query("norm_punctuation", f"select text_id, replace(translate(translate(text, '{_MA}', '{_MB}'), '{_SA}', '{_SB}'), '…', '...') as text from mono_text")
def _(t):
    return t("mono_text").select("text_id", nm.punctuation(F.col("text")).alias("text"))


@query("norm_items")
def _(t):
    x = tg.map_items(tg.to_items(tg.wrap_punctuation(F.col("text_src"))), lambda c: nm.cjk(tx.squeeze_blanks(c)))
    return t("parallel_pair").select("rec_id", tg.from_items(x).alias("text"))


# ---- tagged text


@query("tag_wrap_punctuation", f"select rec_id, regexp_replace(text_src, '([\\p{{P}}\\p{{Z}}|\\n\\t]+)', '<▪punc>\\1</▪punc>', 'g') as tagged from parallel_pair where not regexp_matches(text_src, '[【】〔〕#&@※]')")
def _(t):
    p = t("parallel_pair").where(~F.col("text_src").rlike("[【】〔〕#&@※]"))
    return p.select("rec_id", tg.wrap_punctuation(F.col("text_src")).alias("tagged"))


def _named(t):
    """Numbers as tagged entities: the stand-in for entity mark-up, which the tables lack."""
    return t("parallel_pair").where("text_tgt is not null").select("rec_id", "meta_corpus", "split", "text_tgt", F.regexp_replace("text_tgt", "([0-9]+)", "<▪num>$1</▪num>").alias("tagged"))


@query("tag_plain_text", "select rec_id, text_tgt as plain from parallel_pair where text_tgt is not null")
def _(t):
    return _named(t).select("rec_id", tg.plain_text(F.col("tagged")).alias("plain"))


@query("tag_items_roundtrip", "select rec_id, true as same, true as valid from parallel_pair where text_tgt is not null")
def _(t):
    c = F.col("tagged")
    return _named(t).select("rec_id", (tg.from_items(tg.to_items(c)) == c).alias("same"), tg.is_valid(c).alias("valid"))


@query("tag_entity_counts", "select meta_corpus, 'num' as name, sum(len(regexp_extract_all(text_tgt, '[0-9]+')))::bigint as n from parallel_pair where text_tgt is not null and regexp_matches(text_tgt, '[0-9]') group by 1")
def _(t):
    return _named(t).select("meta_corpus", F.explode(tg.names(F.col("tagged"))).alias("name")).groupBy("meta_corpus", "name").agg(F.count(F.lit(1)).alias("n"))


@query("tag_min_entities", "select rec_id, len(regexp_extract_all(text_tgt, '[0-9]+')) >= 2 as enough from parallel_pair where text_tgt is not null")
def _(t):
    return _named(t).select("rec_id", (F.regexp_count("tagged", F.lit("</▪")) >= 2).alias("enough"))


@query("tag_iob_roundtrip", "select rec_id, length(text_tgt)::int as tokens, true as same from parallel_pair where text_tgt is not null and length(text_tgt) > 0")
def _(t):
    iob = tg.to_iob(tg.to_items(F.col("tagged")))
    d = _named(t).where("length(text_tgt) > 0").select("rec_id", "tagged", iob.alias("iob"))
    return d.select("rec_id", F.size("iob").alias("tokens"), (tg.from_items(tg.from_iob(F.col("iob"))) == F.col("tagged")).alias("same"))


@query("tag_relabel", "select rec_id, regexp_replace(text_tgt, '([0-9]+)', '<▪number>\\1</▪number>', 'g') as renamed, text_tgt as unwrapped, regexp_replace(text_tgt, '([0-9]+)', '<▪other>\\1</▪other>', 'g') as collapsed, regexp_replace(text_tgt, '([0-9]+)', '<▪x_num>\\1</▪x_num>', 'g') as prefixed from parallel_pair where text_tgt is not null")
def _(t):
    c = F.col("tagged")
    return _named(t).select("rec_id", tg.relabel(c, {"num": "number"}).alias("renamed"), tg.relabel(c, {"other": "x"}, keep_unmapped=False).alias("unwrapped"), tg.collapse_labels(c).alias("collapsed"), tg.prefix_labels(c, F.lit("x")).alias("prefixed"))


@query("tag_drop_punctuation", f"select rec_id, regexp_replace(text_src, '[\\p{{P}}\\p{{Z}}|\\n\\t]+', '', 'g') as bare from parallel_pair where not regexp_matches(text_src, '[【】〔〕#&@※]')")
def _(t):
    p = t("parallel_pair").where(~F.col("text_src").rlike("[【】〔〕#&@※]"))
    return p.select("rec_id", tg.drop_punctuation(tg.wrap_punctuation(F.col("text_src"))).alias("bare"))


@query("tag_inner_punctuation")
def _(t):
    return _named(t).select("rec_id", tg.from_items(tg.strip_inner_punctuation(tg.to_items(F.col("tagged")))).alias("text"))


@query("tag_transfer_punctuation")
def _(t):
    d = _named(t).where("length(text_tgt) > 0")
    bare = tg.to_items(F.regexp_replace(F.regexp_replace("text_tgt", tx.PUNC_RUN + "+", ""), "([0-9]+)", "<▪num>$1</▪num>"))
    out = tg.from_items(tg.transfer_punctuation(bare, F.col("text_tgt")))
    return d.select("rec_id", out.alias("tagged"), (tg.plain_text(out) == F.col("text_tgt")).alias("same"))


@query("tag_punctuation_iob")
def _(t):
    labels = {"。": "P1", "，": "P2", "? ": "P3", ". ": "P4", ", ": "P5", ".": "P6"}
    d = t("parallel_pair").where("text_src is not null").select("rec_id", tg.punctuation_iob(F.col("text_src"), labels).alias("iob"))
    return d.select("rec_id", F.size("iob").alias("tokens"), F.size(F.filter("iob", lambda x: x["tag"] != "O")).alias("marks"), tg.restore_punctuation(F.col("iob"), {v: k for k, v in labels.items()}).alias("restored"))


_REDUCED = "case when greatest(a, b, c) = 0 then '' when a = greatest(a, b, c) then '?' when b = greatest(b, c) then '。' else ',' end"


@query("tag_reduce_run", f"with r as (select distinct unnest(regexp_extract_all(translate(text, '【】〔〕#&@※', 'xxxxxxxx'), '{P}+')) as run from mono_text), n as (select run, len(regexp_extract_all(run, '[?？]')) as a, len(regexp_extract_all(run, '[。.!！｡．]')) as b, len(regexp_extract_all(run, '[,，、;；:：·]')) as c from r) select run, {_REDUCED} as reduced from n")
def _(t):
    r = t("mono_text").select(F.explode(tx.punctuation_runs(F.col("text"))).alias("run")).distinct()
    return r.withColumn("reduced", tg.reduce_run(F.col("run")))


@query("tag_reduce_text")
def _(t):
    return t("mono_text").select("text_id", tg.reduce_punctuation(F.col("text")).alias("reduced"), tg.from_items(tg.reduce_items(tg.to_items(tg.wrap_punctuation(F.col("text"))))).alias("tagged"))


@query("tag_encode_labels")
def _(t):
    iob = tg.to_iob(tg.to_items(F.col("tagged")))
    tags = ["O", "B-num", "I-num"]
    d = _named(t).where("length(text_tgt) > 0").select("rec_id", iob.alias("iob")).withColumn("ids", tg.encode_labels(F.col("iob"), {x: i for i, x in enumerate(tags)}))
    return d.select("rec_id", F.aggregate("ids", F.lit(0), lambda a, x: a + x).alias("total"), (tg.decode_labels(F.col("ids"), tags) == F.transform("iob", lambda x: x["tag"])).alias("same"))


@query("tag_spans_to_items")
def _(t):
    d = t("parallel_pair").where("length(text_tgt) >= 8").select("rec_id", "text_tgt", F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("head").alias("tag")), F.struct(F.lit(4).alias("start"), F.lit(6).alias("end"), F.lit("mid").alias("tag"))).alias("spans"))
    return d.select("rec_id", tg.from_items(tg.spans_to_items(F.col("text_tgt"), F.col("spans"))).alias("tagged"))


@query("tag_mark_names")
def _(t):
    r = t("mono_text").select(F.explode(tx.punctuation_runs(F.col("text"))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return r.withColumn("name", tx.character_names(F.col("run")))


def _pages(t):
    """Pages made of the aligned records: the tables hold no HTML."""
    e = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title>"), e(F.col("rec_key")), F.lit("</title></head><body><div class='hj'>"), e(F.col("text_hj")), F.lit("</div><div class='ko'><p>"), e(F.col("text_oko")), F.lit("</p></div><table><tr><td>"), F.coalesce("date_id", F.lit("")), F.lit("</td><td>"), F.col("total").cast("string"), F.lit("</td></tr></table></body></html>"))
    return t("aligned_corpus").select("rec_id", page.alias("html"))


@query("html_records")
def _(t):
    return ht.page_records(_pages(t), "rec_id", "html", ["title", "div.hj", "div.ko"])


@query("html_table_rows", "select rec_id, 0 as row_idx, trim(regexp_replace(coalesce(date_id, ''), '\\s+', ' ', 'g')) as first, total::varchar as second from aligned_corpus where total is not null")
def _(t):
    return ht.table_rows(_pages(t), "rec_id", "html").select("rec_id", "row_idx", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"))


@query("html_to_tagged")
def _(t):
    return _pages(t).select("rec_id", ht.html_to_tagged(F.col("html"), {"p": "ko", "td": "cell"}, ["title"]).alias("tagged"))


@query("html_tag_census", "select rec_id, ['title', 'div', 'p', 'table'] as tags from aligned_corpus where total is not null")
def _(t):
    return _pages(t).where("html is not null").select("rec_id", tg.tag_census(F.col("html"), ["title", "div", "p", "span", "table"]).alias("tags"))


# ---- dates and messages


@query("date_lunar", r"select rec_id, regexp_extract(d, '^(\S+)_\d+년', 1) || '_' || regexp_extract(d, '_(\d+)년', 1) || '년_' || regexp_extract(d, '_(\d\d)월', 1) || '월(윤' || regexp_extract(d, '윤(\d)', 1) || ')_' || regexp_extract(d, '_(\d\d)일', 1) || '일' as day from (select rec_id, trim(date_id) as d from aligned_corpus where date_id is not null)")
def _(t):
    return t("aligned_corpus").where("date_id is not null").select("rec_id", ms.lunar_date(F.trim("date_id")).alias("day"))


@query("date_short_id", r"select rec_id, lpad(regexp_extract(x, '(\d{3,})년', 1), 4, '0') || '-' || lpad(regexp_extract(x, '(\d{1,2})월', 1), 2, '0') || '-' || case when contains(x, '윤') then '1' else '0' end || '-' || lpad(regexp_extract(x, '(\d{1,2})일', 1), 2, '0') as day, regexp_extract(x, '(\d{3,})년', 1)::int as year from (select rec_id, (1500 + order_no) || '년 ' || case when order_no % 2 = 0 then '윤' else '' end || '3월 ' || total || '일' as x from aligned_corpus where order_no is not null and total between 1 and 30)")
def _(t):
    a = t("aligned_corpus").where("order_no is not null and total between 1 and 30")
    x = F.concat((F.lit(1500) + F.col("order_no")).cast("string"), F.lit("년 "), F.when(F.col("order_no") % 2 == 0, "윤").otherwise(""), F.lit("3월 "), F.col("total").cast("string"), F.lit("일"))
    return a.select("rec_id", ms.solar_like_id(x).alias("day"), ms.year(x).alias("year"))


_NAME = "case {c} when 'hj' then 'Hanja' when 'cc' then 'Classical Chinese' when 'ko' then 'Korean' when 'oko' then 'Old Korean' when 'zh' then 'Chinese' when 'en' then 'English' when 'ja' then 'Japanese' else {c} end"


@query("msg_translation", f"""
    select rec_id, 'Translate the following text from ' || s || ' into ' || g || '.' || chr(10) || s || ': ' || text_src || chr(10) || g || ': ' as asked, text_tgt as answered
    from (select *, {_NAME.format(c='lang_src')} as s, {_NAME.format(c='lang_tgt')} as g from parallel_pair) where text_src is not null and text_tgt is not null and lang_src is not null and lang_tgt is not null""")
def _(t):
    m = ms.translation_messages(F.col("text_src"), F.col("text_tgt"), F.col("lang_src"), F.col("lang_tgt"))
    d = t("parallel_pair").select("rec_id", F.from_json(m, "array<struct<role:string,content:string>>").alias("m")).where("m is not null")
    return d.select("rec_id", F.col("m")[0]["content"].alias("asked"), F.col("m")[1]["content"].alias("answered"))


@query("msg_prompt", f"""
    select rec_id, 'Translate the following text from ' || s || ' into ' || g || '.' || chr(10) || s || ': ' || text_src || chr(10) || g || ': ' as asked, 1 as turns
    from (select *, {_NAME.format(c='lang_src')} as s, {_NAME.format(c='lang_tgt')} as g from parallel_pair) where text_src is not null and lang_src is not null and lang_tgt is not null""")
def _(t):
    m = ms.prompt_messages(F.col("text_src"), F.col("lang_src"), F.col("lang_tgt"))
    d = t("parallel_pair").select("rec_id", F.from_json(m, "array<struct<role:string,content:string>>").alias("m")).where("m is not null")
    return d.select("rec_id", F.col("m")[0]["content"].alias("asked"), F.size("m").alias("turns"))


@query("msg_prompt_with_reference", """
    select rec_id, 'Translate the following text from Hanja into English, based on the reference translation in Old Korean.' || chr(10) || 'Hanja: ' || text_hj || chr(10) || 'Old Korean: ' || text_oko || chr(10) || 'English: ' as asked
    from aligned_corpus where text_hj is not null and text_oko is not null""")
def _(t):
    m = ms.prompt_messages(F.col("text_hj"), F.lit("hj"), F.lit("en"), F.col("text_oko"), F.lit("oko"))
    d = t("aligned_corpus").select("rec_id", F.from_json(m, "array<struct<role:string,content:string>>").alias("m")).where("m is not null")
    return d.select("rec_id", F.col("m")[0]["content"].alias("asked"))


@query("msg_role_rename", "select rec_id, 'user' as first, 'assistant' as second, true as same from parallel_pair where text_src is not null and text_tgt is not null")
def _(t):
    turns = F.to_json(F.array(F.struct(F.lit("human").alias("from"), F.col("text_src").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("text_tgt").alias("value"))))
    d = t("parallel_pair").where("text_src is not null and text_tgt is not null").select("rec_id", turns.alias("j")).withColumn("r", ms.sharegpt_to_roles(F.col("j")))
    r = F.from_json("r", "array<struct<role:string,content:string>>")
    return d.select("rec_id", r[0]["role"].alias("first"), r[1]["role"].alias("second"), (ms.roles_to_sharegpt(F.col("r")) == F.col("j")).alias("same"))


@query("msg_chat_length", "select rec_id, (length(text_src) + length(text_tgt) + 9)::int as n from parallel_pair where text_src is not null and text_tgt is not null")
def _(t):
    d = t("parallel_pair").where("text_src is not null and text_tgt is not null")
    return d.select("rec_id", ms.chat_tokens(F.array("text_src", "text_tgt"), F.length("text_src") + F.length("text_tgt")).alias("n"))


# ---- dataset hygiene


@query("hyg_hash_split", f"select rec_id, {SPLIT} as split from (select rec_id, {U.format(k='rec_id')} as u from parallel_pair)")
def _(t):
    return t("parallel_pair").select("rec_id", hy.hash_split(F.col("rec_id")).alias("split"))


@query("hyg_two_level_split", f"select doc_id, {SPLIT} || case when v < 0.5 then '' else '2' end as split from (select doc_id, {U.format(k='doc_id')} as u, {U.format(k='source')} as v from documents where source is not null)")
def _(t):
    return t("documents").where("source is not null").select("doc_id", hy.two_level_split(F.col("source"), F.col("doc_id")).alias("split"))


@query("hyg_dedup_within_split", "select split, rec_id from (select *, row_number() over (partition by split, text_src, text_tgt order by sha256(rec_id || '/42'), rec_id) as rn from parallel_pair where split is not null and text_src is not null and text_tgt is not null) where rn = 1")
def _(t):
    return hy.dedup_within(t("parallel_pair").select("split", "rec_id", "text_src", "text_tgt"), "split", ["text_src", "text_tgt"], "rec_id").select("split", "rec_id")


@query("hyg_global_dedup", "select rec_id from (select *, row_number() over (partition by text_src order by sha256(rec_id || '/42'), rec_id) as rn from parallel_pair where text_src is not null) where rn = 1")
def _(t):
    d = t("parallel_pair").select("rec_id", "text_src", F.lit("all").alias("split"))
    return hy.dedup_within(d, "split", ["text_src"], "rec_id").select("rec_id")


@query("hyg_leaks_test", "select rec_id, split from parallel_pair p where not coalesce(split in ('train', 'valid'), false) or not exists (select 1 from parallel_pair x where x.split = 'test' and x.text_src = p.text_src)")
def _(t):
    return hy.drop_leaks(t("parallel_pair").select("rec_id", "split", "text_src"), "split", ["text_src"], "test", ["train", "valid"]).select("rec_id", "split")


@query("hyg_leaks_valid", "select rec_id, split from parallel_pair p where not coalesce(split = 'train', false) or not exists (select 1 from parallel_pair x where x.split = 'valid' and x.text_src = p.text_src and x.text_tgt = p.text_tgt)")
def _(t):
    return hy.drop_leaks(t("parallel_pair").select("rec_id", "split", "text_src", "text_tgt"), "split", ["text_src", "text_tgt"], "valid", ["train"]).select("rec_id", "split")


@query("hyg_pipeline", """
    with a as (select *, row_number() over (partition by split, text_src order by sha256(rec_id || '/42'), rec_id) as rn from parallel_pair where split is not null and text_src is not null),
    b as (select * from a where rn = 1), c as (select * from b p where split not in ('train', 'valid') or not exists (select 1 from b x where x.split = 'test' and x.text_src = p.text_src))
    select rec_id, split from c p where split <> 'train' or not exists (select 1 from c x where x.split = 'valid' and x.text_src = p.text_src)""")
def _(t):
    return hy.hygiene(t("parallel_pair").select("rec_id", "split", "text_src"), "split", "text_src", "rec_id").select("rec_id", "split")


@query("hyg_pipeline_length", """
    with a as (select *, row_number() over (partition by split, text_src order by sha256(rec_id || '/42'), rec_id) as rn from parallel_pair where split is not null and text_src is not null),
    b as (select * from a where rn = 1), c as (select * from b p where split not in ('train', 'valid') or not exists (select 1 from b x where x.split = 'test' and x.text_src = p.text_src))
    select rec_id, split from c p where (split <> 'train' or not exists (select 1 from c x where x.split = 'valid' and x.text_src = p.text_src)) and length(text_src) between 1 and 100""")
def _(t):
    return hy.hygiene(t("parallel_pair").select("rec_id", "split", "text_src"), "split", "text_src", "rec_id", F.length("text_src"), 100).select("rec_id", "split")


@query("hyg_split_remap", "select rec_id, case when meta_corpus = 'klc' and split = 'test' then 'test0' when meta_corpus = 'klc' and split = 'test2' then 'test' when meta_corpus = 'ocdb' then 'test' else split end as split from parallel_pair where case when meta_corpus = 'klc' and split = 'test' then 'test0' when meta_corpus = 'klc' and split = 'test2' then 'test' when meta_corpus = 'ocdb' then 'test' else split end not in ('train', 'valid', 'test0')")
def _(t):
    c, s = F.col("meta_corpus"), F.col("split")
    new = F.when((c == "klc") & (s == "test"), "test0").when((c == "klc") & (s == "test2"), "test").when(c == "ocdb", "test").otherwise(s)
    return t("parallel_pair").select("rec_id", new.alias("split")).where(~F.col("split").isin("train", "valid", "test0"))


@query("hyg_alignment_rules", "with k as (select hj from link where hj is not null group by hj having count(distinct ko) = 1) select a.rec_id, case when length(a.text_oko) >= 20 and a.meta_data_id_hj in (select hj from k) then a.text_oko end as text_oko from aligned_corpus a")
def _(t):
    k = t("link").where("hj is not null").groupBy("hj").agg(F.count_distinct("ko").alias("n")).where("n = 1").select(F.col("hj").alias("meta_data_id_hj"), F.lit(True).alias("ok"))
    a = t("aligned_corpus").select("rec_id", "meta_data_id_hj", "text_oko").join(k, "meta_data_id_hj", "left")
    return a.select("rec_id", F.when((F.length("text_oko") >= 20) & F.coalesce("ok", F.lit(False)), F.col("text_oko")).alias("text_oko"))


@query("hyg_ordinal_consistency", "with b as (select date_id from aligned_corpus where date_id is not null and cast(right(rec_key, 3) as int) <> order_no) select rec_id, case when date_id is null or date_id not in (select date_id from b) then text_oko end as text_oko from aligned_corpus")
def _(t):
    a = t("aligned_corpus")
    bad = a.where("date_id is not null and cast(right(rec_key, 3) as int) <> order_no").select("date_id").distinct().withColumn("bad", F.lit(True))
    return a.join(bad, "date_id", "left").select("rec_id", F.when(F.col("bad").isNull(), F.col("text_oko")).alias("text_oko"))


@query("hyg_augmentation_merge", "select p.rec_id, case when not regexp_matches(regexp_replace(p.text_tgt, '^(?:답|A):\\s*', ''), '^[A-Za-z]') then regexp_replace(p.text_tgt, '^(?:답|A):\\s*', '') end as answer from parallel_pair p where p.text_tgt is not null")
def _(t):
    a = F.regexp_replace("text_tgt", r"^(?:답|A):\s*", "")
    return t("parallel_pair").where("text_tgt is not null").select("rec_id", F.when(~a.rlike("^[A-Za-z]"), a).alias("answer"))


@query("hyg_answers_joined_back", "with a as (select rec_id, regexp_replace(text_tgt, '^(?:답|A):\\s*', '') as x from parallel_pair where text_tgt is not null and split = 'train') select p.rec_id, case when not regexp_matches(a.x, '^[A-Za-z]') then a.x end as answer from parallel_pair p left join a on p.rec_id = a.rec_id")
def _(t):
    p = t("parallel_pair")
    return hy.merge_answers(p.select("rec_id"), p.where("text_tgt is not null and split = 'train'"), ["rec_id"], "text_tgt", "answer")


@query("hyg_json_array_alignment", "select rec_id, array_to_string(string_split(text_hj, chr(10)), ' ') as hj, array_to_string(string_split(text_oko, chr(10)), ' ') as ko from aligned_corpus where len(string_split(text_hj, chr(10))) = len(string_split(text_oko, chr(10)))")
def _(t):
    j = t("aligned_corpus").where("text_hj is not null and text_oko is not null").select("rec_id", F.to_json(F.split("text_hj", "\n")).alias("a"), F.to_json(F.split("text_oko", "\n")).alias("b"))
    j = j.select("rec_id", F.from_json("a", "array<string>").alias("a"), F.from_json("b", "array<string>").alias("b")).where("size(a) > 0 and size(a) = size(b)")
    return j.select("rec_id", F.array_join("a", " ").alias("hj"), F.array_join("b", " ").alias("ko"))


# ---- incremental processing


@query("inc_not_done", "select rec_id, lang_src from parallel_pair p where not exists (select 1 from parallel_pair d where d.split = 'test' and d.rec_id = p.rec_id and d.lang_src = p.lang_src)")
def _(t):
    p = t("parallel_pair").select("rec_id", "lang_src", "split")
    return inc.not_done(p, p.where("split = 'test'"), ["rec_id", "lang_src"]).select("rec_id", "lang_src")


@query("inc_failed", "select rec_id from aligned_corpus where text_oko is null")
def _(t):
    return inc.failed(t("aligned_corpus"), "text_oko").select("rec_id")


def _halved(text: str) -> str:
    if not text.strip():
        raise ValueError("blank")
    return str(len(text) // 2)


@query("inc_mapped", """
    select rec_id as id, 'half' as model_id, text_src as text, case when regexp_matches(text_src, '[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]') then (length(text_src) // 2)::varchar end as content,
        case when text_src is null then 'ValueError: no text' when not regexp_matches(text_src, '[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]') then 'ValueError: blank' end as error
    from parallel_pair where coalesce(split, '') <> 'test' or text_src is null""")
def _(t):
    p = t("parallel_pair")
    done = p.where("split = 'test'").select(F.col("rec_id").alias("id"), F.lit("half").alias("model_id"), F.col("text_src").alias("content"))
    return inc.mapped(p, "rec_id", "text_src", _halved, "half", done).drop("duration")


# ---- metrics


def _systems(t):
    return t("aligned_corpus").where("text_cko is not null").select("rec_id", "meta_corpus", F.col("text_oko").alias("hyp"), F.col("text_cko").alias("ref"))


@query("met_bleu_char", """
    with r as (select rec_id, meta_corpus, regexp_extract_all(regexp_replace(coalesce(text_oko, ''), '[\\s\\p{Z}]+', '', 'g'), '(?s).') as h, regexp_extract_all(regexp_replace(text_cko, '[\\s\\p{Z}]+', '', 'g'), '(?s).') as f from aligned_corpus where text_cko is not null),
    g as (select rec_id, meta_corpus, n, unnest(list_transform(range(1, greatest(len(h) - n + 2, 1)), lambda i: array_to_string(h[i:i + n - 1], chr(1)))) as x from r, (values (1), (2), (3), (4)) o(n)),
    k as (select rec_id, n, unnest(list_transform(range(1, greatest(len(f) - n + 2, 1)), lambda i: array_to_string(f[i:i + n - 1], chr(1)))) as x from r, (values (1), (2), (3), (4)) o(n)),
    gc as (select rec_id, meta_corpus, n, x, count(*) as c from g group by all), kc as (select rec_id, n, x, count(*) as c from k group by all),
    s as (select gc.meta_corpus, gc.n, sum(least(gc.c, coalesce(kc.c, 0))) as m, sum(gc.c) as t from gc left join kc on gc.rec_id = kc.rec_id and gc.n = kc.n and gc.x = kc.x group by all),
    l as (select meta_corpus, sum(len(h)) as hl, sum(len(f)) as fl, count(*) as rows from r group by 1)
    select s.meta_corpus, round(100 * (case when hl >= fl then 1.0 else exp(1 - fl / hl) end) * exp(sum(ln(m / t)) / 4), 6) as bleu, rows from s join l on s.meta_corpus is not distinct from l.meta_corpus group by s.meta_corpus, hl, fl, rows""")
def _(t):
    return mt.corpus_bleu(_systems(t), ["meta_corpus"], "hyp", "ref").withColumn("bleu", F.round("bleu", 6))


@query("met_bleu_13a")
def _(t):
    d = t("aligned_corpus").where("text_en is not null").select("meta_corpus", F.col("text_en").alias("ref"), F.regexp_replace("text_en", "of ", "for ").alias("hyp"))
    return mt.corpus_bleu(d, ["meta_corpus"], "hyp", "ref", mt.tokens_13a)


@query("met_bootstrap")
def _(t):
    d = t("aligned_corpus").where("text_cko is not null and text_oko is not null").select("rec_id", F.col("text_oko").alias("a"), F.regexp_replace("text_oko", "다", "라").alias("b"), F.col("text_cko").alias("ref"))
    return mt.paired_bootstrap(d, "rec_id", "a", "b", "ref", 2000)


@query("met_entity_f1")
def _(t):
    d = _named(t)
    hyp = F.regexp_replace("text_tgt", "([0-9]{2,})", "<▪num>$1</▪num>")
    return mt.span_f1(mt.entity_spans(d, "rec_id", "tagged"), mt.entity_spans(d.select("rec_id", hyp.alias("h")), "rec_id", "h"), "rec_id")


@query("met_punctuation_f1")
def _(t):
    d = t("parallel_pair").where("text_src is not null").select("rec_id", "text_src")
    marks = lambda c: F.transform(tg.punctuation_after(c), lambda x: tg.reduce_run(x["mark"]))
    spans = lambda c: d.select("rec_id", F.posexplode(marks(c)).alias("start", "label")).where("label <> ''").select("rec_id", "start", (F.col("start") + 1).alias("end"), "label")
    return mt.span_f1(spans(F.col("text_src")), spans(F.regexp_replace("text_src", "，", "")), "rec_id")


@query("met_confusion", "select lower(trim(meta_corpus)) as ref, split as hyp, count(*) as n from parallel_pair where meta_corpus is not null and split is not null group by all")
def _(t):
    return mt.confusion(t("parallel_pair").withColumn("c", F.lower(F.trim("meta_corpus"))), "c", "split")


@query("met_weighted", """
    with d as (select lang_src as r, lang_tgt as h, count(*) as n from parallel_pair where lang_src is not null and lang_tgt is not null group by all),
    s as (select r as x, sum(n) as support, sum(case when r = h then n else 0 end) as tp from d group by 1), f as (select h as x, sum(n) as found from d group by 1)
    select sum(support)::bigint as n, round(sum(tp) / sum(support), 6) as accuracy, round(sum(case when coalesce(found, 0) > 0 then tp / found else 0 end * support) / sum(support), 6) as precision,
        round(sum(tp) / sum(support), 6) as recall, round(sum(2 * tp / (support + coalesce(found, 0)) * support) / sum(support), 6) as f1 from s left join f on s.x = f.x""")
def _(t):
    d = mt.weighted_scores(t("parallel_pair"), "lang_src", "lang_tgt")
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("met_kappa", "with d as (select l_linenumber::double as r, least(7, floor(l_quantity / 8) + 1)::double as h from lineitem), s as (select count(*) as n, avg((r = h)::int) as a, sum((r - h) * (r - h)) as o, sum(r * r) as rr, sum(h * h) as hh, sum(r) as rs, sum(h) as hs from d where r between 1 and 7 and h between 1 and 7) select n, round(a, 6) as accuracy, round(1 - o / (rr + hh - 2 * rs * hs / n), 6) as kappa from s")
def _(t):
    d = t("lineitem").select(F.col("l_linenumber").alias("r"), F.least(F.lit(7), F.floor(F.col("l_quantity") / 8) + 1).alias("h"))
    return mt.agreement(d, "r", "h", 1, 7).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


@query("met_ruzicka")
def _(t):
    d = mt.mean_ruzicka(t("parallel_pair"), F.col("text_src"), F.regexp_replace("text_src", "，", ""))
    return d.select("positions", "unlike", F.round("similarity", 2).alias("similarity"))


_CM = "select lang, c, count(*) as n from (select lang, unnest(regexp_extract_all(text, '(?s).')) as c from mono_text where lang in ('hj', 'cc', 'zh', 'ja')) group by all"


def _oov_mass(t, thresholds):
    g = t("mono_text").where(F.col("lang").isin("hj", "cc", "zh", "ja")).select("lang", F.explode(tx.characters(F.col("text"))).alias("c")).groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n"))
    r = q.running_share(g, "n", [F.desc("n"), F.col("c")], ["lang"]).withColumn("whole", F.sum("n").over(W.partitionBy("lang")))
    # Per character the languages that know it at each threshold; a vocabulary, not the texts, is joined.
    known = r.groupBy("c").agg(F.collect_list(F.struct("lang", "running_percent")).alias("known"))
    x = r.join(known, "c").withColumn("t", F.explode(F.array(*[F.lit(v) for v in thresholds]))).withColumn("l2", F.explode(F.array(*[F.lit(v) for v in ("hj", "cc", "zh", "ja")]))).where("l2 <> lang")
    miss = ~F.exists("known", lambda k: (k["lang"] == F.col("l2")) & (k["running_percent"] <= F.col("t")))
    return x.groupBy(F.col("lang").alias("l1"), "l2", F.col("t").alias("threshold")).agg(F.round(F.sum(F.when(miss, F.col("n")).otherwise(0)) / F.max("whole") * 100, 6).alias("oov"))


@query("met_oov_mass", f"""
    with g as ({_CM}), r as (select *, sum(n) over (partition by lang order by n desc, c rows unbounded preceding) / sum(n) over (partition by lang) * 100 as p, sum(n) over (partition by lang) as whole from g),
    k as (select lang, t, c from r, (values (90), (99), (100)) v(t) where p <= t)
    select a.lang as l1, b.lang as l2, v.t as threshold, round(sum(case when not exists (select 1 from k where k.lang = b.lang and k.t = v.t and k.c = a.c) then a.n else 0 end) / max(a.whole) * 100, 6) as oov from r a, (select distinct lang from g) b, (values (90), (99), (100)) v(t) where a.lang <> b.lang group by all""")
def _(t):
    return _oov_mass(t, (90, 99, 100))


@query("met_oov_thresholds", f"""
    with g as ({_CM}), r as (select *, sum(n) over (partition by lang order by n desc, c rows unbounded preceding) / sum(n) over (partition by lang) * 100 as p, sum(n) over (partition by lang) as whole from g),
    v(t) as (values (100::double), (99.99::double), (99.9::double), (99::double), (95::double), (90::double)), k as (select lang, t, c from r, v where p <= t)
    select a.lang as l1, b.lang as l2, v.t as threshold, round(sum(case when not exists (select 1 from k where k.lang = b.lang and k.t = v.t and k.c = a.c) then a.n else 0 end) / max(a.whole) * 100, 6) as oov from r a, (select distinct lang from g) b, v where a.lang <> b.lang group by all""")
def _(t):
    return _oov_mass(t, (100.0, 99.99, 99.9, 99.0, 95.0, 90.0))


@query("met_vocabulary_size", "select lang, count(distinct c) as size, round(sum((c not between ' ' and '~')::int) / count(*), 6) as outside_ascii from (select lang, unnest(regexp_extract_all(text, '(?s).')) as c from mono_text) group by lang")
def _(t):
    d = t("mono_text").select("lang", F.explode(tx.characters(F.col("text"))).alias("c"))
    return d.groupBy("lang").agg(F.count_distinct("c").alias("size"), F.round(F.sum((~F.col("c").between(" ", "~")).cast("int")) / F.count(F.lit(1)), 6).alias("outside_ascii"))


@query("met_corpus_bundle", "select meta_corpus, count(*) as samples, sum(length(text_hj))::bigint as chars, round(avg(length(text_hj)), 6) as mean, round(avg((text_oko is not null)::int) * 100, 6) as ratio_mt, round(avg(coalesce(regexp_matches(text_hj, '[。，]'), false)::int) * 100, 6) as ratio_punc from aligned_corpus group by 1")
def _(t):
    punc = F.coalesce(F.col("text_hj").rlike("[。，]"), F.lit(False)).cast("int")
    return t("aligned_corpus").groupBy("meta_corpus").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.length("text_hj")).alias("chars"), F.round(F.avg(F.length("text_hj")), 6).alias("mean"), F.round(F.avg(F.col("text_oko").isNotNull().cast("int")) * 100, 6).alias("ratio_mt"), F.round(F.avg(punc) * 100, 6).alias("ratio_punc"))


@query("met_label_inventory", f"""
    with g as (select run as label, count(*) as count from (select unnest(regexp_extract_all(translate(text_src, '【】〔〕#&@※', 'xxxxxxxx'), '{P}+')) as run from parallel_pair) group by 1),
    r as (select *, row_number() over (order by count desc, label) as idx, count / sum(count) over () * 100 as percent, sum(count) over (order by count desc, label rows unbounded preceding) / sum(count) over () * 100 as percent_cum from g)
    select idx, label, count, round(percent, 6) as percent, round(percent_cum, 6) as percent_cum, percent_cum <= 99 or lag(percent_cum, 1, 0) over (order by idx) <= 99 as is_target from r""")
def _(t):
    g = t("parallel_pair").select(F.explode(tx.punctuation_runs(F.col("text_src"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    w = W.orderBy(F.desc("count"), "label")  # an inventory of labels: a small table
    r = q.running_share(g, "count", [F.desc("count"), F.col("label")]).withColumn("idx", F.row_number().over(w).cast("bigint")).withColumn("percent", F.col("count") / F.sum("count").over(W.partitionBy()) * 100)
    r = r.withColumn("is_target", (F.col("running_percent") <= 99) | (F.lag("running_percent", 1, 0.0).over(w) <= 99))
    return r.select("idx", "label", "count", F.round("percent", 6).alias("percent"), F.round("running_percent", 6).alias("percent_cum"), "is_target")


@query("flagship_clean_split_counts", f"""
    with a as (select rec_id, trim(regexp_replace(text_src, '{WS}+', ' ', 'g')) as text, lang_src, {U.format(k='rec_id')} as u from parallel_pair),
    b as (select rec_id, text, lang_src, {SPLIT} as split, case when u < 0.8 then 2 when u < 0.9 then 1 else 0 end as k from a where text <> ''),
    c as (select *, row_number() over (partition by text order by k, sha256(rec_id || '/42'), rec_id) as rn from b)
    select split, lang_src, count(*) as n from c where rn = 1 group by all""")
def _(t):
    d = t("parallel_pair").select("rec_id", tx.blank_to_null(tx.squeeze_blanks(F.col("text_src"))).alias("text"), "lang_src").where("text is not null and text <> ''")
    d = hy.hygiene(d.withColumn("split", hy.hash_split(F.col("rec_id"))), "split", "text", "rec_id")
    return d.groupBy("split", "lang_src").agg(F.count(F.lit(1)).alias("n"))
