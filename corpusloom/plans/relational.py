"""Scans, projections, filters, joins, aggregates, windows, sorts and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import hygiene as hy
from ..operators import projection as pj
from ..operators import quality as q
from ..sources import readers as rd
from .registry import query

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"

# ---- scans and sinks


@query("scan_parquet", "select doc_id, lang, source, n_chars from documents")
def _(t):
    return t("documents").select("doc_id", "lang", "source", "n_chars")


@query("scan_pushdown", "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_quantity >= 45 and l_returnflag = 'R'")
def _(t):
    return t("lineitem").where("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("scan_json_column", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("sink_sample_sidecar", "select * from (select text_id, lang, meta_corpus from mono_text order by sha256(text_id || '/42'), text_id limit 100)")
def _(t):
    return rd.sample_sidecar(t("mono_text").select("text_id", "lang", "meta_corpus"), "text_id", 100)


@query("source_interleaved_pairs", """
    with l as (select rec_id, unnest(string_split(text_hj, chr(10))) as line, generate_subscripts(string_split(text_hj, chr(10)), 1) - 1 as pos from aligned_corpus where text_hj is not null)
    select rec_id, (pos // 2)::bigint as row_idx, max(case when pos % 2 = 0 then line end) as src, max(case when pos % 2 = 1 then line end) as tgt from l group by rec_id, pos // 2""")
def _(t):
    return rd.interleaved_pairs(t("aligned_corpus"), "rec_id", "text_hj")


@query("source_tab_pairs", "select string_split(x, chr(9))[1] as text, string_split(x, chr(9))[2] as label from (select key2 || chr(9) || lang_tgt as x from parallel_pair where key2 is not null and lang_tgt is not null)")
def _(t):
    d = t("parallel_pair").where("key2 is not null and lang_tgt is not null")
    return rd.tab_pairs(d.select(F.concat("key2", F.lit("\t"), "lang_tgt").alias("x")), "x")


@query("sink_parallel_lines", f"""
    with b as (select split, rec_id, lang_src || '-' || lang_tgt as f, lang_tgt || '-' || lang_src as r, trim(regexp_replace(text_src, '{WS}+', ' ', 'g')) as s, trim(regexp_replace(text_tgt, '{WS}+', ' ', 'g')) as g from parallel_pair where text_src is not null and text_tgt is not null and lang_src is not null and lang_tgt is not null)
    select split, f as direction, 'src' as side, rec_id as key, s as line from b union all select split, f, 'tgt', rec_id, g from b
    union all select split, r, 'src', rec_id, g from b union all select split, r, 'tgt', rec_id, s from b""")
def _(t):
    return rd.parallel_lines(t("parallel_pair"), "text_src", "text_tgt", "lang_src", "lang_tgt", "split", "rec_id")


@query("sink_stat_json", """
    select '{' || string_agg('"' || k || '":' || n, ',' order by k) || '}' as json from (select concat_ws('-', split, lang_src, lang_tgt) as k, count(*) as n from parallel_pair where split is not null and lang_src is not null group by split, lang_src, lang_tgt)""")
def _(t):
    g = t("parallel_pair").where("split is not null and lang_src is not null").groupBy("split", "lang_src", "lang_tgt").count()
    return rd.nested_counts_json(g, ["split", "lang_src", "lang_tgt"], "count")


# ---- projections


@query("proj_rename_drop", "select doc_id as key, text as body, lang as language, source as meta_source, n_chars, crawled_at as crawled from documents")
def _(t):
    return t("documents").withColumnsRenamed({"doc_id": "key", "text": "body", "lang": "language", "source": "meta_source", "crawled_at": "crawled"}).drop("title", "loaded_at")


@query("proj_suffix_prefix", "select c_custkey as cust_c_custkey_hj, c_name as cust_c_name_hj, c_nationkey as cust_c_nationkey_hj, c_acctbal as cust_c_acctbal_hj, c_mktsegment as cust_c_mktsegment_hj from customer")
def _(t):
    return pj.prefix_columns(pj.suffix_columns(t("customer"), "hj"), "cust")


@query("proj_canonical_columns", "select key2, lang, text, text_id, meta_corpus, meta_domain from mono_text")
def _(t):
    return pj.canonical_columns(t("mono_text").drop("loaded_at"))


@query("proj_drop_by_name", "select rec_id, rec_key, date_id, order_no, total, meta_corpus from aligned_corpus")
def _(t):
    return pj.drop_where(t("aligned_corpus"), lambda c: c.startswith("text") or "_id_" in c or "url" in c or c == "loaded_at")


@query("proj_constant_key", "select rec_id, 'pair' as kind, meta_corpus || '|' || meta_data_id_hj || '|' || lang_src || '|' || lang_tgt as key from parallel_pair")
def _(t):
    return t("parallel_pair").select("rec_id", F.lit("pair").alias("kind"), pj.composite_key(F.col("meta_corpus"), F.col("meta_data_id_hj"), F.col("lang_src"), F.col("lang_tgt")).alias("key"))


@query("proj_prefer", "select rec_id, coalesce(text_cko, text_oko) as text, case when text_cko is not null then 'text_cko' when text_oko is not null then 'text_oko' end as taken_from from aligned_corpus")
def _(t):
    return pj.prefer("text_cko", "text_oko", t("aligned_corpus")).select("rec_id", "text", "taken_from")


@query("proj_null_group", "select rec_id, case when not coalesce(total > 5, false) then text_oko end as text_oko, case when not coalesce(total > 5, false) then text_en end as text_en from aligned_corpus")
def _(t):
    return pj.null_columns_where(t("aligned_corpus").select("rec_id", "text_oko", "text_en", "total"), ["text_oko", "text_en"], F.col("total") > 5).drop("total")


@query("proj_first_by_rarity", "select rec_id, case when (select count(text_en) from aligned_corpus) <= (select count(text_cko) from aligned_corpus) then coalesce(text_en, text_cko, text_oko) else coalesce(text_cko, text_en, text_oko) end as text from aligned_corpus")
def _(t):
    return pj.first_by_rarity(t("aligned_corpus"), ["text_en", "text_cko", "text_oko"], "text_oko", "text").select("rec_id", "text")


@query("proj_merge_labelled", """
    select doc_id, array_to_string(list_sort(list_filter([case when lang is not null then 'lang: ' || lang end, case when title is not null then 'title: ' || title end, case when source is not null then 'source: ' || source end], lambda x: x is not null)), ' | ') as merged from documents""")
def _(t):
    return pj.merge_labelled(t("documents"), ["lang", "title", "source"], "merged").select("doc_id", "merged")


@query("proj_drop_if_equal", "select doc_id, n_chars, lang from documents")
def _(t):
    d = t("documents").select("doc_id", "n_chars", "lang").withColumn("doc_id_2", F.col("doc_id"))
    return pj.drop_if_equal(pj.drop_if_equal(d, "doc_id", "doc_id_2"), "doc_id", "n_chars")


@query("proj_drop_all_null", "select gloss_id, hj, ko, en from glossary")
def _(t):
    return pj.drop_all_null(t("glossary").withColumn("note", F.lit(None).cast("string")))


@query("proj_blank_to_null", f"select rec_id, case when not regexp_matches(text_src, '^{WS}*$') then text_src end as text_src, case when not regexp_matches(text_tgt, '^{WS}*$') then text_tgt end as text_tgt from parallel_pair")
def _(t):
    return pj.blanks_to_null(t("parallel_pair").select("rec_id", "text_src", "text_tgt"))


@query("proj_fill_null", "select text_id, coalesce(lang, 'N/A') as lang, coalesce(meta_domain, '') as meta_domain from mono_text")
def _(t):
    return t("mono_text").select("text_id", "lang", "meta_domain").na.fill({"lang": "N/A", "meta_domain": ""})


@query("proj_map_values", "select rec_id, case lang_src when 'hj' then 'Hanja' when 'ko' then 'Korean' end as mapped, case lang_src when 'hj' then 'Hanja' when 'ko' then 'Korean' else lang_src end as replaced from parallel_pair")
def _(t):
    m = {"hj": "Hanja", "ko": "Korean"}
    return t("parallel_pair").select("rec_id", pj.map_values(F.col("lang_src"), m).alias("mapped"), pj.map_values(F.col("lang_src"), m, keep=True).alias("replaced"))


@query("proj_padded_ids", "select o_orderkey, 'U' || lpad(row_number() over (order by o_orderkey)::varchar, length((count(*) over ())::varchar)::int, '0') as id from orders")
def _(t):
    return pj.padded_ids(t("orders").select("o_orderkey"), ["o_orderkey"], "U")


@query("proj_cast", "select rec_id, order_no::varchar as order_text, (total / 2)::double as half, cast(substr(rec_key, length(rec_key) - 2) as integer) as last_no from aligned_corpus")
def _(t):
    return t("aligned_corpus").select("rec_id", F.col("order_no").cast("string").alias("order_text"), (F.col("total") / 2).alias("half"), F.expr("cast(right(rec_key, 3) as int)").alias("last_no"))


@query("proj_struct_flatten", "select event_id, event_type, json_extract_string(props, '$.k')::bigint as k from events")
def _(t):
    return t("events").select(F.struct("event_id", "event_type", F.from_json("props", "k bigint").alias("p")).alias("s")).select("s.event_id", "s.event_type", "s.p.k")


@query("proj_percent", "select lang, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from documents group by lang")
def _(t):
    g = t("documents").groupBy("lang").count()
    return g.select("lang", F.round(F.col("count") * 100.0 / F.sum("count").over(W.partitionBy()), 6).alias("percent"))


# ---- filters


@query("filt_membership", "select rec_id, split from parallel_pair where split in ('valid', 'test') and lang_src = 'hj'")
def _(t):
    return t("parallel_pair").where(F.col("split").isin("valid", "test") & (F.col("lang_src") == "hj")).select("rec_id", "split")


@query("filt_not_in_keeps_null", "select rec_id, split from parallel_pair where split is null or split not in ('train', 'valid')")
def _(t):
    return t("parallel_pair").where(q.not_in(F.col("split"), ["train", "valid"])).select("rec_id", "split")


@query("filt_both_present", "select rec_id from aligned_corpus where text_oko is not null and text_en is not null")
def _(t):
    return t("aligned_corpus").where("text_oko is not null and text_en is not null").select("rec_id")


@query("filt_presence_mismatch", "select rec_id from aligned_corpus where (text_oko is null) <> (text_cko is null)")
def _(t):
    return t("aligned_corpus").where(q.presence_mismatch(F.col("text_oko"), F.col("text_cko"))).select("rec_id")


@query("filt_length", "select text_id, length(text) as n from mono_text where length(text) between 16 and 60")
def _(t):
    return t("mono_text").select("text_id", F.length("text").cast("bigint").alias("n")).where("n between 16 and 60")


@query("filt_regex", r"select text_id, len(regexp_extract_all(text, '[0-9]+'))::bigint as numbers from mono_text where regexp_matches(text, '^[0-9○]') or contains(text, 'fig.')")
def _(t):
    d = t("mono_text").where(F.col("text").rlike("^[0-9○]") | F.col("text").contains("fig."))
    return d.select("text_id", F.regexp_count("text", F.lit("[0-9]+")).cast("bigint").alias("numbers"))


@query("filt_sentinel_to_null", "select rec_id, case when length(text_src) < 20 and contains(text_src, '卒') then '' else text_src end as text_src from parallel_pair")
def _(t):
    c = F.col("text_src")
    return t("parallel_pair").select("rec_id", F.when((F.length(c) < 20) & c.contains("卒"), F.lit("")).otherwise(c).alias("text_src"))


@query("filt_script_share", r"select text_id, round(share, 6) as share from (select text_id, length(regexp_replace(text, '[^\p{P} 0-9가-힣]', '', 'g')) / length(text) as share from mono_text where length(text) > 0) where share >= 0.95")
def _(t):
    d = t("mono_text").select("text_id", tx.class_share(F.col("text"), r"[\p{P} 0-9가-힣]").alias("share"))
    return d.where("share >= 0.95").select("text_id", F.round("share", 6).alias("share"))


@query("filt_two_sided_length", "select rec_id from parallel_pair where length(text_src) between 1 and 120 and length(text_tgt) + 3 <= 200")
def _(t):
    return t("parallel_pair").where("length(text_src) between 1 and 120 and length(text_tgt) + 3 <= 200").select("rec_id")


@query("filt_length_window", "select rec_id from parallel_pair where length(text_src) between 1 and 60")
def _(t):
    return t("parallel_pair").where(q.length_window(F.length("text_src"), 60)).select("rec_id")


@query("filt_length_window_both", "select rec_id from parallel_pair where length(text_src) >= 1 and length(text_src) + 3 <= 90 and length(text_tgt) >= 1 and length(text_tgt) + 3 <= 150")
def _(t):
    return t("parallel_pair").where(q.length_window(F.length("text_src"), 90, extra=3) & q.length_window(F.length("text_tgt"), 150, extra=3)).select("rec_id")


@query("agg_best_per_position", "select l_orderkey, l_linenumber % 3 as place, max(l_quantity) as score, min_by(l_linenumber, (-l_quantity, l_linenumber)) as l_linenumber from lineitem group by 1, 2")
def _(t):
    d = t("lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("place"), F.col("l_quantity").alias("score"), "l_linenumber")
    return q.best_of(d, ["l_orderkey", "place"], "score", ["l_linenumber"])


@query("filt_length_by_language", "select rec_id from parallel_pair where not coalesce(length(text_src) > 100 and lang_src in ('hj', 'cc', 'zh'), false)")
def _(t):
    bad = (F.length("text_src") > 100) & F.col("lang_src").isin("hj", "cc", "zh")
    return t("parallel_pair").where(~F.coalesce(bad, F.lit(False))).select("rec_id")


@query("filt_parts_allowed", "select rec_id from parallel_pair where list_has_all(['hj', 'ko'], string_split(lang_src || '-' || lang_tgt, '-'))")
def _(t):
    return t("parallel_pair").where(q.parts_within(F.concat_ws("-", F.when(F.col("lang_src").isNotNull(), F.col("lang_src")), "lang_tgt"), ["hj", "ko"]) & F.col("lang_src").isNotNull() & F.col("lang_tgt").isNotNull()).select("rec_id")


@query("filt_contaminated_days", "select rec_id from aligned_corpus where date_id in (select date_id from aligned_corpus where text_oko is null)")
def _(t):
    return q.contaminated(t("aligned_corpus"), "date_id", F.col("text_oko").isNull()).select("rec_id")


@query("filt_clean_groups", "select rec_id from aligned_corpus a where text_oko is not null and (date_id is null or date_id not in (select date_id from aligned_corpus where text_oko is null and date_id is not null))")
def _(t):
    return q.clean_groups(t("aligned_corpus"), "date_id", F.col("text_oko").isNull()).select("rec_id")


@query("filt_unique_keys", "select ko, hj from link where ko in (select ko from link where ko is not null group by ko having count(*) = 1)")
def _(t):
    return q.unique_keys_only(t("link"), "ko").select("ko", "hj")


@query("filt_mixed_null_groups", "select date_id, count(text_en) as present, count(*) as rows from aligned_corpus group by date_id having count(text_en) between 1 and count(*) - 1")
def _(t):
    return q.mixed_null_groups(t("aligned_corpus"), "date_id", "text_en")


@query("filt_leaves", "with d as (select distinct rec_key as id from aligned_corpus union select distinct date_id from aligned_corpus where date_id is not null) select id from d where id not in (select regexp_replace(id, '_[^_]*$', '') from d)")
def _(t):
    a = t("aligned_corpus")
    d = a.select(F.col("rec_key").alias("id")).union(a.where("date_id is not null").select("date_id")).distinct()
    return q.leaves(d, "id", tx.parent_id(F.col("id")))


@query("filt_expect_unique", "select count(*) as rows, count(distinct rec_id) as keys, count(*) = count(distinct rec_id) as ok from parallel_pair")
def _(t):
    return q.expect_unique(t("parallel_pair"), "rec_id")


@query("filt_null_counts", "select count(*) filter (where split is null) as split, count(*) filter (where lang_src is null) as lang_src, count(*) filter (where meta_corpus is null) as meta_corpus from parallel_pair")
def _(t):
    return t("parallel_pair").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("split", "lang_src", "meta_corpus")])


# ---- joins


@query("join_left_keys", "select o.o_orderkey, o.o_totalprice, c.c_name from orders o left join customer c on o.o_custkey = c.c_custkey")
def _(t):
    o, c = t("orders"), t("customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "o_totalprice", "c_name")


@query("join_left_shared", "select n.n_name, r.r_name from nation n left join region r on n.n_regionkey = r.r_regionkey")
def _(t):
    return t("nation").withColumnRenamed("n_regionkey", "k").join(t("region").withColumnRenamed("r_regionkey", "k"), "k", "left").select("n_name", "r_name")


@query("join_inner_two_keys", "with a as (select lang, source, count(*) as n from documents group by all), b as (select lang, source, sum(n_chars)::bigint as chars from documents group by all) select a.lang, a.source, n, chars from a join b on a.lang = b.lang and a.source = b.source")
def _(t):
    d = t("documents")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).where("lang is not null and source is not null")


@query("join_bridge", f"""
    with l as (select distinct regexp_replace(lower(trim(ko)), '^w', 'k') as ko, regexp_replace(lower(regexp_replace(hj, '^{WS}+|{WS}+$', '', 'g')), '^w', 'k') as hj from link where ko is not null and hj is not null),
    u as (select ko, min(hj) as hj from l group by ko having count(*) = 1)
    select u.ko, u.hj, a.rec_id from u left join aligned_corpus a on a.meta_data_id_hj = u.hj""")
def _(t):
    key = lambda c, trim: F.regexp_replace(F.lower(trim), "^w", "k")
    l = t("link").where("ko is not null and hj is not null").select(key("ko", F.trim("ko")).alias("ko"), key("hj", F.regexp_replace("hj", f"^{WS}+|{WS}+$", "")).alias("hj")).distinct()
    u = l.groupBy("ko").agg(F.min("hj").alias("hj"), F.count(F.lit(1)).alias("n")).where("n = 1").select("ko", "hj")
    a = t("aligned_corpus").select("rec_id", "meta_data_id_hj")
    return u.join(a, u.hj == a.meta_data_id_hj, "left").select("ko", "hj", "rec_id")


@query("join_pivot_languages", "select meta_data_id_hj as id, count(*) filter (where lang_src = 'hj') as hj, count(*) filter (where lang_src = 'ko') as ko, max(length(text_src)) filter (where lang_src = 'hj') as longest from parallel_pair where meta_data_id_hj is not null group by 1")
def _(t):
    g = t("parallel_pair").where("meta_data_id_hj is not null").groupBy(F.col("meta_data_id_hj").alias("id"))
    return g.agg(F.count_if(F.col("lang_src") == "hj").alias("hj"), F.count_if(F.col("lang_src") == "ko").alias("ko"), F.max(F.when(F.col("lang_src") == "hj", F.length("text_src"))).cast("bigint").alias("longest"))


@query("join_ordinal_align", """
    with e as (select event_id, user_id, cast(ts as date) as day, event_type, row_number() over (partition by user_id, cast(ts as date), event_type order by ts, event_id) as rk, count(*) over (partition by user_id, cast(ts as date), event_type) as total from events)
    select a.event_id as left_id, b.event_id as right_id from (select * from e where event_type = 'click') a left join (select * from e where event_type = 'view') b on a.user_id = b.user_id and a.day = b.day and a.rk = b.rk and a.total = b.total""")
def _(t):
    e = t("events").withColumn("day", F.to_date("ts"))
    w = W.partitionBy("user_id", "day", "event_type")
    e = e.withColumn("rk", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("total", F.count(F.lit(1)).over(w))
    a = e.where("event_type = 'click'").select("user_id", "day", "rk", "total", F.col("event_id").alias("left_id"))
    b = e.where("event_type = 'view'").select("user_id", "day", "rk", "total", F.col("event_id").alias("right_id"))
    return a.join(b, ["user_id", "day", "rk", "total"], "left").select("left_id", "right_id")


@query("join_semi", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(t):
    return t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("join_anti", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def _(t):
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("join_duplicate_finder", "select a.rec_id from (select * from parallel_pair where split = 'train') a where exists (select 1 from parallel_pair b where b.split = 'test' and b.text_src = a.text_src and b.text_tgt = a.text_tgt)")
def _(t):
    p = t("parallel_pair")
    return p.where("split = 'train'").join(p.where("split = 'test'").select("text_src", "text_tgt"), ["text_src", "text_tgt"], "left_semi").select("rec_id")


@query("join_on_text_pair", "select a.rec_id as a, b.rec_id as b from parallel_pair a join parallel_pair b on a.text_src = b.text_src and a.text_tgt = b.text_tgt and a.rec_id < b.rec_id where a.meta_corpus = 'niu'")
def _(t):
    p = t("parallel_pair").select("rec_id", "text_src", "text_tgt", "meta_corpus")
    a, b = p.where("meta_corpus = 'niu'").withColumnRenamed("rec_id", "a").drop("meta_corpus"), p.withColumnRenamed("rec_id", "b").drop("meta_corpus")
    return a.join(b, ["text_src", "text_tgt"]).where("a < b").select("a", "b")


@query("join_zip", "with a as (select r_name, row_number() over (order by r_regionkey) as k from region), b as (select split, target_share, row_number() over (order by split) as k from split_target) select a.k, r_name, split, target_share from a left join b on a.k = b.k")
def _(t):
    a = t("region").select("r_name", F.row_number().over(W.orderBy("r_regionkey")).cast("bigint").alias("k"))
    b = t("split_target").select("split", "target_share", F.row_number().over(W.orderBy("split")).cast("bigint").alias("k"))
    return a.join(b, "k", "left").select("k", "r_name", "split", "target_share")


@query("join_report_order", """
    with dim as (select * from (values (1, 'drs'), (2, 'ajd'), (3, 'klc'), (4, 'hue')) v(pos, name)), s as (select lower(trim(meta_corpus)) as name, count(*) as n from parallel_pair where meta_corpus is not null group by 1)
    select coalesce(d.pos, 5) as pos, coalesce(d.name, s.name) as name, coalesce(n::varchar, 'N/A') as n from dim d full join s on d.name = s.name""")
def _(t):
    p = t("parallel_pair")
    dim = p.sparkSession.createDataFrame([(1, "drs"), (2, "ajd"), (3, "klc"), (4, "hue")], "pos int, name string")
    s = p.where("meta_corpus is not null").groupBy(F.lower(F.trim("meta_corpus")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return s.join(dim, "name", "full").select(F.coalesce("pos", F.lit(5)).alias("pos"), "name", F.coalesce(F.col("n").cast("string"), F.lit("N/A")).alias("n"))


@query("join_keyed_update", "select p.p_partkey, coalesce(n.p_name, p.p_name) as p_name, p.p_size from part p left join (select p_partkey, case when p_size > 25 then upper(p_name) end as p_name from part where p_partkey % 3 = 0) n on p.p_partkey = n.p_partkey")
def _(t):
    p = t("part").select("p_partkey", "p_name", "p_size")
    new = p.where("p_size is not null and mod(p_partkey, 3) = 0").select("p_partkey", F.when(F.col("p_size") > 25, F.upper("p_name")).alias("p_name"))
    return pj.coalesce_update(p, new, "p_partkey", ["p_name"])


@query("join_map_distinct", "select rec_id, length(meta_corpus)::int as name_length from parallel_pair")
def _(t):
    return tx.map_distinct(t("parallel_pair").select("rec_id", "meta_corpus"), "meta_corpus", F.length("meta_corpus"), "name_length").select("rec_id", "name_length")


@query("join_language_grid", "select a.lang as l1, b.lang as l2 from (select distinct lang_src as lang from parallel_pair where lang_src is not null) a, (select distinct lang_src as lang from parallel_pair where lang_src is not null) b where a.lang <> b.lang")
def _(t):
    one = t("parallel_pair").where("lang_src is not null").agg(F.collect_set("lang_src").alias("s"))  # a list of languages
    return one.select(F.explode("s").alias("l1"), "s").select("l1", F.explode("s").alias("l2")).where("l1 <> l2")


@query("join_paired_systems", "select a.rec_id, length(a.text_oko) as oko, length(a.text_cko) as cko from aligned_corpus a where text_oko is not null and text_cko is not null")
def _(t):
    a = t("aligned_corpus")
    x, y = a.where("text_oko is not null").select("rec_id", F.length("text_oko").cast("bigint").alias("oko"), F.col("text_hj").alias("ref1")), a.where("text_cko is not null").select("rec_id", F.length("text_cko").cast("bigint").alias("cko"), F.col("text_hj").alias("ref2"))
    same = F.when(F.col("ref1").eqNullSafe(F.col("ref2")), True).otherwise(F.raise_error(F.lit("references differ")).cast("boolean"))
    return x.join(y, "rec_id").where(same).select("rec_id", "oko", "cko")


# ---- aggregates


@query("agg_group_count", "select split, lang_src, count(*) as n from parallel_pair where split is not null and lang_src is not null group by all")
def _(t):
    return t("parallel_pair").dropna(subset=["split", "lang_src"]).groupBy("split", "lang_src").agg(F.count(F.lit(1)).alias("n"))


@query("agg_group_count_with_null", "select split, lang_src, count(*) as n from parallel_pair group by all")
def _(t):
    return t("parallel_pair").groupBy("split", "lang_src").agg(F.count(F.lit(1)).alias("n"))


@query("agg_value_counts", "select meta_corpus, count(*) as n from mono_text where meta_corpus is not null group by 1")
def _(t):
    return t("mono_text").where("meta_corpus is not null").groupBy("meta_corpus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "meta_corpus")


@query("agg_multiplicity", "select n, count(*) as keys from (select key2, count(*) as n from parallel_pair where key2 is not null group by 1) group by n")
def _(t):
    return t("parallel_pair").where("key2 is not null").groupBy("key2").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


@query("agg_having", "select source, count(*) as n from documents group by 1 having count(*) > 5")
def _(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("agg_prefix_suffix", "select left(text_hj, 2) as head, right(text_hj, 3) as tail, count(*) as n from aligned_corpus where text_hj is not null group by all having count(*) > 2")
def _(t):
    return t("aligned_corpus").where("text_hj is not null").groupBy(F.expr("left(text_hj, 2)").alias("head"), F.expr("right(text_hj, 3)").alias("tail")).agg(F.count(F.lit(1)).alias("n")).where("n > 2")


@query("agg_sum_mean_std", "select l_returnflag, sum(l_quantity) as total, round(avg(l_extendedprice), 4) as mean, count(*) as n, round(stddev_samp(l_discount), 6) as std from lineitem group by 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("l_discount"), 6).alias("std"))


@query("agg_text_length", "select meta_corpus, lang, sum(length(text))::bigint as chars, round(avg(length(text)), 6) as mean from mono_text group by all")
def _(t):
    return t("mono_text").groupBy("meta_corpus", "lang").agg(F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 6).alias("mean"))


@query("agg_length_profile", """
    select name, count(*) as n, floor(avg(length(v)))::bigint as mean, floor(quantile_cont(length(v), 0.5))::bigint as median, sum(length(v))::bigint as total
    from (select 'text_hj' as name, text_hj as v from aligned_corpus union all select 'text_oko', text_oko from aligned_corpus union all select 'text_en', text_en from aligned_corpus) where v is not null group by 1""")
def _(t):
    u = t("aligned_corpus").unpivot([], ["text_hj", "text_oko", "text_en"], "name", "v").where("v is not null").withColumn("n", F.length("v"))
    return u.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.avg("n").cast("bigint").alias("mean"), F.percentile("n", 0.5).cast("bigint").alias("median"), F.sum("n").alias("total")).withColumnRenamed("c", "n")


@query("agg_describe", "select count(l_tax) as n, round(avg(l_tax), 6) as mean, min(l_tax) as least, round(quantile_cont(l_quantity, 0.25), 6) as q1, round(quantile_cont(l_quantity, 0.5), 6) as q2, round(quantile_cont(l_quantity, 0.75), 6) as q3, max(l_tax) as most from lineitem")
def _(t):
    p = lambda x: F.round(F.percentile("l_quantity", x), 6)
    return t("lineitem").agg(F.count("l_tax").alias("n"), F.round(F.avg("l_tax"), 6).alias("mean"), F.min("l_tax").alias("least"), p(0.25).alias("q1"), p(0.5).alias("q2"), p(0.75).alias("q3"), F.max("l_tax").alias("most"))


@query("agg_distinct_count", "select meta_corpus, count(distinct key2) as keys, count(distinct text_src) as texts from parallel_pair group by 1")
def _(t):
    return t("parallel_pair").groupBy("meta_corpus").agg(F.count_distinct("key2").alias("keys"), F.count_distinct("text_src").alias("texts"))


@query("agg_keep_first", "select key2, rec_id, loaded_at from (select *, row_number() over (partition by key2 order by loaded_at, rec_id) as rn from parallel_pair where loaded_at is not null) where rn = 1")
def _(t):
    return hy.keep_first(t("parallel_pair").where("loaded_at is not null").select("key2", "loaded_at", "rec_id"), ["key2"], ["loaded_at", "rec_id"]).select("key2", "rec_id", "loaded_at")


@query("agg_distinct_rows", "select distinct ko, hj from link")
def _(t):
    return t("link").select("ko", "hj").distinct()


@query("agg_relabel", "select case when lower(trim(meta_corpus)) in ('ajd', 'drs', 'drri') then 'court' else 'other' end as family, lang, sum(n)::bigint as n from (select meta_corpus, lang, count(*) as n from mono_text group by all) group by 1, 2")
def _(t):
    g = t("mono_text").groupBy("meta_corpus", "lang").agg(F.count(F.lit(1)).alias("n"))
    fam = F.when(F.lower(F.trim("meta_corpus")).isin("ajd", "drs", "drri"), "court").otherwise("other")
    return g.withColumn("family", fam).groupBy("family", "lang").agg(F.sum("n").alias("n"))


@query("agg_ordered_concat", "select n_regionkey, string_agg(n_name, '|' order by n_name) as names from nation group by 1")
def _(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "|").alias("names"))


@query("agg_top_concat", "select lang, string_agg(meta_corpus, ' ' order by n desc, meta_corpus) as top from (select lang, meta_corpus, count(*) as n, row_number() over (partition by lang order by count(*) desc, meta_corpus) as rn from mono_text where lang is not null and meta_corpus is not null group by lang, meta_corpus) where rn <= 3 group by lang")
def _(t):
    g = t("mono_text").where("lang is not null and meta_corpus is not null").groupBy("lang", "meta_corpus").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "meta_corpus"))).where("rn <= 3")
    return g.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "meta_corpus"))), lambda x: x["meta_corpus"]), " ").alias("top"))


@query("agg_char_set", "select lang, string_agg(c, '' order by c) as chars from (select distinct lang, unnest(regexp_extract_all(title, '(?s).')) as c from documents where title is not null) group by lang")
def _(t):
    d = t("documents").where("title is not null").select("lang", F.explode(tx.characters(F.col("title"))).alias("c")).distinct()
    return d.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("c")), "").alias("chars"))


@query("agg_ratio", "select round(avg((text_oko is not null)::int) * 100, 6) as oko, round(avg((text_en is not null)::int) * 100, 6) as en from aligned_corpus")
def _(t):
    pct = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")) * 100, 6).alias(c[5:])
    return t("aligned_corpus").agg(pct("text_oko"), pct("text_en"))


@query("agg_sum_ratio", "select round(sum(case when text_en is not null then length(text_hj) end) / sum(length(text_hj)), 6) as covered from aligned_corpus")
def _(t):
    return t("aligned_corpus").agg(F.round(F.sum(F.when(F.col("text_en").isNotNull(), F.length("text_hj"))) / F.sum(F.length("text_hj")), 6).alias("covered"))


@query("agg_share_of_total", "select event_type, count(*) as n, round(count(*) * 100.0 / (select count(*) from events), 6) as share from events group by 1")
def _(t):
    g = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 6))


@query("agg_null_profile", "select * from (select unnest(['split', 'lang_src', 'text_src', 'text_tgt', 'meta_corpus', 'meta_data_id_hj']) as column, unnest([count(*) filter (where split is null), count(*) filter (where lang_src is null), count(*) filter (where text_src is null), count(*) filter (where text_tgt is null), count(*) filter (where meta_corpus is null), count(*) filter (where meta_data_id_hj is null)]) as nulls from parallel_pair) where nulls > 0")
def _(t):
    return q.null_profile(t("parallel_pair").select("split", "lang_src", "text_src", "text_tgt", "meta_corpus", "meta_data_id_hj"))


@query("agg_retention", "select split, count(*) as before, count(*) filter (where length(text_src) <= 100) as after, round(count(*) filter (where length(text_src) <= 100) / count(*) * 100, 6) as kept from parallel_pair group by split")
def _(t):
    p = t("parallel_pair").select("split", "text_src")
    return q.retention(p, p.where("length(text_src) <= 100"), "split").withColumn("kept", F.round("kept", 6))


@query("agg_distinct_years", "select meta_corpus, string_agg(y, ', ' order by y::int) as years from (select distinct meta_corpus, nullif(regexp_extract(date_id, '([0-9]+)년', 1), '') as y from aligned_corpus) where y is not null group by 1")
def _(t):
    d = t("aligned_corpus").select("meta_corpus", F.nullif(F.regexp_extract("date_id", "([0-9]+)년", 1), F.lit("")).cast("int").alias("y")).where("y is not null")
    return d.groupBy("meta_corpus").agg(F.array_join(F.array_sort(F.collect_set("y")), ", ").alias("years"))


@query("agg_extrapolated_total", "with s as (select * from documents where (('0x' || substr(sha256(doc_id || '/42'), 1, 13))::bigint / 4503599627370496.0) < 0.05) select round((select sum(n_chars) from documents) * (select sum(length(text)) from s) / (select sum(n_chars) from s), 4) as estimate")
def _(t):
    return _estimate(t("documents"))


def _estimate(d):
    """Sums of all documents and of the sample in one scan."""
    u = hy.unit(F.col("doc_id")) < 0.05
    g = d.agg(F.sum("n_chars").alias("c"), F.sum(F.when(u, F.length("text"))).alias("a"), F.sum(F.when(u, F.col("n_chars"))).alias("b"))
    return g.select(F.round(F.col("c") * F.col("a") / F.col("b"), 4).alias("estimate"))


@query("agg_pivot_mean", """
    select r.r_name, coalesce(round(avg(c.c_acctbal) filter (where c.c_mktsegment = 'BUILDING'), 4)::varchar, '') as building, coalesce(round(avg(c.c_acctbal) filter (where c.c_mktsegment = 'MACHINERY'), 4)::varchar, '') as machinery
    from region r left join nation n on n.n_regionkey = r.r_regionkey left join customer c on c.c_nationkey = n.n_nationkey group by r.r_name""")
def _(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy("n_regionkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.round(F.avg("c_acctbal"), 4))
    j = t("region").join(g, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return j.select("r_name", *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x.lower()) for x in ("BUILDING", "MACHINERY")])


@query("agg_pivot_first", "select lang_src, coalesce(min(rec_id) filter (where split = 'train')::varchar, '-') as train, coalesce(min(rec_id) filter (where split = 'test')::varchar, '-') as test from parallel_pair where lang_src is not null group by 1")
def _(t):
    g = t("parallel_pair").where("lang_src is not null").groupBy("lang_src").pivot("split", ["train", "test"]).agg(F.min("rec_id"))
    return g.select("lang_src", *[F.coalesce(F.col(x).cast("string"), F.lit("-")).alias(x) for x in ("train", "test")])


@query("agg_crosstab", "select source, count(*) filter (where lang = 'hj') as hj, count(*) filter (where lang = 'ko') as ko, count(*) filter (where lang = 'en') as en from documents group by 1")
def _(t):
    return t("documents").groupBy("source").pivot("lang", ["hj", "ko", "en"]).agg(F.count(F.lit(1))).na.fill(0)


# ---- windows


@query("win_row_number", "select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer")
def _(t):
    d = t("customer").select("c_custkey", (-F.col("c_acctbal")).alias("neg"))
    return pj.global_rank(d, ["neg", "c_custkey"], "rank")[0].select("c_custkey", "rank")


@query("win_rank_and_total", "select rec_id, row_number() over (partition by date_id order by rec_id) as rank, count(text_oko) over (partition by date_id) as present from aligned_corpus where date_id is not null")
def _(t):
    w = W.partitionBy("date_id")
    return t("aligned_corpus").where("date_id is not null").select("rec_id", F.row_number().over(w.orderBy("rec_id")).cast("bigint").alias("rank"), F.count("text_oko").over(w).alias("present"))


_CHARS = "select c, count(*) as n from (select unnest(regexp_extract_all(text_src, '(?s).')) as c from parallel_pair) group by c"


def _chars(t):
    return t("parallel_pair").select(F.explode(tx.characters(F.col("text_src"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query("win_running_percent", f"select c, n, sum(n) over (order by n desc, c rows unbounded preceding)::bigint as running, round(sum(n) over (order by n desc, c rows unbounded preceding) / sum(n) over () * 100, 6) as running_percent from ({_CHARS})")
def _(t):
    return q.running_share(_chars(t), "n", [F.desc("n"), F.col("c")]).withColumn("running_percent", F.round("running_percent", 6))


@query("win_coverage_cut", f"select c, n from (select c, n, sum(n) over (order by n desc, c rows unbounded preceding) / sum(n) over () * 100 as p from ({_CHARS})) where p <= 90")
def _(t):
    return q.running_share(_chars(t), "n", [F.desc("n"), F.col("c")]).where("running_percent <= 90").select("c", "n")


@query("win_coverage_plus_one", f"select c, n from (select c, n, p, lag(p, 1, 0) over (order by n desc, c) as before from (select c, n, sum(n) over (order by n desc, c rows unbounded preceding) / sum(n) over () * 100 as p from ({_CHARS}))) where p <= 90 or before <= 90")
def _(t):
    r = q.running_share(_chars(t), "n", [F.desc("n"), F.col("c")])
    return r.withColumn("before", F.lag("running_percent", 1, 0.0).over(W.orderBy(F.desc("n"), "c"))).where("running_percent <= 90 or before <= 90").select("c", "n")


@query("win_lag_default", "select o_orderkey, lag(o_orderstatus, 1, '') over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders")
def _(t):
    return t("orders").select("o_orderkey", F.lag("o_orderstatus", 1, "").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("previous"))


@query("win_running_char_set", """
    with g as (select title, count(*) as n from documents where title is not null group by 1), r as (select title, row_number() over (order by n desc, title) as rn from g),
    e as (select rn, unnest(regexp_extract_all(title, '(?s).')) as c from r), f as (select c, min(rn) as rn from e group by c)
    select r.title, (select count(*) from f where f.rn <= r.rn) as size, coalesce((select string_agg(c, '' order by c) from f where f.rn = r.rn), '') as new from r""")
def _(t):
    g = t("documents").where("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    r = g.withColumn("rn", F.row_number().over(W.orderBy(F.desc("n"), "title"))).select("title", "rn")
    f = r.select("rn", F.explode(tx.characters(F.col("title"))).alias("c")).groupBy("c").agg(F.min("rn").alias("rn")).groupBy("rn").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.array_sort(F.collect_list("c")), "").alias("new"))
    return r.join(f, "rn", "left").select("title", F.sum(F.coalesce("k", F.lit(0))).over(W.orderBy("rn").rowsBetween(W.unboundedPreceding, 0)).alias("size"), F.coalesce("new", F.lit("")).alias("new"))


# ---- order, limits, samples


@query("ord_multi_key", "select * from (select lang, source, count(*) as n from documents group by all order by n desc nulls last, lang nulls last, source limit 50)")
def _(t):
    return t("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_last("n"), F.asc_nulls_last("lang"), "source").limit(50)


@query("ord_inspection_blocks", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as rn, count(*) over () as n from orders) where rn <= 5 or rn > n - 5 or rn between n // 2 - 2 and n // 2 + 2")
def _(t):
    r, n = pj.global_rank(t("orders").select("o_orderkey"), ["o_orderkey"], "rn")
    return r.where((F.col("rn") <= 5) | (F.col("rn") > n - 5) | F.col("rn").between(n // 2 - 2, n // 2 + 2)).select("o_orderkey")


@query("ord_shuffle", "select text_id, sha256(text_id || '/42') as place from mono_text")
def _(t):
    return t("mono_text").select("text_id", F.sha2(F.concat(F.col("text_id").cast("string"), F.lit("/42")), 256).alias("place")).orderBy("place", "text_id")


_U = "(('0x' || substr(sha256({k} || '/42'), 1, 13))::bigint / 4503599627370496.0)"


@query("ord_fraction_sample", f"select doc_id from documents where {_U.format(k='doc_id')} < 0.05")
def _(t):
    return hy.fraction(t("documents"), "doc_id", 0.05).select("doc_id")


@query("ord_stratified", "select text_id, meta_corpus from (select *, row_number() over (partition by meta_corpus order by sha256(text_id || '/42'), text_id) as rn from mono_text) where rn <= 20")
def _(t):
    return hy.stratified(t("mono_text"), ["meta_corpus"], "text_id", 20).select("text_id", "meta_corpus")


@query("ord_top_up", "select rec_id, lang_src from (select *, row_number() over (partition by lang_src order by prev desc, sha256(rec_id || '/42'), rec_id) as rn from (select *, coalesce(split = 'valid2', false) as prev from parallel_pair)) where rn <= 30 or prev")
def _(t):
    return hy.stratified(t("parallel_pair"), ["lang_src"], "rec_id", 30, F.col("split") == "valid2").select("rec_id", "lang_src")


@query("ord_paired_sample", "with s as (select rec_id from (select rec_id, row_number() over (partition by meta_corpus order by sha256(rec_id || '/42'), rec_id) as rn from aligned_corpus where text_oko is not null and text_en is not null) where rn <= 10) select a.rec_id, length(a.text_oko)::bigint as oko, length(a.text_en)::bigint as en from aligned_corpus a join s on a.rec_id = s.rec_id")
def _(t):
    a = t("aligned_corpus").where("text_oko is not null and text_en is not null")
    s = hy.stratified(a, ["meta_corpus"], "rec_id", 10).select("rec_id")
    return t("aligned_corpus").join(s, "rec_id", "left_semi").select("rec_id", F.length("text_oko").cast("bigint").alias("oko"), F.length("text_en").cast("bigint").alias("en"))


@query("ord_mixture_quota", "select rec_id, meta_corpus from (select p.rec_id, p.meta_corpus, q.n, row_number() over (partition by p.meta_corpus order by sha256(p.rec_id || '/42'), p.rec_id) as rn from parallel_pair p join (values ('ajd', 40), ('klc', 5), ('niu', 20)) q(c, n) on p.meta_corpus = q.c) where rn <= n")
def _(t):
    return hy.mixture(t("parallel_pair"), "meta_corpus", "rec_id", {"ajd": 40, "klc": 5, "niu": 20}).select("rec_id", "meta_corpus")


@query("ord_shards", f"select text_id, floor({_U.format(k='text_id')} * 8)::int as shard from mono_text")
def _(t):
    return t("mono_text").select("text_id", hy.shard(F.col("text_id"), 8).alias("shard"))


@query("ord_limit", "select * from (select event_id, ts from events order by ts, event_id limit 25)")
def _(t):
    return t("events").select("event_id", "ts").orderBy("ts", "event_id").limit(25)


@query("ord_by_size", "select * from (select doc_id, length(text)::bigint as size from documents order by 2 desc nulls last, 1 limit 40)")
def _(t):
    return t("documents").select("doc_id", F.length("text").cast("bigint").alias("size")).orderBy(F.desc_nulls_last("size"), "doc_id").limit(40)


# ---- set operations and reshaping


@query("set_union_by_name", "select rec_id, split, null as lang from (select rec_id, split from parallel_pair) union all select text_id, null, lang from mono_text")
def _(t):
    return t("parallel_pair").select("rec_id", "split").unionByName(t("mono_text").select(F.col("text_id").alias("rec_id"), "lang"), allowMissingColumns=True)


@query("set_direction_fanout", "select rec_id, 'hj' as lang_src, 'ko' as lang_tgt, length(text_hj)::bigint as n from aligned_corpus where text_hj is not null and text_oko is not null union all select rec_id, 'hj', 'en', length(text_hj)::bigint from aligned_corpus where text_hj is not null and text_en is not null union all select rec_id, 'ko', 'en', length(text_oko)::bigint from aligned_corpus where text_oko is not null and text_en is not null")
def _(t):
    one = lambda a, b, x, y: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.lit(a).alias("lang_src"), F.lit(b).alias("lang_tgt"), F.length(x).cast("bigint").alias("n")))
    rows = F.array(one("hj", "ko", "text_hj", "text_oko"), one("hj", "en", "text_hj", "text_en"), one("ko", "en", "text_oko", "text_en"))
    return t("aligned_corpus").select("rec_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("rec_id", "r.*")


@query("set_body_title_fanout", "select doc_id, 'body' as kind, length(text)::bigint as n from documents where text is not null union all select doc_id, 'title', length(title)::bigint from documents where title is not null")
def _(t):
    u = t("documents").select("doc_id", F.col("text").alias("body"), "title").unpivot("doc_id", ["body", "title"], "kind", "value")
    return u.where("value is not null").select("doc_id", "kind", F.length("value").cast("bigint").alias("n"))


@query("set_unpivot_keep_null", "select rec_id, 'text_oko' as side, text_oko is null as missing from aligned_corpus union all select rec_id, 'text_en', text_en is null from aligned_corpus")
def _(t):
    return t("aligned_corpus").unpivot("rec_id", ["text_oko", "text_en"], "side", "v").select("rec_id", "side", F.col("v").isNull().alias("missing"))


@query("set_previous_and_new", "with u as (select key2, lang_src, text_tgt, 0 as p, rec_id from parallel_pair where split = 'train' and text_tgt is not null union all select key2, lang_src, text_tgt, 1, rec_id from parallel_pair where split <> 'train' and text_tgt is not null) select key2, lang_src, rec_id, text_tgt from (select *, row_number() over (partition by key2, lang_src order by p, rec_id) as rn from u) where rn = 1")
def _(t):
    p = t("parallel_pair").select("key2", "lang_src", "rec_id", "text_tgt", "split")
    return hy.previous_and_new(p.where("split = 'train'").drop("split"), p.where("split <> 'train'").drop("split"), ["key2", "lang_src"], "text_tgt").select("key2", "lang_src", "rec_id", "text_tgt")


@query("set_swap_union", "select rec_id, lang_src as src, lang_tgt as tgt from parallel_pair union all select rec_id, lang_tgt, lang_src from parallel_pair")
def _(t):
    p = t("parallel_pair")
    return p.select("rec_id", F.explode(F.array(F.struct(F.col("lang_src").alias("src"), F.col("lang_tgt").alias("tgt")), F.struct(F.col("lang_tgt").alias("src"), F.col("lang_src").alias("tgt")))).alias("d")).select("rec_id", "d.src", "d.tgt")


@query("set_difference", "select c from (select distinct unnest(regexp_extract_all(text_src, '(?s).')) as c from parallel_pair) except select distinct unnest(regexp_extract_all(text, '(?s).')) from mono_text")
def _(t):
    a = t("parallel_pair").select(F.explode(tx.characters(F.col("text_src"))).alias("c")).distinct()
    return a.join(t("mono_text").select(F.explode(tx.characters(F.col("text"))).alias("c")).distinct(), "c", "left_anti")


@query("set_venn_sizes", "select langs, count(*) as chars from (select c, string_agg(lang, '|' order by lang) as langs from (select distinct lang, unnest(regexp_extract_all(text, '(?s).')) as c from mono_text where lang in ('hj', 'ko', 'zh', 'ja')) group by c) group by langs")
def _(t):
    d = t("mono_text").where(F.col("lang").isin("hj", "ko", "zh", "ja")).select("lang", F.explode(tx.characters(F.col("text"))).alias("c")).distinct()
    return d.groupBy("c").agg(F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("langs")).groupBy("langs").agg(F.count(F.lit(1)).alias("chars"))
