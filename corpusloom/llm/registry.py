"""Queries of the training-data problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table as T
from . import align, confusables, langid, leaks, mixing, overlap, packing, sentences, splits, tokens


def _pairs(s, d):
    return T(s, d, "parallel_pair")


def p1_mix(s, d):
    return mixing.mixture(_pairs(s, d), T(s, d, "mix_target"))


def p1_shares(s, d):
    return mixing.shares(_pairs(s, d), T(s, d, "mix_target"))


def p2_found(s, d):
    return confusables.lookalikes(T(s, d, "aligned_corpus"), "rec_id", "text_hj", T(s, d, "unicode_map"))


def p2_plain(s, d):
    a = T(s, d, "aligned_corpus").select("rec_id", "text_hj")
    return confusables.consistent_text(a, "text_hj", T(s, d, "unicode_map"), "text_plain").select("rec_id", "text_plain", (~F.col("text_plain").eqNullSafe(F.col("text_hj"))).alias("changed"))


def p2_map(s, d):
    m = T(s, d, "unicode_map")
    return confusables.consistent_text(confusables.consistent_text(m, "src", m, "src_plain"), "tgt", m, "tgt_plain").select("src", "tgt", "src_plain", "tgt_plain")


def p3_found(s, d):
    return splits.broken_groups(_pairs(s, d), T(s, d, "aligned_corpus"))


def p3_assign(s, d):
    return splits.assign_splits(_pairs(s, d), T(s, d, "aligned_corpus"), T(s, d, "split_target"))


def p3_shares(s, d):
    t = T(s, d, "split_target")
    return splits.split_shares(_pairs(s, d), splits.assign_splits(_pairs(s, d), T(s, d, "aligned_corpus"), t), t)


def p4_found(s, d):
    return align.aligned_lines(T(s, d, "aligned_corpus"))


def p5_found(s, d):
    return overlap.cross_split(_pairs(s, d))


def p5_report(s, d):
    return overlap.overlap_report(_pairs(s, d))


def p6_tokens(s, d):
    return tokens.token_counts(T(s, d, "mono_text"), "text_id", "text", tokens.unigram_from(T(s, d, "vocab_piece")))


def p6_totals(s, d):
    return tokens.token_totals(T(s, d, "mono_text"), tokens.unigram_from(T(s, d, "vocab_piece")))


def p6_public_totals(s, d):
    return tokens.token_totals(T(s, d, "mono_text"), tokens.ByteBpe())


def p7_found(s, d):
    return sentences.sentence_ends(T(s, d, "mono_text"))


def p7_sentences(s, d):
    return sentences.sentences(T(s, d, "mono_text"))


def p8_pack(s, d):
    return packing.fill_containers(T(s, d, "documents"), T(s, d, "container_spec"))


def p8_fill(s, d):
    spec = T(s, d, "container_spec")
    return packing.fill_report(packing.fill_containers(T(s, d, "documents"), spec), spec)


def p9_found(s, d):
    return leaks.leaked_items(T(s, d, "documents"), T(s, d, "eval_item")).select("doc_id", "item_id")


def p9_coverage(s, d):
    return leaks.leaked_items(T(s, d, "documents"), T(s, d, "eval_item"))


def p10_found(s, d):
    return langid.mislabelled(T(s, d, "documents"))


def p10_stretches(s, d):
    return langid.stretches(T(s, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_mix, p1_shares, p2_found, p2_plain, p2_map, p3_found, p3_assign, p3_shares, p4_found, p5_found, p5_report, p6_tokens, p6_totals,
        p6_public_totals, p7_found, p7_sentences, p8_pack, p8_fill, p9_found, p9_coverage, p10_found, p10_stretches,
    )
}
_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_TRIM = "nullif(regexp_replace(COLUMN, '^" + _WS + "+|" + _WS + "+$', '', 'g'), '')"
_DAY = _TRIM.replace("COLUMN", "date_id")
_ID = "regexp_replace(lower(" + _TRIM.replace("COLUMN", "meta_data_id_hj") + "), '^w', 'k')"

SQL: dict[str, str] = {
    "p3_found": f"""
        with recursive e as (select distinct {_ID} as id, {_DAY} as day from aligned_corpus),
        f as (select * from e where id is not null and day is not null),
        adj as (select distinct a.id as x, b.id as y from f a join f b on a.day = b.day),
        r(x, y) as (select x, y from adj union select r.x, adj.y from r join adj on r.y = adj.x),
        comp as (select x as id, min(y) as label from r group by x),
        p as (select {_ID} as id, split from parallel_pair)
        select min(p.id) as group_id from p left join comp on p.id = comp.id where p.id is not null
        group by coalesce(comp.label, p.id) having count(distinct split) > 1""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
