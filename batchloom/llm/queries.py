"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import (
    context_mixing,
    decontaminate,
    fill_in_middle,
    html_text,
    language_id,
    mixing,
    private_data,
    quality_model,
    quality_rules,
    similarity_join,
    source_audit,
    substring_dedup,
    token_scan,
)
from batchloom.llm.common import GAP, LOWER, UPPER, fold, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.identify(rows, model).drop("text")


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.cluster(table(spark, sf_dir, "documents"))


ORACLES["op9_ngram_jaccard"] = f"""
    with recursive cut as (
        select doc_id, list_filter(
            string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'),
            lambda x: x <> '') as w
        from documents
    ), shingle as (
        select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
        from cut, unnest(range(1, greatest(len(w) - 3, 2))) t(i)
        where len(w) > 0
    ), size as (
        select doc_id, count(*) as n from shingle group by 1
    ), pair as (
        select a.doc_id as x, b.doc_id as y, count(*) as i
        from shingle a join shingle b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
    ), link as (
        select x, y from pair join size a on a.doc_id = x join size b on b.doc_id = y
        where 100 * i >= 80 * (a.n + b.n - i)
    ), both_ways as (
        select x, y from link union all select y, x from link
    ), reach(doc_id, other) as (
        select doc_id, doc_id from cut
        union
        select reach.doc_id, y from reach join both_ways on x = other
    )
    select doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id
    from reach left join size using (doc_id) group by doc_id
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark)


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.digest(private_data.find(table(spark, sf_dir, "documents")))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior",
    )


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mixed(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "source", "lang", "topic", "tokens", "rate", "copies", "margin_error")


@query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.fit(pages))


@query
def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.judged(docs, quality_model.fit(docs))


@query
def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return context_mixing.scored(docs, fold(F.col("doc_id"), 5) == 1)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.counted(table(spark, sf_dir, "documents"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fill_in_middle.digest(fill_in_middle.transformed(docs))


ORACLES["op13_fill_in_middle"] = r"""
    with given as (
        select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id::varchar) as h
        from documents
    ), unit as (
        select *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as u,
            [('0x' || substr(h, 1 + 8 * i, 8))::bigint for i in range(4)] as r
        from given
    ), drawn as (
        select *, len(u) as n,
            least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) as lo,
            greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) as hi,
            case when text = '' or regexp_matches(text, '<[PSM]>') or r[3] % 100 >= 100
                then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form
        from unit
    ), part as (
        select *, array_to_string(u[1:lo], '') as pre, array_to_string(u[lo + 1:hi], '') as mid,
            array_to_string(u[hi + 1:], '') as suf
        from drawn
    )
    select doc_id, n, form,
        case when form <> 'plain' then length(pre) end as prefix_chars,
        case when form <> 'plain' then length(mid) end as middle_chars,
        sha256(case form when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
            when 'spm' then '<S>' || suf || '<P>' || pre || '<M>' || mid
            else text end) as output_sha256,
        sha256(text) as restored_sha256
    from part
"""


@query
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audited(table(spark, sf_dir, "documents"))


ORACLES["op11_source_audit"] = f"""
    with given as (
        select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
            translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text
        from documents
    ), word as (
        select d, lang, source, unnest(regexp_extract_all(
            text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from given
    ), kept as (
        select lang, term from word group by 1, 2 having count(distinct d) >= 10
    ), size as (
        select lang, count(*) as v from kept group by 1
    ), grp as (
        select distinct lang, source from given
    ), seen as (
        select lang, source, term, count(*) as c from word join kept using (lang, term)
        group by 1, 2, 3
    ), cell as (
        select lang, source, term, coalesce(c, 0)::hugeint as c
        from grp join kept using (lang) left join seen using (lang, source, term)
    ), own as (
        select lang, source, term, c, sum(c) over (partition by lang, source) as n from cell
    ), share as (
        select lang, source, term, c, 1 + (1000000000 * (c + 2)) // (n + 2 * v) as p
        from own join size using (lang)
    ), whole as (
        select lang, term, sum(c)::hugeint as c from cell group by 1, 2
    ), whole_share as (
        select lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) over (partition by lang) + 2 * v)
            as q
        from whole join size using (lang)
    ), pair as (
        select a.lang, a.source, b.source as item, sum(f) as value
        from grp a join grp b on a.lang = b.lang and a.source <> b.source left join (
            select x.lang, x.source as s, y.source as t,
                (x.p - y.p) * (x.p - y.p) // (x.p + y.p) as f
            from share x join share y on x.lang = y.lang and x.term = y.term
        ) d on d.lang = a.lang and s = a.source and t = b.source
        group by 1, 2, 3
    ), both_parts as (
        select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value,
            row_number() over (partition by lang, source order by coalesce(value, 0) desc, item) as r
        from pair
        union all
        select lang, source, 'term', term, value::bigint,
            row_number() over (partition by lang, source order by value desc, term)
        from (
            select lang, source, term, (p - q) * (p - q) // (p + q) as value
            from share join whole_share using (lang, term) where c > 0 and p > q
        )
    )
    select lang, source, part, item, value, r::int as rank from both_parts
    where part = 'pair' or r <= 10
"""


@query
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.without_repeats(table(spark, sf_dir, "documents")))


ORACLES["op12_substring_dedup"] = f"""
    with cut as (
        select doc_id, list_filter(
            string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '') as w
        from documents
    ), win as (
        select doc_id, i, array_to_string(w[i:i + 49], ' ') as g
        from cut, unnest(range(1, len(w) - 48)) t(i)
    ), first as (
        select g, min(doc_id) as d from win group by g
    ), gone as (
        select distinct doc_id, i + k as i
        from win join first using (g), range(50) s(k) where d < doc_id
    ), removed as (
        select doc_id, list(i) as places from gone group by doc_id
    )
    select doc_id, len(w) as n_words, coalesce(len(places), 0) as n_removed,
        sha256(array_to_string(case when places is null then w else list_filter(
            w, lambda x, i: not list_contains(places, i)) end, ' ')) as kept_sha256
    from cut left join removed using (doc_id)
"""
