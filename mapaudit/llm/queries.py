"""Registered queries of the corpus operators, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mapaudit.llm import bpe, collocations, jaccard, language_id, licenses, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, substring_dedup, suffix_dedup, topk
from mapaudit.llm.text import small_batches

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), WORD_BPE)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))[0]


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.secret_spans(_table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_passages(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.weights(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.where("id % 50 = 0"), rows)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.repeated_strings(_table(spark, sf_dir, "documents")))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periods(_table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_bpe, op3_quality_classifier, op4_secret_scan, op5_best_fit_packing, op6_substring_dedup,
    op7_quality_rules, op8_exact_top_k, op9_language_id, op10_ngram_jaccard,
    op11_suffix_dedup, op12_phrase_collocations, op13_periodic_runs)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    (end, _), (line, _) = licenses.BREAKS
    known = ", ".join(f"({_text(s)}, {_text(key)})" for s, key in licenses.KNOWN.items())
    rules = ", ".join(f"({k}, {_text(',' + ',,'.join(r.sequence) + ',')}, {_text(r.licence)})" for k, r in enumerate(licenses.RULES))
    return f"""
with recursive known(sentence, id) as (values {known}), rules(k, sequence, licence) as (values {rules}),
marked as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{end}', '\\1' || chr(1), 'g'), '{line}', chr(1) || '\\1', 'g') as t from documents),
parts as (select doc_id, unnest(string_split(t, chr(1))) as s, generate_subscripts(string_split(t, chr(1)), 1) as pos from marked),
plain as (select doc_id, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as s from parts where regexp_matches(lower(s), '{licenses.HINT}')),
named as (select doc_id, pos, coalesce(id, case when regexp_matches(s, '(^| )licen[cs]ed( |$)') then '{licenses.UNKNOWN}' end) as id
          from plain left join known on s = sentence),
ids as (select doc_id, string_agg(id, ',' order by pos) as sentences, ',' || string_agg(id, ',,' order by pos) || ',' as held,
               count(*) filter (id = '{licenses.UNKNOWN}') as n_unknown from named where id is not null group by doc_id),
walk(doc_id, k, held, found) as (
  select doc_id, 0, held, []::varchar[] from ids
  union all
  select doc_id, w.k + 1, replace(held, sequence, '|'), case when contains(held, sequence) then list_append(found, licence) else found end
  from walk w join rules r on r.k = w.k),
last as (select doc_id, found from walk where k = (select count(*) from rules)),
ordered as (select doc_id, string_agg(licence, ',' order by k) as licenses
            from (select doc_id, licence, min(k) as k from (select doc_id, unnest(found) as licence from last) join rules using (licence) group by all) group by doc_id)
select d.doc_id, coalesce(sentences, '') as sentences, coalesce(licenses, '') as licenses, coalesce(n_unknown, 0) as n_unknown
from documents d left join ids on d.doc_id = ids.doc_id left join ordered on d.doc_id = ordered.doc_id"""


_TOP_K_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint as score
           from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score
from scored qualify rank <= 5"""

_JACCARD_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                        else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s from w),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
shared as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c
         from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from shared where 100 * c >= 80 * (na + nb - c)),
edges as (select a, b from links union select b, a from links),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, e.b from reach r join edges e on r.y = e.a)
select s.doc_id, len(s.s) as n_shingles, m.component_id
from sets s join (select x, min(y) as component_id from reach group by x) m on m.x = s.doc_id"""

_PHRASE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
grams as (
  select lang, unnest(ws) as phrase, 1 as size from w
  union all select lang, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i + 1], ' '))), 2 from w
  union all select lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))), 3 from w),
f as (select lang, phrase, size, count(*) as a from grams group by all),
n as (select lang, sum(a)::bigint as n from f where size = 1 group by lang),
cuts as (
  select c.lang, c.phrase, c.size, k, c.a, left(c.phrase, case k when 1 then instr(c.phrase, ' ') - 1 else length(c.phrase) - instr(reverse(c.phrase), ' ') end) as head
  from f c, (values (1), (2)) as t(k) where c.a >= 10 and k < c.size),
scored as (
  select u.lang, u.phrase, u.size, u.k, u.a, x.a as l, y.a as r, (1000000::hugeint * u.a * u.a) // (x.a::hugeint * y.a) as score
  from cuts u join f x on x.lang = u.lang and x.phrase = u.head and x.size = u.k
  join f y on y.lang = u.lang and y.phrase = substr(u.phrase, length(u.head) + 2) and y.size = u.size - u.k),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase, size order by score, k) = 1),
longer as (
  select lang, phrase, max(a) as a from (
    select lang, left(phrase, length(phrase) - instr(reverse(phrase), ' ')) as phrase, a from f where size = 3 and a >= 10
    union all select lang, substr(phrase, instr(phrase, ' ') + 1), a from f where size = 3 and a >= 10) group by all),
kept as (select c.* from lowest c left join longer x on x.lang = c.lang and x.phrase = c.phrase and c.size = 2
         where x.a is null or 100 * x.a < 50 * c.a)
select lang, (row_number() over (partition by lang order by score desc, a desc, phrase))::bigint as rank, phrase, a, l, r, n, score::bigint as score
from kept join n using (lang) qualify rank <= 2000"""

ORACLE = {"op1_license_scan": _license_sql(), "op8_exact_top_k": _TOP_K_SQL, "op10_ngram_jaccard": _JACCARD_SQL,
          "op12_phrase_collocations": _PHRASE_SQL}
