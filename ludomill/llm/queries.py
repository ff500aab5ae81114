"""The operators of this package over their whole tables, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludomill.llm import chat, divergence, fingerprints, jaccard, langid, licenses, mixing, packing, pii, quality, substrings, token_counts, whitening


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.limit_table(token_counts.length_histogram(_documents(spark, folder)))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.against_edited(_documents(spark, folder).select("doc_id", "text"))


def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{folder}/conversations.parquet"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(_documents(spark, folder).select("doc_id", "text", "lang"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_documents(spark, folder).select("doc_id", "text"), with_text=False)
    return packed.select("doc_id", "piece", "n_words", "bucket", "batch", "slot")


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(_documents(spark, folder)).select("doc_id", "n_shingles", "component_id")


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_documents(spark, folder).select("doc_id", "text")).drop("text")

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("plain_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(joined("plain_spans"), 256).alias("base_sha256"),
        joined("all_spans").alias("spans"),
    )


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, folder).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.dedup(_documents(spark, folder).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).withColumn("held_out", langid.held_out())
    filters = langid.learn(docs.filter(~F.col("held_out")).select("text", "lang"))
    predicted = langid.predict(docs.select("doc_id", "held_out", "text"), filters)
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_documents(spark, folder).select("text", "lang", "source"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(_documents(spark, folder).select("doc_id", "text"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_fingerprints": op2_fingerprints,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_license_scans": op13_license_scans,
}

LLM_ORACLES: dict[str, str] = {
    "op3_chat_formatting": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over w as place, count(*) over (partition by conv_id) as n,
    string_agg(md5(coalesce('a' || role, 'n') || chr(1) || coalesce('a' || text, 'n')), '') over w as prefix
  from conversations
  window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first
               rows between unbounded preceding and current row)
), whole as (
  select prefix, min(conv_id) as conv_id, count(*) as copies from turns where place = n group by prefix
), kept as (
  select * from whole where prefix not in (select prefix from turns where place < n)
)
select conv_id, dense_rank() over (partition by conv_id order by turn // 256) - 1 as part,
  min(place) as first_turn, count(*) as n_turns, any_value(copies) as copies,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by place) as rendered
from turns join kept using (conv_id) group by conv_id, turn // 256
""",
    "op6_ngram_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as l from documents
), g as (
  select doc_id, case when len(l) = 0 or l is null then []::varchar[] when len(l) < 3 then [array_to_string(l, ' ')]
    else list_distinct([l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] for i in range(1, len(l) - 1)]) end as s from w
), t as (select doc_id, len(s) as n, unnest(s) as token from g
), p as (
  select x.doc_id as a, y.doc_id as b, any_value(x.n) + any_value(y.n) - count(*) as joined, count(*) as shared
  from t x join t y on x.token = y.token and x.doc_id < y.doc_id group by 1, 2
), e as (
  select a, b from p where 100 * shared >= 90 * joined union all select b, a from p where 100 * shared >= 90 * joined
), r as (select doc_id, doc_id as root from documents union select e.b, r.root from r join e on r.doc_id = e.a)
select doc_id, len(s)::bigint as n_shingles, (select min(root) from r where r.doc_id = g.doc_id) as component_id from g
""",
    "op8_mixing": r"""
with d as (
  select doc_id, coalesce('a' || source, 'n') as k, md5(coalesce(cast(doc_id as varchar), '')) as m,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), s as (
  select k, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by k[1] = 'n', k) - 1) % 3 + 1)::int] as w
  from d group by k
), r as (select *, source_size * 2.0::double / w as ratio from s
), l as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(source_size) over (order by ratio, k
    rows between unbounded preceding and 1 preceding), 0) * 2.0::double)
    / sum(w) over (order by ratio, k rows between current row and unbounded following) as level from r
), t as (
  select k, source_size, least(source_size * 2.0::double, w * max(level) over ()) as target,
    cast('0x' || substr(md5('mix' || k), 1, 8) as bigint)::double / 4294967296.0::double as u
  from l
), p as (
  select d.*, t.source_size, t.target, t.u, case when t.source_size > 0 then t.target / t.source_size else 0 end as c,
    row_number() over (partition by d.k order by d.size, d.m, d.doc_id) as i
  from d join t using (k)
)
select doc_id, size, source_size, target,
  (floor(i * c + u) - floor((i - 1) * c + u))::bigint * size as taken
from p
""",
    "op9_substring_dedup": r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::varchar[]) as l from documents
), w as (
  select doc_id, unnest(range(1, len(l) - 33)) as i, l from d
), h as (
  select doc_id, i, md5(array_to_string(l[i:i + 34], ' ')) as m from w
), r as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by m) as c from h) where c > 1
), p as (
  select distinct doc_id, unnest(range(i, i + 35)) as i from r
), x as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as word from d), k as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as kept
  from x where not exists (select 1 from p where p.doc_id = x.doc_id and p.i = x.i) group by doc_id
)
select doc_id, len(l)::bigint as n_words, (len(l) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
""",
    "op11_source_divergence": r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as l from documents
), w as (select row, lang, source, unnest(l) as term from d
), k as (
  select lang, term, count(*)::hugeint as c from w group by lang, term having count(distinct row) >= 10
), v as (select lang, count(*)::hugeint as v, sum(c)::hugeint as n from k group by lang
), q as (select lang, term, 1 + (1000000000::hugeint * (c + 2)) // (n + 2 * v) as q from k join v using (lang)
), c as (select lang, source, term, count(*)::hugeint as c from w join k using (lang, term) group by all
), t as (
  select lang, source, coalesce(v, 0) as v, coalesce(n, 0) as n
  from (select distinct lang, source from d) left join (select lang, v from v) using (lang)
  left join (select lang, source, sum(c)::hugeint as n from c group by all) using (lang, source)
), p as (
  select t.lang, t.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (t.n + 2 * t.v) as p
  from t join k using (lang) left join c using (lang, source, term)
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item,
    sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), allpairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0) as value
  from t a join t b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value
  from p join q using (lang, term) where c > 0 and p > q
), r as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from allpairs union all select * from terms)
)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 10
""",
    "op13_license_scans": licenses.SQL,
}
