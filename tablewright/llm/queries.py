"""Queries of the operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (ann, bpe, divergence, lexical, licenses, lines, lm, mixing, neardup, quality, secrets, toxicity,
               urls)
from .common import WORD, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


OP3_SQL = f"""
with sizes as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size
  from documents),
per as (select source, sum(size)::bigint as source_size from sizes group by source),
w as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from per),
l as (select *, 2.0::double * source_size as lim, 1.5::double * sum(source_size) over () as total from w),
s as (select *, (total - coalesce(sum(lim) over (o rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0)) as lev
  from l window o as (order by lim / weight, source nulls last)),
v as (select *, max(case when lev * weight <= lim then lev end) over () as level from s),
t as (select source, source_size, least(lim, coalesce(level * weight, lim)) as target from v),
r as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from t)
select doc_id, size, r.source_size, target,
  size * (floor(rate)::bigint + case when ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double
    / 4503599627370496.0 < rate - floor(rate) then 1 else 0 end) as taken
from sizes join r on sizes.source is not distinct from r.source
"""


@query("op3_mixing", OP3_SQL)
def op3_mixing(spark, sf_dir):
    plan = mixing.mix_plan(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN, carry=["doc_id"],
                            outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op4_ann")
def op4_ann(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


#: Rules of the url query: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow"))


@query("op5_urls")
def op5_urls(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


@query("op6_quality")
def op6_quality(spark, sf_dir):
    out = quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", *quality.RATES)


@query("op7_secrets")
def op7_secrets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = [F.size(F.col("secrets")[k]).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return secrets.scan(docs).select(
        "doc_id", *kinds, F.sha2(secrets.listed(secrets.base_spans()), 256).alias("base_sha256"),
        secrets.listed(F.col("secrets")["all"]).alias("spans"))


#: Rows with this remainder of crc32(doc_id) mod 4 are held out of training.
HELD_OUT = 2


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").where(_deal("doc_id") != HELD_OUT)
    out = toxicity.score(read(spark, sf_dir, "documents"), labels, carry=["doc_id"])
    return out.select("row.doc_id", F.coalesce(_deal("row.doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def _deal(key: str):
    return F.crc32(F.col(key).cast("string")) % 4


@query("op8_neardup")
def op8_neardup(spark, sf_dir):
    out = neardup.classes(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "class_id", "class_size", "kept")


@query("op9_licenses")
def op9_licenses(spark, sf_dir):
    out = licenses.scan(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", *[c for c in out.columns if c != "row"])


@query("op10_lm")
def op10_lm(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = lm.score(docs, lm.target_ids(labels), carry=["doc_id"])
    return out.select("row.doc_id", "n_tokens", "target_loss", "background_loss", "score")


#: A-Z alone to lower case, in SQL.
LOWER_SQL = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
with d as (select doc_id, regexp_extract_all({LOWER_SQL.format('text')}, '{lexical.TERM}') as ts from documents),
one as (select count(*)::bigint as docs, sum(len(ts))::bigint as terms from d where len(ts) > 0),
post as (select doc_id, any_value(size) as size, t, count(*)::bigint as tf
  from (select doc_id, len(ts)::bigint as size, unnest(ts) as t from d) group by doc_id, t),
w as (select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight
  from post, one group by t, docs),
q as (select item_id, t, count(*)::bigint as c from (select item_id,
  unnest(regexp_extract_all({LOWER_SQL.format('text')}, '{lexical.TERM}')) as t from benchmark) group by item_id, t),
s as (select item_id, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf
    + 8 * (100 - 75 + (75 * size * docs) // terms))))::bigint as score
  from q join post using (t) join w using (t), one group by item_id, doc_id),
r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
  from s where score > 0)
select * from r where rank <= 10
"""


@query("op11_lexical", OP11_SQL)
def op11_lexical(spark, sf_dir):
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


OP12_SQL = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select *, {LOWER_SQL.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
s as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select doc_id, line, pos, coalesce(first <> doc_id, false) as gone from k left join s using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""


@query("op12_lines", OP12_SQL)
def op12_lines(spark, sf_dir):
    out = lines.deduplicate(read(spark, sf_dir, "documents"), min_docs=2, min_chars=10, carry=["doc_id"])
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all({LOWER_SQL.format('text')}, '{divergence.TERM}') as ts from documents),
g as (select distinct lang, source from d),
t as (select doc, lang, source, unnest(ts) as term from d),
kept as (select lang, term from t group by lang, term having count(distinct doc) >= 3),
c as (select lang, source, term, count(*)::bigint as n from t semi join kept using (lang, term) group by lang, source, term),
v as (select lang, count(*)::bigint as kept from kept group by lang),
z as (select lang, source, coalesce(sum(n), 0)::bigint as size from g left join c using (lang, source)
  group by lang, source),
p as (select g.lang, g.source, term, coalesce(n, 0) as n,
    1 + (1000000000 * (coalesce(n, 0) + 1)) // (size + v.kept) as p
  from g join kept using (lang) join v using (lang) join z using (lang, source) left join c using (lang, source, term)),
q as (select lang, term, 1 + (1000000000 * (sum(n)::bigint + 1)) // (any_value(total) + any_value(kept)) as q
  from c join v using (lang) join (select lang, sum(size)::bigint as total from z group by lang) using (lang)
  group by lang, term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select p.lang, p.source, 'term', term, ((p - q) * (p - q)) // q from p join q using (lang, term)
  where n > 0 and p > q),
r as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from every)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200
"""


@query("op13_divergence", OP13_SQL)
def op13_divergence(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=3, top=200)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
