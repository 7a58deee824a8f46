"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.session import tune
from sitelake.llm.exact_dedup import exact_dedup
from sitelake.llm.frames import id_crc, table
from sitelake.llm.hard_negatives import mine
from sitelake.llm.katz import score_documents as katz_scores
from sitelake.llm.langid import identify
from sitelake.llm.langid import learn as learn_languages
from sitelake.llm.lexical import rank_documents
from sitelake.llm.ngram_join import similar_documents
from sitelake.llm.packing import pack_documents
from sitelake.llm.piece_encoding import encode_digests
from sitelake.llm.quality import learn as learn_quality
from sitelake.llm.quality import score_documents
from sitelake.llm.sharding import shard_documents
from sitelake.llm.simhash import fingerprint_documents
from sitelake.llm.token_counts import count_tokens
from sitelake.llm.url_filter import judge_urls, rule_table

#: Rows of a batch that goes to Python at once; texts can be long.
BATCH = "4000"
BATCH_BYTES = "32m"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the queries; Python workers find this package where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    return tune(spark)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf: fn(prepare(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


OP6 = r"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from d group by h)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.h as text_sha256 from d join g using (h)
"""


@query("op6_exact_dedup", OP6)
def op6_exact_dedup(spark, sf):
    """The older half of the ids is the history, the newer half is looked up in it."""
    docs = table(spark, sf, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    out = exact_dedup(docs, F.col("doc_id") <= middle)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _attribute_sql(tag: str, name: str) -> str:
    pattern = rf"""(?is)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return "(" + " || ".join(f"regexp_extract({tag}, '{pattern}', {g})" for g in (1, 2, 3)) + ")"


def _value_sql(value: str) -> str:
    """An attribute's value with its character references read."""
    code = lambda number: f"case when {number} between 1 and 1114111 and {number} not between 55296 and 57343 then chr(({number})::int) else p end"
    return f"""trim(coalesce(array_to_string(list_transform(
      regexp_extract_all({value}, '(?s)&#[0-9]{{1,7}};|&#[xX][0-9A-Fa-f]{{1,6}};|&[a-z]{{2,4}};|[^&]+|&'), lambda p:
      case when regexp_matches(p, '^&#[0-9]') then {code("regexp_extract(p, '([0-9]+)', 1)::bigint")}
        when regexp_matches(p, '^&#[xX]') then {code("('0x' || regexp_extract(p, '[xX]([0-9A-Fa-f]+)', 1))::bigint")}
        when p = '&amp;' then '&' when p = '&quot;' then '"' when p = '&lt;' then '<' when p = '&gt;' then '>' else p end), ''), ''))"""


def _resolved_sql(target: str, base: str, out: str, keep: str, source: str) -> str:
    """Two steps of a statement: ``target`` seen from ``base``, then without dot segments, as ``out``."""
    site, path = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", f"regexp_extract({base}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    own = "regexp_extract(whole, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    return rf"""
{out}_whole as (
  select {keep}, case when regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') then {target}
    when starts_with({target}, '//') then regexp_extract({base}, '(?s)^(.*?)://', 1) || ':' || {target}
    when starts_with({target}, '/') then {site} || {target}
    when starts_with({target}, '?') then {site} || {path} || {target}
    when starts_with({target}, '#') or regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
    else {site} || coalesce(nullif(regexp_extract({path}, '(?s)^(.*/)', 1), ''), '/') || {target} end as whole from {source}),
{out}_parts as (
  select {keep}, whole, {own} as own, string_split({own}, '/')[2:] as segments from {out}_whole),
{out}_kept as (
  select *, list_reduce(list_prepend([]::varchar[], list_transform(segments, lambda s: [s])), lambda held, s:
    case when s[1] = '..' then held[1:greatest(len(held) - 1, 0)] when s[1] = '.' then held else list_concat(held, s) end) as held from {out}_parts),
{out}_step as (
  select {keep}, case when starts_with(own, '/') and regexp_matches(own, '/\.{{1,2}}(/|$)') then
    regexp_extract(whole, '(?s)^(.*?://[^/?#]*)', 1) || '/' || coalesce(array_to_string(held, '/'), '') || case when segments[-1] in ('.', '..') and len(held) > 0 then '/' else '' end
      || regexp_extract(whole, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1) else whole end as {out} from {out}_kept),"""


OP10 = rf"""
with recursive parts as (
  select page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
tagged as (
  select url, regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta|base)\b[^>]*>') as tags from pages where url is not null),
based as (
  select url, tags, list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base')), lambda t: {_attribute_sql("t", "href")}), lambda h: trim(h) <> '')[1] as base_value
  from tagged where len(tags) > 0),
read as (select url, tags, case when base_value is not null then {_value_sql("base_value")} end as base_href from based),
{_resolved_sql("base_href", "url", "base_url", "url, tags", "read")}
tags as (
  select url, coalesce(base_url, url) as base, unnest(tags) as tag from base_url_step),
targets as (
  select url, base, case
    when regexp_matches(tag, '(?i)^<link') and list_contains(regexp_split_to_array(lower({_attribute_sql("tag", "rel")}), '\s+'), 'canonical') then {_value_sql(_attribute_sql("tag", "href"))}
    when regexp_matches(tag, '(?i)^<meta') and lower(trim({_attribute_sql("tag", "http-equiv")})) = 'refresh' then
      regexp_extract({_value_sql(_attribute_sql("tag", "content"))}, '(?is)\burl\s*=\s*["'']?([^"''\s]*)', 1) end as t from tags),
stated as (select * from targets where t <> ''),
{_resolved_sql("t", "base", "to_url", "url", "stated")}
absolute as (select * from to_url_step),
named as (
  select u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path, regexp_extract(u, '(?s)^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1) as query
  from (select url as u from pages union select to_url from absolute) where u like '%://%'),
links as (
  select a.host || a.path || a.query as u, b.host || b.path || b.query as v
  from absolute x join named a on a.u = x.url join named b on b.u = x.to_url),
both_ways as (select u, v from links union select v, u from links),
reach as (select u as node, v as other from both_ways union select r.node, b.v from reach r join both_ways b on b.u = r.other),
rules(kind, rule_host, rule_path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
places as (select host, path from parts union select host, path from named),
best as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(kind, length(rule_host || rule_path)) as kind
  from places join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by host, path),
tainted as (
  select distinct r.node from reach r join named n on n.host || n.path || n.query = r.other join best b on b.host = n.host and b.path = n.path where b.kind = 'block')
select p.page_id, p.host, p.path, b.rule,
  coalesce(b.kind, case when t.node is not null then 'block' end, 'allow') as verdict
from parts p left join best b on b.host = p.host and b.path = p.path
left join tainted t on p.url like '%://%' and t.node = p.host || p.path || regexp_extract(p.url, '(?s)^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1)
"""


@query("op10_url_filter", OP10)
def op10_url_filter(spark, sf):
    return judge_urls(table(spark, sf, "pages"), rule_table(spark))


@query("op9_packing")
def op9_packing(spark, sf):
    return pack_documents(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op7_token_counts")
def op7_token_counts(spark, sf):
    return count_tokens(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf):
    return encode_digests(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op8_simhash")
def op8_simhash(spark, sf):
    return fingerprint_documents(table(spark, sf, "documents"))


@query("op3_language_id")
def op3_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out")
    filters = learn_languages(docs.where(~held_out))
    out = identify(docs.select("doc_id", "text", held_out), filters)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query("op4_quality")
def op4_quality(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out")
    labels = table(spark, sf, "labels").where(id_crc(F.col("doc_id")) % 3 != 1)
    model = learn_quality(docs, labels)
    out = score_documents(docs.select("doc_id", "text", held_out), model)
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query("op1_ngram_join")
def op1_ngram_join(spark, sf):
    return similar_documents(table(spark, sf, "documents")).drop("digest")


@query("op2_katz_scores")
def op2_katz_scores(spark, sf):
    return katz_scores(table(spark, sf, "documents"), id_crc(F.col("doc_id")) % 7 != 2)


# The checksum table of CRC-32 comes from its polynomial, 0xEDB88320; the walk multiplies as 128-bit numbers.
OP11 = r"""
with recursive crc(i, c) as (
  select i, i from range(256) r(i)),
crc_table as (
  select list(c order by i) as crc_of from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from crc)),
texts as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
bytes as (
  select r, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::bigint) as b from texts),
sums as (
  select r, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, crc_of[xor(c % 256, x) + 1])), 4294967295) as text_crc32 from bytes, crc_table),
walk(r, shards, key, place, step) as (
  select r, shards, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 16))::hugeint, 0::bigint, 0::bigint from texts, (values (16), (17)) n(shards)
  union all
  select r, shards, next, step, floor((step + 1) * (2147483648::double / ((next // 8589934592)::double + 1)))::bigint
  from (select r, shards, step, (key * 2862933555777941757 + 1) % 18446744073709551616 as next from walk where step < shards)),
places as (
  select r, max(place) filter (shards = 16) as shard, max(place) filter (shards = 17) as grown_shard from walk group by r)
select doc_id, octet_length(encode(t))::bigint + 1 as size, text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by doc_id nulls first, octet_length(encode(t)), text_crc32) - 1 as slot, grown_shard::int as grown_shard
from texts join sums using (r) join places using (r)
"""


@query("op11_sharding", OP11)
def op11_sharding(spark, sf):
    return shard_documents(table(spark, sf, "documents"), 16)


OP13 = r"""
with terms as (
  select doc_id, row_number() over () as r, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
counts as (select r, doc_id, term, count(*) as tf from terms group by all),
sizes as (select r, sum(tf)::bigint as n from counts group by r),
totals as (select count(*) as docs, sum(n)::bigint as total from sizes),
norms as (select r, 75 + ((25 * n * docs) // total) as m from sizes, totals),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from counts, totals group by term, docs),
wanted as (
  select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
scores as (
  select item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from wanted join counts using (term) join weights using (term) join norms using (r) group by item_id, doc_id, r),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""


@query("op13_lexical_search", OP13)
def op13_lexical_search(spark, sf):
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 20)


OP12 = r"""
with vectors as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as x
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.r, a.vec_id as anchor_id, b.r as other, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from vectors a, vectors b where a.vec_id % 100 = 0),
near as (
  select r, anchor_id, other_id as positive_id, score as positive_score from scores where same and r <> other
  qualify row_number() over (partition by r order by score desc, other_id, other) <= 5)
select anchor_id, positive_id, (row_number() over w)::int as rank, other_id as negative_id, positive_score, score as negative_score
from near join scores using (r, anchor_id) where not same and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by r, positive_id, positive_score order by score desc, other_id, other) qualify row_number() over w <= 5
"""


@query("op12_hard_negatives", OP12)
def op12_hard_negatives(spark, sf):
    return mine(table(spark, sf, "embeddings"))
