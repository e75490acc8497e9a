"""The registered queries of this package, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontam, htmltext, langid, linededup, neardup, pieces, quality, urlfilter, warc
from tessera.llm._store import table

#: Bound of op1's sample: about so many whole labelled texts of each language.
TEXTS_PER_LANGUAGE = 1000


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    texts, langs = langid.sample(docs.where(part != 2), "text", "lang", "doc_id", TEXTS_PER_LANGUAGE)
    found = langid.identify(spark, docs.select("doc_id", "text"), langid.LanguageModel.train(texts, langs))
    return found.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.find_items(spark, docs.select("doc_id", "text"), benchmark)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.keep_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"), with_input=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(linededup.kept_text("text", "keep_bitmap"), 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_url_filters, op3_minhash_neardup, op4_chat_perspectives, op5_html_text, op6_warc_bundles, op7_decontamination, op8_sentencepiece, op9_line_dedup, op10_quality_rules)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op2_url_filters": f"""
with u as (
  select page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(verdict, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (
  select u.page_id, u.host, u.path, r.verdict, rhost || rpath as rule
  from u join r on (u.host = rhost or ends_with(u.host, '.' || rhost)) and starts_with(u.path, rpath)),
b as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from m group by all)
select u.page_id, u.host, u.path, b.rule,
       coalesce(b.verdict, case when {' or '.join(f"contains(u.host, '{w}')" for words in urlfilter.BLOCKED_WORDS.values() for w in words)} then 'block' else 'allow' end) as verdict
from u left join b on u.page_id = b.page_id and u.host = b.host and u.path = b.path
""",
    "op4_chat_perspectives": """
with t as (
  select conv_id, turn,
         coalesce(nullif(trim(role, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ''), 'unknown') as who,
         coalesce(text, '') as raw,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') as said
  from conversations),
n as (select *, replace(replace(replace(replace(replace(who, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') as shown from t),
p as (select distinct conv_id, who as perspective from t where who <> 'system'),
j as (
  select n.conv_id, perspective, turn, who, raw, said, shown,
         case when who = 'system' then 'system' when who = perspective then 'assistant' else 'user' end as chat_role
  from n join p on n.conv_id is not distinct from p.conv_id),
h as (select *, '<|im_start|>' || chat_role || case when chat_role = 'user' then ' name=' || shown else '' end || chr(10) as head from j),
r as (select *, head || said || '<|im_end|>' || chr(10) as rendered from h),
o as (select *, row_number() over w - 1 as position, sum(length(rendered)) over (w rows between unbounded preceding and current row) - length(rendered) as start
      from r window w as (partition by conv_id, perspective order by turn nulls first, who, raw))
select conv_id, perspective, cast(position as bigint) as position, turn, chat_role, case when chat_role = 'user' then who end as name,
       rendered, cast(start as bigint) as start,
       cast(case when chat_role = 'assistant' then start + length(head) else -1 end as bigint) as mask_start,
       cast(case when chat_role = 'assistant' then length(said) + 10 else 0 end as integer) as mask_length
from o
""",
    "op6_warc_bundles": """
with d as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as x from pages),
g as (select x, min(page_id) as first from d group by x)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(((cast('0x' || substr(d.x, cast((i // 4) * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1 as bigint), 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from d join g on d.x = g.x
""",
    "op9_line_dedup": f"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from l),
k as (select doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key from e),
f as (select key, max(doc_id) as keep from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.doc_id, i, line, f.key is not null and k.doc_id <> f.keep as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from j group by doc_id
""",
}
