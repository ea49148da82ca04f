"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, embeddings, licences, packing, quality, queries_more, simhash, token_counts, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "paragraph", "family", "likeliest", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")


def op3_chat_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(_table(spark, sf_dir, "conversations"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(_table(spark, sf_dir, "documents")))


#: Documents whose labels are never learnt from: every fifth by CRC-32 of the id as text.
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"
QUALITY_LEAST = 0.3


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = quality.train(docs, _table(spark, sf_dir, "labels"), teach=~F.expr(HELD_OUT))
    scored = quality.score(docs, scorer)
    return scored.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")
    records = warc.read(manifest, manifest.folder).where("gap is null")
    return records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_chat_quotation_links, op4_benchmark_decontamination, op5_simhash_near_dedup, op6_best_fit_packing, op7_token_files, op8_quality_classifier, op9_embedding_near_dedup, op10_warc)} | queries_more.QUERIES
_NORMAL = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_QUOTE = chat.QUOTE

#: Quotation linking in DuckDB's SQL, on the passages themselves instead of their hashes.
CHAT_SQL = f"""with recursive
m as (select conv_id, turn, role, text as raw, row_number() over (order by conv_id nulls first, turn nulls first, role nulls first, text nulls first) - 1 as g from conversations),
a as (select g, string_split(regexp_replace(coalesce(raw, ''), '\\r\\n?', chr(10), 'g'), chr(10)) as ls from m),
l as (select g, unnest(ls) as line, generate_subscripts(ls, 1) as i from a),
v as (select *, length(regexp_replace(regexp_extract(line, '{_QUOTE}', 1), '[^>]', '', 'g')) as lev, regexp_replace(line, '{_QUOTE}', '') as plain from l),
c as (select *, case when lag(lev) over (partition by g order by i) = lev then 0 else 1 end as chg from v),
s as (select *, sum(chg) over (partition by g order by i) as seg from c),
x as (select *, max(i) over (partition by g, seg) as e, max(i) over (partition by g) as n from s),
st as (select g, seg, coalesce(string_agg(plain, chr(10) order by i) filter (not (i = e and e < n and regexp_matches(plain, '{chat.INTRODUCES}'))), '') as t from x where lev = 0 group by g, seg),
o as (select m.g, coalesce(trim(string_agg(st.t, chr(10) order by st.seg), ' ' || chr(10) || chr(9)), '') as own from m left join st using (g) group by m.g),
q as (select g, seg, any_value(lev) > 1 as deep, string_agg(plain, chr(10) order by i) as t from x where lev > 0 group by g, seg),
asked as (
  select distinct g, deep, {_NORMAL.format("u")} as u
  from (select g, deep, t as u from q union all select g, deep, unnest(string_split(t, chr(10))) from q)),
said as (
  select distinct g, {_NORMAL.format("u")} as u
  from (select g, own as u from o union all select g, unnest(regexp_split_to_array(own, '\\n\\s*\\n')) from o union all select g, unnest(string_split(own, chr(10))) from o)),
f as (
  select asked.g, asked.deep, asked.u, max(b.g) as t
  from asked join m on m.g = asked.g join said on said.u = asked.u join m b on b.g = said.g and b.conv_id = m.conv_id and b.turn < m.turn
  where asked.u <> '' group by 1, 2, 3),
w as (select g, t, count(*) filter (not deep) as n, count(*) filter (deep) as d from f group by 1, 2),
k as (select g, max(struct_pack(n := n, t := t)) filter (n > 0) as best, sum(n) as n_linked, sum(d) as n_deeper from w group by 1),
p as (
  select m.*, min(m.g) over (partition by m.conv_id) as g0,
    case when m.conv_id is null then null when k.best is not null then k.best.t when b.conv_id = m.conv_id then b.g end as parent,
    coalesce(k.n_linked, 0) as n_linked, coalesce(k.n_deeper, 0) as n_deeper
  from m left join k using (g) left join m b on b.g = m.g - 1),
walk as (
  select g, g as top, 0 as depth, [g] as path from p where parent is null
  union all select p.g, walk.top, walk.depth + 1, list_append(walk.path, p.g) from walk join p on p.parent = walk.g)
select p.conv_id, row_number() over (partition by p.conv_id order by walk.path) - 1 as position, p.turn, p.role, o.own as text, b.turn as reply_to, r.turn as root, cast(walk.depth as bigint) as depth,
  cast((select count(*) from q where q.g = p.g) as int) as n_quotes, cast(p.n_linked as bigint) as n_linked, cast(p.n_deeper as bigint) as n_deeper
from p join o using (g) join walk using (g) join m r on r.g = walk.top left join m b on b.g = p.parent"""

#: All pairs of one label, in double precision; components as a closure.
EMBEDDINGS_SQL = """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
g as (select * from v where label is not null and len(e) > 0 and list_count(e) = len(e) and len(list_filter(e, lambda x: isfinite(x))) = len(e) and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id, vec_id as c from embeddings union select r.vec_id, p.b from r join p on p.a = r.c),
m as (select vec_id, min(c) as component_id from r group by 1), n as (select a as vec_id, count(*) as n from p group by 1)
select vec_id, coalesce(n.n, 0) as n_links, component_id, vec_id = component_id as kept from m left join n using (vec_id)"""

#: Base32 of a SHA-1: five hex digits are four letters.
WARC_SQL = """with p as (select page_id, coalesce(html, '') as html from pages), d as (select page_id, octet_length(encode(html)) as n, sha1(html) as h, max(page_id) over (partition by html) as first from p),
b as (select *, list_transform(range(0, 8), lambda i: cast('0x' || substr(h, cast(i * 5 + 1 as int), 5) as int)) as w from d)
select page_id, cast(n as bigint) as payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((w[k // 4 + 1] >> cast(15 - 5 * (k % 4) as int)) & 31) + 1, 1)), '') as payload_digest,
 case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from b"""

ORACLE_SQL: dict[str, str] = {"op3_chat_quotation_links": CHAT_SQL, "op9_embedding_near_dedup": EMBEDDINGS_SQL, "op10_warc": WARC_SQL} | queries_more.ORACLE_SQL
