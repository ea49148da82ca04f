"""The queries of operators 11 to 13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, pii, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: Every order is applied to the documents themselves, counted by their set of failures; Shapley values are the sums over the 120 orders.
AUDIT_SQL = """with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') as ws from documents),
w as (select *, list_filter(ws, lambda x: x <> '') as words, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by 1),
f as (
  select part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > first, false) as e, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from w left join l using (doc_id)),
m as (select part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from o),
fs as (
  select m.*, s.filter_order, s.step, list_transform(string_split(s.filter_order, ''), lambda k: case k when 'A' then fails.A when 'B' then fails.B when 'C' then fails.C when 'D' then fails.D else fails.E end) as v
  from m, s),
st as (
  select *, substr(filter_order, step, 1) as letter, v[step] as here, list_bool_or(v[1:step - 1]) is true as gone, (select count(*) from (select unnest(v) as q) where q) as n_fails from fs),
r as (
  select part, filter_order, step, letter, sum(n) filter (not gone and not here) as kept, sum(n) filter (not gone and here) as removed, sum(n) filter (gone and here) as redundant, sum(n) filter (here and n_fails = 1) as unique_fails,
    sum(good) filter (not gone and here) as good_lost, sum(toxic) filter (not gone and here) as toxic_lost
  from st group by 1, 2, 3, 4)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
  cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(coalesce(sum(removed) over (partition by part, letter), 0) as bigint) as shapley
from r"""


def op12_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).drop("text")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations whose first 0 to 3 turns, by CRC-32 of the id, are those of the twentieth conversation before or at them."""
    turns, ids = trie.ordered(conversations)
    n_head = F.expr("crc32(cast(cast(conv_id as string) as binary)) % 4")
    return trie.trie(trie.grafted(turns, ids, F.expr("conv_id - conv_id % 20"), n_head, most=3), ids)


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(_table(spark, sf_dir, "conversations"))


#: Every prefix of every rebuilt conversation as a list of turns; the CRC-32 is worked out bit by bit.
TRIE_SQL = """with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '')) as pos from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 20 as head, cast(list_reduce([cast(4294967295 as bigint)] || list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
    lambda a, x: list_reduce([xor(a, x)] || list_transform(range(8), lambda i: i), lambda b, i: xor(b // 2, (b % 2) * 3988292384))) as bigint) as crc
  from (select distinct conv_id from t)),
h as (select conv_id, head, xor(crc, 4294967295) % 4 as h from c),
b as (
  select h.conv_id, t.pos, t.role, t.text from h join t on t.conv_id = h.head and t.pos <= h.h
  union all select h.conv_id, t.pos, t.role, t.text from h join t on t.conv_id = h.conv_id and t.pos > h.h),
g as (
  select conv_id, 0 as depth, [] :: struct(r varchar, x varchar)[] as path, '' as text from h
  union all select conv_id, row_number() over w as depth, list(struct_pack(r := role, x := text)) over w as path, text from b window w as (partition by conv_id order by pos)),
n as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * len(list_filter(string_split_regex(min(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as own from g group by 1, 2),
m as (select g.conv_id as member, n.* from g join n using (depth, path)),
e as (select conv_id, max(depth) as last from g group by 1),
p as (select c.depth, c.conv_id, p.conv_id as parent from n c join m p on p.member = c.conv_id and p.depth = c.depth - 1),
k as (select depth - 1 as depth, parent as conv_id, count(*) as n_children from p group by 1, 2),
f as (select n.*, coalesce(k.n_children, 0) as n_children, p.parent from n left join k using (depth, conv_id) left join p using (depth, conv_id)),
s as (select m.depth, m.conv_id, sum(f.own) as saved, count(*) filter (f.n_children = 0) as n_leaves from f join m on m.member = f.conv_id and m.depth <= f.depth group by 1, 2),
x as (select m.depth, m.conv_id, sha256(string_agg(cast(m.member as varchar), ',' order by m.member)) as sha from m join e on e.conv_id = m.member and e.last = m.depth group by 1, 2)
select f.conv_id, cast(f.depth as bigint) as depth, f.parent as parent_conv_id, cast(f.n_convs as bigint) as n_convs, cast(f.n_children as bigint) as n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens,
  coalesce(x.sha, sha256('')) as ends_sha256
from f join s using (depth, conv_id) left join x using (depth, conv_id)"""

QUERIES = {f.__name__: f for f in (op11_filter_interaction_audit, op12_pii_spans, op13_conversation_prefix_trie)}
ORACLE_SQL: dict[str, str] = {"op11_filter_interaction_audit": AUDIT_SQL, "op13_conversation_prefix_trie": TRIE_SQL}
