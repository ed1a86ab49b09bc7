"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, jaccard, language, lines, mixing, packing, pii, quality, sharding, substrings, topk, trie
from .tables import read

Query = Callable[[SparkSession, str], DataFrame]


def on(table: str, f: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark, read(spark, sf_dir, table))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": on("documents", packing.op1),
    "op2_ngram_jaccard_join": on("documents", jaccard.op2),
    "op3_language_id": on("documents", language.op3),
    "op4_quality_rules": on("documents", quality.op4),
    "op5_mixing": on("documents", mixing.op5),
    "op6_chat_formatting": on("conversations", chat.op6),
    "op7_line_dedup": on("documents", lines.op7),
    "op8_sharding": on("documents", sharding.op8),
    "op9_exact_top_k": on("embeddings", topk.op9),
    "op10_substring_dedup": on("documents", substrings.op10),
    "op11_pii": on("documents", pii.op11),
    "op12_conversation_trie": on("conversations", trie.op12),
    "op13_filter_audit": audit.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat_formatting": r"""with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select *, 24 + length(replace(replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')) + length(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>')) as chars, row_number() over w as i, count(*) over (partition by conv_id) as n from r window w as (partition by conv_id order by turn nulls first, role, text)),
g as (select *, sum(chars) over (partition by conv_id order by i) as upto from f)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256, length(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_chars,
sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(upto) filter (role = 'assistant' or i = n) as bigint) as formatted_chars from g group by 1""",
    "op9_exact_top_k": """with v as (select vec_id, [floor(1024 * cast(x as double)) for x in embedding] as v from embeddings
where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(cast(x as double))]) = 0),
s as (select q.vec_id as query_id, e.vec_id, cast(list_inner_product(q.v, e.v) as bigint) as score from v q join v e on q.vec_id <> e.vec_id and len(q.v) = len(e.v) where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op10_substring_dedup": r"""with d as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20),
k as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as s from p),
r as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as n from k),
g as (select distinct doc_id, unnest(range(i, i + 20)) as j from r where n > 1),
e as (select doc_id, w, unnest(range(1, len(w) + 1)) as j from d),
f as (select e.doc_id, count(g.j) as n_removed, string_agg(case when g.j is null then w[e.j] end, ' ' order by e.j) as kept from e left join g on e.doc_id = g.doc_id and e.j = g.j group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join f using (doc_id)""",
    "op12_conversation_trie": r"""with own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
from conversations where conv_id is not null),
c as (select distinct conv_id, xor(list_reduce([cast(ascii(x) as ubigint) for x in string_split(cast(conv_id as varchar), '')], lambda a, b:
list_reduce([cast(y as ubigint) for y in range(8)], lambda p, q: xor(p >> 1, (p & 1) * 3988292384), xor(a, b)), cast(4294967295 as ubigint)), 4294967295) % 9 as h from own),
heads as (select c.conv_id, o.pos, role, text from c join own o on o.conv_id = c.conv_id - c.conv_id % 5 and o.pos <= h),
taken as (select conv_id, count(*) as n from heads group by 1),
turns as (select * from heads union all select o.conv_id, o.pos - cast(h as bigint) + coalesce(n, 0), role, text from own o join c using (conv_id) left join taken using (conv_id) where o.pos > h),
m as (select conv_id, 0 as depth, '' as k, 0 as bytes from c union all select conv_id, pos, sha256(string_agg(sha256(length(role) || ':' || role || text), '' order by pos)
over (partition by conv_id order by pos rows between unbounded preceding and current row)), strlen(text) from turns),
e as (select *, lead(k) over (partition by conv_id order by depth) is null as last, lag(k) over (partition by conv_id order by depth) as up from m),
n as (select depth, k, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last), '')) as ends_sha256 from e group by 1, 2),
ch as (select depth - 1 as depth, up as k, count(*) as n_children from n where depth > 0 group by 1, 2),
s as (select n.*, coalesce(n_children, 0) as n_children, p.conv_id as parent_conv_id from n left join ch using (depth, k) left join n p on p.depth = n.depth - 1 and p.k = n.up),
t as (select a.depth, a.k, count(*) filter (s.n_children = 0) as n_leaves, sum((s.n_convs - 1) * s.bytes) as saved_tokens from s join m a on a.conv_id = s.conv_id and a.depth <= s.depth group by 1, 2)
select s.conv_id, cast(s.depth as bigint) as depth, parent_conv_id, n_convs, n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, ends_sha256 from s join t using (depth, k)""",
    "op13_filter_audit": r"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, [x for x in regexp_split_to_array(t, '[\x20\x09-\x0D]+') if x <> ''] as w, min(doc_id) over (partition by t) as least from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(least < w.doc_id, false)] as fails from w left join l on w.doc_id = l.doc_id),
c as (select part, good, toxic, fails, count(*) as n from f group by all),
k as (select unnest(range(1, 6)) as k),
o as (select [a.k, b.k, c.k, d.k, e.k] as o from k a, k b, k c, k d, k e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s as (select o, k as step, o[k] as filter, o[1:k - 1] as before from o, k),
m as (select part, o, step, filter, n, good, toxic, fails[filter] as fail, len([x for x in before if fails[x]]) > 0 as gone,
len([x for x in range(1, 6) if fails[x]]) = 1 as alone from c, s),
r as (select part, o, step, filter, sum(case when not gone and not fail then n else 0 end) as kept, sum(case when fail and not gone then n else 0 end) as removed,
sum(case when fail and gone then n else 0 end) as redundant, sum(case when fail and alone then n else 0 end) as unique_fails,
sum(case when fail and not gone then n * good else 0 end) as good_lost, sum(case when fail and not gone then n * toxic else 0 end) as toxic_lost from m group by all)
select part, array_to_string([['A', 'B', 'C', 'D', 'E'][x] for x in o], '') as filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
cast(sum(removed) over (partition by part, filter) as bigint) as shapley from r""",
}
