"""SQL (DuckDB) for the queries that SQL can express."""

from arborlens.llm.url_filter import SUFFIXES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Exact groups: sets of shingles, all pairs that share a shingle by an inverted index, and reachability.
OP1 = f"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
shingles as (
  select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach(doc_id, other) as (
  select a, b from links union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, cast(least(d.doc_id, coalesce(m, d.doc_id)) as bigint) as component_id,
  d.doc_id <= coalesce(m, d.doc_id) as kept
from documents d left join sizes using (doc_id) left join (select doc_id, min(other) as m from reach group by doc_id) using (doc_id)
"""

# Reputation by hand: three levels of beta-binomial posteriors, each with a prior strength by moments.
_MOMENTS = "case when sum(n*(n-1)*prior*(1-prior)) <> 0 then (sum((good-n*prior)*(good-n*prior)) - sum(n*prior*(1-prior))) / sum(n*(n-1)*prior*(1-prior)) else 0.5 end"
_STRENGTH = f"1 / least(greatest({_MOMENTS}, 0.001), 0.999) - 1"
OP5 = f"""
with rules(rhost, rpath, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p as (select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
h0 as (select host, count(quality) as n, coalesce(sum(quality), 0) as good from p left join labels on doc_id = page_id group by host),
l as (select *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') as labels from h0),
h as (select * exclude (labels), case when array_to_string(labels[-2:], '.') in ({", ".join(f"'{x}'" for x in SUFFIXES)}) then array_to_string(labels[-3:], '.') else array_to_string(labels[-2:], '.') end as domain,
  case when array_to_string(labels[-2:], '.') in ({", ".join(f"'{x}'" for x in SUFFIXES)}) then array_to_string(labels[-2:], '.') else labels[-1] end as suffix from l),
d as (select suffix, domain, sum(n) as n, sum(good) as good from h group by all),
s as (select suffix, sum(n) as n, sum(good) as good, (select (sum(good) + 1) / (sum(n) + 2) from h) as prior from d group by suffix),
s2 as (select suffix, (good + prior * k) / (n + k) as mean from s, (select {_STRENGTH} as k from s)),
d1 as (select domain, n, good, mean as prior from d join s2 using (suffix)),
d2 as (select domain, (good + prior * k) / (n + k) as mean from d1, (select {_STRENGTH} as k from d1)),
h1 as (select host, n, good, mean as prior from h join d2 using (domain)),
h2 as (select host, n, good, good + prior * k as a, n - good + (1 - prior) * k as b from h1, (select {_STRENGTH} as k from h1)),
u as (select host, n, good, a / (a + b) + 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as upper from h2),
best as (select page_id, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) as r
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select page_id, host, path, r.rule as rule, coalesce(r.verdict, case when upper < 0.5 then 'block' else 'allow' end) as verdict,
  cast(n as bigint) as host_labelled, cast(good as bigint) as host_good
from p left join best using (page_id) join u using (host)
"""

OP7 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select q.vec_id as query_id, v.vec_id, cast(list_dot_product(q.e, v.e) as bigint) as score,
    row_number() over (partition by q.vec_id order by list_dot_product(q.e, v.e) desc, v.vec_id) as rank
  from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0) where rank <= 10
"""

_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
OP10 = f"""
with b as (select item_id, {_WORDS} as w from benchmark where item_id is not null and text is not null),
bw as (select distinct item_id, m as len, array_to_string(w[i:i + m - 1], ' ') as g
  from (select item_id, w, least(len(w), 13) as m, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
lengths as (select distinct len as m from bw),
d as (select doc_id, {_WORDS} as w from documents),
dw as (select doc_id, m as len, i - 1 as pos, array_to_string(w[i:i + m - 1], ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, lengths where len(w) >= m)),
hits as (select doc_id, pos, dw.len, item_id from dw join bw on dw.g = bw.g and dw.len = bw.len),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(pos, pos + len)) as p from (select distinct doc_id, pos, len from hits)) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as names from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(covered.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(covered.n, 0) > 0 and 20 * coalesce(covered.n, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

# Lengths of the written turns: marks and escapes added to the texts. Roles of the given tables need no escapes.
OP11 = r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
told as (select conv_id, count(*) as n, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as whole,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as learnt,
  sum(length('### ' || role || ': ' || replace(replace(text, '### ', '\### '), '</turn>', '\</turn>') || chr(10) || '</turn>' || chr(10))) as size
  from rows group by conv_id)
select conv_id, n as n_turns, sha256(whole) as turns_sha256, length(learnt) as loss_chars, sha256(learnt) as loss_sha256,
  cast(size as bigint) as formatted_chars
from told
"""

# Every prefix as a list; subtrees by comparing prefixes. The check sum of an id is worked out bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(ascii(c) as bigint)),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""
OP12 = f"""
with own as (select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as t
  from conversations where conv_id is not null group by conv_id),
h as (select *, {_CRC} % 6 as h from own),
seqs as (select h.conv_id, coalesce(own.t[:h.h], []) || h.t[h.h + 1:] as s from h left join own on own.conv_id = h.conv_id - h.conv_id % 100),
steps as (select conv_id, s, unnest(range(len(s) + 1)) as d from seqs),
nodes as (select d as depth, s[:d] as p, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * coalesce(length(any_value(s)[d].text), 0) as worth,
  coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(s) = d), '') as ends from steps group by d, s[:d]),
kids as (select depth - 1 as depth, p[:depth - 1] as p, count(*) as n from nodes where depth > 0 group by all),
full_nodes as (select nodes.*, coalesce(kids.n, 0) as n_children from nodes left join kids on kids.depth = nodes.depth and kids.p = nodes.p),
below as (select a.depth, a.p, count(*) filter (b.n_children = 0) as n_leaves, sum(b.worth) as saved
  from (select depth, p from full_nodes) a join full_nodes b on b.p[:a.depth] = a.p and b.depth >= a.depth group by a.depth, a.p)
select n.conv_id, n.depth, up.conv_id as parent_conv_id, n.n_convs, cast(n.n_children as bigint) as n_children, below.n_leaves,
  cast(below.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from full_nodes n join below on below.depth = n.depth and below.p = n.p left join nodes up on up.depth = n.depth - 1 and up.p = n.p[:n.depth - 1]
"""


def _rounds(k: int = 8, rounds: int = 10) -> str:
    """Round after round: nearest centroid of every vector, then floors of exact means."""
    steps = ["""v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"c0 as (select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, e from v qualify c < {k})"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as (select vec_id, e, w.c, w.d from (select vec_id, any_value(v.e) as e, min(struct_pack(
    d := list_sum(list_transform(list_zip(v.e, m.e), lambda z: cast((z[1] - z[2]) * (z[1] - z[2]) as hugeint))), c := m.c)) as w
  from v, c{i} m group by vec_id))""")
        if i < rounds:
            steps.append(f"""s{i} as (select c, i, sum(e[i]) as s, count(*) as n from a{i}, (select unnest(range(1, 65)) as i) group by c, i),
c{i + 1} as (select m.c, coalesce(x.e, m.e) as e from c{i} m left join (
  select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as e from s{i} group by c) x on x.c = m.c)""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(m.e, ',')) as centroid_sha256
from a{rounds} a join c{rounds} m using (c)
"""


OP13 = _rounds()

SQL = {
    "op1_near_duplicates": OP1, "op5_url_verdicts": OP5, "op7_nearest": OP7, "op10_contamination": OP10, "op11_chats": OP11,
    "op12_conversation_trie": OP12, "op13_centroids": OP13,
}
