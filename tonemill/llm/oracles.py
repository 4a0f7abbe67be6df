"""The operators that SQL can express, for DuckDB."""

_U, _L = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_U}', '{_L}'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as g from d),
n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
e as (select a, b from pairs join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)),
ways as (select a, b from e union select b, a from e),
reach(a, c) as (select a, a from ways union select r.a, w.b from reach r join ways w on w.a = r.c),
comp as (select a, min(c) as c from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.c, d.doc_id) as component_id, coalesce(comp.c, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join comp on comp.a = d.doc_id"""

DECONTAMINATION = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_U}', '{_L}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{_U}', '{_L}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select item, least(len(w), 10) as n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as t from b where len(w) > 0),
sizes as (select distinct n from win),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
grams as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as t from places),
hits as (select g.doc_id, g.i, g.n, win.item from grams g join win on win.n = g.n and win.t = g.t),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered c on c.doc_id = d.doc_id left join items i on i.doc_id = d.doc_id"""

REPEATS = """
with d as (select doc_id, encode(coalesce(text, '')) as t from documents),
starts as (select doc_id, t, unnest(range(1, octet_length(t) - 48)) as p from d where octet_length(t) >= 50),
s as (select doc_id, p, hash(array_slice(t, p, p + 49)) as k from starts),
first as (select k, min(doc_id) as m from s group by k having min(doc_id) <> max(doc_id)),
hit as (select distinct s.doc_id, s.p from s join first on first.k = s.k where s.doc_id > first.m),
edge as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as fresh from hit),
runs as (select doc_id, min(p) as a, max(p) + 50 as b from (select *, sum(fresh) over (partition by doc_id order by p) as run from edge) group by doc_id, run),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 1) as before from runs),
kept as (select g.doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(case when before < a then hex(array_slice(t, before, a - 1)) else '' end, '' order by a) || case when max(b) <= any_value(octet_length(t)) then hex(array_slice(any_value(t), max(b), any_value(octet_length(t)))) else '' end as rest from gaps g join d on d.doc_id = g.doc_id group by g.doc_id)
select d.doc_id, cast(octet_length(t) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(coalesce(unhex(rest), t)) as kept_sha256
from d left join kept k on k.doc_id = d.doc_id"""

# DuckDB has no CRC-32: eight steps for each byte of the decimal id.
_CRC = "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))))"

PREFIX_TRIE = f"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
l as (select conv_id, list(struct_pack(role := role, text := text) order by i) as turns from t group by conv_id),
c as (select conv_id, turns, {_CRC} % 6 as h from l),
r as (select c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) as turns from c left join l b on b.conv_id = c.conv_id - c.conv_id % 100),
steps as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from r),
p as (select conv_id, depth, list_slice(turns, 1, depth) as path, len(turns) = depth as ends, case when depth > 0 then length(turns[depth].text) else 0 end as chars from steps),
nodes as (select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends) as ids from p group by path),
kids as (select list_slice(path, 1, depth - 1) as path, count(*) as n_children from nodes where depth > 0 group by 1),
known as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids k on k.path = n.path),
ups as (select list_slice(path, 1, a) as path, n_children, (n_convs - 1) * chars as saved from (select *, unnest(range(0, depth + 1)) as a from known)),
sums as (select path, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved from ups group by path)
select k.conv_id, k.depth, m.conv_id as parent_conv_id, k.n_convs, k.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(coalesce(k.ids, '')) as ends_sha256
from known k join sums s on s.path = k.path left join nodes m on k.depth > 0 and m.path = list_slice(k.path, 1, k.depth - 1)"""
