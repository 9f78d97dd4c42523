"""The same results in DuckDB's SQL."""

from __future__ import annotations

import string

# The words of a text lie between ASCII white space; only A-Z become lower case.
_WORDS = (
    f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
    r"'[^\x20\x09-\x0D]+')"
)


def labelled(links: str) -> str:
    """CTE ``reach(node, label)``: the smallest node that each node of ``links(a, b)`` reaches."""
    return f"""
both_ways as (select a, b from {links} union select b, a from {links}),
walk(node, seen) as (
  select a, a from both_ways union select w.node, l.b from walk w join both_ways l on w.seen = l.a),
reach as (select node, min(seen) as label from walk group by 1)"""


NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {_WORDS} as words from documents),
sh as (
  select distinct doc_id, case when len(words) < 2 then array_to_string(words, ' ')
                               else words[i] || ' ' || words[i + 1] end as shingle
  from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 1, 1))) as i
        from w where len(words) > 0)),
sizes as (select doc_id, count(*) as n from sh group by 1),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as n_both from sh x join sh y
  on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from common join sizes s on s.doc_id = a join sizes t on t.doc_id = b
  where 100 * n_both >= 80 * (s.n + t.n - n_both)),
{labelled("links")}
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(label, d.doc_id) as component_id,
       coalesce(label, d.doc_id) = d.doc_id as kept
from documents d left join sizes using (doc_id) left join reach on node = d.doc_id
"""


def mixing(fills: int = 4) -> str:
    """The mix, with plain running sums and as many rounds of filling."""
    rounds = ""
    for i in range(fills):
        rounds += f"""
best{i} as (select source_key, max({{'size': size, 'row_key': row_key}}) as best from drawn join gaps{i} using (source_key)
  where not drawn and size > 0 and size <= gap and not list_contains(filled, row_key) group by 1),
gaps{i + 1} as (select source_key, gap - coalesce(best.size, 0) as gap,
    case when best is null then filled else list_append(filled, best.row_key) end as filled
  from gaps{i} left join best{i} using (source_key)),"""
    return f"""
with t as (
  select doc_id, text, coalesce('0' || source, '1') as source_key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
         coalesce(doc_id::varchar, '-') || ':' || coalesce(md5(text), '-') as ident
  from documents),
rows_ as (
  select *, ident || ':' || row_number() over (partition by source_key, ident order by size) as row_key from t),
numbered as (select *, (('0x' || substr(md5(row_key), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u from rows_),
sizes as (select source_key, sum(size)::bigint as source_size from numbered group by 1),
weighed as (
  select *, [5, 2, 1][(row_number() over (order by source_key) - 1) % 3 + 1] as weight, 3 * source_size as room from sizes),
running as (
  select *, sum(source_size) over () as whole, sum(weight) over () as weights,
         coalesce(sum(room) over before, 0) as full_room, coalesce(sum(weight) over before, 0) as full_weight
  from weighed window before as (order by room / weight, source_key rows between unbounded preceding and 1 preceding)),
levels as (select *, (whole - full_room)::double / (weights - full_weight)::double as level from running),
level_ as (select max(level) as best_level from levels where level * weight <= room),
plan as (
  select *, greatest(0.0, target - certain * source_size) as left_
  from (select source_key, source_size, target,
               floor(case when source_size > 0 then target / source_size else 0 end + 1e-12)::bigint as certain
        from (select source_key, source_size,
                     least(room::double, coalesce(best_level * weight, room::double)) as target
              from running, level_))),
drawn as (
  select doc_id, n.source_key, row_key, size,
         sum(size) over (partition by n.source_key order by u, row_key rows unbounded preceding) <= left_ as drawn
  from numbered n join plan using (source_key)),
gaps0 as (
  select source_key, any_value(left_) - coalesce(sum(size) filter (where drawn), 0) as gap, []::varchar[] as filled
  from drawn join plan using (source_key) group by 1),{rounds}
last as (select 1)
select doc_id, size::bigint as size, source_size, target,
       (size * (certain + (drawn or list_contains(filled, row_key))::int))::bigint as taken
from drawn join plan using (source_key) join gaps{fills} using (source_key)
"""


# The checks of a vector, and its doubles.
_USABLE = """
  (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
   where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
     and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

THRESHOLD_LINKS = f"""
with recursive good as (
  select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from {_USABLE} where label is not null),
links as (
  select x.vec_id as a, y.vec_id as b from good x join good y
  on x.label = y.label and len(x.v) = len(y.v) and x.vec_id <> y.vec_id
  where list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93),
{labelled("links")}
select e.vec_id, coalesce(n, 0) as n_links, coalesce(label_, e.vec_id) as component_id,
       coalesce(label_, e.vec_id) = e.vec_id as kept
from embeddings e left join (select a, count(*) as n from links group by 1) on a = e.vec_id
     left join (select node, label as label_ from reach) on node = e.vec_id
"""


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::varchar) || ':' || {f}::varchar, '-')" for f in fields) + ")"


def _tree(name: str, leaves: str) -> str:
    """CTEs over ``leaves(tree, pos, n, digest)``: all nodes, their runs, and a climb from every leaf."""
    return f"""
{name}_nodes(tree, level, pos, n, digest) as (
  select tree, 0, pos, n, digest from {leaves}
  union all
  select tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by pos))
  from {name}_nodes where n > 1 group by tree, level, n, pos // 3),
{name}_runs as (
  select tree, level, pos // 3 as run, list(digest order by pos) as digests from {name}_nodes where n > 1 group by 1, 2, 3),
{name}_climb(tree, leaf_pos, level, pos, lefts, rights) as (
  select tree, pos, 0, pos, []::varchar[], []::varchar[] from {leaves}
  union all
  select tree, leaf_pos, level + 1, c.pos // 3, list_append(lefts, array_to_string(digests[:c.pos % 3], '')),
         list_append(rights, array_to_string(digests[c.pos % 3 + 2:], ''))
  from {name}_climb c join {name}_runs r using (tree, level) where run = c.pos // 3),
{name}_paths as (
  select tree, leaf_pos as pos, arg_max(lefts, level) as lefts, arg_max(rights, level) as rights from {name}_climb group by 1, 2),
{name}_tops as (select tree, digest from {name}_nodes where n = 1)"""


# CRC-32 by its rule: the polynomial 0xEDB88320, bit by bit for a table of bytes, then byte by byte.
MERKLE = f"""
with recursive bytes as (
  select list(list_reduce([i::bigint] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
              order by i) as of_byte
  from range(256) r(i)),
chosen as (
  select d.*, xor(list_reduce([4294967295] || list_transform(range(length(doc_id::varchar)), lambda i: ascii((doc_id::varchar)[i + 1])::bigint),
                              lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 as hit
  from documents d, bytes),
rows_ as (
  select doc_id, coalesce('1' || source, '0') as tree, {_leaf("text")} as digest,
         {_leaf("(case when hit then replace(text, chr(10), '') else text end)")} as found
  from chosen),
leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as pos,
         count(*) over (partition by tree) as n
  from rows_),
{_tree("own", "leaves")},
subroots as (
  select '' as tree, tree as key, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from own_tops),
{_tree("top", "subroots")},
proved as (
  select doc_id, l.digest as leaf, found, s.digest as subroot, r.digest as root, list_concat(p.lefts, q.lefts) as lefts,
         list_concat(p.rights, q.rights) as rights
  from leaves l join own_paths p on p.tree = l.tree and p.pos = l.pos join subroots s on s.key = l.tree
       join top_paths q on q.pos = s.pos join top_tops r on true),
folded as (
  select *, list_reduce([found] || list_transform(range(len(lefts)), lambda i: lefts[i + 1] || chr(0) || rights[i + 1]),
                        lambda now, pair: sha256(split_part(pair, chr(0), 1) || now || split_part(pair, chr(0), 2))) as folded_root
  from proved)
select doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(range(len(lefts)), lambda i: lefts[i + 1] || rights[i + 1]), '')) as proof_sha256,
       folded_root, folded_root = root as verified
from folded
"""


REPEATS = r"""
with w as (
  select row_number() over () as row_id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
grams as (
  select row_id, doc_id, i, array_to_string(words[i:i + 12], ' ') as gram
  from (select *, unnest(generate_series(1, len(words) - 12)) as i from w where doc_id is not null)),
least as (select gram, min(doc_id) as first_id from grams group by 1),
gone as (
  select distinct row_id, i + k as i from grams join least using (gram), range(13) r(k) where first_id < doc_id),
kept as (
  select row_id, string_agg(word, ' ' order by i) as text, count(*) as n
  from (select row_id, unnest(words) as word, generate_subscripts(words, 1) as i from w) anti join gone using (row_id, i)
  group by 1)
select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from w left join kept using (row_id)
"""
