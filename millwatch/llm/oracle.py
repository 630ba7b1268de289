"""DuckDB SQL of the queries that SQL can express on whole tables.

Learned models (3, 4, 5, 7) and the pipeline have none; the tests hold them against
labels and brute force.  So do those for the byte strings (10): a row per byte of
every text is more than SQL takes.
"""

_BLANK = r"[^\x20\x09-\x0D]+"
_HALF_OPEN_HASH = "cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint)"

#: Words of a text by position, from 1; no rows for a text without words.
_WORDS = f"""
words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') as w from documents)"""

_PLAIN = r"""
plain as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
asked as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark)"""

DECONTAMINATION = f"""
with {_PLAIN},
phrases as (
  select distinct item, list_slice(w, i, i + 9) as phrase, least(len(w), 10) as n
  from asked, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as r(i) where len(w) > 0),
sizes as (select distinct n from phrases),
places as (
  select doc_id, i, n, list_slice(w, i, i + n - 1) as phrase
  from plain, sizes, unnest(range(1, len(w) - n + 2)) as r(i) where len(w) >= n),
found as (select p.doc_id, p.i, p.n, f.item from places p join phrases f on p.phrase = f.phrase),
hits as (
  select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from found) group by doc_id),
listed as (
  select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item) filter (item is not null)), ',') as items
  from found group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from plain left join hits using (doc_id) left join listed using (doc_id)"""

JACCARD = f"""
with recursive {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') as s
  from words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as r(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b where 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach as (
  select doc_id as a, doc_id as b from documents
  union
  select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, cast(coalesce(any_value(s.n), 0) as bigint) as n_shingles, min(r.b) as component_id
from documents d left join sizes s using (doc_id) join reach r on r.a = d.doc_id group by d.doc_id"""

LINES = r"""
with lines as (
  select doc_id, source, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') as full_line
  from (select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as i from documents)),
spread as (
  select trim(line, ' ') as line, count(distinct coalesce(source, chr(0))) as sites, min(doc_id) as owner
  from lines where full_line group by 1),
kept as (
  select l.*, not (l.full_line and s.sites >= 10 and s.owner <> l.doc_id) as stays
  from lines l left join spread s on l.full_line and trim(l.line, ' ') = s.line)
select doc_id, cast(count(*) filter (full_line) as bigint) as n_lines, cast(count(*) filter (not coalesce(stays, true)) as bigint) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (coalesce(stays, true)), '')) as kept_sha256
from kept group by doc_id"""

PASSAGES = f"""
with {_WORDS},
windows as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') as s
  from words, unnest(range(1, len(w) - 18)) as r(i) where len(w) >= 20),
ranked as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as nth from windows),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from ranked where nth > 1),
each as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from words),
kept as (
  select e.doc_id, count(*) as n_words, count(g.j) as n_removed, string_agg(e.word, ' ' order by e.j) filter (g.j is null) as kept
  from each e left join gone g on g.doc_id = e.doc_id and g.j = e.j group by e.doc_id)
select d.doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from documents d left join kept using (doc_id)"""

MIXING = f"""
with sized as (
  select doc_id, source, {_HALF_OPEN_HASH} as hash,
         cast(len(regexp_extract_all(coalesce(text, ''), '{_BLANK}')) as bigint) as size from documents),
sources as (
  select source, cast(sum(size) as bigint) as s, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from sized group by source),
ordered as (
  select *, cast(sum(s) over () as bigint)
            - coalesce(cast(sum(3 * s) over (order by 3 * s / w, source nulls last rows between unbounded preceding and 1 preceding) as bigint), 0) as rest,
         sum(w) over (order by 3 * s / w, source nulls last rows between current row and unbounded following) as weights from sources),
capped as (select *, 3 * s * weights <= rest * w as full_ from ordered),
levels as (
  select *, cast(sum(s) over () - coalesce(sum(3 * s) filter (full_) over (), 0) as bigint) as spare,
         cast(sum(w) filter (not full_) over () as bigint) as free from capped),
targets as (
  select source, s as source_size,
         case when full_ then cast(3 * s as double) else cast(w as double) * cast(spare as double) / cast(free as double) end as target from levels),
budgets as (
  select *, cast(round(target) as bigint) as budget, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as passes
  from targets),
runs as (
  select source, hash, sum(size) as leaf, sum(sum(size)) over (partition by source order by hash) as upto from sized group by source, hash),
taken as (
  select r.source, r.hash,
         r.upto <= b.budget - b.passes * b.source_size
         or (r.upto - r.leaf <= b.budget - b.passes * b.source_size and 2 * (b.budget - b.passes * b.source_size - r.upto + r.leaf) > r.leaf) as once
  from runs r join budgets b on r.source is not distinct from b.source)
select z.doc_id, z.size, b.source_size, b.target, cast(z.size * (b.passes + case when t.once then 1 else 0 end) as bigint) as taken
from sized z join budgets b on z.source is not distinct from b.source
join taken t on t.hash = z.hash and t.source is not distinct from z.source"""

SQL = {
    "op1_decontamination": DECONTAMINATION,
    "op2_ngram_jaccard": JACCARD,
    "op6_line_dedup": LINES,
    "op8_substring_dedup": PASSAGES,
    "op9_mixing": MIXING,
}
