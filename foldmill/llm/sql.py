"""DuckDB SQL for the operators that SQL can express."""

OP7 = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    coalesce(doc_id::varchar, 'null' || md5(text), 'null') as draw from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), placed as (
  select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight from sources
), ratios as (
  select *, 2.0::double * source_size as full_size, 2.0::double * source_size / weight as ratio from placed
), levels as (
  select *, (1.5::double * sum(source_size) over ()
    - coalesce(sum(full_size) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0.0))
    / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as lvl
  from ratios
), final as (
  select *, max(case when lvl <= ratio then lvl end) over () as top from levels
), goals as (
  select source, source_size, case when top is null or ratio <= top then full_size else top * weight end as target from final
), whole as (
  select *, round(target)::bigint as words, case when source_size = 0 then 0 else round(target)::bigint // source_size end as epochs from goals
), keyed as (
  select s.*, pow((('0x' || substr(md5(s.draw), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double,
    1.0::double / case when q.least >= 1 then 1.0 when q.least < 1 then 0.5 else 0.75 end) as key
  from sized s left join (select doc_id, min(quality) as least from labels group by doc_id) q on s.doc_id = q.doc_id
), front as (
  select *, coalesce(sum(size) over (partition by source order by key desc, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as ahead from keyed
)
select f.doc_id, f.size, w.source_size, w.target,
  (w.epochs * f.size + greatest(0, least(f.size, w.words - w.epochs * w.source_size - f.ahead)))::bigint as taken
from front f join whole w on f.source is not distinct from w.source
"""

#: Turns without tool calls, as in the tables; arguments of calls in canonical JSON are beyond SQL.
OP3 = r"""
select conv_id, row_number() over (partition by conv_id order by turn nulls last) - 1 as position, turn, coalesce(role, '') as role,
  0::bigint as n_calls, 0::bigint as n_valid, null::boolean as linked,
  '{"content":' || to_json(coalesce(text, ''))::varchar || ',"role":' || to_json(coalesce(role, ''))::varchar || '}' as message
from conversations
"""

OP6 = r"""
with texts as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
  select doc_id, place, array_to_string(words[place:place + 12], ' ') as w
  from (select doc_id, words, unnest(range(1, len(words) - 11)) as place from texts)
), least as (
  select w, min(doc_id) as first from windows group by w
), covered as (
  select distinct doc_id, place + k as place
  from (select v.doc_id, v.place from windows v join least l on v.w = l.w and l.first < v.doc_id), range(13) as r(k)
), spread as (
  select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from texts
), kept as (
  select s.doc_id, count(c.place) as n_removed, string_agg(s.word, ' ' order by s.place) filter (where c.place is null) as words
  from spread s left join covered c on s.doc_id = c.doc_id and s.place = c.place group by s.doc_id
)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.words, '')) as kept_sha256
from texts t left join kept k on t.doc_id = k.doc_id
"""

OP9 = r"""
with lines as (
  select doc_id, generate_subscripts(parts, 1) as line, unnest(parts) as raw from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)
), worded as (
  select doc_id, line, list_sort(list_distinct(regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) as words from lines
), sets as (
  select words, len(words) as n, min((doc_id, line)) as first, row_number() over () as id from worded where len(words) > 0 group by words
), counts as (
  select word, count(*) as c from (select unnest(words) as word from sets) group by word
), prefixes as (
  select id, n, word, row_number() over (partition by id order by c, word) as place from (select id, n, unnest(words) as word from sets) join counts using (word)
), entries as (
  select id, n, word from prefixes where place <= n - ((8 * n + 9) // 10) + 1
), pairs as (
  select distinct a.id as a, b.id as b from entries a join entries b on a.word = b.word and a.id <> b.id and 10 * a.n >= 8 * b.n and 10 * b.n >= 8 * a.n
), links as (
  select distinct p.a from pairs p join sets r on r.id = p.a join sets s on s.id = p.b
  where s.first < r.first and 10 * len(list_intersect(r.words, s.words)) >= 8 * (r.n + s.n - len(list_intersect(r.words, s.words)))
), best as (
  select a from links
), limits as (
  select s.words, s.first as lim, (b.a is not null)::int as linked from sets s left join best b on b.a = s.id
), marked as (
  select w.doc_id, w.line, l.raw, w.words, m.lim, coalesce(m.linked, 0) as linked, coalesce(m.linked = 1 or m.lim < (w.doc_id, w.line), false) as gone
  from worded w join lines l on w.doc_id = l.doc_id and w.line = l.line left join limits m on m.words = w.words
), linked as (
  select doc_id, count(*) as n from (select distinct doc_id, words from marked where linked = 1) group by doc_id
)
select m.doc_id, count(*) filter (where len(words) > 0)::bigint as n_lines, count(*) filter (where gone)::bigint as n_removed, coalesce(any_value(k.n), 0)::bigint as n_links,
  least(m.doc_id, coalesce(min(lim[1]), m.doc_id))::bigint as class_id, sha256(coalesce(string_agg(raw, chr(10) order by line) filter (where not gone), '')) as kept_sha256
from marked m left join linked k on k.doc_id = m.doc_id group by m.doc_id
"""
