"""SQL for those queries of this package that SQL can express."""

from tidemark.llm.licences import NOTICES


def _words(text):
    return _WORDS.replace("coalesce(text, '')", f"coalesce({text}, '')")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_QUOTE = chr(39)
_NOTICES = ", ".join(f"({i}, '{a}', '{b.replace(_QUOTE, 2 * _QUOTE)}')" for i, (a, b) in enumerate(NOTICES))

ORACLES = {
    "op5_decontamination": rf"""
with items as (select item_id, w, least(len(w), 10) as size from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
windows as (select distinct item_id, size, array_to_string(w[p:p + size - 1], ' ') as key
            from (select *, unnest(range(1, len(w) - size + 2)) as p from items)),
docs as (select doc_id, {_WORDS} as w from documents),
sized as (select distinct size from windows),
own as (select doc_id, s.size, unnest(range(1, len(w) - s.size + 2)) as p, w from docs, sized s where len(w) >= s.size),
hits as (select doc_id, p, o.size, item_id from (select doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') as key from own) o
         join windows using (size, key)),
hit_words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + size)) as q from hits) group by 1),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
          from hits group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hit_words using (doc_id) left join found using (doc_id)""",
    "op9_repeats": r"""
with tiles as (select doc_id, generate_subscripts(u, 1) as nth, unnest(u) as unit
               from (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?]+[ \t\n\r\f]+|[\x{3002}\x{FF01}\x{FF1F}]+[ \t\n\r\f]*|\n[ \t\n\r\f]*)', '\1' || chr(1), 'g'), chr(1)),
                                                lambda x: x <> '') as u from documents)),
placed as (select *, sum(length(unit)) over (partition by doc_id order by nth) - length(unit) as start,
                  trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f]+', ' ', 'g'), ' ') as form
           from tiles),
ranked as (select *, form <> '' and len(string_split(form, ' ')) + len(regexp_extract_all(form, '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]{2}')) >= 5
                     and row_number() over (partition by form order by doc_id, nth) > 1 as gone from placed)
select d.doc_id, cast(coalesce(n_units, 0) as bigint) as n_units, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       coalesce(removed, '') as removed, case when d.text is null then null else coalesce(kept, '') end as text
from documents d left join (
  select doc_id, count(*) as n_units, count(*) filter (gone) as n_removed,
         string_agg(cast(start as bigint) || ':' || cast(start + length(unit) as bigint), ',' order by nth) filter (gone) as removed,
         string_agg(unit, '' order by nth) filter (not gone) as kept
  from ranked group by 1) using (doc_id)""",
    "op8_licences": rf"""
with notices(template, license, notice) as (values {_NOTICES}),
own_terms as (select template, license, term, count(*) as tf from (select template, license, unnest({_words("notice")}) as term from notices) group by all),
files as (select row_number() over () as f, doc_id, source || '/' || lang || '/' || doc_id as path,
                 regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'copyright[ ]{{0,3}}(\(c\))?[ ]{{0,3}}[0-9][^.\n]*[.]?', ' ', 'g') as t
          from documents),
placed as (select *, regexp_replace(path, '/?[^/]*$', '') as dir, regexp_split_to_array(t, '\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n') as b from files),
parts as (select f, 0 as kind, generate_subscripts(l, 1) as nth, unnest(l) as part from (select f, string_split(t, chr(10)) as l from files)
          union all select * from (select f, 1, generate_subscripts(b, 1), unnest(b) as part from placed) where contains(trim(part, chr(10)), chr(10))
          union all select f, 2, 1, t from placed where len(b) > 1),
units as (select f, kind, nth, {_words("part")} as w from parts),
held as (select *, list_intersect(list_distinct(w), (select list(distinct term) from own_terms)) as h from units),
size as (select count(*)::DOUBLE as n_lines from units where kind = 0),
seen as (select term, count(*) as df from (select unnest(h) as term from held where kind = 0) group by 1),
idf as (select term, ln((n_lines + 1) / (coalesce(df, 0) + 1)) as idf
        from (select distinct term from own_terms) left join seen using (term), size),
vectors as (select template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by template)) as v
            from own_terms join idf using (term)),
maybe as (select f, kind, nth, len(w) as n, unnest(w) as term from held where len(w) > 0 and len(h) * 2 >= len(list_distinct(w))),
weighed as (select f, kind, nth, n, term, count(*) * coalesce(any_value(idf), (select ln(n_lines + 1) from size)) as x
            from maybe left join idf using (term) group by all),
norms as (select f, kind, nth, sqrt(sum(x * x)) as norm from weighed group by all),
cosines as (select f, kind, nth, n, license, round(dot / norm, 6) as cosine
            from (select f, kind, nth, n, template, license, sum(x * v) as dot from weighed join vectors using (term) group by all)
            join norms using (f, kind, nth)),
best as (select f, kind, nth, n, min((-cosine, license)) as b from cosines where cosine >= 0.8 group by all),
own as (select f, min((b[1], kind, nth, b[2]))[4] as own,
               greatest(coalesce(sum(n) filter (kind = 0), 0), coalesce(sum(n) filter (kind = 1), 0), coalesce(sum(n) filter (kind = 2), 0)) as licensed
        from best group by 1),
counted as (select f, count(*) as n_lines, sum(len(w)) as n_words from units where kind = 0 group by 1),
dirs as (select dir as up, min((-files, own))[2] as dir_license
         from (select dir, own, count(*) as files from placed join own using (f) join counted using (f)
               where licensed >= 0.5 * n_words or regexp_matches(path, '(^|/)(?i:licen[sc]e|copying)([.][^/]*)?$') group by all) group by 1),
above as (select dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') as up
          from (select dir, unnest(range(0, len(string_split(dir, '/')) + 1)) as depth from (select distinct dir from placed))),
near as (select dir, max((depth, dir_license))[2] as inherited from above join dirs using (up) group by 1)
select p.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, own, case when own is null then inherited end as inherited,
       coalesce(own, inherited) as license
from placed p left join counted using (f) left join own using (f) left join near using (dir)""",
    "op11_infill": r"""
with hashed as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h,
                       string_split(coalesce(text, ''), chr(10)) as pieces from documents),
drawn as (select *, cast(len(pieces) as bigint) - case when pieces[-1] = '' then 1 else 0 end as n,
                 [('0x' || substr(h, 8 * k + 1, 8))::bigint for k in range(4)] as d from hashed),
placed as (select *, least(d[1] % (n + 1), d[2] % (n + 1)) as lo, greatest(d[1] % (n + 1), d[2] % (n + 1)) as hi,
                  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain'
                       when d[4] % 100 < 50 then 'spm' else 'psm' end as form from drawn),
sized as (select *, case when lo >= len(pieces) then length(text) else list_sum([length(x) + 1 for x in pieces[1:lo]]) end as a,
                 case when hi >= len(pieces) then length(text) else list_sum([length(x) + 1 for x in pieces[1:hi]]) end as b from placed),
cut as (select *, cast(coalesce(a, 0) as bigint) as a_, cast(coalesce(b, 0) as bigint) as b_ from sized),
parts as (select *, substr(text, 1, a_) as p, substr(text, a_ + 1, b_ - a_) as m, substr(text, b_ + 1) as s from cut)
select doc_id, n, form, case when form <> 'plain' then a_ end as prefix_chars, case when form <> 'plain' then b_ - a_ end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from parts""",
    "op12_variants": r"""
with recursive crcs as (select list(c order by k) as t from (
  select k, list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, one: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from (select unnest(range(256)) as k))),
runs as (select doc_id, run, count(*) as k from (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run
  from documents) group by all having length(run) >= 5),
keyed as (select *, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from runs),
hashed as (select run, k, xor(list_reduce(list_concat([4294967295::bigint], [('0x' || substr(x, 2 * i - 1, 2))::bigint for i in range(1, length(x) // 2 + 1)]),
                                          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from keyed, crcs),
spelt as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from hashed),
vocab as materialized (select word, cast(sum(k) as bigint) as n from spelt where length(word) >= 5 group by 1 having sum(k) >= 3),
gaps as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest
                      from (select *, unnest(range(1, length(word) + 1)) as i from vocab)),
pairs as (select a.word, a.n, b.word as near, b.n as near_n from gaps a join gaps b using (i, rest) where a.word <> b.word
          union select g.word, g.n, v.word, v.n from gaps g join vocab v on v.word = g.rest
          union select v.word, v.n, g.word, g.n from gaps g join vocab v on v.word = g.rest),
best as (select word, count(*) as n_near, min((-near_n, near)) as b from pairs group by 1),
named as materialized (select word, n, coalesce(n_near, 0) as n_near, case when -b[1] >= 2 * n then b[2] end as form,
                              case when -b[1] >= 2 * n then cast(-b[1] as bigint) end as form_n from vocab left join best using (word)),
climb as (select word, word as root, form as up from named
          union all select c.word, c.up, f.form from climb c join named f on f.word = c.up)
select n.word, n.form, c.root, n.n, n.n_near, n.form_n from named n join climb c on c.word = n.word and c.up is null""",
    "op13_copies": r"""
with plain as (select doc_id, coalesce(text, '') as original, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as content from documents),
ranked as (select *, row_number() over w as place, first_value(doc_id) over w as keep_id, count(*) over (partition by content) as group_size
           from plain window w as (partition by content order by length(original) desc, doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(content) as text_sha256 from ranked""",
}
