"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op7_line_dedup"] = r"""
with lines as (
    select doc_id, i, t[i] as line, trim(translate(t[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as t from documents), unnest(range(1, len(t) + 1)) as u(i)
), firsts as (
    select key, min(doc_id) as first_doc from lines where length(key) >= 10 group by key having count(distinct doc_id) > 1
), judged as (
    select l.*, f.first_doc is not null and l.doc_id > f.first_doc as gone from lines l left join firsts f on l.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

ORACLES["op6_near_dedup"] = r"""
with recursive words as materialized (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingled as materialized (
    select distinct doc_id, hash(case when len(w) < 5 then w else w[i : i + 4] end) as s from words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as u(i) where len(w) > 0
), sizes as materialized (
    select doc_id, count(*) as n from shingled group by doc_id
), pairs as (
    select a.doc_id as x, b.doc_id as y, count(*) as c from shingled a join shingled b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as materialized (
    select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
), reach(doc_id, root) as (
    select doc_id, doc_id from documents
    union
    select case when l.x = r.doc_id then l.y else l.x end, r.root from reach r join links l on l.x = r.doc_id or l.y = r.doc_id
), least_id as (select doc_id, min(root) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, component_id = d.doc_id as kept
from documents d join least_id using (doc_id) left join sizes using (doc_id)
"""

ORACLES["op2_substring_dedup"] = r"""
with words as materialized (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as materialized (
    select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from words, unnest(range(1, len(w) - 48)) as u(i) where len(w) >= 50
), firsts as (
    select h, min(doc_id) as first_doc from windows group by h
), hits as (
    select doc_id, i from windows join firsts using (h) where first_doc < doc_id
), gone as (
    select distinct doc_id, i + k as i from hits, range(0, 50) as r(k)
), each_word as (
    select doc_id, i, w[i] as word from words, unnest(range(1, len(w) + 1)) as u(i)
), marked as (
    select e.doc_id, e.i, e.word, g.i is not null as removed from each_word e left join gone g on e.doc_id = g.doc_id and e.i = g.i
)
select d.doc_id, count(m.i) as n_words, count(*) filter (removed) as n_removed,
    sha256(coalesce(string_agg(word, ' ' order by m.i) filter (not removed), '')) as kept_sha256
from documents d left join marked m on d.doc_id = m.doc_id group by d.doc_id
"""

ORACLES["op4_suffix_dedup"] = r"""
with texts as materialized (
    select doc_id, hex(encode(coalesce(text, ''))) as x from documents
), pieces as materialized (
    select doc_id, j, substr(x, 800 * j + 1, 1600) as p from texts, unnest(range(0, (len(x) // 2 - 400) // 400 + 1)) as u(j) where len(x) >= 800
), strings as materialized (
    select doc_id, 400 * j + k as i, md5(substr(p, 2 * k + 1, 800)) as h from pieces, unnest(range(0, least(400, len(p) // 2 - 399))) as u(k)
), again as (
    select h from strings group by h having count(*) > 1
), hits as (
    select doc_id, i, i - row_number() over (partition by doc_id order by i) as run from strings where h in (select h from again)
), covers as (
    select doc_id, min(i) as lo, max(i) + 400 as hi from hits group by doc_id, run
), islands as (
    select doc_id, lo, hi, sum(case when lo <= upto then 0 else 1 end) over (partition by doc_id order by lo) as island
    from (select *, coalesce(max(hi) over (partition by doc_id order by lo rows between unbounded preceding and 1 preceding), -1) as upto from covers)
), gone as (
    select doc_id, min(lo) as lo, max(hi) as hi from islands group by doc_id, island
), gaps as (
    select doc_id, lo, hi, lag(hi, 1, 0) over (partition by doc_id order by lo) as since from gone
), kept as (
    select g.doc_id, count(*) as n_spans, sum(hi - lo) as n_removed, max(hi) as upto,
        string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' order by lo) as head
    from gaps g join texts t on t.doc_id = g.doc_id group by g.doc_id
)
select t.doc_id, len(x) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
    sha256(unhex(coalesce(head || substr(x, 2 * upto + 1), x))) as kept_sha256
from texts t left join kept k on k.doc_id = t.doc_id
"""

ORACLES["op1_quality_rules"] = r"""
with words as materialized (
    select doc_id, coalesce('=' || lang, 'null') as s0, coalesce('=' || source, 'null') as s1, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as materialized (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from words, unnest(range(1, len(w) - 1)) as u(i) where len(w) >= 3
), again as (
    select doc_id, k from windows group by doc_id, k having count(*) > 1
), repeats as (
    select doc_id, count(distinct i + j) as n from windows join again using (doc_id, k), range(0, 3) as r(j) group by doc_id
), dup_lines as (
    select doc_id, count(*) as lines, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from words) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), counted as materialized (
    select doc_id, s0, s1, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(d.lines, 0)::bigint as n_lines, coalesce(d.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
    from words left join repeats r using (doc_id) left join dup_lines d using (doc_id)
), measured as materialized (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 100 * word_chars // greatest(n_words, 1) as m_length, 10000 * n_symbols // greatest(word_chars, 1) as m_symbols,
        10000 * n_dup_lines // greatest(n_lines, 1) as m_dup_lines, 10000 * n_repeat_words // greatest(n_words, 1) as m_repeats
    from counted
), long as (
    select s0, s1, unnest([struct_pack(m := 'm_length', v := m_length, size := 0), struct_pack(m := 'm_symbols', v := m_symbols, size := 0), struct_pack(m := 'm_dup_lines', v := m_dup_lines, size := 0), struct_pack(m := 'm_repeats', v := m_repeats, size := 0),
        struct_pack(m := 'n_symbols', v := n_symbols, size := word_chars), struct_pack(m := 'n_dup_lines', v := n_dup_lines, size := n_lines), struct_pack(m := 'n_repeat_words', v := n_repeat_words, size := n_words)], recursive := true) from measured where not base_failed
), bucketed as (
    select s0, s1, m, size, case when v < 32 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) end as b from long
), sketch as (
    select s0, s1, 2 as level, m, b, count(*) as n, sum(size) as size from bucketed group by all union all select s0, null, 1, m, b, count(*), sum(size) from bucketed group by all union all select null, null, 0, m, b, count(*), sum(size) from bucketed group by all
), upto as (
    select *, sum(n) over (partition by s0, s1, level, m order by b) as upto, sum(n) over (partition by s0, s1, level, m) as whole,
        case when b < 32 then b else (b - ((b - 32) // 32) * 32) << ((b - 32) // 32) end as floor_v from sketch
), quartiles as (
    select s0, s1, level, m, max(whole) as n, min(floor_v) filter (upto * 4 >= whole) as q1, min(floor_v) filter (upto * 2 >= whole) as q2,
        min(floor_v) filter (upto * 4 >= whole * 3) as q3, min(floor_v) filter (upto * 10 >= whole * 9) as d9, sum(size) as size, greatest(coalesce(sum(n) filter (b = 0), 0), 1) as without from upto group by all
), fences as (
    select s0, s1, level, m, n, q1 - (q3 - q1) * 3 - q1 // 32 as low,
        case m when 'm_length' then q3 + (q3 - q1) * 3 + q3 // 32 else d9 + (d9 - q2) * 9 + d9 // 32 end as high,
        ln(n::double / without::double) * n::double / greatest(size, 1)::double as rate, ln(n::double / 0.01::double) as bar from quartiles
), chosen as (
    select d.doc_id, f.m, f.low, f.high, f.rate, f.bar, row_number() over (partition by d.doc_id, f.m order by f.level desc) as k
    from measured d join fences f on (f.level = 0 or (f.n >= 200 and f.s0 = d.s0 and (f.level = 1 or f.s1 = d.s1)))
), held as (
    select d.*, c.m, c.low, c.high, case c.m when 'm_length' then m_length when 'm_symbols' then m_symbols when 'm_dup_lines' then m_dup_lines else m_repeats end as share,
        case c.m when 'm_symbols' then n_symbols when 'm_dup_lines' then n_dup_lines when 'm_repeats' then n_repeat_words // 6 end::double as events,
        case c.m when 'm_symbols' then word_chars when 'm_dup_lines' then n_lines when 'm_repeats' then n_words end::double * r.rate as mean, r.bar
    from measured d join chosen c on c.doc_id = d.doc_id and c.k = 1 and c.m like 'm_%'
    left join chosen r on r.doc_id = d.doc_id and r.k = 1 and r.m = case c.m when 'm_symbols' then 'n_symbols' when 'm_dup_lines' then 'n_dup_lines' when 'm_repeats' then 'n_repeat_words' end
), odd as (
    select distinct doc_id from held where case when m = 'm_length' then share > high or share < low
        else share > high and events > mean and round(events * ln(events / nullif(mean, 0)) - events + mean - bar, 6) > 0 end
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from odd) as kept from measured
"""

ORACLES["op5_sharding"] = r"""
with recursive remainders as materialized (
    select list(c order by n) as t from (select n, list_reduce(list_prepend(n, range(0, 8)), lambda x, k: case when x % 2 = 1 then xor(3988292384, x >> 1) else x >> 1 end) as c from range(0, 256) r(n))
), rows_ as materialized (
    select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size,
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode(coalesce(text, '')))), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as text_crc32,
        md5(coalesce(cast(doc_id as varchar), 'null:' || coalesce(text, ''))) as h from (select *, string_split(hex(encode(coalesce(text, ''))), '') as x from documents), remainders
), docs as materialized (
    select *, ('0x' || substr(h, 1, 4))::integer as place from rows_
), nodes as materialized (
    select ('0x' || substr(md5('node-' || s || '-' || v), 1, 4))::integer as vplace, min(s) as home from range(0, 16) a(s), range(0, 32) b(v) group by 1
), places as materialized (
    select p.place, coalesce(n.vplace, (select min(vplace) from nodes)) as vplace from (select range::integer as place from range(0, 65536)) p asof left join nodes n on p.place <= n.vplace
), counts as materialized (
    select p.place, p.vplace, n.home, coalesce(c.n, 0) as n from places p join nodes n using (vplace) left join (select place, count(*) as n from docs group by place) c using (place)
), bounded as materialized (
    select *, t.total // 16 + case when home < t.total % 16 then 1 else 0 end as bound, coalesce(sum(n) over (partition by home order by place rows between unbounded preceding and 1 preceding), 0) as before
    from counts, (select sum(n)::bigint as total from counts) t
), overs as materialized (
    select *, greatest(0, least(n, before + n - bound))::bigint as over from bounded
), by_node as materialized (
    select vplace, home, bound, sum(n)::bigint as n, sum(over)::bigint as over, row_number() over (order by vplace) as i, count(*) over () as m from overs group by vplace, home, bound
), homes as (
    select s, coalesce(greatest(0, max(bound) - sum(n)), 0)::bigint as room, coalesce(least(max(bound), sum(n)), 0)::bigint as kept from range(0, 16) r(s) left join by_node on home = s group by s
), laps as materialized (
    select i, home, over from by_node union all select i + m, home, 0 from by_node
), walk as (
    select 0::bigint as i, 0::bigint as carried, 0::bigint as placed, (select list(room order by s) from homes) as rooms, (select list(kept order by s) from homes) as slots, null::integer as shard, null::bigint as lo, null::bigint as hi, null::bigint as slot
    union all
    select l.i, w.carried + l.over - x.a, w.placed + x.a, list_transform(w.rooms, lambda r, j: case when j = l.home + 1 then r - x.a else r end), list_transform(w.slots, lambda r, j: case when j = l.home + 1 then r + x.a else r end), l.home, w.placed, w.placed + x.a, w.slots[l.home + 1]
    from walk w join laps l on l.i = w.i + 1, lateral (select least(w.carried + l.over, w.rooms[l.home + 1]) as a) x
), ranked as materialized (
    select *, row_number() over (partition by place order by h, size, text_crc32) - 1 as r from docs
), dealt as (
    select place, home, before, n - over as stay, sum(over) over (order by vplace, before, place rows unbounded preceding) - over as over_at from overs
), put as (
    select doc_id, size, text_crc32, home, before, r, case when r >= stay then over_at + r - stay end as g from ranked join dealt using (place)
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, coalesce(w.shard, home)::integer as shard, coalesce(w.slot + g - w.lo, before + r)::bigint as slot, null::integer as grown_shard
from put left join walk w on g >= w.lo and g < w.hi
"""

_LAST = "right(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"


def _before(state: str, kept: str, follows: str, due: str) -> str:
    """The cheapest edit of a row in a state, with all that follows it."""
    keep = f"case when ok and role[1:1] in ({kept}) then struct_pack(c := more + {follows}.c, a := 'K' || {follows}.a) end"
    if state == "v0":
        keep = f"case when ok and role[1:1] = 's' then struct_pack(c := more + vs.c, a := 'K' || vs.a) when ok and role[1:1] = 'u' then struct_pack(c := more + vu.c, a := 'K' || vu.a) end"
    return f"list_min([struct_pack(c := 2 + {state}.c, a := 'D' || {state}.a), {keep}, case when ok then struct_pack(c := more + 1 + {due}.c, a := 'R' || {due}.a) end])"


def _or_insert(own: str, *others: str) -> str:
    return f"list_min([{own}, " + ", ".join(f"struct_pack(c := {5 * n} + {o}.c, a := '{'I' * n}' || {o}.a)" for n, o in enumerate(others, 1)) + "])"


ORACLES["op12_conversation_repair"] = f"""
with recursive remainders as materialized (
    select list(c order by n) as t from (select n, list_reduce(list_prepend(n, range(0, 8)), lambda x, k: case when x % 2 = 1 then xor(3988292384, x >> 1) else x >> 1 end) as c from range(0, 256) r(n))
), keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), dealt as materialized (
    select conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda s: unicode(s)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 as f from keyed, remainders
), hurt as materialized (
    select conv_id, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
    from dealt, range(0, case f when 3 then 2 else 1 end) where f <> 0
), ordered as materialized (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n,
        row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 as again, {_LAST} as final from hurt
), faults as materialized (
    select *, final <> '' and not again as ok, case when final <> '' and not again and final not in ('.', '!', '?') then 5 else 0 end as more,
        lag(role[1:1]) over (partition by conv_id order by i) || role[1:1] not in ('su', 'ua', 'au') as off from ordered
), paths as (
    select distinct conv_id, n as i, struct_pack(c := 0::bigint, a := '') as v0, struct_pack(c := 10::bigint, a := 'II') as vs, struct_pack(c := 5::bigint, a := 'I') as vu, struct_pack(c := 0::bigint, a := '') as va from ordered
    union all
    select conv_id, i - 1, {_or_insert('b0', 'bu', 'ba')}, {_or_insert('bs', 'bu', 'ba')}, {_or_insert('bu', 'ba')}, {_or_insert('ba', 'bu')} from (
        select p.conv_id, p.i, {_before('v0', "'s'", 'vs', 'vu')} as b0, {_before('vs', "'u'", 'vu', 'vu')} as bs, {_before('vu', "'a'", 'va', 'va')} as bu, {_before('va', "'u'", 'vu', 'vu')} as ba
        from paths p join faults f on f.conv_id is not distinct from p.conv_id and f.i = p.i)
), cheapest as (
    select conv_id, v0.c as cost, v0.a as audit from paths where i = 0
), letters as (
    select conv_id, j, audit[j:j] as e, count(*) filter (where audit[j:j] <> 'I') over w as i, count(*) filter (where audit[j:j] <> 'D') over w as o from cheapest, range(1, length(audit) + 1) r(j)
    window w as (partition by conv_id order by j)
), said as (
    select l.conv_id, l.o, l.e, f.role, case l.e when 'I' then '' else f.text end as text, bool_or(l.o = 1 and l.e = 'K' and f.role[1:1] = 's') over (partition by l.conv_id) as s
    from letters l left join faults f on f.conv_id is not distinct from l.conv_id and f.i = l.i and l.e <> 'I' where l.e <> 'D'
), repaired as (
    select conv_id, sha256(string_agg(case when e = 'K' then role when (o % 2 = 1) <> s then 'user' else 'assistant' end || ':' || text, chr(10) order by o)) as h from said group by conv_id
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where final = '') as blank, count(*) filter (where final <> '' and again) as duplicate,
        count(*) filter (where more = 5) as truncated, count(*) filter (where off) as illegal from faults group by conv_id
)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
    coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a left join counts c on c.conv_id is not distinct from a.conv_id
left join cheapest p on p.conv_id is not distinct from a.conv_id left join repaired r on r.conv_id is not distinct from a.conv_id
"""

ORACLES["op13_source_divergence"] = r"""
with docs as materialized (
    select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), words as materialized (
    select d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as materialized (
    select lang, term, count(*) as total from words group by lang, term having count(distinct d) >= 30
), groups as materialized (
    select distinct lang, source from docs
), counted as materialized (
    select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all
), sizes as materialized (
    select g.lang, g.source, coalesce(v, 0)::hugeint as v, coalesce(all_n, 0)::hugeint as all_n, coalesce(own, 0)::hugeint as own from groups g
    left join (select lang, count(*) as v, sum(total) as all_n from kept group by lang) using (lang) left join (select lang, source, sum(n) as own from counted group by all) using (lang, source)
), prices as materialized (
    select s.lang, s.source, k.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (own + 5 * v) as p, 1 + (1000000000::hugeint * (k.total + 5)) // (all_n + 5 * v) as q
    from sizes s join kept k using (lang) left join counted using (lang, source, term)
), valued as (
    select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value from groups g join groups h on g.lang = h.lang and g.source <> h.source
    left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from prices a join prices b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x on x.lang = g.lang and x.source = g.source and x.item = h.source
    union all
    select lang, source, 'term', term, p - q from prices where n > 0 and p > q
)
select lang, source, part, item, value::bigint as value, rank::integer as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from valued) where part = 'pair' or rank <= 50
"""
