"""DuckDB texts of the conversation queries, for whole results."""

from __future__ import annotations

# CRC-32 as a fold over bytes; its table follows from the polynomial.
CRC_TABLE = """crc_table as materialized (select list_transform(range(256), lambda n:
  list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, n)) as tab)"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, beside ``crc_table``."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: cast(ascii(ch) as bigint))"
    return (f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)")


PREFIX_TRIE = f"""
with {CRC_TABLE},
turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, md5(octet_length(encode(coalesce(role, '')))::text || ':' || coalesce(role, '') || coalesce(text, ''))) as i
  from conversations where conv_id is not null),
ids as (select distinct conv_id from turns),
h as (select conv_id, {crc32("conv_id::text")} % 9 as h from ids, crc_table),
rebuilt as (
  select h.conv_id, t.i, t.role, t.text from h join turns t on t.conv_id = h.conv_id - h.conv_id % 5 and t.i <= h.h
  union all select h.conv_id, t.i, t.role, t.text from h join turns t on t.conv_id = h.conv_id and t.i > h.h),
placed as (select *, row_number() over (partition by conv_id order by i) as d from rebuilt),
-- A prefix is named by the digest of the digests of its turns.
named as (select conv_id, d, octet_length(encode(text)) as bytes,
  md5(string_agg(md5(octet_length(encode(role))::text || ':' || role || text), ' ') over (partition by conv_id order by d)) as node from placed),
members as (
  select conv_id, d, bytes, node, lag(node, 1, '') over (partition by conv_id order by d) as above from named
  union all select conv_id, 0, 0, '', null from ids),
lengths as (select conv_id, max(d) as n from members group by conv_id),
nodes as (select node, d, any_value(above) as above, min(conv_id) as least, count(*) as n, (count(*) - 1) * any_value(bytes) as own from members group by node, d),
ends as (select m.node, m.d, sha256(string_agg(m.conv_id::text, ',' order by m.conv_id)) as ends from members m join lengths l on l.conv_id = m.conv_id and l.n = m.d group by m.node, m.d),
kids as (select above as node, d - 1 as d, count(*) as k from nodes where d > 0 group by all),
full_ as (select n.*, coalesce(k.k, 0) as k from nodes n left join kids k on k.node = n.node and k.d = n.d),
-- Every node counts for all prefixes of its least conversation up to itself.
sums as (select m.node, m.d, sum(f.own) as saved, sum((f.k = 0)::int) as leaves from full_ f join members m on m.conv_id = f.least and m.d <= f.d group by m.node, m.d)
select f.least as conv_id, f.d::bigint as depth, p.least as parent_conv_id, f.n::bigint as n_convs, f.k::bigint as n_children,
  s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from full_ f join sums s on s.node = f.node and s.d = f.d left join ends e on e.node = f.node and e.d = f.d
left join nodes p on p.node = f.above and p.d = f.d - 1
"""


# A state's best way to the end is one text, its cost in nine digits and then its audit, so ``least`` decides.
_STATES = range(1, 5)  # nothing yet, after system, after user, after assistant
_GIVEN = {1: 3, 2: 3, 3: 4, 4: 3}


def _step(value: str, cost: str, letter: str) -> str:
    return f"lpad((substr({value}, 1, 9)::bigint + {cost})::varchar, 9, '0') || '{letter}' || substr({value}, 10)"


def _inserts(values: str) -> str:
    """The list of values with up to two inserts before each."""
    once = "[" + ", ".join(f"least({values}[{s}], {_step(f'{values}[{_GIVEN[s]}]', '3', 'I')})" for s in _STATES) + "]"
    twice = "[" + ", ".join(f"least(v[{s}], {_step(f'w[{_GIVEN[s]}]', '3', 'I')})" for s in _STATES) + "]"
    return f"list_transform([{once}], lambda w: {twice.replace('v[', values + '[')})[1]"


def _row_options(state: int) -> str:
    kept = {1: (("s", 2), ("u", 3)), 2: (("u", 3),), 3: (("a", 4),), 4: (("u", 3),)}[state]
    keeps = " ".join(f"when '{i}' then {_step(f'v[{to}]', 'late', 'K')}" for i, to in kept)
    stays = f"case when stays then case initial {keeps} end end"
    rerole = f"case when stays then {_step(f'v[{_GIVEN[state]}]', '3 + late', 'R')} end"
    return f"least({_step(f'v[{state}]', '4', 'D')}, {stays}, {rerole})"


_END = "['000000000', '900000000', '900000000', '000000000']"

CONVERSATION_REPAIR = f"""
with recursive {CRC_TABLE},
source as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {crc32("coalesce(conv_id::text, ' ') || ':' || coalesce(turn::text, ' ')")} % 20 as kind from conversations, crc_table),
damaged as (select conv_id, turn, case kind when 4 then 'user' else role end as role,
  case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from source, range(2) as c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) as nth,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown from placed),
faulty as (select *, case when shown = '' then 'blank' when nth > 1 then 'duplicate'
  when right(shown, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault, left(role, 1) as initial from seen),
rows_ as materialized (select *, fault not in ('blank', 'duplicate') as stays, case fault when 'truncated' then 3 else 0 end as late,
  initial || lead(initial) over (partition by conv_id order by i) as pair from faulty),
measures as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
  count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from rows_ group by conv_id),
ways as (
  select conv_id, n + 1 as i, list_transform([{_END}], lambda v: {_inserts("v")})[1] as v from measures
  union all
  select w.conv_id, w.i - 1, list_transform([[{", ".join(f"({_row_options(s)})" for s in _STATES)}]], lambda o: {_inserts("o")})[1]
  from ways w join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i - 1),
best as materialized (select conv_id, substr(v[1], 1, 9)::bigint as cost, substr(v[1], 10) as audit from ways where i = 1),
-- The edits in order: p letters done, i rows read, q the state, line what the last edit wrote.
walk as (
  select conv_id, audit, 0::bigint as p, 0::bigint as i, 1 as q, null::varchar as line from best
  union all
  select w.conv_id, w.audit, w.p + 1, w.i + (letter <> 'I')::int,
    case letter when 'D' then w.q when 'K' then case r.initial when 's' then 2 when 'u' then 3 else 4 end else given end,
    case letter when 'K' then r.role || ':' || r.text when 'R' then written || r.text when 'I' then written end
  from (select *, substr(audit, p + 1, 1) as letter, case q when 3 then 4 else 3 end as given,
          case q when 3 then 'assistant:' else 'user:' end as written from walk where p < length(audit)) w
  left join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1),
texts as (select conv_id, string_agg(line, chr(10) order by p) as text from walk where line is not null group by conv_id)
select o.conv_id, coalesce(m.gaps, 0)::bigint as gaps, coalesce(m.blank, 0)::bigint as blank, coalesce(m.duplicate, 0)::bigint as duplicate,
  coalesce(m.truncated, 0)::bigint as truncated, coalesce(m.illegal, 0)::bigint as illegal, coalesce(b.cost, 0)::bigint as cost,
  coalesce(b.audit, '') as audit, sha256(coalesce(t.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join measures m on m.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id
left join texts t on t.conv_id is not distinct from o.conv_id
"""
