"""SQL over the given tables for operators 11 and 13."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``text``, bit by bit."""
    digit = f"instr('0123456789ABCDEF', substr(hex({text}), {{}}, 1))::bigint - 1"
    high, low = digit.format("(2 * i - 1)::int"), digit.format("(2 * i)::int")
    return f"""xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(
      range(1, strlen({text}) + 1), lambda i: ({high}) * 16 + {low})),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k:
        case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""


def _part(column: str) -> str:
    return f"case when {column} is null then '-' else strlen({column}::varchar) || ':' || {column} end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_part, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _levels(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (k, idx, n, h), and what stands beside each."""
    return f"""{name}(k, lvl, idx, n, h) as (
  select k, 0, idx, n, h from {leaves}
  union all
  select k, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' order by idx))
  from {name} where n > 1 group by k, lvl, idx // 16, n),
{name}_beside as (
  select a.k, a.lvl, a.idx,
    coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as l,
    coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as r
  from {name} a join {name} b on a.k = b.k and a.lvl = b.lvl and a.idx // 16 = b.idx // 16
  where a.n > 1 group by all)"""


OP11_SQL = f"""
with recursive rows_of as (
  select *, case when source is null then '' else '=' || source end as k, {_leaf('text')} as h,
    case when {crc32('doc_id::varchar')} % 5 = 0 then {_leaf(lowered('text'))} end as changed
  from documents),
leaves as (
  select *, row_number() over (partition by k order by doc_id nulls first, h) - 1 as idx,
    count(*) over (partition by k) as n from rows_of),
{_levels('tree', 'leaves')},
tops as (
  select '' as k, k as source_key, h, row_number() over (order by k) - 1 as idx, count(*) over () as n
  from tree where n = 1),
{_levels('top', 'tops')},
depth as (select k, max(lvl) as levels from tree group by k),
steps as (
  select a.k, a.idx, s.lvl as step, s.l, s.r
  from leaves a join tree_beside s on s.k = a.k and s.idx = a.idx // power(16, s.lvl)::bigint
  union all
  select a.k, a.idx, d.levels + s.lvl, s.l, s.r
  from leaves a join depth d using (k) join tops t on t.source_key = a.k
  join top_beside s on s.idx = t.idx // power(16, s.lvl)::bigint),
folds(k, idx, step, h) as (
  select k, idx, 0::bigint, coalesce(changed, h) from leaves
  union all
  select f.k, f.idx, f.step + 1, sha256(s.l || f.h || s.r)
  from folds f join steps s on s.k = f.k and s.idx = f.idx and s.step = f.step),
ends as (select k, idx, arg_max(h, step) as folded_root from folds group by all),
proofs as (select k, idx, string_agg(l || r, '' order by step) as proof from steps group by all)
select doc_id, a.h as leaf, subroot, (select h from top where n = 1) as root,
  sha256(coalesce(proof, '')) as proof_sha256, folded_root,
  folded_root = (select h from top where n = 1) as verified
from leaves a join (select source_key as k, h as subroot from tops) using (k)
join ends using (k, idx) left join proofs using (k, idx)
"""

OP13_SQL = f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all({lowered('text')}, '[a-zÀ-ÿ]{{6,}}')) as run from documents),
counted as (
  select run, coalesce(doc_id::varchar, '') || ':' || run as marked, count(*) as times
  from runs group by all),
hashed as (select run, times, {crc32('marked')} as h from counted),
edited as (
  select times, case when h % 199 = 0
    then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
    else run end as word from hashed),
words as (
  select word, sum(times)::bigint as n from edited where length(word) >= 6
  group by word having sum(times) >= 5),
places as (select word, n, unnest(range(1, length(word) + 1))::int as i from words),
less as (
  select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as rest from places),
holes as (
  select word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as hole from places),
near as (
  select a.word, a.n, b.word as other, b.n as other_n
  from holes a join holes b on a.hole = b.hole and a.word <> b.word
  union all select a.word, a.n, b.word, b.n from less a join words b on a.rest = b.word
  union all select b.word, b.n, a.word, a.n from less a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other,
    max(other_n) as other_n from near group by word),
forms as (
  select words.word, words.n, coalesce(n_near, 0) as n_near,
    case when other_n >= 5 * words.n then other end as form,
    case when other_n >= 5 * words.n then other_n end as form_n
  from words left join best using (word)),
chain(word, root) as (
  select word, word from forms
  union all select chain.word, forms.form from chain join forms on forms.word = chain.root
  where forms.form is not null)
select forms.*, chain.root from forms join chain using (word)
where chain.root in (select word from forms where form is null)
"""
