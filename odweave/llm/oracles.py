"""DuckDB SQL for the queries that SQL can express: what each one's rows must be."""

from __future__ import annotations

from odweave.llm.chat import INSTRUCT, Template
from odweave.llm.quality import WORD, sql as quality_sql

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def jaccard_sql(words: int, percent: int) -> str:
    """All linked pairs by a join on shingles, and the smallest document that each one reaches."""
    return f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + {words - 1}], ' ') as s
  from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - {words - 2}))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= {percent} * (x.n + y.n - o)),
r as (select doc_id, doc_id as root from documents union select l.b, r.root from r join l on l.a = r.doc_id where r.root < l.b),
c as (select doc_id, min(root) as component_id from r group by doc_id),
k as (select a, count(*) as n from l group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, coalesce(k.n, 0)::bigint as n_links
from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id left join k on k.a = d.doc_id"""


def warc_sql() -> str:
    groups = [f"('0x' || substr(h, {5 * k + 1}, 5))::bigint" for k in range(8)]
    letters = [f"substr('{_BASE32}', ({g} >> {shift} & 31)::int + 1, 1)" for g in groups for shift in (15, 10, 5, 0)]
    return f"""
with p as (select page_id, coalesce(html, '') as x from pages),
f as (select page_id, octet_length(encode(x))::bigint as payload_bytes, sha1(x) as h, min(page_id) over (partition by x) as first from p)
select page_id, payload_bytes, {' || '.join(letters)} as payload_digest,
case when first = page_id then 'response' else 'revisit' end as record_type,
case when first <> page_id then first end as refers_to, case when first = page_id then true end as checked from f"""


def chat_sql(hostile: str, template: Template = INSTRUCT) -> str:
    """Conversations with unique turn numbers, written by the template."""
    escaped = "replace(text, '␛', '␛0')"
    for control in template.controls:
        escaped = f"replace({escaped}, {_text(control)}, {_text(control[0] + '␛1' + control[1:])})"
    cases = " ".join(f"when {_text(name)} then {len(f.opening) + len(f.closing)}" for name, f in template.roles.items())
    other = f"length(role) + {sum(map(len, (*template.named, template.other.opening, template.other.closing)))}"
    learned = ", ".join(_text(name) for name, f in template.roles.items() if f.learned)
    steps = " or ".join(
        f"(before {'is null' if a is None else '= ' + _text(a)} and role in ({', '.join(map(_text, b))}))" for a, b in template.follows.items()
    )
    last = ", ".join(map(_text, template.last))
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', {_text(hostile)} union all select -1, 1, 'assistant', {_text(hostile)}),
u as (select *, lag(role) over (partition by conv_id order by turn) as before,
  length({escaped}) + case role {cases} else {other} end as chars, role in ({learned}) as learned from t),
c as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(string_agg(text, '' order by turn) filter (where learned), '') as loss, sum(chars)::bigint as formatted_chars,
  bool_and(coalesce({steps}, false)) and arg_max(role, turn) in ({last}) as valid from u group by conv_id)
select conv_id, n_turns, turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars, valid from c"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def resample_sql(percent: int, least_words: int, buckets: int, seed: int) -> str:
    """Checksums letter by letter: all different runs of words walk through their bytes side by side."""
    return rf"""
with recursive w as (select 'd' as side, doc_id, row_number() over () as r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all select 'b', null, row_number() over (), regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
p as (select side, r, ws, unnest(range(1, len(ws) + 1)) as i from w),
f as (select side, r, array_to_string(ws[i:i + k - 1], ' ') as f from p, range(1, 4) as ks(k) where i + k - 1 <= len(ws)),
tab as (select b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
  from range(256) as bs(b)),
crc as (select f, hex(encode(f)) as h, octet_length(encode(f)) as n, 4294967295 as c, 0 as i from (select distinct f from f)
  union all select f, h, n, xor(tab.v, c >> 8), i + 1 from crc join tab on tab.b = xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::bigint) where i < n),
bucket as (select f, xor(c, 4294967295) % {buckets} as bucket from crc where i = n),
fb as (select side, r, bucket from f join bucket using (f)),
n as (select bucket, count(*) filter (where side = 'd') as s, count(*) filter (where side = 'b') as t from fb group by bucket),
g as (select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + {buckets})::double / ((s + 1)::double * ((sum(t) over ()) + {buckets})::double)))::bigint as gain from n),
d as (select r, count(*) as n_features, sum(gain)::bigint as weight from fb join g using (bucket) where side = 'd' group by r),
x as (select doc_id, r, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from w left join d using (r) where side = 'd'),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from x),
z as (select r, row_number() over (order by score desc, doc_id nulls last) as k, count(*) over () as all_ from y where n_words >= {least_words})
select doc_id, n_features, weight, score, case when k <= {percent} * all_ // 100 then k end as rank from y left join z using (r)"""


def audit_sql() -> str:
    """Every order applied to the counts of documents by failed filters."""
    letters = "ABCDE"
    picks = ", ".join(f"l{i}.f as f{i}" for i in range(5))
    unlike = " and ".join(f"l{i}.f <> l{j}.f" for i in range(5) for j in range(i))
    return rf"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
e as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
  + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
  + 16 * coalesce(min(d.doc_id) over (partition by text) < d.doc_id, false)::int as fails
  from d left join l on l.doc_id = d.doc_id),
c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from e group by all),
letters as (select substr('{letters}', i::int, 1) as f, (1 << (i - 1)::int) as bit from range(1, 6) as x(i)),
o as (select {picks} from letters l0, letters l1, letters l2, letters l3, letters l4 where {unlike}),
s as (select f0 || f1 || f2 || f3 || f4 as filter_order, i::int as step, substr(filter_order, i::int, 1) as f,
  (select sum(bit) from letters where contains(substr(filter_order, 1, (i - 1)::int), f)) as before from o, range(1, 6) as x(i)),
t as (select part, filter_order, step, s.f, n, good, toxic, fails & coalesce(before, 0) = 0 as there, fails & bit <> 0 as failed, fails = bit as lone
  from s join letters using (f), c),
r as (select part, filter_order, step, f, coalesce(sum(n) filter (where there and not failed), 0)::bigint as kept,
  coalesce(sum(n) filter (where there and failed), 0)::bigint as removed, coalesce(sum(n) filter (where failed and not there), 0)::bigint as redundant,
  coalesce(sum(n) filter (where lone), 0)::bigint as unique_fails, coalesce(sum(good) filter (where there and failed), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (where there and failed), 0)::bigint as toxic_lost from t group by all)
select * exclude (f), (sum(removed) over (partition by part, f))::bigint as shapley from r"""


def mixing_sql(weights: tuple[int, ...], share: float, most: int, seed: int) -> str:
    """Targets by the common level, documents in the order of their odds."""
    return rf"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  (('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint + 0.5::double) / 281474976710656::double as u from documents),
s as (select source, sum(size)::bigint as source_size, {list(weights)}[((row_number() over (order by source nulls last)) - 1) % {len(weights)} + 1] as weight
  from d group by source),
c as (select *, source_size * {most} as cap, (source_size * {most})::double / weight as per,
  coalesce(sum(source_size * {most}) over b, 0)::bigint as caps, coalesce(sum(weight) over b, 0)::bigint as weights,
  (sum(source_size) over ())::double * {share} as budget, (sum(weight) over ())::bigint as heavy
  from s window b as (order by (source_size * {most})::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
v as (select *, (budget - caps) / (heavy - weights) as level from c),
t as (select source, source_size, least(cap::double, coalesce((select max(level) from v where per >= level), 0) * weight) as target from v),
p as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint as whole, target - whole * source_size as rest from t),
q as (select d.*, source_size, target, whole, rest, (u / (1 - u)) / nullif((rest / nullif(source_size, 0)) / (1 - rest / nullif(source_size, 0)), 0) as odds
  from d join p on p.source is not distinct from d.source),
r as (select *, sum(size) over (partition by source order by odds nulls last, doc_id nulls last rows unbounded preceding) as upto from q)
select doc_id, size, source_size, target, (size * (whole + (odds is not null and 2 * upto - size <= 2 * rest)::int))::bigint as taken from r"""


__all__ = ["audit_sql", "chat_sql", "jaccard_sql", "mixing_sql", "quality_sql", "resample_sql", "warc_sql"]
