"""DuckDB SQL for those text operators that SQL can express.

Toxicity, quality and language models, BPE, packing and entropy windows have none; tests hold them
against the tokenizers library, brute force or held-out labels.
"""

from posrecon.llm.quality_rules import PRODUCTION as RULES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"
_WORDS = "list_filter(string_split_regex(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_NGRAM_JACCARD = f"""
with recursive w as (
  select doc_id, {_WORDS.format(_LOWER.format('text'))} as ws from documents),
s as (
  select doc_id, list_sort(list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end)) as shingles from w),
c as (select min(doc_id) as id, shingles, len(shingles) as n from s where len(shingles) > 0 group by shingles),
t as (select id, n, unnest(shingles) as token from c),
p as (select a.id as x, b.id as y, a.n as n, b.n as m, count(*) as shared
      from t a join t b on a.token = b.token and a.id < b.id group by all),
l as (select x, y from p where 100 * shared >= 85 * (n + m - shared)),
e as (select x, y from l union all select y, x from l),
r as (select id as x, id as root from c union select e.y, r.root from r join e on r.x = e.x),
k as (select x as id, min(root) as component_id from r group by x)
select s.doc_id, len(s.shingles) as n_shingles, coalesce(k.component_id, s.doc_id) as component_id
from s left join c on s.shingles = c.shingles left join k on c.id = k.id"""

_NEIGHBORS = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (
  select q.vec_id as query_id, c.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda a, b: a + b)) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score, vec_id) as rank from d)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10"""

_RATES = {
    "word_length": "100 * word_chars // greatest(n_words, 1)",
    "symbol_rate": "1000 * n_symbols // greatest(n_words, 1)",
    "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)",
    "capital_rate": "1000 * capitals // greatest(word_chars, 1)",
    "exclaim_rate": "1000 * exclaims // greatest(n_words, 1)",
}


def _removed(pattern: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"


def _quartiles(name: str, keys: str) -> str:
    """Sketches merged by ``keys``, and their quartiles."""
    by = f"{keys}, measure" if keys else "measure"
    return f"""
{name}_m as (select {by}, bucket, sum(n) as n from sketch group by {by}, bucket),
{name}_r as (select *, sum(n) over (partition by {by}) as total,
    sum(n) over (partition by {by} order by bucket rows unbounded preceding) as upto from {name}_m),
{name} as (select {by}, any_value(total) as n, min(bucket) filter (where upto * 100 >= total * 25) as q1,
    min(bucket) filter (where upto * 100 >= total * 75) as q3 from {name}_r group by {by})"""


_SPREAD = " ".join(f"when '{f.measure}' then {f.spread}" for f in RULES.fences)
_LOW = ", ".join(f"'{f.measure}'" for f in RULES.fences if f.low)
_QUALITY = f"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS.format('text')} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as w from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from d)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, w) > 1),
again as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from twice) group by doc_id),
c as (
  select doc_id, lang, source, cast(len(ws) as bigint) as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
    {_removed('[#*$%&|<>]+')} as n_symbols, {_removed('[\\p{Lu}]+')} as capitals, {_removed('!+')} as exclaims,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
    cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    coalesce(again.n, 0) as n_repeat_words
  from d left join again using (doc_id)),
m as (select *, {', '.join(f'{e} as {k}' for k, e in _RATES.items())} from c),
long as (unpivot (select doc_id, lang, source, {', '.join(_RATES)} from m) on {', '.join(_RATES)} into name measure value v),
sketch as (select lang, source, measure, v - v % (1 << greatest(length(bin(v)) - 6, 0)) as bucket, count(*) as n from long group by all),
{_quartiles('own', 'lang, source')},{_quartiles('lng', 'lang')},{_quartiles('every', '')},
fence as (
  select o.lang, o.source, o.measure,
    case when o.n >= {RULES.min_docs} then o.q1 when l.n >= {RULES.min_docs} then l.q1 else e.q1 end as low,
    case when o.n >= {RULES.min_docs} then o.q3 when l.n >= {RULES.min_docs} then l.q3 else e.q3 end as high,
    {RULES.reach} * greatest(high - low, case o.measure {_SPREAD} end) as width
  from own o join lng l on o.lang is not distinct from l.lang and o.measure = l.measure join every e on o.measure = e.measure),
verdict as (
  select doc_id, bool_and(v <= high + width and (x.measure not in ({_LOW}) or v >= low - width)) as inside
  from long x join fence f on x.lang is not distinct from f.lang and x.source is not distinct from f.source and x.measure = f.measure
  group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {RULES.min_words} or 100 * n_repeat_words > {RULES.max_repeat_pct} * n_words) as base_failed,
  (not base_failed and inside) as kept
from m join verdict using (doc_id)"""

_LINE_DEDUP = f"""
with l as (
  select doc_id, unnest(x) as line, generate_subscripts(x, 1) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
k as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
r as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.*, coalesce(r.last <> k.doc_id, false) as gone from k left join r using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": _NGRAM_JACCARD,
    "op2_neighbors": _NEIGHBORS,
    "op3_quality_rules": _QUALITY,
    "op6_line_dedup": _LINE_DEDUP,
}
