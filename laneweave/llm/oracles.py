"""SQL with the same results as those queries that SQL can express."""

from __future__ import annotations

from .urls import _BINS, _REACH, _SIZE, ALPHABET, HELD_OUT, RULES, SMOOTHING

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = r"""
with lists as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
w as (select doc_id, len(words) as n, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from lists),
runs as (select doc_id, p, case when p + 19 <= n then string_agg(word, ' ') over (partition by doc_id order by p rows between current row and 19 following) end as run, word from w),
firsts as (select run, min((doc_id, p)) as f from runs where run is not null group by run),
marked as (select r.*, coalesce((r.doc_id, r.p) > f.f, false) as again from runs r left join firsts f on f.run = r.run),
gone as (select doc_id, p, word, max(again::int) over (partition by doc_id order by p rows between 19 preceding and current row) as gone from marked),
done as (select doc_id, count(*) as n_words, sum(gone)::bigint as n_removed, string_agg(word, ' ' order by p) filter (gone = 0) as kept from gone group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join done on done.doc_id = d.doc_id
"""

_OP5_LENGTHS = "\n union all ".join(
    f"select doc_id, p, {n} as n, case when p + {n - 1} <= total then string_agg(word, ' ') over (partition by doc_id order by p rows between current row and {n - 1} following) end as run from w where {n} in (select n from windows)"
    for n in range(1, 11)
)
_OP5 = rf"""
with lists as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
w as (select doc_id, len(words) as total, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from lists),
items as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
windows as (select distinct item_id, least(len(words), 10) as n, array_to_string(words[s : s + 9], ' ') as run from (select *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as s from items where len(words) > 0)),
runs as ({_OP5_LENGTHS}),
found as (select r.doc_id, r.p, r.n, i.item_id from runs r join windows i on i.run = r.run and i.n = r.n),
named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found group by doc_id),
hits as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from found) group by doc_id)
select l.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lists l left join hits using (doc_id) left join named using (doc_id)
"""

_OP6 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

_OP7 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as latest from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and latest <> page_id then 'revisit' else 'response' end as record_type, case when payload_bytes >= 1000 and latest <> page_id then latest end as refers_to from m
"""

_OP9 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
pieces as (select doc_id, n, k, substr(h, 512*k+1, 512 + 98) as h from (select *, unnest(range(0, (n + 255) // 256)) as k from d)),
b as (select doc_id, n, 256*k as base, h, unnest(range(0, least(256, n - 256*k))) as i from pieces),
s as (select doc_id, base + i as p, substr(h, 2*i+1, 2) as byte, case when base + i + 50 <= n then md5(substr(h, 2*i+1, 100)) end as run from b),
f as (select run, min(doc_id) as first_id from s where run is not null group by run),
g as (select s.doc_id, p, byte, max(coalesce(f.first_id < s.doc_id, false)::int) over (partition by s.doc_id order by p rows between 49 preceding and current row) as gone from s left join f on f.run = s.run),
k as (select *, lag(gone, 1, 0) over (partition by doc_id order by p) as before from g),
done as (select doc_id, sum(gone)::bigint as n_removed, count(*) filter (gone = 1 and before = 0) as n_spans, string_agg(byte, '' order by p) filter (gone = 0) as kept from k group by doc_id)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join done using (doc_id)
"""


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


_LONGEST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_RULE = "case " + " ".join(f"when {_fits(h, p)} then '{h}{p}'" for h, p, _ in _LONGEST) + " end"
_GIVEN = "case " + " ".join(f"when {_fits(h, p)} then '{v}'" for h, p, v in _LONGEST) + " end"


def _smoothed(side: str) -> str:
    p = f"((coalesce(c.{side}, 0) + {SMOOTHING / _SIZE}) / (t.{side} + {SMOOTHING}))"
    p = f"((coalesce(bc.{side}, 0) + {SMOOTHING}*{p}) / (coalesce(b.{side}, 0) + {SMOOTHING}))"
    return f"((coalesce(abc.{side}, 0) + {SMOOTHING}*{p}) / (coalesce(ab.{side}, 0) + {SMOOTHING}))"


_HELD_OUT = f"md5(url)[1] in ({', '.join(repr(c) for c in HELD_OUT)})"
_OP10 = rf"""
with cut as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
cut2 as (select page_id, url, regexp_extract(coalesce(rest, ''), '^([^?#]*)', 1) as hp from cut),
cut3 as (select page_id, url, {_LOWER.format("case when strpos(hp, '/') > 0 then substr(hp, 1, strpos(hp, '/') - 1) else hp end")} as host, case when strpos(hp, '/') > 0 then substr(hp, strpos(hp, '/')) else '' end as path from cut2),
seen as (select *, {_RULE} as rule, {_GIVEN} as given from cut3),
urls as (select url, given, count(*) as n, regexp_replace(regexp_replace({_LOWER.format("url")}, '[0-9]', '0', 'g'), '[^a-z0./\-_?=&%:#~+@]', '*', 'g') as plain from seen where length(url) > 0 group by url, given),
chars as (select url, given, n, unnest(range(1, length(plain) + 1)) as p, plain from urls),
codes as (select url, given, n, p, strpos('{ALPHABET}', substr(plain, p, 1)) - 1 as c from chars),
grams as (select *, lag(c, 1, 0) over w as b, lag(c, 2, 0) over w as a from codes window w as (partition by url order by p)),
abc as (select a, b, c, coalesce(sum(n) filter (given = 'allow'), 0)::double as yes, coalesce(sum(n) filter (given = 'block'), 0)::double as no from grams where given is not null and not {_HELD_OUT} group by a, b, c),
ab as (select a, b, sum(yes) as yes, sum(no) as no from abc group by a, b), bc as (select b, c, sum(yes) as yes, sum(no) as no from abc group by b, c),
b as (select b, sum(yes) as yes, sum(no) as no from abc group by b), c as (select c, sum(yes) as yes, sum(no) as no from abc group by c),
t as (select coalesce(sum(yes), 0) as yes, coalesce(sum(no), 0) as no from abc),
scored as (select g.url, any_value(g.given) as given, any_value(g.n) as n, avg(ln({_smoothed('yes')}) - ln({_smoothed('no')})) as score from grams g
 left join abc on abc.a = g.a and abc.b = g.b and abc.c = g.c left join ab on ab.a = g.a and ab.b = g.b left join bc on bc.b = g.b and bc.c = g.c left join b on b.b = g.b left join c on c.c = g.c, t group by g.url),
bins as (select floor((greatest(-{_REACH}, least({_REACH}, score)) + {_REACH}) * {_BINS / (2 * _REACH)}) as bin, sum(case when given = 'allow' then n else 0 end) as yes, sum(case when given = 'block' then n else 0 end) as no from scored where given is not null and {_HELD_OUT} group by 1),
sums as (select *, sum(yes) over () as ys, sum(no) over () as ns, coalesce(sum(yes) over (order by bin rows between unbounded preceding and 1 preceding), 0) as by_, coalesce(sum(no) over (order by bin rows between unbounded preceding and 1 preceding), 0) as bn, lag(bin) over (order by bin) as before from bins),
places as (select by_ / ys + 1 - bn / ns as cost, case when before is null then bin / {_BINS / (2 * _REACH)} - {_REACH} else ((bin / {_BINS / (2 * _REACH)} - {_REACH}) + ((before + 1) / {_BINS / (2 * _REACH)} - {_REACH})) / 2 end as place from sums where ys > 0 and ns > 0),
threshold as (select coalesce((select place from places order by cost, place limit 1), '-infinity'::double) as at)
select s.page_id, s.host, s.path, s.rule, coalesce(s.given, case when coalesce(x.score, 0) >= threshold.at then 'allow' else 'block' end) as verdict from seen s left join scored x on x.url = s.url, threshold
"""

_OP11 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where embedding is not null and vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, c.vec_id as id, c.label, list_inner_product(a.e, c.e)::bigint as score from v a join v c on c.vec_id <> a.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where label = own qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, p.positive_id, p.positive_score, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)::int as rank from p join s on s.anchor_id = p.anchor_id and s.label <> s.own and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

_OP12 = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
w as (select r, lang, source, unnest(words) as term from d),
kept as (select lang, term, count(*) as ln from w group by lang, term having count(distinct r) >= 3),
c as (select w.lang, w.source, w.term, count(*) as n from w join kept using (lang, term) group by all),
g as (select lang, source from d group by all),
big as (select lang, count(*) as v, sum(ln)::bigint as lt from kept group by lang),
tot as (select lang, source, sum(n)::bigint as t from c group by all),
groups as (select g.lang, g.source, coalesce(t, 0) as t, v, lt from g left join tot using (lang, source) left join big using (lang)),
p as (select groups.lang, groups.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (groups.t + groups.v) as p, 1 + (1000000000 * (kept.ln + 1)) // (groups.lt + groups.v) as q
 from groups join kept using (lang) left join c on c.lang = groups.lang and c.source = groups.source and c.term = kept.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from groups a join groups b on b.lang = a.lang and b.source <> a.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value::bigint as value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200
"""

_OP13 = rf"""
with recursive lists as (select doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
shingles as (select distinct doc_id, array_to_string(words[s : s + 3], ' ') as shingle from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as s from lists where len(words) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on b.shingle = a.shingle and b.doc_id > a.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from reach r join both_ways e on e.a = r.b),
least as (select a as doc_id, min(b) as component_id from reach group by a)
select l.doc_id, coalesce(n, 0) as n_shingles, component_id, l.doc_id = component_id as kept from lists l join least using (doc_id) left join sizes using (doc_id)
"""

ORACLES = {
    "op2_substring_dedup": _OP2,
    "op5_decontamination": _OP5,
    "op6_exact_topk": _OP6,
    "op7_warc": _OP7,
    "op9_suffix_dedup": _OP9,
    "op10_url_filter": _OP10,
    "op11_hard_negatives": _OP11,
    "op12_source_divergence": _OP12,
    "op13_minhash_dedup": _OP13,
}
