"""SQL of the engine's queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

from liame.oracles_text import SQL as TEXTS

A, B = "jose-nhusabise", "frederico-vivedim-nhisubuta"
NOW = "timestamp '2026-09-01 00:00:00'"
BR = "country is distinct from 'pt'"
OUTLET = "case when source = 'bluesky' then null else domain end"


def since(days: int) -> str:
    return f"published_at >= {NOW} - interval {days} day"


def r2(x: str) -> str:
    return f"round(({x})::decimal(38, 15), 2)::double"


BASE = """p as (select distinct doc_id, person_id from doc_persons),
ids as (select term_id, kind, term, min(term_id) over (partition by kind, term) as one from (select distinct term_id, kind, term from terms)),
t as (select distinct doc_id, one as term_id from doc_terms join ids using (term_id)),
v as (select term_id, kind, term from ids where term_id = one),
own as (select id as person_id, list(distinct w) as names from (select id, unnest(string_split_regex(strip_accents(lower(a)), '[^a-z0-9]+')) as w from (select id, unnest(aliases) as a from persons)) where length(w) >= 3 group by 1)"""


def named(person: str, term: str = "term") -> str:
    return f"list_has_any(string_split({term}, ' '), (select names from own where person_id = '{person}'))"


def pmi(c_pt: str, n: str, n_p: str, c_t: str) -> str:
    return f"ln(({c_pt}::double * {n}::double) / ({n_p}::double * {c_t}::double)) / ln(2.0::double)"


def scored(tag: str, person: str, where: str, exclude: bool = True) -> str:
    """CTEs s_, m_, x_<tag>: documents in scope, about the person, and the person's scored terms."""
    drop = f"where not {named(person)}" if exclude else ""
    return f"""s{tag} as (select * from docs where {where}),
m{tag} as (select s{tag}.* from s{tag} join p using (doc_id) where person_id = '{person}'),
k{tag} as (select doc_id from s{tag} where doc_id in (select doc_id from p)),
n{tag} as (select (select count(*) from k{tag}) as n, (select count(*) from m{tag}) as n_p),
c{tag} as (select term_id, count(*) as c_pt, avg(tone) as tone, sum(reach_reposts)::bigint as reach from t join m{tag} using (doc_id) group by 1),
a{tag} as (select term_id, count(*) as c_t from t join k{tag} using (doc_id) group by 1),
x{tag} as (select term, kind, c_pt as count, tone, reach, {pmi('c_pt', 'n', 'n_p', 'c_t')} as pmi, n_p from c{tag} join v using (term_id) join a{tag} using (term_id), n{tag} {drop})"""


WHOLE = f"{since(21)} and {BR}"
MAP = f"with {BASE}, {scored('', A, WHOLE)}"
RANK = "pmi * ln(1.0 + count)"
SHOWN = f"term, kind, count, {r2('pmi')} as pmi, {r2('tone')} as tone, reach"
TOP40 = "top as (select * from x where count >= 2 order by count desc, term, kind limit 40)"


def links(docs: str, out: str) -> str:
    return f"""h{out} as (select doc_id, kind || ':' || term as name from t join v using (term_id) join top using (kind, term) where doc_id in (select doc_id from {docs})),
l{out} as (select a.name as s, b.name as t, count(*) as count from h{out} a join h{out} b on a.doc_id = b.doc_id and a.name < b.name group by 1, 2 having count(*) >= 2)"""


SCORES = "sc as (select doc_id, person_id, case when (doc_id + length(person_id)) % 5 = 0 then null else ((doc_id * 7 + length(person_id) * 13) % 21 - 10)::double end as score from p)"
VIEWS = "views as (select person_id, (published_at - interval 3 hour)::date as day, count(*) * 100 as views from p join docs using (doc_id) group by 1, 2)"
FOLDED_DAY = "least((published_at - interval 3 hour)::date, date '2026-08-31')"
LEANS = "(values ('folhetimselhapuce.pt', 'left'), ('gazetaficagece.jor.br', 'right'), ('jornalgalhunoce.jor.br', 'center'), ('diariotrunhimice.jor.br', 'left'), ('correiorobelice.jor.br', 'right')) as leans(domain, lean)"
SOURCES = f"select {OUTLET} as domain, source, count(*) as docs, {r2('avg(tone)')} as tone, count(tone) as tone_n from m group by 1, 2 order by docs desc, domain nulls last, source limit 80"
AGENDA = f"""with {BASE}, d as (select doc_id, {OUTLET} as domain from docs where {WHOLE}), r as (select * from d join p using (doc_id) where domain is not null),
o as (select domain, count(distinct doc_id) as total from r group by 1 having count(distinct doc_id) >= 5 order by total desc, domain limit 30),
g as (select person_id, domain, count(*) as docs, {r2('count(*)::double / any_value(total)')} as share from r join o using (domain) group by 1, 2)"""
COMENTION = f"""with {BASE}, d as (select doc_id from docs where {WHOLE}),
g as (select a.person_id as a, b.person_id as b, count(*) as count from p a join p b on a.doc_id = b.doc_id and a.person_id < b.person_id where a.doc_id in (select doc_id from d) group by 1, 2 having count(*) >= 3)"""
TESTIMONY = f"""with {BASE}, {SCORES}, e as (select source, {OUTLET} as domain, score from docs join sc using (doc_id) where person_id = '{A}' and {since(21)}),
u as (select source, domain, grouping(source) as gs, grouping(domain) as gd, {r2('avg(score)')} as score, count(score) as n from e group by grouping sets ((), (source), (domain, source))),
w as (select case when gs = 1 and gd = 1 then 'overall' when gd = 1 then 'source' else 'domain' end as level, source, domain, score, n from u),
g as (select * from w where level = 'overall' or (level = 'source' and n >= 1) or (level = 'domain' and domain is not null and n >= 3)),
f as (select domain, round(sum(score * n) / sum(n), 6) as score, sum(n)::bigint as n from g where level = 'domain' group by 1)"""
TERM_TESTIMONY = f"""{MAP}, {TOP40}, {SCORES}, z as (select doc_id, score from m join sc using (doc_id) where sc.person_id = '{A}' and score is not null),
g as (select kind || ':' || term as id, {r2('avg(score)')} as score, count(*) as n from z join t using (doc_id) join v using (term_id) join top using (kind, term) group by 1
  union all select null, {r2('avg(score)')}, count(*) from z)"""
CANDIDATES = f"""with c as (select distinct doc_id, name from doc_candidates), d as (select *, {since(7)} as recent from docs where {since(14)}),
g as (select name, count(*) filter (where recent) as count, count(distinct source) filter (where recent) as sources, count(*) filter (where not recent) as previous
  from c join d using (doc_id) group by 1 having count(*) filter (where recent) >= 5 order by count desc, name limit 50)"""
SIDES = f"""with {BASE}, {scored('a', A, WHOLE)}, {scored('b', B, WHOLE)},
keys as ((select term, kind from xa order by count desc, term, kind limit 40) union (select term, kind from xa order by {RANK} desc, term, kind limit 40)
  union (select term, kind from xb order by count desc, term, kind limit 40) union (select term, kind from xb order by {RANK} desc, term, kind limit 40)),
g as (select term, kind, xa.count as a_count, {r2('xa.pmi')} as a_pmi, {r2('xa.tone')} as a_tone, xb.count as b_count, {r2('xb.pmi')} as b_pmi, {r2('xb.tone')} as b_tone,
  {named(A)} as is_name_a, {named(B)} as is_name_b from keys left join xa using (term, kind) left join xb using (term, kind))"""
NAME = named(A)
RISING = f"""with {BASE}, d as (select doc_id, {since(7)} as recent, reach_reposts from docs join p using (doc_id) where person_id = '{A}' and {since(21)} and {BR}),
k as (select term_id, count(*) filter (where recent) as c_recent, count(*) filter (where not recent) as c_baseline, sum(reach_reposts) filter (where recent)::bigint as reach from t join d using (doc_id) group by 1),
c as (select term, kind, c_recent, c_baseline, reach from k join v using (term_id) where not {named(A)}),
w as (select (select count(*) from d where recent) as about_recent, (select count(*) from d where not recent) as about_baseline,
  coalesce((select sum(c_recent) from c), 0)::bigint as words_recent, coalesce((select sum(c_baseline) from c), 0)::bigint as words_baseline),
g as (select term, kind, {r2('c_recent / 7.0::double')} as count_recent, {r2('c_baseline / 14.0::double')} as count_baseline, c_recent as count_recent_raw, c_baseline as count_baseline_raw,
  {r2('(c_recent / 7.0::double) / ((c_baseline + 1) / 14.0::double)')} as lift, reach from c where c_recent >= 3),
lifted as (select * from g order by lift desc, term, kind limit 40), present as (select * from g order by count_recent_raw desc, lift desc, term, kind limit 40)"""


def timeline(docs: str, days: int, bucket: int) -> str:
    last = -(-days // bucket) - 1
    return f"""b as (select i::int as i, {NOW} - to_days(least((i + 1) * {bucket}, {days})::int) as bucket_start from range({last + 1}) r(i)),
y as (select least({last}, greatest(0, ceil(epoch_us({NOW} - published_at)::bigint / ({bucket} * 86400000000::double))::int - 1)) as i, count(*) as n from {docs} group by 1)
select i, bucket_start, coalesce(n, 0) as count from b left join y using (i)"""


WEEK = f"""with {BASE}, d as (select doc_id, {FOLDED_DAY} as day from docs join p using (doc_id) where person_id = '{A}' and published_at >= timestamp '2026-08-25 03:00:00' and {BR})"""


def term_weeks(weeks: int) -> str:
    return f"""with {BASE}, u as (select doc_id from docs where {WHOLE} and doc_id in (select doc_id from p)),
ct as (select term_id, count(*) as c_t from t join u using (doc_id) group by 1), n as (select count(*) as n from u),
d as (select doc_id, person_id, least(date '2026-08-31', date_trunc('week', (published_at - interval 3 hour)::date)::date) as week from docs join p using (doc_id) where {BR}),
e as (select * from d where week >= date '2026-08-31' - {7 * (weeks - 1)}), np as (select person_id, week, count(*) as n_p from e group by 1, 2),
k as (select person_id, week, term_id, count(*) as c_pt from t join e using (doc_id) group by 1, 2, 3 having count(*) >= 2),
q as (select person_id, term, kind, week, c_pt as count, c_t, {pmi('c_pt', 'n', 'n_p', 'c_t')} as pmi from k join ct using (term_id) join v using (term_id) join np using (person_id, week) left join own using (person_id), n
  where kind in ('word', 'hashtag', 'phrase') and not coalesce(list_has_any(string_split(term, ' '), names), false)),
g as (select person_id, term, kind, week, count, c_t from q qualify row_number() over (partition by person_id, week order by {RANK} desc, term, kind) <= 50)"""


PERSISTENCE = f"""{term_weeks(12)}, slots as (select i as slot, date '2026-08-31' - (7 * (11 - i))::int as week from range(12) r(i)),
keys as (select distinct person_id, term, kind from g),
z as (select person_id, term, kind, slot, count from keys cross join slots left join g using (person_id, term, kind, week)),
pk as (select *, max(slot) filter (where count = top) over (partition by person_id, term, kind) as peak from (select *, max(count) filter (where slot < 11) over (partition by person_id, term, kind) as top from z where slot < 11)),
fall as (select person_id, term, kind, any_value(peak) as peak, min(slot) filter (where slot > peak and coalesce(count, 0) <= top / 2.0) as fall from pk group by 1, 2, 3),
newest as (select person_id, term, kind, case when count is null then 10 else 11 end as start from z where slot = 11),
gap as (select person_id, term, kind, start, max(slot) filter (where count is null and slot <= start) as gap from z join newest using (person_id, term, kind) group by 1, 2, 3, 4),
tot as (select person_id, term, kind, count(count) as weeks_present, sum(count)::bigint as total from z group by 1, 2, 3)"""
UNIVERSE = f"""d as (select doc_id, source from docs where {WHOLE}), dk as (select * from d where doc_id in (select doc_id from p)),
un as (select coalesce(source, 'all') as source, term_id, count(*) as c_t from t join dk using (doc_id) group by grouping sets ((source, term_id), (term_id)))"""
BUILT_SCOPES = """us as (select coalesce(source, 'all') as source, count(*) as docs, count(*) filter (where doc_id in (select doc_id from p)) as tracked from d group by grouping sets ((source), ())),
ab as (select coalesce(source, 'all') as source, person_id, count(*) as about from d join p using (doc_id) group by grouping sets ((source, person_id), (person_id))),
wanted as (select unnest(['all', 'bluesky', 'camara', 'gdelt', 'gkg', 'gnews', 'juridico', 'nicho', 'oficial', 'rss', 'senado']) as source),
gs as (select 21::bigint as days, source, id as person_id, coalesce(docs, 0) as docs, coalesce(tracked, 0) as tracked, coalesce(about, 0) as about
  from wanted cross join persons left join us using (source) left join ab on ab.source = wanted.source and ab.person_id = persons.id)"""
_MINS = ", ".join(f"row_number() over (partition by source, person_id, kind, c_pt >= {m} order by key desc, term) as by_{m}" for m in (1, 2, 3, 5))
_KEEP = " or ".join(f"(c_pt >= {m} and by_{m} <= 200)" for m in (1, 2, 3, 5))
PERSON_TERMS = f"""with {BASE}, {UNIVERSE}, {BUILT_SCOPES},
dd as (select doc_id, source, tone, reach_reposts from docs where {WHOLE}),
k as (select coalesce(source, 'all') as source, person_id, term_id, count(*) as c_pt, avg(tone) as tone, sum(reach_reposts)::bigint as reach from t join dd using (doc_id) join p using (doc_id) group by grouping sets ((source, person_id, term_id), (person_id, term_id))),
q as (select k.source, k.person_id, term, kind, c_pt, c_t, tone, reach, about, {pmi('c_pt', 'tracked', 'about', 'c_t')} as pmi from k join v using (term_id) join un on un.source = k.source and un.term_id = k.term_id
  join gs on gs.source = k.source and gs.person_id = k.person_id left join own on own.person_id = k.person_id where not coalesce(list_has_any(string_split(term, ' '), names), false)),
q2 as (select *, pmi * ln(1.0 + c_pt) as key, c_pt >= greatest(3.0, about * 0.05) as sure from q),
q3 as (select *, row_number() over (partition by source, person_id, kind order by c_pt desc, term) as by_count, {_MINS},
  row_number() over (partition by source, person_id, sure order by pmi desc, term, kind) as by_signature from q2),
g as (select 21::bigint as days, source, person_id, term, kind, c_pt, c_t, {r2('tone')} as tone, reach from q3 where by_count <= 200 or {_KEEP} or (sure and by_signature <= 5))"""
OUTLETS = f"""{MAP}, mo as (select doc_id, {OUTLET} as domain from m), oc as (select domain, term_id, count(*) as c_pt from t join mo using (doc_id) where domain is not null and domain <> '' group by 1, 2 having count(*) >= 3),
oq as (select domain, kind, term, c_pt, {pmi('c_pt', 'n', 'n_p', 'c_t')} * ln(1.0 + c_pt) as key from oc join v using (term_id) join a using (term_id), n where not {named(A)}),
sets as (select domain, kind, term, c_pt from oq qualify row_number() over (partition by domain order by key desc, term, kind) <= 40),
sz as (select domain, count(*) as size from sets group by 1),
j as (select a.domain as a, b.domain as b, count(*) as shared from sets a join sets b on a.kind = b.kind and a.term = b.term and a.domain < b.domain group by 1, 2),
e as (select a, b, shared / (x.size + y.size - shared)::double as similarity from j join sz x on x.domain = a join sz y on y.domain = b)"""
MERGED = """o as (select *, row_number() over (partition by uri order by collected_at, doc_id) as k from docs where uri is not null),
f as (select * from o where k = 1),
l as (select uri, arg_min(text, (-length(text), k)) as text, max(length(text)) as longest, count(*) as arrivals, arg_min(domain, k) filter (where domain is not null) as domain,
  arg_min(country, k) filter (where country is not null) as country, arg_min(tone, k) filter (where tone is not null) as tone,
  max(reach_likes) as reach_likes, max(reach_reposts) as reach_reposts, max(reach_replies) as reach_replies, max(reach_quotes) as reach_quotes from o group by 1)"""
CLAMP = "least(greatest({}, -1.0), 1.0)"

SQL: dict[str, str] = TEXTS | {
    "people": "select id, name, len(aliases) as n_aliases, party, office, uf from persons",
    "pmi_nodes": f"{MAP} select {SHOWN} from x where count >= 2 order by count desc, term, kind limit 40",
    "pmi_nodes_by_surprise": f"{MAP} select {SHOWN} from x where count >= 3 order by {RANK} desc, x.term, kind limit 40",
    "pmi_nodes_of_kind": f"with {BASE}, {scored('', A, WHOLE + chr(32) + 'and source in (' + repr('rss') + ', ' + repr('gnews') + ')')} select {SHOWN} from x where count >= 2 and kind in ('word', 'org') order by count desc, term, kind limit 60",
    "term_counts": f"{MAP} select kind, term, c_pt, {r2('tone')} as tone, reach from c join v using (term_id) where not {NAME}",
    "term_totals": f"{MAP} select kind, term, c_t from a join v using (term_id)",
    "scope_stats": f"{MAP} select (select count(*) from s) as docs, n as tracked, n_p as about from n",
    "signature_top5": f"{MAP}, g as (select term, kind, count, {r2('pmi')} as pmi from x where count >= greatest(3.0, n_p * 0.05)) select * from g order by pmi desc, term, kind limit 5",
    "cooccurrence_links": f"{MAP}, {TOP40}, {links('m', '1')} select * from l1",
    "star_links": f"{MAP}, {TOP40} select '{A}' as s, kind || ':' || term as t, count from top",
    "induced_links": f"{MAP}, {TOP40}, {links('m', '1')}, few as (select kind || ':' || term as name from x where count >= 2 order by count desc, term, kind limit 20) select * from l1 where s in (select name from few) and t in (select name from few)",
    "edge_merge": f"{MAP}, {TOP40}, mb as (select s.* from s join p using (doc_id) where person_id = '{B}'), {links('m', '1')}, {links('mb', '2')} select s, t, sum(count)::bigint as count from (select * from l1 union all select * from l2) group by 1, 2",
    "related_terms": f"{MAP}, {TOP40}, {links('m', '1')} select case when s = 'word:governo' then t else s end as node, count from l1 where s = 'word:governo' or t = 'word:governo'",
    "sources_by_outlet": f"{MAP} {SOURCES}",
    "sources_labelled": f"{MAP}, g as ({SOURCES}) select g.domain, source, docs, lean from g left join {LEANS} on leans.domain = g.domain",
    "tone_matrix": f"with {BASE} select person_id, domain, {r2('avg(tone)')} as tone, count(tone) as n from docs join p using (doc_id) where {since(21)} and domain is not null and tone is not null and person_id in (select id from persons) group by 1, 2 having count(tone) >= 3",
    "agenda_share": f"{AGENDA} select person_id, domain, docs, share from g",
    "agenda_pivot": f"{AGENDA} select domain, max(share) filter (where person_id = '{A}') as share_a, max(share) filter (where person_id = '{B}') as share_b from g group by 1",
    "comention_pairs": f"{COMENTION} select * from g",
    "comention_matrix": f"{COMENTION}, i as (select a, b, count, greatest(0.18, count / (select max(count) from g)::double) as ink from g) select * from i union all select b, a, count, ink from i",
    "node_scores": f"{MAP} select kind, term, count::double as by_count, round({RANK}, 6) as by_pmi, reach::double as by_reach from x",
    "score_confusion": f"with {BASE}, {SCORES}, g as (select count(*) filter (score >= 3 and doc_id % 2 = 0) as tp, count(*) filter (score >= 3 and doc_id % 2 <> 0) as fp, count(*) filter (score < 3 and doc_id % 2 = 0) as fn from sc where score is not null) select *, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall from g",
    "persons_upsert": "select id, case when uf is null then upper(name) else name end as name, case when uf is null then 'x' else party end as party from persons",
    "persons_prune": f"with {BASE} select doc_id, person_id from p where person_id in (select id from persons where party is not null)",
    "legacy_terms": f"with {BASE} select kind, term, count(*) as docs from t join v using (term_id) group by 1, 2",
    "result_hash": "select count(*) as rows, true as differs from persons",
    "stub_scores": f"""with {BASE}, u as (select doc_id, person_id, text, list_concat([2166136261::bigint], flatten(list_transform(string_split(person_id || ':' || text, ''), lambda c: case when unicode(c) > 65535 then [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] else [unicode(c)::bigint] end))) as units
  from p join docs using (doc_id) where text is not null),
h as (select doc_id, person_id, text, list_reduce(units, lambda x, y: (xor(x, y) * 16777619) % 4294967296) as h from u)
select doc_id, person_id, 'stub' as method, case when trim(text, chr(32) || chr(9) || chr(10) || chr(13)) = '' then null else round((h % 2001) / 100.0::double - 10, 2) end as score from h""",
    "testimony_grouping_sets": f"{TESTIMONY} select level, source, domain, score, n from g",
    "term_testimony": f"{TERM_TESTIMONY} select * from g",
    "candidates": f"{CANDIDATES} select * from g",
    "candidate_samples": f"{CANDIDATES}, s as (select name, doc_id, source, text, (row_number() over (partition by name order by published_at desc, doc_id desc))::int as rn from c join docs using (doc_id) where name in (select name from g) and {since(7)}) select name, rn, doc_id, source, text from s where rn <= 3",
    "docs_page": f"{MAP} select doc_id, source, domain, published_at, text, uri, tone from m order by published_at desc, doc_id desc limit 50 offset 50",
    "docs_count": f"{MAP} select count(*) as total from m",
    "docs_by_term": f"{MAP} select doc_id, source, domain, published_at, text, uri, tone from m where doc_id in (select doc_id from t join v using (term_id) where term = 'governo' and kind in ('word', 'phrase')) order by published_at desc, doc_id desc limit 50",
    "docs_with_entity": f"{MAP} select doc_id, source, uri from m where doc_id in (select doc_id from p where person_id = '{B}')",
    "docs_by_day": f"{MAP} select doc_id, source from m where {FOLDED_DAY} = date '2026-08-31'",
    "docs_by_week": f"{MAP} select doc_id, source from m where {FOLDED_DAY} >= date '2026-08-24' and {FOLDED_DAY} < date '2026-08-31'",
    "country_filter": f"select 'br' as country, count(*) as docs from docs where {WHOLE} union all select 'pt', count(*) from docs where {since(21)} and country = 'pt' union all select 'all', count(*) from docs where {since(21)}",
    "lean_filter": f"select domain, count(*) as docs from docs where {since(21)} and domain in ('folhetimselhapuce.pt', 'jornalgalhunoce.jor.br') group by 1",
    "attention_series": f"with {BASE}, {VIEWS} select day, views from views where person_id = '{A}' and day >= date '2026-08-11'",
    "peak_day": f"with {BASE}, {VIEWS} select day, views from views where person_id = '{A}' and day >= date '2026-08-11' order by views desc, day limit 1",
    "peak_lag": f"with {BASE}, {VIEWS}, a as (select day from views where person_id = '{A}' and day >= date '2026-08-11' order by views desc, day limit 1), b as (select day from views where person_id = '{B}' and day >= date '2026-08-11' order by views desc, day limit 1) select a.day as day_a, b.day as day_b, b.day - a.day as lag from a, b",
    "compare_entities": f"{SIDES} select * from g",
    "bridge_candidates": f"{SIDES} select kind || ':' || term as id, coalesce(a_count, 0) + coalesce(b_count, 0) as docs from g where not (is_name_a or is_name_b) order by docs desc, id limit 60",
    "ruler_balance": f"{SIDES} select term, kind, case when a_pmi is null and b_pmi is null then null when b_pmi is null then -1.0 when a_pmi is null then 1.0 when abs(a_pmi) + abs(b_pmi) = 0 then 0.0 else {CLAMP.format('(greatest(b_pmi, 0) - greatest(a_pmi, 0)) / (abs(a_pmi) + abs(b_pmi))')} end as balance from g",
    "lenses": f"""with {BASE}, {scored('a', A, WHOLE + " and source = 'rss'", False)}, {scored('b', A, WHOLE + " and source = 'gnews'", False)},
keys as ((select term, kind from xa where not {NAME} order by count desc, term, kind limit 40) union (select term, kind from xa where not {NAME} order by {RANK} desc, term, kind limit 40)
  union (select term, kind from xb where not {NAME} order by count desc, term, kind limit 40) union (select term, kind from xb where not {NAME} order by {RANK} desc, term, kind limit 40)
  union (select term, kind from xa where {NAME} order by count desc, term, kind limit 40) union (select term, kind from xb where {NAME} order by count desc, term, kind limit 40))
select term, kind, xa.count as a_count, {r2('xa.pmi')} as a_pmi, {r2('xa.tone')} as a_tone, xb.count as b_count, {r2('xb.pmi')} as b_pmi, {r2('xb.tone')} as b_tone, {NAME} as is_name from keys left join xa using (term, kind) left join xb using (term, kind)""",
    "rising_terms": f"{RISING} select * from lifted",
    "rising_present": f"{RISING} select * from present",
    "rising_totals": f"{RISING} select * from w",
    "rare_risers": f"{RISING} select term, kind, lift from lifted where lift > 1 and (term, kind) not in (select (term, kind) from present)",
    "share_balance": f"{RISING} select term, kind, round(case when words_recent <= 0 or words_baseline <= 0 then null when count_recent_raw <= 0 then -1.0 else {CLAMP.format('log2((count_recent_raw / words_recent::double) / ((count_baseline_raw + 1) / words_baseline::double)) / 3')} end, 6) as balance from g, w",
    "lift_balance": f"{RISING} select term, kind, round(case when lift <= 0 or own <= 0 then -1.0 else {CLAMP.format('log2(lift / own) / 3')} end, 6) as balance from g, (select (about_recent / 7.0::double) / ((about_baseline + 1) / 14.0::double) as own from w)",
    "timeline_week": f"{MAP}, {timeline('m', 21, 7)}",
    "timeline_day": f"{MAP}, {timeline('m', 21, 1)}",
    "timeline_term": f"{MAP}, mt as (select * from m where doc_id in (select doc_id from t join v using (term_id) where term = 'governo')), {timeline('mt', 21, 1)}",
    "week_about": f"{WEEK}, g as (select date '2026-08-31' - i::int as day from range(7) r(i)), a as (select day, count(*) as about from d group by 1) select day, day::timestamp + interval 3 hour as start, coalesce(about, 0) as about from g left join a using (day)",
    "week_terms": f"{WEEK}, k as (select day, term_id, count(*) as count from t join d using (doc_id) group by 1, 2), g as (select day, row_number() over (partition by day order by count desc, term, kind)::int as rn, term, kind, count from k join v using (term_id) where not {NAME}) select * from g where rn <= 8",
    "week_testimony": f"{WEEK}, {SCORES} select day, {r2('avg(score)')} as score, count(score) as n from d join sc using (doc_id) where person_id = '{A}' and score is not null group by 1",
    "term_weeks": f"{term_weeks(2)} select * from g",
    "persistence_stats": f"{PERSISTENCE} select person_id, term, kind, (start - coalesce(gap, -1))::bigint as streak, (fall - peak)::bigint as half_life, weeks_present, total from gap join fall using (person_id, term, kind) join tot using (person_id, term, kind)",
    "persistence_series": f"{PERSISTENCE} select person_id, term, kind, slot, count from z",
    "persistence_level": f"{term_weeks(2)}, j as (select * from g where person_id = '{A}') select term, kind, week, greatest(1, ceil(count / (select max(count) from j)::double * 5))::bigint as level from j",
    "domain_of": "select doc_id, lower(regexp_replace(regexp_extract(uri, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '')) as domain from docs",
    "country_of": "select doc_id, case when domain like '%.pt' then 'pt' when domain like '%.br' then 'br' end as country from docs",
    "truncate_text": "select doc_id, case when length(text) <= 200 then text when regexp_extract(left(text, 201), '(?s)^(.*)\\s\\S*$', 1) <> '' then regexp_extract(left(text, 201), '(?s)^(.*)\\s\\S*$', 1) else left(text, 200) end as text from docs",
    "build_universe": f"with {BASE}, {UNIVERSE} select source, kind, term, c_t from un join v using (term_id)",
    "build_scopes": f"with {BASE}, {UNIVERSE}, {BUILT_SCOPES} select * from gs",
    "build_person_terms": f"{PERSON_TERMS} select * from g",
    "stored_scopes": f"with {BASE}, {UNIVERSE}, {BUILT_SCOPES} select * from gs",
    "stored_person_terms": f"{PERSON_TERMS} select * from g",
    "fast_nodes": f"{MAP} select {SHOWN} from x where count >= 2 order by {RANK} desc, x.term, kind limit 40",
    "fast_equals_live": "select ''::varchar as term, ''::varchar as kind, 0::bigint as count where false",
    "outlet_terms": f"{OUTLETS} select * from sets",
    "outlet_jaccard": f"{OUTLETS} select * from e",
    "outlet_neighbors": f"{OUTLETS}, w as (select a as domain, b as neighbor, similarity from e union all select b, a, similarity from e) select domain, neighbor, similarity, row_number() over (partition by domain order by similarity desc, neighbor) as rn from w qualify rn <= 5",
    "fold_testimony": f"{TESTIMONY} select * from f",
    "merge_outlets": f"{TESTIMONY}, m as (select docs.* from docs join p using (doc_id) where person_id = '{A}' and {WHOLE}), o as ({SOURCES}) select o.domain, source, docs, f.score as testimony, f.n as testimony_n from o left join f on f.domain = o.domain",
    "testimony_class": f"{TESTIMONY} select domain, source, case when score <= -2.5 then 'against' when score >= 2.5 then 'for' when score is not null then 'neutral' end as verdict from g where level = 'domain'",
    "term_mask": f"{TERM_TESTIMONY} select id, round(score - (select score from g where id is null), 6) as mask, n from g where id is not null and n >= 3",
    "tone_percentiles": "select quantile_cont(tone, 0.5) as p50, quantile_disc(tone, 0.95) as p95 from docs where tone is not null",
    "uri_layers": "select uri, doc_id, row_number() over (partition by uri order by collected_at, doc_id) - 1 as layer from docs",
    "merge_longest_text": f"with {MERGED} select uri, doc_id, f.source, l.text, l.domain, l.country, case when f.source in ('gkg', 'gdelt') then l.tone end as tone, arrivals, longest > length(f.text) or l.domain is distinct from f.domain or l.country is distinct from f.country or (f.source in ('gkg', 'gdelt') and l.tone is distinct from f.tone) as enriched from f join l using (uri)",
    "reach_max": f"with {MERGED} select uri, " + ", ".join(f"case when f.source = 'bluesky' then l.{c} else f.{c} end as {c}" for c in ("reach_likes", "reach_reposts", "reach_replies", "reach_quotes")) + " from f join l using (uri)",
    "retention_trim": f"with {BASE} select doc_id, person_id from p where doc_id in (select doc_id from docs where {since(14)})",
    "tracked_only": f"with {BASE} select doc_id, source from docs where doc_id in (select doc_id from p)",
    "purge_source": f"with {BASE} select doc_id, term_id from t where doc_id in (select doc_id from docs where source is distinct from 'gkg')",
    "purge_kind": "select doc_id, len(list_filter(extra_terms, lambda x: x.kind is distinct from 'org')) as n_extra from docs",
    "orphan_terms": f"with {BASE} select term_id, kind, term from v where term_id not in (select term_id from t)",
    "backfill": "select doc_id, coalesce(domain, case when source <> 'bluesky' then lower(regexp_replace(regexp_extract(uri, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '')) end) as domain, coalesce(country, case when coalesce(domain, case when source <> 'bluesky' then lower(regexp_extract(uri, '^[a-z]+://([^/?#]+)', 1)) end) like '%.pt' then 'pt' when coalesce(domain, case when source <> 'bluesky' then lower(regexp_extract(uri, '^[a-z]+://([^/?#]+)', 1)) end) like '%.br' then 'br' end) as country, least(length(text), 20000)::bigint as n_chars from docs",
    "unscored_pairs": f"with {BASE} select doc_id, person_id from p where doc_id % 3 <> 0",
    "export_docs": f"with {BASE}, g as (select doc_id, string_agg(person_id, ',' order by person_id) as persons from p group by 1) select doc_id, source, uri, coalesce(persons, '') as persons from docs left join g using (doc_id)",
}
