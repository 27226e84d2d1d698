"""SQL of the routes' relations, with the parameters that the catalogue asks."""

from __future__ import annotations

from liame import oracles as o
from liame.oracles import BASE, BR, FOLDED_DAY, OUTLET, RANK, SCORES, SHOWN, VIEWS, A, B, links, r2, scored, since, timeline

_NAMED = lambda words: ", ".join(f"'{w}'" for w in words)
LEFT = _NAMED(("folhetimselhapuce.pt", "gazetaficagece.jor.br", "diariotrunhimice.jor.br", "correiorobelice.jor.br"))
KIND = "kind in ('word', 'phrase')"
GRAPH = f"with {BASE}, {scored('', A, since(7))}, top as (select * from x where count >= 2 and {KIND} order by {RANK} desc, term, kind limit 20), {SCORES}, z as (select doc_id, score from m join sc using (doc_id) where sc.person_id = '{A}' and score is not null)"
SIDED = ["rss", "gnews", "gkg"]


def hops(edges: str, most: int = 10) -> str:
    """Betweenness of an unweighted graph: numbers of shortest paths level by level, then the share of pairs that each node stands between."""
    out = [f"ed as (select s as x, t as y from {edges} union select t, s from {edges})", "d0 as (select distinct x as s, x as v, 0 as d, 1.0::double as p from ed)", "r0 as (select s, v from d0)"]
    for k in range(1, most + 1):
        out.append(f"d{k} as (select d.s, e.y as v, {k} as d, sum(p) as p from d{k - 1} d join ed e on e.x = d.v where (d.s, e.y) not in (select (s, v) from r{k - 1}) group by 1, 2)")
        out.append(f"r{k} as (select s, v from r{k - 1} union all select s, v from d{k})")
    out.append("paths as (" + " union all ".join(f"select * from d{k}" for k in range(most + 1)) + ")")
    out.append("""between as (select a.v, sum(a.p * b.p / w.p) / 2 as b from paths a join paths b on a.v = b.s join paths w on w.s = a.s and w.v = b.v and w.d = a.d + b.d where a.v <> a.s and b.v <> b.s group by 1),
shares as (select v as node, case when (select max(b) from between) > 0 then coalesce(b, 0) / (select max(b) from between) else 0.0 end as bridge from (select distinct x as v from ed) left join between using (v))""")
    return ", ".join(out)


def sides(limit: int, where: str) -> str:
    keys = " union ".join(f"(select term, kind from x{s} order by {order}, term, kind limit {limit})" for s in "ab" for order in ("count desc", f"{RANK} desc"))
    return f"""with {BASE}, {scored('a', A, where)}, {scored('b', B, where)}, keys as ({keys}),
g as (select term, kind, xa.count as a_count, {r2('xa.pmi')} as a_pmi, {r2('xa.tone')} as a_tone, xb.count as b_count, {r2('xb.pmi')} as b_pmi, {r2('xb.tone')} as b_tone,
  {o.named(A)} as is_name_a, {o.named(B)} as is_name_b from keys left join xa using (term, kind) left join xb using (term, kind))"""


LENS_A, LENS_B = f"{since(21)} and {BR} and source = 'rss'", f"{since(21)} and {BR} and domain in ('folhetimselhapuce.pt', 'diariotrunhimice.jor.br')"
_OWN, _WORD = o.named(A), "kind = 'word'"
_LENS_KEYS = " union ".join([f"(select term, kind from x{s} where {_WORD} and not {_OWN} order by {order}, term, kind limit 12)" for s in "ab" for order in ("count desc", f"{RANK} desc")] + [f"(select term, kind from x{s} where {_WORD} and {_OWN} order by count desc, term, kind limit 12)" for s in "ab"])
PAIR = f"{since(21)} and {BR} and source in ({_NAMED(SIDED)})"
RISING = f"""with {BASE}, d as (select doc_id, {since(7)} as recent, reach_reposts from docs join p using (doc_id) where person_id = '{A}' and {since(21)} and {BR}),
k as (select term_id, count(*) filter (where recent) as c_recent, count(*) filter (where not recent) as c_baseline, sum(reach_reposts) filter (where recent)::bigint as reach from t join d using (doc_id) group by 1),
c as (select term, kind, c_recent, c_baseline, reach from k join v using (term_id) where not {_OWN} and kind in ('word', 'hashtag')),
g as (select term, kind, {r2('c_recent / 7.0::double')} as count_recent, {r2('c_baseline / 14.0::double')} as count_baseline, c_recent as count_recent_raw, c_baseline as count_baseline_raw,
  {r2('(c_recent / 7.0::double) / ((c_baseline + 1) / 14.0::double)')} as lift, reach from c where c_recent >= 2)"""
DOCS = f"with {BASE}, m as (select docs.* from docs join p using (doc_id) where person_id = '{A}' and {since(21)} and {BR})"
IN_WEEK = f"{FOLDED_DAY} >= date '2026-08-24' and {FOLDED_DAY} < date '2026-08-31'"
WEEK = lambda where: f"with {BASE}, d as (select doc_id, {FOLDED_DAY} as day from docs join p using (doc_id) where person_id = '{A}' and published_at >= timestamp '2026-08-25 03:00:00' and {where})"
CANDIDATES = f"""with c as (select distinct doc_id, name from doc_candidates), d as (select *, {since(21)} as recent from docs where {since(42)}),
g as (select name, count(*) filter (where recent) as count, count(distinct source) filter (where recent) as sources, count(*) filter (where not recent) as previous
  from c join d using (doc_id) group by 1 having count(*) filter (where recent) >= 3 order by count desc, name limit 20)"""
_SLOTS = "slots as (select i as slot, date '2026-08-31' - (7 * (3 - i))::int as week from range(4) r(i))"
HISTORY = f"""{o.term_weeks(12)}, h as (select * from g where person_id = '{A}'), {_SLOTS},
z as (select term, kind, slot, count from (select distinct term, kind from h where week >= date '2026-08-10') cross join slots left join h using (term, kind, week)),
st as (select term, kind, max(slot) filter (where count is null and slot <= start) as gap, any_value(start) as start from (select *, case when max(count) filter (slot = 3) over (partition by term, kind) is null then 2 else 3 end as start from z) group by 1, 2),
pk as (select *, max(slot) filter (where count = top) over (partition by term, kind) as peak from (select *, max(count) over (partition by term, kind) as top from z where slot < 3)),
fl as (select term, kind, any_value(peak) as peak, min(slot) filter (where slot > peak and coalesce(count, 0) <= top / 2.0) as fall from pk group by 1, 2),
tt as (select term, kind, count(count) as weeks_present, sum(count)::bigint as total, string_agg(coalesce(count::varchar, '-'), ',' order by slot) as series from z group by 1, 2)"""
COMENTION_LEAN = f"""with {BASE}, d as (select doc_id from docs where {since(7)} and {BR} and domain in ({LEFT}, 'jornalgalhunoce.jor.br'))
select a.person_id as a, b.person_id as b, count(*) as count from p a join p b on a.doc_id = b.doc_id and a.person_id < b.person_id where a.doc_id in (select doc_id from d) group by 1, 2"""
AGENDA = f"""with {BASE}, d as (select doc_id, {OUTLET} as domain from docs where {since(7)} and {BR} and source in ('rss', 'gnews')), r as (select * from d join p using (doc_id) where domain is not null),
o as (select domain, count(distinct doc_id) as total from r group by 1 having count(distinct doc_id) >= 2 order by total desc, domain limit 30)
select person_id, domain, count(*) as docs, {r2('count(*)::double / any_value(total)')} as share from r join o using (domain) group by 1, 2"""
TONE = f"with {BASE}, g as (select person_id, domain, {r2('avg(tone)')} as tone, count(tone) as n from docs join p using (doc_id) where {since(7)} and domain is not null and tone is not null and person_id in (select id from persons) group by 1, 2)"
SOURCES = f"{OUTLET} as domain, source, count(*) as docs, {r2('avg(tone)')} as tone, count(tone) as tone_n"
PERSON_OUTLETS = lambda days: f"""o{days} as (select {days}::bigint as days, k.person_id, domain, kind, term, c_pt, {o.pmi('c_pt', 'tracked', 'about', 'c_t')} * ln(1.0 + c_pt) as key from
  (select person_id, {OUTLET} as domain, term_id, count(*) as c_pt from docs join p using (doc_id) join t using (doc_id) where {since(days)} and {BR} and {OUTLET} <> '' group by 1, 2, 3 having count(*) >= 3) k
  join v using (term_id) join (select term_id, count(*) as c_t from t where doc_id in (select doc_id from docs where {since(days)} and {BR}) and doc_id in (select doc_id from p) group by 1) using (term_id)
  join (select person_id, count(*) as about from p join docs using (doc_id) where {since(days)} and {BR} group by 1) ab on ab.person_id = k.person_id
  join (select count(*) as tracked from docs where {since(days)} and {BR} and doc_id in (select doc_id from p)) on true
  left join own on own.person_id = k.person_id where not coalesce(list_has_any(string_split(term, ' '), names), false))"""  # noqa: E731
OUTLETS_BUILT = f"""with {BASE}, {PERSON_OUTLETS(7)}, {PERSON_OUTLETS(21)},
sets as (select days, person_id, domain, kind, term, c_pt from (select * from o7 union all select * from o21) qualify row_number() over (partition by days, person_id, domain order by key desc, term, kind) <= 40),
sz as (select days, person_id, domain, count(*) as size from sets group by 1, 2, 3),
sh as (select a.days, a.person_id, a.domain as a, b.domain as b, count(*) as shared from sets a join sets b on a.days = b.days and a.person_id = b.person_id and a.kind = b.kind and a.term = b.term and a.domain < b.domain group by 1, 2, 3, 4),
e as (select sh.days, sh.person_id, a, b, shared / (x.size + y.size - shared)::double as similarity from sh join sz x on x.days = sh.days and x.person_id = sh.person_id and x.domain = a join sz y on y.days = sh.days and y.person_id = sh.person_id and y.domain = b),
nb as (select days, person_id, domain, neighbor, similarity, row_number() over (partition by days, person_id, domain order by similarity desc, neighbor) as rn
  from (select days, person_id, a as domain, b as neighbor, similarity from e union all select days, person_id, b, a, similarity from e) qualify rn <= 5)"""

SQL: dict[str, str] = {
    "build_outlet_terms": f"{OUTLETS_BUILT} select * from sets",
    "build_outlet_neighbors": f"{OUTLETS_BUILT} select * from nb",
    "bridges": f"{o.MAP}, {o.TOP40}, mb as (select s.* from s join p using (doc_id) where person_id = '{B}'), {links('m', '1')}, {links('mb', '2')}, me as (select s, t from l1 union select s, t from l2), {hops('me')} select 'a/b' as pair, node, bridge from shares",
    "route_people": "select id, name, array_to_string(aliases, ',') as aliases, party, office, uf from persons",
    "route_graph_stats": f"{GRAPH} select (select count(*) from s) as docs, n.n as tracked, n_p as about, (select {r2('avg(score)')} from z) as score, (select count(*) from z) as n from n",
    "route_graph_nodes": f"{GRAPH}, tt as (select kind, term, {r2('avg(score)')} as score, count(*) as n from z join t using (doc_id) join v using (term_id) join top using (kind, term) group by 1, 2) select {SHOWN}, score, n from top left join tt using (kind, term)",
    "route_graph_links": f"{GRAPH}, {links('m', '1')} select 'person:{A}' as s, kind || ':' || term as t, count from top union all select * from l1",
    "route_graph_signature": f"{GRAPH} select term, kind, count, {r2('pmi')} as pmi from x where count >= greatest(3.0, n_p * 0.05) order by 4 desc, term, kind limit 5",
    "route_graph_outlets": f"select domain, lean from {o.LEANS} where lean in ('left', 'right')",
    "route_graph_communities": f"{o.MAP} select kind, term from (select * from x where count >= 2 order by count desc, term, kind limit 200)",
    "route_sources": f"{OUTLETS_BUILT}, m as (select docs.* from docs join p using (doc_id) where person_id = '{A}' and {since(21)} and {BR}), g as (select {SOURCES} from m group by 1, 2 order by docs desc, domain nulls last, source limit 80), ng as (select domain, string_agg(neighbor, ',' order by rn) as neighbors from nb where days = 21 and person_id = '{A}' group by 1) select g.domain, source, docs, tone, tone_n, lean, neighbors from g left join {o.LEANS} on leans.domain = g.domain left join ng on ng.domain = g.domain",
    "route_sources_lean": f"with {BASE}, m as (select docs.* from docs join p using (doc_id) where person_id = '{A}' and {since(7)} and domain in ({LEFT})), g as (select {SOURCES} from m group by 1, 2 order by docs desc, domain nulls last, source limit 80) select g.domain, source, docs, lean, true as no_field from g left join {o.LEANS} on leans.domain = g.domain",
    "route_docs_total": f"{DOCS} select count(*) as total from m where doc_id in (select doc_id from t join v using (term_id) where term = 'governo' and kind = 'word') and {IN_WEEK}",
    "route_docs_page": f"{DOCS} select doc_id, source, domain, published_at, text, uri, tone from m where {IN_WEEK} order by published_at desc, doc_id desc limit 18 offset 50",
    "route_docs_with": f"{DOCS} select doc_id, uri from m where doc_id in (select doc_id from p where person_id = '{B}') and {FOLDED_DAY} = date '2026-08-30' order by published_at desc, doc_id desc limit 100",
    "route_timeline": f"with {BASE}, m as (select docs.* from docs join p using (doc_id) where person_id = '{A}' and {since(7)} and {BR} and source in ('rss', 'gnews') and doc_id in (select doc_id from t join v using (term_id) where term = 'governo')), {timeline('m', 7, 1)}",
    "route_week_about": f"{WEEK(BR + chr(32) + 'and source = ' + repr('rss'))}, g as (select date '2026-08-31' - i::int as day from range(7) r(i)), a as (select day, count(*) as about from d group by 1) select day, day::timestamp + interval 3 hour as start, coalesce(about, 0) as about from g left join a using (day)",
    "route_week_terms": f"{WEEK('true')}, k as (select day, term_id, count(*) as count from t join d using (doc_id) group by 1, 2), g as (select day, row_number() over (partition by day order by count desc, term, kind)::int as rn, term, kind, count from k join v using (term_id) where kind = 'word' and not {_OWN}) select * from g where rn <= 5",
    "route_week_testimony": f"{WEEK(BR + chr(32) + 'and source = ' + repr('rss'))}, {SCORES} select day, {r2('avg(score)')} as score, count(score) as n from d join sc using (doc_id) where person_id = '{A}' and score is not null group by 1",
    "route_rising_terms": f"{RISING} select * from g order by lift desc, term, kind limit 12",
    "route_rising_present": f"{RISING} select * from g order by count_recent_raw desc, lift desc, term, kind limit 12",
    "route_rising_about": f"{RISING} select (select count(*) from d where recent) as about_recent, (select count(*) from d where not recent) as about_baseline, coalesce((select sum(c_recent) from c), 0)::bigint as words_recent, coalesce((select sum(c_baseline) from c), 0)::bigint as words_baseline",
    "route_testimony": f"""with {BASE}, {SCORES}, e as (select source, {OUTLET} as domain, score from docs join sc using (doc_id) where person_id = '{A}' and {since(7)} and source in ('rss', 'gkg')),
u as (select source, domain, grouping(source) as gs, grouping(domain) as gd, {r2('avg(score)')} as score, count(score) as n from e group by grouping sets ((), (source), (domain, source))),
w as (select case when gs = 1 and gd = 1 then 'overall' when gd = 1 then 'source' else 'domain' end as level, source, domain, score, n from u)
select * from w where level = 'overall' or (level = 'source' and n >= 1) or (level = 'domain' and domain is not null and n >= 1)""",
    "route_lenses": f"""with {BASE}, {scored('a', A, LENS_A, False)}, {scored('b', A, LENS_B, False)}, keys as ({_LENS_KEYS})
select term, kind, xa.count as a_count, {r2('xa.pmi')} as a_pmi, {r2('xa.tone')} as a_tone, xb.count as b_count, {r2('xb.pmi')} as b_pmi, {r2('xb.tone')} as b_tone, {_OWN} as is_name from keys left join xa using (term, kind) left join xb using (term, kind)""",
    "route_lenses_about": f"with {BASE}, {scored('a', A, LENS_A, False)}, {scored('b', A, LENS_B, False)} select (select count(*) from ma) as about_a, (select count(*) from mb) as about_b",
    "route_attention": f"with {BASE}, {VIEWS} select day, views from views where person_id = '{A}' and day >= date '2026-08-25'",
    "route_persistence_terms": f"{HISTORY} select '{A}' as person_id, term, kind, series, (start - coalesce(gap, -1))::bigint as streak, (fall - peak)::bigint as half_life, weeks_present, total from tt join st using (term, kind) join fl using (term, kind) where weeks_present > 0 order by streak desc, weeks_present desc, total desc, term, kind limit 30",
    "route_persistence_info": f"{o.term_weeks(12)} select min(week) as first_week, date '2026-09-09' as since, 21 as horizon from g where person_id = '{A}'",
    "route_compare": f"""{sides(20, PAIR)}, top as (select kind, term from g where not (is_name_a or is_name_b) order by coalesce(a_count, 0) + coalesce(b_count, 0) desc, kind || ':' || term limit 60),
{links('ma', '1')}, {links('mb', '2')}, me as (select s, t from l1 union select s, t from l2), {hops('me')} select g.*, round(coalesce(bridge, 0), 9) as bridge from g left join shares on node = kind || ':' || term""",
    "route_compare_about": f"{sides(20, PAIR)} select (select count(*) from ma) as about_a, (select count(*) from mb) as about_b",
    "route_tone": f"{TONE} select * from g",
    "route_tone_domains": f"{TONE} select distinct domain from g",
    "route_agenda": AGENDA,
    "route_candidates": f"{CANDIDATES} select * from g",
    "route_candidate_samples": f"{CANDIDATES}, s as (select name, doc_id, (row_number() over (partition by name order by published_at desc, doc_id desc))::int as rn from c join docs using (doc_id) where name in (select name from g) and {since(21)}) select name, rn, doc_id from s where rn <= 3",
    "route_comention": COMENTION_LEAN,
}
