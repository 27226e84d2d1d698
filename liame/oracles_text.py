"""SQL of the text functions, built up from their definitions rather than from the columns that compute them."""

from __future__ import annotations

from html.entities import html5

from liame.functions.text import PARTICLES, STOPWORDS

BLANK = r"\s\x0b\p{Z}\x{85}\x{1c}-\x{1f}"
_LIST = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_NAMES = {f"&{k}": v for k, v in html5.items() if k.endswith(";")}
ENTITIES = f"map([{', '.join(map(_QUOTED, _NAMES))}], [{', '.join(map(_QUOTED, _NAMES.values()))}])"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def keeps(w: str) -> str:
    thrice = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz0123456789")
    return f"(length({w}) >= 4 and not regexp_full_match({w}, '[0-9]+') and not regexp_full_match({w}, '(ha|he|hu|hi|rs|ks)+') and not regexp_matches({w}, '{thrice}') and {w} not in ({_LIST(STOPWORDS)}))"


# Texts cut into entities and what stands between, the entities looked up, and all put together again.
DECODED = f"""ent as (select {ENTITIES} as known),
cut as (select doc_id, unnest(x) as part, unnest(range(len(x))) as i from (select doc_id, regexp_extract_all(text, '&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});|[^&]+|&') as x from docs where contains(text, '&'))),
glued as (select doc_id, string_agg(case when part[1] <> '&' or length(part) < 3 then part
  when regexp_full_match(part, '&#[0-9]+;') then chr(part[3:-2]::int) when regexp_full_match(part, '&#[xX][0-9a-fA-F]+;') then chr(('0x' || part[4:-2])::int)
  else coalesce(known[part], part) end, '' order by i) as text from cut, ent group by 1),
dec as (select doc_id, coalesce(glued.text, docs.text) as text from docs left join glued using (doc_id))"""
CLEAN = f"{DECODED}, clean as (select doc_id, regexp_replace(regexp_replace(text, 'https?://[^{BLANK}]+', ' ', 'g'), '[#@][^{BLANK}]+', ' ', 'g') as text from dec where text is not null)"
WORDS = f"{CLEAN}, words as (select doc_id, list_filter(string_split_regex({fold('text')}, '[^a-z0-9]+'), lambda w: {keeps('w')}) as ws from clean)"
BREAKS = ',:;|—–"“”«»()\\[\\]'
# Runs of capitalised words: islands of tokens that are capitalised or particles, from their first capital to their last name word.
RUNS = f"""{WORDS}, sentences as (select doc_id, unnest(x) as st, unnest(range(len(x))) as s from (select doc_id, string_split_regex(text, '[.!?\\n\\r]+') as x from clean)),
lists as (select doc_id, s, list_filter(string_split_regex(regexp_replace(st, '([{BREAKS}])', ' \\1 ', 'g'), '[{BLANK}]+'), lambda x: x <> '') as l from sentences),
tokens as (select doc_id, s, unnest(l) as tok, unnest(range(1, len(l) + 1)) as i from lists),
sorts as (select *, case when tok in ({_LIST(PARTICLES)}) then 'p' when not regexp_full_match(tok, '\\p{{Lu}}[\\p{{L}}''’-]*') then 'x' when lower(tok) in ({_LIST(PARTICLES)}) then 'D' else 'C' end as k from tokens),
islands as (select *, sum((k = 'x')::int) over (partition by doc_id, s order by i) as g from sorts),
ends as (select doc_id, s, g, min(i) filter (k in ('C', 'D')) as a, max(i) filter (k = 'C') as z, count(*) filter (k = 'C') as n from islands where k <> 'x' group by 1, 2, 3),
runs as (select doc_id, s, g, string_agg(tok, ' ' order by i) as run from islands join ends using (doc_id, s, g) where k <> 'x' and n >= 2 and a > 1 and i between a and z group by 1, 2, 3),
named as (select distinct doc_id, {fold('run')} as term, list_filter(string_split({fold('run')}, ' '), lambda w: w not in ({_LIST(PARTICLES)})) as ws from runs where run <> upper(run)),
phr as (select doc_id, term, list_filter(ws, lambda w: {keeps('w')}) as kept from named where len(list_filter(ws, lambda w: {keeps('w')})) between 2 and 4 and len(list_filter(ws, lambda w: w in ({_LIST(STOPWORDS)}))) = 0),
joined as (select distinct doc_id, unnest(kept[:-2]) as w1, unnest(kept[2:]) as w2 from phr),
stage as (select u.doc_id, i, u.w1, case when j.doc_id is null then u.w2 end as w2 from (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w1, unnest(list_append(ws[2:], null)) as w2 from words where len(ws) > 0) u left join joined j on j.doc_id = u.doc_id and j.w1 = u.w1 and j.w2 = u.w2)"""
LEXICON = """uni as (select w1 as w, count(*) as c from stage group by 1),
duo as (select w1, w2, count(*) as n from stage where w2 is not null group by 1, 2 having count(*) >= 5)"""
COVERED = """known as (select doc_id, i, w1 || ' ' || w2 as term from stage where w2 is not null and w1 || ' ' || w2 in (select term from phrases)),
covered as (select doc_id, i from known union select doc_id, i + 1 from known
  union select doc_id, place + unnest(range(n)) from (select w.doc_id, st.i as place, len(kept) as n from words w join stage st using (doc_id) join phr using (doc_id) where st.w1 = kept[1] and ws[st.i:st.i + len(kept) - 1] = kept))"""
TAGGED = """al as (select min(id) as id, a from (select id, lower(strip_accents(unnest(aliases))) as a from persons) where a <> '' group by 2),
ordered as (select row_number() over (order by length(a) desc, a) as k, id, a from al),
steps as (select list(struct_pack(k := k, a := '(^|[^a-z0-9])' || regexp_replace(a, '([.*+?^${}()|\\[\\]\\\\-])', '\\\\\\1', 'g') || '($|[^a-z0-9])') order by k) as l from ordered),
marked as (select doc_id, list_reduce(list_prepend(struct_pack(k := 0::bigint, a := lower(strip_accents(text))), l), lambda x, y: struct_pack(k := 0::bigint,
  a := regexp_replace(regexp_replace(x.a, y.a, '\\1' || chr(1) || y.k || chr(2) || '\\2', 'g'), y.a, '\\1' || chr(1) || y.k || chr(2) || '\\2', 'g'))).a as text from dec, steps where text is not null)"""
TOKENS = f"""with chunks as (select doc_id, unnest(list_filter(string_split_regex(text, '[{BLANK}]+'), lambda x: x <> '')) as c from docs where text is not null),
sized as (select doc_id, length(regexp_replace(c, '[\\p{{L}}\\p{{N}}]', '', 'g')) as symbols, contains(c, '://') as link, regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]+') as ws from chunks),
cost as (select doc_id, symbols + coalesce(list_sum(list_transform(ws, lambda w: case when regexp_full_match(w, '\\p{{N}}+') then ceil(length(w) / 2.0) when not regexp_full_match(w, '\\p{{L}}+') then 1 + floor(length(w) / 2.0)
  when link or symbols >= 3 then ceil(length(w) / 3.0) when length(w) > 1 and w = upper(w) then floor(length(w) * 0.7 + 0.5) when w = lower(w) then ceil(length(w) / 8.0) else ceil(length(w) / 6.0) end)), 0) as n from sized)
select doc_id, coalesce(sum(n), 0)::bigint as tokens from (select doc_id from docs where text is not null) left join cost using (doc_id) group by 1"""

SQL: dict[str, str] = {
    "normalize_text": f"select doc_id, {fold('text')} as folded from docs",
    "hashtags": f"select distinct doc_id, {fold('w')} as term from (select doc_id, unnest(regexp_extract_all(text, '#([\\p{{L}}\\p{{N}}_]+)', 1)) as w from docs)",
    "decode_entities": f"with {DECODED} select doc_id, text from dec",
    "content_words": f"with {WORDS} select distinct doc_id, unnest(ws) as term from words",
    "word_pairs": f"with {RUNS} select doc_id, w1, w2 from stage",
    "phrase_lexicon": f"with {RUNS}, {LEXICON} select w1 || ' ' || w2 as term, n as count, round((n / least(a.c, b.c)::double)::decimal(38, 15), 4)::double as score from duo join uni a on a.w = w1 join uni b on b.w = w2 where n / least(a.c, b.c)::double >= 0.35",
    "collocations": f"with {RUNS} select distinct doc_id, w1 || ' ' || w2 as term from stage where w2 is not null and w1 || ' ' || w2 in (select term from phrases)",
    "proper_nouns": f"with {RUNS} select doc_id, term from phr",
    "untracked_names": f"""with {RUNS}, given as (select doc_id, {fold('run')} as name from runs join docs using (doc_id) where source is distinct from 'gkg'
  union all select doc_id, trim(regexp_replace({fold('n')}, '\\s+', ' ', 'g')) from (select doc_id, unnest(extra_names) as n from docs where source = 'gkg' and text is not null))
select distinct doc_id, name from given where name <> '' and name not in (select trim(regexp_replace({fold('a')}, '\\s+', ' ', 'g')) from (select unnest(aliases) as a from persons))""",
    "doc_terms_build": f"""with {RUNS}, {COVERED} select distinct doc_id, kind, term from (
  select doc_id, 'hashtag' as kind, {fold('w')} as term from (select doc_id, unnest(regexp_extract_all(text, '#([\\p{{L}}\\p{{N}}_]+)', 1)) as w from docs)
  union all select doc_id, 'word', w1 from stage where (doc_id, i) not in (select (doc_id, i) from covered)
  union all select doc_id, 'phrase', term from phr union all select doc_id, 'phrase', term from known
  union all select doc_id, e.kind, e.term from (select doc_id, unnest(extra_terms) as e from docs where text is not null))""",
    "entity_tagging": f"with {DECODED}, {TAGGED} select distinct doc_id, id as person_id from marked, ordered where contains(text, chr(1) || k || chr(2))",
    "token_sizes": TOKENS,
}
