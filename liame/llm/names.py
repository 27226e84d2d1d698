"""Spellings of names that people typed, attached to the form they most probably stand for.

Noisy-channel attribution. Spellings are folded to forms; a form's frequency is
its prior. What people do to a name (typos, initials, nicknames, abbreviations,
dropped middle names, joined words) has a likelihood. Every form is attached to
the candidate of higher standing with the largest posterior, if that beats the
form being a name of its own and no other person explains it nearly as well.
Candidates come from joins on keys of the surname, never from all pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liame.llm.components import connected_components
from liame.llm.visual import LOOKS_LIKE
from liame.plans.lineage import cut, release
from liame.plans.parallel import tasks
from liame.sources.tables import load

COMMON = 0.008  # share of spellings from which on a word is a given name or a kind of organisation
TRACKED = 20.0  # documents by which a known spelling's prior is raised
# Logarithms of the likelihoods of what a typist does, before any known pair is seen.
PRIOR = {"exact": 0.0, "typo": -3.0, "initial": -3.0, "nick": -2.0, "short": -2.0, "dropped": -2.0, "added": -4.0, "joined": -2.5, "reordered": -4.0}
WEIGHT = 400.0  # known pairs that count as much as PRIOR does
UNRELATED = -12.0  # of an unrelated name looking so alike
CROWDED = 300  # forms of a surname block from which on it is split by given name, then by middle words
IMPOSSIBLE = -99.0
MARGIN = 1.5  # by how much the best explanation must beat another person's
TITLES = set("dr dra dep sen gov ver prof profa sr sra min pres des eng adv rev pe".split())
ENDINGS = set("ltda sa me eireli".split())
PARTICLES = set("de da do dos das e del".split())
LATIN = {ord(x[0]): x[1] for x in LOOKS_LIKE}
# Given names and their usual short forms.
NICKNAMES = """
jose: ze zeca zezinho juca; francisco: chico chiquinho fran kiko; antonio: tonho toninho tonico tom; joaquim: quincas quim joca;
raimundo: mundico mundinho rai; rodrigo: digo drigo rod; conceicao: ceica sao; roberto: beto betinho rob; eduardo: dudu du edu duda;
thereza: teca tete tere tereza; terezinha: teca tete tere zinha; sebastiao: tiao tiaozinho; leonardo: leo leozinho; mariana: mari nana;
cristina: cris tina; carlos: carlinhos caca cacau; leticia: lele le leti; fernando: nando fe fernandinho; manuel: maneco mane manu;
ana: aninha nana; beatriz: bia bea; isabel: bel isa belinha; luciana: lu lulu luci; helena: lena leninha; gabriela: gabi gaby;
frederico: fred fredi; gustavo: guga gu gus; philippe: lipe felipe filipe phil; walter: valtinho vavau; otavio: tavinho tavo tata;
paulo: paulinho; vicente: vicentinho vice cente; debora: deb debinha dea; patricia: pati paty tricia; sonia: soninha so;
livia: livinha liv; ines: nezinha nene; ruth: rute rutinha; tomas: tomazinho; cicero: cico cicinho; joao: joca jo juca; maria: mia;
pedro: pedrinho; luis: lula luisinho; antonia: tonia toninha; francisca: chica; jorge: jorginho; ricardo: cacá; alexandre: xande ale
"""


def fold(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name.translate(LATIN).lower()) if unicodedata.category(c) not in ("Mn", "Cf"))


def sound(word: str) -> str:
    """A word without the spelling differences that can't be heard."""
    for a, b in (("y", "i"), ("k", "c"), ("w", "v"), ("z", "s"), ("q", "c")):
        word = word.replace(a, b)
    return word


FULL: dict[str, set[str]] = {}  # short form -> given names, as they sound
for _entry in re.split("[;\n]", NICKNAMES):
    if ":" in _entry:
        _name, _shorts = _entry.split(":")
        for _s in _shorts.split():
            FULL.setdefault(sound(fold(_s)), set()).add(sound(fold(_name.strip())))


def parse(name: str, common: set[str]) -> list[str]:
    """The words of a name as they sound, given name first and surname last, without titles, particles and legal endings.

    A comma, or a word other than the first that usually stands first (``common``), tells that the surname stands first.
    """
    text = fold(name)
    head, comma, rest = text.partition(",")
    words = lambda t: [w for w in re.split(r"[^a-z0-9]+", t) if w]
    tokens = words(rest) + words(head) if comma and words(rest) and words(rest)[0] not in ENDINGS else words(text)
    while len(tokens) > 1 and tokens[0] in TITLES:
        tokens = tokens[1:]
    while len(tokens) > 2 and tokens[-1] in ENDINGS:
        tokens = tokens[:-1]
    tokens = [sound(t) for i, t in enumerate(tokens) if not i or t not in PARTICLES]
    if not comma and len(tokens) > 2 and tokens[0] not in common and tokens[0] not in FULL and len(tokens[0]) > 3 and (tokens[1] in common or tokens[1] in FULL):
        tokens = tokens[1:] + tokens[:1]
    return tokens


def near(a: str, b: str) -> bool:
    """Whether one typo (a letter added, left out, changed, or two neighbours swapped) makes ``a`` of ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


Channel = dict[str, float]  # what a typist does -> logarithm of its likelihood
Way = tuple[float, tuple[str, ...]]  # logarithm of a likelihood, and what was done
NO_WAY: Way = (IMPOSSIBLE, ())


def _one(channel: Channel, *done: str) -> Way:
    return sum(channel[x] for x in done), done


def _both(a: Way, b: Way) -> Way:
    return (a[0] + b[0], a[1] + b[1]) if a[0] > IMPOSSIBLE and b[0] > IMPOSSIBLE else NO_WAY


def _word(v: str, c: str, given: bool, ch: Channel, either: bool = False) -> Way:
    """How a word ``c`` was typed as ``v`` (``either``: or ``v`` as ``c``)."""
    if either:
        return max(_word(v, c, given, ch), _word(c, v, given, ch))
    if v == c:
        return _one(ch, "exact")
    if len(v) == 1:
        return _one(ch, "initial") if c[0] == v else NO_WAY
    if given and c in FULL.get(v, ()):
        return _one(ch, "nick")
    if len(v) >= 3 and len(c) > len(v) + 1 and c.startswith(v):
        return _one(ch, "short")
    if min(len(v), len(c)) >= 2 and max(len(v), len(c)) >= 3 and near(v, c):
        return _one(ch, "typo")
    return NO_WAY


def _inner(v: list[str], c: list[str], ch: Channel, either: bool = False) -> Way:
    """The words between given name and surname, in order; the shorter list may lack some.

    Filled row by row: ``best[j]`` is the best way to match the first ``j``
    words of the shorter list with a beginning of the longer.
    """
    swapped = len(v) > len(c)
    short, long = (c, v) if swapped else (v, c)
    skip = _one(ch, "added" if swapped else "dropped")
    spare = len(long) - len(short)
    best: list[Way] = [(0.0, ())] + [NO_WAY] * len(short)
    for i, word in enumerate(long):
        for j in range(min(i + 1, len(short)), -1, -1):
            way = _both(best[j], skip) if i - j < spare else NO_WAY
            if j:
                own = _word(word, short[j - 1], False, ch, either) if swapped else _word(short[j - 1], word, False, ch, either)
                way = max(way, _both(best[j - 1], own))
            best[j] = way
    return best[-1]


def acronyms(c: list[str]) -> set[str]:
    """What a name of three to five words may be called by the beginnings of its words: of each the first letter, of up to two of them up to three, eight in all."""
    if not 3 <= len(c) <= 5:
        return set()
    out = {("", 0)}
    for i, w in enumerate(c):
        left = len(c) - 1 - i
        out = {(a + w[:k], n + (k > 1)) for a, n in out for k in range(1, min(3, len(w)) + 1) if n + (k > 1) <= 2 and len(a) + k + left <= 8}
    return {a for a, _ in out}


def explain(v: list[str], c: list[str], ch: Channel, either: bool = False) -> Way:
    """How the name ``c``, of two words or more, was typed as ``v`` (``either``: how both may stand for one name)."""
    if not v or len(c) < 2:
        return NO_WAY
    whole = "".join(c)
    if len(v) == 1:
        if v[0] == whole:
            return _one(ch, "joined", "joined")
        return _one(ch, *["initial"] * len(c)) if 3 <= len(v[0]) <= 8 and v[0] in acronyms(c) else NO_WAY
    best, typed = NO_WAY, "".join(v)
    if v != c and len(v) < len(c) and (typed == whole or near(typed, whole)):
        best = _one(ch, "joined", "exact" if typed == whole else "typo")
    last = _word(v[-1], c[-1], False, ch, either) if len(v[-1]) > 1 else NO_WAY
    if last[0] > IMPOSSIBLE:
        given = _word(v[0], c[0], True, ch, either)
        if given[0] > IMPOSSIBLE:
            best = max(best, _both(_both(given, last), _inner(v[1:-1], c[1:-1], ch, either)))
        if len(v) == 2 and len(c) > 2:
            if len(v[0]) == len(c) - 1 and v[0] == "".join(w[0] for w in c[:-1]):
                best = max(best, _both(_one(ch, *["initial"] * (len(c) - 1)), last))
            both = "".join(c[:-1])
            if v[0] == both or near(v[0], both):
                best = max(best, _both(_one(ch, "joined", "exact" if v[0] == both else "typo"), last))
    return best


def likelihood(v: list[str], c: list[str], either: bool = False, channel: Channel = PRIOR) -> float:
    return explain(v, c, channel, either)[0]


def readings(tokens: list[str]) -> list[list[str]]:
    """The orders in which the words of a form may be meant: as they stand, surname moved last, surname moved first.

    ``parse`` undoes a reordering only where a common given name tells it.
    """
    return [tokens, tokens[1:] + tokens[:1], tokens[-1:] + tokens[:-1]] if len(tokens) > 2 else [tokens]


def any_order(v: list[str], c: list[str], either: bool = False, channel: Channel = PRIOR) -> Way:
    """``explain`` of the best reading of ``v``."""
    own, *moved = readings(v)
    return max(explain(own, c, channel, either), *(_both(explain(r, c, channel, either), _one(channel, "reordered")) for r in moved), NO_WAY)


def _pieces(word: str) -> set[str]:
    """A word, and it with one letter left out: two words one typo apart share a piece."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _surname_keys(tokens: list[str]) -> set[str]:
    letters = {tokens[0][0], *(n[0] for n in FULL.get(tokens[0], ()))}
    return {f"s:{piece}:{x}" for piece in _pieces(tokens[-1]) for x in letters} if len(tokens) > 1 else set()


def keys(tokens: list[str], own: bool = True) -> set[str]:
    """Join keys: two forms that ``explain`` connects share one.

    The surname with at most one letter left out, with the first letters that
    the given name may have; the exact surname with the given name less one of
    its first two letters; of three words or more, initial, middle words and
    the surname's first letters; of a form's ``own`` order also all words joined
    with at most one letter left out, and the acronyms. Not covered: a typo in the given name's first letter
    together with one in the surname, and an abbreviated surname of a name of two words.
    """
    out = _surname_keys(tokens)
    if len(tokens) > 1:
        last, given = tokens[-1], tokens[0]
        out |= {f"t:{last}:{g}" for g in (given, given[1:], given[:1] + given[2:]) if len(g) > 1}
        if len(tokens) > 2 and len(last) > 2:
            out.add(f"p:{given[0]}:{' '.join(tokens[1:-1])}:{last[:3]}")
    if not own:
        return out
    out |= {f"w:{p}" for p in _pieces("".join(tokens))}
    if len(tokens) == 1:
        out |= {f"a:{tokens[0]}"} if 3 <= len(tokens[0]) <= 8 else set()
    return out | {f"a:{a}" for a in acronyms(tokens)}


def finer(tokens: list[str], level: int) -> tuple[set[str], set[str]]:
    """(as a typed form, as a candidate): keys within a crowded surname block, by given name (level 0) or middle words (level 1)."""
    if level == 0:
        given, runs = tokens[0], set()
        if len(tokens) > 2:
            runs = _pieces("".join(tokens[:-1])) | {"".join(w[0] for w in tokens[:-1])}
        typed = _pieces(given) | FULL.get(given, set()) if len(given) > 1 else {"=" + given}
        return typed, _pieces(given) | {given[:k] for k in range(3, len(given))} | {"=" + given[0]} | runs
    middle = tokens[1:-1]
    if not middle:
        return {"~"}, {"~", "^"}
    typed = {"^"}.union(*(_pieces(m) if len(m) > 1 else {"=" + m} for m in middle))
    return typed, {"~"}.union(*(_pieces(m) | {m[:k] for k in range(3, len(m))} | {"=" + m[0]} for m in middle))


def _forms(batches: Iterator[pd.DataFrame], common: set[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["form"] = [" ".join(parse(n, common)) for n in batch["name"]]
        yield batch[batch["form"] != ""]


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each longer word of a name, and whether it stands first."""
    for batch in batches:
        words = [[w for w in re.split(r"[^a-z0-9]+", fold(x)) if w and w not in TITLES] for x in batch["name"]]
        yield pd.DataFrame([(sound(w), int(i == 0)) for ws in words for i, w in enumerate(ws) if len(w) > 2], columns=["w", "first"])


def _standing(tokens: list[str]) -> int:
    """How many words of a form are whole; a form of many whole words can be a canonical one."""
    return sum(len(t) > 2 and t not in FULL for t in tokens)


def attribute(spellings: DataFrame, known: DataFrame) -> DataFrame:
    """(name, entity): spellings of one entity share its ``entity``, the smallest form attached to it.

    ``spellings`` has rows (record, name), ``known`` rows (id, name): spellings
    known to denote the same. Null and blank names, and names without letters
    or digits, get no row; repeated rows count once, and a name's frequency is
    its number of distinct records. Names of relatives and namesakes stay
    apart, for another given or middle name has no likelihood; names of three
    words or more may have their surname first, however rare the given name
    is; a form that two
    persons explain about equally well is attached to neither.
    """
    spark = spellings.sparkSession
    typed = spellings.where("name is not null and record is not null").groupBy("name").agg(F.countDistinct("record").alias("freq"))
    listed = known.where("name is not null and id is not null").select("name", "id").distinct()
    names = cut(typed.join(listed.select("name").distinct().withColumn("tracked", F.lit(True)), "name", "full").select("name", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"), F.coalesce("tracked", F.lit(False)).alias("tracked")))
    n = names.count()
    # Words that stand first in a share of all spellings, and seldom elsewhere: at most 1 / COMMON of them.
    bag = names.select("name").mapInPandas(_positions, "w string, first int")
    common = {
        r["w"] for r in bag.groupBy("w").agg(F.sum("first").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("first") >= max(3, COMMON * n)) & (F.col("first") * 2 > F.col("n"))).select("w").collect()
    } - PARTICLES - TITLES
    shared = spark.sparkContext.broadcast(common)
    parsed = cut(names.mapInPandas(lambda b: _forms(b, shared.value), "name string, freq long, tracked boolean, form string"))
    release(names)
    forms = parsed.groupBy("form").agg(F.sum("freq").alias("freq"), F.max("tracked").alias("tracked"))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, q, t in zip(batch["form"], batch["freq"], batch["tracked"]):
                order, *others = readings(f.split())
                own, standing = keys(order), _standing(order)
                acronym = len(order) == 1  # what has more words is called by one, and is none
                rows += [(f, q, t, standing, k, acronym or k[:2] != "a:", k in own and standing > 1) for k in own.union(*(keys(r, False) for r in others))]
            yield pd.DataFrame(rows, columns=KEYED)

    def split(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for row in batch.itertuples(index=False):
                    base = row.key.split("|")[0]
                    for i, r in enumerate(readings(row.form.split())):
                        if base in _surname_keys(r):
                            typed, candidate = finer(r, level)
                            candidate = candidate if row.as_c and i == 0 else set()
                            typed = typed if row.as_v else set()
                            rows += [(row.form, row.freq, row.tracked, row.standing, f"{row.key}|{x}", x in typed, x in candidate) for x in typed | candidate]
                yield pd.DataFrame(rows, columns=KEYED)

        return run

    schema = "form string, freq long, tracked boolean, standing int, key string, as_v boolean, as_c boolean"
    rows = cut(forms.repartition(tasks(spark)).mapInPandas(keyed, schema))
    # Pairs within a block grow with its square, so crowded ones are split by what a link needs besides.
    done, written = [], [rows]
    for level in (0, 1):
        crowded = rows.where("key like 's:%'").groupBy("key").count().where(F.col("count") > CROWDED).select("key")
        done.append(rows.join(crowded, "key", "left_anti"))
        rows = cut(rows.join(crowded, "key", "left_semi").mapInPandas(split(level), schema).distinct())
        written.append(rows)
    rows = done[0].unionByName(done[1]).unionByName(rows)
    rank = F.struct(F.col("tracked"), F.col("standing"), F.col("freq"), F.col("form"))
    v = rows.where("as_v").select("key", F.col("form").alias("v"), F.col("freq").alias("v_freq"), rank.alias("v_rank"))
    c = rows.where("as_c").select("key", F.col("form").alias("c"), F.col("freq").alias("c_freq"), F.col("tracked").alias("c_tracked"), rank.alias("c_rank"))
    pairs = v.join(c, "key").where("v_rank < c_rank").select("v", "v_freq", "c", "c_freq", "c_tracked").distinct()
    same = listed.join(parsed.select("name", "form"), "name")
    channel = _channel(same)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                x, _ = any_order(row.v.split(), row.c.split(), channel=channel)
                if x > IMPOSSIBLE:
                    prior = log(1 + row.c_freq + TRACKED * row.c_tracked)
                    if x + prior - log(1 + row.v_freq) > UNRELATED:
                        out.append((row.v, row.c, x + prior))
            yield pd.DataFrame(out, columns=["v", "c", "score"])

    likely = cut(pairs.repartition(tasks(spark)).mapInPandas(scored, "v string, c string, score double"))
    for w in written:
        release(w)
    best = likely.groupBy("v").agg(F.max(F.struct("score", "c")).alias("top")).select("v", F.col("top.c").alias("best"), F.col("top.score").alias("best_score"))

    def rivals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            other = [max(any_order(a.split(), b.split(), True, channel), any_order(b.split(), a.split(), True, channel))[0] <= IMPOSSIBLE for a, b in zip(batch["c"], batch["best"])]
            yield batch.loc[other, ["v"]]

    doubtful = likely.join(best, "v").where((F.col("c") != F.col("best")) & (F.col("score") > F.col("best_score") - MARGIN)).select("v", "c", "best").mapInPandas(rivals, "v string").distinct()
    links = best.join(doubtful, "v", "left_anti").select(F.col("v").alias("a"), F.col("best").alias("b"))
    links = links.unionByName(same.join(same.groupBy("id").agg(F.min("form").alias("first")), "id").select(F.col("form").alias("a"), F.col("first").alias("b")).distinct())
    entities = connected_components(forms.select(F.col("form").alias("node")), links)
    release(likely)
    return parsed.join(entities.select(F.col("node").alias("form"), F.col("component").alias("entity")), "form").select("name", "entity")


KEYED = ["form", "freq", "tracked", "standing", "key", "as_v", "as_c"]


def _channel(same: DataFrame) -> Channel:
    """The likelihoods after the known pairs: what turns the longest spelling of an id into its others, counted, beside PRIOR.

    ``same`` has (id, form, ...). The counts, one for each thing a typist does, are all that is collected.
    """
    longest = same.groupBy("id").agg(F.max(F.struct(F.size(F.split("form", " ")), F.length("form"), F.col("form"))).alias("m")).select("id", F.col("m.form").alias("c"))
    pairs = same.select("id", F.col("form").alias("v")).distinct().join(longest, "id").where("v <> c")

    def done(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(x,) for v, c in zip(batch["v"], batch["c"]) for x in any_order(v.split(), c.split())[1]], columns=["done"], dtype=object)

    seen = {r["done"]: r["count"] for r in pairs.mapInPandas(done, "done string").groupBy("done").count().collect()}
    whole = sum(exp(x) for x in PRIOR.values())
    total = sum(seen.values()) + WEIGHT
    raw = {k: log((seen.get(k, 0) + WEIGHT * exp(x) / whole) / total) for k, x in PRIOR.items()}
    return {k: min(0.0, x - raw["exact"]) for k, x in raw.items()}


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    typed = load(spark, folder, "doc_candidates").select(F.col("doc_id").alias("record"), "name")
    persons = load(spark, folder, "persons")
    known = persons.select("id", "name").unionByName(persons.select("id", F.explode("aliases").alias("name")))
    return typed, known


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of doc_candidates and persons with its entity and the entity's number of spellings."""
    entities = attribute(*_inputs(spark, folder))
    return entities.join(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_spellings")), "entity").select("name", "entity", "n_spellings")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    typed, known = _inputs(spark, folder)
    entities = cut(attribute(typed, known))
    seen = typed.select("name").distinct().withColumn("typed", F.lit(True))
    entities = entities.join(seen, "name", "left").select("name", "entity", F.coalesce("typed", F.lit(False)).alias("typed"))
    a = entities.select(F.col("name").alias("name_a"), "entity", F.col("typed").alias("typed_a"))
    b = entities.select(F.col("name").alias("name_b"), "entity", F.col("typed").alias("typed_b"))
    return a.join(b, "entity").where("name_a < name_b and (typed_a or typed_b)").select("name_a", "name_b")


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities}
SQL: dict[str, str] = {}
