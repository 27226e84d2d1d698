"""Names, truncation and personal data."""

import numpy as np
import pytest

from liame.llm import names as nm
from liame.llm import private as pv
from liame.llm import truncation as tr


@pytest.mark.parametrize("a,b,want", [("abc", "abd", True), ("abc", "ab", True), ("abc", "acb", True), ("abc", "abcd", True), ("abc", "xbd", False), ("abcd", "badc", False), ("", "a", True)])
def test_near(a, b, want):
    assert nm.near(a, b) is want and nm.near(b, a) is want


CANON = "frederico vivedim nhisubuta".split()


@pytest.mark.parametrize("typed", [
    "frederico nhisubuta", "f. v. nhisubuta", "fv nhisubuta", "fred nhisubuta", "Nhisubuta, Frederico Vivedim", "dep. Frederico de Vivedim-Nhisubuta", "FREDERICO VIVEDIM NHISBUTA", "fredericovivedim nhisubuta", "frederyko vivedim nhisubuta",
])
def test_variants_have_a_likelihood(typed):
    v = nm.parse(typed, {"frederico"})
    assert nm.likelihood(v, nm.parse(" ".join(CANON), {"frederico"})) > nm.UNRELATED


@pytest.mark.parametrize("typed", ["walter vivedim nhisubuta", "frederico sazozal nhisubuta", "w. nhisubuta", "frederico vivedim zobuguce", "nhisubuta"])
def test_relatives_and_namesakes_have_none(typed):
    assert nm.likelihood(nm.parse(typed, set()), nm.parse(" ".join(CANON), set())) <= nm.IMPOSSIBLE


def test_linked_forms_share_a_key():
    import random

    rng = random.Random(1)
    canon = nm.parse(" ".join(CANON), {"frederico"})
    for typed in ["fred nhisubuta", "f vivedim nhisubuta", "fredericovivedim nhisubuta", "frederico vivedim nhisubuta"]:
        for _ in range(20):
            t = list(typed)
            i = rng.randrange(len(t) - 1)
            if t[i] != " " and t[i + 1] != " ":
                t[i], t[i + 1] = t[i + 1], t[i]
            v = nm.parse("".join(t), {"frederico"})
            if nm.likelihood(v, canon) > nm.IMPOSSIBLE:
                assert nm.keys(v) & nm.keys(canon), v


def test_attribution(spark):
    typed = [(i, "frederico vivedim nhisubuta") for i in range(9)] + [(20, "fred nhisubuta"), (21, "frederico vivedim nhisbuta"), (21, "frederico vivedim nhisbuta"), (22, "walter vivedim nhisubuta"), (23, "walter vivedim nhisubuta"), (24, "x. nhisubuta"), (25, None), (26, ""), (27, "—"), (None, "z")]
    known = [("f", "Frederico Vivedim Nhisubuta"), ("f", "Nhisubuta"), ("g", None)]
    got = {r["name"]: r["entity"] for r in nm.attribute(spark.createDataFrame(typed, "record long, name string"), spark.createDataFrame(known, "id string, name string")).collect()}
    one = {got[n] for n in ("frederico vivedim nhisubuta", "fred nhisubuta", "frederico vivedim nhisbuta", "Frederico Vivedim Nhisubuta", "Nhisubuta")}
    assert len(one) == 1 and got["walter vivedim nhisubuta"] not in one and got["x. nhisubuta"] not in one and None not in got and "" not in got


def test_surname_first_with_a_rare_given_name(spark):
    import random

    rng = random.Random(4)
    names = ["joana " + " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(2)) for _ in range(400)]
    turned = [("gustavo vevorel trisuceri", "trisuceri gustavo vevorel"), ("leonardo giginar brizudovu", "brizudovu leonardo giginar")]
    typed = [(i, n) for i, n in enumerate(names)] + [(100 + 10 * i + j, n) for i, pair in enumerate(turned) for j, n in enumerate([pair[0]] * 3 + [pair[1]])]
    typed += [(200, "trisuceri ricardo vevorel"), (201, "ricardo vevorel trisuceri"), (202, "ricardo vevorel trisuceri")]
    got = {r["name"]: r["entity"] for r in nm.attribute(spark.createDataFrame(typed, "record long, name string"), spark.createDataFrame([], "id string, name string")).collect()}
    assert all(got[a] == got[b] for a, b in turned) and got["trisuceri ricardo vevorel"] == got["ricardo vevorel trisuceri"] != got[turned[0][0]]
    assert len({got[n] for n in names}) == len(set(names))


def test_many_middle_names_take_no_time():
    import time

    words = [f"bede{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)]
    began = time.perf_counter()
    assert nm.likelihood(["ana", "silva"], ["ana", *words, "silva"]) < 0 and nm.likelihood(["ana", *words[:15], "silva"], ["ana", *words, "silva"]) == pytest.approx(15 * nm.PRIOR["dropped"])
    assert nm.likelihood(["ana", *words[1:], "outro", "silva"], ["ana", *words, "silva"]) <= nm.IMPOSSIBLE
    assert time.perf_counter() - began < 0.5


@pytest.mark.parametrize("typed,name", [("fetape", "federacao de trabalhadores de pesca"), ("cnbb", "conferencia nacional dos bispos do brasil"), ("embrapa", "empresa brasileira de pesquisa agropecuaria")])
def test_acronyms(typed, name):
    v, c = nm.parse(typed, set()), nm.parse(name, set())
    assert (nm.likelihood(v, c) > nm.IMPOSSIBLE) == bool(nm.keys(v) & nm.keys(c))
    assert typed == "fetape" or nm.likelihood(v, c) > nm.IMPOSSIBLE


def test_first_letter_and_abbreviated_forms_share_a_key():
    for typed, name in [("bose vivedim nhisubuta", "jose vivedim nhisubuta"), ("ose nhisubuta", "jose vivedim nhisubuta"), ("ojse nhisubuta", "jose nhisubuta"), ("assoc comercial ind", "associacao comercial industrias")]:
        v, c = nm.parse(typed, set()), nm.parse(name, set())
        assert nm.likelihood(v, c) > nm.IMPOSSIBLE and nm.keys(v) & nm.keys(c), typed


@pytest.mark.parametrize("crowded", [5, 10**6])
def test_a_surname_of_most_spellings(spark, monkeypatch, crowded):
    """Split blocks link what whole blocks link."""
    import random

    monkeypatch.setattr(nm, "CROWDED", crowded)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    givens, middles = [word() for _ in range(40)], [word() for _ in range(40)]
    people = list({f"{rng.choice(givens)} {rng.choice(middles)} silva" for _ in range(600)})
    typed = [(i, n) for i, n in enumerate(people) for _ in range(2)] + [(5000 + i, f"{n.split()[0]} {n.split()[1][:-1]} silva") for i, n in enumerate(people[:60])]
    typed += [(6000 + i, f"{n.split()[0][0]}. {n.split()[1]} silva") for i, n in enumerate(people[60:90])]
    got = {r["name"]: r["entity"] for r in nm.attribute(spark.createDataFrame(typed, "record long, name string"), spark.createDataFrame([], "id string, name string")).collect()}
    linked = [n for _, n in typed[-90:-30] if len({got[n]} & {got[p] for p in people}) == 1]
    assert len(linked) >= 50
    _SEEN.setdefault("split", got)
    assert _SEEN["split"] == got


_SEEN: dict = {}


def test_the_channel_learns_from_known_pairs(spark):
    same = [(f"p{i}", f"frederico nome{chr(97 + i)} souza", f"fred souza {i}") for i in range(20)]
    rows = [(i, c, c) for i, c, _ in same] + [(i, "fred souza", "fred souza") for i, _, _ in same]
    channel = nm._channel(spark.createDataFrame(rows, "id string, form string, name string"))
    assert channel["nick"] > nm.PRIOR["nick"] and channel["dropped"] > nm.PRIOR["dropped"] and channel["typo"] < channel["nick"]
    none = nm._channel(spark.createDataFrame([], "id string, form string, name string"))
    assert all(none[k] == pytest.approx(nm.PRIOR[k]) for k in none)


def test_attribution_of_nothing(spark):
    empty = spark.createDataFrame([], "record long, name string"), spark.createDataFrame([], "id string, name string")
    assert nm.attribute(*empty).count() == 0


@pytest.mark.parametrize("line,kind", [
    ("Foi assim.", "stop"), ("Foi ass…", "dots"), ("Foi [...]", "gap"), ("Foi (…)", "gap"), ("Foi ass&ccedi", "code"), ("Foi ass&#23", "code"), ("Foi ass�", "code"),
    ("#tag https://x.example/1 👏", "none"), ("Foi assim. #tag", "stop"), ("Foi assim,", "open"), ("pedida por Dr.", "open"), ("Foi assim", "plain"), ("“Foi assim”", "stop"), ("É só. 🤷🏽‍♂️", "stop"),
])
def test_endings(line, kind):
    assert tr._ending(line)[0] == kind


def test_alignment():
    full = "a casa foi vendida ontem ¶ nada mais".split()
    assert tr.ends_early("a casa foi ven".split(), full) and tr.ends_early("a casa foi".split(), full)
    assert not tr.ends_early("a casa foi vendida ontem".split(), full) and not tr.ends_early(full, full) and not tr.ends_early(["x"], full)


def test_truncated_texts(spark):
    body = "a oposição afirma que a medida é apenas uma resposta à crise de {} em {}"
    towns = [f"cidade{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = [(i, "rss", f"s{i}.br", body.format("energia", t) + ".") for i, t in enumerate(towns)]
    cut = {1000: body.format("energia", "cidadeaa")[:40], 1001: "a oposição afirma que a medida é apen…", 1002: "a oposição afirma que a medida é apenas uma resposta &agra", 1003: "a oposição afirma que a medida é apenas uma\n#tag"}
    rows += [(k, "gnews", f"t{k}.br", t) for k, t in cut.items()]
    rows += [(2000 + i, "bluesky", None, f"hoje choveu em {t}. Vai entender...") for i, t in enumerate(towns[:9])]
    rows += [(3000, None, None, None), (3001, "rss", None, ""), (3002, "rss", None, "x" * 60_000 + ".")]
    got = {r["doc_id"]: r["how"] for r in tr.truncated(spark.createDataFrame(rows, "doc_id long, source string, domain string, text string")).collect()}
    assert {k for k, how in got.items() if how} == set(cut) and len(got) == len(rows)


def test_cut_copy_is_found_by_alignment(spark):
    words = [f"palavra{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(1, "rss", "a.br", " ".join(words) + "."), (2, "rss", "b.br", " ".join(words[:110]) + " " + words[110][:5]), (3, "rss", "c.br", " ".join(words[:60]) + "."), (4, "rss", "d.br", " ".join(words[:110]) + " " + words[110][:5])]
    got = {r["doc_id"]: r["how"] for r in tr.truncated(spark.createDataFrame(rows, "doc_id long, source string, domain string, text string")).collect()}
    assert got == {1: None, 2: "copy", 3: None, 4: "copy"}


@pytest.mark.parametrize("heavy", [2000, 7])
def test_cut_copy_in_a_hot_group_of_near_copies(spark, monkeypatch, heavy):
    import random

    monkeypatch.setattr(tr, "HEAVY", heavy)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    article = [word() for _ in range(404)]
    rows = [(1, "rss", "a.br", " ".join(article) + "."), (2, "rss", "b.br", " ".join(article[:343]) + " " + article[343][:4])]
    rows += [(10 + i, "rss", f"s{i}.br", " ".join(article + [word() for _ in range(rng.randint(120, 240))]) + ".") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, domain string, text string")
    assert [(r["doc_id"], r["how"]) for r in tr.truncated(docs).where("how is not null").collect()] == [(2, "copy")]


def test_a_bounded_sample_fits_the_same_verdicts(spark, monkeypatch):
    rows = [(i, "rss", f"s{i}.br", f"a oposição afirma que a medida é apenas uma resposta à crise de energia em cidade{i % 26}.") for i in range(400)]
    rows += [(1000, "rss", "t.br", "a oposição afirma que a medida é apenas"), (1001, "rss", "t.br", "a oposição afirma que a medida é apenas uma respo")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, domain string, text string")
    whole = sorted(r["doc_id"] for r in tr.truncated(docs).where("how is not null").collect())
    monkeypatch.setattr(tr, "SAMPLE_CHARS", 15_000)
    assert sorted(r["doc_id"] for r in tr.truncated(docs).where("how is not null").collect()) == whole == [1000, 1001]


def test_endings_are_learned_from_all_texts(spark, monkeypatch):
    """With a bound on a sample so tight that it holds no text, closing words are still known from the others."""
    rows = [(i, "rss", f"s{i}.br", f"a oposição afirma que a medida é apenas uma resposta à crise de energia em cidade{i % 26}.") for i in range(400)]
    rows += [(1000, "rss", "t.br", "a oposição afirma que a medida é apenas"), (1002, "rss", "u.br", "a oposição afirma que a medida é apenas uma...")]
    rows += [(2000 + i, "rss", "v.br", f"vai entender o caso {i}...") for i in range(9)]
    monkeypatch.setattr(tr, "SAMPLE_CHARS", 1)
    docs = spark.createDataFrame(rows, "doc_id long, source string, domain string, text string")
    assert sorted(r["doc_id"] for r in tr.truncated(docs).where("how is not null").collect()) == [1000, 1002]


def test_contexts_are_counted_in_steps(monkeypatch):
    lines = [("plain", "a b c".split()), ("stop", "a b c .".split()), ("dots", "c b".split()), ("plain", "a b c".split())]

    def counted(held):
        monkeypatch.setattr(tr, "HELD", held)
        contexts, totals, notes = tr.Contexts({"a": True, "b": False}), {}, []
        for kind, tokens in lines:
            notes.append(contexts.note(contexts.add(kind, tokens)))
            for view, *rows in contexts.counts() if contexts.full() else []:
                for k, n, e in zip(*rows):
                    totals[view, k] = tuple(np.add(totals.get((view, k), (0, 0)), (n, e)))
        for view, *rows in contexts.counts():
            for k, n, e in zip(*rows):
                totals[view, k] = tuple(np.add(totals.get((view, k), (0, 0)), (n, e)))
        keys = contexts.keys()[notes]
        return totals, keys.tolist(), [totals[v, keys[0][v]] for v in range(len(tr.VIEWS))]

    whole = counted(10**6)
    assert whole == counted(1) and whole[1][0] == whole[1][3] != whole[1][1] and whole[2] == [(3, 2)] * len(tr.VIEWS)


def test_checksums():
    assert pv.luhn("4539578763621486") and not pv.luhn("4539578763621487") and pv.mod97("GB82WEST12345698765432") and not pv.mod97("GB82WEST12345698765433")
    assert pv.checked("529.982.247-25") and not pv.checked("529.982.247-21") and not pv.checked("11111111111")


TEXT = (
    "Ana Lima falou. A moradora Maria Helena Sabutriba, residente na Rua do Velho, n.º 1.459, bairro novo, ligou do número (26) 9.6626.3492. "
    "Processo 9467347-22.2026.8.26.4067, inscrição 20265601030, R$ 585.569.841,44. CPF nº: 26801193659; RG 47.384.741-7. "
    "O Hospital José Zumutica e a Lei Inês Lhesifinhe (Lei nº 14.342/2021). Escreva a jose.silva (arroba) velmail (ponto) example ou veja @jose_oficial. "
    "A obra da Avenida Tomás Nalhitapu parou. Att., Dr. Paulo de Souza\nTel: +55 52 98966-4245"
)


def test_personal_data(spark):
    docs = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (1, TEXT, "x")], "doc_id long, text string, kind string")
    persons = spark.createDataFrame([("Ana Lima", ["Ana Lima"]), (None, None)], "name string, aliases array<string>")
    got = {(r["kind"], r["piece"]) for r in pv.personal_data(docs, persons).collect()}
    assert got == {
        ("name", "Maria Helena Sabutriba"), ("address", "Rua do Velho, n.º 1.459"), ("phone", "(26) 9.6626.3492"), ("id_number", "26801193659"), ("id_number", "47.384.741-7"),
        ("email", "jose.silva (arroba) velmail (ponto) example"), ("name", "Paulo de Souza"), ("phone", "+55 52 98966-4245"),
    }
    out = {r["doc_id"]: r["text"] for r in pv.redacted(docs, persons).collect()}
    assert "A moradora [NOME], residente na [ENDEREÇO], bairro" in out[1] and "Ana Lima falou" in out[1] and "Hospital José Zumutica" in out[1] and out[3] == ""


def test_public_persons_beyond_the_limit_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, TEXT), (2, "O professor Paulo Lima chegou. A moradora Ana Lima saiu."), (3, None)], "doc_id long, text string")
    persons = spark.createDataFrame([("Ana Lima", ["Ana Lima"]), ("Paulo  Lima", None), (None, None)], "name string, aliases array<string>")
    whole = sorted(map(tuple, pv.personal_data(docs, persons).collect()))
    monkeypatch.setattr(pv, "LARGEST_PERSONS", 1)
    assert sorted(map(tuple, pv.personal_data(docs, persons).collect())) == whole and all(r[0] == 1 for r in whole)


def test_given_names_are_learned_from_how_people_are_introduced(spark):
    """Names that no list has, in sentences that no pattern of the module was made from."""
    names = [f"{g} {s}" for g in ("Tainara", "Ubirajara", "Queziane") for s in ("Mobrata", "Selvique", "Tundreva", "Caruzal", "Pelvado", "Gomira", "Rastibe")]
    rows = [(i, f"Ontem a vizinha {n} foi ouvida na praça.") for i, n in enumerate(names)]
    held = ["Quem viu tudo foi {}, que passava ali.", "O carro pertence a {} desde maio.", "Segundo a polícia, {} não quis falar."]
    rows += [(100 + i, t.format(n)) for i, (n, t) in enumerate((n, t) for n in names for t in held)] + [(900, "O Complexo Tundreva e a Serra Selvique ficam longe.")]
    got = {(r["doc_id"], r["piece"]) for r in pv.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "name string, aliases array<string>")).where("kind = 'name'").collect()}
    want = {(100 + i, n) for i, (n, _) in enumerate((n, t) for n in names for t in held)}
    assert len(want & got) >= 0.95 * len(want) and not any(d == 900 for d, _ in got)


@pytest.mark.parametrize("text", ["nome [ at ] host.com", "nome [at ] host.com", "nome ( at ) host.com", "nome(arroba)host.com"])
def test_hidden_addresses(text):
    assert [k for *_, k in pv.Finder(set(), set()).spans(f"escreva a {text} hoje")] == ["email"]


def test_very_long_text_ends():
    finder = pv.Finder({"ana lima"}, set())
    assert finder.spans("Rua " + "A" * 50_000) == [] and finder.spans("a" * 100_000 + "@") == [] and finder.spans("Maria " * 3000 + ".") is not None
