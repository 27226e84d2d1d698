"""Lines, visual forms, leaks and mixing on small cases and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from liame.llm import leaks, mixing
from liame.llm.components import connected_components
from liame.llm.lines import repeated_lines, without_lines
from liame.llm.visual import same_looking

DOCS = "doc_id long, source string, domain string, text string, line_no int, docs string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], DOCS)


def test_components(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"] + [(None,)], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("f", "e"), ("f", "f"), ("g", "zz"), (None, "a"), ("a", "b")], "a string, b string")
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert got == dict(zip("abcdefgh", "aaaaeegh"))


def test_long_chain_is_one_component(spark):
    names = [f"n{i:03d}" for i in random.Random(0).sample(range(100), 100)]
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    assert {r["component"] for r in connected_components(nodes, edges).collect()} == {"n000"}


def test_lines_are_alike_up_to_case_space_and_numbers(spark):
    rows = [(i, "rss", "a.br", f"corpo {chr(97 + i)}\r\n  LEIA mais   {i * 7}\r\n\nSiga o site") for i in range(5)]
    rows += [(10, "rss", "b.br", "Leia mais 1"), (11, "bluesky", None, "Leia mais 1"), (12, "rss", None, None), (13, "rss", None, ""), (0, "rss", "a.br", rows[0][3])]
    docs = docs_of(spark, rows)
    found = repeated_lines(docs)
    got = sorted((r["doc_id"], r["line_no"]) for r in found.collect())
    assert got == sorted((i, n) for i in range(5) for n in (2, 4))
    assert found.select("block").distinct().count() == 1
    clean = {r["doc_id"]: (r["text"], r["n_removed"]) for r in without_lines(docs.dropDuplicates(["doc_id"]), found).collect()}
    assert clean[1] == ("corpo b\r\n", 2) and clean[10] == ("Leia mais 1", 0) and clean[12][0] is None and clean[13] == ("", 0)


def test_four_documents_are_too_few(spark):
    rows = [(i, "rss", "a.br", "uma linha") for i in range(4)] + [(0, "rss", "a.br", "uma linha")] * 3
    assert repeated_lines(docs_of(spark, rows)).count() == 0


SAME = ["Ação é já — “fim” 2", "Ação é já — “fim” 2", "A­ção é já — “fim” 2​", "Аção é јá — “fim” 2", "Ａção é já — “fim” ２", "Ação é já — “fim” 2 \r\n"]
OTHER = ["Acao é já — “fim” 2", "ação é já — “fim” 2", "Ação é já — \"fim\" 2", "Ação é já — “fim” ²", "Ação é já — “fim” 3", "Ação é já - “fim” 2", "Ação é já — “fim” 2!"]


def test_same_looking_texts(spark):
    rows = [(i, "s", None, t) for i, t in enumerate(SAME + OTHER + [SAME[0], None, ""])]
    members, classes = same_looking(docs_of(spark, rows))
    got = sorted(r["doc_id"] for r in members.collect())
    assert got == [0, 1, 2, 3, 4, len(SAME) + len(OTHER)] or got == [*range(len(SAME)), len(SAME) + len(OTHER)]
    assert [r["n_texts"] for r in classes.collect()] in ([5], [6])


def test_joined_emoji_differ_from_two(spark):
    rows = [(1, "s", None, "oi 👩‍⚕"), (2, "s", None, "oi 👩⚕"), (3, "s", None, "ofﬁcio"), (4, "s", None, "officio")]
    assert sorted(r["doc_id"] for r in same_looking(docs_of(spark, rows))[0].collect()) == [3, 4]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abç") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.choice([8, 12, 20, 40])))) for i in range(25)] + [(90, None), (91, ""), (92, "curto demais")]
    texts = []
    for d in range(60):
        filler = [word() for _ in range(rng.randint(0, 150))]
        i, t = rng.choice(items[:25])
        w = t.split()
        a = rng.randint(0, max(0, len(w) - 5))
        part = w[a : a + rng.choice([10, 11, 12, 13, 30])]
        at = rng.randint(0, len(filler))
        texts.append((d, ", ".join(filler[:at] + part + filler[at:]).upper()))
    texts += [(100, None), (101, ""), (0, texts[0][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(df, spark.createDataFrame(items, "item_id long, text string"), passage=20).collect()}
    runs = lambda t: {tuple(w[k : k + 12]) for w in [leaks.words_of(t or "")] for k in range(len(w) - 11)}
    own = {i: runs(t) for i, t in items}
    want = {(d, i) for d, t in texts for i, r in own.items() if r & runs(t)}
    assert got == want and len(want) > 10


def test_search_skips_nothing_above_the_threshold():
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(30))) for i in range(80)]
    index = leaks.Index(items, 12)
    for _ in range(200):
        passage = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([12, 40, 64]))]
        score = [sum(dict(index.postings[t]).get(k, 0.0) for t in set(passage) if t in index.postings) for k in range(len(index.ids))]
        assert sorted(index.search(passage)) == [k for k, s in enumerate(score) if s >= index.least[k]]


def test_quotas_respect_caps():
    total, q = mixing.plan_quotas({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.4, 3), "gone": (0.1, 2)})
    assert total == pytest.approx(3 * 10 * 0.9 / 0.4) and q["b"] == pytest.approx(30) and "gone" not in q
    assert mixing.plan_quotas({}, {"a": (1.0, 1)}) == (0.0, {})


def test_splitting_tree_is_exact():
    node = (0, 7, {"a": (0, 37), "b": (0, 5)})
    parts = list(mixing.tree(node, 3))
    assert [p[0] for p in parts] == list(range(7)) and all(p[1] == 1 for p in parts) and parts == list(mixing.tree(node, 3))
    for s, n in (("a", 37), ("b", 5)):
        assert sorted(x for *_, q in parts if s in q for x in range(q[s][0], q[s][0] + q[s][1])) == list(range(n))
    sizes = [sum(n for _, n in q.values()) for *_, q in parts]
    assert max(sizes) - min(sizes) <= 2
    above = list(mixing.tree(node, 3, 2))
    assert [leaf for n in above for leaf in mixing.tree(n, 3)] == parts


def test_a_large_tree_has_no_empty_shard():
    counts = {f"s{i}": (0, 32 * 100_000 // 20) for i in range(20)}
    top = list(mixing.tree((0, 100_000, counts), 1, -(-100_000 // 256)))
    assert len(top) <= 512 and sum(n[1] for n in top) == 100_000
    some = [leaf for n in top[:4] for leaf in mixing.tree(n, 1)]
    assert all(28 <= sum(k for _, k in q.values()) <= 36 for *_, q in some)


@pytest.mark.parametrize("level", [2, 1024])
def test_last_blocks_equal_running_sums(spark, monkeypatch, level):
    monkeypatch.setattr(mixing, "LEVEL", level)
    rng = random.Random(4)
    rows = [(s, rng.randint(0, 99), rng.randint(1, 9)) for s in "ab" for _ in range(400)]
    got = mixing._last_blocks(spark.createDataFrame(rows, "source string, place long, tokens long"), {"a": 100, "b": 100}, {"a": 777.0, "b": 0.0})
    left, at = 777, 0
    sums = [sum(t for s, p, t in rows if s == "a" and p == k) for k in range(100)]
    while left > sums[at]:
        left -= sums[at]
        at += 1
    assert got == {"a": (at, left)}


def test_mixture_reaches_shares_within_a_document(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["big"] * 8 + ["small"]), rng.randint(5, 60)) for i in range(3000)] + [(9001, None, 10), (9002, "untargeted", 50)]
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 4), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, tokens long"), targets, shard_tokens=5000).cache()
    size = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(size.values())
    assert set(size) == {"big", "small"} and abs(size["big"] / total - 7 / 9) < 0.005
    assert got.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert got.groupBy("doc_id", "source").count().where("(source = 'big' and count > 1) or count > 4").count() == 0
    places = got.groupBy("shard").agg(F.count("*").alias("n"), F.max("position").alias("m")).collect()
    assert len(places) > 2 and all(r["n"] == r["m"] for r in places)


def test_mixture_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, tokens long")
    assert mixing.mixture(none, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")).count() == 0
    assert math.isclose(mixing.plan_quotas({"a": 10}, {"a": (1.0, 2)})[0], 20)


def test_token_counts_skip_nulls(spark):
    rows = spark.createDataFrame([(1, "a", "olá mundo"), (2, "a", None), (3, None, "x"), (4, "a", "")], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(rows).collect()}
    assert got[4] == 0 and got[1] >= 2 and set(got) == {1, 4}
