"""Pairs, top-n and frequencies against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from liame.llm.frequency import SEP, ngram_counts
from liame.llm.pairs import pair_counts, together
from liame.llm.topn import top_n


def baskets(seed=1):
    rng = random.Random(seed)
    rows = [(b, f"i{rng.randint(0, 40)}") for b in range(60) for _ in range(rng.randint(1, 6))]
    rows += [(999, f"i{k}") for k in range(200)]  # one basket far beyond a chunk
    return rows + rows[:50] + [(None, "i1"), (3, None)]


@pytest.mark.parametrize("chunk", [4, 1000])
def test_pairs_equal_brute_force(spark, chunk):
    rows = baskets()
    got = {tuple(r) for r in together(spark.createDataFrame(rows, "basket long, item string"), 100, 2, 1.5, chunk).select("item_a", "item_b", "n_a", "n_b", "n_ab").collect()}
    held = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            held[i].add(b)
    want = set()
    for a, b in itertools.combinations(sorted(held), 2):
        n = len(held[a] & held[b])
        if n >= 2 and n * 100 >= 1.5 * len(held[a]) * len(held[b]):
            want.add((a, b, len(held[a]), len(held[b]), n))
    assert got == want and want


def test_chunks_of_a_huge_basket_make_every_pair_once(spark):
    coded = spark.createDataFrame([(1, i) for i in range(70)] + [(2, i) for i in range(3)], "basket long, code long")
    rows = {(r["a"], r["b"]): r["n_ab"] for r in pair_counts(coded, 8).collect()}
    assert len(rows) == 70 * 69 // 2 and rows[0, 1] == 2 and rows[5, 60] == 1 and all(a < b for a, b in rows)


def test_pairs_of_nothing(spark):
    rows = spark.createDataFrame([], "basket long, item string, extra int")
    assert together(rows, 0).count() == 0


@pytest.mark.parametrize("heavy", [5, 10**6])
def test_top_n_with_ties_nulls_and_repeats(spark, heavy):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice("xyzwvu") + str(rng.randint(0, 9)) if rng.random() > 0.05 else None, rng.choice([1, 2, 3, None]), 0) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, t string, v int, rank int")
    got = sorted((tuple(r) for r in top_n(df, ["g"], "t", "v", 4, heavy).collect()), key=repr)
    best = {}
    for g, t, v, _ in rows:
        if t is not None and v is not None:
            best[g, t] = max(v, best.get((g, t), 0))
    want = [
        (g, t, -v, i) for g in {r[0] for r in rows}
        for i, (v, t) in enumerate(sorted((-v, t) for (x, t), v in best.items() if x == g)[:4], 1)
    ]
    assert got == sorted(want, key=repr)


def test_top_n_of_nothing(spark):
    assert top_n(spark.createDataFrame([], "g string, t string, v int"), ["g"], "t", "v").count() == 0


def brute_ngrams(rows, max_n):
    count, records = Counter(), defaultdict(set)
    for r, terms in rows:
        if r is None or terms is None:
            continue
        terms = [t for t in terms if t is not None]
        for i in range(len(terms)):
            for n in range(1, max_n + 1):
                if i + n <= len(terms):
                    g = SEP.join(terms[i : i + n])
                    count[g] += 1
                    records[g].add(r)
    return {g: (n, len(records[g])) for g, n in count.items()}


@pytest.mark.parametrize("max_n,heavy", [(1, 10**6), (3, 10**6), (3, 4)])
def test_suffix_counting_equals_brute_force(spark, max_n, heavy):
    rng = random.Random(3)
    rows = [(rng.randint(1, 20), [rng.choice("abc") for _ in range(rng.randint(0, 7))]) for _ in range(60)] + [(None, ["a"]), (5, None), (6, ["a", None, "b"]), (7, ["a"] * 300)]
    got = {r["ngram"]: (r["occurrences"], r["records"]) for r in ngram_counts(spark.createDataFrame(rows, "record long, terms array<string>"), max_n, heavy).collect()}
    assert got == brute_ngrams(rows, max_n)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.lists(st.sampled_from(["a", "ab", "b", "é"]), max_size=4)), max_size=6))
def test_suffix_counting_any_input(spark, rows):
    df = spark.createDataFrame(rows, "record long, terms array<string>")
    assert {r["ngram"]: (r["occurrences"], r["records"]) for r in ngram_counts(df, 2).collect()} == brute_ngrams(rows, 2)
