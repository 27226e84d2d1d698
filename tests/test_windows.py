import pytest

from liame import params as pr
from liame.functions import windows as wn
from liame.functions.text import Aliases
from liame.plans import layout, results

PERSONS = Aliases([("ana", ["Ana Lima"], []), ("rui", ["Lima"], [])])


@pytest.mark.parametrize("text,tokens", [("", 0), ("casa", 1), ("reformas-", 2), ("STF", 2), ("Brasileiro", 2), ("2026", 2), ("a1b2", 3), ("https://x.y", 8)])
def test_approx_tokens(text, tokens):
    assert wn.approx_tokens(text) == tokens


def test_token_estimate_in_the_jvm_equals_the_twin(spark):
    texts = ["", "casa", "reformas- STF Brasileiro 2026 a1b2", "https://x.y/Abc?d=1", "É só “isso”\u00a0ok_foo", "#tag @a.b ÇÃO x", "  "]
    got = [r["tokens"] for r in wn.token_sizes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [wn.approx_tokens(t) for t in texts]


def test_first_mention_maps_back_to_the_text():
    text = "Não: a ÁNA LIMA falou"
    assert text[slice(*wn.first_mention(text, PERSONS, "ana"))] == "ÁNA LIMA" and wn.first_mention(text, PERSONS, "rui") is None


def test_window_fits_and_holds_the_mention():
    text = "palavra " * 200 + "Ana Lima " + "palavra " * 200
    got = wn.window(text, wn.first_mention(text, PERSONS, "ana"), lambda s: wn.approx_tokens(s) <= 30)
    assert "Ana Lima" in got and 24 <= wn.approx_tokens(got) <= 30 and set(got.split()) == {"palavra", "Ana", "Lima"}
    assert wn.window("curto", (0, 0), lambda s: True) == "curto"


def test_window_at_the_ends():
    text = "Ana Lima " + "palavra " * 100
    assert wn.window(text, (0, 8), lambda s: len(s) <= 60).startswith("Ana Lima palavra")


def test_results_belong_to_a_build(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    root, q = str(tmp_path / "r"), pr.graph({})
    assert results.cached(spark, root, "b1", "graph", q, lambda: make(3)).count() == 3
    assert results.cached(spark, root, "b1", "graph", pr.graph({"days": "21"}), lambda: make(4)).count() == 3 and made == [3]
    assert results.cached(spark, root, "b2", "graph", q, lambda: make(5)).count() == 5
    results.forget(spark, root, "b2")
    assert results.cached(spark, root, "b1", "graph", q, lambda: make(6)).count() == 6
    assert results.key("graph", q) != results.key("graph", pr.graph({"min": "5"}))


def test_sizes_name_missing_tables(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    rows = {r["name"]: r["bytes"] for r in layout.sizes(spark, {"t": str(tmp_path / "t"), "none": str(tmp_path / "x")}).collect()}
    assert rows["t"] > 0 and rows["none"] is None and rows["total"] == rows["t"]
