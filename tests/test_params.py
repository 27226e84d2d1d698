from datetime import date

import pytest

from liame import params as pr
from liame.operators.scope import Scope


@pytest.mark.parametrize("v,want", [("13", 7), ("14", 7), ("15", 21), ("x", 21), (None, 21), ("9999", 21), ("7abc", 7)])
def test_days_snap_to_the_smaller_on_ties(v, want):
    assert pr.snap(pr.DAYS, v, 21) == want


def test_clamp():
    assert pr.clamp("12x", 1, 0, 10) == 10 and pr.clamp("", 5, 0, 10) == 5 and pr.clamp("-3", 5, 0, 10) == 0


def test_lists_keep_valid_items():
    assert pr.scope({"source": "rss, nada,rss,gkg"}).sources == ("rss", "gkg") and pr.scope({"source": "nada"}).sources is None


@pytest.mark.parametrize("v,want", [(None, "br"), ("pt", "pt"), ("br,pt", "all"), ("all", "all"), ("xx", "br")])
def test_country(v, want):
    assert pr.country(v) == want


def test_day_beats_week_and_windows_bound_both():
    q = pr.docs({"day": "2026-08-30", "week": "2026-08-26"})
    assert (q.day, q.week) == ("2026-08-30", "")
    assert pr.docs({"week": "2026-08-26"}).week == "2026-08-24"
    assert pr.docs({"day": "2026-09-09"}).day == "" and pr.docs({"day": "2026-02-30"}).day == "" and pr.docs({"day": "2026-01-01"}).day == ""


def test_midnight_over_a_missing_hour():
    assert pr.midnight(date(2018, 11, 4)).isoformat() == "2018-11-04T03:00:00+00:00"
    assert pr.midnight(date(2026, 8, 31)).isoformat() == "2026-08-31T03:00:00+00:00"


def test_lens_and_bridges():
    assert pr.lens("source:rss") == ("source:rss", {"sources": ("rss",)}) and pr.lens("source:x") == ("all", {})
    assert pr.bridge_ids("word:b,word:a,x:y,word:") == ["word:a", "word:b"]


def test_routes_have_their_defaults():
    assert (pr.graph({}).limit, pr.graph({}).least, pr.graph({}).scope) == (40, 2, Scope(21))
    assert (pr.rising({}).scope.days, pr.rising({}).least) == (7, 3)
    assert (pr.candidates({}).least, pr.candidates({}).limit, pr.agenda({}).limit) == (5, 50, 30)
    assert (pr.persistence({}).weeks, pr.week({}).limit, pr.timeline({}).bucket_days) == (12, 8, 7)
    assert pr.lenses({"a": "lean:left"}).a.leans == ("left",)
