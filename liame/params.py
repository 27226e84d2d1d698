"""Request parameters: clamping, snapping and the typed queries of every route."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from liame.clock import ANCHOR, ZONE
from liame.functions.text import normalize_text
from liame.operators.scope import KINDS, Scope
from liame.plans.build import LEAST, SOURCES, TOP

# What a request may ask for.
DAYS = (7, 21)
LIMITS = (1, 5, 8, 12, 18, 20, 24, 30, 40, 50, 60, 100, TOP)
SMALL_LIMITS = tuple(x for x in LIMITS if x <= 100)
BASELINES = (14,)
OFFSETS = tuple(range(0, 1001, 50))
WEEKS = (4, 12, 26)
LEANS = ("left", "right", "center")
BRIDGE_NODES = 60
AGENDA_LIMIT = 30

Raw = Mapping[str, str]
_HOST = re.compile(r"[a-z0-9.:-]{1,120}")
_LABEL = re.compile(r"[\w.:/-]{1,128}", re.ASCII)


def leading_int(v: str | None) -> int | None:
    m = re.match(r"\s*([+-]?\d+)", v or "")
    return int(m.group(1)) if m else None


def clamp(v: str | None, default: int, lo: int, hi: int) -> int:
    n = leading_int(v)
    return default if n is None else min(hi, max(lo, n))


def snap(allowed: tuple[int, ...], v: str | None, default: int) -> int:
    """The allowed value nearest to ``v``; of two equally near the first."""
    n = leading_int(v)
    return default if n is None else min(allowed, key=lambda x: abs(x - n))


def listed(v: str | None, keep: Callable[[str], bool]) -> tuple[str, ...] | None:
    """Distinct valid items of a comma list; None (all) if there is none."""
    items = tuple(dict.fromkeys(s for s in (x.strip() for x in (v or "").split(",")) if keep(s)))
    return items or None


def country(v: str | None) -> str:
    asked = {s.strip() for s in (v or "").split(",")}
    if "all" in asked or {"br", "pt"} <= asked:
        return "all"
    return "pt" if "pt" in asked else "br"


def bridge_ids(v: str | None) -> list[str]:
    ids = {s.strip() for s in (v or "").split(",")}
    good = (i for i in ids if i.partition(":")[0] in KINDS and i.partition(":")[2])
    return sorted(good)[:BRIDGE_NODES]


def calendar_day(v: str | None) -> date | None:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", v or "", re.ASCII):
        return None
    try:
        return date.fromisoformat(v or "")
    except ValueError:
        return None


def monday_of(day: date) -> date:
    return day - timedelta(days=day.weekday())


def now_utc(at: str = ANCHOR) -> datetime:
    return datetime.fromisoformat(at).replace(tzinfo=UTC)


def today(at: str = ANCHOR, zone: str = ZONE) -> date:
    return now_utc(at).astimezone(ZoneInfo(zone)).date()


def midnight(day: date, zone: str = ZONE) -> datetime:
    """UTC instant of a local midnight; of an ambiguous or missing one the later reading."""
    wall = datetime.combine(day, time(), ZoneInfo(zone))
    return max(wall.replace(fold=f).astimezone(UTC) for f in (0, 1))


def overlaps(day: date, days: int, at: str = ANCHOR) -> bool:
    """Whether a local day has begun and reaches into the window."""
    return midnight(day) <= now_utc(at) and midnight(day + timedelta(days=1)) > now_utc(at) - timedelta(days=days)


def kept_day(v: str | None, days: int, at: str = ANCHOR) -> str:
    day = calendar_day(v)
    return str(day) if day and overlaps(day, days, at) else ""


def kept_week(v: str | None, day: str, days: int, at: str = ANCHOR) -> str:
    """Monday of the asked week; a day filter, a future week or one before the window leaves none."""
    asked = calendar_day(v)
    if not asked or day:
        return ""
    monday = monday_of(asked)
    last = min(monday + timedelta(days=6), today(at))
    return str(monday) if monday <= today(at) and overlaps(last, days, at) else ""


def scope(q: Raw, days: int = 21) -> Scope:
    return Scope(
        days=snap(DAYS, q.get("days"), days), sources=listed(q.get("source"), SOURCES.__contains__),
        domains=listed(q.get("domain"), lambda s: bool(_HOST.fullmatch(s))), leans=listed(q.get("lean"), LEANS.__contains__), country=country(q.get("country")),
    )


def kinds(q: Raw) -> tuple[str, ...] | None:
    return listed(q.get("kind"), KINDS.__contains__)


def method(q: Raw, default: str = "stub") -> str:
    v = q.get("method", "")
    return v if _LABEL.fullmatch(v) else default


def lens(v: str | None) -> tuple[str, dict]:
    """Label and scope fields of a lens: domain:x, lean:x, source:x, else all."""
    kind, _, value = (v or "").strip().partition(":")
    if kind == "domain" and _HOST.fullmatch(value):
        return f"domain:{value}", {"domains": (value,)}
    if kind == "lean" and value in LEANS:
        return f"lean:{value}", {"leans": (value,)}
    if kind == "source" and value in SOURCES:
        return f"source:{value}", {"sources": (value,)}
    return "all", {}


@dataclass(frozen=True)
class GraphQuery:
    scope: Scope
    kinds: tuple[str, ...] | None
    limit: int
    least: int
    sort: str
    method: str | None
    communities: bool


def graph(q: Raw) -> GraphQuery:
    return GraphQuery(scope(q), kinds(q), snap(LIMITS, q.get("limit"), 40), snap(LEAST, q.get("min"), 2), "pmi" if q.get("sort") == "pmi" else "count", method(q) if q.get("testimony") == "1" else None, q.get("communities") == "1")


@dataclass(frozen=True)
class DocsQuery:
    scope: Scope
    kinds: tuple[str, ...] | None
    term: str
    limit: int
    offset: int
    day: str
    week: str
    with_person: str


def docs(q: Raw, person_id: str = "", at: str = ANCHOR) -> DocsQuery:
    s = scope(q)
    day = kept_day(q.get("day"), s.days, at)
    other = q.get("with", "").strip()
    return DocsQuery(s, kinds(q), normalize_text(q.get("term", "").strip()), snap(LIMITS, q.get("limit"), 50), snap(OFFSETS, q.get("offset"), 0), day, kept_week(q.get("week"), day, s.days, at), other if other != person_id else "")


@dataclass(frozen=True)
class RisingQuery:
    scope: Scope
    kinds: tuple[str, ...] | None
    baseline: int
    limit: int
    least: int


def rising(q: Raw) -> RisingQuery:
    return RisingQuery(scope(q, 7), kinds(q), snap(BASELINES, q.get("baseline"), 14), snap(SMALL_LIMITS, q.get("limit"), 40), snap(LEAST, q.get("min"), 3))


@dataclass(frozen=True)
class TimelineQuery:
    scope: Scope
    kinds: tuple[str, ...] | None
    term: str
    bucket_days: int


def timeline(q: Raw) -> TimelineQuery:
    return TimelineQuery(scope(q), kinds(q), normalize_text(q.get("term", "").strip()), 1 if q.get("bucket") == "day" else 7)


@dataclass(frozen=True)
class FloorQuery:
    """Routes with a window, a floor and a limit: tone, agenda, testimony, comention, candidates, attention."""

    scope: Scope
    least: int
    limit: int | None = None
    method: str | None = None


def tone(q: Raw) -> FloorQuery:
    return FloorQuery(Scope(snap(DAYS, q.get("days"), 21), country="all"), snap(LEAST, q.get("min"), 3))


def agenda(q: Raw) -> FloorQuery:
    return FloorQuery(Scope(snap(DAYS, q.get("days"), 21), listed(q.get("source"), SOURCES.__contains__)), snap(LEAST, q.get("min"), 5), AGENDA_LIMIT)


def testimony(q: Raw) -> FloorQuery:
    return FloorQuery(Scope(snap(DAYS, q.get("days"), 21), listed(q.get("source"), SOURCES.__contains__), country="all"), snap(LEAST, q.get("min"), 3), method=method(q))


def comention(q: Raw) -> FloorQuery:
    return FloorQuery(Scope(snap(DAYS, q.get("days"), 21), listed(q.get("source"), SOURCES.__contains__), leans=listed(q.get("lean"), LEANS.__contains__)), snap(LEAST, q.get("min"), 3))


def candidates(q: Raw) -> FloorQuery:
    return FloorQuery(Scope(snap(DAYS, q.get("days"), 7), country="all"), snap(LEAST, q.get("min"), 5), snap(LIMITS, q.get("limit"), 50))


def attention(q: Raw) -> FloorQuery:
    return FloorQuery(Scope(snap(DAYS, q.get("days"), 21), country="all"), 0)


@dataclass(frozen=True)
class PairQuery:
    """Two sides: compare (one scope) or lenses (a scope each)."""

    a: Scope
    b: Scope
    kinds: tuple[str, ...] | None
    limit: int
    bridges: bool


def compare(q: Raw) -> PairQuery:
    s = scope(q)
    return PairQuery(s, s, kinds(q), snap(SMALL_LIMITS, q.get("limit"), 40), q.get("bridges") == "1")


def lenses(q: Raw) -> PairQuery:
    a, b = (Scope(days=snap(DAYS, q.get("days"), 21), **lens(q.get(k))[1]) for k in ("a", "b"))
    return PairQuery(a, b, kinds(q), snap(SMALL_LIMITS, q.get("limit"), 40), q.get("bridges") == "1")


@dataclass(frozen=True)
class WeekQuery:
    scope: Scope
    kinds: tuple[str, ...] | None
    limit: int
    method: str | None


def week(q: Raw) -> WeekQuery:
    return WeekQuery(scope(q, 7), kinds(q), snap(LIMITS, q.get("limit"), 8), method(q) if q.get("testimony") == "1" else None)


@dataclass(frozen=True)
class PersistenceQuery:
    weeks: int
    limit: int


def persistence(q: Raw) -> PersistenceQuery:
    return PersistenceQuery(snap(WEEKS, q.get("weeks"), 12), snap(LIMITS, q.get("limit"), 40))
