"""Texts that stop before they were complete.

Near-copies are found by min-hash banding over shingles of five words;
verified pairs (similarity of 0.8 or more) are aligned, and the copy whose
alignment ends early, inside a word or sentence of the other, is cut. A record
that no copy decides is scored by itself: the terminality of its closing words,
after the lines a site adds have been set aside. Terminality is fitted on the
lines of all records: one pass counts in how many records a word stands; a
second one counts the contexts of all places and notes those of each record's
closing words, counts its words and signs it for the bands. Closing words meet
the counts of their contexts in joins.
"""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liame.llm.lines import alike_lines
from liame.llm.visual import LOOKS_LIKE, _unaccented
from liame.plans.lineage import cut, release
from liame.plans.parallel import tasks
from liame.sources.tables import load

SAMPLE_CHARS = None  # no sample is taken and nothing reads this; a test that bounds one still sets the name
HELD = 1_000_000  # tokens whose contexts, or words, that a task counts before it hands the counts on
BANDS, ROWS = 20, 5  # a pair of similarity 0.8 shares a band with probability 0.9996
SHINGLE, SIMILAR = 5, 0.8
HEAVY = 2000  # members of a band from which on it is split
FREQUENT, VERY_FREQUENT = 0.01, 0.15  # share of documents from which on a word stands for itself in a fine or coarse context
VIEWS = ((0, 4), (0, 3), (1, 5), (1, 4))  # contexts of a last word: the first decides, else the better of the next two, else the last
DOTS = (2, 2)  # context of a last word before dots, as written
ENOUGH = 10  # occurrences from which on a context counts
LOW = 0.2  # terminality below which an ending is none
TAG_TAIL = re.compile(r"(?:(?:^|\s+)(?:#\w+|https?://\S+|www\.\S+|@\w[\w.]*)|\s*[\U0001F000-\U0001FAFF←-⯿️‍]+)+\s*$")
TAGGED = re.compile(r"#\w|https?:|www\.|@\w")
MARK = re.compile(r"\s*(\[\s?(?:…|\.{2,})\s?\]|\(\s?(?:…|\.{2,})\s?\)|…|\.{2,})$")
CODE = re.compile(r"(?:�+|&(?:#\d{0,6}|#x[0-9a-fA-F]{0,5}|[A-Za-z]{1,8}\d{0,2})?|%[0-9A-F]?|\\u[0-9a-f]{0,3})$")
ABBREVIATED = re.compile(r"(?:^|\s)(?:[A-Z]|[Dd]ra?|[Dd]ep|[Ss]en|[Gg]ov|[Vv]er|[Pp]rof|[Ss]ra?|[Ii]nst|[Ff]ed|[Aa]ssoc|[Cc]oop|[Ss]ind|[Mm]ov|[Cc]ons|[Aa]rt|[Nn]|[Aa]v)\.$")
STRANGE = re.compile("[^\x20-\x7e\xa1-\xac\xae-\xff–—‘’“”…]")  # characters that may need another form
TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
WORD = re.compile(r"\w+(?:[-'’]\w+)*")
ENTITIES = tuple(html.entities.html5)
LATIN = {ord(x[0]): x[1] for x in LOOKS_LIKE}
OPEN = set(",;:-–—(“«/&@#")


def visible(line: str) -> str:
    """A line with compatible and look-alike characters in one form, without invisible ones; dots stay as they are."""
    if STRANGE.search(line):
        line = "".join(c if c == "…" else unicodedata.normalize("NFKC", c) for c in unicodedata.normalize("NFC", line) if unicodedata.category(c) != "Cf").translate(LATIN)
    return line.strip()


def readable(line: str) -> str:
    """A visible line with its entities decoded."""
    return visible(html.unescape(line)) if "&" in line else visible(line)


@lru_cache(maxsize=200_000)
def _number(token: str) -> int:
    """A token's 64-bit number, the same in every process."""
    return int.from_bytes(blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


class Shapes:
    """Turns tokens into numbers of a fine and a coarse shape (numbers are 0, names and rare words W) and of the words as written.

    ``words`` holds the frequent words, true for the very frequent ones; the
    fine shape keeps all of these, the coarse shape the very frequent.
    """

    def __init__(self, words: dict[str, bool]) -> None:
        self.words = words
        self.rare, self.digit, self.edge = _number("W"), _number("0"), _number("^")
        self.known: dict[tuple[str, bool], tuple[int, int, int]] = {}

    def __call__(self, tokens: list[str]) -> tuple[list[int], list[int], list[int]]:
        if not any(t.islower() for t in tokens):
            tokens = [t.lower() for t in tokens]
        fine, coarse, literal, begins, known = [], [], [], True, self.known
        for t in tokens:
            pair = known.get((t, begins)) or self._pair(t, begins)
            fine.append(pair[0])
            coarse.append(pair[1])
            literal.append(pair[2])
            begins = t in ".!?:“"
        return fine, coarse, literal

    def _pair(self, t: str, begins: bool) -> tuple[int, int, int]:
        low = t.lower()
        if not t[0].isalnum():
            pair = (_number(t), _number(t))
        elif t[0].isdigit():
            pair = (self.digit, self.digit)
        elif low == t or begins:
            top = self.words.get(low)
            pair = (self.rare if top is None else _number(low), _number(low) if top else self.rare)
        else:
            pair = (self.rare, self.rare)
        pair = (*pair, _number(low))
        if len(self.known) < 200_000:
            self.known[t, begins] = pair
        return pair


PAD = 5  # edge marks before a line, as many as a context may reach back
WEIGHTS = [int(x) | 1 for x in np.random.default_rng(3).integers(1, 2**63, 16, dtype=np.uint64)]
SALTS = [int(x) for x in np.random.default_rng(4).integers(1, 2**63, 8, dtype=np.uint64)]


def _contexts(padded: np.ndarray, at: np.ndarray, view: int) -> np.ndarray:
    """Keys of the tokens that ``view`` sees before each position of a padded row of numbers."""
    total = np.full(len(at), SALTS[view], dtype=np.uint64)
    for j in range(1, (*VIEWS, DOTS)[view][1] + 1):
        total += padded[at - j] * np.uint64(WEIGHTS[j])
    return total.view(np.int64)


def _untagged(line: str) -> str:
    """A line without the tags, links, mentions and emoji at its end."""
    if line and (TAGGED.match(line.rsplit(None, 1)[-1]) or line[-1] > "\u218f"):
        line = TAG_TAIL.sub("", line)
    return line.rstrip()


def _ending(line: str) -> tuple[str, str]:
    """('code' | 'gap' | 'dots' | 'stop' | 'open' | 'plain' | 'none', the line without its tags and mark)."""
    line = _untagged(visible(line))
    if not line:
        return "none", ""
    m = MARK.search(line, max(0, len(line) - 12))
    if m:
        body = line[: m.start()].rstrip()
        if not body:
            return "none", ""
        return ("dots" if m.group(1)[0] in "…." else "gap"), body
    m = CODE.search(line, max(0, len(line) - 14))
    if m and m.group():
        code = m.group()
        if code[0] in "�\\" or code[0] == "%" and re.search(r"%[0-9A-F]{2}\S*$", line[: m.start()]) or code[:2] == "&#" or code == "&" or code[0] == "&" and any(e.startswith(code[1:]) and e.endswith(";") for e in ENTITIES):
            return "code", line
    text = readable(line)
    if not text:
        return "none", ""
    if ABBREVIATED.search(text, max(0, len(text) - 8)):
        return "open", line
    if text[-1] in ".!?)]}”»\"'’":
        return "stop", line
    if text[-1] in OPEN:
        return "open", line
    return "plain", line


class Contexts:
    """Counts the contexts of all places of the lines it is given, and how many lines end there."""

    def __init__(self, words: dict[str, bool]) -> None:
        self.shapes = Shapes(words)
        self.pad = array("Q", [self.shapes.edge] * PAD)
        self.noted: list[np.ndarray] = []
        self.n_noted = 0
        self._clear()

    def _clear(self) -> None:
        self.rows = (array("Q"), array("Q"), array("Q"))
        self.lines, self.plain, self.dots, self.asked = [], [], [], []

    def full(self) -> bool:
        return len(self.rows[0]) >= HELD

    def add(self, kind: str, tokens: list[str]) -> int:
        """The place of a line's last token."""
        start = len(self.rows[0]) + PAD
        for row, numbers in zip(self.rows, self.shapes(tokens)):
            row.extend(self.pad)
            row.extend(numbers)
        end = start + len(tokens) - 1
        self.lines.append((start, end + 1))
        if kind in ("plain", "dots"):
            (self.plain if kind == "plain" else self.dots).append(end)
        return end

    def note(self, place: int) -> int:
        """The number under which ``keys`` has the contexts of a place."""
        self.asked.append(place)
        self.n_noted += 1
        return self.n_noted - 1

    def counts(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per view its keys, their places and the lines that end there; of all places since the last call."""
        out = []
        if self.lines:
            places = np.concatenate([np.arange(a, b) for a, b in self.lines])
            asked, noted = np.array(self.asked, dtype=np.int64), []
            for view, (which, _) in enumerate((*VIEWS, DOTS)):
                row = np.frombuffer(self.rows[which], dtype=np.uint64)
                seen, n = np.unique(_contexts(row, places, view), return_counts=True)
                ended, e = np.unique(_contexts(row, np.array(self.dots if view == len(VIEWS) else self.plain, dtype=np.int64), view), return_counts=True)
                ends = np.zeros(len(seen), dtype=np.int64)
                ends[np.searchsorted(seen, ended)] = e
                out.append((view, seen, n, ends))
                noted.append(_contexts(row, asked, view))
            self.noted.append(np.stack(noted, axis=1))
        self._clear()
        return out

    def keys(self) -> np.ndarray:
        """A row of keys, one a view, for every place noted since the last call; after ``counts``."""
        out = np.concatenate(self.noted) if self.noted else np.zeros((0, len(VIEWS) + 1), dtype=np.int64)
        self.noted, self.n_noted = [], 0
        return out


def _closing(endings: list[tuple[str, str, list[str]]], site: set[int]) -> tuple[bool, list[int], int | None]:
    """(whether the text stops in the open by its marks, the lines whose closing words decide otherwise, the line before dots that may be rhetorical).

    Lines are taken from the last back to the first that is complete and no site line.
    """
    plain: list[int] = []
    for no in range(len(endings), 0, -1):
        kind, _, tokens = endings[no - 1]
        if kind == "none" or no in site and kind in ("stop", "plain", "open"):
            continue
        if kind == "stop":
            break
        if kind in ("code", "gap", "open"):
            return True, [], None
        if not tokens:
            continue
        if kind == "dots":
            return False, plain, no
        plain.append(no)
    return False, plain, None


def _lines_of(text: str) -> list[tuple[str, str, list[str]]]:
    """(kind of ending, line without its tags and mark, its tokens) of every line."""
    out = []
    for line in text.split("\n"):
        kind, body = _ending(line.rstrip())
        out.append((kind, body, TOKEN.findall(readable(body)) if body else []))
    return out


def _body(lines: list[tuple[str, str, list[str]]], site: set[int]) -> list[str]:
    """Lower-case words of the lines that are no site lines; a line's end is a token of its own."""
    out: list[str] = []
    for no, (_, _, tokens) in enumerate(lines, 1):
        if no not in site:
            words = [t.lower() for t in tokens if t[0].isalnum()]
            if words:
                out += [*words, "¶"]
    return out[:-1]


def _stays_open(lines: list[tuple[str, str, list[str]]], site: set[int]) -> bool:
    """Whether the last line that is no site line ends without a stop."""
    kinds = [kind for no, (kind, _, tokens) in enumerate(lines, 1) if no not in site and (tokens or kind != "none")]
    return bool(kinds) and kinds[-1] not in ("stop", "none")


def _shingles(tokens: list[str]) -> set[str]:
    words = [t for t in tokens if t != "¶"]
    return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


class Signer:
    """Min-hash bands over shingles of words."""

    def __init__(self) -> None:
        rng = np.random.default_rng(11)
        draw = lambda n, odd=0: rng.integers(0, 2**63, n, dtype=np.uint64) | np.uint64(odd)
        self.a, self.b, self.mix, self.salt, self.step = draw(BANDS * ROWS, 1), draw(BANDS * ROWS), draw(ROWS, 1), draw(BANDS), draw(SHINGLE, 1)

    def __call__(self, tokens: list[str]) -> tuple[int, list[int] | None]:
        """(number of different shingles, bands; null for a text without a shingle)."""
        numbers = np.array([_number(t) for t in tokens if t != "¶"], dtype=np.uint64)
        n = len(numbers) - SHINGLE + 1
        if n < 1:
            return 0, None
        h = np.zeros(n, dtype=np.uint64)
        for j in range(SHINGLE):
            h += numbers[j : j + n] * self.step[j]
        h = np.unique(h)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(h), 256):
            least = np.minimum(least, (h[i : i + 256, None] * self.a + self.b).min(axis=0))
        return len(h), ((least.reshape(BANDS, ROWS) * self.mix).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64).tolist()


def ends_early(short: list[str], full: list[str]) -> bool:
    """Whether ``short`` aligned with ``full`` stops inside a line of it, with text of ``full`` left."""
    blocks = [b for b in SequenceMatcher(None, short, full, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return False
    a, b = blocks[-1].a + blocks[-1].size, blocks[-1].b + blocks[-1].size
    if b >= len(full) or full[b] == "¶":
        return False
    if a == len(short):
        return True
    return a == len(short) - 1 and full[b].startswith(short[a]) and full[b] != short[a]


def _site_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, site_lines): lines repeated within a site, and lines that sites share but for the site's own name."""
    label = F.regexp_replace(F.substring_index(F.coalesce("domain", F.lit("")), ".", 1), "[^a-z0-9]", "")
    bare = F.transform(F.split(F.translate(F.array_join("lines", "\n"), *_unaccented()), "\n", -1), lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))
    named = lambda x: F.when(F.length("label") > 3, F.replace(x, F.col("label"), F.lit("@"))).otherwise(x)
    digest = lambda *parts: F.unhex(F.md5(F.concat_ws("\n", *parts)))
    rows = docs.select("doc_id", F.coalesce("domain", "source", F.lit("")).alias("site"), label.alias("label"), alike_lines("text").alias("lines")).withColumn("bare", bare)
    own = F.transform("lines", lambda x, i: F.when(x != "", F.struct((i + 1).cast("long").alias("line_no"), digest(F.lit("own"), F.col("site"), x).alias("key"))))
    shared = F.transform("bare", lambda x, i: F.when(x != "", F.struct((i + 1).cast("long").alias("line_no"), digest(F.lit("any"), named(x)).alias("key"))))
    keyed = cut(rows.select("doc_id", "site", F.array_compact(own).alias("own"), F.array_compact(shared).alias("shared")))
    each = keyed.select("doc_id", "site", F.explode("own").alias("x"), F.lit(True).alias("own")).unionByName(keyed.select("doc_id", "site", F.explode("shared").alias("x"), F.lit(False).alias("own")))
    each = each.select("doc_id", "site", "x.line_no", "x.key", "own")
    kept = each.groupBy("key", "own").agg(F.countDistinct("doc_id").alias("docs"), F.min("site").alias("a"), F.max("site").alias("b")).where("docs >= 5 and (own or a <> b)").select("key")
    return each.join(kept, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("line_no").alias("site_lines"))


def _frequent(texts: DataFrame) -> dict[str, bool]:
    """The words that stand in a share FREQUENT of all texts, true for those in a share VERY_FREQUENT; so many that the driver holds them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, words = 0, Counter()
        for batch in batches:
            for text in batch["text"]:
                n += 1
                words.update(set(WORD.findall(text.lower())))
            if len(words) > HELD:
                yield pd.DataFrame(words.items(), columns=["word", "n"])
                words = Counter()
        yield pd.DataFrame([*words.items(), (None, n)], columns=["word", "n"])

    counts = cut(texts.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.where("word is null").select("n").first()
    n = total["n"] if total else 0
    words = {r["word"]: r["n"] >= VERY_FREQUENT * n for r in counts.where(F.col("word").isNotNull() & (F.col("n") >= max(3, FREQUENT * n))).toLocalIterator()}
    release(counts)
    return words


def _open_closings(records: DataFrame, contexts: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id) of the records whose closing words are hardly ever the end of a line, or stand before dots that are not rhetorical.

    ``records`` has (doc_id, lasts, keys, dots), ``contexts`` (view, keys, counts, closed) as tasks counted them, ``words`` (word, n, ends).
    """
    each = contexts.select("view", F.explode(F.arrays_zip("keys", "counts", "closed")).alias("x")).select("view", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"), F.col("x.closed").alias("ends"))
    known = each.groupBy("view", "key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    shares = known.where((F.col("view") < len(VIEWS)) & (F.col("n") >= ENOUGH)).select("view", "key", (F.col("ends") / F.col("n")).alias("share"))
    rhetorical = known.where((F.col("view") == len(VIEWS)) & (F.col("ends") >= 3) & (F.col("ends") >= 0.5 * F.col("n"))).select(F.col("key").alias("dots"))
    views = range(len(VIEWS))
    line = F.transform("lasts", lambda x, i: F.struct(x.alias("last"), *[F.get(F.col("keys"), i * len(VIEWS) + v).alias(f"k{v}") for v in views]))
    lines = records.where(F.size("lasts") > 0).select("doc_id", F.explode(line).alias("x")).select("doc_id", "x.*")
    same = ["last", *[f"k{v}" for v in views]]
    asked = lines.select(*same).distinct().select(*same, F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"k{v}").alias("key")) for v in views])).alias("x")).select(*same, "x.*")
    found = asked.join(shares, ["view", "key"], "left").groupBy(*same).agg(*[F.max(F.when(F.col("view") == v, F.col("share"))).alias(f"r{v}") for v in views])
    # Words that stand often and close hardly any line.
    inside = words.where((F.col("n") >= 5 * ENOUGH) & (F.col("ends") < LOW / 40 * (F.col("n") + F.col("ends")))).select(F.col("word").alias("last"), F.lit(True).alias("inside"))
    r = [F.col(f"r{v}") for v in views]
    coarse = F.when(r[0].isNull(), F.coalesce(r[2], r[3]))
    fine = F.coalesce(r[0], r[1], F.lit(1.0))
    share = F.when(r[0].isNull() & r[1].isNotNull() & coarse.isNotNull(), F.greatest(fine, coarse)).otherwise(fine)
    low = found.join(inside, "last", "left").where(F.col("inside").isNotNull() | (share < LOW) | F.coalesce(coarse < LOW / 8, F.lit(False))).select(*same)
    dotted = records.where("dots is not null").select("doc_id", "dots").join(rhetorical, "dots", "left_anti")
    return lines.join(low, same, "left_semi").select("doc_id").unionByName(dotted.select("doc_id"))


OF_RECORD = "doc_id long, source string, site_lines array<long>, ending boolean, lasts array<string>, keys array<long>, dots long, whole long, size long, shingles long, open boolean, bands array<long>"
READ = f"{OF_RECORD}, word string, n long, ends long, view int, counts array<int>, closed array<int>"  # a row is a record, a word, or the contexts of one view


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, source, how): how is 'copy' (a near-copy goes on), 'ending', or null for a text taken as complete.

    ``docs`` has (doc_id, source, domain, text). Rows without doc_id are left
    out; a null, empty or blank text is complete; repeated rows count once. An
    ending is none if a mark of omission or half a character code stands there,
    if the closing words are followed by more in nearly all other lines, or if
    the last word is the beginning of a word of the collection and no word of it.
    Dots after words that often end so are rhetorical. Copies that end in the
    open are compared with all texts of similar size in the bands they share, the
    longest first, until one goes on; exact copies are compared once and get
    their verdict together. What no copy decides is scored by its ending.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select("doc_id", "source", "domain", "text")
    texts = rows.where("text is not null")
    one = rows.repartition(tasks(spark), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "source")).alias("r")).select("doc_id", "r.source", "r.text")
    shared = spark.sparkContext.broadcast(_frequent(one.where("text is not null")))
    base = one.join(_site_lines(texts), "doc_id", "left").select("doc_id", "source", F.coalesce("site_lines", F.array().cast("array<long>")).alias("site_lines"), "text")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contexts, sign = Contexts(shared.value), Signer()
        for batch in batches:
            out, rest, counts, closing = [], [], Counter(), Counter()
            for doc_id, source, site, text in zip(batch["doc_id"], batch["source"], batch["site_lines"], batch["text"]):
                if not text:
                    out.append([doc_id, source, site, False, [], [], None, None, 0, 0, False, None])
                    continue
                lines, own, places = _lines_of(text), set(site), {}
                for no, (kind, _, tokens) in enumerate(lines, 1):
                    if tokens and kind not in ("none", "code"):
                        places[no] = contexts.add(kind, tokens)
                        low = [t.lower() for t in tokens]
                        counts.update(low if kind == "stop" else low[:-1])
                        if kind == "plain":
                            closing[low[-1]] += 1
                ending, plain, dots = _closing(lines, own)
                lasts = [lines[no - 1][2][-1].lower() for no in plain]
                noted = [contexts.note(places[no]) for no in plain], None if dots is None else contexts.note(places[dots])
                body = _body(lines, own)
                n, bands = sign(body)
                whole = _signed(int.from_bytes(blake2b(" ".join(body).encode("utf-8", "replace"), digest_size=8).digest(), "little"))
                out.append([doc_id, source, site, ending, lasts, *noted, whole, len(body), n, _stays_open(lines, own), bands])
                if contexts.full():
                    rest += contexts.counts()
            rest += contexts.counts()
            keys = contexts.keys()
            for row in out:
                row[5] = keys[row[5], : len(VIEWS)].ravel() if row[5] else []
                row[6] = None if row[6] is None else int(keys[row[6], len(VIEWS)])
            blank = (None,) * 12
            out = [(*row, *(None,) * 6) for row in out]
            out += [(*blank, w, counts[w], closing[w], None, None, None) for w in counts.keys() | closing.keys() if w[0].isalnum()]
            out += [(*blank[:5], seen, *blank[6:], None, None, None, view, n.astype(np.int32), ends.astype(np.int32)) for view, seen, n, ends in rest]
            whole_numbers = ("doc_id", "dots", "whole", "size", "shingles", "n", "ends", "view")
            yield pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")], dtype=object).astype({k: "Int64" for k in whole_numbers})

    seen = cut(base.mapInPandas(read, READ))
    shared.unpersist()
    records = seen.where("doc_id is not null")
    words = seen.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    # Last words that no line has inside: beginnings of a word that lines have inside, or end with far more often?
    closers = records.select("doc_id", F.explode("lasts").alias("last"))
    unknown = cut(closers.select(F.col("last").alias("word")).distinct().join(words, "word", "left").where("coalesce(n, 0) = 0").select(F.col("word").alias("last"), F.coalesce("ends", F.lit(0)).alias("own")))
    longest = unknown.agg(F.max(F.length("last"))).first()[0] or 0  # no longer beginning of a word can be one of them
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length("word") - 1, F.lit(longest)), F.lit(1))), lambda i: F.substring(F.col("word"), F.lit(1), i))
    longer = words.where((F.col("n") > 0) | (F.col("ends") >= 2 * ENOUGH)).select(F.explode(heads).alias("last"), "n", "ends")
    longer = longer.join(unknown, "last").groupBy("last").agg(F.max("own").alias("own"), F.max("n").alias("inner"), F.max(F.col("n") + F.col("ends")).alias("mass"))
    pieces = longer.where((F.col("inner") > 0) | (F.col("mass") >= 5 * F.col("own"))).select("last")
    by_ending = records.where("ending").select("doc_id").unionByName(closers.join(pieces, "last", "left_semi").select("doc_id"))
    by_ending = by_ending.unionByName(_open_closings(records, seen.where("view is not null"), words))
    flagged = by_ending.select("doc_id", F.lit("ending").alias("how")).unionByName(_cut_copies(records, texts).select("doc_id", F.lit("copy").alias("how")))
    flagged = flagged.groupBy("doc_id").agg(F.min("how").alias("how"))
    return records.select("doc_id", "source").join(flagged, "doc_id", "left")


def _cut_copies(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id) of the copies whose alignment with a near-copy ends early.

    ``signed`` has (doc_id, site_lines, whole, size, shingles, open, bands),
    ``docs`` the texts. Left out are only pairs that can't count: a text whose
    last line ends with a stop, and numbers of shingles too far apart for the similarity.
    """
    signed = signed.where("bands is not null").select("doc_id", "site_lines", "whole", "size", "shingles", "open", "bands")
    # Exact copies of a body have one representative.
    one = signed.groupBy("whole").agg(F.min(F.struct("doc_id", "size", "shingles", "open", "bands")).alias("r")).select("r.*")
    banded = one.select("doc_id", "size", "shingles", "open", F.explode("bands").alias("band"))
    live = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any")).where("n > 1 and any").select("band", F.ceil(F.col("n") / HEAVY).cast("int").alias("salts"))
    # Similar texts stand in the same step of size or in neighbouring ones: a step is wider than 1 / SIMILAR.
    step = F.floor(F.log(F.col("shingles").cast("double")) / float(np.log(1.01 / SIMILAR))).cast("int")
    banded = cut(banded.join(live, "band").withColumn("step", step))
    full = banded.select("band", "step", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.col("doc_id").alias("full_id"), F.col("size").alias("full_size"), F.col("shingles").alias("full_shingles"))
    short = banded.where("open").select("band", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), "salts", "doc_id", "shingles")
    short = short.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    similar = F.least("shingles", "full_shingles") >= F.lit(SIMILAR) * F.greatest("shingles", "full_shingles")
    pairs = cut(short.join(full, ["band", "step", "salt"]).where((F.col("doc_id") != F.col("full_id")) & similar).select("doc_id", "full_id", "full_size").distinct())
    wanted = pairs.select("doc_id").unionByName(pairs.select(F.col("full_id").alias("doc_id"))).distinct()
    sides = docs.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).join(signed.select("doc_id", "site_lines"), "doc_id")
    left = sides.select("doc_id", F.col("text").alias("short"), F.col("site_lines").alias("short_site"))
    right = sides.select(F.col("doc_id").alias("full_id"), F.col("text").alias("full"), F.col("site_lines").alias("full_site"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=256)
        def words(text: str, site: tuple[int, ...]) -> tuple[list[str], set[str]]:
            tokens = _body(_lines_of(text), set(site))
            return tokens, _shingles(tokens)

        done = None
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.doc_id == done:
                    continue
                (x, sx), (y, sy) = words(row.short, tuple(row.short_site)), words(row.full, tuple(row.full_site))
                if len(sx & sy) >= SIMILAR * len(sx | sy) and ends_early(x, y):
                    done = row.doc_id
                    rows.append(done)
            yield pd.DataFrame({"doc_id": rows}, dtype="int64")

    # A text's partners stand together, the longest first; after one that goes on the rest is passed over.
    paired = pairs.join(right, "full_id").join(left, "doc_id").sortWithinPartitions("doc_id", F.desc("full_size"), "full_id")
    early = paired.select("doc_id", "short", "short_site", "full", "full_site").mapInPandas(align, "doc_id long").distinct()
    wholes = signed.join(early, "doc_id", "left_semi").select("whole").distinct()
    return signed.join(wholes, "whole", "left_semi").select("doc_id")


def p7_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(load(spark, folder, "docs"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_verdicts(spark, folder).where("how is not null").select("doc_id")


def p7_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, how many are cut, and their share."""
    return p7_verdicts(spark, folder).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("how").alias("n_cut"), (F.count("how") / F.count(F.lit(1))).alias("share"))


QUERIES = {"p7_found": p7_found, "p7_verdicts": p7_verdicts, "p7_sources": p7_sources}
SQL: dict[str, str] = {}
