"""Evaluation texts inside training text: a BM25 index of the test items, searched with block-max WAND.

The index is built from the test items alone, in shards of bounded size that are
sent to every task one after the other. Every document is cut into overlapping passages, each passage
is a query, and every item above the threshold is verified word by word. The
threshold loses nothing: a passage that holds ``words`` consecutive words of an
item scores at least the least weighted run of that many words of that item.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liame.plans.parallel import spread
from liame.sources.tables import load

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
BLOCK = 16
SHARD_MB = 8  # text of the items of one index
MARKS = re.compile("[" + "".join(chr(c) for c in range(0xAD, 0x10000) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")) + "]")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits without case, accents and invisible characters."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
        if max(text, default="") > "\uffff":
            text = "".join(c for c in text if c <= "\uffff" or unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    return WORD.findall(text.lower())


class Index:
    """Inverted index of the items: per word its postings in blocks with the largest impact of each block."""

    def __init__(self, items: list[tuple[int, str]], run: int) -> None:
        self.run = run
        self.ids: list[int] = []
        self.texts: list[list[str]] = []
        self.asks: list[int] = []
        for item_id, text in sorted(items):
            w = words_of(text)
            if len(w) >= run:
                self.ids.append(item_id)
                self.texts.append(w)
                first, more, _ = text.partition("\n")
                self.asks.append(len(words_of(first)) if more else 0)
        n, mean = len(self.texts), sum(map(len, self.texts)) / max(1, len(self.texts))
        df = Counter(t for w in self.texts for t in set(w))
        idf = {t: log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.least: list[float] = []
        for k, w in enumerate(self.texts):
            tf = Counter(w)
            impact = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in tf.items()}
            for t, x in impact.items():
                self.postings.setdefault(t, []).append((k, x))
            self.least.append(min(sum(impact[t] for t in set(w[i : i + run])) for i in range(len(w) - run + 1)) - 1e-9)
        self.threshold = min(self.least, default=float("inf"))
        self.top = {t: max(x for _, x in p) for t, p in self.postings.items()}
        self.blocks = {t: [(p[i : i + BLOCK][-1][0], max(x for _, x in p[i : i + BLOCK])) for i in range(0, len(p), BLOCK)] for t, p in self.postings.items()}

    def search(self, passage: list[str]) -> list[int]:
        """Items that score their own threshold or more against the passage, by block-max WAND."""
        terms = [t for t in set(passage) if t in self.postings]
        if sum(self.top[t] for t in terms) < self.threshold:
            return []
        lists = [self.postings[t] for t in terms]
        tops, blocks = [self.top[t] for t in terms], [self.blocks[t] for t in terms]
        at = [0] * len(terms)
        live = list(range(len(terms)))
        found = []
        while live:
            live.sort(key=lambda j: lists[j][at[j]][0])
            bound, pivot = 0.0, -1
            for i, j in enumerate(live):
                bound += tops[j]
                if bound >= self.threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            # The blocks in which the pivot lies bound its score more closely than the whole lists.
            close, ends = 0.0, []
            for j in live[: pivot + 1]:
                b = at[j] // BLOCK
                while b < len(blocks[j]) and blocks[j][b][0] < item:
                    b += 1
                if b < len(blocks[j]):
                    close += blocks[j][b][1]
                    ends.append(blocks[j][b][0])
            if close >= self.threshold:
                score = 0.0
                for j in live[: pivot + 1]:
                    p, k = lists[j], at[j]
                    while k < len(p) and p[k][0] < item:
                        k += 1
                    if k < len(p) and p[k][0] == item:
                        score += p[k][1]
                        k += 1
                    at[j] = k
                if score >= self.least[item]:
                    found.append(item)
                target = item + 1
            else:
                # No item up to the end of the nearest block can pass, unless a further list begins before it.
                target = min(ends, default=item) + 1
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][at[live[pivot + 1]]][0])
                target = max(target, item + 1)
            for j in live[: pivot + 1]:
                p, k = lists[j], at[j]
                while k < len(p) and p[k][0] < target:
                    k += 1
                at[j] = k
            live = [j for j in live if at[j] < len(lists[j])]
        return found

    def runs(self, k: int) -> dict[tuple[str, ...], tuple[bool, bool]]:
        """An item's runs: whether they touch its first line (the question) and the rest (the answer); made when first asked for."""
        known = self.__dict__.setdefault("_runs", {})
        if k not in known:
            if len(known) >= 1000:
                known.clear()
            w, ask = self.texts[k], self.asks[k]
            own: dict[tuple[str, ...], tuple[bool, bool]] = {}
            for i in range(len(w) - self.run + 1):
                g = tuple(w[i : i + self.run])
                q, a = own.get(g, (False, False))
                own[g] = (q or i < ask, a or i + self.run > ask)
            known[k] = own
        return known[k]

    def leaks(self, words: list[str], size: int) -> dict[int, tuple[int, int, bool, bool]]:
        """item -> (number of its runs in the words, longest stretch of consecutive words, whether question and answer are touched)."""
        out: dict[int, tuple[int, int, bool, bool]] = {}
        step = max(1, size - self.run + 1)
        candidates: set[int] = set()
        for i in range(0, max(1, len(words) - self.run + 1), step):
            candidates.update(self.search(words[i : i + size]))
        if candidates:
            grams = [tuple(words[i : i + self.run]) for i in range(len(words) - self.run + 1)]
            for k in candidates:
                runs = self.runs(k)
                hits = [i for i, g in enumerate(grams) if g in runs]
                if hits:
                    best = length = 1
                    for x, y in zip(hits, hits[1:]):
                        length = length + 1 if y == x + 1 else 1
                        best = max(best, length)
                    found = {grams[i] for i in hits}
                    out[self.ids[k]] = (len(found), best + self.run - 1, any(runs[g][0] for g in found), any(runs[g][1] for g in found))
        return out


def leaked(documents: DataFrame, items: DataFrame, words: int = 12, passage: int = 64) -> DataFrame:
    """(doc_id, item_id, n_runs, longest, question, answer): documents that hold ``words`` consecutive words of an item.

    ``documents`` has (doc_id, text), ``items`` (item_id, text); rows with a
    null in these hold nothing, repeated rows count once, items shorter than
    ``words`` words can't be found. ``n_runs`` counts the item's runs found,
    ``longest`` is the longest stretch; ``question`` tells whether a run found
    touches the item's first line, if it has more than one, ``answer`` whether
    one touches the rest. Passages of ``passage`` words overlap by ``words`` -
    1, so no run falls between two. Items of more than SHARD_MB go into as many
    indexes; each is built, sent and searched with by itself, over all documents.
    """
    items = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    mb = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6
    shards = int(mb / SHARD_MB) + 1
    spark = documents.sparkSession
    texts = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    schema = "doc_id long, item_id long, n_runs long, longest long, question boolean, answer boolean"

    def searcher(shared):
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared.value
            for batch in batches:
                rows = [
                    (doc_id, item_id, *n)
                    for doc_id, text in zip(batch["doc_id"], batch["text"])
                    for item_id, n in own.leaks(words_of(text), passage).items()
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_runs", "longest", "question", "answer"])

        return search

    parts = []
    for i in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == i)
        shared = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in own.collect()], words))
        parts.append(texts.mapInPandas(searcher(shared), schema))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_runs", "longest", "question", "answer")))


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(load(spark, folder, "documents"), load(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item with the number of documents that hold a part of it."""
    leaks = p8_leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.max("longest").alias("longest"))
    items = load(spark, folder, "eval_items").select("item_id", "suite")
    return items.join(leaks, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"), "longest")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks, "p8_items": p8_items}

_RUNS = r"""
with
e as (select item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') as t,
  case when contains(text, chr(10)) then len(regexp_extract_all(lower(strip_accents(string_split(text, chr(10))[1])), '[\p{L}\p{N}]+')) else 0 end as ask from eval_items),
d as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') as t from documents),
er as (select item_id, ask, unnest(range(1, len(t) - 10)) as j, unnest([array_to_string(t[i:i + 11], ' ') for i in range(1, len(t) - 10)]) as g from e where len(t) >= 12),
eg as (select item_id, g, bool_or(j <= ask) as question, bool_or(j + 11 > ask) as answer from er group by 1, 2),
dr as (select doc_id, unnest(range(1, len(t) - 10)) as i, unnest([array_to_string(t[i:i + 11], ' ') for i in range(1, len(t) - 10)]) as g from d where len(t) >= 12),
h as (select distinct doc_id, item_id, i, g, question, answer from eg join dr using (g)),
r as (select *, i - row_number() over (partition by doc_id, item_id order by i) as island from h),
f as (select doc_id, item_id, count(distinct g) as n_runs, bool_or(question) as question, bool_or(answer) as answer from h group by 1, 2),
l as (select doc_id, item_id, max(n) + 11 as longest from (select doc_id, item_id, island, count(*) as n from r group by 1, 2, 3) group by 1, 2)
"""
SQL = {
    "p8_found": _RUNS + "select doc_id, item_id from f",
    "p8_leaks": _RUNS + "select * from f join l using (doc_id, item_id)",
    "p8_items": _RUNS + """, n as (select item_id, count(*) as n, max(longest) as longest from l group by 1)
select item_id, suite, coalesce(n, 0)::bigint as n_docs, longest from eval_items left join n using (item_id)""",
}
