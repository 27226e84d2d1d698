"""How often every term occurs, and in how many records, by suffix-sorted n-gram counting.

Every sequence is cut into its suffixes of at most ``max_n`` terms. A suffix
goes to the task of its first term; there the suffixes stand in reverse
lexicographic order, so that one pass with a stack of at most ``max_n`` open
prefixes sums the occurrences and record sets of all n-grams. A first term of
more than ``heavy`` suffixes is salted by record: then a record's suffixes stay
together, the counts of the salts add up, and no record set is larger than
about ``heavy``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liame.plans.lineage import cut
from liame.sources.tables import load

SEP = "\x1e"  # below every character of a term, so that a prefix follows its extensions in descending order
CONTROL = "".join(map(chr, range(32)))
SHOWN = "".join(chr(0xE100 + c) for c in range(32))  # what stands for control characters inside a term
OUT = "ngram string, n int, occurrences long, records long"


class _Stack:
    """Open prefixes of one (first term, salt), the longest on top."""

    def __init__(self) -> None:
        self.route: tuple | None = None
        self.terms: list[str] = []
        self.counts: list[int] = []
        self.sets: list[list[np.ndarray]] = []
        self.out: list[tuple] = []

    def close(self, depth: int) -> None:
        while len(self.terms) > depth:
            sets, count = self.sets.pop(), self.counts.pop()
            records = np.unique(np.concatenate(sets)) if len(sets) > 1 else np.unique(sets[0])
            self.out.append((SEP.join(self.terms), len(self.terms), count, len(records)))
            self.terms.pop()
            if self.terms:
                self.counts[-1] += count
                self.sets[-1].append(records)

    def add(self, route: tuple, suffix: str, records: np.ndarray) -> None:
        if route != self.route:
            self.close(0)
            self.route = route
        terms = suffix.split(SEP)
        same = 0
        for x, y in zip(terms, self.terms):
            if x != y:
                break
            same += 1
        self.close(same)
        for t in terms[same:]:
            self.terms.append(t)
            self.counts.append(0)
            self.sets.append([])
        self.counts[-1] += len(records)
        self.sets[-1].append(records)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stack = _Stack()
    for batch in batches:
        if not len(batch):
            continue
        suffix, salt, record = batch["suffix"].to_numpy(), batch["salt"].to_numpy(), batch["record"].to_numpy()
        new = np.flatnonzero((suffix[1:] != suffix[:-1]) | (salt[1:] != salt[:-1])) + 1
        edges = [0, *new.tolist(), len(batch)]
        for lo, hi in zip(edges, edges[1:]):
            s = suffix[lo]
            stack.add((s.split(SEP, 1)[0], salt[lo]), s, record[lo:hi])
        if stack.out:
            done, stack.out = stack.out, []
            yield pd.DataFrame(done, columns=["ngram", "n", "occurrences", "records"])
    stack.close(0)
    if stack.out:
        yield pd.DataFrame(stack.out, columns=["ngram", "n", "occurrences", "records"])


def ngram_counts(sequences: DataFrame, max_n: int = 1, heavy: int = 200_000) -> DataFrame:
    """Occurrences and records of every n-gram of 1 to ``max_n`` terms.

    ``sequences`` has (record long, terms array<string>); one record may have
    several sequences. Null records, arrays and terms count nothing (a null
    term is left out, its neighbours then stand together). Returns (ngram, n,
    occurrences, records), the terms of an n-gram separated by U+001E; control
    characters inside a term come out as U+E100 and following.
    """
    clean = lambda t: F.when(t.rlike(r"[\x00-\x1f]"), F.translate(t, CONTROL, SHOWN)).otherwise(t)
    terms = sequences.where("record is not null and terms is not null").select("record", F.transform(F.filter("terms", lambda t: t.isNotNull()), clean).alias("terms"))
    suffixes = terms.select("record", F.posexplode("terms").alias("i", "first"), "terms").select(
        "record", "first", F.concat_ws(SEP, F.slice("terms", F.col("i") + 1, max_n)).alias("suffix")
    )
    hot = suffixes.groupBy("first").count().where(F.col("count") > heavy).select("first", F.ceil(F.col("count") / heavy).cast("int").alias("salts"))
    routed = suffixes.join(hot, "first", "left").select(
        "record", "first", "suffix",
        F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("record"), F.col("salts"))).cast("int").alias("salt"),
    )
    ordered = routed.repartition("first", "salt").sortWithinPartitions("first", "salt", F.desc("suffix")).select("suffix", "salt", "record")
    parts = ordered.mapInPandas(_walk, OUT)
    return parts.groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def p6_counted(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct (kind, term) with its documents, its share of docs, the older phrases.count and its mark.

    Rows of terms without kind or term are no value. A value's documents are
    those of all its term_ids; rows of doc_terms whose term_id terms lacks
    belong to no value.
    """
    terms = load(spark, folder, "terms").where("kind is not null and term is not null").select("term_id", "kind", "term").distinct()
    value = F.min("term_id").over(Window.partitionBy("kind", "term"))
    terms = cut(terms.withColumn("value", value))
    rows = load(spark, folder, "doc_terms").where("doc_id is not null").join(terms.select("term_id", "value"), "term_id")
    counts = ngram_counts(rows.select(F.col("doc_id").alias("record"), F.array(F.col("value").cast("string")).alias("terms")))
    counts = counts.select(F.col("ngram").cast("long").alias("value"), "records")
    n = load(spark, folder, "docs").count()
    phrases = load(spark, folder, "phrases").where("term is not null").groupBy("term").agg(F.max("count").cast("long").alias("older"))
    docs = F.coalesce("records", F.lit(0)).cast("long")
    return (
        terms.groupBy("value").agg(F.first("kind").alias("kind"), F.first("term").alias("term"))
        .join(counts, "value", "left").join(phrases, "term", "left")
        .select(
            "kind", "term", docs.alias("n_docs"), (docs / F.lit(float(max(n, 1)))).alias("share"),
            F.when(F.col("kind") == "phrase", F.col("older")).alias("phrases_count"),
            F.when(docs < 3, "rare").when(docs > F.lit(0.15 * n), "common").alias("mark"),
        )
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_counted(spark, folder).where("mark is not null").select("kind", "term", "mark")


def p6_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Every word, pair and triple of docs.text with occurrences, documents and mark."""
    docs = load(spark, folder, "docs")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    counts = ngram_counts(docs.select(F.col("doc_id").alias("record"), words.alias("terms")), 3)
    mark = F.when(F.col("records") < 3, "rare").when(F.col("records") > F.lit(0.15 * docs.count()), "common")
    return counts.select(F.translate("ngram", SEP, " ").alias("ngram"), F.col("n").cast("long").alias("n"), "occurrences", "records", mark.alias("mark"))


QUERIES = {"p6_found": p6_found, "p6_counted": p6_counted, "p6_ngrams": p6_ngrams}

_COUNTED = """
with v as (select distinct kind, term from terms where kind is not null and term is not null),
d as (select kind, term, count(distinct doc_id) as n_docs from terms join doc_terms using (term_id) group by 1, 2),
n as (select count(*) as n from docs), o as (select term, max(count)::bigint as older from phrases group by 1),
c as (select kind, term, coalesce(n_docs, 0)::bigint as n_docs, coalesce(n_docs, 0) / greatest(n, 1)::double as share,
  case when kind = 'phrase' then older end as phrases_count,
  case when coalesce(n_docs, 0) < 3 then 'rare' when n_docs > 0.15 * n then 'common' end as mark
  from v left join d using (kind, term) left join o using (term), n)
"""
SQL = {
    "p6_found": _COUNTED + "select kind, term, mark from c where mark is not null",
    "p6_counted": _COUNTED + "select * from c",
    "p6_ngrams": r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from docs),
g as (select doc_id, unnest(t) as ngram, 1 as n from w
  union all select doc_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]), 2 from w
  union all select doc_id, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]), 3 from w),
c as (select ngram, n::bigint as n, count(*) as occurrences, count(distinct doc_id) as records from g group by 1, 2)
select *, case when records < 3 then 'rare' when records > 0.15 * (select count(*) from docs) then 'common' end as mark from c""",
}
