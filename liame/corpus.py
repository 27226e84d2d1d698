"""The engine's relations over a folder of tables, with the keys that the operators rely on."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liame.functions.text import name_tokens
from liame.sources.tables import load


@dataclass(frozen=True)
class Person:
    """A person; ``tracked`` is false for an id that the persons lack, of whose spellings nothing is known."""

    id: str
    name: str
    aliases: tuple[str, ...]
    tracked: bool = True

    @property
    def tokens(self) -> list[str]:
        """Words of the person's own spellings; a term made of them says nothing about the person."""
        return name_tokens(self.aliases)


@dataclass(frozen=True)
class Corpus:
    """docs with unique doc_id; the junctions without repeated rows, so that counts of rows are counts of documents."""

    docs: DataFrame
    doc_persons: DataFrame
    doc_terms: DataFrame
    terms: DataFrame
    persons: DataFrame
    candidates: DataFrame
    phrases: DataFrame

    def persisted(self) -> Corpus:
        """The same relations, kept by the executors after their first use; for many questions to tables that fit."""
        kept = {f.name: getattr(self, f.name).persist() for f in fields(self)}
        return Corpus(**kept)

    def person(self, person_id: str) -> Person:
        p = self.known_or_not(person_id)
        if not p.tracked:
            raise LookupError(f"no person {person_id}")
        return p

    def known_or_not(self, person_id: str) -> Person:
        """The person of a fixed id, which the tables at hand may lack."""
        row = self.persons.where(F.col("id") == person_id).select("id", "name", "aliases").first()
        if row is None:
            return Person(person_id, "", (), tracked=False)
        return Person(row["id"], row["name"], tuple(a for a in row["aliases"] or () if a))


def corpus(spark: SparkSession, folder: str) -> Corpus:
    """Relations of a folder. A term that stands under several ids goes by the smallest of them."""
    read = lambda name: load(spark, folder, name)
    ids = read("terms").select("term_id", "kind", "term").distinct().withColumn("one", F.min("term_id").over(Window.partitionBy("kind", "term")))
    return Corpus(
        docs=read("docs"),
        doc_persons=read("doc_persons").select("doc_id", "person_id").distinct(),
        doc_terms=read("doc_terms").join(ids.select("term_id", "one"), "term_id").select("doc_id", F.col("one").alias("term_id")).distinct(),
        terms=ids.where("term_id = one").select("term_id", "kind", "term"),
        persons=read("persons"),
        candidates=read("doc_candidates").select("doc_id", "name").distinct(),
        phrases=read("phrases"),
    )
