"""Ingest: merging repeated collections of one address, retention, and the streaming job."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liame.clock import ANCHOR, before
from liame.functions.text import country_of, domain_of, truncate
from liame.operators.extract import mention_rows
from liame.plans.lineage import cut

TONED = ("gkg", "gdelt")
REACH = ("reach_likes", "reach_reposts", "reach_replies", "reach_quotes")


def layers(docs: DataFrame, order: list[str]) -> DataFrame:
    """Documents with the number of earlier arrivals of their address."""
    return docs.withColumn("layer", F.row_number().over(Window.partitionBy("uri").orderBy(*order)) - 1)


def _first(column: str, arrival: Column) -> Column:
    return F.min_by(column, F.when(F.col(column).isNotNull(), arrival))


def merged(docs: DataFrame, order: list[str]) -> DataFrame:
    """One document per address out of all its arrivals, in one aggregation.

    The first arrival gives id, source and time; the longest text stays (of
    equally long ones the earliest), domain and country are the first known
    ones, tone too if the first source reports tone; reach is the largest seen
    for a microblog. ``arrivals`` counts them, ``enriched`` tells whether a later
    one changed anything but reach. Rows without an address are left out.
    """
    arrival = F.struct(*order)
    kept = docs.where("uri is not null").select(
        "uri", "doc_id", "source", "text", "published_at", "domain", "country", "tone", *REACH, arrival.alias("_at"),
    )
    first = lambda c: F.min_by(c, "_at")
    rows = kept.groupBy("uri").agg(
        first("doc_id").alias("doc_id"), first("source").alias("source"), first("published_at").alias("published_at"),
        F.max(F.length("text")).alias("_longest"), F.count(F.lit(1)).alias("arrivals"),
        _first("domain", F.col("_at")).alias("domain"), _first("country", F.col("_at")).alias("country"), _first("tone", F.col("_at")).alias("_tone"),
        first(F.coalesce(F.length("text"), F.lit(-1))).alias("_n0"), first(F.struct("domain", "country", "tone")).alias("_0"),
        *[F.max(c).alias(f"_{c}") for c in REACH], *[first(c).alias(f"_0{c}") for c in REACH],
    )
    texts = kept.select("uri", "text", "_at", F.length("text").alias("_longest")).groupBy("uri", "_longest").agg(F.min_by("text", "_at").alias("text"))
    texts = texts.select(F.col("uri").alias("_uri"), F.col("_longest").alias("_n"), "text")
    rows = rows.join(texts, (F.col("uri") == F.col("_uri")) & F.col("_longest").eqNullSafe(F.col("_n")), "left")
    tone = F.when(F.col("source").isin(*TONED), F.col("_tone"))
    blog = F.col("source") == "bluesky"
    changed = (
        (F.coalesce("_longest", F.lit(-1)) > F.col("_n0")) | ~F.col("domain").eqNullSafe(F.col("_0.domain"))
        | ~F.col("country").eqNullSafe(F.col("_0.country")) | (F.col("source").isin(*TONED) & ~F.col("_tone").eqNullSafe(F.col("_0.tone")))
    )
    return rows.select(
        "uri", "doc_id", "source", "text", "published_at", "domain", "country", tone.alias("tone"),
        *[F.when(blog, F.col(f"_{c}")).otherwise(F.col(f"_0{c}")).alias(c) for c in REACH], "arrivals", changed.alias("enriched"),
    )


def merge_into(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Stored and incoming documents merged; stored ones are the earlier arrivals."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return merged(both, ["_new", *order])


def retained(docs: DataFrame, days: int = 21, at: str = ANCHOR) -> DataFrame:
    """Documents that aren't older than the window."""
    return docs.where(F.col("published_at") >= before(days, at))


def cascade(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Derived rows whose document still stands."""
    return rows.join(docs.select("doc_id"), "doc_id", "left_semi")


def naming_someone(docs: DataFrame, doc_persons: DataFrame) -> DataFrame:
    """Documents that name a tracked person; the others are dropped before any write."""
    return docs.join(doc_persons.select("doc_id"), "doc_id", "left_semi")


def without_source(docs: DataFrame, source: str) -> DataFrame:
    """Purge of one source; rows of unknown source stay."""
    return docs.where(~F.col("source").eqNullSafe(F.lit(source)))


def orphan_terms(terms: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """Dictionary rows that no document uses."""
    return terms.join(doc_terms.select("term_id"), "term_id", "left_anti")


def without_kind(docs: DataFrame, kind: str) -> DataFrame:
    """Documents whose extra terms of one kind are gone."""
    return docs.withColumn("extra_terms", F.filter("extra_terms", lambda x: ~x["kind"].eqNullSafe(F.lit(kind))))


def backfilled(docs: DataFrame) -> DataFrame:
    """Missing domain and country derived from the address, texts capped, in one pass."""
    domain = F.coalesce("domain", F.when(F.col("source") != "bluesky", domain_of(F.col("uri"))))
    return docs.withColumn("domain", domain).withColumn("country", F.coalesce("country", country_of(F.col("domain")))).withColumn("text", truncate(F.col("text")))


def latest_views(rows: DataFrame) -> DataFrame:
    """(person_id, day, views): daily page views, malformed rows dropped, the last row of a day wins.

    ``rows`` has (person_id, timestamp string, views long, seq).
    """
    day = F.try_to_date(F.substring("timestamp", 1, 8), "yyyyMMdd")
    good = rows.where(F.col("timestamp").rlike(r"^\d{8}") & (F.col("views") >= 0)).withColumn("day", day).where("day is not null")
    return good.groupBy("person_id", "day").agg(F.max_by("views", "seq").alias("views"))


def upsert_persons(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Persons after an upsert: of an id the incoming row, of several incoming the last by ``seq`` if there is one."""
    if "seq" in incoming.columns:
        columns = [c for c in incoming.columns if c != "seq"]
        incoming = incoming.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("r")).select("r.*")
    return stored.join(incoming.select("id"), "id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def pruned(persons: DataFrame, doc_persons: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persons, doc_persons) without those whose id isn't in ``keep`` (id)."""
    return persons.join(keep.select("id"), "id", "left_semi"), doc_persons.join(keep.select(F.col("id").alias("person_id")), "person_id", "left_semi")


BUCKETS = 64  # parts of the document table, by hash of the address; a batch rewrites those it touches


class Store:
    """The document table of the stream: buckets of addresses, each in the version of the batch that last touched it.

    A batch writes new versions of the buckets it touches under its own number,
    then a manifest (bucket -> version) under a temporary name, and renames
    that: a batch that dies before the rename has changed nothing, and one that
    is replayed after it is passed over. Manifests have even numbers, twice the
    batch's; a compaction stands at the odd number after.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """Manifests in place."""
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def done(self, batch: int) -> bool:
        return any(n >= 2 * batch for n in self.numbers())

    def manifest(self) -> dict[int, str]:
        """bucket -> version, as it stands."""
        numbers = self.numbers()
        if not numbers:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]}", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, buckets: set[int] | None = None) -> DataFrame | None:
        """The documents, or those of some buckets; none if nothing is stored there."""
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(self.manifest().items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, version: str) -> dict[int, str]:
        at = f"{self.path}/data/{version}"
        rows.withColumn("bucket", bucket_of(F.col("uri"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        names = [x.getPath().getName() for x in self._fs.listStatus(self._hadoop.Path(at))]
        return {int(n.partition("=")[2]): version for n in names if n.startswith("bucket=")}

    def replace(self, rows: DataFrame, touched: set[int], batch: int) -> None:
        """Puts ``rows`` in place of the touched buckets' documents."""
        written = self._write(rows, f"batch-{batch}")
        self.publish({b: v for b, v in self.manifest().items() if b not in touched} | written, 2 * batch)

    def publish(self, manifest: dict[int, str], number: int) -> None:
        text = json.dumps({str(k): v for k, v in sorted(manifest.items())})
        temporary, final = self._at(f"manifests/.new-{number}"), self._at(f"manifests/{number}")
        out = self._fs.create(temporary, True)
        out.write(text.encode())
        out.close()
        if not self._fs.rename(temporary, final):
            raise OSError(f"manifest {number} of {self.path} could not be put in place")

    def compact(self, retain: int = 21, at: str = ANCHOR) -> None:
        """Writes all documents of the window as one version, then removes what is older."""
        numbers, whole = self.numbers(), self.read()
        if whole is None or numbers[-1] % 2:
            return
        version = f"compact-{numbers[-1] // 2}"
        self.publish(self._write(retained(whole, retain, at), version), numbers[-1] + 1)
        for n in numbers:
            self._fs.delete(self._at(f"manifests/{n}"), False)
        for x in self._fs.listStatus(self._at("data")):
            if x.getPath().getName() != version:
                self._fs.delete(x.getPath(), True)


def bucket_of(uri: Column) -> Column:
    return F.pmod(F.xxhash64(uri), F.lit(BUCKETS)).cast("int")


CORRUPT = "_corrupt_record"


def stream(
    spark: SparkSession, landing: str, schema: str, persons: DataFrame, store: str, checkpoint: str, order: list[str],
    after: Callable[[SparkSession, DataFrame], None] | None = None, retain: int = 21, at: str = ANCHOR,
):
    """A Structured Streaming job: landed JSON files, tagged, merged into the document table batch by batch.

    The file source's checkpoint is the ledger of processed files; their names
    and rows are kept in ``store/ledger`` too. Lines that are no JSON of the
    schema, and documents without id or address, go to ``store/rejected`` with
    the reason and stop nothing else. Each batch merges with the buckets it
    touches alone, and a replayed batch leaves the same table (``Store``).
    """
    source = spark.readStream.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(landing).withColumn("_file", F.col("_metadata.file_path"))

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        table = Store(session, store)
        if table.done(number):
            return
        rows = cut(rows)
        rows.groupBy("_file").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")
        reason = F.when(F.col(CORRUPT).isNotNull(), "no document").when(F.col("doc_id").isNull(), "no id").when(F.col("uri").isNull(), "no address")
        judged = rows.withColumn("_reason", reason)
        bad = judged.where("_reason is not null")
        bad.select(F.col("_reason").alias("reason"), F.coalesce(CORRUPT, F.to_json(F.struct("doc_id", "uri", "text"))).alias("raw"), F.col("_file").alias("file")).write.mode("overwrite").parquet(f"{store}/rejected/batch={number}")
        good = judged.where("_reason is null").drop(CORRUPT, "_file", "_reason").withColumn("text", truncate(F.col("text")))
        tagged = cut(good.join(mention_rows(good, persons).select("doc_id").distinct(), "doc_id", "left_semi"))
        touched = {r[0] for r in tagged.select(bucket_of(F.col("uri"))).distinct().collect()}
        if not touched:
            return
        earlier = table.read(buckets=touched)
        fresh = retained(tagged, retain, at)
        result = merge_into(earlier.drop("arrivals", "enriched", "bucket"), fresh, order) if earlier is not None else merged(fresh.withColumn("_new", F.lit(1)), ["_new", *order])
        table.replace(retained(result, retain, at), touched, number)
        if after:
            after(session, table.read())

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
