"""Materialised aggregates: universe, scopes and ranked terms of every person, source and window at once.

A reader below the kept ranks gets the same rows as from the live statements;
``router`` decides between the two.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from liame.clock import ANCHOR
from liame.corpus import Corpus
from liame.functions.scoring import pmi, rank, signature_floor
from liame.functions.text import folded
from liame.operators.networks import communities, community_edges
from liame.operators.outlets import jaccard, neighbours
from liame.operators.scope import Scope, in_scope, outlet_domain, tracked
from liame.plans.lineage import cut

SOURCES = ("bluesky", "camara", "gdelt", "gkg", "gnews", "juridico", "nicho", "oficial", "rss", "senado")
DAYS = (7, 21)
LEAST = (1, 2, 3, 5)
TOP = 200


def _source(grouped: DataFrame) -> DataFrame:
    """Grouping-set rows with 'all' where the source was rolled up; a stored null source stays null."""
    return grouped.withColumn("source", F.when(F.col("g") == 1, "all").otherwise(F.col("source"))).drop("g")


def universe(c: Corpus, days: int, at: str = ANCHOR) -> DataFrame:
    """(source, term_id, c_t) over documents that name anyone, per source and for all."""
    docs = tracked(c, in_scope(c.docs, Scope(days, at=at)).select("doc_id", "source"))
    rows = c.doc_terms.join(docs, "doc_id").groupingSets([["source", "term_id"], ["term_id"]], "source", "term_id")
    return _source(rows.agg(F.grouping("source").alias("g"), F.count(F.lit(1)).alias("c_t")))


def scopes(c: Corpus, days: int, at: str = ANCHOR) -> DataFrame:
    """(days, source, person_id, docs, tracked, about) for every listed source and person, zeros included."""
    docs = in_scope(c.docs, Scope(days, at=at)).select("doc_id", "source")
    named = c.doc_persons.select("doc_id").distinct().withColumn("named", F.lit(1))
    u = _source(docs.join(named, "doc_id", "left").groupingSets([["source"], []], "source").agg(F.grouping("source").alias("g"), F.count(F.lit(1)).alias("docs"), F.count("named").alias("tracked")))
    ab = _source(docs.join(c.doc_persons, "doc_id").groupingSets([["source", "person_id"], ["person_id"]], "source", "person_id").agg(F.grouping("source").alias("g"), F.count(F.lit(1)).alias("about")))
    spark = c.docs.sparkSession
    listed = spark.createDataFrame([(s,) for s in ("all", *SOURCES)], "source string")
    grid = listed.crossJoin(c.persons.select(F.col("id").alias("person_id")))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return grid.join(u, "source", "left").join(ab, ["source", "person_id"], "left").select(F.lit(days).cast("long").alias("days"), "source", "person_id", zero("docs"), zero("tracked"), zero("about"))


def person_tokens(c: Corpus) -> DataFrame:
    """(person_id, names): the words of each person's spellings, inside the JVM."""
    aliases = c.persons.select(F.col("id").alias("person_id"), F.explode("aliases").alias("alias"))
    per = aliases.select("person_id", F.explode(F.split(folded(F.col("alias")), "[^a-z0-9]+")).alias("w")).where(F.length("w") >= 3)
    return per.groupBy("person_id").agg(F.sort_array(F.collect_set("w")).alias("names"))


def person_terms(c: Corpus, days: int, at: str = ANCHOR, top: int = TOP) -> DataFrame:
    """(days, source, person_id, term, kind, c_pt, c_t, tone, reach) of the terms that any reader may ask for.

    Kept are, per source and kind, the ``top`` by count and by surprise for
    every least count, and the five of the signature. One pass over all
    persons; the windows share their leading keys.
    """
    docs = in_scope(c.docs, Scope(days, at=at)).select("doc_id", "source", "tone", "reach_reposts")
    rows = c.doc_terms.join(docs.join(c.doc_persons, "doc_id"), "doc_id")
    counts = _source(
        rows.groupingSets([["source", "person_id", "term_id"], ["person_id", "term_id"]], "source", "person_id", "term_id")
        .agg(F.grouping("source").alias("g"), F.count(F.lit(1)).alias("c_pt"), F.avg("tone").alias("tone"), F.sum("reach_reposts").alias("reach"))
    )
    own = F.coalesce(F.arrays_overlap(F.split("term", " "), F.col("names")), F.lit(False))
    sc = scopes(c, days, at).select("source", "person_id", "tracked", "about")
    scored = (
        counts.join(c.terms, "term_id").join(person_tokens(c), "person_id", "left").where(~own)
        .join(universe(c, days, at), ["source", "term_id"]).join(sc, ["source", "person_id"])
        .withColumn("pmi", pmi(F.col("c_pt"), F.col("tracked"), F.col("about"), F.col("c_t")))
        .withColumn("key", rank(F.col("pmi"), F.col("c_pt")))
        .withColumn("sure", F.col("c_pt") >= signature_floor(F.col("about")))
    )
    # Each rank is a branch of its own, so that Spark limits every group before it moves: the hottest person brings a few rows a task.
    scored = cut(scored.select("source", "person_id", "term_id", "term", "kind", "c_pt", "c_t", "tone", "reach", "pmi", "key", "sure"))

    def best(rows: DataFrame, by: list[str], limit: int, *order: Column) -> DataFrame:
        ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("source", "person_id", *by).orderBy(*order)))
        return ranked.where(F.col("rn") <= limit).select("source", "person_id", "term_id")

    kept = [best(scored, ["kind"], top, F.desc("c_pt"), F.col("term"))]
    kept += [best(scored.where(F.col("c_pt") >= m), ["kind"], top, F.desc("key"), F.col("term")) for m in LEAST]
    kept.append(best(scored.where("sure"), [], 5, F.desc("pmi"), F.col("term"), F.col("kind")))
    keys = reduce(DataFrame.unionByName, kept).distinct()
    return scored.join(keys, ["source", "person_id", "term_id"], "left_semi").select(F.lit(days).cast("long").alias("days"), "source", "person_id", "term", "kind", "c_pt", "c_t", "tone", "reach")


def outlet_terms(c: Corpus, days: int, at: str = ANCHOR, top: int = 40, floor: int = 3) -> DataFrame:
    """(days, person_id, domain, kind, term, c_pt): the best terms of every outlet about each person, all persons at once."""
    docs = in_scope(c.docs, Scope(days, at=at)).select("doc_id", outlet_domain().alias("domain")).where("domain is not null and domain <> ''")
    rows = c.doc_terms.join(docs.join(c.doc_persons, "doc_id"), "doc_id")
    counts = rows.groupBy("person_id", "domain", "term_id").agg(F.count(F.lit(1)).alias("c_pt")).where(F.col("c_pt") >= floor)
    own = F.coalesce(F.arrays_overlap(F.split("term", " "), F.col("names")), F.lit(False))
    scored = (
        counts.join(c.terms, "term_id").join(person_tokens(c), "person_id", "left").where(~own)
        .join(universe(c, days, at).where("source = 'all'").select("term_id", "c_t"), "term_id")
        .join(scopes(c, days, at).where("source = 'all'").select("person_id", "tracked", "about"), "person_id")
        .withColumn("key", rank(pmi(F.col("c_pt"), F.col("tracked"), F.col("about"), F.col("c_t")), F.col("c_pt")))
    )
    ranked = scored.withColumn("rn", F.row_number().over(Window.partitionBy("person_id", "domain").orderBy(F.desc("key"), "term", "kind")))
    return ranked.where(F.col("rn") <= top).select(F.lit(days).cast("long").alias("days"), "person_id", "domain", "kind", "term", "c_pt")


def write_window(rows: DataFrame, path: str, by: tuple[str, ...] = ("days",)) -> None:
    """Overwrites only the partitions (windows, weeks) that ``rows`` holds; the schema lies beside them, for a table without rows has no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_schema.json")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(rows.schema.json().encode())
    out.close()


def read_window(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_window`` wrote, with or without rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_schema.json")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return spark.read.schema(StructType.fromJson(json.loads(text))).parquet(path)


def write_aggregates(c: Corpus, path: str, at: str = ANCHOR) -> None:
    """Scopes and person terms of both windows, by window and source, so that a request reads one partition."""
    for days in DAYS:
        write_window(scopes(c, days, at), f"{path}/graph_scopes", ("days", "source"))
        write_window(person_terms(c, days, at), f"{path}/graph_terms", ("days", "source"))


def kept_graphs(c: Corpus, at: str = ANCHOR, days: tuple[int, ...] = DAYS, sources: tuple[str, ...] | None = None, person_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the kept terms of every window, source and person, or of those asked for."""
    keys = ("days", "source", "person_id")
    kept, docs = None, None
    asked = F.lit(True) if sources is None else F.col("source").isin(list(sources))
    asked = asked if person_id is None else asked & (F.col("person_id") == person_id)
    for days in days:
        terms = person_terms(c, days, at).where(asked).join(c.terms, ["kind", "term"]).select(*keys, "term_id", F.concat_ws(":", "kind", "term").alias("node"))
        named = in_scope(c.docs, Scope(days, at=at)).select("doc_id", "source").join(c.doc_persons, "doc_id")
        named = named.select("doc_id", F.lit(days).cast("long").alias("days"), F.explode(F.array("source", F.lit("all"))).alias("source"), "person_id").where(asked)
        kept, docs = (kept.unionByName(terms), docs.unionByName(named)) if kept is not None else (terms, named)
    kept = cut(kept)
    return kept.select(*keys, "node"), community_edges(c.doc_terms, docs, kept, keys)


def outlet_networks(c: Corpus, at: str = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(neighbors, fields) of the outlets about every person in both windows."""
    keys = ("days", "person_id")
    sets = cut(reduce(DataFrame.unionByName, (outlet_terms(c, days, at) for days in DAYS)))
    edges = cut(jaccard(sets, keys))
    nodes = sets.select(*keys, F.col("domain").alias("node")).distinct()
    fields = communities(nodes, edges.select(*keys, F.col("a").alias("s"), F.col("b").alias("t"), F.col("similarity").alias("count")), [*keys])
    return neighbours(edges, keys=keys), fields


def write_networks(c: Corpus, path: str, at: str = ANCHOR) -> None:
    """Communities of terms, fields and neighbours of outlets, of both windows."""
    near, fields = outlet_networks(c, at)
    write_window(near, f"{path}/outlet_neighbors")
    write_window(fields, f"{path}/outlet_fields")
    write_window(communities(*kept_graphs(c, at), ["days", "source", "person_id"]), f"{path}/term_communities")


def write_weeks(weeks: DataFrame, path: str) -> None:
    """Weekly history: the weeks of ``weeks`` are written anew, older ones stay as they are."""
    write_window(weeks, path, ("week",))
