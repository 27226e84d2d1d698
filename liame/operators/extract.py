"""From texts to relations: terms, phrase lexicon, tagged persons, untracked names, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liame.functions import text as tx
from liame.functions import windows as wn
from liame.plans.lineage import cut
from liame.plans.parallel import spread

Scorer = Callable[[str, str], float | None]
SCORERS: dict[str, Callable[[], Scorer]] = {}


def scorer(label: str, loads: bool = False) -> Callable:
    """Registers a per-person text scorer under a method label.

    With ``loads`` the function is a maker: called once in every task, it loads
    what it needs (a model) and returns the scorer; without, it is the scorer.
    """

    def add(f: Callable) -> Callable:
        SCORERS[label] = f if loads else lambda: f
        return f

    return add


@scorer("stub")
def stub(text: str, person_id: str) -> float | None:
    """A repeatable figure between -10 and 10 for tests; blank texts have none."""
    if not text.strip():
        return None
    return round((tx.fnv1a(f"{person_id}:{text}") % 2001) / 100 - 10, 2)


def hashtag_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array_distinct(tx.hashtags(F.col("text")))).alias("term"))


def word_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    rows = tx.decoded(docs.select("doc_id", F.col(text).alias("text")))
    return rows.select("doc_id", F.explode(F.array_distinct(tx.content_words(F.col("text")))).alias("term"))


def pair_stage(docs: DataFrame) -> DataFrame:
    """(doc_id, w1, w2): one row per word occurrence; w2 null where no phrase may begin."""
    return spread(docs.where("text is not null").select("doc_id", "text")).select("doc_id", F.inline(tx.word_pairs_of("text")))


def phrase_lexicon(stage: DataFrame, least: int = 5, share: float = 0.35, names: list[str] | None = None) -> DataFrame:
    """(term, count, score) of pairs that stick: of all times the rarer word stands, how often it stands in the pair.

    Pairs that touch a name word are left out; the words still count on their own.
    """
    uni = stage.groupBy(F.col("w1").alias("w")).agg(F.count(F.lit(1)).alias("c"))
    pairs = stage.where("w2 is not null")
    if names:
        pairs = pairs.where(~F.col("w1").isin(names) & ~F.col("w2").isin(names))
    pairs = pairs.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = pairs.join(uni.select(F.col("w").alias("w1"), F.col("c").alias("c1")), "w1").join(uni.select(F.col("w").alias("w2"), F.col("c").alias("c2")), "w2")
    sticky = F.col("n") / F.least("c1", "c2")
    return rows.where(sticky >= share).select(F.concat_ws(" ", "w1", "w2").alias("term"), F.col("n").alias("count"), F.round(sticky.cast("decimal(38,15)"), 4).cast("double").alias("score"))


def collocations(stage: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, term) of the lexicon's pairs in each text."""
    pairs = stage.where("w2 is not null").select("doc_id", F.concat_ws(" ", "w1", "w2").alias("term")).distinct()
    return pairs.join(lexicon.select("term"), "term", "left_semi")


LARGEST_LEXICON = 2_000_000  # phrases up to which all go to every task; beyond, each document brings its own
LARGEST_SPELLINGS = 200_000  # likewise of the tracked persons' spellings


def term_rows(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, kind, term): every document's distinct terms, phrases standing in for the words inside them.

    A lexicon beyond LARGEST_LEXICON is joined to the documents' word pairs
    instead of sent to every task; the rows are the same.
    """
    extra = F.col("extra_terms") if "extra_terms" in docs.columns else F.array().cast("array<struct<term:string,kind:string>>")
    texts = docs.where("text is not null").select("doc_id", "text", extra.alias("extra"))
    rows = [r["term"] for r in lexicon.select("term").limit(LARGEST_LEXICON + 1).collect()]
    if len(rows) <= LARGEST_LEXICON:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(rows))
        texts = spread(texts.withColumn("own", F.lit(None).cast("array<string>")))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset())
        own = collocations(pair_stage(docs), lexicon).groupBy("doc_id").agg(F.collect_set("term").alias("own"))
        texts = texts.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                (d, k, t)
                for d, s, e, own in zip(b["doc_id"], b["text"], b["extra"], b["own"])
                for k, t in tx.text_terms(s, [(x["kind"], x["term"]) for x in (e if e is not None else ())], shared.value if own is None else frozenset(own))
            ]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "term"])

    return texts.mapInPandas(extract, "doc_id long, kind string, term string")


def spellings(persons: DataFrame) -> DataFrame:
    """(alias, id, excluded) of ``persons`` (id, aliases[, excluded]); excluded spellings belong to nobody."""
    own = persons.select(F.explode("aliases").alias("alias"), "id", F.lit(False).alias("excluded"))
    if "excluded" in persons.columns:
        own = own.unionByName(persons.select(F.explode("excluded").alias("alias"), "id", F.lit(True).alias("excluded")))
    return own.where("alias is not null and id is not null").distinct()


def finder_of(rows) -> tx.Aliases:
    """A finder of (alias, id, excluded) rows; of two persons with one spelling the smaller id owns it."""
    ordered = sorted((r["id"], r["excluded"], r["alias"]) for r in rows)
    return tx.Aliases([(i, () if x else (a,), (a,) if x else ()) for i, x, a in ordered])


def with_spellings(docs: DataFrame, persons: DataFrame) -> tuple[DataFrame, object]:
    """(docs with ``spellings``, the broadcast rows): null, and all spellings sent to every task, up to LARGEST_SPELLINGS.

    Beyond, ``spellings`` has those whose words stand in the document one after
    the other: all that can be found in it, from a join on runs of its words.
    """
    spark = docs.sparkSession
    all_ = spellings(persons)
    rows = all_.limit(LARGEST_SPELLINGS + 1).collect()
    kind = "array<struct<alias:string,id:string,excluded:boolean>>"
    if len(rows) <= LARGEST_SPELLINGS:
        return docs.withColumn("spellings", F.lit(None).cast(kind)), spark.sparkContext.broadcast([r.asDict() for r in rows])
    words = lambda c: F.filter(F.split(tx.folded(c), "[^a-z0-9]+"), lambda w: w != "")
    known = all_.withColumn("words", words(F.col("alias"))).where(F.size("words") > 0).withColumn("gram", F.concat_ws(" ", "words"))
    longest = known.agg(F.max(F.size("words"))).first()[0] or 1
    texts = tx.decoded(docs.select("doc_id", "text").distinct()).select("doc_id", words(F.col("text")).alias("words"))
    grams = texts.select("doc_id", "words", F.posexplode("words").alias("i", "w")).select("doc_id", "words", "i", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n"))
    grams = grams.select("doc_id", F.concat_ws(" ", F.slice("words", F.col("i") + 1, F.col("n"))).alias("gram")).distinct()
    own = grams.join(known.select("gram", F.struct("alias", "id", "excluded").alias("x")), "gram").groupBy("doc_id").agg(F.collect_set("x").alias("spellings"))
    return docs.join(own, "doc_id", "left").withColumn("spellings", F.coalesce("spellings", F.array().cast(kind))), spark.sparkContext.broadcast([])


def dictionary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, doc_terms) with a 64-bit hash of (kind, term) as id, so that writers need no lookup."""
    keyed = rows.select("doc_id", F.xxhash64("kind", "term").alias("term_id"), "kind", "term")
    return keyed.select("term_id", "kind", "term").distinct(), keyed.select("doc_id", "term_id").distinct()


def mention_rows(docs: DataFrame, persons: DataFrame) -> DataFrame:
    """(doc_id, person_id): persons whose spellings stand in the text, the longest spelling first.

    ``persons`` (id, aliases[, excluded]) are the tracked persons, however many.
    """
    texts, shared = with_spellings(docs.where("text is not null").select("doc_id", "text"), persons)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = finder_of(shared.value)
        for b in batches:
            found = [(d, p) for d, s, own in zip(b["doc_id"], b["text"], b["spellings"]) for p in sorted((whole if own is None else finder_of(own)).spans(s))]
            yield pd.DataFrame(found, columns=["doc_id", "person_id"])

    return spread(texts).mapInPandas(tag, "doc_id long, person_id string")


def name_rows(docs: DataFrame, persons: DataFrame) -> DataFrame:
    """(doc_id, name) of names that are no tracked person's spelling and not excluded: the listed ones for gkg, runs of capitalised words else."""
    tidy = lambda c: F.trim(F.regexp_replace(tx.folded(c), r"\s+", " "))
    given = F.when(F.col("source") == "gkg", F.transform(F.coalesce("extra_names", F.array().cast("array<string>")), tidy)).otherwise(tx.runs_of("text"))
    rows = docs.where("text is not null").select("doc_id", F.explode(F.array_distinct(given)).alias("name")).where("name <> ''")
    return rows.join(spellings(persons).select(tidy(F.col("alias")).alias("name")), "name", "left_anti").select("doc_id", "name")


def unscored(pairs: DataFrame, scores: DataFrame, method: str) -> DataFrame:
    """(doc_id, person_id) pairs without a row of the method; a null score is a row."""
    return pairs.join(scores.where(F.col("method") == method).select("doc_id", "person_id"), ["doc_id", "person_id"], "left_anti")


def scored(pairs: DataFrame, docs: DataFrame, method: str = "stub") -> DataFrame:
    """(doc_id, person_id, method, score) of a registered scorer; the function is set up once per task."""
    make = SCORERS[method]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for b in batches:
            score = [f(s, p) if s is not None else None for s, p in zip(b["text"], b["person_id"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "person_id": b["person_id"], "method": method, "score": pd.Series(score, dtype="float64")})

    rows = pairs.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "person_id", "text")
    return rows.mapInPandas(run, "doc_id long, person_id string, method string, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def scored_texts(pairs: DataFrame, docs: DataFrame, persons: DataFrame, budget: int = 512) -> DataFrame:
    """(doc_id, person_id, text): for every pair the window around the person's first mention, within ``budget`` tokens."""
    texts, shared = with_spellings(docs.where("text is not null").select("doc_id", "text"), persons)

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = finder_of(shared.value)
        for b in batches:
            texts = []
            for raw, person, own in zip(b["text"], b["person_id"], b["spellings"]):
                text = tx.decode_entities(raw)
                mention = wn.first_mention(text, whole if own is None else finder_of(own), person) or (0, 0)
                texts.append(wn.window(text, mention, lambda s: wn.approx_tokens(s) <= budget))
            yield pd.DataFrame({"doc_id": b["doc_id"], "person_id": b["person_id"], "text": texts})

    joined = pairs.where("person_id is not null").join(texts, "doc_id").select("doc_id", "person_id", "text", "spellings")
    return joined.mapInPandas(narrow, "doc_id long, person_id string, text string")


def append_scores(pairs: DataFrame, docs: DataFrame, path: str, method: str = "stub") -> int:
    """Scores the pairs that ``path`` has no row of the method for, and appends them; how many. A repeated run adds nothing."""
    spark = pairs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        pairs = unscored(pairs, spark.read.parquet(path), method)
    rows = cut(scored(pairs.distinct(), docs, method))
    rows.write.mode("append").partitionBy("method").parquet(path)
    return rows.count()


def reindex(docs: DataFrame, persons: DataFrame, path: str) -> None:
    """Derives all relations of the documents anew: the phrase lexicon first, then terms under hashed ids, persons and names."""
    lexicon = phrase_lexicon(pair_stage(docs))
    lexicon.write.mode("overwrite").parquet(f"{path}/phrases")
    lexicon = docs.sparkSession.read.parquet(f"{path}/phrases")
    terms, doc_terms = dictionary(cut(term_rows(docs, lexicon)))
    for name, rows in {"terms": terms, "doc_terms": doc_terms, "doc_persons": mention_rows(docs, persons), "candidates": name_rows(docs, persons)}.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def windows_of(pairs: DataFrame, docs: DataFrame, persons: DataFrame, budget: int = 512) -> DataFrame:
    """Documents with one entry (person_id, text) for each person they name: what a scorer would read, for the JSON-lines sink."""
    texts = scored_texts(pairs, docs, persons, budget).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("person_id", "text"))).alias("persons"))
    return docs.select("doc_id", "source", "uri", "published_at").join(texts, "doc_id")


def exported(docs: DataFrame, doc_persons: DataFrame) -> DataFrame:
    """Documents with the sorted list of persons they name, as the JSON-lines sink writes them."""
    named = doc_persons.where("person_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("person_id")).alias("persons"))
    return docs.select("doc_id", "source", "uri", "text", "published_at").join(named, "doc_id", "left").withColumn("persons", F.coalesce("persons", F.array().cast("array<string>")))
