"""Items that appear together: counts of item pairs per basket, with association scores.

Large-basket blocking. A basket of more than ``chunk`` items is split into
chunks by a hash of the item; every pair of chunks of the basket becomes one
row of work, so the pairs of a huge basket are made by many tasks. Ordinary
baskets are one chunk. Both kinds of pairs go into one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liame.plans.lineage import cut
from liame.sources.tables import load


def _products(blocks: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of one sorted array with itself or of two disjoint arrays."""
    if right is None:
        first = blocks.select(F.posexplode(left).alias("i", "x"), F.col(left).alias("rest"))
        rest = F.slice("rest", F.col("i") + 2, F.greatest(F.size("rest") - F.col("i") - 1, F.lit(0)))
        return first.select(F.col("x").alias("a"), F.explode(rest).alias("b"))
    first = blocks.select(F.explode(left).alias("x"), F.col(right).alias("rest"))
    both = first.select("x", F.explode("rest").alias("y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pair_counts(coded: DataFrame, chunk: int = 128) -> DataFrame:
    """Counts of baskets per pair of items.

    ``coded`` has distinct rows (basket, code), code a long. Returns (a, b,
    n_ab) with a < b. The hash spreads a basket over ceil(size / chunk) chunks,
    so no row holds more than a few times ``chunk`` items.
    """
    big = (
        coded.groupBy("basket").count().where(F.col("count") > chunk)
        .select("basket", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    )
    ordinary = (
        coded.join(big, "basket", "left_anti")
        .groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("items"))
        .where(F.size("items") > 1)
    )
    blocks = (
        coded.join(big, "basket")
        .withColumn("block", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))
        .groupBy("basket", "chunks", "block").agg(F.sort_array(F.collect_list("code")).alias("items"))
    )
    met = (
        blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .groupBy("basket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        .agg(
            F.max(F.when(F.col("block") == F.least("block", "other"), F.col("items"))).alias("left"),
            F.max(F.when(F.col("block") == F.greatest("block", "other"), F.col("items"))).alias("right"),
        )
    )
    pairs = (
        _products(ordinary, "items")
        .unionByName(_products(met.where("lo = hi"), "left"))
        .unionByName(_products(met.where("lo < hi and left is not null and right is not null"), "left", "right"))
    )
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))


def together(rows: DataFrame, n: int, min_count: int = 6, min_lift: float = 6.0, chunk: int = 128) -> DataFrame:
    """Pairs of items in at least ``min_count`` baskets, ``min_lift`` times more often than chance.

    ``rows`` has columns (basket, item), item a string; repeated rows count
    once and rows with a null are no member of a basket. ``n`` is the number of
    baskets, those without items included. Returns (item_a, item_b, n_a, n_b,
    n_ab, lift, pmi, npmi), the smaller item by bytes first; nothing for
    ``n`` = 0.

    Two prunings lose nothing. An item in fewer than ``min_count`` baskets has
    no such pair. And n_ab <= min(n_a, n_b), so n_ab * n >= min_lift * n_a *
    n_b needs max(n_a, n_b) <= n / min_lift: items more common than that have
    no such pair either, which removes the hottest items before any pair is made.
    """
    rows = rows.select("basket", "item").where("basket is not null and item is not null")
    counts = rows.distinct().groupBy("item").agg(F.count(F.lit(1)).alias("n_x"))
    kept = counts.where((F.col("n_x") >= min_count) & (F.col("n_x") * F.lit(float(min_lift)) <= F.lit(float(n))))
    kept = cut(kept.withColumn("code", F.monotonically_increasing_id()))
    coded = rows.join(kept.select("item", "code"), "item").select("basket", "code").distinct()
    pairs = pair_counts(coded, chunk).where(F.col("n_ab") >= min_count)
    a = kept.select(F.col("code").alias("a"), F.col("item").alias("x"), F.col("n_x").alias("n_1"))
    b = kept.select(F.col("code").alias("b"), F.col("item").alias("y"), F.col("n_x").alias("n_2"))
    scored = pairs.join(a, "a").join(b, "b").where(
        F.col("n_ab") * F.lit(float(n)) >= F.lit(float(min_lift)) * F.col("n_1") * F.col("n_2")
    )
    first = F.col("x") < F.col("y")
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_1") * F.col("n_2"))
    return scored.select(
        F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"),
        F.when(first, F.col("n_1")).otherwise(F.col("n_2")).alias("n_a"),
        F.when(first, F.col("n_2")).otherwise(F.col("n_1")).alias("n_b"),
        "n_ab", lift.alias("lift"), F.log2(lift).alias("pmi"),
        (F.log2(lift) / F.greatest(-F.log2(F.col("n_ab") / F.lit(float(max(n, 1)))), F.lit(1e-12))).alias("npmi"),
    )


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Terms and persons as items of their documents."""
    terms = load(spark, folder, "doc_terms").select(F.col("doc_id").alias("basket"), F.concat(F.lit("term:"), F.col("term_id").cast("string")).alias("item"))
    persons = load(spark, folder, "doc_persons").select(F.col("doc_id").alias("basket"), F.concat(F.lit("person:"), "person_id").alias("item"))
    return terms.unionByName(persons)


def p1_scored(spark: SparkSession, folder: str) -> DataFrame:
    pairs = together(members(spark, folder), load(spark, folder, "docs").count())
    return pairs.withColumns({c: F.round(c, 6) for c in ("lift", "pmi", "npmi")})


def p1_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Hashtags that the same sites use: a few baskets of many items, so most pairs are made from pairs of chunks."""
    docs = load(spark, folder, "docs").select("doc_id", F.coalesce("domain", "source").alias("basket"))
    tags = load(spark, folder, "terms").where("kind = 'hashtag'").select("term_id", F.col("term").alias("item"))
    rows = load(spark, folder, "doc_terms").join(tags, "term_id").join(docs, "doc_id").select("basket", "item")
    sites = docs.where("basket is not null").select("basket").distinct().count()
    return together(rows, sites, 3, 1.5, 16).select("item_a", "item_b", "n_a", "n_b", "n_ab")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_scored(spark, folder).select("item_a", "item_b")


def p1_kept_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Found person-term pairs beside the largest c_pt that graph_terms keeps for them (null: none kept)."""
    terms = load(spark, folder, "terms").select(F.concat(F.lit("term:"), F.col("term_id").cast("string")).alias("item_b"), "kind", "term")
    kept = (
        load(spark, folder, "graph_terms").where("source = 'all'")
        .groupBy(F.concat(F.lit("person:"), "person_id").alias("item_a"), "kind", "term")
        .agg(F.max("c_pt").cast("long").alias("kept_c_pt"))
    )
    found = p1_scored(spark, folder).where("item_a like 'person:%' and item_b like 'term:%'").select("item_a", "item_b", "n_ab")
    return found.join(terms, "item_b").join(kept, ["item_a", "kind", "term"], "left").select("item_a", "item_b", "kind", "term", "n_ab", "kept_c_pt")


QUERIES = {"p1_found": p1_found, "p1_scored": p1_scored, "p1_sites": p1_sites, "p1_kept_counts": p1_kept_counts}

_PAIRS = """
with m as (select doc_id, 'term:' || term_id as item from doc_terms where doc_id is not null and term_id is not null
  union select doc_id, 'person:' || person_id from doc_persons where doc_id is not null and person_id is not null),
n as (select count(*) as n from docs), c as (select item, count(*) as n_x from m group by item),
p as (select a.item as item_a, b.item as item_b, count(*) as n_ab from m a join m b on a.doc_id = b.doc_id and a.item < b.item group by 1, 2 having count(*) >= 6),
f as (select item_a, item_b, ca.n_x as n_a, cb.n_x as n_b, n_ab, n from p join c ca on ca.item = item_a join c cb on cb.item = item_b, n
  where n_ab * n >= 6 * ca.n_x * cb.n_x)
"""
SQL = {
    "p1_found": _PAIRS + "select item_a, item_b from f",
    "p1_scored": _PAIRS + """, s as (select *, n_ab * n::double / (n_a * n_b) as lift from f)
select item_a, item_b, n_a, n_b, n_ab, round(lift, 6) as lift, round(log2(lift), 6) as pmi, round(log2(lift) / greatest(-log2(n_ab / n::double), 1e-12), 6) as npmi from s""",
    "p1_sites": """
with m as (select distinct coalesce(domain, source) as s, term as item from docs join doc_terms using (doc_id) join terms using (term_id) where kind = 'hashtag' and coalesce(domain, source) is not null),
n as (select count(distinct coalesce(domain, source)) as n from docs), c as (select item, count(*) as n_x from m group by 1),
p as (select a.item as item_a, b.item as item_b, count(*) as n_ab from m a join m b on a.s = b.s and a.item < b.item group by 1, 2 having count(*) >= 3)
select item_a, item_b, ca.n_x as n_a, cb.n_x as n_b, n_ab from p join c ca on ca.item = item_a join c cb on cb.item = item_b, n where n_ab * n >= 1.5 * ca.n_x * cb.n_x""",
    "p1_kept_counts": _PAIRS + """, g as (select 'person:' || person_id as item_a, kind, term, max(c_pt)::bigint as kept_c_pt from graph_terms where source = 'all' group by 1, 2, 3)
select item_a, item_b, kind, term, n_ab, kept_c_pt from f join terms t on item_b = 'term:' || t.term_id left join g using (item_a, kind, term) where item_a like 'person:%'""",
}
