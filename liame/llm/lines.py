"""Lines that one site puts into many of its documents, found as blocks and taken out.

Lines of a site are nodes, consecutive lines edges, both weighted by documents.
Nodes and edges of high support stay; their connected components are the
site's boilerplate blocks, and every occurrence of a block's line goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liame.llm.components import connected_components
from liame.plans.lineage import cut, release
from liame.sources.tables import load

SPACE = r"[\t\r\f \x0b\p{Z}\x{85}\x{1c}-\x{1f}]+"  # all but the line feed
DIGITS = r"\p{Nd}+"


def alike_lines(text: str):
    """The lines of a text, split at a line feed, without letter case, white space differences and numbers."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(text), DIGITS, "0"), SPACE, " ")
    return F.transform(F.split(folded, "\n", -1), lambda x: F.trim(x))


def repeated_lines(docs: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, line_no, block) of every line whose like stands in ``least`` documents of its site.

    ``docs`` has (doc_id, text, domain, source); the site is domain, else
    source, else the empty site. Lines count from 1, split at a line feed;
    blank lines are never found. Rows without doc_id or text hold no lines,
    repeated rows of a doc_id count as one document. ``block`` names the
    connected component of lines that at least ``least`` documents hold one
    after the other; a line that stands with no other is a block by itself.
    """
    docs = docs.where("doc_id is not null and text is not null")
    site = F.coalesce("domain", "source", F.lit(""))
    key = lambda x, i: F.when(x != "", F.struct((i + 1).cast("long").alias("line_no"), F.unhex(F.md5(F.concat_ws("\n", site, x))).alias("key")))
    # Lines are keyed once; nodes, edges and occurrences are read from the written keys.
    keyed = cut(docs.select("doc_id", F.array_compact(F.transform(alike_lines("text"), key)).alias("lines")).where(F.size("lines") > 0))
    seen = keyed.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.line_no", "x.key")
    nodes = cut(seen.groupBy("key").agg(F.countDistinct("doc_id").alias("docs")).where(F.col("docs") >= least).select(F.col("key").alias("node")))
    next_ones = F.arrays_zip(
        F.col("lines.key").alias("a"), F.slice(F.col("lines.key"), F.lit(2), F.greatest(F.size("lines"), F.lit(1))).alias("b")
    )
    pairs = keyed.select("doc_id", F.explode(F.array_distinct(next_ones)).alias("x")).select("doc_id", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    edges = pairs.where("b is not null").groupBy("a", "b").agg(F.countDistinct("doc_id").alias("docs")).where(F.col("docs") >= least)
    blocks = connected_components(nodes, edges)
    release(nodes)
    found = seen.join(blocks.select(F.col("node").alias("key"), F.lower(F.hex("component")).alias("block")), "key")
    return found.select("doc_id", "line_no", "block").distinct()


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, n_removed): the texts without the found lines; null texts stay null."""
    gone = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", (i + 1).cast("long")))
    return docs.select("doc_id", "text").join(gone, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(load(spark, folder, "docs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_blocks(spark, folder).select("doc_id", "line_no")


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return without_lines(load(spark, folder, "docs"), p3_found(spark, folder))


QUERIES = {"p3_found": p3_found, "p3_blocks": p3_blocks, "p3_cleaned": p3_cleaned}

_LINES = rf"""
with d as (select doc_id, coalesce(domain, source, '') as site, string_split(text, chr(10)) as t from docs where text is not null),
x as (select doc_id, site, unnest(t) as line, unnest(range(1, len(t) + 1)) as line_no from d),
k as (select *, trim(regexp_replace(regexp_replace(lower(line), '{DIGITS}', '0', 'g'), '{SPACE}', ' ', 'g')) as alike from x),
f as (select doc_id, line_no from k where alike <> '' and (site, alike) in (select (site, alike) from k group by site, alike having count(distinct doc_id) >= 5))
"""
SQL = {
    # The smallest node that a line reaches names its block.
    "p3_blocks": _LINES.replace("with d as", "with recursive d as") + """,
n as (select doc_id, line_no, md5(site || chr(10) || alike) as node from k join f using (doc_id, line_no)),
o as (select doc_id, md5(site || chr(10) || alike) as x, lead(md5(site || chr(10) || alike)) over (partition by doc_id order by line_no) as y from k where alike <> ''),
e as (select x, y from o where y is not null and x <> y and x in (select node from n) and y in (select node from n) group by 1, 2 having count(distinct doc_id) >= 5),
w as (select x, y from e union select y, x from e),
r as (select distinct node, node as to_node from n union select r.node, w.y from r join w on r.to_node = w.x),
b as (select node, min(to_node) as block from r group by 1)
select doc_id, line_no, block from n join b using (node)""",
    "p3_found": _LINES + "select doc_id, line_no from f",
    "p3_cleaned": _LINES + """, r as (select doc_id, count(*) as n_removed from f group by 1),
c as (select doc_id, string_agg(line, chr(10) order by line_no) as text from k anti join f using (doc_id, line_no) group by 1)
select docs.doc_id, case when n_removed is null then docs.text else coalesce(c.text, '') end as text, coalesce(n_removed, 0)::bigint as n_removed
from docs left join r using (doc_id) left join c using (doc_id)""",
}
