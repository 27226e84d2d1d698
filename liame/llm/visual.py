"""Texts that look the same but consist of different characters, brought to one form.

Look-alike characters are mapped by rule to one of their kind; what then is
equal under Spark's accent- and case-sensitive UNICODE collation (which holds
composed and decomposed accents for equal and skips invisible characters) is
one class. Each class has one canonical member, joined back to its documents.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from liame.plans.lineage import cut
from liame.sources.tables import load

# Cyrillic, Greek and Armenian letters drawn as Latin ones.
LOOKS_LIKE = (
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl ёë їï "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԚQ ԜW ӀI ЁË ЇÏ "
    "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX օo ɡg "
    "ⅰi ⅴv ⅹx ⅼl ⅽc ⅾd ⅿm ⅠI ⅤV ⅩX ⅬL ⅭC ⅮD ⅯM"
).split()
# Ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}
# Spaces and hyphens that differ in line breaking or width only; characters without a shape.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
JOINED = "\ue000"  # stands for a joiner that makes one picture of two emoji, which a collation would skip


def _one_to_one() -> tuple[str, str]:
    pairs = [(x[0], x[1]) for x in LOOKS_LIKE] + [(s, " ") for s in SPACES] + [(h, "-") for h in HYPHENS]
    pairs += [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs) 


HANGUL = ((0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xFFA0, 0xFFDC))  # composed by rule, from letters


def _unaccented() -> tuple[str, str]:
    """Every composed character of the BMP that begins with a letter, and that letter; Hangul aside."""
    pairs = [
        (chr(c), n[0]) for c in range(0xC0, 0xFFFF)
        if not 0xD800 <= c < 0xE000 and not any(a <= c <= b for a, b in HANGUL) and (n := unicodedata.normalize("NFD", chr(c))) != chr(c) and n[0].isalpha()
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def one_form(text: Column) -> Column:
    """``text`` with look-alikes, ligatures, spaces and line ends in one form and without invisible characters."""
    out = F.regexp_replace(text, "([\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}\\x{FE0F}])\u200d(?=[\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}])", "$1" + JOINED)
    out = F.translate(out, _one_to_one()[0] + INVISIBLE + "\u200d", _one_to_one()[1])
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "[ \\t\\r]+(?=\\n|$)", "")


def rough_key(form: Column) -> Column:
    """Equal for texts whose forms are equal under the collation, and for few others: the letters and digits without marks.

    Left out are characters that a collation may skip or compose by rule: modifier letters, Hangul, all beyond the BMP.
    """
    hangul = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in HANGUL)
    return F.xxhash64(F.regexp_replace(F.translate(form, *_unaccented()), f"[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}\\p{{Lo}}\\p{{Nd}}]+|[{hangul}\\x{{10000}}-\\x{{10ffff}}]+", ""))


def same_looking(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of the texts that look like a text of other characters.

    ``docs`` has (doc_id, text); null texts look like nothing. members: (doc_id,
    raw, class), raw a digest of the characters. classes: (class, n_texts,
    canonical) of two different texts or more, class the smallest raw of it and
    canonical the text with it. Only texts whose rough key another text shares
    reach the collation, and each different text reaches it once, so copies of
    one text, however many, cost one row.
    """
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    keyed = cut(texts.select("doc_id", F.md5("text").alias("raw"), rough_key(one_form(F.col("text"))).alias("rough")))
    shared = keyed.groupBy("rough").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("rough")
    chosen = keyed.join(shared, "rough", "left_semi").groupBy("raw").agg(F.min("doc_id").alias("doc_id"))
    chosen = chosen.join(texts, "doc_id").select("raw", "text", one_form(F.col("text")).alias("form")).dropDuplicates(["raw"])
    classes = cut(
        chosen.groupBy(F.expr("collate(form, 'UNICODE')").alias("shape"))
        .agg(F.collect_set("raw").alias("raws"), F.min(F.struct("raw", "text")).alias("least"))
        .where(F.size("raws") > 1).select(F.col("least.raw").alias("class"), F.col("least.text").alias("canonical"), "raws")
    )
    members = keyed.join(classes.select("class", F.explode("raws").alias("raw")), "raw").select("doc_id", "raw", "class").distinct()
    return members, classes.select("class", F.size("raws").cast("long").alias("n_texts"), "canonical")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    members, _ = same_looking(load(spark, folder, "docs"))
    a = members.select(F.col("doc_id").alias("doc_id_a"), F.col("raw").alias("raw_a"), "class")
    b = members.select(F.col("doc_id").alias("doc_id_b"), F.col("raw").alias("raw_b"), "class")
    return a.join(b, "class").where("doc_id_a < doc_id_b and raw_a <> raw_b").select("doc_id_a", "doc_id_b").distinct()


def p4_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its class (null if no other text looks like it) and its text in the one form."""
    docs = load(spark, folder, "docs")
    members, classes = same_looking(docs)
    members = members.join(classes, "class").select("doc_id", "class", "canonical").dropDuplicates(["doc_id"])
    return docs.join(members, "doc_id", "left").select("doc_id", "class", F.coalesce(one_form(F.col("canonical")), one_form(F.col("text"))).alias("form"))


QUERIES = {"p4_found": p4_found, "p4_canonical": p4_canonical}


def _sql_form(shape: bool = True) -> str:
    """``one_form`` in SQL; ``shape``: composed and without variation selectors, as the collation compares."""
    quote = lambda s: s.replace("'", "''")
    a, b = _one_to_one()
    out = "regexp_replace(text, '([\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}\\x{FE0F}])\u200d([\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}])', '\\1" + JOINED + "\\2', 'g')"
    out = f"translate({out}, '{quote(a)}', '{quote(b)}')"
    selector = "\ufe0f" if shape else ""
    out = f"regexp_replace({out}, '[{INVISIBLE}\u200d{selector}]', '', 'g')"
    for x, y in LIGATURES.items():
        out = f"replace({out}, '{x}', '{y}')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t\\r]+\\n', chr(10), 'g'), '[ \\t\\r]+$', '')"
    return f"nfc_normalize({out})" if shape else out


SQL = {
    "p4_found": f"""
with f as (select doc_id, text, {_sql_form()} as form from docs)
select a.doc_id as doc_id_a, b.doc_id as doc_id_b from f a join f b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text""",
    "p4_canonical": f"""
with f as (select doc_id, text, {_sql_form()} as shape, {_sql_form(False)} as form from docs),
k as (select shape, min(md5(text)) as class, arg_min(form, md5(text)) as canonical from f where text is not null group by 1 having count(distinct text) > 1)
select doc_id, class, coalesce(canonical, form) as form from f left join k using (shape)""",
}
