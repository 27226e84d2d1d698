"""Association figures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pmi(c_pt: Column, n: Column, n_p: Column, c_t: Column) -> Column:
    """log2 of how much more often than chance a term stands in a person's documents, unrounded."""
    d = lambda x: x.cast("double")
    return F.log((d(c_pt) * d(n)) / (d(n_p) * d(c_t))) / F.log(F.lit(2.0))


def rank(pmi_raw: Column, count: Column) -> Column:
    """Default order of a term map: surprise weighted by evidence."""
    return pmi_raw * F.log(F.lit(1.0) + count)


def signature_floor(about: Column) -> Column:
    """Least documents of a signature term."""
    return F.greatest(F.lit(3.0), about * F.lit(0.05))


def round2(x: Column) -> Column:
    """Two decimals, half away from zero on the decimal expansion."""
    return F.round(x.cast("decimal(38,15)"), 2).cast("double")


def is_name(term: Column, tokens: list[str]) -> Column:
    """Whether a term is one of the name words, or a phrase that holds one."""
    if not tokens:
        return F.lit(False)
    return term.isin(tokens) | (term.contains(" ") & F.arrays_overlap(F.split(term, " "), F.array(*[F.lit(t) for t in tokens])))
