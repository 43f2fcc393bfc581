"""Descriptions and headers brought to full words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotemill import patterns as P


def expand(text: Column) -> Column:
    """Abbreviations written out one after the other, each only if it stands in the text as it came."""
    low = F.lower(text)
    pairs = F.array(*[F.struct(F.lit(k).alias("short"), F.lit(v).alias("full")) for k, v in P.ABBREVIATIONS.items()])
    present = F.filter(pairs, lambda p: F.contains(low, p["short"]))  # a fold, for nested cases would double with every word
    return F.when(text.isNotNull(), F.aggregate(present, text, lambda out, p: F.regexp_replace(out, F.concat(F.lit(r"(?i)\b"), p["short"], F.lit(r"\b")), p["full"])))


def header(text: Column) -> Column:
    """The field a header names: an abbreviation, a word that begins with a known stem, else the header itself."""
    low = F.lower(F.trim(text))
    found = low
    for stem, field in reversed(P.HEADER_STEMS):
        found = F.when(low.rlike(rf"\b{stem}"), field).otherwise(found)
    exact = F.create_map([F.lit(x) for kv in P.ABBREVIATIONS.items() for x in kv])
    return F.coalesce(exact[low], found)
