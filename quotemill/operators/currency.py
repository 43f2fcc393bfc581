"""The currency of a document, and amounts written in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.patterns import SYMBOLS


def first_symbol(text: Column) -> Column:
    """The currency of the first of $ € £ ¥ ₹, in this order, that occurs; USD without any."""
    found = F.lit("USD")
    for symbol, code in reversed(SYMBOLS):
        found = F.when(F.contains(text, F.lit(symbol)), code).otherwise(found)
    return F.when(text.isNotNull(), found)


def vote(docs: DataFrame) -> DataFrame:
    """(doc_id, currency, votes): the currency whose symbol or code stands before a figure most often; ties go to the
    earlier symbol. Documents without any have no row."""
    counts = F.array(*[F.struct((F.regexp_count("text", F.lit(rf"(?:\{symbol}|\b{code})\s*[\d,.]+"))).alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("code")) for k, (symbol, code) in enumerate(SYMBOLS)])
    best = docs.where(F.col("text").isNotNull()).select("doc_id", F.array_max(counts).alias("b"))
    return best.where("b.n > 0").select("doc_id", F.col("b.code").alias("currency"), F.col("b.n").alias("votes"))


def cid_share(docs: DataFrame) -> DataFrame:
    """(doc_id, n_cid, cid_share, garbled): glyph numbers against characters; more than a twentieth is garbled."""
    n = F.regexp_count("text", F.lit("cid:"))
    t = docs.where(F.length("text") > 0).select("doc_id", n.alias("n_cid"), (n / F.length("text")).alias("cid_share"))
    return t.withColumn("garbled", F.col("cid_share") > 0.05)


def written(amount: Column, code: Column) -> Column:
    """An amount with its currency sign: behind it for EUR, GBP and CHF, else before it; null stays null."""
    sign = F.when(code == "EUR", "€").when(code == "GBP", "£").when(code == "CHF", "CHF").when(code == "JPY", "¥").when(code == "INR", "₹").otherwise("$")
    figure = amount.cast("decimal(18,2)").cast("string")
    return F.when(amount.isNull(), F.lit(None)).when(code.isin("EUR", "GBP", "CHF"), F.concat(figure, F.lit(" "), sign)).otherwise(F.concat(sign, figure))
