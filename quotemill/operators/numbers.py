"""Numbers in text: tokens with their places, and number formats of several locales. Texts without a number give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill import patterns as P


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions refer to instead of computing it again: a generator of one row parts them."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


RUN = 256  # tokens whose lengths are added up one by one; longer lines go by runs of so many


def with_tokens(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """Adds an array of (start, raw) of all matches; start counts from 0. The text between matches gives the places: the
    lengths of all runs of tokens before, and of the tokens before in the same run."""
    m = once(df, "_m", F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("raw"), F.split(text, pattern, -1).alias("between")))
    m = once(m, "_l", F.zip_with("_m.raw", F.slice("_m.between", F.lit(1), F.size("_m.raw")), lambda r, b: F.length(r) + F.length(b)))
    total = lambda start, n: F.aggregate(F.slice("_l", start, n), F.lit(0), lambda s, x: s + x)
    m = once(m, "_o", F.transform(F.sequence(F.lit(0), F.floor(F.size("_l") / RUN).cast("int")), lambda k: total(F.lit(1), k * RUN)))
    start = lambda i: F.get("_o", F.floor(i / RUN).cast("int")) + total(F.floor(i / RUN).cast("int") * RUN + 1, i % RUN) + F.length(F.get("_m.between", i))
    return once(m, name, F.transform("_m.raw", lambda x, i: F.struct(start(i).alias("start"), x.alias("raw")))).drop("_m", "_l", "_o")


def number_tokens(lines: DataFrame, context: int = 10) -> DataFrame:
    """(doc_id, line_no, place, start, raw, value, is_money, is_quantity): each number with what stands around it."""
    t = with_tokens(lines.select("doc_id", "line_no", "line"), "all", "line", P.NUMBER).select("doc_id", "line_no", "line", F.posexplode("all").alias("place", "t"))
    t = t.select("doc_id", "line_no", "place", "t.start", "t.raw", F.replace("t.raw", F.lit(","), F.lit("")).cast("decimal(38,2)").cast("double").alias("value"), "line")
    low = F.greatest(F.col("start") - context, F.lit(0))
    around = F.lower(F.substring("line", low + 1, F.col("start") - low + F.length("raw") + context))
    return t.select("doc_id", "line_no", "place", "start", "raw", "value", F.substring("line", F.col("start"), F.lit(1)).isin("$", "€").alias("is_money"), around.rlike("qty|quantity|pcs|each|ea").alias("is_quantity"))


def plain_figure(text: Column) -> Column:
    """What is left of an amount without signs and words."""
    return F.regexp_replace(text, r"[^0-9.,\-]", "")


def us_number(figure: Column) -> Column:
    """Points and then a comma before two digits are European; else commas go: 2.311,25 and 2,311.25, but 123,45 is 12345."""
    european = figure.rlike(r"^-?\d{1,3}(?:\.\d{3})+,\d{2}$")
    return F.coalesce(F.when(european, F.translate(figure, ",.", ".")).otherwise(F.replace(figure, F.lit(","))).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def european_number(figure: Column) -> Column:
    """1.234,56 and 123,45 and 1,234.56; null where commas and points do not tell."""
    return (
        F.when(figure.rlike(r"^-?\d{1,3}(?:\.\d{3})*,\d{1,2}$"), F.translate(figure, ",.", "."))
        .when(figure.rlike(r"^-?\d+,\d{1,2}$"), F.translate(figure, ",", "."))
        .when(figure.rlike(r"^-?\d{1,3}(?:,\d{3})*(?:\.\d+)?$") | figure.rlike(r"^-?\d+(?:\.\d+)?$"), F.replace(figure, F.lit(",")))
        .try_cast("decimal(18,2)")
    )


def last_separator_number(figure: Column) -> Column:
    """The last of comma and point is the decimal mark; a comma alone is, before one or two digits."""
    comma, dot = F.contains(figure, F.lit(",")), F.contains(figure, F.lit("."))
    eu = comma & dot & (F.locate(",", F.reverse(figure)) < F.locate(".", F.reverse(figure)))
    short = comma & ~dot & figure.rlike(r",\d{0,2}$")
    plain = F.when(eu, F.translate(figure, ",.", ".")).when(short, F.translate(figure, ",", ".")).otherwise(F.replace(figure, F.lit(",")))
    return F.bround(plain.try_cast("decimal(18,4)"), 2).cast("decimal(18,2)")


def cents(raw: Column) -> Column:
    """A TOKEN in hundredths: its digits, two of which are decimals after a mark; null beyond 64 bits."""
    digits = F.regexp_replace(raw, "[.,]", "").try_cast("long")
    return F.when(raw.rlike(r"[.,]\d{2}$"), digits).otherwise(F.try_multiply(digits, F.lit(100)))


def infer_quantity(unit: Column, total: Column) -> Column:
    """total / unit to the nearest whole (half to even) if it is 1 to 100000 and explains the total within 5 %; else 1."""
    q = F.bround(F.try_divide(total, unit), 0)
    return F.when((unit > 0) & q.between(1, 100000) & (F.abs(q * unit - total) <= 0.05 * F.abs(total)), q.cast("int")).otherwise(1)


def flexible_quantity(text: Column) -> Column:
    """The first pattern of a quantity with 1 to 10000; else the first number of 1 to 1000; else 1."""
    found = [r"(?i)(?:qty|quantity|amount|count):\s*(\d+)", r"(?i)(?:qty|quantity|amount|count)\s+(\d+)", r"(?i)(\d+)\s*(?:pieces?|units?|ea|each|pcs)", r"^(\d+)\s+", r"(\d+)\s*[×x]", r"(\d+)\s*@", r"(\d+)\s*\$"]
    each = [F.regexp_extract(text, p, 1).try_cast("long") for p in found]
    alone = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), 1), lambda x: x.try_cast("long")), lambda v: v.between(1, 1000))
    return F.coalesce(*[F.when(e.between(1, 10000), e) for e in each], F.try_element_at(alone, F.lit(1)), F.lit(1)).cast("int")
