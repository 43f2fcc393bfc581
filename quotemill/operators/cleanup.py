"""Descriptions and texts freed of what is not theirs. Null stays null; what is left of under three characters is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill import patterns as P
from quotemill.operators import classify
from quotemill.operators.numbers import once


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def final_description(text: Column) -> Column:
    """Without phrases of test documents and forms, and without a single figure after `and` or a comma at the end."""
    for pattern in P.TEST_PHRASES:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    text = collapsed(F.regexp_replace(F.regexp_replace(text, r"\s+and\s+[1-9]\s*$", ""), r"\s+,\s*[1-9]\s*$", ""))
    return F.when(F.length(text) < 3, "").otherwise(text)


def uncorrupted(text: Column) -> Column:
    """Without letters parted one by one, and broken labels of forms; single words stay as they are."""
    clean = text
    for pattern in P.CORRUPTED:
        clean = F.regexp_replace(clean, f"(?i){pattern}", "")
    clean = collapsed(clean)
    return F.when(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) < 2, text).otherwise(F.when(F.length(clean) < 3, "").otherwise(clean))


def without_spans(line: Column, spans: Column) -> Column:
    """The line without the spans (start, stop; counted from 0) of its figures, last first; no marks at its ends."""
    cut = F.aggregate(F.sort_array(spans, asc=False), line, lambda out, s: F.concat(F.substring(out, F.lit(1), s["start"]), F.substring(out, s["stop"] + 1, F.length(out))))
    return F.regexp_replace(F.regexp_replace(collapsed(cut), r"^[^\p{L}\p{N}_]+", ""), r"[^\p{L}\p{N}_]+$", "")


def clean_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): control characters, page marks, links and paths gone, signs of rare currencies as €, lines of
    noise and of under three characters dropped. Lines are never run together."""
    line = F.regexp_replace("line", r"[\x00-\x1f\x7f]", "")
    for pattern in P.PAGE_NOISE:
        line = F.regexp_replace(line, f"(?i){pattern}", "")
    line = F.regexp_replace(F.regexp_replace(line, P.KEPT_SIGNS, ""), P.RARE_CURRENCY, "€")
    # the noise of a line refers to it dozens of times: it is cleaned once, and parted at its single blanks once
    t = once(lines.select("doc_id", "line_no", "line"), "line", F.trim(F.regexp_replace(line, r"\s{2,}|[^\S ]", " "))).where(F.length("line") > 2)
    t = once(once(t, "w", F.split("line", " ")), "noise", classify.noise_score(F.col("line"), F.col("w")))
    return t.where("noise < 7").select("doc_id", "line_no", "line")


def without_artifacts(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of docs(doc_id, text): hex marks, error messages and overlong words gone; lines that are not
    three tenths letters or digits dropped."""
    text = F.regexp_replace(F.regexp_replace("text", "<0a>", "\n"), "<[0-9a-f]{2}>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)Internal Error:.*?\.", ""), r"(?s)Cannot handle URI.*?\.", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\b[A-Za-z]{20,}\b", ""), "\r\n?", "\n")
    t = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    t = t.withColumn("line", collapsed(F.col("line"))).where("line <> ''")
    return t.where(10 * F.length(F.regexp_replace("line", r"[^\p{L}\p{N}]", "")) > 3 * F.length("line"))


def page_scores(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, method, score) of pages(doc_id, page_no, method, line), a row a line: figures, money and words of
    quotes count for a reading of a page, many odd signs against it."""
    t = F.trim("line")
    odd = F.length(t) - F.length(F.regexp_replace(t, P.ODD_SIGNS, ""))
    points = F.when(F.size(F.regexp_extract_all(t, F.lit(r"[\d,]+\.?\d*"), 0)) >= 2, 10).otherwise(0) + F.when(F.contains(t, F.lit("$")), 5).otherwise(0)
    points = points + F.when(F.lower(t).rlike("qty|quantity|service|product"), 3).otherwise(0) - F.when(10 * odd > F.length(t), odd).otherwise(0)
    return pages.groupBy("doc_id", "page_no", "method").agg(F.sum(F.when(t != "", points).otherwise(0)).alias("score"))


def best_pages(pages: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, page_no, method, score): the best reading of each page; of equals the first in order."""
    scored = page_scores(pages)
    rank = -F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    best = scored.groupBy("doc_id", "page_no").agg(F.max(F.struct("score", rank.alias("rank"), "method")).alias("b"))
    return best.select("doc_id", "page_no", "b.method", "b.score")


def first_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """The first n pages of every document, for what can be told from a sample."""
    return pages.where(F.col("page_no") <= n)


def combined_items(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, place, text): the items of a line that holds several, each with its price and total in euros and
    without a postal code in front; a line without any is its own item."""
    found = F.regexp_extract_all("line", F.lit(P.COMBINED), 0)
    items = F.when(F.size(found) > 0, F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"^(?:[A-Z]{2}\s+)?\d{5}\s+", ""))).otherwise(F.array("line"))
    return lines.select("doc_id", "line_no", F.posexplode(items).alias("place", "text"))
