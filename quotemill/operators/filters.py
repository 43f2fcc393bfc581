"""Lines and items kept or dropped: addresses and contacts, and what may be an item by the rules of each document family.

All are conditions on one trimmed line or one item; null lines and descriptions fail every one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill import patterns as P
from quotemill.operators.lines import words


def hits(text: Column, terms: list[str], short: list[str] = ()) -> Column:
    """How many of the terms the text holds: `terms` anywhere, `short` as words."""
    found = F.lit(0)
    for t in terms:
        found = found + F.contains(text, F.lit(t)).cast("int")
    for t in short:
        found = found + text.rlike(P.LEFT + t + P.RIGHT).cast("int")
    return found


def is_address(line: Column) -> Column:
    """Addresses, contacts, headers of companies, and figures with hardly a word beside those of an address."""
    low = F.lower(line)
    address = hits(low, P.ADDRESS_LONG, P.ADDRESS_SHORT)
    placed = line.rlike(P.ZIP) | low.rlike(P.STREET) | low.rlike(P.SUITE) | (address >= 2)
    reached = low.rlike("|".join(P.REACH_LONG + P.REACH_SHORT)) & (line.rlike(P.PHONE) | line.rlike(P.EMAIL) | low.rlike(P.SITE))
    company = low.rlike("|".join(P.COMPANY)) & ~low.rlike("|".join(P.PRODUCT_WORDS))
    left = words(F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, P.FIGURE_SIGNS, "")), P.MARK, " ")))
    bare = (F.size(left) <= 2) & ((address > 0) | (hits(low, P.REACH_LONG, P.REACH_SHORT) > 0))
    return ((address > 0) & placed) | reached | company | bare | low.rlike(P.STREET_FIRST) | line.rlike(P.CITY)


def is_product(description: Column) -> Column:
    """What is left of a description's test where no classifier is at hand: three characters, no links, paths or code."""
    low = F.lower(F.trim(description))
    return F.coalesce((F.length(F.trim(description)) >= 3) & ~low.rlike(P.NO_PRODUCT), F.lit(False))


def is_item_multi_format(line: Column) -> Column:
    """A figure, a word for quantity, a product word; in short, every line with a digit or a product word."""
    low = F.lower(line)
    return line.rlike(r"\d+(?:,\d{3})*(?:\.\d{2})?") | low.rlike(P.COUNTED) | low.rlike(P.PRODUCT_TERMS)


def multi_format_lines(lines: DataFrame) -> DataFrame:
    """Lines that the multi-format family keeps. Its rule for telephone numbers also takes most prices for one."""
    t = lines.withColumn("line", F.trim("line"))
    line = F.col("line")
    wrong = line.rlike(P.ANY_PHONE) | line.rlike(P.ANY_ADDRESS) | line.rlike(P.ANY_CONTACT) | line.rlike(P.ANY_METADATA) | line.rlike(P.LABEL_ONLY) | line.rlike(r"^[-=_*]{3,}$") | ~line.rlike(r"[\p{L}\p{N}_]")
    return t.where((F.length("line") >= 3) & ~wrong & is_item_multi_format(line))


def is_item_template(line: Column) -> Column:
    """A price, a quantity in front, a product word, or letters and digits together; five characters at least."""
    return (F.length(line) >= 5) & (line.rlike(r"\d+[.,]\d{2}") | line.rlike(r"^\d+\s+") | line.rlike(P.TEMPLATE_PRODUCT) | (line.rlike("[A-Za-z]") & line.rlike(r"\d")))


def template_lines(lines: DataFrame) -> DataFrame:
    """Lines that the template family keeps: its patterns hold for whole lines or their beginnings only."""
    t = lines.withColumn("line", F.trim("line"))
    line = F.col("line")
    wrong = line.rlike(P.PHONE_ONLY) | line.rlike(P.ADDRESS_ONLY) | line.rlike(P.CONTACT_FIRST) | line.rlike(P.METADATA_FIRST) | line.rlike(P.HEADER_ONLY) | line.rlike(r"^[-=_]{3,}$")
    return t.where((F.length("line") >= 3) & ~wrong & (F.length(F.regexp_replace(line, P.MARK, "")) >= 3) & is_item_template(line))


def is_item_line(line: Column) -> Column:
    """The comprehensive family's test: 10 to 200 characters with letters and digits, no beginning of a summary or header,
    and a sign of currency or the shape of a price."""
    t = F.trim(line)
    return F.coalesce(F.length(t).between(10, 200) & ~F.lower(t).rlike(P.NO_ITEM_FIRST) & t.rlike(r"\d") & t.rlike("[A-Za-z]") & (t.rlike(P.CURRENCY_SIGN) | t.rlike(r"\d+[.,]\d{2}|\d+\s+\d+|\d{3,}")), F.lit(False))


def is_valid_item(description: Column, quantity: Column, unit_price: Column, cost: Column) -> Column:
    """A describing text of five characters, positive numbers, and quantity x price = cost within two in a hundred."""
    text, low = F.trim(description), F.lower(F.trim(description))
    w = words(low)
    described = (F.length(text) >= 5) & ~text.rlike(P.CODE_NOISE) & ~low.rlike(P.METADATA_FIRST_WORDS) & ~text.rlike(r"^[\d\s.,\-+]+$")
    whole = (2 * F.size(F.filter(w, lambda x: F.length(x) == 1)) <= F.size(w)) & (10 * F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\s]", "")) <= 3 * F.length(text))
    sums = (quantity > 0) & (unit_price > 0) & (cost > 0) & (F.abs(quantity * unit_price - cost) <= F.greatest(F.lit(0.01), cost * 0.02))
    return F.coalesce(described & whole & sums, F.lit(False))


def valid_results(groups: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_groups, n_items, is_valid): a result has a group and an item."""
    g = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_groups"))
    i = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
    t = g.join(i, "doc_id", "full").select("doc_id", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_items", F.lit(0)).alias("n_items"))
    return t.withColumn("is_valid", (F.col("n_groups") > 0) & (F.col("n_items") > 0))
