"""Prices found in text by patterns, with the confidence that each deserves, and numbers read by currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill import patterns as P
from quotemill.operators.cleanup import without_spans
from quotemill.operators.numbers import european_number, flexible_quantity, last_separator_number, once, plain_figure, us_number, with_tokens


def value_of(raw: Column) -> Column:
    return last_separator_number(plain_figure(raw)).cast("double")


def around(start: Column, length: Column, reach: int) -> Column:
    low = F.greatest(start - reach, F.lit(0))
    return F.substring("line", low + 1, start - low + length + reach)


def all_tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, place, start, raw, value, is_currency, is_quantity, is_percentage) of every number: plain,
    scientific, fraction and ratio; kinds overlap."""
    found = None
    for kind, pattern in enumerate(P.NUMBER_KINDS):
        t = with_tokens(lines.select("doc_id", "line_no", "line"), "all", "line", pattern).select("doc_id", "line_no", "line", F.posexplode("all").alias("place", "t"))
        t = t.select("doc_id", "line_no", "line", F.lit(kind).alias("kind"), "place", "t.start", "t.raw")
        found = t if found is None else found.unionByName(t)
    near = around(F.col("start"), F.length("raw"), 10)
    money = F.contains("raw", F.lit("$")) | F.lower(near).rlike("price|cost|total|amount")
    return found.select("doc_id", "line_no", "kind", "place", "start", "raw", value_of(F.col("raw")).alias("value"), money.alias("is_currency"), F.lower(near).rlike("qty|quantity|pcs|each|ea").alias("is_quantity"), F.contains("raw", F.lit("%")).alias("is_percentage"))


def confidence(raw: Column, context: Column, value: Column) -> Column:
    """Hundredths: 50, more for a sign of currency, words of price nearby, two decimals and an ordinary size; at most 100."""
    size = F.when(value.between(0.01, 100000), 10).when(value > 100000, -20).otherwise(0)
    return F.least(F.lit(50) + F.when(raw.rlike("[$€£¥]"), 30).otherwise(0) + F.when(context.rlike("price|cost|total|amount|rate|fee|charge"), 20).otherwise(0) + F.when(raw.rlike(r"\.[^.]{2}$"), 20).otherwise(0) + size, F.lit(100))


def price_tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, stop, raw, value, confidence): prices by six patterns; of those at one place the likeliest."""
    found = None
    for order, pattern in enumerate(P.PRICE_KINDS):
        t = lines.select("doc_id", "line_no", F.trim("line").alias("line"))
        t = with_tokens(t, "all", "line", f"(?i){pattern}")
        t = t.select("doc_id", "line_no", "line", F.posexplode(F.arrays_zip("all", F.regexp_extract_all("line", F.lit(f"(?i){pattern}"), 1).alias("g"))).alias("k", "z"))
        t = t.select("doc_id", "line_no", "line", F.lit(order).alias("ord"), F.col("z.all.start").alias("start"), F.length("z.all.raw").alias("len"), F.col("z.g").alias("raw"))
        found = t if found is None else found.unionByName(t)
    found = once(found, "value", value_of(F.col("raw"))).where("value is not null")
    found = found.withColumn("confidence", confidence(F.col("raw"), F.lower(around(F.col("start"), F.col("len"), 15)), F.col("value")))
    best = found.groupBy("doc_id", "line_no", "start", (F.col("start") + F.col("len")).alias("stop")).agg(F.max(F.struct("confidence", (-F.col("ord")).alias("o"), "raw", "value")).alias("b"))
    return best.select("doc_id", "line_no", "start", "stop", "b.raw", "b.value", "b.confidence")


def unit_prices(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, pattern, unit, raw, value, confidence): the price for a unit that a line names, by the last of ten
    patterns that fits it."""
    found = F.lit(None).cast("struct<pattern:int,unit:string,raw:string>")
    for k, (unit, pattern) in enumerate(P.UNIT_PRICES):
        found = F.when(F.col("line").rlike(f"(?i){pattern}"), F.struct(F.lit(k).alias("pattern"), F.lit(unit).alias("unit"), F.regexp_extract("line", f"(?i){pattern}", 1).alias("raw"))).otherwise(found)
    t = once(lines.select("doc_id", "line_no", "line"), "u", found).where("u is not null")
    return t.select("doc_id", "line_no", "u.pattern", "u.unit", "u.raw", value_of(F.col("u.raw")).alias("value"), (80 + 2 * F.col("u.pattern")).alias("confidence"))


def quantities_of_text(docs: DataFrame) -> DataFrame:
    """(doc_id, quantity): numbers of up to four digits whose first occurrence stands near a word for quantity or price."""
    t = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.explode(F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike(r"^\d{1,4}$")))).alias("number"))
    at = F.instr("text", F.col("number")) - 1
    low = F.greatest(at - 30, F.lit(0))
    near = F.lower(F.substring("text", low + 1, at - low + 30))
    return t.where((F.col("number").cast("int") >= 1) & near.rlike(r"qty|quantity|price|total|\$|rate")).select("doc_id", F.col("number").cast("int").alias("quantity")).distinct()


def stated_total(docs: DataFrame) -> DataFrame:
    """(doc_id, total): what a text states as its total, by the first of three patterns; without one no row."""
    raws = [F.nullif(F.regexp_extract("text", f"(?i){p}", 1), F.lit("")) for p in P.STATED_TOTALS]
    t = docs.where(F.col("text").isNotNull()).select("doc_id", F.coalesce(*raws).alias("raw")).where("raw is not null")
    return t.select("doc_id", value_of(F.col("raw")).alias("total"))


def locale_price(text: Column) -> Column:
    """A price read as its sign of currency is written at home: points or blanks part thousands of € and ₽, commas those of
    the others; without a sign a comma before two last digits, or alone, is the decimal mark. Null and empty are 0."""
    figure = F.regexp_replace(text, r"[^0-9.,\-]", "")
    two = (F.regexp_count(figure, F.lit(",")) == 1) & figure.rlike(r",\d{2}$")
    continental = F.when(text.rlike("[€₽]"), True).when(text.rlike("[£¥₹₩$]"), False).when(F.contains(figure, F.lit(",")), F.when(F.contains(figure, F.lit(".")), two).otherwise(True)).otherwise(False)
    read = F.when(continental, F.translate(figure, ",.", ".")).otherwise(F.replace(figure, F.lit(","))).try_cast("decimal(18,4)")
    return F.coalesce(F.bround(read, 2).cast("decimal(18,2)"), us_number(figure))


def by_currency(text: Column, code: Column) -> Column:
    """A figure in plain digits by the custom of its currency: a decimal comma, no decimals at all, or a decimal point."""
    bare = F.regexp_replace(text, r"\s+", "")
    european = F.when(F.regexp_count(bare, F.lit(",")) == 1, F.translate(bare, ",.", ".")).when(F.contains(bare, F.lit(",")), F.translate(bare, ",.", ".")).otherwise(F.replace(bare, F.lit(".")))
    return F.when(code.isin(*P.COMMA_CURRENCIES), european).when(code.isin(*P.WHOLE_CURRENCIES), F.regexp_replace(bare, "[.,]", "")).otherwise(F.replace(bare, F.lit(",")))


def unit_price_of(cost: Column, quantity: Column) -> Column:
    """The price of one of `quantity` pieces, half to even at four and then at two decimals; 0 without a quantity."""
    return F.when(quantity > 0, F.bround(F.bround(cost.cast("decimal(18,2)") / quantity, 4), 2)).otherwise(0).cast("double")


#: The same matches as P.STRUCTURED and P.STRUCTURED_NO_QUANTITY, in Java only and in time that grows with the line: all before
#: the first sign of currency is one run of a description's characters, so a match can begin only where such a run does, or
#: behind the match before; and the shortest description ends where blanks begin, or is one blank.
IN_DESCRIPTION = r"[A-Za-z\s\-()0-9]"
DESCRIBED = rf"(?:\G|(?<!{IN_DESCRIPTION})){IN_DESCRIPTION}+?(?:(?<!\s)|(?<=\G\s)|(?<=[^A-Za-z\s\-()0-9]\s))"
AMOUNTS = rf"\s++{P.CURRENCY_SIGN}\d++[.,]\d{{2}}\s++{P.CURRENCY_SIGN}\d++(?:\.\d{{3}})?[.,]\d{{2}}"
PAIR = rf"\s{P.CURRENCY_SIGN}\d++[.,]\d{{2}}\s++{P.CURRENCY_SIGN}\d"
STRUCTURED_AT = rf"{DESCRIBED}\s++\d++{AMOUNTS}"
STRUCTURED_NO_QUANTITY_AT = rf"{DESCRIBED}{AMOUNTS}"


def structured_items(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, place, description, quantity, unit_price, cost): description, quantity and two amounts with a sign
    of currency; without a quantity, or with one beyond 32 bits, it is what the amounts make it, null where that is beyond
    them too. A line may hold several."""
    t = lines.select("doc_id", "line_no", F.trim("line").alias("line")).where(F.col("line").rlike(PAIR))
    of = lambda x, p, k: F.regexp_extract(x, p, k)
    t = once(t, "f", F.when(F.col("line").rlike(rf"\d\s*+(?<=\s){PAIR[2:]}"), F.regexp_extract_all("line", F.lit(STRUCTURED_AT), 0)).otherwise(F.array().cast("array<string>")))
    full = F.transform("f", lambda x: F.struct(*(of(x, P.STRUCTURED, k).alias(n) for k, n in ((1, "d"), (2, "q"), (3, "p"), (4, "t")))))
    part = F.transform(F.regexp_extract_all("line", F.lit(STRUCTURED_NO_QUANTITY_AT), 0), lambda x: F.struct(of(x, P.STRUCTURED_NO_QUANTITY, 1).alias("d"), F.lit("").alias("q"), *(of(x, P.STRUCTURED_NO_QUANTITY, k).alias(n) for k, n in ((2, "p"), (3, "t")))))
    t = once(t, "r", F.when(F.size("f") > 0, full).otherwise(part))
    t = t.select("doc_id", "line_no", F.posexplode("r").alias("place", "x"))
    p, total = european_number(F.col("x.p")).cast("double"), european_number(F.col("x.t")).cast("double")
    t = t.select("doc_id", "line_no", "place", F.trim("x.d").alias("description"), F.col("x.q").try_cast("int").alias("q"), p.alias("unit_price"), total.alias("cost"))
    inferred = F.when(F.col("unit_price") > 0, F.bround(F.col("cost") / F.col("unit_price"), 0)).otherwise(1).try_cast("int")
    t = t.where((F.length("description") > 2) & ~F.col("description").isin("SUBTOTAL", "TOTAL", "TAX") & F.col("unit_price").isNotNull() & F.col("cost").isNotNull())
    return t.select("doc_id", "line_no", "place", "description", F.coalesce("q", inferred).alias("quantity"), "unit_price", "cost")


def currency_items(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, pattern, description, quantity, unit_price, cost): the first pattern of a line that fits, dollars
    before euros, with a quantity before without."""
    t = lines.select("doc_id", "line_no", F.trim("line").alias("line"))
    found = F.lit(None).cast("struct<pattern:string,d:string,q:string,p:string,t:string>")
    for name, pattern, counted in reversed(P.CURRENCY_ITEMS):
        g = lambda k, pattern=pattern: F.regexp_extract("line", pattern, k)
        found = F.when(F.col("line").rlike(pattern), F.struct(F.lit(name).alias("pattern"), g(1).alias("d"), (g(2) if counted else F.lit("1")).alias("q"), g(3 if counted else 2).alias("p"), g(4 if counted else 3).alias("t"))).otherwise(found)
    t = once(t, "x", found).where("x is not null")
    euro = F.startswith("x.pattern", F.lit("eur"))
    read = lambda c: F.when(euro, european_number(F.col(c))).otherwise(F.replace(F.col(c), F.lit(",")).try_cast("decimal(18,2)")).cast("double")
    t = t.select("doc_id", "line_no", "x.pattern", F.trim("x.d").alias("description"), F.coalesce(F.col("x.q").try_cast("int"), F.lit(1)).alias("quantity"), read("x.p").alias("unit_price"), read("x.t").alias("cost"))
    return t.where((F.length("description") >= 3) & F.col("unit_price").isNotNull() & F.col("cost").isNotNull())


def three_figures(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, description, quantity, unit_price, cost): words before three figures, in the first order of them in
    which the quantity (1 to 10000) times the price is the total to the cent."""
    t = lines.select("doc_id", "line_no", "line").where(F.col("line").rlike(P.THREE_FIGURES))
    v = [value_of(F.regexp_extract("line", P.THREE_FIGURES, k)) for k in (2, 3, 4)]
    t = once(t, "v", F.array(*v))
    found = F.lit(None).cast("struct<q:double,p:double,t:double>")
    for order in reversed([(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]):
        q, p, total = (F.col("v")[k] for k in order)
        found = F.when(q.between(1, 10000) & (p > 0) & (F.abs(q * p - total) <= 0.0100001), F.struct(q.alias("q"), p.alias("p"), total.alias("t"))).otherwise(found)
    t = once(t, "x", found).where("x is not null")
    return t.select("doc_id", "line_no", F.trim(F.regexp_extract("line", P.THREE_FIGURES, 1)).alias("description"), F.col("x.q").alias("quantity"), F.col("x.p").alias("unit_price"), F.col("x.t").alias("cost"))


def robust_items(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, strategy, description, quantity, unit_price, cost) of lines, by the first strategy that answers: a
    price for a unit that the line names times its quantity; its first and last figure of money with a quantity within 15 in
    a hundred; its last two figures with the quantity between them."""
    t = with_tokens(lines.select("doc_id", "line_no", F.trim("line").alias("line")), "tokens", "line", P.NUMBER_KINDS[0])

    def token(x: Column) -> Column:
        near = F.lower(around(x["start"], F.length(x["raw"]), 10))
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(x["raw"])).alias("stop"), value_of(x["raw"]).alias("v"), (F.contains(x["raw"], F.lit("$")) | near.rlike("price|cost|total|amount")).alias("money"), near.rlike("qty|quantity|pcs|each|ea").alias("counted"))

    t = once(t, "n", F.filter(F.transform("tokens", token), lambda x: x["v"].isNotNull()))
    named = unit_prices(lines).select("doc_id", "line_no", F.col("value").alias("named"), F.col("raw").alias("named_raw"))
    t = t.join(named, ["doc_id", "line_no"], "left")
    money = F.filter("n", lambda x: x["money"])
    first, last = F.try_element_at(money, F.lit(1)), F.try_element_at(money, F.lit(-1))
    counted = F.coalesce(F.try_element_at(F.filter("n", lambda x: x["counted"]), F.lit(1)), F.try_element_at(F.filter("n", lambda x: ~x["money"] & x["v"].between(1, 10000)), F.lit(1)))
    a, b = F.try_element_at(F.col("n"), F.lit(-2)), F.try_element_at(F.col("n"), F.lit(-1))

    def item(strategy: str, q: Column, p: Column, total: Column, text: Column) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), text.alias("description"), q.cast("double").alias("quantity"), p.cast("double").alias("unit_price"), total.cast("double").alias("cost"))

    spans = lambda *x: F.array(*(F.struct(y["start"].alias("start"), y["stop"].alias("stop")) for y in x))
    q = flexible_quantity(F.col("line"))
    before = F.trim(F.substring("line", F.lit(1), F.instr("line", F.col("named_raw")) - 1))
    by_name = F.when(F.col("named").isNotNull() & (F.length(before) > 2), item("unit_price", q, F.col("named"), q * F.col("named"), before))
    fits = (F.size(money) >= 2) & counted.isNotNull() & (last["v"] != 0) & (F.abs(counted["v"] * first["v"] - last["v"]) <= 0.15 * F.abs(last["v"]))
    by_money = F.when(fits, item("money", counted["v"], first["v"], last["v"], without_spans(F.col("line"), F.array_distinct(spans(counted, first, last)))))
    ratio = b["v"] / a["v"]
    by_last = F.when((F.size("n") >= 2) & (a["v"] != 0) & F.when(a["v"] != 0, ratio).between(0.1, 10000), item("last_two", F.bround(F.when(a["v"] != 0, ratio), 2), a["v"], b["v"], without_spans(F.col("line"), spans(a, b))))
    found = F.filter(F.array(by_name, by_money, by_last), lambda x: x.isNotNull() & (F.length(x["description"]) > 2))
    t = once(t, "item", F.try_element_at(found, F.lit(1))).where("item is not null")
    return t.select("doc_id", "line_no", "item.*")
