"""Items out of lines, by arithmetic: three figures, quantity x price = total.

Figures are read in any locale; all comparisons are in whole hundredths. Three figures in a row are tried everywhere in a
line, its last three also as price, quantity, total, and its first as the quantity of its last two. Of several fits the
exact ones win, then three in a row, then the last. Product words behind three in a row belong to the description. Lines without a fit give an item if their last three fit roughly, if
they tell of a discount, or if they end in two amounts, price and total; else none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill import patterns as P
from quotemill.operators import adjustments, classify, cleanup, filters, grouping, lines
from quotemill.operators.numbers import cents, infer_quantity, once


SIGN = "[$€£¥₹]"
MINUS = rf"(?:^|[\s(:])-{SIGN}?\s?$|{SIGN}\s?-$"
REDUCTION = rf"\b(?:{'|'.join(P.DISCOUNT)})s?\b"
#: All of them hold at the beginning of a line: anchored once, they are not tried at every character.
SUMMARY = f"^(?:{'|'.join(pattern.removeprefix('^') for _, pattern in P.ADJUSTMENTS)})"


def items_of(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, description, quantity, unit_price, cost) of lines(doc_id, line_no, line)."""
    t = once(rows, "raw", F.regexp_extract_all("line", F.lit(P.TOKEN), 0)).where(F.size("raw") >= 2)
    # the texts before, between and behind the figures: the places of the few that are asked for follow from them
    t = once(t, "gap", F.split("line", P.TOKEN, -1))
    t = once(t, "signed", F.col("line").rlike(rf"-{SIGN}?\s?\d"))
    n = F.size("raw")

    def read(raw: Column, i: Column) -> Column:
        c = cents(raw)
        # a figure ends in a digit, which stands before the text between it and the next
        behind = F.concat(F.when(i > 0, "0").otherwise(""), F.get("gap", i))
        return F.struct(F.when(raw.rlike(r"^\d{1,6}$"), raw.try_cast("int")).alias("q"), F.when(F.col("signed") & F.right(behind, F.lit(4)).rlike(MINUS), -c).otherwise(c).alias("c"))

    t = once(t, "t", F.transform("raw", read))

    def close(product: Column, off: Column, total: Column, rough: bool) -> Column:
        return (off <= 50) | (off <= 0.15 * product) if rough else (off <= 1) | (10.0 * off <= F.abs(total))

    def differ(q: Column, p: Column, total: Column) -> Column:
        # size of the product and its distance from the total; most fit 64 bits, what would not is computed wide
        narrow = F.abs(p).between(0, 10**12) & F.abs(total).between(0, 10**17)
        sized = lambda exact, wide: F.when(narrow, exact.cast("double")).otherwise(wide.cast("double"))
        wide = q.cast("decimal(10,0)") * p.cast("decimal(19,0)")
        return F.struct(sized(F.abs(q.cast("long") * p), F.abs(wide)).alias("product"), sized(F.abs(q.cast("long") * p - total), F.abs(wide - total.cast("decimal(19,0)"))).alias("off"))

    # three in a row: those with a quantity first, of these those that fit
    windows = F.filter(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(i.cast("int").alias("i"), F.get("t", i)["q"].alias("q"), F.get("t", i + 1)["c"].alias("p"), F.get("t", i + 2)["c"].alias("total"))), lambda w: w["q"].between(1, 100000) & (w["p"] != 0) & (w["total"] != 0))
    fits = F.filter(F.transform(windows, lambda w: F.struct(w.alias("w"), differ(w["q"], w["p"], w["total"])["off"].alias("off"))), lambda x: close(None, x["off"], x["w"]["total"], False))
    best = F.array_max(F.transform(fits, lambda x: F.struct((x["off"] <= 1).cast("int").alias("level"), x["w"].alias("w"))))
    t = once(t, "best", F.when(n >= 3, best))

    def item(level: Column, kind: int, i: Column, q: Column, p: Column, total: Column, left: Column, right: Column, stop: Column | None = None) -> Column:
        return F.struct(level.alias("level"), F.lit(kind).alias("kind"), i.cast("int").alias("i"), q.cast("int").alias("q"), p.alias("p"), total.alias("total"), left.cast("int").alias("left"), right.cast("int").alias("right"), (F.length("line") if stop is None else stop).cast("int").alias("stop"))

    length = lambda name, start, count: F.length(F.array_join(F.slice(name, start, count), ""))
    i = F.col("best.w.i")
    at_i = length("gap", F.lit(1), i + 1) + length("raw", F.lit(1), i)
    after = at_i + length("raw", i + 1, F.lit(3)) + length("gap", i + 2, F.lit(2))
    t = once(t, "row", F.when(F.col("best").isNotNull(), item(F.col("best.level"), 3, i, F.col("best.w.q"), F.col("best.w.p"), F.col("best.w.total"), F.lit(0), at_i, after)))

    # the rest only where no three in a row fit exactly: by the first two and the last three figures
    open_ = F.col("row").isNull() | (F.col("row.level") < 1)
    size = lambda name, k: F.length(F.get(name, k))
    second_at = size("gap", F.lit(0)) + size("raw", F.lit(0)) + size("gap", F.lit(1))
    ends_at = [F.length("line") - size("gap", n)]
    for k in (1, 2):
        ends_at.append(ends_at[-1] - size("raw", n - k) - size("gap", n - k))
    places = [(F.lit(0), size("gap", F.lit(0)), None), (F.lit(1), second_at, None), *((n - k - 1, e - size("raw", n - k - 1), e) for k, e in enumerate(ends_at))]

    def figure(k: Column, start: Column, end: Column | None) -> Column:
        got = F.get("t", k)
        return F.struct(start.alias("start"), (start + size("raw", k) if end is None else end).alias("end"), got["q"].alias("q"), got["c"].alias("c"), F.get("raw", k).alias("raw"))

    t = once(t, "p", F.when(open_, F.array(*(figure(*x) for x in places))))
    before = lambda x: F.substring("line", F.greatest(x["start"] - 3, F.lit(1)), F.least(x["start"], F.lit(4)))

    def marked(x: Column) -> Column:
        # whether a figure is written as an amount, with two decimals or a sign of currency, or as a percentage
        behind, decimals = F.substring("line", x["end"] + 1, F.lit(4)), x["raw"].rlike(r"[.,]\d{2}$") & x["q"].isNull()
        return F.struct(*(x[k].alias(k) for k in ("start", "end", "q", "c")), (decimals | before(x).rlike(rf"{SIGN}\s?-?$") | behind.rlike(rf"^\s?{SIGN}(?!\s?[-\d])")).alias("amount"), F.startswith(F.ltrim(behind), F.lit("%")).alias("percent"))

    t = once(t, "e", F.when(open_, F.array(*(marked(F.col("p")[k]) for k in range(5)))))

    def fit(kind: int, i: Column, q: Column, price: Column, total: Column, left: Column, right: Column, rough: bool = False) -> Column:
        p, total, total_figure = price["c"], total["c"], total
        d = differ(q["q"], p, total)
        # figures apart from each other, or far from fitting: those of running text, dates and numbers of offers, would do so by chance
        near = close(d["product"], d["off"], total, rough) & ((price["amount"] & total_figure["amount"]) | ((d["off"] <= 1) & (price["amount"] | total_figure["amount"])))
        return F.when(q["q"].between(1, 100000) & (p != 0) & (total != 0) & (price["amount"] | total_figure["amount"]) & near, item(F.lit(-1) if rough else (d["off"] <= 1).cast("int"), kind, i, q["q"], p, total, left, right, total_figure["end"] if kind == 3 else None))

    zero = F.lit(0)
    first, second, *last = (F.col("e")[k] for k in range(5))
    quantity_first = F.when(n >= 3, fit(2, zero, first, last[1], last[0], first["end"], last[1]["start"]))
    price_first = F.when(n >= 3, fit(1, zero, last[1], last[2], last[0], zero, last[2]["start"]))
    roughly = F.when(n >= 3, fit(3, n - 3, last[2], last[1], last[0], zero, last[2]["start"], rough=True))

    # neither a discount nor a pair of amounts is what a summary line states
    whole = ~F.lower("line").rlike(SUMMARY)
    less = F.lower("line").rlike(REDUCTION) | ((F.length("line") <= 50) & F.exists("t", lambda x: x["c"] < 0))
    side_by_side = lambda a, b: F.substring("line", a["end"] + 1, b["start"] - a["end"]).rlike(rf"^(?:\s|{SIGN}|-)*$")
    counted = first["q"].between(1, 100000) & ~first["amount"] & ~first["percent"]
    cost = F.try_multiply(first["q"].cast("long"), second["c"])
    discount = F.when((first["start"] > 0) & second["amount"] & side_by_side(first, second) & whole & less, F.when(counted & (second["c"] != 0) & cost.isNotNull(), item(F.lit(-2), 0, zero, first["q"], second["c"], cost, zero, first["start"])).when(first["amount"] & (first["c"] != 0), item(F.lit(-2), 0, zero, F.lit(1), first["c"], first["c"], zero, first["start"])))
    behind = F.substring("line", last[0]["end"] + 1, F.lit(8))
    ends = last[0]["amount"] & last[1]["amount"] & side_by_side(last[1], last[0]) & behind.rlike(rf"^(?:\s|{SIGN})*$")
    inferred = infer_quantity(last[1]["c"], last[0]["c"])
    pair = F.when(ends & (last[1]["c"] != 0) & (last[0]["c"] != 0) & whole & F.substring("line", F.lit(1), last[1]["start"]).rlike(r"\p{L}{2}"), item(F.lit(-3), 0, zero, inferred, last[1]["c"], last[0]["c"], zero, last[1]["start"]))

    others = F.array_max(F.filter(F.array(F.col("row"), quantity_first, price_first, roughly, discount, pair), lambda w: w.isNotNull()))
    t = once(t, "w", F.when(open_, others).otherwise(F.col("row"))).where("w is not null")
    before_, behind_ = F.trim(F.substring("line", F.col("w.left") + 1, F.col("w.right") - F.col("w.left"))), F.trim(F.substring("line", F.col("w.stop") + 1, F.length("line")))
    belongs = (before_ != "") & (behind_ != "") & (F.length(behind_) < 100) & F.lower(behind_).rlike("|".join(P.TRAILING_WORDS))
    described = lines.clean_description(F.when(belongs, F.concat(before_, F.lit(" "), behind_)).otherwise(before_))
    return t.select("doc_id", "line_no", described.alias("description"), F.col("w.q").alias("quantity"), (F.col("w.p") / 100).alias("unit_price"), (F.col("w.total") / 100).alias("cost"))


def item_lines(docs: DataFrame) -> DataFrame:
    t = lines.lines_of(docs).withColumn("line", F.trim("line"))
    return t.where(~F.lower("line").rlike(P.SKIP_PATTERN))


def parse_quotes(docs: DataFrame) -> DataFrame:
    """Items of docs(doc_id, text), one row each."""
    return items_of(item_lines(docs))


def live_items(docs: DataFrame) -> DataFrame:
    """Items by the whole chain of steps: glyph numbers and misread digits put right, continued rows joined, summary, address
    and contact lines out, rows without figures out, prices of the next lines taken in, and descriptions that the
    classifier does not take for a product out."""
    t = lines.preprocess(lines.lines_of(docs))
    t = lines.merge_continuations(t).select("doc_id", "line_no", "line")
    t = lines.candidates(t).where(~filters.is_address(F.col("line"))).select("doc_id", "line_no", "line")
    items = items_of(lines.look_ahead(t).select("doc_id", "line_no", "line"))
    scored = classify.item_score(classify.features(items.withColumn("line", F.col("description")))).where("is_item")
    return scored.select("doc_id", "line_no", cleanup.final_description(F.col("description")).alias("description"), "quantity", "unit_price", "cost")


def as_results(items: DataFrame, adjustments_: DataFrame) -> DataFrame:
    """(doc_id, quantity, unit_price, total_price, n_items, total, default_item): all items of a document as one group; a
    document with a stated total only becomes one item of that amount."""
    group = items.groupBy("doc_id").agg(F.sum("quantity").alias("quantity"), F.round(F.sum("unit_price"), 2).alias("unit_price"), F.round(F.sum("cost"), 2).alias("total_price"), F.count(F.lit(1)).alias("n_items"))
    total = adjustments_.where("kind = 'total'").groupBy("doc_id").agg(F.max_by("value", "line_no").alias("total"))
    t = group.join(total, "doc_id", "full")
    alone = F.col("n_items").isNull()
    amount = lambda c: F.coalesce(c, F.col("total"))
    return t.select("doc_id", F.coalesce("quantity", F.lit(1)).alias("quantity"), amount("unit_price").alias("unit_price"), amount("total_price").alias("total_price"), F.coalesce("n_items", F.lit(1)).alias("n_items"), amount("total").alias("total"), alone.alias("default_item"))


def summarize(docs: DataFrame) -> DataFrame:
    """(doc_id, total_quantity, total_unit_price_sum, total_cost, number_of_groups) of every document with items."""
    return grouping.totals(grouping.by_quantity(parse_quotes(docs)))


def final_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, subtotal, final_total, n_applied): item totals with the document's own adjustments applied."""
    costs = parse_quotes(docs).groupBy("doc_id").agg(F.sum("cost").alias("total_cost"))
    return adjustments.apply(adjustments.extract(lines.lines_of(docs)), costs).drop("steps")


def results(docs: DataFrame) -> DataFrame:
    """(doc_id, summary, groups): a row for every document, also for those without items."""
    items = parse_quotes(docs)
    summary = grouping.totals(grouping.by_quantity(items)).select("doc_id", F.struct("total_quantity", "total_unit_price_sum", "total_cost", "number_of_groups").alias("summary"))
    return docs.select("doc_id").join(summary, "doc_id", "left").join(grouping.nested_groups(items), "doc_id", "left")


def hundredths(raw: str) -> int:
    """cents() of one figure, of any length."""
    digits = int(raw.replace(".", "").replace(",", ""))
    return digits if len(raw) > 2 and raw[-3] in ".," else digits * 100


def first_triple(figures: list[int]) -> tuple[int, int, int] | None:
    """(quantity, price, total) in hundredths of the first i < j < k, and the first order of them, that fits.

    Whether a figure begins a triple is told by searches among the sorted figures behind it, so a line of n figures costs
    about n * n * log n steps, and all pairs behind are tried for one figure only.
    """
    behind = sorted(v for v in figures if v > 0)

    def among(low: int, high: int, but: int) -> bool:
        return bisect_right(behind, high) - bisect_left(behind, low) > (low <= but <= high)

    def begins(v: int) -> bool:
        for a in behind:
            if 10 <= v <= 1_000_000 and among(-(-v * a // 110), v * a // 90, a):  # v is the quantity, a the price
                return True
            if 10 <= a <= 1_000_000 and (among(-(-v * a // 110), v * a // 90, a) or among(-(-90 * v // a), 110 * v // a, a)):  # a is the quantity, v the price or the total
                return True
        return False

    for i, v in enumerate(figures):
        if v <= 0:
            continue
        del behind[bisect_left(behind, v)]
        if begins(v):
            for j in range(i + 1, len(figures)):
                for k in range(j + 1, len(figures)):
                    for q, p, total in permutations((v, figures[j], figures[k])):
                        if 10 <= q <= 1_000_000 and p > 0 and total > 0 and 90 * total <= q * p <= 110 * total:
                            return q, p, total
    return None


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("quantity", "unit_price", "cost")]))
def triples(raws: pd.Series) -> pd.DataFrame:
    hits = [first_triple([hundredths(raw) for raw in line]) for line in raws]
    return pd.DataFrame([[x / 100 for x in hit] if hit else [None] * 3 for hit in hits], columns=["quantity", "unit_price", "cost"], dtype=float)


def permutation_match(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, quantity, unit_price, cost): the first three of a line's figures i < j < k, however many there are,
    and the first order of them, with quantity x price = total within a tenth."""
    t = once(rows.select("doc_id", "line_no", "line"), "raw", F.regexp_extract_all("line", F.lit(P.TOKEN), 0)).where(F.size("raw") >= 3)
    t = once(t, "hit", triples("raw")).where("hit.quantity is not null")
    return t.select("doc_id", "line_no", "hit.*")
