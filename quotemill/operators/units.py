"""Amounts recorded in several currencies, scales and price bases, brought to US dollars (per piece).

The text around a figure is segmented by dynamic programming over tries of prefixes (thousand, k),
roots (currencies, counts of pieces) and exponents (how many pieces a price covers). A word can mean
several things (c: cents or hundred; M: thousand pieces; thousand: a scale or a basis), so every
decomposition is scored, with priors of the field: a total has no price basis. What the text leaves
open comes from the description or the feed, and a price basis that nothing states from quantity x price
against the total.

Defined results: null and empty fields, and fields without a figure, give no amount and no case.
Unknown words beside a figure are passed over at a cost. Without a known feed bare figures are dollars
with a decimal point. A currency for which the table of units has no factor is a case without an amount.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.operators.numbers import once

#: Spellings of currencies, scales and counts. Single letters keep their case.
CURRENCY = {
    "USD": ("$", "USD", "US$", "US dollar", "US dollars", "dollar", "dollars"),
    "USC": ("¢", "USc", "USC", "US cent", "US cents", "cent", "cents", "ct", "cts", "c"),
    "EUR": ("€", "EUR", "Euro", "Euros"),
    "GBP": ("£", "GBP", "pound", "pounds"),
    "CHF": ("CHF", "Fr.", "SFr."),
    "JPY": ("¥", "JPY", "yen"),
    "CNY": ("CNY", "RMB", "yuan"),
    "INR": ("₹", "INR", "rupees"),
    "RUB": ("₽", "RUB", "руб."),
    "BRL": ("R$", "BRL"),
    "CAD": ("C$", "CA$", "CAD"),
    "AUD": ("A$", "AU$", "AUD"),
    "MXN": ("MX$", "MXN"),
    "PLN": ("zł", "PLN"),
    "CZK": ("Kč", "CZK"),
    "SEK": ("SEK",),
    "NOK": ("NOK",),
    "DKK": ("DKK",),
}
SCALE = {1000.0: ("k", "K", "T", "tsd.", "Tsd.", "tsd", "thousand", "Tausend", "mille")}
COUNT = {
    1.0: ("pc", "pcs", "pc.", "piece", "pieces", "ea", "each", "unit", "units", "St.", "Stk.", "Stück", "pza", "pièce"),
    2.0: ("pr", "pair", "pairs", "Paar", "paire", "par"),
    12.0: ("dz", "doz", "dozen", "Dutzend", "douzaine", "docena", "dúzia"),
    100.0: ("C", "hundred", "Hundert", "cent", "ciento", "cien", "cento", "sto", "сто"),
    1000.0: ("M", "thousand", "Tausend", "mille", "millar", "mil", "milhar", "tysiąc", "тысячу"),
}
LINK = ("/", "per", "the", "by the", "a", "an", "p.", "je", "pro", "par", "por", "au", "à la", "la", "for", "za", "за", "PU", "@")
ALONE = {1.0, 2.0, 12.0}  # counts that need no link before them: each, pair, dozen
#: Letters of other scripts and full-width digits that a description may hold in place of Latin ones, other spaces, and what is invisible.
LOOKS_LIKE = (
    "АВЕКМНОРСТУХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο０１２３４５６７８９\u00a0\u2002\u2007\u2009\u202f\u3000\u00ad\u200b\u200c\u200d\u2060\ufeff",
    "ABEKMHOPCTYXaeopcyxijsABEZHIKMNOPTYXo0123456789      ",
)
#: How a description says what its price covers: a word for price or sale, a bracket, a comma or a dash, and a count behind a link.
PHRASE = (
    r"(?i)(?:(?:\b(?:price|prices|priced|sold|preise?|prix|precio|preço|prezzo|cena|цена)\b|[,(]|\s-\s)\s*|\[(?=PU ))"
    r"((?:per|je|by the|au|à la|por|pro|par|za|за|la)\s+(?:[0-9]+ ?k?|hundred|hundert|cent|ciento|cien|cento|C|dozen|doz|dz|dutzend|douzaine|docena|dúzia|thousand|tausend|mille|millar|mil|milhar|M|pair|pairs|paar|paire|par)\b|PU [0-9]+)"
)
UNIT_PRICE, TOTAL = "unit_price", "total"
#: Log priors of the field's dimension for a basis and for a scaled currency.
PRIOR = {UNIT_PRICE: {"basis": -0.5, "scale": -1.0, "currency": -0.2}, TOTAL: {"basis": -20.0, "scale": -0.5, "currency": -0.2}}


class Trie:
    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, *meaning) -> None:
        node = self.root
        for c in word if len(word) == 1 else word.lower():
            node = node.setdefault(c, {})
        node.setdefault("", []).append((meaning, len(word) == 1))

    def match(self, text: str, at: int) -> Iterator[tuple[int, tuple]]:
        """(end, meaning) of every word that begins at `at`; words of letters end at a word's end."""
        for letters, single in ((text, True), (text.lower(), False)):
            node, i = self.root, at
            while i < len(text) and letters[i] in node:
                node = node[letters[i]]
                i += 1
                for meaning, alone in node.get("", ()):
                    if alone == single and (i - at == 1) == single:
                        yield i, meaning


def _tries() -> Trie:
    trie = Trie()
    for code, words in CURRENCY.items():
        for w in words:
            trie.add(w, "currency", code)
    for factor, words in SCALE.items():
        for w in words:
            trie.add(w, "scale", factor)
    for n, words in COUNT.items():
        for w in words:
            trie.add(w, "count", n)
    for w in LINK:
        trie.add(w, "link", 0)
    return trie


TRIE = _tries()


@lru_cache(maxsize=1 << 16)
def segment(unit: str, field: str) -> tuple[str | None, float, float | None]:
    """(currency, scale, basis) of a unit string, in which # is the figure; None is what it leaves open."""
    prior = PRIOR[field]
    # state: currency, scale, basis, an open link (1.0: bare, else its exponent), whether the figure has passed
    best: list[dict[tuple, float]] = [{} for _ in range(len(unit) + 1)]
    best[0] = {(None, 1.0, None, None, False): 0.0}

    def put(at: int, state: tuple, score: float) -> None:
        if score > best[at].get(state, -math.inf):
            best[at][state] = score

    for i in range(len(unit)):
        for (currency, scale, basis, link, passed), score in best[i].items():
            c = unit[i]
            whole = not (i and unit[i - 1].isalpha() and c.isalpha())
            if c in "   ":
                put(i + 1, (currency, scale, basis, link, passed), score)
            if c == "#":
                put(i + 1, (currency, scale, basis, link, True), score)
                continue
            if c.isdigit():  # an exponent: how many pieces, behind a link
                j = i
                while j < len(unit) and unit[j].isdigit():
                    j += 1
                if link == 1.0 and basis is None:
                    put(j, (currency, scale, float(unit[i:j]), float(unit[i:j]), passed), score + prior["basis"])
            for end, (kind, value) in TRIE.match(unit, i):
                if not whole and kind != "currency":
                    continue
                if end < len(unit) and unit[end - 1].isalpha() and unit[end].isalpha() and kind != "scale":
                    continue
                if kind == "currency" and currency is None and link is None:
                    put(end, (value, scale, basis, link, passed), score + prior["currency"] - (1.0 if value == "USC" and unit[i:end] == "c" and not passed else 0.0))
                if kind == "scale" and scale == 1.0 and link is None:
                    put(end, (currency, value, basis, link, passed), score + prior["scale"])
                if kind == "scale" and link is not None and basis is not None and link == basis and unit[i:end] in ("k", "K"):
                    put(end, (currency, scale, basis * value, basis * value, passed), score)
                if kind == "link" and link is None:
                    put(end, (currency, scale, basis, 1.0, passed), score)
                if kind == "count" and passed:
                    if link == 1.0 and basis is None:
                        put(end, (currency, scale, value, 0.0, passed), score + prior["basis"])
                    elif link is not None and link == basis and value == 1.0:
                        put(end, (currency, scale, basis, 0.0, passed), score)
                    elif link is None and basis is None and value in ALONE:
                        put(end, (currency, scale, value, 0.0, passed), score + prior["basis"] - 1.0)
            put(i + 1, (currency, scale, basis, link, passed), score - 6.0)  # an unknown character
    end = best[len(unit)]
    currency, scale, basis, _, _ = max(end, key=lambda s: (end[s], s[0] is not None, s[2] is not None))
    if scale != 1.0 and currency is None:
        currency = "USD" if "#k" in unit.lower() else None
    return currency, scale, basis


FIGURE = "-?[0-9](?:[0-9.,']|[\u00a0\u202f][0-9])*"
AROUND = "[\\s\u00a0\u202f]*"
#: A table of money units has a row for each unit of the world at most.
MOST_UNITS = 10_000


def figures(raw: pa.Array, marks: pa.Array) -> pa.Array:
    """The numbers of figures: the last of two kinds of marks is the decimal mark; a single mark is, unless it stands
    before three digits and is not the feed's; several marks of one kind part thousands."""
    raw = pc.replace_substring_regex(pc.replace_substring_regex(raw, r"[.,']+$", ""), "['\u00a0\u202f]", "")
    dots, commas = pc.count_substring(raw, "."), pc.count_substring(raw, ",")
    one = pc.equal(pc.add(dots, commas), 1)
    both = pc.and_(pc.greater(dots, 0), pc.greater(commas, 0))
    point = pc.if_else(both, pc.match_substring_regex(raw, r"\.[^.,]*$"), pc.greater(dots, 0))
    own = pc.equal(pc.if_else(point, ".", ","), pc.coalesce(marks, pa.scalar(".")))
    decimal = pc.or_(both, pc.and_(one, pc.or_(own, pc.invert(pc.match_substring_regex(raw, r"[.,][0-9]{3}$")))))
    bare = pc.replace_substring_regex(raw, "[.,]", "")
    plain = pc.if_else(decimal, pc.if_else(point, pc.replace_substring(raw, ",", ""), pc.replace_substring(pc.replace_substring(raw, ".", ""), ",", ".")), bare)
    return pc.cast(pc.if_else(pc.match_substring_regex(plain, r"^-?[0-9]+(?:\.[0-9]*)?$"), plain, None), pa.float64())


def amounts_of(texts: pa.Array, marks: pa.Array, field: str) -> tuple[pa.Array, list, list, list]:
    """(figures, currencies, scales, bases) as texts state them; no figure, no amount. Each distinct text around a figure is
    segmented once."""
    raw = pc.struct_field(pc.extract_regex(texts, f"(?P<f>{FIGURE})"), "f")
    value = figures(raw, marks)
    unit = pc.replace_substring_regex(pc.replace_substring_regex(texts, FIGURE, "#", max_replacements=1), f"{AROUND}#{AROUND}", "#", max_replacements=1)
    unit = pc.if_else(pc.is_valid(value), unit, None).dictionary_encode()
    known = [segment(u.strip(), field) for u in unit.dictionary.to_pylist()]
    none = (None, 1.0, None)
    columns = zip(*(known[k] if k is not None else none for k in unit.indices.to_pylist())) if len(unit) else ((), (), ())
    return value, *(list(c) for c in columns)


AMOUNTS = "n double, p_figure double, p_currency string, p_scale double, stated double, t_figure double, t_currency string, t_scale double, said double"


AMOUNT_TYPE = T.StructType([T.StructField(f.split()[0], T.StringType() if f.endswith("string") else T.DoubleType()) for f in AMOUNTS.split(", ")])


@F.pandas_udf(AMOUNT_TYPE)
def amounts(quantity: pd.Series, price: pd.Series, total: pd.Series, said: pd.Series, mark: pd.Series) -> pd.DataFrame:
    marks = pa.array(mark, pa.string(), from_pandas=True)
    n, p, t = (amounts_of(pa.array(x, pa.string(), from_pandas=True), marks, f) for x, f in ((quantity, TOTAL), (price, UNIT_PRICE), (total, TOTAL)))
    phrases = pd.factorize(said.where(said.notna(), ""))
    bases = np.array([segment("# " + s, UNIT_PRICE)[2] if s else None for s in phrases[1]], object)
    columns = [n[0].to_pandas(), p[0].to_pandas(), *p[1:], t[0].to_pandas(), t[1], t[2], bases[phrases[0]] if len(said) else []]
    table = pd.DataFrame(dict(zip((f.split()[0] for f in AMOUNTS.split(", ")), columns)))
    return table.astype({c: float for c in table.columns if not c.endswith("currency")})


def with_feed(rows: DataFrame, summary: DataFrame, feeds: DataFrame) -> DataFrame:
    """Adds mark and bare (the feed's unit of a bare figure) by doc_id."""
    feed = feeds.select(F.col("feed_id").alias("f"), F.col("decimal_mark").alias("mark"), F.col("amount_unit").alias("bare"))
    quotes = summary.select(F.col("doc_id").alias("d"), F.col("feed_id").alias("df")).join(feed, F.col("df") == F.col("f"), "left").drop("f", "df")
    return rows.join(quotes, F.col("doc_id") == F.col("d"), "left").drop("d")


def factors(money_units: DataFrame) -> tuple[dict[str, float], list[float]]:
    """(dollars in each currency, pieces of each basis) of the table of units, a row for each unit there is. A currency
    without a factor has no value; only the parts of the dollar itself are known without the table."""
    if (n := money_units.count()) > MOST_UNITS:
        raise ValueError(f"{n} units of money; more than {MOST_UNITS} are no table of units")
    rows = [r for r in money_units.collect() if r["unit_code"] and r["factor"]]
    currency = {r["unit_code"]: r["factor"] for r in rows if r["unit_kind"] == "currency"}
    return {"USD": 1.0, "USC": 0.01, "KUSD": 1000.0} | currency, sorted({r["factor"] for r in rows if r["unit_kind"] == "basis"} | {1.0, 2.0, 12.0, 100.0, 1000.0})


def in_dollars(prefix: str, worth: dict[str, float]) -> Column:
    """Dollars in the figure's unit: as its text says, else as its feed; null for a currency without a factor."""
    code = F.coalesce(F.col(f"{prefix}_currency"), F.col("bare"), F.lit("USD"))
    factor = F.create_map([F.lit(x) for kv in worth.items() for x in kv])[code]
    return F.when((F.col(f"{prefix}_scale") != 1) & F.col(f"{prefix}_currency").isNull(), F.col(f"{prefix}_scale")).otherwise(factor * F.col(f"{prefix}_scale"))


def priced(rows: DataFrame, price: str, total: str, summary: DataFrame, feeds: DataFrame, money_units: DataFrame, total_first: bool = False) -> DataFrame:
    """rows(doc_id, quantity, price, total, ...) with price_usd (a piece), price_case, total_usd and total_case. What could be
    a total in thousands or a price for a thousand is the total's if total_first, else the price's."""
    worth, bases = factors(money_units)
    df = with_feed(rows, summary, feeds)
    said = F.regexp_extract(F.translate("description", *LOOKS_LIKE), PHRASE, 1) if "description" in rows.columns else F.lit("")
    df = df.withColumn("a", amounts("quantity", F.col(price), F.col(total), said, "mark")).select("*", "a.*")
    df = once(df, "worth", F.struct(in_dollars("p", worth).alias("p"), in_dollars("t", worth).alias("t"))).withColumns({"p_factor": F.col("worth.p"), "t_factor": F.col("worth.t")})
    df = df.withColumns({f"{x}_case": F.coalesce(F.col(f"{x}_factor") != 1, F.lit(True)) for x in "pt"})
    df = df.withColumn("whole", F.col("n") * F.col("p_figure") * F.col("p_factor") / F.coalesce("stated", F.lit(1.0))).withColumn("sum", F.col("t_figure") * F.col("t_factor"))

    def close(divisor: float, times: float = 1.0) -> Column:
        # figures have two decimals: half a unit of each, and a little for exchange rates
        slack = 0.006 * (F.col("t_factor") * times + F.abs(F.col("n")) * F.col("p_factor") / divisor) + 0.0005 * F.abs(F.col("sum") * times)
        return F.abs(F.col("whole") / divisor - F.col("sum") * times) <= slack

    guess, other = F.lit(None).cast("double"), F.lit(None).cast("double")
    for b in sorted(bases, reverse=True):
        if b > 1:
            guess = F.when(close(b), F.lit(b)).otherwise(guess)
    for f in sorted(set(worth.values()) - {1.0}):
        if abs(f) < 1000:
            other = F.when(close(1.0, f), F.lit(f)).otherwise(other)
    known = F.coalesce((F.col("sum") != 0) & (F.col("whole") != 0), F.lit(False))
    df = once(df, "fit", F.struct(known.alias("known"), F.coalesce(close(1.0), F.lit(False)).alias("exact"), F.coalesce(close(1.0, 1000.0), F.lit(False)).alias("thousand"), guess.alias("guess"), other.alias("other")))
    told = F.col("t_currency").isNull() & (F.col("t_scale") == 1) & ~F.col("t_case")
    open_ = F.col("fit.known") & ~F.col("fit.exact")
    scaled = F.lit(False)
    if total_first:
        scaled = open_ & told & F.col("stated").isNull() & F.coalesce(F.col("fit.guess") == 1000, F.lit(False)) & F.col("fit.thousand")
    # a basis in the description holds unless the figures agree without it
    hidden = F.when(F.col("stated").isNull() & ~scaled, F.when(open_, F.coalesce("fit.guess", "said")).when(~F.col("fit.known"), F.col("said")))
    df = df.withColumn("hidden", hidden)
    df = df.withColumn("other", F.when(scaled, F.lit(1000.0)).when(open_ & told & F.col("hidden").isNull(), F.col("fit.other")))
    basis = F.coalesce("stated", "hidden", F.lit(1.0))
    has_p, has_t = F.col("p_figure").isNotNull(), F.col("t_figure").isNotNull()
    return df.withColumns(
        {
            "price_usd": F.col("p_figure") * F.col("p_factor") / basis,
            "price_case": has_p & (F.col("p_case") | (basis != 1)),
            "total_usd": F.col("t_figure") * F.col("t_factor") * F.coalesce("other", F.lit(1.0)),
            "total_case": has_t & (F.col("t_case") | F.col("other").isNotNull()),
        }
    )


def dollar_items(items: DataFrame, summary: DataFrame, feeds: DataFrame, money_units: DataFrame) -> DataFrame:
    """(item_id, unit_price_usd, cost_usd, unit_price_case, cost_case) for every item."""
    rows = items.select("item_id", "doc_id", "description", "quantity", "unit_price", "cost")
    df = priced(rows, "unit_price", "cost", summary, feeds, money_units)
    return df.select("item_id", F.round("price_usd", 6).alias("unit_price_usd"), F.round("total_usd", 6).alias("cost_usd"), F.col("price_case").alias("unit_price_case"), F.col("total_case").alias("cost_case"))


def dollar_groups(groups: DataFrame, summary: DataFrame, feeds: DataFrame, money_units: DataFrame) -> DataFrame:
    """(group_id, total_price_usd, total_price_case) for every group."""
    rows = groups.select("group_id", "doc_id", "quantity", "unit_price", "total_price")
    df = priced(rows, "unit_price", "total_price", summary, feeds, money_units, total_first=True)
    return df.select("group_id", F.round("total_usd", 6).alias("total_price_usd"), F.col("total_case").alias("total_price_case"))


def read_items(items: DataFrame, summary: DataFrame, feeds: DataFrame, money_units: DataFrame) -> DataFrame:
    """items with quantity as a whole number (fractions are null), unit_price in dollars a piece and cost in dollars, and
    unread: (field, text) of the filled fields that give no number."""
    rows = items.withColumns({f"{c}_text": F.col(c) for c in ("quantity", "unit_price", "cost")})
    df = priced(rows, "unit_price", "cost", summary, feeds, money_units)
    whole = F.when((F.col("n") >= 0) & (F.col("n") < 1e9) & (F.col("n") == F.floor("n")), F.col("n").cast("int"))
    df = df.withColumns({"quantity": whole, "unit_price": F.round("price_usd", 6), "cost": F.round("total_usd", 6)})
    missed = [F.when((F.trim(f"{c}_text") != "") & F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.col(f"{c}_text").alias("text"))) for c in ("quantity", "unit_price", "cost")]
    return df.select(*items.columns, F.filter(F.array(*missed), lambda x: x.isNotNull()).alias("unread"))


def foreign_amounts(items: DataFrame, groups: DataFrame, summary: DataFrame, feeds: DataFrame, money_units: DataFrame) -> DataFrame:
    """(record_type, record_id, field) of every figure that is not in US dollars (a piece)."""
    i = dollar_items(items, summary, feeds, money_units)
    fields = F.filter(F.array(F.when(F.col("unit_price_case"), F.lit("unit_price")), F.when(F.col("cost_case"), F.lit("cost"))), lambda x: x.isNotNull())
    i = i.select(F.lit("item").alias("record_type"), F.col("item_id").cast("long").alias("record_id"), F.explode(fields).alias("field"))
    g = dollar_groups(groups, summary, feeds, money_units).where("total_price_case")
    return i.unionByName(g.select(F.lit("group").alias("record_type"), F.col("group_id").cast("long").alias("record_id"), F.lit("total_price").alias("field")))
