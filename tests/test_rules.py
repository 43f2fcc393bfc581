import random
import time

from pyspark.sql import functions as F

from quotemill import patterns as P
from quotemill.operators import classify, cleanup, filters, lines, numbers, parsing, prices, scoring

LINE = "doc_id long, line_no int, line string"


def of(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], LINE)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_letters_of_every_script_stay(spark):
    for text in ("Träger", "Крон медный", "Façade", "ŻELIWNA PŁYTA"):
        assert one(spark, f"({text}) *", lines.clean_description) == text
        assert one(spark, text, classify.is_garbled) is False
    items = parsing.parse_quotes(spark.createDataFrame([(1, "Träger aus Stahl, weiß 10 €157,74 €1.577,40")], "doc_id long, text string"))
    assert items.first()["description"] == "Träger aus Stahl weiß"


def test_documented_lines(spark):
    text = "3 ESTOP_BODY-GEN2_4 6 $395.00 $2,370.00\nSteel Bracket 2x4 10 $25.00 $250.00\nblue rod 2 $3.00 $6.00 clear plastic"
    got = [tuple(r)[1:] for r in parsing.parse_quotes(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()]
    assert [r[2:] for r in got] == [(6, 395.0, 2370.0), (10, 25.0, 250.0), (2, 3.0, 6.0)]
    assert [r[1] for r in got] == ["3 ESTOP_BODY-GEN2_4", "Steel Bracket 2x4", "blue rod clear plastic"]


def test_addresses_and_contacts(spark):
    yes = ["123 Main Street", "Suite 400, San Jose", "Phone: 555-123-4567", "mail a.b@c.org", "Springfield, IL 62704", "Acme Industries 12"]
    no = ["steel rod 2 $3.00 $6.00", "Träger 10 5,00 50,00", "copper part 2 1.00 2.00", ""]
    got = {r[0]: r[1] for r in of(spark, yes + no).select("line", filters.is_address(F.col("line"))).collect()}
    assert [got[x] for x in yes] == [True] * len(yes) and [got[x] for x in no] == [False] * len(no)


def test_places_of_tokens_in_long_lines(spark):
    line = "é ".join(str(i * 7) for i in range(700))
    t = numbers.with_tokens(of(spark, [line, "", "none"]), "t", "line", r"\d+").select("line", "t").collect()
    assert all(r["line"][x["start"] :].startswith(x["raw"]) for r in t for x in r["t"]) and [len(r["t"]) for r in t] == [700, 0, 0]


def test_prices(spark):
    t = of(spark, ["price $1,234.56 each", "$5/lb", "@ $50.00", "7.50 per unit", "x", None])
    best = {r["line_no"]: (r["value"], r["confidence"]) for r in prices.price_tokens(t).where("confidence > 90").collect()}
    assert best[0] == (1234.56, 100)
    units = {r["line_no"]: (r["unit"], r["value"]) for r in prices.unit_prices(t).collect()}
    assert units[0][0] == "each" and units[1] == ("weight", 5.0) and units[3] == ("unit", 7.5) and 4 not in units
    for text, value in (("€2.311,25", 2311.25), ("1 234,56", 1234.56), ("$1,234.56", 1234.56), ("14 287.40", 14287.4), ("", 0.0)):
        assert float(one(spark, text, prices.locale_price)) == value
    code = lambda c: lambda t: prices.by_currency(t, F.lit(c))
    assert one(spark, "1.234,56", code("EUR")) == "1234.56" and one(spark, "1,234", code("JPY")) == "1234" and one(spark, "14 287.40", code("USD")) == "14287.40"


def test_items_by_pattern_and_by_robust_strategies(spark):
    t = of(spark, ["Gear rack 5 €12,50 €62,50", "Coating €290,75 €1.046,25", "Widget 3 $10.00 $30.00", "bolt 4 2.50 10.00", "widget $7/ea qty: 3", "price 4.00 qty 2 total 8.00 valve"])
    got = {r["line_no"]: (r["description"], r["quantity"], r["unit_price"], r["cost"]) for r in prices.structured_items(t).collect()}
    assert got == {0: ("Gear rack", 5, 12.5, 62.5), 1: ("Coating", 4, 290.75, 1046.25), 2: ("Widget", 3, 10.0, 30.0)}
    assert {r["line_no"]: r["pattern"] for r in prices.currency_items(t).collect()} == {0: "eur_standard", 1: "eur_no_qty", 2: "usd_standard"}
    assert [tuple(r)[1:] for r in prices.three_figures(t).collect()] == [(3, "bolt", 4.0, 2.5, 10.0)]
    robust = {r["line_no"]: (r["strategy"], r["quantity"], r["cost"]) for r in prices.robust_items(t).collect()}
    assert robust[3] == ("last_two", 4.0, 10.0) and robust[2][0] == "money" and robust[2][1:] == (3.0, 30.0)


def test_structured_items_of_long_lines_take_time_in_proportion(spark):
    text = "steel rod 12 " * 20_000
    began = time.monotonic()
    got = prices.structured_items(of(spark, [text + "€1,00 €12,00", text + "€1,00", "a $1.00 $2.00" + " " * 200_000 + "b"])).collect()
    assert time.monotonic() - began < 60 and [(r["line_no"], r["quantity"], r["cost"]) for r in got] == [(0, 12, 12.0)]


def test_structured_items_of_figures_of_any_length(spark):
    t = of(spark, ["Cover plate €12,06 €6000000000003,00", "Gear rack 500000000000 €0,73 €36,50", "Housing 500000000000 €0,01 €6000000000003,00", "Bushing 7 $1.00 $6000000000003.00", "Spacer €1,00 €2147483647,00", "Bracket €1,00 €2147483648,00", "Bolt 2 €1,00 €12345678901234567,00", "Widget 3 $10.00 $30.00"])
    got = {r["line_no"]: (r["description"], r["quantity"], r["unit_price"], r["cost"]) for r in prices.structured_items(t).collect()}
    assert got == {0: ("Cover plate", None, 12.06, 6000000000003.0), 1: ("Gear rack", 50, 0.73, 36.5), 2: ("Housing", None, 0.01, 6000000000003.0), 3: ("Bushing", 7, 1.0, 6000000000003.0), 4: ("Spacer", 2147483647, 1.0, 2147483647.0), 5: ("Bracket", None, 1.0, 2147483648.0), 7: ("Widget", 3, 10.0, 30.0)}


def test_structured_patterns_match_the_same(spark):
    r = random.Random(3)
    bits = ["a", "Gear", "-", "(", " ", "  ", "\t", "5", "12", "€1,00", "$2.50", " €1.234,56", "€", ".", ",", "/", "é", "1.5", " 3 €1,00 €2,00", "x 2 $1.00  $2.00", " €1,00 €1.000,00"]
    t = of(spark, ["".join(r.choices(bits, k=r.randint(1, 14))) for _ in range(5000)])
    found = lambda p: F.regexp_extract_all("line", F.lit(p), 0)
    for slow, fast in ((P.STRUCTURED, prices.STRUCTURED_AT), (P.STRUCTURED_NO_QUANTITY, prices.STRUCTURED_NO_QUANTITY_AT)):
        assert t.where(found(slow) != found(fast)).count() == 0 and t.where(F.size(found(slow)) > 0).count() > 500


def test_clean_lines_cleans_each_line_once(spark):
    texts = ["steel rod\x07 12 pcs Page 3 of 9 final", "see www.x.org/a bracket 12 €4", "paris (₽5) / rod", "Date: 2024 and so on", "a b c d e", "C:\\tmp\\x.pdf rod of steel.PDF", "ok", None]
    t = cleanup.clean_lines(of(spark, texts))
    assert [(r["line_no"], r["line"]) for r in t.orderBy("line_no").collect()] == [(0, "steel rod 12 pcs"), (1, "see bracket 12 €4"), (2, "paris (€5) rod"), (5, "rod of steel")]
    assert t._jdf.queryExecution().optimizedPlan().toString().count(P.PAGE_NOISE[1]) == 1


def test_cleaning(spark):
    assert one(spark, "plate json data and 3", cleanup.final_description) == "plate" and one(spark, "ab", cleanup.final_description) == "" and one(spark, None, cleanup.final_description) is None
    assert one(spark, "steel a_b_c rod", cleanup.uncorrupted) == "steel rod"
    docs = spark.createDataFrame([(1, "ok line<0a>***<41>\nInternal Error: x.y"), (2, None)], "doc_id long, text string")
    assert [r["line"] for r in cleanup.without_artifacts(docs).orderBy("line_no").collect()] == ["ok line", "y"]
    assert [r["text"] for r in cleanup.combined_items(of(spark, ["94105 Gear €1,00 €2,00 Rod €3,00 €6,00", "none"])).orderBy("line_no", "place").collect()] == ["Gear €1,00 €2,00", "Rod €3,00 €6,00", "none"]


def test_confidence_and_prices_of_items(spark):
    items = spark.createDataFrame([(1, "steel rod", 2, 3.0, 6.0), (1, "x", 1, 0.0, 5.0), (2, None, None, None, None)], "doc_id long, description string, quantity int, unit_price double, cost double")
    c = [F.col(x) for x in ("description", "quantity", "unit_price", "cost")]
    assert [r[0] for r in items.select(scoring.item_confidence(*c)).collect()] == [100, 50, 30]
    assert [r[0] for r in items.select(scoring.recomputed_price(*c[1:])).collect()] == [3.0, 5.0, None]
    stated = spark.createDataFrame([(1, 11.0), (3, None)], "doc_id long, stated_cost double")
    assert {tuple(r) for r in scoring.confidence(items, stated).collect()} == {(1, 2, 100), (3, 0, 30)}


def test_readings_of_pages(spark):
    from quotemill.sources import ocr

    pages = spark.createDataFrame([("a", "scan_6", 1, "x\ny"), ("a", "scan_4", 1, "rod 2 $3.00 $6.00"), ("a", "scan_6", 2, "cid:1 " * 11)], "path string, extractor string, page_no int, text string")
    best = {r["page_no"]: r for r in ocr.best_readings(pages, ["scan_6", "scan_4"]).collect()}
    assert best[1]["extractor"] == "scan_4" and best[2]["extractor"] == "scan_6"
    second = spark.createDataFrame([("a", "second_pass", 2, "valve 1 $2.00 $2.00")], pages.schema)
    after = {r["page_no"]: r["text"] for r in ocr.with_second_pass(ocr.best_readings(pages, ["scan_6", "scan_4"]), second).collect()}
    assert after[2] == "valve 1 $2.00 $2.00" and after[1] == "rod 2 $3.00 $6.00"
    assert ocr.text_and_tables(b"") == [] and ocr.text_and_spans(b"") == []


def test_templates_meet_by_word(spark):
    from quotemill.sources import documents

    docs = spark.createDataFrame([(1, "ACME Corp\nNo: 17"), (2, "other"), (3, None)], "doc_id long, text string")
    templates = spark.createDataFrame([("acme", "Acme Corp", "number", r"No: (\d+)"), ("none", "", "x", "y")], "issuer string, keyword string, field string, pattern string")
    assert [tuple(r) for r in documents.by_template(docs, templates).collect()] == [(1, "acme", "number", "17")]


def test_currencies_without_a_factor_have_no_amount(spark):
    from quotemill.operators import units

    items = spark.createDataFrame([(1, 1, "a", "2", "£12.00", "24.00 GBP"), (2, 1, "a", "2", "R$ 4,00", "8,00"), (3, 1, "a", "1", "€5.00", "5.00")], "item_id long, doc_id long, description string, quantity string, unit_price string, cost string")
    summary, feeds = spark.createDataFrame([(1, 1)], "doc_id long, feed_id int"), spark.createDataFrame([(1, ".", "USD")], "feed_id int, decimal_mark string, amount_unit string")
    money = spark.createDataFrame([("GBP", "currency", 1.25)], "unit_code string, unit_kind string, factor double")
    got = {r["item_id"]: tuple(r)[1:] for r in units.dollar_items(items, summary, feeds, money).collect()}
    assert got[1] == (15.0, 30.0, True, True) and got[2][0] is None and got[2][2] is True and got[3][:1] == (None,) and got[3][2] is True
