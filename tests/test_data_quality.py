import datetime

from quotemill.operators import units
from quotemill.sources import rejects

FEEDS = [(1, ",", "."), (2, ";", ",")]


def found(spark, raws):
    raw = spark.createDataFrame([(i, f, t, 0) for i, (f, t) in enumerate(raws)], "raw_id long, feed_id int, raw_text string, reason int")
    feeds = spark.createDataFrame(FEEDS, "feed_id int, delim string, decimal_mark string")
    return {r["raw_id"]: r["reason"] for r in rejects.rejected(raw, feeds).collect()}, rejects.valid_items(raw, feeds)


def test_reasons(spark):
    raws = [
        (1, '1,2,"a, ""b""\nc", 5 ,1.50,-7.5\r'), (1, "1,2,a,,,"), (1, '1,2,"a,5,1,1'), (1, '1,2, "a",5,1,1'), (1, "1,2,a,5,1"), (1, "1,2,a,5x,.5,1"), (1, "1,2,a,5,.5,x"), (1, "1,2,a,5,5,1.23456"),
        (2, "1;2;a;5;1,5;1.5"), (1, None), (1, ""), (9, "a,b"), (1, "1,2,a,٣,1,1"),
    ]
    reasons, valid = found(spark, raws)
    assert reasons == {2: "quoting", 3: "quoting", 4: "columns", 5: "quantity", 6: "unit_price", 7: "cost", 8: "cost", 9: "columns", 10: "columns", 11: "columns", 12: "quantity"}
    row = valid.where("raw_id = 0").first()
    assert (row["description"], float(row["quantity"]), float(row["cost"])) == ('a, "b"\nc', 5.0, -7.5)


def test_empty_table(spark):
    reasons, valid = found(spark, [(1, "1,2,a,1,1,1")])
    assert reasons == {} and valid.where("false").count() == 0


def test_unit_strings():
    s = lambda u, f="unit_price": units.segment(u, f)
    assert s("$#/1k pcs") == ("USD", 1.0, 1000.0) and s("#c") == ("USC", 1.0, None) and s("#/C") == (None, 1.0, 100.0)
    assert s("#tsd. USD") == ("USD", 1000.0, None) and s("#per thousand") == (None, 1.0, 1000.0) and s("#K", "total") == ("USD", 1000.0, None)
    assert s("#each") == (None, 1.0, 1.0) and s("#the pair") == (None, 1.0, 2.0) and s("#") == (None, 1.0, None)


def test_dollars(spark):
    items = spark.createDataFrame(
        [(1, 1, "a", "10", "$2.00", "20.00"), (2, 1, "a", "10", "200.00", "20.00"), (3, 1, "a, je Dutzend", None, "24.00", None), (4, 2, "a", "1", "5,00", "€5,00"), (5, 3, "a", "4", "", None), (6, 1, None, "x", "free", "12 ct")],
        "item_id long, doc_id long, description string, quantity string, unit_price string, cost string",
    )
    summary = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, feed_id int")
    feeds = spark.createDataFrame([(1, ".", "USD"), (2, ",", "EUR")], "feed_id int, decimal_mark string, amount_unit string")
    money = spark.createDataFrame([("EUR", "currency", 1.08), ("DZ", "basis", 12.0)], "unit_code string, unit_kind string, factor double")
    got = {r["item_id"]: tuple(r)[1:] for r in units.dollar_items(items, summary, feeds, money).collect()}
    assert got[1] == (2.0, 20.0, False, False) and got[2] == (2.0, 20.0, True, False) and got[3][0::2] == (2.0, True)
    assert got[4] == (5.4, 5.4, True, True) and got[5][2:] == (False, False) and got[6][1:] == (0.12, False, True)


def test_bare_total_of_a_group_in_thousands(spark):
    schema = "group_id long, doc_id long, quantity string, unit_price string, total_price string"
    groups = spark.createDataFrame([(1, 1, "500", "25.00", "12.50"), (2, 1, "500", "25.00", "12500.00"), (3, 1, "10", "24.00", "20.00"), (4, 1, "500", "25.00 per thousand", "12.50"), (5, 1, "5", "2.00", "1000.00")], schema)
    summary = spark.createDataFrame([(1, 1)], "doc_id long, feed_id int")
    feeds = spark.createDataFrame([(1, ".", "USD")], "feed_id int, decimal_mark string, amount_unit string")
    money = spark.createDataFrame([("KUSD", "currency", 1000.0)], "unit_code string, unit_kind string, factor double")
    got = {r["group_id"]: tuple(r)[1:] for r in units.dollar_groups(groups, summary, feeds, money).collect()}
    assert got == {1: (12500.0, True), 2: (12500.0, False), 3: (20.0, False), 4: (12.5, False), 5: (10.0, True)}


def test_items_are_read_in_every_way_of_writing(spark):
    items = spark.createDataFrame(
        [(1, 1, 0, "a", "500 pcs", "$5.86", "US$ 2,930.00"), (2, 1, 1, "a", "Qty 2", "9,48", "18.96"), (3, 2, 2, "a", "500.00", "13,91", "6.955,00 USD"), (4, 1, 3, "a", " 1", "1,108.50", "1,108.50"), (5, 1, 4, "a", "some", "", "on request"), (6, 1, 5, "a", "2.5", "2.00", "5.00"), (7, 9, 6, None, None, None, "-3")],
        "item_id long, doc_id long, line_no int, description string, quantity string, unit_price string, cost string",
    )
    summary = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, feed_id int")
    feeds = spark.createDataFrame([(1, ".", "USD"), (2, ",", "USD")], "feed_id int, decimal_mark string, amount_unit string")
    money = spark.createDataFrame([("EUR", "currency", 1.08)], "unit_code string, unit_kind string, factor double")
    got = {r["item_id"]: r for r in units.read_items(items, summary, feeds, money).collect()}
    assert [tuple(got[i][4:7]) for i in range(1, 8)] == [(500, 5.86, 2930.0), (2, 9.48, 18.96), (500, 13.91, 6955.0), (1, 1108.5, 1108.5), (None, None, None), (None, 2.0, 5.0), (None, None, -3.0)]
    assert {i: [tuple(u) for u in r["unread"]] for i, r in got.items() if r["unread"]} == {5: [("quantity", "some"), ("cost", "on request")], 6: [("quantity", "2.5")]}


def test_stream_counts_what_arrived(spark, tmp_path):
    from quotemill.streaming import ingest

    t = datetime.datetime(2024, 1, 4, 12)
    src = spark.createDataFrame([(1, "a", t), (2, "a", t), (3, "b", None)], "doc_id long, source string, received_at timestamp")
    src.write.parquet(f"{tmp_path}/in")
    stream = ingest.fresh(ingest.arriving(spark, f"{tmp_path}/in", src.schema).where("received_at is not null"), ["doc_id"], "received_at")
    ingest.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_extractors_skip_broken_files(spark):
    from quotemill.sources import documents

    files = spark.createDataFrame([("a.pdf", bytearray(b"page one\fpage two")), ("b.pdf", bytearray(b"\xff\xfe"))], "path string, content binary")
    pages = documents.extract(files, {"utf8": documents.utf8_pages, "broken": lambda b: 1 / 0})
    assert [tuple(r)[2:] for r in pages.orderBy("page_no").collect()] == [(1, "page one"), (2, "page two")]
    assert documents.first_long_enough(pages, ["broken", "utf8"]).first()["text"] == "page one\npage two"
