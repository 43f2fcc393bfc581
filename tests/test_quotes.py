import itertools
import random

from pyspark.sql import functions as F

from quotemill.operators import adjustments, classify, currency, descriptions, grouping, lines, numbers, parsing, scoring

DOC = "doc_id long, text string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines_of_all_line_ends_null_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None)], DOC)
    assert rows(lines.lines_of(docs)) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, ""), (2, 0, "")]


def test_number_formats(spark):
    df = spark.createDataFrame([("2.311,25",), ("1,234.56",), ("123,45",), ("",), ("1.2.3",), (None,)], "x string")
    got = [tuple(None if v is None else float(v) for v in r) for r in df.select(numbers.us_number(F.col("x")), numbers.european_number(F.col("x")), numbers.last_separator_number(F.col("x"))).collect()]
    assert got == [(2311.25, 2311.25, 2311.25), (1234.56, 1234.56, 1234.56), (12345.0, 123.45, 123.45), (0.0, None, None), (0.0, None, None), (0.0, None, None)]


def test_items_prefer_exact_windows_and_keep_part_numbers(spark):
    docs = spark.createDataFrame([(1, "blue bolt MEDIUM PN1616 23 $2974.93 $68423.39\nno figures\nTotal: $5 5 25"), (2, None)], DOC)
    assert rows(parsing.parse_quotes(docs)) == [(1, 0, "blue bolt MEDIUM PN1616", 23, 2974.93, 68423.39)]
    euro = spark.createDataFrame([(3, "Träger 10 €157,74 €1.577,40")], DOC)
    assert [r[3:] for r in rows(parsing.parse_quotes(euro))] == [(10, 157.74, 1577.4)]


def test_items_of_other_orders_pairs_and_discounts(spark):
    text = [
        "100 Low profile bushing 55x230 mm $3.01 $301.00", "Bracket 12.50 4 50.00", "Bracket $12.50 $50.00", "Setup €25,00 €25,00", "Plate 3 $2.00 $5.30", "Volume rebate 2 $-5.00", "Loyalty credit -$12.00 -$12.00",
        "Rebate 2 -$5.00 -$10.00", "Quotation QM-388079 from Ubrico - 2024-09-17", "Tax 8.25 12.50", "Tel 000 0142", "a 305400000000000 99999 99 23",
    ]
    got = {r[1]: tuple(r[2:]) for r in rows(parsing.parse_quotes(spark.createDataFrame([(1, "\n".join(text))], DOC)))}
    assert got == {
        0: ("Low profile bushing 55x230 mm", 100, 3.01, 301.0), 1: ("Bracket", 4, 12.5, 50.0), 2: ("Bracket", 4, 12.5, 50.0), 3: ("Setup", 1, 25.0, 25.0), 4: ("Plate", 3, 2.0, 5.3),
        5: ("Volume rebate", 2, -5.0, -10.0), 6: ("Loyalty credit -", 1, -12.0, -12.0), 7: ("Rebate", 2, -5.0, -10.0),
    }


def test_first_triple_of_lines_of_any_length(spark):
    def brute(c):
        for t in itertools.combinations(c, 3):
            for q, p, total in itertools.permutations(t):
                if 10 <= q <= 1000000 and p > 0 and total > 0 and 10 * abs(q * p - 100 * total) <= 100 * total:
                    return q, p, total

    draw = random.Random(5)
    for n in [3, 5, 12, 13, 21, 40] * 30:
        c = [draw.choice([0, 100, draw.randrange(10**4), draw.randrange(10**6, 10**9)]) for _ in range(n)]
        assert parsing.first_triple(c) == brute(c)
    primes = "9000017 9100009 9200003 9300017 9400019 9500021 9600013 9700013 9800009 9900013 " * 2
    lines_ = [(1, 0, primes + "bolt 7 3.00 21.00"), (1, 1, primes), (1, 2, "1 " + "9" * 30 + " x " + "9" * 30), (1, 3, "a 2 3"), (1, 4, None)]
    got = rows(parsing.permutation_match(spark.createDataFrame(lines_, "doc_id long, line_no int, line string")))
    assert got == [(1, 0, 7.0, 3.0, 21.0), (1, 2, 1.0, 1e30, 1e30)]


def test_merge_takes_in_continuations_only_after_a_row(spark):
    text = "bracket 2 $3.00 $6.00\nmachine and de-burr\n\nmaterial\nplate 1 $2.00 $2.00"
    got = rows(lines.merge_continuations(lines.lines_of(spark.createDataFrame([(1, text)], DOC))))
    assert got == [(1, 0, "bracket 2 $3.00 $6.00 machine and de-burr", 2), (1, 3, "material", 1), (1, 4, "plate 1 $2.00 $2.00", 1)]


def test_digit_repair_and_cid(spark):
    df = spark.createDataFrame([("$1O.OO Olive l2",), ("cid:12 cid:3 x",), ("",)], "line string")
    assert [tuple(r) for r in df.select(lines.repair_digits(F.col("line")), lines.strip_cid(F.col("line")), lines.mostly_cid(F.col("line"))).collect()] == [("$10.00 Olive 12", "$1O.OO Olive l2", False), ("cid:12 cid:3 x", "x", True), ("", "", False)]


def test_insert_quantity(spark):
    df = spark.createDataFrame([("Setup $25.00 $25.00",), ("Setup 25.00 $25.00",), ("a $1 $2",)], "line string")
    assert [r[0] for r in df.select(lines.insert_quantity(F.col("line"))).collect()] == ["Setup $25.00 $25.00", "Setup 1 25.00 $25.00", "a $1 $2"]


def test_look_ahead_consumes_price_lines_once(spark):
    text = "ROGUE-345\n$4.00\n3 $12\n$9"
    got = rows(lines.look_ahead(lines.lines_of(spark.createDataFrame([(1, text)], DOC))))
    assert got[0][2] == "ROGUE-345 $4.00 3 $12" and len(got) == 2


def test_adjustments_fold_in_order_of_priority(spark):
    text = "Total: $130.00\nTax: 10%\nSubtotal: $100.00\nShipping: $5\nDiscount: $3"
    adj = adjustments.extract(lines.lines_of(spark.createDataFrame([(1, text)], DOC)))
    costs = spark.createDataFrame([(1, 90.0), (2, 7.5)], "doc_id long, total_cost double")
    got = {r["doc_id"]: r for r in adjustments.apply(adj, costs).collect()}
    assert got[1]["steps"] == ["subtotal: 10000", "tax_percentage: 11000", "shipping: 11500", "discount_amount: 11200", "total: 13000"]
    assert (got[2]["subtotal"], got[2]["final_total"], got[2]["n_applied"]) == (7.5, 7.5, 0)


def test_totals_of_documents_with_figures_of_any_length(spark):
    texts = ["steel rod 2 $3.00 $6.00\nserial 123456789012345678 of 4", "steel rod 2 $3.00 $6.00\nSubtotal: 99999999999999\nTax: 10%", "part 99999 9223372036854775.00 -9223372036854775.00\nrod 2 $3.00 $6.00", "bolt 1 $20000000000000000.00 $20000000000000000.00"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["subtotal"], r["final_total"], r["n_applied"]) for r in parsing.final_totals(docs).collect()}
    assert got == {0: (6.0, 6.0, 0), 1: (6.0, 109999999999998.9, 2), 2: (-9223372036854770.0, -9223372036854770.0, 0), 3: (2e16, 2e16, 0)}
    adj = spark.createDataFrame([(1, 0, "tax_percentage", 1e13)], "doc_id long, line_no int, kind string, value double")
    costs = spark.createDataFrame([(1, 1e20)], "doc_id long, total_cost double")
    assert adjustments.apply(adj, costs).first()["n_applied"] == 1


def test_grouping_partitions_items(spark):
    items = spark.createDataFrame([(1, 0, "a", 2, 1.0, 2.0), (1, 1, "b", 2, 3.0, 6.0), (1, 2, "c", None, 5.0, 5.0)], "doc_id long, line_no int, description string, quantity int, unit_price double, cost double")
    assert rows(grouping.totals(grouping.by_quantity(items))) == [(1, 5, 9.0, 13.0, 2)]
    assert grouping.nested_groups(items).first()["groups"][0]["quantity"] == 1
    copies = items.unionByName(items.withColumn("line_no", F.lit(9)))
    assert grouping.without_exact_copies(copies, ["line_no"]).count() == 3


def test_near_copies(spark):
    items = spark.createDataFrame([(1, 0, 1, "steel bracket left", 10.0), (1, 1, 2, "steel bracket lefT", 10.05), (1, 2, 3, "steel bracket left", 20.0), (1, 3, 4, None, None)], "doc_id long, line_no int, item_id long, description string, unit_price double")
    assert [r[2] for r in rows(grouping.without_near_copies(items))] == [1, 3, 4]


def test_best_accepts_early(spark):
    r = spark.createDataFrame([(1, "a", 1, 75.0), (1, "b", 2, 99.0), (2, "a", 1, 10.0), (2, "b", 2, 20.0)], "doc_id long, method string, method_rank int, score double")
    assert [x[1] for x in rows(scoring.best(r, "score", 70))] == ["a", "b"]


def test_currency_and_words(spark):
    df = spark.createDataFrame([("€5 and $6",), ("none",), (None,)], "text string")
    assert [r[0] for r in df.select(currency.first_symbol(F.col("text"))).collect()] == ["USD", "USD", None]
    t = spark.createDataFrame([("pc plate qty",), (None,)], "t string").select(descriptions.expand(F.col("t"))).collect()
    assert [r[0] for r in t] == ["polycarbonate plating quantity", None]


def test_scores_are_bounded(spark):
    t = spark.createDataFrame([(1, 0, ""), (1, 1, "stainless valve service order freight discount PN123 5 pcs $4.00"), (1, 2, "https://x.y page date fax")], "doc_id long, line_no int, line string")
    assert [r["score"] for r in classify.item_score(classify.features(t)).orderBy("line_no").collect()] == [0, 100, 0]


def test_sql_functions(spark):
    from quotemill.functions.sql import register

    register(spark)
    assert tuple(spark.sql("SELECT last_separator_number('1.234,56'), clean_description('a (b)'), count_figures('1 and 2.50')").first()) == (__import__("decimal").Decimal("1234.56"), "a b", 2)
