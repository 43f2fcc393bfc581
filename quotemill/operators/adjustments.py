"""Summary lines of a document (subtotal, tax, shipping, discount, total) and the ordered fold that applies them.

Amounts are whole hundredths inside, so that no rounding hides: percentages are taken of the running total, half up.
They are wide decimals, for a figure of a document may be of any length; a total beyond 38 digits is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill import patterns as P
from quotemill.operators.numbers import last_separator_number

WIDE = "decimal(38,0)"


def extract(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, value): the first pattern that fits each line; percentages as they stand."""
    low = F.lower(F.trim("line"))
    found = F.lit(None).cast("struct<kind:string,raw:string>")
    for kind, pattern in reversed(P.ADJUSTMENTS):
        found = F.when(low.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(low, pattern, 1).alias("raw"))).otherwise(found)
    t = lines.withColumn("f", found).where("f is not null")
    return t.select("doc_id", "line_no", "f.kind", last_separator_number(F.col("f.raw")).cast("double").alias("value"))


def priority(kind: Column) -> Column:
    return F.create_map([F.lit(x) for kv in P.PRIORITY.items() for x in kv])[kind]


def apply(adjustments: DataFrame, costs: DataFrame) -> DataFrame:
    """(doc_id, subtotal, final_total, n_applied, steps) for costs(doc_id, total_cost) and extract().

    In order of priority and line: a subtotal or total that differs replaces the running total, tax and shipping are
    added, a discount taken off. Documents without adjustments keep their cost.
    """
    whole = lambda c: F.round(c.cast("decimal(30,2)") * 100).cast(WIDE)
    row = F.struct(priority(F.col("kind")).alias("p"), "line_no", "kind", whole(F.col("value")).alias("v"))
    listed = adjustments.where(F.col("value").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    t = costs.select("doc_id", whole(F.col("total_cost")).alias("cost")).join(listed, "doc_id", "left")
    zero = F.struct(F.col("cost").alias("running"), F.expr("cast(array() as array<string>)").alias("steps"))

    def step(s: Column, r: Column) -> Column:
        run = s["running"]
        part = F.floor(F.try_divide(F.try_add(F.try_multiply(run, r["v"]), F.lit(5000)), F.lit(10000))).cast(WIDE)
        after = (
            F.when(r["kind"].isin("subtotal", "total"), r["v"])
            .when(r["kind"] == "tax_percentage", F.try_add(run, part))
            .when(r["kind"] == "discount_percentage", F.try_subtract(run, part))
            .when(r["kind"] == "discount_amount", F.try_subtract(run, r["v"]))
            .otherwise(F.try_add(run, r["v"]))
        ).cast(WIDE)
        return F.struct(after.alias("running"), F.concat(s["steps"], F.array(F.concat(r["kind"], F.lit(": "), F.coalesce(after.cast("string"), F.lit("?"))))).alias("steps"))

    t = t.withColumn("s", F.aggregate(F.coalesce("rows", F.expr(f"cast(array() as array<struct<p:int,line_no:int,kind:string,v:{WIDE}>>)")), zero, step))
    return t.select("doc_id", (F.col("cost").cast("double") / 100).alias("subtotal"), (F.col("s.running").cast("double") / 100).alias("final_total"), F.size("s.steps").alias("n_applied"), F.col("s.steps").alias("steps"))
