"""Items to groups, groups to document totals, and copies of items out.

Items are rows (doc_id, line_no, description, quantity, unit_price, cost). Quantities that are no whole number count as 1.
First-seen order is line_no; ties are broken by the given order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole(quantity: Column) -> Column:
    """A quantity as a whole number; texts such as `12 pcs`, `2.5` or null are null."""
    return F.when(F.trim(quantity).rlike(r"^\d{1,9}$"), F.trim(quantity).try_cast("int"))


def by_quantity(items: DataFrame) -> DataFrame:
    """(doc_id, quantity, n_items, group_quantity, unit_price, total_price): the items of one quantity of a document; the
    group's quantity is that of all its items together."""
    g = items.groupBy("doc_id", "quantity").agg(F.count(F.lit(1)).alias("n_items"), F.sum("unit_price").alias("unit_price"), F.sum("cost").alias("total_price"))
    return g.withColumn("group_quantity", F.coalesce("quantity", F.lit(1)).cast("long") * F.col("n_items")).select("doc_id", "quantity", "n_items", "group_quantity", "unit_price", "total_price")


def totals(groups: DataFrame) -> DataFrame:
    """(doc_id, total_quantity, total_unit_price_sum, total_cost, number_of_groups) of by_quantity()."""
    return groups.groupBy("doc_id").agg(
        F.sum("group_quantity").alias("total_quantity"), F.sum("unit_price").alias("total_unit_price_sum"), F.sum("total_price").alias("total_cost"), F.count(F.lit(1)).alias("number_of_groups")
    )


def nested_groups(items: DataFrame) -> DataFrame:
    """(doc_id, groups): groups by quantity with their items in line order, groups by total quantity."""
    item = F.struct("line_no", "description", "quantity", "unit_price", "cost")
    g = items.groupBy("doc_id", "quantity").agg(F.array_sort(F.collect_list(item)).alias("line_items"), F.count(F.lit(1)).alias("n"), F.sum("unit_price").alias("unit_price"), F.sum("cost").alias("total_price"))
    g = g.withColumn("group", F.struct((F.coalesce("quantity", F.lit(1)) * F.col("n")).alias("quantity"), F.col("line_items")[0]["line_no"].alias("first_line"), "unit_price", "total_price", "line_items"))
    return g.groupBy("doc_id").agg(F.array_sort(F.collect_list("group")).alias("groups"))


def by_quantity_and_price(items: DataFrame) -> DataFrame:
    """(doc_id, quantity, unit_price, n_items, cost, place): groups in the order in which they are first seen."""
    g = items.groupBy("doc_id", "quantity", "unit_price").agg(F.count(F.lit(1)).alias("n_items"), F.sum("cost").alias("cost"), F.min("line_no").alias("first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "quantity", "unit_price"))
    return g.withColumn("place", place).drop("first")


def first_of_equals(items: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """The first row of each key of a document."""
    w = Window.partitionBy("doc_id", *keys).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_exact_copies(items: DataFrame, order: list) -> DataFrame:
    return first_of_equals(items, [F.lower(F.trim("description")), F.col("unit_price")], order)


def without_near_copies(items: DataFrame, likeness: float = 0.85, price: float = 0.01) -> DataFrame:
    """Items of a document that resemble no earlier kept item: descriptions at least `likeness` alike by edit distance,
    prices within `price`. A greedy fold over each document's items."""
    row = F.struct("line_no", "item_id", F.lower(F.trim(F.coalesce("description", F.lit("")))).alias("d"), F.col("unit_price").cast("double").alias("p"))
    docs = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    zero = F.expr("cast(array() as array<struct<line_no:int,item_id:bigint,d:string,p:double>>)")

    def alike(a: Column, b: Column) -> Column:
        longest = F.greatest(F.length(a["d"]), F.length(b["d"]))
        near = F.abs(a["p"] - b["p"]) <= price * F.greatest(F.abs(a["p"]), F.abs(b["p"]))
        return F.coalesce(near, F.lit(False)) & ((longest == 0) | (F.levenshtein(a["d"], b["d"]) < (1 - likeness) * longest))

    kept = F.aggregate("rows", zero, lambda done, r: F.when(F.exists(done, lambda k: alike(k, r)), done).otherwise(F.concat(done, F.array(r))))
    return docs.select("doc_id", F.explode(kept).alias("r")).select("doc_id", "r.line_no", "r.item_id")


NOISE_WORDS = ["page", "total", "subtotal", "invoice", "quote", "signature", "terms", "conditions", "http", "www", "css", "javascript"]


def without_noise(items: DataFrame) -> DataFrame:
    """Items whose description holds no noise word as a word and at least three letters."""
    noise = F.lower("description").rlike(r"\b(?:" + "|".join(NOISE_WORDS) + r")\b")
    return items.where(F.col("description").isNotNull() & ~noise & F.col("description").rlike(r"[A-Za-z]{3,}"))
