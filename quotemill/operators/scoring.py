"""Scores of rival results of one document, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def result_score(n_items: Column, total_cost: Column, n_adjustments: Column) -> Column:
    """0 to 100: base 10, 5 an item up to 50, a hundredth of the cost up to 20, 5 an adjustment, 10 for items with a cost."""
    n, cost, adj = F.coalesce(n_items, F.lit(0)), F.coalesce(total_cost.cast("double"), F.lit(0.0)), F.coalesce(n_adjustments, F.lit(0))
    return F.least(F.lit(10) + F.least(5 * n, F.lit(50)) + F.greatest(F.least(cost / 100, F.lit(20.0)), F.lit(0.0)) + 5 * adj + F.when((n > 0) & (cost > 0), 10).otherwise(0), F.lit(100.0))


def quality_score(items: DataFrame) -> DataFrame:
    """(doc_id, n_items, score) from items(doc_id, description, quantity, unit_price, cost as amounts or null): 20, 15 an item up
    to 75, 50 off for one item or none, 2.5 for each filled field, more for realistic amounts; 0 to 200."""
    filled = sum((F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1).otherwise(0) for c in ("description", "quantity", "unit_price", "cost")), F.lit(0))
    price = F.when(F.col("unit_price") > 50, 20).when(F.col("unit_price") > 10, 10).otherwise(0)
    d = items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(filled).alias("filled"), F.sum(price).alias("price"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total"), F.sum(F.when(F.contains(F.lower("description"), F.lit("cid:")), 50).otherwise(0)).alias("cid")
    )
    base = F.lit(20) + F.least(15 * F.col("n_items"), F.lit(75)) - F.when(F.col("n_items") <= 1, 50).otherwise(0) + 2.5 * F.col("filled")
    bonus = F.when(F.col("total") > 1000, 100).when(F.col("total") > 100, 50).otherwise(0) + F.col("price")
    score = F.greatest(base - F.col("cid"), F.lit(0.0)) + bonus - F.when(F.col("total") < 50, 50).otherwise(0)
    return d.select("doc_id", "n_items", F.least(score, F.lit(200.0)).alias("score"))


def best(results: DataFrame, score: str, accept: float | None = None, rank: str = "method_rank") -> DataFrame:
    """One row a document: the first result in rank order whose score reaches `accept`, else the highest score; ties by rank."""
    enough = F.col(score) >= accept if accept is not None else F.lit(False)
    w = Window.partitionBy("doc_id").orderBy(F.when(enough, 0).otherwise(1), F.when(enough, F.col(rank)), F.desc(score), rank)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def totals_agree(items: DataFrame, stated: DataFrame, slack: float = 1.0) -> DataFrame:
    """(doc_id, item_cost, stated_cost, agrees): whether the items of a document add up to its stated total."""
    sums = items.groupBy("doc_id").agg(F.sum("cost").alias("item_cost"))
    t = stated.join(sums, "doc_id", "left")
    return t.select("doc_id", F.coalesce("item_cost", F.lit(0.0)).alias("item_cost"), "stated_cost", (F.abs(F.coalesce("item_cost", F.lit(0.0)) - F.col("stated_cost")) <= slack).alias("agrees"))


def confidence(items: DataFrame, stated: DataFrame) -> DataFrame:
    """(doc_id, n_items, confidence) of every document of stated(doc_id, stated_cost): 40 for items, more for several, for a
    total of ordinary size, for items that add up to it, and 5 a description with letters up to 20; at most 100."""
    described = (F.length("description") > 3) & F.col("description").rlike("[A-Za-z]")
    sums = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("cost").alias("cost"), F.sum(F.when(described, 5).otherwise(0)).alias("described"))
    t = stated.join(sums, "doc_id", "left").withColumns({"n_items": F.coalesce("n_items", F.lit(0)), "described": F.coalesce("described", F.lit(0))})
    n = F.col("n_items")
    score = F.when(n > 0, 40).otherwise(0) + F.when(n > 1, 20).otherwise(0) + F.when(n > 3, 10).otherwise(0) + F.when(F.col("stated_cost").between(0.01, 1000000), 20).otherwise(0)
    score = score + F.when(F.abs(F.coalesce("cost", F.lit(0.0)) - F.coalesce("stated_cost", F.lit(0.0))) <= 1.0, 30).otherwise(0) + F.least(F.col("described"), F.lit(20))
    return t.select("doc_id", "n_items", F.least(score, F.lit(100)).cast("int").alias("confidence"))


def item_confidence(description: Column, quantity: Column, unit_price: Column, cost: Column) -> Column:
    """Hundredths: 50, more for figures that agree, a description with letters, and ordinary sizes; at most 100, and 30
    without all three numbers."""
    sums = F.when(F.abs(quantity * unit_price - cost) <= 0.0100001, 30).otherwise(0)
    size = F.when(unit_price.between(0.01, 100000) & quantity.between(0.1, 10000), 20).otherwise(0)
    text = F.when((F.length(description) > 5) & description.rlike(r"\p{L}"), 20).otherwise(0)
    return F.when(quantity.isNull() | unit_price.isNull() | cost.isNull(), 30).otherwise(F.least(50 + sums + size + text, F.lit(100)))


def recomputed_price(quantity: Column, unit_price: Column, cost: Column) -> Column:
    """cost / quantity where the stated price is missing, 0 or more than a cent off; else the stated one."""
    implied = F.when((quantity > 0) & (cost > 0), F.bround(cost / quantity, 2))
    far = unit_price.isNull() | (unit_price == 0) | (F.abs(unit_price - cost / F.when(quantity > 0, quantity)) > 0.01)
    return F.when(implied.isNotNull() & far, implied).otherwise(unit_price)


def term_weights(texts: DataFrame) -> DataFrame:
    """(item_id, term, tf, idf) of texts(item_id, description): how often a term stands in a text, and the logarithm of how
    rare it is over all of them. Terms are runs of two letters or digits and more, in small letters."""
    terms = texts.select("item_id", F.explode(F.regexp_extract_all(F.lower("description"), F.lit(r"[\p{L}\p{N}]{2,}"), 0)).alias("term"))
    tf = terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = texts.where(F.col("description").isNotNull()).count()
    return tf.join(df, "term").select("item_id", "term", "tf", F.round(F.log((total + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))
