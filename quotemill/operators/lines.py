"""Documents as ordered lines, and operators over that order.

Null texts have no lines, an empty text has one empty line. Line ends may be LF, CR LF or CR. line_no counts from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill import patterns as P


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of docs(doc_id, text)."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(lines).alias("line_no", "line"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strip_cid(line: Column) -> Column:
    """A line without glyph numbers; lines of marks alone become empty."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"\bcid:\d+\s*", " "), r"\s+", " "))
    return F.when(F.contains(line, F.lit("cid:")), F.when(bare.rlike(r"^[:\s.,\-]+$"), "").otherwise(bare)).otherwise(line)


def mostly_cid(line: Column) -> Column:
    w = words(line)
    return (F.size(w) > 0) & (2 * F.size(F.filter(w, lambda x: F.contains(x, F.lit("cid:")))) > F.size(w))


def repair_digits(line: Column) -> Column:
    """Letters that stand for digits in words of digits, money and such letters alone."""
    fix = lambda w: F.when(w.rlike(r"^[$0-9.,\-OlI§S]+$"), F.translate(w, "OlIS§", "01155")).otherwise(w)
    return F.array_join(F.transform(words(line), fix), " ")


def repair_part_numbers(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"(\d+)_\s+(\d+-)", "$1_$2"), r"(\d+)\s+_(\d+-)", "$1_$2")


def clean_description(text: Column) -> Column:
    """Letters and digits of every script, `_`, `-` and `:`; other signs become one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, P.NOT_IN_DESCRIPTION, " "), r"\s+", " "))


def insert_quantity(line: Column) -> Column:
    """A line with a dollar sign and two equal figures gets the quantity 1 before the first, after a space or hyphen."""
    figures = F.regexp_extract_all(line, F.lit(r"[\d,]+\.?\d*"), 0)
    same = F.replace(F.try_element_at(figures, F.lit(1)), F.lit(",")).try_cast("double") == F.replace(F.try_element_at(figures, F.lit(2)), F.lit(",")).try_cast("double")
    at = F.position(F.try_element_at(figures, F.lit(1)), line)
    before = F.substr(line, at - 1, F.lit(1))
    go = (F.size(figures) == 2) & F.contains(line, F.lit("$")) & same & (at > 1) & before.isin(" ", "-")
    return F.when(F.coalesce(go, F.lit(False)), F.concat(F.substr(line, F.lit(1), at - 1), F.lit("1 "), F.substr(line, at))).otherwise(line)


def preprocess(lines: DataFrame) -> DataFrame:
    """Cleans glyph numbers and misread digits, line by line; lines of glyph numbers are dropped."""
    kept = lines.withColumn("line", F.trim("line")).where(~mostly_cid(F.col("line")) & (F.col("line") != ""))
    return kept.withColumn("line", strip_cid(F.col("line"))).withColumn("line", insert_quantity(repair_digits(F.col("line"))))


def merge_continuations(lines: DataFrame) -> DataFrame:
    """A row of three or more figures takes in the lines that continue it; blank lines end it and are dropped.

    The lines between one row and the next row, or blank line, form an island; within it only the unbroken run of
    continuations at its beginning is taken in.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    t = lines.withColumn("line", F.trim("line"))
    t = t.withColumn("figures", F.size(F.regexp_extract_all("line", F.lit(P.ROW_NUMBER), 0)))
    t = t.withColumn("row", (F.col("figures") >= 3) & (F.col("line") != ""))
    t = t.withColumn("goes_on", (F.col("line") != "") & (F.col("figures") <= 2) & F.lower("line").rlike(P.CONTINUATION))
    t = t.withColumn("break", (~F.col("goes_on")).cast("int"))
    t = t.withColumn("island", F.sum("break").over(order))
    head = F.first("row").over(Window.partitionBy("doc_id", "island").orderBy("line_no"))
    t = t.withColumn("headed", head)
    t = t.withColumn("start", F.when(F.col("headed"), F.min("line_no").over(Window.partitionBy("doc_id", "island"))).otherwise(F.col("line_no")))
    t = t.where(F.col("line") != "")
    merged = t.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"), F.max("headed").alias("headed"))
    text = F.array_join(F.transform("parts", lambda p: p["line"]), " ")
    return merged.select("doc_id", F.col("start").alias("line_no"), F.when(F.col("headed"), repair_part_numbers(text)).otherwise(text).alias("line"), F.size("parts").alias("n_lines"))


def data_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section, first_line, last_line, n_lines): runs of lines with prices; a run inside a document needs two lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    t = lines.withColumn("line", F.trim("line")).where("line <> ''").withColumn("priced", has_prices(F.col("line")))
    t = t.withColumn("island", F.sum((~F.col("priced")).cast("int")).over(order)).withColumn("last", F.max("line_no").over(Window.partitionBy("doc_id")))
    runs = t.where("priced").groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count(F.lit(1)).alias("n_lines"), F.max("last").alias("last"))
    runs = runs.where((F.col("n_lines") >= 2) | (F.col("last_line") == F.col("last")))
    return runs.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")).alias("section"), "first_line", "last_line", "n_lines")


NO_PRICES = ["total:", "subtotal:", "tax:", "shipping:", "discount:", "phone:", "email:", "address:", "thank you", "terms", "conditions", "payment", "due date", "valid until"]


def has_prices(line: Column) -> Column:
    """Two figures or more, and money, a figure with at most two decimals, or three figures beside a word for quantity."""
    low = F.lower(line)
    figures = F.regexp_extract_all(line, F.lit(r"[\d,]+\.?\d*"), 0)
    priced = line.rlike(r"[$€£¥]") | F.exists(figures, lambda x: x.rlike(r"\.\d{0,2}$"))
    return ~low.rlike("|".join(NO_PRICES)) & (F.size(figures) >= 2) & (priced | ((F.size(figures) >= 3) & low.rlike("|".join(P.QUANTITY_WORDS))))


def run_groups(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Numbers the runs of equal `key` in consecutive rows of one document."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    before = F.lag(key).over(w)
    new = F.when(F.row_number().over(w) == 1, 1).when(before.eqNullSafe(F.col(key)), 0).otherwise(1)
    return items.withColumn("new_run", new).withColumn("run", F.sum("new_run").over(w)).drop("new_run")


def merge_components(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, n_lines, text): consecutive lines that are parts of an item, joined."""
    part = F.col("line").rlike(r"€\s*\d") | F.col("line").rlike(r"^\d+$") | F.lower("line").rlike("machin|steel|plate|bracket|housing|assembly") | F.col("line").rlike(r"[A-Za-z]+\d|\d+[A-Za-z]")
    t = lines.withColumn("line", F.trim("line")).withColumn("part", part & (F.col("line") != ""))
    t = t.withColumn("island", F.sum((~F.col("part")).cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no"))).where("part")
    joined = t.groupBy("doc_id", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    return joined.select("doc_id", F.col("parts")[0]["line_no"].alias("first_line"), F.size("parts").alias("n_lines"), F.array_join(F.transform("parts", lambda p: p["line"]), " ").alias("text"))


def look_ahead(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, taken): an item line with fewer than three figures takes in the next one or two lines that
    hold its price; a line that was taken in stands no more on its own. One fold over each document's lines."""
    figures = F.size(F.regexp_extract_all("line", F.lit(P.NUMBER), 0))
    t = lines.withColumn("line", F.trim("line")).where("line <> ''")
    low = F.lower("line")
    price = F.contains("line", F.lit("$")) & F.col("line").rlike(r"\d") & (F.size(words(F.col("line"))) <= 4) & ~low.rlike("service|product|rogue|freight|total|subtotal|tax|discount")
    row = t.select("doc_id", F.struct("line_no", "line", figures.alias("figures"), price.alias("price"), looks_incomplete(F.col("line")).alias("open")).alias("row"))
    docs = row.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    zero = F.expr("cast(array() as array<struct<line_no:int,line:string,figures:int,open:boolean,taken:int>>)")

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        join = F.coalesce(last["open"] & (last["figures"] < 3) & (last["taken"] < 2) & r["price"], F.lit(False))
        both = F.struct(last["line_no"].alias("line_no"), F.concat_ws(" ", last["line"], r["line"]).alias("line"), (last["figures"] + r["figures"]).alias("figures"), last["open"].alias("open"), (last["taken"] + 1).alias("taken"))
        alone = F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"), r["figures"].alias("figures"), r["open"].alias("open"), F.lit(0).alias("taken"))
        return F.when(join, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(alone)))

    out = docs.select("doc_id", F.explode(F.aggregate("rows", zero, step)).alias("r"))
    return out.select("doc_id", "r.line_no", "r.line", "r.taken")


def looks_incomplete(line: Column) -> Column:
    return F.upper(line).rlike(r"[A-Z]+-\d+") | (F.lower(line).rlike("|".join(P.INCOMPLETE_WORDS)) & F.contains(line, F.lit("$")))


def candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, figures) of the lines that may hold an item."""
    figures = F.size(F.regexp_extract_all("line", F.lit(P.NUMBER), 0))
    t = lines.withColumn("line", F.trim("line")).where(~F.lower("line").rlike(P.SKIP_PATTERN)).withColumn("figures", figures)
    return t.where((F.col("figures") >= 2) | ((F.col("figures") == 1) & looks_incomplete(F.col("line"))))


def structure(lines: DataFrame) -> DataFrame:
    """(doc_id, figures, n_lines, first_line): the lines of a document by how many figures they hold."""
    t = lines.withColumn("figures", F.size(F.regexp_extract_all("line", F.lit(P.NUMBER), 0)))
    return t.groupBy("doc_id", "figures").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))


def columns(lines: DataFrame, top: int = 5, least: int = 3) -> DataFrame:
    """(doc_id, position, n_lines, place): where gaps of two or more blanks begin, the `top` commonest that occur `least` times."""
    from quotemill.operators.numbers import with_tokens

    spots = with_tokens(lines.where(F.col("line").rlike(r"\s{2,}")), "gaps", "line", r"\s{2,}").select("doc_id", "line_no", F.explode(F.transform("gaps", lambda g: g["start"])).alias("position"))
    counted = spots.groupBy("doc_id", "position").agg(F.count(F.lit(1)).alias("n_lines"), F.min(F.struct("line_no", "position")).alias("seen"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n_lines"), "seen")))
    return ranked.where((F.col("place") <= top) & (F.col("n_lines") >= least)).select("doc_id", "position", "n_lines", "place")


def regions(lines: DataFrame) -> DataFrame:
    """(doc_id, region, kind, start_line, end_line): a new region begins where the number of figures, capitals, marks or
    money differ from what has been gathered in the present one. One fold over each document's lines."""
    figures = F.size(F.regexp_extract_all("line", F.lit(NUMBER_ANY), 0))
    marks = F.when(F.length("line") > 0, (F.length("line") - F.length(F.regexp_replace("line", P.MARK, ""))) / F.length("line")).otherwise(0.0)
    caps = (F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line")) & (F.length("line") > 5)
    row = F.struct("line_no", figures.alias("figures"), caps.cast("int").alias("caps"), marks.alias("marks"), F.col("line").rlike(r"[$€£¥]").cast("int").alias("money"), F.size(words(F.col("line"))).alias("words"), F.contains("line", F.lit(":")).cast("int").alias("colon"))
    docs = lines.select("doc_id", row.alias("row")).groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    zero = F.expr("cast(array() as array<struct<kind:string,start_line:int,end_line:int,figures:int,caps:int,marks:double,money:int>>)")

    def kind(r: Column) -> Column:
        return F.when((r["caps"] == 1) & (r["words"] < 10), "header").when(((r["figures"] >= 2) & (r["money"] == 1)) | (r["figures"] >= 3), "line_items").when(r["money"] == 1, "totals").when(r["colon"] == 1, "metadata").otherwise("content")

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        new = F.coalesce((F.abs(r["figures"] - last["figures"]) > 2) | (r["caps"] != last["caps"]) | (F.abs(r["marks"] - last["marks"]) > 0.3) | ((r["money"] == 1) & (last["money"] == 0)), F.lit(True))
        fresh = F.struct(kind(r).alias("kind"), r["line_no"].alias("start_line"), r["line_no"].alias("end_line"), r["figures"].alias("figures"), r["caps"].alias("caps"), r["marks"].alias("marks"), r["money"].alias("money"))
        grown = F.struct(last["kind"].alias("kind"), last["start_line"].alias("start_line"), r["line_no"].alias("end_line"), (last["figures"] + r["figures"]).alias("figures"), (last["caps"] + r["caps"]).alias("caps"), (last["marks"] + r["marks"]).alias("marks"), (last["money"] + r["money"]).alias("money"))
        return F.when(new, F.concat(done, F.array(fresh))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)))

    out = docs.select("doc_id", F.posexplode(F.aggregate("rows", zero, step)).alias("region", "r"))
    return out.select("doc_id", "region", "r.kind", "r.start_line", "r.end_line")


NUMBER_ANY = r"-?\$?[\d,]+\.?\d*%?"
