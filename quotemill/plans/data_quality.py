"""Queries of the general data-quality operators over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators import units
from quotemill.plans import money_sql
from quotemill.sources import rejects


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("quote_items", "quote_groups", "quote_summary", "feeds", "money_units")
    return units.foreign_amounts(*(table(spark, sf_dir, n) for n in names))


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.dollar_items(*(table(spark, sf_dir, n) for n in ("quote_items", "quote_summary", "feeds", "money_units")))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.dollar_groups(*(table(spark, sf_dir, n) for n in ("quote_groups", "quote_summary", "feeds", "money_units")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(table(spark, sf_dir, "quote_raw"), table(spark, sf_dir, "feeds"))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = rejects.valid_items(table(spark, sf_dir, "quote_raw"), table(spark, sf_dir, "feeds"))
    return loaded.withColumns({c: F.col(c).cast("double") for c in ("quantity", "unit_price", "cost")})


QUERIES = {"p3_found": p3_found, "p3_items": p3_items, "p3_groups": p3_groups, "p5_found": p5_found, "p5_loaded": p5_loaded}

_P5_FIELD = """(?:"(?:[^"]|"")*"|[^"' || d || ']*)"""
_P5_CTE = f"""
WITH r AS (
  SELECT raw_id, regexp_replace(coalesce(raw_text, ''), '\\r\\z', '') AS t, delim AS d0, CASE WHEN delim = '|' THEN '\\|' WHEN delim = chr(9) THEN '\\t' ELSE delim END AS d, CASE WHEN decimal_mark = '.' THEN '\\.' ELSE decimal_mark END AS m, decimal_mark
  FROM quote_raw LEFT JOIN feeds USING (feed_id)
), q AS (
  SELECT *, regexp_matches(t, '\\A{_P5_FIELD}(?:' || d || '{_P5_FIELD})*\\z', 's') AS quoted,
         regexp_extract_all(d0 || t, d || '({_P5_FIELD})', 1, 's') AS f
  FROM r
), v AS (
  SELECT raw_id, quoted, len(f) AS n, decimal_mark,
         list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f, m
  FROM q
), c AS (
  SELECT *, trim(f[4], ' ') AS q, trim(f[5], ' ') AS u, trim(f[6], ' ') AS k FROM v
), j AS (
  SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 6 THEN 'columns'
    WHEN NOT regexp_full_match(q, '[0-9]*') THEN 'quantity'
    WHEN NOT regexp_full_match(u, '(?:-?[0-9]+(?:' || m || '[0-9]{{1,4}})?)?') THEN 'unit_price'
    WHEN NOT regexp_full_match(k, '(?:-?[0-9]+(?:' || m || '[0-9]{{1,4}})?)?') THEN 'cost' END AS reason
  FROM c
)
"""
_GROUPS = money_sql.GROUPS
for _cte in ("m0", "m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8", "usd"):
    _GROUPS = re.sub(rf"\b{_cte}\b", f"g_{_cte}", _GROUPS)
ORACLE = {
    "p3_items": f"WITH {money_sql.ITEMS} SELECT item_id, price_usd AS unit_price_usd, total_usd AS cost_usd, price_case AS unit_price_case, total_case AS cost_case FROM usd",
    "p3_groups": f"WITH {money_sql.GROUPS} SELECT group_id, total_usd AS total_price_usd, total_case AS total_price_case FROM usd",
    "p3_found": f"""WITH {money_sql.ITEMS}, {_GROUPS} SELECT 'item' AS record_type, item_id AS record_id, 'unit_price' AS field FROM usd WHERE price_case UNION ALL
 SELECT 'item', item_id, 'cost' FROM usd WHERE total_case UNION ALL SELECT 'group', group_id, 'total_price' FROM g_usd WHERE total_case""",
    "p5_found": _P5_CTE + "SELECT raw_id, reason FROM j WHERE reason IS NOT NULL",
    "p5_loaded": _P5_CTE
    + """SELECT raw_id, CAST(trim(f[1], ' ') AS BIGINT) AS doc_id, CAST(trim(f[2], ' ') AS INTEGER) AS line_no, f[3] AS description,
      CAST(nullif(q, '') AS DOUBLE) AS quantity, CAST(replace(nullif(u, ''), decimal_mark, '.') AS DOUBLE) AS unit_price, CAST(replace(nullif(k, ''), decimal_mark, '.') AS DOUBLE) AS cost
      FROM j WHERE reason IS NULL""",
}
