"""Scalar functions for use in SQL texts; built-in expressions, so that they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "clean_description": ("t STRING", "STRING", r"trim(regexp_replace(regexp_replace(t, '[^\\p{L}\\p{M}\\p{N}\\s_:\\-]', ' '), '\\s+', ' '))"),
    "last_separator_number": (
        "x STRING",
        "DECIMAL(18,2)",
        r"cast(bround(try_cast(CASE WHEN contains(x, ',') AND contains(x, '.') AND locate(',', reverse(x)) < locate('.', reverse(x)) THEN translate(x, ',.', '.') WHEN contains(x, ',') AND NOT contains(x, '.') AND x RLIKE ',\\d{0,2}$' THEN translate(x, ',', '.') ELSE replace(x, ',') END AS DECIMAL(18,4)), 2) AS DECIMAL(18,2))",
    ),
    "count_figures": ("t STRING", "INT", r"size(regexp_extract_all(t, '-?\\d+(?:,\\d{3})*(?:\\.\\d{2})?', 0))"),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
