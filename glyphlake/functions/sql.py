"""Scalar functions for use in SQL text, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "gl_token": ("s STRING", "STRING", "regexp_replace(lower(s), '[^a-z0-9]+', '')"),
    "gl_space": ("s STRING", "STRING", r"trim(regexp_replace(s, r'\s+', ' '))"),
    "gl_title": ("s STRING", "STRING", r"initcap(trim(regexp_replace(regexp_replace(s, '[-_]+', ' '), r'\s+', ' ')))"),
    "gl_stem": (
        "s STRING",
        "STRING",
        "lower(regexp_replace(regexp_replace(regexp_replace(s, '&', ' and '), '[^A-Za-z0-9]+', '-'), '^-+|-+$', ''))",
    ),
    "gl_url_format": (
        "u STRING",
        "STRING",
        "CASE WHEN lower(u) LIKE '%.woff2%' THEN 'woff2' WHEN lower(u) LIKE '%.woff%' THEN 'woff' WHEN lower(u) LIKE '%.otf%' THEN 'otf' ELSE 'ttf' END",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session; they inline into any query."""
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
