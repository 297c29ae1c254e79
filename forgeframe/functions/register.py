"""The site's text functions as SQL functions, for queries and views that are written in SQL (§2.10).

Scalar functions are SQL functions of the session: their bodies are inlined, so Catalyst optimises through
them. Those that need Python are registered as Arrow-batched UDFs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, type and body of each SQL function.
FUNCTIONS = [
    ("site_short_sha", "sha STRING", "STRING", "substring(sha, 1, 10)"),
    ("site_ellipsis", "x STRING, n INT", "STRING", "CASE WHEN length(x) <= n THEN x ELSE concat(substring(x, 1, n), '...') END"),
    ("site_first_text", "a STRING, b STRING", "STRING", "CASE WHEN length(a) > 0 THEN a ELSE b END"),
    ("site_subtract", "a BIGINT, b BIGINT", "BIGINT", "a - b"),
    ("site_add", "a BIGINT, b BIGINT", "BIGINT", "a + b"),
    ("site_email_hash", "email STRING", "STRING", "md5(lower(trim(email)))"),
    ("site_escape_pound", "x STRING", "STRING", "replace(replace(replace(replace(x, '%', '%25'), '#', '%23'), ' ', '%20'), '?', '%3F')"),
    ("site_newline_to_br", "x STRING", "STRING", "replace(x, chr(10), '<br>')"),
    ("site_short_ref", "ref STRING", "STRING", "regexp_replace(ref, '^refs/(heads|tags)/', '')"),
    ("site_is_digits", "x STRING", "BOOLEAN", "x RLIKE '^[0-9]+$'"),
    ("site_percent", "part BIGINT, whole BIGINT", "BIGINT", "CASE WHEN whole > 0 THEN part * 100 div whole ELSE 0 END"),
    ("site_access_name", "mode INT", "STRING", "CASE mode WHEN 1 THEN 'read' WHEN 2 THEN 'write' WHEN 3 THEN 'admin' WHEN 4 THEN 'owner' ELSE 'none' END"),
]


def register(spark: SparkSession) -> list[str]:
    """Registers all functions in the session and returns their names; a second call replaces them."""
    from forgeframe.functions import html

    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    python = {"site_sanitise": html.udf(html.sanitised), "site_markdown": html.udf(html.markdown), "site_version_compare": html.udf(html.version_compare, "boolean")}
    for name, f in python.items():
        spark.udf.register(name, f)
    return [*(f[0] for f in FUNCTIONS), *python]
