"""The object tables, made from the driver's tables by one SQL text that Spark and DuckDB read alike.

All coordinates are multiples of 1/8, so that sums over them are exact in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from terraspan.functions.geometry import MapHeader

MAP = MapHeader(50, 40, 1000.0, 2000.0, 25.0, 20.0, 30.0, 1)

VIEWS = {
    "wells": """
SELECT concat('W', lpad(cast(u AS string), 5, '0')) AS well, seq, 1000e0 + 40e0 * (u % 15) + seq * (2e0 + u % 3) AS x,
  2000e0 + 30e0 * (u % 11) + seq * ((u % 5) - 2) * 1.5e0 AS y, 1500e0 + 2e0 * seq + 0.25e0 * (event_id % 4) AS z, 10e0 + 4e0 * seq AS md,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN u % 2 = 0 AND seq > 36 THEN 6 - cast(floor(seq / 12) AS int) ELSE cast(floor(seq / 12) AS int) END AS zone,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'error' THEN 4 ELSE cast((floor(seq / 5) + u) % 3 AS int) END AS facies, value AS poro
FROM (SELECT user_id AS u, event_id, event_type, value, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS int) AS seq FROM {events}) e
""",
    "nodes": """
SELECT cast(l_linenumber AS int) AS realisation, cast(l_partkey % 50 + 1 AS int) AS i, cast(l_suppkey % 40 + 1 AS int) AS j, avg(l_extendedprice) / 1013e0 AS value
FROM {lineitem} GROUP BY l_linenumber, l_partkey % 50, l_suppkey % 40
""",
    "depths": """
SELECT i, j, 1500e0 + 2e0 * i + 1.5e0 * j AS value FROM (SELECT DISTINCT cast(l_partkey % 50 + 1 AS int) AS i, cast(l_suppkey % 40 + 1 AS int) AS j FROM {lineitem} WHERE l_partkey % 50 + l_suppkey % 40 > 4) n
""",
    "cells": """
SELECT i, j, k, poro, perm, CASE WHEN k <= 2 THEN 1 WHEN k <= 5 THEN 2 ELSE 3 END AS zone, cast(CASE WHEN n % 7 = 0 THEN 0 ELSE 1 END AS int) AS actnum
FROM (SELECT cast(l_partkey % 20 + 1 AS int) AS i, cast(l_suppkey % 20 + 1 AS int) AS j, cast(l_linenumber AS int) AS k, avg(l_discount) / 1.0137e0 AS poro, avg(l_quantity) / 1.0137e0 AS perm, count(*) AS n
FROM {lineitem} GROUP BY l_partkey % 20, l_suppkey % 20, l_linenumber) c
""",
    "traces": """
SELECT cast(floor(vec_id / 25) + 1 AS int) AS i, cast(vec_id % 25 + 1 AS int) AS j, cast(CASE WHEN vec_id % 17 = 0 THEN 2 ELSE 1 END AS int) AS traceid, embedding AS amp FROM {embeddings}
""",
    "points": """
SELECT c_custkey AS pid, (37 * c_custkey) % 1000 + 0.5e0 AS x, (91 * c_custkey) % 1000 + 0.25e0 AS y, c_acctbal AS z, c_mktsegment AS attr FROM {customer}
""",
    "polygons": """
SELECT poly_id, cast(row_number() OVER (PARTITION BY poly_id ORDER BY n) - 1 AS int) AS seq, x, y, z FROM (VALUES
(0, 0, 100e0, 100e0, 10e0), (0, 1, 600e0, 150e0, 12e0), (0, 2, 500e0, 700e0, 14e0), (0, 3, 300e0, 400e0, 16e0), (0, 4, 100e0, 100e0, 10e0),
(1, 5, 400e0, 300e0, 20e0), (1, 6, 900e0, 350e0, 22e0), (1, 7, 850e0, 900e0, 24e0), (1, 8, 450e0, 800e0, 26e0), (1, 9, 400e0, 300e0, 20e0)) AS v(poly_id, n, x, y, z)
""",
    "fence": """
SELECT poly_id, n AS seq, x, y, z FROM (VALUES (0, 0, 1100e0, 2200e0, 0e0), (0, 1, 1400e0, 2600e0, 3e0), (0, 2, 1700e0, 2700e0, 5e0), (1, 0, 900e0, 2500e0, 1e0), (1, 1, 1300e0, 2500e0, 1e0)) AS v(poly_id, n, x, y, z)
""",
    "vertices": """
SELECT p_partkey - 1 AS vid, cast((p_partkey - 1) % 50 AS double) AS x, cast(floor((p_partkey - 1) / 50) AS double) AS y, p_retailprice / 100e0 AS z FROM {part}
""",
    "triangles": """
SELECT p_partkey AS tid, p_partkey - 1 AS v0, p_partkey AS v1, p_partkey + 49 AS v2 FROM {part} WHERE p_partkey % 50 <> 0 AND p_partkey + 50 <= (SELECT max(p_partkey) FROM {part})
""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame."""
    text = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it uses as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql.strip()
    text = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in used)
    sql = sql.strip()
    return f"WITH {text}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {text} {sql}"
