"""Inputs that queries derive from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.sources import tables

PAGE_W, PAGE_H = 960.0, 540.0

# ---- SQL for the derived inputs

BOXES_SQL = """boxes AS (
  SELECT l_orderkey AS page_id, l_linenumber AS ord,
         CAST((min(l_partkey) * 37) % 700 AS DOUBLE) AS x, CAST((min(l_suppkey) * 53) % 400 AS DOUBLE) AS y,
         12 + max(l_quantity) * 8 AS w, 12 + max(l_discount) * 2400 AS h, min(concat(l_returnflag, l_linestatus)) AS fill
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

LINES_SQL = r"""raw AS (
  SELECT doc_id, unnest(range(1, len(a) + 1)) AS ord, trim(unnest(a)) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
), lines AS (
  SELECT doc_id, CAST(ord AS BIGINT) AS ord, text, CAST(10 + (length(text) % 3) * 2.5 AS DOUBLE) AS lft,
         CAST(ord * 14 + CASE WHEN ord % 7 = 0 THEN 9 ELSE 0 END AS DOUBLE) AS tp,
         CAST(CASE WHEN ord % 4 = 0 THEN 0 ELSE 12 END AS DOUBLE) AS lh,
         CASE WHEN ord = 1 THEN 'title' WHEN length(text) % 11 = 0 THEN 'subheading' ELSE 'body' END AS kind
  FROM raw WHERE text <> '')"""

NORMAL_SQL = r"trim(regexp_replace({c}, '[\s\p{{Z}}]+', ' ', 'g'))"

PLACE_SQL = """CASE WHEN w / 960 >= 0.95 AND h / 540 >= 0.95 THEN 'full'
  WHEN w / 960 >= 0.9 AND h / 540 <= 0.35 THEN CASE WHEN (y + h / 2) / 540 < 0.35 THEN 'band_top' WHEN (y + h / 2) / 540 > 0.65 THEN 'band_bottom' ELSE 'band_middle' END
  ELSE concat(CASE WHEN (y + h / 2) / 540 < 0.38 THEN 'top' WHEN (y + h / 2) / 540 > 0.62 THEN 'bottom' ELSE 'middle' END, '_',
              CASE WHEN (x + w / 2) / 960 < 0.38 THEN 'left' WHEN (x + w / 2) / 960 > 0.62 THEN 'right' ELSE 'center' END) END"""


def derived_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.boxes(tables.table(spark, sf_dir, "lineitem"))


def derived_lines(documents: DataFrame) -> DataFrame:
    return tables.lines(documents)
