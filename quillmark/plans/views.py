"""The library's input tables derived from the supplied tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Prefix of a query: occurrences, persons, authority, corrections, remappings and the province order.
DERIVED = """WITH base AS (
  SELECT c_custkey, r_name AS provincie, p_name AS nm
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = c_custkey),
o AS (
  SELECT o_orderkey AS row_id, o_custkey, cast(o_orderdate AS date) AS date,
         year(o_orderdate) AS j, nm, provincie,
         lag(nm) OVER (PARTITION BY cast(o_orderdate AS date) ORDER BY o_orderkey) AS prev_nm
  FROM orders JOIN base ON o_custkey = c_custkey),
occurrences AS (
  SELECT row_id,
    CASE WHEN row_id % 97 = 0 THEN '-1' WHEN row_id % 101 = 0 THEN '-20'
         WHEN row_id % 211 = 0 THEN NULL ELSE cast(o_custkey AS string) END AS delegate_id,
    CASE WHEN row_id % 223 = 0 THEN NULL
         WHEN row_id % 23 = 0 THEN 'Lunae den ' || cast(j AS string)
         WHEN row_id % 17 = 0 AND prev_nm IS NOT NULL THEN nm || ' ' || prev_nm
         WHEN row_id % 13 = 0 THEN CASE row_id % 2 WHEN 0 THEN substr(nm, 1, 4) ELSE substr(nm, 5) END
         WHEN row_id % 11 = 0 THEN 'vau ' || nm
         WHEN row_id % 19 = 0 THEN replace(nm, 'e', 'c')
         ELSE nm END AS pattern,
    date, j, row_id AS offset_,
    CASE WHEN row_id % 29 = 0 THEN 'president' ELSE 'delegate' END AS class,
    CASE WHEN row_id % 31 = 0 THEN 'unknown' ELSE provincie END AS namens
  FROM o),
persons AS (
  SELECT cast(c_custkey AS string) AS delegate_id,
    CASE WHEN c_custkey % 50 = 0 THEN '' ELSE nm || ', C' || cast(c_custkey AS string) END AS fullname,
    nm AS pattern, provincie
  FROM base WHERE c_custkey % 40 <> 7),
authority AS (
  SELECT cast(c_custkey AS string) AS id_persoon, nm AS naam,
    CASE WHEN c_custkey % 3 = 0 THEN 1995 - 18 - c_custkey % 60 END AS geboortejaar,
    CASE WHEN c_custkey % 3 = 0 THEN 1995 + c_custkey % 20 END AS overlijden,
    CASE WHEN c_custkey % 3 = 1 THEN 1950 + c_custkey % 30 END AS hlife,
    1995 + c_custkey % 3 AS min_year, 2001 - c_custkey % 3 AS max_year
  FROM base),
corrections AS (
  SELECT row_id, 'staged' AS tier, 1 AS tier_rank, cast((o_custkey + 1) % 100 AS string) AS to_id
  FROM o WHERE row_id % 37 = 0
  UNION ALL
  SELECT row_id, 'approved', 2, cast((o_custkey + 2) % 100 AS string) FROM o WHERE row_id % 41 = 0
  UNION ALL
  SELECT row_id, 'active', 3, cast((o_custkey + 3) % 100 AS string) FROM o WHERE row_id % 43 = 0
  UNION ALL
  SELECT row_id + 100000000, 'staged', 1, '1' FROM o WHERE row_id % 503 = 0),
remappings AS (
  SELECT cast(c_custkey AS string) AS from_id, cast(c_custkey + 1 AS string) AS to_id
  FROM base WHERE c_custkey % 25 = 3),
province_order AS (
  SELECT r_name AS provincie, r_regionkey AS prov_rank FROM region)"""

SOURCES = ("region", "nation", "customer", "part", "orders")


def derived(spark: SparkSession, sf_dir: str, name: str, more: str = "") -> DataFrame:
    """One of the derived tables over the tables in ``sf_dir``; ``more`` has further ones."""
    for t in SOURCES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{DERIVED}{more} SELECT * FROM {name}")
