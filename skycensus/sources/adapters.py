"""The test tables as sky tables.  The SQL is the same for both engines; decimal literals have exponents so that both read doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = """SELECT o_orderkey AS source_id, concat('SRC', o_orderkey) AS source_name,
  (340e0 + (o_orderkey % 1000) * 4e-2) % 360e0 AS ra, 40e0 + floor(o_orderkey / 1000) * 4e-2 AS dec,
  5e-2 + (o_orderkey % 17) * 5e-2 AS isl_rms, concat('ID', o_custkey % 997) AS id_name FROM orders"""
COMPONENTS = f"""SELECT concat('SRC', l_orderkey) AS parent,
  (s.ra + (((l_partkey*37) % 201) - 100)/36e2 + 360e0) % 360e0 AS ra, s.dec + (((l_suppkey*53) % 201) - 100)/36e2 AS dec,
  l_extendedprice/5e4 AS peak, 6e0 + (l_partkey % 10) AS maj, 6e0 + (l_partkey % 4) AS min, ((l_suppkey*7) % 180)*1e0 AS pa
  FROM lineitem l JOIN ({SOURCES}) s ON s.source_id = l.l_orderkey"""
CATALOG = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice/1e3 AS total_flux,
  CASE WHEN l_partkey % 53 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 1e-2 + ((l_partkey*7919) % 2000)/2e3*119e-2 END AS z_best,
  l_returnflag = 'R' AS resolved, pow(1e1, 21e0 + (l_extendedprice % 7e2)/1e2) AS l_144,
  CASE WHEN l_suppkey % 29 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 12e0 + l_discount*4e1 END AS mag_w1,
  115e-1 + l_tax*3e1 AS mag_w2, 6e0 + l_quantity/8e0 AS mag_w3,
  CASE WHEN l_linenumber = 4 THEN CAST('NaN' AS DOUBLE) ELSE 1e-1 END AS magerr_w3,
  l_quantity*3e0 AS las, 5e-2 + l_tax AS isl_rms, l_extendedprice/2e3 AS peak_flux FROM lineitem"""
TRIALS = """SELECT event_id, event_type, value AS mock_flux, value*(5e-1 + ((event_id*7919) % 1000)/1e3) >= 15e-1 AS detectable FROM events"""
IMAGES = "SELECT vec_id AS idx, 8 AS h, 8 AS w, embedding AS image, label AS grp FROM embeddings"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _of(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, SOURCES, "orders")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, COMPONENTS, "orders", "lineitem")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, CATALOG, "lineitem")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, TRIALS, "events")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, IMAGES, "embeddings")


#: The same as common table expressions for the SQL side.
WITH = f"WITH RECURSIVE sky_sources AS ({SOURCES}), sky_components AS ({COMPONENTS}), catalog AS ({CATALOG}), trials AS ({TRIALS}), images AS ({IMAGES}) "
