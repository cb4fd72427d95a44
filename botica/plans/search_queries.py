"""Product search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.operators import search as s
from botica.plans import bindings as b
from botica.plans.bindings import plain
from botica.plans.catalog_queries import CATALOG_SELECT

TERM, PATTERN, NAME = "red ring", "r_d%ring", "red widget ECONOMY X 28"


def search_name(spark: SparkSession, sf: str) -> DataFrame:
    return plain(s.search_name(b.catalog(spark, sf), "Red RING"))


def search_name_like(spark: SparkSession, sf: str) -> DataFrame:
    return plain(s.search_name(b.catalog(spark, sf), PATTERN, wildcards=True))


def search_substitutes(spark: SparkSession, sf: str) -> DataFrame:
    return plain(s.search_substitutes(b.catalog(spark, sf), TERM))


def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    return plain(s.search_batch(b.catalog(spark, sf), b.search_terms(spark, sf)))


def search_batch_all_substances(spark: SparkSession, sf: str) -> DataFrame:
    found = s.search_batch(
        b.catalog(spark, sf), b.search_terms(spark, sf), substance_pick="all", substance_match="equals"
    )
    return plain(found)


def substance_group(spark: SparkSession, sf: str) -> DataFrame:
    return plain(s.substance_group(b.catalog(spark, sf), b.search_terms(spark, sf)))


def lookup_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return plain(s.lookup_by_name(b.catalog(spark, sf), NAME))


def lookup_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The first product of every display name, and of names that no product has."""
    catalog = b.catalog(spark, sf)
    wanted = catalog.select("product_name").unionByName(
        catalog.select(F.upper("product_name").alias("product_name"))
    )
    return plain(s.lookup_batch(catalog, wanted))


def first_match(spark: SparkSession, sf: str) -> DataFrame:
    return plain(s.first_match(b.catalog(spark, sf), TERM))


def distinct_substance(spark: SparkSession, sf: str) -> DataFrame:
    return s.distinct_substances(b.catalog(spark, sf))


def product_names_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return s.product_names_sorted(b.catalog(spark, sf))


QUERIES = {
    "search_name": search_name,
    "search_name_like": search_name_like,
    "search_substitutes": search_substitutes,
    "search_batch": search_batch,
    "search_batch_all_substances": search_batch_all_substances,
    "substance_group": substance_group,
    "lookup_by_name": lookup_by_name,
    "lookup_batch": lookup_batch,
    "first_match": first_match,
    "distinct_substance": distinct_substance,
    "product_names_sorted": product_names_sorted,
}

# First matching product of every term, by name and id.
PICK_SQL = """
picked AS (
  SELECT term, substance_name FROM (
    SELECT t.term, c.substance_name,
           row_number() OVER (PARTITION BY t.term ORDER BY c.product_name, c.id) AS place
    FROM terms t JOIN catalog c ON contains(lower(c.product_name), t.term))
  WHERE place = 1)"""

_RANKED = """
  SELECT p.term, c.*, CASE WHEN contains(lower(c.product_name), p.term) THEN 0 ELSE 1 END AS match_rank
  FROM picked p JOIN catalog c
    ON contains(lower(c.product_name), p.term) OR contains(lower(c.substance_name), lower(p.substance_name))"""

_ROW = CATALOG_SELECT.replace("SELECT id", "SELECT term, match_rank, id")

ORACLE = {
    "search_name": f"WITH {b.CATALOG_SQL} {CATALOG_SELECT} catalog WHERE contains(lower(product_name), 'red ring')",
    "search_name_like": f"WITH {b.CATALOG_SQL} {CATALOG_SELECT} catalog WHERE lower(product_name) LIKE '%{PATTERN}%'",
    "search_substitutes": f"""WITH {b.CATALOG_SQL}, terms AS (SELECT '{TERM}' AS term), {PICK_SQL}
{_ROW} ({_RANKED})""",
    "search_batch": f"WITH {b.CATALOG_SQL}, {b.TERMS_SQL}, {PICK_SQL} {_ROW} ({_RANKED})",
    "search_batch_all_substances": f"""WITH {b.CATALOG_SQL}, {b.TERMS_SQL}, reached AS (
  SELECT DISTINCT t.term, c.substance_name FROM terms t JOIN catalog c ON contains(lower(c.product_name), t.term))
{_ROW} (
  SELECT r.term, c.*, CASE WHEN contains(lower(c.product_name), r.term) THEN 0 ELSE 1 END AS match_rank
  FROM reached r JOIN catalog c ON c.substance_name = r.substance_name)""",
    "substance_group": f"""WITH {b.CATALOG_SQL}, {b.TERMS_SQL}, {PICK_SQL}
{_ROW.replace("match_rank, ", "")} (
  SELECT p.term, c.*
  FROM picked p JOIN catalog c ON contains(lower(c.substance_name), lower(p.substance_name)))""",
    "lookup_by_name": f"WITH {b.CATALOG_SQL} {CATALOG_SELECT} catalog WHERE product_name = '{NAME}'",
    "lookup_batch": f"""WITH {b.CATALOG_SQL} {CATALOG_SELECT} (
  SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY id) AS place FROM catalog) WHERE place = 1""",
    "first_match": f"""WITH {b.CATALOG_SQL} {CATALOG_SELECT} catalog
WHERE contains(lower(product_name), '{TERM}') ORDER BY product_name, id LIMIT 1""",
    "distinct_substance": f"WITH {b.CATALOG_SQL} SELECT DISTINCT substance_name FROM catalog",
    "product_names_sorted": f"WITH {b.CATALOG_SQL} SELECT product_name, id FROM catalog ORDER BY product_name, id",
}
