"""Product search and same-substance alternatives, for one term or a table of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botica.functions.text import contains_ignoring_case, is_blank, like_ignoring_case
from botica.operators.containment import containment_pairs
from botica.workspace import new_folder

NAME_MATCH, SUBSTANCE_MATCH = 0, 1


def search_name(catalog: DataFrame, term: str, wildcards: bool = False) -> DataFrame:
    match = like_ignoring_case if wildcards else contains_ignoring_case
    return catalog.filter(match(F.col("product_name"), term))


def lookup_by_name(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.filter(F.col("product_name") == F.lit(name))


def lookup_batch(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """For every exact name the first product by id; unknown names give no row."""
    wanted = names.select("product_name").distinct()
    by_id = Window.partitionBy("product_name").orderBy("id")
    return (
        catalog.join(wanted, "product_name", "left_semi")
        .withColumn("_place", F.row_number().over(by_id))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def first_match(catalog: DataFrame, term: str) -> DataFrame:
    """The first matching product by name and id, or no row."""
    return search_name(catalog, term).orderBy("product_name", "id").limit(1)


def distinct_substances(products: DataFrame) -> DataFrame:
    return products.select("substance_name").distinct()


def product_names_sorted(catalog: DataFrame) -> DataFrame:
    """Ids break ties, so that a name held by many products is sorted in several tasks."""
    return catalog.select("product_name", "id").orderBy("product_name", "id")


def clean_terms(terms: DataFrame) -> DataFrame:
    """Distinct lower-case terms; blank ones search for nothing."""
    return terms.filter(~is_blank(F.col("term"))).select(F.lower("term").alias("term")).distinct()


def _stored(df: DataFrame, label: str) -> DataFrame:
    """A small intermediate result that several joins read, written once."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _spellings(catalog: DataFrame) -> DataFrame:
    """(_name, substance_name, _first): distinct lower-case names of each substance."""
    first = F.min(F.struct("product_name", "id", "substance_name")).alias("_first")
    return catalog.groupBy(F.lower("product_name").alias("_name"), "substance_name").agg(first)


def _name_hits(spelled: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, _name, _first): distinct matched names with their first product."""
    names = spelled.groupBy("_name").agg(F.min("_first").alias("_first"))
    return containment_pairs(clean_terms(terms), "term", names, "_name")


def _containing_substances(spelled: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_wanted, substance_name): the substances that contain a wanted text."""
    known = distinct_substances(spelled).filter(F.col("substance_name").isNotNull())
    needles = wanted.filter(F.col("_wanted") != "")
    found = containment_pairs(needles, "_wanted", known.withColumn("_known", F.lower("substance_name")), "_known")
    return found.select("_wanted", "substance_name")


def _matched_substances(
    spelled: DataFrame, hits: DataFrame, substance_pick: str, substance_match: str
) -> DataFrame:
    """(term, substance_name) for every substance a term leads to."""
    if substance_pick == "first":
        picked = (
            hits.groupBy("term")
            .agg(F.min("_first").alias("_first"))
            .select("term", F.col("_first.substance_name").alias("_substance"))
        )
    elif substance_pick == "all":
        per_name = spelled.select("_name", F.col("substance_name").alias("_substance"))
        picked = hits.select("term", "_name").join(per_name, "_name").select("term", "_substance").distinct()
    else:
        raise ValueError("substance_pick is 'first' or 'all'")

    if substance_match == "equals":
        return picked.filter(F.col("_substance").isNotNull()).withColumnRenamed("_substance", "substance_name")
    if substance_match != "contains":
        raise ValueError("substance_match is 'contains' or 'equals'")
    picked = picked.select("term", F.lower("_substance").alias("_wanted"))
    containing = _containing_substances(spelled, picked.select("_wanted").distinct())
    return picked.join(containing, "_wanted").select("term", "substance_name").distinct()


def search_batch(
    catalog: DataFrame,
    terms: DataFrame,
    substance_pick: str = "first",
    substance_match: str = "contains",
) -> DataFrame:
    """For every term: products whose name contains it, then the others of their substance.

    ``match_rank`` is 0 for a name match and 1 for an alternative. With
    ``substance_pick="first"`` the substance is that of the first matching
    product by name and id; with ``"all"`` every matching product's substance counts.
    Everything is settled on distinct spellings, which are stored; products are joined once.
    """
    spelled = _stored(_spellings(catalog), "spellings")
    hits = _stored(_name_hits(spelled, terms), "name-hits")
    substances = _stored(
        _matched_substances(spelled, hits, substance_pick, substance_match), "matched-substances"
    )
    names = spelled.select("_name", "substance_name")
    rank = F.when(F.contains("_name", F.col("term")), NAME_MATCH).otherwise(SUBSTANCE_MATCH)
    same_substance = names.join(substances, "substance_name").select(
        "term", "_name", "substance_name", rank.alias("match_rank")
    )
    other_substance = (
        hits.select("term", "_name")
        .join(names, "_name")
        .join(substances, ["term", "substance_name"], "left_anti")
        .select("term", "_name", "substance_name", F.lit(NAME_MATCH).alias("match_rank"))
    )
    found = same_substance.unionByName(other_substance).withColumnsRenamed(
        {"_name": "_found_name", "substance_name": "_found_substance"}
    )
    spelling = (F.lower("product_name") == F.col("_found_name")) & F.col("substance_name").eqNullSafe(
        F.col("_found_substance")
    )
    return catalog.join(found, spelling).select("term", *catalog.columns, "match_rank")


def search_substitutes(catalog: DataFrame, term: str) -> DataFrame:
    """One term's name matches followed by the other products of its substance.

    The first match's substance is a single value, so one filter finds both.
    A blank term finds nothing.
    """
    if not term.strip():
        return catalog.select(F.lit(term).alias("term"), "*", F.lit(NAME_MATCH).alias("match_rank")).limit(0)
    wanted = F.nullif(F.lower("substance_name"), F.lit(""))
    picked = first_match(catalog, term).select(wanted).scalar()
    name_match = contains_ignoring_case(F.col("product_name"), term)
    return (
        catalog.filter(name_match | F.contains(F.lower("substance_name"), picked))
        .withColumn("match_rank", F.when(name_match, NAME_MATCH).otherwise(SUBSTANCE_MATCH))
        .select(F.lit(term).alias("term"), *catalog.columns, "match_rank")
        .orderBy("match_rank", "product_name", "id")
    )


def substance_group(catalog: DataFrame, terms: DataFrame) -> DataFrame:
    """For every term the whole group of its substance, sorted by product name."""
    spelled = _stored(_spellings(catalog), "spellings")
    hits = _name_hits(spelled, terms)
    substances = _matched_substances(spelled, hits, "first", "contains")
    return catalog.join(substances, "substance_name").orderBy("term", "product_name", "id")
