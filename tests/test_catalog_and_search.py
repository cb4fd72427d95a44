from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from botica.operators import search as s
from botica.operators.catalog import catalog_view, dim_product
from botica.operators.containment import containment_pairs
from botica.schemas import DIM_PRODUCT_COLUMNS, PRICE_LIST_HEADERS
from tests.frames import money, products

ROWS = [
    ("1", "DEXAMETASONA;CLOTRIMAZOL", "BAYCUTEN", "10 MG", "26,78", "34,08"),
    ("2", "ABATACEPTE", "ORENCIA", "250 MG", "2074,76", "2357,68"),
    ("3", "ABATACEPTE", "ORENCIA", "125 MG", "6588,53", "7486,97*"),
    ("4", "abatacepte", "GENERICO", "50 MG", "10,00", "    -     "),
    ("5", "DEXAMETASONA", "DECADRON", "4 MG", "abc", "12,00"),
    ("6", "ABATACEPTE", "SEM APRESENTACAO", None, "1,00", "1,12"),
    ("7", None, "ORENCIA", "SACHE", "1,00", "1,12"),
    ("8", "OUTRA", "orencia plus", "1 MG", "1,00", "1,12"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return catalog_view(products(spark, ROWS)).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


def test_catalog_view(catalog):
    rows = {r["id"]: r for r in catalog.collect()}
    assert set(rows) == {"1", "2", "3", "4", "5", "7", "8"}
    assert rows["1"]["product_name"] == "BAYCUTEN 10 MG"
    assert rows["1"]["taxes_price"] == money("7.30")
    assert rows["3"]["taxes_price"] == money("898.44")
    assert rows["3"]["price_flag"] and not rows["1"]["price_flag"]
    assert rows["4"]["taxes_price"] is None and rows["5"]["unit_price"] is None
    assert rows["1"]["ean2"] is None and rows["1"]["ean3"] is None and rows["1"]["ean1"] == "x"


def test_dim_product_gives_every_row_its_key(spark):
    headers = list(PRICE_LIST_HEADERS.values())
    code = headers.index(PRICE_LIST_HEADERS["ggrem_code"])
    rows = [tuple("a" if i != code else c for i in range(len(headers))) for c in ("1", "2", "3")]
    frame = spark.createDataFrame(rows, headers)
    dim = dim_product(frame)
    assert dim.columns == DIM_PRODUCT_COLUMNS
    assert dim.select("id").distinct().count() == 3
    with pytest.raises(ValueError, match="TARJA"):
        dim_product(frame.drop("TARJA"))


def test_substitutes_rank_name_matches_first(catalog):
    found = s.search_substitutes(catalog, "Orencia").collect()
    assert [(r["id"], r["match_rank"]) for r in found] == [("3", 0), ("2", 0), ("7", 0), ("8", 0), ("4", 1)]


def test_nothing_found_is_empty(catalog):
    assert ids(s.search_substitutes(catalog, "zzz")) == []
    assert ids(s.search_substitutes(catalog, "  ")) == []
    assert ids(s.first_match(catalog, "zzz")) == []
    assert ids(s.search_substitutes(catalog, "o'r%_")) == []


def test_substance_lookup_is_contains(catalog):
    """A substance leads to the combinations that contain it, not the other way round."""
    assert ids(s.search_substitutes(catalog, "decadron")) == ["5", "1"]
    assert ids(s.search_substitutes(catalog, "baycuten")) == ["1"]


def test_wildcards_are_opt_in(catalog):
    assert ids(s.search_name(catalog, "or_ncia")) == []
    assert sorted(ids(s.search_name(catalog, "or_ncia", wildcards=True))) == ["2", "3", "7", "8"]


def test_lookups(catalog):
    assert ids(s.lookup_by_name(catalog, "ORENCIA 250 MG")) == ["2"]
    assert ids(s.lookup_by_name(catalog, "orencia 250 mg")) == []
    assert ids(s.first_match(catalog, "orencia")) == ["3"]


def test_lookup_batch(spark, catalog):
    twice = catalog.unionByName(catalog.withColumn("id", F.concat(F.lit("0"), "id")))
    names = spark.createDataFrame([("ORENCIA 250 MG",), ("ORENCIA 250 MG",), ("x",)], "product_name string")
    assert ids(s.lookup_batch(twice, names)) == ["02"]


def expected_batch(rows, terms, pick):
    """Search of every term by comparing it with every product."""
    found = set()
    for term in {t.lower() for t in terms if t.strip()}:
        hits = [r for r in rows if term in r["product_name"].lower()]
        hits.sort(key=lambda r: (r["product_name"], r["id"]))
        reached = hits[:1] if pick == "first" else hits
        wanted = {r["substance_name"].lower() for r in reached if r["substance_name"]}
        for row in rows:
            if row in hits:
                found.add((term, row["id"], 0))
            elif row["substance_name"] and any(w in row["substance_name"].lower() for w in wanted):
                found.add((term, row["id"], 1))
    return found


@pytest.mark.parametrize("pick", ["first", "all"])
def test_batch_equals_one_by_one(spark, catalog, pick):
    terms = ["ORENCIA", "orencia", "deca", "mg", "a", "zzz", "", "  ", "baycuten 10 mg", "%", "or"]
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    found = s.search_batch(catalog, frame, substance_pick=pick)
    got = [(r["term"], r["id"], r["match_rank"]) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected_batch(catalog.collect(), terms, pick)


def test_substance_group_is_sorted(spark, catalog):
    frame = spark.createDataFrame([("orencia",), ("decadron",)], "term string")
    got = [(r["term"], r["id"]) for r in s.substance_group(catalog, frame).collect()]
    assert got == [("decadron", "1"), ("decadron", "5"), ("orencia", "4"), ("orencia", "3"), ("orencia", "2")]


def test_containment_equals_brute_force(spark):
    letters = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product("ab", repeat=n)]
    texts = ["ação", "ab", "a", "", "bbbbb", "abab", "aab ba", "ba a", "çã", "aaaa"] + letters
    needles = spark.createDataFrame([(t,) for t in set(texts) if t] + [("ção",), ("zz",)], "n string")
    hay = spark.createDataFrame([(t,) for t in set(texts)], "h string")
    got = {(r["n"], r["h"]) for r in containment_pairs(needles, "n", hay, "h").collect()}
    wanted = {(n, h) for n in {*texts, "ção", "zz"} if n for h in texts if n in h}
    assert got == wanted


def test_batch_search_has_no_nested_loop(spark, catalog):
    terms = spark.createDataFrame([("orencia",)], "term string")
    for hint in (True, False):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB" if hint else "-1")
        try:
            plan = s.search_batch(catalog, terms)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_catalog_cache(catalog):
    """The caller caches the view; searches then read the cached columns."""
    assert catalog.is_cached
    plan = s.search_name(catalog, "x")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan


def test_sorted_names(catalog):
    names = [(r["product_name"], r["id"]) for r in s.product_names_sorted(catalog).collect()]
    assert names == sorted(names) and len(names) == 7


def test_distinct_substances(catalog):
    found = {r[0] for r in s.distinct_substances(catalog.filter(F.col("id").isin("2", "3", "4"))).collect()}
    assert found == {"ABATACEPTE", "abatacepte"}


def executed(df):
    """The plan that ran, after adaptive execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_one_term_needs_neither_join_nor_explode(spark, catalog):
    plan = executed(s.search_substitutes(catalog, "a"))
    assert "Join" not in plan and "Generate" not in plan


def test_batch_search_joins_products_once(spark, catalog):
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    plan = executed(s.search_batch(catalog, terms))
    assert "Generate" not in plan and plan.count("Scan parquet") <= 6
