"""Region hierarchies of several levels."""

import pytest
from pyspark.sql import functions as F

from factorloom.catalog import inputs
from factorloom.plans import patterns
from factorloom.plans.graph import FactorGraph


def levels(spark, pairs):
    return spark.createDataFrame([(c, p, "PART_OF") for c, p in pairs], "child_region_code string, parent_region_code string, relationship_type string")


def test_closure_over_levels_and_two_ways(spark):
    pairs = [("c", "b"), ("b", "a"), ("c", "x"), ("x", "a"), ("c", "a"), ("a", "top"), ("c", "b")]
    got = {(r["ancestor"], r["region"]): r["depth"] for r in patterns.hierarchy_closure(levels(spark, pairs)).collect()}
    assert got == {
        ("b", "c"): 1, ("a", "b"): 1, ("x", "c"): 1, ("a", "x"): 1, ("a", "c"): 1,
        ("top", "a"): 1, ("top", "b"): 2, ("top", "x"): 2, ("top", "c"): 2,
    }


@pytest.mark.parametrize("pairs", [[("a", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")]])
def test_cycles_are_refused(spark, pairs):
    with pytest.raises(Exception, match="cycle"):
        patterns.hierarchy_closure(levels(spark, pairs)).collect()


def test_empty_hierarchy(spark):
    assert patterns.hierarchy_closure(levels(spark, [("a", "b")]).where(F.lit(False))).count() == 0


def test_rollup_counts_a_region_once(spark):
    rows = [("1", "c", 2.0), ("2", "c", None), ("3", "b", 4.0), ("4", "top", 10.0), ("5", None, 1.0), ("6", "lonely", 7.0)]
    facts = spark.createDataFrame(rows, "ef_id string, region string, ef_value double").withColumns(
        {"entity_name": F.lit("n"), "ef_unit": F.lit("u"), "entity_type": F.lit("t"), "source_dataset": F.lit("s")}
    )
    g = FactorGraph(facts, hierarchy=levels(spark, [("c", "b"), ("c", "x"), ("b", "top"), ("x", "top")]))
    got = {r["region_code"]: (r["rows"], r["regions"], r["avg_value"], r["least_value"], r["most_value"]) for r in patterns.rollup_all_levels(g).collect()}
    assert got == {
        "c": (2, 1, 2.0, 2.0, 2.0), "x": (2, 1, 2.0, 2.0, 2.0), "b": (3, 2, 3.0, 2.0, 4.0),
        "top": (4, 3, 16 / 3, 2.0, 10.0), "lonely": (1, 1, 7.0, 7.0, 7.0),
    }


def test_table_counts_are_those_of_the_tables(spark):
    graph = inputs.graph(spark, "/root/testdata/sf0.001")
    counted = {r["name"]: r["rows"] for r in graph.table_counts().collect()}
    assert counted == {name: df.count() for name, df in graph.tables().items()} and len(counted) == 8
