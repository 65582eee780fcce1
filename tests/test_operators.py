"""Operators against brute force, with bounds lowered so that every path runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import crosswalk, merge, multipliers, ordering, outliers, quality, quantiles, sampling, sizing
from factorloom.plans import instruct, scoring


def numbers(seed, n):
    """Spread over many magnitudes, with ties, zeros and negatives."""
    draw = random.Random(seed)
    values = [draw.choice([-1, 1]) * 10 ** draw.uniform(-12, 12) for _ in range(n)]
    return values + [0.0] * 7 + [5.0] * (n // 3) + [5.0 + i * 1e-13 for i in range(20)]


@pytest.mark.parametrize("slice_rows", [0, 3, 1_000_000])
def test_quantiles_are_exact(spark, slice_rows):
    groups = {g: numbers(i, 200 + 37 * i) for i, g in enumerate("abc")}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("a", None), ("b", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r for r in quantiles.exact_statistics(df, "v", probabilities, ["g"], slice_rows).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        assert np.allclose(got[g].q, np.percentile(values, [p * 100 for p in probabilities]), rtol=1e-12)
        assert np.isclose(got[g].mean, np.mean(values))
        assert np.isclose(got[g]["std"], np.std(values))


def test_quantiles_without_groups_or_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_statistics(df, "v", [0.25, 0.75]).head().q == [25.0, 75.0]
    assert quantiles.exact_statistics(df.where("v < 0"), "v", [0.5]).head() is None


def brute_outliers(values, z):
    known = np.array([v for v in values if v is not None and not np.isnan(v)])
    if len(known) < 10:
        return [False] * len(values)
    q1, q3 = np.percentile(known, [25, 75])
    std, spread = known.std(), q3 - q1
    flags = []
    for v in values:
        if v is None or np.isnan(v):
            flags.append(False)
            continue
        far = std > 0 and abs(v - known.mean()) / std > z
        flags.append(bool(far or (spread > 0 and (v < q1 - 1.5 * spread or v > q3 + 1.5 * spread))))
    return flags


@pytest.mark.parametrize(
    "values",
    [
        [1.0] * 11 + [100.0],
        [1.0] * 12,
        [1.0] * 30 + [1000.0],
        [1.0, 2.0, 3.0] * 5 + [50.0, None, float("nan")],
        [1.0] * 5 + [99.0],
        [None] * 12,
        [float(i % 5) for i in range(30)] + [float("inf")],
        [float(i % 5) for i in range(30)] + [float("-inf"), float("inf")],
        [float("inf")] * 12,
    ],
)
def test_outliers_match_the_rule(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, ef_value double")
    got = [r.is_outlier for r in outliers.flag_outliers(df).orderBy("i").collect()]
    assert got == brute_outliers(values, 3.0)


def test_grouped_outliers_only_add_flags(spark):
    rows = [("a", float(i % 4), None) for i in range(20)] + [("a", 99.0, False), ("b", 99.0, True), (None, 1e9, False)]
    df = spark.createDataFrame(rows, "t string, ef_value double, is_outlier boolean")
    got = outliers.flag_outliers(df, by=["t"], z=3.5, keep_true=True)
    assert {(r.t, r.ef_value): r.is_outlier for r in got.where("ef_value > 50").collect()} == {
        ("a", 99.0): True,
        ("b", 99.0): True,
        (None, 1e9): False,
    }
    assert got.where("t = 'a' and ef_value < 50 and is_outlier is null").count() == 20


def test_dense_index_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = sorted((r.k, r["_n"]) for r in ordering.dense_index(df, ["k"], start=1).collect())
    assert got == [(k, k + 1) for k in range(1000)]


def test_first_seen_ordinals(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, "x"), (0, None), (5, "z")], "_ord int, v string")
    got = {r.v: r["_n"] for r in ordering.first_seen_ordinals(df, "v").collect()}
    assert got == {"y": 1, "x": 2, "z": 3}


def test_keep_first_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(2, None), (1, None), (3, "a")], "o int, k string")
    assert sorted(r.o for r in ordering.keep_first(df, ["k"], ["o"]).collect()) == [1, 3]


def test_keep_first_limits_rows_ahead_of_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    plan = ordering.keep_first(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_duplicate_report(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (3,), (3,)], "k int")
    assert tuple(ordering.duplicate_report(df, ["k"]).head()) == (5, 2, 3)


@pytest.mark.parametrize("hot_rows", [0, 5, 1_000_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_weighted_join_equals_a_plain_join(spark, hot_rows, how):
    fact = spark.range(90).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 20).cast("string")).alias("k")
    )
    dim = fact.groupBy("k").agg(F.count(F.lit(1)).alias("w")).where("k <> '7'")
    got = sizing.join_by_weight(fact, dim, "k", "w", how, hot_rows, hot_keys=2)
    expected = fact.join(dim, "k", how)
    assert sorted(map(str, got.select("id", "k", "w").collect())) == sorted(
        map(str, expected.select("id", "k", "w").collect())
    )


def entities(spark):
    rows = [
        (0, "a0", "Beef, raw"),
        (1, "a1", "beef  raw"),
        (2, "a2", None),
        (3, "b0", "Milk"),
        (4, "b1", "BEEF; RAW"),
        (5, "b2", None),
        (6, "b3", "Milk"),
    ]
    df = spark.createDataFrame(rows, "_ord int, entity_id string, entity_name string")
    return {"a": df.where("_ord < 3"), "b": df.where("_ord >= 3"), "none": df.drop("entity_id")}


@pytest.mark.parametrize("hot_rows", [0, 1_000_000])
def test_crosswalk_pairs(spark, hot_rows):
    stacked = crosswalk.stack_entities(entities(spark))
    got = crosswalk.crosswalk_pairs(stacked, hot_rows=hot_rows).collect()
    assert sorted((r.primary_id, r.secondary_id, r.primary_source, r.secondary_source) for r in got) == [
        ("a0", "a1", "a", "a"),
        ("a0", "b1", "a", "b"),
        ("b0", "b3", "b", "b"),
    ]


@pytest.mark.parametrize("hot_rows", [0, 1_000_000])
def test_canonical_ids_match_null_to_null(spark, hot_rows):
    stacked = crosswalk.stack_entities(entities(spark))
    got = {r.entity_id: r.canonical_id for r in crosswalk.canonical_entities(stacked, hot_rows=hot_rows).collect()}
    assert got["a2"] == got["b2"] == "ENT_000002"
    assert got["b0"] == got["b3"] == "ENT_000003"
    assert got["a0"] != got["a1"]


def multiplier_rows(spark):
    rows = [
        (0, "USA", ["sector:energy"], 1.1),
        (1, "USA", ["sector:energy"], 1.3),
        (2, "FR", ["sector:waste", "sector:energy"], 2.0),
        (3, "Global", ["sector:waste"], 0.7),
        (4, None, ["sector:rare"], 9.0),
    ]
    df = spark.createDataFrame(rows, "_ord int, region string, tags array<string>, ef_value double")
    return df.withColumn("entity_type", F.lit("multiplier"))


def test_multiplier_table_last_row_wins_and_global_fallback(spark):
    got = {(r.region, r.sector): r.multiplier for r in multipliers.multiplier_table(multiplier_rows(spark)).collect()}
    assert got == {
        ("USA", "energy"): 1.3,
        ("FR", "waste"): 2.0,
        ("FR", "energy"): 2.0,
        ("Global", "waste"): 0.7,
        ("Global", "energy"): 1.0,
        ("Global", "rare"): 1.0,
    }


@pytest.mark.parametrize("max_rows", [0, 1000])
def test_regional_multipliers(spark, max_rows):
    facts = spark.createDataFrame(
        [
            (0, "US", ["sector:energy"], "x", 10.0),
            (1, "FR", ["sector:energy", "sector:waste"], "x", 10.0),
            (2, "DE", ["sector:waste"], "x", 10.0),
            (3, "DE", ["other:1"], "energy", 10.0),
            (4, "DE", None, "unknown", 10.0),
            (5, None, ["sector:none", "sector:rare"], "x", 10.0),
            (6, "FR", ["sector:none", "sector:waste"], "x", None),
            (7, "fr", ["sector:Waste"], "x", 10.0),
            (8, "DE", ["sector:waste"], "x", 20.0),
            (8, "US", ["sector:energy"], "x", 20.0),
        ],
        "_ord int, region string, tags array<string>, entity_type string, ef_value double",
    )
    table = multipliers.multiplier_table(multiplier_rows(spark))
    got = multipliers.apply_regional(facts, table, max_rows=max_rows, where=F.col("_ord") != 7)
    rows = got.collect()
    assert sorted(r.ef_value for r in rows if r["_ord"] == 8) == [14.0, 26.0]
    assert {r["_ord"]: (r.ef_value, r.multiplier_applied) for r in rows if r["_ord"] != 8} == {
        0: (13.0, True),
        1: (20.0, True),
        2: (7.0, True),
        3: (10.0, True),
        4: (10.0, False),
        5: (10.0, True),
        6: (None, True),
        7: (10.0, None),
    }


def test_multiplier_table_by_region_code(spark):
    rows = spark.createDataFrame(
        [(0, "United States", ["sector:a", "region_code:USA"], 1.5)],
        "_ord int, region string, tags array<string>, ef_value double",
    ).withColumn("entity_type", F.lit("multiplier"))
    got = {r.region for r in multipliers.multiplier_table(rows, region_key="code").collect()}
    assert got == {"USA", "Global"}


def test_multipliers_by_key_prefix(spark):
    table = spark.createDataFrame(
        [(0, "US_oil_and_gas", 2.0), (1, "US_gas", 3.0), (2, "US_gas", 4.0), (3, "U", 9.0), (4, None, 1.0)],
        "_ord int, entity_id string, ef_value double",
    )
    facts = spark.createDataFrame(
        [(0, "US", "gas", 1.0), (1, "US", "oil", 1.0), (2, "US_oil", "gas", 1.0), (3, "FR", "gas", 1.0), (4, None, "gas", 1.0)],
        "_ord int, region string, entity_type string, ef_value double",
    )
    got = {r["_ord"]: (r.ef_value, r.ef_value_original) for r in multipliers.apply_by_key(facts, table).collect()}
    assert got == {0: (4.0, 1.0), 1: (2.0, 1.0), 2: (2.0, 1.0), 3: (1.0, 1.0), 4: (1.0, 1.0)}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.8, 1.0])
def test_split_is_exact_disjoint_and_complete(spark, share):
    df = spark.range(487).select(F.col("id").cast("string").alias("key"))
    first, second = sampling.split_share(df, share, ["key"])
    a, b = {r.key for r in first.collect()}, {r.key for r in second.collect()}
    assert len(a) == int(share * 487)
    assert not a & b and len(a | b) == 487


def test_audit_sample_takes_a_share_of_each_stratum(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("s"))
    counts = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    got = {r.s: r["count"] for r in quality.audit_sample(df, 0.05, ["s"], ["id"]).groupBy("s").count().collect()}
    assert got == {s: int(np.ceil(0.05 * n)) for s, n in counts.items()}


def test_flagged_sample_falls_back_to_all_rows(spark):
    df = spark.range(50).withColumn("f", F.col("id") % 25 == 0).withColumn("none", F.lit(False))
    assert {r.id for r in sampling.sample_flagged(df, "f", 10, ["id"]).collect()} == {0, 25}
    assert sampling.sample_flagged(df, "none", 10, ["id"]).count() == 10


def test_large_flagged_sample_stays_spread_and_has_the_same_rows(spark, monkeypatch):
    df = spark.range(400).repartition(6).withColumn("f", F.when(F.col("id") % 3 == 0, True))
    small = {r.id for r in sampling.sample_flagged(df, "f", 60, ["id"]).collect()}
    monkeypatch.setattr(sampling, "TOP_ROWS", 10)
    spread = sampling.sample_flagged(df, "f", 60, ["id"])
    assert {r.id for r in spread.collect()} == small and len(small) == 60 and all(k % 3 == 0 for k in small)
    # no top-n of the sample itself; the rank inside the one cut prefix may be one
    assert "limit=60" not in spread._jdf.queryExecution().toString()


def test_merge_keeps_every_row_and_skips_incomplete_tables(spark):
    full = spark.createDataFrame(
        [(2, "i", "n", "t", "1.5", "u", "r", "s", 0.5, "x")],
        "_ord int, entity_id string, entity_name string, entity_type string, ef_value string, ef_unit string, "
        "region string, source_dataset string, confidence double, tags string",
    )
    bare = full.withColumn("_ord", F.lit(1)).drop("tags").withColumn("ef_value", F.lit("2d"))
    got = merge.merge({"a": full, "b": bare, "c": full.drop("region")}).orderBy("id").collect()
    assert [(r.id, r.ef_value, r.tags) for r in got] == [("EF00000001", None, []), ("EF00000002", 1.5, ["x"])]
    with pytest.raises(ValueError):
        merge.merge({"c": full.drop("region")})


def test_merge_fixed_fills_missing_tags_with_an_empty_list(spark):
    df = spark.createDataFrame([(0, "i"), (1, "j")], "_ord int, entity_id string")
    got = merge.merge_fixed({"a": df}).orderBy("harmonized_id").collect()
    assert [(r.harmonized_id, r.tags, r.region) for r in got] == [("EF_00000000", [], None), ("EF_00000001", [], None)]


def test_ids_longer_than_the_padding_are_kept(spark):
    df = spark.createDataFrame([(123456789012,)], "n bigint")
    assert df.select(merge.padded_id("EF", "n")).head()[0] == "EF123456789012"


def test_conflicts_prefer_confidence_then_date_then_average(spark):
    df = spark.createDataFrame(
        [("k", 1.0, 0.9, "2024"), ("k", 3.0, 0.9, "2024"), ("k", 9.0, 0.9, "2020"), ("k", 7.0, 0.5, "2025"), ("j", 4.0, None, None)],
        "k string, ef_value double, confidence double, timestamp string",
    )
    got = {r.k: (r.ef_value, r.merged_rows) for r in merge.resolve_conflicts(df, ["k"]).collect()}
    assert got == {"k": (2.0, 2), "j": (4.0, 1)}


def test_quotas():
    assert list(instruct.quotas().values()) == [900, 750, 450, 450, 300, 150]


def test_hallucination_modes(spark):
    answers = spark.createDataFrame([(1, "10 kg CO2e from Trace")], "id int, model_output string")
    truth = spark.createDataFrame(
        [(1, "q", "", "8 kg CO2e from trace", ["Trace"])],
        "id int, instruction string, input string, output string, sources array<string>",
    )
    for mode, rate in (("reference", 100.0), ("exact", 0.0)):
        row = scoring.metrics(scoring.score_rows(answers, truth, mode)).head()
        assert (row.mape, row.source_attribution_accuracy, row.hallucination_rate) == (25.0, 100.0, rate)


def test_metrics_without_scorable_rows_are_null(spark):
    answers = spark.createDataFrame([(1, "nothing")], "id int, model_output string")
    truth = spark.createDataFrame(
        [(1, "q", "", "0 kg", None)], "id int, instruction string, input string, output string, sources array<string>"
    )
    assert tuple(scoring.metrics(scoring.score_rows(answers, truth)).head()) == (None, None, None)


def test_ids_past_their_padding_keep_number_order(spark):
    from factorloom.plans.graph import fact_nodes, source_nodes, type_nodes

    row = ("e", "n", "t - x", 1.0, "kg", "US", "s", 0.5, "2025", False, False)
    names = "entity_id string, entity_name string, entity_type string, ef_value double, ef_unit string, region string, "
    names += "source_dataset string, confidence double, timestamp string, is_outlier boolean, multiplier_applied boolean, id string"
    df = spark.createDataFrame([(*row, "EF100000000"), (*row, "EF99999999")], names).withColumn("tags", F.array())
    assert [r.id for r in merge.repair(df).collect()] == ["EF99999999"]
    two = [(*row[:2], "late", *row[3:6], "late_1", *row[7:], "EF100000000"), (*row[:2], "early", *row[3:6], "early_1", *row[7:], "EF99999999")]
    facts = fact_nodes(spark.createDataFrame(two, names))
    assert {r.type_name: r.type_id for r in type_nodes(facts).collect()} == {"early": "type_1", "late": "type_2"}
    assert {r.name: r.source_id for r in source_nodes(facts).collect()} == {"early_1": "source_1", "late_1": "source_2"}


def test_large_samples_hold_the_same_rows_and_stay_spread(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k")).repartition(6)
    small = {r.k for r in sampling.sample_rows(df, 2000, ["k"]).collect()}
    monkeypatch.setattr(sampling, "TOP_ROWS", 100)
    large = sampling.sample_rows(df, 2000, ["k"])
    assert {r.k for r in large.collect()} == small and len(small) == 2000
    assert large.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert sampling.sample_rows(df, 9000, ["k"]).count() == 5000
