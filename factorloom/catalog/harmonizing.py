"""Harmonising queries: source shapes, units, multipliers, merging, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom import constants as C
from factorloom.catalog import inputs as I
from factorloom.catalog.base import query, table, view
from factorloom.functions import units
from factorloom.operators import crosswalk, merge, multipliers, ordering, outliers, profile
from factorloom.plans import harmonize as plan
from factorloom.session import stage
from factorloom.sources import canonical

REFERENCE = plan.Options(unit_mode="reference")


def _tags(name: str = "tags"):
    return F.array_join(name, "|").alias("tags")


def _shape(df: DataFrame) -> DataFrame:
    return df.select(*C.CANONICAL_COLUMNS[:9], _tags())


def _with_flag(df: DataFrame) -> DataFrame:
    return outliers.flag_outliers(stage(df, "canonical")).select(*C.CANONICAL_COLUMNS[:9], _tags(), "is_outlier")


_SHAPE_SQL = """SELECT entity_id, entity_name, entity_type, ef_value, ef_unit, region, source_dataset, confidence,
  timestamp, array_to_string(tags, '|') AS tags"""


def _flag_sql(source: str) -> str:
    return f"{_SHAPE_SQL}, flagged AS is_outlier FROM ({I.outlier_sql(source, None, C.OUTLIER_Z)})"


@query("canon_project_product", _flag_sql("can_product"))
def canon_project_product(spark, sf):
    return _with_flag(I.canonical_product(spark, sf))


@query(
    "canon_project_period",
    f"""SELECT entity_id, entity_name, entity_type, round(ef_value, 0) AS ef_value, ef_unit, region, source_dataset,
  round(confidence, 6) AS confidence, timestamp, array_to_string(tags, '|') AS tags, flagged AS is_outlier
FROM ({I.outlier_sql("can_period", None, C.OUTLIER_Z)})""",
)
def canon_project_period(spark, sf):
    flagged = _with_flag(I.canonical_period(spark, sf))
    return flagged.withColumns({"ef_value": F.round("ef_value", 0), "confidence": F.round("confidence", 6)})


@query("canon_project_product_region", _flag_sql("can_product_region"))
def canon_project_product_region(spark, sf):
    return _with_flag(I.canonical_product_region(spark, sf))


@query("canon_project_flow", _flag_sql("can_flow"))
def canon_project_flow(spark, sf):
    return _with_flag(I.canonical_flow(spark, sf))


@query("canon_project_factor", _flag_sql("can_factor"))
def canon_project_factor(spark, sf):
    return _with_flag(I.canonical_factor(spark, sf))


@query("canon_project_pathway", _flag_sql("can_pathway"))
def canon_project_pathway(spark, sf):
    return _with_flag(I.canonical_pathway(spark, sf))


@query("canon_project_process", _flag_sql("can_process"))
def canon_project_process(spark, sf):
    return _with_flag(I.canonical_process(spark, sf))


@query("canon_project_multiplier", _flag_sql("can_multiplier"))
def canon_project_multiplier(spark, sf):
    return _with_flag(I.canonical_multiplier(spark, sf))


@query(
    "canon_project_legacy_flow",
    """SELECT entity_id, 'Item' || ' ' || cast(o_custkey % 40 as varchar) AS entity_name, ef_value, ef_unit, region, tags
FROM (SELECT cast(11 + o_custkey % 40 as varchar) AS entity_id, o_custkey, floor(o_totalprice / 10000.0::double) AS ef_value,
    'kg CO2e/USD' AS ef_unit, 'US' AS region, 'NAICS:' || cast(11 + o_custkey % 40 as varchar) AS tags,
    row_number() OVER (PARTITION BY o_custkey % 40, floor(o_totalprice / 10000.0::double) ORDER BY o_orderkey) AS rn FROM orders)
WHERE rn = 1""",
)
def canon_project_legacy_flow(spark, sf):
    """The older flow layout: column roles by header keyword, exact repeats dropped."""
    raw = table(spark, sf, "orders").select(
        (11 + F.col("o_custkey") % 40).cast("string").alias("NAICS_Code"),
        F.concat(F.lit("Item: "), (F.col("o_custkey") % 40).cast("string")).alias("Industry_Name"),
        F.floor(F.col("o_totalprice") / 10000.0).cast("double").alias("GHG_Emissions"),
        F.lit(2020).alias("Year"),
        F.col("o_orderkey").alias("_ord"),
    )
    shaped = canonical.flow(raw, I.AS_OF)
    return shaped.select("entity_id", "entity_name", "ef_value", "ef_unit", "region", _tags())


@query(
    "multiplier_combine",
    "SELECT region, sector, multiplier_factor, rationale, source_page FROM combined",
)
def multiplier_combine(spark, sf):
    both = multipliers.combine(I.predefined_list(spark), I.raw_extracted(spark, sf))
    return both.select("region", "sector", "multiplier_factor", "rationale", "source_page")


@query("multiplier_clean", f"{_SHAPE_SQL}, rationale, source_page FROM can_predefined")
def multiplier_clean(spark, sf):
    return I.canonical_predefined(spark, sf).select(*C.CANONICAL_COLUMNS[:9], _tags(), "rationale", "source_page")


@query(
    "agg_period_mean",
    """SELECT country_id, sector, subsector, year, round(value, 3) AS value, round(confidence, 6) AS confidence
FROM period_means""",
)
def agg_period_mean(spark, sf):
    means = canonical.period_means(I.raw_period(spark, sf))
    return means.withColumns({"value": F.round("value", 3), "confidence": F.round("confidence", 6)})


# --- units ------------------------------------------------------------------------

_FLOW_UNIT = I.unit_sql("amount", "unit")


@query("unit_standardize", f"SELECT _ord AS row_key, {_FLOW_UNIT[0]} AS ef_value, {_FLOW_UNIT[1]} AS ef_unit FROM raw_flow")
def unit_standardize(spark, sf):
    measure = units.standardize_unit("FlowAmount", "Unit", "reference")
    return I.raw_flow(spark, sf).select(
        F.col("_ord").alias("row_key"), measure.value.alias("ef_value"), measure.unit.alias("ef_unit")
    )



@query(
    "unit_standardize_exact",
    """SELECT _ord AS row_key,
  CASE WHEN lower(unit) LIKE 'mt co2e%' THEN amount * 1e9::double WHEN lower(unit) LIKE 'kg co2e%' THEN amount
    WHEN lower(unit) LIKE 'g co2e%' THEN amount * 0.001::double WHEN lower(unit) LIKE 't co2e%' THEN amount * 1000.0::double
    ELSE amount END AS ef_value,
  CASE WHEN unit = '12.5' THEN 'kg CO2e' WHEN unit = 'KG CO2E/t' THEN 'kg CO2e/t' WHEN contains(lower(unit), 'co2e') THEN 'kg CO2e'
    ELSE unit END AS ef_unit
FROM raw_flow""",
)
def unit_standardize_exact(spark, sf):
    measure = units.standardize_unit("FlowAmount", "Unit", "exact")
    return I.raw_flow(spark, sf).select(
        F.col("_ord").alias("row_key"), measure.value.alias("ef_value"), measure.unit.alias("ef_unit")
    )


_PER_KG_UNITS = ["g CO2e/kg", "ton CO2e/kg", "kg CO2e/ton", "kg CO2e/kg", "kg"]
_PER_KG_SQL = f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS v, {I.pick_sql(_PER_KG_UNITS, 'l_partkey % 5')} AS u FROM lineitem)"


def _per_kg_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("v"),
        I.pick(_PER_KG_UNITS, F.col("l_partkey") % 5).alias("u"),
    )


@query(
    "unit_standardize_v1",
    f"""SELECT l_orderkey, l_linenumber, CASE u WHEN 'g CO2e/kg' THEN v * 0.001::double WHEN 'ton CO2e/kg' THEN v * 1000.0::double
    WHEN 'kg CO2e/ton' THEN v * 0.001::double ELSE v END AS ef_value,
  CASE WHEN u IN ('g CO2e/kg', 'ton CO2e/kg', 'kg CO2e/ton') THEN 'kg CO2e/kg' ELSE u END AS ef_unit FROM {_PER_KG_SQL}""",
)
def unit_standardize_v1(spark, sf):
    measure = units.standardize_unit_per_kg("v", "u")
    return _per_kg_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", measure.value.alias("ef_value"), measure.unit.alias("ef_unit")
    )


@query(
    "unit_convert",
    f"""SELECT l_orderkey, l_linenumber, u AS source_unit, CASE WHEN u = 'kg CO2e/kg' THEN v WHEN u = 'g CO2e/kg' THEN v * 0.001::double
    WHEN u = 'ton CO2e/kg' THEN v * 1000.0::double WHEN u = 'kg CO2e/ton' THEN v * 0.001::double ELSE v END AS converted
FROM {_PER_KG_SQL}""",
)
def unit_convert(spark, sf):
    converted = units.convert_unit("v", "u", F.lit("kg CO2e/kg"))
    return _per_kg_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", F.col("u").alias("source_unit"), converted.alias("converted")
    )


# --- multipliers ---------------------------------------------------------------------


@query("multiplier_table", "SELECT region, sector, multiplier FROM multiplier_keys")
def multiplier_table(spark, sf):
    return multipliers.multiplier_table(I.canonical_multiplier(spark, sf))


_FOUR = ["flow", "product", "process", "factor"]
_SECTORS_SQL = "list_transform(list_filter(tags, lambda x: starts_with(x, 'sector:')), lambda x: replace(x, 'sector:', ''))"

view(
    "four_units",
    f"""SELECT _ord, region, entity_type, {I.unit_sql("ef_value", "ef_unit")[0]} AS ef_value,
  coalesce(CASE WHEN region = 'US' THEN 'USA' ELSE region END, '') AS r, CASE WHEN len(s) > 0 THEN s ELSE [entity_type] END AS s
FROM ({" UNION ALL ".join(f"SELECT _ord, region, entity_type, ef_value, ef_unit, {_SECTORS_SQL} AS s FROM can_{n}" for n in _FOUR)})""",
)
view(
    "four_pairs",
    "SELECT r, s, unnest(s) AS sector, generate_subscripts(s, 1) AS pos FROM (SELECT DISTINCT r, s FROM four_units)",
)


@query(
    "multiplier_v2",
    """SELECT u._ord AS row_key, u.region, u.entity_type, u.ef_value * coalesce(m.m, 1.0::double) AS ef_value, m.m IS NOT NULL AS multiplier_applied
FROM four_units u LEFT JOIN (
  SELECT r, s, arg_min(m, rank) AS m FROM (
    SELECT p.r, p.s, k.multiplier AS m, pos AS rank FROM four_pairs p JOIN multiplier_keys k ON k.region = p.r AND k.sector = p.sector
    UNION ALL SELECT p.r, p.s, k.multiplier, 1000 + pos FROM four_pairs p JOIN multiplier_keys k ON k.region = 'Global' AND k.sector = p.sector)
  GROUP BY r, s) m ON u.r = m.r AND u.s = m.s""",
)
def multiplier_v2(spark, sf):
    rows = plan.apply_units(merge.stack(I.datasets(spark, sf, _FOUR)), "reference")
    keys = multipliers.multiplier_table(I.canonical_multiplier(spark, sf))
    applied = multipliers.apply_regional(rows, keys)
    return applied.select(
        F.col("_ord").alias("row_key"),
        "region",
        "entity_type",
        "ef_value",
        "multiplier_applied",
    )


@query(
    "multiplier_unmatched",
    """SELECT coalesce(CASE WHEN region = 'US' THEN 'USA' ELSE region END, '') AS region, entity_type, count(*) AS rows
FROM unit_rows u WHERE dataset <> 'multiplier' AND _ord NOT IN (SELECT _ord FROM chosen_multiplier) GROUP BY 1, 2""",
)
def multiplier_unmatched(spark, sf):
    names = [n for n in I.DATASETS if n != "multiplier"]
    rows = merge.stack(I.datasets(spark, sf, names))
    keys = multipliers.multiplier_table(I.canonical_multiplier(spark, sf))
    return multipliers.unmatched(rows, keys)


_V1_FACTS = """(SELECT _ord, entity_id, entity_name, entity_type, ef_value, region FROM can_factor
  UNION ALL SELECT _ord, entity_id, entity_name, CASE WHEN starts_with(entity_id, '1') THEN 'household' ELSE entity_type END,
    ef_value, CASE WHEN region = 'GLB' THEN 'IN' ELSE region END FROM can_flow)"""


def _v1_facts(spark, sf):
    flows = I.canonical_flow(spark, sf).withColumns(
        {
            "entity_type": F.when(F.col("entity_id").startswith("1"), F.lit("household")).otherwise(F.col("entity_type")),
            "region": F.when(F.col("region") == "GLB", F.lit("IN")).otherwise(F.col("region")),
        }
    )
    return I.canonical_factor(spark, sf).drop("metadata").unionByName(flows)


@query(
    "multiplier_v1",
    f"""SELECT f._ord AS row_key, f.ef_value * coalesce(x.m, w.m, 1.0) AS ef_value, f.ef_value AS ef_value_original
FROM {_V1_FACTS} f
LEFT JOIN (SELECT entity_id, arg_max(ef_value, _ord) AS m FROM can_predefined GROUP BY 1) x ON x.entity_id = f.region || '_' || f.entity_type
LEFT JOIN (
  SELECT p.region, p.entity_type, arg_min(k.m, k.o) AS m
  FROM (SELECT DISTINCT region, entity_type FROM {_V1_FACTS}) p
  JOIN (SELECT entity_id, arg_max(ef_value, _ord) AS m, min(_ord) AS o FROM can_predefined GROUP BY 1) k
    ON starts_with(k.entity_id, p.region || '_') AND contains(k.entity_id, p.entity_type) GROUP BY 1, 2) w
  ON w.region = f.region AND w.entity_type = f.entity_type""",
)
def multiplier_v1(spark, sf):
    applied = multipliers.apply_by_key(_v1_facts(spark, sf), I.canonical_predefined(spark, sf))
    return applied.select(F.col("_ord").alias("row_key"), "ef_value", "ef_value_original")


# --- whole harmonisers -----------------------------------------------------------------

_HARMONIZED_SQL = """SELECT id, entity_id, entity_name, entity_type,
  CASE WHEN source_dataset = 'Climate_TRACE' THEN round(ef_value, 0) ELSE ef_value END AS ef_value, ef_unit, region, source_dataset,
  round(confidence, 6) AS confidence, timestamp, array_to_string(tags, '|') AS tags, is_outlier, multiplier_applied FROM harmonized"""


@query("harmonize_all", _HARMONIZED_SQL)
def harmonize_all(spark, sf):
    merged = plan.harmonize(I.datasets(spark, sf), REFERENCE)
    is_mean = F.col("source_dataset") == "Climate_TRACE"
    return merged.select(
        "id",
        "entity_id",
        "entity_name",
        "entity_type",
        F.when(is_mean, F.round("ef_value", 0)).otherwise(F.col("ef_value")).alias("ef_value"),
        "ef_unit",
        "region",
        "source_dataset",
        F.round("confidence", 6).alias("confidence"),
        "timestamp",
        _tags(),
        "is_outlier",
        "multiplier_applied",
    )


@query(
    "merge_union",
    f"""SELECT 'EF' || lpad(cast(row_number() OVER (ORDER BY _ord) as varchar), 8, '0') AS id, entity_id, entity_name, ef_value,
  region, source_dataset, array_to_string(tags, '|') AS tags
FROM (SELECT {I._COMMON} FROM can_product UNION ALL SELECT {I._COMMON} FROM can_flow UNION ALL SELECT {I._COMMON} FROM can_factor)""",
)
def merge_union(spark, sf):
    """Three datasets are stacked; a fourth lacks required columns and is left out."""
    parts = I.datasets(spark, sf, ["product", "flow", "factor"])
    parts["incomplete"] = parts["product"].drop("confidence", "ef_unit")
    merged = merge.merge(parts)
    return merged.select("id", "entity_id", "entity_name", "ef_value", "region", "source_dataset", _tags())


@query(
    "merge_union_v1",
    f"""SELECT 'EF_' || lpad(cast(row_number() OVER (ORDER BY _ord) - 1 as varchar), 8, '0') AS harmonized_id, entity_id, entity_name,
  region, tags
FROM (SELECT _ord, entity_id, entity_name, region, array_to_string(tags, '|') AS tags FROM can_product
  UNION ALL SELECT _ord, entity_id, entity_name, CAST(NULL AS varchar), '' FROM can_pathway)""",
)
def merge_union_v1(spark, sf):
    parts = I.datasets(spark, sf, ["product", "pathway"])
    parts["pathway"] = parts["pathway"].drop("tags", "region")
    return merge.merge_fixed(parts).select("harmonized_id", "entity_id", "entity_name", "region", _tags())


@query(
    "harmonize_v1",
    f"""SELECT 'EF_' || lpad(cast(row_number() OVER (ORDER BY f._ord) - 1 as varchar), 8, '0') AS harmonized_id, entity_id, entity_name,
  CASE WHEN f.k THEN f.value ELSE f.value * coalesce(x.m, w.m, 1.0) END AS ef_value, ef_unit, f.region AS region
FROM (
  SELECT _ord, entity_id, entity_name, entity_type, CASE WHEN ef_unit = 'g CO2e/kg' THEN ef_value * 0.001::double ELSE ef_value END AS value,
    CASE WHEN ef_unit = 'g CO2e/kg' THEN 'kg CO2e/kg' ELSE ef_unit END AS ef_unit, region, false AS k FROM can_factor
  UNION ALL SELECT _ord, entity_id, entity_name, CASE WHEN starts_with(entity_id, '1') THEN 'household' ELSE entity_type END,
    ef_value, ef_unit, CASE WHEN region = 'GLB' THEN 'IN' ELSE region END, false FROM can_flow
  UNION ALL SELECT _ord, entity_id, entity_name, entity_type, ef_value, ef_unit, region, true FROM can_predefined) f
LEFT JOIN (SELECT entity_id AS e, arg_max(ef_value, _ord) AS m FROM can_predefined GROUP BY 1) x ON x.e = f.region || '_' || f.entity_type
LEFT JOIN (
  SELECT p.region, p.entity_type, arg_min(k.m, k.o) AS m
  FROM (SELECT DISTINCT region, entity_type FROM {_V1_FACTS}) p
  JOIN (SELECT entity_id, arg_max(ef_value, _ord) AS m, min(_ord) AS o FROM can_predefined GROUP BY 1) k
    ON starts_with(k.entity_id, p.region || '_') AND contains(k.entity_id, p.entity_type) GROUP BY 1, 2) w
  ON w.region = f.region AND w.entity_type = f.entity_type""",
)
def harmonize_v1(spark, sf):
    parts = {"facts": _v1_facts(spark, sf), "predefined": I.canonical_predefined(spark, sf)}
    merged = plan.harmonize_by_key(parts)
    return merged.select("harmonized_id", "entity_id", "entity_name", "ef_value", "ef_unit", "region")


# --- crosswalk -----------------------------------------------------------------------------

_CROSSWALK_NAMES = ["product", "flow", "pathway", "process"]
view(
    "entities",
    " UNION ALL ".join(
        f"SELECT entity_id, entity_name, '{n}' AS source_dataset, _ord FROM can_{n}" for n in _CROSSWALK_NAMES
    ),
)
view(
    "named_entities",
    """SELECT *, row_number() OVER (PARTITION BY k ORDER BY _ord) AS place FROM (
  SELECT *, trim(regexp_replace(lower(entity_name), '[^a-z0-9]', ' ', 'g')) AS k FROM entities)""",
)


@query(
    "crosswalk_pairs",
    """SELECT p.entity_id AS primary_id, p.entity_name AS primary_name, p.source_dataset AS primary_source,
  e.entity_id AS secondary_id, e.entity_name AS secondary_name, e.source_dataset AS secondary_source, 0.9::double AS match_confidence
FROM named_entities e JOIN named_entities p ON p.k = e.k AND p.place = 1 WHERE e.place > 1""",
)
def crosswalk_pairs(spark, sf):
    return crosswalk.crosswalk_pairs(crosswalk.stack_entities(I.datasets(spark, sf, _CROSSWALK_NAMES)))


@query(
    "crosswalk_canonical",
    f"""SELECT e.entity_id, e.entity_name, e.source_dataset, 'ENT_' || lpad(cast(f.p as varchar), 6, '0') AS canonical_id
FROM entities e JOIN (
  SELECT entity_name, min(p) AS p FROM (SELECT entity_name, row_number() OVER (ORDER BY _ord) - 1 AS p FROM entities) GROUP BY 1) f
  ON f.entity_name IS NOT DISTINCT FROM e.entity_name""",
)
def crosswalk_canonical(spark, sf):
    return crosswalk.canonical_entities(crosswalk.stack_entities(I.datasets(spark, sf, _CROSSWALK_NAMES)))


# --- outliers, duplicates, repair ---------------------------------------------------------------


@query(
    "outlier_flag",
    f"SELECT event_id, value, flagged AS is_outlier FROM ({I.outlier_sql('events', None, C.OUTLIER_Z, 'value')})",
)
def outlier_flag(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return outliers.flag_outliers(rows, "value")


@query(
    "outlier_by_group",
    f"SELECT event_id, event_type, value, flagged AS is_outlier FROM ({I.outlier_sql('events', 'event_type', C.OUTLIER_Z_GROUPED, 'value')})",
)
def outlier_by_group(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return outliers.flag_outliers(rows, "value", by=["event_type"], z=C.OUTLIER_Z_GROUPED)


@query(
    "outlier_statistics",
    """SELECT l_returnflag, n, round(mean, 4) AS mean, round(sd, 4) AS std, q1, q3 FROM (
  SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd,
    round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3
  FROM lineitem GROUP BY 1)""",
)
def outlier_statistics(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    stats = outliers.group_statistics(rows, "l_extendedprice", ["l_returnflag"])
    return stats.select(
        "l_returnflag",
        "n",
        F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"),
        F.round(F.col("q")[0], 4).alias("q1"),
        F.round(F.col("q")[1], 4).alias("q3"),
    )


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query(
    "dedupe_keep_first",
    """SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part
QUALIFY row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_partkey) = 1""",
)
def dedupe_keep_first(spark, sf):
    return ordering.keep_first(_parts(spark, sf), ["p_name", "p_type"], ["p_partkey"])


@query("dedupe_exact", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem")
def dedupe_exact(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    return ordering.keep_distinct(rows)


_DUP_KEYS = ["entity_id", "entity_type", "region", "source_dataset"]


@query(
    "dup_report",
    f"""SELECT coalesce(sum(c), 0) AS duplicate_rows, count(*) AS duplicate_groups, coalesce(sum(c - 1), 0) AS removable_rows
FROM (SELECT count(*) AS c FROM facts GROUP BY {", ".join(_DUP_KEYS)} HAVING count(*) > 1)""",
)
def dup_report(spark, sf):
    return ordering.duplicate_report(I.facts(spark, sf), _DUP_KEYS)


view(
    "repaired",
    """SELECT id, entity_id, entity_name, lower(split_part(entity_type, ' - ', 1)) AS entity_type, ef_value,
  CASE WHEN regexp_full_match(ef_unit, '[0-9.]+') THEN 'kg CO2e' ELSE ef_unit END AS ef_unit,
  CASE WHEN region = 'US' THEN 'USA' ELSE region END AS region, source_dataset, is_outlier FROM facts
QUALIFY row_number() OVER (PARTITION BY entity_id, entity_type, ef_value, region, source_dataset ORDER BY id) = 1""",
)


@query(
    "repair_pass",
    f"""SELECT id, entity_id, entity_name, entity_type, ef_value, ef_unit, region, source_dataset,
  CASE WHEN flagged THEN true ELSE is_outlier END AS is_outlier
FROM ({I.outlier_sql("repaired", "entity_type", C.OUTLIER_Z_GROUPED)})""",
)
def repair_pass(spark, sf):
    fixed = merge.repair(I.facts(spark, sf))
    return fixed.select(
        "id", "entity_id", "entity_name", "entity_type", "ef_value", "ef_unit", "region", "source_dataset", "is_outlier"
    )


@query(
    "repair_stats",
    """SELECT source_dataset, count(*) AS rows, count(*) FILTER (is_outlier) AS outliers, count(*) FILTER (multiplier_applied) AS multipliers
FROM facts GROUP BY 1""",
)
def repair_stats(spark, sf):
    return profile.flag_totals(I.facts(spark, sf), "source_dataset")


@query(
    "conflict_resolve",
    """SELECT entity_id, region, round(value, 9) AS ef_value, confidence, timestamp, merged_rows FROM (
  SELECT entity_id, region, round(confidence, 2) AS confidence, timestamp, avg(ef_value) AS value, count(*) AS merged_rows
  FROM facts WHERE ef_value IS NOT NULL GROUP BY 1, 2, 3, 4)
QUALIFY row_number() OVER (PARTITION BY entity_id, region ORDER BY confidence DESC NULLS LAST, timestamp DESC NULLS LAST) = 1""",
)
def conflict_resolve(spark, sf):
    resolved = merge.resolve_conflicts(I.facts(spark, sf), ["entity_id", "region"])
    return resolved.withColumn("ef_value", F.round("ef_value", 9))


@query(
    "topk_per_group",
    """SELECT region, entity_type, id, ef_value, cast(rank as int) AS rank FROM (
  SELECT region, entity_type, id, ef_value,
    row_number() OVER (PARTITION BY region, entity_type ORDER BY ef_value DESC NULLS LAST, id) AS rank FROM facts)
WHERE rank <= 3""",
)
def topk_per_group(spark, sf):
    rows = I.facts(spark, sf).select("region", "entity_type", "id", "ef_value")
    return ordering.top_per_group(
        rows, ["region", "entity_type"], [F.desc_nulls_last("ef_value"), F.col("id")], 3
    )
