"""Profile and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.catalog import inputs as I
from factorloom.catalog.base import query, table, view
from factorloom.operators import hashtree, profile, quality, sketches
from factorloom.session import scratch_path
from factorloom.sources import sinks

view(
    "named_facts",
    """SELECT *, trim(regexp_replace(lower(entity_name), '[^a-z0-9]', ' ', 'g')) AS name FROM facts
WHERE entity_name IS NOT NULL AND ef_value IS NOT NULL""",
)


def _count_sql(column: str) -> str:
    return f'SELECT {column}, count(*) AS "count" FROM facts WHERE {column} IS NOT NULL GROUP BY 1'


def _register_counts() -> None:
    named = [("type", "entity_type"), ("source", "source_dataset"), ("region", "region"), ("unit", "ef_unit")]
    for suffix, column in named:

        def run(spark, sf, column=column):
            return profile.value_counts(I.facts(spark, sf), column)

        query(f"value_counts_{suffix}", _count_sql(column))(run)


_register_counts()


@query(
    "topn_regions",
    'SELECT region, count(*) AS "count" FROM facts WHERE region IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10',
)
def topn_regions(spark, sf):
    return profile.top_values(I.facts(spark, sf), "region")


@query(
    "metadata_profile",
    """SELECT 'total' AS section, 'record_count' AS item, count(*)::double AS value FROM facts
UNION ALL SELECT 'confidence', 'confidence_min', coalesce(min(confidence), 0) FROM facts
UNION ALL SELECT 'confidence', 'confidence_max', coalesce(max(confidence), 0) FROM facts
UNION ALL SELECT 'distinct', 'region', count(DISTINCT region) FROM facts
UNION ALL SELECT 'distinct', 'entity_type', count(DISTINCT entity_type) FROM facts
UNION ALL SELECT 'distinct', 'ef_unit', count(DISTINCT ef_unit) FROM facts
UNION ALL SELECT 'distinct', 'source_dataset', count(DISTINCT source_dataset) FROM facts
UNION ALL SELECT 'entity_type', entity_type, count(*) FROM facts WHERE entity_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'ef_unit', ef_unit, count(*) FROM facts WHERE ef_unit IS NOT NULL GROUP BY 2""",
)
def metadata_profile(spark, sf):
    return profile.metadata_profile(I.facts(spark, sf))


@query(
    "metadata_profile_v1",
    """SELECT 'flow' AS dataset, 'rows' AS section, '' AS item, count(*) AS value FROM can_flow
UNION ALL SELECT 'flow', 'regions', '', count(DISTINCT region) FROM can_flow
UNION ALL SELECT 'flow', 'entity_type', entity_type, count(*) FROM can_flow GROUP BY 3
UNION ALL SELECT 'factor', 'rows', '', count(*) FROM can_factor
UNION ALL SELECT 'factor', 'regions', '', count(DISTINCT region) FROM can_factor
UNION ALL SELECT 'factor', 'entity_type', entity_type, count(*) FROM can_factor GROUP BY 3
UNION ALL SELECT v.d, 'columns', 'entity_id,entity_name,entity_type,ef_value,ef_unit,region,source_dataset,confidence,timestamp,tags', 10
  FROM (VALUES ('flow'), ('factor')) v(d)""",
)
def metadata_profile_v1(spark, sf):
    parts = I.datasets(spark, sf, ["flow", "factor"])
    parts["factor"] = parts["factor"].drop("metadata")
    return profile.dataset_profiles(parts)


@query(
    "summary_report_lines",
    """SELECT 0 AS part, 1 AS place, 'Total records: ' || cast(count(*) as varchar) AS line FROM facts
UNION ALL SELECT 0, 2, 'Datasets included: ' || cast(count(DISTINCT source_dataset) as varchar) FROM facts
UNION ALL SELECT 0, 3, 'Regions covered: ' || cast(count(DISTINCT region) as varchar) FROM facts
UNION ALL SELECT 0, 4, 'Average confidence score: ' || printf('%.2f', avg(confidence)) FROM facts
UNION ALL SELECT 1, -count(*), '- ' || entity_type || ': ' || cast(count(*) as varchar) FROM facts WHERE entity_type IS NOT NULL GROUP BY entity_type
UNION ALL SELECT 2, -count(*), '- ' || source_dataset || ': ' || cast(count(*) as varchar) FROM facts GROUP BY source_dataset
UNION ALL SELECT 3, -count(*), '- ' || region || ': ' || cast(count(*) as varchar) FROM facts WHERE region IS NOT NULL GROUP BY region HAVING count(*) > 10""",
)
def summary_report_lines(spark, sf):
    return profile.summary_lines(I.facts(spark, sf))


_PRINTED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query(
    "table_fingerprint",
    f"""WITH m AS (SELECT md5(concat_ws('|', {", ".join(f"coalesce({c}::VARCHAR, chr(92) || 'N')" for c in _PRINTED)})) AS m FROM lineitem)
SELECT count(*) AS rows, sum(('0x' || substr(m, 1, 8))::BIGINT)::BIGINT AS first_sum,
  sum(('0x' || substr(m, 9, 8))::BIGINT)::BIGINT AS second_sum FROM m""",
)
def table_fingerprint(spark, sf):
    """Row count and order-insensitive hash sums."""
    return profile.fingerprint(table(spark, sf, "lineitem"), _PRINTED)


_TREE_WIDTH = 50
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]
_CHANGED = "CASE WHEN l_orderkey % 997 = 3 THEN l_quantity + 1 ELSE l_quantity END"


def _tree_sql(rows: str) -> str:
    quoted = ", ".join(f"coalesce('\"' || replace({c}::VARCHAR, '\"', '\"\"') || '\"', 'N')" for c in _LINE)
    return f"""SELECT 0 AS level, l_orderkey // {_TREE_WIDTH} AS node, count(*)::BIGINT AS rows,
    md5(count(*) || '|' || sum(('0x' || substr(m, 1, 15))::BIGINT::HUGEINT) || '|' || sum(('0x' || substr(m, 16, 15))::BIGINT::HUGEINT)) AS hash
  FROM (SELECT l_orderkey, md5(concat_ws(',', {quoted})) AS m FROM {rows}) GROUP BY l_orderkey // {_TREE_WIDTH}"""


@query(
    "table_hash_tree",
    f"""WITH RECURSIVE tree AS (
  {_tree_sql("lineitem")}
  UNION ALL
  SELECT level + 1, node // {hashtree.FAN}, sum(rows)::BIGINT, md5(string_agg(node || ':' || hash, ',' ORDER BY node))
  FROM (SELECT *, max(node) OVER () AS top FROM tree) WHERE top > 0 GROUP BY level, node // {hashtree.FAN}
) SELECT level, node, rows, hash FROM tree""",
)
def table_hash_tree(spark, sf):
    """Root, inner nodes and leaves of the line items."""
    return hashtree.hash_tree(table(spark, sf, "lineitem"), "l_orderkey", _LINE, _TREE_WIDTH)


@query(
    "table_changed_ranges",
    f"""SELECT node * {_TREE_WIDTH} AS first_key, node * {_TREE_WIDTH} + {_TREE_WIDTH - 1} AS last_key,
  coalesce(a.rows, 0) AS rows_before, coalesce(b.rows, 0) AS rows_after
FROM ({_tree_sql("lineitem")}) a FULL JOIN ({_tree_sql(f"(SELECT * REPLACE ({_CHANGED} AS l_quantity) FROM lineitem WHERE l_orderkey % 1013 <> 5 OR l_linenumber > 1)")}) b
  USING (node) WHERE a.hash IS DISTINCT FROM b.hash""",
)
def table_changed_ranges(spark, sf):
    """The key ranges in which a copy with some changed and some missing line items differs."""
    lines = table(spark, sf, "lineitem")
    changed = lines.where("l_orderkey % 1013 <> 5 or l_linenumber > 1").withColumn("l_quantity", F.expr(_CHANGED))
    trees = [hashtree.hash_tree(df, "l_orderkey", _LINE, _TREE_WIDTH) for df in (lines, changed)]
    return hashtree.changed_ranges(*trees, width=_TREE_WIDTH)


_FIELDS = ["entity_id", "entity_name", "ef_value", "region", "confidence", "is_outlier"]


@query(
    "quality_completeness",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS field, count({c}) * 1.0::double / count(*) AS share, count({c}) * 1.0::double / count(*) > 0.95 AS meets_target FROM facts"
        for c in _FIELDS
    ),
)
def quality_completeness(spark, sf):
    return quality.completeness(I.facts(spark, sf), _FIELDS)


@query(
    "quality_consistency",
    """SELECT name, sources, round(low, 9) AS low, round(high, 9) AS high, round((high - low) / nullif(abs(low), 0), 9) AS spread FROM (
  SELECT name, count(*) AS sources, min(m) AS low, max(m) AS high
  FROM (SELECT name, source_dataset, avg(ef_value) AS m FROM named_facts GROUP BY 1, 2) GROUP BY 1)
WHERE sources > 1 AND (high - low) / nullif(abs(low), 0) > 0.2""",
)
def quality_consistency(spark, sf):
    found = quality.consistency(I.facts(spark, sf))
    return found.withColumns({c: F.round(c, 9) for c in ("low", "high", "spread")})


@query(
    "quality_timeliness",
    """SELECT source_dataset, count(*) AS rows, count(*) FILTER (cast(timestamp as date) < DATE '2023-06-30' - INTERVAL 36 MONTH) AS stale_rows
FROM facts GROUP BY 1""",
)
def quality_timeliness(spark, sf):
    return quality.timeliness(I.facts(spark, sf), F.lit("2023-06-30"))


@query(
    "quality_conf_bands",
    """SELECT CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low'
  ELSE 'unknown' END AS band, count(*) AS rows FROM facts GROUP BY 1""",
)
def quality_conf_bands(spark, sf):
    return quality.confidence_bands(I.facts(spark, sf))


@query(
    "audit_sample",
    """SELECT id, region, entity_type FROM (
  SELECT id, region, entity_type, row_number() OVER (PARTITION BY region, entity_type ORDER BY md5(id || '|42'), id) AS rn,
    count(*) OVER (PARTITION BY region, entity_type) AS n FROM facts)
WHERE rn <= ceil(0.05::double * n)""",
)
def audit_sample(spark, sf):
    rows = I.facts(spark, sf).select("id", "region", "entity_type")
    return quality.audit_sample(rows, 0.05, ["region", "entity_type"], ["id"])


@query(
    "mape_vs_source",
    """SELECT a.source_dataset, count(*) AS entities, round(avg(abs((a.m - b.m) / nullif(b.m, 0)) * 100), 6) AS mape
FROM (SELECT name, source_dataset, avg(ef_value) AS m FROM named_facts GROUP BY 1, 2) a
JOIN (SELECT name, avg(ef_value) AS m FROM named_facts WHERE source_dataset = 'Trace' GROUP BY 1) b USING (name)
WHERE a.source_dataset <> 'Trace' GROUP BY 1""",
)
def mape_vs_source(spark, sf):
    compared = quality.mape_against(I.facts(spark, sf), "Trace")
    return compared.withColumn("mape", F.round("mape", 6))


@query(
    "filter_critical",
    """SELECT id, entity_id, entity_name, ef_value, entity_id IS NOT NULL AND entity_name IS NOT NULL AND ef_value IS NOT NULL
  AND ef_unit IS NOT NULL AS is_valid FROM facts WHERE ef_value IS NOT NULL AND region IS NOT NULL""",
)
def filter_critical(spark, sf):
    rows = I.facts(spark, sf).dropna(subset=["ef_value", "region"])
    return rows.select("id", "entity_id", "entity_name", "ef_value", quality.record_is_valid().alias("is_valid"))


@query(
    "metadata_about",
    f"""SELECT 'Harmonised factors' AS title, 'Factors of all sources in one schema' AS description, '1.0' AS version, '{I.AS_OF}' AS created_at,
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source_dataset AS s FROM facts)) AS source_datasets,
  count(*) AS record_count, count(DISTINCT region) AS regions, min(confidence) AS least_confidence, max(confidence) AS most_confidence,
  6::BIGINT AS steps, 'ef_value' AS value_column FROM facts""",
)
def metadata_about(spark, sf):
    """The description of a merged table, field by field, as it was written and read back."""
    path = scratch_path(spark, "metadata")
    sinks.write_metadata(I.facts(spark, sf), path, as_of=I.AS_OF)
    about = spark.read.json(f"{path}/about")
    return about.select(
        *("title", "description", "version", "created_at"),
        F.array_join("source_datasets", ",").alias("source_datasets"),
        *("record_count", "regions"),
        F.col("confidence_range")[0].alias("least_confidence"),
        F.col("confidence_range")[1].alias("most_confidence"),
        F.size("processing_steps").cast("bigint").alias("steps"),
        F.filter("columns", lambda c: c == "ef_value")[0].alias("value_column"),
    )


@query(
    "distinct_from_sketches",
    """SELECT event_type, c AS "column", CASE c WHEN 'user_id' THEN u ELSE v END AS exact, true AS within, true AS within_in_other_order
FROM (SELECT event_type, count(DISTINCT user_id) AS u, count(DISTINCT value) AS v FROM events GROUP BY 1), (VALUES ('user_id'), ('value')) t(c)""",
)
def distinct_from_sketches(spark, sf):
    """Distinct counts from stored sketches of every day against exact ones, two percent allowed, merged in two ways."""
    path, columns = scratch_path(spark, "sketches"), ["user_id", "value"]
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    halves = {"odd": F.col("event_id") % 2 == 1, "even": F.col("event_id") % 2 == 0}
    for name, half in halves.items():
        sketches.store_sketches(events.where(half), path, columns, ["event_type", "day"], name)
    merged = sketches.stored_counts(spark, path, ["event_type"])
    per_day = sketches.merged_sketches(spark.read.parquet(path), ["event_type", "day"])
    again = sketches.estimates(sketches.merged_sketches(per_day, ["event_type"])).withColumnRenamed("distinct_values", "again")
    entries = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns))
    exact = events.groupBy("event_type").agg(*(F.count_distinct(c).alias(c) for c in columns)).select("event_type", F.inline(entries))
    both = exact.join(merged, ["event_type", "column"]).join(again, ["event_type", "column"])
    return both.select(
        *("event_type", "column", "exact"),
        (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within"),
        (F.abs(F.col("again") - F.col("exact")) <= 0.02 * F.col("exact")).alias("within_in_other_order"),
    )
