"""Queries that read files. Given tables are first written as files in the shared folder."""

from __future__ import annotations

import logging

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorloom.catalog import inputs as I
from factorloom.catalog.base import query, table
from factorloom.operators import merge
from factorloom.plans import publish
from factorloom.plans.harmonize import Options
from factorloom.plans.snapshots import Published, load_interim
from factorloom.session import scratch_path
from factorloom.sources import canonical, jsonarrays, readers, sinks
from factorloom.sources.registry import Registry, SourceSpec

log = logging.getLogger(__name__)

#: Records that are written to one JSON file, on average of the files of a kind.
FILE_RECORDS = 10_000


def _dealt(df, key: str, *by: str):
    """``df`` with ``g``, the number of a file among those of equal ``by``.

    The largest count measured says how many files there are, and the hash of a unique
    ``key`` deals the rows, so equal contents are spread as well.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.coalesce(F.max("n"), F.lit(0))).head()[0]
    files = max(1, -(-most // FILE_RECORDS))
    return df.withColumn("g", F.pmod(F.xxhash64(key), F.lit(files)))


def _one_per_file(df):
    """Writer that gives every row a file of its own."""
    return df.write.option("maxRecordsPerFile", 1)


@query(
    "src_csv_roundtrip",
    """SELECT _ord AS row_key, entity_id, entity_name, ef_value, region, array_to_string(tags, '|') AS tags, 1.0 AS checksums_match FROM can_flow""",
)
def src_csv_roundtrip(spark, sf):
    """Canonical rows to CSV with checksums and back."""
    path = scratch_path(spark, "flow-csv")
    sinks.write_csv(I.canonical_flow(spark, sf), path)
    schema = (
        "entity_id string, entity_name string, entity_type string, ef_value double, ef_unit string, region string, "
        "source_dataset string, confidence double, timestamp string, tags string, _ord string"
    )
    back = readers.load_datasets(spark, {"flow": path, "absent": f"{path}-absent"}, {"flow": schema})["flow"]
    written = spark.read.text(f"{path}.md5").select(F.split("value", "  ")[0].alias("md5"))
    same = sinks.checksums(spark, path).join(written.withColumn("hit", F.lit(1.0)), "md5", "left")
    matching = same.agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("m")).scalar()
    return back.select(
        F.col("_ord").alias("row_key"),
        "entity_id",
        "entity_name",
        "ef_value",
        "region",
        F.array_join(F.from_json("tags", "array<string>"), "|").alias("tags"),
        matching.alias("checksums_match"),
    )


@query(
    "src_encoding_probe",
    r"""SELECT v.encoding, doc_id, md5(text) AS digest FROM (
  SELECT doc_id, regexp_replace(text, '[\r\n]', ' ', 'g') AS text, regexp_matches(text, '[^\x{00}-\x{ff}]') AS wide FROM documents
) d, (VALUES ('utf-8'), ('latin1')) v(encoding) WHERE NOT (wide AND v.encoding = 'latin1')""",
)
def src_encoding_probe(spark, sf):
    """Every text in UTF-8 and, where that can hold it, in Latin-1, read back with the encoding found for its file."""
    path = scratch_path(spark, "encodings")
    # a header with a letter that the two encodings write differently
    flat = table(spark, sf, "documents").select(
        "doc_id",
        F.regexp_replace("text", r"[\r\n]", " ").alias("caf\u00e9"),
        F.col("text").rlike(r"[^\x{00}-\x{ff}]").alias("wide"),
    )
    rows = flat.select("doc_id", "caf\u00e9")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(f"{path}/utf8")
    rows.where(~flat["wide"]).write.options(**options, encoding="ISO-8859-1").csv(f"{path}/latin1")
    found = readers.probe_files(spark, path, "part-*").groupBy("encoding").agg(F.collect_list("path").alias("paths"))
    result = None
    for group in found.collect():
        back = readers.read_csv(spark, group["paths"], "doc_id bigint, value string", encoding=group["encoding"], keep={"value": readers.NULL_TOKENS})
        part = back.select(F.lit(group["encoding"]).alias("encoding"), "doc_id", F.md5(F.coalesce("value", F.lit(""))).alias("digest"))
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "src_delimiter_probe",
    """SELECT v.file, v.separator, n_name, c.customers FROM nation
JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey,
  (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9))) v(file, separator)""",
)
def src_delimiter_probe(spark, sf):
    """The same rows with three separators; each file's own is found from its header."""
    path = scratch_path(spark, "delimiters")
    rows = table(spark, sf, "nation").join(
        table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")),
        F.col("c_nationkey") == F.col("n_nationkey"),
    )
    marks = {"comma": ",", "semicolon": ";", "tab": "\t"}
    for name, mark in marks.items():
        # the last column's name tells the copies apart
        named = rows.select("n_nationkey", "n_name", F.col("customers").alias(f"customers_{name}"))
        named.write.mode("append").option("header", True).option("sep", mark).csv(path)
    back = readers.read_probed(spark, path, glob="part-*")
    counts = [F.struct(F.lit(name).alias("file"), F.lit(mark).alias("separator"), F.col(f"customers_{name}").cast("bigint").alias("customers")) for name, mark in marks.items()]
    return back.select("n_name", F.inline(F.array(*counts))).where("customers is not null")


@query(
    "src_file_discovery",
    "SELECT 'ghg_emission.csv' AS file_name, count(*) AS rows FROM part WHERE p_size > 25",
)
def src_file_discovery(spark, sf):
    """Files found by keyword, with the rows each one holds."""
    path = scratch_path(spark, "discovery")
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    parts.where("p_size > 25").write.option("header", True).csv(f"{path}/ghg_emission.csv")
    parts.where("p_size <= 25").write.option("header", True).csv(f"{path}/prices.csv")
    # a Spark table is a folder: its name stands for the file's
    folder = F.element_at(F.split("path", "/"), -2)
    files = readers.list_files(spark, path).where(F.col("file_name").startswith("part-"))
    listed = files.withColumn("file_name", folder)
    found = readers.discover_tables(listed).select("file_name").distinct()
    rows = (
        spark.read.option("header", True)
        .option("recursiveFileLookup", True)
        .csv(path)
        .select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("file_name"))
        .groupBy("file_name")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return rows.join(found, "file_name", "left_semi")


@query(
    "src_union_files",
    """SELECT p_partkey AS key, p_name AS name, CAST(NULL AS double) AS price, false AS from_text FROM part
UNION ALL SELECT s_suppkey, s_name, s_acctbal, true FROM supplier""",
)
def src_union_files(spark, sf):
    """Two file sets with different columns, one tab-separated, stacked by name; a missing one is skipped."""
    path = scratch_path(spark, "union")
    table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")).write.option(
        "header", True
    ).csv(f"{path}/a.csv")
    table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("price")
    ).write.option("header", True).option("sep", "\t").csv(f"{path}/b.txt")
    paths = [f"{path}/a.csv", f"{path}/missing.csv", f"{path}/b.txt"]
    stacked = readers.union_files(spark, paths)
    return stacked.select(
        F.col("key").cast("bigint").alias("key"), "name", "price", F.col("price").isNotNull().alias("from_text")
    )


@query(
    "src_json_exchanges",
    """SELECT process_name, category, flow_name, unit, count(*) AS rows, round(sum(amount), 4) AS amount FROM raw_process GROUP BY 1, 2, 3, 4""",
)
def src_json_exchanges(spark, sf):
    """Nested process documents written as JSON, read back and exploded."""
    path = scratch_path(spark, "process-json")
    documents = I.process_documents(spark, sf)
    # every file holds one array of documents, a document on each of its lines
    document = F.struct(*(c for c in documents.columns if c not in ("event_id", "source_file")))
    packed = _dealt(documents, "event_id").select("g", F.to_json(document).alias("d"))
    files = packed.groupBy("g").agg(F.concat(F.lit("["), F.array_join(F.collect_list("d"), ",\n"), F.lit("]")).alias("value"))
    _one_per_file(files.select("value")).text(path)
    exchanges = readers.read_exchanges(spark, path)
    return exchanges.groupBy("process_name", "category", "flow_name", "unit").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("amount"), 4).alias("amount")
    )


@query(
    "src_json_inline",
    """SELECT region, sector, gas_type, time_period, count(*) AS rows, round(sum(multiplier), 6) AS multiplier FROM raw_multiplier GROUP BY 1, 2, 3, 4""",
)
def src_json_inline(spark, sf):
    """JSON objects that hold an array of records: each in a file of its own, as many per region as its rows ask for."""
    path = scratch_path(spark, "records-json")
    record = F.struct("region", "sector", "gas_type", "time_period", "multiplier", "confidence")
    dealt = _dealt(I.raw_multiplier(spark, sf), "_ord", "region")
    rows = dealt.groupBy("region", "g").agg(F.collect_list(record).alias("sector_multipliers"))
    _one_per_file(rows.select("sector_multipliers")).json(path)
    back = readers.read_record_array(spark, path, "sector_multipliers")
    return back.groupBy("region", "sector", "gas_type", "time_period").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("multiplier"), 6).alias("multiplier")
    )


@query(
    "src_json_or_jsonl",
    """SELECT form, conv_id, turn, md5(text) AS digest FROM conversations, (VALUES ('array'), ('lines')) v(form)""",
)
def src_json_or_jsonl(spark, sf):
    """The same records as JSON lines and as JSON arrays, side by side in one folder."""
    path = scratch_path(spark, "instructions")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    turns.withColumn("form", F.lit("lines")).write.json(path)
    record = F.struct("conv_id", "turn", "text", F.lit("array").alias("form"))
    # every line becomes an array of its own
    turns.select(F.to_json(F.array(record)).alias("value")).write.mode("append").text(path)
    back = readers.read_json_or_lines(spark, path, "conv_id bigint, turn bigint, text string, form string", whole_file=False)
    return back.select("form", "conv_id", "turn", F.md5("text").alias("digest"))


@query(
    "sink_parquet_by_source",
    "SELECT source_dataset, region, count(*) AS rows FROM facts WHERE source_dataset = 'Trace' GROUP BY 1, 2",
)
def sink_parquet_by_source(spark, sf):
    """Partitioned copy of the fact table, read back with a partition filter."""
    path = scratch_path(spark, "facts-by-source")
    sinks.write_parquet(I.facts(spark, sf), path)
    kept = spark.read.parquet(path).where("source_dataset = 'Trace'")
    return kept.groupBy("source_dataset", "region").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "pipeline_outputs",
    """SELECT 'data' AS name, count(*) AS rows FROM harmonized
UNION ALL SELECT 'crosswalk', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM harmonized WHERE entity_name IS NOT NULL
  GROUP BY trim(regexp_replace(lower(entity_name), '[^a-z0-9]', ' ', 'g')))
UNION ALL SELECT 'metadata/about', count(*) FROM harmonized
UNION ALL SELECT 'graph/regions', count(DISTINCT region) FROM harmonized
UNION ALL SELECT 'graph/entity_types', count(DISTINCT entity_type) FROM harmonized
UNION ALL SELECT 'graph/sources', count(DISTINCT source_dataset) FROM harmonized
UNION ALL SELECT t, (SELECT count(*) FROM harmonized) FROM (VALUES ('graph/emission_factors'), ('graph/ef_to_region'),
  ('graph/ef_to_entity_type'), ('graph/ef_to_source')) v(t)
UNION ALL SELECT 'graph/region_hierarchy', 8""",
)
def pipeline_outputs(spark, sf):
    """Rows of everything that one run writes, read back; for the description, the records it states."""
    path = scratch_path(spark, "outputs")
    publish.publish(I.datasets(spark, sf), path, Options(unit_mode="reference"), I.AS_OF)
    about = spark.read.schema("record_count bigint").json(f"{path}/metadata/about")
    result = about.select(F.lit("metadata/about").alias("name"), F.col("record_count").alias("rows"))
    tables = ["regions", "entity_types", "sources", "emission_factors", "ef_to_region", "ef_to_entity_type", "ef_to_source", "region_hierarchy"]
    for name in ["data", "crosswalk", *(f"graph/{t}" for t in tables)]:
        back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/{name}")
        result = result.unionByName(back.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows"))
    return result


@query(
    "src_csv_multiline",
    r"""SELECT doc_id, md5(text) AS digest, length(text) AS n_chars, length(text) - length(replace(text, chr(10), '')) AS n_breaks, source, lang
FROM (SELECT * REPLACE (CASE WHEN text IN ('NA', 'N/A', 'null', 'None', 'nan', 'NaN', 'NULL', 'n/a') THEN '' ELSE coalesce(text, '') END AS text) FROM documents)""",
)
def src_csv_multiline(spark, sf):
    """Whole texts with their line breaks, quotes and outer spaces, written as CSV and read back."""
    path = scratch_path(spark, "multiline")
    sinks.write_csv(table(spark, sf, "documents").select("doc_id", "text", "source", "lang"), path)
    back = readers.read_csv(spark, path, "doc_id bigint, text string, source string, lang string")
    return back.withColumn("text", F.coalesce("text", F.lit(""))).select(
        "doc_id",
        F.md5("text").alias("digest"),
        F.length("text").cast("bigint").alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("n_breaks"),
        "source",
        "lang",
    )


@query(
    "src_mixed_types",
    """SELECT c_custkey AS key, c_name AS name, floor(c_acctbal)::BIGINT::VARCHAR AS v, floor(c_acctbal) AS w, 'bigint,string,string,double' AS types FROM customer
UNION ALL SELECT o_orderkey, NULL, o_orderpriority, NULL, 'bigint,string,string,double' FROM orders
UNION ALL SELECT p_partkey, p_name, p_size::VARCHAR, p_size + 0.25, 'bigint,string,string,double' FROM part""",
)
def src_mixed_types(spark, sf):
    """Three file sets in which ``v`` is whole, text and whole, and ``w`` whole, absent and decimal, stacked without a schema."""
    path = scratch_path(spark, "mixed")
    whole = F.floor("c_acctbal")
    parts = {
        "a.csv": table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), whole.alias("v"), whole.alias("w")),
        "b.txt": table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("v")),
        "c.csv": table(spark, sf, "part").select(
            F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("v"), (F.col("p_size") + 0.25).alias("w")
        ),
    }
    for name, df in parts.items():
        df.write.options(**sinks.CSV_OPTIONS, sep="\t" if name.endswith(".txt") else ",").csv(f"{path}/{name}")
    stacked = readers.union_files(spark, [f"{path}/{name}" for name in parts])
    kinds = dict(stacked.dtypes)
    types = F.lit(",".join(kinds[c] for c in ("key", "name", "v", "w")))
    return stacked.select("key", "name", "v", "w", types.alias("types"))


@query(
    "publish_sets",
    """SELECT v.number, v.part, v.rows, v.reused FROM (
  SELECT 1 AS number, 'interim/product' AS part, (SELECT count(*) FROM can_product) AS rows, false AS reused
  UNION ALL SELECT 2, 'interim/product', (SELECT count(*) FROM can_product WHERE entity_id::BIGINT % 10 <> 0), false
  UNION ALL SELECT n, 'interim/factor', (SELECT count(*) FROM can_factor), n = 2 FROM (VALUES (1), (2)) s(n)
  UNION ALL SELECT n, p, (SELECT count(*) FROM can_factor) + (SELECT count(*) FROM can_product WHERE n = 1 OR entity_id::BIGINT % 10 <> 0), false
  FROM (VALUES (1), (2)) s(n), (VALUES ('merged'), ('data')) t(p)) v""",
)
def publish_sets(spark, sf):
    """Two published sets, one of two sources changed in between; rows as read back through the manifest."""
    path = scratch_path(spark, "sets")
    published, result = Published(spark, path), None
    for number in (1, 2):
        sources = Registry()
        read = lambda s, _, number=number: I.raw_product(s, sf).where(F.lit(number == 1) | (F.col("LCI_Code") % 10 != 0))
        sources.add(SourceSpec("product", read, canonical.product))
        sources.add(SourceSpec("factor", lambda s, _: I.raw_factor(s, sf), canonical.factor))
        writing = published.begin()
        datasets = load_interim(spark, sources, {"product": sf, "factor": sf}, writing, I.AS_OF)
        merge.merge(datasets).write.parquet(writing.path("merged"))
        merged = spark.read.parquet(writing.path("merged"))
        known = writing.add("merged", "parquet", merged, lambda out: None)
        writing.add("data", "csv", merged, lambda out, merged=merged: sinks.write_csv(merged, out), known=known)
        writing.commit()
        for row in published.current().select("part", "path", "kind").collect():
            kept = "sets/00000001-" in row["path"] and number == 2
            back = published.read(row["part"]) if row["kind"] == "parquet" else readers.read_csv(spark, row["path"], merged.drop("tags").schema.add("tags", "string"))
            counted = back.agg(F.lit(number).alias("number"), F.lit(row["part"]).alias("part"), F.count(F.lit(1)).alias("rows"), F.lit(kept).alias("reused"))
            result = counted if result is None else result.unionByName(counted)
    return result


@query(
    "src_json_array",
    "SELECT event_id, user_id, event_type, value, md5(props) AS digest FROM events",
)
def src_json_array(spark, sf):
    """All events as JSON arrays of many records each, over many lines, cut into records again."""
    path = scratch_path(spark, "events-json")
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))
    dealt = _dealt(table(spark, sf, "events").withColumn("text", record), "event_id").select("g", "event_id", "text")
    # the first record of a file opens the array, the others follow a comma
    first = F.row_number().over(Window.partitionBy("g").orderBy("event_id")) == 1
    lines = dealt.withColumn("text", F.concat(F.when(first, "[").otherwise(","), "text"))
    ends = dealt.select("g").distinct().select("g", F.lit(None).cast("bigint").alias("event_id"), F.lit("]").alias("text"))
    ordered = lines.unionByName(ends).repartition("g").sortWithinPartitions("g", F.col("event_id").asc_nulls_last())
    ordered.select("g", F.col("text").alias("value")).write.partitionBy("g").text(path)
    schema = "event_id bigint, user_id bigint, event_type string, value double, props string"
    back = jsonarrays.read_array(spark, path, schema)
    return back.select("event_id", "user_id", "event_type", "value", F.md5("props").alias("digest"))
