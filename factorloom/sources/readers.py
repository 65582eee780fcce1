"""Reading delimited text and JSON files."""

from __future__ import annotations

import csv
import io
import logging
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.constants import (
    DELIMITERS,
    ENCODINGS,
    EXCHANGE_FLOW_KEYWORDS,
    FLOW_FILE_KEYWORDS,
    JSON_FILE_KEYWORDS,
    NULL_TOKENS,
    TABLE_FILE_KEYWORDS,
    TABLE_FILE_SUFFIXES,
)
from factorloom.functions.numbers import null_nan
from factorloom.functions.text import contains_any
from factorloom.sources import jsonarrays, records, typing

log = logging.getLogger(__name__)

#: Spark's name of a listed encoding, where it has another one.
CHARSETS = {"latin1": "ISO-8859-1"}

#: So much of a header orders the groups of like files; whole headers tell them apart.
ORDER_CHARS = 1000


def nullify_tokens(df: DataFrame, keep: dict[str, list[str]] | None = None) -> DataFrame:
    """Null-like words of delimited text to null, NaN to null.

    ``keep`` names words that are real values of a column, such as ``NA`` for a
    region code.
    """
    typed = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            words = [w for w in NULL_TOKENS if w not in (keep or {}).get(field.name, [])]
            typed[field.name] = F.when(~c.isin(words), c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            typed[field.name] = null_nan(c)
    return df.withColumns(typed) if typed else df


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    separator: str = ",",
    encoding: str = "utf-8",
    keep: dict[str, list[str]] | None = None,
    line_breaks: bool | None = None,
) -> DataFrame:
    """Delimited text with a header. Give a schema for large data; without one it is inferred.

    Quoted values may hold line breaks. ``line_breaks`` says whether some do; left out, one
    scan finds it. Files are split into tasks either way.
    """
    if line_breaks is None:
        line_breaks = records.has_line_breaks(spark, path)
    if line_breaks:
        rows = records.records(spark, path, separator, CHARSETS.get(encoding, encoding))
        header = rows.agg(F.min_by("text", F.struct("path", "block", "record"))).head()[0]
        return _from_records(rows, header or "", schema, separator, keep).drop("source_file")
    reader = _csv_reader(spark, separator, encoding)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nullify_tokens(reader.csv(path), keep)


def _csv_reader(spark: SparkSession, separator: str, encoding: str):
    """Reader of files whose values hold no line breaks."""
    return (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("encoding", CHARSETS.get(encoding, encoding))
        .option("multiLine", False)
        .option("escape", '"')
    )


def header_names(header: str, separator: str) -> list[str]:
    """Column names of a header; one that is missing or met twice gets its place as well, as Spark does."""
    names = next(csv.reader(io.StringIO(header, newline=""), delimiter=separator), [])
    low = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if low.count(n.lower()) > 1 else n for k, n in enumerate(names)]


def _schema(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema


def _from_records(
    rows: DataFrame, header: str, schema: T.StructType | str | None, separator: str, keep: dict[str, list[str]] | None
) -> DataFrame:
    """Values of whole records, with ``source_file``; types are found together if there is no schema."""
    if schema is None:
        return _stacked([_record_texts(rows, header, separator)], None, keep)
    fields = _schema(rows.sparkSession, schema).fields
    values = records.parse(records.without_headers(rows), [f.name for f in fields], [f.dataType.simpleString() for f in fields], separator)
    values = nullify_tokens(values, (keep or {}) | {"path": NULL_TOKENS})
    return values.withColumn("source_file", file_name("path")).drop("path")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; any other trouble in reading it is an error."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def load_datasets(
    spark: SparkSession, paths: dict[str, str], schemas: dict[str, T.StructType | str] | None = None
) -> dict[str, DataFrame]:
    """Read the cleaned CSV of each dataset; absent files are logged and skipped."""
    loaded = {}
    for name, path in paths.items():
        if path_exists(spark, path):
            loaded[name] = read_csv(spark, path, (schemas or {}).get(name))
        else:
            log.warning("dataset file not found: %s", path)
    if not loaded:
        raise ValueError("no dataset could be loaded")
    return loaded


def probe_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """One row per file from one scan: lines, encoding, header, separator and JSON form.

    The text reader keeps raw bytes and UTF-8 never splits a character at a line
    end, so lines are tested apart and large files stay splittable. Latin-1, the
    next encoding in the list, decodes anything. The header is the first line that
    is not blank; the separator is the first of comma, semicolon and tab that
    splits it; a JSON file is an array if its header opens with ``[``. A file has
    ``line_breaks`` in values if a line holds an odd number of quotes; its header may then
    go on in the next line.
    """
    block = F.col("_metadata.file_block_start")
    filled = F.trim("value") != ""
    decoded = F.coalesce(F.try_validate_utf8("value"), F.decode(F.col("value").cast("binary"), CHARSETS[ENCODINGS[1]]))
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.is_valid_utf8("value").alias("valid"),
            F.when(filled, F.struct(block.alias("block"), F.monotonically_increasing_id().alias("row"))).alias("at"),
            F.when(filled, decoded).alias("line"),
            (records.quotes_of("value") % 2 == 1).alias("open"),
        )
    )
    encoding = F.when(F.min("valid"), F.lit(ENCODINGS[0])).otherwise(F.lit(ENCODINGS[1]))
    per_file = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), encoding.alias("encoding"), F.coalesce(F.min_by("line", "at"), F.lit("")).alias("header"),
        F.max("open").alias("line_breaks"),
    )
    separator = F.lit(DELIMITERS[-1])
    for mark in reversed(DELIMITERS):
        separator = F.when(F.col("header").contains(mark), F.lit(mark)).otherwise(separator)
    return per_file.select(
        file_name("path").alias("file_name"),
        "path",
        "lines",
        "encoding",
        "header",
        separator.alias("separator"),
        F.ltrim("header").startswith("[").alias("is_array"),
        "line_breaks",
    )


def probe_encodings(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: name, lines and the first listed encoding that decodes it."""
    return probe_files(spark, path, glob).select("file_name", "path", "lines", "encoding")


def read_probed(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    glob: str = "*",
    separators: bool = True,
    keep: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Delimited files, each read with its own separator and encoding, rows labelled with ``source_file``.

    Files are grouped by header, separator, encoding and line breaks in values, and each
    group is read once; groups are stacked by column name. Without a schema a column has
    the least type that holds its values in all files, found in one job for all groups.
    The driver holds one row per file, as Spark's file index does.
    """
    return _stacked(_probed_parts(spark, path, schema, glob, separators, keep), schema, keep)


def _probed_parts(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None,
    glob: str,
    separators: bool,
    keep: dict[str, list[str]] | None,
) -> list[DataFrame]:
    """One table for each group of like files: typed by the schema, else texts as they are."""
    groups: dict[tuple, list[str]] = {}
    headers: dict[str, str] = {}
    header = [F.substring("header", 1, ORDER_CHARS).alias("opening"), F.md5("header").alias("digest")]
    found = probe_files(spark, path, glob).where("header <> ''")
    for row in found.select("path", "separator", "encoding", "line_breaks", *header).collect():
        mark = row["separator"] if separators else ","
        groups.setdefault((row["opening"], row["digest"], mark, row["encoding"], row["line_breaks"]), []).append(row["path"])
    if schema is None:
        # a whole header comes back once for each kind
        headers = {r["digest"]: r["header"] for r in found.groupBy(F.md5("header").alias("digest")).agg(F.min("header").alias("header")).collect()}
    parts = []
    for (_, digest, mark, encoding, broken), paths in sorted(groups.items()):
        if broken:
            rows = records.records(spark, paths, mark, CHARSETS.get(encoding, encoding))
            first = rows.agg(F.min_by("text", F.struct("path", "block", "record"))).head()[0] if schema is None else ""
            parts.append(_record_texts(rows, first, mark) if schema is None else _from_records(rows, first, schema, mark, keep))
            continue
        reader = _csv_reader(spark, mark, encoding)
        if schema is None:
            names = header_names(headers[digest], mark)
            part = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(paths)
        else:
            part = nullify_tokens(reader.schema(schema).csv(paths), keep)
        parts.append(part.select("*", F.col("_metadata.file_name").alias("source_file")))
    return parts


def _record_texts(rows: DataFrame, header: str, separator: str) -> DataFrame:
    names = header_names(header, separator)
    texts = records.parse(records.without_headers(rows), names, ["string"] * len(names), separator)
    return texts.withColumn("source_file", file_name("path")).drop("path")


def _stacked(parts: list[DataFrame], schema: T.StructType | str | None, keep: dict[str, list[str]] | None) -> DataFrame:
    """Parts stacked by name; texts get their common types first."""
    if not parts:
        raise ValueError("no file could be read")
    if schema is None:
        types = typing.column_types([part.drop("source_file") for part in parts], keep)
        kept = (keep or {}) | {"source_file": NULL_TOKENS}
        parts = [typing.typed(part, types | {"source_file": "string"}, kept) for part in parts]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def probe_delimiter(spark: SparkSession, path: str) -> str:
    """The separator that all files of ``path`` share; an error if they differ."""
    found = [r[0] for r in probe_files(spark, path).where("header <> ''").select("separator").distinct().collect()]
    if len(found) > 1:
        raise ValueError(f"files of {path} have different separators: read them with read_probed")
    return found[0] if found else DELIMITERS[-1]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and base name of every file below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", file_name("path").alias("file_name"), "length")


def _ends_with(name: Column, suffixes: list[str]) -> Column:
    test = F.lit(False)
    for suffix in suffixes:
        test = test | name.endswith(suffix)
    return test


def discover_tables(files: DataFrame) -> DataFrame:
    """Tabular files with an emission keyword in their name, else every tabular file."""
    tables = files.where(_ends_with(F.col("file_name"), TABLE_FILE_SUFFIXES)).withColumn(
        "_hit", contains_any(F.lower("file_name"), TABLE_FILE_KEYWORDS)
    )
    any_hit = tables.agg(F.coalesce(F.max("_hit"), F.lit(False))).scalar()
    return tables.where(F.col("_hit") | ~any_hit).drop("_hit")


def discover_flow_files(files: DataFrame, expected: list[str]) -> DataFrame:
    """The expected files by path ending, else CSV files with a keyword in their name."""
    marked = files.withColumn("_hit", _ends_with(F.col("path"), expected) if expected else F.lit(False))
    any_hit = marked.agg(F.coalesce(F.max("_hit"), F.lit(False))).scalar()
    keyword = F.col("file_name").endswith(".csv") & contains_any("file_name", FLOW_FILE_KEYWORDS)
    return marked.where(F.when(any_hit, F.col("_hit")).otherwise(keyword)).drop("_hit")


def discover_json(files: DataFrame) -> DataFrame:
    named = contains_any(F.lower("file_name"), JSON_FILE_KEYWORDS)
    return files.where(F.col("file_name").endswith(".json") & named)


def union_files(
    spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None, skipped: list[str] | None = None
) -> DataFrame:
    """Stack files of differing columns, each row labelled with its file name.

    The separator of ``.txt`` files is probed, and the encoding of all. Columns whose
    types differ get the type that holds both, in the end text. Absent paths
    are logged, added to ``skipped`` and left out; a file that cannot be read is an
    error, and so is a list without any file.
    """
    there = []
    for path in paths:
        if path_exists(spark, path):
            there.append(path)
        else:
            log.error("no such file: %s", path)
            if skipped is not None:
                skipped.append(path)
    parts = []
    for text in (False, True):
        own = [path for path in there if path.endswith(".txt") == text]
        if own:
            parts += _probed_parts(spark, own, schema, "*", text, None)
    return _stacked(parts, schema, None)


EXCHANGE_SCHEMA = (
    "name string, category struct<name:string>, "
    "exchanges array<struct<flow:struct<name:string>,amount:double,unit:struct<name:string>>>, "
    "flows array<struct<flow:struct<name:string>,amount:double,unit:struct<name:string>>>"
)


def _block_bytes(spark: SparkSession) -> int:
    """Largest part of a file that one task reads."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit[:1]]


def _large_arrays(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """Files that hold an array and are larger than a task reads, and all other files."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").collect()
    large = [row["path"] for row in listed if row["length"] > _block_bytes(spark)]
    if large:
        large = [row["path"] for row in probe_files(spark, large).where("is_array").select("path").collect()]
    # the two listings write the scheme in their own way
    bare = lambda p: re.sub(r"^\w+:/+", "/", p)
    arrays = {bare(p) for p in large}
    return large, [row["path"] for row in listed if bare(row["path"]) not in arrays]


def read_exchanges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Process documents to one row per greenhouse-gas exchange.

    An array of documents that is larger than a task's part of a file is split.
    """
    large, other = _large_arrays(spark, path)
    parts = [jsonarrays.read_array(spark, large, EXCHANGE_SCHEMA)] if large else []
    if other or not parts:
        reader = spark.read.schema(EXCHANGE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        parts.append(reader.json(other if large else path).select("*", F.col("_metadata.file_name").alias("source_file")))
    return explode_exchanges(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def explode_exchanges(documents: DataFrame) -> DataFrame:
    """Exchanges, or flows when there are none, kept if the flow name is a greenhouse gas.

    Missing names read as empty, a missing unit as ``kg``, a missing amount as 0.
    """
    entries = F.when(F.size(F.coalesce("exchanges", F.array())) > 0, F.col("exchanges")).otherwise(F.col("flows"))
    exploded = documents.where("name is not null").select(
        F.col("name").alias("process_name"),
        F.coalesce("category.name", F.lit("")).alias("category"),
        F.explode(entries).alias("_e"),
        "source_file",
    )
    flow = F.coalesce("_e.flow.name", F.lit(""))
    return exploded.where(contains_any(F.lower(flow), EXCHANGE_FLOW_KEYWORDS)).select(
        "process_name",
        "category",
        flow.alias("flow_name"),
        F.coalesce("_e.amount", F.lit(0.0)).alias("amount"),
        F.coalesce("_e.unit.name", F.lit("kg")).alias("unit"),
        "source_file",
    )


MULTIPLIER_RECORD = (
    "region string, sector string, gas_type string, time_period string, multiplier double, "
    "confidence double, description string, reference string, year int"
)


def read_record_array(spark: SparkSession, path: str, field: str, record: str = MULTIPLIER_RECORD) -> DataFrame:
    """Records of one array field of a JSON object."""
    documents = spark.read.schema(f"{field} array<struct<{_nested(record)}>>").option("multiLine", True).json(path)
    return documents.select(F.inline(field))


def _nested(record: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in record.split(",")))


INSTRUCTION_SCHEMA = (
    "instruction string, input string, output string, "
    "metadata struct<regions:array<string>,entity_types:array<string>,difficulty:string,sources:array<string>>"
)


def read_json_or_lines(
    spark: SparkSession, path: str | list[str], schema: str = INSTRUCTION_SCHEMA, whole_file: bool = True
) -> DataFrame:
    """JSON arrays of records and files with one record per line, also side by side.

    The first non-blank character of each file decides: an array opens with ``[``.
    An array may span a whole file and is split where that is larger than a task's part
    of a file; with ``whole_file=False`` arrays must fit on their lines. A record that
    does not parse is an error.
    """
    forms: dict[bool, list[str]] = {False: [], True: []}
    for row in probe_files(spark, path).where("header <> ''").select("path", "is_array").collect():
        forms[row["is_array"] and whole_file].append(row["path"])
    large = []
    if forms[True]:
        large, forms[True] = _large_arrays(spark, forms[True])
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    parts = [reader.option("multiLine", spans).json(paths) for spans, paths in forms.items() if paths]
    if large:
        parts.append(jsonarrays.read_array(spark, large, schema).drop("source_file"))
    if not parts:
        return spark.createDataFrame([], schema)
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def load_train_and_validation(spark: SparkSession, train: str, validation: str) -> tuple[DataFrame, DataFrame]:
    parts = read_json_or_lines(spark, train), read_json_or_lines(spark, validation)
    if any(part.isEmpty() for part in parts):
        raise ValueError("training or validation data is empty")
    return parts
