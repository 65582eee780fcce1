"""Readers, gate, resolver and writers on small files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.catalog import files, shaping
from factorloom.constants import COUNTRY_CODES
from factorloom.operators import profile
from factorloom.plans import harmonize as plan
from factorloom.plans import publish
from factorloom.session import checkpoint_root
from factorloom.sources import canonical, gate, readers, registry, resolve, sinks


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_null_tokens_but_not_a_country_code(spark, tmp_path):
    path = write(tmp_path / "a.csv", "region,name,x\nNA,NA,1.5\nFR,nan,NaN\n")
    got = readers.read_csv(spark, path, "region string, name string, x double", keep={"region": ["NA"]}).collect()
    assert [tuple(r) for r in got] == [("NA", None, 1.5), ("FR", None, None)]


def test_load_datasets_skips_absent_files(spark, tmp_path):
    path = write(tmp_path / "a.csv", "x\n1\n")
    assert list(readers.load_datasets(spark, {"a": path, "b": str(tmp_path / "no.csv")})) == ["a"]
    with pytest.raises(ValueError):
        readers.load_datasets(spark, {"b": str(tmp_path / "no.csv")})


def test_encodings(spark, tmp_path):
    write(tmp_path / "e" / "u.csv", "café\nthé\n")
    write(tmp_path / "e" / "l.csv", "plain\ncafé\n", "latin1")
    got = {r.file_name: (r.encoding, r.lines) for r in readers.probe_encodings(spark, str(tmp_path / "e")).collect()}
    assert got == {"u.csv": ("utf-8", 2), "l.csv": ("latin1", 2)}


@pytest.mark.parametrize("mark", [",", ";", "\t"])
def test_delimiters(spark, tmp_path, mark):
    path = write(tmp_path / "t.txt", f"a{mark}b\n1{mark}2\n")
    assert readers.probe_delimiter(spark, path) == mark


def test_discovery_falls_back_to_every_table(spark, tmp_path):
    for name in ("x/prices.csv", "x/ghg.TXT", "y/notes.md"):
        write(tmp_path / name, "a\n")
    found = readers.discover_tables(readers.list_files(spark, str(tmp_path)))
    assert [r.file_name for r in found.collect()] == ["prices.csv"]
    write(tmp_path / "x/my_CO2.csv", "a\n")
    found = readers.discover_tables(readers.list_files(spark, str(tmp_path)))
    assert [r.file_name for r in found.collect()] == ["my_CO2.csv"]


def test_discovery_of_flows_and_json(spark, tmp_path):
    for name in ("a/import_factor_x.csv", "a/Emission.csv", "b/flow.json", "b/other.json"):
        write(tmp_path / name, "{}\n")
    files = readers.list_files(spark, str(tmp_path))
    assert [r.file_name for r in readers.discover_flow_files(files, ["none.csv"]).collect()] == ["import_factor_x.csv"]
    assert [r.file_name for r in readers.discover_flow_files(files, ["a/Emission.csv"]).collect()] == ["Emission.csv"]
    assert [r.file_name for r in readers.discover_json(files).collect()] == ["flow.json"]


def test_exchanges(spark, tmp_path):
    flow = {"name": "Carbon Dioxide"}
    documents = {
        "p1": {"name": "P", "category": {"name": "C"}, "exchanges": [{"flow": flow, "amount": 2, "unit": {"name": "g"}}, {"flow": {"name": "Water"}}]},
        "p2": {"name": "Q", "exchanges": [], "flows": [{"flow": {"name": "CH4"}}]},
        "p3": {"exchanges": [{"flow": flow}]},
        "p4": {"name": "R"},
    }
    for name, document in documents.items():
        write(tmp_path / "j" / f"{name}.json", json.dumps(document, indent=1))
    got = readers.read_exchanges(spark, str(tmp_path / "j")).orderBy("process_name").collect()
    assert [tuple(r) for r in got] == [
        ("P", "C", "Carbon Dioxide", 2.0, "g", "p1.json"),
        ("Q", "", "CH4", 0.0, "kg", "p2.json"),
    ]


def test_json_array_or_lines(spark, tmp_path):
    records = [{"instruction": "a", "input": "", "output": "b", "metadata": {"regions": ["FR"]}}, {"instruction": "c"}]
    array = write(tmp_path / "a.json", json.dumps(records, indent=2))
    lines = write(tmp_path / "l.json", "\n".join(json.dumps(r) for r in records))
    for path in (array, lines):
        assert sorted(r.instruction for r in readers.read_json_or_lines(spark, path).collect()) == ["a", "c"]
    empty = write(tmp_path / "e.json", "[]")
    with pytest.raises(ValueError):
        readers.load_train_and_validation(spark, array, empty)


def test_record_array(spark, tmp_path):
    path = write(tmp_path / "m.json", json.dumps({"sector_multipliers": [{"region": "X", "multiplier": 1.5}]}, indent=1))
    row = readers.read_record_array(spark, path, "sector_multipliers").head()
    assert (row.region, row.multiplier) == ("X", 1.5)


def test_line_table_gate(spark):
    late = ["a,b,c,d,e"] + ["1"] * 140 + ["<HTML>"] + ["1,2"] * 1000
    files = {
        (None, 1): ["a,b,c,d,e"] + ["1,2,3,4,5"] * 999,
        ("n", 1): ["a,b,c,d"] + ["1,2,3,4"] * 999,
        ("n", 2): ["a,b,c,d,e"] * 999,
        ("late", None): late,
        ("beyond", 0): ["a,b,c,d,e"] + ["x" * 10] * 90 + ["<html>"] + ["1"] * 1000,
        ("one", 0): ["<!DOCTYPE html>"],
    }
    rows = [(*key, i + 1, line) for key, lines in files.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "kind string, part long, place int, value string").repartition(5)
    got = {(r.kind, r.part): (r.is_html, r.has_comma, r.columns, r.lines, r.accepted) for r in gate.check_lines(lines, ["kind", "part"]).collect()}
    assert got == {
        (None, 1): (False, True, 5, 1000, True),
        ("n", 1): (False, True, 4, 1000, False),
        ("n", 2): (False, True, 5, 999, False),
        ("late", None): (True, True, 5, 1142, False),
        ("beyond", 0): (False, True, 5, 1092, True),
        ("one", 0): (True, False, 1, 1, False),
    }


def test_sanity_gate_lands_fewer_files_than_it_checks(spark, tmp_path):
    rows = [(k, k, 1, line, 5.0, "N") for k in [None, *range(0, 50_000, 250)] for line in (1, 2)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    landed = Path(checkpoint_root(spark).removeprefix("file:")) / "factorloom"
    before = set(landed.rglob("part-*"))
    got = shaping.src_sanity_gate(spark, str(tmp_path)).collect()
    assert sorted((r.kind, -1 if r.part is None else r.part, r.is_html, r.columns, r.lines) for r in got) == sorted(
        (kind, part, kind == "web", columns, 3) for part in range(-1, 200) for kind, columns in (("wide", 6), ("narrow", 4), ("web", 6))
    )
    assert len(set(landed.rglob("part-*")) - before) < 50


def test_publish_shapes_every_source_once(spark, tmp_path):
    """The crosswalk takes shaped rows that are written, and those of sources too incomplete for the merged table."""
    schema = (
        "entity_id string, entity_name string, entity_type string, ef_value double, ef_unit string, region string, "
        "source_dataset string, confidence double, timestamp string, tags array<string>, _ord string"
    )
    row = lambda k, name: (f"e{k}", name, "product", 1.0, "kg CO2e", "FR", "s", 0.5, "2025-01-01", ["a"], f"{k:03d}")
    shaped = spark.sparkContext.accumulator(0)

    def seen(name):
        shaped.add(1)
        return name

    one = spark.createDataFrame([row(1, "Steel"), row(2, None), row(5, "zinc")], schema).withColumn("entity_name", F.udf(seen)("entity_name"))
    two = spark.createDataFrame([row(3, "steel"), row(3, "STEEL")], schema)
    bare = spark.createDataFrame([("b1", "Zinc", "000"), ("b2", "steel", "009")], "entity_id string, entity_name string, _ord string")
    datasets = {"one": one, "two": two, "bare": bare, "other": two.drop("entity_id", "ef_unit")}
    expected = sorted(map(tuple, plan.entity_crosswalk(datasets).collect()))
    before = shaped.value
    publish.publish(datasets, str(tmp_path / "out"))
    assert shaped.value - before == 3
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "crosswalk")).collect()
    assert sorted((*r[:6], float(r[6])) for r in back) == expected and len(expected) == 4


def test_csv_files_are_small_enough_for_their_checksums(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_csv(spark.range(0, 250_000, 1, 1), out)
    files = list(Path(out).glob("part-*.csv"))
    assert len(files) == 3 and spark.read.text(f"{out}.md5").count() == 3
    assert spark.read.option("header", True).csv(out).distinct().count() == 250_000


def test_header_filter_reads_every_text(spark, tmp_path):
    rows = [(1, "city Emissions\nrest"), (2, "plain words\nco2"), (3, ""), (4, None), (5, " CH4 x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = shaping.filter_table_header(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (5, 3)]


def test_file_gate(spark, tmp_path):
    good = "a,b,c,d,e\n" + "1,2,3,4,5\n" * 1200
    write(tmp_path / "g" / "good.csv", good)
    write(tmp_path / "g" / "short.csv", "a,b,c,d,e\n1,2,3,4,5\n")
    write(tmp_path / "g" / "page.csv", "x,\n<HTML>,a,b,c,d\n" + "1,2,3,4,5\n" * 1200)
    got = {r.file_name: r for r in gate.check_files(spark, str(tmp_path / "g")).collect()}
    assert {n: r.accepted for n, r in got.items()} == {"good.csv": True, "short.csv": False, "page.csv": False}
    assert (got["good.csv"].lines, got["good.csv"].columns, got["page.csv"].is_html) == (1201, 5, True)
    one_text = spark.createDataFrame([(good,)], "t string").select(*gate.verdict("t")).head()
    assert (one_text.lines, one_text.columns, one_text.accepted) == (1201, 5, True)


def test_table_header_filter(spark):
    df = spark.createDataFrame([(["Year", " GHG total"],), (["Year", "x co2"],)], "c array<string>")
    assert [r[0] for r in df.select(gate.is_relevant_table("c")).collect()] == [True, False]


def schema(*names, kind=T.DoubleType):
    return T.StructType([T.StructField(n, kind()) for n in names])


def test_roles_of_products():
    found = resolve.product_roles(schema("LCI_Name", "ProductName", "PEF_categoria", "Climate_change", "Unit", "DQR"))
    assert found == {
        "name": "LCI_Name", "id": "LCI_Name", "category": "PEF_categoria",
        "quality": "DQR", "unit": "Unit", "value": "Climate_change",
    }
    assert resolve.product_roles(schema("LCI_Name", "ProductName", "x"), {"name": "ProductName"})["name"] == "ProductName"
    with pytest.raises(ValueError):
        resolve.product_roles(schema("a", "b", kind=T.StringType))


def test_roles_with_numeric_fallback():
    assert resolve.product_region_roles(schema("Country", "Product", "Amount"))["value"] == "Amount"
    assert resolve.flow_roles(schema("Year", "Amount"))["value"] == "Amount"
    assert resolve.flow_roles(schema("Year"))["value"] is None


def test_products_without_an_id_are_numbered(spark):
    raw = spark.createDataFrame([(1, "b, x", 2.0), (0, "a", 3.0), (2, "c", None)], "_ord int, title string, amount double")
    got = canonical.product(raw, "2025-01-01", {"name": "title"}).orderBy("_ord").collect()
    assert [(r.entity_id, r.entity_name, r.tags) for r in got] == [("0", "a", ["Unknown"]), ("1", "b x", ["Unknown"])]


def test_period_groups_skip_null_keys_and_nan_values(spark):
    raw = spark.createDataFrame(
        [("usa", "electricity", "coal_fired", 2020, 1.0, 0.5), ("usa", "electricity", "coal_fired", 2020, float("nan"), 0.7), (None, "a", "b", 2020, 1.0, 1.0)],
        "country_id string, sector string, subsector string, year int, value double, confidence double",
    )
    (row,) = canonical.period(raw, "2025-01-01").collect()
    assert (row.entity_name, row.entity_type, row.region, row.ef_value) == ("Coal Fired in Electricity", "energy", "USA", 1e9)
    assert row.confidence == pytest.approx(0.6)


def test_flows_without_regional_files_are_all_us(spark):
    raw = spark.createDataFrame(
        [(0, "1111A0", "CO2", "5", "import.csv"), (1, "22", "CO2", "bad", "import.csv"), (2, "1111A0", "CO2", "5", "import.csv")],
        "_ord int, Sector string, Flowable string, FlowAmount string, source_file string",
    )
    (row,) = canonical.flow(raw, "2025-01-01").collect()
    assert (row.region, row.ef_unit, row.tags) == ("US", "kg CO2e/USD", ["Flow:CO2", "Context:Unknown", "Level:Unknown"])


def test_product_region_covers_every_country(spark):
    rows = [(i, name, f"P{p}", 1.0) for i, (name, p) in enumerate((n, p) for n in COUNTRY_CODES.values() for p in range(21))]
    raw = spark.createDataFrame(rows, "_ord int, CountryName string, Product string, CO2 double")
    assert canonical.product_region(raw, "2025-01-01").count() == 49 * 21


def test_multiplier_metadata_modes(spark):
    raw = spark.createDataFrame(
        [(0, "Europe", "Transport: Road", "CO2", "1990-2000", 1.2, 0.8)],
        "_ord int, region string, sector string, gas_type string, time_period string, multiplier double, confidence double",
    )
    for mode, gas in (("reference", None), ("exact", "CO2")):
        row = canonical.multiplier(raw, "2025-01-01", mode).head()
        assert json.loads(row.metadata)["gas_type"] == gas
    assert row.entity_id == "IPCC_AR6_Europe_Transport:_Road_CO2_1990_2000"
    assert row.tags[-1] == "region_code:EUR"


def small(spark):
    rows = [(i, f"e{i}", "n", "product", 1.0, "t CO2e", "FR", "S", 0.5, "2025-01-01", ["sector:x"]) for i in range(5)]
    return spark.createDataFrame(
        rows,
        "_ord int, entity_id string, entity_name string, entity_type string, ef_value double, ef_unit string, "
        "region string, source_dataset string, confidence double, timestamp string, tags array<string>",
    )


def test_harmonize_without_multipliers(spark):
    got = plan.harmonize({"product": small(spark)})
    assert got.count() == 5 and "multiplier_applied" not in got.columns
    assert {r.ef_value for r in got.collect()} == {1000.0}


def test_csv_with_checksums(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_csv(small(spark), path)
    listed = {r.value for r in spark.read.text(f"{path}.md5").collect()}
    assert listed == {f"{r.md5}  {r.file_name}" for r in sinks.checksums(spark, path).collect()}
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert {r.tags for r in back.collect()} == {'["sector:x"]'}


def test_summary_and_metadata_files(spark, tmp_path):
    sinks.write_summary(small(spark), str(tmp_path / "s"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert "Total records: 5" in lines and "- product: 5" in lines and "- FR: 5" not in lines
    sinks.write_metadata(small(spark), str(tmp_path / "m"))
    found = {(r.section, r.item): r.value for r in spark.read.json(str(tmp_path / "m" / "counts")).collect()}
    about = spark.read.json(str(tmp_path / "m" / "about")).head()
    assert about.record_count == 5 and about.version == "1.0" and "ef_value" in about["columns"] and about.processing_steps
    assert found[("total", "record_count")] == 5.0 and found[("distinct", "region")] == 1.0


def test_instruction_files(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("key"))
    sinks.write_instruction_set(df, str(tmp_path / "i"), ["key"])
    sizes = [spark.read.json(str(tmp_path / n)).count() for n in ("i", "i_train", "i_val")]
    assert sizes == [50, 40, 10]


def test_fingerprint_ignores_order(spark):
    df = small(spark)
    assert profile.fingerprint(df).head() == profile.fingerprint(df.orderBy(F.desc("_ord")).repartition(3)).head()
    assert profile.fingerprint(df).head() != profile.fingerprint(df.where("_ord > 0")).head()


def test_registry(spark):
    sources = registry.Registry()
    spec = registry.SourceSpec("toy", lambda s, path: small(s), lambda raw, as_of=None: raw)
    sources.add(spec)
    with pytest.raises(ValueError):
        sources.add(spec)
    assert set(sources.load_all(spark, {"toy": "x", "other": "y"})) == {"toy"}
    assert len(registry.CANONICALIZERS) == 9


def test_mixed_json_folder_keeps_every_record(spark, tmp_path):
    write(tmp_path / "j" / "a.json", '{"instruction": "a"}\n{"instruction": "b"}\n')
    write(tmp_path / "j" / "b.json", '\n[{"instruction": "c"},\n {"instruction": "d"}]\n')
    write(tmp_path / "j" / "c.json", '  [{"instruction": "e"}]')
    got = readers.read_json_or_lines(spark, str(tmp_path / "j"))
    assert sorted(r.instruction for r in got.collect()) == ["a", "b", "c", "d", "e"]
    write(tmp_path / "k" / "a.json", '{"instruction": "a"}\n{"instr')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.read_json_or_lines(spark, str(tmp_path / "k")).collect()


def test_files_are_read_as_they_are(spark, tmp_path):
    write(tmp_path / "m" / "a.txt", "n;é\n1;é\n")
    write(tmp_path / "m" / "b.txt", "n;é\n2;ü\n", "latin1")
    write(tmp_path / "m" / "c.txt", "\nn\tx\n3\ty\n")
    got = readers.read_probed(spark, str(tmp_path / "m"))
    assert sorted((r.n, r["é"], r.x, r.source_file) for r in got.collect()) == [
        (1, "é", None, "a.txt"),
        (2, "ü", None, "b.txt"),
        (3, None, "y", "c.txt"),
    ]
    with pytest.raises(ValueError, match="different separators"):
        readers.probe_delimiter(spark, str(tmp_path / "m"))


def test_only_absent_files_are_skipped(spark, tmp_path):
    path = write(tmp_path / "u.csv", "a,b\n1,2\n")
    skipped = []
    assert readers.union_files(spark, [path, str(tmp_path / "none.csv")], skipped=skipped).count() == 1
    assert skipped == [str(tmp_path / "none.csv")]
    with pytest.raises(ValueError, match="no file"):
        readers.union_files(spark, [str(tmp_path / "none.csv")])


def _landed(monkeypatch, tmp_path, records):
    """Files that a query writes go to ``tmp_path / "out"``, about ``records`` records to each."""
    monkeypatch.setattr(files, "scratch_path", lambda spark, name: str(tmp_path / "out"))
    monkeypatch.setattr(files, "FILE_RECORDS", records, raising=False)


def test_record_arrays_stay_bounded_in_a_large_region(spark, tmp_path, monkeypatch):
    _landed(monkeypatch, tmp_path, 50)
    rows = spark.range(2000).selectExpr("id AS c_custkey", "0L AS c_nationkey", "'BUILDING' AS c_mktsegment")
    rows.write.parquet(str(tmp_path / "sf" / "customer.parquet"))
    back = files.src_json_inline(spark, str(tmp_path / "sf"))
    assert back.agg(F.sum("rows")).head()[0] == 2000
    sizes = [len(json.loads(p.read_text())["sector_multipliers"]) for p in (tmp_path / "out").rglob("*.json")]
    assert sum(sizes) == 2000 and max(sizes) < 120


def test_equal_documents_are_dealt_over_files(spark, tmp_path, monkeypatch):
    _landed(monkeypatch, tmp_path, 50)
    rows = spark.range(2000).selectExpr("60 * id AS event_id", "'click' AS event_type", "1L AS user_id", "2.0D AS value")
    rows.write.parquet(str(tmp_path / "sf" / "events.parquet"))
    got = files.src_json_exchanges(spark, str(tmp_path / "sf"))
    expected = readers.explode_exchanges(files.I.process_documents(spark, str(tmp_path / "sf")))
    assert got.agg(F.sum("rows")).head()[0] == expected.count() > 0
    sizes = [len(json.loads(p.read_text())) for p in (tmp_path / "out").rglob("*.txt")]
    assert sum(sizes) == 2000 and max(sizes) < 120


def test_wide_headers_are_told_apart_by_their_ends(spark, tmp_path):
    wide = ",".join(f"column_{k:06d}" for k in range(800))
    for name, ends in (("a", "x,y"), ("b", "y,x")):
        write(tmp_path / f"{name}.csv", f"{wide},{ends}\n" + "0," * 800 + "1,2\n")
    got = readers.union_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(tuple, got.select("source_file", "x", "y").collect())) == [("a.csv", 1, 2), ("b.csv", 2, 1)]


def test_separator_behind_a_long_first_name(spark, tmp_path):
    path = write(tmp_path / "t.txt", "a" * 12_000 + ";b\n1;2\n")
    assert readers.probe_delimiter(spark, path) == ";"
