"""JSON arrays cut into records over split files."""

import json
import random

import pytest

from factorloom.sources import jsonarrays, readers

SCHEMA = "k long, name string, deep struct<a: array<struct<b: string>>, c: map<string, string>>"
PIECES = ["a", "}", "{", '"', "\\", "\n", "[", "]", ",", "é", "😀", "x" * 60, "\\\\", '\\"', "}{", ":"]


def value(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))


def invented(rng, count):
    out = []
    for k in range(count):
        record = {"k": k, "name": value(rng)}
        if rng.random() < 0.4:
            record["deep"] = {"a": [{"b": value(rng)} for _ in range(rng.randint(0, 3))], "c": {value(rng) or "z": value(rng)}}
        out.append(record)
    return out


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700")
    yield
    spark.conf.set(key, before)


def as_dicts(rows):
    out = []
    for r in rows:
        record = {"k": r["k"], "name": r["name"]}
        if r["deep"] is not None:
            record["deep"] = {"a": [{"b": x["b"]} for x in r["deep"]["a"]], "c": r["deep"]["c"]}
        out.append(record)
    return sorted(out, key=lambda r: r["k"])


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_records_of_any_layout(spark, tmp_path, small_blocks, layout):
    records = invented(random.Random(5), 250)
    (tmp_path / "a.json").write_text(json.dumps(records, **layout), encoding="utf-8")
    (tmp_path / "b.json").write_text("\n [ ]\n")
    found = jsonarrays.array_records(spark, str(tmp_path))
    assert found.select("block").distinct().count() > 10, "several tasks read one file"
    got = jsonarrays.read_array(spark, str(tmp_path), SCHEMA)
    assert as_dicts(got.collect()) == records


def test_long_record_spans_blocks(spark, tmp_path, small_blocks):
    records = [{"k": 0, "name": "}" * 5000}, {"k": 1, "name": "s", "deep": {"a": [{"b": "{" * 40}] * 120, "c": {}}}, {"k": 2, "name": ""}]
    (tmp_path / "l.json").write_text(json.dumps(records))
    assert as_dicts(jsonarrays.read_array(spark, str(tmp_path / "l.json"), SCHEMA).collect()) == records


def test_broken_record_is_an_error(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"k": 1}, {"k": tru}]')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        jsonarrays.read_array(spark, str(tmp_path / "x.json"), SCHEMA).collect()


def test_reader_takes_arrays_of_any_size(spark, tmp_path, small_blocks):
    records = [{"instruction": f"i{k}}}", "output": "o\n"} for k in range(200)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps(records))
    (tmp_path / "j" / "b.json").write_text("\n".join(json.dumps(r) for r in records[:3]))
    got = readers.read_json_or_lines(spark, str(tmp_path / "j"))
    assert sorted(r["instruction"] for r in got.collect()) == sorted(r["instruction"] for r in records + records[:3])
