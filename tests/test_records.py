"""Quoted values with line breaks over split files, and types of columns that disagree."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from factorloom.sources import readers, records, sinks, typing


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "800")
    yield
    spark.conf.set(key, before)


PIECES = ["a", "é", '"', ",", "\n", "\r\n", " ", "two words", "\n\n", "5", "\t", "x" * 150, "\\", "😀", ";"]


def value(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 6)))


def test_values_survive_writing_and_reading(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    rows = [(k, value(rng), value(rng)) for k in range(300)] + [(300, " sp ", None), (301, "\r", "\n"), (302, '"', '""'), (303, "a\rb", "-")]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(3)
    sinks.write_csv(df, f"{tmp_path}/t")
    assert records.has_line_breaks(spark, f"{tmp_path}/t")
    back = readers.read_csv(spark, f"{tmp_path}/t", "k int, a string, b string", keep={"a": [""], "b": [""]})
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    blocks = records.records(spark, f"{tmp_path}/t").select("path", "block").distinct().count()
    assert blocks > 10, "several tasks read one file"


@pytest.mark.parametrize("mark", [",", ";", "\t"])
@pytest.mark.parametrize("charset", ["utf-8", "latin1"])
def test_foreign_files(spark, tmp_path, small_blocks, mark, charset):
    rng = random.Random(2)
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=mark, lineterminator="\r\n")
    rows = [(str(k), value(rng).replace("😀", "ü"), f"v{k}") for k in range(200)]
    writer.writerows([("id", "te\nxt", "v"), *rows])
    (tmp_path / "f.txt").write_bytes(out.getvalue().encode(charset))
    got = readers.read_probed(spark, str(tmp_path / "f.txt"))
    assert got.columns == ["id", "te\nxt", "v", "source_file"] and dict(got.dtypes)["id"] == "bigint"
    nulls = set(readers.NULL_TOKENS)
    assert sorted(map(tuple, got.collect())) == sorted((int(a), None if b in nulls else b, c, "f.txt") for a, b, c in rows)


def test_stray_quotes_are_read_by_line(spark, tmp_path, small_blocks):
    (tmp_path / "s.csv").write_text('id,name\n1,5" pipe\n2,"a ""b"" c"\n3,3" pipe\n4,7" x\n' + "5,plain\n" * 60)
    got = readers.read_csv(spark, str(tmp_path / "s.csv"), "id int, name string").collect()
    assert sorted((r["id"], r["name"]) for r in got)[:4] == [(1, '5" pipe'), (2, 'a "b" c'), (3, '3" pipe'), (4, '7" x')]
    assert len(got) == 64
    (tmp_path / "o.csv").write_text('id,name\n1,"never closed\n2,b\n')
    assert readers.read_csv(spark, str(tmp_path / "o.csv"), "id int, name string").count() == 2


def test_plain_files_are_not_scanned_for_records(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,name\n1,"a, b"\n2,c\n')
    assert not records.has_line_breaks(spark, str(tmp_path / "p.csv"))
    assert readers.probe_files(spark, str(tmp_path / "p.csv")).head()["line_breaks"] is False


def test_types_that_disagree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v,w,b,d,e\n1,5,1,true,2024-01-31,\n2,6,2,FALSE,2024-02-29,NA\n")
    (tmp_path / "b.csv").write_text("k,v,w,b,d,e\n3,n.a. yet,1.5,x,2024-03-01 10:00:00,nan\n")
    (tmp_path / "c.csv").write_text('v,k,m\n"two\nlines",4,7\n')
    got = readers.union_files(spark, [str(tmp_path / f"{n}.csv") for n in "abc"])
    kinds = dict(got.dtypes)
    assert (kinds["k"], kinds["v"], kinds["w"], kinds["b"], kinds["d"], kinds["e"], kinds["m"]) == (
        *("bigint", "string", "double", "string", "timestamp", "string", "bigint"),
    )
    rows = {r["k"]: (r["v"], r["w"], r["b"], r["e"], r["m"], r["source_file"]) for r in got.collect()}
    assert rows == {
        1: ("5", 1.0, "true", None, None, "a.csv"),
        2: ("6", 2.0, "FALSE", None, None, "a.csv"),
        3: ("n.a. yet", 1.5, "x", None, None, "b.csv"),
        4: ("two\nlines", None, None, None, 7, "c.csv"),
    }


WANT = {
    "boolean": ["true", "False"],
    "bigint": ["5", " -7 ", "+9", "9223372036854775807"],
    "double": ["1.5", "7", "1e9", "-inf", "92233720368547758070"],
    "date": ["2024-02-29"],
    "timestamp": ["2024-02-29", "2024-02-29 10:00:00", "2024-02-29T10:00"],
    "string": ["2024-02-30", "5"],
}


def test_type_of_a_set_does_not_depend_on_order_or_parts(spark):
    rng = random.Random(3)
    for kind, values in WANT.items():
        for parts in (1, 3):
            shuffled = rng.sample([*values, None, "NaN", ""], len(values) + 3)
            df = spark.createDataFrame([(v,) for v in shuffled], "x string").repartition(parts)
            assert typing.column_types([df]) == {"x": kind}
            halves = [df.where(F.col("x") == values[0]), df.where(F.col("x") != values[0])]
            assert typing.column_types(halves) == {"x": kind}
    mixed = [(["true", "1"], "string"), (["1d"], "string"), (["2024-01-01", "x"], "string"), ([None], "string"), (["0x1"], "string")]
    for values, kind in mixed:
        df = spark.createDataFrame([(v,) for v in values], "x string")
        assert typing.column_types([df]) == {"x": kind}
    assert typing.column_types([]) == {}


def test_types_take_one_job(spark):
    tables = [spark.createDataFrame([("1", "x")], "a string, b string"), spark.createDataFrame([("1.5",)], "a string")]
    group = "column types"
    spark.sparkContext.setJobGroup(group, group)
    assert typing.column_types(tables) == {"a": "double", "b": "string"}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3  # stages that adaptive execution submits, one query
