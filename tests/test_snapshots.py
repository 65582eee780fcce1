"""Hash trees, published sets and what a broken run leaves."""

import hashlib

import pytest
from pyspark.sql import functions as F

from factorloom.operators import hashtree
from factorloom.plans import publish, snapshots
from factorloom.plans.snapshots import Published
from factorloom.sources import sinks
from factorloom.sources.registry import Registry, SourceSpec


def table(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, x double")


ROWS = [(k, f"v{k}", k / 4) for k in range(5000)] + [(7, None, None), (7, "N", 1.0), (None, "no key", 2.0)]


def test_tree_does_not_depend_on_order(spark):
    trees = [hashtree.hash_tree(table(spark, ROWS).repartition(n).orderBy(F.rand(n)), "k", width=10) for n in (1, 5)]
    found = [{(r["level"], r["node"]): (r["rows"], r["hash"]) for r in t.collect()} for t in trees]
    assert found[0] == found[1] and hashtree.root(trees[0])[0] == len(ROWS)
    assert {level for level, _ in found[0]} == {0, 1, 2, 3}
    assert sum(level == 3 for level, _ in found[0]) == 1
    one = hashlib.md5()
    below = sorted((node, h) for (level, node), (_, h) in found[0].items() if level == 1 and node >= 0)
    one.update(",".join(f"{n}:{h}" for n, h in below).encode())
    assert found[0][(2, 0)][1] == one.hexdigest()


def test_changed_ranges(spark):
    before = table(spark, ROWS)
    changed = [(k, v if k != 4321 else "other", x) for k, v, x in ROWS if k not in (90, 91)] + [(90, "v91", 22.75), (60_000, "new", None)]
    trees = [hashtree.hash_tree(df, "k", width=100) for df in (before, table(spark, changed))]
    got = sorted(map(tuple, hashtree.changed_ranges(*trees, width=100).collect()))
    assert got == [(0, 99, 102, 101), (4300, 4399, 100, 100), (60_000, 60_099, 0, 1)]
    again = hashtree.hash_tree(before.repartition(7), "k", width=100)
    assert hashtree.changed_ranges(trees[0], again, width=100).count() == 0
    nameless = hashtree.hash_tree(table(spark, ROWS[:-1]), "k", width=100)
    assert [tuple(r) for r in hashtree.changed_ranges(trees[0], nameless, width=100).collect()] == [(None, None, 1, 0)]


def test_values_do_not_run_into_each_other(spark):
    pairs = [(("a,b", "c"), ("a", "b,c")), ((None, "x"), ("N", "x")), (('a"', "b"), ("a", '"b')), (("", None), (None, ""))]
    for one, other in pairs:
        hashes = [
            spark.createDataFrame([row], "a string, b string").select(hashtree.row_hash(["a", "b"])).head()[0] for row in (one, other)
        ]
        assert hashes[0] != hashes[1], (one, other)


def test_empty_table_and_negative_keys(spark):
    assert hashtree.hash_tree(table(spark, []), "k").count() == 0
    assert hashtree.root(hashtree.hash_tree(table(spark, []), "k")) is None
    with pytest.raises(Exception, match="not negative"):
        hashtree.hash_tree(table(spark, [(-5, "a", 1.0)]), "k")


COLUMNS = (
    "entity_id string, entity_name string, entity_type string, ef_value double, ef_unit string, region string, "
    "source_dataset string, confidence double, timestamp string, tags array<string>, _ord string"
)


def sources(spark, data, shaped):
    """Two toy sources; ``shaped`` notes which are shaped."""
    found = Registry()
    for rank, name in enumerate(data):
        def shape(raw, as_of=None, name=name):
            shaped.append(name)
            return raw

        def read(s, path, name=name, rank=rank):
            rows = [
                (f"{name}{k}", f"{name} name\n{k}", "product", float(v), "kg CO2e", "FR", name, 0.5, "2025-01-01", ["sector:x"], f"{rank:03d}/{k:04d}")
                for k, v in enumerate(data[name])
            ]
            return s.createDataFrame(rows, COLUMNS)

        found.add(SourceSpec(name, read, shape))
    return found


def values(spark, path):
    rows = Published(spark, path).read("merged").select("entity_id", "ef_value").collect()
    return sorted(map(tuple, rows))


def test_sets_are_whole_and_unchanged_sources_are_kept(spark, tmp_path, monkeypatch):
    out, data, shaped = str(tmp_path / "out"), {"one": [1, 2, 3], "two": [4, 5]}, []
    paths = {"one": "-", "two": "-"}
    assert Published(spark, out).number() == 0
    with pytest.raises(ValueError, match="no published part"):
        Published(spark, out).read("merged")
    assert publish.run_set(spark, sources(spark, data, shaped), paths, out, as_of="2025-01-01") == 1
    first = values(spark, out)
    assert [v for _, v in first] == [1.0, 2.0, 3.0, 4.0, 5.0] and shaped == ["one", "two"]
    parts = {r["part"]: r for r in Published(spark, out).current().collect()}
    assert parts["data"]["rows"] == 5 and parts["data"]["root"] == parts["merged"]["root"]
    assert {"interim/one", "interim/two", "merged", "data", "crosswalk", "metadata/about", "summary", "graph/regions"} <= set(parts)

    # a run that dies between two writers leaves the old set readable
    data["two"] = [4, 50]
    write = sinks.write_summary
    def broken(*_):
        raise OSError("disk full")

    monkeypatch.setattr(sinks, "write_summary", broken)
    with pytest.raises(OSError):
        publish.run_set(spark, sources(spark, data, []), paths, out, as_of="2025-01-01")
    assert Published(spark, out).number() == 1 and values(spark, out) == first

    # the next run shapes the changed source only
    monkeypatch.setattr(sinks, "write_summary", write)
    shaped = []
    assert publish.run_set(spark, sources(spark, data, shaped), paths, out, as_of="2025-01-01") == 2
    assert shaped == ["two"] and [v for _, v in values(spark, out)] == [1.0, 2.0, 3.0, 4.0, 50.0]
    now = {r["part"]: r for r in Published(spark, out).current().collect()}
    assert now["interim/one"]["path"] == parts["interim/one"]["path"] != now["interim/two"]["path"]
    assert now["merged"]["root"] != parts["merged"]["root"] and now["interim/one"]["root"] == parts["interim/one"]["root"]

    # another date is another result
    shaped = []
    publish.run_set(spark, sources(spark, data, shaped), paths, out, as_of="2025-02-02")
    assert shaped == ["one", "two"]


def test_a_source_of_one_task_is_shaped_by_several(spark, tmp_path):
    raw = spark.range(0, 300_000, 1, 1).select("id", F.md5(F.col("id").cast("string")).alias("v"))
    writing = Published(spark, str(tmp_path / "p")).begin()
    shaped = writing.interim("one", raw, lambda df: df.withColumn("w", F.col("id") % 7))
    assert len(shaped.inputFiles()) > 2
    assert writing.rows[0][4:6] == snapshots.content_root(raw.withColumn("w", F.col("id") % 7))
    assert writing.rows[0][6].startswith(snapshots.content_root(raw)[1])


def test_rows_and_root_of_a_part_serve_another(spark, tmp_path, monkeypatch):
    writing, df = Published(spark, str(tmp_path / "p")).begin(), spark.range(3)
    known = writing.add("r", "parquet", df, lambda path: df.write.parquet(path))
    assert known == snapshots.content_root(df)
    monkeypatch.setattr(snapshots, "content_root", None)
    assert writing.add("s", "csv", df, lambda path: df.write.csv(path), known=known) == known
    assert [row[4:6] for row in writing.rows] == [known, known]


def test_a_second_writer_is_refused(spark, tmp_path):
    published = Published(spark, str(tmp_path / "p"))
    one, two = published.begin(), published.begin()
    df = spark.range(3)
    for writing in (one, two):
        writing.add("r", "parquet", df, lambda path: df.write.parquet(path))
    assert one.commit() == 1
    with pytest.raises(RuntimeError, match="meanwhile"):
        two.commit()
    assert published.read("r").count() == 3


def test_content_root(spark):
    df = table(spark, ROWS)
    assert snapshots.content_root(df) == snapshots.content_root(df.repartition(5))
    assert snapshots.content_root(df) != snapshots.content_root(df.withColumnRenamed("v", "w"))
    assert snapshots.content_root(df.where("k > 3"))[0] < snapshots.content_root(df)[0]
    assert snapshots.content_root(table(spark, []))[0] == 0
