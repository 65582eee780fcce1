from collections import defaultdict

import pytest

from factorloom.llm import mixing
from tests.llm.helpers import ODD, documents, words


def targets(sizes):
    """Weights 5, 2, 1 by source; excess over twice a source's size is shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    share, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left = share - sum(2 * sizes[s] for s in stopped)
        free = sum(weight[s] for s in sizes if s not in stopped)
        out = {s: 2 * sizes[s] if s in stopped else left * weight[s] / free for s in sizes}
        above = {s for s in sizes if s not in stopped and out[s] > 2 * sizes[s]}
        if not above:
            return out
        stopped |= above


def test_targets_and_taken_words(spark):
    rows = [(k, "w " * (1 + k * 37 % 90), f"s{k * k % 11}" if k % 13 else None) for k in range(2000)]
    rows += [(9000 + k, "w " * 50, "hot") for k in range(1500)] + [(20000, None, "empty")]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = targets(sizes)
    got = mixing.plan_mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    taken, text_of = defaultdict(int), {r[0]: r[1] for r in rows}
    for r in got:
        assert r["size"] == len(words(text_of[r["doc_id"]]))
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["n_copies"] <= 2
        taken[r["source"]] += r["n_copies"] * r["size"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 100
    again = mixing.plan_mix(documents(spark, rows, 5)).collect()
    assert {(r["doc_id"], r["n_copies"]) for r in got} == {(r["doc_id"], r["n_copies"]) for r in again}


def test_mix_emits_whole_rows(spark):
    docs = documents(spark, [(k, "a b c", "s") for k in range(30)] + [(k, t, "odd") for k, t in ODD])
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    planned = mixing.plan_mix(docs).agg({"n_copies": "sum"}).first()[0]
    assert out.count() == planned
    assert mixing.plan_mix(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0


def test_stored_rows_are_mixed_without_a_copy(spark, tmp_path, monkeypatch):
    rows = [(k % 70, "a b c " * (1 + k % 9), f"s{k % 3}") for k in range(400)] + [(k, t, "odd") for k, t in ODD]
    path = str(tmp_path / "docs")
    documents(spark, rows).repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    written = []
    real = mixing.tagged
    monkeypatch.setattr(mixing, "tagged", lambda df, name: written.append(name) or real(df, name))
    whole = lambda df: sorted(map(str, df.collect()))
    stored = mixing.mix(docs, stored=True)
    assert stored.columns == docs.columns and not written
    # ties between equal ids go by the row's place, so words by source agree, and reruns agree in full
    assert whole(stored) == whole(mixing.mix(spark.read.parquet(path), stored=True))
    sums = lambda df: {r[0]: r[1] for r in df.groupBy("source").count().collect()}
    assert sums(stored) == sums(mixing.mix(docs)) and written == ["mix-rows"]
    # a table that is no scan is written, whatever it says
    assert sums(mixing.mix(documents(spark, rows), stored=True)) == sums(stored) and written == ["mix-rows"] * 2
