import os

import pytest

from factorloom import session


def folders(spark):
    root = f"{session.checkpoint_root(spark).removeprefix('file:').rstrip('/')}/factorloom"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_tables_on_the_way_go_and_the_result_stays(spark):
    before = folders(spark)

    def make():
        half = session.stage(spark.range(100).where("id % 2 = 0"), "half")
        inner = session.stage_alone(spark, lambda: session.stage(half, "deep").where("id > 10"), "inner")
        return inner.join(half, "id")

    got = session.stage_alone(spark, make, "result")
    assert sorted(r[0] for r in got.collect()) == list(range(12, 100, 2))
    assert [x.split("-")[0] for x in folders(spark) - before] == ["result"]
    # outside nothing is removed
    session.stage(spark.range(3), "plain")
    assert sorted(x.split("-")[0] for x in folders(spark) - before) == ["plain", "result"]


def test_a_run_that_fails_keeps_its_tables(spark):
    before = folders(spark)

    def make():
        session.stage(spark.range(5), "kept")
        raise ValueError("stopped")

    with pytest.raises(ValueError, match="stopped"):
        session.stage_alone(spark, make, "never")
    assert [x.split("-")[0] for x in folders(spark) - before] == ["kept"]
    session.stage(spark.range(3), "later")
    assert sorted(x.split("-")[0] for x in folders(spark) - before) == ["kept", "later"]
