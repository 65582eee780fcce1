import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import negatives, neighbours
from factorloom.llm.vectors import Block, first

SCHEMA = "vec_id long, label int, embedding array<float>, key string, group string, score string"


def table(spark, rows, parts=3):
    full = [(i, label, None if v is None else [None if x is None else float(x) for x in v], "x", "y", "z") for i, label, v in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def sound(rows):
    return [
        (i, label, np.array(v, np.float32).astype(float))
        for i, label, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]


def brute_negatives(rows, is_anchor, n_pos=5, n_neg=10):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in sound(rows) if label is not None]
    out = []
    for a, a_label, av in rows:
        if not is_anchor(a):
            continue
        score = [(sum(x * y for x, y in zip(av, v)), i, label) for i, label, v in rows if i != a and len(v) == len(av)]
        score.sort(key=lambda s: (-s[0], s[1]))
        for p, positive, _ in [s for s in score if s[2] == a_label][:n_pos]:
            inside = [s for s in score if s[2] != a_label and 30 * p <= 100 * s[0] <= 90 * p][:n_neg]
            out += [(a, positive, k, i, p, s) for k, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, is_anchor, parts=3):
    got = negatives.mine(table(spark, rows, parts), is_anchor).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in got)


ODD = [
    (None, 1, [1.0, 2.0]),
    (11, None, [1.0, 2.0]),
    (12, 1, None),
    (13, 1, []),
    (14, 1, [1.0, None]),
    (15, 1, [float("nan"), 1.0]),
    (16, 1, [float("inf"), 1.0]),
    (17, 2, [1.0, 2.0, 3.0]),
]


def test_negatives_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(0, 3)), list(rng.normal(size=8) + 0.7)) for k in range(400)]
    rows += [(1000 + k, 1, [0.5] * 8) for k in range(60)]  # ties
    rows += [(2000 + k, 2, [-3.0] * 8) for k in range(5)] + ODD
    rows += [rows[7], rows[7], rows[20]]  # repeated rows, one of them an anchor
    want = brute_negatives(rows, lambda i: i % 20 == 0)
    assert len(want) > 500
    assert mined(spark, rows, F.col("vec_id") % 20 == 0) == want
    assert mined(spark, rows, F.col("vec_id") % 20 == 0, 1) == want


def test_overlapping_windows_and_ties_of_limits(spark):
    rows = [(0, 0, [1.0])] + [(k, 0, [float(s)]) for k, s in ((1, 10), (2, 10), (3, 7), (4, 3), (5, 0))]
    rows += [(100 + k, 1, [k / 10]) for k in range(120)]
    assert mined(spark, rows, F.col("vec_id") == 0) == brute_negatives(rows, lambda i: i == 0)


def test_negatives_of_nothing(spark):
    assert mined(spark, [], F.col("vec_id") % 20 == 0) == []
    assert mined(spark, ODD, F.col("vec_id") % 20 == 0) == []
    alone = [(0, 1, [1.0, 1.0]), (3, 2, [1.0, 1.0])]
    assert mined(spark, alone, F.col("vec_id") == 0) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5])], F.col("vec_id") == 0) == []


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2.0**30 + 1, 3.0]])
    b = np.array([[2.0**30 + 3, 5.0], [-(2.0**60), 0.0]])
    assert negatives.scores(a, b).tolist() == [[(2**30 + 1) * (2**30 + 3) + 15, -((1 << 63) - 1)]]


def test_first_breaks_ties_by_id():
    scores, ids = np.array([1, 5, 5, 5, 0, 2, 5, 1, 1, 1]), np.array([1, 9, 3, 4, 5, 6, 7, 8, 2, 10])
    assert ids[first(scores, ids, 2)].tolist() == [3, 4]
    assert ids[first(scores, ids, 6)].tolist() == [3, 4, 7, 9, 6, 1]


def found(spark, rows, parts=3, k=20):
    got = neighbours.nearest(table(spark, rows, parts), F.col("vec_id") % 20 == 0, k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def brute_nearest(rows, k=20):
    rows = [(i, v) for i, _, v in sound(rows) if v.any()]
    out = {}
    for q, qv in rows:
        if q % 20 == 0:
            scores = [(sum(x * y for x, y in zip(qv, v)), i) for i, v in rows if i != q and len(v) == len(qv)]
            scores.sort(key=lambda s: (-s[0], s[1]))
            out[q] = scores[:k]
    return out


def recall(got, want):
    hits = sum(len({i for _, i, _ in got.get(q, [])} & {i for _, i in best}) for q, best in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["even", "clustered", "lengths"])
def test_nearest_recall_and_scores(spark, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 24))
    if kind == "clustered":
        v = v * 0.2 + rng.normal(size=(30, 24))[np.arange(3000) % 30]
    if kind == "lengths":
        v *= rng.lognormal(0, 1, size=(3000, 1))
    else:
        v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(k, 0, list(x)) for k, x in enumerate(v)]
    got, want = found(spark, rows), brute_nearest(rows)
    assert recall(got, want) >= 0.95
    vectors = {i: x for i, _, x in sound(rows)}
    for q, best in got.items():
        assert [r for r, _, _ in best] == list(range(1, 21)) and q not in {i for _, i, _ in best}
        assert [(-s, i) for _, i, s in best] == sorted((-s, i) for _, i, s in best)
        for _, i, s in best:
            assert s == sum(x * y for x, y in zip(vectors[q], vectors[i]))


def test_nearest_of_few_odd_and_equal_rows(spark):
    few = [(0, 0, [1.0, 2.0]), (20, 0, [0.5, 0.5]), (3, 0, [1.0, 0.0]), (4, 0, [0.0, 0.0])] + ODD
    few += [(5, None, [1.0, 0.0])]
    want = {q: [(k, i, s) for k, (s, i) in enumerate(best, 1)] for q, best in brute_nearest(few).items()}
    assert found(spark, few) == want and len(want[0]) == 4
    equal = [(k, 0, [0.6, 0.8]) for k in range(500)]
    for q, best in found(spark, equal).items():
        assert [i for _, i, _ in best] == [i for i in range(30) if i != q][:20]
    assert found(spark, []) == {} and found(spark, ODD) == {}


def test_threshold_keeps_the_stated_chance():
    rng = np.random.default_rng(6)
    near = (np.abs(rng.normal(size=(20_000, neighbours.PROJECTIONS))) <= neighbours.WIDTH).sum(axis=1)
    assert (near >= neighbours.threshold()).mean() >= neighbours.FOUND - 0.005
    assert (near >= neighbours.threshold() + 1).mean() < neighbours.FOUND


def test_arrays_and_windows():
    rng = np.random.default_rng(7)
    base = Block(np.arange(50), np.arange(50), np.zeros(50, np.int64), [], rng.normal(size=(50, 4)))
    arrays = neighbours._Arrays(base, 40.0)
    assert (np.diff(arrays.sorted, axis=1) >= 0).all()
    centres = rng.normal(size=(3, neighbours.PROJECTIONS))
    lo, hi = arrays.windows(centres, np.array([0.5, 1.0, 2.0]))
    for q, half in enumerate((0.5, 1.0, 2.0)):
        for line in range(0, neighbours.PROJECTIONS, 9):
            inside = arrays.sorted[line][lo[q, line] : hi[q, line]]
            assert (np.abs(inside - centres[q, line]) <= half).all()
            assert (np.abs(arrays.sorted[line] - centres[q, line]) <= half).sum() == inside.size
