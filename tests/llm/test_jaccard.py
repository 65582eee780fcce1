import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import jaccard
from factorloom.llm.components import components
from factorloom.llm.shingles import shingle_sets
from tests.llm.helpers import LONG, ODD, ascii_lower, documents, words


def shingles(text):
    own = words(ascii_lower(text or ""))
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def brute(rows):
    sets = {doc: shingles(text) for doc, text in rows}
    label = {doc: doc for doc in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, u in enumerate(ids):
        for v in ids[k + 1 :]:
            a, b = sets[u], sets[v]
            if min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)) > 0 and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(u), root(v)))
                label[y] = x
    return {doc: (len(sets[doc]), root(doc)) for doc in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = []

    def copies(n_words, n_copies, changes):
        base = [word() for _ in range(n_words)]
        for _ in range(n_copies):
            own = base[:]
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))

    copies(60, 70, 3)  # a group far above the bound of frequent keys, with pairs on both sides of the threshold
    copies(400, 40, 14)
    for _ in range(25):
        copies(rng.choice([5, 6, 8, 12, 20, 45, 90, 200, 700]), rng.randint(2, 6), rng.randint(1, 9))
    passage = " ".join(word() for _ in range(55))
    for _ in range(60):
        own = [word() for _ in range(rng.randint(1, 160))]
        at = rng.randrange(len(own))
        texts.append(" ".join([*own[:at], passage, *own[at:]]))
    chain = [word() for _ in range(120)]
    for k in range(25):  # each similar to the next, the ends not
        chain[4 * k : 4 * k + 3] = [word() for _ in range(3)]
        texts.append(" ".join(chain))
    texts += ["one two three", "One  TWO\nthree", "one two three four", "É x", "é x", "a b c d e", "a b c d e f", "x " * 300, "x " * 9]
    texts += [texts[0], texts[0].upper(), texts[80] + " " + texts[80]]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_classes_against_brute_force(spark):
    rows = corpus() + [(1, None), (2, ""), (3, " \n "), (5000, LONG), (5001, LONG + " and a few more words than that")]
    classes, links = jaccard.join_similar(documents(spark, rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes.collect()}
    assert got == brute(rows)
    text_of = dict(rows)
    for r in links.collect():
        a, b = shingles(text_of[r["u"]]), shingles(text_of[r["v"]])
        assert 100 * len(a & b) >= 75 * len(a | b)


def test_odd_rows(spark):
    got = [tuple(r) for r in jaccard.join_similar(documents(spark, ODD))[0].collect()]
    assert len(got) == len(ODD)
    assert {r for r in got if r[0] is None} == {(None, 1, None), (None, 0, None)}
    assert sum(r == (4, 1, 4) for r in got) == 2
    assert jaccard.join_similar(documents(spark, []))[0].count() == 0
    docs = documents(spark, ODD)
    left = jaccard.keep_one(docs)
    # 7 has the words of 4
    assert left.columns == docs.columns and left.count() == len(ODD) - 1


def test_segments_find_every_similar_pair():
    rng = np.random.default_rng(11)
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 10, 15, 30, 60, 150, 600, 3000]))
        base = np.unique(rng.integers(0, (1 << 64) - 1, n, np.uint64))
        drop, extra = rng.integers(0, n // 7 + 2), rng.integers(0, n // 7 + 2)
        other = np.unique(np.concatenate((rng.permutation(base)[drop:], rng.integers(0, (1 << 64) - 1, extra, np.uint64))))
        common, union = np.intersect1d(base, other).size, np.union1d(base, other).size
        if 100 * common >= 75 * union:
            (a, _), (b, _) = jaccard.index_entries(base), jaccard.index_entries(other)
            assert np.intersect1d(a, b).size, (n, base.size, other.size)
            assert jaccard.sketches_allow(jaccard.sketch(base), jaccard.sketch(other), base.size, other.size)


def test_keys_and_ids_travel_whole():
    keys = np.random.default_rng(1).integers(0, (1 << 64) - 1, 1000, np.uint64)
    bucket, rest = jaccard._split_keys(keys, 7)
    assert (jaccard._unpack_keys(jaccard._pack_keys(rest)) == rest).all()
    assert ((keys & np.uint64(7)) == (rest & np.uint64(7))).all() and bucket.max() < 128
    for ids in (np.array([5, 9, 5]), np.array([-(1 << 62), 1 << 62]), np.zeros(0, np.int64)):
        base, packed = jaccard._pack_ids(ids.astype(np.int64))
        assert (jaccard._unpack_ids(base, packed, ids.size) == ids).all()


def test_shingles_match_plain_ones():
    texts = [t or "" for _, t in corpus()[:60]] + ["", "A b", "é É a\x0bb\x1cc"]
    for text, found in zip(texts, shingle_sets(texts)):
        assert found.size == len(shingles(text))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 480)]
    edges += [(500, 500 + k) for k in range(100)] + [(None, 3), (7, 7)]
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            x, y = sorted((root(u), root(v)))
            label[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for u, v in edges if u is not None and v is not None and u != v for x in (u, v)}


def test_buckets_stay_bounded_as_the_text_grows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 50, raising=False)
    seen = []
    parted = jaccard._parted

    def spied(docs, bits, shingle):
        out = parted(docs, bits, shingle)
        seen.append(out)
        return out

    monkeypatch.setattr(jaccard, "_parted", spied)
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(100))) for k in range(200)]
    rows += [(1000 + k, text) for k, text in rows[:20]]
    classes, _ = jaccard.join_similar(documents(spark, rows), "doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes.collect()}
    assert got == brute(rows)
    entries = seen[0].where("bucket >= 0").groupBy("bucket").agg(F.sum(F.length("keys")).alias("n"))
    assert entries.agg(F.max("n")).head()[0] // jaccard._KEY_BYTES < 200


def test_a_passage_of_many_sets_does_not_make_their_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    passage = [word() for _ in range(80)]
    rows = [(k, " ".join(passage + [word() for _ in range(rng.randint(20, 160))])) for k in range(900)]
    rows += [(2000 + k, text + " " + word()) for k, (_, text) in enumerate(rows[::30])]
    # 70 of 100 words shared: near the threshold, not over it
    rows += [(4000 + k, " ".join(passage[:70] + [word() for _ in range(30)])) for k in range(100)]
    made = []
    for name in ("_to_first", "_across"):
        real = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda *a, real=real: made.append(real(*a)) or made[-1])
    rng.shuffle(rows)
    classes, _ = jaccard.join_similar(documents(spark, rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes.collect()}
    assert got == brute(rows)
    assert len(made) == 2 and sum(df.count() for df in made) < 2 * len(rows)
