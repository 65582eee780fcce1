import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import toxicity
from tests.llm.helpers import LONG, ODD, documents

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model).join(labels.where(toxicity.held_out()), "doc_id").toPandas()
    toxic = scored["toxic"] == 1
    assert len(scored) > 500
    assert (scored["predicted"] == scored["toxic"]).mean() > 0.93
    assert scored[~toxic]["predicted"].mean() < 0.03
    assert scored[toxic]["predicted"].mean() > 0.6
    rank = scored["score"].rank().to_numpy()
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.9
    assert scored["score"].between(0, 1).all()


def test_held_out_rows_are_a_fifth_by_crc(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in df.collect())


def texts(rng, n, bad):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    for _ in range(n):
        own = [word() for _ in range(60)]
        for _ in range(4 * bad):
            own.insert(rng.randrange(60), rng.choice(["nastyword", "vileness", "uglyname"]))
        yield " ".join(own)


def test_unseen_texts_are_told_apart():
    rng = random.Random(4)
    model = toxicity.train(list(texts(rng, 300, 1)), list(texts(rng, 300, 0)), 0.5)
    assert np.mean([model.score(t) > 0.5 for t in texts(rng, 100, 1)]) > 0.95
    assert np.mean([model.score(t) > 0.5 for t in texts(rng, 100, 0)]) < 0.05


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (4, 0), (None, 1), (5, None), (77, 1)], "doc_id long, toxic int")
    docs = documents(spark, ODD)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(documents(spark, []), model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


@pytest.mark.parametrize("text", ["", " ", "a", "x" * 100_000, LONG, "\U0001f600 é"])
def test_windows_hold_every_word(text):
    assert b"".join(toxicity.windows(text)).split() == text.lower().encode().split()


def test_a_passage_late_in_a_long_text_teaches(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(2000)]
    rows = []
    for k in range(80):
        own = rng.choices(words, k=3200)
        if k % 2:
            own[3000:3000] = rng.choices(["nastyword", "vileness", "uglyname"], k=12)
        rows.append((k, " ".join(own)))
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).where("doc_id >= 60").collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in scored]) >= 0.9
