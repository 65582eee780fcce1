import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm.helpers import documents, words
from tests.llm.test_jaccard import brute as similar_classes
from tests.llm.test_mixing import targets
from tests.llm.test_packing import reference_ids
from tests.llm.test_quality import brute as counts
from tests.llm.test_quality import prose


def fixture():
    rng = random.Random(21)
    rows = [(k, prose(rng, rng.randint(50, 90)), f"s{k % 4}", "en") for k in range(300)]
    rows += [(300 + k, rows[k][1].replace(" ", "  "), "s0", "en") for k in range(20)]
    for k in range(20, 40):
        own = rows[k][1].split(" ")
        own[3] = "changed"
        rows.append((400 + k, " ".join(own), "s1", "fr"))
    rows += [(500, None, None, None), (501, "", "s1", "en"), (502, "too short", "s2", "en"), (503, "a b c " * 40, "s3", "en")]
    return rows + [rows[0], rows[0]]


def test_stages_against_brute_force(spark, tmp_path):
    rows = fixture()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(200)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    left = [r for r in rows if counts(r[1])[0] >= 50 and 100 * counts(r[1])[4] <= 50 * counts(r[1])[0]]
    first = {}
    for r in sorted(left, key=lambda r: r[0]):
        first.setdefault(norm(r[1]), r)
    left = list(first.values())
    label = similar_classes([(r[0], r[1]) for r in left])
    left = [r for r in left if label[r[0]][1] == r[0]]

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_tokens"]
    for name, function in corpus_pipeline.STAGES[:3]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted((r[0], r[1]) for r in left)

    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    mixed.write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    sizes, taken = Counter(), Counter()
    for r in left:
        sizes[r[2]] += len(words(r[1]))
    for r in mixed.collect():
        taken[r["source"]] += len(words(r["text"]))
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= 200

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths, times = Counter(), Counter(r["doc_id"] for r in mixed.collect())
    for r in pieces:
        lengths[r["doc_id"]] += r["length"]
    text_of = {r["doc_id"]: r["text"] for r in mixed.collect()}
    ids = dict(zip(text_of, map(len, reference_ids(list(text_of.values())))))
    assert lengths == {doc: n * ids[doc] for doc, n in times.items()}

