import hashlib
import random
import re

from pyspark.sql import functions as F

from factorloom.llm import exact
from tests.llm.helpers import LONG, ODD, documents


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_against_brute_force(spark):
    rows = [(k, f"text {k % 7}  of\tseven") for k in range(60)] + [(100, LONG), (101, LONG.replace(" ", "\n")), (102, LONG + ".")]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n\n"), (204, "É"), (205, "é")]
    groups = {}
    for doc, text in rows:
        groups.setdefault(norm(text), []).append(doc)
    got = exact.classes(exact.chunked(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    text_of = dict(rows)
    for r in got:
        own = groups[norm(text_of[r["doc_id"]])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), min(own) == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(norm(text_of[r["doc_id"]]).encode()).hexdigest()


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ODD)
    left = exact.deduplicate(docs)
    assert left.columns == docs.columns
    texts = [norm(r["text"]) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t in ODD})
    kept = {norm(r["text"]): r["doc_id"] for r in left.collect()}
    assert kept["One line"] == 4 and kept[""] == 1 and kept["no id here"] is None
    assert exact.classes(exact.chunked(documents(spark, []))).count() == 0


def test_chunks_are_whole_and_move_with_the_text(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8)))
    base = " ".join(word() for _ in range(6000))
    texts = [base, "a new start " + base, base[:20_000] + " changed " + base[20_000:], "x" * 50_000, "\U0001f600" * 9000]
    got = documents(spark, list(enumerate(texts)), 1).select("doc_id", exact.chunks(F.col("text")).alias("c")).collect()
    by = {r["doc_id"]: r["c"] for r in got}
    for k, text in enumerate(texts):
        assert "".join(by[k]) == text
    for other in (1, 2):
        assert len(set(by[0]) & set(by[other])) > 0.8 * len(by[0])


def test_identifiers_keep_clashing_hashes_apart(spark):
    rows = spark.createDataFrame(
        [
            (1, 1, "s", [(5, bytearray(b"a")), (6, bytearray(b"c"))]),
            (2, 2, "s", [(5, bytearray(b"b")), (6, bytearray(b"c"))]),
            (3, 3, "s", [(5, bytearray(b"a")), (6, bytearray(b"c"))]),
        ],
        "_row long, doc_id long, text_sha256 string, chunks array<struct<hash:long,digest:binary>>",
    )
    assert {r["doc_id"]: r["keep_id"] for r in exact.classes(rows).collect()} == {1: 1, 2: 2, 3: 1}
    ids = {(r["hash"], bytes(r["digest"])): (r["rank"], r["uses"]) for r in exact.chunk_identifiers(rows).collect()}
    assert ids == {(5, b"a"): (0, 2), (5, b"b"): (1, 1), (6, b"c"): (0, 3)}
