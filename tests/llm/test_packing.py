import zlib
from collections import defaultdict

import numpy as np
import pytest

from factorloom.llm import packing
from tests.llm.helpers import LONG, ODD, documents


def reference_ids(texts, name=packing.VOCABULARY):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary(name))
    return [x.ids + [packing.CLOSING_ID] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


HARD = [
    "It's we'll don't 's 't",
    "<|endoftext|> a<|startoftext|>b < |endoftext|>",
    "é ́x ÀÉ. Straße, ﬁ ǅ İSTANBUL Kelvin",
    "x　y\t z​ w\r\n\x0b",
    "end!! a|> <|endoftext|>. x<|endoftext|>y END'S it'S don't'ts c++ d_e f_ <|startoftext|",
    "Word. word, WORD., ... ,,. a.b c,d",
    "日本語 \U0001f600\U0001f600 ́ 123 4.5",
]


def check(pieces, texts):
    ids = dict(zip(texts, reference_ids(list(texts.values()))))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        own.sort(key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids[doc]
        at = 0
        for r in own:
            assert r["start"] == at and r["length"] == len(r["ids"]) > 0 and r["doc_tokens"] == len(ids[doc])
            assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
            at += r["length"]
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_pieces_hold_every_id_once(spark):
    texts = {k: x for k, x in enumerate([*HARD, "", LONG, *(f"doc {k} " * (k % 900) for k in range(300))])}
    docs = documents(spark, list(texts.items()))
    check(packing.pack(docs, packing.vocabulary(), with_ids=True).collect(), texts)
    assert "ids" not in packing.pack(docs, packing.vocabulary()).columns


def test_odd_rows(spark):
    got = packing.pack(documents(spark, ODD), packing.vocabulary(), with_ids=True).collect()
    assert sum(r["length"] for r in got) == sum(map(len, reference_ids([t or "" for _, t in ODD])))
    assert sum(r["doc_id"] == 4 and r["start"] == 0 for r in got) == 2
    assert packing.pack(documents(spark, []), packing.vocabulary()).count() == 0


def test_levels_take_the_best_place():
    rng = np.random.default_rng(4)
    levels, filled = packing.Levels(64), {}
    counts = np.zeros(65, int)
    for size in rng.integers(1, 64, 3000):
        options = [(np.inf, 0)]
        for level in range(65 - size):
            if level and not counts[level]:
                continue
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 64
            options.append((int((after**2).sum()), level))
        best = min(x for x, _ in options)
        number, offset = levels.place(int(size))
        assert (best, offset) in options
        assert filled.get(number, 0) == offset
        filled[number] = offset + int(size)
        counts[offset] -= offset > 0
        counts[offset + size] += offset + size < 64
    waste = sum(64 - x for x in filled.values())
    assert waste < 0.05 * sum(filled.values())


@pytest.mark.parametrize("documents_in, part", [(250, 0.8), (1250, 0.85), (5000, 0.9)])
def test_most_tokens_stand_where_they_were_placed(documents_in, part):
    rng = np.random.default_rng(documents_in)
    window, levels, waiting, stayed, tokens = packing.WINDOW, packing.Levels(), {}, 0, 0
    placed = {}
    for doc, size in enumerate(rng.lognormal(6.2, 0.9, documents_in).astype(int) + 2):
        tokens += size
        stayed += size // window * window
        for _ in range(size // window):
            levels.full()
        size %= window
        if not size:
            continue
        number, level = levels.place(int(size))
        placed[doc] = (number, level)
        waiting.setdefault(number, []).append((doc, 0, bytes(4 * size), size))
        if level + size == window:
            stayed += sum(len(x[2]) // 4 for x in waiting.pop(number))
    open_tokens = sum(len(x[2]) // 4 for own in waiting.values() for x in own)
    ends, parts = {}, {}
    for doc, start, ids, _, number, offset in packing._settle(waiting, levels.made, window):
        n = len(ids) // 4
        assert parts.get(doc, 0) == start and ends.get(number, 0) == offset
        parts[doc], ends[number] = start + n, offset + n
        stayed += n if (number, offset - start) == placed[doc] else 0
    assert sum(parts.values()) == sum(ends.values()) == open_tokens
    assert all(x == window or x & (x - 1) == 0 for x in ends.values())
    assert stayed >= part * tokens, stayed / tokens


def test_another_vocabulary_is_used_as_it_is(spark):
    name = "byte_bpe_50k.json"
    assert packing.by_words(packing.vocabulary()) and not packing.by_words(packing.vocabulary(name))
    texts = {k: x for k, x in enumerate([*HARD, "", "two  words\n\tand more"])}
    pieces = packing.pack(documents(spark, list(texts.items())), packing.vocabulary(name), with_ids=True).collect()
    for doc, ids in zip(texts, reference_ids(list(texts.values()), name)):
        own = sorted((r for r in pieces if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids
