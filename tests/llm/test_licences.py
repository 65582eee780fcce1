import random
import re

from factorloom.llm import licences
from tests.llm.helpers import LONG, ODD, ascii_lower, documents


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def brute_base(text):
    own, found = brute_words(text), []
    for phrase, label in licences.PHRASES:
        parts = phrase.split()
        found += [(k, label) for k in range(len(own)) if own[k : k + len(parts)] == parts]
    return len(own), sorted(found)


CASES = [
    "the MIT License, mit-license; Mit   LICENSE and mitlicense mit xlicense",
    "Apache License apache license general public License general general public license",
    "mit License" * 3,
    "é MIT license \U0001f600 license",
    "x " * 50 + licences.TEMPLATES[0][1] + " y" * 50,
    "Copyright. " + licences.TEMPLATES[3][1].upper().replace(" ", "\n * ") + " All Rights Reserved!",
    "permission is hereby granted free of charge but nothing else",
]


def test_places_against_brute_force(spark):
    rows = [*enumerate([*CASES, None, "", LONG])]
    got = {r["doc_id"]: r for r in licences.scan(documents(spark, rows)).collect()}
    for doc, text in rows:
        n, found = brute_base(text)
        r, starts = got[doc], [k for k, _ in found]
        assert (r["n_words"], r["n_base"]) == (n, len(found))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert "mit-text" in got[4]["labels"] and got[4]["spans"][0]["cover"] == 1.0 and got[4]["spans"][0]["start"] == 50
    assert {"apache-notice", "rights-reserved"} <= set(got[5]["labels"].split(","))
    assert got[6]["labels"] == "" and got[7]["score"] == 0


def test_odd_rows(spark):
    assert licences.digest(licences.scan(documents(spark, ODD))).count() == len(ODD)
    assert licences.scan(documents(spark, [])).count() == 0


def test_statistics_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        templates = [[rng.randrange(4) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 4))]
        automaton = licences.SuffixAutomaton(templates)
        stream = [rng.randrange(5) for _ in range(60)]
        inside = lambda x: {(t, k + len(x) - 1) for t, s in enumerate(templates) for k in range(len(s)) if s[k : k + len(x)] == x}
        for end, (state, length) in enumerate(automaton.statistics(stream)):
            longest = max(n for n in range(end + 2) if not n or inside(stream[end + 1 - n : end + 1]))
            assert length == longest
            if length:
                assert automaton.ends[state] == inside(stream[end + 1 - length : end + 1])


def test_many_repeats_take_linear_time():
    scanner = licences.Scanner()
    tokens = licences.words((licences.TEMPLATES[4][1] + " filler words here and there ") * 400)
    assert len([s for s in scanner.spans(tokens) if s[2] == "gpl-notice"]) == 400


def test_templates_inside_others_are_found():
    scanner = licences.Scanner([("long", "w x y z v"), ("inner", "x y z"), ("end", "y z v"), ("one", "q")])
    found = [(a, b, label) for a, b, label, _ in scanner.spans(licences.words("w x y z v and q"))]
    assert found == [(0, 5, "long"), (1, 4, "inner"), (2, 5, "end"), (6, 7, "one")]


def test_stretches_of_every_template_against_brute_force():
    rng = random.Random(17)
    for _ in range(150):
        letters = "abcd"
        texts = [[rng.choice(letters) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 5))]
        scanner = licences.Scanner([(str(k), " ".join(x)) for k, x in enumerate(texts)])
        stream = [rng.choice("abcde") for _ in range(40)]
        want = set()
        for which, own in enumerate(texts):
            parts = {tuple(own[a:b]) for a in range(len(own)) for b in range(a + 1, len(own) + 1)}
            # the longest stretch that ends at each place, unless the next place lengthens it
            longest = [max((n for n in range(1, end + 1) if tuple(stream[end - n : end]) in parts), default=0) for end in range(len(stream) + 1)]
            for end, n in enumerate(longest):
                if n >= min(licences.LEAST_STRETCH, len(own)) and (end == len(stream) or longest[end + 1] != n + 1):
                    places = tuple(k for k in range(n - 1, len(own)) if own[k - n + 1 : k + 1] == stream[end - n : end])
                    want.add((end, n, which, places))
        got = [(end, n, which, tuple(scanner.automaton.places[state][which])) for end, n, state, which in scanner.stretches([w.encode() for w in stream])]
        assert len(got) == len(set(got)) and set(got) == want


def test_whole_templates_are_found_whole():
    scanner = licences.Scanner()
    for label, text in licences.TEMPLATES:
        own = licences.words(text)
        spans = scanner.spans([b"before"] + own + [b"behind"])
        assert (1, 1 + len(own), label, 1.0) in spans
    both = licences.words(licences._BSD)
    assert "bsd-text" in {s[2] for s in scanner.spans(both)} and "mit-full" not in {s[2] for s in scanner.spans(both)}
