import math
import random
import re
from collections import Counter

import pytest

from factorloom.llm import quality
from tests.llm.helpers import LONG, ODD, documents, words


def brute(text):
    own = words(text)
    windows = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(own),
        sum(map(len, own)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_counts_and_base_against_brute_force(spark):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 3, 49, 50, 51, 400)]
    texts += ["a b c a b c", "a a a a", "x\n x\nx\n\n\nx", "#*$%&|<>", "é É\x85é\x1c", LONG, "a b c " * 30, "l 1\nl 1\n" * 40, "abcabc abc"]
    rows = [*enumerate(texts), (900, None)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.digest(quality.judge(documents(spark, rows), labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(dict(rows)[r["doc_id"]])
        assert tuple(r)[1:6] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (r["base_failed"], r["kept"]) == (failed, not failed)


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.1), (3, 50, 0.1), (7, 900, 0.01), (20, 100, 0.3), (99, 100, 0.5), (5, 5, 0.2), (0, 3000, 0.01)])
def test_binomial_is_exact(k, n, p):
    want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.at_most(k, n, p) == pytest.approx(want, rel=1e-10)


def _steps(rows):
    """Rows that each step of the ladder rejects by any rule."""
    return [sum(any(x > step[rule] for rule, x in zip(quality.RULES, row)) for row in rows) for step in quality.LADDER]


def test_cutoffs_keep_the_risk_of_all_rules_together():
    rng = random.Random(8)
    good = [[min(1, rng.random() ** 30) for _ in quality.RULES] for _ in range(3000)]
    bad = [[0.5 + rng.random() / 2 for _ in quality.RULES] for _ in range(200)]
    chosen = quality.choose_cutoffs({"en": (3000, _steps(good))}, {"en": _steps(bad)})
    k = sum(any(x > chosen["en"][rule] for rule, x in zip(quality.RULES, row)) for row in good)
    assert quality.at_most(k, 3000, quality.RISK) <= quality.DELTA / 5
    # 0.95 ** 80 is above the level, 0.95 ** 100 below it
    clean = [[0.0] * len(quality.RULES)]
    for n, found in ((80, False), (100, True)):
        chosen = quality.choose_cutoffs({"en": (n, _steps(clean * n))}, {"en": _steps(bad)})
        assert bool(chosen) == found
    # a stratum that passes its whole ladder hands its level on
    both = {"en": (3000, _steps(clean * 3000)), "de": (87, _steps(clean * 87))}
    assert set(quality.choose_cutoffs(both, {"en": _steps(bad), "de": _steps(bad)})) == {"en", "de"}
    assert not quality.choose_cutoffs({"de": both["de"]}, {"de": _steps(bad)})


def test_no_stratum_loses_more_than_the_risk_in_nearly_all_draws():
    rng = random.Random(21)
    # true rates of rejection of good rows by step, around the risk at the strict end
    rates = {"en": [0.002 * k for k in range(1, 19)], "de": [0.004 * k for k in range(1, 19)], "fr": [0.05 + 0.001 * k for k in range(18)]}
    draws, broken = 400, 0
    for _ in range(draws):
        good = {}
        for name, by_step in rates.items():
            rows = [rng.random() for _ in range(400)]
            good[name] = (400, [sum(x < rate for x in rows) for rate in by_step])
        # the strictest passing step catches more than any other, so it is taken
        chosen = quality.choose_cutoffs(good, {name: [2**k for k in range(18)] for name in rates})
        broken += any(rates[name][quality.LADDER.index(step)] > quality.RISK for name, step in chosen.items())
    assert broken <= 2 * quality.DELTA * draws


def test_labelled_junk_goes_and_clean_rows_stay(spark):
    rng = random.Random(9)
    clean = [(k, prose(rng, 80), "s", rng.choice(["en", "de"])) for k in range(6000)]
    junk = [(10_000 + k, " ".join(w + "%%%" for w in prose(rng, 70).split()), "s", rng.choice(["en", "de"])) for k in range(400)]
    odd = [(20_000 + k, t, "s", lang) for k, (_, t) in enumerate(ODD) for lang in ("en", None)]
    docs = documents(spark, clean + junk + odd)
    labels = [(k, 1) for k, *_ in clean[:5000]] + [(k, 0) for k, *_ in junk[:200]] + [(None, 1), (3, None), (10_001, 0), (10_001, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}
    assert not kept & {k for k, *_ in junk} and {k for k, *_ in clean} <= kept
    left = quality.filter_quality(docs, labels)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.select("doc_id").collect()} == kept
    assert quality.judge(documents(spark, []), labels).count() == 0
