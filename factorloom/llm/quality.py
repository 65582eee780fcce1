"""Quality rules with risk-controlled thresholds.

A rule is a score from 0 to 1; it rejects a text whose score lies above the rule's cutoff
in the text's stratum (its language). The cutoffs of all rules move together down a
ladder, from mild to strict. A step's risk is that of the union: of the rows marked
good, the share that any rule rejects must be below ``RISK``, shown by an exact
binomial test on the labelled rows. Steps are tried in the ladder's order and only those ahead
of the first failure pass (a fixed sequence needs no correction over its steps). Over
the strata the level is shared out by Holm's rule: a stratum that passed its whole
ladder hands its part to the others. With probability ``1 - DELTA`` no stratum loses
more than ``RISK`` of its good rows to the rules. A stratum without a passing step has
no rules, so fewer than about 90 good labels mean that nothing is rejected.

Beside the rules stands a fixed base: fewer than 50 words, or more than half of the
words in repeated three-word windows.

Defined cases: a null text has no words (and fails the base); a null or unlisted
stratum is "other"; of several labels of one id the worst counts; rows without label
take no part in the choice; repeated rows are judged alike; an empty table gives no
row; ``filter_quality`` returns all columns of its input, ``judge`` those it states.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import in_batches, whole
from factorloom.session import stage

RISK = 0.05
DELTA = 0.05
CATCH = 0.97
STRATA = ("en", "de", "fr", "es")
OTHER = "other"
RULES = ("symbols", "shouting", "exclaiming", "repeated_lines", "repeated_words")
#: The strictest cutoff of each rule; the ladder goes there from 1 in equal steps.
STRICTEST = {"symbols": 0.1, "shouting": 0.3, "exclaiming": 0.1, "repeated_lines": 0.2, "repeated_words": 0.2}
STEPS = 18
LADDER = tuple({rule: round(1 - (1 - end) * k / STEPS, 4) for rule, end in STRICTEST.items()} for k in range(1, STEPS + 1))

LEAST_WORDS = 50
SYMBOLS = b"#*$%&|<>"

_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES]
#: Built here, as a type text needs a running session.
MEASURES = T.StructType([T.StructField(x, T.DoubleType() if x in RULES else T.LongType()) for x in _NAMES])
_SPACES = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Number of words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    pairs = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)[1]
    _, place, count = np.unique(pairs * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def measure(text: str) -> tuple:
    """Counts and rule scores of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    again = repeated_words(words)
    codes = np.frombuffer(raw, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    letters = upper + int(((codes >= 97) & (codes <= 122)).sum())
    part = lambda a, b: min(1.0, a / b) if b else 0.0
    return (
        n,
        len(text) - sum(raw.count(bytes([c])) for c in _SPACES),
        symbols,
        repeated,
        again,
        part(symbols, n),
        part(upper, letters),
        part(raw.count(b"!"), n),
        part(repeated, len(lines)),
        part(again, n),
    )


@F.pandas_udf(MEASURES)
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=_NAMES)


def stratum(column: Column) -> Column:
    return F.when(column.isin(*STRATA), column).otherwise(OTHER)


def _beta_part(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # 1 + d1 / (1 + d2 / (1 + ...)), from the front, by the modified Lentz method
    c, d, value = 1.0, 0.0, 1.0
    for k in range(1, 100_000):
        m = k // 2
        if k % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + term * d) or 1e-300)
        c = (1 + term / c) or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front / value


def at_most(k: int, n: int, p: float) -> float:
    """Exact probability of at most ``k`` of ``n`` at rate ``p``."""
    return 1.0 if k >= n else _beta_part(1 - p, n - k, k + 1)


def choose_cutoffs(
    good: dict[str, tuple[int, list[int]]],
    bad: dict[str, list[int]],
    risk: float = RISK,
    delta: float = DELTA,
) -> dict[str, dict[str, float]]:
    """Cutoff by stratum and rule.

    ``good``: number of good rows and how many of them each step of the ladder rejects; ``bad``:
    how many bad rows each step rejects. Of the steps that pass, the mildest is taken that
    catches nearly (``CATCH``) as many bad rows as the strictest.
    """
    open_strata = {*STRATA, OTHER, *good}
    passed = dict.fromkeys(good, 0)
    while open_strata:
        level = delta / len(open_strata)
        for name in open_strata & set(good):
            n, counts = good[name]
            while passed[name] < len(counts) and at_most(counts[passed[name]], n, risk) <= level:
                passed[name] += 1
        done = {name for name in open_strata & set(good) if passed[name] == len(good[name][1])}
        if not done:
            break
        open_strata -= done
    chosen: dict[str, dict[str, float]] = {}
    for name, steps in passed.items():
        caught = bad.get(name, [0] * STEPS)[:steps]
        if steps and caught[-1]:
            chosen[name] = LADDER[next(k for k in range(steps) if caught[k] >= CATCH * caught[-1])]
    return chosen


def _above(cutoffs: dict[str, float], m: str = "m") -> Column:
    """Whether any rule's score lies above its cutoff."""
    return F.greatest(*(F.col(f"{m}.{rule}") - cutoff for rule, cutoff in sorted(cutoffs.items()))) > 0


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Choose cutoffs from ``measured`` (``doc_id, stratum, m``) and ``labels`` (``doc_id, quality``).

    Two rows per stratum come to the driver.
    """
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    steps = F.array(*(F.sum(_above(cutoffs).cast("long")) for cutoffs in LADDER)).alias("steps")
    rows = measured.join(marked, "doc_id").groupBy("stratum", "quality").agg(F.count(F.lit(1)).alias("n"), steps).collect()
    good = {r["stratum"]: (r["n"], list(r["steps"])) for r in rows if r["quality"] == 1}
    bad = {r["stratum"]: list(r["steps"]) for r in rows if r["quality"] == 0}
    return choose_cutoffs(good, bad, risk, delta)


def base_failed(m: str = "m") -> Column:
    n, again = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * again > 50 * n)


def rejected(cutoffs: dict[str, dict[str, float]], m: str = "m", by: str = "stratum") -> Column:
    """Whether a rule rejects the row."""
    out = F.lit(False)
    for name, own in sorted(cutoffs.items()):
        out = out | ((F.col(by) == name) & _above(own, m))
    return out


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """``doc_id, stratum, m`` (counts and scores), ``base_failed, kept`` of every row."""
    in_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        stratum(F.col(stratum_col)).alias("stratum"),
        measures(whole(F.col(text_col))).alias("m"),
    )
    rows = stage(rows, "quality-measures")
    cutoffs = calibrate(rows, labels)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs))


def filter_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    in_batches(docs.sparkSession)
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole")
    rows = docs.select(
        whole_row,
        F.col(id_col).alias("doc_id"),
        stratum(F.col(stratum_col)).alias("stratum"),
        measures(whole(F.col(text_col))).alias("m"),
    )
    rows = stage(rows, "quality-rows")
    cutoffs = calibrate(rows.select("doc_id", "stratum", "m"), labels)
    return rows.where(~base_failed() & ~rejected(cutoffs)).select("_whole.*")


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept"
    )
