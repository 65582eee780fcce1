"""Toxicity by compression distance.

Two zstandard dictionaries are used: one trained on ordinary text, and one for toxic
text, which continues the first with the words and word openings that recur in toxic rows and
hardly occur in ordinary ones, so both know ordinary text equally well. (Dictionaries trained on
the windows of each class alone did not tell the classes apart; the README has figures.) A
text is cut into windows of whole words; every window is compressed with both
dictionaries, and the bytes that the toxic one saves are its distance. Windows of
labelled rows that had no part in training give the log likelihood ratio of each
distance; the sums over a document's windows are calibrated to a probability with
the share of toxic rows among all labelled ones, so that 0.5 is the threshold.

Training reads the whole texts of at most ``FIT_ROWS`` rows of each class (chosen by
the hash of the id), in tasks: counts of words, the words of the toxic dictionary in each text, and
histograms of distances come back. Only the dictionary of ordinary text learns
from a sample of each text, ``FIT_WINDOWS`` windows chosen by hash from all of it; these
windows come to the driver, where it is trained, at most ``FIT_ROWS / 2 * FIT_WINDOWS`` of them.
Scoring reads whole texts of all rows. The model is a few kilobytes and goes to the
tasks as it is.

Defined cases: null and empty texts have one empty window and get the score of a
text without toxic windows; rows without or with null labels teach nothing; with
no rows of a class to learn from, every score is 0 (no toxic ones) or 1 (no
ordinary ones); repeated rows score alike; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import in_batches, whole
from factorloom.session import stage

FIT_ROWS = 3000
#: Windows of an ordinary text that the dictionary of ordinary text may be trained on.
FIT_WINDOWS = 320
#: Words and openings that a task counts before it hands them on.
HELD_WORDS = 200_000
WINDOW = 64
#: Bytes of the ordinary dictionary and of what the toxic one adds.
ORDINARY_BYTES = 4096
TOXIC_BYTES = 512
#: A word, or the opening of words, teaches toxicity if this part of the toxic rows has it, so many times the part of
#: ordinary rows.
LEAST_PART = 0.015
TIMES = 8
LEAST_OPENING = 4
MOST_OPENING = 9
#: Least bytes of a match and bytes of telling words that are tried; held-out rows decide.
MATCHES = ((5, 512), (6, 512), (6, 256), (7, 256))
#: Distances beyond count as this.
MOST = 24

_OPENING = 48
_GRID = np.arange(-MOST, MOST + 1)


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """Lower-cased words joined to windows of about ``size`` bytes; a longer word is a window of its own."""
    out, have, length = [], [], 0
    for word in text.lower().encode("utf-8", "surrogatepass").split():
        if have and length + len(word) > size:
            out.append(b" " + b" ".join(have) + b" ")
            have, length = [], 0
        have.append(word)
        length += len(word) + 1
    out.append(b" " + b" ".join(have) + b" ")
    return out


def openings(text: str) -> set[bytes]:
    """Lower-cased words of a text and their first letters."""
    out = set()
    for word in set(text.lower().encode("utf-8", "surrogatepass").split()):
        out.add(word)
        out.update(word[:k] for k in range(LEAST_OPENING, min(len(word), MOST_OPENING + 1)))
    return out


@dataclass
class Model:
    """Dictionaries, log ratios by distance and the calibration."""

    ordinary: bytes = b""
    toxic: bytes = b""
    full: bool = True
    match: int = 5
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(2 * MOST + 1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    constant: float | None = None

    def __post_init__(self) -> None:
        self._coders: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coders": None}

    def _coder(self, content: bytes):
        import zstandard as z

        # the fast strategy with a step leaves literals as they are: a match saves its whole length
        settings = z.ZstdCompressionParameters(
            window_log=16, hash_log=16, chain_log=16, search_log=4, min_match=self.match, target_length=1,
            strategy=z.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        kind = z.DICT_TYPE_FULLDICT if self.full else z.DICT_TYPE_RAWCONTENT
        dictionary = z.ZstdCompressionDict(content, dict_type=kind)
        dictionary.precompute_compress(compression_params=settings)
        return z.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress

    def distances(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        if self._coders is None:
            # as much filling as the other one has toxic words keeps all distances to ordinary text the same
            filling = b"\0" * len(self.toxic)
            self._coders = (self._coder(self.ordinary + filling), self._coder(self.ordinary + self.toxic))
        plain, toxic = self._coders
        # an opening that both know makes every window worth compressing, however little else they know of it
        opening = self.ordinary[-_OPENING:]
        found = [len(plain(w)) - len(toxic(w)) for w in (opening + w for w in windows(text))]
        return np.clip(np.array(found), -MOST, MOST)

    def features(self, counts: np.ndarray) -> np.ndarray:
        """What the calibration sees of the histogram of a text's distances."""
        total = counts @ self.ratios
        return np.array([1.0, total, total / np.sqrt(counts.sum()), _GRID[counts > 0].max() / 4.0])

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return float(1.0 / (1.0 + np.exp(-np.clip(self.features(_histogram(self.distances(text))) @ self.weights, -30, 30))))


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """A trained dictionary, or nothing if there is too little to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, d=6, k=segment).as_bytes()
    except z.ZstdError:
        return b""


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-3] * (x.shape[1] - 1)]) * weight.sum() / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _telling(in_t: Counter, in_o: Counter, n_t: int, n_o: int) -> set[bytes]:
    """Words and openings that recur in ``n_t`` toxic rows and hardly occur in ``n_o`` ordinary ones."""
    telling = {w for w, n in in_t.items() if n >= _least(n_t) and n / n_t > TIMES * in_o[w] / n_o}
    # an opening is left to the word or longer opening that stands for nearly all of its rows
    longest: dict[bytes, int] = {}
    for w in telling:
        for k in range(LEAST_OPENING, len(w)):
            longest[w[:k]] = max(longest.get(w[:k], 0), in_t[w])
    return {w for w in telling if longest.get(w, 0) < 0.8 * in_t[w]}


def _least(rows: int) -> float:
    """Toxic rows that a word or opening must be in."""
    return max(2, LEAST_PART * rows)


def _chosen(text: str) -> list[bytes]:
    """At most ``FIT_WINDOWS`` windows of a whole text, by their hash and not by place."""
    found = windows(text)
    if len(found) <= FIT_WINDOWS:
        return found
    # equal windows differ by place
    ranked = sorted(range(len(found)), key=lambda k: zlib.crc32(found[k] + k.to_bytes(8, "little")))
    return [found[k] for k in sorted(ranked[:FIT_WINDOWS])]


def _models(in_t: Counter, telling: set[bytes], per_text: list[list[bytes]], ordinary: list[bytes]) -> list[Model]:
    """Uncalibrated models, one for each entry of ``MATCHES``.

    ``per_text`` has the telling words of each toxic text, ``ordinary`` windows of ordinary ones.
    """
    samples = [b" " + b" ".join(found) + b" " for found in per_text if found]
    base = _trained(ORDINARY_BYTES, ordinary, 32)
    # the most frequent ones stand last, where they are nearest
    ranked = b" " + b" ".join(sorted(telling, key=lambda w: (in_t[w], w))) + b" "
    learnt = _trained(TOXIC_BYTES + 512, samples, 16) if sum(map(len, samples)) > 8 * TOXIC_BYTES else b""
    ordinary_bytes = base or b" ".join(ordinary)[-ORDINARY_BYTES:] or b" " * 8
    return [
        Model(ordinary_bytes, (learnt[-TOXIC_BYTES:] if match == 5 else b"") + ranked[-content:], bool(base), match)
        for match, content in MATCHES
    ]


def _histogram(found: np.ndarray) -> np.ndarray:
    return np.bincount(found + MOST, minlength=_GRID.size)


def _best(models: list[Model], toxic: list[np.ndarray], ordinary: list[np.ndarray], toxic_part: float) -> Model:
    """The model with the least loss on held-out texts; a text has one histogram of distances for each model."""
    best, least = Model(), np.inf
    for k, model in enumerate(models):
        loss = _calibrated(model, [h[k] for h in toxic], [h[k] for h in ordinary], toxic_part)
        if loss < least:
            best, least = model, loss
    return best


def train(toxic: list[str], ordinary: list[str], toxic_part: float) -> Model:
    """Fit on texts of both classes; ``toxic_part`` is the share of toxic rows to calibrate for."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if not toxic or not ordinary:
        return Model(constant=1.0 if toxic else 0.0)
    (fit_t, held_t), (fit_o, held_o) = _halves(toxic), _halves(ordinary)
    in_t = Counter(w for t in fit_t for w in openings(t))
    in_o = Counter(w for t in fit_o for w in openings(t))
    telling = _telling(in_t, in_o, len(fit_t), len(fit_o))
    per_text = [sorted(openings(t) & telling) for t in fit_t]
    models = _models(in_t, telling, per_text, [w for t in fit_o for w in _chosen(t)])
    seen = [[np.array([_histogram(m.distances(t)) for m in models]) for t in held] for held in (held_t, held_o)]
    return _best(models, *seen, toxic_part)


def _halves(rows: list) -> tuple[list, list]:
    """Rows to train on and rows to calibrate on; a single one does both."""
    return rows[::2], rows[1::2] or rows


def _calibrated(model: Model, toxic: list[np.ndarray], ordinary: list[np.ndarray], toxic_part: float) -> float:
    """Set ratios and weights from histograms of texts that had no part in training; the mean log loss there."""
    p_t, p_o = (np.sum(x, axis=0) + 0.5 for x in (toxic, ordinary))
    model.ratios = np.clip(np.log(p_t / p_t.sum()) - np.log(p_o / p_o.sum()), -4, 4)
    x = np.array([model.features(h) for h in [*toxic, *ordinary]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    weight = np.where(y == 1, toxic_part / len(toxic), (1 - toxic_part) / len(ordinary)) * len(y)
    model.weights = _logistic(x, y, weight)
    p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
    return float(-(weight * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum() / weight.sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the rows of ``docs`` that ``labels`` (``id_col, toxic``) marks."""
    in_batches(docs.sparkSession)
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    counts = dict(marked.groupBy("toxic").count().collect())
    order = [F.xxhash64(F.col(id_col), F.lit(7)), F.col(id_col)]
    chosen = [marked.where(F.col("toxic") == toxic).orderBy(*order).limit(FIT_ROWS) for toxic in (0, 1)]
    # at most 2 * FIT_ROWS ids meet the documents, and as many whole texts are written for the tasks
    known = (
        docs.select(F.col(id_col), whole(F.col(text_col)).alias("text"))
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), id_col)
        .groupBy(id_col, "toxic")
        .agg(F.max("text").alias("text"))
        .select(F.col(id_col).alias("id"), "toxic", "text")
    )
    known = stage(known, "toxicity-known")
    rows = sorted(known.select("id", "toxic", F.md5("text").alias("text")).collect(), key=lambda r: r["id"])
    ids: dict[int, list] = {}
    for toxic in (0, 1):
        # of equal texts one teaches
        first: dict[str, object] = {}
        for r in rows:
            if r["toxic"] == toxic:
                first.setdefault(r["text"], r["id"])
        ids[toxic] = list(first.values())
    if not ids[0] or not ids[1]:
        return Model(constant=1.0 if ids[1] else 0.0)
    (fit_t, held_t), (fit_o, held_o) = _halves(ids[1]), _halves(ids[0])
    in_t = _counted(known, set(fit_t), _least(len(fit_t)))
    words = sorted(in_t)
    found = _found(known, set(fit_t), set(fit_o), words)
    in_o = Counter(words[k] for i in fit_o for k in found[i]["words"])
    telling = _telling(in_t, in_o, len(fit_t), len(fit_o))
    per_text = [[words[k] for k in found[i]["words"] if words[k] in telling] for i in fit_t]
    models = _models(in_t, telling, per_text, [bytes(w) for i in fit_o for w in found[i]["windows"]])
    seen = _seen(known, {*held_t, *held_o}, models)
    total = sum(counts.values())
    return _best(models, [seen[i] for i in held_t], [seen[i] for i in held_o], counts.get(1, 0) / total)


def _counted(known: DataFrame, ids: set, least: float) -> Counter:
    """Texts with each word or opening, of those that at least ``least`` of the texts have."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some: Counter = Counter()
            for text in batch["text"][batch["id"].isin(ids)]:
                some.update(openings(text))
                if len(some) > HELD_WORDS:
                    yield pd.DataFrame({"word": list(some), "n": list(some.values())})
                    some = Counter()
            yield pd.DataFrame({"word": pd.Series(list(some), dtype=object), "n": pd.Series(list(some.values()), dtype="int64")})

    words = known.where("toxic = 1").select("id", "text").mapInPandas(count, "word binary, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return Counter({bytes(r["word"]): r["n"] for r in words.collect()})


def _found(known: DataFrame, toxic: set, ordinary: set, words: list[bytes]) -> dict:
    """By id, the places in ``words`` of those that a text has and, of an ordinary text, some of its windows."""
    place = {w: k for k, w in enumerate(words)}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, text in zip(batch["id"], batch["text"]):
                if i in toxic or i in ordinary:
                    has = sorted(place[w] for w in openings(text) if w in place)
                    yield pd.DataFrame({"id": [i], "words": [has], "windows": [_chosen(text) if i in ordinary else []]})

    kind = known.schema["id"].dataType.simpleString()
    rows = known.select("id", "text").mapInPandas(find, f"id {kind}, words array<int>, windows array<binary>")
    return {r["id"]: r for r in rows.collect()}


def _seen(known: DataFrame, ids: set, models: list[Model]) -> dict:
    """By id, the histograms of a whole text's distances, one for each model."""

    def see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch[batch["id"].isin(ids)]
            found = [np.concatenate([_histogram(m.distances(t)) for m in models]) for t in own["text"]]
            yield pd.DataFrame({"id": own["id"].to_numpy(), "counts": pd.Series(found, dtype=object)})

    kind = known.schema["id"].dataType.simpleString()
    rows = known.select("id", "text").mapInPandas(see, f"id {kind}, counts array<long>").collect()
    return {r["id"]: np.array(r["counts"]).reshape(len(models), -1) for r in rows}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text."""
    in_batches(docs.sparkSession)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([model.score(t) for t in batch["text"]], float)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "score": found, "predicted": (found >= 0.5).astype("int32")}
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return source.mapInPandas(scored, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: a fifth, by the CRC-32 of the id's text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
