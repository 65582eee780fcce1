"""Sum-of-squares online packing of token ids into windows.

Documents are packed where they are read: every partition of the input keeps an
array with the number of partly filled windows at each fill level. A document
goes, as it comes, to the level (or a new window) that makes the sum of squared
counts smallest; ties go to the fullest level. That keeps the counts of all levels
small and even, so that fitting windows stay at hand. What is longer than a window
is cut into full windows first. At the end of a partition the fullest of the
windows still open stay and are filled up with pieces cut from the emptiest, as many as
those can fill; what is left is cut into lengths that are powers of two, which need no padding. Nothing is shuffled; a task holds the ids of
its own open windows only, and their number stays near that of the fill levels.

Defined cases: a null text is empty and packs the closing id alone; repeated rows
are packed as often as they come; an empty table gives no piece; null ids pass
through; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import in_batches, whole

WINDOW = 4096
CLOSING_ID = 2
VOCABULARY = "word_bpe_49k.json"

#: How a vocabulary cuts words if ``Words`` is to know its ids word by word (fixed value).
WORD_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of Latin-1 with signs behind: such a vocabulary lower-cases the letters and cuts ahead of the signs.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

#: Words that a worker remembers.
KNOWN_WORDS = 500_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Levels:
    """The level array of one packer: which windows stand at which fill level."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """``(window number, offset)`` for a document of ``size`` below the window."""
        counts, window = self.counts, self.window
        # leaving level h changes the sum by 1 - 2 N(h), reaching level h + size by 1 + 2 N(h + size);
        # a full window counts no more
        change = 2 - 2 * counts[1 : window - size + 1]
        change[:-1] += 2 * counts[1 + size : window]
        change[-1] -= 1
        change[counts[1 : window - size + 1] == 0] = np.iinfo(np.int64).max
        best = change.size - 1 - int(change[::-1].argmin())
        if change[best] < 1 + 2 * counts[size]:
            level = best + 1
            number = self.open[level].pop()
            counts[level] -= 1
        else:
            level, number = 0, self.made
            self.made += 1
        if level + size < window:
            counts[level + size] += 1
            self.open[level + size].append(number)
        return number, level

    def full(self) -> int:
        """The number of a window that is filled at once."""
        self.made += 1
        return self.made - 1


class Words:
    """Ids of white-space separated words as bytes; unknown ones are looked up together.

    Known words stand in two tables; a word met again moves to the newer one, and
    when that is full it becomes the older one, so frequent words stay known.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are parallel already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without the steps that plain words don't need
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _look_up(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            yield word, np.asarray(found.ids, "<u4").tobytes()

    def _look_up_plain(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Lower-case letters only: each word ends with its only id that closes a word."""
        groups = [words[k : k + 500] for k in range(0, len(words), 500)]
        joined = [" ".join(group) for group in groups]
        for group, found in zip(groups, self.plain.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.asarray(found.ids, "<u4")
            packed, start = ids.tobytes(), 0
            for word, end in zip(group, (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()):
                yield word, packed[start:end]
                start = end

    def learn(self, words: set[str]) -> None:
        """Have the ids of all given words in the newer table."""
        new, old = self.new, self.old
        missing = words.difference(new)
        met: dict[str, bytes] = {}
        parts: list[tuple[str, str, str]] = []
        plain, other = set(), set()
        for word in missing:
            if word in old:
                met[word] = old[word]
                continue
            found = PLAIN.fullmatch(word)
            if found is None:
                other.add(word)
                continue
            core, tail = found.groups()
            core = core.lower()
            parts.append((word, core, tail))
            if core not in new and core not in old:
                plain.add(core)
            if tail and tail not in new:
                other.add(tail)
        met.update(self._look_up_plain(sorted(plain)))
        met.update(self._look_up(sorted(other)))
        for word, core, tail in parts:
            ids = met.get(core) or new.get(core) or old[core]
            met[word] = ids + (met.get(tail) or new[tail]) if tail else ids
        if len(new) + len(met) > KNOWN_WORDS // 2:
            self.old, self.new = new, {word: new[word] for word in words if word in new}
        self.new.update(met)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; spaces and line ends separate words for this vocabulary and have no ids."""
        end = np.asarray([CLOSING_ID], "<u4").tobytes()
        split = [text.replace("\n", " ").split(" ") for text in texts]
        self.learn(set(chain.from_iterable(split)))
        known = self.new.__getitem__
        for words in split:
            yield b"".join(map(known, words)) + end


class WholeTexts:
    """Ids of whole texts, by the tokenizer as it is."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.asarray([*found.ids, CLOSING_ID], "<u4").tobytes()


def by_words(path: str) -> bool:
    """Whether a vocabulary lower-cases, drops white space and closes words, so that ids are known word by word."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normal = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        spec["model"].get("end_of_word_suffix") == "</w>"
        and normal == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": WORD_CUTS}
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
    )


_KNOWN: dict[str, Words | WholeTexts] = {}


def _words(path: str) -> Words | WholeTexts:
    if path not in _KNOWN:
        _KNOWN[path] = Words(path) if by_words(path) else WholeTexts(path)
    return _KNOWN[path]


def _settled(fills: list[int], window: int) -> int:
    """How many of the open windows stay, fullest first: as many as the tokens of the others can fill up."""
    gaps, given = 0, sum(fills)
    for k, fill in enumerate(fills):
        gaps, given = gaps + window - fill, given - fill
        if gaps > given:
            return k
    return len(fills)


def _settle(waiting: dict[int, list[tuple]], first: int, window: int) -> Iterator[tuple]:
    """Pieces of the windows still open: the fullest stay and are filled up with pieces cut from the emptiest.

    What is left of those is cut into full windows (numbered from ``first``), then powers of two.
    """
    fills = {number: sum(len(ids) for _, _, ids, _ in own) // 4 for number, own in waiting.items()}
    order = sorted(fills, key=lambda number: (-fills[number], number))
    stay = _settled([fills[number] for number in order], window)
    room = []
    for number in order[:stay]:
        offset = 0
        for doc, start, ids, tokens in waiting[number]:
            yield doc, start, ids, tokens, number, offset
            offset += len(ids) // 4
        room.append((number, offset, window - offset))
    left = sum(fills[number] for number in order[stay:]) - sum(size for _, _, size in room)
    for number in range(first, first + left // window):
        room.append((number, 0, window))
    # the ones of a binary number are the powers of two that it is the sum of
    ends = [1 << bit for bit in reversed(range(window.bit_length())) if (left % window) >> bit & 1]
    room += [(first + left // window + k, 0, size) for k, size in enumerate(ends)]
    places = iter(room)
    number, offset, size = 0, 0, 0
    for doc, start, ids, tokens in (piece for number in reversed(order[stay:]) for piece in waiting[number]):
        done, length = 0, len(ids) // 4
        while done < length:
            if not size:
                number, offset, size = next(places)
            take = min(size, length - done)
            yield doc, start + done, ids[4 * done : 4 * (done + take)], tokens, number, offset
            done, offset, size = done + take, offset + take, size - take


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents and their places: ``PIECES``, and the ids themselves if asked for.

    ``sequence_id`` has the partition in its upper bits and the window's number in
    the lower ones.
    """
    in_batches(docs.sparkSession)
    result = PIECES + ", ids array<int>" * with_ids

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        words, levels = _words(tokenizer_path), Levels(window)
        waiting: dict[int, list[tuple]] = {}

        def piece(doc: int | None, start: int, ids: bytes, tokens: int, number: int, offset: int) -> tuple:
            row = (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, number, offset)
            return (*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in result.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["sequence_id"] += base
            return out

        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch["doc_id"], words.ids(list(batch["text"]))):
                doc = None if pd.isna(doc) else int(doc)
                tokens = len(ids) // 4
                start = 0
                while tokens - start >= window:
                    rows.append(piece(doc, start, ids[4 * start : 4 * (start + window)], tokens, levels.full(), 0))
                    start += window
                if start == tokens:
                    continue
                size = tokens - start
                number, level = levels.place(size)
                waiting.setdefault(number, []).append((doc, start, ids[4 * start :], tokens))
                if level + size == window:
                    offset = 0
                    for d, s, part, t in waiting.pop(number):
                        rows.append(piece(d, s, part, t, number, offset))
                        offset += len(part) // 4
            if rows:
                yield frame(rows)
        rows = [piece(*x) for x in _settle(waiting, levels.made, window)]
        if rows:
            yield frame(rows)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return source.mapInPandas(packed, result)
