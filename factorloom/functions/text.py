"""Text cleaning, templating and stable hashing as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.constants import NAME_KEEP

# All Unicode white space, spelled out: Java's \s covers only the ASCII part.
WHITESPACE = (
    r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of every kind at both ends (``trim`` only drops blanks)."""
    return F.regexp_replace(col(c), rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z", "")


def squeeze(c: Column | str) -> Column:
    """Collapse each run of white space to one blank and strip the ends."""
    return F.trim(F.regexp_replace(col(c), f"[{WHITESPACE}]+", " "))


def simplify_name(c: Column | str) -> Column:
    """Matching key: lower case, every other character a blank, ends stripped.

    Inner runs of blanks are kept, so names that differ in punctuation count
    stay apart.
    """
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", " "))


def clean_name(c: Column | str, keep: str = "plain") -> Column:
    """Punctuation (bar the ``keep`` set) and white space to single blanks, ends stripped."""
    kept = "".join("\\" + ch for ch in NAME_KEEP[keep])
    return F.trim(F.regexp_replace(col(c), rf"[^\p{{L}}\p{{N}}_{kept}]+", " "))


def clean_scalar(c: Column | str) -> Column:
    """Trim and lower-case a text value."""
    return F.lower(strip(c))


def title_case(c: Column | str) -> Column:
    """Capitalise each letter that follows a non-letter, lower-case the rest.

    ``initcap`` only breaks words at blanks, so a marked blank is put behind
    every non-letter first and taken out again afterwards.
    """
    marked = F.regexp_replace(col(c), r"([^\p{L}])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def underscored(c: Column | str, characters: str = " ") -> Column:
    return F.translate(col(c), characters, "_" * len(characters))


#: So few words are looked for one by one, which compiled code does faster than a pattern (49 in less than half the time).
FEW_WORDS = 100


def trie_pattern(words: list[str]) -> str:
    """A pattern for the longest of some words at a place, which reads no letter of the text twice there.

    Words are merged by their common beginnings, so a text is compared with one letter
    of many words at a time, however many there are.
    """
    if not words or "" in words:
        raise ValueError("a pattern needs words, and none of them empty")
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def shape(node: dict) -> str:
        further = [re.escape(letter) + shape(below) for letter, below in node.items() if letter]
        if not further:
            return ""
        inner = further[0] if len(further) == 1 and "" not in node else f"(?:{'|'.join(further)})"
        return f"{inner}?" if "" in node else inner

    return shape(tree)


def first_listed(c: Column | str, words: list[str], few: int = FEW_WORDS) -> Column:
    """Place, from 0, of the first listed word that the text holds anywhere; null if it holds none.

    Beyond ``few`` words one pattern finds the longest word at every place of the text, words that
    overlap included; a word found stands for the listed words that it starts with as
    well. A thousand words then cost what a hundred do.
    """
    if len(words) <= few:
        found = F.when(F.lit(False), F.lit(0))
        for k, word in enumerate(words):
            found = found.when(col(c).contains(word), F.lit(k))
        return found
    best = {w: min(k for k, other in enumerate(words) if w.startswith(other)) for w in words}
    hits = F.regexp_extract_all(col(c), F.lit(f"(?=({trie_pattern(words)}))"), F.lit(1))
    places = F.create_map(*(F.lit(x) for pair in best.items() for x in pair))
    return F.array_min(F.transform(hits, lambda w: F.element_at(places, w)))


def contains_any(c: Column | str, words: list[str]) -> Column:
    """True when the text holds any of the words, case as written."""
    if len(words) > FEW_WORDS:
        return col(c).rlike(trie_pattern(words))
    found = F.lit(False)
    for word in words:
        found = found | col(c).contains(word)
    return found


def first_match(c: Column | str, ladder: list[tuple[list[str], str]], default) -> Column:
    """Ordered keyword ladder: the first rung with any word in the text wins."""
    words = [word for rung, _ in ladder for word in rung]
    values = F.array(*(F.lit(value) for rung, value in ladder for _ in rung))
    return F.coalesce(F.get(values, first_listed(c, words)), default if isinstance(default, Column) else F.lit(default))



def replace_first(c: Column | str, target: str, replacement: Column) -> Column:
    """Replace only the first occurrence of a literal; unchanged when absent.

    One anchored pattern, so chained calls do not multiply their input.
    """
    # the regex engine reads backslash and dollar in a replacement
    plain = F.replace(F.replace(replacement, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(col(c), F.lit(rf"(?s)\A(.*?)\Q{target}\E"), F.concat(F.lit("$1"), plain))


def part_before(c: Column | str, separator: str) -> Column:
    return F.substring_index(col(c), separator, 1)


def source_version(c: Column | str) -> Column:
    """Last ``_`` part when it starts with a digit, else ``1.0``."""
    last = F.element_at(F.split(col(c), "_"), -1)
    return F.when(col(c).contains("_") & last.rlike(r"\A[0-9]"), last).otherwise(F.lit("1.0"))


def slug(c: Column | str) -> Column:
    return underscored(F.lower(col(c)))


def hash_key(*parts: Column, seed: int | str = 42) -> Column:
    """Reproducible random order: md5 of the parts and the seed."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def hash_pick(*parts: Column, n: int) -> Column:
    """Reproducible choice in ``0..n-1``."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % n).cast("int")
