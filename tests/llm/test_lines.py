import hashlib
from collections import defaultdict

from factorloom.llm import lines
from tests.llm.helpers import ODD, ascii_lower, documents

SPACES = " \t\n\x0b\x0c\r"


def brute(rows):
    """Rows must have distinct ids."""
    holders = defaultdict(set)
    split = {doc: (text or "").split("\n") for doc, text, *_ in rows}
    key = lambda x: ascii_lower(x.strip(SPACES))
    for doc, own in split.items():
        for x in own:
            holders[key(x)].add(doc)
    out = {}
    for doc, own in split.items():
        left = [x for x in own if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == doc]
        out[doc] = (len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    common = "A line that Many documents Share"
    rows = [(k, f"own {k}\n  {common.upper() if k % 2 else common}\t\nshort\n{common}") for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "É" * 20 + "\nx"), (104, "é" * 20), (105, "É" * 20), (106, "É" * 20)]
    rows += [(107, "\n".join(f"line number {k} of a long one" for k in range(5000)) + "\n" + common)]
    rows += [(108 + k, "nineteen characters" + "\n" + "twenty characters ab") for k in range(4)]
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.digest(lines.deduplicate_lines(documents(spark, rows))).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    got = lines.deduplicate_lines(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r["n_dropped"] == 0 for r in got)
    same = [(5, "a line of twenty or more characters")] * 3 + [(None, "a line of twenty or more characters")]
    got = lines.deduplicate_lines(documents(spark, same)).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in got) == [(0, 1), (5, 0), (5, 1), (5, 1)]
    assert lines.deduplicate_lines(documents(spark, [])).count() == 0
