import re

from factorloom.llm import secrets
from tests.llm.helpers import LONG, ODD, documents


def brute(text):
    out = []
    base = [
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"AKIA[A-Z0-9]+",
        r"[0-9a-f]+",
    ]
    for rank, (kind, pattern, group, least) in enumerate(zip(("assign", "access", "hex"), base, (2, 0, 0), (6, 20, 24))):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    return sorted(out)


CASES = [
    "password=hunter22 and PassWd : 'abc' token:\"abcdef\"",
    "secret=token:abcdefgh then api_key = 12345678 apikey=aaaaaa",
    "\U0001f600 é token=abcdefg AKIA" + "A" * 16 + " AKIAshort AKIA" + "B" * 15,
    "deadbeef" * 3 + " " + "a" * 23 + " x" + "0" * 24 + "G" + "f" * 30,
    "token=" + "ab12" * 12 + ";secret ===== abcdef token='' token==abcdefg",
    "xAKIAAKIA" + "Z" * 20 + "token=ſecret ſecret=abcdefg Kpassword=1234567",
    "ghp_" + "a1" * 12 + " -----BEGIN RSA PRIVATE KEY----- eyJhbGciOi.eyJzdWIiOiIx.sig_-abc123",
]


def test_spans_against_brute_force(spark):
    rows = list(enumerate([*CASES, None, "", LONG + " token=abcdefgh"])) + [(100 + k, CASES[0]) for k in range(20)]
    findings, entries = secrets.scan_new(documents(spark, rows))
    text_of = dict(rows)
    got = findings.collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [tuple(s) for s in r["spans"]]
        assert [s for s in spans if s[1] < 3] == brute(text_of[r["doc_id"]])
        assert spans == sorted(spans)
    kinds = {s["kind"] for r in got if r["doc_id"] == 6 for s in r["spans"]}
    assert {"forge", "pem", "jwt"} <= kinds
    assert entries.count() == len({t or "" for _, t in rows})


def test_text_of_very_many_matches(spark):
    many = " \U0001f600".join(f"token={k:07d} AKIA{'A' * 16}" if k % 3 else f"secret='{k}'" for k in range(20_000))
    counts = [0, 1, secrets.RUN - 1, secrets.RUN, secrets.RUN + 1, 2 * secrets.RUN]
    rows = [(1, many)] + [(10 + k, "token=abcdefg " * n) for k, n in enumerate(counts)]
    text_of = dict(rows)
    for r in secrets.scan_new(documents(spark, rows))[0].collect():
        assert [tuple(s) for s in r["spans"]] == brute(text_of[r["doc_id"]])


def test_ledger_is_incremental(spark):
    first = documents(spark, [(1, CASES[0]), (2, CASES[1])])
    _, ledger = secrets.scan_new(first)
    ledger = ledger.unionByName(ledger)
    later = documents(spark, [(1, CASES[0]), (2, CASES[2]), (3, CASES[0])])
    findings, new = secrets.scan_new(later, ledger)
    assert new.count() == 1
    plain, _ = secrets.scan_new(later)
    key = lambda df: sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in df.collect())
    assert key(findings) == key(plain)
    _, other = secrets.scan_new(later, ledger, version="2")
    assert other.count() == 2


def test_loads_share_a_stored_ledger(spark, monkeypatch):
    scanned = []
    real = secrets.scan
    monkeypatch.setattr(secrets, "scan", lambda blobs, *a: scanned.append(blobs) or real(blobs, *a))
    loads = [documents(spark, [(1, CASES[0]), (2, CASES[1]), (3, None)]), documents(spark, [(4, CASES[1]), (5, CASES[2]), (6, "")])]
    ledger = secrets.Ledger(spark)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"] if s["rank"] < 3] for r in secrets.scan_loads(loads, ledger).collect()}
    assert got == {k: brute(t) for k, t in [(1, CASES[0]), (2, CASES[1]), (3, None), (4, CASES[1]), (5, CASES[2]), (6, "")]}
    assert ledger.read().count() == 4 and [blobs.count() for blobs in scanned] == [3, 1]
    # the same table under its path: nothing is left to scan, another rule version scans all
    again = secrets.Ledger(spark, ledger.path)
    assert secrets.scan_loads(loads, again).count() == 6 and ledger.read().count() == 4
    secrets.scan_loads(loads, again, version="2")
    assert {tuple(r) for r in ledger.read().groupBy("rule_version").count().collect()} == {("1", 4), ("2", 4)}


def test_odd_rows(spark):
    findings, _ = secrets.scan_new(documents(spark, ODD))
    assert secrets.digest(findings).count() == len(ODD)
    findings, entries = secrets.scan_new(documents(spark, []))
    assert findings.count() == 0 and entries.count() == 0
