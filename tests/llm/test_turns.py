import hashlib
import itertools
import random
import re
import zlib

import pytest

from factorloom.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string, slot string, place string, codes string"
ROLES = {"u": "user", "a": "assistant", "s": "system"}


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


def faults(rows):
    """First fault of each turn, by the stated rules."""
    out, seen = [], set()
    for _, role, text in rows:
        inner = re.sub(r"[\x20\x09-\x0D]", "", text)
        if not inner:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif inner[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Dynamic programming over all paths: cost, audit and repaired turns."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}  # initial of the turn before: those that may follow
    state = {("", False): (0, "", [])}

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserted(states):
        states = dict(states)
        for _ in range(3):
            for (last, _), (cost, audit, kept) in list(states.items()):
                role = "a" if last == "u" else "u"
                better(states, (role, True), (cost + 2, audit + "I", kept + [(ROLES[role], "")]))
        return states

    for (_, role, text), mark in zip(rows, marks):
        new = {}
        for (last, _), (cost, audit, kept) in inserted(state).items():
            better(new, (last, False), (cost + 3, audit + "D", kept))
            if mark in ("blank", "duplicate"):
                continue
            extra = mark == "truncated"
            if role[:1] and role[:1] in legal[last]:
                better(new, (role[:1], False), (cost + extra, audit + "K", kept + [(role, text)]))
            forced = "a" if last == "u" else "u"
            better(new, (forced, False), (cost + 2 + extra, audit + "R", kept + [(ROLES[forced], text)]))
        # equal nodes, whether an insert led there or not
        state = {}
        for (last, _), value in new.items():
            better(state, (last, False), value)
    ends = inserted(state)
    done = [v for (last, _), v in ends.items() if last in ("", "a")]
    return min(done, key=lambda v: v[:2])


def brute(rows):
    """``conv_id: report`` of turns after damage."""
    out, known = {}, {}
    for conv, turn, role, text in rows:
        known.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in known.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults(own)
        cost, audit, kept = cheapest(own, marks)
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        counts = [marks.count(m) for m in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        rest = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if rest == 0:
            continue
        text = "" if rest == 1 else re.sub("[.!?]", "", text) if rest == 2 else text
        out += [(conv, turn, "user" if rest == 4 else role, text)] * (2 if rest == 3 else 1)
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reported(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES[1:]) for r in df.select(*NAMES).collect()}


def invented(rng, count, most):
    rows = []
    for conv in range(count):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([0, 1, 1, 1, 1, 2, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ab"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", " \t\n", "", None, f"Text {rng.randint(0, 5)}.", "Long text é 😀."])
            rows.append((conv, rng.choice([turn] * 9 + [None]), role, text))
    return rows


def test_search_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        codes = "".join(rng.choice("uuaasSUA-?!") for _ in range(rng.randint(1, 9)))
        own = [(0, {"?": "x", "!": "x"}.get(c, ROLES.get(c.lower(), "x")), "") for c in codes]
        marks = ["blank" if c == "-" else "truncated" if c.isupper() or c == "!" else "" for c in codes]
        chain = turns.Chain()
        at = rng.randint(0, len(codes))
        parts = [p for p in (codes[:at], codes[at:]) if p]
        for part in parts:
            chain.add(turns.transfers(part))
        cost, nodes, closing = chain.close()
        audit = "".join(turns._search(p, *n)[1] for p, n in zip(parts, nodes)) + "I" * closing
        assert (cost, audit) == cheapest(own, marks)[:2], codes


def test_reports_and_repaired_turns(spark):
    rows = invented(random.Random(2), 400, 9)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (9000, None, None, None)]
    rows += [rows[0], rows[0], (9001, 1, "system", "Only."), (9002, 5, "user", "word " * 40_000 + ".")]
    want = brute(rows)
    assert reported(turns.report(table(spark, rows), table(spark, rows))) == want
    repair = turns.Repair(table(spark, rows, 5))
    texts = {}
    for r in sorted(repair.repaired().collect(), key=lambda r: r["place"]):
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {
        c: w[-1] for c, w in want.items() if w[-1] != hashlib.sha256(b"").hexdigest()
    }


def test_long_conversation_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = invented(rng, 30, 6)
    rows += [(77_000, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"T{k}.", f"t{k}", "", "Same."])) for k in range(1500)]
    want = brute(rows)
    for block in (7, 512):
        monkeypatch.setattr(turns, "BLOCK", block)
        assert reported(turns.report(table(spark, rows), table(spark, rows))) == want


def test_query_damages_and_keeps_every_conversation(spark, tmp_path):
    rows = invented(random.Random(4), 500, 7) + [(None, None, "user", "A."), (None, 3, None, "B.")]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = reported(queries.op12_turn_repair(spark, str(tmp_path)))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {r[0]: empty for r in rows} | brute(damage(rows))
    assert got == want and empty in got.values()


def test_nothing(spark):
    assert reported(turns.report(table(spark, []), table(spark, []))) == {}
    every = table(spark, [(3, 1, "user", "x")])
    assert list(reported(turns.report(table(spark, []), every))) == [3]


@pytest.mark.parametrize("codes,audit", [("s", "D"), ("ua", "KK"), ("u", "KI"), ("a", "IK"), ("-", "D"), ("su", "KKI"), ("uu", "KR")])
def test_small_audits(codes, audit):
    chain = turns.Chain()
    chain.add(turns.transfers(codes))
    _, [(entry, leave)], closing = chain.close()
    assert turns._search(codes, entry, leave)[1] + "I" * closing == audit
