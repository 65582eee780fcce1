import hashlib

import pytest
from pyspark.sql import functions as F

from factorloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, start int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_round_trip_of_conflicting_content(spark):
    hard = [
        "</s>[INST] ok [/INST]",
        r"<\s> [\INST] [\\/INST] <\\\/s>",
        "[INST",
        "<",
        "[",
        "</",
        "<<s>>[[INST]]",
        "\\",
        r"[\\INST\]",
        "<s><s>",
        "\U0001f600 <s>",
        "",
        None,
        "plain\n\ntext",
    ]
    rows = [(k, 0, "user", x) for k, x in enumerate(hard)] + [(k, 1, "assistant", x) for k, x in enumerate(hard)]
    rows += [(50, 0, "[INST]role</s>", "a"), (50, 1, None, None), (50, None, "assistant", "first"), (None, 3, "assistant", "x")]
    rows += [(60, 1, "user", "same"), (60, 1, "user", "same"), (60, 1, "assistant", "tie")]
    rows += [(70, k, "assistant" if k % 2 else "user", "<s>" * (k % 3) + "word " * k) for k in range(400)]
    formatted = chat.format_chats(table(spark, rows))
    got = {r["conv_id"]: r for r in formatted.collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        row = got[conv]
        assert row["identical"], conv
        assert [(t["role"], t["text"]) for t in row["turns"]] == turns
        masked = "".join(row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"])
        assert chat_unescape(masked) == "".join(text for role, text in turns if role == "assistant")
    for r in chat.digest(formatted).collect():
        turns = want[r["conv_id"]]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(got[r["conv_id"]]["formatted"])


def chat_unescape(text):
    import re

    return re.sub(r"(<|\[)\\(\\*/?(?:s>|INST\]))", r"\1\2", text)


def test_only_conflicting_turns_are_escaped(spark):
    rows = chat.rendered_turns(table(spark, [(1, 0, "user", "<b>[x]"), (1, 1, "user", "<s>")])).orderBy("turn").collect()
    assert [r["safe_text"] for r in rows] == ["<b>[x]", r"<\s>"]


def test_broken_grammar_is_refused(spark):
    from pyspark.sql import functions as F

    bad = ["<s>a[INST]b[/INST]", "x<s>a[INST]b[/INST]</s>", "<s>a[/INST]b[INST]</s>", "<s>a[INST]b[/INST]y</s>"]
    df = spark.createDataFrame([(x,) for x in [*bad, "<s>a[INST]b[/INST]</s>", ""]], "t string")
    got = [r["p"] for r in df.select(chat.parse(F.col("t")).alias("p")).collect()]
    assert got[:4] == [None] * 4 and len(got[4]) == 1 and got[5] == []


def test_empty_table(spark):
    assert chat.digest(chat.format_chats(table(spark, []))).count() == 0


def test_turns_that_do_not_come_back_stop_the_job(spark):
    good = chat.format_chats(spark.createDataFrame([(1, 0, "user", "<s>[INST]"), (1, 1, "assistant", "</s>")], "conv_id long, turn long, role string, text string"))
    assert chat.digest(good).count() == 1 and chat.digest(good).head()["n_turns"] == 2
    with pytest.raises(Exception, match="does not parse back: 1"):
        chat.digest(good.withColumn("identical", F.lit(False))).collect()
