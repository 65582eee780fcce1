"""Chat formatting with a checked grammar round trip.

A turn is rendered as ``<s>ROLE[INST]TEXT[/INST]</s>``. The parser cuts the
rendered text at every control string and accepts it only if the control strings
follow each other exactly in that order; it then removes one backslash from each
marked control string. A turn is first rendered as it is and parsed again; if
role and text do not come back, its content is escaped and tried again.

Escaping puts one more backslash behind the first character of every control
string, marked ones included, so that it is undone without loss.

Defined cases: null role or text counts as empty; a null conversation id is a
conversation of its own; turns are ordered by turn (null first), then role, then
text, so repeated rows and ties are all kept; an empty table gives no row; other
columns are ignored. A conversation is one output row and must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
CONTROL = r"</?s>|\[/?INST\]"
TRAINED_ROLE = "assistant"

_BARE = r"(<|\[)(\\*/?(?:s>|INST\]))"
_MARKED = r"(<|\[)\\(\\*/?(?:s>|INST\]))"


def escape(content: Column) -> Column:
    """Add one backslash to every control string."""
    return F.regexp_replace(content, _BARE, r"$1\\$2")


def unescape(content: Column) -> Column:
    """Take one backslash from every marked control string."""
    return F.regexp_replace(content, _MARKED, "$1$2")


def render(role: Column, text: Column) -> Column:
    """One turn in the template."""
    opening, middle, end, closing = (F.lit(x) for x in CONTROLS)
    return F.concat(opening, role, middle, text, end, closing)


def parse(rendered: Column) -> Column:
    """Turns read from a rendered text, or null if it breaks the grammar.

    Of four control strings a turn, role and text stand behind the first and the
    second; nothing may stand behind the third and the fourth.
    """
    pieces = F.split(rendered, CONTROL, -1)
    controls = F.regexp_extract_all(rendered, F.lit(f"({CONTROL})"), 1)
    count = F.floor(F.size(controls) / 4).cast("int")
    wanted = F.flatten(F.array_repeat(F.array(*(F.lit(x) for x in CONTROLS)), count))
    # pieces are picked by their place, so that each array is walked once
    roles = F.filter(pieces, lambda _, k: k % 4 == 1)
    texts = F.filter(pieces, lambda _, k: k % 4 == 2)
    between = F.exists(F.filter(pieces, lambda _, k: k % 4 % 3 == 0), lambda x: x != "")
    turns = F.transform(
        F.arrays_zip(roles.alias("role"), texts.alias("text")),
        lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")),
    )
    return F.when((controls == wanted) & ~between, turns)


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """Each row with content that parses back to itself: ``role, text, safe_role, safe_text``."""
    source = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    wanted = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    same = F.coalesce(parse(render(F.col("role"), F.col("text"))) == wanted, F.lit(False))
    return (
        source.withColumn("same", same)
        .withColumn("safe_role", F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"))))
        .withColumn("safe_text", F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text"))))
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: rendered text, parsed turns, loss spans and the round-trip check.

    ``formatted`` is the text to train on, ``turns`` what the parser reads from
    it, ``loss_spans`` the start and length (code points) of every trained text in
    ``formatted`` and ``identical`` whether the turns equal the source.
    """
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    ranked = Window.partitionBy("conv_id").orderBy(*order)
    size = F.length(render(F.col("safe_role"), F.col("safe_text")))
    lead = F.length(F.concat(F.lit(CONTROLS[0]), F.col("safe_role"), F.lit(CONTROLS[1])))
    placed = (
        rendered_turns(conversations)
        .withColumn("place", F.row_number().over(ranked))
        .withColumn("start", F.sum(size).over(ranked.rowsBetween(Window.unboundedPreceding, 0)) - size + lead)
    )
    row = F.struct("place", "role", "text", "safe_role", "safe_text", "start")
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    trained = F.filter("rows", lambda x: x["role"] == TRAINED_ROLE)
    return (
        gathered.withColumn(
            "formatted", F.array_join(F.transform("rows", lambda x: render(x["safe_role"], x["safe_text"])), "")
        )
        .withColumn("turns", parse(F.col("formatted")))
        .withColumn(
            "loss_spans",
            F.transform(
                trained,
                lambda x: F.struct(x["start"].alias("start"), F.length(x["safe_text"]).cast("long").alias("length")),
            ),
        )
        .withColumn(
            "identical",
            F.coalesce(
                F.col("turns")
                == F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))),
                F.lit(False),
            ),
        )
        .select("conv_id", "formatted", "turns", "loss_spans", "identical")
    )


def checked(formatted: DataFrame) -> DataFrame:
    """The same rows; one whose turns did not come back identical stops the job."""
    message = F.concat(F.lit("conversation does not parse back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    return formatted.withColumn("turns", F.when(F.col("identical"), F.col("turns")).otherwise(F.raise_error(message)))


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser reads back from ``formatted``, which must be the source's turns."""
    formatted = checked(formatted)
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(
        F.transform(F.filter("turns", lambda t: t["role"] == TRAINED_ROLE), lambda t: t["text"]), ""
    )
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
