"""Repair of conversation structure at least cost, by bidirectional Dijkstra over the edit lattice.

A repaired conversation has the roles ``(s?(ua)+)?`` by their initials. The lattice has a
column for every place between turns and four nodes in each: nothing kept yet, a system
turn kept, a user turn expected, an assistant turn expected. An edit is an edge: Keep
(0) and Rerole (2) take a turn, Delete (3) drops it, Insert (2) adds an empty turn in
front of one or at the end. A blank or repeated turn can only be deleted; a truncated one that
stays costs 1. Forward and reverse heaps meet; the search goes on until every path of
the least cost has been crossed, and of the crossings the least concatenation of both
sides' audits (initials of the edits, compared as ASCII) is taken. Audits of paths
between the same two nodes are never prefixes of one another, so the least one of a
side is always part of the least whole.

A conversation of any length is repaired in blocks of ``BLOCK`` turns at most. All turns
are range-sorted by conversation and turn, so a long conversation lies in many files.
A block tells, for each node it can be entered by and left by, the least cost and the rank of its
audit; these few numbers are chained in order, which settles the nodes of every block, and its
audit is searched once more for that pair alone. Only text that is read
to be written again, and the hash of a conversation, which is a chain itself, pass in order; no
conversation is held in memory, but for its audit, which is a value of the result.

Defined cases: a null role or text is one space; turns are ordered by number, nulls
first, then role and text; turns that are equal in all of these follow one another, and
all but the first are repeated ones; a null conversation id is a
conversation of its own; an empty role has no initial and cannot be kept; a conversation
whose turns are all deleted has no repaired turn; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import SPACES, in_batches
from factorloom.session import stage

#: Turns of a block.
BLOCK = 512

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Nodes of a column: nothing kept, system kept, user expected, assistant expected.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The node that a turn of this initial leads to.
_KEEP = {
    START: {"s": SYSTEM, "u": ASSISTANT},
    SYSTEM: {"u": ASSISTANT},
    USER: {"u": ASSISTANT},
    ASSISTANT: {"a": USER},
}
_NEXT = {START: ASSISTANT, SYSTEM: ASSISTANT, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that end a conversation at a node.
_CLOSING = {START: 0, SYSTEM: 2, USER: 0, ASSISTANT: 1}
_ROLE = {START: "user", SYSTEM: "user", USER: "user", ASSISTANT: "assistant"}

#: A turn is one character: its initial, upper case if truncated, ``-`` if it must go, ``?`` or ``!`` (truncated) without a legal initial.
MUST_GO, OTHER, OTHER_CUT = "-", "?", "!"


def _edges(code: str, node: int) -> list[tuple[int, int, str]]:
    """``(cost, node, initial)`` of the edits that use up a turn."""
    out = [(DELETE, node, "D")]
    if code != MUST_GO:
        cut = TRUNCATED if code.isupper() or code == OTHER_CUT else 0
        kept = _KEEP[node].get(code.lower())
        if kept is not None:
            out.append((cut, kept, "K"))
        out.append((REROLE + cut, _NEXT[node], "R"))
    return out


def _search(codes: str, entry: int, leave: int) -> tuple[int, str] | None:
    """Least cost and audit from node ``entry`` before the turns to node ``leave`` behind them.

    Inserts stand in front of a turn, none behind the last one. Nodes of a heap are
    taken by cost and, among equal ones, in the direction of the search, since edges
    without cost lead from column to column; a label is thus final when it is taken.
    """
    end = len(codes)
    labels: list[dict[tuple[int, int], tuple[int, str]]] = [{(0, entry): (0, "")}, {(end, leave): (0, "")}]
    done: list[set[tuple[int, int]]] = [set(), set()]
    heaps: list[list[tuple[int, int, int]]] = [[(0, 0, entry)], [(0, -end, leave)]]
    best: int | None = None

    def forward(at: int, node: int) -> Iterator[tuple[int, tuple[int, int], str]]:
        if at < end:
            yield INSERT, (at, _NEXT[node]), "I"
            for cost, to, edit in _edges(codes[at], node):
                yield cost, (at + 1, to), edit

    def reverse(at: int, node: int) -> Iterator[tuple[int, tuple[int, int], str]]:
        for source in range(4):
            if at < end and _NEXT[source] == node:
                yield INSERT, (at, source), "I"
            if at:
                for cost, to, edit in _edges(codes[at - 1], source):
                    if to == node:
                        yield cost, (at - 1, source), edit

    moves = forward, reverse
    while heaps[0] and heaps[1]:
        # paths of the least cost still to be crossed would cost both tops at least
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, column, node = heapq.heappop(heaps[side])
        place = (abs(column), node)
        if place in done[side]:
            continue
        done[side].add(place)
        audit = labels[side][place][1]
        for step, to, edit in moves[side](*place):
            label = (cost + step, audit + edit if side == 0 else edit + audit)
            known = labels[side].get(to)
            if known is None or label < known:
                labels[side][to] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(heaps[side], (label[0], to[0] if side == 0 else -to[0], to[1]))
        other = labels[1 - side]
        for to in (place, *(to for _, to, _ in moves[side](*place))):
            if to in other and to in labels[side]:
                total = labels[side][to][0] + other[to][0]
                best = total if best is None else min(best, total)
    if best is None:
        return None
    met = (
        labels[0][place][1] + labels[1][place][1]
        for place in labels[0].keys() & labels[1].keys()
        if labels[0][place][0] + labels[1][place][0] == best
    )
    return best, min(met)


@lru_cache(maxsize=20_000)
def least(codes: str, entry: int, leave: int) -> tuple[int, str] | None:
    """``_search``, remembered for short turn patterns that recur."""
    return _search(codes, entry, leave)


def _least(codes: str, entry: int, leave: int) -> tuple[int, str] | None:
    return least(codes, entry, leave) if len(codes) <= 16 else _search(codes, entry, leave)


def transfers(codes: str, entries: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT)) -> list[tuple[int, int, int, int]]:
    """``(entry, leave, cost, rank)`` of a block; ranks order the audits of an entry."""
    out = []
    for entry in entries:
        found = [(leave, r) for leave in range(4) if (r := _least(codes, entry, leave)) is not None]
        order = {audit: k for k, audit in enumerate(sorted(audit for _, (_, audit) in found))}
        out += [(entry, leave, cost, order[audit]) for leave, (cost, audit) in found]
    return out


class Chain:
    """Chains the blocks of a conversation; costs and orders of the paths to each node are kept, not the paths."""

    def __init__(self):
        #: node: cost and place among the audits so far.
        self.heads: dict[int, tuple[int, int]] = {START: (0, 0)}
        self.back: list[tuple[int, ...]] = []

    def add(self, block: list[tuple[int, int, int, int]]) -> None:
        reached: dict[int, tuple[int, int, int, int]] = {}
        for entry, leave, cost, rank in block:
            if entry in self.heads:
                before, order = self.heads[entry]
                # audits of different nodes differ within their first shorter one, so their order stays
                label = (before + cost, order, rank, entry)
                if leave not in reached or label < reached[leave]:
                    reached[leave] = label
        places = {key: k for k, key in enumerate(sorted(x[1:3] for x in reached.values()))}
        self.heads = {leave: (x[0], places[x[1:3]]) for leave, x in reached.items()}
        self.back.append(tuple(reached[n][3] if n in reached else -1 for n in range(4)))

    def close(self) -> tuple[int, list[tuple[int, int]], int]:
        """Cost, nodes (entry, leave) of every block and the inserts behind the last turn."""
        cost, _, node = min((c + INSERT * _CLOSING[n], order, n) for n, (c, order) in self.heads.items())
        closing, nodes = _CLOSING[node], []
        for back in reversed(self.back):
            nodes.append((back[node], node))
            node = back[node]
        return cost, nodes[::-1], closing


def repaired_roles(codes: str, audit: str, entry: int) -> Iterator[tuple[str, str | None]]:
    """``(edit, role)`` of an audit: the role of an added or reroled turn, None for others."""
    node, turns = entry, iter(codes)
    for edit in audit:
        code = next(turns, "") if edit != "I" else ""
        if edit in "IR":
            yield edit, _ROLE[node]
            node = _NEXT[node]
        else:
            yield edit, None
            if edit == "K":
                node = _KEEP[node][code.lower()]


# The Spark side: faults, sorted turns, blocks, chains, repaired turns.

_VISIBLE = r"[^\x20\x09-\x0D]"


def _sorted(conversations: DataFrame) -> DataFrame:
    """All turns written in order of conversation and turn: ``conv_id, turn, role, text, slot, place``."""
    filled = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    # very long texts are no sort keys; equal ones still follow one another
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.sha2("text", 256)]
    ranged = stage(filled.repartitionByRange(*order).sortWithinPartitions(*order), "turns-sorted")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return ranged.select("*", part.alias("slot"), F.col("_metadata.row_index").alias("place"))


def _faulty(turns: DataFrame) -> DataFrame:
    """Turns without their texts, with ``fault`` (null, blank, duplicate or truncated) and ``code``."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    narrow = turns.select(
        "conv_id",
        "turn",
        "slot",
        "place",
        F.substring("role", 1, 1).alias("initial"),
        F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("content"),
        (~F.col("text").rlike(_VISIBLE)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
    )
    seen = Window.partitionBy("conv_id", "content").orderBy("slot", "place")
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.row_number().over(seen) > 1, "duplicate")
        .when(F.col("cut"), "truncated")
    )
    legal = F.col("initial").isin("s", "u", "a")
    staying = F.when(legal, F.when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))).otherwise(
        F.when(F.col("cut"), OTHER_CUT).otherwise(OTHER)
    )
    return narrow.withColumn("fault", fault).withColumn(
        "code", F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(staying)
    )


def _chunk() -> Column:
    return F.floor(F.col("place") / BLOCK).cast("long").alias("chunk")


_BLOCK_COLUMNS = (
    "conv_id {id}, slot int, chunk long, codes string, opens boolean, blank long, duplicate long, truncated long, "
    "illegal long, first string, last string, n_turns long, least_turn long, most_turn long, "
    "transfers array<struct<entry:int,leave:int,cost:long,rank:int>>"
)
_LEGAL = ("su", "ua", "au")


def _blocks(faulty: DataFrame) -> DataFrame:
    """A row for the turns of a conversation in a block, with its costs from node to node."""
    kind = faulty.schema["conv_id"].dataType.simpleString()
    row = F.struct("place", "turn", "code", "initial", "fault")
    # a block has BLOCK turns at most
    gathered = faulty.groupBy("conv_id", "slot", _chunk()).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    of = lambda name: F.transform("rows", lambda x: x[name])
    counted = lambda name: F.size(F.filter("rows", lambda x: x["fault"] == name)).cast("long").alias(name)
    initials = of("initial")
    pairs = F.zip_with(initials, F.slice(initials, F.lit(2), F.size("rows")), lambda x, y: F.concat(x, y))
    turns = F.filter(F.array_distinct(of("turn")), lambda x: x.isNotNull())
    shaped = gathered.select(
        "conv_id",
        "slot",
        "chunk",
        F.array_join(of("code"), "").alias("codes"),
        # only a block that starts where its chunk does can go on with an earlier one
        (F.get(of("place"), F.lit(0)) % BLOCK != 0).alias("opens"),
        counted("blank"),
        counted("duplicate"),
        counted("truncated"),
        F.size(F.filter(pairs, lambda x: x.isNotNull() & ~x.isin(*_LEGAL))).cast("long").alias("illegal"),
        F.get(initials, F.lit(0)).alias("first"),
        F.element_at(initials, -1).alias("last"),
        F.size(turns).cast("long").alias("n_turns"),
        F.array_min(turns).alias("least_turn"),
        F.array_max(turns).alias("most_turn"),
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [transfers(codes, (START,)) if opens else transfers(codes) for codes, opens in zip(batch["codes"], batch["opens"])]
            yield batch.assign(transfers=found)

    return stage(shaped.mapInPandas(search, _BLOCK_COLUMNS.format(id=kind)), "turns-blocks")


class _Totals:
    """What the blocks of a conversation add up to."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.distinct, self.least, self.most, self.last = 0, None, None, None
        self.chain = Chain()
        self.at: list[tuple[int, int]] = []

    def add(self, row) -> None:
        for name in self.counts:
            self.counts[name] += getattr(row, name)
        self.counts["illegal"] += self.last is not None and self.last + row.first not in _LEGAL
        self.last = row.last
        if row.n_turns:
            least, most = int(row.least_turn), int(row.most_turn)
            # turns ascend from block to block; the border number may stand in both
            self.distinct += row.n_turns - (self.most == least)
            self.least = least if self.least is None else self.least
            self.most = most
        self.chain.add([(x["entry"], x["leave"], x["cost"], x["rank"]) for x in row.transfers])
        self.at.append((row.slot, row.chunk))

    def rows(self) -> Iterator[tuple]:
        cost, nodes, closing = self.chain.close()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        for k, ((slot, chunk), (entry, leave)) in enumerate(zip(self.at, nodes)):
            ends = closing if k + 1 == len(nodes) else 0
            whole = (gaps, *self.counts.values(), cost) if k == 0 else (None,) * 6
            yield self.conv_id, slot, chunk, entry, leave, ends, *whole


_SETTLED = (
    "conv_id {id}, slot int, chunk long, entry int, leave int, closing int, "
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
)


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _settled(blocks: DataFrame) -> DataFrame:
    """Every block with the nodes by which it is entered and left; the first one has the conversation's counts."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = [x.split()[0] for x in _SETTLED.split(", ")]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if now is None or not _same(now.conv_id, row.conv_id):
                    if now is not None:
                        out += now.rows()
                    now = _Totals(row.conv_id)
                now.add(row)
            yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names[1:]})
            out = []
        if now is not None:
            yield pd.DataFrame(list(now.rows()), columns=names).astype({n: "Int64" for n in names[1:]})

    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "slot", "chunk")
    return dealt.mapInPandas(chain, _SETTLED.format(id=kind))


_AUDITED = "conv_id {id}, slot int, chunk long, audit string, edits array<string>, roles array<string>"


def _audited(blocks: DataFrame, settled: DataFrame) -> DataFrame:
    """Every block with its audit and, edit by edit, the roles it sets."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = [x.split()[0] for x in _AUDITED.split(", ")]
    same = [F.col("b.conv_id").eqNullSafe(F.col("s.conv_id")), F.col("b.slot") == F.col("s.slot"), F.col("b.chunk") == F.col("s.chunk")]
    joined = blocks.alias("b").join(settled.alias("s"), same).select(
        "b.conv_id", "b.slot", "b.chunk", "b.codes", "s.entry", "s.leave", "s.closing"
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv_id, slot, chunk, codes, entry, leave, closing in batch.itertuples(index=False, name=None):
                audit = _least(codes, entry, leave)[1] + "I" * closing
                edits, roles = zip(*repaired_roles(codes, audit, entry))
                out.append((conv_id, slot, chunk, audit, edits, roles))
            yield pd.DataFrame(out, columns=names)

    return joined.mapInPandas(search, _AUDITED.format(id=kind))


class Repair:
    """The repair of a table of conversations (``conv_id, turn, role, text``)."""

    def __init__(self, conversations: DataFrame):
        in_batches(conversations.sparkSession)
        self.turns = _sorted(conversations)
        self.blocks = _blocks(_faulty(self.turns))
        self.settled = stage(_settled(self.blocks), "turns-settled")
        self.audited = stage(_audited(self.blocks, self.settled), "turns-audited")

    def reports(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation with a turn."""
        entry = F.struct("slot", "chunk", "audit")
        audits = self.audited.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("audits"))
        whole = self.settled.where("cost is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        joined = whole.alias("w").join(audits.alias("a"), F.col("w.conv_id").eqNullSafe(F.col("a.conv_id")))
        return joined.select("w.*", F.array_join(F.transform("audits", lambda x: x["audit"]), "").alias("audit"))

    def _edited(self) -> DataFrame:
        """Turns and the edits of their blocks, dealt by conversation and in order, edits ahead of their turns."""
        edits = self.audited.select("conv_id", "slot", "chunk", F.lit(-1).cast("long").alias("place"), "edits", "roles")
        turns = self.turns.select("conv_id", "slot", _chunk(), "place", "role", "text")
        both = edits.unionByName(turns, allowMissingColumns=True)
        return both.repartition("conv_id").sortWithinPartitions("conv_id", "slot", "chunk", "place")

    def repaired(self) -> DataFrame:
        """``conv_id, place, role, text, edit``: the turns of every repaired conversation, numbered from 0."""
        kind = self.turns.schema["conv_id"].dataType.simpleString()
        names = ["conv_id", "place", "role", "text", "edit"]

        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            walk = _Walk()
            for batch in batches:
                out = [(walk.conv_id, *turn) for turn in walk.turns(batch)]
                yield pd.DataFrame(out, columns=names)

        return self._edited().mapInPandas(emit, f"conv_id {kind}, place long, role string, text string, edit string")

    def hashes(self) -> DataFrame:
        """``conv_id, repaired_sha256`` of the repaired ``role:text``, joined by line breaks."""
        kind = self.turns.schema["conv_id"].dataType.simpleString()

        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            walk, digest, at, out = _Walk(), hashlib.sha256(), None, []
            for batch in batches:
                for place, role, text, _ in walk.turns(batch):
                    if at is not walk.number:
                        if at is not None:
                            out.append((known, digest.hexdigest()))
                        at, known, digest = walk.number, walk.conv_id, hashlib.sha256()
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
                out = []
            if at is not None:
                yield pd.DataFrame([(known, digest.hexdigest())], columns=["conv_id", "repaired_sha256"])

        return self._edited().mapInPandas(emit, f"conv_id {kind}, repaired_sha256 string")


class _Walk:
    """Applies edits to turns that pass in order."""

    def __init__(self):
        self.number, self.conv_id, self.place = None, None, 0
        self.edits: Iterator[tuple[str, str | None]] = iter(())

    def _added(self) -> Iterator[tuple[int, str, str, str]]:
        """Turns added up to the next edit that uses up a turn, which stays in ``held``."""
        self.held = None
        for edit, role in self.edits:
            if edit != "I":
                self.held = edit, role
                return
            yield self.place, role, "", edit
            self.place += 1

    def turns(self, batch: pd.DataFrame) -> Iterator[tuple[int, str, str, str]]:
        """``place, role, text, edit`` of the repaired turns."""
        for conv_id, place, edits, roles, role, text in batch[["conv_id", "place", "edits", "roles", "role", "text"]].itertuples(
            index=False, name=None
        ):
            if place < 0:
                if self.number is None or not _same(self.conv_id, conv_id):
                    self.number, self.conv_id, self.place = object(), conv_id, 0
                self.edits = iter(list(zip(edits, roles)))
                yield from self._added()
                continue
            edit, new = self.held
            if edit != "D":
                yield self.place, new or role, text, edit
                self.place += 1
            yield from self._added()


def report(conversations: DataFrame, every: DataFrame) -> DataFrame:
    """The reports of ``conversations`` with their hashes, one row for each distinct ``conv_id`` of ``every``.

    A conversation without any turn, or without a repaired one, has the hash of the empty text.
    """
    repair = Repair(conversations)
    ids = every.select("conv_id").distinct()
    reports, hashes = repair.reports().alias("r"), repair.hashes().alias("h")
    joined = (
        ids.alias("e")
        .join(reports, F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
        .join(hashes, F.col("e.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    )
    counts = [F.coalesce(f"r.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "e.conv_id",
        *counts,
        F.coalesce("r.audit", F.lit("")).alias("audit"),
        F.coalesce("h.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
