"""Exact Jaccard join of word shingle sets by universe partition.

The hash universe is cut into segments; how many depends on the size band of a
set. Two sets of similarity ``t`` or more differ in at most ``H`` shingles, so of
any ``H + 1`` non-empty segments of one, at least one is equal in the other. A set
indexes the contents of its segments, in its own band and, if a larger partner can
stand there, in the next one.

Which segments are needed is settled by cost. Empty segments are never indexed. A
set that has too few non-empty ones goes on to their one-deletion neighbourhoods, where
a partner must differ twice in a segment to be missed, in the end to single shingles; a
pair meets at the first level that is enough for one of the two. A segment content that many
sets have (a passage shared by many, a group of near copies) is left out by
each set that has enough other segments; sets that haven't keep it, and only they
meet there. No candidate is lost by this, whatever the counts.

Sets that meet are tied to the smallest of them. A pair is ruled out where the parity
sketches of its sets differ in more bits than similar sets can differ in shingles (a
shingle changes one bit at most), and verified by the exact sets otherwise. Where the
ends of such a pair end up in different components, the pairs of different components
that meet there and can be similar are verified as well. So every link between documents is inside a
component, and pairs whose ends are joined already are not compared again.

Where sets of different components meet at a frequent content, its segments tell too
little: a passage shared by thousands of otherwise different sets would ask for all
their pairs. There every set is allocated segments of one shingle, the rarest it has, a
quarter of its size. Two similar sets share one of them, and the places of the first
shared one in both sets bound what they can have in common, so sets that share
the passage alone do not meet.

Rows move as packed numbers: an index entry takes nine bytes. Segment contents
that are frequent within one task are dealt out apart from the others, so a group of
near copies with a third of all rows meets nowhere in one task.

Defined cases: a text with fewer than ``n`` words is one shingle of its own kind; null
and empty texts have an empty set, linked with nothing; rows with equal ids are one
document and share its links; rows with a null id are linked with nothing and get a
null component; repeated rows come back each; an empty table gives no row; other
columns are ignored. Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import in_batches, whole
from factorloom.llm.components import components
from factorloom.llm.shingles import mix, shingle_sets
from factorloom.operators.sizing import join_by_weight, sized_broadcast
from factorloom.session import stage

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
SIMILAR = (75, 100)
#: A segment content that more sets than this have is frequent.
FREQUENT = 12
#: Index entries a task gathers before it hands them on.
HELD = 500_000
#: Shingles whose entries a bucket of the index holds at most, on average: a task meets one bucket in memory.
BUCKET_SHINGLES = 4_000_000

#: Sizes of a band reach from one bound to the next.
_BAND_GROWTH = 16 / 9
#: Segments as part of the largest size of a band.
_SEGMENTS = 0.36
_LEVELS = 3
_KEY_BYTES = 5

_SEG = np.uint64(0xD6E8FEB86659FD93)
_TAG = np.uint64(0xA0761D6478BD642F)


def band_bounds(most: int) -> list[int]:
    """Largest sizes of the bands up to the one that holds ``most``."""
    out = [1]
    while out[-1] < most:
        out.append(math.ceil((out[-1] + 1) * _BAND_GROWTH))
    return out


_BOUNDS = np.array(band_bounds(1 << 40), np.int64)


def needed(size: int, largest: int, similar: tuple[int, int] = SIMILAR) -> int:
    """Segments a set must show so that no partner of up to ``largest`` shingles can differ in all of them."""
    num, den = similar
    partner = min(size * den // num, largest)
    return (size + partner) * (den - num) // (den + num) + 1


def tags_of(size: int, similar: tuple[int, int] = SIMILAR) -> list[int]:
    """The set's own band and the next one if a partner can stand there."""
    own = int(np.searchsorted(_BOUNDS, size))
    return [own, own + 1] if size * similar[1] // similar[0] > _BOUNDS[own] else [own]


def segments(tag: int) -> int:
    """Number of segments of a band."""
    return math.ceil(_SEGMENTS * int(_BOUNDS[tag])) + 3


def index_entries(tokens: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Index keys of a set and the keys it can spare, by tag parity and level.

    Level 0 has the contents of the segments, level 1 these and their one-deletion
    neighbours, level 2 the single shingles. A level is entered only where the one
    before shows too few segments. At level 0 a partner that shares no key differs in
    every segment; at level 1 it differs twice in every segment of two or more
    shingles. The lowest three bits of a key tell parity and level.
    """
    spread = mix(tokens)
    high = tokens >> np.uint64(32)
    keys, spare = [], [-(1 << 30)] * (2 * _LEVELS)
    for tag in tags_of(tokens.size):
        need = needed(tokens.size, int(_BOUNDS[tag]))
        segment = (high * np.uint64(segments(tag))) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        whole_segments = np.add.reduceat(spread, starts) + segment[starts] * _SEG
        for level in range(_LEVELS):
            slot = (tag & 1) * _LEVELS + level
            if level == 0:
                content, shown = whole_segments, starts.size
                spare[slot] = shown - need
            elif level == 1:
                sizes = np.diff(np.append(starts, tokens.size))
                several = np.repeat(sizes > 1, sizes)
                lesser = (np.repeat(whole_segments, sizes) - spread)[several]
                content, shown = np.concatenate((whole_segments, lesser)), starts.size + int((sizes > 1).sum())
                spare[slot] = (shown - need) // 2  # a key left out takes two differences from its segment at most
            else:
                content, shown = spread, tokens.size
                spare[slot] = shown - need
            found = mix(content + np.array([tag * _LEVELS + level + 1], np.uint64) * _TAG)
            keys.append((found & ~np.uint64(7)) | np.uint64(slot))
            if shown >= need:
                break
    return np.concatenate(keys), spare


# Keys travel as a bucket (their upper bits) and five bytes that hold the lowest bits and those behind the bucket.


def _split_keys(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    rest = ((keys >> np.uint64(64 - bits - 8 * _KEY_BYTES)) & np.uint64((1 << (8 * _KEY_BYTES)) - 8)) | (keys & np.uint64(7))
    return bucket, rest


def bucket_bits(text_bytes: int, partitions: int) -> int:
    """Bits that number the buckets: two for each shuffle partition, and as many as the measured text asks for.

    A shingle takes two bytes of text at least, those of its first word and a space.
    """
    buckets = max(2 * partitions, -(-text_bytes // (2 * BUCKET_SHINGLES)))
    return max(4, (buckets - 1).bit_length())


def _pack_keys(rest: np.ndarray) -> bytes:
    return np.ascontiguousarray(rest.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()


def _unpack_keys(packed: bytes) -> np.ndarray:
    rows = np.frombuffer(packed, np.uint8).reshape(-1, _KEY_BYTES)
    out = np.zeros((rows.shape[0], 8), np.uint8)
    out[:, :_KEY_BYTES] = rows
    return out.view("<u8").ravel()


def _pack_ids(ids: np.ndarray) -> tuple[int, bytes]:
    """Ids as their least one and the distances to it, four bytes each if that does."""
    base = int(ids.min()) if ids.size else 0
    top = int(ids.max()) - base if ids.size else 0
    return base, (ids - base).astype("<u4").tobytes() if top < 1 << 32 else ids.astype("<i8").tobytes()


def _unpack_ids(base: int, packed: bytes, count: int) -> np.ndarray:
    if len(packed) == 4 * count:
        return np.frombuffer(packed, "<u4").astype(np.int64) + base
    return np.frombuffer(packed, "<i8").astype(np.int64)


_PACKED = "bucket int, part int, base long, keys binary, ids binary, frequent binary"
#: kind 0: a document with set size and digest; 1: documents that share a key; 2: some of those that share a frequent key.
_MET = "kind byte, key long, docs array<long>, size long, d1 long, d2 long, spare array<int>, sketch binary"

_DOCUMENTS = -1


#: Behind a document's id: set size, digest and spare segments.
_FACTS = np.dtype([("size", "<i8"), ("d1", "<i8"), ("d2", "<i8"), ("spare", "<i4", 2 * _LEVELS)])


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of tokens at each bit; the number of bits is a power of two of at least 4/3 of the tokens."""
    bits = max(64, 1 << max(0, tokens.size * 4 // 3).bit_length())
    place = ((tokens * _SEG) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(x: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes from a longer one: places are counted modulo the number of bits."""
    parts = np.frombuffer(x, np.uint8).reshape(-1, size)
    return np.bitwise_xor.reduce(parts, axis=0)


def sketches_allow(x: bytes, y: bytes, a: int, b: int, similar: tuple[int, int] = SIMILAR) -> bool:
    """Whether sets of ``a`` and ``b`` tokens with these sketches can be similar."""
    num, den = similar
    if min(a, b) * den < max(a, b) * num:
        return False
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
    return apart <= (a + b) * (den - num) // (den + num)


class _Held:
    """Documents and index entries that a task gathers."""

    def __init__(self, bits: int, part: int):
        self.bits, self.part = bits, part
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.known: set[tuple] = set()
        self.keys: list[np.ndarray] = []
        self.ids: list[int] = []
        self.count = 0

    def add(self, doc: int, tokens: np.ndarray) -> None:
        digest = xxhash.xxh3_128_digest(tokens.tobytes())
        keys, spare = index_entries(tokens) if tokens.size else (tokens, [0] * (2 * _LEVELS))
        d1, d2 = np.frombuffer(digest, "<i8")
        facts = np.array([(tokens.size, d1, d2, spare)], _FACTS).tobytes()
        self.rows.append((_DOCUMENTS, self.part, doc, facts, sketch(tokens), b""))
        self.count += 1
        if not tokens.size or (tokens.size, digest) in self.known:
            return  # equal sets are joined by their digest
        self.known.add((tokens.size, digest))
        self.keys.append(keys)
        self.ids.append(doc)
        self.count += keys.size

    def packed(self) -> Iterator[tuple]:
        """Rows to deal out by bucket and part."""
        yield from self.rows
        if not self.keys:
            return
        keys = np.concatenate(self.keys)
        ids = np.repeat(np.array(self.ids, np.int64), [k.size for k in self.keys])
        order = np.argsort(keys, kind="stable")
        bucket, rest = _split_keys(keys[order], self.bits)
        ids = ids[order]
        # sorted keys are sorted by bucket; a run of equal (bucket, rest) may be frequent already here
        starts = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1]))))
        sizes = np.diff(np.append(starts, rest.size))
        apart = np.repeat(sizes > FREQUENT, sizes)
        frequent = starts[sizes > FREQUENT]
        for own, part in ((~apart, 0), (apart, 1 + self.part)):
            b, r, i = bucket[own], rest[own], ids[own]
            edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if b.size else np.zeros(0, np.int64)
            for lo, hi in zip(edges, np.append(edges[1:], b.size)):
                base, packed = _pack_ids(i[lo:hi])
                yield int(b[lo]), part, base, _pack_keys(r[lo:hi]), packed, b""
        for k in np.unique(bucket[frequent]):
            yield int(k), 0, 0, b"", b"", _pack_keys(rest[frequent[bucket[frequent] == k]])


def _parted(docs: DataFrame, bits: int, shingle: int) -> DataFrame:
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = _Held(bits, TaskContext.get().partitionId() % (1 << bits))
        names = [x.split()[0] for x in _PACKED.split(", ")]

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(list(held.packed()), columns=names)
            held.clear()
            return out

        for batch in batches:
            for doc, tokens in zip(batch["doc_id"], shingle_sets(list(batch["text"]), shingle)):
                held.add(int(doc), tokens)
            if held.count >= HELD:
                yield flush()
        if held.count:
            yield flush()

    return docs.mapInPandas(index, _PACKED)


def _meet(blobs: pd.DataFrame) -> pd.DataFrame:
    """Documents that share a key, of one bucket and part."""
    bucket, part = int(blobs["bucket"].iloc[0]), int(blobs["part"].iloc[0])
    if bucket == _DOCUMENTS:
        facts = np.frombuffer(b"".join(blobs["keys"]), _FACTS)
        return pd.DataFrame(
            {
                "kind": 0,
                "key": 0,
                "docs": pd.Series([[x] for x in blobs["base"]], dtype=object),
                "size": facts["size"],
                "d1": facts["d1"],
                "d2": facts["d2"],
                "spare": list(facts["spare"]),
                "sketch": blobs["ids"],
            }
        )
    keys = [_unpack_keys(x) for x in blobs["keys"]]
    ids = [_unpack_ids(b, x, k.size) for b, x, k in zip(blobs["base"], blobs["ids"], keys)]
    key, doc = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if key.size else np.zeros(0, bool)
    key, doc = key[new], doc[new]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if key.size else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, key.size))
    marked = np.unique(np.concatenate([_unpack_keys(x) for x in blobs["frequent"]]))
    many = np.isin(key[starts], marked) | (sizes > FREQUENT) | (part > 0)
    take = np.flatnonzero(many | (sizes > 1))
    full = key[starts[take]].astype(np.int64) | (bucket << (8 * _KEY_BYTES))
    return pd.DataFrame(
        {
            "kind": np.where(many[take], 2, 1).astype("int8"),
            "key": full,
            "docs": pd.Series([doc[starts[k] : starts[k] + sizes[k]] for k in take], dtype=object),
            "size": 0,
            "d1": 0,
            "d2": 0,
            "spare": None,
            "sketch": None,
        }
    )


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with a listed id; the list is broadcast only when counted small."""
    return docs.join(sized_broadcast(ids), "doc_id", "left_semi")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Set and size of every row."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(list(batch["text"]), shingle)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "size": [s.size for s in sets], "tokens": [s.astype("<u8").tobytes() for s in sets]}
            )

    return docs.mapInPandas(build, "doc_id long, size long, tokens binary")


def _both_ends(pairs: DataFrame, facts: DataFrame, value: str) -> DataFrame:
    """Pairs (``u, v``) with ``a`` and ``b``, a value of either end."""
    of_u = facts.select(F.col("doc_id").alias("u"), F.col("size").alias("a_size"), F.col(value).alias("a"))
    of_v = facts.select(F.col("doc_id").alias("v"), F.col("size").alias("b_size"), F.col(value).alias("b"))
    return pairs.join(of_u, "u").join(of_v, "v").select("u", "v", "a_size", "b_size", "a", "b")


def _possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (``u, v``) that sizes and sketches do not rule out, written out."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            may = [
                sketches_allow(x, y, a, b)
                for x, y, a, b in zip(batch["a"], batch["b"], batch["a_size"].tolist(), batch["b_size"].tolist())
            ]
            yield batch.loc[may, ["u", "v"]]

    sized = rows.where("size > 0").select("doc_id", "size", "sketch")
    return stage(_both_ends(pairs, sized, "sketch").mapInPandas(test, "u long, v long").distinct(), "jaccard-possible")


def _linked(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The pairs (``u, v``) whose exact sets are similar enough, written out."""
    num, den = SIMILAR

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = []
            for x, y in zip(batch["a"], batch["b"]):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.sort(np.concatenate((p, q)), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                same.append(den * common >= num * (p.size + q.size - common))
            yield batch.loc[same, ["u", "v"]]

    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = stage(_sets(_texts_of(docs, ids), shingle), "jaccard-sets")
    return stage(_both_ends(pairs, sets, "tokens").mapInPandas(verify, "u long, v long").distinct(), "jaccard-links")


def join_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``.

    ``classes``: one row per row of ``docs``: ``doc_id, n_shingles, component_id``.
    ``links``: verified pairs (``u, v``) that hold all components of different sets
    together; documents with equal sets are joined by their digest instead.
    """
    spark = docs.sparkSession
    in_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    named = source.where("doc_id is not null")
    text_bytes = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    bits = bucket_bits(text_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = stage(_parted(named, bits, shingle).groupBy("bucket", "part").applyInPandas(_meet, _MET), "jaccard-met")
    rows = met.where("kind = 0").select(F.get("docs", F.lit(0)).alias("doc_id"), "size", "d1", "d2", "spare", "sketch")
    links, labels = _links(named, met, rows, shingle)
    classes = rows.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id")
    )
    nameless = _sets(source.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text"), shingle)
    lost = nameless.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return classes.unionByName(lost), links


def _equal_sets(rows: DataFrame) -> DataFrame:
    """Edges from every document to the first one with the same set."""
    groups = (
        rows.where("size > 0")
        .groupBy("d1", "d2", "size")
        .agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return rows.join(groups, ["d1", "d2", "size"]).select(F.col("doc_id").alias("u"), "v").where("u <> v")


def _frequent(met: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, doc_id, active, n`` at frequent keys, of the documents that have too few other segments at the key's level.

    Such a document may still leave out as many keys as it has spare segments, the
    most frequent ones; it looks for partners (``active``) at the others alone and
    can be found at all of them. ``n`` is its number of frequent keys at the level: near
    copies that have most of them are the middle of their group. Where a level shows it too few segments at all, it
    can only be found. Keys at which nobody looks are left out.
    """
    often = met.where("kind = 2").select(
        "key", F.explode("docs").alias("doc_id"), F.col("key").bitwiseAND(7).cast("int").alias("slot")
    )
    often = stage(often.distinct(), "jaccard-often")
    spare = rows.groupBy("doc_id").agg(F.min("spare").alias("spare"))
    counts = often.groupBy("doc_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    short = (
        counts.join(spare, "doc_id")
        .select("doc_id", "slot", "n", F.get("spare", F.col("slot")).alias("spare"))
        .where("n > spare")
    )
    known = often.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    # a document's own keys of a level, rarest first
    rarest = Window.partitionBy("doc_id", "slot").orderBy("f", "key")
    placed = often.join(short, ["doc_id", "slot"]).join(known, "key").withColumn("r", F.row_number().over(rarest))
    active = (F.col("spare") >= 0) & (F.col("r") <= F.col("n") - F.col("spare"))
    kept = stage(placed.select("key", "doc_id", active.alias("active"), "n"), "jaccard-frequent")
    return kept.join(kept.where("active").select("key").distinct(), "key", "left_semi")


def _links(docs: DataFrame, met: DataFrame, rows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Verified pairs that hold the components together, and the components' labels."""
    groups = met.where("kind = 1").select("key", F.get("docs", F.lit(0)).alias("first"), "docs")
    behind = F.explode(F.slice("docs", F.lit(2), F.size("docs"))).alias("v")
    kept = _frequent(met, rows)
    middle = F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("first")
    firsts = kept.groupBy("key").agg(middle)
    far = _pairs(kept.join(firsts, "key"), "first", "doc_id")
    tried = stage(groups.select(F.col("first").alias("u"), behind).unionByName(far).distinct(), "jaccard-tried")
    possible = _possible(tried, rows)
    equal = _equal_sets(rows)

    # a document's smallest partner is tried first; most others are then in its component already
    nearest = possible.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = _linked(nearest, docs, shingle)
    labels = stage(components(links.unionByName(equal)), "jaccard-labels")
    others = possible.join(nearest, ["u", "v"], "left_anti")
    links = links.unionByName(_linked(_apart(others, labels), docs, shingle))
    labels = stage(components(links.unionByName(equal)), "jaccard-labels")

    # keys at which a first pair lies in two components: all pairs of different components of these few documents
    apart = sized_broadcast(_apart(tried, labels))
    loose = (
        groups.where(F.size("docs") > 2)
        .select("key", F.col("first").alias("u"), "docs", behind)
        .join(apart, ["u", "v"], "left_semi")
        .select("key", F.explode("docs").alias("doc_id"))
        .distinct()
    )
    members = stage(_label(loose, labels, "doc_id", "label"), "jaccard-members")
    left = members.select("key", F.col("doc_id").alias("u"), F.col("label").alias("u_label"))
    right = members.select("key", F.col("doc_id").alias("v"), F.col("label").alias("v_label"))
    few = left.join(right, "key").where("u_label <> v_label and u < v").select("u", "v").distinct()

    # documents of different components at a frequent key: single shingles instead of segments, each set its rarest
    placed = _label(kept, labels, "doc_id", "label")
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    at_mixed = placed.join(mixed, "key", "left_semi").select("doc_id").distinct()
    one_of_equal = rows.join(at_mixed, "doc_id", "left_semi").groupBy("d1", "d2", "size").agg(F.min("doc_id").alias("doc_id"))
    rare = stage(_rare_shingles(docs, one_of_equal.select("doc_id").distinct(), shingle), "jaccard-rare")
    near = _to_first(rare, labels).unionByName(few).distinct().join(tried, ["u", "v"], "left_anti")
    near = stage(near, "jaccard-near")
    links = links.unionByName(_linked(_possible(near, rows), docs, shingle))
    labels = stage(components(links.unionByName(equal)), "jaccard-labels")
    more = _across(rare, labels).join(tried.unionByName(near), ["u", "v"], "left_anti")
    links = links.unionByName(_linked(_possible(more, rows), docs, shingle))
    return links, components(links.unionByName(equal))


def _shingle_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """A row for every shingle of every set; ``d1`` tells the sets of equal ids apart."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(list(batch["text"]), shingle)
            sizes = [s.size for s in sets]
            digests = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")[0] for s in sets]
            yield pd.DataFrame(
                {
                    "doc_id": np.repeat(batch["doc_id"].to_numpy(np.int64), sizes),
                    "d1": np.repeat(np.array(digests, np.int64), sizes),
                    "size": np.repeat(np.array(sizes, np.int64), sizes),
                    "token": np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64),
                }
            )

    return docs.mapInPandas(spread, "doc_id long, d1 long, size long, token long")


def _rare_shingles(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``token, doc_id, size, at``: the rarest shingles of the listed documents, with their places in the order of rarity.

    The order is the same for all sets: by the number of listed sets that have the shingle, then by
    the shingle. Two similar sets share one of these, as the ones behind them are too few
    to be similar by; shingles of one set alone take places but are not returned.
    """
    num, den = SIMILAR
    texts = _texts_of(docs, ids)
    counts = _shingle_rows(texts, shingle).groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = join_by_weight(_shingle_rows(texts, shingle), stage(counts, "jaccard-counts"), "token", "f")
    own = Window.partitionBy("doc_id", "d1")
    # ranks without gaps: repeated rows of a document give each shingle again
    ranked = shared.withColumn("r", F.dense_rank().over(own.orderBy("f", "token")))
    placed = ranked.withColumn("at", F.col("size") - F.max("r").over(own) + F.col("r") - 1)
    return placed.where(den * (F.col("size") - F.col("at")) >= num * F.col("size")).select("token", "doc_id", "size", "at").distinct()


def _fits(size: str, at: str, other_size: str, other_at: str) -> Column:
    """Whether sets can be similar whose first common shingle in the order of rarity has these places."""
    num, den = SIMILAR
    behind = F.least(F.col(size) - F.col(at), F.col(other_size) - F.col(other_at))
    sizes = F.least(size, other_size) * den >= F.greatest(size, other_size) * num
    return sizes & (behind * (den + num) >= (F.col(size) + F.col(other_size)) * num)


def _to_first(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """At every rare shingle, pairs of the set that has it first and those of other components: one pair a row at most."""
    placed = _label(rare, labels, "doc_id", "label")
    earliest = F.min(F.struct((F.col("at") / F.col("size")).alias("part"), "doc_id", "size", "at", "label"))
    firsts = placed.groupBy("token").agg(earliest.alias("x")).select(
        "token", F.col("x.doc_id").alias("first"), F.col("x.size").alias("b"), F.col("x.at").alias("b_at"), F.col("x.label").alias("other")
    )
    near = placed.join(firsts, "token").where(F.col("label") != F.col("other")).where(_fits("size", "at", "b", "b_at"))
    return _pairs(near, "first", "doc_id").distinct()


def _across(rare: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs of different components that share a rare shingle and fit by its places.

    At a shingle, the sets outside its largest component are held against all sets, so a
    component is never held against itself.
    """
    placed = stage(_label(rare, labels, "doc_id", "label"), "jaccard-placed")
    per_label = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max_by("label", F.struct("n", -F.col("label"))).alias("largest")
    mixed = per_label.groupBy("token").agg(largest, F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    there = placed.join(mixed, "token")
    left = there.where(F.col("label") != F.col("largest")).select(
        "token", F.col("doc_id").alias("u"), F.col("label").alias("u_label"), F.col("size").alias("a"), F.col("at").alias("a_at")
    )
    right = there.select(
        "token", "largest", F.col("doc_id").alias("v"), F.col("label").alias("v_label"), F.col("size").alias("b"), F.col("at").alias("b_at")
    )
    once = (F.col("u") < F.col("v")) | (F.col("v_label") == F.col("largest"))
    apart = left.join(right, "token").where(F.col("u_label") != F.col("v_label")).where(once)
    return _pairs(apart.where(_fits("a", "a_at", "b", "b_at")), "u", "v").distinct()


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """``u, v``: two different ids of a row, the smaller one first."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def _label(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the label of a node; one without an edge is its own label."""
    named = labels.select(F.col("node").alias(node), F.col("label").alias("_label"))
    return df.join(named, node, "left").withColumn(name, F.coalesce("_label", node)).drop("_label")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends have different labels."""
    both = _label(_label(pairs, labels, "u", "u_label"), labels, "v", "v_label")
    return both.where("u_label <> v_label").select("u", "v")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id, with all their columns.

    Rows that share the smallest id all stay, and so do rows with a null id.
    """
    classes, _ = join_similar(docs, id_col, text_col)
    dropped = classes.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    whole_row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))
    gone = F.col(f"_whole.{id_col}").cast("long") == F.col("_gone")
    return whole_row.join(sized_broadcast(dropped), gone, "left_anti").select("_whole.*")
