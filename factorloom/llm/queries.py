"""The queries of this subpackage and, where SQL can express them, their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import (
    chat,
    exact,
    jaccard,
    licences,
    lines,
    mixing,
    negatives,
    neighbours,
    packing,
    quality,
    secrets,
    toxicity,
    turns,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIP = r"trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), safe AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*/?(s>|INST\]))', '\1\\\2', 'g') AS safe_role,
    regexp_replace(text, '([<\[])(\\*/?(s>|INST\]))', '\1\\\2', 'g') AS safe_text
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe_role) + length(safe_text) + 20)::BIGINT AS formatted_chars
FROM safe GROUP BY conv_id
"""


@query("op1_chat_format", CHAT_SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings."""
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chats(source.unionByName(probe)))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), packing.vocabulary())


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, {_LOWER.format(_STRIP.format("line"))} AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.place, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op4_line_dedup", LINES_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many documents share."""
    return lines.digest(lines.deduplicate_lines(table(spark, sf_dir, "documents")))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of all documents; cutoffs come from the labelled ones."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), labels))


SIMILAR_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [len(w) || ' ' || array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM common c JOIN sizes x ON c.u = x.doc_id JOIN sizes y ON c.v = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (
  SELECT u AS doc_id, v AS other FROM both_ways
  UNION SELECT r.doc_id, b.v FROM reached r JOIN both_ways b ON r.other = b.u
), least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least l ON d.doc_id = l.doc_id
"""


@query("op6_ngram_jaccard", SIMILAR_SQL)
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of shingles and its class of near copies."""
    classes, _ = jaccard.join_similar(table(spark, sf_dir, "documents"))
    return classes


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM n WINDOW w AS (PARTITION BY text)
"""


@query("op7_exact_dedup", EXACT_SQL)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal documents that stays."""
    rows = exact.chunked(table(spark, sf_dir, "documents"))
    return exact.classes(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM sized GROUP BY source
), capped AS (
  SELECT *, 2 * source_size AS most,
    (1.5 * sum(source_size) OVER ())::DOUBLE AS wanted,
    coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS taken,
    sum(weight) OVER from_here::DOUBLE AS free
  FROM sources
  WINDOW before AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    from_here AS (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT (wanted - taken) / free AS level FROM capped
  WHERE (wanted - taken) / free * weight <= most ORDER BY taken, 2.0 * source_size / weight LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN level * weight > most THEN most::DOUBLE ELSE level * weight END AS target,
    ('0x' || substr(md5(coalesce(source, chr(0)) || '|17'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM capped, level
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.shift,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(s.doc_id::VARCHAR || '|17'), s.doc_id) AS rank
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate * rank + shift) - floor(rate * (rank - 1) + shift)))::BIGINT AS taken
FROM ranked
"""


@query("op8_mixing", MIX_SQL)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mixing.digest(mixing.plan_mix(table(spark, sf_dir, "documents")))


@query("op9_licence_scan")
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans of all documents."""
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


def _spans_sql(kind: str, rank: int, pattern: str, least: int, tested_group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
    unnest(list_transform(range(1, len(found) + 1), lambda k:
      (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0))::BIGINT)) AS start,
    unnest(list_transform(found, lambda x: length(x))) AS size,
    unnest(list_transform(tested, lambda x: length(x))) AS tested, {least} AS least
  FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS found,
    regexp_extract_all(text, '{quoted}', {tested_group}) AS tested,
    regexp_split_to_array(text, '{quoted}') AS gaps
    FROM texts WHERE regexp_matches(text, '{quoted}'))"""


SECRETS_SQL = (
    "WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ("
    + " UNION ALL ".join(_spans_sql(r.kind, k, r.pattern, r.least, r.group) for k, r in enumerate(secrets.RULES))
    + """
), spans AS (
  SELECT doc_id, rank, kind, start, kind || ':' || start || ':' || (start + size) AS span FROM found WHERE tested >= least
)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM texts t LEFT JOIN spans s ON t.doc_id = s.doc_id GROUP BY t.doc_id
"""
)


@query("op10_secret_scan", SECRETS_SQL)
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, which come in two loads through one ledger; each distinct text is scanned once."""
    docs = table(spark, sf_dir, "documents")
    later = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return secrets.digest(secrets.scan_loads([docs.where(~later), docs.where(later)], secrets.Ledger(spark)))


NEGATIVES_SQL = r"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), inside AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM inside WHERE rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors, the labels of some rows moved on first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given another role, by a checksum of their place."""
    filled = conversations.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    )
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rest = F.pmod(F.crc32(F.concat_ws(":", *name).cast("binary")), F.lit(20))
    text = F.when(rest == 1, "").when(rest == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = filled.where(rest != 0).select(
        "conv_id",
        "turn",
        F.when(rest == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(rest == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


TURNS_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key
  FROM conversations
), rested AS (
  SELECT *, xor(list_reduce([4294967295::UBIGINT] || list_transform(key, lambda c: ascii(c)::UBIGINT), lambda h, b:
    list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))),
    4294967295::UBIGINT) % 20 AS rest
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN rest = 4 THEN 'user' ELSE role END AS role,
    CASE rest WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN rest = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM rested WHERE rest <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    substr(role, 1, 1) AS initial, {_STRIP.format("text")} AS inside
  FROM damaged
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed
), marked AS (
  SELECT *, CASE WHEN inside = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN inside[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM numbered
), moves(node, added, spot) AS (
  VALUES (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 'user', 3), (1, 'user', 3), (2, 'user', 3), (3, 'assistant', 2)
), edits(spot, edit, initial, role, node, cost) AS (
  VALUES (0, 'D', NULL, NULL, 0, 3), (1, 'D', NULL, NULL, 1, 3), (2, 'D', NULL, NULL, 2, 3), (3, 'D', NULL, NULL, 3, 3),
    (0, 'K', 's', NULL, 1, 0), (0, 'K', 'u', NULL, 3, 0), (1, 'K', 'u', NULL, 3, 0), (2, 'K', 'u', NULL, 3, 0), (3, 'K', 'a', NULL, 2, 0),
    (0, 'R', NULL, 'user', 3, 2), (1, 'R', NULL, 'user', 3, 2), (2, 'R', NULL, 'user', 3, 2), (3, 'R', NULL, 'assistant', 2, 2)
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS node, {{'cost': 0::BIGINT, 'audit': '', 'kept': []::VARCHAR[]}} AS best
  FROM (SELECT DISTINCT conv_id FROM marked)
  UNION ALL
  SELECT w.conv_id, m.i, e.node, min({{
    'cost': w.best.cost + CASE v.added WHEN '' THEN 0 ELSE 2 END + e.cost + (e.edit <> 'D' AND m.fault = 'truncated')::BIGINT,
    'audit': w.best.audit || CASE v.added WHEN '' THEN '' ELSE 'I' END || e.edit,
    'kept': w.best.kept || CASE v.added WHEN '' THEN [] ELSE [v.added || ':'] END
      || CASE e.edit WHEN 'D' THEN [] ELSE [coalesce(e.role, m.role) || ':' || m.text] END}}) AS best
  FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
    JOIN moves v ON v.node = w.node
    JOIN edits e ON e.spot = v.spot AND (e.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate')) AND (e.initial IS NULL OR e.initial = m.initial)
  GROUP BY w.conv_id, m.i, e.node
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), ended AS (
  SELECT w.conv_id, min({{'cost': best.cost + [0, 4, 0, 2][node + 1], 'audit': best.audit || ['', 'II', '', 'I'][node + 1],
    'kept': best.kept || [[], ['user:', 'assistant:'], [], ['assistant:']][node + 1]}}) AS best
  FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n GROUP BY w.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query("op12_turn_repair", TURNS_SQL)
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule, with their faults and the cheapest repair."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turns.report(damaged(conversations), conversations)


@query("op13_nearest")
def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows found for every twentieth vector among all others."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
