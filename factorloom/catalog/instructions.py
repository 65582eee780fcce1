"""Instruction-set and answer-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom import constants as C
from factorloom.catalog import inputs as I
from factorloom.catalog.base import query, table, view
from factorloom.functions import responses
from factorloom.operators.ordering import top_per_group
from factorloom.operators.sampling import mark_share
from factorloom.plans import instruct as plan
from factorloom.plans import scoring
from factorloom.plans.patterns import star_rows
from factorloom.session import stage

_COUNT = plan.quotas()
_NUMBER = "cast({} as varchar)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill_sql(template: str, **values: str) -> str:
    pieces, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [_quoted(before), values.get(name, name)]
    return " || ".join([*pieces, _quoted(rest)])


def _record_sql(family, key, question, answer, regions, types, sources, difficulty, given="''"):
    return f"""SELECT '{family}' AS family, '{family}:' || {key} AS key, {question} AS instruction, {given} AS input,
  {answer} AS output, {regions} AS regions, {types} AS entity_types, '{difficulty}' AS difficulty, {sources} AS sources"""


_VALUE = {"ef_value": _NUMBER.format("ef_value")}
_LOOKUP = (
    "ef_id",
    _fill_sql(C.BASIC_QUESTION),
    _fill_sql(C.BASIC_ANSWER, **_VALUE),
)

view(
    "fam_basic",
    _record_sql("basic_lookup", *_LOOKUP, "region", "entity_type", "source", "basic")
    + f" FROM star ORDER BY md5(ef_id || '|basic'), ef_id LIMIT {_COUNT['basic_lookup']}",
)
_PAIR = {}
for _i in (1, 2):
    _PAIR |= {
        f"region{_i}": f"r{_i}.region",
        f"value{_i}": _NUMBER.format(f"r{_i}.ef_value"),
        f"unit{_i}": f"r{_i}.ef_unit",
        f"source{_i}": f"r{_i}.source",
    }
_PAIR |= {
    "entity_name": "r1.entity_name",
    "relation": "CASE WHEN r1.ef_value > r2.ef_value THEN 'higher' ELSE 'lower' END",
}
view(
    "drawn_regions",
    f"""SELECT *, row_number() OVER (PARTITION BY entity_name ORDER BY md5(entity_name || '|' || region || '|regional'), region) AS place
FROM (SELECT * FROM star WHERE entity_name IN (
    SELECT entity_name FROM (SELECT entity_name, min(_ord) AS f FROM star GROUP BY 1 ORDER BY 2 LIMIT {_COUNT['regional_comparison']}))
  QUALIFY row_number() OVER (PARTITION BY entity_name, region ORDER BY _ord) = 1)""",
)
view(
    "fam_regional",
    _record_sql(
        "regional_comparison",
        "r1.entity_name",
        _fill_sql(C.COMPARISON_QUESTION, **_PAIR),
        _fill_sql(C.COMPARISON_ANSWER, **_PAIR),
        "r1.region || '|' || r2.region",
        "r1.entity_type",
        "r1.source || '|' || r2.source",
        "moderate",
    )
    + " FROM (SELECT * FROM drawn_regions WHERE place = 1) r1 JOIN (SELECT * FROM drawn_regions WHERE place = 2) r2 ON r1.entity_name = r2.entity_name",
)
view(
    "top_groups",
    f"""SELECT g.region, g.entity_type FROM (SELECT region, entity_type, count(*) AS n, min(_ord) AS f FROM star GROUP BY 1, 2) g
JOIN (SELECT region, min(_ord) AS rf FROM star GROUP BY 1 ORDER BY 2 LIMIT {_COUNT['multi_entity_analysis']}) r ON r.region = g.region
WHERE g.n >= 3 ORDER BY rf, f LIMIT {_COUNT['multi_entity_analysis']}""",
)
view(
    "top_rows",
    """SELECT region, entity_type, rn, source, entity_name || ' (' || cast(ef_value as varchar) || ' ' || ef_unit || ')' AS shown FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.region, s.entity_type ORDER BY ef_value DESC NULLS LAST, _ord) AS rn
  FROM star s JOIN top_groups g ON g.region = s.region AND g.entity_type = s.entity_type) WHERE rn <= 3""",
)
view(
    "top_lists",
    """SELECT t.region, t.entity_type, string_agg(shown, ', ' ORDER BY rn) AS listing,
  string_agg(CASE WHEN first_rn = rn THEN t.source END, ', ' ORDER BY rn) AS sources,
  string_agg(CASE WHEN first_rn = rn THEN t.source END, '|' ORDER BY rn) AS source_tags
FROM top_rows t JOIN (SELECT region, entity_type, source, min(rn) AS first_rn FROM top_rows GROUP BY 1, 2, 3) d
  ON d.region = t.region AND d.entity_type = t.entity_type AND d.source = t.source GROUP BY 1, 2""",
)
view(
    "fam_multi",
    _record_sql(
        "multi_entity_analysis",
        "region || '|' || entity_type",
        _fill_sql(C.TOP_QUESTION),
        _fill_sql(C.TOP_ANSWER),
        "region",
        "entity_type",
        "source_tags",
        "complex",
    )
    + " FROM top_lists",
)


def _flagged_sql(flag: str, seed: str, count: int) -> str:
    return f""" FROM (SELECT * FROM star WHERE {flag} OR NOT EXISTS (SELECT 1 FROM star WHERE {flag}))
ORDER BY md5(ef_id || '|{seed}'), ef_id LIMIT {count}"""


view(
    "fam_method",
    _record_sql(
        "methodological",
        "ef_id",
        _fill_sql(C.METHOD_QUESTION),
        _fill_sql(C.METHOD_ANSWER),
        "'Global|' || region",
        "entity_type",
        "source",
        "moderate",
    )
    + _flagged_sql("multiplier_applied", "method", _COUNT["methodological"]),
)
_EDGE = {
    "lower_name": "lower(entity_name)",
    "new_entity": f"'{C.EDGE_ENTITY_PREFIX}' || lower(entity_name)",
    **_VALUE,
}
view(
    "fam_edge",
    _record_sql(
        "edge_cases",
        "ef_id",
        _fill_sql(C.EDGE_QUESTION, **_EDGE),
        _fill_sql(C.EDGE_ANSWER, **_EDGE),
        "region",
        "entity_type",
        "source",
        "complex",
        _fill_sql(C.EDGE_INPUT, **_EDGE),
    )
    + _flagged_sql("is_outlier", "edge", _COUNT["edge_cases"]),
)
_BAND = """CASE WHEN confidence * 100 >= 0 AND confidence * 100 < 30 THEN 'low' WHEN confidence * 100 >= 30 AND confidence * 100 < 70 THEN 'medium'
  WHEN confidence * 100 >= 70 AND confidence * 100 < 100 THEN 'high' ELSE 'low' END"""
_VERIFY = {
    "confidence": _NUMBER.format("confidence"),
    "caution": f"CASE WHEN is_outlier THEN {_quoted(C.VERIFY_CAUTION)} ELSE '' END",
}


def _verify_sql(band: str) -> str:
    return (
        _record_sql(
            "verification",
            "ef_id",
            _fill_sql(C.VERIFY_QUESTION),
            _fill_sql(C.VERIFY_ANSWER, band=band, **_VERIFY),
            "region",
            "entity_type",
            "source",
            "moderate",
        )
        + f" FROM star ORDER BY md5(ef_id || '|verify'), ef_id LIMIT {_COUNT['verification']}"
    )


# confidences run from 0 to 1, so every band of the unscaled form reads low
view("fam_verify", _verify_sql("'low'"))
view("fam_verify_scaled", _verify_sql(_BAND))

_FAMILIES = ["fam_basic", "fam_regional", "fam_multi", "fam_method", "fam_edge", "fam_verify"]
view("base_records", "\nUNION ALL\n".join(f"SELECT * FROM {name}" for name in _FAMILIES))


def _paraphrase_sql() -> None:
    """One view per opening, each with the three rounds as columns."""
    source = "base_records"
    columns = {i: "instruction" for i in (1, 2, 3)}
    for place, (opening, alternatives) in enumerate(C.PARAPHRASES):
        listed = ", ".join(_quoted(a) for a in alternatives)
        made = []
        for i, text in columns.items():
            digest = f"md5(key || '|{i}|{opening}')"
            choice = f"list_extract([{listed}], cast(cast('0x' || substr({digest}, 1, 7) as bigint) % {len(alternatives)} as int) + 1)"
            at = f"instr({text}, {_quoted(opening)})"
            made.append(
                f"CASE WHEN {at} > 0 THEN substr({text}, 1, {at} - 1) || {choice} || substr({text}, {at} + {len(opening)}) ELSE {text} END AS v{i}"
            )
        kept = "*" if place == 0 else "* EXCLUDE (v1, v2, v3)"
        view(f"paraphrased_{place}", f"SELECT {kept}, {', '.join(made)} FROM {source}")
        source, columns = f"paraphrased_{place}", {i: f"v{i}" for i in (1, 2, 3)}


_paraphrase_sql()
view(
    "augmented",
    """SELECT * EXCLUDE (v1, v2, v3, texts, key, instruction, i), key || '#' || cast(i - 1 as varchar) AS key, texts[i] AS instruction FROM (
  SELECT *, generate_subscripts(texts, 1) AS i FROM (
    SELECT *, list_filter([instruction, CASE WHEN v1 <> instruction THEN v1 END, CASE WHEN v2 NOT IN (instruction, v1) THEN v2 END,
      CASE WHEN v3 NOT IN (instruction, v1, v2) THEN v3 END], lambda x: x IS NOT NULL) AS texts FROM paraphrased_3))""",
)


def _staged(spark, sf):
    """Fact rows written once: the six families read them several times."""
    return stage(I.star(spark, sf), "star")


def _flat(df, *more):
    metadata = {name: F.array_join(f"metadata.{name}", "|") for name in ("regions", "entity_types", "sources")}
    return df.select(
        "family",
        "key",
        "instruction",
        "input",
        "output",
        *[c.alias(name) for name, c in metadata.items()],
        F.col("metadata.difficulty").alias("difficulty"),
        *more,
    )


_FLAT_SQL = "SELECT family, key, instruction, input, output, regions, entity_types, sources, difficulty"


@query("instr_basic_lookup", f"{_FLAT_SQL} FROM fam_basic")
def instr_basic_lookup(spark, sf):
    return _flat(plan.basic_lookup(I.star(spark, sf), _COUNT["basic_lookup"]))


@query("instr_regional_comparison", f"{_FLAT_SQL} FROM fam_regional")
def instr_regional_comparison(spark, sf):
    return _flat(plan.regional_comparison(I.star(spark, sf), _COUNT["regional_comparison"]))


@query("instr_multi_entity", f"{_FLAT_SQL} FROM fam_multi")
def instr_multi_entity(spark, sf):
    return _flat(plan.multi_entity_analysis(I.star(spark, sf), _COUNT["multi_entity_analysis"]))


@query("instr_methodological", f"{_FLAT_SQL} FROM fam_method")
def instr_methodological(spark, sf):
    return _flat(plan.methodological(I.star(spark, sf), _COUNT["methodological"]))


@query("instr_edge_cases", f"{_FLAT_SQL} FROM fam_edge")
def instr_edge_cases(spark, sf):
    return _flat(plan.edge_cases(I.star(spark, sf), _COUNT["edge_cases"]))


@query("instr_verification", f"{_FLAT_SQL} FROM fam_verify_scaled")
def instr_verification(spark, sf):
    return _flat(plan.verification(I.star(spark, sf), _COUNT["verification"], scale=100))


@query("instr_augment", f"{_FLAT_SQL} FROM augmented WHERE family IN ('basic_lookup', 'methodological')")
def instr_augment(spark, sf):
    rows = I.star(spark, sf)
    records = plan.basic_lookup(rows, _COUNT["basic_lookup"]).unionByName(
        plan.methodological(rows, _COUNT["methodological"])
    )
    return _flat(plan.augment(records))


@query("instr_mix", f"{_FLAT_SQL}, md5(key || '|shuffle') AS shuffle FROM augmented")
def instr_mix(spark, sf):
    return _flat(plan.mix(_staged(spark, sf)), "shuffle")


@query(
    "instr_split",
    """SELECT key, row_number() OVER (ORDER BY md5(key || '|shuffle'), key) <= floor(0.8::double * count(*) OVER ()) AS in_training FROM augmented""",
)
def instr_split(spark, sf):
    records = plan.mix(_staged(spark, sf)).select("key")
    return mark_share(records, C.TRAIN_SHARE, ["key"], seed="shuffle", out="in_training")


view(
    "test_records",
    """SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(key || '|test'), key) AS rn, count(*) OVER () AS n FROM augmented)
WHERE rn <= floor(0.1::double * n)""",
)


@query("instr_test_sample", f"{_FLAT_SQL} FROM test_records")
def instr_test_sample(spark, sf):
    return _flat(plan.test_sample(plan.mix(_staged(spark, sf))))


@query(
    "instr_test_sample_mix",
    """SELECT difficulty, count(*) AS rows, round(count(*) / sum(count(*)) OVER () * 100, 1) AS percent FROM test_records GROUP BY 1""",
)
def instr_test_sample_mix(spark, sf):
    return plan.category_mix(plan.test_sample(plan.mix(_staged(spark, sf))))


@query(
    "graph_instr",
    _record_sql("graph_lookup", *_LOOKUP, "region_code", "entity_type", "source", "basic")
    + " FROM star ORDER BY md5(ef_id || '|star'), ef_id LIMIT 10000",
)
def graph_instr(spark, sf):
    rows = star_rows(I.graph(spark, sf), limit=10_000)
    return _flat(plan.lookup_records(rows, "region_code", "graph_lookup"))


# --- prompts and scoring -----------------------------------------------------------

_ANSWER_OPENINGS = [
    "It is 12.5 kg CO2e/kg. ",
    "About 3 tons CO2e, according to Trace: ",
    "",
    "See 40.25 g CO2e based on Flow_v2.1 ",
    "Between 7 and 9 kg CO2e/kWh; source: trace. ",
]
_TRUTH_OPENINGS = ["The value is 10 kg CO2e from Trace. ", "", "It is 0 kg CO2e from flow_v2.1. "]


def _exchanges(spark, sf):
    """User turns with the assistant turn that follows, as scored examples."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered")
    )
    key = F.col("conv_id") * 1000 + F.col("turn")
    return asked.join(answered, ["conv_id", "turn"]).select(
        key.alias("id"),
        F.col("asked").alias("instruction"),
        F.when(key % 3 == 0, F.lit("Given data.")).otherwise(F.lit("")).alias("input"),
        F.concat(I.pick(_TRUTH_OPENINGS, key % 3), "asked").alias("output"),
        F.concat(I.pick(_ANSWER_OPENINGS, key % 5), "answered").alias("model_output"),
        F.array(F.lit("Trace"), F.lit("Flow_v2.1")).alias("sources"),
    )


view(
    "exchanges",
    f"""SELECT id, asked AS instruction, CASE WHEN id % 3 = 0 THEN 'Given data.' ELSE '' END AS input,
  {I.pick_sql(_TRUTH_OPENINGS, "id % 3")} || asked AS output, {I.pick_sql(_ANSWER_OPENINGS, "id % 5")} || answered AS model_output
FROM (SELECT u.conv_id * 1000 + u.turn AS id, u.text AS asked, a.text AS answered FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')""",
)


def _value_sql(x: str) -> str:
    found = [rf"nullif(regexp_extract({x}, '{p}', 1), '')" for p in [*C.NUMBER_PATTERNS, C.ANY_NUMBER_PATTERN]]
    return f"cast(coalesce({', '.join(found)}) as double)"


def _source_sql(x: str) -> str:
    name = r"([\p{L}\p{N}_]+(?:[-_.][\p{L}\p{N}_]+)*)"
    found = [rf"nullif(regexp_extract({x}, '(?i){lead}{name}', 1), '')" for lead in C.SOURCE_LEADS]
    return f"coalesce({', '.join(found)})"


def _scored(spark, sf, mode="reference"):
    rows = _exchanges(spark, sf)
    return scoring.score_rows(rows.select("id", "model_output"), rows.drop("model_output"), mode)


view(
    "scored",
    f"""SELECT *, abs((answer_value - expected_value) / nullif(expected_value, 0)) * 100 AS value_error,
  lower(answer_source) = lower(expected_source) AS source_match,
  CASE WHEN answer_source IS NOT NULL AND expected_source IS NOT NULL THEN answer_source NOT IN ('trace', 'flow_v2.1') END AS hallucinated,
  CASE WHEN answer_source IS NOT NULL AND expected_source IS NOT NULL THEN lower(answer_source) NOT IN ('trace', 'flow_v2.1') END AS hallucinated_exact
FROM (SELECT id, instruction, input, output, model_output, {_value_sql("model_output")} AS answer_value, {_value_sql("output")} AS expected_value,
  {_source_sql("model_output")} AS answer_source, {_source_sql("output")} AS expected_source FROM exchanges)""",
)


@query("eval_extract_value", f"SELECT id, {_value_sql('model_output')} AS number FROM exchanges")
def eval_extract_value(spark, sf):
    return _exchanges(spark, sf).select("id", responses.extract_value("model_output").alias("number"))


@query("eval_extract_source", f"SELECT id, {_source_sql('model_output')} AS source FROM exchanges")
def eval_extract_source(spark, sf):
    return _exchanges(spark, sf).select("id", responses.extract_source("model_output").alias("source"))


@query(
    "eval_rows",
    """SELECT id, md5(instruction) AS instruction, input, answer_value, expected_value, answer_source, expected_source,
  round(value_error, 6) AS value_error, source_match, hallucinated FROM scored""",
)
def eval_rows(spark, sf):
    return _scored(spark, sf).select(
        "id",
        F.md5("instruction").alias("instruction"),
        "input",
        "answer_value",
        "expected_value",
        "answer_source",
        "expected_source",
        F.round("value_error", 6).alias("value_error"),
        "source_match",
        "hallucinated",
    )


_METRICS = """SELECT round(avg(value_error), 6) AS mape, round(avg(source_match::int) * 100, 6) AS source_attribution_accuracy,
  round(avg({}::int) * 100, 6) AS hallucination_rate FROM scored"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("eval_metrics", _METRICS.format("hallucinated"))
def eval_metrics(spark, sf):
    return _rounded(scoring.metrics(_scored(spark, sf)))


@query("eval_metrics_exact", _METRICS.format("hallucinated_exact"))
def eval_metrics_exact(spark, sf):
    return _rounded(scoring.metrics(_scored(spark, sf, "exact")))


@query(
    "eval_precision_at_3",
    """SELECT count(*) AS queries, round(avg(hit::int) * 100, 6) AS precision FROM (
  SELECT t.l_partkey, coalesce(max((r.item = t.item)::int), 0) AS hit
  FROM (SELECT l_partkey, min(l_suppkey) AS item FROM lineitem GROUP BY 1) t
  LEFT JOIN (SELECT l_partkey, l_suppkey AS item, row_number() OVER (PARTITION BY l_partkey
      ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS place FROM lineitem) r ON r.l_partkey = t.l_partkey AND r.place <= 3
  GROUP BY 1)""",
)
def eval_precision_at_3(spark, sf):
    """Parts as queries, their dearest lines as ranked answers, their first supplier as truth."""
    lines = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber"
    )
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey"]
    ranked = top_per_group(lines, ["l_partkey"], order, 3).select(
        F.col("l_partkey").alias("query"), "rank", F.col("l_suppkey").alias("item")
    )
    truth = lines.groupBy(F.col("l_partkey").alias("query")).agg(F.min("l_suppkey").alias("item"))
    return _rounded_precision(scoring.precision_at(ranked, truth, 3))


def _rounded_precision(df):
    return df.withColumn("precision", F.round("precision", 6))


@query(
    "prompt_format",
    """SELECT id, md5('<s>[INST] ' || instruction || CASE WHEN input <> '' THEN chr(10) || chr(10) || input ELSE '' END || ' [/INST] ' || output || ' </s>') AS chat,
  md5('<s>[INST] ' || instruction || ' ' || CASE WHEN input <> '' THEN chr(10) || input ELSE '' END || ' [/INST]') AS question,
  md5('### ' || instruction || CASE WHEN input <> '' THEN chr(10) || input ELSE '' END || ' => ' || output) AS custom FROM exchanges""",
)
def prompt_format(spark, sf):
    parts = ("instruction", "input", "output")
    return _exchanges(spark, sf).select(
        "id",
        F.md5(responses.chat_prompt(*parts)).alias("chat"),
        F.md5(responses.template_prompt("instruction", "input")).alias("question"),
        F.md5(responses.template_prompt(*parts, template="### {instruction}{input} => {output}")).alias("custom"),
    )


@query(
    "eval_report",
    """SELECT 0 AS place, '| mape | ' || printf('%.2f', avg(value_error)) || ' |' AS line FROM scored
UNION ALL SELECT 1, '| source_attribution_accuracy | ' || printf('%.2f', avg(source_match::int) * 100) || ' |' FROM scored
UNION ALL SELECT 2, '| hallucination_rate | ' || printf('%.2f', avg(hallucinated::int) * 100) || ' |' FROM scored
UNION ALL SELECT id * 10 + p + 100, CASE p WHEN 0 THEN '**Instruction**: ' || instruction WHEN 1 THEN '**Input**: ' || input
    WHEN 2 THEN '**Expected Output**: ' || output ELSE '**Model Output**: ' || model_output END
  FROM (SELECT * FROM scored ORDER BY id LIMIT 5), (VALUES (0), (1), (2), (3)) v(p) WHERE p <> 1 OR input <> ''""",
)
def eval_report(spark, sf):
    from factorloom.sources.sinks import report_lines

    scored = _scored(spark, sf)
    return report_lines(scoring.metrics(scored), scored)
