"""Instruction sets from fact rows: six question families, paraphrases, splits.

Input rows have ``ef_id`` (unique), ``_ord``, ``entity_name``, ``entity_type``,
``region``, ``source``, ``ef_value``, ``ef_unit``, ``confidence``,
``is_outlier`` and ``multiplier_applied``. Random choices are orders by hash,
so a run can be repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom import constants as C
from factorloom.functions.bands import confidence_band
from factorloom.functions.numbers import double_text
from factorloom.functions.text import hash_key, hash_pick, replace_first
from factorloom.operators.ordering import top_per_group
from factorloom.operators.sampling import mark_share, sample_flagged, sample_rows, split_share
from factorloom.operators.sizing import bounded_broadcast
from factorloom.session import cut_lineage


def fill(template: str, **values: Column | str) -> Column:
    """Template text with named fields as one concatenation."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        value = values.get(name, name)
        pieces += [F.lit(before), F.col(value) if isinstance(value, str) else value]
    return F.concat(*pieces, F.lit(rest))


def _record(
    family: str,
    key: Column,
    question: Column,
    answer: Column,
    regions: Column,
    types: Column,
    sources: Column,
    difficulty: str,
    given: Column | None = None,
) -> list[Column]:
    return [
        F.lit(family).alias("family"),
        F.concat(F.lit(f"{family}:"), key).alias("key"),
        question.alias("instruction"),
        (given if given is not None else F.lit("")).alias("input"),
        answer.alias("output"),
        F.struct(
            regions.alias("regions"),
            types.alias("entity_types"),
            F.lit(difficulty).alias("difficulty"),
            sources.alias("sources"),
        ).alias("metadata"),
    ]


def _own(*names: str) -> list[Column]:
    return [F.array(n) for n in names]


def lookup_records(rows: DataFrame, region_in_metadata: str = "region", family: str = "basic_lookup") -> DataFrame:
    """One basic question per fact row."""
    value = double_text("ef_value")
    return rows.select(
        *_record(
            family,
            F.col("ef_id"),
            fill(C.BASIC_QUESTION),
            fill(C.BASIC_ANSWER, ef_value=value),
            *_own(region_in_metadata, "entity_type", "source"),
            "basic",
        )
    )


def basic_lookup(rows: DataFrame, count: int, seed: int | str = "basic") -> DataFrame:
    return lookup_records(sample_rows(rows, count, ["ef_id"], seed))


def regional_comparison(rows: DataFrame, count: int, seed: int | str = "regional") -> DataFrame:
    """Two regions of the same entity, for the first ``count`` entities seen.

    The limit comes before the test for two regions, so fewer questions may
    result. Each region is represented by its first row.
    """
    named = rows.where("entity_name is not null and region is not null")
    # at most `count` rows
    first = (
        named.groupBy("entity_name").agg(F.min("_ord").alias("_first")).orderBy("_first").limit(count)
    ).select("entity_name")
    facts = F.struct("_ord", "ef_value", "ef_unit", "source", "entity_type")
    per_region = (
        named.join(bounded_broadcast(first, count), "entity_name")
        .groupBy("entity_name", "region")
        .agg(F.min(facts).alias("f"))
    )
    drawn = top_per_group(
        per_region, ["entity_name"], [hash_key(F.col("entity_name"), F.col("region"), seed=seed), "region"], 2
    )
    side = F.struct("region", "f")
    pairs = (
        drawn.groupBy("entity_name")
        .agg(*[F.max(F.when(F.col("rank") == i, side)).alias(f"r{i}") for i in (1, 2)])
        .where("r2 is not null")
    )
    values = {}
    for i in (1, 2):
        values[f"region{i}"] = F.col(f"r{i}.region")
        values[f"value{i}"] = double_text(F.col(f"r{i}.f.ef_value"))
        values[f"unit{i}"] = F.col(f"r{i}.f.ef_unit")
        values[f"source{i}"] = F.col(f"r{i}.f.source")
    higher = F.col("r1.f.ef_value") > F.col("r2.f.ef_value")
    values["relation"] = F.when(higher, F.lit("higher")).otherwise(F.lit("lower"))
    return pairs.select(
        *_record(
            "regional_comparison",
            F.col("entity_name"),
            fill(C.COMPARISON_QUESTION, **values),
            fill(C.COMPARISON_ANSWER, **values),
            F.array(values["region1"], values["region2"]),
            F.array("r1.f.entity_type"),
            F.array(values["source1"], values["source2"]),
            "moderate",
        )
    )


def multi_entity_analysis(rows: DataFrame, count: int) -> DataFrame:
    """Top three of (region, type) groups with at least three rows.

    Groups run in first-seen order of region, then type, over the first
    ``count`` regions, and stop after ``count`` groups.
    """
    keys = ["region", "entity_type"]
    groups = (
        rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.min("_ord").alias("_first"))
    )
    # at most `count` rows each
    regions = groups.groupBy("region").agg(F.min("_first").alias("_region")).orderBy("_region").limit(count)
    chosen = (
        groups.where("_rows >= 3")
        .join(bounded_broadcast(regions, count), "region")
        .orderBy("_region", "_first")
        .limit(count)
        .select(*keys)
    )
    top = top_per_group(
        rows.join(bounded_broadcast(chosen, count), keys), keys, [F.desc_nulls_last("ef_value"), F.col("_ord")], 3
    )
    shown = fill("{entity_name} ({ef_value} {ef_unit})", ef_value=double_text("ef_value"))
    listed = top.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", shown.alias("text"), "source"))).alias("_top")
    )
    sources = F.array_distinct(F.transform("_top", lambda t: t["source"]))
    values = {
        "listing": F.array_join(F.transform("_top", lambda t: t["text"]), ", "),
        "sources": F.array_join(sources, ", "),
    }
    return listed.select(
        *_record(
            "multi_entity_analysis",
            F.concat_ws("|", *keys),
            fill(C.TOP_QUESTION),
            fill(C.TOP_ANSWER, **values),
            *_own(*keys),
            sources,
            "complex",
        )
    )


def methodological(rows: DataFrame, count: int, seed: int | str = "method") -> DataFrame:
    """Facts with a multiplier; any facts when there are none."""
    chosen = sample_flagged(rows, "multiplier_applied", count, ["ef_id"], seed)
    return chosen.select(
        *_record(
            "methodological",
            F.col("ef_id"),
            fill(C.METHOD_QUESTION),
            fill(C.METHOD_ANSWER),
            F.array(F.lit(C.GLOBAL_REGION), F.col("region")),
            *_own("entity_type", "source"),
            "moderate",
        )
    )


def edge_cases(rows: DataFrame, count: int, seed: int | str = "edge") -> DataFrame:
    """Outlier facts; any facts when there are none."""
    lowered = F.lower("entity_name")
    values = {
        "lower_name": lowered,
        "new_entity": F.concat(F.lit(C.EDGE_ENTITY_PREFIX), lowered),
        "ef_value": double_text("ef_value"),
    }
    chosen = sample_flagged(rows, "is_outlier", count, ["ef_id"], seed)
    return chosen.select(
        *_record(
            "edge_cases",
            F.col("ef_id"),
            fill(C.EDGE_QUESTION, **values),
            fill(C.EDGE_ANSWER, **values),
            *_own("region", "entity_type", "source"),
            "complex",
            fill(C.EDGE_INPUT, **values),
        )
    )


def verification(rows: DataFrame, count: int, seed: int | str = "verify", scale: float = 1.0) -> DataFrame:
    """Reliability questions. Bands are read on 0-100: pass ``scale=100`` for 0-1 confidences."""
    values = {
        "band": confidence_band("confidence", scale),
        "confidence": double_text(F.col("confidence")),
        "caution": F.when(F.col("is_outlier"), F.lit(C.VERIFY_CAUTION)).otherwise(F.lit("")),
    }
    return sample_rows(rows, count, ["ef_id"], seed).select(
        *_record(
            "verification",
            F.col("ef_id"),
            fill(C.VERIFY_QUESTION),
            fill(C.VERIFY_ANSWER, **values),
            *_own("region", "entity_type", "source"),
            "moderate",
        )
    )


def paraphrase(text: Column, key: Column, round_number: int) -> Column:
    """Swap each known opening for one of its alternatives, in list order."""
    result = text
    for opening, alternatives in C.PARAPHRASES:
        pick = hash_pick(key, F.lit(round_number), F.lit(opening), n=len(alternatives))
        choice = F.element_at(F.array(*[F.lit(a) for a in alternatives]), pick + 1)
        result = replace_first(result, opening, choice)
    return result


def augment(records: DataFrame, variants: int = 3) -> DataFrame:
    """Records and up to ``variants`` distinct paraphrases of each; no shuffle."""
    # One round is one projection, so its text is computed once.
    columns = records.columns
    widened = records
    for i in range(1, variants + 1):
        widened = widened.withColumn(f"_v{i}", paraphrase(F.col("instruction"), F.col("key"), i))
    made = F.array_distinct(F.array(*[f"_v{i}" for i in range(1, variants + 1)]))
    kept = F.filter(made, lambda v: v != F.col("instruction"))
    every = F.concat(F.array("instruction"), kept)
    return widened.select("*", F.posexplode(every).alias("_i", "_text")).select(
        *[
            F.concat("key", F.lit("#"), F.col("_i").cast("string")).alias("key")
            if c == "key"
            else F.col("_text").alias("instruction")
            if c == "instruction"
            else F.col(c)
            for c in columns
        ]
    )


def quotas(total: int = C.INSTRUCTION_TOTAL) -> dict[str, int]:
    return {family: int(share * total) for family, share in C.FAMILY_SHARES}


def mix(rows: DataFrame, total: int = C.INSTRUCTION_TOTAL, variants: int = 3) -> DataFrame:
    """All six families by quota, with paraphrases, in hash order of ``shuffle``.

    At most ``total`` records leave the fact rows; they are written once, so
    that splits and samples do not draw them again.
    """
    wanted = quotas(total)
    families = [
        basic_lookup(rows, wanted["basic_lookup"]),
        regional_comparison(rows, wanted["regional_comparison"]),
        multi_entity_analysis(rows, wanted["multi_entity_analysis"]),
        methodological(rows, wanted["methodological"]),
        edge_cases(rows, wanted["edge_cases"]),
        verification(rows, wanted["verification"]),
    ]
    together = cut_lineage(reduce(DataFrame.unionByName, families))
    return augment(together, variants).withColumn("shuffle", hash_key(F.col("key"), seed="shuffle"))


def split(records: DataFrame, share: float = C.TRAIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """Training and validation parts; the first has ``int(share * n)`` records."""
    return split_share(records, share, ["key"], "shuffle")


def test_sample(records: DataFrame, share: float = C.TEST_SHARE, disjoint: bool = False) -> DataFrame:
    """``int(share * n)`` records of the full set, which overlap training.

    ``disjoint=True`` draws the same share from the validation part only.
    """
    base = split(records)[1] if disjoint else records
    marked = mark_share(base, share, ["key"], seed="test", out="_in")
    return marked.where("_in").drop("_in")


def category_mix(records: DataFrame) -> DataFrame:
    """Count and percentage per difficulty."""
    counts = records.groupBy(F.col("metadata.difficulty").alias("difficulty")).agg(F.count(F.lit(1)).alias("rows"))
    # one row per difficulty
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.round(F.col("rows") / total * 100, 1))
