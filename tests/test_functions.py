"""Column functions on hand-computed rows, one case per known trap."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factorloom.functions import bands, numbers, regions, responses, tags, text, units


def column(spark, values, kind, make):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("2d", None),
        ("1f", None),
        (" 2 ", 2.0),
        ("1,000", None),
        ("inf", math.inf),
        ("nan", None),
        ("", None),
        (None, None),
        ("-3e2", -300.0),
        (".5", 0.5),
        (" 7\t", 7.0),
    ],
)
def test_coerce_numeric(spark, given, expected):
    assert column(spark, [given], "string", numbers.coerce_numeric) == [expected]


def test_null_nan(spark):
    assert column(spark, [1.5, float("nan"), None], "double", numbers.null_nan) == [1.5, None, None]


@pytest.mark.parametrize(
    "value", [1e9, 123456789.125, 0.0005, 1e-5, 1e16, 12345.67, 0.0, -2.5e7, 1.0, 1e22, 3.25e-7, 9999999.0, 1e-4]
)
def test_double_text_is_the_shortest_decimal(spark, value):
    assert column(spark, [value], "double", numbers.double_text) == [repr(value)]


def test_strip_removes_every_white_space(spark):
    assert column(spark, ["\t a b \n", None], "string", text.strip) == ["a b", None]


def test_simplify_keeps_inner_runs(spark):
    got = column(spark, ["Beef, raw", "Beef raw", "  (X)", None], "string", text.simplify_name)
    assert got == ["beef  raw", "beef raw", "x", None]


@pytest.mark.parametrize(
    ("keep", "expected"), [("plain", "Blé d été 50 a_b x y"), ("hyphen", "Blé d été 50 a_b x-y"), ("hyphen_parens", "Blé d été (50 ) a_b x-y")]
)
def test_clean_name_variants(spark, keep, expected):
    got = column(spark, [" Blé  d'été (50%) a_b, x-y "], "string", lambda c: text.clean_name(c, keep))
    assert got == [expected]


def test_title_case_after_any_non_letter(spark):
    values = ["x-ray o'neil", "2d print", "road_freight", "ÉCOLE de"]
    assert column(spark, values, "string", text.title_case) == [v.title() for v in values]


def test_replace_first_only(spark):
    make = lambda c: text.replace_first(c, "What is", F.lit("Tell me"))
    assert column(spark, ["So\nWhat is What is?", "none", None], "string", make) == ["So\nTell me What is?", "none", None]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("USEEIO_v2.1", "1.0"), ("Agri_3.1", "3.1"), ("plain", "1.0"), ("a_b_2020", "2020"), ("tail_", "1.0")],
)
def test_source_version(spark, given, expected):
    assert column(spark, [given], "string", text.source_version) == [expected]


UNIT_CASES = [
    ("kg CO2e", 0.001, "kg CO2e", 1.0, "kg CO2e"),
    ("g CO2e/MJ", 0.001, "kg CO2e", 0.001, "kg CO2e/MJ"),
    ("t CO2e", 1000.0, "kg CO2e", 1000.0, "kg CO2e"),
    ("Mt CO2e", 1000.0, "kg CO2e", 1e9, "kg CO2e"),
    ("Gt CO2e", 1000.0, "kg CO2e", 1e12, "kg CO2e"),
    ("12.5", 0.001, "kg CO2e", 1.0, "kg CO2e"),
    ("KG CO2E/t", 0.001, "kg CO2e", 1.0, "kg CO2e/t"),
    ("ratio", 1.0, "ratio", 1.0, "ratio"),
    ("kg/TJ", 1.0, "kg/TJ", 1.0, "kg/TJ"),
    (None, 1.0, None, 1.0, None),
]


@pytest.mark.parametrize(("unit", "factor", "name", "exact_factor", "exact_name"), UNIT_CASES)
def test_units_in_both_modes(spark, unit, factor, name, exact_factor, exact_name):
    df = spark.createDataFrame([(1.0, unit)], "v double, u string")
    for mode, f, n in (("reference", factor, name), ("exact", exact_factor, exact_name)):
        measure = units.standardize_unit("v", "u", mode)
        assert tuple(df.select(measure.value, measure.unit).head()) == (f, n)


def test_numeric_unit_pattern_is_anchored(spark):
    assert column(spark, ["1.5", "1.5\n", "1.5 kg"], "string", numbers.is_numeric_text) == [True, False, False]


def test_convert_unit_leaves_unknown_units(spark):
    df = spark.createDataFrame([(2.0, "g CO2e/kg"), (2.0, "miles"), (2.0, "kg CO2e/kg")], "v double, u string")
    got = [r[0] for r in df.select(units.convert_unit("v", "u", F.lit("kg CO2e/kg"))).collect()]
    assert got == [0.002, 2.0, 2.0]


REGION_CASES = [
    ("AUSTRIA", "US", "AT"),
    ("EUROPE", "RO", "WE"),
    ("AFRICA", "FR", "WF"),
    ("ASIA", "SI", "WA"),
    ("CHINA", "IN", "CN"),
    ("United States", "AT", "US"),
    (" de ", "DE", "DE"),
    ("Atlantis", "AT", "ROW"),
    ("Oz", "ROW", "ROW"),
    (None, None, None),
]


@pytest.mark.parametrize(("given", "reference", "exact"), REGION_CASES)
def test_country_in_both_modes(spark, given, reference, exact):
    assert column(spark, [given], "string", lambda c: regions.standardize_country(c, "reference")) == [reference]
    assert column(spark, [given], "string", lambda c: regions.standardize_country(c, "exact")) == [exact]


TAG_CASES = [
    ("['a']", ["a"], ["['a']"]),
    ('["a", "b"]', ["a", "b"], ["a", "b"]),
    ("nope", [], ["nope"]),
    ("['it's']", [], ["['it's']"]),
    ("3", [], ["3"]),
    ("3.0", [], ["3.0"]),
    ('"x"', [], ["x"]),
    ("true", [], ["True"]),
    (None, [], []),
    ("[]", [], []),
]


@pytest.mark.parametrize(("given", "lenient", "strict"), TAG_CASES)
def test_tag_parsers(spark, given, lenient, strict):
    assert column(spark, [given], "string", tags.parse_lenient) == [lenient]
    assert column(spark, [given], "string", tags.parse_strict) == [strict]


def test_sectors_fall_back_to_type(spark):
    df = spark.createDataFrame(
        [(["sector:a", "x:b", "sector:c"], "t"), (["x:b"], "t"), (None, None), ([], "")],
        "tags array<string>, entity_type string",
    )
    got = [r[0] for r in df.select(tags.sectors_or_type("tags", "entity_type")).collect()]
    assert got == [["a", "c"], ["t"], [], []]


def test_metadata_json_keeps_nulls(spark):
    df = spark.createDataFrame([("a", None)], "p string, q string")
    assert df.select(tags.metadata_json(F.col("p"), F.col("q"))).head()[0] == '{"p":"a","q":null}'


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("It is 2.5 kg CO2e/km, not 7", 2.5),
        ("Year 2019: 3 tons CO2e", 3.0),
        ("-4e3 units", 4.0),
        ("12 KG CO2E then 9 g CO2e", 9.0),
        ("none", None),
        (None, None),
    ],
)
def test_extract_value(spark, given, expected):
    assert column(spark, [given], "string", responses.extract_value) == [expected]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Sourced FROM USEEIO_v2.1.", "USEEIO_v2.1"),
        ("according to Trace; from Ägypten", "Ägypten"),
        ("source: IPCC-AR6", "IPCC-AR6"),
        ("no citation", None),
    ],
)
def test_extract_source(spark, given, expected):
    assert column(spark, [given], "string", responses.extract_source) == [expected]


def test_prompts(spark):
    df = spark.createDataFrame([("q", "", "a"), ("q", "c", "a")], "i string, n string, o string")
    chat = [r[0] for r in df.select(responses.chat_prompt("i", "n", "o")).collect()]
    assert chat == ["<s>[INST] q [/INST] a </s>", "<s>[INST] q\n\nc [/INST] a </s>"]
    ask = [r[0] for r in df.select(responses.template_prompt("i", "n")).collect()]
    assert ask == ["<s>[INST] q  [/INST]", "<s>[INST] q \nc [/INST]"]


def test_confidence_band_scale(spark):
    assert column(spark, [0.9, 29.0, 30.0, 70.0, 100.0, -1.0], "double", bands.confidence_band) == [
        "low", "low", "medium", "high", "low", "low",
    ]
    assert column(spark, [0.9, 0.3], "double", lambda c: bands.confidence_band(c, 100)) == ["high", "medium"]


def test_flags_are_true_only_for_true(spark):
    assert column(spark, ["True", " true", "1", None, "no"], "string", numbers.parse_flag) == [True, True, False, False, False]


def test_first_listed_word_anywhere():
    import re

    words = ["US", "AUS", "AT", "AUSTRIA", "U", "x.y", "x", "FRA", "FR"]
    rng = random.Random(7)
    pattern = re.compile(text.trie_pattern(words))
    for _ in range(500):
        given = "".join(rng.choice(["A", "U", "S", "T", "R", "I", "x", ".", "y", "F", " "]) for _ in range(rng.randint(0, 9)))
        hits = [m for k in range(len(given)) if (m := pattern.match(given, k))]
        longest = {k: max((w for w in words if given.startswith(w, k)), key=len, default=None) for k in range(len(given))}
        assert {m.start(): m[0] for m in hits} == {k: w for k, w in longest.items() if w}
    for bad in ([], ["a", ""]):
        with pytest.raises(ValueError):
            text.trie_pattern(bad)


def test_first_listed_against_a_ladder(spark):
    words = ["US", "AUS", "AT", "AUSTRIA", "U", "x.y", "x", "FRA", "FR"]
    rng = random.Random(8)
    given = ["".join(rng.choice("AUSTRIxyF. ") for _ in range(rng.randint(0, 9))) for _ in range(300)] + [None, "AUSTRIA", "FRANCE"]
    want = [next((k for k, w in enumerate(words) if t is not None and w in t), None) for t in given]
    for few in (0, 100):
        assert column(spark, given, "string", lambda c, few=few: text.first_listed(c, words, few)) == want
    many = [f"K{k:03d}" for k in range(1000)]
    got = column(spark, ["a K999 K512 b", "K5120", "none"], "string", lambda c: text.first_listed(c, many))
    assert got == [512, 512, None]
