"""Column functions on literal rows with hand-computed answers."""

import pytest
from pyspark.sql import functions as F

from civicspark.functions import codes, prompts, rules
from civicspark.functions import scalars as s


def values(spark, texts, fn, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_borough_code_and_labels(spark):
    assert values(spark, [" manhattan ", "NEW YORK", '"Kings"', "Richmond", "1", "", None], codes.borough_code) == [1, 1, 2, 5, 0, 0, 0]
    assert values(spark, [0, 5, 6, None], lambda c: codes.borough_label(c), "int") == ["Unknown", "Staten Island", "Unknown", "Unknown"]
    assert values(spark, [17, 20, 21], lambda c: codes.complaint_label(c), "int") == ["Fire", "Other", "Unknown"]


def test_complaint_code_word_trap(spark):
    texts = ["Heating", "Sewer Problems", "Fire Safety", "Noise - Helicopter", "Noise - Commercial", "Assault", None, "x"]
    assert values(spark, texts, codes.complaint_code) == [2, 18, 17, 1, 12, 19, 20, 20]


def test_canonical_borough(spark):
    assert values(spark, ["2", "3", "kings", "nan", "", None, "Jersey"], codes.canonical_borough) == [
        "BRONX", "BROOKLYN", "BROOKLYN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_severities_at_the_limits(spark):
    assert values(spark, [10000.01, 10000.0, 2500.0, 500.0, None], codes.ecb_severity, "double") == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW"]
    assert values(spark, ["LL1081", "P*CLSS1", "UB", "x", None], codes.dob_severity) == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW"]


def test_bands_differ_at_the_limits(spark):
    assert values(spark, [60.0, 60.1, 30.0, 0.0, None], codes.risk_band, "double") == ["yellow", "red", "scored", "none", "none"]
    assert values(spark, [60.0, 30.0, 10.0, 9.9, None], codes.display_band, "double") == ["severe", "high", "medium", "low", "low"]


def test_integer_casts(spark):
    assert values(spark, ["3.7", "2.5", " 4 ", "x", "", None, "-2.5"], s.to_int) == [4, 3, 4, None, None, None, -3]


def test_strict_and_lenient_dates(spark):
    texts = ["2024-01-02", "2024-01-02T10:00:00.000", "01/02/2024", "20240102", "2024", "", None]
    strict = [str(v) if v else None for v in values(spark, texts, s.to_date)]
    assert strict == ["2024-01-02", "2024-01-02", None, None, None, None, None]
    lenient = [str(v) if v else None for v in values(spark, texts, lambda c: s.to_date(c, True))]
    assert lenient[2] == "2024-01-02" and lenient[3] is None


def test_epoch_seconds(spark):
    texts = ["01/02/2024 03:04:05 PM", "1/2/2024 15:04:05", "2024-01-02T15:04:05.000", " 1/2/2024 ", "2024-01-02", "junk", "", None]
    assert values(spark, texts, s.epoch_seconds) == [1704207845, 1704207845, 1704207845, 1704153600, 0, 0, 0, 0]


def test_resolution_days(spark):
    df = spark.createDataFrame([(100, 86500), (100, 100), (0, 50), (100, 50)], "a bigint, b bigint")
    assert [r[0] for r in df.select(s.resolution_days(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, -1.0, -1.0]


def test_bbl_and_truncation(spark):
    assert values(spark, ["1-00477 0001", "1004770001", "10047", None], s.looks_like_bbl) == ["1004770001", "1004770001", None, None]
    assert values(spark, ["abcdef", "abc"], lambda c: s.truncated(c, 3, "...")) == ["abc...", "abc"]


# One own report per kind and what the rules make of it.
SCENARIOS = [
    ("Neighbours play drums with loud noise all night", 1, "NYPD", "noise"),
    ("Runner is unconscious and not breathing by the lake", 4, "EMS", "medical"),
    ("There is a fire in the bakery", 5, "FDNY", "fire"),
    ("Two cars met in a crash at the bridge", 2, "311", "traffic"),
    ("A suspicious bag lies on platform two", 2, "311", "suspicious"),
]


@pytest.mark.parametrize("text,severity,agency,scenario", SCENARIOS)
def test_rules(spark, text, severity, agency, scenario):
    row = spark.createDataFrame([(text,)], "t string").select(rules.triage("t").alias("r"), rules.scenario("t").alias("s")).first()
    assert (row.r.severity, row.r.agency, row.s) == (severity, agency, scenario)
    assert text[:40] in row.r.summary


def test_rule_order_and_substrings(spark):
    df = spark.createDataFrame([("gas leak and FIRE",), ("a begunia",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(rules.triage("t")["category"]).collect()]
    assert got == ["Structure Fire", "Violent Crime", "General Incident", "General Incident"]


def test_replies(spark):
    good = '{"category":"A","severity":3,"agency":"EMS","send":"x","summary":"y","confidence":0.7}'
    replies = [good, f"```json\n{good}\n```", f"Answer: {good} thanks", "{broken", None, "[]"]
    df = spark.createDataFrame([(i, r, "loud party") for i, r in enumerate(replies)], "i int, reply string, t string")
    got = [r[0] for r in df.orderBy("i").select(rules.parse_reply("reply", "t")["category"]).collect()]
    assert got == ["A", "A", "A", "Noise Complaint", "Noise Complaint", "Noise Complaint"]


def test_prompt_skips_empty_parts(spark):
    df = spark.createDataFrame([("ctx", None, "t"), ("", "pic", "t")], "c string, v string, t string")
    a, b = [r[0] for r in df.select(prompts.prompt("c", "v", "t")).collect()]
    assert a == "BUILDING HISTORY AT THIS LOCATION:\nctx\n\nINCIDENT REPORT:\nt\n\nReturn ONLY the JSON."
    assert b == "SCENE FROM PHOTO:\npic\n\nINCIDENT REPORT:\nt\n\nReturn ONLY the JSON."
