"""Rule-based triage of incident texts, severity and routing tables, and parsing of stored model replies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes


@dataclass(frozen=True)
class Rule:
    words: tuple[str, ...]
    category: str
    severity: int
    agency: str
    send: str
    lead: str  # summary before the text
    tail: str  # summary after the text
    confidence: float = 0.5


# Words, answers and summary wording of the triage rules, tried in this order.
TRIAGE_RULES = [
    Rule(("fire", "smoke", "burning", "flames"), "Structure Fire", 5, "FDNY",
         "Engine Company + Ladder Company + Battalion Chief + EMS standby",
         "Reported fire/smoke. ", ". Deploy full box alarm. EMS standby for potential victims."),
    Rule(("medical", "breathing", "collapsed", "unconscious", "chest", "heart"), "Medical Emergency", 4, "EMS",
         "ALS Ambulance + First Responder", "Medical emergency reported. ", ". Deploy ALS unit."),
    Rule(("gun", "shot", "robbery", "assault", "stabbing", "weapon"), "Violent Crime", 5, "NYPD",
         "2 RMPs + Sergeant + EMS standby", "Violent crime reported. ", ". Multiple units needed. EMS standby."),
    Rule(("gas", "leak", "smell"), "Gas Leak", 4, "FDNY", "Engine Company + Haz-Mat Unit",
         "Gas leak/odor reported. ", ". Evacuate area. Con Ed notification."),
    Rule(("noise", "loud", "music", "party"), "Noise Complaint", 1, "NYPD", "1 RMP (Radio Motor Patrol)",
         "Noise disturbance. ", ".", 0.6),
    Rule(("water", "flood", "pipe", "burst"), "Water Emergency", 3, "FDNY", "Engine Company",
         "Water emergency. ", ". Check for electrical hazards."),
]
OTHER = Rule((), "General Incident", 2, "311", "Dispatch appropriate unit based on assessment", "Incident reported: ", "", 0.4)
RULE_TEXT, OTHER_TEXT = 120, 150

# Words of the five demonstration scenarios, tried in this order; the rest is noise.
SCENARIO_RULES = [
    ("fire", ("fire", "smoke", "burning")),
    ("medical", ("medical", "breathing", "collapsed", "unconscious", "chest pain")),
    ("suspicious", ("suspicious", "package", "bomb")),
    ("traffic", ("car", "accident", "vehicle", "crash", "flipped")),
]
SCENARIO_OTHER = "noise"

# Agencies a result may name.
AGENCIES = ["NYPD", "FDNY", "EMS", "Sanitation", "Buildings", "Housing", "Multi", "311"]


def _categories(of: Callable[[Rule], object]) -> dict[object, str]:
    """Categories of the rules, in their order, for each value of ``of``."""
    out: dict[object, list[str]] = {}
    for rule in [*TRIAGE_RULES, OTHER]:
        names = out.setdefault(of(rule), [])
        if rule.category not in names:
            names.append(rule.category)
    return {key: ", ".join(names) for key, names in out.items()}


RESULT_SCHEMA = "category STRING, severity INT, agency STRING, send STRING, summary STRING, confidence DOUBLE"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(words: tuple[str, ...], column: str) -> str:
    """Substring test for several words; short OR chain of ``contains`` keeps it in generated code."""
    return "(" + " OR ".join(f"contains({column}, {_quote(w)})" for w in words) + ")"


def _answer(rule: Rule, text: str, length: int) -> str:
    summary = f"concat({_quote(rule.lead)}, substring({text}, 1, {length}), {_quote(rule.tail)})"
    return (
        f"named_struct('category', {_quote(rule.category)}, 'severity', {rule.severity}, 'agency', {_quote(rule.agency)}, "
        f"'send', {_quote(rule.send)}, 'summary', {summary}, 'confidence', {rule.confidence}D)"
    )


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once per row and called ``name`` (a text is lower-cased once, not per word)."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def triage_sql(text: str) -> str:
    cases = " ".join(f"WHEN {_any(r.words, 'low')} THEN {_answer(r, text, RULE_TEXT)}" for r in TRIAGE_RULES)
    return _bound(f"lower({text})", "low", f"CASE {cases} ELSE {_answer(OTHER, text, OTHER_TEXT)} END")


def triage(text: str) -> Column:
    """Struct column with the answer of the first rule whose words occur anywhere in the lower-cased text."""
    return F.expr(triage_sql(text))


def scenario(text: str) -> Column:
    cases = " ".join(f"WHEN {_any(words, 'low')} THEN {_quote(name)}" for name, words in SCENARIO_RULES)
    return F.expr(_bound(f"lower({text})", "low", f"CASE {cases} ELSE {_quote(SCENARIO_OTHER)} END"))


def parse_reply(reply: str, text: str) -> Column:
    """Result struct from a stored model reply.

    Code fences are stripped; then the whole reply is tried as JSON, then its outermost braces, then the rules.
    """
    bare = f"regexp_replace(regexp_replace(trim(BOTH ' \\t\\r\\n' FROM {reply}), '^```(json)?\\\\s*', ''), '\\\\s*```$', '')"
    schema = _quote(RESULT_SCHEMA)
    whole = f"from_json(CASE WHEN startswith(bare, '{{') THEN bare END, {schema}, map('mode', 'PERMISSIVE'))"
    part = f"from_json(nullif(regexp_extract(bare, '(?s)\\\\{{.*\\\\}}', 0), ''), {schema}, map('mode', 'PERMISSIVE'))"
    usable = "x -> x.category IS NOT NULL OR x.severity IS NOT NULL OR x.agency IS NOT NULL"
    parsed = _bound(bare, "bare", f"get(filter(array({whole}, {part}), {usable}), 0)")
    return F.expr(f"coalesce({parsed}, {triage_sql(text)})")


def severity_scale(spark: SparkSession) -> DataFrame:
    meaning = _categories(lambda r: r.severity)
    rows = [(k, label, meaning.get(k)) for k, label in codes.SEVERITY_LABELS.items()]
    return spark.createDataFrame(rows, "severity int, label string, meaning string")


def agency_routing(spark: SparkSession) -> DataFrame:
    handled = _categories(lambda r: r.agency)
    return spark.createDataFrame([(a, handled.get(a)) for a in AGENCIES if a != OTHER.agency], "agency string, handles string")


def label_results(results: DataFrame) -> DataFrame:
    """Join results with the two small dimensions: severity label and meaning, agency routing."""
    spark = results.sparkSession
    out = results.join(F.broadcast(severity_scale(spark)), "severity", "left")  # one row per severity
    return out.join(F.broadcast(agency_routing(spark)), "agency", "left")  # one row per agency
