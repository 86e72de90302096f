"""Lookups between names and codes, severities and bands. All are column expressions; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Borough name or county -> numeric code.
BOROUGH_CODES = {
    "MANHATTAN": 1,
    "NEW YORK": 1,
    "BROOKLYN": 2,
    "KINGS": 2,
    "QUEENS": 3,
    "BRONX": 4,
    "STATEN ISLAND": 5,
    "RICHMOND": 5,
}
# Label of each borough code, in code order.
BOROUGH_LABELS = ["Unknown", "Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"]
# Canonical borough from name, county or digit (the digits are not the codes above).
BOROUGH_NAMES = {
    "MANHATTAN": "MANHATTAN",
    "BROOKLYN": "BROOKLYN",
    "QUEENS": "QUEENS",
    "BRONX": "BRONX",
    "STATEN ISLAND": "STATEN ISLAND",
    "NEW YORK": "MANHATTAN",
    "KINGS": "BROOKLYN",
    "RICHMOND": "STATEN ISLAND",
    "1": "MANHATTAN",
    "2": "BRONX",
    "3": "BROOKLYN",
    "4": "QUEENS",
    "5": "STATEN ISLAND",
}
# Exact complaint type -> code.
COMPLAINT_CODES = {
    "NOISE": 1,
    "NOISE - RESIDENTIAL": 1,
    "NOISE - STREET/SIDEWALK": 1,
    "NOISE - VEHICLE": 1,
    "NOISE - PARK": 1,
    "HEAT/HOT WATER": 2,
    "HEATING": 2,
    "STREET CONDITION": 3,
    "PLUMBING": 4,
    "WATER SYSTEM": 5,
    "PAINT/PLASTER": 6,
    "BLOCKED DRIVEWAY": 7,
    "GENERAL CONSTRUCTION": 8,
    "ILLEGAL PARKING": 9,
    "UNSANITARY CONDITION": 10,
    "RODENT": 11,
    "NOISE - COMMERCIAL": 12,
    "ELEVATOR": 13,
    "ELECTRIC": 14,
    "DOOR/WINDOW": 15,
    "APPLIANCE": 16,
}
# Words tried inside other complaint types, first hit wins.
COMPLAINT_WORDS = [("FIRE", 17), ("MEDICAL", 18), ("EMS", 18), ("ASSAULT", 19), ("NOISE", 1)]
COMPLAINT_OTHER = 20
# Label of each complaint code, in code order.
COMPLAINT_LABELS = [
    "Unknown",
    "Noise",
    "Heat/Hot Water",
    "Street Condition",
    "Plumbing",
    "Water System",
    "Paint/Plaster",
    "Blocked Driveway",
    "General Construction",
    "Illegal Parking",
    "Unsanitary Condition",
    "Rodent",
    "Noise - Commercial",
    "Elevator",
    "Electric",
    "Door/Window",
    "Appliance",
    "Fire",
    "Medical",
    "Assault",
    "Other",
]
# Violation types per severity, and penalty floors per severity.
DOB_SEVERITY = {
    "CRITICAL": ["LL6291", "AEUHAZ", "IMEGNCY", "LL1081"],
    "HIGH": ["ACC1", "HBLVIO", "P*CLSS1"],
    "MEDIUM": ["UB", "COMPBLD"],
}
ECB_PENALTY_ABOVE = {"CRITICAL": 10000.0, "HIGH": 2500.0, "MEDIUM": 500.0}
# Severity scale shown to users.
SEVERITY_LABELS = {1: "Low", 2: "Moderate", 3: "Urgent", 4: "Critical", 5: "Life-Threatening"}


def lookup(key: Column, table: dict, default) -> Column:
    """Constant map lookup. The map is a literal, so it costs no join and no shuffle."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def trim_quoted(text: Column) -> Column:
    """Strip blanks, tabs, line ends and double quotes from both ends."""
    return F.btrim(text, F.lit(' \t\r\n"'))


def borough_code(name: Column) -> Column:
    return lookup(F.upper(trim_quoted(name)), BOROUGH_CODES, 0).cast("tinyint")


def complaint_code(kind: Column) -> Column:
    key = F.upper(trim_quoted(kind))
    by_word = F.lit(COMPLAINT_OTHER)
    for word, code in reversed(COMPLAINT_WORDS):
        by_word = F.when(key.contains(word), F.lit(code)).otherwise(by_word)
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in COMPLAINT_CODES.items() for x in kv]), key)
    return F.coalesce(exact, by_word).cast("tinyint")


def _label(code: Column, labels: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), code.cast("int")), F.lit(labels[0]))


def borough_label(code: Column) -> Column:
    return _label(code, BOROUGH_LABELS)


def complaint_label(code: Column) -> Column:
    return _label(code, COMPLAINT_LABELS)


def canonical_borough(value: Column) -> Column:
    """Canonical name from a name, county or digit; anything else, blanks and NULL are UNKNOWN."""
    return lookup(F.upper(F.trim(value.cast("string"))), BOROUGH_NAMES, "UNKNOWN")


def dob_severity(violation_type: Column) -> Column:
    out = F.lit("LOW")
    for level, kinds in reversed(DOB_SEVERITY.items()):
        out = F.when(violation_type.isin(kinds), F.lit(level)).otherwise(out)
    return out


def ecb_severity(penalty: Column) -> Column:
    out = F.lit("LOW")
    for level, floor in reversed(ECB_PENALTY_ABOVE.items()):
        out = F.when(penalty > F.lit(floor), F.lit(level)).otherwise(out)
    return out


def risk_band(score: Column) -> Column:
    """Band of the scoring job: red above 60, yellow above 30, scored above 0."""
    return F.when(score > 60, "red").when(score > 30, "yellow").when(score > 0, "scored").otherwise("none")


def display_band(score: Column) -> Column:
    """Band of the report page: thresholds are inclusive and one step lower."""
    return F.when(score >= 60, "severe").when(score >= 30, "high").when(score >= 10, "medium").otherwise("low")


def severity_label(severity: Column) -> Column:
    return lookup(severity.cast("int"), SEVERITY_LABELS, SEVERITY_LABELS[2])


def active_label(flag: Column) -> Column:
    return F.when(flag, "ACTIVE").otherwise("Resolved")
