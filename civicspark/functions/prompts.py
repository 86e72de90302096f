"""Context and prompt texts as columns, for any downstream batch scorer. Everything is an SQL expression text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headings and closing lines of the two prompt forms.
DISPATCH_PARTS = {
    "context": "BUILDING HISTORY AT THIS LOCATION:\n",
    "vision": "SCENE FROM PHOTO:\n",
    "report": "INCIDENT REPORT:\n",
    "closing": "\n\nReturn ONLY the JSON.",
}
SEARCH_PARTS = {
    "context": "CONTEXT FROM NYC INCIDENT DATABASE:\n",
    "vision": "VISUAL SCENE ANALYSIS:\n",
    "report": "INCIDENT REPORT:\n",
    "closing": "\n\n\nAnalyze this incident. Return ONLY the JSON object with category, severity, agency, summary, and "
    "confidence. No other text.",
}
# Lengths kept of each text.
VISION_CHARS, REPORT_CHARS, CONTEXT_CHARS, SIMILAR_SHOWN = 300, 400, 2000, 3


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _heading(head: str, column: str) -> str:
    """The part with its heading, or NULL (skipped by concat_ws) when the text is missing or empty."""
    return f"CASE WHEN {column} != '' THEN concat({lit(head)}, {column}) END"


def prompt(context: str, vision: str, text: str, parts: dict[str, str] = DISPATCH_PARTS) -> Column:
    report = f"concat({lit(parts['report'])}, {text}, {lit(parts['closing'])})"
    return F.expr(f"concat_ws({lit(chr(10) * 2)}, {_heading(parts['context'], context)}, {_heading(parts['vision'], vision)}, {report})")


def shown(column: str) -> str:
    """A value as printed in a context line; a missing one prints as None."""
    return f"coalesce(CAST({column} AS STRING), 'None')"


def building_line() -> str:
    return (
        f"concat('Building: ', {shown('address')}, ' ', {shown('borough')}, ' | Built ', {shown('year_built')}, ' | ', "
        f"{shown('num_floors')}, ' floors | Owner: ', {shown('owner_name')})"
    )


def count_line(column: str, wording: str) -> str:
    return f"CASE WHEN {column} > 0 THEN concat(CAST({column} AS STRING), {lit(wording)}) END"


# Wording of the count lines, in order.
COUNT_LINES = {
    "fire_n": " prior fire incidents at this location",
    "ems_n": " prior EMS calls nearby",
    "nypd_n": " prior NYPD complaints nearby",
    "hpd_n": " HPD violations (housing code)",
    "dob_n": " DOB violations (building code)",
}


def similar_line(item: str, place: str) -> str:
    """One numbered line for a similar incident."""
    days = f"{item}.resolution_days"
    return (
        f"concat(CAST({place} + 1 AS STRING), '. ', {shown(item + '.complaint_type')}, ' in ', {shown(item + '.borough')}, "
        f"CASE WHEN {item}.date != '' THEN concat(' (', {item}.date, ')') ELSE '' END, "
        f"CASE WHEN {days} > 0 THEN concat(' \u2014 resolved in ', format_string('%.1f', CAST({days} AS DOUBLE)), ' days') ELSE '' END, "
        f"CASE WHEN {item}.source != '' THEN concat(' [source: ', {item}.source, ']') ELSE '' END)"
    )


def search_context(text: str, vision: str, similar: str, total: str, average: str) -> Column:
    """Context of the retrieval form.

    ``similar`` is an array of structs (complaint_type, borough, date, resolution_days, source), best first.
    """
    lines = f"transform(slice({similar}, 1, {SIMILAR_SHOWN}), (x, i) -> {similar_line('x', 'i')})"
    head = lit("\nSIMILAR PAST INCIDENTS IN NYC:")
    past = (
        f"CASE WHEN {total} > 0 AND {average} > 0 THEN concat({lit(chr(10) + 'HISTORICAL CONTEXT: ')}, format_number({total}, 0), "
        f"' similar incidents on record. Average resolution: ', format_string('%.1f', {average}), ' days.') END"
    )
    whole = (
        f"concat_ws({lit(chr(10))}, CASE WHEN {vision} != '' THEN concat('SCENE ANALYSIS: ', substring({vision}, 1, {VISION_CHARS})) END, "
        f"concat('DISPATCH REPORT: ', substring({text}, 1, {REPORT_CHARS})), "
        f"CASE WHEN size({similar}) > 0 THEN {head} END, CASE WHEN size({similar}) > 0 THEN array_join({lines}, {lit(chr(10))}) END, {past})"
    )
    return F.expr(f"CASE WHEN length({whole}) > {CONTEXT_CHARS} THEN concat(substring({whole}, 1, {CONTEXT_CHARS}), '...') ELSE {whole} END")
