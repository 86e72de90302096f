"""Building reports for a table of resolved requests: one frame per section."""

from __future__ import annotations

from functools import partial, reduce
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import together
from . import history as h

# Rows shown per section. Elevators are shown whole.
SECTION_LIMITS = {
    "dob_violations": 50,
    "dob_safety_violations": 30,
    "ecb_violations": 30,
    "hpd_violations": 50,
    "hpd_complaints": 50,
    "fire_inspections": 20,
    "elevators": None,
    "service_requests_311": 50,
    "fire_incidents": 30,
    "ems_incidents": 20,
    "nypd_complaints": 20,
}
# Per section found by bin: date column that orders it, and columns shown.
BIN_SECTIONS = {
    "dob_violations": ("issue_date", ["violation_type", "description", "issue_date", "severity", "is_active"]),
    "dob_safety_violations": ("issue_date", ["violation_type", "violation_description", "issue_date", "status"]),
    "ecb_violations": ("issue_date", ["ecb_violation_number", "violation_type", "violation_description", "penalty_imposed",
                                      "balance_due", "issue_date", "severity", "is_active"]),
    "hpd_violations": ("inspection_date", ["violation_class", "nov_description", "inspection_date", "current_status", "apartment"]),
    "hpd_complaints": ("received_date", ["major_category", "minor_category", "status", "status_description", "received_date"]),
    "fire_inspections": ("inspection_date", ["inspection_date", "result", "violation_description", "is_compliant"]),
    "elevators": (None, ["device_type", "status", "speed", "capacity", "floor_from", "floor_to"]),
}
BOX_SECTIONS = {
    "fire_incidents": (h.FIRE_BOX, "incident_datetime", ["incident_type_desc", "incident_classification", "incident_datetime",
                                                         "engines_assigned", "dispatch_response_seconds"]),
    "ems_incidents": (h.EMS_BOX, "incident_datetime", ["initial_call_type", "initial_severity_level", "incident_datetime",
                                                       "dispatch_response_seconds"]),
    "nypd_complaints": (h.NYPD_BOX, "complaint_date", ["offense_description", "law_category", "complaint_date", "premises_type"]),
}
SECTION_311 = ["complaint_type", "descriptor", "status", "created_date", "agency"]
# Sections that the "no direct records" note looks at.
DIRECT_SECTIONS = [
    "dob_violations", "ecb_violations", "hpd_violations", "hpd_complaints", "service_requests_311", "fire_incidents",
    "ems_incidents", "nypd_complaints", "fire_inspections", "elevators",
]


def _shown(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _order(df: DataFrame, date: str, columns: list[str], tie: str | None) -> list[str]:
    ties = [tie] if tie else [c for c in _shown(df, columns) if c != date]
    return [f"{date} DESC NULLS LAST", *h.nulls_last(*ties)]


def located_buildings(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """(request_id, bbl, bin, addr, owner_name, latitude, longitude) of the requests that found a building.

    The point is the request's own, else the building's; the address is the building's.
    """
    own = requests.selectExpr("request_id", "latitude AS rlat", "longitude AS rlon")
    found = resolved.selectExpr("request_id", "bbl", "bin", "upper(address) AS addr", "owner_name", "latitude", "longitude")
    return found.join(own, "request_id").selectExpr(
        "request_id", "bbl", "bin", "addr", "owner_name", "coalesce(nullif(rlat, 0D), latitude) AS latitude",
        "coalesce(nullif(rlon, 0D), longitude) AS longitude",
    )


def sections(located: DataFrame, tables: dict[str, DataFrame], ties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Section name -> (request_id, rn, columns...). A section whose table is not given is left out.

    ``ties`` names a column that breaks ties of equal dates per section. ``risk_scores`` and ``owner_portfolio`` in
    ``tables`` add one row per request each; ``hospitals``, ``hydrants`` and ``facilities`` add the nearby section.
    """
    ties = ties or {}
    steps: dict[str, Callable[[], DataFrame]] = {}
    for name, (date, columns) in BIN_SECTIONS.items():
        if name in tables:
            df = tables[name]
            show = _shown(df, columns)
            tie = ties.get(name)
            payload = list(dict.fromkeys([*show, *([tie] if tie else [])]))
            if date is None:
                steps[name] = partial(h.by_key, located, df, "bin", [], None, payload)
            else:
                steps[name] = partial(h.by_key, located, df, "bin", _order(df, date, columns, tie), SECTION_LIMITS[name], payload)
    if "service_requests_311" in tables:
        df = tables["service_requests_311"]
        tie = ties.get("service_requests_311")
        payload = list(dict.fromkeys([*_shown(df, SECTION_311), *([tie] if tie else [])]))
        order = _order(df, "created_date", SECTION_311, tie)
        steps["service_requests_311"] = partial(h.requests_311, located, df, order, SECTION_LIMITS["service_requests_311"], payload)
    for name, (box, date, columns) in BOX_SECTIONS.items():
        if name in tables:
            df = tables[name]
            tie = ties.get(name)
            payload = list(dict.fromkeys([*_shown(df, columns), *([tie] if tie else [])]))
            steps[name] = partial(h.by_box, located, df, box, _order(df, date, columns, tie), SECTION_LIMITS[name], payload)
    places = {n: tables.get(n) for n in ("hospitals", "hydrants", "facilities")}
    if any(p is not None for p in places.values()):
        steps["nearby"] = partial(h.nearby, located, **places)
    out = dict(zip(steps, together(*steps.values())))
    if "risk_scores" in tables:
        out["risk_score"] = located.select("request_id", "bbl").join(tables["risk_scores"], "bbl")
    if "owner_portfolio" in tables:
        out["owner_portfolio"] = located.select("request_id", "owner_name").join(tables["owner_portfolio"], "owner_name")
    return out


def section_sizes(located: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Rows per request and section, one column per section, and the "no direct records" flag."""
    tagged = [df.selectExpr("request_id", f"'{name}' AS section") for name, df in parts.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    counts = stacked.groupBy("request_id").agg(*[F.expr(f"count_if(section = '{n}') AS {n}") for n in parts])
    out = located.select("request_id").join(counts, "request_id", "left").na.fill(0)
    direct = " + ".join(n for n in DIRECT_SECTIONS if n in parts) or "0"
    return out.withColumn("no_direct_records", F.expr(f"({direct}) = 0"))
