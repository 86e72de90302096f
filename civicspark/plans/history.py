"""Incident history and nearby resources for a table of located requests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FEET, MILES
from ..operators import spatial as sp
from ..operators.ranking import first_per_key
from ..operators.staging import together
from ..operators.substring import containing

# Rows shown per source, and half width of each source's box in degrees.
HISTORY_LIMITS = {"311": 10, "HPD Violation": 8, "DOB Violation": 8, "FDNY": 8, "EMS": 8, "NYPD": 8}
SOURCE_RANK = {"311": 1, "HPD Violation": 2, "DOB Violation": 3, "FDNY": 4, "EMS": 5, "NYPD": 6}
FIRE_BOX = sp.Box(0.003, strict=False)
EMS_BOX = sp.Box(0.002, strict=False)
NYPD_BOX = sp.Box(0.002, strict=False)
HYDRANT_BOX = sp.Box(0.005, strict=False)
FACILITY_BOX = sp.Box(0.01, strict=False)
NEAREST = {"hospitals": 3, "hydrants": 3, "facilities": 5}

_ENTRY = ["request_id", "source", "rn", "type", "detail", "date", "status"]


@dataclass
class Tables:
    """Fact tables of the history; a table that is None contributes nothing."""

    requests_311: DataFrame | None = None
    hpd: DataFrame | None = None
    dob: DataFrame | None = None
    fire: DataFrame | None = None
    ems: DataFrame | None = None
    nypd: DataFrame | None = None


def nulls_last(*columns: str) -> list[str]:
    return [f"{c} ASC NULLS LAST" for c in columns]


def locate(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """(request_id, bbl, bin, addr, latitude, longitude): the request's own point, else the building's.

    ``addr`` is the address as typed, upper-cased; ``resolved`` is the output of :func:`.resolve.resolve`.
    """
    own = requests.selectExpr("request_id", "upper(address) AS addr", "latitude AS rlat", "longitude AS rlon")
    found = resolved.select("request_id", "bbl", "bin", "latitude", "longitude")
    lat = "coalesce(nullif(rlat, 0D), latitude)"
    lon = "coalesce(nullif(rlon, 0D), longitude)"
    return own.join(found, "request_id", "left").selectExpr("request_id", "bbl", "bin", "addr", f"{lat} AS latitude", f"{lon} AS longitude")


def by_key(located: DataFrame, facts: DataFrame, key: str, order: list[str], k: int | None, payload: list[str]) -> DataFrame:
    """First k facts of each request's key. Facts are cut to k per key before they meet the requests."""
    asked = located.where(f"{key} IS NOT NULL AND {key} != ''").select("request_id", key)
    rows = facts.join(asked.select(key).distinct(), key, "left_semi").selectExpr(key, *payload)
    if k is not None:
        rows = first_per_key(rows, [key], order, k)
    return asked.join(rows, key).drop(key)


def by_box(located: DataFrame, points: DataFrame, box: sp.Box, order: list[str], k: int, payload: list[str]) -> DataFrame:
    """First k points in the box around each request; requests at one spot are answered once."""
    asked = located.where("latitude != 0 AND longitude != 0").selectExpr("request_id", "latitude AS qlat", "longitude AS qlon")
    usable = points.where("latitude IS NOT NULL AND latitude != 0")
    found = sp.latest_within(asked.select("qlat", "qlon").distinct(), usable, box, k, order, payload)
    return asked.join(found, ["qlat", "qlon"]).drop("qlat", "qlon")


def requests_311(located: DataFrame, facts: DataFrame, order: list[str], k: int, payload: list[str]) -> DataFrame:
    """311 rows by lot; only where a lot has none, by address text inside the incident address."""
    first = by_key(located, facts, "bbl", order, k, payload)
    lots = facts.where("bbl IS NOT NULL").select("bbl").distinct()
    with_rows = located.join(lots, "bbl", "left_semi").select("request_id")
    rest = located.where("addr IS NOT NULL AND addr != ''").join(with_rows, "request_id", "left_anti").select("request_id", "addr")
    named = facts.where("incident_address IS NOT NULL").selectExpr("upper(incident_address) AS entry", *payload)
    best = first_per_key(named, ["entry"], order, k).drop("rn")  # k per address suffice
    pairs = containing(rest.selectExpr("addr AS pattern").distinct(), best.select("entry").distinct())
    top = first_per_key(pairs.join(best, "entry"), ["pattern"], order, k).drop("entry")
    second = rest.join(top, rest["addr"] == top["pattern"]).drop("addr", "pattern")
    return first.unionByName(second)


def _entries(rows: DataFrame, source: str, kind: str, detail: str, date: str, status: str) -> DataFrame:
    return rows.selectExpr(
        "request_id", f"'{source}' AS source", "rn", f"{kind} AS type", f"{detail} AS detail",
        f"CAST({date} AS STRING) AS date", f"{status} AS status",
    )


def history(located: DataFrame, t: Tables) -> DataFrame:
    """All history entries: (request_id, source, rn, type, detail, date, status), at most 50 per request.

    Entries of a request are shown by source in the order of SOURCE_RANK, newest first within a source.
    """
    lim = HISTORY_LIMITS
    none = "CAST(NULL AS STRING)"

    def from_311() -> DataFrame:
        cols = ["complaint_type", "descriptor", "status", "created_date", "unique_key"]
        rows = requests_311(located, t.requests_311, ["created_date DESC NULLS LAST", "unique_key"], lim["311"], cols)
        return _entries(rows, "311", "complaint_type", "descriptor", "created_date", "status")

    def from_hpd() -> DataFrame:
        ties = nulls_last("violation_id", "nov_description", "violation_class", "current_status")
        rows = by_key(located, t.hpd, "bin", ["inspection_date DESC NULLS LAST", *ties], lim["HPD Violation"],
                      ["violation_class", "nov_description", "current_status", "inspection_date", "violation_id"])
        return _entries(rows, "HPD Violation", "concat('Class ', violation_class)", "nov_description", "inspection_date", "current_status")

    def from_dob() -> DataFrame:
        ties = nulls_last("id", "description", "violation_type", "is_active")
        rows = by_key(located, t.dob, "bin", ["issue_date DESC NULLS LAST", *ties], lim["DOB Violation"],
                      ["violation_type", "description", "is_active", "issue_date", "id"])
        return _entries(rows, "DOB Violation", "violation_type", "description", "issue_date",
                        "CASE WHEN is_active THEN 'ACTIVE' ELSE 'Resolved' END")

    def from_fire() -> DataFrame:
        rows = by_box(located, t.fire, FIRE_BOX, ["incident_datetime DESC NULLS LAST", "incident_id"], lim["FDNY"],
                      ["incident_type_desc", "incident_classification", "incident_datetime", "incident_id"])
        return _entries(rows, "FDNY", "incident_type_desc", "incident_classification", "incident_datetime", none)

    def from_ems() -> DataFrame:
        rows = by_box(located, t.ems, EMS_BOX, ["incident_datetime DESC NULLS LAST", "cad_incident_id"], lim["EMS"],
                      ["initial_call_type", "initial_severity_level", "incident_datetime", "cad_incident_id"])
        return _entries(rows, "EMS", "initial_call_type", "concat('Severity: ', initial_severity_level)", "incident_datetime", none)

    def from_nypd() -> DataFrame:
        rows = by_box(located, t.nypd, NYPD_BOX, ["complaint_date DESC NULLS LAST", "complaint_number"], lim["NYPD"],
                      ["offense_description", "law_category", "complaint_date", "complaint_number"])
        return _entries(rows, "NYPD", "offense_description", "law_category", "complaint_date", none)

    sources = [(t.requests_311, from_311), (t.hpd, from_hpd), (t.dob, from_dob), (t.fire, from_fire), (t.ems, from_ems), (t.nypd, from_nypd)]
    parts = together(*[step for table, step in sources if table is not None])
    return reduce(lambda a, b: a.unionByName(b), parts).select(*_ENTRY)


def source_counts(entries: DataFrame) -> DataFrame:
    """Entries per request and kind of source, on the history as shown (already limited)."""
    return entries.groupBy("request_id").agg(
        F.expr("count_if(source = 'FDNY') AS fire_n"), F.expr("count_if(source = 'EMS') AS ems_n"),
        F.expr("count_if(source = 'NYPD') AS nypd_n"), F.expr("count_if(contains(source, 'HPD')) AS hpd_n"),
        F.expr("count_if(contains(source, 'DOB')) AS dob_n"),
    )


TOTALS = ["fire_total", "ems_total", "nypd_total", "hpd_total", "dob_total"]


def full_counts(located: DataFrame, t: Tables) -> DataFrame:
    """Entries per request and kind of source before any cut, beside :func:`source_counts` of the shown history:
    (request_id, fire_total, ems_total, nypd_total, hpd_total, dob_total).

    Boxes are counted by cell aggregates (:func:`spatial.count_within`: a cell inside a box is counted whole, no pair
    is made), keys by one count per key; the counts of all sources are stacked and folded in one aggregation.
    """
    placed = located.where("latitude != 0 AND longitude != 0").selectExpr("request_id", "latitude AS qlat", "longitude AS qlon")
    spots = placed.select("qlat", "qlon").distinct()
    keyed = located.where("bin IS NOT NULL AND bin != ''").select("request_id", "bin")
    parts = []
    for name, table, box in (("fire_total", t.fire, FIRE_BOX), ("ems_total", t.ems, EMS_BOX), ("nypd_total", t.nypd, NYPD_BOX)):
        if table is not None:
            n = sp.count_within(spots, table.where("latitude IS NOT NULL AND latitude != 0"), box)
            parts.append(placed.join(n, ["qlat", "qlon"]).selectExpr("request_id", f"'{name}' AS total", "n"))
    for name, table in (("hpd_total", t.hpd), ("dob_total", t.dob)):
        if table is not None:
            n = table.join(keyed.select("bin").distinct(), "bin", "left_semi").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
            parts.append(keyed.join(n, "bin").selectExpr("request_id", f"'{name}' AS total", "n"))
    sums = [F.coalesce(F.sum(F.when(F.col("total") == c, F.col("n"))), F.lit(0)).cast("long").alias(c) for c in TOTALS]
    if not parts:
        return located.select("request_id", *[F.lit(0).cast("long").alias(c) for c in TOTALS])
    folded = reduce(lambda a, b: a.unionByName(b), parts).groupBy("request_id").agg(*sums)
    return located.select("request_id").join(folded, "request_id", "left").na.fill(0, TOTALS)


def _nearest(located: DataFrame, found: DataFrame, kind: str, name: str, decimals: int) -> DataFrame:
    asked = located.where("latitude != 0 AND longitude != 0").selectExpr("request_id", "latitude AS qlat", "longitude AS qlon")
    return asked.join(found, ["qlat", "qlon"]).selectExpr(
        "request_id", f"'{kind}' AS kind", "rn", f"{name} AS name", f"round(dist, {decimals}) AS distance"
    )


def nearby(located: DataFrame, hospitals: DataFrame | None, hydrants: DataFrame | None, facilities: DataFrame | None) -> DataFrame:
    """(request_id, kind, rn, name, distance): nearest hospitals in miles, hydrants and facilities in feet.

    Rows are ordered by exact distance, then name. As rounding keeps order, they are in order of the shown distance.
    """
    spots = located.where("latitude != 0 AND longitude != 0").selectExpr("latitude AS qlat", "longitude AS qlon").distinct()
    usable = "latitude IS NOT NULL AND latitude != 0"
    steps = []
    if hospitals is not None:
        def hospital_rows() -> DataFrame:
            near = sp.nearest_anywhere(spots, hospitals.where(usable), NEAREST["hospitals"], ["facility_name"], ["facility_name"], MILES)
            return _nearest(located, near, "hospitals", "facility_name", 2)
        steps.append(hospital_rows)
    if hydrants is not None:
        def hydrant_rows() -> DataFrame:
            near = sp.nearest_within(spots, hydrants.where(usable), HYDRANT_BOX, NEAREST["hydrants"], ["unitid"], ["unitid"], FEET)
            return _nearest(located, near, "hydrants", "unitid", 0)
        steps.append(hydrant_rows)
    if facilities is not None:
        def facility_rows() -> DataFrame:
            near = sp.nearest_within(spots, facilities.where(usable), FACILITY_BOX, NEAREST["facilities"], ["facname"], ["facname"], FEET)
            return _nearest(located, near, "facilities", "facname", 0)
        steps.append(facility_rows)
    return reduce(lambda a, b: a.unionByName(b), together(*steps))
