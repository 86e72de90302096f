"""Named queries over the fixture relations: one per operator or pipeline."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import codes, prompts, rules
from .functions import scalars as s
from .operators import spatial as sp
from .operators.joins import merge_measures
from .operators.ranking import latest_per_key, page
from .operators.staging import written
from .operators.vectors import cosine_top_n
from .plans import corpus as cp
from .plans import crosswalk as xw
from .plans import history as hs
from .plans import portfolio as pf
from .plans import quality as ql
from .plans import report as rp
from .plans import resolve as rs
from .plans import risk
from .plans import scored as sc
from .plans import triage as tr
from .session import ensure_checkpoint_dir
from .sources import conform as cf
from .sources import sinks
from .sources.coded import load_coded
from .streaming import lookup as lk
from .streaming import reports as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def text_dates(df: DataFrame) -> DataFrame:
    """Dates as text, so that both engines print them alike."""
    return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"})


# ---- prepared inputs -------------------------------------------------------------------------------------------


def clean_buildings(spark: SparkSession, d: str) -> DataFrame:
    b = fx.relation(spark, d, "fx_buildings")
    return b.withColumn("bin", F.when(~s.missing_key(F.col("bin")), F.col("bin")))


def stored_buildings(spark: SparkSession, d: str) -> DataFrame:
    """The filled buildings as a table, for plans that read them more than once."""
    return written(buildings(spark, d), "buildings")


def buildings(spark: SparkSession, d: str) -> DataFrame:
    sources = [
        (fx.relation(spark, d, "fx_hpd_violations"), 1),
        (fx.relation(spark, d, "fx_hpd_complaints"), 2),
        (fx.relation(spark, d, "fx_registrations"), 3),
    ]
    return xw.fill_bins(clean_buildings(spark, d), xw.crosswalk(sources))


def ecb(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.relation(spark, d, "fx_ecb_violations")
    return rows.withColumns({
        "is_active": F.coalesce(F.col("balance_due") > 0, F.lit(False)),
        "severity": codes.ecb_severity(F.col("penalty_imposed")),
    })


def dob(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.relation(spark, d, "fx_dob_violations")
    return rows.withColumn("severity", codes.dob_severity(F.col("violation_type")))


def inspections(spark: SparkSession, d: str) -> DataFrame:
    return fx.relation(spark, d, "fx_inspections").withColumn("is_compliant", cf.is_compliant(F.col("result")))


def elevators(spark: SparkSession, d: str) -> DataFrame:
    return fx.relation(spark, d, "fx_elevators").withColumn("status", F.coalesce("raw_status", F.lit("UNKNOWN")))


def hospitals(spark: SparkSession, d: str) -> DataFrame:
    return cf.hospitals_from_facilities(fx.relation(spark, d, "fx_facilities"))


def fire(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(fx.relation(spark, d, "fx_fire_raw"), ["incident_id"], "incident_datetime", "event_id")


def risk_facts(spark: SparkSession, d: str) -> risk.Facts:
    rel = {n: fx.relation(spark, d, f"fx_{n}") for n in ("hpd_violations", "ems_incidents", "nypd_complaints", "service_requests_311", "hydrants")}
    return risk.Facts(
        buildings=buildings(spark, d), dob=dob(spark, d), ecb=ecb(spark, d), hpd=rel["hpd_violations"], fire=fire(spark, d),
        ems=rel["ems_incidents"], nypd=rel["nypd_complaints"], requests=rel["service_requests_311"],
        inspections=inspections(spark, d), elevators=elevators(spark, d), hydrants=rel["hydrants"], hospitals=hospitals(spark, d),
    )


# ---- crosswalk and portfolio -----------------------------------------------------------------------------------


@query
def crosswalk_fill(spark, d):
    return buildings(spark, d).select("bbl", "bin")


def _registration_frames(spark, d):
    regs = fx.relation(spark, d, "fx_registrations").select(
        F.col("contactdescription").alias("contact"), F.col("registrationid").alias("registration_id"), "bin"
    )
    contacts = fx.relation(spark, d, "fx_registration_contacts").select(
        F.col("corporationname").alias("corporation"), F.col("firstname").alias("first_name"),
        F.col("lastname").alias("last_name"), F.col("registrationid").alias("registration_id"),
        F.col("contacttype").alias("role"),
    )
    return regs, contacts


@query
def registrations_portfolio(spark, d):
    regs, contacts = _registration_frames(spark, d)
    return pf.with_contacts(regs, contacts).select("owner_name", "total_buildings", "total_ecb_balance_due")


@query
def registrations_members(spark, d):
    regs, contacts = _registration_frames(spark, d)
    base = pf.registrations(regs)
    added = pf.contacts_not_listed(contacts, base).select("owner_name")
    members = pf.registration_members(regs).unionByName(pf.contact_members(contacts).join(added, "owner_name", "left_semi"))
    return pf.joined(members, ["owner_name"], "bin")


def _portfolio(spark, d, balance):
    out = pf.owner_portfolio(stored_buildings(spark, d), dob(spark, d), fx.relation(spark, d, "fx_hpd_violations"), ecb(spark, d), balance)
    return out.withColumns({
        "total_ecb_balance_due": F.round("total_ecb_balance_due", 1),
        "avg_violations_per_building": F.round("avg_violations_per_building", 4),
    })


@query
def owner_portfolio_compat(spark, d):
    return _portfolio(spark, d, "compat")


@query
def owner_portfolio_exact(spark, d):
    return _portfolio(spark, d, "exact")


@query
def owner_bins(spark, d):
    return pf.owner_bins(buildings(spark, d))


@query
def owner_bins_text(spark, d):
    return pf.joined(pf.owner_bins(buildings(spark, d)), ["owner_name"], "bin")


@query
def high_neglect_owners(spark, d):
    return pf.high_neglect(_portfolio(spark, d, "exact")).select("owner_name", "total_class_c_violations", "total_ecb_balance_due")


# ---- risk ------------------------------------------------------------------------------------------------------


@query
def risk_by_bin(spark, d):
    parts = risk.violations_by_bin(dob(spark, d), ecb(spark, d), fx.relation(spark, d, "fx_hpd_violations"))
    return merge_measures(parts, ["bin"], risk.VIOLATION_SUMS)


@query
def risk_fire_or_join(spark, d):
    return risk.fires_by_bin(stored_buildings(spark, d), fire(spark, d))


def _near(spark, d, points, box, name):
    b = clean_buildings(spark, d)
    counted = sp.count_within(sp.distinct_spots(b), fx.relation(spark, d, points), box).withColumnRenamed("n", name)
    return risk.near_by_bbl(b, counted, {name: "sum"})


@query
def risk_ems_grid(spark, d):
    return _near(spark, d, "fx_ems_incidents", risk.EMS_BOX, "prior_ems_incidents")


@query
def risk_nypd_grid(spark, d):
    return _near(spark, d, "fx_nypd_complaints", risk.NYPD_BOX, "nearby_nypd_incidents")


@query
def risk_311_velocity(spark, d):
    return risk.velocity_by_bbl(clean_buildings(spark, d), fx.relation(spark, d, "fx_service_requests_311"), fx.AS_OF)


@query
def risk_inspection(spark, d):
    return inspections(spark, d).groupBy("bin").agg(F.bool_or("is_compliant").alias("last_fdny_inspection_pass"))


@query
def risk_elevator(spark, d):
    _, lifts = risk.equipment_by_bin(inspections(spark, d), elevators(spark, d))
    return merge_measures([lifts], ["bin"], {c: risk.EQUIPMENT_SUMS[c] for c in lifts.columns if c != "bin"})


@query
def nearest_hydrant(spark, d):
    b = clean_buildings(spark, d)
    near = risk.nearest_hydrants(sp.distinct_spots(b), fx.relation(spark, d, "fx_hydrants"))
    out = risk.near_by_bbl(b, near, {"nearest_hydrant_ft": "min"})
    return out.withColumn("nearest_hydrant_ft", F.round("nearest_hydrant_ft", 4))


@query
def nearest_hospital(spark, d):
    b = clean_buildings(spark, d)
    how = {"hospital": "min", "nearest_hospital_mi": "min"}
    spots = merge_measures(risk.nearest_hospitals(sp.distinct_spots(b), hospitals(spark, d)), ["qlat", "qlon"], how)
    out = risk.near_by_bbl(b, spots, how)
    return out.select("bbl", F.col("hospital.name").alias("nearest_hospital"), F.round("nearest_hospital_mi", 6).alias("nearest_hospital_mi"))


@query
def risk_composite(spark, d):
    scores = risk.with_bands(risk.risk_scores(risk_facts(spark, d), fx.AS_OF))
    return scores.withColumns({
        "nearest_hydrant_ft": F.round("nearest_hydrant_ft", 4), "nearest_hospital_mi": F.round("nearest_hospital_mi", 6),
    })


@query
def risk_bands(spark, d):
    return risk.band_counts(risk.risk_scores(risk_facts(spark, d), fx.AS_OF))


@query
def risk_pushed_to_buildings(spark, d):
    scores = risk.risk_scores(risk_facts(spark, d), fx.AS_OF)
    return risk.push_scores(buildings(spark, d), scores).select("bbl", "bin", "risk_score")


# ---- scalars and predicates ------------------------------------------------------------------------------------


@query
def filter_code_box_count(spark, d):
    coded = fx.relation(spark, d, "fx_coded")
    code = F.col("complaint_type") == 3
    box = sc.in_box("lat", "lon", 40.71, 40.725, -73.99, -73.96)
    return sc.count_matches(coded, {"by_code": code, "by_box": box, "by_both": code & box})


@query
def scored_topk(spark, d):
    coded = fx.relation(spark, d, "fx_coded")
    return sc.scored_top_k(coded, 200, "event_id", 2, 4, 40.7128, -73.98).select("event_id", "complaint_type", "borough", "score")


@query
def coded_dates(spark, d):
    rows = fx.relation(spark, d, "fx_date_texts")
    created, closed = s.epoch_seconds(F.col("created_text")), s.epoch_seconds(F.col("closed_text"))
    rows = rows.select("o_orderkey", created.alias("created"), closed.alias("closed"))
    days = s.resolution_days(F.col("created"), F.col("closed"))
    return rows.withColumn("resolution_days", F.round(days.cast("double"), 3))


@query
def code_maps(spark, d):
    rows = fx.relation(spark, d, "fx_names")
    place, kind = codes.borough_code(F.col("place")), codes.complaint_code(F.col("kind"))
    return rows.select(
        "c_custkey", place.cast("int").alias("borough_code"), codes.borough_label(place).alias("borough_label"),
        codes.canonical_borough(F.col("place")).alias("borough_name"), kind.cast("int").alias("complaint_code"),
        codes.complaint_label(kind).alias("complaint_label"),
    )


@query
def dob_severity(spark, d):
    return dob(spark, d).groupBy("violation_type", "severity").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"))


@query
def ecb_severity(spark, d):
    return ecb(spark, d).select("ecb_violation_number", "severity", "is_active")


@query
def planar_distances(spark, d):
    rows = fx.relation(spark, d, "fx_requests").where("latitude IS NOT NULL")
    here = (F.col("latitude"), F.col("longitude"), F.lit(40.72), F.lit(-73.98))
    return rows.select(
        "request_id", F.round(s.planar(*here, s.FEET), 3).alias("feet"), F.round(s.planar(*here, s.MILES), 6).alias("miles")
    )


@query
def identifiers_and_texts(spark, d):
    b = fx.relation(spark, d, "fx_buildings")
    dashed = F.concat(F.substring("bbl", 1, 1), F.lit("-"), F.substring("bbl", 2, 5), F.lit(" "), F.substring("bbl", 7, 4))
    return text_dates(b.select(
        "bbl", s.looks_like_bbl(dashed).alias("as_bbl"), s.looks_like_bbl(F.col("address")).alias("not_a_bbl"),
        s.stable_id(F.col("bbl"), F.col("address")).alias("hash_id"), s.truncated(F.col("address"), 8, "...").alias("short"),
        s.to_int(F.concat("num_floors", F.lit(".7"))).alias("rounded"), s.to_date(F.concat("year_built", F.lit("-02-03"))).alias("iso"),
        codes.severity_label(F.col("num_floors") % 7).alias("label"),
    ))


@query
def dedup_latest(spark, d):
    return fire(spark, d).select("incident_id", "event_id", "incident_datetime")


@query
def hospitals_from_facilities(spark, d):
    return hospitals(spark, d).select("facility_name", "facility_type", "latitude", "longitude")


# ---- conform jobs: the fixture rows under the headers of the published files, as text ----------------------------


def _as_source(df: DataFrame, **renames: str) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(renames.get(c, c)) for c in df.columns])


@query
def conform_buildings(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_buildings"), bbl="BBL", bin="BIN", owner_name="ownername",
                     year_built="yearbuilt", num_floors="numfloors", zipcode="ZIPCode")
    return cf.conform(raw, "pluto").drop("last_updated")


@query
def conform_dob_violations(spark, d):
    raw = fx.relation(spark, d, "fx_dob_violations").selectExpr(
        "bin AS BIN", "violation_type AS VIOLATION_TYPE", "description", "issue_date AS IssueDate",
        "CASE WHEN NOT is_active THEN 'done' END AS disposition_date")
    out = cf.conform(_as_source(raw), "dob_violations")
    return text_dates(out.groupBy("bin", "severity", "is_active").agg(F.count("*").alias("n"), F.max("issue_date").alias("latest")))


@query
def conform_dob_safety(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_dob_safety"), violation_description="description")
    return cf.conform(raw, "dob_safety_violations").groupBy("bin", "status", "violation_description").agg(F.count("*").alias("n"))


@query
def conform_ecb_violations(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_ecb_violations"))
    return text_dates(cf.conform(raw, "dob_ecb_violations").select(
        "ecb_violation_number", "bin", "penalty_imposed", "balance_due", "issue_date", "severity", "is_active"))


@query
def conform_hpd_violations(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_hpd_violations"), violation_id="ViolationID", violation_class="Class",
                     inspection_date="InspectionDate", current_status="CurrentStatus", nov_description="NOVDescription")
    out = cf.conform(raw, "hpd_violations")
    return text_dates(out.groupBy("bin", "violation_class", "current_status").agg(
        F.count("violation_id").alias("ids"), F.max("inspection_date").alias("latest")))


@query
def conform_hpd_complaints(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_hpd_complaints"), complaint_id="Problem ID", major_category="Major Category",
                     status="Complaint Status", received_date="Received Date")
    return text_dates(cf.conform(raw, "hpd_complaints").select("complaint_id", "bin", "status", "major_category", "received_date"))


@query
def conform_fire_incidents(spark, d):
    raw = fx.relation(spark, d, "fx_fire_raw").drop("bin", "event_id")
    raw = _as_source(raw, incident_id="STARFIRE_INCIDENT_ID", dispatch_response_seconds="DISPATCH_RESPONSE_SECONDS_QY",
                     engines_assigned="ENGINES_ASSIGNED_QUANTITY")
    return cf.conform(raw, "fire_incidents").select("incident_id", "incident_datetime", "dispatch_response_seconds", "bin")


@query
def conform_fire_company_incidents(spark, d):
    raw = fx.relation(spark, d, "fx_fire_raw").selectExpr(
        "event_id AS IM_INCIDENT_KEY", "incident_datetime AS INCIDENT_DATE_TIME", "dispatch_response_seconds AS TOTAL_INCIDENT_DURATION",
        "CASE engines_assigned WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS FIRE_ORIGIN_BELOW_GRADE", "incident_type_desc AS ACTION_TAKEN1_DESC")
    return cf.conform(_as_source(raw), "fire_company_incidents").select(
        "im_incident_key", "incident_date_time", "total_incident_duration", "fire_origin_below_grade", "action_taken_primary")


@query
def conform_ems_incidents(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_ems_incidents"), cad_incident_id="CAD_INCIDENT_ID",
                     initial_severity_level="INITIAL_SEVERITY_LEVEL_CODE", dispatch_response_seconds="DISPATCH_RESPONSE_SECONDS_QY")
    return cf.conform(raw, "ems_incidents").select(
        "cad_incident_id", "incident_datetime", "initial_call_type", "initial_severity_level", "dispatch_response_seconds", "latitude")


@query
def conform_service_requests_311(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_service_requests_311"), unique_key="Unique Key", created_date="Created Date",
                     complaint_type="Problem (formerly Complaint Type)", descriptor="Problem Detail (formerly Descriptor)",
                     incident_address="Incident Address")
    return cf.conform(raw, "311_requests").select(
        "unique_key", "created_date", "closed_date", "complaint_type", "descriptor", "incident_address", "bbl", "bin", "status")


@query
def conform_nypd_complaints(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_nypd_complaints"), complaint_number="CMPLNT_NUM", complaint_date="RPT_DT",
                     offense_description="OFNS_DESC", law_category="LAW_CAT_CD", premises_type="PREM_TYP_DESC", borough="BORO_NM")
    return text_dates(cf.conform(raw, "nypd_complaints").drop("police_precinct"))


@query
def conform_inspections(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_inspections"), result="LAST_INSP_STAT", inspection_date="LAST_VISIT_DT")
    out = cf.conform(raw, "fire_prevention_inspections")
    return text_dates(out.groupBy("bin", "is_compliant").agg(F.count("*").alias("n"), F.max("expiration_date").alias("latest")))


@query
def conform_elevators(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_elevators"), raw_status="DEVICE_STATUS", id="DEVICE_ID")
    return cf.conform(raw, "elevators").select("device_id", "bin", "device_type", "device_status", "status")


@query
def conform_hydrants(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_hydrants"), latitude="LATITUDE", longitude="Longitude")
    return cf.conform(raw, "fire_hydrants").select("unitid", "latitude", "longitude")


@query
def conform_facilities(spark, d):
    raw = fx.relation(spark, d, "fx_facilities").selectExpr(
        "uid", "facname", "factype", "facsubgrp", "borough AS boro", "uid AS addressnum", "'Main Street' AS streetname",
        "CASE WHEN facsubgrp = 'OTHER' THEN address END AS address", "latitude", "longitude")
    return cf.conform(_as_source(raw), "facilities").select("uid", "address", "borough", "latitude", "longitude")


@query
def conform_hospitals(spark, d):
    raw = _as_source(fx.relation(spark, d, "fx_facilities"), borough="boro")
    return cf.conform(raw, "hospitals").select("facility_name", "facility_type", "borough", "latitude", "longitude")


@query
def coded_incidents(spark, d):
    """A CSV file with blanks, quotes, commas and line breaks in its fields, written by Spark and loaded again."""
    rows = fx.query(spark, d, "SELECT n.c_custkey, n.kind, n.place, p.created_text, p.closed_text, q.latitude, q.longitude "
                              "FROM fx_names n JOIN fx_date_texts p ON n.c_custkey = p.o_orderkey JOIN fx_points q ON n.c_custkey = q.event_id")
    csv = rows.selectExpr("c_custkey AS `Unique Key`", "kind AS `Complaint Type`", "place AS BOROUGH", "created_text AS CREATED_DATE",
                          "closed_text AS `Closed Date`", "latitude AS Latitude", "longitude AS Longitude",
                          "concat('note, \"', c_custkey, '\"\\nsecond line') AS Note")
    path = f"{ensure_checkpoint_dir(spark)}/coded-{uuid.uuid4().hex}"
    csv.write.option("header", True).option("escape", '"').csv(path)
    coded = load_coded(spark, path, multi_line=True)
    return coded.groupBy("complaint_type", "borough").agg(
        F.count("*").alias("n"), F.sum("created_date").alias("created"), F.round(F.sum(F.col("resolution_days").cast("double")), 1).alias("days"),
        F.round(F.sum(F.col("lat").cast("double")), 2).alias("lat"))


@query
def source_filter(spark, d):
    rows = _as_source(fx.relation(spark, d, "fx_service_requests_311"))
    kept = cf.fetch_filter(rows, "311_requests")
    return kept.groupBy("complaint_type").agg(F.count("*").alias("n"))


@query
def global_counts(spark, d):
    facts = {"dob": dob(spark, d).where("is_active"), "ecb": ecb(spark, d).where("is_active"),
             "class_c": fx.relation(spark, d, "fx_hpd_violations").where("violation_class = 'C' AND current_status != 'CLOSE'"),
             "compliant": inspections(spark, d).where("is_compliant"), "out": elevators(spark, d).where("status != 'ACTIVE'")}
    return sinks.inventory(facts)


@query
def table_inventory(spark, d):
    return sinks.inventory({n: fx.relation(spark, d, n) for n in fx.RELATIONS})


@query
def schema_evolution(spark, d):
    b = fx.relation(spark, d, "fx_service_requests_311").drop("bbl")
    return cf.with_columns(b, "bbl string, unique_key string").select("unique_key", "bbl")


@query
def paged_buildings(spark, d):
    return page(fx.relation(spark, d, "fx_buildings"), ["bbl"], 50, 25).select("bbl", "address")


# ---- resolve, history, report ----------------------------------------------------------------------------------


def triage_buildings(spark, d):
    return stored_buildings(spark, d).withColumn("risk_score", F.expr("CAST(year_built % 50 AS DOUBLE) / 2D"))


@query
def resolve_building(spark, d):
    out = rs.resolve(fx.relation(spark, d, "fx_requests"), stored_buildings(spark, d), ["bbl", "bin", "address"])
    return out.select("request_id", "stage", "bbl", "bin", "address")


@query
def address_search(spark, d):
    return rs.search_address(buildings(spark, d), "1_ broad", "Queens", 10).select("bbl", "address", "borough")


@query
def address_search_many(spark, d):
    asked = fx.relation(spark, d, "fx_requests").selectExpr("request_id AS search_id", "address AS text", "CASE WHEN request_id % 2 = 0 THEN 'queens' END AS borough")
    return rs.search_many(asked, stored_buildings(spark, d), 10)


def history_tables(spark, d):
    rel = {n: fx.relation(spark, d, f"fx_{n}") for n in ("service_requests_311", "hpd_violations", "ems_incidents", "nypd_complaints")}
    return hs.Tables(rel["service_requests_311"], rel["hpd_violations"], dob(spark, d), fire(spark, d), rel["ems_incidents"], rel["nypd_complaints"])


@query
def history_totals(spark, d):
    """Per request, the entries of each source before the history cuts them to its limits."""
    req = fx.relation(spark, d, "fx_requests")
    resolved = rs.resolve(req, stored_buildings(spark, d), ["bbl", "bin", "address"])
    located = written(hs.locate(req, resolved), "located")
    return hs.full_counts(located, history_tables(spark, d))


@query
def incident_history(spark, d):
    req = fx.relation(spark, d, "fx_requests")
    resolved = rs.resolve(req, stored_buildings(spark, d), ["bbl", "bin", "address"])
    located = written(hs.locate(req, resolved), "located")
    return hs.history(located, history_tables(spark, d))


@query
def nearby_resources(spark, d):
    req = fx.relation(spark, d, "fx_requests").select("request_id", "latitude", "longitude")
    out = hs.nearby(req, hospitals(spark, d), fx.relation(spark, d, "fx_hydrants"), fx.relation(spark, d, "fx_facilities"))
    return out


def _report(spark, d):
    req = fx.relation(spark, d, "fx_requests")
    b = stored_buildings(spark, d)
    resolved = rs.resolve(req, b, ["bbl", "bin", "address", "owner_name"])
    located = written(rp.located_buildings(req, resolved), "located")
    portfolio = pf.owner_portfolio(b, dob(spark, d), fx.relation(spark, d, "fx_hpd_violations"), ecb(spark, d), "exact")
    tables = {
        "dob_violations": dob(spark, d), "dob_safety_violations": fx.relation(spark, d, "fx_dob_safety"), "ecb_violations": ecb(spark, d),
        "hpd_violations": fx.relation(spark, d, "fx_hpd_violations"), "hpd_complaints": fx.relation(spark, d, "fx_hpd_complaints"),
        "fire_inspections": inspections(spark, d), "elevators": elevators(spark, d),
        "service_requests_311": fx.relation(spark, d, "fx_service_requests_311"), "fire_incidents": fire(spark, d),
        "ems_incidents": fx.relation(spark, d, "fx_ems_incidents"), "nypd_complaints": fx.relation(spark, d, "fx_nypd_complaints"),
        "owner_portfolio": portfolio,
    }
    ties = {"service_requests_311": "unique_key", "fire_incidents": "incident_id", "ecb_violations": "ecb_violation_number"}
    return located, rp.sections(located, tables, ties)


@query
def building_report_counts(spark, d):
    located, parts = _report(spark, d)
    return rp.section_sizes(located, parts)


@query
def building_report_ecb(spark, d):
    _, parts = _report(spark, d)
    return text_dates(parts["ecb_violations"].select("request_id", "rn", "ecb_violation_number", "issue_date", "balance_due"))


# ---- text, triage, validation ----------------------------------------------------------------------------------


@query
def triage_rules(spark, d):
    return fx.base(spark, d, "documents").select("doc_id", rules.triage("text").alias("r")).select("doc_id", "r.*")


@query
def scenario_rules(spark, d):
    docs = fx.base(spark, d, "documents")
    return docs.select("doc_id", rules.scenario("text").alias("scenario"))


@query
def reply_parse(spark, d):
    rows = fx.relation(spark, d, "fx_replies")
    return rows.select("doc_id", rules.parse_reply("reply", "text").alias("r")).select("doc_id", "r.category", "r.severity", "r.agency", "r.confidence")


@query
def labelled_results(spark, d):
    rows = fx.base(spark, d, "documents").select("doc_id", rules.triage("text").alias("r")).selectExpr("doc_id", "r.severity", "r.agency")
    out = rules.label_results(rows)
    return out.groupBy("severity", "label", "agency", F.col("handles").isNotNull().alias("routed")).agg(F.count("*").alias("n"))


@query
def validate_results(spark, d):
    rows = fx.relation(spark, d, "fx_responses")
    given = rows.select("scenario_id", "severity", "agency", "summary", "confidence", "similar_count", "total_ms")
    out = ql.validate(given, rows.select("scenario_id", "expected_severity", "expected_agency"))
    return out.select("scenario_id", "status", F.array_join("issues", "; ").alias("issues"))


@query
def contract_checks(spark, d):
    good, bad = tr.check_requests(fx.base(spark, d, "documents").select("doc_id", "text"))
    return sinks.inventory({"valid": good, "rejected": bad})


@query
def latency_summary(spark, d):
    return ql.latency_summary(fx.relation(spark, d, "fx_responses"), ["event_type"], "latency_ms", "ok")


@query
def latency_overall(spark, d):
    return ql.latency_summary(fx.relation(spark, d, "fx_responses"), [], "latency_ms", "ok")


@query
def token_throughput(spark, d):
    return ql.throughput(fx.relation(spark, d, "fx_responses"), ["event_type"])


@query
def batch_triage(spark, d):
    req = fx.relation(spark, d, "fx_requests")
    return tr.batch_triage(req, triage_buildings(spark, d), history_tables(spark, d))["result"].select(
        "request_id", "stage", "bbl", "category", "severity", "agency", "summary", "context", "prompt")


# ---- corpus and retrieval --------------------------------------------------------------------------------------


def corpus_rows(spark, d, since=None):
    rel = {n: fx.relation(spark, d, f"fx_{n}") for n in ("service_requests_311", "nypd_complaints")}
    return cp.incidents(rel["service_requests_311"], fire(spark, d), rel["nypd_complaints"], since)


@query
def corpus_docs(spark, d):
    return cp.documents(corpus_rows(spark, d))


@query
def corpus_sources(spark, d):
    return cp.documents(corpus_rows(spark, d)).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query
def structured_search(spark, d):
    return cp.structured_search(corpus_rows(spark, d), "queens", "heat", 25)


@query
def resolution_stats(spark, d):
    return cp.resolution_stats(corpus_rows(spark, d), ["source", "complaint_type"])


@query
def resolution_stats_overall(spark, d):
    return cp.resolution_stats(corpus_rows(spark, d), None, "queens", "noise")


@query
def vector_topn(spark, d):
    emb = fx.base(spark, d, "embeddings").selectExpr("vec_id", "embedding AS vector")
    hits = cosine_top_n(emb.withColumnRenamed("vec_id", "query_id"), emb.withColumnRenamed("vec_id", "corpus_id"), 5)
    return hits.selectExpr("query_id", "corpus_id", "rn", "round(cosine, 5) AS similarity")


@query
def vector_topn_filtered(spark, d):
    emb = fx.base(spark, d, "embeddings").selectExpr("vec_id", "embedding AS vector", "label")
    hits = cosine_top_n(emb.withColumnRenamed("vec_id", "query_id"), emb.withColumnRenamed("vec_id", "corpus_id"), 5, "label", skip_self=True)
    return hits.selectExpr("query_id", "corpus_id", "rn", "round(cosine, 5) AS similarity")


@query
def embedded_corpus(spark, d):
    """Documents with their vectors (hashed words); the vector values have no SQL form."""
    docs = sinks.encode_documents(cp.documents(corpus_rows(spark, d)), cp.bag_of_words())
    return docs.selectExpr("doc_id", "source", "size(embedding) AS dimensions", "round(aggregate(embedding, 0D, (a, x) -> a + x * x), 4) AS norm")


@query
def similar_incidents(spark, d):
    """For each request text its five most similar corpus documents, inside the borough where one is given."""
    docs = sinks.encode_documents(cp.documents(corpus_rows(spark, d)), cp.bag_of_words())
    asked = fx.relation(spark, d, "fx_requests").selectExpr(
        "request_id AS query_id", "text AS document", "CASE WHEN request_id % 3 = 0 THEN 'Queens' WHEN request_id % 3 = 1 THEN 'All' END AS borough")
    asked = sinks.encode_documents(asked, cp.bag_of_words())
    return cp.retrieve_similar(written(asked, "asked"), written(docs, "corpus"), 5).select("query_id", "rn", "doc_id", "similarity")


@query
def search_contexts(spark, d):
    rows = fx.relation(spark, d, "fx_replies").selectExpr(
        "doc_id", "text", "reply",
        "transform(sequence(0, CAST(doc_id % 5 AS INT)), i -> struct('Kind ' || CAST(i AS STRING) AS complaint_type, "
        "CASE WHEN i = 1 THEN CAST(NULL AS STRING) ELSE 'QUEENS' END AS borough, CASE WHEN i = 2 THEN '' ELSE '2024-01-0' || CAST(i + 1 AS STRING) END AS date, "
        "i - 1 AS resolution_days, 'SR311' AS source)) AS similar", "doc_id * 1000 AS total", "CAST(doc_id % 8 AS DOUBLE) + 0.25D AS average")
    rows = rows.withColumn("average", F.expr("average + 0.05D"))
    return rows.select("doc_id", prompts.search_context("text", "reply", "similar", "total", "average").alias("context"))


@query
def search_prompts(spark, d):
    rows = fx.relation(spark, d, "fx_replies")
    return rows.select("doc_id", prompts.prompt("reply", "reply", "text", prompts.SEARCH_PARTS).alias("prompt"))


# ---- streaming -------------------------------------------------------------------------------------------------


@query
def streamed_triage(spark, d):
    """All documents as a stream of reports: duplicates dropped, rules applied, written per micro-batch."""
    return st.triage_once(spark, f"{d}/documents*.parquet", "doc_id BIGINT, text STRING").select("doc_id", "category", "severity")


@query
def streamed_enrichment(spark, d):
    """Requests as a stream with resends, one part of them a micro-batch: resends within an hour of event time are
    dropped, rules applied, and each batch enriched from the persisted lookup (bbl, bin, exact address; nearest
    hospital of the building), which is built once before the stream starts.

    Parts follow one another in event time, and all files of a part are one micro-batch, so that no report is late
    however many files a part has or however long the table spans."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    reqs = fx.relation(spark, d, "fx_requests").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("request_id")))
    schema = "request_id BIGINT, bbl STRING, bin STRING, address STRING, latitude DOUBLE, longitude DOUBLE, text STRING, ts TIMESTAMP"
    reqs = reqs.selectExpr("CAST(request_id AS BIGINT) AS request_id", "bbl", "bin", "address", "latitude", "longitude", "text", "ts")
    ends = reqs.agg(F.min("request_id").alias("low"), F.max("request_id").alias("high")).first()  # one row
    part = F.floor((F.col("request_id") - F.lit(ends["low"])) * 3 / F.lit((ends["high"] or 0) - (ends["low"] or 0) + 1))
    # sent again ten minutes later: within the watermark, so dropped
    again = reqs.where("request_id % 7 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    parts = {**{k: reqs.where(part == k) for k in range(3)}, 9: again}
    facts = lk.Lookup(spark, f"{root}/lookup")
    facts.refresh(clean_buildings(spark, d), nearest_hospital(spark, d))
    stream = st.without_resends(st.read_reports(spark, f"{root}/in/*", schema), "request_id", "ts", "1 hour")
    for k, rows in parts.items():
        rows.write.parquet(f"{root}/in/part={k}")
        run = st.start(stream, lk.enrich(facts), f"{root}/out", f"{root}/state", once=True)
        run.awaitTermination()
        if run.exception() is not None:
            raise run.exception()
    return spark.read.parquet(f"{root}/out/result").drop("batch_id")
