"""Test relations derived from the driver's tables.

Each entry is the body of one SELECT that both Spark SQL and DuckDB accept unchanged, so the same text feeds the
queries and their check. Every relation covers the whole of its source tables.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations"]

AS_OF = "2024-02-10"

_STREET = """CASE {k} % 7 WHEN 0 THEN 'Atlantic Avenue' WHEN 1 THEN 'Broadway' WHEN 2 THEN 'Canal Street'
            WHEN 3 THEN 'Dean Street' WHEN 4 THEN 'East 4 Street' WHEN 5 THEN 'Fulton Street' ELSE 'Grand Concourse' END"""
_BIN = "CAST(2000000 + {k} - {k} % 3 AS VARCHAR(20))"
_BBL = "CAST(1000000000 + {k} AS VARCHAR(20))"

RELATIONS: dict[str, str] = {
    "fx_buildings": f"""
        SELECT {_BBL.format(k='c_custkey')} AS bbl,
               CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN '0'
                    ELSE {_BIN.format(k='c_custkey')} END AS bin,
               CASE n_regionkey WHEN 0 THEN 'MANHATTAN' WHEN 1 THEN 'BROOKLYN' WHEN 2 THEN 'QUEENS'
                    WHEN 3 THEN 'BRONX' ELSE 'STATEN ISLAND' END AS borough,
               CAST(c_custkey % 311 + 1 AS VARCHAR(20)) || ' ' || {_STREET.format(k='c_custkey')} AS address,
               CAST(10001 + c_custkey % 89 AS VARCHAR(20)) AS zipcode,
               CASE WHEN c_custkey % 37 = 0 THEN NULL
                    ELSE 'OWNER ' || CAST(c_custkey % 97 AS VARCHAR(20)) END AS owner_name,
               CAST(1900 + c_custkey % 120 AS INT) AS year_built,
               CAST(1 + c_custkey % 40 AS INT) AS num_floors,
               CASE WHEN c_custkey % 101 = 0 THEN NULL
                    ELSE 40.7e0 + CAST((c_custkey * 7919) % 4000 AS DOUBLE) / 100000e0 END AS latitude,
               CASE WHEN c_custkey % 101 = 0 THEN NULL
                    ELSE -74.0e0 + CAST((c_custkey * 104729) % 5000 AS DOUBLE) / 100000e0 END AS longitude
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fx_dob_violations": f"""
        SELECT l_orderkey * 8 + l_linenumber AS id, {_BIN.format(k='o_custkey')} AS bin,
               CASE l_partkey % 6 WHEN 0 THEN 'LL6291' WHEN 1 THEN 'ACC1' WHEN 2 THEN 'UB'
                    WHEN 3 THEN 'P*CLSS1' WHEN 4 THEN 'COMPBLD' ELSE 'OTHER' END AS violation_type,
               'item ' || CAST(l_partkey AS VARCHAR(20)) AS description,
               CAST(l_shipdate AS DATE) AS issue_date, l_linestatus = 'O' AS is_active
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_dob_safety": f"""
        SELECT o_orderkey AS id, {_BIN.format(k='o_custkey')} AS bin, 'SAFETY' AS violation_type,
               o_orderpriority AS violation_description, CAST(o_orderdate AS DATE) AS issue_date,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status
        FROM orders""",
    "fx_hpd_violations": f"""
        SELECT CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_orderkey * 8 + l_linenumber END AS violation_id,
               {_BIN.format(k='o_custkey')} AS bin, {_BBL.format(k='o_custkey')} AS bbl,
               CASE l_returnflag WHEN 'R' THEN 'C' WHEN 'A' THEN 'B' ELSE 'A' END AS violation_class,
               CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'CLOSE' ELSE 'OPEN' END AS current_status,
               'notice ' || CAST(l_suppkey AS VARCHAR(20)) AS nov_description,
               CAST(l_shipdate AS DATE) AS inspection_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_hpd_complaints": f"""
        SELECT o_orderkey AS complaint_id,
               CASE WHEN o_orderkey % 3 = 0 THEN {_BIN.format(k='(o_custkey + 3)')} ELSE {_BIN.format(k='o_custkey')} END AS bin,
               {_BBL.format(k='o_custkey')} AS bbl, o_orderpriority AS major_category,
               o_orderstatus AS status, CAST(o_orderdate AS DATE) AS received_date
        FROM orders""",
    "fx_registrations": f"""
        SELECT s_suppkey AS registrationid, 'CONTACT ' || CAST(s_nationkey AS VARCHAR(20)) AS contactdescription,
               CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE {_BIN.format(k='s_suppkey')} END AS bin,
               {_BBL.format(k='s_suppkey')} AS bbl
        FROM supplier""",
    "fx_registration_contacts": """
        SELECT c_custkey AS registrationid,
               CASE WHEN c_custkey % 4 = 0 THEN 'CONTACT ' || CAST(c_nationkey + 20 AS VARCHAR(20)) END AS corporationname,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'FIRST' || CAST(c_custkey % 50 AS VARCHAR(20)) END AS firstname,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS lastname,
               CASE c_custkey % 4 WHEN 0 THEN 'CorporateOwner' WHEN 1 THEN 'HeadOfficer'
                    WHEN 2 THEN 'IndividualOwner' ELSE 'Agent' END AS contacttype
        FROM customer""",
    "fx_ecb_violations": f"""
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS ecb_violation_number, {_BIN.format(k='o_custkey')} AS bin,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_totalprice / 20e0 END AS penalty_imposed,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 0e0
                    ELSE o_totalprice / 100e0 END AS balance_due,
               CAST(o_orderdate AS DATE) AS issue_date
        FROM orders""",
    "fx_inspections": f"""
        SELECT {_BIN.format(k='o_custkey')} AS bin, o_orderkey AS id, CAST(o_orderdate AS DATE) AS inspection_date,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'APPROVAL' WHEN '2-HIGH' THEN ' approval '
                    WHEN '3-MEDIUM' THEN 'NOV(HOLD)' WHEN '4-NOT SPECIFIED' THEN NULL
                    ELSE 'NOT APPROVAL(VIO)' END AS result
        FROM orders""",
    "fx_elevators": f"""
        SELECT p_partkey AS id, {_BIN.format(k='p_partkey')} AS bin, p_type AS device_type,
               CASE WHEN p_size % 9 = 0 THEN NULL WHEN p_size % 4 = 0 THEN 'Active'
                    WHEN p_size % 4 = 1 THEN 'OUT' ELSE 'ACTIVE' END AS raw_status
        FROM part""",
    "fx_points": """
        SELECT event_id, ts, user_id, event_type, value,
               CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 0e0
                    ELSE 40.700003e0 + CAST((event_id * 6151) % 4000 AS DOUBLE) / 100000e0 END AS latitude,
               CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 0e0
                    ELSE -73.999997e0 + CAST((event_id * 3571) % 5000 AS DOUBLE) / 100000e0 END AS longitude
        FROM events""",
    "fx_fire_raw": f"""
        SELECT event_id, CAST(event_id % 1000 AS VARCHAR(20)) AS incident_id, ts AS incident_datetime,
               CASE event_id % 3 WHEN 0 THEN 'STRUCTURAL FIRE' WHEN 1 THEN 'SMOKE' ELSE 'ALARM' END AS incident_type_desc,
               'CLASS ' || CAST(event_id % 5 AS VARCHAR(20)) AS incident_classification,
               CASE event_id % 3 WHEN 0 THEN 'BROOKLYN' ELSE 'QUEENS' END AS incident_borough,
               CAST(floor(value) AS INT) AS dispatch_response_seconds, CAST(event_id % 4 AS INT) AS engines_assigned,
               CASE WHEN event_id % 4 = 0 THEN {_BIN.format(k='user_id')} END AS bin, latitude, longitude
        FROM fx_points WHERE event_type = 'error'""",
    "fx_ems_incidents": """
        SELECT CAST(event_id AS VARCHAR(20)) AS cad_incident_id, ts AS incident_datetime,
               CASE event_id % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'INJURY' ELSE 'SICK' END AS initial_call_type,
               CAST(event_id % 8 + 1 AS VARCHAR(20)) AS initial_severity_level,
               CAST(floor(value) AS INT) AS dispatch_response_seconds, latitude, longitude
        FROM fx_points WHERE event_type = 'view'""",
    "fx_nypd_complaints": """
        SELECT CAST(event_id AS VARCHAR(20)) AS complaint_number, CAST(ts AS DATE) AS complaint_date,
               CASE event_id % 3 WHEN 0 THEN 'PETIT LARCENY' WHEN 1 THEN 'ASSAULT 3' ELSE 'HARASSMENT' END AS offense_description,
               CASE event_id % 2 WHEN 0 THEN 'MISDEMEANOR' ELSE 'FELONY' END AS law_category,
               CASE event_id % 5 WHEN 0 THEN 'BRONX' WHEN 1 THEN 'None' ELSE 'MANHATTAN' END AS borough,
               'STREET' AS premises_type, latitude, longitude
        FROM fx_points WHERE event_type = 'click'""",
    "fx_service_requests_311": f"""
        SELECT CAST(event_id AS VARCHAR(20)) AS unique_key, ts AS created_date,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts + INTERVAL '1' HOUR * CAST(floor(value) AS INT) END AS closed_date,
               CASE event_id % 2 WHEN 0 THEN 'HPD' ELSE 'DEP' END AS agency,
               CASE event_id % 4 WHEN 0 THEN 'HEATING' WHEN 1 THEN 'Noise - Residential' WHEN 2 THEN 'PLUMBING'
                    ELSE NULL END AS complaint_type,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'detail ' || CAST(event_id % 13 AS VARCHAR(20)) END AS descriptor,
               CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'UNKNOWN' ELSE 'QUEENS' END AS borough,
               UPPER(CAST(user_id % 311 + 1 AS VARCHAR(20)) || ' ' || {_STREET.format(k='user_id')}) AS incident_address,
               CASE WHEN user_id % 3 = 0 THEN NULL ELSE {_BBL.format(k='user_id')} END AS bbl,
               CASE WHEN event_id % 6 = 0 THEN 'Open' ELSE 'Closed' END AS status
        FROM fx_points WHERE event_type IN ('purchase', 'signup')""",
    "fx_hydrants": """
        SELECT p_partkey AS id, 'H' || CAST(p_partkey AS VARCHAR(20)) AS unitid,
               40.7e0 + CAST((p_partkey * 9973) % 4000 AS DOUBLE) / 100000e0 AS latitude,
               -74.0e0 + CAST((p_partkey * 7877) % 5000 AS DOUBLE) / 100000e0 AS longitude
        FROM part""",
    "fx_facilities": """
        SELECT CAST(s_suppkey AS VARCHAR(20)) AS uid, s_name AS facname,
               CASE s_suppkey % 5 WHEN 0 THEN 'Acute Care Hospital' WHEN 1 THEN 'Firehouse' WHEN 2 THEN 'School'
                    WHEN 3 THEN NULL ELSE 'Park' END AS factype,
               CASE s_suppkey % 5 WHEN 3 THEN 'MENTAL HEALTH' ELSE 'OTHER' END AS facsubgrp,
               'BRONX' AS borough, CAST(s_suppkey AS VARCHAR(20)) || ' Main Street' AS address,
               40.7e0 + CAST((s_suppkey * 7331) % 4000 AS DOUBLE) / 100000e0 AS latitude,
               CASE WHEN s_suppkey % 17 = 0 THEN 0e0
                    ELSE -74.0e0 + CAST((s_suppkey * 5557) % 5000 AS DOUBLE) / 100000e0 END AS longitude
        FROM supplier""",
    "fx_requests": f"""
        SELECT c_custkey AS request_id,
               CASE WHEN c_custkey % 5 = 0 THEN {_BBL.format(k='c_custkey')} END AS bbl,
               CASE WHEN c_custkey % 5 = 1 THEN {_BIN.format(k='c_custkey')} END AS bin,
               CASE WHEN c_custkey % 5 = 2 THEN CAST(c_custkey % 311 + 1 AS VARCHAR(20)) || ' broadway'
                    WHEN c_custkey % 15 = 8 THEN CAST(c_custkey % 29 AS VARCHAR(20)) || ' _ast% street'
                    WHEN c_custkey % 5 = 3 THEN 'no such place' END AS address,
               CASE WHEN c_custkey % 5 >= 3
                    THEN 40.700001e0 + CAST((c_custkey * 7919) % 4000 AS DOUBLE) / 100000e0 END AS latitude,
               CASE WHEN c_custkey % 5 >= 3
                    THEN -73.999999e0 + CAST((c_custkey * 104729) % 5000 AS DOUBLE) / 100000e0 END AS longitude,
               CASE c_custkey % 6 WHEN 0 THEN 'Smoke and flames on floor ' WHEN 1 THEN 'Man collapsed, not breathing, unit '
                    WHEN 2 THEN 'Gas smell near door ' WHEN 3 THEN 'Loud party at ' WHEN 4 THEN 'Pipe burst in room '
                    ELSE 'Something odd at ' END || CAST(c_custkey AS VARCHAR(20)) AS text
        FROM customer""",
    "fx_coded": """
        SELECT event_id, CAST(event_id % 21 AS INT) AS complaint_type, CAST(event_id % 6 AS INT) AS borough,
               CAST(COALESCE(latitude, 0e0) AS FLOAT) AS lat, CAST(COALESCE(longitude, 0e0) AS FLOAT) AS lon
        FROM fx_points""",
    "fx_names": """
        SELECT c_custkey,
               CASE c_custkey % 11 WHEN 0 THEN ' Manhattan ' WHEN 1 THEN 'NEW YORK' WHEN 2 THEN '"kings"' WHEN 3 THEN 'Queens'
                    WHEN 4 THEN 'bronx' WHEN 5 THEN 'Richmond' WHEN 6 THEN '5' WHEN 7 THEN NULL WHEN 8 THEN ''
                    WHEN 9 THEN 'nan' ELSE c_mktsegment END AS place,
               CASE c_custkey % 13 WHEN 0 THEN 'Noise - Commercial' WHEN 1 THEN ' heating ' WHEN 2 THEN 'Structure Fire'
                    WHEN 3 THEN 'WATER SYSTEM' WHEN 4 THEN 'Sewer Problems' WHEN 5 THEN 'medical call' WHEN 6 THEN 'Assault 3'
                    WHEN 7 THEN 'Noise - Helicopter' WHEN 8 THEN NULL WHEN 9 THEN 'APPLIANCE' WHEN 10 THEN '"Rodent"'
                    ELSE c_mktsegment END AS kind
        FROM customer""",
    "fx_date_texts": """
        SELECT o_orderkey, o_orderkey % 40 AS gap, y, mo, dd, h,
               CASE o_orderkey % 8
                    WHEN 0 THEN mo || '/' || dd || '/' || y || ' ' || h || ':05:09 PM'
                    WHEN 1 THEN '0' || CAST(o_orderkey % 9 + 1 AS VARCHAR(20)) || '/' || dd || '/' || y || ' 1' || CAST(o_orderkey % 10 AS VARCHAR(20)) || ':05:09'
                    WHEN 2 THEN y || '-11-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR(20)) || 'T08:09:10.000'
                    WHEN 3 THEN ' ' || mo || '/' || dd || '/' || y || ' '
                    WHEN 4 THEN 'unknown' WHEN 5 THEN '' WHEN 6 THEN NULL
                    ELSE '"' || mo || '/' || dd || '/' || y || ' ' || h || ':59:00 AM"' END AS created_text,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '12/31/' || y || ' 23:59:59' END AS closed_text
        FROM (SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS VARCHAR(20)) AS y,
                     CAST(EXTRACT(MONTH FROM o_orderdate) AS VARCHAR(20)) AS mo,
                     CAST(EXTRACT(DAY FROM o_orderdate) AS VARCHAR(20)) AS dd,
                     CAST(o_orderkey % 12 + 1 AS VARCHAR(20)) AS h FROM orders) t""",
    "fx_replies": """
        SELECT doc_id, text,
               CASE doc_id % 7
                    WHEN 0 THEN '{"category": "Kind ' || lang || '", "severity": 3, "agency": "EMS", "send": "unit", "summary": "from ' || source || '", "confidence": 0.75}'
                    WHEN 1 THEN '```json' || chr(10) || '{"category": "Fenced ' || source || '", "severity": 2, "agency": "FDNY", "send": "unit", "summary": "s", "confidence": 0.5}' || chr(10) || '```'
                    WHEN 2 THEN 'Sure, here it is: {"category": "Inside ' || lang || '", "severity": 5, "agency": "NYPD", "send": "unit", "summary": "t", "confidence": 0.25} Bye.'
                    WHEN 3 THEN '{"category": "Broken ' || lang || '", "severity": '
                    WHEN 4 THEN NULL WHEN 5 THEN 'no braces at all'
                    ELSE '' END AS reply
        FROM documents""",
    "fx_responses": """
        SELECT event_id AS scenario_id, CAST(event_id % 7 AS INT) AS severity,
               CASE event_id % 5 WHEN 0 THEN 'NYPD' WHEN 1 THEN 'FDNY' WHEN 2 THEN 'Police' WHEN 3 THEN NULL ELSE 'Multi' END AS agency,
               CASE WHEN event_id % 3 = 0 THEN 'short' ELSE 'a long enough summary of event ' || CAST(event_id AS VARCHAR(20)) END AS summary,
               CAST(event_id % 4 AS DOUBLE) / 4e0 AS confidence, CAST(event_id % 6 AS INT) AS similar_count,
               CAST(floor(value) AS INT) * 30 AS total_ms,
               CAST(event_id % 4 + 1 AS INT) AS expected_severity,
               CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'NYPD' ELSE 'FDNY' END AS expected_agency,
               event_type, value AS latency_ms, event_id % 10 != 0 AS ok
        FROM events""",
}


def with_fixtures(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a statement with the fixture relations it needs, as common table expressions, in dependency order."""
    extra = extra or {}
    bodies = {**RELATIONS, **extra}
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in bodies:
            if name not in done and re.search(rf"\b{name}\b", text):
                if bodies[name] is text:
                    continue
                visit(bodies[name])
                done[name] = bodies[name]

    visit(sql)
    if not done:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in done.items()) + "\n" + sql


@cache
def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the driver. Cached, as every ``read.parquet`` lists the files and reads a footer again."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture relation over the tables in ``sf_dir``."""
    return query(spark, sf_dir, f"SELECT * FROM {name}")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a statement over the fixture relations and the driver's tables."""
    text = with_fixtures(sql)
    for name in BASE_TABLES:
        if re.search(rf"\b{name}\b", text):
            base(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)
