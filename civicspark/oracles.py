"""The same questions as plain SQL for the check. Theta joins, OR joins and cross joins are written out literally."""

from __future__ import annotations

from .fixtures import AS_OF, RELATIONS, with_fixtures

# Prepared inputs shared by several statements.
PREPARED: dict[str, str] = {
    "px_clean": """SELECT * REPLACE (CASE WHEN bin IS NULL OR TRIM(bin) IN ('', '0') THEN NULL ELSE bin END AS bin) FROM fx_buildings""",
    "px_pairs": """
        SELECT bbl, bin, 1 AS pri, COUNT(*) AS cnt FROM fx_hpd_violations
        WHERE bbl IS NOT NULL AND bin IS NOT NULL AND bbl NOT IN ('', '0') AND bin NOT IN ('', '0') GROUP BY 1, 2
        UNION ALL
        SELECT bbl, bin, 2, COUNT(*) FROM fx_hpd_complaints
        WHERE bbl IS NOT NULL AND bin IS NOT NULL AND bbl NOT IN ('', '0') AND bin NOT IN ('', '0') GROUP BY 1, 2
        UNION ALL
        SELECT bbl, bin, 3, COUNT(*) FROM fx_registrations
        WHERE bbl IS NOT NULL AND bin IS NOT NULL AND bbl NOT IN ('', '0') AND bin NOT IN ('', '0') GROUP BY 1, 2""",
    "px_xwalk": """
        SELECT bbl, bin FROM (SELECT bbl, bin, ROW_NUMBER() OVER (PARTITION BY bbl ORDER BY pri, cnt DESC, bin) AS rn
                              FROM px_pairs) WHERE rn = 1""",
    "px_buildings": """
        SELECT b.* REPLACE (CASE WHEN b.bin IS NULL OR b.bin IN ('', '0') THEN COALESCE(x.bin, b.bin) ELSE b.bin END AS bin)
        FROM px_clean b LEFT JOIN px_xwalk x ON b.bbl = x.bbl""",
    "px_ecb": """SELECT *, COALESCE(balance_due > 0, FALSE) AS is_active FROM fx_ecb_violations""",
    "px_fire": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY incident_id
               ORDER BY incident_datetime DESC NULLS LAST, event_id) AS rn FROM fx_fire_raw) WHERE rn = 1""",
    "px_hospitals": """
        SELECT facname AS facility_name, COALESCE(factype, facsubgrp) AS facility_type, borough, address, latitude, longitude
        FROM fx_facilities
        WHERE (UPPER(COALESCE(facsubgrp, '')) LIKE '%HOSPITAL%' OR UPPER(COALESCE(factype, '')) LIKE '%HOSPITAL%'
               OR UPPER(COALESCE(facsubgrp, '')) LIKE '%HEALTH%')
          AND latitude IS NOT NULL AND latitude != 0 AND longitude IS NOT NULL AND longitude != 0""",
    "px_inspections": """
        SELECT *, COALESCE(UPPER(TRIM(result)) = 'APPROVAL', FALSE) AS is_compliant FROM fx_inspections""",
    "px_elevators": "SELECT *, COALESCE(raw_status, 'UNKNOWN') AS status FROM fx_elevators",
    "px_portfolio": """
        SELECT b.owner_name, COUNT(DISTINCT b.bbl) AS total_buildings,
               (SELECT COUNT(DISTINCT v.id) FROM px_buildings i JOIN fx_dob_violations v ON i.bin = v.bin
                WHERE i.owner_name = b.owner_name AND v.is_active) AS total_open_violations,
               (SELECT COUNT(DISTINCT v.violation_id) FROM px_buildings i JOIN fx_hpd_violations v ON i.bin = v.bin
                WHERE i.owner_name = b.owner_name AND v.violation_class = 'C' AND v.current_status != 'CLOSE') AS total_class_c_violations
        FROM px_buildings b WHERE b.owner_name IS NOT NULL GROUP BY b.owner_name""",
    "px_fires_by_bin": """
        SELECT b.bin, COUNT(*) AS prior_fire_incidents FROM px_buildings b JOIN px_fire f
          ON (b.bin = f.bin AND f.bin IS NOT NULL)
          OR (f.bin IS NULL AND f.latitude IS NOT NULL AND ABS(b.latitude - f.latitude) < 0.0005e0
              AND ABS(b.longitude - f.longitude) < 0.0005e0)
        WHERE b.bin IS NOT NULL GROUP BY b.bin""",
    "px_ems": """
        SELECT b.bbl, COUNT(*) AS prior_ems_incidents FROM px_clean b JOIN fx_ems_incidents e
          ON ABS(b.latitude - e.latitude) < 0.0005e0 AND ABS(b.longitude - e.longitude) < 0.0005e0 GROUP BY b.bbl""",
    "px_nypd": """
        SELECT b.bbl, COUNT(*) AS nearby_nypd_incidents FROM px_clean b JOIN fx_nypd_complaints e
          ON ABS(b.latitude - e.latitude) < 0.0010e0 AND ABS(b.longitude - e.longitude) < 0.0010e0 GROUP BY b.bbl""",
    "px_velocity": f"""
        SELECT b.bbl, NULLIF(COUNT(*) FILTER (WHERE r.created_date >= DATE '{AS_OF}' - INTERVAL 30 DAY), 0) AS complaint_velocity_30d,
               COUNT(*) AS complaint_velocity_90d
        FROM px_clean b JOIN fx_service_requests_311 r ON LOWER(b.address) = LOWER(r.incident_address)
        WHERE r.created_date >= DATE '{AS_OF}' - INTERVAL 90 DAY GROUP BY b.bbl""",
    "px_hydrant": """
        SELECT b.bbl, ROUND(MIN(SQRT(POW((b.latitude - h.latitude) * 364000, 2) + POW((b.longitude - h.longitude) * 288200, 2))), 4)
               AS nearest_hydrant_ft
        FROM px_clean b, fx_hydrants h
        WHERE ABS(b.latitude - h.latitude) < 0.005e0 AND ABS(b.longitude - h.longitude) < 0.005e0 GROUP BY b.bbl""",
    "px_hospital": """
        SELECT bbl, (MIN(CASE WHEN name IS NOT NULL THEN {'d': d, 'name': name} END)).name AS nearest_hospital,
               ROUND(MIN(d), 6) AS nearest_hospital_mi
        FROM (SELECT b.bbl, h.facility_name AS name,
                     SQRT(POW((b.latitude - h.latitude) * 69.0e0, 2) + POW((b.longitude - h.longitude) * 54.6e0, 2)) AS d
              FROM px_clean b, px_hospitals h)
        WHERE d IS NOT NULL GROUP BY bbl""",
    "px_by_bin": """
        SELECT k.bin, d.n AS active_dob_violations, e.n AS active_ecb_violations, c.n AS active_hpd_class_c, b.n AS active_hpd_class_b
        FROM (SELECT bin FROM fx_dob_violations WHERE is_active UNION SELECT bin FROM px_ecb WHERE is_active
              UNION SELECT bin FROM fx_hpd_violations WHERE violation_class IN ('B', 'C') AND current_status != 'CLOSE') k
        LEFT JOIN (SELECT bin, COUNT(*) AS n FROM fx_dob_violations WHERE is_active GROUP BY bin) d ON k.bin = d.bin
        LEFT JOIN (SELECT bin, COUNT(*) AS n FROM px_ecb WHERE is_active GROUP BY bin) e ON k.bin = e.bin
        LEFT JOIN (SELECT bin, COUNT(*) AS n FROM fx_hpd_violations WHERE violation_class = 'C' AND current_status != 'CLOSE' GROUP BY bin) c ON k.bin = c.bin
        LEFT JOIN (SELECT bin, COUNT(*) AS n FROM fx_hpd_violations WHERE violation_class = 'B' AND current_status != 'CLOSE' GROUP BY bin) b ON k.bin = b.bin""",
    "px_inspected": "SELECT bin, BOOL_OR(is_compliant) AS last_fdny_inspection_pass FROM px_inspections GROUP BY bin",
    "px_lifts": """SELECT bin, COUNT(*) AS elevator_count, COUNT(*) FILTER (WHERE status != 'ACTIVE') AS elevator_out_of_service
        FROM px_elevators GROUP BY bin""",
    "px_components": """
        SELECT b.bbl, b.bin, v.active_dob_violations, v.active_ecb_violations, v.active_hpd_class_c, v.active_hpd_class_b,
               f.prior_fire_incidents, e.prior_ems_incidents, n.nearby_nypd_incidents, r.complaint_velocity_30d,
               r.complaint_velocity_90d, i.last_fdny_inspection_pass, l.elevator_count, l.elevator_out_of_service,
               h.nearest_hydrant_ft, o.nearest_hospital, o.nearest_hospital_mi
        FROM px_buildings b LEFT JOIN px_by_bin v ON b.bin = v.bin LEFT JOIN px_fires_by_bin f ON b.bin = f.bin
        LEFT JOIN px_ems e ON b.bbl = e.bbl LEFT JOIN px_nypd n ON b.bbl = n.bbl LEFT JOIN px_velocity r ON b.bbl = r.bbl
        LEFT JOIN px_inspected i ON b.bin = i.bin LEFT JOIN px_lifts l ON b.bin = l.bin
        LEFT JOIN px_hydrant h ON b.bbl = h.bbl LEFT JOIN px_hospital o ON b.bbl = o.bbl""",
    "px_scores": """
        SELECT *, COALESCE(active_hpd_class_c, 0) * 6.0e0 + COALESCE(prior_fire_incidents, 0) * 4.0e0
               + COALESCE(active_ecb_violations, 0) * 3.0e0 + COALESCE(active_dob_violations, 0) * 2.5e0
               + COALESCE(active_hpd_class_b, 0) * 2.0e0 + COALESCE(complaint_velocity_30d, 0) * 2.0e0
               + COALESCE(prior_ems_incidents, 0) * 1.5e0 + COALESCE(nearby_nypd_incidents, 0) * 0.75e0
               + COALESCE(complaint_velocity_90d, 0) * 1.0e0
               + CASE WHEN last_fdny_inspection_pass = FALSE THEN 15.0e0 ELSE 0.0e0 END
               + CASE WHEN elevator_out_of_service > 0 THEN 5.0e0 ELSE 0.0e0 END AS overall_risk_score
        FROM px_components""",
    "px_owned_bins": "SELECT DISTINCT owner_name, bin FROM px_buildings WHERE owner_name IS NOT NULL AND bin IS NOT NULL",
    "px_named_contacts": """
        SELECT COALESCE(corporationname, TRIM(CONCAT(COALESCE(firstname, ''), ' ', COALESCE(lastname, '')))) AS owner_name, registrationid
        FROM fx_registration_contacts
        WHERE contacttype IN ('HeadOfficer', 'IndividualOwner', 'CorporateOwner') AND COALESCE(corporationname, firstname) IS NOT NULL""",
    "px_registered": """
        SELECT contactdescription AS owner_name, registrationid, bin FROM fx_registrations
        WHERE contactdescription IS NOT NULL AND bin IS NOT NULL""",
}

_NOT_REGISTERED = "owner_name NOT IN (SELECT owner_name FROM px_registered)"

SQL: dict[str, str] = {
    "crosswalk_fill": "SELECT bbl, bin FROM px_buildings",
    "registrations_portfolio": f"""
        SELECT owner_name, COUNT(DISTINCT registrationid) AS total_buildings, 0.0e0 AS total_ecb_balance_due
        FROM px_registered GROUP BY owner_name
        UNION ALL
        SELECT owner_name, COUNT(DISTINCT registrationid), 0.0e0 FROM px_named_contacts GROUP BY owner_name HAVING {_NOT_REGISTERED}""",
    "registrations_members": f"""
        SELECT owner_name, STRING_AGG(bin, ',' ORDER BY bin) AS bins FROM px_registered GROUP BY owner_name
        UNION ALL
        SELECT owner_name, STRING_AGG(CAST(registrationid AS VARCHAR), ',' ORDER BY CAST(registrationid AS VARCHAR))
        FROM px_named_contacts GROUP BY owner_name HAVING {_NOT_REGISTERED}""",
    "owner_portfolio_compat": """
        SELECT p.owner_name, p.total_buildings, p.total_open_violations, p.total_class_c_violations,
               ROUND(COALESCE(f.due, 0e0), 1) AS total_ecb_balance_due,
               ROUND(p.total_open_violations / p.total_buildings, 4) AS avg_violations_per_building
        FROM px_portfolio p LEFT JOIN (
            SELECT b.owner_name, SUM(e.balance_due * GREATEST(1, (SELECT COUNT(*) FROM fx_dob_violations v WHERE v.bin = b.bin))
                                     * GREATEST(1, (SELECT COUNT(*) FROM fx_hpd_violations v WHERE v.bin = b.bin))) AS due
            FROM px_buildings b JOIN px_ecb e ON b.bin = e.bin AND e.is_active GROUP BY b.owner_name) f
          ON p.owner_name = f.owner_name""",
    "owner_portfolio_exact": """
        SELECT p.owner_name, p.total_buildings, p.total_open_violations, p.total_class_c_violations,
               ROUND(COALESCE((SELECT SUM(e.balance_due) FROM px_owned_bins o JOIN px_ecb e ON o.bin = e.bin
                               WHERE o.owner_name = p.owner_name AND e.is_active), 0e0), 1) AS total_ecb_balance_due,
               ROUND(p.total_open_violations / p.total_buildings, 4) AS avg_violations_per_building
        FROM px_portfolio p""",
    "owner_bins": "SELECT owner_name, bin FROM px_owned_bins",
    "owner_bins_text": "SELECT owner_name, STRING_AGG(bin, ',' ORDER BY bin) AS bins FROM px_owned_bins GROUP BY owner_name",
    "high_neglect_owners": """
        SELECT * FROM (SELECT p.owner_name, p.total_class_c_violations,
               ROUND(COALESCE((SELECT SUM(e.balance_due) FROM px_owned_bins o JOIN px_ecb e ON o.bin = e.bin
                               WHERE o.owner_name = p.owner_name AND e.is_active), 0e0), 1) AS total_ecb_balance_due
        FROM px_portfolio p) WHERE total_class_c_violations > 5 OR total_ecb_balance_due > 50000""",
    "risk_by_bin": "SELECT * FROM px_by_bin",
    "risk_fire_or_join": "SELECT * FROM px_fires_by_bin",
    "risk_ems_grid": "SELECT * FROM px_ems",
    "risk_nypd_grid": "SELECT * FROM px_nypd",
    "risk_311_velocity": "SELECT * FROM px_velocity",
    "risk_inspection": "SELECT * FROM px_inspected",
    "risk_elevator": "SELECT * FROM px_lifts",
    "nearest_hydrant": "SELECT * FROM px_hydrant",
    "nearest_hospital": "SELECT * FROM px_hospital",
    "risk_composite": """
        SELECT *, CASE WHEN overall_risk_score > 60 THEN 'red' WHEN overall_risk_score > 30 THEN 'yellow'
                       WHEN overall_risk_score > 0 THEN 'scored' ELSE 'none' END AS band,
               CASE WHEN overall_risk_score >= 60 THEN 'severe' WHEN overall_risk_score >= 30 THEN 'high'
                    WHEN overall_risk_score >= 10 THEN 'medium' ELSE 'low' END AS display_band
        FROM px_scores""",
    "risk_bands": """
        SELECT COUNT(*) FILTER (WHERE overall_risk_score > 0) AS scored, COUNT(*) FILTER (WHERE overall_risk_score > 30) AS yellow,
               COUNT(*) FILTER (WHERE overall_risk_score > 60) AS red FROM px_scores""",
    "risk_pushed_to_buildings": "SELECT bbl, bin, overall_risk_score AS risk_score FROM px_scores",
}


# ---- requests, history, triage ---------------------------------------------------------------------------------


def _resolved(request: str, by_key: bool) -> str:
    """The resolution cascade: every candidate of every stage, best one per request."""
    d = "(500e0 / 364000.0e0)"
    keys = """
        SELECT r.request_id, 1 AS stage, 0e0 AS ord, b.* FROM {r} r JOIN px_buildings b ON r.bbl = b.bbl
        UNION ALL SELECT r.request_id, 2, 0e0, b.* FROM {r} r JOIN px_buildings b ON r.bin = b.bin
        UNION ALL """ if by_key else ""
    return f"""
        SELECT * EXCLUDE (ord, rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY stage, ord, bbl) AS rn FROM (
        {keys.format(r=request)}
        SELECT r.request_id, 3 AS stage, 0e0 AS ord, b.* FROM {request} r JOIN px_buildings b ON UPPER(b.address) = UPPER(TRIM(r.address))
        UNION ALL SELECT r.request_id, 4, CAST(LENGTH(b.address) AS DOUBLE), b.* FROM {request} r JOIN px_buildings b
            ON UPPER(b.address) LIKE '%' || UPPER(TRIM(r.address)) || '%' WHERE TRIM(r.address) != ''
        UNION ALL SELECT r.request_id, 5, SQRT(POW((b.latitude - r.latitude) * 364000, 2) + POW((b.longitude - r.longitude) * 288200, 2)), b.*
            FROM {request} r JOIN px_buildings b ON b.latitude BETWEEN r.latitude - {d} AND r.latitude + {d}
             AND b.longitude BETWEEN r.longitude - {d} AND r.longitude + {d}
            WHERE r.latitude != 0 AND r.longitude != 0 AND b.latitude != 0)) WHERE rn = 1"""


def _located(resolved: str) -> str:
    return f"""
        SELECT r.request_id, b.bbl, b.bin, UPPER(r.address) AS addr, COALESCE(NULLIF(r.latitude, 0), b.latitude) AS latitude,
               COALESCE(NULLIF(r.longitude, 0), b.longitude) AS longitude
        FROM fx_requests r LEFT JOIN {resolved} b ON r.request_id = b.request_id"""


def _boxed(located: str, facts: str, r: str) -> str:
    return f"""{located} l JOIN {facts} f ON f.latitude BETWEEN l.latitude - {r} AND l.latitude + {r}
            AND f.longitude BETWEEN l.longitude - {r} AND l.longitude + {r}
            WHERE l.latitude != 0 AND l.longitude != 0 AND f.latitude IS NOT NULL AND f.latitude != 0"""


def _rank(order: str) -> str:
    return f"ROW_NUMBER() OVER (PARTITION BY l.request_id ORDER BY {order})"


def _pairs_311(located: str) -> str:
    return f"""
        SELECT l.request_id, s.* FROM {located} l JOIN fx_service_requests_311 s ON s.bbl = l.bbl
        UNION ALL SELECT l.request_id, s.* FROM {located} l JOIN fx_service_requests_311 s
            ON UPPER(s.incident_address) LIKE '%' || l.addr || '%'
        WHERE l.addr != '' AND NOT EXISTS (SELECT 1 FROM fx_service_requests_311 x WHERE x.bbl = l.bbl)"""


def _history(located: str, pairs: str) -> str:
    return f"""
        SELECT request_id, source, rn, type, detail, CAST(date AS VARCHAR) AS date, status FROM (
        SELECT l.request_id, '311' AS source, 1 AS sr, 10 AS cap, {_rank('l.created_date DESC NULLS LAST, l.unique_key')} AS rn,
               l.complaint_type AS type, l.descriptor AS detail, CAST(l.created_date AS VARCHAR) AS date, l.status AS status FROM {pairs} l
        UNION ALL SELECT l.request_id, 'HPD Violation', 2, 8, {_rank('f.inspection_date DESC NULLS LAST, f.violation_id NULLS LAST, f.nov_description NULLS LAST, f.violation_class NULLS LAST, f.current_status NULLS LAST')},
               'Class ' || f.violation_class, f.nov_description, CAST(f.inspection_date AS VARCHAR), f.current_status
            FROM {located} l JOIN fx_hpd_violations f ON f.bin = l.bin
        UNION ALL SELECT l.request_id, 'DOB Violation', 3, 8, {_rank('f.issue_date DESC NULLS LAST, f.id NULLS LAST, f.description NULLS LAST, f.violation_type NULLS LAST, f.is_active NULLS LAST')},
               f.violation_type, f.description, CAST(f.issue_date AS VARCHAR), CASE WHEN f.is_active THEN 'ACTIVE' ELSE 'Resolved' END
            FROM {located} l JOIN fx_dob_violations f ON f.bin = l.bin
        UNION ALL SELECT l.request_id, 'FDNY', 4, 8, {_rank('f.incident_datetime DESC NULLS LAST, f.incident_id')}, f.incident_type_desc,
               f.incident_classification, CAST(f.incident_datetime AS VARCHAR), NULL FROM {_boxed(located, 'px_fire', '0.003e0')}
        UNION ALL SELECT l.request_id, 'EMS', 5, 8, {_rank('f.incident_datetime DESC NULLS LAST, f.cad_incident_id')}, f.initial_call_type,
               'Severity: ' || f.initial_severity_level, CAST(f.incident_datetime AS VARCHAR), NULL FROM {_boxed(located, 'fx_ems_incidents', '0.002e0')}
        UNION ALL SELECT l.request_id, 'NYPD', 6, 8, {_rank('f.complaint_date DESC NULLS LAST, f.complaint_number')}, f.offense_description,
               f.law_category, CAST(f.complaint_date AS VARCHAR), NULL FROM {_boxed(located, 'fx_nypd_complaints', '0.002e0')}
        ) WHERE rn <= cap"""


def _near(kind: str, sites: str, name: str, scale: tuple[str, str], box: str | None, k: int, decimals: int) -> str:
    dist = f"SQRT(POW((s.latitude - r.latitude) * {scale[0]}, 2) + POW((s.longitude - r.longitude) * {scale[1]}, 2))"
    inside = "" if box is None else f""" AND s.latitude BETWEEN r.latitude - {box} AND r.latitude + {box}
            AND s.longitude BETWEEN r.longitude - {box} AND r.longitude + {box}"""
    return f"""SELECT request_id, '{kind}' AS kind, rn, name, ROUND(d, {decimals}) AS distance FROM (
        SELECT r.request_id, s.{name} AS name, {dist} AS d, ROW_NUMBER() OVER (PARTITION BY r.request_id ORDER BY {dist}, s.{name}) AS rn
        FROM fx_requests r, {sites} s WHERE r.latitude != 0 AND r.longitude != 0 AND s.latitude != 0{inside}) WHERE rn <= {k}"""


def _words(*words: str) -> str:
    return "regexp_matches(LOWER(text), '" + "|".join(words) + "')"


_TRIAGE = [
    (_words("fire", "smoke", "burning", "flames"), "Structure Fire", 5, "FDNY", "Engine Company + Ladder Company + Battalion Chief + EMS standby",
     "Reported fire/smoke. ", ". Deploy full box alarm. EMS standby for potential victims.", 0.5, 120),
    (_words("medical", "breathing", "collapsed", "unconscious", "chest", "heart"), "Medical Emergency", 4, "EMS", "ALS Ambulance + First Responder",
     "Medical emergency reported. ", ". Deploy ALS unit.", 0.5, 120),
    (_words("gun", "shot", "robbery", "assault", "stabbing", "weapon"), "Violent Crime", 5, "NYPD", "2 RMPs + Sergeant + EMS standby",
     "Violent crime reported. ", ". Multiple units needed. EMS standby.", 0.5, 120),
    (_words("gas", "leak", "smell"), "Gas Leak", 4, "FDNY", "Engine Company + Haz-Mat Unit", "Gas leak/odor reported. ",
     ". Evacuate area. Con Ed notification.", 0.5, 120),
    (_words("noise", "loud", "music", "party"), "Noise Complaint", 1, "NYPD", "1 RMP (Radio Motor Patrol)", "Noise disturbance. ", ".", 0.6, 120),
    (_words("water", "flood", "pipe", "burst"), "Water Emergency", 3, "FDNY", "Engine Company", "Water emergency. ",
     ". Check for electrical hazards.", 0.5, 120),
    ("TRUE", "General Incident", 2, "311", "Dispatch appropriate unit based on assessment", "Incident reported: ", "", 0.4, 150),
]


def _triage(column: int) -> str:
    def value(row: tuple) -> str:
        if column == 5:
            return f"'{row[5]}' || SUBSTRING(text, 1, {row[8]}) || '{row[6]}'"
        x = row[column]
        return f"'{x}'" if isinstance(x, str) else (f"{x}e0" if isinstance(x, float) else str(x))

    return "CASE " + " ".join(f"WHEN {r[0]} THEN {value(r)}" for r in _TRIAGE) + " END"


_TRIAGE_COLUMNS = (
    f"{_triage(1)} AS category, {_triage(2)} AS severity, {_triage(3)} AS agency, {_triage(4)} AS send, {_triage(5)} AS summary, {_triage(7)} AS confidence"
)
_PCT = "list_sort(list(latency_ms))[LEAST(CAST(FLOOR(COUNT(*) * {p}e0) AS BIGINT), COUNT(*) - 1) + 1]"
_LATENCY = f"""COUNT(*) AS total_queries, SUM(CAST(ok AS INT)) AS successes, COUNT(*) - SUM(CAST(ok AS INT)) AS failures,
    ROUND(SUM(CAST(ok AS INT)) / COUNT(*) * 100, 1) AS success_rate, ROUND(MIN(latency_ms), 1) AS min_ms,
    ROUND({_PCT.format(p='0.50')}, 1) AS p50_ms, ROUND({_PCT.format(p='0.95')}, 1) AS p95_ms, ROUND({_PCT.format(p='0.99')}, 1) AS p99_ms,
    ROUND(MAX(latency_ms), 1) AS max_ms, ROUND(AVG(latency_ms), 1) AS mean_ms, ROUND(STDDEV_SAMP(latency_ms), 1) AS stdev_ms"""


def _shown(c: str) -> str:
    return f"COALESCE(CAST({c} AS VARCHAR), 'None')"


_CONTEXT = f"""
    SELECT r.request_id, CONCAT_WS(chr(10),
        CASE WHEN b.stage IS NOT NULL THEN 'Building: ' || {_shown('b.address')} || ' ' || {_shown('b.borough')} || ' | Built ' || {_shown('b.year_built')}
             || ' | ' || {_shown('b.num_floors')} || ' floors | Owner: ' || {_shown('b.owner_name')} END,
        CASE WHEN b.year_built % 50 > 0 THEN 'Precomputed risk score: ' || CAST(CAST(b.year_built % 50 AS DOUBLE) / 2e0 AS VARCHAR) END,
        CASE WHEN n.fire_n > 0 THEN n.fire_n || ' prior fire incidents at this location' END,
        CASE WHEN n.ems_n > 0 THEN n.ems_n || ' prior EMS calls nearby' END,
        CASE WHEN n.nypd_n > 0 THEN n.nypd_n || ' prior NYPD complaints nearby' END,
        CASE WHEN n.hpd_n > 0 THEN n.hpd_n || ' HPD violations (housing code)' END,
        CASE WHEN n.dob_n > 0 THEN n.dob_n || ' DOB violations (building code)' END, n.details) AS context
    FROM fx_requests r LEFT JOIN px_resolved_text b ON r.request_id = b.request_id LEFT JOIN (
        SELECT request_id, COUNT(*) FILTER (WHERE source = 'FDNY') AS fire_n, COUNT(*) FILTER (WHERE source = 'EMS') AS ems_n,
               COUNT(*) FILTER (WHERE source = 'NYPD') AS nypd_n, COUNT(*) FILTER (WHERE source LIKE '%HPD%') AS hpd_n,
               COUNT(*) FILTER (WHERE source LIKE '%DOB%') AS dob_n, STRING_AGG(line, chr(10) ORDER BY pos) FILTER (WHERE pos <= 3) AS details
        FROM (SELECT *, '  - [' || source || '] ' || {_shown('type')} || ' ' || {_shown('detail')} || ' (' || {_shown('date')} || ')' AS line,
                     ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY CASE source WHEN '311' THEN 1 WHEN 'HPD Violation' THEN 2
                         WHEN 'DOB Violation' THEN 3 WHEN 'FDNY' THEN 4 WHEN 'EMS' THEN 5 ELSE 6 END, rn) AS pos FROM px_history_text)
        GROUP BY request_id) n ON r.request_id = n.request_id"""

_CORPUS = f"""
    SELECT unique_key AS id, complaint_type, descriptor, borough, agency, CAST(created_date AS VARCHAR) AS created_date,
           CAST(DATE_DIFF('day', created_date, closed_date) AS INT) AS resolution_days, 'SR311' AS source
    FROM fx_service_requests_311
    UNION ALL SELECT incident_id, incident_type_desc, incident_classification, incident_borough, 'FDNY', CAST(incident_datetime AS VARCHAR), -1, 'FIRE'
    FROM px_fire
    UNION ALL SELECT complaint_number, offense_description, law_category, borough, 'NYPD', CAST(complaint_date AS VARCHAR), -1, 'NYPD'
    FROM fx_nypd_complaints"""

_DOCS = """
    SELECT DISTINCT SUBSTRING(md5(source || '_' || id), 1, 16) AS doc_id,
           CONCAT_WS(' \u2014 ', COALESCE(complaint_type, 'Unknown') || CASE WHEN borough IS NOT NULL AND borough NOT IN ('', 'UNKNOWN', 'None', 'nan') THEN ' in ' || borough ELSE '' END,
                     CASE WHEN descriptor NOT IN ('', 'None', 'nan') THEN SUBSTRING(descriptor, 1, 200) END,
                     CASE WHEN resolution_days > 0 THEN 'resolved in ' || printf('%.1f', CAST(resolution_days AS DOUBLE)) || ' days' END) AS document,
           source, COALESCE(borough, 'None') AS borough, COALESCE(agency, 'None') AS agency, COALESCE(complaint_type, 'None') AS complaint_type,
           CAST(COALESCE(resolution_days, -1) AS DOUBLE) AS resolution_days, COALESCE(created_date, 'None') AS date
    FROM px_corpus"""

_STATS = """COUNT(*) AS total_similar, ROUND(AVG(CASE WHEN resolution_days > 0 THEN resolution_days END), 2) AS avg_resolution_days,
    ROUND(CAST(MIN(CASE WHEN resolution_days > 0 THEN resolution_days END) AS DOUBLE), 2) AS min_resolution_days,
    ROUND(CAST(MAX(CASE WHEN resolution_days > 0 THEN resolution_days END) AS DOUBLE), 2) AS max_resolution_days,
    ROUND(MEDIAN(CASE WHEN resolution_days > 0 THEN resolution_days END), 2) AS median_resolution_days"""

PREPARED.update({
    "px_resolved_keys": _resolved("fx_requests", True),
    "px_resolved_text": _resolved("fx_requests", False),
    "px_located_keys": _located("px_resolved_keys"),
    "px_located_text": _located("px_resolved_text"),
    "px_pairs_keys": _pairs_311("px_located_keys"),
    "px_pairs_text": _pairs_311("px_located_text"),
    "px_history_keys": _history("px_located_keys", "px_pairs_keys"),
    "px_history_text": _history("px_located_text", "px_pairs_text"),
    # A report keeps the building's address and drops requests without a building.
    "px_located_report": """
        SELECT b.request_id, b.bbl, b.bin, UPPER(b.address) AS addr, b.owner_name, COALESCE(NULLIF(r.latitude, 0), b.latitude) AS latitude,
               COALESCE(NULLIF(r.longitude, 0), b.longitude) AS longitude
        FROM px_resolved_keys b JOIN fx_requests r ON r.request_id = b.request_id""",
    "px_pairs_report": _pairs_311("px_located_report"),
    "px_context": _CONTEXT,
    "px_corpus": _CORPUS,
    "px_docs": _DOCS,
    "px_cosine": """
        SELECT a.vec_id AS query_id, b.vec_id AS corpus_id, a.label AS query_label, b.label AS corpus_label,
               list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a, embeddings b""",
})


def _count_of(section: str, body: str, cap: int | None) -> str:
    n = "COUNT(*)" if cap is None else f"LEAST(COUNT(*), {cap})"
    return f"COALESCE((SELECT {n} FROM {body}), 0) AS {section}"


def _by_bin(section: str, facts: str, cap: int | None) -> str:
    return f"LEFT JOIN (SELECT bin, {'COUNT(*)' if cap is None else f'LEAST(COUNT(*), {cap})'} AS n FROM {facts} GROUP BY bin) {section} ON {section}.bin = l.bin"


def _by_box(section: str, facts: str, r: str, cap: int) -> str:
    return f"LEFT JOIN (SELECT l.request_id, LEAST(COUNT(*), {cap}) AS n FROM {_boxed('px_located_report', facts, r)} GROUP BY l.request_id) {section} ON {section}.request_id = l.request_id"


_REPORT_BIN = [("dob_violations", "fx_dob_violations", 50), ("dob_safety_violations", "fx_dob_safety", 30), ("ecb_violations", "px_ecb", 30),
               ("hpd_violations", "fx_hpd_violations", 50), ("hpd_complaints", "fx_hpd_complaints", 50), ("fire_inspections", "px_inspections", 20),
               ("elevators", "px_elevators", None)]
_REPORT_BOX = [("fire_incidents", "px_fire", "0.003e0", 30), ("ems_incidents", "fx_ems_incidents", "0.002e0", 20),
               ("nypd_complaints", "fx_nypd_complaints", "0.002e0", 20)]
_REPORT_NAMES = [r[0] for r in _REPORT_BIN] + [r[0] for r in _REPORT_BOX] + ["service_requests_311"]
_DIRECT = [n for n in _REPORT_NAMES if n != "dob_safety_violations"]
_REPORT = f"""
    SELECT l.request_id, {', '.join(f'COALESCE({n}.n, 0) AS {n}' for n in _REPORT_NAMES)},
           CASE WHEN l.owner_name IS NULL THEN 0 ELSE 1 END AS owner_portfolio,
           ({' + '.join(f'COALESCE({n}.n, 0)' for n in _DIRECT)}) = 0 AS no_direct_records
    FROM px_located_report l {' '.join(_by_bin(*r) for r in _REPORT_BIN)} {' '.join(_by_box(*r) for r in _REPORT_BOX)}
    LEFT JOIN (SELECT request_id, LEAST(COUNT(*), 50) AS n FROM px_pairs_report GROUP BY request_id) service_requests_311
      ON service_requests_311.request_id = l.request_id"""

_BARE = "trim(text_in, ' ' || chr(9) || chr(13) || chr(10) || '\"')"


def _moment(c: str) -> str:
    t = f"trim({c}, ' ' || chr(9) || chr(13) || chr(10) || '\"')"
    return f"""COALESCE(try_strptime({t}, '%m/%d/%Y %I:%M:%S %p'), try_strptime({t}, '%m/%d/%Y %H:%M:%S'),
        try_strptime(LEFT({t}, 19), '%Y-%m-%dT%H:%M:%S'), try_strptime({t}, '%m/%d/%Y'))"""


def _seconds(c: str) -> str:
    return f"CAST(COALESCE(epoch({_moment(c)}), 0) AS BIGINT)"


_D2 = "((lat - CAST(40.7128e0 AS FLOAT)) * (lat - CAST(40.7128e0 AS FLOAT)) + (lon - CAST(-73.98e0 AS FLOAT)) * (lon - CAST(-73.98e0 AS FLOAT)))"
_PLACE = "UPPER(trim(place, ' ' || chr(9) || chr(13) || chr(10) || '\"'))"
_KIND = "UPPER(trim(kind, ' ' || chr(9) || chr(13) || chr(10) || '\"'))"
_BORO = f"""CASE {_PLACE} WHEN 'MANHATTAN' THEN 1 WHEN 'NEW YORK' THEN 1 WHEN 'BROOKLYN' THEN 2 WHEN 'KINGS' THEN 2 WHEN 'QUEENS' THEN 3
    WHEN 'BRONX' THEN 4 WHEN 'STATEN ISLAND' THEN 5 WHEN 'RICHMOND' THEN 5 ELSE 0 END"""
_CODE = f"""CASE WHEN {_KIND} IN ('NOISE', 'NOISE - RESIDENTIAL') THEN 1 WHEN {_KIND} = 'HEATING' THEN 2 WHEN {_KIND} = 'WATER SYSTEM' THEN 5
    WHEN {_KIND} = 'RODENT' THEN 11 WHEN {_KIND} = 'NOISE - COMMERCIAL' THEN 12 WHEN {_KIND} = 'APPLIANCE' THEN 16
    WHEN {_KIND} LIKE '%FIRE%' THEN 17 WHEN {_KIND} LIKE '%MEDICAL%' OR {_KIND} LIKE '%EMS%' THEN 18 WHEN {_KIND} LIKE '%ASSAULT%' THEN 19
    WHEN {_KIND} LIKE '%NOISE%' THEN 1 ELSE 20 END"""
_CODE_LABEL = """CASE code WHEN 1 THEN 'Noise' WHEN 2 THEN 'Heat/Hot Water' WHEN 5 THEN 'Water System' WHEN 11 THEN 'Rodent'
    WHEN 12 THEN 'Noise - Commercial' WHEN 16 THEN 'Appliance' WHEN 17 THEN 'Fire' WHEN 18 THEN 'Medical' WHEN 19 THEN 'Assault' ELSE 'Other' END"""
_REPLY = """CASE doc_id % 7 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {d} END"""

SQL.update({
    "filter_code_box_count": """
        SELECT COUNT(*) FILTER (WHERE complaint_type = 3) AS by_code,
               COUNT(*) FILTER (WHERE CAST(lat AS DOUBLE) BETWEEN 40.71e0 AND 40.725e0 AND CAST(lon AS DOUBLE) BETWEEN -73.99e0 AND -73.96e0) AS by_box,
               COUNT(*) FILTER (WHERE complaint_type = 3 AND CAST(lat AS DOUBLE) BETWEEN 40.71e0 AND 40.725e0
                                AND CAST(lon AS DOUBLE) BETWEEN -73.99e0 AND -73.96e0) AS by_both FROM fx_coded""",
    "scored_topk": f"""
        SELECT event_id, complaint_type, borough, score FROM (
            SELECT *, CAST(CASE WHEN borough = 2 THEN 2 ELSE 0 END + CASE WHEN complaint_type = 4 THEN 3 ELSE 0 END
                + CASE WHEN lat != 0 AND {_D2} < CAST(0.001e0 AS FLOAT) THEN 1e0 WHEN lat != 0 AND {_D2} < CAST(0.01e0 AS FLOAT) THEN 0.5e0 ELSE 0e0 END AS FLOAT) AS score
            FROM fx_coded) WHERE score > 0 ORDER BY score DESC, event_id LIMIT 200""",
    "coded_dates": f"""
        SELECT *, ROUND(CAST(CASE WHEN created > 0 AND closed > created THEN CAST(closed - created AS FLOAT) / CAST(86400 AS FLOAT) ELSE CAST(-1 AS FLOAT) END AS DOUBLE), 3) AS resolution_days
        FROM (SELECT o_orderkey, {_seconds('created_text')} AS created, {_seconds('closed_text')} AS closed FROM fx_date_texts)""",
    "code_maps": f"""
        SELECT c_custkey, borough_code, CASE borough_code WHEN 1 THEN 'Manhattan' WHEN 2 THEN 'Brooklyn' WHEN 3 THEN 'Queens' WHEN 4 THEN 'Bronx'
                   WHEN 5 THEN 'Staten Island' ELSE 'Unknown' END AS borough_label, borough_name, code AS complaint_code, {_CODE_LABEL} AS complaint_label
        FROM (SELECT c_custkey, {_BORO} AS borough_code, {_CODE} AS code,
                     CASE UPPER(TRIM(place)) WHEN 'MANHATTAN' THEN 'MANHATTAN' WHEN 'NEW YORK' THEN 'MANHATTAN' WHEN 'QUEENS' THEN 'QUEENS'
                          WHEN 'BRONX' THEN 'BRONX' WHEN 'RICHMOND' THEN 'STATEN ISLAND' WHEN '5' THEN 'STATEN ISLAND' ELSE 'UNKNOWN' END AS borough_name
              FROM fx_names)""",
    "dob_severity": """
        SELECT violation_type, CASE WHEN violation_type IN ('LL6291', 'AEUHAZ', 'IMEGNCY', 'LL1081') THEN 'CRITICAL'
                 WHEN violation_type IN ('ACC1', 'HBLVIO', 'P*CLSS1') THEN 'HIGH' WHEN violation_type IN ('UB', 'COMPBLD') THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               COUNT(*) AS n, COUNT(*) FILTER (WHERE is_active) AS active FROM fx_dob_violations GROUP BY 1, 2""",
    "ecb_severity": """
        SELECT ecb_violation_number, CASE WHEN penalty_imposed > 10000 THEN 'CRITICAL' WHEN penalty_imposed > 2500 THEN 'HIGH'
                 WHEN penalty_imposed > 500 THEN 'MEDIUM' ELSE 'LOW' END AS severity, is_active FROM px_ecb""",
    "planar_distances": """
        SELECT request_id, ROUND(SQRT(POW((latitude - 40.72e0) * 364000, 2) + POW((longitude + 73.98e0) * 288200, 2)), 3) AS feet,
               ROUND(SQRT(POW((latitude - 40.72e0) * 69.0e0, 2) + POW((longitude + 73.98e0) * 54.6e0, 2)), 6) AS miles
        FROM fx_requests WHERE latitude IS NOT NULL""",
    "identifiers_and_texts": """
        SELECT bbl, bbl AS as_bbl, CAST(NULL AS VARCHAR) AS not_a_bbl, SUBSTRING(md5(bbl || '_' || address), 1, 16) AS hash_id,
               CASE WHEN LENGTH(address) > 8 THEN SUBSTRING(address, 1, 8) || '...' ELSE address END AS short, num_floors + 1 AS rounded,
               year_built || '-02-03' AS iso,
               CASE num_floors % 7 WHEN 1 THEN 'Low' WHEN 3 THEN 'Urgent' WHEN 4 THEN 'Critical' WHEN 5 THEN 'Life-Threatening' ELSE 'Moderate' END AS label
        FROM fx_buildings""",
    "dedup_latest": "SELECT incident_id, event_id, incident_datetime FROM px_fire",
    "hospitals_from_facilities": "SELECT facility_name, facility_type, latitude, longitude FROM px_hospitals",
    "conform_buildings": """
        SELECT bbl, CASE WHEN bin IS NULL OR TRIM(bin) IN ('', '0') THEN NULL ELSE bin END AS bin, borough, NULL AS block, NULL AS lot, address, zipcode,
               NULL AS borough_code, num_floors, year_built, NULL AS building_class, NULL AS land_use, NULL AS residential_units, NULL AS total_units,
               NULL AS lot_area, NULL AS building_area, owner_name, latitude, longitude, NULL AS construction_type, 0e0 AS risk_score
        FROM fx_buildings WHERE bbl IS NOT NULL AND TRIM(bbl) NOT IN ('', '0')""",
    "conform_dob_violations": """
        SELECT bin, CASE WHEN violation_type IN ('LL6291', 'AEUHAZ', 'IMEGNCY', 'LL1081') THEN 'CRITICAL'
                 WHEN violation_type IN ('ACC1', 'HBLVIO', 'P*CLSS1') THEN 'HIGH' WHEN violation_type IN ('UB', 'COMPBLD') THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               is_active, COUNT(*) AS n, CAST(MAX(issue_date) AS VARCHAR) AS latest FROM fx_dob_violations WHERE bin IS NOT NULL GROUP BY ALL""",
    "conform_dob_safety": """
        SELECT bin, COALESCE(status, 'OPEN') AS status, violation_description, COUNT(*) AS n FROM fx_dob_safety WHERE bin IS NOT NULL GROUP BY ALL""",
    "conform_ecb_violations": """
        SELECT ecb_violation_number, bin, penalty_imposed, balance_due, CAST(issue_date AS VARCHAR) AS issue_date, CASE WHEN penalty_imposed > 10000 THEN 'CRITICAL'
                 WHEN penalty_imposed > 2500 THEN 'HIGH' WHEN penalty_imposed > 500 THEN 'MEDIUM' ELSE 'LOW' END AS severity, is_active
        FROM px_ecb WHERE bin IS NOT NULL""",
    "conform_hpd_violations": """
        SELECT bin, violation_class, current_status, COUNT(violation_id) AS ids, CAST(MAX(inspection_date) AS VARCHAR) AS latest
        FROM fx_hpd_violations WHERE bin IS NOT NULL GROUP BY ALL""",
    "conform_hpd_complaints": """
        SELECT complaint_id, bin, status, major_category, CAST(received_date AS VARCHAR) AS received_date FROM fx_hpd_complaints WHERE bin IS NOT NULL""",
    "conform_fire_incidents": """
        SELECT incident_id, incident_datetime, dispatch_response_seconds, NULL AS bin FROM px_fire""",
    "conform_fire_company_incidents": """
        SELECT CAST(event_id AS VARCHAR) AS im_incident_key, incident_datetime AS incident_date_time, dispatch_response_seconds AS total_incident_duration,
               engines_assigned = 0 AS fire_origin_below_grade, incident_type_desc AS action_taken_primary FROM fx_fire_raw""",
    "conform_ems_incidents": """
        SELECT cad_incident_id, incident_datetime, initial_call_type, initial_severity_level, dispatch_response_seconds, latitude FROM fx_ems_incidents""",
    "conform_service_requests_311": """
        SELECT unique_key, created_date, closed_date, complaint_type, descriptor, incident_address, bbl, NULL AS bin, status FROM fx_service_requests_311""",
    "conform_nypd_complaints": """
        SELECT complaint_number, CAST(complaint_date AS VARCHAR) AS complaint_date, borough, offense_description, law_category, premises_type, latitude, longitude FROM fx_nypd_complaints""",
    "conform_inspections": """
        SELECT bin, is_compliant, COUNT(*) AS n, CAST(MAX(inspection_date) AS VARCHAR) AS latest FROM px_inspections
        WHERE bin IS NOT NULL AND TRIM(bin) NOT IN ('', '0') GROUP BY ALL""",
    "conform_elevators": """
        SELECT CAST(id AS VARCHAR) AS device_id, bin, device_type, status AS device_status, status FROM px_elevators WHERE bin IS NOT NULL""",
    "conform_hydrants": "SELECT unitid, latitude, longitude FROM fx_hydrants WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
    "conform_facilities": """
        SELECT uid, CASE WHEN facsubgrp = 'OTHER' THEN address ELSE uid || ' Main Street' END AS address, borough, latitude, longitude
        FROM fx_facilities WHERE latitude IS NOT NULL AND latitude != 0""",
    "conform_hospitals": """
        SELECT facname AS facility_name, COALESCE(factype, facsubgrp) AS facility_type, borough, latitude, longitude FROM fx_facilities
        WHERE latitude IS NOT NULL AND latitude != 0 AND longitude IS NOT NULL AND longitude != 0""",
    "coded_incidents": f"""
        SELECT complaint_type, borough, COUNT(*) AS n, SUM(created) AS created,
               ROUND(SUM(CAST(CASE WHEN created > 0 AND closed > created THEN CAST(closed - created AS FLOAT) / CAST(86400 AS FLOAT) ELSE CAST(-1 AS FLOAT) END AS DOUBLE)), 1) AS days,
               ROUND(SUM(CAST(CAST(COALESCE(latitude, 0e0) AS FLOAT) AS DOUBLE)), 2) AS lat
        FROM (SELECT {_CODE} AS complaint_type, {_BORO} AS borough, {_seconds('created_text')} AS created, {_seconds('closed_text')} AS closed, latitude
              FROM fx_names n JOIN fx_date_texts p ON n.c_custkey = p.o_orderkey JOIN fx_points q ON n.c_custkey = q.event_id) GROUP BY ALL""",
    "source_filter": """
        SELECT complaint_type, COUNT(*) AS n FROM fx_service_requests_311 WHERE complaint_type IN ('HEATING', 'PLUMBING', 'GENERAL CONSTRUCTION',
            'Heat/Hot Water', 'ELECTRIC', 'Gas Leak', 'STRUCTURAL', 'SAFETY', 'Hazardous Materials', 'Illegal Conversion', 'Building/Use') GROUP BY 1""",
    "global_counts": """
        SELECT 'dob' AS table_name, COUNT(*) AS row_count FROM fx_dob_violations WHERE is_active
        UNION ALL SELECT 'ecb', COUNT(*) FROM px_ecb WHERE is_active
        UNION ALL SELECT 'class_c', COUNT(*) FROM fx_hpd_violations WHERE violation_class = 'C' AND current_status != 'CLOSE'
        UNION ALL SELECT 'compliant', COUNT(*) FROM px_inspections WHERE is_compliant
        UNION ALL SELECT 'out', COUNT(*) FROM px_elevators WHERE status != 'ACTIVE'""",
    "table_inventory": " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in RELATIONS),
    "schema_evolution": "SELECT unique_key, CAST(NULL AS VARCHAR) AS bbl FROM fx_service_requests_311",
    "paged_buildings": "SELECT bbl, address FROM fx_buildings ORDER BY bbl LIMIT 50 OFFSET 25",
    "resolve_building": "SELECT request_id, stage, bbl, bin, address FROM px_resolved_keys",
    "address_search": """
        SELECT bbl, address, borough FROM px_buildings WHERE UPPER(address) LIKE '%1_ BROAD%' AND UPPER(borough) = 'QUEENS' ORDER BY LENGTH(address), bbl LIMIT 10""",
    "address_search_many": """
        SELECT search_id, rn, bbl, address FROM (
            SELECT r.request_id AS search_id, b.bbl, b.address, ROW_NUMBER() OVER (PARTITION BY r.request_id ORDER BY LENGTH(b.address), b.bbl) AS rn
            FROM fx_requests r JOIN px_buildings b ON UPPER(b.address) LIKE '%' || UPPER(r.address) || '%'
            WHERE r.address != '' AND (r.request_id % 2 != 0 OR UPPER(b.borough) = 'QUEENS')) WHERE rn <= 10""",
    "history_totals": """
        SELECT l.request_id, (SELECT COUNT(*) FROM px_fire f WHERE l.latitude != 0 AND l.longitude != 0 AND f.latitude IS NOT NULL AND f.latitude != 0 AND f.latitude BETWEEN l.latitude - 0.003e0 AND l.latitude + 0.003e0 AND f.longitude BETWEEN l.longitude - 0.003e0 AND l.longitude + 0.003e0) AS fire_total,
               (SELECT COUNT(*) FROM fx_ems_incidents f WHERE l.latitude != 0 AND l.longitude != 0 AND f.latitude IS NOT NULL AND f.latitude != 0 AND f.latitude BETWEEN l.latitude - 0.002e0 AND l.latitude + 0.002e0 AND f.longitude BETWEEN l.longitude - 0.002e0 AND l.longitude + 0.002e0) AS ems_total,
               (SELECT COUNT(*) FROM fx_nypd_complaints f WHERE l.latitude != 0 AND l.longitude != 0 AND f.latitude IS NOT NULL AND f.latitude != 0 AND f.latitude BETWEEN l.latitude - 0.002e0 AND l.latitude + 0.002e0 AND f.longitude BETWEEN l.longitude - 0.002e0 AND l.longitude + 0.002e0) AS nypd_total,
               (SELECT COUNT(*) FROM fx_hpd_violations f WHERE f.bin = l.bin AND l.bin != '') AS hpd_total,
               (SELECT COUNT(*) FROM fx_dob_violations f WHERE f.bin = l.bin AND l.bin != '') AS dob_total
        FROM px_located_keys l""",
    "incident_history": "SELECT * FROM px_history_keys",
    "nearby_resources": " UNION ALL ".join([
        _near("hospitals", "px_hospitals", "facility_name", ("69.0e0", "54.6e0"), None, 3, 2),
        _near("hydrants", "fx_hydrants", "unitid", ("364000", "288200"), "0.005e0", 3, 0),
        _near("facilities", "fx_facilities", "facname", ("364000", "288200"), "0.01e0", 5, 0)]),
    "building_report_counts": _REPORT,
    "building_report_ecb": """
        SELECT request_id, rn, ecb_violation_number, CAST(issue_date AS VARCHAR) AS issue_date, balance_due FROM (
            SELECT l.request_id, e.*, ROW_NUMBER() OVER (PARTITION BY l.request_id ORDER BY e.issue_date DESC NULLS LAST, e.ecb_violation_number) AS rn
            FROM px_located_report l JOIN px_ecb e ON e.bin = l.bin) WHERE rn <= 30""",
    "triage_rules": f"SELECT doc_id, {_TRIAGE_COLUMNS} FROM documents",
    "scenario_rules": f"""
        SELECT doc_id, CASE WHEN {_words('fire', 'smoke', 'burning')} THEN 'fire' WHEN {_words('medical', 'breathing', 'collapsed', 'unconscious', 'chest pain')} THEN 'medical'
            WHEN {_words('suspicious', 'package', 'bomb')} THEN 'suspicious' WHEN {_words('car', 'accident', 'vehicle', 'crash', 'flipped')} THEN 'traffic'
            ELSE 'noise' END AS scenario FROM documents""",
    "reply_parse": f"""
        SELECT doc_id, {_REPLY.format(a="'Kind ' || json_extract_string(reply, '$.category')[6:]", b="'Fenced ' || regexp_extract(reply, 'Fenced ([^\"]*)', 1)", c="'Inside ' || regexp_extract(reply, 'Inside ([^\"]*)', 1)", d=_triage(1))} AS category,
               {_REPLY.format(a='3', b='2', c='5', d=_triage(2))} AS severity, {_REPLY.format(a="'EMS'", b="'FDNY'", c="'NYPD'", d=_triage(3))} AS agency,
               {_REPLY.format(a='0.75e0', b='0.5e0', c='0.25e0', d=_triage(7))} AS confidence
        FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 IN (0, 1, 2) THEN reply END AS reply FROM fx_replies)""",
    "labelled_results": f"""
        SELECT severity, CASE severity WHEN 1 THEN 'Low' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Urgent' WHEN 4 THEN 'Critical' ELSE 'Life-Threatening' END AS label,
               agency, agency != '311' AS routed, COUNT(*) AS n FROM (SELECT {_TRIAGE_COLUMNS} FROM documents) GROUP BY ALL""",
    "validate_results": """
        SELECT scenario_id, CASE WHEN issues = '' THEN 'PASS' ELSE 'WARN' END AS status, issues FROM (SELECT scenario_id, CONCAT_WS('; ',
            CASE WHEN severity IS NULL OR severity NOT BETWEEN 1 AND 5 THEN 'Invalid severity: ' || severity END,
            CASE WHEN agency IS NULL OR agency NOT IN ('NYPD', 'FDNY', 'EMS', 'Sanitation', 'Buildings', 'Housing', 'Multi', '311') THEN 'Invalid agency: ' || COALESCE(agency, 'None') END,
            CASE WHEN expected_agency IS NOT NULL AND agency IS DISTINCT FROM expected_agency THEN 'Agency mismatch: got ' || COALESCE(agency, 'None') || ', expected ' || expected_agency END,
            CASE WHEN ABS(severity - expected_severity) > 1 THEN 'Severity off by >1: got ' || severity || ', expected ' || expected_severity END,
            CASE WHEN LENGTH(summary) < 20 THEN 'Summary too short (' || LENGTH(summary) || ' chars)' END,
            CASE WHEN confidence < 0.5 THEN 'Low confidence: ' || confidence END,
            CASE WHEN similar_count = 0 THEN 'No similar incidents returned' END,
            CASE WHEN total_ms > 5000 THEN 'Latency too high: ' || total_ms || 'ms' END) AS issues FROM fx_responses)""",
    "contract_checks": """
        SELECT 'valid' AS table_name, COUNT(*) AS row_count FROM documents WHERE LENGTH(text) BETWEEN 1 AND 2000
        UNION ALL SELECT 'rejected', COUNT(*) FROM documents WHERE text IS NULL OR LENGTH(text) NOT BETWEEN 1 AND 2000""",
    "latency_summary": f"SELECT event_type, {_LATENCY} FROM fx_responses GROUP BY event_type",
    "latency_overall": f"SELECT {_LATENCY} FROM fx_responses",
    "token_throughput": """
        SELECT event_type, ROUND(SUM(LENGTH(summary) // 4) / (SUM(latency_ms) / 1000e0), 1) AS tokens_per_sec FROM fx_responses GROUP BY event_type""",
    "batch_triage": f"""
        SELECT r.request_id, b.stage, b.bbl, {_triage(1)} AS category, {_triage(2)} AS severity, {_triage(3)} AS agency, {_triage(5)} AS summary, c.context,
               CONCAT_WS(chr(10) || chr(10), CASE WHEN c.context != '' THEN 'BUILDING HISTORY AT THIS LOCATION:' || chr(10) || c.context END,
                   'INCIDENT REPORT:' || chr(10) || r.text || chr(10) || chr(10) || 'Return ONLY the JSON.') AS prompt
        FROM fx_requests r LEFT JOIN px_resolved_text b ON r.request_id = b.request_id LEFT JOIN px_context c ON c.request_id = r.request_id""",
    "corpus_docs": "SELECT * FROM px_docs",
    "corpus_sources": """
        SELECT source, COUNT(*) AS n, MIN(first_id) AS first_id FROM (
            SELECT source, SUBSTRING(md5(source || '_' || id), 1, 16) AS first_id FROM px_corpus GROUP BY 1, 2)
        GROUP BY source""",
    "structured_search": """
        SELECT * FROM px_corpus WHERE borough = 'QUEENS' AND complaint_type ILIKE '%heat%' ORDER BY created_date DESC, source, id LIMIT 25""",
    "resolution_stats": f"SELECT source, complaint_type, {_STATS} FROM px_corpus GROUP BY 1, 2",
    "resolution_stats_overall": f"SELECT {_STATS} FROM px_corpus WHERE borough = 'QUEENS' AND complaint_type ILIKE '%noise%'",
    "vector_topn": """
        SELECT query_id, corpus_id, rn, ROUND(c, 5) AS similarity FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY c DESC, corpus_id) AS rn FROM px_cosine) WHERE rn <= 5""",
    "vector_topn_filtered": """
        SELECT query_id, corpus_id, rn, ROUND(c, 5) AS similarity FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY c DESC, corpus_id) AS rn FROM px_cosine
            WHERE query_label = corpus_label AND query_id != corpus_id) WHERE rn <= 5""",
    "search_contexts": f"""
        SELECT doc_id, CASE WHEN LENGTH(t) > 2000 THEN SUBSTRING(t, 1, 2000) || '...' ELSE t END AS context FROM (
            SELECT doc_id, CONCAT_WS(chr(10), CASE WHEN reply != '' THEN 'SCENE ANALYSIS: ' || SUBSTRING(reply, 1, 300) END,
                'DISPATCH REPORT: ' || SUBSTRING(text, 1, 400), chr(10) || 'SIMILAR PAST INCIDENTS IN NYC:',
                '1. Kind 0 in QUEENS (2024-01-01) [source: SR311]',
                CASE WHEN doc_id % 5 >= 1 THEN '2. Kind 1 in None (2024-01-02) [source: SR311]' END,
                CASE WHEN doc_id % 5 >= 2 THEN '3. Kind 2 in QUEENS \u2014 resolved in 1.0 days [source: SR311]' END,
                CASE WHEN doc_id > 0 THEN chr(10) || 'HISTORICAL CONTEXT: ' || format('{{:,}}', doc_id * 1000) || ' similar incidents on record. Average resolution: '
                     || printf('%.1f', CAST(doc_id % 8 AS DOUBLE) + 0.3e0) || ' days.' END) AS t FROM fx_replies)""",
    "search_prompts": """
        SELECT doc_id, CONCAT_WS(chr(10) || chr(10), CASE WHEN reply != '' THEN 'CONTEXT FROM NYC INCIDENT DATABASE:' || chr(10) || reply END,
            CASE WHEN reply != '' THEN 'VISUAL SCENE ANALYSIS:' || chr(10) || reply END, 'INCIDENT REPORT:' || chr(10) || text,
            chr(10) || 'Analyze this incident. Return ONLY the JSON object with category, severity, agency, summary, and confidence. No other text.') AS prompt
        FROM fx_replies""",
    "streamed_enrichment": f"""
        SELECT CAST(r.request_id AS BIGINT) AS request_id, {_triage(1)} AS category, {_triage(2)} AS severity,
               w.stage, w.bbl, w.borough, h.nearest_hospital, h.nearest_hospital_mi
        FROM fx_requests r
        LEFT JOIN (
            SELECT a.request_id, MIN(a.stage) AS stage, arg_min(f.bbl, a.stage) AS bbl, arg_min(f.borough, a.stage) AS borough
            FROM (SELECT request_id, 'bbl' AS kind, bbl AS key, 1 AS stage FROM fx_requests
                  UNION ALL SELECT request_id, 'bin', bin, 2 FROM fx_requests
                  UNION ALL SELECT request_id, 'addr', UPPER(TRIM(address)), 3 FROM fx_requests) a
            JOIN (
                SELECT kind, key, bbl, borough FROM (
                    SELECT 'bbl' AS kind, bbl AS key, bbl, borough, ROW_NUMBER() OVER (PARTITION BY bbl ORDER BY bin NULLS FIRST) AS rn
                    FROM px_clean WHERE bbl IS NOT NULL AND bbl != ''
                    UNION ALL
                    SELECT 'bin', bin, bbl, borough, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY bbl NULLS FIRST)
                    FROM px_clean WHERE bin IS NOT NULL AND bin != ''
                    UNION ALL
                    SELECT 'addr', UPPER(address), bbl, borough, ROW_NUMBER() OVER (PARTITION BY UPPER(address) ORDER BY bbl NULLS FIRST)
                    FROM px_clean WHERE address IS NOT NULL AND UPPER(address) != '')
                WHERE rn = 1) f ON a.kind = f.kind AND a.key = f.key
            WHERE a.key IS NOT NULL AND a.key != '' GROUP BY a.request_id) w ON r.request_id = w.request_id
        LEFT JOIN px_hospital h ON w.bbl = h.bbl""",
    "streamed_triage": f"SELECT doc_id, {_triage(1)} AS category, {_triage(2)} AS severity FROM documents",
})


def statements() -> dict[str, str]:
    return {name: with_fixtures(sql, PREPARED) for name, sql in SQL.items()}
