"""CSV and Parquet in, conform, catalogue, sinks, refresh job and stream."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from civicspark.plans import corpus, refresh
from civicspark.sources import conform as cf
from civicspark.sources import files, sinks
from civicspark.sources.coded import decode_incidents, load_coded
from civicspark.sources.specs import SPECS
from civicspark.streaming import reports

SF = "/root/testdata/sf0.001"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_catalogue():
    assert len(SPECS) == 18
    assert SPECS["pluto"].files[:2] == ("Primary_Land_Use_Tax_Lot_Output__PLUTO_.parquet", "Primary_Land_Use_Tax_Lot_Output__PLUTO_.csv")


def test_csv_rows_kept_and_dropped(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'x,y\n1,"a, ""q"" b"\n2,"two\nlines"\n3\n4,5,6\n,\n7,last')
    rows = [tuple(r) for r in files.read_table(spark, path, True).collect()]
    assert ("1", 'a, "q" b') in rows and ("2", "two\nlines") in rows and ("7", "last") in rows
    assert files.read_table(spark, path, True).count() == len(rows) == files.read_table(spark, path, True).select("x").count()


def test_find_file_order(spark, tmp_path):
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
    put(tmp_path / "two" / "pluto.csv", "bbl\n1")
    dirs = [str(tmp_path / "one"), str(tmp_path / "two")]
    assert files.find_file(spark, dirs, list(SPECS["pluto"].files)).endswith("two/pluto.csv")
    put(tmp_path / "one" / "pluto.csv", "bbl\n1")
    assert files.find_file(spark, dirs, list(SPECS["pluto"].files)).endswith("one/pluto.csv")
    assert files.find_file(spark, dirs, ["none.csv"]) is None


def test_aliases_missing_columns_and_required(spark):
    df = spark.createDataFrame([("1004770001", "0", " ", "3.6"), ("0", "5", "a", "1"), (None, "5", "a", "1")], "BBL string, Bin string, address string, NumFloors string")
    row = cf.conform(df, "pluto").collect()
    assert len(row) == 1 and row[0].bin is None and row[0].num_floors == 4 and row[0].owner_name is None and row[0].risk_score == 0.0
    with pytest.raises(ValueError):
        cf.conform(df.drop("BBL"), "pluto")


def test_alias_order_is_by_column_not_by_row(spark):
    df = spark.createDataFrame([("1", None, "2024-05-06")], "CMPLNT_NUM string, CMPLNT_FR_DT string, RPT_DT string")
    assert cf.conform(df, "nypd_complaints").first().complaint_date is None


def test_active_flag_uses_raw_text(spark):
    df = spark.createDataFrame([("1", "not a date"), ("1", None)], "bin string, disposition_date string")
    assert sorted(r.is_active for r in cf.conform(df, "dob_violations").collect()) == [False, True]


def test_fire_dedup_nulls_last_and_ids_unique(spark):
    df = spark.createDataFrame(
        [("7", None), ("7", "2024-01-01 00:00:00"), ("7", "2024-01-02 00:00:00"), (" ", "2024-01-01 00:00:00"), (None, None)],
        "starfire_incident_id string, incident_datetime string")
    rows = cf.conform(df, "fire_incidents").collect()
    assert len(rows) == 1 and str(rows[0].incident_datetime) == "2024-01-02 00:00:00"
    lifts = cf.conform(spark.range(100).selectExpr("CAST(id AS STRING) AS bin", "CAST(NULL AS STRING) AS status"), "elevators")
    assert lifts.select("id").distinct().count() == 100 and lifts.first().status == "UNKNOWN"


def test_coded_csv(spark, tmp_path):
    path = put(tmp_path / "c.csv", "\n".join([
        "Complaint Type,BOROUGH,Created_Date,Closed Date,Latitude,Longitude,Note",
        'Noise - Residential,KINGS,01/02/2024 03:04:05 PM,01/03/2024 03:04:05 PM,40.5,-74.25,"a, b"',
        'Sewer Problems,Nowhere,2024-01-02T00:00:00.000,,x,,"two\nlines"',
        'HEATING,Queens,1/2/2024,1/1/2024,1,2,"say ""hi"""',
        ",,,,,,last"]))
    rows = [tuple(r) for r in load_coded(spark, path).collect()]
    assert rows == [
        (1, 2, 1704207845, 1.0, 40.5, -74.25), (18, 0, 1704153600, -1.0, 0.0, 0.0), (2, 3, 1704153600, -1.0, 1.0, 2.0),
        (20, 0, 0, -1.0, 0.0, 0.0)]
    assert decode_incidents(load_coded(spark, path)).first().borough == "Brooklyn"
    bare = put(tmp_path / "d.csv", "BOROUGH\nBronx")
    assert tuple(load_coded(spark, bare).first()) == (20, 4, 0, -1.0, 0.0, 0.0)


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    sinks.replace_table(a, str(tmp_path / "t"), "k")
    sinks.replace_table(a, str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    both = sinks.append_to(spark, str(tmp_path / "t"), spark.createDataFrame([("z",)], "k string"), str(tmp_path / "t2"))
    assert both.count() == 3 and both.where("k = 'z'").first().v is None
    sinks.register({"some_table": a})
    assert sinks.describe_tables(spark)["some_table"] == [("k", "string"), ("v", "int")]


def test_vectors_and_scenarios_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("1", "fire on roof"), ("2", ""), ("3", "fire on roof")], "doc_id string, document string")
    sinks.write_vectors(docs, corpus.bag_of_words(16), str(tmp_path / "v"))
    rows = {r.doc_id: r.embedding for r in spark.read.parquet(str(tmp_path / "v")).collect()}
    assert rows["1"] == rows["3"] and len(rows["2"]) == 16 and sum(x * x for x in rows["1"]) == pytest.approx(1, abs=1e-5)
    put(tmp_path / "s.json", json.dumps({"scenarios": [{"id": "a", "text": "t", "borough": "Q", "image_b64": None,
                                                        "expected": {"category": "c", "severity": 4, "agency": "EMS"}}]}))
    got = sinks.read_scenarios(spark, str(tmp_path / "s.json"))
    assert got.first().expected.severity == 4
    sinks.write_results(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_refresh_job(spark, tmp_path):
    from civicspark import fixtures as fx

    src = tmp_path / "raw"
    renames = {
        "pluto": ("fx_buildings", {"owner_name": "ownername", "year_built": "yearbuilt", "num_floors": "numfloors"}),
        "registrations": ("fx_registrations", {}), "registration_contacts": ("fx_registration_contacts", {}),
        "dob_violations": ("fx_dob_violations", {}), "dob_ecb_violations": ("fx_ecb_violations", {}),
        "hpd_violations": ("fx_hpd_violations", {"violation_class": "class", "current_status": "currentstatus", "violation_id": "violationid"}),
        "fire_incidents": ("fx_fire_raw", {"incident_id": "starfire_incident_id"}), "ems_incidents": ("fx_ems_incidents", {}),
        "nypd_complaints": ("fx_nypd_complaints", {"complaint_number": "cmplnt_num", "complaint_date": "rpt_dt", "offense_description": "ofns_desc"}),
        "311_requests": ("fx_service_requests_311", {}), "fire_prevention_inspections": ("fx_inspections", {}),
        "elevators": ("fx_elevators", {"raw_status": "status"}), "fire_hydrants": ("fx_hydrants", {}), "facilities": ("fx_facilities", {}),
    }
    for name, (relation, cols) in renames.items():
        df = fx.relation(spark, SF, relation).withColumnsRenamed(cols)
        target = f"{src}/{SPECS[name].files[-2 if name != 'pluto' else 2]}"
        df.select(*[F.col(c).cast("string") for c in df.columns]).write.parquet(target)
    refresh.run(spark, [str(src)], str(tmp_path / "out"), ["load", "portfolio", "risk", "embed"], "2024-02-10")
    store = refresh.Store(spark, str(tmp_path / "out"))
    scores = store.read("building_risk_scores")
    assert scores.count() == store.read("buildings").count() == store.read("buildings_scored").count() == 150
    assert scores.where("overall_risk_score > 0").count() > 100
    assert store.read("buildings").where("bin IS NULL").count() < 15
    assert store.read("owner_portfolio").count() > 90 and store.read("incident_corpus").count() > 500
    assert store.read("hospitals").count() == 3


def test_stream_equals_batch_and_drops_resends(spark, tmp_path):
    from civicspark.functions import rules

    rows = spark.sql("""SELECT id AS report_id, timestamp_seconds(1700000000 + id) AS sent,
        CASE id % 3 WHEN 0 THEN 'smoke' WHEN 1 THEN 'loud party' ELSE 'nothing' END AS text FROM range(60)""")
    twice = rows.unionByName(rows.where("report_id < 20"))
    twice.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = reports.read_reports(spark, str(tmp_path / "in"), "report_id bigint, sent timestamp, text string", files_per_trigger=2)
    stream = reports.classify(reports.without_resends(stream, "report_id", "sent", "1 hour"))
    run = reports.start(stream, lambda b: {"result": b, "urgent": b.where("severity >= 4")}, str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    run.awaitTermination()
    assert run.exception() is None
    got = spark.read.parquet(str(tmp_path / "out" / "result"))
    want = rows.select("report_id", rules.triage("text")["category"].alias("category"))
    assert sorted(map(tuple, got.select("report_id", "category").collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(str(tmp_path / "out" / "urgent")).count() == 20
    shutil.rmtree(tmp_path / "state", ignore_errors=True)


def test_stream_enrichment_equals_batch(spark, tmp_path):
    from civicspark import fixtures as fx
    from civicspark import queries as qs
    from civicspark.plans import triage as tr

    requests = fx.relation(spark, SF, "fx_requests")
    requests.repartition(2).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)
    b, tables = qs.triage_buildings(spark, SF), qs.history_tables(spark, SF)
    hydrants = fx.relation(spark, SF, "fx_hydrants")
    enrich = reports.triage_enrichment(b, tables, hydrants=hydrants)
    stream = reports.read_reports(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    run = reports.start(stream, enrich, str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    run.awaitTermination()
    assert run.exception() is None
    want = tr.batch_triage(requests, b, tables, hydrants=hydrants)
    for name in ("result", "history", "nearby"):
        got = spark.read.parquet(str(tmp_path / "out" / name)).select(*want[name].columns)
        assert got.count() == want[name].count() and got.exceptAll(want[name]).isEmpty()
