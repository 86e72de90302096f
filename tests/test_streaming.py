"""Stream enrichment: the persisted lookup answers by key, and a refresh takes effect at the next batch."""

from civicspark.streaming import lookup as lk

BUILDINGS = "bbl string, bin string, address string, borough string"
NEAREST = "bbl string, nearest_hospital string, nearest_hospital_mi double"
REPORTS = "request_id long, bbl string, bin string, address string, text string"


def test_lookup_answers_and_refreshes(spark, tmp_path):
    b1 = spark.createDataFrame([("1", "10", "1 Main St", "BRONX"), ("2", "10", "2 Main St", "QUEENS"), ("3", None, "1 main st", "BRONX")], BUILDINGS)
    near = spark.createDataFrame([("1", "H", 0.5)], NEAREST)
    facts = lk.Lookup(spark, str(tmp_path / "lookup"))
    facts.refresh(b1, near)
    batch = spark.createDataFrame(
        [(1, None, None, " 1 MAIN ST ", "smoke"), (2, "2", "10", None, "x"), (3, None, "10", None, "y"), (4, None, None, "nowhere", "z")], REPORTS
    )
    run = lk.enrich(facts)
    got = {r.request_id: (r.stage, r.bbl, r.borough, r.nearest_hospital) for r in run(batch)["result"].collect()}
    assert got == {1: (3, "1", "BRONX", "H"), 2: (1, "2", "QUEENS", None), 3: (2, "1", "BRONX", "H"), 4: (None, None, None, None)}
    b2 = b1.replace("BRONX", "MANHATTAN", "borough")
    facts.refresh(b2, near)
    again = {r.request_id: r.borough for r in run(batch)["result"].collect()}
    assert again[1] == "MANHATTAN" and again[2] == "QUEENS"


def test_facts_are_not_broadcast_by_hint(spark, tmp_path):
    rows = spark.range(5000).selectExpr("CAST(id AS STRING) AS bbl", "CAST(id AS STRING) AS bin", "concat(id, ' Main St') AS address", "'BRONX' AS borough")
    facts = lk.Lookup(spark, str(tmp_path / "lookup"))
    facts.refresh(rows, spark.createDataFrame([("1", "H", 0.5)], NEAREST))
    batch = spark.range(50).selectExpr("id AS request_id", "CAST(id AS STRING) AS bbl", "CAST(NULL AS STRING) AS bin", "CAST(NULL AS STRING) AS address", "'x' AS text")
    plan = lk.enrich(facts)(batch)["result"]._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_stream_keeps_requests_over_more_than_the_watermark(spark, tmp_path):
    from civicspark.queries import QUERIES

    source = "/root/testdata/sf0.001"
    for name in ("customer", "nation", "supplier"):
        rows = spark.read.parquet(f"{source}/{name}.parquet")
        if name == "customer":  # two copies, ids four hours of event time apart, dealt over several files
            rows = rows.union(rows.withColumn("c_custkey", (rows.c_custkey + 14_400).cast(rows.schema["c_custkey"].dataType))).repartition(4)
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    want = spark.read.parquet(str(tmp_path / "customer.parquet")).count()
    got = QUERIES["streamed_enrichment"](spark, str(tmp_path))
    assert got.count() == want and got.select("request_id").distinct().count() == want
