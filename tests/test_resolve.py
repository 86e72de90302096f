"""Resolution as a cascade: each stage answers only what the stages before it left open."""

from civicspark.plans import resolve as rs

BUILDINGS = [
    ("1", "10", "100 MAIN ST", 40.70, -74.00),
    ("2", "20", "200 BROADWAY", 40.71, -74.01),
    ("3", "30", "200 BROADWAY APT", 40.72, -74.02),
    ("4", "40", "5 ELM ST", 40.75, -73.90),
]
REQUESTS = [
    (1, "2", None, "MAIN", None, None),  # bbl first, though its text is part of an address
    (2, None, "40", None, None, None),  # bin
    (3, None, None, " 100 main st ", None, None),  # address, trimmed and upper-cased
    (4, None, None, "BROADWAY", None, None),  # shortest address containing it
    (5, None, None, "nowhere", 40.75, -73.9001),  # nearest building within 500 ft
    (6, None, None, "zzz", 0.0, 0.0),  # nothing: a latitude of 0 is missing
    (1, "2", None, "MAIN", None, None),  # a repeated request
    (None, "1", None, None, None, None),  # a request without id still resolves
]


def test_resolve_cascade(spark, monkeypatch):
    b = spark.createDataFrame(BUILDINGS, "bbl string, bin string, address string, latitude double, longitude double")
    r = spark.createDataFrame(REQUESTS, "request_id int, bbl string, bin string, address string, latitude double, longitude double")
    seen = []
    inner = rs.shortest_containing

    def recorded(patterns, entries, n):
        seen.extend(x.pattern for x in patterns.collect())
        return inner(patterns, entries, n)

    monkeypatch.setattr(rs, "shortest_containing", recorded)
    got = sorted((x.request_id or 0, x.stage, x.bbl) for x in rs.resolve(r, b, ["bbl", "bin", "address"]).collect())
    assert got == [(0, 1, "1"), (1, 1, "2"), (2, 2, "4"), (3, 3, "1"), (4, 4, "2"), (5, 5, "4")]
    assert sorted(seen) == ["BROADWAY", "NOWHERE", "ZZZ"]  # "MAIN" was answered by its bbl
