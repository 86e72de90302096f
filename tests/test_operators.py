"""Substring join, order statistics, vectors, portfolios: against brute force on small random frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicspark.operators import quantiles as q
from civicspark.operators import vectors
from civicspark.operators.joins import left_spread
from civicspark.operators.substring import containing
from civicspark.plans import portfolio as pf
from civicspark.plans import scored


def test_substring_join_equals_like(spark):
    rnd = random.Random(3)
    entries = sorted({"".join(rnd.choice("AB C") for _ in range(rnd.randint(0, 9))) for _ in range(150)} | {"A%B", "A_B", "A\\B", ""})
    patterns = sorted({"".join(rnd.choice("AB C%_") for _ in range(rnd.randint(1, 6))) for _ in range(80)} | {"%", "_", "A\\B", "ZZZ"})
    e = spark.createDataFrame([(x,) for x in entries], "entry string")
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    got = {tuple(r) for r in containing(p, e).select("pattern", "entry").collect()}
    both = p.crossJoin(e).where("entry LIKE concat('%', pattern, '%') ESCAPE '\u0001'")
    assert got == {tuple(r) for r in both.select("pattern", "entry").collect()}


@pytest.mark.parametrize("small", [True, False])
def test_values_at_rank(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(q, "SMALL", 1)
    rnd = random.Random(5)
    rows = [("a", rnd.random() ** 8 * 1000) for _ in range(700)] + [("b", 7.0)] * 300 + [(None, float(i)) for i in range(11)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.pick): r.v for r in q.values_at(df, ["g"], "v", {"p50": q.rank_at(0.5), "p99": q.rank_at(0.99)}).collect()}
    for g in ("a", "b", None):
        vs = sorted(v for k, v in rows if k == g and v is not None)
        for name, p in (("p50", 0.5), ("p99", 0.99)):
            assert got[(g, name)] == vs[min(int(len(vs) * p), len(vs) - 1)]
    assert ("c", "p50") not in got
    assert q.median(df, ["g"], "v").where("g IS NULL").first()["median"] == 5.0


def test_cosine_top_n_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "PIVOTS", 5)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 4
    data = [(i, (centres[i % 6] + rng.normal(size=8) * (0.3 if i % 2 else 2)).tolist(), i % 3) for i in range(200)]
    data += [(1000 + i, data[0][1], 0) for i in range(40)]  # copies
    df = spark.createDataFrame(data, "id bigint, vector array<double>, label int")
    got = vectors.cosine_top_n(
        df.selectExpr("id AS query_id", "vector", "label"), df.selectExpr("id AS corpus_id", "vector", "label"), 4, "label")
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rn, r.corpus_id, r.cosine))
    m = np.array([d[1] for d in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids, labels = np.array([d[0] for d in data]), np.array([d[2] for d in data])
    for row, (i, _, label) in enumerate(data):
        sims = m[labels == label] @ m[row]
        best = np.sort(sims)[::-1][:4]
        assert len(found[i]) == 4
        assert np.allclose([c for _, _, c in sorted(found[i])], best, atol=1e-9)
    assert ids.shape[0] == 240


def test_portfolio_compat_equals_full_join(spark):
    rnd = random.Random(9)
    pick = lambda: rnd.choice(["b1", "b2", "b3", "b4", None])
    b = spark.createDataFrame([(str(i), pick(), rnd.choice(["o1", "o2", "o3", None])) for i in range(25)], "bbl string, bin string, owner_name string")
    dob = spark.createDataFrame([(i % 30, pick(), rnd.random() < 0.5) for i in range(40)], "id int, bin string, is_active boolean")
    hpd = spark.createDataFrame([(i % 20 or None, pick(), rnd.choice("ABC"), rnd.choice(["OPEN", "CLOSE", None])) for i in range(40)],
                                "violation_id int, bin string, violation_class string, current_status string")
    ecb = spark.createDataFrame([(pick(), float(rnd.randint(-5, 50))) for _ in range(30)], "bin string, balance_due double").withColumn("is_active", F.expr("balance_due > 0"))
    for name, df in (("b", b), ("dv", dob), ("hv", hpd), ("ecb", ecb)):
        df.createOrReplaceTempView(f"t_{name}")
    want = spark.sql("""
        SELECT b.owner_name, count(DISTINCT b.bbl) AS lots, count(DISTINCT dv.id) FILTER (WHERE dv.is_active) AS o,
               count(DISTINCT hv.violation_id) FILTER (WHERE hv.violation_class = 'C' AND hv.current_status != 'CLOSE') AS c,
               coalesce(sum(e.balance_due), 0) AS due
        FROM t_b b LEFT JOIN t_dv dv ON b.bin = dv.bin LEFT JOIN t_hv hv ON b.bin = hv.bin LEFT JOIN t_ecb e ON b.bin = e.bin AND e.is_active
        WHERE b.owner_name IS NOT NULL GROUP BY b.owner_name""")
    got = pf.owner_portfolio(b, dob, hpd, ecb).select(
        "owner_name", "total_buildings", "total_open_violations", "total_class_c_violations", "total_ecb_balance_due")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_left_spread_keeps_rows_without_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "i int, k string")
    right = spark.createDataFrame([("a", 10), (None, 99)], "k string, v int")
    assert sorted((r.i, r.v) for r in left_spread(left, right, "k", "i").collect()) == [(1, 10), (2, None), (3, None)]


def test_plans_keep_their_hash_keys(spark):
    """No nested loop anywhere, and the spread key of rows without a bin is not folded away."""
    df = spark.createDataFrame([(i,) for i in range(50)], "id bigint").selectExpr("id", "array(CAST(id AS DOUBLE), 1D) AS vector")
    top = vectors.cosine_top_n(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "corpus_id"), 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    left = spark.range(50).selectExpr("id AS i", "CASE WHEN id % 3 = 0 THEN CAST(id AS STRING) END AS k")
    plan = left_spread(left, left.selectExpr("k", "i AS v"), "k", "i")._jdf.queryExecution().executedPlan().toString()
    assert "coalesce" in plan


def test_score_steps(spark):
    rows = [(1, 2, 3, 40.0, -74.0), (2, 2, 0, 40.02, -74.0), (3, 0, 3, 40.05, -74.05), (4, 0, 0, 0.0, 0.0), (5, 0, 0, 41.0, -74.0)]
    df = spark.createDataFrame(rows, "id int, borough int, complaint_type int, lat float, lon float")
    got = [(r.id, r.score) for r in scored.scored_top_k(df, 10, "id", 2, 3, 40.0, -74.0).collect()]
    assert got == [(1, 6.0), (3, 3.5), (2, 3.0)]
    assert [r.id for r in scored.scored_top_k(df, 10, "id", 2, 0, 0.0, -74.0).collect()] == [1, 2]


def test_values_at_ends_on_infinities_nan_and_the_whole_range(spark, monkeypatch):
    from civicspark.operators import quantiles as qn

    monkeypatch.setattr(qn, "SMALL", 10)
    base = [float(i) for i in range(50)]
    for extra in ([float("inf")], [float("nan")], [-1.7e308, 1.7e308], [float("-inf"), float("nan"), float("inf"), 5e-324]):
        values = base + extra
        df = spark.createDataFrame([("g", v) for v in values], "g string, x double")
        ranks = {f"r{i}": F.lit(i) for i in range(0, len(values), 7)}
        got = {r.pick: r.v for r in qn.values_at(df, ["g"], "x", ranks).collect()}
        order = sorted(values, key=lambda v: (v != v, v))
        for name, i in ((n, int(n[1:])) for n in ranks):
            want = order[i]
            assert (got[name] != got[name] and want != want) or got[name] == want


def test_cosine_top_n_two_passes_many_pivots(spark, monkeypatch):
    """Clustered vectors over many small cells, copies among them: exact, ties by id, same by broadcast or join."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "MIN_CELL", 4)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6)) * 5
    data = [(i, (centres[i % 12] + rng.normal(size=6) * 0.2).tolist()) for i in range(300)]
    data += [(500 + i, data[3][1]) for i in range(25)] + [(900, [0.0] * 6), (901, None)]
    df = spark.createDataFrame(data, "id bigint, vector array<double>")
    q, c = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "corpus_id")
    got = {(r.query_id, r.rn): (r.corpus_id, r.cosine) for r in vectors.cosine_top_n(q, c, 3, skip_self=True).collect()}
    monkeypatch.setattr(vectors, "CELL_ROWS", 0)
    joined = {(r.query_id, r.rn): (r.corpus_id, r.cosine) for r in vectors.cosine_top_n(q, c, 3, skip_self=True).collect()}
    assert joined == got
    rows = [(i, np.array(v)) for i, v in data if v is not None]
    for i, v in rows:
        want = []
        for j, w in rows:
            if j != i:
                nv, nw = np.linalg.norm(v), np.linalg.norm(w)
                want.append((-round(float(v @ w / (nv * nw)) if nv and nw else 0.0, 9), j))
        want.sort()
        for rn, (score, j) in enumerate(want[:3], 1):
            corpus_id, cosine = got[(i, rn)]
            assert abs(cosine + score) < 1e-8
            if i in (3,) or 500 <= i < 525:  # the copies: equal scores, smaller ids first
                assert corpus_id == j
    assert not any(k[0] == 901 for k in got)


@pytest.mark.parametrize("cell_rows", [1 << 20, 0])
def test_equal_vectors_are_met_once_and_queries_once_per_block(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vectors, "SPREAD_BLOCK", 64)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    monkeypatch.setattr(vectors, "MIN_CELL", 1)
    monkeypatch.setattr(vectors, "ASKED", 100)
    seen, scan = [], vectors._scan
    monkeypatch.setattr(vectors, "_scan", lambda probes, c, *rest: seen.append((probes, c)) or scan(probes, c, *rest))
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=6).tolist(), i % 2) for i in range(300)]
    data += [(1000 + i, data[i % 2][1], i % 2) for i in range(400)]  # two vectors, 200 copies each
    df = spark.createDataFrame(data, "id bigint, vector array<double>, label int")
    got = vectors.cosine_top_n(df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "corpus_id"), 3, "label", skip_self=True)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rn, r.corpus_id))
    m = np.array([d[1] for d in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for row, (i, _, label) in enumerate(data):
        sims = np.round(np.einsum("ij,j->i", m, m[row]), 9)
        order = sorted((-sims[k], data[k][0]) for k in range(len(data)) if data[k][2] == label and data[k][0] != i)
        assert [x for _, x in sorted(found[i])] == [x for _, x in order[:3]]
    for probes, c in seen:
        assert c.count() <= 300 + 2 * 3 and probes.count() <= 300
        assert probes.select(F.max(F.size("blocks"))).first()[0] <= 3
