"""Distance operators against the plain theta join, on random points with copies, hot cells and cell edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from civicspark.functions.scalars import FEET, MILES, planar
from civicspark.operators import spatial as sp

SQUARES = [sp.Box(0.0005), sp.Box(0.003, strict=False)]


def make(spark, seed, n, hot=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and hot:  # hot cell: many distinct spots close together
            lat, lon = 40.7001 + rnd.random() * 1e-4, -74.0001 - rnd.random() * 1e-4
        elif kind == 1 and hot:  # copies of one spot
            lat, lon = 40.70015, -74.00015
        elif kind == 2:  # on cell edges and exactly one radius apart
            lat, lon = 40.7 + 0.0005 * rnd.randint(-4, 4), -74.0 + 0.0005 * rnd.randint(-4, 4)
        elif kind == 3:
            lat, lon = None, -74.0
        elif kind == 4:  # around the origin, both signs
            lat, lon = 0.0005 * rnd.randint(-3, 3), 0.001 * rnd.random() - 0.0005
        else:
            lat, lon = 40.7 + rnd.random() * 0.01 - 0.005, -74.0 + rnd.random() * 0.01 - 0.005
        rows.append((i, lat, lon, rnd.randint(0, 5)))
    return spark.createDataFrame(rows, "id int, latitude double, longitude double, day int")


@pytest.fixture(scope="module")
def frames(spark):
    queries = make(spark, 1, 240).cache()
    points = make(spark, 2, 900).cache()
    spots = sp.distinct_spots(queries).cache()
    theta = spots.crossJoin(points.where("latitude is not null and longitude is not null")).cache()
    return spots, points, theta


def hits(theta, box):
    return theta.where(f"{box.axis('qlat', 'latitude')} AND {box.axis('qlon', 'longitude')}")


def as_set(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("box", SQUARES)
def test_count_equals_theta_join(frames, box):
    spots, points, theta = frames
    want = hits(theta, box).groupBy("qlat", "qlon").agg(F.count("*").alias("n"))
    assert as_set(sp.count_within(spots, points, box), "qlat", "qlon", "n") == as_set(want, "qlat", "qlon", "n")


@pytest.mark.parametrize("box", SQUARES)
def test_latest_equals_theta_join(frames, box):
    spots, points, theta = frames
    order = ["day DESC", "id"]
    got = sp.latest_within(spots, points, box, 4, order, ["day", "id"])
    want = sp._top(hits(theta, box), "qlat, qlon", order, 4)
    assert as_set(got, "qlat", "qlon", "rn", "id") == as_set(want, "qlat", "qlon", "rn", "id")


@pytest.mark.parametrize("box", SQUARES)
@pytest.mark.parametrize("k", [1, 3])
def test_nearest_in_box_equals_theta_join(frames, box, k):
    spots, points, theta = frames
    got = sp.nearest_within(spots, points, box, k, ["id"], ["id"], FEET)
    dist = planar(F.col("latitude"), F.col("longitude"), F.col("qlat"), F.col("qlon"), FEET)
    want = sp._top(hits(theta, box).withColumn("dist", dist), "qlat, qlon", ["dist", "id"], k)
    assert as_set(got, "qlat", "qlon", "rn", "id", "dist") == as_set(want, "qlat", "qlon", "rn", "id", "dist")


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_anywhere_equals_cross_join(frames, k):
    spots, points, theta = frames
    got = sp.nearest_anywhere(spots, points, k, ["id"], ["id"], MILES)
    dist = planar(F.col("latitude"), F.col("longitude"), F.col("qlat"), F.col("qlon"), MILES)
    want = sp._top(theta.withColumn("dist", dist), "qlat, qlon", ["dist", "id"], k)
    assert as_set(got, "qlat", "qlon", "rn", "id", "dist") == as_set(want, "qlat", "qlon", "rn", "id", "dist")


def test_nearest_anywhere_with_few_or_no_sites(spark, frames):
    spots, points, _ = frames
    few = points.where("id = 5")
    assert sp.nearest_anywhere(spots, few, 3, ["id"], ["id"], MILES).count() == spots.count()
    assert sp.nearest_anywhere(spots, points.where("id < 0"), 3, ["id"], ["id"], MILES).count() == 0


def test_no_cross_join_in_plans(frames):
    spots, points, _ = frames
    box = SQUARES[0]
    for df in (
        sp.count_within(spots, points, box),
        sp.latest_within(spots, points, box, 3, ["id"], ["id"]),
        sp.nearest_within(spots, points, box, 3, ["id"], ["id"], FEET),
        sp.nearest_anywhere(spots, points, 3, ["id"], ["id"], FEET),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_hot_cell_opens_few_spots(spark):
    """10,000 distinct spots in one cell: a query that covers them opens none of them."""
    hot = spark.range(10000).select(
        (F.lit(40.70005) + F.col("id") * 1e-9).alias("latitude"), (F.lit(-74.00005) + F.col("id") * 1e-9).alias("longitude")
    )
    query = spark.createDataFrame([(40.7001, -74.0001)], "qlat double, qlon double")
    assert sp.count_within(query, hot, sp.Box(0.0005)).first()["n"] == 10000
    assert math.isclose(0.0005, sp.Box(0.0005).radius)


def test_nearest_anywhere_with_far_outlier_opens_few_pairs(spark):
    """4,000 sites crowd in a few metres and one lies across the globe: refinement follows the crowd."""
    rnd = random.Random(7)
    rows = [(i, 40.7 + rnd.random() * 1e-4, -74.0 + rnd.random() * 1e-4) for i in range(4000)] + [(4000, -33.9, 151.2)]
    sites = spark.createDataFrame(rows, "id int, latitude double, longitude double")
    asked = [(40.7 + rnd.random() * 1e-4, -74.0 + rnd.random() * 1e-4) for _ in range(50)] + [(-33.0, 150.0), (0.0, 0.0)]
    spots = spark.createDataFrame(asked, "qlat double, qlon double")
    k = 3
    pairs = sp._nearest_pairs(spots, sites, k, ["id"], ["id"], MILES).count()
    assert pairs <= len(asked) * 40 * sp.CELL_LIMIT // 4
    got = sp.nearest_anywhere(spots, sites, k, ["id"], ["id"], MILES)
    theta = spots.crossJoin(sites)
    dist = planar(F.col("latitude"), F.col("longitude"), F.col("qlat"), F.col("qlon"), MILES)
    want = sp._top(theta.withColumn("dist", dist), "qlat, qlon", ["dist", "id"], k)
    assert as_set(got, "qlat", "qlon", "rn", "id", "dist") == as_set(want, "qlat", "qlon", "rn", "id", "dist")
