"""Entity resolution for a table of requests, and address search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FEET
from ..operators import spatial as sp
from ..operators.ranking import first_per_key
from ..operators.staging import together, written
from ..operators.substring import containing, shortest_containing

NEAR_BOX = sp.Box(500 / 364000.0, strict=False)
STAGES = ["bbl", "bin", "address", "part of address", "nearest"]


def resolve(requests: DataFrame, buildings: DataFrame, columns: list[str]) -> DataFrame:
    """(request_id, stage, bbl, columns...) for each request that any stage can answer.

    Stages in order: bbl, bin, exact upper-cased address, shortest address that contains the text, nearest building in
    a 500 ft box. The lowest stage wins; within a stage the smallest bbl. The three key lookups
    run first; the address search and the nearest building, the dear stages, run side by side and only for the
    requests the lookups left open. Every stage looks up a
    table reduced to one row per key, so requests never multiply; rows with the same request_id are one request. A
    latitude or longitude of 0 counts as missing. A request's borough cannot change the outcome: a borough-less search
    that found nothing contains every search with a borough. Both frames are read several times: pass tables, or write
    a long plan first.
    """
    req = requests.selectExpr("request_id", "bbl AS r_bbl", "bin AS r_bin", "upper(trim(address)) AS r_addr",
                              "latitude AS qlat", "longitude AS qlon")
    req = req.where("r_bbl IS NOT NULL OR r_bin IS NOT NULL OR r_addr IS NOT NULL OR qlat IS NOT NULL")
    keep = [c for c in columns if c not in ("bbl", "latitude", "longitude")]
    body = ", ".join(["bbl", "latitude", "longitude", *keep])
    rows = buildings.selectExpr(f"struct({body}) AS b", "bbl", "bin", "address", "latitude", "longitude", "upper(address) AS addr")

    def per_key(key: str, order: list[str]) -> DataFrame:
        known = rows.where(f"{key} IS NOT NULL AND {key} != ''")
        return first_per_key(known, [key], order).selectExpr(f"{key} AS k", "b")

    def equal(stage: int, column: str, table: DataFrame) -> DataFrame:
        asked = req.where(f"{column} IS NOT NULL AND {column} != ''").selectExpr("request_id", f"{column} AS k")
        return asked.join(table, "k").selectExpr("request_id", f"{stage} AS stage", "b")

    def lowest(hits: DataFrame) -> DataFrame:
        return hits.groupBy("request_id").agg(F.expr("min_by(b, stage) AS b"), F.expr("min(stage) AS stage"))

    def still_open(asked: DataFrame, answered: DataFrame) -> DataFrame:
        done = answered.select(F.col("request_id").alias("_done"))
        return asked.join(done, asked["request_id"].eqNullSafe(done["_done"]), "left_anti")

    by_address = per_key("addr", ["bbl"])
    exact = [equal(1, "r_bbl", per_key("bbl", ["bin"])), equal(2, "r_bin", per_key("bin", ["bbl"])), equal(3, "r_addr", by_address)]
    answered = [written(lowest(reduce(lambda a, b: a.unionByName(b), exact)), "resolved-keys")]

    # stages 4 and 5, side by side, only for requests the key lookups left open: addresses that contain the text
    # (for patterns that are no address themselves) and the nearest building
    req = still_open(req, answered[0])
    patterns = req.selectExpr("r_addr AS pattern").where("pattern IS NOT NULL AND pattern != ''").distinct()
    open_patterns = patterns.join(by_address.selectExpr("k AS pattern"), "pattern", "left_anti")
    placed = req.where("qlat != 0 AND qlon != 0").select("request_id", "qlat", "qlon")
    sites = rows.where("latitude IS NOT NULL AND latitude != 0").select("latitude", "longitude", "b")
    pairs, near = together(
        lambda: shortest_containing(open_patterns, by_address.selectExpr("k AS entry"), 1),
        lambda: sp.nearest_within(placed.select("qlat", "qlon").distinct(), sites, NEAR_BOX, 1, ["b.bbl"], ["b"], FEET),
    )
    # Equal addresses share their length, so the smallest bbl per address is enough to break ties.
    best = pairs.join(by_address, pairs["entry"] == by_address["k"]).selectExpr(
        "pattern", "struct(length(b.address) AS l, b.bbl AS i) AS o", "b"
    )
    by_part = best.groupBy("pattern").agg(F.expr("min_by(b, o) AS b")).selectExpr("pattern AS k", "b")
    nearest = placed.join(near.select("qlat", "qlon", "b"), ["qlat", "qlon"]).selectExpr("request_id", "5 AS stage", "b")
    answered.append(lowest(equal(4, "r_addr", by_part).unionByName(nearest)))
    won = reduce(lambda a, b: a.unionByName(b), answered)
    return won.selectExpr("request_id", "stage", "b.*")


def search_address(buildings: DataFrame, text: str, borough: str | None = None, limit: int = 10) -> DataFrame:
    """Buildings whose address contains the text (% and _ are wildcards), shortest address first."""
    found = buildings.where(F.upper("address").like(f"%{text.upper()}%"))
    if borough:
        found = found.where(F.upper("borough") == borough.upper())
    columns = [c for c in ("bbl", "bin", "address", "borough", "zipcode", "latitude", "longitude") if c in found.columns]
    return found.orderBy(F.length("address"), "bbl").limit(limit).select(*columns)


def search_many(searches: DataFrame, buildings: DataFrame, limit: int = 10) -> DataFrame:
    """Address search for a table of (search_id, text, borough): (search_id, rn, bbl, address)."""
    asked = searches.selectExpr("search_id", "upper(text) AS pattern", "upper(borough) AS wanted")
    entries = buildings.where("address IS NOT NULL").selectExpr("upper(address) AS entry").distinct()
    patterns = asked.select("pattern").where("pattern IS NOT NULL AND pattern != ''").distinct()
    pairs = containing(patterns, entries)
    # Of equal addresses in one borough no more than `limit` can be shown.
    rows = buildings.selectExpr("upper(address) AS entry", "upper(borough) AS boro", "bbl", "address")
    rows = first_per_key(rows, ["entry", "boro"], ["bbl"], limit).drop("rn")
    hits = pairs.join(rows, "entry")
    in_pattern = first_per_key(hits, ["pattern", "boro"], ["length(address)", "bbl"], limit).drop("rn")
    out = asked.join(in_pattern, "pattern").where("wanted IS NULL OR boro = wanted")
    return first_per_key(out, ["search_id"], ["length(address)", "bbl"], limit).select("search_id", "rn", "bbl", "address")
