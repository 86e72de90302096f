"""Distance joins between large point tables: counts, latest-k and nearest-k around query points.

No operator here pairs every query with every point, nor all members of one grid cell with each other.

* Queries and points are first reduced to distinct coordinates (map-side combined), so any number of copies at one
  spot costs one row, and a query spot asked a million times is answered once.
* Space is cut into nested square cells. Per cell only a small aggregate (count, true bounding box, best rows) is
  kept. A query meets the *aggregates* of the cells its box touches; a cell wholly inside is answered by its
  aggregate, a cell wholly outside is dropped, and only cells cut by the box edge are opened.
* An edge cell with more than ``CELL_LIMIT`` distinct spots is refined to the next finer level before it is opened.

Inside and outside are decided by evaluating the caller's own predicate on the bounding box that the cell's points
really have, so the answers equal those of the plain theta join bit for bit.

Frames of queries have (qlat, qlon); frames of points have (latitude, longitude) and any payload. Orders are SQL
texts such as ``"ts DESC"``. Expressions are SQL texts too: one call to the JVM each, instead of one per operator.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import written

LEVEL_BITS = 2  # each level splits a cell side in 4
CELL_LIMIT = 64  # distinct spots an edge cell may hold before it is refined
MAX_LEVELS = 6  # the finest cells of a box search are radius / 2048 wide
START_CELLS = 8  # cells per axis of the first level of an unbounded search: at most 9 x 9 aggregates
_BOX_COLUMNS = ["lat_lo", "lat_hi", "lon_lo", "lon_hi"]


@dataclass(frozen=True)
class Box:
    """Square around the query point, in degrees. ``strict`` is |d| < r; otherwise BETWEEN q-r AND q+r."""

    radius: float
    strict: bool = True

    @property
    def r(self) -> str:
        return f"{self.radius!r}D"

    @property
    def reach(self) -> str:
        """A shade more than the radius, for choosing cells; the exact predicate follows."""
        return f"{self.radius * 1.000001!r}D"

    def axis(self, q: str, p: str) -> str:
        if self.strict:
            return f"abs({q} - {p}) < {self.r}"
        return f"({p} >= {q} - {self.r} AND {p} <= {q} + {self.r})"

    def misses(self, q: str, low: str, high: str) -> str:
        """Every point of [low, high] lies on one side of the box."""
        if self.strict:
            return f"({q} - {high} >= {self.r} OR {low} - {q} >= {self.r})"
        return f"({high} < {q} - {self.r} OR {low} > {q} + {self.r})"

    @property
    def hit(self) -> str:
        return f"{self.axis('qlat', 'plat')} AND {self.axis('qlon', 'plon')}"


@dataclass(frozen=True)
class Grid:
    """Nested cells; level 0 is the coarsest, ``levels - 1`` the finest with cells of ``side`` degrees."""

    side: float
    levels: int

    @staticmethod
    def around(radius: float) -> "Grid":
        return Grid(radius / 2 / 2 ** (LEVEL_BITS * (MAX_LEVELS - 1)), MAX_LEVELS)

    def fine(self, x: str) -> str:
        return f"CAST(floor(({x}) / {self.side!r}D) AS BIGINT)"

    def up(self, fine: str, level: int) -> str:
        return f"shiftright({fine}, {LEVEL_BITS * (self.levels - 1 - level)})"

    def cell(self, x: str, level: int) -> str:
        return self.up(self.fine(x), level)


def distinct_spots(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Distinct usable coordinates as (qlat, qlon)."""
    spots = df.selectExpr(f"{lat} AS qlat", f"{lon} AS qlon").where("qlat IS NOT NULL AND qlon IS NOT NULL")
    return spots.distinct()


def _top(df: DataFrame, keys: str, order: list[str], k: int, rank: str = "rn") -> DataFrame:
    """First k rows per key. Spark limits each map task's groups before the shuffle, so hot keys stay small."""
    ranked = df.selectExpr("*", f"row_number() OVER (PARTITION BY {keys} ORDER BY {', '.join(order)}) AS {rank}")
    return ranked.where(f"{rank} <= {k}")


def _best_spots(points: DataFrame, grid: Grid | None, order: list[str], k: int, payload: list[str]) -> DataFrame:
    """At most k rows per distinct coordinate: no other row can be among the first k of any query."""
    rows = points.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    rows = _top(rows.selectExpr("latitude AS plat", "longitude AS plon", *payload), "plat, plon", order, k).drop("rn")
    return rows if grid is None else _with_fine(rows, grid)


def _with_fine(spots: DataFrame, grid: Grid) -> DataFrame:
    return spots.selectExpr("*", f"{grid.fine('plat')} AS fi", f"{grid.fine('plon')} AS fj")


def _at(spots: DataFrame, grid: Grid, level: int, *columns: str) -> DataFrame:
    return spots.selectExpr(f"{grid.up('fi', level)} AS ci", f"{grid.up('fj', level)} AS cj", *columns)


def _cells(spots: DataFrame, grid: Grid, level: int, weight: str = "1") -> DataFrame:
    """Aggregate per non-empty cell: rows, weight and the bounding box of its points."""
    return _at(spots, grid, level, "plat", "plon", f"{weight} AS pw").groupBy("ci", "cj").agg(
        F.expr("count(1) AS n"), F.expr("sum(pw) AS w"), F.expr("min(plat) AS lat_lo"), F.expr("max(plat) AS lat_hi"),
        F.expr("min(plon) AS lon_lo"), F.expr("max(plon) AS lon_hi"),
    )


def _depth(spots: DataFrame, grid: Grid) -> int:
    """Levels needed until no cell holds more than CELL_LIMIT rows.

    All levels are counted in one job from one roll-up of the finest cells: each finest cell stands once per level
    under its parent there, and the driver reads one maximum per level.
    """
    finest = spots.groupBy("fi", "fj").agg(F.expr("count(1) AS n"))
    shift = f"{LEVEL_BITS} * ({grid.levels - 1} - level)"
    per_level = finest.selectExpr("fi", "fj", "n", f"explode(sequence(0, {grid.levels - 1})) AS level").selectExpr(
        "level", f"shiftright(fi, {shift}) AS ci", f"shiftright(fj, {shift}) AS cj", "n"
    )
    cells = per_level.groupBy("level", "ci", "cj").agg(F.expr("sum(n) AS n"))
    fullest = dict(cells.groupBy("level").agg(F.expr("max(n) AS m")).collect())  # one row per level
    for level in range(grid.levels):
        if (fullest.get(level) or 0) <= CELL_LIMIT:
            return level + 1
    return grid.levels


def _near_queries(points: DataFrame, queries: DataFrame, grid: Grid, box: Box) -> DataFrame:
    """Points in a coarsest cell that the box of some query touches: no other point can be in any box."""
    touched = _touched(queries, grid, box).selectExpr("ci AS _ci", "cj AS _cj").distinct()
    placed = points.selectExpr("*", f"{grid.cell('latitude', 0)} AS _ci", f"{grid.cell('longitude', 0)} AS _cj")
    return placed.join(touched, ["_ci", "_cj"], "left_semi").drop("_ci", "_cj")


def _touched(queries: DataFrame, grid: Grid, box: Box, *extra: str) -> DataFrame:
    """Level-0 cells that the box of each query may touch (emptiness is sorted out by the join)."""

    def span(x: str) -> str:
        return f"sequence({grid.cell(f'{x} - {box.reach}', 0)}, {grid.cell(f'{x} + {box.reach}', 0)})"

    rows = queries.selectExpr("qlat", "qlon", *extra, f"explode({span('qlat')}) AS ci")
    return rows.selectExpr("*", f"explode({span('qlon')}) AS cj")


def _children(frontier: DataFrame, box: Box, grid: Grid, level: int, *extra: str) -> DataFrame:
    """Cells of ``level + 1`` under the given cells, cut to the box."""

    def span(x: str, cell: str) -> str:
        first = f"greatest(shiftleft({cell}, {LEVEL_BITS}), {grid.cell(f'{x} - {box.reach}', level + 1)})"
        last = f"least(shiftleft({cell}, {LEVEL_BITS}) + {2**LEVEL_BITS - 1}, {grid.cell(f'{x} + {box.reach}', level + 1)})"
        return f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}) END"

    rows = frontier.selectExpr("qlat", "qlon", *extra, f"explode({span('qlat', 'ci')}) AS ki", "cj")
    return rows.selectExpr("qlat", "qlon", *extra, "ki AS ci", f"explode({span('qlon', 'cj')}) AS kj").selectExpr(
        "qlat", "qlon", *extra, "ci", "kj AS cj"
    )


def _classify(frontier: DataFrame, cells: DataFrame, box: Box, last: bool) -> DataFrame:
    """Join with the cell aggregates; kind 0 = inside, 1 = open the cell, 2 = refine it."""
    inside = " AND ".join(
        [box.axis("qlat", "lat_lo"), box.axis("qlat", "lat_hi"), box.axis("qlon", "lon_lo"), box.axis("qlon", "lon_hi")]
    )
    outside = f"{box.misses('qlat', 'lat_lo', 'lat_hi')} OR {box.misses('qlon', 'lon_lo', 'lon_hi')}"
    edge = "1" if last else f"CASE WHEN n <= {CELL_LIMIT} THEN 1 ELSE 2 END"
    met = frontier.join(cells, ["ci", "cj"]).where(f"NOT ({outside})")
    return met.selectExpr("*", f"CASE WHEN {inside} THEN 0 ELSE {edge} END AS kind")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def count_within(queries: DataFrame, points: DataFrame, box: Box) -> DataFrame:
    """Points in the box of each distinct query spot: (qlat, qlon, n), spots without a hit are absent.

    Equal to counting the theta join.
    """
    grid = Grid.around(box.radius)
    spots = (
        _near_queries(points.where("latitude IS NOT NULL AND longitude IS NOT NULL"), queries, grid, box)
        .selectExpr("latitude AS plat", "longitude AS plon").groupBy("plat", "plon").agg(F.expr("count(1) AS pw"))
    )
    spots = written(_with_fine(spots, grid), "spots")
    parts = []
    levels = _depth(spots, grid)
    frontier = _touched(queries, grid, box)
    for level in range(levels):
        last = level == levels - 1
        met = _classify(frontier, _cells(spots, grid, level, "pw"), box, last)
        # Two branches, not one outer join: an inside cell must not meet its own spots, however many they are.
        parts.append(met.where("kind = 0").select("qlat", "qlon", "w"))
        opened = met.where("kind = 1").select("qlat", "qlon", "ci", "cj")
        opened = opened.join(_at(spots, grid, level, "plat", "plon", "pw"), ["ci", "cj"])
        parts.append(opened.where(box.hit).selectExpr("qlat", "qlon", "pw AS w"))
        if not last:
            frontier = _children(met.where("kind = 2"), box, grid, level)
    return _union(parts).groupBy("qlat", "qlon").agg(F.expr("sum(w) AS n"))


def latest_within(queries: DataFrame, points: DataFrame, box: Box, k: int, order: list[str], payload: list[str]) -> DataFrame:
    """First k points by ``order`` in the box of each distinct query spot: (qlat, qlon, rn, payload...).

    Only k rows per spot and k rows per cell can ever be among the first k, so each is cut to k before any join;
    before that, points outside every cell that some query's box touches are left out by a semi-join.
    """
    grid = Grid.around(box.radius)
    near = _near_queries(points.where("latitude IS NOT NULL AND longitude IS NOT NULL"), queries, grid, box)
    spots = written(_best_spots(near, grid, order, k, payload), "spots")
    parts = []
    levels = _depth(spots, grid)
    frontier = _touched(queries, grid, box)
    for level in range(levels):
        last = level == levels - 1
        met = _classify(frontier, _cells(spots, grid, level), box, last)
        celled = _at(spots, grid, level, "plat", "plon", *payload)
        whole = _top(celled, "ci, cj", order, k).drop("rn").selectExpr("*", "0 AS kind")
        sides = whole.unionByName(celled.selectExpr("*", "1 AS kind"))
        parts.append(
            met.where("kind < 2").select("qlat", "qlon", "ci", "cj", "kind").join(sides, ["ci", "cj", "kind"])
            .where(f"kind = 0 OR ({box.hit})").select("qlat", "qlon", *payload)
        )
        if not last:
            frontier = _children(met.where("kind = 2"), box, grid, level)
    return _top(_union(parts), "qlat, qlon", order, k)


def _length(dlat: str, dlon: str, scale: tuple[float, float]) -> str:
    return f"sqrt(pow(({dlat}) * {scale[0]!r}D, 2) + pow(({dlon}) * {scale[1]!r}D, 2))"


def _near(scale: tuple[float, float], c: str = "") -> str:
    """Distance from the query to the nearest point of a cell's bounding box."""
    gap = "greatest({c}{a}_lo - q{a}, q{a} - {c}{a}_hi, 0D)"
    return _length(gap.format(a="lat", c=c), gap.format(a="lon", c=c), scale)


def _far(scale: tuple[float, float], c: str = "") -> str:
    """Distance from the query to the farthest corner of a cell's bounding box."""
    gap = "greatest(abs(q{a} - {c}{a}_lo), abs(q{a} - {c}{a}_hi))"
    return _length(gap.format(a="lat", c=c), gap.format(a="lon", c=c), scale)


_KEEP = "near_d <= bound * 1.000001D + 1e-9D"


def _prune(met: DataFrame, k: int, scale: tuple[float, float], sure: str) -> DataFrame:
    """Drop cells that cannot hold one of the k nearest.

    ``bound`` is a distance within which k points are known to lie: cells sorted by their far corner, rows summed
    until k are reached. A query meets a bounded number of cells, so the window partition is bounded too.
    """
    inf = "double('infinity')"
    met = met.selectExpr("*", f"{_near(scale)} AS near_d", f"CASE WHEN {sure} THEN {_far(scale)} ELSE {inf} END AS far_d")
    met = met.selectExpr("*", "sum(n) OVER (PARTITION BY qlat, qlon ORDER BY far_d ROWS UNBOUNDED PRECEDING) AS cum")
    reached = f"min(CASE WHEN cum >= {k} THEN far_d ELSE {inf} END) OVER (PARTITION BY qlat, qlon)"
    met = met.selectExpr("* EXCEPT (bound, cum)", f"least(bound, {reached}) AS bound")
    return met.where(_KEEP)


def nearest_within(
    queries: DataFrame, sites: DataFrame, box: Box, k: int, order: list[str], payload: list[str], scale: tuple[float, float]
) -> DataFrame:
    """The k nearest sites inside the box of each distinct query spot: (qlat, qlon, rn, dist, payload...).

    ``order`` breaks ties of equal distance. Cells are opened only if no k nearer sites are already certain.
    """
    grid = Grid.around(box.radius)
    near = _near_queries(sites.where("latitude IS NOT NULL AND longitude IS NOT NULL"), queries, grid, box)
    spots = written(_best_spots(near, grid, order, k, payload), "sites")
    parts = []
    levels = _depth(spots, grid)
    dist = _length("plat - qlat", "plon - qlon", scale)
    frontier = _touched(queries, grid, box, "double('infinity') AS bound")
    for level in range(levels):
        last = level == levels - 1
        met = _prune(_classify(frontier, _cells(spots, grid, level), box, last), k, scale, "kind = 0")
        small = "true" if last else f"n <= {CELL_LIMIT}"
        parts.append(
            met.where(small).select("qlat", "qlon", "ci", "cj")
            .join(_at(spots, grid, level, "plat", "plon", *payload), ["ci", "cj"]).where(box.hit)
            .selectExpr("qlat", "qlon", f"{dist} AS dist", *payload)
        )
        if not last:
            frontier = _children(met.where(f"NOT ({small})"), box, grid, level, "bound")
    return _top(_union(parts), "qlat, qlon", ["dist", *order], k)


def _start(queries: DataFrame, start: list, k: int, scale: tuple[float, float]) -> DataFrame:
    """Pair each query with the start cells that may hold one of its k nearest, by array functions in its own row."""
    rows = ", ".join(
        f"struct({r.ci}L AS ci, {r.cj}L AS cj, {r.n}L AS n, "
        + ", ".join(f"{getattr(r, c)!r}D AS {c}" for c in _BOX_COLUMNS) + ")"
        for r in start
    )
    measured = f"struct({_far(scale, 's.')} AS far_d, {_near(scale, 's.')} AS near_d, s.n AS n, s.ci AS ci, s.cj AS cj)"
    met = queries.selectExpr("qlat", "qlon", f"transform(array({rows}), s -> {measured}) AS cells")
    bound = f"""aggregate(array_sort(cells), struct(0L AS seen, 0D AS d),
        (acc, c) -> CASE WHEN acc.seen < {k} THEN struct(acc.seen + c.n AS seen, c.far_d AS d) ELSE acc END,
        acc -> CASE WHEN acc.seen >= {k} THEN acc.d ELSE double('infinity') END)"""
    met = met.selectExpr("*", f"{bound} AS bound")
    met = met.selectExpr("qlat", "qlon", "bound", f"explode(filter(cells, c -> c.{_KEEP})) AS c")
    return met.selectExpr("qlat", "qlon", "bound", "c.ci", "c.cj", "c.n")


def nearest_anywhere(
    queries: DataFrame, sites: DataFrame, k: int, order: list[str], payload: list[str], scale: tuple[float, float]
) -> DataFrame:
    """The k nearest sites of each distinct query spot, however far: (qlat, qlon, rn, dist, payload...).

    Top-down search over cells refined by occupancy. Two small facts are read first: one row with the extent of the
    sites, and one row per start cell (at most 9 x 9 by construction), which become constants of the plan and are
    pruned inside each query row. A met cell with at most CELL_LIMIT spots is opened; a fuller one is replaced by its
    children, and only the spots under such cells are counted at the next level. This goes on while any met cell is
    too full, down to cells whose indices doubles still tell apart (DEEPEST levels at most), where what is left is
    opened as it is: sites that close are, for any purpose, one spot. A far outlier widens the start cells but only
    adds levels where sites crowd, so no query meets a crowd at once.
    """
    return _top(_nearest_pairs(queries, sites, k, order, payload, scale), "qlat, qlon", ["dist", *order], k)


DEEPEST = 24  # levels below the start cells at most


def _nearest_pairs(
    queries: DataFrame, sites: DataFrame, k: int, order: list[str], payload: list[str], scale: tuple[float, float]
) -> DataFrame:
    """Every (query, site) pair that the search opens, with its distance: the candidates of :func:`nearest_anywhere`."""
    spots = written(_best_spots(sites, None, order, k, payload), "sites")
    extent = spots.selectExpr(
        "count(1) AS n", "min(plat) AS a", "max(plat) AS b", "min(plon) AS c", "max(plon) AS d"
    ).first()
    if not extent.n:
        none = spots.selectExpr("plat AS qlat", "plon AS qlon", "0D AS dist", *payload)
        return none.limit(0)
    side = max(extent.b - extent.a, extent.d - extent.c, 1e-6) / START_CELLS
    biggest = max(abs(extent.a), abs(extent.b), abs(extent.c), abs(extent.d), side)
    # the finest cells stay above 2^-50 of the largest coordinate: their indices are exact in doubles and longs
    room = int(math.floor(math.log(side * 2.0**50 / biggest, 2**LEVEL_BITS)))
    extra = max(0, min(DEEPEST, room))
    grid = Grid(side / 2 ** (LEVEL_BITS * extra), extra + 1)
    spots = written(_with_fine(spots, grid), "sites-fine")
    start = _cells(spots, grid, 0).collect()  # <= (START_CELLS + 1)^2 rows
    dist = _length("plat - qlat", "plon - qlon", scale)
    met = _start(queries, start, k, scale)
    parts, level = [], 0
    while True:
        last = level == grid.levels - 1
        if level:
            met = _prune(met, k, scale, "true")
        # the cells met per query are few; writing them keeps each level's plan to one step
        met = written(met, "nearest-met")
        small = "true" if last else f"n <= {CELL_LIMIT}"
        parts.append(
            met.where(small).select("qlat", "qlon", "ci", "cj")
            .join(_at(spots, grid, level, "plat", "plon", *payload), ["ci", "cj"])
            .selectExpr("qlat", "qlon", f"{dist} AS dist", *payload)
        )
        crowded = met.where(f"NOT ({small})")
        if last or crowded.isEmpty():
            break
        dense = crowded.select("ci", "cj").distinct()
        under = _at(spots, grid, level, "fi", "fj", "plat", "plon").join(dense, ["ci", "cj"]).drop("ci", "cj")
        finer = _cells(under, grid, level + 1).selectExpr(
            "* EXCEPT (w)", f"shiftright(ci, {LEVEL_BITS}) AS pi", f"shiftright(cj, {LEVEL_BITS}) AS pj"
        )
        above = crowded.selectExpr("qlat", "qlon", "bound", "ci AS pi", "cj AS pj")
        met = above.join(finer, ["pi", "pj"]).drop("pi", "pj")
        level += 1
    return _union(parts)
