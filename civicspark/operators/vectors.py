"""Exact cosine top-n between two large vector tables.

Equal vectors are met once: of the corpus rows with one vector (and filter value) only the n smallest ids can be among
the n best, and queries with one vector share one search. About sqrt(rows) corpus vectors are drawn as pivots (at most
``PIVOTS``, and no more than ``PIVOT_BYTES`` of them) and every corpus vector is assigned to its nearest pivot; a cell
holds the vectors of one pivot and one filter value. Neighbouring cells of a filter value are put together into blocks
of about ``BLOCK`` rows, the unit in which rows meet. A query is answered in two passes. The first compares it with the
blocks of its nearest cells that hold n rows, which gives a true n-th best cosine; the second compares it only with the
other blocks that have a cell whose best possible cosine (triangle inequality on angles) reaches that bound. Compared
rows go block against block as matrix products of at most ``PRODUCT`` numbers; a block hands on at most n rows per
query. So no pair is ever a row, a query is sent once per block (not per cell), and no pivot, however crowded, lands in
one task. The table of cells reaches the tasks as a broadcast when it has at most ``CELL_ROWS`` rows (a checked size),
else it meets the queries by filter value. The pivots decide only how much is compared: results are exact either way.

Memory of a task: two blocks of vectors (each at most about ``BLOCK_BYTES`` as doubles), one product, and angles of at
most ``PRODUCT`` numbers; which blocks a query meets is a list of whole numbers.

Ties: the cosines handed on are computed again pair by pair with one formula and rounded to ``PLACES`` places, so that
equal vectors score equally in whichever block they meet; equal scores end by the smaller corpus id. Rows without a
vector, or whose filter value is null, take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import written

PIVOTS = 1 << 16  # upper bound on the number of pivots; about sqrt(rows) are drawn
PIVOT_BYTES = 32 << 20  # the pivots, shipped to every task as one broadcast, stay below this
MIN_CELL = 256  # a cell of fewer rows is not worth a pivot of its own
CELL_ROWS = 1 << 20  # the table of cells is broadcast up to this many rows, else joined by filter value
BLOCK = 32768  # rows of a block, if their vectors fit into BLOCK_BYTES
BLOCK_BYTES = 16 << 20
SPREAD_BLOCK = 1024  # small tables are cut into smaller blocks, down to this, so that all cores have some
PRODUCT = 1 << 21  # numbers of a matrix product or a table of angles held at once
ASKED = 4096  # queries that meet the cells of their filter value in one task, if these are joined
SLACK = 1e-6
TIE = 1e-9  # cosines this close to the n-th of a block are re-scored too
PLACES = 12
GATHER_BYTES = 16 << 20  # re-scoring gathers at most this much of vectors at once


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of a list column as rows of unit length (zero stays zero)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    m = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _side_by_side(pivots: np.ndarray) -> np.ndarray:
    """Pivots ordered so that neighbours in number lie near each other: by the nearest of a few, then by the angle."""
    few = pivots[: math.isqrt(len(pivots)) + 1]
    step = max(1, PRODUCT // len(few))
    best, angle = np.zeros(len(pivots), int), np.zeros(len(pivots))
    for at in range(0, len(pivots), step):
        part = _angles(pivots[at:at + step], few)
        best[at:at + step], angle[at:at + step] = part.argmin(axis=1), part.min(axis=1)
    return pivots[np.lexsort((angle, best))]


def _best_of_block(qs: pa.Table, cs: pa.Table, k: int) -> pa.Table:
    """The k best corpus rows of each query in one block: matrix products to find them, one formula per pair to score."""
    cs = cs.sort_by("corpus_id")
    qu, cu = _unit(qs["vector"]), _unit(cs["vector"])
    bound = _numbers(qs["bound"])
    bound = np.where(np.isnan(bound), -np.inf, bound)
    k = min(k, len(cu))
    gather = max(1, GATHER_BYTES // (16 * max(1, qu.shape[1])))
    step = max(1, PRODUCT // max(1, len(cu)))
    out = []
    for at in range(0, len(qu), step):
        part = qu[at:at + step]
        sims = part @ cu.T
        least = bound[at:at + step]
        # A bound from the first pass may leave few; only rows that it leaves more than k need the k-th of the block.
        many = np.count_nonzero(sims >= (least - TIE)[:, None], axis=1) > k
        if many.any():
            kth = np.partition(sims[many], sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
            least = least.copy()
            least[many] = np.maximum(least[many], kth)
        rows, cols = np.nonzero(sims >= (least - TIE)[:, None])
        exact = np.zeros(len(rows))
        for i in range(0, len(rows), gather):
            exact[i:i + gather] = np.einsum("ij,ij->i", part[rows[i:i + gather]], cu[cols[i:i + gather]])
        exact = np.round(exact, PLACES)
        order = np.lexsort((cols, -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        out.append((rows[keep] + at, cols[keep], exact[keep]))
    rows, cols, exact = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return pa.table({"probe": qs["probe"].take(rows), "corpus_id": cs["corpus_id"].take(cols), "cosine": pa.array(exact)})


def _scan(probes: DataFrame, c: DataFrame, need: int, per_block: int, id_type: str) -> DataFrame:
    """Compare each probe (probe, vector, tag, bound, blocks) with the rows of its blocks."""
    group = ["tag", "block", "part", "slice"]
    probes = probes.select("probe", "vector", "tag", "bound", F.explode("blocks").alias("block"))
    parts = c.select("tag", "block", "parts").distinct()
    load = probes.groupBy("tag", "block").agg(F.count(F.lit(1)).alias("asked")).join(parts, ["tag", "block"])
    plan = load.select("tag", "block", "parts", F.ceil(F.col("asked") / F.lit(per_block)).cast("int").alias("slices"))
    left = probes.join(plan, ["tag", "block"]).withColumn("slice", F.pmod(F.xxhash64("probe"), F.col("slices")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = c.drop("parts").join(plan.select("tag", "block", "slices"), ["tag", "block"])
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    left, right = left.select("probe", "vector", "bound", *group), right.select("corpus_id", "vector", *group)
    schema = f"probe bigint, corpus_id {id_type}, cosine double"

    def compare(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if qs.num_rows and cs.num_rows:
            return _best_of_block(qs, cs, need)
        return pa.table({"probe": pa.array([], pa.int64()), "corpus_id": cs["corpus_id"].slice(0, 0), "cosine": pa.array([], pa.float64())})

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, schema)


class _Cells:
    """Cells of one filter value, by block: pivot, rows, spread and block of each."""

    def __init__(self, pivot, size, spread, block):
        self.pivot, self.size, self.spread, self.block = (np.asarray(x) for x in (pivot, size, spread, block))
        self.start = np.flatnonzero(np.r_[True, self.block[1:] != self.block[:-1]]) if len(self.block) else np.zeros(0, int)

    def near(self, angles: np.ndarray, need: int) -> np.ndarray:
        """Per query and block: does it hold one of the nearest cells that hold ``need`` rows (all, if fewer)?"""
        order = np.argsort(angles, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        wanted = np.zeros(angles.shape, bool)
        np.put_along_axis(wanted, order, before < need, axis=1)
        return np.logical_or.reduceat(wanted, self.start, axis=1)

    def reached(self, angles: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Per query and block: can a cell of it hold a cosine that reaches the bound?"""
        reach = np.where(np.isnan(bound), np.pi, np.arccos(np.clip(bound, -1.0, 1.0)))
        far = np.maximum(0.0, angles - self.spread) > reach[:, None] + SLACK
        return np.logical_or.reduceat(~far, self.start, axis=1)

    def blocks(self, angles: np.ndarray, bound: np.ndarray | None, need: int) -> list[np.ndarray]:
        """Blocks that each query meets in the first pass, or in the second if the bounds are given."""
        angles = angles[:, self.pivot]
        met = self.near(angles, need)
        if bound is not None:
            met = self.reached(angles, bound) & ~met
        ids = self.block[self.start].astype(np.int32)
        return [ids[row] for row in met]


def _listed(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32()))


def _with_blocks(batch, blocks: list[np.ndarray]):
    keep = [batch.column(n) for n in ("probe", "vector", "tag", "bound")]
    keep = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in keep]
    return pa.RecordBatch.from_arrays([*keep, _listed(blocks)], ["probe", "vector", "tag", "bound", "blocks"])


def _numbers(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def cosine_top_n(
    queries: DataFrame, corpus: DataFrame, n: int, filter_column: str | None = None, id_type: str = "bigint",
    skip_self: bool = False,
) -> DataFrame:
    """(query_id, corpus_id, cosine, rn) for the n most similar corpus rows of each query; ties by id.

    ``queries`` has (query_id, vector[, filter]), ``corpus`` has (corpus_id, vector[, filter]). With a filter column
    only rows of equal value are compared.
    """
    spark = queries.sparkSession
    tag = filter_column or "_all"
    # Without a filter every row has tag 0, written so that the optimizer cannot fold the tag away.
    q = queries if filter_column else queries.withColumn(tag, F.expr("int(isnull(query_id))"))
    c = corpus if filter_column else corpus.withColumn(tag, F.expr("int(isnull(corpus_id))"))
    q = q.where(F.col("vector").isNotNull() & F.col(tag).isNotNull()).select("query_id", "vector", F.col(tag).alias("tag"))
    c = c.where(F.col("vector").isNotNull() & F.col(tag).isNotNull()).select("corpus_id", "vector", F.col(tag).alias("tag"))
    tag_type = c.schema["tag"].dataType.simpleString()
    vec_type = c.schema["vector"].dataType.simpleString()
    need = n + 1 if skip_self else n

    # Of equal vectors the ``need`` smallest ids: cut in each map task before the shuffle, so copies do not gather.
    copies = Window.partitionBy("tag", "vector").orderBy("corpus_id")
    c = written(c.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= need).drop("_copy"), "corpus")
    facts = c.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("dim")).first()  # one row
    rows, dim = facts["rows"], max(1, facts["dim"] or 1)
    wanted = max(1, min(PIVOTS, math.isqrt(rows) + 1, -(-rows // MIN_CELL), PIVOT_BYTES // (8 * dim)))
    chosen = c.select("vector").orderBy(F.xxhash64("corpus_id"), "corpus_id").limit(wanted).toArrow()  # <= wanted rows
    if not chosen.num_rows:
        return q.limit(0).select(
            "query_id", F.lit(None).cast(id_type).alias("corpus_id"), F.lit(0.0).alias("cosine"), F.lit(1).alias("rn")
        )
    pivots = spark.sparkContext.broadcast(_side_by_side(_unit(chosen["vector"])))
    step = max(1, PRODUCT // chosen.num_rows)
    cores = max(1, spark.sparkContext.defaultParallelism)
    per_block = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim), max(SPREAD_BLOCK, rows // cores)))

    def assign(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                angle = _angles(_unit(batch.column("vector")), pivots.value)
                best = angle.argmin(axis=1)
                near = angle[np.arange(len(best)), best]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x) for x in ("corpus_id", "vector", "tag")), pa.array(best.astype(np.int32)), pa.array(near)],
                    ["corpus_id", "vector", "tag", "cell", "angle"])

    c = written(c.select("corpus_id", "vector", "tag").mapInArrow(
        assign, f"corpus_id {id_type}, vector {vec_type}, tag {tag_type}, cell int, angle double"), "assigned")
    cells = c.groupBy("tag", "cell").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("spread"))
    # Neighbouring cells make a block; one that is still too large (a crowded cell) is cut by a hash of the ids. The
    # windows are over the cells of a filter value, at most one per pivot.
    upto = Window.partitionBy("tag").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("block", F.floor((F.sum("size").over(upto) - F.col("size")) / F.lit(per_block)).cast("int"))
    cells = written(cells.withColumn("rows", F.sum("size").over(Window.partitionBy("tag", "block"))), "cells")
    parts = F.ceil(F.col("rows") / F.lit(per_block)).cast("int")
    c = c.join(cells.select("tag", "cell", "block", parts.alias("parts")), ["tag", "cell"])
    c = written(c.select(
        "corpus_id", "vector", "tag", "block", F.pmod(F.xxhash64("corpus_id"), F.col("parts")).cast("int").alias("part"),
        "parts"), "blocks")

    # Queries with one vector are one probe.
    probes = q.select("tag", "vector").distinct().withColumn("probe", F.monotonically_increasing_id())
    probes = written(probes.withColumn("bound", F.lit(None).cast("double")), "probes")
    members = written(q.join(probes.drop("bound"), ["tag", "vector"]).select("query_id", "probe"), "members")
    asked_type = {x: q.schema[x].dataType.simpleString() for x in ("vector", "tag")}
    probe_type = f"probe bigint, vector {asked_type['vector']}, tag {asked_type['tag']}, bound double, blocks array<int>"
    few = cells.count() <= CELL_ROWS
    if few:  # checked size: at most CELL_ROWS rows of five numbers
        lines = cells.select(F.col("tag").cast("string").alias("tag"), "cell", "size", "spread", "block").toArrow()
        lines = lines.sort_by([("tag", "ascending"), ("cell", "ascending")])
        values = [lines[x].to_numpy() for x in ("cell", "size", "spread", "block")]
        names, first = np.unique(lines["tag"].to_numpy().astype(str), return_index=True)
        lookup = spark.sparkContext.broadcast({
            str(t): _Cells(*(v[a:b] for v in values)) for t, a, b in zip(names, first, [*first[1:], lines.num_rows])
        })

    def with_blocks(df: DataFrame, second: bool) -> DataFrame:
        """``df`` (probe, vector, tag, bound) with the blocks that each probe meets in the first or the second pass."""

        def sent(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    angle = _angles(_unit(batch.column("vector")), pivots.value)
                    bound = _numbers(batch.column("bound")) if second else None
                    keys = np.array(batch.column("_key").to_pylist(), dtype=object)
                    met = [np.zeros(0, np.int32)] * len(keys)
                    for key in set(keys.tolist()) & lookup.value.keys():
                        at_key = np.flatnonzero(keys == key)
                        found = lookup.value[key].blocks(angle[at_key], None if bound is None else bound[at_key], need)
                        for i, x in zip(at_key, found):
                            met[i] = x
                    yield _with_blocks(batch, met)

        def joined(asked: pa.Table, known: pa.Table) -> pa.Table:
            out = []
            known = known.sort_by("cell")
            mine = _Cells(*(known[x].to_numpy() for x in ("cell", "size", "spread", "block")))
            for at in range(0, asked.num_rows if known.num_rows else 0, step):
                batch = asked.slice(at, step)
                angle = _angles(_unit(batch["vector"]), pivots.value)
                out.append(_with_blocks(batch, mine.blocks(angle, _numbers(batch["bound"]) if second else None, need)))
            return pa.Table.from_batches(out or [_with_blocks(asked.slice(0, 0), [])])

        if few:
            return df.select("probe", "vector", "tag", "bound", F.col("tag").cast("string").alias("_key")).mapInArrow(sent, probe_type)
        salts = probes.groupBy("tag").agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED)).cast("int").alias("salts"))
        left = df.join(salts, "tag").withColumn("salt", F.pmod(F.xxhash64("probe"), F.col("salts")).cast("int"))
        right = cells.join(salts, "tag").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        left = left.select("probe", "vector", "tag", "bound", "salt").groupBy("tag", "salt")
        return left.cogroup(right.select("tag", "salt", "cell", "size", "spread", "block").groupBy("tag", "salt")).applyInArrow(joined, probe_type)

    best = Window.partitionBy("probe").orderBy(F.col("cosine").desc(), F.col("corpus_id"))
    found = _scan(with_blocks(probes, False), c, need, per_block, id_type).withColumn("_rn", F.row_number().over(best))
    found = written(found.where(F.col("_rn") <= need), "first")
    bounds = found.where(F.col("_rn") == need).select("probe", F.col("cosine").alias("bound"))
    again = probes.drop("bound").join(bounds, "probe", "left").select("probe", "vector", "tag", "bound")
    found = found.drop("_rn").unionByName(_scan(with_blocks(again, True), c, need, per_block, id_type))
    found = found.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= need).drop("_rn")
    found = found.join(members, "probe").select("query_id", "corpus_id", "cosine")
    if skip_self:
        found = found.where(~F.col("query_id").eqNullSafe(F.col("corpus_id")))
    window = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), F.col("corpus_id"))
    return found.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)
