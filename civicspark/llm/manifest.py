"""Merkle manifest of a table, with a proof for every row, built by incremental witnesses over aligned blocks.

Tree shape (fixed by the manifest's format): the nodes of a level are taken two at a time from the left; a last lone
node is hashed on its own; levels are made while more than one node remains, and one node is the root as it is. A
node's hash ``H`` is the lowercase hex SHA-256 of its children's hex digests written one after the other.

Method. Rows are numbered in order within their group (:func:`ranks.positions`, no group in one task). The tree is
then appended block by block: a block is an aligned run of ``2**width`` nodes, so every pair it forms lies inside it
and the block's root is exactly a node of the whole tree. Inside a block the nodes are appended in order; every
completion of a sibling extends the witness (the list of siblings) of all leaves below the open subtree, which is
kept once per subtree and copied to the leaves when the block is closed. Block roots are then appended as further
nodes of the level above, in blocks again, until one node per group is left; the witnesses of the blocks above are
joined onto the leaves' own. A block is one group of ``2**width`` rows, whatever the size of the table.

Rows: each row of ``documents`` is a leaf. Null ``doc_id`` sorts first within its ``lang``; rows that repeat
(doc_id, leaf) take neighbouring places in any order, which changes no digest of the result's row set. Null
``lang`` is a group of its own, first among groups (then bytewise UTF-8). An empty table gives no rows. Extra
columns of the input are not read. Texts are hashed whole, however long.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import written
from .ranks import positions

WIDTH = 12  # blocks of 2**12 nodes: about 1 MB of witnesses in one group of the block step

STEP = StructType([StructField("sib", StringType()), StructField("left", BooleanType())])
PATH = ArrayType(STEP)


def H(column: Column) -> Column:
    return F.sha2(column, 256)


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return H(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _height(n: int) -> int:
    return max(0, (n - 1).bit_length())


def _block(width: int, payload: list[str], schema: StructType):
    """The step for one block: each node's witness within the block, and the block's root."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_idx")
        n, levels = table["_n"][0].as_py(), table["_levels"][0].as_py()
        idx = table["_idx"].to_pylist()
        first = idx[0] >> width << width
        local = [i - first for i in idx]
        level = [None] * (local[-1] + 1)
        for j, h in zip(local, table["_h"].to_pylist()):
            level[j] = h
        steps = []  # per level: the step each open subtree of that level adds to the witness of its leaves
        count, base = n, first
        for _ in range(levels):
            step, parents = [None] * len(level), [None] * (-(-len(level) // 2))
            for p in range(len(parents)):
                a, b = 2 * p, 2 * p + 1
                if base + b < count:  # a sibling completes the pair
                    step[a], step[b] = (level[b], False), (level[a], True)
                    parents[p] = _sha(level[a] + level[b])
                else:  # the last lone node of its level
                    step[a] = (None, False)
                    parents[p] = _sha(level[a])
            steps.append(step)
            level, count, base = parents, -(-count // 2), base >> 1
        witnesses = [[{"sib": steps[k][j >> k][0], "left": steps[k][j >> k][1]} for k in range(levels)] for j in local]
        rows = len(idx) + 1
        columns = {
            "_g": pa.array(table["_g"].to_pylist() + [table["_g"][0].as_py()], pa.string()),
            "_idx": pa.array(idx + [first >> width], pa.int64()),
        }
        for c in payload:
            columns[c] = pa.concat_arrays([table[c].combine_chunks(), pa.nulls(1, table.schema.field(c).type)])
        columns["_kind"] = pa.array([0] * len(idx) + [1], pa.int32())
        columns["_path"] = pa.array(witnesses + [[]], pa.list_(pa.struct([("sib", pa.string()), ("left", pa.bool_())])))
        columns["_h"] = pa.array([None] * len(idx) + [level[0]], pa.string())
        assert rows == len(columns["_idx"])
        return pa.table(columns).select([f.name for f in schema.fields])

    return run


def tree(nodes: DataFrame, payload: list[str], width: int = WIDTH, name: str = "merkle") -> tuple[DataFrame, DataFrame]:
    """Witnesses and roots of one tree per group.

    ``nodes`` has ``_g`` (group, not null), ``_idx`` (0-based place, gapless per group), ``_h`` (hex digest) and the
    ``payload`` columns, which are kept. Returns (nodes with ``_path``: the steps from the node to its group's root,
    each a sibling digest and whether it lies to the left, or a null sibling where the node is hashed alone;
    roots: ``_g``, ``_root``). The sizes of the groups are brought to the driver: one row a group.
    """
    spark = nodes.sparkSession
    sizes = {r["_g"]: r["n"] for r in nodes.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
    types = {f.name: f.dataType for f in nodes.schema.fields}
    out_schema = StructType(
        [StructField("_g", StringType()), StructField("_idx", LongType())]
        + [StructField(c, types[c]) for c in payload]
        + [StructField("_kind", IntegerType()), StructField("_path", PATH), StructField("_h", StringType())]
    )
    level_schema = "_g string, _n long, _levels int"
    current, paths, rnd = nodes.select("_g", "_idx", "_h", *payload), [], 0
    roots = []
    while True:
        plan = []
        for g, n in sizes.items():
            left = _height(n) - rnd * width
            if left > 0 or rnd == 0:
                plan.append((g, -(-n // (1 << (rnd * width))) if rnd else n, max(0, min(width, left))))
        if not plan:
            break
        levels = spark.createDataFrame(plan, level_schema)
        schema = out_schema if rnd == 0 else StructType([f for f in out_schema.fields if f.name not in payload])
        step = _block(width, payload if rnd == 0 else [], schema)
        blocks = current.join(F.broadcast(levels), "_g").withColumn("_blk", F.shiftright("_idx", width))
        done = written(blocks.groupBy("_g", "_blk").applyInArrow(step, schema), f"{name}-{rnd}")
        paths.append(done.where("_kind = 0").drop("_kind", "_h"))
        finished = [g for g, _, lv in plan if _height(sizes[g]) <= (rnd * width + lv)]
        tops = done.where("_kind = 1").select("_g", "_idx", "_h")
        roots.append(tops.where(F.col("_g").isin(finished)).select("_g", F.col("_h").alias("_root")))
        current = tops.where(~F.col("_g").isin(finished))
        rnd += 1
        if len(finished) == len(plan):
            break
    if not paths:
        empty = nodes.select("_g", "_idx", *payload).withColumn("_path", F.lit(None).cast(PATH)).where(F.lit(False))
        return empty, spark.createDataFrame([], "_g string, _root string")
    # witnesses of the blocks above, joined top down, then onto the nodes' own
    upper = None
    for r in range(len(paths) - 1, 0, -1):
        here = paths[r].select("_g", "_idx", "_path")
        if upper is not None:
            here = (
                here.withColumn("_up", F.shiftright("_idx", width))
                .join(upper.withColumnRenamed("_idx", "_up").withColumnRenamed("_path", "_above"), ["_g", "_up"], "left")
                .select("_g", "_idx", F.concat("_path", F.coalesce("_above", F.array().cast(PATH))).alias("_path"))
            )
        upper = here
    own = paths[0]
    if upper is not None:
        own = (
            own.withColumn("_up", F.shiftright("_idx", width))
            .join(upper.withColumnRenamed("_idx", "_up").withColumnRenamed("_path", "_above"), ["_g", "_up"], "left")
            .withColumn("_path", F.concat("_path", F.coalesce("_above", F.array().cast(PATH))))
            .drop("_up", "_above")
        )
    root = roots[0]
    for r in roots[1:]:
        root = root.unionByName(r)
    return own.select("_g", "_idx", *payload, "_path"), root


def fold(start: Column, path: Column) -> Column:
    """The root reached from ``start`` along a witness."""
    return F.aggregate(
        path,
        start,
        lambda acc, s: F.when(s["sib"].isNull(), H(acc))
        .when(s["left"], H(F.concat(s["sib"], acc)))
        .otherwise(H(F.concat(acc, s["sib"]))),
    )


def proof_digest(path: Column) -> Column:
    """H of the siblings of a witness, bottom up (the empty text's digest where there are none)."""
    return H(F.array_join(F.transform(F.filter(path, lambda s: s["sib"].isNotNull()), lambda s: s["sib"]), ""))


def manifest(documents: DataFrame, width: int = WIDTH, extra: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, subroot (per ``lang``), root and witness (``path``) of every row of ``documents``.

    Returns doc_id, source, lang, n_chars, leaf, subroot, root, path (steps from the leaf to the root), and the
    ``extra`` columns, computed from the typed input columns (doc_id, source, lang, n_chars, text) before texts
    are left behind: the tree moves digests only.
    """
    extra = extra or {}
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("text").cast("string").alias("text"),
    )
    names = ("doc_id", "source", "lang", "n_chars", "text")
    leaves = rows.select(
        "doc_id", "source", "lang", "n_chars", leaf(*[F.col(c) for c in names]).alias("_h"),
        *[value.alias(key) for key, value in extra.items()],
    )
    # groups as text that orders null first, then by UTF-8 bytes
    group = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    placed = positions(leaves, group, [F.col("doc_id").asc_nulls_first(), F.col("_h")], "merkle-leaves")
    placed = placed.withColumnRenamed("_pos", "_idx").withColumn("leaf", F.col("_h"))
    own, subroots = tree(placed, ["doc_id", "source", "lang", "n_chars", "leaf", *extra], width, "merkle-lang")
    # the subroots are the leaves of the tree over groups
    tops = positions(subroots.withColumnRenamed("_g", "_lang"), F.lit(""), [F.col("_lang")], "merkle-tops")
    tops = tops.select("_g", F.col("_pos").alias("_idx"), F.col("_root").alias("_h"), "_lang", F.col("_root").alias("subroot"))
    upper, root = tree(tops, ["_lang", "subroot"], width, "merkle-top")
    upper = upper.join(root, "_g").select(
        F.col("_lang").alias("_g"), "subroot", F.col("_path").alias("_above"), F.col("_root").alias("root")
    )
    # one row a group: a bounded side
    whole = own.join(F.broadcast(upper), "_g")
    return whole.select(
        "doc_id", "source", "lang", "n_chars", "leaf", "subroot", "root", F.concat("_path", "_above").alias("path"), *extra
    )


def tampered(doc_id: Column) -> Column:
    """Rows whose unsigned crc32 of the decimal id is divisible by 7 (null ids never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def verify(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Manifest of ``documents`` checked against a tampered copy.

    Where :func:`tampered` holds and ``n_chars`` is not null, the leaf is recomputed with ``n_chars + 1`` and folded
    along the original witness; elsewhere the original leaf is folded. Returns doc_id, leaf, subroot, root,
    proof_sha256 (H of the witness's siblings, bottom up), folded_root, verified (folded_root = root).
    """
    hit = tampered(F.col("doc_id")) & F.col("n_chars").isNotNull()
    changed = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    made = manifest(documents, width, {"_changed": F.when(hit, changed)})
    start = F.coalesce(F.col("_changed"), F.col("leaf"))
    return made.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(start, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
