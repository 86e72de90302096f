"""Near-duplicate documents by an inverted join on MinHash coordinates.

Texts with one shingle set are one node. A node is posted under each (coordinate, value) of its signature; values that
only one node has are dropped, and a node with fewer than ``match`` left can reach no other. Postings go rarest first:
two nodes that agree in ``match`` coordinates meet already in the first ``n - match + 1`` of the ``n`` left (prefix), so
the long lists at the end are not merged but skipped; the collisions there are counted by comparing signatures. Pairs
above the match threshold are confirmed on the full sets.

Lists are never expanded into all pairs: nodes are first tried against the head of each list and their neighbour in it;
only nodes of a list that are then still in different components are compared with each other, by the size of their
sets and by their signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, utf8, written
from .components import components

COORDINATES = 64
MATCH = 34
WIDTH = 5
PERCENT = 80
SUBLIST = 1000
HUB_SIZE = 8
KNOWN = 150_000
REMEMBERED = 64
CELLS = 1 << 13


class WordHashes(dict):
    """Hash of each word; up to KNOWN words of usual length are remembered. A task makes its own: what it remembers
    ends with it and does not stay in its worker."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= REMEMBERED:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = value
        return value


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lower-cased, words apart by ASCII white
    space. With fewer words the whole sequence is one shingle; without words there is none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(32)))


def signature(found: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Least value of each coordinate's hash over a set, as signed 32-bit numbers."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CELLS):
        np.minimum(least, (found[at : at + CELLS, None] * multipliers + offsets).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, node_key (digest of the set, null if empty), signature (null if empty) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        multipliers = rng.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
        offsets = rng.integers(0, 1 << 63, coordinates, np.uint64)
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                n, keys, marks = [], [], []
                for text in utf8(batch.column("text")):
                    found = shingles(text, width, hashes)
                    n.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    marks.append(signature(found, multipliers, offsets) if len(found) else None)
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "node_key", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, node_key binary, signature array<int>")


def prefixes(nodes: DataFrame, match: int) -> DataFrame:
    """Postings (coordinate, value, df, node, weight) of the rarest values of each node, as many as a match must share
    one of. ``weight`` sums how many nodes share each value of the node: the text that others are edits of has most."""
    posts = nodes.select("node", F.posexplode("signature").alias("coordinate", "value"))
    shared = posts.groupBy("coordinate", "value").agg(F.count("*").alias("df")).where("df > 1")
    own = posts.join(shared, ["coordinate", "value"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "coordinate", "value"))).alias("posts"), F.sum("df").alias("weight"))
    first = own.where(F.size("posts") >= match).select("node", "weight", F.explode(F.slice("posts", F.lit(1), F.size("posts") - (match - 1))).alias("p"))
    return first.select("p.coordinate", "p.value", "p.df", "node", "weight")


def agreeing(x: Column, y: Column) -> Column:
    """In how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)


def listed(posts: DataFrame) -> DataFrame:
    """(node, lists): the coordinates under which a node is posted."""
    return posts.groupBy("node").agg(F.sort_array(F.collect_list("coordinate")).alias("lists"))


def meets_first(coordinate: Column, x: str, y: str) -> Column:
    """Is this the first coordinate whose list holds both nodes? So a pair that shares many lists is one row, not one
    per list."""
    both = F.array_intersect(F.col("lists_" + x), F.col("lists_" + y))
    earlier = F.filter(both, lambda c: (c < coordinate) & (F.element_at("sig_" + x, c + 1) == F.element_at("sig_" + y, c + 1)))
    return F.size(earlier) == 0


def matches(pairs: DataFrame, nodes: DataFrame, match: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``match`` coordinates."""
    marks = nodes.select("node", "signature")
    joined = pairs.join(marks.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a").join(marks.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
    return joined.where(agreeing(F.col("x"), F.col("y")) >= match).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return joined.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, items): the whole sorted set of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, "text"):
                items = [shingles(t, width, hashes).tobytes() for t in utf8(batch.column("text"))]
                yield pa.record_batch([batch.column("node"), pa.array(items, pa.binary())], ["node", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return texts.join(wanted, "node", "left_semi").mapInArrow(run, "node long, items binary")


def apart_pairs(placed: DataFrame, rest: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, match: int) -> DataFrame:
    """Pairs (a, b) that share a list, lie in different components and may be linked.

    A node x meets a large component through its hub h, the member of most weight: for a member y, the intersection of x
    and y is at most that of x and h plus what x and y share outside h. So x is compared only with members small enough
    for the first term alone, and with those that share a shingle outside h and reach the bound with both terms. Nodes
    of small components are compared one by one.
    """
    sizes = placed.select("component", "node", "weight").distinct().groupBy("component").agg(F.count("*").alias("size"), F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("h"))
    hubs = written(sizes.select("component", "size", (-F.col("h.m")).alias("hub")), "hubs")
    near = rest.join(hubs, "component")
    small = near.select("coordinate", "value", F.col("component").alias("component_a"), F.col("size").alias("size_a"), F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("signature").alias("sig_x"), F.col("lists").alias("lists_x"))
    large = near.select("coordinate", "value", "component", "size", "hub").distinct()
    smaller = F.struct("size_a", "component_a") < F.struct("size", "component")
    asked = small.join(large.where(F.col("size") >= HUB_SIZE), ["coordinate", "value"]).where(smaller).select("x", "component", "hub", "n_x").distinct()
    asked = written(outside(asked, sets, "x"), "asked")
    bound = f"(100 + {percent}) * {{}} >= {percent} * (n_x + n_y)"
    similar = (agreeing(F.col("sig_x"), F.col("sig_y")) >= match) & meets_first(F.col("coordinate"), "x", "y")
    fits = F.expr(f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)")
    other = near.select("coordinate", "value", "component", "size", F.col("node").alias("y"), F.col("n").alias("n_y"), F.col("signature").alias("sig_y"), F.col("lists").alias("lists_y"))
    # Small components, and members small enough for the hub alone.
    few = small.join(other.where(F.col("size") < HUB_SIZE), ["coordinate", "value"]).where(smaller & fits & similar).select("x", "y")
    by_hub = small.join(asked.select("x", "component", "common"), "x").join(other, ["coordinate", "value", "component"]).where(F.expr(bound.format("common")) & fits & similar).select("x", "y")
    # Members that share a shingle outside the hub.
    members = placed.select("component", F.col("node").alias("y")).distinct().join(hubs, "component").join(asked.select("component").distinct(), "component", "left_semi").join(nodes.select(F.col("node").alias("y"), F.col("n").alias("n_y")), "y")
    theirs = outside(members.select("y", "component", "hub", "n_y"), sets, "y").select("y", "n_y", "component", F.explode("rest").alias("item"))
    ours = asked.select("x", "n_x", "common", "component", F.explode("rest").alias("item"))
    shared = ours.join(theirs, ["component", "item"]).groupBy("x", "y", "n_x", "n_y", "common").agg(F.count("*").alias("more")).where(bound.format("(common + more)")).select("x", "y")
    return few.union(by_hub).union(shared).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def outside(rows: DataFrame, sets: DataFrame, of: str) -> DataFrame:
    """``rows`` (``of``, component, hub, n) with ``common``, how many items ``of`` shares with the hub, and ``rest``, its
    other items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, rest = [], []
            for p, q in zip(batch.column("p"), batch.column("q"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                left = np.setdiff1d(p, q, assume_unique=True)
                common.append(len(p) - len(left))
                rest.append(left.view(np.int64))
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(common, pa.int64()), pa.array(rest, pa.list_(pa.int64()))], [*names, "common", "rest"])

    names = [of, "component", "hub", "n_" + of]
    joined = rows.join(sets.select(F.col("node").alias(of), F.col("items").alias("p")), of).join(sets.select(F.col("node").alias("hub"), F.col("items").alias("q")), "hub")
    return joined.select(*names, "p", "q").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", common long, rest array<long>")


def labelled(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, match: int = MATCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents without words (null, empty, white space) are linked with nothing and kept. Rows without doc_id have a
    null component and are kept. Rows that repeat an id are one vertex with the links of all its texts. An empty table
    gives no rows; other columns are not read.
    """
    base = written(signatures(docs, width, coordinates), "signatures")
    nodes = written(base.where("node_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("node_key").agg(F.min("doc_id").alias("node"), F.min_by("signature", "doc_id").alias("signature"), F.min("n_shingles").alias("n")), "nodes")
    posts = written(prefixes(nodes, match), "postings")
    # First round: the head of each list, its node of most weight, and the neighbour in a bounded part of the list.
    heads = posts.groupBy("coordinate", "value").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("h"))
    star = posts.join(heads, ["coordinate", "value"]).select(F.least("node", -F.col("h.m")).alias("a"), F.greatest("node", -F.col("h.m")).alias("b"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("df") / SUBLIST).cast("long"))
    chain = posts.withColumn("part", part).withColumn("a", F.lag("node").over(Window.partitionBy("coordinate", "value", "part").orderBy("node"))).select("a", F.col("node").alias("b"))
    tries = star.union(chain).where("a < b").distinct()
    near = written(matches(tries, nodes, match), "tries")
    wanted = posts.select("node").distinct()
    sets = written(full_sets(docs, wanted, width), "sets")
    links = written(confirmed(near, sets, percent), "links")
    label = components(links)
    # Second round: what the lists still hold apart.
    placed = written(posts.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    apart = placed.groupBy("coordinate", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    facts = nodes.select("node", "n", "signature").join(listed(posts), "node")
    rest = written(placed.join(apart.select("coordinate", "value"), ["coordinate", "value"], "left_semi").join(facts, "node"), "rest")
    more = apart_pairs(placed, rest, nodes, sets, percent, match).join(near, ["a", "b"], "left_anti")
    found = written(confirmed(written(more, "more"), sets, percent), "found")
    if not found.isEmpty():
        label = written(components(links.union(found)), "components")
    of_key = nodes.select("node_key", "node").join(label.withColumnRenamed("id", "node"), "node", "left").select("node_key", F.coalesce("component", "node").alias("component"))
    out = base.select("doc_id", "n_shingles", "node_key").join(written(of_key, "labels"), "node_key", "left")
    component = F.when(F.col("node_key").isNotNull() & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
