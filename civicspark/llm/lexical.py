"""Ranked lexical search: impact-ordered postings read by NRA (no random access) until the top k are settled.

Scoring (integer, fixed by the contract). Terms are the maximal runs of ASCII letters, ASCII digits and any
non-ASCII character, with only A-Z lower-cased. ``N`` counts documents with a term, ``L`` their terms with repeats,
``n`` one document's terms, ``df`` the documents holding a term, ``tf`` its count in the document. A term weighs
``w = floor(1000 * ln((2N + 2) / (2df + 1)))``; a document's ``m = 75 + (25 * n * N) div L``; the impact of a term in
a document is ``w * ((10**9 * tf) div (1000 * tf + 12 * m))``, and a query scores the sum of impacts over its terms,
repeats included. Every impact is at least 0.

Method. The postings of each asked term are ordered by impact (then doc_id) and numbered without putting a term into
one task (:func:`ranks.positions`). Reading is in rounds of growing depth ``d``: every open query reads the first
``d`` postings of each of its terms. A seen document's lower bound adds what was read; its upper bound adds, for each
term not yet seen, the impact at depth ``d - 1`` (the list's threshold; 0 once the list is read out), and a document
never seen has the sum of the thresholds. A query is settled when its best ``k`` by lower bound all have lower =
upper (final scores), no other document can reach the k-th score (ties: a larger doc_id loses), and, with fewer than
``k`` positive scores, nothing else can score above 0. Settled queries leave; the others read four times deeper.

Documents are keyed by ``doc_id``: rows with the same id are one document with all their terms; rows with a null
id are one document with a null id, which ranks first among equal scores. Null or term-less texts (documents and
queries) have no terms; a query without terms, or whose terms no document holds, returns nothing. Texts are read
whole, however long. Extra input columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir
from .common import slices, utf8, written
from .ranks import positions

# Fixed values of the contract: the term pattern and the letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

TOP = 20
FIRST_DEPTH = 64
GROWTH = 4
BROADCAST_ROWS = 2_000_000  # query terms sent whole to every task only below this count
CANDIDATE_ROWS = 250_000  # candidate (query, document) pairs sent whole to every task only below this count
SMALLEST = -(1 << 63)
# TERM and the lower-casing for UTF-8 bytes: what stands in no term becomes a blank, bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LENGTH = ""  # stands for a term in the row that carries a document's number of terms; no term is empty


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def band(pos: Column) -> Column:
    """Reading band of a posting's place: 0 below FIRST_DEPTH, then one band per growth of the depth."""
    expr, depth, b = F.when(pos < FIRST_DEPTH, F.lit(0)), FIRST_DEPTH, 1
    while depth < (1 << 62) // GROWTH:
        depth *= GROWTH
        expr = expr.when(pos < depth, F.lit(b))
        b += 1
    return expr.otherwise(F.lit(b))


def _band_of_depth(depth: int) -> int:
    b, d = 0, FIRST_DEPTH
    while d < depth:
        d *= GROWTH
        b += 1
    return b


def document_terms(documents: DataFrame) -> DataFrame:
    """(doc_id, term, c): each distinct term of a text with its number, and a row ``LENGTH`` with the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, found, numbers = [], [], []
                for text in utf8(batch.column("text")):
                    words = text.translate(FOLD).split()
                    counts = Counter(words)
                    counts[LENGTH.encode()] = len(words)
                    sizes.append(len(counts))
                    found.extend(counts)
                    numbers.extend(counts.values())
                ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.record_batch([ids, pa.array(found, pa.string()), pa.array(numbers, pa.int64())], ["doc_id", "term", "c"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, term string, c long")


def counted(documents: DataFrame, asked: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """One read of the texts: (doc_id, n) for every document, (doc_id, term, tf) for the asked terms, N and L.

    Each text is split into terms once; besides its terms a document gives one row that carries its number of terms,
    so lengths and term counts come from one scan and one aggregation (partial before the shuffle). ``asked`` holds
    the distinct asked ``word``s with their number ``term`` (``rows`` of them; up to BROADCAST_ROWS sent whole to every
    task, else joined by a shuffle); from here on a term is its number.
    """
    words = document_terms(documents).withColumnRenamed("term", "word")
    hits = asked.select("word", "term").unionByName(asked.sparkSession.range(1).select(F.lit(LENGTH).alias("word"), F.lit(-1).cast("long").alias("term")))
    kept = words.join(F.broadcast(hits) if rows <= BROADCAST_ROWS else hits, "word")
    both = written(kept.groupBy("doc_id", "term").agg(F.sum("c").alias("tf")), "lexical-tf")
    sizes = both.where("term = -1").select("doc_id", F.col("tf").alias("n"))
    totals = sizes.where("n > 0").agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    return sizes, both.where("term >= 0"), int(totals["N"] or 0), int(totals["L"] or 0)


def index(documents: DataFrame, asked: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Impact-ordered postings of the asked terms: term, doc_id, impact, pos, band; and the longest list's length.

    ``asked`` holds the distinct words of the queries (``rows`` of them) and the numbers that stand for them. N and L cover all documents and all their
    terms; df and tf are counted over all documents for the asked terms, the only lists a search reads.
    """
    sizes, tf, N, L = counted(documents, asked, rows)
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * N + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", weight.alias("w"))
    m = F.lit(75) + F.expr(f"(25 * n * {N}) div {max(L, 1)}")
    impact = F.col("w") * F.expr("(1000000000 * tf) div (1000 * tf + 12 * _m)")
    # null ids are one document: a join that keeps them
    sized = tf.join(sizes.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d")
    postings = sized.withColumn("_m", m).join(weights, "term").select("term", "doc_id", impact.alias("impact"))
    placed = positions(postings, F.col("term"), [F.col("impact").desc(), F.col("doc_id").asc_nulls_first()], "lexical-postings")
    placed = placed.withColumnRenamed("_pos", "pos").drop("_g").withColumn("band", band(F.col("pos")))
    # one folder per reading band: a round reads the bands it needs and no other file
    spark = placed.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/lexical-index-{uuid.uuid4().hex}"
    # files hold the postings of a range of documents: the sums per (query, document) of a round combine within
    # each scan task before the shuffle, over all terms of the document in that band
    placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").write.partitionBy("band").parquet(path)
    laid = spark.read.schema(placed.schema).parquet(path)
    longest = weights.agg(F.max("df")).first()[0] or 0
    return laid, int(longest)


def query_terms(queries: DataFrame, key: str) -> DataFrame:
    """(key, term, q): each distinct term of a query with its number of repeats."""
    words = queries.select(F.col(key).alias("item"), F.explode(terms(F.col("text"))).alias("term"))
    return words.groupBy("item", "term").agg(F.count(F.lit(1)).alias("q"))


def _side(df: DataFrame, rows: int) -> DataFrame:
    """Candidate pairs (two longs a row) go whole to each task only up to CANDIDATE_ROWS."""
    return F.broadcast(df) if rows <= CANDIDATE_ROWS else df


def _round(postings: DataFrame, asked: DataFrame, depth: int, top: int, small: bool, cand: tuple[DataFrame, int] | None):
    """Bounds after reading ``depth`` postings of each term: per open query its best ``top``, whether settled, and
    whether closed (no unseen document can reach its ``top``-th score); and the bounds themselves, unwritten.

    ``cand`` holds (item, _d) for closed queries: only these documents are joined for them, as no other can enter.
    """
    read = postings.where(F.col("band") <= _band_of_depth(depth)).where(F.col("pos") < depth)
    read = read.select("term", "doc_id", "impact", F.coalesce(F.col("doc_id"), F.lit(SMALLEST)).alias("_d"))
    thresholds = postings.where(F.col("band") <= _band_of_depth(depth)).where(F.col("pos") == depth - 1)
    lists = asked.join(thresholds.select("term", F.col("impact").alias("thr")), "term", "left").fillna(0, ["thr"])
    lists = written(lists, "lexical-lists")
    if cand is None:
        seen = read.join(F.broadcast(lists) if small else lists, "term")
    else:
        pairs, rows = cand
        closed = pairs.select("item").distinct()
        open_lists = lists.join(F.broadcast(closed), "item", "left_anti")
        closed_lists = lists.join(F.broadcast(closed), "item", "left_semi")
        # a closed query meets only its candidates: the postings are cut to their documents before any join
        closed_part = read.join(_side(pairs, rows), "_d").join(
            F.broadcast(closed_lists) if small else closed_lists, ["item", "term"]
        )
        seen = read.join(F.broadcast(open_lists) if small else open_lists, "term").unionByName(closed_part)
    bounds = seen.groupBy("item", "doc_id").agg(
        F.sum(F.col("q") * F.col("impact")).alias("lb"), F.sum(F.col("q") * F.col("thr")).alias("seen_thr")
    )
    unseen = lists.groupBy("item").agg(F.sum(F.col("q") * F.col("thr")).alias("u0"))
    # not written: only the first rows by lower and by upper bound are used, each cut per task before its shuffle,
    # and the exchange of the sums is shared by both
    bounds = bounds.join(F.broadcast(unseen) if small else unseen, "item").withColumn(
        "ub", F.col("lb") + F.col("u0") - F.col("seen_thr")
    )
    doc = F.coalesce(F.col("doc_id"), F.lit(SMALLEST))
    by_lower = Window.partitionBy("item").orderBy(F.col("lb").desc(), doc)
    by_upper = Window.partitionBy("item").orderBy(F.col("ub").desc(), doc)
    columns = ["item", "doc_id", "lb", "ub"]
    # one job writes both short lists: the exchange of the sums is planned once and read by both
    picked = written(
        bounds.where("lb > 0").withColumn("rank", F.row_number().over(by_lower)).where(F.col("rank") <= top)
        .select(*columns, "rank", F.lit(0).alias("kind"))
        .unionByName(
            bounds.withColumn("rank", F.row_number().over(by_upper)).where(F.col("rank") <= top + 1)
            .select(*columns, "rank", F.lit(1).alias("kind"))
        ),
        "lexical-picked",
    )
    best = picked.where("kind = 0")
    others = (
        picked.where("kind = 1")
        .alias("o")
        .join(
            best.select("item", "doc_id").alias("b"),
            (F.col("o.item") == F.col("b.item")) & F.col("o.doc_id").eqNullSafe(F.col("b.doc_id")),
            "left_anti",
        )
        .withColumn("_o", F.row_number().over(by_upper))
        .where("_o = 1")
        .select("item", F.col("ub").alias("o_ub"), F.coalesce(F.col("doc_id"), F.lit(SMALLEST)).alias("o_doc"))
    )
    summary = best.groupBy("item").agg(
        F.count(F.lit(1)).alias("k"),
        F.min("lb").alias("lb_k"),
        F.max_by(F.coalesce(F.col("doc_id"), F.lit(SMALLEST)), F.col("rank")).alias("doc_k"),
        F.bool_and(F.col("lb") == F.col("ub")).alias("exact"),
    )
    items = unseen.join(summary, "item", "left").join(others, "item", "left")
    full = (F.col("k") == top) & (F.col("u0") < F.col("lb_k")) & (
        F.col("o_ub").isNull()
        | (F.col("o_ub") < F.col("lb_k"))
        | ((F.col("o_ub") == F.col("lb_k")) & (F.col("o_doc") > F.col("doc_k")))
    )
    few = (F.coalesce(F.col("k"), F.lit(0)) < top) & (F.col("u0") == 0) & (F.coalesce(F.col("o_ub"), F.lit(0)) == 0)
    settled = F.coalesce(F.col("exact"), F.lit(True)) & (full | few)
    closing = (F.col("k") == top) & (F.col("u0") < F.col("lb_k"))
    states = written(
        items.select(
            "item", F.coalesce(settled, F.lit(False)).alias("settled"), F.coalesce(closing, F.lit(False)).alias("closed"), "lb_k",
            "doc_k",
        ),
        "lexical-states",
    )
    found = best.join(states.where("settled"), "item").select("item", "rank", "doc_id", F.col("lb").alias("score"))
    return written(found, "lexical-found"), states, bounds


def search(documents: DataFrame, queries: DataFrame, key: str = "item_id", top: int = TOP) -> DataFrame:
    """Each query's ``top`` highest-scoring documents with a score above 0: key, rank, doc_id, score."""
    asked = written(query_terms(queries, key), "lexical-asked")
    small = asked.count() <= BROADCAST_ROWS
    distinct = asked.select(F.col("term").alias("word")).distinct()
    distinct = written(distinct.withColumn("term", F.monotonically_increasing_id()), "lexical-terms")
    asked = written(asked.withColumnRenamed("term", "word").join(distinct, "word").drop("word"), "lexical-asked")
    postings, longest = index(documents, distinct, distinct.count())
    found, depth = [], FIRST_DEPTH
    open_items, cand = asked, None
    while True:
        got, states, bounds = _round(postings, open_items, depth, top, small, cand)
        found.append(got)
        if depth >= longest:
            break
        still = states.where("not settled").select("item")
        if still.isEmpty():
            break
        # queries that closed in this round keep, from now on, the documents whose upper bound reaches their
        # top-th lower bound; bounds only narrow, so no other document can come back
        known = cand[0].select("item").distinct() if cand else None
        newly = states.where("closed AND NOT settled").select("item", "lb_k", "doc_k")
        if known is not None:
            newly = newly.join(known, "item", "left_anti")
        newly = written(newly, "lexical-closing")
        if not newly.isEmpty():
            # a document that ranks after the top-th even at its upper bound (lower score, or the same score and a
            # larger id) can never enter: ties of many copies do not stay candidates
            d = F.coalesce(F.col("doc_id"), F.lit(SMALLEST))
            reach = (F.col("ub") > F.col("lb_k")) | ((F.col("ub") == F.col("lb_k")) & (d <= F.col("doc_k")))
            picked = bounds.join(F.broadcast(newly), "item").where(reach)
            more = picked.select("item", d.alias("_d"))
            kept = cand[0].join(still, "item", "left_semi") if cand else None
            pairs = written(more if kept is None else kept.unionByName(more), "lexical-candidates")
            cand = (pairs, pairs.count())
        elif cand:
            pairs = written(cand[0].join(still, "item", "left_semi"), "lexical-candidates")
            cand = (pairs, pairs.count())
        open_items = written(asked.join(still, "item", "left_semi"), "lexical-open")
        depth *= GROWTH
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("item").alias(key), F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("long"), F.col("score").cast("long")
    )


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY ALL),
totals AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), impacts AS (
  SELECT tf.term, tf.doc_id,
         CAST(floor(1000.0 * ln((2.0 * big_n + 2.0) / (2.0 * df.df + 1.0))) AS BIGINT)
           * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * sizes.n * big_n) // big_l))) AS impact
  FROM tf JOIN sizes ON tf.doc_id IS NOT DISTINCT FROM sizes.doc_id JOIN df USING (term), totals
), scores AS (
  SELECT item_id, doc_id, sum(q * impact) AS score FROM asked JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS FIRST) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""
