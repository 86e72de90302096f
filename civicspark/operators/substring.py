"""Join of search texts with a dictionary of texts that contain them, without pairing everything with everything.

A text that contains a search text also contains every q-gram of it. Each search text is therefore looked up under
its rarest q-gram only, and the few candidates found there are checked exactly. % and _ inside a search text stay
LIKE wildcards, so grams never run across them. A search text without any literal character is looked up under the
empty gram, which every entry has.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .staging import written

GRAM = 4

_ENTRY_GRAMS = f"""CASE WHEN entry = '' THEN array('') ELSE concat(array(''), array_distinct(flatten(transform(
    sequence(1, least({GRAM}, length(entry))),
    n -> transform(sequence(1, length(entry) - n + 1), i -> substring(entry, i, n)))))) END"""
_PIECES = "filter(split(pattern, '[%_]'), p -> length(p) > 0)"
_SIZE = f"least({GRAM}, coalesce(array_max(transform(pieces, p -> length(p))), 0))"
_PATTERN_GRAMS = """CASE WHEN size = 0 THEN array('') ELSE array_distinct(flatten(transform(
    filter(pieces, p -> length(p) >= size),
    p -> transform(sequence(1, length(p) - size + 1), i -> substring(p, i, size))))) END"""
# Plain search texts take the fast path. \\u0001 stands in as escape character, so a backslash is an ordinary one.
_MATCH = """CASE WHEN contains(pattern, '%') OR contains(pattern, '_') THEN entry LIKE concat('%', pattern, '%') ESCAPE '\\u0001'
    ELSE contains(entry, pattern) END"""


def containing(patterns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pairs (pattern, entry) with ``entry LIKE '%pattern%'``.

    ``patterns`` has a distinct column ``pattern``, ``dictionary`` a distinct column ``entry``; both may be large.
    """
    pieces = patterns.where("pattern IS NOT NULL").selectExpr("pattern", f"{_PIECES} AS pieces")
    grams = pieces.selectExpr("pattern", "pieces", f"{_SIZE} AS size").selectExpr("pattern", f"explode({_PATTERN_GRAMS}) AS gram")
    # Only grams that some search text uses survive, so the index is never built for the rest.
    postings = dictionary.where("entry IS NOT NULL").selectExpr("entry", f"explode({_ENTRY_GRAMS}) AS gram")
    postings = written(postings.join(grams.select("gram").distinct(), "gram", "left_semi"), "postings")
    weight = postings.groupBy("gram").agg(F.expr("count(1) AS df"))
    # A gram without postings proves that its search text has no match.
    rarest = (
        grams.join(weight, "gram", "left").groupBy("pattern")
        .agg(F.expr("min(struct(coalesce(df, 0L) AS df, gram)) AS best")).where("best.df > 0").selectExpr("pattern", "best.gram AS gram")
    )
    return rarest.join(postings, "gram").where(_MATCH).select("pattern", "entry")


FIRST_LENGTH = 16  # entries read in the first round: those of at most this many characters
_LONGEST = 1 << 31


def _length_band(length: str) -> str:
    """Band of an entry length: 0 up to FIRST_LENGTH, then one band per doubling."""
    cases, limit, band = [], FIRST_LENGTH, 0
    while limit < _LONGEST:
        cases.append(f"WHEN {length} <= {limit} THEN {band}")
        limit, band = limit * 2, band + 1
    return f"CASE {' '.join(cases)} ELSE {band} END"


def shortest_containing(patterns: DataFrame, dictionary: DataFrame, k: int = 1) -> DataFrame:
    """Pairs (pattern, entry) with ``entry LIKE '%pattern%'``, for each pattern only the entries no longer than its
    k-th shortest match (all of its matches if it has fewer): every entry of that length is kept, so the caller's own
    order (length, then its ids) decides among them.

    Postings of a pattern's rarest gram are laid out by entry length. Reading goes in rounds of doubling length; a
    pattern leaves as soon as k matches stand, so a short text such as ``1``, which most entries hold, meets the
    short entries only. Rounds end when the longest entry has been read.
    """
    pieces = patterns.where("pattern IS NOT NULL").selectExpr("pattern", f"{_PIECES} AS pieces")
    grams = pieces.selectExpr("pattern", "pieces", f"{_SIZE} AS size").selectExpr("pattern", f"explode({_PATTERN_GRAMS}) AS gram")
    postings = dictionary.where("entry IS NOT NULL").selectExpr("entry", "length(entry) AS len", f"explode({_ENTRY_GRAMS}) AS gram")
    postings = postings.join(grams.select("gram").distinct(), "gram", "left_semi").selectExpr("*", f"{_length_band('len')} AS band")
    spark = postings.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/postings-by-length-{uuid.uuid4().hex}"
    postings.write.partitionBy("band").parquet(path)
    postings = spark.read.schema(postings.schema).parquet(path)
    stats = postings.groupBy("gram").agg(F.expr("count(1) AS df"), F.expr("max(len) AS longest"))
    rarest = written(
        grams.join(stats, "gram", "left").groupBy("pattern")
        .agg(F.expr("min(struct(coalesce(df, 0L) AS df, gram, longest)) AS best")).where("best.df > 0")
        .selectExpr("pattern", "best.gram AS gram", "best.longest AS longest"),
        "rarest",
    )
    found, open_, limit, band = [], rarest, FIRST_LENGTH, 0
    while True:
        read = postings.where(f"band <= {band} AND len <= {limit}")
        hits = open_.join(read, "gram").where(_MATCH).select("pattern", "entry", "len", "longest")
        ranked = hits.selectExpr("*", "row_number() OVER (PARTITION BY pattern ORDER BY len, entry) AS rn")
        kth = ranked.where(f"rn <= {k}").groupBy("pattern").agg(F.expr("count(1) AS n"), F.expr("max(len) AS cut"))
        done = written(
            open_.join(kth, "pattern", "left").selectExpr(
                "pattern", f"coalesce(n, 0) >= {k} OR longest <= {limit} AS settled", "coalesce(cut, 0) AS cut"
            ),
            "settled",
        )
        found.append(
            written(hits.join(done.where("settled"), "pattern").where("len <= cut").select("pattern", "entry"), "shortest")
        )
        open_ = written(open_.join(done.where("NOT settled"), "pattern", "left_semi"), "open")
        if open_.isEmpty():
            break
        limit, band = limit * 2, band + 1
    return reduce(lambda a, b: a.unionByName(b), found)
