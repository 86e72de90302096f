"""Document fingerprints from closed syncmers, in built-in functions only.

A run of ``K`` words is a closed syncmer if, of the ``K - S + 1`` runs of ``S`` words in it, the one with the least hash
is the first or the last. Whether a run is chosen depends on its own words alone, so an edit changes only the runs that
touch it, and the chosen runs serve as anchors with positions (``anchors``). A fingerprint is the ``SIZE`` least 32-bit
hashes of the chosen runs; the likeness of two is the share they have in common of the ``SIZE`` least of both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, S = 5, 2  # S-runs in a K-run: four
SIZE = 64
RANGE_ROWS = 1000
LEAST_ID = -(1 << 63)
BLANKS = " \t\n\r\x0b\f"


def with_runs(frame: DataFrame, text: str) -> DataFrame:
    """Adds ``_words`` and ``_runs`` (s0..s3: hashes of the S-runs; last: fifth word; at: place) of the chosen runs.

    Each step stands on its own, so that no array is built again for each of its elements. A text of fewer than K words
    has none; where no run of a longer text is chosen, all are.
    """
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    step = frame.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+")))
    n = F.size("_words")
    pairs = F.greatest(n - 1, F.lit(0))
    step = step.withColumn("_pairs", F.zip_with(F.slice("_words", F.lit(1), pairs), F.slice("_words", F.lit(2), pairs), lambda a, b: F.xxhash64(a, b)))
    runs = F.greatest(n - (K - 1), F.lit(0))
    parts = [F.slice("_pairs", F.lit(i), runs) for i in (1, 2, 3, 4)] + [F.slice("_words", F.lit(5), runs)]
    step = step.withColumn("_all", F.arrays_zip(*parts))
    chosen = F.filter("_all", lambda x: (x["0"] <= F.least(x["1"], x["2"], x["3"])) | (x["3"] <= F.least(x["0"], x["1"], x["2"])))
    return step.withColumn("_runs", chosen)


def with_fingerprint(frame: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the fingerprint as a sorted array of at most SIZE integers, empty for a text without words."""
    kept = frame.columns
    step = with_runs(frame, text)

    def mark(x: Column) -> Column:
        return F.xxhash64(x["0"], x["2"], x["4"]).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)

    source = F.when(F.size("_runs") > 0, F.col("_runs")).otherwise(F.col("_all"))
    step = step.withColumn("_source", source)
    marks = F.transform("_source", lambda x: mark(x).cast("int"))
    whole = F.array((F.xxhash64(F.array_join("_words", " ")).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int"))
    of_text = F.when(F.size("_words") == 0, F.array().cast("array<int>")).when(F.size("_words") < K, whole).otherwise(marks)
    return step.withColumn(out, F.slice(F.sort_array(F.array_distinct(of_text)), 1, SIZE)).select(*kept, out)


def as_text(fingerprint: Column) -> Column:
    """Fingerprint as text: eight hexadecimal digits for each number."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long") + F.lit(1 << 31))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common numbers among the SIZE least of two fingerprints; two empty ones are alike."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, position (word, from 0), hash of every closed syncmer of the whole texts, for positional matching."""
    runs = with_runs(docs.select("doc_id", F.col(text).alias("_text")), "_text")
    placed = F.transform("_all", lambda x, i: F.struct(i.alias("position"), F.xxhash64(x["0"], x["2"], x["4"]).alias("hash"), ((x["0"] <= F.least(x["1"], x["2"], x["3"])) | (x["3"] <= F.least(x["0"], x["1"], x["2"]))).alias("chosen")))
    return runs.select("doc_id", F.explode(placed).alias("p")).where("p.chosen").select("doc_id", "p.position", "p.hash")


def followers(keys: DataFrame) -> DataFrame:
    """``keys`` (id, tie, n_chars; distinct) with the id and tie of the next by id; the first comes after the last.

    Rows are dealt to ranges at approximate quantiles; the last row of a range is followed by the first of the next, so
    only one row per range passes one task.
    """
    ranges = max(1, math.isqrt(keys.count() // RANGE_ROWS))  # ranges and their sizes both grow with the root
    cuts = sorted(set(keys.stat.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.001))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    dealt = keys.withColumn("part", part)
    me = F.struct("id", "tie")
    inside = dealt.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy("id", "tie")))
    heads = dealt.groupBy("part").agg(F.min(me).alias("head"))
    around = Window.orderBy("part")
    over = heads.select("part", F.lead("head").over(around).alias("after"), F.min("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    joined = inside.join(F.broadcast(over), "part")
    return joined.withColumn("next", F.coalesce("next", "after", "first")).select("id", "tie", "n_chars", F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    In the edited text the last quarter of the characters (rounded down) is replaced by the first as many of the next
    document. Null texts are empty. Rows of one id follow one another by a hash of the text, equal rows share one place
    and get equal results; rows without id come first (the
    least 64-bit number, which stands for no id, is taken as none). A single document is its own next one. No rows, no result.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    base = written(with_fingerprint(rows.withColumn("n_chars", F.length("text").cast("long")), "text", "print").select("id", "tie", "n_chars", "print"), "fingerprints").dropDuplicates(["id", "tie"])
    order = written(followers(base.select("id", "tie", "n_chars")), "followers")
    give = order.select(F.col("next_id").alias("id"), F.col("next_tie").alias("tie"), F.col("id").alias("to_id"), F.col("tie").alias("to_tie"), F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"))
    texts = rows.select("id", "tie", "text")  # the same columns in both joins, so that texts are shuffled once
    tails = texts.join(give, ["id", "tie"]).select(F.col("to_id").alias("id"), F.col("to_tie").alias("tie"), F.expr("left(text, quarter)").alias("tail")).dropDuplicates(["id", "tie"])
    nexts = base.join(give, ["id", "tie"]).select(F.col("to_id").alias("id"), F.col("to_tie").alias("tie"), F.col("print").alias("next_print"))
    whole = texts.join(tails, ["id", "tie"])
    edited = whole.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 4 as int))"), F.col("tail")))
    done = with_fingerprint(edited.select("id", "tie", "n_chars", "edited"), "edited", "edited_print")
    done = done.select("id", "tie", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited_print")
    out = done.join(base.select("id", "tie", "print"), ["id", "tie"]).join(nexts, ["id", "tie"])
    doc_id = F.when(F.col("id") != LEAST_ID, F.col("id")).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id")
    return out.select(doc_id, "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
