"""URL filter: rules first, then the ratio of two character models.

Urls that a rule accepts or rejects train one smoothed variable-order Markov model each; the others are judged by the
difference of the two log-likelihoods, divided by the number of characters, against a threshold calibrated on a part
of the ruled urls that is kept out of the counts. Counts cover all ruled urls and are exact: a Spark table with a row for
each character and context seen, which grows with the corpus and meets the urls to be judged in joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 6
WEIGHT = 2.0
UNIFORM = 1 / 256
SCALE = 1e9
BINS = 4000
SPAN = 8.0
GRAMS = 1 << 17


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both empty where the url is null or has no ``://``."""
    rest = F.coalesce(F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    after = F.expr("substring(_rest, length(_host) + 1)")
    return (
        pages.withColumn("_rest", rest).withColumn("_host", host)
        .withColumn("path", F.regexp_extract(after, r"(?s)^([^?#]*)", 1))
        .withColumn("host", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .drop("_rest", "_host")
    )


def ruled(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def counted(frame: DataFrame, key: str, order: int = ORDER) -> DataFrame:
    """``key``, context, next, n: how often each character of ``url_text`` follows its context of ``order`` characters.

    A context shorter than ``order`` reaches back to the start of the text; an empty ``next`` is the end. Equal rows are
    combined where they are read, at most GRAMS at a time, so a row may come several times.
    """
    kind = dict(frame.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}

        def rows() -> pa.RecordBatch:
            keys, before, after = zip(*found, strict=True)
            out = pa.record_batch([pa.array(keys, types), pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(found.values(), pa.int64())], [key, "context", "next", "n"])
            found.clear()
            return out

        for batch in batches:
            types = batch.column(key).type
            for k, text in zip(batch.column(key).to_pylist(), batch.column("url_text").to_pylist(), strict=True):
                for i in range(len(text) + 1):
                    gram = (k, text[max(0, i - order) : i], text[i : i + 1])
                    found[gram] = found.get(gram, 0) + 1
                    if len(found) >= GRAMS:
                        yield rows()
        if found:
            yield rows()

    return frame.select(key, "url_text").mapInArrow(run, f"{key} {kind}, context string, next string, n long")


def cut(frame: DataFrame, order: Column) -> DataFrame:
    """``start`` (the context reaches the start mark) and ``context`` cut to their last ``order`` symbols."""
    longer = frame.withColumn("_over", F.length("context") + F.col("start").cast("int") - order)
    context = F.when(F.col("_over") > 0, F.expr("substring(context, 1 + _over - int(start))")).otherwise(F.col("context"))
    return longer.withColumn("context", context).withColumn("start", F.col("start") & (F.col("_over") <= 0)).drop("_over")


def ratios(train: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """context, next, ratio: log(accepted) - log(rejected) of every ``wanted`` (context, next), smoothed from order 0 to
    ``order`` by the counts of all of ``train`` (url_text, accepted).

    Each order is joined to the one below it by the shortened context, so no key has more rows than there are
    characters.
    """
    n = lambda yes: F.sum(F.when(F.col("accepted") == yes, F.col("n")).otherwise(0))
    seen = counted(train, "accepted", order).groupBy("context", "next").agg(n(True).alias("a"), n(False).alias("r"), F.lit(False).alias("want"))
    zero = F.lit(0).cast("long")
    both = seen.union(wanted.select("context", "next", zero, zero, F.lit(True)).distinct())
    by_order = cut(both.withColumn("start", F.length("context") < order).withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(order)))), F.col("order"))
    # Grams that are not wanted only add to the counts of their context.
    grams = by_order.groupBy("order", "start", "context", "next").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.max("want").alias("want"))
    within = Window.partitionBy("order", "start", "context")
    table = written(grams.withColumn("all_a", F.sum("a").over(within)).withColumn("all_r", F.sum("r").over(within)).where("want"), "url_grams")
    below = None
    for k in range(order + 1):
        level = table.where(F.col("order") == k).drop("order", "want")
        if below is None:
            level = level.withColumn("_pa", F.lit(UNIFORM)).withColumn("_pr", F.lit(UNIFORM))
        else:
            level = cut(level.withColumn("_context", F.col("context")).withColumn("_start", F.col("start")), F.lit(k - 1)).join(below, ["start", "context", "next"])
            level = level.drop("start", "context").withColumnsRenamed({"_start": "start", "_context": "context"})
        p = lambda side: (F.col(side) + WEIGHT * F.col(f"_p{side}")) / (F.col(f"all_{side}") + WEIGHT)
        below = level.select("start", "context", "next", p("a").alias("_pa"), p("r").alias("_pr"))
    return below.select("context", "next", (F.log("_pa") - F.log("_pr")).alias("ratio"))


def scored(texts: DataFrame, train: DataFrame, order: int = ORDER) -> DataFrame:
    """key, score: mean ratio over the characters (end mark included) of each of ``texts`` (key, url_text)."""
    wanted = written(counted(texts, "key", order), "url_characters")
    each = wanted.join(ratios(train, wanted, order), ["context", "next"])
    # Sums of whole numbers do not depend on their order.
    return each.groupBy("key").agg((F.sum(F.round(F.col("ratio") * SCALE).cast("long") * F.col("n")) / SCALE / F.sum("n")).alias("score"))


def calibrate(held: DataFrame) -> float:
    """The threshold with the least sum of error rates on held-out ruled urls with their ``score`` (the middle of equally good ones)."""
    place = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("score"))) + SPAN) * (BINS / (2 * SPAN)))
    rows = held.groupBy(place.alias("place"), "accepted").count().collect()  # at most 2 * BINS rows
    hist = np.zeros((2, BINS + 2))
    for r in rows:
        hist[int(r["accepted"]), int(r["place"])] += r["count"]
    if not hist[0].sum() or not hist[1].sum():
        return 0.0
    below, above = np.cumsum(hist[1]) - hist[1], hist[0].sum() - (np.cumsum(hist[0]) - hist[0])
    wrong = below / hist[1].sum() + above / hist[0].sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best.mean() * (2 * SPAN / BINS) - SPAN)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the model's ``score`` and ``threshold`` where no rule fits.

    Rules see host and path; the models learn and score the whole url as it is written, a null one as empty. Null urls
    and urls without ``://`` have empty host and path and are judged by the model like any other. Repeated rows stay. Where no url is accepted or none rejected by a rule, the threshold is 0 and the missing side's model is
    the uniform one. Other columns are dropped.
    """
    rule, verdict = ruled(rules)
    rows = with_parts(pages.select("page_id", F.col("url").cast("string").alias("_url")), "_url").withColumn("rule", rule).withColumn("verdict", verdict)
    rows = rows.withColumn("url_text", F.coalesce("_url", F.lit("")))
    rows = rows.withColumn("key", F.unhex(F.md5(F.col("url_text").cast("binary"))))
    held = F.crc32(F.col("url_text").cast("binary")) % 5 == 0
    train = rows.where(F.col("rule").isNotNull() & ~held).select("url_text", (F.col("verdict") == "allow").alias("accepted"))
    scores = written(scored(rows.where(F.col("rule").isNull() | held).select("key", "url_text").distinct(), train), "url_scores")
    threshold = calibrate(rows.where(F.col("rule").isNotNull() & held).select("key", (F.col("verdict") == "allow").alias("accepted")).join(scores, "key"))
    by_rule = rows.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    rest = rows.where("rule IS NULL").select("key", "page_id", "host", "path").join(scores, "key")
    by_model = rest.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score")
    return by_rule.unionByName(by_model).withColumn("threshold", F.lit(threshold))
