"""Repeated byte strings across documents, by a sparse suffix array.

A string of ``length`` bytes is removed where it also starts earlier. Only suffixes at content-defined places enter the
array: of the ``K``-byte grams in each string the one with the least hash (the leftmost of equal ones) is its anchor, so
equal strings have equal anchors at equal distances, and no string is without one. Then, with every byte of every text
looked at:

1. grams that occur once are dropped: strings around them cannot repeat;
2. anchors left are grouped by gram; one whose whole surroundings (all strings around the anchor) stood earlier is
   covered, and only the first of each kind of surroundings goes on, where a gram has more than one kind;
3. their suffixes are range-partitioned by leading bytes at sampled splitters, sorted in each bucket by multikey
   quicksort (words of eight bytes, only ties are sorted further), and equal neighbours are compared by document and
   place. A splitter is a gram's leading bytes, so equal strings never lie on two sides of a boundary.

Copies of a whole text are covered by their first one from the start and take no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, fresh, slices, utf8, written

LENGTH = 100
K = 32
PLACES = 23
BYTES_PER_BUCKET = 32 << 20
PER_RANGE = 20_000
SAMPLE = 20_000
CELLS = 1 << 21
STRINGS = 300_000

_letters = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place (K is a power of two); shorter than ``data`` by K - 1."""
    h, step = _letters[data], 1
    while step < K:
        h = (h[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[step:] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[step:] >> np.uint64(31)))
        step *= 2
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of ``width``."""
    step, least = 1, keys
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return least if step == width else np.minimum(least[: len(keys) - width + 1], least[width - step :])


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and gram hash of every anchor, in that order."""
    window = length - K + 1
    out: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) < CELLS):
            total += len(texts[end])
            end += 1
        starts = np.cumsum([0, *(len(t) for t in texts[at:end])])
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        first, found = np.flatnonzero(np.diff(starts) >= length), []
        for low in range(0, max(0, len(data) - length + 1), 1 << (PLACES - 1)):  # a very long text goes in steps
            part = data[low : low + (1 << (PLACES - 1)) + length - 1]
            h = gram_hashes(part)
            keys = (h >> np.uint64(PLACES) << np.uint64(PLACES)) | np.arange(len(h), dtype=np.uint64)
            least = window_least(keys, window)
            ok = np.zeros(len(data) - length + 2, np.int8)
            ok[starts[first]] += 1
            ok[np.minimum(starts[first + 1] - length + 1, len(ok) - 1)] -= 1
            valid = np.cumsum(ok)[low : low + len(least)] > 0
            place = (least[valid[: len(least)]] & np.uint64((1 << PLACES) - 1)).astype(np.int64)
            place = place[np.flatnonzero(np.diff(place, prepend=-1))]
            found.append((place + low, h[place]))
        if found:
            place, h = (np.concatenate(x) for x in zip(*found, strict=True))
            place, pick = np.unique(place, return_index=True)
            text = np.searchsorted(starts, place, "right") - 1
            out.append((text + at, place - starts[text], h[pick]))
        at = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one value."""
    return b"".join(np.ascontiguousarray(a).astype("<i8" if a.dtype.kind == "i" else "<u8").tobytes() for a in arrays)


def unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    n = len(blob) // (8 * len(kinds))
    return [np.frombuffer(blob, f"<{k}8", n, 8 * n * i) for i, k in enumerate(kinds)]


def dealt(bucket: np.ndarray, *arrays: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One value of packed arrays per bucket."""
    order = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[order], return_index=True)
    edges = [*at.tolist(), len(order)]
    sorted_ = [a[order] for a in arrays]
    return ids.tolist(), [pack(*(a[s:e] for a in sorted_)) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_)))


def gram_rows(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, blob): documents and grams of all anchors, dealt by gram; a gram twice in a document counts twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                text, _, h = anchors(utf8(batch.column("text")), length)
                bucket, blob = dealt((h % np.uint64(buckets)).astype(np.int64), ids[text], h)
                yield pa.record_batch([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, blob binary")


def repeated_grams(rows: DataFrame) -> DataFrame:
    """(doc_id, gram) of grams that stand at two places or more."""

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpack(b, "iu") for b in table.column("blob").to_pylist()]
        doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        start, size = runs(h[order])
        keep = order[np.repeat(size > 1, size)]
        pairs = np.unique(np.stack([doc[keep], h[keep].view(np.int64)]), axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], ["doc_id", "gram"])

    return rows.groupBy("bucket").applyInArrow(meet, "doc_id long, gram long")


def flagged_texts(docs: DataFrame, flags: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """(doc_id, sha, packed, blob): the text, compressed, and place, gram and hash of the surroundings of each anchor
    whose gram is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, blobs = utf8(batch.column("text")), []
                text, place, h = anchors(texts, length)
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                for i, (raw, wanted) in enumerate(zip(texts, batch.column("grams"), strict=True)):
                    own = slice(edges[i], edges[i + 1])
                    keep = np.isin(h[own].view(np.int64), wanted.values.to_numpy())
                    p, g = place[own][keep], h[own][keep]
                    around = np.array([surroundings(raw, x, length) for x in p.tolist()], np.uint64)
                    blobs.append(pack(p, g, around))
                columns = [batch.column("doc_id"), batch.column("sha"), pa.array([squeeze(t) for t in texts], pa.binary()), pa.array(blobs, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "sha", "packed", "blob"])

    grams = flags.groupBy("doc_id").agg(F.collect_list("gram").alias("grams")).join(firsts.select(F.col("first").alias("doc_id"), "sha"), "doc_id")
    joined = docs.select("doc_id", "text").join(grams, "doc_id").where(F.sha2(F.col("text").cast("binary"), 256) == F.col("sha"))
    return joined.select("doc_id", "sha", "text", "grams").mapInArrow(run, "doc_id long, sha string, packed binary, blob binary")


def raw_texts(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column.to_pylist()]


def surroundings(raw: bytes, place: int, length: int) -> int:
    left, right = min(place, length - K), min(len(raw) - place, length)
    return xxhash.xxh3_64_intdigest(raw[place - left : place + right], left << 8 | (length - right & 255))


def first_surroundings(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """(doc_id, place, gram, first): anchors of repeated grams. Not first: covered, as the same surroundings stood
    earlier. First: to be compared with the other kinds of surroundings of its gram. Others are dropped."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [unpack(b, "iuu") for b in batch.column("blob").to_pylist()]
            if not columns:
                continue
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(c[0]) for c in columns])
            place, h, around = (np.concatenate(x) for x in zip(*columns, strict=True))
            bucket, blob = dealt((h % np.uint64(buckets)).astype(np.int64), ids, place, h, around)
            yield pa.record_batch([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpack(b, "iiuu") for b in table.column("blob").to_pylist()]
        doc, place, h, around = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, doc, around, h))
        doc, place, h, around = doc[order], place[order], h[order], around[order]
        again = np.zeros(len(h), bool)  # the same place, from a row given twice
        again[1:] = (h[1:] == h[:-1]) & (around[1:] == around[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
        doc, place, h, around = doc[~again], place[~again], h[~again], around[~again]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
        start, size = runs(h)
        kinds = np.add.reduceat(first.astype(np.int64), start)
        keep = ~first | np.repeat(kinds > 1, size)
        return pa.table([pa.array(doc[keep]), pa.array(place[keep]), pa.array(h[keep].view(np.int64)), pa.array(first[keep])], ["doc_id", "place", "gram", "first"])

    rows = texts.select("doc_id", "blob").mapInArrow(deal, "bucket long, blob binary")
    return rows.groupBy("bucket").applyInArrow(meet, "doc_id long, place long, gram long, first boolean")


def context_rows(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc_id, place, left, context): the bytes around the wanted anchors, ``left`` of them before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "packed"):
                row, place, left, context = [], [], [], []
                for i, (raw, places) in enumerate(zip(raw_texts(batch.column("packed")), batch.column("places").to_pylist(), strict=True)):
                    for p in places:
                        before = min(p, length - K)
                        row.append(i)
                        place.append(p)
                        left.append(before)
                        context.append(raw[p - before : p + length])
                yield pa.record_batch([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(place, pa.int64()), pa.array(left, pa.int32()), pa.array(context, pa.binary())], ["doc_id", "place", "left", "context"])

    places = wanted.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    return texts.select("doc_id", "packed").join(places, "doc_id").mapInArrow(run, "doc_id long, place long, left int, context binary")


def equal_strings(words: np.ndarray, base: np.ndarray, length: int) -> np.ndarray:
    """Class of each suffix among those equal in ``length`` bytes, -1 for one without an equal, by multikey quicksort:
    sort by one word, go on only inside ties. ``words`` holds the eight bytes from each place, ``base`` the starts."""
    rank, live = np.zeros(len(base), np.int64), np.arange(len(base))
    for at in range(0, length, 8):
        w = words[base[live] + at]
        if at + 8 > length:
            w = w >> np.uint64(8 * (at + 8 - length))
        order = np.lexsort((w, rank[live]))
        live, w = live[order], w[order]
        r = rank[live]
        new = np.ones(len(live), bool)
        new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
        start, size = runs(np.cumsum(new))
        rank[live] = np.cumsum(new)
        alone = np.repeat(size == 1, size)
        rank[live[alone]] = -1
        live = live[~alone]
        if not len(live):
            break
    return rank


def later_strings(doc: np.ndarray, place: np.ndarray, left: np.ndarray, contexts: list[bytes], length: int) -> tuple[list, list, list]:
    """Spans (doc, start, end) covered by strings of the contexts that stand earlier in another of them."""
    reach = length - K
    pad = -(-length // 8) * 8 - length
    size = np.array([len(c) for c in contexts], np.int64)
    grid = np.zeros((len(contexts), reach + length + pad + 8), np.uint8)
    for i, c in enumerate(contexts):
        grid[i, reach - left[i] : reach - left[i] + len(c)] = np.frombuffer(c, np.uint8)
    words, found = np.zeros(grid.size, np.uint64), []
    for b in range(8):
        words = (words << np.uint64(8)) | np.roll(grid.ravel(), -b)
    step = max(1, STRINGS // max(1, len(contexts)))
    for low in range(0, reach + 1, step):  # equal strings stand at equal distances from their gram
        offset = np.arange(low, min(low + step, reach + 1))
        row, at = np.nonzero((offset >= reach - left[:, None]) & (offset + length <= reach - left[:, None] + size[:, None]))
        group = equal_strings(words, row * grid.shape[1] + at + low, length)
        tied = np.flatnonzero(group >= 0)
        start = place[row] - reach + at + low
        order = tied[np.lexsort((start[tied], doc[row[tied]], group[tied]))]
        g, d, s = group[order], doc[row[order]], start[order]
        same = np.zeros(len(order), bool)
        same[1:] = g[1:] == g[:-1]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        # The first of a class stays; it may stand in the class more than once.
        later = same & ~((d == d[head]) & (s == s[head]))
        found.append((d[later], s[later]))
    d, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return spans(d, s, s + length)


def spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list, list, list]:
    """Maximal runs of the given stretches, per document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    out: tuple[list, list, list] = ([], [], [])
    for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
        if out[0] and out[0][-1] == d and s <= out[2][-1]:
            out[2][-1] = max(out[2][-1], e)
        else:
            out[0].append(d)
            out[1].append(s)
            out[2].append(e)
    return out


def sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, end) found by sorting the suffixes of the contexts, range-partitioned at sampled splitters."""
    lead = F.expr(f"substring(context, left + 1, {K})")
    rows = contexts.withColumn("lead", lead)
    n = rows.count()
    ranges = buckets_for(n, PER_RANGE)
    share = min(1.0, SAMPLE / max(1, n))
    keys = sorted(bytes(r[0]) for r in rows.where(F.pmod(F.xxhash64("lead", "doc_id", "place"), F.lit(1 << 20)) < int(share * (1 << 20))).select("lead").limit(4 * SAMPLE).collect())
    splitters = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []

    def place_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = [bisect_right(splitters, x) for x in batch.column("lead").to_pylist()]
            yield pa.record_batch([pa.array(bucket, pa.int64()), *(batch.column(c) for c in names)], ["bucket", *names])

    def meet(table: pa.Table) -> pa.Table:
        lead = table.column("lead").to_pylist()
        order = sorted(range(len(lead)), key=lead.__getitem__)
        found: tuple[list, list, list] = ([], [], [])
        doc, place, left = (table.column(c).to_numpy() for c in ("doc_id", "place", "left"))
        context = table.column("context").to_pylist()
        at = 0
        while at < len(order):  # whole grams at a time, so that the words of few suffixes are held at once
            end = min(at + 4000, len(order))
            while end < len(order) and lead[order[end]] == lead[order[end - 1]]:
                end += 1
            part = order[at:end]
            for a, b in zip(found, later_strings(doc[part], place[part], left[part].astype(np.int64), [context[i] for i in part], length), strict=True):
                a += b
            at = end
        return pa.table([pa.array(x, pa.int64()) for x in found], ["doc_id", "start", "end"])

    names = ["doc_id", "place", "left", "context", "lead"]
    placed = rows.mapInArrow(place_in, "bucket long, doc_id long, place long, left int, context binary, lead binary")
    return placed.groupBy("bucket").applyInArrow(meet, "doc_id long, start long, end long")


def removals(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``docs`` (doc_id, n_bytes, sha, copy); what to remove of the others with repeated strings (doc_id, sha,
    places, strings, one row per document, see ``stretches``); and the texts of these (doc_id, sha, packed).

    ``copy`` marks later copies of a whole text of at least ``length`` bytes: all of it is to be removed. Ids order the
    documents. Of different texts under one id, the one with the least digest takes part, the others are kept whole;
    equal rows get equal results. Rows without id are kept whole. Null texts are empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    base = written(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "sha"), "digests")
    long_ones = base.where(F.col("n_bytes") >= length).where("doc_id IS NOT NULL")
    chosen = long_ones.groupBy("doc_id").agg(F.min("sha").alias("sha"))
    firsts = written(chosen.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "firsts")
    marked = base.join(firsts, "sha", "left").join(chosen.withColumnRenamed("sha", "own"), "doc_id", "left")
    marked = marked.select("doc_id", "n_bytes", "sha", F.coalesce((F.col("n_bytes") >= length) & (F.col("own") == F.col("sha")) & (F.col("doc_id") > F.col("first")), F.lit(False)).alias("copy"))
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, buckets_for(total, BYTES_PER_BUCKET))
    flags = repeated_grams(gram_rows(rows.where("doc_id IS NOT NULL"), buckets, length)).join(firsts.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    texts = written(flagged_texts(rows, flags, firsts, length), "flagged")
    found = written(first_surroundings(texts, buckets, length), "surroundings")
    compared = sorted_buckets(written(context_rows(texts, found.where("first"), length), "contexts"), length)
    covered = found.where("NOT first").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    strings = compared.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("strings"))
    cuts = covered.join(strings, "doc_id", "full_outer").join(firsts.select(F.col("first").alias("doc_id"), "sha"), "doc_id")
    return marked, cuts.select("doc_id", "sha", "places", "strings"), texts.select("doc_id", "sha", "packed")


def stretches(size: int, places: list[int] | None, strings: list[dict] | None, length: int) -> tuple[list, list]:
    """Starts and ends of the maximal runs to remove from a text of ``size`` bytes: the surroundings of covered anchors
    at ``places``, and ``strings``."""
    pairs = [(max(0, p - length + K), min(size, p + length)) for p in places or ()] + [(x["start"], x["end"]) for x in strings or ()]
    s, e = np.array([p for p in pairs if p[1] - p[0] >= length], np.int64).reshape(-1, 2).T
    return spans(np.zeros(len(s), np.int64), s, e)[1:]


def kept_bytes(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see ``removals``)."""
    marked, cuts, texts = removals(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "packed"):
                made = []
                for raw, places, strings in zip(raw_texts(batch.column("packed")), batch.column("places").to_pylist(), batch.column("strings").to_pylist(), strict=True):
                    starts, ends = stretches(len(raw), places, strings, length)
                    made.append((sum(ends) - sum(starts), len(starts), hashlib.sha256(kept_bytes(raw, starts, ends)).hexdigest()))
                n_removed, n_spans, kept = list(zip(*made, strict=True)) or [()] * 3
                yield pa.record_batch([batch.column("doc_id"), batch.column("sha"), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "sha", "n_removed", "n_spans", "kept_sha256"])

    done = texts.join(cuts.drop("sha"), "doc_id").mapInArrow(run, "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string")
    out = marked.join(done.dropDuplicates(["doc_id", "sha"]), ["doc_id", "sha"], "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def whole_characters(raw: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The runs drawn in to the edges of UTF-8 characters; a run inside one character goes."""
    out: tuple[list[int], list[int]] = ([], [])
    for s, e in zip(starts, ends, strict=True):
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out[0].append(s)
            out[1].append(e)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", count: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text`` (whole characters only) and, if there is such a column,
    ``count`` taken anew. A later copy of a whole text becomes empty; no row is dropped. See ``removals``.

    What meets ``docs`` are the places to cut, not the texts left: a text is exchanged once here, and cut where it is.
    """

    @F.arrow_udf("string")
    def left_of(texts: pa.Array, places: pa.Array, strings: pa.Array) -> pa.Array:
        out: list[bytes | None] = []
        for raw, p, s in zip(texts.cast(pa.binary()), places, strings, strict=True):
            if not raw.is_valid:
                out.append(None)
                continue
            raw = raw.as_py()
            out.append(kept_bytes(raw, *whole_characters(raw, *stretches(len(raw), p.as_py(), s.as_py(), length))))
        return pa.array(out, pa.binary()).cast(pa.string())

    marked, cuts, _ = removals(docs.select("doc_id", F.col(text).alias("text")), length)
    copies = marked.where("copy").select("doc_id", "sha").distinct()
    key, digest, places, strings, whole, rest = (fresh(c, docs.columns) for c in ("_id", "_sha", "_places", "_strings", "_whole", "_rest"))
    new = cuts.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True).toDF(key, digest, places, strings, whole)
    own = (F.col("doc_id").cast("long") == F.col(key)) & (F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256) == F.col(digest))
    cut = left_of(F.when(~F.col(whole), F.col(text).cast("string")), F.col(places), F.col(strings))
    out = docs.join(new, own, "left").withColumn(rest, cut).withColumn(rest, F.when(F.col(whole), F.lit("")).otherwise(F.col(rest)))
    out = out.withColumn(text, F.coalesce(rest, F.col(text)))
    if count in docs.columns:
        out = out.withColumn(count, F.when(F.col(rest).isNull(), F.col(count)).otherwise(F.length(rest)).cast(dict(docs.dtypes)[count]))
    return out.select(*docs.columns)
