"""Packing documents into sequences by bin completion.

Documents become pieces of at most ``size`` ids; only the number of pieces per length decides how they are packed, so
the search works on a table of at most ``size`` counts, whatever the number of documents. It fills the sequence of the
largest piece left with an undominated filling, applies that pattern as often as the counts allow, and goes on. Total
waste above what the incumbent allows prunes a branch; best fit decreasing gives the first incumbent. Spark then deals
the pieces to the slots of the patterns by their rank within their length.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import buckets_for, slices, tokenizer_file, utf8, written

SIZE = 2048
END_ID = 0
KNOWN = 120_000
REMEMBERED = 64
PART = 1 << 18
SIMPLE = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*$"
PIECES = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9\n]+")
WIDTH = 6
NODES = 400
BRANCHES = 3
STEPS = 20_000
PER_BUCKET = 100_000


def ids_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that begin at ``start``, one after the other, in parts of bounded size."""
    out = [ids[:0]]
    for at in range(0, len(start), PART):
        first, n = start[at : at + PART], length[at : at + PART]
        ends = np.cumsum(n)
        out.append(ids[np.repeat(first - ends + n, n) + np.arange(ends[-1])])
    return np.concatenate(out)


def starts(length: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, and the end of the last."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])


class Words:
    """Ids of whole texts, from a tokenizer that drops white space. Each distinct stretch between ASCII white space is
    encoded on its own; simple Latin ones are cut into pre-tokens first. Pre-tokens and the other stretches are
    remembered in two generations, so that memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.known: dict[bytes | str, bytes] = {}
        self.older: dict[bytes | str, bytes] = {}

    def forget(self) -> None:
        """The memory of a task does not outlive it: its worker goes on to other steps."""
        self.known, self.older = {}, {}
        pa.default_memory_pool().release_unused()

    def tokenize(self, pieces: list[str]) -> list[bytes]:
        """Ids of lower-case pre-tokens."""
        shown = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        return [ids_bytes([t.id for t in self.model.tokenize(x)]) for x in shown]

    def encode(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of any stretches, by the whole tokenizer."""
        texts = [w.decode("utf-8", "surrogatepass") for w in stretches]
        return [ids_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lookup(self, keys: list, encode) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """Ids of distinct keys, one after the other, and how many each has. Keys of usual length are remembered."""
        if len(self.known) + len(keys) > KNOWN:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found, new = list(map(known.get, keys)), []
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = ids = older.get(keys[i])
                if ids is None:
                    new.append(i)
                else:
                    known[keys[i]] = ids
        for i, ids in zip(new, encode([keys[i] for i in new]), strict=True):
            found[i] = ids
            if len(keys[i]) <= REMEMBERED:
                known[keys[i]] = ids
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def simple(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple Latin stretches, one after the other, and how many each has. The tokenizer's own rule cuts all
        of them at once."""
        cut = pa.array(PIECES.findall("\n".join(stretches).lower()), pa.string()).dictionary_encode()
        pieces, at = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), cut.indices.to_numpy()
        mark = pieces.index("\n") if "\n" in pieces else -1
        within = at != mark
        if mark >= 0:  # no pre-token: it holds the place of one without ids
            pieces[mark] = ""
        ids, n = self.lookup(pieces, self.tokenize)
        at, word = at[within], np.cumsum(~within)[within]
        return gathered(ids, starts(n)[at], n[at]), np.bincount(word, n[at], len(stretches)).astype(np.int64)

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = cut.values.dictionary_encode()  # each distinct stretch is looked up once
        plain = pc.and_not(pc.match_substring_regex(coded.dictionary, SIMPLE), pc.match_substring(coded.dictionary, "<|"))
        ids, n = self.simple(coded.dictionary.filter(plain).to_numpy(zero_copy_only=False).tolist())
        more, m = self.lookup(coded.dictionary.filter(pc.invert(plain)).view(pa.binary()).to_pylist(), self.encode)
        length, first, where = np.zeros(len(plain), np.int64), np.zeros(len(plain), np.int64), plain.to_numpy(zero_copy_only=False)
        length[where], first[where] = n, starts(n)[:-1]
        length[~where], first[~where] = m, starts(m)[:-1] + len(ids)
        at = coded.indices.to_numpy()
        out = gathered(np.concatenate([ids, more]), first[at], length[at])
        ends = starts(length[at])[cut.offsets.to_numpy()]
        return [out[a:b].tobytes() for a, b in zip(ends, ends[1:])]


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    """The tokenizer of a file, kept by each Python worker."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of the whole texts (null: empty), each ended by id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, end = words(tokenizer_file(tokenizer)), np.array([END_ID], "<u4").tobytes()
        try:
            for whole in batches:
                for batch in slices(whole, "text"):
                    doc, piece, start, length, crc = [], [], [], [], []
                    for row, ids in enumerate(own.encode_all(utf8(batch.column("text")))):
                        ids += end
                        n = len(ids) // 4
                        for p, at in enumerate(range(0, n, size)):
                            part = ids[4 * at : 4 * (at + size)]
                            doc.append(row)
                            piece.append(p)
                            start.append(at)
                            length.append(len(part) // 4)
                            crc.append(zlib.crc32(part))
                    columns = [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                    yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            own.forget()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Stock:
    """Pieces left, by length."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] = self.left.get(size, 0) - n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        elif self.left[size] == -n:  # put back: n is below 0
            self.sizes.insert(bisect_right(self.sizes, size), size)

    def largest(self, most: int) -> int:
        """The largest length left that is at most ``most``; 0 if there is none."""
        at = bisect_right(self.sizes, most)
        return self.sizes[at - 1] if at else 0


def best_fit(stock: Stock, size: int) -> list[tuple[int, ...]]:
    """One filling: the largest piece, then always the largest that fits."""
    out, room = [], size
    while s := stock.largest(room):
        out.append(s)
        stock.take(s, 1)
        room -= s
    for s in out:
        stock.take(s, -1)
    return out


def fillings(stock: Stock, room: int, most: int) -> list[tuple[int, tuple[int, ...]]]:
    """Up to ``most`` undominated fillings (waste, lengths) of ``room``, least waste first.

    A filling is dominated if a piece left fits into its waste, or if two of its pieces can be replaced by one piece
    left that is as long or longer and still fits.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    nodes = 0

    def go(room: int, top: int, items: tuple[int, ...]) -> bool:
        nonlocal nodes
        nodes += 1
        s = stock.largest(min(room, top))
        if not s:
            if not stock.largest(room):
                for i in range(len(items)):
                    for j in range(i):
                        pair = items[i] + items[j]
                        if pair <= stock.largest(pair + room):
                            return False
                found.append((room, items))
            return room == 0 and len(found) >= 1
        if found and nodes > NODES:
            return True
        for _ in range(WIDTH):
            stock.take(s, 1)
            done = go(room - s, s, (*items, s))
            stock.take(s, -1)
            if done:
                return True
            s = stock.largest(s - 1)
            if not s or nodes > NODES and found:
                break
        return False

    go(room, room, ())
    if not found:
        rest = best_fit(stock, room)
        found.append((room - sum(rest), tuple(rest)))
    return sorted(found)[:most]


def dive(counts: dict[int, int], size: int, choose) -> list[tuple[int, tuple[int, ...]]]:  # noqa: ANN001
    """Patterns (times, lengths) until nothing is left; ``choose`` picks the filling around the largest piece."""
    stock, plan = Stock(counts), []
    while stock.sizes:
        first = stock.sizes[-1]
        stock.take(first, 1)
        rest = choose(stock, size - first)
        stock.take(first, -1)
        items = (first, *rest)
        need = {s: items.count(s) for s in set(items)}
        times = min(stock.left[s] // n for s, n in need.items())
        for s, n in need.items():
            stock.take(s, n * times)
        plan.append((times, items))
    return plan


def solve(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times, lengths) that use each piece once, in as few sequences as the search finds.

    Each pattern uses up at least one length to below what it needs of it, so there are a few patterns per length at
    most. Returns at once when the lower bound, all ids divided by the size, is met.
    """
    total = sum(s * n for s, n in counts.items())
    bound = -(-total // size)
    best = dive(counts, size, best_fit)
    bins = sum(t for t, _ in best)
    if bins == bound:
        return best
    stock, path, steps = Stock(counts), [], 0
    used = waste = 0

    def options() -> list[tuple[int, tuple[int, ...]]]:
        first = stock.sizes[-1]
        stock.take(first, 1)
        rest = fillings(stock, size - first, BRANCHES)
        stock.take(first, -1)
        return [(w, (first, *items)) for w, items in rest][::-1]

    stack = [options()] if stock.sizes else []
    while stack and steps < STEPS and bins > bound:
        steps += 1
        if not stack[-1]:
            stack.pop()
            if path:
                times, items, w = path.pop()
                for s in set(items):
                    stock.take(s, -times * items.count(s))
                used -= times
                waste -= times * w
            continue
        w, items = stack[-1].pop()
        times = min(stock.left[s] // items.count(s) for s in set(items))
        # Fewer sequences than the incumbent leave this much waste in all.
        if waste + times * w > (bins - 1) * size - total:
            fits = ((bins - 1) * size - total - waste) // w if w else times
            if fits < 1:
                continue
            times = min(times, fits)
        for s in set(items):
            stock.take(s, times * items.count(s))
        path.append((times, items, w))
        used += times
        waste += times * w
        if stock.sizes:
            stack.append(options())
        else:
            if used < bins:
                best, bins = [(t, i) for t, i, _ in path], used
            stack.append([])
    return best


def slots(plan: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Where pieces go: per length and run of ranks, the first sequence, pieces per sequence and first offset."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, items in plan:
        offset = 0
        for s in sorted(set(items), reverse=True):
            n = items.count(s)
            rows.append((s, rank.get(s, 0), sequence, n, offset))
            rank[s] = rank.get(s, 0) + times * n
            offset += s * n
        sequence += times
    rows.sort()
    names = ("length", "rank", "sequence", "per", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one id; repeated rows are packed each; null ids stay; an empty table gives no rows; other
    columns are not read. The driver holds the counts of at most ``size`` lengths and the patterns made of them.
    """
    cut = written(pieces(docs, tokenizer, size), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    at = slots(solve(counts, size))
    buckets = buckets_for(sum(counts.values()), PER_BUCKET)
    placed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    # Ranks within a length: rows before this bucket, then the place in it, so no length is one task's work.
    sums = placed.groupBy("length", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("length", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = placed.join(base, ["length", "bucket"]).withColumn("rank", F.col("before") + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = at["length"] << 44 | at["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.searchsorted(key, length << 44 | rank, "right") - 1
            k = rank - at["rank"][row]
            sequence, offset = at["sequence"][row] + k // at["per"][row], at["offset"][row] + k % at["per"][row] * length
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = dict(docs.dtypes)["doc_id"]
    return ranked.select(*names, "rank").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
