"""Byte-level BPE by segment trees over the ranks of adjacent pairs.

Each piece of text (one match of the pre-tokenizer's pattern) starts as one symbol per byte. The leaf of a symbol
holds the rank of the merge with its right neighbour, joined with its place, so that the smallest leaf is the lowest
rank and, among equal ranks, the leftmost pair. The root gives that pair; a merge changes three leaves, each followed
by one path to the root. Pieces of like size are encoded side by side as rows of one array, one merge per round.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tokenizer_file

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of the format
NONE = np.int64(1) << 62
CELLS = 1 << 15
LONG = 128
KNOWN = 250_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merges = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols, NONE where there is none (or a symbol is missing, below 0)."""
        key = left << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, by trees of the same power of two side by side."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.array([max(2, 1 << (len(p) - 1).bit_length()) if p else 0 for p in pieces])
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            step = max(1, CELLS // int(size))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                if size > LONG or len(part) < 8:
                    for row in part:
                        out[row] = self._tree(pieces[row])
                    continue
                for row, ids in zip(part, self._trees([pieces[r] for r in part], int(size)), strict=True):
                    out[row] = ids
        return out

    def _trees(self, pieces: list[bytes], size: int) -> Iterator[list[int]]:
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        places = np.arange(size)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(n, size)
        grid = np.where(places < length[:, None], self.of_byte[raw], -1)
        rank = self.rank(grid[:, :-1], grid[:, 1:])
        trees = np.full((n, 2 * size), NONE)
        trees[:, size : 2 * size - 1] = np.where(rank < NONE, rank * size + places[:-1], NONE)
        level = size
        while level > 1:
            trees[:, level // 2 : level] = np.minimum(trees[:, level : 2 * level : 2], trees[:, level + 1 : 2 * level : 2])
            level //= 2
        # Flat views from here on; symbols have one more cell per row, which stays empty.
        wide = size + 2
        symbol = np.full((n, wide), -1)
        symbol[:, 1:-1] = grid
        after = np.tile(np.arange(1, wide + 1), n)
        before = np.tile(np.arange(-1, wide - 1), n)
        flat, tree = symbol.ravel(), trees.ravel()
        live = np.flatnonzero(trees[:, 1] < NONE)
        while len(live):
            cells, nodes = live * wide, live * (2 * size)
            root = tree[nodes + 1]
            left = root % size + 1
            here = cells + left
            right = after[here]
            made = self.merged[root // size]
            flat[here] = made
            gone = cells + right
            flat[gone] = -1
            follows = after[gone]
            after[here] = follows
            before[cells + follows] = left
            lead = before[here]
            new = self.rank(np.concatenate([made, flat[cells + lead]]), np.concatenate([flat[cells + follows], made]))
            k = len(live)
            ends = nodes + size - 1
            tree[ends + right] = NONE
            tree[ends + left] = np.where(new[:k] < NONE, new[:k] * size + left - 1, NONE)
            has = lead > 0
            tree[(ends + lead)[has]] = np.where(new[k:] < NONE, new[k:] * size + lead - 1, NONE)[has]
            paths = np.concatenate([left, right, np.maximum(lead, 1)]) + (size - 1)
            base = np.concatenate([nodes, nodes, nodes])
            while paths[0] > 1:  # all nodes of a round are on the same level
                paths >>= 1
                child = base + 2 * paths
                tree[base + paths] = np.minimum(tree[child], tree[child + 1])
            live = live[tree[nodes + 1] < NONE]
        used = flat >= 0
        ids, ends = flat[used].tolist(), np.cumsum(used.reshape(n, wide).sum(1)).tolist()
        start = 0
        for end in ends:
            yield ids[start:end]
            start = end

    def _tree(self, piece: bytes) -> list[int]:
        """One long piece, on plain lists."""
        symbol = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(symbol)
        size = 1 << (n - 1).bit_length()
        rank = self.rank(symbol[:-1], symbol[1:])
        none = int(NONE)
        leaves = np.full(size, NONE)
        leaves[: n - 1] = np.where(rank < NONE, rank * size + np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        ids, merges, merged = symbol.tolist(), self.merges, self.merged.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while tree[1] < none:
            left = tree[1] % size
            right = after[left]
            ids[left] = merged[tree[1] // size]
            ids[right] = -1
            follows, lead = after[right], before[left]
            after[left] = follows
            changed = [(right, none), (left, none)]
            if follows < n:
                before[follows] = left
                got = merges.get(ids[left] << 32 | ids[follows])
                changed[1] = (left, none if got is None else got * size + left)
            if lead >= 0:
                got = merges.get(ids[lead] << 32 | ids[left])
                changed.append((lead, none if got is None else got * size + lead))
            for place, value in changed:
                node = place + size
                tree[node] = value
                while node > 1:
                    other = tree[node ^ 1]
                    node >>= 1
                    best = value if value < other else other
                    if tree[node] == best:
                        break
                    tree[node] = value = best
        return [x for x in ids if x >= 0]

    def entry(self, ids: list[int]) -> tuple[str, bytes]:
        return ",".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks not met lately. Two generations are kept, so that memory is bounded and common ones stay."""
        if len(self.known) + len(chunks) > KNOWN:
            self.older, self.known = self.known, {}
        new = []
        for chunk in chunks:
            got = self.older.get(chunk)
            if got is None:
                new.append(chunk)
            else:
                self.known[chunk] = got
        found = [self.pieces.findall(c if c[0] == "\n" else " " + c) for c in new]
        pieces = list({x for f in found for x in f})
        ids = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces]), strict=True))
        for chunk, f in zip(new, found, strict=True):
            self.known[chunk] = self.entry(ids[f[0]] if len(f) == 1 else [i for x in f for i in ids[x]])

    def chunks(self, text: str) -> list[str] | None:
        """The text cut before each blank and line break, blanks dropped; None where that cut may not be exact.

        A piece never goes on past the start of a run of white space, so the cut is exact where each run of blanks and
        breaks is one character long.
        """
        if not text or any(s in text for s in self.special):
            return None
        chunks = (text.replace("\n", " \n") if "\n" in text else text).split(" ")
        return None if "" in chunks or "\n" in chunks else chunks

    def digest_all(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, digest of the ids, digest of the text decoded from them."""
        cut, out = [self.chunks(t) for t in texts], []
        self.learn({c for chunks in cut if chunks for c in chunks[1:] if c not in self.known})
        heads = [self.pieces.findall(chunks[0]) for chunks in cut if chunks]
        pieces = list({x for f in heads for x in f})
        of_head = dict(zip(pieces, self.encode_pieces([p.encode() for p in pieces]), strict=True))
        head = iter(heads)
        known, older = self.known, self.older
        for text, chunks in zip(texts, cut, strict=True):
            if chunks is None:
                rows = [self.entry(self.encode(text))]
            else:
                rows = [self.entry([i for x in next(head) for i in of_head[x]])]
                try:
                    rows += map(known.__getitem__, chunks[1:])
                except KeyError:  # a generation ended in this call
                    rows[1:] = [known[c] if c in known else older[c] for c in chunks[1:]]
            ids = ",".join([r[0] for r in rows])
            decoded = b"".join([r[1] for r in rows]).decode("utf-8", "replace")
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of plain text and, with their ids, the special strings between them."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self.parts(text):
            if special is None:
                for one in self.encode_pieces([p.encode() for p in self.pieces.findall(part)]):
                    ids += one
            else:
                ids.append(special)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, kept by each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_frame(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), the ids of each whole text; null is empty."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts):  # noqa: ANN001, ANN202
        own = codec(tokenizer_file(tokenizer))
        return texts.fillna("").map(own.encode)

    return docs.withColumn("ids", ids(F.col(text)))


def decode_frame(frame: DataFrame, tokenizer: str = "byte_bpe_50k.json", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``frame`` with the text decoded from an array of ids; null is empty."""

    @F.pandas_udf("string")
    def texts(arrays):  # noqa: ANN001, ANN202
        own = codec(tokenizer_file(tokenizer))
        return arrays.map(lambda x: own.decode(x if x is not None else ()))

    return frame.withColumn(out, texts(F.col(ids)))


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids (digests of the empty string); repeated rows and null ids stay rows; other columns
    are not read. A map-only job: each text is encoded and decoded where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_file(tokenizer))
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = own.digest_all([x or "" for x in batch.column("text").to_pylist()])
                n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
