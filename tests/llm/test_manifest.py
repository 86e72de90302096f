"""Merkle manifest against a plain recomputation of the tree, on several block widths and odd input."""

import hashlib
import zlib

import pytest

from civicspark.llm import manifest



@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    if v is None:
        return "-"
    s = str(v)
    return f"{len(s.encode())}:{s}"


def leaf_of(r):
    return H("".join(field(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))


def levels(nodes):
    """All levels of the tree over ``nodes``, bottom first."""
    out = [nodes]
    while len(out[-1]) > 1:
        cur = out[-1]
        out.append([H("".join(cur[i : i + 2])) for i in range(0, len(cur), 2)])
    return out


def witness(levs, i):
    path = []
    for lev in levs[:-1]:
        j = i ^ 1
        path.append((lev[j], bool(i & 1)) if j < len(lev) else (None, False))
        i >>= 1
    return path


def fold(h, path):
    for sib, left in path:
        h = H(h) if sib is None else H(sib + h) if left else H(h + sib)
    return h


def brute(rows):
    rows = [dict(r) for r in rows]
    for r in rows:
        r["leaf"] = leaf_of(r)
    key = lambda lang: (0, b"") if lang is None else (1, lang.encode())
    langs = sorted({r["lang"] for r in rows}, key=key)
    subs, per = [], {}
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        levs = levels([r["leaf"] for r in mine])
        per[lang] = (mine, levs)
        subs.append(levs[-1][0])
    top = levels(subs)
    out = []
    for g, lang in enumerate(langs):
        mine, levs = per[lang]
        for i, r in enumerate(mine):
            path = witness(levs, i) + witness(top, g)
            t = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            start = leaf_of({**r, "n_chars": r["n_chars"] + 1}) if t else r["leaf"]
            folded = fold(start, path)
            proof = H("".join(s for s, _ in path if s is not None))
            out.append((r["doc_id"], r["leaf"], levs[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


ROWS = [
    (i, f"text {i % 7} é" * (i % 3), ["en", "de", None, "fr"][i % 4] if i % 11 else "en", ["a", None][i % 5 == 0], None if i % 13 == 0 else 10 + i)
    for i in range(1, 90)
] + [(None, "no id", "en", "s", 3), (5, None, "en", None, None), (5, None, "en", None, None), (7, "x" * 200000, "日本", "s", 200000)]


@pytest.mark.parametrize("width", [1, 2, 3, 12])
def test_manifest_matches_plain_tree(spark, width):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    want = brute([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in ROWS])
    assert got(manifest.verify(df.withColumn("leaf", df.text).withColumn("_g", df.lang), width)) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


def test_manifest_single_row_and_empty(spark):
    one = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = manifest.verify(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H("")
    assert manifest.verify(one.where("false")).count() == 0


def test_manifest_on_table(spark, documents):
    rows = documents.select("doc_id", "text", "lang", "source", "n_chars").collect()
    want = brute([r.asDict() for r in rows])
    assert got(manifest.verify(documents, 4)) == want
