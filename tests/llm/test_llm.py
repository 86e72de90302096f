"""The ten operators and the pipeline against brute force, round trips and odd input."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tokenizers import Tokenizer

from civicspark.llm import bpe, chat, components, fingerprints, forest, licenses, neardup, packing, suffixes, toxicity, urls
from civicspark.llm.queries import QUERIES, STATEMENTS

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sha string, node string, bucket int, toxicity double"
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "one"), (5, "one"), (5, "two words"), (None, "no id at all here"), (6, "x" * 30000), (7, "naïve ☃ 日本語 text"), (8, LONG)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "a", "b", 1, 0.5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(documents):
    return {r.doc_id: r.text or "" for r in documents.collect()}


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


# Nearest neighbours


def test_forest_recall_and_order():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 16))
    ids = np.arange(1500)
    got = {}
    for q, v, d in zip(*forest.nearest(ids, vectors, ids[::50], vectors[::50]), strict=True):
        got.setdefault(q, []).append((d, v))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for _, v in found} & set(np.argsort(d)[:10].tolist()))
        assert found == sorted(found) and all(abs(x - d[v]) < 1e-12 for x, v in found)
    assert hits >= 0.9 * 10 * len(got)


def test_forest_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(100, None), (101, []), (102, [0.0, 0.0]), (103, [None, 1.0]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1.0, 2.0, 3.0]), (107, [9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    out = forest.search(frame, lambda f: f.where("vec_id IN (20, 102, 106)")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(20, i + 1, i, 0.0) for i in range(10)]
    assert forest.search(frame.limit(0), lambda f: f).count() == 0


def test_forest_rows_without_id(spark):
    """A row without vec_id is neither a candidate nor a query, and does not end the job."""
    rows = [(i, [float(i), 1.0]) for i in range(12)] + [(None, [5.0, 1.0]), (None, [0.5, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = forest.search(frame, lambda f: f.where("vec_id = 5 OR vec_id IS NULL")).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in out} == {5}
    assert out and all(r.vec_id is not None and r.vec_id != 5 for r in out)
    assert [r.score for r in out] == sorted(abs(r.vec_id - 5.0) for r in out)


# Near-duplicates


def brute_components(texts, width, percent):
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def copies(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    out = {}
    for i in range(n):
        edited = list(base)
        for _ in range(i % 9):
            edited[rng.randrange(200)] = rng.choice(words)
        out[i] = " ".join(edited) if i % 3 else " ".join(base)
    return out


def test_neardup_against_all_pairs(spark, documents):
    texts = texts_of(documents) | {10_000 + i: t for i, t in copies(60).items()}
    got = {r.doc_id: r for r in neardup.labelled(docs_of(spark, texts.items()), width=4).collect()}
    for d, (n, root) in brute_components(texts, 4, 80).items():
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (n, root, d == root)


def test_neardup_odd_rows(odd):
    rows = neardup.labelled(odd).collect()
    assert len(rows) == len(ODD) and [r.kept for r in rows if r.doc_id is None] == [True]
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1 and by[8].component_id == 4 and not by[8].kept
    assert neardup.labelled(odd.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 90), (90, 100)], "a long, b long")
    assert {r.id: r.component for r in components.components(links).collect()} == {**{i: 0 for i in range(61)}, 90: 90, 100: 90}


# Packing


def pieces_of(text, tokenizer, size=2048):
    ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
    return [(p, at, len(ids[at : at + size]), zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), size))]


def test_packing_places_every_piece(spark, documents, odd):
    tokenizer = library("word_bpe_49k.json")
    for frame in (documents, odd):
        rows = packing.pack(frame).collect()
        want = sorted(str((r.doc_id, *p)) for r in frame.collect() for p in pieces_of(r.text or "", tokenizer))
        assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
        ends = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 2048
    assert packing.pack(documents.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 20) for _ in range(9)]
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i]:
                place(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
        place(i + 1, [*rooms, 20 - items[i]])

    place(0, [])
    plan = packing.solve({s: items.count(s) for s in set(items)}, 20)
    assert sum(n for n, _ in plan) == best[0]
    assert sorted(s for n, p in plan for s in p * n) == sorted(items) and all(sum(p) <= 20 for _, p in plan)


def test_packing_beats_best_fit():
    counts = {7: 1, 6: 1, 5: 1, 4: 2, 2: 2}  # 30 in sequences of 15: best fit opens a third
    assert sum(n for n, _ in packing.dive(counts, 15, packing.best_fit)) == 3 or sum(n for n, _ in packing.solve(counts, 15)) == 2
    assert sum(n for n, _ in packing.solve(counts, 15)) == 2
    assert packing.solve({}, 15) == []


# Chat


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|im_start|>", "<|im_end|<|im_end|>", "<|n|>", "<\\|n|>\n", "<|im_"])
def test_chat_round_trip(text):
    for role in ("user", "assistant", "", "a\nb", "<|im_start|>", "<|n|>", "<\\|n|>\n"):
        rendered, shown = chat.render(role, text)
        assert chat.parse(rendered) == [(role, text)] and chat.unescape(shown) == text
        assert chat.parse(rendered * 3) == [(role, text)] * 3
    assert chat.parse("no turn") is None


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, None, "assistant", "a"), (1, 0, None, None), (None, 5, "assistant", "<|im_end|>"), (2, 1, "user", "é☃")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("x"))
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(frame)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"assistant\na\n\n\n\n\n").hexdigest()
    assert got[None].loss_chars == 10 and got[None].loss_sha256 == hashlib.sha256(b"<|im_end|>").hexdigest()
    assert chat.conversation_digests(chat.format_turns(frame.limit(0))).count() == 0


# Repeated strings


def brute_removed(texts, length=100):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = texts[d].encode()
        cover = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                cover[s : s + length] = True
            seen.add(part)
        kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
        out[d] = (len(raw), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes_against_all_strings(spark, documents):
    rng = random.Random(5)
    passage, line = "".join(rng.choices("abcdefgh ", k=260)), "é" * 80 + "".join(rng.choices("abc", k=40))
    own = lambda n: "".join(rng.choices("qwertzuiop ", k=n))
    made = [own(300) + passage + own(50), passage, passage[3:], own(90) + passage[:99], own(20) + passage[100:201], line + own(9), line, own(5) + line, "ab" * 400, "ab" * 300 + own(3), own(99), passage]
    texts = texts_of(documents.limit(80)) | {20_000 + i: t for i, t in enumerate(made)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removal_digests(docs_of(spark, texts.items())).collect()}
    assert got == brute_removed(texts)


def test_suffixes_odd_rows(spark, odd):
    rows = suffixes.removal_digests(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[8].n_removed == len(LONG) and by[4].n_removed > 100_000 and by[6].n_removed == 29999 and by[1].n_bytes == 0 and by[5].n_removed == 0
    cut = suffixes.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    assert cut.where("doc_id = 8").first().text == "" and cut.where("doc_id = 7").first().text == ODD[9][1]
    assert suffixes.removal_digests(odd.limit(0)).count() == 0


def test_repeats_are_cut_where_the_text_is(spark, documents):
    """No text left over meets the rows: places do. The result is the removal of the whole characters."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcé☃ ", k=260))
    texts = texts_of(documents.limit(40)) | {20_000: passage, 20_001: "x" + passage, 20_002: passage[7:200] + "yz", 20_003: passage, 20_004: "é" * 130}
    rows = docs_of(spark, [*texts.items(), (20_001, "x" + passage), (None, passage)])
    cut = suffixes.without_repeats(rows)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "packed" not in plan
    seen, want = set(), {}
    for d in sorted(texts):
        raw = texts[d].encode()
        cover = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                cover[s : s + 100] = True
            seen.add(raw[s : s + 100])
        edges = np.flatnonzero(np.diff(cover.astype(int), prepend=0)).tolist()
        want[d] = suffixes.kept_bytes(raw, *suffixes.whole_characters(raw, edges[::2], edges[1::2])).decode()
    got = cut.collect()
    assert len(got) == len(texts) + 2
    assert {(r.doc_id, r.text, r.n_chars) for r in got if r.doc_id is not None} == {(d, t, len(t)) for d, t in want.items()}
    assert [r.text for r in got if r.doc_id is None] == [passage]


def test_cuts_at_characters():
    raw = "aéb".encode()
    assert suffixes.whole_characters(raw, [0], [2]) == ([0], [1]) and suffixes.whole_characters(raw, [2], [3]) == ([], [])


# Fingerprints


def test_fingerprints_against_python(spark, documents, odd):
    frame = docs_of(spark, [(i, t) for i, t in texts_of(documents.limit(60)).items()])
    rows = sorted(fingerprints.edited_likeness(frame).collect(), key=lambda r: r.doc_id)
    texts = texts_of(frame)
    ids = sorted(texts)
    for r, after in zip(rows, ids[1:] + ids[:1], strict=True):
        text, n = texts[r.doc_id], len(texts[r.doc_id])
        edited = text[: n - n // 4] + texts[after][: n // 4]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.mean([r.near_edited for r in rows]) > 0.4 > 0.1 > np.mean([r.near_next for r in rows])
    out = fingerprints.edited_likeness(odd).collect()
    assert len(out) == len(ODD) and len({r.fingerprint for r in out if r.doc_id in (4, 8)}) == 1
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {""}
    assert fingerprints.edited_likeness(odd.limit(0)).count() == 0


def test_syncmers_do_not_depend_on_context(spark):
    words = [f"t{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", "y", "z", *words, "end"]))]
    found = fingerprints.anchors(docs_of(spark, rows)).collect()
    one = {(r.position, r.hash) for r in found if r.doc_id == 1}
    assert one and one <= {(r.position - 3, r.hash) for r in found if r.doc_id == 2}


# Toxicity


def test_toxicity_learns_from_bags_and_names_sentences(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(300):
        sentences = [[rng.choice(plain) for _ in range(8)] for _ in range(5)]
        if i % 4 == 0:
            sentences[rng.randrange(5)][3] = "vileword"
        texts.append(". ".join(" ".join(s) for s in sentences) + ".")
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts[:200], labels[:200])
    assert all((model.score(t) >= 0.5) == bool(y) for t, y in zip(texts[200:], labels[200:], strict=True))
    bad = texts[200]
    (hit,) = [s for s in model.sentences(bad) if s[2] >= 0.5]
    assert "vileword" in bad[hit[0] : hit[1]]
    assert toxicity.locate(docs_of(spark, [(1, bad), (2, None)]), model).count() == 1
    assert 0 <= model.score("") < 0.5 and toxicity.train([], []).score("x") < 0.01


def test_toxicity_does_not_rise_with_clean_sentences(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["so", "the", "day", "went", "on", "and", "we", "ate"]) for _ in range(9)) + ". "
    texts = ["".join(line() for _ in range(6)) + ("vileword here. " if i % 4 == 0 else "") for i in range(200)]
    labels = [int(i % 4 == 0) for i in range(200)]
    model = toxicity.train(texts, labels)
    block = "".join(line() for _ in range(2500))  # 10^5 characters
    for text in (block, block * 10, block * 100):
        assert model.score(text) < 0.5 and abs(model.score(text) - model.score(block)) < 1e-9
        assert model.score(text + "vileword here.") >= 0.5
    # A word that only one long document of the sample clears.
    docs = docs_of(spark, [(i, t) for i, t in enumerate([*texts, *["vileword quiteharmless. " * 2000] * 3]) if zlib.crc32(str(i).encode()) % 5])
    seen = []
    keep, toxicity.train = toxicity.train, lambda texts, labels: seen.extend(map(len, texts)) or keep(texts, labels)
    try:
        toxicity.fit(docs, spark.createDataFrame([(i, 1, labels[i] if i < 200 else 0) for i in range(203)], "doc_id long, quality int, toxic int"))
        assert max(seen) > 40_000
        seen.clear()
        toxicity.fit(docs, spark.createDataFrame([(i, 1, labels[i] if i < 200 else 0) for i in range(203)], "doc_id long, quality int, toxic int"), sample_bytes=60_000)
        assert max(seen) < 40_000 and sum(seen) <= 60_000 and len(seen) > 100
    finally:
        toxicity.train = keep


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (4, 0, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.classify(odd.limit(0), labels.limit(0)).count() == 0


# Urls


def test_url_parts_and_rules(spark):
    given = ["http://WWW.Example.com/en/x?q#f", "https://a.example.com/en/", "http://example.com/en", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://h?x/y", "no scheme", None, "", "a://", "http://www.example.com/de/", "x://y://z/p"]
    frame = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("score", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[1][2:] == ("example.com/en/", "block")
    assert got[2] == ("example.com", "/en", "com/", "allow") or got[2][2] is None
    assert got[3][2:] == ("net/es/", "block") and got[4][2] == "net/fr/" and got[5][2] is None and got[6][:2] == ("h", "")
    assert got[7][:3] == got[8][:3] == got[9][:3] == ("", "", None) and got[11][2] == "com/" and got[12][:2] == ("y:", "//z/p")
    assert len(got) == len(given) and all(v[3] in ("allow", "block") for v in got.values())
    assert urls.judge(frame.limit(0)).count() == 0


def test_url_models_tell_kinds_apart(spark):
    rng = random.Random(1)
    name = lambda kind: "".join(rng.choice(kind) for _ in range(6))
    rows = [(i, f"http://{name('abc')}.com/{name('abc')}") if i % 2 else (i, f"http://{name('xyz')}.net/es/{name('xyz')}") for i in range(400)]
    rows += [(1000 + i, f"http://{name('abc' if i % 2 else 'xyz')}.org/{name('abc' if i % 2 else 'xyz')}") for i in range(60)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()
    assert sum((r.verdict == "allow") == bool(r.page_id % 2) for r in got) >= 55


def test_url_models_read_the_whole_url(spark):
    rows = [(i, f"http://a.com/p?{'good' * 3}{i}") if i % 2 else (i, f"http://a.net/es/p#{'vile' * 3}{i}") for i in range(200)]
    rows += [(1000, "http://b.org/p?goodgoodgood1"), (1001, "http://b.org/p#vilevilevile1"), (1002, "goodgoodgood"), (1003, "vilevilevile"), (1004, None)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 1000").collect()}
    assert [got[i].verdict for i in range(1000, 1004)] == ["allow", "block"] * 2 and got[1004].score is not None
    assert (got[1000].host, got[1000].path, got[1002].host, got[1002].path) == ("b.org", "/p", "", "")


def test_url_counts_are_exact(spark):
    from collections import Counter
    from math import log

    rng = random.Random(7)
    make = lambda n: ["".join(rng.choice("abé/\x02\x03") for _ in range(rng.randint(0, 12))) for _ in range(n)]
    known, new = [(t, rng.random() < 0.5) for t in make(80)], sorted(set(make(40)))
    START, END = object(), object()
    counts = {True: (Counter(), Counter()), False: (Counter(), Counter())}

    def symbols(text):
        for i in range(len(text) + 1):
            before = (START, *text[:i])
            yield before, (*text, END)[i]

    for text, side in known:
        for before, c in symbols(text):
            for k in range(urls.ORDER + 1):
                context = (k, before[len(before) - k :] if k < len(before) else before)
                counts[side][0][context, c] += 1
                counts[side][1][context] += 1

    def score(text):
        total = 0
        for before, c in symbols(text):
            for side, sign in ((True, 1), (False, -1)):
                p = 1 / 256
                for k in range(urls.ORDER + 1):
                    context = (k, before[len(before) - k :] if k < len(before) else before)
                    p = (counts[side][0][context, c] + urls.WEIGHT * p) / (counts[side][1][context] + urls.WEIGHT)
                total += sign * log(p)
        return total / (len(text) + 1)

    train = spark.createDataFrame(known, "url_text string, accepted boolean")
    texts = spark.createDataFrame([(t, t) for t in new], "key string, url_text string")
    got = {r.key: r.score for r in urls.scored(texts, train).collect()}
    assert got.keys() == set(new) and all(abs(got[t] - score(t)) < 1e-8 for t in new)


# Byte pairs


def test_bpe_equals_the_library(documents, odd):
    library_, own = library("byte_bpe_50k.json"), bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    for frame in (documents.limit(60), odd):
        rows = {(r.doc_id, r.ids_sha256) for r in bpe.round_trip(frame).collect()}
        for r in frame.collect():
            ids = library_.encode(r.text or "", add_special_tokens=False).ids
            assert (r.doc_id, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) in rows
    rng = random.Random(1)
    pool = [*"ab  \n\t\r\x0b\x1c\x85\xa0\u3000'sdt0½é中😀ß\0", "<|endoftext|>", "'ll", " the"]
    for _ in range(400):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 20)))
        ids = library_.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library_.decode(ids, skip_special_tokens=False)
        assert own.digest_all([text])[0][:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert own.decode([own.encode("é")[0] - 0, 10]) == library_.decode([own.encode("é")[0], 10], skip_special_tokens=False)


def test_bpe_frames(odd):
    out = bpe.decode_frame(bpe.encode_frame(odd)).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in out)


def test_packing_looks_each_word_up_once():
    """A lookup for each occurrence was a fifth of the encoding."""

    class Counting(dict):
        looked = 0

        def __contains__(self, key):
            Counting.looked += 1
            return super().__contains__(key)

    own = packing.Words(packing.tokenizer_file("word_bpe_49k.json"))
    texts = [b"the cat and The dog 12 \xc3\xa9t\xc3\xa9 " * 500, b"the cat again", b""]
    want = own.encode_all(texts)
    own.known = Counting(own.known)
    assert own.encode_all(texts) == want and Counting.looked <= 9
    assert want == [packing.ids_bytes(own.tokenizer.encode(t.decode(), add_special_tokens=False).ids) for t in texts]


def test_packing_encodes_odd_words():
    own = packing.Words(packing.tokenizer_file("word_bpe_49k.json"))
    odd = ["", " ", "\t a\x0b\x0c b \r\n", "I'll don't 'S 'reX x'", "<|endoftext|> a<|startoftext|>b <|x", "\u00c9T\u00c9 stra\u00dfe \u00ff\u00d7\u00f7 \u00b5", "e\u0301 \ufb01 \u0130I \u4f60\u597d 12\u0663 \u00a0x\u2003y \U0001f600", "a\x00b ~!@#$%^&*()_+ 3.14abc", "w" * 3000]
    texts = [*odd, " ".join(odd), "\n".join(odd * 3)]
    want = [packing.ids_bytes(own.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.encode_all([t.encode() for t in texts]) == want and [own.encode_all([t.encode()]) for t in texts] == [[w] for w in want]
    assert own.encode_all([]) == [] and own.encode_all([b"", b""]) == [b"", b""]


def test_packing_memory_is_bounded(monkeypatch):
    """A worker held up to a million entries of any length, in the steps after its own too."""
    monkeypatch.setattr(packing, "KNOWN", 1000)
    own = packing.Words(packing.tokenizer_file("word_bpe_49k.json"))
    for at in range(0, 6000, 600):
        texts = [" ".join(f"Word{i}x, w{'o' * (i % 9)}rd{i}" for i in range(at, at + 600)), "y" * 500 + str(at)]
        assert own.encode_all([t.encode() for t in texts]) == [packing.ids_bytes(own.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
        assert len(own.known) <= 1000 and max(map(len, own.known)) <= 64
    own.forget()
    assert not own.known and not own.older


# Licenses


def test_licenses(spark):
    rows = [(1, "some prose here\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "The cat sat on the mat.\nAnother plain line of words"), (4, None), (5, "LICENSED UNDER CC BY-NC 4.0"), (None, "All rights reserved."), (6, LONG)]
    filler = [(100 + i, f"plain words number {i} about nothing much\nand a second line {i * 7} of it") for i in range(40)]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, rows + filler)).collect()}
    assert {k: v.family for k, v in got.items() if v.confirmed} == {1: "mit", 2: "apache-2.0", 5: "cc-by-nc", None: "proprietary"} and got[1].paragraph == 1
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_wrapped_licenses(spark):
    import textwrap

    headers = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    }
    rows, want = [], {}
    for i, (family, text) in enumerate(headers.items()):
        for j, (width, mark) in enumerate([(70, ""), (70, "# "), (40, " * ")]):
            rows.append((10 * i + j, "Some title\n\n" + "\n".join(mark + line for line in textwrap.wrap(text, width)) + "\n\nplain words about nothing much"))
            want[10 * i + j] = (2, family)
    rows.append((90, "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted provided that the following conditions are met"))
    filler = [(100 + i, f"plain words number {i} about nothing much\nand a second line {i * 7} of it") for i in range(40)]
    got = licenses.scan(docs_of(spark, rows + filler)).collect()
    assert {r.doc_id: (r.paragraph, r.family) for r in got if r.confirmed and r.doc_id != 90} == want
    assert len(got) == len({(r.doc_id, r.paragraph) for r in got})
    assert not [r for r in got if r.doc_id < 90 and not r.confirmed and r.paragraph == 3]


def test_license_words_are_cut_once(spark):
    """One regular expression a line in the plan (each reader of the words had a copy of it, some within lambdas)."""
    text = "a.b c3.5 .5x end.\nThe QUICK-fox... v1.0. ünder"
    frame = licenses.featured(licenses.paragraphs(docs_of(spark, [(1, text)])))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert [r.words for r in frame.orderBy("paragraph").collect()] == [["a", "b", "c3.5", ".5x", "end"], ["the", "quick", "fox", "v1.0", "nder"]]


def test_license_screen_loses_nothing(spark, documents):
    from pyspark.sql import functions as F

    docs = documents.select("doc_id", "text").unionByName(docs_of(spark, [(-i, t) for i, t in enumerate(t for n in licenses.NOTICES.values() for t in n)]).select("doc_id", "text"))
    model, names, _ = licenses.fit(docs)
    lines = licenses.featured(licenses.paragraphs(docs)).withColumn("likely", licenses.likely(model))
    found = licenses.guesses(model.transform(licenses.vectors(lines)), names).where("license >= 0.5")
    assert found.count() >= 30 and found.where(~F.col("likely")).count() == 0
    assert lines.where("not likely").count() > lines.where("likely").count()


def test_native_plans(documents):
    import re

    for frame in (fingerprints.edited_likeness(documents.limit(20)), licenses.scan(documents.limit(20))):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# Queries and pipeline


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_statements(spark, name):
    from harness import compare, connect

    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(STATEMENTS[name]).df()) == ""


def test_pipeline_stages(spark, documents):
    import corpus_pipeline as pipeline

    docs = documents.withColumn("_rest", F.lit("clash")).withColumn("toxicity", F.lit(1))
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() > 0
    texts = texts_of(docs)
    assert all(root == d for d, (_, root) in brute_components(texts_of(pipeline.STAGES[1][1](spark, documents, SF)), 5, 80).items())
    assert all(n <= 101 for _, n, _, _ in brute_removed(texts).values())  # cuts may bring strings together anew
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == len(texts)


def test_nothing_else_imports_the_package():
    import pathlib

    root = pathlib.Path(bpe.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]


def test_neardup_pair_is_met_in_one_of_its_lists(spark):
    rows = [(0, [1, 2, 3, 4], [1, 2, 3]), (1, [1, 2, 9, 4], [0, 1, 3]), (2, [7, 2, 9, 4], [1, 2, 3]), (3, [7, 7, 7, 7], [0])]
    nodes = spark.createDataFrame(rows, "node long, sig array<int>, lists array<int>")
    post = nodes.select("*", F.explode("lists").alias("coordinate")).withColumn("value", F.expr("sig[coordinate]"))
    x, y = (post.select("coordinate", "value", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "sig", "lists"))) for s in "xy")
    pairs = x.join(y, ["coordinate", "value"]).where("node_x < node_y").where(neardup.meets_first(F.col("coordinate"), "x", "y"))
    assert sorted((r.node_x, r.node_y) for r in pairs.collect()) == [(0, 1), (0, 2), (1, 2)]


def test_neardup_words_do_not_stay_in_the_worker(monkeypatch):
    """Half a million words of any length stayed with a worker through all later stages of the pipeline."""
    assert not [x for x in vars(neardup).values() if isinstance(x, neardup.WordHashes)]
    monkeypatch.setattr(neardup, "KNOWN", 100)
    text, hashes = " ".join([f"word{i}" for i in range(250)] + ["x" * 1000, "y" * 64]).encode(), neardup.WordHashes()
    found = neardup.shingles(text, 4, hashes)
    assert 0 < len(hashes) <= 100 and max(map(len, hashes)) <= 64 and b"y" * 64 in hashes
    monkeypatch.setattr(neardup, "KNOWN", 10_000)
    assert np.array_equal(found, neardup.shingles(text, 4, neardup.WordHashes())) and len(found) == 249
