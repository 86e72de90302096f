"""Shortest entries containing a text: length-sliced reading against the plain pairing, and a bounded read for '1'."""

import random

from pyspark.sql import functions as F

from civicspark.operators import substring as sb


def brute(spark, patterns, entries, k):
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    e = spark.createDataFrame([(x,) for x in entries], "entry string")
    pairs = p.crossJoin(e).where(sb._MATCH).withColumn("len", F.length("entry")).collect()
    out = set()
    for pat in set(patterns) - {None}:
        mine = sorted((r.len, r.entry) for r in pairs if r.pattern == pat)
        if mine:
            cut = mine[min(k, len(mine)) - 1][0]
            out |= {(pat, e) for l, e in mine if l <= cut}
    return out


def test_shortest_containing_equals_plain_pairing(spark):
    rnd = random.Random(3)
    entries = sorted({f"{rnd.randint(1, 400)} {rnd.choice(['MAIN', 'BROADWAY', 'ELM', 'OAK'])} {'ST' if rnd.random() < .5 else 'AVENUE ' * rnd.randint(1, 9)}".strip() for _ in range(600)})
    entries += ["", "1", "X" * 300]
    patterns = ["1", "MAIN", "1 M", "%", "_1", "ZZZ", "AVENUE AVENUE AVENUE", "", None, "X" * 40, "4%ELM"]
    for k in (1, 3):
        p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
        e = spark.createDataFrame([(x,) for x in entries], "entry string")
        got = {tuple(r) for r in sb.shortest_containing(p, e, k).collect()}
        assert got == brute(spark, patterns, entries, k)


def test_short_text_meets_short_entries_only(spark):
    entries = [str(i) + " MAIN STREET" + " X" * (i % 50) for i in range(3000)]
    p = spark.createDataFrame([("1",)], "pattern string")
    e = spark.createDataFrame([(x,) for x in entries], "entry string")
    got = sb.shortest_containing(p, e, 1).collect()
    holding = [x for x in entries if "1" in x]
    shortest = min(len(x) for x in holding)
    assert {r.entry for r in got} == {x for x in holding if len(x) == shortest}
    assert len(got) < 10 < 1000 < len(holding)
