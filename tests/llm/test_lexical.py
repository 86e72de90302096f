"""Ranked lexical search: NRA against the full scoring in DuckDB, on the table and on odd input."""

import duckdb
import pytest

from civicspark.llm import lexical

SF = "/root/testdata/sf0.001"


def oracle(docs, bench):
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("benchmark", bench)
    return sorted(tuple(r) for r in con.execute(lexical.SQL).fetchall())


def got(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_search_matches_full_scoring(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = oracle(docs.toPandas(), bench.toPandas())
    assert want and got(lexical.search(docs, bench)) == want


ROWS = [
    (1, "Apple apple banana"), (2, "apple"), (3, None), (4, ""), (5, "banana banana CHERRY"), (5, "apple"),
    (None, "apple cherry"), (6, "ÄPPLE apple-pie 42 x" * 3000), (7, "apple"), (8, "apple"), (9, "zzz"),
] + [(100 + i, "apple banana filler") for i in range(150)]
ITEMS = [(1, "apple"), (2, "banana cherry apple apple"), (3, None), (4, "nothing here"), (5, "ÄPPLE 42"), (6, "apple apple")]


def test_search_odd_input(spark):
    import pandas as pd

    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("item", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = oracle(pd.DataFrame(ROWS, columns=["doc_id", "text"]), pd.DataFrame(ITEMS, columns=["item_id", "text"]))
    res = got(lexical.search(docs, bench))
    assert res == want
    assert {r[0] for r in res} == {1, 2, 5, 6}
    assert lexical.search(docs.where("false"), bench).count() == 0


def test_search_with_shallow_rounds_and_pruning(spark, monkeypatch):
    """Depths of 2, 4, 8, ...: queries close early and read only their candidates for many rounds."""
    monkeypatch.setattr(lexical, "FIRST_DEPTH", 2)
    monkeypatch.setattr(lexical, "GROWTH", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = oracle(docs.toPandas(), bench.toPandas())
    assert got(lexical.search(docs, bench)) == want


def test_texts_are_cut_into_terms_once_and_terms_travel_as_numbers(spark):
    """The terms of a text are those of the pattern; behind the scan a term is a number, not a string."""
    from pyspark.sql import functions as F

    texts = [(1, "A-b_c9 ÄÖ\u00a0x\u2028y\x00z\x1fÀ\x7fq 日本 aB ab"), (2, None), (3, " ,;"), (1, "AB")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.term): r.c for r in lexical.document_terms(docs).groupBy("doc_id", "term").agg(F.sum("c").alias("c")).collect()}
    words = docs.select("doc_id", F.explode(lexical.terms(F.col("text"))).alias("term"))
    want = {(r.doc_id, r.term): r["count"] for r in words.groupBy("doc_id", "term").count().collect()}
    assert got == want | {(1, ""): sum(v for (d, _), v in want.items() if d == 1), (2, ""): 0, (3, ""): 0}
    asked = spark.createDataFrame([("ab", 0), ("y", 1)], "word string, term long")
    postings, _ = lexical.index(docs, asked, 2)
    assert dict(postings.dtypes)["term"] == "bigint" and postings.count() == 1
