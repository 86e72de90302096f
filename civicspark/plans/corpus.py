"""Incident corpus: one schema for three sources, document texts, ids, embeddings and structured search."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quantiles as q
from ..operators import vectors
from ..operators.joins import join_same
from ..operators.ranking import first_per_key
from ..operators.staging import together

NO_FILTER = ("ALL", "UNKNOWN", "")


def incidents(requests: DataFrame, fire: DataFrame, nypd: DataFrame, since: str | None = None) -> DataFrame:
    """(id, complaint_type, descriptor, borough, agency, created_date, resolution_days, source).

    Whole sources; rows without a date or before ``since`` are left out only if that date is given.
    """
    parts = {
        "SR311": (requests, "created_date", "unique_key", "complaint_type", "descriptor", "borough", "agency",
                  "datediff(closed_date, created_date)"),
        "FIRE": (fire, "incident_datetime", "incident_id", "incident_type_desc", "incident_classification",
                 "incident_borough", "'FDNY'", "-1"),
        "NYPD": (nypd, "complaint_date", "complaint_number", "offense_description", "law_category", "borough", "'NYPD'", "-1"),
    }
    out = None
    for source, (df, date, key, kind, detail, borough, agency, days) in parts.items():
        rows = df if since is None else df.where(F.col(date) >= F.lit(since).cast("date"))
        rows = rows.selectExpr(
            f"CAST({key} AS STRING) AS id", f"{kind} AS complaint_type", f"{detail} AS descriptor", f"{borough} AS borough",
            f"{agency} AS agency", f"CAST({date} AS STRING) AS created_date", f"CAST({days} AS INT) AS resolution_days",
            f"'{source}' AS source",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def document_text() -> str:
    """'type in borough \u2014 detail \u2014 resolved in x days'; missing parts are skipped, a missing type is Unknown."""
    place = "CASE WHEN borough NOT IN ('', 'UNKNOWN', 'None', 'nan') THEN concat(' in ', borough) ELSE '' END"
    detail = "CASE WHEN descriptor NOT IN ('', 'None', 'nan') THEN substring(descriptor, 1, 200) END"
    days = "CASE WHEN resolution_days > 0 THEN concat('resolved in ', format_string('%.1f', CAST(resolution_days AS DOUBLE)), ' days') END"
    return f"concat_ws(' \u2014 ', concat(coalesce(complaint_type, 'Unknown'), coalesce({place}, '')), {detail}, {days})"


def documents(rows: DataFrame) -> DataFrame:
    """Corpus documents with a stable id; repeated (source, id) pairs are kept once."""
    docs = rows.selectExpr(
        "substring(md5(CAST(concat_ws('_', source, id) AS BINARY)), 1, 16) AS doc_id", f"{document_text()} AS document",
        "source", "coalesce(borough, 'None') AS borough", "coalesce(agency, 'None') AS agency",
        "coalesce(complaint_type, 'None') AS complaint_type",
        "CAST(coalesce(resolution_days, -1) AS DOUBLE) AS resolution_days", "coalesce(created_date, 'None') AS date",
    )
    rest = ["document", "agency", "complaint_type", "resolution_days", "date", "borough"]
    return first_per_key(docs, ["doc_id"], rest).drop("rn")


def bag_of_words(dimensions: int = 64):
    """Deterministic encoder: signed hashed word counts, scaled to unit length."""

    def encode(texts: pd.Series) -> list:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(word.encode())
                out[row, h % dimensions] += 1.0 if h & 0x10000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return list(np.divide(out, norms, out=out, where=norms > 0))

    return encode


def retrieve_similar(queries: DataFrame, corpus: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, rn, doc_id, similarity, metadata...) by exact cosine.

    ``queries`` has (query_id, embedding, borough): a borough other than ALL, UNKNOWN or '' restricts the search to
    documents of that borough.
    """
    free = "borough IS NULL OR upper(borough) IN (" + ", ".join(f"'{x}'" for x in NO_FILTER) + ")"
    body = corpus.selectExpr("doc_id AS corpus_id", "embedding AS vector", "borough")
    id_type = corpus.schema["doc_id"].dataType.simpleString()
    ask = queries.selectExpr("query_id", "embedding AS vector", "upper(borough) AS borough")
    inside, anywhere = together(
        lambda: vectors.cosine_top_n(ask.where(f"NOT ({free})"), body, n, "borough", id_type),
        lambda: vectors.cosine_top_n(ask.where(free).drop("borough"), body.drop("borough"), n, None, id_type),
    )
    hits = inside.unionByName(anywhere)
    meta = corpus.drop("embedding", "document")
    return hits.join(meta, hits["corpus_id"] == meta["doc_id"]).selectExpr(
        "query_id", "rn", "doc_id", "round(cosine, 3) AS similarity", *[c for c in meta.columns if c != "doc_id"]
    )


def _matching(rows: DataFrame, borough: str | None, complaint_type: str | None) -> DataFrame:
    if borough and borough.upper() not in NO_FILTER:
        rows = rows.where(F.col("borough") == borough.upper())
    if complaint_type:
        rows = rows.where(F.col("complaint_type").ilike(f"%{complaint_type}%"))
    return rows


def structured_search(rows: DataFrame, borough: str | None = None, complaint_type: str | None = None, limit: int = 5) -> DataFrame:
    """Newest matching incidents; filters apply only if given."""
    return _matching(rows, borough, complaint_type).orderBy(F.col("created_date").desc(), "source", "id").limit(limit)


def resolution_stats(rows: DataFrame, groups: list[str] | None = None, borough: str | None = None, complaint_type: str | None = None) -> DataFrame:
    """Matches, and average, median, shortest and longest positive resolution in days (two decimals)."""
    groups = groups or []
    found = _matching(rows, borough, complaint_type)
    positive = "CASE WHEN resolution_days > 0 THEN resolution_days END"
    plain = found.groupBy(*groups).agg(
        F.expr("count(1) AS total_similar"), F.expr(f"round(avg({positive}), 2) AS avg_resolution_days"),
        F.expr(f"round(CAST(min({positive}) AS DOUBLE), 2) AS min_resolution_days"),
        F.expr(f"round(CAST(max({positive}) AS DOUBLE), 2) AS max_resolution_days"),
    )
    keyed, keys = (found, groups) if groups else (found.withColumn("_g", F.lit(0)), ["_g"])
    middle = q.median(keyed.where("resolution_days > 0"), keys, "resolution_days")
    middle = middle.selectExpr(*keys, "round(median, 2) AS median_resolution_days")
    if not groups:
        return plain.withColumn("_g", F.lit(0)).join(middle, "_g", "left").drop("_g")
    return join_same(plain, middle, groups, "left")
