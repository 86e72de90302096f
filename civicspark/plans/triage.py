"""Batch triage: resolve, history, context, rules and nearest resources for a table of incident reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, rules
from ..operators.ranking import first_per_key
from ..operators.staging import written
from . import history as h
from . import resolve as rs

DETAILS_SHOWN = 3
TEXT_LIMIT = 2000
BUILDING_COLUMNS = ["bbl", "bin", "address", "borough", "year_built", "num_floors", "owner_name", "risk_score", "latitude", "longitude"]


def _source_rank() -> str:
    return "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in h.SOURCE_RANK.items()) + " END"


def contexts(requests: DataFrame, resolved: DataFrame, entries: DataFrame) -> DataFrame:
    """(request_id, context): building line, score line, count lines and the first three entries, one per line."""
    counts = h.source_counts(entries)
    detail = f"concat('  - [', source, '] ', {prompts.shown('type')}, ' ', {prompts.shown('detail')}, ' (', {prompts.shown('date')}, ')')"
    first = first_per_key(entries, ["request_id"], [_source_rank(), "rn"], DETAILS_SHOWN, "pos")
    top = first.selectExpr("request_id", f"struct(pos, {detail} AS line) AS d").groupBy("request_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(d)), x -> x.line), '\\n') AS details")  # three at most
    )
    rows = requests.select("request_id").join(resolved, "request_id", "left").join(counts, "request_id", "left").join(top, "request_id", "left")
    score = "CASE WHEN risk_score > 0 THEN concat('Precomputed risk score: ', CAST(risk_score AS STRING)) END"
    building = f"CASE WHEN stage IS NOT NULL THEN {prompts.building_line()} END"
    lines = ", ".join([building, score, *[prompts.count_line(c, w) for c, w in prompts.COUNT_LINES.items()], "details"])
    return rows.selectExpr("request_id", f"concat_ws('\\n', {lines}) AS context")


def batch_triage(
    requests: DataFrame, buildings: DataFrame, tables: h.Tables, hospitals: DataFrame | None = None,
    hydrants: DataFrame | None = None, facilities: DataFrame | None = None, use_keys: bool = False,
) -> dict[str, DataFrame]:
    """``result`` (one row per request), ``history`` and ``nearby`` (long form).

    As in the request form of the service, lot and building numbers of a request are not used unless ``use_keys``.
    """
    asked = requests if use_keys else requests.withColumns({
        "bbl": F.lit(None).cast("string"), "bin": F.lit(None).cast("string"),
    })
    resolved = written(rs.resolve(asked, buildings, BUILDING_COLUMNS), "resolved")
    located = written(h.locate(requests, resolved), "located")
    entries = written(h.history(located, tables), "history")
    answer = requests.select("request_id", "text", rules.triage("text").alias("r")).select("request_id", "text", "r.*")
    result = (
        answer.join(contexts(requests, resolved, entries), "request_id", "left")
        .join(resolved.select("request_id", "bbl", "bin", "stage"), "request_id", "left")
        .withColumn("prompt", prompts.prompt("context", "CAST(NULL AS STRING)", "text"))
    )
    out = {"result": result, "history": entries}
    if hospitals is not None or hydrants is not None or facilities is not None:
        out["nearby"] = h.nearby(located, hospitals, hydrants, facilities)
    return out


def check_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid and rejected by the request contract: text of 1 to 2000 characters, image text bounded."""
    ok = f"length(text) BETWEEN 1 AND {TEXT_LIMIT}"
    if "image_b64" in requests.columns:
        ok += " AND coalesce(length(image_b64), 0) <= 10000000"
    verdict = f"coalesce({ok}, false)"
    return requests.where(verdict), requests.where(f"NOT {verdict}")
