"""Validation of triage results and latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import AGENCIES
from ..operators import quantiles as q
from ..operators.joins import join_same

# Limits of the result checks.
MIN_SUMMARY, MIN_CONFIDENCE, MAX_MS = 20, 0.5, 5000


def validate(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """(scenario_id, status, issues...) for responses joined with what was expected.

    ``responses``: scenario_id, severity, agency, summary, confidence, similar_count, total_ms. ``expected``:
    scenario_id, expected_severity, expected_agency. Issues are an array in a fixed order; none means PASS.
    """
    rows = responses.join(expected, "scenario_id")
    agencies = ", ".join(f"'{a}'" for a in AGENCIES)
    show = "coalesce(CAST({0} AS STRING), 'None')".format
    checks = [
        f"CASE WHEN severity IS NULL OR severity < 1 OR severity > 5 THEN concat('Invalid severity: ', {show('severity')}) END",
        f"CASE WHEN agency IS NULL OR agency NOT IN ({agencies}) THEN concat('Invalid agency: ', {show('agency')}) END",
        f"CASE WHEN expected_agency != '' AND NOT (agency <=> expected_agency) THEN concat('Agency mismatch: got ', {show('agency')}, ', expected ', expected_agency) END",
        "CASE WHEN expected_severity != 0 AND abs(severity - expected_severity) > 1 THEN concat('Severity off by >1: got ', "
        "CAST(severity AS STRING), ', expected ', CAST(expected_severity AS STRING)) END",
        f"CASE WHEN coalesce(length(summary), 0) < {MIN_SUMMARY} THEN concat('Summary too short (', CAST(coalesce(length(summary), 0) AS STRING), ' chars)') END",
        f"CASE WHEN coalesce(confidence, 0D) < {MIN_CONFIDENCE}D THEN concat('Low confidence: ', CAST(coalesce(confidence, 0D) AS STRING)) END",
        "CASE WHEN coalesce(similar_count, 0) = 0 THEN 'No similar incidents returned' END",
        f"CASE WHEN total_ms > {MAX_MS} THEN concat('Latency too high: ', CAST(total_ms AS STRING), 'ms') END",
    ]
    out = rows.withColumn("issues", F.expr(f"filter(array({', '.join(checks)}), x -> x IS NOT NULL)"))
    return out.withColumn("status", F.expr("CASE WHEN size(issues) = 0 THEN 'PASS' ELSE 'WARN' END"))


def check_results(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid and rejected by the result contract: severity 1 to 5, confidence 0 to 1."""
    ok = "coalesce(severity BETWEEN 1 AND 5 AND confidence BETWEEN 0 AND 1 AND category IS NOT NULL AND agency IS NOT NULL AND summary IS NOT NULL, false)"
    return results.where(ok), results.where(f"NOT {ok}")


def latency_summary(samples: DataFrame, groups: list[str], value: str = "latency_ms", ok: str | None = None) -> DataFrame:
    """Count, success rate, min, p50, p95, p99, max, mean and sample deviation per group, to one decimal.

    A percentile is the value at rank int(n * p), at most n - 1, in ascending order.
    """
    good = f"CAST({ok} AS INT)" if ok else "1"
    plain = samples.groupBy(*groups).agg(
        F.expr("count(1) AS total_queries"), F.expr(f"sum({good}) AS successes"), F.expr(f"min({value}) AS lowest"),
        F.expr(f"max({value}) AS highest"), F.expr(f"avg({value}) AS middle"), F.expr(f"stddev_samp({value}) AS spread"),
    )
    ranks = {"p50": q.rank_at(0.50), "p95": q.rank_at(0.95), "p99": q.rank_at(0.99)}
    picks = q.values_at(samples, groups, value, ranks).groupBy(*groups).agg(
        *[F.expr(f"max(CASE WHEN pick = '{p}' THEN v END) AS {p}") for p in ranks]
    )
    both = join_same(plain, picks, groups) if groups else plain.withColumn("_g", F.expr("1")).join(picks.withColumn("_g", F.expr("1")), "_g")
    return both.selectExpr(
        *groups, "total_queries", "successes", "total_queries - successes AS failures",
        "round(successes / total_queries * 100, 1) AS success_rate", "round(lowest, 1) AS min_ms",
        *[f"round({p}, 1) AS {p}_ms" for p in ranks], "round(highest, 1) AS max_ms", "round(middle, 1) AS mean_ms",
        "round(coalesce(spread, 0D), 1) AS stdev_ms",
    )


def throughput(samples: DataFrame, groups: list[str], summary: str = "summary", value: str = "latency_ms") -> DataFrame:
    """Estimated tokens per second: a quarter of the summary's characters over the summed latency."""
    return samples.groupBy(*groups).agg(
        F.expr(f"CASE WHEN sum({value}) > 0 THEN round(sum(floor(length({summary}) / 4)) / (sum({value}) / 1000D), 1) ELSE 0D END AS tokens_per_sec")
    )
