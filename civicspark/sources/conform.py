"""Conform jobs: messy files in, fixed typed tables out. Every job is one projection with one filter."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import scalars as s
from ..operators.ranking import latest_per_key, with_row_id
from .files import filtered, find_file, headers, is_present, pick, read_table
from .specs import SPECS, Spec

Raw = dict[str, Column]


def _cast(c: Column, kind: str, lenient: bool) -> Column:
    if kind == "int":
        return s.to_int(c)
    if kind == "double":
        return s.to_double(c)
    if kind == "date":
        return s.to_date(c, lenient)
    if kind == "moment":
        return s.to_moment(c, lenient)
    return c.cast("string")


def typed(df: DataFrame, spec: Spec, lenient_dates: bool = False) -> tuple[Raw, Raw]:
    """Raw and typed expression per target column, from the headers the file really has."""
    available = headers(df)
    missing = [f.name for f in spec.fields if f.name in spec.required and not is_present(available, *f.aliases)]
    if missing:
        raise ValueError(f"{spec.name}: required column not found: {', '.join(missing)}")
    raw = {f.name: pick(available, *f.aliases) for f in spec.fields}
    return raw, {f.name: _cast(raw[f.name], f.type, lenient_dates).alias(f.name) for f in spec.fields}


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _buildings(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["bin"] = F.when(~s.missing_key(raw["bin"]), raw["bin"].cast("string"))
    out["construction_type"] = _null()
    out["risk_score"] = F.lit(0.0)
    out["last_updated"] = F.current_timestamp()
    return out, ~s.missing_key(raw["bbl"])


def _dob(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["severity"] = codes.dob_severity(raw["violation_type"].cast("string"))
    out["is_active"] = raw["disposition_date"].isNull()  # the raw text, not the parsed date
    return out, raw["bin"].isNotNull()


def _safety(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["status"] = F.coalesce(out["status"], F.lit("OPEN"))
    return out, raw["bin"].isNotNull()


def _ecb(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["severity"] = codes.ecb_severity(out["penalty_imposed"])
    out["is_active"] = F.coalesce(out["balance_due"] > 0, F.lit(False))
    return out, raw["bin"].isNotNull()


def _has_bin(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    return out, raw["bin"].isNotNull()


def _fire(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["bin"] = _null()
    return out, raw["incident_id"].isNotNull() & (F.trim(raw["incident_id"].cast("string")) != "")


def _company(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["fire_origin_below_grade"] = F.coalesce(raw["below_grade"] == "Y", F.lit(False))
    del out["below_grade"]
    return out, F.lit(True)


def _everything(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    return out, F.lit(True)


def _requests(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["bin"] = _null()
    return out, F.lit(True)


def _nypd(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    return out, raw["complaint_number"].isNotNull()


def _inspections(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["is_compliant"] = is_compliant(raw["result"])
    return out, ~s.missing_key(raw["bin"])


def is_compliant(result: Column) -> Column:
    return F.coalesce(F.upper(F.trim(result.cast("string"))) == "APPROVAL", F.lit(False))


def _elevators(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["device_status"] = F.coalesce(out["device_status"], F.lit("UNKNOWN"))
    out["status"] = out["device_status"]
    return out, raw["bin"].isNotNull()


def _hydrants(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    return out, raw["latitude"].isNotNull() & raw["longitude"].isNotNull()


def _facilities(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    joined = F.trim(F.concat(F.coalesce(out["addressnum"], F.lit("")), F.lit(" "), F.coalesce(out["streetname"], F.lit(""))))
    out["address"] = F.coalesce(out["address"], joined)
    return out, s.present(out["latitude"])


def _hospitals(raw: Raw, out: Raw) -> tuple[Raw, Column]:
    out["facility_type"] = F.coalesce(out.pop("factype"), out.pop("facsubgrp"))
    out["phone"] = _null()
    return out, s.present(out["latitude"]) & s.present(out["longitude"])


RULES: dict[str, Callable[[Raw, Raw], tuple[Raw, Column]]] = {
    "pluto": _buildings,
    "dob_violations": _dob,
    "dob_safety_violations": _safety,
    "dob_ecb_violations": _ecb,
    "hpd_violations": _has_bin,
    "hpd_complaints": _has_bin,
    "fire_incidents": _fire,
    "fire_company_incidents": _company,
    "ems_incidents": _everything,
    "311_requests": _requests,
    "nypd_complaints": _nypd,
    "fire_prevention_inspections": _inspections,
    "elevators": _elevators,
    "fire_hydrants": _hydrants,
    "facilities": _facilities,
    "hospitals": _hospitals,
}
ROW_ID = {
    "dob_violations", "dob_safety_violations", "fire_company_incidents", "fire_prevention_inspections", "elevators",
    "fire_hydrants",
}


def conform(df: DataFrame, name: str, lenient_dates: bool = False) -> DataFrame:
    """Typed table of one data set, from a frame with whatever headers the file has."""
    spec = SPECS[name]
    raw, out = typed(df, spec, lenient_dates)
    out, keep = RULES[name](raw, out)
    table = df.where(keep).select(*[c.alias(n) for n, c in out.items()])
    if name == "fire_incidents":
        table = latest_per_key(table, ["incident_id"], "incident_datetime", *[c for c in table.columns if c not in ("incident_id", "incident_datetime")])
    return with_row_id(table) if name in ROW_ID else table


def load(spark: SparkSession, name: str, dirs: list[str], lenient_dates: bool = False, multi_line: bool = False) -> DataFrame | None:
    """Find, scan and conform one data set; None when no candidate file exists."""
    path = find_file(spark, dirs, list(SPECS[name].files))
    return None if path is None else conform(read_table(spark, path, multi_line), name, lenient_dates)


def fetch_filter(df: DataFrame, name: str) -> DataFrame:
    """The row filter that the published source is asked for."""
    spec = SPECS[name]
    if spec.source_filter is None:
        return df
    column, values = spec.source_filter
    return filtered(df, column, list(values))


def hospitals_from_facilities(facilities: DataFrame) -> DataFrame:
    group = F.upper(F.coalesce("facsubgrp", F.lit("")))
    kind = F.upper(F.coalesce("factype", F.lit("")))
    medical = group.contains("HOSPITAL") | kind.contains("HOSPITAL") | group.contains("HEALTH")
    return facilities.where(medical & s.present(F.col("latitude")) & s.present(F.col("longitude"))).select(
        F.col("facname").alias("facility_name"), F.coalesce("factype", "facsubgrp").alias("facility_type"), "borough",
        "address", F.lit(None).cast("string").alias("phone"), "latitude", "longitude",
    )


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """Schema evolution: add the missing columns of ``schema`` as NULL, keep all others."""
    have = headers(df)
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name.lower() not in have})
