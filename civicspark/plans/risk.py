"""Building risk score: fifteen stored components, eleven of them weighted."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.scalars import FEET, MILES
from ..operators import spatial as sp
from ..operators.joins import left_spread, merge_measures
from ..operators.staging import together, written
from .portfolio import open_status

# Weight of each counted component, and the two flat additions.
WEIGHTS = {
    "active_hpd_class_c": 6.0,
    "prior_fire_incidents": 4.0,
    "active_ecb_violations": 3.0,
    "active_dob_violations": 2.5,
    "active_hpd_class_b": 2.0,
    "complaint_velocity_30d": 2.0,
    "prior_ems_incidents": 1.5,
    "nearby_nypd_incidents": 0.75,
    "complaint_velocity_90d": 1.0,
}
FAILED_INSPECTION = 15.0
ELEVATOR_OUT = 5.0
# Half widths of the distance joins, in degrees.
FIRE_BOX = sp.Box(0.0005)
EMS_BOX = sp.Box(0.0005)
NYPD_BOX = sp.Box(0.0010)
HYDRANT_BOX = sp.Box(0.005)

STORED = [
    "active_dob_violations", "active_ecb_violations", "active_hpd_class_c", "active_hpd_class_b", "prior_fire_incidents",
    "prior_ems_incidents", "nearby_nypd_incidents", "complaint_velocity_30d", "complaint_velocity_90d",
    "last_fdny_inspection_pass", "elevator_count", "elevator_out_of_service", "nearest_hydrant_ft", "nearest_hospital",
    "nearest_hospital_mi",
]


@dataclass
class Facts:
    """Conformed tables that the score draws on."""

    buildings: DataFrame
    dob: DataFrame
    ecb: DataFrame
    hpd: DataFrame
    fire: DataFrame
    ems: DataFrame
    nypd: DataFrame
    requests: DataFrame
    inspections: DataFrame
    elevators: DataFrame
    hydrants: DataFrame
    hospitals: DataFrame


def violations_by_bin(dob: DataFrame, ecb: DataFrame, hpd: DataFrame) -> list[DataFrame]:
    """Rows to be summed per bin; NULL where the row does not count, so that a bin without any stays NULL."""
    opened = open_status(F.col("current_status"))
    one = F.lit(1)
    return [
        dob.where("is_active").select("bin", one.alias("active_dob_violations")),
        ecb.where("is_active").select("bin", one.alias("active_ecb_violations")),
        hpd.where(F.col("violation_class").isin("B", "C") & opened).select(
            "bin",
            F.when(F.col("violation_class") == "C", 1).alias("active_hpd_class_c"),
            F.when(F.col("violation_class") == "B", 1).alias("active_hpd_class_b"),
        ),
    ]


VIOLATION_SUMS = dict.fromkeys(
    ["active_dob_violations", "active_ecb_violations", "active_hpd_class_c", "active_hpd_class_b"], "sum"
)


def equipment_by_bin(inspections: DataFrame, elevators: DataFrame) -> list[DataFrame]:
    return [
        inspections.select("bin", F.col("is_compliant").alias("last_fdny_inspection_pass")),
        elevators.select(
            "bin", F.lit(1).alias("elevator_count"),
            F.when(F.col("status") != "ACTIVE", 1).otherwise(0).alias("elevator_out_of_service"),
        ),
    ]


EQUIPMENT_SUMS = {"last_fdny_inspection_pass": "bool_or", "elevator_count": "sum", "elevator_out_of_service": "sum"}


def fires_by_bin(buildings: DataFrame, fire: DataFrame) -> DataFrame:
    """Building rows times fires: by bin where the fire has one, by distance where it has none.

    The two conditions exclude each other, so the OR join is a sum of two counts. The bin branch multiplies row
    counts instead of joining rows.
    """
    placed = buildings.where(F.col("bin").isNotNull()).select("bin", F.col("latitude").alias("qlat"), F.col("longitude").alias("qlon"))
    loose = fire.where(F.col("bin").isNull())
    near = sp.count_within(sp.distinct_spots(placed, "qlat", "qlon"), loose, FIRE_BOX).withColumnRenamed("n", "near_n")
    counted = merge_measures(
        [
            placed.select("bin", F.lit(1).alias("lots")),
            fire.where(F.col("bin").isNotNull()).select("bin", F.lit(1).alias("fires")),
            placed.join(near, ["qlat", "qlon"]).select("bin", "near_n"),
        ],
        ["bin"], {"lots": "sum", "fires": "sum", "near_n": "sum"},
    )
    total = F.coalesce(F.col("lots") * F.col("fires"), F.lit(0)) + F.coalesce("near_n", F.lit(0))
    return counted.select("bin", total.alias("prior_fire_incidents")).where("prior_fire_incidents > 0")


def complaints_by_address(requests: DataFrame, as_of: str) -> DataFrame:
    """311 rows of the last 30 and 90 days per lower-cased address. There is no upper bound on the date."""
    since = {n: F.date_sub(F.lit(as_of).cast("date"), n).cast("timestamp_ntz") for n in (30, 90)}
    recent = requests.where((F.col("created_date") >= since[90]) & F.col("incident_address").isNotNull())
    return recent.groupBy(F.lower("incident_address").alias("addr")).agg(
        F.count_if(F.col("created_date") >= since[30]).alias("n30"), F.count(F.lit(1)).alias("n90")
    )


def velocity_by_bbl(buildings: DataFrame, requests: DataFrame, as_of: str) -> DataFrame:
    per_address = complaints_by_address(requests, as_of)
    lots = buildings.where(F.col("address").isNotNull()).select("bbl", F.lower("address").alias("addr"))
    sums = lots.join(per_address, "addr").groupBy("bbl").agg(F.sum("n30").alias("n30"), F.sum("n90").alias("n90"))
    return sums.select(
        "bbl", F.nullif(F.col("n30"), F.lit(0)).alias("complaint_velocity_30d"), F.col("n90").alias("complaint_velocity_90d")
    )


def nearest_hydrants(spots: DataFrame, hydrants: DataFrame) -> DataFrame:
    sites = hydrants.select("latitude", "longitude", F.lit(0).alias("_o"))
    near = sp.nearest_within(spots, sites, HYDRANT_BOX, 1, ["_o"], ["_o"], FEET)
    return near.select("qlat", "qlon", F.col("dist").alias("nearest_hydrant_ft"))


def nearest_hospitals(spots: DataFrame, hospitals: DataFrame) -> list[DataFrame]:
    """Nearest named hospital, and nearest distance to any; an unnamed one counts for the distance only."""
    named = hospitals.where(F.col("facility_name").isNotNull())
    unnamed = hospitals.where(F.col("facility_name").isNull())
    best, bare = together(
        lambda: sp.nearest_anywhere(spots, named, 1, ["facility_name"], ["facility_name"], MILES),
        lambda: sp.nearest_anywhere(spots, unnamed, 1, ["facility_name"], ["facility_name"], MILES),
    )
    pick = F.struct(F.col("dist").alias("d"), F.col("facility_name").alias("name"))
    return [
        best.select("qlat", "qlon", pick.alias("hospital"), F.col("dist").alias("nearest_hospital_mi")),
        bare.select("qlat", "qlon", F.col("dist").alias("nearest_hospital_mi")),
    ]


def near_by_spot(f: Facts, spots: DataFrame) -> DataFrame:
    """All distance components per distinct building spot, folded into one frame."""
    ems, nypd, hydrants, hospitals = together(
        lambda: sp.count_within(spots, f.ems, EMS_BOX).withColumnRenamed("n", "prior_ems_incidents"),
        lambda: sp.count_within(spots, f.nypd, NYPD_BOX).withColumnRenamed("n", "nearby_nypd_incidents"),
        lambda: nearest_hydrants(spots, f.hydrants),
        lambda: nearest_hospitals(spots, f.hospitals),
    )
    return merge_measures(
        [ems, nypd, hydrants, *hospitals],
        ["qlat", "qlon"],
        {
            "prior_ems_incidents": "sum", "nearby_nypd_incidents": "sum", "nearest_hydrant_ft": "min",
            "hospital": "min", "nearest_hospital_mi": "min",
        },
    )


def near_by_bbl(buildings: DataFrame, by_spot: DataFrame, how: dict[str, str]) -> DataFrame:
    """Spread per-spot measures over the buildings standing there and fold them per lot."""
    lots = buildings.select("bbl", F.col("latitude").alias("qlat"), F.col("longitude").alias("qlon"))
    placed = lots.where(F.col("qlat").isNotNull() & F.col("qlon").isNotNull())
    return merge_measures([placed.join(by_spot, ["qlat", "qlon"]).drop("qlat", "qlon")], ["bbl"], how)


def composite() -> Column:
    counted = [F.coalesce(c, F.lit(0)) * F.lit(w) for c, w in WEIGHTS.items()]
    flat = [
        F.when(F.col("last_fdny_inspection_pass") == F.lit(False), F.lit(FAILED_INSPECTION)).otherwise(F.lit(0.0)),
        F.when(F.col("elevator_out_of_service") > 0, F.lit(ELEVATOR_OUT)).otherwise(F.lit(0.0)),
    ]
    return reduce(lambda a, b: a + b, counted + flat)


def risk_scores(f: Facts, as_of: str) -> DataFrame:
    """One row per building row: bbl, bin, overall_risk_score and the stored components.

    The buildings feed eight branches, so they are written once and read from there.
    """
    f = replace(f, buildings=written(f.buildings.select("bbl", "bin", "address", "latitude", "longitude"), "buildings"))
    spots = written(sp.distinct_spots(f.buildings), "spots")
    fires, by_spot = together(lambda: fires_by_bin(f.buildings, f.fire), lambda: near_by_spot(f, spots))
    by_bin = merge_measures(
        [*violations_by_bin(f.dob, f.ecb, f.hpd), *equipment_by_bin(f.inspections, f.elevators), fires],
        ["bin"], {**VIOLATION_SUMS, **EQUIPMENT_SUMS, "prior_fire_incidents": "sum"},
    )
    near_how = {
        "prior_ems_incidents": "sum", "nearby_nypd_incidents": "sum", "nearest_hydrant_ft": "min", "hospital": "min",
        "nearest_hospital_mi": "min",
    }
    near = near_by_bbl(f.buildings, by_spot, near_how)
    by_bbl = merge_measures(
        [near, velocity_by_bbl(f.buildings, f.requests, as_of)], ["bbl"],
        {**near_how, "complaint_velocity_30d": "sum", "complaint_velocity_90d": "sum"},
    )
    rows = left_spread(f.buildings.select("bbl", "bin"), by_bin, "bin", "bbl").join(by_bbl, "bbl", "left")
    rows = rows.withColumn("nearest_hospital", F.col("hospital.name"))
    return rows.select("bbl", "bin", composite().alias("overall_risk_score"), *STORED)


def push_scores(buildings: DataFrame, scores: DataFrame) -> DataFrame:
    """Buildings with their score; lots with several score rows take the highest."""
    best = scores.groupBy("bbl").agg(F.max("overall_risk_score").alias("_score"))
    old = F.col("risk_score") if "risk_score" in buildings.columns else F.lit(0.0)
    return buildings.join(best, "bbl", "left").withColumn("risk_score", F.coalesce("_score", old)).drop("_score")


def band_counts(scores: DataFrame) -> DataFrame:
    score = F.col("overall_risk_score")
    return scores.agg(
        F.count_if(score > 0).alias("scored"), F.count_if(score > 30).alias("yellow"), F.count_if(score > 60).alias("red")
    )


def with_bands(scores: DataFrame) -> DataFrame:
    score = F.col("overall_risk_score")
    return scores.withColumns({"band": codes.risk_band(score), "display_band": codes.display_band(score)})
