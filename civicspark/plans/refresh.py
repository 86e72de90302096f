"""Full refresh as one job: load, portfolio, risk, embed. Phases can be chosen.

``spark-submit -m civicspark.plans.refresh --all --data-dir DIR [DIR ...] --out-dir OUT --as-of 2024-02-10``
"""

from __future__ import annotations

import argparse
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import together
from ..session import build_session
from ..sources import conform as cf
from ..sources import sinks
from ..sources.files import find_file, headers, is_present, pick, read_table
from ..sources.specs import SPECS
from . import corpus, crosswalk, portfolio, risk

# Column that clusters the files of each table, for key lookups that skip files.
CLUSTER_BY = {
    "buildings": "bbl", "dob_violations": "bin", "dob_safety_violations": "bin", "dob_ecb_violations": "bin",
    "hpd_violations": "bin", "hpd_complaints": "bin", "fire_prevention_inspections": "bin", "elevators": "bin",
    "service_requests_311": "bbl", "building_risk_scores": "bbl",
}
CROSSWALK_SOURCES = {"hpd_violations": 1, "hpd_complaints": 2, "registrations": 3}


class Store:
    """Tables as Parquet folders under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, name: str, df: DataFrame) -> None:
        sinks.replace_table(df, f"{self.root}/{name}", CLUSTER_BY.get(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")


def _scan(spark: SparkSession, name: str, dirs: list[str], multi_line: bool = False) -> DataFrame | None:
    path = find_file(spark, dirs, list(SPECS[name].files))
    return None if path is None else read_table(spark, path, multi_line)


def load(spark: SparkSession, dirs: list[str], store: Store, lenient_dates: bool = False, multi_line: bool = False) -> list[str]:
    """Conform every data set that has a file; the names of the tables written."""
    raw = {name: _scan(spark, name, dirs, multi_line) for name in SPECS}
    found = {name: df for name, df in raw.items() if df is not None}
    steps: dict[str, Callable[[], DataFrame]] = {}
    for name, df in found.items():
        if name in cf.RULES and name != "hospitals":
            steps[SPECS[name].table] = lambda n=name, d=df: cf.conform(d, n, lenient_dates)
    if "facilities" in found:
        steps["hospitals"] = lambda: cf.hospitals_from_facilities(cf.conform(found["facilities"], "facilities"))
    elif "hospitals" in found:
        steps["hospitals"] = lambda: cf.conform(found["hospitals"], "hospitals")
    if "buildings" in steps:
        steps["buildings"] = lambda: _filled(cf.conform(found["pluto"], "pluto"), found)
    if "registrations" in found:
        steps["owner_portfolio"] = lambda: _registered(found)
    together(*[lambda n=n, s=s: store.write(n, s()) for n, s in steps.items()])
    return sorted(steps)


def _filled(buildings: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    sources = []
    for name, priority in CROSSWALK_SOURCES.items():
        if name in found and all(is_present(headers(found[name]), c) for c in ("bbl", "bin")):
            available = headers(found[name])
            sources.append((found[name].select(pick(available, "bbl").alias("bbl"), pick(available, "bin").alias("bin")), priority))
    return crosswalk.fill_bins(buildings, crosswalk.crosswalk(sources)) if sources else buildings


def _registered(found: dict[str, DataFrame]) -> DataFrame:
    _, cols = cf.typed(found["registrations"], SPECS["registrations"])
    regs = found["registrations"].select(cols["contact"], cols["registration_id"], cols["bin"])
    if "registration_contacts" not in found:
        return portfolio.registrations(regs)
    _, cols = cf.typed(found["registration_contacts"], SPECS["registration_contacts"])
    return portfolio.with_contacts(regs, found["registration_contacts"].select(*cols.values()))


def compute_portfolio(store: Store, balance: str = "compat") -> None:
    b = store.read("buildings")
    store.write("owner_portfolio", portfolio.owner_portfolio(
        b, store.read("dob_violations"), store.read("hpd_violations"), store.read("dob_ecb_violations"), balance))
    store.write("owner_bins", portfolio.owner_bins(b))  # bins as rows; with_bin_text adds them as text on request


def compute_risk(store: Store, as_of: str) -> None:
    names = {
        "buildings": "buildings", "dob": "dob_violations", "ecb": "dob_ecb_violations", "hpd": "hpd_violations",
        "fire": "fire_incidents", "ems": "ems_incidents", "nypd": "nypd_complaints", "requests": "service_requests_311",
        "inspections": "fire_prevention_inspections", "elevators": "elevators", "hydrants": "fire_hydrants", "hospitals": "hospitals",
    }
    facts = risk.Facts(**{k: store.read(t) for k, t in names.items()})
    store.write("building_risk_scores", risk.risk_scores(facts, as_of))
    store.write("buildings_scored", risk.push_scores(facts.buildings, store.read("building_risk_scores")))


def compute_corpus(store: Store, encoder=None, since: str | None = None) -> None:
    rows = corpus.incidents(store.read("service_requests_311"), store.read("fire_incidents"), store.read("nypd_complaints"), since)
    sinks.write_vectors(corpus.documents(rows), encoder or corpus.bag_of_words(), f"{store.root}/incident_corpus")


def run(spark: SparkSession, dirs: list[str], out: str, phases: list[str], as_of: str | None, lenient_dates: bool = False,
        multi_line: bool = False) -> None:
    store = Store(spark, out)
    if "load" in phases:
        load(spark, dirs, store, lenient_dates, multi_line)
    if "portfolio" in phases:
        compute_portfolio(store)
    if "risk" in phases:
        compute_risk(store, as_of or str(spark.range(1).select(F.current_date()).first()[0]))
    if "embed" in phases:
        compute_corpus(store)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for phase in ("load", "portfolio", "risk", "embed", "all"):
        parser.add_argument(f"--{phase}", action="store_true")
    parser.add_argument("--data-dir", nargs="+", required=True)
    parser.add_argument("--out-dir", required=True)
    parser.add_argument("--as-of")
    parser.add_argument("--lenient-dates", action="store_true")
    parser.add_argument("--multi-line", action="store_true", help="quoted fields hold line breaks; each file is then one task")
    args = parser.parse_args(argv)
    phases = [p for p in ("load", "portfolio", "risk", "embed") if args.all or getattr(args, p)]
    if not phases:
        parser.error("choose at least one phase")
    run(build_session("refresh"), args.data_dir, args.out_dir, phases, args.as_of, args.lenient_dates, args.multi_line)


if __name__ == "__main__":
    main()
