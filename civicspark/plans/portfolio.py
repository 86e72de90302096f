"""Owner portfolios: from registrations and contacts, and computed from the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import written
from ..sources.specs import OWNER_ROLES

# Limits above which an owner counts as neglectful.
NEGLECT_CLASS_C = 5
NEGLECT_BALANCE = 50000.0


def open_status(status: Column) -> Column:
    """Not closed. A missing status is not open: the comparison is NULL and the row is not counted."""
    return status != "CLOSE"


def joined(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All values of a group as one comma list in order. One row per group: only for lists a reader can hold."""
    return df.groupBy(*keys).agg(F.expr(f"listagg(CAST({value} AS STRING), ',') WITHIN GROUP (ORDER BY CAST({value} AS STRING))").alias("bins"))


def _empty_measures() -> dict[str, Column]:
    return {
        "total_open_violations": F.lit(0),
        "total_class_c_violations": F.lit(0),
        "total_ecb_balance_due": F.lit(0.0),
        "avg_violations_per_building": F.lit(0.0),
    }


def registrations(regs: DataFrame) -> DataFrame:
    """Contact -> distinct registrations. ``regs`` has (contact, registration_id, bin)."""
    known = regs.where(F.col("contact").isNotNull() & F.col("bin").isNotNull())
    counts = known.groupBy(F.col("contact").alias("owner_name")).agg(
        F.countDistinct("registration_id").cast("int").alias("total_buildings")
    )
    return counts.withColumns(_empty_measures())


def registration_members(regs: DataFrame) -> DataFrame:
    """The bins behind each contact, one per row, copies included."""
    return regs.where(F.col("contact").isNotNull() & F.col("bin").isNotNull()).select(
        F.col("contact").alias("owner_name"), F.col("bin").cast("string").alias("bin")
    )


def _named_contacts(contacts: DataFrame) -> DataFrame:
    person = F.trim(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))))
    owners = contacts.where(F.col("role").isin(*OWNER_ROLES) & F.coalesce("corporation", "first_name").isNotNull())
    return owners.select(F.coalesce("corporation", person).alias("owner_name"), "registration_id")


def contacts_not_listed(contacts: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Owners among the contacts whose name the portfolio does not have yet."""
    counts = _named_contacts(contacts).groupBy("owner_name").agg(
        F.countDistinct("registration_id").cast("int").alias("total_buildings")
    )
    taken = portfolio.where(F.col("owner_name").isNotNull()).select("owner_name").distinct()
    return counts.join(taken, "owner_name", "left_anti").withColumns(_empty_measures())


def contact_members(contacts: DataFrame) -> DataFrame:
    return _named_contacts(contacts).select("owner_name", F.col("registration_id").cast("string").alias("bin"))


def with_contacts(regs: DataFrame, contacts: DataFrame) -> DataFrame:
    base = registrations(regs)
    return base.unionByName(contacts_not_listed(contacts, base))


def owner_bins(buildings: DataFrame) -> DataFrame:
    """Distinct known bins of each owner, one per row."""
    return buildings.where(F.col("owner_name").isNotNull() & F.col("bin").isNotNull()).select("owner_name", "bin").distinct()


def owner_portfolio(buildings: DataFrame, dob: DataFrame, hpd: DataFrame, ecb: DataFrame, balance: str = "compat") -> DataFrame:
    """One row per named owner.

    ``balance="compat"`` is the sum over the full join of buildings with DOB, HPD and active ECB rows, in which every
    balance is repeated once per matching row of the other two tables; it is computed from per-bin row counts, so
    the repeated rows never exist. ``balance="exact"`` adds each bin's balance once per owner.
    """
    if balance not in ("compat", "exact"):
        raise ValueError("balance is 'compat' or 'exact'")
    owned = buildings.where(F.col("owner_name").isNotNull())
    lots = owned.groupBy("owner_name").agg(F.countDistinct("bbl").alias("total_buildings"))
    bins = owned.where(F.col("bin").isNotNull()).groupBy("owner_name", "bin").agg(F.count(F.lit(1)).alias("lots"))
    bins = written(bins, "owner-bins")  # read by five branches

    def distinct_ids(facts: DataFrame, key: str, name: str) -> DataFrame:
        # An id that occurs in one bin only is counted there, and owners add up the counts of their bins. Only the
        # ids found in several bins are followed to the owner one by one. So a crowded bin with many owners never
        # multiplies its rows.
        rows = facts.where(f"{key} IS NOT NULL AND bin IS NOT NULL").selectExpr(f"{key} AS _id", "bin")
        seen = rows.groupBy("_id").agg(F.expr("min(bin) AS lo"), F.expr("max(bin) AS hi"))
        plain = seen.where("lo = hi").groupBy(F.col("lo").alias("bin")).agg(F.expr("count(1) AS n"))
        spread = rows.join(seen.where("lo != hi").select("_id"), "_id", "left_semi")
        counts = bins.join(plain, "bin").select("owner_name", "n").unionByName(
            bins.join(spread, "bin").groupBy("owner_name").agg(F.countDistinct("_id").alias("n"))
        )
        return counts.groupBy("owner_name").agg(F.sum("n").alias(name))

    open_dob = distinct_ids(dob.where("is_active"), "id", "open_n")
    open_c = distinct_ids(
        hpd.where((F.col("violation_class") == "C") & open_status(F.col("current_status"))), "violation_id", "class_c_n"
    )
    due = ecb.where("is_active").groupBy("bin").agg(F.sum("balance_due").alias("due"))
    per_bin = bins.join(due, "bin")  # bins without a balance add nothing
    if balance == "compat":
        repeats = [
            facts.groupBy("bin").agg(F.count(F.lit(1)).alias(name)) for facts, name in ((dob, "dob_n"), (hpd, "hpd_n"))
        ]
        for counted in repeats:
            per_bin = per_bin.join(counted, "bin", "left")
        times = F.coalesce("dob_n", F.lit(1)) * F.coalesce("hpd_n", F.lit(1)) * F.col("lots")
        per_bin = per_bin.withColumn("due", F.col("due") * times)
    owed = per_bin.groupBy("owner_name").agg(F.sum("due").alias("owed"))
    out = lots.where(F.col("total_buildings") > 0)
    for part in (open_dob, open_c, owed):
        out = out.join(part, "owner_name", "left")
    opened = F.coalesce("open_n", F.lit(0))
    return out.select(
        "owner_name",
        "total_buildings",
        opened.alias("total_open_violations"),
        F.coalesce("class_c_n", F.lit(0)).alias("total_class_c_violations"),
        F.coalesce("owed", F.lit(0.0)).alias("total_ecb_balance_due"),
        F.coalesce(opened / F.nullif(F.col("total_buildings"), F.lit(0)), F.lit(0.0)).alias("avg_violations_per_building"),
    )


def with_bin_text(portfolio: DataFrame, members: DataFrame) -> DataFrame:
    """Add the comma list of bins as one text column."""
    return portfolio.join(joined(members, ["owner_name"], "bin"), "owner_name", "left")


def high_neglect(portfolio: DataFrame) -> DataFrame:
    return portfolio.where(
        (F.col("total_class_c_violations") > NEGLECT_CLASS_C) | (F.col("total_ecb_balance_due") > NEGLECT_BALANCE)
    )


