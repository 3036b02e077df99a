"""Contribution scoring, reliability, decay and titles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Experience points.
PIONEER_XP, MATERIAL_XP = 15, 5
TIER_XP = {"none": 0, "address_only": 10, "partial": 15, "full": 30}
VOTE_XP = {"verified": 5, "disputed": 3}
#: Stamp and verification milestones: count reached, title, points.
STAMP_MILESTONES = ((10, "master_validator", 50), (25, "database_legend", 100))
VERIFICATION_MILESTONES = ((10, "fact_checker", 25), (50, "truth_seeker", 100))


def longer(text: Column, n: int) -> Column:
    return F.coalesce(F.length(F.trim(text)) > n, F.lit(False)).cast("int")


def contribution(address: Column, architect: Column, year: Column, style: Column, notes: Column, materials: list[Column], in_top_3: Column) -> Column:
    """(type, xp, fields, pioneer) of a contribution: valid fields make the tier, materials and a miss of the top three add."""
    made = sum((longer(m, 2) for m in materials), F.lit(0))
    fields = longer(address, 5) + longer(architect, 2) + F.coalesce(year.between(1800, 2030), F.lit(False)).cast("int") + longer(style, 2) + longer(notes, 10) + made
    kind = F.when(fields == 0, "none").when((fields == 1) & (F.coalesce(F.trim(address), F.lit("")) != ""), "address_only").when(fields <= 2, "partial").otherwise("full")
    xp = F.when(kind == "none", TIER_XP["none"]).when(kind == "address_only", TIER_XP["address_only"]).when(kind == "partial", TIER_XP["partial"]).otherwise(TIER_XP["full"])
    pioneer = ~in_top_3 & (kind != "none")
    return F.struct(kind.alias("type"), (xp + made * MATERIAL_XP + F.when(pioneer, PIONEER_XP).otherwise(0)).alias("xp"), fields.alias("fields"), pioneer.alias("pioneer"))


def reliability(verified: Column, disputed: Column) -> Column:
    total = verified + disputed
    return F.when(total > 0, verified / total * F.least(total / F.lit(3.0), F.lit(1.0))).otherwise(F.lit(0.0))


def status(score: Column) -> Column:
    return F.when(score >= 0.9, "highly_verified").when(score >= 0.7, "verified").when(score >= 0.5, "partially_verified").otherwise("unverified")


def whole_days(since: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(since)) / 86400)


def decay(created: Column, last_verified: Column, as_of: Column) -> Column:
    """1 for 90 days without a verification, then down to 0.5 over a year."""
    days = whole_days(F.coalesce(last_verified, created), as_of)
    return F.when(days < 90, F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), 1 - (days - 90) / F.lit(365.0) * 0.5))


def title(pioneers: Column, validators: Column) -> Column:
    return F.when(validators >= 25, "Database Legend").when(validators >= 10, "Master Validator").when(pioneers >= 1, "Pioneer").otherwise("Explorer")


def accepted(votes_for: Column, votes_against: Column) -> Column:
    return (votes_for >= 3) & (votes_for >= 2 * votes_against)
