"""Base year, linear target paths and status against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import measure
from ledgerleaf.settings import CarbonSettings

SCOPE12 = ("Scope 1", "Scope 2")
AHEAD, NEAR, BEHIND = "ahead", "near", "behind"
NEAR_LOW, NEAR_HIGH = 0.9, 1.1


def _sum(cond: Column, cfg: CarbonSettings) -> Column:
    return measure(F.coalesce(F.sum(F.when(cond, F.col(cfg.value_column))), F.lit(0).cast("decimal(28,10)")))


def base_year_totals(facts: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """One row: base-year totals of both scope groups over all scopes (the sites filter applies, the scope filter does not)."""
    base = facts.filter(F.col("Year") == cfg.base_year)
    if cfg.sites is not None:
        base = base.filter(F.col("SiteName").isin(*cfg.sites))
    counted = F.lit(True) if cfg.include_use_phase else ~F.col("CategoryID").eqNullSafe("3.11")
    return base.agg(
        _sum(F.col("Scope").isin(*SCOPE12), cfg).alias("Scope12_Base"),
        _sum((F.col("Scope") == "Scope 3") & counted, cfg).alias("Scope3_Base"),
    )


def actuals(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Totals of both scope groups per year; null where a group has no rows in a year."""

    def total(cond: Column) -> Column:
        return measure(F.sum(F.when(cond, F.col(cfg.value_column))))

    return (
        sliced.filter(F.col("Year").isNotNull())
        .groupBy("Year")
        .agg(
            total(F.col("Scope").isin(*SCOPE12)).alias("Scope12_Actual"), total(F.col("Scope") == "Scope 3").alias("Scope3_Actual")
        )
    )


def target_path(facts: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Linear path per year from the base year to the target year."""
    span = max(cfg.target_year - cfg.base_year, 1)
    years = base_year_totals(facts, cfg).select("*", F.explode(F.sequence(F.lit(cfg.base_year), F.lit(cfg.target_year))).alias("Year"))

    def path(base: str, reduction: int) -> Column:
        done = (F.col("Year") - cfg.base_year) / F.lit(float(span))
        return F.round(F.col(base) * (1 - F.lit(reduction / 100) * done), 6)

    return years.select(
        "Year", path("Scope12_Base", cfg.reduction_scope12).alias("Scope12_Target"),
        path("Scope3_Base", cfg.reduction_scope3).alias("Scope3_Target"),
    )


def target_vs_actual(facts: DataFrame, sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    return target_path(facts, cfg).join(actuals(sliced, cfg), "Year", "left")


def target_status(facts: DataFrame, sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Two rows: latest actual, path, gap, target, cut still needed, required annual cut, change since the base year."""
    acts = actuals(sliced, cfg)
    # Per-year rows only: a year is a row of the joined path and actuals, at most a few dozen.
    years = target_path(facts, cfg).join(acts, "Year", "full")
    latest = F.max(F.when(F.col("Scope12_Actual").isNotNull(), F.col("Year")))

    def at(col: str, year: int) -> Column:
        return F.max(F.when(F.col("Year") == year, F.col(col)))

    def at_latest(col: str) -> Column:
        return F.max_by(F.col(col), F.when(F.col("Scope12_Actual").isNotNull(), F.col("Year")))

    one = years.agg(
        latest.alias("LatestYear"),
        *[at_latest(f"{g}_{k}").alias(f"{g}_{k}") for g in ("Scope12", "Scope3") for k in ("Actual", "Target")],
        *[at(f"{g}_Target", cfg.target_year).alias(f"{g}_Goal") for g in ("Scope12", "Scope3")],
        *[at(f"{g}_Actual", cfg.base_year).alias(f"{g}_BaseActual") for g in ("Scope12", "Scope3")],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("Target"), F.coalesce(F.col(f"{g}_Actual"), F.lit(0.0)).alias("Actual"),
                F.col(f"{g}_Target").alias("Pathway"), F.col(f"{g}_Goal").alias("TargetValue"), F.col(f"{g}_BaseActual").alias("Base"),
            )
            for g, label in (("Scope12", "Scope 1+2"), ("Scope3", "Scope 3"))
        ]
    )
    a, t = F.col("Actual"), F.col("TargetValue")
    years_left = F.greatest(F.lit(cfg.target_year) - F.col("LatestYear"), F.lit(1))
    return one.select("LatestYear", F.inline(rows)).select(
        "Target", "LatestYear", "Actual", "Pathway", F.round(a - F.col("Pathway"), 6).alias("Gap"), "TargetValue",
        F.round(a - t, 6).alias("CutStillNeeded"),
        F.when((a > 0) & (t > 0), F.round(1 - F.pow(t / a, 1 / years_left), 6)).alias("RequiredAnnualCut"),
        F.when(F.col("Base") != 0, F.round(a / F.col("Base") - 1, 6)).alias("ChangeSinceBase"),
    )


def target_band(facts: DataFrame, sliced: DataFrame, cfg: CarbonSettings, lower_is_better: bool = True) -> DataFrame:
    """Reporting-year actual against the path: ahead, near or behind."""
    row = target_vs_actual(facts, sliced, cfg).filter(F.col("Year") == cfg.reporting_year)
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("Target"), F.coalesce(F.col(f"{g}_Actual"), F.lit(0.0)).alias("Actual"), F.col(f"{g}_Target").alias("Pathway"))
            for g, label in (("Scope12", "Scope 1+2"), ("Scope3", "Scope 3"))
        ]
    )
    low, high = (AHEAD, BEHIND) if lower_is_better else (BEHIND, AHEAD)
    band = F.when(F.col("Actual") < F.col("Pathway") * NEAR_LOW, low).when(F.col("Actual") <= F.col("Pathway") * NEAR_HIGH, NEAR).otherwise(high)
    return row.select("Year", F.inline(rows)).withColumn("Band", band)
