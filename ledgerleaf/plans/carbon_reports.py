"""Inventory report tables. ``facts`` is everything, ``sliced`` obeys the filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf import dims
from ledgerleaf.functions.columns import measure, ratio
from ledgerleaf.operators.carbon.fact import scope_label
from ledgerleaf.operators.carbon.targets import actuals, target_vs_actual
from ledgerleaf.operators.ordered import running_total
from ledgerleaf.settings import CarbonSettings

SCOPES = ("Scope 1", "Scope 2", "Scope 3")
PARETO_SHARE = 0.8
TOP_ACTIVITIES = 10
BASIS_GAP_LIMIT = 0.02


def _t(cfg: CarbonSettings) -> Column:
    return measure(F.sum(cfg.value_column)).alias("tCO2e")


def _year(df: DataFrame, year: int) -> DataFrame:
    return df.filter(F.col("Year") == year)


def slice_values(facts: DataFrame) -> DataFrame:
    years = facts.filter(F.col("Year").isNotNull()).select(F.lit("Year").alias("Field"), F.col("Year").cast("string").alias("Value"))
    sites = facts.filter(F.col("SiteName").isNotNull()).select(F.lit("SiteName").alias("Field"), F.col("SiteName").alias("Value"))
    return years.unionByName(sites).distinct()


def scope_year(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Year x scope, fixed columns, zero where empty, with the row total."""
    v = F.col(cfg.value_column)
    zero = F.lit(0).cast("decimal(28,10)")
    sums = {s: F.coalesce(F.sum(F.when(F.col("Scope") == s, v)), zero) for s in SCOPES}
    total = F.coalesce(F.sum(F.when(F.col("Scope").isin(*SCOPES), v)), zero)
    return (
        sliced.filter(F.col("Year").isNotNull())
        .groupBy("Year")
        .agg(*[measure(c).alias(s) for s, c in sums.items()], measure(total).alias("Total"))
    )


def month_scope(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    return sliced.groupBy("YearMonth", "Scope").agg(_t(cfg))


def site_activity(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    own = _year(sliced, cfg.reporting_year).filter(F.col("Scope").isin("Scope 1", "Scope 2"))
    return own.groupBy("SiteName", "ActivityType").agg(_t(cfg))


def scope2_by_month(sliced: DataFrame) -> DataFrame:
    return sliced.filter("Scope = 'Scope 2'").groupBy("YearMonth").agg(
        measure(F.sum("tCO2e_Location")).alias("tCO2e_Location"), measure(F.sum("tCO2e_Market")).alias("tCO2e_Market")
    )


def scope1_by_month(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    return sliced.filter("Scope = 'Scope 1'").groupBy("YearMonth", "ActivityType").agg(_t(cfg))


def site_table(sliced: DataFrame, years: list[int], cfg: CarbonSettings, sites: DataFrame | None = None) -> DataFrame:
    """Scope 1 and 2 per site and scope, one column per year, with the site's attributes."""
    own = sliced.filter(F.col("Scope").isin("Scope 1", "Scope 2") & F.col("Year").isNotNull())
    wide = own.groupBy("SiteName", "Scope").pivot("Year", years).agg(measure(F.sum(cfg.value_column))).na.fill(0.0)
    if sites is None:
        return wide
    attributes = sites.groupBy("SiteName").agg(*[F.min(c).alias(c) for c in ("Country", "SiteType", "Employees")])
    return wide.join(attributes, "SiteName", "left")


def years_present(facts: DataFrame) -> list[int]:
    """Calendar years in the facts: a few dozen values, needed as column names."""
    return [r.Year for r in facts.select("Year").filter("Year IS NOT NULL").distinct().orderBy("Year").collect()]


def scope3_all_categories(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """All fifteen categories, zero where nothing is reported."""
    found = (
        _year(sliced, cfg.reporting_year).filter("Scope = 'Scope 3'").groupBy("CategoryID").agg(_t(cfg))
    )
    names = dims.category_names(sliced.sparkSession).filter("CategoryID LIKE '3.%'")
    t = F.coalesce("tCO2e", F.lit(0.0))
    # Fifteen rows, so the window is too.
    total = F.greatest(F.sum(t).over(Window.partitionBy()), F.lit(1.0))
    return names.join(found, "CategoryID", "left").select(
        "CategoryID", scope_label(F.col("CategoryID"), F.col("CategoryName")).alias("ScopeCategory"), t.alias("tCO2e"),
        F.when(F.col("tCO2e").isNotNull(), "Included").otherwise("Not applicable / not reported").alias("Status"),
        F.round(t / F.round(total, 6), 6).alias("Share"),
    )


def category_status(sliced: DataFrame, categories: DataFrame, cfg: CarbonSettings) -> DataFrame:
    totals = scope3_all_categories(sliced, cfg).select("CategoryID", "tCO2e", "Share")
    return categories.filter("Scope = 'Scope 3'").join(totals, "CategoryID", "left")


def scope3_trend(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    return sliced.filter("Scope = 'Scope 3'").groupBy("Year", "ScopeCategory").agg(_t(cfg))


def yoy_by_category(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Change to the year before by joining year - 1; a gap in the years gives null."""
    now = sliced.filter(F.col("Year").isNotNull()).groupBy("ScopeCategory", "Year").agg(_t(cfg))
    before = now.select("ScopeCategory", (F.col("Year") + 1).alias("Year"), F.col("tCO2e").alias("Previous"))
    return now.join(before, ["ScopeCategory", "Year"], "left").withColumns(
        {"Change": F.round(F.col("tCO2e") - F.col("Previous"), 6), "ChangeRate": F.round(F.try_divide("tCO2e", "Previous") - 1, 6)}
    )


def change_bridge(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Scope 3 from the year before to the reporting year: start, one delta per category, end."""
    v = F.col(cfg.value_column)
    two = sliced.filter((F.col("Scope") == "Scope 3") & F.col("Year").isin(cfg.reporting_year - 1, cfg.reporting_year))
    zero = F.lit(0).cast("decimal(28,10)")

    def of(year: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("Year") == year, v)), zero)

    delta = two.groupBy("ScopeCategory").agg(measure(of(cfg.reporting_year) - of(cfg.reporting_year - 1)).alias("tCO2e"))
    ends = two.agg(measure(of(cfg.reporting_year - 1)).alias("a"), measure(of(cfg.reporting_year)).alias("b"))
    steps = ends.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("Step"), F.lit(str(cfg.reporting_year - 1)).alias("Label"), F.col("a").alias("tCO2e")),
                F.struct(F.lit(2).alias("Step"), F.lit(str(cfg.reporting_year)).alias("Label"), F.col("b").alias("tCO2e")),
            )
        )
    )
    return steps.unionByName(delta.select(F.lit(1).alias("Step"), F.col("ScopeCategory").alias("Label"), "tCO2e")).orderBy(
        "Step", "tCO2e", "Label"
    )


def hierarchy(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Scope > category > activity of the reporting year with the share of everything."""
    leaves = (
        _year(sliced, cfg.reporting_year)
        .groupBy("Scope", "ScopeCategory", "ActivityType")
        .agg(F.sum(cfg.value_column).alias("v"))
        .filter("v > 0")
    )
    levels = leaves.rollup("Scope", "ScopeCategory", "ActivityType").agg(F.grouping_id().cast("int").alias("g"), measure(F.sum("v")).alias("tCO2e"))
    depth = F.when(F.col("g") == 0, 3).when(F.col("g") == 1, 2).when(F.col("g") == 3, 1).otherwise(0)
    root = leaves.agg(measure(F.sum("v"))).scalar()
    return levels.select("Scope", "ScopeCategory", "ActivityType", depth.alias("Depth"), "tCO2e", ratio(F.col("tCO2e"), root).alias("Share"))


def pareto(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Activities by size with their cumulative share and how many make up 80 %."""
    sums = _year(sliced, cfg.reporting_year).groupBy("ActivityType").agg(F.sum(cfg.value_column).cast("decimal(28,10)").alias("v"))
    ranked = running_total(sums, [F.desc("v"), F.asc("ActivityType")], F.col("v"), "cum")
    total = ranked.agg(measure(F.sum("v"))).scalar()
    shared = ranked.select(
        "ActivityType", measure(F.col("v")).alias("tCO2e"), ratio(measure(F.col("cum")), total).alias("Cumulative"),
        ratio(measure(F.col("v")), total).alias("Share"),
    )
    n80 = shared.agg(F.count_if(F.col("Cumulative") <= PARETO_SHARE) + 1).scalar()
    return shared.withColumn("N80", n80)


def top_activities(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    return pareto(sliced, cfg).drop("N80").orderBy(F.desc("tCO2e"), "ActivityType").limit(TOP_ACTIVITIES)


def data_quality(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Emissions-weighted score per category (on the location basis whatever the chosen one) and improvement potential."""
    by = _year(sliced, cfg.reporting_year).groupBy("ScopeCategory").agg(
        _t(cfg), measure(F.sum("DQ_Weighted")).alias("w"), measure(F.sum("tCO2e_Location")).alias("l")
    )
    score = F.round(F.col("w") / F.greatest("l", F.lit(1.0)), 6)
    return by.select("ScopeCategory", "tCO2e", score.alias("WeightedDQ")).withColumn(
        "ImprovementPotential", F.round(F.col("tCO2e") * (F.col("WeightedDQ") - 1), 6)
    )


def method_share(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    by = sliced.groupBy("Year", "Method").agg(_t(cfg))
    # At most one row per method inside a year.
    return by.withColumn("Share", ratio(F.col("tCO2e"), F.round(F.sum("tCO2e").over(Window.partitionBy("Year")), 6)))


def scope2_basis_gap(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    s2 = _year(sliced, cfg.reporting_year).filter("Scope = 'Scope 2'").agg(
        measure(F.sum("tCO2e_Location")).alias("Location"), measure(F.sum("tCO2e_Market")).alias("Market")
    )
    gap = F.round(F.try_divide(F.abs(F.col("Location") - F.col("Market")), "Location"), 6)
    return s2.withColumn("RelativeGap", gap).withColumn("IsReported", F.coalesce(F.col("RelativeGap") > BASIS_GAP_LIMIT, F.lit(False)))


def intensity(sliced: DataFrame, drivers: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Emissions per revenue and per unit sold, by year."""
    acts = actuals(sliced, cfg)
    totals = scope_year(sliced, cfg).select("Year", "Total")
    kg = F.coalesce("Scope12_Actual", F.lit(0.0)) * 1000
    return totals.join(acts, "Year", "left").join(drivers.select("Year", "RevenueUSDm", "UnitsSold"), "Year", "left").select(
        "Year", "Total", "RevenueUSDm", "UnitsSold",
        ratio(F.col("Total"), F.col("RevenueUSDm")).alias("tCO2e_per_USDm"), ratio(kg, F.col("UnitsSold")).alias("kgCO2e_per_unit"),
    )


def summary_by_category(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    return sliced.filter(F.col("Year").isNotNull()).groupBy("ScopeCategory", "Year").agg(_t(cfg))


def summary_by_site(sliced: DataFrame, cfg: CarbonSettings) -> DataFrame:
    return sliced.filter(F.col("Year").isNotNull()).groupBy("SiteName", "Scope", "Year").agg(_t(cfg))


def kpis(sliced: DataFrame, drivers: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """One row: totals of the reporting year, changes to the year before, intensities and data quality."""
    y, p = cfg.reporting_year, cfg.reporting_year - 1
    years = scope_year(sliced, cfg)
    per = years.agg(
        *[F.max(F.when(F.col("Year") == y, F.col(f"`{c}`"))).alias(c) for c in (*SCOPES, "Total")],
        *[F.max(F.when(F.col("Year") == p, F.col(f"`{c}`"))).alias(f"{c} previous") for c in (*SCOPES, "Total")],
    )
    dq = _year(sliced, y).agg(measure(F.sum("DQ_Weighted")).alias("w"), measure(F.sum("tCO2e_Location")).alias("l"))
    rates = intensity(sliced, drivers, cfg)
    of = lambda year, c: rates.filter(F.col("Year") == year).select(F.max(c)).scalar()
    score = dq.select(F.round(F.col("w") / F.greatest("l", F.lit(1.0)), 6)).scalar()
    return per.select(
        *[F.col(f"`{c}`").alias(c.replace(" ", "")) for c in (*SCOPES, "Total")],
        *[F.round(F.col(f"`{c}`") - F.col(f"`{c} previous`"), 6).alias(c.replace(" ", "") + "_Change") for c in (*SCOPES, "Total")],
        ratio(F.col("`Scope 3`"), F.col("Total")).alias("Scope3Share"),
        of(y, "tCO2e_per_USDm").alias("tCO2e_per_USDm"),
        F.round(of(y, "tCO2e_per_USDm") - of(p, "tCO2e_per_USDm"), 6).alias("tCO2e_per_USDm_Change"),
        of(y, "kgCO2e_per_unit").alias("kgCO2e_per_unit"),
        score.alias("WeightedDQ"),
    )


def findings(facts: DataFrame, sliced: DataFrame, drivers: DataFrame, cfg: CarbonSettings) -> DataFrame:
    """Findings as data: scope 3 share, top category, change, gap to path, data quality, contractual instruments."""
    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def finding(rank: int, code: str, value: Column, subject: Column = null_s, second: Column = null_d) -> list[Column]:
        return [
            F.lit(rank).alias("Rank"), F.lit(code).alias("Code"), subject.alias("Subject"), value.cast("double").alias("Value"),
            second.cast("double").alias("SecondValue"),
        ]

    y = cfg.reporting_year
    one = kpis(sliced, drivers, cfg)
    s3 = _year(sliced, y).filter("Scope = 'Scope 3'")
    top_row = s3.groupBy("ScopeCategory").agg(_t(cfg)).orderBy(F.desc("tCO2e"), "ScopeCategory").limit(1)
    s3_total = s3.agg(F.greatest(measure(F.sum(cfg.value_column)), F.lit(1.0))).scalar()
    share = one.select(*finding(1, "scope3_share", F.coalesce("Scope3Share", F.lit(0.0)), second=F.col("Scope3")))
    top = top_row.select(*finding(2, "top_scope3_category", ratio(F.col("tCO2e"), s3_total), F.col("ScopeCategory"), F.col("tCO2e")))
    previous = F.col("Total") - F.col("Total_Change")
    before = F.col("tCO2e_per_USDm") - F.col("tCO2e_per_USDm_Change")
    change = one.filter(F.col("Total_Change").isNotNull()).select(
        *finding(
            3, "change_to_previous_year", F.round(F.try_divide(F.col("Total_Change"), previous), 6),
            second=F.round(F.try_divide(F.col("tCO2e_per_USDm_Change"), before), 6),
        )
    )
    on_path = target_vs_actual(facts, sliced, cfg).filter((F.col("Year") == y) & F.col("Scope12_Actual").isNotNull())
    gap = on_path.select(
        *finding(4, "gap_to_path_scope12", F.round(F.try_divide("Scope12_Actual", "Scope12_Target") - 1, 6), second=F.lit(float(cfg.reduction_scope12)))
    )
    spend = s3.agg(
        ratio(
            F.coalesce(measure(F.sum(F.when(F.col("Method") == "Spend-based", F.col(cfg.value_column)))), F.lit(0.0)),
            F.greatest(measure(F.sum(cfg.value_column)), F.lit(1.0)),
        )
    ).scalar()
    quality = one.select(*finding(5, "weighted_data_quality", F.col("WeightedDQ"), second=spend))
    basis = scope2_basis_gap(sliced, cfg).filter("IsReported").select(
        *finding(6, "contractual_instruments", F.round(1 - F.try_divide("Market", "Location"), 6), second=F.col("Market"))
    )
    return reduce(DataFrame.unionByName, [share, top, change, gap, quality, basis])
