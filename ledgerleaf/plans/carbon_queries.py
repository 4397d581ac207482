"""The carbon queries over the derived activity rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import dims, fixtures
from ledgerleaf.functions.columns import decimals_as_double, measure
from ledgerleaf.operators.carbon import fact as facts_of
from ledgerleaf.operators.carbon import factors, targets
from ledgerleaf.plans import carbon_reports as reports
from ledgerleaf.settings import CarbonSettings
from ledgerleaf.sources import bundles, sinks
from ledgerleaf.store import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]

CFG = CarbonSettings(**fixtures.CARBON_YEARS)
LOCATION_CFG = CarbonSettings(**fixtures.CARBON_YEARS, basis="Location", include_use_phase=False, scopes=("Scope 1", "Scope 3"))
MAPPING = {
    "Date": "Date", "Site": "Site", "Scope": "Scope", "Category": "Category", "ActivityType": "Activity", "Quantity": "Quantity",
    "Unit": "Unit", "Factor": "Factor",
}
NEW_FACTORS = (("EF_NG", 2), ("EF_EL_TH", 3), ("EF_SP_STEEL", 4))


def activity(spark: SparkSession, sf_dir: str, supplied: bool = False) -> DataFrame:
    return factors.activity_columns(fixtures.activity_rows(spark, sf_dir, supplied).drop("lib_no"), MAPPING)


def converted(spark: SparkSession, sf_dir: str, supplied: bool = False) -> DataFrame:
    return factors.activity_to_fact(activity(spark, sf_dir, supplied), dims.factors(spark))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the converted activity; sites of even nations buy contractual electricity at 65 % of the grid factor."""
    contract = (F.col("Scope") == "Scope 2") & (F.regexp_extract("SiteID", r"(\d+)$", 1).try_cast("int") % 2 == 0)
    market = F.when(contract, (F.col("EmissionFactor") * F.lit("0.65").cast("decimal(3,2)")).cast(facts_of.FACTOR))
    return facts_of.normalise_fact(converted(spark, sf_dir).withColumn("EmissionFactorMarket", market))


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and units per year from the order tables, in the shape of the target table."""
    revenue = (
        fixtures.table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").alias("Year"))
        .agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).cast("double") / 100000000).alias("RevenueUSDm"))
    )
    units = (
        fixtures.table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("Year")).agg(F.sum("l_quantity").alias("UnitsSold"))
    )
    return revenue.join(units, "Year", "full")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site dimension from the nations."""
    n = F.col("n_nationkey")
    regions = fixtures.table(spark, sf_dir, "region")
    return (
        fixtures.table(spark, sf_dir, "nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("SiteID"), F.concat(F.lit("Site "), "n_name").alias("SiteName"), F.col("r_name").alias("Country"),
            F.when(n % 3 == 0, "Office").otherwise("Manufacturing").alias("SiteType"), (n * 10 + 5).alias("Employees"),
            F.when(n % 4 == 0, "TH").when(n % 4 == 1, "VN").when(n % 4 == 2, "DE").otherwise("US").alias("GridRegion"),
        )
    )


def fact_view(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "Date", "SiteID", "Scope", "CategoryID", "ActivityType", F.col("Quantity").cast("double").alias("Quantity"), "FactorID",
        F.col("EmissionFactor").cast("double").alias("EmissionFactor"), "Method", "DataQualityScore", *extra,
    )


def _measured(df: DataFrame) -> DataFrame:
    return df.withColumns({c: measure(F.col(c)) for c in ("tCO2e_Location", "tCO2e_Market")})


def _emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = facts_of.with_emissions(facts_of.clean_fact(fixtures.raw_facts(spark, sf_dir)), "SourceFile")
    return _measured(fact).select("SourceFile", "SiteID", "ActivityType", "YearMonth", "tCO2e_Location", "tCO2e_Market")


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_view(facts_of.clean_fact(fixtures.raw_facts(spark, sf_dir)), "YearMonth", "SourceFile")


def _resolved(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    # All rows of an activity resolve alike, so the result is shown per activity.
    rows = factors.resolve_factors(activity(spark, sf_dir), dims.factors(spark), **kw)
    return rows.groupBy("ActivityType", "lib_no", "MatchedBy").agg(F.count(F.lit(1)).alias("Rows"))


def _resolved_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = factors.resolve_factors(activity(spark, sf_dir), dims.factors(spark), sites=sites(spark, sf_dir), match="region")
    return rows.groupBy("SiteID", "ActivityType", "lib_no", "MatchedBy").agg(F.count(F.lit(1)).alias("Rows"))


def _repriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.create_map(*[F.lit(x) for pair in NEW_FACTORS for x in pair])
    library = dims.factors(spark).withColumn(
        "Factor", (F.col("Factor") * F.coalesce(change[F.col("FactorID")], F.lit(1))).cast(facts_of.FACTOR)
    )
    fact = facts_of.with_emissions(facts_of.clean_fact(fixtures.raw_facts(spark, sf_dir)), "SourceFile")
    return _measured(factors.reprice(fact, library)).select(
        "SiteID", "ActivityType", "YearMonth", "FactorID", F.col("EmissionFactor").cast("double").alias("EmissionFactor"),
        F.col("EmissionFactorMarket").cast("double").alias("EmissionFactorMarket"), "tCO2e_Location", "tCO2e_Market",
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = facts_of.with_labels(facts_of.clean_fact(converted(spark, sf_dir)))
    return labelled.groupBy("Scope", "CategoryID", "CategoryName", "ScopeCategory").agg(F.count(F.lit(1)).alias("Rows"))


def _site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = sites(spark, sf_dir).filter("Employees % 20 = 5")
    return facts_of.with_site_names(facts_of.clean_fact(converted(spark, sf_dir)), known).groupBy("SiteID", "SiteName").agg(
        F.count(F.lit(1)).alias("Rows")
    )


def _slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = facts_of.slice_fact(inventory(spark, sf_dir), LOCATION_CFG)
    return sliced.groupBy("Scope", "CategoryID", "SiteName").agg(
        F.count(F.lit(1)).alias("Rows"), measure(F.sum(LOCATION_CFG.value_column)).alias("tCO2e")
    )


def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = fixtures.activity_rows(spark, sf_dir).select(F.col("Site").alias("SiteID"), "Scope", F.col("Activity").alias("ActivityType"))
    return decimals_as_double(facts_of.complete_schema(partial))


def _site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = sites(spark, sf_dir)
    fact = materialize(facts_of.slice_fact(facts_of.with_site_names(inventory(spark, sf_dir).drop("SiteName"), known), CFG), "inventory")
    return reports.site_table(fact, reports.years_present(fact), CFG, known)


def _marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_dir = new_path(spark, "inventory-run")
    return sinks.mart_rows(spark, run_dir, _write_marts(spark, sf_dir, run_dir))


def _write_marts(spark: SparkSession, sf_dir: str, run_dir: str, only: tuple[str, ...] | None = None) -> list[str]:
    fact = materialize(facts_of.slice_totals(inventory(spark, sf_dir)), "inventory-totals")
    sliced = facts_of.slice_fact(fact, CFG)
    return sinks.write_inventory_marts(fact, sliced, dims.factors(spark), drivers(spark, sf_dir), CFG, run_dir, only)


MARTS = ("by_scope", "by_category", "by_site", "targets", "findings")


def _mart(name: str) -> Query:
    """What a reader finds in one mart."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        run_dir = new_path(spark, "inventory-run")
        _write_marts(spark, sf_dir, run_dir, (name,))
        return spark.read.parquet(f"{run_dir}/{name}")

    return run


def _target_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = drivers(spark, sf_dir).select(F.explode(F.array(F.col("Year").cast("string"), F.lit("Total"), F.lit(""))).alias("Year"), "RevenueUSDm", "UnitsSold")
    return bundles.clean_target_years(raw)


# (facts, slice of the facts) -> report; ``once`` reports read the slice a single time and stay one lazy plan, the others read its totals.
ONCE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ghg_scope_year": lambda s: reports.scope_year(s, CFG),
    "ghg_month_scope": lambda s: reports.month_scope(s, CFG),
    "ghg_site_activity": lambda s: reports.site_activity(s, CFG),
    "ghg_scope2_month": reports.scope2_by_month,
    "ghg_scope1_month": lambda s: reports.scope1_by_month(s, CFG),
    "ghg_scope3_all_categories": lambda s: reports.scope3_all_categories(s, CFG),
    "ghg_category_status": lambda s: reports.category_status(s, dims.categories(s.sparkSession), CFG),
    "ghg_scope3_trend": lambda s: reports.scope3_trend(s, CFG),
    "ghg_actuals": lambda s: targets.actuals(s, CFG),
    "ghg_data_quality": lambda s: reports.data_quality(s, CFG),
    "ghg_method_share": lambda s: reports.method_share(s, CFG),
    "ghg_scope2_basis_gap": lambda s: reports.scope2_basis_gap(s, CFG),
    "ghg_sum_category": lambda s: reports.summary_by_category(s, CFG),
    "ghg_sum_site": lambda s: reports.summary_by_site(s, CFG),
    "ghg_base_year": lambda s: targets.base_year_totals(s, CFG),
    "ghg_target_path": lambda s: targets.target_path(s, CFG),
}
SHARED: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "ghg_slice_values": lambda f, s: reports.slice_values(f),
    "ghg_hierarchy": lambda f, s: reports.hierarchy(s, CFG),
    "ghg_pareto": lambda f, s: reports.pareto(s, CFG),
    "ghg_top10": lambda f, s: reports.top_activities(s, CFG),
    "ghg_yoy_by_category": lambda f, s: reports.yoy_by_category(s, CFG),
    "ghg_change_bridge": lambda f, s: reports.change_bridge(s, CFG),
    "ghg_target_vs_actual": lambda f, s: targets.target_vs_actual(f, s, CFG),
    "ghg_target_status": lambda f, s: targets.target_status(f, s, CFG),
    "ghg_target_band": lambda f, s: targets.target_band(f, s, CFG),
}
WITH_DRIVERS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "ghg_intensity": lambda f, s, d: reports.intensity(s, d, CFG),
    "ghg_kpis": lambda f, s, d: reports.kpis(s, d, CFG),
    "ghg_findings": lambda f, s, d: reports.findings(f, s, d, CFG),
}


def _once(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(facts_of.slice_fact(inventory(spark, sf_dir), CFG))


def _shared(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = materialize(facts_of.slice_totals(inventory(spark, sf_dir)), "inventory-totals")
        return build(fact, facts_of.slice_fact(fact, CFG))

    return run


def _driven(build: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = materialize(facts_of.slice_totals(inventory(spark, sf_dir)), "inventory-totals")
        return build(fact, facts_of.slice_fact(fact, CFG), drivers(spark, sf_dir))

    return run


def carbon_queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "ghg_fact_schema": _schema,
        "ghg_fact_clean": _clean,
        "ghg_emissions": _emissions,
        "ghg_labels": _labels,
        "ghg_site_names": _site_names,
        "ghg_slice": _slice,
        "ghg_resolve_factors": _resolved,
        "ghg_resolve_factors_region": _resolved_by_region,
        "ghg_unmatched": lambda spark, sf_dir: factors.unmatched_activities(
            factors.resolve_factors(activity(spark, sf_dir), dims.factors(spark))
        ),
        "ghg_activity_to_fact": lambda spark, sf_dir: fact_view(converted(spark, sf_dir)),
        "ghg_activity_to_fact_supplied": lambda spark, sf_dir: fact_view(converted(spark, sf_dir, supplied=True)),
        "ghg_reprice": _repriced,
        "ghg_site_table": _site_table,
        "ghg_target_years": _target_years,
        "snk_inventory_marts": _marts,
    }
    out.update({f"snk_inventory_{name}": _mart(name) for name in MARTS})
    out.update({n: _once(b) for n, b in ONCE.items()})
    out.update({n: _shared(b) for n, b in SHARED.items()})
    out.update({n: _driven(b) for n, b in WITH_DRIVERS.items()})
    return out
