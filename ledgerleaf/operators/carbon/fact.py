"""Emission facts: schema, cleansing, emissions, labels, slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import dims
from ledgerleaf.functions.columns import text_or_null, with_dates, year_month
from ledgerleaf.settings import CarbonSettings
from ledgerleaf.store import materialize

QUANTITY = "decimal(18,4)"
FACTOR = "decimal(18,6)"
EMISSION = "decimal(28,10)"

FACT_TYPES = {
    "Date": "timestamp_ntz", "SiteID": "string", "Scope": "string", "CategoryID": "string", "ActivityType": "string",
    "Quantity": QUANTITY, "Unit": "string", "FactorID": "string", "EmissionFactor": FACTOR, "EmissionFactorMarket": FACTOR,
    "FactorUnit": "string", "Method": "string", "DataSource": "string", "DataQualityScore": "int", "tCO2e_Location": EMISSION,
    "tCO2e_Market": EMISSION, "Note": "string",
}


def complete_schema(df: DataFrame) -> DataFrame:
    """All fact columns in order, missing ones null; further columns stay behind them."""
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in FACT_TYPES.items()]
    return df.select(*cols, *[c for c in df.columns if c not in FACT_TYPES])


def _number(c: str, kind: str) -> Column:
    return F.col(c).try_cast(kind)


def clean_fact(df: DataFrame) -> DataFrame:
    """Typed facts from text: ids, scope spelling, numbers, score and method."""
    full = complete_schema(df)
    columns, timed = full.columns, dict(full.dtypes)["Date"].startswith("timestamp")
    full = full if timed else with_dates(full, {"_at": F.col("Date").cast("string")}, day_first=False)
    given = F.nanvl(_number("DataQualityScore", "double"), F.lit(None).cast("double"))
    score = F.least(F.greatest(F.coalesce(given, F.lit(3.0)), F.lit(1.0)), F.lit(5.0))
    out = {
        "Date": F.col("Date") if timed else F.col("_at_month"),
        "CategoryID": F.regexp_replace(text_or_null(F.col("CategoryID")), r"^(\d+)\.0$", "$1"),
        "Scope": F.regexp_replace(F.trim("Scope"), r"(?i)^scope\s*", "Scope "),
        "Quantity": F.coalesce(_number("Quantity", QUANTITY), F.lit(0).cast(QUANTITY)),
        "EmissionFactor": _number("EmissionFactor", FACTOR),
        "EmissionFactorMarket": F.coalesce(_number("EmissionFactorMarket", FACTOR), _number("EmissionFactor", FACTOR)),
        "tCO2e_Location": _number("tCO2e_Location", EMISSION),
        "tCO2e_Market": _number("tCO2e_Market", EMISSION),
        "DataQualityScore": score.cast("int"),
        "Method": F.coalesce("Method", F.lit("Unspecified")),
    }
    return full.withColumns(out).select(*columns).withColumns({"Year": F.year("Date"), "YearMonth": year_month(F.col("Date"))})


def tonnes(quantity: Column, factor: Column) -> Column:
    """Quantity x factor (kg per unit) in tonnes, exact to ten places."""
    return ((quantity * factor).cast(EMISSION) * F.lit("0.001").cast("decimal(4,3)")).cast(EMISSION)


def with_emissions(fact: DataFrame, source: str | None = None) -> DataFrame:
    """Fill emissions. A whole source without any supplied value is computed, else the supplied values stand.

    The gate is one row per source, written first so that its real size decides how it is joined.
    """
    missing_loc, missing_mkt = F.lit(True), F.lit(True)
    if source is not None:
        gate = materialize(
            fact.groupBy(source).agg(
                (F.count("tCO2e_Location") == 0).alias("_no_loc"), (F.count("tCO2e_Market") == 0).alias("_no_mkt")
            ),
            "emission-gate",
        )
        fact = fact.join(gate, source, "left")
        missing_loc, missing_mkt = F.col("_no_loc"), F.col("_no_mkt")
    location = F.when(missing_loc, tonnes(F.col("Quantity"), F.col("EmissionFactor"))).otherwise(F.col("tCO2e_Location"))
    market = F.when(missing_mkt, tonnes(F.col("Quantity"), F.col("EmissionFactorMarket"))).otherwise(F.col("tCO2e_Market"))
    return (
        fact.withColumn("tCO2e_Location", location)
        .withColumn("tCO2e_Market", F.coalesce(market, F.col("tCO2e_Location")))
        .withColumn("DQ_Weighted", (F.col("DataQualityScore") * F.col("tCO2e_Location")).cast(EMISSION))
        .drop("_no_loc", "_no_mkt")
    )


def scope_label(category: Column, name: Column) -> Column:
    return F.concat(F.lit("Cat "), F.substring(category, 3, 10), F.lit(" · "), name)


def with_labels(fact: DataFrame) -> DataFrame:
    """Category name and scope label; a name in the facts counts only where the category is unknown."""
    names = dims.category_names(fact.sparkSession).withColumnRenamed("CategoryName", "_known")
    given = F.col("CategoryName") if "CategoryName" in fact.columns else F.lit(None).cast("string")
    joined = fact.join(names, "CategoryID", "left").withColumn("CategoryName", F.coalesce("_known", given)).drop("_known")
    label = F.when(F.col("Scope") == "Scope 3", scope_label(F.col("CategoryID"), F.col("CategoryName"))).otherwise(F.col("Scope"))
    return joined.withColumn("ScopeCategory", label)


def with_site_names(fact: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    given = F.col("SiteName") if "SiteName" in fact.columns else F.lit(None).cast("string")
    if sites is None:
        return fact.withColumn("SiteName", F.coalesce(given, F.col("SiteID")))
    lookup = sites.groupBy("SiteID").agg(F.min("SiteName").alias("_site"))
    return fact.join(lookup, "SiteID", "left").withColumn("SiteName", F.coalesce("_site", "SiteID")).drop("_site")


def normalise_fact(df: DataFrame, sites: DataFrame | None = None, source: str | None = None) -> DataFrame:
    return with_site_names(with_labels(with_emissions(clean_fact(df), source)), sites)


def slice_fact(fact: DataFrame, cfg: CarbonSettings) -> DataFrame:
    out = fact.filter(F.col("Scope").isin(*cfg.scopes))
    if cfg.sites is not None:
        out = out.filter(F.col("SiteName").isin(*cfg.sites))
    if not cfg.include_use_phase:
        out = out.filter(~F.col("CategoryID").eqNullSafe("3.11"))
    return out


def slice_totals(fact: DataFrame) -> DataFrame:
    """Sums of the three measures by all labels that yearly reports ask for; exact, so reports read it in place of the facts.

    One scan of the facts, combined before the shuffle. What is left has no months, quantities or factors.
    """
    labels = ["Year", "Scope", "CategoryID", "ScopeCategory", "ActivityType", "SiteName", "Method"]
    measures = ("tCO2e_Location", "tCO2e_Market", "DQ_Weighted")
    return fact.groupBy(*labels).agg(*[F.sum(c).cast(EMISSION).alias(c) for c in measures])
