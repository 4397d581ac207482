"""Emission factors: resolution, activity to facts, re-pricing.

Everything joins the factor library, whose size is known to Catalyst; the activity rows are never shuffled. The
"library name contains the first 12 characters" rule is an equality join on the library's substrings, not a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import dims
from ledgerleaf.functions.columns import text_or_null, with_dates
from ledgerleaf.operators.carbon.fact import EMISSION, FACTOR, QUANTITY, complete_schema, tonnes

PROBE_LENGTH = 12
DEFAULT_SCORE = 3


def library_key(c: Column) -> Column:
    return F.trim(F.lower(c))


def exact_lookup(library: DataFrame) -> DataFrame:
    """Library name -> first library row."""
    return library.groupBy(library_key(F.col("ActivityType")).alias("_exact_key")).agg(F.min("lib_no").alias("_exact_no"))


def probe_lookup(library: DataFrame) -> DataFrame:
    """Every substring of up to 12 characters of a library name -> first library row that contains it."""
    keys = library.select("lib_no", library_key(F.col("ActivityType")).alias("key"))
    starts = keys.select("lib_no", "key", F.explode(F.expr("sequence(1, greatest(length(key), 1))")).alias("at"))
    grams = starts.select("lib_no", "key", "at", F.explode(F.sequence(F.lit(0), F.lit(PROBE_LENGTH))).alias("n"))
    return (
        grams.select("lib_no", F.expr("substring(key, at, n)").alias("_probe_key"))
        .groupBy("_probe_key")
        .agg(F.min("lib_no").alias("_probe_no"))
    )


def resolve_factors(
    activity: DataFrame,
    library: DataFrame,
    choices: DataFrame | None = None,
    sites: DataFrame | None = None,
    match: str = "first",
) -> DataFrame:
    """Adds ``lib_no`` and ``MatchedBy`` to rows with ``ActivityType``: a chosen factor, else the exact name, else the probe.

    ``match="first"`` takes the first library row of a name. ``match="region"`` prefers the row of the site's grid region.
    """
    library = library.select("lib_no", "FactorID", "ActivityType", "Region")
    activity = activity.drop("lib_no")
    text = F.lower("ActivityType")
    probe = F.substring(text, 1, PROBE_LENGTH)
    out = (
        activity.join(exact_lookup(library), text == F.col("_exact_key"), "left")
        .join(probe_lookup(library), probe == F.col("_probe_key"), "left")
    )
    chosen = F.lit(None).cast("int")
    if choices is not None:
        picks = choices.join(library.select("FactorID", F.col("lib_no").alias("_choice_no")), "FactorID")
        picks = picks.groupBy(F.col("ActivityType").alias("_choice_key")).agg(F.min("_choice_no").alias("_choice_no"))
        out = out.join(picks, F.col("ActivityType") == F.col("_choice_key"), "left")
        chosen = F.col("_choice_no")
    regional = F.lit(None).cast("int")
    if match == "region":
        grid = sites.select(F.col("SiteID").alias("_site"), F.col("GridRegion").alias("_region")).dropDuplicates(["_site"])
        by_region = library.groupBy(library_key(F.col("ActivityType")).alias("_rk"), F.col("Region").alias("_rr")).agg(
            F.min("lib_no").alias("_region_no")
        )
        out = out.join(grid, F.col("SiteID") == F.col("_site"), "left").join(
            by_region, (text == F.col("_rk")) & (F.col("_region") == F.col("_rr")), "left"
        )
        regional = F.col("_region_no")
    how = (
        F.when(chosen.isNotNull(), "choice").when(F.coalesce(regional, F.col("_exact_no")).isNotNull(), "exact")
        .when(F.col("_probe_no").isNotNull(), "prefix")
    )
    return out.select(
        *activity.columns, F.coalesce(chosen, regional, F.col("_exact_no"), F.col("_probe_no")).alias("lib_no"), how.alias("MatchedBy")
    )


def unmatched_activities(resolved: DataFrame) -> DataFrame:
    """Activity names that have neither a library row nor a supplied factor."""
    needs = F.col("lib_no").isNull() & F.col("EmissionFactor").isNull()
    return resolved.filter(needs).groupBy("ActivityType").agg(F.count(F.lit(1)).alias("Rows"))


def activity_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Mapped text columns as typed activity rows. ``mapping``: field -> column of the file."""

    def text(field: str) -> Column:
        return text_or_null(F.col(mapping[field])) if mapping.get(field) else F.lit(None).cast("string")

    mapped = {v for v in mapping.values() if v}
    return with_dates(df, {"_at": F.col(mapping["Date"])}, day_first=False).select(
        F.col("_at_month").alias("Date"),
        (text("Site") if mapping.get("Site") else F.lit("Site")).alias("SiteID"),
        text("Scope").alias("Scope"),
        text("Category").alias("CategoryID"),
        text("ActivityType").alias("ActivityType"),
        F.col(mapping["Quantity"]).try_cast(QUANTITY).alias("Quantity"),
        text("Unit").alias("Unit"),
        text("Factor").try_cast(FACTOR).alias("EmissionFactor"),
        *[c for c in df.columns if c not in mapped],
    )


def activity_to_fact(
    activity: DataFrame, library: DataFrame, choices: DataFrame | None = None, sites: DataFrame | None = None, match: str = "first"
) -> DataFrame:
    """Activity rows as emission facts; rows without any factor drop out."""
    scores = dims.method_scores(activity.sparkSession)
    lib = library.select(
        "lib_no", F.col("FactorID").alias("_id"), F.col("Factor").alias("_factor"), F.col("FactorUnit").alias("_unit"),
        F.col("Method").alias("_method"), F.col("CategoryID").alias("_category"),
    )
    own = F.col("EmissionFactor").isNotNull()
    fact = (
        resolve_factors(activity, library, choices, sites, match)
        .join(lib, "lib_no", "left")
        .withColumns(
            {
                "FactorID": F.when(~own, F.col("_id")),
                "FactorUnit": F.when(~own, F.col("_unit")),
                "Method": F.when(~own, F.col("_method")),
                "CategoryID": F.when(own, F.col("CategoryID")).otherwise(F.coalesce("CategoryID", "_category")),
                "EmissionFactor": F.coalesce("EmissionFactor", "_factor"),
            }
        )
        .filter(F.col("EmissionFactor").isNotNull())
        .join(scores, "Method", "left")
        .withColumn("DataQualityScore", F.coalesce("Score", F.lit(DEFAULT_SCORE)))
        .drop("_id", "_factor", "_unit", "_method", "_category", "Score", "lib_no", "MatchedBy")
    )
    return complete_schema(fact)


def rejected_factors(library: DataFrame) -> DataFrame:
    """Factor ids that occur more than once; re-pricing uses their first row."""
    return library.groupBy("FactorID").agg(F.count(F.lit(1)).alias("Rows")).filter("Rows > 1")


def reprice(fact: DataFrame, library: DataFrame, strict_recompute: bool = False) -> DataFrame:
    """New factors by id; the market factor keeps its ratio to the location factor.

    Emissions are recomputed where a factor is known; ``strict_recompute`` also blanks the rows without one.
    """
    new = library.groupBy("FactorID").agg(F.min_by("Factor", "lib_no").alias("_new"))
    known = F.col("_new").isNotNull() & F.col("EmissionFactor").isNotNull()
    market_ratio = F.when(
        F.col("EmissionFactor") > 0,
        F.coalesce(F.try_divide(F.col("EmissionFactorMarket"), F.col("EmissionFactor")).cast("decimal(18,10)"), F.lit(1).cast("decimal(18,10)")),
    ).otherwise(F.lit(1).cast("decimal(18,10)"))
    priced = (
        fact.join(new, "FactorID", "left")
        .withColumn("_ratio", market_ratio)
        .withColumns(
            {
                "EmissionFactorMarket": F.when(known, (F.col("_new") * F.col("_ratio")).cast(FACTOR)).otherwise(
                    F.col("EmissionFactorMarket")
                ),
                "EmissionFactor": F.when(known, F.col("_new")).otherwise(F.col("EmissionFactor")),
            }
        )
    )
    location = tonnes(F.col("Quantity"), F.col("EmissionFactor"))
    market = tonnes(F.col("Quantity"), F.col("EmissionFactorMarket"))
    if not strict_recompute:
        location, market = F.coalesce(location, "tCO2e_Location"), F.coalesce(market, "tCO2e_Market")
    return (
        priced.withColumns({"tCO2e_Location": location, "tCO2e_Market": market})
        .withColumn("DQ_Weighted", (F.col("DataQualityScore") * F.col("tCO2e_Location")).cast(EMISSION))
        .drop("_new", "_ratio")
    )
