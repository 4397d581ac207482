"""Named-table bundles and dimensions: one folder per run, one table per name, explicit schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerleaf import dims
from ledgerleaf.functions.columns import text_or_null

# Bundle table names.
LEDGER_TABLES = ("FactJournalLines", "DimAccount")
CARBON_TABLES = ("FactEmissions", "DimEmissionFactor", "Targets", "DimSite", "DimScopeCategory")

DIMENSION_SCHEMAS = {
    "DimAccount": dims.CHART_SCHEMA,
    "DimEmissionFactor": dims.FACTOR_SCHEMA,
    "Targets": dims.TARGET_SCHEMA.replace("Year int", "Year string"),
    "DimSite": dims.SITE_SCHEMA,
    "DimScopeCategory": dims.CATEGORY_SCHEMA,
}

#: Columns without which a dimension can't be used; of the others it is the first.
REQUIRED = {"DimAccount": ("AccountNo", "AccountClass", "AccountGroup")}


def read_dimension(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A dimension from CSV, its columns found by heading, in any order.

    Values are read as text and cast (inferred types would turn category 3.10 into 3.1). A missing column is null, but
    a missing required one is an error; other columns are left out.
    """
    raw = spark.read.csv(path, header=True, escape='"')
    found = {c.strip("\ufeff \t"): c for c in raw.columns}
    wanted = StructType.fromDDL(DIMENSION_SCHEMAS[name]).fields
    missing = [c for c in REQUIRED.get(name, (wanted[0].name,)) if c not in found]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)} of {name}")
    table = raw.select(*[(raw[f"`{found[f.name]}`"] if f.name in found else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted])
    # The order of a factor library decides which of its rows a name resolves to.
    return table.withColumn("lib_no", F.monotonically_increasing_id()) if name == "DimEmissionFactor" else table


def clean_target_years(df: DataFrame) -> DataFrame:
    """Target rows with a numeric year only."""
    year = text_or_null(F.col("Year").cast("string")).try_cast("double").try_cast("int")
    return df.withColumn("Year", year).filter(F.col("Year").isNotNull())


@dataclass(frozen=True)
class Bundle:
    """Tables of a run; an absent dimension is None, and factors and categories fall back to the defaults."""

    fact: DataFrame
    accounts: DataFrame | None = None
    factors: DataFrame | None = None
    targets: DataFrame | None = None
    sites: DataFrame | None = None
    categories: DataFrame | None = None


def _dimension(spark: SparkSession, folder: str, name: str, present: set[str]) -> DataFrame | None:
    return read_dimension(spark, f"{folder}/{name}", name) if name in present else None


def open_ledger_bundle(spark: SparkSession, folder: str, present: set[str]) -> Bundle:
    """``present`` names the tables in the folder; the journal lines are Parquet, the chart CSV."""
    return Bundle(spark.read.parquet(f"{folder}/FactJournalLines"), accounts=_dimension(spark, folder, "DimAccount", present))


def open_carbon_bundle(spark: SparkSession, folder: str, present: set[str]) -> Bundle:
    given = _dimension(spark, folder, "DimEmissionFactor", present)
    categories = _dimension(spark, folder, "DimScopeCategory", present)
    targets = _dimension(spark, folder, "Targets", present)
    return Bundle(
        spark.read.parquet(f"{folder}/FactEmissions"),
        factors=given if given is not None else dims.factors(spark),
        targets=clean_target_years(targets) if targets is not None else None,
        sites=_dimension(spark, folder, "DimSite", present),
        categories=categories if categories is not None else dims.categories(spark),
    )
