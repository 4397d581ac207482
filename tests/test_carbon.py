"""The example year (84 rows): totals worked out by hand from the factor library."""

from pyspark.sql import functions as F

from ledgerleaf import dims
from ledgerleaf.operators.carbon.fact import clean_fact, normalise_fact
from ledgerleaf.operators.carbon.factors import activity_columns, activity_to_fact, reprice

# One month of example activity.
MONTH = (
    ("Main plant", "Scope 1", None, "Natural gas (stationary)", "120000", "kWh"),
    ("Main plant", "Scope 1", None, "Diesel (mobile & stationary)", "4000", "litre"),
    ("Main plant", "Scope 2", None, "Purchased electricity", "450000", "kWh"),
    ("Head office", "Scope 3", "3.6", "Air travel short-haul economy", "30000", "passenger-km"),
    ("Main plant", "Scope 3", "3.5", "Waste to landfill (mixed)", "12", "tonne"),
    ("Main plant", "Scope 3", "3.1", "Steel and iron castings (spend)", "400000", "USD"),
    ("Main plant", "Scope 1", None, "Refrigerant leakage", "5", "kg"),
)
MAPPING = {"Date": "Month", "Site": "Facility", "Scope": "Scope", "Category": "Category", "ActivityType": "Activity", "Quantity": "Consumption", "Unit": "Unit"}


def example(spark):
    rows = tuple((f"2025-{m:02d}-01", *r) for m in range(1, 13) for r in MONTH)
    raw = dims.inline_table(spark, rows, "Month string, Facility string, Scope string, Category string, Activity string, Consumption string, Unit string")
    return normalise_fact(activity_to_fact(activity_columns(raw, MAPPING), dims.factors(spark)))


def test_example_year(spark):
    fact = example(spark)
    by = {r.Scope: float(r.t) for r in fact.groupBy("Scope").agg(F.sum("tCO2e_Market").alias("t")).collect()}
    assert {k: round(v, 2) for k, v in by.items()} == {"Scope 1": 509.28, "Scope 2": 2700.0, "Scope 3": 4200.6}
    assert round(sum(by.values()), 2) == 7409.88
    assert {r.CategoryID for r in fact.select("CategoryID").distinct().collect()} == {"1", "2", "3.1", "3.5", "3.6"}


def test_repricing_with_the_same_factors_changes_nothing(spark):
    fact = example(spark)
    total = lambda df: df.agg(F.sum("tCO2e_Location"), F.sum("tCO2e_Market")).first()[:]
    assert total(reprice(fact, dims.factors(spark))) == total(fact)


def test_ids_and_scores(spark):
    rows = (("1.0", "SCOPE 1", "9"), ("3.10", "scope3", None), ("3.1", "Scope 3", "2.9"))
    raw = dims.inline_table(spark, rows, "CategoryID string, Scope string, DataQualityScore string")
    got = [(r.CategoryID, r.Scope, r.DataQualityScore) for r in clean_fact(raw).collect()]
    assert sorted(got) == [("1", "Scope 1", 5), ("3.1", "Scope 3", 2), ("3.10", "Scope 3", 3)]
