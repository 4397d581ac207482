"""Summary sinks: one table per mart under a run directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators.carbon.targets import target_vs_actual
from ledgerleaf.plans import carbon_reports as inventory
from ledgerleaf.plans import ledger_reports as reports
from ledgerleaf.plans.ledger_book import LedgerBook
from ledgerleaf.settings import CarbonSettings


def write_mart(df: DataFrame, run_dir: str, name: str, by: str | None = None) -> None:
    """Parquet, detail marts by ``by``. The rebalance splits a large partition value over several evenly sized files."""
    target = f"{run_dir}/{name}"
    if by is None:
        df.write.mode("overwrite").parquet(target)
    else:
        df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(target)


def mart_rows(spark: SparkSession, run_dir: str, names: list[str]) -> DataFrame:
    """Row count of each written mart, from the Parquet footers."""
    out = None
    for name in names:
        row = spark.read.parquet(f"{run_dir}/{name}").agg(F.count(F.lit(1)).alias("Rows")).select(F.lit(name).alias("Mart"), "Rows")
        out = row if out is None else out.unionByName(row)
    return out


def write_ledger_marts(book: LedgerBook, run_dir: str, only: tuple[str, ...] | None = None) -> list[str]:
    """By year, preparer and month, flags, settlements, accounts and quality, or some of them. Shared inputs are computed once."""
    year = F.year("PostingDate").alias("Year")
    if only is None:
        book.write_lines()
    marts: dict[str, tuple[Callable[[], DataFrame | None], str | None]] = {
        "by_year": (lambda: reports.summary_by_year(book.postings), None),
        "by_preparer": (lambda: reports.summary_by_preparer(book.postings, book.flags), None),
        "by_month": (lambda: reports.summary_by_month(book.postings), None),
        "flags": (lambda: book.flags.select("*", year), "Year"),
        "accounts": (lambda: book.accounts, None),
        "data_quality": (lambda: book.quality, None),
        "settlements": (lambda: None if book.settlements is None else book.settlements.drop("TouchesCash").select("*", year), "Year"),
    }
    written = []
    for name, (build, by) in marts.items():
        df = build() if only is None or name in only else None
        if df is not None:
            write_mart(df, run_dir, name, by)
            written.append(name)
    return written


def write_flag_extract(flags: DataFrame, path: str, tests: tuple[str, ...] | None = None) -> None:
    """The chosen tests as CSV in test and amount order. The sort is a range partitioning, so the files are in order too."""
    reports.flag_extract(flags, tests).write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)


FLAG_EXTRACT_SCHEMA = (
    "PostingID string, PostingDate timestamp_ntz, PostingType string, UserID string, PostingAmount decimal(18,2), Test string, Detail string"
)


def write_inventory_marts(
    facts: DataFrame, sliced: DataFrame, factors: DataFrame, drivers: DataFrame, cfg: CarbonSettings, run_dir: str, only: tuple[str, ...] | None = None
) -> list[str]:
    """By scope, category and site, targets, the factors used and the findings, or some of them."""
    marts: dict[str, Callable[[], DataFrame]] = {
        "by_scope": lambda: inventory.scope_year(sliced, cfg),
        "by_category": lambda: inventory.summary_by_category(sliced, cfg),
        "by_site": lambda: inventory.summary_by_site(sliced, cfg),
        "targets": lambda: target_vs_actual(facts, sliced, cfg),
        "factors_used": lambda: factors,
        "findings": lambda: inventory.findings(facts, sliced, drivers, cfg),
    }
    names = [name for name in marts if only is None or name in only]
    for name in names:
        df = marts[name]()
        # Parquet columns may hold any name, but not blanks in older readers.
        write_mart(df.toDF(*[c.replace(" ", "") for c in df.columns]), run_dir, name)
    return names
