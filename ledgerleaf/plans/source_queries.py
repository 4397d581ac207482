"""Queries over untidy exports: scan, headings, mapping and canonical lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import dims, fixtures, untidy
from ledgerleaf.functions.columns import decimals_as_double, text_or_null
from ledgerleaf.operators.carbon import factors
from ledgerleaf.operators.ledger import canonical
from ledgerleaf.operators.ledger.postings import roll_up
from ledgerleaf.plans.carbon_queries import fact_view, inventory, sites
from ledgerleaf.plans.ledger_book import LedgerBook
from ledgerleaf.settings import LedgerSettings
from ledgerleaf.sources import bundles, exports
from ledgerleaf.store import new_path, packed_table

Query = Callable[[SparkSession, str], DataFrame]


def _named(df: DataFrame) -> DataFrame:
    """Files by the name of their source instead of their path."""
    return df.withColumn("SourceFile", F.regexp_extract("SourceFile", "SourceFile=([^/]+)/", 1))


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the exports and scan them back."""
    folder = new_path(spark, "exports")
    untidy.write_exports(spark, sf_dir, folder)
    return exports.scan_exports(spark, folder)


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the exports with its cells."""
    cells = F.array_join(F.transform("Cells", lambda c: F.coalesce(c, F.lit(""))), "|")
    return _named(_scan(spark, sf_dir)).select("SourceFile", "LineNo", "Separator", cells.alias("Record"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(exports.headings(_scan(spark, sf_dir)))


def _journal_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lines of journal files, from the scan on: headings, mapping, the side of amounts by file."""
    folder = new_path(spark, "journal-files")
    untidy.write_journal_files(spark, sf_dir, folder)
    cells = exports.scan_exports(spark, folder)
    heads = exports.headings(cells)
    return _named(canonical.to_canonical(exports.mapped_rows(exports.data_rows(cells, heads), exports.column_map(heads))))


def _postings_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = packed_table(_journal_of_files(spark, sf_dir), "file-lines")
    book = LedgerBook(lines, dims.chart(spark), cfg=LedgerSettings(line_order="struct(SourceFile, LineNo)"))
    return book.postings_plan.select(
        "PostingID", "PostingType", "PostingDate", "DocumentDate", "EnteredDateTime", "Counterparty", "LineCount", "Debits", "Credits", "IsBalanced", "LagDays"
    )


def _facts_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission facts of activity files, from the scan on."""
    folder = new_path(spark, "activity-files")
    untidy.write_activity_files(spark, sf_dir, folder)
    cells = exports.scan_exports(spark, folder)
    heads = exports.headings(cells)
    rows = exports.mapped_activity(exports.data_rows(cells, heads), exports.activity_map(heads))
    mapping = {f: f for f in exports.ACTIVITY_WORDS}
    return fact_view(factors.activity_to_fact(factors.activity_columns(rows, mapping), dims.factors(spark)))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _heads(spark, sf_dir)
    ledger, carbon = exports.column_map(heads), exports.activity_map(heads)
    mode = lambda df, name: df.withColumn("Mode", F.lit(name))
    return (
        mode(exports.mapping_gaps(heads, ledger, signed=False), "split")
        .unionByName(mode(exports.mapping_gaps(heads, ledger, signed=True), "signed"))
        .unionByName(mode(exports.mapping_gaps(heads, ledger), "by file"))
        .unionByName(mode(exports.mapping_gaps(heads, carbon, carbon=True), "activity"))
    )


def _column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _heads(spark, sf_dir)
    kind = lambda df, name: df.withColumn("Domain", F.lit(name))
    return kind(exports.column_map(heads), "ledger").unionByName(kind(exports.activity_map(heads), "carbon"))


def _parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.parse_dates(untidy.untidy_journal(spark, sf_dir))


def _parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = untidy.untidy_journal(spark, sf_dir)
    return canonical.parse_amounts(raw).select("SourceFile", "LineNo", "Debit", "Credit")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = untidy.untidy_journal(spark, sf_dir)
    return canonical.parse_amounts(raw, signed=True).select("SourceFile", "LineNo", "Debit", "Credit")


def _text_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = untidy.untidy_journal(spark, sf_dir)
    return raw.select("SourceFile", "LineNo", *[text_or_null(F.col(c)).alias(c) for c in ("PostingID", "UserID", "Counterparty", "RefPostingID")])


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.to_canonical(untidy.untidy_journal(spark, sf_dir))


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _canonical(spark, sf_dir)
    return lines.groupBy("SourceFile").agg(
        F.count_if(F.col("AccountNo").eqNullSafe(F.col("AccountName"))).alias("SameAccount"), F.count("AccountNo").alias("Numbers"),
        F.count("AccountName").alias("Names"),
    )


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).groupBy("SourceFile").agg(
        F.count(F.lit(1)).alias("Lines"), F.count_if(F.col("AccountName").isNull()).alias("NoAccount")
    )


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = packed_table(_canonical(spark, sf_dir), "canonical-lines")
    numbered = canonical.first_appearance_ids(kept)
    return kept.join(numbered, ["SourceFile", "PostingID"]).groupBy("SourceFile", "PostingID", "NumberedID").agg(F.count(F.lit(1)).alias("Lines"))


def _ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).select("SourceFile", "LineNo", "PostingID")


def _unroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = canonical.report_to_canonical(untidy.report_rows(spark, sf_dir))
    return lines.select("SourceFile", "LineNo", "PostingID", "PostingDate", "AccountName", "Debit", "Credit", "Counterparty")


def _bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a ledger and a carbon bundle, open them, and roll both up."""
    folder = new_path(spark, "bundle")
    fixtures.journal_lines(spark, sf_dir).write.parquet(f"{folder}/FactJournalLines")
    dims.chart(spark).write.csv(f"{folder}/DimAccount", header=True)
    inventory(spark, sf_dir).write.parquet(f"{folder}/FactEmissions")
    ledger = bundles.open_ledger_bundle(spark, folder, {"FactJournalLines", "DimAccount"})
    carbon = bundles.open_carbon_bundle(spark, folder, {"FactEmissions"})
    book = LedgerBook(ledger.fact, ledger.accounts)
    row = lambda name, df: df.agg(F.count(F.lit(1)).alias("Rows")).select(F.lit(name).alias("Item"), "Rows")
    return (
        row("charted accounts", book.accounts.filter("Source = 'chart of accounts'"))
        .unionByName(row("postings", roll_up(book.lines.join(book.accounts.select("AccountNo", "AccountClass", "AccountGroup", "IsLiquid"), "AccountNo", "left"), LedgerSettings())))
        .unionByName(row("facts with a default factor", carbon.fact.join(carbon.factors, "FactorID", "left_semi")))
    )


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site and category dimensions through CSV: ids stay text."""
    folder = new_path(spark, "dimensions")
    derived = sites(spark, sf_dir).withColumns(
        {"FloorAreaM2": F.col("Employees") * 20, "GridFactorLocation": F.lit(0.5), "MarketInstrument": F.lit(None).cast("string")}
    )
    columns = [part.split(" ")[0] for part in dims.SITE_SCHEMA.split(", ")]
    derived.select(*columns).write.csv(f"{folder}/DimSite", header=True)
    used = inventory(spark, sf_dir).select("CategoryID", "Scope").distinct().join(dims.categories(spark).drop("Scope"), "CategoryID", "left")
    used.select("CategoryID", "Scope", "CategoryName", "MethodOrReason", "Status").write.csv(f"{folder}/DimScopeCategory", header=True)
    site, category = (bundles.read_dimension(spark, f"{folder}/{n}", n) for n in ("DimSite", "DimScopeCategory"))
    return site.select(F.lit("DimSite").alias("Table"), F.col("SiteID").alias("ID"), F.col("SiteName").alias("Name")).unionByName(
        category.select(F.lit("DimScopeCategory").alias("Table"), F.col("CategoryID").alias("ID"), F.col("CategoryName").alias("Name"))
    )


def source_queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "src_exports": _exports,
        "src_header_rows": lambda spark, sf_dir: _named(exports.header_rows(_scan(spark, sf_dir))),
        "src_layout": lambda spark, sf_dir: exports.layouts(_heads(spark, sf_dir)),
        "src_column_map": _column_map,
        "src_mapping_gaps": _gaps,
        "src_bundle": _bundle,
        "src_dimensions": _dimensions,
        "gl_canonical_lines": _canonical,
        "gl_parse_amount": _parse_amount,
        "gl_signed_split": _signed,
        "gl_parse_dates": _parse_dates,
        "gl_text_nulls": _text_nulls,
        "gl_account_fallback": _fallback,
        "gl_noise_filter": _noise,
        "gl_synthetic_ids": _synthetic,
        "gl_ffill_ids": _ffill,
        "gl_report_unroll": _unroll,
        "gl_amount_suspects": lambda spark, sf_dir: canonical.suspect_amounts(untidy.suspect_rows(spark, sf_dir)),
        "gl_unread_dates": lambda spark, sf_dir: canonical.unread_dates(untidy.untidy_journal(spark, sf_dir)),
        "gl_lines_from_files": _journal_of_files,
        "gl_postings_from_files": _postings_of_files,
        "ghg_facts_from_files": _facts_of_files,
    }
    return {name: (lambda q: lambda spark, sf_dir: decimals_as_double(q(spark, sf_dir)))(q) for name, q in out.items()}
