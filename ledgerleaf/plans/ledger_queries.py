"""The ledger queries over the derived journal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import dims, fixtures
from ledgerleaf.functions.columns import MONEY_LINE, decimals_as_double
from ledgerleaf.operators.ledger import accounts as acc
from ledgerleaf.operators.ledger import checks, postings, quality, settlement
from ledgerleaf.plans import ledger_reports as reports
from ledgerleaf.plans.ledger_book import LedgerBook
from ledgerleaf.sources import sinks
from ledgerleaf.store import new_path

Query = Callable[[SparkSession, str], DataFrame]

OVERRIDES = (("4600", "Asset", "Cash & bank"), ("9990", "Equity", "Equity"))
SLICE = dict(
    start="1996-01-01",
    end="1999-12-31",
    types=("Sales invoice", "Purchase invoice", "Customer receipt", "Operating expense"),
    users=("U1", "U2", "U3"),
)
EXTRACT_TESTS = (checks.UNBALANCED, checks.DUPLICATE, checks.VERY_LATE)


def book_of(spark: SparkSession, sf_dir: str, chart: bool = True, overrides: DataFrame | None = None) -> LedgerBook:
    return LedgerBook(fixtures.journal_lines(spark, sf_dir), dims.chart(spark) if chart else None, overrides)


def _sliced(df: DataFrame) -> DataFrame:
    return postings.slice_postings(df, **SLICE)


def _overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = dims.inline_table(spark, OVERRIDES, "AccountNo string, AccountClass string, AccountGroup string")
    return book_of(spark, sf_dir, overrides=edits).accounts


def _row_test(name: str) -> Callable[[LedgerBook], DataFrame]:
    return lambda b: checks.row_test_flags(b.postings_plan, b.cfg, name)


def _slice_columns(df: DataFrame) -> DataFrame:
    return df.select("PostingID", "PostingDate", "PostingType", "UserID", "PostingAmount")


def _exact(b: LedgerBook) -> DataFrame:
    return b.settlements_by("reference")


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal with the amounts of every thousandth key times a million millions."""
    wide = F.when(F.expr("LineNo div 32 % 1000 = 0"), F.lit(10**12)).otherwise(F.lit(1)).cast("decimal(13,0)")
    lines = fixtures.journal_lines(spark, sf_dir).withColumns({c: (F.col(c) * wide).cast(MONEY_LINE) for c in ("Debit", "Credit")})
    return decimals_as_double(quality.oversized_postings(LedgerBook(lines, dims.chart(spark)).postings_plan))


def _in_slice(b: LedgerBook, rows: Callable[[], DataFrame]) -> DataFrame:
    """Rows of postings in the slice. The postings come first, so that the rows are computed from the same table."""
    sliced = _sliced(b.postings)
    return postings.keep_sliced(rows(), sliced)


def _marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_dir = new_path(spark, "ledger-run")
    return sinks.mart_rows(spark, run_dir, sinks.write_ledger_marts(book_of(spark, sf_dir), run_dir))


def _mart(name: str) -> Query:
    """What a reader finds in one mart."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        run_dir = new_path(spark, "ledger-run")
        sinks.write_ledger_marts(book_of(spark, sf_dir), run_dir, (name,))
        found = spark.read.parquet(f"{run_dir}/{name}")
        return decimals_as_double(found.drop("Year") if name in ("flags", "settlements") else found)

    return run


MARTS = ("by_year", "by_preparer", "by_month", "flags", "data_quality", "settlements")


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "flag-extract")
    sinks.write_flag_extract(book_of(spark, sf_dir).flags_plan, path, EXTRACT_TESTS)
    return decimals_as_double(
        spark.read.schema(sinks.FLAG_EXTRACT_SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path, header=True)
    )


TIMELINESS = [
    "PostingID", "LagDays", "HasLag", "LagBand", "IsOnTime", "EnteredHour", "EnteredWeekday", "IsWeekend", "IsAfterHours", "Year",
    "YearMonth", "IsMonthEndWeek",
]
POSTING = [
    "PostingID", *postings.HEADER_FIELDS, "FirstAccountName", "LineCount", "Debits", "Credits", *postings.FEATURES, "PostingAmount",
    "Imbalance", "IsBalanced",
]

# Reports read once use the plan of the postings; those that read them several times use the written table.
BOOK_QUERIES: dict[str, Callable[[LedgerBook], DataFrame]] = {
    "gl_accounts": lambda b: acc.account_totals(b.lines),
    "gl_chart_join": lambda b: b.accounts,
    "gl_enriched_lines": lambda b: postings.enrich_lines(b.lines, b.accounts).select(
        "PostingID", "LineNo", "AccountNo", "Debit", "Credit", "AccountClass", "AccountGroup", "IsLiquid"
    ),
    "gl_postings": lambda b: postings.roll_up(postings.enrich_lines(b.lines, b.accounts), b.cfg).select(*POSTING),
    "gl_posting_types": lambda b: b.postings_plan.select("PostingID", "PostingType"),
    "gl_timeliness": lambda b: b.postings_plan.select(*TIMELINESS),
    "gl_test_unbalanced": _row_test(checks.UNBALANCED),
    "gl_test_large_cash": _row_test(checks.LARGE_CASH),
    "gl_test_duplicate": lambda b: checks.duplicate_flags(b.postings_with(checks.POSTING_COLUMNS)),
    "gl_test_backdated": _row_test(checks.BACKDATED),
    "gl_test_rare_account": lambda b: checks.rare_account_flags(b.postings_plan, b.lines, b.cfg),
    "gl_test_off_hours": _row_test(checks.OFF_HOURS),
    "gl_test_very_late": _row_test(checks.VERY_LATE),
    "gl_test_wrong_invoice": lambda b: checks.wrong_invoice_flags(b.postings_with(checks.POSTING_COLUMNS)),
    "gl_rare_account_years": lambda b: checks.rare_account_years(b.lines, b.cfg),
    "gl_flags": lambda b: b.flags_plan,
    "gl_tests_skipped": lambda b: checks.tests_skipped(_sliced(b.postings_plan)),
    "gl_ref_type": lambda b: checks.referenced_types(b.postings),
    "gl_slice": lambda b: _slice_columns(_sliced(b.postings_plan)),
    "gl_slice_semi": lambda b: _in_slice(b, lambda: b.flags_plan),
    "gl_slice_values": lambda b: reports.slice_values(b.postings_with(reports.SLICE_COLUMNS)),
    "gl_settle_exact": _exact,
    "gl_settle_fifo": lambda b: b.settlements_by("fifo"),
    "gl_aging": lambda b: _exact(b).select("PostingID", "InvoiceDate", "AgeAtPeriodEnd", "AgeBucket", "DaysToSettle", "PaidVia"),
    "gl_dq_unbalanced": lambda b: quality.unbalanced_entries(b.postings_plan),
    "gl_dq_no_date": lambda b: quality.lines_without_date(b.lines),
    "gl_dq_no_account": lambda b: quality.lines_without_account(b.lines),
    "gl_dq_two_sided": lambda b: quality.two_sided_lines(b.lines),
    "gl_dq_guessed_accounts": lambda b: quality.guessed_accounts(b.accounts),
    "gl_dq_no_preparer": lambda b: quality.entries_without_preparer(b.postings_plan),
    "gl_dq_duplicate_lines": lambda b: quality.duplicate_lines(b.lines),
    "gl_dq_summary": lambda b: b.quality,
    "gl_dq_detail": lambda b: quality.quality_detail(b.lines, b.postings, b.accounts, b.cfg),
    "gl_kpis": lambda b: reports.kpis(b.postings, b.lines, b.flags, _exact(b)),
    "gl_monthly_flagged": lambda b: reports.monthly_flagged(b.postings, b.flags_plan),
    "gl_by_type": lambda b: reports.by_type(b.postings_plan),
    "gl_month_type": lambda b: reports.by_month_type(b.postings_plan),
    "gl_by_preparer": lambda b: reports.by_preparer(b.postings_with(reports.SLICE_COLUMNS)),
    "gl_month_end_share": lambda b: reports.month_end_share(b.postings_plan),
    "gl_lines_per_entry": lambda b: reports.lines_per_entry(b.postings_plan),
    "gl_lag_bands_user": lambda b: reports.lag_bands_by_user(b.postings_plan),
    "gl_lag_bands": lambda b: reports.lag_bands(b.postings_plan),
    "gl_lag_kpis": lambda b: reports.lag_kpis(b.postings_plan, b.cfg),
    "gl_lag_month": lambda b: reports.lag_by_month(b.postings_plan),
    "gl_ontime_type": lambda b: reports.on_time_by_type(b.postings_plan),
    "gl_late_backlog": lambda b: reports.late_backlog(b.postings_plan, b.cfg),
    "gl_weekday_hour": lambda b: reports.weekday_hour(b.postings_plan),
    "gl_off_hours_kpis": lambda b: reports.off_hours_kpis(b.postings_plan, b.cfg),
    "gl_off_hours_user": lambda b: reports.off_hours_by_user(b.postings_plan),
    "gl_off_hours_risky": lambda b: reports.off_hours_risky(b.postings_plan, b.cfg),
    "gl_flags_by_test": lambda b: reports.flags_by_test(b.flags_plan),
    "gl_flag_kpis": lambda b: reports.flag_kpis(b.postings, b.flags),
    "gl_flags_user_test": lambda b: reports.flags_user_test(b.flags_plan),
    "gl_flags_month_test": lambda b: reports.flags_month_test(b.flags_plan),
    "gl_settle_kpis": lambda b: reports.settlement_kpis(_in_slice(b, lambda: _exact(b)), _sliced(b.postings)),
    "gl_settle_by_type": lambda b: reports.settlement_by_type(_exact(b)),
    "gl_settle_hist": lambda b: reports.settlement_histogram(b.settlements),
    "gl_open_by_age": lambda b: reports.open_by_age(_exact(b)),
    "gl_open_invoices": lambda b: reports.open_invoices(_exact(b)),
    "gl_sum_year": lambda b: reports.summary_by_year(b.postings_plan),
    "gl_sum_preparer": lambda b: reports.summary_by_preparer(b.postings, b.flags_plan),
    "gl_sum_month": lambda b: reports.summary_by_month(b.postings_plan),
    "gl_findings": lambda b: reports.findings(b.postings, b.flags, b.settlements),
}


def _on_book(build: Callable[[LedgerBook], DataFrame]) -> Query:
    return lambda spark, sf_dir: decimals_as_double(build(book_of(spark, sf_dir)))


def ledger_queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "gl_journal_lines": lambda spark, sf_dir: decimals_as_double(fixtures.journal_lines(spark, sf_dir)),
        "gl_classify_accounts": lambda spark, sf_dir: decimals_as_double(book_of(spark, sf_dir, chart=False).accounts),
        "gl_account_overrides": lambda spark, sf_dir: decimals_as_double(_overridden(spark, sf_dir)),
        "gl_dq_oversized": _oversized,
        "snk_flag_extract": _extract,
        "snk_ledger_marts": _marts,
    }
    out.update({f"snk_ledger_{name}": _mart(name) for name in MARTS})
    out.update({name: _on_book(build) for name, build in BOOK_QUERIES.items()})
    return out
