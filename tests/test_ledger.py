"""Classification, roll-up and timing on hand-made rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerleaf import dims
from ledgerleaf.functions.columns import floor_days, parse_amount
from ledgerleaf.operators.ledger.accounts import classify_accounts
from ledgerleaf.operators.ledger.postings import build_postings
from ledgerleaf.operators.ledger.quality import oversized_postings

LINE = (
    "LineNo long, PostingID string, PostingDate timestamp_ntz, DocumentDate timestamp_ntz, EnteredDateTime timestamp_ntz, AccountNo string, "
    "AccountName string, Debit decimal(18,4), Credit decimal(18,4), UserID string, Counterparty string, RefPostingID string"
)
# Class and group by keyword alone, worked out by hand.
GUESSES = {
    "Cash-in-hand": ("Asset", "Cash & bank"),
    "Trade receivables": ("Asset", "Receivables"),
    "Deductible input tax, 19%": ("Asset", "VAT / sales tax"),
    "VAT payable, 19%": ("Liability", "VAT / sales tax"),
    "Cost of merchandise, 19% input tax": ("Expense", "Cost of goods"),
    "Statutory social security expenses": ("Expense", "Personnel"),
    "Rent — immovable property": ("Expense", "Other operating"),
    "Revenue, 19% VAT": ("Revenue", "Revenue"),
    "VAT receivable": ("Asset", "Receivables"),
    "Bank charges": ("Asset", "Cash & bank"),
    "Miscellaneous (sales tax)": ("Expense", "Other operating"),
    "Owner drawings": ("Equity", "Equity"),
}


def lines(spark, rows):
    full = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, LINE)


def row(pid, no, name, dr, cr, date=dt.datetime(2024, 3, 28), doc=None, entered=None, user=None):
    return (pid, date, doc, entered, no, name, Decimal(dr), Decimal(cr), user, None, None)


def test_keyword_classes(spark):
    df = lines(spark, [row("P", str(i), n, "1", "0") for i, n in enumerate(GUESSES)])
    got = {r.AccountName: (r.AccountClass, r.AccountGroup) for r in classify_accounts(df).collect()}
    assert got == GUESSES


def test_chart_with_a_repeated_number_keeps_the_lines(spark):
    chart = dims.inline_table(spark, (("1", "x", "Asset", "VAT", "Debit"), ("1", "y", "Asset", "VAT", "Debit")), dims.CHART_SCHEMA)
    got = classify_accounts(lines(spark, [row("P", "1", "n", "1", "0")] * 3), chart).collect()
    assert [(r.AccountNo, r.Lines, r.Source) for r in got] == [("1", 3, "chart of accounts")]


def test_roll_up_types_and_timing(spark):
    rows = [
        row("A", "4210", "Rent", "100.005", "0", entered=dt.datetime(2024, 3, 30, 18), doc=dt.datetime(2024, 3, 30, 10)),
        row("A", "1600", "Trade payables", "0", "100", date=None),
        row("B", "9", "Odd", "0", "5", date=None),
        row(None, "9", "Odd", "7", "0"),
    ]
    df = lines(spark, rows).repartition(3)
    got = {r.PostingID: r for r in build_postings(df, classify_accounts(df)).collect()}
    assert set(got) == {"A", "B"}
    a = got["A"]
    assert a.PostingType == "Purchase invoice" and a.PostingAmount == Decimal("100.00") and a.IsBalanced
    # Floored: entered at midnight is ten hours before the document.
    assert (a.LagDays, a.LagBand, a.IsWeekend, a.IsAfterHours, a.IsMonthEndWeek) == (-1, "0-3 days", True, True, True)
    assert got["B"].PostingType == "Other" and got["B"].YearMonth is None and got["B"].IsMonthEndWeek is False
    assert got["B"].EnteredWeekday is None and got["B"].IsOnTime is False and got["B"].Imbalance == Decimal("-5.00")


def test_amount_text(spark):
    texts = {"(1,234.50)": "-1234.50", "(-5)": "5", "1.234,56": "1.23456", "5-": "0", "1e5": "15", "": "0", "$ 7": "7", None: "0", "-": "0"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_amount(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == {t: Decimal(v).quantize(Decimal("0.0001")) for t, v in texts.items()}


def test_floor_days(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 00:00:00' AS a, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS b")
    assert df.select(floor_days(F.col("a"), F.col("b")), floor_days(F.col("b"), F.col("a"))).first()[:] == (0, -1)


def test_totals_that_fit_no_posting(spark):
    """A posting of more places than postings hold is listed and stops no other; so is one that no decimal holds."""
    rows = [row("big", "1000", "Cash", "9" * 13, 0), row("big", "8400", "Sales", 0, "9" * 13), row("small", "1000", "Cash", 5, 0), row("small", "8400", "Sales", 0, 5)]
    journal = lines(spark, rows)
    huge = F.when(F.col("PostingID") == "big", F.lit(10**11)).otherwise(F.lit(1)).cast("decimal(12,0)")
    journal = journal.withColumns({c: (F.col(c) * huge).cast("decimal(28,4)") for c in ("Debit", "Credit")})
    found = build_postings(journal, classify_accounts(journal, dims.chart(spark)))
    got = {r.PostingID: (r.PostingAmount, r.Imbalance, r.IsBalanced) for r in found.collect()}
    assert got == {"big": (None, Decimal("0.00"), True), "small": (Decimal("5.00"), Decimal("0.00"), True)}
    assert [r.PostingID for r in oversized_postings(found).collect()] == ["big"]
