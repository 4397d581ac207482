"""The eight journal-entry tests. Each returns one row per flagged posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import plain_number
from ledgerleaf.settings import LedgerSettings
from ledgerleaf.store import packed_table

FLAG_COLUMNS = ["PostingID", "PostingDate", "PostingType", "UserID", "PostingAmount", "Test", "Detail"]
HEAD = FLAG_COLUMNS[:5]

# Test names.
UNBALANCED = "Unbalanced entry"
LARGE_CASH = "Large amount through cash"
DUPLICATE = "Possible duplicate"
BACKDATED = "Back-dated entry"
RARE_ACCOUNT = "Rarely used account"
OFF_HOURS = "Weekend / after-hours on cash or bank"
VERY_LATE = "Very late entry"
WRONG_INVOICE = "Payment cleared against wrong invoice"

#: What the tests read of a posting.
POSTING_COLUMNS = (
    "PostingID", "PostingDate", "DocumentDate", "PostingType", "UserID", "PostingAmount", "Imbalance", "IsBalanced", "TouchesCash", "CashAmount",
    "LiquidAmount", "IsWeekend", "IsAfterHours", "LagDays", "Counterparty", "RefPostingID", "FirstAccountName", "Year",
)

# Tests that need an optional column.
NEEDS = (
    (DUPLICATE, "Counterparty"),
    (BACKDATED, "DocumentDate"),
    (OFF_HOURS, "EnteredDateTime"),
    (VERY_LATE, "EnteredDateTime"),
    (WRONG_INVOICE, "RefPostingID"),
)


def is_off_hours(cfg: LedgerSettings) -> Column:
    return (F.col("IsWeekend") | F.col("IsAfterHours")) & (F.col("LiquidAmount") > cfg.cash_limit)


def _row_tests(cfg: LedgerSettings) -> list[tuple[str, Column, Column]]:
    """Tests that need nothing but the posting itself: (name, predicate, detail)."""
    return [
        (
            UNBALANCED,
            ~F.col("IsBalanced"),
            F.concat(F.lit("Debits differ from credits by "), plain_number(F.abs("Imbalance"))),
        ),
        (
            LARGE_CASH,
            F.col("TouchesCash") & (F.col("CashAmount") > cfg.cash_limit),
            F.lit(f"Cash-account movement above {cfg.cash_limit:,.0f}"),
        ),
        (BACKDATED, F.col("PostingDate") < F.col("DocumentDate"), F.lit("Posting date is earlier than the document date")),
        (
            OFF_HOURS,
            is_off_hours(cfg),
            F.when(F.col("IsWeekend"), "Entered on a weekend").otherwise("Entered outside working hours"),
        ),
        (
            VERY_LATE,
            F.col("LagDays") > cfg.very_late_days,
            F.concat(F.lit("Keyed "), F.col("LagDays").cast("string"), F.lit(" days after the document date")),
        ),
    ]


def row_test_flags(postings: DataFrame, cfg: LedgerSettings = LedgerSettings(), only: str | None = None) -> DataFrame:
    """All single-posting tests in one pass over the postings."""
    hits = [
        F.when(cond, F.struct(F.lit(name).alias("Test"), detail.alias("Detail")))
        for name, cond, detail in _row_tests(cfg)
        if only in (None, name)
    ]
    return postings.select(*HEAD, F.inline(F.array(*hits))).filter(F.col("Test").isNotNull()).select(*FLAG_COLUMNS)


def duplicate_flags(postings: DataFrame) -> DataFrame:
    """Same date, amount, type and counterparty as another entry.

    The keys are counted first (combined before the shuffle) and only repeated keys are joined back, so a key that
    holds a large share of the postings is never sorted in one task; the join side with the hot key can be split.
    """
    known = postings.filter(F.col("Counterparty").isNotNull() & (F.col("PostingAmount") > 0))
    keys = ["PostingDate", "PostingAmount", "PostingType", "Counterparty"]
    repeated = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    p, r = known.alias("p"), repeated.alias("r")
    same = (
        F.col("p.PostingDate").eqNullSafe(F.col("r.PostingDate"))
        & (F.col("p.PostingAmount") == F.col("r.PostingAmount"))
        & (F.col("p.PostingType") == F.col("r.PostingType"))
        & (F.col("p.Counterparty") == F.col("r.Counterparty"))
    )
    return p.join(r, same, "left_semi").select(
        *HEAD, F.lit(DUPLICATE).alias("Test"), F.lit("Same date, amount, type and counterparty as another entry").alias("Detail")
    )


def rare_account_years(lines: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    """(account, year) pairs with few distinct postings; lines without account or date count nowhere."""
    return (
        lines.select("AccountNo", F.year("PostingDate").alias("Year"), "PostingID")
        .filter(F.col("AccountNo").isNotNull() & F.col("Year").isNotNull())
        .groupBy("AccountNo", "Year")
        .agg(F.count_distinct("PostingID").alias("Postings"))
        .filter(F.col("Postings") <= cfg.dormant_max)
    )


def rare_account_postings(lines: DataFrame, rare: DataFrame) -> DataFrame:
    """Postings that touch a rare pair, with the first rare account and how many there are."""
    keyed = lines.select("AccountNo", F.year("PostingDate").alias("Year"), "PostingID").filter(F.col("PostingID").isNotNull())
    return (
        keyed.join(rare.select("AccountNo", "Year"), ["AccountNo", "Year"], "left_semi")
        .groupBy("PostingID")
        .agg(F.min("AccountNo").alias("RareAccount"), F.count_distinct("AccountNo").alias("RareAccounts"))
    )


def rare_account_flags(postings: DataFrame, lines: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    """The pairs are written first: their real size decides whether the lines are shuffled at all."""
    rare = packed_table(rare_account_years(lines, cfg), "rare-accounts")
    touched = rare_account_postings(lines, rare)
    detail = F.concat(F.lit("Account with few postings in the year: "), F.coalesce("FirstAccountName", F.lit("")))
    return postings.join(touched, "PostingID").select(
        *HEAD, F.lit(RARE_ACCOUNT).alias("Test"), detail.alias("Detail"), "RareAccount", "RareAccounts"
    )


def referenced_types(postings: DataFrame) -> DataFrame:
    """Postings with a reference, and the type of the posting referred to."""
    refs = postings.filter(F.col("RefPostingID").isNotNull()).select(*HEAD, "RefPostingID")
    target = postings.select(F.col("PostingID").alias("RefPostingID"), F.col("PostingType").alias("RefType"))
    return refs.join(target, "RefPostingID", "left").select(*HEAD, "RefPostingID", "RefType")


def wrong_invoice_flags(postings: DataFrame) -> DataFrame:
    """Payments whose reference is an invoice of the opposite kind; only payments and invoices are shuffled."""
    wrong_kind = F.when(F.col("PostingType") == "Supplier payment", "Sales invoice").when(
        F.col("PostingType") == "Customer receipt", "Purchase invoice"
    )
    payments = (
        postings.withColumn("RefType", wrong_kind)
        .filter(F.col("RefPostingID").isNotNull() & F.col("RefType").isNotNull())
        .select(*HEAD, "RefPostingID", "RefType")
    )
    invoices = postings.filter(F.col("PostingType").isin("Sales invoice", "Purchase invoice")).select(
        F.col("PostingID").alias("RefPostingID"), F.col("PostingType").alias("RefType")
    )
    return payments.join(invoices, ["RefPostingID", "RefType"], "left_semi").select(
        *HEAD,
        F.lit(WRONG_INVOICE).alias("Test"),
        F.lit("Payment references an invoice of the opposite type").alias("Detail"),
    )


def all_flags(postings: DataFrame, lines: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    """All tests in long form, one row per (posting, test)."""
    return (
        row_test_flags(postings, cfg)
        .unionByName(duplicate_flags(postings))
        .unionByName(rare_account_flags(postings, lines, cfg).select(*FLAG_COLUMNS))
        .unionByName(wrong_invoice_flags(postings))
    )


def tests_skipped(sliced: DataFrame) -> DataFrame:
    """Which tests had no input in the slice."""
    counted = sliced.agg(*[F.count(c).alias(c) for c in sorted({c for _, c in NEEDS})])
    rows = F.array(
        *[
            F.struct(
                F.lit(test).alias("Test"), F.lit(c).alias("NeedsColumn"), F.col(c).alias("Values"), (F.col(c) == 0).alias("IsSkipped")
            )
            for test, c in NEEDS
        ]
    )
    return counted.select(F.inline(rows))


def distinct_flagged(flags: DataFrame) -> DataFrame:
    """One row per flagged posting; the header fields are the same on all of its flags."""
    return flags.select(*HEAD).dropDuplicates(["PostingID"])
