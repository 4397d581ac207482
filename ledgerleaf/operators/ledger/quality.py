"""Ledger data-quality checks; always on all lines, never on a slice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import MONEY_LINE
from ledgerleaf.settings import LedgerSettings

# Check names and notes, in report order.
UNBALANCED = ("Unbalanced entries", "Debits and credits differ within one entry")
NO_DATE = ("Lines with no date", "Date missing or unreadable")
NO_ACCOUNT = ("Lines with no account", "Account blank")
TWO_SIDED = ("Lines with both debit and credit", "A line should carry one side only")
GUESSED = ("Accounts classified by keyword guess", "Review these classes in the expander below")
NO_PREPARER = ("Entries with no preparer", "Workload and user-based tests skip these")
DUPLICATE_LINES = ("Duplicate lines inside an entry", "Same account and amount repeated within one entry")
CHECKS = (UNBALANCED, NO_DATE, NO_ACCOUNT, TWO_SIDED, GUESSED, NO_PREPARER, DUPLICATE_LINES)

DUPLICATE_KEY = ["PostingID", "AccountNo", "Debit", "Credit"]
_two_sided = (lambda: (F.col("Debit") > 0) & (F.col("Credit") > 0))


def unbalanced_entries(postings: DataFrame) -> DataFrame:
    return postings.filter(~F.col("IsBalanced")).select("PostingID", "PostingDate", "Imbalance")


def oversized_postings(postings: DataFrame) -> DataFrame:
    """Postings whose amount or imbalance has more places than postings hold; a total that no decimal holds is null."""
    too_wide = F.col("PostingAmount").isNull() | F.col("Imbalance").isNull()
    return postings.filter(too_wide).select("PostingID", "PostingDate", "Debits", "Credits")


def lines_without_date(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("PostingDate").isNull()).select("LineNo", "PostingID", "AccountName", "Debit", "Credit")


def lines_without_account(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("AccountName").isNull()).select("LineNo", "PostingID", "PostingDate", "Debit", "Credit")


def two_sided_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(_two_sided()).select("LineNo", "PostingID", "AccountName", "Debit", "Credit")


def guessed_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("Source") == "keyword guess").select("AccountNo", "AccountName", "AccountClass", "AccountGroup")


def entries_without_preparer(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("UserID").isNull()).select("PostingID", "PostingDate", "PostingAmount")


def _repeated_keys(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*DUPLICATE_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_lines(lines: DataFrame) -> DataFrame:
    """Keys are counted before the shuffle; only the repeated ones are joined back (null equals null)."""
    x, r = lines.alias("x"), _repeated_keys(lines).alias("r")
    same: Column = reduce(
        lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"r.{k}")) for k in DUPLICATE_KEY]
    )
    return x.join(r, same, "left_semi").select("LineNo", "PostingID", "AccountName", "Debit", "Credit")


def quality_summary(lines: DataFrame, postings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Seven rows: order, check, count, note. One pass per source; the repeated lines are summed from counted keys."""

    def rows(counts: DataFrame, pairs: list[tuple[tuple[str, str], str]]) -> DataFrame:
        return counts.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(CHECKS.index(check) + 1).alias("CheckOrder"),
                            F.lit(check[0]).alias("Check"),
                            F.col(c).cast("bigint").alias("Count"),
                            F.lit(check[1]).alias("Note"),
                        )
                        for check, c in pairs
                    ]
                )
            )
        )

    of_lines = lines.agg(
        F.count_if(F.col("PostingDate").isNull()).alias("a"),
        F.count_if(F.col("AccountName").isNull()).alias("b"),
        F.count_if(_two_sided()).alias("c"),
    )
    of_postings = postings.agg(F.count_if(~F.col("IsBalanced")).alias("a"), F.count_if(F.col("UserID").isNull()).alias("b"))
    of_accounts = accounts.agg(F.count_if(F.col("Source") == "keyword guess").alias("a"))
    repeated = _repeated_keys(lines).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a"))
    return (
        rows(of_postings, [(UNBALANCED, "a"), (NO_PREPARER, "b")])
        .unionByName(rows(of_lines, [(NO_DATE, "a"), (NO_ACCOUNT, "b"), (TWO_SIDED, "c")]))
        .unionByName(rows(of_accounts, [(GUESSED, "a")]))
        .unionByName(rows(repeated, [(DUPLICATE_LINES, "a")]))
    )


def quality_detail(
    lines: DataFrame, postings: DataFrame, accounts: DataFrame, cfg: LedgerSettings = LedgerSettings()
) -> DataFrame:
    """The offending rows of every check in one shape; with ``cfg.detail_rows`` only the first so many of each check."""
    shape = {
        "PostingID": "string", "LineNo": "bigint", "AccountNo": "string", "AccountName": "string", "PostingDate": "timestamp_ntz",
        "Amount": MONEY_LINE, "Debit": MONEY_LINE, "Credit": MONEY_LINE,
    }

    def part(check: tuple[str, str], df: DataFrame, key: list[str]) -> DataFrame:
        cols = [
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()
        ]
        if cfg.detail_rows is not None:
            df = df.orderBy(*key).limit(cfg.detail_rows)
        return df.select(F.lit(check[0]).alias("Check"), *cols)

    line_key = ["PostingID", "LineNo"]
    parts = [
        part(UNBALANCED, unbalanced_entries(postings).withColumnRenamed("Imbalance", "Amount"), ["PostingID"]),
        part(NO_DATE, lines_without_date(lines), line_key),
        part(NO_ACCOUNT, lines_without_account(lines), line_key),
        part(TWO_SIDED, two_sided_lines(lines), line_key),
        part(GUESSED, guessed_accounts(accounts), ["AccountNo"]),
        part(NO_PREPARER, entries_without_preparer(postings).withColumnRenamed("PostingAmount", "Amount"), ["PostingID"]),
        part(DUPLICATE_LINES, duplicate_lines(lines), line_key),
    ]
    return reduce(DataFrame.unionByName, parts)
