"""Lines to postings: header fields, sums, features, type and timeliness in one grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import MONEY_POSTING, contains_any, floor_days, or_false, weekday_name, year_month
from ledgerleaf.settings import LedgerSettings

HEADER_FIELDS = ("PostingDate", "DocumentDate", "EnteredDateTime", "UserID", "Counterparty", "RefPostingID")
FEATURES = (
    "DrAP", "CrAP", "DrAR", "CrAR", "DrLiquid", "CrLiquid", "CrRevenue", "DrExpense", "Personnel", "LiquidAmount", "TouchesCash",
    "CashAmount",
)
CASH_WORDS = ("cash", "petty")
# Lag bands with their upper bounds in days (the last one is open up to 100000).
LAG_BANDS = (("0-3 days", 3), ("4-7 days", 7), ("8-14 days", 14), ("15-30 days", 30), ("31+ days", 100000))


def enrich_lines(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lines with the class, group and cash flag of their account."""
    return lines.join(accounts.select("AccountNo", "AccountClass", "AccountGroup", "IsLiquid"), "AccountNo", "left")


def _features() -> dict[str, Column]:
    debit, credit = F.col("Debit") > 0, F.col("Credit") > 0
    group, cls = F.col("AccountGroup"), F.col("AccountClass")
    liquid = or_false(F.col("IsLiquid"))
    cash_name = or_false(contains_any(F.lower("AccountName"), CASH_WORDS))
    moved = F.col("Debit") + F.col("Credit")

    def any_line(cond: Column) -> Column:
        return F.bool_or(or_false(cond))

    def money_where(cond: Column) -> Column:
        return F.try_sum(F.when(cond, moved).otherwise(F.lit(0).cast("decimal(18,4)")))

    return {
        "DrAP": any_line(debit & (group == "Payables")),
        "CrAP": any_line(credit & (group == "Payables")),
        "DrAR": any_line(debit & (group == "Receivables")),
        "CrAR": any_line(credit & (group == "Receivables")),
        "DrLiquid": any_line(debit & liquid),
        "CrLiquid": any_line(credit & liquid),
        "CrRevenue": any_line(credit & (cls == "Revenue")),
        "DrExpense": any_line(debit & (cls == "Expense")),
        "Personnel": any_line(group == "Personnel"),
        "LiquidAmount": money_where(liquid),
        "TouchesCash": any_line(cash_name),
        "CashAmount": money_where(cash_name),
    }


def roll_up(enriched: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    """One row per posting id. Sums and flags combine before the shuffle, so a hot id costs one row per task.

    Totals beyond the type of postings are null; ``quality.oversized_postings`` lists them.
    """

    def first(c: str) -> Column:
        return F.expr(f"min_by({c}, {cfg.line_order}) FILTER (WHERE {c} IS NOT NULL)").alias(c)

    grouped = (
        enriched.filter(F.col("PostingID").isNotNull())
        .groupBy("PostingID")
        .agg(
            *[first(c) for c in HEADER_FIELDS],
            first("AccountName").alias("FirstAccountName"),
            F.count(F.lit(1)).alias("LineCount"),
            F.try_sum("Debit").alias("Debits"),
            F.try_sum("Credit").alias("Credits"),
            *[c.alias(n) for n, c in _features().items()],
        )
    )
    imbalance = F.bround(F.try_subtract("Debits", "Credits"), 2)
    return grouped.withColumns(
        {
            "PostingAmount": F.bround("Debits", 2).try_cast(MONEY_POSTING),
            "Imbalance": imbalance.try_cast(MONEY_POSTING),
            "IsBalanced": or_false(F.abs(imbalance) < F.lit("0.01").cast("decimal(3,2)")),
        }
    )


def with_types(postings: DataFrame) -> DataFrame:
    """Posting type by ordered rules over the features."""
    c = F.col
    kind = (
        F.when(c("CrAP") & c("DrExpense"), "Purchase invoice")
        .when(c("CrRevenue") & c("DrAR"), "Sales invoice")
        .when(c("CrRevenue"), "Cash sale")
        .when(c("DrAP") & c("CrLiquid"), "Supplier payment")
        .when(c("CrAR") & c("DrLiquid"), "Customer receipt")
        .when(c("Personnel"), "Payroll")
        .when(c("DrExpense"), "Operating expense")
        .otherwise("Other")
    )
    return postings.withColumn("PostingType", kind)


def lag_band(days: Column) -> Column:
    band = F.when(days <= -10000, F.lit(None).cast("string"))
    for label, top in LAG_BANDS:
        band = band.when(days <= top, label)
    return band


def with_timeliness(postings: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    entered, posted = F.col("EnteredDateTime"), F.col("PostingDate")
    base = F.coalesce("DocumentDate", "PostingDate")
    entered_day = F.to_date(entered).cast("timestamp_ntz")
    day = F.to_date(posted)
    hour = F.hour(entered)
    return (
        postings.withColumn("LagDays", floor_days(entered_day, base))
        .withColumns(
            {
                "HasLag": F.col("LagDays").isNotNull(),
                "LagBand": lag_band(F.col("LagDays")),
                "IsOnTime": or_false(F.col("LagDays") <= cfg.on_time_days),
                "EnteredHour": hour,
                "EnteredWeekday": weekday_name(entered),
                "IsWeekend": or_false(F.weekday(F.to_date(entered)) >= 5),
                "IsAfterHours": or_false((hour < cfg.work_start) | (hour >= cfg.work_end)),
                "Year": F.year(posted),
                "YearMonth": year_month(posted),
                "IsMonthEndWeek": or_false(F.datediff(F.last_day(day), day) <= cfg.month_end_days - 1),
            }
        )
    )


def build_postings(lines: DataFrame, accounts: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    return with_timeliness(with_types(roll_up(enrich_lines(lines, accounts), cfg)), cfg)


def slice_postings(
    postings: DataFrame,
    start: str | None = None,
    end: str | None = None,
    types: tuple[str, ...] | None = None,
    users: tuple[str, ...] | None = None,
) -> DataFrame:
    """Period, type and preparer filter. Runs last: tests and settlement are computed on everything first.

    The end is midnight of the end date, undated postings drop out, postings without a preparer always stay.
    """
    out = postings
    if start is not None and end is not None:
        out = out.filter(F.col("PostingDate").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    else:
        out = out.filter(F.col("PostingDate").isNotNull())
    if types is not None:
        out = out.filter(F.col("PostingType").isin(*types))
    if users is not None:
        out = out.filter(F.col("UserID").isin(*users) | F.col("UserID").isNull())
    return out


def keep_sliced(df: DataFrame, sliced: DataFrame) -> DataFrame:
    """Rows of lines, flags or settlements whose posting is in the slice."""
    return df.join(sliced.select("PostingID"), "PostingID", "left_semi")
