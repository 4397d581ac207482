"""Ledger report tables. Inputs are the (sliced) postings, flags, settlements and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import WEEKDAYS, rate, ratio, year_month
from ledgerleaf.operators.ledger.checks import distinct_flagged, is_off_hours
from ledgerleaf.operators.ledger.postings import LAG_BANDS
from ledgerleaf.settings import LedgerSettings

HISTOGRAM_BINS = 40
CASH_SHARE_LIMIT = 0.1


def _n(name: str = "Entries") -> Column:
    return F.count(F.lit(1)).alias(name)


def _mean(c: str, name: str) -> Column:
    return F.round(F.avg(c), 6).alias(name)


#: What the choices for the slice and the counts by preparer read of a posting.
SLICE_COLUMNS = ("UserID", "PostingType")


def slice_values(postings: DataFrame) -> DataFrame:
    """Choices for the slice: preparers and posting types."""
    users = postings.filter(F.col("UserID").isNotNull()).select(F.lit("UserID").alias("Field"), F.col("UserID").alias("Value"))
    types = postings.select(F.lit("PostingType").alias("Field"), F.col("PostingType").alias("Value"))
    return users.unionByName(types).distinct()


def kpis(postings: DataFrame, lines: DataFrame, flags: DataFrame, settlements: DataFrame) -> DataFrame:
    head = postings.agg(
        _n(),
        F.sum("PostingAmount").alias("TotalDebits"),
        F.count_if(~F.col("IsBalanced")).alias("Unbalanced"),
        _mean("LagDays", "AvgLagDays"),
        rate(F.when(F.col("HasLag"), F.col("IsOnTime"))).alias("OnTimeRate"),
        F.min("PostingDate").alias("PeriodStart"),
        F.max("PostingDate").alias("PeriodEnd"),
    )
    open_amount = settlements.agg(F.sum(F.when(~F.col("IsSettled"), F.col("PostingAmount")))).scalar()
    flagged = flags.agg(F.count_distinct("PostingID")).scalar()
    line_count = lines.agg(F.count(F.lit(1))).scalar()
    return head.select(
        "*",
        line_count.alias("Lines"),
        flagged.alias("Flagged"),
        ratio(flagged, F.col("Entries")).alias("FlaggedShare"),
        F.coalesce(open_amount, F.lit(0)).alias("OpenAmount"),
    )


def monthly_flagged(postings: DataFrame, flags: DataFrame) -> DataFrame:
    entries = postings.groupBy("YearMonth").agg(_n())
    flagged = distinct_flagged(flags).groupBy(year_month(F.col("PostingDate")).alias("YearMonth")).agg(_n("Flagged"))
    e, f = entries.alias("e"), flagged.alias("f")
    return e.join(f, F.col("e.YearMonth").eqNullSafe(F.col("f.YearMonth")), "left").select(
        "e.YearMonth", "Entries", F.coalesce("Flagged", F.lit(0)).alias("Flagged")
    )


def by_type(postings: DataFrame) -> DataFrame:
    return postings.groupBy("PostingType").agg(_n())


def by_month_type(postings: DataFrame) -> DataFrame:
    return postings.groupBy("YearMonth", "PostingType").agg(_n())


def by_preparer(postings: DataFrame) -> DataFrame:
    known = postings.filter(F.col("UserID").isNotNull())
    total = known.agg(F.count(F.lit(1))).scalar()
    return known.groupBy("UserID").agg(_n()).withColumn("Share", ratio(F.col("Entries"), total))


def month_end_share(postings: DataFrame) -> DataFrame:
    return postings.groupBy("YearMonth").agg(rate(F.col("IsMonthEndWeek")).alias("MonthEndShare"))


def lines_per_entry(postings: DataFrame) -> DataFrame:
    return postings.groupBy("LineCount").agg(_n())


def _with_lag(postings: DataFrame) -> DataFrame:
    return postings.filter("HasLag")


def lag_bands_by_user(postings: DataFrame) -> DataFrame:
    bands = (
        _with_lag(postings)
        .filter(F.col("UserID").isNotNull() & F.col("LagBand").isNotNull())
        .groupBy("UserID", "LagBand")
        .agg(_n())
    )
    per_user = F.sum("Entries").over(Window.partitionBy("UserID"))
    return bands.withColumn("Share", ratio(F.col("Entries"), per_user))


def lag_bands(postings: DataFrame) -> DataFrame:
    """All bands in fixed order, zero where empty: one conditional count per band in a single pass."""
    counts = _with_lag(postings).agg(
        *[F.count_if(F.col("LagBand") == label).alias(f"b{i}") for i, (label, _) in enumerate(LAG_BANDS, 1)]
    )
    rows = [
        F.struct(F.lit(i).alias("BandOrder"), F.lit(label).alias("LagBand"), F.col(f"b{i}").alias("Entries"))
        for i, (label, _) in enumerate(LAG_BANDS, 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def lag_kpis(postings: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    return _with_lag(postings).agg(
        _mean("LagDays", "AvgLagDays"),
        F.median("LagDays").alias("MedianLagDays"),
        rate(F.col("IsOnTime")).alias("OnTimeRate"),
        rate(F.col("LagDays") > cfg.very_late_days).alias("VeryLateRate"),
    )


def lag_by_month(postings: DataFrame) -> DataFrame:
    return _with_lag(postings).groupBy("YearMonth").agg(_mean("LagDays", "AvgLagDays"), F.median("LagDays").alias("MedianLagDays"))


def on_time_by_type(postings: DataFrame) -> DataFrame:
    return _with_lag(postings).groupBy("PostingType").agg(rate(F.col("IsOnTime")).alias("OnTimeRate"))


def late_backlog(postings: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    return (
        postings.filter(F.col("LagDays") > cfg.very_late_days)
        .select("PostingID", "PostingType", "DocumentDate", "EnteredDateTime", "UserID", "LagDays", "PostingAmount")
        .orderBy(F.desc("LagDays"), "PostingID")
    )


def weekday_hour(postings: DataFrame) -> DataFrame:
    """Long weekday x hour table, all seven days and 24 hours, zero where empty."""
    spark = postings.sparkSession
    counts = postings.filter(F.col("EnteredDateTime").isNotNull()).groupBy("EnteredWeekday", "EnteredHour").agg(_n())
    days = [F.struct(F.lit(i).alias("DayOrder"), F.lit(d).alias("EnteredWeekday")) for i, d in enumerate(WEEKDAYS, 1)]
    grid = spark.range(1).select(F.inline(F.array(*days))).select(
        "DayOrder", "EnteredWeekday", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("EnteredHour")
    )
    return grid.join(counts, ["EnteredWeekday", "EnteredHour"], "left").select(
        "DayOrder", "EnteredWeekday", "EnteredHour", F.coalesce("Entries", F.lit(0)).alias("Entries")
    )


def off_hours_kpis(postings: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    timed = postings.filter(F.col("EnteredDateTime").isNotNull())
    return timed.agg(
        rate(F.col("IsWeekend")).alias("WeekendRate"),
        rate(F.col("IsAfterHours")).alias("AfterHoursRate"),
        F.count_if(is_off_hours(cfg)).alias("LargeOffHours"),
    )


def off_hours_by_user(postings: DataFrame) -> DataFrame:
    timed = postings.filter(F.col("EnteredDateTime").isNotNull() & F.col("UserID").isNotNull())
    return timed.groupBy("UserID").agg(
        rate(F.col("IsWeekend")).alias("WeekendRate"), rate(F.col("IsAfterHours")).alias("AfterHoursRate")
    )


def off_hours_risky(postings: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    return (
        postings.filter(F.col("EnteredDateTime").isNotNull() & is_off_hours(cfg))
        .select("PostingID", "PostingType", "EnteredDateTime", "UserID", "PostingAmount")
        .orderBy(F.desc("PostingAmount"), "PostingID")
    )


def flags_by_test(flags: DataFrame) -> DataFrame:
    """A posting carries a test at most once, so rows per test are distinct postings."""
    return flags.groupBy("Test").agg(_n(), F.sum("PostingAmount").alias("Amount"))


def flag_kpis(postings: DataFrame, flags: DataFrame) -> DataFrame:
    entries = postings.agg(F.count(F.lit(1))).scalar()
    tests = flags.agg(F.count_distinct("Test")).scalar()
    return distinct_flagged(flags).agg(_n("Flagged"), F.sum("PostingAmount").alias("FlaggedAmount")).select(
        "Flagged", ratio(F.col("Flagged"), entries).alias("FlagRate"), "FlaggedAmount", tests.alias("TestsTripped")
    )


def flags_user_test(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("UserID").isNotNull()).groupBy("UserID", "Test").agg(_n())


def flags_month_test(flags: DataFrame) -> DataFrame:
    return flags.groupBy(year_month(F.col("PostingDate")).alias("YearMonth"), "Test").agg(_n())


def flag_extract(flags: DataFrame, tests: tuple[str, ...] | None = None) -> DataFrame:
    chosen = flags if tests is None else flags.filter(F.col("Test").isin(*tests))
    return chosen.orderBy("Test", F.desc("PostingAmount"), "PostingID")


def settlement_kpis(settlements: DataFrame, sliced: DataFrame) -> DataFrame:
    settled = F.col("IsSettled")
    return settlements.agg(
        F.count(F.lit(1)).alias("Invoices"),
        rate(settled).alias("SettledRate"),
        F.round(F.avg(F.when(settled, F.col("DaysToSettle"))), 6).alias("AvgDaysToSettle"),
        F.sum(F.when(~settled, F.col("PostingAmount"))).alias("OpenAmount"),
        F.count_if(~settled).alias("OpenInvoices"),
        rate(F.col("PaidVia") == "Cash").alias("CashShareOfInvoices"),
        rate(F.when(settled, F.col("PaidVia") == "Cash")).alias("CashShareOfSettled"),
    ).select("*", sliced.agg(F.max("PostingDate")).scalar().alias("SlicePeriodEnd"))


def settlement_by_type(settlements: DataFrame) -> DataFrame:
    return settlements.groupBy("CounterpartyType").agg(
        F.count(F.lit(1)).alias("Invoices"),
        F.count_if("IsSettled").alias("Settled"),
        _mean("DaysToSettle", "AvgDays"),
        rate(F.coalesce(F.col("DaysToSettle") <= 30, F.lit(False))).alias("Within30"),
        F.count_if(F.col("PaidVia") == "Cash").alias("PaidViaCash"),
    )


def settlement_histogram(settlements: DataFrame) -> DataFrame:
    """Days to settle in 40 equal bins between the smallest and the largest value."""
    settled = settlements.filter("IsSettled").select("CounterpartyType", "DaysToSettle")
    low = settled.agg(F.min("DaysToSettle").cast("double")).scalar()
    high = settled.agg(F.max("DaysToSettle").cast("double")).scalar()
    # One row per distinct value first, so that binning and its two bounds touch a few hundred rows.
    counted = settled.groupBy("CounterpartyType", "DaysToSettle").agg(_n("n"))
    width = (high - low) / HISTOGRAM_BINS
    number = F.least(F.floor(F.try_divide(F.col("DaysToSettle") - low, width)) + 1, F.lit(HISTOGRAM_BINS))
    return (
        counted.withColumn("Bin", F.coalesce(number, F.lit(1)).cast("int"))
        .groupBy("CounterpartyType", "Bin")
        .agg(F.sum("n").alias("Invoices"))
    )


def open_by_age(settlements: DataFrame) -> DataFrame:
    return (
        settlements.filter(~F.col("IsSettled") & F.col("AgeBucket").isNotNull())
        .groupBy("CounterpartyType", "AgeBucket")
        .agg(_n("Invoices"), F.sum("PostingAmount").alias("OpenAmount"))
    )


def open_invoices(settlements: DataFrame) -> DataFrame:
    return (
        settlements.filter(~F.col("IsSettled"))
        .select("PostingID", "CounterpartyType", "InvoiceDate", "PostingAmount", "AgeAtPeriodEnd", "AgeBucket")
        .orderBy(F.desc("AgeAtPeriodEnd"), "PostingID")
    )


def _timing_measures() -> list[Column]:
    """Rates over all postings (``_all``) and over those with a lag or an entry time (``_known``)."""
    timed = F.col("EnteredDateTime").isNotNull()
    return [
        _n("Postings"),
        F.sum("PostingAmount").alias("TotalDebits"),
        _mean("LagDays", "AvgLagDays"),
        rate(F.col("IsOnTime")).alias("OnTimeRate_all"),
        rate(F.when(F.col("HasLag"), F.col("IsOnTime"))).alias("OnTimeRate_known"),
        rate(F.col("IsWeekend")).alias("WeekendRate_all"),
        rate(F.when(timed, F.col("IsWeekend"))).alias("WeekendRate_known"),
        rate(F.col("IsAfterHours")).alias("AfterHoursRate_all"),
        rate(F.when(timed, F.col("IsAfterHours"))).alias("AfterHoursRate_known"),
    ]


def summary_by_year(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("Year").isNotNull()).groupBy("Year").agg(*_timing_measures())


def summary_by_preparer(postings: DataFrame, flags: DataFrame) -> DataFrame:
    total = postings.agg(F.count(F.lit(1))).scalar()
    flagged = distinct_flagged(flags).filter(F.col("UserID").isNotNull()).groupBy("UserID").agg(_n("Flagged"))
    users = (
        postings.filter(F.col("UserID").isNotNull())
        .groupBy("UserID")
        .agg(
            _n("Postings"), _mean("LagDays", "AvgLagDays"), rate(F.col("IsOnTime")).alias("OnTimeRate_all"),
            rate(F.when(F.col("HasLag"), F.col("IsOnTime"))).alias("OnTimeRate_known"),
        )
    )
    return users.join(flagged, "UserID", "left").withColumn("Share", ratio(F.col("Postings"), total))


def summary_by_month(postings: DataFrame) -> DataFrame:
    return postings.groupBy("YearMonth").agg(
        _n("Postings"), _mean("LagDays", "AvgLagDays"), rate(F.col("IsOnTime")).alias("OnTimeRate_all"),
        rate(F.when(F.col("HasLag"), F.col("IsOnTime"))).alias("OnTimeRate_known"),
    )


def findings(postings: DataFrame, flags: DataFrame, settlements: DataFrame | None) -> DataFrame:
    """All findings as ranked data, the unbalanced entries first."""
    null_s, null_n, null_d = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def finding(order: int, code: str, subject=null_s, count=null_n, amount=null_d, share=null_d, value=null_d) -> list[Column]:
        return [
            F.lit(order).alias("o"), F.lit(code).alias("Code"), subject.alias("Subject"), count.cast("bigint").alias("Count"),
            amount.cast("double").alias("Amount"), share.cast("double").alias("Share"), value.cast("double").alias("Value"),
        ]

    entries = postings.agg(F.count(F.lit(1))).scalar()
    unbalanced = postings.agg(F.count_if(~F.col("IsBalanced")).alias("n")).filter("n > 0").select(
        *finding(0, "unbalanced_entries", count=F.col("n"))
    )
    late = (
        postings.filter("HasLag")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_if(~F.col("IsOnTime")).alias("late"), F.round(F.avg("LagDays"), 6).alias("lag"),
        )
        .filter("n > 0")
        .select(*finding(1, "late_entries", count=F.col("late"), share=ratio(F.col("late"), F.col("n")), value=F.col("lag")))
    )
    unique = distinct_flagged(flags)
    top = (
        flags.groupBy("Test").agg(_n("n")).orderBy(F.desc("n"), "Test").limit(3)
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "Test"))).alias("t"))
        .select(F.array_join(F.transform("t", lambda x: F.concat(x["Test"], F.lit(" ("), (-x["m"]).cast("string"), F.lit(")"))), "; "))
        .scalar()
    )
    flagged = (
        unique.agg(_n("n"), F.sum("PostingAmount").alias("amount"))
        .filter("n > 0")
        .select(
            *finding(2, "flagged_entries", subject=top, count=F.col("n"), amount=F.col("amount"), share=ratio(F.col("n"), entries))
        )
    )
    per_user = postings.filter(F.col("UserID").isNotNull()).groupBy("UserID").agg(_n("all"))
    flagged_user = unique.filter(F.col("UserID").isNotNull()).groupBy("UserID").agg(_n("flagged"))
    riskiest = (
        per_user.join(flagged_user, "UserID")
        .withColumn("rate", ratio(F.col("flagged"), F.col("all")))
        .orderBy(F.desc("rate"), "UserID")
        .limit(1)
        .select(
            *finding(
                3, "highest_flag_rate_preparer", subject=F.col("UserID"), count=F.col("all"), share=F.col("rate"),
                value=ratio(F.col("all"), entries),
            )
        )
    )
    parts = [unbalanced, late, flagged, riskiest]
    if settlements is not None:
        open_ = (
            settlements.filter(~F.col("IsSettled"))
            .agg(
                _n("n"), F.sum("PostingAmount").alias("amount"), F.count_if(F.col("AgeBucket") == "90+").alias("old"),
            )
            .filter("n > 0")
            .select(*finding(4, "open_invoices", count=F.col("n"), amount=F.col("amount"), value=F.col("old")))
        )
        cash = (
            settlements.agg(rate(F.col("PaidVia") == "Cash").alias("share"), F.count_if(F.col("PaidVia") == "Cash").alias("n"))
            .filter(F.col("share") > CASH_SHARE_LIMIT)
            .select(*finding(5, "cash_share_of_invoices", count=F.col("n"), share=F.col("share")))
        )
        parts += [open_, cash]
    # At most six one-row parts reach this window.
    ranked = reduce(DataFrame.unionByName, parts).withColumn("Rank", F.row_number().over(Window.orderBy("o")))
    return ranked.select("Rank", "Code", "Subject", "Count", "Amount", "Share", "Value")
