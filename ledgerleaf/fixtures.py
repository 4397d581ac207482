"""Journal lines and activity rows derived from the order tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import dims

ACCOUNT_NAMES = {row[0]: row[1] for row in dims.CHART}
EXPENSE_ACCOUNTS = ("4210", "4240", "4250", "4260", "4360", "4580", "4600", "4930")

# Accounts of the adjustment entries: absent from the chart, so that every keyword rule is used. Number is 9000 + position.
UNLISTED_ACCOUNTS = (
    "VAT receivable",
    "Trade debtors (domestic)",
    "GST collected, 10% GST",
    "Input tax recoverable",
    "Accounts payable - other",
    "Sundry creditors",
    "Bank charges",
    "Petty cash box",
    "Savings deposit",
    "Cost of goods sold",
    "Purchase returns",
    "Payroll clearing",
    "Pension contributions",
    "Service revenue, 7% tax",
    "Fees earned",
    "Mortgage loan",
    "Accrued interest",
    "Owner drawings",
    "Share capital",
    "Inventory on hand",
    "Office furniture",
    "Prepaid rent",
    "Miscellaneous (sales tax)",
    "Travel, 19% input tax",
)
SUSPENSE_ACCOUNT = ("9990", "Unassigned items")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table of fewer file splits than cores (one small file); larger tables are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _days(n: Column) -> Column:
    return F.make_dt_interval(n.cast("int"))


def _id(prefix: str, k: Column) -> Column:
    return F.concat(F.lit(prefix), k.cast("string"))


HEAD_COLUMNS = ("fam", "kind", "PostingID", "k", "PostingDate", "Counterparty", "gross", "RefPostingID")


def _heads(df: DataFrame, fam: Column, kind: Column, pid: Column, date: Column, party: Column, gross: Column, ref: Column) -> DataFrame:
    return df.select(
        fam.cast("int").alias("fam"), kind.alias("kind"), pid.alias("PostingID"), "k", date.cast("timestamp_ntz").alias("PostingDate"),
        party.cast("string").alias("Counterparty"), gross.cast("bigint").alias("gross"), ref.cast("string").alias("RefPostingID"),
    )


def _copies(df: DataFrame, last: int, keep: Column) -> DataFrame:
    """Each row once per ``post`` number 0..last for which ``keep`` holds."""
    return df.select("*", F.explode(F.array(*[F.lit(i) for i in range(last + 1)])).alias("post")).filter(keep)


def posting_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per posting: family, key, date, counterparty, gross cents, reference."""
    none = F.lit(None)
    k, post = F.col("k"), F.col("post")

    sales = (
        spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("c_name").alias("cp"),
            _cents("o_totalprice").alias("g"),
        )
    )
    cash, receipt, copy = k % 10 == 0, post == 1, post == 2
    sales = _copies(sales, 2, (post == 0) | (receipt & ~cash & (k % 4 != 0)) | (copy & (k % 250 == 3)))
    sales_heads = _heads(
        sales,
        fam=post,
        kind=F.when(receipt, "CR").when(cash, "CS").otherwise("SI"),
        pid=F.when(receipt, _id("CR-", k)).when(copy, F.concat(_id("SI-", k), F.lit("-D"))).otherwise(_id("SI-", k)),
        date=F.when(receipt, F.col("d") + _days(k % 75)).otherwise(F.col("d")),
        party=F.col("cp"),
        gross=F.col("g"),
        ref=F.when(receipt, F.when(k % 101 == 0, _id("PI-", k)).otherwise(_id("SI-", k))),
    )

    purchases = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.max("l_shipdate").alias("d"),
            F.concat(F.lit("Supplier#"), F.lpad(F.min("l_suppkey").cast("string"), 9, "0")).alias("cp"),
            F.sum(_cents("l_extendedprice")).alias("g"),
        )
    )
    paid = post == 1
    purchase_heads = _heads(
        _copies(purchases, 1, (post == 0) | (k % 3 != 0)),
        fam=post + 3,
        kind=F.when(paid, "SP").otherwise("PI"),
        pid=F.when(paid, _id("SP-", k)).otherwise(_id("PI-", k)),
        date=F.when(paid, F.col("d") + _days(k % 60)).otherwise(F.col("d")),
        party=F.col("cp"),
        gross=F.col("g"),
        ref=F.when(paid, F.when(k % 103 == 0, _id("SI-", k)).otherwise(_id("PI-", k))),
    )

    expense_heads = _heads(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), _cents("p_retailprice").alias("g")),
        fam=F.lit(5), kind=F.lit("OE"), pid=_id("OE-", k),
        date=F.lit("1995-01-01").cast("timestamp_ntz") + _days(k % 2400), party=none, gross=F.col("g"), ref=none,
    )

    payroll_heads = _heads(
        table(spark, sf_dir, "orders")
        .select(F.last_day(F.to_date("o_orderdate")).alias("d"))
        .distinct()
        .withColumn("k", (F.year("d") * 12 + F.month("d")).cast("bigint")),
        fam=F.lit(6), kind=F.lit("PR"), pid=F.concat(F.lit("PR-"), F.date_format("d", "yyyyMM")),
        date=F.col("d"), party=none, gross=F.lit(2500000), ref=none,
    )

    adjustment_heads = _heads(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")),
        fam=F.lit(7), kind=F.lit("AJ"), pid=_id("AJ-", k),
        date=F.when(k % 40 != 7, F.lit("1995-06-01").cast("timestamp_ntz") + _days(k % 2000)),
        party=none, gross=10000 + (k * 37) % 90000, ref=none,
    )

    heads = sales_heads
    for part in (purchase_heads, expense_heads, payroll_heads, adjustment_heads):
        heads = heads.unionByName(part)
    return heads


def _account_names(spark: SparkSession) -> DataFrame:
    unlisted = tuple((str(9000 + i), name) for i, name in enumerate(UNLISTED_ACCOUNTS))
    rows = (*ACCOUNT_NAMES.items(), *unlisted, SUSPENSE_ACCOUNT)
    return dims.inline_table(spark, rows, "AccountNo string, AccountName string")


def _line_of_head() -> tuple[Column, Column, Column, Column]:
    """(exists, account number, debit cents, credit cents) of line ``pos`` of a head."""
    k, g, kind, pos = F.col("k"), F.col("gross"), F.col("kind"), F.col("pos")
    vat = F.expr("(gross * 19) div 119")
    revenue = g - vat - F.when(k % 97 == 0, 500).otherwise(0)
    salaries = F.expr("(gross * 4) div 5")
    copied = (kind == "AJ") & (k % 30 == 17)
    both = F.when(k % 45 == 13, 500).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sold, paid = kind.isin("SI", "CS"), kind.isin("CR", "SP")

    exists = (pos < 2) | kind.isin("SI", "CS", "PI", "PR") | copied
    expense_no = F.when(k % 400 == 0, F.lit("4950")).otherwise(
        F.element_at(F.array(*[F.lit(a) for a in EXPENSE_ACCOUNTS]), (k % 8 + 1).cast("int"))
    )
    first = (
        F.when(kind == "SI", "1400").when(kind == "CS", "1000").when(kind == "CR", F.when(k % 5 == 1, "1000").otherwise("1100"))
        .when(kind == "PI", "3400").when(kind == "SP", "1600").when(kind == "OE", expense_no).when(kind == "PR", "4120")
        .otherwise((9000 + k % 24).cast("string"))
    )
    second = (
        F.when(sold, "8400").when(kind == "CR", "1400").when(kind == "PI", "1576")
        .when(kind == "SP", F.when(k % 11 == 0, "1000").otherwise("1100"))
        .when(kind == "OE", F.when(k % 4 == 0, "1000").otherwise("1100"))
        .when(kind == "PR", "4130").when(k % 60 != 11, SUSPENSE_ACCOUNT[0])
    )
    third = F.when(sold, "1776").when(kind == "PI", "1600").when(kind == "PR", "1200").otherwise((9000 + k % 24).cast("string"))
    debit = (
        F.when((pos == 0) | copied & (pos == 2), F.when(kind == "PI", g - vat).when(kind == "PR", salaries)
               .when(kind == "AJ", g + both).otherwise(g))
        .when((pos == 1) & (kind == "PI"), vat)
        .when((pos == 1) & (kind == "PR"), g - salaries)
        .otherwise(zero)
    )
    credit = (
        F.when(pos == 1, F.when(sold, revenue).when(paid | (kind == "OE"), g).when(copied, g * 2).when(kind == "AJ", g).otherwise(zero))
        .when((pos == 2) & sold, vat)
        .when((pos == 2) & kind.isin("PI", "PR"), g)
        .when(kind == "AJ", both)
        .otherwise(zero)
    )
    number = F.when(pos == 0, first).when(pos == 1, second).otherwise(third)
    return exists, number, debit, credit


def _money(c: str) -> Column:
    return (F.col(c) * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,4)")


@lru_cache(maxsize=8)
def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical journal lines, one row per debit or credit. Only the lazy plan is kept between calls, no data."""
    k = F.col("k")
    date = F.col("PostingDate")
    exists, number, debit, credit = _line_of_head()
    lines = (
        posting_heads(spark, sf_dir)
        .select(
            "fam", "kind", "gross", "k", "PostingID", "PostingDate", "Counterparty", "RefPostingID",
            F.when(k % 50 != 49, F.when(k % 89 == 0, date + _days(F.lit(3))).otherwise(date - _days(k % 6))).alias("DocumentDate"),
            (
                date + _days((k * 7) % F.when(k % 13 == 0, 45).otherwise(9))
                + F.make_dt_interval(F.lit(0), (6 + k % 15).cast("int"))
            ).alias("EnteredDateTime"),
            F.when(k % 113 != 0, F.concat(F.lit("U"), (k % 7).cast("string"))).alias("UserID"),
            F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"),
        )
        .filter(exists)
        .withColumns({"AccountNo": number, "dr": debit, "cr": credit})
        .join(_account_names(spark), "AccountNo", "left")
    )
    return lines.select(
        ((k * 8 + F.col("fam")) * 4 + F.col("pos")).alias("LineNo"),
        "PostingID", "PostingDate", "DocumentDate", "EnteredDateTime", "AccountNo", "AccountName",
        _money("dr").alias("Debit"), _money("cr").alias("Credit"),
        "UserID", "Counterparty", "RefPostingID",
        F.lit(None).cast("string").alias("LineText"),
    )


# Years of the derived activity data: 2001 is partial, so 2000 is reported.
CARBON_YEARS = dict(base_year=1995, reporting_year=2000, target_year=2005)


@lru_cache(maxsize=8)
def activity_rows(spark: SparkSession, sf_dir: str, supplied: bool = False) -> DataFrame:
    """Raw activity per (month, site, library row); ``supplied`` gives every fifth library row an own factor."""
    lib = dims.factors(spark).select("lib_no", "Scope", "CategoryID", "ActivityType", "Factor", "FactorUnit")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    activity = F.col("ActivityType")
    name = (
        F.when(F.col("lib_no") == 49, "Unlisted activity")
        .when(F.col("lib_no") % 7 == 3, F.concat(activity.substr(1, 12), F.lit(" (site)")))
        .otherwise(activity)
    )
    month = F.trunc(F.to_date("l_shipdate"), "month")
    # Summed per supplier first: the site is only looked up for the sums.
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(month.alias("Month"), "l_suppkey", (F.col("l_partkey") % 50).cast("int").alias("lib_no"))
        .agg(F.sum("l_quantity").alias("q"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("Month", "n_name", "lib_no")
        .agg(F.sum("q").cast("bigint").alias("Quantity"))
        .join(lib, "lib_no")
        .select(
            F.date_format("Month", "yyyy-MM-dd").alias("Date"),
            F.col("n_name").alias("Site"),
            "lib_no",
            "Scope",
            F.when(F.col("Scope") == "Scope 3", F.col("CategoryID")).alias("Category"),
            name.alias("Activity"),
            F.col("Quantity").cast("string").alias("Quantity"),
            F.substring_index("FactorUnit", "/", -1).alias("Unit"),
            (F.when(F.col("lib_no") % 5 == 0, F.col("Factor") * 2) if supplied else F.lit(None)).cast("string").alias("Factor"),
        )
    )


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission facts as untidy text, in two files: one without any emissions, one with some."""
    n = F.col("lib_no")
    second = F.col("Date").substr(7, 1).isin("1", "3", "5", "7", "9")
    lib = dims.factors(spark).select("lib_no", F.col("CategoryID").alias("cat"), "FactorID", F.col("Factor").alias("f"), F.col("Method").alias("m"))
    score = (
        F.when(n % 7 == 0, "").when(n % 7 == 1, "7").when(n % 7 == 2, "2.6").when(n % 7 == 3, "0").when(n % 7 == 4, "abc").when(n % 7 == 5, "4")
    )
    return (
        activity_rows(spark, sf_dir)
        .join(lib, "lib_no")
        .select(
            F.when(second, "fact-b").otherwise("fact-a").alias("SourceFile"),
            F.when(n % 13 == 5, "bad").otherwise(F.col("Date")).alias("Date"),
            F.col("Site").alias("SiteID"),
            F.when(n % 3 == 0, F.upper("Scope")).when(n % 3 == 1, F.concat(F.lit(" scope"), F.substring_index("Scope", " ", -1)))
            .otherwise(F.col("Scope")).alias("Scope"),
            F.when(F.col("cat").isin("1", "2"), F.concat("cat", F.lit(".0"))).otherwise(F.concat(F.lit(" "), "cat")).alias("CategoryID"),
            F.col("Activity").alias("ActivityType"),
            F.when(n % 10 == 9, "n/a").otherwise(F.col("Quantity")).alias("Quantity"),
            "Unit",
            "FactorID",
            F.when(n % 11 != 0, F.col("f").cast("string")).alias("EmissionFactor"),
            F.when(n % 17 == 5, (F.col("f") * 3).cast("string")).alias("EmissionFactorMarket"),
            F.when(n % 6 != 0, F.col("m")).alias("Method"),
            score.alias("DataQualityScore"),
            F.when(second & (n % 3 == 0), F.concat("Quantity", F.lit(".5"))).alias("tCO2e_Location"),
        )
    )
