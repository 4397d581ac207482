"""Invoices to payments, by reference or first-in-first-out, and aging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import floor_days
from ledgerleaf.operators.ordered import CHUNK, border_keys, chunk_by_range, same_key
from ledgerleaf.settings import LedgerSettings

# Age buckets with their upper bounds in days (the last one is open up to 100000).
AGE_BUCKETS = (("0-30", 30), ("31-60", 60), ("61-90", 90), ("90+", 100000))
INVOICE_COLUMNS = ["PostingID", "PostingType", "PostingDate", "DocumentDate", "PostingAmount", "Counterparty"]
#: What matching and aging read of a posting.
POSTING_COLUMNS = (*INVOICE_COLUMNS, "TouchesCash", "RefPostingID")


def invoices_of(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("PostingType").isin("Purchase invoice", "Sales invoice")).select(
        *INVOICE_COLUMNS,
        F.coalesce("DocumentDate", "PostingDate").alias("InvoiceDate"),
        F.when(F.col("PostingType") == "Purchase invoice", "Supplier (AP)").otherwise("Customer (AR)").alias("CounterpartyType"),
    )


def payments_of(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("PostingType").isin("Supplier payment", "Customer receipt")).select(
        F.col("PostingID").alias("PaymentID"),
        F.col("PostingDate").alias("PaymentDate"),
        "TouchesCash", "PostingAmount", "Counterparty", "RefPostingID",
    )


def match_by_reference(postings: DataFrame) -> DataFrame:
    """Invoices with the earliest payment that names them (undated payments last, ties by payment id).

    The earliest payment is a minimum per reference, combined before the shuffle, so many payments against one
    invoice never meet in one task.
    """
    order = F.struct(F.col("PaymentDate").isNull().alias("undated"), "PaymentDate", "PaymentID", "TouchesCash")
    earliest = (
        payments_of(postings)
        .filter(F.col("RefPostingID").isNotNull())
        .groupBy(F.col("RefPostingID").alias("PostingID"))
        .agg(F.min(order).alias("p"))
        .select("PostingID", "p.PaymentID", "p.PaymentDate", "p.TouchesCash")
    )
    return invoices_of(postings).join(earliest, "PostingID", "left")


def match_fifo(postings: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    """Invoices with payments of the same counterparty and exact amount, first in first out.

    Invoice number i (in date order) takes payment number ``i + max(j <= i)(lb_j - j)``, where ``lb_j`` counts the
    payments dated before invoice j less the grace days: a running maximum instead of a greedy loop. Counts and
    maximum come from an ordered scan over (counterparty, amount) that splits hot groups over many tasks.
    """
    keys = ["Counterparty", "PostingAmount"]
    matchable = F.col("Counterparty").isNotNull()
    invoices = invoices_of(postings)
    grace = F.make_dt_interval(F.lit(cfg.fifo_grace_days))
    events = (
        invoices.filter(matchable & F.col("InvoiceDate").isNotNull())
        .select(*keys, (F.col("InvoiceDate") - grace).alias("ts"), F.lit(0).alias("is_pay"), F.col("PostingID").alias("id"),
                F.lit(None).cast("boolean").alias("TouchesCash"))
        .unionByName(
            payments_of(postings)
            .filter(matchable & F.col("PaymentDate").isNotNull())
            .select(*keys, F.col("PaymentDate").alias("ts"), F.lit(1).alias("is_pay"), F.col("PaymentID").alias("id"), "TouchesCash")
        )
    )
    chunked = chunk_by_range(events, keys, ["ts", "is_pay", "id"])

    def scan(df: DataFrame) -> DataFrame:
        """Counts and running maximum inside (keys, chunk)."""
        upto = Window.partitionBy(*keys, CHUNK).orderBy("ts", "is_pay", "id").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        counted = df.withColumn("pays", F.sum("is_pay").over(upto)).withColumn(
            "bills", F.sum(1 - F.col("is_pay")).over(upto)
        )
        # For an invoice row: lb = pays, i = bills - 1.
        ahead = F.when(F.col("is_pay") == 0, F.col("pays") - F.col("bills") + 1)
        return counted.withColumn("ahead", F.max(ahead).over(upto))

    borders = border_keys(chunked, keys)
    on_border = chunked.join(F.broadcast(borders), same_key(chunked, borders, keys), "left_semi")
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        scan(on_border)
        .groupBy(*keys, CHUNK)
        .agg(F.max("pays").alias("n_pays"), F.max("bills").alias("n_bills"), F.max("ahead").alias("c_ahead"))
        .withColumns(
            {
                "pays0": F.coalesce(F.sum("n_pays").over(before), F.lit(0)),
                "bills0": F.coalesce(F.sum("n_bills").over(before), F.lit(0)),
            }
        )
        .withColumn("ahead0", F.max(F.col("pays0") - F.col("bills0") + F.col("c_ahead")).over(before))
        .select(*keys, CHUNK, "pays0", "bills0", "ahead0")
    )
    zero = F.lit(0)
    scanned = (
        scan(chunked)
        .join(F.broadcast(carry), [*keys, CHUNK], "left")
        .withColumns(
            {
                "pays0": F.coalesce("pays0", zero),
                "bills0": F.coalesce("bills0", zero),
            }
        )
    )
    ahead = F.greatest("ahead0", F.col("pays0") - F.col("bills0") + F.col("ahead"))
    is_pay = F.col("is_pay") == 1
    number = F.when(is_pay, F.col("pays0") + F.col("pays") - 1).otherwise(F.col("bills0") + F.col("bills") - 1 + ahead)
    # Invoice i and payment k meet on (keys, number): at most one of each, so this grouping cannot be skewed.
    matches = (
        scanned.groupBy(*keys, number.alias("number"))
        .agg(
            F.max(F.when(~is_pay, F.col("id"))).alias("PostingID"),
            F.max(F.when(is_pay, F.struct(F.col("id").alias("PaymentID"), F.col("ts").alias("PaymentDate"), "TouchesCash"))).alias("p"),
        )
        .filter(F.col("PostingID").isNotNull() & F.col("p").isNotNull())
        .select("PostingID", "p.PaymentID", "p.PaymentDate", "p.TouchesCash")
    )
    return invoices.join(matches, "PostingID", "left")


def age_bucket(days: Column) -> Column:
    bucket = F.when(days <= -1, F.lit(None).cast("string"))
    for label, top in AGE_BUCKETS:
        bucket = bucket.when(days <= top, label)
    return bucket


def with_aging(matched: DataFrame, postings: DataFrame) -> DataFrame:
    """Settlement facts; the period end is the latest date of all postings, never of a slice."""
    period_end = postings.select(F.max("PostingDate")).scalar()
    settled = F.col("PaymentID").isNotNull()
    return (
        matched.withColumns(
            {
                "IsSettled": settled,
                "DaysToSettle": floor_days(F.col("PaymentDate"), F.col("InvoiceDate")),
                "AgeAtPeriodEnd": floor_days(period_end, F.col("InvoiceDate")),
                "PaidVia": F.when(settled & F.coalesce("TouchesCash", F.lit(False)), "Cash").when(settled, "Bank").otherwise("Open"),
            }
        )
        .withColumn("AgeBucket", age_bucket(F.col("AgeAtPeriodEnd")))
        .select(
            *INVOICE_COLUMNS, "InvoiceDate", "CounterpartyType", "PaymentID", "PaymentDate", "TouchesCash", "IsSettled",
            "DaysToSettle", "AgeAtPeriodEnd", "AgeBucket", "PaidVia",
        )
    )


def settle(postings: DataFrame, method: str, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    """``method``: "reference" or "fifo"."""
    matched = match_by_reference(postings) if method == "reference" else match_fifo(postings, cfg)
    return with_aging(matched, postings)


def settlement_method(postings: DataFrame) -> str | None:
    """Reference if any posting has one, else FIFO if any has a counterparty, else none. One row reaches the driver."""
    seen = postings.agg(F.count("RefPostingID").alias("refs"), F.count("Counterparty").alias("parties")).first()
    if seen.refs:
        return "reference"
    return "fifo" if seen.parties else None
