"""Untidy journal text to canonical lines. Input: SourceFile, LineNo and the twelve fields (and Amount) as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import MONEY_LINE, amount_is_suspect, date_outline, parse_amount, text_or_null, unfused, with_dates
from ledgerleaf.operators.ordered import CHUNK, ROWS_PER_CHUNK, forward_fill, running_total
from ledgerleaf.store import packed_table

FIELDS = (
    "PostingID", "PostingDate", "DocumentDate", "EnteredDateTime", "AccountNo", "AccountName", "Debit", "Credit", "UserID",
    "Counterparty", "RefPostingID", "LineText",
)
DATE_FIELDS = ("PostingDate", "DocumentDate", "EnteredDateTime")
TEXT_FIELDS = ("PostingID", "AccountNo", "AccountName", "UserID", "Counterparty", "RefPostingID", "LineText")


def complete_fields(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in FIELDS]
    return df.select("SourceFile", "LineNo", *cols, *[c for c in ("Amount", "Signed") if c in have])


def parse_amounts(df: DataFrame, signed: bool | None = None) -> DataFrame:
    """Debit and credit from two columns or from one signed amount.

    ``signed`` says which for all rows. Without it the column ``Signed``, a property of each file, does; without that
    column the sides count.
    """
    if signed is None and "Signed" in df.columns:
        by_file = F.coalesce(F.col("Signed"), F.lit(False))
    else:
        by_file = F.lit(bool(signed))
    if "Amount" not in df.columns:
        df = df.withColumn("Amount", F.lit(None).cast("string"))
    amount, zero = parse_amount(F.col("Amount")), F.lit(0).cast(MONEY_LINE)
    of_amount = {"Debit": F.greatest(amount, zero), "Credit": F.greatest((-amount).cast(MONEY_LINE), zero)}
    return df.withColumns({c: F.when(by_file, of_amount[c]).otherwise(parse_amount(F.col(c))) for c in of_amount}).drop("Signed")


def suspect_amounts(df: DataFrame) -> DataFrame:
    """Per file the amounts whose meaning the parser may change (comma decimals, letters, trailing minus)."""
    return df.groupBy("SourceFile").agg(
        F.count_if(amount_is_suspect(F.col("Debit"))).alias("DebitSuspects"), F.count_if(amount_is_suspect(F.col("Credit"))).alias("CreditSuspects")
    )


def normalise_text(df: DataFrame) -> DataFrame:
    return df.withColumns({**{c: text_or_null(F.col(c)) for c in TEXT_FIELDS}, "SourceFile": unfused(F.col("SourceFile"))})


def is_noise(account: Column) -> Column:
    """No account and no amount, or a total line."""
    no_amount = F.abs("Debit") + F.abs("Credit") == 0
    return (account.isNull() & no_amount) | F.coalesce(F.lower(account).startswith("total"), F.lit(False))


def typed_rows(df: DataFrame, signed: bool | None = None, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Amounts, texts and both readings of each date, written once; everything later reads this table."""
    clean = normalise_text(parse_amounts(complete_fields(df), signed))
    dated = with_dates(clean, {c: F.col(c) for c in DATE_FIELDS}).drop(*DATE_FIELDS, "Amount")
    return packed_table(dated.withColumn(CHUNK, F.expr(f"LineNo div {rows_per_chunk}")), "journal-rows")


def file_profile(typed: DataFrame) -> DataFrame:
    """One row for each block of lines of a file: date votes and gates of the whole file, and the id carried into the block.

    One pass over the typed rows. Whether the account name or the number tells noise depends on a gate, so ids are
    counted and kept for both.
    """
    found: dict[str, Column] = {f"_n_{c}_{name}": F.count(f"{c}_{name}") for c in DATE_FIELDS for name in ("month", "day")}
    found |= {"_names": F.count("AccountName"), "_numbers": F.count("AccountNo")}
    for account in ("AccountName", "AccountNo"):
        kept, has = ~is_noise(F.col(account)), F.col("PostingID").isNotNull()
        found[f"_ids_{account}"] = F.count_if(kept & has)
        found[f"_gaps_{account}"] = F.count_if(kept & ~has)
        # The line with the id: numbers are grouped by hash, where a text would have all rows sorted.
        found[f"_last_{account}"] = F.max(F.when(kept & has, F.col("LineNo")))
    blocks = typed.groupBy("SourceFile", CHUNK).agg(*[c.alias(name) for name, c in found.items()])
    of_file = Window.partitionBy("SourceFile")
    before = of_file.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(of_file)
    no_name = total("_names") == 0
    gated = lambda c: F.when(F.col("_no_name"), F.col(f"{c}_AccountNo")).otherwise(F.col(f"{c}_AccountName"))
    blocks = blocks.withColumn("_no_name", no_name)
    profile = blocks.select(
        "SourceFile", CHUNK, "_no_name", (total("_numbers") == 0).alias("_no_number"),
        *[(total(f"_n_{c}_day") > total(f"_n_{c}_month")).alias(f"_day_first_{c}") for c in DATE_FIELDS],
        (total(gated("_ids")) == 0).alias("_no_ids"), (total(gated("_gaps")) > 0).alias("_gaps"),
        F.last(gated("_last"), ignorenulls=True).over(before).alias("_from"),
    )
    profile = packed_table(profile, "journal-blocks")
    # The ids at those lines, for files that are filled over several blocks.
    wanted = profile.filter("_gaps AND NOT _no_ids AND _from IS NOT NULL").select("SourceFile", F.col("_from").alias("LineNo")).distinct()
    ids = typed.select("SourceFile", "LineNo", "PostingID").join(wanted, ["SourceFile", "LineNo"])
    ids = ids.groupBy("SourceFile", F.col("LineNo").alias("_from")).agg(F.max("PostingID").alias("_carry"))
    return packed_table(profile.join(ids, ["SourceFile", "_from"], "left").drop("_from"), "journal-profile")


def read_dates(profiled: DataFrame) -> DataFrame:
    """Each date column of a file is read day-first only if that reads strictly more values."""
    return profiled.withColumns(
        {c: F.when(F.col(f"_day_first_{c}"), F.col(f"{c}_day")).otherwise(F.col(f"{c}_month")) for c in DATE_FIELDS}
    )


def parse_dates(df: DataFrame) -> DataFrame:
    """SourceFile, LineNo and the date columns of untidy rows as times."""
    typed = typed_rows(df)
    return read_dates(typed.join(file_profile(typed), ["SourceFile", CHUNK])).select("SourceFile", "LineNo", *DATE_FIELDS)


def unread_dates(df: DataFrame) -> DataFrame:
    """Date texts that name no day in either order, by file, field and outline (9 for a digit, a for letters)."""
    dated = with_dates(complete_fields(df).select("SourceFile", *DATE_FIELDS), {c: F.col(c) for c in DATE_FIELDS})
    read = [F.struct(F.lit(c).alias("Field"), F.col(c).alias("Text"), F.col(f"{c}_month").alias("_month"), F.col(f"{c}_day").alias("_day")) for c in DATE_FIELDS]
    # The filter stays above the generator. Pushed into the readings, it would compute each of them many times.
    texts = dated.select("SourceFile", F.inline(F.array(*read)))
    unread = F.col("_month").isNull() & F.col("_day").isNull() & text_or_null(F.col("Text")).isNotNull()
    return texts.filter(unread).groupBy("SourceFile", "Field", date_outline(F.col("Text")).alias("Outline")).agg(
        F.count(F.lit(1)).alias("Lines"), F.min("Text").alias("Example")
    )


def fill_accounts(df: DataFrame) -> DataFrame:
    """A wholly empty account name or number column is copied from the other one."""
    name = F.when(F.col("_no_name"), F.col("AccountNo")).otherwise(F.col("AccountName"))
    return df.withColumn("AccountName", name).withColumn(
        "AccountNo", F.when(F.col("_no_number"), F.col("AccountName")).otherwise(F.col("AccountNo"))
    )


def synthetic_id() -> Column:
    """Id from the day and the counterparty, independent of the row order."""
    day = F.coalesce(F.date_format(F.to_date("PostingDate"), "yyyyMMdd"), F.lit("nodate"))
    return F.concat(F.lit("E-"), day, F.lit("-"), F.coalesce("Counterparty", F.lit("")))


def fill_ids(df: DataFrame) -> DataFrame:
    """Synthetic ids in files without any, else the last id carried down; only files with gaps are ordered for that."""
    named = df.withColumn("PostingID", F.when(F.col("_no_ids"), synthetic_id()).otherwise(F.col("PostingID")))
    gaps = F.col("_gaps") & ~F.col("_no_ids")
    within = Window.partitionBy("SourceFile", CHUNK).orderBy("LineNo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = named.filter(gaps).withColumn("PostingID", F.coalesce(F.last("PostingID", ignorenulls=True).over(within), F.col("_carry")))
    return named.filter(~gaps).unionByName(filled)


def first_appearance_ids(lines: DataFrame) -> DataFrame:
    """Ids numbered by first appearance in the file (E0, E1, ...), for parity with numbered synthetic ids.

    The distinct ids are numbered over all files by an ordered scan, less the first number of each file.
    """
    keys = lines.groupBy("SourceFile", "PostingID").agg(F.min("LineNo").alias("_first"))
    order = [F.asc("SourceFile"), F.asc("_first"), F.asc("PostingID")]
    numbered = packed_table(running_total(keys, order, F.lit(1), "_n"), "numbered-ids")
    start = numbered.groupBy("SourceFile").agg(F.min("_n").alias("_start"))
    return numbered.join(start, "SourceFile").select(
        "SourceFile", "PostingID", F.concat(F.lit("E"), (F.col("_n") - F.col("_start")).cast("string")).alias("NumberedID")
    )


def to_canonical(df: DataFrame, signed: bool | None = None, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Canonical lines with SourceFile and LineNo. Order them with ``struct(SourceFile, LineNo)``.

    ``df`` is computed once. ``signed`` is as in ``parse_amounts``.
    """
    typed = typed_rows(df, signed, rows_per_chunk)
    profiled = read_dates(typed.join(file_profile(typed), ["SourceFile", CHUNK]))
    kept = fill_accounts(profiled).filter(~is_noise(F.col("AccountName")))
    return fill_ids(kept).select("SourceFile", "LineNo", *FIELDS)


def unroll_report(df: DataFrame, ffill_num: bool = True) -> DataFrame:
    """Report-style journal (header fields only on an entry's first line) to mapped text rows.

    Input text columns: Date, TransactionType, Num, Name, Memo, Account, Debit, Credit. An entry with a blank number
    inherits the previous one unless ``ffill_num`` is off. The input is computed once; one ordered pass fills all fields.
    """
    has_account = F.coalesce(~F.trim("Account").isin("", "nan"), F.lit(False)).alias("_has_account")
    blank = lambda c: F.when(~F.col(c).isin("", "nan"), F.col(c)).alias(c)
    heads = ["Date", "TransactionType", "Name"] + (["Num"] if ffill_num else [])
    texts = df.select(
        "SourceFile", "LineNo", has_account, *[blank(c) for c in ("Date", "TransactionType", "Name", "Num")], "Memo", "Account", "Debit", "Credit"
    )
    rows = forward_fill(packed_table(texts, "report-texts"), "SourceFile", "LineNo", heads).filter("_has_account").drop("_has_account")
    rows = packed_table(with_dates(rows, {"": F.col("Date")}), "report-rows")
    votes = packed_table(rows.groupBy("SourceFile").agg((F.count("_day") > F.count("_month")).alias("_day_first")), "report-votes")
    day = F.when(F.col("_day_first"), F.col("_day")).otherwise(F.col("_month"))
    number = F.coalesce(text_or_null(F.col("Num")), F.date_format(F.to_date(day), "yyyy-MM-dd"))
    return rows.join(votes, "SourceFile").select(
        "SourceFile", "LineNo", F.concat(F.trim("TransactionType"), F.lit(" "), number).alias("PostingID"), F.col("Date").alias("PostingDate"),
        F.col("Account").alias("AccountName"), "Debit", "Credit", F.col("Name").alias("Counterparty"), F.col("Memo").alias("LineText"),
    )


def report_to_canonical(df: DataFrame, ffill_num: bool = True) -> DataFrame:
    return to_canonical(unroll_report(df, ffill_num))
