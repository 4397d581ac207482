"""Untidy exports derived from the journal and the activity rows: six kinds of files, a few thousand entries in each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.fixtures import activity_rows, journal_lines
from ledgerleaf.functions.columns import unfused

ENTRIES_PER_FILE = 4000
#: Title rows above the headings, by kind.
TITLE_ROWS = (3, 3, 3, 40, 3, 3)
#: Every so many entries the document date is no date, or no day.
NO_DATE, NO_DAY = "Q1 1995", "31/02/1995"
BROKEN_EVERY = 500

# Headings by kind; kind 5 has too few known headings to be found.
HEADINGS = (
    ("PostingID", "PostingDate", "DocumentDate", "EnteredDateTime", "AccountNo", "AccountName", "Debit", "Credit"),
    ("Date", "Transaction Type", "Num", "Name", "Memo/Description", "Account", "Debit", "Credit"),
    ("Voucher", "Date", "GL account name", "Debit", "Credit", "Prepared by (team)", "Customer name", "nan"),
    ("posting id", "Posting Date", "Account-Name", "DEBIT", "CREDIT", "User", "Debit", "Reference"),
    ("Date", "Account code", "Amount", "Debit", "Created at", "Month", "", "Fuel source"),
    ("Facility", "Consumption", "Unit", "Entry", "Scope", "Activity", "Month", "Category"),
)


def _key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines with key, position and kind; ``step`` 1 marks an extra row after the first line of an entry."""
    k, pos = F.expr("LineNo div 32"), F.col("LineNo") % 4
    lines = journal_lines(spark, sf_dir).withColumns({"k": unfused(k), "pos": pos, "kind": k % 6})
    return lines.withColumn("SourceFile", F.format_string("kind%d-%05d", F.col("kind"), F.expr(f"k div {ENTRIES_PER_FILE}")))


def _amount(c: str) -> Column:
    kind, d = F.col("kind"), F.col(c)
    commas = F.format_number(d.cast("decimal(18,2)"), 2)
    return (
        F.when((d == 0) & (kind < 3), "").when((d == 0) & (kind == 3), "-").when(kind == 0, commas)
        .when(kind == 2, F.concat(F.lit("$ "), commas)).otherwise(d.cast("decimal(18,2)").cast("string"))
    )


def _day(c: str, null: str) -> Column:
    layouts = ("MM/dd/yyyy", "dd/MM/yyyy", "d MMM yyyy", "MMM d, yyyy", "MM/dd/yy", "yyyyMMdd")
    return F.coalesce(_by_kind(layouts, lambda p: F.date_format(F.to_date(c), p)), F.lit(null))


def _entered() -> Column:
    layouts = (
        "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "M/d/yyyy h:mm a", "yyyy-MM-dd HH:mm:ss.SSS", "d-MMM-yy HH:mm", "yyyy-MM-dd'T'HH:mm:ss'+02:00'",
    )
    return F.coalesce(_by_kind(layouts, lambda p: F.date_format("EnteredDateTime", p)), F.lit(""))


def _by_kind(values: tuple, of: Callable[[object], Column]) -> Column:
    out = None
    for kind, value in enumerate(values):
        chosen = F.col("kind") == kind
        out = F.when(chosen, of(value)) if out is None else out.when(chosen, of(value))
    return out


def untidy_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped text rows: SourceFile, LineNo, the twelve fields and a signed Amount."""
    kind, pos = F.col("kind"), F.col("pos")
    lines = _key(spark, sf_dir)
    signed = F.col("Debit") - F.col("Credit")
    commas = F.format_number(F.abs(signed).cast("decimal(18,2)"), 2)
    rows = lines.select(
        unfused(F.col("SourceFile")).alias("SourceFile"), "LineNo",
        F.when(kind == 2, None).when((kind == 3) & (pos > 0), "").otherwise(F.concat(F.lit(" "), "PostingID", F.lit(" "))).alias("PostingID"),
        _day("PostingDate", "nan").alias("PostingDate"),
        F.when(F.col("k") % BROKEN_EVERY == 3, NO_DATE).when(F.col("k") % BROKEN_EVERY == 4, NO_DAY).otherwise(_day("DocumentDate", "None")).alias("DocumentDate"),
        _entered().alias("EnteredDateTime"),
        F.when(kind != 5, F.col("AccountNo")).alias("AccountNo"),
        F.when(kind != 4, F.col("AccountName")).alias("AccountName"),
        _amount("Debit").alias("Debit"), _amount("Credit").alias("Credit"),
        F.coalesce("UserID", F.lit("None")).alias("UserID"), F.coalesce("Counterparty", F.lit(" ")).alias("Counterparty"),
        F.coalesce("RefPostingID", F.lit("nan")).alias("RefPostingID"), F.lit("").alias("LineText"),
        F.when(signed < 0, F.concat(F.lit("("), commas, F.lit(")"))).otherwise(commas).alias("Amount"),
    )
    null = F.lit(None).cast("string")
    # After each entry: a total line in kind 5, a blank separator in kind 1.
    total = kind == 5
    extra = lines.filter((pos == 0) & kind.isin(1, 5)).select(
        "SourceFile", (F.col("LineNo") + 3).alias("LineNo"), F.lit("").alias("PostingID"), F.lit("").alias("PostingDate"),
        null.alias("DocumentDate"), null.alias("EnteredDateTime"), null.alias("AccountNo"),
        F.when(total, F.concat(F.lit("TOTAL "), "AccountName")).otherwise("").alias("AccountName"),
        F.when(total, _amount("Debit")).otherwise("").alias("Debit"), F.lit("").alias("Credit"), null.alias("UserID"),
        null.alias("Counterparty"), null.alias("RefPostingID"), null.alias("LineText"), null.alias("Amount"),
    )
    return rows.unionByName(extra)


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report-style rows: header fields on the first line of an entry only, every seventh number blank, a total row after it."""
    pos, k = F.col("pos"), F.col("k")
    first = pos == 0
    null = F.lit(None).cast("string")
    lines = _key(spark, sf_dir)
    rows = lines.select(
        "SourceFile", "LineNo",
        F.when(first, F.coalesce(F.date_format(F.to_date("PostingDate"), "dd/MM/yyyy"), F.lit(""))).otherwise("").alias("Date"),
        F.when(first, F.substring("PostingID", 1, 2)).otherwise("").alias("TransactionType"),
        F.when(first & (k % 7 != 0), k.cast("string")).otherwise("").alias("Num"),
        F.when(first, F.col("Counterparty")).alias("Name"), F.lit("memo").alias("Memo"), F.col("AccountName").alias("Account"),
        F.col("Debit").cast("decimal(18,2)").cast("string").alias("Debit"), F.col("Credit").cast("decimal(18,2)").cast("string").alias("Credit"),
    )
    totals = lines.filter(first).select(
        "SourceFile", (F.col("LineNo") + 3).alias("LineNo"), F.lit("").alias("Date"), F.lit("").alias("TransactionType"), F.lit("").alias("Num"),
        null.alias("Name"), null.alias("Memo"), F.lit("").alias("Account"), F.col("Debit").cast("decimal(18,2)").cast("string").alias("Debit"),
        null.alias("Credit"),
    )
    return rows.unionByName(totals)


def suspect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount texts whose meaning a parser may change, by the last digit of the entry: comma decimals, a trailing minus,
    a currency, more digits than money has; credits with a comma in brackets."""
    d, c, digit = F.col("Debit").cast("decimal(18,2)").cast("string"), F.col("Credit").cast("decimal(18,2)").cast("string"), F.col("k") % 10
    comma = F.replace(d, F.lit("."), F.lit(","))
    debit = F.when(digit == 1, comma).when(digit == 2, F.concat(d, F.lit("-"))).when(digit == 3, F.concat(F.lit("USD "), d))
    debit = debit.when(digit == 4, F.concat(F.lit("9" * 25), d)).when(digit == 5, F.concat(F.lit("-"), d)).otherwise(d)
    credit = F.when(digit == 6, F.concat(F.lit("("), F.replace(c, F.lit("."), F.lit(",")), F.lit(")"))).otherwise(F.concat(F.lit("$ "), c))
    return _key(spark, sf_dir).select("SourceFile", "LineNo", debit.alias("Debit"), credit.alias("Credit"))


def _line(cells: list[Column], sep: Column) -> Column:
    """Delimited text of cells: those with a separator or a line break are quoted, others stand as they are."""

    def written(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        needed = F.contains(text, sep) | F.contains(text, F.lit("\n"))
        return F.when(needed, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    parts = [written(cells[0])]
    for c in cells[1:]:
        parts += [sep, written(c)]
    return F.concat(*parts)


def _write(rows: DataFrame, folder: str) -> None:
    """SourceFile, LineNo and value as one packed file for each source; files are bounded by their entries."""
    (
        rows.repartition("SourceFile").sortWithinPartitions("SourceFile", "LineNo").select("SourceFile", "value")
        .write.partitionBy("SourceFile").text(folder, compression="gzip")
    )


def _separator() -> Column:
    return F.when(F.col("kind").isin(2, 3), ";").otherwise(",")


def _heads(files: DataFrame, headings: tuple, titles: tuple) -> DataFrame:
    """Title rows, every tenth of them blank, and the headings, numbered before all data; a byte-order mark in kind 0."""
    title = F.transform(
        F.sequence(F.lit(1), _by_kind(titles, F.lit)),
        lambda i: F.struct((i - 1000).cast("long").alias("LineNo"), F.when(i == 2, F.concat(F.lit("Journal"), F.col("sep"), F.lit("Date")))
                           .when(i % 10 == 0, F.concat(F.lit("  \nReport 12\" wide, page "), i.cast("string"))).otherwise(F.concat(F.lit("Acme "), i.cast("string"))).alias("value")),
    )
    rows = F.when(_by_kind(titles, F.lit) > 0, title).otherwise(F.filter(title, lambda _: F.lit(False)))
    names = F.array_join(_by_kind(headings, lambda h: F.array(*map(F.lit, h))), "|")
    head = F.struct(F.lit(-1).cast("long").alias("LineNo"), F.replace(names, F.lit("|"), F.col("sep")).alias("value"))
    lines = files.withColumn("sep", _separator()).select("SourceFile", "kind", F.explode(F.concat(rows, F.array(head))).alias("r")).select("SourceFile", "kind", "r.*")
    first = F.row_number().over(Window.partitionBy("SourceFile").orderBy("LineNo")) == 1
    return lines.select("SourceFile", "LineNo", F.when((F.col("kind") == 0) & first, F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value")).alias("value"))


def write_exports(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The first eight fields of the lines under headings of six kinds. Kind 1 has blank lines between its entries, kind 2
    inch marks, kind 4 line breaks within cells."""
    lines = _key(spark, sf_dir)
    kind, k = F.col("kind"), F.col("k")
    account = F.when((kind == 4) & (k % 7 == 0), F.concat("AccountName", F.lit('\n("second", line)'))).when(
        (kind == 2) & (k % 5 == 0), F.concat("AccountName", F.lit(' 12" x'))
    ).otherwise(F.col("AccountName"))
    cells = [F.col(c) for c in ("PostingID", "PostingDate", "DocumentDate", "EnteredDateTime", "AccountNo")] + [account, F.col("Debit"), F.col("Credit")]
    text = _line(cells, _separator())
    text = F.when((kind == 1) & (F.col("pos") == 0), F.concat(F.lit("   \n"), text)).otherwise(text)
    rows = lines.select("SourceFile", "LineNo", text.alias("value"))
    _write(rows.unionByName(_heads(lines.select("SourceFile", "kind").distinct(), HEADINGS, TITLE_ROWS)), folder)


# Headings of journal files with the fields they hold, by kind. Kind 2 has no ids, kind 4 one signed amount; kinds 2, 4 and
# 5 have too few known headings to be found below titles.
JOURNAL_FILES = (
    (("PostingID", "PostingID"), ("PostingDate", "PostingDate"), ("Document date", "DocumentDate"), ("EnteredDateTime", "EnteredDateTime"), ("Account number", "AccountNo"),
     ("AccountName", "AccountName"), ("Debit", "Debit"), ("Credit", "Credit"), ("User", "UserID"), ("Counterparty", "Counterparty"), ("Applied to", "RefPostingID")),
    (("Num", "PostingID"), ("Date", "PostingDate"), ("Account", "AccountName"), ("Debit", "Debit"), ("Credit", "Credit"), ("Name", "Counterparty"),
     ("Created at", "EnteredDateTime"), ("Prepared by", "UserID")),
    (("Date", "PostingDate"), ("GL account name", "AccountName"), ("Debit amount", "Debit"), ("Credit amount", "Credit"), ("Customer", "Counterparty")),
    (("Entry No", "PostingID"), ("Date", "PostingDate"), ("AccountNo", "AccountNo"), ("Account name", "AccountName"), ("Credit", "Credit"), ("Debit", "Debit"),
     ("Payee", "Counterparty"), ("Entry time", "EnteredDateTime")),
    (("Voucher", "PostingID"), ("GL date", "PostingDate"), ("Account code", "AccountNo"), ("Amount", "Amount"), ("Preparer", "UserID")),
    (("Journal ID", "PostingID"), ("TxnDate", "PostingDate"), ("Ledger account", "AccountName"), ("Dr", "Debit"), ("Cr", "Credit"), ("Supplier", "Counterparty"),
     ("Cleared against", "RefPostingID"), ("Doc date", "DocumentDate")),
)
JOURNAL_TITLES = (3, 2, 0, 40, 0, 0)


def write_journal_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The untidy journal as files of six layouts."""
    rows = untidy_journal(spark, sf_dir).withColumn("kind", F.substring("SourceFile", 5, 1).cast("int")).withColumn("sep", _separator())
    text = _by_kind(JOURNAL_FILES, lambda columns: _line([F.col(field) for _, field in columns], F.col("sep")))
    files = rows.select("SourceFile", "kind").distinct()
    heads = _heads(files, tuple(tuple(h for h, _ in columns) for columns in JOURNAL_FILES), JOURNAL_TITLES)
    _write(rows.select("SourceFile", "LineNo", text.alias("value")).unionByName(heads), folder)


# Headings of activity files with the columns they hold, by kind.
ACTIVITY_FILES = (
    (("Month", "Date"), ("Facility name", "Site"), ("Scope", "Scope"), ("Category", "Category"), ("Activity", "Activity"), ("Consumption", "Quantity"), ("Unit", "Unit")),
    (("Quantity", "Quantity"), ("Units", "Unit"), ("Fuel or source", "Activity"), ("GHG scope", "Scope"), ("Subcategory", "Category"), ("Plant", "Site"), ("Period", "Date")),
)


def write_activity_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The activity rows as files of two layouts, one for each site; the second kind has semicolons."""
    kind = F.length("Site") % 2
    # One file for each site: what a site reports, month by month.
    rows = activity_rows(spark, sf_dir).withColumns({"kind": kind, "sep": F.when(kind == 1, ";").otherwise(",")})
    source = F.concat(F.lit("activity-"), F.md5("Site"))
    text = _by_kind(ACTIVITY_FILES, lambda columns: _line([F.col(c) for _, c in columns], F.col("sep")))
    head = _by_kind(ACTIVITY_FILES, lambda columns: _line([F.lit(h) for h, _ in columns], F.col("sep")))
    data = rows.select(source.alias("SourceFile"), F.lit(1).cast("long").alias("LineNo"), text.alias("value"))
    _write(data.unionByName(rows.select(source.alias("SourceFile"), F.lit(0).cast("long").alias("LineNo"), head.alias("value")).distinct()), folder)
