"""Account roll-up, classification, chart lookup and user overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import or_false
from ledgerleaf.settings import LedgerSettings

# Ordered keyword rules (keywords, class, group); the first rule that matches wins.
KEYWORD_RULES = (
    (("receivable", "debtors"), "Asset", "Receivables"),
    (("vat", "gst", "sales tax", "input tax", "tax payable", "hst"), "Liability", "VAT / sales tax"),
    (("payable", "creditors"), "Liability", "Payables"),
    (("cash", "bank", "petty", "checking", "savings", "current account"), "Asset", "Cash & bank"),
    (("cost of", "purchase", "cogs", "merchandise", "goods sold"), "Expense", "Cost of goods"),
    (("salar", "wage", "payroll", "social security", "pension"), "Expense", "Personnel"),
    (("revenue", "sales", "income", "fees earned", "turnover"), "Revenue", "Revenue"),
    (("loan", "credit card", "mortgage", "accrued"), "Liability", "Other liabilities"),
    (("equity", "capital", "retained", "drawings", "owner"), "Equity", "Equity"),
    (("inventory", "stock", "equipment", "furniture", "deposit", "prepaid", "fixed asset"), "Asset", "Other assets"),
)
DEFAULT_CLASS = ("Expense", "Other operating")
VAT_GROUP = "VAT / sales tax"
VAT_ASSET_WORDS = ("input", "deductible", "receivable", "recoverable")
CASH_GROUP = "Cash & bank"
# Patterns removed from an account name before the rules run.
BRACKETED = r"\(.*?\)"
TAX_SUFFIX = r",?\s*\d+(\.\d+)?\s*%\s*(vat|input tax|tax|gst)?"

CHART_COLUMNS = {"AccountNo", "AccountClass", "AccountGroup"}


def account_totals(lines: DataFrame, cfg: LedgerSettings = LedgerSettings()) -> DataFrame:
    """One row per account number; lines without a number belong to no account."""
    return (
        lines.filter(F.col("AccountNo").isNotNull())
        .groupBy("AccountNo")
        .agg(
            F.expr(f"min_by(AccountName, {cfg.line_order}) FILTER (WHERE AccountName IS NOT NULL)").alias("AccountName"),
            F.count(F.lit(1)).alias("Lines"),
            F.sum("Debit").alias("Debits"),
            F.sum("Credit").alias("Credits"),
        )
    )


def clean_name(name: Column) -> Column:
    text = F.lower(F.coalesce(name, F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, BRACKETED, " "), TAX_SUFFIX, " ")


def rule_number(text: Column) -> Column:
    """1-based number of the first keyword rule that matches a clean name; one more than the rules if none does."""
    number = None
    for i, (words, _, _) in enumerate(KEYWORD_RULES, 1):
        hit = text.rlike("|".join(words))
        number = F.when(hit, i) if number is None else number.when(hit, i)
    return number.otherwise(len(KEYWORD_RULES) + 1)


def with_chart(totals: DataFrame, chart: DataFrame | None) -> DataFrame:
    """Left join of the supplied chart, first row per number; without the needed columns the chart is ignored."""
    if chart is None or not CHART_COLUMNS <= set(chart.columns):
        return totals.withColumns(
            {
                "AccountClass": F.lit(None).cast("string"),
                "AccountGroup": F.lit(None).cast("string"),
                "Source": F.lit("keyword guess"),
            }
        )
    # A number that occurs twice takes its smallest (class, group), so that lines are never multiplied.
    known = (
        chart.select(F.trim(F.col("AccountNo").cast("string")).alias("AccountNo"), "AccountClass", "AccountGroup")
        .groupBy("AccountNo")
        .agg(F.min(F.struct(F.col("AccountClass").isNull(), "AccountClass", "AccountGroup")).alias("c"))
        .select("AccountNo", "c.AccountClass", "c.AccountGroup")
    )
    source = F.when(F.col("AccountClass").isNotNull(), "chart of accounts").otherwise("keyword guess")
    return totals.join(known, "AccountNo", "left").withColumn("Source", source)


def chart_duplicates(chart: DataFrame) -> DataFrame:
    return (
        chart.groupBy(F.trim(F.col("AccountNo").cast("string")).alias("AccountNo"))
        .agg(F.count(F.lit(1)).alias("Rows"))
        .filter("Rows > 1")
    )


def fill_guesses(accounts: DataFrame) -> DataFrame:
    """Class and group by keyword for the accounts that have no class yet."""
    classes = F.array(*[F.lit(c) for _, c, _ in KEYWORD_RULES], F.lit(DEFAULT_CLASS[0]))
    groups = F.array(*[F.lit(g) for _, _, g in KEYWORD_RULES], F.lit(DEFAULT_CLASS[1]))
    missing = F.col("AccountClass").isNull()
    group = F.element_at(groups, F.col("_rule"))
    vat_asset = (group == VAT_GROUP) & F.col("_text").rlike("|".join(VAT_ASSET_WORDS))
    guess = F.when(vat_asset, "Asset").otherwise(F.element_at(classes, F.col("_rule")))
    return (
        accounts.withColumn("_text", clean_name(F.col("AccountName")))
        .withColumn("_rule", rule_number(F.col("_text")))
        .withColumns(
            {
                "AccountGroup": F.when(missing, group).otherwise(F.col("AccountGroup")),
                "AccountClass": F.coalesce(F.col("AccountClass"), guess),
            }
        )
        .drop("_text", "_rule")
    )


def with_overrides(accounts: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Replace class and group of the accounts named in ``overrides`` (AccountNo, AccountClass, AccountGroup)."""
    if overrides is None:
        return accounts
    edits = overrides.groupBy("AccountNo").agg(
        F.max(F.struct("AccountClass", "AccountGroup")).alias("_edit")
    )
    edited = F.col("_edit").isNotNull()
    return (
        accounts.join(edits, "AccountNo", "left")
        .withColumns(
            {
                "AccountClass": F.when(edited, F.col("_edit.AccountClass")).otherwise(F.col("AccountClass")),
                "AccountGroup": F.when(edited, F.col("_edit.AccountGroup")).otherwise(F.col("AccountGroup")),
                "Source": F.when(edited, "your edit").otherwise(F.col("Source")),
            }
        )
        .drop("_edit")
    )


def classify_accounts(
    lines: DataFrame,
    chart: DataFrame | None = None,
    overrides: DataFrame | None = None,
    cfg: LedgerSettings = LedgerSettings(),
) -> DataFrame:
    """The account dimension: totals, class and group, where they come from, and whether it is cash or bank."""
    accounts = with_overrides(fill_guesses(with_chart(account_totals(lines, cfg), chart)), overrides)
    return accounts.select(
        "AccountNo", "AccountName", "Lines", "Debits", "Credits", "AccountClass", "AccountGroup", "Source",
        or_false(F.col("AccountGroup") == CASH_GROUP).alias("IsLiquid"),
    )
