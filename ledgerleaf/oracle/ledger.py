"""Independent SQL statements of the ledger results (DuckDB dialect, money as integer cents)."""

from __future__ import annotations

from ledgerleaf import dims, fixtures


def _text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def values_cte(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) or v is None else repr(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


_NAMES = [
    *fixtures.ACCOUNT_NAMES.items(),
    *[(str(9000 + i), n) for i, n in enumerate(fixtures.UNLISTED_ACCOUNTS)],
    fixtures.SUSPENSE_ACCOUNT,
]

HEADS = """
sales AS (SELECT o_orderkey AS k, o_orderdate AS d, c_name AS cp, CAST(round(o_totalprice * 100) AS BIGINT) AS g
          FROM orders JOIN customer ON o_custkey = c_custkey),
bills AS (SELECT l_orderkey AS k, max(l_shipdate) AS d, 'Supplier#' || lpad(CAST(min(l_suppkey) AS VARCHAR), 9, '0') AS cp,
                 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS g
          FROM lineitem GROUP BY l_orderkey),
heads AS (
  SELECT 0 AS fam, CASE WHEN k % 10 = 0 THEN 'CS' ELSE 'SI' END AS kind, k, 'SI-' || k AS pid, d, cp, g, CAST(NULL AS VARCHAR) AS ref FROM sales
  UNION ALL SELECT 1, 'CR', k, 'CR-' || k, d + to_days(CAST(k % 75 AS INTEGER)), cp, g,
         CASE WHEN k % 101 = 0 THEN 'PI-' ELSE 'SI-' END || k FROM sales WHERE k % 10 <> 0 AND k % 4 <> 0
  UNION ALL SELECT 2, 'SI', k, 'SI-' || k || '-D', d, cp, g, NULL FROM sales WHERE k % 250 = 3
  UNION ALL SELECT 3, 'PI', k, 'PI-' || k, d, cp, g, NULL FROM bills
  UNION ALL SELECT 4, 'SP', k, 'SP-' || k, d + to_days(CAST(k % 60 AS INTEGER)), cp, g,
         CASE WHEN k % 103 = 0 THEN 'SI-' ELSE 'PI-' END || k FROM bills WHERE k % 3 <> 0
  UNION ALL SELECT 5, 'OE', p_partkey, 'OE-' || p_partkey, TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 2400 AS INTEGER)), NULL,
         CAST(round(p_retailprice * 100) AS BIGINT), NULL FROM part
  UNION ALL SELECT 6, 'PR', year(d) * 12 + month(d), 'PR-' || strftime(d, '%Y%m'), CAST(d AS TIMESTAMP), NULL, 2500000, NULL
         FROM (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS d FROM orders)
  UNION ALL SELECT 7, 'AJ', c_custkey, 'AJ-' || c_custkey,
         CASE WHEN c_custkey % 40 <> 7 THEN TIMESTAMP '1995-06-01' + to_days(CAST(c_custkey % 2000 AS INTEGER)) END, NULL,
         10000 + (c_custkey * 37) % 90000, NULL FROM customer),
ext AS (SELECT *, g * 19 // 119 AS vat,
   CASE WHEN k % 50 <> 49 THEN CASE WHEN k % 89 = 0 THEN d + to_days(3) ELSE d - to_days(CAST(k % 6 AS INTEGER)) END END AS dd,
   d + to_days(CAST((k * 7) % CASE WHEN k % 13 = 0 THEN 45 ELSE 9 END AS INTEGER)) + to_hours(6 + k % 15) AS et,
   CASE WHEN k % 113 <> 0 THEN 'U' || (k % 7) END AS usr FROM heads),
raw AS (
  SELECT *, 0 AS pos, '1400' AS acc, g AS dr, 0 AS cr FROM ext WHERE kind = 'SI'
  UNION ALL SELECT *, 0, '1000', g, 0 FROM ext WHERE kind = 'CS'
  UNION ALL SELECT *, 1, '8400', 0, g - vat - CASE WHEN k % 97 = 0 THEN 500 ELSE 0 END FROM ext WHERE kind IN ('SI', 'CS')
  UNION ALL SELECT *, 2, '1776', 0, vat FROM ext WHERE kind IN ('SI', 'CS')
  UNION ALL SELECT *, 0, CASE WHEN k % 5 = 1 THEN '1000' ELSE '1100' END, g, 0 FROM ext WHERE kind = 'CR'
  UNION ALL SELECT *, 1, '1400', 0, g FROM ext WHERE kind = 'CR'
  UNION ALL SELECT *, 0, '3400', g - vat, 0 FROM ext WHERE kind = 'PI'
  UNION ALL SELECT *, 1, '1576', vat, 0 FROM ext WHERE kind = 'PI'
  UNION ALL SELECT *, 2, '1600', 0, g FROM ext WHERE kind = 'PI'
  UNION ALL SELECT *, 0, '1600', g, 0 FROM ext WHERE kind = 'SP'
  UNION ALL SELECT *, 1, CASE WHEN k % 11 = 0 THEN '1000' ELSE '1100' END, 0, g FROM ext WHERE kind = 'SP'
  UNION ALL SELECT *, 0, CASE WHEN k % 400 = 0 THEN '4950'
      ELSE (['4210', '4240', '4250', '4260', '4360', '4580', '4600', '4930'])[k % 8 + 1] END, g, 0 FROM ext WHERE kind = 'OE'
  UNION ALL SELECT *, 1, CASE WHEN k % 4 = 0 THEN '1000' ELSE '1100' END, 0, g FROM ext WHERE kind = 'OE'
  UNION ALL SELECT *, 0, '4120', g * 4 // 5, 0 FROM ext WHERE kind = 'PR'
  UNION ALL SELECT *, 1, '4130', g - g * 4 // 5, 0 FROM ext WHERE kind = 'PR'
  UNION ALL SELECT *, 2, '1200', 0, g FROM ext WHERE kind = 'PR'
  UNION ALL SELECT *, 0, CAST(9000 + k % 24 AS VARCHAR), g + CASE WHEN k % 45 = 13 THEN 500 ELSE 0 END,
      CASE WHEN k % 45 = 13 THEN 500 ELSE 0 END FROM ext WHERE kind = 'AJ'
  UNION ALL SELECT *, 1, CASE WHEN k % 60 <> 11 THEN '9990' END, 0, CASE WHEN k % 30 = 17 THEN 2 * g ELSE g END FROM ext WHERE kind = 'AJ'
  UNION ALL SELECT *, 2, CAST(9000 + k % 24 AS VARCHAR), g + CASE WHEN k % 45 = 13 THEN 500 ELSE 0 END,
      CASE WHEN k % 45 = 13 THEN 500 ELSE 0 END FROM ext WHERE kind = 'AJ' AND k % 30 = 17),
"""

LINES = (
    values_cte("names", "no, nm", _NAMES)
    + ","
    + HEADS
    + """
lines AS (SELECT (k * 8 + fam) * 4 + pos AS LineNo, pid AS PostingID, d AS PostingDate, dd AS DocumentDate, et AS EnteredDateTime,
          acc AS AccountNo, nm AS AccountName, CAST(dr AS BIGINT) AS dr, CAST(cr AS BIGINT) AS cr, usr AS UserID, cp AS Counterparty,
          ref AS RefPostingID FROM raw LEFT JOIN names ON acc = no)"""
)

# The keyword rules as one ordered CASE over the cleaned name.
GUESS = """
CASE
 WHEN regexp_matches(t, 'receivable|debtors') THEN 'Asset|Receivables'
 WHEN regexp_matches(t, 'vat|gst|sales tax|input tax|tax payable|hst') THEN
   CASE WHEN regexp_matches(t, 'input|deductible|receivable|recoverable') THEN 'Asset' ELSE 'Liability' END || '|VAT / sales tax'
 WHEN regexp_matches(t, 'payable|creditors') THEN 'Liability|Payables'
 WHEN regexp_matches(t, 'cash|bank|petty|checking|savings|current account') THEN 'Asset|Cash & bank'
 WHEN regexp_matches(t, 'cost of|purchase|cogs|merchandise|goods sold') THEN 'Expense|Cost of goods'
 WHEN regexp_matches(t, 'salar|wage|payroll|social security|pension') THEN 'Expense|Personnel'
 WHEN regexp_matches(t, 'revenue|sales|income|fees earned|turnover') THEN 'Revenue|Revenue'
 WHEN regexp_matches(t, 'loan|credit card|mortgage|accrued') THEN 'Liability|Other liabilities'
 WHEN regexp_matches(t, 'equity|capital|retained|drawings|owner') THEN 'Equity|Equity'
 WHEN regexp_matches(t, 'inventory|stock|equipment|furniture|deposit|prepaid|fixed asset') THEN 'Asset|Other assets'
 ELSE 'Expense|Other operating' END"""
CLEAN = (
    "regexp_replace(regexp_replace(lower(coalesce(AccountName, '')), '\\(.*?\\)', ' ', 'g'), "
    "',?\\s*\\d+(\\.\\d+)?\\s*%\\s*(vat|input tax|tax|gst)?', ' ', 'g')"
)

_chart = values_cte("chart", "no, cls, grp", [(r[0], r[2], r[3]) for r in dims.CHART])


def accounts(chart: bool = True, overrides: str = "") -> str:
    source = _chart if chart else "chart AS (SELECT CAST('' AS VARCHAR) AS no, CAST('' AS VARCHAR) AS cls, CAST('' AS VARCHAR) AS grp WHERE false)"
    edits = overrides or "edits AS (SELECT CAST('' AS VARCHAR) AS no, CAST('' AS VARCHAR) AS cls, CAST('' AS VARCHAR) AS grp WHERE false)"
    return f"""{source}, {edits},
totals AS (SELECT AccountNo, min(AccountName) AS AccountName, count(*) AS Lines, CAST(sum(dr) AS BIGINT) AS dr, CAST(sum(cr) AS BIGINT) AS cr
           FROM lines WHERE AccountNo IS NOT NULL GROUP BY AccountNo),
guessed AS (SELECT *, {GUESS} AS gs FROM (SELECT *, {CLEAN} AS t FROM totals)),
accounts AS (SELECT a.AccountNo, AccountName, Lines, dr, cr,
   coalesce(e.cls, c.cls, split_part(gs, '|', 1)) AS AccountClass,
   CASE WHEN e.no IS NOT NULL THEN e.grp WHEN c.cls IS NOT NULL THEN c.grp ELSE split_part(gs, '|', 2) END AS AccountGroup,
   CASE WHEN e.no IS NOT NULL THEN 'your edit' WHEN c.cls IS NOT NULL THEN 'chart of accounts' ELSE 'keyword guess' END AS Source
   FROM guessed a LEFT JOIN chart c ON a.AccountNo = c.no LEFT JOIN edits e ON a.AccountNo = e.no)"""


POSTINGS = """
enriched AS (SELECT l.*, AccountClass, AccountGroup, coalesce(AccountGroup = 'Cash & bank', false) AS liq,
   coalesce(lower(l.AccountName) LIKE '%cash%' OR lower(l.AccountName) LIKE '%petty%', false) AS csh
   FROM lines l LEFT JOIN accounts a ON l.AccountNo = a.AccountNo),
rolled AS (SELECT PostingID, min(PostingDate) AS PostingDate, min(DocumentDate) AS DocumentDate, min(EnteredDateTime) AS EnteredDateTime,
   min(UserID) AS UserID, min(Counterparty) AS Counterparty, min(RefPostingID) AS RefPostingID,
   arg_min(AccountName, LineNo) FILTER (WHERE AccountName IS NOT NULL) AS FirstAccountName,
   count(*) AS LineCount, CAST(sum(dr) AS BIGINT) AS dr, CAST(sum(cr) AS BIGINT) AS cr,
   coalesce(bool_or(dr > 0 AND AccountGroup = 'Payables'), false) AS DrAP, coalesce(bool_or(cr > 0 AND AccountGroup = 'Payables'), false) AS CrAP,
   coalesce(bool_or(dr > 0 AND AccountGroup = 'Receivables'), false) AS DrAR, coalesce(bool_or(cr > 0 AND AccountGroup = 'Receivables'), false) AS CrAR,
   bool_or(dr > 0 AND liq) AS DrLiquid, bool_or(cr > 0 AND liq) AS CrLiquid,
   coalesce(bool_or(cr > 0 AND AccountClass = 'Revenue'), false) AS CrRevenue, coalesce(bool_or(dr > 0 AND AccountClass = 'Expense'), false) AS DrExpense,
   coalesce(bool_or(AccountGroup = 'Personnel'), false) AS Personnel,
   CAST(sum(CASE WHEN liq THEN dr + cr ELSE 0 END) AS BIGINT) AS liqamt, bool_or(csh) AS TouchesCash,
   CAST(sum(CASE WHEN csh THEN dr + cr ELSE 0 END) AS BIGINT) AS cshamt
   FROM enriched GROUP BY PostingID),
typed AS (SELECT *, CASE WHEN CrAP AND DrExpense THEN 'Purchase invoice' WHEN CrRevenue AND DrAR THEN 'Sales invoice'
   WHEN CrRevenue THEN 'Cash sale' WHEN DrAP AND CrLiquid THEN 'Supplier payment' WHEN CrAR AND DrLiquid THEN 'Customer receipt'
   WHEN Personnel THEN 'Payroll' WHEN DrExpense THEN 'Operating expense' ELSE 'Other' END AS PostingType,
   CAST(floor((epoch(date_trunc('day', EnteredDateTime)) - epoch(coalesce(DocumentDate, PostingDate))) / 86400.0) AS INTEGER) AS LagDays
   FROM rolled),
postings AS (SELECT *, LagDays IS NOT NULL AS HasLag, dr - cr AS imb,
   CASE WHEN LagDays <= 3 THEN '0-3 days' WHEN LagDays <= 7 THEN '4-7 days' WHEN LagDays <= 14 THEN '8-14 days'
        WHEN LagDays <= 30 THEN '15-30 days' WHEN LagDays <= 100000 THEN '31+ days' END AS LagBand,
   coalesce(LagDays <= 7, false) AS IsOnTime, CAST(hour(EnteredDateTime) AS INTEGER) AS EnteredHour, dayname(EnteredDateTime) AS EnteredWeekday,
   coalesce(isodow(EnteredDateTime) >= 6, false) AS IsWeekend,
   coalesce(hour(EnteredDateTime) < 8 OR hour(EnteredDateTime) >= 17, false) AS IsAfterHours,
   CAST(year(PostingDate) AS INTEGER) AS Year, strftime(PostingDate, '%Y-%m') AS YearMonth,
   coalesce(last_day(CAST(PostingDate AS DATE)) - CAST(PostingDate AS DATE) <= 4, false) AS IsMonthEndWeek
   FROM typed)"""

FLAGS = """
rare AS (SELECT AccountNo, CAST(year(PostingDate) AS INTEGER) AS Year, count(DISTINCT PostingID) AS Postings FROM lines
   WHERE AccountNo IS NOT NULL AND PostingDate IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT PostingID) <= 5),
raretouch AS (SELECT PostingID, min(l.AccountNo) AS RareAccount, count(DISTINCT l.AccountNo) AS RareAccounts
   FROM lines l JOIN rare r ON l.AccountNo = r.AccountNo AND year(l.PostingDate) = r.Year GROUP BY PostingID),
flags AS (
  SELECT PostingID, PostingDate, PostingType, UserID, dr AS amt, 'Unbalanced entry' AS Test,
     'Debits differ from credits by ' || (abs(imb) // 100) || '.' ||
        CASE WHEN abs(imb) % 10 = 0 THEN CAST((abs(imb) % 100) // 10 AS VARCHAR) ELSE lpad(CAST(abs(imb) % 100 AS VARCHAR), 2, '0') END AS Detail
     FROM postings WHERE imb <> 0
  UNION ALL SELECT PostingID, PostingDate, PostingType, UserID, dr, 'Large amount through cash', 'Cash-account movement above 1,500'
     FROM postings WHERE TouchesCash AND cshamt > 150000
  UNION ALL SELECT PostingID, PostingDate, PostingType, UserID, dr, 'Possible duplicate', 'Same date, amount, type and counterparty as another entry'
     FROM (SELECT *, count(*) OVER (PARTITION BY PostingDate, dr, PostingType, Counterparty) AS n FROM postings)
     WHERE n > 1 AND dr > 0 AND Counterparty IS NOT NULL
  UNION ALL SELECT PostingID, PostingDate, PostingType, UserID, dr, 'Back-dated entry', 'Posting date is earlier than the document date'
     FROM postings WHERE PostingDate < DocumentDate
  UNION ALL SELECT PostingID, PostingDate, PostingType, UserID, dr, 'Rarely used account',
     'Account with few postings in the year: ' || coalesce(FirstAccountName, '') FROM postings WHERE PostingID IN (SELECT PostingID FROM raretouch)
  UNION ALL SELECT PostingID, PostingDate, PostingType, UserID, dr, 'Weekend / after-hours on cash or bank',
     CASE WHEN IsWeekend THEN 'Entered on a weekend' ELSE 'Entered outside working hours' END
     FROM postings WHERE (IsWeekend OR IsAfterHours) AND liqamt > 150000
  UNION ALL SELECT PostingID, PostingDate, PostingType, UserID, dr, 'Very late entry', 'Keyed ' || LagDays || ' days after the document date'
     FROM postings WHERE LagDays > 30
  UNION ALL SELECT p.PostingID, p.PostingDate, p.PostingType, p.UserID, p.dr, 'Payment cleared against wrong invoice',
     'Payment references an invoice of the opposite type' FROM postings p JOIN postings q ON p.RefPostingID = q.PostingID
     WHERE (p.PostingType = 'Supplier payment' AND q.PostingType = 'Sales invoice')
        OR (p.PostingType = 'Customer receipt' AND q.PostingType = 'Purchase invoice')),
flagged AS (SELECT DISTINCT PostingID, PostingDate, PostingType, UserID, amt FROM flags)"""

_INV = """
inv AS (SELECT PostingID, PostingType, PostingDate, DocumentDate, dr AS amt, Counterparty, coalesce(DocumentDate, PostingDate) AS InvoiceDate,
   CASE WHEN PostingType = 'Purchase invoice' THEN 'Supplier (AP)' ELSE 'Customer (AR)' END AS CounterpartyType
   FROM postings WHERE PostingType IN ('Purchase invoice', 'Sales invoice')),
pay AS (SELECT PostingID AS PaymentID, PostingDate AS PaymentDate, TouchesCash, dr AS amt, Counterparty, RefPostingID
   FROM postings WHERE PostingType IN ('Supplier payment', 'Customer receipt')),"""
_AGED = """
matched AS (SELECT inv.*, m.PaymentID, m.PaymentDate, m.TouchesCash FROM inv LEFT JOIN m ON inv.PostingID = m.PostingID),
settled AS (SELECT *, PaymentID IS NOT NULL AS IsSettled,
   CAST(floor((epoch(PaymentDate) - epoch(InvoiceDate)) / 86400.0) AS INTEGER) AS DaysToSettle,
   CAST(floor((epoch((SELECT max(PostingDate) FROM postings)) - epoch(InvoiceDate)) / 86400.0) AS INTEGER) AS AgeAtPeriodEnd,
   CASE WHEN PaymentID IS NULL THEN 'Open' WHEN coalesce(TouchesCash, false) THEN 'Cash' ELSE 'Bank' END AS PaidVia FROM matched),
settlements AS (SELECT *, CASE WHEN AgeAtPeriodEnd <= -1 THEN NULL WHEN AgeAtPeriodEnd <= 30 THEN '0-30' WHEN AgeAtPeriodEnd <= 60 THEN '31-60'
   WHEN AgeAtPeriodEnd <= 90 THEN '61-90' WHEN AgeAtPeriodEnd <= 100000 THEN '90+' END AS AgeBucket FROM settled)"""

SETTLE_EXACT = (
    _INV
    + """
m AS (SELECT RefPostingID AS PostingID, PaymentID, PaymentDate, TouchesCash FROM (SELECT *, row_number() OVER
   (PARTITION BY RefPostingID ORDER BY PaymentDate NULLS LAST, PaymentID) AS rn FROM pay WHERE RefPostingID IS NOT NULL) WHERE rn = 1),"""
    + _AGED
)

# First in, first out: number the invoices and payments per (counterparty, amount), then k = i + running max(lb - i).
SETTLE_FIFO = (
    _INV
    + """
iv AS (SELECT PostingID, Counterparty, amt, InvoiceDate - INTERVAL 5 DAY AS ts,
   row_number() OVER (PARTITION BY Counterparty, amt ORDER BY InvoiceDate, PostingID) - 1 AS i
   FROM inv WHERE Counterparty IS NOT NULL AND InvoiceDate IS NOT NULL),
pv AS (SELECT *, row_number() OVER (PARTITION BY Counterparty, amt ORDER BY PaymentDate, PaymentID) - 1 AS p
   FROM pay WHERE Counterparty IS NOT NULL AND PaymentDate IS NOT NULL),
lb AS (SELECT iv.PostingID, iv.Counterparty, iv.amt, iv.i, count(pv.PaymentID) AS lb FROM iv LEFT JOIN pv
   ON iv.Counterparty = pv.Counterparty AND iv.amt = pv.amt AND pv.PaymentDate < iv.ts GROUP BY ALL),
kk AS (SELECT *, i + max(lb - i) OVER (PARTITION BY Counterparty, amt ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM lb),
m AS (SELECT kk.PostingID, pv.PaymentID, pv.PaymentDate, pv.TouchesCash FROM kk JOIN pv
   ON kk.Counterparty = pv.Counterparty AND kk.amt = pv.amt AND kk.k = pv.p),"""
    + _AGED
)

QUALITY = """
dupkeys AS (SELECT *, count(*) OVER (PARTITION BY PostingID, AccountNo, dr, cr) AS n FROM lines),
duplines AS (SELECT * FROM dupkeys WHERE n > 1)"""


def with_lines(select: str) -> str:
    return f"WITH {LINES}\n{select}"


def with_accounts(select: str, chart: bool = True, overrides: str = "") -> str:
    return f"WITH {LINES}, {accounts(chart, overrides)}\n{select}"


def with_postings(select: str, *more: str) -> str:
    parts = [LINES, accounts(), POSTINGS, *more]
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + select


MONEY = "CAST({0} AS DOUBLE) / 100.0 AS {1}"


def money(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) / 100.0 AS {name}"


ACCOUNT_ROW = f"AccountNo, AccountName, Lines, {money('dr', 'Debits')}, {money('cr', 'Credits')}, AccountClass, AccountGroup, Source, AccountGroup = 'Cash & bank' AS IsLiquid"
FLAG_ROW = f"PostingID, PostingDate, PostingType, UserID, {money('amt', 'PostingAmount')}, Test, Detail"
SETTLE_ROW = (
    f"PostingID, PostingType, PostingDate, DocumentDate, {money('amt', 'PostingAmount')}, Counterparty, InvoiceDate, CounterpartyType, "
    "PaymentID, PaymentDate, TouchesCash, IsSettled, DaysToSettle, AgeAtPeriodEnd, AgeBucket, PaidVia"
)
SLICE = (
    "slice AS (SELECT * FROM postings WHERE PostingDate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' "
    "AND PostingType IN ('Sales invoice', 'Purchase invoice', 'Customer receipt', 'Operating expense') "
    "AND (UserID IN ('U1', 'U2', 'U3') OR UserID IS NULL))"
)


def rate(cond: str, name: str) -> str:
    return f"round(avg(CAST({cond} AS INTEGER)), 6) AS {name}"


def ratio(a: str, b: str, name: str) -> str:
    return f"round(CAST({a} AS DOUBLE) / CAST(nullif({b}, 0) AS DOUBLE), 6) AS {name}"


_TIMING = ", ".join(
    [
        "count(*) AS Postings", money("sum(dr)", "TotalDebits"), "round(avg(LagDays), 6) AS AvgLagDays",
        rate("IsOnTime", "OnTimeRate_all"), rate("CASE WHEN HasLag THEN IsOnTime END", "OnTimeRate_known"),
        rate("IsWeekend", "WeekendRate_all"), rate("CASE WHEN EnteredDateTime IS NOT NULL THEN IsWeekend END", "WeekendRate_known"),
        rate("IsAfterHours", "AfterHoursRate_all"),
        rate("CASE WHEN EnteredDateTime IS NOT NULL THEN IsAfterHours END", "AfterHoursRate_known"),
    ]
)


def flags_of(test: str, extra: str = "") -> str:
    return with_postings(f"SELECT {FLAG_ROW}{extra} FROM flags WHERE Test = '{test}'", FLAGS)


def _checked(no: int, name: str, note: str, count: str) -> str:
    return f"SELECT {no} AS CheckOrder, '{name}' AS \"Check\", {count} AS Count, '{note}' AS Note"


_DETAIL = "CAST({pid} AS VARCHAR) AS PostingID, CAST({ln} AS BIGINT) AS LineNo, CAST({no} AS VARCHAR) AS AccountNo, CAST({nm} AS VARCHAR) AS AccountName, CAST({dt} AS TIMESTAMP) AS PostingDate, CAST({am} AS DOUBLE) / 100.0 AS Amount, CAST({dr} AS DOUBLE) / 100.0 AS Debit, CAST({cr} AS DOUBLE) / 100.0 AS Credit"


def _detail(check: str, source: str, **cols: str) -> str:
    base = dict(pid="NULL", ln="NULL", no="NULL", nm="NULL", dt="NULL", am="NULL", dr="NULL", cr="NULL") | cols
    return f"SELECT '{check}' AS \"Check\", {_DETAIL.format(**base)} FROM {source}"


_LINE_COLS = dict(pid="PostingID", ln="LineNo", nm="AccountName", dr="dr", cr="cr")
_NO_ACCOUNT_COLS = dict(pid="PostingID", ln="LineNo", dt="PostingDate", dr="dr", cr="cr")
_OPEN = "CASE WHEN NOT IsSettled THEN amt END"

FINDINGS = """
cand AS (
 SELECT 0 AS o, 'unbalanced_entries' AS Code, CAST(NULL AS VARCHAR) AS Subject, count(*) AS Count, CAST(NULL AS DOUBLE) AS Amount,
    CAST(NULL AS DOUBLE) AS Share, CAST(NULL AS DOUBLE) AS Value FROM postings WHERE imb <> 0 HAVING count(*) > 0
 UNION ALL SELECT 1, 'late_entries', NULL, count(*) FILTER (WHERE NOT IsOnTime), NULL,
    round(CAST(count(*) FILTER (WHERE NOT IsOnTime) AS DOUBLE) / count(*), 6), round(avg(LagDays), 6) FROM postings WHERE HasLag HAVING count(*) > 0
 UNION ALL SELECT 2, 'flagged_entries', (SELECT string_agg(Test || ' (' || n || ')', '; ' ORDER BY n DESC, Test) FROM
    (SELECT Test, count(*) AS n FROM flags GROUP BY Test ORDER BY n DESC, Test LIMIT 3)), count(*), CAST(sum(amt) AS DOUBLE) / 100.0,
    round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM postings), 6), NULL FROM flagged HAVING count(*) > 0
 UNION ALL SELECT * FROM (SELECT 3, 'highest_flag_rate_preparer', UserID, n, NULL, round(CAST(f AS DOUBLE) / n, 6) AS r,
    round(CAST(n AS DOUBLE) / (SELECT count(*) FROM postings), 6)
    FROM (SELECT UserID, count(*) AS n FROM postings GROUP BY UserID) JOIN (SELECT UserID, count(*) AS f FROM flagged GROUP BY UserID) USING (UserID)
    ORDER BY r DESC, UserID LIMIT 1)
 UNION ALL SELECT 4, 'open_invoices', NULL, count(*), CAST(sum(amt) AS DOUBLE) / 100.0, NULL,
    CAST(count(*) FILTER (WHERE AgeBucket = '90+') AS DOUBLE) FROM settlements WHERE NOT IsSettled HAVING count(*) > 0
 UNION ALL SELECT 5, 'cash_share_of_invoices', NULL, count(*) FILTER (WHERE PaidVia = 'Cash'), NULL,
    round(avg(CAST(PaidVia = 'Cash' AS INTEGER)), 6), NULL FROM settlements HAVING avg(CAST(PaidVia = 'Cash' AS INTEGER)) > 0.1)"""


def _reports() -> dict[str, str]:
    p, a, ln = with_postings, with_accounts, with_lines
    edits = values_cte("edits", "no, cls, grp", [("4600", "Asset", "Cash & bank"), ("9990", "Equity", "Equity")])
    days = "(VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) AS w(DayOrder, EnteredWeekday)"
    head_cols = "PostingID, PostingDate, DocumentDate, EnteredDateTime, UserID, Counterparty, RefPostingID, FirstAccountName, LineCount"
    feats = "DrAP, CrAP, DrAR, CrAR, DrLiquid, CrLiquid, CrRevenue, DrExpense, Personnel, TouchesCash"
    sums = ", ".join(
        money(e, n)
        for e, n in [("dr", "Debits"), ("cr", "Credits"), ("liqamt", "LiquidAmount"), ("cshamt", "CashAmount"), ("dr", "PostingAmount"), ("imb", "Imbalance")]
    )
    exact = SETTLE_EXACT
    return {
        "gl_journal_lines": ln(f"SELECT * EXCLUDE (dr, cr), CAST(NULL AS VARCHAR) AS LineText, {money('dr', 'Debit')}, {money('cr', 'Credit')} FROM lines"),
        "gl_accounts": ln(f"SELECT AccountNo, min(AccountName) AS AccountName, count(*) AS Lines, {money('sum(dr)', 'Debits')}, {money('sum(cr)', 'Credits')} FROM lines WHERE AccountNo IS NOT NULL GROUP BY AccountNo"),
        "gl_classify_accounts": a(f"SELECT {ACCOUNT_ROW} FROM accounts", chart=False),
        "gl_chart_join": a(f"SELECT {ACCOUNT_ROW} FROM accounts"),
        "gl_account_overrides": a(f"SELECT {ACCOUNT_ROW} FROM accounts", overrides=edits),
        "gl_enriched_lines": p(f"SELECT PostingID, LineNo, AccountNo, {money('dr', 'Debit')}, {money('cr', 'Credit')}, AccountClass, AccountGroup, CASE WHEN AccountGroup IS NOT NULL THEN liq END AS IsLiquid FROM enriched"),
        "gl_postings": p(f"SELECT {head_cols}, {feats}, {sums}, imb = 0 AS IsBalanced FROM postings"),
        "gl_dq_oversized": with_lines("""SELECT PostingID, min(PostingDate) AS PostingDate, CAST(CAST(sum(dr) AS HUGEINT) * 10000000000 AS DOUBLE) AS Debits,
            CAST(CAST(sum(cr) AS HUGEINT) * 10000000000 AS DOUBLE) AS Credits FROM lines WHERE LineNo // 32 % 1000 = 0
            GROUP BY PostingID HAVING sum(dr) >= 1000000 OR abs(sum(dr) - sum(cr)) >= 1000000"""),
        "gl_posting_types": p("SELECT PostingID, PostingType FROM postings"),
        "gl_timeliness": p("SELECT PostingID, LagDays, HasLag, LagBand, IsOnTime, EnteredHour, EnteredWeekday, IsWeekend, IsAfterHours, Year, YearMonth, IsMonthEndWeek FROM postings"),
        "gl_test_unbalanced": flags_of("Unbalanced entry"),
        "gl_test_large_cash": flags_of("Large amount through cash"),
        "gl_test_duplicate": flags_of("Possible duplicate"),
        "gl_test_backdated": flags_of("Back-dated entry"),
        "gl_test_rare_account": p(f"SELECT {FLAG_ROW}, RareAccount, RareAccounts FROM flags JOIN raretouch USING (PostingID) WHERE Test = 'Rarely used account'", FLAGS),
        "gl_test_off_hours": flags_of("Weekend / after-hours on cash or bank"),
        "gl_test_very_late": flags_of("Very late entry"),
        "gl_test_wrong_invoice": flags_of("Payment cleared against wrong invoice"),
        "gl_rare_account_years": p("SELECT AccountNo, Year, Postings FROM rare", FLAGS),
        "gl_flags": p(f"SELECT {FLAG_ROW} FROM flags", FLAGS),
        "gl_tests_skipped": p("""SELECT Test, NeedsColumn, v AS "Values", v = 0 AS IsSkipped FROM (
            SELECT 'Possible duplicate' AS Test, 'Counterparty' AS NeedsColumn, count(Counterparty) AS v FROM slice
            UNION ALL SELECT 'Back-dated entry', 'DocumentDate', count(DocumentDate) FROM slice
            UNION ALL SELECT 'Weekend / after-hours on cash or bank', 'EnteredDateTime', count(EnteredDateTime) FROM slice
            UNION ALL SELECT 'Very late entry', 'EnteredDateTime', count(EnteredDateTime) FROM slice
            UNION ALL SELECT 'Payment cleared against wrong invoice', 'RefPostingID', count(RefPostingID) FROM slice)""", SLICE),
        "gl_ref_type": p(f"SELECT p.PostingID, p.PostingDate, p.PostingType, p.UserID, {money('p.dr', 'PostingAmount')}, p.RefPostingID, q.PostingType AS RefType FROM postings p LEFT JOIN postings q ON p.RefPostingID = q.PostingID WHERE p.RefPostingID IS NOT NULL"),
        "gl_slice": p(f"SELECT PostingID, PostingDate, PostingType, UserID, {money('dr', 'PostingAmount')} FROM slice", SLICE),
        "gl_slice_semi": p(f"SELECT {FLAG_ROW} FROM flags WHERE PostingID IN (SELECT PostingID FROM slice)", FLAGS, SLICE),
        "gl_slice_values": p("SELECT DISTINCT 'UserID' AS Field, UserID AS Value FROM postings WHERE UserID IS NOT NULL UNION ALL SELECT DISTINCT 'PostingType', PostingType FROM postings"),
        "gl_settle_exact": p(f"SELECT {SETTLE_ROW} FROM settlements", exact),
        "gl_settle_fifo": p(f"SELECT {SETTLE_ROW} FROM settlements", SETTLE_FIFO),
        "gl_aging": p("SELECT PostingID, InvoiceDate, AgeAtPeriodEnd, AgeBucket, DaysToSettle, PaidVia FROM settlements", exact),
        "gl_dq_unbalanced": p(f"SELECT PostingID, PostingDate, {money('imb', 'Imbalance')} FROM postings WHERE imb <> 0"),
        "gl_dq_no_date": ln(f"SELECT LineNo, PostingID, AccountName, {money('dr', 'Debit')}, {money('cr', 'Credit')} FROM lines WHERE PostingDate IS NULL"),
        "gl_dq_no_account": ln(f"SELECT LineNo, PostingID, PostingDate, {money('dr', 'Debit')}, {money('cr', 'Credit')} FROM lines WHERE AccountName IS NULL"),
        "gl_dq_two_sided": ln(f"SELECT LineNo, PostingID, AccountName, {money('dr', 'Debit')}, {money('cr', 'Credit')} FROM lines WHERE dr > 0 AND cr > 0"),
        "gl_dq_guessed_accounts": a("SELECT AccountNo, AccountName, AccountClass, AccountGroup FROM accounts WHERE Source = 'keyword guess'"),
        "gl_dq_no_preparer": p(f"SELECT PostingID, PostingDate, {money('dr', 'PostingAmount')} FROM postings WHERE UserID IS NULL"),
        "gl_dq_duplicate_lines": f"WITH {LINES}, {QUALITY} SELECT LineNo, PostingID, AccountName, {money('dr', 'Debit')}, {money('cr', 'Credit')} FROM duplines",
        "gl_dq_summary": p(
            " UNION ALL ".join(
                [
                    _checked(1, "Unbalanced entries", "Debits and credits differ within one entry", "(SELECT count(*) FROM postings WHERE imb <> 0)"),
                    _checked(2, "Lines with no date", "Date missing or unreadable", "(SELECT count(*) FROM lines WHERE PostingDate IS NULL)"),
                    _checked(3, "Lines with no account", "Account blank", "(SELECT count(*) FROM lines WHERE AccountName IS NULL)"),
                    _checked(4, "Lines with both debit and credit", "A line should carry one side only", "(SELECT count(*) FROM lines WHERE dr > 0 AND cr > 0)"),
                    _checked(5, "Accounts classified by keyword guess", "Review these classes in the expander below", "(SELECT count(*) FROM accounts WHERE Source = 'keyword guess')"),
                    _checked(6, "Entries with no preparer", "Workload and user-based tests skip these", "(SELECT count(*) FROM postings WHERE UserID IS NULL)"),
                    _checked(7, "Duplicate lines inside an entry", "Same account and amount repeated within one entry", "(SELECT count(*) FROM duplines)"),
                ]
            ),
            QUALITY,
        ),
        "gl_dq_detail": p(
            " UNION ALL ".join(
                [
                    _detail("Unbalanced entries", "postings WHERE imb <> 0", pid="PostingID", dt="PostingDate", am="imb"),
                    _detail("Lines with no date", "lines WHERE PostingDate IS NULL", **_LINE_COLS),
                    _detail("Lines with no account", "lines WHERE AccountName IS NULL", **_NO_ACCOUNT_COLS),
                    _detail("Lines with both debit and credit", "lines WHERE dr > 0 AND cr > 0", **_LINE_COLS),
                    _detail("Accounts classified by keyword guess", "accounts WHERE Source = 'keyword guess'", no="AccountNo", nm="AccountName"),
                    _detail("Entries with no preparer", "postings WHERE UserID IS NULL", pid="PostingID", dt="PostingDate", am="dr"),
                    _detail("Duplicate lines inside an entry", "duplines", **_LINE_COLS),
                ]
            ),
            QUALITY,
        ),
        "gl_kpis": p(
            f"""SELECT count(*) AS Entries, {money('sum(dr)', 'TotalDebits')}, count(*) FILTER (WHERE imb <> 0) AS Unbalanced,
            round(avg(LagDays), 6) AS AvgLagDays, {rate('CASE WHEN HasLag THEN IsOnTime END', 'OnTimeRate')}, min(PostingDate) AS PeriodStart,
            max(PostingDate) AS PeriodEnd, (SELECT count(*) FROM lines) AS Lines, (SELECT count(*) FROM flagged) AS Flagged,
            round(CAST((SELECT count(*) FROM flagged) AS DOUBLE) / count(*), 6) AS FlaggedShare,
            coalesce((SELECT CAST(sum({_OPEN}) AS DOUBLE) / 100.0 FROM settlements), 0) AS OpenAmount FROM postings""",
            FLAGS, exact,
        ),
        "gl_monthly_flagged": p("SELECT p.YearMonth, count(*) AS Entries, count(f.PostingID) AS Flagged FROM postings p LEFT JOIN flagged f USING (PostingID) GROUP BY 1", FLAGS),
        "gl_by_type": p("SELECT PostingType, count(*) AS Entries FROM postings GROUP BY 1"),
        "gl_month_type": p("SELECT YearMonth, PostingType, count(*) AS Entries FROM postings GROUP BY 1, 2"),
        "gl_by_preparer": p("SELECT UserID, count(*) AS Entries, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS Share FROM postings WHERE UserID IS NOT NULL GROUP BY 1"),
        "gl_month_end_share": p(f"SELECT YearMonth, {rate('IsMonthEndWeek', 'MonthEndShare')} FROM postings GROUP BY 1"),
        "gl_lines_per_entry": p("SELECT LineCount, count(*) AS Entries FROM postings GROUP BY 1"),
        "gl_lag_bands_user": p("SELECT UserID, LagBand, count(*) AS Entries, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY UserID), 6) AS Share FROM postings WHERE HasLag AND UserID IS NOT NULL GROUP BY 1, 2"),
        "gl_lag_bands": p("SELECT BandOrder, b.LagBand, count(p.PostingID) AS Entries FROM (VALUES (1, '0-3 days'), (2, '4-7 days'), (3, '8-14 days'), (4, '15-30 days'), (5, '31+ days')) AS b(BandOrder, LagBand) LEFT JOIN postings p ON p.LagBand = b.LagBand GROUP BY 1, 2"),
        "gl_lag_kpis": p(f"SELECT round(avg(LagDays), 6) AS AvgLagDays, CAST(median(LagDays) AS DOUBLE) AS MedianLagDays, {rate('IsOnTime', 'OnTimeRate')}, {rate('LagDays > 30', 'VeryLateRate')} FROM postings WHERE HasLag"),
        "gl_lag_month": p("SELECT YearMonth, round(avg(LagDays), 6) AS AvgLagDays, CAST(median(LagDays) AS DOUBLE) AS MedianLagDays FROM postings WHERE HasLag GROUP BY 1"),
        "gl_ontime_type": p(f"SELECT PostingType, {rate('IsOnTime', 'OnTimeRate')} FROM postings WHERE HasLag GROUP BY 1"),
        "gl_late_backlog": p(f"SELECT PostingID, PostingType, DocumentDate, EnteredDateTime, UserID, LagDays, {money('dr', 'PostingAmount')} FROM postings WHERE LagDays > 30"),
        "gl_weekday_hour": p(f"SELECT DayOrder, w.EnteredWeekday, CAST(h.h AS INTEGER) AS EnteredHour, count(p.PostingID) AS Entries FROM {days} CROSS JOIN range(24) AS h(h) LEFT JOIN postings p ON p.EnteredWeekday = w.EnteredWeekday AND p.EnteredHour = h.h GROUP BY 1, 2, 3"),
        "gl_off_hours_kpis": p(f"SELECT {rate('IsWeekend', 'WeekendRate')}, {rate('IsAfterHours', 'AfterHoursRate')}, count(*) FILTER (WHERE (IsWeekend OR IsAfterHours) AND liqamt > 150000) AS LargeOffHours FROM postings WHERE EnteredDateTime IS NOT NULL"),
        "gl_off_hours_user": p(f"SELECT UserID, {rate('IsWeekend', 'WeekendRate')}, {rate('IsAfterHours', 'AfterHoursRate')} FROM postings WHERE EnteredDateTime IS NOT NULL AND UserID IS NOT NULL GROUP BY 1"),
        "gl_off_hours_risky": p(f"SELECT PostingID, PostingType, EnteredDateTime, UserID, {money('dr', 'PostingAmount')} FROM postings WHERE (IsWeekend OR IsAfterHours) AND liqamt > 150000"),
        "gl_flags_by_test": p(f"SELECT Test, count(DISTINCT PostingID) AS Entries, {money('sum(amt)', 'Amount')} FROM flags GROUP BY 1", FLAGS),
        "gl_flag_kpis": p(f"SELECT count(*) AS Flagged, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM postings), 6) AS FlagRate, {money('sum(amt)', 'FlaggedAmount')}, (SELECT count(DISTINCT Test) FROM flags) AS TestsTripped FROM flagged", FLAGS),
        "gl_flags_user_test": p("SELECT UserID, Test, count(DISTINCT PostingID) AS Entries FROM flags WHERE UserID IS NOT NULL GROUP BY 1, 2", FLAGS),
        "gl_flags_month_test": p("SELECT strftime(PostingDate, '%Y-%m') AS YearMonth, Test, count(DISTINCT PostingID) AS Entries FROM flags GROUP BY 1, 2", FLAGS),
        "gl_settle_kpis": p(
            f"""SELECT count(*) AS Invoices, {rate('IsSettled', 'SettledRate')}, round(avg(CASE WHEN IsSettled THEN DaysToSettle END), 6) AS AvgDaysToSettle,
            {money(f'sum({_OPEN})', 'OpenAmount')}, count(*) FILTER (WHERE NOT IsSettled) AS OpenInvoices, {rate("PaidVia = 'Cash'", 'CashShareOfInvoices')},
            {rate("CASE WHEN IsSettled THEN PaidVia = 'Cash' END", 'CashShareOfSettled')}, (SELECT max(PostingDate) FROM slice) AS SlicePeriodEnd
            FROM settlements WHERE PostingID IN (SELECT PostingID FROM slice)""",
            exact, SLICE,
        ),
        "gl_settle_by_type": p(f"SELECT CounterpartyType, count(*) AS Invoices, count(*) FILTER (WHERE IsSettled) AS Settled, round(avg(DaysToSettle), 6) AS AvgDays, {rate('coalesce(DaysToSettle <= 30, false)', 'Within30')}, count(*) FILTER (WHERE PaidVia = 'Cash') AS PaidViaCash FROM settlements GROUP BY 1", exact),
        "gl_settle_hist": p("SELECT CounterpartyType, CAST(least(floor((DaysToSettle - lo) / ((hi - lo) / 40.0)) + 1, 40) AS INTEGER) AS Bin, count(*) AS Invoices FROM settlements, (SELECT CAST(min(DaysToSettle) AS DOUBLE) AS lo, CAST(max(DaysToSettle) AS DOUBLE) AS hi FROM settlements WHERE IsSettled) WHERE IsSettled GROUP BY 1, 2", exact),
        "gl_open_by_age": p(f"SELECT CounterpartyType, AgeBucket, count(*) AS Invoices, {money('sum(amt)', 'OpenAmount')} FROM settlements WHERE NOT IsSettled AND AgeBucket IS NOT NULL GROUP BY 1, 2", exact),
        "gl_open_invoices": p(f"SELECT PostingID, CounterpartyType, InvoiceDate, {money('amt', 'PostingAmount')}, AgeAtPeriodEnd, AgeBucket FROM settlements WHERE NOT IsSettled", exact),
        "gl_sum_year": p(f"SELECT Year, {_TIMING} FROM postings WHERE Year IS NOT NULL GROUP BY 1"),
        "gl_sum_preparer": p(f"SELECT p.UserID, count(*) AS Postings, round(avg(LagDays), 6) AS AvgLagDays, {rate('IsOnTime', 'OnTimeRate_all')}, {rate('CASE WHEN HasLag THEN IsOnTime END', 'OnTimeRate_known')}, nullif(count(f.PostingID), 0) AS Flagged, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM postings), 6) AS Share FROM postings p LEFT JOIN flagged f USING (PostingID) WHERE p.UserID IS NOT NULL GROUP BY 1", FLAGS),
        "gl_sum_month": p(f"SELECT YearMonth, count(*) AS Postings, round(avg(LagDays), 6) AS AvgLagDays, {rate('IsOnTime', 'OnTimeRate_all')}, {rate('CASE WHEN HasLag THEN IsOnTime END', 'OnTimeRate_known')} FROM postings GROUP BY 1"),
        "gl_findings": p("SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS Rank, Code, Subject, Count, Amount, Share, Value FROM cand", FLAGS, exact, FINDINGS),
        "snk_flag_extract": p(f"SELECT {FLAG_ROW} FROM flags WHERE Test IN ('Unbalanced entry', 'Possible duplicate', 'Very late entry')", FLAGS),
        "snk_ledger_marts": p(
            """SELECT 'by_year' AS Mart, (SELECT count(DISTINCT Year) FROM postings) AS Rows
            UNION ALL SELECT 'by_preparer', (SELECT count(DISTINCT UserID) FROM postings)
            UNION ALL SELECT 'by_month', (SELECT count(*) FROM (SELECT DISTINCT YearMonth FROM postings))
            UNION ALL SELECT 'flags', (SELECT count(*) FROM flags) UNION ALL SELECT 'settlements', (SELECT count(*) FROM settlements)
            UNION ALL SELECT 'accounts', (SELECT count(*) FROM accounts) UNION ALL SELECT 'data_quality', 7""",
            FLAGS, exact,
        ),
    }


def statements() -> dict[str, str]:
    out = _reports()
    marts = {"by_year": "gl_sum_year", "by_preparer": "gl_sum_preparer", "by_month": "gl_sum_month", "flags": "gl_flags", "data_quality": "gl_dq_summary"}
    out |= {f"snk_ledger_{mart}": out[name] for mart, name in marts.items()}
    out["snk_ledger_settlements"] = f"SELECT * EXCLUDE (TouchesCash) FROM ({out['gl_settle_exact']})"
    return out
