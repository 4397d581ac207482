"""Independent SQL statements of the export results: what the untidy text must come back as."""

from __future__ import annotations

from ledgerleaf import untidy
from ledgerleaf.oracle import carbon
from ledgerleaf.oracle.ledger import LINES, POSTINGS, accounts, money, values_cte

KEYED = (
    LINES
    + """,
keyed AS (SELECT * REPLACE (CASE WHEN LineNo // 32 % 500 NOT IN (3, 4) THEN DocumentDate END AS DocumentDate), LineNo // 32 AS k, LineNo % 4 AS pos, (LineNo // 32) % 6 AS kind,
  'kind' || ((LineNo // 32) % 6) || '-' || lpad(CAST(LineNo // 32 // 4000 AS VARCHAR), 5, '0') AS SourceFile FROM lines),
files AS (SELECT DISTINCT SourceFile, kind FROM keyed),
canon AS (SELECT SourceFile, LineNo, kind,
  CASE WHEN kind = 2 THEN 'E-' || coalesce(strftime(PostingDate, '%Y%m%d'), 'nodate') || '-' || coalesce(Counterparty, '') ELSE PostingID END AS PostingID,
  PostingDate, DocumentDate, EnteredDateTime,
  CASE WHEN kind = 5 THEN AccountName ELSE AccountNo END AS AccountNo, CASE WHEN kind = 4 THEN AccountNo ELSE AccountName END AS AccountName,
  dr, cr, UserID, Counterparty, RefPostingID FROM keyed)"""
)
_HEADINGS = values_cte("kindheads", "kind, pos, h", [(k, p, h) for k, names in enumerate(untidy.HEADINGS) for p, h in enumerate(names, 1)])
# Expected mappings by kind, worked out by hand from the synonym rules: (kind, domain, field, position).
_MAPPED = [
    (0, "ledger", f, p) for f, p in [("PostingID", 1), ("PostingDate", 2), ("DocumentDate", 3), ("EnteredDateTime", 4), ("AccountNo", 5), ("AccountName", 6), ("Debit", 7), ("Credit", 8), ("Counterparty", 6)]
] + [
    (1, "ledger", f, p) for f, p in [("PostingID", 3), ("PostingDate", 1), ("AccountName", 6), ("Debit", 7), ("Credit", 8), ("Counterparty", 4), ("LineText", 5)]
] + [
    (2, "ledger", f, p) for f, p in [("PostingID", 1), ("PostingDate", 2), ("AccountNo", 3), ("AccountName", 3), ("Debit", 4), ("Credit", 5), ("UserID", 6), ("Counterparty", 3)]
] + [
    (3, "ledger", f, p) for f, p in [("PostingID", 1), ("PostingDate", 2), ("AccountName", 3), ("Debit", 7), ("Credit", 5), ("UserID", 6), ("Counterparty", 3)]
] + [
    (4, "ledger", f, p) for f, p in [("PostingDate", 1), ("EnteredDateTime", 5), ("AccountNo", 2), ("AccountName", 2), ("Debit", 4)]
] + [
    (0, "carbon", "Date", 2), (0, "carbon", "Factor", None), (1, "carbon", "Date", 1),
    (2, "carbon", "Date", 2), (3, "carbon", "Date", 2), (3, "carbon", "Factor", 8),
    (4, "carbon", "Date", 1), (4, "carbon", "ActivityType", 8), (4, "carbon", "Quantity", 3),
]


#: Lines of the journal files with the fields each kind holds, numbered as the records of a file.
_TITLES = "CASE kind " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(untidy.JOURNAL_TITLES)) + " END"


def _held(field: str, value: str) -> str:
    kinds = [str(k) for k, columns in enumerate(untidy.JOURNAL_FILES) if field in [f for _, f in columns]]
    return f"CASE WHEN kind IN ({', '.join(kinds)}) THEN {value} END AS {field}"


FILE_LINES = (
    KEYED.replace("\nlines AS (", "\nbase AS (").replace("FROM lines)", "FROM base)")
    + f""",
records AS (SELECT *, {_TITLES} + row_number() OVER (PARTITION BY SourceFile ORDER BY LineNo) AS Record, LineNo % 4 < 3 AS real
  FROM (SELECT * FROM keyed UNION ALL SELECT * REPLACE (LineNo + 3 AS LineNo) FROM keyed WHERE pos = 0 AND kind IN (1, 5))),
lines AS (SELECT SourceFile, Record AS LineNo,
  CASE WHEN kind = 2 THEN 'E-' || coalesce(strftime(PostingDate, '%Y%m%d'), 'nodate') || '-' || coalesce(Counterparty, '') ELSE PostingID END AS PostingID,
  PostingDate, {_held("DocumentDate", "CAST(CAST(DocumentDate AS DATE) AS TIMESTAMP)")}, {_held("EnteredDateTime", "EnteredDateTime")},
  CASE WHEN kind IN (1, 2, 5) THEN AccountName ELSE AccountNo END AS AccountNo, CASE WHEN kind = 4 THEN AccountNo ELSE AccountName END AS AccountName,
  CASE WHEN kind = 4 THEN greatest(dr - cr, 0) ELSE dr END AS dr, CASE WHEN kind = 4 THEN greatest(cr - dr, 0) ELSE cr END AS cr,
  {_held("UserID", "UserID")}, {_held("Counterparty", "Counterparty")}, {_held("RefPostingID", "RefPostingID")} FROM records WHERE real)"""
)


def c(select: str, *more: str) -> str:
    return "WITH " + ", ".join([KEYED, *more]) + "\n" + select


def statements() -> dict[str, str]:
    mapped = values_cte("mapped", "kind, dom, field, pos", [m for m in _MAPPED if m[3] is not None])
    line = "SourceFile, LineNo"
    amounts = f"{money('dr', 'Debit')}, {money('cr', 'Credit')}"
    extra = "SELECT SourceFile, LineNo + 3 AS LineNo, {0} FROM keyed WHERE pos = 0 AND kind IN (1, 5)"
    gaps = values_cte(
        "gaps", "kind, m, mode",
        [(4, "Debit / Credit", "split"), (5, "PostingDate", "split"), (5, "AccountName", "split"), (5, "Debit / Credit", "split")]
        + [(5, f, "by file") for f in ("PostingDate", "AccountName", "Debit / Credit")] + [(k, "Amount", "signed") for k in (0, 1, 2, 3, 5)] + [(5, "PostingDate", "signed"), (5, "AccountName", "signed")]
        + [(k, f, "activity") for k in (0, 1, 2, 3) for f in ("Scope", "ActivityType", "Quantity")]
        + [(4, "Scope", "activity")] + [(5, f, "activity") for f in ("Date", "Scope", "ActivityType", "Quantity")],
    )
    return {
        "src_exports": c(
            """SELECT SourceFile, titles + 1 + n AS LineNo, sep AS Separator, concat_ws('|', PostingID, d1, d2, d3, coalesce(AccountNo, ''), nm, d, e) AS Record FROM data
            UNION ALL SELECT SourceFile, titles, sep, head FROM files JOIN exportheads USING (kind)
            UNION ALL SELECT SourceFile, i - 1, sep, CASE WHEN i = 2 THEN 'Journal|Date' WHEN i % 10 = 0 THEN 'Report 12" wide, page ' || i ELSE 'Acme ' || i END
              FROM files JOIN exportheads USING (kind), range(1, 41) t(i) WHERE i <= titles""",
            values_cte(
                "exportheads", "kind, titles, sep, head",
                [(k, untidy.TITLE_ROWS[k], ";" if k in (2, 3) else ",", "|".join(h)) for k, h in enumerate(untidy.HEADINGS)],
            ),
            """data AS (SELECT f.SourceFile, f.kind, titles, sep, l.PostingID, l.AccountNo, coalesce(CAST(l.PostingDate AS VARCHAR), '') AS d1,
              coalesce(CAST(l.DocumentDate AS VARCHAR), '') AS d2, coalesce(CAST(l.EnteredDateTime AS VARCHAR), '') AS d3,
              row_number() OVER (PARTITION BY f.SourceFile ORDER BY l.LineNo) - 1 AS n,
              coalesce(l.AccountName || CASE WHEN f.kind = 4 AND f.k % 7 = 0 THEN chr(10) || '("second", line)' WHEN f.kind = 2 AND f.k % 5 = 0 THEN ' 12" x' ELSE '' END, '') AS nm,
              (l.dr // 100) || '.' || lpad(CAST(l.dr % 100 AS VARCHAR), 2, '0') || '00' AS d, (l.cr // 100) || '.' || lpad(CAST(l.cr % 100 AS VARCHAR), 2, '0') || '00' AS e
              FROM lines l JOIN keyed f ON l.LineNo = f.LineNo JOIN exportheads h ON h.kind = f.kind)""",
        ),
        "src_header_rows": c("SELECT SourceFile, CAST(CASE kind WHEN 5 THEN 0 WHEN 3 THEN 40 ELSE 3 END AS BIGINT) AS HeaderLine FROM files"),
        "src_layout": c("SELECT SourceFile, CASE WHEN kind IN (0, 3) THEN 'canonical' WHEN kind = 1 THEN 'qbo' ELSE 'unknown' END AS LedgerLayout, 'activity' AS CarbonLayout FROM files"),
        "src_column_map": c("SELECT SourceFile, field AS Field, pos AS Position, h AS Heading, dom AS Domain FROM files JOIN mapped USING (kind) JOIN kindheads USING (kind, pos)", mapped, _HEADINGS),
        "src_mapping_gaps": c("SELECT SourceFile, m AS Missing, mode AS Mode FROM files JOIN gaps USING (kind)", gaps),
        "src_bundle": f"""WITH {LINES}, {accounts()}, {carbon.FACT}
            SELECT 'charted accounts' AS Item, count(*) AS Rows FROM accounts WHERE Source = 'chart of accounts'
            UNION ALL SELECT 'postings', count(DISTINCT PostingID) FROM lines UNION ALL SELECT 'facts with a default factor', count(*) FROM inv""",
        "src_dimensions": f"WITH {carbon.FACT}, {carbon.CATS} SELECT 'DimSite' AS \"Table\", n_name AS ID, 'Site ' || n_name AS Name FROM nation UNION ALL SELECT DISTINCT 'DimScopeCategory', i.cat, CategoryName FROM inv i JOIN cats ON i.cat = CategoryID",
        "gl_canonical_lines": c(f"SELECT {line}, PostingID, PostingDate, CAST(CAST(DocumentDate AS DATE) AS TIMESTAMP) AS DocumentDate, EnteredDateTime, AccountNo, AccountName, {amounts}, UserID, Counterparty, RefPostingID, CAST(NULL AS VARCHAR) AS LineText FROM canon"),
        "gl_parse_amount": c(f"SELECT {line}, {amounts} FROM keyed UNION ALL " + extra.format(f"CASE WHEN kind = 5 THEN {money('dr', 'd').split(' AS d')[0]} ELSE 0 END, 0")),
        "gl_signed_split": c(f"SELECT {line}, CAST(greatest(dr - cr, 0) AS DOUBLE) / 100.0 AS Debit, CAST(greatest(cr - dr, 0) AS DOUBLE) / 100.0 AS Credit FROM keyed UNION ALL " + extra.format("0, 0")),
        "gl_parse_dates": c(f"SELECT {line}, PostingDate, DocumentDate, EnteredDateTime FROM keyed UNION ALL " + extra.format("NULL, NULL, NULL")),
        "gl_text_nulls": c(f"SELECT {line}, CASE WHEN kind = 2 OR kind = 3 AND pos > 0 THEN NULL ELSE PostingID END AS PostingID, UserID, Counterparty, RefPostingID FROM keyed UNION ALL " + extra.format("NULL, NULL, NULL, NULL")),
        "gl_account_fallback": c("SELECT SourceFile, count(*) FILTER (WHERE AccountNo IS NOT DISTINCT FROM AccountName) AS SameAccount, count(AccountNo) AS Numbers, count(AccountName) AS Names FROM canon GROUP BY 1"),
        "gl_noise_filter": c("SELECT SourceFile, count(*) AS Lines, count(*) FILTER (WHERE AccountName IS NULL) AS NoAccount FROM canon GROUP BY 1"),
        "gl_synthetic_ids": c("SELECT SourceFile, PostingID, 'E' || (row_number() OVER (PARTITION BY SourceFile ORDER BY min(LineNo)) - 1) AS NumberedID, count(*) AS Lines FROM canon GROUP BY 1, 2"),
        "gl_ffill_ids": c(f"SELECT {line}, PostingID FROM canon"),
        "gl_report_unroll": c(
            f"""SELECT {line}, typ || ' ' || coalesce(num, strftime(d, '%Y-%m-%d')) AS PostingID, d AS PostingDate, AccountName, {amounts}, cp AS Counterparty FROM rep WHERE AccountName IS NOT NULL""",
            """rep AS (SELECT SourceFile, LineNo, AccountName, dr, cr,
              last_value(CASE WHEN pos = 0 THEN PostingID[1:2] END IGNORE NULLS) OVER w AS typ,
              last_value(CASE WHEN pos = 0 AND k % 7 <> 0 THEN CAST(k AS VARCHAR) END IGNORE NULLS) OVER w AS num,
              last_value(CASE WHEN pos = 0 THEN PostingDate END IGNORE NULLS) OVER w AS d,
              last_value(CASE WHEN pos = 0 THEN Counterparty END IGNORE NULLS) OVER w AS cp
              FROM keyed WINDOW w AS (PARTITION BY SourceFile ORDER BY LineNo ROWS UNBOUNDED PRECEDING))""",
        ),
        "gl_amount_suspects": c("SELECT SourceFile, count(*) FILTER (WHERE k % 10 IN (1, 2, 3, 4)) AS DebitSuspects, count(*) FILTER (WHERE k % 10 = 6) AS CreditSuspects FROM keyed GROUP BY 1"),
        "gl_unread_dates": c(f"""SELECT SourceFile, 'DocumentDate' AS Field, CASE WHEN k % 500 = 3 THEN 'a9 9999' ELSE '99/99/9999' END AS Outline, count(*) AS Lines,
            CASE WHEN k % 500 = 3 THEN '{untidy.NO_DATE}' ELSE '{untidy.NO_DAY}' END AS Example FROM keyed WHERE k % 500 IN (3, 4) GROUP BY ALL"""),
        "gl_lines_from_files": f"""WITH {FILE_LINES} SELECT {line}, PostingID, PostingDate, DocumentDate, EnteredDateTime, AccountNo, AccountName, {amounts}, UserID, Counterparty,
            RefPostingID, CAST(NULL AS VARCHAR) AS LineText FROM lines""",
        "gl_postings_from_files": f"""WITH {FILE_LINES}, {accounts()}, {POSTINGS} SELECT PostingID, PostingType, PostingDate, DocumentDate, EnteredDateTime, Counterparty, LineCount,
            {money('dr', 'Debits')}, {money('cr', 'Credits')}, imb = 0 AS IsBalanced, LagDays FROM postings""",
        "ghg_facts_from_files": carbon.statements()["ghg_activity_to_fact"],
    }
