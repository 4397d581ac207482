"""Files and values that the derived tables don't contain."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions.columns import amount_is_suspect, with_dates
from ledgerleaf.operators.carbon.fact import clean_fact
from ledgerleaf.operators.carbon.factors import activity_columns, activity_to_fact
from ledgerleaf.operators.ledger.canonical import to_canonical
from ledgerleaf.sources import bundles, exports


def test_dimension_by_heading(spark, tmp_path):
    path = tmp_path / "chart.csv"
    path.write_text('AccountGroup,Other,AccountNo,AccountClass\n"Cash ""petty"" & bank",x,1000,Asset\n')
    row = bundles.read_dimension(spark, str(path), "DimAccount").first()
    assert (row.AccountNo, row.AccountName, row.AccountClass, row.AccountGroup) == ("1000", None, "Asset", 'Cash "petty" & bank')
    path.write_text("AccountNo,AccountName\n1000,Cash\n")
    with pytest.raises(ValueError, match="AccountClass"):
        bundles.read_dimension(spark, str(path), "DimAccount")


def test_target_years_that_fit_no_integer(spark):
    years = spark.createDataFrame([("2030",), ("1e20",), ("nan",), ("soon",)], "Year string")
    assert [r.Year for r in bundles.clean_target_years(years).collect()] == [2030]


def test_scores_that_are_no_number(spark):
    facts = spark.createDataFrame([("a", "nan"), ("b", "7"), ("c", "2.0"), ("d", None)], "SiteID string, DataQualityScore string")
    assert {r.SiteID: r.DataQualityScore for r in clean_fact(facts).collect()} == {"a": 3, "b": 5, "c": 2, "d": 3}


def test_doubled_quotes_and_backslashes(spark, tmp_path):
    (tmp_path / "lines.csv").write_text('Account,Text,Debit,Credit\n1000,"said ""hi"", bye",10,0\n1100,"C:\\",0,10\n')
    rows = {r.LineNo: [c for c in r.Cells if c is not None] for r in exports.scan_exports(spark, str(tmp_path)).orderBy("LineNo").collect()}
    assert list(rows.values())[1:] == [["1000", 'said "hi", bye', "10", "0"], ["1100", "C:\\", "0", "10"]]


def test_wide_rows_and_quoted_line_breaks(spark, tmp_path):
    names = [f"c{i}" for i in range(80)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(names) + "\n")
    (tmp_path / "broken.csv").write_text('Account,Text,Debit,Credit\n1000,"two\nlines, ""both""",10,0\n1100,,0,10\nx,y\n')
    rows = exports.scan_exports(spark, str(tmp_path)).collect()
    wide = [r.Cells for r in rows if r.SourceFile.endswith("wide.csv")]
    broken = [r.Cells for r in sorted(rows, key=lambda r: r.LineNo) if r.SourceFile.endswith("broken.csv")]
    assert wide == [names, names]
    assert broken[1:] == [["1000", 'two\nlines, "both"', "10", "0"], ["1100", None, "0", "10"], ["x", "y"]]


def test_signed_amounts_from_a_file(spark, tmp_path):
    (tmp_path / "signed.csv").write_text("Date,Account,Num,Amount\n2024-01-02,Cash,1,(10.50)\n2024-01-02,Sales,1,10.50\n2024-01-03,Big,2,123456789012345.00\n")
    cells = exports.scan_exports(spark, str(tmp_path))
    heads = exports.headings(cells)
    lines = to_canonical(exports.mapped_rows(exports.data_rows(cells, heads), exports.column_map(heads)), signed=True)
    got = {r.AccountName: (str(r.Debit), str(r.Credit)) for r in lines.collect()}
    assert got == {"Cash": ("0.0000", "10.5000"), "Sales": ("10.5000", "0.0000"), "Big": ("123456789012345.0000", "0.0000")}


def test_amounts_that_fit_no_decimal_are_suspect(spark):
    texts = spark.createDataFrame([("9" * 30,), ("-",), ("12.50",), ("1.2.3",), (None,)], "t string")
    assert [r[0] for r in texts.select(amount_is_suspect(F.col("t"))).collect()] == [True, False, False, True, False]


def test_own_factor_library_and_choices(spark, tmp_path):
    path = tmp_path / "library.csv"
    path.write_text("FactorID,ActivityType,Factor,FactorUnit,Method,CategoryID,Region\nF1,Coal,2,kg/kg,,,\nF2,coal,3,kg/kg,,,\nF3,Peat,5,kg/kg,,,\n")
    library = bundles.read_dimension(spark, str(path), "DimEmissionFactor")
    raw = spark.createDataFrame([("2024-01-01", "Scope 1", "Coal", "10"), ("2024-01-01", "Scope 1", "Turf", "10")], "d string, s string, a string, q string")
    activity = activity_columns(raw, {"Date": "d", "Scope": "s", "ActivityType": "a", "Quantity": "q"})
    choices = spark.createDataFrame([("Turf", "F3")], "ActivityType string, FactorID string")
    facts = activity_to_fact(activity, library, choices).collect()
    assert {r.ActivityType: (r.FactorID, float(r.EmissionFactor)) for r in facts} == {"Coal": ("F1", 2.0), "Turf": ("F3", 5.0)}


def _records(spark, folder):
    """Records by file name: cells (null as empty) in the order of their numbers, which must have no gaps."""
    found = {}
    for r in exports.scan_exports(spark, str(folder)).collect():
        found.setdefault(r.SourceFile.rsplit("/", 1)[1], {})[r.LineNo] = [c or "" for c in r.Cells]
    for rows in found.values():
        assert sorted(rows) == list(range(len(rows)))
    return {name: [rows[i] for i in range(len(rows))] for name, rows in found.items()}


def _parsed(text, sep):
    rows = list(csv.reader(io.StringIO(text), delimiter=sep))
    return [r for r in rows if len(r) > 1 or (r and r[0].strip())]


def test_records_over_split_borders(spark, tmp_path):
    """Quoted line breaks, blank lines and inch marks in files cut into splits of a few bytes, against a CSV parser."""
    rng = random.Random(8)
    cells = ["x", '12" pipe', '"a, b"', '"a; b"', '"two\nlines"', '"say ""hi"""', '","', '""', '"\n\n"', '"x\n""\ny"', "Mü"]
    want = {}
    for k in range(8):
        sep = ",;"[k % 2]
        lines = [sep.join(["Date", "Account", "Debit", "Credit"])]
        lines += [rng.choice(["", "   ", '""', '"  "']) if rng.random() < 0.2 else sep.join(rng.choice(cells) for _ in range(4)) for _ in range(12)]
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n")
        want[f"f{k}.csv"] = _parsed("\n".join(lines) + "\n", sep)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert _records(spark, tmp_path) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_line_breaks_change_no_other_row(spark, tmp_path):
    plain = "Date,Account,Debit,Credit\n   \n2024-01-02,Cash,1,0\n"
    (tmp_path / "plain.csv").write_text(plain)
    (tmp_path / "broken.csv").write_text(plain + '2024-01-03,"two\nlines",2,0\n')
    (tmp_path / "inch.csv").write_text(plain + '2024-01-03,12" pipe,2,0\n2024-01-04,Cash,3,0\n')
    (tmp_path / "open.csv").write_text(plain + '2024-01-03,"never closed,2,0\n\n2024-01-04,"" x,3,0\n')
    got = _records(spark, tmp_path)
    head = [["Date", "Account", "Debit", "Credit"], ["2024-01-02", "Cash", "1", "0"]]
    assert got["plain.csv"] == head
    assert got["broken.csv"] == [*head, ["2024-01-03", "two\nlines", "2", "0"]]
    assert got["inch.csv"] == [*head, ["2024-01-03", '12" pipe', "2", "0"], ["2024-01-04", "Cash", "3", "0"]]
    assert got["open.csv"][:3] == [*head, ["2024-01-03", '"never closed', "2", "0"]] and len(got["open.csv"]) == 4


def test_header_below_many_titles(spark, tmp_path):
    """The header counts wherever it stands, and decides the separator whatever is more frequent."""
    titles = "".join(f"Report, page {i}, of, many\n" for i in range(60))
    (tmp_path / "late.csv").write_text(titles + "Date;Account;Debit;Credit\n" + "2024-01-02;Cash;1,50;0,00\n" * 3)
    cells = exports.scan_exports(spark, str(tmp_path))
    head = exports.headings(cells).first()
    assert head.HeaderLine == 60 and head.Headings == ["Date", "Account", "Debit", "Credit"]
    assert [r.Cells for r in exports.data_rows(cells, exports.headings(cells)).collect()] == [["2024-01-02", "Cash", "1,50", "0,00"]] * 3


@pytest.mark.parametrize("rows_per_chunk", [1 << 20, 3])
def test_sides_and_ids_by_file(spark, tmp_path, rows_per_chunk):
    """A folder with a split file and a signed one; ids are carried down over blocks of lines."""
    (tmp_path / "signed.csv").write_text("Date,Account,Num,Amount\n2024-01-02,Cash,1,(10.50)\n2024-01-02,Sales,,10.50\n")
    ids = ["A", "", "", "", "", "", "", "B", ""]
    (tmp_path / "split.csv").write_text("Date,Account,Num,Debit,Credit\n" + "".join(f"{i + 10}/03/2024,Cash,{x},{i},0\n" for i, x in enumerate(ids)))
    cells = exports.scan_exports(spark, str(tmp_path))
    heads = exports.headings(cells)
    mapping = exports.column_map(heads)
    assert exports.mapping_gaps(heads, mapping).count() == 0
    lines = to_canonical(exports.mapped_rows(exports.data_rows(cells, heads), mapping), rows_per_chunk=rows_per_chunk)
    rows = sorted((r.SourceFile.rsplit("/", 1)[1], r.LineNo, r.PostingID, str(r.PostingDate.date()), float(r.Debit), float(r.Credit)) for r in lines.collect())
    assert [r[2:] for r in rows if r[0] == "signed.csv"] == [("1", "2024-01-02", 0.0, 10.5), ("1", "2024-01-02", 10.5, 0.0)]
    assert [r[2:] for r in rows if r[0] == "split.csv"] == [("A" if i < 7 else "B", f"2024-03-{i + 10}", float(i), 0.0) for i in range(9)]


DATES = {
    "3 Jan 2024": ("2024-01-03",) * 2, "Jan 3, 2024": ("2024-01-03",) * 2, "03/01/24": ("2024-03-01", "2024-01-03"), "2024-01-03T10:00:00Z": ("2024-01-03 10:00",) * 2,
    "2024-01-03 10:00:00.125": ("2024-01-03 10:00:00.125",) * 2, "1/3/2024 2:05 PM": ("2024-01-03 14:05", "2024-03-01 14:05"), "20240103": ("2024-01-03",) * 2,
    "2024/1/3 4:5": ("2024-01-03 04:05",) * 2, "13/01/2024": (None, "2024-01-13"), "1.13.70": ("1970-01-13", None), "31-04-2024": (None, None), "5-Oct-98": ("1998-10-05",) * 2,
    "September 5 1999 12:00 am": ("1999-09-05",) * 2, "2024-01-03T10:00:00+02:00": ("2024-01-03 10:00",) * 2, "29/2/2024": (None, "2024-02-29"), "2/29/2023": (None, None),
    "20240230": (None, None), "1/3/2024 13:05 PM": (None, None), "Q1 1995": (None, None), "12/12": (None, None), "1/2-2024": (None, None), " nan ": (None, None), None: (None, None),
}


def test_date_shapes(spark):
    texts = spark.createDataFrame([(t,) for t in DATES], "t string")
    got = {r.t: (r.d_month, r.d_day) for r in with_dates(texts, {"d": F.col("t")}).collect()}
    named = spark.createDataFrame([(t, *v) for t, v in DATES.items()], "t string, m string, d string")
    want = named.selectExpr("t", "CAST(m AS timestamp_ntz) AS m", "CAST(d AS timestamp_ntz) AS d").collect()
    assert got == {r.t: (r.m, r.d) for r in want}
