"""What a scan of exports leaves on disk."""

import gzip
import pathlib

from ledgerleaf import untidy
from ledgerleaf.sources import exports
from ledgerleaf.store import materialize, packed_table, shared_folder

TEXT = 'Date,Account,Debit,Credit\n   \n2024-01-02,Cash,1,0\n2024-01-03,"two\nlines",2,0\n2024-01-04,12" pipe,3,0\n'


def test_packed_files_have_the_same_records(spark, tmp_path):
    (tmp_path / "plain.csv").write_text(TEXT)
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(TEXT.encode()))
    found = {}
    for r in exports.scan_exports(spark, str(tmp_path)).collect():
        found.setdefault(r.SourceFile.rsplit("/", 1)[1], []).append((r.LineNo, r.Cells, r.Separator, r.HeadingHits))
    assert len(found["plain.csv"]) == 4 and sorted(found["packed.csv.gz"]) == sorted(found["plain.csv"])


def test_written_exports_are_packed(spark, tmp_path):
    untidy._write(spark.createDataFrame([("a", 1, "x")], "SourceFile string, LineNo long, value string"), str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "SourceFile=a").glob("part-*")
    assert gzip.decompress(part.read_bytes()) == b"x\n"


def test_states_of_quotes_are_discarded(spark, tmp_path):
    before = set(pathlib.Path(shared_folder(spark)).iterdir())
    (tmp_path / "broken.csv").write_text(TEXT)
    cells = exports.scan_exports(spark, str(tmp_path))
    left = {p.name.rsplit("-", 1)[0] for p in set(pathlib.Path(shared_folder(spark)).iterdir()) - before}
    assert not left & {"export-states", "export-carry"} and cells.count() == 4


def test_tables_are_packed(spark):
    table = packed_table(spark.range(10), "numbers")
    assert all(".zstd." in f for f in table.inputFiles()) and table.count() == 10
    assert not any(".zstd." in f for f in materialize(spark.range(10), "numbers").inputFiles())
