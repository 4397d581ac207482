"""A run of all marts derives the journal lines once."""

from ledgerleaf.plans.ledger_queries import book_of
from ledgerleaf.sources import sinks
from ledgerleaf.store import new_path


def test_lines_are_written_once(spark):
    book = book_of(spark, "/root/testdata/sf0.001")
    derived = book.lines
    sinks.write_ledger_marts(book, new_path(spark, "ledger-run"))
    assert book.lines.inputFiles() and all("/lines-" in f for f in book.lines.inputFiles())
    assert book.lines.schema == derived.schema and book.lines.exceptAll(derived).count() == 0 == derived.exceptAll(book.lines).count()
