"""A sample of the registered queries against their SQL (``oracle_check.py`` compares all of them)."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("gl_flags_by_test", "gl_timeliness", "gl_settle_fifo", "src_column_map", "gl_canonical_lines", "ghg_reprice", "ghg_kpis")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note
