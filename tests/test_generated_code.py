"""Generated code stays within what the JVM compiles: it never compiles a method of more than 8000 bytes."""

from pyspark.sql import functions as F

from ledgerleaf.functions.columns import with_dates
from ledgerleaf.operators.ledger import canonical

HUGE = 8000


def _rows(spark, *texts):
    """Untidy rows as text columns; the texts are dates."""
    fields = {c: F.col("t") if c in canonical.DATE_FIELDS else F.lit("1").cast("string") for c in canonical.FIELDS}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "LineNo long, t string").repartition(2)
    return rows.withColumns({**fields, "SourceFile": F.concat(F.lit("f"), F.col("LineNo") % 1)}).drop("t")


def _largest_method(spark, df):
    """Bytes of the largest generated method of a plan; -1 where a span doesn't compile at all."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
        spans = debug.codegenStringSeq(plan)
        sizes = [spans.apply(i)._3().maxMethodCodeSize() for i in range(spans.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return -1 if -1 in sizes else max(sizes)


def test_readings_of_all_date_fields_compile(spark):
    df = with_dates(_rows(spark, "2024-01-03"), {c: F.col(c) for c in canonical.DATE_FIELDS})
    assert 0 < _largest_method(spark, df) <= HUGE


def test_cleaning_of_rows_compiles(spark):
    df = canonical.normalise_text(canonical.parse_amounts(canonical.complete_fields(_rows(spark, "2024-01-03"))))
    df = with_dates(df, {c: F.col(c) for c in canonical.DATE_FIELDS})
    assert 0 < _largest_method(spark, df) <= HUGE


def test_texts_that_look_like_cut_dates(spark):
    texts = ["=,2024,1,3,,,,,,,", "=,2024,1,3,,/,10,5,x,p,", " =,2024,1,3,,/,10,5,7,p,", "=", "2024-01-03 10:00:60"]
    got = with_dates(_rows(spark, *texts), {"d": F.col("PostingDate")}).orderBy("LineNo").collect()
    assert [str(r.d_month) for r in got] == ["None"] * 4 + ["2024-01-03 10:01:00"]


def test_filter_of_unread_dates_computes_no_reading_again(spark):
    """The filter used to be pushed into the readings, and each of them was computed several times."""
    df = canonical.unread_dates(_rows(spark, "2024-01-03", "Q1 1995", "31/02/1995", "Q2 1996", "nan"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?i)^") == 1
    got = {(r.Field, r.Outline, r.Lines, r.Example) for r in df.collect()}
    assert got == {(f, o, n, x) for f in canonical.DATE_FIELDS for o, n, x in (("a9 9999", 2, "Q1 1995"), ("99/99/9999", 1, "31/02/1995"))}
