"""Chunked scans against plain loops."""

import random

from pyspark.sql import functions as F

from ledgerleaf.operators.ordered import forward_fill, running_total


def test_forward_fill_over_many_chunks(spark):
    rng = random.Random(5)
    rows = [(f, i, rng.choice([None, None, f"v{i}"])) for f, n in (("big", 300), ("small", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "f string, n long, v string").repartition(4)
    got = {(r.f, r.n): r.v for r in forward_fill(df, "f", "n", ["v"], rows_per_chunk=16).collect()}
    last, want = {}, {}
    for f, n, v in rows:
        last[f] = v or last.get(f)
        want[f, n] = last[f]
    assert got == want


def test_running_total(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(5)) for i in range(200)]
    got = {r.id: r.cum for r in running_total(spark.createDataFrame(rows, "id int, v int"), [F.desc("v"), F.asc("id")], F.col("v"), "cum").collect()}
    total, want = 0, {}
    for i, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += v
        want[i] = total
    assert got == want
