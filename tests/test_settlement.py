"""FIFO matching against a greedy loop, with a hot (counterparty, amount) group that spans chunks."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerleaf.operators.ledger.settlement import match_by_reference, match_fifo

SCHEMA = (
    "PostingID string, PostingType string, PostingDate timestamp_ntz, DocumentDate timestamp_ntz, PostingAmount decimal(18,2), "
    "Counterparty string, RefPostingID string, TouchesCash boolean"
)
DAY0 = dt.datetime(2024, 1, 1)


def postings(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        party = "hot" if hot else rng.choice(["a", "b", "c", None])
        amount = Decimal("10.00") if hot else Decimal(rng.choice(["5.00", "7.50"]))
        kind = rng.choice(["Sales invoice", "Purchase invoice", "Customer receipt", "Supplier payment"])
        date = None if rng.random() < 0.05 else DAY0 + dt.timedelta(days=rng.randrange(20))
        rows.append((f"P{i:04d}", kind, date, None, amount, party, f"P{rng.randrange(n):04d}" if rng.random() < 0.5 else None, False))
    return rows


def greedy(rows):
    invoices = sorted((r for r in rows if "invoice" in r[1] and r[5] and r[2]), key=lambda r: (r[2], r[0]))
    pays = sorted((r for r in rows if "invoice" not in r[1] and r[5] and r[2]), key=lambda r: (r[2], r[0]))
    used, match = set(), {}
    for inv in invoices:
        for p in pays:
            if p[0] not in used and p[5] == inv[5] and p[4] == inv[4] and p[2] >= inv[2] - dt.timedelta(days=5):
                used.add(p[0])
                match[inv[0]] = p[0]
                break
    return match


def test_fifo_equals_greedy_loop(spark):
    for seed in (1, 2):
        rows = postings(seed, 400)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = match_fifo(df).collect()
        assert {r.PostingID: r.PaymentID for r in got if r.PaymentID} == greedy(rows)
        assert len(got) == sum("invoice" in r[1] for r in rows)


def test_reference_takes_earliest_payment(spark):
    rows = postings(3, 300)
    got = {r.PostingID: r.PaymentID for r in match_by_reference(spark.createDataFrame(rows, SCHEMA)).filter(F.col("PaymentID").isNotNull()).collect()}
    want = {}
    for inv in (r for r in rows if "invoice" in r[1]):
        pays = [r for r in rows if "invoice" not in r[1] and r[6] == inv[0]]
        if pays:
            want[inv[0]] = min(pays, key=lambda r: (r[2] is None, r[2] or DAY0, r[0]))[0]
    assert got == want
