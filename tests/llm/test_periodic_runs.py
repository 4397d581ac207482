"""Periodic runs against all pairs of equal words."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerleaf.llm import periodic_runs
from ledgerleaf.llm.common import WordHashes


def _brute(words, min_length, min_exponent):
    """Stretches whose words are equal a period apart; of equal stretches the smallest period counts."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), st.integers(1, 9), st.integers(0, 60), st.sampled_from([(6, 4), (2, 2), (5, 3), (1, 2)]))
def test_runs(words, period, start, limits):
    words = [words[i] if i < start + period or not start else words[start + (i - start) % period] for i in range(len(words))]
    assert periodic_runs.runs_of(words, WordHashes().of(words), *limits) == _brute(words, *limits)


def _collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    plain = [" ".join(rng.choice(["a", "b", "c", "dd", "é"]) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    long = " ".join(f"w{i % 3000}" for i in range(15_000))
    odd = [None, "", " \n\t", "x", "x " * 6, "x " * 5, "ab\x0bab\x0cab\nab ab ab", "la la " * 9, "y" * 3_000_000, ("z" * 400_000 + " ") * 7, long, long]
    return odd + plain


def test_collapse(spark, texts):
    rows = [(i if i % 7 else None, t, i, "_clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, collapsed string").selectExpr("*", "at AS _row", "'x' AS _text", "at AS runs")
    got = {r.at: r for r in periodic_runs.collapse_runs(docs).collect()}
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "at", "_row", "_text", "runs", "collapsed"}
    for i, text in enumerate(texts):
        words = [w.decode() for w in (text or "").encode().split()]
        runs = _brute(words, 6, 4) if len(words) < 10_000 else [(0, 15_000, 3000)]
        assert [tuple(r) for r in got[i].runs] == runs
        assert got[i].collapsed == _collapsed(words, runs) and got[i]._row == i


def test_digest(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x " * 8), (3, "x"), (10, None)], "doc_id long, text string")
    got = sorted(map(tuple, periodic_runs.digest(docs).collect()), key=repr)
    want = []
    for doc_id, text in docs.collect():
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = _brute(words, 6, 4) if n < 10_000 else [(s, m, q) for s, m, q in periodic_runs.runs_of([w.encode() for w in words], WordHashes().of([w.encode() for w in words]))]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(_collapsed(words, runs))))
    assert got == sorted(want, key=repr)
    assert periodic_runs.digest(docs.limit(0)).collect() == []
