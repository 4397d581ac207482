"""Rows without ids, with shared ids and with clashing columns: operators and stages against plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from ledgerleaf.llm import log_bilinear, lsh_forest, mixing, phrase_automata, prefix_doubling, repeats


def _text(seed, words=120):
    return " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, 500, words))


def _removed(texts, length):
    """(removed bytes, sha256 of the rest) of each text, by counting every string of ``length`` bytes."""
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for text in texts:
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - length + 1):
            if count[text[k : k + length]] > 1:
                gone[k : k + length] = True
        yield int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(text, gone, strict=True) if not g)).hexdigest()


def test_strings_shared_with_texts_without_an_id(spark):
    """Two texts share 600 bytes, one or both without an id; copies without ids; two texts under one id."""
    shared, other, third = _text(1, 150)[:600], _text(2, 150)[:500], _text(3, 150)[:450]
    rows = [(1, _text(4) + shared), (None, _text(5) + shared), (None, _text(6) + other), (None, other + _text(7)), (2, third + _text(8)), (2, _text(9) + third)]
    rows += [(None, _text(10)), (None, _text(10)), (3, _text(10) + " tail"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.kept_sha256) for r in prefix_doubling.digest(df).collect())
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((i or 0, len(t), n, sha) for (i, _), t, (n, sha) in zip(rows, texts, _removed(texts, 400), strict=True))
    assert got == want and sum(n for _, _, n, _ in got) > 4000


def test_strings_of_split_shards_without_ids(spark, monkeypatch):
    """A passage in 60 texts, most without an id, in shards so small that they are split."""
    monkeypatch.setattr(prefix_doubling, "RUNS", prefix_doubling.repeats.Runs(400, 48, 2000, False, True))
    passage, second = _text(11, 150)[:600], _text(12, 150)[:420]
    rows = [(i if i % 5 == 0 else None, _text(100 + i, 20) + passage[: 400 + 3 * i] + _text(200 + i, 20) + (second if i % 7 == 0 else "")) for i in range(60)]
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in prefix_doubling.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = [t.encode() for _, t in rows]
    assert got == sorted((len(t), n, sha) for t, (n, sha) in zip(texts, _removed(texts, 400), strict=True))


def test_parts_of_a_passage_that_texts_repeat(spark):
    """A passage twelve times in each of 90 texts: no part of a split shard gets much more than two shards' units."""
    runs = repeats.Runs(400, 48, 20_000, False, True)
    passage = _text(13, 150)[:420]
    rows = [(i, "".join(_text(1000 + 12 * i + k, 60)[:200] + passage for k in range(12))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = repeats.distinct_texts(repeats.scan(docs, runs))
    sent = repeats.stretches(docs, repeats.recurring(texts, runs), runs).collect()
    sizes, homes = Counter(), Counter()
    for r in sent:
        sizes[r.shard, r.part] += len(r.stretch)
        homes[r.shard, r.part] += len(r.stretch) * r.own
    assert len({r.key for r in sent}) == 90 and sum(sizes.values()) > 90 * 12 * 400
    assert max(sizes[k] - homes[k] for k in sizes) <= 4 * runs.units  # by hash, so not all are alike


def test_passages_that_texts_repeat_in_split_shards(spark, monkeypatch):
    """The same with ends of their own and in shards split in many parts: results as by counting every string."""
    monkeypatch.setattr(prefix_doubling, "RUNS", repeats.Runs(400, 48, 4000, False, True))
    passage = _text(13, 150)[:420]
    rows = [(i, "".join(_text(1000 + 12 * i + k, 60)[:100] + passage[: 380 + i] for k in range(6))) for i in range(40)]
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in prefix_doubling.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = [t.encode() for _, t in rows]
    assert got == sorted((len(t), n, sha) for t, (n, sha) in zip(texts, _removed(texts, 400), strict=True))


def _shingles(text):
    words = (text or "").split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _edited(text, places):
    words = text.split()
    for p in places:
        words[p] = "changed"
    return " ".join(words)


@pytest.fixture(scope="module")
def near():
    """Texts near the threshold on both sides, chains, copies, shared ids and rows without ids."""
    rng = np.random.default_rng(20)
    rows = []
    for base in range(12):
        text = _text(300 + base, 150)
        rows.append((len(rows), text))
        for edits in (0, 1, 2, 3, 4, 6):
            rows.append((len(rows), _edited(text, rng.choice(150, edits, replace=False))))
    rows += [(5, _text(400)), (5, _text(401)), (None, _text(400)), (None, _text(402)), (None, _edited(_text(402), [3])), (900, "a b"), (901, "a b"), (902, ""), (903, None), (902, "")]
    return rows


def _classes(rows):
    sets = [_shingles(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in linked[i])]) for i in range(len(rows))]
        if new == label:
            return label, [len(x) for x in linked]
        label = new


def test_near_duplicates_against_all_pairs(spark, near):
    label, links = _classes(near)
    name = {c: min((i for (i, _), at in zip(near, label, strict=True) if at == c and i is not None), default=None) for c in label}
    want = Counter((i, name[c], n) for (i, _), c, n in zip(near, label, links, strict=True))
    got = lsh_forest.near_duplicates(spark.createDataFrame(near, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_one_of_each_by_row(spark, near):
    label, _ = _classes(near)
    stay = {}
    for (i, text), c in zip(near, label, strict=True):
        if text:
            best = (i is None, i or 0, hashlib.sha256(text.encode()).digest())
            stay[c] = min(stay.get(c, (best, i, text)), (best, i, text), key=lambda x: x[0])
    want = Counter((i, t) for _, i, t in stay.values()) + Counter((i, t) for i, t in near if not t)
    df = spark.createDataFrame([(*r, 7) for r in near], "doc_id long, text string, _key int")
    got = lsh_forest.one_of_each(df)
    assert got.columns == df.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want
    # A copy of one text and another text under the same id: nothing but the copy goes.
    a, b, c = (_text(s) for s in (500, 501, 502))
    rows = lsh_forest.one_of_each(spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (3, a + " " + b)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in rows} == {(1, a), (2, b), (3, c), (3, a + " " + b)}


def test_clashing_columns(spark, near):
    """Stages keep columns that have the names they work with themselves."""
    names = ["_h", "_copy", "_source", "_with", "_full", "_prefix", "_cut", "_decided", "_key", "_of", "_ID", "row", "_line_score"]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, t and f"{t} {passage}", "ab"[n % 2], *range(n, n + len(names))) for n, (i, t) in enumerate(near)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{c} int' for c in names)}")
    for done in (mixing.mixed_documents(df), phrase_automata.without_repeats(df), lsh_forest.one_of_each(df)):
        assert done.columns == df.columns
        extra = {tuple(r[3:]) for r in rows}
        got = done.collect()
        assert got and all(tuple(r[3:]) in extra for r in got)
        assert all(r.doc_id == rows[r._h][0] and r.source == rows[r._h][2] for r in got)


def test_passages_of_texts_under_one_id(spark):
    """A document without an id loses nothing and makes nothing go; of texts with one id each has its own decision."""
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(1, _text(30) + " " + passage), (2, passage + " " + _text(31)), (2, _text(32)), (None, passage), (3, _text(33) + " x"), (None, _text(33)), (2, passage + " " + _text(31))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in phrase_automata.digest(df).collect())
    assert got == Counter([(1, 175, 0), (2, 175, 55), (2, 120, 0), (None, 55, 0), (3, 121, 0), (None, 120, 0), (2, 175, 55)])


def test_counts_of_the_language_model(spark):
    """base_score, n_known and train_tokens, recomputed from the contract; null, empty and repeated rows among them."""
    import math
    import zlib

    rows = [(i, _text(600 + i, 60).upper() if i % 3 else _text(600 + i, 90)) for i in range(60)] + [(60, None), (61, ""), (62, "only-here Once"), (0, _text(600, 90)), (None, "w1 w2 unseen")]
    got = log_bilinear.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    tokens = [[*(t or "").lower().split(), ""] for _, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for words, out in zip(tokens, held, strict=True) if not out for w in words)
    total, distinct = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, out, len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w), 6)) for (i, _), w, out in zip(rows, tokens, held, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)
