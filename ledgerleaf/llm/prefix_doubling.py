"""Suffix-array dedup by distributed prefix doubling.

Byte strings of 400 bytes that occur at two places go, wherever they start. Stretches of text that can hold one are
brought together by ``repeats``; there every place gets a rank by its first 8 bytes, and pairs of ranks (at a place and
``offset`` bytes on) are sorted and ranked again for offsets 8, 16, ... 256 and, to end at 400, 144. Places whose rank
is unique drop out as they appear. What still shares a rank past the threshold is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm import repeats
from ledgerleaf.llm.common import sliced, texts_of
from ledgerleaf.store import materialize

LENGTH = 400
FIRST = 8
RUNS = repeats.Runs(length=LENGTH, core=48, units=1_000_000, words=False, same_text=True)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each value, or -1 if it is unique; which aren't unique)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    alone = new & np.concatenate((new[1:], [True]))
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.where(alone, -1, np.cumsum(new) - 1)
    return ranks, ranks >= 0


def repeated_starts(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts of strings of ``length`` bytes that occur twice or more, a number of each string).

    ``data`` holds stretches one after another, and ``ends[i]`` is where the stretch of byte i ends.
    """
    places = np.flatnonzero(np.arange(len(data)) + FIRST <= ends)
    value = np.zeros(len(places), np.uint64)
    for k in range(FIRST):
        value = (value << np.uint64(8)) | data[places + k].astype(np.uint64)
    rank = np.full(len(data) + 1, -1, np.int64)
    size = FIRST
    rank[places], stay = _ranked(value)
    places = places[stay]
    while size < length and len(places):
        offset = min(size, length - size)
        # A place stays only if the string there and the one ``offset`` on both occur elsewhere.
        fits = places[places + size + offset <= ends[places]]
        fits = fits[rank[fits + offset] >= 0]
        pairs = rank[fits] * np.int64(len(data)) + rank[fits + offset]
        rank[:] = -1
        rank[fits], stay = _ranked(pairs)
        places, size = fits[stay], size + offset
    return places, rank[places]


def _doubled(table: pa.Table) -> pa.Table:
    """Spans of repeated strings in the stretches of a part of a shard."""
    stretches = table.column("stretch").to_pylist()
    keys, starts, docs = (table.column(c).to_pylist() for c in ("key", "start", "first_id"))
    sizes = np.array([len(s) for s in stretches])
    data = np.frombuffer(b"".join(stretches), np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    ends = (begins + sizes)[row_of]
    places, rank = repeated_starts(data, ends)
    places.sort()
    row = row_of[places]
    absolute = places - begins[row] + np.array(starts, np.int64)[row]
    cuts = np.flatnonzero(np.diff(row)) + 1
    hit_keys = [keys[r] for r in row[np.concatenate(([0], cuts)).astype(int)]] if len(row) else []
    parts = table.column("parts")[0].as_py()
    open_runs = np.empty(0, repeats.OPEN_RUN)
    if parts > 1:  # one of each string that no home text has
        own = np.array(table.column("own").to_pylist(), bool)
        rows = [_open_runs(keys[i], -1 if docs[i] is None else docs[i], starts[i], data[begins[i] : begins[i] + sizes[i]]) for i in range(len(keys))]
        homes = np.concatenate([r["h1"] for r, o in zip(rows, own, strict=True) if o] or [np.empty(0, np.uint64)])
        rest = np.concatenate([r for r, o in zip(rows, own, strict=True) if not o] or [open_runs])
        rest = rest[~np.isin(rest["h1"], homes)]
        open_runs = rest[np.unique(rest["h1"], return_index=True)[1]]
    return repeats.found_table(hit_keys, np.split(absolute, cuts) if len(absolute) else [], LENGTH, table.column("shard")[0].as_py(), parts, open_runs)


def _open_runs(key: bytes, doc: int, start: int, data: np.ndarray) -> np.ndarray:
    h1, h2 = repeats.run_hashes(data.astype(np.uint64) + np.uint64(1), LENGTH)
    out = np.empty(len(h1), repeats.OPEN_RUN)
    out["h1"], out["h2"], out["doc"], out["start"], out["key"] = h1, h2, doc, start + np.arange(len(h1)), np.void(key)
    return out


def _several(runs: np.ndarray, new: np.ndarray) -> np.ndarray:
    group = np.cumsum(new) - 1
    return np.bincount(group)[group] > 1


def decisions(docs: DataFrame) -> DataFrame:
    """(key, first_id, copies, n_units, spans) of the texts that lose bytes: those in the spans, or all if there are copies."""
    scanned = materialize(repeats.scan(docs, RUNS), "scanned")
    texts = materialize(repeats.distinct_texts(scanned), "texts")
    pairs = repeats.recurring(texts, RUNS)
    sent = repeats.stretches(docs, pairs, RUNS)
    found = materialize(sent.groupBy("shard", "part").applyInArrow(_doubled, repeats.FOUND), "found")
    spans = repeats.settle(found, RUNS, _several)
    of_text = texts.select("key", "first_id", "copies", "n_units").join(spans, "key", "left")
    return of_text.filter(_whole(F.struct("copies", "n_units")) | F.col("spans").isNotNull())


def _whole(of: Column) -> Column:
    """True for texts that go whole: those with copies that are long enough."""
    return (of["copies"] > 1) & (of["n_units"] >= LENGTH)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    Defined cases: a null or empty text has no bytes; texts under 400 bytes stay; every copy of a longer text goes
    whole; ids decide nothing, so documents without one or with a shared one are like all others; an empty table gives
    no rows.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text, decided in zip(texts_of(batch), batch.column("_cut").to_pylist(), strict=True):
                gone = np.zeros(len(text), bool)
                if decided:
                    gone = np.ones(len(text), bool) if decided["whole"] else repeats.covered(decided["spans"], len(text))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), int(gone.sum()), int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = repeats.with_decisions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), decisions(docs), "_cut", _whole)
    return rows.mapInArrow(told, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
