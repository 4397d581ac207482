"""Substring dedup by repeated-phrase automata.

Passages that recur are confirmed by counting phrases of all distinct texts (``repeats``). Each shard compiles the
phrases of its home texts into an Aho-Corasick automaton and streams the stretches of all documents sent to it: every
occurrence tells which windows of 50 words may be repeated, and those are compared. A word goes if a window that covers
it also starts in a document with a smaller id; windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm import repeats
from ledgerleaf.llm.common import WordHashes, free_names, sliced, texts_of
from ledgerleaf.store import materialize

WINDOW = 50
RUNS = repeats.Runs(length=WINDOW, core=8, units=300_000, words=True, same_text=False)
#: The words of a phrase that its automaton looks for.
_MIDDLE = slice((RUNS.phrase - RUNS.core) // 2, (RUNS.phrase - RUNS.core) // 2 + RUNS.core)


def _located(table: pa.Table) -> pa.Table:
    """Spans of repeated windows in the stretches of a part of a shard."""
    keys, docs, own, starts = (table.column(c).to_pylist() for c in ("key", "first_id", "own", "start"))
    stretches = table.column("stretch").to_pylist()
    parts = table.column("parts")[0].as_py()
    automaton = ahocorasick.Automaton()
    for stretch, places in zip(stretches, table.column("places").to_pylist(), strict=True):
        if places:
            words = stretch.split(b" ")
            for p in places:
                # Bytes as characters, so places in the text are places in its bytes.
                core = (b" " + b" ".join(words[p + _MIDDLE.start : p + _MIDDLE.stop]) + b" ").decode("latin-1")
                automaton.add_word(core, len(core))
    if not len(automaton):
        return repeats.found_table([], [], WINDOW, 0, 1, np.empty(0, repeats.OPEN_RUN))
    automaton.make_automaton()
    hashes = WordHashes()
    columns = [[], [], [], []]  # both hashes, row, start within the stretch
    for row, stretch in enumerate(stretches):
        ends = [(end, size) for end, size in automaton.iter((b" " + stretch + b" ").decode("latin-1"))]
        values = hashes.of(stretch.split(b" "))
        n = len(values) - WINDOW + 1
        if not ends or n <= 0:
            continue
        gaps = np.flatnonzero(np.frombuffer(b" " + stretch, np.uint8) == 32)
        first = np.searchsorted(gaps, np.array([end - size + 1 for end, size in ends])) - _MIDDLE.start
        low, high = np.clip(first + RUNS.phrase - WINDOW, 0, n), np.clip(first + 1, 0, n)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, np.maximum(high, low), -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        h1, h2 = repeats.run_hashes(values, WINDOW)
        for column, x in zip(columns, (h1[at], h2[at], np.full(len(at), row), at), strict=True):
            column.append(x)
    if not columns[0]:
        return repeats.found_table([], [], WINDOW, 0, 1, np.empty(0, repeats.OPEN_RUN))
    h1, h2, row, at = map(np.concatenate, columns)
    doc = np.array(docs, np.int64)[row]
    order = np.lexsort((doc, h2, h1))
    h1, h2, row, at, doc = h1[order], h2[order], row[order], at[order], doc[order]
    new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    later = doc > doc[new][np.cumsum(new) - 1]
    absolute = at + np.array(starts, np.int64)[row]
    by_row = np.lexsort((absolute[later], row[later]))
    rows_hit, at_hit = row[later][by_row], absolute[later][by_row]
    cuts = np.flatnonzero(np.diff(rows_hit)) + 1
    hit_keys = [keys[r] for r in rows_hit[np.concatenate(([0], cuts)).astype(int)]] if len(rows_hit) else []
    open_runs = np.empty(0, repeats.OPEN_RUN)
    if parts > 1:  # the first of its kind here, unless every part has it
        waits = np.flatnonzero(new & ~np.array(own, bool)[row])
        open_runs = np.empty(len(waits), repeats.OPEN_RUN)
        names = np.frombuffer(b"".join(keys), "V16")
        for field, x in (("h1", h1), ("h2", h2), ("doc", doc), ("start", absolute), ("key", names[row])):
            open_runs[field] = x[waits]
    return repeats.found_table(hit_keys, np.split(at_hit, cuts) if len(at_hit) else [], WINDOW, table.column("shard")[0].as_py(), parts, open_runs)


def _later(runs: np.ndarray, new: np.ndarray) -> np.ndarray:
    return runs["doc"] > runs["doc"][new][np.cumsum(new) - 1]


def decisions(docs: DataFrame) -> DataFrame:
    """(key, first_id, copies, n_units, spans) of the texts that lose words: those in the spans, or all in later copies."""
    scanned = materialize(repeats.scan(docs, RUNS), "scanned")
    texts = materialize(repeats.distinct_texts(scanned), "texts")
    pairs = repeats.recurring(texts, RUNS)
    sent = repeats.stretches(docs, pairs, RUNS)
    found = materialize(sent.groupBy("shard", "part").applyInArrow(_located, repeats.FOUND), "found")
    spans = repeats.settle(found, RUNS, _later)
    of_text = texts.filter("first_id is not null").select("key", "first_id", "copies", "n_units").join(spans, "key", "left")
    return of_text.filter(f"spans is not null or (copies > 1 and n_units >= {WINDOW})")


def _whole(of: Column) -> Column:
    """True for a later document with a text that is long enough; null without an id, since such a document loses nothing."""
    return (F.col("doc_id").cast("long") > of["first_id"]) & (of["n_units"] >= F.when(F.col("doc_id").cast("long").isNotNull(), WINDOW))


def _kept(text: bytes, decided: dict | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many go."""
    words = text.split()
    if not decided:
        return words, 0
    if decided["whole"]:
        return [], len(words)
    gone = repeats.covered(decided["spans"], len(words))
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document.

    Defined cases: a null or empty text has no words; a document without an id loses nothing and makes nothing go; rows
    that share an id aren't earlier than each other; texts under 50 words stay; an empty table gives no rows.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, removed, sha = [], [], []
            for text, decided in zip(texts_of(batch), batch.column("_cut").to_pylist(), strict=True):
                words, gone = _kept(text, decided)
                n.append(len(words) + gone)
                removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = repeats.with_decisions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), decisions(docs), "_cut", _whole)
    return rows.mapInArrow(told, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents with the repeated words taken out of their texts (then joined by single spaces); all other texts and
    columns stay as they are, and documents of which no word stays by this are dropped.

    Defined cases: as in ``digest``; null, empty and blank texts stay as they are; columns may have any names.
    """
    names = docs.columns
    (cut_name,) = free_names(docs, "_cut")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, stays = [], []
            for text, raw, decided in zip(batch.column("text").to_pylist(), texts_of(batch), batch.column(cut_name).to_pylist(), strict=True):
                words, gone = _kept(raw, decided)
                texts.append(b" ".join(words).decode() if gone else text)
                stays.append(bool(words) or not gone)
            columns = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    return repeats.with_decisions(docs, decisions(docs), cut_name, _whole).mapInArrow(cut, T.StructType(docs.schema.fields))
