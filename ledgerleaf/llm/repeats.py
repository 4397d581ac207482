"""Finding texts that share long runs of units (words or bytes), and bringing the shared parts together.

Every run of ``length`` units holds a phrase of ``phrase`` units whose place follows from the run's content alone: the
core of ``core`` units with the least hash (winnowing) has ``gap`` units of the run to its left or to its right, and the
phrase is the core with that side. So equal runs share a phrase at the same place, and texts whose phrases occur nowhere
else hold no repeated run. The phrases of all distinct texts are counted; those that recur get a home, the first text
that has them; and the stretches around them are cut out and sent to the shard of that home, where equal runs meet.

Shards are sized by how often each text has its recurring phrases. The stretches are cut before a shard is split, so
that their true sizes tell which shards get too much (a passage in very many texts). These are split by text; their
home texts go to every part, and what the parts cannot settle is compared in slices by hash (``settle``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import WordHashes, free_names, if_small, key_column, mixed, sliced, text_key, texts_of, window_hashes
from ledgerleaf.store import materialize


@dataclass(frozen=True)
class Runs:
    """``length`` of a run, ``core`` of a phrase, the ``units`` of a shard, and whether a unit is a word or a byte."""

    length: int
    core: int
    units: int
    words: bool
    #: Whether a run that occurs twice in one text counts as repeated.
    same_text: bool

    @property
    def gap(self) -> int:
        return (self.length - self.core) // 2

    @property
    def phrase(self) -> int:
        return self.core + self.gap

    def parts(self, text: bytes) -> list[bytes]:
        return text.split() if self.words else [text]

    def values(self, text: bytes, hashes: WordHashes) -> np.ndarray:
        return hashes.of(text.split()) if self.words else np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)


#: A run found to be repeated waits for its equals in other parts of a split shard.
OPEN_RUN = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("key", "V16")])
FOUND = "key binary, start long, end long, shard long, slice long, open binary"


def run_hashes(values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every run."""
    return window_hashes(values, length), window_hashes(mixed(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), length)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    full = np.concatenate((x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrase_hashes(values: np.ndarray, runs: Runs) -> np.ndarray:
    """Hashes of the phrases of a text, one for each place."""
    if len(values) < runs.length:
        return np.empty(0, np.uint64)
    cores = window_hashes(values, runs.core)
    ranked = (cores & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(cores), dtype=np.uint64)
    at = (_sliding_least(ranked, runs.length - runs.core + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    hashes = window_hashes(values, runs.phrase)
    places = np.unique(np.concatenate((at, at - runs.gap)))
    return hashes[places[(places >= 0) & (places < len(hashes))]]


def scan(docs: DataFrame, runs: Runs) -> DataFrame:
    """(doc_id, key, n_units, phrases, places, again) of every document; key names its text. ``places`` tells at how many
    places of the text each phrase occurs; ``again`` are phrases that occur at several, and stays empty unless those count."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            keys, sizes, phrases, places, again = [], [], [], [], []
            for text in texts_of(batch):
                values = runs.values(text, hashes)
                found, count = np.unique(phrase_hashes(values, runs), return_counts=True)
                keys.append(text_key(text))
                sizes.append(len(values))
                phrases.append(found.view(np.int64))
                places.append(count)
                again.append(found[count > 1].view(np.int64) if runs.same_text else np.empty(0, np.int64))
            lists = pa.list_(pa.int64())
            arrays = [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(phrases, lists), pa.array(places, lists), pa.array(again, lists)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n_units", "phrases", "places", "again"])

    schema = "doc_id long, key binary, n_units long, phrases array<long>, places array<long>, again array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, schema)


def distinct_texts(scanned: DataFrame) -> DataFrame:
    """(key, first_id, copies, n_units, phrases, places, again): one row for each text."""
    first = [F.first(c).alias(c) for c in ("n_units", "phrases", "places", "again")]
    return scanned.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *first)


def recurring(texts: DataFrame, runs: Runs) -> DataFrame:
    """(key, first_id, home, phrase, places): phrases that recur, for each text that has them, and at how many places.

    Where runs within one text count, ids decide nothing, and texts without an id take part like all others.
    """
    rows = texts if runs.same_text else texts.filter("first_id is not null")
    each = rows.select("key", "first_id", F.explode("phrases").alias("phrase"))
    count = each.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("first_id", "key")).alias("least"))
    several = count.filter("n > 1").select("phrase", F.col("least.key").alias("home"))
    if runs.same_text:
        twice = rows.select(F.explode("again").alias("phrase"), F.col("key").alias("home"), "first_id")
        twice = twice.groupBy("phrase").agg(F.min(F.struct("first_id", "home")).alias("least")).select("phrase", F.col("least.home").alias("home"))
        several = several.unionByName(twice.join(several.select("phrase"), "phrase", "left_anti"))
    homes = materialize(several, "phrases")
    each = rows.select("key", "first_id", F.inline(F.arrays_zip(F.col("phrases").alias("phrase"), "places")))
    return materialize(each.join(if_small(homes), "phrase").select("key", "first_id", "home", "phrase", "places"), "recurring")


def stretches(docs: DataFrame, pairs: DataFrame, runs: Runs) -> DataFrame:
    """(shard, part, parts, key, first_id, own, start, stretch, places): the parts of texts around recurring phrases.

    ``places`` are those of the phrases in the stretch of a home text (``own``).
    """
    of_text = pairs.groupBy("key", "first_id", "home").agg(F.collect_list("phrase").alias("phrases"), F.sum("places").alias("places"))
    # Units that a text sends, about: a run's length, and the distance of phrases for each further place.
    load = F.lit(runs.length) + F.col("places") * (runs.length // 4)
    of_text = materialize(of_text.withColumn("load", load), "stretches")
    total = of_text.agg(F.sum("load")).first()[0] or 0
    shards = max(1, -(-total // runs.units))
    to = of_text.withColumn("shard", F.expr(f"pmod(xxhash64(home), {shards})"))
    sent = to.groupBy("key", "first_id", "shard").agg(
        F.flatten(F.collect_list("phrases")).alias("phrases"),
        F.flatten(F.collect_list(F.when(F.col("home") == F.col("key"), F.col("phrases")).otherwise(F.array().cast("array<long>")))).alias("own"),
    )
    sent = materialize(sent, "sent")
    # Eight bytes for each phrase and about a hundred for each row.
    narrow = sent.agg(F.sum(F.size("phrases") + F.size("own") + 16)).first()[0] or 0
    wanted = F.broadcast(sent) if narrow <= 1 << 23 else sent
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), key_column(F.col("text")).alias("_key"), "text").filter("text is not null")
    joined = rows.join(wanted, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("first_id"))).drop("_id", "_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        for batch in sliced(batches):
            columns = {c: batch.column(c).to_pylist() for c in ("shard", "key", "first_id")}
            phrases, own = batch.column("phrases"), batch.column("own")
            out = []
            last_text, last = None, None
            for i, text in enumerate(texts_of(batch)):
                key = columns["key"][i]
                if (columns["shard"][i], key) in done:  # a repeated row
                    continue
                done.add((columns["shard"][i], key))
                if text is not last_text and text != last_text:
                    values = runs.values(text, hashes)
                    last_text, last = text, (window_hashes(values, runs.phrase), runs.parts(text), len(values))
                hashed, pieces, n = last
                at = np.flatnonzero(np.isin(hashed, np.array(phrases[i].as_py(), np.int64).view(np.uint64)))
                homes = np.flatnonzero(np.isin(hashed, np.array(own[i].as_py(), np.int64).view(np.uint64)))
                low = np.maximum(at - (runs.length - runs.phrase), 0)
                high = np.minimum(at + runs.length, n)
                new = np.flatnonzero(np.concatenate(([True], low[1:] > np.maximum.accumulate(high)[:-1])))
                for a, b in zip(low[new].tolist(), np.maximum.reduceat(high, new).tolist(), strict=True):
                    stretch = b" ".join(pieces[a:b]) if runs.words else pieces[0][a:b]
                    inside = homes[(homes >= a) & (homes + runs.phrase <= b)] - a
                    out.append((columns["shard"][i], key, columns["first_id"][i], bool(len(homes)), b - a, a, stretch, inside.tolist()))
            if out:
                arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), _STRETCH_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=_STRETCH_NAMES)

    stretched = materialize(joined.mapInArrow(cut, _STRETCH), "cut")
    # A part holds what home texts send, and of all others no more than makes it twice a shard's units.
    homes, others = (F.coalesce(F.sum(F.when(F.col("own") == own, F.col("size"))), F.lit(0)) for own in (True, False))
    parts = F.greatest(F.lit(1), F.ceil(others / (2 * runs.units - F.least(homes, F.lit(runs.units))))).cast("long")
    per_shard = materialize(stretched.groupBy("shard").agg(parts.alias("parts")), "shards")
    part = F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.expr("pmod(xxhash64(key, 7), parts)")))
    return stretched.join(if_small(per_shard), "shard").withColumn("part", F.explode(part)).drop("size")


_STRETCH = "shard long, key binary, first_id long, own boolean, size long, start long, stretch binary, places array<int>"
_STRETCH_NAMES = [c.split()[0] for c in _STRETCH.split(", ")]
_STRETCH_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]


def found_table(key: list[bytes], starts: list[np.ndarray], length: int, shard: int, parts: int, open_runs: np.ndarray) -> pa.Table:
    """Rows of ``FOUND``: the merged spans of repeated runs of each stretch, and open runs packed by slice."""
    keys, low, high = [], [], []
    for name, at in zip(key, starts, strict=True):
        if len(at):
            new = np.flatnonzero(np.concatenate(([True], at[1:] > at[:-1] + length)))
            ends = np.concatenate((at[new[1:] - 1], at[-1:])) + length
            keys += [name] * len(new)
            low.append(at[new])
            high.append(ends)
    n = len(keys)
    low, high = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (low, high))
    slices, blobs = [], []
    if len(open_runs):
        number = (open_runs["h1"] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(number, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            slices.append(int(number[members[0]]))
            blobs.append(open_runs[members].tobytes())
    m = len(slices)
    return pa.table(
        {
            "key": pa.array(keys + [None] * m, pa.binary()), "start": pa.array([*low.tolist(), *[None] * m], pa.int64()), "end": pa.array([*high.tolist(), *[None] * m], pa.int64()),
            "shard": pa.array([shard] * (n + m), pa.int64()), "slice": pa.array([None] * n + slices, pa.int64()), "open": pa.array([None] * n + blobs, pa.binary()),
        }
    )


def settle(found: DataFrame, runs: Runs, repeated: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(key, spans) for each text with repeated runs, spans being pairs of start and end that may overlap.

    ``repeated`` tells which of the open runs, sorted by hash and then document, are repeated, given where a new hash
    starts. A slice gets from each of its shard's parts that part's share, so it is as large as a part.
    """

    def compared(table: pa.Table) -> pa.Table:
        runs_ = np.concatenate([np.frombuffer(x, OPEN_RUN) for x in table.column("open").to_pylist()])
        runs_ = runs_[np.lexsort((runs_["doc"], runs_["h2"], runs_["h1"]))]
        new = np.concatenate(([True], (runs_["h1"][1:] != runs_["h1"][:-1]) | (runs_["h2"][1:] != runs_["h2"][:-1])))
        hit = runs_[repeated(runs_, new)]
        return pa.table({"key": pa.array([k.tobytes() for k in hit["key"]], pa.binary()), "start": pa.array(hit["start"]), "end": pa.array(hit["start"] + runs.length)})

    more = found.filter("open is not null").groupBy("shard", "slice").applyInArrow(compared, "key binary, start long, end long")
    spans = found.filter("open is null").select("key", "start", "end").unionByName(more)
    return spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def covered(spans: list, n: int) -> np.ndarray:
    """Boolean mask of the units that lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        pairs = np.array([(s["start"], s["end"]) for s in spans])
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def with_decisions(docs: DataFrame, decisions: DataFrame, name: str, whole: Callable[[Column], Column]) -> DataFrame:
    """Documents with the decision on their text in the column ``name``: (whole, spans), or null where nothing goes.

    ``decisions`` has key, first_id, copies, n_units and spans, one row for each text; ``whole`` tells from these whether
    a document goes whole, and is null where it loses nothing.
    """
    own, theirs = free_names(docs.withColumn(name, F.lit(0)), "_key", "_of")
    each = decisions.select(F.col("key").alias(theirs), F.struct("first_id", "copies", "n_units", "spans").alias(name))
    each = materialize(each, "decisions")
    size = each.agg(F.sum(F.expr(f"8L + coalesce(greatest(size({name}.spans), 0), 0)"))).first()[0] or 0
    joined = docs.withColumn(own, key_column(F.col("text"))).join(F.broadcast(each) if size <= 1 << 22 else each, F.col(own) == F.col(theirs), "left")
    decided = F.struct(whole(F.col(name)).alias("whole"), F.col(name)["spans"].alias("spans"))
    return joined.drop(own, theirs).withColumn(name, F.when(F.col(name).isNotNull() & whole(F.col(name)).isNotNull(), decided))
