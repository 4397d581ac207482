"""Approximate nearest neighbours by a hash-prefix forest.

Every vector has a string of ``BITS`` sign bits (random hyperplanes through the mean) in each of ``TREES`` trees; a tree
is the sorted array of its strings. A query descends to the longest prefix it shares with others in each tree and then
ascends in all trees at once, a bit at a time, until the vectors that share the prefixes are enough candidates; their
exact distances decide. How many are enough is measured: for a bounded sample of queries the true neighbours are found
by a pass over all vectors, and with them how far the trees must be ascended for the target recall.

The array of a tree is spread over cells (its strings' first bits); a cell with too many vectors is split by id, and its
queries go to every part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.common import if_small, unit_hash
from ledgerleaf.store import materialize

TREES, BITS = 16, 16
NEIGHBOURS, QUERY_EVERY = 10, 100
#: Queries whose true neighbours are found to set the number of candidates, and the share of them to be met.
SAMPLE, RECALL = 128, 0.96
#: Vectors in a part of a cell.
PART = 50_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as bytes. Left out are null and zero vectors, those with a null or non-finite component or
    without an id, and those of another length than most have (the least such length)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    finite = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(f"{finite} and exists(embedding, x -> x != 0)")
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("embedding") == (sizes[0] if sizes else 0))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            values = column.flatten().to_numpy(zero_copy_only=False).astype("<f4" if kind == "float" else "<f8")
            raw = [r.tobytes() for r in values.reshape(batch.num_rows, -1)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(packed, "vec_id long, v binary")


def distinct(rows: DataFrame) -> DataFrame:
    """(vec_id, v, share): equal rows once; ``share`` is one over the vectors that the id has, so an id counts as one."""
    ids = materialize(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("vec_id").alias("_id")), "repeated")
    one = F.lit(1.0).alias("share")
    if not ids.head(1):
        return rows.select("vec_id", "v", one)
    ids = if_small(ids)
    same = F.col("vec_id") == F.col("_id")
    several = materialize(rows.join(ids, same, "left_semi").dropDuplicates(["vec_id", "v"]), "distinct")
    vectors = materialize(several.groupBy(F.col("vec_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")), "shares")
    shared = several.join(if_small(vectors), same).select("vec_id", "v", (1 / F.col("n")).alias("share"))
    return materialize(rows.join(ids, same, "left_anti").select("vec_id", "v", one).unionByName(shared), "once")


@dataclass
class Forest:
    """Hyperplanes and, for each level, how many vectors and ids have each prefix in each tree (at most 2^BITS a tree).

    An id with several vectors counts in ``ids`` by the share of them that have the prefix.
    """

    kind: str
    mean: np.ndarray
    planes: np.ndarray
    counts: list[np.ndarray] | None = None
    ids: list[np.ndarray] | None = None
    enough: float = 0

    def matrix(self, raw: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(raw), self.kind).reshape(len(raw), -1).astype(np.float64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Strings of the vectors as numbers: rows are vectors, columns are trees."""
        bits = ((x - self.mean) @ self.planes > 0).reshape(len(x), TREES, BITS)
        return bits @ (1 << np.arange(BITS - 1, -1, -1))

    def met(self, codes: np.ndarray, level: int) -> np.ndarray:
        """Sum over trees of the ids that share the first ``level`` bits."""
        return self.ids[level][np.arange(TREES), codes >> (BITS - level)].sum(axis=1)

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """The deepest level at which each query has met enough ids; 0 (all vectors) if there is none."""
        best = np.zeros(len(codes), np.int64)
        for level in range(1, BITS + 1):
            best[self.met(codes, level) >= self.enough] = level
        return best


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest common prefix over the trees of every string of ``a`` with every string of ``b``."""
    best = np.zeros((len(a), len(b)), np.int64)
    for t in range(TREES):
        differ = a[:, None, t] ^ b[None, :, t]
        best = np.maximum(best, BITS - np.ceil(np.log2(differ + 1)).astype(np.int64))
    return best


def _nearest(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest ids, each by its nearest row, ties to smaller ids."""
    most = k
    while True:
        every = len(distance) <= most
        near = np.arange(len(distance)) if every else np.flatnonzero(distance <= np.partition(distance, most - 1)[most - 1])
        near = near[np.lexsort((ids[near], distance[near]))]
        first = np.sort(np.unique(ids[near], return_index=True)[1])
        if every or len(first) >= k:
            return near[first[:k]]
        most *= 4  # rows of ids that are there already


def build(vectors: DataFrame, queries: DataFrame, kind: str) -> Forest:
    """Mean, hyperplanes, prefix counts, and the number of candidates that meets the target recall on the sample."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("v").to_pylist()), kind).reshape(batch.num_rows, -1)
                n, total = n + len(x), total + x.sum(axis=0, dtype=np.float64)
        if n:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "total": total, "n": np.full(len(total), n)})

    # As many rows as a vector has components.
    sums = vectors.mapInArrow(added, "i long, total double, n long").groupBy("i").agg((F.sum("total") / F.sum("n")).alias("mean")).toPandas().sort_values("i")
    mean = sums["mean"].to_numpy()
    planes = np.random.default_rng(11).standard_normal((len(mean), TREES * BITS))
    forest = Forest(kind, mean, planes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids = np.zeros(TREES << BITS, np.int64), np.zeros(TREES << BITS)
        for batch in batches:
            if batch.num_rows:
                codes = forest.codes(forest.matrix(batch.column("v").to_pylist()))
                cell = (codes + (np.arange(TREES) << BITS)).ravel()
                total += np.bincount(cell, minlength=len(total))
                ids += np.bincount(cell, np.repeat(batch.column("share").to_numpy(), TREES), len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": at, "n": total[at], "ids": ids[at]})

    # At most TREES * 2^BITS rows.
    cells = vectors.mapInArrow(counted, "cell long, n long, ids double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).toPandas()
    full, ids = np.zeros(TREES << BITS, np.int64), np.zeros(TREES << BITS)
    full[cells["cell"]] = cells["n"]
    ids[cells["cell"]] = cells["ids"]
    forest.counts, forest.ids = ([x.reshape(TREES, 1 << level, -1).sum(axis=2) for level in range(BITS + 1)] for x in (full, ids))
    sample = queries.orderBy(unit_hash("forest", F.col("vec_id")), "vec_id").limit(SAMPLE).toPandas()
    if len(sample):
        forest.enough = _enough(vectors, sample, forest)
    return forest


def _enough(vectors: DataFrame, sample, forest: Forest) -> float:
    ids = sample["vec_id"].to_numpy()
    q = forest.matrix([bytes(v) for v in sample["v"]])
    codes = forest.codes(q)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, own = forest.matrix(batch.column("v").to_pylist()), batch.column("vec_id").to_numpy()
                bits = shared_bits(codes, forest.codes(x))
                squares = (x * x).sum(1)
                for i in range(len(ids)):
                    distance = np.where(own == ids[i], np.inf, squares - 2 * (x @ q[i]))
                    near = _nearest(distance, own, NEIGHBOURS)
                    yield pa.RecordBatch.from_pydict({"q": np.full(len(near), i), "vec_id": own[near], "far": distance[near], "bits": bits[i, near]})

    found = vectors.mapInArrow(nearest, "q long, vec_id long, far double, bits long").filter("far < double('infinity')")
    place = F.row_number().over(Window.partitionBy("q").orderBy("far", "vec_id"))
    # The nearest row of each id, of equally near ones that with the longest prefix.
    found = found.groupBy("q", "vec_id").agg(F.min(F.struct("far", (-F.col("bits")).alias("less"))).alias("least")).select("q", "vec_id", "least.far", (-F.col("least.less")).alias("bits"))
    true = found.withColumn("place", place).filter(F.col("place") <= NEIGHBOURS).select("q", "bits").toPandas()
    if not len(true):
        return 0
    need = np.array([forest.met(codes[q : q + 1], bits)[0] for q, bits in zip(true["q"], true["bits"], strict=True)])
    # With 11 ids a tree on average, one tree has 10 besides the query.
    return max(float(np.quantile(need, RECALL, method="higher")), TREES * (NEIGHBOURS + 1))


def search(vectors: DataFrame, every: int = QUERY_EVERY, neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors of those whose id is divisible by ``every``.

    Defined cases: vectors that ``usable`` leaves out are neither queries nor candidates; of rows that share an id the
    nearest counts, and none is a neighbour of its own id; ties go to the smaller id; an empty table gives no rows.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    known = distinct(materialize(usable(vectors), "vectors"))
    queries = known.filter(F.col("vec_id") % every == 0).select("vec_id", "v")
    built = build(known, queries, kind)
    shared = known.sparkSession.sparkContext.broadcast(built)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                levels = shared.value.levels(shared.value.codes(shared.value.matrix(batch.column("v").to_pylist())))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(levels)], names=["query_id", "q", "level"])

    placed = materialize(queries.mapInArrow(asked, "query_id long, q binary, level long"), "queries")
    # Cells have the depth at which most queries end.
    depth = placed.agg(F.percentile_approx("level", 0.5)).first()[0] or 0
    parts = np.maximum(1, -(-built.counts[depth] // PART))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw, ids = batch.column("v").to_pylist(), batch.column("vec_id").to_numpy()
                codes = shared.value.codes(shared.value.matrix(raw))
                for t in range(TREES):
                    cell = codes[:, t] >> (BITS - depth)
                    part = ids % parts[t, cell]
                    yield pa.RecordBatch.from_arrays([pa.array(t * (1 << depth) + cell), pa.array(part), pa.array(codes[:, t]), batch.column("vec_id"), batch.column("v")], names=["cell", "part", "code", "vec_id", "v"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            if batch.num_rows:
                codes = shared.value.codes(shared.value.matrix(batch.column("q").to_pylist()))
            for i, level in enumerate(batch.column("level").to_pylist()):
                for t in range(TREES if level else 1):  # at level 0 one tree has all vectors
                    low = int(codes[i, t]) >> (BITS - level) << (BITS - level)
                    high = low + (1 << (BITS - level)) - 1
                    for cell in range(low >> (BITS - depth), (high >> (BITS - depth)) + 1):
                        rows += [(t * (1 << depth) + cell, p, i, low, high) for p in range(parts[t, cell])]
            if rows:
                cell, part, i, low, high = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part), batch.column("query_id").take(pa.array(i)), batch.column("q").take(pa.array(i)), pa.array(low), pa.array(high)], names=["cell", "part", "query_id", "q", "low", "high"])

    def nearest(index: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if index.num_rows and asking.num_rows:
            order = np.argsort(index.column("code").to_numpy(), kind="stable")
            code, ids = index.column("code").to_numpy()[order], index.column("vec_id").to_numpy()[order]
            raw = np.frombuffer(b"".join(index.column("v").to_pylist()), kind).reshape(len(ids), -1)[order]
            q = np.frombuffer(b"".join(asking.column("q").to_pylist()), kind).reshape(asking.num_rows, -1).astype(np.float64)
            lo = np.searchsorted(code, asking.column("low").to_numpy(), "left")
            hi = np.searchsorted(code, asking.column("high").to_numpy(), "right")
            for i, name in enumerate(asking.column("query_id").to_pylist()):
                mine = np.flatnonzero(ids[lo[i] : hi[i]] != name) + lo[i]
                distance = np.sqrt(((raw[mine].astype(np.float64) - q[i]) ** 2).sum(axis=1))
                near = _nearest(distance, ids[mine], neighbours)
                for column, x in zip(out, (np.full(len(near), name), ids[mine][near], distance[near]), strict=True):
                    column.append(x)
        joined = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({"query_id": pa.array(joined[0].astype(np.int64)), "vec_id": pa.array(joined[1].astype(np.int64)), "score": pa.array(joined[2].astype(np.float64))})

    index = known.mapInArrow(spread, "cell long, part long, code long, vec_id long, v binary").groupBy("cell", "part")
    asking = placed.mapInArrow(visits, "cell long, part long, query_id long, q binary, low long, high long").groupBy("cell", "part")
    found = index.cogroup(asking).applyInArrow(nearest, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
