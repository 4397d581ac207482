"""N-gram Jaccard join by MinHash with fixed banding, in place of an LSH forest.

Every text becomes the set of its runs of five words and a MinHash signature. Tree t holds values t * DEPTH ... of each,
and texts meet where their prefixes in a tree agree. No trie is sorted or descended: all texts have one prefix length,
the longest at which the chance that a pair at the threshold meets in no tree is at most 1 - recall. That is 3 of the
DEPTH values, so trees are 24 bands of 3 rows and the last two values serve the signature comparison only. Texts that meet are
compared by signature, which splits them into clusters (joined by pairs whose signatures agree well below the
threshold), and all pairs of a cluster are then verified exactly, block against block. Pairs never become rows: a block
pair returns the number of links of each text and a spanning forest of them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import WORD, WordHashes, free_names, if_small, key_column, mixed, sliced, texts_of, window_hashes
from ledgerleaf.llm.components import components
from ledgerleaf.llm.ranks import rank_within
from ledgerleaf.store import materialize

WORDS = 5
THRESHOLD = (4, 5)
TREES, DEPTH = 24, 5
RECALL = 1 - 1e-7
#: Share of equal signature values from which two texts belong to one cluster: six standard deviations below 0.8.
NEAR = 0.58
#: Texts that meet at one trie node and are compared by signature; at larger nodes all belong to one cluster.
NODE = 2048
#: Texts in a block of the verification, and columns of its incidence matrix at a time.
BLOCK, COLUMNS = 1024, 1024
#: Rows of a pair matrix that a step works on, so that temporaries stay far smaller than the matrix.
ROWS = 128

_FACTORS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OFFSETS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def prefix_length(recall: float = RECALL, threshold: float = THRESHOLD[0] / THRESHOLD[1], trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with probability ``recall``; 1 at least."""
    for length in range(depth, 1, -1):
        if (1 - threshold**length) ** trees <= 1 - recall:
            return length
    return 1


def shingles(text: bytes, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words make one run, no words none."""
    words = text.split()
    return np.unique(window_hashes(hashes.of(words), min(width, len(words)) or 1))


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 2048):
        low = np.minimum(low, (found[start : start + 2048, None] * _FACTORS + _OFFSETS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, key, sig) of every document; key names its set of runs, null without words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches):
            keys, sigs = [], []
            for text in texts_of(batch):
                found = shingles(text, hashes)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            arrays = [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "key", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_column(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(made, "doc_id long, text_key binary, key binary, sig binary")


def _prefixes(nodes: DataFrame, length: int) -> DataFrame:
    """(bucket, key): the trie node of each tree that a text is in."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
            bucket = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (n, TREES))
            for k in range(length):
                bucket = mixed(bucket * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k] + np.uint64(1))
            keys = batch.column("key").take(pa.array(np.repeat(np.arange(n), TREES)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.reshape(-1).view(np.int64)), keys], names=["bucket", "key"])

    return nodes.select("key", "sig").mapInArrow(made, "bucket long, key binary")


def forest_edges(near: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for every member of a component of a symmetric boolean matrix."""
    n = len(near)
    label = np.arange(n)
    while True:
        low = label.copy()
        for start in range(0, n, ROWS):
            part = slice(start, start + ROWS)
            low[part] = np.minimum(low[part], np.where(near[part], label[None, :], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            return [(int(r), i) for i, r in enumerate(label.tolist()) if r != i]
        label = low


def _near_edges(table: pa.Table) -> pa.Table:
    """Edges between texts of a trie node whose signatures agree in ``NEAR`` of the values; several nodes at once."""
    bucket = table.column("bucket").to_numpy()
    keys = table.column("key").to_pylist()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(keys), -1)
    # By key within a node, so that a task that is run again returns the same edges whatever order its rows come in.
    order = np.array(sorted(range(len(keys)), key=lambda i: (bucket[i], keys[i])), np.int64)
    u, v = [], []
    for members in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        rows = sig[members]
        near = np.zeros((len(members), len(members)), bool)
        for start in range(0, len(members), 64):
            near[start : start + 64] = (rows[start : start + 64, None] == rows[None]).mean(axis=2) >= NEAR
        for root, i in forest_edges(near):
            u.append(keys[members[root]])
            v.append(keys[members[i]])
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def clusters(nodes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(node, root): clusters that hold every pair at the threshold; texts that meet no other are left out."""
    meets = _prefixes(nodes, prefix_length(recall))
    size = meets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("pivot"), F.bit_xor(F.xxhash64("key")).alias("_set"))
    # Trie nodes with the same texts are one: the same count, least text and combined hash.
    size = size.filter("n > 1").groupBy("n", "pivot", "_set").agg(F.min("bucket").alias("bucket"))
    size = materialize(size.select("bucket", "n", "pivot"), "trie")
    members = materialize(meets.join(if_small(size), "bucket"), "members")
    small = members.filter(F.col("n") <= NODE)
    parts = max(1, -(-small.count() // 1000))
    told = nodes.select("key", "sig").join(if_small(small), "key").select(F.expr(f"pmod(xxhash64(bucket), {parts})").alias("part"), "bucket", "key", "sig")
    compared = told.groupBy("part").applyInArrow(_near_edges, "u binary, v binary")
    stars = members.filter((F.col("n") > NODE) & (F.col("key") != F.col("pivot"))).select(F.col("pivot").alias("u"), F.col("key").alias("v"))
    return components(compared.unionByName(stars))


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the texts of block pairs: for each text the copies it is linked to, and a spanning forest."""
    hashes = WordHashes()
    groups = defaultdict(list)
    root, a, b = (table.column(c).to_pylist() for c in ("root", "a", "b"))
    for i, name in enumerate(zip(root, a, b, strict=True)):
        groups[name].append(i)
    keys, block, copies = table.column("key").to_pylist(), table.column("block").to_numpy(), table.column("copies").to_numpy()
    texts = table.column("text")
    u, v, links = [], [], []
    for (_, left, right), rows in groups.items():
        rows.sort(key=lambda i: keys[i])
        sets = [shingles((texts[i].as_py() or "").encode(), hashes) for i in rows]
        linked = _linked(sets)
        here = block[rows]
        if left != right:  # pairs within a block are counted where it is paired with itself
            linked &= here[:, None] != here[None]
        count = linked @ copies[rows]
        for i, n in enumerate(count.tolist()):
            if n:
                u.append(keys[rows[i]])
                v.append(None)
                links.append(n)
        for r, i in forest_edges(linked):
            u.append(keys[rows[r]])
            v.append(keys[rows[i]])
            links.append(0)
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "links": pa.array(links, pa.int64())})


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity at the threshold; intersections by matrix products."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), np.int32)
    for start in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        incidence = np.zeros((n, COLUMNS), np.float32)
        incidence[row[lo:hi], column[lo:hi] - start] = 1
        for first in range(0, n, ROWS):
            # Sums of at most COLUMNS ones are exact in 32-bit floats.
            common[first : first + ROWS] += (incidence[first : first + ROWS] @ incidence.T).astype(np.int32)
    over, under = THRESHOLD
    linked = np.empty((n, n), bool)
    for first in range(0, n, ROWS):
        part = slice(first, first + ROWS)
        linked[part] = (over + under) * common[part].astype(np.int64) >= over * (sizes[part, None] + sizes[None])
    np.fill_diagonal(linked, False)
    return linked


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for every document.

    Two documents are linked if the Jaccard similarity of their sets of five-word runs is 0.8 or more; copies are
    linked. A class is a connected component of links, named by its least doc_id; n_links counts the documents that one
    is linked to. Defined cases: texts of one to four words have one run; texts without words (and null) are linked to
    none; a class of documents without ids has a null name; repeated rows are documents of their own; an empty table
    gives no rows.
    """
    return classes(docs, recall).select("doc_id", "class_id", "n_links")


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_key, root, class_id, n_links) for every document; root names its class and is null without words."""
    sigs = materialize(signatures(docs), "signatures")
    named = sigs.filter("key is not null").groupBy("key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    nodes = named.agg(F.count(F.lit(1)).alias("copies"), first, F.min("sig").alias("sig"))
    nodes = materialize(nodes.select("key", "copies", "sig", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_text")), "nodes")
    cluster = clusters(nodes, recall)
    verified = materialize(_verified(docs, nodes, cluster), "links")
    links = verified.filter("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    roots = components(verified.filter("v is not null"))
    known = nodes.select("key", "copies", "first_id").join(links, F.col("key") == F.col("u"), "left").join(roots, F.col("key") == F.col("node"), "left")
    known = known.select("key", "first_id", F.coalesce("root", "key").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = materialize(known, "classes")
    least = known.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = known.join(least, "root").select(F.col("key").alias("_key"), "root", "class_id", "n_links")
    alone = F.col("key").isNull()
    return sigs.join(named, F.col("key") == F.col("_key"), "left").select(
        "doc_id", "text_key", "root", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def _verified(docs: DataFrame, nodes: DataFrame, cluster: DataFrame) -> DataFrame:
    """(u, v, links): links counted for u where v is null, else a link of a spanning forest."""
    of_cluster = nodes.join(cluster, F.col("key") == F.col("node")).select("root", "key", "copies", "first_id", "first_text")
    ranked = rank_within(of_cluster, ["root"], ["key"], "_rank").withColumn("block", F.expr(f"_rank div {BLOCK}"))
    ranked = materialize(ranked, "ranked")
    blocks = ranked.groupBy("root").agg((F.max("block") + 1).alias("_blocks"))
    paired = ranked.join(blocks, "root").withColumn("_other", F.explode(F.expr("sequence(0L, _blocks - 1)")))
    paired = materialize(paired.select("root", "key", "copies", "block", F.least("block", "_other").alias("a"), F.greatest("block", "_other").alias("b")), "pairs")
    texts = _keyed_texts(docs, ranked)
    parts = max(1, -(-paired.count() // 1000))
    sent = if_small(paired).join(texts, paired["key"] == texts["_key"]).select(
        F.expr(f"pmod(xxhash64(root, a, b), {parts})").alias("part"), "root", "a", "b", "block", "key", "copies", "text"
    )
    return sent.groupBy("part").applyInArrow(_block_links, "u binary, v binary, links long")


def _keyed_texts(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """(_key, text): one text for each set of runs in ``ranked``."""
    wanted = if_small(ranked.select("first_id", "first_text", F.col("key").alias("_key")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_column(F.col("text")).alias("text_key"), "text")
    same = (F.col("text_key") == F.col("first_text")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return rows.join(wanted, same).select("_key", "text").dropDuplicates(["_key"])


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows that stay if of each class of near-duplicates only one does: that with the least doc_id, then text key.

    Defined cases: rows are told apart by id and text, so texts that share an id are judged each on its own; rows without
    an id come last in their class; of rows with the same id and text one stays, whichever; texts without words (and
    null) are in no class and all stay; columns may have any names.
    """
    rows = classes(docs, recall).filter("root is not null").groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "rows")).alias("least")
    number, key, number_kept, key_kept = free_names(docs, "_id", "_key", "_id_kept", "_key_kept")
    stays = rows.groupBy("root").agg(least).select(F.col("least.doc_id").alias(number_kept), F.col("least.text_key").alias(key_kept), F.col("least.rows").alias("rows"))
    stays = materialize(stays, "stays")
    single, several = (stays.filter(x).drop("rows") for x in ("rows = 1", "rows > 1"))
    wordless = F.coalesce(~F.col("text").rlike(WORD), F.lit(True))
    named = docs.filter(~wordless).withColumns({number: F.col("doc_id").cast("long"), key: key_column(F.col("text"))})
    same = (F.col(key) == F.col(key_kept)) & F.col(number).eqNullSafe(F.col(number_kept))
    kept = named.join(if_small(single), same, "left_semi")
    repeated = named.join(if_small(several), same, "left_semi").dropDuplicates([number, key])
    return kept.unionByName(repeated).drop(number, key).unionByName(docs.filter(wordless))
