"""Best-fit packing by swap-based local search.

Documents are tokenised where they are read. The pieces of documents (two dozen bytes each) are dealt evenly into blocks;
each block is packed best-fit first, largest pieces before smaller ones, and then improved: moving a piece, or exchanging
one for one or two for one between bins that aren't full, whenever that raises the sum of squared fills, until no bin can
give to one that is at least as full.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerleaf.llm.common import sliced
from ledgerleaf.store import materialize

CAPACITY = 2048
#: Pieces that one task packs; a block leaves a bin or two that aren't full.
BLOCK = 1 << 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@functools.lru_cache(maxsize=1)  # one for each Python worker
def encoder(name: str = "byte_bpe_50k"):
    """Ids of a text, as ``tokenizers`` gives them for ``name``.json with special tokens as ordinary text.

    The same vocabulary and pattern run in ``tiktoken`` four times as fast (a test compares the ids).
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: a document's ids and a closing id 0. The first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, start in enumerate(starts):
                    end = starts[k + 1] if k + 1 < len(starts) else len(ids)
                    rows.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (lists of indexes), each piece into the fullest bin that it fits in, largest piece first."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


def _amounts(members: list[int], sizes: np.ndarray) -> np.ndarray:
    """What a bin can give back for a piece: nothing, one of its pieces or two of them."""
    own = sizes[members]
    first, second = np.triu_indices(len(own), 1)
    return np.unique(np.concatenate(([0], own, own[first] + own[second])))


class _Takers:
    """Bins with room, by what they give back and by free room: (capacity + 1)² counts of four bytes, 17 MB for 2048."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int) -> None:
        self.bins, self.sizes, self.back = bins, sizes, np.arange(capacity + 1)
        self.count = np.zeros((capacity + 1, capacity + 1), np.int32)  # by amount and room
        self.most = np.full(capacity + 1, -1, np.int64)  # the largest room of a bin that gives each amount
        self.amounts: dict[int, np.ndarray] = {}
        self.by_room: dict[int, dict[int, None]] = defaultdict(dict)

    def add(self, b: int, room: int) -> None:
        # Amounts are sorted: a bin's largest pairs are no more than it holds.
        amounts = self.amounts[b] = _amounts(self.bins[b], self.sizes)
        self.count[amounts, room] += 1
        self.most[amounts] = np.maximum(self.most[amounts], room)
        self.by_room[room][b] = None

    def remove(self, b: int, room: int) -> None:
        amounts = self.amounts.pop(b)
        del self.by_room[room][b]
        self.count[amounts, room] -= 1
        gone = amounts[(self.most[amounts] == room) & (self.count[amounts, room] == 0)]
        if len(gone):
            left = self.count[gone, : room + 1] > 0
            self.most[gone] = np.where(left.any(axis=1), room - left[:, ::-1].argmax(axis=1), -1)

    def best(self, gives: np.ndarray) -> tuple[int, int, int, int] | None:
        """(size, amount, taker, its room) of the step that moves most, to the fullest bin that can take it."""
        reach = np.maximum.accumulate(np.where(self.most >= 0, self.back + self.most, -1))
        gives = gives[reach[gives - 1] >= gives]
        if not len(gives):
            return None
        gain = gives[:, None] - self.back
        gain[(gain <= 0) | (gain > self.most)] = 0
        i, amount = (int(x) for x in np.unravel_index(int(gain.argmax()), gain.shape))
        moved = int(gain[i, amount])
        room = moved + int((self.count[amount, moved:] > 0).argmax())
        for b in self.by_room[room]:
            amounts = self.amounts[b]
            at = int(amounts.searchsorted(amount))
            if at < len(amounts) and amounts[at] == amount:
                return int(gives[i]), amount, b, room
        raise AssertionError("the counts of takers differ from their amounts")


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search on the bins that aren't full.

    The least filled bin gives: a piece moves to a bin with room for it, or is exchanged for a smaller piece, or for two
    pieces that are smaller together, of a bin that is at least as full and has room for the difference. Each step moves
    fill from a bin to one as full or fuller, so the sum of squared fills rises and the search ends. A bin that can give
    no more is set aside; passes over all bins are repeated until one finds no step.
    """
    sizes = np.asarray(sizes, np.int64)
    fill = [int(sizes[b].sum()) for b in bins]
    bins = [list(b) for b in bins]
    while _pass(bins, fill, sizes, capacity):
        pass
    return [b for b in bins if b]


def _pass(bins: list[list[int]], fill: list[int], sizes: np.ndarray, capacity: int) -> int:
    """Every bin that isn't full gives, least filled first; the number of steps."""
    takers, steps = _Takers(bins, sizes, capacity), 0
    for b, n in enumerate(fill):
        if 0 < n < capacity:
            takers.add(b, capacity - n)
    for room in range(capacity - 1, 0, -1):  # takers only gain fill
        for giver in list(takers.by_room[room]):
            if giver not in takers.by_room[room]:  # it has gained
                continue
            takers.remove(giver, room)
            while bins[giver]:
                found = takers.best(np.unique(sizes[bins[giver]]))
                if found is None:
                    break
                size, amount, taker, free = found
                takers.remove(taker, free)
                _exchange(bins, sizes, giver, taker, size, amount)
                fill[giver] -= size - amount
                fill[taker] += size - amount
                if fill[taker] < capacity:
                    takers.add(taker, capacity - fill[taker])
                steps += 1
            if fill[giver] == capacity - room:  # still a taker for others as full as it
                takers.add(giver, room)
        for b in list(takers.by_room[room]):
            takers.remove(b, room)
    return steps


def _exchange(bins: list[list[int]], sizes: np.ndarray, giver: int, taker: int, size: int, amount: int) -> None:
    """A piece of ``size`` goes to ``taker``; none, one or two of its pieces with ``amount`` together come back."""
    given = next(x for x in bins[giver] if sizes[x] == size)
    back: list[int] = []
    if amount:
        back = [x for x in bins[taker] if sizes[x] == amount][:1]
        seen: dict[int, int] = {}
        for x in bins[taker] if not back else ():
            if amount - int(sizes[x]) in seen:
                back = [seen[amount - int(sizes[x])], x]
                break
            seen[int(sizes[x])] = x
    bins[giver] = [x for x in bins[giver] if x != given] + back
    bins[taker] = [x for x in bins[taker] if x not in back] + [given]


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row for each piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is one piece of one token (the closing id); repeated rows are packed each;
    an empty table gives no rows.
    """
    cut = materialize(pieces(docs, capacity), "pieces")
    blocks = max(1, -(-cut.count() // block))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        received = list(batches)
        if not sum(b.num_rows for b in received):
            return
        table = pa.Table.from_batches(received)
        sizes = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = TaskContext.get().partitionId() << 32
        for k, members in enumerate(improve(best_fit(sizes, capacity), sizes, capacity)):
            sequence[members] = base + k
            offset[members] = np.concatenate(([0], np.cumsum(sizes[members])[:-1]))
        table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from table.to_batches()

    return cut.repartition(blocks).mapInArrow(packed, PACKED)
