"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Tokens are states: each of the ``HEAD`` most frequent ones that occur ``LEAST`` times has one, all others share
``CLASSES`` states by the hash of their last two bytes. From the vectors of the two states before it, weighted by
position, the model predicts a vector. States of like frequency form groups and groups form groups of groups, all of
about as many members: the probability of a state is the product of three softmaxes, each over the target vectors of the
members of one node and computed in full. Within a class a token has its add-one share of the training counts, with one
place for unknown tokens, so probabilities of tokens add up to one.

Counts are of the whole training part, which is learned from once, a part of it in each round. Its states are dealt in
pieces to shards of ``SHARD`` tokens, so the number of shards follows from the tokens and not from the tasks. In a round
every shard improves the broadcast model, against noise drawn from the frequencies of the nodes of each level, and each
vector is averaged over the shards that changed it, by how often they did, at most ``FAN`` shards at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import sliced
from ledgerleaf.store import discard, materialize

CLASSES, WIDTH = 64, 16
#: Frequent words (of at most 64 bytes) whose counts every task holds; counts of all others are joined.
HEAD = 150_000
#: Occurrences from which a frequent word has vectors of its own; the others train the classes that unknown words have.
LEAST = 3
ROUNDS, BATCH, NOISE, RATE = 2, 4096, 32, 0.1
#: Rows of the model that shards send together, and how many shards are averaged at a time.
CHUNK, FAN = 512, 64
#: Training tokens of a shard, and of a piece, which is dealt as a whole.
SHARD, PIECE = 4_000_000, 16_384
#: Levels of nodes: states, groups, groups of groups.
LEVELS = 3


def held_out() -> Column:
    """True for documents that aren't learned from: crc32 of the id as text, modulo 7, is 2 (null counts as empty)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lowered, then one end, which is the empty token."""
    return [*text.lower().split(), b""]


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % CLASSES


def batch_tokens(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(``tokens`` of all texts of a batch, one after another; how many each text has)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text"), "")))
    words, of_text = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
    offsets = _offsets(words)
    # White space at the ends of a text makes empty words, which have no bytes and go; then each text gets its end.
    there = offsets[1:] > offsets[:-1]
    kept = np.concatenate(([0], np.cumsum(there)))[of_text]
    offsets = np.append(offsets[:-1][there], offsets[-1])
    offsets = np.insert(offsets, kept[1:], offsets[kept[1:]])
    kind = pa.large_binary() if offsets.dtype == np.int64 else pa.binary()
    found = pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets), words.buffers()[2]])
    return found, np.diff(kept) + 1


def _offsets(words: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(words.type) or pa.types.is_large_binary(words.type)
    return np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1]


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each token."""
    if not len(words):
        return np.empty(0, np.int64)
    offsets = _offsets(words)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    data = np.concatenate((np.zeros(2, np.uint8), data[: offsets[-1]]))  # two more, so that no place is below 0
    size, ends = np.diff(offsets), offsets[1:]
    last = np.where(size > 0, data[ends + 1], 0).astype(np.int64)
    before = np.where(size > 1, data[ends], 0).astype(np.int64)
    return _tails()[np.minimum(size, 2) * 65536 + before * 256 + last]


@cache
def _tails() -> np.ndarray:
    """Classes by number of last bytes (0, 1 or 2) and these."""
    empty, one = np.full(65536, tail_class(b""), np.int64), np.zeros(65536, np.int64)
    one[:256] = [tail_class(bytes([x])) for x in range(256)]
    return np.concatenate((empty, one, [tail_class(x.to_bytes(2, "big")) for x in range(65536)]))


#: Distinct tokens whose counts a task holds before it adds them up.
COUNTED = 1_000_000


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, class, n): how often each token occurs. Tasks add up counts before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            for table in held:
                words = table["token"].combine_chunks()
                classes = pa.array(tail_classes(words).astype(np.int32))
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), classes, table["n"].combine_chunks()], names=["token", "class", "n"])

        def added(held: list[pa.Table]) -> list[pa.Table]:
            sums = pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]) if held else None
            return [sums.select(["token", "n_sum"]).rename_columns(["token", "n"])] if held else []

        held: list[pa.Table] = []
        for batch in sliced(batches, 8 << 20):
            found = batch_tokens(batch)[0].value_counts()
            held.append(pa.table({"token": found.field("values"), "n": found.field("counts")}))
            if sum(map(len, held)) > COUNTED:
                held = added(held)
                if len(held[0]) > COUNTED // 2:
                    yield from rows(held)
                    held = []
        yield from rows(added(held))

    made = docs.select("text").mapInArrow(counted, "token binary, class int, n long")
    return made.groupBy("token", "class").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """State and count of the frequent tokens, totals of the classes, and N and V of all tokens. Classes follow the own states."""

    words: pa.Array
    state: np.ndarray
    count: np.ndarray
    class_total: np.ndarray  # N + V + 1 of each class
    frequency: np.ndarray  # of the states
    total: int
    distinct: int
    own: int  # tokens with a state of their own

    def read(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(state of each token, its place among the frequent ones or -1, the tokens that have none)."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words.cast(words.type)), -1).to_numpy().astype(np.int32)
        states = self.state[at]
        rare = words.filter(pa.array(at < 0))
        states[at < 0] = tail_classes(rare) + self.own
        return states, at, rare


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # Counts by steps of an eighth of a power of two show from which step on there are at most HEAD short tokens.
    short = counts.filter("length(token) <= 64").withColumn("step", F.floor(F.log2("n") * 8))
    upto = short.groupBy("step").count().toPandas().sort_values("step", ascending=False)
    steps = upto["step"][upto["count"].cumsum() <= HEAD]
    head = short.filter(F.col("step") >= int(steps.min()) if len(steps) else F.lit(False)).toPandas()
    head["token"] = [bytes(w) for w in head["token"]]
    head = head.sort_values(["n", "token"], ascending=[False, True], ignore_index=True)
    words = list(head["token"])
    own = int((head["n"] >= LEAST).sum())
    state = np.where(np.arange(len(words)) < own, np.arange(len(words)), head["class"].to_numpy(np.int64) + own)
    count = head["n"].to_numpy(np.int64)
    sums = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas().set_index("class")
    n, v = (sums[c].reindex(range(CLASSES), fill_value=0).to_numpy(np.int64).copy() for c in ("n", "v"))
    top = head[:own]
    np.subtract.at(n, top["class"].to_numpy(np.int64), top["n"].to_numpy(np.int64))
    np.subtract.at(v, top["class"].to_numpy(np.int64), 1)
    frequency = np.concatenate((count[:own], n)) + 0.5
    return Vocabulary(pa.array(words, pa.binary()), np.append(state, 0), np.append(count, 0), n + v + 1.0, frequency / frequency.sum(), total, distinct, own)


class Model:
    """One table: vectors of the states (and of the begin) as context, of the nodes of each level as target, and the
    weight of each component by distance. The last column is the bias of targets."""

    def __init__(self, states: int, table: np.ndarray | None = None) -> None:
        self.states = self.begin = states
        self.branch = 1  # members of a node
        while self.branch**LEVELS < states:
            self.branch += 1
        self.nodes = [-(-states // self.branch**level) for level in range(LEVELS)]
        self.at = (states + 1 + np.cumsum([0, *self.nodes])).tolist()  # first row of each level, then of the weights
        self.at_weight = self.at[LEVELS]
        self.table = np.zeros((self.at_weight + 2, WIDTH + 1), np.float32) if table is None else table

    @classmethod
    def initial(cls, frequency: np.ndarray) -> Model:
        model = cls(len(frequency))
        model.table[: model.at_weight, :WIDTH] = np.random.default_rng(7).normal(0, 0.1, (model.at_weight, WIDTH))
        model.table[model.at_weight :, :WIDTH] = 1
        for level in range(LEVELS):
            model.table[model.at[level] : model.at[level + 1], WIDTH] = np.log(model.by_node(frequency, level))
        return model

    def by_node(self, frequency: np.ndarray, level: int) -> np.ndarray:
        return np.add.reduceat(frequency, np.arange(0, self.states, self.branch**level))

    def predicted(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The vector after each context, and a one, so that a product with a row of targets includes its bias."""
        return self.guess(self.table.take(near, axis=0), self.table.take(far, axis=0))

    def guess(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """``predicted`` from the rows of the two states."""
        weight = self.table[self.at_weight :]
        guess = near * weight[0]
        guess += far * weight[1]
        guess[:, WIDTH] = 1
        return guess

    def log_probabilities(self, near: np.ndarray, far: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each state after its context; normalised over all states."""
        out = np.empty(len(states), np.float64)
        order = np.argsort(states, kind="stable")  # rows of a node are together, at every level
        lengths = np.sqrt(np.einsum("ij,ij->i", self.table[:, :WIDTH], self.table[:, :WIDTH]))
        for start in range(0, len(order), GUESSES):  # vectors of so many contexts are held
            i = order[start : start + GUESSES]
            guess = self.predicted(near[i], far[i])
            reach, total, some = float(np.sqrt(np.einsum("ij,ij->i", guess, guess).max())), np.zeros(len(i)), states[i]
            for level in range(LEVELS):
                node = some // self.branch**level
                parent = node // self.branch if level < LEVELS - 1 else np.zeros_like(node)
                edges = [0, *(np.flatnonzero(np.diff(parent)) + 1).tolist(), len(node)]
                for low, high in zip(edges[:-1], edges[1:], strict=True):
                    first = int(parent[low]) * self.branch
                    rows = slice(self.at[level] + first, self.at[level] + min(first + self.branch, self.nodes[level]))
                    members = self.table[rows].copy()
                    members[:, WIDTH] -= members[:, WIDTH].max()  # the softmax stays as it is
                    safe = reach * float(lengths[rows].max()) < 80
                    for begin in range(low, high, SOFTMAX_ROWS):
                        part = slice(begin, min(begin + SOFTMAX_ROWS, high))
                        total[part] += _log_softmax(guess[part], members, node[part] - first, safe)
            out[i] = total
        return out


#: Contexts whose vectors are made at a time.
GUESSES = 1 << 16
#: Rows of a softmax at a time, so that its matrix stays in a core's cache.
SOFTMAX_ROWS = 2048


def _log_softmax(guess: np.ndarray, vectors: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """``safe`` tells that some score of each row is over -80 and none over 80, so that exp neither vanishes nor overflows."""
    scores = guess @ vectors.T
    if not safe:
        scores -= scores.max(axis=1)[:, None]
    own = scores[np.arange(len(at)), at].astype(np.float64)
    return own - np.log((np.exp(scores, out=scores) @ np.ones(len(vectors), np.float32)).astype(np.float64))


def contexts(states: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The states one and two tokens before each; ``starts`` are the places of first tokens."""
    near, far = np.empty_like(states), np.empty_like(states)
    near[1:], far[2:] = states[:-1], states[:-2]
    near[starts] = begin
    far[starts] = begin
    second = starts + 1
    far[second[second < len(states)]] = begin
    return near, far


class Trainer:
    """Noise-contrastive estimation with adaptive steps, in batches that share their noise."""

    def __init__(self, model: Model, frequency: np.ndarray, seed: int) -> None:
        self.model, self.rng = model, np.random.default_rng(seed)
        # First row, cumulated and logarithmic noise frequency of the nodes of each level.
        by_node = [model.by_node(frequency, level) for level in range(LEVELS)]
        self.kinds = [(at, np.cumsum(f), np.log(NOISE * f).astype(np.float32)) for at, f in zip(model.at, by_node, strict=False)]
        self.square = np.ones_like(model.table)
        self.touched = np.zeros(len(model.table))

    def learn(self, line: np.ndarray, heads: np.ndarray) -> None:
        """``line`` holds pieces from ``heads`` on, of which the first two states are context; begins aren't learned."""
        learned = line != self.model.begin
        learned[heads] = learned[heads + 1] = False
        places = np.flatnonzero(learned).astype(np.int32)
        self.rng.shuffle(places)
        for start in range(0, len(places), BATCH):
            at = places[start : start + BATCH]
            # By state, so that the rows of a node are together at every level.
            keyed = np.sort(line[at].astype(np.int64) << 32 | at)
            at = keyed & 0xFFFFFFFF
            self._step(line[at - 1].astype(np.int64), line[at - 2].astype(np.int64), keyed >> 32)

    def _step(self, near: np.ndarray, far: np.ndarray, states: np.ndarray) -> None:
        """One batch, whose states ascend. Each row is changed once, by all of its gradients."""
        m = self.model
        near_rows, far_rows = m.table.take(near, axis=0), m.table.take(far, axis=0)
        guess = m.guess(near_rows, far_rows)
        noise = [np.minimum(np.searchsorted(cdf, self.rng.random(NOISE)), len(cdf) - 1) for _, cdf, _ in self.kinds]
        others = m.table[np.concatenate([at + x for (at, _, _), x in zip(self.kinds, noise, strict=True)])]
        others_log = np.concatenate([noise_log[x] for (_, _, noise_log), x in zip(self.kinds, noise, strict=True)])
        wrong = guess @ others.T
        wrong -= others_log
        wrong = _sigmoid(wrong)
        d_guess, d_others, changes = wrong @ others, wrong.T @ guess, []
        for level, (at, _, noise_log) in enumerate(self.kinds):
            right_ones = states // m.branch**level
            own = m.table.take(at + right_ones, axis=0)
            right = _sigmoid(np.einsum("ij,ij->i", guess, own) - noise_log[right_ones]) - 1
            own *= right[:, None]
            d_guess += own
            more = d_others[level * NOISE : (level + 1) * NOISE]
            changes.append((at, *_with_noise(*_summed(right_ones, right[:, None] * guess), noise[level], more)))
        weight = m.table[m.at_weight :].copy()
        weight[:, WIDTH] = d_guess[:, WIDTH] = 0
        towards = np.concatenate((d_guess * weight[0], d_guess * weight[1]))
        before = np.concatenate((near, far))
        # The place below the row: keys differ, so any sort gives the same order.
        keyed = np.sort(before << 32 | np.arange(len(before)))
        changes.append((0, *_summed(keyed >> 32, towards.take(keyed & 0xFFFFFFFF, axis=0))))
        of_weight = [np.einsum("ij,ij->j", d_guess, x) for x in (near_rows, far_rows)]
        changes.append((m.at_weight, np.arange(2), np.stack(of_weight), np.ones(2, np.int64)))
        for at, rows, gradient, often in changes:
            self._change(at + rows, gradient, often)

    def _change(self, rows: np.ndarray, gradient: np.ndarray, often: np.ndarray) -> None:
        square = gradient * gradient
        square += self.square.take(rows, axis=0)
        self.square[rows] = square
        gradient *= np.float32(RATE)
        gradient /= np.sqrt(square, out=square)
        self.model.table[rows] = self.model.table.take(rows, axis=0) - gradient
        self.touched[rows] += often


def _summed(rows: np.ndarray, gradients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each of the rows, which ascend, its gradients' sum, how many they are)."""
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[first], np.add.reduceat(gradients, first, axis=0), np.diff(np.append(first, len(rows)))


def _with_noise(rows: np.ndarray, gradient: np.ndarray, often: np.ndarray, noise: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the gradients of the noise, whose rows may be among them or not."""
    order = np.argsort(noise, kind="stable")
    others, added, times = _summed(noise[order], more[order])
    place = np.minimum(np.searchsorted(rows, others), len(rows) - 1)
    known = rows[place] == others
    gradient[place[known]] += added[known]
    often[place[known]] += times[known]
    return np.append(rows, others[~known]), np.concatenate((gradient, added[~known])), np.append(often, times[~known])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    with np.errstate(over="ignore"):  # exp of a far negative one is infinite, and its inverse 0
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def dealt(docs: DataFrame, vocab, begin: int, slots: int) -> DataFrame:
    """(slot, states): the states of all documents in pieces, each with the two before it. Two begins precede a document.

    The pieces of a task go to one slot after the other, so slots are of like size whatever the documents are.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, turn = vocab.value, None
        for batch in sliced(batches):
            words, sizes = batch_tokens(batch)
            if not len(sizes):
                continue
            states, _, _ = known.read(words)
            starts = np.repeat(np.cumsum([0, *sizes[:-1]]), 2)
            line = np.insert(states, starts, begin).astype("<i4")
            cut = [line[max(a - 2, 0) : a + PIECE].tobytes() for a in range(0, len(line), PIECE)]
            if turn is None:
                turn = zlib.crc32(cut[0])
            yield pa.RecordBatch.from_pydict({"slot": (turn + np.arange(len(cut))) % slots, "states": pa.array(cut, pa.binary())})
            turn += len(cut)

    return docs.select("text").mapInArrow(pieces, "slot long, states binary")


def _learner(vocab, start) -> Callable[[tuple, pa.Table], pa.Table]:
    def improved(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        model = Model(start.value.states, start.value.table.copy())
        trainer = Trainer(model, vocab.value.frequency, shard)
        # Batches are drawn from the whole shard, so they are as large however it is cut into pieces. The states that
        # precede a piece are context only; they are at the end of another one.
        pieces = sorted(table.column("states").to_pylist())
        del table
        sizes = [len(p) // 4 for p in pieces]
        line = np.frombuffer(b"".join(pieces), "<i4")
        del pieces
        trainer.learn(line, np.cumsum([0, *sizes[:-1]]))
        rows = np.flatnonzero(trainer.touched)
        parts = np.split(rows, np.flatnonzero(np.diff(rows // CHUNK)) + 1) if len(rows) else []
        return _table([(int(some[0]) // CHUNK, shard, some, trainer.touched[some], model.table[some]) for some in parts])

    return improved


def train(docs: DataFrame, vocab: Vocabulary) -> Model:
    """Parameters averaged over shards, after ``ROUNDS`` rounds that together use each document once."""
    model = Model.initial(vocab.frequency)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocab)
    shards = max(1, -(-vocab.total // (SHARD * ROUNDS)))
    pieces = materialize(dealt(docs, shared, model.begin, shards * ROUNDS), "pieces")
    for k in range(ROUNDS):
        start = context.broadcast(model)
        of_round = pieces.filter(F.col("slot") % ROUNDS == k).select(F.expr(f"slot div {ROUNDS}").alias("shard"), "states")
        made, left = of_round.groupBy("shard").applyInArrow(_learner(shared, start), _ROWS), shards
        while left:
            made = made.withColumn("part", F.expr(f"part div {FAN}")).groupBy("chunk", "part").applyInArrow(_averaged, _ROWS)
            left = -(-left // FAN) if left > FAN else 0
        # As many bytes as the model has.
        for at, vectors in made.select("at", "vectors").toPandas().itertuples(index=False):
            model.table[np.frombuffer(at, np.int32)] = np.frombuffer(vectors, np.float32).reshape(-1, WIDTH + 1)
    discard(pieces)
    return model


_ROWS = "chunk long, part long, at binary, touched binary, vectors binary"


def _table(rows: list[tuple]) -> pa.Table:
    """Rows of the model by chunk: (chunk, part, places, how often each was changed, vectors)."""
    chunk, part, at, touched, vectors = zip(*rows, strict=True) if rows else [()] * 5
    kinds = ((at, np.int32), (touched, np.float32), (vectors, np.float32))
    blobs = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in kinds]
    return pa.Table.from_arrays([pa.array(chunk, pa.int64()), pa.array(part, pa.int64()), *blobs], names=[c.split()[0] for c in _ROWS.split(", ")])


def _averaged(table: pa.Table) -> pa.Table:
    """Rows of a chunk, averaged by how often each has been changed."""
    total, touched = np.zeros((CHUNK, WIDTH + 1)), np.zeros(CHUNK)
    chunk, part = (table.column(c)[0].as_py() for c in ("chunk", "part"))
    for at, n, vectors in sorted(zip(*(table.column(c).to_pylist() for c in ("at", "touched", "vectors")), strict=True)):
        place, weight = np.frombuffer(at, np.int32) - chunk * CHUNK, np.frombuffer(n, np.float32).astype(np.float64)
        total[place] += np.frombuffer(vectors, np.float32).reshape(-1, WIDTH + 1) * weight[:, None]
        touched[place] += weight
    place = np.flatnonzero(touched)
    return _table([(chunk, part, place + chunk * CHUNK, touched[place], total[place] / touched[place, None])])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Defined cases: a null or empty text is its end alone; repeated rows are scored each and counted each; without
    training texts every count is 0; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    learned = rows.filter(~F.col("held_out"))
    counts = materialize(token_counts(learned), "counts")
    vocab = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, train(learned, vocab)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, model = shared.value
        row = TaskContext.get().partitionId() << 33
        log_count = np.log10(known.count + 1.0)
        log_class = np.append(np.zeros(known.own), np.log10(known.class_total))
        for batch in sliced(batches, 8 << 20):
            words, sizes = batch_tokens(batch)
            if not len(sizes):
                continue
            states, at, rare = known.read(words)
            del words
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            model_log = model.log_probabilities(*contexts(states, starts, model.begin), states)
            model_log /= np.log(10)
            own = np.where(at < 0, 0, log_count[at])
            model_log += np.where(states >= known.own, own - log_class[states], 0)
            missing = np.add.reduceat(at < 0, starts, dtype=np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(missing))).astype(np.int32))
            columns = [
                pa.array(np.arange(row, row + len(sizes))), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes.astype(np.int64)),
                pa.array(sizes - missing), pa.array(np.add.reduceat(own, starts)), pa.array(np.add.reduceat(model_log, starts)),
                pa.ListArray.from_arrays(offsets, rare.cast(pa.binary())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare"])
            row += len(sizes)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<binary>"
    parts = materialize(rows.mapInArrow(scored, schema), "scored")
    # Rare tokens get their counts by a join; unknown ones count 0 and add nothing.
    rare = parts.select("row", F.explode("rare").alias("token")).join(counts.select("token", "n"), "token")
    found = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    joined = parts.drop("rare").join(found, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("more", "gain")})
    shift = float(np.log10(vocab.total + vocab.distinct + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain") - F.col("n_tokens") * shift).alias("base_score"), (F.col("model") + F.col("gain")).alias("score"),
    )
