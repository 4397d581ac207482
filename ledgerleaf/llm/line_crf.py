"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are counts by kind of character, word lengths and repetition, of the line
itself and of its neighbours; the chain adds weights for pairs of neighbouring states. Documents are labelled as a
whole, so in training every line has its document's label. Scoring runs the forward-backward recursion over whole
texts and averages the marginal probability of "good" over the lines, weighted by their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.common import sliced, texts_of, unit_hash

#: Labelled documents that the model is fitted on at most (those with the smallest hash of their id), and the number of
#: lines beyond which a document is left out of fitting. Scoring has no such bounds.
FIT_DOCUMENTS = 8000
FIT_LINES = 2000
#: Bytes of text whose line features are held at a time.
BLOCK_BYTES = 4 << 20

_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _HIGH, _OTHER = range(8)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[65:91] = _UPPER
_KIND[97:123] = _LOWER
_KIND[48:58] = _DIGIT
_KIND[list(b"#*$%&|<>{}[]\\^~=_@")] = _SYMBOL
_KIND[list(b"!?")] = _BANG
_KIND[128:] = _HIGH

OWN = 13
NEIGHBOUR = (2, 3, 4, 5, 6, 8, 11, 12)  # the own features that the lines before and after add
FEATURES = OWN + 2 * len(NEIGHBOUR)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines of each text, bytes of each line and its break). An empty text is one empty line."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    per_text = np.diff(np.concatenate(([0], np.searchsorted(ends, text_ends) + 1)))
    kind = _KIND[data]
    count = [np.add.reduceat((kind == k).view(np.uint8), starts, dtype=np.int64).astype(np.float32) for k in range(7)]
    begins = kind != _SPACE
    begins[1:] &= kind[:-1] == _SPACE
    words = np.add.reduceat(begins.view(np.uint8), starts, dtype=np.int64).astype(np.float32)
    size = (ends - starts).astype(np.float32)
    letters = np.maximum(count[_UPPER] + count[_LOWER] + count[_HIGH], 1)
    per_word = np.maximum(words, 1)
    repeated, adjacent, distinct = (np.zeros(len(starts), np.float32) for _ in range(3))
    at = 0
    for text in texts:
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                repeated[at] = 1
            elif line:
                seen.add(line)
            line_words = line.split()
            adjacent[at] = sum(map(eq, line_words, line_words[1:]))
            distinct[at] = len(set(line_words))
            at += 1
    own = np.stack(
        [
            np.ones_like(size), np.log1p(size) / 5, np.minimum(count[_SYMBOL] / per_word, 3), count[_UPPER] / letters,
            np.minimum(count[_BANG] / per_word, 3), np.minimum(count[_DIGIT] / letters, 3), np.minimum((size - count[_SPACE] + 1) / per_word, 40) / 10,
            count[_HIGH] / letters, repeated, (words == 0).astype(np.float32), np.minimum(words, 5) / 5,
            adjacent / per_word, (words - distinct) / per_word,
        ],
        axis=1,
    )
    first = np.zeros(len(size), bool)
    first[np.cumsum(per_text)[:-1]] = True
    first[0] = True
    last = np.roll(first, -1)
    beside = own[:, NEIGHBOUR]
    before, after = np.roll(beside, 1, axis=0), np.roll(beside, -1, axis=0)
    # At a text's ends the line stands in for its missing neighbour.
    before[first], after[last] = beside[first], beside[last]
    return np.concatenate((own, before, after), axis=1), per_text, size + 1


@dataclass
class LineModel:
    """``weights``: log-odds of "good" by feature; ``pairs[a, b]``: weight of state b after state a (1: good)."""

    weights: np.ndarray
    pairs: np.ndarray

    def messages(self, unary: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward (with the line itself) and backward log-odds of every line; all texts advance together."""
        starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
        order = np.argsort(-per_text, kind="stable")
        starts, sizes = starts[order], per_text[order]
        (t00, t01), (t10, t11) = self.pairs
        ahead, behind = np.array(unary, np.float64), np.zeros(len(unary))
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # texts of at least so many lines
        for t in range(1, longest):
            i = starts[: active[t]] + t
            r = ahead[i - 1]
            ahead[i] += np.logaddexp(r + t11, t01) - np.logaddexp(r + t10, t00)
        for t in range(1, longest):
            n = active[t]
            i = starts[:n] + sizes[:n] - 1 - t
            r = unary[i + 1] + behind[i + 1]
            behind[i] = np.logaddexp(t11 + r, t10) - np.logaddexp(t01 + r, t00)
        return ahead, behind

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean marginal of "good" for each text."""
        features, per_text, size = line_features(texts)
        unary = features.astype(np.float64) @ self.weights
        ahead, behind = self.messages(unary, per_text)
        good = _logistic(ahead + behind)
        starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
        return np.add.reduceat(good * size, starts) / np.add.reduceat(size.astype(np.float64), starts)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(features: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = 300, penalty: float = 1.0) -> LineModel:
    """Maximise the conditional log-likelihood of the line states with an L2 penalty, by Adam on the whole sample.

    Without both labels in the sample there is nothing to learn: every line then has odds of 1.
    """
    model = LineModel(np.zeros(FEATURES), np.zeros((2, 2)))
    if len(np.unique(labels)) < 2:
        return model
    x, y = features.astype(np.float64), np.repeat(labels, per_text).astype(np.float64)
    ends = np.cumsum(per_text)
    inner = np.ones(len(y), bool)
    inner[ends - 1] = False
    left = np.flatnonzero(inner)  # lines with a line after them
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[left].astype(int), y[left + 1].astype(int)), 1)
    scale = 1 / len(per_text)
    theta, m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
    for step in range(1, steps + 1):
        model.weights, model.pairs = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        unary = x @ model.weights
        ahead, behind = model.messages(unary, per_text)
        p = _logistic(ahead + behind)
        after = unary[left + 1] + behind[left + 1]
        pair = np.stack([model.pairs[a, b] + a * ahead[left] + b * after for a in (0, 1) for b in (0, 1)])
        pair = np.exp(pair - np.logaddexp.reduce(pair, axis=0))
        gradient = np.concatenate((x.T @ (y - p), seen_pairs.ravel() - pair.sum(1))) * scale - penalty * scale * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        rate = 0.1 * min(1.0, 3 * (1 - step / (steps + 1)))
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineModel(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def held_out() -> Column:
    """True for documents whose labels aren't used: crc32 of the id as text, modulo 4, is 2 (null counts as empty)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> LineModel:
    """Fit on at most ``most`` labelled documents that aren't held out. A document with several labels is bad if one is."""
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    marked = marks.agg(F.min("quality").cast("int").alias("_good"))
    sample = marked.orderBy(unit_hash("crf", F.col("doc_id")), "doc_id").limit(most).withColumnRenamed("doc_id", "_id")
    # At most ``most`` pairs of numbers, so the broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_good", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for text, good in zip(texts_of(batch), batch.column("_good").to_pylist(), strict=True):
                features, lines, _ = line_features([text])
                if lines[0] <= FIT_LINES:
                    yield pa.RecordBatch.from_pydict({"good": [good], "features": [features.astype("<f4").tobytes()]})

    got = rows.mapInArrow(measured, "good long, features binary").toPandas()
    if got.empty:
        return fit(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0))
    got = got.sort_values(["good", "features"])  # the same order in every run
    arrays = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for x in got["features"]]
    return fit(np.concatenate(arrays), np.array([len(a) for a in arrays]), got["good"].to_numpy())


def with_score(docs: DataFrame, model: LineModel, name: str) -> DataFrame:
    """All rows and columns of ``docs``, and the score of the text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = texts_of(batch)
            values, block, size = [np.zeros(0)], [], 0
            for text in texts:
                block.append(text)
                size += len(text) + 1
                if size > BLOCK_BYTES:
                    values.append(model.scores(block))
                    block, size = [], 0
            if block:
                values.append(model.scores(block))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(values))], names=[*batch.schema.names, name])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Defined cases: null and empty texts are one empty line; repeated rows are scored each; without labels of both kinds
    every score is 0.5; an empty table gives no rows.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    scored = with_score(rows, train(docs, labels), "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
