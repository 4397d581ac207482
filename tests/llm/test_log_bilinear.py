"""The language model's tasks: their tokens, what a step changes, probabilities and the memory they take."""

import random
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest

from ledgerleaf.llm import log_bilinear


def _batch(texts, kind):
    """A slice of a batch, as Spark's batches are cut."""
    return pa.RecordBatch.from_pydict({"text": pa.array(["x y", *texts], kind)}).slice(1)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_tokens_of_a_batch(kind):
    rng, signs = random.Random(3), " \t\n\x0b\x0c\r\x1c\x1f\x00\x85\xa0AZaz0Éé 　😀"
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(rng.randrange(9))]
        words, sizes = log_bilinear.batch_tokens(_batch(texts, kind))
        want = [log_bilinear.tokens((t or "").encode()) for t in texts]
        flat = [w for of_text in want for w in of_text]
        assert words.to_pylist() == flat and sizes.tolist() == [len(w) for w in want]
        assert log_bilinear.tail_classes(words).tolist() == [log_bilinear.tail_class(w) for w in flat]


def _frequency(states):
    frequency = 1 / (1.0 + np.arange(states))
    return frequency / frequency.sum()


def test_a_step_is_the_gradient_of_the_estimate():
    """One batch against plain sums over tokens and noise, for rows that occur once, often, and as noise too."""
    frequency, width = _frequency(300), log_bilinear.WIDTH
    line = np.concatenate(([300, 300], np.random.default_rng(1).choice(300, 500, p=frequency))).astype("<i4")
    model, plain = log_bilinear.Model.initial(frequency), log_bilinear.Model.initial(frequency).table.astype(np.float64)
    trainer = log_bilinear.Trainer(model, frequency, 5)
    trainer.learn(line, np.array([0]))
    rng = np.random.default_rng(5)
    rng.shuffle(np.arange(500, dtype=np.int32))
    drawn = [np.minimum(np.searchsorted(cdf, rng.random(log_bilinear.NOISE)), len(cdf) - 1) for _, cdf, _ in trainer.kinds]
    gradient, often, weight = np.zeros_like(plain), np.zeros(len(plain)), plain[model.at_weight :, :width]
    for i in range(2, len(line)):
        near, far = line[i - 1], line[i - 2]
        guess = plain[near, :width] * weight[0] + plain[far, :width] * weight[1]
        back = np.zeros(width)
        for level, (at, _, noise_log) in enumerate(trainer.kinds):
            for node, right in [(line[i] // model.branch**level, 1), *((n, 0) for n in drawn[level])]:
                row = plain[at + node]
                error = 1 / (1 + np.exp(-(guess @ row[:width] + row[width] - noise_log[node]))) - right
                gradient[at + node, :width] += error * guess
                gradient[at + node, width] += error
                back += error * row[:width]
            often[at + line[i] // model.branch**level] += 1
        for k, before in enumerate((near, far)):
            gradient[before, :width] += back * weight[k]
            gradient[model.at_weight + k, :width] += back * plain[before, :width]
            often[before] += 1
    for level, (at, _, _) in enumerate(trainer.kinds):
        np.add.at(often, at + drawn[level], 1)
    often[model.at_weight :] += 1
    want = plain - log_bilinear.RATE * gradient / np.sqrt(1 + gradient * gradient)
    assert np.abs(model.table - want).max() < 1e-4
    assert (trainer.touched == often).all()


def test_probabilities_add_up_where_scores_are_large():
    frequency = _frequency(200)
    model = log_bilinear.Model.initial(frequency)
    every = np.arange(200)
    for factor in (1, 300):  # beyond what exp can hold
        model.table[:, : log_bilinear.WIDTH] *= factor
        context = np.full(200, 7)
        assert abs(np.exp(model.log_probabilities(context, context, every)).sum() - 1) < 1e-3


def _peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_shard_and_of_a_scored_slice():
    """Bytes a token: a shard takes its states and places, and a softmax no vectors of all contexts at once."""
    frequency, n = _frequency(1000), 1_000_000
    states = np.random.default_rng(2).choice(1000, n, p=frequency)
    start = types.SimpleNamespace(value=log_bilinear.Model.initial(frequency))
    learn = log_bilinear._learner(types.SimpleNamespace(value=types.SimpleNamespace(frequency=frequency)), start)
    line = np.concatenate(([1000, 1000], states)).astype("<i4")
    pieces = [line[max(a - 2, 0) : a + log_bilinear.PIECE].tobytes() for a in range(0, len(line), log_bilinear.PIECE)]
    table = pa.table({"shard": pa.array([0] * len(pieces)), "states": pa.array(pieces)})
    assert _peak(lambda: learn((pa.scalar(0),), table)) < 20 * n
    model, near, far = start.value, np.roll(states, 1), np.roll(states, 2)
    assert _peak(lambda: model.log_probabilities(near, far, states)) < 60 * n
