"""Operators of the llm subpackage on odd rows, against brute-force versions."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerleaf.llm import lsh_forest, mixing, packing, phrase_automata, prefix_doubling, prefix_forest, quality_rules, sharding

WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(f"p{i}" for i in range(60))


def _texts():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, 120)) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", texts[2] + " " + PASSAGE, PASSAGE + "\n" + texts[3], None, "", " \t\n", "one two", "x" * 900, "x" * 900, "la " * 500]
    return texts + [" ".join(rng.choice(WORDS, 20000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "a", "b"][i % 3], "en" if i % 2 else None, -1, "clash") for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size long, kept string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")


def _words(text):
    return (text or "").encode().split()


def test_substring_dedup(docs):
    seen, want = {}, {}
    for i, text in enumerate(_texts()):
        words = _words(text)
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            if seen.setdefault(tuple(words[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_automata.digest(docs).collect()}
    assert got == want


def test_suffix_dedup(docs):
    texts = [(t or "").encode() for t in _texts()]
    count = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    for r in prefix_doubling.digest(docs).collect():
        text = texts[r.doc_id]
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 399):
            if count[text[k : k + 400]] > 1:
                gone[k : k + 400] = True
        assert (r.n_bytes, r.n_removed) == (len(text), int(gone.sum()))
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, g in zip(text, gone, strict=True) if not g)).hexdigest()


def test_near_duplicates(docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in lsh_forest.near_duplicates(docs).collect()}
    assert got[0] == (0, 1) and got[12] == (0, 1) and got[1] == (1, 1) and got[13] == (1, 1)
    assert got[16] == (16, 0) and got[17] == (17, 0) and got[20] == (20, 1) and got[21] == (20, 1)


def test_packing(docs):
    rows = packing.pack(docs).collect()
    encode, texts = packing.encoder(), _texts()
    place, filled = {}, Counter()
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        filled[r.sequence_id] += r.length
        ids = np.array([*encode(texts[r.doc_id] or ""), 0], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert all(sum(n for o, n in p if o < x) == x for p in place.values() for x, _ in p) and max(filled.values()) <= 2048
    assert sum(filled.values()) == sum(len(encode(t or "")) + 1 for t in texts)


def test_packing_searches_all_bins():
    """Sizes near 1/2 and 1/4 of a bin leave hundreds of bins open: no step may be left, and few bins beyond the least possible."""
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(int(0.88 * c), int(1.12 * c), 500) for c in (1024, 512)])
    first = packing.best_fit(sizes, 2048)
    bins = packing.improve(first, sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(1000))
    fill = [int(sizes[b].sum()) for b in bins]
    assert max(fill) <= 2048 and len(bins) <= 1.01 * sizes.sum() / 2048 < len(first)
    back = [{0, *(int(sizes[i]) for i in b), *(int(sizes[i] + sizes[j]) for i in b for j in b if i < j)} for b in bins]
    for g, giver in enumerate(bins):
        for t in range(len(bins)):
            if t != g and fill[g] <= fill[t] < 2048:
                assert not any(0 < sizes[i] - p <= 2048 - fill[t] for i in giver for p in back[t])


def test_encoder_matches_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    for text in ("", "a  b\n\n c", "<|endoftext|>", "éñß  \t'll 123", " " * 50 + "x", "la " * 300):
        assert packing.encoder()(text) == plain.encode(text, add_special_tokens=False).ids


def test_mixing_and_sharding(docs):
    rows = mixing.digest(docs).collect()
    sizes = [len(_words(t)) for t in _texts()]
    assert sorted((r.doc_id, r.size) for r in rows) == list(enumerate(sizes))
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - sum(sizes)) < 1e-6 * sum(sizes)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    slots = sorted((r.shard, r.slot) for r in sharding.digest(docs).collect())
    count = Counter(s for s, _ in slots)
    assert slots == [(s, k) for s in sorted(count) for k in range(count[s])] and max(count.values()) - min(count.values()) <= 1


def test_quality_rules(docs, labels):
    got = {r.doc_id: r for r in quality_rules.digest(docs, labels).collect()}
    assert got[16].base_failed and got[16].n_words == 0 and not got[22].kept and got[22].n_repeat_words == 500 and got[0].kept


def test_nearest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8)]
    found = prefix_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.array([v for _, v in rows[:300]])
    hits = 0
    for q in (0, 100, 200):
        near = np.sqrt(((x - x[q]) ** 2).sum(1))
        near[q] = np.inf
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(near)[:10].tolist()))
    assert len(found) == 30 and hits >= 27


@pytest.mark.parametrize("times", [2, 20])
def test_nearest_of_repeated_rows(spark, times):
    """Each row ``times`` times, and one id near a query with thirty vectors of its own: ten distinct neighbours each."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8))
    own = x[0] + rng.standard_normal((30, 8)) / 1000
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * times + [(300, v.tolist()) for v in own]
    found = prefix_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    hits = 0
    for q in (0, 100, 200):
        near = np.append(((x - x[q]) ** 2).sum(1), ((own - x[q]) ** 2).sum(1).min()) ** 0.5
        near[q] = np.inf
        mine = {r.vec_id: (r.rank, r.score) for r in found if r.query_id == q}
        assert sorted(r for r, _ in mine.values()) == list(range(1, 11))
        assert all(abs(near[i] - s) < 1e-9 for i, (_, s) in mine.items())
        hits += len(set(mine) & set(np.argsort(near)[:10].tolist()))
    assert hits >= 27 and 300 in {r.vec_id for r in found if r.query_id == 0}


def test_empty_tables(docs, labels):
    from ledgerleaf.llm import line_crf, log_bilinear

    none = docs.filter("false")
    for df in (quality_rules.digest(none, labels), log_bilinear.score(none), mixing.digest(none), phrase_automata.digest(none), prefix_doubling.digest(none)):
        assert df.count() == 0
    for df in (lsh_forest.near_duplicates(none), packing.pack(none), line_crf.digest(none, labels), sharding.digest(none)):
        assert df.count() == 0
    for df in (mixing.mixed_documents(none), phrase_automata.without_repeats(none), lsh_forest.one_of_each(none), line_crf.digest(none, labels.filter("false"))):
        assert df.count() == 0


def test_components_of_edges_that_change_when_computed_again(spark):
    """Triangles whose spanning star is drawn anew in every evaluation: still one component each."""
    import pyarrow as pa

    from ledgerleaf.llm.components import components

    def stars(batches):
        rng = np.random.default_rng()
        for batch in batches:
            three = 3 * np.repeat(batch.column("id").to_numpy(), 2)
            root = np.repeat(rng.integers(0, 3, batch.num_rows), 2)
            other = (root + np.tile([1, 2], batch.num_rows)) % 3
            yield pa.RecordBatch.from_pydict({"u": three + root, "v": three + other})

    found = components(spark.range(100).mapInArrow(stars, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == {n: n - n % 3 for n in range(300)}


def test_frequent_words_have_own_vectors(spark):
    """600 words with the same last two bytes: the score of a word depends on which of them is before it, and all sum to one."""
    from ledgerleaf.llm import log_bilinear

    rng = np.random.default_rng(8)
    words = [f"w{i}xy" for i in range(600)]
    rows = [(i, " ".join(rng.choice(words, 300))) for i in range(40)]
    asked = [(1000 + i, f"{words[i]} {words[0]}") for i in range(600)]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string")
    got = log_bilinear.score(df).filter("doc_id >= 1000").collect()
    assert len({round(r.score, 6) for r in got}) > 500
    counts = log_bilinear.token_counts(df)
    vocab = log_bilinear.vocabulary(counts)
    model = log_bilinear.train(df, vocab)
    every = np.arange(len(vocab.frequency))
    assert vocab.own == 601
    for before in (0, 300, model.begin):
        context = np.full(len(every), before)
        assert abs(np.exp(model.log_probabilities(context, context, every)).sum() - 1) < 1e-5


@pytest.mark.parametrize("kept", ["false", "quality = 1"])
def test_pipeline_keeps_all_without_a_model(spark, docs, labels, tmp_path, kept):
    import corpus_pipeline

    labels.filter(kept).write.parquet(str(tmp_path / "labels.parquet"))
    good = corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and good.count() == docs.count()


def test_scores_of_odd_texts(docs, labels):
    from ledgerleaf.llm import line_crf, log_bilinear

    assert line_crf.digest(docs, labels).filter("score between 0 and 1").count() == docs.count()
    assert log_bilinear.score(docs).filter("score <= 0 and n_tokens >= 1").count() == docs.count()
