"""Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from ledgerleaf.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(leaves, fan):
    """The root, and for each leaf the (left, right) siblings from its level up."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(places):
            run = at - at % fan
            paths[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + fan])))
            places[i] = at // fan
        level = [_h(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], paths


def _manifest(rows, fan=2):
    """(leaf, subroot, root, path) of rows of doc_id, source, lang, n_chars and text, in no order."""
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((first(row[0]), _leaf(row)))
    langs, trees = sorted(groups, key=first), {}
    for lang in langs:
        trees[lang] = _tree([leaf for _, leaf in sorted(groups[lang])], fan)
    root, above = _tree([trees[lang][0] for lang in langs], fan)
    for lang, over in zip(langs, above, strict=True):
        for (_, leaf), path in zip(sorted(groups[lang]), trees[lang][1], strict=True):
            yield leaf, trees[lang][0], root, tuple(path + over)


ROWS = (
    [(i, "web" if i % 3 else None, "en", i if i % 5 else None, f"text {i}") for i in range(41)]
    + [(i, "wiki", "é", 1, None) for i in range(100, 107)]
    + [(None, "a", None, 1, ""), (None, "a", None, 1, ""), (7, "a", None, 2, "x" * 300_000)]
    + [(200, "one", "zh", 3, "alone"), (5, "web", "en", 5, "text 5"), (5, "web", "en", 9, "other"), (None, None, "en", None, None)]
)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("fan", "block"), [(2, 1024), (2, 4), (2, 2), (3, 9), (5, 4)])
def test_manifest(spark, fan, block):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'clash' AS root", "1 AS _row", "2 AS _h", "3 AS _pos")
    leaves = docs.withColumn("leaf", merkle.leaf_of([docs[c] for c in merkle.FIELDS]))
    out = merkle.manifest(leaves, "lang", ["doc_id"], fan=fan, block=block).collect()
    assert sorted((r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in out) == sorted(_manifest(ROWS, fan))
    assert {(r._row, r._h, r._pos) for r in out} == {(1, 2, 3)} and len(out) == len(ROWS)


def test_tampered_rows_do_not_fold_to_the_root(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    want = {}
    for row, (leaf, subroot, root, path) in zip(sorted(ROWS, key=_leaf), sorted(_manifest(ROWS)), strict=True):
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
        h = _leaf((*row[:3], row[3] + 1, row[4])) if tampered else leaf
        for left, right in path:
            h = _h(left, h, right)
        proof = _h(*[left + right for left, right in path])
        want.setdefault((row[0], leaf), []).append((subroot, root, proof, h, h == root))
        assert (h == root) != tampered
    got = {}
    for r in merkle.digest(docs).collect():
        got.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(not r[4] for rows in want.values() for r in rows)


def test_small_tables(spark):
    assert merkle.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = merkle.digest(spark.createDataFrame(ROWS[:1], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == _h("")
