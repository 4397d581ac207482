"""Periodic runs: stretches of words that repeat with a smallest period, found with a suffix automaton.

The suffix links of a document's automaton form a tree in which the path of a prefix holds all its suffixes. Appending
word i recolours that path with i, as the access of a link-cut tree does: each part of the path that still has one old
colour e ends in the longest suffix that last occurred at e, so its length is how far the texts that end at e and at i
agree. If they agree over at least i - e words, the last two stretches of i - e words are a square, and all such squares
with one left end are one run. A square's root occurs nowhere in between, so i - e is the smallest period. A document of
n words meets O(n log n) colours.

A run that is long enough repeats each of its short windows of words within its own period. Words that no such stretch
can hold never enter an automaton; this leaves out no run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.common import CRC_TABLE, WORD, WordHashes, crc32_sql, sliced, texts_of, window_hashes

MIN_LENGTH = 6
MIN_EXPONENT = 4
RUNS = "array<struct<start:long,length:long,period:long>>"
#: Passes that narrow the stretches; more would only save work.
_PASSES = 8


class Automaton:
    """Suffix automaton of a sequence: longest length and suffix link of each state, and the state of each prefix."""

    def __init__(self, items: Iterable[int]):
        self.longest, self.link, self.prefixes = [0], [-1], []
        longest, link, then = self.longest, self.link, [{}]
        last = 0
        for c in items:
            new = len(longest)
            longest.append(longest[last] + 1)
            link.append(0)
            then.append({})
            p = last
            while p >= 0 and c not in then[p]:
                then[p][c] = new
                p = link[p]
            if p >= 0:
                q = then[p][c]
                if longest[p] + 1 < longest[q]:
                    twin = len(longest)
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    then.append(dict(then[q]))
                    link[q] = twin
                    while p >= 0 and then[p].get(c) == q:
                        then[p][c] = twin
                        p = link[p]
                    q = twin
                link[new] = q
            last = new
            self.prefixes.append(new)


class ColouredPaths:
    """Link-cut tree over fixed parents. Each preferred path is a splay tree, ordered by depth, with a colour at its root."""

    def __init__(self, parents: list[int]):
        self.up = list(parents)
        self.shallow = [-1] * len(parents)
        self.deep = [-1] * len(parents)
        self.colour = [-1] * len(parents)

    def _rotate(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        p = up[x]
        g = up[p]
        if shallow[p] == x:
            moved = shallow[p] = deep[x]
            deep[x] = p
        else:
            moved = deep[p] = shallow[x]
            shallow[x] = p
        if moved >= 0:
            up[moved] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if shallow[g] == p:
                shallow[g] = x
            elif deep[g] == p:
                deep[g] = x
        self.colour[x] = self.colour[p]

    def _splay(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        while (p := up[x]) >= 0 and (shallow[p] == x or deep[p] == x):
            g = up[p]
            if g >= 0 and (shallow[g] == p or deep[g] == p):
                self._rotate(p if (shallow[g] == p) == (shallow[p] == x) else x)
            self._rotate(x)

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from the root to ``node``; yields (deepest node, colour) of each part that had a colour."""
        below, x = -1, node
        while x >= 0:
            self._splay(x)
            old = self.colour[x]
            if old >= 0:
                yield x, old
            cut = self.deep[x]
            if cut >= 0:
                self.colour[cut] = old
            self.deep[x] = below
            below = x
            x = self.up[x]
        self.colour[below] = colour


def all_runs(items: list[int]) -> dict[tuple[int, int], int]:
    """All maximal runs of two periods or more: (start, smallest period) to the last place."""
    automaton = Automaton(items)
    longest, paths, runs = automaton.longest, ColouredPaths(automaton.link), {}
    for i, state in enumerate(automaton.prefixes):
        for node, before in paths.access(state, i):
            if longest[node] >= i - before:
                runs[before - longest[node] + 1, i - before] = i
    return runs


def _window(min_length: int, min_exponent: int) -> int:
    """Words of the windows that recur at a distance of one period all over any run that is long enough."""
    return min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 2))


def stretches(hashes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """Half-open stretches of words that hold every run of the least length and exponent; few others in common texts."""
    width = _window(min_length, min_exponent)
    windows = window_hashes(hashes, width)
    order = np.argsort(windows, kind="stable")
    same = np.flatnonzero(windows[order[1:]] == windows[order[:-1]])
    if not len(same):
        return []
    far = np.iinfo(np.int64).max // min_exponent
    near = np.full(len(windows), far, np.int64)
    gaps = order[same + 1] - order[same]
    near[order[same + 1]] = gaps
    near[order[same]] = np.minimum(near[order[same]], gaps)
    open_ = near < far
    for _ in range(_PASSES):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], open_.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
        size = np.repeat(ends - starts + width - 1, ends - starts)
        at = np.flatnonzero(open_)
        shut = at[(near[at] * min_exponent > size) | (size < min_length)]
        if not len(shut):
            break
        open_[shut] = False
    else:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], open_.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2]
    return [(int(a), int(b) + width - 1) for a, b in zip(starts, ends, strict=True)]


def runs_of(words: list[bytes], hashes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least that length and that many periods, by start and period."""
    found = []
    for a, b in stretches(hashes, min_length, min_exponent):
        numbers: dict[bytes, int] = {}
        items = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
        for (start, period), last in all_runs(items).items():
            if last - start + 1 >= max(min_length, min_exponent * period):
                found.append((a + start, last - start + 1, period))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Replace the text by ``runs`` and ``collapsed``: the words that are in no run behind its first period, joined by blanks.

    ``runs`` lists (start, length, period), counted in words, of each run of at least ``min_length`` words and
    ``min_exponent`` (2 or more) periods, by start and period. All other columns stay; columns named runs or collapsed
    are replaced. Defined cases: a null or empty text has no runs and an empty collapsed text; rows are judged one by one,
    so repeated rows and null ids have no effect; an empty table gives no rows. A task holds one document's words; a
    stretch that is periodic takes some 700 bytes a word in its automaton, other words take 50 bytes.
    """
    others = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    row = T.StructType([docs.schema[c] for c in others])
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row") if others else F.lit(0).alias("_row"), F.col(text).alias("_text"))

    def collapse(batches):
        import pyarrow as pa

        known = WordHashes()
        for batch in sliced(batches):
            runs, left = [], []
            for content in texts_of(batch, "_text"):
                words = content.split()
                found = runs_of(words, known.of(words), min_length, min_exponent)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                if found:
                    stays = np.ones(len(words), bool)
                    for s, n, p in found:
                        stays[s + p : s + n] = False
                    words = [w for w, kept in zip(words, stays.tolist(), strict=True) if kept]
                left.append(b" ".join(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [batch.column("_row"), pa.array(runs, kind), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "runs", "collapsed"])

    schema = T.StructType([T.StructField("_row", row if others else T.IntegerType()), *T._parse_datatype_string(f"runs {RUNS}, collapsed string").fields])
    out = packed.mapInArrow(collapse, schema)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in others], "runs", "collapsed")


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's texts: of every tenth hash, the words from a certain one on repeat with a certain period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    times = F.ceil((n - a) / p)
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times.cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & text.rlike(WORD), changed).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns. A null doc_id has no hash, so its text stays as it is."""
    out = collapse_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    # The longest run; ties go to the smallest start, then the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.start")).alias("start"), F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"), F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"),
        sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS r, doc_id, {crc32_sql("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents, crc_table
), e AS (
  SELECT r, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (
  SELECT r, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS x FROM (SELECT *, unnest(range(n)) AS i FROM f)
), pairs AS (
  SELECT s.r, s.i, u.i - s.i AS q FROM t s JOIN t u ON s.r = u.r AND s.x = u.x AND u.i > s.i JOIN f ON f.r = s.r WHERE 4 * (u.i - s.i) <= n
), islands AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
  GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (SELECT r, start, length, min(q) AS period FROM islands GROUP BY r, start, length),
best AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    first(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS b FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY i) AS collapsed FROM t
  WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = t.r AND t.i >= runs.start + runs.period AND t.i < runs.start + runs.length) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM f LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
