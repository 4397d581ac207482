"""What the operators of this subpackage share: words, hashes and reading the documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters; ``bytes.split()`` splits UTF-8 alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of a few numbers each that a broadcast may hold: under 100 MB in memory.
BROADCAST_ROWS = 1 << 20


def if_small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most ``most`` rows; else the join shuffles."""
    return F.broadcast(table) if table.count() <= most else table


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def unit_hash(seed: str, key: Column) -> Column:
    """60 bits that SQL engines can compute alike: the first 15 hexadecimal digits of an MD5; null counts as empty text."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


#: DuckDB SQL of a table with the 256 steps of a CRC-32, by a rule.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
)"""


def crc32_sql(value: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII value's text, beside ``crc_table``."""
    codes = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), 4294967295)"


def text_key(text: bytes) -> bytes:
    """16 bytes that name a text: the first half of its SHA-256."""
    return hashlib.sha256(text).digest()[:16]


def key_column(text: Column) -> Column:
    """``text_key`` as a Spark expression; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` lacks, whatever the case of its own: the stems, with underscores where they are taken."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def texts_of(batch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column of an Arrow batch; null becomes empty."""
    import pyarrow as pa

    column = batch.column(name)
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def sliced(batches: Iterable, most: int = 4 << 20) -> Iterator:
    """The rows of Arrow batches in slices of about ``most`` bytes, so that a task never copies a whole batch of texts.

    Arrow's pool keeps freed memory; it is given back after the last batch, since the worker waits for other tasks.
    """
    import pyarrow as pa

    for batch in batches:
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word's bytes. Keeps the words seen, and forgets all of them when there are too many."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) % (1 << 64)
    return y


_BASE_INVERSE = np.uint64(_inverse(int(_BASE)))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(units: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` units (64-bit values), by prefix sums; empty if there are fewer units."""
    n = len(units)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _power_tables(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(units * up, dtype=np.uint64)))
        return mixed((sums[width:] - sums[:-width]) * down[: n - width + 1])
