"""Helpers the training-data operators share: tables kept in the shared folder and byte-level work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightloom.session import work_path

SPACES = r"\x20\x09-\x0D"
# Fixed seeds and multipliers of the 64-bit hashes below.
_TABLE = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

Query = Callable[[SparkSession, str], DataFrame]


def fold(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo `parts`; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later jobs, and tasks rerun after a lost executor, start from it."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_chunks(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20, column: str = "text", rows: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `limit` text bytes (one row at least, `rows` at most): the slice, its UTF-8 bytes, the rows' offsets. Null text is empty."""
    for batch in batches:
        text = batch.column(column).cast(pa.large_string()).fill_null("")
        n = len(text)
        if not n:
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            last = min(last, n, first + rows if rows else n)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash step and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any substring follows (substring_hash)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0], out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end); equal strings have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words are runs of bytes other than `space` (white space) and never cross rows."""
    word = ~space[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles_of(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `width`-word runs and their rows; a row with fewer words gives one run of all its words, a row without words none."""
    n = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(n) - n
    place = np.arange(len(rows)) - first[rows]
    whole = np.minimum(n, width)[rows]  # words of a run in this row
    at = np.flatnonzero(place + whole <= n[rows])
    acc, size = np.zeros(len(at), np.uint64), whole[at]
    for k in range(width):
        use = k < size
        acc = np.where(use, mix(acc * np.uint64(_STEP) + hashes[np.minimum(at + k, len(hashes) - 1)] + np.uint64(k + 1)), acc)
    return acc, rows[at]
