"""Helpers shared by the training-data operators: stored tables and hashes of words and shingles."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed, components, shared_folder

__all__ = ["ascii_lower", "checkpointed", "components", "giving_back", "mix", "read", "shared_folder", "shingle_sets", "signed", "stored", "text_buffers", "unit_interval", "word_count", "word_hashes"]

#: The white space that separates words, as a regular expression class and as bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: for rows with texts, of which later steps read columns."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_interval(*parts: Column | str) -> Column:
    """A reproducible uniform number in (0, 1) from the given values: 52 bits of their md5."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def giving_back(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """run, a task's work on its batches, with the memory that it used given back when it ends.

    Python workers live on after a task, idle ones too; what a task leaves in their pools is missing in later stages.
    """

    @wraps(run)
    def leaving(batches: Iterator[Any]) -> Iterator[Any]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
        if trim is not None:
            trim(0)

    return leaving


# --- words and shingles over Arrow buffers -----------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text whose hashes are made at once.
SLICE_BYTES = 1 << 18


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        for i, base in enumerate((_BASE, _UNBASE)):
            grown = np.full(size, base, dtype=np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads each bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null reads as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes of the words of each row: (first row, last row + 1, hashes, where each row's begin and end).

    Rows come in slices of about SLICE_BYTES, so that memory follows the slice and the longest text, not the batch.
    """
    data, offsets = text_buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        last = min(last, rows)
        begin = int(offsets[first])
        raw = data[begin : int(offsets[last])]
        cuts = (offsets[first : last + 1] - begin).astype(np.int64)
        if len(raw) == 0:
            yield first, last, np.zeros(0, np.uint64), np.zeros(last - first + 1, np.int64)
            first = last
            continue
        inside = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[cuts] = True
        head = inside.copy()
        head[1:] &= ~inside[:-1] | edge[1:-1]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        power, unpower = _powers_to(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LOWER[raw] * power[: len(raw)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * unpower[starts] + (ends - starts).astype(np.uint64))
        yield first, last, hashes, np.searchsorted(starts, cuts)
        first = last


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingles of `width` words as sorted 64-bit hashes).

    A text of fewer words is one shingle, a text without words has none.
    """
    for first, last, words, bounds in word_hashes(column):
        count = max(0, len(words) - width + 1)
        sums = np.zeros(count, np.uint64)
        for k in range(width):
            sums += words[k : k + count] * _MULTIPLIERS[k % 4] * np.uint64(2 * (k // 4) + 1)
        sums = mix(sums)
        for row in range(first, last):
            a, b = int(bounds[row - first]), int(bounds[row - first + 1])
            if b - a >= width:
                yield row, np.unique(sums[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for k in range(a, b):
                    whole = mix(np.array([whole]))[0] ^ words[k]
                yield row, mix(np.array([whole]))
            else:
                yield row, np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
