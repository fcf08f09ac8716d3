"""Minimal perfect hashing of distinct 64-bit keys, built by Spark in shards.

A key's place in a bit array of a level is its hash there; keys that are alone in their place stay, the others go to the
next level, until none is left. A key's number is the number of set bits before its own: n keys get the numbers 0 to n - 1,
in about 4 bits each. As a key that isn't of the set may get a number too, the keys themselves lie under their numbers.

Each shard of the keys, told by their hash, is built by one task; shards of a level lie in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix

SHARDS, SPACE = 64, 1.5
LEVELS = "shard int, level int, bits binary, keys binary"
_GOLDEN = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(1)) & np.uint64(SHARDS - 1)).astype(np.int64)


def place(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """A place below size (under 2**32) for each key, another one in each level."""
    h = mix(keys.astype(np.uint64) + np.uint64((level + 2) * _GOLDEN % 2**64))
    return (((h >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)).astype(np.int64)


def built(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of bits, keys that stay, in the order of their bits) of each level, for distinct keys."""
    left, level = keys, 0
    while len(left):
        size = -(-max(64, int(SPACE * len(left))) // 64) * 64
        at = place(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        stays = alone[at]
        yield np.packbits(alone, bitorder="little").view(np.uint64), left[stays][np.argsort(at[stays])]
        left, level = left[~stays], level + 1


def shards(distinct: DataFrame) -> DataFrame:
    """distinct (shard, key), each key once, as the levels of each shard."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([batch.column("key").to_numpy() for batch in batches])
        for level, (bits, stay) in enumerate(built(keys)):
            yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()], pa.int32()), pa.array([level], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.array([stay.tobytes()], pa.binary())], names=["shard", "level", "bits", "keys"])

    return distinct.groupBy("shard").applyInArrow(run, LEVELS)


class PerfectHash:
    """number() of keys, from the rows of shards(): (shard, level, bits, keys)."""

    def __init__(self, rows: Iterator[tuple[int, int, bytes, bytes]]):
        found = sorted((level, shard, bits, keys) for shard, level, bits, keys in rows)
        levels = max((r[0] for r in found), default=-1) + 1
        #: Words of a shard's bits in a level, and the first of them.
        self.sizes, self.starts = np.zeros((levels, SHARDS), np.int64), np.zeros((levels, SHARDS), np.int64)
        at = 0
        for level, shard, bits, _ in found:
            self.sizes[level, shard], self.starts[level, shard] = len(bits) // 8, at
            at += len(bits) // 8
        self.bits = np.frombuffer(b"".join(r[2] for r in found), np.uint64)
        self.keys = np.frombuffer(b"".join(r[3] for r in found), np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.keys)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, -1 for keys that aren't of the set."""
        out, left, shard = np.full(len(keys), -1, np.int64), np.arange(len(keys)), shard_of(keys)
        for level in range(len(self.sizes)):
            size = self.sizes[level, shard[left]]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = place(keys[left], level, size * 64)
            word, bit = self.starts[level, shard[left]] + (at >> 6), (at & 63).astype(np.uint64)
            held = self.bits[word]
            hit = (held >> bit) & np.uint64(1) == 1
            under = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(under)
            left = left[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)
