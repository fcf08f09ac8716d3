"""Importance resampling towards a target distribution, by hashed n-grams.

Documents and target texts are bags of features: all runs of 1 to `longest` consecutive words, in hashed buckets. A
bucket's gain is the logarithm of how much likelier the target's features fall into it than the documents', each bucket
counted once more. A document's weight is its features' mean gain; its score adds Gumbel noise drawn from its id, so that
the highest scores are a sample without replacement in proportion to the exponentials of the weights.

A worker interns the n-grams of some documents at a time in an open-addressed table of NumPy arrays: the xxhash64 of an
n-gram finds its slot, its bytes confirm it. A slot holds its bucket and its count; the slot of each occurrence is kept, so
that buckets are made once for each distinct n-gram and gains are gathered by slot. Counts of buckets are vectors of fixed
length, summed in two steps. Ranks need no sort of all documents: scores are whole numbers within a bounded range, and a
count of each tells the score at which the draw ends; ties are ranked in tiles of ids.

Defined results: null texts have no words. Bits of text that aren't words part them. A document without features has
weight 0. Null ids share one draw and come last among ties; rows equal in all that is returned are ranked in any order. A
very long text is worked on in pieces. Without target texts all t are 0. An empty table gives an empty result. Further
columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running
from .common import giving_back, stored
from .tables import PART, PARTS, sent, summed

#: Fixed value: what words are made of, once A-Z is lower-cased, in UTF-8: digits, a-z, all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NOT_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of text whose words are made at once, and n-grams interned at once.
SLICE, OCCURRENCES = 1 << 20, 1 << 15
#: Ids of a tile in which ties are ranked.
TILE = 1 << 20
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    longest: int = 2
    min_words: int = 20
    percent: int = 25
    seed: int = 7
    #: Scores and weights are in these parts of a unit.
    scale: int = 1000


class Interned:
    """An open-addressed table of the n-grams given: owner and bucket of each slot, count, and slots, one an occurrence."""

    def __init__(self, grams: list[bytes], buckets: int, digest=xxhash.xxh64_intdigest):
        n = len(grams)
        size = 1 << max(4, (2 * n - 1).bit_length())
        keys, bytes_ = np.fromiter(map(digest, grams), np.uint64, n), np.empty(n, object)
        bytes_[:] = grams
        owner, self.slots = np.full(size, -1, np.int64), np.zeros(n, np.int64)
        place, pending = (keys & np.uint64(size - 1)).astype(np.int64), np.arange(n)
        while len(pending):
            held = owner[place]
            free = np.flatnonzero(held < 0)
            owner[place[free]] = pending[free]  # of several that want a slot one stays; equal ones find themselves in it
            held[free] = owner[place[free]]
            same = held == pending
            near = np.flatnonzero(~same & (keys[held] == keys[pending]))
            same[near] = bytes_[held[near]] == bytes_[pending[near]]
            self.slots[pending[same]] = place[same]
            rest = np.flatnonzero(~same)
            pending, place = pending[rest], (place[rest] + 1) & (size - 1)
        used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slots, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        self.bucket[used] = np.fromiter((zlib.crc32(grams[k]) % buckets for k in owner[used].tolist()), np.int64, len(used))


def words(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, in lists of a slice of it each."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            cut = _NOT_WORD.search(text, end)
            end = cut.start() if cut else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def interned(column: pa.Array, how: Resampling) -> Iterator[tuple[np.ndarray, np.ndarray, Interned]]:
    """(rows, how many n-grams of each follow, their table) for pieces of a text column; and how many words each has."""
    grams: list[bytes] = []
    rows: list[int] = []
    sizes: list[int] = []
    heads: list[int] = []
    for row, text in enumerate(column.cast(pa.large_binary())):
        before: list[bytes] = []
        for found in words(text.as_py() or b""):
            for n in range(1, how.longest + 1):
                # n-grams that end in these words: what stands before them reaches back n - 1 words
                run = [*before[len(before) - min(n - 1, len(before)) :], *found]
                made = run if n == 1 else list(map(b" ".join, zip(*[run[k:] for k in range(n)], strict=False)))
                grams += made
                rows.append(row)
                sizes.append(len(made))
                heads.append(len(made) if n == 1 else 0)
            before = [*before, *found][-(how.longest - 1) :] if how.longest > 1 else []
            if len(grams) >= OCCURRENCES:
                yield np.array(rows), np.array([sizes, heads]), Interned(grams, how.buckets)
                grams, rows, sizes, heads = [], [], [], []
    if grams:
        yield np.array(rows), np.array([sizes, heads]), Interned(grams, how.buckets)


def bucket_counts(texts: DataFrame, how: Resampling) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    size = -(-how.buckets // PART) * PART

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint64)
        for batch in batches:
            for _, _, found in interned(batch.column(0), how):
                used = np.flatnonzero(found.count)
                np.add.at(table, found.bucket[used], found.count[used].astype(np.uint64))
        yield from sent(table)

    return summed(texts.select("text").mapInArrow(run, PARTS), size, "<u8")[: how.buckets]


def gains(documents: np.ndarray, target: np.ndarray, how: Resampling) -> np.ndarray:
    """The gain of each bucket, from the counts of documents and target."""
    s_all, t_all, extra = int(documents.sum()), int(target.sum()), how.buckets
    ratio = lambda s, t: math.floor(how.scale * math.log((t + 1) * (s_all + extra) / ((s + 1) * (t_all + extra))))
    return np.array([ratio(s, t) for s, t in zip(documents.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, how), bucket_counts(target, how), how))  # a number for each bucket

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, features, count = (np.zeros(n, np.int64) for _ in range(3))
            for rows, (sizes, heads), found in interned(batch.column(1), how):
                gained = gain.value[found.bucket][found.slots]
                sums = np.concatenate([[0], np.cumsum(gained)])
                ends = np.cumsum(sizes)
                np.add.at(total, rows, sums[ends] - sums[ends - sizes])
                np.add.at(features, rows, sizes)
                np.add.at(count, rows, heads)
            weight = total // np.maximum(features, 1)  # down, also below 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-how.scale * F.log(-F.log(uniform))).cast("long")
    return found.withColumn("score", F.col("weight") + noise)


def drawn(scored: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """scored (doc_id, n_words, score and more) with rank: 1, 2, 3... by score, then id, of those drawn, else null."""
    open_ = scored.where(F.col("n_words") >= how.min_words)
    # scores are whole numbers: gains and noise are logarithms, so that a table of them stays small
    counts = sorted(((r["score"], r["n"]) for r in open_.groupBy("score").agg(F.count("*").alias("n")).toLocalIterator()), reverse=True)
    quota = how.percent * sum(n for _, n in counts) // 100
    ahead, before = {}, 0
    for score, n in counts:
        if before >= quota:
            break
        ahead[score] = before
        before += n
    none = F.lit(None).cast("long")
    if not ahead:
        return scored.withColumn("rank", none)
    last = min(ahead)
    table = scored.sparkSession.createDataFrame(list(ahead.items()), "score long, ahead long")
    chosen = (F.col("n_words") >= how.min_words) & (F.col("score") >= last)
    placed = scored.where(chosen).withColumn("__at", F.coalesce("doc_id", F.lit(_LAST)))
    placed = running(placed, ["score"], "__at", ["__at", *[c for c in scored.columns if c not in ("doc_id", "score")]], {"__earlier": ("sum", F.lit(1))}, TILE)
    rank = F.col("ahead") + F.col("__earlier") + 1
    ranked = placed.join(F.broadcast(table), "score").select(*scored.columns, F.when(rank <= quota, rank).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~chosen).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    return drawn(stored(weighed(docs, target, how)), how).select("doc_id", "n_features", "weight", "score", "rank")
