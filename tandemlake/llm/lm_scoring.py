"""Cross-entropy difference: each document's loss under a target model less that under a background model.

Both are bigram models over one vocabulary, the words of all documents, lower-cased in A-Z. The background model counts
every document, the target model those of the target. They are matched: the background's counts are scaled to the target's
number of tokens, so that both give the same to words that neither knows, and are smoothed alike. With c the counts, n
their sum, V the size of the vocabulary and m = SMOOTHING,

    p(w)     = (c(w) + 1) / (n + V)
    p(w | v) = (c(v, w) + m * p(w)) / (c(v) + m)

where v is the word before, or the document's begin. A score is the mean over a document's tokens of the target's loss
less the background's, in nats: low for documents like the target. A document that a model has counted is scored by the
model without that document's own counts, so that the target's documents have no advantage of being in it.

The counts are a distributed table of words and pairs, as hashes, that grows with the corpus; a hash has SPARE bits more
than it takes to count the corpus' bytes, so that 1 in some 10,000 shares its hash with another. Documents are
dealt to blocks of BLOCK bytes, each stored once as one compressed row. A block counts its own words and pairs and sends
them, as sorted arrays, to buckets of hashes; a bucket adds up the blocks' counts and sends each block the sums of what
other blocks have as well. The block then scores its documents. A hot word or pair is one entry of each block and one sum
of a bucket; buckets are as many as keep each of them to about BUCKET entries. Only totals reach the driver.

Defined results: null texts and texts without a word have 0 tokens and null losses and score. An empty target has equal
probabilities for all words, and the background isn't scaled. A null doc_id is in no target. Repeated rows count and are scored as often as they come. A
very long text is a block of its own and is held by one task. An empty table gives an empty result. Other columns, of
whatever name, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stored, word_hashes

#: Words of context mass.
SMOOTHING = 50.0
#: Bytes of text of a block, and bytes that a row counts for at least; entries of a bucket.
BLOCK, ROW_BYTES, BUCKET = 1 << 22, 64, 1 << 20
#: Bytes of a word in its text, about, from which the number of buckets follows.
WORD_BYTES = 6
#: Up to so many ids of target documents (8 bytes each) are broadcast to the documents; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of a hash beyond those of the corpus' size in bytes, and the least; the lowest bit tells words (0) from pairs (1).
SPARE, LEAST_BITS = 12, 40
_BEGIN = 0x51F42D4C957F2C5D
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
BLOCKS = "block long, size long, docs binary"
SENT = "bucket long, block long, grams binary, counts binary"
RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


@dataclass(frozen=True)
class Models:
    smoothing: float = SMOOTHING
    block: int = BLOCK
    bucket: int = BUCKET


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, text, wanted: whether the document is one of the target."""
    chosen = target.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    if chosen.count() <= BROADCAST_IDS:
        chosen = F.broadcast(chosen)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return held.join(chosen, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", F.col("id").isNotNull().alias("wanted"))


def blocks(flagged: DataFrame, how: Models) -> DataFrame:
    """block, size (bytes of text), docs: the documents in blocks, stored, so that blocks stay as they are."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, []

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:  # noqa: B023
                out.write_table(pa.Table.from_batches(held))  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "size", "docs"])  # noqa: B023

        for batch in batches:
            sizes = np.maximum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), ROW_BYTES).astype(np.int64)
            at = 0
            while at < batch.num_rows:
                upto = size + np.cumsum(sizes[at:])
                taken = max(int(np.searchsorted(upto, how.block, "right")), 0 if held else 1)
                if taken:
                    held.append(batch.slice(at, taken))
                    size, at = int(upto[taken - 1]), at + taken
                if at < batch.num_rows:
                    yield row()
                    number, size, held = number + 1, 0, []
        if held:
            yield row()

    return stored(flagged.select("doc_id", "text", "wanted").mapInArrow(deal, BLOCKS))


def _documents(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers with their bytes of one place side by side, so that those that are 0 compress."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def steps(ordered: np.ndarray) -> bytes:
    """Numbers in order, packed by their differences."""
    return packed(np.diff(ordered, prepend=np.uint64(0)))


def from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


@dataclass
class Grams:
    """The tokens of a run of documents: each token's document, its word and its pair; the documents' sizes."""

    of: np.ndarray
    words: np.ndarray
    pairs: np.ndarray
    sizes: np.ndarray


def _begin(bits: int) -> np.uint64:
    return np.uint64(_BEGIN >> (64 - bits) & ~1)


def grams(column: pa.Array, bits: int) -> Grams:
    """A document's begin is a word of its own."""
    shift, one = np.uint64(64 - bits), np.uint64(1)
    words, sizes = [np.zeros(0, np.uint64)], np.zeros(len(column), np.int64)
    for first, last, found, bounds in word_hashes(column):
        words.append((found >> shift) & ~one)
        sizes[first:last] = np.diff(bounds)
    ids = np.concatenate(words)
    of = np.repeat(np.arange(len(column)), sizes)
    contexts = np.empty_like(ids)
    contexts[1:] = ids[:-1]
    contexts[(np.cumsum(sizes) - sizes)[sizes > 0]] = _begin(bits)
    return Grams(of, ids, (mix(contexts * _LEFT + ids * _RIGHT) >> shift) | one, sizes)


def counted(made: Grams, wanted: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, begins and pairs in order, their counts in all documents and in the target's as two rows, the
    place of each token's word, then of each one's pair)."""
    begins = np.flatnonzero(made.sizes > 0)
    every = np.concatenate([made.words, made.pairs, np.full(len(begins), _begin(bits))])
    inside = np.concatenate([wanted[made.of], wanted[made.of], wanted[begins]])
    found, place = np.unique(every, return_inverse=True)
    counts = np.stack([np.bincount(place, minlength=len(found)), np.bincount(place[inside], minlength=len(found))])
    return found, counts.astype(np.uint64), place[: 2 * len(made.words)].reshape(2, -1)


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def block_counts(dealt: DataFrame, buckets: int, bits: int) -> DataFrame:
    """bucket, block, grams, counts: what each block has of each bucket, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the high bits decide, so that a bucket is a stretch of what is in order
        bounds = np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs = _documents(raw.as_buffer())
                found, counts, _ = counted(grams(_column(docs, "text"), bits), _column(docs, "wanted").to_numpy(zero_copy_only=False).astype(bool), bits)
                edges = np.searchsorted(found, bounds).tolist()
                rows = [(k, a, b) for k, (a, b) in enumerate(zip([0, *edges], [*edges, len(found)], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _, _ in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()),
                        pa.array([steps(found[a:b]) for _, a, b in rows], pa.binary()), pa.array([packed(counts[:, a:b].reshape(-1)) for _, a, b in rows], pa.binary()),
                    ],
                    names=["bucket", "block", "grams", "counts"],
                )

    return dealt.select("block", "docs").mapInArrow(run, SENT)


def summed(sent: DataFrame, bits: int) -> DataFrame:
    """bucket, block, grams, counts: for each block the sums over all blocks of what others have as well.

    A row with a null block holds three numbers of a bucket: its distinct words, their tokens, and those of the target.
    """

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "block", "grams", "counts"]
        blocks, parts, counts = [], [], []
        for batch in batches:
            for block, part, count in zip(batch.column("block"), batch.column("grams"), batch.column("counts"), strict=True):
                blocks.append(block.as_py()), parts.append(from_steps(part.as_py()))
                counts.append(unpacked(count.as_py()).reshape(2, -1))
        found, inverse, held = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        every = np.concatenate(counts, axis=1)
        total = np.stack([np.bincount(inverse, c, len(found)) for c in every]).astype(np.uint64)
        words = (found & np.uint64(1) == 0) & (found != _begin(bits))
        bucket, known = key[0].as_py(), [int(words.sum()), *(int(t[words].sum()) for t in total)]
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([np.array(known, ">u8").tobytes()], pa.binary())], names=names)
        at = 0
        for block, part in zip(blocks, parts, strict=True):
            place = inverse[at : at + len(part)]
            at += len(part)
            place = place[held[place] > 1]
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([block], pa.int64()), pa.array([steps(found[place])], pa.binary()), pa.array([packed(total[:, place].reshape(-1))], pa.binary())], names=names)

    return sent.groupBy("bucket").applyInArrow(add, SENT)


def repeats(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each token, how many tokens of its row have its place."""
    _, inverse, counts = np.unique(rows << 40 | places, return_inverse=True, return_counts=True)
    return counts[inverse]


def _scores(blocks: pa.Table, sums: pa.Table, totals: tuple[int, int, int], bits: int, how: Models) -> pa.Table:
    """The scores of a block's documents; totals are all tokens, the target's, and the size of the vocabulary."""
    docs = _documents(blocks.column("docs")[0].as_buffer())
    wanted = _column(docs, "wanted").to_numpy(zero_copy_only=False).astype(bool)
    made = grams(_column(docs, "text"), bits)
    found, counts, (word, pair) = counted(made, wanted, bits)
    for part, count in zip(sums.column("grams").to_pylist(), sums.column("counts").to_pylist(), strict=True):
        counts[:, np.searchsorted(found, from_steps(part))] = unpacked(count).reshape(2, -1)
    own = [repeats(made.of, word), repeats(made.of, pair), np.ones(len(word), np.int64)]
    # each token's context is the word before it, or the begin, of which a document has one
    context = np.full_like(word, np.searchsorted(found, _begin(bits)))
    follows = np.flatnonzero(made.of[1:] == made.of[:-1])
    context[follows + 1], own[2][follows + 1] = word[follows], own[0][follows]
    size, vocabulary = made.sizes[made.of], totals[2]
    sums_of = []
    for k, total in enumerate(totals[:2]):
        c = counts[k].astype(np.float64)
        mine = np.ones(len(made.of)) if k == 0 else wanted[made.of].astype(np.float64)
        scale = totals[1] / totals[0] if k == 0 and totals[1] else 1.0
        alone = (scale * (c[word] - own[0] * mine) + 1.0) / (scale * (total - size * mine) + vocabulary)
        loss = -np.log((scale * (c[pair] - own[1] * mine) + how.smoothing * alone) / (scale * (c[context] - own[2] * mine) + how.smoothing))
        sums_of.append(np.bincount(made.of, loss, len(made.sizes)))
    empty = made.sizes == 0
    background, target = (x / np.maximum(made.sizes, 1) for x in sums_of)
    arrays = [_column(docs, "doc_id"), pa.array(made.sizes), pa.array(target, mask=empty), pa.array(background, mask=empty), pa.array(target - background, mask=empty)]
    return pa.Table.from_arrays(arrays, names=[c.split()[0] for c in RESULT.split(", ")])


def difference(docs: DataFrame, target: DataFrame, how: Models = Models()) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of docs for a target given by the doc_id of its documents."""
    dealt = blocks(flagged(docs, target), how)
    (size,) = dealt.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-2 * size // (WORD_BYTES * how.bucket)))
    bits = min(64, max(LEAST_BITS, int(size).bit_length() + SPARE))
    sums = stored(summed(block_counts(dealt, buckets, bits), bits))
    number = lambda k: F.coalesce(F.sum(F.conv(F.hex(F.substring("counts", 8 * k + 1, 8)), 16, 10).cast("long")), F.lit(0))
    vocabulary, tokens, inside = sums.where("block is null").agg(*map(number, range(3))).first()
    totals = (tokens, inside, vocabulary)

    def score(blocks: pa.Table, sums: pa.Table) -> pa.Table:
        return _scores(blocks, sums, totals, bits, how)

    held = sums.where("block is not null").select(F.col("block").alias("of"), "grams", "counts")
    return dealt.select("block", "docs").groupBy("block").cogroup(held.groupBy("of")).applyInArrow(score, RESULT)
