"""Aligning two tokenizers' tokens of the same texts, and counting which ids go together.

Both write a text as bytes without a gap. Where tokens of both end at one byte the tokens before it make a group; tokens
whose bytes overlap are linked. Between two neighbouring ends of any token lies exactly one linked pair, so that links need
no search: they are the sorted union of both lists of ends.

No token of either kind reaches over a space behind other characters, and neither tokenizer looks across it. A text is cut
there into chunks, a word each as a rule, which are encoded and aligned by themselves; a worker remembers those it has met.
The tests hold chunks against whole texts.

A pair of ids is counted by the documents that hold it linked. The first pass aligns documents and keeps each task's pairs
with their numbers, by shard. The distinct pairs get a minimal perfect hash; the numbers become dense vectors indexed by
it, which are summed in two steps. The second pass aligns documents again and looks its links up, verifying the pair that
lies under each number. Tables of pairs are broadcast up to `most_pairs` (about 25 bytes each); beyond, counts are grouped
and joined by shuffles, and documents meet their sums by their texts' digests.

Defined results: null and empty texts, and those whose tokens' bytes aren't a space and the text (characters that a
tokenizer rewrites), have no tokens: zeros and an empty string. A document is a row, also if its id repeats. Special
tokens' strings are text like any other. A very long text is worked on chunk by chunk, one without spaces whole. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, stored
from .perfect_hash import SHARDS, PerfectHash, shard_of, shards
from .tables import PART, PARTS, sent, summed
from .tokens import encode_ordinary, fast_library

PIECES = "piece_bpe_32k.model"
#: Pairs that a task holds before it adds equal ones, and pairs that are broadcast.
HELD, MOST_PAIRS = 1 << 20, 1 << 24
#: Chunks that a worker remembers, and their characters; then it begins anew.
KNOWN, KNOWN_BYTES = 1 << 18, 1 << 24
#: Characters of the texts looked at together, and new chunks encoded together.
SLICE, TOGETHER = 1 << 20, 4096
#: A pair of ids as one number: the first id above these bits.
BITS = 16


@lru_cache(maxsize=1)
def pieces():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))


@lru_cache(maxsize=1)
def vocabularies() -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id of both."""
    a, b = fast_library(), pieces()
    first = [a.decode_single_token_bytes(i) for i in range(a.n_vocab)]
    second = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return first, second


@lru_cache(maxsize=1)
def _lengths() -> tuple[np.ndarray, np.ndarray]:
    a, b = vocabularies()
    return np.array([len(t) for t in a]), np.array([len(t) for t in b])


#: A space with what follows, up to the next space behind other characters; white space at the end is the last chunk's.
CHUNK = re.compile(r"(?: \s*)\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?")


#: White space before a space: the space doesn't begin a chunk.
_RUNS = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]


def chunks(text: str) -> list[str]:
    """A space and the text, cut where neither tokenizer looks across; each chunk without the space that it begins with."""
    whole = " " + text
    if not text[-1:].isspace() and not any(run in whole for run in _RUNS):
        return text.split(" ")
    return [c[1:] for c in CHUNK.findall(whole)] if whole.strip() else [text]


@lru_cache(maxsize=1)
def _written() -> np.ndarray:
    """Each number in decimal, padded with zero bytes, before each of the separators."""
    n = max(map(len, vocabularies()))
    return np.array([[f"{i}{s}".encode() for i in range(n)] for s in (",", "|", ";", "")], "S7")


@dataclass
class Aligned:
    """Some chunks' tokens of both, groups and links, linked pairs (both ids as one number), and their ids as _written()."""

    sizes: np.ndarray
    pairs: np.ndarray
    codes: np.ndarray


def align(group: list[str]) -> Aligned | None:
    """Chunks aligned as one text; None if the tokens' bytes aren't the chunks'."""
    first, second = vocabularies()
    whole = " " + " ".join(group)
    a, b = encode_ordinary(whole).astype(np.int64), np.array(pieces().encode(whole[1:]), np.int64)
    raw = whole.encode()
    if b"".join(map(first.__getitem__, a.tolist())) != raw or b"".join(map(second.__getitem__, b.tolist())) != raw:
        return None
    ends = np.cumsum([len(c) + 1 if c.isascii() else len(c.encode()) + 1 for c in group])
    a_ends, b_ends = np.cumsum(_lengths()[0][a]), np.cumsum(_lengths()[1][b])
    every = np.concatenate([a_ends, b_ends])
    every.sort(kind="stable")  # two runs
    twice = every[1:] == every[:-1]
    common, every = every[1:][twice], every[np.append(True, ~twice)]
    pairs = (a[np.searchsorted(a_ends, every)] << BITS) | b[np.searchsorted(b_ends, every)]
    upto = [np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, common, every)]
    # a group's own tokens of the first kind come first, then those of the second
    a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
    ids, sign = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
    a_at, b_at = np.arange(len(a)) + np.searchsorted(b_group, a_group), np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
    ids[a_at], sign[a_at] = a, common[a_group] == a_ends
    ids[b_at], sign[b_at] = b, 2 * (common[b_group] == b_ends)
    behind = upto[0] + upto[1]
    sign[behind - 1] = 3  # nothing behind a chunk's last
    counts = [np.diff(u, prepend=0) for u in upto]
    return Aligned(np.stack(counts, axis=1), pairs, (sign * len(_written()[0]) + ids).astype(np.int32))


def _ranges(ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places from ends[n] to ends[n + 1] of each number, how many those are)."""
    many = ends[numbers + 1] - ends[numbers]
    upto = np.cumsum(many)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends[numbers] - upto + many, many), many


class _Numbers(dict):
    """Chunks with their numbers; one that is asked for and unknown gets the next."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        return number


def _aligned(group: list[str]) -> list[Aligned | None]:
    """The chunks in parts, None for a chunk whose tokens aren't its bytes."""
    found = align(group) if group else None
    if found is not None or len(group) < 2:
        return [found] * len(group[:1])
    half = len(group) // 2
    return _aligned(group[:half]) + _aligned(group[half:])


_NONE = Aligned(np.zeros((1, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))


class Memory:
    """The chunks that a worker has met, numbered, with their tokens, groups and links; none for those whose tokens aren't
    their bytes."""

    def __init__(self):
        self.numbers = _Numbers()
        self.sizes = np.zeros((0, 4), np.int64)
        self.pairs, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        #: Where each chunk's pairs and codes end, a 0 before.
        self.ends, self.written = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.held = 0

    def learn(self, fresh: list[str]) -> None:
        """Align chunks that have got the next numbers."""
        made: list[Aligned] = []
        at = 0
        # white space at the end looks at what follows: such chunks, the last ones of texts, stay alone
        alone = [k for k, c in enumerate(fresh) if c[-1:].isspace() or not c]
        for k in [*alone, len(fresh)]:
            for part in [*(fresh[x : min(k, x + TOGETHER)] for x in range(at, k, TOGETHER)), fresh[k : k + 1]]:
                made += [found or _NONE for found in _aligned(part)]
            at = k + 1
        self.held += sum(map(len, fresh))
        self.sizes = np.concatenate([self.sizes, *[m.sizes for m in made]])
        self.pairs = np.concatenate([self.pairs, *[m.pairs for m in made]])
        self.codes = np.concatenate([self.codes, *[m.codes for m in made]])
        self.ends = np.append(0, np.cumsum(self.sizes[:, 3]))
        self.written = np.append(0, np.cumsum(self.sizes[:, 0] + self.sizes[:, 1]))

    def documents(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows with tokens, the numbers of their chunks, where each row's begin and end) for slices of a text column."""
        rows: list[int] = []
        found: list[np.ndarray] = []
        size = 0
        for row, text in enumerate(column):
            held = text.as_py()
            if held:
                if not found and (self.held >= KNOWN_BYTES or len(self.numbers) >= KNOWN):
                    self.__init__()
                cut = chunks(held)
                rows.append(row)
                found.append(np.fromiter(map(self.numbers.__getitem__, cut), np.int64, len(cut)))
                size += len(held)
            if size >= SLICE or (size and row == len(column) - 1):
                known = len(self.sizes)
                if len(self.numbers) > known:
                    self.learn(list(islice(self.numbers, known, None)))
                whole = [k for k, n in enumerate(found) if self.sizes[n, 0].all()]
                yield np.array([rows[k] for k in whole], np.int64), np.concatenate([np.zeros(0, np.int64), *[found[k] for k in whole]]), np.cumsum([0, *[len(found[k]) for k in whole]])
                rows, found, size = [], [], 0

    def links(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the pairs that chunks link, whose they are)."""
        at, many = _ranges(self.ends, numbers)
        return self.pairs[at], np.repeat(np.arange(len(numbers)), many)


def _document_pairs(memory: Memory, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document above a pair of ids, for each pair that a document links, once; how often it does)."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    held, n = np.unique((doc << 32) | numbers, return_counts=True)
    pairs, of = memory.links(held & 0xFFFFFFFF)
    keys, at = np.unique((held[of] >> 32 << 32) | pairs, return_inverse=True)
    return keys, np.bincount(at, n[of], len(keys)).astype(np.int64)


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)


COUNTED = "shard int, pairs binary, counts binary"


def counted(docs: DataFrame) -> DataFrame:
    """Each task's pairs with the numbers of its documents that link them, by shard."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        memory = Memory()
        for batch in batches:
            for _, numbers, ends in memory.documents(batch.column(0)):
                some, n = np.unique(_document_pairs(memory, numbers, ends)[0] & 0xFFFFFFFF, return_counts=True)
                pairs.append(some)
                counts.append(n)
                held += len(some)
                if held >= HELD:
                    keys, sums = _added(pairs, counts)
                    pairs, counts, held = [keys], [sums], 0
        keys, sums = _added(pairs, counts)
        shard = shard_of(keys)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        for k in range(SHARDS):
            part = order[bounds[k] : bounds[k + 1]]
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([keys[part].tobytes()], pa.binary()), pa.array([sums[part].tobytes()], pa.binary())], names=["shard", "pairs", "counts"])

    return docs.select("text").mapInArrow(run, COUNTED)


def distinct_pairs(found: DataFrame) -> DataFrame:
    """shard, key: each pair of counted() once."""

    def run(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("pairs"):
                keys = np.union1d(keys, np.frombuffer(raw.as_py(), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), group[0].as_py(), np.int32)), pa.array(keys)], names=["shard", "key"])

    return found.select("shard", "pairs").groupBy("shard").applyInArrow(run, "shard int, key long")


def dense_counts(found: DataFrame, table: PerfectHash) -> np.ndarray:
    """The number of documents of each pair, under the pair's number."""
    size = -(-max(1, len(table)) // PART) * PART
    held = found.sparkSession.sparkContext.broadcast(table)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(size, np.uint64)
        for batch in batches:
            for pairs, counts in zip(batch.column(0), batch.column(1), strict=True):
                at = held.value.number(np.frombuffer(pairs.as_py(), np.int64))
                vector[at] += np.frombuffer(counts.as_py(), np.int64).astype(np.uint64)  # a row has each pair once
        yield from sent(vector)

    return summed(found.select("pairs", "counts").mapInArrow(run, PARTS), size, "<u8")[: len(table)].astype(np.int64)


MADE = "n_a long, n_b long, n_groups long, n_links long"


def _summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows between neighbouring ends."""
    return np.diff(np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, axis=0)])[ends], axis=0)


def _described(memory: Memory, numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(n_a, n_b, n_groups, n_links of each document, its groups' ids)."""
    sizes = memory.sizes[numbers]
    at, many = _ranges(memory.written, numbers)
    codes, last = memory.codes[at], np.cumsum(many) - 1
    within = np.ones(len(numbers), bool)
    within[ends[1:] - 1] = False
    codes[last[within]] -= _written().shape[1]  # a semicolon between chunks
    raw = _written().reshape(-1)[codes]
    heads = np.append(0, last + 1)[ends]
    return _summed(sizes, ends), [raw[x:y].tobytes().replace(b"\0", b"").decode() for x, y in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)]


def _looked_up(docs: DataFrame, table: PerfectHash, count: np.ndarray) -> DataFrame:
    most = np.zeros(1 << BITS, np.int64)
    np.maximum.at(most, table.keys >> BITS, count)
    best = np.packbits(count == most[table.keys >> BITS])
    held = docs.sparkSession.sparkContext.broadcast((table, count, best))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count, best = held.value
        memory = Memory()
        for batch in batches:
            total, text = np.zeros((batch.num_rows, 6), np.int64), [""] * batch.num_rows
            for rows, numbers, ends in memory.documents(batch.column(1)):
                # a chunk's sums are those of its links, whatever its document
                used, at = np.unique(numbers, return_inverse=True)
                pairs, of = memory.links(used)
                place = table.number(pairs)
                if (place < 0).any():
                    raise ValueError("documents have changed between the two passes")
                sums = np.stack([np.bincount(of, v, len(used)) for v in (best[place >> 3] >> (7 - (place & 7)) & 1, count[place])], axis=1).astype(np.int64)
                made, written = _described(memory, numbers, ends)
                total[rows] = np.column_stack([made, _summed(sums[at], ends)])
                for row, named in zip(rows.tolist(), written, strict=True):
                    text[row] = named
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, total.T), pa.array(text, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {MADE}, n_best long, count_sum long, groups string")


def pair_counts(found: DataFrame) -> DataFrame:
    """a_id, b_id, docs: how many documents link each pair, from counted(), by shuffle; best: whether none has more of a_id's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(pairs.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.int64))], names=["pair", "docs"])

    summed_ = found.select("pairs", "counts").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    a_id = F.shiftright("pair", BITS)
    summed_ = stored(summed_.select(a_id.alias("a_id"), F.col("pair").bitwiseAND((1 << BITS) - 1).alias("b_id"), "docs"))
    return summed_.join(summed_.groupBy("a_id").agg(F.max("docs").alias("most")), "a_id").select("a_id", "b_id", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _joined(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """_looked_up for pair tables of any size: sums are made for each digest of a text and joined to the documents."""
    digest = F.md5("text").alias("digest")

    @giving_back
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            for rows, numbers, ends in memory.documents(batch.column(1)):
                keys, n = _document_pairs(memory, numbers, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[keys >> 32])), pa.array(keys >> BITS & ((1 << BITS) - 1)), pa.array(keys & ((1 << BITS) - 1)), pa.array(n)], names=["digest", "a_id", "b_id", "n"])

    @giving_back
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            total, text = np.zeros((batch.num_rows, 4), np.int64), [""] * batch.num_rows
            for rows, numbers, ends in memory.documents(batch.column(2)):
                total[rows], written = _described(memory, numbers, ends)
                for row, named in zip(rows.tolist(), written, strict=True):
                    text[row] = named
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, total.T), pa.array(text, pa.string())], names=["doc_id", "digest", "n_a", "n_b", "n_groups", "n_links", "groups"])

    each = docs.select(digest, "text").mapInArrow(links, "digest string, a_id long, b_id long, n long").groupBy("digest", "a_id", "b_id").agg(F.max("n").alias("n"))
    sums = each.join(counts, ["a_id", "b_id"]).groupBy("digest").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    made = docs.select("doc_id", digest, "text").mapInArrow(sizes, f"doc_id long, digest string, {MADE}, groups string")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return made.join(sums, "digest", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")


def linked(docs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is its first id's most frequent), count_sum
    (documents of the links' pairs) and the groups' ids of each document."""
    found = stored(counted(docs))
    distinct = stored(distinct_pairs(found))
    if distinct.count() > most_pairs:
        return _joined(docs, pair_counts(found))
    table = PerfectHash(tuple(r) for r in shards(distinct).toLocalIterator())
    return _looked_up(docs, table, dense_counts(found, table))
