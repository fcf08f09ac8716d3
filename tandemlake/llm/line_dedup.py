"""Dropping the lines that many documents repeat.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key that enough documents hold
loses its lines: all of them, or all but the first (keep_first: the one of the smallest doc_id, then the earliest line).

Two Bloom filters tell which keys can repeat at all: every task sets a key's bits in `once`, and in `twice` if `once` had
them. Two tasks' filters make one: twice = twice | twice' | (once & once'). A filter never misses a key, so that only keys
that `twice` holds, the suspected repeats, are shuffled, each with its bytes and its number of documents within the task;
grouped by the bytes themselves, their numbers are exact. Texts are never shuffled.

The filters have BITS bits for each line of the corpus, up to most_bits: beyond, more keys are suspected and shuffled, and
the result stays the same. Confirmed keys are broadcast up to a size that is checked; a larger table is joined with the
suspected lines, and what they lose with the documents, by shuffles.

Defined results: null and empty texts are one empty line. An empty key never counts. A document is a row, also if its id
repeats; a key twice in one document counts once. With keep_first, rows of one id that are equally first keep theirs each,
and rows without an id come last. A very long text is split whole, in one worker. An empty table gives an empty result; in
`cleaned`, all further columns, of whatever name, pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, stored

#: Bits of a filter for each line, the most of a filter, and words of a part in which filters are sent.
BITS, MOST_BITS, PART = 16, 1 << 30, 1 << 10
#: Parts merged in one group, and groups of tasks in the first of two steps.
GROUP, SALTS = 64, 16
#: Keys that a task counts before it sends them, and bytes of confirmed keys that are broadcast.
HELD, BROADCAST_BYTES = 100_000, 64 << 20
FILTERS = "unit int, salt int, part int, once binary, twice binary"
_WORD, _SIX = np.uint64(32), np.uint64(63)


@dataclass(frozen=True)
class Lines:
    """Keys of at least min_chars code points in at least min_docs documents."""

    min_docs: int = 10
    min_chars: int = 1
    keep_first: bool = False
    most_bits: int = MOST_BITS
    broadcast_bytes: int = BROADCAST_BYTES


def key(line: bytes) -> bytes:
    """bytes.strip() takes exactly ASCII white space, bytes.lower() exactly A-Z."""
    return line.strip().lower()


def keys(text: bytes | None, how: Lines) -> list[bytes]:
    """The key of each line, empty where it is too short to count."""
    found = [key(line) for line in (text or b"").split(b"\n")]
    if how.min_chars > 1:
        return [k if len(k.decode()) >= how.min_chars else b"" for k in found]
    return found


def places(found: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the filter, four bits of it) for each key."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    word = ((h >> _WORD) * np.uint64(words)) >> _WORD
    bits = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= np.uint64(1) << ((h >> np.uint64(shift)) & _SIX)
    return word.astype(np.int64), bits


def seen(once: np.ndarray, twice: np.ndarray, word: np.ndarray, bits: np.ndarray) -> None:
    """Set keys' bits, in `twice` for those that `once` has already or that come twice among them."""
    order = np.lexsort((bits, word))
    w, b = word[order], bits[order]
    again = (once[w] & b) == b
    again[1:] |= (w[1:] == w[:-1]) & (b[1:] == b[:-1])
    np.bitwise_or.at(twice, w[again], b[again])
    np.bitwise_or.at(once, w, b)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_py() for x in column.cast(pa.large_binary()))


def filter_of_repeats(docs: DataFrame, how: Lines = Lines()) -> np.ndarray:
    """The filter of the keys that more than one document may hold."""
    text = F.col("text")
    lines = docs.select(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    size = min(how.most_bits, max(1, lines) * BITS)
    words = -(-size // (64 * PART)) * PART

    @giving_back
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            found: list[bytes] = []
            for raw in _texts(batch.column(0)):
                found += set(keys(raw, how)) - {b""}
                if len(found) >= HELD:
                    seen(once, twice, *places(found, words))
                    found = []
            seen(once, twice, *places(found, words))
        salt = TaskContext.get().partitionId() % SALTS
        a, b = once.reshape(-1, PART), twice.reshape(-1, PART)
        filled = np.flatnonzero(a.any(axis=1)).tolist()
        for at in range(0, len(filled), GROUP):
            some = filled[at : at + GROUP]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p // GROUP for p in some], pa.int32()), pa.array([salt] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([a[p].tobytes() for p in some], pa.binary()), pa.array([b[p].tobytes() for p in some], pa.binary())],
                names=["unit", "salt", "part", "once", "twice"],
            )

    def merge(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, once, twice in zip(*(batch.column(c).to_pylist() for c in ("part", "once", "twice")), strict=True):
                a, b = np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64)
                if part in held:
                    x, y = held[part]
                    held[part] = (x | a, y | b | (x & a))
                else:
                    held[part] = (a, b)
        n = len(held)
        salt = pa.array([-1] * n, pa.int32())  # the second step has one group for each unit
        yield pa.RecordBatch.from_arrays(
            [pa.array([group[0].as_py()] * n, pa.int32()), salt, pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x, _ in held.values()], pa.binary()), pa.array([y.tobytes() for _, y in held.values()], pa.binary())],
            names=["unit", "salt", "part", "once", "twice"],
        )

    merged = docs.select("text").mapInArrow(fill, FILTERS).groupBy("unit", "salt").applyInArrow(merge, FILTERS).groupBy("unit").applyInArrow(merge, FILTERS)
    out = np.zeros((words // PART, PART), np.uint64)
    for r in merged.select("part", "twice").toLocalIterator():  # most_bits bits in all
        out[r["part"]] = np.frombuffer(r["twice"], np.uint64)
    return out.reshape(-1)


def _suspects(found: list[bytes], twice: np.ndarray) -> list[bool]:
    word, bits = places(found, len(twice))
    return ((twice[word] & bits) == bits).tolist()


SUSPECTS = "key binary, docs long, doc_id long, line int"


def repeated(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """key, docs, first (doc_id, line): the keys that enough documents hold, with their number and the first place."""
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast(filter_of_repeats(docs, how))

    def rows(held: dict[bytes, tuple[int, int | None, int]]) -> pa.RecordBatch:
        places_ = list(held.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array([p[0] for p in places_], pa.int64()), pa.array([p[1] for p in places_], pa.int64()), pa.array([p[2] for p in places_], pa.int32())],
            names=["key", "docs", "doc_id", "line"],
        )

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int | None, int]] = {}
        size = 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                first: dict[bytes, int] = {}
                for at, k in enumerate(keys(raw, how)):
                    if k and k not in first:
                        first[k] = at
                found = list(first)
                for k, suspect in zip(found, _suspects(found, twice.value), strict=True):
                    if not suspect:
                        continue
                    had = held.get(k)
                    if had is None:
                        held[k] = (1, doc, first[k])
                        size += len(k)
                        continue
                    place = (had[1] is None, had[1] or 0, had[2]), (doc is None, doc or 0, first[k])
                    held[k] = (had[0] + 1, *(had[1:] if place[0] <= place[1] else (doc, first[k])))
                if len(held) >= HELD or size >= 16 << 20:
                    yield rows(held)
                    held, size = {}, 0
        yield rows(held)

    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")
    counted = docs.select("doc_id", "text").mapInArrow(count, SUSPECTS).groupBy("key").agg(F.sum("docs").alias("docs"), F.min(place).alias("first"))
    return counted.where(F.col("docs") >= how.min_docs).select("key", "docs", F.struct("first.doc_id", "first.line").alias("first"))


def _kept(raw: bytes | None, drop: set[int]) -> bytes:
    return b"\n".join(line for at, line in enumerate((raw or b"").split(b"\n")) if at not in drop)


def _applied(docs: DataFrame, drops: Callable[[pa.RecordBatch], Iterator[tuple[int, set[int]]]], columns: list[str], schema: str) -> DataFrame:
    """docs, whose first columns are those named and the text, as those with n_lines, n_dropped and kept."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, gone, kept = [], [], []
            for raw, (n, drop) in zip(_texts(batch.column(len(columns))), drops(batch), strict=True):
                lines.append(n)
                gone.append(len(drop))
                kept.append((_kept(raw, drop) if drop else raw or b"").decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "n_lines", "n_dropped", "kept"])

    return docs.mapInArrow(run, schema)


def _dropped(rows: DataFrame, docs: DataFrame, how: Lines) -> DataFrame:
    """rows (row, doc_id, text) as row, n_lines, n_dropped, kept."""
    confirmed = stored(repeated(docs, how))
    size = confirmed.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    if size <= how.broadcast_bytes:
        table = docs.sparkSession.sparkContext.broadcast({bytes(r["key"]): (r["first"]["doc_id"], r["first"]["line"]) for r in confirmed.toLocalIterator()})

        def drops(batch: pa.RecordBatch) -> Iterator[tuple[int, set[int]]]:
            known = table.value
            for doc, raw in zip(batch.column(2).to_pylist(), _texts(batch.column(1)), strict=True):
                found = keys(raw, how)
                gone = {at for at, k in enumerate(found) if k and k in known}
                yield len(found), {at for at in gone if known[found[at]] != (doc, at)} if how.keep_first else gone

        return _applied(rows.select("row", "text", "doc_id"), drops, ["row"], schema)

    @giving_back
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, digest, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
                at: dict[bytes, list[int]] = {}
                for line, k in enumerate(keys(raw, how)):
                    if k:
                        at.setdefault(k, []).append(line)
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(at), pa.int64()), pa.array([digest] * len(at)), pa.array(list(at), pa.binary()), pa.array(list(at.values()), pa.list_(pa.int32()))], names=["doc_id", "digest", "key", "lines"])

    # a text and an id decide what is lost: equal rows come together here
    lines = docs.select("doc_id", F.md5("text").alias("digest"), "text").mapInArrow(occurrences, "doc_id long, digest string, key binary, lines array<int>")
    hit = lines.join(confirmed, "key").select("doc_id", "digest", F.explode("lines").alias("line"), F.col("first").alias("f"))
    if how.keep_first:
        hit = hit.where(~(F.col("f.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("f.line") == F.col("line"))))
    lost = hit.groupBy("doc_id", "digest").agg(F.collect_set("line").alias("lost")).select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest"), "lost")
    both = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.md5("text").eqNullSafe(F.col("__digest")), "left")

    def told(batch: pa.RecordBatch) -> Iterator[tuple[int, set[int]]]:
        for raw, lines in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            yield (raw or b"").count(b"\n") + 1, set(lines or ())

    return _applied(both.select("row", "text", "lost"), told, ["row"], schema)


def dropped(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept (the lines that stay, joined by newlines) of each document."""
    narrow = docs.select("doc_id", "text")
    found = _dropped(narrow.select(F.struct("doc_id").alias("row"), "doc_id", "text"), narrow, how)
    return found.select("row.doc_id", "n_lines", "n_dropped", "kept")


def cleaned(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """docs with what stays of each text; a null text stays null."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = _dropped(docs.select(row, F.col("doc_id"), F.col("text")), docs.select("doc_id", "text"), how)
    kept = F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text")
    return found.select(*[kept if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
