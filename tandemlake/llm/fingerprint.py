"""Document fingerprints from prefix polynomial hashes.

A text's modular prefix arrays, P[i] = sum of c[j] * BASE^j over j < i, answer the hash of any span in constant time, and
with it whether two spans are equal; binary search over span equality finds the longest common extension of two
positions, forward or backward. A fingerprint reads the hash of every window of the text off the prefix arrays and keeps
the least hash in each of SLOTS classes; the share of common windows of two texts is estimated from how many slots of their
fingerprints agree. Windows have one width for texts of any length: a text is set between signs that no text has, so that
its ends make windows of their own and one letter has WINDOW of them.
Where slots agree, the windows behind them are anchors: their longest common extensions are spans that both texts hold,
and the share of both texts that such spans cover is reported beside the estimate.

Two moduli of 31 bits make one 62-bit hash, so that products stay in 64 bits.

The edited text of `edited` needs the next document's text. Documents are dealt to ranges of doc_id and, within one id, of
the text's first bytes; the first document of each range goes to the range before it as well, and each range is sorted and
read as a stream by a task of its own; text moves once. Ranges are about RANGE_ROWS documents, and MOST_RANGES at most, so
that what the driver holds, some 32 bytes for each, is bounded; larger ranges are sorted by Spark, on disk where needed.

Defined results: null text is empty, and an empty text's slots are all empty; two empty texts are alike (1), an empty and
another text are not (0). Null ids come first; rows with equal ids are
ordered by text. With one row, the next document is the row itself. A very long text is held whole, with its prefix
arrays, by one task. An empty table gives an empty result. Other columns, of whatever name, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Primes below 2^31 and bases.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Slots of a fingerprint, code points of a window, and the sign at a text's ends.
SLOTS, WINDOW, END = 64, 7, 0x110000
#: Documents of a range, about, the most ranges, and drawn keys that place a range's bounds.
RANGE_ROWS, MOST_RANGES, DRAWN = 8_000, 16_384, 64
_NULL = -(2**63)
_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo the prime."""
    kept = _tables.get((which, 0))
    if kept is None or len(kept[0]) < n:
        p, size = MODULI[which], 1 << max(16, int(n - 1).bit_length())
        made = []
        for base in (BASES[which], pow(BASES[which], -1, p)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), p)) % np.uint64(p)])
            made.append(table)
        kept = _tables[(which, 0)] = (made[0], made[1])
    return kept


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str | np.ndarray) -> None:
        points = code_points(text) if isinstance(text, str) else text
        self.length = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.prefix = []
        for which, p in enumerate(MODULI):
            power, _ = _powers(which, self.length + 1)
            total = np.zeros(self.length + 1, np.uint64)
            # below 2^31 each: their sum stays below 2^64 for any text that fits in memory
            np.cumsum(values * power[: self.length] % np.uint64(p), out=total[1:])
            self.prefix.append(total)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of text[start:end], the same wherever an equal span stands."""
        out = np.zeros(len(starts), np.uint64)
        for which, p in enumerate(MODULI):
            _, unpower = _powers(which, self.length + 1)
            part = (self.prefix[which][ends] - self.prefix[which][starts]) % np.uint64(p) * unpower[starts] % np.uint64(p)
            out = (out << np.uint64(31)) | part
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of the width, in order."""
        n = self.length - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for which, p in enumerate(MODULI):
            _, unpower = _powers(which, self.length + 1)
            total = self.prefix[which]
            part = (total[width:] - total[:n]) % np.uint64(p) * unpower[:n] % np.uint64(p)
            out = (out << np.uint64(31)) | part
        return out

    def span(self, start: int, end: int) -> int:
        out = 0
        for which, p in enumerate(MODULI):
            total = self.prefix[which]
            out = out << 31 | (int(total[end]) - int(total[start])) % p * int(_powers(which, self.length + 1)[1][start]) % p
        return out

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        if start + length > self.length or other_start + length > other.length:
            return False
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def longest_common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common prefix of text[start:] and other[other_start:]."""
        low, high = 0, min(self.length - start, other.length - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, other_start, middle) else (low, middle - 1)
        return low

    def longest_common_backward(self, end: int, other: PrefixHash, other_end: int) -> int:
        """Length of the longest common suffix of text[:end] and other[:other_end]."""
        low, high = 0, min(end, other_end)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(end - middle, other, other_end - middle, middle) else (low, middle - 1)
        return low


class Print:
    """A text between signs, with its prefix arrays and its sketch: the least window hash in each slot as 32 bits, 0 for an
    empty slot, and where it stands. An empty text has no windows."""

    def __init__(self, points: np.ndarray, slots: int = SLOTS, window: int = WINDOW) -> None:
        self.points, self.width = points, window
        ends = np.full(window - 1, END, np.uint32)
        self.hash = PrefixHash(np.concatenate([ends, points, ends]))
        self.sketch, self.places = np.zeros(slots, np.uint32), np.zeros(slots, np.int64)
        if not len(points):
            return
        hashes = mix(self.hash.windows(window) + np.uint64(window))
        slot = ((hashes >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
        low = np.maximum(hashes & np.uint64(0xFFFFFFFF), np.uint64(1))
        # the least hash of a slot, and the first place of it: places below 2^31, as texts are
        least = np.full(slots, 1 << 63, np.uint64)
        np.minimum.at(least, slot, low << np.uint64(31) | np.arange(len(low), dtype=np.uint64))
        seen = least < np.uint64(1 << 63)
        self.sketch[seen] = (least[seen] >> np.uint64(31)).astype(np.uint32)
        self.places[seen] = (least[seen] & np.uint64((1 << 31) - 1)).astype(np.int64)

    def within(self, start: int, end: int) -> tuple[int, int]:
        """A span of the text between signs as one of the text."""
        pad, n = self.width - 1, len(self.points)
        return min(max(start - pad, 0), n), min(max(end - pad, 0), n)


def as_text(kept: np.ndarray) -> str:
    """A fingerprint as 8 hexadecimal digits for each slot."""
    return kept.astype(">u4").tobytes().hex()


def of_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the estimated share of windows that two texts have in common, twice the common ones by those of both."""
    used = (a > 0) | (b > 0)
    if not used.any():
        return 1.0
    same = float(((a == b) & used).sum()) / float(used.sum())
    return 2 * same / (1 + same)


def alike(a: Print, b: Print) -> float:
    """The likeness of two texts' fingerprints."""
    return likeness(a.sketch, b.sketch)


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reached = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


def shared(a: Print, b: Print) -> float:
    """0 to 1: the share of both texts in the longest common spans around the windows that agree in their sketches."""
    if len(a.points) == 0 or len(b.points) == 0:
        return float(len(a.points) == len(b.points))
    width = a.width
    agree = np.flatnonzero((a.sketch == b.sketch) & (a.sketch > 0))
    mine, others, reach = [], [], {}
    for i, j in sorted(zip(a.places[agree].tolist(), b.places[agree].tolist(), strict=True)):
        if reach.get(i - j, 0) >= i + width:
            continue  # within a span that is known
        before = a.hash.longest_common_backward(i, b.hash, j)
        after = a.hash.longest_common_extension(i, b.hash, j)
        if before + after >= width:
            mine.append(a.within(i - before, i + after)), others.append(b.within(j - before, j + after))
            reach[i - j] = i + after
    return (_covered(mine) + _covered(others)) / (len(a.points) + len(b.points))


def _keys(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ids and the begins of texts as 16 bytes each that sort as the two do."""
    out = np.empty((len(ids), 2), ">u8")
    out[:, 0] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = begins.astype(np.uint64)
    return out.view("S16").reshape(-1)


def _key_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, id (null as the least), begin: the first seven bytes of the text as a number."""
    begin = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.coalesce("doc_id", F.lit(_NULL)).alias("id"), begin.alias("begin"))


def ranges(keyed: DataFrame, rows: int = RANGE_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner bounds of about equal ranges, the numbers of the ranges that hold rows, their least keys).

    Bounds come from keys drawn by their hash, with the rows of each; a few keys for each range reach the driver.
    """
    n = keyed.count()
    parts = min(MOST_RANGES, max(1, -(-n // rows)))
    bounds = np.zeros(0, "S16")
    if parts > 1:
        draw = F.pmod(F.xxhash64("id", "begin"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, DRAWN * parts / n))
        drawn = keyed.where(draw).groupBy("id", "begin").agg(F.count("*").alias("n")).orderBy("id", "begin").collect()
        weights = np.cumsum([r["n"] for r in drawn])
        if len(drawn):
            at = np.searchsorted(weights, weights[-1] * np.arange(1, parts) / parts)
            bounds = np.unique(_keys(np.array([drawn[i]["id"] for i in at.tolist()]), np.array([drawn[i]["begin"] for i in at.tolist()])))
    shared = keyed.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, begins in batches:
            yield pa.array(np.searchsorted(shared.value, _keys(ids.to_numpy(), begins.to_numpy()), "right").astype(np.int32))

    found = keyed.select("id", "begin").groupBy(place("id", "begin").alias("range")).agg(F.min(F.struct("id", "begin")).alias("least")).orderBy("range").collect()
    return bounds, np.array([r["range"] for r in found], np.int64), _keys(np.array([r["least"]["id"] for r in found], np.int64), np.array([r["least"]["begin"] for r in found], np.int64))


def with_next(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """range, after, doc_id, text: each range of documents sorted, then the document that follows it (after = 1)."""
    keyed = _key_columns(docs)
    bounds, held, least = ranges(keyed, rows)
    shared = docs.sparkSession.sparkContext.broadcast((bounds, held, least))

    @F.arrow_udf("array<struct<range: int, after: int>>")
    def dealt(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bounds, held, least = shared.value
        for ids, begins in batches:
            keys = _keys(ids.to_numpy(), begins.to_numpy())
            at = np.searchsorted(held, np.searchsorted(bounds, keys, "right"))
            first = least[at] == keys
            lengths = 1 + first
            ends = np.cumsum(lengths)
            place, after = np.zeros(ends[-1], np.int32), np.zeros(ends[-1], np.int32)
            place[ends - lengths] = at
            # the first range's first document follows the last range
            place[ends[first] - 1], after[ends[first] - 1] = (at[first] - 1) % len(held), 1
            rows = pa.StructArray.from_arrays([pa.array(place), pa.array(after)], names=["range", "after"])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), rows)

    moved = keyed.select(F.explode(dealt("id", "begin")).alias("at"), "doc_id", "text").select("at.range", "at.after", "doc_id", "text")
    return moved.repartitionById(max(1, len(held)), F.col("range")).sortWithinPartitions("range", "after", F.col("doc_id").asc_nulls_first(), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_edited double, shared_next double"
#: Rows that are handed on at once.
BATCH = 500


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `with_next` in order: each document is compared with the one that follows it in its range."""
    held, made = None, []
    for batch in batches:
        for place, after, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if after and (held is None or held[0] != place):
                continue  # of the documents that follow a range only the first counts
            own = Print(code_points(text.as_py()))
            if held is not None and held[0] == place:
                made.append(_compare(*held[1:], own))
            held = None if after else (place, doc_id, own)
            if len(made) >= BATCH:
                yield _batch(made)
                made = []
    yield _batch(made)


def _batch(made: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _compare(doc_id: int | None, own: Print, following: Print) -> tuple:
    cut = len(own.points) // 2
    changed = np.concatenate([own.points[: len(own.points) - cut], following.points[:cut]])
    digest = hashlib.sha256(changed.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    after = Print(changed)
    return (
        doc_id, len(own.points), digest, as_text(own.sketch), as_text(after.sketch), alike(own, after), alike(own, following),
        shared(own, after), shared(own, following),
    )


def edited(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, one row for each row of docs."""
    return with_next(docs, rows).select("range", "after", "doc_id", "text").mapInArrow(_stream, RESULT)
