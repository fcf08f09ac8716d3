"""Order-preserving packing of token streams into sequences by dynamic programming.

Documents are tokenised in order, each followed by an end id, into one stream for each input partition. A sequence is a
window of the stream. Windows may end at document ends, at sentence ends (a token that ends with a full stop, a question
or exclamation mark or a line end) and, in stretches without either, at every STEP-th token; a run of 2, 4 or 8 windows
may be cut anywhere within, where sentences are so long that ending at one would cost more. The cuts minimise padding plus
penalties, in tokens: SENTENCE_CUT at a sentence end, INNER_CUT within one. With c the position and f the cost of a cut,

    f(i) = penalty(i) - c(i) + min over m in RUNS of m * length + (m - 1) * INNER_CUT + min f(j) + c(j)
           over the j with c(i) - m * length <= c(j) < c(i) - (m - 1) * length

so that one monotone queue of f + c for each m gives a cut its best predecessor in constant time on average.

The stream is solved in chunks of CHUNK tokens; the last windows of a chunk are solved again with the next. What remains at
a partition's end is cut into powers of two, which need no padding, where a padded window would waste more than
TAIL_PADDING. Nothing is shuffled and a task holds one chunk and its longest document.

Defined results: null text is empty, and an empty text is its end id alone; a null doc_id stays null; repeated rows are
packed as often as they come; sequences never span input partitions. Very long texts are cut over as many sequences as
they fill. An empty table gives an empty result. Other columns, of whatever name, aren't read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import giving_back

LENGTH, END_ID = 1024, 0
SENTENCE_CUT, INNER_CUT, STEP, RUNS = 1, 64, 64, (1, 2, 4, 8)
CHUNK, TAIL_PADDING = 1 << 18, 16
#: One sequence id: the partition's number above, the sequence's number in it below.
PARTITION_BITS = 36


@lru_cache(maxsize=1)
def sentence_ends() -> np.ndarray:
    """For each id whether its token ends a sentence: with a full stop, a question or exclamation mark or a line end."""
    words = tokens.fast_library()
    return np.array([words.decode_single_token_bytes(i)[-1:] in b".!?\n" for i in range(words.n_vocab)])


@dataclass(frozen=True)
class Packing:
    length: int = LENGTH
    end_id: int = END_ID
    sentence_cut: int = SENTENCE_CUT
    inner_cut: int = INNER_CUT
    step: int = STEP
    runs: tuple[int, ...] = RUNS
    chunk: int = CHUNK
    tail_padding: int = TAIL_PADDING


def candidates(ids: np.ndarray, doc_ends: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """(positions where a window may end, with 0 and the stream's end; their penalties)."""
    ends = sentence_ends()
    after = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    places = np.unique(np.concatenate([[0], after, doc_ends]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > how.length // 4)
    if len(wide):
        places = np.unique(np.concatenate([places, *[np.arange(places[i] + how.step, places[i + 1], how.step) for i in wide]]))
    penalty = np.full(len(places), how.inner_cut, np.int64)
    penalty[np.searchsorted(places, after)] = how.sentence_cut
    penalty[np.searchsorted(places, doc_ends)] = 0
    penalty[0] = 0
    return places, penalty


def cuts(places: np.ndarray, penalty: np.ndarray, how: Packing) -> list[int]:
    """Ends of the windows of a least-cost packing; the last is the stream's end."""
    length, n = how.length, len(places)
    c, add = places.tolist(), penalty.tolist()
    key, came = [0] * n, [(0, 1)] * n  # key: f + c
    # for each m: its queue, the first candidate not yet in it, its reach and its cost
    queues = [(m, deque(), [0], (m - 1) * length, m * length, m * length + (m - 1) * how.inner_cut) for m in how.runs]
    for i in range(1, n):
        at, best, source = c[i], None, (0, 1)
        for m, queue, entered, nearest, farthest, cost in queues:
            k, low, high = entered[0], at - farthest, at - nearest
            while k < i and (c[k] < high or m == 1):
                value = key[k]
                while queue and key[queue[-1]] >= value:
                    queue.pop()
                queue.append(k)
                k += 1
            entered[0] = k
            while queue and c[queue[0]] < low:
                queue.popleft()
            if queue and (best is None or key[queue[0]] + cost < best):
                best, source = key[queue[0]] + cost, (queue[0], m)
        key[i], came[i] = best + add[i], source
    out, i = [], n - 1
    while i > 0:
        j, m = came[i]
        out.append(c[i])
        out.extend(c[j] + length * k for k in range(m - 1, 0, -1))
        i = j
    return out[::-1]


def tail(start: int, end: int, how: Packing) -> list[int]:
    """Ends of the windows that a partition's last one is cut into."""
    rest = end - start
    if rest == 0 or how.length - rest <= how.tail_padding:
        return [end] if rest else []
    out = []
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            start += 1 << bit
            out.append(start)
    return out


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, cut string"


class _Stream:
    """One partition's stream, from the first token not yet packed."""

    def __init__(self, partition: int, how: Packing) -> None:
        self.how, self.sequence = how, partition << PARTITION_BITS
        self.docs: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start of the part held, the part, tokens of the whole
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch | None:
        how = self.how
        if not self.docs:
            return None
        ids = np.concatenate([d[2] for d in self.docs])
        doc_ends = np.cumsum([len(d[2]) for d in self.docs])
        ends = cuts(*candidates(ids, doc_ends, how), how)
        if last:
            begin = ends[-2] if len(ends) > 1 else 0
            ends = ends[:-1] + tail(begin, ends[-1], how)
        else:
            ends = [e for e in ends if e <= len(ids) - 2 * max(how.runs) * how.length]
        if not ends:
            return None
        windows = np.array([0, *ends])
        done = int(windows[-1])
        edges = np.unique(np.concatenate([windows, [0], doc_ends[doc_ends < done]]))
        begins, stops = edges[:-1], edges[1:]
        doc = np.searchsorted(doc_ends, begins, "right")
        window = np.searchsorted(windows, begins, "right") - 1
        doc_begins = doc_ends - np.array([len(d[2]) for d in self.docs])
        held_from = np.array([d[1] for d in self.docs])
        raw = ids.astype("<u4").tobytes()
        at_end = sentence_ends()[np.minimum(ids[stops - 1], len(sentence_ends()) - 1)]
        cut = np.where(np.isin(stops, doc_ends), "document", np.where(at_end, "sentence", "inner"))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[k][0] for k in doc.tolist()], pa.int64()),
                pa.array(begins - doc_begins[doc] + held_from[doc]),
                pa.array(stops - begins),
                pa.array([self.docs[k][3] for k in doc.tolist()], pa.int64()),
                pa.array(window + self.sequence),
                pa.array(begins - windows[window]),
                pa.array([raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)], pa.binary()),
                pa.array(cut.tolist(), pa.string()),
            ],
            names=[c.split()[0] for c in PIECES.split(", ")],
        )
        self.sequence += len(ends)
        kept = []
        for k in range(int(np.searchsorted(doc_ends, done, "right")), len(self.docs)):
            doc_id, start, part, whole = self.docs[k]
            gone = max(0, done - int(doc_begins[k]))
            kept.append((doc_id, start + gone, part[gone:], whole))
        self.docs, self.held = kept, len(ids) - done
        return out


def packed(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """The pieces of all documents' token streams: doc_id, start, length, doc_tokens, sequence_id, offset, ids, cut.

    ids are little-endian unsigned 32-bit numbers; cut tells where a piece ends: with its document, a sentence, or inside. A sequence's pieces follow one another from offset 0 without a gap.
    """

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(TaskContext.get().partitionId(), how)
        end = np.array([how.end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                stream.add(doc_id.as_py(), np.concatenate([tokens.encode(text.as_py() or ""), end]))
                if stream.held >= how.chunk and (out := stream.pack(last=False)) is not None:
                    yield out
        if (out := stream.pack(last=True)) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
