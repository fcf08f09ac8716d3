"""Count tables of fixed size, filled by tasks and summed by Spark.

A task sends the parts of its table that hold anything; parts are summed in two steps, each over a bounded share of the
tasks' parts. Only the sum, whose size is a parameter and not the input's, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Counters of a part, and groups of tasks in the first step.
PART, SALTS = 1 << 16, 16
PARTS = "part int, salt int, counts binary"


def sent(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table as rows of PARTS. Its length is a multiple of PART."""
    salt = TaskContext.get().partitionId() % SALTS
    cut = table.reshape(-1, PART)
    for number in np.flatnonzero(cut.any(axis=1)).tolist():
        arrays = [pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([cut[number].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "salt", "counts"])


def summed(parts: DataFrame, size: int, kind: str, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The sum of all tasks' tables of `size` counters of numpy's type `kind`, as unsigned 64-bit numbers.

    finish turns each part of the sum into what the driver gets, so that a smaller type costs it less.
    """
    done = np.zeros(0, np.uint64) if finish is None else finish(np.zeros(0, np.uint64))

    def adder(kind: str, finish: Callable[[np.ndarray], np.ndarray] | None):
        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(PART, np.uint64)
            for batch in batches:
                for part in batch.column("counts"):
                    total += np.frombuffer(part.as_py(), kind)
            raw = (total if finish is None else finish(total)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([raw], pa.binary())], names=["part", "counts"])

        return add

    first = parts.groupBy("part", "salt").applyInArrow(adder(kind, None), "part int, counts binary")
    out = np.zeros(size, done.dtype)
    for r in first.groupBy("part").applyInArrow(adder("<u8", finish), "part int, counts binary").toLocalIterator():
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], done.dtype)
    return out
