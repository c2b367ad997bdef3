"""What the operators on vectors share: exact integer components, and sums over all rows under a fixed number of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest squared length of a vector in integers: the squared distance of any two, and of a vector and a mean, is a long.
LIMIT = float(1 << 60)
#: Integers up to this size have exact products and sums of 64 terms as doubles.
EXACT = 1 << 22

SUMS = "slot bigint, value bigint"


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as array<int>.

    Null where the vector is null, holds null or a value that is not finite, or is so long (squared length over LIMIT) that
    distances to it are no longs.
    """
    whole = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(float(scale)))
    length = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x)
    # null where a component is null, NaN (which is larger than any number) where one is
    return F.when(F.coalesce(length <= F.lit(LIMIT), F.lit(False)), F.transform(whole, lambda x: F.floor(x).cast("int")))


def matrix(packed: pa.Array, width: int, dtype=np.int64) -> np.ndarray:
    """Rows of `width` integers from a column of equally long lists of them."""
    flat = packed.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(packed), width)


def sums_batch(values: np.ndarray) -> pa.RecordBatch:
    """One row per slot that is not zero."""
    slot = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(values[slot], pa.int64())], ["slot", "value"])


def totals(parts: DataFrame, slots: int) -> list[int]:
    """Exact sums of rows (slot, value) by slot. Tasks send a row per slot at most; the driver gets one per slot."""
    found = parts.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("decimal(38,0)").alias("value")).collect()
    out = [0] * slots
    for r in found:
        out[r["slot"]] = int(r["value"])
    return out


def blocks(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)
