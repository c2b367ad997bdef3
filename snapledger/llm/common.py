"""What the operators of this package share: scratch tables, column guards, small column helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.scratch import discard, remove, scratch_path, stored

__all__ = ["RELEASES", "SPACES", "discard", "full_text", "in_training", "remove", "scratch_path", "stored", "table", "trim", "worker_of"]

#: ASCII white space, as the contracts of several operators define it.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def full_text(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def in_training(doc_id: str | Column, folds: int = 3, held_out: int = 1) -> Column:
    """Whether a row may be learnt from: crc32 of the id as text, mod folds, is not the held-out remainder.

    A null id has no checksum and counts as held out.
    """
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds != held_out, F.lit(False))


#: What a Python worker keeps between the tasks of one operator is dropped by these functions.
RELEASES: list[Callable[[], None]] = []
_worker = {"of": ""}


def trim() -> None:
    """Hand memory that this process no longer uses back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def worker_of(operator: str) -> None:
    """Tasks call this before they work: what another operator's tasks have left in a worker that is used again is dropped."""
    if _worker["of"] not in ("", operator):
        for release in RELEASES:
            release()
        trim()
    _worker["of"] = operator
