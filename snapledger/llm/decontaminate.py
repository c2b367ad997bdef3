"""Benchmark decontamination by greedy string tiling.

A document is tiled against a benchmark item if they share seeds (runs of MIN_MATCH tokens) that could cover enough of
the item. Tiling then marks the longest common runs first, each token at most once, found by running Karp-Rabin over
ever shorter run lengths; so passages whose parts stand in another order are caught as well. An item counts as leaked
if the tiles cover the given share of its tokens.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import full_text, stored, table

#: Tokens of the shortest tile, and share of an item's tokens that tiles must cover.
MIN_MATCH, COVERAGE = 5, 0.5
#: Bytes of benchmark text that are sent to the executors at a time.
SHARD_BYTES = 8 << 20

_WORD = re.compile(r"\w+")
_BASE = 0x100000001B3
_WRAP = (1 << 64) - 1


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rolling_hashes(ids: list[int], size: int) -> list[int]:
    """Karp-Rabin hashes of all runs of `size` ids."""
    if len(ids) < size:
        return []
    value, top = 0, pow(_BASE, size - 1, 1 << 64)
    for x in ids[:size]:
        value = (value * _BASE + x) & _WRAP
    out = [value]
    for gone, new in zip(ids, ids[size:], strict=False):
        value = ((value - gone * top) * _BASE + new) & _WRAP
        out.append(value)
    return out


def _free_windows(used: np.ndarray, size: int) -> list[int]:
    """Starts of the runs of `size` tokens of which none is used."""
    taken = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(taken[size:] == taken[: len(taken) - size]).tolist() if len(used) >= size else []


def _free_runs(busy: np.ndarray) -> Iterator[tuple[int, int]]:
    """(offset, length) of the stretches that are not busy."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], busy, [True]])))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield start, end - start


def _before(ids: list[int], used: list[bool], k: int) -> int | None:
    """The token in front of place k, None if there is none that a run could start with."""
    return None if k == 0 or used[k - 1] else ids[k - 1]


def greedy_tiles(item: list[int], doc: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length), longest first; of equal lengths the first in item, then in doc.

    Negative ids match nothing, so they separate stretches of a document. Places with equal hashes are kept by the token in front of
    them: a pair whose tokens in front are equal is part of a run that starts earlier and is never looked at, so that a token
    that repeats costs a pair for each place of the document, not for each pair of places.
    """
    a, b = np.array(item, np.int64), np.array(doc, np.int64)
    used_a, used_b = np.zeros(len(a), bool), b < 0

    def run(i: int, j: int) -> int:
        """Length of the unused common run from i and j."""
        n, step, most = 0, 32, min(len(a) - i, len(b) - j)
        while n < most:
            end = min(n + step, most)
            x, y = slice(i + n, i + end), slice(j + n, j + end)
            other = (a[x] != b[y]) | used_a[x] | used_b[y]
            if other.any():
                return n + int(other.argmax())
            n, step = end, 4 * step
        return n

    tiles: list[tuple[int, int, int]] = []
    size = max(len(item), min_match)
    while size >= min_match:
        found: list[tuple[int, int, int]] = []
        if (mine := _free_windows(used_a, size)) and (theirs := _free_windows(used_b, size)):
            where: dict[int, dict[int | None, list[int]]] = defaultdict(lambda: defaultdict(list))
            wanted, hashes, used = rolling_hashes(item, size), rolling_hashes(doc, size), used_b.tolist()
            either = set(wanted)
            for j in theirs:
                if hashes[j] in either:
                    where[hashes[j]][_before(doc, used, j)].append(j)
            used = used_a.tolist()
            for i in mine if where else ():
                front = _before(item, used, i)
                for other, places in where[wanted[i]].items() if wanted[i] in where else ():
                    if front is None or other != front:
                        found += [(-n, i, j) for j in places if (n := run(i, j)) >= size]
            heapq.heapify(found)
        while found:
            n, i, j = heapq.heappop(found)
            n = -n
            busy = used_a[i : i + n] | used_b[j : j + n]
            if not busy.any():
                tiles.append((i, j, n))
                used_a[i : i + n] = used_b[j : j + n] = True
            else:
                for at, m in _free_runs(busy):
                    if m >= size:
                        heapq.heappush(found, (-m, i + at, j + at))
        if size == min_match:
            break
        size = max(size // 2, min_match)
    return tiles


@dataclass
class Benchmark:
    """Items as one row of ids, and their seeds by hash."""

    names: list
    vocabulary: dict[str, int]
    ids: np.ndarray
    starts: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    min_match: int

    @classmethod
    def of(cls, rows: list[tuple], min_match: int) -> Benchmark | None:
        """rows: (name, text). Items without a token are left out; one shorter than min_match is a seed as a whole."""
        vocabulary: dict[str, int] = {}
        names, ids, starts = [], [], [0]
        for name, text in rows:
            if words := tokens(text or ""):
                names.append(name)
                ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
                starts.append(len(ids))
        by_size = defaultdict(lambda: defaultdict(list))
        for a, b in zip(starts, starts[1:], strict=False):
            size = min(min_match, b - a)
            for k, h in enumerate(rolling_hashes(ids[a:b], size)):
                by_size[size][h].append(a + k)
        seeds = {}
        for size, found in by_size.items():
            keys = np.array(sorted(found), np.uint64)
            lists = [found[int(k)] for k in keys]
            seeds[size] = (keys, np.r_[0, np.cumsum([len(x) for x in lists])], np.concatenate(lists))
        return cls(names, vocabulary, np.array(ids), np.array(starts), seeds, min_match) if names else None

    def shared(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(seed length, positions in the document, number of the seed there) of all seeds that the document shares."""
        known = ids > 0
        for size, (keys, _, _) in self.seeds.items():
            if len(ids) < size:
                continue
            whole = np.convolve(known, np.ones(size, np.int64), "valid") == size if size > 1 else known
            at = np.flatnonzero(whole)
            value = np.zeros(len(at), np.uint64)
            for k in range(size):
                value = value * np.uint64(_BASE) + ids[at + k].astype(np.uint64)
            k = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            hit = keys[k] == value
            if hit.any():
                yield size, at[hit], k[hit]

    def leaks(self, text: str, coverage: float) -> Iterator[tuple]:
        """(item, its tokens, covered tokens, tiles, longest tile) of the items that a text leaks.

        Each distinct seed is followed to the items once, however often the document repeats it; an item is tiled only if
        its seeds in the document cover enough of it, as no tiling can cover more.
        """
        ids = np.array([self.vocabulary.get(w, 0) for w in tokens(text)], np.int64)
        for size, in_doc, seed in self.shared(ids):
            _, first, place = self.seeds[size]
            found = np.unique(seed)
            n = first[found + 1] - first[found]
            there = place[np.repeat(first[found] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            order = np.argsort(there)
            there, by = there[order], np.repeat(found, n)[order]
            item = np.searchsorted(self.starts, there, "right") - 1
            begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            step = np.minimum(np.append(there[1:], there[-1] + size) - there, size)
            last = np.append(begin[1:], len(there)) - 1
            step[last] = size
            reach = np.add.reduceat(step, begin)
            tokens_of = self.starts[item[begin] + 1] - self.starts[item[begin]]
            for g in np.flatnonzero(reach >= coverage * tokens_of - 1e-9):
                k, a, b = item[begin[g]], int(self.starts[item[begin[g]]]), int(self.starts[item[begin[g]] + 1])
                part = stretches(ids, in_doc[np.isin(seed, by[begin[g] : last[g] + 1])], size)
                tiles = greedy_tiles(self.ids[a:b].tolist(), part, min(self.min_match, b - a))
                covered = sum(n for *_, n in tiles)
                if covered >= coverage * (b - a) - 1e-9:
                    yield self.names[k], b - a, covered, len(tiles), max(n for *_, n in tiles)


def stretches(ids: np.ndarray, seeds: np.ndarray, size: int) -> list[int]:
    """The ids that seeds (sorted positions) cover, with -1 between stretches that do not meet."""
    inside = np.zeros(len(ids) + 1, np.int64)
    np.add.at(inside, seeds, 1)
    np.add.at(inside, seeds + size, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    gap = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(ids[at], gap, -1).tolist()


def benchmark_shards(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, shard_bytes: int = SHARD_BYTES) -> Iterator[Broadcast]:
    """The benchmark, broadcast in parts of about shard_bytes of text; a larger one takes more passes over the documents.

    Driver and executors hold one part at a time if the caller destroys each when its pass is over.
    """
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // shard_bytes))
    for k in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).orderBy("id", "text").collect()
        if (b := Benchmark.of([(r["id"], r["text"]) for r in mine], min_match)) is not None:
            yield benchmark.sparkSession.sparkContext.broadcast(b)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    min_match: int = MIN_MATCH, coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and item that it leaks: id_col, item_col, item_tokens, covered_tokens, coverage, tiles, longest_tile.

    Null and empty texts and items without a word leak nothing; an item of fewer than min_match tokens leaks if it
    occurs as a whole. Rows of docs or of the benchmark that repeat give repeated rows. A text of any length is tiled whole.
    Empty tables give an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col), full_text(text_col).alias("_text"))
    schema = docs.select(
        id_col,
        F.lit(None).cast(benchmark.schema[item_col].dataType).alias(item_col),
        *(F.lit(None).cast("int").alias(c) for c in ("item_tokens", "covered_tokens", "tiles", "longest_tile")),
    ).schema

    item_type = _arrow(benchmark, item_col)
    names = schema.names

    def against(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                found = [(i, *x) for i, text in enumerate(batch.column(1)) for x in b.leaks(text.as_py(), coverage)]
                columns = list(zip(*found, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(columns[0], pa.int64())),
                        pa.array(columns[1], item_type),
                        *(pa.array(columns[k], pa.int32()) for k in (2, 3, 4, 5)),
                    ],
                    names,
                )

        return run

    found = docs.sparkSession.createDataFrame([], schema)
    for shared in benchmark_shards(benchmark, item_col, text_col, min_match):
        found = found.unionByName(stored(rows.mapInArrow(against(shared), schema), "leaks"))
        shared.destroy()
    return found.select(
        id_col, item_col, "item_tokens", "covered_tokens", (F.col("covered_tokens") / F.col("item_tokens")).alias("coverage"), "tiles", "longest_tile"
    )


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE
) -> DataFrame:
    """The rows of docs that leak no item; their columns stay as they are."""

    def clean_of(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                clean = [not any(True for _ in b.leaks(text.as_py() or "", coverage)) for text in batch.column(text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    before = None
    for shared in benchmark_shards(benchmark, item_col, text_col, min_match):
        if before is not None:
            docs = stored(docs, "clean")
            before.destroy()
        docs, before = docs.mapInArrow(clean_of(shared), docs.schema), shared
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
