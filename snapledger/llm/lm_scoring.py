"""Stupid-backoff scores, joined from n-gram count tables that are partitioned by hash.

Documents stand in blocks of bounded size. A block's distinct n-grams are dealt out by the leading bits of their
64-bit hashes, a row for each block and partition; a partition's rows together are its count table, and the counts go
back to the blocks they were asked from, where they are joined to the n-grams and summed for each document. A frequent n-gram is
one entry of each block, so no partition grows with it.

A row is scored by the counts of all other rows: its own are taken off, so no text is evidence for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import full_text, stored, table

#: Words of the longest n-gram, and weight of a step back.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a block: at least, at most, and blocks that a corpus is dealt into between the two.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 8 << 20, 64 << 20, 10_000
CACHE = 400_000
LEVEL = 3

_MIX = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def _word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    if len(_known) > CACHE:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def ngram_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each word and lie in one document, and whether there is one.

    words: word hashes of all documents in a row; starts: for each word, where its document begins.
    """
    value = words.copy()
    at = np.arange(len(words))
    whole = at - starts >= n - 1
    for k in range(1, n):
        value[k:] = (value[k:] * _MIX) ^ (words[:-k] + np.uint64(k) * _MIX + (value[k:] >> np.uint64(31)))
    value ^= value >> np.uint64(32)
    return value * _MIX + np.uint64(n), whole


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed: planes that are zero or small take next to nothing."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _deltas(values: np.ndarray) -> np.ndarray:
    """Sorted numbers as the first and the steps between them."""
    out = values.copy()
    out[1:] -= values[:-1]
    return out


def _each(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [unpacked(x.as_py()) for x in column]


class Block:
    """The words of a block's documents and their n-grams."""

    def __init__(self, texts: Iterator[bytes]):
        found = [_word_hashes(t) for t in texts]
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.words = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.starts = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct n-grams and their counts; which words end one."""
        value, whole = ngram_hashes(self.words, self.starts, n)
        return *np.unique(value[whole], return_counts=True), whole

    def elsewhere(self, n: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the occurrences of its n-gram in other documents, given those of the distinct n-grams; which words end one."""
        value, whole = ngram_hashes(self.words, self.starts, n)
        _, at = np.unique(value[whole], return_inverse=True)
        _, own, times = np.unique(self.starts[whole] * max(len(totals), 1) + at, return_inverse=True, return_counts=True)
        count = np.zeros(len(self.words), np.int64)
        count[whole] = totals[at] - times[own]
        return count, whole


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, the last column, compressed one by one for the shuffle."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for b in batches:
        small = [pack(x.as_py().encode("utf-8", "surrogatepass")) for x in b.column(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(small, pa.binary())], b.schema.names)


def _texts(t: pa.Table) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(x.as_py()) for x in t.column("text"))


def _ask(order: int, bits: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        block = Block(_texts(t))
        parts, orders, grams, counts = [], [], [], []
        for n in range(1, order + 1):
            value, count, _ = block.distinct(n)
            part = (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
            edges = np.searchsorted(part, np.arange((1 << bits) + 1))
            for p in np.flatnonzero(np.diff(edges)):
                a, b = edges[p], edges[p + 1]
                parts.append(int(p))
                orders.append(n)
                grams.append(packed(_deltas(value[a:b])))
                counts.append(packed(count[a:b]))
        return pa.table(
            {
                "block": pa.array([key[0].as_py()] * len(parts), pa.int64()), "part": pa.array(parts, pa.int64()), "n": pa.array(orders, pa.int32()),
                "grams": pa.array(grams, pa.binary()), "counts": pa.array(counts, pa.binary()),
            }
        )

    return run


def _count(t: pa.Table) -> pa.Table:
    """The counts over all blocks, in the places where each block asked for them."""
    grams = [np.cumsum(x, dtype=np.uint64) for x in _each(t.column("grams"))]
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, np.concatenate(_each(t.column("counts")))).astype(np.uint64)[at]
    totals = pa.array([packed(x) for x in np.split(total, np.cumsum([len(g) for g in grams])[:-1])], pa.binary())
    return pa.table({"block": t.column("block"), "part": t.column("part"), "n": t.column("n"), "totals": totals})


def _score(order: int, backoff: float):
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        block = Block(_texts(docs))
        size, n_words = len(block.sizes), len(block.words)
        logs, steps = np.zeros(n_words), np.zeros(n_words)
        open_ = np.ones(n_words, bool)
        by_n, by_part = (counts.column(c).to_numpy() for c in ("n", "part"))
        tables = []
        for n in range(1, order + 1):
            pick = np.flatnonzero(by_n == n)
            pick = pick[np.argsort(by_part[pick])]
            totals = [unpacked(counts.column("totals")[int(k)].as_py()) for k in pick]
            tables.append(block.elsewhere(n, np.concatenate([np.empty(0, np.uint64), *totals]).astype(np.int64)))
        for n in range(order, 1, -1):
            count, whole = tables[n - 1]
            use = open_ & whole & (count > 0)
            before = np.roll(tables[n - 2][0], 1)
            logs[use] += np.log(count[use]) - np.log(before[use])
            steps[open_ & whole & ~use] += 1
            open_ &= ~use
        logs[open_] += np.log(np.maximum(tables[0][0][open_], 1))
        doc = np.repeat(np.arange(size), block.sizes)
        value = np.bincount(doc, logs + steps * np.log(backoff), size).astype(np.float64)
        return pa.table(
            {
                "_id": docs.column("_id"), "n_tokens": pa.array(block.sizes), "value": pa.array(value),
                "alone": pa.array(np.bincount(doc, open_, size).astype(np.float64)),
            }
        )

    return run


def block_of(blocks: int) -> Column:
    """The block of a row (_id, text), by both: no single id decides a block's size."""
    return F.pmod(F.xxhash64("_id", "text", F.lit("block")), F.lit(blocks))


def lm_scores(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None
) -> DataFrame:
    """id_col, n_tokens, log_score (sum of the words' natural logarithms), mean_log_score of every row.

    Words are runs without ASCII white space, in ASCII lower case. A word scores count(context + word) / count(context)
    by the longest context in its document, if all other rows together have that n-gram, else `backoff` times its score with
    the context one word shorter; at last its share of the words of all other rows, where a word that none of them has counts
    as one. N-grams are told apart by 64-bit hashes. Null and empty texts have no words, score zero and a null mean.
    Rows that repeat are all counted and returned, and are evidence for each other; null and repeated ids are like any others. A
    text of any length is scored whole. An empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), full_text(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (block_bytes or min(max(LEAST_BLOCK, size // BLOCKS), MOST_BLOCK))))
    bits = (blocks - 1).bit_length()
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = rows.select("_id", block_of(blocks).alias("block"), "text").mapInArrow(
        _small, f"_id {kind}, block bigint, text binary"
    ).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(
        _ask(order, bits), "block bigint, part bigint, n int, grams binary, counts binary"
    ).repartition(1 << bits, "part", "n")
    counted = asked.groupBy("part", "n").applyInArrow(_count, "block bigint, part bigint, n int, totals binary").repartition(blocks, "block")
    scored = stored(
        dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(_score(order, backoff), f"_id {kind}, n_tokens bigint, value double, alone double"),
        "lm-scores",
    )
    words = scored.agg(F.sum("n_tokens")).first()[0] or 0
    total = F.col("value") - F.col("alone") * F.log(F.greatest(F.lit(float(words)) - F.col("n_tokens"), F.lit(1.0)))
    return scored.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        total.alias("log_score"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")))


SQL = {
    "op10_lm_scoring": r"""
        WITH d AS (
                 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
                 FROM documents),
             w AS (
                 SELECT doc_id, i, words[i] AS c, CASE WHEN i > 1 THEN words[i - 1] END AS b, CASE WHEN i > 2 THEN words[i - 2] END AS a
                 FROM d, unnest(range(1, len(words) + 1)) AS u(i)),
             n AS (
                 SELECT doc_id, i, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS words,
                        count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS n1,
                        CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY doc_id, b, c) END AS n2,
                        CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY doc_id, a, b, c) END AS n3
                 FROM w),
             o AS (SELECT *, lag(n1) OVER p AS m1, lag(n2) OVER p AS m2 FROM n WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
             s AS (
                 SELECT doc_id, count(*) AS n_tokens,
                        sum(CASE WHEN n3 > 0 THEN ln(n3) - ln(m2)
                                 WHEN n2 > 0 THEN ln(n2) - ln(m1) + ln(0.4) * (i > 2)::INT
                                 ELSE ln(greatest(n1, 1)) - ln(greatest(words, 1)) + ln(0.4) * ((i > 1)::INT + (i > 2)::INT) END) AS score
                 FROM o GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, round(coalesce(score, 0.0), 6) AS log_score, round(score / n_tokens, 6) AS mean_log_score
        FROM d LEFT JOIN s USING (doc_id)"""
}
