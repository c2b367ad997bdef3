"""Vector code compression: one byte per part of a vector, by codebooks whose entries are found through a VA file.

The entries of a part's codebook are quantised to a few bits per coordinate. A query looks its lower and upper bound to each
cell of each coordinate up once; the sums of those bounds leave only the entries whose lower bound is not above the least
upper one, and these alone are held against the query in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import stored, table
from snapledger.llm.vectors import SUMS, blocks, integers, matrix, sums_batch, totals

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits of a coordinate's cell.
CELL_BITS = 3
#: Vectors that are coded at a time.
BLOCK = 2048
#: Labels whose sums are broadcast at most; of more, the sums travel to rows dealt by label and salt.
SENT_LABELS = 10_000
#: Rows of one label that meet in a task, about, where sums travel.
SALT_ROWS = 1 << 18


class VaFile:
    """The entries (m x width integers) of one codebook with their cells: cell[d, e] is the cell of coordinate d of entry e."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries
        cells = min(1 << bits, len(entries))
        # the coordinates of a dimension in order, cut into cells of equally many entries
        place = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = (place * cells // len(entries)).T
        self.low = np.empty((entries.shape[1], cells))
        self.high = np.empty_like(self.low)
        for d in range(entries.shape[1]):
            for c in range(cells):
                held = entries[self.cell[d] == c, d]
                self.low[d, c], self.high[d, c] = held.min(), held.max()

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each query to each entry, by a lookup table per query."""
        lower, upper = np.zeros((2, len(queries), len(self.entries)))
        for d in range(queries.shape[1]):
            q = queries[:, d, None].astype(np.float64)
            under, over = self.low[d] - q, q - self.high[d]
            nearest, farthest = np.maximum(np.maximum(under, over), 0), np.maximum(np.abs(under), np.abs(over))
            lower += (nearest * nearest)[:, self.cell[d]]
            upper += (farthest * farthest)[:, self.cell[d]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each query; of equal ones the first."""
        lower, upper = self.bounds(queries)
        # bounds are exact for components of usual size; the slack covers the rounding of larger ones
        who, entry = np.nonzero(lower * (1 - 2.0**-40) <= upper.min(1, keepdims=True) * (1 + 2.0**-40))
        apart = queries[who] - self.entries[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        found = np.full(lower.shape, np.iinfo(np.int64).max)
        found[who, entry] = distance
        best = found.argmin(1)
        return best, found[np.arange(len(best)), best]


def code_vectors(books: list[VaFile], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of each vector."""
    width = vectors.shape[1] // len(books)
    code, error = np.empty((2, len(vectors), len(books)), np.int64)
    for p, book in enumerate(books):
        code[:, p], error[:, p] = book.nearest(vectors[:, p * width : (p + 1) * width])
    return code, error


def _round_sums(books: list[VaFile], dim: int):
    width, entries = dim // len(books), len(books[0].entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), entries, width + 1), np.int64)
        for b in batches:
            for part in blocks(b, BLOCK):
                vectors = matrix(part.column(0), dim)
                code, _ = code_vectors(books, vectors)
                for p in range(len(books)):
                    np.add.at(total[p, :, :width], code[:, p], vectors[:, p * width : (p + 1) * width])
                    total[p, :, width] += np.bincount(code[:, p], minlength=entries)
        yield sums_batch(total.reshape(-1))

    return sums


def train_codebooks(ints: DataFrame, seeds: list[list[int]], parts: int, rounds: int) -> list[VaFile]:
    """Codebooks of each part after `rounds` rounds over all rows of ints (one column: array<int>, all as long as the seeds).

    Sums of a round are exact, and of a fixed size whatever the rows; the mean of an entry is rounded down.
    """
    dim = len(seeds[0])
    width = dim // parts
    books = [VaFile(np.array(seeds, np.int64)[:, p * width : (p + 1) * width]) for p in range(parts)]
    for _ in range(rounds):
        found = totals(ints.mapInArrow(_round_sums(books, dim), SUMS), parts * len(seeds) * (width + 1))
        for p in range(parts):
            entries = books[p].entries.copy()
            for e in range(len(seeds)):
                *total, n = found[(p * len(seeds) + e) * (width + 1) : (p * len(seeds) + e + 1) * (width + 1)]
                if n:
                    entries[e] = [s // n for s in total]
            books[p] = VaFile(entries)
    return books


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, sent_labels: int = SENT_LABELS, salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """id_col, code (two hex digits a part), error, label_error, codebooks_sha256 of every row with a whole vector.

    Components become floor(scale * x). Vectors are cut into `parts` equal runs, each with a codebook of `entries` entries, started
    with the rows of the smallest ids and refined by `rounds` rounds over all rows (floored means; entries without rows stay). error is
    the exact squared distance to the decoded vector, label_error its sum over the rows of a label.

    Left out: vectors that are null, hold null or a value that is not finite, or whose integers have a squared length over 2**60, as
    their distances are no longs; vectors of another length than most (of equally frequent lengths the longest) and, if that is no
    positive multiple of `parts`, of that. Rows that repeat count as often as they occur, also as starts of the codebooks, where equal ids
    are taken in order of their vectors; null ids come last there. Null labels are one label. Fewer rows than entries
    give smaller codebooks, none an empty result. Further columns are ignored.
    """
    read = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integers(F.col(vector_col), scale).alias("v"))
    read = stored(read.where("v IS NOT NULL").withColumn("n", F.size("v")), "vectors")
    spark = vectors.sparkSession
    given = {f.name: f.dataType.simpleString() for f in read.schema}
    empty = spark.createDataFrame([], f"id {given['id']}, code string, error bigint, label_error bigint, codebooks_sha256 string").withColumnRenamed("id", id_col)
    lengths = read.where((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    if not (common := lengths.orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()):
        return empty
    dim, rows = common[0]
    kept = read.where(F.col("n") == dim)
    seeds = [r["v"] for r in kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()]
    books = train_codebooks(kept.select("v"), seeds, parts, rounds)
    digest = sha256(",".join(str(x) for b in books for x in b.entries.reshape(-1).tolist()).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, BLOCK):
                codes, errors = code_vectors(books, matrix(part.column(2), dim))
                text = [bytes(r).hex() for r in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(errors.sum(1), pa.int64())], ["id", "label", "code", "error"]
                )

    coded = kept.select("id", "label", "v").mapInArrow(code, f"id {given['id']}, label {given['label']}, code string, error bigint")
    coded = stored(coded, "vector-codes")
    return _with_label_errors(coded, rows, sent_labels, salt_rows).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _with_label_errors(coded: DataFrame, rows: int, sent_labels: int, salt_rows: int) -> DataFrame:
    """coded with label_error. Few labels are broadcast; of many, each label's sum goes to the salts that its rows are dealt by."""
    label = F.col("label")
    sums = stored(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("bigint").alias("label_error")), "label-errors")
    if sums.count() <= sent_labels:
        sent = sums.withColumnRenamed("label", "_label")
        return coded.join(F.broadcast(sent), label.eqNullSafe(F.col("_label")))
    salts = max(1, rows // salt_rows)
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(salts)).cast("int"))
    places = dealt.groupBy("label", "_salt").agg(F.count(F.lit(1)).alias("_n")).select(F.col("label").alias("_label"), F.col("_salt").alias("_s"))
    sent = places.join(sums, label.eqNullSafe(F.col("_label"))).select("_label", "_s", "label_error")
    return dealt.join(sent, (F.col("_salt") == F.col("_s")) & label.eqNullSafe(F.col("_label")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds as a chain of common table expressions, with plain distances to all entries."""
    near = (
        "a{r} AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT vec_id, p, e,"
        " list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cells JOIN b{r} USING (p)) GROUP BY vec_id, p)"
    )
    mean = (
        "m{r} AS (SELECT p, best.e AS e, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r} JOIN cells USING (vec_id, p), range(1, 9) t(i) GROUP BY ALL),"
        " b{n} AS MATERIALIZED (SELECT p, e, coalesce(f.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT p, e,"
        " list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{r} GROUP BY p, e) f USING (p, e))"
    )
    rounds = ", ".join(f"{near.format(r=r)}, {mean.format(r=r, n=r + 1)}" for r in range(ROUNDS))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS MATERIALIZED (SELECT vec_id, p, v[p * 8 + 1 : p * 8 + 8] AS q FROM kept, range(8) t(p)),
        b0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM cells
            WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),
        {rounds}, {near.format(r=ROUNDS)},
        coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY p, e, i)) FROM b{ROUNDS}, range(1, 9) t(i)) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


SQL = {"op11_vector_codes": _sql()}
