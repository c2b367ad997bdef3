"""Quality by nearest-neighbour voting in a latent semantic space.

Terms are words, the shapes of tokens, words that follow themselves and the share of distinct tokens. A bounded sample of labelled rows gives the vocabulary, the inverse document
frequencies and the latent directions (truncated SVD by subspace iteration on the Gram matrix, summed over the
executors); its vectors are broadcast. Each block of documents is multiplied with all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import discard, full_text, in_training, stored, table

#: Labelled rows that the model holds (about, by hash of the id), terms, latent directions, neighbours.
LABELLED, TERMS, LATENT, NEIGHBOURS = 6000, 2048, 64, 25
#: Slots that terms are hashed to before the vocabulary is chosen.
SLOTS = 1 << 16
BLOCK = 256
#: Power of the similarity that weights a neighbour's label.
FOCUS = 6
#: Tokens that a worker remembers, and characters of the longest of them.
CACHE, LONGEST_KEPT = 200_000, 256
#: Similarities that differ by less count as equal.
TIE = 1e-6

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_RUN = re.compile(r"(.)\1+")


class TermSlots(dict):
    """token -> (slot of the word, slot of the shape), forgotten when there are too many."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        word = _EDGE.sub("", token).lower()
        shape = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in token)
        shape = _RUN.sub(r"\1+", shape)
        found = _slot(f"w {word}"), _slot(f"s {shape}")
        if len(token) <= LONGEST_KEPT:
            self[token] = found
        return found


def _slot(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) % SLOTS


#: Slots of words that follow themselves, and of the share of distinct tokens in tenths.
ECHO, VARIETY = SLOTS, SLOTS + 1
ALL_SLOTS = SLOTS + 12


def term_counts(text: str, known: TermSlots) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots of a text's terms and their counts."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    counts = Counter(tokens)
    slot = [s for t in counts for s in known[t]]
    n = [c for c in counts.values() for _ in range(2)]
    if echoes := sum(map(eq, tokens, islice(tokens, 1, None))):
        slot.append(ECHO)
        n.append(echoes)
    slot.append(VARIETY + 10 * len(counts) // len(tokens))
    n.append(len(counts))
    found, at = np.unique(slot, return_inverse=True)
    return found, np.bincount(at, n)


@dataclass
class LatentModel:
    """column: slot to term or -1; project: terms x directions, idf folded in; vectors and labels of the sample."""

    column: np.ndarray
    project: np.ndarray
    prior: float
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None

    def terms(self, texts: list[str], known: TermSlots) -> np.ndarray:
        x = np.zeros((len(texts), len(self.project)), np.float32)
        for i, text in enumerate(texts):
            slot, n = term_counts(text, known)
            c = self.column[slot]
            x[i, c[c >= 0]] = 1 + np.log(n[c >= 0])
        return x

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str], known: TermSlots) -> np.ndarray:
        """Similarity-weighted share of good labels among the nearest labelled vectors; the prior where none is near.

        Vectors that are as near as the last neighbour all vote.
        """
        similar = self.latent(self.terms(texts, known)) @ self.vectors.T
        k = min(NEIGHBOURS, similar.shape[1])
        last = -np.partition(-similar, k - 1, axis=1)[:, k - 1]
        row, near = np.nonzero(similar >= (last - TIE)[:, None])
        weight = np.clip(similar[row, near], 0, 1).astype(np.float64) ** FOCUS
        total = np.bincount(row, weight, len(texts))
        votes = np.bincount(row, weight * self.labels[near], len(texts))
        return np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.prior)


def _term_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, known = np.zeros(ALL_SLOTS, np.int64), TermSlots()
    for b in batches:
        for x in b.column("text"):
            n[term_counts(x.as_py(), known)[0]] += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["slot", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = LABELLED) -> LatentModel | None:
    """Fit on about `rows` labelled rows outside the held-out third; None if there are none.

    Rows are drawn by a hash of the id, and where ids repeat again by a hash of the row, to twice `rows` at most; equal rows count once.

    What the driver gathers has a fixed size: term counts (SLOTS), Gram sums (TERMS x TERMS per partition, eight of
    them) and the sample's vectors (rows x LATENT).
    """
    spark = docs.sparkSession
    marked = (
        labels.where(in_training(id_col) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    )
    total = marked.count()
    if not total:
        return None
    chance = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) / (1 << 30)
    # a pair of numbers each; half a megabyte of them at the default, but for chance
    chosen = marked.where(chance < max(rows / total, 1e-9))
    drawn = docs.select(F.col(id_col).alias("id"), full_text(text_col).alias("text")).join(F.broadcast(chosen), "id")
    hashed = drawn.select("label", "text", F.xxhash64("id", "text", F.lit("row")).alias("u"))
    found = max(hashed.agg(F.approx_count_distinct("u")).first()[0], 1)
    few = hashed.where(F.shiftrightunsigned("u", 1) / float(1 << 63) < 2 * rows / found)
    sample = stored(few.groupBy("u").agg(F.min("label").alias("label"), F.min("text").alias("text")), "quality-sample").repartition(8)
    n = sample.count()
    if not n:
        return None
    counted = sample.select("text").mapInArrow(_term_frequencies, "slot bigint, n bigint")
    top = counted.groupBy("slot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot").limit(TERMS).collect()
    column = np.full(ALL_SLOTS, -1, np.int32)
    idf = np.ones((max(len(top), 1), 1), np.float32)
    for i, r in enumerate(top):
        column[r["slot"]] = i
        idf[i] = np.log((1 + n) / (1 + r["n"])) + 0.1
    raw = spark.sparkContext.broadcast(LatentModel(column, idf, 0.5))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = raw.value, TermSlots()
        g = np.zeros((len(model.project),) * 2, np.float32)
        good = 0
        for b in batches:
            texts = b.column("text").to_pylist()
            good += int(np.sum(b.column("label").to_pylist()))
            for i in range(0, len(texts), BLOCK):
                x = model.terms(texts[i : i + BLOCK], known) * model.project[:, 0]
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([good])], ["g", "good"])

    g, good = np.zeros((len(idf),) * 2), 0
    for r in sample.mapInArrow(gram, "g binary, good bigint").toLocalIterator():
        g += np.frombuffer(r["g"], np.float32).reshape(g.shape)
        good += r["good"]
    width = min(LATENT, len(idf))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((len(idf), min(width + 16, len(idf)))))[0]
    for _ in range(12):
        basis = np.linalg.qr(g @ basis)[0]
    values, vectors = np.linalg.eigh(basis.T @ g @ basis)
    basis = basis @ vectors[:, ::-1][:, :width]
    model = LatentModel(column, (idf * basis).astype(np.float32), good / n)
    shipped = spark.sparkContext.broadcast(model)

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shipped.value, TermSlots()
        for b in batches:
            z = m.latent(m.terms(b.column("text").to_pylist(), known))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([v.tobytes() for v in z], pa.binary())], ["label", "z"])

    held = sample.select("label", "text").mapInArrow(vectors_of, "label int, z binary").collect()
    model.vectors = np.array([np.frombuffer(r["z"], np.float32) for r in held])
    model.labels = np.array([r["label"] for r in held], np.float64)
    raw.unpersist()
    shipped.unpersist()
    return model


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """id_col, held_out, score (0 to 1, higher: label 1 likelier), predicted of every row of docs.

    Labels of ids outside the held-out third are learnt from, on average where an id has several; a score depends on
    the text alone. Null counts as empty; a text without a known term gets the share of good labels, and one half if there
    is nothing to learn from. Labelled vectors as near as the last of the neighbours (repeated texts) all vote. Rows that repeat
    are all returned and count once among the labelled; a text of any length is scored whole; an empty table gives an empty
    result; further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col), (~in_training(id_col)).alias("held_out"), full_text(text_col).alias("_text"))
    schema = rows.select(id_col, "held_out", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = model.value, TermSlots()
        for b in batches:
            out = np.full(b.num_rows, 0.5)
            texts = b.column("_text")
            for i in range(0, b.num_rows if m else 0, BLOCK):
                out[i : i + BLOCK] = m.score(texts[i : i + BLOCK].to_pylist(), known)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], schema.names)

    return rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
