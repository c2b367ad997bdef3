"""Language ID by string kernels: presence of character n-grams, Nystroem landmarks, one-versus-rest kernel ridge.

The blended-spectrum presence kernel of two texts counts the distinct n-grams (1 to 3 characters) that both have,
over the geometric mean of their own counts. N-grams are hashed to a fixed number of slots, so every table that is sent
to the executors has a fixed size: landmarks x slots while fitting, slots x languages while scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import discard, full_text, in_training, stored, table, worker_of

#: Longest n-gram, and bits of a slot number.
ORDER, SLOT_BITS = 3, 17
#: Rows that a language gives to the fit (about, by hash of the id), and landmarks of a language.
FIT_ROWS, LANDMARKS = 1500, 48
RIDGE = 1e-2
#: Texts that are scored by one matrix product.
BATCH = 128
SHARPNESS = 6.0
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def slots(text: str, flags: np.ndarray) -> np.ndarray:
    """Sorted slots of the distinct n-grams of a text; flags is scratch space of one False per slot."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - SLOT_BITS)
    value = np.zeros(len(points), np.uint64)
    for n in range(ORDER):
        if len(points) <= n:
            break
        value = (value[: len(points) - n] + points[n:] + np.uint64(n + 1)) * _MIX
        value ^= value >> np.uint64(29)
        flags[value >> shift] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass
class KernelModel:
    """column: slot to column or -1; weights: columns x languages, landmarks and ridge folded in."""

    languages: list[str]
    column: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest values of texts given by their slots: one matrix product over the columns that any of them has."""
        columns = [c[c >= 0] for c in (self.column[s] for s in found)]
        used = np.unique(np.concatenate(columns)) if columns else np.empty(0, np.int64)
        x = np.zeros((len(found), len(used)), np.float32)
        for i, c in enumerate(columns):
            x[i, np.searchsorted(used, c)] = 1
        size = np.sqrt(np.maximum([len(s) for s in found], 1))[:, None]
        return x @ self.weights[used] / size + self.intercept


@dataclass
class Landmarks:
    """column: slot to column or -1; presence: columns x landmarks, one where a landmark has the slot; root: kernel values to features."""

    column: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    root: np.ndarray

    def features(self, found: list[np.ndarray]) -> np.ndarray:
        """Nystroem features of texts given by their slots."""
        shared = np.zeros((len(found), len(self.sizes)))
        for i, s in enumerate(found):
            c = self.column[s]
            shared[i] = self.presence[c[c >= 0]].sum(0, dtype=np.int32) / np.sqrt(max(len(s), 1))
        return shared / np.sqrt(self.sizes) @ self.root


def _sample_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_of("language_id")
    flags = np.zeros(1 << SLOT_BITS, bool)
    for b in batches:
        found = [slots(x.as_py(), flags).astype(np.int32) for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), pa.array(found, pa.list_(pa.int32()))], ["lang", "place", "slots"])


def fit_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """lang, text and u (a hash of id and text) of about `rows` distinct rows of each language that may be learnt from.

    Equal rows count once, so that neither a repeated id nor a repeated row decides the size of the sample.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), full_text(text_col).alias("text")).where(
        in_training("id") & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")
    )
    hashed = known.select("lang", "text", F.xxhash64("id", "text", F.lit("language")).alias("u"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("u").alias("n"))
    chance = F.shiftrightunsigned("u", 1) / float(1 << 63)
    # a row per language: the model holds far more of each
    drawn = hashed.join(F.broadcast(sizes), "lang").where(chance < F.lit(float(rows)) / F.col("n"))
    return drawn.groupBy("lang", "u").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> KernelModel | None:
    """Fit on about `rows` rows of each language that may be learnt from, chosen by a hash of id and text.

    The driver sees the landmarks' slots (landmarks x languages, each at most 2**SLOT_BITS numbers), and sums of a fixed
    size per partition. None if there is nothing to learn from.
    """
    sample = stored(fit_sample(docs, id_col, text_col, lang_col, rows), "language-sample")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    first = sample.withColumn("place", place).where(F.col("place") <= landmarks).select("lang", "place", "text")
    found = first.mapInArrow(_sample_slots, "lang string, place int, slots array<int>").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["place"]))
    languages = sorted({r["lang"] for r in found})
    marks = [np.array(r["slots"]) for r in found]

    used = np.unique(np.concatenate(marks))
    column = np.full(1 << SLOT_BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    presence, sizes = np.zeros((len(used), len(marks)), np.uint8), np.array([len(m) for m in marks])
    for j, m in enumerate(marks):
        presence[column[m], j] = 1
    basis = presence / np.sqrt(sizes, dtype=np.float32)
    kernel = basis.T.astype(np.float64) @ basis
    values, vectors = np.linalg.eigh(kernel)
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    # a byte for each slot and landmark: a worker holds a quarter of what the features' weights would take
    shipped = docs.sparkSession.sparkContext.broadcast(Landmarks(column, presence, sizes, root))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """z'z and z'y of a partition, z being the Nystroem features and a one."""
        worker_of("language_id")
        marks = shipped.value
        width = marks.root.shape[1] + 1
        zz, zy = np.zeros((width, width)), np.zeros((width, len(languages)))
        flags = np.zeros(1 << SLOT_BITS, bool)
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text")
            for i in range(0, len(langs), BATCH):
                part = langs[i : i + BATCH]
                z = np.ones((len(part), width))
                z[:, :-1] = marks.features([slots(x.as_py(), flags) for x in texts[i : i + BATCH]])
                y = np.where(np.array(part)[:, None] == np.array(languages), 1.0, -1.0)
                zz += z.T @ z
                zy += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()]), pa.array([zy.tobytes()])], ["zz", "zy"])

    width = root.shape[1] + 1
    zz, zy = np.zeros((width, width)), np.zeros((width, len(languages)))
    for r in sample.select("lang", "text").repartition(8).mapInArrow(sums, "zz binary, zy binary").toLocalIterator():
        zz += np.frombuffer(r["zz"]).reshape(zz.shape)
        zy += np.frombuffer(r["zy"]).reshape(zy.shape)
    discard(sample)
    shipped.unpersist()
    penalty = RIDGE * zz[-1, -1] / width * np.eye(width)
    penalty[-1, -1] = 0
    w = np.linalg.solve(zz + penalty, zy)
    return KernelModel(languages, column, (basis @ (root @ w[:-1])).astype(np.float32), w[-1].astype(np.float32))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None
) -> DataFrame:
    """id_col, held_out, lang_pred, score of every row, besides the columns named in keep.

    Learns from rows with a language whose id is not in the held-out third; predicts from the text alone. A null text,
    one without a letter, and every text if there is nothing to learn from, is `und` with score zero. Otherwise the
    score is the best language's share of the sharpened one-versus-rest values; of equal values the first language in
    alphabetical order wins. Rows that repeat are all returned and count once in the fit; a text of any length counts whole; an
    empty table gives an empty result; further columns are ignored but for those to keep. The model holds one column of weights
    per language.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    columns = [*dict.fromkeys([id_col, *(keep or [])])]
    held = ~in_training(id_col)
    rows = docs.select(*columns, held.alias("held_out"), F.col(text_col).alias("_text"))
    schema = docs.select(*columns, held.alias("held_out"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, best = predictions(model.value, b.column("_text"))
            kept = [b.column(i) for i in range(len(b.schema.names) - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs), pa.array(best)], schema.names)

    return rows.mapInArrow(score, schema)


def predictions(model: KernelModel | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, a block of texts per matrix product."""
    flags = np.zeros(1 << SLOT_BITS, bool)
    langs, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for i in range(0, len(texts) if model else 0, BATCH):
        asked, found = [], []
        for k, x in enumerate(texts[i : i + BATCH], i):
            text = x.as_py()
            if text and any(map(str.isalpha, text)):
                asked.append(k)
                found.append(slots(text, flags))
        if asked:
            f = SHARPNESS * model.scores(found).astype(np.float64)
            p = np.exp(f - f.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k, j, v in zip(asked, p.argmax(1), p.max(1), strict=True):
                langs[k], best[k] = model.languages[j], v
    return langs, best


def known_language(docs: DataFrame, min_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose text has a language that the classifier knows, with a score of min_score or more.

    Columns stay as they are, also such as have names of the classifier's own. A null text, one without a letter and, if there is
    nothing to learn from, every text goes; rows that repeat are judged alike; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("language_id")
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                b = whole.slice(start, BATCH)
                langs, best = predictions(model.value, b.column(at))
                yield b.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in zip(langs, best, strict=True)], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
