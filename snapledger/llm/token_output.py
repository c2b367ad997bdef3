"""Token-ID output: whole texts as ids of a public tokenizer, one wavelet matrix per shard, one file per shard.

Shards are ranges of the document id, so ids stand in ascending order of document over all files. A file is written
by Spark's text writer from a string column that holds the shard's bytes, so any file system that Spark knows will do;
the writer ends it with one line feed, which readers ignore.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import RELEASES, full_text, remove, scratch_path, stored, table, trim, worker_of
from snapledger.llm.wavelet import Shard, WaveletMatrix, dump

END_ID = 2
#: Bytes of text that go to a shard, on average: at least, at most, and shards that a table is dealt into between the two.
LEAST_SHARD, MOST_SHARD, SHARDS = 8 << 20, 256 << 20, 10_000
#: Pieces that a worker remembers, and bytes of the longest of them.
CACHE, PIECE = 500_000, 48
#: Bytes of text (and more, if one text has more) that are encoded at a time.
AT_ONCE = 4 << 20

#: Kinds of bytes. Beyond ASCII, a byte that may begin white space is of no kind: a cut too few does no harm.
_OTHER, _LETTER, _DIGIT, _SIGN, _SPACE, _LINE, _BEYOND = range(7)
_KIND = np.array(
    [_SPACE if c == 32 else _LINE if c == 10 else _OTHER if c < 32 or c in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3) else _BEYOND if c > 127
     else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN for c in range(256)], np.uint8,
)


def _pairs(first: tuple[int, ...], second: tuple[int, ...]) -> np.ndarray:
    """A table over pairs of kinds."""
    table = np.zeros((8, 8), bool)
    table[np.ix_(first, second)] = True
    return table.ravel()


_VISIBLE = (_LETTER, _DIGIT, _SIGN, _BEYOND)
_SPACED, _SIGNED, _ENDED = _pairs((_SPACE,), _VISIBLE), _pairs((_LETTER,), (_SIGN,)), _pairs(_VISIBLE[:3], (_LINE,))


def borders(raw: np.ndarray) -> np.ndarray:
    """Where UTF-8 text may be cut so that the tokenizer gives the same ids for the parts as for the whole.

    Before a space that a visible character follows; between a letter and a sign; before a line feed that follows a visible
    character, and after it too, if another one comes next. A longer run of white space is never cut but before its last space.
    """
    kind = _KIND[raw]
    pair = kind[:-1] * 8 + kind[1:]
    line = np.flatnonzero(_ENDED[pair]) + 1
    alone = line[line < len(raw) - 1] + 1
    alone = alone[np.isin(kind[alone], _VISIBLE)]
    found = np.zeros(len(raw) + 1, bool)
    found[: max(len(raw) - 1, 0)] = _SPACED[pair]
    for at in (np.flatnonzero(_SIGNED[pair]) + 1, line, alone):
        found[at] = True
    return found


def _values(pieces: pa.Array) -> list[bytes]:
    """The values of an unsliced binary array."""
    _, at, data = pieces.buffers()
    if not len(pieces):
        return []
    at, raw = np.frombuffer(at, np.int32)[: len(pieces) + 1].tolist(), data.to_pybytes()
    return list(map(raw.__getitem__, map(slice, at, at[1:])))


_encoders: dict[str, Encoder] = {}
RELEASES.append(_encoders.clear)


class Encoder:
    """Ids of whole texts, piece by piece.

    Texts are cut where byte-level BPE never joins them. Arrow tells the distinct pieces of a batch, and each of them goes
    through the tokenizer once per worker. A text that holds an added token (such as that of a special token) goes through
    the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), END_ID + 1)
        self.bits = (size - 1).bit_length()
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of text that each id stands for: byte-level tokens have a character for each byte.
        self.widths = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(token)
        self.known: dict[bytes, int] = {}
        # an Arrow batch of texts has less than 2^31 bytes, and the pieces that stay known fewer still
        self.flat, self.first, self.length = np.empty(0, self.kind), np.empty(0, np.int32), np.empty(0, np.int32)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece, -1 if it is not known."""
        return np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int32, len(pieces))

    def _forget(self, but: list[bytes] = ()) -> None:
        """Known pieces are numbered; number k has the ids from first[k] on, length[k] of them. Some may stay known."""
        kept = [(p, self.flat[self.first[k] : self.first[k] + self.length[k]]) for p in but if (k := self.known.get(p)) is not None]
        self.known = {}
        self.flat, self.first, self.length = np.empty(0, self.kind), np.empty(0, np.int32), np.empty(0, np.int32)
        self._add([p for p, _ in kept], np.concatenate([self.flat, *(x for _, x in kept)]), np.array([len(x) for _, x in kept], np.int64))

    def _add(self, pieces: list[bytes], ids: np.ndarray, length: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.length), len(self.length) + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(length) - length).astype(np.int32)])
        self.length, self.flat = np.concatenate([self.length, length.astype(np.int32)]), np.concatenate([self.flat, ids])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, straight from the tokenizer."""
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_apart(self, pieces: list[bytes]) -> None:
        ids = self.whole([p.decode() for p in pieces])
        self._add(pieces, np.concatenate([np.empty(0, self.kind), *ids]), np.array([len(x) for x in ids], np.int64))

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces that begin with a space are encoded as one text, cut where the bytes of the ids say."""
        self._learn_apart([p for p in pieces if p[:1] != b" "])
        spaced = [p for p in pieces if p[:1] == b" "]
        if not spaced:
            return
        ids = self.whole([b"".join(spaced).decode()])[0]
        ends = np.cumsum([len(p) for p in spaced])
        reached = np.cumsum(self.widths[ids])
        cut = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or (reached[cut] != ends).any():
            self._learn_apart(spaced)
        else:
            self._add(spaced, ids, np.diff(cut, prepend=-1))

    def _cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts in a row, and for each text where its pieces begin (with the end of all)."""
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1] if at is not None else np.zeros(1, np.int32)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        at = at - at[0]
        border = borders(raw)
        border[at] = True
        ends = np.flatnonzero(border)
        pieces = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        return pieces.dictionary_encode(), np.searchsorted(ends, at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. Texts are not null."""
        apart = np.flatnonzero(np.any([pc.match_substring(texts, t).to_numpy(zero_copy_only=False) for t in self.added], axis=0)) if self.added else []
        own = self.whole(texts.take(pa.array(apart)).to_pylist()) if len(apart) else []
        mask = np.zeros(len(texts), bool)
        mask[apart] = True
        rest = pc.if_else(pa.array(mask), "", texts) if len(apart) else texts
        pieces, begin = self._cut(rest)
        distinct = _values(pieces.dictionary)
        number = self._numbers(distinct)
        new = [distinct[i] for i in np.flatnonzero(number < 0)]
        if new and (len(self.known) + len(new) > CACHE or len(self.flat) > 16 * CACHE):
            self._forget(but=distinct)
            self._learn(new)
            number = self._numbers(distinct)
        elif new:
            self._learn(new)
            number[number < 0] = self._numbers(new)
        number = number[pieces.indices.to_numpy()]
        length = self.length[number]
        reached = np.concatenate([np.zeros(1, np.int32), np.cumsum(length, dtype=np.int32)])
        ids = self.flat[np.arange(reached[-1], dtype=np.int32) + np.repeat(self.first[number] - reached[:-1], length)]
        starts = reached[begin]
        counts = np.diff(starts)
        for p in new:
            if len(p) > PIECE:
                del self.known[p]
        if own:
            edges = [0, *starts[apart].tolist()]
            ids = np.concatenate([*(y for a, b, x in zip(edges, edges[1:], own, strict=False) for y in (ids[a:b], x)), ids[edges[-1] :]])
            counts[apart] = [len(x) for x in own]
        return ids, counts


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about AT_ONCE bytes."""
    run = np.cumsum(pc.binary_length(texts).to_numpy()) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False))


def _write_shard(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("token_output")
        enc = encoder(path)
        ids: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        nulls = 0
        for b in batches:
            for part in _parts(b.column(1)):
                found, counts = enc.encode(part)
                ids.append(np.insert(found, np.cumsum(counts), end_id))
                lengths.append(counts + 1)
            nulls += b.column(0).null_count
            docs.append(b.column(0).fill_null(0).to_numpy())
        if sum(map(len, docs)):
            matrix = WaveletMatrix.build(np.concatenate(ids), enc.bits)
            ids.clear()
            shard = TaskContext.get().partitionId()
            blob = dump(matrix, np.concatenate(docs), np.concatenate(lengths), shard, nulls)
            del matrix, docs, lengths
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])
            del blob
        trim()

    return run


def write_token_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    shard_bytes: int | None = None,
) -> None:
    """Write the ids of every document, each followed by end_id, to shard files under path.

    Null texts count as empty and hold the end id alone. Null ids come first; documents of one id stand together, in no
    fixed order. The id must be an integer column. An empty table writes no shard; further columns are ignored. A text of any
    length is one document of one shard; rows of one id go to one shard.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), full_text(text_col).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(1, -(-size // (shard_bytes or min(max(LEAST_SHARD, size // SHARDS), MOST_SHARD))))
    rows = rows.repartitionByRange(shards, "_id").sortWithinPartitions("_id")
    blobs = rows.mapInArrow(_write_shard(tokenizer, end_id), "blob binary")
    blobs.select(F.col("blob").cast("string")).write.text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """The shard files as rows of one binary column."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").where("length(content) > 0")


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["shard", "ordinal", "doc_id", "start", "n_tokens", "ids_crc32"]
    for b in batches:
        for content in b.column(0):
            s = Shard(content.as_py())
            lengths = s.lengths()
            ends = np.cumsum(lengths)
            ids = s.matrix.decode().astype("<u4")
            crc = [zlib.crc32(memoryview(ids[e - n : e])) for e, n in zip(ends, lengths, strict=True)]
            known = np.arange(len(lengths)) >= s.null_ids
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(lengths), s.number, np.int64)), pa.array(np.arange(len(lengths))),
                    pa.array(s.doc_ids(), mask=~known), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()),
                ],
                names,
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files alone."""
    files = shard_files(spark, path)
    rows = stored(
        files.mapInArrow(
            _read_documents, "shard bigint, ordinal bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
        ),
        "token-docs",
    )
    # one row per shard, so a single ordered window is enough
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    return rows.join(offsets, "shard").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """shard, doc_id, position (in the document) of every occurrence of a token, by rank and select."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s = Shard(content.as_py())
                at = np.array(s.matrix.locate(token), np.int64)
                ends = np.cumsum(s.lengths())
                doc = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), s.number, np.int64)), pa.array(s.doc_ids()[doc], mask=doc < s.null_ids),
                        pa.array(at - (ends - s.lengths())[doc]),
                    ],
                    ["shard", "doc_id", "position"],
                )

    return shard_files(spark, path).mapInArrow(look, "shard bigint, doc_id bigint, position bigint")


def token_count(spark: SparkSession, path: str, token: int) -> DataFrame:
    """shard, occurrences of a token, by rank alone."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s = Shard(content.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.number], pa.int64()), pa.array([s.matrix.rank(token)], pa.int64())], ["shard", "occurrences"]
                )

    return shard_files(spark, path).mapInArrow(look, "shard bigint, occurrences bigint")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards of docs to the shared folder and give what the files say of every document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    write_token_shards(docs, path, tokenizer or public_tokenizer())
    found = read_documents(spark, path)
    remove(spark, path)
    return found


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
