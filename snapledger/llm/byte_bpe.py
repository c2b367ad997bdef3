"""Byte-level BPE as a monoid: a match of the pattern is encoded by halves, and two encoded neighbours are joined at their border.

Joining re-encodes a window of tokens around the border, and widens it until the tokens outside are settled. They are once the
border pairs of the window fit: encoded by itself, the text of two neighbouring tokens that fit gives these two. If all neighbours of
a row of tokens fit, the row is the encoding of its text: suppose a merge over some border were the first such one; up to then
every token's bytes are merged as in the text of that token and its neighbour alone, where the lowest rank, leftmost first,
would have crossed the border as well. Decoding concatenates the bytes of tokens in pairs, up the tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import RELEASES, full_text, table, worker_of

#: Bytes that are encoded without further halving, bytes from which a window is merged through a heap, tokens joined at once.
LEAF, HEAP, DECODED = 8, 48, 1024
#: Matches that a worker remembers, and characters of the longest of them; pairs of tokens that it remembers to fit or not, and leaves.
CACHE, PIECE, PAIRS, LEAVES = 200_000, 48, 100_000, 100_000
#: Above any rank.
NO_RANK = 1 << 62
#: Characters of a text that are split into matches at a time (and more, up to the next white space).
SEGMENT = 1 << 20
#: Bytes of results that leave a task at once (and more, if one text has more).
AT_ONCE = 4 << 20

#: A character that is neither letter, number nor white space.
NO_CLASS = "\u00a4"
#: Where a text may be cut: no match of the pattern has white space behind other characters, nor looks that far.
_EDGE = regex.compile(r"(?<=\S)(?=\s)")


class Bpe:
    """Encoding and decoding by ranks (bytes of a token to its id, which is its rank)."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.fits, self.leaves = lru_cache(PAIRS)(self._fits), lru_cache(LEAVES)(self.merged)

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of data by plain merging: the pair of the lowest rank first, of equal ones the leftmost."""
        if len(data) > HEAP:
            return self._merged_by_heap(data)
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        found = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while found and (least := min(found)) < NO_RANK:
            at = found.index(least)
            token = parts[at] = parts[at] + parts.pop(at + 1)
            del found[at]
            if at < len(found):
                found[at] = rank(token + parts[at + 1], NO_RANK)
            if at:
                found[at - 1] = rank(parts[at - 1] + token, NO_RANK)
        return parts

    def _merged_by_heap(self, data: bytes) -> list[bytes]:
        n = len(data)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (r := self.ranks.get(data[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, b, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not alive[a] or end[a] != b or end[b] != stop:
                continue
            end[a], alive[b] = stop, 0
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(data[a : end[a]])
            a = end[a]
        return out

    def _fits(self, a: bytes, b: bytes) -> bool:
        return self.merged(a + b) == [a, b]

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The tokens of the text of both: a window over the border, wider on the side that does not fit, until both do."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(b"".join(left[-i:] + right[:j]))
            settled_left = i == len(left) or self.fits(left[-i - 1], window[0])
            settled_right = j == len(right) or self.fits(window[-1], right[j])
            if settled_left and settled_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if settled_left else 2 * i, j if settled_right else 2 * j

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= self.leaf:
            return self.leaves(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a match: its own, if it is a token, else those of its tree."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return [self.ranks[t] for t in self.tree(piece)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, runs of them joined in pairs up the tree."""
        runs = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + DECODED])) for i in range(0, len(ids), DECODED)]
        while len(runs) > 1:
            runs = [b"".join(runs[i : i + 2]) for i in range(0, len(runs), 2)]
        return runs[0] if runs else b""

    def decode_packed(self, ids: bytes) -> bytes:
        return self.decode(np.frombuffer(ids, "<u4").tolist())


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a line per token: base64 of its bytes, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def stand_ins() -> dict[int, str]:
    """Characters that this Python's \\s, \\p{L} and \\p{N} class unlike the reference library's (newer Unicode tables), each with
    a usual character of the class that it has there."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    out: dict[int, str] = {}
    for kind, usual in (("\\p{L}", "z"), ("\\p{N}", "0"), ("\\s", "\t")):
        # this encoding's ids are the bytes of what the pattern matches
        there = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        here = set(regex.findall(kind, every))
        out |= {ord(c): usual for c in there - here} | {ord(c): out.get(ord(c), "") for c in here - there}
    return out


class Splitter:
    """The matches of a pattern in a text, whole and in order."""

    def __init__(self, pattern: str, unlike: dict[int, str]):
        self.pattern, self.unlike = regex.compile(pattern), unlike
        self.odd = frozenset(map(chr, unlike))

    def matches(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.unlike))]

    def segments(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SEGMENT and (cut := _EDGE.search(text, start + SEGMENT)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]


class _Known(dict):
    """Matches and their ids as little-endian unsigned 32-bit integers; a full table becomes the older one, which is asked last."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            found = self.bpe.encode(piece.encode())
            ids = pack(f"<{len(found)}I", *found)
        if len(piece) <= PIECE:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def _loaded(path: str) -> Bpe:
    return Bpe(read_ranks(path))


@lru_cache(2)
def _known(path: str) -> _Known:
    return _Known(_loaded(path))


RELEASES += [_loaded.cache_clear, _known.cache_clear]


def _runs(batches: Iterator[pa.RecordBatch], column: int, convert, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches with a column replaced by the binaries that convert gives for it, in runs of AT_ONCE bytes of them."""
    for b in batches:
        found, size, start = [], 0, 0
        for k, x in enumerate(b.column(column)):
            found.append(convert(x.as_py()))
            size += sum(map(len, found[-1]))
            if size >= AT_ONCE or k == b.num_rows - 1:
                kept = [c for i, c in enumerate(b.slice(start, len(found)).columns) if i != column]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.binary()) for c in zip(*found, strict=True))], names)
                found, size, start = [], 0, k + 1


def encoded(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False
) -> DataFrame:
    """id_col and ids (the ids of the whole text as little-endian unsigned 32-bit integers, in one binary) of every row.

    vocabulary: path of a file of ranks, on every executor. Each match of pattern is encoded by itself; what it does not match has no ids;
    there are no special tokens. with_decoded adds `decoded`, the bytes that the ids stand for, decoded where they were made.

    Null and empty texts have no ids. A text of any length is encoded whole: it is split in runs of SEGMENT characters, and a match of
    n bytes takes about n log(n) steps. Repeated rows are all returned; an empty table gives an empty result; further columns are ignored.
    """
    unlike = docs.sparkSession.sparkContext.broadcast(stand_ins())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "ids", *(["decoded"] if with_decoded else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_of("byte_bpe")
        known, split = _known(vocabulary), Splitter(pattern, unlike.value)
        ids_of = known.__getitem__

        def convert(text: str) -> list[bytes]:
            ids = b"".join(b"".join(map(ids_of, split.matches(s))) for s in split.segments(text))
            return [ids, known.bpe.decode_packed(ids)] if with_decoded else [ids]

        return _runs(batches, 1, convert, names)

    found = docs.select(F.col(id_col).alias("id"), full_text(text_col).alias("text")).mapInArrow(encode, ", ".join([f"id {kind}", *(f"{c} binary" for c in names[1:])]))
    return found.withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """tokens with a binary column `into`, in place of one of that name: the bytes that the ids stand for; null where they are null."""
    columns = [c for c in tokens.columns if c != into]
    rows = tokens.select(F.struct(*columns).alias("row"), F.col(ids_col).alias("ids"))
    schema = tokens.select(F.struct(*columns).alias("row"), F.lit(b"").alias("decoded")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocabulary)
        return _runs(batches, 1, lambda ids: [bpe.decode_packed(ids or b"")], schema.names)

    found = rows.mapInArrow(decode, schema)
    return found.select(*(F.col("row").getField(c).alias(c) for c in columns), F.when(F.col("row").getField(ids_col).isNotNull(), F.col("decoded")).alias(into))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_decoded=True).select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


SQL: dict[str, str] = {}
