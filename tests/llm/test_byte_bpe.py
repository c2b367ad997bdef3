"""Encoding by trees against the tiktoken library, and its parts against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from snapledger.llm import byte_bpe as bb

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bb.read_ranks(PATH)
BPE = bb.Bpe(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = bb.Splitter(public_tokenizers.PATTERN, bb.stand_ins())

TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello, world! It's  1234567 o'clock\r\n", "Żółć ẞ 漢字かな交じり文 한국어 العربية हिन्दी", "a" * 5000, "ab" * 3000 + "c" * 999,
    "漢字" * 2000, "0123456789" * 300, "\u0000\u001c\u0085　x", "՘֋ ₏ zz\U00011de3 9", "<|endoftext|>", "é" * 700, "😀" * 500 + " 👩‍👩‍👧‍👦",
    "!?" * 2000, " " * 3000 + "x", "\n" * 2500, "pneumonoultramicroscopicsilicovolcanoconiosis antidisestablishmentarianism",
]


def plain(data):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        found = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in RANKS]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=90), st.text("abcdehinorst", max_size=120).map(str.encode), st.text("aab", max_size=200).map(str.encode)))
def test_tree_equals_plain_merging(data):
    want = plain(data)
    assert BPE.merged(data) == want and BPE._merged_by_heap(data) == want
    assert BPE.tree(data) == want and bb.Bpe(RANKS, leaf=1).tree(data) == want


def test_join_is_associative():
    rnd = random.Random(4)
    for _ in range(200):
        a, b, c = (bytes(rnd.choice(b"aeinorst ") for _ in range(rnd.randrange(30))) for _ in range(3))
        x, y, z = map(plain, (a, b, c))
        assert BPE.join(BPE.join(x, y), z) == BPE.join(x, BPE.join(y, z)) == plain(a + b + c)
        assert BPE.join([], x) == x == BPE.join(x, [])


def test_windows_widen_as_far_as_tokens_change():
    """A toy vocabulary in which a byte in front moves every border to its right."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"ba": 257}
    bpe = bb.Bpe({**ranks, b"ba": 256, b"ab": 257}, leaf=1)
    assert bpe.tree(b"ab" * 40 + b"a") == bpe.merged(b"ab" * 40 + b"a") == [b"a"] + [b"ba"] * 40
    right = bpe.merged(b"b" + b"ab" * 30)
    assert bpe.join([b"a"], right) == bpe.merged(b"ab" + b"ab" * 30)


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_ids_equal_the_library(text):
    ids = [i for s in SPLIT.segments(text) for m in SPLIT.matches(s) for i in BPE.encode(m.encode())]
    assert ids == LIBRARY.encode_ordinary(text)
    assert BPE.decode(ids) == LIBRARY.decode_bytes(ids)


def test_every_character_is_split_as_the_library_does():
    rnd = random.Random(6)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [chr(c) for c in bb.stand_ins()]
    for k in range(20):
        pool = rnd.sample(chars, 3000) + rnd.sample(odd, min(len(odd), 500)) + list("a 1'\n\t") * 200
        rnd.shuffle(pool)
        text = "".join(pool)
        assert [i for m in SPLIT.matches(text) for i in BPE.encode(m.encode())] == LIBRARY.encode_ordinary(text), k


def test_segments_cut_where_no_match_is_cut(monkeypatch):
    monkeypatch.setattr(bb, "SEGMENT", 50)
    rnd = random.Random(8)
    for _ in range(50):
        text = "".join(rnd.choice(["a", "b1", "'s", " ", "  ", "\n", "\t \n", "!", "漢"]) for _ in range(600))
        parts = list(SPLIT.segments(text))
        assert "".join(parts) == text and len(parts) > 3
        assert [m for s in parts for m in SPLIT.matches(s)] == SPLIT.matches(text)


def test_long_runs_of_one_character_take_little_time():
    import time

    began = time.perf_counter()
    for text in ("a" * 200_000, "ab" * 100_000, "漢" * 60_000, " " * 200_000 + "x"):
        ids = [i for m in SPLIT.matches(text) for i in BPE.encode(m.encode())]
        assert BPE.decode(ids) == text.encode()
    assert time.perf_counter() - began < 60


def test_query_columns_equal_the_library(spark, monkeypatch):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[4], "x", 7), (None, "no id", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    tokens = bb.encoded(docs, PATH, public_tokenizers.PATTERN)
    back = bb.decoded(tokens, PATH).collect()
    want = sorted(((i, np.array(LIBRARY.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in back), key=repr) == want
    at_once = bb.encoded(docs, PATH, public_tokenizers.PATTERN, with_decoded=True).collect()
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in at_once), key=repr) == want
    assert bb.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).collect()[0]["decoded"] is None
    assert bb.encoded(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_over_the_given_table(spark):
    found = {r["doc_id"]: r for r in bb.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(found)
    for r in rows:
        ids, got = LIBRARY.encode_ordinary(r["text"] or ""), found[r["doc_id"]]
        packed = np.array(ids, "<u4").tobytes()
        want = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == want
