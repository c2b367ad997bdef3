import random
import zlib

import pytest
from pyspark.sql import functions as F

from snapledger.llm import decontaminate as dc
from snapledger.llm.common import in_training
from snapledger.llm.language_id import identify, known_language
from snapledger.llm.quality_knn import quality

LANGS = {"aa": "the of and to in is you that it he was for on are".split(), "bb": "der die und den von das mit sich auf für ist".split(), "cc": "el la que en los del las por con una su".split()}


def documents(n=360, seed=2, compound=1):
    """Rows (id, text, lang or None, good, true lang); words are made of `compound` parts of the language."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(LANGS))
        words = ["".join(rnd.choice(LANGS[lang]) for _ in range(compound)) for _ in range(rnd.randrange(5, 60))]
        good = rnd.random() < 0.7
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), lang if rnd.random() < 0.9 else None, int(good), lang))
    return rows


def test_training_rows_are_two_thirds(spark):
    got = spark.range(300).select("id", in_training("id").alias("t")).collect()
    assert all(r["t"] == (zlib.crc32(str(r["id"]).encode()) % 3 != 1) for r in got)


def test_language_of_held_out_texts(spark):
    rows = documents()
    truth = {r[0]: r[4] for r in rows}
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 456 !?", "cc"), (1004, "²", "cc"), (1005, "½ ① 12", "aa"), (1006, "Ⅳ", None), (1003, "the of and " * 3000, None)]
    docs = spark.createDataFrame([r[:3] for r in rows] + odd + [rows[0][:3]], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 80 and sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.98
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == 0
    kept = known_language(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(truth) | {1003}


def test_language_without_training_rows(spark):
    none = spark.createDataFrame([(1, "the of", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in identify(none).collect()] == [("und", 0.0)]
    assert identify(none.limit(0)).collect() == []


def test_quality_of_held_out_texts(spark):
    rows = documents(600, 9, 3)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(5000, None, None), (5001, "zzz", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows if r[0] % 2] + [(1, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality(docs.withColumn("quality", F.lit(0)), labels).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert sum(got[r[0]]["predicted"] == r[3] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r["score"], r["predicted"]) for r in quality(docs, labels).collect()] == [(0.5, 1)]


def brute_tiles(item, doc, least):
    """Greedy string tiling by trying all pairs."""
    used_i, used_d, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] >= 0 and i + n not in used_i and j + n not in used_d:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        tiles.append((i, j, n))
        used_i.update(range(i, i + n))
        used_d.update(range(j, j + n))


@pytest.mark.parametrize("seed", range(40))
def test_tiling_equals_brute_force(seed):
    rnd = random.Random(seed)
    item = [rnd.randrange(4) for _ in range(rnd.randrange(0, 25))]
    doc = [rnd.choice([-1, 0, 1, 2, 3]) for _ in range(rnd.randrange(0, 40))]
    if seed % 2 and item:
        doc[3:3] = item[len(item) // 2 :] + [-1] + item[: len(item) // 2]
    got = dc.greedy_tiles(item, doc, 3)
    assert [n for *_, n in got] == [n for *_, n in brute_tiles(item, doc, 3)]
    assert all(item[i : i + n] == doc[j : j + n] for i, j, n in got)
    for side, length in ((0, len(item)), (1, len(doc))):
        spans = [k for t in got for k in range(t[side], t[side] + t[2])]
        assert len(spans) == len(set(spans)) <= length


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def leak_rows():
    words = ITEM.split()
    return [
        (1, f"before {ITEM} after"), (2, "x " + " ".join(words[7:]) + " y z " + " ".join(words[:7])), (3, ITEM.upper().replace(" ", ", ")), (4, " ".join(words[:6]) + " and so on"),
        (5, "nothing of the kind here at all"), (6, None), (7, ""), (8, f"{'pad ' * 9000}{ITEM}"), (9, "tiny item"), (10, " ".join(words[::-1])), (10, f"{ITEM} {ITEM}"),
    ]


def test_leaks_are_found_and_clean_documents_stay(spark):
    docs = spark.createDataFrame(leak_rows(), "doc_id long, text string").withColumn("coverage", F.lit("clash"))
    items = spark.createDataFrame([(100, ITEM), (101, "tiny item"), (102, None), (103, "?!")], "item_id long, text string")
    got = dc.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["covered_tokens"]) for r in got) == [(1, 100, 14), (2, 100, 14), (3, 100, 14), (8, 100, 14), (9, 101, 2), (10, 100, 14)]
    clean = dc.without_leaks(docs, items)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [4, 5, 6, 7, 10]
    assert dc.leaks(docs, items.limit(0)).collect() == [] and dc.leaks(docs.limit(0), items).collect() == []


def test_a_large_benchmark_goes_out_in_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{i} " + " ".join(f"q{i}x{k}" for k in range(9))) for i in range(20)], "doc_id long, text string")
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    monkeypatch.setattr(dc, "SHARD_BYTES", 100)
    shards = list(dc.benchmark_shards(items, "item_id", "text", 5, 100))
    assert len(shards) > 3
    found = {n for s in shards for n in s.value.names}
    assert found == set(range(20))


@pytest.mark.parametrize("item,doc", [([1] * 400, [1] * 16000), ([1] * 400, ([1] * 300 + [2]) * 54), ([1, 2] * 200, [1, 2] * 8000)])
def test_repeated_tokens_take_little_time(item, doc):
    import time

    began = time.perf_counter()
    tiles = dc.greedy_tiles(item, doc)
    assert time.perf_counter() - began < 6 and sum(n for *_, n in tiles) == 400
    small = item[:40], doc[:200]
    assert dc.greedy_tiles(*small) == brute_tiles(*small, dc.MIN_MATCH)


def test_document_of_repeated_tokens_is_tiled_whole(spark):
    docs = spark.createDataFrame([(1, "0 " * 16_000), (2, "other words " * 40), (3, "x " + "0 1 " * 300)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "0 " * 400)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in dc.without_leaks(docs, benchmark).collect()) == [2, 3]
