import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from snapledger.llm import simhash as sh
from snapledger.llm.exact_dedup import exact_dedup
from snapledger.operators.components import connected_components

WORDS = [f"w{i}" for i in range(300)]


def corpus():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([1, 3, 4, 40, 90]))) for _ in range(60)]
    rows = []
    for i in range(240):
        t = rnd.choice(texts)
        if rnd.random() < 0.4:
            words = t.split()
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            t = " ".join(words)
        rows.append((i, t.upper() if rnd.random() < 0.2 else t))
    hot = texts[3]
    rows += [(1000 + i, hot) for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "w1  w2\tw3"), (2004, "w1 w2 w3"), (2005, " ".join(WORDS * 60)), (7, rows[7][1])]
    rnd.shuffle(rows)
    return rows


def test_exact_dedup_equals_brute_force(spark):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).repartition(7)
    got = exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_exact_dedup_of_nothing_and_null_ids(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = exact_dedup(spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (-1, 3, False), (3, 3, True)]


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {f: f for f in set(fps)}
    nodes = sorted(label)
    changed = True
    near = {a: [b for b in nodes if (a ^ b).bit_count() <= 4] for a in nodes}
    while changed:
        changed = False
        for a in nodes:
            low = min(label[b] for b in near[a])
            if low < label[a]:
                label[a], changed = low, True
    return label


def test_simhash_equals_brute_force(spark):
    rows = corpus()
    fp = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(fp)
    smallest = {}
    for (i, _), f in zip(rows, fp, strict=True):
        smallest[label[f]] = min(i, smallest.get(label[f], i))
    want = sorted((i, f"{f:016x}", smallest[label[f]]) for (i, _), f in zip(rows, fp, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).repartition(5)
    got = sh.simhash_classes(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == want
    kept = sh.near_distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(smallest.values())


def test_hash_is_that_of_the_engine(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("ä b")).alias("h")).first()["h"]
    assert got % 2**64 == xxhash.xxh64_intdigest("ä b".encode(), 42)


@pytest.mark.parametrize("tree", [3, 50, 8192])
def test_links_are_whole_for_any_tree_size(spark, tree):
    rnd = random.Random(tree)
    fps = {0}
    for _ in range(12):  # chains and dense groups
        f = rnd.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = sh.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), tree_size=tree)
    found = {r["node"] % 2**64: r["component"] % 2**64 for r in connected_components(links).collect()}
    want = brute_components(list(fps))
    groups = lambda label: sorted(sorted(a for a in fps if label.get(a, a) == c) for c in {label.get(a, a) for a in fps})
    assert groups(found) == groups(want)


def test_bk_forest_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fp = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), base ^ np.uint64(0b11111)]))
    shard = np.zeros(len(fp), np.int64)
    roots, keys, children = sh.build_forest(shard, fp)
    got = {(int(q), int(n)) for a, b in sh.search_forest(roots, keys, children, fp, shard, fp, 4) for q, n in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 4}


def test_simhash_of_nothing(spark):
    assert sh.simhash_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100), (200, 201), (201, 200), (200, 201), (300, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 300: 0, 201: 200}


def test_near_distinct_keeps_columns_of_any_name_and_type(spark):
    schema = "doc_id long, text string, _name string, _key string, name string, key long, `row` string, id string, `a.b` int, tags map<string,int>"
    rest = ("n", "k", "x", 5, "r", "i", 1)
    rows = [(1, "one two three four five", *rest, {"a": 1}), (2, "entirely other words stand here", *rest, {"a": 1}), (2, "entirely other words stand here", *rest, {"a": 2})]
    rows += [(4, None, *rest, None), (3, "", *rest, {}), (None, "no id but words of its own", *rest, {})]
    got = sh.near_distinct(spark.createDataFrame(rows, schema))
    assert got.columns == spark.createDataFrame([], schema).columns and got.dtypes == spark.createDataFrame([], schema).dtypes
    found = sorted(((r["doc_id"] or 0, r["_name"], r["_key"], r["key"], r["a.b"]) for r in got.collect()))
    assert found == [(i, "n", "k", 5, 1) for i in (0, 1, 2, 3)]
    assert sh.near_distinct(spark.createDataFrame([], schema)).collect() == []
    long = spark.createDataFrame([(1, "word " * 200_000), (2, "word " * 200_001), (3, " ".join(f"w{i}" for i in range(50_000)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in sh.near_distinct(long).collect()) == [1, 3]
