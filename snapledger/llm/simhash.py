"""SimHash near-dedup: 64-bit fingerprints of 4-word shingles, linked through BK-trees over shards of the fingerprints.

Two fingerprints that differ in at most 4 bits agree in at least two of six bit blocks, so each pair of blocks
shards the distinct fingerprints without losing a link. A shard's tree has its children keyed by their Hamming
distance to the parent; a search follows only the edges whose key is within the radius of its own distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import full_text, stored, table, worker_of
from snapledger.operators.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: (first bit, bits) of the blocks; RADIUS differing bits leave two of them equal.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Fingerprints of a shard tree at most, and fingerprints searched for at once.
TREE = 8192
QUERIES = 512
#: Rows that a task gathers, whole shards at a time, before it builds their trees.
FOREST = 60_000


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as an unsigned number; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_of("simhash")
    for b in batches:
        found = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and fp (the fingerprint as a signed long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), full_text(text_col).alias("_text")).mapInArrow(
        _fingerprints, f"_id {kind}, fp bigint"
    )


def build_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees over the distinct fingerprints of each shard, level by level.

    Returns the root of each shard (shards are numbered from 0, in order), and the edges as sorted keys
    parent * 65 + distance with the child of each.
    """
    roots = np.full(int(shard.max()) + 1, -1)
    keys, children = [], []
    items, subtree, parent_key = np.arange(len(fp)), shard, None
    while len(items):
        order = np.argsort(subtree, kind="stable")
        items, subtree = items[order], subtree[order]
        first = np.r_[True, subtree[1:] != subtree[:-1]]
        nodes = items[first]
        if parent_key is None:
            roots[subtree[first]] = nodes
        else:
            keys.append(subtree[first])
            children.append(nodes)
        node_of = nodes[np.cumsum(first) - 1]
        distance = np.bitwise_count(fp[items] ^ fp[node_of]).astype(np.int64)
        rest = ~first
        items, subtree, parent_key = items[rest], node_of[rest] * 65 + distance[rest], True
    if not keys:
        return roots, np.empty(0, np.int64), np.empty(0, np.int64)
    keys, children = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(keys, kind="stable")
    return roots, keys[order], children[order]


def search_forest(
    roots: np.ndarray, keys: np.ndarray, children: np.ndarray, fp: np.ndarray, shard: np.ndarray, wanted: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index into wanted, node) within the radius, a block of queries at a time.

    From a node at distance d only edges with keys from d - radius to d + radius can lead to a match.
    """
    for start in range(0, len(wanted), QUERIES):
        query = np.arange(start, min(start + QUERIES, len(wanted)))
        node = roots[shard[query]]
        query, node = query[node >= 0], node[node >= 0]
        while len(query):
            distance = np.bitwise_count(wanted[query] ^ fp[node]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(keys, node * 65 + np.maximum(distance - radius, 1), "left")
            high = np.searchsorted(keys, node * 65 + np.minimum(distance + radius, 64), "right")
            n = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            query, node = np.repeat(query, n), children[at]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (smallest index of each class) after linking a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def shard_links(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius inside each shard: a star for each class, never all pairs.

    side 0 holds what the shard's tree is made of, side 1 what is only searched for; a shard with no side 1
    searches its own tree.
    """
    n = len(fp)
    both = np.zeros(int(shard.max()) + 1, bool)
    both[shard[side == 1]] = True
    tree = np.flatnonzero(side == 0)
    asked = np.flatnonzero((side == 1) | ~both[shard])
    label = np.arange(n)
    if len(tree) and len(asked):
        known = np.full(int(shard.max()) + 1, -1)
        roots, keys, children = build_forest(shard[tree], fp[tree])
        known[: len(roots)] = roots
        for q, node in search_forest(known, keys, children, fp[tree], shard[asked], fp[asked], radius):
            label = join_labels(label, asked[q], tree[node])
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, key, a, b, side, fp), sorted by shard, to links."""
    held: list[np.ndarray] = []
    size = 0

    def out(rows: np.ndarray) -> pa.RecordBatch:
        change = (rows[1:, :4] != rows[:-1, :4]).any(1)
        shard = np.r_[0, np.cumsum(change)]
        x, y = shard_links(shard, rows[:, 4], rows[:, 5].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1))
        size += b.num_rows
        if size >= FOREST:
            rows = np.ascontiguousarray(np.concatenate(held))
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield out(rows[:cut])
            held, size = [rows[cut:]], len(rows) - cut
    if size:
        yield out(np.concatenate(held))


def block_value(fp: Column, block: tuple[int, int]) -> Column:
    start, bits = block
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1))


def fingerprint_links(distinct: DataFrame, tree_size: int = TREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within RADIUS.

    A shard is (pair of blocks, value of both). A shard of more than tree_size fingerprints is dealt into chunks by
    hash, each with a tree of its own; the tree of a chunk is sent to every other chunk's queries, so that neither a
    tree nor a task grows with the group.
    """
    pairs = [
        F.struct(
            F.lit(k).alias("band"),
            (F.shiftleft(block_value(F.col("fp"), BLOCKS[i]), 11) + block_value(F.col("fp"), BLOCKS[j])).alias("key"),
        )
        for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    sharded = distinct.select("fp", F.explode(F.array(*pairs)).alias("s")).select("fp", "s.band", "s.key")
    sizes = sharded.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / tree_size).alias("chunks"), F.count(F.lit(1)).alias("n"))
    dealt = (
        sharded.join(sizes.where("n > 1").drop("n"), ["band", "key"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    )
    rows = dealt.select(
        "band",
        "key",
        F.least("chunk", "other").alias("a"),
        F.greatest("chunk", "other").alias("b"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"),
        "fp",
    )
    keys = ["band", "key", "a", "b"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links, "a bigint, b bigint")


def classes_of(fps: DataFrame) -> DataFrame:
    """fp, component and component_id (smallest _id of the component) of the distinct fingerprints of fps (_id, fp)."""
    nodes = stored(fps.groupBy("fp").agg(F.min("_id").alias("root")), "simhash-nodes")
    links = connected_components(fingerprint_links(nodes.select("fp")))
    member = nodes.join(links.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    smallest = member.groupBy("component").agg(F.min("root").alias("component_id"))
    return member.join(smallest, "component").select("fp", "component", "component_id")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id it can reach).

    Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are one node, so
    copies cost nothing in the search. Rows that repeat an id keep their own fingerprint; null ids never become a
    component_id unless a class has no other. A text of any length is hashed whole; further columns are ignored. An empty table
    gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col), "simhash")
    return fps.join(classes_of(fps).drop("component"), "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one for each component: that with the smallest id. Their columns stay as they are.

    Of rows with that id the one with the smallest hash of all its columns stays (of rows that are equal throughout any); a row
    without an id stays only where no row of the component has one. The choice is made on ids and hashes alone, and whole rows
    move once, to meet it. Columns may have any name and type; null and empty texts have fingerprint zero and are near copies of
    one another; a text of any length counts whole; an empty table stays empty.
    """
    named = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    hashed = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if "map<" in f.dataType.simpleString() else c for c, f in zip(named, docs.schema, strict=True)]
    whole = docs.select(
        F.struct(*named).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.xxhash64(*hashed).alias("key"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
    )
    fps = stored(fingerprints(whole.select(F.struct("id", "key").alias("_id"), F.col("text").alias("_text")), "_id", "_text"), "simhash-rows")
    classes = classes_of(fps.select(F.col("_id.id").alias("_id"), "fp")).withColumnRenamed("component_id", "_keep")
    mine = fps.join(classes, "fp").where(F.col("_id.id").eqNullSafe(F.col("_keep")))
    chosen = mine.groupBy("component").agg(F.min("_id").alias("_id")).select(
        F.coalesce(F.col("_id.id").cast("string"), F.lit("")).alias("name"), F.col("_id.key").alias("key")
    )
    kept = whole.select("row", "name", "key").join(chosen, ["name", "key"], "left_semi").dropDuplicates(["name", "key"])
    return kept.select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
