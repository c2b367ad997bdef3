import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from snapledger.llm import registry
from snapledger.llm.common import stored
from snapledger.llm.decontaminate import Benchmark
from snapledger.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), f"test-{name}"))
    return tables


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "token_output"]
    assert all(t.columns == stages[0].columns for t in stages[1:5])


def test_near_dedup_keeps_one_of_each_group(stages):
    rows = stages[1].select("doc_id", "text").collect()
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            low = min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 4)
            if low < label[i]:
                label[i], changed = low, True
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(set(label.values()))


def test_decontamination_drops_leaks_and_nothing_else(spark, stages):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    b = Benchmark.of([(r["item_id"], r["text"]) for r in items], 5)
    want = sorted(r["doc_id"] for r in stages[2].collect() if not list(b.leaks(r["text"], 0.5)))
    assert sorted(r["doc_id"] for r in stages[3].collect()) == want
    assert len(want) < stages[2].count()


def test_mixing_keeps_most_good_documents(spark, stages):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    before = stages[3].join(good, "doc_id", "left_semi").count()
    after = stages[4].join(good, "doc_id", "left_semi").select("doc_id").distinct().count()
    assert after > 0.9 * before


def test_token_files_hold_the_mixture(stages):
    got = stages[5].orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert stages[5].agg(F.sum("n_tokens")).first()[0] == got[-1]["start"] + got[-1]["n_tokens"]


def test_every_operator_is_registered():
    names = registry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(names)
