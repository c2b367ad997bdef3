"""Groups of rows that are alike come to their job without Python, and to what the rows one after the other come to."""

import random
from datetime import timedelta

import test_observe as one
from pyspark.sql import functions as F

from snapledger.operators import observe as ob


def rows_of(rnd, n, start):
    """Rows of n postings, one to four each, that differ in what a source may change; of some the company's name or the native id, too."""
    out = []
    for k in range(n):
        native, company, url = rnd.choice(["", f"m{k}"]), rnd.choice(["Acme", "Globex"]), rnd.choice(["", f"https://y.example/{k}", f"https://y.example/{k}"])
        for _ in range(rnd.randrange(1, 5)):
            i = start + len(out)
            maybe = lambda x: rnd.choice([x, "", None])
            out.append((
                i, f"s{k % 3}", native if rnd.random() < 0.9 else "", company if rnd.random() < 0.9 else f"{company}, Inc.", f"Engineer {k}", "Berlin", maybe(f"c{i}"), maybe(f"e{i}"), maybe(f"v{i}"), maybe(f"d{i}"),
                url, one.START + timedelta(days=i) if rnd.random() < 0.4 else None, one.START + timedelta(hours=rnd.randrange(999)), rnd.choice([0, 10, 20, 30]), rnd.random() < 0.3,
            ))
    return out


def observed(spark, batches, monkeypatch, plain=True):
    """The tables after all batches, and how many groups were plain; in the second batch some stored jobs have lost their links."""
    numbers, alike, whole = [], ob._alike, ob._whole
    with monkeypatch.context() as m:
        m.setattr(ob, "_whole", lambda groups: (numbers.append(groups.count()), whole(groups))[1])
        if not plain:
            m.setattr(ob, "_alike", lambda *a: alike(*a).withColumn("plain", F.lit(False)))
        state = ob.empty_state(spark)
        for rows in batches:
            batch = spark.createDataFrame(rows, one.SCHEMA)
            state = ob.observe(batch, state, one.canonical(), ["seq"], "p1", one.target())
            state.pop("conflicts")
            state["jobs"] = state["jobs"].withColumn("link_state", F.when(F.col("title").endswith("3"), "gone").otherwise(F.col("link_state")))
    return {k: df.withColumn("native_sources", F.sort_array("native_sources")).collect() if k == "jobs" else df.collect() for k, df in state.items()}, numbers


def test_groups_of_rows_alike_come_to_what_single_rows_do(spark, monkeypatch):
    first, second = rows_of(random.Random(3), 40, 0), rows_of(random.Random(4), 50, 1000)
    got, numbers = observed(spark, [first, second], monkeypatch)
    want, none = observed(spark, [first, second], monkeypatch, plain=False)
    assert min(numbers) > 10 and none == [0, 0]
    for name, rows in want.items():
        assert sorted(map(repr, got[name])) == sorted(map(repr, rows)), name
    assert {"gone", "unchecked"} == {r["link_state"] for r in got["jobs"]}
    jobs, owner, provenance, deliveries, _ = one.replay(first + second)
    assert len(jobs) == len(got["jobs"]) and len(owner) == len(got["identities"]) and len(provenance) == len(got["provenance"]) and len(deliveries) == len(got["deliveries"])


def test_rows_alike_enter_no_python(spark, monkeypatch):
    def work(*_):
        def fail(rows, held):
            raise AssertionError("worked through row by row")

        return fail

    monkeypatch.setattr(ob, "_work", work)
    row = lambda i, k, at: (i, f"s{k % 3}", "", "Acme", f"Engineer {k}", *[None] * 5, f"https://y.example/{k}", None, one.START + timedelta(days=at), 10 * (1 + at % 2), False)
    batches = [[row(100 * at + k, k, at) for at in days for k in range(20)] for days in ((0, 1, 2), (3, 4))]
    state = ob.empty_state(spark)
    for rows in batches:
        state = ob.observe(spark.createDataFrame(rows, one.SCHEMA), state, one.canonical(), ["seq"], "p1", one.target())
    one.check(state, one.replay(batches[0] + batches[1]))
