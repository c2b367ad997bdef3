"""Folders of several generations are one scan, pruned and filtered at the files."""

import pytest

from snapledger.sources.generations import Unreadable, choices, scan

LAYOUT = {
    "id": ("bigint", "id"), "country": ("string", "place.country", "country", "''"), "posted_at": ("timestamp", "posted_at", "NULL"),
    "pay": ("decimal(12,2)", "pay", "salary", "NULL"),
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("generations")
    made = {
        "old": "SELECT 1 AS id, 'x' AS unused",
        "older": "SELECT 11 AS id, 'x' AS unused",
        "next": "SELECT '2' AS id, 'SG' AS country, 12.5D AS salary",
        "new": "SELECT 3L AS id, named_struct('country', 'DE', 'city', 'Berlin') AS place, TIMESTAMP '2026-01-02' AS posted_at, CAST(7 AS DECIMAL(9,1)) AS pay, 'y' AS extra",
    }
    for name, sql in made.items():
        spark.sql(sql).write.parquet(str(root / name))
    return [str(root / n) for n in made]


def test_every_generation_is_read(spark, folders):
    rows = scan(spark, folders, LAYOUT)
    assert rows.dtypes == [("id", "bigint"), ("country", "string"), ("posted_at", "timestamp"), ("pay", "decimal(12,2)")]
    got = [(r.id, r.country, str(r.posted_at), str(r.pay)) for r in rows.orderBy("id").collect()]
    assert got == [(1, "", "None", "None"), (2, "SG", "None", "12.50"), (3, "DE", "2026-01-02 00:00:00", "7.00"), (11, "", "None", "None")]


def test_filters_and_columns_reach_the_files(spark, folders):
    plan = scan(spark, folders, LAYOUT).where("country = 'SG'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country,SG)" in plan and "unused" not in plan and "salary" not in plan and "extra" not in plan
    # the generation without the column has the constant, which the filter refuses: it is not read
    assert plan.count("FileScan parquet") == 2


def test_equal_generations_share_a_scan(spark, folders):
    plan = scan(spark, folders[:2], LAYOUT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_what_cannot_be_read_is_named(spark, folders):
    with pytest.raises(Unreadable, match="nowhere"):
        scan(spark, folders, {"nowhere": ("string", "absent", "gone")})
    assert choices(spark, spark.read.parquet(folders[2]).schema, LAYOUT)["pay"] == "CAST(salary AS decimal(12,2))"


def test_no_folders(spark):
    rows = scan(spark, [], LAYOUT)
    assert rows.count() == 0 and rows.columns == list(LAYOUT)
