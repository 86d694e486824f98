"""The timeline on disk against a sorted list, and how many files a page opens."""

import random

import pytest

from attesta.operators import timelinestore as store

TYPES = "sort double, id long, name string"


def events(seed, n, first):
    rng = random.Random(seed)
    return [(float(rng.randrange(2000)), first + i, f"e{rng.randrange(9)}") for i in range(n)]


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_pages_to_the_end(spark, tmp_path, few_partitions):
    path, rows = str(tmp_path / "t"), events(1, 3000, 0)
    frame = spark.createDataFrame([*rows, (None, 9, "undated")], TYPES)
    store.append(frame, path)
    got, after = [], None
    while True:
        files = store.files_of_page(spark, path, after, 400)
        page = [tuple(r) for r in store.page(spark, path, TYPES, after, 400).collect()]
        if not page:
            break
        assert 1 <= len(files) <= 3
        got += page
        after = page[-1][:2]
    assert got == sorted(rows)
    assert len(store.files_of_page(spark, path, (1990.0, 0), 400)) <= 2


def test_an_evidence_is_added_without_a_rewrite(spark, tmp_path, few_partitions):
    path, one, two = str(tmp_path / "t"), events(1, 1200, 0), events(2, 900, 5000)
    store.append(spark.createDataFrame(one, TYPES), path)
    files = {r[0]: r[1] for r in store._bounds(spark, path).select("file", "n").collect()}
    store.append(spark.createDataFrame(two, TYPES), path)
    after_add = {r[0]: r[1] for r in store._bounds(spark, path).select("file", "n").collect()}
    assert files.items() <= after_add.items() and sum(after_add.values()) == 2100
    every, after = sorted(one + two), (700.0, 0)
    want = [r for r in every if r[:2] > after][:300]
    assert [tuple(r) for r in store.page(spark, path, TYPES, after, 300).collect()] == want
    store.merge(spark, path, TYPES, str(tmp_path / "u"))
    assert [tuple(r) for r in store.page(spark, str(tmp_path / "u"), TYPES, after, 300).collect()] == want
    assert len(store.files_of_page(spark, str(tmp_path / "u"), after, 300)) <= 3


def test_a_batch_without_bounds_does_not_count(spark, tmp_path):
    path, rows = str(tmp_path / "t"), events(3, 50, 0)
    batch = store.append(spark.createDataFrame(rows, TYPES), path)
    spark.createDataFrame(events(4, 50, 100), TYPES).write.parquet(f"{path}/events/batch=half")
    assert [tuple(r) for r in store.page(spark, path, TYPES, None, 500).collect()] == sorted(rows)
    assert store.whole(spark, path, TYPES).count() == 50 and batch != "half"
    assert store.page(spark, path, TYPES, (1e12, 0), 10).count() == 0
