"""Open listings kept in buckets by micro-batches."""

import os
import random

import pytest

from tilework.operators import catalog
from tilework.streaming import listings

SCHEMA = "token_id long, block long, log_index int, kind string, amount decimal(38,0), actor string"


def events(r, n, tokens, first):
    return [(r.randrange(tokens), first + i, 0, r.choice(["listed", "listed", "cancelled", "bought", "other"]), r.randrange(100), f"a{r.randrange(5)}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*x[:4], __import__("decimal").Decimal(x[4]), x[5]) for x in rows], SCHEMA)


def told(df):
    return sorted((r["token_id"], int(r["price"]), r["seller"]) for r in df.collect())


def written(path, n):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{path}/data/{n}") for f in names)


@pytest.mark.parametrize("buckets", [1, 16])
def test_batches_in_any_order_end_as_the_batch_job(spark, tmp_path, buckets):
    r, path = random.Random(buckets), str(tmp_path)
    rows = events(r, 300, 40, 0)
    r.shuffle(rows)
    for n in range(5):
        listings.write_batch(frame(spark, rows[n::5]), n, path, buckets)
        seen = [x for m in range(n + 1) for x in rows[m::5]]
        assert told(listings.current_listings(spark, path)) == told(catalog.listings_from_events(frame(spark, seen)))
    assert sorted(os.listdir(f"{path}/manifests"))[-2:] == ["3.json", "4.json"] and len([f for f in os.listdir(f"{path}/manifests") if f.endswith(".json")]) == 2


def test_a_batch_that_failed_is_tried_again(spark, tmp_path):
    r, path = random.Random(3), str(tmp_path)
    rows = events(r, 120, 20, 0)
    listings.write_batch(frame(spark, rows[:60]), 0, path, 8)
    os.makedirs(f"{path}/data/1/bucket=3")  # what a try without a manifest leaves
    with open(f"{path}/data/1/bucket=3/part-0.parquet", "w") as f:
        f.write("half a file")
    before = told(listings.current_listings(spark, path))
    assert before == told(catalog.listings_from_events(frame(spark, rows[:60])))
    for _ in range(2):  # the second time after its manifest, as a repeated batch comes
        listings.write_batch(frame(spark, rows[60:]), 1, path, 8)
        assert told(listings.current_listings(spark, path)) == told(catalog.listings_from_events(frame(spark, rows)))


def test_bytes_follow_the_batch_not_the_state(spark, tmp_path):
    path = str(tmp_path)
    state = [(t, t, 0, "listed", t, "a") for t in range(20_000)]
    listings.write_batch(frame(spark, state), 0, path, 64)
    listings.write_batch(frame(spark, [(5, 30_000, 0, "listed", 1, "b"), (6, 30_001, 0, "bought", 1, "b")]), 1, path, 64)
    assert len([b for b in os.listdir(f"{path}/data/1") if b.startswith("bucket=")]) <= 2
    assert written(path, 1) < written(path, 0) / 16
    assert len(listings.current_listings(spark, path).collect()) == 19_999


def test_files_that_nothing_names_go(spark, tmp_path):
    path = str(tmp_path)
    for n in range(6):
        listings.write_batch(frame(spark, [(t, 10 * n + t, 0, "listed", n, "a") for t in range(10)]), n, path, 2)
    assert sorted(os.listdir(f"{path}/data")) == ["4", "5"]
    assert {p for _, p, _ in told(listings.current_listings(spark, path))} == {5}
    assert {p for _, p, _ in told(listings.current_listings(spark, path, 4))} == {4}


def test_empty(spark, tmp_path):
    path = str(tmp_path)
    assert told(listings.current_listings(spark, path)) == []
    listings.write_batch(frame(spark, [(1, 1, 0, "other", 1, "a")]), 0, path)
    assert told(listings.current_listings(spark, path)) == []
