"""The stored word index reads the buckets of its words and continues behind a cursor."""

import random

from tilework.operators import index


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index(spark, tmp_path):
    r, path = random.Random(1), str(tmp_path / "index")
    titles = [(i, " ".join(r.choice(["Red", "red", "Blue", "gear", "a", "Big-Box", "ÉCLAIR"]) for _ in range(r.randint(0, 4)))) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(titles, "token_id long, title string")
    index.write_index(df.filter("token_id < 200"), path)
    index.write_index(df.filter("token_id >= 200"), path)
    has = lambda t, *words: t is not None and all(w in t.lower().split() for w in words)
    told = lambda d: sorted(x["token_id"] for x in d.collect())
    assert told(index.search_index(spark, path, ["RED"])) == [i for i, t in titles if has(t, "red")]
    assert told(index.search_index(spark, path, ["red", "gear", "Red", "x"])) == [i for i, t in titles if has(t, "red", "gear")]
    assert told(index.search_index(spark, path, ["none"])) == told(index.search_index(spark, path, ["a"])) == []
    seen, after = [], None
    while page := told(index.index_page(spark, path, ["blue"], after, 17)):
        seen, after = seen + page, page[-1]
    assert seen == [i for i, t in titles if has(t, "blue")]
    plan = plan_of(index.search_index(spark, path, ["red"], 40))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "GreaterThan(token_id,40)" in plan and "EqualTo(word,red)" in plan
