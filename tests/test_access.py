"""The access expiry: segments against a plain fold, a hot key, streams out of order."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilework.functions import NEVER
from tilework.operators import access
from tilework.streaming import access as stream

SCHEMA = "model_id string, key string, plan_id int, block long, log_index int, kind string"


def log(r, n, keys, blocks, hot=0.0):
    """Events with different (block, log_index) for each key."""
    kinds = ["access_bought"] * 8 + ["access_granted", "access_revoked", "access_revoked"]
    rows, seen = [], set()
    while len(rows) < n:
        key = "hot" if r.random() < hot else f"k{r.randrange(keys)}"
        row = ("m", key, r.choice([0, 1, 2]), r.randrange(blocks), r.randrange(3), r.choice(kinds))
        if (key, *row[3:5]) not in seen:
            seen.add((key, *row[3:5]))
            rows.append(row)
    return rows


PLANS = {0: 10, 1: 500}


def plain(rows):
    """(key, block, log_index) -> expiry after it, by walking."""
    out, state = {}, {}
    for _, key, plan, block, i, kind in sorted(rows, key=lambda x: x[3:5]):
        e = state.get(key, 0)
        if kind == "access_granted":
            e = NEVER
        elif kind == "access_revoked":
            e = 0
        elif e != NEVER:
            e = max(e, block) + PLANS.get(plan, 0)
        state[key] = out[key, block, i] = e
    return out


@pytest.fixture(scope="module")
def plans(spark):
    return spark.createDataFrame([("m", p, d) for p, d in PLANS.items()], "model_id string, plan_id int, duration_blocks long")


@pytest.mark.parametrize("bounds", [[], [50.0], [1.0, 2.0, 30.0, 31.0, 200.0, 299.0], [float(b) for b in range(0, 300, 7)]])
def test_segments_as_walked(spark, plans, bounds):
    rows = log(random.Random(len(bounds)), 700, 6, 300, 0.5)
    got = access.access_history(spark.createDataFrame(rows, SCHEMA), plans, bounds).collect()
    assert {(r["key"], r["block"], r["log_index"]): int(r["expiry"]) for r in got} == plain(rows) and len(got) == len(rows)


@pytest.mark.parametrize("bounds", [[], [20.0, 77.0, 150.0, 290.0]])
def test_as_of(spark, plans, bounds):
    r = random.Random(9)
    rows = log(r, 300, 3, 300, 0.5)
    events = spark.createDataFrame(rows, SCHEMA)
    asked = [(i, "m", r.choice(["hot", "k0", "k1", "none"]), r.randrange(-5, 320)) for i in range(400)]
    requests = spark.createDataFrame(asked, "id int, model_id string, key string, block long")
    told = access.access_at(requests, access.access_history(events, plans, bounds), bounds)
    walked = plain(rows)
    for x in told.collect():
        before = max((k for k in walked if k[0] == x["key"] and k[1] <= x["block"]), key=lambda k: k[1:], default=None)
        e = walked[before] if before else 0
        assert int(x["expiry"]) == e and x["valid"] == (e == NEVER or (e >= x["block"] and e > 0))
    assert told.count() == len(asked)


def test_hot_key_is_spread(spark, plans, tmp_path):
    """A key with 90 % of the events is in as many tasks as it has ranges."""
    n = 20_000
    key = F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    rows = spark.range(n).selectExpr("'m' model_id", "id block", "0 plan_id", "0 log_index", "'access_bought' kind", "id").withColumn("key", key)
    rows.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(was, ("false", "8", "-1")):
        spark.conf.set(c, v)
    try:
        bounds = access.block_ranges(events, rows=200)
        assert 80 <= len(bounds) <= 100
        history = access.access_history(events, plans, bounds)
        sizes = [r["n"] for r in history.groupBy(F.spark_partition_id().alias("p")).agg(F.sum((F.col("key") == "hot").cast("int")).alias("n")).collect()]
        assert len(sizes) == 8 and max(sizes) < 0.35 * n and sum(sizes) == 0.9 * n
        # Blocks follow each other, so every purchase adds its whole duration.
        end = history.filter("key = 'hot'").agg(F.max_by("expiry", "block")).first()[0]
        assert int(end) == 0 + 10 * (n * 9 // 10)
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("block"))
    assert access.block_ranges(df, rows=1000) == [] and access.block_ranges(df.limit(0)) == []
    assert len(access.block_ranges(df, rows=100, most=64)) == 9
    same = df.withColumn("block", F.lit(7).cast("long"))
    assert access.block_ranges(same, rows=10) == [7.0]


# ---- the stream --------------------------------------------------------------


def stream_rows(rows):
    return [(m, k, kind, b, i, PLANS.get(p)) for m, k, p, b, i, kind in rows]


STREAM = "model_id string, key string, kind string, block long, log_index int, duration_blocks long"


def feed(spark, path, rows):
    spark.createDataFrame(stream_rows(rows), STREAM).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, lateness, **more):
    source = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(path)
    writer = stream.stream_access(source, lateness, **more).writeStream.outputMode("update").foreachBatch(stream.keep_batches(f"{out}/out"))
    query = writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/out")


def ends(rows):
    last = {}
    for (key, block, i), e in plain(rows).items():
        if key not in last or (block, i) > last[key][0]:
            last[key] = (block, i), e
    return {k: e for k, (_, e) in last.items()}


def test_shuffled_batches_end_as_the_fold(spark, tmp_path):
    """Five files of events in any order, and a restart from the checkpoint after three."""
    r = random.Random(11)
    rows = log(r, 400, 5, 2000, 0.4)
    r.shuffle(rows)
    path, out = str(tmp_path / "in"), str(tmp_path)
    for i in range(3):
        feed(spark, path, rows[i::5])
    run(spark, path, out, 3000)
    for i in range(3, 5):
        feed(spark, path, rows[i::5])
    feed(spark, path, rows[:40])  # events that come twice count once
    told = run(spark, path, out, 3000)
    assert {x["key"]: int(x["expiry"]) for x in stream.current_access(told).collect()} == ends(rows)
    assert stream.too_late(told).count() == 0


def test_what_is_past_the_bound_is_counted(spark, tmp_path):
    """Old events are folded; those that come for them go to the side output and change nothing."""
    rows = [("m", "k", 0, b, 0, "access_bought") for b in (10, 1000, 2000)]
    late = [("m", "k", 1, 5, 0, "access_bought"), ("m", "k", 0, 1500, 0, "access_revoked"), ("m", "k", 1, 900, 0, "access_granted")]
    path, out = str(tmp_path / "in"), str(tmp_path)
    feed(spark, path, rows)
    run(spark, path, out, 800)  # folds what is below block 1200
    feed(spark, path, late)
    told = run(spark, path, out, 800)
    assert {x["key"]: x["n"] for x in stream.too_late(told).collect()} == {"k": 2}
    assert {x["key"]: int(x["expiry"]) for x in stream.current_access(told).collect()} == {"k": 2010} == ends([*rows, late[1]])


def test_fold_merge_and_settle():
    a, b, c = (10, 0, "access_bought", 5), (12, 0, "access_bought", 5), (20, 1, "access_revoked", 0)
    waiting, late = stream.merge([b], [a, b, (1, 0, "access_granted", 0)], (5, 0))
    assert waiting == [a, b] and late == [(1, 0, "access_granted", 0)]
    assert stream.fold(0, [a, b]) == 20 and stream.fold(NEVER, [a]) == NEVER and stream.fold(3, [a, c]) == 0
    assert stream.settle_until(0, [a, b, c], (5, 0), 12) == (15, [b, c], (10, 0))
    assert stream.settle_until(7, [], (5, 0), 12) == (7, [], (5, 0))


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, v):
        self.held = v

    put = update

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return _Value()

    getListState = getValueState

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class _Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_idle_key_is_folded_by_its_timer():
    p, handle = stream.AccessProcessor(100, 50), _Handle()
    p.init(handle)
    frame = lambda *e: pd.DataFrame(e, columns=["block", "log_index", "kind", "duration_blocks"])
    list(p.handleInputRows(("m", "k"), iter([frame((10, 0, "access_bought", 5), (40, 0, "access_bought", 5))]), _Clock()))
    assert handle.timers == [1050] and len(p.waiting.get()) == 2
    told = next(iter(p.handleExpiredTimer(("m", "k"), _Clock(), None)))
    assert told["expiry"].tolist() == ["45"] and not p.waiting.exists()
    late = next(iter(p.handleInputRows(("m", "k"), iter([frame((30, 0, "access_revoked", 0))]), _Clock())))
    assert late["kind"].tolist() == ["state", "too_late"] and late["expiry"].tolist()[0] == "45"


class _Map:
    def __init__(self):
        self.held, self.reads, self.writes = {}, 0, 0

    def getValue(self, k):
        self.reads += 1
        return self.held.get(k)

    def updateValue(self, k, v):
        self.writes += 1
        self.held[k] = v

    def iterator(self):
        return iter(list(self.held.items()))


class _MapHandle(_Handle):
    def getMapState(self, *_):
        return _Map()


class _Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_call_serves_all_keys_of_a_bucket():
    """One call and one table for 200 keys; each key's state is read once and written once, others are left alone."""
    p, handle = stream.BucketProcessor(100, 50), _MapHandle()
    p.init(handle)
    names = ["model_id", "key", "block", "log_index", "kind", "duration_blocks"]
    frame = lambda *e: pd.DataFrame(e, columns=names)
    first = frame(*[("m", f"k{i}", b, 0, "access_bought", 5) for b in (10, 40) for i in range(200)])
    told = list(p.handleInputRows((3,), iter([first[:150], first[150:]]), _Clock()))
    assert len(told) == 1 and told[0]["expiry"].tolist() == ["45"] * 200 and (p.keys.reads, p.keys.writes) == (200, 200)
    assert handle.timers == [1050]
    told = list(p.handleInputRows((3,), iter([frame(("m", "k7", 500, 1, "access_granted", 0), (None, None, 1, 0, "access_revoked", 0))]), _Clock()))
    assert told[0]["expiry"].tolist() == [str(NEVER), "0"] and (p.keys.reads, p.keys.writes) == (202, 202)
    assert list(p.handleExpiredTimer((3,), _Clock(), _Expired(1049)))[0].empty  # set before these keys' batch
    folded = list(p.handleExpiredTimer((3,), _Clock(), _Expired(1050)))[0]
    assert len(folded) == 201 and all(not v[5] for v in p.keys.held.values())
    assert list(p.handleExpiredTimer((3,), _Clock(), _Expired(2000)))[0].empty  # each key once
    late = list(p.handleInputRows((3,), iter([frame(("m", "k1", 30, 0, "access_revoked", 0))]), _Clock()))[0]
    assert late["kind"].tolist() == ["state", "too_late"] and late["expiry"].tolist()[0] == "45"


@pytest.mark.parametrize("buckets", [1, 7, None])
def test_buckets_change_nothing(spark, tmp_path, buckets):
    """Whatever the buckets, also for a null key: the fold's end and the events that came too late."""
    rows = [*log(random.Random(5), 150, 4, 900, 0.3), ("m", None, 0, 5, 0, "access_bought")]
    path, out = str(tmp_path / "in"), str(tmp_path)
    feed(spark, path, rows)
    run(spark, path, out, 50, buckets=buckets)
    feed(spark, path, [("m", "hot", 1, 1, 2, "access_granted")])
    told = run(spark, path, out, 50, buckets=buckets)
    assert {x["key"]: int(x["expiry"]) for x in stream.current_access(told).collect()} == ends(rows)
    assert {x["key"]: x["n"] for x in stream.too_late(told).collect()} == {"hot": 1}
