"""Training, scoring and evaluation over lineitem, orders and embeddings."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tilework.functions import INT32_MAX, argmax, js_round, linear_bin, quantize, sigmoid
from tilework.operators import boost, evaluate, explain, job, model, predict, search, split
from tilework.operators.binning import best_split, cumulative_bins
from tilework.operators.model import Ensemble, Tree
from tilework.plans.tables import FEATURES, LINES_SQL, lines, table
from tilework.sources import models as files
from tilework.sources.delimited import vector_source
from tilework.sources.shared import shared_dir

WIDTH = 64  # elements of embeddings.embedding
PARAMS = boost.Params(trees=3, depth=2, lr=0.3, early_stop=False)


def split_lines(spark, d):
    return split.seeded_split(lines(spark, d).select("row_id", *FEATURES, F.col("charge").alias("y")), "row_id")


def buckets(df):
    return df.withColumn("y", F.when(F.col("y") < 20000, 0).when(F.col("y") < 50000, 1).otherwise(2))


def flagship(spark, d):
    """Split, train three trees on the charge, score all rows, loss by split."""
    rows = split_lines(spark, d)
    run = boost.train_regression(rows, FEATURES, PARAMS)
    return evaluate.evaluate(rows, run.ensemble)


def _curve(spark, run):
    return run.curve_table(spark).withColumn("value", F.round("value", 6))


def m_train_regression(spark, d):
    return _curve(spark, boost.train_regression(split_lines(spark, d), FEATURES, PARAMS))


def m_train_binary(spark, d):
    rows = split_lines(spark, d).withColumn("y", (F.col("y") > 40000).cast("int"))
    return _curve(spark, boost.train_binary(rows, FEATURES, boost.Params(trees=3, depth=2, lr=0.3, weights=(1.0, 2.0), early_stop=False)))


def m_train_multiclass(spark, d):
    rows = vector_source(table(spark, d, "embeddings"), "embedding", WIDTH, ("vec_id", "label")).withColumnRenamed("label", "y")
    rows = split.stratified_split(rows, "vec_id", "y")
    return _curve(spark, boost.train_multiclass(rows, [f"f{i}" for i in range(WIDTH)], 10, boost.Params(trees=2, depth=2, lr=0.3, early_stop=False)))


def m_train_multilabel(spark, d):
    rows = split_lines(spark, d).withColumn("labels", F.array((F.col("l_quantity") > 25).cast("int"), (F.col("y") > 40000).cast("int")))
    p = boost.Params(trees=2, depth=2, lr=0.3, binning="quantile", early_stop=False)
    return _curve(spark, boost.train_multilabel(rows, FEATURES, 2, p, row_id="row_id"))


def m_importance(spark, d):
    rows = split_lines(spark, d).withColumn("y", (F.col("y") > 40000).cast("int"))
    ensemble = boost.train_binary(rows, FEATURES, PARAMS).ensemble
    _, trees = ensemble.tables(spark)
    usage = explain.split_usage(model.nodes_table(trees))
    names = F.array(*[F.lit(c) for c in FEATURES])
    usage = usage.select(F.element_at(names, F.col("feature") + 1).alias("feature"), "splits")
    gain = explain.permutation_importance(rows.filter("split = 'test'"), ensemble, "row_id").join(usage, "feature", "left")
    return explain.rank_features(gain.fillna(0, ["splits"])).select("feature", "splits", "place", "tag")


def m_pca(spark, d):
    rows = vector_source(table(spark, d, "embeddings"), "embedding", WIDTH, ("vec_id",))
    return explain.pca3(rows, [f"f{i}" for i in range(WIDTH)], "vec_id")


def m_correlations(spark, d):
    """Correlations of all pairs of columns by one mergeable pass; a row with a missing value is left out."""
    rows = lines(spark, d).withColumn("l_tax", F.when(F.col("l_partkey") % 17 != 0, F.col("l_tax")))
    return explain.correlations(rows, [*FEATURES, "charge"]).select("left", "right", F.round("r", 6).alias("r"))


M_CORRELATIONS = f"""WITH {LINES_SQL}, v AS (SELECT * FROM lines WHERE l_partkey % 17 <> 0)
""" + " UNION ALL ".join(f"SELECT '{a}' AS left, '{b}' AS right, round(corr({a}, {b}), 6) AS r FROM v" for i, a in enumerate([*FEATURES, "charge"]) for b in [*FEATURES, "charge"][i + 1 :])


def m_scatter(spark, d):
    return explain.scatter3(lines(spark, d), "row_id", FEATURES[:3], "charge", 1000, 3)


M_SCATTER = f"WITH {LINES_SQL} SELECT row_id, l_quantity AS x, l_extendedprice AS y, l_discount AS z, charge AS target FROM lines ORDER BY md5('3:' || row_id), row_id LIMIT 1000"


def m_search(spark, d):
    rows = split_lines(spark, d)
    _, trials = search.search(rows, FEATURES, "regression", boost.Params(trees=2, depth=1, lr=0.3), rounds=2, cap_trees=2)
    return search.trial_page(trials, 0).select("round", "status", "best_iter")


def m_search_waves(spark, d):
    """Eight trials on data that are prepared once, three at a time, hopeless ones ended from their first round on."""
    rows = split_lines(spark, d)
    _, trials = search.search(rows, FEATURES, "regression", boost.Params(trees=2, depth=2, lr=0.3), rounds=8, cap_trees=2, parallel=3, end_early=1)
    return trials.select("round", "status", "best_iter", F.round("best_val", 3).alias("best_val"))


def m_refit(spark, d):
    run = search.refit(split_lines(spark, d), FEATURES, "regression", PARAMS, 2)
    return _curve(spark, run)


def k_model_round_trip(spark, d):
    """Encode, attach a package, chunk, put together, decode: the scores stay."""
    rows = split_lines(spark, d)
    ensemble = boost.train_regression(rows, FEATURES, PARAMS).ensemble
    data = files.encode_models(*ensemble.tables(spark))
    packed = files.attach_package(data.withColumn("package", F.lit('{"meta":{"v":1}}')))
    back = files.reassemble_chunks(files.chunk_blobs(packed, 64)).first()
    again, footer = files.decode(bytes(back["data"]), "model")
    again.features = FEATURES
    told = predict.predict(rows, ensemble).select("row_id", F.col("score_q")[0].alias("q"))
    same = predict.predict(rows, again).select("row_id", F.col("score_q")[0].alias("q2"))
    return told.join(same, "row_id").groupBy((F.col("q") == F.col("q2")).alias("same"), F.lit(len(footer)).alias("footer_bytes")).agg(F.count(F.lit(1)).alias("n"))


K_MODEL_ROUND_TRIP = "SELECT true AS same, CAST(28 AS INTEGER) AS footer_bytes, count(*) AS n FROM lineitem"

# ---- root of the first regression tree, by SQL -----------------------------

ROOT_SQL = f"""{LINES_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS i, count(*) OVER () AS n_all FROM lines),
sc AS (SELECT CAST(greatest(1, least(1000000, floor(2147480000 / greatest(max(abs(l_quantity)), max(abs(l_extendedprice)), max(abs(l_discount)), max(abs(l_tax)))), floor(2147480000 / max(abs(charge))))) AS BIGINT) AS s FROM lines),
tr AS (SELECT * FROM r WHERE i <= floor(n_all * 0.7)),
ba AS (SELECT CAST(floor(avg(charge) * any_value(s) + 0.5) AS BIGINT) AS base FROM tr, sc),
ft AS (
  SELECT row_id, charge, unnest([0, 1, 2, 3]) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM tr
), rg AS (SELECT feature, min(x) AS lo, max(x) - min(x) AS w FROM ft GROUP BY feature),
dr AS (SELECT feature, row_number() OVER (ORDER BY md5('42:1:0:0:' || feature)) - 1 AS draw FROM rg WHERE w > 0),
hist AS (
  SELECT feature, CAST(draw AS INTEGER) AS draw, CAST(least(greatest(floor((x - lo) / w * 32), 0), 31) AS INTEGER) AS bin,
    count(*) AS n, CAST(sum(CAST(floor(charge * s + 0.5) AS BIGINT) - base) AS BIGINT) AS g
  FROM ft JOIN rg USING (feature) JOIN dr USING (feature), sc, ba WHERE draw < 2 GROUP BY 1, 2, 3
)"""


def _root_pass(spark, d):
    rows, ensemble, _, usable, w = boost.prepare(split_lines(spark, d), FEATURES, "regression", PARAMS)
    drawn = {(0, 0): boost.drawn_features(PARAMS.seed, 1, 0, 0, usable)}
    return boost.level_pass(rows, ensemble, [[]], [Tree.blank(2)], 0, drawn, 32, w, False)


def m_root_histogram(spark, d):
    return _root_pass(spark, d).filter("kind = 0").select("feature", "draw", "bin", "n", "g")


M_ROOT_HISTOGRAM = f"WITH {ROOT_SQL} SELECT feature, draw, bin, n, g FROM hist"


def m_root_split(spark, d):
    hist = _root_pass(spark, d).filter("kind = 0")
    return best_split(hist, ["out", "node"], 5, bins=32).select("feature", "bin", F.col("nl").alias("n_left"), F.col("gl").cast("long").alias("g_left"))


M_ROOT_SPLIT = f"""WITH {ROOT_SQL}, cum AS (
  SELECT *, sum(n) OVER w AS nl, sum(g) OVER w AS gl, sum(n) OVER p AS nt, sum(g) OVER p AS gt
  FROM hist WINDOW w AS (PARTITION BY feature ORDER BY bin), p AS (PARTITION BY feature)
), sco AS (
  SELECT *, CAST(gl AS DOUBLE) * CAST(gl AS DOUBLE) / nl + CAST(gt - gl AS DOUBLE) * CAST(gt - gl AS DOUBLE) / (nt - nl) AS score FROM cum WHERE nl >= 5 AND nt - nl >= 5 AND bin < 31
)
SELECT feature, bin, CAST(nl AS BIGINT) AS n_left, CAST(gl AS BIGINT) AS g_left FROM sco ORDER BY score DESC, draw, bin LIMIT 1"""


def m_cumulative_bins(spark, d):
    hist = lines(spark, d).select("l_linenumber", linear_bin("l_quantity", 1.0, 49.0, 16).alias("bin"), F.col("l_partkey").alias("g"))
    hist = hist.groupBy("l_linenumber", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.lit(0).alias("h"))
    return cumulative_bins(hist, ["l_linenumber"]).select("l_linenumber", "bin", "nl", "gl", "nt", "gt")


M_CUMULATIVE_BINS = """WITH h AS (
  SELECT l_linenumber, CAST(least(greatest(floor((l_quantity - 1.0) / 49.0 * 16), 0), 15) AS INTEGER) AS bin, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS g FROM lineitem GROUP BY 1, 2
)
SELECT l_linenumber, bin, CAST(sum(n) OVER w AS BIGINT) AS nl, CAST(sum(g) OVER w AS BIGINT) AS gl, CAST(sum(n) OVER p AS BIGINT) AS nt, CAST(sum(g) OVER p AS BIGINT) AS gt
FROM h WINDOW w AS (PARTITION BY l_linenumber ORDER BY bin), p AS (PARTITION BY l_linenumber)"""

# ---- scoring with given trees ----------------------------------------------

SCALE = 1000


def _tree(feat, thr, leaf) -> Tree:
    return Tree(np.array(feat, np.int32), np.array(thr, np.int32), np.array(leaf, np.int32))


def given_ensemble(task: str = "regression", outputs: int = 1) -> Ensemble:
    """Two trees of depth 2 for each output; the second has a node that is not split."""
    first = _tree([0, 1, 2], [25_000, 40_000_000, 50], [-700, 300, 900, 1500])
    second = _tree([3, 0, 1], [40, INT32_MAX, 60_000_000], [10, 10, -450, 820])
    trees = [[first, second]]
    for k in range(1, outputs):
        trees.append([_tree(first.feat, first.thr, first.leaf[::-1] * k), _tree(second.feat, second.thr, second.leaf + 100 * k)])
    return Ensemble(task, 4, 2, SCALE, [50 * (k + 1) for k in range(outputs)], trees, features=FEATURES)


GIVEN_SQL = f"""{LINES_SQL}, q AS (
  SELECT row_id, charge, l_quantity, floor(l_quantity * 1000 + 0.5) AS x0, least(floor(l_extendedprice * 1000 + 0.5), 2147483647) AS x1, floor(l_discount * 1000 + 0.5) AS x2, floor(l_tax * 1000 + 0.5) AS x3 FROM lines
), lf AS (
  SELECT *, CASE WHEN x0 > 25000 THEN CASE WHEN x2 > 50 THEN 4 ELSE 3 END ELSE CASE WHEN x1 > 40000000 THEN 2 ELSE 1 END END AS a,
    CASE WHEN x3 > 40 THEN CASE WHEN x1 > 60000000 THEN 4 ELSE 3 END ELSE 1 END AS b FROM q
), given AS (
  SELECT *, 50 + [-700, 300, 900, 1500][a] + [10, 10, -450, 820][b] AS s0,
    100 + [1500, 900, 300, -700][a] + [110, 110, -350, 920][b] AS s1, 150 + [3000, 1800, 600, -1400][a] + [210, 210, -250, 1020][b] AS s2 FROM lf
)"""


def m_permutation(spark, d):
    """What each feature is worth to the given trees, on a sample of a thousand lines."""
    rows = lines(spark, d).withColumn("y", F.col("l_quantity") / 25)
    return explain.permutation_importance(rows, given_ensemble(), "row_id", 42, 1000).select("feature", F.round("delta_loss", 6).alias("delta_loss"))


M_PERMUTATION = f"""WITH {LINES_SQL}, s AS (SELECT * FROM lines ORDER BY md5('42:' || row_id), row_id LIMIT 1000),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS i FROM s),
f AS (SELECT unnest(['', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature),
d AS (SELECT feature, l_quantity, l_extendedprice, l_discount, l_tax, row_number() OVER (PARTITION BY feature ORDER BY md5('43:' || feature || ':' || row_id), row_id) AS i FROM r, f),
m AS (
  SELECT f.feature, r.l_quantity / 25 AS y, floor(CASE f.feature WHEN 'l_quantity' THEN d.l_quantity ELSE r.l_quantity END * 1000 + 0.5) AS x0,
    least(floor(CASE f.feature WHEN 'l_extendedprice' THEN d.l_extendedprice ELSE r.l_extendedprice END * 1000 + 0.5), 2147483647) AS x1,
    floor(CASE f.feature WHEN 'l_discount' THEN d.l_discount ELSE r.l_discount END * 1000 + 0.5) AS x2, floor(CASE f.feature WHEN 'l_tax' THEN d.l_tax ELSE r.l_tax END * 1000 + 0.5) AS x3
  FROM r JOIN d USING (i) JOIN f ON f.feature = d.feature
), e AS (
  SELECT feature, y, 50 + [-700, 300, 900, 1500][CASE WHEN x0 > 25000 THEN CASE WHEN x2 > 50 THEN 4 ELSE 3 END ELSE CASE WHEN x1 > 40000000 THEN 2 ELSE 1 END END]
    + [10, 10, -450, 820][CASE WHEN x3 > 40 THEN CASE WHEN x1 > 60000000 THEN 4 ELSE 3 END ELSE 1 END] AS s FROM m
), l AS (SELECT feature, avg((s / 1000.0 - y) * (s / 1000.0 - y)) AS loss FROM e GROUP BY feature)
SELECT a.feature, round(a.loss - b.loss, 6) AS delta_loss FROM l a, l b WHERE b.feature = '' AND a.feature <> ''"""


def k_model_store(spark, d):
    """From files to scores: four models and a broken file are read, stored as tables, and meet the lines that ask for them."""
    path = f"{shared_dir(spark)}/model_store/{uuid.uuid4().hex}"
    tasks = (("regression", 1), ("binary_classification", 1), ("multiclass_classification", 3), ("multilabel_classification", 3))
    data = []
    for task, outputs in tasks:
        e = given_ensemble(task, outputs)
        e.model_id = task
        package = files.package_of(task, task, FEATURES, ["a", "b", "c"][:outputs], {}, [(1, "train", "logloss", 0.5)], {})
        data.append((task, bytearray(files.encode(e)), package))
    rows = spark.createDataFrame(data, "model_id string, data binary, package string")
    files.write_model_files(files.attach_package(rows), f"{path}/files")
    files.write_model_files(rows.limit(1).select(F.lit("broken").alias("model_id"), F.substring("data", 1, 60).alias("data")), f"{path}/files")
    files.write_store(files.read_models(spark, f"{path}/files"), f"{path}/store")
    head, trees = files.read_store(spark, f"{path}/store")
    names = F.array(*[F.lit(t) for t, _ in tasks], F.lit("broken"))
    asked = lines(spark, d).select(F.col("row_id").alias("request_id"), F.element_at(names, (F.pmod("l_linenumber", F.lit(5)) + 1).cast("int")).alias("model_id"), F.when(F.col("l_quantity") <= 2, F.array(*FEATURES[:3])).otherwise(F.array(*FEATURES)).alias("features"))
    scored = predict.score_requests(asked, head, trees).join(F.broadcast(head.select("model_id", "task")), "model_id", "left")  # four rows
    return scored.select("request_id", "task", F.array_join("score_q", ",").alias("scores"), "reason")


K_MODEL_STORE = f"""WITH {GIVEN_SQL.replace('row_id, charge, l_quantity, floor', 'row_id, charge, l_quantity, l_linenumber, floor')}, m AS (
  SELECT *, l_linenumber % 5 AS k, ['regression', 'binary_classification', 'multiclass_classification', 'multilabel_classification', NULL][l_linenumber % 5 + 1] AS task FROM given
)
SELECT row_id AS request_id, task, CASE WHEN k < 4 AND l_quantity > 2 THEN CASE WHEN k < 2 THEN CAST(s0 AS VARCHAR) ELSE s0 || ',' || s1 || ',' || s2 END END AS scores,
  CASE WHEN k = 4 THEN 'unknown_model' WHEN l_quantity <= 2 THEN 'feature_count' END AS reason FROM m"""


def k_file_to_model(spark, d):
    """A file of lines with faults becomes a stored model: rows by fate and by part, and whether the file on disk scores as the run did."""
    path = f"{shared_dir(spark)}/file_to_model/{uuid.uuid4().hex}"
    label = F.when(F.col("l_orderkey") % 11 == 0, "").when(F.col("charge") > 40000, " Yes").otherwise("no")
    price = F.when(F.col("l_partkey") % 13 == 0, "12abc").otherwise(F.col("l_extendedprice").cast("string"))
    text = lines(spark, d).select("row_id", "l_quantity", price.alias("l_extendedprice"), "l_discount", "l_tax", label.alias("big"))
    text.write.csv(f"{path}/text", sep=";", header=True)
    done = job.train_file(spark, f"{path}/text", f"{path}/out", "binary_classification", ["big"], params=boost.Params(trees=2, depth=2, lr=0.3, weights="auto", early_stop=False), row_id="row_id", title="big lines")
    told = files.with_package_fields(files.read_model_packages(files.read_models(spark, f"{path}/out/files")))
    head = told.select(*files.STORED)
    r = head.first()
    again = model.from_tables(head, files.trees_of(told))[r["model_id"]]
    again.features = list(r["feature_names"])
    stored = spark.read.parquet(f"{path}/out/rows")
    key = lambda df: df.select("split", F.col("logloss").alias("loss"), F.col("accuracy").alias("acc"))
    same = key(done.losses).join(key(evaluate.evaluate(stored, again)).withColumnsRenamed({"loss": "l2", "acc": "a2"}), "split")
    fits = same.filter((F.abs(F.col("loss") - F.col("l2")) < 1e-9) & (F.col("acc") == F.col("a2")) & (F.col("loss") < 0.68)).select(F.concat(F.lit("scores alike: "), "split").alias("what"), F.lit(1).cast("long").alias("n"))
    return done.report.select(F.col("reason").alias("what"), "n").union(done.parts.select(F.concat(F.lit("part: "), "split"), "n")).union(fits)


K_FILE_TO_MODEL = f"""WITH {LINES_SQL}, t AS (
  SELECT row_id, CASE WHEN l_orderkey % 11 = 0 THEN 'bad_label' WHEN l_partkey % 13 = 0 THEN 'bad_feature' ELSE 'kept' END AS reason FROM lines
), r AS (SELECT row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS i, count(*) OVER () AS n FROM t WHERE reason = 'kept')
SELECT reason AS what, count(*) AS n FROM t GROUP BY 1
UNION ALL SELECT 'part: ' || CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END, count(*) FROM r GROUP BY 1
UNION ALL SELECT 'scores alike: ' || unnest(['train', 'val', 'test']), 1"""


def m_predict_value(spark, d):
    return predict.predict(lines(spark, d), given_ensemble()).select("row_id", F.col("score_q")[0].alias("q"), js_round(F.col("value") * 1000).alias("milli"))


M_PREDICT_VALUE = f"WITH {GIVEN_SQL} SELECT row_id, CAST(s0 AS BIGINT) AS q, CAST(s0 AS BIGINT) AS milli FROM given"


def m_predict_binary(spark, d):
    out = predict.predict(lines(spark, d), given_ensemble("binary_classification"))
    return out.select("row_id", "cls", js_round(F.col("probability") * 1e6).alias("p"))


M_PREDICT_BINARY = f"WITH {GIVEN_SQL} SELECT row_id, CAST(s0 >= 0 AS INTEGER) AS cls, CAST(floor(1 / (1 + exp(-s0 / 1000.0)) * 1e6 + 0.5) AS BIGINT) AS p FROM given"


def m_predict_classes(spark, d):
    out = predict.predict(lines(spark, d), given_ensemble("multiclass_classification", 3))
    out = predict.top_probabilities(out, 2, ["low", "mid", "high"])
    q = F.col("score_q")
    return out.select("row_id", q[0].alias("q0"), q[1].alias("q1"), q[2].alias("q2"), "cls", argmax("score_q").alias("top_cls"), F.col("top")[0]["name"].alias("first"), F.col("top")[1]["name"].alias("second"))


M_PREDICT_CLASSES = f"""WITH {GIVEN_SQL}, k AS (SELECT *, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS c FROM given),
k2 AS (SELECT *, CASE c WHEN 0 THEN CASE WHEN s1 >= s2 THEN 1 ELSE 2 END WHEN 1 THEN CASE WHEN s0 >= s2 THEN 0 ELSE 2 END ELSE CASE WHEN s0 >= s1 THEN 0 ELSE 1 END END AS e FROM k)
SELECT row_id, CAST(s0 AS BIGINT) AS q0, CAST(s1 AS BIGINT) AS q1, CAST(s2 AS BIGINT) AS q2, CAST(c AS INTEGER) AS cls, CAST(c AS INTEGER) AS top_cls,
  ['low', 'mid', 'high'][c + 1] AS first, ['low', 'mid', 'high'][e + 1] AS second FROM k2"""


def m_predict_labels(spark, d):
    out = predict.predict(lines(spark, d), given_ensemble("multilabel_classification", 3))
    return predict.positive_labels(out, ["a", "b", "c"]).select("row_id", "n_positive", F.array_join("positive", ",").alias("positive"))


M_PREDICT_LABELS = f"""WITH {GIVEN_SQL}, u AS (SELECT row_id, unnest([s0, s1, s2]) AS s, unnest(['a', 'b', 'c']) AS l FROM given)
SELECT row_id, CAST(count(*) FILTER (s >= 0) AS INTEGER) AS n_positive, coalesce(string_agg(l, ',' ORDER BY s DESC, l) FILTER (s >= 0), '') AS positive FROM u GROUP BY row_id"""


def _parts(df):
    return df.withColumn("split", F.col("l_linenumber").cast("string"))


def a_mse(spark, d):
    out = predict.predict(_parts(lines(spark, d)).withColumn("y", F.col("l_quantity") / 25), given_ensemble())
    return evaluate.mse(out).select("split", "n", F.round("mse", 6).alias("mse"))


A_MSE = f"""WITH {GIVEN_SQL.replace('row_id, charge, l_quantity, floor', 'row_id, charge, l_quantity, l_linenumber, floor')}
SELECT CAST(l_linenumber AS VARCHAR) AS split, count(*) AS n, round(avg((s0 / 1000.0 - l_quantity / 25) * (s0 / 1000.0 - l_quantity / 25)), 6) AS mse FROM given GROUP BY 1"""


def a_binary_logloss(spark, d):
    out = predict.predict(_parts(lines(spark, d)).withColumn("y", (F.col("charge") > 40000).cast("int")).withColumn("w", F.col("l_quantity")), given_ensemble("binary_classification"))
    return evaluate.binary_logloss_acc(out, weight="w").select("split", "n", F.round("logloss", 6).alias("logloss"), F.round("accuracy", 6).alias("accuracy"))


A_BINARY_LOGLOSS = f"""WITH {GIVEN_SQL.replace('row_id, charge, l_quantity, floor', 'row_id, charge, l_quantity, l_linenumber, floor')}, p AS (SELECT *, 1 / (1 + exp(-s0 / 1000.0)) AS p FROM given)
SELECT CAST(l_linenumber AS VARCHAR) AS split, count(*) AS n, round(sum(-ln(CASE WHEN charge > 40000 THEN p ELSE 1 - p END) * l_quantity) / sum(l_quantity), 6) AS logloss,
  round(avg(CAST((p >= 0.5) = (charge > 40000) AS INTEGER)), 6) AS accuracy FROM p GROUP BY 1"""


def a_class_logloss(spark, d):
    y = F.when(F.col("charge") < 20000, 0).when(F.col("charge") < 50000, 1).otherwise(2)
    out = predict.predict(_parts(lines(spark, d)).withColumn("y", y), given_ensemble("multiclass_classification", 3))
    return evaluate.multiclass_logloss_acc(out).select("split", "n", F.round("logloss", 6).alias("logloss"), F.round("accuracy", 6).alias("accuracy"))


A_CLASS_LOGLOSS = f"""WITH {GIVEN_SQL.replace('row_id, charge, l_quantity, floor', 'row_id, charge, l_quantity, l_linenumber, floor')}, y AS (
  SELECT *, CASE WHEN charge < 20000 THEN 1 WHEN charge < 50000 THEN 2 ELSE 3 END AS y, exp(s0 / 1000.0) + exp(s1 / 1000.0) + exp(s2 / 1000.0) AS z, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 1 WHEN s1 >= s2 THEN 2 ELSE 3 END AS c FROM given
)
SELECT CAST(l_linenumber AS VARCHAR) AS split, count(*) AS n, round(avg(-ln(exp([s0, s1, s2][y] / 1000.0) / z)), 6) AS logloss, round(avg(CAST(y = c AS INTEGER)), 6) AS accuracy FROM y GROUP BY 1"""


def a_label_logloss(spark, d):
    labels = F.array((F.col("l_quantity") > 25).cast("int"), (F.col("charge") > 40000).cast("int"))
    out = predict.predict(_parts(lines(spark, d)).withColumn("labels", labels), given_ensemble("multilabel_classification", 2))
    return evaluate.multilabel_logloss_acc(out, weights=[2.0, 0.5]).select("split", "n", F.round("logloss", 6).alias("logloss"), F.round("accuracy", 6).alias("accuracy"))


A_LABEL_LOGLOSS = f"""WITH {GIVEN_SQL.replace('row_id, charge, l_quantity, floor', 'row_id, charge, l_quantity, l_linenumber, floor')}, u AS (
  SELECT l_linenumber, unnest([s0, s1]) AS s, unnest([l_quantity > 25, charge > 40000]) AS y, unnest([2.0, 0.5]) AS w FROM given
), p AS (SELECT *, 1 / (1 + exp(-s / 1000.0)) AS p, CASE WHEN y THEN w ELSE 1.0 END AS rw FROM u)
SELECT CAST(l_linenumber AS VARCHAR) AS split, count(*) AS n, round(sum(-ln(CASE WHEN y THEN p ELSE 1 - p END) * rw) / sum(rw), 6) AS logloss, round(avg(CAST((p >= 0.5) = y AS INTEGER)), 6) AS accuracy FROM p GROUP BY 1"""


def j_compare(spark, d):
    rows = lines(spark, d)
    pred = predict.predict(rows, given_ensemble("binary_classification")).select("row_id", "cls")
    actual = rows.select("row_id", (F.col("charge") > 40000).cast("int").alias("y"))
    return evaluate.compare_predictions(pred, actual, "binary_classification")


J_COMPARE = f"WITH {GIVEN_SQL} SELECT row_id, CAST(s0 >= 0 AS INTEGER) AS cls, CAST(charge > 40000 AS INTEGER) AS y, (s0 >= 0) = (charge > 40000) AS correct FROM given"


def j_compare_values(spark, d):
    rows = lines(spark, d)
    pred = predict.predict(rows, given_ensemble()).select("row_id", "value")
    told = evaluate.compare_predictions(pred, rows.select("row_id", F.floor(F.col("l_quantity") / 10 - 2).cast("double").alias("y")), "regression")
    return told.select("row_id", "y", *[F.round(c, 6).alias(c) for c in ("value", "abs_error", "rel_error")], "band")


J_COMPARE_VALUES = f"""WITH {GIVEN_SQL}, e AS (SELECT row_id, s0 / 1000.0 AS value, CAST(floor(l_quantity / 10 - 2) AS DOUBLE) AS y FROM given), a AS (SELECT *, abs(value - y) AS abs_error, CASE WHEN y <> 0 THEN abs(value - y) / abs(y) END AS rel_error FROM e)
SELECT row_id, y, round(value, 6) AS value, round(abs_error, 6) AS abs_error, round(rel_error, 6) AS rel_error,
  CASE WHEN rel_error IS NULL THEN CASE WHEN abs_error = 0 THEN 'good' ELSE 'warn' END WHEN rel_error <= 0.05 THEN 'good' WHEN rel_error <= 0.15 THEN 'warn' ELSE 'bad' END AS band FROM a"""


def j_compare_labels(spark, d):
    rows = lines(spark, d)
    pred = predict.predict(rows, given_ensemble("multilabel_classification", 3)).select("row_id", "predicted")
    actual = rows.select("row_id", F.array((F.col("l_quantity") > 25).cast("int"), (F.col("charge") > 40000).cast("int"), F.lit(1)).alias("labels"))
    told = evaluate.compare_predictions(pred, actual, "multilabel_classification")
    return told.select("row_id", F.array_join("predicted", "").alias("predicted"), F.array_join("labels", "").alias("labels"), F.round("label_accuracy", 6).alias("label_accuracy"))


J_COMPARE_LABELS = f"""WITH {GIVEN_SQL}, b AS (SELECT row_id, CAST(s0 >= 0 AS INTEGER) AS p0, CAST(s1 >= 0 AS INTEGER) AS p1, CAST(s2 >= 0 AS INTEGER) AS p2, CAST(l_quantity > 25 AS INTEGER) AS a0, CAST(charge > 40000 AS INTEGER) AS a1 FROM given)
SELECT row_id, concat(p0, p1, p2) AS predicted, concat(a0, a1, 1) AS labels, round((CAST(p0 = a0 AS INTEGER) + CAST(p1 = a1 AS INTEGER) + p2) / 3.0, 6) AS label_accuracy FROM b"""


def j_score_requests(spark, d):
    """Each line asks one of two models."""
    head, trees = given_ensemble().tables(spark)
    other = given_ensemble("multiclass_classification", 3)
    other.model_id = "other"
    h2, t2 = other.tables(spark)
    asked = lines(spark, d).select(F.col("row_id").alias("request_id"), F.when(F.col("l_linenumber") == 1, "other").otherwise("model").alias("model_id"), F.array(*FEATURES).alias("features"))
    scored = predict.score_requests(asked, head.union(h2), trees.union(t2))
    return scored.select("request_id", "model_id", F.array_join("score_q", ",").alias("scores"))


J_SCORE_REQUESTS = f"""WITH {GIVEN_SQL.replace('row_id, charge, l_quantity, floor', 'row_id, charge, l_quantity, l_linenumber, floor')}
SELECT row_id AS request_id, CASE WHEN l_linenumber = 1 THEN 'other' ELSE 'model' END AS model_id,
  CASE WHEN l_linenumber = 1 THEN s0 || ',' || s1 || ',' || s2 ELSE CAST(s0 AS VARCHAR) END AS scores FROM given"""


def a_split_usage(spark, d):
    nodes = lines(spark, d).select(F.col("l_linenumber").alias("feature"), F.when(F.col("l_quantity") > 40, INT32_MAX).otherwise(F.col("l_partkey").cast("int")).alias("thr"))
    return explain.split_usage(nodes).select("feature", "splits", F.round("share", 6).alias("share"))


A_SPLIT_USAGE = "SELECT l_linenumber AS feature, count(*) AS splits, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem WHERE l_quantity <= 40 GROUP BY 1"

# ---- curves derived from orders --------------------------------------------

CURVE_SQL = """curve AS (
  SELECT CAST(o_custkey % 40 AS VARCHAR) AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS INTEGER) AS step, o_totalprice AS val FROM orders
)"""


def _orders_curve(spark, d):
    from pyspark.sql import Window as W

    run = (F.col("o_custkey") % 40).cast("string")
    return table(spark, d, "orders").select(run.alias("run_id"), F.row_number().over(W.partitionBy(run).orderBy("o_orderkey")).alias("step"), F.col("o_totalprice").alias("val"))


def w_best_iteration(spark, d):
    return boost.best_iteration(_orders_curve(spark, d), 20).select("run_id", "step", "improved", "best_iter", "since_best", "stop")


W_BEST_ITERATION = f"""WITH {CURVE_SQL}, b AS (
  SELECT *, coalesce(val + 1e-12 < min(val) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM curve
), c AS (SELECT *, max(CASE WHEN improved THEN step END) OVER (PARTITION BY run_id ORDER BY step) AS best_iter FROM b)
SELECT run_id, step, improved, best_iter, step - best_iter AS since_best, step - best_iter >= 20 AS stop FROM c"""


def w_plateau_lr(spark, d):
    rounds = boost.best_iteration(_orders_curve(spark, d), 20).select("run_id", "step", "improved")
    return boost.plateau_lr(rounds, 0.5, 5, 0.5, 0.01).select("run_id", "step", F.round("lr", 9).alias("lr"))


W_PLATEAU_LR = f"""WITH RECURSIVE {CURVE_SQL}, b AS (
  SELECT *, coalesce(val + 1e-12 < min(val) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM curve
), walk AS (
  SELECT run_id, 0 AS step, CAST(0.5 AS DOUBLE) AS lr, 0 AS bad FROM (SELECT DISTINCT run_id FROM b)
  UNION ALL
  SELECT b.run_id, b.step, CASE WHEN NOT b.improved AND walk.bad + 1 >= 5 THEN greatest(walk.lr * 0.5, 0.01) ELSE walk.lr END,
    CASE WHEN b.improved OR walk.bad + 1 >= 5 THEN 0 ELSE walk.bad + 1 END
  FROM walk JOIN b ON b.run_id = walk.run_id AND b.step = walk.step + 1
)
SELECT run_id, step, round(lr, 9) AS lr FROM walk WHERE step > 0"""


def w_piecewise_lr(spark, d):
    segments = table(spark, d, "nation").select((F.col("n_nationkey") * 4 + 1).cast("int").alias("start"), (F.col("n_nationkey") * 4 + 3).cast("int").alias("end"), (0.5 / (F.col("n_nationkey") + 1)).alias("lr"))
    rounds = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 120).cast("int").alias("step"))
    return boost.piecewise_lr(rounds, segments, 0.05).select("p_partkey", "step", F.round("lr", 9).alias("lr"))


W_PIECEWISE_LR = """SELECT p_partkey, CAST(p_partkey % 120 AS INTEGER) AS step, round(coalesce(0.5 / (n_nationkey + 1), 0.05), 9) AS lr
FROM part LEFT JOIN nation ON p_partkey % 120 BETWEEN n_nationkey * 4 + 1 AND n_nationkey * 4 + 3"""


def w_rank_features(spark, d):
    rows = lines(spark, d).groupBy(F.col("l_linenumber").alias("feature")).agg(F.round((F.avg("l_quantity") - 25.5), 6).alias("delta_loss"), F.count(F.lit(1)).alias("splits"))
    return explain.rank_features(rows)


W_RANK_FEATURES = """WITH r AS (SELECT l_linenumber AS feature, round(avg(l_quantity) - 25.5, 6) AS delta_loss, count(*) AS splits FROM lineitem GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY delta_loss DESC, splits DESC, feature) AS INTEGER) AS place, CASE WHEN delta_loss > 1e-12 THEN 'useful' WHEN delta_loss < -1e-12 THEN 'harm' ELSE 'neutral' END AS tag FROM r"""


def w_best_trial(spark, d):
    trials = table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("round"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("error").alias("status"), F.lit("{}").alias("params"), F.col("o_totalprice").alias("best_val"), F.lit(1).alias("best_iter"), F.lit(None).cast("string").alias("error"))
    return search.best_trial(trials).select("round", "best_val")


W_BEST_TRIAL = "SELECT CAST(o_orderkey AS INTEGER) AS round, o_totalprice AS best_val FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 1"


def m_quantised_sigmoid(spark, d):
    """Probabilities of quantised scores, as a table function would serve them."""
    q = quantize(F.col("l_quantity") - 25, SCALE)
    return lines(spark, d).groupBy(q.alias("q")).agg(F.count(F.lit(1)).alias("n"), F.max(js_round(sigmoid(q / SCALE) * 1e6)).alias("p"))


M_QUANTISED_SIGMOID = f"""WITH {LINES_SQL} SELECT CAST(floor((l_quantity - 25) * 1000 + 0.5) AS BIGINT) AS q, count(*) AS n, max(CAST(floor(1 / (1 + exp(-(floor((l_quantity - 25) * 1000 + 0.5) / 1000.0))) * 1e6 + 0.5) AS BIGINT)) AS p FROM lines GROUP BY 1"""


QUERIES = {k: v for k, v in globals().items() if k[:2] in ("m_", "a_", "w_", "j_", "k_") and callable(v)}
SQL = {k: globals()[k.upper()] for k in QUERIES if k.upper() in globals()}
