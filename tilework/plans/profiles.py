"""Cleaning, profiling, splits and samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilework.functions import js_round
from tilework.operators import binning, clean, evaluate, profile, split
from tilework.plans.tables import DIRTY_SQL, FEATURES, LINES_SQL, dirty, lines, table

NUMBER_SQL = r"""'[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?'"""
B_OK = f"regexp_full_match(trim(coalesce(b, '')), {NUMBER_SQL})"
A_OK = f"regexp_full_match(trim(a), {NUMBER_SQL})"
BIT_SQL = f"""CASE WHEN lower(trim(a)) IN ('0', '0.0', 'false', 'f', 'no', 'n') THEN 0 WHEN lower(trim(a)) IN ('1', '1.0', 'true', 't', 'yes', 'y') THEN 1
  WHEN {A_OK} THEN CASE CAST(trim(a) AS DOUBLE) WHEN 0 THEN 0 WHEN 1 THEN 1 END END"""


def p_drop_regression(spark, d):
    return clean.drop_report(dirty(spark, d), "regression", ["a"], ["b"])


P_DROP_REGRESSION = f"""WITH {LINES_SQL}, {DIRTY_SQL}
SELECT CASE WHEN NOT {A_OK} THEN 'bad_label' WHEN NOT {B_OK} THEN 'bad_feature' ELSE 'kept' END AS reason, count(*) AS n FROM dirty GROUP BY 1"""


def p_drop_classes(spark, d):
    return clean.drop_report(dirty(spark, d), "multiclass_classification", ["a"], ["b"], ["7", "-0.5", "TRUE"])


P_DROP_CLASSES = f"""WITH {LINES_SQL}, {DIRTY_SQL}
SELECT CASE WHEN NOT (trim(a) = 'TRUE' OR ({A_OK} AND CAST(CASE WHEN {A_OK} THEN trim(a) END AS DOUBLE) IN (7, -0.5))) THEN 'bad_label' WHEN NOT {B_OK} THEN 'bad_feature' ELSE 'kept' END AS reason,
  count(*) AS n FROM dirty GROUP BY 1"""


def p_drop_labels(spark, d):
    return clean.drop_report(dirty(spark, d).withColumn("flag", (F.col("l_returnflag") == "R").cast("string")), "multilabel_classification", ["a", "flag"], ["b"])


P_DROP_LABELS = f"""WITH {LINES_SQL}, {DIRTY_SQL}
SELECT CASE WHEN trim(a) = '' THEN 'missing_label' WHEN ({BIT_SQL}) IS NULL THEN 'invalid_label' WHEN NOT {B_OK} THEN 'bad_feature' ELSE 'kept' END AS reason, count(*) AS n
FROM dirty GROUP BY 1"""


def p_regression_rows(spark, d):
    rows = clean.regression_rows(dirty(spark, d), "a", ["b"], ["row_id"])
    return rows.select("row_id", js_round(F.col("b") * 100).alias("b"), js_round(F.col("y") * 100).alias("y"))


P_REGRESSION_ROWS = f"""WITH {LINES_SQL}, {DIRTY_SQL}
SELECT row_id, CAST(floor(CAST(b AS DOUBLE) * 100 + 0.5) AS BIGINT) AS b, CAST(floor(CAST(trim(a) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS y
FROM (SELECT * FROM dirty WHERE {A_OK} AND {B_OK})"""


def p_binary_rows(spark, d):
    rows = clean.binary_rows(dirty(spark, d), "l_returnflag", "A", "R", ["b"], ["row_id"])
    return rows.select("row_id", "y", js_round(F.col("b") * 100).alias("b"))


P_BINARY_ROWS = f"""WITH {LINES_SQL}, {DIRTY_SQL}
SELECT row_id, CAST(CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS INTEGER) AS y, CAST(floor(CAST(b AS DOUBLE) * 100 + 0.5) AS BIGINT) AS b
FROM (SELECT * FROM dirty WHERE l_returnflag IN ('A', 'R') AND {B_OK})"""


def p_multiclass_rows(spark, d):
    rows = clean.multiclass_rows(dirty(spark, d), "l_returnflag", ["R", "N", "R", "A"], ["b"], ["row_id"])
    return rows.select("row_id", "y")


P_MULTICLASS_ROWS = f"""WITH {LINES_SQL}, {DIRTY_SQL}
SELECT row_id, CAST(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS y FROM dirty WHERE l_returnflag IN ('A', 'R', 'N') AND {B_OK}"""


def p_multilabel_rows(spark, d):
    rows = clean.multilabel_rows(dirty(spark, d).withColumn("flag", (F.col("l_returnflag") == "R").cast("string")), ["a", "flag"], ["b"], ["row_id"])
    return rows.select("row_id", F.col("labels")[0].alias("y0"), F.col("labels")[1].alias("y1"))


P_MULTILABEL_ROWS = f"""WITH {LINES_SQL}, {DIRTY_SQL}, p AS (SELECT row_id, l_returnflag, b, {BIT_SQL} AS bit FROM dirty)
SELECT row_id, CAST(bit AS INTEGER) AS y0, CAST(l_returnflag = 'R' AS INTEGER) AS y1 FROM p WHERE bit IS NOT NULL AND {B_OK}"""


def a_label_values(spark, d):
    return profile.label_values(dirty(spark, d), "a")


A_LABEL_VALUES = f"""WITH {LINES_SQL}, {DIRTY_SQL}, c AS (
  SELECT CASE WHEN {A_OK} THEN CASE WHEN CAST(trim(a) AS DOUBLE) = floor(CAST(trim(a) AS DOUBLE)) THEN CAST(CAST(CAST(trim(a) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(trim(a) AS DOUBLE) AS VARCHAR) END ELSE trim(a) END AS label FROM dirty
)
SELECT label, count(*) AS n, false AS all_numeric FROM c WHERE label <> '' GROUP BY label"""


def a_numeric_labels(spark, d):
    return profile.label_values(lines(spark, d), "l_linenumber")


A_NUMERIC_LABELS = "SELECT CAST(l_linenumber AS VARCHAR) AS label, count(*) AS n, true AS all_numeric FROM lineitem GROUP BY 1"


def a_class_balance(spark, d):
    return profile.class_balance(table(spark, d, "lineitem"), "l_returnflag")


A_CLASS_BALANCE = "SELECT l_returnflag AS cls, count(*) AS n FROM lineitem GROUP BY 1"


def a_label_balance(spark, d):
    return profile.label_balance(table(spark, d, "labels"), ["quality", "toxic"])


A_LABEL_BALANCE = """WITH l AS (SELECT * FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT 'quality' AS label, CAST(sum(quality) AS BIGINT) AS pos, CAST(count(*) - sum(quality) AS BIGINT) AS neg FROM l
UNION ALL SELECT 'toxic', CAST(sum(toxic) AS BIGINT), CAST(count(*) - sum(toxic) AS BIGINT) FROM l"""


def a_binary_weights(spark, d):
    one = profile.binary_weights(table(spark, d, "labels"), "toxic", normalize=True)
    return one.select("c0", "c1", js_round(F.col("w0") * 1e6).alias("w0"), js_round(F.col("w1") * 1e6).alias("w1"))


A_BINARY_WEIGHTS = """WITH c AS (SELECT count(*) FILTER (toxic = 0) AS c0, count(*) FILTER (toxic = 1) AS c1 FROM labels),
w AS (SELECT *, least((c0 + c1) / (2.0 * c0), 20) AS w0, least((c0 + c1) / (2.0 * c1), 20) AS w1 FROM c),
m AS (SELECT *, (w0 * c0 + w1 * c1) / (c0 + c1) AS m FROM w)
SELECT c0, c1, CAST(floor(w0 / m * 1e6 + 0.5) AS BIGINT) AS w0, CAST(floor(w1 / m * 1e6 + 0.5) AS BIGINT) AS w1 FROM m"""


def _bucketed(spark, d):
    y = F.when(F.col("charge") < 20000, 0).when(F.col("charge") < 95000, 1).otherwise(2)
    return lines(spark, d).withColumn("y", y)


def a_class_weights(spark, d):
    return profile.class_weights(_bucketed(spark, d), 4, cap=20.0).select("cls", "n", js_round(F.col("w") * 1e6).alias("w"))


A_CLASS_WEIGHTS = f"""WITH {LINES_SQL}, c AS (SELECT CASE WHEN charge < 20000 THEN 0 WHEN charge < 95000 THEN 1 ELSE 2 END AS cls, count(*) AS n FROM lines GROUP BY 1),
k AS (SELECT CAST(range AS INTEGER) AS cls FROM range(4)), t AS (SELECT sum(n) AS total FROM c)
SELECT k.cls, coalesce(c.n, 0) AS n, CAST(floor(least(CASE WHEN c.n IS NULL THEN 1.0 ELSE total / (4.0 * c.n) END, 20) * 1e6 + 0.5) AS BIGINT) AS w FROM k LEFT JOIN c USING (cls) CROSS JOIN t"""


def a_label_weights(spark, d):
    rows = table(spark, d, "labels").select(F.array("quality", "toxic").alias("labels"))
    return profile.label_pos_weights(rows, 2, normalize=True).select("label", "pos", "neg", js_round(F.col("w") * 1e6).alias("w"), js_round(F.col("scale") * 1e6).alias("scale"))


A_LABEL_WEIGHTS = """WITH c AS (
  SELECT 0 AS label, CAST(sum(quality) AS BIGINT) AS pos, CAST(count(*) - sum(quality) AS BIGINT) AS neg FROM labels
  UNION ALL SELECT 1, CAST(sum(toxic) AS BIGINT), CAST(count(*) - sum(toxic) AS BIGINT) FROM labels
), w AS (SELECT *, least(greatest(neg / pos, 1e-6), 20) AS w FROM c), m AS (SELECT sum(neg + w * pos) / sum(neg + pos) AS m FROM w)
SELECT label, pos, neg, CAST(floor(w * 1e6 + 0.5) AS BIGINT) AS w, CAST(floor(1 / m * 1e6 + 0.5) AS BIGINT) AS scale FROM w, m"""


def a_feature_ranges(spark, d):
    out = profile.feature_ranges(lines(spark, d), [*FEATURES, "charge"])
    return out.select("feature", *[js_round(F.col(c) * 10000).alias(c) for c in ("low", "high", "width")])


A_FEATURE_RANGES = f"WITH {LINES_SQL}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(floor(min({c}) * 10000 + 0.5) AS BIGINT) AS low, CAST(floor(max({c}) * 10000 + 0.5) AS BIGINT) AS high, CAST(floor((max({c}) - min({c})) * 10000 + 0.5) AS BIGINT) AS width FROM lines"
    for c in [*FEATURES, "charge"]
)


def a_auto_scale(spark, d):
    return profile.auto_scale(lines(spark, d), FEATURES, "charge")


A_AUTO_SCALE = f"""WITH {LINES_SQL}
SELECT CAST(greatest(1, least(1000000, floor(2147480000 / greatest(max(abs(l_quantity)), max(abs(l_extendedprice)), max(abs(l_discount)), max(abs(l_tax)))), floor(2147480000 / max(abs(charge))))) AS BIGINT) AS scale_q FROM lines"""


def a_quantiles(spark, d):
    out = binning.quantile_thresholds(lines(spark, d), ["l_extendedprice", "charge"], 16, "row_id", seed=7)
    return out.select("feature", F.posexplode("thresholds").alias("j", "t")).select("feature", "j", js_round(F.col("t") * 100).alias("t"))


A_QUANTILES = f"""WITH {LINES_SQL}, s AS (SELECT * FROM lines ORDER BY md5('7:' || row_id), row_id LIMIT 50000),
q AS (
  SELECT 'l_extendedprice' AS feature, unnest(quantile_cont(l_extendedprice, [{', '.join(str(j / 16) for j in range(1, 16))}])) AS t, unnest(range(15)) AS j FROM s
  UNION ALL SELECT 'charge', unnest(quantile_cont(charge, [{', '.join(str(j / 16) for j in range(1, 16))}])), unnest(range(15)) FROM s
)
SELECT feature, CAST(j AS INTEGER) AS j, CAST(floor(t * 100 + 0.5) AS BIGINT) AS t FROM q"""


def a_quantile_sketch(spark, d):
    """Cuts of all rows by the sketch: whether the exact ranks of each are within the error that it states."""
    rows, names, bins = lines(spark, d), ["l_quantity", "l_extendedprice", "charge"], 32
    cuts = binning.quantile_sketch(rows, names, bins).select("feature", "error", F.posexplode("thresholds").alias("j", "cut"))
    values = rows.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("feature", "x"))
    # The values of a feature between two cuts are counted, and the counts added up.
    ends = F.broadcast(cuts.groupBy("feature").agg(F.array_sort(F.collect_list("cut")).alias("cuts")))
    below = lambda op: F.size(F.filter("cuts", op)).cast("int")
    placed = values.join(ends, "feature").select("feature", below(lambda t: t < F.col("x")).alias("under"), below(lambda t: t <= F.col("x")).alias("upto"))
    counts = placed.groupBy("feature", "under", "upto").agg(F.count(F.lit(1)).alias("n"))
    # A value is at or below cut j where it is above j cuts at most, and below it where at most j cuts are at or below it.
    ranked = cuts.join(counts, "feature").groupBy("feature", "j", "error").agg(
        F.sum(F.when(F.col("under") <= F.col("j"), F.col("n")).otherwise(0)).alias("high"), F.sum(F.when(F.col("upto") <= F.col("j"), F.col("n")).otherwise(0)).alias("low"), F.sum("n").alias("n"))
    want, off = (F.col("j") + 1) / bins * F.col("n"), F.col("error") * F.col("n")
    return ranked.select("feature", "j", "n", ((F.col("low") <= want + off) & (F.col("high") >= want - off) & (F.col("error") < 0.02)).alias("within"))


A_QUANTILE_SKETCH = "SELECT unnest(['l_quantity', 'l_extendedprice', 'charge']) AS feature, CAST(j.range AS INTEGER) AS j, (SELECT count(*) FROM lineitem) AS n, true AS within FROM range(31) j"


def a_base_scores(spark, d):
    rows = _bucketed(spark, d)
    classes = profile.base_score_multiclass(profile.class_weights(rows, 4), 1000).select(F.concat(F.lit("class "), F.col("cls")).alias("what"), "base_q")
    weights = profile.label_pos_weights(table(spark, d, "labels").select(F.array("quality", "toxic").alias("labels")), 2)
    labels = profile.base_score_multilabel(weights, 1000).select(F.concat(F.lit("label "), F.col("label")).alias("what"), "base_q")
    flag = rows.withColumn("y", (F.col("charge") > 40000).cast("int"))
    one = profile.base_score_binary(flag, 1000, w0=1.0, w1=2.0).select(F.lit("binary").alias("what"), "base_q")
    mean = profile.base_score_regression(rows, 10, "l_quantity").select(F.lit("mean").alias("what"), "base_q")
    return classes.union(labels).union(one).union(mean)


A_BASE_SCORES = f"""WITH {LINES_SQL}, c AS (SELECT CASE WHEN charge < 20000 THEN 0 WHEN charge < 95000 THEN 1 ELSE 2 END AS cls, count(*) AS n FROM lines GROUP BY 1),
k AS (SELECT CAST(range AS INTEGER) AS cls FROM range(4)), t AS (SELECT sum(n) AS total FROM c),
w AS (SELECT k.cls, coalesce(c.n, 0) AS n, least(CASE WHEN c.n IS NULL THEN 1.0 ELSE total / (4.0 * c.n) END, 20) AS w FROM k LEFT JOIN c USING (cls) CROSS JOIN t),
s AS (SELECT sum(w * n) AS all_w FROM w),
l AS (
  SELECT 0 AS label, sum(quality) AS pos, count(*) - sum(quality) AS neg FROM labels UNION ALL SELECT 1, sum(toxic), count(*) - sum(toxic) FROM labels
), lw AS (SELECT *, least(greatest(neg / pos, 1e-6), 20) AS w FROM l),
b AS (SELECT count(*) FILTER (charge > 40000) * 2.0 AS ones, count(*) FILTER (charge <= 40000) AS zeros FROM lines)
SELECT 'class ' || cls AS what, CAST(floor(ln(greatest((w * n + 0.001) / (all_w + 0.004), 1e-9)) * 1000 + 0.5) AS BIGINT) AS base_q FROM w, s
UNION ALL SELECT 'label ' || label, CAST(floor(ln((w * pos / (neg + w * pos)) / (1 - w * pos / (neg + w * pos))) * 1000 + 0.5) AS BIGINT) FROM lw
UNION ALL SELECT 'binary', CAST(floor(ln(ones / zeros) * 1000 + 0.5) AS BIGINT) FROM b
UNION ALL SELECT 'mean', CAST(floor(avg(l_quantity) * 10 + 0.5) AS BIGINT) FROM lines"""


def a_summary(spark, d):
    rows = dirty(spark, d).withColumn("reason", clean.drop_reason("regression", ["a"], ["b"]))
    return profile.dataset_summary(rows, "reason", 1, 0)


A_SUMMARY = f"""WITH {LINES_SQL}, {DIRTY_SQL}
SELECT count(*) AS raw_rows, count(*) FILTER ({A_OK} AND {B_OK}) AS usable_rows, count(*) FILTER (NOT ({A_OK} AND {B_OK})) AS dropped_rows, 4 AS columns, 1 AS features, 0 AS classes FROM dirty"""


def a_error_bands(spark, d):
    return evaluate.regression_error_bands(lines(spark, d).withColumn("value", F.col("l_extendedprice")), "value", "charge")


A_ERROR_BANDS = f"""WITH {LINES_SQL}, e AS (SELECT abs(l_extendedprice - charge) / abs(charge) AS r FROM lines)
SELECT CASE WHEN r <= 0.05 THEN 'good' WHEN r <= 0.15 THEN 'warn' ELSE 'bad' END AS band, count(*) AS n FROM e GROUP BY 1"""


def w_seeded_split(spark, d):
    return split.seeded_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 11)


W_SEEDED_SPLIT = """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('11:' || o_orderkey), o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM r"""


def w_stratified_split(spark, d):
    return split.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 11)


W_STRATIFIED_SPLIT = """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('11:' || o_orderkey), o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN i <= floor(n * 0.7) THEN 'train' WHEN i <= floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM r"""


def x_train_plus_val(spark, d):
    return split.train_plus_val(w_seeded_split(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


X_TRAIN_PLUS_VAL = f"SELECT split, count(*) AS n FROM ({W_SEEDED_SPLIT}) WHERE split <> 'test' GROUP BY split"


def l_sample_rows(spark, d):
    return split.sample_rows(lines(spark, d).select("row_id", "l_quantity"), "row_id", 2000, 5)


L_SAMPLE_ROWS = f"WITH {LINES_SQL} SELECT row_id, l_quantity FROM lines ORDER BY md5('5:' || row_id), row_id LIMIT 2000"


def l_valid_sample(spark, d):
    """Rows of a dirty file that can be plotted: a sample of them, and how many there are."""
    return split.sample_valid(dirty(spark, d), "row_id", ["a", "b"], 2000, 5)


L_VALID_SAMPLE = f"""WITH {LINES_SQL}, {DIRTY_SQL}, v AS (SELECT row_id, CAST(trim(a) AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, count(*) OVER () AS n_valid FROM dirty WHERE {A_OK} AND {B_OK})
SELECT * FROM v ORDER BY md5('5:' || row_id), row_id LIMIT 2000"""


QUERIES = {k: v for k, v in globals().items() if k[:2] in ("p_", "a_", "w_", "x_", "l_") and callable(v)}
SQL = {k: globals()[k.upper()] for k in QUERIES}
