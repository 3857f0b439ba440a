"""Scalar functions over lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilework import functions as fn
from tilework.plans.tables import DIRTY_SQL, LINES_SQL, dirty, lines, table


def f_quantize(spark, d):
    x = F.col("l_quantity") - 25.25
    return lines(spark, d).select(
        "row_id", fn.js_round(x / 2).alias("half"), fn.quantize("charge", 1000).alias("q"), fn.quantize("charge", 1_000_000).alias("held"),
        fn.quantize(-F.col("l_discount"), 50).alias("neg"), fn.js_round(fn.dequantize(fn.quantize("l_tax", 1000), 1000) * 1000).alias("back"),
    )


F_QUANTIZE = f"""WITH {LINES_SQL}
SELECT row_id, CAST(floor((l_quantity - 25.25) / 2 + 0.5) AS BIGINT) AS half,
  CAST(least(greatest(floor(charge * 1000 + 0.5), -2147483648), 2147483647) AS BIGINT) AS q,
  CAST(least(greatest(floor(charge * 1000000 + 0.5), -2147483648), 2147483647) AS BIGINT) AS held,
  CAST(floor(-l_discount * 50 + 0.5) AS BIGINT) AS neg, CAST(floor(floor(l_tax * 1000 + 0.5) / 1000.0 * 1000 + 0.5) AS BIGINT) AS back
FROM lines"""


def f_bins(spark, d):
    cuts = F.array(*[F.lit(float(v)) for v in (10, 20, 30, 40)])
    b = fn.linear_bin("l_quantity", 1.0, 49.0, 32)
    return lines(spark, d).select("row_id", b.alias("bin"), fn.js_round(fn.bin_threshold(b, 1.0, 49.0, 32) * 1000).alias("edge"), fn.quantile_bin("l_quantity", cuts).alias("qbin"))


F_BINS = f"""WITH {LINES_SQL}, b AS (
  SELECT row_id, l_quantity, CAST(least(greatest(floor((l_quantity - 1.0) / 49.0 * 32), 0), 31) AS INTEGER) AS bin FROM lines
)
SELECT row_id, bin, CAST(floor((1.0 + CAST(49.0 AS DOUBLE) * (bin + 1) / 32) * 1000 + 0.5) AS BIGINT) AS edge,
  CAST((l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT + (l_quantity > 40)::INT AS INTEGER) AS qbin
FROM b"""


def f_probabilities(spark, d):
    z = F.col("l_quantity") / 10 - 2.5
    logits = F.array(z, -z, F.col("l_tax") * 10)
    micro = lambda c: fn.js_round(c * 1e6)
    p = fn.softmax(logits, 2.0)
    return lines(spark, d).select("row_id", micro(fn.sigmoid(z)).alias("p"), micro(p[0]).alias("p0"), micro(p[2]).alias("p2"), fn.argmax(logits).alias("top"), micro(fn.log_odds(F.col("l_discount"))).alias("odds"))


F_PROBABILITIES = f"""WITH {LINES_SQL}, z AS (SELECT row_id, l_discount, l_quantity / 10 - 2.5 AS a, l_tax * 10 AS c FROM lines),
m AS (SELECT *, greatest(a, -a, c) AS top_z FROM z),
e AS (SELECT *, exp((a - top_z) / 2) AS ea, exp((-a - top_z) / 2) AS eb, exp((c - top_z) / 2) AS ec FROM m)
SELECT row_id, CAST(floor(1 / (1 + exp(-a)) * 1e6 + 0.5) AS BIGINT) AS p,
  CAST(floor(ea / (ea + eb + ec) * 1e6 + 0.5) AS BIGINT) AS p0, CAST(floor(ec / (ea + eb + ec) * 1e6 + 0.5) AS BIGINT) AS p2,
  CAST(CASE WHEN a = top_z THEN 0 WHEN -a = top_z THEN 1 ELSE 2 END AS INTEGER) AS top,
  CAST(floor(ln(greatest(l_discount, 1e-6) / (1 - greatest(l_discount, 1e-6))) * 1e6 + 0.5) AS BIGINT) AS odds
FROM e"""


def f_labels(spark, d):
    return dirty(spark, d).select(
        "row_id", fn.is_strict_number("a").alias("strict"), fn.canon_label("a").alias("label"), fn.parse_binary01("a").alias("bit"),
        fn.js_round(fn.to_number("b") * 100).alias("number"),
    )


F_LABELS = rf"""WITH {LINES_SQL}, {DIRTY_SQL}, n AS (
  SELECT *, regexp_full_match(trim(a), '[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?') AS strict,
    CASE WHEN regexp_full_match(trim(b), '[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?') THEN CAST(b AS DOUBLE) END AS nb
  FROM dirty
), v AS (SELECT *, CASE WHEN strict THEN CAST(trim(a) AS DOUBLE) END AS x FROM n)
SELECT row_id, strict,
  CASE WHEN x IS NULL THEN trim(a) WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS label,
  CAST(CASE WHEN lower(trim(a)) IN ('0', '0.0', 'false', 'f', 'no', 'n') OR x = 0 THEN 0
    WHEN lower(trim(a)) IN ('1', '1.0', 'true', 't', 'yes', 'y') OR x = 1 THEN 1 END AS INTEGER) AS bit,
  CAST(floor(nb * 100 + 0.5) AS BIGINT) AS number
FROM v"""


def f_titles(spark, d):
    w = fn.title_words(F.concat_ws(", ", "p_name", "p_type", "p_name"))
    return table(spark, d, "part").select("p_partkey", F.array_join(w, "|").alias("words"), fn.word_key(w[0]).alias("first_key"))


F_TITLES = """WITH w AS (
  SELECT p_partkey, unnest(regexp_split_to_array(lower(concat_ws(', ', p_name, p_type, p_name)), '[\\s,]+')) AS word,
    generate_subscripts(regexp_split_to_array(lower(concat_ws(', ', p_name, p_type, p_name)), '[\\s,]+'), 1) AS i
  FROM part
), d AS (SELECT p_partkey, word, min(i) AS i FROM w WHERE length(word) >= 2 GROUP BY p_partkey, word)
SELECT p_partkey, string_agg(word, '|' ORDER BY i) AS words, sha256(arg_min(word, i)) AS first_key FROM d GROUP BY p_partkey""".replace("\\\\", "\\")


def f_sizes(spark, d):
    size = fn.model_bytes("p_size", F.col("p_partkey") % 8 + 1, F.lit(1))
    vector = fn.model_bytes("p_size", F.col("p_partkey") % 8 + 1, F.lit(3))
    est = fn.deploy_estimate(vector, F.lit(1000), F.lit(7))
    return table(spark, d, "part").select("p_partkey", size.alias("bytes"), vector.alias("vector_bytes"), est["chunks"].alias("chunks"), est["transactions"].alias("transactions"), est["fee"].cast("long").alias("fee"))


F_SIZES = """WITH s AS (
  SELECT p_partkey, 24 + p_size * ((2 ** (p_partkey % 8 + 1) - 1) * 8 + 2 ** (p_partkey % 8 + 1) * 4) AS b,
    24 + 12 + p_size * 3 * ((2 ** (p_partkey % 8 + 1) - 1) * 8 + 2 ** (p_partkey % 8 + 1) * 4) AS v
  FROM part
)
SELECT p_partkey, CAST(b AS BIGINT) AS bytes, CAST(v AS BIGINT) AS vector_bytes, CAST(ceil(v / 24000.0) AS BIGINT) AS chunks,
  CAST(ceil(v / 24000.0) + 2 AS BIGINT) AS transactions, CAST(1000 + 7 * v AS BIGINT) AS fee FROM s"""


def f_clamped_sizes(spark, d):
    """Every part's size and depth held to the model size limit (arithmetic on columns, whole steps at once)."""
    trees, depth = F.col("p_size") * 4000, (F.col("p_partkey") % 8 + 1).cast("int")
    per = (F.pow(F.lit(2), depth) - 1) * 8 + F.pow(F.lit(2), depth) * 4
    over = F.greatest(F.ceil((24 + trees * per - fn.SIZE_LIMIT) / (25 * per)), F.lit(0))
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(10), trees - 25 * over).cast("long").alias("trees"), depth.alias("depth"))


F_CLAMPED = """WITH s AS (SELECT p_partkey, p_size * 4000 AS t, p_partkey % 8 + 1 AS d, (2 ** (p_partkey % 8 + 1) - 1) * 8 + 2 ** (p_partkey % 8 + 1) * 4 AS per FROM part)
SELECT p_partkey, CAST(greatest(10, t - 25 * greatest(ceil((24 + t * per - 15000000) / (25.0 * per)), 0)) AS BIGINT) AS trees, CAST(d AS INTEGER) AS depth FROM s"""


def f_durations(spark, d):
    b = F.col("p_partkey") * 37
    expiry = F.when(F.col("p_size") % 10 == 0, F.lit(str(fn.NEVER))).when(F.col("p_size") % 7 == 0, "0").otherwise((F.col("p_partkey") * 3).cast("string")).cast("decimal(20,0)")
    return table(spark, d, "part").select(
        "p_partkey", fn.blocks_to_duration(b).alias("duration"), fn.remaining_blocks(expiry, F.lit(500)).alias("left_text"),
        fn.pricing_label(F.col("p_size") % 2 == 0, F.col("p_size") % 3, (F.col("p_size").cast("decimal(38,0)") * F.lit(10**17).cast("decimal(18,0)")).cast("decimal(38,0)")).alias("pricing"),
        fn.normalize_task(F.when(F.col("p_size") % 4 == 0, "binary").when(F.col("p_size") % 4 == 1, " multilabel ").when(F.col("p_size") % 4 == 2, "other").otherwise("multiclass_classification")).alias("task"),
    )


F_DURATIONS = """WITH s AS (SELECT p_partkey, p_size, p_partkey * 37 * 15 AS sec FROM part), u AS (
  SELECT *, CASE WHEN sec >= 86400 THEN 86400 WHEN sec >= 3600 THEN 3600 ELSE 60 END AS unit FROM s
), h AS (SELECT *, (sec * 200 + unit) // (2 * unit) AS cents FROM u)
SELECT p_partkey,
  CASE WHEN sec <= 0 THEN 'none' ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || CASE unit WHEN 86400 THEN ' days' WHEN 3600 THEN ' hours' ELSE ' minutes' END END AS duration,
  CASE WHEN p_size % 10 = 0 THEN 'perpetual' WHEN p_size % 7 = 0 OR p_partkey = 0 THEN 'none' ELSE CAST(greatest(p_partkey * 3 - 500, 0) AS VARCHAR) END AS left_text,
  CASE WHEN p_size % 2 <> 0 THEN 'Disabled' WHEN p_size % 3 = 0 THEN 'Free' ELSE CASE WHEN p_size % 3 = 1 THEN 'Tips ' ELSE 'Paid ' END || (p_size // 10) || CASE WHEN p_size % 10 = 0 THEN '' ELSE '.' || (p_size % 10) END END AS pricing,
  CASE p_size % 4 WHEN 0 THEN 'binary_classification' WHEN 1 THEN 'multilabel_classification' WHEN 2 THEN 'regression' ELSE 'multiclass_classification' END AS task
FROM h"""


def f_packing(spark, d):
    names = F.array(F.col("p_name"), F.lit("  "), F.concat(F.lit(" "), F.col("p_brand")))
    packed = fn.pack_features(F.to_json(F.struct(F.lit(1).alias("v"), F.lit("regression").alias("task"))), names)
    back = fn.unpack_features(packed)
    q = F.array(F.col("p_partkey").cast("long"), (-F.col("p_size")).cast("long"), F.lit(2147483647).cast("long"))
    data = fn.pack_i32_le(q)
    return table(spark, d, "part").select(
        "p_partkey", packed.alias("packed"), F.array_join(back["features"], ";").alias("features"),
        F.hex(data).alias("data"), F.array_join(fn.unpack_i32_le(data), ",").alias("unpacked"),
    )


F_PACKING = """WITH h AS (
  SELECT *, printf('%08X', p_partkey) AS k, printf('%08X', CASE WHEN p_size = 0 THEN 0 ELSE 4294967296 - p_size END) AS s FROM part
)
SELECT p_partkey, '#meta={"v":1,"task":"regression"}' || chr(10) || p_name || chr(10) || p_brand AS packed, p_name || ';' || p_brand AS features,
  k[7:8] || k[5:6] || k[3:4] || k[1:2] || s[7:8] || s[5:6] || s[3:4] || s[1:2] || 'FFFFFF7F' AS data,
  p_partkey || ',' || (-p_size) || ',2147483647' AS unpacked
FROM h"""


QUERIES = {
    "f_quantize": f_quantize, "f_bins": f_bins, "f_probabilities": f_probabilities, "f_labels": f_labels, "f_titles": f_titles,
    "f_sizes": f_sizes, "f_clamped_sizes": f_clamped_sizes, "f_durations": f_durations, "f_packing": f_packing,
}
SQL = {
    "f_quantize": F_QUANTIZE, "f_bins": F_BINS, "f_probabilities": F_PROBABILITIES, "f_labels": F_LABELS, "f_titles": F_TITLES,
    "f_sizes": F_SIZES, "f_clamped_sizes": F_CLAMPED, "f_durations": F_DURATIONS, "f_packing": F_PACKING,
}
