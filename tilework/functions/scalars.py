"""Scalar functions as column expressions.

Rounding is floor(x + 0.5): halves go up, also below zero, which Spark's
round() does not do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32_MAX, INT32_MIN = 2147483647, -2147483648
# Limits and sizes of files and models.
SIZE_LIMIT = 15_000_000
MAX_TREES = 65_535
CHUNK_SIZE = 24_000
MAX_CHUNK = 24_572
NEVER = 18446744073709551615

# What a number looks like, the words that stand for 1 and 0,
# those of the two sides of a binary label, the tasks and their other names.
STRICT_NUMBER = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"
TRUE_WORDS = ("1", "1.0", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "0.0", "false", "f", "no", "n")
POSITIVE_WORDS = ("1", "true", "yes", "y", "t", "pos", "positive", "spam", "fraud")
NEGATIVE_WORDS = ("0", "false", "no", "n", "f", "neg", "negative", "ham")
TASKS = ("regression", "binary_classification", "multiclass_classification", "multilabel_classification")
TASK_ALIASES = {
    "binary": "binary_classification",
    "classification": "binary_classification",
    "multiclass": "multiclass_classification",
    "multilabel": "multilabel_classification",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def js_round(x) -> Column:
    """floor(x + 0.5) as BIGINT; null and NaN give null."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x), F.floor(x + F.lit(0.5)).cast("long"))


def clamp_i32(x) -> Column:
    return F.least(F.greatest(_c(x), F.lit(INT32_MIN).cast("long")), F.lit(INT32_MAX).cast("long"))


def quantize(x, scale) -> Column:
    """x * scale, rounded and held to 32 bits, as BIGINT."""
    y = _c(x).cast("double") * _c(scale)
    bounded = F.least(F.greatest(y, F.lit(float(INT32_MIN))), F.lit(float(INT32_MAX)))
    return F.when(~F.isnan(y), clamp_i32(F.floor(bounded + F.lit(0.5)).cast("long")))


def dequantize(q, scale) -> Column:
    return _c(q).cast("double") / _c(scale)


def sigmoid(z) -> Column:
    """1 / (1 + exp(-z)) without overflow; a non-finite z gives 0.5."""
    z = _c(z).cast("double")
    e = F.exp(-F.abs(z))
    finite = ~F.isnan(z) & (F.abs(z) < float("inf"))
    return F.when(finite, F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))).otherwise(F.lit(0.5))


def softmax(logits, scale=1) -> Column:
    """Probabilities from an array of logits, shifted by the largest."""
    a = _c(logits)
    top = F.array_max(a).cast("double")
    parts = F.transform(a, lambda v: F.exp((v.cast("double") - top) / _c(scale)))
    total = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    return F.transform(parts, lambda v: v / total)


def argmax(logits) -> Column:
    """Place of the largest value from 0; the first of equal ones."""
    a = _c(logits)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_odds(p, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(_c(p).cast("double"), F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (1 - p))


def is_strict_number(s) -> Column:
    return F.coalesce(F.trim(_c(s)).rlike(STRICT_NUMBER), F.lit(False))


def to_number(s) -> Column:
    """DOUBLE of a strictly written finite number, else null."""
    s = F.trim(_c(s))
    n = F.when(s.rlike(STRICT_NUMBER), s.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def canon_label(s) -> Column:
    """One text for each label: whole numbers lose their decimals, others keep the shortest form."""
    s = F.trim(F.coalesce(_c(s), F.lit("")))

    def number(n: Column) -> Column:
        whole = (F.abs(n - F.round(n)) < 1e-12) & (F.abs(n) < 9.2e18)
        fixed = F.regexp_replace(F.format_string("%.15f", n), r"0+$", "")
        plain = (F.abs(n) >= 1e-4) & (F.abs(n) < 1e16) & (fixed.try_cast("double") == n)
        # What is no number is not formatted.
        return F.when(n.isNull(), F.lit(None)).when(whole, F.round(n).cast("long").cast("string")).when(plain, fixed).otherwise(n.cast("string"))

    # The lambda's argument is worked out once.
    return F.coalesce(F.transform(F.array(to_number(s)), number)[0], s)


def parse_binary01(s) -> Column:
    k = F.lower(F.trim(_c(s)))
    n = to_number(k)
    number = F.when(n == 0, 0).when(n == 1, 1)
    return F.when(k.isin(*FALSE_WORDS), 0).when(k.isin(*TRUE_WORDS), 1).otherwise(number).cast("int")


def title_words(s) -> Column:
    """Distinct lower-case words of two characters and more, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(_c(s), F.lit(""))), r"[\s,]+"), lambda w: F.length(w) >= 2))


def word_key(w) -> Column:
    """A stable key of a word."""
    return F.sha2(_c(w), 256)


def linear_bin(x, low, width, bins) -> Column:
    """Bin of x among ``bins`` equal ones from low; the edges belong to the last bin on their side."""
    b = F.floor((_c(x) - _c(low)) / _c(width) * _c(bins)).cast("int")
    return F.when(_c(width) > 0, F.least(F.greatest(b, F.lit(0)), (_c(bins) - 1).cast("int")))


def bin_threshold(b, low, width, bins) -> Column:
    """Upper boundary of bin b."""
    return _c(low) + _c(width) * (_c(b) + 1) / _c(bins)


def quantile_bin(x, thresholds) -> Column:
    """Place of the first threshold that is not below x."""
    return F.size(F.filter(_c(thresholds), lambda t: t < _c(x)))


def normalize_task(s) -> Column:
    t = F.trim(F.coalesce(_c(s), F.lit("")))
    for alias, task in TASK_ALIASES.items():
        t = F.when(t == alias, task).otherwise(t)
    return F.when(t.isin(*TASKS), t).otherwise("regression")


def pack_features(meta_json, names) -> Column:
    """'#meta=' and JSON, then one trimmed, non-empty feature name per line."""
    kept = F.filter(F.transform(_c(names), lambda n: F.trim(n)), lambda n: n != "")
    return F.array_join(F.concat(F.array(F.concat(F.lit("#meta="), _c(meta_json))), kept), "\n")


def unpack_features(packed) -> Column:
    """STRUCT<meta: STRING, features: ARRAY<STRING>> from the packed text."""
    def told(lines):
        has = F.startswith(lines[0], F.lit("#meta="))
        meta = F.when(has, F.substring(lines[0], 7, 1 << 30))
        names = F.when(has, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        names = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
        return F.struct(meta.alias("meta"), names.alias("features"))

    # The lambda's argument is worked out once.
    return F.transform(F.array(F.split(_c(packed), "\n")), told)[0]


def _swapped(v: Column) -> Column:
    """The low 32 bits of a BIGINT with their bytes in the other order."""
    low, high = v.bitwiseAND(F.lit(0xFF)), F.shiftright(v, 8).bitwiseAND(F.lit(0xFF00))
    return F.shiftleft(low, 24).bitwiseOR(F.shiftleft(v.bitwiseAND(F.lit(0xFF00)), 8)).bitwiseOR(high).bitwiseOR(F.shiftright(v, 24).bitwiseAND(F.lit(0xFF)))


def pack_i32_le(values) -> Column:
    """An array of 32-bit integers as little-endian bytes."""
    return F.unhex(F.array_join(F.transform(_c(values), lambda v: F.lpad(F.hex(_swapped(v.cast("long"))), 8, "0")), ""))


def unpack_i32_le(data) -> Column:
    """The integers of little-endian bytes; a rest of under four bytes is left.

    Each step is a transform of its own: a lambda's argument is worked out
    once, an expression that is named twice is worked out twice.
    """
    words = F.regexp_extract_all(F.hex(_c(data)), F.lit("([0-9A-F]{8})"))
    numbers = F.transform(words, lambda w: F.conv(w, 16, 10).cast("long"))
    signed = F.transform(numbers, lambda v: (_swapped(v).bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)).cast("int"))
    return F.coalesce(signed, F.array().cast("array<int>"))


def model_bytes(trees, depth, outputs=1) -> Column:
    """Bytes of a model: header, then nodes of 8 and leaves of 4 bytes."""
    depth = F.greatest(_c(depth), F.lit(1))
    leaves = F.pow(F.lit(2), depth).cast("long")
    head = F.lit(24) + F.when(_c(outputs) > 1, _c(outputs) * 4).otherwise(0)
    return (head + _c(trees) * _c(outputs) * ((leaves - 1) * 8 + leaves * 4)).cast("long")


def bytes_of(trees: int, depth: int, outputs: int = 1) -> int:
    leaves = 1 << max(1, depth)
    return 24 + (4 * outputs if outputs > 1 else 0) + trees * outputs * ((leaves - 1) * 8 + leaves * 4)


def clamp_for_size(trees: int, depth: int, task: str = "regression", outputs: int = 2) -> tuple[int, int]:
    """Trees and depth of a model under the size limit: fewer trees first, then less depth.

    Trees go down in steps of 25 to a least number (1 for vector models, 10
    otherwise), depth to 2.
    """
    vector = task in ("multiclass_classification", "multilabel_classification")
    least = 1 if vector else 10
    outputs = max(2, outputs) if vector else 1
    trees, depth = max(least, int(trees)), max(1, int(depth))
    if vector:
        trees = min(trees, max(1, MAX_TREES // outputs))
    over = -(-(bytes_of(trees, depth, outputs) - SIZE_LIMIT) // max(1, bytes_of(25, depth, outputs) - bytes_of(0, depth, outputs)))
    if over > 0:
        trees = max(least, trees - 25 * over)
    while bytes_of(trees, depth, outputs) > SIZE_LIMIT and depth > 2:
        depth -= 1
    return trees, depth


def deploy_estimate(size, base_fee, byte_fee) -> Column:
    """STRUCT<chunks, transactions, fee> for a model of so many bytes."""
    chunks = F.ceil(_c(size) / CHUNK_SIZE).cast("long")
    fee = _c(base_fee).cast("decimal(38,0)") + _c(byte_fee).cast("decimal(18,0)") * _c(size).cast("decimal(18,0)")
    return F.struct(chunks.alias("chunks"), (chunks + 2).alias("transactions"), fee.cast("decimal(38,0)").alias("fee"))


def wei_to_unit(wei) -> Column:
    """Whole units (10**18) of an amount, exact."""
    return (_c(wei).cast("decimal(38,0)") * F.lit("0.000000000000000001").cast("decimal(18,18)")).cast("decimal(38,18)")


def unit_to_wei(unit) -> Column:
    return F.round(_c(unit).cast("decimal(20,18)") * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")


def pricing_label(enabled, mode, fee) -> Column:
    text = F.regexp_replace(F.regexp_replace(wei_to_unit(fee).cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(~_c(enabled), "Disabled").when(_c(mode) == 0, "Free").when(_c(mode) == 1, F.concat(F.lit("Tips "), text)).otherwise(F.concat(F.lit("Paid "), text))


def blocks_to_duration(blocks) -> Column:
    """Text of a number of 15-second blocks in days, hours or minutes."""
    s = _c(blocks).cast("long") * 15
    unit = lambda n, word: F.format_string("%.2f " + word, s.cast("double") / n)
    return F.when(s <= 0, F.lit("none")).when(s >= 86400, unit(86400, "days")).when(s >= 3600, unit(3600, "hours")).otherwise(unit(60, "minutes"))


def remaining_blocks(expiry, block) -> Column:
    """'none', 'perpetual' or the number of blocks left as text."""
    e = _c(expiry).cast("decimal(20,0)")
    left = F.greatest(e - _c(block).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.when(e.isNull() | (e == 0), "none").when(e == F.lit(str(NEVER)).cast("decimal(20,0)"), "perpetual").otherwise(left.cast("decimal(20,0)").cast("string"))
