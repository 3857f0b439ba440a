"""Source divergence audit by hash-consed segment trees over term ids.

Terms are counted once for each (lang, source) and for each lang. The kept
terms of a lang are dealt into blocks; over a block each group's counts are a
segment tree. Equal count subtrees are one node, whatever group they are in,
so a level of all trees is a table of (left, right) pairs without repeats. Two
groups are compared by walking their trees side by side, level by level, from
the roots: equal node pairs that a walk meets are put together with their
number and are priced once. Blocks, and for langs of many sources also bands
of sources, are dealt over tasks; what they give is added up by Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilework.llm.common import UPPER_TO_LOWER, discard, settle, small_batches, table, texts

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
#: Distinct (group, term) pairs that a task holds before it hands them on.
HELD = 400_000
#: Kept terms in a block, about; and sources in a band.
BLOCK, BAND = 4096, 64
#: Bytes of a text that are split into terms at a time.
PORTION = 1 << 22


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists; a text is cut only at blanks."""
    low, at = text.translate(UPPER_TO_LOWER), 0
    while len(low) - at > PORTION and (cut := low.find(b" ", at + PORTION)) >= 0:
        yield TERM.findall(low[at:cut])
        at = cut
    yield TERM.findall(low[at:] if at else low)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): added up in each task before they move.

    ``df`` counts documents and stands with a null source, ``n`` counts
    occurrences. A task hands on what it holds whenever it grows large, so
    rows of one key may repeat.
    """

    def rows(counts: dict[tuple, Counter], kind: bool) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            n = len(found)
            told, zeros = pa.array(found.values(), pa.int64()), pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), told if kind else zeros, zeros if kind else told],
                ["lang", "source", "term", "n", "df"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents, held = {}, {}, 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts(batch, "text")):
                mine, of_lang, once = counts.setdefault((lang, source), Counter()), documents.setdefault((lang, None), Counter()), set()
                before = len(mine) + len(of_lang)
                for part in _terms(text):
                    mine.update(part)
                    once.update(part)
                of_lang.update(once)
                held += len(mine) + len(of_lang) - before
                if held > HELD:
                    yield from rows(counts, True)
                    yield from rows(documents, False)
                    counts, documents, held = {}, {}, 0
        yield from rows(counts, True)
        yield from rows(documents, False)

    small_batches(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "lang string, source string, term string, n long, df long")


def kept_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n) of terms in at least ``least`` documents of their lang.

    One shuffle by (lang, term) serves the sums and the document counts.
    """
    counted = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    whole = counted.withColumn("df", F.sum("df").over(W.partitionBy("lang", "term")))
    return whole.filter((F.col("df") >= least) & F.col("source").isNotNull()).select("lang", "source", "term", "n")


# ---- trees -------------------------------------------------------------------


def consed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hash-consed segment trees of the rows of a (groups, 2**k) table.

    Gives the root of each row, the count of each leaf node, and for each
    level above the leaves the (left, right) children of its nodes. Nodes of a
    level are numbered; equal subtrees have one number.
    """
    leaves, at = np.unique(counts, return_inverse=True)
    at, levels = at.reshape(counts.shape), []
    width = len(leaves)
    while at.shape[1] > 1:
        pairs, up = np.unique(at[:, ::2] * np.int64(width) + at[:, 1::2], return_inverse=True)
        levels.append((pairs // width, pairs % width))
        at, width = up.reshape(len(counts), -1), len(pairs)
    return at[:, 0], leaves, levels


def _merged(walk: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal (walk, a, b) put together, their times added up."""
    wide, high = np.int64(b.max()) + 1, np.int64(a.max()) + 1
    key = (walk * high + a) * wide + b
    one, of = np.unique(key, return_inverse=True)
    return one // (wide * high), one // wide % high, one % wide, np.bincount(of, times, len(one)).astype(np.int64)


def walks(roots_a: np.ndarray, roots_b: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(walk, leaf of a, leaf of b, times) that the walks of all pairs of roots end with.

    Of the node pairs that a walk meets on a level each is opened once.
    """
    walk, a, b, times = np.arange(len(roots_a), dtype=np.int64), roots_a, roots_b, np.ones(len(roots_a), np.int64)
    for left, right in reversed(levels):
        walk, a, b, times = _merged(np.tile(walk, 2), np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]]), np.tile(times, 2))
    return walk, a, b, times


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * terms)) of each count, as whole numbers of any size where they need it."""
    wide = int(counts.max(initial=0)) + 2 > (1 << 62) // SCALE or total + 2 * terms >= 1 << 62
    return 1 + (counts.astype(object) + 2 if wide else counts.astype(np.int64) + 2) * SCALE // (total + 2 * terms)


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); both are at most 10**9 + 1, so squares fit."""
    p, q = p.astype(np.int64), q.astype(np.int64)
    return (p - q) ** 2 // (p + q)


def _occurring(roots: np.ndarray, other: np.ndarray, leaves: np.ndarray, levels: list) -> tuple[np.ndarray, ...]:
    """(row, place, leaf, leaf of the other tree) where a row's count is positive.

    Subtrees without a count are left out as soon as they are met.
    """
    some = [leaves > 0]
    for left, right in levels:
        some.append(some[-1][left] | some[-1][right])
    row, place, a, b = np.arange(len(roots)), np.zeros(len(roots), np.int64), roots, other
    for depth in range(len(levels), 0, -1):
        here = some[depth][a]
        row, place, a, b = row[here], place[here], a[here], b[here]
        left, right = levels[depth - 1]
        row, place = np.tile(row, 2), np.concatenate([place * 2, place * 2 + 1])
        a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
    here = some[0][a]
    return row[here], place[here], a[here], b[here]


SCORE_SCHEMA = "lang string, source string, part string, item string, value long"


def _score_block(key, block: pa.Table, top: int) -> pa.Table:
    """Partial sums of all pairs between two bands of sources, and the first terms of each source, in one block of terms.

    block: side (0: first band, 1: second, 2: the whole lang), source, total,
    terms, term, n. Rows without a term name the groups.
    """
    lang, _, low, high = (k.as_py() for k in key)
    side, source, term, n = (block.column(c).to_pylist() for c in ("side", "source", "term", "n"))
    total, V = block.column("total").to_pylist(), block.column("terms")[0].as_py()
    groups = sorted({(s, x, t) for s, x, t in zip(side, source, total) if t is not None}, key=lambda g: (g[0], g[1] or ""))
    number = {g[:2]: i for i, g in enumerate(groups)}
    words = Counter()
    for t, c in zip(term, n):
        if t is not None:
            words[t] += c
    words = sorted(words, key=lambda t: (-words[t], t))  # rare terms side by side: their subtrees are alike
    place = {t: i for i, t in enumerate(words)}
    counts = np.full((len(groups), 1 << max(len(words) - 1, 0).bit_length()), -1, np.int64)  # -1: no term
    counts[:, : len(words)] = 0
    for s, x, t, c in zip(side, source, term, n):
        if t is not None and (s, x) in number:
            counts[number[s, x], place[t]] = c
    roots, leaves, levels = consed(counts)
    p = [shares(np.maximum(leaves, 0), g[2], V) for g in groups] if V else []
    first = [i for i, g in enumerate(groups) if g[0] == 0]
    second = [i for i, g in enumerate(groups) if g[0] == (0 if low == high else 1)]
    pairs = [(i, j) for i in first for j in second if low != high or i < j]
    out: list[tuple] = []
    if pairs:
        at = np.array(pairs)
        sums = np.zeros(len(pairs), np.int64)
        if V and words:
            walk, a, b, times = walks(roots[at[:, 0]], roots[at[:, 1]], levels)
            real = leaves[a] >= 0
            walk, a, b, times = walk[real], a[real], b[real], times[real]
            table_p = np.stack([x.astype(np.int64) for x in p])
            np.add.at(sums, walk, times * prices(table_p[at[walk, 0], a], table_p[at[walk, 1], b]))
        for (i, j), v in zip(pairs, sums.tolist()):
            out += [(groups[i][1], "pair", groups[j][1], v), (groups[j][1], "pair", groups[i][1], v)]
    if low == high and V and words:
        whole = number[2, None]
        row, where, a, b = _occurring(roots[first], np.repeat(roots[whole], len(first)), leaves, levels)
        table_p = np.stack([x.astype(np.int64) for x in p])
        mine, q = table_p[np.array(first, np.int64)[row], a], table_p[whole, b]
        up = mine > q
        row, where, value = row[up], where[up], prices(mine[up], q[up])
        by_text = np.empty(len(words), np.int64)
        by_text[sorted(range(len(words)), key=lambda i: words[i].encode())] = np.arange(len(words))
        order = np.lexsort((by_text[where], -value, row))
        row, where, value = row[order], where[order], value[order]
        begin = np.searchsorted(row, row)
        best = np.arange(len(row)) - begin < top
        out += [(groups[first[r]][1], "term", words[w], v) for r, w, v in zip(row[best].tolist(), where[best].tolist(), value[best].tolist())]
    columns = list(zip(*out)) or [[]] * 4
    return pa.table([pa.array([lang] * len(out), pa.string()), *[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64())], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a lang departs from the others and which terms it overuses.

    Nulls in text, lang and source count as ''. Every (lang, source) that
    occurs is a group, also without terms; a lang without kept terms gives 0
    for its pairs and no terms. A source that is alone in its lang has no
    pairs. Repeated rows count as often as they occur; ties go by the UTF-8
    bytes of the item; an empty table gives no rows; other columns are not
    read.
    """
    spark = docs.sparkSession
    kept = settle(kept_counts(docs, least), "kept")
    sources = _plain(docs).select("lang", "source").distinct()
    spoken = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"))
    groups = sources.join(spoken, ["lang", "source"], "left").na.fill(0, ["total"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.count(F.lit(1)).alias("sources")).join(vocabulary, "lang", "left").na.fill(0, ["terms"])
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK))).withColumn("bands", F.ceil(F.col("sources") / BAND))
    groups = settle(groups.join(langs.select("lang", "terms", "blocks", "bands"), "lang"), "groups")
    langs = settle(langs, "langs")

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows of sources go to every pair of bands that their own is in."""
        band = F.pmod(F.xxhash64("source"), F.col("bands"))
        meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bands") - 1)).alias("other")
        rows = rows.select("*", band.alias("band"), meets)
        low, high = F.least("band", "other"), F.greatest("band", "other")
        return rows.withColumns({"low": low, "high": high, "side": F.when(F.col("band") == low, 0).otherwise(1)})

    def every(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))

    cols = ["lang", "block", "low", "high", "side", "source", "total", "terms", "term", "n"]
    nothing = [F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n")]
    none = F.lit(None)
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    shapes = langs.select("lang", "terms", "blocks", "bands")
    named = dealt(groups.withColumn("block", every("blocks"))).select(*cols[:-2], *nothing)
    counted = dealt(kept.join(shapes, "lang").withColumn("block", block).withColumn("total", none.cast("long"))).select(*cols)
    own = dict(side=F.lit(2), source=none.cast("string"))
    whole = langs.select("*", every("blocks").alias("block")).withColumns(own | {"total": F.col("whole")}).select("*", every("bands").alias("low"), *nothing).withColumn("high", F.col("low"))
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(shapes, "lang").withColumn("block", block)
    # Every cell needs all terms of its block: two sources that both lack a term differ in its share too.
    of_lang = of_lang.withColumns(own | {"total": none.cast("long")}).select("*", every("bands").alias("low"))
    of_lang = of_lang.select("*", F.explode(F.sequence("low", F.col("bands") - 1)).alias("high"))
    rows = named.unionByName(counted).unionByName(whole.select(*cols)).unionByName(of_lang.select(*cols))
    scored = rows.groupBy("lang", "block", "low", "high").applyInArrow(lambda key, block: _score_block(key, block, top), SCORE_SCHEMA)
    scored = settle(scored, "scored")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = scored.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = scored.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = settle(pairs.unionByName(terms), "audit")
    discard(kept, groups, langs, scored)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between the sources of each lang, and the ten terms that each source overuses most.

    Nulls count as ''; groups without terms take part.
    """
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (SELECT i, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS terms FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // CAST(coalesce(t.total, 0) + 2 * v.terms AS HUGEINT) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), l AS (
  SELECT k.lang, k.term, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(x.n, 0) + 2) // CAST(coalesce(y.total, 0) + 2 * v.terms AS HUGEINT) AS q
  FROM k JOIN v USING (lang) LEFT JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) x USING (lang, term)
  LEFT JOIN (SELECT lang, sum(total) AS total FROM t GROUP BY lang) y USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN s y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM s JOIN l USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, CAST(value AS BIGINT), row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
