"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed, each once more where it occurs
twice and four times in a text; a document has each term or not. The machine's
logit is linear in the terms plus the inner products of their factors, so a
pair (an insult with a group mention) can weigh more than its parts.

Learning takes a bounded sample of labelled documents (SAMPLE rows), of which
texts that repeat count once. Spark counts the sample's terms and picks those
that go with the label by G-squared, over all of the sample and, for the
partners of a pair, inside the documents that hold one of the strongest terms.
Only places of picked terms come to the driver, at most PAIRS of them. There
the machine is fitted by Adagrad; its penalty is the one that does best on a
fifth of the sample held back. Scoring is map-only over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import UPPER_TO_LOWER, crc_mod, discard, portions, settle, table, texts, word_bounds, word_hashes

#: Bytes of the word beginnings that are terms beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Times that a term must occur for its 1st, 2nd and 3rd level.
LEVELS = (1, 2, 4)
SAMPLE, PAIRS = 20_000, 8_000_000
#: Terms kept at most, and partners among them; terms that pick the documents
#: in which partners are looked for; the least G-squared of a kept term, which
#: one term in a thousand reaches by chance.
TERMS, PARTNERS, ANCHORS, LEAST_G2 = 2048, 512, 64, 10.83
FACTORS = 8
PENALTIES = (1e-4, 1e-3, 1e-2)

_GAP = np.zeros(256, bool)
_GAP[list(range(0x30)) + list(range(0x3A, 0x61)) + list(range(0x7B, 0x80))] = True


def terms(rows: list[bytes], kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs of many texts, each pair once, in order of rows and terms.

    With ``kept`` (sorted) only those terms come out.
    """
    data = b"\0".join(rows).translate(UPPER_TO_LOWER)
    buf = np.frombuffer(data, np.uint8)
    start, end = word_bounds(buf, _GAP)
    row = np.searchsorted(np.cumsum([0] + [len(r) + 1 for r in rows]), start, side="right") - 1
    whole = word_hashes(buf, start, end, 1)
    # Beginnings are hashed once for each different word.
    words, first, place = np.unique(whole, return_index=True, return_inverse=True)
    at, length = start[first], end[first] - start[first]
    codes, has = [words >> np.uint64(32)], [np.ones(len(words), bool)]
    for n in BEGINNINGS:
        long = length >= n
        code = np.zeros(len(words), np.uint64)
        code[long] = word_hashes(buf, at[long], at[long] + n, 2 + n) >> np.uint64(32)
        codes.append(code), has.append(long)
    if kept is not None:
        wanted = np.unique(kept >> 2).astype(np.uint64)
        has = [h & np.isin(c, wanted) for c, h in zip(codes, has)]
    keys = []
    for code, have in zip(codes, has):
        here = np.flatnonzero(have[place])
        keys.append((row[here].astype(np.uint64) << np.uint64(32)) | code[place[here]])
    pairs, times = np.unique(np.concatenate(keys), return_counts=True)
    out_row, out_term = [], []
    for i, least in enumerate(LEVELS):
        some = pairs[times >= least]
        out_row.append((some >> np.uint64(32)).astype(np.int64))
        out_term.append(((some & np.uint64(0xFFFFFFFF)) << np.uint64(2)).astype(np.int64) | i)
    r, t = np.concatenate(out_row), np.concatenate(out_term)
    if kept is not None:
        good = np.isin(t, kept)
        r, t = r[good], t[good]
    order = np.lexsort((t, r))
    return r[order], t[order]


class Machine:
    """Bias, linear weights and factors over the kept terms."""

    def __init__(self, kept: np.ndarray, factors: int = FACTORS, seed: int = 5):
        self.kept = np.sort(np.asarray(kept, np.int64))
        self.b = 0.0
        self.w = np.zeros(len(kept))
        self.v = np.random.default_rng(seed).normal(0, 0.1, (len(kept), factors))

    def logit(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Logits of n rows from (row, kept term) pairs sorted by row."""
        pair = -0.5 * np.bincount(row, (self.v * self.v).sum(1)[at], n)
        for f in range(self.v.shape[1]):
            s = np.bincount(row, self.v[at, f], n)
            pair += 0.5 * s * s
        return self.b + np.bincount(row, self.w[at], n) + pair

    def find(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with kept terms only, terms numbered by place."""
        if not len(self.kept):
            return row[:0], term[:0]
        at = np.minimum(np.searchsorted(self.kept, term), len(self.kept) - 1)
        good = self.kept[at] == term
        return row[good], at[good]

    def fit(self, row: np.ndarray, at: np.ndarray, y: np.ndarray, penalty: float = 1e-3, epochs: int = 30, rate: float = 0.1, batch: int = 256, seed: int = 6) -> Machine:
        """Adagrad on the logistic loss with an L2 penalty on weights and factors."""
        n = len(y)
        self.b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        first = np.searchsorted(row, np.arange(n + 1))
        rng = np.random.default_rng(seed)
        gb, gw, gv = 1e-8, np.full(self.w.shape, 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                docs = order[i : i + batch]
                size = first[docs + 1] - first[docs]
                local = np.repeat(np.arange(len(docs)), size)
                places = np.repeat(first[docs] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
                a = at[places]
                err = 1 / (1 + np.exp(-np.clip(self.logit(local, a, len(docs)), -30, 30))) - y[docs]
                err /= len(docs)
                g = float(err.sum())
                gb += g * g
                self.b -= rate * g / np.sqrt(gb)
                used, slot = np.unique(a, return_inverse=True)
                share = np.bincount(slot, minlength=len(used)) / len(docs)
                dw = np.bincount(slot, err[local], len(used)) + penalty * share * self.w[used]
                gw[used] += dw * dw
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                for f in range(self.v.shape[1]):
                    v = self.v[:, f]
                    s = np.bincount(local, v[a], len(docs))
                    dv = np.bincount(slot, err[local] * (s[local] - v[a]), len(used)) + penalty * share * v[used]
                    gv[used, f] += dv * dv
                    self.v[used, f] -= rate * dv / np.sqrt(gv[used, f])
        return self


def log_loss(machine: Machine, row: np.ndarray, at: np.ndarray, y: np.ndarray) -> float:
    z = np.clip(machine.logit(row, at, len(y)), -30, 30)
    return float(np.mean(np.log1p(np.exp(-z)) + (1 - y) * z)) if len(y) else 0.0


def fitted(kept: np.ndarray, row: np.ndarray, term: np.ndarray, y: np.ndarray) -> Machine:
    """The machine with the penalty that does best on every fifth row, fitted on all rows."""
    row, at = Machine(kept).find(row, term)
    fifth = np.arange(len(y)) % 5 == 0
    scores = []
    for penalty in PENALTIES:
        sides = []
        for side in (~fifth, fifth):
            new = np.cumsum(side) - 1
            mine = side[row]
            sides.append((new[row[mine]], at[mine], y[side]))
        scores.append(log_loss(Machine(kept).fit(*sides[0], penalty), *sides[1]))
    return Machine(kept).fit(row, at, y, PENALTIES[int(np.argmin(scores))])


def g_squared(hit: Column, seen: Column, positives: float, total: float) -> Column:
    """Log-likelihood ratio of term and label from document counts."""

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    p = positives / total
    rest, none = seen - hit, F.lit(float(total)) - seen
    left = F.lit(float(positives)) - hit
    return 2 * (part(hit, seen * p) + part(rest, seen * (1 - p)) + part(left, none * p) + part(none - left, none * (1 - p)))


def strongest(places: DataFrame, positives: int, total: int, most: int, least: float = LEAST_G2) -> list[tuple[int, float]]:
    """The terms (h, toxic, term) rows say most about the label, the strongest first."""
    if not 0 < positives < total:
        return []
    sums = places.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("seen"), F.sum("toxic").cast("double").alias("hit")).filter("seen >= 2")
    told = sums.select("term", g_squared(F.col("hit"), F.col("seen"), positives, total).alias("g2")).filter(F.col("g2") >= least)
    return [(r["term"], r["g2"]) for r in told.orderBy(F.desc("g2"), "term").limit(most).collect()]  # ``most`` rows


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine:
    """A machine from doc_id, text and doc_id, toxic (null labels left out).

    At most ``most`` labelled ids are used, drawn by a hash of the id; an id or
    a text that is labelled twice is toxic if one label says so. Without both
    labels the machine has no terms and scores the share of toxic rows.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most)
    some = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most ``most`` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in portions(texts(batch, "text")):
                row, term = terms(part)
                cut = np.searchsorted(row, np.arange(len(part) + 1))
                mine = batch.slice(i, len(part))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term))
                yield pa.RecordBatch.from_arrays([mine.column("h"), mine.column("toxic"), lists], ["h", "toxic", "terms"])

    texts_of = some.select(F.xxhash64("text").alias("h"), "text", "toxic").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    sample = settle(texts_of.select("h", "text", "toxic").mapInArrow(run, "h long, toxic int, terms array<long>"), "toxic_sample")
    total, positives = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    places = sample.select("h", "toxic", F.explode("terms").alias("term"))
    alone = strongest(places, positives, total, TERMS - PARTNERS)
    if not alone:
        machine = Machine(np.zeros(0, np.int64))
        machine.b = float(np.log((positives + 0.5) / (total - positives + 0.5)))
        return machine
    anchors = F.array(*[F.lit(t) for t, _ in alone[:ANCHORS]])
    near = settle(sample.filter(F.arrays_overlap("terms", anchors)), "toxic_near")
    n_near, p_near = near.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    partners = strongest(near.select("h", "toxic", F.explode("terms").alias("term")), p_near, n_near, TERMS)
    kept = [t for t, _ in alone]
    kept += [t for t, _ in partners if t not in set(kept)][:PARTNERS]
    kept = np.sort(np.array(kept, np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(kept)  # TERMS numbers

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.flatnonzero(np.isin(shared.value, np.array(t, np.int64))).astype(np.uint16).tobytes() for t in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array(held, pa.binary())], ["h", "toxic", "places"])

    rows = settle(sample.mapInArrow(places_of, "h long, toxic int, places binary"), "toxic_places")
    pairs = rows.agg(F.coalesce(F.sum(F.length("places")) / 2, F.lit(0.0))).first()[0]
    got = rows.orderBy("h").limit(int(most * min(1.0, PAIRS / max(pairs, 1)))).toArrow()
    y = got["toxic"].to_numpy().astype(float)
    lists = [np.frombuffer(x, np.uint16) for x in got["places"].to_pylist()]
    row = np.repeat(np.arange(len(y)), [len(x) for x in lists])
    machine = fitted(kept, row, kept[np.concatenate(lists)], y)
    discard(sample, near, rows)
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on).

    Null and empty texts score what a text without known terms does. Ids may
    be null or repeated; an empty table gives no rows; extra columns are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # TERMS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for i, part in portions(texts(batch, "text")):
                z = m.logit(*m.find(*terms(part, m.kept)), len(part))
                p[i : i + len(part)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    machine = learn(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    return score(docs, machine).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
