"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (one to three characters, words padded
by one space) weighted by TF-IDF and scaled to length one. Document counts for
the IDF cover every training document. The weights are fitted on a bounded
sample (PER_LABEL documents a language are expected) with per-coordinate
follow-the-regularised-leader and an elastic-net penalty, which leaves most of
them zero; a temperature fitted on a held-back fifth of the sample calibrates
the scores. Prediction is map-only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.common import crc_mod, scramble, table

HASH_BITS = 14
SIZE = 1 << HASH_BITS
ORDERS = (1, 2, 3)
PER_LABEL = 1500
UNKNOWN = "und"
#: How far from chance (0) to certainty (1) a score must lie to be beyond doubt.
MARGIN = 1 / 3
#: A doubtful text goes only if at most this share of labelled texts of its length scores as low.
RARE = 0.02
FOLDS = 5

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters, for all of them; built once a worker."""
    if not _LETTERS:
        _LETTERS.append(np.char.isalpha(np.arange(0x110000, dtype=np.uint32).view("U1")))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts by hash bucket, or None without any letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    # Letters stay, every run of others becomes one space.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    line = np.where(is_letter, points, 32)[keep].astype(np.uint64)
    line = np.concatenate(([np.uint64(32)], line, [np.uint64(32)]))
    out = np.zeros(SIZE, np.int64)
    key = np.zeros(len(line), np.uint64)
    for n in ORDERS:
        key = (key[: len(line) - n + 1] << np.uint64(21)) | line[n - 1 :]
        out += np.bincount((scramble(key, n) >> np.uint64(64 - HASH_BITS)).astype(np.int64), minlength=SIZE)
    return out


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((value * value).sum())
    return at, value / norm if norm else value


def document_counts(train: DataFrame) -> np.ndarray:
    """Training documents that hold each bucket; the last entry counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts = ngram_counts(text)
                if counts is not None:
                    seen[:SIZE] += counts > 0
                    seen[SIZE] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    sums = train.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(SIZE + 1, np.int64)
    for row in sums.collect():  # at most SIZE + 1 rows
        out[row["bucket"]] = row["n"]
    return out


def sample(train: DataFrame, per_label: int) -> DataFrame:
    """(h, text, lang): about per_label documents of each language, by a hash of id and text; rows alike in these count once."""
    share = train.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(per_label * 1.0) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    some = train.join(F.broadcast(share.withColumnRenamed("lang", "_lang")), F.col("lang") == F.col("_lang")).filter(drawn < F.col("share"))  # one row for each language
    return some.select(F.xxhash64(F.lit(8), "doc_id", "text").alias("h"), "text", "lang").dropDuplicates(["h", "lang"])


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2."""

    def __init__(self, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.001):
        self.z = np.zeros((SIZE + 1, classes))
        self.n = np.zeros((SIZE + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p[None, :]
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 4) -> tuple[list[str], np.ndarray, float]:
    """Languages, weights (buckets and a bias row) and temperature.

    rows: bucket numbers, values and label of each sampled document, in the
    order in which they are learned.
    """
    labels = sorted({lang for _, _, lang in rows})
    code = {lang: i for i, lang in enumerate(labels)}
    held = [r for i, r in enumerate(rows) if i % FOLDS == 0]
    w = trained([r for i, r in enumerate(rows) if i % FOLDS] or rows, code, epochs)
    return labels, w, temperature_of(logits_of(held, w), np.array([code[lang] for _, _, lang in held]))


def trained(rows: list[tuple[np.ndarray, np.ndarray, str]], code: dict[str, int], epochs: int = 4) -> np.ndarray:
    """Weights after some passes over the rows."""
    model, bias = Ftrl(len(code)), np.array([SIZE])
    for _ in range(epochs):
        for at, value, lang in rows:
            model.step(np.concatenate((at, bias)), np.append(value, 1.0), code[lang])
    return model.weights(slice(None))


def logits_of(rows: list[tuple[np.ndarray, np.ndarray, str]], w: np.ndarray) -> np.ndarray:
    return np.array([value @ w[at] + w[SIZE] for at, value, _ in rows])


def cross_fit(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> tuple[list[str], np.ndarray, float, np.ndarray]:
    """Languages, weights of all rows, temperature, and the calibrated score of each row by weights that did not learn from it."""
    labels = sorted({lang for _, _, lang in rows})
    code = {lang: i for i, lang in enumerate(labels)}
    logits, truth = np.zeros((len(rows), len(labels))), np.array([code[lang] for _, _, lang in rows])
    for fold in range(min(FOLDS, len(rows))):
        mine = list(range(fold, len(rows), FOLDS))
        logits[mine] = logits_of([rows[i] for i in mine], trained([r for i, r in enumerate(rows) if i % FOLDS != fold] or rows, code))
    t = temperature_of(logits, truth)
    return labels, trained(rows, code), t, softmax(logits / t).max(axis=1)


def temperature_of(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature under which held-back rows are likeliest."""
    held = truth
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    # Few texts that are all told right would call for a temperature near 0: the
    # rule of succession leaves each of them a doubt, spread over all languages.
    doubt = 1 / (len(held) + 2)
    loss = []
    for t in grid:
        logs = np.log(softmax(logits / t) + 1e-12)
        loss.append(-((1 - doubt) * logs[np.arange(len(truth)), truth] + doubt * logs.mean(1)).mean())
    return float(grid[int(np.argmin(loss))])


def identify(docs: DataFrame, train: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs; learns from train.

    train has doc_id, text and lang (rows with a null lang are left out). A
    text that is null or without any letter is ``und`` with score 0, and so is
    every text when there is nothing to learn from. Ids may be null or
    repeated; extra columns are not read.
    """
    return predict(docs, *learn(train, per_label))


def learn(train: DataFrame, per_label: int = PER_LABEL):
    """Languages, weights, temperature and IDF from (doc_id, text, lang); no languages where no row has both a lang and a letter."""
    rows, idf = features(train, per_label)
    return (*fit(rows), idf) if rows else ([], np.zeros((SIZE + 1, 0)), 1.0, idf)


def features(train: DataFrame, per_label: int) -> tuple[list[tuple[np.ndarray, np.ndarray, str]], np.ndarray]:
    """(buckets, values, lang) of the sampled rows, in an order of their hash, and the IDF."""
    train = train.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    seen = document_counts(train)
    idf = np.log((1 + seen[SIZE]) / (1 + seen[:SIZE])) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value, lang, order = [], [], [], []  # numbers as bytes: small on the driver
            for doc, text, label in zip(*[batch.column(c).to_pylist() for c in ("h", "text", "lang")]):
                counts = ngram_counts(text)
                if counts is not None:
                    a, v = tf_idf(counts, idf)
                    at.append(a.astype(np.int32).tobytes()), value.append(v.astype(np.float32).tobytes()), lang.append(label), order.append(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(order, pa.int64()), pa.array(at, pa.binary()), pa.array(value, pa.binary()), pa.array(lang, pa.string())],
                ["h", "at", "value", "lang"],
            )

    # The sample is bounded by per_label a language, so it fits the driver.
    got = sorted(sample(train, per_label).mapInArrow(run, "h long, at binary, value binary, lang string").toLocalIterator(), key=lambda r: (r["h"], r["lang"]))
    return [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32), r["lang"]) for r in got], idf


def judge(rows: list[str | None], labels: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float) -> tuple[list[str], list[float]]:
    """Language and calibrated score of each text."""
    lang, score = [], []
    for text in rows:
        counts = ngram_counts(text)
        if counts is None or not labels:
            lang.append(UNKNOWN), score.append(0.0)
            continue
        at, value = tf_idf(counts, idf)
        p = softmax((value @ weights[at] + weights[SIZE]) / temperature)
        lang.append(labels[int(p.argmax())]), score.append(float(p.max()))
    return lang, score


def predict(docs: DataFrame, labels: list[str], w: np.ndarray, temperature: float, idf: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = judge(batch.column("text").to_pylist(), labels, *shared.value, temperature)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def least_score(languages: int) -> float:
    """The score from which a text is accepted: MARGIN of the way from chance to certainty."""
    return 1 / languages + MARGIN * (1 - 1 / languages)


def is_rare(score: float, length: int, scores: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether at most RARE of the labelled texts that are no more than twice as long score as low.

    The text itself is counted with them, so with fewer than 1 / RARE - 1 such
    texts nothing is rare: there is no ground to reject it.
    """
    alike = lengths <= 2 * length
    return (1 + int((scores[alike] <= score).sum())) / (1 + int(alike.sum())) <= RARE


def accept(docs: DataFrame, train: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of the learned languages.

    Rejected are texts that are null or without any letter (``und``), and
    texts that are both in doubt and unlike the labelled ones: their
    calibrated score is below least_score(), and hardly any labelled text of
    such a length scores as low when it is held back (is_rare()). Texts in
    another script or strings of random letters do so. Labelled texts score
    through folds that did not learn from them, which also gives the
    temperature. A text that is like the labelled ones goes with a chance of
    RARE at most, whatever their number; with few labelled texts, with few as
    short as a text is, or with none, texts with a letter stay. Repeated rows
    have one fate; an empty table gives no rows; columns other than text are
    only carried along.
    """
    rows, idf = features(train, per_label)
    labels, w, temperature, scores = cross_fit(rows) if rows else ([], np.zeros((SIZE + 1, 0)), 1.0, np.zeros(0))
    lengths = np.array([len(at) for at, _, _ in rows])  # distinct n-grams
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), idf, scores, lengths))  # per_label rows a language at most
    least = least_score(len(labels)) if labels else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for text in batch.column("text").to_pylist():
                counts = ngram_counts(text)
                if counts is None or not labels:
                    stays.append(counts is not None)
                    continue
                weights, idf, known, sizes = shared.value
                at, value = tf_idf(counts, idf)
                score = float(softmax((value @ weights[at] + weights[SIZE]) / temperature).max())
                stays.append(score >= least or not is_rare(score, len(at), known, sizes))
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.filter(crc_mod("doc_id", 4) != 2))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
