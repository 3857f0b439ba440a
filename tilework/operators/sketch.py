"""Quantiles of all rows by a mergeable sketch, all features in one pass.

A sketch holds buffers of values, one for each level; a value of level h
stands for 2**h rows. A buffer that is full is sorted and every other value
moves up a level, the odd and the even ones in turn. That shifts no rank by
more than 2**h, so a sketch knows how wrong it can be: the sum of these shifts.
Sketches merge by putting their levels together, so each task makes its own
and they are merged in two steps. The error grows with the logarithm of the
rows: about log2(rows / SIZE) / SIZE of all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilework.operators.blocks import pack_rows, packed

#: Values of a buffer; features whose buffers travel in one row; groups of the first merging step.
SIZE, CHUNK, GROUPS = 1024, 16, 64
SCHEMA = "chunk int, part int, level int, turn int, rows long, shift long, data binary"


class Sketch:
    """Buffers of several features that see the same rows."""

    def __init__(self, features: int, size: int = SIZE):
        self.features, self.size = features, size
        self.levels: list[np.ndarray] = [np.zeros((features, 0))]
        self.turns = [0]
        self.rows = self.shift = 0

    def add(self, values: np.ndarray) -> None:
        """values: rows by features."""
        for at in range(0, len(values), self.size):
            part = values[at : at + self.size].T
            self.rows += part.shape[1]
            self.levels[0] = np.concatenate([self.levels[0], part], axis=1)
            self._compact()

    def merge(self, other: Sketch) -> None:
        self.rows, self.shift = self.rows + other.rows, self.shift + other.shift
        for h, values in enumerate(other.levels):
            self._up_to(h)
            self.levels[h] = np.concatenate([self.levels[h], values], axis=1)
        self._compact()

    def _up_to(self, h: int) -> None:
        while len(self.levels) <= h:
            self.levels.append(np.zeros((self.features, 0)))
            self.turns.append(0)

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            values = self.levels[h]
            if values.shape[1] >= 2 * self.size:
                self._up_to(h + 1)
                whole = values.shape[1] // 2 * 2
                ranked = np.sort(values[:, :whole], axis=1)
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], ranked[:, self.turns[h] :: 2]], axis=1)
                self.levels[h] = values[:, whole:]
                self.turns[h] ^= 1
                self.shift += 1 << h
            h += 1

    def quantiles(self, at: Sequence[float]) -> np.ndarray:
        """For each feature the values at these shares of the rows; each is a value that occurs, and they do not fall."""
        values = np.concatenate(self.levels, axis=1)
        weight = np.concatenate([np.full(v.shape[1], 1 << h) for h, v in enumerate(self.levels)])
        order = np.argsort(values, axis=1, kind="stable")
        upto = np.cumsum(weight[order], axis=1)
        out = np.empty((self.features, len(at)))
        for f in range(self.features):
            place = np.searchsorted(upto[f], np.asarray(at) * upto[f, -1])
            out[f] = values[f, order[f, np.minimum(place, len(weight) - 1)]]
        return np.maximum.accumulate(out, axis=1)

    def to_rows(self, chunk: int, part: int) -> list[tuple]:
        return [(chunk, part, h, self.turns[h], self.rows, self.shift, np.ascontiguousarray(v).tobytes()) for h, v in enumerate(self.levels)]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.int64()] * 2 + [pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)


def _from_rows(rows: list[dict], features: int, size: int) -> Sketch:
    """The sketch of rows with one (chunk, part)."""
    out = Sketch(features, size)
    out.rows, out.shift = rows[0]["rows"], rows[0]["shift"]
    for r in sorted(rows, key=lambda r: r["level"]):
        out._up_to(r["level"])
        out.levels[r["level"]], out.turns[r["level"]] = np.frombuffer(r["data"], np.float64).reshape(features, -1), r["turn"]
    return out


def sketches(blocks: DataFrame, width: int, size: int = SIZE) -> list[Sketch]:
    """A sketch for each CHUNK features of the training rows of packed blocks (see blocks.pack_rows).

    The driver gets a few thousand values for each feature.
    """
    spans = [(c, at, min(at + CHUNK, width)) for c, at in enumerate(range(0, width, CHUNK))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = [Sketch(b - a, size) for _, a, b in spans]
        for batch in batches:
            x = packed(batch, "x", np.float64, width)[packed(batch, "split", np.uint8, 1)[:, 0] == 0]
            for sketch, (_, a, b) in zip(own, spans):
                sketch.add(x[:, a:b])
        part = TaskContext.get().partitionId()
        for sketch, (c, _, _) in zip(own, spans):
            if sketch.rows:
                yield from _table(sketch.to_rows(c, part)).to_batches()

    def merge(key, table):
        chunk, group = key[0].as_py(), key[1].as_py()
        _, a, b = spans[chunk]
        parts: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            parts.setdefault(r["part"], []).append(r)
        first, *more = [_from_rows(parts[p], b - a, size) for p in sorted(parts)]
        for other in more:
            first.merge(other)
        return _table(first.to_rows(chunk, group))

    made = blocks.select("split", "x").mapInArrow(run, SCHEMA)
    some = made.groupBy("chunk", F.pmod("part", F.lit(GROUPS)).alias("group")).applyInArrow(merge, SCHEMA)
    whole = some.groupBy("chunk", F.lit(0).alias("group")).applyInArrow(merge, SCHEMA)
    told: dict[int, list[dict]] = {}
    for r in whole.collect():
        told.setdefault(r["chunk"], []).append(r.asDict())
    return [_from_rows(told[c], b - a, size) if c in told else Sketch(b - a, size) for c, a, b in spans]


def sketched_thresholds(blocks: DataFrame, width: int, bins: int, size: int = SIZE) -> tuple[list[list[float]], float]:
    """(bins - 1 cuts of each feature, the share of rows by which the rank of a cut may be off)."""
    at = [j / bins for j in range(1, bins)]
    found = sketches(blocks, width, size)
    cuts = [row.tolist() for s in found for row in (s.quantiles(at) if s.rows else np.zeros((s.features, len(at))))]
    # One value of the top level on each side, besides the shifts.
    off = max((s.shift + (1 << (len(s.levels) - 1)) for s in found if s.rows), default=0)
    return cuts, off / max([1, *(s.rows for s in found)])


def quantile_sketch(df: DataFrame, features: Sequence[str], bins: int = 32, size: int = SIZE) -> DataFrame:
    """(feature, thresholds, error) over all rows of df, which are numbers; an empty table gives no rows."""
    spark = df.sparkSession
    blocks = pack_rows(df.withColumns({"_part": F.lit(0), "_y": F.lit(0.0)}), features, "_y")
    cuts, error = sketched_thresholds(blocks, len(features), bins, size)
    rows = [(c, t, float(error)) for c, t in zip(features, cuts) if error]
    return spark.createDataFrame(rows, "feature string, thresholds array<double>, error double")
