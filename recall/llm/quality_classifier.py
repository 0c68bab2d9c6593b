"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of the whole text (lengths, character classes, repetition) are
standardised and mapped by z_k = cos(w_k x + b_k), whose inner products approximate a Gaussian
kernel. Each partition adds up its Z'Z and Z'y over the labelled rows of folds 1 to 3; the
sums (a ``FEATURES``-square matrix each) are added in about sqrt(partitions) groups and solved on
the driver. Raw scores of fold 4 are counted in a fixed grid; pooling adjacent violators over
the grid's counts gives the calibration. All labelled rows take part; fold 0 never does.

Defined cases: a null or empty text has zero statistics and a score like any other; without labelled rows
the score is 0, with one label only that label; null ids and labels are not learnt from, of repeated
labels the largest counts; repeated rows score alike; an empty table gives an empty result;
further columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.llm.rows import FOLDS, fold, written

FEATURES = 256
RIDGE = 1.0
BANDWIDTH = 2.0   # kernel width in standard deviations, per sqrt(statistics)
CALIBRATION = FOLDS - 1
GRID = 2000       # cells of a raw score's unit interval
SEED = 11
STATISTICS = ("log words", "log characters", "word length", "distinct words", "repeats", "symbols", "bars", "exclamations", "capitals",
              "digits", "stops", "commas", "other marks", "beyond ASCII", "lines per word", "repeated lines", "short words", "long words")

CLASSES = np.zeros((256, 9))
for _k, _chars in enumerate((b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), b"0123456789", b".?", b",;:", b"\"'()[]{}-_/\\+=~^`@", bytes(range(128, 256)))):
    CLASSES[list(_chars), _k] = 1


def statistics(text: str | None) -> list[float]:
    """``STATISTICS`` of a text, as shares where they would grow with its length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    lengths = np.fromiter(map(len, words), np.int64, n)
    per_word = max(1, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    classes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / size
    return [
        math.log1p(n), math.log1p(len(raw)), lengths.sum() / per_word, len(set(words)) / math.sqrt(per_word),
        sum(map(bytes.__eq__, words, words[1:])) / per_word, *classes.tolist(), len(lines) / per_word,
        1 - len(set(lines)) / max(1, len(lines)), float((lengths < 4).sum()) / per_word, float((lengths > 12).sum()) / per_word]


def text_statistics(source: DataFrame) -> DataFrame:
    """``at, doc_id, x`` for each row of ``located(docs)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["at", "doc_id", "x"])

    return source.select("at", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text").mapInArrow(
        run, "at struct<file:string,row:bigint>, doc_id long, x array<double>")


@dataclass
class Fourier:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale).clip(-8, 8) @ self.w + self.b) * math.sqrt(2.0 / self.b.size)
        return np.c_[np.ones(len(x)), z]


def fourier(known: DataFrame) -> Fourier:
    """The map, standardised by the mean and deviation of the labelled rows' statistics (one row collected)."""
    k = len(STATISTICS)
    parts = [f(F.col("x")[i]) for i in range(k) for f in (F.avg, F.stddev_pop)]
    moments = np.array([0.0 if v is None else v for v in known.agg(*parts).first()]).reshape(k, 2)
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, 1 / (BANDWIDTH * math.sqrt(k)), (k, FEATURES))
    scale = np.where(moments[:, 1] > 1e-9, moments[:, 1], 1.0)
    return Fourier(moments[:, 0], scale, w, rng.uniform(0, 2 * math.pi, FEATURES))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def normal_equations(known: DataFrame, z: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over the rows ``(x, label)``, by partition, then by group of partitions, then here."""
    width = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            f = z(matrix(batch.column("x")))
            total += f.T @ np.c_[f, batch.column("label").to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])],
                                         names=["part", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["sums"])
        return pd.DataFrame({"sums": [total.tobytes()]})

    parts = written(known.select("x", F.col("label").cast("double").alias("label")).mapInArrow(sums, "part int, sums binary"), "normal-equations")
    groups = max(1, math.isqrt(parts.count()))
    rows = parts.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInPandas(added, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(width * (width + 1))).reshape(width, width + 1)
    return total[:, :-1], total[:, -1]


def isotonic(x: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: places and non-decreasing shares of the blocks."""
    blocks: list[list[float]] = []
    for place, n, p in zip(x.tolist(), weight.tolist(), positive.tolist()):
        blocks.append([place * n, n, p])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], a)]
    done = np.array(blocks)
    return done[:, 0] / done[:, 1], done[:, 2] / done[:, 1]


@dataclass
class Classifier:
    z: Fourier
    weights: np.ndarray
    places: np.ndarray
    shares: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.interp(raw, self.places, self.shares) if self.places.size else np.clip(raw, 0, 1)


def learn(table: DataFrame, labels: DataFrame, label: str = "quality") -> Classifier:
    """The classifier fitted on the labelled rows of ``text_statistics``."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0)) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    rows = written(table.join(known, "doc_id").select("x", "label", fold().alias("fold")), "labelled-statistics")
    fit = rows.filter(F.col("fold") != CALIBRATION)
    z = fourier(fit)
    a, b = normal_equations(fit, z)
    weights = np.linalg.solve(a + RIDGE * np.eye(len(a)) * np.r_[1e-6, np.ones(len(a) - 1)], b) if a[0, 0] else np.zeros(len(b))
    model = Classifier(z, weights, np.empty(0), np.empty(0))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(matrix(batch.column("x"))).clip(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(raw * GRID).astype(np.int64)), batch.column("label")], names=["cell", "label"])

    counts = rows.filter(F.col("fold") == CALIBRATION).select("x", "label").mapInArrow(cells, "cell long, label int") \
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).orderBy("cell").toPandas()  # at most 3 * GRID + 1 rows
    if len(counts):
        model.places, model.shares = isotonic(counts["cell"].to_numpy() / GRID, counts["n"].to_numpy(float), counts["p"].to_numpy(float))
    return model


def score(source: DataFrame, labels: DataFrame) -> DataFrame:
    """``at, doc_id, held_out, score`` for each row of ``located(docs)``."""
    table = written(text_statistics(source), "text-statistics")
    shared = source.sparkSession.sparkContext.broadcast(learn(table, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), batch.column("doc_id"), pa.array(model.score(matrix(batch.column("x"))))], names=["at", "doc_id", "score"])

    scored = table.mapInArrow(run, "at struct<file:string,row:bigint>, doc_id long, score double")
    return scored.select("at", "doc_id", (fold() == 0).alias("held_out"), "score")
