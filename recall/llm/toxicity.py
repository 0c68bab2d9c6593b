"""Toxicity by a second-order factorization machine over hashed terms.

    logit(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with x_i = 1 when a term hashing to i occurs in the text. The second sum lets a pair of terms (an insult
and a group's name) weigh more than the two alone, which additive weights miss; it costs one
pass: ((sum v_i)^2 - sum v_i^2) / 2.

The model is fitted from at most ``SAMPLE`` labelled documents outside fold 0, one row for each of their ids. Spark counts
their hashed terms; every hash seen in at least ``MIN_DOCS`` of them gets parameters, whatever it tells
by itself, as it may tell something beside another. Only which of these each sampled document has
reaches the driver, where the parameters are fitted. Most terms are noise, so parameters are shrunk to 0 at every step and
only those that the labels keep pulling away stay: less for terms that depend on the label by themselves
(chi-square), and in the factors less for frequent ones, whose pairs are seen often enough to be judged. Scoring is one pass over whole
texts with the parameters broadcast: at most ``2 ** HASH_BITS * (RANK + 1)`` numbers of four bytes.

Defined cases: a null or empty text scores by the bias alone; without labelled rows, or with one label only, all
score that label's share (0 without labels); ids and labels that are null are not learnt from;
repeated rows score alike; of several texts of a sampled id the smallest is learnt from; an empty table gives an empty
result; further columns, whatever their names, are carried along. A very long text is read in blocks; its distinct words are held.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.llm.rows import fold, label_sample, text_views, word_blocks, written

HASH_BITS = 22
STEMS = (4, 5, 6)  # bytes of a word's start that are terms too
SAMPLE = 12_000
MIN_DOCS = 5
RANK = 4
EPOCHS = 20
RATE = 0.1
SHRINK = 0.02  # of a step's size, for a term without an effect of its own
CHI_HALF = 4   # chi-square of an own effect that halves it
SEEN_HALF = 80  # documents that halve it for factors
BATCH = 64
SEED = 7
#: A-Z to a-z, other ASCII than letters and digits to a blank; the bytes of other letters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_hashes(text: memoryview) -> np.ndarray:
    """Distinct hashes of a text's terms, sorted: its words, and their stems marked as such."""
    words: set[bytes] = set()
    for block in word_blocks(text, PLAIN):
        words.update(block)
    terms = words.union(*[{b"^" + w[:n] for w in words if len(w) > n} for n in STEMS])
    return np.unique(np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) >> (32 - HASH_BITS))


def known(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Those of the hashes that are terms."""
    return hashes[terms[np.searchsorted(terms, hashes).clip(max=terms.size - 1)] == hashes] if terms.size else hashes[:0]


@dataclass
class Machine:
    terms: np.ndarray    # sorted hashes with parameters
    bias: float
    weights: np.ndarray  # (terms,)
    factors: np.ndarray  # (terms, RANK)

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """Parameter rows of the hashes that have any."""
        if not self.terms.size:
            return np.empty(0, np.int64)
        at = np.searchsorted(self.terms, hashes).clip(max=self.terms.size - 1)
        return at[self.terms[at] == hashes]

    def logit(self, columns: np.ndarray) -> float:
        v = self.factors[columns]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[columns].sum() + 0.5 * (total @ total - (v * v).sum()))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def frequent_terms(rows: DataFrame, least: int = MIN_DOCS) -> np.ndarray:
    """The hashes in ``least`` or more, but not in all, of ``rows(terms)``, sorted: 2 ** HASH_BITS at most."""
    n = rows.count()
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    return np.sort(counts.filter(F.col("seen").between(least, n - 1)).select("term").toPandas()["term"].to_numpy(np.int64))


def shrinkage(rows: list[np.ndarray], y: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """How much each term's weight and its factors are shrunk."""
    share = y.mean()
    seen = np.bincount(np.concatenate(rows), minlength=n_terms) + 1e-9
    toxic = np.bincount(np.concatenate(rows), np.repeat(y, [r.size for r in rows]), n_terms)
    expected = seen * share
    chi = (toxic - expected) ** 2 / (expected * (1 - share) * np.maximum(1 - seen / y.size, 1e-9))
    weights = SHRINK / (1 + chi / CHI_HALF)
    return weights, weights * np.minimum(1, np.sqrt(SEEN_HALF / 4 / seen))


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by group ``at``."""
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], axis=1)


def fit(docs: list[np.ndarray], y: np.ndarray, terms: np.ndarray) -> Machine:
    """Minimises the logistic loss by AdaGrad in small batches with shrinkage; deterministic for given rows in order.

    ``docs``: the hashes in each document; ``terms``: the sorted hashes that get parameters.
    """
    none = np.empty(0, np.int64), np.empty(0), np.empty((0, RANK))
    if len(docs) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(docs) else 0.0
        return Machine(none[0], float(np.log((share + 1e-9) / (1 - share + 1e-9))), none[1], none[2])
    rng = np.random.default_rng(SEED)
    share = y.mean()
    m = Machine(terms, float(np.log(share / (1 - share))), np.zeros(terms.size, np.float32), rng.normal(0, 0.05, (terms.size, RANK)).astype(np.float32))
    rows = [m.columns(d).astype(np.int32) for d in docs]
    less, less_factors = shrinkage(rows, y, terms.size)
    gb, gw, gv = 1e-8, np.full(terms.size, 1e-8), np.full(terms.size, 1e-8)
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(rows)), -(-len(rows) // BATCH)):
            cols = np.concatenate([rows[i] for i in batch])
            own = np.repeat(np.arange(batch.size), [rows[i].size for i in batch])
            v = m.factors[cols]
            totals = sums(own, v, batch.size)
            linear = np.bincount(own, m.weights[cols], batch.size)
            pairs = 0.5 * ((totals ** 2).sum(axis=1) - np.bincount(own, (v * v).sum(axis=1), batch.size))
            error = sigmoid(m.bias + linear + pairs) - y[batch]
            used, at = np.unique(cols, return_inverse=True)
            dw = np.bincount(at, error[own], used.size) / batch.size
            dv = sums(at, error[own, None] * (totals[own] - v), used.size) / batch.size
            db = error.mean()
            gb, gw[used], gv[used] = gb + db ** 2, gw[used] + dw ** 2, gv[used] + (dv ** 2).mean(axis=1)
            m.bias -= RATE * db / np.sqrt(gb)
            step = RATE / np.sqrt(gw[used])
            w = m.weights[used] - step * dw
            m.weights[used] = np.sign(w) * np.maximum(np.abs(w) - step * less[used], 0)
            step = RATE / np.sqrt(gv[used])
            v = m.factors[used] - step[:, None] * dv
            size = np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12)
            m.factors[used] = v * np.maximum(1 - step * less_factors[used] / size, 0)[:, None]
    return m


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Machine:
    """The machine fitted on a bounded sample of the labelled rows of ``docs(doc_id, text)``."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_hashes(t).astype(np.int32) for t in text_views(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc_id", "label", "terms"])

    ids = F.broadcast(label_sample(labels, label, most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row an id, however often it is repeated
    rows = written(rows.mapInArrow(hashes, "doc_id long, label int, terms array<int>"), "labelled-terms")
    terms = frequent_terms(rows)

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [known(terms, np.asarray(t.values)).astype("<u4").tobytes() for t in batch.column("terms")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(kept, pa.binary())],
                                             names=["doc_id", "label", "terms"])

    got = rows.mapInArrow(usable, "doc_id long, label int, terms binary").toPandas().sort_values("doc_id")
    return fit([np.frombuffer(x, "<u4") for x in got["terms"]], got["label"].to_numpy(np.float64), terms)


def score(source: DataFrame, machine: Machine) -> DataFrame:
    """``at, doc_id, held_out, score`` for each row of ``located(docs)``."""
    shared = source.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            logits = np.array([m.logit(m.columns(term_hashes(t))) for t in text_views(batch.column("text"))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("doc_id"), pa.array(sigmoid(logits))],
                                             names=["at", "doc_id", "score"])

    scored = source.select("at", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text").mapInArrow(
        run, "at struct<file:string,row:bigint>, doc_id long, score double")
    return scored.select("at", "doc_id", (fold() == 0).alias("held_out"), "score")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; one pass, rows stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            logits = np.array([m.logit(m.columns(term_hashes(t))) for t in text_views(batch.column("text"))], np.float64)
            yield batch.filter(pa.array(sigmoid(logits) < threshold))

    return docs.mapInArrow(run, docs.schema)
