"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text's features are hashed: each word (lower-cased, without outer punctuation), its
punctuation, pairs of words, and pairs and triples of word shapes (case, punctuation,
whether the word before is the same). Values are log counts of unit length, so a score
is one sparse dot product and texts of any length weigh alike.

Training rows are a sample of ``MAX_TRAIN`` labelled rows on average, taken by a hash of
the document's id. Each of ``SHARDS`` groups of the sample trains its own weights in one task, and
their mean is the model, which holds at most ``2 ** BITS`` weights whatever the input.

Edge cases: null or empty texts have only the bias feature and get its score; null or
other labels and null ids are not learned from; repeated rows count repeatedly; without
labels every score is 0.5; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_rows

#: Labelled rows to train on, on average; more rows are sampled by a hash of their id.
MAX_TRAIN = 12_000
SHARDS = 4
EPOCHS = 4
BITS = 18
#: FTRL-proximal: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.02, 0.2
_MASK = (1 << BITS) - 1
_CACHE = 500_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class _Words(dict):
    """Word -> 64 bits: a hash of its letters (upper 40 bits) and its shape (lower 24 bits)."""

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGES)
        tail = word[len(word.rstrip(_EDGES)) :] if core else word
        case = 0 if not core else 1 if core.islower() else 2 if core.istitle() else 3 if core.isupper() else 4 if core.isdigit() else 5
        shape = (crc32(tail.encode("utf-8", "surrogatepass")) & 0x1FFFFF) << 3 | case
        value = (crc32(core.lower().encode("utf-8", "surrogatepass")) << 24 | shape) & 0x7FFFFFFFFFFFFFFF
        if len(word) <= 40:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64(_MASK)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their values, of unit length; number 0 is the bias."""
    words = text.split() if text else []
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    packed = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    core, shape = packed >> np.uint64(24), packed & np.uint64(0xFFFFFF)
    same = np.zeros(len(words), np.uint64)
    same[1:] = core[1:] == core[:-1]
    shape = shape * np.uint64(2) + same
    parts = [_mix(core, 1), _mix(shape, 2)]
    if len(words) > 1:
        parts += [_mix(core[:-1] * np.uint64(0x10000001B3) + core[1:], 3), _mix(shape[:-1] * np.uint64(0x100000001B3) + shape[1:], 4)]
    if len(words) > 2:
        parts.append(_mix((shape[:-2] * np.uint64(0x100000001B3) + shape[1:-1]) * np.uint64(0x100000001B3) + shape[2:], 5))
    at, n = np.unique(np.concatenate(parts), return_counts=True)
    values = np.log1p(n)
    values /= np.sqrt(values @ values)
    return np.append(at.astype(np.int64), 0), np.append(values, 0.3)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights by follow-the-regularised-leader updates, row by row in the given order."""
    z, n = np.zeros(_MASK + 1), np.zeros(_MASK + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        w = (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels, strict=True):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w  # a number occurs once in ``at``, but for the bias by collision
            n[at] = more
    return weights(slice(None))


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights learned from the labelled rows that are not held out."""
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    there = own.count()
    if not there:
        return np.zeros(_MASK + 1)
    # the sample has ``max_train`` rows on average: some 200 kB, whatever the number of labels
    order = F.xxhash64(F.lit("quality-sample"), F.col("doc_id"))
    share = min(1.0, max_train / there)
    sample = own.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("place", order)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").withColumn("shard", F.pmod(F.col("place"), F.lit(SHARDS)).cast("int"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("place", "ascending"), ("text", "ascending"), ("y", "ascending")])
        w = ftrl([features(t) for t in table.column("text").to_pylist()], table.column("y").to_pylist())
        at = np.flatnonzero(w)
        return pa.table({"at": at, "w": w[at]})

    parts = rows.groupBy("shard").applyInArrow(fit, "at long, w double")
    model = np.zeros(_MASK + 1)
    for r in parts.groupBy("at").agg((F.sum("w") / SHARDS).alias("w")).collect():  # at most 2 ** BITS rows
        model[r["at"]] = r["w"]
    return model


def _scorer(docs: DataFrame, model: np.ndarray):
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # 2 ** BITS x 4 bytes

    def score(text: str | None) -> float:
        at, x = features(text)
        return float(1 / (1 + np.exp(-np.clip(shared.value[at] @ x, -35, 35))))

    return score


def scores(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    score = _scorer(docs, model)

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), batch.column(1), (s := [score(t) for t in batch.column(2).to_pylist()]), [int(x >= 0.5) for x in s]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", held_out(F.col("doc_id")), F.col("text").cast("string")), run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: np.ndarray, least: float = 0.5) -> DataFrame:
    """The documents with a score of ``least`` or more, all columns kept."""
    score, at = _scorer(docs, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(t) >= least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
