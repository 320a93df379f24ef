"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes are learned on a bounded sample: principal axes, turned by rotations that are
fitted so that signs lose least (iterative quantisation), several of them side by side.
Every vector is indexed by its code, cut into substrings with an inverted list each. A
code within Hamming radius R of a query has, by pigeonhole, a substring within about R divided by
their number, so probing those lists finds all codes within R; what they hold is
filtered by the whole code and ranked by the cosine of the original vectors. R is the
one that holds ``COVER`` of the sample's own nearest neighbours.

Vectors and queries are dealt into blocks of bounded size; each block of vectors meets each
block of queries once and gives its nearest few, so rows that leave are a few per query and block.

Edge cases: vectors that are null, zero, of another dimension than most of the sample,
or with null or non-finite components take no part; nor do null ids; a query's own id
is no candidate; ids that occur several times are one query, by its first vector, and
several candidates; where fewer than the wanted number are within the radius, it grows
until enough or all are found; equal scores go to the smaller id; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import materialise

#: Vectors to learn from, on average, and those of them whose neighbours calibrate the radius.
MAX_TRAIN = 4096
CALIBRATE = 512
ROTATIONS = 2
ITERATIONS = 25
COVER = 0.985
#: Vectors and queries that meet in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 16_384
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two next to their largest component, which is exact; neither squares nor sums overflow or vanish then."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Codes:
    """Centre and rotated axes; a vector's code is the signs along them, eight to a byte."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        x = unit(sample)
        self.centre = x.mean(axis=0)
        _, axes = np.linalg.eigh(np.cov((x - self.centre).T) if len(x) > 1 else np.eye(x.shape[1]))
        flat = (x - self.centre) @ axes
        rng, turned = np.random.default_rng(seed), []
        for _ in range(ROTATIONS):
            turn, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
            for _ in range(ITERATIONS):
                signs = np.where(flat @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(flat.T @ signs)
                turn = u @ v
            turned.append(axes @ turn)
        self.axes = np.concatenate(turned, axis=1)
        self.radius = self._calibrate(x, k)

    def of(self, x: np.ndarray) -> np.ndarray:
        x = unit(x)
        return np.packbits((x - self.centre) @ self.axes >= 0, axis=1)

    def _calibrate(self, x: np.ndarray, k: int) -> int:
        codes, n = self.of(x), min(len(x), CALIBRATE)
        if len(x) < 2:
            return codes.shape[1] * 8
        near = x[:n] @ x.T
        near[np.arange(n), np.arange(n)] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        apart = _POP[codes[:n, None, :] ^ codes[best]].sum(axis=2)
        return int(np.quantile(apart, COVER, method="higher"))


class MultiIndex:
    """Inverted lists of the bytes of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.lists = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            self.lists.append((order, np.searchsorted(codes[order, s], np.arange(257))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within ``radius`` of ``code``."""
        m = len(code)
        each, more = divmod(radius, m)  # the first ``more`` + 1 substrings are probed to ``each``, the others to one less
        seen = np.zeros(len(self.codes), bool)
        for s, (order, cuts) in enumerate(self.lists):
            reach = each if s <= more else each - 1
            for b in np.flatnonzero(_POP[np.arange(256) ^ code[s]] <= reach) if reach >= 0 else ():
                seen[order[cuts[b] : cuts[b + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[_POP[self.codes[rows] ^ code].sum(axis=1) <= radius]


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id bigint, v array<double>) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialise(valid(vectors, key, vector), "ann-valid")
    there = rows.count()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not there:
        return empty
    # MAX_TRAIN vectors on average, by a hash of the id: some 2 MB whatever the table's size
    share = int(min(1.0, MAX_TRAIN / there) * (1 << 30))
    sample = [r["v"] for r in rows.where(F.pmod(F.xxhash64(F.lit("ann"), "vec_id"), F.lit(1 << 30)) < share).orderBy("vec_id", "v").collect()] or [rows.first()["v"]]
    sizes = sorted((len(v) for v in sample), key=lambda n: -sum(len(v) == n for v in sample))
    dim = sizes[0]
    codes = Codes(np.array([v for v in sample if len(v) == dim]), k)
    shared = spark.sparkContext.broadcast(codes)  # two matrices of dim x dim

    rows = rows.where(F.size("v") == dim)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = max(1, -(-there // BLOCK_VECTORS))
    turns = max(1, -(-rows.where(F.pmod("vec_id", F.lit(every)) == 0).count() // BLOCK_QUERIES))
    blocks = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "vec_id", "v")
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(turns)).cast("int").alias("turn"), "vec_id", "v")

    def search(block: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if block.num_rows and wanted.num_rows:
            ids, x = block.column("vec_id").to_numpy(), scaled(_matrix(block, dim))
            index, norms = MultiIndex(shared.value.of(x)), np.sqrt((x * x).sum(axis=1))
            q_ids, q = wanted.column("vec_id").to_numpy(), scaled(_matrix(wanted, dim))
            q_norms, most = np.sqrt((q * q).sum(axis=1)), shared.value.axes.shape[1]
            for i, code in enumerate(shared.value.of(q)):
                radius = shared.value.radius
                while True:
                    found = index.within(code, radius)
                    found = found[ids[found] != q_ids[i]]
                    if len(found) >= k or radius >= most:
                        break
                    radius = min(most, radius + max(1, radius // 4))
                score = (x[found] * q[i]).sum(axis=1) / (norms[found] * q_norms[i])
                best = np.lexsort((ids[found], -score))[:k]
                out[0].append(np.full(len(best), q_ids[i]))
                out[1].append(ids[found][best])
                out[2].append(score[best])
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        return pa.table({"query_id": flat(out[0], np.int64), "vec_id": flat(out[1], np.int64), "score": flat(out[2], np.float64)})

    near = blocks.groupBy("part", "turn").cogroup(queries.groupBy("part", "turn")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each block
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("v").chunks]).reshape(-1, dim)
