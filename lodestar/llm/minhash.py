"""Near-duplicate documents by weighted MinHash signatures of hashed darts.

A shingle (five words) weighs as often as it stands in the document, and is a region of the plane as wide as its
weight. Darts fall into it at hashed ranks: a Poisson process that depends on the shingle alone, cut into
strips of weight, so that the same shingle gets the same darts in every document. Each
dart has a coordinate, and a document keeps its earliest dart of each: two documents
agree in a coordinate with the probability of their weighted Jaccard similarity (the sum of the lesser
weights over that of the greater ones). A document throws darts only up to the rank that fills all coordinates as a rule, some
``K log K`` in all, whatever its length; where one stays empty the rank is doubled.

Documents of equal words are one class from the start. The others meet in bands; a pair
with similarity 0.8 misses all 24 bands with probability 3e-6. In each bucket every document is verified, on exact
weighted sets, against the bucket's hub. Hubs are the documents of least hash, whatever the bucket, so that a cluster has
the same few in all its bands and a document a few pairs. Links give classes. Only buckets that
hold several classes go on: their documents outside the commonest class meet those of other classes. Small
buckets give these pairs at once. In larger ones blocks meet in groups of bounded size, signatures are compared, and what agrees
enough is verified in place; a pair of similarity 0.8 falls short of LEAST_AGREEMENT with probability 1e-7, a
thirtieth of what the bands miss. The documents outside the commonest class of a large bucket take time with the square of their number.

Edge cases: null and empty texts, and texts without words, are classes of their own;
a text of fewer than five words is one shingle; null ids keep a null class and are kept;
rows that share an id share a class, which all their texts belong to; an empty table gives an empty table;
further columns are ignored or, by ``keep_one``, kept, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import components, fresh_name, map_rows, materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
K = BANDS * ROWS
#: Buckets of up to so many documents give their pairs of different classes at once.
SMALL_BUCKET = 6
#: Documents in a block of a larger bucket; a group holds two blocks.
BLOCK = 512
#: Coordinates that have to agree, of K, before a pair of a larger bucket is verified.
LEAST_AGREEMENT = 55
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_CACHE = 500_000
_U = np.uint64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = value
        return value


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of runs of ``size`` words, or of all words if there are fewer, and how often each stands."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(ids))
    n = len(ids) - size + 1
    h = ids[:n].copy()
    for k in range(1, size):
        h = mix(h) + ids[k : k + n]
    found, often = np.unique(mix(h), return_counts=True)
    return found, often.astype(np.int32)


def signatures(sets: list[np.ndarray], weights: list[np.ndarray], k: int = K) -> np.ndarray:
    """A row of ``k`` dart numbers for each non-empty set; ``weights`` are positive."""
    out = np.zeros((len(sets), k), np.uint64)
    todo = np.arange(len(sets))
    totals = np.array([w.sum() for w in weights], float)
    limit = (math.log(k) + 4) / np.maximum(totals, 1e-300)
    while len(todo):
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
        weight = np.concatenate([weights[i] for i in todo]).astype(float)
        best, dart = _throw(element, weight, owner, limit[todo], len(todo), k)
        full = (best < np.inf).all(axis=1)
        out[todo[full]] = dart[full]
        todo = todo[~full]
        limit[todo] *= 2
    return out


def _strips(most: float) -> Iterator[tuple[float, float, int]]:
    """Lower end, width and number of the weight strips up to ``most``: 0 to 1, then each as wide as all before it."""
    yield 0.0, 1.0, 0
    edge, number = 1.0, 1
    while edge < most:
        yield edge, edge, number
        edge, number = edge * 2, number + 1


def _throw(element, weight, owner, limit, n, k):
    best, dart = np.full((n, k), np.inf), np.zeros((n, k), np.uint64)
    ranks, owners, darts = [], [], []
    for low, width, number in _strips(weight.max() if weight.size else 0.0):
        own = np.flatnonzero(weight > low)
        e, o, w = element[own], owner[own], weight[own]
        rank, turn = np.zeros(len(e)), 0
        salt = mix(np.array([number], np.uint64))
        while len(e):
            h = mix(e ^ (salt + _U((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)))
            rank = rank - np.log1p(-((h >> _U(11)) * 2.0**-53)) / (k * width)  # exponential gaps
            near = rank <= limit[o]
            e, o, w, rank, h = e[near], o[near], w[near], rank[near], h[near]
            d = mix(h + _U(0x632BE59BD9B4E019))
            under = low + width * ((mix(d) >> _U(11)) * 2.0**-53) < w
            ranks.append(rank[under])
            owners.append(o[under])
            darts.append(d[under])
            turn += 1
    if ranks:
        rank, o, d = np.concatenate(ranks), np.concatenate(owners), np.concatenate(darts)
        late_first = np.argsort(-rank, kind="stable")
        rank, o, d = rank[late_first], o[late_first], d[late_first]
        at = (d % _U(k)).astype(np.int64)
        best[o, at] = rank  # of several, the last and so the earliest dart stays
        dart[o, at] = d
    return best, dart


def _band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.repeat(mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :], len(sig), axis=0)
    for r in range(ROWS):
        h = mix(h ^ sig[:, r::ROWS]) + _U(r)
    return h.view(np.int64)


def _sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, n, bands, sig): fingerprint of the words, sum of the weights, band keys, 16 bits of each coordinate."""

    def run(batch: pa.RecordBatch) -> list:
        fps, sets = [], []
        for t in batch.column(1).to_pylist():
            words = words_of(t)
            fps.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
            sets.append(shingles(words))
        full = [i for i, (s, _) in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        sigs: list = [None] * len(sets)
        if full:
            sig = signatures([sets[i][0] for i in full], [sets[i][1] for i in full])
            keys, short = _band_keys(sig), (sig >> _U(48)).astype(np.uint16)
            for j, i in enumerate(full):
                bands[i], sigs[i] = keys[j], short[j].tobytes()
        return [batch.column(0), fps, [int(w.sum()) for _, w in sets], bands, sigs]

    return map_rows(docs, run, "doc_id bigint, fp binary, n bigint, bands array<bigint>, sig binary")


def _weights(blob: bytes, count: int) -> np.ndarray:
    """An empty blob stands for weights of 1."""
    return np.frombuffer(blob, np.int32) if blob else np.ones(count, np.int32)


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, shingles, weights): the weighted set of each document row."""

    def run(batch: pa.RecordBatch) -> list:
        sets = [shingles(words_of(t)) for t in batch.column(1).to_pylist()]
        return [batch.column(0), [int(w.sum()) for _, w in sets], [s.tobytes() for s, _ in sets], [b"" if (w == 1).all() else w.tobytes() for _, w in sets]]

    return map_rows(docs, run, "doc_id bigint, n bigint, shingles binary, weights binary")


def _alike(x: np.ndarray, wx: np.ndarray, others: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Which of the weighted sets are similar enough to ``x``."""
    sizes = np.array([len(y) for y in others])
    flat, w = np.concatenate(others), np.concatenate(weights)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    begins = np.cumsum(sizes) - sizes
    both = np.add.reduceat(np.where(x[at] == flat, np.minimum(wx[at], w), 0).astype(np.int64), begins)
    return both >= THRESHOLD * (int(wx.sum()) + np.add.reduceat(w.astype(np.int64), begins) - both) - 1e-9


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with a similarity of THRESHOLD or more, by exact sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "wa", "sb", "wb")

    def run(batch: pa.RecordBatch) -> list:
        a_out, b_out, last, x, wx = [], [], None, None, None
        for a, b, sa, wa, sb, wb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(batch.column(i) for i in range(2, 6)), strict=True):
            own = (sa.as_buffer(), wa.as_buffer())
            if last is None or not all(map(pa.Buffer.equals, own, last)):  # an id may have several texts
                last, x = own, np.frombuffer(own[0], np.uint64)
                wx = _weights(wa.as_py(), len(x))
            y = np.frombuffer(sb.as_buffer(), np.uint64)
            if len(x) and len(y) and _alike(x, wx, [y], [_weights(wb.as_py(), len(y))])[0]:
                a_out.append(a)
                b_out.append(b)
        return [a_out, b_out]

    return map_rows(rows, run, "a bigint, b bigint")


def _may_be_alike(n: Column, m: Column) -> Column:
    return F.least(n, m) >= THRESHOLD * F.greatest(n, m) - 1e-9


def _block_links(members: DataFrame) -> DataFrame:
    """Links (a, b) that join different classes of large buckets, by exact sets.

    ``members``: bucket, usual (whether of the commonest class), n_usual, n_other, doc_id, c, n, sig, shingles, weights. The two kinds of a bucket's documents
    are dealt into blocks by a hash; each block of the usual ones meets each of the others, and these meet each other. Pairs whose signatures
    agree enough are verified there, and of the links a group gives a spanning forest.
    """
    many = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    rows = members.withColumns({"blocks": many("n_usual"), "others": many("n_other")})
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("usual"), F.col("blocks")).otherwise(F.col("others"))).cast("int"))
    cell = lambda i, j, mixed: F.struct(i.alias("i"), j.alias("j"), F.lit(mixed).alias("mixed"))
    to = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    own = F.col("block")
    cells = F.when(F.col("usual"), to("others", lambda k: cell(own, k, True))).otherwise(F.concat(to("blocks", lambda k: cell(k, own, True)), to("others", lambda k: cell(F.least(own, k), F.greatest(own, k), False))))
    rows = rows.withColumn("cell", F.explode(cells)).select("bucket", "cell.*", "usual", "block", "doc_id", "c", "n", "sig", "shingles", "weights")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("n", "ascending"), ("doc_id", "ascending")])
        ids, c, n, block, usual = (table.column(x).to_numpy().copy() for x in ("doc_id", "c", "n", "block", "usual"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), K)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        weights = [_weights(w, len(s)) for w, s in zip(table.column("weights").to_pylist(), sets, strict=True)]
        mixed, same = table.column("mixed")[0].as_py(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        links = []
        for x in range(len(ids) - 1):
            end = np.searchsorted(n, n[x] / THRESHOLD + 1e-9, "right")
            to = np.arange(x + 1, end)
            meet = usual[to] != usual[x] if mixed else same | (block[to] != block[x])
            to = to[(c[to] != c[x]) & meet]
            if len(to):
                to = to[(sig[to] == sig[x]).sum(axis=1) >= LEAST_AGREEMENT]
            for y in to[_alike(sets[x], weights[x], [sets[y] for y in to], [weights[y] for y in to])] if len(to) else ():
                if c[y] != c[x]:
                    links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                    c[c == c[y]] = c[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("bucket", "i", "j", "mixed").applyInArrow(run, "a bigint, b bigint").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): the least id of each document's class, for every row with an id.

    What is joined on a key that many rows may share is written before, so that both sides are plain exchanges, whose large partitions Spark can split.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sketch = materialise(_sketch(own), "dart-sketch")
    # documents of equal words: the least id stands for all
    equal = materialise(sketch.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("fp", "rep"), "dart-equal")
    named = sketch.join(equal, "fp", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rep_of, reps = named.select("doc_id", "rep"), named.where("fp is not null and doc_id = rep")
    # an id with several texts ties their classes together
    several = rep_of.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    ties = rep_of.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    members = reps.select("doc_id", "n", F.posexplode("bands").alias("band", "key")).select("doc_id", "n", F.xxhash64("band", "key").alias("bucket"))
    hub = F.min(F.struct(F.xxhash64(F.lit("hub"), "doc_id").alias("h"), "doc_id", "n"))
    buckets = materialise(members.groupBy("bucket").agg(F.count("*").alias("size"), hub.alias("hub")).where("size > 1").select("bucket", "size", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n")), "dart-hubs")
    met = materialise(members.join(buckets, "bucket"), "dart-buckets")  # without the buckets of one document
    star = met.where((F.col("doc_id") != F.col("hub")) & _may_be_alike(F.col("n"), F.col("hub_n"))).select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    sets = materialise(_sets(own.join(met.select("doc_id").distinct(), "doc_id", "left_semi")), "dart-sets")
    links = materialise(_verify(star, sets).union(ties), "dart-links")

    # buckets of several classes
    labels = components(links, "dart-labels").select(F.col("v").alias("doc_id"), "c")
    classed = materialise(met.select("bucket", "size", "doc_id", "n").join(labels, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "dart-classed")
    shares = classed.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    shares = shares.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("all"), F.count("*").alias("classes")).where("classes > 1")
    shares = materialise(shares.select("bucket", F.col("most.c").alias("usual_c"), F.col("most.k").alias("n_usual"), (F.col("all") - F.col("most.k")).alias("n_other")), "dart-mixed")
    mixed = classed.join(shares, "bucket").withColumn("usual", F.col("c") == F.col("usual_c"))
    small, large = mixed.where(F.col("size") <= SMALL_BUCKET), mixed.where(F.col("size") > SMALL_BUCKET)
    other = small.select("bucket", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"))
    pairs = small.join(other, "bucket").where((F.col("doc_id") < F.col("b")) & (F.col("c") != F.col("d")) & _may_be_alike(F.col("n"), F.col("m"))).select(F.col("doc_id").alias("a"), "b").distinct()
    large = large.drop("n").join(reps.select("doc_id", "sig"), "doc_id").join(sets, "doc_id")
    more = materialise(_verify(pairs, sets).union(_block_links(large)), "dart-more")
    labels = components(links.union(more), "dart-final")
    return rep_of.join(labels.select(F.col("v").alias("rep"), "c"), "rep", "left").select("doc_id", F.coalesce("c", "rep").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that have the least id of their class, all columns kept; so are rows without an id."""
    gone = fresh_name("of_gone", docs)
    stays = classes(docs).groupBy("doc_id").agg(F.min("class_id").alias("class_id")).where("doc_id <> class_id").select(F.col("doc_id").alias(gone))
    return docs.join(stays, docs["doc_id"].cast("bigint") == F.col(gone), "left_anti")
