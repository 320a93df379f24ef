"""Token totals by source, language and tokenizer, kept up by signed deltas.

A batch of changes holds images of documents before and after: inserts have no image
before, deletes none after, revisions both. Each batch becomes one small table of sums
of signed counts, written in a folder of its own and then named in the commit log. A
batch that the log names is never applied again; one that broke off before is
written anew over its remains. Totals are the sums of all committed deltas; ``compact`` sums them up into a base
and then deletes them, after which the base and the folders of later batches are read, by name. There may be ``MAX_OPEN`` of these; more are
an error until they are compacted.

One writer at a time. Edge cases: null sources, languages and texts are groups and
counts of their own (a null text has no tokens); a null image adds nothing; repeated
rows count repeatedly; an empty batch is committed without deltas; groups whose totals
are all zero are left out; further columns are ignored.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import encode_piece, read_ranks
from lodestar.llm.common import map_rows

#: Pieces whose counts a Python worker keeps (some 200 bytes each); beyond it the memory is dropped and starts anew.
CACHE_PIECES = 1_000_000
#: Only pieces of at most this many characters are kept.
CACHE_CHARS = 64
#: Bits that hold one tokenizer's count in a packed number; no text has that many tokens.
_BITS = 40

#: Batches that may be committed since the last compaction.
MAX_OPEN = 10_000

KEYS = ("source", "lang", "tokenizer")
_LOG = "batch_id string"
_BASE = "version bigint"
_DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint, bytes bigint"


class _Counts(dict):
    """Piece -> its token counts by all rank files, packed in one number; filled on demand, bounded."""

    def __init__(self, paths: tuple[str, ...]):
        super().__init__()
        self.ranks = [read_ranks(path) for path in paths]

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        packed = sum(len(encode_piece(raw, ranks)) << (_BITS * i) for i, ranks in enumerate(self.ranks))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed


@functools.lru_cache(maxsize=4)
def _counter(paths: tuple[str, ...], pattern: str):
    """Counts of a text by each rank file: it is split once, and its packed counts are added."""
    of, split, mask = _Counts(paths).__getitem__, regex.compile(pattern).findall, (1 << _BITS) - 1

    def count(text: str | None) -> list[int]:
        packed = sum(map(of, split(text))) if text else 0
        return [packed >> (_BITS * i) & mask for i in range(len(paths))]

    return count


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], pattern: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_bytes): a row for each document row and tokenizer version.

    ``tokenizers`` maps a version's name to its rank file; all of them split by ``pattern``.
    """
    names, paths = list(tokenizers), tuple(tokenizers.values())

    def run(batch: pa.RecordBatch) -> list:
        count = _counter(paths, pattern)
        texts = batch.column(3).to_pylist()
        counts = [count(t) for t in texts]
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        own = [batch.column(i).to_pylist() * len(names) for i in range(3)]
        return [*own, [name for name in names for _ in texts], [c[i] for i in range(len(names)) for c in counts], sizes * len(names)]

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", *(F.col(c).cast("string") for c in ("source", "lang", "text")))
    return map_rows(own, run, f"doc_id {kind}, source string, lang string, tokenizer string, n_tokens bigint, n_bytes bigint")


_IMAGE = ("source", "lang", "tokenizer", "n_tokens", "n_bytes")


def changes(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows: -1 for each image before, +1 for each after; either may be None."""
    sides = [df.select(*_IMAGE, F.lit(sign).cast("bigint").alias("sign")) for df, sign in ((before, -1), (after, 1)) if df is not None]
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # an empty first file each, so that the folders can be read before any commit
        for part, schema in (("log", _LOG), ("delta/batch_id=@start", _DELTA), ("bases", _BASE)):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{part}")

    def committed(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log").distinct()

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """Apply a batch of signed rows once. False: it had been applied before."""
        if not batch_id or any(c in batch_id for c in "/=%"):
            raise ValueError("a batch id is text without / = %")
        if self.committed().where(F.col("batch_id") == batch_id).take(1):
            return False
        sums = signed.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"), F.sum(F.col("sign") * F.col("n_bytes")).alias("bytes"))
        sums.write.mode("overwrite").parquet(f"{self.path}/delta/batch_id={batch_id}")
        self.spark.createDataFrame([(batch_id,)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return True

    def _base(self) -> str | None:
        """Folder of the base that was committed last."""
        last = self.spark.read.schema(_BASE).parquet(f"{self.path}/bases").agg(F.max("version").alias("v")).first()["v"]
        return None if last is None else f"{self.path}/base/{last}"

    def _compacted(self, base: str | None) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{base}/batches") if base else self.spark.createDataFrame([], _LOG)

    def _open(self, base: str | None) -> list[str]:
        """Ids of the batches that the base hasn't."""
        rows = self.committed().join(self._compacted(base), "batch_id", "left_anti").limit(MAX_OPEN + 1).collect()
        if len(rows) > MAX_OPEN:
            raise ValueError(f"more than {MAX_OPEN} batches since the last compaction")
        return sorted(r[0] for r in rows)

    def _sums(self, base: str | None, ids: list[str]) -> DataFrame:
        """Sums of the base and of the batches named."""
        paths = [f"{base}/sums"] * bool(base) + [f"{self.path}/delta/batch_id={i}" for i in ids]
        rows = self.spark.read.schema(_DELTA).parquet(*(paths or [f"{self.path}/delta/batch_id=@start"]))
        sums = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "bytes")))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0) | (F.col("bytes") != 0))

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _folders(self, part: str) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return [x.getPath().getName() for x in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]

    def compact(self) -> int:
        """Sum up all committed batches into a new base, and give its version. One that breaks off before it is committed isn't seen; what it should have deleted, the next one deletes.

        Results of ``totals`` that haven't been computed by then have to be asked for again.
        """
        base = self._base()
        ids, version = self._open(base), int(base.rpartition("/")[2]) + 1 if base else 1
        path = f"{self.path}/base/{version}"
        self._sums(base, ids).write.mode("overwrite").parquet(f"{path}/sums")
        done = self._compacted(base).unionByName(self.spark.createDataFrame([(i,) for i in ids], _LOG))
        done.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches")
        self.spark.createDataFrame([(version,)], _BASE).coalesce(1).write.mode("append").parquet(f"{self.path}/bases")
        there = self.spark.createDataFrame([(x.partition("=")[2],) for x in self._folders("delta")], _LOG)
        for row in there.join(self._compacted(path), "batch_id", "left_semi").toLocalIterator():
            self._delete(f"{self.path}/delta/batch_id={row[0]}")
        if base:
            self._delete(base)
        return version

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, bytes) after all committed batches."""
        base = self._base()
        return self._sums(base, self._open(base))
