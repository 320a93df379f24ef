"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that Python receives; long documents make wide rows.
BATCH_ROWS = 1024


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that this process has handed out; ``clear_scratch`` deletes them.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share.

    The folder is ``spark.checkpoint.dir`` of the session, which is only read. Where that is unset, as in
    local tests, it is a temporary folder of this machine; with any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/lodestar-scratch"
    _scratch.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete what ``scratch_path`` has handed out so far; results that are still to be read from there must be written before."""
    jvm, done = spark.sparkContext._jvm, len(_scratch)
    for path in _scratch:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _scratch.clear()
    return done


#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    What was shuffled for it isn't needed after that and is removed at once, not when the driver happens to collect garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of the frames is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, c): the least vertex c of the component of each vertex of ``edges`` (a, b); vertices are of any type that has an order.

    Each round a vertex takes the least label around it and then that label's own
    label, so that paths halve; it ends when nothing changes. Both joins of a round read written
    tables, so that Spark can split the rows of a vertex with many edges or of a label with many vertices.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c")), name)
    while True:
        around = both.join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("a").alias("v")).agg(F.min("cb").alias("m"))
        near = labels.join(around, "v", "left").select("v", F.col("c").alias("was"), F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        fresh = materialise(near.join(jump, "c", "left").select("v", "was", F.least("c", F.coalesce("cc", "c")).alias("c")), name)
        changed = fresh.where("c <> was").limit(1).count()
        labels = fresh.select("v", "c")
        if not changed:
            return labels


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns the output columns as lists or arrays.

    A batch is cut to ``BATCH_ROWS`` rows, which bounds the memory of one call.
    """
    types = arrow_types(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                cols = fn(batch.slice(at, BATCH_ROWS))
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, types, strict=True)], schema=types)

    return df.mapInArrow(run, schema)


def arrow_types(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
