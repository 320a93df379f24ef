"""A Merkle manifest of a dataset: one digest for each row, source and the whole, and the siblings that prove a row.

Rows of a group (a source) ascend by key; every ``FANOUT`` consecutive digests become the digest of
their joined text, the last run of a level having fewer, until one is left. Nothing is padded. The groups' last digests,
in order of the groups, are the leaves of a tree of the same kind, whose last digest is the root.

Digests are dealt into ranges of (group, key), so a part holds runs of consecutive leaves of some groups; counts of
the runs give each its first index. A part climbs its runs with a mountain-range stack: a leaf is pushed, and whenever the top
of the stack completes a run of siblings, these are popped and their parent is pushed, as digits are carried in base ``FANOUT``.
The end of a level completes a run early. What stays on the stack are completed peaks, at most a few for each level: runs that
begin in an earlier part or end in a later one. The peaks of ``MERGED`` neighbouring parts are pushed on one stack in turn, which completes
the unaligned edges, and so on until each group has one peak. Proofs go the other way: a part asks for the siblings that it lacks,
a few for each level, finds them among peaks and merged nodes, and computes the rest anew.

No group is in one task: a part has about ``PART_LEAVES`` rows, a merge ``MERGED`` times some peaks.

Edge cases: a null column is ``-``, not an empty text; null sources are a group, the first; null keys come
first in their group and are never tampered with; rows that share a key are ordered by their digests, and rows that are equal have equal digests but places,
and so proofs, of their own; an empty table has no rows and no root; further columns, whatever they are called, are ignored; texts of any length are
hashed as they are.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_types, materialise

FANOUT = 3
#: Leaves of one part, about; and parts whose peaks are merged in one task.
PART_LEAVES, MERGED = 100_000, 64
#: What a leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "part bigint, grp string, total bigint, level int, idx bigint, digest string, open boolean"
_STEPS = "array<struct<left:string,right:string>>"


def joined_digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def level_sizes(total: int) -> list[int]:
    """Nodes of each level, from the leaves to the last."""
    sizes = [total]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FANOUT))
    return sizes


class Mountains:
    """A stack of completed subtrees of consecutive leaves, from left to right."""

    def __init__(self, total: int):
        self.sizes, self.peaks = level_sizes(total), []

    def push(self, level: int, idx: int, digest: str) -> Iterator[tuple[int, int, str]]:
        """Add a node to the right; give the nodes that it completes."""
        self.peaks.append((level, idx, digest))
        while level + 1 < len(self.sizes) and (idx % FANOUT == FANOUT - 1 or idx == self.sizes[level] - 1):
            run = self.peaks[-(idx % FANOUT + 1) :]
            if [x[:2] for x in run] != [(level, i) for i in range(idx - idx % FANOUT, idx + 1)]:
                return  # it began in an earlier part
            del self.peaks[-len(run) :]
            level, idx, digest = level + 1, idx // FANOUT, joined_digest([x[2] for x in run])
            self.peaks.append((level, idx, digest))
            yield self.peaks[-1]


def missing_siblings(start: int, end: int, total: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the nodes that have no leaf of start to end, but a parent that has."""
    low, high = start, end - 1
    for level, size in enumerate(level_sizes(total)[:-1]):
        parents = low // FANOUT, high // FANOUT
        yield from ((level, i) for i in range(parents[0] * FANOUT, low))
        yield from ((level, i) for i in range(high + 1, min((parents[1] + 1) * FANOUT, size)))
        low, high = parents


class Branches:
    """Siblings on the way from the leaves of one run to the last digest of their group."""

    def __init__(self, start: int, digests: list[str], total: int, lacking: list[tuple[int, int, str]]):
        self.sizes = level_sizes(total)
        self.nodes: list[dict[int, str]] = [{} for _ in self.sizes]
        for level, idx, digest in lacking:
            self.nodes[level][idx] = digest
        self.nodes[0].update(enumerate(digests, start))
        low, high = start, start + len(digests) - 1
        for level in range(len(self.sizes) - 1):
            low, high = low // FANOUT, high // FANOUT
            for p in range(low, high + 1):
                self.nodes[level + 1][p] = joined_digest(self._children(level, p))
        self._kept: list[tuple[int, list]] = [(-1, [])] * len(self.sizes)

    def _children(self, level: int, parent: int) -> list[str]:
        return [self.nodes[level][i] for i in range(parent * FANOUT, min((parent + 1) * FANOUT, self.sizes[level]))]

    def steps(self, idx: int, level: int = 0) -> list[tuple[str, str]]:
        """(left, right) siblings, joined, of a node and of its ancestors; those of the last ancestor asked for are kept."""
        if self._kept[level][0] != idx:
            out = []
            if level + 1 < len(self.sizes):
                run, at = self._children(level, idx // FANOUT), idx % FANOUT
                out = [("".join(run[:at]), "".join(run[at + 1 :])), *self.steps(idx // FANOUT, level + 1)]
            self._kept[level] = (idx, out)
        return self._kept[level][1]


def folded(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        leaf = joined_digest([left, leaf, right])
    return leaf


@dataclasses.dataclass
class Forest:
    """Trees over groups of leaves. ``leaves`` (part, grp, key, leaf, ...), ``runs`` (part, grp, start, n, total), ``nodes`` (grp, level, idx, digest) that no part has alone, ``tops`` (grp, top)."""

    leaves: DataFrame
    runs: DataFrame
    nodes: DataFrame
    tops: DataFrame


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("key", "ascending"), ("leaf", "ascending")], null_placement="at_start"))


def _climb(leaves: pa.Table, run: pa.Table) -> pa.Table:
    if not leaves.num_rows:
        return _nodes([])
    part, grp, start, _, total = (c[0].as_py() for c in run.select(["part", "grp", "start", "n", "total"]).columns)
    stack = Mountains(total)
    for i, digest in enumerate(_sorted(leaves).column("leaf").to_pylist(), start):
        for _ in stack.push(0, i, digest):
            pass
    return _nodes([(part, grp, total, *x, True) for x in stack.peaks])


def _merge(peaks: pa.Table) -> pa.Table:
    """Nodes that the peaks of neighbouring parts complete, and the peaks that are left."""
    rows = sorted(zip(*(c.to_pylist() for c in peaks.select(["idx", "level", "digest", "part", "grp", "total"]).columns), strict=True), key=lambda r: r[0] * FANOUT ** r[1])
    part, grp, total = rows[0][3] // MERGED, *rows[0][4:]
    stack, made = Mountains(total), []
    for idx, level, digest, *_ in rows:
        made += [(part, grp, total, *x, False) for x in stack.push(level, idx, digest)]
    return _nodes(made + [(part, grp, total, *x, True) for x in stack.peaks])


def _nodes(rows: list[tuple]) -> pa.Table:
    return _table(rows, pa.schema([("part", pa.int64()), ("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("open", pa.bool_())]))


def forest(leaves: DataFrame, name: str = "merkle") -> Forest:
    """The trees over ``leaves``: grp (text, not null), key (ascending, nulls first), leaf (a digest in hex), and what else goes along."""
    spark = leaves.sparkSession
    rows = materialise(leaves, f"{name}-leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_LEAVES))
    # equal rows may fill a third of a table, so ranges split them by their places in the written table
    dealt = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, "grp", "key", "leaf", "nth").drop("nth")
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id().cast("bigint")), f"{name}-parts")
    counts = dealt.groupBy("part", "grp").agg(F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    runs = counts.select("part", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n", F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    runs = materialise(runs, f"{name}-runs")

    peaks = materialise(dealt.groupBy("part", "grp").cogroup(runs.groupBy("part", "grp")).applyInArrow(_climb, _NODE), f"{name}-peaks")
    nodes, last = peaks, runs.agg(F.max("part").alias("m")).first()["m"] or 0
    while last:
        peaks = materialise(peaks.where("open").groupBy("grp", F.floor(F.col("part") / MERGED).alias("block")).applyInArrow(_merge, _NODE), f"{name}-merged")
        nodes, last = nodes.unionByName(peaks.where(~F.col("open"))), last // MERGED
    return Forest(dealt, runs, nodes.select("grp", "level", "idx", "digest"), peaks.where("open").select("grp", F.col("digest").alias("top")))


def _with_lacking(trees: Forest, ups: DataFrame | None) -> DataFrame:
    """Each run with the siblings that its part lacks, and what ``ups`` has of its group."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(part, grp, *x) for part, grp, start, n, total in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True) for x in missing_siblings(start, start + n, total)]
            yield from _table(rows, types).to_batches()

    types = arrow_types(trees.runs.sparkSession, schema := "part bigint, grp string, level int, idx bigint")
    asked = trees.runs.select("part", "grp", "start", "n", "total").mapInArrow(ask, schema)
    found = asked.join(trees.nodes, ["grp", "level", "idx"]).groupBy("part", "grp").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("lacking"))  # a few for each level
    runs = trees.runs.join(found, ["part", "grp"], "left")
    return runs.join(ups, "grp") if ups is not None else runs


def proven(trees: Forest, finish: Callable[[Branches, int, list, dict, list], list], schema: str, ups: DataFrame | None = None) -> DataFrame:
    """Rows that ``finish(branches, start, steps above, run, rows)`` makes of each run; ``ups`` (grp, up, ...) has a row for each group."""
    types = arrow_types(trees.leaves.sparkSession, schema)

    def run(leaves: pa.Table, with_run: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return _table([], types)
        own, rows = with_run.to_pylist()[0], _sorted(leaves).to_pylist()
        branches = Branches(own["start"], [r["leaf"] for r in rows], own["total"], [(x["level"], x["idx"], x["digest"]) for x in own["lacking"] or ()])
        above = [(x["left"], x["right"]) for x in own.get("up") or ()]
        return _table(finish(branches, own["start"], above, own, rows), types)

    return trees.leaves.groupBy("part", "grp").cogroup(_with_lacking(trees, ups).groupBy("part", "grp")).applyInArrow(run, schema)


def _proof_rows(branches: Branches, start: int, above: list, own: dict, rows: list) -> list:
    dicts = lambda steps: [{"left": a, "right": b} for a, b in steps]
    return [(r["grp"], r["key"], r["leaf"], dicts(branches.steps(i) + above)) for i, r in enumerate(rows, start)]


def field(c: Column) -> Column:
    """A value as its byte count, a colon and its text; null as a dash."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def group_name(source: Column) -> Column:
    """Sources as text that sorts as they do, the null one first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(grp, key, leaf, tampered) of each row. ``tampered`` covers a text without its line breaks where 2 divides the crc32 of the id, else equals the leaf."""
    own = [F.col(c) for c in COLUMNS]
    key = F.col("doc_id").cast("bigint")
    chosen = F.crc32(key.cast("string").cast("binary")) % 2 == 0
    changed = row_digest(*own[:-1], F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit("")))
    rows = docs.select(group_name(F.col("source")).alias("grp"), key.alias("key"), row_digest(*own).alias("leaf"), F.when(chosen & F.col("text").contains("\n"), changed).alias("changed"))
    return rows.select("grp", "key", "leaf", F.coalesce("changed", "leaf").alias("tampered"))


@dataclasses.dataclass
class Manifest:
    """Trees of the sources, and the tree over their last digests. ``subroots``: (grp, subroot, root, up), up being the siblings on the way to the root."""

    sources: Forest
    top: Forest
    subroots: DataFrame


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of rows (grp, key, leaf, ...)."""
    sources = forest(leaves)
    tops = sources.tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("top").alias("leaf"))
    top = forest(tops, "merkle-top")
    ups = proven(top, _proof_rows, f"grp string, key string, leaf string, steps {_STEPS}")
    # the tree of subroots has one group, and so one root
    subroots = ups.join(top.tops.withColumnRenamed("top", "root"), "grp").select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), "root", F.col("steps").alias("up"))
    return Manifest(sources, top, materialise(subroots, "merkle-subroots"))


def proofs(of: Manifest) -> DataFrame:
    """(grp, key, leaf, steps): the siblings of each row, level by level through its subroot to the root."""
    kind = of.sources.leaves.schema["key"].dataType.simpleString()
    return proven(of.sources, _proof_rows, f"grp string, key {kind}, leaf string, steps {_STEPS}", of.subroots)


def _audit_rows(branches: Branches, start: int, above: list, own: dict, rows: list) -> list:
    out, end = [], "".join(a + b for a, b in above)
    kept, rest, steps = -1, "", []
    for i, r in enumerate(rows, start):
        both = branches.steps(i) + above
        if i // FANOUT != kept:  # what is above the siblings is the same for a run
            kept, steps = i // FANOUT, branches.steps(i)[1:]
            rest = "".join(a + b for a, b in steps) + end
        first = "".join(branches.steps(i)[0]) if len(branches.sizes) > 1 else ""
        root = folded(r["tampered"], both)
        out.append((r["key"], r["leaf"], own["subroot"], own["root"], joined_digest([first, rest]), root, root == own["root"]))
    return out


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row: what its proof says of the text that was tampered with."""
    of = manifest(document_leaves(docs))
    return proven(of.sources, _audit_rows, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", of.subroots)
