"""Array archives in folders as a data source of Spark: ``spark.read.format("archives")`` and ``df.write.format("archives")``.

Reading: files are dealt into partitions by their bytes. Of an archive a task reads the directory at its end and the members that are asked for, by
their places: without ``cells`` only the start of the array, which has its shape. Writing: each task writes into a folder of its own, which isn't seen
until the job commits; then the folders of the tasks that were accepted are renamed, one each, and what other attempts left is deleted. So a task that
runs twice leaves nothing double, and a job that fails leaves nothing.

Paths are those that ``pyarrow.fs`` opens from every executor: a shared folder, HDFS, an object store. For others there is ``arrays.read_archives``.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodestar.functions import names

#: Bytes of the files of one partition; a larger file is one of its own.
PARTITION_BYTES = 32_000_000
#: The members of an archive that tell of its array.
METADATA = ("spacing", "sequence", "series_id", "slice_index")
_STAGING = "_staging-"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _member(archive: zipfile.ZipFile, name: str, shape_only: bool = False) -> np.ndarray | tuple[int, ...]:
    """A member, or its shape by its first bytes."""
    with archive.open(f"{name}.npy") as f:
        if not shape_only:
            return np.lib.format.read_array(io.BytesIO(f.read()), allow_pickle=False)
        version = np.lib.format.read_magic(f)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]


def read_archive(source: io.IOBase, array: str, cells: bool) -> dict:
    """Shape, spacing (1, 1 if absent), metadata, and the cells if they are asked for."""
    with zipfile.ZipFile(source) as archive:
        there = {n.removesuffix(".npy") for n in archive.namelist()}
        if array not in there:
            raise ValueError(f"no array {array}")
        found = {k: _member(archive, k) for k in METADATA if k in there}
        x = _member(archive, array, not cells)
    text = lambda v: None if v is None else v.item().decode() if isinstance(v.item(), bytes) else str(v.item())
    out = {k: text(found.get(k)) for k in ("sequence", "series_id")} | {"slice_index": None if "slice_index" not in found else int(text(found["slice_index"]))}
    out["spacing"] = found["spacing"].astype(float).tolist() if "spacing" in found else [1.0, 1.0]
    return out | ({"shape": list(x.shape), "cells": x.astype(float).ravel().tolist()} if cells else {"shape": list(x)})


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.array, self.cells = options["path"], options.get("array", "image"), options.get("cells", "true").lower() == "true"
        self.pattern, self.most = options.get("pattern", "*.npz"), int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[Files]:
        system, base = _place(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and fnmatch(f.base_name, self.pattern) and f"/{_STAGING}" not in f.path]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if held and size + f.size > self.most:
                out.append(Files(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, Files(held)]

    def opened(self, system: fs.FileSystem, path: str) -> io.IOBase:
        return system.open_input_file(path)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, base = _place(self.path)
        for path in partition.paths:
            row = {"file": posixpath.relpath(path, base)}
            try:
                with self.opened(system, path) as f:
                    row |= read_archive(f, self.array, self.cells)
            except Exception as e:  # noqa: BLE001  whatever is wrong with one file is told in its row
                row["error"] = f"{type(e).__name__}: {e}"
            yield tuple(row.get(c) for c in ("file", "shape", *(["cells"] if self.cells else []), "spacing", "sequence", "series_id", "slice_index", "error"))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (file, content): ``file`` may have folders; two rows of one name in a task fail it."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, f"{_STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _place(self.path)
        folder, seen = f"{base}/{self.job}/{uuid.uuid4().hex}", set()
        for batch in iterator:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                if not file or file in seen or ".." in file.split("/") or file.startswith("/"):
                    raise ValueError(f"{file!r} is no name of a file, or occurs twice")
                seen.add(file)
                system.create_dir(posixpath.dirname(f"{folder}/{file}"))
                with system.open_output_stream(f"{folder}/{file}") as f:
                    f.write(content.as_buffer())
        return Written(folder, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _place(self.path)
        before = [f.path for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("part-")] if self.overwrite else []
        for n, m in enumerate(m for m in messages if m is not None and m.files):
            system.move(m.folder, f"{base}/part-{n:05d}-{self.job.removeprefix(_STAGING)}")
        for path in before:
            system.delete_dir(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _place(self.path)
        if system.get_file_info(f"{base}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.job}")


class Archives(DataSource):
    """Options: path; array (image), cells (true), pattern (*.npz), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        cells = "cells array<double>, " if self.options.get("cells", "true").lower() == "true" else ""
        return f"file string, shape array<int>, {cells}spacing array<double>, sequence string, series_id string, slice_index int, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


def load_archives(spark: SparkSession, path: str, array: str, cells: bool = True, pattern: str = "*.npz") -> DataFrame:
    """The archives below ``path``; ``file`` is their path below it, less the folder of the task that wrote it. Metadata that an archive lacks follows from its name."""
    spark.dataSource.register(Archives)
    found = spark.read.format("archives").option("path", path).option("array", array).option("cells", str(cells)).option("pattern", pattern).load()
    plain = F.element_at(F.split("file", "/"), -1)
    own = {"sequence": names.sequence_of(plain), "series_id": names.series_id(plain), "slice_index": names.slice_index(plain)}
    return found.withColumns({c: F.coalesce(c, x) for c, x in own.items()}).withColumn("file", F.regexp_replace("file", r"^part-\d{5,}-[0-9a-f]{32}/", ""))


def save_archives(packed: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (file, content) below ``path``; all of them are there when it returns, and none of them if it fails."""
    packed.sparkSession.dataSource.register(Archives)
    packed.select("file", "content").write.format("archives").option("path", path).mode("overwrite" if overwrite else "append").save()


def save_pairs(images: DataFrame, masks: DataFrame, path: str, overwrite: bool = False) -> None:
    """Packed images with their masks, as images/<file> and masks/<file>; what has no partner isn't written."""
    both = images.select("file", F.col("content").alias("image")).join(masks.select("file", F.col("content").alias("mask")), "file")
    parts = F.explode(F.array(F.struct(F.concat(F.lit("images/"), "file").alias("file"), F.col("image").alias("content")), F.struct(F.concat(F.lit("masks/"), "file").alias("file"), F.col("mask").alias("content"))))
    save_archives(both.select(parts.alias("x")).select("x.*"), path, overwrite)
