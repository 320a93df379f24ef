"""Archives as files: what is read of them, how they are dealt out, and what an interrupted write leaves."""

import io
import os

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from lodestar.sources import archive_files


def save(path, **members):
    out = io.BytesIO()
    np.savez_compressed(out, **members)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(out.getvalue())


class Counting(archive_files.ArchiveReader):
    """Counts the bytes that are read."""

    def opened(self, system: fs.FileSystem, path: str):
        reader = self

        class File(io.FileIO):
            def readinto(self, buffer):
                n = super().readinto(buffer)
                reader.bytes += n
                return n

            def read(self, size=-1):
                data = super().read(size)
                reader.bytes += len(data)
                return data

        return File(path)

    bytes = 0


def rows_and_bytes(path, **options):
    reader = Counting({"path": str(path), **options})
    return [r for p in reader.partitions() for r in reader.read(p)], reader.bytes


def test_only_what_is_asked_for_is_read(tmp_path):
    noise = np.random.default_rng(1).random((200, 300))
    save(tmp_path / "a/x_t2_s001.npz", image=noise, mask=noise, spacing=np.array([0.5, 2.0]), sequence=np.array("T2"), slice_index=np.array(7))
    size = os.path.getsize(tmp_path / "a/x_t2_s001.npz")
    (row,), read = rows_and_bytes(tmp_path)
    assert row[0] == "a/x_t2_s001.npz" and row[1] == [200, 300] and np.array_equal(np.reshape(row[2], (200, 300)), noise) and row[3:] == ([0.5, 2.0], "T2", None, 7, None)
    assert 0.4 * size < read < 0.7 * size
    (row,), read = rows_and_bytes(tmp_path, cells="false")
    assert row == ("a/x_t2_s001.npz", [200, 300], [0.5, 2.0], "T2", None, 7, None) and read < 0.05 * size


def test_broken_files_are_rows_and_partitions_go_by_bytes(tmp_path):
    for i in range(10):
        save(tmp_path / f"{i}.npz", image=np.random.default_rng(i).random((20, 20)))
    (tmp_path / "3.npz").write_bytes(b"PK broken")
    save(tmp_path / "4.npz", mask=np.zeros((2, 2)))
    rows, _ = rows_and_bytes(tmp_path)
    assert [r[0] for r in rows if r[-1]] == ["3.npz", "4.npz"] and "no array image" in rows[4][-1]
    parts = archive_files.ArchiveReader({"path": str(tmp_path), "partitionbytes": "7000"}).partitions()
    assert len(parts) > 2 and sorted(os.path.basename(p) for x in parts for p in x.paths) == [f"{i}.npz" for i in range(10)]
    assert archive_files.ArchiveReader({"path": str(tmp_path), "pattern": "*.none"}).partitions()[0].paths == []


def batch(*files):
    return pa.RecordBatch.from_pydict({"file": list(files), "content": [f.encode() for f in files]})


def test_a_task_that_runs_twice_leaves_nothing_double(tmp_path):
    writer = archive_files.ArchiveWriter({"path": str(tmp_path)}, overwrite=False)
    writer.write(iter([batch("x/a", "b")]))  # its message is lost
    messages = [writer.write(iter([batch("x/a"), batch("b")])), writer.write(iter([batch("c")])), writer.write(iter([])), None]
    assert archive_files.ArchiveReader({"path": str(tmp_path), "pattern": "*"}).partitions()[0].paths == []  # not before the commit
    writer.commit(messages)
    found = lambda: sorted(str(p.relative_to(tmp_path)).partition("/")[2] for p in tmp_path.rglob("*") if p.is_file())
    assert found() == ["b", "c", "x/a"]
    again = archive_files.ArchiveWriter({"path": str(tmp_path)}, overwrite=True)
    again.abort([again.write(iter([batch("d")]))])
    assert found() == ["b", "c", "x/a"]
    again = archive_files.ArchiveWriter({"path": str(tmp_path)}, overwrite=True)
    again.commit([again.write(iter([batch("d")]))])
    assert found() == ["d"]
    for wrong in (("a", "a"), ("../a",), ("/a",), ("",)):
        with pytest.raises(ValueError, match="name"):
            again.write(iter([batch(*wrong)]))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(8).selectExpr("concat('f', id, '.npz') AS file", "cast(if(id = 5, raise_error('broken'), 'x') AS binary) AS content").repartition(4)
    with pytest.raises(Exception, match="broken"):
        archive_files.save_archives(rows, f"file://{tmp_path}/out")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
