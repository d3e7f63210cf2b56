"""Answers meet their rows where the rows are, so that no text is moved to be joined with what was found out about it.

A frame is pinned: every pass over it sees the same partitions, and the column part has a row's partition. What a pass asks travels as hashes. The answers are grouped by
part, and each part's answers become one file in the shared folder, which the task that reads the part again opens. It is one plan for all sizes: nothing that grows with the
input is broadcast, and a key that a third of all rows hold costs each part one answer.

A file is complete under a temporary name before it gets its own, so an attempt that dies leaves nothing that is read; a repeated attempt writes the same answers again. The folders go
when the process ends, or earlier where a caller knows that nothing reads them any more.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincask.llm.common import settle, shared_dir
from graincask.llm.words import U, mix


class Pinned(NamedTuple):
    """Rows with the column part, and the number of parts."""

    rows: DataFrame
    parts: int


def pinned(rows: DataFrame) -> Pinned:
    """The rows over partitions that are planned once, so that a pass over them never sees others, also where executors come and go. rows must not have a column part."""
    spark = rows.sparkSession
    marked = rows.withColumn("part", F.spark_partition_id())
    rdd = marked._jdf.queryExecution().toRdd()
    rdd.setName(marked._jdf.queryExecution().executedPlan().toString()[:4000])  # Spark's pages show what is read
    return Pinned(DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, marked._jdf.schema(), False), spark), rdd.getNumPartitions())


def parts_of(settled: DataFrame) -> int:
    """Partitions of a settled frame."""
    return settled._jdf.queryExecution().toRdd().getNumPartitions()


def filesystem(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        scheme, _, rest = path.partition("://")
        return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest}")
    return fs.LocalFileSystem(), path


def delete(*folders: str) -> None:
    for folder in folders:
        where, path = filesystem(folder)
        if where.get_file_info(path).type.name == "Directory":
            where.delete_dir(path)


_LEFT: set[str] = set()


@atexit.register
def _clear() -> None:
    for folder in _LEFT:
        try:
            delete(folder)
        except OSError:  # already gone with the shared folder
            pass


def new_folder(df: DataFrame, kind: str = "answers") -> str:
    """A folder of its own in the shared folder, which goes at the end of the process if not before."""
    folder = f"{shared_dir(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    _LEFT.add(folder)
    return folder


def put(folder: str, part: int, table: pa.Table) -> None:
    where, path = filesystem(folder)
    where.create_dir(path, recursive=True)
    fresh = f"{path}/{part}.{uuid.uuid4().hex}"
    with where.open_output_stream(fresh) as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table)
    where.move(fresh, f"{path}/{part}")


def file_away(answers: DataFrame) -> str:
    """Writes the answers (part and other columns) as a file per part. The folder's name."""
    folder = new_folder(answers)

    def one(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        put(folder, part, t.drop_columns(["part"]))
        return pa.table({"part": pa.array([part], pa.int32()), "rows": pa.array([t.num_rows], pa.int64())})

    settle(answers.groupBy("part").applyInArrow(one, "part int, rows long"))
    return folder


def told(folder: str, part: int) -> pa.Table | None:
    """What was filed for a part; None where there is nothing."""
    where, path = filesystem(folder)
    if where.get_file_info(f"{path}/{part}").type.name != "File":
        return None
    with where.open_input_file(f"{path}/{part}") as f:
        return pa.ipc.open_file(f).read_all()


def name(*keys: np.ndarray) -> np.ndarray:
    """One number per row for its keys, for use within a part."""
    out = np.zeros(len(keys[0]), U)
    for k, key in enumerate(keys):
        out = mix(out + mix(key.astype(np.int64).view(U) + U(k + 1)))
    return out


class Told:
    """Look-up of what rows of a part were told, by key columns."""

    def __init__(self, folder: str, part: int, *keys: str):
        self.table = told(folder, part)
        if self.table is None or not self.table.num_rows:
            self.names, self.table = np.empty(0, U), None
            return
        names = name(*(self.table.column(k).to_numpy() for k in keys))
        self.order = np.argsort(names, kind="stable")
        self.names = names[self.order]

    def find(self, *keys: np.ndarray) -> np.ndarray:
        """The row of the table for each row, or -1."""
        if not len(self.names):
            return np.full(len(keys[0]), -1)
        want = name(*keys)
        at = np.minimum(np.searchsorted(self.names, want), len(self.names) - 1)
        return np.where(self.names[at] == want, self.order[at], -1)


def by_part(batches: Iterator[pa.RecordBatch], most: int = 1 << 15) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batches, each of one part and of at most so many rows."""
    for batch in batches:
        parts = batch.column(batch.schema.get_field_index("part")).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for s in range(a, b, most):
                yield int(parts[s]), batch.slice(s, min(most, b - s))
