"""Array files by row position: raw float16 / float32 files and .npy, read in ranges of rows, written as parts with row offsets."""

from __future__ import annotations

import ast
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, PARTS = "rowarrays", "_parts.json"
_KINDS = {"float16": "<f2", "float32": "<f4", "float64": "<f8"}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or the local one of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def npy_header(head: bytes) -> tuple[str, tuple[int, ...], int]:
    """(dtype, shape, offset of the numbers) from a .npy file's first bytes; ValueError unless rows lie one after the other."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("no .npy file")
    wide = head[6] > 1
    size = int.from_bytes(head[8 : 12 if wide else 10], "little")
    begin = 12 if wide else 10
    said = ast.literal_eval(head[begin : begin + size].decode("latin1"))
    if said["fortran_order"]:
        raise ValueError("columns lie one after the other, not rows")
    return said["descr"], tuple(said["shape"]), begin + size


@dataclass
class Rows(InputPartition):
    """``count`` rows of a file from byte ``offset`` on; the first has the position ``first``."""

    path: str
    offset: int
    first: int
    count: int
    kind: str
    dim: int


class ArrayReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.dim = options["path"], options.get("dtype", "float32"), int(options.get("dim", 0))
        self.most = int(options.get("partitionbytes", 64 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))

    def _files(self) -> Iterator[tuple[str, int, int, int, str, int]]:
        """(path, offset, first position, rows, dtype, dim) of each file; only sizes and headers are read here."""
        store, path = _at(self.path)
        if store.get_file_info(path).type == fs.FileType.Directory:
            with store.open_input_stream(f"{path}/{PARTS}") as f:
                said = json.loads(f.read())
            for part in said["parts"]:
                yield f"{self.path.rstrip('/')}/{part['file']}", 0, part["first"], part["rows"], _KINDS[said["dtype"]], said["dim"]
            return
        size = store.get_file_info(path).size
        if path.endswith(".npy"):
            with store.open_input_file(path) as f:
                kind, shape, offset = npy_header(f.read(min(size, 1 << 16)))
            yield self.path, offset, 0, shape[0], kind, int(np.prod(shape[1:], dtype=np.int64))
            return
        if self.dim < 1:
            raise ValueError("a raw file needs the option dim")
        width = self.dim * np.dtype(_KINDS[self.kind]).itemsize
        if size % width:
            raise ValueError(f"{self.path} has {size} bytes, no multiple of a row's {width}")
        yield self.path, 0, 0, size // width, _KINDS[self.kind], self.dim

    def partitions(self):
        out = []
        for path, offset, first, rows, kind, dim in self._files():
            width = max(1, dim * np.dtype(kind).itemsize)
            step = max(1, self.most // width)
            out += [Rows(path, offset + k * width, first + k, min(step, rows - k), kind, dim) for k in range(0, rows, step)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a table without rows
            return
        width = partition.dim * np.dtype(partition.kind).itemsize
        step = max(1, self.batch // max(1, width))
        store, path = _at(partition.path)
        with store.open_input_file(path) as f:
            for k in range(0, partition.count, step):
                n = min(step, partition.count - k)
                raw = f.read_at(n * width, partition.offset + k * width)
                if len(raw) != n * width:
                    raise ValueError(f"{partition.path} ends before row {partition.first + k + n}")
                values = np.frombuffer(raw, partition.kind).astype(np.float32)
                ends = np.arange(n + 1, dtype=np.int32) * partition.dim
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first + k, partition.first + k + n)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["row", "vector"])


@dataclass
class Part(WriterCommitMessage):
    file: str
    first: int
    rows: int
    dim: int


class ArrayWriter(DataSourceArrowWriter):
    """Each task's rows must be one run of positions; the parts together must be positions 0, 1, 2 ... without a gap."""

    def __init__(self, options):
        self.path, self.kind = options["path"].rstrip("/"), options.get("dtype", "float32")
        self.number = np.dtype(_KINDS[self.kind])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, path = _at(self.path)
        out, part = None, Part(f"part-{uuid.uuid4().hex}.bin", 0, 0, 0)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, vectors = batch.column("row").to_numpy(zero_copy_only=False), batch.column("vector")
                if batch.column("row").null_count or vectors.null_count or vectors.flatten().null_count:
                    raise ValueError("a row's position, vector or number is null")
                if out is None:
                    store.create_dir(path, recursive=True)
                    out, part.first, part.dim = store.open_output_stream(f"{path}/{part.file}"), int(rows[0]), len(vectors[0])
                if not (rows == part.first + part.rows + np.arange(len(rows))).all():
                    raise ValueError(f"positions have a gap or a repeat near {part.first + part.rows}")
                values = vectors.flatten().to_numpy()
                if len(values) != part.dim * len(rows):
                    raise ValueError("vectors differ in length")
                out.write(values.astype(self.number).tobytes())
                part.rows += len(rows)
        finally:
            if out is not None:
                out.close()
        return part

    def commit(self, messages) -> None:
        store, path = _at(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        if [m.first for m in parts] != [0, *np.cumsum([m.rows for m in parts]).tolist()][: len(parts)] or len({m.dim for m in parts}) > 1:
            raise ValueError("the parts are no positions 0, 1, 2 ... of vectors of one length")
        store.create_dir(path, recursive=True)
        said = {"dtype": self.kind, "dim": parts[0].dim if parts else 0, "parts": [{"file": m.file, "first": m.first, "rows": m.rows} for m in parts]}
        with store.open_output_stream(f"{path}/{PARTS}") as f:
            f.write(json.dumps(said).encode())

    def abort(self, messages) -> None:
        store, path = _at(self.path)
        for m in messages:
            if m is not None and m.rows:
                store.delete_file(f"{path}/{m.file}")


class RowArrays(DataSource):
    """Format ``rowarrays``: (row long, vector array<float>). Options: path; of raw files dtype and dim; partitionbytes, batchbytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return ArrayWriter(self.options)


def read_arrays(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(row, vector) of a raw file (options dtype, dim), a .npy file or a folder of write_arrays. A partition is a range of rows that is
    read by its byte offset, a few megabytes at a time; half floats become floats."""
    spark.dataSource.register(RowArrays)
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)


def write_arrays(df: DataFrame, row: str, vector: str, path: str, dtype: str = "float32") -> None:
    """Write vectors by position ``row`` (0, 1, 2 ...; ValueError otherwise) as parts of neighbouring rows, with a list of the parts.

    Rows are dealt by ranges of positions and sorted inside a part, so no task sees more than a part. A failed write leaves no
    list of parts, without which a folder can't be read.
    """
    df.sparkSession.dataSource.register(RowArrays)
    rows = df.select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("vector"))
    rows.repartitionByRange("row").sortWithinPartitions("row").write.format(NAME).option("dtype", dtype).mode("append").save(path)
