"""Random access to FASTA files: an index of contigs by byte offset, and reads of the asked windows' bytes alone."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalars import normalize_chrom
from .arrays import _at

NAME = "fastaruns"
_RUN = pa.schema([("file", pa.string()), ("part", pa.int64()), ("k", pa.int64()), ("head", pa.string()), ("offset", pa.int64()), ("letters", pa.int64()), ("width", pa.int64()), ("stride", pa.int64()), ("uneven", pa.int64()), ("last", pa.int64())])


@dataclass
class Bytes(InputPartition):
    """The lines of a file that begin in [low, high)."""

    path: str
    part: int
    low: int
    high: int


class RunReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("partitionbytes", 64 << 20))

    def partitions(self):
        store, path = _at(self.path)
        info = store.get_file_info(path)
        folder = info.type == fs.FileType.Directory
        files = [f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.base_name[0] not in "._"] if folder else [info]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            name = f"{self.path.rstrip('/')}/{f.base_name}" if folder else self.path
            out += [Bytes(name, low // self.most, low, min(f.size, low + self.most)) for low in range(0, f.size, self.most)]
        return out

    def read(self, partition: Bytes | None) -> Iterator[pa.RecordBatch]:
        """A row for each head and its lines, and one (without a head) for lines before the first head."""
        if partition is None:
            return
        store, path = _at(partition.path)
        rows: list[dict] = []
        with io.BufferedReader(store.open_input_file(path), 1 << 20) as f:
            at = partition.low
            if at:  # a line that began before is the part's before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            now = None
            while at < partition.high and (raw := f.readline()):
                line = raw.rstrip(b"\r\n")
                if line[:1] == b">" or now is None:
                    now = {"file": partition.path, "part": partition.part, "k": len(rows), "head": None, "offset": None, "letters": 0, "width": 0, "stride": 0, "uneven": 0, "last": 0, "short": 0}
                    rows.append(now)
                if line[:1] == b">":
                    now["head"] = (line[1:].decode().split() or [""])[0]
                elif line:
                    if now["offset"] is None:
                        now |= {"offset": at, "width": len(line), "stride": len(raw)}
                    now["uneven"] += now["short"] + (len(line) > now["width"])  # a line before this one was short
                    now["short"] = int(len(line) < now["width"])
                    now["letters"] += len(line)
                    now["last"] = at + len(line) - 1
                at += len(raw)
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in _RUN.names} for r in rows], schema=_RUN)


class FastaRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, part long, k long, head string, offset long, letters long, width long, stride long, uneven long, last long"

    def reader(self, schema) -> DataSourceReader:
        return RunReader(self.options)


def fasta_index(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(file, contig, length, offset, width, stride, even) of each contig of a file or folder: where its first letter lies, how many letters
    and bytes a line has. Files are read in ranges of bytes; a contig's lines meet only as totals of ranges.

    ``even`` is false where a line before a contig's last one is shorter or longer than its first: such contigs have no random access.
    """
    spark.dataSource.register(FastaRuns)
    runs = spark.read.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)
    upto = Window.partitionBy("file").orderBy("part", "k")
    runs = runs.withColumn("turn", F.count("head").over(upto)).where("turn > 0")
    first = F.struct("part", "k")
    out = runs.groupBy("file", "turn").agg(
        F.max("head").alias("contig"), F.sum("letters").alias("length"), F.min("offset").alias("offset"), F.min_by("width", F.when(F.col("letters") > 0, first)).alias("width"),
        F.min_by("stride", F.when(F.col("letters") > 0, first)).alias("stride"), F.sum("uneven").alias("uneven"), F.max("last").alias("last"))
    left = F.col("length") - 1
    even = (F.col("length") == 0) | ((F.col("uneven") == 0) & (F.col("last") == F.col("offset") + F.floor(left / F.col("width")) * F.col("stride") + left % F.col("width")))
    return out.select("file", normalize_chrom(F.col("contig")).alias("contig"), "length", "offset", "width", "stride", even.alias("even"))


def fasta_windows(windows: DataFrame, index: DataFrame, gap: int = 4096, bucket: int = 1 << 20, counter=None) -> DataFrame:
    """(contig, start, length, seq) for each different window (contig, start from 0, length), in upper case, reading only bytes that are asked for.

    A window is cut at the contig's ends; one outside of it, or on an unknown contig, has an empty seq; windows of a contig that
    isn't ``even`` raise an error. Windows of a megabyte of a file are one task's work at a time, sorted by place; those less
    than ``gap`` bytes apart share a read. ``counter``, an accumulator, gets the bytes that were read.
    """
    asked = windows.select(normalize_chrom(F.col("contig")).alias("contig"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")).where("contig is not null and start is not null and length is not null").distinct()
    known = index.withColumnRenamed("length", "letters")
    low, high = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("length"), F.col("letters"))
    at = lambda p: F.col("offset") + F.floor(p / F.col("width")) * F.col("stride") + p % F.col("width")
    found = asked.join(known, "contig").where(low < high)
    even = F.when(F.col("even"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("lines differ in length: "), F.col("contig"))).cast("boolean"))
    found = found.where(even).select("contig", "start", "length", "file", at(low).alias("b0"), (at(high - 1) + 1).alias("b1"))
    found = found.withColumn("bucket", F.floor(F.col("b0") / bucket)).repartition("file", "bucket").sortWithinPartitions("file", "bucket", "b0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            files, b0, b1 = batch.column("file").to_pylist(), batch.column("b0").to_numpy(), batch.column("b1").to_numpy()
            seqs, k = [], 0
            while k < len(files):
                end, to = k + 1, b1[k]
                while end < len(files) and files[end] == files[k] and b0[k] <= b0[end] <= to + gap:
                    to, end = max(to, b1[end]), end + 1
                store, path = _at(files[k])
                with store.open_input_file(path) as f:
                    raw = f.read_at(int(to - b0[k]), int(b0[k]))
                if counter is not None:
                    counter.add(len(raw))
                view = memoryview(raw)
                seqs += [bytes(view[int(a - b0[k]) : int(b - b0[k])]).translate(None, b"\r\n").decode().upper() for a, b in zip(b0[k:end], b1[k:end], strict=True)]
                k = end
            yield pa.RecordBatch.from_arrays([batch.column("contig"), batch.column("start"), batch.column("length"), pa.array(seqs, pa.string())], ["contig", "start", "length", "seq"])

    got = found.mapInArrow(read, "contig string, start long, length long, seq string")
    return asked.join(got, ["contig", "start", "length"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))
