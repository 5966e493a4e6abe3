"""Files of fixed-width records as a data source: ``spark.read.format("records")`` and ``df.write.format("records")``.

A partition is a list of byte ranges cut at record borders, so a large file is read by many tasks and many small files by
one. Files are opened through ``pyarrow.fs``, which knows local folders and the usual object stores. A file belongs to the
contract that its name begins with, up to the first ``-`` or ``.``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RECORD_BYTES = 32
RANGE_BYTES = 32 << 20
BATCH_RECORDS = 1 << 16
# layouts of a record (fixed values): field, stored kind, and the number that stored prices are divided by
DAILY = [("date", "<u4", 1), ("open", "<u4", 100), ("high", "<u4", 100), ("low", "<u4", 100), ("close", "<u4", 100),
         ("amount", "<f4", 1), ("volume", "<u4", 1), ("reserved", "<u4", 1)]
SETTLED = [("date", "<i4", 1), ("open", "<f4", 1), ("high", "<f4", 1), ("low", "<f4", 1), ("close", "<f4", 1),
           ("interest", "<i4", 1), ("volume", "<i4", 1), ("settlement", "<f4", 1)]
LAYOUTS = {"daily": DAILY, "settled": SETTLED}
SPARK_TYPES = {"date": "int", "volume": "bigint", "interest": "bigint"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def contract_of(path: str) -> str:
    return os.path.basename(path).split(".")[0].split("-")[0]


class Ranges(InputPartition):
    """(path, first byte, bytes) of a task."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def cut_ranges(files: list[tuple[str, int]], most: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of whole records, at most ``most`` bytes together (one record at least); bytes of a broken last record are left out."""
    most = max(most // RECORD_BYTES, 1) * RECORD_BYTES
    result, room = [], 0
    for path, size in files:
        at, size = 0, size // RECORD_BYTES * RECORD_BYTES
        while at < size:
            if not room:
                result.append([])
                room = most
            take = min(room, size - at)
            result[-1].append((path, at, take))
            at, room = at + take, room - take
    return result


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[tuple[str, str, int]]):
        self.path, self.fields = options["path"], fields
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        system, path = _open(self.path)
        found = system.get_file_info(pafs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == pafs.FileType.Directory \
            else [system.get_file_info(path)]
        # names that begin with a dot or an underscore are no data, as in Spark's own sources
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File
                       and not any(part[0] in "._" for part in f.path[len(path):].split("/") if part))
        return [Ranges(parts) for parts in cut_ranges(files, self.range_bytes)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        layout = np.dtype([(name, kind) for name, kind, _ in self.fields])
        system, _ = _open(self.path)
        for path, start, size in partition.parts:
            with system.open_input_file(path) as file:
                while size:
                    rows = np.frombuffer(file.read_at(min(size, BATCH_RECORDS * RECORD_BYTES), start), dtype=layout)
                    if not len(rows):
                        raise OSError(f"{path} ends before byte {start + size}")
                    start, size = start + rows.nbytes, size - rows.nbytes
                    columns = [pa.array([contract_of(path)] * len(rows))]
                    for name, _, divisor in self.fields:
                        if name != "reserved":
                            kind = {"int": "int32", "bigint": "int64"}.get(SPARK_TYPES.get(name), "float64")
                            columns.append(pa.array(rows[name].astype(kind) / divisor if divisor > 1 else rows[name].astype(kind)))
                    yield pa.RecordBatch.from_arrays(columns, names=["instrument", *[n for n, _, _ in self.fields if n != "reserved"]])


class RecordWriter(DataSourceArrowWriter):
    """A file per task and contract, if rows come sorted by contract; files get their names when the whole job has succeeded."""

    def __init__(self, options: dict, fields: list[tuple[str, str, int]], overwrite: bool):
        self.path, self.fields, self.overwrite, self.job = options["path"], fields, overwrite, uuid.uuid4().hex

    def _records(self, batch: pa.RecordBatch) -> np.ndarray:
        rows = np.zeros(batch.num_rows, dtype=[(name, kind) for name, kind, _ in self.fields])
        for name, kind, scale in self.fields:
            if name in batch.schema.names:
                values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                if "f" not in kind:
                    values = np.floor(values * float(scale) + 0.5) if scale > 1 else values
                    ends = np.iinfo(np.dtype(kind))
                    if len(values) and not (values.min() >= ends.min and values.max() <= ends.max):
                        raise ValueError(f"{name} is null or does not fit its field")
                rows[name] = values
        return rows

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = _open(self.path)
        folder, attempt = f"{path}/_{self.job}", uuid.uuid4().hex
        system.create_dir(folder, recursive=True)
        names, contract, file = [], None, None
        for batch in batches:
            rows = self._records(batch)
            contracts = batch.column(batch.schema.get_field_index("instrument")).to_pylist()
            edges = [0, *(i for i in range(1, len(rows)) if contracts[i] != contracts[i - 1]), len(rows)]
            for start, stop in zip(edges, edges[1:]):
                if start < stop:
                    if file is None or contracts[start] != contract:
                        if file is not None:
                            file.close()
                        contract = contracts[start]
                        names.append(f"{contract}-{attempt}-{len(names)}.day")
                        file = system.open_output_stream(f"{folder}/{names[-1]}")
                    file.write(rows[start:stop].tobytes())
        if file is not None:
            file.close()
        return Written([(f"{folder}/{name}", f"{path}/{name}") for name in names])

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(path)):
                if old.type == pafs.FileType.File:
                    system.delete_file(old.path)
        for message in messages:
            for temporary, name in message.files if message else ():
                system.move(temporary, name)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        if system.get_file_info(f"{path}/_{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{path}/_{self.job}")


class RecordSource(DataSource):
    """Options: ``path``; ``layout`` (daily, the default, or settled); ``rangeBytes``, most bytes read by a task."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def _fields(self) -> list[tuple[str, str, int]]:
        return LAYOUTS[self.options.get("layout", "daily")]

    def schema(self) -> str:
        return "instrument string, " + ", ".join(f"{name} {SPARK_TYPES.get(name, 'double')}" for name, _, _ in self._fields() if name != "reserved")

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options, self._fields())

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, self._fields(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
