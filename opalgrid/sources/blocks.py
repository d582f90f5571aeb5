"""Block files: fixed-size blocks of packed rows.

Rows have no header and never span blocks: little-endian integers and floats, strings in UTF-8 that a zero byte ends.
The last two bytes of a block hold its number of rows, zeros fill the space before them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import qualified

#: Fixed values of the format.
CODES = {"int": "<i", "bigint": "<q", "float": "<f", "double": "<d"}
COUNT_BYTES = 2
BLOCK_SIZE = 4096
BLOCKS_PER_BATCH = 64


def encode_row(row: Iterable, types: list[str]) -> bytes:
    out = bytearray()
    for value, kind in zip(row, types, strict=True):
        if kind == "string":
            raw = value.encode()
            if b"\0" in raw:
                raise ValueError("a string with a zero byte can't be written")
            out += raw + b"\0"
        else:
            out += struct.pack(CODES[kind], value)
    return bytes(out)


def encode_blocks(rows: Iterable[Iterable], types: list[str], block_size: int = BLOCK_SIZE) -> Iterator[bytes]:
    """Blocks filled in the order of the rows."""
    room, held, n = block_size - COUNT_BYTES, bytearray(), 0
    for row in rows:
        raw = encode_row(row, types)
        if len(raw) > room:
            raise ValueError(f"a row of {len(raw)} bytes is larger than a block")
        if len(held) + len(raw) > room or n == 0xFFFF:
            yield bytes(held).ljust(room, b"\0") + struct.pack("<H", n)
            held, n = bytearray(), 0
        held += raw
        n += 1
    if n:
        yield bytes(held).ljust(room, b"\0") + struct.pack("<H", n)


class Decoder:
    """Rows of blocks as columns: neighbouring numbers are read by one format, blocks without strings as one array."""

    def __init__(self, types: list[str]) -> None:
        self.types = types
        self.steps: list[tuple[int, struct.Struct | None]] = []  # the first column, and the format; none for a string
        for i, kind in enumerate(types):
            if kind == "string":
                self.steps.append((i, None))
            elif i and self.steps and self.steps[-1][1] is not None:
                first, form = self.steps[-1]
                self.steps[-1] = (first, struct.Struct(form.format + CODES[kind][1:]))
            else:
                self.steps.append((i, struct.Struct(CODES[kind])))
        self.row = None if "string" in types else np.dtype([(f"c{i}", {"int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}[k]) for i, k in enumerate(types)])

    def columns(self, block: bytes) -> list:
        (n,) = struct.unpack_from("<H", block, len(block) - COUNT_BYTES)
        if self.row is not None:
            rows = np.frombuffer(block, self.row, n)
            return [rows[name].tolist() for name in rows.dtype.names]
        out: list[list] = [[] for _ in self.types]
        at = 0
        for _ in range(n):
            for first, form in self.steps:
                if form is None:
                    end = block.index(b"\0", at)
                    out[first].append(block[at:end].decode())
                    at = end + 1
                else:
                    for i, value in enumerate(form.unpack_from(block, at), first):
                        out[i].append(value)
                    at += form.size
        return out


def decode_block(block: bytes, types: list[str]) -> Iterator[tuple]:
    """The rows of one block."""
    return zip(*Decoder(types).columns(block), strict=True)


def _types(schema: T.StructType) -> list[str]:
    return [f.dataType.simpleString() for f in schema.fields]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, blocks: int) -> None:
        self.path, self.start, self.blocks = path, start, blocks


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.types, self.names = _types(schema), schema.names
        self.block = int(options.get("block_size", BLOCK_SIZE))
        self.per_task = int(options.get("blocks_per_task", 16384))
        self.path = options["path"]

    def _open(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.path.replace("s3a://", "s3://", 1))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, root = self._open()
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and f.path.endswith(".bin")]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.size % self.block:
                raise ValueError(f"{f.path} is no whole number of blocks of {self.block} bytes")
            n = f.size // self.block
            out += [_Range(f.path, at, min(self.per_task, n - at)) for at in range(0, n, self.per_task)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}
        types, decoder = [kinds[t] for t in self.types], Decoder(self.types)
        fs, _ = self._open()
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start * self.block)
            for at in range(0, partition.blocks, BLOCKS_PER_BATCH):
                held = [decoder.columns(f.read(self.block)) for _ in range(min(BLOCKS_PER_BATCH, partition.blocks - at))]
                yield pa.RecordBatch.from_arrays([pa.array([v for block in held for v in block[i]], t) for i, t in enumerate(types)], names=self.names)


class BlockFileSource(DataSource):
    """``spark.read.format("opal_blocks").schema(...).load(path)``; a task reads a range of blocks at a time."""

    @classmethod
    def name(cls) -> str:
        return "opal_blocks"

    def schema(self) -> str:
        raise ValueError("the schema must be given: block files do not hold it")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_blocks(spark: SparkSession, path: str, schema: T.StructType, block_size: int = BLOCK_SIZE) -> DataFrame:
    spark.dataSource.register(BlockFileSource)
    return spark.read.format("opal_blocks").schema(schema).option("block_size", str(block_size)).load(qualified(spark, path))


def write_blocks(frame: DataFrame, folder: str, block_size: int = BLOCK_SIZE) -> None:
    """One block file per partition in a folder that all executors share.

    A file gets its name only when it is whole, so that a task may run again; Parquet is the better choice for new data.
    """
    types, folder = _types(frame.schema), qualified(frame.sparkSession, folder)

    def run(batches):
        import uuid

        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{root}/.part-{part:05d}-{uuid.uuid4().hex}"
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        n = 0
        with fs.open_output_stream(name) as out:
            for block in encode_blocks(rows, types, block_size):
                out.write(block)
                n += 1
        fs.move(name, f"{root}/part-{part:05d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=["part", "blocks"])

    frame.mapInArrow(run, "part int, blocks long").agg({"blocks": "sum"}).collect()
