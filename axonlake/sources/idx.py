"""Data source of IDX files, plain or gzipped: labels and images of fixed size by index, a partition a range of indexes."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a file of labels and one of images begin with.
MAGIC = {"labels": 2049, "images": 2051}


def _open(path: str):
    with open(path, "rb") as f:
        packed = f.read(2) == b"\x1f\x8b"
    return gzip.open(path, "rb") if packed else open(path, "rb")  # noqa: SIM115


def _exactly(f, n: int, what: str) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"the file ends within {what}")
    return data


def header(path: str, kind: str) -> tuple[int, int, int, int]:
    """(bytes of the header, records, rows, columns) of a file of that kind; labels have one row and column."""
    with _open(path) as f:
        magic, count = struct.unpack(">II", _exactly(f, 8, "its header"))
        if magic != MAGIC[kind]:
            raise ValueError(f"the file doesn't begin as one of {kind}")
        if not count:
            raise ValueError("the file has no records")
        if kind == "labels":
            return 8, count, 1, 1
        rows, cols = struct.unpack(">II", _exactly(f, 8, "its header"))
        return 16, count, rows, cols


class Range(InputPartition):
    pass


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.step = options["path"], options.get("kind", "labels"), int(options.get("records", 10_000))
        self.start, self.count, self.rows, self.cols = header(self.path, self.kind)
        self.classes = int(options.get("classes", 256))
        for name, found in (("count", self.count), ("rows", self.rows), ("cols", self.cols)):
            if name in options and int(options[name]) != found:
                raise ValueError(f"{name} is {found}, not {options[name]}")

    def partitions(self):
        return [Range((lo, min(lo + self.step, self.count))) for lo in range(0, self.count, self.step)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        """The range's records. A gzipped file is read through to where they begin, in pieces; the last range also sees that nothing follows."""
        lo, hi = partition.value
        size = self.rows * self.cols
        with _open(self.path) as f:
            left = self.start + lo * size
            while left:
                left -= len(_exactly(f, min(left, 1 << 20), "its records"))
            for at in range(lo, hi, max(1, (1 << 22) // size)):
                n = min(hi - at, max(1, (1 << 22) // size))
                data, index = _exactly(f, n * size, "its records"), pa.array(np.arange(at, at + n))
                if self.kind == "labels":
                    labels = np.frombuffer(data, np.uint8)
                    if labels.max() >= self.classes:
                        raise ValueError(f"label {labels.max()} at {at + int(labels.argmax())} is not below {self.classes}")
                    yield pa.RecordBatch.from_arrays([index, pa.array(labels.astype(np.int32))], names=["index", "label"])
                else:
                    pixels = pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary())
                    yield pa.RecordBatch.from_arrays([index, pa.array(np.full(n, self.rows, np.int32)), pa.array(np.full(n, self.cols, np.int32)), pixels], names=["index", "rows", "cols", "pixels"])
            if hi == self.count and f.read(1):
                raise ValueError("bytes follow the last record")


class Idx(DataSource):
    """format("idx").option("path", ...): a file that driver and executors can read. Options: kind (labels or images), records a partition, and what must hold: count, rows, cols, classes."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return {"labels": "index long, label int", "images": "index long, rows int, cols int, pixels binary"}[self.options.get("kind", "labels")]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
