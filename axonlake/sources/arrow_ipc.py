"""Arrow IPC (Feather) files as a Spark data source: one partition for each record batch, every batch validated."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.ipc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Deepest nesting of lists that is read.
DEPTH = 64


def supported(kind: pa.DataType, depth: int = 0) -> bool:
    """Signed and unsigned integers, 32- and 64-bit floats, UTF-8 strings, lists of these, dictionaries with integer indices."""
    if depth > DEPTH:
        return False
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return supported(kind.value_type, depth + 1)
    if pa.types.is_dictionary(kind):
        return pa.types.is_integer(kind.index_type) and supported(kind.value_type, depth + 1)
    return pa.types.is_integer(kind) or pa.types.is_float32(kind) or pa.types.is_float64(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind)


def plain(kind: pa.DataType) -> pa.DataType:
    """The type after dictionaries are decoded; unsigned 64-bit integers become decimals, which hold them exactly."""
    if pa.types.is_dictionary(kind):
        return plain(kind.value_type)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return pa.list_(plain(kind.value_type))
    if pa.types.is_uint64(kind):
        return pa.decimal128(20, 0)
    if pa.types.is_unsigned_integer(kind):
        return {8: pa.int16(), 16: pa.int32(), 32: pa.int64()}[kind.bit_width]
    return pa.string() if pa.types.is_large_string(kind) else kind


class Batch(InputPartition):
    pass


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], most: int):
        self.path, self.columns, self.most = path, columns, most

    def partitions(self):
        with pa.OSFile(self.path, "rb") as f:
            return [Batch(i) for i in range(pa.ipc.open_file(f).num_record_batches)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with pa.OSFile(self.path, "rb") as f:
            batch = pa.ipc.open_file(f).get_batch(partition.value)
            if batch.nbytes > self.most:
                raise ValueError(f"record batch {partition.value} takes {batch.nbytes} bytes; the limit is {self.most}")
            batch.validate(full=True)
            table = pa.Table.from_batches([batch]).select(self.columns)
            yield from table.cast(pa.schema([(n, plain(table.schema.field(n).type)) for n in self.columns])).to_batches()


class ArrowIpc(DataSource):
    """format("arrow_ipc").option("path", ...): a file that driver and executors can read. Options: columns, max_batch_bytes."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _columns(self) -> tuple[pa.Schema, list[str]]:
        with pa.OSFile(self.options["path"], "rb") as f:
            schema = pa.ipc.open_file(f).schema
        return schema, [c for c in self.options.get("columns", "").split(",") if c] or schema.names

    def schema(self) -> StructType:
        schema, names = self._columns()
        for n in names:
            if n not in schema.names:
                raise ValueError(f"no column {n}")
            if not supported(schema.field(n).type):
                raise ValueError(f"column {n} has the type {schema.field(n).type}, which is not read")
        return from_arrow_schema(pa.schema([(n, plain(schema.field(n).type)) for n in names]))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self._columns()[1], int(self.options.get("max_batch_bytes", 1 << 30)))
