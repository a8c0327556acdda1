"""Single data files: reading and writing Parquet outside of a table, and describing files for adoption."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from enum import Enum

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from siltstone.table import files as tf
from siltstone.table.storage import open_storage
from siltstone.table.types import Schema, arrow_records

CODEC = "zstd"


class FileFormat(Enum):
    """Formats of data files. Only Parquet is read and written; tables refuse the others."""

    PARQUET = "parquet"
    AVRO = "avro"
    ORC = "orc"


def _parquet_only(format: FileFormat | str) -> None:
    name = format.value if isinstance(format, FileFormat) else str(format).lower()
    if name != "parquet":
        raise ValueError(f"only Parquet files are read and written, not {name}")


class DataFileReader:
    """Reads one file. Results come to the driver; :meth:`df` gives a DataFrame instead."""

    def __init__(self, path: str, format: FileFormat | str = FileFormat.PARQUET):
        _parquet_only(format)
        self.path, self._file = path, pq.ParquetFile(path)

    def __enter__(self) -> DataFileReader:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    @property
    def schema(self) -> pa.Schema:
        return self._file.schema_arrow

    def df(self, spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
        rows = spark.read.parquet("file://" + os.path.abspath(self.path))
        return rows if columns is None else rows.select(*[f"`{c}`" for c in self._known(columns)])

    def _known(self, columns: list[str] | None) -> list[str] | None:
        unknown = [c for c in columns or [] if c not in self.schema.names]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        return columns

    def read_all(self) -> pa.Table:
        return self._file.read()

    def read_columns(self, columns: list[str]) -> pa.Table:
        return self._file.read(columns=self._known(columns)).select(columns)

    def read_batches(self, batch_size: int = 10_000, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
        yield from self._file.iter_batches(batch_size, columns=self._known(columns))

    def read_pandas(self) -> pd.DataFrame:
        return self.read_all().to_pandas()

    def read_columns_pandas(self, columns: list[str]) -> pd.DataFrame:
        return self.read_columns(columns).to_pandas()

    def read_batches_pandas(self, batch_size: int = 10_000) -> Iterator[pd.DataFrame]:
        for batch in self.read_batches(batch_size):
            yield batch.to_pandas()


class DataFileWriter:
    """Writes one file in pieces; it appears under its name when closed, and not at all if the ``with`` block raises."""

    def __init__(self, path: str, schema: Schema, format: FileFormat | str = FileFormat.PARQUET):
        _parquet_only(format)
        self.path, self.schema = path, schema
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        self._temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        self._writer = pq.ParquetWriter(self._temporary, schema.arrow(), compression=CODEC)
        self.rows = 0

    def write_batch(self, batch: pa.RecordBatch | pa.Table) -> None:
        table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
        self._writer.write_table(table.select(self.schema.names).cast(self.schema.arrow()))
        self.rows += table.num_rows

    def write_records(self, records: list[dict]) -> None:
        self.write_batch(arrow_records(records, self.schema))

    def write_pandas(self, frame: pd.DataFrame) -> None:
        self.write_batch(pa.Table.from_pandas(frame, schema=self.schema.arrow(), preserve_index=False))

    def close(self) -> None:
        self._writer.close()
        with open(self._temporary, "rb") as f:
            os.fsync(f.fileno())
        os.replace(self._temporary, self.path)

    def __enter__(self) -> DataFileWriter:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.close()
        else:
            self._writer.close()
            os.unlink(self._temporary)


def write_data_file(spark: SparkSession, root: str, path: str, records: list[dict] | pd.DataFrame | DataFrame, schema: Schema, partition_values: dict | None = None, format: FileFormat | str = FileFormat.PARQUET) -> tf.DataFile:
    """Write records, a pandas frame or a DataFrame (as one file) below a table's folder; its entry, with bounds and checksum, for :meth:`Table.append_data`."""
    _parquet_only(format)
    storage = open_storage(root, spark)
    if isinstance(records, DataFrame):  # written by one task and moved under its name
        aside = f"{path}.{uuid.uuid4().hex}"
        records.select(*schema.names).coalesce(1).write.option("compression", CODEC).parquet(storage.uri(aside))
        part = next(n for n in storage.names(aside) if n.endswith(".parquet"))
        storage.move(f"{aside}/{part}", path)
        storage.delete(aside)
    else:
        rows = pa.Table.from_pandas(records, schema=schema.arrow(), preserve_index=False) if isinstance(records, pd.DataFrame) else arrow_records(records, schema)
        sink = pa.BufferOutputStream()
        pq.write_table(rows, sink, compression=CODEC)
        storage.write(path, sink.getvalue())
    return tf.describe(spark, storage, [tf.relative_to(storage, path)], schema, partition_values=partition_values)[0]


def read_data_file(path: str, columns: list[str] | None = None) -> list[dict]:
    """The rows of one file as dicts."""
    with DataFileReader(path) as r:
        return (r.read_all() if columns is None else r.read_columns(columns)).to_pylist()


def read_pandas_file(path: str, columns: list[str] | None = None) -> pd.DataFrame:
    with DataFileReader(path) as r:
        return r.read_pandas() if columns is None else r.read_columns_pandas(columns)


def is_compatible(records: list[dict], schema: Schema) -> bool:
    """Whether records could be appended to a table with this schema."""
    try:
        arrow_records(records, schema)
    except ValueError:
        return False
    return True


def is_pandas_compatible(frame: pd.DataFrame, schema: Schema) -> bool:
    """Whether a pandas frame has the schema's columns and types, with no nulls in required ones."""
    try:
        table = pa.Table.from_pandas(frame, schema=schema.arrow(), preserve_index=False)
    except (pa.ArrowInvalid, pa.ArrowTypeError, KeyError):
        return False
    return not set(frame.columns) - set(schema.names) and not any(table[f.name].null_count for f in schema.fields if f.required)


def check_files(root: str, files: list[tf.DataFile], spark: SparkSession | None = None) -> None:
    """``FileNotFoundError`` naming the files that are not there."""
    storage = open_storage(root, spark)
    missing = [f.path for f in files if not storage.exists(f.path)]
    if missing:
        raise FileNotFoundError(f"missing data files: {missing}")
