"""Tables: create and load, append, scan, time travel, maintenance."""

from __future__ import annotations

import hashlib
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.table import files as tf
from siltstone.table import maintenance
from siltstone.table import snapshots as sn
from siltstone.table.errors import CommitConflict, ConcurrentModificationException, CorruptDataError, TableExistsError
from siltstone.table.log import CommitLog
from siltstone.table.predicates import FilterExpression, check_types, may_match, parse_filter_dict, to_arrow, to_column
from siltstone.table.storage import Storage, open_storage
from siltstone.table.transaction import Transaction
from siltstone.table.types import PartitionSpec, Schema

VERIFY_CONF = "spark.siltstone.verifyChecksums"
#: Scans whose result goes to the driver read so many files of so many bytes there, without a Spark job.
LOCAL_FILES, LOCAL_BYTES = 32, 32 * 1024 * 1024


@dataclass
class _Plan:
    schema: Schema
    expressions: list[FilterExpression]
    names: list[str]
    files: list[tf.DataFile]
    verify: bool

    @property
    def is_small(self) -> bool:
        return len(self.files) <= LOCAL_FILES and sum(f.size for f in self.files) <= LOCAL_BYTES


class MetadataStore:
    """A table's versions of state in its commit log."""

    def __init__(self, storage: Storage | str):
        self.log = CommitLog(storage)

    def latest(self) -> tuple[int, dict]:
        version, state = self.log.latest()
        if state is None:
            raise ValueError(f"no table at {os.path.dirname(self.log.folder)}")
        return version, state

    def initialize(self, schema: Schema, spec: PartitionSpec | None = None, properties: dict | None = None) -> dict:
        """Publish version 0; :class:`TableExistsError` if there is one."""
        now = int(time.time() * 1000)
        state = {"format": 1, "table_uuid": str(uuid.uuid4()), "schema": schema.as_dicts(), "schema_id": schema.schema_id, "partition_spec": {"spec_id": spec.spec_id, "fields": [vars(f) for f in spec.fields]} if spec else {"spec_id": 0, "fields": []}, "properties": properties or {}, "snapshots": [], "current_snapshot_id": -1, "last_sequence_number": 0, "history": [], "metadata_log": [], "last_updated_ms": now}
        try:
            self.log.publish(0, state)
        except CommitConflict:
            raise TableExistsError(os.path.dirname(self.log.folder)) from None
        return state

    def commit(self, base: int, old: dict, new: dict) -> int:
        """Publish ``new`` after version ``base``; :class:`ConcurrentModificationException` if that is not the newest."""
        keep = int(new["properties"].get(sn.VERSIONS, 100))
        entries = [*old["metadata_log"], {"version": base, "timestamp_ms": old["last_updated_ms"]}][-keep:]
        versions = self.log.versions()
        try:
            if versions[-1] != base:
                raise CommitConflict(f"version {base} is not the newest")
            self.log.publish(base + 1, new | {"metadata_log": entries})
        except CommitConflict as e:
            raise ConcurrentModificationException(str(e)) from None
        if len(versions) >= keep:
            self.log.trim(keep, [*versions, base + 1])
        return base + 1


class Table:
    """A handle on a table folder. The state is read anew for every operation; nothing is cached."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.storage = spark, open_storage(root, spark)
        self.root = self.storage.root
        self.store = MetadataStore(self.storage)

    # ---- state ----

    def state(self) -> dict:
        return self.store.latest()[1]

    def refresh(self) -> dict:
        return self.state()

    @property
    def schema(self) -> Schema:
        s = self.state()
        return Schema(s["schema"], s["schema_id"])

    def current_snapshot(self) -> dict | None:
        s = sn.current(self.state())
        return sn.describe(s) if s else None

    def snapshot_by_id(self, snapshot_id: int) -> dict | None:
        s = sn.by_id(self.state(), snapshot_id)
        return sn.describe(s) if s else None

    def snapshots(self) -> list[dict]:
        return [sn.describe(s) for s in sorted(self.state()["snapshots"], key=lambda s: s["sequence_number"])]

    def history(self) -> list[dict]:
        return self.state()["history"]

    def time_travel(self, snapshot_id: int | None = None, timestamp: int | None = None) -> dict | None:
        """A snapshot by id (which wins) or the latest at or before an epoch time in milliseconds; without either the current one; None if there is none."""
        state = self.state()
        if snapshot_id is not None:
            found = sn.by_id(state, snapshot_id)
        elif timestamp is not None:
            found = sn.at(state, timestamp)
        else:
            found = sn.current(state)
        return sn.describe(found) if found else None

    def last_batch(self, stream: str) -> int:
        """The last micro-batch of a stream that was appended; -1 if none was."""
        return self.state().get("streams", {}).get(stream, -1)

    def set_properties(self, **properties: str | None) -> None:
        """Set table properties; None removes one."""
        self._update(lambda s: s | {"properties": {k: v for k, v in (s["properties"] | properties).items() if v is not None}})

    def delete_snapshot(self, snapshot_id: int) -> bool:
        """Forget a snapshot; False if there is no such. See :func:`siltstone.table.snapshots.without` for its children and the current one."""
        if sn.by_id(self.state(), snapshot_id) is None:
            return False
        self._update(lambda s: sn.without(s, {snapshot_id}))
        return True

    def _update(self, change) -> None:
        for attempt in range(50):
            version, state = self.store.latest()
            try:
                self.store.commit(version, state, change(state) | {"last_updated_ms": max(int(time.time() * 1000), state["last_updated_ms"])})
                return
            except CommitConflict:
                time.sleep(min(2.0, 0.01 * 2 ** min(attempt, 8)))
        raise ConcurrentModificationException("lost to other writers 50 times")

    def rollback_to(self, _snapshot_id: int):
        raise NotImplementedError("a table cannot be rolled back to a snapshot")

    # ---- writing ----

    def new_transaction(self) -> Transaction:
        return Transaction(self)

    def append_records(self, records: list[dict], schema: Schema | None = None, partition_values: dict | None = None) -> bool:
        with self.new_transaction().begin() as t:
            t.append_records(records, schema, partition_values)
        return True

    def append_pandas(self, frame: pd.DataFrame, schema: Schema | None = None, partition_values: dict | None = None) -> bool:
        with self.new_transaction().begin() as t:
            t.append_pandas(frame, schema, partition_values)
        return True

    def append_df(self, df: DataFrame, **options) -> bool:
        """See :meth:`siltstone.table.transaction.Transaction.append_df`."""
        with self.new_transaction().begin() as t:
            t.append_df(df, **options)
        return True

    def append_data(self, files: list) -> bool:
        with self.new_transaction().begin() as t:
            t.append_files(files)
        return True

    # ---- reading ----

    def _snapshot(self, state: dict, snapshot_id: int | None) -> dict | None:
        if snapshot_id is None:
            return sn.current(state)
        found = sn.by_id(state, snapshot_id)
        if found is None:
            raise ValueError(f"no snapshot {snapshot_id}")
        return found

    def data_files(self, filter: dict | None = None, snapshot_id: int | None = None) -> list[tf.DataFile]:
        """The files a scan with this filter reads, after pruning by their bounds."""
        state = self.state()
        schema = Schema(state["schema"], state["schema_id"])
        expressions = parse_filter_dict(filter)
        to_column(expressions, schema)
        return sn.files_of(self.storage, self._snapshot(state, snapshot_id), wanted=lambda f: may_match(expressions, schema, f))

    def _plan(self, columns: list[str] | None, filter: dict | None, verify: bool | None, snapshot_id: int | None, default_verify: bool) -> _Plan:
        """What a scan reads, and whether checksums are to be verified."""
        state = self.state()
        schema = Schema(state["schema"], state["schema_id"])
        expressions = parse_filter_dict(filter)
        check_types(expressions, schema)
        names = schema.names if columns is None else list(columns)
        unknown = [c for c in names if c not in schema.by_name]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        filtered = {schema.by_name[e.column].id for e in expressions}
        files = sn.files_of(self.storage, self._snapshot(state, snapshot_id), filtered, lambda f: may_match(expressions, schema, f))
        if verify is None:
            verify = self.spark_conf(VERIFY_CONF, "true" if default_verify else "false").lower() == "true"
        return _Plan(schema, expressions, names, files, verify)

    def spark_conf(self, key: str, default: str) -> str:
        return self.spark.conf.get(key, default) if self.spark is not None else default

    def _spark_rows(self, plan: _Plan, place: bool) -> DataFrame:
        """The scan as a DataFrame, with ``place`` also the file path and number of each row in ``__file`` and ``__row``."""
        if any("time" in (f.type, f.type.removeprefix("list<").rstrip(">")) for f in plan.schema.fields):
            self.spark.conf.set("spark.sql.timeType.enabled", "true")
        if plan.verify:
            tf.verify(self.spark, self.storage, plan.files)
        quoted = [F.col(f"`{c}`") for c in plan.names]
        if not plan.files:
            empty = self.spark.createDataFrame([], plan.schema.struct())
            return empty.select(*quoted, *([F.lit("").alias("__file"), F.lit(0).cast("long").alias("__row")] if place else []))
        rows = self.spark.read.schema(plan.schema.struct()).parquet(*[self.storage.uri(f.path) for f in plan.files])
        condition = to_column(plan.expressions, plan.schema)
        if condition is not None:
            rows = rows.where(condition)
        return rows.select(*quoted, *([F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")] if place else []))

    def scan_df(self, columns: list[str] | None = None, filter: dict | None = None, verify_checksums: bool | None = None, snapshot_id: int | None = None) -> DataFrame:
        """The scan as a DataFrame: files pruned by their bounds here, columns and filter pushed to Parquet by Spark.

        ``snapshot_id`` reads an older snapshot. Checksums are verified only if asked for (here, or by
        the configuration ``spark.siltstone.verifyChecksums``), as that reads the pruned files once more.
        """
        return self._spark_rows(self._plan(columns, filter, verify_checksums, snapshot_id, False), False)

    def to_df(self, snapshot_id: int | None = None) -> DataFrame:
        """The whole table as a DataFrame. Filters on it reach Parquet but do not prune files by the manifests; :meth:`scan_df` does."""
        return self.scan_df(snapshot_id=snapshot_id)

    def _local_tables(self, plan: _Plan) -> Iterator[pa.Table]:
        """The rows of each file, read on the driver; a file that is verified is read once, hashed and parsed."""
        condition = to_arrow(plan.expressions, plan.schema)
        wanted = pa.schema([f for f in plan.schema.arrow() if f.name in plan.names])
        needed = list(dict.fromkeys([*plan.names, *(e.column for e in plan.expressions)]))
        for f in plan.files:
            source: pa.NativeFile | BinaryIO
            if plan.verify and f.checksum:
                try:
                    content = self.storage.read(f.path)
                except FileNotFoundError:
                    raise CorruptDataError(f"{f.path} is gone") from None
                if hashlib.sha256(content).hexdigest() != f.checksum:
                    raise CorruptDataError(f"{f.path} does not have its checksum")
                source = pa.BufferReader(content)
            else:
                source = self.storage.open(f.path)
            rows = pq.read_table(source, columns=needed, partitioning=None)
            if condition is not None:
                rows = rows.filter(condition)
            yield rows.select(plan.names).cast(pa.schema([wanted.field(n) for n in plan.names]))

    def _arrow(self, columns, filter, verify, snapshot_id) -> pa.Table:
        """The scan's rows on the driver, in the order of manifests, files and rows."""
        plan = self._plan(columns, filter, verify, snapshot_id, True)
        if plan.is_small:
            tables = list(self._local_tables(plan))
            return pa.concat_tables(tables) if tables else pa.schema([plan.schema.arrow().field(n) for n in plan.names]).empty_table()
        found = self._spark_rows(plan, True).toArrow()
        place = {_plain(self.storage.uri(f.path)): i for i, f in enumerate(plan.files)}
        paths = found["__file"].combine_chunks().dictionary_encode()
        ranks = pa.array([place[_plain(unquote(p))] for p in paths.dictionary.to_pylist()], pa.int32())
        ordered = found.append_column("__rank", pc.take(ranks, paths.indices)).sort_by([("__rank", "ascending"), ("__row", "ascending")])
        return ordered.select(plan.names)

    def scan(self, columns: list[str] | None = None, filter: dict | None = None, parallel: bool | int = False, verify_checksums: bool | None = None, snapshot_id: int | None = None) -> list[dict]:
        """The rows as dicts, in the order of manifests, files and rows.

        If the pruned files are few and small (:data:`LOCAL_FILES`, :data:`LOCAL_BYTES`) the driver, where the rows must come anyway,
        reads them itself; else Spark does, in parallel whatever ``parallel`` says.
        """
        return self._arrow(columns, filter, verify_checksums, snapshot_id).to_pylist()

    def to_pandas(self, columns: list[str] | None = None, filter: dict | None = None, parallel: bool | int = False, verify_checksums: bool | None = None, snapshot_id: int | None = None) -> pd.DataFrame:
        """The rows as a pandas frame; order and reading as in :meth:`scan`."""
        return self._arrow(columns, filter, verify_checksums, snapshot_id).to_pandas()

    def scan_batches(self, batch_size: int = 10_000, columns: list[str] | None = None, filter: dict | None = None, verify_checksums: bool | None = None) -> Iterator[list[dict]]:
        """Batches of at most ``batch_size`` dicts, none empty, none spanning files; one file or partition is on the driver at a time."""
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        plan = self._plan(columns, filter, verify_checksums, None, True)
        if plan.is_small:
            for rows in self._local_tables(plan):
                yield from (b.to_pylist() for b in rows.combine_chunks().to_batches(max_chunksize=batch_size) if b.num_rows)
            return
        batch, file = [], None
        for r in self._spark_rows(plan, True).toLocalIterator(prefetchPartitions=True):
            if batch and (len(batch) >= batch_size or r["__file"] != file):
                yield batch
                batch = []
            file = r["__file"]
            batch.append({n: r[n] for n in plan.names})
        if batch:
            yield batch

    def iter_records(self, columns: list[str] | None = None, filter: dict | None = None, verify_checksums: bool | None = None) -> Iterator[dict]:
        for batch in self.scan_batches(1000, columns, filter, verify_checksums):
            yield from batch

    def iter_pandas(self, chunksize: int = 50_000, columns: list[str] | None = None, filter: dict | None = None, verify_checksums: bool | None = None) -> Iterator[pd.DataFrame]:
        for batch in self.scan_batches(chunksize, columns, filter, verify_checksums):
            yield pd.DataFrame(batch)

    def row_count(self, snapshot_id: int | None = None) -> int:
        """The number of rows by the manifests; no data is read."""
        state = self.state()
        return sum(f.record_count for f in sn.files_of(self.storage, self._snapshot(state, snapshot_id), set()))

    # ---- metadata as DataFrames ----

    def files_df(self, snapshot_id: int | None = None) -> DataFrame:
        """The entries of a snapshot's manifests, read by Spark."""
        manifests = sn.manifests_of(self.storage, self._snapshot(self.state(), snapshot_id))
        kind = "path string, format string, partition_values map<string,string>, record_count long, size long, lower map<string,string>, upper map<string,string>, null_counts map<string,long>, value_counts map<string,long>, checksum string, status int, snapshot_id long, sequence_number long, file_sequence_number long"
        if not manifests:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[self.storage.uri(m["path"]) for m in manifests])

    def snapshots_df(self) -> DataFrame:
        rows = [(s["snapshot_id"], s["parent_snapshot_id"], s["timestamp_ms"], s["operation"], s["sequence_number"], s["schema_id"]) for s in self.state()["snapshots"]]
        return self.spark.createDataFrame(rows, "snapshot_id long, parent_snapshot_id long, timestamp_ms long, operation string, sequence_number long, schema_id int")

    def history_df(self) -> DataFrame:
        return self.spark.createDataFrame([(h["timestamp_ms"], h["snapshot_id"]) for h in self.state()["history"]], "timestamp_ms long, snapshot_id long")

    # ---- maintenance ----

    def garbage_collect(self, grace_period_ms: int = 3_600_000) -> dict:
        return maintenance.garbage_collect(self, grace_period_ms)

    def verify_integrity(self, snapshot_id: int | None = None) -> dict:
        """Whether the files of a snapshot are there with their checksums; never raises for a bad file."""
        return tf.integrity_report(self.spark, self.storage, sn.files_of(self.storage, self._snapshot(self.state(), snapshot_id), set()))

    def cleanup_orphaned_files(self):
        raise NotImplementedError("use garbage_collect")

    def compact(self, target_rows: int = 1_000_000, cluster_by: list[str] | None = None) -> bool:
        """Rewrite the current files as fewer ones of about ``target_rows`` rows in one transaction; False if there is nothing to gain."""
        files = self.data_files()
        wanted = max(1, -(-sum(f.record_count for f in files) // target_rows))
        if len(files) <= wanted:
            return False
        with self.new_transaction().begin() as t:
            t.append_df(self.scan_df(), cluster_by=cluster_by, files=wanted)
            t.delete_files([f.path for f in files])
        return True


def _plain(uri: str) -> str:
    """The path of a URI, without scheme and host."""
    return "/" + re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", uri).lstrip("/")


def create_table(spark: SparkSession, path: str, schema: Schema | None = None, partition_spec: PartitionSpec | None = None, properties: dict | None = None) -> Table:
    """Create a table, or open the one that is there, whose schema then holds; safe against others doing the same."""
    table = Table(spark, path)
    try:
        table.store.initialize(schema or Schema(), partition_spec, properties)
    except TableExistsError:
        table.store.latest()
    return table


def load_table(spark: SparkSession, path: str) -> Table:
    """Open a table; ``ValueError`` if there is none."""
    table = Table(spark, path)
    table.store.latest()
    return table
