"""Queries that go through the rest of the table interface: driver-side scans, single files, transactions, history, maintenance, storage.

Where an operation gives facts instead of rows, the query gives these facts in one row.
"""

from __future__ import annotations

import logging
import os
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.table_queries import _fresh, _source, _three_snapshots, table
from siltstone.session import local_path, new_path
from siltstone.sources import datafiles
from siltstone.table import AmbiguousCommitError, CommitConflict, ConcurrentModificationException, CorruptDataError, DataFile, Field, GarbageCollectionAborted, Schema, Table, TableExistsError, TransactionManager, create_table, load_table
from siltstone.table import files as tf
from siltstone.table.log import CommitLog
from siltstone.table.storage import HadoopStorage, LocalStorage, open_storage, safe_join

_SUPPLIER = ["s_suppkey", "s_name", "s_acctbal"]
_SUPPLIER_KIND = "s_suppkey long, s_name string, s_acctbal double"


def _facts(spark: SparkSession, **facts: bool | int | str) -> DataFrame:
    kind = {bool: "boolean", int: "long", str: "string"}
    return spark.range(1).select(*[F.lit(v).cast(kind[type(v)]).alias(k) for k, v in facts.items()])


def _raises(error: type[Exception], call, *args, **kwargs) -> bool:
    try:
        call(*args, **kwargs)
    except error:
        return True
    return False


def _path(spark: SparkSession, label: str) -> str:
    return local_path(new_path(spark, label))


# ---- scans whose rows come to the driver ----


def scan_dicts(spark, folder):
    return spark.createDataFrame(table(spark, folder, "supplier").scan(_SUPPLIER, {"s_acctbal": (">", 0.0)}), _SUPPLIER_KIND)


def scan_parallel_verified(spark, folder):
    return spark.createDataFrame(table(spark, folder, "supplier").scan(_SUPPLIER, parallel=4, verify_checksums=True), _SUPPLIER_KIND)


def scan_pandas(spark, folder):
    return spark.createDataFrame(table(spark, folder, "supplier").to_pandas(_SUPPLIER, {"s_nationkey": ("in", [1, 2, 3, 4])}), _SUPPLIER_KIND)


def scan_records_one_by_one(spark, folder):
    return spark.createDataFrame(list(table(spark, folder, "supplier").iter_records(_SUPPLIER)), _SUPPLIER_KIND)


def scan_pandas_chunks(spark, folder):
    chunks = list(table(spark, folder, "supplier").iter_pandas(37, _SUPPLIER))
    return spark.createDataFrame(pd.concat(chunks), _SUPPLIER_KIND).withColumn("within", F.lit(max(map(len, chunks)) <= 37))


def batches_keep_to_files(spark, folder):
    """Rows per file by the batches, which never span files, and by the manifests."""
    t = _fresh(spark, _source(spark, folder, "supplier"), "batches")
    t.append_df(_source(spark, folder, "supplier"), files=3, checksum=True)
    t.append_df(_source(spark, folder, "supplier"), files=1, checksum=True)
    wanted = [f.record_count for f in t.data_files()]
    got, at = [0] * len(wanted), 0
    for batch in t.scan_batches(7):
        while got[at] == wanted[at]:
            at += 1
        got[at] += len(batch)
    return _facts(spark, same=got == wanted, rows=sum(got))


# ---- single files ----


def datafile_reading(spark, folder):
    """Each data file read by itself, in all ways a reader has."""
    t = table(spark, folder, "supplier")
    rows = []
    for i, f in enumerate(t.data_files()):
        path = os.path.join(t.root, f.path)
        with datafiles.DataFileReader(path) as r:
            batches = pa.Table.from_batches(list(r.read_batches(50, _SUPPLIER)), r.read_columns(_SUPPLIER).schema)
            same = batches.equals(r.read_columns(_SUPPLIER)) and r.read_all().num_rows == r.df(spark, _SUPPLIER).count() == len(r.read_pandas()) == sum(map(len, r.read_batches_pandas(50)))
        rows += datafiles.read_data_file(path, _SUPPLIER) if i % 2 else datafiles.read_pandas_file(path, _SUPPLIER).to_dict("records")
    return spark.createDataFrame(rows, _SUPPLIER_KIND).withColumn("same", F.lit(same))


def datafile_writing(spark, folder):
    """Files written from records, a pandas frame, a DataFrame and in pieces, then adopted with their bounds."""
    df = _source(spark, folder, "nation")
    t = _fresh(spark, df, "written")
    frame, schema = df.toPandas(), t.schema
    entries = [
        datafiles.write_data_file(spark, t.root, "data/records.parquet", frame.to_dict("records"), schema), datafiles.write_data_file(spark, t.root, "data/frame.parquet", frame, schema), datafiles.write_data_file(spark, t.root, "data/df.parquet", df, schema, {"part": "x"}),
    ]
    with datafiles.DataFileWriter(os.path.join(t.root, "data", "pieces.parquet"), schema) as w:
        w.write_records(frame.to_dict("records")[:10])
        w.write_pandas(frame.iloc[10:])
    t.append_data([*entries, "data/pieces.parquet"])
    datafiles.check_files(t.root, t.data_files())
    return t.to_df()


def datafile_checks(spark, folder):
    schema = Schema([Field(1, "id", "long", True), Field(2, "name", "string")])
    good, bad = [{"id": 1, "name": "x"}], [{"name": "x"}]
    return _facts(
        spark, missing=_raises(FileNotFoundError, datafiles.check_files, _path(spark, "none"), [DataFile("data/none.parquet", 1, 1)]), fits=datafiles.is_compatible(good, schema) and datafiles.is_pandas_compatible(pd.DataFrame(good), schema),
        misfits=not datafiles.is_compatible(bad, schema) and not datafiles.is_pandas_compatible(pd.DataFrame({"id": ["a"], "name": ["b"]}), schema), other_format=_raises(ValueError, datafiles.DataFileReader, "x", "avro"),
    )


# ---- writing tables ----


def append_by_records(spark, folder):
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "records")
    t.append_records([r.asDict() for r in df.collect()])
    return load_table(spark, t.root).to_df()


def append_by_pandas(spark, folder):
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "pandas")
    t.append_pandas(df.toPandas())
    t.append_pandas(df.toPandas())
    return t.to_df()


def transaction_rollback(spark, folder):
    """A transaction rolled back leaves neither rows nor files; one that raises neither."""
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "rolled")
    tx = t.new_transaction().begin()
    tx.append_df(df)
    rolled = tx.rollback() and not tx.rollback()

    def raising():
        with t.new_transaction().begin() as inner:
            inner.append_df(df)
            raise KeyError("stop")

    raised = _raises(KeyError, raising)
    names = [n for _, _, files in os.walk(os.path.join(t.root, "data")) for n in files] + os.listdir(os.path.join(t.root, "_inflight"))
    return _facts(spark, rolled=rolled, raised=raised, rows=t.row_count(), files=len(names))


def transaction_manager(spark, folder):
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "managed")
    manager = TransactionManager(t)
    first, second = manager.begin(), manager.begin()
    first.append_df(df)
    second.append_df(df)
    first.commit()
    return _facts(spark, open_before=len(manager.active()), cleaned=manager.cleanup(), open_after=len(manager.active()), rows=t.row_count())


def markers_protect(spark, folder):
    """Collection beside an open transaction keeps its files."""
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "marked")
    tx = t.new_transaction().begin()
    tx.append_df(df)
    deleted = t.garbage_collect(0)["data_files"]
    tx.commit()
    return t.to_df().withColumn("deleted", F.lit(deleted).cast("long"))


def concurrent_appends(spark, folder):
    """Two transactions from one base both count; a commit on an old base fails."""
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "both")
    version, state = t.store.latest()
    a, b = t.new_transaction().begin(), t.new_transaction().begin()
    a.append_df(df)
    b.append_df(df)
    a.commit()
    b.commit()
    stale = _raises(ConcurrentModificationException, t.store.commit, version, state, state)
    return _facts(spark, stale=stale, rows=t.row_count(), snapshots=len(t.snapshots()))


def create_and_open(spark, folder):
    schema = Schema.of(_source(spark, folder, "region").schema)
    path = _path(spark, "created")
    t = create_table(spark, path, schema)
    again = create_table(spark, path, Schema([Field(1, "other", "long")]))
    return _facts(spark, kept=again.schema.names == schema.names, exists=_raises(TableExistsError, t.store.initialize, schema), absent=_raises(ValueError, load_table, spark, path + "-none"), columns=len(load_table(spark, path).schema.fields))


def operations_refused(spark, folder):
    t = _fresh(spark, _source(spark, folder, "region"), "refused")
    tx = t.new_transaction().begin()
    calls = (lambda: t.rollback_to(1), lambda: tx.overwrite_by_filter({}), t.cleanup_orphaned_files)
    return _facts(spark, refused=sum(_raises(NotImplementedError, c) for c in calls))


# ---- snapshots ----


def _dated(spark, folder) -> tuple[Table, list[dict]]:
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "dated")
    for _ in range(3):
        t.append_df(df)
        time.sleep(0.005)
    return t, t.snapshots()


def time_travel_by_time(spark, folder):
    """The table as of the time of its second snapshot; before the first there is none."""
    t, found = _dated(spark, folder)
    then = t.time_travel(timestamp=found[1]["timestamp_ms"])
    before = t.time_travel(timestamp=found[0]["timestamp_ms"] - 1)
    same = then["snapshot_id"] == t.time_travel(snapshot_id=found[1]["snapshot_id"])["snapshot_id"]
    return t.scan_df(snapshot_id=then["snapshot_id"]).withColumn("ok", F.lit(before is None and same))


def snapshot_history(spark, folder):
    """History, lineage after the middle snapshot is deleted, and its children's new parent."""
    t, found = _dated(spark, folder)
    deleted = t.delete_snapshot(found[1]["snapshot_id"]) and not t.delete_snapshot(found[1]["snapshot_id"])
    left = t.snapshots()
    return _facts(spark, deleted=deleted, history=len(t.history()), reparented=left[1]["parent_id"] == found[0]["snapshot_id"], in_history=t.history_df().count(), rows=t.row_count())


def retention_by_properties(spark, folder):
    """Two snapshots and three versions are kept of six appends; the rows all stay."""
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "retained")
    t.set_properties(**{"history.keep-snapshots": 2, "log.keep-versions": 3})
    for _ in range(6):
        t.append_df(df)
    return _facts(spark, snapshots=len(t.snapshots()), versions=len(t.store.log.versions()), logged=len(t.state()["metadata_log"]), rows=t.row_count())


def distinct_files_of_manifests(spark, folder):
    """Files that several manifests list count once."""
    t, _ = _dated(spark, folder)
    with t.new_transaction().begin() as tx:
        tx.append_files([f.path for f in t.data_files()])
    return _facts(spark, listed=t.files_df().count() > t.files_df().select("path").distinct().count(), rows=t.row_count(), read=t.to_df().count())


# ---- integrity ----


def damage_is_seen(spark, folder):
    """One file altered, one removed: what the report and verified scans say."""
    df = _source(spark, folder, "supplier")
    t = _fresh(spark, df, "damaged")
    t.append_df(df, files=3)
    first, second = (os.path.join(t.root, f.path) for f in t.data_files()[:2])
    with open(first, "r+b") as f:
        f.seek(8)
        byte = f.read(1)
        f.seek(8)
        f.write(bytes([byte[0] ^ 255]))
    os.unlink(second)
    report = t.verify_integrity()
    return _facts(spark, files=report["total_files"], there=report["existing_files"], missing=len(report["missing_files"]), altered=len(report["checksum_mismatches"]), scan_raises=_raises(CorruptDataError, t.scan), df_raises=_raises(CorruptDataError, t.scan_df, verify_checksums=True))


def collection_fails_closed(spark, folder):
    """With a manifest gone nothing is deleted."""
    t = _three_snapshots(spark, folder)
    orphan = os.path.join(t.root, "data", "orphan.parquet")
    with open(orphan, "wb") as f:
        f.write(b"x")
    os.unlink(os.path.join(t.root, "_manifests", next(n for n in os.listdir(os.path.join(t.root, "_manifests")) if n.endswith(".parquet"))))
    return _facts(spark, aborted=_raises(GarbageCollectionAborted, t.garbage_collect, 0), kept=os.path.exists(orphan))


def bounds_as_text(spark, folder):
    """Bounds of a file come back from their text as they were."""
    t = table(spark, folder, "events")
    bounds = [v for f in t.data_files() for side in (f.lower, f.upper) for v in side.values()]
    return _facts(spark, same=all(tf.decode_bound(tf.encode_bound(v)) == v for v in bounds), some=len(bounds) > 0)


def log_recovery(spark, folder):
    """The newest version is what the log's folder lists; leftovers of torn writes do not count, a taken version is a conflict, a broken one an error."""
    t = _three_snapshots(spark, folder)
    log = t.store.log
    version, state = log.latest()
    with open(os.path.join(log.folder, ".torn.tmp"), "w") as f:
        f.write("{")
    same = load_table(spark, t.root).state() == state
    taken = _raises(CommitConflict, log.publish, version, {})
    with open(os.path.join(log.folder, f"{version + 1:020d}.json"), "w") as f:
        f.write("{")
    return _facts(spark, same=same, taken=taken, broken=_raises(ValueError, t.state))


def commit_of_unknown_outcome(spark, folder):
    """If a commit's outcome can't be told, its files stay."""
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "unknown")
    tx = t.new_transaction().begin()
    tx.append_df(df)

    def lost(*_args):
        raise AmbiguousCommitError("the answer was lost")

    t.store.commit = lost
    raised = _raises(AmbiguousCommitError, tx.commit)
    files = [n for _, _, names in os.walk(os.path.join(t.root, "data")) for n in names]
    return _facts(spark, raised=raised, files_stay=len(files) > 0)


# ---- storage ----


def storage_operations(spark, folder):
    """The same operations on a local folder and through the JVM's file systems."""
    done = []
    for make in (LocalStorage, lambda p: HadoopStorage(spark, f"file://{p}")):
        s = make(_path(spark, "storage"))
        s.write("a/b", b"12345")
        s.write("a/b", b"123456")
        s.create("a/c", b"")
        with s.open("a/b") as f:
            f.seek(2)
            ranged = f.read(2) == b"34" == s.read("a/b", 2, 2)
        log = CommitLog(s)
        log.publish(0, {"n": 1})
        done.append(s.list("a") == ["a/b", "a/c"] and ranged and _raises(CommitConflict, s.create, "a/c", b"x") and _raises(CommitConflict, log.publish, 0, {}) and s.delete("a/b") and not s.exists("a/b") and _raises(ValueError, s.read, "../x"))
    return _facts(spark, local=done[0], hadoop=done[1], chosen=isinstance(open_storage("/x"), LocalStorage), sandbox=_raises(ValueError, safe_join, "/tmp/x", "../y"))


def failures_are_logged(spark, folder):
    """What cannot be cleaned up after a commit is logged, and does not fail the commit."""
    said: list[str] = []
    handler = logging.Handler()
    handler.emit = lambda record: said.append(record.getMessage())
    logging.getLogger("siltstone").addHandler(handler)
    try:
        df = _source(spark, folder, "region")
        t = _fresh(spark, df, "logged")
        tx = t.new_transaction().begin()
        tx.append_df(df)
        delete = t.storage.delete

        def stuck(path):
            if path.startswith("_inflight/"):
                raise OSError("stuck")
            return delete(path)

        t.storage.delete = stuck
        tx.commit()
        return _facts(spark, rows=t.row_count(), logged=any("stuck" in s for s in said))
    finally:
        logging.getLogger("siltstone").removeHandler(handler)


QUERIES = {
    f.__name__: f
    for f in (
        scan_dicts, scan_parallel_verified, scan_pandas, scan_records_one_by_one, scan_pandas_chunks, batches_keep_to_files, datafile_reading, datafile_writing, datafile_checks, append_by_records, append_by_pandas, transaction_rollback, transaction_manager, markers_protect,
        concurrent_appends, create_and_open, operations_refused, time_travel_by_time, snapshot_history, retention_by_properties, distinct_files_of_manifests, damage_is_seen, collection_fails_closed, bounds_as_text, log_recovery, commit_of_unknown_outcome, storage_operations,
        failures_are_logged,
    )
}

_S = "SELECT s_suppkey, s_name, s_acctbal FROM supplier"
SQL = {
    "scan_dicts": _S + " WHERE s_acctbal > 0",
    "scan_parallel_verified": _S,
    "scan_pandas": _S + " WHERE s_nationkey IN (1, 2, 3, 4)",
    "scan_records_one_by_one": _S,
    "scan_pandas_chunks": "SELECT s_suppkey, s_name, s_acctbal, true AS within FROM supplier",
    "batches_keep_to_files": "SELECT true AS same, 2 * count(*) AS rows FROM supplier",
    "datafile_reading": "SELECT s_suppkey, s_name, s_acctbal, true AS same FROM supplier",
    "datafile_writing": " UNION ALL ".join(["SELECT * FROM nation"] * 4),
    "datafile_checks": "SELECT true AS missing, true AS fits, true AS misfits, true AS other_format",
    "append_by_records": "SELECT * FROM region",
    "append_by_pandas": "SELECT * FROM region UNION ALL SELECT * FROM region",
    "transaction_rollback": "SELECT true AS rolled, true AS raised, 0::bigint AS rows, 0::bigint AS files",
    "transaction_manager": "SELECT 1::bigint AS open_before, 1::bigint AS cleaned, 0::bigint AS open_after, count(*) AS rows FROM region",
    "markers_protect": "SELECT *, 0::bigint AS deleted FROM region",
    "concurrent_appends": "SELECT true AS stale, 2 * count(*) AS rows, 2::bigint AS snapshots FROM region",
    "create_and_open": "SELECT true AS kept, true AS exists, true AS absent, count(*) AS columns FROM (DESCRIBE region)",
    "operations_refused": "SELECT 3::bigint AS refused",
    "time_travel_by_time": "SELECT *, true AS ok FROM (SELECT * FROM region UNION ALL SELECT * FROM region)",
    "snapshot_history": "SELECT true AS deleted, 2::bigint AS history, true AS reparented, 2::bigint AS in_history, 3 * count(*) AS rows FROM region",
    "retention_by_properties": "SELECT 2::bigint AS snapshots, 3::bigint AS versions, 3::bigint AS logged, 6 * count(*) AS rows FROM region",
    "distinct_files_of_manifests": "SELECT true AS listed, 3 * count(*) AS rows, 3 * count(*) AS read FROM region",
    "damage_is_seen": "SELECT 3::bigint AS files, 2::bigint AS there, 1::bigint AS missing, 1::bigint AS altered, true AS scan_raises, true AS df_raises",
    "collection_fails_closed": "SELECT true AS aborted, true AS kept",
    "bounds_as_text": "SELECT true AS same, true AS some",
    "log_recovery": "SELECT true AS same, true AS taken, true AS broken",
    "commit_of_unknown_outcome": "SELECT true AS raised, true AS files_stay",
    "storage_operations": "SELECT true AS local, true AS hadoop, true AS chosen, true AS sandbox",
    "failures_are_logged": "SELECT count(*) AS rows, true AS logged FROM region",
}
