"""Tables: schemas, appends, transactions, snapshots, concurrency, checksums, collection."""

import datetime as dt
import json
import math
import multiprocessing
import os
import threading
import time

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from siltstone.table import ConcurrentModificationException, CorruptDataError, DataFile, Field, GarbageCollectionAborted, Schema, TableExistsError, TransactionManager, create_table, load_table
from siltstone.table import files as tf

PEOPLE = Schema([Field(1, "id", "long", True), Field(2, "name", "string"), Field(3, "age", "int"), Field(4, "score", "double")])
ROWS = [{"id": 1, "name": "Wren", "age": 41, "score": 12.25}, {"id": 2, "name": "Tarn", "age": 36, "score": 7.5}, {"id": 3, "name": None, "age": 46, "score": 9.75}]


@pytest.fixture(autouse=True, params=["driver", "spark"])
def reader(request, monkeypatch):
    """Scans run once read by the driver and once by Spark."""
    if request.param == "spark":
        monkeypatch.setattr("siltstone.table.table.LOCAL_FILES", -1)


@pytest.fixture
def table(spark, tmp_path):
    return create_table(spark, str(tmp_path / "t"), PEOPLE)


# ---- schema and rows ----


@pytest.mark.parametrize("fields", [[{"id": 1, "name": "a", "type": "super_int"}], [{"name": "a", "type": "int"}], [{"id": 1, "type": "int"}], [{"id": 1, "name": "a"}], [{"id": 1, "name": "a", "type": "int"}, {"id": 1, "name": "b", "type": "int"}], [{"id": 1, "name": "a", "type": "int"}, {"id": 2, "name": "a", "type": "int"}]])
def test_bad_schemas(fields):
    with pytest.raises(ValueError):
        Schema(fields)


def test_every_type(spark, tmp_path):
    kinds = ["boolean", "int", "long", "float", "double", "date", "time", "timestamp", "string", "uuid", "binary", "fixed", "list<long>"]
    t = create_table(spark, str(tmp_path), Schema([Field(i + 1, f"c{i}", k) for i, k in enumerate(kinds)]))
    row = dict(zip([f"c{i}" for i in range(13)], [True, 1, 2, 0.5, 0.25, dt.date(2024, 1, 2), dt.time(1, 2, 3), dt.datetime(2024, 1, 2, 3), "s", "u", b"b", b"f", [1, 2]], strict=True))
    t.append_records([row, {}])
    assert t.scan() == [row, dict.fromkeys(row)]


@pytest.mark.parametrize("record", [{"id": 1, "extra": 2}, {"name": "x"}, {"id": None}, {"id": "1"}, {"id": 1.5}, {"id": 1, "age": 2**40}, {"id": 1, "name": 5}])
def test_bad_records_leave_the_table_alone(table, record):
    with pytest.raises(ValueError):
        table.append_records([record])
    assert table.snapshots() == [] and table.scan() == []


def test_missing_optional_is_null_and_int_fits_double(table):
    table.append_records([{"id": 1, "score": 3}])
    assert table.scan() == [{"id": 1, "name": None, "age": None, "score": 3.0}]


def test_schema_is_kept_and_wanted(spark, tmp_path):
    bare = create_table(spark, str(tmp_path / "bare"))
    with pytest.raises(ValueError):
        bare.append_records([{"id": 1}])
    t = create_table(spark, str(tmp_path / "t"), PEOPLE)
    assert load_table(spark, t.root).schema == PEOPLE
    assert create_table(spark, t.root, Schema([Field(1, "other", "int")])).schema == PEOPLE
    with pytest.raises(ValueError):
        t.append_records([{"id": 1}], Schema([Field(1, "id", "int", True)]))
    with pytest.raises(TableExistsError):
        t.store.initialize(PEOPLE)
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "none"))


def test_empty_table(table):
    assert table.scan() == [] and len(table.to_pandas()) == 0 and list(table.scan_batches()) == [] and table.row_count() == 0
    assert table.to_df().columns == PEOPLE.names and table.current_snapshot() is None
    table.append_records([])
    assert table.scan() == [] and len(table.snapshots()) == 1


def test_pandas_round_trip(table):
    table.append_pandas(pd.DataFrame({"id": [1, 2], "name": ["a", None], "age": [3, 4], "score": [1.5, math.nan]}))
    rows = table.scan()
    assert rows[0] == {"id": 1, "name": "a", "age": 3, "score": 1.5} and rows[1]["name"] is None and math.isnan(rows[1]["score"])
    assert [len(f) for f in table.iter_pandas(1)] == [1, 1]


def test_dataframes(spark, table):
    df = spark.createDataFrame([(4, "d", 1, 0.5), (5, None, 2, 0.25)], "id long, name string, age int, score double")
    table.append_df(df.select("score", "age", "name", "id"), cluster_by=["id"], files=2)
    assert {r["id"] for r in table.scan()} == {4, 5}
    with pytest.raises(ValueError):
        table.append_df(df.withColumn("age", df.age.cast("long")))
    with pytest.raises(ValueError):
        table.append_df(df.withColumn("more", df.age))
    with pytest.raises(Exception, match="required column"):
        table.append_df(spark.createDataFrame([(None, "x", 1, 0.5)], "id long, name string, age int, score double"))
    assert table.row_count() == 2
    assert not [f for _, _, names in os.walk(os.path.join(table.root, "_inflight")) for f in names]


def test_order_and_projection(table):
    for r in ROWS:
        table.append_records([r])
    assert [r["id"] for r in table.scan()] == [1, 2, 3]
    assert table.scan(["age"], {"name": "Tarn"}) == [{"age": 36}]
    assert table.to_pandas(["id"])["id"].tolist() == [1, 2, 3]
    assert all(len(b) == 1 for b in table.scan_batches(10))


# ---- transactions and snapshots ----


def test_lineage(table):
    for r in ROWS:
        table.append_records([r])
    found = table.snapshots()
    assert [s["sequence_number"] for s in found] == [1, 2, 3] and [s["parent_id"] for s in found] == [-1, found[0]["snapshot_id"], found[1]["snapshot_id"]]
    assert [f.snapshot_id for f in table.data_files()] == [s["snapshot_id"] for s in found]
    gone = table.data_files()[1].path
    with table.new_transaction() as t:
        t.delete_files(["/" + gone])
    assert [f.sequence_number for f in table.data_files()] == [1, 3] and table.snapshots()[-1]["operation"] == "delete"
    assert [r["id"] for r in table.scan()] == [1, 3]
    before = len(table.snapshots())
    with table.new_transaction() as t:
        t.delete_files(["data/none.parquet"])
    assert len(table.snapshots()) == before
    keep = table.data_files()[1].path
    with table.new_transaction() as t:
        t.delete_files([keep])
    assert [f.status for f in table.data_files()] == [tf.ADDED]


def test_empty_and_reused_transactions(table):
    t = table.new_transaction().begin()
    assert t.commit() and table.snapshots() == []
    t.begin().append_records(ROWS[:1])
    t.commit()
    t.begin()
    assert t.commit() and table.row_count() == 1
    with pytest.raises(RuntimeError):
        t.append_records(ROWS)
    assert t.rollback() is False


def test_exception_rolls_back(table):
    with pytest.raises(KeyError), table.new_transaction() as t:
        t.append_records(ROWS)
        raise KeyError
    assert table.snapshots() == [] and not [n for _, _, names in os.walk(os.path.join(table.root, "data")) for n in names]


def test_transaction_manager(table):
    m = TransactionManager(table)
    m.begin(), m.begin()
    assert len(m.active()) == 2 and m.cleanup() == 2 and m.active() == []


def test_stale_base(table):
    version, state = table.store.latest()
    table.append_records(ROWS[:1])
    with pytest.raises(ConcurrentModificationException):
        table.store.commit(version, state, state)


def test_time_travel(table):
    for r in ROWS:
        table.append_records([r])
        time.sleep(0.005)
    a, b, c = table.snapshots()
    assert table.time_travel(snapshot_id=a["snapshot_id"], timestamp=c["timestamp_ms"])["snapshot_id"] == a["snapshot_id"]
    assert table.time_travel(timestamp=b["timestamp_ms"])["snapshot_id"] == b["snapshot_id"]
    assert table.time_travel(timestamp=0) is None and table.time_travel(snapshot_id=5) is None
    assert table.time_travel()["snapshot_id"] == c["snapshot_id"]
    assert [r["id"] for r in table.scan(snapshot_id=b["snapshot_id"])] == [1, 2] and table.row_count(a["snapshot_id"]) == 1


def test_expiry_and_deletion(table):
    for r in ROWS:
        table.append_records([r])
    a, b, c = table.snapshots()
    assert table.delete_snapshot(b["snapshot_id"]) and not table.delete_snapshot(b["snapshot_id"])
    assert table.snapshots()[-1]["parent_id"] == a["snapshot_id"]
    assert table.delete_snapshot(c["snapshot_id"]) and table.current_snapshot()["snapshot_id"] == a["snapshot_id"] and table.row_count() == 1
    table.append_records(ROWS[1:])
    with table.new_transaction() as t:
        t.expire_snapshots(0)
        t.expire_snapshots(int(time.time() * 1000) + 10_000)
    assert len(table.snapshots()) == 1 and table.snapshots()[0]["parent_id"] == -1 and len(table.scan()) == 3
    assert table.delete_snapshot(table.current_snapshot()["snapshot_id"]) and table.current_snapshot() is None and table.scan() == []


def test_retention_and_versions(table):
    table.set_properties(**{"history.keep-snapshots": 2, "log.keep-versions": 3})
    for r in ROWS * 2:
        table.append_records([r])
    assert len(table.snapshots()) == 2 and len(table.state()["metadata_log"]) == 3 and table.row_count() == 6


def test_dangling_current(table):
    table.append_records(ROWS)
    version, state = table.store.latest()
    table.store.commit(version, state, state | {"current_snapshot_id": 12345})
    for call in (table.scan, lambda: table.append_records(ROWS), table.row_count):
        with pytest.raises(RuntimeError):
            call()


def test_unreadable_base_aborts(table):
    table.append_records(ROWS)
    path = os.path.join(table.root, table.state()["snapshots"][0]["manifest_list"])
    os.rename(path, path + ".away")
    with pytest.raises(FileNotFoundError):
        table.append_records(ROWS)
    assert len(table.state()["snapshots"]) == 1
    os.rename(path + ".away", path)
    assert table.row_count() == 3


def test_a_batch_replayed_after_expiry_is_not_appended_again(spark, table):
    from siltstone.streaming.ingest import append_batch

    df = spark.createDataFrame([(1, "a", 1, 0.5)], "id long, name string, age int, score double")
    assert append_batch(table, df, "q", 0)
    table.append_records([{"id": 2}])
    with table.new_transaction().begin() as t:
        t.expire_snapshots(2**60)
    assert not append_batch(table, df, "q", 0) and table.row_count() == 2
    late = table.new_transaction().begin()
    late.append_df(df).once("q", 1)
    assert append_batch(table, df, "q", 1)
    assert not late.commit() and not late.published and table.row_count() == 3
    assert table.garbage_collect(0)["data_files"] == 0  # the transaction that came second has removed its files


def test_failure_after_publishing_keeps_data(table, monkeypatch):
    monkeypatch.setattr("siltstone.table.transaction._remove", lambda path: None)
    table.append_records(ROWS)
    assert table.row_count() == 3


def test_torn_version_is_not_seen(table):
    with open(os.path.join(table.root, "_log", ".x.tmp"), "w") as f:
        f.write('{"half')
    table.append_records(ROWS)
    assert table.row_count() == 3


def test_not_implemented(table):
    with pytest.raises(NotImplementedError):
        table.rollback_to(1)
    with pytest.raises(NotImplementedError):
        table.cleanup_orphaned_files()
    with pytest.raises(NotImplementedError):
        table.new_transaction().overwrite_by_filter(None)


# ---- concurrency ----


def test_threads_lose_nothing(table):
    def work(n):
        for i in range(3):
            table.append_records([{"id": 100 * n + i}])

    threads = [threading.Thread(target=work, args=(n,)) for n in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["id"] for r in table.scan()) == sorted(100 * n + i for n in range(8) for i in range(3))
    assert [s["sequence_number"] for s in table.snapshots()] == list(range(1, 25))


def _process(root, n):
    t = load_table(None, root)
    for i in range(4):
        t.append_records([{"id": 100 * n + i}])


def test_processes_lose_nothing(table):
    context = multiprocessing.get_context("spawn")
    workers = [context.Process(target=_process, args=(table.root, n)) for n in range(8)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    assert all(w.exitcode == 0 for w in workers)
    assert sorted(r["id"] for r in table.scan()) == sorted(100 * n + i for n in range(8) for i in range(4))


# ---- files ----


def test_adoption(table):
    folder = os.path.join(table.root, "data", "mine")
    os.makedirs(folder)
    good = pa.table({"id": [1], "name": ["x"], "age": pa.array([2], pa.int32()), "score": [0.5]})
    pq.write_table(good, f"{folder}/good.parquet", compression="snappy")
    pq.write_table(good.select(["name", "id", "age", "score"]), f"{folder}/order.parquet")
    pq.write_table(good.rename_columns(["id", "name", "age", "wrong"]), f"{folder}/wrong.parquet")
    pq.write_table(good, f"{folder}/lz4.parquet", compression="lz4")
    with open(f"{folder}/junk.parquet", "w") as f:
        f.write("junk")
    for bad in ("order", "wrong", "lz4", "junk"):
        with pytest.raises(ValueError):
            table.append_data([f"data/mine/{bad}.parquet"])
    with pytest.raises(FileNotFoundError):
        table.append_data(["data/mine/none.parquet"])
    with pytest.raises(ValueError):
        table.append_data([DataFile("data/mine/good.parquet", 1, 1, format="orc")])
    with pytest.raises(ValueError, match="traversal"):
        table.append_data(["../outside.parquet"])
    table.append_data([f"{folder}/good.parquet"])
    assert table.scan() == [{"id": 1, "name": "x", "age": 2, "score": 0.5}]


def test_checksums(spark, table):
    table.append_records(ROWS)
    path = os.path.join(table.root, table.data_files()[0].path)
    content = bytearray(open(path, "rb").read())
    content[10] ^= 0xFF
    open(path, "wb").write(content)
    with pytest.raises(CorruptDataError):
        table.scan()
    report = table.verify_integrity()
    assert report["checksum_mismatches"] and report["existing_files"] == 1
    spark.conf.set("spark.siltstone.verifyChecksums", "false")
    try:
        table.scan_df().schema  # the file is not looked at
        with pytest.raises(CorruptDataError):
            table.scan(verify_checksums=True)
    finally:
        spark.conf.unset("spark.siltstone.verifyChecksums")
    os.unlink(path)
    assert table.verify_integrity()["missing_files"]


def test_bounds_codec_and_statistics(table):
    for v in (True, 5, -1.5, "ä\"x", dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.date(2024, 1, 2), dt.time(1, 2)):
        assert tf.decode_bound(tf.encode_bound(v)) == v and type(tf.decode_bound(tf.encode_bound(v))) is type(v)
    table.append_records([{"id": 10, "score": 1.0}, {"id": 50, "score": math.nan}, {"id": 30}])
    f = table.data_files()[0]
    assert (f.lower[1], f.upper[1], f.null_counts[2], f.record_count) == (10, 50, 3, 3)
    assert table.files_df().count() == 1 and table.snapshots_df().count() == 1 and table.history_df().count() == 1


def test_compaction(table):
    for i in range(6):
        table.append_records([{"id": i}])
    assert table.compact() and len(table.data_files()) == 1 and sorted(r["id"] for r in table.scan()) == list(range(6))
    assert not table.compact()


# ---- collection ----


def _orphan(table, name="data/orphan.parquet"):
    path = os.path.join(table.root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    open(path, "w").close()
    return path


def test_collection(table):
    table.append_records(ROWS)
    old, fresh = _orphan(table), _orphan(table, "data/fresh.parquet")
    os.utime(old, (time.time() - 7200,) * 2)
    assert table.garbage_collect() == {"data_files": 1, "manifest_files": 0, "manifest_lists": 0}
    assert os.path.exists(fresh) and not os.path.exists(old) and table.row_count() == 3 and len(table.scan()) == 3
    protected = _orphan(table, "data/open/part.parquet")
    os.makedirs(os.path.join(table.root, "_inflight"), exist_ok=True)
    with open(os.path.join(table.root, "_inflight", "m.json"), "w") as f:
        json.dump({"path": "data/open", "created_ms": int(time.time() * 1000)}, f)
    table.garbage_collect(0)
    assert os.path.exists(protected) and not os.path.exists(fresh)


def test_collection_fails_closed(table):
    table.append_records(ROWS)
    orphan = _orphan(table)
    manifest = [n for n in os.listdir(os.path.join(table.root, "_manifests")) if n.endswith(".parquet")][0]
    with open(os.path.join(table.root, "_manifests", manifest), "w") as f:
        f.write("junk")
    with pytest.raises(GarbageCollectionAborted):
        table.garbage_collect(0)
    assert os.path.exists(orphan)


def test_collection_after_expiry_and_through_a_link(spark, tmp_path):
    t = create_table(spark, str(tmp_path / "data"), PEOPLE)
    for r in ROWS:
        t.append_records([r])
    gone = t.data_files()[0].path
    with t.new_transaction() as x:
        x.delete_files([gone]).expire_snapshots(int(time.time() * 1000) + 10_000)
    os.symlink(t.root, tmp_path / "link")
    linked = load_table(spark, str(tmp_path / "link"))
    assert linked.garbage_collect(0)["data_files"] == 1
    assert len(linked.scan()) == 2 and len(t.scan()) == 2


def test_manifest_outside_is_refused(table):
    table.append_records(ROWS)
    version, state = table.store.latest()
    bad = [s | {"manifest_list": "../../etc/passwd"} for s in state["snapshots"]]
    table.store.commit(version, state, state | {"snapshots": bad})
    with pytest.raises(ValueError, match="traversal"):
        table.scan()


def test_stream_batches_commit_once(spark, table):
    from siltstone.streaming.ingest import append_batch

    df = spark.createDataFrame([(1, "a", 1, 0.5)], "id long, name string, age int, score double")
    assert append_batch(table, df, "q", 0) and not append_batch(table, df, "q", 0)
    assert append_batch(table, df, "other", 0) and append_batch(table, df, "q", 1) and not append_batch(table, df, "q", 0)
    assert table.row_count() == 3


def test_a_table_on_another_storage(spark, tmp_path, monkeypatch):
    """Everything through the JVM's file systems, none of it through paths of this machine."""
    from siltstone.table.storage import HadoopStorage

    monkeypatch.setattr("siltstone.table.table.open_storage", lambda root, session: HadoopStorage(session, f"file://{root}"))
    t = create_table(spark, str(tmp_path / "t"), PEOPLE)
    assert t.root.startswith("file://") and isinstance(load_table(spark, str(tmp_path / "t")).storage, HadoopStorage)
    t.append_records(ROWS)
    t.append_df(spark.createDataFrame([(4, "d", 1, 0.5), (5, None, 2, 0.25)], "id long, name string, age int, score double"), files=2)
    spark.createDataFrame([(6, "e", 3, 0.5)], "id long, name string, age int, score double").coalesce(1).write.parquet(t.storage.uri("data/mine"))
    t.append_data([f"data/mine/{n}" for n in t.storage.names("data/mine") if n.endswith(".parquet")])
    assert sorted(r["id"] for r in t.scan()) == list(range(1, 7)) and t.scan(["id"], {"age": (">", 40)}) == [{"id": 1}, {"id": 3}] and t.to_df().count() == 6
    with t.new_transaction().begin() as tx:
        tx.delete_files([f.path for f in t.data_files() if f.path.startswith("data/mine")])
        tx.expire_snapshots(2**60)
    assert t.garbage_collect(0)["data_files"] >= 1 and t.row_count() == 5 and t.verify_integrity()["existing_files"] == len(t.data_files())
    tx = t.new_transaction().begin()
    tx.append_records(ROWS)
    before = len(t.storage.list("data"))
    assert tx.rollback() and len(t.storage.list("data")) < before and t.row_count() == 5


def test_unknown_schemes_are_refused(spark):
    with pytest.raises(Exception, match="UnsupportedFileSystem|No FileSystem"):
        create_table(spark, "nosuch://host/t", PEOPLE)


def test_manifests_that_cannot_match_are_not_read(table, monkeypatch):
    monkeypatch.setattr(tf, "MANIFEST_ENTRIES", 2)
    with table.new_transaction().begin() as t:
        for i in range(7):
            t.append_records([{"id": 10 * i + j, "age": None if i == 3 else i} for j in range(3)])
    reads = []
    read = tf.read_manifest
    monkeypatch.setattr(tf, "read_manifest", lambda storage, name, fields=None: reads.append(name) or read(storage, name, fields))
    assert table.scan(["id"], {"id": ("between", (41, 42))}) == [{"id": 41}, {"id": 42}] and len(reads) == 1
    reads.clear()
    assert [r["id"] for r in table.scan(["id"], {"age": ("is_null",)})] == [30, 31, 32] and len(reads) == 1
    reads.clear()
    assert len(table.scan()) == 21 and len(reads) == 4
