"""Single files and storage."""

import pandas as pd
import pyarrow as pa
import pytest

from siltstone.sources.datafiles import DataFileReader, DataFileWriter, FileFormat, check_files, is_compatible, is_pandas_compatible, read_data_file, read_pandas_file, write_data_file
from siltstone.table import CommitConflict, DataFile, Field, Schema, create_table
from siltstone.table.log import CommitLog
from siltstone.table.storage import HadoopStorage, LocalStorage, open_storage

SCHEMA = Schema([Field(1, "id", "long", True), Field(2, "name", "string"), Field(3, "age", "int")])
ROWS = [{"id": i, "name": f"n{i}", "age": i % 7} for i in range(25)]


def test_writer_and_reader(spark, tmp_path):
    path = str(tmp_path / "deep" / "f.parquet")
    with DataFileWriter(path, SCHEMA) as w:
        w.write_records(ROWS[:10])
        w.write_batch(pa.RecordBatch.from_pylist(ROWS[10:20], SCHEMA.arrow()))
        w.write_pandas(pd.DataFrame(ROWS[20:]))
    assert read_data_file(path) == ROWS and read_data_file(path, ["age"])[3] == {"age": 3}
    assert read_pandas_file(path, ["id"])["id"].tolist() == list(range(25))
    with DataFileReader(path) as r:
        assert r.schema.names == SCHEMA.names and r.read_all().num_rows == 25 and r.df(spark, ["name"]).count() == 25
        assert [b.num_rows for b in r.read_batches(10)] == [10, 10, 5] and [len(f) for f in r.read_batches_pandas(20)] == [20, 5]
        with pytest.raises(ValueError):
            r.read_columns(["none"])
    with pytest.raises(KeyError), DataFileWriter(str(tmp_path / "g.parquet"), SCHEMA) as w:
        w.write_records(ROWS)
        raise KeyError
    assert not list(tmp_path.glob("g.parquet*"))
    for other in (FileFormat.ORC, "avro"):
        with pytest.raises(ValueError):
            DataFileReader(path, other)


def test_described_files_can_be_adopted(spark, tmp_path):
    t = create_table(spark, str(tmp_path), SCHEMA)
    entries = [write_data_file(spark, t.root, "data/a.parquet", ROWS[:5], SCHEMA, {"day": "x"}), write_data_file(spark, t.root, "data/b.parquet", pd.DataFrame(ROWS[5:9]), SCHEMA), write_data_file(spark, t.root, "data/c.parquet", spark.createDataFrame(ROWS[9:], "id long, name string, age int"), SCHEMA)]
    assert entries[0].lower[1] == 0 and entries[0].partition_values == {"day": "x"}
    t.append_data(entries)
    assert sorted(t.scan(), key=lambda r: r["id"]) == ROWS and t.data_files()[0].partition_values == {"day": "x"}
    check_files(t.root, t.data_files())
    with pytest.raises(FileNotFoundError):
        check_files(t.root, [DataFile("data/none.parquet", 1, 1)])


def test_compatibility():
    assert is_compatible(ROWS, SCHEMA) and not is_compatible([{"name": "x"}], SCHEMA) and not is_compatible([{"id": "x"}], SCHEMA)
    assert is_pandas_compatible(pd.DataFrame(ROWS), SCHEMA) and not is_pandas_compatible(pd.DataFrame({"id": ["x"], "name": ["y"], "age": [1]}), SCHEMA)
    assert not is_pandas_compatible(pd.DataFrame({"id": [None], "name": ["y"], "age": [1]}), SCHEMA) and not is_pandas_compatible(pd.DataFrame({**ROWS[0], "more": 1}, index=[0]), SCHEMA)


@pytest.fixture(params=["local", "hadoop"])
def storage(request, spark, tmp_path):
    return LocalStorage(str(tmp_path)) if request.param == "local" else HadoopStorage(spark, f"file://{tmp_path}")


def test_storage(storage):
    s = storage
    assert s.list("none") == [] == s.names("none") == s.folders("none") and not s.exists("a/b") and not s.delete("a/b")
    s.write("a/b", b"12345")
    s.write("a/b", b"123456")
    assert s.read("a/b") == b"123456" and s.read("a/b", 2, 3) == b"345" and s.info("a/b")[0] == 6 and s.list() == ["a/b"] and s.folders() == ["a"] and s.names("a") == ["b"]
    with s.open("a/b") as f:
        f.seek(2)
        assert f.read(3) == b"345" and f.read() == b"6"
    s.write("empty", b"")
    assert s.read("empty") == b""
    for call in (s.open, s.read):
        with pytest.raises(FileNotFoundError):
            call("none")
    with pytest.raises(ValueError):
        s.read("../outside")
    assert s.delete("a") and s.delete("empty") and s.list() == []


def test_exclusive_creation(storage):
    storage.create("x", b"1")
    with pytest.raises(CommitConflict):
        storage.create("x", b"2")
    assert storage.read("x") == b"1" and storage.list() == ["x"]


def test_log_on_a_storage(storage):
    log = CommitLog(storage)
    assert log.latest() == (-1, None)
    for i in range(5):
        log.publish(i, {"n": i})
    with pytest.raises(CommitConflict):
        log.publish(3, {})
    log.trim(2)
    assert log.versions() == [3, 4] and log.latest() == (4, {"n": 4})


def test_storages_by_scheme(spark, tmp_path):
    assert isinstance(open_storage(f"file://{tmp_path}"), LocalStorage) and isinstance(open_storage(str(tmp_path)), LocalStorage)
    with pytest.raises(ValueError):
        open_storage("hdfs://host/x")
    with pytest.raises(Exception, match="UnsupportedFileSystem|No FileSystem"):
        open_storage("nosuch://host/x", spark)
