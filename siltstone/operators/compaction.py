"""Small-file consolidation into indexed archive containers.

Many small files become few large blocks. A block holds the members' bytes one
after the other; the index says for each member its block, offset, length and
checksum, so a member can be read alone and blocks can be read in parallel.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.joins import lookup_join
from siltstone.operators.scans import prefix_sum
from siltstone.session import filesystem, materialize, new_path, task_count

SMALL_BYTES = 16 * 1024 * 1024
MIN_FILES = 4
TARGET_BYTES = 128 * 1024 * 1024

#: Bytes of blocks one task reads back.
_READ_BYTES = 32 * 1024 * 1024
#: Hash buckets of a partition's members while they are placed; a partition that holds most of them is spread over so many tasks.
_BUCKETS = 16

_BLOCK_SCHEMA = "table_uuid string, part string, container_no long, block_path string, file_path string, offset long, length long, sha256 string"


def small_files(files: DataFrame, objects: DataFrame, small_bytes: int = SMALL_BYTES, min_files: int = MIN_FILES) -> DataFrame:
    """The small files of crowded partitions: table_uuid, part, file_path, size, record_count.

    ``files`` has table_uuid, file_path, part, file_size_in_bytes, record_count (one row
    per file), ``objects`` table_uuid, path, is_put, size_bytes. Only files whose object is
    there count. The size is the file's or, if that is null or not positive, the
    object's; a file of unknown size is never small. Rows without table_uuid or path are no
    files; other columns are ignored.
    """
    files = files.select("table_uuid", "file_path", "part", "file_size_in_bytes", "record_count")
    there = objects.where("is_put").select("table_uuid", F.col("path").alias("file_path"), "size_bytes")
    sized = files.join(there, ["table_uuid", "file_path"]).withColumn("size", F.when(F.col("file_size_in_bytes") > 0, F.col("file_size_in_bytes")).otherwise(F.col("size_bytes")))
    small = sized.where(F.col("size") < small_bytes).select("table_uuid", "part", "file_path", F.greatest("size", F.lit(0)).alias("size"), "record_count")
    small = materialize(small, "small-files")  # read twice
    crowded = small.groupBy("table_uuid", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_files).select("table_uuid", "part")
    return lookup_join(small, crowded, ["table_uuid", "part"], "left_semi", salt_by=["file_path"])


def plan_containers(members: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Assign each member of a table to a container by its bytes: table_uuid, part, file_path, container_no.

    ``members``: table_uuid, part, file_path (unique with the table), size; other columns are ignored. A table of T bytes gets
    ceil(T / target) containers, at least one, of near equal size: a container exceeds its share by one member at most. The members of a partition
    follow each other, so it lies in few containers. A null size counts as 0.
    """
    members = members.select("table_uuid", "part", "file_path", F.coalesce("size", F.lit(0)).alias("size"))
    placed = prefix_sum(members, ["table_uuid"], ["file_path"], "size", "at", ["part"], _BUCKETS)
    count = F.greatest(F.lit(1), F.ceil(F.col("at_total") / F.lit(target_bytes))).cast("long")
    number = F.when(F.col("at_total") > 0, F.least(count - 1, F.floor(F.col("at") / F.col("at_total") * count))).otherwise(F.lit(0)).cast("long")
    return placed.select("table_uuid", "part", "file_path", number.alias("container_no"))


def _spool(folder: str, distinct: bool):
    """A mapInArrow function: rows sorted by member and record become the members' bytes, one file a task; gives where each member stands.

    A file is written under a name of its task attempt; only rows of a task that
    succeeded come back, so files of lost attempts are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        kinds = {"table_uuid": pa.string(), "part": pa.string(), "file_path": pa.string(), "path": pa.string(), "at": pa.int64(), "length": pa.int64(), "raw_length": pa.int64(), "records": pa.int64()}
        columns: dict[str, list] = {name: [] for name in kinds}
        member, last, at, sink, path = None, None, 0, None, ""
        lines: list[bytes] = []

        def close_member() -> None:
            nonlocal at, sink, path
            if member is None:
                return
            raw = b"\n".join(lines) + (b"\n" if lines else b"")
            packed = press.compress(raw) if lines else b""
            if packed and sink is None:
                system, root = filesystem(folder)
                system.create_dir(root, recursive=True)
                path = f"{root}/{uuid.uuid4().hex}.spool"
                sink = system.open_output_stream(path)
            if packed:
                sink.write(packed)
            for name, value in zip(columns, (*member, path if packed else None, at, len(packed), len(raw), len(lines)), strict=True):
                columns[name].append(value)
            at += len(packed)

        def found() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))
            for v in columns.values():
                v.clear()
            return out

        for batch in batches:
            for *key, record in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != member:
                    close_member()
                    member, lines, last = key, [], None
                if record is not None and not (distinct and record == last):
                    last = record
                    lines.append(record)
            if len(columns["at"]) >= 10_000:
                yield found()
        close_member()
        if sink is not None:
            sink.close()
        yield found()

    return write


def record_bytes(columns: list[str]) -> Column:
    """A record as one line of JSON text (an array of the columns' values, nulls kept), encoded in UTF-8."""
    return F.encode(F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"}), "UTF-8")


def encode_members(members: DataFrame, records: DataFrame, folder: str, distinct: bool = False) -> DataFrame:
    """The bytes of each member, its records as compressed lines, spooled to ``folder``: table_uuid, part, file_path, path, at, length, raw_length, records.

    ``members`` has table_uuid, file_path (unique), part; ``records`` table_uuid, file_path, record (binary, without line feeds). With
    ``distinct`` equal records of a member are one record delivered again and are kept once; else each is kept. A member without
    records has length 0 and no path; null records are none. Records of files that are not members are left alone.
    """
    members = members.select("table_uuid", "file_path", "part")
    rows = lookup_join(records.select("table_uuid", "file_path", "record"), members, ["table_uuid", "file_path"])  # a small file has few records, so no key is hot
    order = ["table_uuid", "part", "file_path", "record"]
    headers = members.withColumn("record", F.lit(None).cast("binary"))
    by_member = rows.select(*order).unionByName(headers.select(*order)).repartition("table_uuid", "file_path").sortWithinPartitions("table_uuid", "file_path", "record")
    return by_member.mapInArrow(_spool(folder, distinct), "table_uuid string, part string, file_path string, path string, at long, length long, raw_length long, records long")


def _copy_blocks(rows: DataFrame, folder: str, origin: str) -> DataFrame:
    """Write blocks: the bytes of the members of each container one after the other, read from where they are.

    ``rows``: table_uuid, part, container_no, file_path, path, at, length (null: the whole file), in partitions and order of the containers. Gives the
    index (:data:`_BLOCK_SCHEMA`). A member of length 0 has no block.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        source, _ = filesystem(origin)
        system.create_dir(root, recursive=True)
        container, sink, block, at = None, None, "", 0
        opened: dict = {}
        for batch in batches:
            found: dict[str, list] = {k: [] for k in ("table_uuid", "part", "container_no", "block_path", "file_path", "offset", "length", "sha256")}
            for table, part, number, file, path, start, size in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (table, number) != container:
                    if sink is not None:
                        sink.close()
                    container, sink, at = (table, number), None, 0
                digest, length = hashlib.sha256(), 0
                if path is not None:
                    if sink is None:
                        block = f"{root}/{uuid.uuid4().hex}.block"
                        sink = system.open_output_stream(block)
                    if size is None:
                        with source.open_input_stream(path) as member:
                            while piece := member.read(1 << 22):
                                sink.write(piece)
                                digest.update(piece)
                                length += len(piece)
                    else:
                        if path not in opened:
                            if len(opened) >= 64:
                                opened.pop(next(iter(opened))).close()
                            opened[path] = source.open_input_file(path)
                        opened[path].seek(start)
                        piece = opened[path].read(size)
                        if len(piece) != size:
                            raise OSError(f"{path} ends before {start + size}")
                        sink.write(piece)
                        digest.update(piece)
                        length = size
                for k, v in zip(found, (table, part, number, block if path is not None else None, file, at, length, digest.hexdigest()), strict=True):
                    found[k].append(v)
                at += length
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("container_no", "offset", "length") else pa.string()) for k, v in found.items()], names=list(found))
        if sink is not None:
            sink.close()
        for f in opened.values():
            f.close()

    return rows.mapInArrow(write, _BLOCK_SCHEMA)


def pack(members: DataFrame, records: DataFrame, folder: str, target_bytes: int = TARGET_BYTES, distinct: bool = False) -> DataFrame:
    """Write each member's records into a container of its table and give the written index.

    The index has table_uuid, part, container_no, block_path, file_path, offset, length, raw_length, records, sha256. ``members`` and ``records`` are as in
    :func:`encode_members`. Containers are planned by the bytes the members have come to, about ``target_bytes`` each, and several partitions
    share one: a table has at most one block that is not full. A member without records gets an index row of length 0
    without block. Records are shuffled once, by member; after that only places are.
    """
    spooled = materialize(encode_members(members, records, f"{folder}/spool", distinct), "spooled")
    plan = plan_containers(spooled.withColumn("size", F.col("length")), target_bytes)
    rows = lookup_join(spooled, plan.select("table_uuid", "file_path", "container_no"), ["table_uuid", "file_path"])
    total = spooled.agg(F.sum("length")).first()[0] or 0
    tasks = task_count(members.sparkSession, total, 4 * target_bytes)  # by the bytes to copy, of which the shuffled places say nothing
    places = rows.select("table_uuid", "part", "container_no", "file_path", "path", F.col("at").alias("start"), "length").repartition(tasks, "table_uuid", "container_no").sortWithinPartitions("table_uuid", "container_no", "part", "file_path")
    index = materialize(_copy_blocks(places, f"{folder}/blocks", folder), "blocks")
    system, root = filesystem(folder)
    if system.get_file_info(f"{root}/spool").type == pafs.FileType.Directory:
        system.delete_dir(f"{root}/spool")
    facts = spooled.select("table_uuid", "file_path", "raw_length", "records")
    return lookup_join(index, facts, ["table_uuid", "file_path"]).select("table_uuid", "part", "container_no", "block_path", "file_path", "offset", "length", "raw_length", "records", "sha256")


def _members(frames: Iterator[pd.DataFrame], verify: bool = True) -> Iterator[tuple]:
    """Each row of an index, in order of blocks and offsets, with its bytes."""
    path, source = None, None
    for frame in frames:
        for m in frame.itertuples(index=False):
            if m.block_path != path:
                if source is not None:
                    source.close()
                path, source = m.block_path, filesystem(m.block_path)[0].open_input_file(m.block_path)
            source.seek(m.offset)
            content = source.read(m.length)
            if verify and hashlib.sha256(content).hexdigest() != m.sha256:
                raise ValueError(f"member {m.file_path} of {m.block_path} does not have its checksum")
            yield m, content


def read_members(index: DataFrame, verify: bool = True) -> DataFrame:
    """The records in the archive: table_uuid, file_path, record (text). Each member is read by its offset and length.

    Blocks are read in parallel; with ``verify`` a member whose bytes do not have the
    checksum of the index raises ``ValueError``.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpress = zstandard.ZstdDecompressor()
        names, records = [], []
        for m, packed in _members(frames, verify):
            lines = unpress.decompress(packed, max_output_size=m.raw_length).decode().removesuffix("\n").split("\n")  # splitlines would also split at U+2028 and U+0085 within a record
            names += [(m.table_uuid, m.file_path)] * len(lines)
            records += lines
            if len(records) >= 10_000:
                yield pd.DataFrame(names, columns=["table_uuid", "file_path"]).assign(record=records)
                names, records = [], []
        if records:
            yield pd.DataFrame(names, columns=["table_uuid", "file_path"]).assign(record=records)

    rows = index.select("block_path", "offset", "table_uuid", "file_path", "length", "raw_length", "sha256").where("length > 0")
    return _in_ranges(rows).mapInPandas(read, "table_uuid string, file_path string, record string")


def _in_ranges(index: DataFrame) -> DataFrame:
    """Rows of an index in order of blocks and offsets, in tasks of about _READ_BYTES of the blocks; the rows themselves say nothing of what there is to read."""
    total = index.agg(F.sum("length")).first()[0] or 0
    return index.repartitionByRange(task_count(index.sparkSession, total, _READ_BYTES), "block_path", "offset").sortWithinPartitions("block_path", "offset")


def list_files(spark: SparkSession, source: str) -> DataFrame:
    """file_path, size of all files below a folder, empty ones too: its folders on the driver, what is below them in tasks."""
    system, root = filesystem(source)
    top = system.get_file_info(pafs.FileSelector(root, recursive=False))
    here = [(i.path, i.size) for i in top if i.type == pafs.FileType.File]
    folders = [(i.path,) for i in top if i.type == pafs.FileType.Directory]
    found = spark.createDataFrame(here, "file_path string, size long")
    if not folders:
        return found

    def below(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = filesystem(source)
        for frame in frames:
            for folder in frame["folder"]:
                infos = [i for i in system.get_file_info(pafs.FileSelector(folder, recursive=True)) if i.type == pafs.FileType.File]
                yield pd.DataFrame({"file_path": [i.path for i in infos], "size": [i.size for i in infos]}).astype({"size": "int64", "file_path": "object"})

    tasks = min(len(folders), 4 * spark.sparkContext.defaultParallelism)
    return found.unionByName(spark.createDataFrame(folders, "folder string").repartition(tasks).mapInPandas(below, "file_path string, size long"))


def write_files(files: DataFrame, folder: str) -> int:
    """Write each row's ``content`` to its ``file_path`` below ``folder``, from tasks; how many. Paths must be unique; a file appears whole, under its name, and a repeated task replaces what it wrote."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = filesystem(folder)
        made: set[str] = set()
        for frame in frames:
            for name, content in zip(frame["file_path"], frame["content"], strict=True):
                at = f"{root}/{name}"
                if os.path.dirname(at) not in made:
                    system.create_dir(os.path.dirname(at), recursive=True)
                    made.add(os.path.dirname(at))
                temporary = f"{root}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temporary) as f:
                    f.write(content)
                system.move(temporary, at)
            yield pd.DataFrame({"n": [len(frame)]})

    return files.select("file_path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def pack_files(spark: SparkSession, source: str, folder: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Pack all files below ``source`` byte for byte into containers; gives the written index (block_path, file_path, offset, length, sha256).

    No file is split; a container takes about ``target_bytes``. Only paths are shuffled: the task that writes a
    container reads its members, a piece at a time. Empty files are members like others. An empty folder gives an empty index.
    """
    listing = materialize(list_files(spark, source).select(F.lit("").alias("table_uuid"), F.lit("").alias("part"), "file_path", "size"), "listing")
    plan = materialize(plan_containers(listing, target_bytes), "files-plan")
    last = plan.agg(F.max("container_no")).first()[0] or 0
    rows = plan.select("table_uuid", "part", "container_no", "file_path", F.col("file_path").alias("path"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("length"))
    rows = rows.repartition(int(last) + 1, "container_no").sortWithinPartitions("container_no", "file_path")
    return materialize(_copy_blocks(rows, folder, source), "files-index").select("block_path", "file_path", "offset", "length", "sha256")


def read_files(index: DataFrame) -> DataFrame:
    """The bytes of all packed files: file_path, content. Blocks are read in parallel; damaged ones raise ``ValueError``."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, contents, held = [], [], 0
        for m, content in _members(frames):
            names.append(m.file_path)
            contents.append(content)
            held += len(content)
            if held >= 1 << 22 or len(names) >= 10_000:
                yield pd.DataFrame({"file_path": names, "content": contents})
                names, contents, held = [], [], 0
        if names:
            yield pd.DataFrame({"file_path": names, "content": contents})

    return _in_ranges(index.select("block_path", "offset", "file_path", "length", "sha256")).mapInPandas(read, "file_path string, content binary")


def read_file(index: DataFrame, file_path: str) -> bytes:
    """The bytes of one packed file, found by the index; ``KeyError`` if it isn't there, ``ValueError`` if they are damaged."""
    row = index.where(F.col("file_path") == file_path).first()
    if row is None:
        raise KeyError(file_path)
    system, _ = filesystem(row["block_path"])
    with system.open_input_file(row["block_path"]) as source:
        source.seek(row["offset"])
        content = source.read(row["length"])
    if hashlib.sha256(content).hexdigest() != row["sha256"]:
        raise ValueError(f"{file_path} in {os.path.basename(row['block_path'])} is damaged")
    return content


def compact(files: DataFrame, objects: DataFrame, records: DataFrame, small_bytes: int = SMALL_BYTES, min_files: int = MIN_FILES, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Choose and pack in one: the index of all small files of crowded partitions.

    ``records`` has table_uuid, file_path and the record's own columns; loaded_at and
    other delivery columns must be left out, as equal records of a file are one delivered again and kept once.
    """
    members = materialize(small_files(files, objects, small_bytes, min_files), "members")
    own = [c for c in records.columns if c not in ("table_uuid", "file_path")]
    lines = records.select("table_uuid", "file_path", record_bytes(own).alias("record"))
    return pack(members, lines, new_path(files.sparkSession, "containers"), target_bytes, distinct=True)
