"""The queries of the general pipeline problems, over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import epoch_millis
from siltstone.operators import compaction, hierarchy, incremental, orphans, profile
from siltstone.operators.joins import lookup_join
from siltstone.session import materialize, new_path
from siltstone.sources.catalogue import Catalogue

TASK_COLUMNS = ["task_id", "workflow_id", "status", "started_at", "completed_at", "duration_ms", "error_message", "worker_id"]


def _archive(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the written archive of all small files in crowded partitions."""
    catalogue = Catalogue(spark, folder)
    records = catalogue.table("task_logs").select("table_uuid", "file_path", *TASK_COLUMNS)
    return compaction.compact(catalogue.live_files(), catalogue.objects(), records)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _archive(spark, folder).select("table_uuid", "file_path")


def p1_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Per table: the files and records in its archive, the files without records here, and whether it has at most one block that is not full."""
    by = _archive(spark, folder).groupBy("table_uuid").agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.count_if(F.col("length") == 0).alias("empty_files"), F.sum("length").alias("bytes"), F.countDistinct("block_path").alias("blocks"))
    return by.select("table_uuid", "files", "records", "empty_files", (F.col("blocks") <= F.ceil(F.col("bytes") / compaction.TARGET_BYTES)).alias("well_sized"))


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records read back from the archive: each record of the packed files once."""
    rows = compaction.read_members(_archive(spark, folder))
    cells = F.from_json("record", "array<string>")
    return rows.select("table_uuid", "file_path", cells.alias("c")).select("table_uuid", "file_path", *[F.col("c")[i].alias(c) for i, c in enumerate(TASK_COLUMNS)])


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files packed byte for byte and read back from the blocks: the bytes and checksum of each. The files, one small one for each file of the catalogue with records, list its tasks."""
    tasks = Catalogue(spark, folder).table("task_logs").where("task_id is not null").select("table_uuid", "file_path", "task_id").distinct()
    texts = tasks.groupBy("table_uuid", "file_path").agg(F.concat(F.array_join(F.array_sort(F.collect_list("task_id")), "\n"), F.lit("\n")).alias("content"))
    source = new_path(spark, "many-files")
    compaction.write_files(texts.select(F.concat_ws("/", "table_uuid", "file_path").alias("file_path"), F.encode("content", "UTF-8").alias("content")), source)
    back = compaction.read_files(compaction.pack_files(spark, source, new_path(spark, "packed-files")))
    part = lambda i: F.regexp_extract("file_path", r"many-files-[0-9a-f]+/([^/]*)/(.*)", i)
    return back.select(part(1).alias("table_uuid"), part(2).alias("file_path"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _references(catalogue: Catalogue) -> DataFrame:
    """Every reference with the time of the referring snapshot (null if unknown)."""
    snapshots = catalogue.snapshots().select("table_uuid", "snapshot_id", epoch_millis(F.col("timestamp_ms")).alias("ref_ms"), F.col("manifest_list").alias("path"))
    times = snapshots.groupBy("table_uuid", "snapshot_id").agg(F.max("ref_ms").alias("ref_ms"))
    lists = snapshots.where("path <> ''").groupBy("table_uuid", F.col("path").alias("manifest_list")).agg(F.min("ref_ms").alias("ref_ms"))
    from_lists = catalogue.manifest_files().select("table_uuid", "manifest_list", F.col("manifest_path").alias("path")).join(lists, ["table_uuid", "manifest_list"], "left")
    files = catalogue.data_files().select("table_uuid", "snapshot_id", F.col("file_path").alias("path")).join(times, ["table_uuid", "snapshot_id"], "left")
    parts = {"snapshots": snapshots, "manifest_files": from_lists, "data_files": files}
    named = [d.select(F.lit(name).alias("source_table"), "table_uuid", "path", "ref_ms") for name, d in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    catalogue = Catalogue(spark, folder)
    parts = {"snapshots": (catalogue.snapshots(), "manifest_list"), "manifest_files": (catalogue.manifest_files(), "manifest_path"), "data_files": (catalogue.data_files(), "file_path")}
    named = [d.select(F.lit(name).alias("source_table"), "table_uuid", F.col(c).alias("path"), F.lit(None).cast("long").alias("ref_ms")) for name, (d, c) in parts.items()]
    references = named[0].unionByName(named[1]).unionByName(named[2])
    checked = orphans.check_references(references, catalogue.object_events())
    return checked.where("state in ('missing', 'deleted')").select("source_table", "table_uuid", F.col("path").alias("ref_path"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per source table, table, month of the referring snapshot and state."""
    catalogue = Catalogue(spark, folder)
    checked = orphans.check_references(_references(catalogue), catalogue.object_events(), grace_ms=3_600_000)
    month = F.date_format(F.timestamp_millis("ref_ms"), "yyyy-MM")
    return checked.where("state <> 'ok'").groupBy("source_table", "table_uuid", month.alias("month"), "state").agg(F.count(F.lit(1)).alias("n_references"))


def _adopted(spark: SparkSession, folder: str) -> tuple[incremental.IncrementalRun, DataFrame]:
    """A run whose first manifest holds the files that the successful runs of the log have covered, as the entries of that time show them; and the live files as they are."""
    catalogue = Catalogue(spark, folder)
    states = materialize(catalogue.entry_states(), "states")
    run = incremental.IncrementalRun(spark, new_path(spark, "runs"))
    run.adopt(incremental.covered_files(states, incremental.successful_runs(catalogue.table("run_log"), catalogue.snapshot_sequences())))
    return run, catalogue.live_states(states)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    run, listing = _adopted(spark, folder)
    return run.pending(listing).select("table_uuid", "file_path")


def p3_run(spark: SparkSession, folder: str) -> DataFrame:
    """The records of each file, counted by three runs: over all files as first listed, one that breaks off, and one over the live files as they are now.

    Files listed again since have changed, so they are counted again and their first rows are superseded.
    """
    catalogue = Catalogue(spark, folder)
    states = materialize(catalogue.entry_states(), "states")
    first = states.groupBy("table_uuid", "file_path").agg(F.min("seq").alias("seq"), F.max("file_size_in_bytes").alias("file_size_in_bytes"), F.max("checksum").alias("checksum"))
    records = catalogue.table("task_logs").select("table_uuid", "file_path", *TASK_COLUMNS).distinct()

    def work(files: DataFrame) -> DataFrame:
        return records.join(files.select("table_uuid", "file_path"), ["table_uuid", "file_path"]).groupBy("table_uuid", "file_path").agg(F.count(F.lit(1)).alias("records"))

    def broken(files: DataFrame) -> DataFrame:
        raise InterruptedError("after its files were taken on")

    run = incremental.IncrementalRun(spark, new_path(spark, "runs"))
    run.run(first, work)
    live = catalogue.live_states(states)
    try:
        run.run(live, broken)
    except InterruptedError:
        pass
    run.run(live, work)
    return run.output()


def _table_fields(catalogue: Catalogue) -> DataFrame:
    fields = catalogue.table("table_fields").select(F.col("schema_id").alias("current_schema_id"), "field_id", "field_name", "field_type", "required", "value_pattern")
    return catalogue.table("table_metadata").select("table_uuid", "current_schema_id").transform(lambda tables: lookup_join(tables, fields, ["current_schema_id"]))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    catalogue = Catalogue(spark, folder)
    entries = catalogue.with_sequence(catalogue.data_files().where("file_path <> ''"))
    return profile.check_statistics(entries, _table_fields(catalogue)).select("table_uuid", "file_path", "field_id")


def p4_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Null rate and range of every field of every catalogued table, from the files' statistics."""
    catalogue = Catalogue(spark, folder)
    entries = catalogue.with_sequence(catalogue.data_files().where("file_path <> ''"))
    return profile.profile_statistics(entries, _table_fields(catalogue))


_PATTERNS = {"task_id": "task-[0-9]{10}", "workflow_id": "wf-[a-z]+-[0-9]{4}", "worker_id": "worker-[0-9]{4}"}


def p4_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Exact base aggregates of every column of the records."""
    rows = Catalogue(spark, folder).table("task_logs")
    return profile.profile_columns(rows, rows.columns, _PATTERNS)


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of nulls and of values off their pattern of every column, by month of load, and their change from the month before."""
    rows = Catalogue(spark, folder).table("task_logs")
    month = F.year("loaded_at") * 12 + F.month("loaded_at")
    return profile.period_shares(rows, month, rows.columns, _PATTERNS)


def p4_drift(spark: SparkSession, folder: str) -> DataFrame:
    """How well the rows loaded in each 90 days can be told from those of the 90 days with rows before, over all tables, and by which columns. Periods are counted back from the newest row; the newest is 0."""
    rows = Catalogue(spark, folder).table("task_logs")
    newest = rows.agg(F.max("loaded_at").alias("m")).first()["m"]
    period = -F.floor((F.unix_millis(F.lit(newest).cast("timestamp")) - F.unix_millis(F.col("loaded_at").cast("timestamp"))) / (90 * 86_400_000))
    times = {c: profile.time_feature(F.col(c), F.col("loaded_at")) for c in ("started_at", "completed_at")}
    return profile.period_drift(rows, period, TASK_COLUMNS, ["table_uuid", "file_path", "task_id", "started_at"], times)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    snapshots = Catalogue(spark, folder).table("snapshots")
    found = hierarchy.resolve_hierarchy(snapshots, "snapshot_id", "parent_snapshot_id", ["table_uuid", "timestamp_ms"])
    return found.select(F.col("id").alias("snapshot_id"), F.col("root").alias("root_snapshot_id"), F.col("depth").alias("link_depth"))


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The full path from the root to each snapshot that reaches one."""
    paths = hierarchy.hierarchy_paths(Catalogue(spark, folder).table("snapshots"), "snapshot_id", "parent_snapshot_id", ["table_uuid", "timestamp_ms"])
    return paths.select(F.col("id").alias("snapshot_id"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """For each snapshot with snapshots below it: how many, from the interval that holds them."""
    found = hierarchy.nested_intervals(Catalogue(spark, folder).table("snapshots"), "snapshot_id", "parent_snapshot_id", ["table_uuid", "timestamp_ms"])
    return found.where("descendants > 0").select(F.col("id").alias("snapshot_id"), F.col("root").alias("root_snapshot_id"), "descendants")


def p5_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Each snapshot, those without any below it and those that lead into a circle too, with the interval that holds its descendants, how many they are, and whether its link runs in a circle.

    Below a snapshot lie those of the same root whose interval lies within its own; below one on a circle all others of its root.
    """
    found = hierarchy.nested_intervals(Catalogue(spark, folder).table("snapshots"), "snapshot_id", "parent_snapshot_id", ["table_uuid", "timestamp_ms"], circles=True)
    return found.select(F.col("id").alias("snapshot_id"), F.col("root").alias("root_snapshot_id"), "enter", "leave", "descendants", "on_circle")


QUERIES = {f.__name__: f for f in (p1_found, p1_blocks, p1_records, p1_files, p2_found, p2_report, p3_found, p3_run, p4_found, p4_statistics, p4_profile, p4_shares, p4_drift, p5_found, p5_paths, p5_descendants, p5_intervals)}
