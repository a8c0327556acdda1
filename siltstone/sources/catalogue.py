"""The catalogue of tables (metadata, snapshots, manifests, files, stored objects) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.columns import partition_key, relative_path
from siltstone.operators.joins import lookup_join
from siltstone.session import materialize


class Catalogue:
    """Reads the catalogue tables of a folder; every path comes out relative to its table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _relative(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Replace path columns by relative ones; rows of unknown tables keep theirs without leading slashes."""
        places = self.table("table_metadata").select("table_uuid", "table_location")
        joined = lookup_join(df, places, ["table_uuid"], "left", salt_by=columns)
        return joined.withColumns({c: relative_path(F.col(c), F.col("table_location")) for c in columns}).drop("table_location")

    def snapshots(self) -> DataFrame:
        return self._relative(self.table("snapshots").drop("summary"), ["manifest_list"])

    def manifest_files(self) -> DataFrame:
        return self._relative(self.table("manifest_files"), ["manifest_list", "manifest_path"])

    def data_files(self) -> DataFrame:
        return self._relative(self.table("data_files"), ["manifest_path", "file_path"])

    def object_events(self) -> DataFrame:
        """table_uuid, path, event_ms, is_put, size_bytes; each event once."""
        log = self.table("stored_objects").where("object_path is not null and event_ms is not null")
        rows = self._relative(log, ["object_path"])
        return rows.select("table_uuid", F.col("object_path").alias("path"), "event_ms", (F.lower(F.trim("event_type")) == "put").alias("is_put"), "size_bytes")

    def objects(self) -> DataFrame:
        """The last state of each stored object: table_uuid, path, is_put, size_bytes.

        Of a put and a delete at the same time the put counts.
        """
        last = F.max(F.struct("event_ms", "is_put", "size_bytes")).alias("last")
        return self.object_events().groupBy("table_uuid", "path").agg(last).select("table_uuid", "path", "last.is_put", "last.size_bytes")

    def snapshot_sequences(self) -> DataFrame:
        """table_uuid, snapshot_id, snapshot_sequence; one row per snapshot."""
        return self.table("snapshots").groupBy("table_uuid", "snapshot_id").agg(F.max("sequence_number").alias("snapshot_sequence"))

    def with_sequence(self, entries: DataFrame) -> DataFrame:
        """Adds ``seq``: the entry's sequence number or, if null, that of its snapshot."""
        joined = lookup_join(entries, self.snapshot_sequences(), ["table_uuid", "snapshot_id"], "left", salt_by=["file_path"])
        return joined.withColumn("seq", F.coalesce("sequence_number", "snapshot_sequence")).drop("snapshot_sequence")

    def live_entries(self, entries: DataFrame | None = None) -> DataFrame:
        """The entries of ``data_files`` (or those given) in the manifests of each table's current snapshot."""
        current = self.table("table_metadata").select("table_uuid", F.col("current_snapshot_id").alias("snapshot_id"))
        lists = lookup_join(self.table("snapshots").select("table_uuid", "snapshot_id", "manifest_list"), current, ["table_uuid", "snapshot_id"], "left_semi")
        lists = materialize(self._relative(lists, ["manifest_list"]).where("manifest_list <> ''").select("table_uuid", "manifest_list").distinct(), "lists")  # about one a table
        stands = self.manifest_files().select("table_uuid", "manifest_list", "manifest_path").where("manifest_path <> ''")
        live = materialize(lookup_join(stands, lists, ["table_uuid", "manifest_list"], "left_semi", salt_by=["manifest_path"]).select("table_uuid", "manifest_path").distinct(), "manifests")
        entries = self.data_files().where("file_path <> ''") if entries is None else entries
        return lookup_join(entries, live, ["table_uuid", "manifest_path"], "left_semi", salt_by=["file_path"])

    def live_files(self) -> DataFrame:
        """Each live file once: table_uuid, file_path, part, file_size_in_bytes, record_count."""
        entries = self.live_entries().select("table_uuid", "file_path", partition_key(F.col("partition_values")).alias("part"), "file_size_in_bytes", "record_count")
        return entries.groupBy("table_uuid", "file_path").agg(*[F.max(c).alias(c) for c in ("part", "file_size_in_bytes", "record_count")])

    def entry_states(self) -> DataFrame:
        """The entries of ``data_files`` with their sequence number: table_uuid, manifest_path, file_path, seq, file_size_in_bytes, checksum."""
        return self.with_sequence(self.data_files().where("file_path <> ''")).select("table_uuid", "manifest_path", "file_path", "seq", "file_size_in_bytes", "checksum")

    def live_states(self, states: DataFrame) -> DataFrame:
        """Each live file as its entry (see :meth:`entry_states`) with the largest sequence number shows it: table_uuid, file_path, seq, file_size_in_bytes, checksum."""
        return self.live_entries(states).groupBy("table_uuid", "file_path").agg(F.max("seq").alias("seq"), F.max("file_size_in_bytes").alias("file_size_in_bytes"), F.max("checksum").alias("checksum"))
