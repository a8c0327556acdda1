"""Processing only new or changed files, once each."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.joins import lookup_join
from siltstone.operators.scans import running_max
from siltstone.table.errors import CommitConflict
from siltstone.table.log import CommitLog
from siltstone.table.storage import open_storage

#: Sequence numbers of one table are cut into blocks of so many, so that a hot table is spread over tasks.
SEQUENCE_BLOCK = 1024
#: Parts of a manifest after which they are merged into one.
MERGED_PARTS = 16
#: Versions of the state kept in its log.
KEPT_VERSIONS = 20

_KEY = ("table_uuid", "file_path")
#: What tells one state of a file from another.
_STATE = ("seq", "size", "checksum")
_MANIFEST = "table_uuid string, file_path string, seq long, size long, checksum string, batch long"


def covered_files(entries: DataFrame, runs: DataFrame) -> DataFrame:
    """The files that finished runs have covered, as they were then: table_uuid, file_path, seq, size, checksum, each state once.

    ``entries``: table_uuid, file_path, seq, file_size_in_bytes, checksum, of any time; ``runs``: table_uuid, above_seq,
    upto_seq of successful runs. A run covers above_seq < seq <= upto_seq; runs with a
    null bound cover nothing, and entries without a table or sequence number are never covered.
    Runs and entries are merged in order of the sequence number (no join on ranges): an
    entry is covered if the largest upto_seq of the runs that begin below it reaches it.
    """
    ends = runs.where("table_uuid is not null and above_seq is not null and upto_seq is not null").groupBy("table_uuid", "above_seq").agg(F.max("upto_seq").alias("upto"))
    starts = ends.select("table_uuid", F.col("above_seq").alias("pos"), F.lit(1).alias("side"), "upto", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("checksum"))
    points = entries.where("table_uuid is not null and seq is not null").select("table_uuid", F.col("seq").alias("pos"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("upto"), "file_path", F.col("file_size_in_bytes").alias("size"), "checksum").distinct()
    merged = running_max(starts.unionByName(points), ["table_uuid"], "pos", ["side"], F.col("upto"), "reach", SEQUENCE_BLOCK)
    return merged.where("side = 0 and reach >= pos").select("table_uuid", "file_path", F.col("pos").alias("seq"), "size", "checksum")


def pending_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Anti-join of the listing against the manifest by table, path, size, checksum and, if the listing has it, sequence number; nulls equal nulls."""
    state = [c for c in _STATE if c != "seq" or "seq" in listing.columns]
    done = manifest.select(*[F.col(c).alias(f"__{c}") for c in (*_KEY, *state)])
    same = (F.col("table_uuid") == F.col("__table_uuid")) & (F.col("file_path") == F.col("__file_path"))
    for c in state:
        same &= F.col("file_size_in_bytes" if c == "size" else c).eqNullSafe(F.col(f"__{c}"))
    return listing.join(done, same, "left_anti")


def successful_runs(run_log: DataFrame, snapshot_sequences: DataFrame) -> DataFrame:
    """table_uuid, above_seq, upto_seq of the runs with status success (any letter case); a null end is that of the snapshot."""
    runs = run_log.where(F.lower(F.trim("status")) == "success").select("table_uuid", "from_sequence_number", "to_sequence_number", F.col("to_snapshot_id").alias("snapshot_id")).distinct()
    joined = runs.join(snapshot_sequences.select("table_uuid", "snapshot_id", "snapshot_sequence"), ["table_uuid", "snapshot_id"], "left")
    return joined.select("table_uuid", F.col("from_sequence_number").alias("above_seq"), F.coalesce("to_sequence_number", "snapshot_sequence").alias("upto_seq"))


class IncrementalRun:
    """Runs a function over the files that are new or changed since the last successful run.

    State lives in ``folder``, which all executors reach: the log names the manifest parts and batches that count. Every attempt
    at a batch has a folder of its own, with the files it took on and the rows it made of them; the batch's identifier is the version of
    the log it leads to, which only one attempt can publish. Readers use :meth:`output`, which sees published batches only, so nothing is skipped
    or repeated wherever an attempt breaks off. What a listing gives is read once: what is processed is what the manifest gets.

    A file whose size, checksum or sequence number has changed is processed again, and its rows of earlier batches no longer count.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.storage = open_storage(self.folder, spark)
        self.log = CommitLog(self.storage)

    def _state(self) -> tuple[int, dict]:
        version, doc = self.log.latest()
        return version, doc or {"batches": [], "parts": [], "superseded": 0}

    def _parts(self, state: dict) -> DataFrame:
        if not state["parts"]:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(*[self.storage.uri(p) for p in state["parts"]])

    def manifest(self) -> DataFrame:
        """The last processed state of each file: table_uuid, file_path, seq, size, checksum, batch."""
        _, state = self._state()
        return _latest(self._parts(state)) if state["superseded"] else self._parts(state)

    def pending(self, listing: DataFrame) -> DataFrame:
        """The files of ``listing`` that are new or changed, by the manifest published last.

        ``listing``: table_uuid, file_path, file_size_in_bytes, checksum and, if there are such, seq; other columns are kept. Rows without table or path are no files.
        """
        known = F.col("table_uuid").isNotNull() & F.col("file_path").isNotNull()
        return pending_files(listing.where(known), self.manifest())

    def adopt(self, covered: DataFrame) -> None:
        """Publish a manifest of files that others have processed (see :func:`covered_files`) as the first version; :class:`CommitConflict` if there is a state already.

        Of several states of a file all are kept: a listing that shows one of them again has been processed.
        """
        part = self._attempt(0) + "/manifest"
        seq = F.col("seq") if "seq" in covered.columns else F.lit(None).cast("long")
        covered.select(*_KEY, seq.alias("seq"), "size", "checksum", F.lit(0).cast("long").alias("batch")).write.parquet(self.storage.uri(part))
        self.log.publish(0, {"batches": [], "parts": [part], "superseded": 0})

    @staticmethod
    def _attempt(batch: int) -> str:
        return f"attempts/{batch:08d}-{uuid.uuid4().hex[:12]}"

    def output(self) -> DataFrame | None:
        """The rows of all published batches, those of files processed again later left out; None before the first."""
        _, state = self._state()
        if not state["batches"]:
            return None
        batches = {b["batch"]: self.storage.uri(b["rows"]) for b in state["batches"]}
        rows = self.spark.read.parquet(*batches.values())
        if not state["superseded"]:
            return rows
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/attempts/(\d{8})-", 1).cast("long")
        last = self._parts(state).groupBy(*_KEY).agg(F.max("batch").alias("__last"))
        numbered = rows.select("*", number.alias("__batch"), F.col("_metadata.row_index").alias("__row"))
        return lookup_join(numbered, last, list(_KEY), salt_by=["__row"]).where("__batch = __last").select(*rows.columns)

    def run(self, listing: DataFrame, work: Callable[[DataFrame], DataFrame]) -> str | None:
        """Process what is pending; the batch identifier, or None if nothing is.

        ``work`` gets the pending part of ``listing``, written down, and gives the rows to write, which must have table_uuid and file_path (``ValueError``).
        A file listed several times counts once, with its largest sequence number, size and checksum. If anything
        raises, nothing is published. If another run publishes first, this raises :class:`CommitConflict` and its rows are never read.
        """
        version, state = self._state()
        number = version + 1
        attempt = self._attempt(number)
        self._clear(version)
        seq = F.col("seq") if "seq" in listing.columns else F.lit(None).cast("long")
        order = F.struct(seq.alias("s"), "file_size_in_bytes", "checksum")
        once = self.pending(listing).groupBy(*_KEY).agg(F.max_by(F.struct(*listing.columns), order).alias("f")).select("f.*")
        files = self.storage.uri(f"{attempt}/files")
        once.write.parquet(files)
        taken = self.spark.read.schema(once.schema).parquet(files)
        digest = taken.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*_KEY, "file_size_in_bytes", "checksum").cast("decimal(38,0)")).alias("h")).first()
        if not digest["n"]:
            self.storage.delete(attempt)
            return None
        rows = work(taken)
        if not set(_KEY) <= set(rows.columns):
            raise ValueError(f"the rows must have the columns {_KEY}")
        rows.write.parquet(self.storage.uri(f"{attempt}/rows"))
        manifest = taken.select(*_KEY, seq.alias("seq"), F.col("file_size_in_bytes").alias("size"), "checksum", F.lit(number).cast("long").alias("batch"))
        again = manifest.join(self._parts(state).select(*_KEY), list(_KEY), "left_semi").count() if state["parts"] else 0
        parts = state["parts"]
        if len(parts) >= MERGED_PARTS:  # one part then holds all files; of a file adopted or processed repeatedly only the last state
            manifest, parts = _latest(self._parts(state).unionByName(manifest)), []
        manifest.write.parquet(self.storage.uri(f"{attempt}/manifest"))
        batch = f"{number:08d}-{hashlib.sha256(json.dumps([digest['n'], str(digest['h'])]).encode()).hexdigest()[:16]}"
        self.log.publish(number, {"batches": [*state["batches"], {"id": batch, "batch": number, "rows": f"{attempt}/rows"}], "parts": [*parts, f"{attempt}/manifest"], "superseded": state["superseded"] + again})
        self.log.trim(KEPT_VERSIONS)
        return batch

    def _clear(self, version: int) -> None:
        """Remove attempts that can't be published any more: those at versions the log has, which it does not name."""
        if version < 0:
            return
        named = set()
        for v in self.log.versions():
            doc = self.log.read(v)
            named |= {p.rsplit("/", 1)[0] for p in (*doc["parts"], *[b["rows"] for b in doc["batches"]])}
        for name in self.storage.folders("attempts"):
            if f"attempts/{name}" not in named and int(name[:8]) <= version:
                self.storage.delete(f"attempts/{name}")


def _latest(parts: DataFrame) -> DataFrame:
    """Of each file what its last batch says."""
    last = F.max("batch").over(Window.partitionBy(*_KEY))
    return parts.withColumn("__last", last).where("batch = __last").drop("__last")


__all__ = ["CommitConflict", "IncrementalRun", "covered_files", "pending_files", "successful_runs"]
