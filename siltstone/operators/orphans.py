"""References to objects that are missing, deleted or late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.scans import running_max

#: Events and references of one object are cut at this many milliseconds (30 days) so that a hot object is spread over tasks.
SLICE_MS = 30 * 86_400_000
_END = 2**62


def check_references(references: DataFrame, events: DataFrame, grace_ms: int = 0) -> DataFrame:
    """The state of the object behind each reference.

    ``references``: source_table, table_uuid, path, ref_ms (null: the end of the log);
    null and empty paths are no references and are left out. ``events``: table_uuid,
    path, event_ms, is_put. Extra columns are ignored; a null table_uuid is a table of its
    own. References are reduced to distinct ones; both sides are shuffled by object and time slice and sorted by
    time, and one linear merge gives each reference the last event before it (events
    delivered again change nothing). An object is valid from a put to the next delete.

    Gives the distinct references with n_refs and ``state``: ``ok``; ``missing`` (never
    put); ``deleted`` (the last event is a delete); ``late`` (present at the end, but
    not at ref_ms + grace_ms). Of a put and a delete at the same time the put counts.
    """
    references, events = (d.withColumn("table_uuid", F.coalesce("table_uuid", F.lit(""))) for d in (references, events))
    refs = references.where("path is not null and path <> ''").groupBy("source_table", "table_uuid", "path", "ref_ms").agg(F.count(F.lit(1)).alias("n_refs"))
    log = events.where("path is not null and event_ms is not null").select("table_uuid", "path", "event_ms", F.coalesce("is_put", F.lit(False)).alias("is_put"))
    # an event as one number that orders by time and then puts last; numbers aggregate by hash, structs would be sorted
    state = F.greatest(F.lit(-_END // 2), F.least(F.lit(_END // 2), F.col("event_ms"))) * 2 + F.col("is_put").cast("long")
    left = log.select("table_uuid", "path", F.col("event_ms").alias("pos"), F.lit(0).alias("side"), state.alias("event"), F.lit(None).cast("string").alias("source_table"), F.lit(None).cast("long").alias("ref_ms"), F.lit(0).cast("long").alias("n_refs"))
    right = refs.select("table_uuid", "path", F.coalesce(F.col("ref_ms") + grace_ms, F.lit(_END)).alias("pos"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("event"), "source_table", "ref_ms", "n_refs")
    merged = running_max(left.unionByName(right), ["table_uuid", "path"], "pos", ["side"], F.col("event"), "then", SLICE_MS).where("side = 1")
    at_ref, at_end = (F.coalesce(F.pmod(F.col(c), F.lit(2)) == 1, F.lit(False)) for c in ("then", "then_all"))
    verdict = F.when(F.col("then_all").isNull(), "missing").when(~at_end, "deleted").when(~at_ref, "late").otherwise("ok")
    return merged.select("source_table", F.nullif("table_uuid", F.lit("")).alias("table_uuid"), "path", "ref_ms", "n_refs", verdict.alias("state"))
