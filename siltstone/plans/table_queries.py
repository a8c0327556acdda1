"""Queries over the star schema, all through the table layer."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.joins import asof_join
from siltstone.session import local_path, new_path
from siltstone.table import Schema, Table, create_table

_ingested: dict[tuple[str, str, str], Table] = {}

#: The columns a table's files are clustered by when it is taken in.
_CLUSTER = {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"], "events": ["ts"]}


def _source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fresh(spark: SparkSession, df: DataFrame, label: str) -> Table:
    """An empty table with the columns of ``df`` in a new folder."""
    return create_table(spark, local_path(new_path(spark, label)), Schema.of(df.schema))


def table(spark: SparkSession, folder: str, name: str) -> Table:
    """A test table taken into the table layer, once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _ingested:
        df = _source(spark, folder, name)
        t = _fresh(spark, df, name)
        t.append_df(df, cluster_by=_CLUSTER.get(name), files=8 if name in _CLUSTER else None, checksum=True)
        _ingested[key] = t
    return _ingested[key]


def _df(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name).to_df()


def _total(c: str) -> F.Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


# ---- scans, projection, filters ----


def scan_all_region(spark, folder):
    return table(spark, folder, "region").to_df()


def project_orders(spark, folder):
    return table(spark, folder, "orders").scan_df(["o_orderkey", "o_totalprice"])


def _filtered(name: str, columns: list[str], condition: dict):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, name).scan_df(columns, condition)

    return query


_ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_NOON = (dt.datetime(2024, 1, 5, 12), dt.datetime(2024, 1, 20, 6))


def _with_nulls(spark: SparkSession, folder: str) -> Table:
    """lineitem with nulls in a column of flags."""
    key = (spark.sparkContext.applicationId, folder, "lineitem_nulls")
    if key not in _ingested:
        df = _source(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", F.lit(None).cast("string")).otherwise(F.col("l_returnflag")).alias("flag"))
        t = _fresh(spark, df, "lineitem_nulls")
        t.append_df(df)
        _ingested[key] = t
    return _ingested[key]


def _null_filter(condition: dict):
    return lambda spark, folder: _with_nulls(spark, folder).scan_df(filter=condition)


def filter_conjunction(spark, folder):
    return table(spark, folder, "lineitem").scan_df(["l_orderkey", "l_linenumber", "l_quantity", "l_discount"], {"l_returnflag": "R", "l_quantity": (">", 30.0), "l_discount": ("between", (0.03, 0.07))})


def project_without_filter_col(spark, folder):
    return table(spark, folder, "customer").scan_df(["c_name"], {"c_mktsegment": ("in", ["BUILDING", "MACHINERY"])})


def pruned_range_lineitem(spark, folder):
    return table(spark, folder, "lineitem").scan_df(["l_orderkey", "l_linenumber", "l_extendedprice"], {"l_orderkey": ("between", (1000, 1999))})


def array_roundtrip(spark, folder):
    return _df(spark, folder, "embeddings").select("vec_id", F.size("embedding").alias("dims"), F.element_at("embedding", 1).cast("double").alias("first"), "label")


# ---- table operations ----


def row_count_meta(spark, folder):
    return spark.range(1).select(F.lit(table(spark, folder, "lineitem").row_count()).cast("long").alias("n"))


def file_stats(spark, folder):
    """Rows and key range of the whole table, put together from the manifests' bounds only."""
    t = table(spark, folder, "lineitem")
    files = t.files_df()
    key = str(t.schema.by_name["l_orderkey"].id)
    number = lambda m: F.get_json_object(F.element_at(F.col(m), key), "$.v").cast("long")
    return files.agg(F.sum("record_count").alias("n"), F.min(number("lower")).alias("min_key"), F.max(number("upper")).alias("max_key"))


def multi_append_union(spark, folder):
    df = _source(spark, folder, "nation")
    t = _fresh(spark, df, "nation_twice")
    t.append_df(df)
    t.append_df(df)
    return t.to_df()


def adopt_files(spark, folder):
    """Files written by others below the table's folder are registered where they are."""
    df = _source(spark, folder, "supplier")
    t = _fresh(spark, df, "adopted")
    path = os.path.join(t.root, "data", "outside")
    df.coalesce(1).write.option("compression", "snappy").parquet("file://" + path)
    t.append_data([f"data/outside/{n}" for n in os.listdir(path) if n.endswith(".parquet")])
    return t.to_df()


def delete_file_effect(spark, folder):
    """Orders, appended in two parts by status; the files of one are removed."""
    df = _source(spark, folder, "orders").select(*_ORDER)
    t = _fresh(spark, df, "deleted")
    t.append_df(df.where("o_orderstatus = 'F'"))
    gone = [f.path for f in t.data_files()]
    t.append_df(df.where("o_orderstatus <> 'F'"))
    with t.new_transaction().begin() as tx:
        tx.delete_files(gone)
    return t.to_df()


def asof_scan(spark, folder):
    """The table as of its first snapshot."""
    df = _source(spark, folder, "orders").select(*_ORDER)
    t = _fresh(spark, df, "asof")
    t.append_df(df.where("o_orderstatus = 'O'"))
    first = t.current_snapshot()["snapshot_id"]
    t.append_df(df.where("o_orderstatus <> 'O'"))
    return t.scan_df(snapshot_id=first)


def _three_snapshots(spark, folder) -> Table:
    df = _source(spark, folder, "region")
    t = _fresh(spark, df, "lineage")
    t.append_df(df)
    first = [f.path for f in t.data_files()]
    t.append_df(df)
    with t.new_transaction().begin() as tx:
        tx.delete_files(first)
    return t


def snapshot_lineage(spark, folder):
    t = _three_snapshots(spark, folder)
    return t.snapshots_df().select("sequence_number", "operation")


def expire_keeps_data(spark, folder):
    t = _three_snapshots(spark, folder)
    with t.new_transaction().begin() as tx:
        tx.expire_snapshots(int(time.time() * 1000) + 1000)
    return t.to_df()


def delete_snapshot_repoint(spark, folder):
    """The current snapshot is deleted, so the one before becomes current: two appends of region."""
    t = _three_snapshots(spark, folder)
    t.delete_snapshot(t.current_snapshot()["snapshot_id"])
    return t.to_df()


def compaction_keeps_rows(spark, folder):
    df = _source(spark, folder, "part")
    t = _fresh(spark, df, "compacted")
    t.append_df(df, files=12)
    t.compact(target_rows=1_000_000)
    return t.to_df()


def batches_roundtrip(spark, folder):
    """All rows through the batch iterator and back."""
    t = table(spark, folder, "supplier")
    rows = [(r["s_suppkey"], r["s_name"]) for b in t.scan_batches(97, ["s_suppkey", "s_name"]) for r in b]
    return spark.createDataFrame(rows, "s_suppkey long, s_name string")


def checksum_report(spark, folder):
    r = table(spark, folder, "orders").verify_integrity()
    return spark.createDataFrame([(r["total_files"] == r["existing_files"], len(r["checksum_mismatches"]))], "all_there boolean, mismatches long")


def gc_orphan(spark, folder):
    """An orphan is collected, the table's own files are not."""
    t = _three_snapshots(spark, folder)
    orphan = os.path.join(t.root, "data", "orphan.parquet")
    shutil.copy(os.path.join(t.root, t.data_files()[0].path), orphan)
    deleted = t.garbage_collect(0)
    return spark.createDataFrame([(deleted["data_files"], t.to_df().count())], "deleted long, n long")


# ---- aggregates over scans ----


def failed_avg_duration(spark, folder):
    rows = table(spark, folder, "events").scan_df(["event_type", "value"], {"event_type": "error"})
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("value").cast("decimal(18,6)")).cast("double").alias("avg_value"))


def groupby_count(spark, folder):
    return _df(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def groupby_sum(spark, folder):
    return _df(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_total("l_quantity").alias("sum_qty"), _total("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


# ---- what the host engine adds, over our scans ----


def join_inner(spark, folder):
    """Revenue per nation."""
    o, c, n = (_df(spark, folder, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    return joined.groupBy("n_name").agg(_total("o_totalprice").alias("revenue"), F.count("*").alias("orders"))


def join_left(spark, folder):
    o, c = (_df(spark, folder, t) for t in ("orders", "customer"))
    spent = o.groupBy("o_custkey").agg(_total("o_totalprice").alias("spent"))
    return c.join(spent, c.c_custkey == spent.o_custkey, "left").select("c_custkey", "spent")


def join_full(spark, folder):
    s, c = (_df(spark, folder, t) for t in ("supplier", "customer"))
    a = s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    b = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return a.join(b, a.s_nationkey == b.c_nationkey, "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "suppliers", "customers")


def join_semi(spark, folder):
    o, l = (_df(spark, folder, t) for t in ("orders", "lineitem"))
    return o.join(l.where("l_returnflag = 'R'"), o.o_orderkey == l.l_orderkey, "left_semi").select("o_orderkey", "o_orderstatus")


def join_anti(spark, folder):
    c, o = (_df(spark, folder, t) for t in ("customer", "orders"))
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def join_asof(spark, folder):
    """Each error with the user's last event of another kind at or before it."""
    e = _df(spark, folder, "events").withColumn("ms", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = e.where("event_type = 'error'").select("event_id", "user_id", "ms")
    others = e.where("event_type <> 'error'").select("user_id", F.col("ms").alias("at"), F.col("event_id").alias("last_event"))
    return asof_join(errors, others, ["user_id"], "ms", "at", ["last_event"], 7 * 86_400_000_000).select("event_id", "last_event")


def join_range(spark, folder):
    """Orders per price band; bands are a fixed list of five."""
    bands = spark.createDataFrame([("a", 0.0, 50_000.0), ("b", 50_000.0, 100_000.0), ("c", 100_000.0, 200_000.0), ("d", 200_000.0, 400_000.0), ("e", 400_000.0, 1e12)], "band string, low double, high double")
    o = _df(spark, folder, "orders")
    return o.join(F.broadcast(bands), (o.o_totalprice >= bands.low) & (o.o_totalprice < bands.high)).groupBy("band").agg(F.count("*").alias("n"))


def agg_rollup(spark, folder):
    return _df(spark, folder, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def agg_cube(spark, folder):
    return _df(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority").agg(_total("o_totalprice").alias("total"))


def agg_grouping_sets(spark, folder):
    _df(spark, folder, "customer").createOrReplaceTempView("siltstone_customer")
    return spark.sql("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM siltstone_customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


def window_rank(spark, folder):
    """The three dearest orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return _df(spark, folder, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def window_lag(spark, folder):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return _df(spark, folder, "events").select("event_id", gap.alias("gap_us"))


def sort_top(spark, folder):
    """The hundred largest orders."""
    return _df(spark, folder, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


def set_operations(spark, folder):
    """Nations with customers, intersected with those with suppliers, without those of region 0."""
    c, s, n = (_df(spark, folder, t) for t in ("customer", "supplier", "nation"))
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select(F.col("s_nationkey").alias("k")))
    return both.exceptAll(n.where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


def predicate_mix(spark, folder):
    p = _df(spark, folder, "part")
    return p.where((F.col("p_type").like("%BRASS%") | F.col("p_brand").rlike("#1[0-5]$")) & ~(F.col("p_size") < 10)).select("p_partkey", "p_brand", "p_size")


def scalar_functions(spark, folder):
    o = _df(spark, folder, "orders")
    return o.select("o_orderkey", F.lower("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("y"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("thousands"))


def json_fields(spark, folder):
    """How often each key stands in the events' JSON."""
    e = _df(spark, folder, "events")
    return e.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def subquery_scalar(spark, folder):
    """Orders above the average price of their customer."""
    _df(spark, folder, "orders").createOrReplaceTempView("siltstone_orders")
    return spark.sql("SELECT o_orderkey FROM siltstone_orders o WHERE CAST(o_totalprice AS DECIMAL(18,2)) > (SELECT avg(CAST(i.o_totalprice AS DECIMAL(18,2))) FROM siltstone_orders i WHERE i.o_custkey = o.o_custkey)")


def udf_vectorised(spark, folder):
    """A pandas UDF over a scan: price with tax, in cents."""

    @F.pandas_udf(T.LongType())
    def cents(price, tax):
        return (price * (1 + tax) * 100).round().astype("int64")

    l = _df(spark, folder, "lineitem")
    return l.groupBy("l_linestatus").agg(F.sum(cents("l_extendedprice", F.lit(0.5))).alias("cents"))


def join_hints(spark, folder):
    """The same join by sort-merge, shuffled hash and broadcast of the 25 nations; right and inner."""
    s, n, r = (_df(spark, folder, t) for t in ("supplier", "nation", "region"))
    merged = s.hint("merge").join(n, s.s_nationkey == n.n_nationkey)
    hashed = merged.join(r.hint("shuffle_hash"), merged.n_regionkey == r.r_regionkey, "right")
    return hashed.groupBy("r_name").agg(F.count("s_suppkey").alias("suppliers"), _total("s_acctbal").alias("balance"))


def agg_percentiles(spark, folder):
    return _df(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.5).alias("median_qty"), F.expr("max_by(l_orderkey, struct(l_extendedprice, l_orderkey))").alias("dearest"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


def window_frames(spark, folder):
    """Sum of the last three orders of a customer, and of those within 100 keys before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return _df(spark, folder, "orders").select("o_orderkey", F.sum(price).over(w.rowsBetween(-2, 0)).cast("double").alias("last3"), F.sum(price).over(w.rangeBetween(-100, 0)).cast("double").alias("near"))


def window_sessions(spark, folder):
    """Sessions of a user with gaps below six hours: their number of events."""
    e = _df(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    sessions = e.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def formats_roundtrip(spark, folder):
    """A scan written as ORC, JSON and CSV and read back, together."""
    rows = _df(spark, folder, "nation")
    back = []
    for name in ("orc", "json", "csv"):
        path = new_path(spark, f"format-{name}")
        rows.write.format(name).save(path)
        back.append(spark.read.format(name).schema(rows.schema).load(path))
    return back[0].unionByName(back[1]).unionByName(back[2])


def join_cross(spark, folder):
    """Every pair of the five regions."""
    _df(spark, folder, "region").createOrReplaceTempView("siltstone_region")
    return spark.sql("SELECT a.r_name AS one, b.r_name AS other FROM siltstone_region a CROSS JOIN siltstone_region b")


def _median(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """The exact median of the values that aren't null (null if there are none), as one row with column ``p``.

    ``low`` and ``high`` are guesses around it. The values beyond them are only counted, those between are counted by value
    and sorted. A guess that the median lies beyond is dropped, so any guesses give the right result.
    """
    x = F.col(column)
    low_, high_ = (F.lit(v).cast("double") for v in (low, high))
    n, below, upto = df.agg(F.count(x), F.count_if(x < low_), F.count_if(x <= high_)).first()
    first, last = (n - 1) // 2, n // 2
    rows, before = df.where(x.isNotNull()), 0
    if below <= first and low is not None:
        rows, before = rows.where(x >= low_), below
    if upto > last:
        rows = rows.where(x <= high_)
    values = rows.groupBy(x.alias("x")).agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(Window.orderBy("x")) + before)
    return values.where(" or ".join(f"end - n <= {k} and {k} < end" for k in (first, last))).agg(F.avg("x").alias("p"))


def agg_approximate(spark, folder):
    """Approximate aggregates lie near the exact ones, or both are null or 0.

    Each is taken on its own: next to a distinct count in one ``agg``, Spark keeps the others' sketches for every single key.
    """
    rows = _df(spark, folder, "lineitem")
    a, cuts = rows.agg(F.approx_count_distinct("l_orderkey", 0.02), F.percentile_approx("l_extendedprice", [0.499, 0.5, 0.501], 10_000)).first()
    low, middle, high = cuts or (None, None, None)
    a, e, m, p = F.lit(a), F.col("e"), F.lit(middle).cast("double"), F.col("p")
    exact = rows.agg(F.countDistinct("l_orderkey").alias("e")).unionByName(_median(rows, "l_extendedprice", low, high), allowMissingColumns=True).agg(F.max("e").alias("e"), F.max("p").alias("p"))
    return exact.select(((F.abs(a - e) < 0.1 * e) | (a == e)).alias("distinct_near"), ((F.abs(m - p) < 0.01 * F.abs(p)) | m.eqNullSafe(p)).alias("median_near"))


def subquery_exists_in(spark, folder):
    """EXISTS, NOT EXISTS and IN over scans."""
    for name in ("orders", "customer", "nation"):
        _df(spark, folder, name).createOrReplaceTempView(f"siltstone_{name}")
    return spark.sql(
        "SELECT c_custkey FROM siltstone_customer c WHERE EXISTS (SELECT 1 FROM siltstone_orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')"
        " AND NOT EXISTS (SELECT 1 FROM siltstone_orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) AND c_nationkey IN (SELECT n_nationkey FROM siltstone_nation WHERE n_regionkey IN (0, 1, 2))"
    )


def map_functions(spark, folder):
    """Maps made from columns, looked into, filtered and turned into rows."""
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    rows = _df(spark, folder, "part").select("p_partkey", F.map_filter(m, lambda k, v: v.isNotNull()).alias("m"))
    return rows.select("p_partkey", F.element_at("m", "size").cast("int").alias("size"), F.size("m").alias("n"), F.map_contains_key("m", "none").alias("has_none"), F.explode("m").alias("key", "value"))


def apply_in_pandas(spark, folder):
    """A pandas function per group, of at most all of a customer's orders: the price of each order as share of the customer's total."""

    def share(frame):
        cents = (frame["o_totalprice"] * 100).round()
        return frame.assign(share=(cents / cents.sum()).round(9))[["o_orderkey", "share"]]

    return _df(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").applyInPandas(share, "o_orderkey long, share double")


def map_in_arrow(spark, folder):
    """Batches of a scan through an Arrow function."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def lower(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_lower(b.column(1))], names=["p_partkey", "name"])

    return _df(spark, folder, "part").select("p_partkey", "p_name").mapInArrow(lower, "p_partkey long, name string")


def udaf_pandas(spark, folder):
    """An aggregate function in pandas over the parts' sizes of each brand."""

    @F.pandas_udf("long")
    def spread(values: pd.Series) -> int:
        return int(values.max() - values.min())

    return _df(spark, folder, "part").groupBy("p_brand").agg(spread("p_size").alias("spread"))


def format_text(spark, folder):
    """A column of a scan as lines of text and back."""
    path = new_path(spark, "format-text")
    _df(spark, folder, "customer").select(F.col("c_name").alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("c_name"))


def _event_stream(spark, folder):
    staged = local_path(new_path(spark, "stream_source"))
    _source(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet("file://" + staged)
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("file://" + staged)


def stream_sliding(spark, folder):
    """Windows of two hours every hour over the events as a stream; those that have closed."""
    from siltstone.streaming.ingest import windowed_counts

    return windowed_counts(_event_stream(spark, folder), new_path(spark, "stream_windows"), "2 hours", slide="1 hour")


def stream_sessions(spark, folder):
    """Sessions of a user with gaps below six hours over the events as a stream; those that have closed."""
    from siltstone.streaming.ingest import session_counts

    return session_counts(_event_stream(spark, folder), new_path(spark, "stream_sessions"), "user_id", "6 hours")


def udtf_pairs(spark, folder):
    """A table function: one row per word of a part's name."""

    @F.udtf(returnType="place int, word string")
    class Words:
        def eval(self, text: str):
            yield from enumerate((text or "").split(" "))

    spark.udtf.register("siltstone_words", Words)
    _df(spark, folder, "part").createOrReplaceTempView("siltstone_part")
    return spark.sql("SELECT p_partkey, w.place, w.word FROM siltstone_part, LATERAL siltstone_words(p_name) w")


def stream_state(spark, folder):
    """A custom stateful operator over the events as a stream: the last value and number of events of each user."""
    from siltstone.streaming.ingest import latest_per_key

    staged = local_path(new_path(spark, "stream_source"))
    df = _source(spark, folder, "events").select("event_id", "user_id")
    df.repartitionByRange(4, "event_id").write.parquet("file://" + staged)
    source = spark.readStream.schema("event_id long, user_id long").option("maxFilesPerTrigger", 1).parquet("file://" + staged)
    return latest_per_key(source, "user_id", "event_id", new_path(spark, "stream_latest"))


def stream_append(spark, folder):
    """The events as a stream into a table, in micro-batches that each commit once; read back as counts per day."""
    from siltstone.streaming.ingest import stream_into

    df = _source(spark, folder, "events")
    t = _fresh(spark, df, "stream_target")
    staged = local_path(new_path(spark, "stream_source"))
    df.repartition(4).write.parquet("file://" + staged)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet("file://" + staged)
    stream_into(source, t, new_path(spark, "stream_state"), "events", available_now=True).awaitTermination()
    return t.to_df().groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def stream_window(spark, folder):
    """Hourly windows with a watermark over the events as a stream; the windows that have closed."""
    from siltstone.streaming.ingest import windowed_counts

    return windowed_counts(_event_stream(spark, folder), new_path(spark, "stream_windows"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_all_region, project_orders, filter_conjunction, project_without_filter_col, pruned_range_lineitem, array_roundtrip, row_count_meta, file_stats, multi_append_union, adopt_files,
        delete_file_effect, asof_scan, snapshot_lineage, expire_keeps_data, delete_snapshot_repoint, compaction_keeps_rows, batches_roundtrip, checksum_report, gc_orphan, failed_avg_duration,
        groupby_count, groupby_sum, join_inner, join_left, join_full, join_semi, join_anti, join_asof, join_range, agg_rollup, agg_cube, agg_grouping_sets, window_rank, window_lag, sort_top,
        set_operations, predicate_mix, scalar_functions, json_fields, subquery_scalar, udf_vectorised, join_hints, agg_percentiles, window_frames,
        window_sessions, formats_roundtrip, udtf_pairs, join_cross, agg_approximate, subquery_exists_in, map_functions, apply_in_pandas, map_in_arrow, udaf_pandas, format_text, stream_sliding, stream_sessions, stream_append, stream_window, stream_state,
    )
}
_FILTERS = {
    "filter_eq": ("=", "o_orderstatus = 'F'", {"o_orderstatus": "F"}),
    "filter_ne": ("!=", "o_orderstatus <> 'F'", {"o_orderstatus": ("!=", "F")}),
    "filter_lt": ("<", "o_totalprice < 50000", {"o_totalprice": ("<", 50_000)}),
    "filter_le": ("<=", "o_orderkey <= 500", {"o_orderkey": ("<=", 500)}),
    "filter_gt": (">", "o_totalprice > 300000", {"o_totalprice": (">", 300_000.0)}),
    "filter_ge": (">=", "o_orderkey >= 900", {"o_orderkey": (">=", 900)}),
    "filter_in": ("in", "o_orderstatus IN ('F', 'P')", {"o_orderstatus": ("in", ["F", "P", None])}),
    "filter_not_in": ("not in", "o_orderstatus NOT IN ('F', 'P')", {"o_orderstatus": ("not_in", ["F", "P"])}),
}
_NULLS = {
    "filter_is_null": ("flag IS NULL", {"flag": ("is_null", False)}),
    "filter_is_not_null": ("flag IS NOT NULL", {"flag": ("notnull",)}),
    "filter_not_in_nulls": ("flag IS NOT NULL AND flag <> 'R'", {"flag": ("not_in", ["R", None])}),
    "filter_empty_in": ("false", {"flag": ("in", [])}),
    "filter_empty_not_in": ("flag IS NOT NULL", {"flag": ("not_in", [])}),
}
QUERIES |= {name: _filtered("orders", _ORDER, c) for name, (_, _, c) in _FILTERS.items()}
QUERIES |= {name: _null_filter(c) for name, (_, c) in _NULLS.items()}
QUERIES["filter_between_ts"] = _filtered("events", ["event_id", "value"], {"ts": ("between", _NOON), "event_type": ("in", ["error", "purchase"])})

_TWO = "SELECT * FROM region UNION ALL SELECT * FROM region"
SQL = {
    "scan_all_region": "SELECT * FROM region",
    "project_orders": "SELECT o_orderkey, o_totalprice FROM orders",
    "filter_conjunction": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30 AND l_discount BETWEEN 0.03::double AND 0.07::double",
    "project_without_filter_col": "SELECT c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "pruned_range_lineitem": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 1999",
    "array_roundtrip": "SELECT vec_id, len(embedding)::int AS dims, embedding[1]::double AS first, label FROM embeddings",
    "row_count_meta": "SELECT count(*) AS n FROM lineitem",
    "file_stats": "SELECT count(*) AS n, min(l_orderkey) AS min_key, max(l_orderkey) AS max_key FROM lineitem",
    "multi_append_union": "SELECT * FROM nation UNION ALL SELECT * FROM nation",
    "adopt_files": "SELECT * FROM supplier",
    "delete_file_effect": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'",
    "asof_scan": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'",
    "snapshot_lineage": "SELECT * FROM (VALUES (1::bigint, 'append'), (2, 'append'), (3, 'delete')) AS v(sequence_number, operation)",
    "expire_keeps_data": "SELECT * FROM region",
    "delete_snapshot_repoint": _TWO,
    "compaction_keeps_rows": "SELECT * FROM part",
    "batches_roundtrip": "SELECT s_suppkey, s_name FROM supplier",
    "checksum_report": "SELECT true AS all_there, 0::bigint AS mismatches",
    "gc_orphan": "SELECT 1::bigint AS deleted, count(*) AS n FROM region",
    "failed_avg_duration": "SELECT count(*) AS n, (sum(value::decimal(18,6)) / count(*))::double AS avg_value FROM events WHERE event_type = 'error'",
    "groupby_count": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "groupby_sum": "SELECT l_returnflag, l_linestatus, sum(l_quantity::decimal(18,2))::double AS sum_qty, sum(l_extendedprice::decimal(18,2))::double AS sum_price, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "join_inner": "SELECT n_name, sum(o_totalprice::decimal(18,2))::double AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "join_left": "SELECT c_custkey, sum(o_totalprice::decimal(18,2))::double AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "join_full": "SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON s_nationkey = c_nationkey",
    "join_semi": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_asof": "SELECT event_id, (SELECT max(struct_pack(t := o.ts, e := o.event_id)).e FROM events o WHERE o.user_id = x.user_id AND o.event_type <> 'error' AND o.ts <= x.ts) AS last_event FROM events x WHERE event_type = 'error'",
    "join_range": "SELECT CASE WHEN o_totalprice < 50000 THEN 'a' WHEN o_totalprice < 100000 THEN 'b' WHEN o_totalprice < 200000 THEN 'c' WHEN o_totalprice < 400000 THEN 'd' ELSE 'e' END AS band, count(*) AS n FROM orders GROUP BY 1",
    "agg_rollup": "SELECT p_brand, p_size, count(*) AS n, grouping_id(p_brand, p_size)::int AS level FROM part GROUP BY ROLLUP (p_brand, p_size)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, sum(o_totalprice::decimal(18,2))::double AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "window_rank": "SELECT o_custkey, o_orderkey, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "window_lag": "SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events",
    "sort_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "set_operations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0",
    "predicate_mix": "SELECT p_partkey, p_brand, p_size FROM part WHERE (p_type LIKE '%BRASS%' OR regexp_matches(p_brand, '#1[0-5]$')) AND NOT p_size < 10",
    "scalar_functions": "SELECT o_orderkey, lower(o_orderpriority) AS priority, year(o_orderdate)::int AS y, strftime(o_orderdate, '%Y-%m') AS month, floor(o_totalprice / 1000)::bigint AS thousands FROM orders",
    "json_fields": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
    "subquery_scalar": "SELECT o_orderkey FROM orders o WHERE o_totalprice::decimal(18,2) > (SELECT sum(i.o_totalprice::decimal(18,2)) / count(*) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "udf_vectorised": "SELECT l_linestatus, sum(round_even(l_extendedprice * 1.5::double * 100, 0)::bigint)::bigint AS cents FROM lineitem GROUP BY 1",
    "join_hints": "SELECT r_name, count(s_suppkey) AS suppliers, sum(s_acctbal::decimal(18,2))::double AS balance FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "agg_percentiles": "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median_qty, arg_max(l_orderkey, struct_pack(a := l_extendedprice, b := l_orderkey)) AS dearest, count(*) FILTER (l_discount > 0.05::double) AS discounted FROM lineitem GROUP BY 1",
    "window_frames": "SELECT o_orderkey, sum(o_totalprice::decimal(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::double AS last3, sum(o_totalprice::decimal(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW)::double AS near FROM orders",
    "window_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
    "formats_roundtrip": "SELECT * FROM nation UNION ALL SELECT * FROM nation UNION ALL SELECT * FROM nation",
    "udtf_pairs": "SELECT p_partkey, (i - 1)::int AS place, string_split(p_name, ' ')[i] AS word FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS t(i)",
    "join_cross": "SELECT a.r_name AS one, b.r_name AS other FROM region a, region b",
    "agg_approximate": "SELECT true AS distinct_near, true AS median_near",
    "subquery_exists_in": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 1, 2))",
    "map_functions": "SELECT p_partkey, p_size::int AS size, 2 AS n, false AS has_none, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, p_size::int, 2, false, 'size', p_size::varchar FROM part",
    "apply_in_pandas": "SELECT o_orderkey, round(round_even(o_totalprice * 100, 0) / sum(round_even(o_totalprice * 100, 0)) OVER (PARTITION BY o_custkey), 9) AS share FROM orders",
    "map_in_arrow": "SELECT p_partkey, lower(p_name) AS name FROM part",
    "udaf_pandas": "SELECT p_brand, (max(p_size) - min(p_size))::bigint AS spread FROM part GROUP BY 1",
    "format_text": "SELECT c_name FROM customer",
    "stream_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2 HAVING start + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "stream_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "stream_state": "SELECT user_id, max(event_id) AS latest, count(*) AS n FROM events GROUP BY 1",
    "stream_append": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "stream_window": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "filter_between_ts": "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 12:00:00' AND TIMESTAMP '2024-01-20 06:00:00' AND event_type IN ('error', 'purchase')",
}
SQL |= {name: f"SELECT {', '.join(_ORDER)} FROM orders WHERE {sql}" for name, (_, sql, _) in _FILTERS.items()}
SQL |= {name: f"SELECT * FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag END AS flag FROM lineitem) WHERE {sql}" for name, (sql, _) in _NULLS.items()}
