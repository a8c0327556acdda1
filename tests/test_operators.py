"""The general pipeline operators against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.columns import epoch_millis, partition_key, relative_path
from siltstone.operators import compaction, hierarchy, incremental, orphans, profile
from siltstone.operators.joins import asof_join, lookup_join
from siltstone.operators.scans import prefix_sum, running_max, sums_before
from siltstone.session import materialize, new_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- columns ----


def test_relative_path(spark):
    cases = [("/a/b/data/x", "/a/b", "data/x"), ("//data/x", "/a/b", "data/x"), ("a/b//data/x", "/a/b/", "data/x"), ("/a/bc/x", "/a/b", "a/bc/x"), ("data/x", None, "data/x"), (None, "/a", None), ("", "/a", "")]
    df = spark.createDataFrame([c[:2] for c in cases], "p string, l string")
    assert [r[0] for r in df.select(relative_path(F.col("p"), F.col("l"))).collect()] == [c[2] for c in cases]


def test_epoch_and_partition_key(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (1_700_000_000_123_456,), (None,)], "t long")
    assert [r[0] for r in df.select(epoch_millis(F.col("t"))).collect()] == [1_700_000_000_000, 1_700_000_000_123, 1_700_000_000_123, None]
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({},), (None,)], "m map<string,string>")
    a, b, c, d = (r[0] for r in df.select(partition_key(F.col("m"))).collect())
    assert a == b != c == d == ""


# ---- scans and joins ----


def test_running_max_and_sums(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.choice([None, *range(0, 60)]), rng.randrange(100), i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, p long, v long, i long")
    got = {r["i"]: (r["m"], r["m_all"]) for r in running_max(df, ["k"], "p", ["i"], F.col("v"), "m", 7).collect()}
    place = lambda r: (-1 if r[1] is None else r[1], r[3])
    for r in data:
        own = [x for x in data if x[0] == r[0]]
        assert got[r[3]] == (max(x[2] for x in own if place(x) <= place(r)), max(x[2] for x in own))
    for r in sums_before(df, ["k"], "p", ["v"], 7).collect():
        before = [x[2] for x in data if x[0] == r["k"] and x[1] is not None and x[1] < r["p"]]
        assert r["v_before"] == (sum(before) if before else None)


def test_prefix_sum(spark):
    df = spark.createDataFrame([("a", f"f{i}", i) for i in range(50)] + [("b", "x", 0)], "k string, u string, v long")
    got = prefix_sum(df, ["k"], ["u"], "v", "at", buckets=4).collect()
    spans = sorted((r["at"], r["at"] + r["v"]) for r in got if r["k"] == "a")
    assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] == sum(range(50))
    assert {r["at_total"] for r in got if r["k"] == "a"} == {sum(range(50))}


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join(spark, how, limit):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (None, 11)], "k int, w int")
    assert rows(lookup_join(left, right, ["k"], how, ["v"], 3, limit)) == rows(left.join(right, "k", how))


def test_asof_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1), ("a", None), ("c", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 9, 3), ("a", 11, 4), ("b", 2, 5), ("a", None, 6)], "k string, u long, v long")
    assert rows(asof_join(left, right, ["k"], "t", "u", ["v"], 4)) == sorted([("a", 5, 2), ("a", 10, 3), ("b", 1, None), ("a", None, None), ("c", 3, None)], key=str)


# ---- problem 1 ----

FILES = "table_uuid string, file_path string, part string, file_size_in_bytes long, record_count long, size_bytes long, at long"
OBJECTS = "table_uuid string, path string, is_put boolean, size_bytes long, size long"


def test_small_files(spark):
    files = [("t", f"f{i}", "", 10, 1, 7, 7) for i in range(3)] + [("t", "null_size", "", None, 1, 7, 7), ("t", "zero", "", 0, 1, 7, 7), ("t", "big", "", 100, 1, 7, 7), ("t", "gone", "", 1, 1, 7, 7), ("t", "unknown", "", None, None, 7, 7), ("u", "alone", "", 1, 1, 7, 7), (None, "x", "", 1, 1, 7, 7), ("t", None, "", 1, 1, 7, 7)]
    objects = [("t", p, p != "gone", None if p == "unknown" else 500 if p == "zero" else 20, 1) for _, p, *_ in files] + [("u", "alone", True, 5, 1)]
    found = compaction.small_files(spark.createDataFrame(files, FILES), spark.createDataFrame(objects, OBJECTS), small_bytes=50, min_files=4)
    assert {r["file_path"]: r["size"] for r in found.collect()} == {"f0": 10, "f1": 10, "f2": 10, "null_size": 20}
    none = compaction.small_files(spark.createDataFrame([], FILES), spark.createDataFrame([], OBJECTS))
    assert none.count() == 0 and compaction.plan_containers(none).count() == 0


def test_containers_are_near_equal(spark):
    members = spark.createDataFrame([("t", f"p{i % 3}", f"f{i}", 1 + i % 9, 1) for i in range(400)] + [("u", "zero", f"z{i}", 0, 0) for i in range(3)] + [("u", "null", "n", None, None)], "table_uuid string, part string, file_path string, size long, record_count long")
    plan = compaction.plan_containers(members, 200).collect()
    assert len(plan) == 404 and {r["container_no"] for r in plan if r["table_uuid"] == "u"} == {0}
    size = {r["file_path"]: r["size"] for r in members.collect()}
    sums, parts = {}, {}
    for r in plan:
        if r["table_uuid"] == "t":
            sums[r["container_no"]] = sums.get(r["container_no"], 0) + size[r["file_path"]]
            parts.setdefault(r["container_no"], set()).add(r["part"])
    total = sum(sums.values())
    assert len(sums) == -(-total // 200) and all(abs(s - total / len(sums)) <= 18 for s in sums.values())
    assert sum(len(p) for p in parts.values()) <= len(sums) + 2  # the members of a partition follow each other


def test_pack_and_read(spark):
    members = spark.createDataFrame([("t", "p", "f1"), ("t", "q", "f2"), ("t", "p", "empty"), ("u", "", "alone")], "table_uuid string, part string, file_path string")
    records = spark.createDataFrame([("t", "f1", "a", None, 1), ("t", "f1", "a", None, 1), ("t", "f1", "b", "é\n\"", 2), ("t", "f2", "x" * 100_000, None, None), ("t", "other", "z", None, 1), ("t", "f2", None, None, None)], "table_uuid string, file_path string, record string, text string, part long")
    lines = records.select("table_uuid", "file_path", compaction.record_bytes(["record", "text", "part"]).alias("record"))
    every = compaction.pack(members, lines, new_path(spark, "test-pack"))
    assert {r["file_path"]: r["records"] for r in every.collect()} == {"f1": 3, "f2": 2, "empty": 0, "alone": 0}
    index = materialize(compaction.pack(members, lines, new_path(spark, "test-pack"), distinct=True))
    by = {r["file_path"]: r for r in index.collect()}
    assert {k: r["records"] for k, r in by.items()} == {"f1": 2, "f2": 2, "empty": 0, "alone": 0} and by["empty"]["length"] == 0 and by["alone"]["block_path"] is None
    assert by["f1"]["block_path"] == by["f2"]["block_path"] and {by["f1"]["offset"], by["f2"]["offset"]} == {0, by["f1"]["length"]}  # partitions share a block
    back = compaction.read_members(index).select("file_path", F.from_json("record", "array<string>").alias("c")).collect()
    assert sorted(((r[0], *r[1]) for r in back), key=str) == sorted([("f1", "a", None, "1"), ("f1", "b", "é\n\"", "2"), ("f2", "x" * 100_000, None, None), ("f2", None, None, None)], key=str)
    path = by["f1"]["block_path"]
    content = bytearray(open(path, "rb").read())
    content[by["f1"]["offset"] + 3] ^= 255
    open(path, "wb").write(content)
    with pytest.raises(Exception, match="checksum"):
        compaction.read_members(index).count()
    none = compaction.pack(members.limit(0), lines, new_path(spark, "test-pack"))
    assert none.count() == 0 and compaction.read_members(none).count() == 0


def test_blocks_are_of_the_target_size(spark):
    members = spark.createDataFrame([(t, f"p{i % 7}", f"f{i}") for t in "tu" for i in range(60)], "table_uuid string, part string, file_path string")
    records = members.select("table_uuid", "file_path", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("i")).select("table_uuid", "file_path", compaction.record_bytes(["i", "file_path"]).alias("record"))
    index = compaction.pack(members, records, new_path(spark, "test-blocks"), target_bytes=1500).collect()
    for t in "tu":
        own = [r for r in index if r["table_uuid"] == t]
        size = sum(r["length"] for r in own)
        blocks = {r["block_path"] for r in own}
        assert len(own) == 60 and sum(r["records"] for r in own) == 1200 and len(blocks) == -(-size // 1500) > 1
        assert all(os.path.getsize(b) == sum(r["length"] for r in own if r["block_path"] == b) for b in blocks)


def test_records_with_separators_of_lines_come_back_whole(spark):
    texts = ["a\u2028b", "c\u0085d", "e\u2029f\x0b\x0c\x1c\r\n", "g"]
    members = spark.createDataFrame([("t", "p", "f")], "table_uuid string, part string, file_path string")
    records = spark.createDataFrame([("t", "f", t) for t in texts], "table_uuid string, file_path string, error_message string")
    index = compaction.pack(members, records.select("table_uuid", "file_path", compaction.record_bytes(["error_message"]).alias("record")), new_path(spark, "test-lines"))
    back = compaction.read_members(index).select(F.from_json("record", "array<string>")[0]).collect()
    assert sorted(r[0] for r in back) == sorted(texts)


def test_pack_files_round_trip(spark, tmp_path):
    contents = {f"d{i % 3}/f{i}.bin": os.urandom(i * 37 % 500) for i in range(40)}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    index = compaction.pack_files(spark, str(tmp_path), new_path(spark, "test-files"), target_bytes=2000)
    assert index.count() == 40 and 1 < index.select("block_path").distinct().count() < 10
    for name, content in contents.items():
        assert compaction.read_file(index, str(tmp_path / name)) == content
    assert {r["file_path"]: bytes(r["content"]) for r in compaction.read_files(index).collect()} == {str(tmp_path / n): c for n, c in contents.items()}
    with pytest.raises(KeyError):
        compaction.read_file(index, "none")
    (tmp_path / "nothing").mkdir()
    assert compaction.pack_files(spark, str(tmp_path / "nothing"), new_path(spark, "test-files")).count() == 0


# ---- problem 2 ----

REFS = "source_table string, table_uuid string, path string, ref_ms long, state string, pos long"
EVENTS = "table_uuid string, path string, event_ms long, is_put boolean, side int"


def test_check_references(spark):
    events = [("t", "ok", 5, True, 1), ("t", "ok", 5, True, 1), ("t", "gone", 5, True, 1), ("t", "gone", 9, False, 1), ("t", "late", 50, True, 1), ("t", "back", 5, False, 1), ("t", "back", 7, True, 1), ("t", "tie", 5, False, 1), ("t", "tie", 5, True, 1), ("t", None, 5, True, 1), ("t", "notime", None, True, 1), ("u", "missing", 1, True, 1), (None, "ok", 1, True, 1), ("t", "nullput", 3, None, 1)]
    refs = [("s", "t", p, 10, "x", 1) for p in ("ok", "ok", "gone", "late", "back", "tie", "missing", "notime", "nullput", None, "")] + [("s", "t", "late", None, "x", 1)]
    got = orphans.check_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(events, EVENTS))
    assert {(r["path"], r["ref_ms"]): (r["state"], r["n_refs"]) for r in got.collect()} == {
        ("ok", 10): ("ok", 2), ("gone", 10): ("deleted", 1), ("late", 10): ("late", 1), ("late", None): ("ok", 1), ("back", 10): ("ok", 1), ("tie", 10): ("ok", 1), ("missing", 10): ("missing", 1), ("notime", 10): ("missing", 1), ("nullput", 10): ("deleted", 1),
    }
    assert orphans.check_references(spark.createDataFrame([], REFS), spark.createDataFrame(events, EVENTS)).count() == 0
    assert {r["state"] for r in orphans.check_references(spark.createDataFrame(refs[:1], REFS), spark.createDataFrame([], EVENTS)).collect()} == {"missing"}


# ---- problem 3 ----


def test_covered_and_pending_files(spark):
    rng = random.Random(3)
    files = [(rng.choice("ab"), f"f{i}", rng.choice([None, *range(40)]), i, None if i % 5 else "c") for i in range(200)]
    runs = [(rng.choice("ab"), a := rng.choice([None, *range(40)]), None if a is None or rng.random() < 0.1 else a + rng.randrange(6)) for _ in range(12)]
    f = spark.createDataFrame(files, "table_uuid string, file_path string, seq long, file_size_in_bytes long, checksum string")
    manifest = incremental.covered_files(f.unionByName(f), spark.createDataFrame(runs, "table_uuid string, above_seq long, upto_seq long"))
    wanted = {x[:2] for x in files if x[2] is not None and any(t == x[0] and a is not None and b is not None and a < x[2] <= b for t, a, b in runs)}
    assert {(r["table_uuid"], r["file_path"]) for r in manifest.collect()} == wanted and manifest.count() == len(wanted)
    assert {(r["table_uuid"], r["file_path"]) for r in incremental.pending_files(f, manifest).collect()} == {x[:2] for x in files} - wanted
    for changed in (f.withColumn("file_size_in_bytes", F.lit(-1).cast("long")), f.withColumn("seq", F.lit(1000).cast("long")), f.withColumn("checksum", F.lit("x"))):
        assert incremental.pending_files(changed, manifest).count() == 200
    assert incremental.pending_files(f.limit(0), manifest).count() == 0


LISTED = "table_uuid string, file_path string, file_size_in_bytes long, checksum string, extra int"


def named(df):
    return df.select("table_uuid", "file_path", "checksum")


def files(run):
    return sorted((r["file_path"], r["checksum"]) for r in run.output().collect())


def test_incremental_run_survives_failure(spark):
    run = incremental.IncrementalRun(spark, new_path(spark, "test-run"))
    first = spark.createDataFrame([("t", "a", 1, "x", 0), ("t", "b", None, "y", 0), ("t", "b", None, "y", 1), ("t", None, 1, "x", 0), (None, "a", 1, "x", 0)], LISTED)
    assert run.output() is None
    for work in (lambda df: 1 / 0, lambda df: named(df).withColumn("checksum", F.raise_error(F.lit("fails while writing")).cast("string")), lambda df: df.select("file_path")):
        with pytest.raises((ZeroDivisionError, ValueError, Exception)):
            run.run(first, work)
        assert run.output() is None and run.manifest().count() == 0
    assert run.run(first, named) and files(run) == [("a", "x"), ("b", "y")]
    assert run.run(first, named) is None
    assert len(run.storage.folders("attempts")) == 1  # what failed is gone
    more = first.unionByName(spark.createDataFrame([("t", "c", 3, "z", 0)], LISTED))
    assert run.run(more, named) and files(run) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_a_changed_file_is_processed_again_and_its_rows_replaced(spark):
    run = incremental.IncrementalRun(spark, new_path(spark, "test-run"))
    listing = lambda *rows: spark.createDataFrame([("t", p, n, c, 0) for p, n, c in rows], LISTED)
    run.run(listing(("a", 1, "1"), ("b", 1, "1")), named)
    run.run(listing(("a", 1, "2"), ("b", 1, "1"), ("c", 1, "1")), named)
    assert files(run) == [("a", "2"), ("b", "1"), ("c", "1")] and run.manifest().count() == 3
    run.run(listing(("a", 1, "1"), ("b", 2, "1")), named)  # back as it was, and another size
    assert files(run) == [("a", "1"), ("b", "1"), ("c", "1")]
    assert run.pending(listing(("a", 1, "1"), ("b", 2, "1"), ("c", 1, "1"))).count() == 0


def test_a_listing_that_grows_while_it_is_processed(spark, tmp_path):
    run = incremental.IncrementalRun(spark, new_path(spark, "test-run"))
    source = str(tmp_path / "listing")
    spark.createDataFrame([("t", "a", 1, "x", 0)], LISTED).write.parquet(source)
    listing = spark.read.schema(LISTED).parquet(source)

    def work(df):
        spark.createDataFrame([("t", "b", 1, "x", 0)], LISTED).write.mode("append").parquet(source)
        return named(df)

    run.run(listing, work)
    assert files(run) == [("a", "x")]
    again = spark.read.schema(LISTED).parquet(source)
    assert run.run(again, named) and run.run(again, named) is None
    assert files(run) == [("a", "x"), ("b", "x")]


def test_runs_beside_each_other_and_many_runs(spark, monkeypatch):
    monkeypatch.setattr(incremental, "MERGED_PARTS", 3)
    monkeypatch.setattr(incremental, "KEPT_VERSIONS", 2)
    run = incremental.IncrementalRun(spark, new_path(spark, "test-run"))
    listing = lambda n: spark.createDataFrame([("t", f"f{i}", 1, "x", 0) for i in range(n)], LISTED)

    def overtaken(df):
        run.run(listing(1), named)
        return named(df)

    with pytest.raises(incremental.CommitConflict):
        run.run(listing(1), overtaken)
    assert files(run) == [("f0", "x")]
    for n in range(2, 7):
        run.run(listing(n), named)
    assert len(files(run)) == 6 == run.manifest().count() and run.run(listing(6), named) is None
    assert len(run.log.versions()) == 2 and len(run.log.latest()[1]["parts"]) <= 3


def test_adopted_manifest(spark):
    run = incremental.IncrementalRun(spark, new_path(spark, "test-run"))
    covered = spark.createDataFrame([("t", "a", 1, 5, "x"), ("t", "a", 4, 5, "x"), ("t", "b", 2, None, None)], "table_uuid string, file_path string, seq long, size long, checksum string")
    run.adopt(covered)
    with pytest.raises(incremental.CommitConflict):
        run.adopt(covered)
    listing = spark.createDataFrame([("t", "a", 4, 5, "x"), ("t", "b", 2, None, None), ("t", "c", 3, 1, "x")], "table_uuid string, file_path string, seq long, file_size_in_bytes long, checksum string")
    assert [r["file_path"] for r in run.pending(listing).collect()] == ["c"]
    assert [r["file_path"] for r in run.pending(listing.withColumn("seq", F.col("seq") + 1)).orderBy("file_path").collect()] == ["a", "b", "c"]
    run.run(listing, named)
    assert files(run) == [("c", "x")] and run.pending(listing).count() == 0


# ---- problem 4 ----

ENTRY = "table_uuid string, file_path string, seq long, record_count long, value_counts map<string,long>, null_value_counts map<string,long>, lower_bounds map<string,string>, upper_bounds map<string,string>, n_values int, required string"
FIELDS = "table_uuid string, field_id int, field_type string, required boolean, value_pattern string, lower string"


def test_check_statistics(spark):
    good = ({"1": 100, "2": 100}, {"1": 0, "2": 10}, {"1": "1", "2": '{"t": "str", "v": "ab"}'}, {"1": '{"t": "int", "v": 9}', "2": "b"})

    def entry(name, seq=1, count=100, **changes):
        maps = [dict(m) for m in good]
        for k, v in changes.items():
            maps["vnlh".index(k[0])][k[1:]] = v
        return ("t", name, seq, count, *maps, 0, "x")

    cases = [
        entry("good"), entry("good"), entry("negative", v2=-1), entry("nulls_over", n2=101), entry("required", n1=1), entry("count", count=99), entry("nocount", count=None), entry("nan", l1='{"t": "float", "v": NaN}'), entry("wide", h1=str(2**31)),
        entry("text", l1="abc"), entry("crossed", l1="10"), entry("crossed_text", h2="aa"), entry("pattern", h2="b1"), entry("line_end", h2="b\n"), entry("text_nan", l2='{"t": "float", "v": NaN}', h2='{"t": "float", "v": NaN}'), entry("text_null", l2='{"t": "str", "v": null}'), entry("no_bounds", l1=None, h1=None), ("t", "no_maps", 1, 5, None, None, None, None, 0, "x"), ("t", "other_field", 1, 1, {"9": 5}, {"9": 9}, None, None, 0, "x"), (None, "x", 1, 1, {"2": 1}, {"2": 2}, None, None, 0, "x"),
    ]
    fields = spark.createDataFrame([("t", 1, "int", True, None, "q"), ("t", 2, "string", False, "^[a-z]+$", "q")], FIELDS)
    got = {(r["file_path"], r["field_id"]): r["violations"] for r in profile.check_statistics(spark.createDataFrame(cases, ENTRY), fields).collect()}
    assert got == {
        ("negative", 2): ["bad_count", "count_mismatch"], ("nulls_over", 2): ["bad_count"], ("required", 1): ["bad_count"], ("count", 1): ["count_mismatch"], ("count", 2): ["count_mismatch"], ("nan", 1): ["unreadable_bound"], ("wide", 1): ["unreadable_bound"], ("text", 1): ["unreadable_bound"],
        ("crossed", 1): ["crossed_bounds"], ("crossed_text", 2): ["crossed_bounds"], ("pattern", 2): ["pattern"], ("line_end", 2): ["pattern"], ("text_nan", 2): ["pattern"], ("text_null", 2): ["unreadable_bound"],
    }
    assert profile.check_statistics(spark.createDataFrame([], ENTRY), fields).count() == 0


def test_null_shift(spark):
    fields = spark.createDataFrame([("t", 1, "long", False, None, "")], FIELDS)
    one = lambda name, seq, n, values=300: ("t", name, seq, None, {"1": values}, {"1": n}, {}, {}, 0, "")
    entries = [one("a", 1, 0), one("b", 2, 0), one("same_seq", 3, 290), one("also", 3, 130), one("few", 4, 99, 99), one("repeat", 9, 299), one("repeat", 1, 299), one("noseq", None, 299)]
    found = profile.check_statistics(spark.createDataFrame(entries, ENTRY), fields)
    # "repeat" counts with sequence 1, so it has no predecessors and is one of those of the others: 299 of 600 before 2, 299 of 900 before 3
    assert {r["file_path"] for r in found.collect()} == {"b", "same_seq"}


def test_profile_statistics(spark):
    fields = spark.createDataFrame([("t", 1, "long", False, None, ""), ("t", 2, "string", False, None, "")], FIELDS)
    entries = [
        ("t", "a", 1, 9, {"1": 10, "2": 10}, {"1": 2, "2": 0}, {"1": "9", "2": "b"}, {"1": "10", "2": "c"}, 0, ""), ("t", "a", 1, 9, {"1": 10, "2": 10}, {"1": 2, "2": 0}, {"1": "9", "2": "b"}, {"1": "10", "2": "c"}, 0, ""),
        ("t", "b", 2, 9, {"1": 30, "2": 5}, {"1": 31, "2": None}, {"1": "oops", "2": None}, {"1": '{"t": "int", "v": 7}'}, 0, ""), ("t", "c", 2, 9, None, None, None, None, 0, ""), (None, "d", 2, 9, {"1": 1}, {"1": 1}, None, None, 0, ""),
    ]
    got = {r["field_id"]: r for r in profile.profile_statistics(spark.createDataFrame(entries, ENTRY), fields).collect()}
    assert set(got) == {1, 2}
    assert tuple(got[1])[2:] == (2, 10, 2, 0.2, 9.0, 10.0, None, None)
    assert tuple(got[2])[2:] == (2, 10, 0, 0.0, None, None, "b", "c")
    assert profile.profile_statistics(spark.createDataFrame([], ENTRY), fields).count() == 0


def test_profile_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (10, "b1", None), (9, None, None), (9, "a", None)], "n long, s string, void string")
    got = {r["column"]: r for r in profile.profile_columns(df, ["n", "s", "void"], {"s": "[a-z]"}).collect()}
    assert (got["n"]["min_value"], got["n"]["max_value"], got["n"]["distinct_values"], got["n"]["top_count"]) == ("1", "10", 3, 2)
    assert (got["s"]["nulls"], got["s"]["null_rate"], got["s"]["pattern_violations"]) == (1, 0.25, 1)
    assert (got["void"]["nulls"], got["void"]["distinct_values"], got["void"]["min_value"]) == (4, 0, None)
    empty = profile.profile_columns(df.limit(0), ["n", "s"]).collect()
    assert [(r["rows"], r["null_rate"]) for r in empty] == [(0, None)] * 2


def test_load_drift(spark):
    rng = np.random.default_rng(1)
    data = [(i, int(new), float(rng.normal(5 if new else 0)), str(rng.choice(list("abcd"))), None if rng.random() < 0.1 else float(rng.normal())) for i in range(3000) for new in [i % 3 == 0]]
    df = spark.createDataFrame(data, "id long, new int, moved double, kind string, same double")
    got = {r["column"]: r for r in profile.load_drift(df, F.col("new") == 1, ["moved", "kind", "same"], ["id"]).collect()}
    assert got["*"]["auc"] > 0.95 and got["moved"]["auc_drop"] > 0.3 and abs(got["kind"]["auc_drop"]) < 0.05 and abs(got["same"]["auc_drop"]) < 0.05
    still = {r["column"]: r["auc"] for r in profile.load_drift(df, F.col("new") == 1, ["kind", "same"], ["id"]).collect()}
    assert abs(still["*"] - 0.5) < 0.06
    one = profile.load_drift(df, F.lit(False), ["kind"], ["id"]).collect()
    assert [r["auc"] for r in one] == [None, None]


def test_period_drift_of_times_between_older_loads(spark):
    rng = np.random.default_rng(2)
    t0, day, data = 1_700_000_000_000, 86_400_000, []
    for i in range(4000):
        period = i % 4
        loaded = t0 + period * 90 * day + int(rng.integers(0, 90 * day))
        started = loaded - int(rng.integers(60_000, 600_000))
        completed = None if period >= 2 and rng.random() < 0.5 else started + 1000
        data.append((i, period, started // 1000 if period == 1 and rng.random() < 0.8 else started, completed, loaded))
    df = spark.createDataFrame(data, "id long, period int, started_at long, completed_at long, at long").withColumn("loaded_at", F.timestamp_millis("at"))
    columns = ["started_at", "completed_at"]
    times = {c: profile.time_feature(F.col(c), F.col("loaded_at")) for c in columns}
    got = {(r["period_old"], r["period_new"], r["column"]): r for r in profile.period_drift(df, F.col("period"), columns, ["id"], times).collect()}
    assert {k[:2] for k in got} == {(0, 1), (1, 2), (2, 3)} and len(got) == 9
    assert got[0, 1, "started_at"]["auc_drop"] > 0.3 and abs(got[0, 1, "completed_at"]["auc_drop"]) < 0.05  # a change of unit
    assert got[1, 2, "completed_at"]["auc_drop"] > 0.02 and got[1, 2, "*"]["auc"] > 0.9  # nulls rise
    assert abs(got[2, 3, "*"]["auc"] - 0.5) < 0.06  # time passes, nothing else
    one = profile.period_drift(df.where("period = 1"), F.col("period"), columns, ["id"], times).collect()
    assert [(r["period_old"], r["period_new"], r["auc"], r["rows_new"]) for r in one] == [(None, 1, None, 1000)] * 3


def test_p4_drift_has_all_columns_and_periods(spark, data):
    from siltstone.plans import pipeline_queries

    found = pipeline_queries.p4_drift(spark, data).collect()
    assert {r["column"] for r in found} == {"*", *pipeline_queries.TASK_COLUMNS}
    assert all(r["period_old"] is None or r["period_old"] < r["period_new"] for r in found)


# ---- problem 5 ----


def brute(links):
    out = {}
    for n in links:
        path, at = [n], n
        while links[at] in links and links[at] not in path:
            at = links[at]
            path.append(at)
        if links[at] in links:
            ring = path[path.index(links[at]) :]
            out[n] = (min(ring), -1, None)
        else:
            out[n] = (at, len(path) - 1, path[::-1])
    return out


def graph(kind, n, seed):
    rng = random.Random(seed)
    ids = list({rng.randrange(-(2**62), 2**62) for _ in range(n)})
    if kind == "chain":
        return {ids[i]: ids[i - 1] if i else None for i in range(n)}
    if kind == "circle":
        return {ids[i]: ids[i - 1] for i in range(n)}
    if kind == "tree":
        return {ids[i]: ids[rng.randrange(max(0, i - 5), i)] if i else 7 for i in range(n)}
    return {i: rng.choice([*ids, None, 123]) if kind == "random" else rng.choice(ids) for i in ids}


@pytest.mark.parametrize(("kind", "n"), [("chain", 40), ("circle", 30), ("tree", 50), ("random", 50), ("dense", 40)])
@pytest.mark.parametrize("per_task", [7, 1000])
def test_hierarchy(spark, kind, n, per_task):
    links = graph(kind, n, n)
    data = [(k, v, i) for i, (k, v) in enumerate(links.items())]
    df = spark.createDataFrame(data + data[:3] + [(None, 5, 0)], "node long, parent long, root long").repartition(3)
    wanted = brute(links)
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy.resolve_hierarchy(df, "node", "parent", ["root"], per_task).collect()}
    assert got == {k: v[:2] for k, v in wanted.items()}
    paths = hierarchy.hierarchy_paths(df, "node", "parent", ["root"], per_task)
    assert {r["id"]: r["path"] for r in paths.collect()} == {k: v[2] for k, v in wanted.items() if v[2]}
    if kind in ("circle", "dense") or per_task > 7:
        return
    nested = {r["id"]: r for r in hierarchy.nested_intervals(df, "node", "parent", ["root"], per_task).collect()}
    assert nested.keys() == {k for k, v in wanted.items() if v[2]}
    below = {(a, k) for k, v in wanted.items() if v[2] for a in v[2][:-1]}
    assert below == {(a, k) for a, x in nested.items() for k, y in nested.items() if x["root"] == y["root"] == wanted[k][0] and x["enter"] < y["enter"] and y["leave"] < x["leave"]}
    assert all(x["descendants"] == sum(a == k for a, _ in below) and 0 <= x["enter"] < x["leave"] for k, x in nested.items())


@pytest.mark.parametrize(("kind", "per_task"), [("circle", 7), ("dense", 7), ("dense", 1000), ("random", 1000), ("tree", 1000)])
def test_descendants_of_every_node(spark, kind, per_task):
    """Nodes on and before circles and those without descendants included."""
    links = graph(kind, 40, 40) | {90: 90, 91: 90, 92: None, 93: 12345}
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(links.items())], "node long, parent long, near long").repartition(3)
    got = {r["id"]: r for r in hierarchy.nested_intervals(df, "node", "parent", ["near"], per_task, circles=True).collect()}
    below = {k: set() for k in links}
    rings = set()
    for n in links:
        at, seen = links[n], set()
        while at in links and at not in seen:
            seen.add(at)
            below[at].add(n)
            at = links[at]
        rings |= {n} & seen
    assert got.keys() == links.keys() and {k for k, x in got.items() if x["on_circle"]} == rings >= {90}
    assert {k: x["root"] for k, x in got.items()} == {k: v[0] for k, v in brute(links).items()}
    for k, x in got.items():
        assert {j for j, y in got.items() if y["root"] == x["root"] and j != k and (x["on_circle"] or x["enter"] < y["enter"] and y["leave"] < x["leave"])} == below[k] - {k}
        assert x["descendants"] == len(below[k] - {k})
    for root in {x["root"] for x in got.values()}:
        own = [x for x in got.values() if x["root"] == root]
        assert sorted(s for x in own for s in (x["enter"], x["leave"])) == list(range(2 * len(own)))


def test_a_chain_is_merged_over_levels(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(hierarchy, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    df = spark.createDataFrame([(i, i - 1) for i in range(1, 200)], "node long, parent long").repartition(3)
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy.resolve_hierarchy(df, "node", "parent", ["node"], 7).collect()}
    assert got == {i: (1, i - 1) for i in range(1, 200)} and labels.count("forest") >= 3 and "jump" not in labels


def test_a_parent_of_most_nodes(spark):
    df = spark.createDataFrame([(i, 0 if i else None) for i in range(300)] + [(1000, 5), (1001, 1000)], "node long, parent long")
    got = {r["id"]: r["descendants"] for r in hierarchy.nested_intervals(df, "node", "parent", rows_per_task=50).collect()}
    assert got == {i: 0 for i in range(300)} | {0: 301, 5: 2, 1000: 1, 1001: 0}


def test_hierarchy_edges(spark):
    kind = "node long, parent long"
    assert hierarchy.resolve_hierarchy(spark.createDataFrame([], kind), "node", "parent").count() == 0
    assert hierarchy.hierarchy_paths(spark.createDataFrame([], kind), "node", "parent").count() == 0
    assert hierarchy.nested_intervals(spark.createDataFrame([], kind), "node", "parent").count() == 0
    data = [(1, 1), (2, 1), (3, None), (4, 3), (4, 99), (5, 98)]
    got = {r["id"]: (r["root"], r["depth"]) for r in hierarchy.resolve_hierarchy(spark.createDataFrame(data, kind), "node", "parent").collect()}
    assert got == {1: (1, -1), 2: (1, -1), 3: (3, 0), 4: (3, 1), 5: (5, 0)}
