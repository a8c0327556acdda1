"""Parent-child links to full hierarchies: root, depth, circles, paths, intervals of descendants.

Rows are laid out by a locality key, so that most chains lie within one partition.
Each partition joins its links into weighted disjoint sets: every node gets the top
it reaches inside and its distance. What is left, one link per top that has
its parent elsewhere, is merged in wider groups, again and again, until nothing
crosses. Distances and the smallest id on the way travel with the links, so circles
through any number of partitions are found and named as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.joins import lookup_join
from siltstone.session import materialize, task_count

_NONE = np.iinfo(np.int64).max
_FOREST = "id long, top long, dist long, least long, ext long, ext_steps long, ext_least long, circle boolean, pid int"


def contract_links(ids: np.ndarray, parents: np.ndarray, has_parent: np.ndarray, steps: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weighted disjoint sets of one partition, by path compression for all nodes at once.

    A link from ``ids[i]`` to ``parents[i]`` is ``steps[i]`` long and ``least[i]`` is the smallest id on it, without
    ``ids[i]`` and with the parent. Gives for each node its top (a node without link or with
    its parent elsewhere), the distance, the smallest id from the node to the top, the
    row of the top, and whether the node leads into a circle (then the smallest id is the circle's).
    """
    order = np.argsort(ids, kind="stable")
    place = np.searchsorted(ids, parents, sorter=order)
    place = order[np.minimum(place, len(ids) - 1)]
    inside = has_parent & (ids[place] == parents)
    jump = np.where(inside, place, np.arange(len(ids)))
    dist = np.where(inside, steps, 0)
    smallest = np.where(inside, least, _NONE)
    for _ in range(int(len(ids)).bit_length() + 1):
        further = inside[jump]
        if not further.any():
            break
        dist = np.where(further, dist + dist[jump], dist)
        smallest = np.minimum(smallest, smallest[jump])
        jump = jump[jump]
    circle = inside[jump]
    smallest = np.where(circle, smallest[jump], np.minimum(smallest, ids))
    return ids[jump], dist, smallest, jump, circle


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over the rows id, parent, steps, least, pid of one partition (bounded by rows_per_task)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    has = pc.is_valid(t["parent"]).to_numpy()
    parents = pc.fill_null(t["parent"], 0).to_numpy()
    ids, steps, least = (t[c].to_numpy() for c in ("id", "steps", "least"))
    top, dist, smallest, row, circle = contract_links(ids, parents, has, steps, least)
    ext = pa.array(parents[row], mask=~has[row] | circle)
    out = pa.table({"id": ids, "top": top, "dist": dist, "least": smallest, "ext": ext, "ext_steps": steps[row], "ext_least": least[row], "circle": circle, "pid": t["pid"].cast(pa.int32())})
    yield from out.to_batches(max_chunksize=50_000)


def _jump(links: DataFrame) -> DataFrame:
    """Resolve links by pointer doubling with joins: the last resort for links too many for one task that partitions do not contract.

    This takes links whose ends lie in partitions at random, without any locality. Each round is a join of all of them, and there are as many as
    the longest chain has binary digits: a chain of a million nodes laid out at random took 276 s on 8 local cores, the same one in order 12 s.

    links: id, parent, steps, least, parents never null. Gives id, root, dist, least, circle.
    """
    state = materialize(links.select("id", F.col("parent").alias("next"), F.col("steps").alias("dist"), "least"), "jump")
    for _ in range(int(state.count()).bit_length() + 1):
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("dist").alias("dist2"), F.col("least").alias("least2"))
        step = lookup_join(state, ahead, ["next"], "left", salt_by=["id"])
        moved = F.col("next2").isNotNull()
        state = materialize(step.select("id", F.when(moved, F.col("next2")).otherwise(F.col("next")).alias("next"), F.when(moved, F.col("dist") + F.col("dist2")).otherwise(F.col("dist")).alias("dist"), F.least("least", "least2").alias("least"), moved.alias("moved")), "jump")
        if not state.where("moved").limit(1).count():
            break
        state = state.drop("moved")
    ends = state.select(F.col("id").alias("next"), F.col("least").alias("least2"))
    done = lookup_join(state, ends, ["next"], "left", salt_by=["id"])
    circle = F.col("least2").isNotNull()
    return done.select("id", F.col("next").alias("root"), "dist", F.coalesce("least2", "least").alias("least"), circle.alias("circle"))


def _solve(links: DataFrame, rows: int, groups: int, rows_per_task: int) -> DataFrame:
    """Final root, distance and circle of each node of ``links`` (id, parent, steps, least, pid), laid out in ``groups`` partitions by pid.

    Nodes missing from the result are roots themselves.
    """
    forest = materialize(links.mapInArrow(_contract, _FOREST), "forest")
    if groups == 1:
        return forest.select("id", F.col("top").alias("root"), "dist", "least", "circle")
    tops = forest.where("id = top and ext is not null and not circle").select("id", "ext", "ext_steps", "ext_least", "pid")
    behind = forest.select(F.col("id").alias("ext"), F.col("top").alias("parent"), "dist", "least", F.col("circle").alias("into"))
    across = lookup_join(tops, behind, ["ext"], salt_by=["id"])
    # of a way into a circle only the circle's smallest id counts
    way = F.when(F.col("into"), F.col("least")).otherwise(F.least("least", "ext_least"))
    across = materialize(across.select("id", "parent", (F.col("dist") + F.col("ext_steps")).alias("steps"), way.alias("least"), "into", "pid"), "across")
    into = across.where("into").select(F.col("id").alias("root"), F.col("least").alias("into_least"))
    links_up = across.where("not into").select("id", "parent", "steps", "least", "pid")
    count = links_up.count()
    if count > max(rows_per_task, 0.7 * rows):
        upper = _jump(links_up)
    else:
        # tops that are linked to but have no link of their own are nodes of the next level as well
        ends = links_up.select(F.col("parent").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("steps"), F.lit(0).cast("long").alias("least"), "pid")
        nodes = links_up.unionByName(ends).groupBy("id").agg(F.max(F.struct("parent", "steps", "least", "pid")).alias("x")).select("id", "x.*")
        nodes = materialize(nodes, "level")
        size = nodes.count()
        wider = 1 if count <= rows_per_task else -(-size // rows_per_task)
        laid = nodes.coalesce(1) if wider == 1 else nodes.withColumn("pid", F.least(F.lit(wider - 1), F.floor(F.col("pid") * wider / groups)).cast("int")).repartition(wider, "pid")
        upper = _solve(laid, size, wider, rows_per_task)
    upper = lookup_join(upper, into, ["root"], "left", salt_by=["id"])
    upper = upper.select(F.col("id").alias("top"), F.col("root").alias("up_root"), F.col("dist").alias("up_dist"), F.coalesce("into_least", "least").alias("up_least"), (F.col("circle") | F.col("into_least").isNotNull()).alias("up_circle"))
    lower = lookup_join(forest, upper, ["top"], "left", salt_by=["id"])
    lower = lookup_join(lower, into.select(F.col("root").alias("top"), "into_least"), ["top"], "left", salt_by=["id"])
    circle = F.col("circle") | F.col("into_least").isNotNull() | F.coalesce("up_circle", F.lit(False))
    least = F.when(F.col("circle"), F.col("least")).otherwise(F.coalesce("into_least", "up_least", "least"))
    return materialize(lower.select("id", F.coalesce("up_root", "top").alias("root"), (F.col("dist") + F.coalesce("up_dist", F.lit(0))).alias("dist"), least.alias("least"), circle.alias("circle")), "solved")


def _laid_out(df: DataFrame, node: str, parent: str, locality: Sequence[str], rows_per_task: int) -> tuple[DataFrame, int, int]:
    """Distinct links in partitions by locality: (id, parent, steps, least, pid), rows, partitions."""
    near = [F.min(c).alias(f"__l{i}") for i, c in enumerate(locality)]
    links = df.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("long").alias("id")).agg(F.min(F.col(parent).cast("long")).alias("parent"), *near)
    links = materialize(links, "links")
    rows = links.count()
    tasks = task_count(df.sparkSession, rows, rows_per_task)
    spread = links.repartitionByRange(tasks, *[f"__l{i}" for i in range(len(locality))], "id")
    return spread.select("id", "parent", F.lit(1).cast("long").alias("steps"), F.coalesce("parent", F.lit(0)).alias("least"), F.spark_partition_id().alias("pid")), rows, tasks


def resolve_hierarchy(df: DataFrame, node: str, parent: str, locality: Sequence[str] = (), rows_per_task: int = 500_000) -> DataFrame:
    """Root and depth of every node: id, root, depth.

    One row per distinct non-null ``node``. A node given several times with several
    parents counts with the smallest; a null parent or one that is no node makes a
    root (depth 0). A node that leads into a circle gets the smallest id on the circle
    as root and depth -1; a node that is its own parent is a circle of one. ``locality``
    names columns by which related rows lie together (only speed depends on it). No
    task holds more than about ``rows_per_task`` nodes. An empty table gives an empty result.
    """
    links, rows, tasks = _laid_out(df, node, parent, locality, rows_per_task)
    solved = _solve(links, rows, tasks, rows_per_task)
    return solved.select("id", F.when(F.col("circle"), F.col("least")).otherwise(F.col("root")).alias("root"), F.when(F.col("circle"), F.lit(-1)).otherwise(F.col("dist")).cast("int").alias("depth"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way from the local top down to each node, by traversal of the partition's parent index."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    has = pc.is_valid(t["parent"]).to_numpy()
    ids, parents = t["id"].to_numpy(), pc.fill_null(t["parent"], 0).to_numpy()
    one = np.ones(len(ids), np.int64)
    _, dist, _, row, circle = contract_links(ids, parents, has, one, parents)
    order = np.argsort(ids, kind="stable")
    up = order[np.minimum(np.searchsorted(ids, parents, sorter=order), len(ids) - 1)]
    nodes = np.flatnonzero(~circle)
    nodes = nodes[np.argsort(dist[nodes], kind="stable")]
    ends = np.cumsum(dist[nodes] + 1)
    start = 0
    while start < len(nodes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 500_000, side="right")))
        own = nodes[start:stop]
        d = dist[own]
        offsets = np.concatenate([[0], np.cumsum(d + 1)])
        flat, current = np.empty(offsets[-1], np.int64), own.copy()
        for step in range(int(d.max()) + 1):
            on = d >= step
            flat[offsets[:-1][on] + d[on] - step] = ids[current[on]]
            current = np.where(on & (d > step), up[current], current)
        top = row[own]
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(parents[top], mask=~has[top])], names=["id", "way", "ext"])
        start = stop


def hierarchy_paths(df: DataFrame, node: str, parent: str, locality: Sequence[str] = (), rows_per_task: int = 500_000) -> DataFrame:
    """The full path of every node that reaches a root: id, path (from the root to the node).

    Nodes that lead into a circle have no path and are left out; see
    :func:`resolve_hierarchy` for the rest. Within a partition the path is read off
    its parent index; the few ways that go on elsewhere are joined by doubling.
    The result is as large as the paths together are.
    """
    circles = materialize(resolve_hierarchy(df, node, parent, locality, rows_per_task).where("depth = -1").select(F.col("id").alias("__id")), "circles")
    own = df.select(*dict.fromkeys([node, parent, *locality]))
    sound = lookup_join(own.withColumn("__id", F.col(node).cast("long")), circles, ["__id"], "left_anti").drop("__id")
    links, _, _ = _laid_out(sound, node, parent, locality, rows_per_task)
    ways = materialize(links.mapInArrow(_segments, "id long, way array<long>, ext long"), "ways")
    known = ways.select("id", "way", "ext")
    wanted = ways.where("ext is not null").select(F.col("ext").alias("id")).distinct()
    crossing = materialize(known.join(wanted, "id").select("id", F.col("way").alias("before"), F.col("ext").alias("next")), "crossing")
    rounds = int(crossing.count()).bit_length() + 1
    for _ in range(rounds):
        if not crossing.where("next is not null").limit(1).count():
            break
        ahead = crossing.select(F.col("id").alias("next"), F.col("before").alias("before2"), F.col("next").alias("next2"))
        joined = lookup_join(crossing, ahead, ["next"], "left", salt_by=["id"])
        # a parent that is no node ends the way
        crossing = materialize(joined.select("id", F.when(F.col("before2").isNotNull(), F.concat("before2", "before")).otherwise(F.col("before")).alias("before"), F.col("next2").alias("next")), "crossing")
    ends = crossing.select(F.col("id").alias("ext"), "before")
    return lookup_join(ways, ends, ["ext"], "left", salt_by=["id"]).select("id", F.when(F.col("before").isNotNull(), F.concat("before", "way")).otherwise(F.col("way")).alias("path"))


#: Ranges of ids that children are cut into; a parent of most nodes is spread over so many tasks.
_SIBLING_BUCKETS = 16


def nested_intervals(df: DataFrame, node: str, parent: str, locality: Sequence[str] = (), rows_per_task: int = 500_000, circles: bool = False) -> DataFrame:
    """Every node that reaches a root with the interval of its tree that holds its descendants: id, root, enter, leave, descendants.

    A walk around each tree enters and leaves every node once, in steps from 0, siblings by id; a node lies below another one of the same root if its interval lies within the
    other's. So all descendants are there in a row per node, however deep the trees, where pairs would grow with the square of a chain. The walk is a chain
    of links itself and is numbered by :func:`resolve_hierarchy`'s method. Nodes that lead into a circle are left out; see there for the rest.

    With ``circles`` they come too, and a column on_circle. Their root is the smallest id on the circle, and the walk is that of the tree without its
    link. Below a node on the circle lie all others of its root; below one that only leads into it those within its interval, as in any tree.
    """
    solved = materialize(resolve_hierarchy(df, node, parent, locality, rows_per_task).where("depth >= 0" if not circles else "true"), "solved")
    links, _, _ = _laid_out(df, node, parent, locality, rows_per_task)
    sound = lookup_join(links.select("id", "parent"), solved, ["id"])
    nodes = materialize(sound.select("id", "root", F.when(F.col("id") != F.col("root"), F.col("parent")).alias("parent"), F.when((F.col("id") == F.col("root")) & (F.col("depth") < 0), F.col("parent")).alias("last"), F.monotonically_increasing_id().alias("n")), "nodes")
    above = nodes.select(F.col("id").alias("parent"), F.col("n").alias("p"))
    kids = lookup_join(nodes.where("parent is not null").select("id", "n", "parent"), above, ["parent"], salt_by=["n"])
    cuts = nodes.where("parent is not null").agg(F.percentile_approx("id", [i / _SIBLING_BUCKETS for i in range(1, _SIBLING_BUCKETS)], 1000).alias("c")).first()["c"] or []
    bucket = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    kids = materialize(kids.select("id", "n", "p", bucket.alias("b")), "children")
    heads = kids.groupBy("p", "b").agg(F.min_by("n", "id").alias("head"), F.max_by("n", "id").alias("tail"))
    by_bucket = Window.partitionBy("p").orderBy("b")  # at most _SIBLING_BUCKETS rows
    heads = heads.select("p", "head", "tail", F.lead("head").over(by_bucket).alias("next_head"), F.row_number().over(by_bucket).alias("i"))
    within = kids.select("n", "p", F.lead("n").over(Window.partitionBy("p", "b").orderBy("id")).alias("next"))
    after = lookup_join(within, heads.select(F.col("tail").alias("n"), "next_head"), ["n"], "left").select("n", "p", F.coalesce("next", "next_head").alias("next"))
    first = heads.where("i = 1").select(F.col("p").alias("n"), F.col("head").alias("first"))
    enter, leave = F.col("n") * 2, F.col("n") * 2 + 1
    entered = lookup_join(nodes.select("n"), first, ["n"], "left").select(enter.alias("step"), F.coalesce(F.col("first") * 2, leave).alias("next"), "n")
    left = lookup_join(nodes.select("n"), after, ["n"], "left").select(leave.alias("step"), F.coalesce(F.col("next") * 2, F.col("p") * 2 + 1).alias("next"), "n")
    walk, rows, tasks = _laid_out(entered.unionByName(left), "step", "next", ["n"], rows_per_task)
    ranks = _solve(walk, rows, tasks, rows_per_task).select(F.expr("id div 2").alias("n"), F.pmod("id", F.lit(2)).alias("side"), "dist", F.expr("root div 2").alias("top"))
    ends = ranks.groupBy("n").agg(F.max(F.when(F.col("side") == 0, F.col("dist"))).alias("e"), F.max(F.when(F.col("side") == 1, F.col("dist"))).alias("l"), F.max("top").alias("top"))
    ends = materialize(ends, "intervals")
    length = ends.where("n = top").select("top", F.col("e").alias("total"))
    placed = lookup_join(ends, length, ["top"], salt_by=["n"]).select("n", (F.col("total") - F.col("e")).alias("enter"), (F.col("total") - F.col("l")).alias("leave"))
    intervals = lookup_join(nodes.select("n", "id", "root", "last"), placed, ["n"])
    below = F.expr("(leave - enter - 1) div 2")
    if not circles:
        return intervals.select("id", "root", "enter", "leave", below.alias("descendants"))
    # the circle is the way from its smallest id down to that one's parent
    intervals = materialize(intervals, "intervals")
    closed = intervals.where("last is not null").select("root", F.col("last").alias("id"), below.alias("others"))
    closed = lookup_join(closed, intervals.select("id", F.col("enter").alias("last_enter"), F.col("leave").alias("last_leave")), ["id"]).drop("id")
    found = lookup_join(intervals, closed, ["root"], "left", salt_by=["n"])
    on = F.coalesce((F.col("enter") <= F.col("last_enter")) & (F.col("last_leave") <= F.col("leave")), F.lit(False))
    return found.select("id", "root", "enter", "leave", F.when(on, F.col("others")).otherwise(below).alias("descendants"), on.alias("on_circle"))
