"""Data quality profiles: checks of file statistics, exact base aggregates, and a classifier test for change between loads."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.columns import bound_number, bound_text, epoch_millis, matches_whole
from siltstone.operators.joins import lookup_join
from siltstone.operators.scans import sums_before
from siltstone.session import materialize

#: Sequence numbers of one table and field are cut into blocks of so many.
SEQUENCE_BLOCK = 256

#: What check_statistics can report.
VIOLATIONS = ("bad_count", "count_mismatch", "unreadable_bound", "crossed_bounds", "pattern", "null_shift")


def file_statistics(entries: DataFrame) -> DataFrame:
    """One row per entry and field of its statistics; entries without statistics give none.

    ``entries``: table_uuid, file_path, seq, record_count and the maps value_counts, null_value_counts,
    lower_bounds, upper_bounds keyed by field id (text). Fields whose id is no number are left out.
    """
    keys = F.array_distinct(F.concat(*[F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("value_counts", "null_value_counts")]))
    rows = entries.select("table_uuid", "file_path", "seq", "record_count", "value_counts", "null_value_counts", "lower_bounds", "upper_bounds", F.explode(keys).alias("key"))
    at = lambda m: F.try_element_at(m, F.col("key"))
    return rows.select(
        "table_uuid", "file_path", "seq", "record_count", F.col("key").try_cast("int").alias("field_id"),
        at(F.col("value_counts")).alias("n_values"), at(F.col("null_value_counts")).alias("n_nulls"),
        bound_text(at(F.col("lower_bounds"))).alias("lower"), at(F.col("lower_bounds")).isNotNull().alias("has_lower"),
        bound_text(at(F.col("upper_bounds"))).alias("upper"), at(F.col("upper_bounds")).isNotNull().alias("has_upper"),
    ).where("field_id is not null")


def _violations(stats: DataFrame) -> dict[str, Column]:
    """The checks that need one statistic and its field only."""
    c = F.col
    low_long, low_double = bound_number(c("lower"), c("field_type"))
    up_long, up_double = bound_number(c("upper"), c("field_type"))
    is_whole, is_real, is_text = c("field_type").isin("int", "long"), c("field_type").isin("float", "double"), c("field_type") == "string"
    no = F.lit(False)

    def unreadable(has: Column, text: Column, as_long: Column, as_double: Column) -> Column:
        return has & F.when(is_whole, as_long.isNull()).when(is_real, as_double.isNull()).when(is_text, text.isNull()).otherwise(no)

    crossed = F.when(is_whole, low_long > up_long).when(is_real, low_double > up_double).when(is_text, c("lower") > c("upper"))
    off = lambda has, text: has & c("value_pattern").isNotNull() & text.isNotNull() & ~matches_whole(text, c("value_pattern"))
    return {
        "bad_count": (c("n_values") < 0) | (c("n_nulls") < 0) | (c("n_nulls") > c("n_values")) | (c("required") & (c("n_nulls") > 0)),
        "count_mismatch": c("record_count").isNotNull() & (c("record_count") != c("n_values")),
        "unreadable_bound": unreadable(c("has_lower"), c("lower"), low_long, low_double) | unreadable(c("has_upper"), c("upper"), up_long, up_double),
        "crossed_bounds": crossed,
        "pattern": off(c("has_lower"), c("lower")) | off(c("has_upper"), c("upper")),
    }


def check_statistics(entries: DataFrame, fields: DataFrame, min_values: int = 100, min_pool: int = 500, max_shift: float = 0.4) -> DataFrame:
    """Each file and field whose statistics break a rule: table_uuid, file_path, field_id, violations.

    ``fields``: table_uuid, field_id, field_type, required, value_pattern; fields not
    listed there are not checked. ``violations`` lists the broken rules: counts that
    are negative, exceed each other or show nulls in a required field; counts that
    differ from record_count; bounds that cannot be read in the field's type, are
    crossed, or do not match the pattern as a whole; a null share that differs by more
    than ``max_shift`` from the pooled share of the field over the table's files with a
    smaller sequence number (files with 0 <= nulls <= values, at least ``min_pool`` values
    together, ``min_values`` in the file itself). An entry delivered or listed again
    counts once; a file breaks a rule if one of its entries does. Files without a
    sequence number have no predecessors and are none.
    """
    stats = lookup_join(file_statistics(entries), fields.select("table_uuid", "field_id", "field_type", "required", "value_pattern"), ["table_uuid", "field_id"], salt_by=["file_path"])
    broken = _violations(stats)
    flags = [F.max(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in broken.items()]
    counts = F.struct(F.coalesce("seq", F.lit(2**62)).alias("s"), "n_values", "n_nulls")
    files = stats.groupBy("table_uuid", "file_path", "field_id").agg(F.min("seq").alias("first_seq"), F.min(counts).alias("c"), *flags)
    files = materialize(files.withColumns({"n_values": F.col("c.n_values"), "n_nulls": F.col("c.n_nulls")}).drop("c"), "statistics")  # read three times below
    sound = files.where("n_nulls between 0 and n_values").select("table_uuid", "field_id", "first_seq", F.lit(0).alias("probe"), "n_values", "n_nulls")
    probes = files.where("first_seq is not null").select("table_uuid", "field_id", "first_seq", F.lit(1).alias("probe"), F.lit(0).cast("long").alias("n_values"), F.lit(0).cast("long").alias("n_nulls"))
    pool = sums_before(sound.unionByName(probes), ["table_uuid", "field_id"], "first_seq", ["n_values", "n_nulls"], SEQUENCE_BLOCK)
    joined = files.join(pool, ["table_uuid", "field_id", "first_seq"], "left")
    shift = (F.col("n_values") >= min_values) & (F.col("n_values_before") >= min_pool) & (F.abs(F.col("n_nulls") / F.col("n_values") - F.col("n_nulls_before") / F.col("n_values_before")) > max_shift)
    named = [F.when(F.col(v), F.lit(v)) for v in broken] + [F.when(shift, F.lit("null_shift"))]
    return joined.select("table_uuid", "file_path", "field_id", F.array_compact(F.array(*named)).alias("violations")).where("size(violations) > 0")


def profile_statistics(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """A profile of each table's fields from file statistics alone: no data is read.

    Gives table_uuid, field_id, files, n_values, n_nulls, null_rate, min_number, max_number, min_text, max_text. Only counts with 0 <= nulls <= values are summed,
    only bounds that can be read in the field's type make the range. A file counts once; if its entries differ, with the smallest counts
    and the widest range. Fields that are not listed in ``fields`` (see :func:`check_statistics`) are left out.
    """
    stats = lookup_join(file_statistics(entries), fields.select("table_uuid", "field_id", "field_type"), ["table_uuid", "field_id"], salt_by=["file_path"])
    numbers = {side: F.coalesce(*[n.cast("double") for n in bound_number(F.col(side), F.col("field_type"))]) for side in ("lower", "upper")}
    texts = {side: F.when(F.col("field_type") == "string", F.col(side)) for side in ("lower", "upper")}
    sound = F.col("n_nulls").between(0, F.col("n_values"))
    one = stats.groupBy("table_uuid", "file_path", "field_id").agg(
        F.min(F.when(sound, F.col("n_values"))).alias("n_values"), F.min(F.when(sound, F.col("n_nulls"))).alias("n_nulls"),
        F.min(numbers["lower"]).alias("min_number"), F.max(numbers["upper"]).alias("max_number"), F.min(texts["lower"]).alias("min_text"), F.max(texts["upper"]).alias("max_text"),
    )
    out = one.groupBy("table_uuid", "field_id").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_values"), F.coalesce(F.sum("n_nulls"), F.lit(0)).alias("n_nulls"),
        F.min("min_number").alias("min_number"), F.max("max_number").alias("max_number"), F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
    )
    return out.select("table_uuid", "field_id", "files", "n_values", "n_nulls", F.when(F.col("n_values") > 0, F.col("n_nulls") / F.col("n_values")).alias("null_rate"), "min_number", "max_number", "min_text", "max_text")


def profile_columns(df: DataFrame, columns: Sequence[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Exact base aggregates of each column: column, rows, nulls, null_rate, distinct_values, min_value, max_value, top_count, pattern_violations.

    Values are compared as text, numbers in numeric order for min_value and max_value.
    Equal values are counted before the shuffle, so a hot value is one row per
    task. An empty table gives a row per column with zero rows and null rate null.
    """
    patterns = patterns or {}
    numeric = {n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    value = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"))
    cells = df.select(F.explode(F.array(*[value(c) for c in columns])).alias("x")).select("x.*")
    counted = cells.groupBy("column", "value", "number").agg(F.count(F.lit(1)).alias("n"))
    bad = F.lit(False)
    for c, p in patterns.items():
        bad = F.when((F.col("column") == c) & F.col("value").isNotNull(), ~F.col("value").rlike(rf"\A(?:{p})\z")).otherwise(bad)
    known = F.when(F.col("value").isNotNull(), F.struct("number", "value"))
    out = counted.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"), F.min(known)["value"].alias("min_value"), F.max(known)["value"].alias("max_value"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top_count"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("pattern_violations"),
    )
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    full = named.join(out, "column", "left").fillna(0, ["rows", "nulls", "distinct_values", "pattern_violations"])
    return full.select("column", "rows", "nulls", F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).alias("null_rate"), "distinct_values", "min_value", "max_value", "top_count", "pattern_violations")


def period_shares(df: DataFrame, period: Column, columns: Sequence[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Per period and column the exact shares of nulls and of values off the column's pattern: period, column, rows, null_share, bad_share, and by how much they differ from the period with rows before (null for the first).

    ``period`` is a whole number; rows where it is null are left out. Rows are counted per task before the shuffle. An empty table gives no rows.
    """
    patterns = patterns or {}
    own = df.withColumn("__period", period.cast("long")).where("__period is not null")
    bad = lambda c: F.count_if(~F.col(c).cast("string").rlike(rf"\A(?:{patterns[c]})\z")) if c in patterns else F.lit(0).cast("long")
    counts = own.groupBy("__period").agg(F.count(F.lit(1)).alias("__rows"), *[x for i, c in enumerate(columns) for x in (F.count_if(F.col(c).isNull()).alias(f"__n{i}"), bad(c).alias(f"__b{i}"))])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n"), F.col(f"__b{i}").alias("b")) for i, c in enumerate(columns)]))
    rows = counts.select(F.col("__period").alias("period"), F.col("__rows").alias("rows"), cells.alias("x")).select("period", "x.column", "rows", (F.col("x.n") / F.col("rows")).alias("null_share"), (F.col("x.b") / F.col("rows")).alias("bad_share"))
    before = Window.partitionBy("column").orderBy("period")  # a row per period
    return rows.select("*", (F.col("null_share") - F.lag("null_share").over(before)).alias("null_change"), (F.col("bad_share") - F.lag("bad_share").over(before)).alias("bad_change"))


def time_feature(value: Column, loaded_at: Column) -> Column:
    """What of an epoch time can be compared between loads: its number of digits (the unit) and the magnitude of its distance from ``loaded_at``; null stays null.

    The distance takes out the plain passage of time, which would tell any two loads apart; frozen values move away from ``loaded_at``.
    """
    seconds = (F.unix_millis(loaded_at.cast("timestamp")) - epoch_millis(value)) / 1000
    distance = F.round(F.signum(seconds) * F.log1p(F.abs(seconds)) * 2).cast("long")
    return F.when(value.isNotNull(), F.concat_ws("/", F.length(F.abs(value).cast("string")), F.coalesce(distance.cast("string"), F.lit("?"))))


def _features(df: DataFrame, columns: Sequence[str], bins: int) -> list[Column]:
    """Each column as the number of one of its bins: null, or by magnitude and leading digits (numbers), or by hash (text)."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal"):
            v = F.col(c).cast("double")
            scaled = F.round(F.signum(v) * F.log1p(F.abs(v)) * 8).cast("long")
            return F.when(v.isNull() | F.isnan(v), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(scaled), F.lit(bins - 1))).cast("int")
        return F.when(F.col(c).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(bins - 1))).cast("int")

    return [one(c).alias(f"x{i}") for i, c in enumerate(columns)]


def _arrays(batch: pa.RecordBatch, columns: int) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """The bins of each column, and the other columns by name."""
    cells = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
    return cells, {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("period", "fold", "u")}


def _logits(w: np.ndarray, cells: list[np.ndarray], bins: int) -> np.ndarray:
    z = np.full(len(cells[0]), w[-1])
    for c, x in enumerate(cells):
        z += w[c * bins : (c + 1) * bins][x]
    return z


def _sample_blocks(pairs: Sequence[tuple[int, int, int]], columns: int, folds: int):
    """A mapInArrow function: the bins of sampled rows by comparison and fold, packed for the rounds of fitting: i, f, x (bins by column), y (1: the later period)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        rows: Counter = Counter()

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            x, y = (np.concatenate(parts, axis=-1) for parts in zip(*held.pop(key), strict=True))
            rows.pop(key)
            return pa.RecordBatch.from_pydict({"i": pa.array([key[0]], pa.int32()), "f": pa.array([key[1]], pa.int32()), "x": [x.tobytes()], "y": [y.tobytes()]})

        for batch in batches:
            cells, by = _arrays(batch, columns)
            cells = np.stack(cells).astype(np.uint16)
            for i, (old, new, below) in enumerate(pairs):
                inside = ((by["period"] == old) | (by["period"] == new)) & (by["u"] < below)
                for f in range(folds):
                    at = np.flatnonzero(inside & (by["fold"] == f))
                    if len(at):
                        held.setdefault((i, f), []).append((cells[:, at], (by["period"][at] == new).astype(np.uint8)))
                        rows[i, f] += len(at)
                        if rows[i, f] >= 100_000:
                            yield block((i, f))
        for key in list(held):
            yield block(key)

    return pack


def _fit_jointly(sample: DataFrame, pairs: Sequence[tuple[int, int, int]], columns: int, folds: int, bins: int, ridge: float, rounds: int, refit_rounds: int) -> np.ndarray:
    """Logistic regressions of all comparisons, ablations and folds: weights by (pair, model, fold, bin), the intercept last.

    ``sample`` has the rows packed by :func:`_sample_blocks`. Model 0 has all columns, model i + 1 lacks
    column i; fold k is fitted on the rows of the other folds. Model 0 is fitted first; the others start from its weights, near their own, and are fitted together. Each round is one job: every task sums
    gradient and curvature of its rows for the models in hand, the
    driver adds these sums (their size depends on pairs, bins, columns and folds only) and takes a diagonal Newton step, scaled so that no round can overshoot.
    """
    models, width = columns + 1, bins * columns
    weights = np.zeros((len(pairs), models, folds, width + 1))
    used = np.ones_like(weights)
    for m in range(1, models):
        used[:, m, :, (m - 1) * bins : m * bins] = 0
    momentum = np.zeros_like(weights)
    for done in range(rounds + refit_rounds):
        if done == rounds:
            weights, momentum = weights[:, :1] * used, np.zeros_like(weights)
        w, fitted = weights.copy(), (0,) if done < rounds else range(1, models)

        def sums(batches: Iterator[pa.RecordBatch], w=w, fitted=fitted) -> Iterator[pa.RecordBatch]:
            gradient, curvature = np.zeros_like(w), np.zeros_like(w)
            for batch in batches:
                for i, f, x, y in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    own, later = np.frombuffer(x, np.uint16).reshape(columns, -1).astype(np.intp), np.frombuffer(y, np.uint8)
                    for m in fitted:
                        for k in range(folds):
                            if k == f and folds > 1:
                                continue
                            p = 1 / (1 + np.exp(-_logits(w[i, m, k], own, bins)))
                            r, h = p - later, p * (1 - p)
                            g, v = gradient[i, m, k], curvature[i, m, k]
                            for c, cell in enumerate(own):
                                if c != m - 1:
                                    g[c * bins : (c + 1) * bins] += np.bincount(cell, r, bins)
                                    v[c * bins : (c + 1) * bins] += np.bincount(cell, h, bins)
                            g[-1] += r.sum()
                            v[-1] += h.sum()
            yield pa.RecordBatch.from_pydict({"g": [gradient.tobytes()], "h": [curvature.tobytes()]})

        parts = sample.mapInArrow(sums, "g binary, h binary").collect()  # a row per task, of a size fixed by the parameters
        g = sum(np.frombuffer(p["g"]).reshape(w.shape) for p in parts) * used + ridge * w
        h = sum(np.frombuffer(p["h"]).reshape(w.shape) for p in parts) + ridge
        step = g / (h * (columns + 1) + 1.0)
        momentum = 0.7 * momentum - step
        moved = np.isin(np.arange(models), list(fitted))[None, :, None, None]
        weights = np.where(moved, (weights + momentum) * used, weights)
    return weights


_DRIFT = "period_old long, period_new long, column string, auc double, auc_drop double, shift double, p_value double, changed boolean, rows_old long, rows_new long"


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _auc_tail(auc: float, n: int, m: int) -> float:
    """The chance of an AUC at least so large between equal loads of n and m rows."""
    return _normal_tail((auc - 0.5) / math.sqrt((n + m + 1) / (12 * n * m)))


def _bins_tail(old: np.ndarray, new: np.ndarray) -> tuple[float, float]:
    """(total variation distance, chance of counts that differ so much) of the counts of the bins of two loads, by the chi-square test of homogeneity in Wilson and Hilferty's approximation."""
    both = (old + new) > 0
    a, b = old[both].astype(float), new[both].astype(float)
    n, m = a.sum(), b.sum()
    degrees = len(a) - 1
    shift = float(np.abs(a / n - b / m).sum() / 2)
    if degrees < 1:
        return shift, 1.0
    expected = np.stack([(a + b) * n, (a + b) * m]) / (n + m)
    chi = float(((np.stack([a, b]) - expected) ** 2 / expected).sum())
    spread = 2 / (9 * degrees)
    return shift, _normal_tail(((chi / degrees) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def period_drift(df: DataFrame, period: Column, columns: Sequence[str], key: Sequence[str], features: dict[str, Column] | None = None, bins: int = 64, fit_rows: int = 200_000, folds: int = 2, ridge: float = 1.0, rounds: int = 25, refit_rounds: int = 8, alpha: float = 0.01, min_auc: float = 0.52, min_shift: float = 0.05) -> DataFrame:
    """Classifier two-sample test between each period with rows and the next: period_old, period_new, column, auc, auc_drop, shift, p_value, changed, rows_old, rows_new.

    ``period`` is a whole number, of which there are few; rows where it is null are left out. ``features`` has columns whose values are
    compared in another form (see :func:`time_feature`). A logistic regression over the binned columns learns to tell the rows of the later period. It
    is fitted per fold on at most about ``fit_rows`` rows of each comparison (a sample by hash of ``key``; the
    only part that does not see all rows) and scores *all* rows of the other folds,
    so the discrimination is cross-fitted. The row with column ``*`` has the AUC of the
    full model: 0.5 is no change. Each other row is an ablation: the AUC without that
    column, refitted, and by how much it drops. Beside it stands what the exact counts of the column's bins over all rows say: ``shift``, the
    share of rows that would have to move for the bins to be alike. ``p_value`` is the chance of the AUC (row ``*``) or of the counts between equal
    loads; ``changed`` says that it is below ``alpha``, divided among the columns, and that the AUC is at least ``min_auc``, or the shift at least
    ``min_shift``. Fewer than two periods give null figures and a null period_old.
    """
    spark = df.sparkSession
    names = ["*", *columns]
    own = df.withColumns({f"_f{i}": (features or {}).get(c, F.col(c)) for i, c in enumerate(columns)})
    rows = own.select(*_features(own, [f"_f{i}" for i in range(len(columns))], bins), period.cast("long").alias("period"), F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int").alias("fold"), F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1_000_000)).alias("u")).where("period is not null")
    rows = materialize(rows, "drift-rows")  # read by three jobs
    sizes = {r["period"]: r["n"] for r in rows.groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(sizes)
    pairs = [(a, b, int(1_000_000 * min(1.0, fit_rows * folds / ((sizes[a] + sizes[b]) * max(1, folds - 1))))) for a, b in zip(order, order[1:], strict=False)]
    if not pairs:
        only = order[0] if order else None
        return spark.createDataFrame([(None, only, c, None, None, None, None, None, 0, sizes.get(only, 0)) for c in names], _DRIFT)
    bound: dict[int, int] = {}
    for a, b, below in pairs:
        bound |= {a: max(below, bound.get(a, 0)), b: below}
    chosen = F.lit(False)
    for at, below in bound.items():
        chosen |= (F.col("period") == at) & (F.col("u") < below)
    packed = rows.where(chosen).repartition(spark.sparkContext.defaultParallelism).mapInArrow(_sample_blocks(pairs, len(columns), folds), "i int, f int, x binary, y binary")
    sample = materialize(packed, "drift-sample")  # read in every round
    weights = _fit_jointly(sample, pairs, len(columns), folds, bins, ridge, rounds, refit_rounds).astype(np.float32)
    cells = 2000

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(pairs), len(names), folds, cells, 2), np.int64)
        marginal = np.zeros((len(order), len(columns), bins), np.int64)
        for batch in batches:
            x, by = _arrays(batch, len(columns))
            at = np.searchsorted(order, by["period"])
            for c, own in enumerate(x):
                marginal[:, c] += np.bincount(at * bins + own, minlength=len(order) * bins).reshape(len(order), bins)
            for i, (old, new, _) in enumerate(pairs):
                inside = (by["period"] == old) | (by["period"] == new)
                for k in range(folds):
                    at = np.flatnonzero(inside & (by["fold"] == k))
                    if not len(at):
                        continue
                    part, y = [c[at] for c in x], by["period"][at] == new
                    for m in range(len(names)):  # weights of a left-out column are 0
                        cell = np.minimum(cells - 1, (cells / (1 + np.exp(-_logits(weights[i, m, k], part, bins)))).astype(int))
                        counts[i, m, k] += np.bincount(cell * 2 + y, minlength=2 * cells).reshape(cells, 2)
        found, bare = np.nonzero(counts), np.nonzero(marginal)
        for columns_of in ([*found, counts[found]], [np.full(len(bare[0]), -1), bare[1], bare[0], bare[2], np.zeros(len(bare[0])), marginal[bare]]):
            yield pa.RecordBatch.from_pydict({n: pa.array(v.astype(np.int64), pa.int64()) for n, v in zip("imkcyn", columns_of, strict=True)})

    scored = rows.mapInArrow(histogram, "i long, m long, k long, c long, y long, n long")
    table = scored.groupBy("i", "m", "k", "c", "y").agg(F.sum("n").alias("n")).toPandas()  # at most pairs x models x folds x cells x 2 rows, and periods x columns x bins
    bare, table = table[table.i < 0], table[table.i >= 0]
    marginal = np.zeros((len(order), len(columns), bins), np.int64)
    marginal[bare.k, bare.m, bare.c] = bare.n
    counts = np.zeros((len(pairs), len(names), folds, cells, 2))
    counts[table.i, table.m, table.k, table.c, table.y] = table.n
    out = []
    for i, (old, new, _) in enumerate(pairs):
        aucs = []
        for m in range(len(names)):
            parts = []
            for h in counts[i, m]:
                below = np.concatenate([[0], np.cumsum(h[:, 0])[:-1]])
                compared = h[:, 0].sum() * h[:, 1].sum()
                if compared:
                    parts.append((float((h[:, 1] * (below + h[:, 0] / 2)).sum() / compared), h.sum()))
            aucs.append(float(np.average([a for a, _ in parts], weights=[w for _, w in parts])) if parts else None)
        sides = [order.index(old), order.index(new)]
        for m, (c, a) in enumerate(zip(names, aucs, strict=True)):
            if m:
                shift, chance = _bins_tail(*marginal[sides, m - 1])
                changed = shift >= min_shift and chance < alpha / len(columns)
            else:
                shift, chance = None, None if a is None else _auc_tail(a, sizes[old], sizes[new])
                changed = None if a is None else a >= min_auc and chance < alpha
            out.append((old, new, c, a, None if m == 0 or a is None else aucs[0] - a, shift, chance, changed, sizes[old], sizes[new]))
    return spark.createDataFrame(out, _DRIFT)


def load_drift(df: DataFrame, is_new: Column, columns: Sequence[str], key: Sequence[str], bins: int = 64, fit_rows: int = 200_000, folds: int = 2, ridge: float = 1.0, rounds: int = 25) -> DataFrame:
    """:func:`period_drift` between two loads, the rows with ``is_new`` and the others: column, auc, auc_drop, shift, p_value, changed, rows_old, rows_new. An empty load gives null figures."""
    label = F.coalesce(is_new, F.lit(False)).cast("long")
    found = period_drift(df, label, columns, key, None, bins, fit_rows, folds, ridge, rounds)
    one = found.where("period_old is null").first()
    if one is not None:
        new = one["rows_new"] if one["period_new"] == 1 else 0
        found = found.withColumns({"rows_old": F.lit(one["rows_new"] - new).cast("long"), "rows_new": F.lit(new).cast("long")})
    return found.drop("period_old", "period_new")
