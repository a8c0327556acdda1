"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_path(path: Column, location: Column) -> Column:
    """``path`` relative to its table's ``location``.

    Leading slashes and the location prefix do not count; every other character
    does. Null stays null, a null location only strips the slashes.
    """
    bare = F.ltrim(path, F.lit("/"))
    prefix = F.concat(F.rtrim(F.ltrim(location, F.lit("/")), F.lit("/")), F.lit("/"))
    inside = F.coalesce(bare.startswith(prefix), F.lit(False)) & (F.length(prefix) > 1)
    return F.when(inside, F.ltrim(F.substr(bare, F.length(prefix) + 1), F.lit("/"))).otherwise(bare)


def epoch_millis(value: Column) -> Column:
    """Epoch milliseconds from a value in seconds, milliseconds, microseconds or nanoseconds.

    The unit is told from the magnitude, which is unambiguous between 1973 and 5138.
    """
    size = F.abs(value)
    return (
        F.when(size < F.lit(10**11), value * 1000)
        .when(size < F.lit(10**14), value)
        .when(size < F.lit(10**17), F.floor(value / 1000))
        .otherwise(F.floor(value / 1_000_000))
        .cast("long")
    )


def partition_key(values: Column) -> Column:
    """A map of partition values as one canonical string; null and empty are the same."""
    entries = F.array_sort(F.map_entries(values))
    return F.when(values.isNull() | (F.size(values) == 0), F.lit("")).otherwise(F.to_json(entries))


def bound_text(bound: Column) -> Column:
    """The text of a column bound written as ``{"t": ..., "v": ...}`` or bare; of a value that is no valid JSON, such as NaN, what stands there. Null if there is none."""
    tagged = bound.rlike(r'^\s*\{\s*"t"\s*:')
    raw = F.nullif(F.nullif(F.regexp_extract(bound, r'"v"\s*:\s*([^"\s{}]+)\s*\}\s*$', 1), F.lit("null")), F.lit(""))
    return F.when(tagged, F.coalesce(F.get_json_object(bound, "$.v"), raw)).otherwise(bound)


def bound_number(text: Column, kind: Column) -> tuple[Column, Column]:
    """(as long, as double) of a bound's text for the field types int, long, float and double.

    What the type cannot hold, NaN among it, is null.
    """
    as_long = F.when(text.rlike(r"^[+-]?[0-9]{1,19}$"), text.try_cast("long"))
    as_long = F.when((kind == "int") & ~as_long.between(-(2**31), 2**31 - 1), F.lit(None)).otherwise(as_long)
    as_double = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(Infinity|inf|Inf)$"), text.try_cast("double"))
    return F.when(kind.isin("int", "long"), as_long), F.when(kind.isin("float", "double"), as_double)


def matches_whole(text: Column, pattern: Column) -> Column:
    """Whether the regular expression matches the whole text (not merely up to a final line end)."""
    return F.regexp_like(text, F.concat(F.lit(r"\A(?:"), pattern, F.lit(r")\z")))
