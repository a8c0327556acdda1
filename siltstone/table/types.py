"""The schema model: declared fields, their Spark and Arrow types, and what a literal may be compared with."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import types as T

# The type names of fields.
PRIMITIVES: dict[str, tuple[T.DataType, pa.DataType]] = {
    "boolean": (T.BooleanType(), pa.bool_()),
    "int": (T.IntegerType(), pa.int32()),
    "long": (T.LongType(), pa.int64()),
    "float": (T.FloatType(), pa.float32()),
    "double": (T.DoubleType(), pa.float64()),
    "date": (T.DateType(), pa.date32()),
    "time": (T.StringType(), pa.time64("us")),  # replaced in spark_type
    "timestamp": (T.TimestampNTZType(), pa.timestamp("us")),
    "string": (T.StringType(), pa.string()),
    "uuid": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "fixed": (T.BinaryType(), pa.binary()),
}

_LIST = re.compile(r"list<(.+)>")
_LITERALS: dict[str, tuple[type, ...]] = {
    "boolean": (bool,),
    "int": (int, float),
    "long": (int, float),
    "float": (int, float),
    "double": (int, float),
    "date": (dt.date,),
    "time": (dt.time,),
    "timestamp": (dt.datetime,),
    "string": (str,),
    "uuid": (str,),
    "binary": (bytes, bytearray),
    "fixed": (bytes, bytearray),
}


def _element(name: str) -> str | None:
    m = _LIST.fullmatch(name)
    return m[1] if m else None


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type name; ``ValueError`` if there is no such type."""
    if (element := _element(name)) is not None:
        return T.ArrayType(spark_type(element))
    if name == "time":
        return T.TimeType(6)
    if name not in PRIMITIVES:
        raise ValueError(f"unknown field type {name!r}; known are {', '.join(PRIMITIVES)} and list<...>")
    return PRIMITIVES[name][0]


def arrow_type(name: str) -> pa.DataType:
    """The Arrow type of a type name."""
    if (element := _element(name)) is not None:
        return pa.list_(arrow_type(element))
    if name not in PRIMITIVES:
        raise ValueError(f"unknown field type {name!r}")
    return PRIMITIVES[name][1]


def type_name(kind: T.DataType) -> str:
    """The type name of a Spark type; ``ValueError`` for maps, structs, decimals and others that are not supported."""
    if isinstance(kind, T.ArrayType):
        return f"list<{type_name(kind.elementType)}>"
    if kind.typeName() == "time" or type(kind).__name__ == "TimeType":
        return "time"
    names = {"boolean": "boolean", "integer": "int", "long": "long", "float": "float", "double": "double", "date": "date", "timestamp_ntz": "timestamp", "string": "string", "binary": "binary"}
    if kind.typeName() not in names:
        raise ValueError(f"columns of type {kind.simpleString()} are not supported")
    return names[kind.typeName()]


@dataclass(frozen=True)
class Field:
    """A column: id and name unique in the schema, type name, and whether nulls are refused."""

    id: int
    name: str
    type: str
    required: bool = False

    def accepts(self, literal: object) -> bool:
        """Whether a value can be compared with this column without any cast between kinds."""
        kinds = _LITERALS.get(self.type)
        if kinds is None:
            return False
        if isinstance(literal, bool) and self.type != "boolean":
            return False
        if self.type == "date" and isinstance(literal, dt.datetime):
            return False
        return isinstance(literal, kinds)


@dataclass(frozen=True)
class Schema:
    """An ordered list of fields. Fields may be given as :class:`Field` or as dicts with id, name, type and required."""

    fields: tuple[Field, ...] = ()
    schema_id: int = 0
    by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __init__(self, fields: list | tuple = (), schema_id: int = 0):
        made = []
        for f in fields:
            if isinstance(f, Field):
                made.append(f)
                continue
            missing = [k for k in ("id", "name", "type") if f.get(k) is None]
            if missing:
                raise ValueError(f"field {f!r} lacks {', '.join(missing)}")
            kind = f["type"]["type"] if isinstance(f["type"], dict) else f["type"]
            made.append(Field(int(f["id"]), f["name"], kind, bool(f.get("required", False))))
        for f in made:
            spark_type(f.type)
        for what in ("id", "name"):
            values = [getattr(f, what) for f in made]
            if len(set(values)) != len(values):
                raise ValueError(f"field {what}s must be unique: {values}")
        object.__setattr__(self, "fields", tuple(made))
        object.__setattr__(self, "schema_id", schema_id)
        object.__setattr__(self, "by_name", {f.name: f for f in made})

    @classmethod
    def of(cls, struct: T.StructType, required: tuple[str, ...] = ()) -> Schema:
        """The schema of a DataFrame; ``required`` names the columns that refuse nulls."""
        return cls([Field(i + 1, f.name, type_name(f.dataType), f.name in required) for i, f in enumerate(struct.fields)])

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def struct(self) -> T.StructType:
        """As a Spark schema; every column may be null, as Parquet is always read so. Ids are in the metadata."""
        return T.StructType([T.StructField(f.name, spark_type(f.type), True, {"id": f.id}) for f in self.fields])

    def arrow(self) -> pa.Schema:
        return pa.schema([pa.field(f.name, arrow_type(f.type)) for f in self.fields])

    def signature(self) -> frozenset:
        """What two schemas must agree in: names, types and required, not ids or order."""
        return frozenset((f.name, f.type, f.required) for f in self.fields)

    def as_dicts(self) -> list[dict]:
        return [{"id": f.id, "name": f.name, "type": f.type, "required": f.required} for f in self.fields]


@dataclass(frozen=True)
class PartitionField:
    source_id: int
    field_id: int
    name: str
    transform: str = "identity"


@dataclass(frozen=True)
class PartitionSpec:
    """Kept with the table; files carry partition values, and no transform is evaluated."""

    spec_id: int = 0
    fields: tuple[PartitionField, ...] = ()


@dataclass(frozen=True)
class SortField:
    source_id: int
    direction: str = "asc"
    null_order: str = "nulls-first"


@dataclass(frozen=True)
class SortOrder:
    """Kept with the table; :meth:`siltstone.table.Table.append_df` sorts by what its caller names."""

    order_id: int = 0
    fields: tuple[SortField, ...] = ()


def arrow_records(records: list[dict], schema: Schema) -> pa.Table:
    """Records as an Arrow table in the schema's types.

    ``ValueError`` names the record if it has a field the schema lacks, or lacks or
    nulls a required one; values the type cannot hold raise as well, a fraction for a whole number among them.
    """
    names, required = set(schema.names), [f.name for f in schema.fields if f.required]
    whole = [f.name for f in schema.fields if f.type in ("int", "long")]
    for i, r in enumerate(records):
        unknown = [k for k in r if k not in names]
        if unknown:
            raise ValueError(f"record {i} has unknown fields {unknown}")
        absent = [k for k in required if r.get(k) is None]
        if absent:
            raise ValueError(f"record {i} lacks required fields {absent}")
        for k in whole:
            if isinstance(r.get(k), float) and not r[k].is_integer():
                raise ValueError(f"record {i}: {r[k]} is no whole number for field {k}")
    try:
        return pa.Table.from_pylist(records, schema=schema.arrow())
    except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
        raise ValueError(f"records do not have the types of the schema: {e}") from e
