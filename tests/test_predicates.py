"""The filter language: what matches, what raises, and that pruning never loses a row."""

import datetime as dt
import math
import operator

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from siltstone.table import DataFile, FilterOp, Schema, create_table, parse_filter_dict
from siltstone.table.predicates import may_match, to_column
from siltstone.table.types import Field

NAN = math.nan


@pytest.fixture(autouse=True, params=["driver", "spark"])
def reader(request, monkeypatch):
    """Scans run once read by the driver and once by Spark."""
    if request.param == "spark":
        monkeypatch.setattr("siltstone.table.table.LOCAL_FILES", -1)


@pytest.fixture(scope="module")
def doubles(spark, tmp_path_factory):
    t = create_table(spark, str(tmp_path_factory.mktemp("doubles")), Schema([Field(1, "x", "double"), Field(2, "f", "float"), Field(3, "n", "long"), Field(4, "s", "string"), Field(5, "b", "boolean"), Field(6, "I", "int")]))
    t.append_records([{"x": 1.0, "f": 0.1, "n": 1, "s": "a", "b": True, "I": 5}, {"x": NAN, "f": NAN, "n": 2, "s": "b"}, {"n": 3}, {"x": 2.0, "f": 2.0, "n": 4, "s": "c", "b": False}])
    return t


@pytest.mark.parametrize(
    ("condition", "wanted"),
    [
        ((">", 1.0), [2.0]), ((">=", 1.0), [1.0, 2.0]), (("<", 2.0), [1.0]), (("<=", 2.0), [1.0, 2.0]), (1.0, [1.0]), (("==", NAN), []), ((">=", NAN), []), ((">", NAN), []), (("<", NAN), []), (("<=", NAN), []),
        (("!=", NAN), [1.0, "nan", 2.0]), (("!=", 1.0), ["nan", 2.0]), (("in", [NAN]), ["nan"]), (("in", [1.0, NAN]), [1.0, "nan"]), (("not_in", [NAN]), [1.0, 2.0]), (("not in", []), [1.0, "nan", 2.0]),
        (("NOTIN", [1.0, None]), ["nan", 2.0]), (("in", [1.0, None]), [1.0]), (("in", []), []), (("is_null", False), [None]), (("notnull",), [1.0, "nan", 2.0]), (("between", (1.0, 1.5)), [1.0]), ((">", 1), [2.0]),
    ],
)
def test_nan_and_null(doubles, condition, wanted):
    for rows in (doubles.scan(["x"], {"x": condition}), list(doubles.iter_records(["x"], {"x": condition}))):
        assert ["nan" if r["x"] is not None and math.isnan(r["x"]) else r["x"] for r in rows] == wanted


def test_float_literals_are_cast_in_lists_only(doubles):
    assert doubles.scan(["n"], {"f": 0.1}) == []
    assert doubles.scan(["n"], {"f": ("in", [0.1])}) == [{"n": 1}]


def test_long_against_fraction(doubles):
    assert [r["n"] for r in doubles.scan(["n"], {"n": (">", 1.5)})] == [2, 3, 4]


@pytest.mark.parametrize("bad", [{"n": "1"}, {"s": 1}, {"b": 1}, {"n": ("in", ["1"])}, {"n": True}, {"x": ("between", ("a", "b"))}])
def test_literals_of_another_kind(doubles, bad):
    with pytest.raises(TypeError):
        doubles.scan(filter=bad)


@pytest.mark.parametrize("bad", [{"i": 5}, {"zz": 1}, {"n": ("startswith", 1)}, {"n": None}, {"n": ("==", None)}, {"n": ("in", "abc")}])
def test_bad_filters(doubles, bad):
    with pytest.raises(ValueError):
        doubles.scan(filter=bad)


def test_unknown_projection(doubles):
    with pytest.raises(ValueError):
        doubles.scan(columns=["nope"])


def test_spellings():
    kinds = [parse_filter_dict({"a": (o, 1)})[0].op for o in ("eq", "=", "==", "NE", "<>", "lt", "le", "gt", "ge")]
    assert kinds == [FilterOp.EQ] * 3 + [FilterOp.NE] * 2 + [FilterOp.LT, FilterOp.LE, FilterOp.GT, FilterOp.GE]
    assert parse_filter_dict({"a": [1, 2]})[0].value == [1, 2]
    assert to_column([], Schema()) is None


SCHEMA = Schema([Field(1, "v", "int")])


def entry(low, high, nulls=0, rows=10):
    bounds = ({1: low}, {1: high}) if low is not None else ({}, {})
    return DataFile("f", rows, 1, lower=bounds[0], upper=bounds[1], null_counts={1: nulls})


def test_pruning_keeps_and_drops():
    files = {"f1": entry(0, 30), "f2": entry(31, 60), "f3": entry(61, 100), "f4": entry(None, None)}
    kept = lambda c: [n for n, f in files.items() if may_match(parse_filter_dict({"v": c}), SCHEMA, f)]
    assert kept((">", 50)) == ["f2", "f3", "f4"]
    assert kept(75) == ["f3", "f4"]
    assert kept(("in", [5, 99])) == ["f1", "f3", "f4"]
    assert kept(("is_null",)) == []
    assert not may_match(parse_filter_dict({"v": 1}), SCHEMA, entry(None, None, nulls=10))
    reals = Schema([Field(1, "v", "double")])
    assert may_match(parse_filter_dict({"v": ("!=", 1.0)}), reals, entry(1.0, 1.0))
    assert may_match(parse_filter_dict({"v": ("in", [NAN])}), reals, entry(1.0, 2.0))
    assert not may_match(parse_filter_dict({"v": ("!=", 1)}), SCHEMA, entry(1, 1))


VALUES = st.lists(st.one_of(st.none(), st.integers(-20, 20)), min_size=1, max_size=12)
OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VALUES, st.sampled_from([*OPS, "in", "not_in"]), st.integers(-22, 22), st.lists(st.integers(-22, 22), max_size=4))
def test_pruning_is_sound(values, op, literal, many):
    known = [v for v in values if v is not None]
    f = entry(min(known, default=None), max(known, default=None), values.count(None), len(values))
    operand = many if op in ("in", "not_in") else literal
    hit = {"in": lambda v: v in many, "not_in": lambda v: v not in many}.get(op, lambda v: OPS[op](v, literal) if op in OPS else None)
    if any(hit(v) for v in known):
        assert may_match(parse_filter_dict({"v": (op, operand)}), SCHEMA, f)


@pytest.fixture(scope="module")
def pieces(spark, tmp_path_factory):
    t = create_table(spark, str(tmp_path_factory.mktemp("pieces")), Schema([Field(1, "id", "long", True), Field(2, "value", "int"), Field(3, "category", "string")]))
    for b in range(5):
        t.append_records([{"id": 100 * b + i, "value": 10 * b + i, "category": f"cat_{b}"} for i in range(20)])
    return t


@pytest.mark.parametrize("condition", [{"value": (">=", 55)}, {"value": ("<", 3)}, {"value": 12, "category": "cat_1"}, {"category": ("in", ["cat_0", "cat_4"])}, {"category": ("!=", "cat_2")}, {"id": ("between", (105, 204))}])
def test_pruned_equals_unpruned(pieces, condition):
    everything = pieces.scan()
    test = parse_filter_dict(condition)
    keep = lambda r: all({"in": lambda a, b: a in b, "not_in": lambda a, b: a not in b}.get(e.op.value, OPS.get(e.op.value))(r[e.column], e.value) for e in test)
    assert pieces.scan(filter=condition) == [r for r in everything if keep(r)]
    assert len(pieces.data_files(condition)) <= 5
    assert [r for b in pieces.scan_batches(7, filter=condition) for r in b] and all(len(b) <= 7 for b in pieces.scan_batches(7, filter=condition))


def test_zeros_and_fractions_in_lists(spark, tmp_path):
    t = create_table(spark, str(tmp_path), Schema([Field(1, "x", "double"), Field(2, "n", "long")]))
    t.append_records([{"x": 0.0, "n": 1}, {"x": -0.0, "n": 2}, {"x": 1.0, "n": None}])
    assert len(t.scan(filter={"x": ("in", [0.0])})) == 2 and len(t.scan(filter={"x": ("not_in", [0.0])})) == 1
    assert [r["n"] for r in t.scan(filter={"n": ("in", [1.0, 1.5])})] == [1]


def test_timestamps(spark, tmp_path):
    t = create_table(spark, str(tmp_path), Schema([Field(1, "t", "timestamp"), Field(2, "d", "date")]))
    t.append_records([{"t": dt.datetime(2024, 1, 1), "d": dt.date(2024, 1, 1)}, {"t": dt.datetime(2024, 2, 1), "d": dt.date(2024, 2, 1)}])
    assert len(t.scan(filter={"t": (">", dt.datetime(2024, 1, 15)), "d": (">", dt.date(2024, 1, 15))})) == 1
    assert len(t.data_files({"t": (">", dt.datetime(2025, 1, 1))})) == 0
    with pytest.raises(TypeError):
        t.scan(filter={"d": dt.datetime(2024, 1, 1)})
