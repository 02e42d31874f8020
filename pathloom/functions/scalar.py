"""Built-in functions. A wrong type known at compile time is an error; a wrong value gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import N, semantic
from . import temporal as tm
from . import types as ty
from .expressions import AGGREGATES, TEMPORAL_NAMES, Entity, Env, Typed, clock_value, compiled, constant, is_constant, null, temporal_constant
from .types import BOOL, FLOAT, INT, NULL, STRING, T

WHITE = " \t\n\r\f\x0b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIMPLE: dict[str, tuple[int, int, Callable]] = {}


def function(name: str, least: int = 1, most: int | None = None):
    def register(f):
        SIMPLE[name] = (least, least if most is None else most, f)
        return f

    return register


def wrong(name: str, t: T):
    return semantic(f"{name}() does not take {t}")


def numeric(name: str, t: T) -> None:
    if t not in ty.NUMBERS:
        raise wrong(name, t)


@function("abs")
def _abs(x: Typed) -> Typed:
    numeric("abs", x[1])
    return F.abs(x[0]), x[1]


@function("ceil")
def _ceil(x: Typed) -> Typed:
    numeric("ceil", x[1])
    c = x[0].cast("double")
    return F.when(F.abs(c) < 2.0**53, F.ceil(F.when(F.abs(c) < 2.0**53, c)).cast("double")).otherwise(c), FLOAT


@function("sign")
def _sign(x: Typed) -> Typed:
    numeric("sign", x[1])
    return F.when(x[0] > 0, 1).when(x[0] < 0, -1).when(x[0].isNotNull(), 0).cast("long"), INT


@function("sqrt")
def _sqrt(x: Typed) -> Typed:
    numeric("sqrt", x[1])
    return F.sqrt(x[0].cast("double")), FLOAT


@function("rand", 0)
def _rand() -> Typed:
    return F.rand(), FLOAT


@function("tointeger")
def _to_integer(x: Typed) -> Typed:
    c, t = x
    if t == INT:
        return x
    if t == STRING:
        return F.when(F.rlike(c, F.lit("^-?[0-9]+$")), c.try_cast("long")), INT
    if t == FLOAT:
        return F.when(F.abs(c) < 2.0**63, F.when(F.abs(c) < 2.0**63, c).cast("long")), INT
    if t == BOOL:
        return c.cast("long"), INT
    raise wrong("toInteger", t)


@function("tofloat")
def _to_float(x: Typed) -> Typed:
    c, t = x
    if t in ty.NUMBERS or t == BOOL:
        return (c.cast("long") if t == BOOL else c).cast("double"), FLOAT
    if t == STRING:
        return F.when(F.rlike(c, F.lit(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$")), c.try_cast("double")), FLOAT
    raise wrong("toFloat", t)


@function("toboolean")
def _to_boolean(x: Typed) -> Typed:
    c, t = x
    if t == BOOL:
        return x
    if t == STRING:
        low = F.lower(F.btrim(c, F.lit(WHITE)))
        return F.when(low == "true", True).when(low == "false", False), BOOL
    if t == INT:
        return null(BOOL)
    raise wrong("toBoolean", t)


@function("tostring")
def _to_string(x: Typed) -> Typed:
    return ty.printed(*x), STRING


@function("tolower")
def _to_lower(x: Typed) -> Typed:
    text("toLower", x[1])
    return F.translate(x[0], UPPER, LOWER), STRING


@function("toupper")
def _to_upper(x: Typed) -> Typed:
    text("toUpper", x[1])
    return F.translate(x[0], LOWER, UPPER), STRING


def text(name: str, t: T) -> None:
    if t != STRING:
        raise wrong(name, t)


@function("trim")
def _trim(x: Typed) -> Typed:
    text("trim", x[1])
    return F.btrim(x[0], F.lit(WHITE)), STRING


@function("split", 2)
def _split(x: Typed, y: Typed) -> Typed:
    text("split", x[1])
    text("split", y[1])
    quoted = F.concat(F.lit(r"\Q"), y[0], F.lit(r"\E"))
    return F.when(y[0] == "", F.split(x[0], "")).otherwise(F.split(x[0], quoted, -1)), ty.list_of(STRING)


@function("substring", 2, 3)
def _substring(x: Typed, start: Typed, length: Typed | None = None) -> Typed:
    text("substring", x[1])
    bad = start[0] < 0
    n = F.length(x[0]) if length is None else length[0].cast("int")
    if length is not None:
        bad = bad | (length[0] < 0)
    return F.when(bad, F.raise_error(F.lit("substring: negative argument")).cast("string")).otherwise(F.substring(x[0], start[0].cast("int") + 1, n)), STRING


@function("reverse")
def _reverse(x: Typed) -> Typed:
    if x[1].name != "list" and x[1] != STRING:
        raise wrong("reverse", x[1])
    return F.reverse(x[0]), x[1]


@function("size")
def _size(x: Typed) -> Typed:
    c, t = x
    if t == STRING:
        return F.length(c).cast("long"), INT
    if t.name == "list":
        return F.when(c.isNotNull(), F.size(c)).cast("long"), INT
    raise wrong("size", t)


@function("length")
def _length(x: Typed) -> Typed:
    c, t = x
    if t.name == "path":
        return F.when(c.isNotNull(), F.size(c["relationships"])).cast("long"), INT
    if t.name == "list" or t == STRING:
        return null(INT)
    raise wrong("length", t)


@function("isempty")
def _is_empty(x: Typed) -> Typed:
    c, t = x
    if t.name == "list":
        return F.when(c.isNotNull(), F.size(c) == 0), BOOL
    if t == STRING:
        return F.length(c) == 0, BOOL
    if t.name == "map":
        return F.when(c.isNotNull(), F.lit(not t.members)), BOOL
    raise wrong("isEmpty", t)


def items(name: str, t: T) -> T:
    if t.name != "list":
        raise wrong(name, t)
    return t.elem


@function("head")
def _head(x: Typed) -> Typed:
    return F.get(x[0], F.lit(0)), items("head", x[1])


@function("last")
def _last(x: Typed) -> Typed:
    return F.get(x[0], F.size(x[0]) - 1), items("last", x[1])


@function("tail")
def _tail(x: Typed) -> Typed:
    items("tail", x[1])
    return F.when(x[0].isNotNull(), F.slice(x[0], 2, F.greatest(F.size(x[0]) - 1, F.lit(0)))), x[1]


@function("range", 2, 3)
def _range(a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    for t in (a, b, *([step] if step else [])):
        if t[1] != INT:
            raise wrong("range", t[1])
    s = step[0] if step else F.lit(1).cast("long")
    up, down = (s > 0) & (a[0] <= b[0]), (s < 0) & (a[0] >= b[0])
    empty = F.array().cast("array<bigint>")
    return F.when(s == 0, F.raise_error(F.lit("range: step is zero")).cast("array<bigint>")).when(up | down, F.sequence(F.when(up | down, a[0]), F.when(up | down, b[0]), F.when(up | down, s))).when(a[0].isNotNull() & b[0].isNotNull() & s.isNotNull(), empty), ty.list_of(INT)


@function("coalesce", 1, 99)
def _coalesce(*xs: Typed) -> Typed:
    t = NULL
    for _, x in xs:
        t = ty.unified(t, x)
    return F.coalesce(*[ty.converted(c, x, t) for c, x in xs]), t


@function("id")
def _id(x: Typed) -> Typed:
    if x[1].name not in ("node", "relationship"):
        raise wrong("id", x[1])
    return x[0]["id"], INT


@function("labels")
def _labels(x: Typed) -> Typed:
    if x[1].name != "node":
        raise wrong("labels", x[1])
    return x[0]["labels"], ty.list_of(STRING)


@function("type")
def _type(x: Typed) -> Typed:
    if x[1].name != "relationship":
        raise wrong("type", x[1])
    return x[0]["type"], STRING


@function("keys")
def _keys(x: Typed) -> Typed:
    c, t = x
    if t.name not in ("node", "relationship", "map"):
        raise wrong("keys", t)
    base = c if t.name == "map" else c["properties"]
    names = [k for k, _ in t.members]
    found = F.filter(F.array(*[F.when(F.lit(True) if t.name == "map" else base[k].isNotNull(), F.lit(k)) for k in names]), lambda k: k.isNotNull()) if names else F.array().cast("array<string>")
    return F.when(c.isNotNull(), found), ty.list_of(STRING)


@function("properties")
def _properties(x: Typed) -> Typed:
    if x[1].name == "map":
        return x
    if x[1].name not in ("node", "relationship"):
        raise wrong("properties", x[1])
    return x[0]["properties"], T("map", None, x[1].members)


@function("nodes")
def _nodes(x: Typed) -> Typed:
    if x[1].name != "path":
        raise wrong("nodes", x[1])
    return x[0]["nodes"], dict(x[1].members)["nodes"]


@function("relationships")
def _relationships(x: Typed) -> Typed:
    if x[1].name != "path":
        raise wrong("relationships", x[1])
    return x[0]["relationships"], dict(x[1].members)["relationships"]


ENTITY = {"id": ("id", INT), "labels": ("labels", ty.list_of(STRING)), "type": ("type", STRING)}
DURATIONS = {"duration.between": "between", "duration.inmonths": "inMonths", "duration.indays": "inDays", "duration.inseconds": "inSeconds"}
#: Names that are compiled apart from SIMPLE, with their numbers of arguments.
SPECIAL = {
    **{k: (0, 1) for k in TEMPORAL_NAMES}, **{f"{k}.{c}": (0, 1) for k in TEMPORAL_NAMES for c in ("transaction", "statement", "realtime")}, **{f"{k}.truncate": (2, 3) for k in TEMPORAL_NAMES},
    "datetime.fromepoch": (2, 2), "datetime.fromepochmillis": (1, 1), "duration": (1, 1), **{k: (2, 2) for k in DURATIONS}, "startnode": (1, 1), "endnode": (1, 1),
}


def arity(name: str) -> tuple[int, int] | None:
    low = name.lower()
    if low in AGGREGATES:
        return (0 if low == "count" else AGGREGATES[low], AGGREGATES[low])
    return SIMPLE[low][:2] if low in SIMPLE else SPECIAL.get(low)


def call(e: N, env: Env) -> Typed:
    name = e.name.lower()
    if name in AGGREGATES:
        raise semantic(f"aggregation {e.name}() is not allowed here")
    if name not in SIMPLE and name not in SPECIAL:
        raise semantic(f"unknown function {e.name}()")
    least, most = arity(name)
    if not least <= len(e.args) <= most:
        raise semantic(f"{e.name}() takes {least if least == most else f'{least} to {most}'} arguments, not {len(e.args)}")
    if e.distinct:
        raise semantic(f"DISTINCT in {e.name}(), which is no aggregation")
    if name in SPECIAL:
        return special(name, e, env)
    if name in ENTITY and e.args[0].kind == "var" and isinstance(v := env.vars.get(e.args[0].name), Entity) and (name == "id" or (name == "labels") == (v.kind == "node")):
        return v.col(ENTITY[name][0]), ENTITY[name][1]
    args = [compiled(a, env) for a in e.args]
    if name != "coalesce" and any(t == NULL for _, t in args):
        return null()
    return SIMPLE[name][2](*args)


def special(name: str, e: N, env: Env) -> Typed:
    if name in ("startnode", "endnode"):
        raise semantic(f"{e.name}() needs a relationship variable of a MATCH")
    if all(is_constant(a, env) for a in e.args) and (folded := temporal_constant(e, env)) is not None:
        return tm.literal(folded[0], folded[1]), folded[0]
    if name in DURATIONS:
        (a, ta), (b, tb) = (compiled(x, env) for x in e.args)
        if NULL in (ta, tb):
            return null(ty.DURATION)
        return tm.between(DURATIONS[name], a, ta, b, tb), ty.DURATION
    if name.endswith(".truncate"):
        to, unit = TEMPORAL_NAMES[name.partition(".")[0]], constant(e.args[0], env)
        c, t = compiled(e.args[1], env)
        if t == NULL:
            return null(to)
        if t not in TEMPORAL_NAMES.values():
            raise wrong(e.name, t)
        return tm.truncated(unit, c, t, to, fields_of(e.args[2], env) if len(e.args) == 3 else None), to
    base = name.partition(".")[0]
    if len(e.args) == 1 and "." not in name:
        to = ty.DURATION if name == "duration" else TEMPORAL_NAMES[base]
        if e.args[0].kind == "map":
            fields = fields_of(e.args[0], env)
            if any(t == NULL for _, t in fields.values()):
                return null(to)
            return (tm.duration_column({k: c for k, (c, _) in fields.items()}) if to == ty.DURATION else tm.built_column(to, fields)), to
        return from_column(to, *compiled(e.args[0], env)), to
    if name in ("datetime.fromepoch", "datetime.fromepochmillis"):
        a, zero = compiled(e.args[0], env)[0].cast("long"), F.lit(0).cast("long")
        if name == "datetime.fromepoch":
            return tm.epoch_column(a, compiled(e.args[1], env)[0].cast("long") if len(e.args) > 1 else zero), ty.DATETIME
        return tm.epoch_column(F.floor(a / 1000), F.pmod(a, F.lit(1000)) * 1_000_000), ty.DATETIME
    raise semantic(f"{e.name}() on these arguments")


def fields_of(e: N, env: Env) -> dict[str, Typed]:
    """The fields of a map literal as columns."""
    if e.kind != "map":
        raise semantic("fields are given by a map literal")
    return {k: compiled(v, env) for k, v in e.items.items()}


def from_column(to: T, c: Column, t: T) -> Column:
    """A temporal value of a column: of a text in ISO form, or a selection from another temporal value."""
    if t == NULL:
        return null(to)[0]
    if t == to:
        return c
    if t == STRING:
        return tm.duration_text_column(c) if to == ty.DURATION else tm.text_column(to, c)
    if t not in TEMPORAL_NAMES.values() or to == ty.DURATION:
        raise semantic(f"{to}() of {t} columns")
    day, nanos, offset, zone = tm.parts_columns(c, t)
    if day is None and to not in (ty.LOCALTIME, ty.TIME):
        raise semantic(f"{to}() of {t} columns")
    return F.when(c.isNotNull(), tm.assembled(to, day, nanos, offset, zone))


__all__ = ["arity", "call", "clock_value"]
