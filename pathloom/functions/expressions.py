"""Expressions to typed columns: three-valued logic, deep equality, lists, maps and functions, all JVM-side."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import N, semantic
from . import temporal as tm
from . import types as ty
from .types import ANY, BOOL, FLOAT, INT, NULL, STRING, T

AGGREGATES = {"avg": 1, "collect": 1, "count": 1, "max": 1, "min": 1, "percentilecont": 2, "percentiledisc": 2, "sum": 1}
Typed = tuple[Column, T]


@dataclass
class Entity:
    """A node or relationship bound to flat columns: prefix + id, labels or (src, dst, type), and p_ + property."""

    kind: str
    prefix: str
    props: dict[str, T]
    types: tuple[str, ...] = ()

    def col(self, name: str) -> Column:
        return F.col(f"`{self.prefix}{name}`")

    def prop(self, name: str) -> Column:
        return self.col(f"p_{name}")

    @property
    def id(self) -> Column:
        return self.col("id")

    def columns(self) -> list[str]:
        own = ["id", "labels"] if self.kind == "node" else ["id", "src", "dst", "type"]
        return [self.prefix + c for c in own] + [f"{self.prefix}p_{p}" for p in self.props]

    def struct(self) -> Typed:
        props = F.struct(*[self.prop(p).alias(p) for p in sorted(self.props)])
        if self.kind == "node":
            out, t = F.struct(self.id.alias("id"), self.col("labels").alias("labels"), props.alias("properties")), ty.node_of(self.props)
        else:
            out, t = F.struct(*[self.col(c).alias(c) for c in ("id", "src", "dst", "type")], props.alias("properties")), ty.rel_of(self.props)
        return F.when(self.id.isNotNull(), out), t


@dataclass
class Value:
    """A variable held in one column (or a lambda's argument)."""

    column: Column
    type: T
    name: str = ""

    def columns(self) -> list[str]:
        return [self.name]


@dataclass
class Env:
    """What an expression may refer to."""

    graph: object
    params: dict
    vars: dict[str, Entity | Value] = field(default_factory=dict)
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))

    def bound(self, **more) -> Env:
        return Env(self.graph, self.params, {**self.vars, **more}, self.now)


def null(t: T = NULL) -> Typed:
    return F.lit(None).cast(ty.to_spark(t)), t


def literal(value) -> Typed:
    """A Python value (a parameter, a constant) as a column."""
    if value is None:
        return null()
    if isinstance(value, bool):
        return F.lit(value), BOOL
    if isinstance(value, int):
        return F.lit(value).cast("long"), INT
    if isinstance(value, float):
        return F.lit(value), FLOAT
    if isinstance(value, str):
        return F.lit(value), STRING
    if isinstance(value, dt.datetime):
        return tm.literal(ty.LOCALDATETIME, value), ty.LOCALDATETIME
    if isinstance(value, dt.date):
        return tm.literal(ty.DATE, value), ty.DATE
    if isinstance(value, (list, tuple)):
        return listed([literal(v) for v in value])
    if isinstance(value, dict):
        return mapped({k: literal(v) for k, v in value.items()})
    raise semantic(f"a parameter of type {type(value).__name__}")


def listed(items: list[Typed]) -> Typed:
    t = NULL
    for _, x in items:
        t = ty.unified(t, x)
    if not items:
        return F.array().cast("array<string>"), ty.list_of(NULL)
    return F.array(*[ty.converted(c, x, t) for c, x in items]), ty.list_of(t)


def mapped(items: dict[str, Typed]) -> Typed:
    return F.struct(*[c.alias(k) for k, (c, _) in sorted(items.items())]) if items else F.struct(), ty.map_of({k: t for k, (_, t) in items.items()})


def constant(e: N, env: Env):
    """The Python value of an expression that refers to no row, or a complaint."""
    if e.kind == "lit":
        return e.value
    if e.kind == "param":
        if e.name not in env.params:
            raise semantic(f"missing parameter ${e.name}")
        return env.params[e.name]
    if e.kind == "unary":
        v = constant(e.expr, env)
        return -v if e.op == "-" else v
    if e.kind == "map":
        return {k: constant(v, env) for k, v in e.items.items()}
    if e.kind == "list":
        return [constant(v, env) for v in e.items]
    if e.kind == "binary" and e.op in "+-*":
        a, b = constant(e.left, env), constant(e.right, env)
        return a + b if e.op == "+" else a - b if e.op == "-" else a * b
    if e.kind == "call_fn" and (folded := temporal_constant(e, env)) is not None:
        return folded[1]
    raise semantic("not a constant")


def is_constant(e: N, env: Env) -> bool:
    try:
        constant(e, env)
    except (ValueError, TypeError):
        return False
    return True


# comparison


def nan_free(c: Column, t: T) -> Column:
    return F.isnan(c) if t == FLOAT else F.lit(False)


def numbers_equal(a: Column, ta: T, b: Column, tb: T) -> Column:
    if ta == tb == FLOAT:
        return F.when(F.isnan(a) | F.isnan(b), F.when(a.isNotNull() & b.isNotNull(), False)).otherwise(a == b)
    if ta == tb:
        return a == b
    whole, real = (a, b) if ta == INT else (b, a)
    near = whole.cast("double") == real
    # beyond 2**53 a whole number may round to an unequal double
    return F.when(near & (F.abs(real) < 2.0**63), whole.cast("decimal(38,0)") == real.cast("decimal(38,0)")).when(near, False).otherwise(near)


def equal(a: Column, ta: T, b: Column, tb: T) -> Column:
    """a = b in three-valued logic; lists and maps element by element, entities by id."""
    if NULL in (ta, tb):
        return F.lit(None).cast("boolean")
    if ta in ty.NUMBERS and tb in ty.NUMBERS:
        return numbers_equal(a, ta, b, tb)
    if ANY in (ta, tb):
        return ty.converted(a, ta, ANY) == ty.converted(b, tb, ANY)
    if ta.name == tb.name == "list":
        pairs = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: equal(F.get(a, i), ta.elem, F.get(b, i), tb.elem))
        deep = F.when(F.exists(pairs, lambda x: F.coalesce(~x, F.lit(False))), False).when(F.exists(pairs, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(True)
        return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(F.size(a) != F.size(b), False).when(F.size(a) == 0, True).otherwise(deep)
    if ta.name == tb.name == "map":
        x, y = dict(ta.members), dict(tb.members)
        if set(x) != set(y):
            return F.when(a.isNotNull() & b.isNotNull(), False)
        parts = [equal(a[k], x[k], b[k], y[k]) for k in x]
        out = F.lit(True)
        for p in parts:
            out = out & p
        return F.when(a.isNotNull() & b.isNotNull(), out)
    if ta.name == tb.name and ta.name in ("node", "relationship"):
        return a["id"] == b["id"]
    if ta.name == tb.name == "path":
        ids = lambda p: F.concat(F.transform(p["nodes"], lambda x: x["id"]), F.transform(p["relationships"], lambda x: x["id"]))
        return ids(a) == ids(b)
    if ta.name == tb.name:
        return a == b
    return F.when(a.isNotNull() & b.isNotNull(), False)


def ordered(op: str, a: Column, ta: T, b: Column, tb: T) -> Column:
    less = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    nothing = F.lit(None).cast("boolean")
    if ta in ty.NUMBERS and tb in ty.NUMBERS:
        out = less(a, b)
        if FLOAT in (ta, tb):
            if ta != tb:
                x, y = a.cast("double"), b.cast("double")
                out = F.when(x == y, less(a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))).otherwise(less(x, y))
            out = F.when(nan_free(a, ta) | nan_free(b, tb), F.when(a.isNotNull() & b.isNotNull(), False)).otherwise(out)
        return out
    if ta == tb and (ta in (STRING, BOOL) or ta in (ty.DATE, ty.LOCALDATETIME, ty.LOCALTIME)):
        return less(a, b)
    if ta == tb == ty.TIME:
        return less(a["nanos"] - a["offset"] * tm.NANOS, b["nanos"] - b["offset"] * tm.NANOS)
    if ta == tb == ty.DATETIME:
        at = lambda c: F.struct(tm.component(c, ty.DATETIME, "epochSeconds"), c["nanos"])
        return less(at(a), at(b))
    return nothing


def member(x: Typed, xs: Typed) -> Column:
    (c, t), (l, tl) = x, xs
    if tl == NULL:
        return F.lit(None).cast("boolean")
    if tl.name != "list":
        raise semantic("IN needs a list")
    same = lambda v: equal(c, t, v, tl.elem)
    found = F.transform(l, same)
    return F.when(l.isNull(), F.lit(None).cast("boolean")).when(F.size(l) == 0, False).when(F.exists(found, lambda v: F.coalesce(v, F.lit(False))), True).when(F.exists(found, lambda v: v.isNull()), F.lit(None).cast("boolean")).otherwise(False)


def boolean(e: N, env: Env) -> Column:
    c, t = compiled(e, env)
    if t == NULL:
        return F.lit(None).cast("boolean")
    if t != BOOL:
        raise semantic(f"expected a boolean, found {t}")
    return c


def divided(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).when(a < 0, -inf)).otherwise(a / F.when(b != 0, b))


def arithmetic(op: str, x: Typed, y: Typed) -> Typed:
    (a, ta), (b, tb) = x, y
    if op == "+" and "list" in (ta.name, tb.name):
        elem = ty.unified(ta.elem if ta.name == "list" else ta, tb.elem if tb.name == "list" else tb)
        whole = lambda c, t: ty.converted(c, t, ty.list_of(elem)) if t.name == "list" else F.array(ty.converted(c, t, elem))
        return F.concat(whole(a, ta), whole(b, tb)), ty.list_of(elem)
    if NULL in (ta, tb):
        return null()
    if op == "+" and ta == tb == STRING:
        return F.concat(a, b), STRING
    if ta not in ty.NUMBERS or tb not in ty.NUMBERS:
        raise semantic(f"{op} on {ta} and {tb}")
    if op == "^":
        return F.pow(a.cast("double"), b.cast("double")), FLOAT
    if ta == tb == INT:
        if op == "/":
            return F.call_function("div", a, b), INT
        return {"+": a + b, "-": a - b, "*": a * b, "%": a % b}[op], INT
    a, b = a.cast("double"), b.cast("double")
    if op == "/":
        return divided(a, b), FLOAT
    if op == "%":
        return F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.when(b != 0, b)), FLOAT
    return {"+": a + b, "-": a - b, "*": a * b}[op], FLOAT


def compiled(e: N, env: Env) -> Typed:
    return HANDLERS[e.kind](e, env)


def on_var(e: N, env: Env) -> Typed:
    if e.name not in env.vars:
        raise semantic(f"undefined variable `{e.name}`")
    v = env.vars[e.name]
    return v.struct() if isinstance(v, Entity) else (v.column, v.type)


def on_prop(e: N, env: Env) -> Typed:
    if e.base.kind == "var" and isinstance(v := env.vars.get(e.base.name), Entity):
        return (v.prop(e.key), v.props[e.key]) if e.key in v.props else null()
    c, t = compiled(e.base, env)
    if t.name == "map":
        members = dict(t.members)
        return (c[e.key], members[e.key]) if e.key in members else null()
    if t.name in ("node", "relationship"):
        members = dict(t.members)
        return (c["properties"][e.key], members[e.key]) if e.key in members else null()
    if t in ty.TEMPORAL or t == ty.DURATION:
        found = tm.component(c, t, e.key)
        if found is None:
            return null()
        return found, STRING if e.key in ("timezone", "offset") else INT
    if t.name in ("list", "path") or t in (INT, FLOAT, BOOL, STRING):
        raise semantic(f"{t} has no property {e.key!r}")
    return null()


def on_labels(e: N, env: Env) -> Typed:
    if e.base.kind == "var" and isinstance(v := env.vars.get(e.base.name), Entity):
        own, kind = (v.col("labels") if v.kind == "node" else v.col("type")), v.kind
    else:
        c, t = compiled(e.base, env)
        if t == NULL:
            return null(BOOL)
        if t.name not in ("node", "relationship"):
            raise semantic(f"labels of {t}")
        own, kind = (c["labels"] if t.name == "node" else c["type"]), t.name
    if kind != "node":
        return F.when(own.isNotNull(), own.isin(*e.labels)), BOOL
    out = F.lit(True)
    for label in e.labels:
        out = out & F.array_contains(own, label)
    return F.when(own.isNotNull(), out), BOOL


def on_binary(e: N, env: Env) -> Typed:
    if e.op in ("and", "or"):
        a, b = boolean(e.left, env), boolean(e.right, env)
        # the right side, which may fail, is asked only where it matters
        return (F.when(~a, False).otherwise(a & b), BOOL) if e.op == "and" else (F.when(a, True).otherwise(a | b), BOOL)
    if e.op == "xor":
        return boolean(e.left, env) != boolean(e.right, env), BOOL
    if e.op in ("=", "<>") and e.left.kind == e.right.kind == "var" and isinstance(x := env.vars.get(e.left.name), Entity) and isinstance(y := env.vars.get(e.right.name), Entity) and x.kind == y.kind:
        return (x.id == y.id if e.op == "=" else x.id != y.id), BOOL
    x, y = compiled(e.left, env), compiled(e.right, env)
    if e.op == "=":
        return equal(*x, *y), BOOL
    if e.op == "<>":
        return ~equal(*x, *y), BOOL
    if e.op in ("<", "<=", ">", ">="):
        return ordered(e.op, *x, *y), BOOL
    if e.op == "in":
        return member(x, y), BOOL
    if e.op in ("starts", "ends", "contains"):
        if x[1] != STRING or y[1] != STRING:
            return null(BOOL)
        return {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[e.op](x[0], y[0]), BOOL
    return arithmetic(e.op, x, y)


def on_unary(e: N, env: Env) -> Typed:
    c, t = compiled(e.expr, env)
    if t not in (*ty.NUMBERS, NULL):
        raise semantic(f"sign of {t}")
    return (-c if e.op == "-" and t != NULL else c), t


def on_not(e: N, env: Env) -> Typed:
    return ~boolean(e.expr, env), BOOL


def on_is_null(e: N, env: Env) -> Typed:
    if e.expr.kind == "var" and isinstance(v := env.vars.get(e.expr.name), Entity):
        c = v.id
    else:
        c, t = compiled(e.expr, env)
    return (c.isNotNull() if e.negated else c.isNull()), BOOL


def on_index(e: N, env: Env) -> Typed:
    (c, t), (i, ti) = compiled(e.base, env), compiled(e.at, env)
    if t.name == "map" and e.at.kind in ("lit", "param"):
        key, members = constant(e.at, env), dict(t.members)
        return (c[key], members[key]) if key in members else null()
    if NULL in (t, ti):
        return null(t.elem or NULL)
    if t.name != "list" or ti != INT:
        raise semantic(f"{t}[{ti}]")
    i = i.cast("int")
    return F.get(c, F.when(i < 0, i + F.size(c)).otherwise(i)), t.elem


def on_slice(e: N, env: Env) -> Typed:
    c, t = compiled(e.base, env)
    if t == NULL:
        return null()
    if t.name != "list":
        raise semantic(f"slice of {t}")
    size, bounds = F.size(c), []
    for x, default in ((e.low, F.lit(0)), (e.high, size)):
        b = compiled(x, env)[0].cast("int") if x is not None else default
        bounds.append(F.least(F.greatest(F.when(b < 0, b + size).otherwise(b), F.lit(0)), size))
    low, high = bounds
    known = c.isNotNull()
    for x in (e.low, e.high):
        if x is not None:
            known = known & compiled(x, env)[0].isNotNull()
    return F.when(known, F.slice(c, low + 1, F.greatest(high - low, F.lit(0)))), t


def on_case(e: N, env: Env) -> Typed:
    values = [compiled(v, env) for _, v in e.branches] + ([compiled(e.default, env)] if e.default is not None else [])
    t = NULL
    for _, x in values:
        t = ty.unified(t, x)
    out = None
    for (when, _), (v, tv) in zip(e.branches, values, strict=False):
        holds = equal(*compiled(e.subject, env), *compiled(when, env)) if e.subject is not None else boolean(when, env)
        v = ty.converted(v, tv, t)
        out = F.when(holds, v) if out is None else out.when(holds, v)
    return (out.otherwise(ty.converted(*values[-1], t)) if e.default is not None else out), t


def on_comprehension(e: N, env: Env) -> Typed:
    c, t = compiled(e.source, env)
    if t == NULL:
        return null()
    if t.name != "list":
        raise semantic(f"comprehension over {t}")
    inner = lambda x: env.bound(**{e.var: Value(x, t.elem)})
    if e.where is not None:
        c = F.filter(c, lambda x: boolean(e.where, inner(x)))
    if e.expr is None:
        return c, t
    elem = compiled(e.expr, inner(F.lit(None).cast(ty.to_spark(t.elem))))[1]
    return F.transform(c, lambda x: compiled(e.expr, inner(x))[0]), ty.list_of(elem)


def on_quantifier(e: N, env: Env) -> Typed:
    c, t = compiled(e.source, env)
    if t == NULL:
        return null(BOOL)
    if t.name != "list":
        raise semantic(f"{e.word} over {t}")
    holds = F.transform(c, lambda x: boolean(e.where, env.bound(**{e.var: Value(x, t.elem)})) if e.where is not None else x.cast("boolean"))
    yes, no, unknown = (F.size(F.filter(holds, f)) for f in (lambda x: x, lambda x: ~x, lambda x: x.isNull()))
    nothing = F.lit(None).cast("boolean")
    out = {
        "all": F.when(no > 0, False).when(unknown > 0, nothing).otherwise(True),
        "any": F.when(yes > 0, True).when(unknown > 0, nothing).otherwise(False),
        "none": F.when(yes > 0, False).when(unknown > 0, nothing).otherwise(True),
        "single": F.when(yes > 1, False).when(unknown > 0, nothing).otherwise(yes == 1),
    }[e.word]
    return F.when(c.isNotNull(), out), BOOL


def on_call(e: N, env: Env) -> Typed:
    from .scalar import call

    return call(e, env)


TEMPORAL_NAMES = {"date": ty.DATE, "localtime": ty.LOCALTIME, "time": ty.TIME, "localdatetime": ty.LOCALDATETIME, "datetime": ty.DATETIME}
BETWEEN = {"between": "between", "inmonths": "inMonths", "indays": "inDays", "inseconds": "inSeconds"}
CLOCKS = ("transaction", "statement", "realtime")


def clock_value(kind: str, now: dt.datetime, zone: str | None):
    offset = tm.zone_offset(zone, now) if zone else 0
    local = now + dt.timedelta(seconds=offset)
    nanos = (local - dt.datetime.combine(local.date(), dt.time())) // dt.timedelta(microseconds=1) * 1000
    return {"date": local.date(), "localtime": nanos, "time": (nanos, offset), "localdatetime": local, "datetime": (local, offset, zone, nanos % tm.NANOS)}[kind]


def temporal_constant(e: N, env: Env):
    """(type, Python value) of a temporal call on constants; None if it is no such call."""
    name = e.name.lower()
    base, _, rest = name.partition(".")
    if base in TEMPORAL_NAMES and rest in ("", *CLOCKS):
        if not e.args or rest:
            return TEMPORAL_NAMES[base], clock_value(base, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) if rest == "realtime" else env.now, constant(e.args[0], env) if e.args else None)
        arg = constant(e.args[0], env)
        if arg is None:
            return TEMPORAL_NAMES[base], None
        if isinstance(arg, str):
            return TEMPORAL_NAMES[base], tm.parsed(base, arg)
        if isinstance(arg, dict):
            return TEMPORAL_NAMES[base], tm.built(base, arg)
        if isinstance(arg, dt.datetime):
            return TEMPORAL_NAMES[base], tm.built(base, {"datetime": arg} if base != "date" else {"date": arg.date()})
        if isinstance(arg, dt.date):
            return TEMPORAL_NAMES[base], tm.built(base, {"date": arg})
        if isinstance(arg, tuple) and len(arg) == 4:
            return TEMPORAL_NAMES[base], arg if base == "datetime" else tm.built(base, {"datetime": arg})
    if base in TEMPORAL_NAMES and rest == "truncate":
        unit, value, *more = (constant(a, env) for a in e.args)
        return TEMPORAL_NAMES[base], None if value is None else tm.truncated_constant(base, unit, value, more[0] if more else {})
    if base == "duration" and rest in BETWEEN:
        a, b = (constant(x, env) for x in e.args)
        return ty.DURATION, None if a is None or b is None else tm.between_constants(BETWEEN[rest], a, b)
    if name == "datetime.fromepoch":
        s, n = (constant(a, env) for a in e.args)
        return ty.DATETIME, (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s, microseconds=n // 1000), 0, None, n % tm.NANOS)
    if name == "datetime.fromepochmillis":
        ms = constant(e.args[0], env)
        return ty.DATETIME, (dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms), 0, None, ms % 1000 * 1_000_000)
    if name == "duration":
        arg = constant(e.args[0], env)
        return ty.DURATION, None if arg is None else tm.parsed_duration(arg) if isinstance(arg, str) else tm.duration_of(arg)
    return None


def unsupported(e: N, env: Env) -> Typed:
    raise semantic(f"{e.kind.replace('_', ' ')} is not allowed here")


HANDLERS = {
    "lit": lambda e, env: literal(e.value),
    "param": lambda e, env: literal(constant(e, env)),
    "var": on_var,
    "prop": on_prop,
    "has_labels": on_labels,
    "binary": on_binary,
    "unary": on_unary,
    "not": on_not,
    "is_null": on_is_null,
    "index": on_index,
    "slice": on_slice,
    "case": on_case,
    "list": lambda e, env: listed([compiled(x, env) for x in e.items]),
    "map": lambda e, env: mapped({k: compiled(v, env) for k, v in e.items.items()}),
    "comprehension": on_comprehension,
    "quantifier": on_quantifier,
    "call_fn": on_call,
    "exists": unsupported,
    "pattern_comprehension": unsupported,
}
__all__ = ["ANY", "AGGREGATES", "Entity", "Env", "Value", "boolean", "compiled", "constant"]
