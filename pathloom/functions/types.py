"""Static types of expressions, and the columns that carry them.

Entities that are values (in lists, results) are structs: node {id, labels, properties}, relationship {id, src, dst,
type, properties}, path {nodes, relationships}. Durations are {months, days, seconds, nanos}; times of day are
{nanos} or {nanos, offset} (seconds); zoned date-times {ts, offset, zone, nanos}.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..plans.ast import semantic


@dataclass(frozen=True)
class T:
    name: str
    elem: T | None = None
    members: tuple[tuple[str, T], ...] = field(default=())

    def __str__(self) -> str:
        return f"{self.name}<{self.elem}>" if self.elem else self.name


NULL, BOOL, INT, FLOAT, STRING, ANY = (T(x) for x in ("null", "boolean", "integer", "float", "string", "any"))
DATE, LOCALDATETIME, LOCALTIME, TIME, DATETIME, DURATION = (T(x) for x in ("date", "localdatetime", "localtime", "time", "datetime", "duration"))
NUMBERS = (INT, FLOAT)
TEMPORAL = (DATE, LOCALDATETIME, LOCALTIME, TIME, DATETIME)


def list_of(t: T) -> T:
    return T("list", t)


def map_of(members: dict[str, T]) -> T:
    return T("map", None, tuple(sorted(members.items())))


def node_of(members: dict[str, T]) -> T:
    return T("node", None, tuple(sorted(members.items())))


def rel_of(members: dict[str, T]) -> T:
    return T("relationship", None, tuple(sorted(members.items())))


def path_of(node: T, rel: T) -> T:
    return T("path", None, (("nodes", list_of(node)), ("relationships", list_of(rel))))


def to_spark(t: T) -> S.DataType:
    simple = {"boolean": S.BooleanType(), "integer": S.LongType(), "float": S.DoubleType(), "string": S.StringType(), "any": S.StringType(), "null": S.StringType(), "date": S.DateType(), "localdatetime": S.TimestampNTZType()}
    if t.name in simple:
        return simple[t.name]
    struct = lambda **kw: S.StructType([S.StructField(k, v) for k, v in kw.items()])
    if t.name == "list":
        return S.ArrayType(to_spark(t.elem))
    if t.name == "map":
        return S.StructType([S.StructField(k, to_spark(v)) for k, v in t.members])
    props = S.StructType([S.StructField(k, to_spark(v)) for k, v in t.members])
    if t.name == "node":
        return struct(id=S.LongType(), labels=S.ArrayType(S.StringType()), properties=props)
    if t.name == "relationship":
        return struct(id=S.LongType(), src=S.LongType(), dst=S.LongType(), type=S.StringType(), properties=props)
    if t.name == "path":
        return S.StructType([S.StructField(k, to_spark(v)) for k, v in t.members])
    if t == DURATION:
        return struct(months=S.LongType(), days=S.LongType(), seconds=S.LongType(), nanos=S.LongType())
    if t == LOCALTIME:
        return struct(nanos=S.LongType())
    if t == TIME:
        return struct(nanos=S.LongType(), offset=S.LongType())
    if t == DATETIME:
        return struct(ts=S.TimestampNTZType(), offset=S.LongType(), zone=S.StringType(), nanos=S.LongType())
    raise semantic(f"no column type for {t}")


def from_spark(d: S.DataType) -> T:
    if isinstance(d, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        return INT
    if isinstance(d, (S.FloatType, S.DoubleType, S.DecimalType)):
        return FLOAT
    if isinstance(d, S.BooleanType):
        return BOOL
    if isinstance(d, S.DateType):
        return DATE
    if isinstance(d, (S.TimestampNTZType, S.TimestampType)):
        return LOCALDATETIME
    if isinstance(d, S.ArrayType):
        return list_of(from_spark(d.elementType))
    if isinstance(d, S.StructType):
        return map_of({f.name: from_spark(f.dataType) for f in d.fields})
    return STRING


def unified(a: T, b: T) -> T:
    """The type that holds both, or a complaint."""
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    if a in NUMBERS and b in NUMBERS:
        return FLOAT
    if a.name == b.name == "list":
        return list_of(unified(a.elem, b.elem))
    if a.name == b.name and a.name in ("map", "node", "relationship"):
        x, y = dict(a.members), dict(b.members)
        return T(a.name, None, tuple(sorted((k, unified(x.get(k, NULL), y.get(k, NULL))) for k in {**x, **y})))
    if a.name == b.name == "path":
        return T("path", None, tuple((k, unified(x, y)) for (k, x), (_, y) in zip(a.members, b.members, strict=True)))
    return ANY


def converted(c: Column, have: T, want: T) -> Column:
    """The column as the wanted type; any is a text that tells values of all types apart."""
    if have == want:
        return c
    if have == NULL:
        return F.lit(None).cast(to_spark(want))
    if want == FLOAT and have == INT:
        return c.cast("double")
    if want == ANY:
        return tagged(c, have)
    if want.name == "list" and have.name == "list":
        return F.transform(c, lambda x: converted(x, have.elem, want.elem))
    if want.name in ("map", "node", "relationship") and have.name == want.name:
        of = dict(have.members)
        base = c if want.name == "map" else c["properties"]
        fields = [converted(base[k], of.get(k, NULL), t).alias(k) if k in of else F.lit(None).cast(to_spark(t)).alias(k) for k, t in want.members]
        body = F.struct(*fields) if fields else F.struct()
        if want.name == "node":
            body = F.struct(c["id"].alias("id"), c["labels"].alias("labels"), body.alias("properties"))
        elif want.name == "relationship":
            body = F.struct(*[c[k].alias(k) for k in ("id", "src", "dst", "type")], body.alias("properties"))
        return F.when(c.isNotNull(), body)
    return c.cast(to_spark(want))


def tagged(c: Column, t: T) -> Column:
    """The value's literal: equal values, 1 and 1.0 among them, have equal texts, values of other types have others."""
    if t == FLOAT:
        return F.when((c == F.floor(c)) & (F.abs(c) < 2.0**53), F.floor(c).cast("string")).otherwise(c.cast("string"))
    if t in (INT, BOOL):
        return c.cast("string")
    if t == STRING:
        return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1))
    if t.name == "list":
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(tagged(x, t.elem), F.lit("null"))), ", "), F.lit("]")) if t.elem != NULL else F.when(c.isNotNull(), "[]")
    return F.concat(F.lit(f"{t.name}("), printed(c, t), F.lit(")"))


def printed(c: Column, t: T) -> Column:
    if t.name in ("list", "map", "node", "relationship", "path"):
        return F.to_json(c)
    if t == LOCALDATETIME:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")
