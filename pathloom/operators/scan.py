"""Scans: nodes by label, relationships by type, as flat columns under a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types as ty
from ..functions.expressions import Entity


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def scan_nodes(graph, labels, prefix: str, among: list | None = None) -> tuple[DataFrame, Entity]:
    """Nodes that have all the labels, of the tables among which they lie if that is known. Tables that cannot hold one are not read; Catalyst prunes columns that nothing asks for."""
    tables = [t for t in graph.node_tables(labels) if among is None or any(t is x for x in among)]
    props: dict[str, ty.T] = {}
    for t in tables:
        for k, v in t.props.items():
            props[k] = ty.unified(props[k], v) if k in props else v
    entity = Entity("node", prefix, props)
    frames = []
    for t in tables:
        df = t.df
        if t.labels is None:
            for label in labels:
                df = df.filter(F.array_contains("labels", label))
        own = F.array(*map(F.lit, t.labels)).cast("array<string>") if t.labels is not None else F.col("labels")
        frames.append(df.select(F.col("id").alias(f"{prefix}id"), own.alias(f"{prefix}labels"), *_props(t.props, props, prefix)))
    return union_all(frames) if frames else empty(graph, entity), entity


def scan_rels(graph, types, direction: str, prefix: str) -> tuple[DataFrame, Entity]:
    """Relationships of the types with columns from and to along the direction; both: either way, a loop once."""
    tables = graph.rel_tables(types)
    props: dict[str, ty.T] = {}
    for t in tables:
        for k, v in t.props.items():
            props[k] = ty.unified(props[k], v) if k in props else v
    entity, frames = Entity("relationship", prefix, props, tuple(types)), []
    for t in tables:
        base = t.df.select(F.col("id").alias(f"{prefix}id"), F.col("src").alias(f"{prefix}src"), F.col("dst").alias(f"{prefix}dst"), F.lit(t.type).alias(f"{prefix}type"), *_props(t.props, props, prefix))
        ways = []
        if direction in ("out", "both"):
            ways.append(base.withColumns({f"{prefix}from": F.col(f"`{prefix}src`"), f"{prefix}to": F.col(f"`{prefix}dst`")}))
        if direction in ("in", "both"):
            way = base.withColumns({f"{prefix}from": F.col(f"`{prefix}dst`"), f"{prefix}to": F.col(f"`{prefix}src`")})
            ways.append(way.filter(F.col(f"`{prefix}src`") != F.col(f"`{prefix}dst`")) if direction == "both" else way)
        frames += ways
    if not frames:
        df = empty(graph, entity)
        return df.withColumns({f"{prefix}from": F.col(f"`{prefix}src`"), f"{prefix}to": F.col(f"`{prefix}dst`")}), entity
    return union_all(frames), entity


def _props(have: dict, want: dict, prefix: str):
    return [(ty.converted(F.col(f"`{k}`"), have[k], t) if k in have else F.lit(None).cast(ty.to_spark(t))).alias(f"{prefix}p_{k}") for k, t in want.items()]


def empty(graph, entity: Entity) -> DataFrame:
    kinds = {"id": "long", "labels": "array<string>", "src": "long", "dst": "long", "type": "string"}
    names = ["id", "labels"] if entity.kind == "node" else ["id", "src", "dst", "type"]
    return graph.spark.createDataFrame([], ", ".join(f"`{entity.prefix}{n}` {kinds[n]}" for n in names))


def node_values(graph, name: str = "value", among: list | None = None) -> DataFrame:
    """Nodes as values of the graph's one node type, whichever tables they are read from."""
    df, entity = scan_nodes(graph, (), "v_", among)
    return df.select(ty.converted(*entity.struct(), graph.node_type()).alias(name))
