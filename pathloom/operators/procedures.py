"""Procedures on the schema of a graph: small tables that a CALL joins to its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import semantic
from .scan import union_all

#: name: (signature, description)
PROCEDURES = {
    "db.labels": ("db.labels() :: (label :: STRING)", "Labels of all nodes"),
    "db.propertyKeys": ("db.propertyKeys() :: (propertyKey :: STRING)", "Names of all properties in use"),
    "db.relationshipTypes": ("db.relationshipTypes() :: (relationshipType :: STRING)", "Types of all relationships"),
    "dbms.procedures": ("dbms.procedures() :: (name :: STRING, signature :: STRING, description :: STRING, mode :: STRING, worksOnSystem :: BOOLEAN)", "All procedures"),
}


def records(graph, name: str, args: list) -> DataFrame:
    found = next((p for p in PROCEDURES if p.lower() == name.lower()), None)
    if found is None:
        raise semantic(f"unknown procedure {name}")
    if args:
        raise semantic(f"{found} takes no arguments")
    spark = graph.spark
    if found == "db.labels":
        frames = [t.df.limit(1).select(F.explode(F.array(*map(F.lit, t.labels))).alias("label")) if t.labels else t.df.select(F.explode("labels").alias("label")) for t in graph.nodes if t.labels != ()]
        return union_all(frames).distinct().orderBy("label") if frames else spark.createDataFrame([], "label string")
    if found == "db.relationshipTypes":
        frames = [t.df.limit(1).select(F.lit(t.type).alias("relationshipType")) for t in graph.rels]
        return union_all(frames).distinct().orderBy("relationshipType") if frames else spark.createDataFrame([], "relationshipType string")
    if found == "db.propertyKeys":
        frames = [t.df.select(F.explode(F.array(*[F.when(F.col(f"`{p}`").isNotNull(), F.lit(p)) for p in t.props])).alias("propertyKey")).distinct() for t in (*graph.nodes, *graph.rels) if t.props]
        return union_all(frames).filter("propertyKey is not null").distinct().orderBy("propertyKey") if frames else spark.createDataFrame([], "propertyKey string")
    rows = [(n, s, d, "READ", True) for n, (s, d) in sorted(PROCEDURES.items())]
    return spark.createDataFrame(rows, "name string, signature string, description string, mode string, worksOnSystem boolean")
