"""Property graphs over DataFrames: node tables by label, relationship tables by type, and their mapping from tables.

A node's id is its label's number times 2**48 plus its key, a relationship's its type's number times 2**48 plus a row
key; both are computed from the rows alone, so that no shuffle is needed and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as ty

SPAN = 1 << 48


@dataclass
class NodeTable:
    """df has id, properties, and labels where they are not the same for all rows; ids: a range that all ids lie in, where known."""

    df: DataFrame
    labels: tuple[str, ...] | None
    props: dict[str, ty.T]
    unique: tuple[str, ...] = ()
    rows: int | None = None
    ids: tuple[int, int] | None = None


@dataclass
class RelTable:
    """df has id, src, dst and properties; ends: labels that all sources and targets have, where known; ids: as for nodes."""

    df: DataFrame
    type: str
    props: dict[str, ty.T]
    ends: tuple[tuple[str, ...] | None, tuple[str, ...] | None] = (None, None)
    rows: int | None = None
    ids: tuple[int, int] | None = None


def _props(df: DataFrame, besides: set[str]) -> dict[str, ty.T]:
    return {f.name: ty.from_spark(f.dataType) for f in df.schema.fields if f.name not in besides}


def _widened(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, floats as doubles, timestamps without a zone."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), ty.from_spark(f.dataType)
        out.append((c.cast(ty.to_spark(t)) if t in (ty.INT, ty.FLOAT, ty.LOCALDATETIME) and f.dataType != ty.to_spark(t) else c).alias(f.name))
    return df.select(*out)


@dataclass
class PropertyGraph:
    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    next_node: int = 0
    next_rel: int = 0

    def with_nodes(self, label: str | tuple[str, ...], df: DataFrame, key: str, unique: tuple[str, ...] = (), rows: int | None = None) -> PropertyGraph:
        """Adds a node table; key is the column that tells the rows apart, other columns are properties as well."""
        labels, number = (label,) if isinstance(label, str) else label, len(self.nodes)
        wide = _widened(df)
        out = wide.select((F.lit(number * SPAN) + F.col(key).cast("long")).alias("id"), *[F.col(f"`{c}`") for c in wide.columns if c != "id"])
        return replace(self, nodes=[*self.nodes, NodeTable(out, labels, _props(out, {"id"}), unique, rows, (number * SPAN, (number + 1) * SPAN))], next_node=max(self.next_node, (number + 1) * SPAN))

    def with_relationships(self, type_: str, df: DataFrame, source: tuple[str, str], target: tuple[str, str], key: str, props: dict[str, str] | None = None, rows: int | None = None) -> PropertyGraph:
        """Adds a relationship table; source and target are (label, key column), key is the row's own number, props names columns."""
        number = len(self.rels)
        base = {t.labels[0]: i for i, t in reversed([*enumerate(self.nodes)]) if t.labels}
        kept = _widened(df.select(*[F.col(c).alias(n) for n, c in (props or {}).items()], F.col(key).alias("_key"), *[F.col(c).alias(f"_{n}") for (_, c), n in ((source, "src"), (target, "dst"))]))
        ends = [(F.lit(base[label] * SPAN) + F.col(f"_{name}").cast("long")).alias(name) for (label, _), name in ((source, "src"), (target, "dst"))]
        out = kept.select((F.lit(number * SPAN) + F.col("_key").cast("long")).alias("id"), *ends, *(props or {}))
        return replace(self, rels=[*self.rels, RelTable(out, type_, _props(out, {"id", "src", "dst"}), ((source[0],), (target[0],)), rows, (number * SPAN, (number + 1) * SPAN))], next_rel=max(self.next_rel, (number + 1) * SPAN))

    def with_entities(self, nodes: DataFrame | None, rels: list[tuple[str, DataFrame]]) -> PropertyGraph:
        """A graph of nodes with their own labels column (id, labels, properties) and relationships (id, src, dst, properties) by type."""
        tables = [NodeTable(_widened(nodes), None, _props(nodes, {"id", "labels"}))] if nodes is not None else []
        return replace(self, nodes=[*self.nodes, *tables], rels=[*self.rels, *(RelTable(_widened(d), t, _props(d, {"id", "src", "dst"})) for t, d in rels)])

    def node_tables(self, labels) -> list[NodeTable]:
        return [t for t in self.nodes if t.labels is None or set(labels) <= set(t.labels)]

    def rel_tables(self, types) -> list[RelTable]:
        return [t for t in self.rels if not types or t.type in types]

    def tables_at(self, types, ends: tuple[int, ...]) -> list[NodeTable] | None:
        """The node tables that sources (0) or targets (1) of relationships of the types can lie in; None where their tables do not say."""
        labels = [t.ends[e] for t in self.rel_tables(types) for e in ends]
        if any(x is None for x in labels):
            return None
        return [t for t in self.nodes if t.labels is None or any(set(x) <= set(t.labels) for x in labels)]

    def node_type(self) -> ty.T:
        props: dict[str, ty.T] = {}
        for t in self.nodes:
            for k, v in t.props.items():
                props[k] = ty.unified(props[k], v) if k in props else v
        return ty.node_of(props)

    def rel_type(self, types=()) -> ty.T:
        props: dict[str, ty.T] = {}
        for t in self.rel_tables(types):
            for k, v in t.props.items():
                props[k] = ty.unified(props[k], v) if k in props else v
        return ty.rel_of(props)

    def cypher(self, text: str, **params) -> DataFrame:
        """Runs a reading query; writing ones go through execute()."""
        from ..plans.compiler import run_query

        return run_query(self, text, params)[0]

    def execute(self, text: str, **params) -> tuple[DataFrame, PropertyGraph]:
        """Runs any query: its rows, and the graph after it. The graph at hand stays as it is, so a failure changes nothing."""
        from ..plans.compiler import run_query

        return run_query(self, text, params, writable=True)

    def nodes_as_values(self) -> DataFrame:
        """Every node as one struct column, value."""
        from ..operators.scan import node_values

        return node_values(self)


def warehouse_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """The star-schema tables in folder as a graph; properties drop the tables' prefixes."""

    def table(name: str, prefix: str = "") -> DataFrame:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        return df.select(*[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns])

    region, nation = table("region", "r_"), table("nation", "n_")
    customer, supplier, part, orders = table("customer", "c_"), table("supplier", "s_"), table("part", "p_"), table("orders", "o_")
    lines, events, turns = table("lineitem", "l_"), table("events"), table("conversations")
    turns = turns.withColumn("key", F.col("conv_id") * 65536 + F.col("turn"))
    users = events.select(F.col("user_id")).distinct()
    g = PropertyGraph(spark)
    for label, df, key in (("Region", region, "regionkey"), ("Nation", nation, "nationkey"), ("Customer", customer, "custkey"), ("Supplier", supplier, "suppkey"), ("Part", part, "partkey"), ("Order", orders, "orderkey"), ("User", users, "user_id"), ("Event", events, "event_id")):
        g = g.with_nodes(label, df, key, (key,))
    g = g.with_nodes("Document", table("documents").drop("text"), "doc_id", ("doc_id",)).with_nodes("Turn", turns, "key")
    # lines have no unique key: the hash of the whole row tells them apart
    lines = lines.withColumn("line_id", F.shiftrightunsigned(F.xxhash64(*lines.columns), 17))
    g = g.with_relationships("IN_REGION", nation, ("Nation", "nationkey"), ("Region", "regionkey"), "nationkey")
    g = g.with_relationships("IN_NATION", customer, ("Customer", "custkey"), ("Nation", "nationkey"), "custkey")
    g = g.with_relationships("IN_NATION", supplier, ("Supplier", "suppkey"), ("Nation", "nationkey"), "suppkey")
    g = g.with_relationships("PLACED", orders, ("Customer", "custkey"), ("Order", "orderkey"), "orderkey")
    props = {c: c for c in ("linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")}
    g = g.with_relationships("CONTAINS", lines, ("Order", "orderkey"), ("Part", "partkey"), "line_id", props)
    g = g.with_relationships("SUPPLIED", lines, ("Supplier", "suppkey"), ("Part", "partkey"), "line_id", {"quantity": "quantity"})
    g = g.with_relationships("DID", events, ("User", "user_id"), ("Event", "event_id"), "event_id")
    following = turns.select("key", (F.col("key") + 1).alias("next")).join(turns.select(F.col("key").alias("next")), "next")
    return g.with_relationships("NEXT", following, ("Turn", "key"), ("Turn", "next"), "key")
