"""Updates as new snapshots: tables are immutable, a clause gives the graph after it, and a failure leaves the old one.

Rows that an update works on are written once before it, so that ids and values are decided a single time. Ids of new
entities continue the graph's counters in the order of rows, by sums over partitions. A table that can hold none of the changed entities stays as it is, unread.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import types as ty
from ..functions.expressions import Entity, Env, Value, compiled, literal
from ..plans.ast import GraphQueryError, N, semantic
from ..sources.graph import NodeTable, RelTable
from ..sources.storage import written as stored
from .match import Match, column, fresh
from .scan import scan_nodes, scan_rels


def written(state, clause: N):
    return {"create": created, "set": updated, "remove": removed, "delete": deleted, "merge": merged}[clause.kind](state, clause)


def numbered(state):
    """The rows written once, with a column that counts them from 0."""
    spark, row = state.env.graph.spark, fresh("row")
    df = state.df.withColumns({f"{row}p": F.spark_partition_id(), f"{row}m": F.monotonically_increasing_id()})
    df = stored(spark, df)
    # a row for each partition: sums of those before
    counts = df.groupBy(f"{row}p").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(f"{row}p").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(column(f"{row}p").alias(f"{row}q"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(f"{row}b"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = df.join(bases, column(f"{row}p") == column(f"{row}q"))
    number = column(f"{row}b") + column(f"{row}m").bitwiseAND(F.lit((1 << 33) - 1))
    return state.keep(df=df.withColumn(row, number).drop(*[f"{row}{x}" for x in "pmqb"])), row, total


def properties(props: N | None, state) -> dict[str, tuple[Column, ty.T]]:
    if props is None:
        return {}
    if props.kind == "param":
        value = state.env.params.get(props.name)
        if not isinstance(value, dict):
            raise semantic(f"${props.name} is not a map")
        return {k: literal(v) for k, v in value.items()}
    return {k: compiled(v, state.env) for k, v in props.items.items()}


def storable(t: ty.T) -> ty.T:
    if t.name in ("node", "relationship", "path", "map"):
        raise semantic(f"a property cannot be a {t.name}")
    return ty.STRING if t == ty.NULL else t


def created(state, clause: N):
    from ..plans.compiler import with_subqueries

    for part in clause.parts:
        for x in (*part.nodes, *part.rels):
            if x.props is not None and x.props.kind == "map":
                for k, e in x.props.items.items():
                    state, x.props.items[k] = with_subqueries(state, e)
    state, row, _ = numbered(state)
    return create_parts(state, clause.parts, row)


def create_parts(state, parts: list[N], row: str):
    for part in parts:
        bound = []
        for n in part.nodes:
            if n.var in state.env.vars:
                v = state.env.vars[n.var]
                if not isinstance(v, Entity):
                    match = Match(state.df, state.env, [])
                    v = match._entity(n.var)
                    state = state.keep(df=match.df, env=match.env)
                bound.append(v)
            else:
                state, v = create_node(state, n, row)
                bound.append(v)
        path_rels = []
        for r, a, b in zip(part.rels, bound, bound[1:], strict=False):
            state, v = create_rel(state, r, *((b, a) if r.direction == "in" else (a, b)), row)
            path_rels.append(v)
        if part.path:
            graph, path = state.env.graph, fresh("path")
            node_t, rel_t = graph.node_type(), graph.rel_type()
            value = F.struct(F.array(*[ty.converted(*v.struct(), node_t) for v in bound]).alias("nodes"), F.array(*[ty.converted(*v.struct(), rel_t) for v in path_rels]).cast(ty.to_spark(ty.list_of(rel_t))).alias("relationships"))
            state = state.keep(df=state.df.withColumn(path, value), env=state.env.bound(**{part.path: Value(column(path), ty.path_of(node_t, rel_t), path)}))
    return state


def create_node(state, n: N, row: str):
    graph, prefix, props = state.env.graph, fresh("n"), properties(n.props, state)
    first = graph.next_node
    total = state.df.count()
    labels = list(dict.fromkeys(n.labels))
    new = {f"{prefix}id": F.lit(first).cast("long") + column(row), f"{prefix}labels": F.array(*map(F.lit, labels)).cast("array<string>")}
    new |= {f"{prefix}p_{k}": c.cast(ty.to_spark(storable(t))) if t == ty.NULL else c for k, (c, t) in props.items()}
    df = stored(graph.spark, state.df.withColumns(new))
    entity = Entity("node", prefix, {k: storable(t) for k, (_, t) in props.items()})
    rows = df.select(entity.id.alias("id"), *[entity.prop(k).alias(k) for k in entity.props])
    graph = replace(graph, nodes=[*graph.nodes, NodeTable(rows, tuple(labels), dict(entity.props), ids=(first, first + total))], next_node=first + total)
    return state.keep(df=df, env=with_graph(state.env, graph, {n.var: entity} if n.var else {})), entity


def create_rel(state, r: N, source: Entity, target: Entity, row: str):
    graph, prefix, props = state.env.graph, fresh("r"), properties(r.props, state)
    first, total = graph.next_rel, state.df.count()
    new = {f"{prefix}id": F.lit(first).cast("long") + column(row), f"{prefix}src": source.id, f"{prefix}dst": target.id, f"{prefix}type": F.lit(r.types[0])}
    new |= {f"{prefix}p_{k}": c.cast(ty.to_spark(storable(t))) if t == ty.NULL else c for k, (c, t) in props.items()}
    df = stored(graph.spark, state.df.withColumns(new))
    entity = Entity("relationship", prefix, {k: storable(t) for k, (_, t) in props.items()}, (r.types[0],))
    if not df.filter(entity.col("src").isNull() | entity.col("dst").isNull()).isEmpty():
        raise GraphQueryError("RuntimeError: a created relationship needs both of its nodes")
    rows = df.select(entity.id.alias("id"), entity.col("src").alias("src"), entity.col("dst").alias("dst"), *[entity.prop(k).alias(k) for k in entity.props])
    graph = replace(graph, rels=[*graph.rels, RelTable(rows, r.types[0], dict(entity.props), ids=(first, first + total))], next_rel=first + total)
    return state.keep(df=df, env=with_graph(state.env, graph, {r.var: entity} if r.var else {})), entity


def with_graph(env: Env, graph, new: dict) -> Env:
    return Env(graph, env.params, {**env.vars, **new}, env.now)


# SET and REMOVE


def updated(state, clause: N):
    for item in clause.items:
        state = one_update(state, item)
    return state


def removed(state, clause: N):
    for item in clause.items:
        if item.kind == "remove_prop":
            state = one_update(state, N("set_prop", base=item.base, key=item.key, value=N("lit", value=None)))
        else:
            state = change(state, item.var, labels=lambda own: F.array_except(own, F.array(*map(F.lit, item.labels))))
    return state


def one_update(state, item: N):
    from ..plans.compiler import with_subqueries

    if item.kind == "set_labels":
        return change(state, item.var, labels=lambda own: F.array_sort(F.array_union(own, F.array(*map(F.lit, item.labels)))))
    state, item.value = with_subqueries(state, item.value)
    if item.kind == "set_prop":
        if item.base.kind != "var":
            raise semantic("SET needs a variable's property")
        return change(state, item.base.name, props={item.key: compiled(item.value, state.env)})
    c, t = compiled(item.value, state.env)
    if t.name != "map":
        raise semantic(f"SET of all properties needs a map, found {t}")
    new = {k: (c[k], x) for k, x in t.members}
    if not item.add:
        new = {k: (F.lit(None).cast(ty.to_spark(x)), x) for k, x in entity_of(state, item.var)[1].props.items()} | new
    return change(state, item.var, props=new)


def entity_of(state, var: str):
    if var not in state.env.vars:
        raise semantic(f"undefined variable `{var}`")
    if isinstance(state.env.vars[var], Entity):
        return state, state.env.vars[var]
    match = Match(state.df, state.env, [])
    entity = match._entity(var)
    return state.keep(df=match.df, env=match.env), entity


def touched(tables: list, ids: DataFrame, name: str) -> list[bool]:
    """For each table whether it can hold any of the ids, by one pass over them; tables without a known range of ids can."""
    asked = [(i, t.ids) for i, t in enumerate(tables) if t.ids is not None]
    hits = ids.agg(*[F.max(F.col(name).between(lo, hi - 1)).alias(f"t{i}") for i, (lo, hi) in asked]).first() if asked else {}
    return [t.ids is None or bool(hits[f"t{i}"]) for i, t in enumerate(tables)]


def change(state, var: str, props: dict | None = None, labels=None):
    """New property values or labels for the entities of a variable; of several rows for one entity the last wins."""
    state, entity = entity_of(state, var)
    state, row, _ = numbered(state)
    graph, props = state.env.graph, {k: (c, t if t == ty.NULL else storable(t)) for k, (c, t) in (props or {}).items()}
    cells = [c.cast(ty.to_spark(t)).alias(f"new_{k}") for k, (c, t) in props.items()]
    rows = state.df.filter(entity.id.isNotNull()).select(entity.id.alias("at"), column(row).alias("row"), *cells)
    last = Window.partitionBy("at").orderBy(F.desc("row"))
    rows = stored(graph.spark, rows.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "row"))
    tables, held = [], graph.nodes if entity.kind == "node" else graph.rels
    for t, hit in zip(held, touched(held, rows, "at"), strict=True):
        if not hit:  # stays as it is, not even read
            tables.append(t)
            continue
        df = t.df
        if labels is not None and t.labels is not None:
            df, t = df.withColumn("labels", F.array(*map(F.lit, t.labels)).cast("array<string>")), replace(t, labels=None)
        joined = df.join(rows, df.id == rows["at"], "left")
        own, cells = dict(t.props), {}
        for k, (_, kind) in props.items():
            if kind == ty.NULL and k not in own:
                continue
            merged_t = ty.unified(own[k], kind) if k in own else kind
            old = ty.converted(F.col(f"`{k}`"), own[k], merged_t) if k in own else F.lit(None).cast(ty.to_spark(merged_t))
            cells[k] = F.when(F.col("at").isNotNull(), ty.converted(F.col(f"`new_{k}`"), kind, merged_t)).otherwise(old)
            own[k] = merged_t
        if labels is not None:
            cells["labels"] = F.when(F.col("at").isNotNull(), labels(F.col("labels"))).otherwise(F.col("labels"))
        joined = joined.withColumns(cells).drop("at", *[f"new_{k}" for k in props])
        tables.append(replace(t, df=stored(graph.spark, joined), props=own))
    graph = replace(graph, **({"nodes": tables} if entity.kind == "node" else {"rels": tables}))
    return refreshed(state.keep(env=with_graph(state.env, graph, {})), entity.kind)


def refreshed(state, kind: str):
    """Variables of the kind read again from the graph, so that later clauses see the update."""
    df, new, graph = state.df, {}, state.env.graph
    for name, v in state.env.vars.items():
        if isinstance(v, Entity) and v.kind == kind:
            if kind == "node":
                among = [t for t, hit in zip(graph.nodes, touched(graph.nodes, state.df.select(v.id.alias("at")), "at"), strict=True) if hit]
                fresh_rows, entity = scan_nodes(graph, (), fresh("n"), among)
            else:
                fresh_rows, entity = scan_rels(graph, v.types, "out", fresh("r"))
            df = df.join(fresh_rows, v.id == entity.id, "left")
            new[name] = entity
    return state.keep(df=stored(state.env.graph.spark, df), env=state.env.bound(**new))


# DELETE


def deleted(state, clause: N):
    from ..plans.compiler import with_subqueries

    graph, node_ids, rel_ids = state.env.graph, [], []
    state, _, _ = numbered(state)
    for e in clause.exprs:
        state, e = with_subqueries(state, e)
        c, t = compiled(e, state.env)
        if t == ty.NULL:
            continue
        if t.name not in ("node", "relationship", "path"):
            raise semantic(f"DELETE of {t}")
        if t.name == "path":
            node_ids.append(state.df.select(F.explode(F.transform(c["nodes"], lambda x: x["id"])).alias("gone")))
            rel_ids.append(state.df.select(F.explode(F.transform(c["relationships"], lambda x: x["id"])).alias("gone")))
        else:
            (node_ids if t.name == "node" else rel_ids).append(state.df.select(c["id"].alias("gone")))

    def ids(frames: list[DataFrame]) -> DataFrame:
        out = graph.spark.createDataFrame([], "gone long")
        for f in frames:
            out = out.unionByName(f)
        return stored(graph.spark, out.filter("gone is not null").distinct())

    nodes, rels = ids(node_ids), ids(rel_ids)
    tables, gone_from = [], [t for t, hit in zip(graph.nodes, touched(graph.nodes, nodes, "gone"), strict=True) if hit] if node_ids else []
    for t, hit in zip(graph.rels, touched(graph.rels, rels, "gone"), strict=True):
        ends = gone_from and (None in t.ends or any(x.labels is None or any(set(e) <= set(x.labels) for e in t.ends) for x in gone_from))
        if not (hit and rel_ids) and not ends:  # neither its relationships nor their ends go
            tables.append(t)
            continue
        df = t.df.join(rels, t.df.id == rels.gone, "left_anti")
        if ends:
            either = F.array("src", "dst")
            touching = df.select("id", F.explode(either).alias("end")).join(nodes, F.col("end") == nodes.gone, "left_semi").select(F.col("id").alias("touched")).distinct()
            if not clause.detach and not touching.isEmpty():
                raise GraphQueryError("RuntimeError: a node that still has relationships cannot be deleted")
            df = df.join(touching, df.id == touching.touched, "left_anti")
        tables.append(replace(t, df=stored(graph.spark, df)))
    kept = [replace(t, df=stored(graph.spark, t.df.join(nodes, t.df.id == nodes.gone, "left_anti"))) if any(t is x for x in gone_from) else t for t in graph.nodes]
    return state.keep(env=with_graph(state.env, replace(graph, nodes=kept, rels=tables), {}))


# MERGE


def merged(state, clause: N):
    """Rows that match keep their matches; the others create the pattern once for each distinct set of its values."""
    from ..plans.compiler import with_subqueries

    part = clause.part
    for x in (*part.nodes, *part.rels):
        if x.props is not None:
            for k, e in x.props.items.items():
                state, x.props.items[k] = with_subqueries(state, e)
    state, row, _ = numbered(state)
    values, cells = {}, {}
    for x in (*part.nodes, *part.rels):
        for k, e in (x.props.items if x.props is not None else {}).items():
            name = fresh("m")
            c, t = compiled(e, state.env)
            cells[name] = c if t != ty.NULL else F.lit(None).cast("string")
            values[name] = t
            x.props.items[k] = N("var", name=f" {name}")
    df = state.df.withColumns(cells) if cells else state.df
    hidden = {f" {n}": Value(column(n), t, n) for n, t in values.items()}
    outer = state.env
    state = state.keep(df=df, env=outer.bound(**hidden))
    anonymous = [x for x in (*part.nodes, *part.rels) if x.var is None]
    for x in anonymous:
        x.var = fresh(" anon")
    for x in part.rels:
        if x.direction == "both":
            x.direction = "out"
            both = N("part", path=part.path, nodes=part.nodes, rels=[N("rel", **{**y.members(), "direction": "both"}) if y is x else y for y in part.rels])
            break
    else:
        both = part
    hit, _ = Match(state.df, state.env, [both]).run()
    hit_rows = stored(state.env.graph.spark, hit.select(column(row).alias("hit")).distinct())
    missing = state.df.join(hit_rows, column(row) == hit_rows.hit, "left_anti")
    for n in values:
        if not missing.filter(column(n).isNull()).isEmpty():
            raise GraphQueryError("RuntimeError: a property of MERGE is null")
    bound = [v.id for x in part.nodes if isinstance(v := state.env.vars.get(x.var), Entity)]
    keys = [*map(column, values), *bound]
    order = Window.partitionBy(*keys).orderBy(column(row)) if keys else Window.partitionBy(F.lit(1)).orderBy(column(row))
    first = stored(state.env.graph.spark, missing.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth"))
    made = state.keep(df=first)
    if not first.isEmpty():
        made, at, _ = numbered(made)
        made = create_parts(made, [part], at)
    graph = made.env.graph
    new_rows = first.select(column(row).alias("made"))
    state = state.keep(env=with_graph(state.env, graph, {}))
    found, env = Match(state.df, state.env, [both]).run()
    created_flag = fresh("made")
    found = found.join(new_rows.withColumn(created_flag, F.lit(True)), column(row) == F.col("made"), "left").drop("made")
    state = state.keep(df=stored(graph.spark, found), env=env)
    for kind, items in clause.actions:
        wanted = column(created_flag).isNotNull() if kind == "create" else column(created_flag).isNull()
        for item in items:
            state = conditional(state, item, wanted)
    drop = [n for n in state.env.vars if n in hidden]
    env = Env(state.env.graph, state.env.params, {n: v for n, v in state.env.vars.items() if n not in drop}, state.env.now)
    return state.keep(env=env)


def conditional(state, item: N, wanted: Column):
    """An update on those rows only for which wanted holds: for the others the entity is null."""
    target = item.base.name if item.kind == "set_prop" else item.var
    state, entity = entity_of(state, target)
    prefix = fresh("only")
    df = state.df.withColumns({prefix + c.removeprefix(entity.prefix): F.when(wanted, column(c)) for c in entity.columns()})
    alias = f" {prefix}"
    only = Entity(entity.kind, prefix, entity.props, entity.types)
    renamed = N(item.kind, **(item.members() | ({"base": N("var", name=alias)} if item.kind == "set_prop" else {"var": alias})))
    state = one_update(state.keep(df=df, env=state.env.bound(**{alias: only})), renamed)
    return state.keep(env=Env(state.env.graph, state.env.params, {n: v for n, v in state.env.vars.items() if n != alias}, state.env.now))
