"""Queries to frames: each clause takes the frame and the variables before it and gives those after it.

Subqueries (EXISTS, pattern comprehensions, OPTIONAL MATCH) are joins: the distinct values of the outer variables that
they refer to are the domain, the subquery runs on the domain, and its result joins back null-safely.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import types as ty
from ..functions.expressions import AGGREGATES, Entity, Env, Value, boolean, compiled, constant
from ..operators.match import Counted, Match, Usage, column, fresh, names_in
from ..operators.procedures import records
from . import validator
from .ast import N, semantic
from .parser import parse

WRITES = {"create", "merge", "set", "remove", "delete"}


@dataclass
class State:
    df: DataFrame
    env: Env
    usage: Usage | None
    #: In a subquery: the columns that tell the outer rows' values apart, and all their values.
    carry: tuple[str, ...] = ()
    outer: DataFrame | None = None
    #: Where a row stands for several: the column that says for how many.
    weight: str | None = None

    def keep(self, **changes) -> State:
        return replace(self, **changes)


def run_query(graph, text: str, params: dict | None = None, writable: bool = False):
    """The rows of a query, and the graph after it."""
    tree = parse(text)
    validator.check(tree)
    if not writable and any(x.kind in WRITES for x in tree.walk()):
        raise semantic("a writing query needs execute()")
    env = Env(graph, dict(params or {}))
    parts = tree.parts if tree.kind == "union" else [tree]
    out = None
    for part in parts:
        df, env = run_single(part, Env(env.graph, env.params, {}, env.now), Usage(part))
        if out is None:
            out = df
        elif out.columns != df.columns:
            raise semantic("UNION parts need the same columns")
        else:
            out = out.unionByName(df)
    if tree.kind == "union" and not tree.all:
        out = out.distinct()
    return out, env.graph


def run_single(tree: N, env: Env, usage: Usage) -> tuple[DataFrame, Env]:
    state = State(env.graph.spark.range(1).select(), env, usage)
    for clause, after in zip(tree.clauses, [*tree.clauses[1:], None], strict=True):
        if clause.kind == "return":
            return returned(state, clause), state.env
        state = matched(state, clause, counted(state, clause, after)) if clause.kind == "match" and not clause.optional else applied(state, clause)
    if tree.clauses[-1].kind == "call" and tree.clauses[-1].alone:
        names = [n for n in state.env.vars]
        return state.df.select(*[state.env.vars[n].column.alias(n) for n in names]), state.env
    return state.df.select().limit(0), state.env


def applied(state: State, clause: N) -> State:
    if clause.kind == "match":
        return optional_match(state, clause) if clause.optional else matched(state, clause)
    if clause.kind == "unwind":
        return unwound(state, clause)
    if clause.kind == "with":
        return projected(state, clause)
    if clause.kind == "call":
        return called(state, clause)
    from ..operators.writes import written

    return written(state, clause)


def matched(state: State, clause: N, only: Counted | None = None) -> State:
    df, env = Match(state.df, state.env, clause.parts, state.usage, only).run()
    if only is None or only.weight is None:
        return where(state.keep(df=df, env=env), clause.where)
    state = state.keep(df=df, env=env, weight=only.weight)
    for part in only.predicates:
        state = state if part in only.taken else where(state, part)
    return state


def counted(state: State, clause: N, after: N | None) -> Counted | None:
    """What the clause after a MATCH reads of it, if that clause does nothing but count its rows, by groups or all."""
    if after is None or after.kind not in ("return", "with") or after.star or state.carry:
        return None
    exprs = [e for e, _ in (*after.items, *after.order)]
    calls = [x for e in exprs for x in e.walk() if is_aggregate(x)]
    if not any(has_aggregate(e) for e, _ in after.items) or not all(x.name.lower() == "count" and x.star for x in calls):
        return None
    if any(x.kind == "call_fn" and x.name.lower() == "rand" for t in (clause, after) for x in t.walk()):  # drawn anew for each row
        return None
    return Counted(names_in(exprs), conjuncts(clause.where) if clause.where is not None else [])


def conjuncts(e: N) -> list[N]:
    return conjuncts(e.left) + conjuncts(e.right) if e.kind == "binary" and e.op == "and" else [e]


def where(state: State, e: N | None) -> State:
    """Keeps rows for which the predicate is true; EXISTS and NOT EXISTS at the top are semi and anti joins."""
    for part in conjuncts(e) if e is not None else []:
        negated, inner = (True, part.expr) if part.kind == "not" else (False, part)
        if inner.kind == "exists":
            state = semi(state, inner, "left_anti" if negated else "left_semi")
        else:
            width = state.df.columns
            inside, part = with_subqueries(state, part)
            state = state.keep(df=inside.df.filter(boolean(part, inside.env)).select(*map(column, width)))
    return state


# subqueries


def free_variables(tree, env: Env) -> list[str]:
    """Outer variables that a subquery refers to, in patterns as well."""
    names = names_in(tree)
    return [n for n in env.vars if n in names]


def key_of(v: Entity | Value) -> Column:
    return v.id if isinstance(v, Entity) else v.column


def domain(state: State, names: list[str]) -> tuple[State, list[Column]]:
    """Distinct values of the named variables with their keys as carried columns, and the keys of the outer frame."""
    outer = [key_of(state.env.vars[n]) for n in names]
    keys = [fresh("k") for _ in names]
    columns = dict.fromkeys(c for n in names for c in state.env.vars[n].columns())
    df = state.df.select(*map(column, columns), *[c.alias(k) for c, k in zip(outer, keys, strict=True)])
    df = df.dropDuplicates(keys) if names else state.env.graph.spark.range(1).select()
    env = replace(state.env, vars={n: state.env.vars[n] for n in names})
    return State(df, env, state.usage, tuple(keys), df.select(*map(column, keys)) if names else None), outer


def joined_back(df: DataFrame, outer: list[Column], inner: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    on = F.lit(True)
    for c, k in zip(outer, keys, strict=True):
        on = on & c.eqNullSafe(column(k))
    return df.join(inner, on, how)


def run_inner(inside: State, query: N) -> State:
    """The clauses of a subquery up to its RETURN, which counts where it can change which outer rows have any: by SKIP, LIMIT or an aggregation."""
    for clause in query.clauses:
        if clause.kind == "return":
            if clause.skip is not None or clause.limit is not None or any(has_aggregate(e) for e, _ in clause.items):
                inside = projected(inside, clause)
            break
        inside = applied(inside, clause)
    return inside


def found_keys(inside: State, query: N) -> DataFrame:
    """The keys of the outer values for which the subquery has rows (more than once where it has several)."""
    out = None
    for part in query.parts if query.kind == "union" else [query]:
        df = run_inner(inside, part).df.select(*map(column, inside.carry))
        out = df if out is None else out.unionByName(df)
    return out


def semi(state: State, e: N, how: str) -> State:
    inside, outer = domain(state, free_variables(e.query, state.env))
    return state.keep(df=joined_back(state.df, outer, found_keys(inside, e.query), inside.carry, how))


def with_subqueries(state: State, e: N) -> tuple[State, N]:
    """The expression with its subqueries replaced by variables, which joins have added to the frame."""
    inner = next((x for x in e.walk() if x.kind in ("exists", "pattern_comprehension") or (x.kind == "call_fn" and x.name.lower() in ("startnode", "endnode"))), None)
    while inner is not None:
        name = fresh(" s")
        state = subquery(state, inner, name)
        same = inner.identity()
        e = e.replaced(lambda x, same=same, name=name: N("var", name=name) if x.identity() == same else None)
        inner = next((x for x in e.walk() if x.kind in ("exists", "pattern_comprehension") or (x.kind == "call_fn" and x.name.lower() in ("startnode", "endnode"))), None)
    return state, e


def subquery(state: State, e: N, name: str) -> State:
    out = fresh("s")
    if e.kind == "call_fn":
        return end_node(state, e, name, out)
    if e.kind == "exists":
        inside, outer = domain(state, free_variables(e.query, state.env))
        found = found_keys(inside, e.query)
        found = found.distinct().withColumn(out, F.lit(True)) if inside.carry else found.limit(1).agg((F.count(F.lit(1)) > 0).alias(out))
        value, t = F.coalesce(column(out), F.lit(False)), ty.BOOL
    else:
        query = N("single", clauses=[N("match", optional=False, parts=[e.part], where=e.where)])
        inside, outer = domain(state, free_variables([query, e.expr], state.env))
        inside = run_inner(inside, query)
        inside, expr = with_subqueries(inside, e.expr)
        c, t = compiled(expr, inside.env)
        t = ty.list_of(t)
        rows = inside.df.groupBy(*map(column, inside.carry)) if inside.carry else inside.df.groupBy()
        found = rows.agg(F.transform(F.collect_list(F.struct(c.alias("v"))), lambda x: x["v"]).alias(out))
        value = F.coalesce(column(out), F.array().cast(ty.to_spark(t)))
    joined = joined_back(state.df, outer, found, inside.carry, "left").drop(*inside.carry).withColumn(out, value)
    return state.keep(df=joined, env=state.env.bound(**{name: Value(column(out), t, out)}))


def end_node(state: State, e: N, name: str, out: str) -> State:
    from ..operators.scan import node_values

    c, t = compiled(e.args[0], state.env)
    if t.name != "relationship":
        raise semantic(f"{e.name}() needs a relationship")
    own = state.env.vars.get(e.args[0].name) if e.args[0].kind == "var" else None
    types = own.types if isinstance(own, Entity) else ()
    nodes = node_values(state.env.graph, out, state.env.graph.tables_at(types, (0 if e.name.lower() == "startnode" else 1,)))
    joined = state.df.join(nodes, c["src" if e.name.lower() == "startnode" else "dst"] == column(out)["id"], "left")
    return state.keep(df=joined, env=state.env.bound(**{name: Value(column(out), state.env.graph.node_type(), out)}))


def optional_match(state: State, clause: N) -> State:
    query = N("single", clauses=[N("match", optional=False, parts=clause.parts, where=clause.where)])
    inside, outer = domain(state, free_variables(query, state.env))
    inside = run_inner(inside, query)
    new = {n: v for n, v in inside.env.vars.items() if n not in state.env.vars}
    columns = list(dict.fromkeys(c for v in new.values() for c in [*v.columns(), *([v.inner] if hasattr(v, "inner") else [])]))
    df = joined_back(state.df, outer, inside.df.select(*map(column, (*inside.carry, *columns))), inside.carry, "left").drop(*inside.carry)
    return state.keep(df=df, env=state.env.bound(**new))


# rows


def unwound(state: State, clause: N) -> State:
    state, e = with_subqueries(state, clause.expr)
    c, t = compiled(e, state.env)
    out = fresh("u")
    if t == ty.NULL or t.name != "list":  # only lists have rows
        df, elem = state.df.withColumn(out, F.lit(None).cast("string")).limit(0), ty.NULL
    else:
        df, elem = state.df.withColumn(out, F.explode(c)), t.elem
    return state.keep(df=df, env=state.env.bound(**{clause.alias: Value(column(out), elem, out)}))


def called(state: State, clause: N) -> State:
    rows = records(state.env.graph, clause.name, clause.args)
    wanted = clause.yields if clause.yields is not None else [(c, c) for c in rows.columns]
    new = {}
    for name, alias in wanted:
        if name not in rows.columns:
            raise semantic(f"{clause.name} has no result {name!r}")
        if alias in state.env.vars or alias in new:
            raise semantic(f"`{alias}` is bound already")
        out = fresh("c")
        rows = rows.withColumnRenamed(name, out)
        new[alias] = Value(column(out), ty.from_spark(rows.schema[out].dataType), out)
    rows = rows.select(*[column(v.name) for v in new.values()])
    df = state.df.crossJoin(rows) if state.df.columns else rows
    return where(state.keep(df=df, env=state.env.bound(**new)), clause.where)


def is_aggregate(e: N) -> bool:
    return e.kind == "call_fn" and e.name.lower() in AGGREGATES


def has_aggregate(e: N) -> bool:
    """Whether an expression aggregates; what a subquery does inside is its own."""
    return is_aggregate(e) or e.kind != "exists" and any(has_aggregate(x) for x in e.children())


def items_of(state: State, clause: N) -> list[tuple[N, str]]:
    items = [(N("var", name=n), n) for n in state.env.vars if not n.startswith(" ")] if clause.star else []
    items += [(e, alias or (e.name if e.kind == "var" else e.text)) for e, alias in clause.items]
    names = [n for _, n in items]
    if len(set(names)) < len(names):
        raise semantic("two columns have the same name")
    if clause.star and not items:
        raise semantic("* needs a variable in scope")
    return items


def projected(state: State, clause: N) -> State:
    """WITH and RETURN: the projection, its order and its part; the variables after it are its columns."""
    items = items_of(state, clause)
    grouped = any(has_aggregate(e) for e, _ in items)
    state, order = aggregated(state, items, clause) if grouped else plain(state, items, clause)
    df = state.df
    skip, limit = (None if n is None else whole_number(n, state.env) for n in (clause.skip, clause.limit))
    if state.carry and not (skip is None and limit is None):  # of the rows of each outer value
        place = fresh("nth")
        within = Window.partitionBy(*map(column, state.carry)).orderBy(*(order or [F.lit(0)]))
        df = df.withColumn(place, F.row_number().over(within)).filter(column(place) > (skip or 0))
        df = df if limit is None else df.filter(column(place) <= (skip or 0) + limit)
    else:
        df = df if skip is None else df.offset(skip)
        df = df if limit is None else df.limit(limit)
    columns = list(dict.fromkeys([c for v in state.env.vars.values() for c in v.columns()] + [*state.carry]))
    state = state.keep(df=df.select(*map(column, columns)))
    return where(state, clause.where)


def whole_number(e: N, env: Env) -> int:
    """SKIP and LIMIT are whole numbers known before the query runs."""
    if any(x.kind in ("var", "prop") for x in e.walk() if x.kind == "var"):
        raise semantic("SKIP and LIMIT cannot refer to variables")
    try:
        value = constant(e, env)
    except ValueError:
        state, e = with_subqueries(State(env.graph.spark.range(1).select(), Env(env.graph, env.params), None), e)
        value = state.df.select(compiled(e, state.env)[0].alias("n")).first()["n"]
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise semantic("SKIP and LIMIT need whole numbers from 0")
    return value


def sort_key(c: Column, descending: bool) -> Column:
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def sortable(c: Column, t: ty.T) -> Column:
    if t == ty.TIME:
        return c["nanos"] - c["offset"] * 1_000_000_000
    if t.name in ("node", "relationship"):
        return c["id"]
    return c


def plain(state: State, items: list, clause: N):
    before, new, added = state, {}, {}
    for e, name in items:
        if e.kind == "var" and e.name in state.env.vars and isinstance(state.env.vars[e.name], Entity):
            new[name] = state.env.vars[e.name]
            continue
        before, e = with_subqueries(before, e)
        c, t = compiled(e, before.env)
        out = fresh("p")
        added[out] = c
        new[name] = Value(column(out), t, out)
        if e.kind == "var" and isinstance(old := before.env.vars.get(e.name), Value) and hasattr(old, "inner"):
            new[name] = old
            added.pop(out)
    df = before.df.withColumns(added) if added else before.df
    after = Env(state.env.graph, state.env.params, new, state.env.now)
    if clause.distinct:
        columns = dict.fromkeys([c for v in new.values() for c in v.columns()] + [*state.carry])
        keys = [f"{v.prefix}id" if isinstance(v, Entity) else v.name for v in new.values()] + [*state.carry]
        df = df.select(*map(column, columns)).dropDuplicates(keys)
    scope = after if clause.distinct else replace(before.env, vars={**before.env.vars, **new})
    keys, inside = [], State(df, scope, state.usage, state.carry)
    for e, descending in clause.order:
        e = aliased(e, items)
        inside, e = with_subqueries(inside, e)
        keys.append(sort_key(sortable(*compiled(e, inside.env)), descending))
    df = inside.df.orderBy(*keys) if keys else inside.df
    return state.keep(df=df, env=after), keys


def aliased(e: N, items: list) -> N:
    """An ORDER BY expression in terms of the projection's columns where they are the same."""
    by = {x.identity(): name for x, name in items}
    return e.replaced(lambda x: N("var", name=by[x.identity()]) if x.identity() in by else None)


def aggregated(state: State, items: list, clause: N):
    env, keys, new, group, firsts = state.env, {}, {}, [], []
    inside, plain_items = state, [(e, n) for e, n in items if not has_aggregate(e)]
    added = {}
    for e, name in plain_items:
        source = e
        if e.kind == "var" and isinstance(env.vars.get(e.name), Entity):
            v = new[name] = env.vars[e.name]
            group.append(f"{v.prefix}id")
            firsts += [c for c in v.columns() if c != f"{v.prefix}id"]
        else:
            inside, e = with_subqueries(inside, e)
            c, t = compiled(e, inside.env)
            out = fresh("g")
            added[out] = c
            group.append(out)
            new[name] = Value(column(out), t, out)
        keys[source.identity()] = name
    calls: dict = {}

    def extract(e: N) -> N:
        def one(x: N):
            if x.identity() in keys:
                return N("var", name=keys[x.identity()])
            if is_aggregate(x):
                if any(has_aggregate(a) for a in x.args):
                    raise semantic("an aggregation inside an aggregation")
                if x.identity() not in calls:
                    calls[x.identity()] = (x, fresh(" a"))
                return N("var", name=calls[x.identity()][1])
            return None

        return e.replaced(one)

    results = [(extract(e), name) for e, name in items if has_aggregate(e)]
    orders = [(extract(aliased(e, items)), d) for e, d in clause.order]
    aggregates, outs, values = [], [], {}
    for x, hidden in calls.values():
        inside, args = all_with_subqueries(inside, x.args)
        out, arg = fresh("a"), fresh("x")
        outs.append(out)
        c, t, argument = aggregate(x, args, inside.env, arg, state.weight)
        if argument is not None:
            added[arg] = argument
        aggregates.append(c.alias(out))
        values[hidden] = Value(column(out), t, out)
    df = inside.df.withColumns(added) if added else inside.df
    if state.outer is not None and not group:  # an aggregation without keys has a row for every outer value
        hit = fresh("hit")
        df = with_all_outer(df.withColumn(hit, F.lit(True)), state)
        aggregates = [F.count(column(hit)).alias(out) if x.star else c for (x, _), c, out in zip(calls.values(), aggregates, outs, strict=True)]
    group += [c for c in state.carry if c not in group]
    firsts = [F.first(column(c)).alias(c) for c in dict.fromkeys(firsts) if c not in group]
    df = df.groupBy(*map(column, dict.fromkeys(group))).agg(*aggregates, *firsts) if group else df.agg(*aggregates)
    after = Env(env.graph, env.params, {**new, **values}, env.now)
    made = {}
    for e, name in results:
        c, t = compiled(e, after)
        out = fresh("p")
        made[out] = c
        after.vars[name] = Value(column(out), t, out)
    df = df.withColumns(made) if made else df
    order = [sort_key(sortable(*compiled(e, after)), d) for e, d in orders]
    df = df.orderBy(*order) if order else df
    final = Env(env.graph, env.params, {name: after.vars[name] for _, name in items}, env.now)
    return state.keep(df=df, env=final, weight=None), order


def with_all_outer(df: DataFrame, state: State) -> DataFrame:
    """The rows, and one of nulls for each outer value that has none."""
    again = {k: fresh("k") for k in state.carry}
    every = state.outer.select(*[column(k).alias(n) for k, n in again.items()])
    on = F.lit(True)
    for k, n in again.items():
        on = on & column(n).eqNullSafe(column(k))
    return every.join(df, on, "left").drop(*state.carry).withColumnsRenamed({n: k for k, n in again.items()})


def all_with_subqueries(state: State, args: list[N]):
    out = []
    for a in args:
        state, a = with_subqueries(state, a)
        out.append(a)
    return state, out


def aggregate(x: N, args: list[N], env: Env, name: str, weight: str | None = None) -> tuple[Column, ty.T, Column | None]:
    """The aggregation over the column called name, its type, and what that column holds."""
    kind = x.name.lower()
    if kind == "count" and x.star:
        return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(column(weight)), F.lit(0).cast("long")), ty.INT, None
    least = AGGREGATES[kind]
    if len(args) != least:
        raise semantic(f"{x.name}() takes {least} arguments")
    if args[0].kind == "var" and isinstance(v := env.vars.get(args[0].name), Entity) and kind == "count":
        c, t = v.id, ty.INT
    else:
        c, t = compiled(args[0], env)
    over = column(name)
    if kind == "count":
        return (F.count_distinct(over) if x.distinct else F.count(over)), ty.INT, c
    if kind == "collect":
        return (F.array_distinct(F.collect_list(over)) if x.distinct else F.collect_list(over)), ty.list_of(t), c
    if kind in ("min", "max"):
        return (F.min(over) if kind == "min" else F.max(over)), t, c
    if t == ty.NULL:
        return (F.first(F.lit(0)).cast("long"), ty.INT, None) if kind == "sum" else (F.first(F.lit(None).cast("double")), ty.FLOAT, None)
    if t not in ty.NUMBERS:
        raise semantic(f"{x.name}() of {t}")
    if kind == "sum":
        zero = F.lit(0).cast(ty.to_spark(t))
        return F.coalesce(F.sum_distinct(over) if x.distinct else F.sum(over), zero), t, c
    if kind == "avg":
        return F.avg(over) if not x.distinct else F.expr(f"avg(DISTINCT `{name}`)"), ty.FLOAT, c.cast("double")
    p = constant(args[1], env)
    if p is None:
        return F.first(F.lit(None).cast("double")), ty.FLOAT, c
    if not isinstance(p, (int, float)) or not 0 <= p <= 1:
        raise semantic("a percentile lies between 0 and 1")
    own = "DISTINCT " if x.distinct else ""
    if x.distinct:
        return distinct_percentile(kind, over, float(p), t), t if kind == "percentiledisc" else ty.FLOAT, c
    if kind == "percentilecont":
        return F.percentile(over, float(p)), ty.FLOAT, c.cast("double")
    return F.expr(f"percentile_disc({float(p)!r}) WITHIN GROUP (ORDER BY {own}`{name}`)").cast(ty.to_spark(t)), t, c


def distinct_percentile(kind: str, over: Column, p: float, t: ty.T) -> Column:
    values = F.sort_array(F.collect_set(over))
    n = F.size(values)
    if kind == "percentiledisc":
        return F.get(values, F.greatest(F.ceil(n * F.lit(p)).cast("int") - 1, F.lit(0)))
    at = (n - 1) * F.lit(p)
    low = F.get(values, F.floor(at).cast("int")).cast("double")
    return low + (F.get(values, F.ceil(at).cast("int")).cast("double") - low) * (at - F.floor(at))


def returned(state: State, clause: N) -> DataFrame:
    state = projected(state, clause)
    out = []
    for name, v in state.env.vars.items():
        c, t = v.struct() if isinstance(v, Entity) else (v.column, v.type)
        out.append((c.cast("string") if t == ty.NULL else c).alias(name))
    return state.df.select(*out)
