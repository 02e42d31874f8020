"""Pattern matching as joins: scans, expansions, variable lengths, paths and relationship uniqueness."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import types as ty
from ..functions.expressions import Entity, Env, Value, boolean, compiled, equal
from ..plans.ast import N, semantic
from .scan import scan_nodes, scan_rels

#: A pattern without an upper bound ends when no path goes on; one that is still growing after so many hops fails.
MAX_HOPS = 10_000
UNROLLED = 8
#: So many pairs of relationships that must differ are settled by subtraction in a counted branch (each doubles its terms).
MAX_PAIRS = 3
#: Bytes of files whose relationships make a partition where nodes are counted DISTINCT.
DEALT_BYTES = 8 << 20
_numbers = count()


def fresh(tag: str) -> str:
    return f"{tag}{next(_numbers)}_"


def column(name: str) -> Column:
    return F.col(f"`{name}`")


class Usage:
    """Which properties of which variables a query reads; '*' where it needs the whole entity. distinct: variables that are counted DISTINCT."""

    def __init__(self, query: N):
        self.props: dict[str, set[str]] = {}
        self.distinct: set[str] = set()
        self._visit(query)

    def _add(self, var: str, what: str) -> None:
        self.props.setdefault(var, set()).add(what)

    def _visit(self, e) -> None:
        if isinstance(e, N):
            if e.kind == "prop" and e.base.kind == "var":
                self._add(e.base.name, e.key)
                return
            if e.kind == "call_fn" and e.name.lower() in ("count", "id") and len(e.args) == 1 and e.args[0].kind == "var" and not e.star:
                if e.distinct:
                    self.distinct.add(e.args[0].name)
                return
            if e.kind == "has_labels" and e.base.kind == "var":
                self._add(e.base.name, "labels()")
                return
            if e.kind == "var":
                self._add(e.name, "*")
            if e.kind in ("return", "with") and e.star:
                self._add("*", "*")
            if e.kind in ("create", "merge", "set", "remove", "delete", "set_all", "set_labels", "remove_labels"):
                self._add("*", "*")
            for c in e.members().values():
                self._visit(c)
        elif isinstance(e, (list, tuple)):
            for c in e:
                self._visit(c)
        elif isinstance(e, dict):
            for c in e.values():
                self._visit(c)

    def only_id(self, var: str) -> bool:
        return "*" not in self.props and not self.props.get(var)


def names_in(tree) -> set[str]:
    """Variables that a tree refers to, in patterns as well."""
    found = set()
    for x in tree.walk() if isinstance(tree, N) else (y for t in tree for y in t.walk()):
        if x.kind == "var":
            found.add(x.name)
        elif x.kind in ("node", "rel") and x.var:
            found.add(x.var)
    return found


@dataclass
class Counted:
    """What follows a MATCH whose rows are only counted: the variables read after it, its predicates, and what a counted branch made of them."""

    read: set[str]
    predicates: list[N]
    taken: list[N] = field(default_factory=list)
    weight: str | None = None


class Match:
    """One MATCH clause on top of a frame whose variables are bound in env."""

    def __init__(self, df: DataFrame | None, env: Env, parts: list[N], usage: Usage | None = None, counted: Counted | None = None):
        self.df, self.env, self.graph, self.usage, self.counted = df, env.bound(), env.graph, usage, counted
        self.parts, self.rels, self.paths = [], [], []
        self.dealt: tuple[int, Column] | None = None
        for p in parts:
            nodes = [self._named(n, "anon_n") for n in p.nodes]
            rels = [self._named(r, "anon_r") for r in p.rels]
            self.parts.append((p.path, nodes, rels))

    @staticmethod
    def _named(p: N, tag: str) -> N:
        if p.var is not None:
            return p
        out = N(p.kind, **p.members())
        out.var = fresh(f" {tag}")
        return out

    def run(self, where: N | None = None) -> tuple[DataFrame, Env]:
        steps = [(a, r, b, path) for path, nodes, rels in self.parts for a, r, b in zip(nodes, rels, nodes[1:], strict=False)]
        self._check(steps)
        self.labels: dict[str, set[str]] = {}
        self.patterns: dict[str, list[N]] = {}
        for _, nodes, _ in self.parts:
            for n in nodes:
                self.labels.setdefault(n.var, set()).update(n.labels)
                self.patterns.setdefault(n.var, []).append(n)
        self.in_path = {x.var for path, nodes, rels in self.parts if path for x in (*nodes, *rels)}
        for v in [*self.patterns]:
            if v in self.env.vars:
                self._restrict_bound(v)
        waiting, lone = list(steps), [v for v in self.patterns]
        while waiting:
            step = self._next(waiting)
            if self.counted is not None and self._branch(waiting, [s for s in steps if s not in waiting]):
                lone = []
                break
            waiting.remove(step)
            self._expand(*step)
        for v in lone:
            if v not in self.env.vars:
                self._start(v)
        self._unique()
        for path, nodes, rels in self.parts:
            if path:
                self._path(path, nodes, rels)
        return self.df, self.env

    def _check(self, steps) -> None:
        kinds: dict[str, str] = {}
        seen = set()
        for _, nodes, rels in self.parts:
            for x in (*nodes, *rels):
                if kinds.setdefault(x.var, x.kind) != x.kind:
                    raise semantic(f"`{x.var}` is both a node and a relationship")
                bound = self.env.vars.get(x.var)
                if bound is not None and (bound.kind if isinstance(bound, Entity) else bound.type.name) not in (("node", "null") if x.kind == "node" else ("relationship", "list", "null")):
                    raise semantic(f"`{x.var}` is not a {'node' if x.kind == 'node' else 'relationship'}")
                if x.props is not None and x.props.kind == "param":
                    raise semantic("a parameter cannot be the property map of a MATCH")
        for _, r, _, _ in steps:
            if r.var in seen:
                raise semantic(f"relationship variable `{r.var}` is used twice in a pattern")
            seen.add(r.var)

    def _entity(self, var: str) -> Entity:
        v = self.env.vars[var]
        if isinstance(v, Value):  # an entity that went through a list or projection
            prefix = fresh("e")
            members = dict(v.type.members)
            own = ("id", "labels") if v.type.name == "node" else ("id", "src", "dst", "type")
            self.df = self.df.withColumns({f"{prefix}{k}": v.column[k] for k in own} | {f"{prefix}p_{k}": v.column["properties"][k] for k in members})
            v = self.env.vars[var] = Entity(v.type.name, prefix, members)
        return v

    def _restrict_bound(self, var: str) -> None:
        entity = self._entity(var)
        self.df = self.df.filter(entity.id.isNotNull())
        for label in sorted(self.labels[var]):
            self.df = self.df.filter(F.array_contains(entity.col("labels"), label))
        for p in self.patterns[var]:
            self._filter_props(var, p.props)

    def _filter_props(self, var: str, props: N | None) -> None:
        if props is not None:
            for k, e in props.items.items():
                want = compiled(e, self.env)
                have = compiled(N("prop", base=N("var", name=var), key=k), self.env)
                self.df = self.df.filter(equal(*have, *want))

    def _rank(self, var: str) -> tuple:
        """Places to start from: properties given first, then labels, then small tables."""
        given = sum(len(p.props.items) for p in self.patterns[var] if p.props is not None)
        tables = self.graph.node_tables(self.labels[var])
        rows = [t.rows for t in tables]
        return (-given, -len(self.labels[var]), len(tables), sum(r or 0 for r in rows))

    def _next(self, waiting):
        """A step that touches what is bound, one with both ends first; else the best place to start."""
        bound = lambda s: (s[0].var in self.env.vars) + (s[2].var in self.env.vars)
        best = max(waiting, key=lambda s: (bound(s), s[1].span is None))
        if bound(best):
            return best
        start = min({s[i].var for s in waiting for i in (0, 2)}, key=lambda v: (self._rank(v), str(v)))
        self._start(start)
        return self._next(waiting)

    def _branch(self, waiting: list, done: list) -> bool:
        """Whether all that is left of the pattern hangs on one bound node beside a like relationship, and nothing after the MATCH reads it; then it is counted instead of joined.

        Of two such branches a node has as many rows as their product, of which a count needs the two numbers only."""
        bound = set(self.env.vars)
        inner = {x.var for a, r, b, _ in waiting for x in (a, r, b)} - bound
        touched = {s[i].var for s in waiting for i in (0, 2)} & bound
        if len(touched) != 1 or any(v not in bound and v not in inner for v in self.patterns):
            return False
        (hub,) = touched
        ways = lambda steps: {r.direction if r.direction == "both" or a.var == hub else {"out": "in", "in": "out"}[r.direction] for a, r, b, _ in steps if hub in (a.var, b.var)}
        mine, theirs = ways(done), ways(waiting)
        if not (mine & theirs or mine and "both" in theirs or "both" in mine) or inner & (self.counted.read | self.in_path):
            return False
        if any(r.span is not None or r.var in bound for _, r, _, _ in waiting):
            return False
        given = [x.props for s in waiting for x in s[:3] if x.var in inner and x.props is not None] + [p for p in self.counted.predicates if names_in(p) & inner]
        if any(not names_in(g) <= inner or any(x.kind in ("exists", "pattern_comprehension") or x.kind == "call_fn" and x.name.lower() in ("startnode", "endnode") for x in g.walk()) for g in given):
            return False
        pairs = [(x, s.var) for r, x in self.rels for _, s, _, _ in waiting if not (r.types and s.types) or set(r.types) & set(s.types)]
        if len(pairs) > MAX_PAIRS or not all(isinstance(x, Entity) for x, _ in pairs):
            return False
        self._count_branch(hub, waiting, pairs)
        return True

    def _count_branch(self, hub: str, waiting: list, pairs: list) -> None:
        """Gives each row the number of ways in which the waiting steps go on from its hub node, and keeps rows that have any.

        The steps are matched once for all hubs. Ways that use a relationship of the row are taken off again: over the
        sets of pairs that must differ, those with a row's own relationships in all pairs of the set count with
        alternating sign, and are found by equality."""
        near, there = self._entity(hub), Entity("node", fresh("n"), {})
        side = Match(None, Env(self.graph, self.env.params, {hub: there}, self.env.now), [], self.usage)
        side.labels, side.patterns, side.in_path = self.labels, self.patterns, self.in_path
        left = list(waiting)
        while left:
            step = side._next(left)
            left.remove(step)
            side._expand(*step)
        side._unique()
        inner = {x.var for s in waiting for x in s[:3]} - {hub}
        self.counted.taken = [p for p in self.counted.predicates if names_in(p) & inner]
        for p in self.counted.taken:
            side.df = filtered(side.df, p, side.env)
        pairs = [(x, side.env.vars[v]) for x, v in pairs]
        for x, y in pairs:
            self.df, side.df = self.df.filter(x.id.isNotNull()), side.df.filter(y.id.isNotNull())
        total, kept = F.lit(0).cast("long"), self.df.columns
        for n in range(len(pairs) + 1):
            for same in combinations(pairs, n):
                at, ways = fresh("k"), fresh("c")
                keys = {y.prefix: fresh("k") for _, y in same}
                ids = {keys[y.prefix]: y.id for _, y in same}
                numbers = side.df.groupBy(there.id.alias(at), *[c.alias(k) for k, c in ids.items()]).agg(F.count(F.lit(1)).alias(ways))
                on = near.id == column(at)
                for x, y in same:
                    on = on & (x.id == column(keys[y.prefix]))
                self.df = self.df.join(numbers, on, "left" if same else "inner")
                total = total + F.lit((-1) ** n) * F.coalesce(column(ways), F.lit(0))
        weight = self.counted.weight = fresh("w")
        self.df = self.df.select(*map(column, kept), total.alias(weight)).filter(column(weight) > 0)

    def _start(self, var: str) -> None:
        df, entity = scan_nodes(self.graph, sorted(self.labels[var]), fresh("n"))
        had = bool(self.env.vars)
        self.env.vars[var] = entity
        props = [p.props for p in self.patterns[var] if p.props is not None]
        own = [p for p in props if not any(x.kind == "var" for x in p.walk())]
        later = [p for p in props if p not in own]
        whole, self.df = self.df, df
        for p in own:
            self._filter_props(var, p)
        self.df = whole.crossJoin(self.df) if had or whole.columns else self.df
        for p in later:
            self._filter_props(var, p)

    def _need_node(self, var: str, r: N, end: int) -> bool:
        """Whether a node's table must be joined, or its id and what its relationships' tables say are enough."""
        if self.usage is None or not self.usage.only_id(var) or var in self.in_path:
            return True
        if any(p.props is not None for p in self.patterns[var]) or r.span is not None:
            return True
        for t in self.graph.rel_tables(r.types):
            for e in self._ends(r, end):
                if t.ends[e] is None or not self.labels[var] <= set(t.ends[e]):
                    return True
        return False

    @staticmethod
    def _ends(r: N, side: int) -> tuple[int, ...]:
        """Which ends of relationships the node on this side (0: left) of the pattern can be."""
        return {"out": (side,), "in": (1 - side,), "both": (0, 1)}[r.direction]

    def _among(self, r: N, side: int, other: str) -> list | None:
        """Node tables that the node on this side of the pattern can lie in; without any hop it is the one on the other side."""
        found = self.graph.tables_at(r.types, self._ends(r, side))
        if found is None or r.span is None or r.span[0] > 0:
            return found
        return [*found, *(t for t in self.graph.node_tables(self.labels.get(other, ())) if not any(t is x for x in found))]

    def _expand(self, a: N, r: N, b: N, path) -> None:
        flip = a.var not in self.env.vars
        if flip:  # go from the bound end
            a, b = b, a
        direction = {"out": "in", "in": "out", "both": "both"}[r.direction] if flip else r.direction
        source, into = self._entity(a.var), b.var in self.env.vars
        target = self._entity(b.var) if into else None
        if r.span is not None:
            self._variable(source, target, a, r, b, direction, flip)
            return
        rels, entity = scan_rels(self.graph, r.types, direction, fresh("r"))
        start, end = column(f"{entity.prefix}from"), column(f"{entity.prefix}to")
        bound = self.env.vars.get(r.var)
        if bound is not None:
            bound = self._entity(r.var)
        self.env.vars[r.var] = entity
        if r.props is not None and not any(x.kind == "var" for x in r.props.walk()):
            whole, self.df = self.df, rels
            self._filter_props(r.var, r.props)
            rels, self.df = self.df, whole
        on = source.id == start
        if into:
            on = on & (target.id == end)
        if bound is not None:
            on = on & (bound.id == entity.id)
        if self.df is None:  # the first step of a counted branch: its hub is where it starts, whichever node that is
            self.df = rels.withColumn(f"{source.prefix}id", start).filter(on)
        else:
            if self.usage is not None and a.var in self.usage.distinct and (parts := self._parts(source, rels)):
                self.df, rels, self.dealt = self.df.repartition(parts, source.id), rels.repartition(parts, start), (parts, source.id)
            self.df = self.df.join(rels, on)
        if r.props is not None and any(x.kind == "var" for x in r.props.walk()):
            self._filter_props(r.var, r.props)
        self.rels.append((r, entity))
        if not into:
            self._bind_target(a, b, r, end, 0 if flip else 1)

    def _parts(self, source: Entity, rels: DataFrame) -> int | None:
        """In how many partitions nodes that are counted DISTINCT meet their relationships; None leaves it to Spark.

        The partitions of this join also hold the groups of the count, so a task sorts its rows and then keeps each of
        them twice: 60 times its bytes of files on the test tables. Spark's own partitions grow to its advisory size, and
        beyond it once there are spark.sql.shuffle.partitions of them. Nodes that Spark would broadcast, and sizes that no
        files tell, are left alone."""
        nodes, leaves = self.df.select(source.id), self._leaves(rels)
        if not self._large(nodes) or any(x.getClass().getSimpleName() != "LogicalRelation" for x in (*leaves, *self._leaves(nodes))):
            return None
        return sum(int(str(x.stats().sizeInBytes())) for x in leaves) // DEALT_BYTES + 1

    def _leaves(self, df: DataFrame) -> list:
        found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return [found.apply(i) for i in range(found.size())]

    def _large(self, df: DataFrame) -> bool:
        """Whether Spark would rather shuffle a frame than broadcast it."""
        most = self.graph.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > most

    def _bind_target(self, a: N, b: N, r: N, end: Column, side: int) -> None:
        if not self._need_node(b.var, r, side):
            prefix = fresh("n")
            labels = sorted(self.labels[b.var])
            self.df = self.df.withColumns({f"{prefix}id": end, f"{prefix}labels": F.array(*map(F.lit, labels)).cast("array<string>")})
            self.env.vars[b.var] = Entity("node", prefix, {})
            return
        nodes, node = scan_nodes(self.graph, sorted(self.labels[b.var]), fresh("n"), self._among(r, side, a.var))
        self.env.vars[b.var] = node
        props = [p.props for p in self.patterns[b.var] if p.props is not None]
        own = [p for p in props if not any(x.kind == "var" for x in p.walk())]
        whole, self.df = self.df, nodes
        for p in own:
            self._filter_props(b.var, p)
        read = [f"{node.prefix}id", *(f"{node.prefix}p_{k}" for k in node.props if k in self.usage.props.get(b.var, ()))] if self.dealt else []
        if self.dealt and self._large(self.df.select(*map(column, read))):  # by these nodes and back, as many parts as before
            parts, by = self.dealt
            self.df = whole.repartition(parts, end).join(self.df.repartition(parts, node.id), end == node.id).repartition(parts, by)
        else:
            self.df = whole.join(self.df, end == node.id)
        for p in props:
            if p not in own:
                self._filter_props(b.var, p)

    def _variable(self, source: Entity, target: Entity | None, a: N, r: N, b: N, direction: str, flip: bool) -> None:
        """Trails of low to high relationships: each hop joins the frontier with the relationships it has not used.

        Up to UNROLLED hops are one chain of joins: a trail that is long enough to be a result and may also go on does
        both, as two rows, and rows that stay pass later joins unmatched. Longer ones are written after each hop."""
        low, high = r.span
        tag, rel_t = fresh("v"), self.graph.rel_type(r.types)
        if r.var in self.env.vars:
            raise semantic(f"`{r.var}` is bound already")
        rel_array, node_t = ty.list_of(rel_t), self.graph.node_type()
        kept = self.df.columns
        at, used, going = (column(f"{tag}{x}") for x in ("at", "ids", "going"))
        walk = self.df.withColumns({f"{tag}rels": F.array().cast(ty.to_spark(rel_array)), f"{tag}at": source.id, f"{tag}ids": F.array().cast("array<bigint>")})
        named = r.var in self.in_path
        if named:
            walk = walk.withColumn(f"{tag}nodes", F.array().cast(ty.to_spark(ty.list_of(node_t))))
        mine = [f"{tag}{x}" for x in ("rels", "at", "ids", *(["nodes"] if named else []))]
        among = self.graph.tables_at(r.types, self._ends(r, 0 if flip else 1))

        def hop(frontier: DataFrame, stays: bool) -> DataFrame:
            """The frontier one relationship on; stays: with the rows as they were."""
            rels, entity = scan_rels(self.graph, r.types, direction, fresh("h"))
            if r.props is not None:
                env, frame = self.env, self.df
                self.env, self.df = self.env.bound(**{r.var: entity}), rels
                self._filter_props(r.var, r.props)
                rels, self.env, self.df = self.df, env, frame
            value = ty.converted(*entity.struct(), rel_t)
            chain = F.concat(F.array(value), column(f"{tag}rels")) if flip else F.concat(column(f"{tag}rels"), F.array(value))
            new = {f"{tag}rels": chain, f"{tag}at": column(f"{entity.prefix}to"), f"{tag}ids": F.concat(used, F.array(entity.id))}
            if named:
                nodes, node = scan_nodes(self.graph, (), fresh("h"), among)
                rels = rels.join(nodes, column(f"{entity.prefix}to") == node.id)
                v = ty.converted(*node.struct(), node_t)
                new[f"{tag}nodes"] = F.concat(F.array(v), column(f"{tag}nodes")) if flip else F.concat(column(f"{tag}nodes"), F.array(v))
            on = (at == column(f"{entity.prefix}from")) & ~F.array_contains(used, entity.id)
            if not stays:
                return frontier.join(rels, on).select(*map(column, kept), *[new[m].alias(m) for m in mine])
            newest = F.size(used) == hops - 1
            both = frontier.withColumn(f"{tag}going", F.explode(F.when(newest, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
            step = both.join(rels, going & on, "left").filter(~going | entity.id.isNotNull())
            return step.select(*map(column, kept), *[F.when(going, new[m]).otherwise(column(m)).alias(m) for m in mine])

        frontier, hops = walk.filter(source.id.isNotNull()), 0
        if high is not None and high <= UNROLLED:
            while hops < high:
                hops += 1
                frontier = hop(frontier, hops > low)
            self.df = frontier.filter(F.size(used) >= low)
        else:
            found = [frontier] if low == 0 else []
            while high is None or hops < high:
                hops += 1
                if hops > MAX_HOPS:
                    raise semantic(f"a pattern without an upper bound goes on for more than {MAX_HOPS} hops")
                frontier = materialized(self.graph.spark, hop(frontier, False))
                if frontier.isEmpty():
                    break
                if hops >= low:
                    found.append(frontier)
            out = found[0] if found else walk.filter(F.lit(False))
            for f in found[1:]:
                out = out.unionByName(f)
            self.df = out
        self.env.vars[r.var] = Value(column(f"{tag}rels"), rel_array, f"{tag}rels")
        if named:
            self.env.vars[r.var].inner, self.env.vars[r.var].backwards = f"{tag}nodes", flip
        self.rels.append((r, f"{tag}ids"))
        if target is not None:
            self.df = self.df.filter(target.id == at)
        else:
            self._bind_target(a, b, r, at, 0 if flip else 1)

    def _unique(self) -> None:
        """No relationship twice in one match; types that cannot meet need no comparison."""
        for i, (r, x) in enumerate(self.rels):
            for s, y in self.rels[:i]:
                if r.types and s.types and not set(r.types) & set(s.types):
                    continue
                if isinstance(x, Entity) and isinstance(y, Entity):
                    self.df = self.df.filter(x.id != y.id)
                elif isinstance(x, Entity) or isinstance(y, Entity):
                    one, many = (x, y) if isinstance(x, Entity) else (y, x)
                    self.df = self.df.filter(~F.array_contains(column(many), one.id))
                else:
                    self.df = self.df.filter(~F.arrays_overlap(column(x), column(y)))

    def _path(self, name: str, nodes: list[N], rels: list[N]) -> None:
        node_t, rel_t = self.graph.node_type(), self.graph.rel_type()
        as_node = lambda n: F.array(ty.converted(*compiled(N("var", name=n.var), self.env), node_t))
        node_parts, rel_parts = [as_node(nodes[0])], [F.array().cast(ty.to_spark(ty.list_of(rel_t)))]
        for r, n in zip(rels, nodes[1:], strict=True):
            v = self.env.vars[r.var]
            if isinstance(v, Entity):
                rel_parts.append(F.array(ty.converted(*v.struct(), rel_t)))
                node_parts.append(as_node(n))
            else:
                rel_parts.append(ty.converted(v.column, v.type, ty.list_of(rel_t)))
                node_parts.append(self._inner(v, n))
        path = fresh("path")
        t = ty.path_of(node_t, rel_t)
        # a path read backwards holds the start node among its inner nodes, not the end
        value = F.struct(F.concat(*node_parts).alias("nodes"), F.concat(*rel_parts).alias("relationships"))
        self.df = self.df.withColumn(path, value)
        self.env.vars[name] = Value(column(path), t, path)

    def _inner(self, v: Value, end: N) -> Column:
        """Nodes after the first of a variable-length part: those that were walked over; walked backwards, without the first and with the end."""
        inner = column(v.inner)
        if not v.backwards:
            return inner
        last = F.array(ty.converted(*compiled(N("var", name=end.var), self.env), self.graph.node_type()))
        return F.when(F.size(inner) == 0, inner).otherwise(F.concat(F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0))), last))


def materialized(spark, df: DataFrame) -> DataFrame:
    """The rows written once, so that they are not computed again; in spark.checkpoint.dir, which all executors see."""
    from ..sources.storage import written

    return written(spark, df)


def filtered(df: DataFrame, where: N | None, env: Env) -> DataFrame:
    return df if where is None else df.filter(boolean(where, env))
