"""Graph patterns as data, compiled to joins.

A pattern is a list of atoms over variables. All joins carry (corpus, sentence_id), because a
dependency edge never leaves its sentence; sessions from :mod:`lexiquarry.session` let Spark use a
partitioning on these two columns for all of them.

    Edge("x", "dobj", "y")              x has a 'dobj' edge to y (several labels: alternatives)
    Tok("x", "lemma", "must")           a property of x; ops: eq, ne, prefix, not_prefix, regex, not_regex, in
    Prop("x", "name", "n")              a column n with a property of x, which x must have
    Bind("why", F.lit("F"))             a column computed from the others
    Differ("x", "y")                    two variables have different values
    Not(Edge("p", "rcmod", "x"))        no such match exists
    Either([..atoms..], [..atoms..])    union of branches
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.session import cut

PLACE = ["corpus", "sentence_id"]


@dataclass
class GraphTables:
    """tokens(corpus, sentence_id, token_id, text, lemma, pos, ne_type, ..), deps(.., graph, head, tail, label)."""

    tokens: DataFrame
    deps: DataFrame

    def co_partitioned(self, partitions: int) -> "GraphTables":
        """Deal both tables once by sentence, so that the joins need no further exchange."""
        return GraphTables(self.tokens.repartition(partitions, *PLACE), self.deps.repartition(partitions, *PLACE))


@dataclass(frozen=True)
class Edge:
    src: str
    labels: str  # alternatives separated by '|'; 'prefix*' matches by prefix
    dst: str
    graph: str = "dep"
    keep: str | None = None  # a column that gets the label


@dataclass(frozen=True)
class Tok:
    var: str
    prop: str
    value: str
    op: str = "eq"


@dataclass(frozen=True)
class Prop:
    var: str
    prop: str
    name: str


@dataclass(frozen=True)
class Bind:
    name: str
    value: Column


@dataclass(frozen=True)
class Differ:
    a: str
    b: str


class Not:
    def __init__(self, *atoms):
        self.atoms = atoms


class Either:
    def __init__(self, *branches):
        self.branches = branches


def _test(t: Tok) -> Column:
    c = F.col(t.prop)
    return {
        "eq": lambda: c == t.value,
        "ne": lambda: c != t.value,
        "prefix": lambda: c.startswith(t.value),
        "not_prefix": lambda: ~c.startswith(t.value),
        "regex": lambda: c.rlike(t.value),
        "not_regex": lambda: ~c.rlike(t.value),
        "in": lambda: c.isin(*t.value.split("|")),
    }[t.op]()


def _labels(spec: str) -> Column:
    exact = [x for x in spec.split("|") if not x.endswith("*")]
    cond = F.col("label").isin(*exact) if exact else F.lit(False)
    for x in spec.split("|"):
        if x.endswith("*"):
            cond = cond | F.col("label").startswith(x[:-1])
    return cond


def _edge(g: GraphTables, e: Edge) -> DataFrame:
    rows = g.deps.where((F.col("graph") == e.graph) & _labels(e.labels))
    cols = [*PLACE, F.col("head").alias(e.src), F.col("tail").alias(e.dst)]
    return rows.select(*cols, F.col("label").alias(e.keep)) if e.keep else rows.select(*cols).distinct() if "|" in e.labels or "*" in e.labels else rows.select(*cols)


def _tokens(g: GraphTables, var: str, tests: list[Tok], props: list[Prop] = ()) -> DataFrame:
    cond = F.lit(True)
    for t in tests:
        cond = cond & _test(t)
    for p in props:
        cond = cond & F.col(p.prop).isNotNull()
    return g.tokens.where(cond).select(*PLACE, F.col("token_id").alias(var), *[F.col(p.prop).alias(p.name) for p in props])


def _join(left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
    if left is None:
        return right
    return left.join(right, [c for c in left.columns if c in right.columns], how)


def match(g: GraphTables, atoms, bound: DataFrame | None = None) -> DataFrame:
    """All bindings of the variables in ``atoms``: (corpus, sentence_id, variables..)."""
    tests: dict[str, list[Tok]] = {}
    props: dict[str, list[Prop]] = {}
    for a in atoms:
        if isinstance(a, (Tok, Prop)):
            tests.setdefault(a.var, []).extend([a] if isinstance(a, Tok) else [])
        if isinstance(a, Prop):
            props.setdefault(a.var, []).append(a)
    out = bound
    # Constant lookups first: they are the selective side.
    for var, own in sorted(tests.items(), key=lambda x: not any(t.op == "eq" for t in x[1])):
        if bound is None or var not in bound.columns:
            if out is None and any(t.op == "eq" and t.prop != "pos" for t in own):
                out = _tokens(g, var, own, props.pop(var, []))
                tests[var] = []
    for a in atoms:
        if isinstance(a, Edge):
            out = _join(out, _edge(g, a))
    for var, own in tests.items():
        wanted = props.get(var, [])
        if own or wanted:
            out = _join(out, _tokens(g, var, own, wanted), "left_semi" if out is not None and var in out.columns and not wanted else "inner")
    for a in atoms:
        if isinstance(a, Either):
            branches = [match(g, b, out) for b in a.branches]
            names = [c for c in branches[0].columns if all(c in b.columns for b in branches)]
            out = branches[0].select(*names)
            for b in branches[1:]:
                out = out.unionByName(b.select(*names))
    for a in atoms:
        if isinstance(a, Bind):
            out = out.withColumn(a.name, a.value)
        if isinstance(a, Differ):
            out = out.where(F.col(a.a) != F.col(a.b))
    for a in atoms:
        if isinstance(a, Not):
            other = match(g, a.atoms)
            out = _join(out, other.select(*[c for c in other.columns if c in out.columns]).distinct(), "left_anti")
    return out


def construct(g: GraphTables, atoms, head: str, tail: str, label: Column) -> DataFrame:
    """New edges (corpus, sentence_id, head, tail, label) as a set."""
    m = match(g, atoms)
    return m.select(*PLACE, F.col(head).alias("head"), F.col(tail).alias("tail"), label.alias("label")).distinct()


_STEP = re.compile(r"([\w:]+)\(\s*(_?\d+)\s*,\s*(_?\d+)\s*\)")


def parse_path(pattern: str, graph: str = "basic") -> tuple[str, list[Edge]]:
    """``relation => (nsubj(_1, _3), dobj(_3, _2))`` -> (relation, atoms over v1, v2, v3)."""
    rel, _, body = pattern.partition("=>")
    steps = _STEP.findall(body)
    if not steps:
        raise ValueError(f"no path in {pattern!r}")
    return rel.strip(), [Edge("v" + a.strip("_"), label, "v" + b.strip("_"), graph) for label, a, b in steps]


def path_candidates(g: GraphTables, pattern: str, graph: str = "basic") -> DataFrame:
    """(corpus, sentence_id, rel, arg1, arg2): what a mined path pattern binds _1 and _2 to."""
    rel, atoms = parse_path(pattern, graph)
    m = _over_middle(g, atoms)
    if m is None:
        m = match(g, [*atoms, Differ("v1", "v2")]).select(*PLACE, "v1", "v2").distinct()
    return m.select(*PLACE, F.lit(rel).alias("rel"), F.col("v1").alias("arg1"), F.col("v2").alias("arg2"))


def _over_middle(g: GraphTables, atoms: list[Edge]) -> DataFrame | None:
    """The set (corpus, sentence_id, v1, v2) of two edges that meet in one other variable; None for other atoms.

    Pairs grow with the square of a middle's edges. A v1 with one middle makes each of its pairs once, so
    that only the pairs of the others are dealt again to be made distinct.
    """
    mine = [[e for e in atoms if {e.src, e.dst} - {"v1", "v2"} == {e.src, e.dst} - {v} and v in (e.src, e.dst)] for v in ("v1", "v2")]
    middles = {v for e in atoms for v in (e.src, e.dst)} - {"v1", "v2"}
    if len(atoms) != 2 or [len(x) for x in mine] != [1, 1] or len(middles) != 1:
        return None
    needed = [(F.col("graph") == e.graph) & _labels(e.labels) for e in atoms]
    g = GraphTables(g.tokens, cut(g.deps.where(needed[0] | needed[1]).select(*PLACE, "graph", "head", "tail", "label")))  # read four times
    (mid,), one, two = middles, _edge(g, mine[0][0]), _edge(g, mine[1][0]).distinct()
    reach = one.where(F.col(mid).isNotNull()).groupBy(*PLACE, "v1").agg(F.min(mid).alias(mid), F.max(mid).alias("_high"))
    several = one.join(reach.where(F.col(mid) < F.col("_high")).select(*PLACE, "v1"), [*PLACE, "v1"], "left_semi").distinct()
    pairs = lambda x: x.join(two, [*PLACE, mid]).where("v1 <> v2").select(*PLACE, "v1", "v2")
    return pairs(reach.where(F.col(mid) == F.col("_high")).drop("_high")).unionByName(pairs(several).distinct())


# -- the same patterns as SQL text -------------------------------------------------------------------


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_test(t: Tok, column: str) -> str:
    c, v = f"{column}.{t.prop}", t.value
    return {
        "eq": lambda: f"{c} = {_quoted(v)}",
        "ne": lambda: f"{c} <> {_quoted(v)}",
        "prefix": lambda: f"starts_with({c}, {_quoted(v)})",
        "not_prefix": lambda: f"NOT starts_with({c}, {_quoted(v)})",
        "regex": lambda: f"regexp_matches({c}, {_quoted(v)})",
        "not_regex": lambda: f"NOT regexp_matches({c}, {_quoted(v)})",
        "in": lambda: f"{c} IN ({', '.join(map(_quoted, v.split('|')))})",
    }[t.op]()


def _branches(atoms) -> list[list]:
    """``atoms`` without Either: one list per combination of branches."""
    out = [[]]
    for a in atoms:
        ways = [list(b) for b in a.branches] if isinstance(a, Either) else [[a]]
        out = [x + w for x in out for w in ways]
    return [y for x in out for y in (_branches(x) if any(isinstance(a, Either) for a in x) else [x])]


def _sql_body(atoms, deps: str, tokens: str, outer: dict[str, str], place: str | None, tag: str) -> tuple[str, dict[str, str], str]:
    """(FROM .. WHERE .., variables, place) of atoms without Either; ``outer`` are bound variables."""
    bound, tables, conds = dict(outer), [], []

    def at(alias: str) -> None:
        nonlocal place
        if place is None:
            place = alias
        else:
            conds.extend(f"{alias}.{c} = {place}.{c}" for c in PLACE)

    def bind(var: str, value: str) -> None:
        if var in bound:
            conds.append(f"{bound[var]} = {value}")
        else:
            bound[var] = value

    for i, a in enumerate(atoms):
        if isinstance(a, Edge):
            e = f"{tag}e{i}"
            tables.append(f"{deps} {e}")
            at(e)
            kinds = [f"starts_with({e}.label, {_quoted(x[:-1])})" if x.endswith("*") else f"{e}.label = {_quoted(x)}" for x in a.labels.split("|")]
            conds.append(f"{e}.graph = {_quoted(a.graph)} AND ({' OR '.join(kinds)})")
            bind(a.src, f"{e}.head")
            bind(a.dst, f"{e}.tail")
            if a.keep:
                bound[a.keep] = f"{e}.label"
    for i, a in enumerate(atoms):
        if isinstance(a, (Tok, Prop)):
            t = f"{tag}t{i}"
            tables.append(f"{tokens} {t}")
            at(t)
            bind(a.var, f"{t}.token_id")
            if isinstance(a, Tok):
                conds.append(_sql_test(a, t))
            else:
                conds.append(f"{t}.{a.prop} IS NOT NULL")
                bound[a.name] = f"{t}.{a.prop}"
    for i, a in enumerate(atoms):
        if isinstance(a, Differ):
            conds.append(f"{bound[a.a]} <> {bound[a.b]}")
        if isinstance(a, Not):
            for k, b in enumerate(_branches(a.atoms)):
                conds.append(f"NOT EXISTS (SELECT 1 {_sql_body(b, deps, tokens, bound, place, f'{tag}n{i}{k}')[0]})")
    return f"FROM {', '.join(tables)} WHERE {' AND '.join(conds) or 'true'}", bound, place


def as_sql(atoms, columns: dict[str, str], deps: str = "deps", tokens: str = "tokens") -> str:
    """A SELECT DISTINCT over tables ``deps`` and ``tokens``: place and ``columns`` (name -> expression in
    which ``{var}`` stands for a variable)."""
    out = []
    for b in _branches(atoms):
        body, bound, place = _sql_body(b, deps, tokens, {}, None, "")
        shown = [f"{place}.{c} AS {c}" for c in PLACE] + [f"{v.format(**bound)} AS {k}" for k, v in columns.items()]
        out.append(f"SELECT {', '.join(shown)} {body}")
    return " UNION ".join(out) if len(out) > 1 else out[0].replace("SELECT ", "SELECT DISTINCT ", 1)
