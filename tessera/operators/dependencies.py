"""Conditional functional dependencies: parsing, consistency, violations, repair.

``A,B@C,D#l1,l2&r1,r2#..``: columns A and B determine C and D where a pattern holds; ``_`` is the wildcard, and a
plain dependency has the pattern of wildcards only.  Comparisons are on strings, nulls match only the wildcard, and a null
is a value of its own on the right-hand side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..exceptions import IllegalParameterError, InconsistentDependenciesError, NoSuchColumnError
from ..metrics import Violation, Violations
from .graph import checkpoint

WILDCARD = "_"


@dataclass(frozen=True)
class Pattern:
    lhs: tuple[str, ...]
    rhs: tuple[str, ...]

    def __str__(self) -> str:
        return f"{','.join(self.lhs)}&{','.join(self.rhs)}"


@dataclass(frozen=True)
class CFD:
    lhs: tuple[str, ...]
    rhs: tuple[str, ...]
    patterns: tuple[Pattern, ...]
    priority: float = 1.0

    @property
    def name(self) -> str:
        return f"{','.join(self.lhs)}@{','.join(self.rhs)}"


def parse(text: str, priority: float = 1.0) -> CFD:
    head, *tableau = text.split("#")
    left, sep, right = head.partition("@")
    lhs, rhs = (tuple(x.strip() for x in side.split(",")) for side in (left, right))
    if not sep or not all(lhs) or not all(rhs):
        raise IllegalParameterError(f"not a dependency: {text!r}")
    patterns = []
    for row in filter(None, tableau):
        pl, sep, pr = row.partition("&")
        p = Pattern(tuple(x.strip() for x in pl.split(",")), tuple(x.strip() for x in pr.split(",")))
        if not sep or len(p.lhs) != len(lhs) or len(p.rhs) != len(rhs):
            raise IllegalParameterError(f"pattern {row!r} does not fit {head!r}")
        patterns.append(p)
    return CFD(lhs, rhs, tuple(patterns), priority)


def parse_all(texts: tuple[str, ...] | list[str] | str, priorities: list[float] | tuple[float, ...] = ()) -> list[CFD]:
    texts = [texts] if isinstance(texts, str) else list(texts)
    if priorities and len(priorities) != len(texts):
        raise IllegalParameterError("as many priorities as dependencies are needed")
    cfds = [parse(t, p) for t, p in zip(texts, priorities or [1.0] * len(texts), strict=True)]
    check_consistent(cfds)
    return cfds


def check_consistent(cfds: list[CFD]) -> None:
    """Some value assignment must satisfy all constants: starting from each pattern's constants, what the others force is
    added until nothing changes; two constants for one column contradict each other."""
    rules = [(dict(zip(c.lhs, p.lhs, strict=True)), {k: v for k, v in zip(c.rhs, p.rhs, strict=True) if v != WILDCARD}) for c in cfds for p in c.patterns]
    for lhs, rhs in rules:
        known = {k: v for k, v in lhs.items() if v != WILDCARD}
        todo = [rhs]
        while todo:
            for k, v in todo.pop().items():
                if known.setdefault(k, v) != v:
                    raise InconsistentDependenciesError(f"Inconsistent CFDs: {k} must be both {known[k]!r} and {v!r}")
            for l2, r2 in rules:
                if any(v != WILDCARD for v in l2.values()) and all(v == WILDCARD or known.get(k) == v for k, v in l2.items()) and any(known.get(k) != v for k, v in r2.items()):
                    todo.append(r2)


def matches(columns: tuple[str, ...], values: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c, v in zip(columns, values, strict=True):
        if v != WILDCARD:
            out = out & F.col(c).cast("string").eqNullSafe(F.lit(v))
    return out


def _check_columns(df: DataFrame, cfds: list[CFD]) -> None:
    for c in cfds:
        for x in (*c.lhs, *c.rhs):
            if x not in df.columns:
                raise NoSuchColumnError(f"no column {x}")


def _key(columns: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)])


def violation_table(df: DataFrame, cfds: list[CFD]) -> DataFrame:
    """(cfd_idx, pat_idx, attr, const_vio, var_vio).

    All constant violations are one scan.  A variable violation counts, per group of equal left-hand sides, unordered pairs
    of rows with differing right-hand sides: (n^2 - sum of squares) / 2 from two stages of counts.
    """
    _check_columns(df, cfds)
    spark = df.sparkSession
    cells, counts = [], []
    for i, c in enumerate(cfds):
        for j, p in enumerate(c.patterns):
            for attr, v in zip(c.rhs, p.rhs, strict=True):
                hit = F.lit(False) if v == WILDCARD else matches(c.lhs, p.lhs) & ~F.col(attr).cast("string").eqNullSafe(F.lit(v))
                counts.append(F.count_if(hit).alias(f"c{len(cells)}"))
                cells.append((i, j, attr, v))
    if not cells:
        return spark.createDataFrame([], "cfd_idx int, pat_idx int, attr string, const_vio bigint, var_vio bigint")
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("cfd_idx"), F.lit(j).alias("pat_idx"), F.lit(attr).alias("attr"), F.col(f"c{k}").alias("const_vio")) for k, (i, j, attr, _) in enumerate(cells)]))
    const = df.agg(*counts).select(rows.alias("r")).select("r.*")
    variable = None
    for i, c in enumerate(cfds):
        for a, attr in enumerate(c.rhs):
            wild = [(j, p) for j, p in enumerate(c.patterns) if p.rhs[a] == WILDCARD]
            if not wild:
                continue
            # one frequency table per dependency and attribute answers all its patterns
            n = df.groupBy(*[F.col(x).cast("string").alias(f"l{k}") for k, x in enumerate(c.lhs)], F.col(attr).cast("string").alias("r")).agg(F.count(F.lit(1)).alias("n"))
            per = n.groupBy(*[f"l{k}" for k in range(len(c.lhs))]).agg(F.sum("n").cast("decimal(38,0)").alias("n"), F.sum(F.col("n").cast("decimal(19,0)") * F.col("n")).alias("sq"))
            pairs = ((F.col("n") * F.col("n") - F.col("sq")) / 2).cast("bigint")
            keys = tuple(f"l{k}" for k in range(len(c.lhs)))
            got = per.agg(*[F.coalesce(F.sum(F.when(matches(keys, p.lhs), pairs)), F.lit(0)).cast("bigint").alias(f"v{j}") for j, p in wild])
            r = F.explode(F.array(*[F.struct(F.lit(i).alias("cfd_idx"), F.lit(j).alias("pat_idx"), F.lit(attr).alias("attr"), F.col(f"v{j}").alias("var_vio")) for j, _ in wild]))
            part = got.select(r.alias("r")).select("r.*")
            variable = part if variable is None else variable.unionByName(part)
    if variable is None:
        return const.withColumn("var_vio", F.lit(0).cast("bigint"))
    both = const.withColumn("var_vio", F.lit(0).cast("bigint")).unionByName(variable.withColumn("const_vio", F.lit(0).cast("bigint")))
    return both.groupBy("cfd_idx", "pat_idx", "attr").agg(F.sum("const_vio").alias("const_vio"), F.sum("var_vio").alias("var_vio"))


def violations(df: DataFrame, cfds: tuple[str, ...] | list[str] | str) -> Violations:
    parsed = parse_all(cfds)
    out: dict[str, dict[str, dict[str, Violation]]] = {c.name: {str(p): {} for p in c.patterns} for c in parsed}
    for r in violation_table(df, parsed).collect():
        c = parsed[r.cfd_idx]
        out[c.name][str(c.patterns[r.pat_idx])][r.attr] = Violation(r.const_vio, r.var_vio)
    return Violations(out)


def _majority(df: DataFrame, c: CFD, attr: str) -> DataFrame:
    """(l0.., to): the most frequent right-hand side of each group that has several; ties go to the smallest value."""
    keys = [f"l{k}" for k in range(len(c.lhs))]
    n = df.groupBy(*[F.col(x).cast("string").alias(k) for k, x in zip(keys, c.lhs, strict=True)], F.col(attr).cast("string").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("several"), F.min_by("r", F.struct((-F.col("n")).alias("n"), F.col("r").isNull().alias("z"), F.col("r").alias("r"))).alias("to"))
    return best.where("several > 1").drop("several")


def repair(df: DataFrame, cfds: tuple[str, ...] | list[str] | str, *, priorities: list[float] | tuple[float, ...] = (), max_rounds: int = 3) -> DataFrame:
    """At most ``max_rounds`` rounds: constants of patterns are written (highest priority first, later ones win ties), then each
    attribute gets, of the majorities of all dependencies that bind it, the value with the largest summed priority.  Values
    keep their column's type.  Rounds are cut by checkpoints and stop when nothing is violated."""
    parsed = parse_all(cfds, priorities)
    _check_columns(df, parsed)
    order = df.columns
    for round_ in range(max_rounds):
        if round_ and not violation_table(df, parsed).where("const_vio > 0 or var_vio > 0").limit(1).count():
            break
        writes: dict[str, list[tuple[float, int, Column, str]]] = {}
        for c in parsed:
            for p in c.patterns:
                for attr, v in zip(c.rhs, p.rhs, strict=True):
                    if v != WILDCARD:
                        writes.setdefault(attr, []).append((c.priority, len(writes.get(attr, [])), matches(c.lhs, p.lhs), v))
        new = {}
        for attr, rules in writes.items():
            case = F
            for _, _, cond, v in sorted(rules, key=lambda r: (-r[0], -r[1])):
                case = case.when(cond, F.lit(v).try_cast(df.schema[attr].dataType))
            new[attr] = case.otherwise(F.col(attr))
        df = df.withColumns(new) if new else df
        votes: dict[str, list[tuple[float, str]]] = {}
        marks = []
        for i, c in enumerate(parsed):
            for a, attr in enumerate(c.rhs):
                bound = [p for p in c.patterns if p.rhs[a] == WILDCARD]
                if not bound:
                    continue
                hit = F.lit(False)
                for p in bound:
                    hit = hit | matches(c.lhs, p.lhs)
                marks.append((i, a, c, attr, hit))
        work = df
        for i, a, c, attr, hit in marks:
            table = _majority(df, c, attr).select(*[F.col(f"l{k}").alias(f"__l{k}") for k in range(len(c.lhs))], F.struct("to").alias(f"__to{i}_{a}"))
            on = F.lit(True)
            for k, x in enumerate(c.lhs):
                on = on & work[x].cast("string").eqNullSafe(table[f"__l{k}"])
            work = work.join(table, on, "left").drop(*[f"__l{k}" for k in range(len(c.lhs))])
            work = work.withColumn(f"__to{i}_{a}", F.when(hit, F.col(f"__to{i}_{a}")))
            votes.setdefault(attr, []).append((c.priority, f"__to{i}_{a}"))
        fixes = {}
        for attr, given in votes.items():
            # each proposal's weight is the summed priority of all equal proposals; the heaviest wins, the later on ties
            best = F.lit(None).cast("struct<w:double,k:int,to:string>")
            for k, (_, name) in enumerate(given):
                weight = F.lit(0.0)
                for p, other in given:
                    weight = weight + F.when(F.col(other).isNotNull() & F.col(other)["to"].eqNullSafe(F.col(name)["to"]), float(p)).otherwise(0.0)
                mine = F.when(F.col(name).isNotNull(), F.struct(weight.alias("w"), F.lit(k).alias("k"), F.col(name)["to"].alias("to")))
                best = F.greatest(best, mine)
            fixes[attr] = F.when(best.isNotNull(), best["to"].try_cast(df.schema[attr].dataType)).otherwise(F.col(attr))
        df = checkpoint((work.withColumns(fixes) if fixes else work).select(*order))
    return df
