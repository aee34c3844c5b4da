"""Read-only SQL over allowed views, with a row limit and a bound on work.

Spark parses the text; nothing here reads SQL. The parsed plan, before it is resolved, tells which relations it names and whether it
is a query at all; the analysed plan then runs in a session of its own that has the allowed views and nothing else.

Work is bounded three times. Functions that make rows or long values out of nothing (range, sequence, repeat and the like) must have literal sizes of MAX_MADE at most, and no
other table function is taken than those listed. The optimised plan's rows are estimated before anything runs: cross and theta joins multiply, generators
and grouping sets too, equal keys do not; a plan with a step of more than MAX_WORK rows is refused. Recursive queries end at the session's limits on levels and rows. And
collect() interrupts a query's jobs after a time.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

MAX_ROWS = 200
#: Rows or characters that a function may make out of nothing, rows of a step of a plan, what a generator makes of a row, and seconds.
MAX_MADE, MAX_WORK, GENERATED, SECONDS = 100_000, 10_000_000_000, 100, 60.0
#: Parquet holds a row in fewer bytes than its types have.
COMPRESSED = 4
RECURSION = {"spark.sql.cteRecursionLevelLimit": "100", "spark.sql.cteRecursionRowLimit": str(MAX_MADE)}

#: Functions that reach outside the data, and nodes of parsed plans that queries are made of.
FORBIDDEN_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true current_user session_user version".split())
QUERY_NODES = frozenset(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation OneRowRelation Pivot Project
    Sort SubqueryAlias Tail UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction
    UnresolvedWith Union Unpivot Window WithWindowDefinition Offset Sample ResolvedInlineTable CTERelationDef CTERelationRef WithCTE UnresolvedTVFAliases PipeOperator""".split()
)
#: Table functions that are taken, and which arguments of functions say how much they make.
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack range".split())
SIZES = {"repeat": (1,), "array_repeat": (1,), "space": (0,), "lpad": (1,), "rpad": (1,)}


class NotAllowed(ValueError):
    """The text is no query that may run."""


@dataclass(frozen=True)
class Checked:
    sql: str
    tables: tuple[str, ...]
    limit: int


def _children(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _plans(plan) -> list:
    """A parsed plan with all plans inside it, subqueries and named queries included."""
    out, open_ = [], [plan]
    while open_:
        now = open_.pop()
        out.append(now)
        open_ += _children(now.children())
        open_ += [p for p in _children(now.innerChildren()) if hasattr(p, "children") and p.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans")]
        if now.getClass().getSimpleName() == "UnresolvedWith":
            open_ += [_pair(x)[1] for x in _children(now.cteRelations())]
        for expression in _children(now.expressions()):
            open_ += _subplans(expression)
    return out


def _pair(x) -> tuple:
    return x.productElement(0), x.productElement(1)


def _subplans(expression) -> list:
    out = []
    kind = expression.getClass().getSimpleName()
    if kind in ("Exists", "LateralSubquery", "ListQuery", "ScalarSubquery"):
        out.append(expression.plan())
    elif "TableSubquery" in kind:
        raise NotAllowed("a table is no argument")
    for child in _children(expression.children()):
        out += _subplans(child)
    return out


def _functions(expression) -> set[str]:
    out = set()
    if expression.getClass().getSimpleName() == "UnresolvedFunction":
        out.add(expression.nameParts().mkString(".").lower())
    for child in _children(expression.children()):
        out |= _functions(child)
    return out


def _literal(expression) -> int:
    kind = expression.getClass().getSimpleName()
    if kind == "UnaryMinus":
        return -_literal(expression.child())
    value = expression.value() if kind == "Literal" else None
    if not isinstance(value, int):
        raise NotAllowed("what makes rows or long values needs literal sizes")
    return value


def _length(arguments: list) -> int:
    """Values from a first to a last one. Dates and timestamps count in the units that they are held in; steps of time are a day at least."""
    low, high = _literal(arguments[0]), _literal(arguments[1])
    step = arguments[2] if len(arguments) > 2 else None
    if step is not None and step.getClass().getSimpleName() != "Literal" and step.getClass().getSimpleName() != "UnaryMinus":
        raise NotAllowed("what makes rows or long values needs literal sizes")
    each = _literal(step) if step is not None and isinstance(getattr(step, "value", lambda: 1)(), int) else 1
    return abs(high - low) // max(1, abs(each)) + 1


def _bounded(name: str, arguments: list) -> None:
    made = [_literal(arguments[i]) for i in SIZES.get(name, ()) if i < len(arguments)]
    if name == "sequence" and len(arguments) > 1:
        made.append(_length(arguments))
    if name == "range":
        made.append(_length(arguments) if len(arguments) > 1 else _literal(arguments[0]) if arguments else 0)
    if any(n > MAX_MADE for n in made):
        raise NotAllowed(f"{name} may make {MAX_MADE} at most")


def _bounded_below(expression) -> None:
    if expression.getClass().getSimpleName() == "UnresolvedFunction":
        _bounded(expression.nameParts().mkString(".").lower(), _children(expression.children()))
    for child in _children(expression.children()):
        _bounded_below(child)


def _rows(plan) -> tuple[float, float]:
    """(rows of a plan, rows of its largest step), as estimated."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    below = [_rows(c) for c in _children(plan.children())]
    rows, most = [r for r, _ in below], max((m for _, m in below), default=0.0)
    if kind == "Join":
        left, right = rows
        how = plan.joinType().toString()
        conditions = plan.condition()
        keyed = conditions.isDefined() and _has_equal_sides(conditions.get(), plan.left().outputSet(), plan.right().outputSet())
        most = max(most, max(left, right) if keyed else left * right)
        out = left if how in ("LeftSemi", "LeftAnti") or "Existence" in how else max(left, right) if keyed else left * right
    elif kind == "Generate":
        out = rows[0] * GENERATED
    elif kind == "Expand":
        out = rows[0] * plan.projections().size()
    elif kind == "Union":
        out = sum(rows)
    elif kind in ("UnionLoop", "UnionLoopRef"):
        out = float(MAX_MADE)
    elif kind in ("GlobalLimit", "LocalLimit", "Tail") and plan.limitExpr().getClass().getSimpleName() == "Literal":
        out = min(rows[0], float(plan.limitExpr().value()))
    elif kind == "Range":
        out = float(str(plan.numElements()))
    elif kind == "LocalRelation":
        out = float(plan.data().size())
    elif rows:
        out = max(rows)
    else:
        width = 8 + sum(a.dataType().defaultSize() for a in _children(plan.output().toSeq()))
        out = 1.0 if kind == "OneRowRelation" else max(1.0, COMPRESSED * float(str(plan.stats().sizeInBytes())) / width)
    return out, max(most, out)


def _has_equal_sides(condition, left, right) -> bool:
    """Whether a condition demands a value of one side to equal one of the other."""
    kind = condition.getClass().getSimpleName()
    if kind == "And":
        return _has_equal_sides(condition.left(), left, right) or _has_equal_sides(condition.right(), left, right)
    if kind in ("EqualTo", "EqualNullSafe"):
        a, b = condition.left().references(), condition.right().references()
        sides = (a.subsetOf(left), a.subsetOf(right), b.subsetOf(left), b.subsetOf(right))
        return bool(a.size() and b.size()) and (sides[0] and sides[3] or sides[1] and sides[2])
    return False


def estimated_rows(frame: DataFrame) -> float:
    """Rows of the largest step of a frame's optimised plan, its subqueries included."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    return max(_rows(p)[1] for p in [plan, *_children(plan.subqueriesAll())])


def check(spark: SparkSession, sql: str, allowed: Sequence[str], max_rows: int = MAX_ROWS, requested: int | None = None) -> Checked:
    """Raises NotAllowed unless sql is one query over allowed views (named with no qualifier) and named queries of its own."""
    if not sql or not sql.strip():
        raise NotAllowed("the query is empty")
    text = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise NotAllowed(f"the query can't be parsed: {str(e).splitlines()[0][:200]}") from None
    plans = _plans(plan)
    names, own = set(), set()
    for p in plans:
        kind = p.getClass().getSimpleName().rstrip("$")
        if kind not in QUERY_NODES:
            raise NotAllowed(f"{kind} is not allowed")
        if kind == "UnresolvedWith":
            own |= {_pair(x)[0].lower() for x in _children(p.cteRelations())}
        if kind == "UnresolvedRelation":
            if p.multipartIdentifier().size() != 1:
                raise NotAllowed("relations are named without a qualifier")
            names.add(p.multipartIdentifier().apply(0).lower())
        if kind == "UnresolvedTableValuedFunction":
            name = p.name().apply(0).lower()
            if p.name().size() != 1 or name not in TABLE_FUNCTIONS:
                raise NotAllowed("this table function is not allowed")
            _bounded(name, _children(p.functionArgs()))
        for expression in _children(p.expressions()):
            if bad := _functions(expression) & FORBIDDEN_FUNCTIONS:
                raise NotAllowed(f"{', '.join(sorted(bad))} is not allowed")
            _bounded_below(expression)
    views = {a.lower() for a in allowed}
    if clash := own & views:
        raise NotAllowed(f"a named query hides {', '.join(sorted(clash))}")
    if unknown := names - own - views:
        raise NotAllowed(f"not among the allowed views: {', '.join(sorted(unknown))}")
    return Checked(text, tuple(sorted(names - own)), min(max(requested if requested is not None else max_rows, 1), max_rows))


def run(spark: SparkSession, sql: str, views: Mapping[str, str], max_rows: int = MAX_ROWS, requested: int | None = None, max_work: float = MAX_WORK) -> DataFrame:
    """The result of a checked query, at most max_rows rows of it. views: Parquet path of each allowed view. max_work: rows of the largest step, as estimated."""
    own = spark.newSession()
    for name, value in RECURSION.items():
        own.conf.set(name, value)
    checked = check(own, sql, list(views), max_rows, requested)
    for name, path in views.items():
        if name.lower() in checked.tables:
            own.read.parquet(path).createOrReplaceTempView(name)
    found = own.sql(checked.sql)
    if (rows := estimated_rows(found)) > max_work:
        raise NotAllowed(f"a step of the query would have some {rows:.2g} rows, more than {max_work:.2g}")
    return found.limit(checked.limit)


def collect(spark: SparkSession, sql: str, views: Mapping[str, str], seconds: float = SECONDS, **how) -> tuple[list[str], list[Row]]:
    """(columns, rows) of run(). After so many seconds the query's jobs are interrupted, and TimeoutError says so."""
    context, tag = spark.sparkContext, f"gateway-{uuid.uuid4().hex}"
    found = run(spark, sql, views, **how)
    late, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while True:  # a query may start further jobs
                context.cancelJobsWithTag(tag)
                if done.wait(0.5):
                    return

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        return found.columns, found.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the query was stopped after {seconds:g} seconds") from None
        raise e
    finally:
        done.set()
        context.removeJobTag(tag)
        watcher.join()


def describe(views: Mapping[str, DataFrame]) -> list[dict]:
    """Name and columns (name, type) of each view."""
    return [{"table": k, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in v.schema]} for k, v in sorted(views.items())]
