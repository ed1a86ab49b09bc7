"""Row security: who sees which agents' calls, and SQL over views that hold nothing else."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_CAP = 500
SECONDS = 5.0
#: groups of built-in functions that only compute; those left out reach the engine, files or the machine
PURE = frozenset(
    f"{group}_funcs"
    for group in ("agg", "array", "bitwise", "collection", "conditional", "conversion", "date", "datetime", "generator", "hash", "json", "lambda", "map", "math", "predicate", "string", "struct", "variant", "window")
)
#: functions that stand as tables
TABLES = frozenset({"explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "range", "stack", "json_tuple"})
#: what an analysed query may be made of; commands, inserts and relations that are no view of the caller's are not here
NODES = frozenset(
    """Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit
    LocalRelation Offset OneRowRelation Pivot Project Range ResolvedHint Sample Sort SubqueryAlias Tail Union Unpivot View Window WithCTE""".split()
)


@dataclass(frozen=True)
class Scope:
    """Visible agents: None is an unset scope and sees nothing, '*' sees all."""

    agents: frozenset | str | None
    call_id: object = None

    @classmethod
    def of(cls, agents: Iterable | None, call_id: object = None) -> Scope:
        return cls("*" if agents is None else frozenset(agents), call_id)

    @classmethod
    def granted(cls, grants: Iterable, admin: bool = False, call_id: object = None) -> Scope:
        """Owners, admins and members without any grant see every agent."""
        grants = frozenset(grants)
        return cls("*" if admin or not grants else grants, call_id)


def secured(calls: DataFrame, scope: Scope, agent: str = "agent_id", call: str = "call_id") -> DataFrame:
    """The calls a scope sees; a call binding narrows it to one."""
    if not scope.agents:
        return calls.where(F.lit(False))
    out = calls if scope.agents == "*" else calls.where(F.col(agent).isin(*sorted(scope.agents)))
    return out if scope.call_id is None else out.where(F.col(call) == F.lit(scope.call_id))


def secured_through(rows: DataFrame, calls: DataFrame, *keys: str) -> DataFrame:
    """Rows of the visible calls."""
    return rows.join(calls, list(keys), "left_semi")


def run_sql(spark: SparkSession, views: Mapping[str, DataFrame], query: str, cap: int = ROW_CAP, seconds: float = SECONDS) -> dict:
    """Run one read-only statement over scoped views and nothing else.

    The views live in the caller's session under a name prefix of their own and
    are dropped afterwards; the statement has to be a single query that names
    only them, consists of ``NODES`` and calls built-in functions of ``PURE``
    groups alone, so it writes nothing, runs no command and reaches no method or
    file. Gives columns, rows (``cap`` at most), row_count and truncated,
    or error; never raises on a bad statement.
    """
    text = query.strip().rstrip(";")
    if not re.match(r"(?is)^(select|with)\b", text) or ";" in text:
        return {"error": "only a single SELECT is allowed"}
    session = spark.newSession()
    try:
        for name, df in views.items():
            # temp views are of one session: the frames' plans are re-read there
            _register(session, name, df)
        if found := _impure(session, text):
            return {"error": f"function {found} is not allowed"}
        if found := _foreign(session, text, set(views)):
            return {"error": found}
        out = session.sql(text).limit(cap + 1)
        rows = [list(r) for r in _within(session, out, seconds)]
        return {"columns": out.columns, "rows": rows[:cap], "row_count": min(len(rows), cap), "truncated": len(rows) > cap}
    except (PySparkException, Py4JJavaError) as error:
        if "SPARK_JOB_CANCELLED" in str(error):
            return {"error": f"statement took more than {seconds:g} s"}
        return {"error": str(error).strip().splitlines()[0][:300]}


def _within(session: SparkSession, out: DataFrame, seconds: float) -> list:
    """The rows, or an error after so many seconds; what runs then, or starts later, is cancelled by its tag."""
    tag, over = f"ad-hoc-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late = seconds
        while not over.wait(late):
            session.sparkContext.cancelJobsWithTag(tag)
            late = 0.2

    session.sparkContext.addJobTag(tag)
    threading.Thread(target=cancel, daemon=True).start()
    try:
        return out.collect()
    finally:
        over.set()
        session.sparkContext.removeJobTag(tag)


def _register(session: SparkSession, name: str, df: DataFrame) -> None:
    jvm = session.sparkContext._jvm
    frame = jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.logicalPlan())
    frame.createOrReplaceTempView(name)


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Trees:
    """What a node of the engine's trees is: attributes of a JVM object tell nothing."""

    def __init__(self, session: SparkSession):
        named = session._jvm.java.lang.Class.forName
        catalyst = "org.apache.spark.sql.catalyst"
        self._node = named(f"{catalyst}.trees.TreeNode")
        self._plan = named(f"{catalyst}.plans.logical.LogicalPlan")
        self._holder = named(f"{catalyst}.expressions.PlanExpression")

    def plan(self, node) -> bool:
        return self._plan.isInstance(node)

    def children(self, node) -> list:
        return [x for x in [*_each(node.children()), *_each(node.innerChildren())] if self._node.isInstance(x)]

    def plans(self, plan) -> list:
        """Child plans, with those of subqueries and of what the plan names."""
        return [x for x in [*self.children(plan), *_each(plan.subqueries())] if self.plan(x)]

    def everything(self, node) -> list:
        """Children, and expressions of a plan, and the plan of a subquery."""
        more = _each(node.expressions()) if self.plan(node) else [node.plan()] if self._holder.isInstance(node) else []
        return [*self.children(node), *more]


def _impure(session: SparkSession, text: str) -> str | None:
    """The first function that the statement calls and that is not of a group that only computes."""
    catalyst = session._jvm.org.apache.spark.sql.catalyst
    trees = _Trees(session)
    scalar, table = catalyst.analysis.FunctionRegistry.builtin(), catalyst.analysis.TableFunctionRegistry.builtin()

    def called(name: str, registry, fine) -> str | None:
        info = registry.lookupFunction(catalyst.FunctionIdentifier(name.lower()))
        return None if info.isDefined() and fine(info.get()) else name

    def of(parts) -> str:
        return ".".join(_each(parts))

    def walk(node) -> str | None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction" and (bad := called(of(node.nameParts()), scalar, lambda i: i.getGroup() in PURE)):
            return bad
        if kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedGenerator"):
            name = node.name().toString() if kind == "UnresolvedGenerator" else of(node.name()) if kind == "UnresolvedTableValuedFunction" else "range"
            if name.lower() not in TABLES or called(name, table, lambda i: True):
                return name
        for child in trees.everything(node):
            if bad := walk(child):
                return bad
        return None

    return walk(session._jsparkSession.sessionState().sqlParser().parsePlan(text))


def _foreign(session: SparkSession, text: str, allowed: set[str]) -> str | None:
    """What the analysed statement holds besides ``NODES`` over the allowed views, as an error.

    Names are resolved by the analyser, so a WITH name hides a table only where
    it is in scope. The views' own plans stand below a node that names the view;
    what is read anywhere else was named by the statement.
    """
    trees = _Trees(session)
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    analysed = session._jsparkSession.sessionState().executePlan(plan, session._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).analyzed()

    def walk(node) -> str | None:
        kind = node.getClass().getSimpleName()
        if kind == "View" and node.isTempView():
            name = node.desc().identifier().table()
            return None if name in allowed else f"no view named {name}"
        if "Relation" in kind and kind not in NODES:
            return f"no view named {node.simpleString(60)}"
        if kind not in NODES:
            return f"{kind} is not allowed"
        for child in trees.plans(node):
            if bad := walk(child):
                return bad
        return None

    return walk(analysed)
