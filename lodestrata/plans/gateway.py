"""Read-only SQL: a lexical gate, a look at the parsed plan's relations and functions, a pushed-down cap.

Spark has no read-only transaction, so what a statement may touch is decided before it is analyzed:
tables and views that the session knows, its own common table expressions, and no function that
calls Java or reads by path. Of the parsed plan only nodes that the check knows are let through, so
a clause that puts names together from pieces is refused. The analyzed plan is looked at once more:
every leaf is a known view or table or holds no data of its own, and nothing calls Java.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

MAX_ROWS, DEFAULT_ROWS = 5000, 200
#: Fixed values of the interface: words a statement may begin with, and words it may not hold anywhere.
LEAD_WORDS = ("select", "with", "explain", "show", "table", "values")
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "vacuum", "analyze", "comment", "copy", "lock", "reindex", "refresh", "cluster")
#: Functions that run code outside of SQL, and table functions that read nothing but their arguments.
BARRED_FUNCTIONS = ("reflect", "java_method", "try_reflect")
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple")
#: Nodes of a parsed statement that are let through; of other packages than the analysis' own, all expressions are.
PLAN_NODES = frozenset(
    "Aggregate Distinct Except ExplainCommand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project Sample ShowColumns ShowFunctions "
    "ShowNamespaces ShowTables ShowViews Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTable UnresolvedTableOrView "
    "UnresolvedTableValuedFunction UnresolvedView UnresolvedWith Window WithWindowDefinition CurrentNamespace$ UnresolvedNamespace ShowFunctionsCommand ShowColumnsCommand".split()
)
ANALYSIS_EXPRESSIONS = frozenset(
    "MultiAlias UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedOrdinal UnresolvedStar UnresolvedStarExcept UnresolvedStarExceptOrReplace "
    "UnresolvedSubqueryColumnAliases".split()
)
#: Leaves of an analyzed statement that read no file; a file relation is let through below a view or as a table of the catalog.
PLAIN_LEAVES = frozenset("CTERelationRef LocalRelation LogicalRDD OneRowRelation Range UnionLoopRef ResolvedNamespace CommandResult InMemoryRelation".split())
JAVA_CALLS = ("CallMethodViaReflection", "TryReflect", "StaticInvoke", "Invoke")
SHOWN = r"show\s+(tables|views|databases|schemas|functions|columns)\b"


class Rejected(ValueError):
    """The statement is not a single read-only query."""


@dataclass(frozen=True)
class Answer:
    columns: list[str]
    rows: list[tuple]
    row_count: int
    truncated: bool
    duration_ms: float
    statement: str


def cleaned(sql: str) -> str:
    """The statement without comments and a trailing semicolon, or Rejected.

    Words and semicolons inside literals count too; that is stricter than needed, and kept.
    """
    text = re.sub(r"--[^\n]*", " ", re.sub(r"(?s)/\*.*?\*/", " ", sql or "")).strip().removesuffix(";").strip()
    if not text:
        raise Rejected("empty statement")
    if ";" in text:
        raise Rejected("multiple statements")
    if (word := re.match(r"[A-Za-z]*", text)[0].lower()) not in LEAD_WORDS:
        raise Rejected(f"a statement cannot begin with {word or text[0]!r}")
    if found := re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", text):
        raise Rejected(f"forbidden word: {found[1].lower()}")
    if found := re.search(rf"(?i)\b({'|'.join(BARRED_FUNCTIONS)})\b", text):
        raise Rejected(f"forbidden function: {found[1].lower()}")
    if word == "show" and not re.match(f"(?i){SHOWN}", text):
        raise Rejected("only tables, views, schemas, functions and columns are shown")
    return text


def _nodes(spark: SparkSession, plan: object, stop: tuple[str, ...] = ()) -> list:
    """All nodes of a plan and of its expressions, whatever they are nested in, but for what lies below nodes named in ``stop``."""
    gateway, out, todo = spark.sparkContext._gateway, [], [plan]
    while todo:
        item = todo.pop()
        if not isinstance(item, JavaObject):
            continue
        if is_instance_of(gateway, item, "scala.collection.Iterable"):
            parts = item.iterator()
        elif is_instance_of(gateway, item, "scala.Product"):  # nodes, options and pairs
            parts = item.productIterator()
        else:
            continue
        if is_instance_of(gateway, item, "org.apache.spark.sql.catalyst.trees.TreeNode"):
            out.append(item)
            if item.getClass().getSimpleName() in stop:
                continue
        while parts.hasNext():
            todo.append(parts.next())
    return out


def _is_plan(spark: SparkSession, node: JavaObject) -> bool:
    return is_instance_of(spark.sparkContext._gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")


def check_relations(spark: SparkSession, text: str) -> None:
    """Refuses nodes that are not known, relations that the session does not know by name, and table functions that read."""
    text = re.sub(r"(?i)^explain\s+((extended|formatted|codegen|cost)\s+)?", "", text)
    try:
        nodes = _nodes(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
    except ParseException as error:
        raise Rejected(str(error).strip().splitlines()[0]) from None
    named = {node.alias().lower() for node in nodes if node.getClass().getSimpleName() == "SubqueryAlias"}
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if _is_plan(spark, node):
            if kind not in PLAN_NODES:
                raise Rejected(f"forbidden clause: {kind}")
        elif ".catalyst.analysis." in node.getClass().getName() and kind not in ANALYSIS_EXPRESSIONS:
            raise Rejected(f"forbidden expression: {kind}")
        if kind in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedView", "UnresolvedTableOrView"):
            parts = [node.multipartIdentifier().apply(n) for n in range(node.multipartIdentifier().size())]
            known = len(parts) == 1 and parts[0].lower() in named
            if not known and not spark.catalog.tableExists(".".join(f"`{x.replace('`', '``')}`" for x in parts)):
                raise Rejected(f"unknown relation: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction" and node.name().apply(0).lower() not in TABLE_FUNCTIONS:
            raise Rejected(f"forbidden table function: {node.name().apply(0)}")
        elif kind == "UnresolvedFunction" and node.nameParts().last().lower() in BARRED_FUNCTIONS:
            raise Rejected(f"forbidden function: {node.nameParts().last()}")


def check_analyzed(spark: SparkSession, df: DataFrame) -> None:
    """Refuses an analyzed query that reads anything but views and tables of the catalog, or calls Java."""
    for node in _nodes(spark, df._jdf.queryExecution().analyzed(), stop=("View",)):
        kind = node.getClass().getSimpleName().removesuffix("$")
        if kind in JAVA_CALLS:
            raise Rejected(f"forbidden function: {kind}")
        if _is_plan(spark, node) and not node.children().size() and kind not in PLAIN_LEAVES:
            if kind != "HiveTableRelation" and not (kind == "LogicalRelation" and node.catalogTable().isDefined()):
                raise Rejected(f"reads more than views and tables: {kind}")


def plan(spark: SparkSession, sql: str) -> DataFrame:
    """The query of an accepted statement; nothing has run yet, but for SHOW and EXPLAIN."""
    text = cleaned(sql)
    check_relations(spark, text)
    df = spark.sql(text)
    if not re.match(r"(?i)(explain|show)\b", text):
        if "Command" in df._jdf.queryExecution().analyzed().getClass().getSimpleName():
            raise Rejected("not a query")
        check_analyzed(spark, df)
    return df


def execute(spark: SparkSession, sql: str, max_rows: int = DEFAULT_ROWS) -> Answer:
    """At most ``max_rows`` (1 to 5000) rows; one more is asked for, to know whether the answer was cut."""
    cap, start = max(1, min(MAX_ROWS, int(max_rows))), time.monotonic()
    try:
        df = plan(spark, sql)
        rows = [tuple(r) for r in df.limit(cap + 1).collect()]
    except Rejected:
        raise
    except Exception as error:
        raise ValueError(str(error).strip().splitlines()[0]) from None
    return Answer(df.columns, rows[:cap], min(len(rows), cap), len(rows) > cap, (time.monotonic() - start) * 1000, cleaned(sql))
