"""Read-only SQL from outside: one statement, allowed views, no dangerous functions, a row limit."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

#: Plan nodes that only read, and functions that reach outside.
READS = ("Project", "Filter", "Aggregate", "Join", "Sort", "Union", "Distinct", "Except", "Intersect", "GlobalLimit", "LocalLimit", "Offset", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "WithCTE", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "Generate", "Window", "WithWindowDefinition", "Pivot", "Unpivot", "UnresolvedInlineTable", "OneRowRelation", "LateralJoin", "UnresolvedTableValuedFunction")
BLOCKED = ("java_method", "reflect", "input_file_name", "version", "current_user", "session_user", "current_database", "current_catalog", "try_reflect")


class Refused(ValueError):
    """The statement isn't allowed."""


def check(spark: SparkSession, sql: str, allowed: Collection[str]) -> None:
    """Raises Refused unless the parsed statement only reads from allowed relations (or its own CTEs)."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as error:
        raise Refused(f"it can't be parsed: {str(error).splitlines()[0]}") from error
    names = {a.lower() for a in allowed}

    def walk(node, inner: set[str]) -> None:
        kind = node.nodeName().strip()
        if kind not in READS:
            raise Refused(f"{kind} isn't allowed")
        own = set(inner)
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                pair = relations.apply(i)
                walk(pair._2(), own)
                own.add(pair._1().lower())
        if kind == "UnresolvedRelation" and (name := node.tableName().lower()) not in names | own:
            raise Refused(f"{name} isn't allowed")
        text = node.expressions().mkString(" ").lower()
        if hit := next((f for f in BLOCKED if re.search(rf"(?<![a-z_]){f}\(", text)), None):
            raise Refused(f"{hit} isn't allowed")
        for i in range(node.subqueries().size()):
            walk(node.subqueries().apply(i), own)
        for i in range(node.children().size()):
            walk(node.children().apply(i), own)

    walk(plan, set())


def guarded(spark: SparkSession, sql: str, allowed: Collection[str], most: int = 5000) -> DataFrame:
    """The statement's rows, at most so many."""
    check(spark, sql, allowed)
    return spark.sql(sql.strip().rstrip(";")).limit(most)
