"""Which tables a SQL text reads, by asking Spark's own parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EDGE_FIELDS = "src string, dst string"


def referenced_tables(spark: SparkSession, sql: str) -> list[str]:
    """Tables read anywhere in ``sql``, each once, in order of appearance.

    Joins, set operations, derived tables and subqueries are followed; names of common
    table expressions are not tables inside their scope.
    """
    # The parser has no public Python entry; this is the only use of the session's JVM side.
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found: dict[str, None] = {}
    _collect(plan, frozenset(), found)
    return list(found)


def reference_edges(spark: SparkSession, models) -> DataFrame:
    """Edges from every table a model reads to the model."""
    rows = [(table, model.name) for model in models for table in referenced_tables(spark, model.sql)]
    return spark.createDataFrame(rows, EDGE_FIELDS)


def _collect(plan, hidden, found):
    kind = plan.getClass().getSimpleName()
    if kind == "UnresolvedRelation":
        parts = list(_items(plan.multipartIdentifier()))
        if len(parts) > 1 or parts[0].lower() not in hidden:
            found.setdefault(".".join(parts))
        return
    if kind == "UnresolvedWith":
        inside = hidden
        recursive = plan.allowRecursion()
        for relation in _items(plan.cteRelations()):
            name = relation._1().lower()
            _collect(relation._2(), inside | {name} if recursive else inside, found)
            inside = inside | {name}
        _collect(plan.child(), inside, found)
        return
    for child in _items(plan.children()):
        _collect(child, hidden, found)
    for expression in _items(plan.expressions()):
        _collect_in_expression(expression, hidden, found)


def _collect_in_expression(expression, hidden, found):
    if _has_plan(expression):
        _collect(expression.plan(), hidden, found)
    for child in _items(expression.children()):
        _collect_in_expression(child, hidden, found)


def _has_plan(expression) -> bool:
    return expression.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")


def _items(sequence):
    for at in range(sequence.size()):
        yield sequence.apply(at)
