"""Read-only SQL over registered views.

A statement is parsed, not executed, and all that its parsed plan is made of is
walked: it may have the listed kinds of nodes and expressions only, read
temporary views and its own common table expressions by a name of one part, and
call the listed functions and table functions. So no command, no file or catalog relation and no function that
reaches into the JVM passes, whatever the statement's text looks like.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The plan nodes that a query may have.
NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "Join", "LateralJoin", "Generate", "Pivot", "UnresolvedHaving",
    "SubqueryAlias", "UnresolvedWith", "WithWindowDefinition", "UnresolvedRelation", "UnresolvedTableValuedFunction", "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "OneRowRelation", "LocalRelation",
}
#: The functions that a query may call.
FUNCTIONS = set(
    """abs acos any_value array array_contains array_distinct array_join array_max array_min array_position array_size array_sort asin atan avg between bigint bit_count bool_and bool_or boolean btrim cardinality cast ceil ceiling char_length coalesce
    collect_list collect_set concat concat_ws contains corr cos count count_if cume_dist current_date current_timestamp date date_add date_diff date_format date_sub date_trunc day dayofweek dense_rank double element_at endswith exp explode extract
    filter first first_value flatten float floor from_json get_json_object greatest hour if ifnull ilike initcap inline instr int isnan isnotnull isnull json_array_length lag last last_value lcase lead least left len length like ln
    locate log log10 lower lpad ltrim map map_keys map_values max max_by md5 mean median min min_by minute mod month named_struct nth_value ntile nullif nvl percent_rank percentile percentile_approx posexplode position pow power quarter radians
    rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace replace reverse right rlike round row_number rpad rtrim second sha2 sign sin size slice sort_array split sqrt startswith stddev string struct
    substr substring sum tan timestamp to_date to_timestamp transform trim trunc ucase unix_timestamp upper variance weekday window year""".split()
)
TABLE_FUNCTIONS = {"range", "explode", "posexplode", "inline"}


#: The kinds of expressions that a query may have.
EXPRESSIONS = set(
    """Add Alias And AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Contains Cube CurrentDate CurrentRow$ CurrentTimestamp Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual GroupingSets
    In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction LateralSubquery LessThan LessThanOrEqual Like ILike ListQuery Literal MultiAlias Multiply NamedArgumentExpression Not Or RLike RangeFrame$ Remainder Rollup
    RowFrame$ ScalarSubquery SortOrder SpecifiedWindowFrame Subtract UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction
    UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedRegex UnresolvedStar UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition
    CreateNamedStruct IsNaN IsTrue IsFalse Between LikeAll LikeAny NotLikeAll NotLikeAny Extract Substring StringTrim StringTrimLeft StringTrimRight StringLocate Overlay Coalesce If First Last AnyValue
    UnresolvedGenerator""".split()
)


class NotReadOnly(ValueError):
    """The statement is not a single query over registered views."""


def _each(items) -> Iterator:
    """The members of a Scala collection."""
    at = items.iterator()
    while at.hasNext():
        yield at.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName()


class _Walk:
    """Goes through everything that a parsed plan is made of, whatever field it stands in."""

    def __init__(self, spark: SparkSession):
        named = spark._jvm.java.lang.Class.forName
        catalyst = "org.apache.spark.sql.catalyst"
        self.plan, self.expression = named(f"{catalyst}.plans.logical.LogicalPlan"), named(f"{catalyst}.expressions.Expression")
        self.many, self.product = named("scala.collection.Iterable"), named("scala.Product")

    def anything(self, x, views: set[str]) -> None:
        if not hasattr(x, "getClass"):
            return  # a number or a text
        if self.plan.isInstance(x):
            self.of_plan(x, views)
        elif self.expression.isInstance(x):
            self.of_expression(x, views)
        elif self.many.isInstance(x):
            for one in _each(x):
                self.anything(one, views)
        elif self.product.isInstance(x):  # options and pairs, as in a map of windows
            self.fields(x, views)

    def fields(self, x, views: set[str]) -> None:
        at = x.productIterator()
        while at.hasNext():
            self.anything(at.next(), views)

    def of_expression(self, e, views: set[str]) -> None:
        kind = _kind(e)
        if kind not in EXPRESSIONS:
            raise NotReadOnly(f"{kind} is no known part of a query that reads")
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = [str(p).lower() for p in _each(e.nameParts() if kind == "UnresolvedFunction" else e.name().nameParts())]
            if len(parts) != 1 or parts[0] not in FUNCTIONS:
                raise NotReadOnly(f"the function {'.'.join(parts)} is not allowed")
        self.fields(e, views)

    def of_plan(self, plan, views: set[str]) -> None:
        kind = _kind(plan).rstrip("$")
        if kind not in NODES:
            raise NotReadOnly(f"{kind} is no part of a query that reads")
        if kind == "UnresolvedWith":
            for pair in _each(plan.cteRelations()):
                name = str(pair._1()).lower()
                if plan.allowRecursion():
                    self.anything(pair._2(), views | {name})
                else:
                    self.anything(pair._2(), views)
                views = views | {name}
            self.anything(plan.child(), views)
            return
        if kind == "UnresolvedRelation":
            # A view has one name; more parts lead to catalogs and files, whatever they are called.
            parts = [str(p).lower() for p in _each(plan.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in views:
                raise NotReadOnly(f"{'.'.join(parts)} is not a registered view")
        if kind == "UnresolvedTableValuedFunction":
            parts = [str(p).lower() for p in _each(plan.name())]
            if len(parts) != 1 or parts[0] not in TABLE_FUNCTIONS:
                raise NotReadOnly(f"the table function {'.'.join(parts)} is not allowed")
        self.fields(plan, views)


def check(spark: SparkSession, sql: str) -> str:
    """The statement without its closing mark; raises where it is no query over registered views."""
    body = sql.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:
        raise NotReadOnly(f"no single statement: {str(e).splitlines()[0]}") from e
    _Walk(spark).anything(plan, {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary})
    return body


def guarded(spark: SparkSession, sql: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` rows of a query and one more, which tells that there are others."""
    return spark.sql(f"SELECT * FROM (\n{check(spark, sql)}\n) LIMIT {int(limit) + 1}")
