"""Every KPI query a table's columns allow, as one long table; and guarded ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roles import has_token, year_columns
from ..operators import kpi


@dataclass
class Template:
    name: str
    needs: list[str]
    dimensions: list[str]
    build: Callable[[DataFrame], DataFrame]


RETAIL = [
    Template("top_products_revenue", ["category", "total_sales", "unit_price", "discount_percent"],
             ["product_category"], kpi.top_categories),
    Template("monthly_sales_mom_growth", ["order_date", "total_sales"], ["order_month"], kpi.monthly_mom),
    Template("regional_contribution_share", ["region", "total_sales"], ["sales_region"], kpi.region_share),
    Template("customer_rfm_ranking", ["customer_id", "total_sales"], ["customer_id"], kpi.customer_rank),
    Template("payment_method_aov", ["payment_method", "total_sales", "customer_satisfaction"], ["payment_type"],
             kpi.payment_mix),
    Template("high_value_transaction_outliers",
             ["order_id", "customer_id", "order_date", "category", "region", "total_sales", "quantity", "unit_price"],
             [], None),
]


def templates(df: DataFrame, order_key: list[str] | None = None, target: str | None = None,
              dims: list[str] | None = None) -> list[Template]:
    """The templates for this kind of table: yearly columns make it demographic, else retail."""
    found: list[Template] = []
    if target and dims:
        name = "_".join(target.lower().replace("/", " ").split())
        found.append(Template("target_metric_decomposition", [target, *dims], dims,
                              lambda d: kpi.metric_by_dims(d, target, dims).withColumnRenamed(f"total_{name}", "total")))
    years = year_columns(df)
    if years:
        latest = years[-1][1]
        entity = next((c for c in df.columns if has_token(c, "country", "territory", "nation")), None)
        group = next((c for c in df.columns if has_token(c, "continent", "region")), None)
        projected = next((c for c in df.columns if has_token(c, "projected") and not has_token(c, "growth")), None)
        rate = next((c for c in df.columns if has_token(c, "growth", "cagr") and not has_token(c, "projected")), None)
        found.append(Template("demographic_top_nations", [entity or "country", latest], ["country"],
                              lambda d: kpi.top_entities(d, entity, latest, None, projected)))
        found.append(Template("demographic_continent_rollup", [group or "continent", latest], ["continent"],
                              lambda d: kpi.group_rollup(d, group, latest, projected)))
        found.append(Template("demographic_growth_leaders", [entity or "country", rate or "growth"], ["country"],
                              lambda d: kpi.growth_leaders(d, entity, rate)))
        return found
    for t in RETAIL:
        if t.build is None:
            key = order_key or ["order_id"]

            def outliers(d: DataFrame) -> DataFrame:
                rows = kpi.high_value_orders(d, key=key)
                return rows.select(F.concat_ws("-", *key).alias("order_ref"), "total_sales", "quantity", "unit_price",
                                   "sales_percentile")

            t = Template(t.name, [*t.needs, *key], ["order_ref"], outliers)
        found.append(t)
    return found


def _missing(df: DataFrame, t: Template) -> list[str]:
    have = {c.lower() for c in df.columns}
    return sorted({n for n in t.needs if n.lower() not in have})


def skipped(df: DataFrame, **options) -> list[tuple[str, str]]:
    """(template, reason) of the templates the columns do not allow."""
    return [(t.name, "missing: " + ", ".join(m)) for t in templates(df, **options) if (m := _missing(df, t))]


def kpi_suite(df: DataFrame, **options) -> DataFrame:
    """All possible templates as rows (template, dimension, measure, value).

    Several queries read the same table: pass a materialised one.
    """
    parts = []
    for t in templates(df, **options):
        if _missing(df, t):
            continue
        result = t.build(df)
        dims = [F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("null")) for d in t.dimensions]
        measures = [c for c in result.columns if c not in t.dimensions]
        wide = result.select(
            F.lit(t.name).alias("template"), F.concat_ws(" | ", *dims).alias("dimension"),
            *[F.col(f"`{m}`").cast("double").alias(m) for m in measures],
        )
        parts.append(wide.unpivot(["template", "dimension"], measures, "measure", "value"))
    if not parts:
        raise ValueError("no template fits the columns of this table")
    return reduce(lambda a, b: a.unionByName(b), parts)


#: functions that run any Java method, and plan nodes that write, change the session or start a program
_JAVA_CALLS = {"reflect", "try_reflect", "java_method"}
_REFUSED = ["Command", "ParsedStatement", "ScriptTransformation"]


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_plan(spark: SparkSession, statement: str) -> None:
    """Refuses a statement unless Spark's parser reads it as one query over registered views.

    Every plan in it is looked at: children, WITH definitions and the plans inside expressions. A table must be a
    temporary view or a WITH name, of one part: files and other catalogs have more. Functions that call Java and
    programs that transform rows are refused by their place in the plan, so no spelling hides them.
    """
    jvm, state = spark.sparkContext._jvm, spark._jsparkSession.sessionState()
    find = jvm.java.lang.Class.forName
    base = "org.apache.spark.sql.catalyst."
    refused = [find(f"{base}plans.logical.{n}") for n in _REFUSED]
    inner, relation, called, defined = (find(base + n) for n in (
        "expressions.PlanExpression", "analysis.UnresolvedRelation", "analysis.UnresolvedFunction", "plans.logical.UnresolvedWith"
    ))
    try:
        open_ = [state.sqlParser().parsePlan(statement)]
    except Exception as e:
        if "ParseException" not in type(e).__name__ and "ParseException" not in str(e):
            raise
        raise PermissionError("not one statement that Spark can read") from e
    tables, names = [], set()
    while open_:
        node = open_.pop()
        if any(kind.isInstance(node) for kind in refused):
            raise PermissionError("only queries that read are allowed")
        if relation.isInstance(node):
            tables.append(_list(node.multipartIdentifier()))
        if defined.isInstance(node):
            for each in _list(node.cteRelations()):
                names.add(each._1().lower())
                open_.append(each._2())
        open_ += _list(node.children())
        expressions = _list(node.expressions())
        while expressions:
            e = expressions.pop()
            if inner.isInstance(e):
                open_.append(e.plan())
            if called.isInstance(e) and _list(e.nameParts())[-1].lower() in _JAVA_CALLS:
                raise PermissionError("functions that call Java are not allowed")
            expressions += _list(e.children())
    for parts in tables:
        if len(parts) > 1 or not (parts[0].lower() in names or state.catalog().getTempView(parts[0]).isDefined()):
            raise PermissionError(f"not a registered view: {'.'.join(parts)}")


def sql_readonly(spark: SparkSession, statement: str, limit: int = 500) -> DataFrame:
    """A reading query over the registered views, never more than ``limit`` rows."""
    check_plan(spark, statement)
    return spark.sql(statement).limit(limit)
