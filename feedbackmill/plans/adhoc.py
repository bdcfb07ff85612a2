"""SQL of the caller over the reviews, read-only and kept to one business."""

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from feedbackmill.operators.aspects import of_reviews
from feedbackmill.operators.dashboard import KEY
from feedbackmill.sinks.store import ReviewStore
from feedbackmill.sources.pages import Selectors, register_page_items

VIEWS = ("reviews", "aspect_sentiments", "review_clusters")
CHART_KINDS = ("line", "bar", "pie")
CONTEXT_ROWS = 50
_CARRIED_CONF = (
    "spark.sql.session.timeZone",
    "spark.sql.shuffle.partitions",
    "spark.sql.adaptive.enabled",
    "spark.sql.ansi.enabled",
)
# Functions that call code by its class name; scoped sessions don't have them.
REFLECTION = ("java_method", "reflect", "try_reflect")
# A name made from a value is looked up while the text is parsed, before its plan can be checked.
_MADE_NAME = re.compile(r"\bidentifier\W*\(", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?\*/|--[^\n]*", re.DOTALL)
# Sources that hold no stored rows.
_OWN_ROWS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnresolvedInlineTable", "ResolvedInlineTable")

Tables = dict[str, DataFrame]


class QueryError(Exception):
    """The SQL text could not be run."""


@dataclass(frozen=True)
class Chart:
    """Rows (x, y) of a result with the wanted kind of chart and its axis labels."""

    points: DataFrame
    kind: str | None
    x_label: str
    y_label: str


@dataclass(frozen=True)
class Answer:
    data: DataFrame
    context: DataFrame
    chart: Chart | None

    def context_rows(self) -> list[Row]:
        return fetch(self.context)


def scoped_session(
    spark: SparkSession, load: Callable[[SparkSession], Tables], key: str | None = None,
    selectors: Selectors = Selectors(),
) -> SparkSession:
    """A session of its own whose only views are the tables from ``load``, cut to one business.

    Its table function ``page_items`` takes the reviews out of a page by ``selectors``.
    """
    child = spark.newSession()
    for name in _CARRIED_CONF:
        child.conf.set(name, spark.conf.get(name))
    # Without this, a query could name a stored file and so leave its business.
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    tables = load(child)
    if key is not None:
        cut = {n: t.where(F.col(KEY) == key) for n, t in tables.items()}
        reviews = cut.pop("reviews")
        tables = {"reviews": reviews, **{n: of_reviews(t, reviews) for n, t in cut.items()}}
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
    register_page_items(child, selectors)
    registry = child._jsparkSession.sessionState().functionRegistry()
    for name in REFLECTION:
        registry.dropFunction(child._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return child


def _sources(plan) -> Iterator[str]:
    """Of an analysed plan and its subqueries: the views it reads by name, and its other sources."""
    kind = plan.nodeName()
    if kind == "View" and plan.isTempView():
        yield f"view {plan.desc().identifier().unquotedString()}"
        return
    inner = [part.apply(i) for part in (plan.children(), plan.subqueries()) for i in range(part.size())]
    if not inner:
        yield kind
    for child in inner:
        yield from _sources(child)


def check_sources(result: DataFrame) -> None:
    """Refuse a query that reads anything but the views of its session and rows of its own."""
    session = result.sparkSession
    views = {f"view {t.name}" for t in session.catalog.listTables() if t.isTemporary}
    for source in _sources(result._jdf.queryExecution().analyzed()):
        if source not in _OWN_ROWS and source not in views:
            raise QueryError(f"not among the tables of this session: {source}")


def store_session(store: ReviewStore, key: str | None = None) -> SparkSession:
    """Scoped session over stored tables; those of one business are read by partition."""
    return scoped_session(
        store.spark,
        lambda session: {n: ReviewStore(session, store.root).read(n, key) for n in VIEWS},
        key,
    )


def run_query(session: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Result of one query, with values for its ``:name`` markers.

    The text has to be a whole statement by itself, so that it can't close the bracket around it; and
    as a subquery, only a single query can be parsed, never a command.
    """
    text = (sql or "").strip().rstrip(";").rstrip()
    if not text:
        raise ValueError("the SQL text is empty")
    if _MADE_NAME.search(_COMMENT.sub(" ", text)):
        raise QueryError("names can't be made from values")
    try:
        session._jsparkSession.sessionState().sqlParser().parsePlan(text)
        result = session.sql(f"SELECT * FROM (\n{text}\n) AS result", args=args)
    except PySparkException as e:
        raise QueryError(str(e)) from e
    check_sources(result)
    return result


def fetch(rows: DataFrame, n: int = CONTEXT_ROWS) -> list[Row]:
    """The first rows of a result; what fails only when it runs arrives as a QueryError, too."""
    try:
        return rows.limit(n).collect()
    except PySparkException as e:
        raise QueryError(str(e)) from e


def chart_axes(result: DataFrame, wanted: bool = True) -> DataFrame | None:
    """First column as x and second as y; None when unwanted, too narrow or empty."""
    if not wanted or len(result.columns) < 2 or result.isEmpty():
        return None
    by_place = result.toDF(*[f"c{i}" for i in range(len(result.columns))])
    return by_place.select(F.col("c0").alias("x"), F.col("c1").alias("y"))


def answer(
    session: SparkSession,
    sql: str,
    needs_graph: bool = False,
    chart_type: str | None = None,
    x_label: str = "",
    y_label: str = "",
    args: dict | None = None,
) -> Answer:
    """Whole result, its first rows for whoever words the answer, and its chart."""
    data = run_query(session, sql, args)
    try:
        points = chart_axes(data, needs_graph)
    except PySparkException as e:
        raise QueryError(str(e)) from e
    kind = chart_type if chart_type in CHART_KINDS else None
    chart = None if points is None else Chart(points, kind, x_label, y_label)
    return Answer(data, data.limit(CONTEXT_ROWS), chart)
