"""Free SQL over one tenant's ledgers (Q1-Q3).

The reference lets a model write SQL and only asks it, in the prompt, to
filter by user (B11).  Here the text is analysed before it runs, in a session of its own where
no file can be named in FROM, and accepted by what it reads: every leaf of the analysed plan is one of
the tenant's views, a CTE, literal rows or a range, and every function is one of Spark's own that stays
inside the query.  An error, at analysis or at run time, becomes a one-row ``error``
result, as in the reference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook import schemas as S
from tallybook.session import SCALE_CONF, cut_lineage

QUERY_TABLES = ("projects", "labor_costs", "material_costs", "payment_milestones")
NOT_A_QUERY = "only SELECT or WITH queries are run"

# The meanings that the reference's prompt gives to columns, and its relations.
MEANINGS = {
    "projects": {"": "โครงการก่อสร้าง", "name": "ชื่อโครงการ", "client_name": "ชื่อลูกค้า", "contract_value": "มูลค่าสัญญา",
                 "status": "'active'|'completed'|'pending'"},
    "labor_costs": {"": "ค่าแรงช่าง", "worker_name": "ชื่อช่าง", "worker_type": "ประเภทช่าง", "work_days": "วันทำงาน",
                    "daily_rate": "ค่าแรง/วัน", "total_amount": "ยอดรวม", "paid_amount": "จ่ายแล้ว"},
    "material_costs": {"": "ค่าวัสดุ", "item_name": "ชื่อวัสดุ", "quantity": "จำนวน", "unit": "หน่วย", "unit_price": "ราคา/หน่วย",
                       "total_amount": "ยอดรวม", "supplier": "ร้านที่ซื้อ"},
    "payment_milestones": {"": "งวดงาน / รายรับ", "milestone_name": "ชื่องวด", "amount": "มูลค่างวด", "due_date": "กำหนดเก็บเงิน",
                           "received_date": "วันที่รับเงินจริง", "status": "'pending'|'received'"},
}
RELATIONS = {t: f"{t}.project_id = projects.id" for t in QUERY_TABLES[1:]}

# What an analysed query may read besides the tenant's views, and the functions that reach outside of it.
LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}
BARRED = {"CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDTF", "PythonUDAF", "ScalaAggregator", "InputFileName",
          "InputFileBlockStart", "InputFileBlockLength"}
OWN_FUNCTIONS = "org.apache.spark.sql.catalyst."


def schema_text(spark: SparkSession) -> DataFrame:
    """Q1: ``(table_name, column_name, data_type, position, meaning, relation)`` of
    the queryable tables; a table's own meaning is its row with an empty column name."""
    rows = []
    for t in QUERY_TABLES:
        rows.append((t, "", None, -1, MEANINGS[t][""], RELATIONS.get(t)))
        rows += [(t, f.name, f.dataType.simpleString(), i, MEANINGS[t].get(f.name),
                  RELATIONS.get(t) if f.name == "project_id" else None) for i, f in enumerate(S.LEDGERS[t].fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int, "
                                       "meaning string, relation string")


def schema_prompt(spark: SparkSession) -> str:
    """The rows of :func:`schema_text` as the text block of the prompt."""
    lines = []
    for r in sorted(schema_text(spark).collect(), key=lambda r: (QUERY_TABLES.index(r.table_name), r.position)):
        note = f" ({r.meaning})" if r.meaning else ""
        lines.append(f"{r.table_name}{note}" if r.position < 0 else f"  {r.column_name} {r.data_type}{note}")
    return "\n".join([*lines, *(f"Relation: {v}" for v in RELATIONS.values())])


def tenant_views(views: dict[str, DataFrame], user_id) -> dict[str, DataFrame]:
    """Q2: every ledger limited to one user (None: all users, for admin jobs).

    ``user_id`` may be a table with a ``user_id`` column: the ledgers of all its users at once, for a job over many tenants.
    A row without a user belongs to no tenant.
    """
    if user_id is None:
        return dict(views)
    if isinstance(user_id, DataFrame):
        users = user_id.select("user_id")
        return {n: df.join(users, "user_id", "left_semi").select(*df.columns) for n, df in views.items()}
    return {n: df.filter(F.col("user_id") == F.lit(str(user_id))) for n, df in views.items()}


def visible_rows(views: dict[str, DataFrame]) -> DataFrame:
    """``(user_id, table_name, n_rows)``: what each tenant's views hold, for all tenants in one pass."""
    counts = [df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
                .select("user_id", F.lit(name).alias("table_name"), "n_rows") for name, df in views.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.filter(F.col("user_id").isNotNull())


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _sources(plan, views: set[str]) -> Iterator:
    """What an analysed plan reads, CTEs and subqueries included; the tenant's views are not opened."""
    if plan.getClass().getSimpleName() == "View":
        name = plan.desc().identifier()
        if not (plan.isTempView() and name.database().isEmpty() and name.table().lower() in views):
            yield plan
        return
    below = [c for group in (plan.children(), plan.innerChildren(), plan.subqueries()) for c in _items(group) if hasattr(c, "subqueries")]
    if not below and plan.children().isEmpty():
        yield plan
    for child in below:
        yield from _sources(child, views)


def _functions(plan, views: set[str]) -> Iterator:
    """Every expression of an analysed plan outside the tenant's views."""
    if plan.getClass().getSimpleName() == "View":
        return
    waiting = _items(plan.expressions())
    while waiting:
        e = waiting.pop()
        yield e
        waiting += _items(e.children())
    for group in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _items(group):
            if hasattr(child, "subqueries"):
                yield from _functions(child, views)


def analysed(session: SparkSession, sql: str, views) -> tuple[str | None, object]:
    """Why ``sql`` may not run over ``views`` (None when it may), and its analysed plan, which is what runs.

    Only a query is analysed at all.  It is judged by what its names have been resolved to, so it does not matter how a
    name is spelt, hidden by a CTE of another scope, or made by IDENTIFIER().
    """
    state, jvm = session._jsparkSession.sessionState(), session.sparkContext._jvm
    try:
        parsed = state.sqlParser().parseQuery(sql)
    except PySparkException:
        state.sqlParser().parsePlan(sql)    # a statement of another kind, or the syntax error itself
        return NOT_A_QUERY, None
    plan = state.executePlan(parsed, jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).analyzed()
    names = {v.lower() for v in views}
    for leaf in _sources(plan, names):
        if leaf.getClass().getSimpleName().removesuffix("$") not in LEAVES:
            return f"only {', '.join(sorted(views))} may be read", None
    for e in _functions(plan, names):
        kind = e.getClass()
        if kind.getSimpleName() in BARRED or not kind.getName().startswith(OWN_FUNCTIONS):
            return "this function is not allowed", None
    return None, plan


def _error(spark: SparkSession, msg: str) -> DataFrame:
    return spark.createDataFrame([(msg,)], "error string")


def run_sql(spark: SparkSession, sql: str, build_views: Callable[[SparkSession], dict[str, DataFrame]],
            user_id=None) -> DataFrame:
    """Q3: run ``sql`` against the tenant's views; errors become one ``error`` row.

    The result is computed here, into a reliable checkpoint, so that an error of the run itself is caught too.
    """
    session = spark.newSession()
    for key, value in SCALE_CONF.items():
        if not key.startswith("spark.ui."):
            session.conf.set(key, value)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    views = tenant_views(build_views(session), user_id)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        why, plan = analysed(session, sql or "", views)
        if why:
            return _error(session, why)
        rows = session.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan)
        return cut_lineage(DataFrame(rows, session))
    except (PySparkException, Py4JError) as e:
        return _error(session, str(e).split("\n")[0])
