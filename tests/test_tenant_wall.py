"""Free SQL is accepted by what its names resolve to, not by how they are written."""

import uuid

import pytest

from tallybook.operators import freesql as FS


@pytest.fixture(scope="module")
def secret(spark):
    """A catalog table, a global temporary view and a persistent function of the cluster, none of them the tenant's."""
    name = f"secret_{uuid.uuid4().hex[:8]}"
    spark.sql("SELECT 'other tenant' AS v").createOrReplaceGlobalTempView(name)
    spark.sql(f"CREATE VIEW {name} AS SELECT 'other tenant' AS v")
    yield name
    spark.sql(f"DROP VIEW {name}")
    spark.catalog.dropGlobalTempView(name)


def run(spark, sql):
    views = lambda s: {"projects": s.createDataFrame([("p1", "u1"), ("p2", "u2")], "id string, user_id string")}
    return FS.run_sql(spark, sql, views, user_id="u1")


@pytest.mark.parametrize("sql", [
    "SELECT * FROM {s}", "SELECT * FROM default.{s}", "SELECT * FROM spark_catalog.default.{s}", "SELECT * FROM global_temp.{s}", "TABLE {s}",
    "SELECT * FROM {s} CROSS JOIN (WITH {s} AS (SELECT 1 x) SELECT * FROM {s})",
    "WITH a AS (WITH {s} AS (SELECT 1 x) SELECT * FROM {s}) SELECT * FROM a, {s}",
    "WITH a AS (SELECT * FROM {s}), {s} AS (SELECT 1 x) SELECT * FROM a",
    "WITH projects AS (SELECT * FROM {s}) SELECT * FROM projects",
    "SELECT (SELECT max(v) FROM {s}) FROM projects", "SELECT * FROM projects WHERE EXISTS (SELECT 1 FROM {s})",
    "SELECT * FROM projects WHERE id IN (SELECT v FROM {s})", "SELECT * FROM projects, LATERAL (SELECT * FROM {s})",
    "SELECT id FROM projects UNION SELECT v FROM {s}", "SELECT * FROM IDENTIFIER('{s}')", "SELECT * FROM IDENTIFIER('sec' || substr('{s}', 4))",
    "SELECT max(id) FROM projects HAVING max(id) < (SELECT max(v) FROM {s})", "SELECT id FROM projects ORDER BY (SELECT max(v) FROM {s})",
    "FROM {s} SELECT v", "SELECT * FROM (VALUES (1)) t JOIN {s}", "EXECUTE IMMEDIATE 'SELECT * FROM {s}'",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv')", "SELECT try_reflect('java.lang.System', 'getenv')",
    "SELECT transform(array(1), x -> reflect('java.lang.System', 'getProperty', 'user.dir')) FROM projects", "SELECT input_file_name() FROM projects",
    "SELECT * FROM projects LATERAL VIEW explode(array(java_method('java.lang.System', 'getProperty', 'user.dir'))) t AS x",
    "WITH x AS (SELECT 1) INSERT INTO projects SELECT 1, 2", "DESCRIBE projects", "SET spark.sql.runSQLOnFiles=true", "USE default"])
def test_refused(spark, secret, sql):
    out = run(spark, sql.format(s=secret))
    assert out.columns == ["error"] and out.count() == 1
    assert "other tenant" not in out.first()["error"]


@pytest.mark.parametrize("sql, rows", [
    ("SELECT 'java_method(' AS a, 'reflect(x)' AS b, id FROM projects", [("java_method(", "reflect(x)", "p1")]),
    ("SELECT 'SELECT * FROM {s}' AS q", [("SELECT * FROM {s}",)]),
    ("WITH {s} AS (SELECT id FROM projects) SELECT * FROM {s}", [("p1",)]),
    ("WITH a AS (WITH b AS (SELECT id FROM Projects) SELECT * FROM b) SELECT (SELECT max(id) FROM a) FROM a", [("p1",)]),
    ("SELECT * FROM IDENTIFIER('pro' || 'jects')", [("p1", "u1")]), ("VALUES (1), (2)", [(1,), (2,)]), ("SELECT id FROM range(2) ORDER BY id", [(0,), (1,)]),
    ("SELECT x FROM projects LATERAL VIEW explode(array(1, 2)) t AS x ORDER BY x", [(1,), (2,)]),
    ("SELECT count(*) FROM projects p JOIN projects q USING (id) WHERE p.id IN (SELECT id FROM projects)", [(1,)])])
def test_accepted(spark, secret, sql, rows):
    out = run(spark, sql.format(s=secret)).collect()
    assert [tuple(r) for r in out] == [tuple(x.format(s=secret) if isinstance(x, str) else x for x in r) for r in rows]


def test_views_of_many_users(spark):
    df = spark.createDataFrame([("p1", "u1"), ("p2", "u2"), ("p3", None), ("p4", "u1")], "id string, user_id string")
    users = spark.createDataFrame([("u1",), (None,), ("u9",)], "user_id string")
    assert sorted(r.id for r in FS.tenant_views({"projects": df}, users)["projects"].collect()) == ["p1", "p4"]
