"""Guarded SQL: what a text may read is decided on the nodes of its plan."""

import pytest

from costdocs.operators.guard import run_guarded

ALLOWED = [
    "SELECT * FROM agg_x",
    "SELECT k, sum(id) s FROM agg_x GROUP BY k HAVING sum(id) > 0 ORDER BY s LIMIT 3 OFFSET 0",
    "SELECT a.id FROM agg_x a JOIN agg_y b ON a.id = b.id WHERE a.id IN (SELECT id FROM agg_y) AND EXISTS (SELECT 1 FROM agg_y WHERE agg_y.id = a.id)",
    "SELECT * FROM (WITH q AS (SELECT id FROM agg_x), r AS (SELECT id FROM q) SELECT * FROM r UNION ALL SELECT * FROM q)",
    "SELECT * FROM (WITH q AS (WITH q AS (SELECT id FROM agg_x) SELECT * FROM q) SELECT * FROM q)",
    "SELECT (SELECT max(id) FROM agg_y) m, row_number() OVER w AS n FROM agg_x WINDOW w AS (ORDER BY id)",
    "SELECT id, x FROM agg_x LATERAL VIEW explode(xs) e AS x",
    "SELECT * FROM agg_x, LATERAL (SELECT agg_y.id AS z FROM agg_y WHERE agg_y.id = agg_x.id)",
    "SELECT * FROM VALUES (1), (2) AS t(a)",
    "SELECT DISTINCT k FROM AGG_X",
    "SELECT * FROM agg_x TABLESAMPLE (3 ROWS)",
    "SELECT * FROM range(4)",
    "SELECT * FROM (SELECT k, id FROM agg_x) PIVOT (sum(id) FOR k IN ('k'))",
    "SELECT id FROM agg_x EXCEPT SELECT id FROM agg_y",
    "SELECT /*+ BROADCAST(b) */ a.id FROM agg_x a JOIN agg_y b USING (id)",
    "SELECT * FROM agg_x t(a, b, c)",
    "SELECT 'CTE [callers_view]' AS a FROM agg_x",
]
REFUSED = [
    "SELECT * FROM IDENTIFIER('text.' || '`{file}`')",
    "SELECT * FROM IDENTIFIER('text.`{file}`')",
    "SELECT * FROM IDENTIFIER('callers_' || 'view')",
    "SELECT 'CTE [callers_view]' AS a, t FROM callers_view",
    "SELECT * FROM text.`{file}`",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM agg_x",
    "SELECT (SELECT max(t) FROM callers_view)",
    "SELECT * FROM agg_x WHERE id IN (SELECT id FROM callers_view)",
    "SELECT id FROM agg_x ORDER BY (SELECT max(id) FROM callers_view)",
    "SELECT * FROM (WITH q AS (SELECT * FROM callers_view) SELECT * FROM q)",
    "SELECT * FROM (WITH callers_view AS (SELECT * FROM callers_view) SELECT * FROM callers_view)",
    "SELECT * FROM (WITH q AS (SELECT 1) SELECT * FROM q) JOIN q",
    "SELECT * FROM agg_x, LATERAL (SELECT * FROM callers_view)",
    "SELECT * FROM (TABLE callers_view)",
    "SELECT * FROM agg_x TIMESTAMP AS OF '2020-01-01'",
    "SELECT * FROM STREAM(agg_x)",
    "SELECT * FROM sql_keywords()",
    "SELECT * FROM (WITH RECURSIVE r AS (SELECT 1 UNION ALL SELECT * FROM r) SELECT * FROM r)",
    "SELECT * FROM (SELECT 1) WHERE EXISTS (SELECT * FROM IDENTIFIER('callers_view'))",
    "SELECT * FROM spark_catalog.default.x",
    "SELECT * FROM agg_x |> WHERE id IN (SELECT id FROM callers_view)",
]


@pytest.fixture(scope="module")
def views(spark):
    spark.range(3).selectExpr("id", "'t' AS t").createOrReplaceTempView("callers_view")
    yield {"agg_x": spark.range(5).selectExpr("id", "array(id, id + 1) AS xs", "'k' AS k"), "agg_y": spark.range(3)}
    spark.catalog.dropTempView("callers_view")


@pytest.mark.parametrize("sql", ALLOWED)
def test_a_text_that_reads_the_given_tables_runs(spark, views, sql):
    assert run_guarded(spark, sql, views).count() > 0


@pytest.mark.parametrize("sql", REFUSED)
def test_a_text_that_reads_anything_else_is_refused(spark, views, tmp_path, sql):
    file = tmp_path / "s.txt"
    file.write_text("secret\n")
    with pytest.raises((ValueError, RuntimeError)):
        run_guarded(spark, sql.replace("{file}", str(file)), views).collect()
