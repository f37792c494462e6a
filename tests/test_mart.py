import json
import os

import pytest

from costdocs.operators import guard, rollups
from costdocs.plans import mart, snapshots
from costdocs.plans.ask import ask
from tests.test_cost import item, line_items, rows_of


def items(spark, month, *usages):
    return line_items(spark, *[item(u, billing_ym=month, product_instancetype="ml.m5") for u in usages])


@pytest.fixture
def base(spark, tmp_path):
    path = str(tmp_path / "mart")
    both = items(spark, "202507", "Host", "Studio").unionByName(items(spark, "202508", "Host", "Host", "Train"))
    mart.write_mart(spark, both, path, csv=True)
    return path


def counts(spark, base):
    return {(r["mart_month"], r["table"]): r["rows"] for r in mart.manifest_counts(mart.read_manifest(spark, base)).collect()}


def test_round_trip_and_manifest(spark, base):
    assert [r[0] for r in mart.months(spark, base).collect()] == ["202507", "202508"]
    found = counts(spark, base)
    assert len(found) == 2 * len(rollups.TABLES)
    assert found["202508", "fact_sagemaker_costs"] == 3
    assert found["202508", "agg_endpoint_hours"] == 1
    assert found["202508", "agg_studio_hours"] == 0
    tables = mart.read_mart(spark, base)
    assert rows_of(tables["agg_endpoint_hours"]) == [(None, "ml.m5", 0.0, 3.0)]
    assert rows_of(tables["monthly_summary"]) == [("202508", 3 * 1.5, 3 * 1.5)]
    record = mart.read_manifest(spark, base).first()
    assert record["schema_version"] == "1.0" and record["created_at"]


def test_month_is_read_alone_and_as_text(spark, base):
    plan = mart.read_table(spark, base, "agg_endpoint_hours", "202507")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mart_month" in plan
    assert mart.read_table(spark, base, "agg_endpoint_hours").schema["mart_month"].dataType.typeName() == "string"
    assert mart.read_table(spark, base, "agg_endpoint_hours", "202507").columns == ["resource_id", "instance_type", "hours", "cost"]


def test_csv_twin_is_quoted(spark, base):
    text = spark.read.text(f"{base}/csv/agg_training_cost")
    assert {r[0] for r in text.collect()} == {'"account_id","instance_type","cost","mart_month"', '"","ml.m5","1.5","202508"'}


def test_month_is_replaced_without_leftovers(spark, base):
    mart.write_month(spark, items(spark, "202508", "Studio"), base, "202508")
    found = counts(spark, base)
    assert found["202508", "agg_endpoint_hours"] == 0
    assert found["202508", "agg_studio_hours"] == 1
    assert found["202507", "agg_endpoint_hours"] == 1
    assert mart.read_table(spark, base, "agg_endpoint_hours", "202508").count() == 0


def test_line_items_without_a_month_are_kept_apart(spark, tmp_path):
    base = str(tmp_path / "m")
    mart.write_mart(spark, items(spark, "202508", "Host").unionByName(items(spark, None, "Host", "Train")), base)
    assert [r[0] for r in mart.months(spark, base).collect()] == ["202508"] and mart.resolve_month(spark, base) == "202508"
    found = counts(spark, base)
    assert found[None, "fact_sagemaker_costs"] == 2 and found[None, "monthly_summary"] == 0
    assert {r["mart_month"] for r in mart.mart_total_size(spark, base).collect()} == {None, "202508"}


def test_latest_and_unknown_month(spark, base, tmp_path):
    assert mart.resolve_month(spark, base) == "202508"
    assert mart.resolve_month(spark, base, "2025-07") == "202507"
    for path, month in ((base, "209901"), (str(tmp_path / "none"), "latest")):
        with pytest.raises(FileNotFoundError):
            mart.resolve_month(spark, path, month)
    assert mart.months(spark, str(tmp_path / "none")).count() == 0


def test_sizes_follow_the_files(spark, base):
    files = mart.stored_files(spark, base, "202508").collect()
    assert {f["table"] for f in files} >= {"fact_sagemaker_costs", "monthly_summary"}
    assert all(f["size_bytes"] > 0 and f["mart_month"] == "202508" for f in files)
    total = mart.mart_total_size(spark, base, "202508").first()["total_size_mb"]
    assert total == round(sum(f["size_bytes"] for f in files) / 1048576, 2)


def test_catalog_and_month_info(spark, base):
    tables = mart.read_mart(spark, base)
    first = mart.catalog({"monthly_summary": tables["monthly_summary"]}).orderBy("ordinal").collect()
    assert [tuple(r) for r in first] == [
        ("monthly_summary", 0, "billing_ym", "string"),
        ("monthly_summary", 1, "unblended_cost", "double"),
        ("monthly_summary", 2, "blended_cost", "double"),
    ]
    info = mart.month_info(spark, base)
    assert info["month"] == "202508" and info["file_count"] == len(info["source_files"]) == len(json.loads(info["schema"]))
    assert "agg_studio_hours" not in info["source_files"]
    assert mart.month_info(spark, base, "209901")["file_count"] == 0


def test_ask(spark, base):
    good = ask(spark, "endpoints?", "SELECT instance_type, cost FROM read_parquet('data/processed/latest/agg_endpoint_hours.parquet')", base, debug=True)
    assert not good["error"] and good["row_count"] == 1 and good["column_count"] == 2
    assert good["numeric_summary"]["cost"]["sum"] == 3.0 and good["sample_rows"] == [{"instance_type": "ml.m5", "cost": 3.0}]
    assert good["debug"]["month"] == "202508"
    for sql, month in (("DROP TABLE x", "latest"), ("SELECT nothing FROM monthly_summary", "latest"), ("SELECT 1", "209901")):
        bad = ask(spark, "q", sql, base, month, debug=True)
        assert bad["error"] and bad["row_count"] == 0 and bad["debug"]["error_type"]


@pytest.mark.parametrize(
    "sql, word_ok, text_ok",
    [
        ("SELECT 1;", True, True),
        (" \n select created_at from t", True, False),
        ("SELECT recall FROM t", True, False),
        ("WITH a AS (SELECT 1) SELECT * FROM a", False, False),
        ("SELECT 1; drop table t", False, False),
        ("SELECT 1 FROM copy", False, True),
        ("selection", False, True),
        ("", False, False),
        (None, False, False),
        ("SELECT 1 UNION SELECT 2", True, True),
    ],
)
def test_guards(spark, sql, word_ok, text_ok):
    log = spark.createDataFrame([(sql,)], "sql string")
    assert guard.checked(log, guard.word_guard(log.sql)).first()["ok"] is word_ok
    assert guard.checked(log, guard.substring_guard(log.sql)).first()["ok"] is text_ok


def test_gate_before_running(spark):
    views = {"t": spark.range(3)}
    assert guard.run_guarded(spark, "select max(id) AS m from t;", views).first()["m"] == 2
    for sql in (
        "update t set id = 1",
        "select 1 from t where grant",
        "with a as (select 1) select 1 from a",
        "select transform(id) using 'cat' as (x) from t",
        "select reflect('java.lang.System', 'getProperty', 'user.home')",
    ):
        with pytest.raises(ValueError):
            guard.run_guarded(spark, sql, views)
    with pytest.raises(RuntimeError):
        guard.run_guarded(spark, "select x from missing_table", views)


@pytest.mark.parametrize(
    "text, sql",
    [
        ('{"sql": "SELECT 1"}', "SELECT 1"),
        ('```json\n{"sql": "SELECT 1"}\n```', "SELECT 1"),
        ('{"other": 1}', ""),
        ("Sure: select a\nfrom t; thanks", "select a\nfrom t;"),
        ("SELECT a FROM t  ", "SELECT a FROM t;"),
        ("[1, 2]", None),
        ("nothing here", None),
    ],
)
def test_sql_in_model_text(spark, text, sql):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(guard.extract_sql(df.t)).first()[0] == sql


def test_paths_become_months_and_views(spark):
    df = spark.createDataFrame([("SELECT * FROM read_parquet('data/processed/latest/agg_storage_cost.parquet')",)], "s string")
    row = df.select(guard.month_paths(df.s, "data\\processed\\202508/").alias("m"), guard.table_views(df.s).alias("v")).first()
    assert row["m"] == "SELECT * FROM read_parquet('data/processed/202508/agg_storage_cost.parquet')"
    assert row["v"] == "SELECT * FROM agg_storage_cost"


def test_other_columns_of_the_line_items_are_stored(spark, tmp_path):
    base = str(tmp_path / "m")
    mart.write_month(spark, items(spark, "202507", "Host"), base, "202507")
    more = items(spark, "202508", "Host").drop("usertag9").selectExpr("*", "'x' AS extra")
    mart.write_month(spark, more, base, "202508")
    row = mart.read_mart(spark, base)["fact_sagemaker_costs"].first()
    assert (row["extra"], row["usertag9"], row["is_endpoint"]) == ("x", None, True)
    assert "extra" not in mart.read_mart(spark, base, "202507")["fact_sagemaker_costs"].columns


def test_files_of_other_months(spark, base):
    def cost(month, sql):
        return ask(spark, "q", sql, base, month)["numeric_summary"].get("cost", {}).get("sum")

    sql = "SELECT cost FROM read_parquet('data/processed/{}/agg_endpoint_hours.parquet')"
    assert cost("latest", sql.format("latest")) == cost("latest", sql.format("202508")) == 3.0
    assert cost("latest", sql.format("2025-07")) == cost("2025-07", sql.format("latest")) == 1.5
    assert cost("latest", sql.format("202508") + " UNION ALL " + sql.format("202507")) == 4.5
    assert ask(spark, "q", sql.format("209901"), base)["error"] and ask(spark, "q", sql.replace("agg_endpoint_hours", "nothing").format("202507"), base)["error"]


def test_views_are_private(spark, base, tmp_path):
    spark.range(7).createOrReplaceTempView("agg_endpoint_hours")
    spark.range(7).createOrReplaceTempView("own")
    try:
        new, old = (guard.run_guarded(spark, "SELECT cost FROM agg_endpoint_hours", mart.read_mart(spark, base, m), m) for m in ("202508", "202507"))
        assert (new.first()["cost"], old.first()["cost"]) == (3.0, 1.5)
        assert spark.table("agg_endpoint_hours").count() == 7
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("guarded_")]
        views = mart.read_mart(spark, base)
        path = str(tmp_path / "secret")
        spark.range(3).write.parquet(path)
        for sql in (f"SELECT * FROM parquet.`{path}`", f"SELECT (SELECT max(id) FROM parquet.`{path}`) AS m", f"SELECT * FROM (WITH x AS (SELECT * FROM text.`{path}`) SELECT * FROM x)"):
            with pytest.raises(ValueError):
                guard.run_guarded(spark, sql, views)
        with pytest.raises(RuntimeError):
            guard.run_guarded(spark, "SELECT * FROM own", views)
        assert guard.run_guarded(spark, "SELECT * FROM (WITH x AS (SELECT cost FROM agg_endpoint_hours) SELECT * FROM x)", views).count() == 1
    finally:
        spark.catalog.dropTempView("agg_endpoint_hours")
        spark.catalog.dropTempView("own")


def test_a_question_is_run_once(spark, base):
    record = ask(spark, "q", "SELECT rand() AS `a(b)`, NULL AS n, 1 AS x FROM monthly_summary", base)
    assert not record["error"] and record["row_count"] == 1 and record["column_count"] == 3
    assert record["sample_rows"][0]["a(b)"] == record["numeric_summary"]["a(b)"]["sum"]


def test_extra_columns_of_single_months(spark, tmp_path):
    path = str(tmp_path / "m")
    mart.write_month(spark, items(spark, "202501", "Host"), path, "202501")
    mart.write_month(spark, items(spark, "202502", "Host").selectExpr("*", "'core' AS team", "7 AS size"), path, "202502", csv=True)
    rows = mart.read_table(spark, path, "fact_sagemaker_costs").select("mart_month", "team", "size").collect()
    assert sorted(map(tuple, rows)) == [("202501", None, None), ("202502", "core", 7)]
    assert "team" not in mart.read_table(spark, path, "fact_sagemaker_costs", "202501").columns
    assert mart.read_table(spark, path, "fact_sagemaker_costs", "202502").first()["team"] == "core"
    mart.write_month(spark, items(spark, "202503", "Host").selectExpr("*", "1.5D AS team"), path, "202503")
    with pytest.raises(ValueError, match="two types"):
        mart.read_table(spark, path, "fact_sagemaker_costs")


def test_intermediate_tables_are_removed(spark, base):
    import pyarrow.fs

    from costdocs.sources.scratch import shared_folder

    folder = shared_folder(spark)
    fs, path = pyarrow.fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    listed = lambda: {f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path))}
    before = listed()
    mart.write_month(spark, items(spark, "202509", "Host"), base, "202509")
    ask(spark, "q", "SELECT * FROM monthly_summary", base)
    assert listed() <= before


def broken(*_, **__):
    raise RuntimeError("lost")


@pytest.mark.parametrize("step", ["_write_summaries", "_write_file_list", "_records"])
def test_a_write_that_fails_leaves_the_old_month(spark, base, monkeypatch, step):
    old = {t: rows_of(df) for t, df in mart.read_mart(spark, base, "202508").items()}
    before = counts(spark, base)
    monkeypatch.setattr(mart, step, broken)
    for write in (lambda: mart.write_month(spark, items(spark, "202508", "Studio"), base, "202508"), lambda: mart.write_mart(spark, items(spark, "202509", "Studio"), base)):
        with pytest.raises(RuntimeError, match="lost"):
            write()
        assert {t: rows_of(df) for t, df in mart.read_mart(spark, base).items()} == old
        assert counts(spark, base) == before
    assert len(os.listdir(f"{base}/data")) == 1


def test_two_writers_publish_both_months(spark, base, monkeypatch):
    own, once = snapshots._renamed, []

    def overtaken(session, source, target):
        if not once:  # another writer is done in the meantime
            once.append(target)
            mart.write_month(session, items(session, "202510", "Host"), base, "202510")
        return own(session, source, target)

    monkeypatch.setattr(snapshots, "_renamed", overtaken)
    mart.write_month(spark, items(spark, "202509", "Host"), base, "202509")
    assert [r[0] for r in mart.months(spark, base).collect()] == ["202507", "202508", "202509", "202510"]
    assert {m: mart.read_table(spark, base, "fact_sagemaker_costs", m).count() for m in ("202507", "202508", "202509", "202510")} == {"202507": 2, "202508": 3, "202509": 1, "202510": 1}
    assert not [f for f in os.listdir(f"{base}/manifest") if f.startswith("_")]


def test_versions_that_nobody_names_are_removed(spark, base):
    late = mart.read_mart(spark, base, "202508")["agg_endpoint_hours"]
    mart.write_month(spark, items(spark, "202508", "Studio"), base, "202508")
    assert rows_of(late) == [(None, "ml.m5", 0.0, 3.0)]  # a reader that began before
    for n in (1, 2, 3):
        mart.write_month(spark, items(spark, "202508", *["Host"] * n), base, "202508")
    folders = os.listdir(f"{base}/data")
    assert len(folders) == 3  # of the first write, which has 202507, and of the last two
    assert sorted(map(tuple, mart.read_table(spark, base, "agg_endpoint_hours").select("mart_month", "cost").collect())) == [("202507", 1.5), ("202508", 4.5)]
    assert {(r["mart_month"], r["table"]) for r in mart.stored_files(spark, base).collect()} == {k for k, n in counts(spark, base).items() if n}
    assert {(r["mart_month"], r["name"]) for r in mart.read_manifest_files(spark, base).collect()} == {(r["mart_month"], r["name"]) for r in mart.stored_files(spark, base).collect()}


def test_a_month_without_line_items(spark, tmp_path):
    path = str(tmp_path / "m")
    mart.write_month(spark, items(spark, "202501", "Host").where("false"), path, "202501")
    assert set(counts(spark, path).values()) == {0} and mart.resolve_month(spark, path) == "202501"
    assert all(df.count() == 0 for df in mart.read_mart(spark, path).values())
    mart.write_mart(spark, items(spark, "202501", "Host").where("false"), path)
    assert mart.months(spark, path).count() == 0
