"""Keyed state tables, run tables, documents, and plans that parse and shuffle once."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import prices as P
from tallyforge.sources import state as S
from tallyforge.sources.alerts import decode_budget_alerts, rejected_budget_alerts
from tallyforge.workload.landing import sku_export

COLUMNS = "project_id string, day string, at timestamp, cost double"
AT = datetime(2024, 1, 1, 5, 0, 0, 123456)
SF = "/root/testdata/sf0.001"


def rows(spark, *r):
    return spark.createDataFrame([(p, d, AT, c) for p, d, c in r], COLUMNS)


def got(df):
    return sorted(((r["project_id"], r["day"], r["cost"]) for r in df.collect()), key=str)


@pytest.fixture()
def table(spark, tmp_path):
    return S.StateTable(str(tmp_path / "t"), spark.createDataFrame([], COLUMNS).schema, ("project_id", "day", "at"), "substr(day, 1, 7)")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_replaced_added_and_removed(spark, table, tmp_path):
    assert got(S.load_state(spark, table)) == []
    S.save_state(rows(spark, ("a", "2024-01-01", 1.0), ("a", "2024-02-01", 2.0), (None, "2024-01-02", 3.0), ("b", None, 4.0)), table)
    change = rows(spark, ("a", "2024-01-01", 9.0), (None, "2024-01-02", 5.0), ("b", None, 6.0), ("c", "2024-03-01", 7.0))
    for _ in range(2):      # a replayed save changes nothing
        S.save_state(change, table)
        assert got(S.load_state(spark, table)) == sorted(
            [("a", "2024-01-01", 9.0), ("a", "2024-02-01", 2.0), (None, "2024-01-02", 5.0), ("b", None, 6.0), ("c", "2024-03-01", 7.0)], key=str)
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "rows" / "part=2024-02").iterdir()}
    S.save_state(rows(spark, ("a", "2024-01-01", 0.0), ("c", "2024-03-01", 0.0)), table, removed=F.col("cost") == 0)
    left = sorted([("a", "2024-02-01", 2.0), (None, "2024-01-02", 5.0), ("b", None, 6.0)], key=str)
    assert got(S.load_state(spark, table)) == left
    S.save_state(rows(spark), table)
    assert got(S.load_state(spark, table)) == left
    assert untouched == {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "rows" / "part=2024-02").iterdir()}
    assert got(S.load_state(spark, table, parts=["2024-02"])) == [("a", "2024-02-01", 2.0)]
    assert S.load_state(spark, table).first()["at"].microsecond == 123456


def test_another_session_finds_the_state(spark, table):
    S.save_state(rows(spark, ("a", "2024-01-01", 1.0), ("b", "2024-01-01", 2.0)), table)
    # as after a restart: nothing but the files is known
    spark.sql(f"DROP TABLE {S._rows(spark, table)}")
    spark.sql(f"DROP TABLE {S._changes(spark, table)}")
    assert got(S.load_state(spark, table)) == [("a", "2024-01-01", 1.0), ("b", "2024-01-01", 2.0)]
    S.save_state(rows(spark, ("b", "2024-01-01", 3.0)), table)
    assert got(S.load_state(spark, table)) == [("a", "2024-01-01", 1.0), ("b", "2024-01-01", 3.0)]


def test_changes_join_without_an_exchange(spark, table):
    S.save_state(rows(spark, *[(f"p{i}", "2024-01-01", float(i)) for i in range(50)]), table)
    for df in (S.updated(spark, table, ["2024-01"]), S.load_state(spark, table, {"cost": 0.0})):
        assert "Exchange" not in plan(df)
    joined = plan(S.updated(spark, table, ["2024-01"]))
    assert "SortMergeJoin" in joined and joined.count("Bucketed: true") == 2


def test_runs_are_read_alone(spark, tmp_path):
    path = str(tmp_path / "runs")
    schema = spark.createDataFrame([], COLUMNS).schema
    assert S.read_runs(spark, path, schema).count() == 0
    for cost in (1.0, 2.0):
        S.save_run(rows(spark, ("a", "d", cost)), path, 1)
    S.save_run(rows(spark, ("b", "d", 3.0)), path, 2)
    assert got(S.read_run(spark, path, 1, schema)) == [("a", "d", 2.0)]
    assert sorted(r["version"] for r in S.read_runs(spark, path, schema).collect()) == [1, 2]


def test_documents_are_parsed_once(spark):
    docs = spark.createDataFrame([
        ("bad", "{"), ("none", None), ("empty", "{}"), ("odd", '{"messages": {"2": 5}, "amounts": {"2024-01": "x"}, "budget": "many"}'),
        ("null", '{"messages": null, "amounts": {"2024-01": 1}}')], "project_id string, doc string")
    found = S.upgrade_budget_documents(docs)
    text = optimized(found.where("budget > 1 OR size(amounts) > 0"))
    assert text.lower().count("parse_json(") + text.lower().count("parsejson") == 1 and "from_json" not in text
    at = {r["project_id"]: r for r in found.collect()}
    assert at["bad"]["amounts"] is None and at["none"]["messages"] is None and at["empty"]["amounts"] == {}
    assert at["odd"]["budget"] is None and at["odd"]["messages"] == {"2": "5"} and at["null"]["amounts"] == {"2024-01": 1.0}


def test_messages_are_parsed_once(spark):
    messages = spark.createDataFrame([(1, "e30="), (2, None), (3, "no"), (4, "eyJjb3N0QW1vdW50IjogMX0=")], "message_id long, data string")
    for df in (decode_budget_alerts(messages), rejected_budget_alerts(messages)):
        text = optimized(df)
        assert text.count("from_json") == 1 and text.replace("not base64 text", "").count("base64") == 1
    reasons = {r["message_id"]: r["reason"] for r in rejected_budget_alerts(messages).collect()}
    assert reasons[1] == "not a budget document" and reasons[2] == "not base64 text" and reasons[4].startswith("missing or malformed: project_id")


def test_price_tables_take_one_shuffle(spark):
    export = sku_export(spark, SF)
    found = P.price_rows(export)
    assert plan(found).count("Exchange") == 1 and plan(found).count("FileScan") == 1
    for name in P.TABLES:
        one, alone = P.table_of(found, name), P.pricing(export, name)
        assert one.columns == alone.columns
        assert one.exceptAll(alone).count() == 0 and alone.exceptAll(one).count() == 0
