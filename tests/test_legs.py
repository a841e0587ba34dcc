"""Legs, clocks and verdicts of runs: stops are dealt by run once, and unknown stops are passed over."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lodestar import queries_plans as QP
from lodestar.plans import legs
from lodestar.sources import views as V


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name, by_place, by_run", [("retime", 2, 2), ("schedule_day", 2, 2), ("plan_json", 2, 2), ("verify_plans", 2, 4)])
def test_stops_are_dealt_by_run_once(spark, no_broadcast, name, by_place, by_run):
    plan = getattr(QP, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    # stops and places; then stops and runs, and for verdicts the measured legs and the runs once more
    assert sum("hashpartitioning(poi_id" in x for x in dealt) == by_place
    assert sum("hashpartitioning(run_id" in x for x in dealt) == by_run
    assert not any("day_no" in x for x in dealt) and "ObjectHashAggregate" not in plan


def test_plans_are_numbered_by_what_shows(spark):
    plan = V.v_plan(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_linenumber" in plan and "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_unknown_stops_have_no_leg(spark):
    at = [("a", 7.0, 80.0), ("b", 7.1, 80.0), ("c", 7.2, 80.0)]
    places = spark.createDataFrame([(i, x, y, 540, 600, i != "c", 10.0, 30) for i, x, y in at], "poi_id string, lat double, lon double, open_min int, close_min int, hours_estimated boolean, entry_fee_lkr double, typical_dwell_min int")
    rows = [(1, 1, 0, "x"), (1, 1, 1, "a"), (1, 1, 2, "y"), (1, 2, 0, "z"), (1, 2, 1, "b"), (1, 2, 2, "b"), (1, 3, 0, "c"), (2, 1, 0, "x"), (9, 1, 0, "a")]
    stops = spark.createDataFrame(rows, "run_id long, day_no int, slot int, poi_id string")
    runs = spark.createDataFrame([(1, 7.0, 79.0, 150.0, 2), (2, 7.0, 80.0, 150.0, 1), (3, 7.0, 80.0, 150.0, 1)], "run_id long, start_lat double, start_lon double, budget double, n_days int")
    edges = spark.createDataFrame([("b", "a", 500.0), ("x", "x", 1.0)], "from_id string, to_id string, duration_min double")
    got = {(r.day_no, r.slot, r.from_id, r.poi_id, r.kind) for r in legs.build_legs(stops, places, runs).collect()}
    assert got == {(1, 1, "__start__", "a", "start"), (2, 1, "a", "b", "overnight"), (2, 2, "b", "b", "between"), (3, 0, "b", "c", "overnight")}
    v = {r.run_id: r for r in legs.verify_plans(stops, places, runs, edges).collect()}
    one = v[1].asDict()
    assert {k: one[k] for k in ("stops", "unknown_poi", "duplicate_poi", "legs_measured", "legs_estimated", "transfer_too_long", "day_overflow", "opening_hours", "too_many_days", "budget_exceeded")} == {
        "stops": 7, "unknown_poi": 3, "duplicate_poi": 1, "legs_measured": 1, "legs_estimated": 3, "transfer_too_long": 2, "day_overflow": 0, "opening_hours": 0, "too_many_days": 1, "budget_exceeded": 1,
    }
    assert v[1].total_cost == 40.0 and set(v) == {1, 2, 3} and v[2].unknown_poi == 1 and v[2].empty_plan == 0 and v[3].empty_plan == 1
    assert legs.schedule_day(stops, places, runs).where("run_id = 1").orderBy("day_no").select(F.collect_list("valid")).first()[0] == [False, True, True]
