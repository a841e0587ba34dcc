"""Retrieval in score bands and ranks within requests: the rows of meeting all places, far fewer of them met."""

from pyspark.sql import functions as F

from lodestar.plans import planner, retrieve
from test_widen import by_force, tables


def test_retrieval_meets_bands_only(spark, monkeypatch):
    rows, p, asked, q = tables(spark)
    near, counts, found = retrieve._near, [], []
    for one_pass in (retrieve.ONE_PASS, 0):
        seen = []
        monkeypatch.setattr(retrieve, "ONE_PASS", one_pass)
        monkeypatch.setattr(retrieve, "_near", lambda *a, seen=seen, **k: seen.append(near(*a, **k)) or seen[-1])
        found.append({tuple(r) for r in retrieve.retrieve_candidates(q, p, 10).select("request_id", "poi_id", "rank").collect()})
        counts.append(seen[-1].where("request_id = 1").count())
        monkeypatch.undo()
    assert found[0] == found[1] and {r[0] for r in found[0]} >= {1, 4, 7}
    assert counts[1] < counts[0] * 0.5
    best = sorted((x for x in by_force(rows, asked) if x[0] == 1 and x[2] == 0), key=lambda x: x[3])[:10]
    assert [x[1] for x in best] == [x[1] for x in sorted((x for x in found[1] if x[0] == 1), key=lambda x: x[2])]


def test_cap_and_affordability_deal_candidates_once(spark):
    rows = [(1, f"p{i:02}", 2, 50.0, "d" if i % 3 else "e", "c", float(i % 7) / 7, float(i), 10.0 + i) for i in range(60)]
    c = spark.createDataFrame(rows, "request_id long, poi_id string, n_days int, poi_budget double, district string, category string, utility double, entry_fee_lkr double, distance_from_start_km double")
    plan = retrieve.keep_affordable(retrieve.stratified_cap(c, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    kept = {r["poi_id"]: r["added"] for r in retrieve.keep_affordable(retrieve.stratified_cap(c.withColumn("poi_budget", F.lit(6.0)), 2, 1)).where("keep").collect()}
    assert kept.keys() >= {"p00", "p01", "p02", "p03"} and kept["p01"] and not kept["p00"]


def test_stays_are_met_in_bands(spark, monkeypatch):
    from lodestar.operators import near

    points = spark.range(40).selectExpr("id AS pid", "6.0 + id / 40.0 AS lat", "80.0 + id % 7 / 10.0 AS lon").unionByName(spark.createDataFrame([(99, 50.0, 10.0)], "pid long, lat double, lon double"))
    sites = spark.range(3000).selectExpr("id AS acc_id", "6.0 + id % 97 / 97.0 AS slat", "80.0 + id % 61 / 61.0 AS slon", "CASE WHEN id % 50 > 0 THEN CAST(id * 7 % 31 AS double) END AS good")
    found, met = [], []
    for one_pass in (near.ONE_PASS, 0):
        monkeypatch.setattr(near, "ONE_PASS", one_pass)
        j = near.best_within(points, sites, 25.0, "good", 5)
        met.append(j.count())
        j.createOrReplaceTempView("met_stays")
        found.append(set(map(tuple, spark.sql("SELECT * FROM (SELECT pid, acc_id, row_number() OVER (PARTITION BY pid ORDER BY good DESC, round(km, 4), acc_id) AS rn FROM met_stays) WHERE rn <= 5").collect())))
    assert found[0] == found[1] and len(found[0]) == 200 and met[1] < met[0] * 0.5


def test_pruning_writes_no_pairs(spark, monkeypatch):
    rows = [(1, f"p{i}", 7.0 + (i > 5) * 9 * (i - 5), 80.0, 60) for i in range(8)] + [(2, "alone", 7.0, 80.0, 60), (3, "a", 7.0, 80.0, 500), (3, "b", 7.0, 80.0, 300)]
    c = spark.createDataFrame(rows, "request_id long, poi_id string, lat double, lon double, typical_dwell_min int")
    monkeypatch.setattr(planner, "materialise", lambda df: 1 / 0)
    got = {tuple(r) for r in planner.reach_prune(c).collect()}
    assert got == {(1, s, f"p{i}") for i in range(6) for s in (0, 1)}
    assert planner.reach_prune(c, 1).count() == len(rows)


def test_beam_writes_no_states(spark, monkeypatch):
    rows = [(1, f"p{i:02}", 7.0 + i % 9 / 50, 80.0 + i % 4 / 40, 45, 540, 1020, i % 3 > 0, float(i % 5), i % 11 / 11, 30.0, 2, i % 6 > 0, 7.0, 80.0) for i in range(30)]
    rows += [(2, "none", 7.0, 80.0, 45, 540, 1020, True, 99.0, 0.5, 1.0, 1, True, 7.0, 80.0)]
    names = "request_id long, poi_id string, lat double, lon double, typical_dwell_min int, open_min int, close_min int, hours_estimated boolean, entry_fee_lkr double, utility double, poi_budget double, n_days int, keep boolean, start_lat double, start_lon double"
    monkeypatch.setattr(planner, "materialise", lambda df: 1 / 0)
    got = planner.beam_plan(spark.createDataFrame(rows, names), 7).collect()
    assert len(got) == 7 and {r["request_id"] for r in got} == {1} and all(r["truncated"] for r in got)
    kept = {r[1]: r for r in rows if r[12]}
    for r in got:
        assert len(set(r["stops"])) == len(r["stops"]) == len(r["days"]) and abs(sum(kept[x][8] for x in r["stops"]) - r["spent"]) < 1e-9 and r["spent"] <= 30
    assert [r["value"] for r in sorted(got, key=lambda r: r["rank"])] == sorted((r["value"] for r in got), reverse=True)


def test_beams_of_many_requests_pass_a_task_together(spark):
    names = "request_id long, poi_id string, lat double, lon double, typical_dwell_min int, open_min int, close_min int, hours_estimated boolean, entry_fee_lkr double, utility double, poi_budget double, n_days int, keep boolean, start_lat double, start_lon double"
    rows = [(q, f"p{i:02}", 7.0 + i % 9 / 50, 80.0 + (i + q) % 4 / 40, 45, 540, 1020, i % 3 > 0, float(i % 5), (i * q) % 11 / 11, 9.0 * q, q % 4, (i + q) % 6 > 0, 7.0, 80.0) for q in range(9) for i in range(3 * q)]
    got = planner.beam_plan(spark.createDataFrame(rows, names), 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and plan.count("Exchange hashpartitioning") == 1
    together = {(r.request_id, r["rank"]): tuple(r) for r in got.collect()}
    alone = {(r.request_id, r["rank"]): tuple(r) for q in range(9) for r in planner.beam_plan(spark.createDataFrame([x for x in rows if x[0] == q], names), 4).collect()}
    assert together == alone and {k[0] for k in together} == set(range(1, 9)) and together[4, 1][2] == [] and together[3, 1][2]


def test_first_days_make_no_rows_of_pairs(spark, monkeypatch):
    rows = [(1, f"p{i:02}", 7.0 + i % 9 / 50, 80.0 + i % 4 / 40, 45, 540, 1020, i % 3 > 0, float(i % 5), i % 11 / 11, 9.0, float(i % 7), i % 6 > 0) for i in range(30)]
    rows += [(2, "a", 7.0, 80.0, 60, 540, 1020, True, 1.0, 0.5, 9.0, 0.0, True), (2, "b", 7.0, 80.0, 60, 540, 1020, True, 1.0, 0.5, 9.0, 0.0, True), (2, "c", 7.0, 80.0, 60, 540, 1020, True, 1.0, 0.0, 9.0, 0.0, True)]
    rows += [(3, "alone", 7.0, 80.0, 60, 540, 1020, True, 1.0, 0.5, 9.0, 0.0, True)]
    c = spark.createDataFrame(rows, "request_id long, poi_id string, lat double, lon double, typical_dwell_min int, open_min int, close_min int, hours_estimated boolean, entry_fee_lkr double, utility double, poi_budget double, distance_from_start_km double, keep boolean")
    monkeypatch.setattr(planner, "materialise", lambda df: 1 / 0)
    for days in (planner.best_day_pair(c), planner.best_day(c)):
        plan = days._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Sort" in plan and plan.count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in planner.best_day_pair(c).where("request_id > 1").collect()} == {(2, "a", "b", 1.0)}
    found = [{(r.request_id, tuple(r.stops), r.value) for r in planner.best_day(c, tried).collect()} for tried in (1, 4, 10_000)]
    # a third stop that adds nothing loses to the two that come first in the order of ids
    assert found[0] == found[1] == found[2] and (2, ("a", "b"), 1.0) in found[0] and {r[0] for r in found[0]} == {1, 2}
    assert max(v for k, _, v in found[0] if k == 1) > planner.best_day_pair(c).where("request_id = 1").first().value


def test_retrieval_takes_no_place_below_the_last_band(spark, monkeypatch):
    """Where all requests have enough in the bands above, the places of those below are not dealt out at all."""
    _, p, asked, q = tables(spark)
    near, given = retrieve._near, []
    monkeypatch.setattr(retrieve, "_near", lambda *a, **k: given.append(a[1]) or near(*a, **k))
    ids = [r.request_id for r in retrieve.retrieve_candidates(q, p, 10).groupBy("request_id").count().where("count = 10").collect()]
    q = q.where(F.col("request_id").isin(ids))
    want = {tuple(r) for r in retrieve.retrieve_candidates(q, p, 10).select("request_id", "poi_id", "rank").collect()}
    monkeypatch.setattr(retrieve, "ONE_PASS", 0)
    got = {tuple(r) for r in retrieve.retrieve_candidates(q, p, 10).select("request_id", "poi_id", "rank").collect()}
    assert got == want and ids
    assert given[-1].count() < given[0].count() / 2


def test_requests_that_want_more_bands_are_met_by_themselves(spark, monkeypatch):
    """However many are met apart, the rows are those of meeting all; places of deeper bands are dealt out for these only."""
    _, p, asked, q = tables(spark)
    rows = lambda: {tuple(r) for r in retrieve.retrieve_candidates(q, p, 10).select("request_id", "poi_id", "rank").collect()}
    want = rows()
    near, given = retrieve._near, []
    monkeypatch.setattr(retrieve, "ONE_PASS", 0)
    monkeypatch.setattr(retrieve, "_near", lambda *a, **k: given.append(a) or near(*a, **k))
    for one_in in (1, 2, 64):
        monkeypatch.setattr(retrieve, "STRAGGLERS", one_in)
        del given[:]
        assert rows() == want
        if one_in == 1:
            most, late = given[-2], given[-1]
            assert most[1].count() < late[1].count() / 2 and late[0].count() > 0
            assert not {r.request_id for r in most[0].collect()} & {r.request_id for r in late[0].collect()}
