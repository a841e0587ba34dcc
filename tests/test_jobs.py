import pytest
from pyspark.sql import functions as F

from lodestar import queries_plans as QP
from lodestar import queries_places as QL
from lodestar.plans import jobs, retrieve
from lodestar.sources import osm
from lodestar.sources import views as V
from tests.conftest import DATA


def centres(spark):
    return V.v_district(spark, DATA).select(F.col("district_no").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), "district")


def test_dataset_build(spark):
    e = osm.v_osm(spark, DATA)
    got = jobs.build_dataset(e, V.v_segments(spark, DATA), None, centres(spark))
    rows = got.collect()
    assert len(rows) == QL.normalise_pois(spark, DATA).count() == len({r.poi_id for r in rows})
    assert all(r.district and r.district_method == "polygon" and r.open_min is not None and r.typical_dwell_min for r in rows)


def test_district_methods(spark):
    p = V.v_poi(spark, DATA).select("poi_id", "lat", "lon")
    few = V.v_segments(spark, DATA).where("district = 'NATION_1'")
    by_centre = {r.poi_id: r for r in jobs.assign_districts(p, few, None, centres(spark)).collect()}
    voted = jobs.assign_districts(p, None, QL._reference(spark, DATA), centres(spark)).collect()
    assert all(r.district_method == "nearest_centroid" for r in by_centre.values()) and len(voted) == len(by_centre)
    assert all(r.district for r in voted)
    for r in voted:
        if r.district_method == "nearest_centroid_fallback":
            assert r.district == by_centre[r.poi_id].district and r.district_confidence == 0.0


def test_planners_by_name(spark):
    c = QP._cand(spark, DATA)
    plans = jobs.run_planner("rule_based", c)
    assert plans.select("system").distinct().first().system == "rule_based" and plans.count() == QP.rule_based_plan(spark, DATA).count()
    with pytest.raises(KeyError, match="greedy_eco"):
        jobs.run_planner("none", c)


def test_audit_and_csv(spark, tmp_path):
    req, places = V.v_request(spark, DATA), V.v_place(spark, DATA)
    a = jobs.audit(req, QP._cand(spark, DATA), retrieve.widen_candidates(req, places))
    assert a.count() == req.count()
    jobs.write_csv(QP.violation_rates(spark, DATA), str(tmp_path / "v"))
    back = spark.read.option("header", True).csv(str(tmp_path / "v"))
    assert back.columns == ["system", "violation", "pct"] and back.count() == 24


def test_beam_is_a_planner_by_name(spark):
    from lodestar.plans import planner

    cand = QP._cand(spark, DATA).where("request_id % 400 = 0")
    rows = jobs.run_planner("beam", cand).collect()
    best = {r.request_id: r.stops for r in planner.beam_plan(QP._capped(spark, DATA).where("request_id % 400 = 0")).where("rank = 1").collect()}
    plans = {}
    for r in sorted(rows, key=lambda r: (r.request_id, r.day_no, r.slot)):
        plans.setdefault(r.request_id, []).append(r.poi_id)
        assert r.system == "beam" and 0 <= r.slot < 3
    assert plans == {k: v for k, v in best.items() if v} and plans


def test_planner_gates(spark):
    got = {r.gate: r for r in QP.planner_gates(spark, DATA).collect()}
    assert set(got) == {"T2", "T3", "T8", "T9"}
    assert got["T9"].observed == 0 and got["T8"].observed == 0 and got["T3"].observed == 0 and got["T8"].passed
    assert got["T2"].passed == (got["T2"].observed >= 80)


def test_register_reader(spark, tmp_path):
    from lodestar.sources import register

    head = ",".join(register.COLUMNS.values())
    (tmp_path / "a.csv").write_text(f'{head},Extra\n" Sea View ", Homestay ,five,12,6.9,79.8,Galle,X,1\nTwin,Inn,nan,n/a,,80.1,Kandy,Y,2\nTwin,Inn,nan,n/a,,80.1,Kandy,Y,3\n"A ""quoted"" name",Inn,,7.0,6,80,Kandy,,4\n')
    rows = sorted(register.read_register(spark, f"file://{tmp_path}/a.csv").collect(), key=lambda r: (r.name, r.acc_id))
    assert [(r.name, r.sltda_type, r.grade, r.rooms, r.lat) for r in rows] == [('A "quoted" name', "Inn", None, 7, 6.0), ("Sea View", "Homestay", "FIVE", 12, 6.9), ("Twin", "Inn", None, None, None), ("Twin", "Inn", None, None, None)]
    assert len({r.acc_id for r in rows}) == 4
    (tmp_path / "b.csv").write_text("Name,Type\nx,y\n")
    with pytest.raises(ValueError, match="District, Division, Grade"):
        register.read_register(spark, f"file://{tmp_path}/b.csv")


def test_browse_filters_are_optional(spark):
    from lodestar.operators import browse

    p = V.v_place(spark, DATA)
    assert browse.browse_places(p).count() == p.count()
    one = p.first()
    some = browse.browse_places(p, district=one.district, text=one.name[:4].upper()).collect()
    assert one.poi_id in {r.poi_id for r in some} and all(r.district == one.district for r in some)
    assert browse.browse_stays(V.v_stay(spark, DATA)).count() == V.v_stay(spark, DATA).count()
    page = browse.page_of(p.select("poi_id", "prominence"), 1, 7).collect()
    assert len(page) == 7 and not page[0].has_prev and page[0].has_next and page[0].total == p.count()


def test_whole_dataset_by_name(spark):
    e = osm.v_osm(spark, DATA)
    stations = V.v_station(spark, DATA).select("station_id", "lat", "lon")
    views = spark.createDataFrame([(f"T {i}", float(i * i)) for i in range(100)], "title string, mean_views double")
    got = jobs.build_tables(e, V.v_segments(spark, DATA), None, centres(spark), stations, views, V.v_acc(spark, DATA), k=3)
    places = {r.poi_id: r for r in got["places"].collect()}
    assert len(places) == QL.normalise_pois(spark, DATA).count()
    assert all(0 <= r.prominence <= 1 and 0 <= r.rail_access_score <= 1 and r.nearest_station is not None for r in places.values())
    assert {r.popularity_source for r in places.values()} <= {"wikipedia", "none"}
    edges = got["edges"].collect()
    assert edges and all(r.from_id in places and r.to_id in places and r.from_id != r.to_id for r in edges)
    ends = {x for r in edges for x in (r.from_id, r.to_id)}
    assert ends == set(places)
    assert got["stays"].count() == V.v_acc(spark, DATA).count()
    bare = jobs.build_tables(e, V.v_segments(spark, DATA), None, centres(spark), k=1)
    assert set(bare) == {"places", "edges"} and bare["places"].where("popularity_known or rail_access_score <> 0").count() == 0
