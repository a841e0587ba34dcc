"""Known answers of single expressions and operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import queries_plans as QP
from lodestar import queries_places as QL
from lodestar.functions import score, text
from lodestar.functions import tags as T
from lodestar.functions.geo import haversine_km
from lodestar.operators import clean, dedupe, metrics, near, rail
from lodestar.plans import legs, planner
from lodestar.sources import dims, osm
from lodestar.sources import views as V
from lodestar.streaming import jobs
from tests.conftest import DATA


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float, type(None))) else F.lit(v))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "value,want",
    [("24/7", (0, 1440)), ("Mo-Su 08:00-18:00", (480, 1080)), ("06:00-12:00; 14:00-20:30", (360, 1230)), ("18:00-02:00", (1080, 1440)), ("sunrise-sunset", None), ("", None), (None, None), ("25:00-26:00", None)],
)
def test_opening_hours(spark, value, want):
    got = one(spark, T.opening_hours(F.col("v")), v=F.lit(value).cast("string"))
    assert (tuple(got) if got else None) == want


def tags(**kv):
    return F.create_map(*(F.lit(x) for k, v in kv.items() for x in (k.replace("_", ":", 1) if k.startswith(("name_", "fee_")) else k, v)))


@pytest.mark.parametrize("kv,want", [({"charge": "LKR 1,500"}, 1500.0), ({"charge": "USD 10"}, 3000.0), ({"fee": "no"}, 0.0), ({"fee": "yes"}, None), ({"fee_amount": "50"}, 50.0), ({"charge": "1.2.3", "fee": "no"}, 0.0)])
def test_parse_fee(spark, kv, want):
    assert one(spark, T.parse_fee(F.col("t")), t=tags(**kv)) == want


@pytest.mark.parametrize(
    "kv,want",
    [
        ({"boundary": "national_park"}, "wildlife"),
        ({"natural": "beach"}, "beach"),
        ({"historic": "ruins"}, "heritage"),
        ({"amenity": "place_of_worship"}, None),
        ({"amenity": "place_of_worship", "wikidata": "Q1"}, "religious"),
        ({"natural": "wood"}, None),
        ({"natural": "wood", "tourism": "attraction"}, "nature"),
        ({"amenity": "place_of_worship", "tourism": "viewpoint"}, "religious"),
        ({"natural": "wood", "man_made": "tower"}, "urban"),
        ({"shop": "bakery"}, None),
    ],
)
def test_categorise(spark, kv, want):
    assert one(spark, T.categorise(F.col("t")), t=tags(**kv)) == want


def test_names(spark):
    assert one(spark, T.pick_name(F.col("t")), t=tags(name_en=" A ", name="Temple")) == "Temple"
    assert one(spark, T.pick_name(F.col("t")), t=tags(name="ab")) is None
    assert one(spark, T.normalise_name(F.col("n")), n="Fort Hammenhiel கடல்") == "fort hammenhiel"
    assert one(spark, T.wiki_title(F.col("n")), n="en:Old Fort") == "Old_Fort" and one(spark, T.wiki_title(F.col("n")), n="si:x") is None


@pytest.mark.parametrize("name,want", [("Moneragala", "Monaragala"), ("NUWARA-ELIYA", "Nuwara Eliya"), ("Trincom", "Trincomalee"), ("Kandy District", "Kandy"), ("Atlantis", None), ("", None)])
def test_canonical_district(spark, name, want):
    assert one(spark, clean.canonical_district(F.col("n")), n=name) == want


def test_rail_curve_falls(spark):
    df = spark.createDataFrame([(float(k) / 2,) for k in range(130)], "km double").select("km", score.rail_access(F.col("km")).alias("s")).orderBy("km").collect()
    s = [r.s for r in df]
    assert s == sorted(s, reverse=True) and s[0] == s[4] == 1.0 and s[16] == 0.6 and s[50] == 0.0 and s[120] == 0.0


def test_haversine(spark):
    assert one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(2 * math.pi * 6371 / 360)
    assert one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371)


def test_emissions(spark):
    kg = lambda m, km, p, sc="central": one(spark, score.kg_per_traveller(F.lit(m), F.lit(km), F.lit(p), sc))
    assert kg("bus", 10.0, 2) == pytest.approx(0.2717) and kg("tuktuk", 10.0, 4) == pytest.approx(10 * 0.1135 * 2 / 4) and kg("car_shared", 10.0, 1) == pytest.approx(10 * 0.16691 / 4)
    assert kg("boat", 10.0, 1) == 0 and kg("bus", 0.0, 1) == 0
    for m in dims.EMISSIONS:
        assert kg(m, 5.0, 3, "low") <= kg(m, 5.0, 3) <= kg(m, 5.0, 3, "high")


@pytest.mark.parametrize(
    "said,want",
    [
        ("7 days, budget LKR 120,000 for 2 people, temples and safari", (7, 120000.0, 2, ["wildlife", "religious"])),
        ("a weekend for a couple near the beach, 1.5 lakh rs", (2, 150000.0, 2, ["beach"])),
        ("One week alone hiking, budget of about 90k", (7, 90000.0, 1, ["adventure"])),
        ("no idea", (None, None, None, [])),
        (None, (None, None, None, [])),
    ],
)
def test_trip_text(spark, said, want):
    got = one(spark, text.parse_trip_text(F.col("t")), t=F.lit(said).cast("string"))
    assert tuple(got) == want


def test_validate_trip(spark):
    got = one(spark, text.validate_trip(F.lit(99), F.lit(0.0), F.lit(2), F.array(F.lit(" Beach"), F.lit("golf"), F.lit("beach"))))
    assert got.days is None and got.budget_lkr is None and got.party_size == 2 and got.interests == ["beach"]
    assert got.notes == ["days 99 is outside 1-21 and was ignored", "budget must be above zero and was ignored", "unrecognised interests ignored: golf"] and got.missing == ["days", "budget_lkr"]


def test_scores_are_read_from_prose(spark):
    assert one(spark, text.parse_scores(F.lit('Sure:\n```json\n{"scores": {"a": 0.5, "b": 1}}\n``` bye'))) == {"a": 0.5, "b": 1.0}
    assert one(spark, text.parse_scores(F.lit('{"a": 0.25}'))) == {"a": 0.25}
    assert one(spark, text.parse_scores(F.lit("no object"))) is None
    assert one(spark, text.hhmm(F.lit(485))) == "08:05"


def test_gini_counts_the_unused_catalogue(spark):
    counts = spark.createDataFrame([("a", 50)] * 3 + [("b", 5)] * 4, "system string, n long")
    size = spark.createDataFrame([(2245,)], "size long")
    got = {r.system: r.gini for r in metrics.gini(counts, size).collect()}
    xs = np.array([0.0] * 2242 + [50.0] * 3)
    i = np.arange(1, 2246)
    assert got["a"] == round(float(((2 * i - 2246) * xs).sum() / (2245 * xs.sum())), 4) and got["a"] > 0.99
    assert metrics.gini(counts.where("system = 'b'"), spark.createDataFrame([(4,)], "size long")).first().gini == 0.0


def test_k_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(5.9, 9.8, 80), rng.uniform(79.7, 81.9, 80)))]
    crowd = [(1000 + i, 6.0 + i / 1e4, 80.0) for i in range(60)] + [(2000 + i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(5.9, 9.8, 15), rng.uniform(79.7, 81.9, 15)))]
    p = spark.createDataFrame([*pts, (-1, None, 80.0)], "pid long, lat double, lon double")
    s = spark.createDataFrame(crowd, "sid long, slat double, slon double")
    got = {(r.pid, r.rn): r.sid for r in near.k_nearest(p, s, 6).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    for i, a, o in pts:
        want = sorted((km(a, o, x, y), n) for n, x, y in crowd)[:6]
        assert [got[i, r + 1] for r in range(6)] == [n for _, n in want]
    assert len(got) == 6 * len(pts)


def test_dedupe_merges_bilingual_and_keeps_the_richer(spark):
    rows = [("node/1", "Fort Hammenhiel கடல்", 9.69, 79.92, False, False, None), ("way/2", "Fort Hammenhiel", 9.6901, 79.92, True, False, None), ("way/3", "Other Place", 9.69, 79.9201, False, False, None), ("node/4", "கடல்", 9.69, 79.92, False, False, None), ("node/5", "கோட்டை", 9.69, 79.92, False, False, None)]
    df = spark.createDataFrame(rows, "poi_id string, name string, lat double, lon double, hours_parsed boolean, fee_parsed boolean, wikidata string")
    got = {r.poi_id: r.merged for r in dedupe.dedupe_pois(df).collect()}
    assert got == {"way/2": 1, "way/3": 0, "node/4": 0, "node/5": 0}
    assert dedupe.ratio("kandy lake", "kandy lake") == 100.0 and dedupe.ratio("", "") == 0.0 and dedupe.ratio("abc", "abd") == pytest.approx(100 * 4 / 6)
    assert dedupe.dedupe_pois(df.limit(0)).count() == 0


def test_upsert_last_write_wins(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    delta = spark.createDataFrame([("b", 3, 1), ("b", None, 2), ("c", 9, 1)], "id string, v int, seq int")
    assert sorted(map(tuple, clean.upsert(base, delta, "id", "seq").collect())) == [("a", 1), ("b", None), ("c", 9)]


def test_guards(spark):
    with pytest.raises(ValueError, match="google_rating"):
        dims.require_absent(spark.createDataFrame([(1,)], "google_rating int"))
    with pytest.raises(ValueError, match="rooms"):
        dims.require_columns(spark.range(1), {"rooms", "id"})


def test_dump_round_trip(spark, tmp_path):
    path = str(tmp_path / "dump.json")
    (tmp_path / "dump.json").write_text('{"version": 0.6, "generator": "x",\n "elements": [{"type": "node", "id": 1, "lat": 7.0, "lon": 80.0, "tags": {"name": "Lake", "natural": "beach"}}, {"type": "way", "id": 2, "center": {"lat": 1.0, "lon": 80.0}, "tags": {"name": "Far", "natural": "beach"}}]}')
    e = osm.read_dump(spark, path)
    assert {r.poi_id: r.reject_reason for r in clean.examined(e).collect()} == {"node/1": None, "way/2": "out_of_bbox"}
    osm.save_raw(e.withColumn("extract_date", F.lit("2026-01-01")), str(tmp_path / "raw"))
    with pytest.raises(Exception, match="already exists"):
        osm.save_raw(e.withColumn("extract_date", F.lit("2026-01-01")), str(tmp_path / "raw"))


def track(spark):
    return spark.createDataFrame([(1, 2, 10.0, "fast"), (2, 3, 10.0, "slow"), (1, 3, 30.0, "fast"), (8, 9, 1.0, "hill")], "a long, b long, km double, cls string")


def test_rail_paths_are_fastest(spark):
    got = {(r.src, r.node): (round(r.minutes, 3), r.km) for r in rail.rail_paths(track(spark), spark.createDataFrame([(1,), (9,)], "src long")).collect()}
    assert got[1, 3] == (round(30 / 64 * 60, 3), 30.0) and got[1, 2] == (round(10 / 64 * 60, 3), 10.0) and (1, 8) not in got and got[9, 8][1] == 1.0


def test_speed_fit_leaves_one_out(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(5, 60, (8, 2))
    y = x @ [1.25, 2.5] + rng.normal(0, 1, 8)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "trip long, lowland double, hill double, minutes double")
    got = {r.trip: r for r in rail.speed_fit(df, ["lowland", "hill"]).collect()}
    for i in range(8):
        m = np.arange(8) != i
        assert got[i].left_out == pytest.approx(x[i] @ np.linalg.lstsq(x[m], y[m], rcond=None)[0])
        assert got[i].predicted == pytest.approx(x[i] @ np.linalg.lstsq(x, y, rcond=None)[0])


def pool(spark, n=7, days=1, budget=1000.0):
    rng = np.random.default_rng(9)
    rows = [(1, f"p{i}", 7.0 + float(rng.uniform(0, 0.4)), 80.0 + float(rng.uniform(0, 0.4)), int(rng.choice([60, 90, 120])), 480 + 60 * (i % 3), 1080, bool(i % 2), float(rng.uniform(0, 300)), round(float(rng.uniform(0.2, 0.9)), 3), budget, days, 7.1, 80.1, True) for i in range(n)]
    names = "request_id long, poi_id string, lat double, lon double, typical_dwell_min int, open_min int, close_min int, hours_estimated boolean, entry_fee_lkr double, utility double, poi_budget double, n_days int, start_lat double, start_lon double, keep boolean"
    df = spark.createDataFrame(rows, names)
    return rows, df.withColumn("distance_from_start_km", haversine_km("lat", "lon", "start_lat", "start_lon"))


def best_by_force(rows, pick):
    """Best value of a one-day plan of two or three stops, by trying all."""
    import itertools

    def minutes(a, b):
        a, b, c, d = map(math.radians, (*a, *b))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)) * 1.35 / 35 * 60

    best = None
    for k in pick:
        for path in itertools.permutations(rows, k):
            clock, at, value, fee, ok = 480.0, (7.1, 80.1), 0.0, 0.0, True
            for i, r in enumerate(path):
                m = math.ceil(minutes(at, (r[2], r[3])))
                ok &= m <= (240 if i == 0 else 120)
                clock += m + 15
                if not r[7]:
                    clock = max(clock, r[5])
                clock += r[4]
                ok &= clock <= 1080 and (r[7] or clock <= r[6])
                value = round(value + r[9] - m / 60 * 0.12, 6)
                fee += r[8]
                at = (r[2], r[3])
            ok &= all(minutes((a[2], a[3]), (b[2], b[3])) <= 150 for a, b in itertools.combinations(path, 2)) and fee <= rows[0][10]
            if ok and (best is None or value > best):
                best = value
    return best


def test_a_beam_that_never_truncates_is_optimal(spark):
    rows, df = pool(spark)
    got = planner.beam_plan(df, width=10_000).where("rank = 1").first()
    assert not got.truncated and got.value == pytest.approx(best_by_force(rows, (2, 3)))
    assert planner.beam_plan(df, width=3).where("rank = 1").first().truncated
    alts = planner.alternatives(planner.beam_plan(df, width=500), quality=0.1).collect()
    seen = [set(got.stops)]
    for r in sorted(alts, key=lambda r: r.alt):
        assert all(len(s & set(r.stops)) <= len(s) // 2 for s in seen)
        seen.append(set(r.stops))


def test_pruning_never_loses_a_supported_value(spark):
    rows, df = pool(spark, 9)
    far = df.withColumn("lat", F.when(F.col("poi_id") == "p0", 9.5).otherwise(F.col("lat")))
    got = {(r.slot, r.poi_id) for r in planner.reach_prune(far).collect()}
    assert (0, "p0") not in got and got == {(s, f"p{i}") for s in (0, 1) for i in range(1, 9)}


def test_plans_of_the_beam_pass_the_verifier(spark):
    plan = planner.beam_plan(QP._capped(spark, DATA)).where("rank = 1")
    places, req = V.v_place(spark, DATA), V.v_request(spark, DATA)
    # a plan's days are not kept apart in its list, so each request of one day is verified
    one_day = req.where("n_days = 1")
    stops = plan.join(one_day.select("request_id"), "request_id").select(F.col("request_id").alias("run_id"), F.lit(1).alias("day_no"), F.posexplode("stops").alias("slot", "poi_id"))
    runs = one_day.withColumnRenamed("request_id", "run_id").join(stops.select("run_id").distinct(), "run_id")
    no_edges = V.v_edges(spark, DATA).limit(0)
    got = legs.verify_plans(stops, places, runs, no_edges).collect()
    assert got and all(r.feasible for r in got)


def test_streams_equal_batches(spark, tmp_path):
    log = jobs.v_parse_log(spark, DATA)
    jobs.append_log(log, str(tmp_path / "log"))
    stream = jobs.parse_accuracy_windowed(jobs.read_log(spark, str(tmp_path / "log"), stream=True))
    q = stream.writeStream.format("memory").queryName("accuracy").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("accuracy").collect())) == sorted(map(tuple, jobs.parse_accuracy_windowed(log).collect()))

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value").write.parquet(str(tmp_path / "ev"))
    src = spark.readStream.schema("ts timestamp, event_type string, user_id long, value double").parquet(str(tmp_path / "ev"))
    q = jobs.pageviews_daily(src).writeStream.format("memory").queryName("views").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    closed, batch = set(map(tuple, spark.table("views").collect())), set(map(tuple, jobs.pageviews_daily(events).collect()))
    last = max(r[0] for r in batch)
    assert closed <= batch and closed == {r for r in batch if r[0] < last}


def test_empty_inputs(spark):
    r, p = V.v_request(spark, DATA).limit(0), V.v_place(spark, DATA)
    from lodestar.plans import retrieve

    assert retrieve.retrieve_candidates(r, p).count() == 0 and retrieve.widen_candidates(r, p.limit(0)).count() == 0
    assert QL.knn_edges(spark, DATA).where("from_id = to_id").count() == 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0 and {"retrieve_candidates", "verify_plans"} <= set(E.queries())


def test_nearest_is_exact_for_points_anywhere(spark):
    import math
    import random

    from lodestar.operators import near

    rng = random.Random(3)
    sites = [(i, 5.9 + rng.random() * 4, 79.6 + rng.random() * 2.3) for i in range(120)]
    points = [(i, 5.9 + rng.random() * 4, 79.6 + rng.random() * 2.3) for i in range(60)] + [(900, 40.0, 81.0), (901, -60.0, 20.0), (902, 7.0, 170.0), (903, None, 80.0)]

    def km(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(x))

    p, s = spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(sites, "sid long, slat double, slon double")
    got = {}
    for r in near.k_nearest(p, s, 3).collect():
        got.setdefault(r.pid, []).append((r.rn, r.sid))
    for i, a, b in points[:-1]:
        want = sorted((km(a, b, c, d), j) for j, c, d in sites)[:3]
        assert sorted(got[i]) == [(k + 1, j) for k, (_, j) in enumerate(want)], i
    assert 903 not in got
    few = near.k_nearest(p, s.limit(2), 5).groupBy("pid").count().collect()
    assert len(few) == len(points) - 1 and all(r["count"] == 2 for r in few)
    assert near.k_nearest(p, s.limit(0), 2).count() == 0 and near.k_nearest(p.limit(0), s, 2).count() == 0


def test_nearest_polygon_matches_all_sides(spark):
    import math
    import random

    from lodestar.operators import near

    rng = random.Random(6)
    sides = [(f"d{i % 9}", *(x := (79 + rng.random() * 3, 5 + rng.random() * 5)), x[0] + rng.uniform(-0.5, 0.5), x[1] + rng.uniform(-0.5, 0.5)) for i in range(60)]
    points = [(i, 5 + rng.random() * 5, 79 + rng.random() * 3) for i in range(50)] + [(99, 50.0, -3.0)]
    got = {r.pid: r for r in near.nearest_polygon(spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(sides, "district string, ax double, ay double, bx double, by double")).collect()}

    def degrees(lat, lon, ax, ay, bx, by):
        t = max(0.0, min(1.0, ((lon - ax) * (bx - ax) + (lat - ay) * (by - ay)) / max((bx - ax) ** 2 + (by - ay) ** 2, 1e-18)))
        return round(math.hypot(lon - ax - t * (bx - ax), lat - ay - t * (by - ay)), 9)

    for i, lat, lon in points:
        d, name = min((degrees(lat, lon, *s[1:]), s[0]) for s in sides)
        assert got[i].district == name and abs(got[i].degrees - d) < 1e-8


def test_ranks_by_counts_match_sorting(spark):
    import random

    from lodestar.operators import metrics

    rng = random.Random(7)
    rows = [(g, rng.choice([rng.random() * 1e6, 5.0, 5.0, rng.randrange(9)])) for g in "aab" for _ in range(700)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame([(g, float(v) if v is not None else None) for g, v in rows], "g string, v double")
    got = {(r.g, r.p): r.value for r in metrics.nearest_rank(df, "g", "v", [0, 5, 50, 95, 100]).collect()}
    mid = {r.g: r.median for r in metrics.median_of(df, "g", "v").collect()}
    for g in "abc":
        vs = sorted(float(v) for x, v in rows if x == g and v is not None)
        assert [got[g, p] for p in (0, 5, 50, 95, 100)] == [vs[round(p / 100 * (len(vs) - 1))] for p in (0, 5, 50, 95, 100)]
        assert mid[g] == (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2
    assert "d" not in mid


def test_trip_texts(spark):
    from lodestar.functions import text

    cases = {
        "3 days in Ella for 2 people, budget 90k LKR": (3, 90000.0, 2),
        "Rs. 1.5 lakh for a week, solo": (7, 150000.0, 1),
        "We have 120,000 rupees; weekend trip for the two of us": (2, 120000.0, 2),
        "budget of about 2 million, 4-night stay, 3 of us": (4, 2000000.0, 3),
        "my husband and I, 5 day trip, budget is flexible as ever, maybe 10": (5, None, 2),
        "10 pax for 12 nights at 40 thousand rs": (12, 40000.0, 10),
        "nothing here 42": (None, None, None),
        "": (None, None, None),
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", text.parse_trip_text(F.col("t")).alias("p"))
    for r in df.collect():
        assert (r.p.days, r.p.budget_lkr, r.p.party_size) == cases.get(r.t, (None, None, None)), r.t


def test_shared_folder(spark):
    """The setting, else the context's folder, else a temporary one in local mode alone."""
    from types import SimpleNamespace as N

    from lodestar.sources import shared

    def session(setting, given, master):
        folder = N(isDefined=lambda: given is not None, get=lambda: given)
        context = N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: folder)))
        return N(conf=N(get=lambda name, default: setting), sparkContext=context)

    assert shared.shared_dir(session("store://x/y/", None, "spark://a")) == "store://x/y"
    assert shared.shared_dir(session(None, "store://z", "spark://a")) == "store://z"
    assert shared.shared_dir(session(None, None, "local[4]")).startswith("file:")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(session(None, None, "spark://a"))
    assert shared.materialise(spark.range(3)).count() == 3
