"""Planners under changed requests, against plain Python over their plans."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.plans import jobs, retrieve, scenarios
from lodestar.sources import views as V
from tests.conftest import DATA

N = scenarios.N


@pytest.fixture(scope="module")
def setting(spark):
    requests = V.v_request(spark, DATA).where("request_id % 400 = 0")
    places = V.v_place(spark, DATA)
    return requests, places, scenarios.scenario_candidates(requests, places)


def by_run(rows):
    plans = {}
    for r in sorted(rows, key=lambda r: (r.run_id, r.day_no, r.slot)):
        plans.setdefault(r.run_id, []).append((r.day_no, r.poi_id))
    return plans


def jaccard(a, b):
    x, y = {p for _, p in a or []}, {p for _, p in b or []}
    return round(len(x & y) / len(x | y), 4) if x | y else 1.0


@pytest.mark.parametrize("name", ["rule_based", "greedy_eco", "beam"])
def test_gates_and_sensitivity_match_plain_python(spark, setting, name):
    requests, places, cand = setting
    ids = [r.request_id for r in requests.collect()]
    rows = scenarios.scenario_plans(name, cand)
    plans = by_run(rows.collect())
    # one run of all scenarios gives what a run of the requests alone gives
    alone = jobs.PLANNERS[name](retrieve.with_scores(retrieve.retrieve_candidates(requests, places))).select((F.col("request_id") * N).alias("run_id"), "day_no", "slot", "poi_id")
    assert by_run(alone.collect()) == {k: v for k, v in plans.items() if k % N == 0}

    at = lambda r, k: plans.get(r * N + scenarios.SCENARIOS.index(k))
    want = {r: (at(r, "base") != at(r, "budget"), jaccard(at(r, "base"), at(r, "budget")), jaccard(at(r, "culture"), at(r, "beach")) if at(r, "culture") and at(r, "beach") else None, at(r, "base") == at(r, "again")) for r in ids}
    got = {r.request_id: (r.changed, r.budget_overlap, r.interest_overlap, r.repeated) for r in scenarios.sensitivity(rows, requests).collect()}
    assert got == want

    district = {p.poi_id: p.district for p in places.collect()}
    base = [x for r in ids for x in at(r, "base") or []]
    freq = Counter(p for _, p in base)
    counts = sorted([0] * (len(district) - len(freq)) + list(freq.values()))
    n = len(counts)
    overlaps = [w[2] for w in want.values() if w[2] is not None]
    signatures = [tuple(at(r, "base")) for r in ids if at(r, "base")]
    expect = {
        "T1": sum(p not in district for _, p in base),
        "T2": 100 * sum(w[0] for w in want.values()) / len(ids),
        "T3": 100 * sum(overlaps) / len(overlaps) if overlaps else 0,
        "T4": round(100 * len(freq) / len(district), 2),
        "T5": round(sum((2 * i - n - 1) * x for i, x in enumerate(counts, 1)) / (n * sum(counts)), 4),
        "T6": round(100 * len(set(signatures)) / len(signatures), 2),
        "T8": 0,
        "T9": sum(not w[3] for w in want.values()),
        "T10": len({district[p] for p in freq}),
    }
    rows = scenarios.gates(name, cand, requests, places).collect()
    assert {r.gate: r.observed for r in rows} == pytest.approx(expect, abs=1e-4) and expect["T9"] == 0
    for r in rows:
        limit, up = scenarios.GATES[r.gate]
        assert r.threshold == limit and r.passed == (r.observed >= limit if up else r.observed <= limit)


def test_gates_without_requests(spark, setting):
    requests, places, cand = setting
    rows = scenarios.gates("rule_based", cand.limit(0), requests.limit(0), places).collect()
    assert len(rows) == len(scenarios.GATES) and all(r.observed == 0 for r in rows)


def test_slices_give_the_same_and_leave_no_candidates(spark, setting, monkeypatch):
    """Requests in several slices have the gates and the sensitivity of all at once; what a slice wrote is gone, but for plans."""
    from pathlib import Path

    from lodestar.sources import shared

    requests, places, cand = setting
    names = ("rule_based", "greedy_eco")
    want = {tuple(r) for name in names for r in scenarios.gates(name, cand, requests, places).collect()}
    whole = {tuple(r) for r in scenarios.sensitivity(scenarios.scenario_plans("greedy_eco", cand), requests).collect()}
    monkeypatch.setattr(scenarios, "SLICE", max(1, requests.count() // 3))
    folder = Path(shared.shared_dir(spark).removeprefix("file://"))
    before, made, inside = set(folder.iterdir()), [], scenarios.scenario_candidates
    monkeypatch.setattr(scenarios, "scenario_candidates", lambda *a: made.append(inside(*a)) or made[-1])
    plans, fakes = scenarios.plans_in_slices(requests, places, names)
    assert len(made) >= 3 and cand.columns == made[0].columns
    left = [set(spark.read.parquet(str(p)).columns) for p in set(folder.iterdir()) - before]
    assert len(left) == 2 + 3 * len(made) and not [c for c in left if "distance_from_start_km" in c or "_held" in c]
    assert {tuple(r) for r in scenarios.sensitivity(plans["greedy_eco"], requests).collect()} == whole
    assert {tuple(r) for name in names for r in scenarios.gates_of(name, plans[name], fakes, requests, places).collect()} == want
    monkeypatch.undo()
    assert {tuple(r) for r in scenarios.all_gates(requests, places, names).collect()} == want


def test_written_tables_leave_no_shuffles(spark):
    """The files of a shuffle go once its table is written; the session's setting is as before."""
    import time

    from lodestar.sources import shared

    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.endswith(".data")}

    before, set_to = shuffles(), spark.conf.get(shared.SHUFFLES)
    t = shared.materialise(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before and t.count() == 7 and spark.conf.get(shared.SHUFFLES) == set_to
    with pytest.raises(ValueError), shared.passing_tables(spark):
        gone, kept = shared.materialise(spark.range(5)), shared.materialise(spark.range(6), lasting=True)
        raise ValueError
    assert kept.count() == 6
    with pytest.raises(Exception):
        gone.count()
