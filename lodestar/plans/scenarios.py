"""Planners under changed requests: all variants of all requests are planned in one run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import diversity, plan_jaccard, plan_signature
from ..sources.dims import PROFILES
from ..sources.shared import materialise, passing_tables
from .jobs import PLANNERS
from .retrieve import retrieve_candidates, with_scores

SCENARIOS = ("base", "budget", "culture", "beach", "again")
N = len(SCENARIOS)
SLICE = 1 << 15  # about so many requests have their candidates written at a time
# what planners read of a candidate
CANDIDATE = ["request_id", "poi_id", "lat", "lon", "district", "category", "open_min", "close_min", "hours_estimated", "typical_dwell_min", "entry_fee_lkr", "prominence"]
CANDIDATE += ["n_days", "poi_budget", "start_lat", "start_lon", "distance_from_start_km", "sust", "utility"]
# gate -> threshold, and whether what is observed has to reach it or stay within it
GATES = {"T1": (0.0, False), "T2": (80.0, True), "T3": (30.0, False), "T4": (40.0, True), "T5": (0.60, False), "T6": (90.0, True), "T8": (0.0, False), "T9": (0.0, False), "T10": (10.0, True)}


def scenario_requests(requests: DataFrame) -> DataFrame:
    """Each request once for each scenario, under the number request_id * 5 + its place in ``SCENARIOS``.

    As asked, with twice the budget, with the interests of two profiles that share
    no category, and as asked once more.
    """
    r = requests.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    asked = lambda name: F.array(*map(F.lit, PROFILES[name]))
    interests = F.when(F.col("_k") == 2, asked("culture")).when(F.col("_k") == 3, asked("beach")).otherwise(F.col("interests"))
    budget = F.when(F.col("_k") == 1, F.col("budget") * 2).otherwise(F.col("budget"))
    return r.withColumns({"request_id": F.col("request_id") * N + F.col("_k"), "interests": interests, "budget": budget}).drop("_k")


def scenario_candidates(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Scored candidates of all requests in all scenarios, as ``CANDIDATE``, written once for any number of planners."""
    return materialise(with_scores(retrieve_candidates(scenario_requests(requests), places)).select(*CANDIDATE))


def scenario_plans(name: str, cand: DataFrame) -> DataFrame:
    """(run_id, day_no, slot, poi_id) of a named planner over ``scenario_candidates``; a run is a request in a scenario."""
    return materialise(PLANNERS[name](cand).select(F.col("request_id").alias("run_id"), "day_no", "slot", "poi_id"), lasting=True)


def made_up(cand: DataFrame) -> DataFrame:
    """(asked, passed): how many requests have candidates, and how many of these sets would let a made-up id pass."""
    given = cand.where(F.col("request_id") % N == 0).groupBy("request_id").agg(F.collect_set("poi_id").alias("given"))
    passed = F.size(F.array_except(F.concat("given", F.array(F.lit("made-up"))), "given")) == 0
    return given.agg(F.count("*").alias("asked"), F.count_if(passed).alias("passed"))


def plans_in_slices(requests: DataFrame, places: DataFrame, names: tuple[str, ...]) -> tuple[dict[str, DataFrame], DataFrame]:
    """``scenario_plans`` of each planner over the same candidates, and ``made_up`` of these in parts.

    A request in all scenarios has hundreds of candidates and a plan of a few stops:
    requests pass in slices of about ``SLICE``, and what is written for one is
    deleted before the next, so that disk follows the plans and not the candidates.
    """
    requests, read = materialise(requests), {*CANDIDATE, "popularity_known", "popularity_index"}
    places = materialise(places.select(*(c for c in places.columns if c in read)))  # scored once, not in each slice
    parts = max(1, -(-requests.count() // SLICE))
    found: dict[str, list[DataFrame]] = {name: [] for name in (*names, "")}
    for part in range(parts):
        with passing_tables(requests.sparkSession):
            cand = scenario_candidates(requests.where(F.pmod(F.xxhash64("request_id"), F.lit(parts)) == part), places)
            for name in names:
                found[name].append(scenario_plans(name, cand))
            found[""].append(materialise(made_up(cand), lasting=True))
    whole = {name: reduce(DataFrame.unionByName, of) for name, of in found.items()}
    return whole, whole.pop("")


def _run(k: str) -> Column:
    return F.col("request_id") * N + SCENARIOS.index(k)


def sensitivity(plans: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, changed, budget_overlap, interest_overlap, repeated) of each request.

    changed: whether the plan differs under twice the budget, budget_overlap the
    Jaccard likeness of the places then; interest_overlap that of the plans for the
    two profiles, null unless both have a plan; repeated: whether the plan made
    again is the same.  A request without a plan has an empty one.
    """
    r = requests.select("request_id").distinct()
    sig = materialise(plan_signature(plans))
    of = lambda k: sig.select(F.col("run_id").alias(f"run_{k}"), F.col("signature").alias(k))
    for k in SCENARIOS:
        r = r.withColumn(f"run_{k}", _run(k))
    j = r
    for k in SCENARIOS:
        j = j.join(of(k), f"run_{k}", "left")
    pairs = r.select(F.col("run_base").alias("a"), F.col("run_budget").alias("b")).unionByName(r.select(F.col("run_culture").alias("a"), F.col("run_beach").alias("b")))
    like = materialise(plan_jaccard(plans, pairs))
    j = j.join(like.select(F.col("a").alias("run_base"), F.col("jaccard").alias("budget_overlap")), "run_base", "left")
    j = j.join(like.select(F.col("a").alias("run_culture"), F.col("jaccard").alias("interest_overlap")), "run_culture", "left")
    both = F.col("culture").isNotNull() & F.col("beach").isNotNull()
    return j.select("request_id", (~F.col("base").eqNullSafe(F.col("budget"))).alias("changed"), "budget_overlap", F.when(both, F.col("interest_overlap")).alias("interest_overlap"), F.col("base").eqNullSafe(F.col("again")).alias("repeated"))


def gates(name: str, cand: DataFrame, requests: DataFrame, places: DataFrame) -> DataFrame:
    """``gates_of`` a planner over the candidates of all requests."""
    return gates_of(name, scenario_plans(name, cand), made_up(cand), requests, places)


def gates_of(name: str, plans: DataFrame, fakes: DataFrame, requests: DataFrame, places: DataFrame) -> DataFrame:
    """(system, gate, observed, threshold, passed) of a planner's ``scenario_plans`` and the ``made_up`` of their candidates, one row a gate.

    T1 unknown ids, T4 coverage, T5 Gini, T6 distinct plans and T10 districts are
    over the plans as asked; T2 is the share of requests whose plan changes with
    the budget, T3 the mean overlap of the two profiles' plans, T9 the number of
    plans that a repetition changes; T8 the share of candidate sets that would let
    a made-up id pass.  All but T1, T9 and T10 are in percent, T5 from 0 to 1.
    """
    base = plans.where(F.col("run_id") % N == 0)
    runs = requests.select(_run("base").alias("run_id"), F.lit(name).alias("system"), F.col("request_id").alias("request_key"))
    d = diversity(base, runs, places.select("poi_id", "district"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    shape = d.agg(*(F.max(c).alias(c) for c in ("catalogue_coverage_pct", "gini", "distinct_plan_pct", "districts_covered")))
    shape = shape.select(zero("catalogue_coverage_pct").alias("T4"), zero("gini").alias("T5"), zero("distinct_plan_pct").alias("T6"), zero("districts_covered").alias("T10"))
    unknown = base.join(places.select("poi_id"), "poi_id", "left_anti").agg(F.count("*").cast("double").alias("T1"))
    s = sensitivity(plans, requests)
    moved = s.agg(
        F.coalesce(F.avg(F.when(F.col("changed"), 100.0).otherwise(0.0)), F.lit(0.0)).alias("T2"),
        F.coalesce(F.avg("interest_overlap") * 100, F.lit(0.0)).alias("T3"),
        F.count_if(~F.col("repeated")).cast("double").alias("T9"),
    )
    fake = fakes.agg(F.coalesce(F.try_divide(F.sum("passed") * 100.0, F.sum("asked")), F.lit(0.0)).alias("T8"))
    one = shape.crossJoin(unknown).crossJoin(moved).crossJoin(fake)  # of one row each
    rows = [F.struct(F.lit(g).alias("gate"), F.round(g, 4).alias("observed"), F.lit(t).alias("threshold"), (F.col(g) >= t if up else F.col(g) <= t).alias("passed")) for g, (t, up) in GATES.items()]
    return one.select(F.lit(name).alias("system"), F.explode(F.array(*rows)).alias("r")).select("system", "r.*")


def all_gates(requests: DataFrame, places: DataFrame, names: tuple[str, ...] = tuple(PLANNERS)) -> DataFrame:
    """The gates of several planners over the same candidates."""
    plans, fakes = plans_in_slices(requests, places, names)
    out = None
    for name in names:
        part = gates_of(name, plans[name], fakes, requests, places)
        out = part if out is None else out.unionByName(part)
    return out
