"""Queries over requests, plans, tracks, texts and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import score, text
from .operators import metrics, rail
from .plans import legs, planner, retrieve, scenarios
from .sources import views as V
from .sources.dims import BUDGETS, DURATIONS, PROFILES
from .sources.shared import materialise
from .streaming import jobs


def _requests(s, d):
    return V.v_request(s, d)


def _cand(s, d):
    return retrieve.with_scores(retrieve.retrieve_candidates(_requests(s, d), V.v_place(s, d)))


def _capped(s, d):
    return retrieve.keep_affordable(retrieve.stratified_cap(_cand(s, d)))


def _stops(s, d):
    return V.v_plan(s, d)


def _verdicts(s, d):
    return legs.verify_plans(_stops(s, d), V.v_place(s, d), V.v_run(s, d), V.v_edges(s, d))


def retrieve_candidates(s, d):
    return retrieve.retrieve_candidates(_requests(s, d), V.v_place(s, d)).select("request_id", "rank", "poi_id", "category", "prominence", "retrieval_score", F.round("distance_from_start_km", 3).alias("distance_km"))


def widen_candidates(s, d):
    return retrieve.widen_candidates(_requests(s, d), V.v_place(s, d))


def retrieval_diag(s, d):
    c = _cand(s, d)
    known = F.when(F.col("popularity_known"), F.col("popularity_index"))
    return c.groupBy("request_id").agg(
        F.count("*").alias("n"), F.countDistinct("category").alias("categories"), F.countDistinct("district").alias("districts"), score.half_up(F.avg("prominence"), 5).alias("mean_prominence"),
        F.round(F.count(known) * 100.0 / F.count("*"), 1).alias("known_pct"), score.half_up(F.coalesce(F.avg(known), F.lit(0.0)), 5).alias("mean_popularity"),
    )


def induced_edges(s, d):
    """Edges with both ends among a request's candidates, and their share of all pairs."""
    c = _cand(s, d).select("request_id", "poi_id")
    n = c.groupBy("request_id").agg(F.count("*").alias("n"))
    e = V.v_edges(s, d).select("from_id", "to_id")
    inside = c.withColumnRenamed("poi_id", "from_id").join(e, "from_id").join(c.withColumnRenamed("poi_id", "to_id"), ["request_id", "to_id"]).groupBy("request_id").agg(F.count("*").alias("edges"))
    j = n.join(inside, "request_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("long"))
    return j.select("request_id", "n", "edges", F.round(F.col("edges") * 200.0 / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)), 4).alias("pair_pct"))


def travel_lookup(s, d):
    l = legs.measured_minutes(legs.build_legs(_stops(s, d), V.v_place(s, d), V.v_run(s, d)), V.v_edges(s, d))
    return l.groupBy("measured").agg(F.count("*").alias("legs"), F.round(F.sum("minutes"), 2).alias("minutes"))


def _scores(s, d):
    """Long score table with an invented, an omitted and an out-of-range score for some requests."""
    c = _cand(s, d).select("request_id", "poi_id", F.col("pref").alias("score"), "rank")
    bad = F.col("request_id") % 300 == 0
    good = c.where(~(bad & (F.col("rank") == 2))).withColumn("score", F.when(bad & (F.col("rank") == 1), 1.4).otherwise(F.col("score")))
    fake = c.where(bad & (F.col("rank") == 3)).withColumn("poi_id", F.lit("sigiriya"))
    return good.unionByName(fake).select("request_id", "poi_id", "score")


def score_contract(s, d):
    """Invented, omitted and out-of-range ids of each request's scores."""
    c = _cand(s, d).select("request_id", "poi_id", F.lit(True).alias("given"))
    j = c.join(_scores(s, d), ["request_id", "poi_id"], "full_outer")
    return j.groupBy("request_id").agg(F.count_if(F.col("given").isNull()).alias("invented"), F.count_if(F.col("score").isNull()).alias("omitted"), F.count_if(~F.col("score").between(0, 1)).alias("out_of_range"))


def score_with_fallback(s, d):
    """Scores of a pluggable scorer where they keep the contract, else the heuristic's."""
    c = _cand(s, d)

    def answers(prompts):  # stands for a model: every third request gets a broken answer
        return prompts.map(lambda p: "no answer" if int(p.split("|")[0]) % 300 == 0 else "```json\n{\"scores\": {" + ", ".join(f'"{i}": 0.5' for i in p.split("|")[1].split(",")) + "}}\n```")

    g = c.groupBy("request_id").agg(F.sort_array(F.collect_list("poi_id")).alias("ids"))
    scorer = F.pandas_udf(answers, "string")
    g = g.withColumn("scores", text.parse_scores(scorer(F.concat_ws("|", F.col("request_id").cast("string"), F.array_join("ids", ",")))))
    ok = F.coalesce((F.sort_array(F.map_keys("scores")) == F.col("ids")) & F.forall(F.map_values("scores"), lambda x: x.between(0, 1)), F.lit(False))
    j = c.select("request_id", "poi_id", "pref").join(g.withColumn("used_llm", ok), "request_id")
    return j.select("request_id", "poi_id", F.when(F.col("used_llm"), F.element_at("scores", F.col("poi_id"))).otherwise(F.col("pref")).alias("score"), "used_llm")


def parse_scores(s, d):
    """Scores read back from answers with fences and prose around them."""
    item = F.concat(F.lit('"'), F.col("poi_id"), F.lit('": '), F.col("pref").cast("string"))
    g = _cand(s, d).where("rank <= 3").groupBy("request_id").agg(F.array_join(F.sort_array(F.collect_list(item)), ", ").alias("body"))
    answer = F.concat(F.lit("Here it is:\n```json\n{\"scores\": {"), F.col("body"), F.lit("}}\n```\nDone."))
    return g.select("request_id", F.explode(text.parse_scores(answer)).alias("poi_id", "score"))


def score_payload(s, d):
    """Candidates in batches of twenty as JSON, without names and districts."""
    p = F.struct(F.col("poi_id").alias("id"), "category", F.round("entry_fee_lkr").cast("long").alias("entry_fee_lkr"), F.col("typical_dwell_min").alias("typical_visit_minutes"))
    b = _cand(s, d).select("request_id", F.floor((F.col("rank") - 1) / 20).alias("batch"), F.struct("rank", p.alias("p")).alias("x"))
    g = b.groupBy("request_id", "batch").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return g.select("request_id", "batch", F.size("xs").cast("long").alias("n"), F.to_json(F.transform("xs", lambda x: x["p"])).alias("payload"))


def unknown_ids(s, d):
    p = _stops(s, d).withColumn("poi_id", F.when((F.col("run_id") % 50 == 0) & (F.col("slot") == 0), F.concat(F.lit("x/"), F.col("poi_id"))).otherwise(F.col("poi_id")))
    return p.join(V.v_place(s, d), "poi_id", "left_anti").select("run_id", "day_no", "slot", "poi_id")


def heuristic_preference(s, d):
    return _cand(s, d).select("request_id", "poi_id", "pref")


def utility(s, d):
    return _cand(s, d).select("request_id", "poi_id", F.round("utility", 4).alias("utility"))


def request_budgets(s, d):
    return _requests(s, d).select("request_id", F.round(1 - F.col("w_pref"), 4).alias("w_sust"), score.half_up(F.col("budget") * 0.20, 3).alias("poi_budget"), score.half_up(F.col("budget") * 0.45, 3).alias("lodging_budget"))


def unary_feasible(s, d):
    from .operators.clean import unary_feasible as check

    c = check(_cand(s, d))
    return c.groupBy("request_id").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("dropped"), F.count_if("hours_imputed").alias("hours_imputed"))


def keep_nearest(s, d):
    return retrieve.keep_nearest(_cand(s, d)).select("request_id", F.col("near_rank").alias("near_rank"), "poi_id")


def stratified_cap(s, d):
    return retrieve.stratified_cap(_cand(s, d)).select("request_id", "poi_id", "cap_rank", "keep")


def cheapest_total(s, d):
    return retrieve.cheapest_total(_cand(s, d)).select("request_id", F.round("total", 2).alias("total"))


def keep_affordable(s, d):
    return _capped(s, d).groupBy("request_id").agg(F.count_if("keep").alias("kept"), F.count_if("added").alias("added"))


def reach_prune(s, d):
    return planner.reach_prune(_capped(s, d).where("keep"))


def domain_reduction(s, d):
    cap = materialise(_capped(s, d).select("request_id", "poi_id", "lat", "lon", "typical_dwell_min", "keep"))
    before = cap.groupBy("request_id").agg(F.count("*").alias("before"), F.nullif(F.count_if("keep"), F.lit(0)).alias("capped"))
    after = planner.reach_prune(cap).where("slot = 0").groupBy("request_id").agg(F.count("*").alias("after"))
    j = before.join(after, "request_id", "left")
    a, k = F.coalesce("after", F.lit(0)), F.least(F.coalesce("capped", F.lit(0)), F.coalesce("after", F.lit(0)))
    pct = lambda x, y: F.when(y > 0, F.round((y - x) * 100.0 / y, 2)).otherwise(0.0)
    return j.select("request_id", pct(a, F.col("before")).alias("domain_reduction_pct"), pct(k, a).alias("cap_reduction_pct"))


def best_day_pair(s, d):
    return planner.best_day_pair(_capped(s, d))


def best_day(s, d):
    return planner.best_day(_capped(s, d)).select("request_id", F.array_join("stops", ",").alias("stops"), "value")


def beam_plan(s, d):
    p = planner.beam_plan(_capped(s, d)).where("rank = 1")
    return p.select("request_id", F.array_join("stops", ",").alias("stops"), "value", "spent", "truncated")


def alternatives(s, d):
    a = planner.alternatives(planner.beam_plan(_capped(s, d)))
    return a.select("request_id", "alt", F.array_join("stops", ",").alias("stops"), "value")


def conflicts(s, d):
    cap = materialise(_capped(s, d).select(*planner.DAY, "keep"))
    return planner.conflicts(_requests(s, d), cap, planner.reach_prune(cap.where("keep")), planner.best_day_pair(cap))


def rule_based_plan(s, d):
    return planner.rule_based(_cand(s, d))


def greedy_eco_plan(s, d):
    return planner.greedy_eco(_cand(s, d))


def sensitivity(s, d):
    """Baseline plans under the budget and twice the budget: changed, and the overlap of their places."""
    c = _cand(s, d).withColumn("poi_budget", F.col("poi_budget") * 0.3)
    a = planner.rule_based(c)
    b = planner.rule_based(c.withColumn("poi_budget", F.col("poi_budget") * 2))
    both = a.withColumnRenamed("request_id", "run_id").select("run_id", "day_no", "slot", "poi_id")
    other = b.select((-F.col("request_id") - 1).alias("run_id"), "day_no", "slot", "poi_id")
    pairs = c.select(F.col("request_id").alias("a")).distinct().withColumn("b", -F.col("a") - 1)
    sig = metrics.plan_signature(both.unionByName(other))
    j = metrics.plan_jaccard(both.unionByName(other), pairs).join(sig.withColumnsRenamed({"run_id": "a", "signature": "sa"}), "a", "left").join(sig.withColumnsRenamed({"run_id": "b", "signature": "sb"}), "b", "left")
    return j.select(F.col("a").alias("request_id"), (~F.col("sa").eqNullSafe(F.col("sb"))).alias("changed"), "jaccard")


def mmr_utility(s, d):
    """Utility less the penalty for likeness to a request's three best candidates."""
    c = _cand(s, d)
    w = Window.partitionBy("request_id").orderBy(F.desc("utility"), "poi_id")
    c = c.withColumn("rn", F.row_number().over(w))
    c = c.withColumn("chosen", F.collect_list(F.when(F.col("rn") <= 3, F.struct("district", "category", "poi_id"))).over(Window.partitionBy("request_id")))
    alike = lambda x: F.when((x["district"] == F.col("district")) & (x["category"] == F.col("category")), 1.0).when(x["district"] == F.col("district"), 0.6).when(x["category"] == F.col("category"), 0.4).otherwise(0.0)
    worst = F.coalesce(F.array_max(F.transform(F.filter("chosen", lambda x: x["poi_id"] != F.col("poi_id")), alike)), F.lit(0.0))
    return c.select("request_id", "poi_id", score.half_up(F.col("utility") - worst * F.col("utility") * 0.3, 4).alias("mmr"))


def kg_per_traveller(s, d):
    k = F.col("k")
    p = V.v_poi(s, d).select("poi_id", V.pick(["walk", "train", "bus", "tuktuk", "car_private", "car_shared", "boat"], k % 7).alias("mode"), ((k * 13 % 900) / F.lit(10.0)).alias("km"), (k % 6 + 1).alias("party"))
    return p.select("poi_id", *(score.half_up(score.kg_per_traveller(F.col("mode"), F.col("km"), F.col("party"), sc), 6).alias(sc) for sc in ("low", "central", "high")))


def estimated_mode(s, d):
    return V.v_poi(s, d).select("poi_id", score.estimated_mode((F.col("k") * 7 % 1000) / F.lit(10.0)).alias("mode"))


def trip_score(s, d):
    k = F.col("k")
    kg = (k * 17 % 600) / F.lit(10.0)
    return V.v_poi(s, d).select("poi_id", score.journey_score(kg).alias("journey"), score.trip_sustainability((k % 101) / F.lit(100.0), kg).alias("trip"))


def plan_leg(s, d):
    km = (F.col("k") * 7 % 1500) / F.lit(10.0)
    l = V.v_poi(s, d).select("poi_id", legs.plan_leg(km).alias("l"))
    return l.select("poi_id", "l.mode", "l.minutes", "l.km")


def build_legs(s, d):
    l = legs.build_legs(_stops(s, d), V.v_place(s, d), V.v_run(s, d))
    return l.select("run_id", "day_no", "slot", "from_id", "poi_id", "kind", F.round("km", 3).alias("km"))


def retime(s, d):
    return legs.retime(_stops(s, d), V.v_place(s, d), V.v_run(s, d))


def schedule_day(s, d):
    return legs.schedule_day(_stops(s, d), V.v_place(s, d), V.v_run(s, d))


def verify_plans(s, d):
    return _verdicts(s, d)


def trip_emissions(s, d):
    return legs.trip_emissions(_stops(s, d), V.v_place(s, d), V.v_run(s, d))


def emissions_summary(s, d):
    r = V.v_run(s, d)
    return legs.emissions_summary(legs.travelled(legs.build_legs(_stops(s, d), V.v_place(s, d), r), r), r)


def lodging_candidates(s, d):
    return legs.lodging_candidates(_stops(s, d), V.v_place(s, d), V.v_stay(s, d), limit=3).select("run_id", "night", "rn", "acc_id", "km")


def choose_lodging(s, d):
    r = V.v_run(s, d)
    st = _stops(s, d)
    c = legs.lodging_candidates(st, V.v_place(s, d), V.v_stay(s, d))
    end = st.groupBy("run_id").agg(F.max("day_no").alias("last"))
    nights = end.where("last > 1").select("run_id", F.explode(F.sequence(F.lit(1), F.col("last") - 1)).alias("night"))
    out = legs.choose_lodging(c, nights, r.select("run_id", (F.col("budget") * 0.45).alias("lodging_budget")))
    return out.groupBy("run_id").agg(F.count("*").alias("nights"), F.count("acc_id").alias("assigned"), F.round(F.coalesce(F.sum("rate"), F.lit(0.0)), 0).alias("total"))


def _totals(s, d):
    """Means of preference and sustainability of each run, and its utility."""
    p = V.v_place(s, d).select("poi_id", "prominence", score.place_sustainability().alias("sust"))
    t = _stops(s, d).join(p, "poi_id").groupBy("run_id").agg(score.half_up(F.avg("prominence"), 4).alias("s_pref"), score.half_up(F.avg("sust"), 4).alias("s_sust"))
    return t.join(V.v_run(s, d).select("run_id", "w_pref"), "run_id").select("run_id", "s_pref", "s_sust", score.half_up(score.utility(F.col("w_pref"), F.col("s_pref"), F.col("s_sust")), 6).alias("utility"))


def itinerary_totals(s, d):
    p = V.v_place(s, d).select("poi_id", "entry_fee_lkr", "district", "typical_dwell_min", "prominence", score.place_sustainability().alias("sust"))
    j = _stops(s, d).join(p, "poi_id")
    return j.groupBy("run_id").agg(F.round(F.sum("entry_fee_lkr"), 2).alias("cost"), score.half_up(F.avg("prominence"), 4).alias("s_pref"), score.half_up(F.avg("sust"), 4).alias("s_sust"), F.countDistinct("district").alias("districts"), F.sum("typical_dwell_min").cast("long").alias("active_min"))


def leg_provenance(s, d):
    l = legs.measured_minutes(legs.build_legs(_stops(s, d), V.v_place(s, d), V.v_run(s, d)), V.v_edges(s, d)).where("slot > 0")
    return l.join(V.v_run(s, d).select("run_id", "system"), "run_id").groupBy("system").agg(F.count_if("measured").alias("stored"), F.count_if(~F.col("measured")).alias("estimated"))


def plan_signature(s, d):
    return metrics.plan_signature(_stops(s, d))


def plan_jaccard(s, d):
    runs = V.v_run(s, d).select("run_id")
    pairs = runs.select(F.col("run_id").alias("a"), (F.col("run_id") + 1).alias("b")).join(runs.select(F.col("run_id").alias("b")), "b", "left_semi")
    return metrics.plan_jaccard(_stops(s, d), pairs.select("a", "b"))


def plan_json(s, d):
    """Each plan as nested JSON: days, their stops with times, transport and what is estimated."""
    r, p = V.v_run(s, d), V.v_place(s, d)
    st = _stops(s, d)
    return legs.plan_payload(st, p, r).select("run_id", F.to_json("days").alias("plan"))


def gini(s, d):
    c = _stops(s, d).join(V.v_run(s, d).select("run_id", "system"), "run_id").groupBy("system", "poi_id").agg(F.count("*").alias("n")).select("system", "n")
    return metrics.gini(c, V.v_place(s, d).agg(F.count("*").alias("size")))


def diversity(s, d):
    return metrics.diversity(_stops(s, d), V.v_run(s, d), V.v_place(s, d))


def system_summary(s, d):
    return metrics.system_summary(_verdicts(s, d), V.v_run(s, d), legs.trip_emissions(_stops(s, d), V.v_place(s, d), V.v_run(s, d)), _totals(s, d))


def violation_rates(s, d):
    return metrics.violation_rates(_verdicts(s, d), V.v_run(s, d))


def latency_percentiles(s, d):
    return metrics.nearest_rank(V.v_run(s, d).select("system", (F.col("budget") / 1000.0).alias("seconds")), "system", "seconds", [50, 95])


def weight_sweep(s, d):
    """Answers, means and diversity of plans by interest weight."""
    r = V.v_run(s, d).withColumn("system", F.col("w_pref").cast("string"))
    answered = _stops(s, d).groupBy("run_id").agg(F.lit(True).alias("some"))
    every = r.select("run_id", "system").join(answered, "run_id", "left").join(_totals(s, d), "run_id", "left").groupBy("system")
    means = every.agg(F.round(F.count("some") * 100.0 / F.count("*"), 1).alias("answer_rate_pct"), score.half_up(F.avg("s_pref"), 4).alias("mean_pref"), score.half_up(F.avg("s_sust"), 4).alias("mean_sust"))
    both = metrics.diversity(_stops(s, d), r, V.v_place(s, d)).join(means, "system")
    return both.withColumn("w_sust", F.round(1 - F.col("system").cast("double"), 2)).withColumnRenamed("system", "w_pref")


def alternatives_gain(s, d):
    """Diversity of the runs of even number alone and of all runs, and the others' mean utility over the best of their request."""
    r = V.v_run(s, d)
    best = r.where("run_id % 2 = 0").withColumn("system", F.lit("best"))
    every = r.withColumn("system", F.lit("offered"))
    st = _stops(s, d)
    one = metrics.diversity(st.join(best.select("run_id"), "run_id", "left_semi"), best, V.v_place(s, d))
    both = one.unionByName(metrics.diversity(st, every, V.v_place(s, d))).drop("distinct_plan_pct")
    worth = _totals(s, d).join(r.select("run_id", "request_key"), "run_id")
    return both.join(F.broadcast(metrics.quality_ratio(worth.where("run_id % 2 = 0"), worth.where("run_id % 2 = 1")).withColumn("system", F.lit("offered"))), "system", "left")


def scenario_ranking(s, d):
    """Per scenario the systems by mean emissions, and whether the order never changes."""
    e = legs.trip_emissions(_stops(s, d), V.v_place(s, d), V.v_run(s, d)).join(V.v_run(s, d).select("run_id", "system"), "run_id")
    m = e.groupBy("system").agg(*(F.round(F.avg(sc), 4).alias(sc) for sc in ("low", "central", "high"))).unpivot("system", ["low", "central", "high"], "scenario", "kg")
    r = m.groupBy("scenario").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kg", "system"))), lambda x: x["system"]), ",").alias("ranking"))
    n = r.agg((F.countDistinct("ranking") == 1).alias("stable"))
    return r.crossJoin(F.broadcast(n))


def gates(s, d):
    """Gate rows (gate, system, observed, passed) over the run tables."""
    known = V.v_place(s, d).select("poi_id", F.lit(True).alias("known"))
    v = _stops(s, d).join(V.v_run(s, d).select("run_id", "system"), "run_id").join(known, "poi_id", "left").groupBy("system").agg(F.count_if(F.col("known").isNull()).cast("double").alias("u"))
    j = diversity(s, d).join(v, "system")
    row = lambda g, x, ok: F.struct(F.lit(g).alias("gate"), x.cast("double").alias("observed"), ok.alias("passed"))
    c = F.col
    rows = F.array(row("T1", c("u"), c("u") == 0), row("T4", c("catalogue_coverage_pct"), c("catalogue_coverage_pct") >= 40), row("T5", c("gini"), c("gini") <= 0.60), row("T6", c("distinct_plan_pct"), c("distinct_plan_pct") >= 90), row("T10", c("districts_covered"), c("districts_covered") >= 10))
    return j.select("system", F.explode(rows).alias("r")).select("system", "r.*")


def planner_gates(s, d):
    """Budget, interest, made-up id and repetition gates of a baseline planner."""
    from .plans.jobs import planner_gates as gates_of

    return gates_of("rule_based", _cand(s, d).withColumn("poi_budget", F.col("poi_budget") * 0.3))


def all_gates(s, d):
    """Gates T1 to T6 and T8 to T10 of every planner, the beam included."""
    return scenarios.all_gates(_requests(s, d), V.v_place(s, d))


def beam_sensitivity(s, d):
    """The beam's plans under twice the budget, two profiles and a repetition."""
    r = _requests(s, d)
    plans, _ = scenarios.plans_in_slices(r, V.v_place(s, d), ("beam",))
    return scenarios.sensitivity(plans["beam"], r)


def query_set(s, d):
    """The request grid times the customers' market segments as repeats."""
    b = s.createDataFrame(list(BUDGETS.items()), "budget_band string, budget double")
    t = s.createDataFrame(list(DURATIONS.items()), "duration_band string, n_days int")
    p = s.createDataFrame([(k, len(v)) for k, v in PROFILES.items()], "profile string, interests int")
    r = V.table(s, d, "customer").select(F.col("c_mktsegment").alias("repeat")).distinct()
    return b.crossJoin(t).crossJoin(p).crossJoin(F.broadcast(r)).select(F.concat_ws("-", "budget_band", "duration_band", "profile", "repeat").alias("query_id"), "budget", "n_days", "interests")


def _texts(s, d):
    """User messages and sentences built from orders."""
    o = F.col("o_orderkey")
    days = V.pick([" days", " day trip", "-night stay"], o % 3)
    lead = F.when(o % 7 == 0, F.lit("A week away")).when(o % 11 == 0, F.lit("Weekend trip")).otherwise(F.concat((F.lit(1) + o % 25).cast("string"), days))
    money = V.pick([", budget 90k LKR", ", rs 1.5 lakh", ", 120,000 rupees", ", about 2 mn lkr", ""], o % 5)
    party = V.pick([", 4 people", ", solo", ", a couple", ", 30 adults", ""], (o / 5).cast("long") % 5)
    wish = V.pick([", love temples and safari", ", hiking and waterfalls", ", beaches and markets", ""], (o / 25).cast("long") % 4)
    made = V.table(s, d, "orders").select(F.concat(F.lit("o"), o.cast("string")).alias("id"), F.concat(lead, money, party, wish).alias("text"))
    said = V.table(s, d, "conversations").where("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"), "text")
    return made.unionByName(said)


def parse_trip_text(s, d):
    p = _texts(s, d).select("id", text.parse_trip_text(F.col("text")).alias("p"))
    return p.select("id", "p.days", F.round("p.budget_lkr", 2).alias("budget_lkr"), "p.party_size", F.array_join("p.interests", ",").alias("interests"))


def validate_trip(s, d):
    p = _texts(s, d).select("id", text.parse_trip_text(F.col("text")).alias("p"))
    given = F.concat("p.interests", F.array(F.lit("Golf"), F.lit(" Beach ")))
    v = p.select("id", text.validate_trip(F.col("p.days"), F.col("p.budget_lkr"), F.col("p.party_size"), given).alias("v"))
    return v.select("id", "v.days", "v.party_size", F.array_join("v.interests", ",").alias("interests"), F.array_join("v.notes", "; ").alias("notes"), F.array_join("v.missing", ",").alias("missing"))


def parse_accuracy(s, d):
    return jobs.parse_accuracy(jobs.v_parse_log(s, d))


def parse_accuracy_windowed(s, d):
    return jobs.parse_accuracy_windowed(jobs.v_parse_log(s, d))


def pageviews_daily(s, d):
    return jobs.pageviews_daily(V.table(s, d, "events"))


def track_class(s, d):
    p = V.v_track(s, d)
    st = V.v_station(s, d).select("station_id", "lat", "lon")
    j = p.join(st.select(F.col("station_id").alias("a"), F.col("lat").alias("la"), F.col("lon").alias("lo")), "a").join(st.select(F.col("station_id").alias("b"), F.col("lat").alias("lb"), F.col("lon").alias("lob")), "b")
    return j.select("a", "b", rail.track_class((F.col("la") + F.col("lb")) / 2, (F.col("lo") + F.col("lob")) / 2, F.col("cls")).alias("track_class"))


def _ways(s, d):
    """Stations in ways of ten nodes, some disused, some with a missing point."""
    st = V.v_station(s, d).withColumn("way", F.floor(F.col("station_id") / 10))
    g = st.groupBy("way").agg(F.sort_array(F.collect_list(F.struct("station_id", "lat", "lon"))).alias("x"))
    geo = F.transform("x", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    tags = F.map_from_entries(F.filter(F.array(F.struct(F.lit("railway").alias("k"), F.lit("rail").alias("v")), F.struct(F.lit("disused").alias("k"), F.when(F.col("way") % 4 == 3, "yes").alias("v"))), lambda p: p["v"].isNotNull()))
    return g.select(tags.alias("tags"), F.transform("x", lambda p: p["station_id"]).alias("nodes"), F.when(F.col("way") % 5 == 4, F.slice(geo, F.lit(2), F.size("x"))).otherwise(geo).alias("geometry"))


def track_edges(s, d):
    e = rail.track_edges(_ways(s, d))
    return e.select("a", "b", F.round("km", 3).alias("km"))


def heal_gaps(s, d):
    n = V.v_station(s, d).select("node", "lat", "lon")
    return rail.heal_gaps(V.v_track(s, d), n, 25.0).select("a", "b", F.round("km", 3).alias("km"))


def station_snap(s, d):
    nodes = V.v_poi(s, d).select(F.col("k").alias("node"), "lat", "lon")
    st = V.v_station(s, d).select((F.col("station_id") + 100_000).alias("station_id"), (F.col("lat") + 0.003).alias("lat"), F.col("lon"))
    return rail.station_snap(st, nodes).select("station_id", "node", F.round("km", 3).alias("km"))


def station_match(s, d):
    k = F.col("s_suppkey")
    st = V.table(s, d, "supplier").select(k.alias("station_id"), F.concat(V.pick(["Ella", "Avissawella", "Kandy Main", "Galle"], k % 4), F.lit(" "), k.cast("string"), V.pick(["", " Station", " Railway Station"], k % 3)).alias("name"))
    want = V.table(s, d, "supplier").select(F.concat(V.pick(["ella", "Kandy Main", "galle", "Matara"], k % 4), F.lit(" "), (k % 40).cast("string")).alias("wanted")).distinct()
    return rail.station_match(want, st)


def _paths(s, d):
    src = V.v_track(s, d).select(F.col("a").alias("src")).distinct()
    return rail.rail_paths(V.v_track(s, d), src)


def rail_paths(s, d):
    by = [F.coalesce(F.col("km_by_class")[c], F.lit(0.0)).alias(f"km_{c}") for c in ("lowland", "hill", "fast", "slow")]
    return _paths(s, d).select("src", "node", F.round("minutes", 4).alias("minutes"), "km", *by)


def train_offers(s, d):
    st = V.v_station(s, d)
    a = st.select("station_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = st.select((F.col("station_id") - 5).alias("station_id"), (F.col("lat") + 0.005).alias("lat2"), F.col("lon").alias("lon2"))
    return rail.train_offers(a.join(b, "station_id").withColumnRenamed("station_id", "trip_id"), st, _paths(s, d))


def speed_fit(s, d):
    """Journeys along the lines: kilometres by class from the track, minutes by speed and a wobble by number."""
    t = V.v_track(s, d).withColumn("trip", F.floor(F.col("a") / 4))
    km = lambda c: F.sum(F.when(F.col("cls") == c, F.col("km")).otherwise(0.0)).alias(c)
    j = t.groupBy("trip").agg(*(km(c) for c in ("lowland", "hill", "fast", "slow")))
    j = j.withColumn("minutes", F.round((F.col("lowland") / 47.6 + F.col("hill") / 24.1 + F.col("fast") / 64.0 + F.col("slow") / 24.0) * 60.0 * (F.lit(1.0) + (F.col("trip") % 5 - 2) / F.lit(50.0)), 2))
    f = rail.speed_fit(j, ["lowland", "hill", "fast", "slow"])
    return f.select("trip", "minutes", F.round("predicted", 4).alias("predicted"), F.round("left_out", 4).alias("left_out"))


def queries() -> dict:
    import types

    return {n: f for n, f in globals().items() if isinstance(f, types.FunctionType) and not n.startswith("_") and n != "queries" and f.__module__ == __name__}
