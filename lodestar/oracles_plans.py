"""SQL of the queries over requests, plans, tracks, texts and logs."""

from __future__ import annotations

from .oracles import hav, kg, mode, with_views
from .sources.dims import BUDGETS, DURATIONS, ECO_COST, INTEREST_STEMS, PROFILES, TRAIN_KMH

_W = with_views
_REQ = ["v_request", "v_place"]
_PLAN = ["v_plan", "v_run", "v_place"]

_ECO = "CASE category " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in ECO_COST.items()) + " ELSE 0.3::DOUBLE END"
_NEAR = f"""near AS (SELECT r.*, round(r.budget * 0.20, 4) AS poi_budget, p.* EXCLUDE (lat, lon), p.lat, p.lon, {hav("r.start_lat", "r.start_lon", "p.lat", "p.lon")} AS dist,
  round(p.prominence - CASE WHEN p.popularity_known THEN p.popularity_index ELSE 0.0 END * 0.35, 6) AS rs
  FROM v_request r JOIN v_place p ON p.entry_fee_lkr <= round(r.budget * 0.20, 4))"""
_CAND = (
    _NEAR
    + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rs DESC, prominence DESC, poi_id) AS rk FROM near WHERE dist <= 60 AND list_contains(interests, category) AND prominence >= 0.25),
cand AS (SELECT *, round(w_pref * pref + (1 - w_pref) * (1 - 0.4::DOUBLE) * sust, 6) AS u FROM (SELECT *, round(least(1.0, CASE WHEN list_contains(interests, category) THEN 0.75 ELSE 0.25 END + prominence * 0.25) + 1e-9, 4) AS pref,
  round(greatest(0.0, least(1.0, 1.0 - (CASE WHEN popularity_known THEN round(popularity_index, 4) ELSE 0.35 END * 0.75 + {_ECO} * 0.25))), 4) AS sust FROM ranked WHERE rk <= 150))"""
)
_KEEP = """kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sm, poi_id) AS near_rank FROM (SELECT *, round(dist * 1.35 / 35.0 * 60.0, 6) AS sm FROM cand)) WHERE near_rank <= 12 AND sm <= 240)"""
_CAP = (
    _KEEP
    + """,
dep AS (SELECT *, row_number() OVER (PARTITION BY request_id, district, category ORDER BY u DESC, poi_id) AS depth, max(u) OVER (PARTITION BY request_id, district, category) AS gb FROM cand),
cr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY depth, gb DESC, district, category) AS cap_rank FROM dep),
cap AS (SELECT cr.*, cap_rank <= 40 OR kn.poi_id IS NOT NULL AS keep FROM cr LEFT JOIN kn USING (request_id, poi_id))"""
)


def _cheap(rel: str, name: str) -> str:
    return f"""{name} AS (SELECT request_id, CASE WHEN count(*) >= any_value(n_days) * 2 THEN sum(entry_fee_lkr) ELSE 'infinity'::DOUBLE END AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY entry_fee_lkr, poi_id) AS rn FROM {rel}) WHERE rn <= n_days * 2 GROUP BY 1)"""


_AFFORD = (
    _CAP
    + ",\n"
    + _cheap("(SELECT * FROM cap WHERE keep)", "inn")
    + ",\n"
    + _cheap("cap", "whl")
    + """,
aff AS (SELECT c.* EXCLUDE (keep), keep OR add2 AS keep, add2 AS added FROM (SELECT c.*, coalesce(i.total, 'infinity'::DOUBLE) > poi_budget AND w.total <= poi_budget
    AND row_number() OVER (PARTITION BY c.request_id ORDER BY entry_fee_lkr, u DESC, poi_id) <= n_days * 2 AND NOT keep AS add2 FROM cap c LEFT JOIN inn i USING (request_id) LEFT JOIN whl w USING (request_id)) c)"""
)
_PAIRM = hav("a.lat", "a.lon", "b.lat", "b.lon") + " * 1.35 / 35.0 * 60.0"


def _sup(rel: str) -> str:
    return f"""sup AS (SELECT DISTINCT a.request_id, a.poi_id FROM {rel} a JOIN {rel} b ON a.request_id = b.request_id AND a.poi_id <> b.poi_id
  WHERE {_PAIRM} <= 120 AND a.typical_dwell_min + {_PAIRM} + 15 + b.typical_dwell_min <= 600)"""


_DAYPAIR = f"""kc AS (SELECT * FROM aff WHERE keep),
dp AS (SELECT a.*, b.poi_id AS poi2, b.u AS u2, b.typical_dwell_min AS dw2, b.hours_estimated AS he2, b.open_min AS op2, b.close_min AS cl2, b.entry_fee_lkr AS fee2, a.dist * 1.35 / 35.0 * 60.0 AS hop, {_PAIRM} AS m
  FROM kc a JOIN kc b ON a.request_id = b.request_id AND a.poi_id <> b.poi_id),
d1 AS (SELECT *, CASE WHEN hours_estimated THEN 480 + ceil(hop) + 15 ELSE greatest(480 + ceil(hop) + 15, open_min) END + typical_dwell_min AS t1 FROM dp WHERE hop <= 240 AND m <= 120),
d2 AS (SELECT *, CASE WHEN he2 THEN t1 + ceil(m) + 15 ELSE greatest(t1 + ceil(m) + 15, op2) END + dw2 AS t2 FROM d1),
d3 AS (SELECT *, round(u + u2 - (hop + m) / 60.0 * 0.12, 6) AS v FROM d2 WHERE (hours_estimated OR t1 <= close_min) AND (he2 OR t2 <= cl2) AND t2 <= 1080 AND entry_fee_lkr + fee2 <= poi_budget),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY v DESC, poi_id, poi2) AS rb FROM d3) WHERE rb = 1)"""

_LEGS = f"""st AS (SELECT s.*, p.lat, p.lon, p.open_min, p.close_min, p.hours_estimated, p.entry_fee_lkr, p.typical_dwell_min, r.start_lat, r.start_lon FROM v_plan s JOIN v_place p USING (poi_id) JOIN v_run r USING (run_id)),
pv AS (SELECT *, coalesce(lag(poi_id) OVER w, '__start__') AS from_id, coalesce(lag(lat) OVER w, start_lat) AS plat, coalesce(lag(lon) OVER w, start_lon) AS plon, lag(day_no) OVER w AS pday FROM st WINDOW w AS (PARTITION BY run_id ORDER BY day_no, slot, poi_id)),
lg AS (SELECT *, CASE WHEN pday IS NULL THEN 'start' WHEN pday = day_no THEN 'between' ELSE 'overnight' END AS kind, {hav("plat", "plon", "lat", "lon")} AS km FROM pv)"""
_MEAS = """ed AS (SELECT least(from_id, to_id) AS ia, greatest(from_id, to_id) AS ib, min(duration_min) AS dm FROM v_edges GROUP BY 1, 2),
ml AS (SELECT lg.*, coalesce(dm, km * 1.35 / 35.0 * 60.0) AS minutes, dm IS NOT NULL AS measured FROM lg LEFT JOIN ed ON ia = least(lg.from_id, lg.poi_id) AND ib = greatest(lg.from_id, lg.poi_id))"""


def _clock(rel: str, name: str, minutes: str) -> str:
    """Arrivals and departures of up to three stops a day, written out slot by slot."""
    cols = ", ".join(f"max(CASE WHEN slot = {i} THEN {e} END) AS {n}{i}" for i in range(3) for e, n in ((minutes, "mm"), ("open_min", "op"), ("close_min", "cl"), ("CASE WHEN hours_estimated THEN 1 ELSE 0 END", "he"), ("typical_dwell_min", "dw"), ("poi_id", "pp")))
    step = lambda i, prev: f"CASE WHEN he{i} = 1 THEN {prev} + mm{i} + 15 ELSE greatest({prev} + mm{i} + 15, op{i}) END"
    # days may lack a slot; the clock then passes on
    out = f"{name}0 AS (SELECT run_id, day_no, {cols} FROM {rel} GROUP BY 1, 2)"
    out += f",\n{name}1 AS (SELECT *, CASE WHEN pp0 IS NULL THEN 480.0 ELSE {step(0, '480.0')} + dw0 END AS e0 FROM {name}0)"
    out += f",\n{name}2 AS (SELECT *, CASE WHEN pp1 IS NULL THEN e0 ELSE {step(1, 'e0')} + dw1 END AS e1 FROM {name}1)"
    out += f",\n{name} AS (SELECT *, CASE WHEN pp2 IS NULL THEN e1 ELSE {step(2, 'e1')} + dw2 END AS e2 FROM {name}2)"
    return out


_TR = "tr AS (SELECT lg.*, r.party, {m} AS mode FROM lg JOIN v_run r USING (run_id)),\ntv AS (SELECT *, round(CASE mode WHEN 'walk' THEN km * 1.35 / 4.5 * 60.0 WHEN 'tuktuk' THEN km * 1.35 / 35.0 * 60.0 * 1.1 + 5.0 WHEN 'bus' THEN km * 1.35 / 35.0 * 60.0 * 1.4 + 10.0 ELSE km * 1.35 / 35.0 * 60.0 END, 1) AS dmin, round(km * 1.35, 1) AS dkm, round({g} * 1000.0, 1) AS g FROM tr)".format(
    m=mode("km * 1.35"), g=kg("mode", "(km * 1.35)", "party")
)
_VERDICT = (
    _LEGS
    + ",\n"
    + _MEAS
    + ",\n"
    + _clock("ml", "ck", "minutes")
    + """,
dy AS (SELECT run_id, sum(CASE WHEN he0 = 0 AND e0 > cl0 + 1e-6 THEN 1 ELSE 0 END + CASE WHEN he1 = 0 AND e1 > cl1 + 1e-6 THEN 1 ELSE 0 END + CASE WHEN he2 = 0 AND e2 > cl2 + 1e-6 THEN 1 ELSE 0 END) AS oh, count(*) FILTER (round(e2, 6) > 1080) AS ov FROM ck GROUP BY 1),
hp AS (SELECT *, row_number() OVER (PARTITION BY run_id, day_no ORDER BY slot, poi_id) = 1 AS hop FROM ml),
ct AS (SELECT run_id, count(*) FILTER (hop AND minutes > 240) AS tl, count(*) FILTER (measured) AS lm, count(*) FILTER (NOT measured) AS le FROM hp GROUP BY 1),
fl AS (SELECT run_id, count(*) AS stops, count(*) - count(DISTINCT poi_id) AS dup, max(day_no) AS last_day FROM v_plan GROUP BY 1),
co AS (SELECT run_id, count(*) AS known, sum(entry_fee_lkr) AS cost FROM st GROUP BY 1),
vd AS (SELECT run_id, coalesce(stops, 0) - coalesce(known, 0) AS unknown_poi, coalesce(dup, 0) AS duplicate_poi, CAST(CASE WHEN coalesce(cost, 0) > budget * 0.20::DOUBLE + 1e-6 THEN 1 ELSE 0 END AS BIGINT) AS budget_exceeded,
  coalesce(ov, 0) AS day_overflow, CAST(coalesce(oh, 0) AS BIGINT) AS opening_hours, CAST(CASE WHEN stops IS NULL THEN 1 ELSE 0 END AS BIGINT) AS empty_plan, CAST(CASE WHEN coalesce(last_day, 0) > n_days THEN 1 ELSE 0 END AS BIGINT) AS too_many_days,
  coalesce(tl, 0) AS transfer_too_long, round(coalesce(cost, 0.0), 2) AS total_cost, coalesce(stops, 0) AS stops, coalesce(lm, 0) AS legs_measured, coalesce(le, 0) AS legs_estimated
  FROM v_run LEFT JOIN fl USING (run_id) LEFT JOIN co USING (run_id) LEFT JOIN ct USING (run_id) LEFT JOIN dy USING (run_id)),
ver AS (SELECT *, unknown_poi + duplicate_poi + budget_exceeded + day_overflow + opening_hours + empty_plan + too_many_days + transfer_too_long = 0 AS feasible FROM vd)"""
)
_EMI = "nd AS (SELECT run_id, count(DISTINCT day_no) AS nd FROM v_plan GROUP BY 1),\nem AS (SELECT run_id, " + ", ".join(f"round(sum({kg(mode('(km * 1.35)').join('()'), '(km * 1.35)', 'r.party', sc)}) / any_value(nd), 3) AS {sc}" for sc in ("low", "central", "high")) + " FROM lg JOIN v_run r USING (run_id) JOIN nd USING (run_id) GROUP BY 1)"
_SIG = "sg AS (SELECT run_id, array_to_string(list(day_no || ':' || poi_id ORDER BY day_no, slot, poi_id), '|') AS signature FROM v_plan GROUP BY 1)"


def _div(stops: str, runs: str, n: str = "") -> str:
    """Diversity per system of the given relations, as CTE dv{n}."""
    return f"""s{n} AS (SELECT p.*, r.system, r.request_key FROM {stops} p JOIN {runs} r USING (run_id)),
f{n} AS (SELECT system, poi_id, count(*) AS n FROM s{n} GROUP BY 1, 2),
gi{n} AS (SELECT system, round(sum((2 * (sz - m + rn) - sz - 1) * n) / (any_value(sz) * sum(n)), 4) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY n) AS rn, count(*) OVER (PARTITION BY system) AS m, (SELECT count(*) FROM v_place) AS sz FROM f{n}) GROUP BY 1),
t5{n} AS (SELECT system, sum(n) AS top5 FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY n DESC, poi_id) AS rn FROM f{n}) WHERE rn <= 5 GROUP BY 1),
fk{n} AS (SELECT system, round(100.0 * count(DISTINCT signature) / count(*), 2) AS dpp FROM (SELECT system, request_key, arg_min(signature, run_id) AS signature FROM (SELECT DISTINCT run_id, system, request_key FROM s{n}) JOIN sg USING (run_id) GROUP BY 1, 2) GROUP BY 1),
dv{n} AS (SELECT f.system, any_value(pl) AS plans, CAST(sum(f.n) AS BIGINT) AS total_recommendations, count(*) AS distinct_pois, round(100.0 * count(*) / (SELECT count(*) FROM v_place), 2) AS catalogue_coverage_pct, any_value(gini) AS gini,
  any_value(dpp) AS distinct_plan_pct, count(DISTINCT district) AS districts_covered, round(100.0 * any_value(top5) / sum(f.n), 2) AS top5_share_pct
  FROM f{n} f LEFT JOIN v_place USING (poi_id) JOIN gi{n} USING (system) JOIN t5{n} USING (system) JOIN fk{n} USING (system) JOIN (SELECT system, count(DISTINCT run_id) AS pl FROM s{n} GROUP BY 1) USING (system) GROUP BY 1)"""


def _text() -> str:
    """Messages by windows over their numbered tokens; the patterns are written for this SQL alone."""
    stems = ", ".join("CASE WHEN " + " OR ".join(f"contains(line, ' {x}')" for x in v) + f" THEN '{c}' END" for c, v in INTEREST_STEMS.items())
    unit = lambda c: f"CASE WHEN {c} IN ('k', 'thousand') THEN 1000.0 WHEN {c} IN ('lakh', 'lakhs', 'lac') THEN 100000.0 WHEN {c} IN ('m', 'mn', 'million') THEN 1000000.0 END"
    money = lambda c: f"coalesce({c} IN ('lkr', 'rs', 'rupee', 'rupees'), false)"
    return f"""tx AS (SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'A week away' WHEN o_orderkey % 11 = 0 THEN 'Weekend trip' ELSE (1 + o_orderkey % 25) || [' days', ' day trip', '-night stay'][o_orderkey % 3 + 1] END
  || [', budget 90k LKR', ', rs 1.5 lakh', ', 120,000 rupees', ', about 2 mn lkr', ''][o_orderkey % 5 + 1] || [', 4 people', ', solo', ', a couple', ', 30 adults', ''][(o_orderkey // 5) % 5 + 1]
  || [', love temples and safari', ', hiking and waterfalls', ', beaches and markets', ''][(o_orderkey // 25) % 4 + 1] AS t FROM orders
  UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations WHERE role = 'user'),
ty AS (SELECT row_number() OVER () AS r, id, regexp_extract_all(lower(coalesce(t, '')), '\\p{{L}}+|[0-9]+(?:,[0-9]+)*(?:\\.[0-9]+)?') AS ws FROM tx),
tk AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ty),
tn AS (SELECT *, TRY_CAST(replace(w, ',', '') AS DOUBLE) AS v, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2, lead(w) OVER o AS n1, lead(w, 2) OVER o AS n2, sum(length(w) + 1) OVER o AS upto FROM tk WINDOW o AS (PARTITION BY r ORDER BY i)),
tb AS (SELECT *, max(CASE WHEN w = 'budget' THEN i END) OVER e AS bi, max(CASE WHEN w = 'budget' THEN upto END) OVER e AS bu, max(CASE WHEN v IS NOT NULL THEN i END) OVER e AS vi FROM tn WINDOW e AS (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tm AS (SELECT *, least(CASE WHEN {money("p1")} THEN i - 1 END, CASE WHEN bi IS NOT NULL AND coalesce(vi < bi, true) AND upto - length(w) - 1 - bu + 1 <= 12 THEN bi END,
    CASE WHEN CASE WHEN {unit("n1")} IS NULL THEN {money("n1")} ELSE {money("n2")} END THEN i END) AS f, v * coalesce({unit("n1")}, 1.0) AS amount FROM tb WHERE v IS NOT NULL),
ta AS (SELECT r, arg_min(amount, f) AS budget_lkr FROM tm WHERE f IS NOT NULL GROUP BY r),
tw AS (SELECT r, arg_min(TRY_CAST(p1 AS INTEGER), i) FILTER (w IN ('day', 'days', 'night', 'nights') AND regexp_full_match(p1, '[0-9]+') AND TRY_CAST(p1 AS INTEGER) IS NOT NULL) AS days, bool_or(w = 'week' AND p1 IN ('a', 'one')) AS week, bool_or(w = 'weekend') AS weekend,
    arg_min(TRY_CAST(CASE WHEN w = 'us' THEN p2 ELSE p1 END AS INTEGER), i) FILTER (CASE WHEN w = 'us' THEN p1 = 'of' AND regexp_full_match(p2, '[0-9]+') ELSE w IN ('people', 'persons', 'pax', 'adults', 'travellers', 'travelers', 'friends') AND regexp_full_match(p1, '[0-9]+') END) AS party,
    bool_or(w IN ('solo', 'alone', 'myself')) AS alone, bool_or(w = 'couple' OR (w IN ('wife', 'husband', 'partner') AND p1 = 'my') OR (w = 'us' AND p1 = 'of' AND p2 = 'two')) AS pair FROM tn GROUP BY r),
pt AS (SELECT id, coalesce(days, CASE WHEN week THEN 7 END, CASE WHEN weekend THEN 2 END) AS n_days, budget_lkr, coalesce(party, CASE WHEN alone THEN 1 END, CASE WHEN pair THEN 2 END) AS party_size, list_filter([{stems}], lambda x: x IS NOT NULL) AS interests
  FROM (SELECT *, ' ' || array_to_string(ws, ' ') AS line FROM ty) LEFT JOIN tw USING (r) LEFT JOIN ta USING (r))"""


_LOG = """lo AS (SELECT o_orderdate AS ts, CASE WHEN o_orderstatus = 'O' THEN 'llm' ELSE 'rules' END AS source, f.field, 1 - ((o_custkey % 16) // f.bit) % 2 AS kept
  FROM orders, (VALUES ('days', 1), ('budget_lkr', 2), ('party_size', 4), ('interests', 8)) f(field, bit))"""


def oracles() -> dict[str, str]:
    o = {}
    o["retrieve_candidates"] = _W(_REQ, _CAND + "\nSELECT request_id, CAST(rk AS INTEGER) AS rank, poi_id, category, prominence, rs AS retrieval_score, round(dist, 3) AS distance_km FROM cand")
    o["widen_candidates"] = _W(
        _REQ,
        _NEAR
        + """,
nd AS (SELECT *, CASE WHEN dist <= 60 AND list_contains(interests, category) THEN CASE WHEN prominence >= 0.25 THEN 0 ELSE 1 END WHEN list_contains(interests, category) THEN 2 ELSE 3 END AS need FROM near WHERE dist <= 250),
sp AS (SELECT request_id, CASE WHEN count(*) FILTER (need = 0) >= 15 THEN 0 WHEN count(*) FILTER (need <= 1) >= 15 THEN 1 WHEN count(*) FILTER (need <= 2) >= 15 THEN 2 ELSE 3 END AS step FROM nd GROUP BY 1),
rk AS (SELECT nd.request_id, poi_id, step, row_number() OVER (PARTITION BY nd.request_id ORDER BY rs DESC, prominence DESC, poi_id) AS rank FROM nd JOIN sp USING (request_id) WHERE need <= step)
SELECT request_id, poi_id, CAST(step AS INTEGER) AS step, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 150""",
    )
    o["retrieval_diag"] = _W(
        _REQ,
        _CAND
        + "\nSELECT request_id, count(*) AS n, count(DISTINCT category) AS categories, count(DISTINCT district) AS districts, round(avg(prominence) + 1e-9, 5) AS mean_prominence, round(100.0 * count(*) FILTER (popularity_known) / count(*), 1) AS known_pct, round(coalesce(avg(popularity_index) FILTER (popularity_known), 0.0) + 1e-9, 5) AS mean_popularity FROM cand GROUP BY 1",
    )
    o["induced_edges"] = _W(
        [*_REQ, "v_edges"],
        _CAND
        + ",\ni AS (SELECT a.request_id, count(*) AS e FROM cand a JOIN v_edges d ON d.from_id = a.poi_id JOIN cand b ON b.request_id = a.request_id AND b.poi_id = d.to_id GROUP BY 1),\nn AS (SELECT request_id, count(*) AS n FROM cand GROUP BY 1)\nSELECT request_id, n, coalesce(e, 0) AS edges, round(coalesce(e, 0) * 200.0 / nullif(n * (n - 1), 0), 4) AS pair_pct FROM n LEFT JOIN i USING (request_id)",
    )
    o["travel_lookup"] = _W([*_PLAN, "v_edges"], _LEGS + ",\n" + _MEAS + "\nSELECT measured, count(*) AS legs, round(sum(minutes), 2) AS minutes FROM ml GROUP BY 1")
    o["score_contract"] = _W(
        _REQ,
        _CAND
        + "\nSELECT request_id, CASE WHEN request_id % 300 = 0 THEN count(*) FILTER (rk = 3) ELSE 0 END AS invented, CASE WHEN request_id % 300 = 0 THEN count(*) FILTER (rk = 2) ELSE 0 END AS omitted, CASE WHEN request_id % 300 = 0 THEN count(*) FILTER (rk = 1) ELSE 0 END AS out_of_range FROM cand GROUP BY 1",
    )
    o["score_with_fallback"] = _W(_REQ, _CAND + "\nSELECT request_id, poi_id, CASE WHEN request_id % 300 = 0 THEN pref ELSE 0.5 END AS score, request_id % 300 <> 0 AS used_llm FROM cand")
    o["parse_scores"] = _W(_REQ, _CAND + "\nSELECT request_id, poi_id, pref AS score FROM cand WHERE rk <= 3")
    o["score_payload"] = _W(
        _REQ,
        _CAND
        + """
SELECT request_id, CAST(floor((rk - 1) / 20) AS BIGINT) AS batch, count(*) AS n, '[' || array_to_string(list('{"id":"' || poi_id || '","category":"' || category || '","entry_fee_lkr":' || CAST(round(entry_fee_lkr) AS BIGINT) || ',"typical_visit_minutes":' || typical_dwell_min || '}' ORDER BY rk), ',') || ']' AS payload FROM cand GROUP BY 1, 2""",
    )
    o["unknown_ids"] = _W(["v_plan"], "SELECT run_id, day_no, slot, 'x/' || poi_id AS poi_id FROM v_plan WHERE run_id % 50 = 0 AND slot = 0")
    o["heuristic_preference"] = _W(_REQ, _CAND + "\nSELECT request_id, poi_id, pref FROM cand")
    o["utility"] = _W(_REQ, _CAND + "\nSELECT request_id, poi_id, round(u, 4) AS utility FROM cand")
    o["request_budgets"] = _W(["v_request"], "SELECT request_id, round(1 - w_pref, 4) AS w_sust, round(budget * 0.20 + 1e-9, 3) AS poi_budget, round(budget * 0.45 + 1e-9, 3) AS lodging_budget FROM v_request")
    o["unary_feasible"] = _W(
        _REQ,
        _CAND
        + ",\nx AS (SELECT request_id, fee, fee AND (hours_estimated OR greatest(480, open_min) + typical_dwell_min <= least(1080, close_min)) AS ok, fee AND hours_estimated AS hi FROM (SELECT *, fee_estimated OR entry_fee_lkr <= poi_budget AS fee FROM cand))\nSELECT request_id, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS dropped, count(*) FILTER (hi) AS hours_imputed FROM x GROUP BY 1",
    )
    o["keep_nearest"] = _W(_REQ, _CAND + ",\n" + _KEEP + "\nSELECT request_id, CAST(near_rank AS INTEGER) AS near_rank, poi_id FROM kn")
    o["stratified_cap"] = _W(_REQ, _CAND + ",\n" + _CAP + "\nSELECT request_id, poi_id, CAST(cap_rank AS INTEGER) AS cap_rank, keep FROM cap")
    o["cheapest_total"] = _W(_REQ, _CAND + ",\n" + _cheap("cand", "ch") + "\nSELECT request_id, round(total, 2) AS total FROM ch")
    o["keep_affordable"] = _W(_REQ, _CAND + ",\n" + _AFFORD + "\nSELECT request_id, count(*) FILTER (keep) AS kept, count(*) FILTER (added) AS added FROM aff GROUP BY 1")
    o["reach_prune"] = _W(_REQ, _CAND + ",\n" + _AFFORD + ",\nkk AS (SELECT * FROM aff WHERE keep),\n" + _sup("kk") + "\nSELECT request_id, CAST(slot AS INTEGER) AS slot, poi_id FROM sup, (VALUES (0), (1)) s(slot)")
    o["domain_reduction"] = _W(
        _REQ,
        _CAND
        + ",\n"
        + _AFFORD
        + ",\n"
        + _sup("cand")
        + """,
z AS (SELECT request_id, count(*) AS b, (SELECT count(*) FROM sup WHERE sup.request_id = cand.request_id) AS a, (SELECT count(*) FROM aff WHERE keep AND aff.request_id = cand.request_id) AS k FROM cand GROUP BY 1)
SELECT request_id, CASE WHEN b > 0 THEN round((b - a) * 100.0 / b, 2) ELSE 0.0 END AS domain_reduction_pct, CASE WHEN a > 0 THEN round((a - least(k, a)) * 100.0 / a, 2) ELSE 0.0 END AS cap_reduction_pct FROM z""",
    )
    o["best_day_pair"] = _W(_REQ, _CAND + ",\n" + _AFFORD + ",\n" + _DAYPAIR + "\nSELECT request_id, poi_id AS a, poi2 AS b, v AS value FROM best")
    o["best_day"] = _W(
        _REQ,
        _CAND
        + ",\n"
        + _AFFORD
        + ",\n"
        + _DAYPAIR
        + f""",
tr AS (SELECT d.request_id, d.poi_id AS a, d.poi2 AS b, c.poi_id AS c, d.t2, d.u + d.u2 - (d.hop + d.m) / 60.0 * 0.12 AS w2, c.u AS u3, c.hours_estimated AS he3, c.open_min AS op3, c.close_min AS cl3, c.typical_dwell_min AS dw3,
    {hav("k.lat", "k.lon", "c.lat", "c.lon")} * 1.35 / 35.0 * 60.0 AS m2, {hav("d.lat", "d.lon", "c.lat", "c.lon")} * 1.35 / 35.0 * 60.0 AS m3
  FROM d3 d JOIN kc c ON c.request_id = d.request_id AND c.poi_id <> d.poi_id AND c.poi_id <> d.poi2 AND d.entry_fee_lkr + d.fee2 + c.entry_fee_lkr <= d.poi_budget
  JOIN kc k ON k.request_id = d.request_id AND k.poi_id = d.poi2),
t3 AS (SELECT *, CASE WHEN he3 THEN t2 + ceil(m2) + 15 ELSE greatest(t2 + ceil(m2) + 15, op3) END + dw3 AS e FROM tr WHERE m2 <= 120 AND m3 <= 150),
al AS (SELECT request_id, v, poi_id || ',' || poi2 AS stops, [poi_id, poi2] AS l FROM d3
  UNION ALL SELECT request_id, round(w2 + u3 - m2 / 60.0 * 0.12, 6), a || ',' || b || ',' || c, [a, b, c] FROM t3 WHERE (he3 OR e <= cl3) AND e <= 1080)
SELECT request_id, stops, v AS value FROM al QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY v DESC, l) = 1""",
    )
    o["conflicts"] = _W(
        _REQ,
        _CAND
        + ",\n"
        + _AFFORD
        + ",\n"
        + _DAYPAIR
        + ",\nkk AS (SELECT * FROM aff WHERE keep),\n"
        + _sup("kk")
        + """
SELECT r.request_id, CASE WHEN coalesce(n, 0) < r.n_days * 2 THEN 'too_few_candidates' WHEN coalesce(s, 0) = 0 THEN 'domain_wipeout' WHEN b.request_id IS NULL THEN 'no_feasible_assignment' END AS conflict
FROM v_request r LEFT JOIN (SELECT request_id, count(*) AS n FROM cand GROUP BY 1) USING (request_id) LEFT JOIN (SELECT request_id, count(*) AS s FROM sup GROUP BY 1) USING (request_id) LEFT JOIN best b USING (request_id)""",
    )

    def greedy(order: str, share: str = "poi_budget") -> str:
        return f"""gr AS (SELECT request_id, n_days, {share} AS bud, poi_id, entry_fee_lkr AS fee, row_number() OVER (PARTITION BY request_id ORDER BY {order}, poi_id) AS rn FROM cand),
fo AS (SELECT request_id, rn, poi_id, CASE WHEN fee <= bud THEN fee ELSE 0.0 END AS spent, CASE WHEN fee <= bud THEN 1 ELSE 0 END AS n, fee <= bud AS took FROM gr WHERE rn = 1
  UNION ALL SELECT g.request_id, g.rn, g.poi_id, CASE WHEN f.n < g.n_days * 3 AND f.spent + g.fee <= g.bud THEN f.spent + g.fee ELSE f.spent END, CASE WHEN f.n < g.n_days * 3 AND f.spent + g.fee <= g.bud THEN f.n + 1 ELSE f.n END, f.n < g.n_days * 3 AND f.spent + g.fee <= g.bud
  FROM fo f JOIN gr g ON g.request_id = f.request_id AND g.rn = f.rn + 1)
SELECT request_id, CAST(floor((n - 1) / 3) + 1 AS INTEGER) AS day_no, CAST((n - 1) % 3 AS INTEGER) AS slot, poi_id FROM fo WHERE took"""

    rec = lambda q: q.replace("WITH ", "WITH RECURSIVE ", 1)
    o["rule_based_plan"] = rec(_W(_REQ, _CAND + ",\n" + greedy("prominence DESC")))
    o["greedy_eco_plan"] = rec(_W(_REQ, _CAND + ",\n" + greedy("sust DESC")))
    o["mmr_utility"] = _W(
        _REQ,
        _CAND
        + """,
tp AS (SELECT * FROM (SELECT request_id, poi_id, district, category, row_number() OVER (PARTITION BY request_id ORDER BY u DESC, poi_id) AS rn FROM cand) WHERE rn <= 3)
SELECT c.request_id, c.poi_id, round(any_value(c.u) - coalesce(max(CASE WHEN t.district = c.district AND t.category = c.category THEN 1.0 WHEN t.district = c.district THEN 0.6 WHEN t.category = c.category THEN 0.4 ELSE 0.0 END), 0.0)::DOUBLE * any_value(c.u) * 0.3::DOUBLE + 1e-9, 4) AS mmr
FROM cand c LEFT JOIN tp t ON t.request_id = c.request_id AND t.poi_id <> c.poi_id GROUP BY 1, 2""",
    )
    o["kg_per_traveller"] = _W(
        ["v_poi"],
        "x AS (SELECT poi_id, ['walk', 'train', 'bus', 'tuktuk', 'car_private', 'car_shared', 'boat'][k % 7 + 1] AS mode, (k * 13 % 900) / 10.0 AS km, k % 6 + 1 AS party FROM v_poi)\nSELECT poi_id, " + ", ".join(f"round({kg('mode', 'km', 'party', sc)} + 1e-9, 6) AS {sc}" for sc in ("low", "central", "high")) + " FROM x",
    )
    o["estimated_mode"] = _W(["v_poi"], f"SELECT poi_id, {mode('x')} AS mode FROM (SELECT poi_id, (k * 7 % 1000) / 10.0 AS x FROM v_poi)")
    ref = "(227.5::DOUBLE * 0.16691::DOUBLE)"
    o["trip_score"] = _W(["v_poi"], f"SELECT poi_id, j AS journey, round((1 - 0.4::DOUBLE) * pm + 0.4::DOUBLE * j, 4) AS trip FROM (SELECT poi_id, (k % 101) / 100.0 AS pm, round(1.0 - least(1.0, ((k * 17 % 600) / 10.0) / {ref}), 4) AS j FROM v_poi)")
    o["plan_leg"] = _W(
        ["v_poi"],
        f"SELECT poi_id, mode, round(CASE mode WHEN 'walk' THEN km * 1.35::DOUBLE / 4.5::DOUBLE * 60.0::DOUBLE WHEN 'tuktuk' THEN km * 1.35::DOUBLE / 35.0::DOUBLE * 60.0::DOUBLE * 1.1::DOUBLE + 5.0 WHEN 'bus' THEN km * 1.35::DOUBLE / 35.0::DOUBLE * 60.0::DOUBLE * 1.4::DOUBLE + 10.0 ELSE km * 1.35::DOUBLE / 35.0::DOUBLE * 60.0::DOUBLE END, 1) AS minutes, round(km * 1.35::DOUBLE, 1) AS km FROM (SELECT *, {mode('(km * 1.35::DOUBLE)')} AS mode FROM (SELECT poi_id, (k * 7 % 1500) / 10.0 AS km FROM v_poi))",
    )
    o["build_legs"] = _W(_PLAN, _LEGS + "\nSELECT run_id, day_no, slot, from_id, poi_id, kind, round(km, 3) AS km FROM lg")
    e = lambda i: f"SELECT run_id, day_no, {i} AS slot, pp{i} AS poi_id, e{i} - dw{i} AS arr, e{i} AS dep, he{i} = 0 AND e{i} > cl{i} + 1e-6 AS late, e2 FROM ck WHERE pp{i} IS NOT NULL"
    o["retime"] = _W(
        _PLAN,
        _LEGS + ",\n" + _TR + ",\n" + _clock("tv", "ck", "dmin") + f"\nSELECT run_id, day_no, slot, poi_id, CAST(round(arr + 1e-9) AS INTEGER) AS arrive, CAST(round(dep + 1e-9) AS INTEGER) AS depart, late, CAST(greatest(0, round(e2 - 1080 + 1e-9)) AS INTEGER) AS overflow FROM ({e(0)} UNION ALL {e(1)} UNION ALL {e(2)})",
    )
    o["schedule_day"] = _W(
        _PLAN,
        _LEGS
        + ",\nm2 AS (SELECT *, km * 1.35 / 35.0 * 60.0 AS minutes FROM lg),\n"
        + _clock("m2", "ck", "ceil(minutes)")
        + f""",
hp AS (SELECT run_id, day_no, max(CASE WHEN minutes > CASE WHEN hop THEN 240 ELSE 120 END THEN 1 ELSE 0 END) AS far FROM (SELECT *, row_number() OVER (PARTITION BY run_id, day_no ORDER BY slot, poi_id) = 1 AS hop FROM m2) GROUP BY 1, 2),
ap AS (SELECT DISTINCT a.run_id, a.day_no FROM st a JOIN st b ON a.run_id = b.run_id AND a.day_no = b.day_no AND a.slot < b.slot WHERE {_PAIRM} > 150)
SELECT run_id, day_no, far = 0 AND ap.run_id IS NULL AND e2 <= 1080 AND NOT (coalesce(he0 = 0 AND e0 > cl0 + 1e-6, false) OR coalesce(he1 = 0 AND e1 > cl1 + 1e-6, false) OR coalesce(he2 = 0 AND e2 > cl2 + 1e-6, false)) AS valid FROM ck JOIN hp USING (run_id, day_no) LEFT JOIN ap USING (run_id, day_no)""",
    )
    o["verify_plans"] = _W([*_PLAN, "v_edges"], _VERDICT + "\nSELECT * FROM ver")
    o["trip_emissions"] = _W(_PLAN, _LEGS + ",\n" + _EMI + "\nSELECT * FROM em")
    car = kg("'car_private'", "dkm", "party")
    o["emissions_summary"] = _W(
        _PLAN,
        _LEGS
        + ",\n"
        + _TR
        + f""",
sm AS (SELECT run_id, sum(dkm) AS km, sum(g) AS g, sum({car}) AS car, any_value(party) AS party FROM tv GROUP BY 1),
s2 AS (SELECT run_id, km, g / 1000.0 * sm.party AS total, car * sm.party AS base, g / 1000.0 / greatest(n_days, 1) AS dayk FROM sm JOIN v_run USING (run_id)),
s3 AS (SELECT *, greatest(0.0, base - total) AS saved FROM s2)
SELECT run_id, round(km + 1e-9, 1) AS total_km, round(total + 1e-9, 2) AS total_kg_co2, round(base + 1e-9, 2) AS private_car_kg_co2, round(saved + 1e-9, 2) AS saved_kg_co2, CASE WHEN base > 0 THEN round(saved * 100.0 / base + 1e-9, 1) ELSE 0.0 END AS saved_pct, round(dayk + 1e-9, 2) AS kg_per_traveller_day,
  round(1.0 - least(1.0, round(dayk + 1e-9, 6) / {ref}), 4) AS journey_score FROM s3""",
    )
    lodge = f"""la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, day_no ORDER BY slot DESC, poi_id) AS rn, max(day_no) OVER (PARTITION BY run_id) AS ende FROM (SELECT s.*, p.lat, p.lon FROM v_plan s JOIN v_place p USING (poi_id))) WHERE rn = 1 AND day_no < ende),
sp AS (SELECT DISTINCT poi_id, lat, lon FROM la),
nn AS (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY sustainability_score DESC, km, acc_id) AS rn FROM (SELECT poi_id, acc_id, rate, sustainability_score, round(km, 4) AS km FROM (SELECT a.poi_id, s.acc_id, s.rate, s.sustainability_score, {hav("a.lat", "a.lon", "s.lat", "s.lon")} AS km FROM sp a, v_stay s) WHERE km <= 25))"""
    o["lodging_candidates"] = _W([*_PLAN, "v_stay"], lodge + "\nSELECT run_id, day_no AS night, CAST(nn.rn AS INTEGER) AS rn, acc_id, km FROM la JOIN nn USING (poi_id) WHERE nn.rn <= 3")
    o["choose_lodging"] = rec(
        _W(
            [*_PLAN, "v_stay"],
            lodge
            + """,
ni AS (SELECT e.run_id, n.night, row_number() OVER (PARTITION BY e.run_id ORDER BY n.night) AS i, coalesce(l.opts, []) AS opts, r.budget * 0.45 AS bud FROM (SELECT run_id, max(day_no) AS last FROM v_plan GROUP BY 1) e JOIN (SELECT unnest(range(1, 20)) AS night) n ON n.night < e.last JOIN v_run r ON r.run_id = e.run_id
  LEFT JOIN (SELECT run_id, day_no, list(nn.rate ORDER BY nn.rn) AS opts FROM la JOIN nn USING (poi_id) WHERE nn.rn <= 25 GROUP BY 1, 2) l ON l.run_id = e.run_id AND l.day_no = n.night),
fo AS (SELECT run_id, 0::BIGINT AS i, 0.0::DOUBLE AS spent, NULL::DOUBLE AS rate FROM ni WHERE i = 1
  UNION ALL SELECT n.run_id, n.i, f.spent + coalesce(list_filter(n.opts, lambda x: f.spent + x <= n.bud)[1], 0.0), list_filter(n.opts, lambda x: f.spent + x <= n.bud)[1] FROM fo f JOIN ni n ON n.run_id = f.run_id AND n.i = f.i + 1)
SELECT run_id, count(*) AS nights, count(rate) AS assigned, round(coalesce(sum(rate), 0.0), 0) AS total FROM fo WHERE i > 0 GROUP BY 1""",
        )
    )
    o["itinerary_totals"] = _W(
        _PLAN,
        f"""x AS (SELECT *, round(greatest(0.0, least(1.0, 1.0 - (CASE WHEN popularity_known THEN round(popularity_index, 4) ELSE 0.35 END * 0.75 + {_ECO} * 0.25))), 4) AS sust FROM v_place)
SELECT run_id, round(sum(entry_fee_lkr), 2) AS cost, round(avg(prominence) + 1e-9, 4) AS s_pref, round(avg(sust) + 1e-9, 4) AS s_sust, count(DISTINCT district) AS districts, CAST(sum(typical_dwell_min) AS BIGINT) AS active_min FROM v_plan JOIN x USING (poi_id) GROUP BY 1""",
    )
    o["leg_provenance"] = _W([*_PLAN, "v_edges"], _LEGS + ",\n" + _MEAS + "\nSELECT system, count(*) FILTER (measured) AS stored, count(*) FILTER (NOT measured) AS estimated FROM ml JOIN v_run USING (run_id) WHERE slot > 0 GROUP BY 1")
    o["plan_signature"] = _W(["v_plan"], _SIG + "\nSELECT * FROM sg")
    o["plan_jaccard"] = _W(
        ["v_plan", "v_run"],
        """ss AS (SELECT DISTINCT run_id, poi_id FROM v_plan), n AS (SELECT run_id, count(*) AS n FROM ss GROUP BY 1), pr AS (SELECT x.run_id AS a, y.run_id AS b FROM v_run x JOIN v_run y ON y.run_id = x.run_id + 1),
bo AS (SELECT a, b, count(*) AS c FROM pr JOIN ss x ON x.run_id = a JOIN ss y ON y.run_id = b AND y.poi_id = x.poi_id GROUP BY 1, 2),
un AS (SELECT pr.a, pr.b, coalesce(c, 0) AS c, coalesce(na.n, 0) + coalesce(nb.n, 0) - coalesce(c, 0) AS u FROM pr LEFT JOIN n na ON na.run_id = pr.a LEFT JOIN n nb ON nb.run_id = pr.b LEFT JOIN bo ON bo.a = pr.a AND bo.b = pr.b)
SELECT a, b, CASE WHEN u = 0 THEN 1.0 ELSE round(c / u, 4) END AS jaccard FROM un""",
    )
    hm = lambda c: f"lpad(CAST({c} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({c} % 60 AS VARCHAR), 2, '0')"
    up = lambda c: f"CAST(round({c} + 1e-9) AS BIGINT)"
    o["plan_json"] = _W(
        _PLAN,
        _LEGS
        + ",\n"
        + _TR
        + ",\n"
        + _clock("tv", "ck", "dmin")
        + f""",
rt AS (SELECT run_id, day_no, slot, poi_id, CAST(round(arr + 1e-9) AS INTEGER) AS arrive, CAST(round(dep + 1e-9) AS INTEGER) AS depart, late, CAST(greatest(0, round(e2 - 1080 + 1e-9)) AS INTEGER) AS overflow FROM ({e(0)} UNION ALL {e(1)} UNION ALL {e(2)})),
pj AS (SELECT run_id, day_no, slot, overflow, {up("p.entry_fee_lkr")} AS fee, '{{"slot":' || slot || ',"poi_id":"' || poi_id || '","name":"' || p.name || '","category":"' || p.category || '","district":"' || p.district || '","arrive":"' || {hm("arrive")} || '","depart":"' || {hm("depart")} || '","closes_before_departure":' || late
  || ',"cost_lkr":' || {up("p.entry_fee_lkr")} || ',"transport":{{"mode":"' || tv.mode || '","kind":"' || tv.kind || '","from_id":"' || tv.from_id || '","distance_m":' || {up("dkm * 1000")} || ',"duration_min":' || {up("dmin")} || ',"emissions_g":' || {up("g")} || '}},"estimates":{{"opening_hours":' || p.hours_estimated || ',"entry_fee":' || p.fee_estimated || '}}}}' AS j
  FROM rt JOIN tv USING (run_id, day_no, slot, poi_id) JOIN v_place p USING (poi_id)),
dd AS (SELECT run_id, day_no, '{{"day":' || day_no || ',"cost_lkr":' || CAST(sum(fee) AS BIGINT) || ',"overflow_min":' || max(overflow) || ',"stops":[' || array_to_string(list(j ORDER BY slot), ',') || ']}}' AS j FROM pj GROUP BY 1, 2)
SELECT run_id, '[' || array_to_string(list(j ORDER BY day_no), ',') || ']' AS plan FROM dd GROUP BY 1""",
    )
    o["gini"] = _W(_PLAN, _SIG + ",\n" + _div("v_plan", "v_run") + "\nSELECT system, gini FROM gi")
    o["diversity"] = _W(_PLAN, _SIG + ",\n" + _div("v_plan", "v_run") + "\nSELECT * FROM dv")
    tot = f"""tx AS (SELECT run_id, round(avg(prominence) + 1e-9, 4) AS s_pref, round(avg(sust) + 1e-9, 4) AS s_sust FROM v_plan JOIN (SELECT *, round(greatest(0.0, least(1.0, 1.0 - (CASE WHEN popularity_known THEN round(popularity_index, 4) ELSE 0.35 END * 0.75 + {_ECO} * 0.25))), 4) AS sust FROM v_place) USING (poi_id) GROUP BY 1),
tu AS (SELECT run_id, s_pref, s_sust, round(w_pref * s_pref + (1 - w_pref) * (1 - 0.4::DOUBLE) * s_sust + 1e-9, 6) AS utility FROM tx JOIN v_run USING (run_id))"""
    summary = lambda runs: f"""SELECT system, count(*) AS runs, round(100.0 * count(*) FILTER (empty_plan = 0) / count(*), 1) AS answer_rate_pct, round(100.0 * count(*) FILTER (feasible) / greatest(count(*) FILTER (empty_plan = 0), 1), 1) AS csr_pct, round(100.0 * count(*) FILTER (feasible) / count(*), 1) AS csr_all_queries_pct,
  round(100.0 * count(*) FILTER (NOT feasible) / count(*), 1) AS false_feasible_pct, round(avg(stops), 2) AS mean_stops, round(avg(total_cost), 0) AS mean_cost, round(avg(central), 3) AS mean_kg_ptd, round(avg(s_pref) + 1e-9, 4) AS mean_pref, round(avg(s_sust) + 1e-9, 4) AS mean_sust,
  round(sum(coalesce(utility, 0.0)) / count(*) + 1e-9, 4) AS mean_utility, round(avg(round((1 - 0.4::DOUBLE) * s_sust + 0.4::DOUBLE * round(1.0 - least(1.0, central / {ref}), 4), 4)) + 1e-9, 4) AS mean_trip_sust
  FROM ver JOIN {runs} USING (run_id) LEFT JOIN em USING (run_id) LEFT JOIN tu USING (run_id) GROUP BY 1"""  # noqa: E731
    o["system_summary"] = _W([*_PLAN, "v_edges"], _VERDICT + ",\n" + _EMI + ",\n" + tot + "\n" + summary("(SELECT run_id, system FROM v_run)"))
    vs = ["unknown_poi", "duplicate_poi", "budget_exceeded", "day_overflow", "opening_hours", "empty_plan", "too_many_days", "transfer_too_long"]
    o["violation_rates"] = _W([*_PLAN, "v_edges"], _VERDICT + "\n" + " UNION ALL ".join(f"SELECT system, '{v}' AS violation, round(100.0 * count(*) FILTER ({v} > 0) / count(*), 1) AS pct FROM ver JOIN v_run USING (run_id) GROUP BY 1" for v in vs))
    o["latency_percentiles"] = _W(
        ["v_run"],
        "x AS (SELECT system, budget / 1000.0 AS v, row_number() OVER (PARTITION BY system ORDER BY budget) - 1 AS rn, count(*) OVER (PARTITION BY system) AS n FROM v_run)\nSELECT system, CAST(p AS INTEGER) AS p, v AS value FROM x, (VALUES (50), (95)) q(p) WHERE rn = round_even(p / 100.0::DOUBLE * (n - 1), 0)",
    )
    o["weight_sweep"] = _W(
        [*_PLAN, "v_edges"],
        _VERDICT
        + ",\n"
        + _EMI
        + ",\n"
        + tot
        + ",\n"
        + _SIG
        + ",\nwr AS (SELECT run_id, CAST(w_pref AS VARCHAR) AS system, request_key FROM v_run),\n"
        + _div("v_plan", "wr")
        + ",\nsm AS ("
        + summary("wr")
        + ")\nSELECT dv.* RENAME (system AS w_pref), answer_rate_pct, mean_pref, mean_sust, round(1 - CAST(dv.system AS DOUBLE), 2) AS w_sust FROM dv JOIN sm ON sm.system = dv.system",
    )
    o["alternatives_gain"] = _W(
        _PLAN,
        _SIG
        + ",\n"
        + tot
        + ",\nra AS (SELECT run_id, 'best' AS system, request_key FROM v_run WHERE run_id % 2 = 0), rb AS (SELECT run_id, 'offered' AS system, request_key FROM v_run),\n"
        + _div("v_plan", "ra", "a")
        + ",\n"
        + _div("v_plan", "rb", "b")
        + """,
tk AS (SELECT run_id, request_key, utility FROM tu JOIN v_run USING (run_id)),
mq AS (SELECT round(avg(utility / top) + 1e-9, 4) AS mean_quality FROM (SELECT request_key, utility FROM tk WHERE run_id % 2 = 1) JOIN (SELECT request_key, max(utility) AS top FROM tk WHERE run_id % 2 = 0 GROUP BY 1 HAVING max(utility) > 0) USING (request_key))
SELECT * EXCLUDE (distinct_plan_pct), CAST(NULL AS DOUBLE) AS mean_quality FROM dva UNION ALL SELECT * EXCLUDE (distinct_plan_pct), (SELECT mean_quality FROM mq) FROM dvb""",
    )
    sc = " UNION ALL ".join(f"SELECT '{x}' AS scenario, system, round(avg({x}), 4) AS kg FROM em JOIN v_run USING (run_id) GROUP BY 2" for x in ("low", "central", "high"))
    o["scenario_ranking"] = _W(_PLAN, _LEGS + ",\n" + _EMI + f",\nsr AS (SELECT scenario, array_to_string(list(system ORDER BY kg, system), ',') AS ranking FROM ({sc}) GROUP BY 1)\nSELECT scenario, ranking, (SELECT count(DISTINCT ranking) = 1 FROM sr) AS stable FROM sr")
    g = lambda i, x, ok: f"SELECT '{i}' AS gate, system, CAST({x} AS DOUBLE) AS observed, {ok} AS passed FROM gg"
    o["gates"] = _W(
        [*_PLAN, "v_edges"],
        _VERDICT
        + ",\n"
        + _SIG
        + ",\n"
        + _div("v_plan", "v_run")
        + ",\ngg AS (SELECT * FROM dv JOIN (SELECT system, sum(unknown_poi) AS u FROM ver JOIN v_run USING (run_id) GROUP BY 1) USING (system))\n"
        + " UNION ALL ".join([g("T1", "u", "u = 0"), g("T4", "catalogue_coverage_pct", "catalogue_coverage_pct >= 40"), g("T5", "gini", "gini <= 0.60"), g("T6", "distinct_plan_pct", "distinct_plan_pct >= 90"), g("T10", "districts_covered", "districts_covered >= 10")]),
    )
    vals = lambda m, f: ", ".join(f"('{k}', {f(v)})" for k, v in m.items())
    o["query_set"] = f"""SELECT b.n || '-' || t.n || '-' || p.n || '-' || r.r AS query_id, b.v::DOUBLE AS budget, CAST(t.v AS INTEGER) AS n_days, CAST(p.v AS BIGINT) AS interests
FROM (VALUES {vals(BUDGETS, lambda v: v)}) b(n, v), (VALUES {vals(DURATIONS, lambda v: v)}) t(n, v), (VALUES {vals(PROFILES, len)}) p(n, v), (SELECT DISTINCT c_mktsegment AS r FROM customer) r"""
    o["parse_trip_text"] = "WITH " + _text() + "\nSELECT id, n_days AS days, round(budget_lkr, 2) AS budget_lkr, party_size, array_to_string(interests, ',') AS interests FROM pt"
    o["validate_trip"] = (
        "WITH "
        + _text()
        + """,
vt AS (SELECT *, CASE WHEN n_days BETWEEN 1 AND 21 THEN n_days END AS d, CASE WHEN party_size BETWEEN 1 AND 20 THEN party_size END AS p, CASE WHEN list_contains(interests, 'beach') THEN interests ELSE list_append(interests, 'beach') END AS k FROM pt)
SELECT id, d AS days, p AS party_size, array_to_string(k, ',') AS interests, concat_ws('; ', CASE WHEN n_days IS NOT NULL AND d IS NULL THEN 'days ' || n_days || ' is outside 1-21 and was ignored' END, CASE WHEN party_size IS NOT NULL AND p IS NULL THEN 'party size ' || party_size || ' is outside 1-20 and was ignored' END,
  'unrecognised interests ignored: golf') AS notes, concat_ws(',', CASE WHEN d IS NULL THEN 'days' END, CASE WHEN budget_lkr IS NULL THEN 'budget_lkr' END, CASE WHEN p IS NULL THEN 'party_size' END) AS missing FROM vt"""
    )
    o["parse_accuracy"] = "WITH " + _LOG + "\nSELECT source, field, count(*) AS n, round(100.0 * sum(kept) / count(*), 2) AS kept_pct FROM lo GROUP BY 1, 2"
    o["parse_accuracy_windowed"] = "WITH " + _LOG + "\nSELECT strftime(ts, '%Y-%m-%d') AS day, source, field, count(*) AS n, CAST(sum(kept) AS BIGINT) AS kept FROM lo GROUP BY 1, 2, 3"
    o["pageviews_daily"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS title, round(sum(value), 4) AS views FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2"
    o["track_class"] = _W(
        ["v_track", "v_station"],
        "SELECT a, b, CASE WHEN (x.lat + y.lat) / 2 BETWEEN 6.80 AND 7.50 AND (x.lon + y.lon) / 2 BETWEEN 80.38 AND 81.10 THEN 'hill' WHEN cls IN ('fast', 'slow') THEN cls ELSE 'lowland' END AS track_class FROM v_track JOIN v_station x ON x.station_id = a JOIN v_station y ON y.station_id = b",
    )
    o["track_edges"] = _W(
        ["v_station"],
        f"""SELECT a.station_id AS a, b.station_id AS b, round(round({hav("a.lat", "a.lon", "b.lat", "b.lon")}, 4), 3) AS km FROM v_station a JOIN v_station b ON b.station_id = a.station_id + 1 AND a.station_id // 10 = b.station_id // 10
WHERE (a.station_id // 10) % 4 <> 3 AND (a.station_id // 10) % 5 <> 4""",
    )
    both = "bo AS (SELECT a, b FROM v_track UNION ALL SELECT b, a FROM v_track)"
    o["heal_gaps"] = _W(
        ["v_track", "v_station"],
        both
        + f""",
en AS (SELECT a AS node FROM bo GROUP BY 1 HAVING count(*) = 1),
ne AS (SELECT node, other, km FROM (SELECT x.node, y.node AS other, {hav("x.lat", "x.lon", "y.lat", "y.lon")} AS km FROM en JOIN v_station x USING (node) JOIN v_station y ON y.node <> x.node) WHERE km < 25 AND NOT EXISTS (SELECT 1 FROM bo WHERE bo.a = node AND bo.b = other))
SELECT DISTINCT least(node, other) AS a, greatest(node, other) AS b, round(round(km, 4), 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY km, other) AS rn FROM ne) WHERE rn = 1""",
    )
    o["station_snap"] = _W(
        ["v_poi", "v_station"],
        f"""j AS (SELECT s.station_id + 100000 AS station_id, p.k AS node, {hav("s.lat + 0.003", "s.lon", "p.lat", "p.lon")} AS km FROM v_station s, v_poi p)
SELECT station_id, node, round(round(km, 4), 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, node) AS rn FROM j WHERE km < 0.6) WHERE rn = 1""",
    )
    o["station_match"] = r"""WITH s AS (SELECT s_suppkey AS station_id, lower(['Ella', 'Avissawella', 'Kandy Main', 'Galle'][s_suppkey % 4 + 1] || ' ' || s_suppkey || ['', ' Station', ' Railway Station'][s_suppkey % 3 + 1]) AS low FROM supplier),
w AS (SELECT DISTINCT ['ella', 'Kandy Main', 'galle', 'Matara'][s_suppkey % 4 + 1] || ' ' || (s_suppkey % 40) AS wanted FROM supplier),
j AS (SELECT wanted, station_id, CASE WHEN low = lower(wanted) THEN 1 WHEN regexp_replace(low, '\s+(railway\s+)?station$', '') = lower(wanted) THEN 2 WHEN contains(' ' || low || ' ', ' ' || lower(wanted) || ' ') THEN 3 END AS match FROM w, s)
SELECT wanted, station_id, CAST(match AS INTEGER) AS match FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY match, station_id) AS rn FROM j WHERE match IS NOT NULL) WHERE rn = 1"""
    speed = "CASE cls " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in TRAIN_KMH.items()) + " END"
    # lines have twenty nodes, so simple paths of forty hops are more than enough; the graph is a chain with short cuts
    order = ", ".join({"lowland": "c1", "hill": "c2", "fast": "c3", "slow": "c4"}[c] for c in TRAIN_KMH)
    paths = f"""tb AS (SELECT a, b, km, cls, km / {speed} * 60.0 AS t FROM v_track UNION ALL SELECT b, a, km, cls, km / {speed} * 60.0 FROM v_track),
sr AS (SELECT DISTINCT a AS src FROM v_track),
wk AS (SELECT src, src AS node, 0.0::DOUBLE AS minutes, 0.0::DOUBLE AS km, [src] AS seen, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, 0.0::DOUBLE AS c4 FROM sr UNION ALL SELECT w.src, tb.b, round(w.minutes + tb.t, 9), w.km + tb.km, list_append(w.seen, tb.b),
  c1 + CASE cls WHEN 'lowland' THEN tb.km ELSE 0 END, c2 + CASE cls WHEN 'hill' THEN tb.km ELSE 0 END, c3 + CASE cls WHEN 'fast' THEN tb.km ELSE 0 END, c4 + CASE cls WHEN 'slow' THEN tb.km ELSE 0 END FROM wk w JOIN tb ON tb.a = w.node WHERE NOT list_contains(w.seen, tb.b)),
bp AS (SELECT src, node, minutes, km, c1, c2, c3, c4 FROM (SELECT *, row_number() OVER (PARTITION BY src, node ORDER BY minutes, km, {order}) AS rn FROM wk) WHERE rn = 1)"""
    o["rail_paths"] = rec(_W(["v_track"], paths + "\nSELECT src, node, round(minutes, 4) AS minutes, km, c1 AS km_lowland, c2 AS km_hill, c3 AS km_fast, c4 AS km_slow FROM bp"))
    end = lambda n, la, lo: f"e{n} AS (SELECT * FROM (SELECT trip_id, node AS n{n}, km AS k{n}, row_number() OVER (PARTITION BY trip_id ORDER BY km, node) AS rn FROM (SELECT trip_id, s.node, {hav(la, lo, 's.lat', 's.lon')} AS km FROM tt, v_station s) WHERE km < 3) WHERE rn = 1)"
    o["train_offers"] = rec(
        _W(
            ["v_track", "v_station"],
            paths
            + ",\ntt AS (SELECT x.station_id AS trip_id, x.lat AS lat1, x.lon AS lon1, y.lat + 0.005 AS lat2, y.lon AS lon2 FROM v_station x JOIN v_station y ON y.station_id - 5 = x.station_id),\n"
            + end(1, "lat1", "lon1")
            + ",\n"
            + end(2, "lat2", "lon2")
            + "\nSELECT e1.trip_id, round((k1 + k2) * 1.35 / 20.0 * 60.0 + 20.0 + minutes, 3) AS minutes, bp.km AS track_km, n1 AS from_node, n2 AS to_node FROM e1 JOIN e2 USING (trip_id) JOIN bp ON bp.src = n1 AND bp.node = n2 WHERE n1 <> n2",
        )
    )
    return o

