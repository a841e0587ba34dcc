"""The same queries and views in DuckDB SQL."""

from __future__ import annotations

from .sources.dims import CATEGORIES, CATEGORY_DEFAULTS, ECO_COST, EMISSIONS, GRADES, PROMINENCE, STAY_TYPES
from .sources.osm import CHARGES, HOURS, TAG_PAIRS
from .sources.views import GRADE_NAMES, TYPE_NAMES


def lst(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


def case(expr: str, values: dict, default: str) -> str:
    num = lambda v: f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {num(v)}" for k, v in values.items()) + f" ELSE {default} END"


def hav(a: str, b: str, c: str, d: str) -> str:
    """Kilometres between (a, b) and (c, d)."""
    return f"(2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)))))"


def mode(km: str) -> str:
    return f"CASE WHEN {km} <= 1.5 THEN 'walk' WHEN {km} <= 6.0 THEN 'tuktuk' WHEN {km} < 60.0 THEN 'bus' ELSE 'car_shared' END"


def kg(m: str, km: str, party: str, scenario: str = "central") -> str:
    at = {"low": 3, "central": 4, "high": 5}[scenario]
    out = []
    for name, f in EMISSIONS.items():
        v = f"{km} * {f[at]}" if f[0] == "pkm" else f"{km} * {f[at]} / {f[2]}.0" if f[2] else f"{km} * {f[at]} * ceil({party} / {f[1]}.0) / {party}"
        out.append(f"WHEN {m} = '{name}' THEN {v}")
    return f"(CASE WHEN {km} <= 0 THEN 0.0 {' '.join(out)} ELSE 0.0 END)"


_default = lambda i: {c: v[i] for c, v in CATEGORY_DEFAULTS.items()}

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_poi": (
        [],
        f"""SELECT p_partkey AS k, 'node/' || p_partkey AS poi_id, p_name AS name,
  5.85 + ((p_partkey * 7919) % 4050) / 1000.0 AS lat, 79.60 + ((p_partkey * 104729) % 2350) / 1000.0 AS lon,
  {lst(CATEGORIES)}[p_partkey % 8 + 1] AS category,
  CASE WHEN p_partkey % 10 = 0 THEN 360 + 5 * p_size END AS open_raw, CASE WHEN p_partkey % 10 = 0 THEN 1440 - 6 * p_size END AS close_raw,
  CASE WHEN p_partkey % 7 = 0 THEN round(2.5 * p_retailprice, 2) END AS fee_raw, p_size % 13 AS tag_count,
  CASE WHEN p_partkey % 9 = 0 THEN 'Q' || p_partkey END AS wikidata, CASE WHEN p_partkey % 11 = 0 THEN 'en:T ' || (p_partkey % 100) END AS wikipedia,
  p_partkey % 97 = 0 AS unesco,
  '{{' || concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN '"tourism":"attraction"' END, CASE WHEN p_partkey % 4 = 1 THEN '"historic":"ruins"' END,
    CASE WHEN p_partkey % 5 = 0 THEN '"website":"w"' END, CASE WHEN p_partkey % 8 = 1 THEN '"boundary":"protected_area"' END) || '}}' AS osm_tags_kept
FROM part""",
    ),
    "v_imputed": (
        ["v_poi"],
        f"""SELECT * EXCLUDE (open_raw, close_raw, fee_raw), coalesce(open_raw, {case("category", _default(1), "NULL")}) AS open_min,
  coalesce(close_raw, {case("category", _default(2), "NULL")}) AS close_min, open_raw IS NULL AS hours_estimated,
  coalesce(fee_raw, {case("category", _default(3), "NULL")}) AS entry_fee_lkr, fee_raw IS NULL AS fee_estimated,
  {case("category", _default(0), "NULL")} AS typical_dwell_min, true AS dwell_estimated, 'unknown' AS eco_certified, 'unknown' AS community_run
FROM v_poi""",
    ),
    "v_place": (
        ["v_imputed"],
        f"""SELECT q.*, n_name AS district FROM (SELECT p.*, k % 11 = 0 AS popularity_known, CASE WHEN k % 11 = 0 THEN 'wikipedia' ELSE 'none' END AS popularity_source,
  CASE WHEN k % 11 = 0 THEN ((k * 37) % 100) / 100.0 ELSE 0.0 END AS popularity_index, (k % 11) / 10.0 AS rail_access_score,
  round(greatest(0.0, least(1.0, least(12, greatest(0, tag_count)) / 12.0 * 0.25
    + CASE WHEN contains(osm_tags_kept, '"tourism"') THEN 0.20 ELSE 0.0 END + CASE WHEN contains(osm_tags_kept, 'website') THEN 0.12 ELSE 0.0 END
    + CASE WHEN NOT hours_estimated THEN 0.12 ELSE 0.0 END + CASE WHEN NOT fee_estimated THEN 0.08 ELSE 0.0 END
    + CASE WHEN contains(osm_tags_kept, '"historic"') THEN 0.08 ELSE 0.0 END + CASE WHEN contains(osm_tags_kept, 'protect') THEN 0.08 ELSE 0.0 END
    + (k % 11) / 10.0 * 0.10 + CASE WHEN wikidata IS NOT NULL THEN 0.20 ELSE 0.0 END + CASE WHEN wikipedia IS NOT NULL THEN 0.15 ELSE 0.0 END
    + CASE WHEN unesco THEN 0.25 ELSE 0.0 END + {case("category", PROMINENCE, "0.0")})), 4) AS prominence,
  CAST(least(floor((lon - 79.60) / 0.47), 4) + 5 * least(floor((lat - 5.85) / 0.81), 4) AS INTEGER) AS district_no
FROM v_imputed p) q JOIN nation ON n_nationkey = district_no""",
    ),
    "v_district": (
        [],
        """SELECT district_no, district, x0, y0, x0 + 0.47 AS x1, y0 + 0.81 AS y1, y0 + 0.405 AS lat, x0 + 0.235 AS lon FROM (
SELECT n_nationkey AS district_no, n_name AS district, 79.60::DOUBLE + 0.47::DOUBLE * (n_nationkey % 5) AS x0, 5.85::DOUBLE + 0.81::DOUBLE * floor(n_nationkey / 5) AS y0 FROM nation)""",
    ),
    "v_acc": (
        [],
        f"""SELECT c_custkey AS k, 'sltda/' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS acc_id, c_name AS name, {lst(TYPE_NAMES)}[c_custkey % 12 + 1] AS sltda_type,
  CAST(1 + (c_custkey * 37) % 300 AS INTEGER) AS rooms, CASE WHEN c_custkey % 13 < 11 THEN {lst(GRADE_NAMES)}[c_custkey % 11 + 1] END AS grade,
  c_nationkey AS district_no, CAST(c_nationkey * 4 + c_custkey % 4 AS INTEGER) AS division_no,
  CASE WHEN c_custkey % 3 <> 0 THEN 5.85 + ((c_custkey * 6151) % 4050) / 1000.0 END AS lat,
  CASE WHEN c_custkey % 3 <> 0 THEN 79.60 + ((c_custkey * 15485) % 2350) / 1000.0 END AS lon
FROM customer""",
    ),
    "v_scored": (
        ["v_acc"],
        f"""SELECT s.*, round(1.0 - sustainability_score, 4) AS acc_impact FROM (
SELECT t.*, round(greatest(0.0, least(1.0, 0.65 * category_score + 0.35 * size_score + grade_adj)), 4) AS sustainability_score FROM (
SELECT a.*, {case("sltda_type", {k: v[0] for k, v in STAY_TYPES.items()}, "0.5::DOUBLE")} AS category_score, {case("sltda_type", {k: v[1] for k, v in STAY_TYPES.items()}, "10000.0::DOUBLE")} AS rate,
  greatest(0.0, least(1.0, 1.0 - (ln(greatest(1.0, least(300.0, coalesce(rooms, (SELECT median(rooms) FROM v_acc))))) - ln(1)) / (ln(300) - ln(1)))) AS size_score,
  {case("grade", GRADES, "0.0::DOUBLE")} AS grade_adj
FROM v_acc a) t) s""",
    ),
    "v_stay": (["v_scored"], "SELECT * FROM v_scored WHERE lat IS NOT NULL"),
    "v_station": (
        [],
        """SELECT s_suppkey AS station_id, s_name AS name, 5.85 + ((s_suppkey * 7919) % 4050) / 1000.0 AS lat,
  79.60 + ((s_suppkey * 104729) % 2350) / 1000.0 AS lon, s_suppkey AS node FROM supplier""",
    ),
    "v_request": (
        [],
        f"""SELECT o_orderkey AS request_id, CAST(1 + o_orderkey % 3 AS INTEGER) AS n_days, o_totalprice AS budget, CAST(1 + o_orderkey % 4 AS INTEGER) AS party,
  6.50 + ((o_custkey * 911) % 2500) / 1000.0 AS start_lat, 79.90 + ((o_custkey * 577) % 1500) / 1000.0 AS start_lon, (o_orderkey % 5) / 4.0 AS w_pref,
  [{lst(CATEGORIES)}[o_orderkey % 8 + 1], {lst(CATEGORIES)}[(o_orderkey + 3) % 8 + 1]] AS interests
FROM orders WHERE o_orderkey % 50 = 0""",
    ),
    "v_plan": (
        [],
        """SELECT run_id, CAST(floor(rn / 3) + 1 AS INTEGER) AS day_no, CAST(rn % 3 AS INTEGER) AS slot, poi_id FROM (
SELECT l_orderkey AS run_id, 'node/' || l_partkey AS poi_id, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS rn FROM lineitem)""",
    ),
    "v_run": (
        [],
        """SELECT o_orderkey AS run_id, o_orderstatus AS system, o_totalprice AS budget, o_custkey AS request_key, CAST(1 + o_orderkey % 4 AS INTEGER) AS party,
  (o_orderkey % 5) / 4.0 AS w_pref, CAST(1 + o_orderkey % 4 AS INTEGER) AS n_days, 6.50 + ((o_custkey * 911) % 2500) / 1000.0 AS start_lat,
  79.90 + ((o_custkey * 577) % 1500) / 1000.0 AS start_lon FROM orders""",
    ),
    "v_views": ([], "SELECT user_id AS title, CAST(hour(ts) AS INTEGER) AS period, sum(value) AS views FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL"),
    "v_track": (
        [],
        """SELECT s_suppkey AS a, s_suppkey + 1 AS b, CAST(1 + (s_suppkey * 13) % 20 AS DOUBLE) AS km, ['lowland', 'hill', 'fast', 'slow'][s_suppkey % 4 + 1] AS cls FROM supplier WHERE s_suppkey % 20 <> 19
UNION ALL SELECT s_suppkey, s_suppkey + 7, CAST(5 + (s_suppkey * 17) % 30 AS DOUBLE), 'lowland' FROM supplier WHERE s_suppkey % 10 = 2 AND s_suppkey % 20 < 10""",
    ),
    "v_edges": (
        ["v_poi"],
        f"""SELECT ka, kb, from_id, to_id, round(km, 2) AS distance_km, round(km * 1.35 / 35.0 * 60.0, 1) AS duration_min, CASE WHEN ka % 6 = 0 THEN 'osrm' ELSE 'haversine' END AS method FROM (
SELECT a.k AS ka, b.k AS kb, a.poi_id AS from_id, b.poi_id AS to_id, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS km FROM v_poi a JOIN v_poi b ON b.k IN (a.k + 1, a.k + 2))""",
    ),
    "v_osm": (
        ["v_poi"],
        f"""SELECT CASE WHEN k % 4 = 0 THEN 'way' ELSE 'node' END AS type, k AS id,
  CASE WHEN k % 53 <> 0 THEN CASE WHEN k % 59 = 0 THEN 13.08 ELSE lat END END AS lat, CASE WHEN k % 53 <> 0 THEN lon END AS lon,
  map_from_entries(list_filter([
    {{'key': 'name', 'value': CASE WHEN k % 61 <> 0 THEN CASE WHEN k % 43 = 0 THEN 'ATM ' || name ELSE name END END}},
    {{'key': 'name:en', 'value': CASE WHEN k % 5 = 0 AND k % 61 <> 0 AND k % 43 <> 0 THEN name || ' EN' END}},
    {{'key': {lst(p[0] for p in TAG_PAIRS)}[k % 16 + 1], 'value': {lst(p[1] for p in TAG_PAIRS)}[k % 16 + 1]}},
    {{'key': coalesce({lst(p[2] for p in TAG_PAIRS)}[k % 16 + 1], '-'), 'value': {lst(p[3] for p in TAG_PAIRS)}[k % 16 + 1]}},
    {{'key': 'opening_hours', 'value': {lst(HOURS)}[k % 7 + 1]}},
    {{'key': 'charge', 'value': {lst(CHARGES)}[k % 6 + 1]}},
    {{'key': 'fee', 'value': CASE WHEN k % 4 = 1 THEN 'no' END}},
    {{'key': 'heritage:operator', 'value': CASE WHEN k % 97 = 0 THEN 'whc' END}},
    {{'key': 'wikidata', 'value': wikidata}}, {{'key': 'wikipedia', 'value': wikipedia}}], lambda p: p['value'] IS NOT NULL)) AS tags
FROM v_poi""",
    ),
}


def _category() -> str:
    from .sources.dims import CATEGORY_RULES

    out = []
    for c, hits, needs in CATEGORY_RULES:
        hit = " OR ".join(f"coalesce(tags['{k}'] IN ({', '.join(chr(39) + x + chr(39) for x in v)}), false)" for k, v in hits)
        need = " AND (" + " OR ".join(f"coalesce(tags['{k}'] <> '', false)" for k in needs) + ")" if needs else ""
        out.append(f"WHEN ({hit}){need} THEN '{c}'")
    return "CASE " + " ".join(out) + " END"


_NAME = "coalesce(" + ", ".join(f"CASE WHEN length(trim(tags['{k}'])) >= 3 THEN trim(tags['{k}']) END" for k in ("name:en", "name", "int_name", "official_name")) + ")"
_RANGE = r"(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})"
VIEWS["v_exam"] = (
    ["v_osm"],
    f"""SELECT *, CASE WHEN name IS NULL THEN 'no_name' WHEN regexp_matches(name, '(?i)^(bus|petrol|fuel|atm|toilet)|^untitled|^unnamed') THEN 'excluded'
  WHEN lat IS NULL OR lon IS NULL THEN 'no_coords' WHEN NOT (lat BETWEEN 5.85 AND 9.90 AND lon BETWEEN 79.60 AND 81.95) THEN 'out_of_bbox'
  WHEN category IS NULL THEN 'no_category' END AS reject_reason
FROM (SELECT type || '/' || id AS poi_id, id, {_NAME} AS name, lat, lon, {_category()} AS category, tags FROM v_osm)""",
)
VIEWS["v_hours"] = (
    ["v_osm"],
    f"""SELECT id, always, list_filter(list_transform(r, lambda x: {{'o': x['o'], 'c': CASE WHEN x['c'] <= x['o'] THEN x['c'] + 1440 ELSE x['c'] END}}), lambda x: x['o'] <= 1440 AND x['c'] <= 2880) AS ok FROM (
SELECT id, t IN ('24/7', '24 hours', '24hrs') AS always, list_transform(range(1, len(h1) + 1), lambda i: {{'o': CAST(h1[i] AS INTEGER) * 60 + CAST(m1[i] AS INTEGER), 'c': CAST(h2[i] AS INTEGER) * 60 + CAST(m2[i] AS INTEGER)}}) AS r FROM (
SELECT id, t, regexp_extract_all(t, '{_RANGE}', 1) AS h1, regexp_extract_all(t, '{_RANGE}', 2) AS m1, regexp_extract_all(t, '{_RANGE}', 3) AS h2, regexp_extract_all(t, '{_RANGE}', 4) AS m2
FROM (SELECT id, lower(trim(coalesce(tags['opening_hours'], ''))) AS t FROM v_osm)))""",
)
VIEWS["v_parsed"] = (
    ["v_hours", "v_osm"],
    """SELECT o.id, o.tags, CASE WHEN always THEN 0 WHEN len(ok) > 0 THEN list_min(list_transform(ok, lambda x: x['o'])) END AS open_min,
  CASE WHEN always THEN 1440 WHEN len(ok) > 0 THEN list_max(list_transform(ok, lambda x: least(x['c'], 1440))) END AS close_min,
  coalesce(TRY_CAST(replace(regexp_extract(coalesce(tags['charge'], tags['fee:amount']), '(\\d[\\d,\\.]*)', 1), ',', '') AS DOUBLE)
    * CASE WHEN contains(lower(coalesce(tags['charge'], tags['fee:amount'])), 'usd') THEN 300 ELSE 1 END, CASE WHEN lower(tags['fee']) IN ('no', 'false') THEN 0.0 END) AS fee
FROM v_osm o JOIN v_hours h ON o.id = h.id""",
)


def with_views(needs: list[str], body: str) -> str:
    """``body`` under the views it needs, and theirs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in VIEWS[name][0]:
                add(x)
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body.lstrip()


def all_oracles() -> dict[str, str]:
    from . import oracles_places, oracles_plans

    return {**oracles_places.oracles(), **oracles_plans.oracles()}
