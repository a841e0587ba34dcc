"""SQL of the place queries."""

from __future__ import annotations

from .oracles import hav, lst, with_views
from .sources.dims import DISTRICT_ALIASES, DISTRICTS, ECO_COST

_W = with_views


def _canonical() -> str:
    flat = {n.lower().replace(" ", ""): n for n in DISTRICTS}
    return (
        "CASE WHEN k2 = '' THEN NULL "
        + " ".join(f"WHEN k2 = '{a}' THEN '{b}'" for a, b in DISTRICT_ALIASES.items())
        + " "
        + " ".join(f"WHEN sq = '{f}' THEN '{n}'" for f, n in flat.items())
        + " "
        + " ".join(f"WHEN starts_with(sq, '{f[:6]}') THEN '{n}'" for f, n in flat.items())
        + " END"
    )


_TITLE = "CASE WHEN {t} <> '' THEN CASE WHEN contains({t}, ':') THEN CASE WHEN lower(trim(split_part({t}, ':', 1))) = 'en' THEN replace(trim(substr({t}, strpos({t}, ':') + 1)), ' ', '_') END ELSE replace(trim({t}), ' ', '_') END END"
_LATIN = "trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))"
_DUP = """dup AS (SELECT k, poi_id, name, lat, lon FROM v_poi UNION ALL SELECT k, 'way/' || k, name || ' ව', lat + 0.0005, lon + 0.0005 FROM v_poi WHERE k % 5 = 0)"""
_SEG = """seg AS (SELECT district, x1 AS sx, y0 AS sy, x1 AS ex, y1 AS ey FROM v_district UNION ALL SELECT district, x0, y0, x1, y0 FROM v_district
UNION ALL SELECT district, x0, y1, x0, y0 FROM v_district UNION ALL SELECT district, x1, y1, x0, y1 FROM v_district)"""
_REF = """acc AS (SELECT s.k, s.lat, s.lon, d.district FROM v_stay s JOIN v_district d USING (district_no) WHERE s.k % 4 = 1),
ref AS (SELECT k AS sid, lat, lon, district, 1.0::DOUBLE AS weight FROM acc
  UNION ALL SELECT -district_no - 1, lat, lon, d.district, 0.25::DOUBLE FROM v_district d LEFT JOIN (SELECT district, count(*) AS n FROM acc GROUP BY 1) c ON c.district = d.district WHERE coalesce(n, 0) < 8)"""
_PHOTO = f"""ph AS (SELECT lat, lon FROM v_acc WHERE lat IS NOT NULL UNION ALL SELECT lat + 0.002, lon FROM v_station),
near AS (SELECT p.poi_id AS pid, min({hav("p.lat", "p.lon", "h.lat", "h.lon")}) * 1000 AS m FROM v_poi p JOIN ph h ON abs(p.lat - h.lat) < 0.01 AND abs(p.lon - h.lon) < 0.01 GROUP BY 1),
pic AS (SELECT p.poi_id AS pid, CASE WHEN p.wikipedia IS NOT NULL THEN 'wikipedia' WHEN m <= 300 THEN 'nearby_300m' WHEN m <= 1000 THEN 'nearby_1km' ELSE 'none' END AS image_source,
  CASE WHEN p.wikipedia IS NOT NULL THEN 0.0 WHEN m <= 1000 THEN round(m, 1) END AS image_distance_m FROM v_poi p LEFT JOIN near ON near.pid = p.poi_id)"""
_TOKENS = "array_to_string(list_sort(list_filter(string_split(latin, ' '), lambda x: x <> '')), ' ')"
_CENTROID = "c AS (SELECT * FROM (SELECT p.poi_id, d.district_no, {h} AS km, row_number() OVER (PARTITION BY p.poi_id ORDER BY {h}, d.district_no) AS rn FROM v_poi p, v_district d) WHERE rn = 1)".format(h=hav("p.lat", "p.lon", "d.lat", "d.lon"))
_KANDY = hav("lat", "lon", "7.2906", "80.6337")
_PAIR = f"""ps AS (SELECT ka AS a, kb AS b, round(km, 3) AS km FROM (SELECT a.k AS ka, b.k AS kb, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS km FROM v_poi a JOIN v_poi b ON b.k = (a.k * 7919 + 13) % 1999)
  WHERE km BETWEEN 5 AND 150 ORDER BY (ka * 104729 + kb * 31) % 100003, ka LIMIT 40)"""


def _share(rel: str, col: str) -> str:
    return f"SELECT {col} AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {rel}), 2) AS share_pct FROM {rel} GROUP BY {col}"


def oracles() -> dict[str, str]:
    o = {}
    o["osm_scan"] = _W(["v_osm"], "SELECT type, id, round(lat, 6) AS lat, CAST(cardinality(tags) AS BIGINT) AS n_tags FROM v_osm")
    o["latest_snapshot"] = _W(["v_poi"], "SELECT poi_id, '2026-03-15' AS extract_date FROM v_poi WHERE k % 3 = 2")
    o["register_load"] = _W(
        ["v_acc"],
        "SELECT acc_id, trim(name) AS name, CASE WHEN k % 5 = 0 THEN NULL ELSE upper(grade) END AS grade, CASE WHEN k % 17 = 0 THEN NULL ELSE rooms END AS rooms FROM v_acc",
    )
    o["node_upsert"] = _W(
        ["v_poi"],
        "SELECT poi_id, CASE WHEN k % 4 = 0 THEN name || ' **' WHEN k % 2 = 0 THEN name || ' *' ELSE name END AS name, CASE WHEN k % 4 = 0 THEN 'beach' WHEN k % 2 = 0 THEN 'urban' ELSE category END AS category FROM v_poi WHERE k % 3 <> 0 OR k % 2 = 0",
    )
    o["graph_edges"] = _W(
        ["v_place", "v_stay", "v_edges"],
        """SELECT 'IN_DISTRICT' AS kind, poi_id AS a, district AS b FROM v_place UNION SELECT 'HAS_CATEGORY', poi_id, category FROM v_place UNION SELECT 'OF_TYPE', acc_id, sltda_type FROM v_stay
UNION ALL SELECT 'TRAVEL', from_id, to_id FROM v_edges WHERE ka % 3 <> 0 AND kb % 3 <> 0""",
    )
    t = _TITLE.format(t="wikipedia")
    o["fetch_worklist"] = _W(["v_poi"], f"SELECT DISTINCT {t} AS title FROM v_poi WHERE wikipedia IS NOT NULL EXCEPT SELECT {t} FROM v_poi WHERE wikipedia IS NOT NULL AND k % 3 = 0")
    o["name_pick"] = _W(["v_exam"], "SELECT id, name FROM v_exam")
    o["normalise_pois"] = _W(
        ["v_exam", "v_parsed"],
        """SELECT poi_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, category, open_min, close_min, open_min IS NOT NULL AS hours_parsed, round(fee, 2) AS entry_fee_lkr, fee IS NOT NULL AS fee_parsed,
  coalesce(e.tags['heritage:operator'] = 'whc', false) AS unesco, CAST(cardinality(e.tags) AS BIGINT) AS tag_count FROM v_exam e JOIN v_parsed p ON e.id = p.id WHERE reject_reason IS NULL""",
    )
    o["drop_stats"] = _W(["v_exam"], "SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM v_exam GROUP BY 1")
    o["categorise"] = _W(["v_exam"], "SELECT id, category FROM v_exam")
    o["opening_hours"] = _W(["v_parsed"], "SELECT id, open_min, close_min FROM v_parsed")
    o["parse_fee"] = _W(["v_parsed"], "SELECT id, round(fee, 2) AS fee FROM v_parsed")
    o["validate_coords"] = _W(
        ["v_acc"],
        "SELECT acc_id, CASE WHEN ok THEN round(lat2, 6) END AS lat, CASE WHEN ok THEN round(lon, 6) END AS lon FROM (SELECT *, lat2 BETWEEN 5.85 AND 9.90 AND lon BETWEEN 79.60 AND 81.95 AS ok FROM (SELECT *, CASE WHEN k % 10 = 1 THEN lat + 5 ELSE lat END AS lat2 FROM v_acc))",
    )
    o["required_defaults"] = _W(["v_poi"], "SELECT poi_id, wikidata, coalesce(open_raw, 480) AS open_raw, coalesce(fee_raw, 0.0) AS fee_raw, 'unknown' AS eco_certified FROM v_poi")
    one = lambda c, sp: f"SELECT '{c}' AS property, count(*) AS rows, count({c}) AS filled, {'count(' + c + ') > 0' if sp else 'count(' + c + ') = count(*)'} AS ok FROM v_place"
    o["completeness"] = _W(["v_place"], " UNION ALL ".join(one(c, c == "wikidata") for c in ("poi_id", "name", "district", "open_min", "wikidata")))
    o["browse_places"] = _W(["v_place"], "SELECT poi_id, name, prominence FROM v_place WHERE category = 'heritage' AND contains(lower(name), 'a') AND prominence >= 0.3")
    o["browse_stays"] = _W(["v_stay"], "SELECT acc_id, sltda_type, round(sustainability_score, 4) AS sustainability_score FROM v_stay WHERE contains(lower(sltda_type), 'home') AND sustainability_score >= 0.8")
    o["validate_candidates"] = _W(
        ["v_place"],
        """SELECT poi_id, concat_ws(',', CASE WHEN NOT (o2 < c2) THEN 'hours_order' END, CASE WHEN k % 23 = 0 THEN 'popularity_index' END) AS violations
FROM (SELECT *, open_min AS o2, CASE WHEN k % 19 = 0 THEN open_min ELSE close_min END AS c2 FROM v_place)""",
    )
    o["validate_requests"] = _W(["v_request"], "SELECT request_id, concat_ws(',', CASE WHEN request_id % 700 = 0 THEN 'n_days' END, CASE WHEN request_id % 900 = 0 THEN 'budget' END) AS violations FROM v_request")
    o["district_units"] = """SELECT raw, NOT regexp_matches(lower(raw), 'ds division|divisional|secretariat|province|gn division|grama|municipal|urban council|pradeshiya') AS is_district,
  regexp_replace(trim(raw), '(?i) (district|disctrict)$', '') AS stem
FROM (SELECT n_name || [' District', ' Disctrict', ' DS Division', ' Province', '', ' Municipal Council', ' district'][n_nationkey % 7 + 1] AS raw FROM nation)"""
    o["photo_filter"] = r"""SELECT title FROM (SELECT s_name || [' view.jpg', ' map.png', ' site plan.JPG', ' flag.svg', ' temple.WEBP', ' notes.pdf', ' lake.jpeg'][s_suppkey % 7 + 1] AS title FROM supplier)
WHERE regexp_matches(title, '(?i)\.(jpg|jpeg|png|webp)$') AND NOT regexp_matches(title, '(?i)\b(map|locator|diagram|plan|logo|flag|coat of arms|chart|svg|pdf|scan|document|seal)\b')"""
    o["nearest_centroid"] = _W(["v_poi", "v_district"], _CENTROID + "\nSELECT poi_id, CAST(district_no AS INTEGER) AS district_no, round(km, 3) AS km FROM c")
    o["nearest_station"] = _W(
        ["v_poi", "v_station"],
        f"""n AS (SELECT * FROM (SELECT poi_id, station_id, km, row_number() OVER (PARTITION BY poi_id ORDER BY km, station_id) AS rn FROM (SELECT p.poi_id, s.station_id, {hav("p.lat", "p.lon", "s.lat", "s.lon")} AS km FROM v_poi p, v_station s)) WHERE rn = 1)
SELECT poi_id, station_id AS nearest_station, round(km, 3) AS station_km, round(CASE WHEN x <= 2.0 THEN 1.0 WHEN x <= 8.0 THEN 1.0 - 0.4 * (x - 2.0) / 6.0 WHEN x <= 25.0 THEN 0.6 * (1.0 - (x - 8.0) / 17.0) ELSE 0.0 END, 4) AS rail_access_score
FROM (SELECT *, round(km, 6) AS x FROM n)""",
    )
    o["knn_edges"] = _W(
        ["v_poi"],
        f"""n AS (SELECT * FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY km, b) AS rn FROM (SELECT x.k AS a, y.k AS b, {hav("x.lat", "x.lon", "y.lat", "y.lon")} AS km FROM v_poi x JOIN v_poi y ON x.k <> y.k)) WHERE rn <= 25),
e AS (SELECT DISTINCT least(a, b) AS ka, greatest(a, b) AS kb FROM n)
SELECT x.poi_id AS from_id, y.poi_id AS to_id, round({hav("x.lat", "x.lon", "y.lat", "y.lon")}, 2) AS distance_km, round({hav("x.lat", "x.lon", "y.lat", "y.lon")} * 1.35 / 35.0 * 60.0, 1) AS duration_min, 'haversine' AS method
FROM e JOIN v_poi x ON x.k = ka JOIN v_poi y ON y.k = kb""",
    )
    o["district_reference"] = _W(["v_stay", "v_district"], _REF + "\nSELECT district, weight, count(*) AS n FROM ref GROUP BY ALL")
    o["district_knn_vote"] = _W(
        ["v_poi", "v_stay", "v_district"],
        _REF
        + f""",
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY km, sid) AS rn, min(km) OVER (PARTITION BY poi_id) AS first FROM (SELECT p.poi_id, r.sid, r.district, r.weight, {hav("p.lat", "p.lon", "r.lat", "r.lon")} AS km FROM v_poi p, ref r)) WHERE rn <= 7),
v AS (SELECT poi_id, district, sum(weight / greatest(km, 0.25)) AS w, min(first) AS first FROM n GROUP BY ALL),
b AS (SELECT *, sum(w) OVER (PARTITION BY poi_id) AS total, row_number() OVER (PARTITION BY poi_id ORDER BY round(w, 9) DESC, district) AS rk FROM v)
SELECT poi_id, CASE WHEN first <= 60 THEN district ELSE '-' END AS district, CASE WHEN first <= 60 THEN round(round(w, 9) / total, 3) ELSE 0.0 END AS confidence,
  CASE WHEN first <= 60 THEN 'sltda_knn' ELSE 'nearest_centroid_fallback' END AS method FROM b WHERE rk = 1""",
    )
    o["point_in_polygon"] = _W(
        ["v_poi", "v_district"],
        _SEG
        + """,
p AS (SELECT poi_id, lat, CASE WHEN k % 50 = 0 THEN lon + 2.5 ELSE lon END AS lon FROM v_poi)
SELECT poi_id, min(district) AS district FROM (SELECT poi_id, district FROM p, seg GROUP BY poi_id, district
  HAVING sum(CASE WHEN (sy > lat) <> (ey > lat) AND lon < (ex - sx) * (lat - sy) / nullif(ey - sy, 0) + sx THEN 1 ELSE 0 END) % 2 = 1) GROUP BY 1""",
    )
    o["nearest_polygon"] = _W(
        ["v_poi", "v_district"],
        _SEG
        + """,
p AS (SELECT poi_id, lat, lon + 2.5 AS lon FROM v_poi WHERE k % 50 = 0),
q AS (SELECT poi_id, district, lat, lon, sx, sy, ex - sx AS dx, ey - sy AS dy, greatest(0.0, least(1.0, ((lon - sx) * (ex - sx) + (lat - sy) * (ey - sy)) / greatest((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy), 1e-18))) AS t FROM p, seg),
r AS (SELECT poi_id, district, round(sqrt(power(lon - (sx + t * dx), 2) + power(lat - (sy + t * dy), 2)), 9) AS d FROM q)
SELECT poi_id, district, round(d, 6) AS degrees FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY d, district) AS rn FROM r) WHERE rn = 1""",
    )
    o["nearby_places"] = _W(
        ["v_poi", "v_station"],
        f"""j AS (SELECT station_id, poi_id, round(km, 4) AS km FROM (SELECT s.station_id, p.poi_id, {hav("s.lat", "s.lon", "p.lat", "p.lon")} AS km FROM v_station s, v_poi p) WHERE km <= 15)
SELECT station_id, CAST(rn AS INTEGER) AS rn, poi_id, km FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, poi_id) AS rn FROM j) WHERE rn <= 10""",
    )
    o["nearby_stays"] = _W(
        ["v_stay", "v_station"],
        f"""SELECT station_id, acc_id, round(km, 3) AS km FROM (SELECT s.station_id, a.acc_id, {hav("s.lat", "s.lon", "a.lat", "a.lon")} AS km FROM v_station s, v_stay a
WHERE a.sltda_type NOT IN ('Boutique Hotels', 'Tourist Hotels', 'Classified Hotels( 1-5 Star)', 'Boutique Villas')) WHERE km <= 20""",
    )
    o["dup_pairs"] = _W(
        ["v_poi"],
        _DUP
        + f""",
b AS (SELECT poi_id, lat, lon, {_LATIN} AS latin, floor(lat * 100 + 0.5) AS gx, floor(lon * 100 + 0.5) AS gy FROM dup)
SELECT a, b, round(m, 1) AS m, contained FROM (SELECT x.poi_id AS a, y.poi_id AS b, round({hav("x.lat", "x.lon", "y.lat", "y.lon")} * 1000, 2) AS m,
  x.latin <> '' AND y.latin <> '' AND (contains(x.latin, y.latin) OR contains(y.latin, x.latin)) AS contained FROM b x JOIN b y ON x.gx = y.gx AND x.gy = y.gy AND x.poi_id < y.poi_id) WHERE m < 200""",
    )
    o["normalise_name"] = _W(["v_poi"], _DUP + f"\nSELECT poi_id, latin, {_TOKENS} AS tokens FROM (SELECT poi_id, {_LATIN} AS latin FROM dup)")
    o["recover_coords"] = _W(
        ["v_acc"],
        """v AS (SELECT division_no, median(lat) AS la, median(lon) AS lo FROM v_acc WHERE lat IS NOT NULL GROUP BY 1), d AS (SELECT district_no, median(lat) AS la, median(lon) AS lo FROM v_acc WHERE lat IS NOT NULL GROUP BY 1)
SELECT acc_id, round(coalesce(a.lat, v.la, d.la), 6) AS lat, round(coalesce(a.lon, v.lo, d.lo), 6) AS lon, a.lat IS NULL AS location_estimated,
  CASE WHEN a.lat IS NOT NULL THEN 'sltda_published' WHEN v.la IS NOT NULL THEN 'aga_division_centroid' ELSE 'district_centroid' END AS location_method
FROM v_acc a LEFT JOIN v USING (division_no) LEFT JOIN d USING (district_no) WHERE coalesce(a.lat, v.la, d.la) IS NOT NULL""",
    )
    o["resolve_titles"] = _W(["v_poi"], f"SELECT poi_id, title FROM (SELECT poi_id, coalesce({t}, CASE WHEN k % 18 = 0 THEN 'W_' || k END) AS title FROM v_poi) WHERE title IS NOT NULL")
    o["wiki_title"] = _W(["v_poi"], f"SELECT poi_id, {_TITLE.format(t='tag')} AS title FROM (SELECT poi_id, ['en:Old Fort', 'si:Kotuwa', 'Plain Title', 'EN: Tea Hill ', ''][k % 5 + 1] AS tag FROM v_poi)")
    o["nearest_photo"] = _W(["v_poi", "v_acc", "v_station"], _PHOTO + "\nSELECT pid, image_source, image_distance_m FROM pic")
    o["photo_coverage"] = _W(["v_poi", "v_acc", "v_station"], _PHOTO + "\n" + _share("pic", "image_source"))
    o["fee_override"] = _W(
        ["v_place"],
        """r AS (SELECT * FROM (VALUES ('royal', 'museum', NULL, 5000.0), ('ivory', NULL, NULL, 1500.0), ('ivory s', NULL, NULL, 1700.0), ('blue', NULL, 'FRANCE', 900.0)) t(fragment, exclude, district, fee)),
j AS (SELECT p.poi_id, p.entry_fee_lkr, max_by(r.fee, length(r.fragment)) AS fee FROM v_place p LEFT JOIN r ON contains(lower(p.name), r.fragment) AND NOT coalesce(contains(lower(p.name), r.exclude), false) AND (r.district IS NULL OR r.district = p.district) GROUP BY 1, 2)
SELECT poi_id, CAST(coalesce(fee, entry_fee_lkr) AS DOUBLE) AS fee, fee IS NOT NULL AS overridden FROM j""",
    )
    o["haversine"] = _W(["v_poi"], f"SELECT poi_id, round({_KANDY}, 3) AS km FROM v_poi")
    o["road_estimate"] = _W(["v_poi"], f"SELECT poi_id, round(km * 1.35, 6) AS road_km, round(km * 1.35 / 35.0 * 60.0, 6) AS minutes FROM (SELECT poi_id, round({_KANDY}, 3) AS km FROM v_poi)")
    names = [*DISTRICTS, "moneragala", "Nuwara-Eliya", "KILINOCHCI", "Trincom", "Amparai District", "Nowhere", " ", "Maha  Nuwara"]
    o["canonical_district"] = _W(
        ["v_poi"],
        f"""SELECT poi_id, {_canonical()} AS district FROM (SELECT poi_id, k2, replace(k2, ' ', '') AS sq FROM (SELECT poi_id, regexp_replace(trim(replace(lower({lst(names)}[k % {len(names)} + 1]), '-', ' ')), '\\s+', ' ', 'g') AS k2 FROM v_poi))""",
    )
    o["prominence"] = _W(["v_place"], "SELECT poi_id, prominence FROM v_place")
    o["size_score"] = _W(["v_scored"], "SELECT acc_id, round(size_score, 6) AS size_score FROM v_scored")
    o["accommodation_score"] = _W(["v_scored"], "SELECT acc_id, category_score, grade_adj, sustainability_score, acc_impact FROM v_scored")
    o["rail_access"] = _W(["v_poi"], "SELECT poi_id, round(CASE WHEN x <= 2.0 THEN 1.0 WHEN x <= 8.0 THEN 1.0 - 0.4 * (x - 2.0) / 6.0 WHEN x <= 25.0 THEN 0.6 * (1.0 - (x - 8.0) / 17.0) ELSE 0.0 END, 4) AS score FROM (SELECT poi_id, (k * 7 % 3000) / 100.0 AS x FROM v_poi)")
    o["impute"] = _W(["v_imputed"], "SELECT poi_id, open_min, close_min, hours_estimated, entry_fee_lkr, fee_estimated, typical_dwell_min, eco_certified FROM v_imputed")
    eco = "CASE category " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in ECO_COST.items()) + " ELSE 0.3::DOUBLE END"
    o["place_sustainability"] = _W(["v_place"], f"SELECT poi_id, cc AS crowding_cost, ec AS eco_cost, round(greatest(0.0, least(1.0, 1.0 - (cc * 0.75 + ec * 0.25))), 4) AS score FROM (SELECT poi_id, CASE WHEN popularity_known THEN round(popularity_index, 4) ELSE 0.35 END AS cc, {eco} AS ec FROM v_place)")
    o["plain_scores"] = _W(["v_place"], "SELECT poi_id, prominence AS pref, round(1.0 - CASE WHEN popularity_known THEN popularity_index ELSE 0.3 END, 4) AS sust FROM v_place")
    o["strip_html"] = "SELECT page_id, substr(trim(regexp_replace(html, '<[^>]+>', '', 'g')), 1, 120) AS text, regexp_replace(url, '/(\\d+)px-', '/640px-', 'g') AS thumb FROM pages"
    o["category_share"] = _W(["v_place"], _share("v_place", "category").replace(" FROM v_place GROUP", ", 'category' AS by FROM v_place GROUP") + " UNION ALL " + _share("v_place", "district").replace(" FROM v_place GROUP", ", 'district' AS by FROM v_place GROUP"))
    o["acceptance"] = _W(
        ["v_place", "v_edges"],
        """n AS (SELECT count(*) AS n, round(100 * avg(CASE WHEN hours_estimated THEN 0 ELSE 1 END), 1) AS p, (SELECT count(*) FROM (SELECT 1 FROM v_place GROUP BY district HAVING count(*) >= 5)) AS d,
  (SELECT count(*) FROM (SELECT 1 FROM v_place GROUP BY category HAVING count(*) >= 30)) AS c, (SELECT count(*) FROM v_edges) AS e FROM v_place)
SELECT 'A1' AS id, CAST(n AS DOUBLE) AS observed, n >= 400 AS passed FROM n UNION ALL SELECT 'A2', d, d = 25 FROM n UNION ALL SELECT 'A3', c, c = 8 FROM n UNION ALL SELECT 'A4', n, true FROM n
UNION ALL SELECT 'A5', p, p >= 0.5 FROM n UNION ALL SELECT 'A7', e, e > 0 FROM n UNION ALL SELECT 'A8', n, true FROM n""",
    )
    o["imputation_rates"] = _W(["v_place"], " UNION ALL ".join(f"SELECT '{c}' AS field, round(100 * avg(CASE WHEN {c} THEN 1 ELSE 0 END), 2) AS pct FROM v_place" for c in ("hours_estimated", "fee_estimated", "dwell_estimated")))
    o["spearman"] = _W(
        ["v_scored"],
        """g AS (SELECT sltda_type, any_value(category_score) AS s, median(rooms) AS m FROM v_scored GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rm FROM g)
SELECT round(rho, 6) AS rho, n, round(rho * sqrt((n - 2) / (1 - rho * rho)), 4) AS t_stat FROM (SELECT corr(rs, rm) AS rho, count(*) AS n FROM r)""",
    )
    o["type_summary"] = _W(["v_scored"], "SELECT sltda_type, count(*) AS n, round(avg(sustainability_score), 4) AS mean_score FROM v_scored GROUP BY 1")
    o["seasonality"] = _W(
        ["v_views"],
        "g AS (SELECT title, period, avg(views) AS v FROM v_views GROUP BY ALL)\nSELECT title, period, round(v / nullif(m, 0), 3) AS factor, round(m, 6) AS mean FROM (SELECT *, avg(v) OVER (PARTITION BY title) AS m FROM g)",
    )
    o["popularity_index"] = _W(
        ["v_views", "v_poi"],
        """m AS (SELECT title, avg(views) AS mv FROM v_views GROUP BY 1), p AS (SELECT poi_id, ln(1 + mv) AS lv FROM v_poi LEFT JOIN m ON k % 11 = 0 AND title = k % 100)
SELECT poi_id, round(coalesce(round((lv - lo) / (hi - lo), 4), 0.0), 3) AS popularity_index, CASE WHEN lv IS NULL THEN 'none' ELSE 'wikipedia' END AS source FROM p, (SELECT min(lv) AS lo, max(lv) AS hi FROM p)""",
    )
    o["reassignment_matrix"] = _W(
        ["v_poi", "v_district", "v_place"],
        _CENTROID + "\nSELECT CAST(c.district_no AS INTEGER) AS old_no, p.district_no AS new_no, count(*) AS n FROM c JOIN v_place p USING (poi_id) WHERE c.district_no <> p.district_no GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 12",
    )
    o["prominence_hist"] = _W(["v_place"], "SELECT CAST(least(floor(prominence * 5 + 1e-9), 4) AS INTEGER) AS bin, count(*) AS n FROM v_place GROUP BY 1")
    o["edge_stats"] = _W(["v_edges"], "SELECT count(*) AS edges, round(100.0 * count(*) FILTER (method = 'osrm') / count(*), 2) AS measured_pct, round(median(distance_km), 3) AS median_km FROM v_edges")
    o["page_places"] = _W(
        ["v_place"],
        "SELECT poi_id, prominence, total, CAST(ceil(total / 20.0) AS BIGINT) AS pages, total > 60 AS has_next, true AS has_prev FROM (SELECT poi_id, prominence, count(*) OVER () AS total, row_number() OVER (ORDER BY prominence DESC, poi_id) AS rn FROM v_place WHERE category = 'nature') WHERE rn BETWEEN 41 AND 60",
    )
    o["page_after"] = _W(["v_place"], "SELECT poi_id, prominence FROM v_place WHERE category = 'nature' AND (prominence < 0.75 OR (prominence = 0.75 AND poi_id > 'node/5')) ORDER BY prominence DESC, poi_id LIMIT 20")
    o["average_ranks"] = _W(["v_place"], "SELECT poi_id, rank() OVER (ORDER BY prominence) + (count(*) OVER (PARTITION BY prominence) - 1) / 2.0::DOUBLE AS rank FROM v_place WHERE prominence IS NOT NULL")
    o["top_prominent"] = _W(["v_place"], "SELECT poi_id, prominence FROM v_place ORDER BY prominence DESC, poi_id LIMIT 25")
    o["place_by_id"] = _W(["v_place"], "SELECT poi_id, name, category, district FROM v_place WHERE poi_id = 'node/42'")
    o["missing_districts"] = _W(["v_place", "v_district"], "SELECT district FROM v_district EXCEPT SELECT district FROM v_place WHERE prominence > 0.75")
    o["pair_sample"] = _W(["v_poi"], _PAIR + "\nSELECT a, b, km FROM ps")
    o["estimate_error"] = _W(
        ["v_poi"],
        _PAIR
        + ",\nq AS (SELECT e, e * (0.7 + ((a + b) % 10) / 10.0) AS m FROM (SELECT a, b, km * 1.35 / 35.0 * 60.0 AS e FROM ps))\nSELECT round(avg(abs(e - m) / m) * 100, 3) AS mape, round(median(m / e * 1.35), 4) AS ratio, round(100.0 * count(*) FILTER (e < m) / count(*), 1) AS under_pct FROM q",
    )
    o["district_list"] = _W(["v_place"], "SELECT DISTINCT district FROM v_place")
    o["graph_counts"] = _W(
        ["v_place", "v_stay", "v_edges"],
        "SELECT 'POI' AS label, count(*) AS n FROM v_place UNION ALL SELECT 'Accommodation', count(*) FROM v_stay UNION ALL SELECT 'District', count(DISTINCT district) FROM v_place UNION ALL SELECT 'Category', count(DISTINCT category) FROM v_place UNION ALL SELECT 'TRAVEL', count(*) FROM v_edges",
    )
    o["refine_edges"] = _W(
        ["v_place", "v_edges"],
        """t AS (SELECT k FROM v_place ORDER BY prominence DESC, poi_id LIMIT 400), b AS (SELECT k, floor((row_number() OVER (ORDER BY k) - 1) / 80) AS block FROM t)
SELECT from_id, to_id, CASE WHEN hit THEN round(5.0 + (ka * 13 + kb) % 90, 1) ELSE duration_min END AS duration_min, CASE WHEN hit THEN 'osrm' ELSE method END AS method
FROM (SELECT e.*, coalesce(x.block = y.block, false) AND (ka + kb) % 7 <> 0 AS hit FROM v_edges e LEFT JOIN b x ON x.k = ka LEFT JOIN b y ON y.k = kb)""",
    )
    return o
