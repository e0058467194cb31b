"""The same queries as plain SQL over the given tables, for checking.

Written for DuckDB. Queries that fit models have none. Doubles are rounded and
dates and lists turned to text as the registered queries do.
"""

from __future__ import annotations

from fieldcast.plans.bindings import spline_sql, with_tables


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def day(*names: str) -> str:
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ALLOWED = """status <> 'x' AND all_reported AND protocol_id IN ('P21','P22') AND obs_time IS NOT NULL
 AND n_observers <= 10 AND duration_hrs BETWEEN 0.08::DOUBLE AND 5.0::DOUBLE"""
# every character counted as white space, as the clean-up does
SPACES = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
GAP = """(SELECT CAST(d AS DATE) AS obs_date FROM generate_series(DATE '2023-10-20', DATE '2024-03-13',
 INTERVAL 1 DAY) t(d) WHERE CAST(d AS DATE) NOT IN (SELECT obs_date FROM checklists))"""
NEED = """(SELECT DISTINCT clat, clon, CAST(date AS DATE) AS date FROM (SELECT clat, clon, obs_date AS date FROM spanned
 UNION ALL SELECT clat, clon, obs_date + INTERVAL 1 DAY FROM spanned))"""
GAPPED = f"""(SELECT n.* FROM {NEED} n ANTI JOIN (SELECT DISTINCT clat, clon, CAST(ts AS DATE) AS date
 FROM weather WHERE ts < TIMESTAMP '2024-01-20') h USING (clat, clon, date))"""
ELIGIBLE_ON = "hr IN (SELECT hr FROM model GROUP BY hr HAVING count(*) >= 100)"
LACKS = """(n_wx_hours = 0 OR wind_max IS NULL OR temp_mean IS NULL OR cloud_mean IS NULL
 OR humid_mean IS NULL)"""
BATCHES = "SELECT sub_id, loc_id, CAST(obs_date AS VARCHAR) AS obs_date, round(duration_hrs, 6) AS duration_hrs FROM checklists"
EFFORT = "b_dur * ln({d}::DOUBLE) + b_dist * ln(2.0::DOUBLE) + b_obs + b_trav"
SIG = "(1 / (1 + exp(-({}))))"


def _drivers(rows_of: str = "best", keys: str = "species_code, loc_id", effort: str = EFFORT,
             duration: str = "1.0") -> str:
    fixed = "b0 + week_term + site_effect"
    wx = "b_wind * {w} + b_temp * temp_mean + b_rain * precip_sum + b_cloud * cloud_mean"
    now_h, ref_h = "coalesce(hour_term, 0)", "coalesce(ref_term, 0)"

    def at(h: str, d: float | str, w: str) -> str:
        return SIG.format(" + ".join([fixed, h, effort.format(d=d), wx.format(w=w)]))

    base = at(ref_h, 0.5, "12")
    rows = {"time of day": f"{at(now_h, 0.5, '12')} - {base}", "how long": f"{at(ref_h, duration, '12')} - {base}",
            "weather": f"{at(ref_h, 0.5, 'wind_max')} - {base}", "total": at(now_h, duration, "wind_max")}
    return " UNION ALL ".join(
        f"SELECT {keys}, CAST(day AS VARCHAR) AS day, hour, '{k}' AS label, "
        f"CAST(floor(({v}) * 100 + 0.5) AS INTEGER) AS points FROM {rows_of}" for k, v in rows.items())


_WEEKS = """(SELECT species_code, CAST(substr(term, 6, 2) AS INTEGER) AS w FROM coefs WHERE term LIKE 'week_%')"""
_EXPECTED = f"""(SELECT m.observer, strftime(m.obs_date, '%Y-%m') AS month, {SIG.format(
 '''b.b0 + coalesce(h.value, 0) + w.value + coalesce(own.value, pool.value, 0) + b_dur * m.log_dur
 + b_dist * m.log_dist + b_obs * m.n_observers + b_trav * m.traveling + b_wind * m.wind_max
 + b_temp * m.temp_mean + b_rain * m.precip_sum + b_cloud * m.cloud_mean''')} AS p,
 CAST(o.sub_id IS NOT NULL AS INTEGER) AS y
 FROM (SELECT * FROM model WHERE NOT {LACKS}) m CROSS JOIN scal b
 JOIN coefs s ON s.species_code = b.species_code AND s.term = 'support_'||lpad(CAST(m.hr AS VARCHAR), 2, '0') AND s.value >= 50
 JOIN coefs w ON w.species_code = b.species_code AND w.term = 'week_'||lpad(CAST(m.week AS VARCHAR), 2, '0')
 LEFT JOIN coefs h ON h.species_code = b.species_code AND h.term = 'hour_'||lpad(CAST(m.hr AS VARCHAR), 2, '0')
 LEFT JOIN coefs own ON own.species_code = b.species_code AND own.term = 'site_'||m.site AND m.site <> 'PERSONAL'
 LEFT JOIN coefs pool ON pool.species_code = b.species_code AND pool.term = 'site_PERSONAL'
 LEFT JOIN observations o ON o.sub_id = m.sub_id AND o.species_code = b.species_code)"""
_BOARD = f"""(SELECT observer, month, found, expected, hours, n_lists, found / expected AS efficiency
 FROM (SELECT observer, month, sum(y) AS found, sum(p) AS expected FROM {_EXPECTED} GROUP BY 1, 2)
 JOIN (SELECT observer, strftime(obs_date, '%Y-%m') AS month, sum(duration_hrs) AS hours, count(*) AS n_lists
  FROM model WHERE NOT {LACKS} GROUP BY 1, 2) USING (observer, month))"""
_PHOTO_NAMES = """(SELECT species_code, 'photo name '||sno AS photo_name, EXISTS (SELECT 1 FROM photos p
  WHERE p.taxon_id = sno - 3 AND is_curated AND licence IS NOT NULL) AS has_main FROM species WHERE sno % 3 = 0)"""
_FEED = """(SELECT c.okey, c.obs_date, c.observer, l.loc_id, l.lat + (okey % 3) / 1000.0::DOUBLE AS lat, l.lon,
 CASE WHEN okey % 5 <> 0 THEN is_hotspot ELSE false END AS is_hotspot FROM checklists c JOIN locations l USING (loc_id))"""
_BINOMIAL = r"array_to_string(list_slice(string_split(trim(regexp_replace(nm, '\s+', ' ', 'g')), ' '), 1, 2), ' ')"

EXTREMES = f"""SELECT year(date) AS year, month(date) AS month, {day('date')}, {r('wind_max', 'precip', 'temp_mean')},
 CASE WHEN month(date) % 2 = 1 THEN 'windy' ELSE 'calm' END AS kind FROM (SELECT *, row_number() OVER
 (PARTITION BY year(date), month(date) ORDER BY CASE WHEN month(date) % 2 = 1 THEN -wind_max ELSE wind_max END, date) AS rn
 FROM (SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN count(*) % 5 <> 0 THEN round(max(o_totalprice) / 1000, 3) END AS wind_max,
  round(sum(o_totalprice) / 10000, 3) AS precip, round(avg(o_totalprice) / 10000, 3) AS temp_mean FROM orders GROUP BY 1)
 WHERE wind_max IS NOT NULL) WHERE rn = 1"""

# the share of a normal distribution beyond both ends, from the series of the error function
NORMAL_TAILS = ("(1 - exp(-{0} * {0} / 2) * list_sum(list_transform(range(0, 200), "
                "lambda n: exp((2 * n + 1) * ln({0} / sqrt(2.0::DOUBLE)) - lgamma(n + 1.5::DOUBLE)))))")
HOUR_TERMS = """SELECT unnest(list_filter(hours, lambda h: h <> 8)) AS hr, unnest(b[10:]) AS beta, unnest(var[10:]) AS var
 FROM glm JOIN hour_knots ON rows_of = '{1}' WHERE fit = '{0}'"""

BODIES: dict[str, str] = {
    "eligible_outings": f"""SELECT sub_id, loc_id, {day('obs_date')}, obs_time, {r('duration_hrs', 'distance_km')},
 n_observers, protocol_id, {r('lat', 'lon')}, is_hotspot FROM eligible""",
    "richness": f"""SELECT sub_id, loc_id, coalesce(x.richness, 0) AS richness
 FROM checklists c LEFT JOIN richness x USING (sub_id) WHERE {ALLOWED}""",
    "grid_snap": """SELECT loc_id, round_even(lat / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS clat,
 round_even(lon / 0.25::DOUBLE, 0) * 0.25::DOUBLE AS clon FROM locations""",
    "clock_hour": """SELECT sub_id, obs_time, round(CAST(split_part(obs_time, ':', 1) AS DOUBLE)
 + CAST(split_part(obs_time, ':', 2) AS DOUBLE) / 60, 6) AS hour FROM checklists""",
    "outing_span": f"""SELECT sub_id, {TS.format("s")} AS start_ts, {TS.format("e")} AS end_ts,
 {TS.format("date_trunc('hour', s)")} AS span_from,
 {TS.format("CASE WHEN e = date_trunc('hour', e) THEN e ELSE date_trunc('hour', e) + INTERVAL 1 HOUR END")} AS span_to
 FROM (SELECT sub_id, CAST(obs_date AS TIMESTAMP) + to_microseconds(CAST(round(hour * 3600000000) AS BIGINT)) AS s,
  CAST(obs_date AS TIMESTAMP) + to_microseconds(CAST(round((hour + duration_hrs) * 3600000000) AS BIGINT)) AS e
  FROM spanned)""",
    "derived_features": f"""SELECT sub_id, dayofyear(obs_date) AS doy, round(ln(duration_hrs), 6) + 0.0 AS log_dur,
 round(ln(1 + coalesce(distance_km, 0)), 6) + 0.0 AS log_dist, CAST(protocol_id = 'P22' AS INTEGER) AS traveling
 FROM checklists WHERE {ALLOWED}""",
    "hour_week_bucket": """SELECT sub_id, CAST(round_even(CAST(split_part(obs_time, ':', 1) AS DOUBLE)
 + CAST(split_part(obs_time, ':', 2) AS DOUBLE) / 60, 0) AS INTEGER) AS hr, dayofyear(obs_date) // 7 AS week
 FROM checklists""",
    "site_pooling": "SELECT CASE WHEN is_hotspot THEN loc_id ELSE 'PERSONAL' END AS site, count(*) AS n FROM eligible GROUP BY 1",
    "in_coverage": """SELECT point_id, ok AS in_coverage, CASE WHEN NOT ok THEN 'area' END AS reason
 FROM (SELECT point_id, lat BETWEEN 40.19::DOUBLE AND 40.68::DOUBLE AND lon BETWEEN -80.34::DOUBLE AND -79.69::DOUBLE AS ok FROM pins)""",
    "validate_outings": """SELECT outing_id, problems = '' AS valid, problems FROM (SELECT outing_id, concat_ws(',',
 CASE WHEN protocol NOT IN ('stationary','traveling','incidental') THEN 'protocol' END,
 CASE WHEN (duration_min IS NULL AND protocol <> 'incidental') OR duration_min NOT BETWEEN 1 AND 720 THEN 'duration_min' END,
 CASE WHEN (distance_km IS NULL AND protocol = 'traveling') OR distance_km < 0 THEN 'distance_km' END,
 CASE WHEN (party_size IS NULL AND protocol <> 'incidental') OR party_size NOT BETWEEN 1 AND 50 THEN 'party_size' END)
 AS problems FROM logged)""",
    "weather_span": f"""SELECT sub_id, clat, clon, {r('hour', 'wind_max', 'precip_sum', 'temp_mean', 'cloud_mean', 'humid_mean', digits=9)},
 n_wx_hours FROM model""",
    "weather_gap": f"SELECT clat, clon, {day('date')} FROM {GAPPED}",
    "weather_gap_ranges": f"""SELECT clat, clon, CAST(min(date) AS VARCHAR) AS from_date,
 CAST(max(date) AS VARCHAR) AS to_date, count(*) AS n_days FROM {GAPPED} GROUP BY 1, 2""",
    "weather_dedup": f"""SELECT clat, clon, {TS.format('ts')} AS ts, {r('wind', 'precip', 'temp', 'cloud', 'humid', digits=9)}
 FROM (SELECT *, row_number() OVER (PARTITION BY clat, clon, ts ORDER BY batch DESC) AS rn FROM (
  SELECT 0 AS batch, * FROM weather UNION ALL
  SELECT 1, 40.25::DOUBLE + 0.25::DOUBLE * (user_id % 3) AS clat,
   -80.25::DOUBLE + 0.25::DOUBLE * ((user_id // 3) % 3) AS clon, date_trunc('hour', ts) AS ts,
   max(value % 40), sum(value % 3), avg(value % 30), avg(value % 100), avg(value % 80)
  FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL)) WHERE rn = 1""",
    "weather_gate": f"SELECT {day('obs_date')}, count(*) AS n_bad FROM model WHERE {LACKS} GROUP BY obs_date",
    "weather_spread": f"""SELECT variable, {r('min_value', 'max_value', 'median_value')} FROM (
 SELECT variable, min(x) AS min_value, max(x) AS max_value, quantile_cont(x, 0.5) AS median_value
 FROM (SELECT 'wind_max' AS variable, wind_max AS x FROM model UNION ALL SELECT 'temp_mean', temp_mean FROM model
 UNION ALL SELECT 'precip_sum', precip_sum FROM model UNION ALL SELECT 'cloud_mean', cloud_mean FROM model)
 WHERE x IS NOT NULL GROUP BY 1)""",
    "weather_unzip": f"""SELECT clat, clon, {TS.format('ts')} AS ts, {r('temp', 'precip', 'wind', 'cloud', 'humid', digits=9)},
 CAST(NULL AS DOUBLE) AS pressure FROM weather""",
    "presence_absence": "SELECT sub_id, species_code, y FROM labels_long",
    "species_floor": "SELECT * FROM floor_species",
    "fitted_species": f"""SELECT species_code, count(*) AS n_det FROM observations JOIN floor_species USING (species_code)
 WHERE sub_id IN (SELECT sub_id FROM model WHERE NOT {LACKS} AND hr IN (SELECT hr FROM model WHERE NOT {LACKS}
  GROUP BY hr HAVING count(*) >= 50)) GROUP BY 1 HAVING count(*) >= 50""",
    "hour_support": "SELECT hr, count(*) AS n, count(*) >= 100 AS supported FROM model GROUP BY 1",
    "prevalence": f"""SELECT species_code, detections, n_seen, n_outings, round(n_seen / n_outings, 6) AS prevalence
 FROM (SELECT f.species_code, f.detections, (SELECT count(*) FROM model JOIN observations o USING (sub_id)
  WHERE o.species_code = f.species_code) AS n_seen, (SELECT count(*) FROM model) AS n_outings
 FROM floor_species f ORDER BY detections DESC, species_code LIMIT 8)""",
    "model_census": f"""SELECT count(*) AS n_rows, count(DISTINCT obs_date) AS n_days,
 count(DISTINCT loc_id) FILTER (is_hotspot) AS n_hotspots, count(DISTINCT loc_id) FILTER (NOT is_hotspot) AS n_personal
 FROM model WHERE {ELIGIBLE_ON}""",
    "model_wide": f"""SELECT m.sub_id, m.richness, m.hr, m.week, m.site, {", ".join(
 f"CAST(count(*) FILTER (species_code = 'sp{i:02d}') > 0 AS INTEGER) AS y_sp{i:02d}" for i in range(3, 40))}
 FROM model m LEFT JOIN observations o USING (sub_id) GROUP BY ALL""",
    "flatten_checklists": f"""SELECT sub_id, loc_id, 'R1' AS region, concat_ws(' ', CAST(obs_date AS VARCHAR), obs_time) AS obs_dt,
 {day('obs_date')}, obs_time, {r('duration_hrs', 'distance_km')}, n_observers, protocol_id, all_reported,
 coalesce(n, 0) AS richness, observer, '2024-02-05 06:00:00' AS scraped_at FROM checklists
 LEFT JOIN (SELECT sub_id, count(*) AS n FROM observations GROUP BY 1) USING (sub_id)""",
    "flatten_observations": "SELECT sub_id, species_code, how_many FROM observations SEMI JOIN checklists USING (sub_id)",
    "feed_locations": f"""SELECT loc_id, {r('lat', 'lon')}, is_hotspot FROM (SELECT *, row_number() OVER
 (PARTITION BY loc_id ORDER BY obs_date, observer, okey) AS rn FROM {_FEED}) WHERE rn = 1""",
    "idempotent_append": BATCHES,
    "natural_key_merge": BATCHES,
    "merge_report": """SELECT 'checklists' AS table_name, count(*) AS n_seen, count(*) FILTER (status = 'P') AS n_added,
 count(*) FILTER (status = 'F') AS n_known FROM checklists WHERE status <> 'O'""",
    "store_merge": """SELECT 'checklists' AS table_name, sub_id AS key, round(duration_hrs, 6) AS value FROM checklists
 UNION ALL SELECT 'locations', loc_id, round(lat, 6) FROM locations
 UNION ALL SELECT 'observations', sub_id||'/'||species_code, CAST(how_many AS DOUBLE) FROM observations""",
    "store_merge_report": """SELECT 'checklists' AS table_name, count(*) AS n_seen, count(*) FILTER (status = 'P') AS n_added,
 count(*) FILTER (status = 'F') AS n_known FROM checklists WHERE status <> 'O'
 UNION ALL SELECT 'locations', count(*), count(*) FILTER (k = 0), count(*) FILTER (k = 2)
  FROM (SELECT CAST(substr(loc_id, 2) AS BIGINT) % 3 AS k FROM locations) WHERE k <> 1
 UNION ALL SELECT 'observations', count(*), count(*) FILTER (k = 0), count(*) FILTER (k = 2)
  FROM (SELECT CAST(substr(sub_id, 2) AS BIGINT) % 3 AS k FROM observations) WHERE k <> 1""",
    "insert_sites": f"""SELECT 'locations' AS table_name, count(*) AS n_seen, count(*) FILTER (NOT is_hotspot) AS n_added,
 count(*) FILTER (is_hotspot) AS n_known, (SELECT count(*) FROM locations WHERE is_hotspot)
  + count(*) FILTER (NOT is_hotspot) AS n_stored FROM (SELECT DISTINCT loc_id, l.is_hotspot FROM {_FEED} f
   JOIN locations l USING (loc_id))""",
    "unresolved_days": f"SELECT DISTINCT {day('obs_date')} FROM checklists WHERE loc_id NOT IN (SELECT loc_id FROM locations)",
    "site_census": f"""SELECT n_sites, n_hotspots, {r('lat_min', 'lat_max', 'lon_min', 'lon_max')}, n_needed, n_missing,
 round(n_hotspots / n_sites, 6) AS hotspot_share, round((lat_max - lat_min) * 111, 6) AS span_km,
 (lat_max - lat_min) * 111 > 25 AS wider_than_cell FROM (SELECT count(*) AS n_sites, count(*) FILTER (is_hotspot) AS n_hotspots,
 min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM locations),
 (SELECT count(DISTINCT loc_id) AS n_needed, count(DISTINCT loc_id) FILTER (loc_id NOT IN (SELECT loc_id FROM locations))
  AS n_missing FROM checklists)""",
    "calendar_gap": f"SELECT {day('obs_date')} FROM {GAP}",
    "backfill_plan": f"""SELECT chunk, CAST(min(obs_date) AS VARCHAR) AS from_date, CAST(max(obs_date) AS VARCHAR) AS to_date,
 count(*) AS n_days, array_to_string(list_sort(list(DISTINCT dayofyear(obs_date) // 7)), ',') AS weeks,
 count(*) * 111 AS n_calls FROM (SELECT obs_date, (rn - 1) // 15 + 1 AS chunk FROM (SELECT obs_date,
 row_number() OVER (ORDER BY obs_date) AS rn FROM {GAP}) WHERE rn <= 80) GROUP BY 1""",
    "truncated_days": f"SELECT {day('obs_date')}, count(*) AS n, count(*) >= 510 AS truncated FROM checklists GROUP BY obs_date",
    "settled_window": f"""SELECT sub_id, {day('obs_date')} FROM checklists
 WHERE obs_date BETWEEN DATE '2024-01-23' AND DATE '2024-01-29'""",
    "table_census": """SELECT 'checklists' AS item, count(*) AS n FROM checklists UNION ALL
 SELECT 'observations', count(*) FROM observations UNION ALL
 SELECT 'species', count(DISTINCT species_code) FROM observations UNION ALL
 SELECT 'locations', count(DISTINCT loc_id) FROM checklists""",
    "extreme_days": EXTREMES,
    "extreme_days_documents": EXTREMES,
    "coef_long": f"SELECT species_code, term, {r('value')} FROM coefs",
    "coef_replace": f"""SELECT species_code, term, {r('value')} FROM refit UNION ALL
 SELECT species_code, term, {r('value')} FROM coefs WHERE species_code NOT IN (SELECT species_code FROM refit)""",
    "coef_bundle": f"SELECT species_code, term, {r('value')} FROM coefs",
    "coef_diff": f"""SELECT n_common, n_only_left, n_only_right, {r('max_abs_diff')}, n_beyond,
 n_only_left = 0 AND n_only_right = 0 AS same_terms, n_only_left = 0 AND n_only_right = 0 AND n_beyond = 0 AS within
 FROM (SELECT count(*) FILTER (a.term IS NOT NULL AND b.term IS NOT NULL) AS n_common,
  count(*) FILTER (b.term IS NULL) AS n_only_left, count(*) FILTER (a.term IS NULL) AS n_only_right,
  max(abs(a.value - b.value)) AS max_abs_diff, count(*) FILTER (abs(a.value - b.value) > 1e-6) AS n_beyond
 FROM coefs a FULL JOIN refit b ON a.species_code = b.species_code AND a.term = b.term)""",
    "hotspot_dim": f"""SELECT loc_id, name, {r('latitude', 'longitude')}, coalesce(n, 0) AS n_checklists FROM site_names
 LEFT JOIN (SELECT loc_id, count(*) AS n FROM checklists GROUP BY 1) USING (loc_id)
 WHERE 'site_'||loc_id IN (SELECT term FROM coefs)""",
    "hotspots_unmatched": """SELECT DISTINCT substr(term, 6) AS loc_id FROM coefs WHERE term LIKE 'site\\_%' ESCAPE '\\'
 AND term <> 'site_PERSONAL' AND substr(term, 6) NOT IN (SELECT loc_id FROM site_names)""",
    "species_list": f"""SELECT species_code, coalesce(photo_name, CASE WHEN sno % 2 = 0 THEN 'Listed '||sno END, species_code)
 AS common_name, coalesce(has_main, false) AS has_photos FROM species LEFT JOIN {_PHOTO_NAMES} USING (species_code)""",
    "model_meta": """SELECT (SELECT count(DISTINCT species_code) FROM coefs) AS species,
 (SELECT array_to_string(list_sort(list(DISTINCT CAST(substr(term, 6) AS INTEGER))), ',') FROM coefs WHERE term LIKE 'week_%') AS modelled_weeks,
 (SELECT array_to_string(list_sort(list(DISTINCT CAST(substr(term, 6) AS INTEGER))), ',') FROM coefs WHERE term LIKE 'hour_%') AS modelled_hours,
 (SELECT count(*) FROM site_names WHERE 'site_'||loc_id IN (SELECT term FROM coefs)) AS hotspots,
 '2024-02-05 06:00:00' AS fitted_at, 'R1' AS region, 'Region one' AS region_name, 40.19::DOUBLE AS lat_min, 40.68::DOUBLE AS lat_max,
 -80.34::DOUBLE AS lon_min, -79.69::DOUBLE AS lon_max""",
    "forecast_span": f"""SELECT clat, clon, {day('day')}, hour, {r('wind_max', 'temp_mean', 'precip_sum', 'cloud_mean', digits=9)},
 n_hours FROM spans3""",
    "unavailable": """SELECT b.species_code, CAST(day AS VARCHAR) AS day, hour, CASE WHEN coalesce(su.value, 0) < 50 THEN 'hour'
 WHEN wk.value IS NULL THEN 'week' END AS reason FROM scal b CROSS JOIN (SELECT DISTINCT day FROM fdays)
 CROSS JOIN (SELECT unnest(range(0, 24)) AS hour)
 LEFT JOIN coefs su ON su.species_code = b.species_code AND su.term = 'support_'||lpad(CAST(hour AS VARCHAR), 2, '0')
 LEFT JOIN coefs wk ON wk.species_code = b.species_code AND wk.term = 'week_'||lpad(CAST(dayofyear(day) // 7 AS VARCHAR), 2, '0')""",
    "score_grid": f"""SELECT species_code, loc_id, {day('day')}, hour, {r('probability')}, reason, has_site_effect FROM grid""",
    "rolling_forecast": f"""SELECT species_code, loc_id, {day('day')}, hour, {r('probability')}, reason FROM rolled_grid""",
    "rolling_slots": f"""SELECT b.clat, b.clon, {day('b.day')[:-len(' AS b.day')]} AS day, count(*) AS n_slots,
 count(*) FILTER (a.clat IS NULL OR a.n_hours <> b.n_hours OR
  [round(x, 9) FOR x IN [a.wind_max, a.temp_mean, a.precip_sum, a.cloud_mean]] IS DISTINCT FROM
  [round(x, 9) FOR x IN [b.wind_max, b.temp_mean, b.precip_sum, b.cloud_mean]]) AS n_scored
 FROM rolled_spans b LEFT JOIN spans a USING (clat, clon, day, hour) GROUP BY 1, 2, 3""",
    "drivers": _drivers(),
    "best_window": f"""SELECT species_code, loc_id, {day('day')}, hour, hour + 1 AS until_hour, {r('probability')} FROM best""",
    "best_hotspots": f"""SELECT species_code, {day('day')}, hour, rank, loc_id, {r('probability', 'lo', 'hi')}, n_scored,
 round(CASE WHEN hi = lo THEN 0.5 ELSE (probability - lo) / nullif(hi - lo, 0) END, 6) AS t FROM ranked_sites WHERE rank <= 12""",
    "species_shortlist": f"""SELECT loc_id, {day('day')}, hour, rank, species_code, {r('probability')} FROM (SELECT *, row_number()
 OVER (PARTITION BY loc_id, day, hour ORDER BY round(probability, 9) DESC, species_code) AS rank FROM grid
 WHERE probability IS NOT NULL) WHERE rank <= 24""",
    "weather_effect": f"""SELECT species_code, {day('day')}, hour, loc_id, {r('probability', 'at_median')},
 round((probability - at_median) * 100, 6) + 0.0 AS points FROM (SELECT *, {SIG.format(
 f"b0 + coalesce(hour_term, 0) + week_term + site_effect + {EFFORT.format(d=1.0)} + b_wind * 12 + b_temp * 18 + b_cloud * 60")}
 AS at_median FROM ranked_sites WHERE rank = 1)""",
    "forecast_request": f"""SELECT request_id, species_code, loc_id, has_site_effect, {day('day')}, hour, reason,
 {r('probability')} FROM asked_grid""",
    "request_summary": f"""SELECT g.request_id, g.species_code, {day('b.day')[:-len(' AS b.day')]} AS day, b.hour, b.hour + 1 AS until_hour,
 round(b.probability, 6) + 0.0 AS probability, n_slots, n_scored, w.weeks AS modelled_weeks,
 CASE WHEN n_week > 0 AND n_scored = 0 THEN (SELECT string_agg(x.w, ',' ORDER BY least(abs(x.w - week), 53 - abs(x.w - week)), x.w)
  FROM (SELECT w FROM {_WEEKS} y WHERE y.species_code = g.species_code
   ORDER BY least(abs(w - week), 53 - abs(w - week)), w LIMIT 3) x) END AS nearest_weeks
 FROM (SELECT request_id, species_code, count(day) AS n_slots, count(probability) AS n_scored,
  count(*) FILTER (reason = 'week') AS n_week, dayofyear(min(day)) // 7 AS week FROM asked_grid GROUP BY 1, 2) g
 LEFT JOIN asked_best b USING (request_id)
 LEFT JOIN (SELECT species_code, string_agg(w, ',' ORDER BY w) AS weeks FROM {_WEEKS} GROUP BY 1) w ON w.species_code = g.species_code""",
    "request_drivers": _drivers("asked_best", "request_id, species_code",
                                "b_dur * ln({d}::DOUBLE) + b_dist * ln(1 + distance_km) + b_obs * n_observers + b_trav * traveling",
                                "duration_hrs"),
    "week_coverage": f"""SELECT s.species_code, week, x.w IS NOT NULL AS fitted, week = 2 AS is_current FROM species s
 CROSS JOIN (SELECT unnest(range(0, 53)) AS week) LEFT JOIN {_WEEKS} x ON x.species_code = s.species_code AND x.w = week""",
    "nearest_weeks": f"""SELECT * FROM (SELECT species_code, week, row_number() OVER (PARTITION BY species_code, week
 ORDER BY least(abs(w - week), 53 - abs(w - week)), w) AS rank, w AS nearest, least(abs(w - week), 53 - abs(w - week)) AS distance
 FROM {_WEEKS} x CROSS JOIN (SELECT unnest(range(0, 53)) AS week)
 WHERE NOT EXISTS (SELECT 1 FROM {_WEEKS} y WHERE y.species_code = x.species_code AND y.w = week)) WHERE rank <= 3""",
    "fit_ridge_check": """SELECT species_code, term, count(*) AS n_rows, CAST(sum(y) AS DOUBLE) AS fitted FROM (
  SELECT species_code, y, unnest(['intercept', 'hour_'||lpad(CAST(hr AS VARCHAR), 2, '0'),
   'week_'||lpad(CAST(week AS VARCHAR), 2, '0'), 'site_'||site]) AS term FROM fit_labels) GROUP BY 1, 2
 UNION ALL SELECT species_code, term, count(*), 0.0::DOUBLE FROM fit_labels CROSS JOIN (SELECT unnest(['log_dur',
  'log_dist', 'n_observers', 'traveling', 'wind_max', 'temp_mean', 'precip_sum', 'cloud_mean']) AS term) GROUP BY 1, 2""",
    "holdout_check": " UNION ALL ".join(f"""SELECT '{split}' AS split, species_code,
 count(*) FILTER (is_test) AS n_test, count(*) FILTER (is_test AND y = 1) AS pos_test,
 count(*) FILTER (NOT is_test) AS n_train, CAST(sum(y) FILTER (NOT is_test) AS DOUBLE) AS fitted_train
 FROM fit_labels JOIN {test} USING ({key}) GROUP BY 2""" for split, key, test in (
        ("by_site", "loc_id", "fit_site_test"), ("by_date", "obs_date", "fit_date_test"),
        ("calibration", "loc_id", "fit_site_test"))),
    "hour_coding_check": """SELECT hr, count(*) AS n, CAST(sum(y) AS DOUBLE) AS fitted FROM hour_labels GROUP BY 1""",
    "hour_coding": f"""SELECT fit AS coding, n, CAST(len(b) - 1 AS INTEGER) AS params, {r('aic', 'pseudo_r2')} FROM (
 SELECT *, 2 * len(b) - 2 * ll AS aic, 1 - ll / (pos * ln(pos / n) + (n - pos) * ln((n - pos) / n)) AS pseudo_r2 FROM glm
 JOIN (SELECT fit, count(*) AS n, sum(y) AS pos FROM glm_rows GROUP BY 1) USING (fit)) WHERE fit <> 'example'""",
    "odds_ratios": f"""SELECT hr, n, {r('odds_ratio', 'p_value')}, coalesce(p_value < 0.05, false) AS significant FROM (
 SELECT hr, coalesce(exp(beta), 1.0::DOUBLE) AS odds_ratio, {NORMAL_TAILS.format('abs(beta / sqrt(var))')} AS p_value
 FROM (SELECT unnest(hours) AS hr FROM hour_knots WHERE rows_of = 'day') LEFT JOIN ({HOUR_TERMS.format('dummy', 'day')}) USING (hr))
 JOIN (SELECT hr, count(*) AS n FROM hour_fits WHERE rows_of = 'day' GROUP BY 1) USING (hr)""",
    "worked_example": f"""SELECT hr, {r('hour_term', 'total')}, round({SIG.format('total')}, 6) + 0.0 AS probability, hr = 8 AS is_reference
 FROM (SELECT hr, hour_term, hour_term + list_dot_product(b[1:9], [1.0::DOUBLE, 0, ln(2.0::DOUBLE), 3 * u * (1 - u) * (1 - u),
   3 * u * u * (1 - u), u * u * u, 12, 18, 0]) AS total
  FROM (SELECT hr, coalesce(beta, 0) AS hour_term, g.b, (least(greatest(134, d_lo), d_hi) - d_lo) / (d_hi - d_lo) AS u
   FROM (SELECT unnest([6, 7, 8, 10, 12, 14, 19]) AS hr) JOIN hour_knots k ON k.rows_of = 'example' AND list_contains(k.hours, hr)
   LEFT JOIN ({HOUR_TERMS.format('example', 'example')}) USING (hr) CROSS JOIN (SELECT b FROM glm WHERE fit = 'example') g))""",
    "spline_values": f"""SELECT variable, x, variable||'_'||fn AS term, round(value, 6) + 0.0 AS value FROM (
 SELECT variable, x, unnest([1, 2, 3]) AS fn, unnest([{", ".join(spline_sql("x", ["d_lo"] * 4 + ["d_hi"] * 4))}]) AS value
 FROM (SELECT DISTINCT 'doy' AS variable, CAST(doy AS DOUBLE) AS x FROM hour_fits WHERE rows_of = 'day') JOIN hour_knots ON rows_of = 'day'
 UNION ALL SELECT variable, x, unnest([1, 2, 3, 4]), unnest([{", ".join(spline_sql("x", ["t_lo"] * 4 + ["t_mid"] + ["t_hi"] * 4))}])
 FROM (SELECT DISTINCT 'hour' AS variable, hour AS x FROM hour_fits WHERE rows_of = 'day') JOIN hour_knots ON rows_of = 'day')
 WHERE round(value, 9) <> 0""",
    "hour_contrasts": f"""SELECT h.hr, {r('odds_ratio', 'std_error', 'aic')} FROM (
 SELECT h.hr, h.a / h.b / (q.a / q.b) AS odds_ratio, sqrt(1 / h.a + 1 / h.b + 1 / q.a + 1 / q.b) AS std_error,
  2 * count(*) OVER () - 2 * sum(h.a * ln(h.a / (h.a + h.b)) + h.b * ln(h.b / (h.a + h.b))) OVER () AS aic
 FROM hour_counts h CROSS JOIN hour_counts q WHERE q.hr = 8) h WHERE h.hr <> 8""",
    "refit_publish": f"""SELECT species_code, term, {r('value')} FROM published
 UNION ALL SELECT b.species_code, 'slots_'||CASE WHEN coalesce(n_hours, 0) = 0 OR wind_max IS NULL OR temp_mean IS NULL
   OR precip_sum IS NULL OR cloud_mean IS NULL THEN 'forecast' WHEN coalesce(su.value, 0) < 50 THEN 'hour'
   WHEN wk.term IS NULL THEN 'week' ELSE 'scored' END, CAST(count(*) AS DOUBLE)
 FROM (SELECT DISTINCT species_code FROM published) b CROSS JOIN hotspots s
 LEFT JOIN spans p ON p.clat = s.clat AND p.clon = s.clon
 LEFT JOIN published su ON su.species_code = b.species_code AND su.term = 'support_'||lpad(CAST(p.hour AS VARCHAR), 2, '0')
 LEFT JOIN published wk ON wk.species_code = b.species_code AND wk.term = 'week_'||lpad(CAST(dayofyear(p.day) // 7 AS VARCHAR), 2, '0')
 GROUP BY 1, 2""",
    "group_holdout": "SELECT loc_id, is_test FROM site_test",
    "eval_metrics": f"SELECT split, species_code, n, n_pos, {r('brier', 'auc', 'avg_precision', 'cal_mae', digits=9)} FROM metrics",
    "holdout_metrics_check": f"SELECT split, species_code, n, n_pos, {r('brier', 'auc', 'avg_precision', 'cal_mae')} FROM level_metrics",
    "calibration_table": f"""SELECT split, species_code, bin, round(pred, 9) AS pred, round(obs, 9) AS obs, n, round(obs - pred, 9) + 0.0 AS gap
 FROM calibration""",
    "calibration_mae": f"""SELECT split, species_code, {r('cal_mae', digits=9)}, CASE WHEN cal_mae < 0.03 THEN 'good'
 WHEN cal_mae > 0.08 THEN 'bad' ELSE 'fair' END AS verdict FROM cal_mae""",
    "eval_summary": f"""SELECT split, n_species, {r('mean_cal_mae', 'median_cal_mae', 'mean_auc', 'median_auc', 'mean_brier', digits=9)}
 FROM (SELECT split, count(*) AS n_species, avg(cal_mae) AS mean_cal_mae, median(cal_mae) AS median_cal_mae,
 avg(auc) AS mean_auc, median(auc) AS median_auc, avg(brier) AS mean_brier FROM metrics GROUP BY 1)""",
    "snap_hotspot": f"""SELECT point_id, n.loc_id, {r('distance_km')} FROM pins LEFT JOIN (SELECT * FROM near
 WHERE rank = 1 AND distance_km <= 0.2) n USING (point_id)""",
    "nearby_ranked": f"""SELECT * FROM (SELECT point_id, species_code, loc_id, {r('distance_km', 'best_probability')}, has_site_effect,
 row_number() OVER (PARTITION BY point_id ORDER BY round(b.best_probability, 9) DESC NULLS LAST, loc_id) AS position
 FROM near n JOIN pins p USING (point_id) LEFT JOIN (SELECT species_code, loc_id, max(probability) AS best_probability,
  bool_or(has_site_effect) AS has_site_effect FROM grid GROUP BY 1, 2) b USING (species_code, loc_id)
 WHERE n.rank <= 10 AND n.distance_km <= 25)""",
    "recent_nearby": """SELECT round(round_even(lat * 10, 0) / 10, 6) AS blat, round(round_even(lon * 10, 0) / 10, 6) AS blon,
 species_code, CAST(max(obs_date) AS VARCHAR) AS last_seen, count(*) AS n_lists FROM sightings
 WHERE obs_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-29' GROUP BY 1, 2, 3""",
    "recent_radius": """SELECT point_id, species_code, CAST(last_seen AS VARCHAR) AS last_seen, n_lists
 FROM (SELECT point_id, round_even(lat * 10, 0) / 10 AS blat, round_even(lon * 10, 0) / 10 AS blon FROM pins)
 JOIN (SELECT blat, blon, species_code, max(last_seen) AS last_seen, CAST(sum(n) AS BIGINT) AS n_lists FROM (
  SELECT p.*, s.*, 2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(s.lat - blat) / 2), 2)
   + cos(radians(blat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - blon) / 2), 2))) AS d
  FROM (SELECT DISTINCT round_even(lat * 10, 0) / 10 AS blat, round_even(lon * 10, 0) / 10 AS blon FROM pins) p
  CROSS JOIN (SELECT lat, lon, species_code, max(obs_date) AS last_seen, count(*) AS n FROM sightings
   WHERE obs_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-29' GROUP BY 1, 2, 3) s) WHERE d <= 25
  GROUP BY 1, 2, 3) USING (blat, blon)""",
    "shared_answers": """SELECT point_id, species_code, CAST(last_seen AS VARCHAR) AS last_seen, n_lists,
 CAST(answered_on AS VARCHAR) AS answered_on FROM asked_places JOIN place_answers USING (blat, blon)
 JOIN seen_around USING (blat, blon, answered_on)""",
    "user_lists": f"""SELECT observer, sub_id, loc_id, {day('obs_date')}, obs_time, {r('duration_hrs')}, coalesce(n, 0) AS n_species,
 row_number() OVER (PARTITION BY observer ORDER BY c.obs_date DESC, obs_time DESC NULLS LAST, sub_id) AS position
 FROM checklists c LEFT JOIN (SELECT sub_id, count(DISTINCT species_code) AS n FROM observations GROUP BY 1) USING (sub_id)""",
    "user_summary": f"""SELECT observer, n_lists, {r('hours')}, coalesce(n_species, 0) AS n_species
 FROM (SELECT observer, count(*) AS n_lists, sum(duration_hrs) AS hours FROM checklists GROUP BY 1)
 LEFT JOIN (SELECT observer, count(DISTINCT species_code) AS n_species FROM checklists JOIN observations USING (sub_id) GROUP BY 1) USING (observer)""",
    "leaderboard": f"SELECT observer, month, found, {r('expected', 'hours')}, n_lists, {r('efficiency')} FROM {_BOARD}",
    "leaderboard_top": f"""SELECT month, rank, observer, {r('efficiency')} FROM (SELECT *, row_number() OVER (PARTITION BY month
 ORDER BY round(efficiency, 9) DESC NULLS LAST, observer) AS rank FROM {_BOARD}) WHERE rank <= 20""",
    "photo_clean": f"""SELECT doc_id AS photo_id, 'https://photos.example.org/'||source||'/medium.jpg' AS url, 'cc-by' AS licence,
 trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) AS attribution FROM documents WHERE lang <> 'fr' OR lang IS NULL""",
    "photo_top": "SELECT taxon_id, slot, photo_id, url, licence, attribution FROM photo_slots",
    "photo_coverage": """SELECT taxon_id, count(*) FILTER (slot LIKE 'main%') AS n_main, count(*) FILTER (slot LIKE 'month%') AS n_months,
 bool_or(slot = 'female') AS has_female FROM photo_slots GROUP BY 1""",
    "photo_documents": """SELECT taxon_id, coalesce(string_agg(url, ',' ORDER BY slot) FILTER (slot LIKE 'main%'), '') AS main_urls,
 coalesce(string_agg(substr(slot, 7, 2), ',' ORDER BY slot) FILTER (slot LIKE 'month%'), '') AS months,
 max(url) FILTER (slot = 'female') AS female_url FROM photo_slots GROUP BY 1""",
    "binomial_match": f"""SELECT n.p_partkey, n.bi AS binomial, coalesce(f.taxon_id, b.taxon_id) AS taxon_id
 FROM (SELECT p_partkey, nm, {_BINOMIAL} AS bi FROM (SELECT p_partkey, p_name||' '||p_brand AS nm FROM part)) n
 LEFT JOIN (SELECT nm, min(k) AS taxon_id FROM (SELECT p_name AS nm, p_partkey AS k FROM part UNION ALL
  SELECT p_name||' '||p_brand, p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY 1) f ON f.nm = n.nm
 LEFT JOIN (SELECT nm, min(k) AS taxon_id FROM (SELECT p_name AS nm, p_partkey AS k FROM part UNION ALL
  SELECT p_name||' '||p_brand, p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY 1) b ON b.nm = n.bi""",
    "settled_counts": """SELECT CAST(obs_date AS VARCHAR) AS obs_date, count(DISTINCT okey) AS n FROM filed f
 LEFT JOIN marks m ON m.wave = f.wave - 1
 WHERE (m.mark IS NULL OR obs_date > m.mark) AND obs_date < (SELECT max(mark) FROM marks) GROUP BY 1""",
    "ingest_rejects": """SELECT CASE okey % 20 WHEN 0 THEN '{"subId":"'||sub_id||'","loc' WHEN 1 THEN '{"locId":"'||sub_id||'"}'
 ELSE sub_id END AS document, okey % 20 > 1 AS stored FROM checklists""",
    "stream_ingest": f"""SELECT sub_id, loc_id, {day('obs_date')}, coalesce(n, 0) AS richness, coalesce(n, 0) AS n_obs FROM checklists
 LEFT JOIN (SELECT sub_id, count(*) AS n FROM observations GROUP BY 1) USING (sub_id)""",
}


def statements() -> dict[str, str]:
    return {k: with_tables(v) for k, v in BODIES.items()}
