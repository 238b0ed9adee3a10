"""The queries of `queries.py` in SQL, over the same tables."""

from __future__ import annotations

DEP = """
dep AS (
  SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS station,
         CAST(user_id AS VARCHAR) AS train,
         date_trunc('minute', ts) AS ts,
         CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS departure,
         CASE WHEN event_type = 'error' THEN 'T' ELSE 'R' END AS mode,
         event_type AS mission,
         CAST(event_id % 150 AS INTEGER) AS terminus,
         event_id
  FROM events
)"""

UNIQ = DEP + """,
uniq AS (
  SELECT * FROM dep
  QUALIFY row_number() OVER (PARTITION BY train, departure ORDER BY event_id) = 1
)"""

STATIONS = """
stations AS (
  SELECT CAST(s_suppkey AS INTEGER) AS station, s_name AS label,
         CAST(48.8 AS DOUBLE) + s_suppkey / CAST(1000 AS DOUBLE) AS latitude,
         CAST(2.2 AS DOUBLE) + s_suppkey / CAST(500 AS DOUBLE) AS longitude
  FROM supplier
)"""


def windows(key: str, decimals: int = 1) -> str:
    """All windows of 60 minutes every 2 minutes."""
    return f"""
win AS (
  SELECT {key}, window_start, window_start + 3600 AS window_end, count(train) AS nt,
         round_even(CAST(60 AS DOUBLE) / count(train), {decimals}) AS awt
  FROM (
    SELECT {key}, train,
           unnest(generate_series(departure - departure % 120 - 3480, departure - departure % 120, 120)) AS window_start
    FROM uniq
  )
  GROUP BY {key}, window_start
)"""


AS_OF = "CAST(epoch(TIMESTAMP '2024-01-15 12:00:00') AS BIGINT)"
AS_OF_COMPAT = "CAST(epoch(TIMESTAMP '2024-01-15 12:01:30') AS BIGINT)"

LAST = "WITH " + UNIQ + "," + windows("station") + f""",
last AS (
  SELECT * FROM win WHERE window_start = (
    SELECT max(s) FROM (SELECT unnest(generate_series({AS_OF} - 7200 - {AS_OF} % 120, {AS_OF}, 120)) AS s)
    WHERE s + 3600 <= {AS_OF})
)"""

STOPS = UNIQ + f""",
stops AS (
  SELECT DISTINCT train, station, departure, mode, mission, terminus FROM uniq
  WHERE mode = 'R' AND departure BETWEEN {AS_OF} - 86400 AND {AS_OF} + 86400
)"""

LEGS = STOPS + f""",
ahead AS (
  SELECT *, lead(departure) OVER w AS next_departure, lead(station) OVER w AS next_station
  FROM stops WINDOW w AS (PARTITION BY train ORDER BY departure, station)
),
legs AS (
  SELECT * FROM ahead
  WHERE next_departure IS NOT NULL
    AND NOT ({AS_OF} > departure AND {AS_OF} > next_departure)
    AND NOT ({AS_OF} < departure AND {AS_OF} < next_departure)
)"""

PUBLISHED = "WITH " + LEGS + "," + STATIONS + f""",
moving AS (
  SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE,
         100.0::DOUBLE * abs({AS_OF} - departure) / abs(next_departure - departure))) AS share
  FROM legs
),
published AS (
  SELECT train,
         strftime(to_timestamp(departure) AT TIME ZONE 'UTC', '%H:%M:%S') AS departure,
         strftime(to_timestamp(next_departure) AT TIME ZONE 'UTC', '%H:%M:%S') AS arrival,
         departure AS departure_uts, next_departure AS arrival_uts, mission,
         moving.station AS from_st, next_station AS to_st, a.label AS from_st_lb, b.label AS to_st_lb,
         next_departure - departure AS time_to_st, round_even(share, 1) AS progress,
         CASE WHEN mission IN ('click', 'view') THEN 1 ELSE -1 END AS direction,
         a.latitude + (share / 100.0::DOUBLE) * (b.latitude - a.latitude) AS train_lt,
         a.longitude + (share / 100.0::DOUBLE) * (b.longitude - a.longitude) AS train_lg,
         a.latitude AS a_lt, a.longitude AS a_lg, b.latitude AS b_lt, b.longitude AS b_lg
  FROM moving
  LEFT JOIN stations a ON a.station = moving.station
  LEFT JOIN stations b ON b.station = moving.next_station
)"""

PUBLISHED_COLUMNS = """train, departure, arrival, departure_uts, arrival_uts, mission, from_st, to_st,
       from_st_lb, to_st_lb, time_to_st, progress, direction, train_lt, train_lg"""

LINE_LEGS = """
line_uniq AS (
  SELECT CAST(l_suppkey AS INTEGER) AS station, CAST(l_orderkey AS VARCHAR) AS train,
         CAST(epoch(l_shipdate) AS BIGINT) AS departure
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_shipdate
                             ORDER BY l_linenumber, l_suppkey, l_linestatus, l_partkey) = 1
),
line_legs AS (
  SELECT *, lead(departure) OVER w AS next_departure, lead(station) OVER w AS next_station,
         lead(departure) OVER w - departure AS time_to_st
  FROM line_uniq WINDOW w AS (PARTITION BY train ORDER BY departure, station)
)"""

# Ancestors in the tree "parent of k is k div 2", and every path as rows in order.
ANCESTORS = """
anc AS (
  SELECT s_suppkey AS station, s_suppkey AS ancestor, 0 AS up FROM supplier
  UNION ALL
  SELECT station, ancestor // 2, up + 1 FROM anc WHERE ancestor > 0
)"""

PATH_POINTS = "WITH RECURSIVE " + LINE_LEGS + "," + ANCESTORS + """,
pairs AS (
  SELECT DISTINCT station AS from_st, next_station AS to_st FROM line_legs WHERE next_station IS NOT NULL
),
junction AS (
  SELECT from_st, to_st, max(a.ancestor) AS lca
  FROM pairs JOIN anc a ON a.station = from_st JOIN anc b ON b.station = to_st AND b.ancestor = a.ancestor
  GROUP BY from_st, to_st
),
climb AS (
  SELECT from_st, to_st, lca, ancestor AS node, up FROM junction JOIN anc ON station = from_st WHERE ancestor >= lca
),
turn AS (SELECT from_st, to_st, up AS top FROM climb WHERE node = lca),
descend AS (
  SELECT j.from_st, j.to_st, j.lca, d.ancestor AS node, l.up - d.up AS below, t.top
  FROM junction j
  JOIN anc d ON d.station = j.to_st AND d.ancestor > j.lca
  JOIN anc l ON l.station = j.to_st AND l.ancestor = j.lca
  JOIN turn t ON t.from_st = j.from_st AND t.to_st = j.to_st
),
track AS (
  SELECT s_suppkey AS lower, o AS order_point,
         (s_suppkey // 2) + (o + 1) / CAST(3 AS DOUBLE) * (s_suppkey - s_suppkey // 2) AS km
  FROM supplier, generate_series(0, 1) g(o) WHERE s_suppkey > 0
),
path AS (
  SELECT from_st, to_st, up * 3 AS idx, CAST(node AS DOUBLE) AS km FROM climb
  UNION ALL
  SELECT from_st, to_st, up * 3 + 2 - order_point, km FROM climb JOIN track ON lower = node WHERE node > lca
  UNION ALL
  SELECT from_st, to_st, top * 3 + below * 3, CAST(node AS DOUBLE) FROM descend
  UNION ALL
  SELECT from_st, to_st, top * 3 + (below - 1) * 3 + 1 + order_point, km FROM descend JOIN track ON lower = node
),
place AS (
  SELECT from_st, to_st, idx,
         CAST(round((CAST(48.8 AS DOUBLE) + km / CAST(1000 AS DOUBLE)) * 1000000) AS BIGINT) AS lat,
         CAST(round((CAST(2.2 AS DOUBLE) + km / CAST(500 AS DOUBLE)) * 1000000) AS BIGINT) AS lon
  FROM path
)"""

RAIL = """
rail AS (
  SELECT l_returnflag AS code_ligne, 'V' || l_linenumber AS nom_voie,
         CAST(48 AS DOUBLE) + l_suppkey / CAST(1000 AS DOUBLE) AS lat1,
         CAST(2 AS DOUBLE) + l_partkey / CAST(100000 AS DOUBLE) AS lon1,
         CAST(48 AS DOUBLE) + l_quantity / CAST(1000 AS DOUBLE) AS lat2,
         CAST(2 AS DOUBLE) + l_discount AS lon2
  FROM lineitem
)"""

_MISSION = """
  substr('BDFNPRSUVX', CAST(event_id % 10 AS INTEGER) + 1, 1) AS m1,
  substr('IAOEUX', CAST((event_id // 10) % 6 AS INTEGER) + 1, 1) AS m2,
  substr('ABCLMPX', CAST((event_id // 60) % 7 AS INTEGER) + 1, 1) AS m3"""

ORDERED = "SELECT station, awt FROM last"
PROGRESS = PUBLISHED + f" SELECT {PUBLISHED_COLUMNS}, train_lt AS train_alt, train_lg AS train_alg FROM published"
LATER = "CAST(epoch(TIMESTAMP '2024-01-15 12:34:56') AS BIGINT)"
STRAIGHT = """WHEN a_lt IS NULL OR b_lt IS NULL THEN NULL ELSE"""


def _share(now: str) -> str:
    return f"""greatest(0.0::DOUBLE, least(100.0::DOUBLE,
         100.0::DOUBLE * abs({now} - departure_uts) / abs(arrival_uts - departure_uts)))"""


def _along(axis: str, share: str) -> str:
    t = f"({share} / 100.0::DOUBLE)"
    return f"(1.0::DOUBLE - {t}) * a_{axis} + {t} * b_{axis}"


def _cubic(axis: str, x: str) -> str:
    """The cubic that the paths of `cubic_position` follow; NULL without a destination."""
    if axis == "lat":
        return f"""(48.01::DOUBLE + from_st / 97.0::DOUBLE + 0.0021371::DOUBLE * ({x}) + (to_st - 50) * 1.0373171e-6::DOUBLE * ({x}) * ({x})
         + (from_st + 1) * 1.0117193e-8::DOUBLE * ({x}) * ({x}) * ({x}))"""
    return f"""(2.003::DOUBLE + to_st / 89.0::DOUBLE - 0.0013177::DOUBLE * ({x}) + (from_st - 40) * 2.0719317e-6::DOUBLE * ({x}) * ({x})
         - (to_st + 2) * 1.0117193e-8::DOUBLE * ({x}) * ({x}) * ({x}))"""


# Every event a train of its own.
EVERY_WINDOW = windows("station").replace("FROM uniq", "FROM dep")

ORACLE: dict[str, str] = {
    "decode_json": "WITH " + DEP + " SELECT station, train, departure, mode, mission, terminus, event_id FROM dep",
    "decode_quarantine": "WITH " + DEP + """
SELECT event_id, CASE WHEN mission NOT IN ('error', 'view') THEN train END AS train,
       CASE WHEN mission = 'error' THEN substr('{"station":' || station || ',"train":"' || train || '","timestamp"', 1, 20)
            WHEN mission = 'view' THEN '{"station":"abc","train":"' || train || '","timestamp":"'
              || strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') || '","mode":"' || mode || '","mission":"' || mission
              || '","terminus":' || terminus || '}' END AS bad_value
FROM dep""",
    "boards_quarantine": "WITH " + DEP + """,
boards AS (
  SELECT event_id, station, train, mission,
         '<passages><train><date mode="R">' || strftime(ts, '%d/%m/%Y %H:%M') || '</date><num>' || train || '</num><miss>'
         || upper(mission) || '</miss><term>' || terminus || '</term></train><train><date mode="R">'
         || strftime(ts + INTERVAL 5 MINUTE, '%d/%m/%Y %H:%M') || '</date><num>' || (CAST(train AS BIGINT) + 1)
         || '</num><miss>' || upper(mission) || '</miss><term>' || terminus || '</term></train></passages>' AS xml
  FROM dep
)
SELECT event_id, station, NULL AS train, substr(xml, 1, length(xml) - 20) AS bad_value FROM boards WHERE mission = 'error'
UNION ALL SELECT event_id, station, train, NULL FROM boards WHERE mission <> 'error'
UNION ALL SELECT event_id, station, CAST(CAST(train AS BIGINT) + 1 AS VARCHAR), NULL FROM boards
WHERE mission NOT IN ('error', 'view')""",
    "local_times": "WITH " + DEP + " SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS local_time FROM dep",
    "volume_metric": "SELECT count(*) AS rows FROM events",
    "files_round_trip": "WITH " + DEP + " SELECT station, train, departure, mode, mission, terminus FROM dep",
    "parse_board_xml": "WITH " + DEP + """
SELECT station, train, departure, 'R' AS mode, upper(mission) AS mission, terminus, event_id FROM dep
UNION ALL
SELECT station, CAST(CAST(train AS BIGINT) + 1 AS VARCHAR), departure + 300, 'R', upper(mission), terminus, event_id
FROM dep WHERE mission <> 'view'""",
    "dedup_first": "WITH " + UNIQ + " SELECT station, train, departure, mode, mission, terminus, event_id FROM uniq",
    "stops_distinct": "WITH " + DEP + " SELECT DISTINCT train, station, departure, mode, mission, terminus FROM dep",
    "inject_synthetic": "WITH " + DEP + """
SELECT station, train, departure, mode, mission, terminus FROM dep
UNION ALL SELECT 0, '007', CAST(epoch(TIMESTAMP '2024-01-15 12:00:10') AS BIGINT), 'R', 'SECRET', 1
UNION ALL SELECT 1, '007', CAST(epoch(TIMESTAMP '2024-01-15 12:01:10') AS BIGINT), 'R', 'SECRET', 1""",
    "awt_windows": "WITH " + UNIQ + "," + windows("mission") + " SELECT * FROM win",
    "awt_panes": "WITH " + UNIQ + "," + windows("mission") + " SELECT * FROM win",
    "awt_panes_by_station": "WITH " + UNIQ + "," + windows("station", 2) + " SELECT * FROM win",
    "awt_last_window_latest": LAST + " SELECT station, window_start, window_end, nt, awt FROM last",
    "awt_last_window_compat": "WITH " + UNIQ + "," + windows("station") + f"""
SELECT * FROM win WHERE {AS_OF_COMPAT} - 3720 <= window_start AND window_end <= {AS_OF_COMPAT} - 60""",
    "awt_ordered": LAST + ORDERED,
    "awt_global": LAST + " SELECT count(station) AS number_of_stations, round(avg(awt), 9) AS global_awt FROM last",
    "awt_min": LAST + " SELECT station, awt AS min_awt FROM last ORDER BY awt, station LIMIT 1",
    "awt_max": LAST + " SELECT station, awt AS max_awt FROM last ORDER BY awt DESC, station LIMIT 1",
    "awt_with_station": LAST + "," + STATIONS + """
SELECT station, awt, label, latitude, longitude FROM last JOIN stations USING (station)""",
    "next_stop_events": "WITH " + UNIQ + """
SELECT station, train, departure, lead(departure) OVER w AS next_departure, lead(station) OVER w AS next_station,
       lead(departure) OVER w - departure AS time_to_st
FROM uniq WINDOW w AS (PARTITION BY train ORDER BY departure, station)""",
    "next_stop_lineitem": "WITH " + LINE_LEGS + """
SELECT station, train, departure, next_departure, next_station, time_to_st FROM line_legs""",
    "around_now": "WITH " + STOPS + " SELECT * FROM stops",
    "legs_in_progress": "WITH " + LEGS + """
SELECT train, station, departure, next_station, next_departure, next_departure - departure AS time_to_st FROM legs""",
    "train_progress_coarse": PROGRESS,
    "trains_by_direction": PUBLISHED + " SELECT train, direction, from_st, to_st FROM published WHERE direction = 1",
    "accurate_position": PUBLISHED + f"""
SELECT {PUBLISHED_COLUMNS},
       CASE WHEN from_st = to_st THEN a_lt ELSE coalesce({_along("lt", "progress")}, train_lt) END AS train_alt,
       CASE WHEN from_st = to_st THEN a_lg ELSE coalesce({_along("lg", "progress")}, train_lg) END AS train_alg
FROM published""",
    "positions_at_instant": PUBLISHED + f""",
moved AS (
  SELECT *, CASE WHEN {LATER} < departure_uts THEN 0.0::DOUBLE ELSE {_share(LATER)} END AS share FROM published
)
SELECT train, from_st, to_st, departure_uts, arrival_uts, share AS progress,
       CASE WHEN from_st = to_st THEN a_lt ELSE {_along("lt", "share")} END AS lat,
       CASE WHEN from_st = to_st THEN a_lg ELSE {_along("lg", "share")} END AS lon
FROM moved""",
    "positions_without_path": PUBLISHED + f""",
moved AS (
  SELECT *, CASE WHEN {LATER} < departure_uts THEN 0.0::DOUBLE ELSE {_share(LATER)} END AS share FROM published
)
SELECT train, from_st, to_st,
       coalesce(CASE WHEN from_st % 2 = 0 THEN CASE WHEN from_st = to_st THEN a_lt ELSE {_along("lt", "share")} END END, train_lt) AS lat,
       coalesce(CASE WHEN from_st % 2 = 0 THEN CASE WHEN from_st = to_st THEN a_lg ELSE {_along("lg", "share")} END END, train_lg) AS lon
FROM moved""",
    "cubic_position": PUBLISHED + f"""
SELECT train, from_st, to_st, progress,
       CAST(floor(coalesce({_cubic("lat", "CASE WHEN from_st = to_st THEN 0.0::DOUBLE ELSE progress END")}, train_lt)
                  * 1000000 + 0.5) AS BIGINT) AS lat,
       CAST(floor(coalesce({_cubic("lon", "CASE WHEN from_st = to_st THEN 0.0::DOUBLE ELSE progress END")}, train_lg)
                  * 1000000 + 0.5) AS BIGINT) AS lon
FROM published""",
    "cubic_track": PUBLISHED + f""",
moved AS (
  SELECT train, from_st, to_st, at_uts,
         CASE WHEN from_st = to_st THEN 0.0::DOUBLE ELSE {_share("at_uts")} END AS share
  FROM (
    SELECT *, unnest(generate_series({AS_OF} - 3600 + 60 * CAST(ceil(greatest(0, departure_uts - {AS_OF} + 3600) / 60) AS BIGINT),
                                     least({AS_OF} + 3600, arrival_uts), 60)) AS at_uts
    FROM published
  )
)
SELECT train, from_st, to_st, at_uts, CAST(floor({_cubic("lat", "share")} * 1000000 + 0.5) AS BIGINT) AS lat,
       CAST(floor({_cubic("lon", "share")} * 1000000 + 0.5) AS BIGINT) AS lon
FROM moved""",
    "spline_coefficients": PUBLISHED + """,
pieces AS (
  SELECT from_st, to_st, CAST(unnest(generate_series(0, (from_st * 7 + to_st) % 21 + 3)) AS INTEGER) AS seg,
         (from_st * 7 + to_st) % 21 + 4 AS n,
         0.0021371::DOUBLE AS p1, (to_st - 50) * 1.0373171e-6::DOUBLE AS p2, (from_st + 1) * 1.0117193e-8::DOUBLE AS p3,
         -0.0013177::DOUBLE AS q1, (from_st - 40) * 2.0719317e-6::DOUBLE AS q2, -(to_st + 2) * 1.0117193e-8::DOUBLE AS q3
  FROM (SELECT DISTINCT from_st, to_st FROM published WHERE to_st IS NOT NULL)
),
at_piece AS (SELECT *, 100.0::DOUBLE * seg / n AS x FROM pieces)
SELECT from_st, to_st, seg,
       CAST(floor((48.01::DOUBLE + from_st / 97.0::DOUBLE + p1 * x + p2 * x * x + p3 * x * x * x) * 1e6 + 0.5) AS BIGINT) AS a0,
       CAST(floor((p1 + 2 * p2 * x + 3 * p3 * x * x) * 1e7 + 0.5) AS BIGINT) AS a1,
       CAST(floor((p2 + 3 * p3 * x) * 1e9 + 0.5) AS BIGINT) AS a2, CAST(floor(p3 * 1e11 + 0.5) AS BIGINT) AS a3,
       CAST(floor((2.003::DOUBLE + to_st / 89.0::DOUBLE + q1 * x + q2 * x * x + q3 * x * x * x) * 1e6 + 0.5) AS BIGINT) AS b0,
       CAST(floor((q1 + 2 * q2 * x + 3 * q3 * x * x) * 1e7 + 0.5) AS BIGINT) AS b1,
       CAST(floor((q2 + 3 * q3 * x) * 1e9 + 0.5) AS BIGINT) AS b2, CAST(floor(q3 * 1e11 + 0.5) AS BIGINT) AS b3
FROM at_piece""",
    "positions_track": PUBLISHED + f""",
ticks AS (SELECT unnest(generate_series({AS_OF} - 3600, {AS_OF} + 3600, 60)) AS at_uts),
moved AS (
  SELECT *, {_share("at_uts")} AS share
  FROM published JOIN ticks ON at_uts BETWEEN departure_uts AND arrival_uts
)
SELECT train, from_st, to_st, departure_uts, arrival_uts, at_uts, share AS progress,
       a_lt + (share / 100.0::DOUBLE) * (b_lt - a_lt) AS lat,
       a_lg + (share / 100.0::DOUBLE) * (b_lg - a_lg) AS lon
FROM moved""",
    "ancestors_from_branches": "WITH RECURSIVE " + ANCESTORS + """
SELECT CAST(station AS INTEGER) AS station, CAST(ancestor AS INTEGER) AS ancestor FROM anc""",
    "ancestors_from_parents": "WITH RECURSIVE " + ANCESTORS + """
SELECT CAST(station AS INTEGER) AS station, CAST(ancestor AS INTEGER) AS ancestor, CAST(up AS INTEGER) AS up FROM anc""",
    "topology_edges": """
SELECT CAST(s_suppkey // 2 AS INTEGER) AS upper, CAST(s_suppkey AS INTEGER) AS lower,
       '0' || bin(s_suppkey) AS pos, CAST(s_suppkey % 2 AS INTEGER) AS slot,
       (SELECT string_agg(CAST(floor((48.8::DOUBLE + km / 1000) * 1000000 + 0.5) AS BIGINT) || ','
                          || CAST(floor((2.2::DOUBLE + km / 500) * 1000000 + 0.5) AS BIGINT), ' ' ORDER BY km)
        FROM (SELECT (s_suppkey // 2) + (o + 1) / 3.0::DOUBLE * (s_suppkey - s_suppkey // 2) AS km
              FROM generate_series(0, 1) g(o))) AS places
FROM supplier WHERE s_suppkey > 0""",
    "station_paths_mid_branch": "WITH RECURSIVE " + LINE_LEGS + """,
parents AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN s_suppkey - 2
                              WHEN s_suppkey < 10 THEN s_suppkey - 1 ELSE s_suppkey - 10 END AS parent
  FROM supplier
),
anc AS (
  SELECT k AS station, k AS ancestor, 0 AS up FROM parents
  UNION ALL
  SELECT station, parent, up + 1 FROM anc JOIN parents ON k = ancestor WHERE parent IS NOT NULL
),
pairs AS (
  SELECT DISTINCT station AS from_st, next_station AS to_st FROM line_legs WHERE next_station IS NOT NULL
),
turn AS (
  SELECT from_st, to_st, min(a.up) AS a_up, min(b.up) AS b_up
  FROM pairs JOIN anc a ON a.station = from_st JOIN anc b ON b.station = to_st AND b.ancestor = a.ancestor
  GROUP BY from_st, to_st
),
nodes AS (
  SELECT from_st, to_st, ancestor AS k, up < a_up AS below FROM turn JOIN anc ON station = from_st WHERE up <= a_up
  UNION ALL
  SELECT from_st, to_st, ancestor, true FROM turn JOIN anc ON station = to_st WHERE up < b_up
),
points AS (
  SELECT from_st, to_st, CAST(k AS DOUBLE) AS km FROM nodes
  UNION ALL
  SELECT from_st, to_st, (nodes.k + parent) / 2.0::DOUBLE FROM nodes JOIN parents ON parents.k = nodes.k WHERE below
)
SELECT from_st, to_st, CAST(count(*) AS INTEGER) AS number_step,
       CAST(sum(CAST(floor((48.8::DOUBLE + km / 1000) * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS lat_sum
FROM points GROUP BY from_st, to_st""",
    "station_paths": PATH_POINTS + """
SELECT from_st, to_st, string_agg(CAST(lat AS VARCHAR), ' ' ORDER BY idx) AS lats,
       string_agg(CAST(lon AS VARCHAR), ' ' ORDER BY idx) AS lons
FROM place GROUP BY from_st, to_st""",
    "path_lengths": PATH_POINTS + """
SELECT from_st, to_st, CAST(count(*) AS INTEGER) AS number_step FROM path GROUP BY from_st, to_st""",
    "spline_knots": PATH_POINTS + """
SELECT from_st, to_st, CAST(idx AS INTEGER) AS seg, lat AS start_lat, end_lat
FROM (SELECT *, lead(lat) OVER (PARTITION BY from_st, to_st ORDER BY idx) AS end_lat FROM place)
WHERE end_lat IS NOT NULL""",
    "spline_continuity": PATH_POINTS + """
SELECT from_st, to_st, CAST(idx AS INTEGER) AS seg, 0 AS a0, 0 AS a1, 0 AS a2, 0 AS a3, 0 AS b0, 0 AS b1, 0 AS b2, 0 AS b3
FROM (SELECT *, max(idx) OVER (PARTITION BY from_st, to_st) AS last FROM path) WHERE last >= 4 AND idx < last - 1""".replace(
        " 0 AS", " CAST(0 AS BIGINT) AS"),
    "known_terminus": "WITH " + DEP + """
SELECT event_id, station, terminus FROM dep WHERE terminus IN (SELECT s_suppkey FROM supplier)""",
    "terminus_station": "WITH " + DEP + "," + STATIONS + """
SELECT event_id, terminus, latitude AS terminus_lt, longitude AS terminus_lg, label AS terminus_lb
FROM dep LEFT JOIN stations ON stations.station = terminus""",
    "line_stations": """
SELECT CAST(s_suppkey AS INTEGER) AS station, s_name AS label, 0.0::DOUBLE AS latitude, 0.0::DOUBLE AS longitude
FROM supplier WHERE s_acctbal >= 0""",
    "coordinates_update": "WITH " + STATIONS + """,
places AS (
  SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS station, value, user_id FROM events
  QUALIFY row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY event_id DESC) = 1
)
SELECT stations.station, label, coalesce(value, latitude) AS latitude,
       coalesce(CAST(user_id AS DOUBLE), longitude) AS longitude
FROM stations LEFT JOIN places ON places.station = stations.station""",
    "upsert_dim": "WITH " + STATIONS + """
SELECT CAST(station AS BIGINT) AS station, label, latitude, longitude FROM stations
WHERE station NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT c_custkey, c_name, 0.0::DOUBLE, 0.0::DOUBLE FROM customer""",
    "keyed_stations": "WITH " + STATIONS + """
SELECT CAST(station AS VARCHAR) AS key, label, latitude, longitude FROM stations""",
    "keyed_bad_lines": """
SELECT CASE WHEN s_suppkey % 7 <> 3 THEN CAST(s_suppkey AS VARCHAR) END AS key,
       CASE WHEN s_suppkey % 7 <> 3 THEN s_name END AS label,
       CASE WHEN s_suppkey % 7 = 3 THEN substr('{"' || s_suppkey || '":{"label":"' || s_name || '"}}', 1, 12) END AS bad_value
FROM supplier""",
    "keyed_paths": PUBLISHED + """
SELECT DISTINCT from_st, to_st, 2 AS number_step, a_lt AS lat, b_lg AS lon FROM published
WHERE a_lt IS NOT NULL AND b_lt IS NOT NULL""",
    "csv_station_order": """
SELECT CAST(s_suppkey AS INTEGER) AS station, CASE WHEN s_suppkey = 0 THEN '0' ELSE '0' || bin(s_suppkey) END AS pos,
       0 AS order FROM supplier""".replace("AS order", 'AS "order"'),
    "csv_track_points": """
SELECT CAST(s_suppkey // 2 AS INTEGER) AS depart, CAST(s_suppkey AS INTEGER) AS arrivee, '0' AS path,
       CAST(o AS INTEGER) AS order_point, s_suppkey * 2 + o AS idreseau,
       CAST(floor((48.8::DOUBLE + km / 1000) * 1000000 + 0.5) AS BIGINT) AS lat,
       CAST(floor((2.2::DOUBLE + km / 500) * 1000000 + 0.5) AS BIGINT) AS lon
FROM (SELECT s_suppkey, o, (s_suppkey // 2) + (o + 1) / 3.0::DOUBLE * (s_suppkey - s_suppkey // 2) AS km
      FROM supplier, generate_series(0, 1) g(o) WHERE s_suppkey > 0)""",
    "json_open_data": """
SELECT CAST(s_suppkey AS INTEGER) AS station, s_name AS label, CASE WHEN s_acctbal >= 0 THEN '1' END AS on_line,
       CAST(row_number() OVER (PARTITION BY s_suppkey // 100 ORDER BY CAST(s_suppkey AS VARCHAR)) AS INTEGER) AS place
FROM supplier""",
    "locale_csv": "WITH " + STATIONS + """
SELECT station, label, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude FROM stations""",
    "csv_stations": "WITH " + STATIONS + " SELECT station, label, latitude, longitude FROM stations",
    "line_membership": """
SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id, i) - 1 AS pos, label
FROM (
  SELECT user_id, event_id, 0 AS i, event_type AS label FROM events
  UNION ALL SELECT user_id, event_id, 1, props FROM events
)""",
    "decode_mission": "WITH coded AS (SELECT event_id," + _MISSION + """ FROM events)
SELECT event_id, m1 || m2 || m3 || 'E' AS mission,
       CASE m1 WHEN 'B' THEN 'BECON LES BRUYERES' WHEN 'D' THEN 'SAINT-CLOUD' WHEN 'F' THEN 'MAISONS LAFFITTE'
               WHEN 'N' THEN 'NANTERRE UNIVERSITÉ' WHEN 'P' THEN 'PARIS SAINT-LAZARE (GARE SAINT-LAZARE)'
               WHEN 'R' THEN 'MARLY LE ROI' WHEN 'S' THEN 'SAINT-NOM LA BRETECHE FORET DE MARLY'
               WHEN 'U' THEN 'CERGY LE HAUT' WHEN 'V' THEN 'VERSAILLES RIVE DROITE' END AS mission_terminus,
       CASE m1 WHEN 'B' THEN 'L1,L2,L3,L4' WHEN 'D' THEN 'L1,L2' WHEN 'F' THEN 'L4' WHEN 'N' THEN 'L4'
               WHEN 'P' THEN 'L1,L2,L3,L4' WHEN 'R' THEN 'L2,L3' WHEN 'S' THEN 'L2,L3' WHEN 'U' THEN 'L4'
               WHEN 'V' THEN 'L1' END AS mission_lines,
       CASE m2 WHEN 'I' THEN 'direct' WHEN 'A' THEN 'semi direct' WHEN 'O' THEN 'omnibus'
               WHEN 'E' THEN 'autres dessertes' WHEN 'U' THEN 'autres dessertes' END AS mission_service,
       CASE m3 WHEN 'A' THEN 'Asnières sur Seine' WHEN 'B' THEN 'Bécon les Bruyères' WHEN 'C' THEN 'Clichy Levallois'
               WHEN 'L' THEN 'La Défense ou Les Vallées' WHEN 'M' THEN 'Nanterre Université'
               WHEN 'P' THEN 'Pont Cardinet' END AS mission_via
FROM coded""",
    "short_label": """
SELECT p_partkey, label, CASE WHEN length(label) > 16 THEN substr(label, 1, 12) || '...' ELSE label END AS short_label
FROM (SELECT p_partkey, p_brand || ' ' || p_name AS label FROM part)""",
    "map_layers": PUBLISHED + """
SELECT CASE WHEN train IS NOT NULL THEN 'train' ELSE 'station' END AS layer,
       train, train_lt, train_lg, station, label, latitude, longitude
FROM published FULL OUTER JOIN stations ON 0 = 1""",
    "map_layers_with_rail": PUBLISHED + "," + RAIL + """
SELECT 'train' AS layer, train, train_lt, train_lg, NULL AS station, NULL AS label, NULL AS latitude, NULL AS longitude,
       NULL AS code_ligne, NULL AS nom_voie, NULL AS end_no, NULL AS lat, NULL AS lon FROM published
UNION ALL SELECT 'station', NULL, NULL, NULL, station, label, latitude, longitude, NULL, NULL, NULL, NULL, NULL FROM stations
UNION ALL SELECT 'rail', NULL, NULL, NULL, NULL, NULL, NULL, NULL, code_ligne, nom_voie, 0, lat1, lon1 FROM rail
UNION ALL SELECT 'rail', NULL, NULL, NULL, NULL, NULL, NULL, NULL, code_ligne, nom_voie, 1, lat2, lon2 FROM rail""",
    "segment_endpoints": "WITH " + RAIL + """
SELECT code_ligne, nom_voie, 0 AS end_no, lat1 AS lat, lon1 AS lon FROM rail
UNION ALL SELECT code_ligne, nom_voie, 1, lat2, lon2 FROM rail""",
    "line_track": "WITH " + RAIL + " SELECT * FROM rail WHERE code_ligne IN ('A', 'N') AND nom_voie = 'V1'",
    "distinct_track_points": "WITH " + RAIL + """,
track AS (SELECT * FROM rail WHERE code_ligne IN ('A', 'N') AND nom_voie = 'V1')
SELECT lat1 AS lat, lon1 AS lon FROM track UNION SELECT lat2, lon2 FROM track""",
    "stream_awt": LAST + ORDERED,
    "stream_progress": PROGRESS,
    "stream_catalog": PROGRESS,
    "stream_late_rows": "WITH " + DEP + " SELECT station, train, departure, mode, mission, terminus, event_id FROM dep",
    "stream_awt_windows": "WITH " + DEP + "," + EVERY_WINDOW + " SELECT * FROM win",
    "stream_global_awt": "WITH " + DEP + "," + EVERY_WINDOW + """
SELECT window_end, count(station) AS number_of_stations, round(avg(awt), 9) AS global_awt FROM win
WHERE window_end <= (SELECT max(departure) - 60 FROM dep) GROUP BY window_end""",
    "stream_stops": "WITH " + DEP + f"""
SELECT CAST(event_id AS VARCHAR) AS train, station, departure, mode, mission, terminus FROM dep
WHERE mode = 'R' AND departure BETWEEN {AS_OF} - 86400 AND {AS_OF} + 86400""",
    "stream_panes": "WITH " + DEP + "," + EVERY_WINDOW + """
SELECT * FROM win WHERE window_end <= (SELECT max(departure) - 60 FROM dep)""",
}
ORACLE["stream_legs"] = ORACLE["next_stop_events"]
ORACLE["accurate_position_sql"] = ORACLE["cubic_position"]
ORACLE["next_stop_history"] = ORACLE["next_stop_lineitem"]
ORACLE["decode_variant_fields"] = "WITH " + DEP + """
SELECT event_id, CASE WHEN mission <> 'error' THEN station END AS station, train, departure, terminus,
       CASE WHEN mission = 'error' THEN 'station' ELSE '' END AS drifted,
       CASE mission WHEN 'view' THEN 'delay' WHEN 'purchase' THEN 'platform' ELSE '' END AS more_names,
       CASE mission WHEN 'view' THEN '5' WHEN 'purchase' THEN '{"name":"A","zone":[1,2]}' ELSE '' END AS more_values
FROM dep"""
ORACLE["locale_csv_commas"] = "WITH " + STATIONS + """,
texts AS (
  SELECT *, CASE WHEN station % 3 = 1 THEN floor(latitude)::INT::VARCHAR ELSE printf('%.3f', latitude) END AS lat,
         CASE WHEN station % 5 = 2 THEN floor(longitude)::INT::VARCHAR ELSE printf('%.3f', longitude) END AS lon
  FROM stations
),
fields AS (SELECT *, string_split(replace(lat || ',' || lon, '.', ','), ',') AS f FROM texts),
ways AS (
  SELECT *, len(f) AS n, f[1]::DOUBLE AS lat1, (f[1] || '.' || f[2])::DOUBLE AS lat2,
         CASE WHEN len(f) = 3 THEN (f[2] || '.' || f[3])::DOUBLE END AS lon2, f[len(f)]::DOUBLE AS lon1
  FROM fields
),
judged AS (
  SELECT *, n <> 3 OR (lat1 BETWEEN 48 AND 60 AND lon2 BETWEEN 2 AND 47)::INT + (lat2 BETWEEN 48 AND 60 AND lon1 BETWEEN 2 AND 47)::INT = 1 AS good
  FROM ways
)
SELECT CASE WHEN good THEN station END AS station, CASE WHEN good THEN label END AS label,
       CASE WHEN good THEN lat::DOUBLE END AS latitude, CASE WHEN good THEN lon::DOUBLE END AS longitude,
       CASE WHEN NOT good THEN station || ',' || label || ',' || replace(lat || ',' || lon, '.', ',') END AS bad_value
FROM judged"""
ORACLE["boards_stream"] = "WITH " + DEP + """
SELECT station, train, departure, 'R' AS mode, upper(mission) AS mission, terminus, NULL::VARCHAR AS bad_value FROM dep
UNION ALL
SELECT station, CAST(CAST(train AS BIGINT) + 1 AS VARCHAR), departure + 300, 'R', upper(mission), terminus, NULL
FROM dep WHERE mission <> 'view'"""
