"""SQL that states each registered query independently, for another engine."""

from __future__ import annotations

# Fixed values of the catalogue's queries.
LEVEL = 4_000_000.0

FIELD = """field AS (
  SELECT l_shipdate AS time, l_linenumber AS depth, l_quantity AS latitude, l_discount AS longitude,
         floor(l_extendedprice * 100 + 0.5) AS so, floor(l_tax * 100 + 0.5) AS tx
  FROM lineitem)"""

CHL = """chl AS (
  SELECT o_orderdate AS time, c_nationkey AS latitude, c_mktsegment AS segment,
         floor(o_totalprice * 100 + 0.5) AS CHL
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def season(time: str) -> str:
    return (f"CASE WHEN month({time}) IN (12, 1, 2) THEN 'DJF' WHEN month({time}) IN (3, 4, 5) THEN 'MAM' "
            f"WHEN month({time}) IN (6, 7, 8) THEN 'JJA' WHEN month({time}) IN (9, 10, 11) THEN 'SON' END")


def month(time: str = "time") -> str:
    return f"CAST(month({time}) AS INTEGER)"


def axis(name: str, dim: str, source: str = "field") -> str:
    return (f"{name} AS (SELECT {dim}, row_number() OVER (ORDER BY {dim}) - 1 AS i "
            f"FROM (SELECT DISTINCT {dim} FROM {source}))")


LINES = """SELECT l_linenumber AS depth, l_quantity AS latitude, l_discount AS longitude, l_shipdate AS time"""

TOP = "depth = (SELECT min(depth) FROM field)"

SEASON_TOP = f"""a2 AS (
  SELECT {season('time')} AS season, latitude, longitude, avg(so) AS v
  FROM field WHERE {TOP} GROUP BY ALL)"""

ISOLINE = f"""{SEASON_TOP}, {axis('ilat', 'latitude')}, {axis('ilon', 'longitude')},
cells AS (
  SELECT season, latitude, longitude, v, ilat.i AS y, ilon.i AS x
  FROM a2 JOIN ilat USING (latitude) JOIN ilon USING (longitude)),
pairs AS (
  SELECT a.season, 'longitude' AS edge, a.v AS v0, b.v AS v1, a.latitude, a.longitude,
         b.latitude AS lat1, b.longitude AS lon1
  FROM cells a JOIN cells b ON a.season = b.season AND a.y = b.y AND b.x = a.x + 1
  UNION ALL
  SELECT a.season, 'latitude', a.v, b.v, a.latitude, a.longitude, b.latitude, b.longitude
  FROM cells a JOIN cells b ON a.season = b.season AND a.x = b.x AND b.y = a.y + 1),
points AS (
  SELECT season, edge,
         round(latitude + ({LEVEL} - v0) / (v1 - v0) * (lat1 - latitude), 6) AS latitude,
         round(longitude + ({LEVEL} - v0) / (v1 - v0) * (lon1 - longitude), 6) AS longitude
  FROM pairs WHERE (v0 < {LEVEL}) <> (v1 < {LEVEL}))"""

# Corners of a grid cell: a, east b, north c, north-east d; sides in the order south, west, north, east.
SEGMENTS = f"""{SEASON_TOP}, {axis('ilat', 'latitude')}, {axis('ilon', 'longitude')},
cells AS (
  SELECT season, latitude, longitude, v, ilat.i AS y, ilon.i AS x
  FROM a2 JOIN ilat USING (latitude) JOIN ilon USING (longitude)),
squares AS (
  SELECT a.season, a.v AS va, b.v AS vb, c.v AS vc, d.v AS vd, a.latitude AS y0, c.latitude AS y1, a.longitude AS x0, b.longitude AS x1
  FROM cells a JOIN cells b ON a.season = b.season AND a.y = b.y AND b.x = a.x + 1
  JOIN cells c ON a.season = c.season AND a.x = c.x AND c.y = a.y + 1
  JOIN cells d ON a.season = d.season AND d.x = b.x AND d.y = c.y),
sides AS (
  SELECT season, va, vb, vc, vd,
    CASE WHEN (va < {LEVEL}) <> (vb < {LEVEL}) THEN [y0, x0 + ({LEVEL} - va) / (vb - va) * (x1 - x0)] END AS s,
    CASE WHEN (va < {LEVEL}) <> (vc < {LEVEL}) THEN [y0 + ({LEVEL} - va) / (vc - va) * (y1 - y0), x0] END AS w,
    CASE WHEN (vc < {LEVEL}) <> (vd < {LEVEL}) THEN [y1, x0 + ({LEVEL} - vc) / (vd - vc) * (x1 - x0)] END AS n,
    CASE WHEN (vb < {LEVEL}) <> (vd < {LEVEL}) THEN [y0 + ({LEVEL} - vb) / (vd - vb) * (y1 - y0), x1] END AS e
  FROM squares),
pieces AS (
  SELECT season, coalesce(s, w, n) AS p, coalesce(e, n, w) AS q FROM sides
  WHERE (s IS NULL)::INT + (w IS NULL)::INT + (n IS NULL)::INT + (e IS NULL)::INT = 2
  UNION ALL SELECT season, s, CASE WHEN (va < {LEVEL}) <> ((va + vb + vc + vd) / 4 < {LEVEL}) THEN w ELSE e END
  FROM sides WHERE s IS NOT NULL AND w IS NOT NULL AND n IS NOT NULL AND e IS NOT NULL
  UNION ALL SELECT season, CASE WHEN (va < {LEVEL}) <> ((va + vb + vc + vd) / 4 < {LEVEL}) THEN n ELSE w END,
    CASE WHEN (va < {LEVEL}) <> ((va + vb + vc + vd) / 4 < {LEVEL}) THEN e ELSE n END
  FROM sides WHERE s IS NOT NULL AND w IS NOT NULL AND n IS NOT NULL AND e IS NOT NULL)"""

SECTION = f"""a1 AS (
  SELECT {month()} AS month, latitude, longitude, floor(avg(so) + 0.5) AS so
  FROM field WHERE {TOP} GROUP BY ALL),
section AS (SELECT month, latitude, avg(so) AS so FROM a1 GROUP BY ALL)"""

PROFILE = f"""{axis('ilat', 'latitude')}, {axis('ilon', 'longitude')},
water AS (
  SELECT depth, so, tx, so * 2 + tx AS w FROM field JOIN ilat USING (latitude) JOIN ilon USING (longitude)
  WHERE ilat.i = 20 + 1 AND ilon.i = 4 + 1),
profile AS (
  SELECT d.depth, avg(so) AS u, avg(tx) AS v, avg(w) AS w FROM (SELECT DISTINCT depth FROM field) d
  LEFT JOIN water USING (depth) GROUP BY d.depth)"""

SQL: dict[str, str] = {
    "q_subset_box": f"""{LINES}, l_extendedprice AS so FROM lineitem
WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity BETWEEN 10 AND 20
  AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""",
    "q_subset_variables": f"""{LINES}, l_extendedprice AS so, l_tax AS tx FROM lineitem
WHERE l_quantity BETWEEN 40 AND 50""",
    "q_depth_nearest": f"""{LINES}, l_extendedprice AS so FROM lineitem
WHERE l_linenumber = (SELECT l_linenumber FROM lineitem
                      ORDER BY abs(l_linenumber - 2.3), l_linenumber DESC LIMIT 1)""",
    "q_lazy_open": """SELECT ts AS time, event_type, user_id, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
    "q_year_requests": f"""WITH {FIELD} SELECT time, depth, latitude, longitude, so FROM field
WHERE time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
   OR time BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'
   OR time BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-12-31'""",
    "q_multi_open": f"""WITH {FIELD} SELECT CAST(year(time) AS INTEGER) AS year, count(*) AS cells,
  avg(so) AS so, avg(tx) AS tx FROM field GROUP BY ALL""",
    "q_reopened_subset": f"""WITH {FIELD} SELECT time, latitude, longitude, so, tx FROM field
WHERE {TOP} AND latitude BETWEEN 10 AND 20
  AND time BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'""",
    "q_duplicate_cells": f"""WITH {FIELD} SELECT time, depth, latitude, longitude, count(*) AS copies
FROM field GROUP BY ALL HAVING count(*) > 1""",
    "q_info": f"""WITH {FIELD}
SELECT 'dim' AS kind, 'time' AS name, 'timestamp_ntz' AS dtype, count(DISTINCT time) AS size FROM field
UNION ALL SELECT 'dim', 'depth', 'int', count(DISTINCT depth) FROM field
UNION ALL SELECT 'dim', 'latitude', 'double', count(DISTINCT latitude) FROM field
UNION ALL SELECT 'dim', 'longitude', 'double', count(DISTINCT longitude) FROM field
UNION ALL SELECT 'var', 'so', 'double', NULL
UNION ALL SELECT 'var', 'tx', 'double', NULL""",
    "q_isel_point": f"""WITH {FIELD}, {axis('idepth', 'depth')}, {axis('ilat', 'latitude')}, {axis('ilon', 'longitude')}
SELECT time, so, tx FROM field JOIN idepth USING (depth) JOIN ilat USING (latitude) JOIN ilon USING (longitude)
WHERE idepth.i = 2 AND ilat.i = 10 AND ilon.i = 3""",
    "q_isel_mixed": f"""WITH {FIELD}, {axis('idepth', 'depth')}, {axis('ilat', 'latitude')}, {axis('ilon', 'longitude')}
SELECT time, latitude, longitude, so, tx
FROM field JOIN idepth USING (depth) JOIN ilat USING (latitude) JOIN ilon USING (longitude)
WHERE idepth.i = 0 AND ilat.i >= 3 AND ilat.i < 6 AND ilon.i >= 8 AND ilon.i < 20""",
    "q_isel_slice_chain": f"""WITH {FIELD}, {axis('ilat', 'latitude')}, {axis('ilon', 'longitude')}
SELECT time, depth, so, tx FROM field JOIN ilat USING (latitude) JOIN ilon USING (longitude)
WHERE ilat.i = 10 + 1 AND ilon.i = 4 + 1""",
    "q_snapshot": f"""WITH {FIELD} SELECT depth, latitude, longitude, so, tx FROM field
WHERE time = (SELECT min(time) FROM field)""",
    "q_sel_season": f"""WITH {FIELD}, {SEASON_TOP} SELECT latitude, longitude, v AS so FROM a2 WHERE season = 'JJA'""",
    "q_squeeze": f"""WITH {FIELD}, {axis('ilon', 'longitude')}
SELECT time, latitude, so FROM field JOIN ilon USING (longitude) WHERE {TOP} AND ilon.i = 2""",
    "q_axis_positions": f"""WITH {FIELD}, {axis('ilon', 'longitude')} SELECT longitude, i AS position FROM ilon""",
    "q_drop_dims": """SELECT DISTINCT l_orderkey AS place, floor(o_totalprice * 100 + 0.5) AS zos
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "q_time_parts": f"""WITH {FIELD} SELECT DISTINCT time, {month()} AS month, {season('time')} AS season FROM field""",
    "q_month_clim": f"""WITH {FIELD} SELECT {month()} AS month, depth, latitude, longitude, avg(so) AS so
FROM field GROUP BY ALL""",
    "q_month_clim_surface": f"""WITH {FIELD} SELECT {month()} AS month, latitude, longitude, avg(so) AS so, avg(tx) AS tx
FROM field WHERE {TOP} GROUP BY ALL""",
    "q_month_clim_chl": f"""WITH {CHL} SELECT {month()} AS month, latitude, segment, avg(CHL) AS CHL
FROM chl GROUP BY ALL""",
    "q_season_mean": f"""WITH {FIELD} SELECT {season('time')} AS season, depth, latitude, longitude,
  avg(so) AS so, avg(tx) AS tx FROM field GROUP BY ALL""",
    "q_season_mean_chl": f"""WITH {CHL} SELECT {season('time')} AS season, latitude, segment, avg(CHL) AS CHL
FROM chl GROUP BY ALL""",
    "q_skipna": f"""WITH {FIELD}, holed AS (
  SELECT time, depth, latitude, longitude, CASE WHEN depth = 7 THEN 'nan'::DOUBLE ELSE so END AS so FROM field)
SELECT {month()} AS month, depth, latitude, longitude, avg(so) FILTER (WHERE NOT isnan(so)) AS so
FROM holed GROUP BY {month()}, depth, latitude, longitude""",
    "q_zonal_of_clim": f"""WITH {FIELD}, a1 AS (
  SELECT {month()} AS month, depth, latitude, longitude, floor(avg(so) + 0.5) AS so FROM field GROUP BY ALL)
SELECT month, depth, latitude, avg(so) AS so FROM a1 GROUP BY ALL""",
    "q_zonal_daily": f"""WITH {FIELD} SELECT time, latitude, depth, avg(so) AS so FROM field GROUP BY ALL""",
    "q_time_mean": f"""WITH {FIELD} SELECT depth, latitude, longitude, avg(so) AS so, avg(tx) AS tx
FROM field GROUP BY ALL""",
    "q_robust_limits": f"""WITH {FIELD}, a2 AS (
  SELECT {season('time')} AS season, depth, latitude, longitude, avg(so) AS so FROM field GROUP BY ALL)
SELECT round(quantile_cont(so, 0.02), 6) AS vmin, round(quantile_cont(so, 0.98), 6) AS vmax FROM a2""",
    "q_robust_section": f"""WITH {FIELD}, daily AS (
  SELECT time, depth, latitude, avg(so) AS so FROM field GROUP BY ALL)
SELECT round(quantile_cont(so, 0.02), 6) AS vmin, round(quantile_cont(so, 0.98), 6) AS vmax FROM daily""",
    "q_extents": f"""WITH {FIELD}, a2 AS (
  SELECT {season('time')} AS season, depth, latitude, longitude, avg(so) AS so FROM field GROUP BY ALL)
SELECT min(so) AS so_min, max(so) AS so_max, min(latitude) AS latitude_min, max(latitude) AS latitude_max,
  min(longitude) AS longitude_min, max(longitude) AS longitude_max FROM a2""",
    "q_profile_table": f"""WITH {FIELD}, {PROFILE}
SELECT depth AS "depth [m]", u AS "u [m/s]", v AS "v [m/s]", w AS "w[m/s]" FROM profile""",
    "q_profile_long": f"""WITH {FIELD}, {PROFILE}
SELECT depth AS "depth [m]", 'u [m/s]' AS series, u AS value FROM profile
UNION ALL SELECT depth, 'v [m/s]', v FROM profile
UNION ALL SELECT depth, 'w[m/s]', w FROM profile""",
    "q_profile_window": f"""WITH {FIELD}, {axis('ilat', 'latitude')}, {axis('ilon', 'longitude')}
SELECT depth * 10.0::DOUBLE AS depth, avg(so * 2 + tx) AS w FROM field JOIN ilat USING (latitude) JOIN ilon USING (longitude)
WHERE ilat.i = 21 AND ilon.i = 5 AND depth * 10 BETWEEN 0 AND 50 GROUP BY depth""",
    "q_overlay_season": f"""WITH {FIELD}, {CHL},
c AS (SELECT {season('time')} AS season, latitude, segment, avg(CHL) AS CHL FROM chl GROUP BY ALL),
s AS (SELECT {season('time')} AS season, latitude, longitude, avg(so) AS so FROM field WHERE {TOP} GROUP BY ALL)
SELECT 'chl' AS layer, season, CAST(latitude AS DOUBLE) AS latitude, segment, CHL, CAST(NULL AS DOUBLE) AS longitude,
  CAST(NULL AS DOUBLE) AS so FROM c
UNION ALL SELECT 'salt', season, latitude, NULL, NULL, longitude, so FROM s WHERE season IN (SELECT season FROM c)""",
    "q_plume_layers": f"""WITH {FIELD}, {CHL}, {ISOLINE},
c AS (SELECT {season('time')} AS season, latitude, segment, avg(CHL) AS CHL FROM chl GROUP BY ALL)
SELECT 'field' AS layer, season, CAST(latitude AS DOUBLE) AS latitude, segment, CHL, CAST(NULL AS VARCHAR) AS edge,
  CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS VARCHAR) AS label FROM c
UNION ALL SELECT 'edge', season, latitude, NULL, NULL, edge, longitude, '4000000' FROM points
  WHERE season IN (SELECT season FROM c)""",
    "q_facet_pivot": f"""WITH {FIELD} SELECT latitude, longitude,
  avg(so) FILTER (WHERE {season('time')} = 'DJF') AS DJF, avg(so) FILTER (WHERE {season('time')} = 'JJA') AS JJA,
  avg(so) FILTER (WHERE {season('time')} = 'MAM') AS MAM, avg(so) FILTER (WHERE {season('time')} = 'SON') AS SON
FROM field WHERE {TOP} GROUP BY latitude, longitude""",
    "q_facet_labels": f"""WITH {FIELD} SELECT row_number() OVER (ORDER BY season) - 1 AS panel, season
FROM (SELECT DISTINCT {season('time')} AS season FROM field)""",
    "q_isoline": f"""WITH {FIELD}, {ISOLINE} SELECT season, edge, latitude, longitude FROM points""",
    "q_bands": f"""WITH {FIELD}, {SECTION}
SELECT month, latitude, so, CAST(floor((so - 0.0) / 500000.0) AS BIGINT) AS band FROM section""",
    "q_robust_bands": f"""WITH {FIELD}, {SECTION},
lim AS (SELECT quantile_cont(so, 0.02) AS lo, quantile_cont(so, 0.98) AS hi FROM section),
raw AS (SELECT lo, hi, (hi - lo) / 6 AS wanted, pow(10.0, floor(log10((hi - lo) / 6))) AS power FROM lim),
step AS (SELECT lo, hi, (SELECT min(m * power) FROM (VALUES (1.0::DOUBLE), (1.5), (2.0), (2.5), (3.0), (4.0), (5.0),
  (6.0), (8.0), (10.0)) t(m) WHERE m * power >= wanted) AS step FROM raw),
edge AS (SELECT floor(lo / step) AS first, ceil(hi / step) AS last, step FROM step)
SELECT month, latitude, so, CAST(CASE WHEN so = last * step THEN last - first - 1
  ELSE greatest(least(floor(so / step), last), first - 1) - first END AS INTEGER) AS band
FROM section CROSS JOIN edge""",
    "q_hovmoller_clip": f"""WITH {FIELD}, {SECTION}
SELECT month, latitude, CASE WHEN so IS NOT NULL THEN least(greatest(so, 2000000.0::DOUBLE), 6000000.0::DOUBLE) END AS so
FROM section""",
    "q_hovmoller_chl": f"""WITH {CHL}, a1 AS (
  SELECT {month()} AS month, latitude, segment, floor(avg(CHL) + 0.5) AS CHL FROM chl GROUP BY ALL)
SELECT month, latitude, avg(CHL) AS CHL FROM a1 GROUP BY ALL""",
    "q_season_null_time": f"""WITH {FIELD}, holed AS (
  SELECT CASE WHEN depth < 7 THEN time END AS time, latitude, longitude, so FROM field)
SELECT {season('time')} AS season, latitude, avg(so) AS so FROM holed WHERE time IS NOT NULL GROUP BY ALL""",
    "q_mean_all_dims": f"""WITH {FIELD} SELECT avg(so) AS so, avg(tx) AS tx FROM field""",
    "q_robust_hot_value": f"""WITH {FIELD}, hot AS (
  SELECT CASE WHEN depth <= 4 THEN 3000000.0::DOUBLE ELSE so END AS so FROM field)
SELECT round(quantile_cont(so, 0.02), 6) AS vmin, round(quantile_cont(so, 0.98), 6) AS vmax FROM hot""",
    "q_subset_stored": f"""{LINES}, l_extendedprice AS so FROM lineitem
WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity BETWEEN 10 AND 20""",
    "q_subset_years_added": """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS cells, max(l_extendedprice) AS so
FROM lineitem WHERE l_quantity >= 25 AND (l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
   OR l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31') GROUP BY ALL""",
    "q_year_replaced": """WITH days AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS latitude FROM lineitem
  WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
     OR l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31')
SELECT 'old' AS state, year, count(*) AS cells, min(latitude) AS latitude FROM days GROUP BY ALL
UNION ALL SELECT 'new', year, count(*), min(latitude) FROM days WHERE year = 1996 OR latitude >= 25 GROUP BY ALL""",
    "q_store_report": f"""WITH {FIELD}, n AS (SELECT count(*) AS cells FROM field)
SELECT 'dim' AS kind, 'time' AS name, (SELECT cells FROM n) AS cells, CAST(NULL AS BIGINT) AS missing,
  CAST(min(time) AS VARCHAR) AS first, CAST(max(time) AS VARCHAR) AS last FROM field
UNION ALL SELECT 'dim', 'depth', (SELECT cells FROM n), NULL, CAST(min(depth) AS VARCHAR), CAST(max(depth) AS VARCHAR) FROM field
UNION ALL SELECT 'dim', 'latitude', (SELECT cells FROM n), NULL, CAST(min(latitude) AS VARCHAR), CAST(max(latitude) AS VARCHAR) FROM field
UNION ALL SELECT 'dim', 'longitude', (SELECT cells FROM n), NULL, CAST(min(longitude) AS VARCHAR), CAST(max(longitude) AS VARCHAR) FROM field
UNION ALL SELECT 'var', 'so', (SELECT cells FROM n), count(*) FILTER (WHERE depth = 7), NULL, NULL FROM field""",
    "q_mixed_dims": """SELECT coalesce(l_orderkey, o_orderkey) AS place, avg(floor(l_extendedprice * 100 + 0.5)) AS so,
  floor(any_value(o_totalprice) * 100 + 0.5) AS zos FROM lineitem FULL JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "q_mixed_drop": """SELECT o_orderkey AS place, floor(o_totalprice * 100 + 0.5) AS zos FROM orders""",
    "q_mixed_stored": f"""WITH {FIELD}, {axis('ilat', 'latitude')},
flat AS (SELECT time, latitude, longitude, max(tx) AS tx FROM field WHERE depth = 1 GROUP BY ALL),
deep AS (SELECT {season('time')} AS season, latitude, longitude, avg(so) AS so FROM field JOIN ilat USING (latitude)
  WHERE depth = 2 AND ilat.i >= 5 AND ilat.i < 9 GROUP BY ALL),
top AS (SELECT {season('time')} AS season, latitude, longitude, avg(tx) AS tx FROM flat JOIN ilat USING (latitude)
  WHERE ilat.i >= 5 AND ilat.i < 9 GROUP BY ALL)
SELECT season, latitude, longitude, so, tx FROM deep FULL JOIN top USING (season, latitude, longitude)""",
    "q_isoline_segments": f"""WITH {FIELD}, {SEGMENTS} SELECT season, round(p[1], 6) AS latitude_from, round(p[2], 6) AS longitude_from,
  round(q[1], 6) AS latitude_to, round(q[2], 6) AS longitude_to FROM pieces""",
    "q_clim_incremental": f"""WITH {FIELD} SELECT {month()} AS month, depth, latitude, longitude, avg(so) AS so, avg(tx) AS tx
FROM field WHERE latitude >= 25 OR time NOT BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31' GROUP BY ALL""",
    "q_clim_seasons_kept": f"""WITH {FIELD}, {axis('ilat', 'latitude')}, holed AS (
  SELECT time, depth, latitude, longitude, CASE WHEN depth < 7 THEN so END AS so FROM field JOIN ilat USING (latitude) WHERE ilat.i < 4)
SELECT {season('time')} AS season, depth, latitude, longitude, avg(so) AS so FROM holed GROUP BY ALL""",
    "q_box_day_layout": f"""WITH {FIELD} SELECT *, 'box' AS part FROM field
WHERE latitude BETWEEN 10 AND 14 AND longitude BETWEEN 0.02 AND 0.04
UNION ALL SELECT *, 'day' FROM field WHERE time = TIMESTAMP '1997-03-05'""",
    "q_isel_stored": f"""WITH {FIELD}, {axis('ilat', 'latitude')}, {axis('ilon', 'longitude')}
SELECT time, depth, so, tx FROM field JOIN ilat USING (latitude) JOIN ilon USING (longitude)
WHERE ilat.i = 10 + 1 AND ilon.i = 4 + 1""",
    "q_year_refetched_empty": """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS cells
FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' GROUP BY ALL""",
    "q_store_descending": f"""WITH {FIELD}, {axis('ilat', 'latitude')}
SELECT time, depth, longitude, so FROM field JOIN ilat USING (latitude)
WHERE ilat.i = (SELECT max(i) FROM ilat) - 1 AND time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'""",
    "q_store_sparse_axis": f"""WITH {FIELD}, {axis('ilat', 'latitude')}
SELECT time, depth, longitude, so FROM field JOIN ilat USING (latitude)
WHERE ilat.i = 30 AND latitude NOT BETWEEN 5 AND 15 AND time >= TIMESTAMP '1998-01-01'""",
    "q_combine_names": f"""WITH {FIELD} SELECT time, depth, latitude, longitude, so, CAST(NULL AS DOUBLE) AS tx FROM field WHERE depth <= 3
UNION ALL SELECT time, depth, latitude, longitude, NULL, tx FROM field WHERE depth > 3""",
    "q_profile_instant": f"""WITH {FIELD}, {PROFILE},
years AS (SELECT date_trunc('year', time) AS t, depth, floor(avg(so) + 0.5) AS u, floor(avg(tx) + 0.5) AS v
  FROM field JOIN ilat USING (latitude) JOIN ilon USING (longitude) WHERE ilat.i = 21 AND ilon.i = 5 GROUP BY ALL),
stamps AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT date_trunc('year', time) AS t FROM field))
SELECT p.depth AS "depth [m]", y.u AS "u [m/s]", y.v AS "v [m/s]", p.w AS "w[m/s]"
FROM profile p LEFT JOIN (SELECT depth, u, v FROM years JOIN stamps USING (t) WHERE i = 2) y USING (depth)""",
}
