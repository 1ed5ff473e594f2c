"""Rasters, polygons and scenes derived from the driver's tables by plain arithmetic, as SQL that Spark and DuckDB both read.

A grid has 100 columns; null stands for a masked value. Integer division is written // and becomes div for Spark.
"""

from __future__ import annotations

BANDS = ("B02", "B03", "B04", "B08", "B05", "B06", "B07", "B8A", "B11", "B12")
#: Class ids, names and colours of the scheme.
CLASSES = (
    (1, "Artificial surfaces", "e6004d"), (2, "Arable land", "ffffa8"), (3, "Permanent crops", "e68000"), (4, "Pastures", "e6e64d"), (5, "Heterogeneous agriculture", "ffe6a6"), (6, "Broad-leaved forest", "80ff00"),
    (7, "Coniferous forest", "00a600"), (8, "Mixed forest", "4dff00"), (9, "Scrub / herbaceous", "a6ff80"), (10, "Open spaces, little vegetation", "ccffcc"), (11, "Wetlands", "a6a6ff"), (12, "Water bodies", "00ccf2"),
)

_dn = ", ".join(f"CAST((v * {3 + 7 * i} + event_id * {i + 1}) % 6000 AS INT) AS dn_{b}" for i, b in enumerate(BANDS))
_five = lambda x: f"CASE {x} WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 6 END"
_ref = lambda b: f"CASE WHEN dn_{b} <> 0 THEN (dn_{b} - 1000) / 10000.0E0 END AS {b}"
_nd = lambda a, b, n: f"CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END AS {n}"

VIEWS = {
    "classes": " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS class_id, '{n}' AS class_name, '{c}' AS colour" for i, n, c in CLASSES),
    "pixels": f"SELECT CAST(event_id // 100 AS INT) AS r, CAST(event_id % 100 AS INT) AS c, event_id, user_id, CAST(event_id * 7 % 12 AS INT) AS scl, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 4 WHEN 'error' THEN 5 ELSE 6 END AS label, {_five('(event_id * 13 + user_id) % 5')} AS pred, props, {_dn} FROM (SELECT *, CAST(floor(value * 20) AS BIGINT) AS v FROM events) e",
    "reflect": f"SELECT r, c, scl, label, pred, {', '.join(map(_ref, BANDS))} FROM pixels",
    "indexed": f"SELECT *, scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND {' AND '.join(f'{b} IS NOT NULL' for b in BANDS)} AS valid, {_nd('B08', 'B04', 'NDVI')}, {_nd('B03', 'B08', 'NDWI')}, {_nd('B11', 'B08', 'NDBI')}, {_nd('B08', 'B05', 'NDRE')}, {_nd('B11', 'B12', 'NBR2')} FROM reflect",
    "smooth": f"SELECT r, c, {_five('(r // 7 + c // 11) % 5')} AS label, {_five('((r + 2) // 7 + c // 11) % 5')} AS pred FROM pixels",
    "wide": f"SELECT r, c, {_five('(r // 97 + c // 50) % 5')} AS label, CASE WHEN event_id % 7 = 0 THEN {_five('(event_id * 13 + user_id) % 5')} ELSE {_five('(r // 97 + c // 50) % 5')} END AS pred FROM pixels",
    "blocks": "SELECT r, c, label, pred, valid, r // 20 * 5 + c // 20 AS block FROM indexed",
    "polys": "SELECT p_partkey AS poly_id, p_partkey * 37 % 2000 * 10.0E0 AS x0, p_partkey * 91 % 2000 * 10.0E0 AS y0, p_partkey * 37 % 2000 * 10.0E0 + p_size * 10 AS x1, p_partkey * 91 % 2000 * 10.0E0 + p_size * 10 AS y1, CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 7 ELSE 8 END AS class_id FROM part",
    "named": "SELECT p.*, k.class_name, (x1 - x0) * (y1 - y0) AS area FROM polys p LEFT JOIN classes k ON k.class_id = p.class_id",
    "communes": "SELECT lpad(CAST(s_suppkey AS VARCHAR(20)), 4, '0') AS lau2, s_name AS commune, n_name AS canton, s_suppkey % 10 * 2000.0E0 AS x0, s_suppkey // 10 % 10 * 2000.0E0 AS y0, s_suppkey % 10 * 2000.0E0 + 2000 AS x1, s_suppkey // 10 % 10 * 2000.0E0 + 2000 AS y1 FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "reference": "SELECT c_custkey AS ref_id, c_custkey % 40 * 500.0E0 AS x0, c_custkey // 40 % 40 * 500.0E0 AS y0, c_custkey % 40 * 500.0E0 + 500 AS x1, c_custkey // 40 % 40 * 500.0E0 + 500 AS y1, k.class_id, k.class_name FROM customer LEFT JOIN classes k ON k.class_id = CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 6 WHEN 'HOUSEHOLD' THEN 4 END",
    "aoi": "SELECT 1000.0E0 AS x0, 1000.0E0 AS y0, 18500.0E0 AS x1, 18500.0E0 AS y1",
    "commune_aoi_v": "SELECT lau2, commune, canton, g.x0, g.y0, g.x1, g.y1, greatest(g.x0, a.x0) AS ix0, greatest(g.y0, a.y0) AS iy0, least(g.x1, a.x1) AS ix1, least(g.y1, a.y1) AS iy1, (g.x1 - g.x0) * (g.y1 - g.y0) / 1e6 AS commune_area_km2, (least(g.x1, a.x1) - greatest(g.x0, a.x0)) * (least(g.y1, a.y1) - greatest(g.y0, a.y0)) / 1e6 AS covered_area_km2, (least(g.x1, a.x1) - greatest(g.x0, a.x0)) * (least(g.y1, a.y1) - greatest(g.y0, a.y0)) / nullif((g.x1 - g.x0) * (g.y1 - g.y0), 0) AS covered_fraction FROM communes g JOIN aoi a ON least(g.x1, a.x1) > greatest(g.x0, a.x0) AND least(g.y1, a.y1) > greatest(g.y0, a.y0)",
    "scenes": "SELECT 'S' || CAST(o_orderkey AS VARCHAR(20)) AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS day, o_totalprice / 5000 AS cloud, o_custkey % 7 * 0.05E0 + 5.9E0 AS west, o_custkey % 5 * 0.05E0 + 49.4E0 AS south, o_custkey % 7 * 0.05E0 + 6.4E0 AS east, o_custkey % 5 * 0.05E0 + 49.9E0 AS north, CASE WHEN o_orderstatus = 'F' THEN 'MGRS-31UGR' ELSE '' END AS grid_code, CAST(30 + o_orderkey % 3 AS INT) AS utm_zone, 'U' AS latitude_band, 'G' || substr(o_orderpriority, 1, 1) AS grid_square, o_orderstatus = 'P' AS offset_applied, CASE o_orderkey % 5 WHEN 0 THEN '05.11' WHEN 1 THEN '04.00' WHEN 2 THEN '03.01' WHEN 3 THEN 'not-a-number' END AS baseline FROM orders",
}


def closure(sql: str, more: dict[str, str] | None = None) -> list[str]:
    """The views that a text needs, in order of definition."""
    import re

    defined = VIEWS | (more or {})
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in defined:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(defined[name])
    return [n for n in defined if n in found]
