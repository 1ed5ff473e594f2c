"""Polygons of the derived views as rings, and SQL of what they share, for DuckDB.

Rings are lists of corners over the columns of a view; outer rings run against the clock, holes with it. Spark gets them as arrays,
DuckDB as rows of edges (x range, slope, height at 0, sign).
"""

from __future__ import annotations

Corner = tuple[str, str]

_part = lambda p, f: f"({p}0 + {f} * ({p}1 - {p}0))"
#: View, key, outer ring, hole, and where there is one: boxes with a corner cut off and a hole in every third, boxes with a notch,
#: boxes without two corners, and one box without four.
SHAPES: dict[str, tuple[str, str, list[Corner], list[Corner], str]] = {
    "poly": ("named", "poly_id", [("x0", "y0"), ("x1", "y0"), ("x1", _part("y", "0.5E0")), (_part("x", "0.5E0"), "y1"), ("x0", "y1")], [(_part("x", a), _part("y", b)) for a, b in (("0.2E0", "0.2E0"), ("0.2E0", "0.4E0"), ("0.4E0", "0.4E0"), ("0.4E0", "0.2E0"))], "poly_id % 3 = 0"),
    "commune": ("communes", "lau2", [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), (_part("x", "0.5E0"), "(y1 - 500)"), ("x0", "y1")], [], ""),
    "ref": ("reference", "ref_id", [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("(x0 + 100)", "y1"), ("x0", "(y1 - 150)")], [], ""),
    "aoi": ("aoi", "1", [("(x0 + 2000)", "y0"), ("(x1 - 2500)", "y0"), ("x1", "(y0 + 2000)"), ("x1", "(y1 - 1000)"), ("(x1 - 3000)", "y1"), ("(x0 + 2000)", "y1"), ("x0", "(y1 - 2000)"), ("x0", "(y0 + 500)")], [], ""),
}


def rings(name: str, form: str = "") -> str:
    """Spark SQL of a shape's rings; form: a column that has all that they depend on."""
    _, _, outer, hole, where = SHAPES[name]
    if form:
        import re

        of_form = lambda x: re.sub(r"\b[xy][01]\b", lambda m: f"{form}.{m[0]}", x)
        outer, hole, where = [tuple(map(of_form, x)) for x in outer], [tuple(map(of_form, x)) for x in hole], f"{form}.hole"
    ring = lambda corners: "array(" + ", ".join(f"array(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for x, y in [*corners, corners[0]]) + ")"
    return f"CASE WHEN {where} THEN array({ring(outer)}, {ring(hole)}) ELSE array({ring(outer)}) END" if hole else f"array({ring(outer)})"


def form(name: str) -> str:
    """Spark SQL of what a shape's rings depend on."""
    return f"struct(x0, y0, x1, y1, coalesce({SHAPES[name][4] or 'FALSE'}, FALSE) AS hole)"


def edges(name: str) -> str:
    """DuckDB SQL of all edges of a shape's rings: id, xa, ya, xb, yb."""
    view, key, outer, hole, where = SHAPES[name]
    out = []
    for corners, only in ((outer, ""), (hole, f" WHERE {where}")):
        for (xa, ya), (xb, yb) in zip(corners, [*corners[1:], *corners[:1]], strict=True):
            out.append(f"SELECT {key} AS id, {xa} AS xa, {ya} AS ya, {xb} AS xb, {yb} AS yb FROM {view}{only}")
    return " UNION ALL ".join(out)


def upright(name: str) -> str:
    """The edges that aren't vertical, by slope (k), height at x = 0 (h), and sign (1: an upper edge)."""
    return f"SELECT id, least(xa, xb) AS lo, greatest(xa, xb) AS hi, (yb - ya) / (xb - xa) AS k, ya - xa * (yb - ya) / (xb - xa) AS h, CASE WHEN xb < xa THEN 1 ELSE -1 END AS s FROM ({edges(name)}) e WHERE xa <> xb"


def size(name: str) -> str:
    """id, area."""
    return f"SELECT id, sum(s * (h * (hi - lo) + k * (hi * hi - lo * lo) / 2)) AS area FROM ({upright(name)}) u GROUP BY id"


def shared(sets: str, keys: list[str], names: list[str], ids: list[str]) -> str:
    """keys and the area that shapes share: sets has the keys and an id for each shape. For each choice of edges the lowest one is
    integrated between the places where two of them cross."""
    e = [f"e{i}" for i in range(len(names))]
    lo, hi = f"greatest({', '.join(f'{x}.lo' for x in e)})", f"least({', '.join(f'{x}.hi' for x in e)})"
    cross = [f"CASE WHEN {a}.k = {b}.k THEN {lo} ELSE least(greatest(({b}.h - {a}.h) / ({a}.k - {b}.k), {lo}), {hi}) END" for i, a in enumerate(e) for b in e[:i]]
    joins = ""
    for i, (name, key) in enumerate(zip(names, ids, strict=True)):
        before = e[:i]
        meet = f" AND greatest({', '.join(f'{x}.lo' for x in [*before, e[i]])}) < least({', '.join(f'{x}.hi' for x in [*before, e[i]])})" if before else ""
        joins += f" JOIN ({upright(name)}) {e[i]} ON {e[i]}.id = {key}{meet}"
    lowest = lambda t: "least(" + ", ".join(f"h{i} + k{i} * {t}" for i in range(len(e))) + ")"
    chosen = f"SELECT {', '.join(f's0.{k}' for k in keys)}, {' * '.join(f'{x}.s' for x in e)} AS s, {', '.join(f'{x}.h AS h{i}, {x}.k AS k{i}' for i, x in enumerate(e))}, list_sort([{', '.join([lo, hi, *cross])}]) AS t FROM ({sets}) s0{joins}"
    whole = f"list_sum(list_transform(range(1, len(t)), lambda i: (t[i + 1] - t[i]) * ({lowest('t[i]')} + {lowest('t[i + 1]')}) / 2))"
    return f"SELECT {', '.join(keys)}, sum(s * {whole}) AS area FROM ({chosen}) c GROUP BY {', '.join(keys)}"


LEAST = "1e-6"
_meet = lambda a, b: f"greatest({a}.x0, {b}.x0) <= least({a}.x1, {b}.x1) AND greatest({a}.y0, {b}.y0) <= least({a}.y1, {b}.y1)"
#: What Spark gets by cell joins and plane geometry. Shapes share something with more than a millionth of a square metre.
COVER = f"SELECT g.lau2, g.commune, g.canton, g.x0, g.y0, g.x1, g.y1, z.area / 1e6 AS commune_area_km2, w.area / 1e6 AS covered_area_km2, w.area / z.area AS covered_fraction FROM communes g JOIN ({size('commune')}) z ON z.id = g.lau2 JOIN ({shared('SELECT lau2 FROM communes', ['lau2'], ['commune', 'aoi'], ['s0.lau2', '1'])}) w ON w.lau2 = g.lau2 WHERE w.area > {LEAST}"
MET: dict[str, str] = {
    "commune_cover": COVER,
    "commune_polys": f"SELECT g.lau2, g.commune, g.covered_fraction, p.poly_id, p.class_id, p.class_name, round(w.area, 3) AS area FROM ({shared('SELECT g.lau2, p.poly_id FROM commune_cover g JOIN named p ON ' + _meet('g', 'p'), ['lau2', 'poly_id'], ['poly', 'commune', 'aoi'], ['s0.poly_id', 's0.lau2', '1'])}) w JOIN commune_cover g ON g.lau2 = w.lau2 JOIN named p ON p.poly_id = w.poly_id WHERE w.area > {LEAST}",
    "class_cover": "SELECT 'poly' AS kind, class_name, sum(w.area) / 1e6 AS km2 FROM (" + shared("SELECT poly_id FROM named", ["poly_id"], ["poly", "aoi"], ["s0.poly_id", "1"]) + ") w JOIN named p ON p.poly_id = w.poly_id GROUP BY class_name UNION ALL SELECT 'ref' AS kind, class_name, sum(w.area) / 1e6 AS km2 FROM (" + shared("SELECT ref_id FROM reference", ["ref_id"], ["ref", "aoi"], ["s0.ref_id", "1"]) + ") w JOIN reference r ON r.ref_id = w.ref_id WHERE class_name IS NOT NULL GROUP BY class_name",
    "new_parts": f"SELECT g.lau2, g.commune, w.poly_id, w.ref_id, round(w.area, 3) AS area FROM ({shared('SELECT g.lau2, p.poly_id, q.ref_id FROM commune_cover g JOIN (SELECT * FROM named WHERE class_id = 1) p ON ' + _meet('g', 'p') + ' JOIN reference q ON ' + _meet('p', 'q') + ' AND ' + _meet('g', 'q') + ' WHERE g.covered_fraction >= 0.9 AND q.class_name IS DISTINCT FROM ' + chr(39) + 'Artificial surfaces' + chr(39), ['lau2', 'poly_id', 'ref_id'], ['poly', 'ref', 'commune', 'aoi'], ['s0.poly_id', 's0.ref_id', 's0.lau2', '1'])}) w JOIN commune_cover g ON g.lau2 = w.lau2 WHERE w.area > {LEAST}",
}
