"""Map projections as SQL that Spark and DuckDB both read: Krüger's transverse Mercator, equal-area azimuthal, spherical Mercator.

Each function takes the name or text of a relation and returns the text of one with the coordinates added; helper columns go.
"""

from __future__ import annotations

from math import asin, cos, log, pi, radians, sin, sqrt

#: The ellipsoid's axis and flattening, scale and false easting of a zone, origin of the equal-area grid of Europe.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EAST = 0.9996, 500000.0
LAEA_LAT, LAEA_LON, LAEA_EAST, LAEA_NORTH = 52.0, 10.0, 4321000.0, 3210000.0

_n = FLATTENING / (2 - FLATTENING)
_e = sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = AXIS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
#: Krüger's series in the third flattening: forward, backward, and from conformal to geographic latitude.
FORTH = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
BACK = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
LATITUDE = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)
#: From authalic to geographic latitude.
AUTHALIC = (_e**2 / 3 + 31 * _e**4 / 180 + 517 * _e**6 / 5040, 23 * _e**4 / 360 + 251 * _e**6 / 3780, 761 * _e**6 / 45360)


def number(x: float) -> str:
    """A literal that both engines read as a double."""
    return f"({x:.17e})"


def chain(relation: str, keep: list[str], *steps: dict[str, str]) -> str:
    """relation with the columns of each step from those before; of all these only the last step's and `keep` stay."""
    source = relation if relation.isidentifier() else f"({relation}) s0"
    for i, step in enumerate(steps):
        first = ", ".join(keep) if i == len(steps) - 1 else "*"
        source = f"(SELECT {first}, {', '.join(f'{text} AS {name}' for name, text in step.items())} FROM {source}) t{i}"
    return source[1 : source.rindex(")")]


def _waves(terms: tuple[float, ...], first: str, second: str, x: str, y: str, sign: str) -> str:
    return " ".join(f"{sign} {number(k)} * {first}({2 * i} * {x}) * {second}({2 * i} * {y})" for i, k in enumerate(terms, 1))


def to_utm(relation: str, keep: list[str], lon: str, lat: str, zone: int) -> str:
    """keep, east, north of degrees."""
    root = 2 * sqrt(_n) / (1 + _n)
    return chain(
        relation,
        keep,
        {"k_t": f"sinh(atanh(sin(radians({lat}))) - {number(root)} * atanh({number(root)} * sin(radians({lat}))))", "k_l": f"radians({lon} - {number(6 * zone - 183)})"},
        {"k_x": "atan2(k_t, cos(k_l))", "k_y": "atanh(sin(k_l) / sqrt(1 + k_t * k_t))"},
        {"east": f"{number(FALSE_EAST)} + {number(SCALE * RADIUS)} * (k_y {_waves(FORTH, 'cos', 'sinh', 'k_x', 'k_y', '+')})", "north": f"{number(SCALE * RADIUS)} * (k_x {_waves(FORTH, 'sin', 'cosh', 'k_x', 'k_y', '+')})"},
    )


def from_utm(relation: str, keep: list[str], east: str, north: str, zone: int) -> str:
    """keep, lon, lat in degrees."""
    turned = " ".join(f"+ {number(k)} * sin({2 * i} * k_s)" for i, k in enumerate(LATITUDE, 1))
    return chain(
        relation,
        keep,
        {"k_u": f"{north} / {number(SCALE * RADIUS)}", "k_v": f"({east} - {number(FALSE_EAST)}) / {number(SCALE * RADIUS)}"},
        {"k_x": f"k_u {_waves(BACK, 'sin', 'cosh', 'k_u', 'k_v', '-')}", "k_y": f"k_v {_waves(BACK, 'cos', 'sinh', 'k_u', 'k_v', '-')}"},
        {"k_s": "asin(sin(k_x) / cosh(k_y))", "k_l": "atan2(sinh(k_y), cos(k_x))"},
        {"lon": f"{number(6 * zone - 183)} + degrees(k_l)", "lat": f"degrees(k_s {turned})"},
    )


def _authalic(sine: float) -> float:
    return (1 - _e**2) * (sine / (1 - (_e * sine) ** 2) - log((1 - _e * sine) / (1 + _e * sine)) / (2 * _e))


_pole = _authalic(1.0)
_beta = asin(_authalic(sin(radians(LAEA_LAT))) / _pole)
_sphere = AXIS * sqrt(_pole / 2)
_d = AXIS * cos(radians(LAEA_LAT)) / sqrt(1 - (_e * sin(radians(LAEA_LAT))) ** 2) / (_sphere * cos(_beta))


def to_laea(relation: str, keep: list[str], lon: str, lat: str) -> str:
    """keep, east, north of degrees."""
    e, sb, cb = number(_e), number(sin(_beta)), number(cos(_beta))
    return chain(
        relation,
        keep,
        {"k_s": f"sin(radians({lat}))", "k_l": f"radians({lon} - {number(LAEA_LON)})"},
        {"k_b": f"asin({number((1 - _e**2) / _pole)} * (k_s / (1 - {e} * {e} * k_s * k_s) - ln((1 - {e} * k_s) / (1 + {e} * k_s)) / (2 * {e})))"},
        {"k_r": f"{number(_sphere)} * sqrt(2 / (1 + {sb} * sin(k_b) + {cb} * cos(k_b) * cos(k_l)))"},
        {"east": f"{number(LAEA_EAST)} + k_r * {number(_d)} * cos(k_b) * sin(k_l)", "north": f"{number(LAEA_NORTH)} + k_r / {number(_d)} * ({cb} * sin(k_b) - {sb} * cos(k_b) * cos(k_l))"},
    )


def from_laea(relation: str, keep: list[str], east: str, north: str) -> str:
    """keep, lon, lat in degrees."""
    d, sb, cb = number(_d), number(sin(_beta)), number(cos(_beta))
    turned = " ".join(f"+ {number(k)} * sin({2 * i} * k_b)" for i, k in enumerate(AUTHALIC, 1))
    return chain(
        relation,
        keep,
        {"k_x": f"({east} - {number(LAEA_EAST)}) / {d}", "k_y": f"({north} - {number(LAEA_NORTH)}) * {d}"},
        {"k_p": "greatest(sqrt(k_x * k_x + k_y * k_y), 1e-9)"},
        {"k_c": f"2 * asin(k_p / {number(2 * _sphere)})"},
        {"k_b": f"asin(cos(k_c) * {sb} + k_y * sin(k_c) * {cb} / k_p)", "k_l": f"atan2(k_x * sin(k_c), k_p * {cb} * cos(k_c) - k_y * {sb} * sin(k_c))"},
        {"lon": f"{number(LAEA_LON)} + degrees(k_l)", "lat": f"degrees(k_b {turned})"},
    )


def to_mercator(relation: str, keep: list[str], lon: str, lat: str) -> str:
    """keep, mx, my in metres of the sphere."""
    return chain(relation, keep, {"mx": f"radians({lon}) * {number(AXIS)}", "my": f"asinh(tan(radians({lat}))) * {number(AXIS)}"})


def from_mercator(relation: str, keep: list[str], x: str, y: str) -> str:
    return chain(relation, keep, {"lon": f"{x} * {number(180 / pi / AXIS)}", "lat": f"degrees(atan(sinh({y} / {number(AXIS)})))"})


def outline(relation: str, keep: list[str], points: int = 64) -> str:
    """keep, x, y: the points along the edges of boxes x0, y0, x1, y1, so many steps an edge; a row becomes 4 * points rows."""
    steps = ", ".join(f"({i})" for i in range(4 * points))
    share = f"(k % {points}) / {number(points)}"
    side = lambda a, b, c, d: f"CASE k // {points} WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {d} END"
    x = side(f"x0 + (x1 - x0) * {share}", "x1", f"x1 - (x1 - x0) * {share}", "x0")
    y = side("y0", f"y0 + (y1 - y0) * {share}", "y1", f"y1 - (y1 - y0) * {share}")
    source = relation if relation.isidentifier() else f"({relation}) s1"
    return f"SELECT {', '.join(keep)}, {x} AS x, {y} AS y FROM {source} CROSS JOIN (VALUES {steps}) AS edge(k)"
