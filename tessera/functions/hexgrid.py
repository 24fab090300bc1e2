"""The icosahedral hexagon grid: points to cells, centres, boundaries, areas, neighbours (numpy over whole columns).

The grid is laid on the 20 faces of an icosahedron, projected gnomonically.  Each face has plane coordinates in
which the centres of resolution-0 cells are the hexagonal lattice of unit spacing around the face's centre: vertices of
the face at distance 2, edge midpoints at distance 1.  A finer lattice has seven cells for each cell of the one
before, turned by ROTATION at odd resolutions.  Planes of neighbouring faces are unfolded across their common edge.

All tables are derived from the faces' centres and axes: the 122 base cells are numbered from north to south, and each
has a home face whose axes its digits refer to.  Around the 12 pentagons the five faces take five of six wedges of
the lattice; the wedge of digit 1 is empty.
"""

from __future__ import annotations

import numpy as np

#: The faces' centres (latitude, longitude) and the azimuths of their first axes, in radians.
FACE_CENTERS = [
    (0.803582649718989942, 1.248397419617396099), (1.307747883455638156, 2.536945009877921159), (1.054751253523952054, -1.347517358900396623), (0.600191595538186799, -0.450603909469755746), (0.491715428198773866, 0.401988202911306943),
    (0.172745327415618701, 1.678146885280433686), (0.605929321571350690, 2.953923329812411617), (0.427370518328979641, -1.888876200336285401), (-0.079066118549212831, -0.733429513380867741), (-0.230961644455383637, 0.506495587332349035),
    (0.079066118549212831, 2.408163140208925497), (0.230961644455383637, -2.635097066257444203), (-0.172745327415618701, -1.463445768309359553), (-0.605929321571350690, -0.187669323777381622), (-0.427370518328979641, 1.252716453253507838),
    (-0.600191595538186799, 2.690988744120037492), (-0.491715428198773866, -2.739604450678486295), (-0.803582649718989942, -1.893195233972397139), (-1.307747883455638156, -0.604647643711872080), (-1.054751253523952054, 1.794075294689396615),
]
FACE_AXES = [
    5.619958268523939882, 5.760339081714187279, 0.780213654393430055, 0.430469363979999913, 6.130269123335111400, 2.692877706530642877, 2.982963003477243874, 3.532912002790141181, 3.494305004259568154, 3.003214169499538391,
    5.930472956509811562, 0.138378484090254847, 0.448714947059150361, 0.158629650112549365, 5.891865957979238535, 2.711123289609793325, 3.294508837434268316, 3.804819692245439833, 3.664438879055192436, 2.361378999196363184,
]
#: The gnomonic length of a lattice step, the turn of odd resolutions, and the earth's radius in km.
STEP = 0.38196601125010500003
ROTATION = 0.333473172251832115336090755351601070065900389
EARTH_KM = 6371.007180918475
#: The directions of the digits 1 to 6 in steps of 60 degrees, and these steps on the lattice's two axes.
TURN_OF_DIGIT = [0, 4, 2, 3, 0, 5, 1]
UNITS = [(0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1)]

_DIGIT_OF_TURN = np.array([4, 6, 2, 3, 1, 5])
_TURN = np.array(TURN_OF_DIGIT)
_UNIT = np.array(UNITS, np.int64)
_DIGIT = np.zeros((3, 3), np.int64)
_DIGIT[tuple((_UNIT + 1).T)] = np.arange(7)
EDGES = np.radians([60.0, 180.0, 300.0])
_U = np.stack([np.cos(EDGES), np.sin(EDGES)], 1)


def unit_vector(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere from radians."""
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


_LAT, _LON = np.array(FACE_CENTERS).T
_C = unit_vector(_LAT, _LON)
_NORTH = np.stack([-np.sin(_LAT) * np.cos(_LON), -np.sin(_LAT) * np.sin(_LON), np.cos(_LAT)], 1)
_EAST = np.stack([-np.sin(_LON), np.cos(_LON), np.zeros(20)], 1)
_AZ = np.array(FACE_AXES)[:, None]
_X = _NORTH * np.cos(_AZ) + _EAST * np.sin(_AZ)
_Y = _NORTH * np.sin(_AZ) - _EAST * np.cos(_AZ)


def turned(p: np.ndarray, angle: np.ndarray | float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.stack([c * p[..., 0] - s * p[..., 1], s * p[..., 0] + c * p[..., 1]], -1)


def plane_of(v: np.ndarray, face: np.ndarray) -> np.ndarray:
    """Plane coordinates on a face."""
    return np.stack([(v * _X[face]).sum(-1), (v * _Y[face]).sum(-1)], -1) / (v * _C[face]).sum(-1)[..., None] / STEP


def sphere_of(face: np.ndarray, p: np.ndarray) -> np.ndarray:
    v = _C[face] + STEP * (p[..., :1] * _X[face] + p[..., 1:] * _Y[face])
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _lattice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a - b / 2, b * np.sqrt(0.75)], -1)


def _rounded(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest lattice point (a, b)."""
    r = p[..., 1] / np.sqrt(0.75)
    q = p[..., 0] - r / 2
    s = -q - r
    rq, rr, rs = np.rint(q), np.rint(r), np.rint(s)
    dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs - s)
    rq = np.where((dq > dr) & (dq > ds), -rr - rs, rq)
    rr = np.where((dr >= dq) & (dr > ds), -rq - rs, rr)
    return (rq + rr).astype(np.int64), rr.astype(np.int64)


def _neighbours() -> tuple[np.ndarray, np.ndarray]:
    """For each face and edge: the face beyond, and how far its axes are turned from this face's."""
    beyond = np.array([[int((_C @ sphere_of(np.array([f]), 1.5 * _U[e : e + 1])[0]).argmax()) for e in range(3)] for f in range(20)])
    back = np.array([[int(np.flatnonzero(beyond[beyond[f, e]] == f)[0]) for e in range(3)] for f in range(20)])
    return beyond, EDGES[None, :] + np.pi - EDGES[back]


_BEYOND, _SHIFT = _neighbours()


def unfold(face: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The face that a point in a face's (extended) plane lies on, its coordinates there, and the turn of the axes."""
    face, p, angle = face.copy(), p.copy(), np.zeros(len(face))
    for _ in range(6):
        over = p @ _U.T
        edge = over.argmax(1)
        out = np.flatnonzero(over.max(1) > 1 + 1e-9)
        if not len(out):
            break
        f, e = face[out], edge[out]
        p[out] = turned(p[out] - 2 * _U[e], -_SHIFT[f, e])
        angle[out] += _SHIFT[f, e]
        face[out] = _BEYOND[f, e]
    return face, p, angle


def _base_cells() -> tuple[np.ndarray, ...]:
    """Of each base cell: home face, lattice point on it, and for pentagons the faces clockwise from home (else -1)."""
    places: dict[tuple, list] = {}
    for f in range(20):
        for a, b in [(0, 0), *UNITS[1:], (2, 0), (0, 2), (-2, -2)]:
            p = _lattice(np.array([a]), np.array([b]))
            v = sphere_of(np.array([f]), p)[0]
            places.setdefault(tuple(np.round(v, 6) + 0.0), []).append((f, a, b, v))
    cells = sorted(places.values(), key=lambda sides: -sides[0][3][2])
    home, at, around = np.zeros(122, np.int64), np.zeros((122, 2), np.int64), np.full((122, 5), -1, np.int64)
    for n, sides in enumerate(cells):
        if len(sides) == 1:
            f, a, b, _ = sides[0]
        elif len(sides) == 2:  # an edge belongs to the polar face; between two of the same belt to one side
            cap = [s for s in sides if s[0] < 5 or s[0] >= 15]
            turn = {(1, 1): 60, (-1, 0): 180, (0, -1): 300}
            if len(cap) == 1:
                f, a, b, _ = cap[0]
            elif len(cap) == 2:
                f, a, b, _ = next(s for s in sides if turn[s[1:3]] == (60 if s[0] < 5 else 300))
            else:
                kind = turn[sides[0][1:3]]
                f, a, b, _ = next(s for s in sides if (s[0] >= 10) == (kind == 60))
        else:  # a vertex belongs to the face whose first axis points at it; at the poles to the first or the last
            on_axis = [s for s in sides if s[1:3] == (2, 0)]
            f, a, b, v = on_axis[0] if sides[0][3][2] > 0 or len(on_axis) == 1 else on_axis[-1]
            east, north = np.cross([0, 0, 1.0], v), None
            east /= np.linalg.norm(east)
            north = np.cross(v, east)
            bearing = {s[0]: np.arctan2(_C[s[0]] @ north, _C[s[0]] @ east) for s in sides}
            around[n] = sorted(bearing, key=lambda g: (bearing[f] - bearing[g]) % (2 * np.pi))
        home[n], at[n] = f, (a, b)
    return home, at, around


HOME, HOME_AT, AROUND = _base_cells()
PENTAGONS = np.flatnonzero(AROUND[:, 0] >= 0)
_CENTERS = sphere_of(HOME, _lattice(*HOME_AT.T.astype(float)))


def _vertex_angle(face: int, cell: int) -> float:
    """In which direction a face sees one of its vertices."""
    p = plane_of(_CENTERS[cell], np.array(face))
    return float(np.arctan2(p[1], p[0]))


#: For each pentagon, how far each of its faces (clockwise from home) is turned against home's lattice.
_WEDGE_TURN = np.zeros((122, 5))
for _n in PENTAGONS:
    for _i, _f in enumerate(AROUND[_n]):
        _WEDGE_TURN[_n, _i] = (np.pi - _i * np.pi / 3) - (_vertex_angle(_f, _n) + np.pi)


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Base cell, and turns of 60 degrees to its home axes, for each face and lattice point (a, b) from -2 to 2."""
    cell, turns = np.zeros((20, 5, 5), np.int64), np.zeros((20, 5, 5), np.int64)
    for f in range(20):
        for a in range(-2, 3):
            for b in range(-2, 3):
                face, p, angle = unfold(np.array([f]), _lattice(np.array([a]), np.array([b])))
                n = int((_CENTERS @ sphere_of(face, p)[0]).argmax())
                g, turn = int(face[0]), -float(angle[0])
                if AROUND[n, 0] >= 0:
                    turn += _WEDGE_TURN[n, int(np.flatnonzero(AROUND[n] == g)[0])] if g in AROUND[n] else 0.0
                elif HOME[n] != g and HOME[n] in _BEYOND[g]:
                    turn -= _SHIFT[g, int(np.flatnonzero(_BEYOND[g] == HOME[n])[0])]
                cell[f, a + 2, b + 2], turns[f, a + 2, b + 2] = n, round(turn / (np.pi / 3)) % 6
    return cell, turns


_CELL, _TURNS = _lookup()


def cell_of(lat: np.ndarray, lon: np.ndarray, res: int) -> np.ndarray:
    """The cell of a resolution that holds each point (degrees)."""
    v = unit_vector(np.radians(lat), np.radians(lon))
    face = (v @ _C.T).argmax(1)
    p = plane_of(v, face) * np.sqrt(7.0) ** res
    a, b = _rounded(turned(p, -ROTATION) if res % 2 else p)
    digits = np.zeros((len(a), res + 1), np.int64)
    for r in range(res, 0, -1):
        if r % 2:
            up_a, up_b = np.rint((3 * a - b) / 7).astype(np.int64), np.rint((a + 2 * b) / 7).astype(np.int64)
            at_a, at_b = 2 * up_a + up_b, 3 * up_b - up_a
        else:
            up_a, up_b = np.rint((2 * a + b) / 7).astype(np.int64), np.rint((3 * b - a) / 7).astype(np.int64)
            at_a, at_b = 3 * up_a - up_b, up_a + 2 * up_b
        digits[:, r] = _DIGIT[a - at_a + 1, b - at_b + 1]
        a, b = up_a, up_b
    base, turns = _CELL[face, a + 2, b + 2], _TURNS[face, a + 2, b + 2]
    if res:
        turned_by = np.where(digits > 0, _DIGIT_OF_TURN[(_TURN[digits] + turns[:, None]) % 6], 0)
        lead = turned_by[np.arange(len(a)), (turned_by > 0).argmax(1)]
        gap = (AROUND[base, 0] >= 0) & (lead == 1)  # the empty wedge: on to the next face on that side
        turns = np.where(gap, turns + np.where(face == HOME[base], 1, 5), turns)
        digits = np.where(digits > 0, _DIGIT_OF_TURN[(_TURN[digits] + turns[:, None]) % 6], 0)
    out = np.full(len(a), (1 << 59) | (res << 52), np.int64) | (base << 45)
    for r in range(1, 16):
        out |= (digits[:, r] if r <= res else np.full(len(a), 7, np.int64)) << (3 * (15 - r))
    return out


def _placed(cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """(face, plane coordinates of the centre there, resolution, whether a pentagon)."""
    res, base = (cells >> 52) & 15, (cells >> 45) & 127
    a, b = HOME_AT[base].T
    any_digit = np.zeros(len(cells), bool)
    for r in range(1, int(res.max(initial=0)) + 1):
        live = res >= r
        down = (2 * a + b, 3 * b - a) if r % 2 else (3 * a - b, a + 2 * b)
        digit = np.where(live, (cells >> (3 * (15 - r))) & 7, 0)
        digit[digit == 7] = 0
        a, b = (np.where(live, x + _UNIT[digit, i], y) for i, (x, y) in enumerate(zip(down, (a, b))))
        any_digit |= digit > 0
    p = _lattice(a.astype(float), b.astype(float))
    p = np.where((res % 2 == 1)[:, None], turned(p, ROTATION), p) / np.sqrt(7.0)[None] ** res[:, None]
    pent = AROUND[base, 0] >= 0
    face, q, _ = unfold(HOME[base], p)
    some = np.flatnonzero(pent & any_digit)
    if len(some):  # around a vertex: by wedge, clockwise from home
        off = p[some] - [2.0, 0.0]
        wedge = (np.pi - np.arctan2(off[:, 1], off[:, 0])) / (np.pi / 3) % 6
        # what reaches into the empty wedge goes on from the face it comes from
        wedge = np.where(wedge < 5, np.minimum(np.rint(wedge), 4), 0).astype(np.int64)
        n = base[some]
        corner = plane_of(_CENTERS[n], AROUND[n, wedge])
        face[some], q[some], _ = unfold(AROUND[n, wedge], turned(off, -_WEDGE_TURN[n, wedge]) + corner)
    return face, q, res, pent & ~any_digit


def center_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude of the centres (degrees)."""
    face, p, _, _ = _placed(cells)
    return degrees_of(sphere_of(face, p))


def degrees_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arcsin(np.clip(v[..., 2], -1, 1))), np.degrees(np.arctan2(v[..., 1], v[..., 0]))


def boundary_of(cells: np.ndarray) -> list[np.ndarray]:
    """The corners (points of the unit sphere) of each cell, counter-clockwise and not closed.

    At odd resolutions an edge that crosses an edge of the icosahedron has a corner there.
    """
    face, p, res, pent = _placed(cells)
    radius = np.sqrt(1 / 3) / np.sqrt(7.0) ** res
    start = np.pi / 6 + np.where(res % 2 == 1, ROTATION, 0.0)
    angles = start[:, None] + np.arange(6)[None, :] * np.pi / 3
    corners = p[:, None, :] + radius[:, None, None] * np.stack([np.cos(angles), np.sin(angles)], -1)
    g, q, _ = unfold(np.repeat(face, 6), corners.reshape(-1, 2))
    points = sphere_of(g, q).reshape(-1, 6, 3)
    following = np.roll(corners, -1, axis=1)
    out: list[np.ndarray] = []
    for i in range(len(cells)):
        if pent[i]:
            out.append(_pentagon(int((cells[i] >> 45) & 127), int(res[i])))
            continue
        if res[i] % 2 == 0 or (corners[i] @ _U.T).max() <= 1:
            out.append(points[i])
            continue
        ring = []
        for k in range(6):
            ring.append(points[i, k])
            side, beyond = corners[i, k] @ _U.T - 1, following[i, k] @ _U.T - 1
            cuts = sorted(s / (s - t) for s, t in zip(side, beyond) if s * t < -1e-18)
            for t in cuts:
                x = corners[i, k] + t * (following[i, k] - corners[i, k])
                h, y, _ = unfold(face[i : i + 1], x[None])
                if abs((x @ _U.T).max() - 1) < 1e-9:
                    ring.append(sphere_of(h, y)[0])
        out.append(np.array(ring))
    return out


def _pentagon(base: int, res: int) -> np.ndarray:
    """The corners of a pentagon: at odd resolutions the wedges' edges cut its sides."""
    radius = np.sqrt(1 / 3) / np.sqrt(7.0) ** res
    ring = []
    start = np.pi / 6 + (ROTATION if res % 2 else 0.0)
    for wedge in range(5):
        middle = np.pi - wedge * np.pi / 3
        face = np.array([AROUND[base, wedge]])
        corner = plane_of(_CENTERS[base], face)
        place = lambda p: sphere_of(face, turned(p[None], -_WEDGE_TURN[base, wedge]) + corner)[0]
        if res % 2 == 0:
            ring.append(place(radius * np.array([np.cos(middle + np.pi / 6), np.sin(middle + np.pi / 6)])))
            continue
        k = np.floor((middle + np.pi / 6 - start) / (np.pi / 3) + 1e-9)
        own = start + k * np.pi / 3  # the lattice corner inside the wedge
        at = radius * np.array([np.cos(own), np.sin(own)])
        before = radius * np.array([np.cos(own + np.pi / 3), np.sin(own + np.pi / 3)])
        normal = np.array([-np.sin(middle + np.pi / 6), np.cos(middle + np.pi / 6)])
        t = (at @ normal) / (at @ normal - before @ normal)
        ring += [place(at + t * (before - at)), place(at)]
    return np.array(ring[::-1])


def area_of(cells: np.ndarray) -> np.ndarray:
    """Square metres, as the sum of the spherical triangles around the centre."""
    face, p, _, _ = _placed(cells)
    middle = sphere_of(face, p)
    return np.array([_fan(c, ring) for c, ring in zip(middle, boundary_of(cells))]) * (EARTH_KM * 1000) ** 2


def _fan(c: np.ndarray, ring: np.ndarray) -> float:
    a, b = ring, np.roll(ring, -1, axis=0)
    over = np.abs(np.einsum("ij,ij->i", np.cross(a, b), np.broadcast_to(c, a.shape)))
    under = 1 + (a * b).sum(1) + a @ c + b @ c
    return float((2 * np.arctan2(over, under)).sum())


def neighbours_of(cells: np.ndarray) -> list[np.ndarray]:
    """The cells that share an edge with each cell: six, or five around a pentagon, in rising order."""
    rings, res = boundary_of(cells), (cells >> 52) & 15
    face, p, _, _ = _placed(cells)
    middle = sphere_of(face, p)
    owner = np.repeat(np.arange(len(cells)), [len(r) for r in rings])
    ends, after = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    probe = (ends + after) / 2
    probe = probe + 0.2 * (probe - middle[owner])
    lat, lon = degrees_of(probe / np.linalg.norm(probe, axis=1, keepdims=True))
    found = np.zeros(len(owner), np.int64)
    for r in np.unique(res):
        some = res[owner] == r
        found[some] = cell_of(lat[some], lon[some], int(r))
    return [np.setdiff1d(found[owner == i], cells[i]) for i in range(len(cells))]
