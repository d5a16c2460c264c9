"""Values between scattered places: linear and cubic over a Delaunay triangulation, the nearest value outside.

Places are whole numbers of a unit, and all decisions about them are exact. Targets lie in square
tiles. A tile is given the places around it up to a halo, and each of its targets seeks the Delaunay
triangle that holds it: from any triangle that does, a place inside its circumcircle takes the part of
one of its corners, until the circle is empty. If the circle stays within the halo, or leaves it where
there are no places any more, no other tile could know better; the targets left try again with
twice the halo. So results don't depend on the tiles, and no task triangulates more than a tile
and its halo.

Four or more places on one circle have several triangulations. Here x*x + y*y decides, then x*y,
then x*x - y*y, which no four places leave undecided.

The linear value weighs the three corners by their areas. The cubic one is a Clough-Tocher patch:
the triangle is split at its centre in three cubics that meet smoothly; at each corner the slope
comes from a quadratic fitted to the nearest places, and along each side the slope across it is
linear, so that a quadratic surface is met exactly. Targets beyond the convex hull of the places take
the nearest place's value, and targets at a place its own.

Defined results: places and targets with a null coordinate, and places with a null value, take no
part; of several values at one place the least counts; without places there are no values; if all
places lie on a line, every target takes the nearest value; equal distances go to the place of the
smaller y, then x; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.materialise import saved
from tidelane.operators.nearest import nearest, nearest_with

#: Units to a side of a tile, and around it at first.
TILE, HALO = 32, 8
#: Places that a corner's slope is fitted to.
NEIGHBOURS = 12
#: Pairs of a target and a place that are looked at at a time.
STEP = 1 << 20
#: Units across up to which products of four differences fit 64 bits.
NARROW = 1 << 14

_CORNERS = [f"{c}{k}" for k in range(3) for c in ("x", "y", "v")]
FOUND = pa.schema([("target_id", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("how", pa.string()), *((c, pa.float64() if c[0] == "v" else pa.int64()) for c in _CORNERS)])
FOUND_DDL = "target_id long, x long, y long, how string, " + ", ".join(f"{c} {'double' if c[0] == 'v' else 'long'}" for c in _CORNERS)


def convex_hull(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and the upper chain of the hull of the rows (x, y), by rising x."""
    points = [tuple(p) for p in np.unique(points, axis=0).tolist()]
    chains = []
    for turn in (1, -1):
        chain: list[tuple[int, int]] = []
        for p in points:
            while len(chain) > 1 and turn * ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(np.array(chain, dtype=object).reshape(-1, 2))
    return chains[0], chains[1]


def hull_of(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hull of all places. Only the ends of each line can be on it; tasks make hulls of theirs, which the driver joins.

    A hull of whole numbers up to m across has no more than 9 * m**(2/3) corners.
    """

    def hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.int64)
        for b in batches:
            lower, upper = convex_hull(np.concatenate([held, np.stack([b["x"].to_numpy(), b["y"].to_numpy()], axis=1)]))
            held = np.unique(np.concatenate([lower, upper]).astype(np.int64), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], names=["x", "y"])

    ends = known.groupBy("y").agg(F.min("x").alias("a"), F.max("x").alias("b")).select(F.explode(F.array("a", "b")).alias("x"), "y")
    rows = ends.mapInArrow(hulls, "x long, y long").toArrow()
    return convex_hull(np.stack([rows["x"].to_numpy(), rows["y"].to_numpy()], axis=1).reshape(-1, 2))


def in_hull(hull: tuple[np.ndarray, np.ndarray], q: np.ndarray) -> np.ndarray:
    """Whether the rows (x, y) lie in the hull or on it; nothing does if it has no area."""
    lower, upper = hull
    if len(lower) < 2 or len(lower) == len(upper) == 2 and (lower == upper).all():
        return np.zeros(len(q), bool)
    inside = (q[:, 0] >= lower[0, 0]) & (q[:, 0] <= lower[-1, 0])
    # Sides straight up, at the ends, bound no y.
    lower, upper = lower[: len(lower) - (lower[-1, 0] == lower[-2, 0])], upper[(upper[0, 0] == upper[1, 0]) * 1 :]
    if min(len(lower), len(upper)) < 2:
        return np.zeros(len(q), bool)
    for chain, turn in ((lower, 1), (upper, -1)):
        k = np.clip(np.searchsorted(chain[:, 0].astype(np.int64), q[:, 0]), 1, len(chain) - 1)
        a, b = chain[k - 1], chain[k]
        side = (b[:, 0] - a[:, 0]) * (q[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (q[:, 0] - a[:, 0])
        inside &= (turn * side >= 0).astype(bool)
    return inside


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _forms(d: np.ndarray) -> list[np.ndarray]:
    """The three forms that decide, one after the other."""
    x, y = d[..., 0], d[..., 1]
    return [x * x + y * y, x * y, x * x - y * y]


def first_triangles(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each target a triangle of places that holds it, and whether there is one. d: places from the targets, (targets, places, 2)."""
    n = np.arange(len(d))
    r2 = _forms(d)[0].astype(float)
    a = r2.argmin(axis=1)
    ahead = -d[n, a]
    cross, dot = _cross(ahead[:, None], d), (ahead[:, None] * d).sum(axis=2)
    angle = np.arctan2(cross.astype(float), dot.astype(float))
    angle[cross == 0] = np.where(dot[cross == 0] > 0, 0.0, np.inf)  # straight ahead; behind is no use
    far = np.inf
    left, right = np.where(angle >= 0, angle, far), np.where(angle < 0, -angle, far)
    b, c = left.argmin(axis=1), right.argmin(axis=1)
    straight = left[n, b] == 0
    beside = np.where(straight[:, None] & (left == 0), far, left)
    other = beside.argmin(axis=1)
    take = straight & ~np.isfinite(right[n, c])
    c = np.where(take, other, c)
    found = np.isfinite(left[n, b]) & np.where(take, np.isfinite(beside[n, other]), np.isfinite(right[n, c]))
    found &= straight | (_cross(d[n, c], d[n, b]) >= 0).astype(bool)
    tri = np.stack([a, b, c], axis=1)
    turned = (_cross(d[n, b] - d[n, a], d[n, c] - d[n, a]) < 0).astype(bool)
    tri[turned] = tri[turned][:, [0, 2, 1]]
    return tri, found


def _inside(corners: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of triangles around the origin, (n, 3, 2): whether they hold it, and the forms' values there, between the corners'."""
    w = np.stack([_cross(corners[:, (k + 1) % 3], corners[:, (k + 2) % 3]) for k in range(3)], axis=1)
    whole = w.sum(axis=1)
    sign = np.where((whole < 0).astype(bool), -1, 1)
    ok = (whole != 0).astype(bool) & ((w * sign[:, None]) >= 0).astype(bool).all(axis=1)
    safe = np.where(ok, whole, 1)
    return ok, [np.where(ok, ((w * f).sum(axis=1) / safe).astype(float), np.inf) for f in _forms(corners)]


def delaunay_triangles(points: np.ndarray, targets: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
    """For each target the corners (places among points) of the Delaunay triangle that holds it, or -1 if none does.

    among: the places (targets, n) that each target is to know, some of them more than once.
    """
    out = np.full((len(targets), 3), -1)
    if len(points) < 3:
        return out
    wide = int(max(np.ptp(np.concatenate([points[:, k], targets[:, k]])) for k in (0, 1))) if len(targets) else 0
    kind = np.int64 if wide <= NARROW else object
    for first in range(0, len(targets), max(1, STEP // len(points))):
        q = targets[first : first + max(1, STEP // len(points))]
        d = (points[None] if among is None else points[among[first : first + len(q)]]).astype(kind) - q[:, None].astype(kind)
        tri, found = first_triangles(d)
        rows = np.flatnonzero(found)
        while len(rows):
            own, t = d[rows], tri[rows]
            corner = [np.take_along_axis(own, t[:, k, None, None], axis=1)[:, 0] for k in range(3)]
            b, c, p = corner[1] - corner[0], corner[2] - corner[0], own - corner[0][:, None]
            area = _cross(b, c)
            deep = []
            for fb, fc, fp in zip(_forms(b), _forms(c), _forms(p)):
                e, g = b[:, 1] * fc - fb * c[:, 1], b[:, 0] * fc - fb * c[:, 0]
                deep.append(-(p[..., 0] * e[:, None] - p[..., 1] * g[:, None] + fp * area[:, None]))
            n = np.arange(len(rows))
            enter, open_, tie = np.full(len(rows), -1), np.ones(len(rows), bool), np.ones(deep[0].shape, bool)
            for v in deep:
                v = np.where(tie, v, -1)
                k = v.argmax(axis=1)
                hit = open_ & (v[n, k] > 0).astype(bool)
                enter[hit] = k[hit]
                open_ &= ~hit
                tie &= (v == 0).astype(bool)
            more = np.flatnonzero(enter >= 0)
            rows, t, enter = rows[more], t[more], enter[more]
            if not len(rows):
                break
            choices = [np.where(np.arange(3) == k, enter[:, None], t) for k in range(3)]
            values = [_inside(np.take_along_axis(d[rows], x[:, :, None], axis=1)) for x in choices]
            best = np.zeros(len(rows), int)
            for k in (1, 2):
                less, same = np.zeros(len(rows), bool), np.ones(len(rows), bool)
                for form in range(3):
                    now = np.stack([v[1][form] for v in values])[best, np.arange(len(rows))]
                    less |= same & (values[k][1][form] < now)
                    same &= values[k][1][form] == now
                best = np.where(less, k, best)
            new = np.stack(choices)[best, np.arange(len(rows))]
            at = np.take_along_axis(d[rows], new[:, :, None], axis=1)
            turned = (_cross(at[:, 1] - at[:, 0], at[:, 2] - at[:, 0]) < 0).astype(bool)
            new[turned] = new[turned][:, [0, 2, 1]]
            tri[rows] = new
        corners = tri if among is None else np.take_along_axis(among[first : first + len(q)], tri, axis=1)
        out[first : first + len(q)][found] = corners[found]
    return out


def circle_reach(corners: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Least and largest x and y, (n, 4), of the part of the triangles' circumcircles in the box."""
    a = corners[:, 0].astype(float)
    b, c = corners[:, 1].astype(float) - a, corners[:, 2].astype(float) - a
    area = 2 * _cross(b, c)
    b2, c2 = (b * b).sum(axis=1), (c * c).sum(axis=1)
    middle = np.stack([(c[:, 1] * b2 - b[:, 1] * c2) / area, (b[:, 0] * c2 - c[:, 0] * b2) / area], axis=1)
    radius = np.sqrt((middle * middle).sum(axis=1))
    middle += a
    out = np.empty((len(corners), 4))
    for k in (0, 1):
        other = 1 - k
        off = middle[:, other] - np.clip(middle[:, other], box[2 * other], box[2 * other + 1])
        half = np.sqrt(np.maximum(radius * radius - off * off, 0)) + 1e-6 + 1e-9 * radius
        out[:, 2 * k] = np.maximum(middle[:, k] - half, box[2 * k])
        out[:, 2 * k + 1] = np.minimum(middle[:, k] + half, box[2 * k + 1])
    return out


def _finding(hull: tuple[np.ndarray, np.ndarray], ends: tuple[int, ...], tile: int, halo: int):
    """For a tile's targets and the places around it: how each is found, 'open' where the halo is too narrow to tell."""

    def find(key, mine, places):
        tx, ty = key[0].as_py(), key[1].as_py()
        q = np.stack([mine["x"].to_numpy(), mine["y"].to_numpy()], axis=1)
        points = np.stack([places["x"].to_numpy(), places["y"].to_numpy()], axis=1).reshape(-1, 2)
        value = places["value"].to_numpy()
        how = np.full(len(q), "open", object)
        corners = np.zeros((len(q), 3, 3))
        place = {p: v for p, v in zip(map(tuple, points.tolist()), value.tolist())}
        at = np.array([place.get(p, np.nan) for p in map(tuple, q.tolist())], float)
        own = np.array([p in place for p in map(tuple, q.tolist())], bool)
        how[own] = "at"
        corners[own, :, 2] = at[own, None]
        out = ~own & ~in_hull(hull, q)
        how[out] = "outside"
        rest = np.flatnonzero(~own & ~out)
        tri = delaunay_triangles(points, q[rest])
        rest, tri = rest[tri[:, 0] >= 0], tri[tri[:, 0] >= 0]
        if len(rest):
            reach = circle_reach(points[tri], ends)
            region = [max(tx * tile - halo, ends[0]), min(tx * tile + tile - 1 + halo, ends[1]), max(ty * tile - halo, ends[2]), min(ty * tile + tile - 1 + halo, ends[3])]
            sure = (np.ceil(reach[:, [0, 2]]) >= [region[0], region[2]]).all(axis=1) & (np.floor(reach[:, [1, 3]]) <= [region[1], region[3]]).all(axis=1)
            how[rest[sure]] = "inside"
            corners[rest[sure], :, :2] = points[tri[sure]]
            corners[rest[sure], :, 2] = value[tri[sure]]
        columns = {"target_id": mine["target_id"], "x": q[:, 0], "y": q[:, 1], "how": how.tolist()}
        columns |= {f"{c}{k}": corners[:, k, m].astype(np.int64) if c != "v" else corners[:, k, m] for k in range(3) for m, c in enumerate("xyv")}
        return pa.table({f.name: pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.ChunkedArray) else columns[f.name].cast(f.type) for f in FOUND})

    return find


def _finding_within(reach: int):
    """For a tile's targets and the places around it: the triangle of the places within reach of each target that holds it, or the nearest of them."""

    def find(key, mine, places):
        q = np.stack([mine["x"].to_numpy(), mine["y"].to_numpy()], axis=1).reshape(-1, 2)
        points = np.stack([places["x"].to_numpy(), places["y"].to_numpy()], axis=1).reshape(-1, 2)
        order = np.lexsort((points[:, 0], points[:, 1]))  # ties go to the smaller y, then x
        points, value = points[order], places["value"].to_numpy()[order]
        how, corners = np.full(len(q), "outside", object), np.zeros((len(q), 3, 3))
        corners[:, :, 2] = np.nan
        step = max(1, STEP // max(1, len(points)))
        for first in range(0, len(q) if len(points) else 0, step):
            here = np.arange(first, min(first + step, len(q)))
            d = points[None] - q[here][:, None]
            far = (np.abs(d) > reach).any(axis=2)
            here, d, far = here[~far.all(axis=1)], d[~far.all(axis=1)], far[~far.all(axis=1)]
            if not len(here):
                continue
            d2 = np.where(far, np.iinfo(np.int64).max, (d * d).sum(axis=2))
            near = d2.argmin(axis=1)
            n = np.arange(len(here))
            corners[here, :, 2] = value[near][:, None]
            how[here[d2[n, near] == 0]] = "at"
            own = np.argsort(far, axis=1, kind="stable")[:, : (~far).sum(axis=1).max()]
            own = np.where(np.take_along_axis(far, own, axis=1), near[:, None], own)  # rows are filled up with the nearest again
            tri = delaunay_triangles(points, q[here], own)
            held = (tri[:, 0] >= 0) & (d2[n, near] > 0)
            how[here[held]] = "inside"
            corners[here[held], :, :2], corners[here[held], :, 2] = points[tri[held]], value[tri[held]]
        columns = {f"{c}{k}": corners[:, k, m] for k in range(3) for m, c in enumerate("xyv")}
        columns |= {"target_id": mine["target_id"].to_numpy(), "x": q[:, 0], "y": q[:, 1], "how": how.tolist()}
        return pa.table({f.name: pa.array(columns[f.name].astype(np.int64) if f.type == pa.int64() else columns[f.name], f.type, from_pandas=True) for f in FOUND})

    return find


def located_within(known: DataFrame, targets: DataFrame, reach: int, tile: int = TILE) -> DataFrame:
    """As located(), where each target knows only the places within reach of it in x and in y; 'outside' has the nearest one's value, if any, as v0. Saved."""
    tiles = [F.floor(F.col(c) / tile).alias(t) for c, t in (("x", "tx"), ("y", "ty"))]
    spread = [F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))).alias(t) for c, t in (("x", "tx"), ("y", "ty"))]
    places = known.select("x", "y", "value", spread[0]).select("x", "y", "value", "tx", spread[1])
    return saved(targets.select("target_id", "x", "y", *tiles).groupBy("tx", "ty").cogroup(places.groupBy("tx", "ty")).applyInArrow(_finding_within(reach), FOUND_DDL))


def located(known: DataFrame, targets: DataFrame, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """FOUND_DDL of every target: how it is found ('inside' with its triangle's corners, 'at' a place, or 'outside').

    known: x, y long, value; targets: target_id, x, y long. Saved.
    """
    box = known.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return targets.select("target_id", "x", "y", F.lit("outside").alias("how"), *(F.lit(None).cast("double" if c[0] == "v" else "long").alias(c) for c in _CORNERS)).limit(0)
    hull, ends = hull_of(known), tuple(map(int, box))
    left = saved(targets.withColumn("tx", F.floor(F.col("x") / tile)).withColumn("ty", F.floor(F.col("y") / tile)))
    found = None
    while True:
        active = left.select("tx", "ty").distinct()
        spread = [F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))).alias(t) for c, t in (("x", "tx"), ("y", "ty"))]
        places = known.select("x", "y", "value", spread[0]).select("x", "y", "value", "tx", spread[1]).join(active, ["tx", "ty"], "left_semi")
        got = saved(left.groupBy("tx", "ty").cogroup(places.groupBy("tx", "ty")).applyInArrow(_finding(hull, ends, tile, halo), FOUND_DDL))
        done = got.filter("how <> 'open'")
        found = done if found is None else found.unionByName(done)
        left = saved(left.join(got.filter("how = 'open'").select("target_id"), "target_id", "left_semi"))
        if left.isEmpty():
            return found
        if halo > max(ends[1] - ends[0], ends[3] - ends[2]) + tile + max(abs(x) for x in ends):
            raise RuntimeError("a target within the hull has no triangle")
        halo *= 2


def fitted_slopes(lists: list[list[tuple[float, float, float]]]) -> np.ndarray:
    """The slope (n, 2) at the origin of the quadratic through it that fits each list of (x, y, rise) best, near ones weighing more."""
    out = np.zeros((len(lists), 2))
    by_length: dict[int, list[int]] = {}
    for k, rows in enumerate(lists):
        by_length.setdefault(len(rows), []).append(k)
    for n, group in by_length.items():
        if not n:
            continue
        d = np.array([lists[k] for k in group], float)
        size = np.sqrt((d[..., :2] ** 2).sum(axis=2)).max(axis=1)[:, None]
        x, y = d[..., 0] / size, d[..., 1] / size
        weight = 1 / np.sqrt(x * x + y * y)
        m = np.stack([x, y, x * x / 2, x * y, y * y / 2], axis=2) * weight[..., None]
        fit = (np.linalg.pinv(m, rcond=1e-9) @ (d[..., 2] * weight)[..., None])[..., 0]
        out[group] = fit[:, :2] / size
    return out


def patch_value(corners: np.ndarray, values: np.ndarray, slopes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Clough-Tocher patch of triangles (n, 3, 2) with values (n, 3) and slopes (n, 3, 2) at their corners, at q (n, 2)."""
    n = np.arange(len(q))
    w = np.stack([_cross(corners[:, (k + 1) % 3] - q, corners[:, (k + 2) % 3] - q) for k in range(3)], axis=1)
    share = w / w.sum(axis=1)[:, None]
    centre = corners.mean(axis=1)
    along = lambda i, j: values[:, i] + (slopes[:, i] * (corners[:, j] - corners[:, i])).sum(axis=1) / 3
    inward = [values[:, i] + (slopes[:, i] * (centre - corners[:, i])).sum(axis=1) / 3 for i in range(3)]
    middle = []  # by the corner opposite
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        side = corners[:, j] - corners[:, i]
        b = ((centre - corners[:, i]) * side).sum(axis=1) / (side * side).sum(axis=1)
        a = 1 - b
        ij, ji = along(i, j), along(j, i)
        middle.append(a * ij + b * ji + ((inward[i] - a * values[:, i] - b * ij) + (inward[j] - a * ji - b * values[:, j])) / 2)
    deep = [(inward[i] + middle[(i + 1) % 3] + middle[(i + 2) % 3]) / 3 for i in range(3)]
    heart = (deep[0] + deep[1] + deep[2]) / 3
    k = share.argmin(axis=1)
    i, j = (k + 1) % 3, (k + 2) % 3
    s, u, v = 3 * share[n, k], share[n, i] - share[n, k], share[n, j] - share[n, k]
    at = lambda parts, where: np.stack(parts)[where, n]
    edge_ij, edge_ji = at([along(1, 2), along(2, 0), along(0, 1)], k), at([along(2, 1), along(0, 2), along(1, 0)], k)
    return (
        values[n, i] * u**3 + 3 * edge_ij * u * u * v + 3 * edge_ji * u * v * v + values[n, j] * v**3
        + 3 * at(inward, i) * u * u * s + 6 * at(middle, k) * u * v * s + 3 * at(inward, j) * v * v * s
        + 3 * at(deep, i) * u * s * s + 3 * at(deep, j) * v * s * s + heart * s**3
    )


def _slopes(known: DataFrame, corners: DataFrame, neighbours: int) -> DataFrame:
    """x, y, gx, gy of every corner (x, y, one of the places), from the nearest places around it."""
    targets = known.select(F.col("id").alias("target_id"), F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty"), F.col("value").alias("tv"))
    near = nearest_with(saved(corners.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))), targets, neighbours + 1, ["tv"])
    # A corner's own row is its first. Ids hold the coordinates.
    lists = near.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("rank", "target_id", "tv"))).alias("near"))  # `neighbours` and itself

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rises = []
            for x, y, rows in zip(b["x"].to_pylist(), b["y"].to_pylist(), b["near"].to_pylist()):
                places = [(((r["target_id"] + (1 << 31)) & 0xFFFFFFFF) - (1 << 31), r["target_id"], r["tv"]) for r in rows]
                rises.append([(tx - x, ((id_ - tx) >> 32) - y, v - places[0][2]) for tx, id_, v in places[1:]])
            slopes = fitted_slopes(rises)
            yield pa.RecordBatch.from_arrays([b["x"].cast(pa.int64()), b["y"].cast(pa.int64()), pa.array(slopes[:, 0]), pa.array(slopes[:, 1])], names=["x", "y", "gx", "gy"])

    return lists.mapInArrow(fit, "x long, y long, gx double, gy double")


def griddata(known: DataFrame, targets: DataFrame, method: str = "cubic", *, unit: float = 1.0, tile: int = TILE, halo: int = HALO, neighbours: int = NEIGHBOURS, reach: int | None = None) -> DataFrame:
    """target_id, value, how: each target's value, found 'inside' a triangle (by the method), 'at' a place, or 'outside' (the nearest place's).

    known: x, y, value; targets: target_id, x, y. Coordinates are taken to the nearest unit. With reach, a target
    knows only the places within so many units of it in x and in y: it is outside where no triangle of these holds
    it, and has no value where there are none.
    """
    if method not in ("linear", "cubic"):
        raise ValueError(f"unknown method {method}")
    whole = [F.round(F.col(c) / unit).cast("long").alias(c) for c in ("x", "y")]
    places = known.select(*whole, F.col("value").cast("double").alias("value")).dropna().groupBy("x", "y").agg(F.min("value").alias("value"))
    # A place's id follows its coordinates, y first, so that ties go by them: 2**31 units either way.
    places = saved(places.withColumn("id", F.shiftleft("y", 32) + F.col("x")))
    asked = saved(targets.select("target_id", *whole).dropna())
    found = located(places, asked, tile, halo) if reach is None else located_within(places, asked, reach, tile)
    outside = found.filter("how = 'outside'").select(F.col("target_id").alias("probe_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = nearest(outside if reach is None else outside.limit(0), places.select(F.col("id").alias("target_id"), F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty")))
    beyond = near.select(F.col("probe_id").alias("t"), F.col("target_id").alias("id")).join(places.select("id", "value"), "id").select(F.col("t").alias("target_id"), "value", F.lit("outside").alias("how"))
    if reach is not None:
        beyond = found.filter("how = 'outside'").select("target_id", F.col("v0").alias("value"), "how")
    at = found.filter("how = 'at'").select("target_id", F.col("v0").alias("value"), "how")
    inside = found.filter("how = 'inside'")
    if method == "linear":
        areas = [(F.col(f"x{i}") - F.col("x")) * (F.col(f"y{j}") - F.col("y")) - (F.col(f"y{i}") - F.col("y")) * (F.col(f"x{j}") - F.col("x")) for i, j in ((1, 2), (2, 0), (0, 1))]
        value = sum(a * F.col(f"v{k}") for k, a in enumerate(areas)) / sum(areas)
        return inside.select("target_id", value.alias("value"), "how").unionByName(at).unionByName(beyond)
    corners = inside.select(F.explode(F.array(*[F.struct(*(F.col(f"{c}{k}").alias(n) for c, n in (("x", "x"), ("y", "y")))) for k in range(3)])).alias("c")).select("c.*").distinct()
    slopes = saved(_slopes(places, corners, neighbours))
    sloped = inside
    for k in range(3):
        sloped = sloped.join(slopes.select(F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("gx").alias(f"gx{k}"), F.col("gy").alias(f"gy{k}")), [f"x{k}", f"y{k}"], "left")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = lambda *names: np.stack([b[c].to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            corner = np.stack([got(f"x{k}", f"y{k}") for k in range(3)], axis=1)
            slope = np.nan_to_num(np.stack([got(f"gx{k}", f"gy{k}") for k in range(3)], axis=1))
            value = patch_value(corner, got("v0", "v1", "v2"), slope, got("x", "y")) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b["target_id"], pa.array(value, pa.float64())], names=["target_id", "value"])

    smooth = sloped.mapInArrow(evaluate, "target_id long, value double").withColumn("how", F.lit("inside"))
    return smooth.unionByName(at).unionByName(beyond)
