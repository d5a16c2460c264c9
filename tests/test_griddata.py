"""Triangulated interpolation against a search over all triangles, surfaces that it must meet, and its own smoothness."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.operators import griddata as g
from tidelane.operators import raster


def brute(points, q):
    """Corners of the Delaunay triangle that holds q: of all that do, the one under which the lifted points lie lowest."""
    def forms(p):
        x, y = p[0] - q[0], p[1] - q[1]
        return x * x + y * y, x * y, x * x - y * y

    best = None
    for t in itertools.combinations(points, 3):
        d = [(p[0] - q[0], p[1] - q[1]) for p in t]
        w = [d[(k + 1) % 3][0] * d[(k + 2) % 3][1] - d[(k + 1) % 3][1] * d[(k + 2) % 3][0] for k in range(3)]
        whole = sum(w)
        if whole and all(x * whole >= 0 for x in w):
            key = tuple(sum(Fraction(a * forms(p)[m], whole) for a, p in zip(w, t)) for m in range(3))
            if best is None or key < best[0]:
                best = key, {p for a, p in zip(w, t) if a}
    return best and best[1]


@pytest.mark.parametrize("kind", ["lattice", "scattered", "wide"])
def test_triangles_against_all_triples(kind):
    rng = random.Random(5)
    for _ in range(6):
        scale, span = (10**6, 40) if kind == "wide" else (1, 6 if kind == "lattice" else 40)
        places = sorted({(rng.randint(0, span) * scale, rng.randint(0, span) * scale) for _ in range(28)})
        targets = [q for q in ((rng.randint(-1, span) * scale, rng.randint(-1, span) * scale) for _ in range(30)) if q not in places]
        tri = g.delaunay_triangles(np.array(places), np.array(targets))
        for q, t in zip(targets, tri.tolist()):
            want = brute(places, q)
            assert (want is None) == (t[0] < 0)
            if want:
                got = {places[k] for k in t}
                assert want <= got and brute(sorted(got), q) == want


def test_hull():
    rng = random.Random(1)
    places = np.array([(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(60)])
    hull = g.convex_hull(places)
    corners = [*map(tuple, hull[0].tolist()), *map(tuple, hull[1].tolist()[::-1][1:-1])]
    q = np.array([(x, y) for x in range(-2, 33) for y in range(-2, 33)])
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    want = [all(turn(a, b, p) >= 0 for a, b in zip(corners, corners[1:] + corners[:1])) for p in q.tolist()]
    assert g.in_hull(hull, q).tolist() == want
    assert not g.in_hull(g.convex_hull(np.array([(0, 0), (2, 2), (1, 1)])), q).any() and not g.in_hull(g.convex_hull(np.zeros((0, 2), int)), q).any()


def frames(spark, n=400, span=60, surface=lambda x, y: x + y, seed=3):
    rng = random.Random(seed)
    places = sorted({(rng.randint(0, span), rng.randint(0, span)) for _ in range(n)})
    targets = [(k, x, y) for k, (x, y) in enumerate((x, y) for x in range(-3, span + 4, 2) for y in range(-3, span + 4, 3))]
    known = spark.createDataFrame([(float(x), float(y), float(surface(x, y)), "mine") for x, y in places], "x double, y double, value double, id string")
    return places, targets, known, spark.createDataFrame([(k, float(x), float(y)) for k, x, y in targets], "target_id long, x double, y double")


@pytest.mark.parametrize("method", ["linear", "cubic"])
def test_results_do_not_depend_on_tiles(spark, method):
    rng = random.Random(7)
    _, _, known, targets = frames(spark, 150, surface=lambda x, y: rng.random())
    known = known.cache()
    got = [{r.target_id: (r.how, round(r.value, 9)) for r in g.griddata(known, targets, method, tile=t, halo=h).collect()} for t, h in ((32, 8), (7, 2), (500, 1))]
    assert got[0] == got[1] == got[2] and {h for h, _ in got[0].values()} == {"inside", "at", "outside"}


def test_surfaces_that_are_met_exactly(spark):
    plane, bowl = (lambda x, y: 3 * x - 2 * y + 5), (lambda x, y: 0.5 * x * x - x * y + 2 * y * y + x - 7)
    for surface, method in ((plane, "linear"), (plane, "cubic"), (bowl, "cubic")):
        places, targets, known, asked = frames(spark, surface=surface)
        at = {k: (x, y) for k, x, y in targets}
        rows = g.griddata(known, asked, method).collect()
        assert len(rows) == len(targets)
        for r in rows:
            if r.how == "outside":
                near = min(places, key=lambda p: ((p[0] - at[r.target_id][0]) ** 2 + (p[1] - at[r.target_id][1]) ** 2, p[1], p[0]))
                assert r.value == surface(*near)
            else:
                assert r.value == pytest.approx(surface(*at[r.target_id]), abs=1e-6)


def test_patches_meet_smoothly():
    """Values and slopes on both sides of a shared edge, and of the lines within a triangle."""
    rng = np.random.default_rng(2)
    corners = np.array([[[0, 0], [4, 0], [1, 3]], [[4, 0], [5, 4], [1, 3]]], float)
    value = {tuple(p): rng.random() for p in corners.reshape(-1, 2).tolist()}
    slope = {p: rng.random(2) for p in value}

    def at(k, q):
        q = np.atleast_2d(q)
        n = len(q)
        tri = [tuple(p) for p in corners[k].tolist()]
        return g.patch_value(np.repeat(corners[k][None], n, 0), np.repeat([[value[p] for p in tri]], n, 0), np.repeat([[slope[p] for p in tri]], n, 0), q)

    edge = np.array([4, 0]) + np.linspace(0.05, 0.95, 9)[:, None] * np.array([-3, 3])
    across, h = np.array([3, 3]) / 18**0.5, 1e-6
    assert np.allclose(at(0, edge), at(1, edge))
    assert np.allclose((at(0, edge) - at(0, edge - h * across)) / h, (at(1, edge + h * across) - at(1, edge)) / h, atol=1e-4)
    centre = corners[0].mean(axis=0)
    for p in corners[0]:
        line = p + np.linspace(0.1, 0.9, 7)[:, None] * (centre - p)
        n = np.array([-(centre - p)[1], (centre - p)[0]])
        assert np.allclose((at(0, line + h * n) - at(0, line)) / h, (at(0, line) - at(0, line - h * n)) / h, atol=1e-4)
        assert at(0, p)[0] == pytest.approx(value[tuple(p)])


def test_odd_inputs(spark):
    asked = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 0.0), (3, 0.0, 0.0)], "target_id long, x double, y double")
    for rows, want in (([], {}), ([(0.0, 0.0, 5.0)], {1: (5.0, "outside"), 3: (5.0, "at")}), ([(0.0, 0.0, 5.0), (0.0, 0.0, 4.0), (3.0, 3.0, 1.0), (2.0, 2.0, 9.0), (None, 1.0, 1.0), (1.0, 2.0, None)], {1: (4.0, "outside"), 3: (4.0, "at")})):
        got = g.griddata(spark.createDataFrame(rows, "x double, y double, value double"), asked)
        assert {r.target_id: (r.value, r.how) for r in got.collect()} == want
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 2.0), (1, 1, 3.0), (0, 2, 5.0)], "row_i int, col_j int, v double")
    got = {(r.row_i, r.col_j): (r.value, r.how) for r in raster.griddata_filled(cells, "v", "linear").collect()}
    assert got[0, 1] == (3.0, "inside") and got[1, 1] == (3.0, "known")
    empty = raster.griddata_filled(cells.withColumn("v", F.lit(None).cast("double")), "v").collect()
    assert {(r.value, r.how) for r in empty} == {(None, "missing")} and len(empty) == 5


def test_places_within_reach_alone(spark):
    """Down the side of a strip: known cells more than the reach apart hold nothing between them, and too far ones are not taken."""
    known = spark.createDataFrame([(0, 0, 1.0), (0, 12, 3.0), (4, 6, 5.0), (4, 2, 7.0)], "x int, y int, value double")
    gaps = spark.createDataFrame([(1, 0, 6), (2, 0, 3), (3, 3, 3), (4, 40, 40), (5, 4, 6)], "target_id long, x int, y int")
    got = {r.target_id: (r.value, r.how) for r in g.griddata(known, gaps, "linear", reach=4).collect()}
    assert got == {1: (5.0, "outside"), 2: (1.0, "outside"), 3: (4.75, "inside"), 4: (None, "outside"), 5: (5.0, "at")}
    whole = {r.target_id: r.how for r in g.griddata(known, gaps, "linear").collect()}
    assert whole[1] == "inside"
