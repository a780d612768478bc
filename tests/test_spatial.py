import math
import random

import pytest

from areaweek.operators import spatial as sp

R = 6371.0088


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * R * math.asin(min(1, math.sqrt(h)))


def ring_edges(code, ring, points):
    return [(code, ring, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(points, points[1:] + points[:1]))]


EDGE = "lga_code string, ring int, seq int, x1 double, y1 double, x2 double, y2 double"


def test_concave_polygon_with_a_hole(spark):
    rows = ring_edges("A", 0, [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]) + ring_edges("A", 1, [(0.5, 0.2), (1, 0.2), (1, 0.6), (0.5, 0.6)])
    edges = spark.createDataFrame(rows, EDGE)
    points = spark.createDataFrame([("in", 0.2, 1.0), ("notch", 2.0, 3.0), ("hole", 0.7, 0.4), ("out", 9.0, 9.0), ("none", None, 1.0), ("same", 0.2, 1.0)],
                                   "point_id string, longitude double, latitude double")
    assert {r.point_id for r in sp.locate_points(points, edges).collect()} == {"in", "same"}


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(7)
    rows = [(f"u{i:03d}", rng.uniform(-60, 60), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 181) - 360 * (rng.random() < 0.5), 10 + rng.random()])) for i in range(120)]
    rows = [(u, la, ((lo + 180) % 360) - 180) for u, la, lo in rows]
    return rows, spark.createDataFrame(rows, "lga_code string, centre_lat double, centre_lon double")


def test_nearest_k_equals_all_pairs(spark, units):
    rows, registry = units
    got = {(r.lga_code, r.place): (r.neighbour_code, r.centroid_km) for r in sp.nearest_k(registry, registry, 3).collect()}
    assert len(got) == 3 * len(rows)
    for u, la, lo in rows:
        best = sorted((km(la, lo, b, c), v) for v, b, c in rows if v != u)[:3]
        for place, (distance, other) in enumerate(best, 1):
            assert got[u, place][0] == other and got[u, place][1] == pytest.approx(distance, abs=1e-6)


def test_nearest_k_with_too_few_units(spark):
    registry = spark.createDataFrame([("a", 0.0, 0.0), ("b", 50.0, 120.0)], "lga_code string, centre_lat double, centre_lon double")
    assert {(r.lga_code, r.neighbour_code) for r in sp.nearest_k(registry, registry, 3).collect()} == {("a", "b"), ("b", "a")}


def test_nearest_k_on_a_crowded_centre(spark):
    """10,000 units on one spot and 300 within metres of it: no join makes the pairs of the crowd, and ties go by code."""
    rows = [(f"c{i:05d}", 9.0, 7.0) for i in range(10_000)] + [(f"m{i:03d}", 9.01 + i * 1e-6, 7.0) for i in range(300)] + [("far", 11.0, 8.0), ("none", None, None)]
    registry = spark.createDataFrame(rows, "lga_code string, centre_lat double, centre_lon double")
    assert sp._level_sizes(registry.where("lga_code like 'm%'"))[0] < 360 / 2**13
    got = {}
    for r in sp.nearest_k(registry, registry, 3).collect():
        got.setdefault(r.lga_code, []).append((r.place, r.neighbour_code))
    names = lambda unit: [code for _, code in sorted(got[unit])]
    assert len(got) == 10_301 and "none" not in got
    assert names("c00001") == ["c00000", "c00002", "c00003"] and names("c09999") == ["c00000", "c00001", "c00002"]
    assert set(names("m150")[:2]) == {"m149", "m151"} and names("m000") == ["m001", "m002", "m003"]
    assert names("far") == ["m299", "m298", "m297"]


def test_snap_equals_all_pairs(spark, units):
    rows, registry = units
    rng = random.Random(3)
    spots = []
    for i in range(200):
        _, la, lo = rng.choice(rows)
        spots.append((f"p{i}", ((lo + rng.uniform(-0.6, 0.6) + 180) % 360) - 180, la + rng.uniform(-0.5, 0.5)))
    frame = spark.createDataFrame(spots, "point_id string, longitude double, latitude double")
    got = {r.point_id: r.lga_code for r in sp.snap_points(frame, registry).collect()}
    for pid, lo, la in spots:
        distance, unit = min((km(la, lo, b, c), u) for u, b, c in rows)
        assert got.get(pid) == (unit if distance <= 40 else None)


def test_adjacency_weights_and_one_directional_fill(spark):
    def square(code, x):
        return ring_edges(code, 0, [(x, 0), (x + 1, 0), (x + 1, 1), (x, 1)])

    edges = spark.createDataFrame(square("A", 0) + square("B", 1) + square("C", 2) + square("D", 30), EDGE)
    registry = spark.createDataFrame([(c, 0.5, x + 0.5) for c, x in (("A", 0), ("B", 1), ("C", 2), ("D", 30))], "lga_code string, centre_lat double, centre_lon double")
    rows = sp.build_adjacency(edges, registry).collect()
    total = {}
    for r in rows:
        total[r.lga_code] = total.get(r.lga_code, 0) + r.weight
    assert all(t == pytest.approx(1) for t in total.values())
    pairs = {(r.lga_code, r.neighbour_code): r for r in rows}
    assert pairs["A", "B"].border_km == pytest.approx(111.32 * math.sqrt(math.cos(math.radians(0.5))))
    assert len(pairs) == 12 and pairs["D", "C"].border_km == 1.0


def test_near_touch_is_a_weak_border(spark):
    a = ring_edges("A", 0, [(0, 0), (1, 0), (1, 1), (0, 1)])
    b = ring_edges("B", 0, [(1.015, 0), (2, 0), (2, 1), (1.015, 1)])
    registry = spark.createDataFrame([("A", 0.5, 0.5), ("B", 0.5, 1.5)], "lga_code string, centre_lat double, centre_lon double")
    got = {(r.lga_code, r.neighbour_code): r.border_km for r in sp.border_edges(spark.createDataFrame(a + b, EDGE), registry).collect()}
    assert set(got) == {("A", "B"), ("B", "A")} and got["A", "B"] == pytest.approx(0.01 * 111.32, rel=1e-3)


def borders(spark, *units):
    return {(r.lga_code, r.neighbour_code): r.border_degrees for r in sp.shared_borders(spark.createDataFrame(sum(units, []), EDGE)).collect()}


def test_a_slanted_border_with_own_vertices_on_each_side(spark):
    # One side draws the slope in one piece, the other in three, with vertices rounded to the grid.
    cuts = [(round(x, 6), round(x / 3, 6)) for x in (1.0, 1.7)]
    upper = ring_edges("A", 0, [(0, 0), (3, 1), (3, 4), (0, 4)])
    lower = ring_edges("B", 0, [(0, 0), (0, -2), (3, -2), (3, 1), cuts[1], cuts[0]])
    got = borders(spark, upper, lower)
    assert set(got) == {("A", "B"), ("B", "A")}
    assert all(v == pytest.approx(math.sqrt(10), abs=1e-5) for v in got.values())


def test_side_contact_containment_and_crossing(spark):
    big = ring_edges("A", 0, [(0, 0), (4, 0), (4, 4), (0, 4)])
    beside = ring_edges("B", 0, [(4, 1), (6, 1), (6, 2.5), (4, 2.5)])  # on a part of a side
    inner = ring_edges("C", 0, [(0, 1), (1, 1), (1, 2), (0, 2)])  # inside, on a part of a side
    far_in = ring_edges("D", 0, [(2, 2), (3, 2), (3, 3), (2, 3)])  # inside, no contact
    across = ring_edges("E", 0, [(-1, 3.5), (0.5, 3.5), (0.5, 3.8), (-1, 3.8)])  # crosses a side
    got = borders(spark, big, beside, inner, far_in, across)
    assert {k: round(v, 9) for k, v in got.items()} == {("A", "B"): 1.5, ("B", "A"): 1.5, ("A", "C"): 1.0, ("C", "A"): 1.0}
    edges = spark.createDataFrame(big + beside + inner + far_in + across, EDGE)
    pairs = {tuple(r) for r in sp.near_touches(edges, known=sp.shared_borders(edges)).collect()}
    assert pairs == {("A", "D"), ("D", "A"), ("A", "E"), ("E", "A")}


def test_each_stretch_counts_once(spark):
    # The neighbour draws the same side twice, whole and in parts that overlap.
    a = ring_edges("A", 0, [(0, 0), (2, 0), (2, 2), (0, 2)])
    b = [("B", 0, i, *map(float, s)) for i, s in enumerate([(2, 0, 2, 2), (2, 0, 2, 1.5), (2, 0.5, 2, 2), (2, 2, 2, 0), (2, 2, 5, 1), (5, 1, 2, 0)])]
    assert borders(spark, a, b)["A", "B"] == pytest.approx(2.0)


def test_near_by_segment_not_by_vertex(spark):
    # The corner of B points at the middle of a long side of A.
    a = ring_edges("A", 0, [(0, 0), (0, 50), (-1, 50), (-1, 0)])
    rows = lambda gap: spark.createDataFrame(a + ring_edges("B", 0, [(gap, 25.3), (3, 26), (3, 25)]), EDGE)
    assert {tuple(r) for r in sp.near_touches(rows(0.019)).collect()} == {("A", "B"), ("B", "A")}
    assert sp.near_touches(rows(0.021)).count() == 0


def test_location_keeps_no_lists(spark):
    edges = spark.createDataFrame(ring_edges("A", 0, [(0, 0), (4, 0), (4, 4)]), EDGE)
    points = spark.createDataFrame([("p", 3.0, 1.0)], "point_id string, longitude double, latitude double")
    plan = sp.locate_points(points, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Cartesian" not in plan
