"""Spatial queries: unit cells from the nations, points from the orders, customer centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Domain
from ..functions.geo import degrees_to_km, haversine_km
from ..operators import spatial as sp
from .panel_checks import r6
from .sql import compose

QUERIES: dict = {}
SQL: dict[str, str] = {}

HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
# Each nation is a square cell with one corner cut, so not every polygon is convex-regular.
PARTS = {
    "corners": """select lga_code, unnest([centre_lon - 1, centre_lon + 1, centre_lon + 1, centre_lon, centre_lon - 1]) as x, unnest([centre_lat - 1, centre_lat - 1, centre_lat + 1, centre_lat + 1, centre_lat + 1]) as y, unnest([1, 2, 3, 4, 5]) as i from registry""",
    "segs": """select lga_code, x as x1, y as y1, coalesce(lead(x) over o, first_value(x) over o) as x2, coalesce(lead(y) over o, first_value(y) over o) as y2
        from corners window o as (partition by lga_code order by i rows between unbounded preceding and unbounded following)""",
    "points": "select event_id as point_id, longitude, latitude from incidents",
    "inside": """select point_id, min(lga_code) as lga_code from (select point_id, lga_code, sum(case when (y1 > latitude) <> (y2 > latitude) and longitude < (x2 - x1) * (latitude - y1) / nullif(y2 - y1, 0) + x1 then 1 else 0 end) as crossings
        from points cross join segs group by all) where crossings % 2 = 1 group by all""",
    "snapped": f"select point_id, arg_min(lga_code, (km, lga_code)) as lga_code, min(km) as km from (select point_id, lga_code, {HAV.format(a='latitude', b='centre_lat', c='longitude', d='centre_lon')} as km from points cross join registry) where km <= 40 group by all",
    # Border units: the cells (every other one with split sides), a square on the west side of each, and one well inside.
    "border_units": """select lga_code, centre_lat, centre_lon from registry union all select 'V' || lga_code, centre_lat, centre_lon - 0.75 from registry
        union all select 'W' || lga_code, centre_lat, centre_lon from registry""",
    "border_corners": """select lga_code, x, y, i from corners
        union all select lga_code, centre_lon - 1, centre_lat + 0.25, 6 from registry where ascii(right(lga_code, 1)) % 2 = 1
        union all select lga_code, centre_lon + 0.5, centre_lat - 1, 1.5 from registry where ascii(right(lga_code, 1)) % 2 = 1
        union all select 'V' || lga_code, centre_lon + unnest([-1, -0.5, -0.5, -1]), centre_lat + unnest([-0.5, -0.5, 0.5, 0.5]), unnest([1, 2, 3, 4]) from registry
        union all select 'W' || lga_code, centre_lon + unnest([-0.125, 0.125, 0.125, -0.125]), centre_lat + unnest([-0.125, -0.125, 0.125, 0.125]), unnest([1, 2, 3, 4]) from registry""",
    "border_segs": """select lga_code, x as x1, y as y1, coalesce(lead(x) over o, first_value(x) over o) as x2, coalesce(lead(y) over o, first_value(y) over o) as y2
        from border_corners window o as (partition by lga_code order by i rows between unbounded preceding and unbounded following)""",
    "collinear": """select a.lga_code, b.lga_code as neighbour_code, sqrt(pow(a.x2 - a.x1, 2) + pow(a.y2 - a.y1, 2)) as len,
        ((b.x1 - a.x1) * (a.x2 - a.x1) + (b.y1 - a.y1) * (a.y2 - a.y1)) as s1, ((b.x2 - a.x1) * (a.x2 - a.x1) + (b.y2 - a.y1) * (a.y2 - a.y1)) as s2
        from border_segs a join border_segs b on a.lga_code <> b.lga_code
        and abs((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) < 1e-9 and abs((b.x2 - a.x1) * (a.y2 - a.y1) - (b.y2 - a.y1) * (a.x2 - a.x1)) < 1e-9""",
    "shared": """select lga_code, neighbour_code, sum(least(len, greatest(s1, s2) / len) - greatest(0, least(s1, s2) / len)) as deg from collinear
        where least(len, greatest(s1, s2) / len) - greatest(0, least(s1, s2) / len) > 1e-6 group by all""",
    "close_ends": """select distinct a.lga_code, b.lga_code as neighbour_code from border_corners a join border_segs b on a.lga_code <> b.lga_code
        and pow(a.x - b.x1 - least(1, greatest(0, ((a.x - b.x1) * (b.x2 - b.x1) + (a.y - b.y1) * (b.y2 - b.y1)) / (pow(b.x2 - b.x1, 2) + pow(b.y2 - b.y1, 2)))) * (b.x2 - b.x1), 2)
          + pow(a.y - b.y1 - least(1, greatest(0, ((a.x - b.x1) * (b.x2 - b.x1) + (a.y - b.y1) * (b.y2 - b.y1)) / (pow(b.x2 - b.x1, 2) + pow(b.y2 - b.y1, 2)))) * (b.y2 - b.y1), 2) <= 0.0004""",
    "held": """select c.lga_code, s.lga_code as neighbour_code from (select lga_code, min((x, y))[1] as x, min((x, y))[2] as y from border_corners group by lga_code) c
        join border_segs s on s.lga_code <> c.lga_code and (s.y1 > c.y) <> (s.y2 > c.y) and c.x < (s.x2 - s.x1) * (c.y - s.y1) / nullif(s.y2 - s.y1, 0) + s.x1
        group by all having count(*) % 2 = 1""",
    "touch": """select distinct lga_code, neighbour_code, 0.01 as deg from (select * from close_ends union all select neighbour_code, lga_code from close_ends union all select * from held union all select neighbour_code, lga_code from held) t
        anti join shared s on s.lga_code = t.lga_code and s.neighbour_code = t.neighbour_code""",
    "borders": f"select e.lga_code, neighbour_code, deg * 111.32 * sqrt(cos(radians((a.centre_lat + b.centre_lat) / 2))) as border_km, {HAV.format(a='a.centre_lat', b='b.centre_lat', c='a.centre_lon', d='b.centre_lon')} as centroid_km from (select * from shared union all select * from touch) e join border_units a on a.lga_code = e.lga_code join border_units b on b.lga_code = e.neighbour_code",
    "centres": "select lga_code, centre_lat, centre_lon from registry_l",
    "knn": f"select * from (select a.lga_code, b.lga_code as neighbour_code, {HAV.format(a='a.centre_lat', b='b.centre_lat', c='a.centre_lon', d='b.centre_lon')} as km, row_number() over (partition by a.lga_code order by {HAV.format(a='a.centre_lat', b='b.centre_lat', c='a.centre_lon', d='b.centre_lon')}, b.lga_code) as place from centres a join centres b on a.lga_code <> b.lga_code) where place <= 3",
    "thin_edges": "select concat('C', lpad(cast(a.c_custkey as string), 9, '0')) as lga_code, concat('C', lpad(cast(b.c_custkey as string), 9, '0')) as neighbour_code, 1.0::double as border_km, 1.0::double as centroid_km from customer a join customer b on b.c_custkey in (a.c_custkey - 1, a.c_custkey + 1)",
    "filled": "select * from thin_edges union all select lga_code, neighbour_code, greatest(1.0, 50 / greatest(km, 1.0)), km from knn k anti join thin_edges t on t.lga_code = k.lga_code and t.neighbour_code = k.neighbour_code",
}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql, PARTS)
        return fn

    return add


def cell_edges(d: Domain):
    """Polygon edges of the unit cells."""
    x, y = F.col("centre_lon"), F.col("centre_lat")
    ring = [(x - 1, y - 1), (x + 1, y - 1), (x + 1, y + 1), (x, y + 1), (x - 1, y + 1)]
    segments = [
        F.struct(F.lit(i).alias("seq"), a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
        for i, (a, b) in enumerate(zip(ring, [*ring[1:], ring[0]]))
    ]
    return d.registry.select("lga_code", F.lit(0).alias("ring"), F.explode(F.array(*segments)).alias("s")).select("lga_code", "ring", "s.*")


def _ring(units, prefix: str, corners: list[tuple]):
    """Edges of one ring per unit; corners are offsets from its centre."""
    at = lambda c: (F.col("centre_lon") + c[0], F.col("centre_lat") + c[1])
    sides = [F.struct(F.lit(i).alias("seq"), *[v.alias(n) for v, n in zip((*at(a), *at(b)), ("x1", "y1", "x2", "y2"))]) for i, (a, b) in enumerate(zip(corners, [*corners[1:], corners[0]]))]
    return units.select(F.concat(F.lit(prefix), "lga_code").alias("lga_code"), F.lit(0).alias("ring"), F.explode(F.array(*sides)).alias("s")).select("lga_code", "ring", "s.*")


def border_units(d: Domain):
    """Cells, every other one with split sides; a square on the west side of each; a square well inside."""
    odd = F.ascii(F.right("lga_code", F.lit(1))) % 2 == 1
    plain = [(-1, -1), (1, -1), (1, 1), (0, 1), (-1, 1)]
    split = [(-1, -1), (0.5, -1), (1, -1), (1, 1), (0, 1), (-1, 1), (-1, 0.25)]
    edges = _ring(d.registry.where(~odd), "", plain).unionByName(_ring(d.registry.where(odd), "", split))
    edges = edges.unionByName(_ring(d.registry, "V", [(-1, -0.5), (-0.5, -0.5), (-0.5, 0.5), (-1, 0.5)]))
    edges = edges.unionByName(_ring(d.registry, "W", [(-0.125, -0.125), (0.125, -0.125), (0.125, 0.125), (-0.125, 0.125)]))
    named = lambda prefix, shift: d.registry.select(F.concat(F.lit(prefix), "lga_code").alias("lga_code"), "centre_lat", (F.col("centre_lon") + shift).alias("centre_lon"))
    return edges, named("", 0.0).unionByName(named("V", -0.75)).unionByName(named("W", 0.0))


def points(d: Domain):
    return d.incidents.select(F.col("event_id").alias("point_id"), "longitude", "latitude")


@query(
    "g1_haversine",
    f"select event_id, round({HAV.format(a='latitude', b='centre_lat', c='longitude', d='centre_lon')}, 6) as km from incidents join registry using (lga_code)",
)
def g1(spark, sf):
    d = Domain(spark, sf)
    joined = d.incidents.join(d.registry.select("lga_code", "centre_lat", "centre_lon"), "lga_code")
    return joined.select("event_id", r6(haversine_km(F.col("latitude"), F.col("longitude"), F.col("centre_lat"), F.col("centre_lon")), "km"))


@query("g2_degrees_to_km", "select event_id, round(longitude * 111.32 * sqrt(cos(radians(latitude))), 6) as km from incidents")
def g2(spark, sf):
    return Domain(spark, sf).incidents.select("event_id", r6(degrees_to_km(F.col("longitude"), F.col("latitude")), "km"))


@query("j5_point_in_polygon", "select point_id, lga_code from inside")
def j5(spark, sf):
    d = Domain(spark, sf)
    return sp.locate_points(points(d), cell_edges(d))


@query("j6_nearest_centre", "select point_id, lga_code, round(km, 6) as km from snapped")
def j6(spark, sf):
    d = Domain(spark, sf)
    return sp.snap_points(points(d), d.registry).withColumn("km", F.round("km", 6))


@query(
    "j6_assign_units",
    "select p.point_id, coalesce(i.lga_code, s.lga_code) as lga_code, case when i.lga_code is not null then 'polygon' when s.lga_code is not null then 'centre' end as located_by from points p left join inside i using (point_id) left join snapped s using (point_id)",
)
def j6b(spark, sf):
    d = Domain(spark, sf)
    return sp.assign_units(points(d), cell_edges(d), d.registry)


@query(
    "j7_shared_borders",
    "select borders.lga_code, neighbour_code, round(border_km, 6) as border_km, round(centroid_km, 6) as centroid_km, n as incidents from borders join (select lga_code, count(*) as n from incidents group by all) i on i.lga_code = right(borders.lga_code, 4)",
)
def j7(spark, sf):
    d = Domain(spark, sf)
    n = d.incidents.groupBy(F.col("lga_code").alias("home")).agg(F.count(F.lit(1)).alias("incidents"))
    edges, units = border_units(d)
    return sp.border_edges(edges, units).withColumn("home", F.right("lga_code", F.lit(4))).join(n, "home").select(
        "lga_code", "neighbour_code", r6("border_km", "border_km"), r6("centroid_km", "centroid_km"), "incidents"
    )


@query("j8_nearest_k", "select lga_code, neighbour_code, round(km, 6) as centroid_km, place from knn")
def j8(spark, sf):
    registry = Domain(spark, sf, large=True).registry
    return sp.nearest_k(registry, registry, 3).withColumn("centroid_km", F.round("centroid_km", 6))


@query("j8_fill_isolated", "select lga_code, neighbour_code, round(border_km, 6) as border_km, round(centroid_km, 6) as centroid_km from filled")
def j8b(spark, sf):
    d = Domain(spark, sf, large=True)
    return sp.fill_isolated(d.adjacency, d.registry).select("lga_code", "neighbour_code", r6("border_km", "border_km"), r6("centroid_km", "centroid_km"))


@query("a18_border_weights", "select lga_code, neighbour_code, round(border_km / sum(border_km) over (partition by lga_code), 6) as weight from filled")
def a18(spark, sf):
    d = Domain(spark, sf, large=True)
    return sp.border_weights(sp.fill_isolated(d.adjacency, d.registry)).select("lga_code", "neighbour_code", r6("weight", "weight"))


@query(
    "u2_first_edge_wins",
    "select lga_code, neighbour_code, round(border_km, 6) as border_km from (select lga_code, neighbour_code, border_km from thin_edges union all select lga_code, neighbour_code, km from knn k anti join thin_edges t on t.lga_code = k.lga_code and t.neighbour_code = k.neighbour_code)",
)
def u2(spark, sf):
    d = Domain(spark, sf, large=True)
    extra = sp.nearest_k(d.registry, d.registry, 3).select("lga_code", "neighbour_code", F.col("centroid_km").alias("border_km"))
    base = d.adjacency.select("lga_code", "neighbour_code", "border_km")
    return sp.first_edge_wins([base, extra]).select("lga_code", "neighbour_code", r6("border_km", "border_km"))
