"""Point location, nearest units and shared-border adjacency.

Every spatial join is an equi-join on grid cells followed by an exact test, so
there is no all-pairs step and no size limit on either side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, degrees_to_km, haversine_km
from ..session import durable
from .ranking import top_in_group

# Snapping radius, buffer of the near-touch test, smallest degree, filler border.
SNAP_KM = 40.0
BUFFER_DEGREES = 0.01
MIN_NEIGHBOURS = 3
FILLER_KM = 50.0


def _cell(value, size) -> Column:
    return F.floor(value / size).cast("long")


def _cells(low, high, size) -> Column:
    return F.sequence(_cell(low, size), _cell(high, size))


def polygons_around(spots: DataFrame, edges: DataFrame, size: float = 0.5) -> DataFrame:
    """(longitude, latitude, lga_code) of every polygon around each of the distinct ``spots``.

    A ray to the right of a point only meets edges whose height range covers the
    point. Edges are entered in the rows of cells that they cross, in each column of
    their polygon's box up to their own right end; crossings are counted edge by
    edge. Holes count through their own edges.
    """
    box = edges.groupBy("lga_code").agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"))
    columns = box.select("lga_code", F.explode(_cells(F.col("x0"), F.col("x9"), size)).alias("cx"))
    rows = edges.where("y1 <> y2").select("lga_code", "x1", "y1", "x2", "y2", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), size)).alias("cy"))
    entered = rows.join(columns, "lga_code").where(F.col("cx") * size <= F.greatest("x1", "x2"))
    at = spots.select("longitude", "latitude").withColumns({"cx": _cell(F.col("longitude"), size), "cy": _cell(F.col("latitude"), size)})
    crossed = F.expr("(y1 > latitude) <> (y2 > latitude) and longitude < (x2 - x1) * (latitude - y1) / nullif(y2 - y1, 0) + x1")
    hits = at.join(entered, ["cx", "cy"]).where(crossed).groupBy("longitude", "latitude", "lga_code").agg(F.count(F.lit(1)).alias("crossings"))
    return hits.where("crossings % 2 = 1").select("longitude", "latitude", "lga_code")


def locate_points(points: DataFrame, edges: DataFrame, size: float = 0.5, key: str = "point_id") -> DataFrame:
    """(key, lga_code) for points inside a polygon; the lowest code wins an overlap.

    Points are reduced to distinct coordinates first: many events share a
    town's coordinates, and each coordinate is tested once.
    """
    usable = points.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull() & ~F.isnan("longitude") & ~F.isnan("latitude"))
    held = polygons_around(usable.select("longitude", "latitude").distinct(), edges, size)
    held = held.groupBy("longitude", "latitude").agg(F.min("lga_code").alias("lga_code"))
    return usable.select(key, "longitude", "latitude").join(held, ["longitude", "latitude"]).select(key, "lga_code")


def _radius_degrees(km, latitude: Column) -> tuple[Column, Column]:
    """Half height and half width in degrees of the box around a circle on the sphere."""
    angle = (km if isinstance(km, Column) else F.lit(float(km))) / EARTH_RADIUS_KM
    ratio = F.sin(angle) / F.greatest(F.cos(F.radians(latitude)), F.lit(1e-9))
    width = F.when((ratio >= 1) | (angle >= math.pi / 2), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    return F.degrees(angle), width


def _around(df: DataFrame, lat: str, lon: str, half_height: Column, half_width: Column, size) -> DataFrame:
    """Fan a row out to every cell that its box touches; columns wrap at the date line.

    ``size`` must divide 360.

    A small margin keeps distances right at the edge of the box inside it.
    """
    columns = F.ceil(F.lit(360.0) / size).cast("long")
    margin = 1e-6
    lon_cells = F.when(
        half_width >= 179.0, F.sequence(F.lit(0).cast("long"), columns - 1)
    ).otherwise(
        F.array_distinct(
            F.transform(
                _cells(F.col(lon) + 180 - half_width - margin, F.col(lon) + 180 + half_width + margin, size),
                lambda c: F.pmod(c, columns),
            )
        )
    )
    return df.withColumn("cy", F.explode(_cells(F.col(lat) - half_height - margin, F.col(lat) + half_height + margin, size))).withColumn("cx", F.explode(lon_cells))


def _own_cell(lat: str, lon: str, size) -> dict[str, Column]:
    return {"cy": _cell(F.col(lat), size), "cx": _cell(F.pmod(F.col(lon) + 180, F.lit(360.0)), size)}


def snap_points(points: DataFrame, registry: DataFrame, max_km: float = SNAP_KM, key: str = "point_id") -> DataFrame:
    """(key, lga_code, km): nearest unit centre within ``max_km``, lowest code on a tie."""
    size = 0.5
    centres = registry.select("lga_code", "centre_lat", "centre_lon")
    high, wide = _radius_degrees(max_km, F.least(F.abs("centre_lat") + math.degrees(max_km / EARTH_RADIUS_KM), F.lit(90.0)))
    reach = _around(centres, "centre_lat", "centre_lon", high, wide, F.lit(size))
    spots = points.select("longitude", "latitude").where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).distinct()
    near = spots.withColumns(_own_cell("latitude", "longitude", F.lit(size))).join(reach, ["cx", "cy"])
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("centre_lat"), F.col("centre_lon"))
    best = near.withColumn("km", km).where(F.col("km") <= max_km).groupBy("longitude", "latitude").agg(
        F.min(F.struct("km", "lga_code")).alias("b")
    )
    return points.select(key, "longitude", "latitude").join(best, ["longitude", "latitude"]).select(key, "b.lga_code", "b.km")


def assign_units(points: DataFrame, edges: DataFrame, registry: DataFrame, key: str = "point_id") -> DataFrame:
    """Every point with its unit: polygon first, then nearest centre, else null."""
    inside = locate_points(points, edges, key=key).withColumn("located_by", F.lit("polygon"))
    outside = points.join(inside.select(key), key, "left_anti")
    snapped = snap_points(outside, registry, key=key).select(key, "lga_code", F.lit("centre").alias("located_by"))
    return points.select(key).join(inside.unionByName(snapped), key, "left")


def _along(segments: DataFrame, size: float, margin: float) -> DataFrame:
    """Enter each segment (x1 <= x2) in the cells within ``margin`` of it, column by column."""
    columns = segments.withColumn("cx", F.explode(_cells(F.col("x1") - margin, F.col("x2") + margin, size)))
    inside = lambda x: F.least("x2", F.greatest("x1", x))
    slope = (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))
    left, right = (F.col("y1") + (inside(x) - F.col("x1")) * slope for x in (F.col("cx") * size - margin, (F.col("cx") + 1) * size + margin))
    ends = F.coalesce(left, "y1"), F.coalesce(right, "y2")
    return columns.withColumn("cy", F.explode(_cells(F.least(*ends) - margin, F.greatest(*ends) + margin, size)))


def _segments(edges: DataFrame, digits: int) -> DataFrame:
    """Distinct segments of each unit, snapped to a grid, left end first."""
    a, b = (F.struct(F.round(x, digits).alias("x"), F.round(y, digits).alias("y")) for x, y in (("x1", "y1"), ("x2", "y2")))
    ends = edges.select("lga_code", F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).where("p <> q").distinct()
    return ends.select("lga_code", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def _other(segments: DataFrame) -> DataFrame:
    return segments.withColumnsRenamed({"lga_code": "neighbour_code", "x1": "u1", "y1": "v1", "x2": "u2", "y2": "v2"})


def _typical_length(segments: DataFrame) -> float:
    return segments.agg(F.avg(F.expr("sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"))).first()[0] or 1.0


def shared_borders(edges: DataFrame, digits: int = 6) -> DataFrame:
    """(lga_code, neighbour_code, border_degrees): the length over which the borders of two units run together.

    Vertices need not agree: each stretch where a segment of one unit lies on a segment
    of the other counts, whether a side is split, longer than the other, or a
    unit lies inside another and touches its side. Segments meet in grid cells of
    about their own length and must keep within the snapping error over the stretch;
    the stretches of a segment with one neighbour are swept in order, so each part
    counts once.
    """
    segments, error = _segments(edges, digits), 1.5 * 10.0**-digits
    size = max(2 * _typical_length(segments), 100 * error)
    cells = _along(segments, size, error)
    boxes = f"u1 <= x2 + {error} and u2 >= x1 - {error} and least(v1, v2) <= greatest(y1, y2) + {error} and greatest(v1, v2) >= least(y1, y2) - {error}"
    met = cells.join(_other(cells), ["cx", "cy"]).where(f"lga_code <> neighbour_code and {boxes}")
    # Places of the other's ends along this segment (t) and their distances from its line (d).
    length = "sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))"
    along = lambda u, v: F.expr(f"(({u} - x1) * (x2 - x1) + ({v} - y1) * (y2 - y1)) / {length}")
    apart = lambda u, v: F.expr(f"(({v} - y1) * (x2 - x1) - ({u} - x1) * (y2 - y1)) / {length}")
    placed = met.withColumns({"t1": along("u1", "v1"), "t2": along("u2", "v2"), "d1": apart("u1", "v1"), "d2": apart("u2", "v2")})
    stretch = placed.withColumns({"low": F.expr("greatest(0.0, least(t1, t2))"), "high": F.expr(f"least({length}, greatest(t1, t2))")})
    near = lambda t: F.abs(F.expr(f"d1 + (d2 - d1) * ({t} - t1) / (t2 - t1)")) <= error
    together = stretch.where(f"high - low > {error}").where(near("low") & near("high"))
    segment = ["lga_code", "neighbour_code", "x1", "y1", "x2", "y2"]
    # A window holds the stretches of one segment with one neighbour.
    before = F.max("high").over(Window.partitionBy(*segment).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    new = together.select(*segment, "low", "high").distinct().withColumn("new", F.col("high") - F.greatest("low", before))
    return new.where("new > 0").groupBy("lga_code", "neighbour_code").agg(F.sum("new").alias("border_degrees"))


def _squared_distance(x: str, y: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """Square of a point's distance from a segment, as SQL."""
    t = f"coalesce(least(1.0, greatest(0.0, (({x} - {x1}) * ({x2} - {x1}) + ({y} - {y1}) * ({y2} - {y1})) / nullif(pow({x2} - {x1}, 2) + pow({y2} - {y1}, 2), 0))), 0.0)"
    return f"(pow({x} - {x1} - {t} * ({x2} - {x1}), 2) + pow({y} - {y1} - {t} * ({y2} - {y1}), 2))"


def _side(x: str, y: str, x1: str, y1: str, x2: str, y2: str) -> str:
    return f"sign(({x2} - {x1}) * ({y} - {y1}) - ({y2} - {y1}) * ({x} - {x1}))"


def near_touches(edges: DataFrame, reach: float = 2 * BUFFER_DEGREES, known: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """Pairs of units whose segments come within ``reach``, or of which one lies inside the other.

    Only segments of units that meet in a cell are compared, and pairs in ``known`` are
    left out before that, so the many neighbours with a common border cost nothing.
    """
    segments = _segments(edges, digits)
    size = max(_typical_length(segments), reach)
    cells = _along(segments, size, reach / 2 + 10.0**-digits)
    homes = cells.select("lga_code", "cx", "cy").distinct()
    pairs = homes.join(homes.withColumnRenamed("lga_code", "neighbour_code"), ["cx", "cy"]).where("lga_code < neighbour_code")
    if known is not None:
        pairs = pairs.join(known.select("lga_code", "neighbour_code"), ["lga_code", "neighbour_code"], "left_anti")
    met = pairs.join(cells, ["lga_code", "cx", "cy"]).join(_other(cells), ["neighbour_code", "cx", "cy"])
    one, two = ("x1", "y1", "x2", "y2"), ("u1", "v1", "u2", "v2")
    ends = [_squared_distance(*p, *s) for p, s in ((two[:2], one), (two[2:], one), (one[:2], two), (one[2:], two))]
    crossing = f"{_side(*two[:2], *one)} * {_side(*two[2:], *one)} < 0 and {_side(*one[:2], *two)} * {_side(*one[2:], *two)} < 0"
    close = met.where(f"least({', '.join(ends)}) <= {reach * reach} or ({crossing})").select("lga_code", "neighbour_code").distinct()
    # One corner of each ring tells whether the ring lies inside another unit.
    ring = ["lga_code", *[c for c in ("ring",) if c in edges.columns]]
    corners = edges.groupBy(*ring).agg(F.min(F.struct("x1", "y1")).alias("c")).select(F.col("lga_code").alias("inner"), F.col("c.x1").alias("longitude"), F.col("c.y1").alias("latitude"))
    held = corners.join(polygons_around(corners.select("longitude", "latitude").distinct(), edges), ["longitude", "latitude"]).where("inner <> lga_code")
    both = close.unionByName(held.select(F.least("inner", "lga_code").alias("lga_code"), F.greatest("inner", "lga_code").alias("neighbour_code"))).distinct()
    either = both.unionByName(both.select(F.col("neighbour_code").alias("lga_code"), F.col("lga_code").alias("neighbour_code")))
    return either if known is None else either.join(known.select("lga_code", "neighbour_code"), ["lga_code", "neighbour_code"], "left_anti")


def border_edges(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """(lga_code, neighbour_code, border_km, centroid_km) before filling and weighting."""
    shared = durable(shared_borders(edges))
    touching = near_touches(edges, known=shared).withColumn("border_degrees", F.lit(BUFFER_DEGREES))
    a = registry.select("lga_code", F.col("centre_lat").alias("a_lat"), F.col("centre_lon").alias("a_lon"))
    b = registry.select(F.col("lga_code").alias("neighbour_code"), F.col("centre_lat").alias("b_lat"), F.col("centre_lon").alias("b_lon"))
    return shared.unionByName(touching).join(a, "lga_code").join(b, "neighbour_code").select(
        "lga_code", "neighbour_code",
        degrees_to_km(F.col("border_degrees"), (F.col("a_lat") + F.col("b_lat")) / 2).alias("border_km"),
        haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("centroid_km"),
    )


# Halvings of the full circle: sizes divide it, so wrapped columns line up.
_DEPTHS = (13, 17, 21, 25, 29)
#: A cell of the finest grid may hold so many units before a finer one is used.
_FULL_CELL = 64


def _level_sizes(centres: DataFrame) -> list[float]:
    """Cell sizes from the finest grid that the centres need to the whole circle."""
    depth = F.posexplode(F.array(*[F.lit(360 / 2**d) for d in _DEPTHS])).alias("place", "size")
    cells = centres.select("centre_lat", "centre_lon", depth).withColumns(_own_cell("centre_lat", "centre_lon", F.col("size")))
    fullest = cells.groupBy("place", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).groupBy("place").agg(F.max("n").alias("n"))
    # One row per depth.
    place = fullest.where(F.col("n") <= _FULL_CELL).agg(F.min("place")).first()[0]
    finest = _DEPTHS[-1] if place is None else _DEPTHS[place]
    return [360 / 2**i for i in range(finest, -1, -1)]


def nearest_k(queries: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest other units of each query unit, exactly, without all pairs.

    Units that share a centre are one class: it is asked for once, and of its units
    only the first ``k + 1`` by code can be anyone's nearest. A pyramid of grids, as
    fine as the fullest cell needs, is counted first. Each centre picks the finest
    level whose 3 x 3 block holds enough units, which bounds the distance of its
    last neighbour; the second look takes every unit within that bound. Units
    without a centre neither ask nor answer.
    """
    spot = ["centre_lat", "centre_lon"]
    every = registry.select("lga_code", *spot).where(F.col("centre_lat").isNotNull() & F.col("centre_lon").isNotNull())
    centres = top_in_group(every, spot, [F.asc("lga_code")], k + 1, "_m").drop("_m")
    level_sizes = _level_sizes(centres)
    sizes = F.array(*[F.lit(s) for s in level_sizes])
    level = F.posexplode(sizes).alias("level", "size")
    homes = centres.select("*", level).withColumns(_own_cell("centre_lat", "centre_lon", F.col("size")))
    members = queries.select("lga_code").distinct().join(every, "lga_code")
    asking = members.groupBy(*spot).agg(F.min("lga_code").alias("q")).select("q", F.col("centre_lat").alias("q_lat"), F.col("centre_lon").alias("q_lon"))
    occupied = homes.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    near_block = _around(asking.select("*", level), "q_lat", "q_lon", F.col("size"), F.col("size"), F.col("size"))
    filled = near_block.join(occupied, ["level", "cx", "cy"]).groupBy("q", "level").agg(F.sum("n").alias("n")).where(F.col("n") > k)
    start = filled.groupBy("q").agg(F.min("level").alias("level"))
    rough = near_block.join(start, ["q", "level"]).join(homes, ["level", "cx", "cy"])
    km = haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("centre_lat"), F.col("centre_lon"))
    bound = top_in_group(rough.select("q", km.alias("km"), "lga_code"), ["q"], [F.asc("km"), F.asc("lga_code")], k + 1, "_r")
    reach = bound.groupBy("q").agg(F.max("km").alias("reach"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k + 1)
    # A query with fewer than k others anywhere looks at the whole sphere.
    bounded = asking.join(reach.select("q", "reach"), "q", "left").withColumn("reach", F.coalesce("reach", F.lit(math.pi * EARTH_RADIUS_KM)) * (1 + 1e-9) + 1e-6)
    high, wide = _radius_degrees(F.col("reach"), F.least(F.abs("q_lat") + F.degrees(F.col("reach") / EARTH_RADIUS_KM), F.lit(90.0)))
    needed = F.greatest(high, F.least(wide, F.lit(360.0)))
    fitting = F.array_max(F.filter(F.transform(sizes, lambda s, i: F.when(s < needed, i + 1).otherwise(0)), lambda i: i.isNotNull()))
    chosen = bounded.withColumn("level", F.least(fitting, F.lit(len(level_sizes) - 1))).withColumn("size", F.element_at(sizes, F.col("level") + 1))
    second = _around(chosen, "q_lat", "q_lon", high, wide, F.col("size"))
    found = second.join(homes.drop("size"), ["level", "cx", "cy"]).select("q", "q_lat", "q_lon", "lga_code", km.alias("km"))
    listed = top_in_group(found, ["q"], [F.asc("km"), F.asc("lga_code")], k + 1, "_r").select(
        F.col("q_lat").alias("centre_lat"), F.col("q_lon").alias("centre_lon"), F.col("lga_code").alias("neighbour_code"), F.col("km").alias("centroid_km")
    )
    others = members.join(listed, spot).where(F.col("lga_code") != F.col("neighbour_code")).select("lga_code", "neighbour_code", "centroid_km")
    return top_in_group(others, ["lga_code"], [F.asc("centroid_km"), F.asc("neighbour_code")], k, "place")


def fill_isolated(adjacency: DataFrame, registry: DataFrame, k: int = MIN_NEIGHBOURS) -> DataFrame:
    """Add the ``k`` nearest units to units with fewer than ``k`` edges; existing edges win.

    The fill is one-directional: the neighbour does not gain the reverse edge.
    """
    degree = adjacency.groupBy("lga_code").agg(F.count(F.lit(1)).alias("n"))
    thin = registry.select("lga_code").join(degree, "lga_code", "left").where(F.coalesce("n", F.lit(0)) < k)
    border = F.greatest(F.lit(1.0), F.lit(FILLER_KM) / F.greatest(F.col("centroid_km"), F.lit(1.0)))
    extra = nearest_k(thin, registry, k).select("lga_code", "neighbour_code", border.alias("border_km"), "centroid_km")
    missing = extra.join(adjacency.select("lga_code", "neighbour_code"), ["lga_code", "neighbour_code"], "left_anti")
    return adjacency.select("lga_code", "neighbour_code", "border_km", "centroid_km").unionByName(missing)


def border_weights(adjacency: DataFrame) -> DataFrame:
    """Each edge's share of its unit's total border."""
    totals = adjacency.groupBy("lga_code").agg(F.sum("border_km").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("border_km") / F.col("_total")).otherwise(0.0)
    return adjacency.join(totals, "lga_code").select("lga_code", "neighbour_code", share.alias("weight"), "border_km", "centroid_km")


def build_adjacency(edges: DataFrame, registry: DataFrame) -> DataFrame:
    return border_weights(fill_isolated(border_edges(edges, registry), registry))


def first_edge_wins(tables: list[DataFrame]) -> DataFrame:
    """Union of edge tables; of edges listed twice the earlier table's stays."""
    stacked = None
    for rank, table in enumerate(tables):
        rows = table.withColumn("_rank", F.lit(rank))
        stacked = rows if stacked is None else stacked.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy("lga_code", "neighbour_code").orderBy("_rank")
    return stacked.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_rank")
