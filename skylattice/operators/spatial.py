"""Gridded values at station points, nearest or bilinear, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.timefns import align
from skylattice.schema import require

from .durable import cut

KEYS = ["datetime", "lat", "lon"]


def at_stations(grid: DataFrame, stations: DataFrame, mode: str = "nearest") -> DataFrame:
    """station_id, datetime and the grid's value columns at each station and time.

    A grid that has stations already passes through (J3c). Else times with the same points share a lattice,
    each station's places are found once a lattice, and the grid meets them by an equi-join of lattice, lat
    and lon: rows that no station reads are dropped where they are scanned. Of rows that repeat a time and
    point the least values count. A grid row without lat or lon is passed over; a station without gets no rows.
    """
    if {"station_id", "datetime"} <= set(grid.columns):
        return align(grid, "UTC").withColumn("station_id", F.col("station_id").cast("string"))
    require(grid, KEYS, "grid")
    if mode not in ("nearest", "bilinear"):
        raise ValueError(f"unknown extraction mode {mode!r}")
    grid = align(grid, "UTC").where("lat is not null and lon is not null")
    values = [c for c in grid.columns if c not in KEYS]
    points = stations.select(F.col("station_id").cast("string").alias("station_id"), F.col("lat").cast("double").alias("s_lat"), F.col("lon").cast("double").alias("s_lon"))
    points = points.where("s_lat is not null and s_lon is not null")
    times = cut(lattices(grid))  # the grid is read for this, for the lattices' points, and for its values: three times
    n_stations, (n_times, n_lattices) = _up_to_limit(points), times.agg(F.count("*"), F.count_distinct("lattice")).first()
    points = _dimension(points, n_stations)
    first = times.groupBy("lattice").agg(F.min("datetime").alias("datetime"))
    lattice = cut(grid.select(*KEYS).join(first, "datetime").select("lattice", "lat", "lon").distinct())
    places = _nearest(lattice, points)
    if mode == "bilinear":
        places = places.unionByName(_corners(lattice, points))
    # `v` stays a struct: a corner whose values are null is there all the same.
    read = grid.withColumn("v", F.struct(*[F.col(c).cast("double").alias(c) for c in values])).select(*KEYS, "v")
    # A lattice has one place a station, or five.
    n_places = n_stations * n_lattices * (5 if mode == "bilinear" else 1)
    met = read.join(_dimension(times, n_times), "datetime").join(_dimension(places, n_places), ["lattice", "lat", "lon"])
    at = [F.min(F.when(F.col("place") == i, F.col("v"))).alias(f"v{i}") for i in range(5 if mode == "bilinear" else 1)]
    share = [F.min(F.when(F.col("place") == i, F.col("share"))).alias(f"w{i}") for i in range(1, 5)] if mode == "bilinear" else []
    found = met.groupBy("station_id", "datetime").agg(*at, *share)
    if mode == "nearest":
        return found.select("station_id", "datetime", "v0.*")
    all_there = F.col("v1").isNotNull() & F.col("v2").isNotNull() & F.col("v3").isNotNull() & F.col("v4").isNotNull()
    # In the order in which the terms are summed: low-low, high-low, low-high, high-high.
    total = {c: sum((F.col(f"v{i}")[c] * F.col(f"w{i}") for i in (3, 2, 4)), F.col("v1")[c] * F.col("w1")) for c in values}
    return found.select("station_id", "datetime", *[F.when(all_there, t).otherwise(F.col("v0")[c]).alias(c) for c, t in total.items()])


def lattices(grid: DataFrame) -> DataFrame:
    """datetime, lattice: times whose rows have the same points, as often, share one; told by the count and two sums of 32 bits of hashes."""
    h = F.xxhash64(F.col("lat").cast("double"), F.col("lon").cast("double"))
    sums = [F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))]
    return grid.groupBy("datetime").agg(F.concat_ws("-", *[c.cast("string") for c in sums]).alias("lattice"))


#: Cells of the index: a lattice's finest have about one point each, each further level has twice the width.
PARTS = 16


def everywhere(points: DataFrame, others: DataFrame, key: str = "lattice") -> DataFrame:
    """Each of `points` with each of `others`, where the result has them all anyway. Both are dealt by parts of `others`, so this is an equi-join."""
    dealt = others.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    return points.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).join(dealt, "__part").drop("__part")


def _extent(lattice: DataFrame) -> DataFrame:
    """lattice, its corner x0, y0 and far corner x1, y1, the width of a finest cell, and the level at which one cell holds all."""
    box = lattice.groupBy("lattice").agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"), F.count("*").alias("n"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = F.greatest(w, h)
    width = F.when(long == 0, 1.0).otherwise(F.greatest(F.sqrt(w * h / F.col("n")), long / F.col("n")))
    return box.withColumn("width", width).withColumn("top", (F.ceil(F.log2(F.greatest(long / F.col("width"), F.lit(1.0)))) + 1).cast("int")).drop("n")


def _cell(v: Column, origin: str) -> Column:
    return F.floor((v - F.col(origin)) / F.col("width")).cast("long")


def _at_level(cell: Column, level: Column) -> Column:
    return F.floor(cell / F.pow(F.lit(2.0), level)).cast("long")


def _nearest(lattice: DataFrame, points: DataFrame) -> DataFrame:
    """Place 0: the least squared distance in degrees; of equal ones the least (lat, lon).

    A station takes some point of the finest cell around it that has one. Nothing farther than that point can be
    nearest, so the points of the cells that its circle meets are all there is to compare: at a level where those are four at
    most, beside one another. Joins are by cell, so the work grows with points and stations, not with their product.
    """
    extent = _extent(lattice)
    placed = lattice.join(extent, "lattice").withColumns({"cx": _cell(F.col("lon"), "x0"), "cy": _cell(F.col("lat"), "y0")})
    level = F.col("level")
    finest = placed.groupBy("lattice", "top", "cx", "cy").agg(F.min(F.struct("lat", "lon")).alias("some"))
    filled = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))).groupBy("lattice", "level", _at_level(F.col("cx"), level).alias("cx"), _at_level(F.col("cy"), level).alias("cy")).agg(F.min("some").alias("some"))
    inside = lambda v, lo, hi: F.least(F.greatest(v, F.col(lo)), F.col(hi))
    own = everywhere(points, extent).withColumns({"px": inside(F.col("s_lon"), "x0", "x1"), "py": inside(F.col("s_lat"), "y0", "y1")})
    seen = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
    seen = seen.withColumns({"cx": _at_level(_cell(F.col("px"), "x0"), level), "cy": _at_level(_cell(F.col("py"), "y0"), level)}).join(filled, ["lattice", "level", "cx", "cy"])
    columns = ["lattice", "station_id", "s_lat", "s_lon", "x0", "y0", "x1", "y1", "px", "py", "width", "top"]
    some = seen.groupBy(*columns).agg(F.min(F.struct("level", "some")).alias("found")).withColumn("some", F.col("found.some"))
    squared = lambda a, b: a * a + b * b
    # A little more than the distance, for what rounding may have taken off.
    reach = squared(F.col("some.lat") - F.col("s_lat"), F.col("some.lon") - F.col("s_lon")) * (1 + 1e-9) + 1e-300
    out_x, out_y = F.col("s_lon") - F.col("px"), F.col("s_lat") - F.col("py")
    half_x, half_y = F.sqrt(F.greatest(reach - out_y * out_y, F.lit(0.0))), F.sqrt(F.greatest(reach - out_x * out_x, F.lit(0.0)))
    pad = 1e-9
    some = some.withColumns(
        {
            "from_x": inside(F.col("s_lon") - half_x * (1 + pad), "x0", "x1"), "to_x": inside(F.col("s_lon") + half_x * (1 + pad), "x0", "x1"),
            "from_y": inside(F.col("s_lat") - half_y * (1 + pad), "y0", "y1"), "to_y": inside(F.col("s_lat") + half_y * (1 + pad), "y0", "y1"),
        }
    )
    wide = F.greatest(F.col("to_x") - F.col("from_x"), F.col("to_y") - F.col("from_y")) / F.col("width")
    some = some.withColumn("level", F.least(F.ceil(F.log2(F.greatest(wide, F.lit(1.0)))).cast("int"), F.col("top")))
    span = lambda a, b, origin: F.explode(F.sequence(_at_level(_cell(F.col(a), origin), level), _at_level(_cell(F.col(b), origin), level)))
    asked = some.select("lattice", "station_id", "s_lat", "s_lon", "level", "y0", "width", "from_y", "to_y", span("from_x", "to_x", "x0").alias("cx"))
    asked = asked.select("lattice", "station_id", "s_lat", "s_lon", "level", "cx", span("from_y", "to_y", "y0").alias("cy"))
    there = placed.join(asked.select("lattice", "level").distinct(), "lattice").select("lattice", "level", _at_level(F.col("cx"), level).alias("cx"), _at_level(F.col("cy"), level).alias("cy"), "lat", "lon")
    far = squared(F.col("lat") - F.col("s_lat"), F.col("lon") - F.col("s_lon")).alias("far")
    best = asked.join(there, ["lattice", "level", "cx", "cy"]).groupBy("lattice", "station_id").agg(F.min(F.struct(far, F.col("lat"), F.col("lon"))).alias("best"))
    return best.select("lattice", "station_id", "best.lat", "best.lon", F.lit(0).alias("place"), F.lit(1.0).alias("share"))


def _between(lattice: DataFrame, points: DataFrame, axis: str) -> DataFrame:
    """lattice, station_id and the axis' lines around each station: the last below it and the first not below it.

    Neighbouring lines are gaps; a gap is known in each of the cells that it meets, a station in its own. A cell is as wide as
    gaps are on average, so all gaps together meet at most twice as many cells as there are lines.
    """
    lo, hi, s = f"{axis}_lo", f"{axis}_hi", F.col(f"s_{axis}")
    lines = lattice.select("lattice", F.col(axis).alias(hi)).distinct()
    extent = lines.groupBy("lattice").agg(F.min(hi).alias("origin"), F.max(hi).alias("end"), F.count("*").alias("n")).where("n > 1")
    extent = extent.select("lattice", "origin", "end", ((F.col("end") - F.col("origin")) / (F.col("n") - 1)).alias("width"))
    gaps = lines.withColumn(lo, F.lag(hi).over(Window.partitionBy("lattice").orderBy(hi))).where(F.col(lo).isNotNull()).join(extent, "lattice")
    gaps = gaps.select("lattice", lo, hi, F.explode(F.sequence(_cell(F.col(lo), "origin"), _cell(F.col(hi), "origin"))).alias("cell"))
    own = everywhere(points.select("station_id", s), extent).where(s.between(F.col("origin"), F.col("end"))).select("lattice", "station_id", s, _cell(s, "origin").alias("cell"))
    return own.join(gaps, ["lattice", "cell"]).where((F.col(lo) < s) & (s <= F.col(hi))).select("lattice", "station_id", s, lo, hi)


def _corners(lattice: DataFrame, points: DataFrame) -> DataFrame:
    """Places 1 to 4: the corners low-low, low-high, high-low, high-high (lat, lon) around a station that has lines on all four sides."""
    box = _between(lattice, points, "lat").join(_between(lattice, points, "lon"), ["lattice", "station_id"])
    y = (F.col("s_lat") - F.col("lat_lo")) / (F.col("lat_hi") - F.col("lat_lo"))
    x = (F.col("s_lon") - F.col("lon_lo")) / (F.col("lon_hi") - F.col("lon_lo"))
    share = [(1 - y) * (1 - x), (1 - y) * x, y * (1 - x), y * x]
    corners = [(a, b) for a in ("lo", "hi") for b in ("lo", "hi")]
    each = [F.struct(F.col(f"lat_{a}").alias("lat"), F.col(f"lon_{b}").alias("lon"), F.lit(i + 1).alias("place"), share[i].alias("share")) for i, (a, b) in enumerate(corners)]
    return box.select("lattice", "station_id", F.explode(F.array(*each)).alias("c")).select("lattice", "station_id", "c.*")


#: Stations, times and places of up to so many rows are broadcast. Beyond it the joins exchange.
STATIONS = 100_000


def _up_to_limit(df: DataFrame) -> int:
    """The number of rows, counted no further than the limit and one."""
    return df.limit(STATIONS + 1).count()


def _dimension(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= STATIONS else df


def outer_on_grid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of one grid, joined where they share time and place, all rows kept."""
    return a.join(b, KEYS, "full_outer")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__no", F.row_number().over(w)).where("__no = 1").drop("__no")
