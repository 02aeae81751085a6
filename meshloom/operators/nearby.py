"""Points near other points, and the regions that contain them, by equi-joins on grid cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.runtime import Scratch, small

#: Sides of coverage cells are powers of two; each refinement cuts a cell into SPLIT x SPLIT.
SPLIT_BITS = 2
REFINEMENTS = 3
#: Cells of the near join are this many times as wide as the distance.
NEAR_WIDTH = 32
#: A tile has TILE cells a side; where one holds more than TILE_POINTS points, its cells are cut into FINE parts a side.
TILE = 32
TILE_POINTS = 4_096
FINE = 8
#: Cells at least this wide need no look at the extent of the points.
SAFE_WIDTH = 1e-6
#: Cells that a Python worker holds before it hands them on.
COVER_HELD = 100_000
#: Most coverage cells that are broadcast; beyond it the join shuffles.
COVER_ROWS = 500_000


def finite(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


# -- pairs within a distance ------------------------------------------------


def _width(eps: float, points: DataFrame, axes: tuple[str, ...]) -> float:
    """Width of the cells: several distances, but so wide that a cell's number fits a bigint; a tiny ``eps`` reads the extent once."""
    if eps * NEAR_WIDTH >= SAFE_WIDTH:
        return eps * NEAR_WIDTH
    widest = points.agg(F.max(F.greatest(*[F.abs(a) for a in axes]))).first()[0] if points.columns else None
    return max(eps * NEAR_WIDTH, (widest or 1.0) * 2.0**-40, 1e-300)


def _ready(points: DataFrame, point_id: str, scope: str | None, axes: tuple[str, ...]) -> DataFrame:
    at = [F.col(a).cast("double") for a in axes]
    s = F.lit(0) if scope is None else F.col(scope)
    return points.where(finite(*at) & s.isNotNull() & F.col(point_id).isNotNull()).select(s.alias("s"), F.col(point_id).alias("id"), *[a.alias(f"c{i}") for i, a in enumerate(at)])


def _dense_tiles(points: DataFrame, width: float, n: int) -> DataFrame | None:
    """(s, t0, ...): the tiles of TILE cells a side that hold more than TILE_POINTS points; None if there are none.

    The count is combined before its shuffle, so that a tile of any number of points is one row a partition.
    """
    tile = [F.floor(F.floor(F.col(f"c{i}") / width) / TILE).alias(f"t{i}") for i in range(n)]
    dense = points.groupBy("s", *tile).agg(F.count("*").alias("__n")).where(F.col("__n") > TILE_POINTS).drop("__n")
    dense = Scratch(points.sparkSession, "tiles").save(dense, "dense")
    return None if dense.isEmpty() else dense.withColumn("__dense", F.lit(True))


def _near(left: DataFrame, right: DataFrame, eps: float, width: float, n: int, meets: Column | None = None) -> DataFrame:
    """(s, id_a, id_b, d2): each left point goes to its own cell, and each right one to every cell that its ball touches, so that a pair meets once.

    Cells are wide, so that few points have copies; in tiles that hold many left points they are cut into FINE parts a side.
    Cells meet by a hash of their place; a true pair meets in the left point's own cell.
    """
    reach = eps * (1 + 1e-9)
    dense = _dense_tiles(left, width, n)
    axes = range(n)
    fine = width / FINE  # FINE is a power of two: both widths cut a coordinate alike
    key = lambda level: F.xxhash64("s", F.lit(level), *[f"k{i}" for i in axes])

    home = left
    for i in axes:
        home = home.withColumn(f"k{i}", F.floor(F.col(f"c{i}") / width))
    spread = right
    for i in axes:
        c = F.col(f"c{i}")
        # The rounding of c / width may exceed reach for far coordinates; one more ulp-sized margin covers it.
        slack = F.lit(reach) + F.abs(c) * 1e-15
        spread = spread.withColumn(f"k{i}", F.explode(F.sequence(F.floor((c - slack) / width), F.floor((c + slack) / width))))
    if dense is None:
        home, spread = home.withColumn("key", key(0)), spread.withColumn("key", key(0))
    else:
        flags = small(dense)
        tile = lambda df: reduce(lambda d, i: d.withColumn(f"t{i}", F.floor(F.col(f"k{i}") / TILE)), axes, df).join(flags, ["s", *[f"t{i}" for i in axes]], "left")
        home, spread = tile(home), tile(spread)
        for i in axes:
            c = F.col(f"c{i}")
            slack = F.lit(reach) + F.abs(c) * 1e-15
            home = home.withColumn(f"k{i}", F.when(F.col("__dense"), F.floor(c / fine)).otherwise(F.col(f"k{i}")))
            lo = F.greatest(F.floor((c - slack) / fine), F.col(f"k{i}") * FINE)
            hi = F.least(F.floor((c + slack) / fine), F.col(f"k{i}") * FINE + (FINE - 1))
            spread = spread.withColumn(f"k{i}", F.explode(F.when(F.col("__dense"), F.sequence(lo, hi)).otherwise(F.array(f"k{i}"))))
        level = F.when(F.col("__dense"), key(1)).otherwise(key(0))
        home, spread = home.withColumn("key", level), spread.withColumn("key", level)
    home = home.select("key", "s", F.col("id").alias("id_a"), *[F.col(f"c{i}").alias(f"a{i}") for i in axes])
    spread = spread.select("key", F.col("s").alias("__s"), F.col("id").alias("id_b"), *[F.col(f"c{i}").alias(f"b{i}") for i in axes])
    gap = [F.col(f"a{i}") - F.col(f"b{i}") for i in axes]
    d2 = sum((g * g for g in gap[1:]), gap[0] * gap[0])
    both = home.join(spread, "key").where(F.col("s") == F.col("__s"))
    if meets is not None:
        both = both.where(meets)
    return both.select("s", "id_a", "id_b", d2.alias("d2")).where(F.col("d2") <= eps * eps)


def _checked(eps: float) -> None:
    if not eps >= 0 or math.isinf(eps):
        raise ValueError("eps must be a finite number, 0 or more")


def near_pairs(points: DataFrame, eps: float, point_id: str = "node_id", scope: str | None = "mesh_id", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Pairs (id_a < id_b) of points of one ``scope`` at a distance of at most ``eps``, with ``d2``, the squared distance.

    Ids must be unique within ``points``; with ``scope`` None all points are of one.  Each point goes to the cell that holds it and a
    copy to every cell that its ball touches; a pair meets in the cell of
    its smaller id and nowhere else, so nothing has to be deduplicated.  Points
    with a null, NaN or infinite coordinate, a null scope or a null id are in no
    pair.  ``eps`` 0 finds equal points; a negative one is refused.
    """
    _checked(eps)
    p = _ready(points, point_id, scope, axes)
    names = [f"c{i}" for i in range(len(axes))]
    found = _near(p, p, eps, _width(eps, p, tuple(names)), len(axes), F.col("id_a") < F.col("id_b"))
    return found.select("id_a", "id_b", "d2") if scope is None else found.withColumnRenamed("s", scope)


def near_join(left: DataFrame, right: DataFrame, eps: float, left_id: str = "node_id", right_id: str = "node_id", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(id_a, id_b, d2): every left point with every right one at a distance of at most ``eps``; nulls as in :func:`near_pairs`."""
    _checked(eps)
    a, b = _ready(left, left_id, None, axes), _ready(right, right_id, None, axes)
    names = tuple(f"c{i}" for i in range(len(axes)))
    return _near(a, b, eps, max(_width(eps, a, names), _width(eps, b, names)), len(axes)).select("id_a", "id_b", "d2")


# -- regions ----------------------------------------------------------------


def _touches(x0, y0, x1, y1, bx0, by0, bx1, by1):
    """Whether each segment meets each box; boxes in rows, segments in columns."""
    import numpy as np

    lo = np.maximum(np.minimum(x0, x1), bx0) <= np.minimum(np.maximum(x0, x1), bx1)
    lo &= np.maximum(np.minimum(y0, y1), by0) <= np.minimum(np.maximum(y0, y1), by1)
    side = lambda px, py: (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
    s = np.stack([side(bx0, by0), side(bx0, by1), side(bx1, by0), side(bx1, by1)])
    scale = (np.abs(x1 - x0) + np.abs(y1 - y0)) * (np.abs(bx1) + np.abs(by1) + np.abs(x0) + np.abs(y0)) * 1e-12
    return lo & (s.min(0) <= scale) & (s.max(0) >= -scale)


def _classify(shape: str, xs, ys, radius, x0, y0, side):
    """0 outside, 1 boundary, 2 interior, for the cells with corners (x0, y0) and the given side."""
    import numpy as np

    x1, y1 = x0 + side, y0 + side
    if shape == "disc":
        cx, cy = xs[0], ys[0]
        near = np.hypot(np.maximum(np.maximum(x0 - cx, cx - x1), 0), np.maximum(np.maximum(y0 - cy, cy - y1), 0))
        far = np.hypot(np.maximum(np.abs(x0 - cx), np.abs(x1 - cx)), np.maximum(np.abs(y0 - cy), np.abs(y1 - cy)))
        return np.where(near > radius * (1 + 1e-12), 0, np.where(far < radius * (1 - 1e-12), 2, 1))
    if shape == "box":
        a0, a1, b0, b1 = min(xs[0], xs[1]), max(xs[0], xs[1]), min(ys[0], ys[1]), max(ys[0], ys[1])
        out = (x1 < a0) | (x0 > a1) | (y1 < b0) | (y0 > b1)
        return np.where(out, 0, np.where((x0 >= a0) & (x1 <= a1) & (y0 >= b0) & (y1 <= b1), 2, 1))
    px, py = np.asarray(xs), np.asarray(ys)
    qx, qy = np.roll(px, -1), np.roll(py, -1)
    c = lambda v: v[:, None]
    hit = _touches(px, py, qx, qy, c(x0), c(y0), c(x1), c(y1)).any(1)
    mx, my = c(x0 + side / 2), c(y0 + side / 2)
    cross = (py > my) != (qy > my)
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = (cross & (mx < (qx - px) * (my - py) / (qy - py) + px)).sum(1) % 2 == 1
    return np.where(hit, 1, np.where(inside, 2, 0))


def _cover_one(shape, xs, ys, radius, refinements: int):
    """(level, ix, iy, interior) of the cells that cover one region, the places as arrays; the side of a cell is 2**level."""
    import numpy as np

    if xs is None or ys is None or shape not in ("box", "disc", "poly"):
        return
    xs, ys = [math.nan if v is None else float(v) for v in xs], [math.nan if v is None else float(v) for v in ys]
    need = {"box": 2, "disc": 1, "poly": 3}[shape]
    if len(xs) != len(ys) or len(xs) < need or not all(map(math.isfinite, xs + ys)):
        return
    if shape == "disc":
        if radius is None or not math.isfinite(radius) or radius < 0:
            return
        box = (xs[0] - radius, xs[0] + radius, ys[0] - radius, ys[0] + radius)
    else:
        box = (min(xs), max(xs), min(ys), max(ys))
    extent = max(box[1] - box[0], box[3] - box[2], 1e-6)
    # The coarsest level is even, so that all regions share few levels.
    level = SPLIT_BITS * math.ceil(math.log2(extent) / SPLIT_BITS)
    side = 2.0**level
    ix, iy = (a.ravel() for a in np.meshgrid(np.arange(math.floor(box[0] / side), math.floor(box[1] / side) + 1), np.arange(math.floor(box[2] / side), math.floor(box[3] / side) + 1)))
    for depth in range(refinements + 1):
        kind = _classify(shape, xs, ys, radius, ix * side, iy * side, side)
        yield level, ix[kind == 2], iy[kind == 2], True
        ix, iy = ix[kind == 1], iy[kind == 1]
        if depth == refinements:
            yield level, ix, iy, False
            return
        level -= SPLIT_BITS
        side = 2.0**level
        n = 1 << SPLIT_BITS
        ox, oy = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
        ix, iy = (ix[:, None] * n + ox).ravel(), (iy[:, None] * n + oy).ravel()


def cover_regions(regions: DataFrame, region_id: str = "zone_id", refinements: int = REFINEMENTS) -> DataFrame:
    """(region_id, level, ix, iy, interior): grid cells that cover each region.

    Cells inside are kept as coarse as they come, those that the outline crosses
    are cut again, ``refinements`` times; only those of the last cut stay
    boundary cells.  A region of unknown shape, with a null, NaN, too
    few or unequally many corners, or a disc without a radius of 0 or more, has no cells.
    """
    cols = regions.select(F.col(region_id).cast("long").alias("r"), "shape", "xs", "ys", F.col("radius").cast("double").alias("radius"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        names, held, rows = [region_id, "level", "ix", "iy", "interior"], [], 0

        def out() -> pd.DataFrame:
            r, level, ix, iy, interior = zip(*held)
            n = [len(v) for v in ix]
            return pd.DataFrame(dict(zip(names, [np.repeat(r, n), np.repeat(level, n), np.concatenate(ix), np.concatenate(iy), np.repeat(interior, n)])))

        for f in frames:
            for r, shape, xs, ys, radius in f.itertuples(index=False):
                for part in _cover_one(shape, xs, ys, None if radius is None else float(radius), refinements):
                    held.append((r, *part))
                    rows += len(part[1])
                if rows > COVER_HELD:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()

    return cols.mapInPandas(work, f"{region_id} long, level int, ix long, iy long, interior boolean")


def inside(shape: Column, xs: Column, ys: Column, radius: Column, x: Column, y: Column) -> Column:
    """The exact test: box and disc with their border, polygon by the even-odd rule."""
    n = F.size(xs)
    box = x.between(F.least(xs[0], xs[1]), F.greatest(xs[0], xs[1])) & y.between(F.least(ys[0], ys[1]), F.greatest(ys[0], ys[1]))
    disc = (x - xs[0]) * (x - xs[0]) + (y - ys[0]) * (y - ys[0]) <= radius * radius

    def crosses(i: Column) -> Column:
        j = F.when(i == n - 1, F.lit(0)).otherwise(i + 1)
        px, py, qx, qy = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        return F.when((py > y) != (qy > y), x < (qx - px) * (y - py) / (qy - py) + px).otherwise(False)

    poly = F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1
    return F.coalesce(F.when(shape == "box", box).when(shape == "disc", disc).when(shape == "poly", poly), F.lit(False))


def points_in_regions(points: DataFrame, regions: DataFrame, point_id: str = "node_id", region_id: str = "zone_id", x: str = "x", y: str = "y", refinements: int = REFINEMENTS) -> DataFrame:
    """(region_id, point_id) for each point in each region, once if points and regions have unique ids.

    A point looks up its cell of each level that the coverage uses.  A hit in an
    interior cell counts at once; only hits in boundary cells get the exact test.
    The coverage is broadcast up to ``COVER_ROWS`` cells; beyond that the join
    shuffles, and a hot cell is split by adaptive skew handling.  Points with a
    null, NaN or infinite coordinate are in no region.
    """
    spark = points.sparkSession
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    shapes = regions.select(F.col(region_id).cast("long").alias(region_id), "shape", "xs", "ys", F.col("radius").cast("double").alias("radius"))
    cover = Scratch(spark, "cover").save(cover_regions(regions, region_id, refinements), "cells")
    levels = sorted(r[0] for r in cover.select("level").distinct().collect())  # one row a power of two
    if not levels:
        return spark.createDataFrame([], f"{region_id} long, {point_id} {dict(points.dtypes)[point_id]}")
    p = points.where(finite(px, py) & F.col(point_id).isNotNull()).select(F.col(point_id).alias("__id"), px.alias("__x"), py.alias("__y"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("__x") / F.lit(2.0**k)).alias("ix"), F.floor(F.col("__y") / F.lit(2.0**k)).alias("iy")) for k in levels]))
    hits = p.select("__id", "__x", "__y", cells.alias("__c")).select("__id", "__x", "__y", "__c.level", "__c.ix", "__c.iy").join(small(cover, COVER_ROWS), ["level", "ix", "iy"])
    # One branch: the exact test is made only where the cell does not decide.
    exact = inside(F.col("shape"), F.col("xs"), F.col("ys"), F.col("radius"), F.col("__x"), F.col("__y"))
    found = hits.join(small(shapes), region_id).where(F.when(F.col("interior"), True).otherwise(exact))
    return found.select(region_id, F.col("__id").alias(point_id))
