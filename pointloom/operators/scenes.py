"""Cameras, point clouds and rasters as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import norm, psnr, quaternion_product
from pointloom.session import shared_dir

# Most places in a cell of the first search for neighbours.
FULL_CELL = 64


def camera_spread(cameras: DataFrame, centre: Sequence[str]) -> DataFrame:
    """translate = -(mean centre), radius = 1.1 x the largest distance from it."""
    mean = cameras.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(centre)))
    d = norm([F.col(c) - F.col(f"m{i}") for i, c in enumerate(centre)])
    return cameras.crossJoin(F.broadcast(mean)).agg((1.1 * F.max(d)).alias("radius"), *((-F.first(f"m{i}")).alias(f"t{i}") for i in range(len(centre))))


def _staged(df: DataFrame, name: str, values: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    """The values as columns of their own, so that later expressions refer to them instead of repeating them."""
    return df.withColumns({f"{name}{i}": x for i, x in enumerate(values)}), [F.col(f"{name}{i}") for i in range(len(values))]


def unit_rotations(df: DataFrame, quaternion: Sequence[Column], name: str) -> tuple[DataFrame, list[Column]]:
    """The normalised quaternion as four columns."""
    df, raw = _staged(df, f"{name}raw", quaternion)
    df, n = _staged(df, f"{name}norm", [norm(raw)])
    return _staged(df, name, [x / n[0] for x in raw])


def rotation_residuals(df: DataFrame, a: list[Column], b: list[Column], name: str = "r") -> tuple[DataFrame, list[Column]]:
    """Adds the rotation vector of the principal angle that takes unit a to unit b."""
    df, q = _staged(df, "_q", quaternion_product(b, [a[0], -a[1], -a[2], -a[3]]))
    df, v = _staged(df, "_v", [x * F.when(q[0] < 0, -1.0).otherwise(1.0) for x in q])
    df, n = _staged(df, "_n", [norm(v[1:])])
    df, f = _staged(df, "_f", [F.when(n[0] < 1e-12, F.lit(2.0)).otherwise(2 * F.atan2(n[0], v[0]) / F.when(n[0] > 0, n[0]))])
    return _staged(df, name, [x * f[0] for x in v[1:]])


def apply_residuals(df: DataFrame, vec: list[Column], a: list[Column], name: str = "t") -> tuple[DataFrame, list[Column]]:
    """Adds the unit quaternion of the rotation by vec after unit a."""
    df, angle = _staged(df, "_angle", [norm(vec)])
    df, turn = _staged(df, "_turn", [F.cos(angle[0] / 2), *(x * F.when(angle[0] < 1e-12, F.lit(0.5)).otherwise(F.sin(angle[0] / 2) / F.when(angle[0] > 0, angle[0])) for x in vec)])
    return _staged(df, name, quaternion_product(turn, a))


def orbit_camera(azimuth: Column, elevation: Column, distance: Column) -> dict[str, Column]:
    """Eye on a sphere around the origin and the unit view direction; angles in degrees."""
    az, el = F.radians(azimuth), F.radians(elevation)
    eye = [distance * F.sin(az) * F.cos(el), distance * F.sin(el), distance * F.cos(az) * F.cos(el)]
    return {**{f"eye{i}": x for i, x in enumerate(eye)}, **{f"view{i}": -x / distance for i, x in enumerate(eye)}}


def voxel_downsample(points: DataFrame, axes: Sequence[str], size: float, extra: Sequence[str] = ()) -> DataFrame:
    """Mean of the points (and further columns) of each voxel, counted from the least corner of the cloud."""
    low = points.agg(*(F.min(a).alias(f"_l{i}") for i, a in enumerate(axes)))
    cells = points.crossJoin(F.broadcast(low)).withColumns({f"v{i}": F.floor((F.col(a) - F.col(f"_l{i}")) / size) for i, a in enumerate(axes)})
    return cells.groupBy(*(f"v{i}" for i in range(len(axes)))).agg(F.count("*").alias("points"), *(F.avg(c).alias(c) for c in (*axes, *extra)))


def box_centre(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    return points.agg(*(((F.min(a) + F.max(a)) / 2).alias(f"c_{a}") for a in axes))


def _saved(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def nearest_scale(points: DataFrame, id_col: str, axes: Sequence[str], cell: float, k: int = 3) -> DataFrame:
    """log of the root mean squared distance to the k true nearest neighbours; `found` is under k only if there are no more points.

    Points at one place are one row with a count, so copies make no pairs. The 27 cells around a place hold
    all that lies within one cell size. Where the k-th distance is larger (or fewer are found), the search is
    repeated in cells of twice the size, until one block holds the whole cloud. A point without neighbours,
    or with a null or infinite coordinate, gives no row.
    """
    finite = reduce(lambda x, y: x & y, (F.abs(a) < float("inf") for a in axes))
    points = _saved(points.select(id_col, *axes).where(finite))
    places = _saved(points.groupBy(*axes).agg(F.count("*").alias("_c")))
    n, *ends = places.agg(F.count("*"), *(F.max(F.abs(a)) for a in axes)).first()
    extent = 2 * max((x for x in ends if x is not None), default=0.0)
    grid = [f"_v{i}" for i in range(len(axes))]

    def within(df: DataFrame, size: float) -> DataFrame:
        return df.withColumns({v: F.floor(F.col(a) / size) for v, a in zip(grid, axes)})

    def spread(df: DataFrame) -> DataFrame:
        for v in grid:
            df = df.withColumn(v, F.explode(F.array(*(F.col(v) + d for d in (-1, 0, 1)))))
        return df

    alone = F.col("_c") > k if n > 1 else F.lit(True)
    out = places.where(alone).select(*axes, F.least(F.col("_c") - 1, F.lit(k)).alias("found"), F.lit(0.0).alias("_mean"))
    own = places.where(~alone)
    size = min(cell, extent / (2 * n ** (1 / 3))) if n and extent > 0 else cell
    # A block of full cells has far more places than k, so the fullest one sets the first size.
    while size > extent * 1e-12 and n > FULL_CELL and within(places, size).groupBy(*grid).count().agg(F.max("count")).first()[0] > FULL_CELL:
        size /= 4
    while n > 1:
        left = own.count()
        if not left:
            break
        mine = within(own, size)
        other = within(places, size).select(*grid, *(F.col(a).alias(f"_{a}") for a in axes), F.col("_c").alias("_m"))
        # Spread neighbours keep all pairs of a place in its own cell's task; spreading a small rest is cheaper.
        few = left * 8 < n
        mine, other = (spread(mine), other) if few else (mine, spread(other))
        keys = list(axes) if few else [*grid, *axes]
        apart = reduce(lambda x, y: x | y, (F.col(a) != F.col(f"_{a}") for a in axes))
        d2 = sum(((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) for a in axes), F.lit(0.0))
        w = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        near = mine.join(other, grid).where(apart).withColumn("_d", d2)
        near = near.withColumns({"_n": F.row_number().over(w), "_run": F.sum("_m").over(w)}).where(F.col("_n") <= k)
        used = F.greatest(F.lit(0), F.least(F.col("_m"), k + 1 - F.col("_c") - (F.col("_run") - F.col("_m"))))
        near = near.withColumn("_u", used).where("_u > 0").groupBy(*keys).agg((F.min("_c") - 1 + F.sum("_u")).alias("found"), F.sum(F.col("_u") * F.col("_d")).alias("_sum"), F.max("_d").alias("_far"))
        whole = size >= extent
        # A hair under the cell size, as floor(a / size) is rounded.
        sure = F.lit(whole) | (F.col("found") == k) & (F.sqrt("_far") <= size * (1 - 1e-9))
        near = _saved(near.where(sure).select(*axes, "found", (F.col("_sum") / F.col("found")).alias("_mean")))
        out = out.unionByName(near)
        if whole:
            break
        own = _saved(own.join(near, list(axes), "left_anti"))
        size *= 2
    return points.join(out, list(axes)).where("found > 0").select(id_col, "found", F.log(F.sqrt(F.greatest(F.col("_mean"), F.lit(1e-7)))).alias("log_scale"))


def image_quality(pixels: DataFrame, image: Sequence[str], a: str, b: str) -> DataFrame:
    """mse, psnr, mae and largest difference per image."""
    d = F.col(a) - F.col(b)
    out = pixels.groupBy(*image).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("worst"))
    return out.withColumn("psnr", psnr(F.col("mse")))


def channel_psnr(pixels: DataFrame, image: Sequence[str], channel: str, a: str, b: str) -> DataFrame:
    """The other definition: psnr of each channel, then their mean."""
    per = image_quality(pixels, [*image, channel], a, b)
    return per.groupBy(*image).agg(F.avg("psnr").alias("psnr"))


def silhouettes(pixels: DataFrame, image: Sequence[str], alpha_a: str, alpha_b: str, depth_a: str, depth_b: str, threshold: float = 0.5) -> DataFrame:
    """Overlap of masks (1 if both are empty), false positives and negatives, alpha and depth errors (null without common pixels)."""
    a, b = F.col(alpha_a) > threshold, F.col(alpha_b) > threshold
    da, dd = F.col(alpha_b) - F.col(alpha_a), F.when(a & b, F.col(depth_b) - F.col(depth_a))
    count = lambda x: F.sum(x.cast("bigint"))
    return pixels.groupBy(*image).agg(
        F.coalesce(F.try_divide(count(a & b), count(a | b)), F.lit(1.0)).alias("iou"),
        count(~a & b).alias("false_positive"),
        count(a & ~b).alias("false_negative"),
        F.avg(F.abs(da)).alias("alpha_mae"),
        F.sqrt(F.avg(da * da)).alias("alpha_rmse"),
        F.avg(F.abs(dd)).alias("depth_mae"),
        F.sqrt(F.avg(dd * dd)).alias("depth_rmse"),
    )


def composite(splats: DataFrame, pixel: Sequence[str], order: Sequence[str], alpha: str, colour: str, depth: str, background: float = 0.0) -> DataFrame:
    """Front-to-back compositing per pixel: colour, alpha and mean depth (0 where nothing is seen)."""
    before = Window.partitionBy(*pixel).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    clear = F.coalesce(F.product(1 - F.col(alpha)).over(before), F.lit(1.0))
    seen = splats.withColumn("_w", clear * F.col(alpha))
    out = seen.groupBy(*pixel).agg(F.sum(F.col("_w") * F.col(colour)).alias("_c"), F.sum("_w").alias("alpha"), F.sum(F.col("_w") * F.col(depth)).alias("_d"))
    return out.select(*pixel, (F.col("_c") + (1 - F.col("alpha")) * background).alias("colour"), "alpha", F.when(F.col("alpha") > 1e-8, F.col("_d") / F.col("alpha")).otherwise(0.0).alias("depth"))


def splat_pixels(splats: DataFrame, x: str, y: str, radius: str, width: int, height: int) -> DataFrame:
    """One row per splat and pixel of its clipped box; empty boxes give none."""
    left, right = F.greatest(F.lit(0), F.floor(F.col(x) - F.col(radius))), F.least(F.lit(width - 1), F.ceil(F.col(x) + F.col(radius)))
    top, bottom = F.greatest(F.lit(0), F.floor(F.col(y) - F.col(radius))), F.least(F.lit(height - 1), F.ceil(F.col(y) + F.col(radius)))
    inside = splats.where((left <= right) & (top <= bottom))
    return inside.withColumn("px", F.explode(F.sequence(left, right))).withColumn("py", F.explode(F.sequence(top, bottom)))


def train_test(images: DataFrame, name: str, hold: int = 8) -> DataFrame:
    """Every hold-th image by name is for testing; the window is over one scene's list of names."""
    return images.withColumn("position", (F.row_number().over(Window.orderBy(name)) - 1).cast("bigint")).withColumn("split", F.when(F.col("position") % hold == 0, "test").otherwise("train"))


def ssim(images: DataFrame, id_col: str, a: str, b: str, width: int) -> DataFrame:
    """Mean structural similarity of two rasters (flat arrays in 0..1, one row per image); windows of 11 with zeros beyond the edges."""

    def band(n: int) -> np.ndarray:
        """The blur of n pixels in a row as a matrix."""
        d = np.arange(-5, 6)
        g = np.exp(-(d * d) / 4.5)
        at = np.arange(n)[:, None] - np.arange(n)[None, :]
        return np.where(abs(at) <= 5, np.exp(-(at * at) / 4.5) / g.sum(), 0.0)

    def similarity(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        rows, columns = band(p.shape[1]), band(width)
        blur = lambda m: rows @ m @ columns
        mp, mq = blur(p), blur(q)
        vp, vq, c = blur(p * p) - mp * mp, blur(q * q) - mq * mq, blur(p * q) - mp * mq
        return (((2 * mp * mq + 1e-4) * (2 * c + 9e-4)) / ((mp * mp + mq * mq + 1e-4) * (vp + vq + 9e-4))).mean((1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch))
            sides = [np.asarray(batch.column(k).flatten(), float) for k in (1, 2)]
            sizes = np.asarray(pc.list_value_length(batch.column(1)))
            begins = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                for i in range(0, len(own), 256):
                    some = own[i : i + 256]
                    at = begins[some][:, None] + np.arange(n)[None, :]
                    out[some] = similarity(*(x[at].reshape(len(some), -1, width) for x in sides))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[id_col, "ssim"])

    kind = images.schema[id_col].dataType.simpleString()
    return images.select(id_col, a, b).mapInArrow(run, f"`{id_col}` {kind}, ssim double")
