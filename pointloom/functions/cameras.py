"""Camera expressions: projection, splat footprints, cloud normalisation and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.columns import total


def projection(near: float, far: float, fov_x: Column, fov_y: Column) -> dict[str, Column]:
    """The non-zero entries of a perspective matrix with depth in 0..1."""
    return {"p00": 1 / F.tan(fov_x / 2), "p11": 1 / F.tan(fov_y / 2), "p22": F.lit(far / (far - near)), "p23": F.lit(-far * near / (far - near))}


def transformed(p: list[Column], matrix: list[list[float]]) -> list[Column]:
    """Homogeneous transform of a point; the denominator is kept from zero by 1e-7."""
    h = [total([p[k] * float(row[k]) for k in range(3)]) + float(row[3]) for row in matrix]
    return [x / (h[3] + 1e-7) for x in h[:3]]


def normalised_cloud(p: list[Column], centre: list[Column], size: float = 480.0, drop: float = 0.1, degrees: float = 90.0) -> list[Column]:
    """Centred, scaled, lowered by `drop`, then turned about the x axis."""
    x, y, z = [(a - c) / size for a, c in zip(p, centre)]
    y, c, s = y - drop, math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [x, c * y - s * z, s * y + c * z]


def splat_radius(a: Column, b: Column, c: Column, blur: float = 0.3) -> Column:
    """Three standard deviations along the longer axis of the 2 x 2 covariance [[a, b], [b, c]] + blur."""
    mid = (a + c) / 2 + blur
    return 3 * F.sqrt(mid + F.sqrt(F.greatest(F.lit(0.0), (a - c) * (a - c) / 4 + b * b)))


def splat_alpha(dx: Column, dy: Column, a: Column, b: Column, c: Column, opacity: Column, blur: float = 0.3) -> Column:
    """Opacity times the Gaussian weight at an offset from the centre, at most 0.99."""
    p, q = a + blur, c + blur
    power = -0.5 * (q * dx * dx - 2 * b * dx * dy + p * dy * dy) / (p * q - b * b)
    return F.least(F.lit(0.99), opacity * F.exp(power))


def learning_rate(step: Column, start: float, end: float, steps: int, delay: int = 0, least: float = 1.0) -> Column:
    """Log-linear from start to end, with a sine ramp from `least` over the first `delay` steps."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), step / steps))
    ramp = F.lit(1.0) if not delay else least + (1 - least) * F.sin(math.pi / 2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), step / delay)))
    return ramp * F.exp(math.log(start) * (1 - t) + math.log(end) * t)


def target_width(width: Column, setting: int) -> Column:
    """Width after scaling: a divisor of 1, 2, 4 or 8, -1 for at most 1600, else the setting itself."""
    if setting in (1, 2, 4, 8):
        return F.rint(width / setting).cast("bigint")
    if setting == -1:
        return F.least(width, F.lit(1600)).cast("bigint")
    return F.lit(setting).cast("bigint")


def clear_black(red: Column, green: Column, blue: Column, alpha: Column) -> Column:
    """Alpha with black pixels made transparent."""
    return F.when((red == 0) & (green == 0) & (blue == 0), 0).otherwise(alpha)


def camera_json(number: Column, name: Column, position: list[Column], rotation: list[list[Column]], width: Column, height: Column, fov_x: Column, fov_y: Column) -> Column:
    """A camera as a JSON object: id, name, width, height, position, rotation (rows) and focal lengths in pixels."""
    fields = {
        "id": number,
        "name": name,
        "width": width,
        "height": height,
        "position": F.array(*(x.cast("double") for x in position)),
        "rotation": F.array(*(F.array(*row) for row in rotation)),
        "fx": width / (2 * F.tan(fov_x / 2)),
        "fy": height / (2 * F.tan(fov_y / 2)),
    }
    return F.to_json(F.struct(*(x.alias(n) for n, x in fields.items())))


def eye_and_up(matrix: Column) -> dict[str, Column]:
    """Eye, up and forward of a camera-to-world matrix (rows): its last, second and third columns."""
    return {name: F.array(*(matrix[i][j] for i in range(3))) for name, j in (("eye", 3), ("up", 1), ("forward", 2))}
