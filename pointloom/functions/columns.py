"""Column expressions: numbers, vectors, quaternions and hashes. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the zeroth spherical-harmonic basis constant.
SH0 = 0.28209479177387814
# The spherical-harmonic basis constants of degrees 1 to 3.
SH1 = 0.4886025119029199
SH2 = [1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396]
SH3 = [-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435]


def snap(x: Column, digits: int = 6) -> Column:
    """x on a grid of 10**-digits, halves up: equal in engines that sum in another order."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def vector(x: Column, n: int) -> list[Column]:
    """The n components of an array column as doubles."""
    return [F.element_at(x, i + 1).cast("double") for i in range(n)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return total([x * y for x, y in zip(a, b)])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def sigmoid(x: Column, limit: float = 80.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def psnr(mse: Column) -> Column:
    """-10 log10(mse); infinite for equal images."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(F.when(mse > 0, mse)))


def bits(x: Column) -> Column:
    """A text key that differs wherever two arrays of numbers differ in a bit (so -0.0 is not 0.0)."""
    return x.cast("string")


def wrapped(degrees: Column) -> Column:
    """A difference of angles in [-180, 180)."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def unit(q: list[Column]) -> list[Column]:
    n = norm(q)
    return [x / n for x in q]


def rotation_angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two quaternions; q and -q are one rotation."""
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot(unit(a), unit(b))))))


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    w, x, y, z = a
    p, q, r, s = b
    return [w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p]


def rotation_matrix(q: list[Column]) -> list[list[Column]]:
    """3 x 3 matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def matrix_quaternion(m: list[list[Column]]) -> list[Column]:
    """Unit quaternion (w, x, y, z) with w >= 0 of a rotation matrix; its largest part is taken from the diagonal, so no part is divided by a small one."""
    (a, b, c), (d, e, f), (g, h, i) = m
    squares = [1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i]  # four times w, x, y, z squared
    most = F.greatest(*squares)
    forms = [
        [most, h - f, c - g, d - b],
        [h - f, most, b + d, c + g],
        [c - g, b + d, most, f + h],
        [d - b, c + g, f + h, most],
    ]
    out = []
    for k in range(4):
        part = F.when(squares[0] == most, forms[0][k]).when(squares[1] == most, forms[1][k]).when(squares[2] == most, forms[2][k]).otherwise(forms[3][k])
        out.append(part / (2 * F.sqrt(most)))
    sign = F.when(out[0] < 0, -1.0).otherwise(1.0)
    return [x * sign for x in out]


def covariance(q: list[Column], log_scale: list[Column]) -> dict[str, Column]:
    """Upper triangle of R S S' R' for scales exp(log_scale)."""
    r, s = rotation_matrix(q), [F.exp(2 * x) for x in log_scale]
    return {f"c{i}{j}": total([r[i][k] * r[j][k] * s[k] for k in range(3)]) for i in range(3) for j in range(i, 3)}


def sh_color(coefficients: list[Column], d: list[Column], degree: int) -> Column:
    """Spherical-harmonic sum over (degree + 1)**2 coefficients in the unit direction d, for degrees 0 to 3."""
    x, y, z = d
    basis = [F.lit(SH0)]
    if degree > 0:
        basis += [-SH1 * y, SH1 * z, -SH1 * x]
    if degree > 1:
        basis += [SH2[0] * x * y, SH2[1] * y * z, SH2[2] * (2 * z * z - x * x - y * y), SH2[3] * x * z, SH2[4] * (x * x - y * y)]
    if degree > 2:
        basis += [
            SH3[0] * y * (3 * x * x - y * y),
            SH3[1] * x * y * z,
            SH3[2] * y * (4 * z * z - x * x - y * y),
            SH3[3] * z * (2 * z * z - 3 * x * x - 3 * y * y),
            SH3[4] * x * (4 * z * z - x * x - y * y),
            SH3[5] * z * (x * x - y * y),
            SH3[6] * x * (x * x - 3 * y * y),
        ]
    return total([b * c for b, c in zip(basis, coefficients)])


def focal_length(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def field_of_view(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def quantization_step(peak: Column, width: int) -> Column:
    """Step of signed numbers of `width` bits whose largest magnitude is peak; 1 if all are zero."""
    return F.when(peak == 0, 1.0).otherwise(peak / float(2 ** (width - 1) - 1))


def quantized(x: Column, step: Column) -> Column:
    return F.rint(x / step).cast("int")


def packed_bytes(n: Column, width: int) -> Column:
    return F.ceil(n * width / 8).cast("bigint")


def index_bytes(changed: Column, rows: Column) -> Column:
    """Bytes of an index of changed rows: none if dense, else ids of 4 bytes or a bit mask, whichever is less."""
    mask = F.ceil(rows / 8)
    return F.when(changed == rows, F.lit(0)).when(4 * changed < mask, 4 * changed).otherwise(mask).cast("bigint")


def index_kind(changed: Column, rows: Column) -> Column:
    return F.when(changed == rows, "dense").when(4 * changed < F.ceil(rows / 8), "ids").otherwise("mask")


def safe_path(path: Column) -> Column:
    """Relative, without parent steps or backslashes, and not the folder itself."""
    return ~path.startswith("/") & ~path.contains("\\") & ~path.rlike(r"(^|/)\.\.(/|$)") & (path != ".") & (path != "")


def aggregate(strategy: str, x: Column, weight: Column | None = None, higher_is_better: bool = False) -> Column:
    """One statistic by name; weighted means leave out rows of weight zero before they multiply, and a negative weight raises."""
    if strategy in ("uniform_mean", "mean"):
        return F.avg(x)
    if strategy == "weighted_mean":
        checked = F.when(weight < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(weight)
        return F.try_divide(F.sum(F.when(checked != 0, x * checked)), F.sum(checked))
    if strategy == "median":
        return F.median(x)
    if strategy == "p95":
        return F.percentile(x, 0.95)
    if strategy in ("worst", "max", "worst_case"):
        return F.min(x) if higher_is_better else F.max(x)
    raise ValueError(f"unknown statistic {strategy}")


def if_complete(x: Column, statistic: Column) -> Column:
    """The statistic, or null where any row of the group lacks x."""
    return F.when(F.count(F.lit(1)) == F.count(x), statistic)
