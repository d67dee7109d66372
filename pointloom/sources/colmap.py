"""COLMAP reconstructions (text and binary) and column-major raster files as tables."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Camera models by id, with the number of their parameters.
MODELS = [("SIMPLE_PINHOLE", 3), ("PINHOLE", 4), ("SIMPLE_RADIAL", 4), ("RADIAL", 5), ("OPENCV", 8), ("OPENCV_FISHEYE", 8), ("FULL_OPENCV", 12), ("FOV", 5), ("SIMPLE_RADIAL_FISHEYE", 4), ("RADIAL_FISHEYE", 5), ("THIN_PRISM_FISHEYE", 12)]

CAMERAS = "id bigint, model string, width bigint, height bigint, params array<double>"
IMAGES = "id bigint, qvec array<double>, tvec array<double>, camera_id bigint, name string, xys array<array<double>>, point_ids array<bigint>"
POINTS = "id bigint, xyz array<double>, rgb array<int>, error double"


class _Bytes:
    """A cursor over little-endian records."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        out = struct.unpack_from("<" + layout, self.data, self.at)
        self.at += struct.calcsize("<" + layout)
        return out


def cameras(data: bytes) -> Iterator[dict]:
    """Cameras of a binary file."""
    b = _Bytes(data)
    for _ in range(b.take("Q")[0]):
        camera, model, width, height = b.take("iiQQ")
        name, n = MODELS[model]
        yield {"id": camera, "model": name, "width": width, "height": height, "params": list(b.take(f"{n}d"))}


def images(data: bytes) -> Iterator[dict]:
    """Images of a binary file: names end with a zero byte, then come the 2-D points."""
    b = _Bytes(data)
    for _ in range(b.take("Q")[0]):
        image, *pose, camera = b.take("i7di")
        end = data.index(b"\0", b.at)
        name, b.at = data[b.at : end].decode(), end + 1
        n = b.take("Q")[0]
        flat = b.take("ddq" * n)
        yield {"id": image, "qvec": pose[:4], "tvec": pose[4:], "camera_id": camera, "name": name, "xys": [[flat[3 * i], flat[3 * i + 1]] for i in range(n)], "point_ids": list(flat[2::3])}


def points(data: bytes) -> Iterator[dict]:
    """3-D points of a binary file; tracks are skipped."""
    b = _Bytes(data)
    for _ in range(b.take("Q")[0]):
        point, x, y, z, red, green, blue, error = b.take("QdddBBBd")
        b.at += 8 * b.take("Q")[0]
        yield {"id": point, "xyz": [x, y, z], "rgb": [red, green, blue], "error": error}


def _lines(data: bytes) -> list[str]:
    return [x for x in data.decode().splitlines() if not x.startswith("#")]


def cameras_text(data: bytes) -> Iterator[dict]:
    for line in filter(str.strip, _lines(data)):
        camera, model, width, height, *params = line.split()
        yield {"id": int(camera), "model": model, "width": int(width), "height": int(height), "params": [float(x) for x in params]}


def images_text(data: bytes) -> Iterator[dict]:
    """Two lines for each image; the second one may be empty."""
    rows = _lines(data)
    while rows and not rows[0].strip():
        rows = rows[1:]
    for head, body in zip(rows[::2], rows[1::2] + [""]):
        if not head.strip():
            break
        word, flat = head.split(maxsplit=9), body.split()
        yield {
            "id": int(word[0]),
            "qvec": [float(x) for x in word[1:5]],
            "tvec": [float(x) for x in word[5:8]],
            "camera_id": int(word[8]),
            "name": word[9],
            "xys": [[float(x), float(y)] for x, y in zip(flat[::3], flat[1::3])],
            "point_ids": [int(x) for x in flat[2::3]],
        }


def points_text(data: bytes) -> Iterator[dict]:
    for line in filter(str.strip, _lines(data)):
        word = line.split()
        yield {"id": int(word[0]), "xyz": [float(x) for x in word[1:4]], "rgb": [int(x) for x in word[4:7]], "error": float(word[7])}


def raster(data: bytes) -> np.ndarray:
    """A width&height&channels& header and column-major float32 values, as height x width x channels."""
    width, height, channels, body = data.split(b"&", 3)
    w, h, c = int(width), int(height), int(channels)
    return np.frombuffer(body, "<f4", w * h * c).reshape((w, h, c), order="F").transpose(1, 0, 2)


def _table(spark: SparkSession, path: str, schema: str, binary: Callable, text: Callable) -> DataFrame:
    """One row per record of all files at the path; the suffix tells text from binary."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list((text if name.endswith(".txt") else binary)(content.as_py()))
                for i in range(0, len(rows), 10_000):
                    some = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), *(pa.array([r[n] for r in some], type=_KINDS[k]) for n, k in (x.split(" ", 1) for x in schema.split(", ")))], names=["path", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {schema}")


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, CAMERAS, cameras, cameras_text)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, IMAGES, images, images_text)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, POINTS, points, points_text)


def views(image_rows: DataFrame, camera_rows: DataFrame) -> DataFrame:
    """Images with their camera and its fields of view; the few cameras are left to Spark's size check."""
    own = camera_rows.select(F.col("id").alias("camera_id"), "model", "width", "height", F.element_at("params", 1).alias("fx"), F.when(F.col("model") == "PINHOLE", F.element_at("params", 2)).otherwise(F.element_at("params", 1)).alias("fy"))
    joined = image_rows.join(own, "camera_id")
    return joined.withColumns({"fov_x": 2 * F.atan(F.col("width") / (2 * F.col("fx"))), "fov_y": 2 * F.atan(F.col("height") / (2 * F.col("fy")))})
