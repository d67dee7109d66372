"""PLY point files: a Python data source that reads vertices as rows, and a writer.

    spark.dataSource.register(PlySource)
    spark.read.format("ply").schema("x float, y float, ...").load(path)

Reads ascii and both binary byte orders, scalar properties only, the vertex element only. The
file column is `path`; `row_idx` numbers the vertices of a file. One task reads a range of
rows of a binary file, so large files are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names and sizes of PLY's scalar types.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_SQL = {"i1": "int", "u1": "int", "i2": "int", "u2": "int", "i4": "int", "u4": "bigint", "f4": "float", "f8": "double"}
#: Vertices that one task reads.
SPLIT = 1 << 20


@dataclass
class Header:
    order: str
    rows: int
    fields: list[tuple[str, str]]
    size: int
    comments: list[str]

    @property
    def dtype(self) -> np.dtype:
        sign = ">" if self.order == "binary_big_endian" else "<"
        return np.dtype([(name, sign + kind) for name, kind in self.fields])


def parse_header(data: bytes) -> Header:
    """Header of a PLY file; list properties of the vertex and elements before it are refused."""
    end = data.find(b"end_header\n")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY header")
    order, rows, fields, comments, element = "", -1, [], [], ""
    for line in data[:end].decode("ascii").splitlines()[1:]:
        word = line.split()
        if not word:
            continue
        if word[0] == "format":
            order = word[1]
        elif word[0] in ("comment", "obj_info"):
            comments.append(line.split(" ", 1)[1] if " " in line else "")
        elif word[0] == "element":
            if rows < 0 and word[1] != "vertex":
                raise ValueError("the vertex element has to come first")
            element = word[1]
            rows = int(word[2]) if element == "vertex" else rows
        elif word[0] == "property" and element == "vertex":
            if word[1] == "list":
                raise ValueError("list properties are not supported")
            fields.append((word[2], TYPES[word[1]]))
    if order not in ("ascii", "binary_little_endian", "binary_big_endian") or rows < 0:
        raise ValueError("format or vertex element is missing")
    return Header(order, rows, fields, end + len(b"end_header\n"), comments)


def vertices(data: bytes) -> np.ndarray:
    """All vertices of a PLY file as a structured array."""
    head = parse_header(data)
    if head.order == "ascii":
        body = data[head.size :].split()
        width = len(head.fields)
        if len(body) < head.rows * width:
            raise ValueError("vertex data is truncated")
        table = [tuple(float(x) if k[0] == "f" else int(x) for x, (_, k) in zip(body[i * width : (i + 1) * width], head.fields)) for i in range(head.rows)]
        return np.array(table, head.dtype)
    if len(data) < head.size + head.rows * head.dtype.itemsize:
        raise ValueError("vertex data is truncated")
    return np.frombuffer(data, head.dtype, head.rows, head.size)


def ply_bytes(rows: np.ndarray, comments: tuple[str, ...] = ()) -> bytes:
    """A binary little-endian file of a structured array."""
    names = {"f4": "float", "f8": "double", "i1": "char", "u1": "uchar", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint"}
    lines = ["ply", "format binary_little_endian 1.0", *(f"comment {c}" for c in comments), f"element vertex {len(rows)}"]
    lines += [f"property {names[rows.dtype[n].str[1:]]} {n}" for n in rows.dtype.names]
    little = rows.astype([(n, "<" + rows.dtype[n].str[1:]) for n in rows.dtype.names])
    return ("\n".join(lines) + "\nend_header\n").encode("ascii") + little.tobytes()


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        self.path, self.first, self.count = path, first, count


class PlySource(DataSource):
    """Files that Python can open on every executor (a shared file system); read_ply takes any store."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        with open(self.options["path"], "rb") as file:
            head = parse_header(file.read(1 << 16))
        return "row_idx bigint, " + ", ".join(f"`{n}` {_SQL[k]}" for n, k in head.fields)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], [f.name for f in schema.fields])


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as file:
            head = parse_header(file.read(1 << 16))
        if head.order == "ascii":
            return [_Rows(self.path, 0, head.rows)]
        return [_Rows(self.path, at, min(SPLIT, head.rows - at)) for at in range(0, max(head.rows, 1), SPLIT)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        with open(part.path, "rb") as file:
            head = parse_header(file.read(1 << 16))
            if head.order == "ascii":
                file.seek(0)
                rows = vertices(file.read())
            else:
                file.seek(head.size + part.first * head.dtype.itemsize)
                rows = np.frombuffer(file.read(part.count * head.dtype.itemsize), head.dtype)
        columns = [(np.arange(len(rows)) + part.first if n == "row_idx" else rows[n]).tolist() for n in self.names]
        yield from zip(*columns)


def parse_ply(files: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows of files given as (key, bytes): the key, row_idx and the named vertex fields (name -> Spark type)."""
    import pyarrow as pa

    names, key = list(fields), files.columns[0]
    kinds = {"float": "f4", "double": "f8", "int": "i4", "bigint": "i8"}

    def run(batches):
        for batch in batches:
            for i, content in enumerate(batch.column(1)):
                rows = vertices(content.as_py())
                own = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                arrays = [own, pa.array(np.arange(len(rows), dtype=np.int64)), *(pa.array(rows[n].astype(kinds[fields[n]])) for n in names)]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "row_idx", *names])

    kind = files.schema[key].dataType.simpleString()
    return files.mapInArrow(run, f"`{key}` {kind}, row_idx bigint, " + ", ".join(f"`{n}` {t}" for n, t in fields.items()))


def read_ply(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """path, row_idx and the named vertex fields of many files, from any store.

    A whole file is one row of the binary reader, so each has to fit a task; see PlySource for larger ones.
    """
    return parse_ply(spark.read.format("binaryFile").load(path).select("path", "content"), fields)


def write_ply(rows: DataFrame, key: str, row_col: str, fields: dict[str, str], folder: str) -> DataFrame:
    """key and ply (binary): one file's bytes per key, rows in order; if a folder is given they are saved there by key."""
    import pyarrow as pa

    kinds = {"float": "f4", "double": "f8", "int": "i4"}

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by(row_col)
        out = np.zeros(part.num_rows, [(n, kinds[t]) for n, t in fields.items()])
        for n in fields:
            out[n] = part.column(n).to_numpy()
        return pa.table({key: [part.column(key)[0].as_py()], "ply": pa.array([ply_bytes(out)], pa.binary())})

    kind = rows.schema[key].dataType.simpleString()
    files = rows.select(key, row_col, *fields).groupBy(key).applyInArrow(run, f"`{key}` {kind}, ply binary")
    if folder:
        files.write.mode("overwrite").parquet(folder)
    return files


def grouped(df: DataFrame) -> DataFrame:
    """Flat splat columns as attribute arrays, numbered fields in numeric order: xyz, rotation, scale, opacity, sh."""

    def many(prefix: str) -> list[str]:
        return sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix) :]))

    rest, dc = many("f_rest_"), many("f_dc_")
    keep = [c for c in ("path", "row_idx", "gaussian_id") if c in df.columns]
    return df.select(
        *keep,
        F.array("x", "y", "z").alias("xyz"),
        F.array(*many("rot_")).alias("rotation"),
        F.array(*many("scale_")).alias("scale"),
        "opacity",
        F.array(*(F.array(dc[c], *(rest[c * len(rest) // 3 : (c + 1) * len(rest) // 3])) for c in range(3))).alias("sh"),
    )
