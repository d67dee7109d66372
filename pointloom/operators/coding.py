"""Coding of attributes: quantisation, packing, sparse and temporal predictions, packets."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.columns import bits, quantization_step

# The marks that begin a packet and a container.
PACKET_MAGIC, CONTAINER_MAGIC = b"CPGAUS01", b"CPSEG1\n"


def quantize(rows: DataFrame, value: str, width: int, groups: Sequence[str] = ()) -> DataFrame:
    """Adds q, step and decoded. The step follows the largest magnitude of the group (of all rows if none is named)."""
    peak = rows.groupBy(*groups).agg(F.max(F.abs(F.col(value).cast("double"))).alias("_peak"))
    out = rows.join(F.broadcast(peak), list(groups)) if groups else rows.crossJoin(F.broadcast(peak))
    step = quantization_step(F.col("_peak"), width)
    out = out.withColumn("step", step).withColumn("q", F.rint(F.col(value).cast("double") / F.col("step")).cast("int"))
    return out.withColumn("decoded", (F.col("q") * F.col("step")).cast("float")).drop("_peak")


def pack_signed(values: np.ndarray, width: int) -> bytes:
    """Two's complement numbers of `width` bits, least significant bit first, without gaps."""
    numbers = values.astype(np.int64) & ((1 << width) - 1)
    return np.packbits(((numbers[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_signed(data: bytes, n: int, width: int) -> np.ndarray:
    """The n numbers that pack_signed has packed; raises if the size is not theirs."""
    if len(data) != -(-n * width // 8):
        raise ValueError("packed size does not fit")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width).astype(np.int64)
    numbers = (flat << np.arange(width)).sum(axis=1)
    return np.where(numbers >> (width - 1) & 1, numbers - (1 << width), numbers).astype(np.int32)


def pack_column(rows: DataFrame, id_col: str, numbers: str, width: int, level: int = 6) -> DataFrame:
    """id, n, packed_bytes, coded (zlib of the packed array) and whether unpacking gives the numbers back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, coded, same = [], [], [], []
            for x in batch.column(1):
                own = np.array(x.as_py() or [], np.int32)
                packed = pack_signed(own, width)
                data = zlib.compress(packed, level)
                n.append(len(own))
                sizes.append(len(packed))
                coded.append(data)
                same.append(bool((unpack_signed(inflate(data, len(packed)), len(own), width) == own).all()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), pa.array(coded, pa.binary()), pa.array(same, pa.bool_())], names=[id_col, "n", "packed_bytes", "coded", "same"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, numbers).mapInArrow(run, f"`{id_col}` {kind}, n bigint, packed_bytes bigint, coded binary, same boolean")


def inflate(data: bytes, size: int) -> bytes:
    """zlib data of a known size; truncated and trailing data raise."""
    own = zlib.decompressobj()
    out = own.decompress(data)
    if not own.eof or own.unused_data or len(out) != size:
        raise ValueError("compressed data is truncated or has a tail")
    return out


def half_floats(values: np.ndarray) -> bytes:
    """Little-endian float16; values beyond its range raise."""
    with np.errstate(over="ignore"):
        out = values.astype("<f2")
    if not np.isfinite(out).all():
        raise ValueError("value does not fit float16")
    return out.tobytes()


def packet(header: dict, streams: dict[str, bytes], level: int = 6) -> bytes:
    """Magic, header length, canonical JSON header with stream places, zlib body, SHA-256 of all before."""
    at, places = 0, {}
    for name in streams:
        places[name] = [at, len(streams[name])]
        at += len(streams[name])
    body = b"".join(streams.values())
    text = json.dumps({**header, "streams": places, "raw_bytes": len(body), "body_sha256": hashlib.sha256(body).hexdigest()}, sort_keys=True, separators=(",", ":")).encode()
    data = PACKET_MAGIC + struct.pack("<Q", len(text)) + text + zlib.compress(body, level)
    return data + hashlib.sha256(data).digest()


def read_packet(data: bytes) -> tuple[dict, dict[str, bytes]]:
    """Header and streams of a packet; any damage raises."""
    if data[:8] != PACKET_MAGIC or hashlib.sha256(data[:-32]).digest() != data[-32:]:
        raise ValueError("packet is damaged")
    size = struct.unpack("<Q", data[8:16])[0]
    header = json.loads(data[16 : 16 + size])
    body = inflate(data[16 + size : -32], header["raw_bytes"])
    if hashlib.sha256(body).hexdigest() != header["body_sha256"]:
        raise ValueError("body is damaged")
    return header, {name: body[at : at + n] for name, (at, n) in header["streams"].items()}


def container(members: list[tuple[str, bytes]]) -> bytes:
    """Magic, index length, JSON index with running offsets, and the members' bytes."""
    index, at = [], 0
    for name, data in members:
        index.append({"id": name, "offset": at, "length": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        at += len(data)
    text = json.dumps({"members": index}, sort_keys=True, separators=(",", ":")).encode()
    return CONTAINER_MAGIC + struct.pack("<Q", len(text)) + text + b"".join(x for _, x in members)


def container_index(data: bytes) -> tuple[list[dict], int]:
    """The index and where the members begin."""
    if not data.startswith(CONTAINER_MAGIC):
        raise ValueError("not a container")
    size = struct.unpack("<Q", data[7:15])[0]
    if size > 64 << 20 or 15 + size > len(data):
        raise ValueError("index is too long")
    return json.loads(data[15 : 15 + size])["members"], 15 + size


def container_member(data: bytes, name: str) -> bytes:
    """One member, checked by its digest."""
    index, base = container_index(data)
    own = next((x for x in index if x["id"] == name), None)
    if own is None:
        raise KeyError(name)
    out = data[base + own["offset"] : base + own["offset"] + own["length"]]
    if hashlib.sha256(out).hexdigest() != own["sha256"]:
        raise ValueError(f"{name} is damaged")
    return out


def write_containers(members: DataFrame, keys: Sequence[str], position: str, id_col: str, data: str) -> DataFrame:
    """keys and the container (binary) of each group's members in order; a group is one segment, so it is small."""
    kinds = ", ".join(f"`{k}` {members.schema[k].dataType.simpleString()}" for k in keys)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by(position)
        out = container([(str(a), b) for a, b in zip(part.column(id_col).to_pylist(), part.column(data).to_pylist())])
        return pa.table({**{k: [part.column(k)[0].as_py()] for k in keys}, "container": pa.array([out], pa.binary())})

    return members.select(*keys, position, id_col, data).groupBy(*keys).applyInArrow(run, f"{kinds}, container binary")


def read_containers(containers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and each member's id, offset, length, digest and bytes, all checked."""
    kinds = ", ".join(f"`{k}` {containers.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, x in enumerate(batch.column(len(keys))):
                for m in container_index(x.as_py())[0]:
                    rows.append(i)
                    out.append({**m, "data": container_member(x.as_py(), m["id"])})
            at = pa.array(rows, pa.int64())
            names = ("id", "offset", "length", "sha256", "data")
            kind = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *(pa.array([x[n] for x in out], t) for n, t in zip(names, kind))], names=[*keys, *names])

    return containers.select(*keys, "container").mapInArrow(run, f"{kinds}, id string, offset bigint, length bigint, sha256 string, data binary")


def sparse_changes(target: DataFrame, parent: DataFrame, id_col: str, values: Sequence[str]) -> DataFrame:
    """Rows to send: new ones, and those that differ from the parent in any bit."""
    own = parent.select(id_col, *(F.col(v).alias(f"_{v}") for v in values))
    both = target.select(id_col, *values).join(own.withColumn("_there", F.lit(True)), id_col, "left")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~bits(F.col(v)).eqNullSafe(bits(F.col(f"_{v}")))
    new = F.col("_there").isNull()
    return both.where(new | differs).select(id_col, *values, new.alias("is_new"))


def apply_changes(parent: DataFrame, changes: DataFrame, id_col: str, values: Sequence[str]) -> DataFrame:
    """The parent's rows with the sent values in place, and the new rows."""
    sent = changes.select(id_col, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_sent"))
    both = parent.select(id_col, *values).join(sent, id_col, "full_outer")
    return both.select(id_col, *(F.when(F.col("_sent"), F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values))


def closed_loop(sequence: DataFrame, keys: Sequence[str], frame: str, value: str, step: float) -> DataFrame:
    """Temporal prediction from the *decoded* frame before: q, decoded and error per frame.

    The state runs through an ordered fold of one sequence, in the JVM.
    """
    ordered = sequence.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(value).cast("double").alias("v")))).alias("xs"))
    zero = F.lit(None).cast("array<struct<f:bigint,v:double,q:bigint,decoded:double>>")
    start = F.coalesce(zero, F.array().cast("array<struct<f:bigint,v:double,q:bigint,decoded:double>>"))

    def carry(done: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["decoded"], F.lit(0.0))
        q = F.rint((x["v"] - before) / step).cast("bigint")
        return F.concat(done, F.array(F.struct(x["f"].cast("bigint").alias("f"), x["v"].alias("v"), q.alias("q"), (before + q * step).alias("decoded"))))

    out = ordered.select(*keys, F.explode(F.aggregate("xs", start, carry)).alias("r"))
    return out.select(*keys, F.col("r.f").alias(frame), F.col("r.q").alias("q"), F.col("r.decoded").alias("decoded"), F.abs(F.col("r.v") - F.col("r.decoded")).alias("error"))


def open_loop(sequence: DataFrame, keys: Sequence[str], frame: str, value: str, step: float) -> DataFrame:
    """The control: residuals against the original frame before, whose errors add up."""
    w = Window.partitionBy(*keys).orderBy(frame)
    residual = F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))
    return sequence.withColumn("q", F.rint(residual / step).cast("bigint"))


def state_digest(state: DataFrame, groups: Sequence[str], row_col: str, columns: Sequence[str]) -> DataFrame:
    """A digest of each group's rows that depends on their values' bits and their order.

    Rows are hashed first and only the hashes are brought together.
    """
    row = F.sha2(F.concat_ws("|", F.col(row_col).cast("string"), *(bits(F.col(c)) for c in columns)), 256)
    return state.select(*groups, row_col, row.alias("_h")).groupBy(*groups).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row_col, "_h"))), lambda x: x["_h"]), ""), 256).alias("digest"))


def serialized_sizes(changes: DataFrame, configurations: DataFrame) -> DataFrame:
    """Bytes of each stream under each configuration (layout, width): values and index.

    changes has owner, attribute, components, rows and changed. Layout dense sends all rows,
    ids an id of 4 bytes per changed row, sparse the shorter of ids and a bit mask, base nothing
    for rows that did not change and no index, as the row set is known.
    """
    sent = F.when(F.col("layout") == "dense", F.col("rows")).otherwise(F.col("changed"))
    mask = F.ceil(F.col("rows") / 8)
    index = F.when(F.col("layout") == "ids", 4 * F.col("changed")).when(F.col("layout") == "sparse", F.when(F.col("changed") == F.col("rows"), 0).otherwise(F.least(4 * F.col("changed"), mask))).otherwise(0)
    out = changes.crossJoin(F.broadcast(configurations))
    return out.withColumns({"value_bytes": F.ceil(sent * F.col("components") * F.col("width") / 8).cast("bigint"), "index_bytes": index.cast("bigint")})


def labelled(members: DataFrame, frame: str, attribute: str, stable: Column) -> DataFrame:
    """Stream names of per-frame packets (attribute and frame), the attribute itself, and whether ids stay the same."""
    return members.withColumns({"stream": F.concat(F.lit(f"{attribute}_frame"), F.col(frame).cast("string")), "attribute": F.lit(attribute), "stable": stable})
