"""Scene states as archives of named arrays, one archive per key."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {"float": "f4", "double": "f8", "int": "i4", "bigint": "i8"}


def state_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A compressed archive; equal arrays give equal members. Arrays have to be equally long and finite."""
    if len({len(x) for x in arrays.values()}) > 1:
        raise ValueError("arrays of a state have to be equally long")
    for name, x in arrays.items():
        if x.dtype.kind == "f" and not np.isfinite(x).all():
            raise ValueError(f"{name} has numbers that are not finite")
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def state_arrays(data: bytes, names: list[str]) -> dict[str, np.ndarray]:
    """The named arrays of an archive; one that is missing, or holds objects, raises."""
    with np.load(io.BytesIO(data), allow_pickle=False) as archive:
        lacking = [n for n in names if n not in archive.files]
        if lacking:
            raise ValueError(f"state lacks {', '.join(lacking)}")
        return {n: archive[n] for n in names}


def save_states(rows: DataFrame, key: str, row_col: str, fields: dict[str, str]) -> DataFrame:
    """key and state (binary): one archive per key, rows in order. A key's rows meet in one task, so keys are frames or blocks."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by(row_col)
        arrays = {n: part.column(n).to_numpy().astype(KINDS[t]) for n, t in fields.items()}
        return pa.table({key: part.column(key).slice(0, 1), "state": pa.array([state_bytes(arrays)], pa.binary())})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, row_col, *fields).groupBy(key).applyInArrow(run, f"`{key}` {kind}, state binary")


def load_states(states: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows of archives given as (key, bytes): the key, row_idx and the named arrays."""
    key, names = states.columns[0], list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(1)):
                arrays = state_arrays(content.as_py(), names)
                n = len(arrays[names[0]])
                own = batch.column(0).take(pa.array([i] * n, pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(n, dtype=np.int64)), *(pa.array(arrays[x].astype(KINDS[t])) for x, t in fields.items())], names=[key, "row_idx", *names])

    kind = states.schema[key].dataType.simpleString()
    return states.mapInArrow(run, f"`{key}` {kind}, row_idx bigint, " + ", ".join(f"`{n}` {t}" for n, t in fields.items()))
