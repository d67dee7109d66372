"""Operator 10: packing by power-of-two decomposition.

Each document is tokenised, one end id is appended, and its ids are cut into pieces whose
lengths are powers of two: as many of the longest allowed length as fit, then the binary digits
of the rest from high to low. Pieces of equal length share a bucket (the column `length`), and
each piece is a sequence of its own, so no sequence crosses documents and none needs padding.
A training job batches sequences of one bucket.

The plan is a map over the documents' scan without a shuffle. Sequence ids come from the
partition and the row's place in it; they are unique over all pieces. Null and empty texts
have only the end id. Repeated rows are packed once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import arrow_map
from pointloom.llm.tokens import USES, batch_ids, encoder, vocabulary
from pointloom.session import table

#: Characters beyond which a text is encoded in overlapping chunks; memos are faster than the library's offsets.
CHUNK_CHARS = 1 << 16


def lengths(n: int, longest: int = 2048) -> list[int]:
    """The powers of two that n splits into, falling; `longest` is one too and may repeat."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(df: DataFrame, model: str | None = None, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0).

    with_ids adds `ids`, the piece's token ids. `longest` is a power of two.
    """
    if longest & (longest - 1):
        raise ValueError("longest has to be a power of two")
    name, tail = model or vocabulary(), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        memo = encoder(name)
        for batch in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for i, (_, data) in enumerate(batch_ids(batch.column(1), memo, CHUNK_CHARS)):
                data += tail
                n, at = len(data) // 4, 0
                for size in lengths(n, longest):
                    piece = data[4 * at : 4 * (at + size)]
                    rows.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    at += size
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return arrow_map(df, [id_col, text_col], run, schema, USES).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
