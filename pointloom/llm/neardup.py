"""Operator 4: near-duplicate documents by ProbMinHash.

Words (a-z after lowering, digits, all beyond ASCII) make five-word shingles weighted by how
often a text has them; a text of fewer words is one shingle. Each shingle starts a Poisson
process whose rate is its weight: exponential waiting times, each arrival in a random one of 64
registers, and a register keeps the shingle of its first arrival. A process ends early, once
it is later than the latest register of its document. Equal registers estimate the
probability Jaccard similarity; 16 bands of 4 registers make candidates (recall over 0.999 at
0.8), verified by the exact probability Jaccard similarity of the weighted shingles (0.8 or
more, which is the Jaccard similarity where all weights are equal). linking.py finds the
components. Texts of the same words in the same order are one node from the start.

Null texts are not compared. Texts without words are only grouped with equal texts. The group
of a document is named by its least id; ids of repeated rows share a group, a null id names a
group only if all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import ALNUM, U64, arrow_map, grams, joined, mix, released, slices, split_words, texts
from pointloom.llm.lines import band_keys
from pointloom.llm.linking import HEAD, bucket_edges, linked, lookup, saved, sketched, sketches, small
from pointloom.session import table

K, BANDS, ROWS, THRESHOLD = 5, 16, 4, 0.8
REGISTERS = BANDS * ROWS
#: Cells of a text's sketch.
CELLS = 1024


def documents_words(rows: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, where each row's words begin) of slices of the rows."""
    for i, j in slices([len(x) for x in rows]):
        data, begins = joined(rows[i:j])
        starts, _, words = split_words(ALNUM.lower[data], ALNUM)
        yield i, j, words, np.searchsorted(starts, begins)


def sequence_hash(words: np.ndarray, first: np.ndarray, rows: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each row's words in order; of the raw bytes where there are none."""
    sizes = np.diff(first)
    place = (np.arange(len(words)) - np.repeat(first[:-1], sizes)).astype(U64)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(mix(words + mix(place + U64(1))), out=total[1:])
    out = mix((total[first[1:]] - total[first[:-1]]) ^ sizes.astype(U64))
    for k in np.flatnonzero(sizes == 0).tolist():
        own = np.frombuffer(rows[k], np.uint8).astype(U64)
        out[k] = mix(mix(own + mix(np.arange(len(own), dtype=U64))).sum(keepdims=True) + U64(len(own) + 1))[0]
    return out.view(np.int64)


def weighted_shingles(words: np.ndarray, first: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit shingle, row, weight), each pair of row and shingle once, ordered by row."""
    sizes = np.diff(first)
    windows = np.maximum(sizes - k + 1, 0)
    row = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + first[:-1][row]
    g = grams(words, k)[at] if len(row) else np.zeros(0, U64)
    few = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(few):
        g = np.concatenate([g, np.array([grams(words[first[i] : first[i + 1]], int(sizes[i]), seed=int(sizes[i]))[0] for i in few.tolist()], U64)])
        row = np.concatenate([row, few])
    parts = []
    for base in range(0, len(sizes), 1 << 16):
        own = (row >= base) & (row < base + (1 << 16)) if len(sizes) > 1 << 16 else slice(None)
        key, count = np.unique(((row[own] - base).astype(U64) << U64(48)) | (g[own] >> U64(16)), return_counts=True)
        parts.append((key & U64((1 << 48) - 1), (key >> U64(48)).astype(np.int64) + base, count.astype(np.float64)))
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate([x[c] for x in parts]) for c in range(3))  # type: ignore[return-value]


def prob_min_hash(shingle: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """rows x registers 32-bit numbers that name the first arrival; 0xFFFFFFFF for a row without shingles.

    Arrival i of a shingle waits an exponential time that depends on (shingle, i) alone, divided
    by its weight, so heavier shingles arrive earlier in proportion.
    """
    never = U64(0xFFFFFFFFFFFFFFFF)
    best = np.full(rows * registers, never, U64)
    name = mix(shingle)
    active, time, i = np.arange(len(shingle)), np.zeros(len(shingle)), 0
    while len(active):
        i += 1
        x = mix(shingle[active] + U64(i * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active]
        register = (mix(x ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.int64) * registers >> 32
        # Times are positive, so their bits order like the numbers; the low bits carry the name.
        packed = (time.view(U64) & U64(0xFFFFFFFFFF000000)) | (name[active] & U64(0xFFFFFF))
        np.minimum.at(best, row[active] * registers + register, packed)
        last = best.reshape(rows, registers).max(axis=1)
        go = (time.view(U64) & U64(0xFFFFFFFFFF000000)) < last[row[active]]
        active, time = active[go], time[go]
    out = (best & U64(0xFFFFFF)).astype(np.uint32)
    out[best == never] = 0xFFFFFFFF
    return out.reshape(rows, registers)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        rows = texts(batch.column(0))
        for i, j, words, first in documents_words(rows):
            nodes, once = np.unique(sequence_hash(words, first, rows[i:j]), return_index=True)
            some = once[np.diff(first)[once] > 0]
            if len(some) < j - i:  # copies and wordless texts need no signature of their own
                take = np.zeros(j - i, bool)
                take[some] = True
                words = words[np.repeat(take, np.diff(first))]
                sizes = np.diff(first)[take]
                first = np.concatenate([[0], np.cumsum(sizes)])
                nodes = sequence_hash(words, first, [])
            else:
                nodes = sequence_hash(words, first, rows[i:j])
            if len(nodes):
                keys = band_keys(prob_min_hash(*weighted_shingles(words, first), len(nodes)), BANDS)
                yield keys.ravel(), np.repeat(nodes, BANDS)


def signatures(rows: list[str]) -> np.ndarray:
    """Signatures of a list of texts."""
    data = [x.encode() for x in rows]
    parts = [prob_min_hash(*weighted_shingles(words, first), j - i) for i, j, words, first in documents_words(data)]
    return np.concatenate(parts) if parts else np.zeros((0, REGISTERS), np.uint32)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum over shared x of 1 / sum over y of max(a_y / a_x, b_y / b_x), in O(n log n)."""
    x, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0
    wa, wb = a[1][at], b[1][bt]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    ratio = wb / wa
    if ratio.min() == ratio.max():  # max(a_y / a_x, b_y / b_x) = a_y / a_x for all shared y
        return float((wa / (wa.sum() + only_a + only_b / ratio[0])).sum())
    order = np.argsort(ratio, kind="stable")
    ra, rb, rr = wa[order], wb[order], ratio[order]
    ca, cb = np.concatenate([[0], np.cumsum(ra)]), np.concatenate([[0], np.cumsum(rb)])
    # For x of ratio r: a_y / a_x is the larger one exactly for the y of ratio at most r.
    upto = np.searchsorted(rr, rr, side="right")
    total = (ca[upto] + only_a) / ra + (cb[-1] - cb[upto] + only_b) / rb
    return float((1 / total).sum())


def _weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, _, words = split_words(ALNUM.lower[np.frombuffer(text.encode(), np.uint8)], ALNUM)
    shingle, _, weight = weighted_shingles(words, np.array([0, len(words)]))
    return shingle, weight


def similar(a: list[str], b: list[str], threshold: float = THRESHOLD) -> np.ndarray:
    """Whether the exact probability Jaccard similarity reaches the threshold."""
    out = np.zeros(len(a), bool)
    last: tuple[str | None, tuple] = (None, ())
    for i, (x, y) in enumerate(zip(a, b)):
        if x != last[0]:
            last = (x, _weighted(x))
        out[i] = probability_jaccard(last[1], _weighted(y)) >= threshold - 1e-12
    return out


def sketch(rows: list[str]) -> np.ndarray:
    """Sketches of the texts' weighted shingles."""
    out = [np.zeros((0, HEAD + CELLS // 2), np.uint8)]
    for i, j, words, first in documents_words([x.encode() for x in rows]):
        shingle, row, weight = weighted_shingles(words, first)
        out.append(sketches(shingle, row, weight, j - i, CELLS))
    return np.concatenate(out)


def compare(rows: list[str], threshold: float = THRESHOLD):
    """Exact similarities of pairs in two blocks, until all that is connected is known to be."""
    weighted = [_weighted(x) for x in rows]

    def block(x: np.ndarray, y: np.ndarray, mask: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros(mask.shape, bool)
        rows_of, columns_of = (x.copy() for x in own)  # labels of the parts that are connected so far
        for p, q in np.argwhere(mask).tolist():
            if rows_of[p] != columns_of[q] and probability_jaccard(weighted[x[p]], weighted[y[q]]) >= threshold - 1e-12:
                out[p, q] = True
                new, old = rows_of[p], columns_of[q]
                rows_of[rows_of == old] = new
                columns_of[columns_of == old] = new
        return out

    return block


def _named(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(1))
            nodes = [sequence_hash(words, first, rows[i:j]) for i, j, words, first in documents_words(rows)]
            own = pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), own, *([batch.column(1)] if with_text else batch.columns[2:])], names=["id", "node", *(["text"] if with_text else batch.schema.names[2:])])

    return run


def _row(id_col: str, text_col: str) -> Column:
    """Names a row by id and text; rows equal in both are one document."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("\0"), F.col(text_col))


def _labelled(df: DataFrame, id_col: str, text_col: str, rows: bool = False) -> DataFrame:
    """id and component of each row that has a text, and with `rows` the row's name."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.where(F.col(text_col).isNotNull())
    edges = bucket_edges(docs.select(text_col), _sign)
    nodes = saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    more = [_row(id_col, text_col).alias("row")] if rows else []
    named = saved(arrow_map(docs, [F.col(id_col).alias("id"), text_col, *more], _named(False), f"id {kind}, node bigint{', row bigint' if rows else ''}"))
    # One row of each node lends its text.
    lenders = saved(named.join(small(nodes), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select(F.col("id").alias("own")).distinct())
    # The ids are checked again by hash, as an id may have several rows.
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = held.join(small(lenders), F.col("id").eqNullSafe(F.col("own")), "left_semi")
    own_texts = held.mapInArrow(released(_named(True)), f"id {kind}, node bigint, text string").join(small(nodes), "node", "left_semi")
    own_texts = saved(sketched(own_texts.groupBy("node").agg(F.first("text").alias("text")), sketch))
    comps = saved(linked(edges, own_texts, similar, compare, THRESHOLD))
    return named.join(small(comps), "node", "left").select("id", F.coalesce("comp", "node").alias("comp"), *(["row"] if rows else []))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, group_id (the least id of its group; its own where it has no duplicates), n_group (rows in it)."""
    labelled = saved(_labelled(df, id_col, text_col))
    groups = saved(labelled.groupBy("comp").agg(F.min("id").alias("group_id"), F.count("*").alias("n_group")).where("n_group > 1"))
    out = labelled.join(small(groups), "comp", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_group", F.lit(1)).cast("bigint").alias("n_group"))
    rest = df.where(F.col(text_col).isNull()).select(F.col(id_col).alias("id"), F.col(id_col).alias("group_id"), F.lit(1).cast("bigint").alias("n_group"))
    return out.union(rest).withColumnRenamed("id", id_col)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df, one document of each group: that of the least id, null last.

    Rows that share id and text are one document, of which one row stays; null texts all stay. Documents
    are told apart by id and text, so that another text under the same id, or a null id, is decided on its own.
    """
    found = saved(_labelled(df, id_col, text_col, rows=True))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    leads = saved(found.groupBy("comp").agg(F.min(place).alias("lead"), F.count("*").alias("n")).where("n > 1").select("comp", F.col("lead.row").alias("lead"), "n"))
    copies = saved(lookup(found.select("comp", "row"), leads, "comp", "n").groupBy("row").agg(F.first(F.col("row") != F.col("lead")).alias("goes"), F.count("*").alias("n")).where("goes or n > 1"))
    # A row whose name occurs once and leads its group has no entry; of a name that occurs several times and leads, one row stays.
    rows = df.select(_row(id_col, text_col).alias("row"), F.struct(*(f"`{x}`" for x in df.columns)).alias("doc"))
    kept = rows.join(small(copies), "row", "left_anti")
    repeated = saved(copies.where("not goes").select("row"))
    if not repeated.isEmpty():
        once = rows.join(small(repeated), "row", "left_semi").groupBy("row").agg(F.first("doc").alias("doc"))
        kept = kept.unionByName(once)
    return kept.select(*(F.col("doc")[x].alias(x) for x in df.columns))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
