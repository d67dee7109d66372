"""Operator 8: fuzzy line dedup by MinHash.

Lines (split at \\n) are lowered and spaces around them dropped; all windows of `k` characters
(code points) are a line's shingles, a shorter line is one shingle. One-permutation MinHash puts
each shingle's hash into one of 56 bins and keeps the least per bin, empty bins borrow from
the next filled one; 14 bands of 4 bins make candidates (recall over 0.999 at similarity 0.8).
Candidates are verified by the exact Jaccard similarity of their shingle sets (0.8 or more),
and linking.py finds the components. Of each component, exact copies included, the line of the
least (id, place) stays and the rest go, wherever they stand.

Empty lines and lines of spaces are never compared and stay. Null texts stay null and
have no lines. Repeated rows of one id: their lines tie, and the row whose text sorts first
keeps them; rows equal in id and text keep theirs together, as they cannot be told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import U64, free_name, mix, slices
from pointloom.llm.linking import HEAD, bucket_edges, linked, lookup, saved, sketched, sketches, small
from pointloom.session import table

K, BANDS, ROWS, THRESHOLD = 8, 14, 4, 0.8
BINS = BANDS * ROWS
#: Code points hashed at once; a longer line is hashed in pieces.
LONG = 1 << 18
#: Code points of lines that are hashed together, so that the arrays stay in the processor's cache.
TOGETHER = 1 << 15
#: Cells of a line's sketch.
CELLS = 512
_EMPTY = np.uint32(0xFFFFFFFF)


def folded(line: Column) -> Column:
    """The form in which lines are compared."""
    return F.trim(F.lower(line))


def shingles(lines: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all windows of k code points, line of each)."""
    points, sizes = coded(lines)
    windows = np.maximum(sizes - k + 1, 0)
    line = np.repeat(np.arange(len(lines)), windows)
    # A window starts at each of a line's code points but for the last k - 1.
    starts = np.arange(len(line)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(windows) + windows, windows)
    hashes = mix(windowed(points, k)[starts]) if len(starts) else np.zeros(0, U64)
    short = np.flatnonzero((windows == 0) & (sizes > 0)).tolist()
    if short:
        own = np.array([hash_of(lines[i]) for i in short], U64)
        hashes, line = np.concatenate([hashes, own]), np.concatenate([line, np.array(short, np.int64)])
    return hashes, line


def coded(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all lines, length of each)."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    return points, np.array([len(x) for x in lines], np.int64)


def windowed(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive numbers, built from those of halves; as many as there are windows."""
    if k == 1:
        return points
    half = windowed(points, k // 2)
    n = max(len(points) - k + 1, 0)
    out, right = half[:n] * U64(0x9E3779B97F4A7C15), half[k // 2 : k // 2 + n]
    if k > 3:  # code points have no bits beyond the 29th
        more = right >> U64(29)
        more ^= right
        right = more
    out += right
    return out if k % 2 == 0 else out * U64(0xD6E8FEB86659FD93) + points[k - 1 : k - 1 + n]


def hash_of(text: str) -> int:
    from zlib import adler32, crc32

    data = text.encode("utf-8", "surrogatepass")
    return crc32(data) << 32 | adler32(data)


def signatures(lines: list[str], k: int = K, bins: int = BINS) -> np.ndarray:
    """One row of `bins` 32-bit numbers per line, empty bins filled from the next filled ones."""
    out = np.full(len(lines) * bins + 1, _EMPTY, np.uint32)  # the last one is for windows that go beyond their line
    pieces = [(i, x[at : at + LONG + k - 1]) for i, x in enumerate(lines) for at in range(0, max(len(x) - k + 1, 1), LONG)]
    for p, q in slices([len(x) for _, x in pieces], TOGETHER):
        some = [x for _, x in pieces[p:q]]
        points, sizes = coded(some)
        first = np.array([i for i, _ in pieces[p:q]], np.int64) * bins
        hashes = mix(windowed(points, k))
        at = np.repeat(first, sizes)[: len(hashes)]
        at += bin_of(hashes, bins)
        beyond = (np.cumsum(sizes)[:-1, None] - np.arange(1, k)).ravel()
        at[beyond[(beyond >= 0) & (beyond < len(at))]] = len(out) - 1
        np.minimum.at(out, at, hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE))
        short = np.flatnonzero((sizes < k) & (sizes > 0))
        if len(short):
            own = np.array([hash_of(some[i]) for i in short.tolist()], U64)
            at = first[short] + bin_of(own, bins)
            np.minimum.at(out, at, own.astype(np.uint32) & np.uint32(0xFFFFFFFE))
    out = out[:-1].reshape(len(lines), bins)
    gaps = np.flatnonzero((out == _EMPTY).any(axis=1))
    for at in range(0, len(gaps), 256):
        fill(out, gaps[at : at + 256], bins)
    return out


def bin_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each hash, by its highest bits."""
    return (((hashes >> U64(40)) * U64(bins)) >> U64(24)).view(np.int64)


def fill(signs: np.ndarray, rows: np.ndarray, bins: int) -> None:
    """Fills the empty bins of some rows from the next filled ones, around the end; a row without any stays empty.

    A borrowed value is altered by each step, so that it differs from the lender's own.
    """
    own, far = signs[rows], 2 * bins
    lender = np.where(own == _EMPTY, np.int16(far), np.arange(bins, dtype=np.int16))
    lender = np.minimum.accumulate(lender[:, ::-1], axis=1)[:, ::-1]
    lender = np.where(lender == far, lender[:, :1] + np.int16(bins), lender)
    lender[lender >= far] = 0
    steps = np.ones(bins, np.uint32)
    steps[1:] = np.uint32(2654435761)
    steps = np.multiply.accumulate(steps)
    borrowed = np.take_along_axis(own, lender.astype(np.int64) % bins, axis=1) * steps[(lender - np.arange(bins, dtype=np.int16)) % bins]
    signs[rows] = np.where(own == _EMPTY, np.where((own == _EMPTY).all(axis=1)[:, None], _EMPTY, borrowed), own)


def band_keys(signs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per line and band."""
    rows = signs.shape[1] // bands
    parts = signs.reshape(len(signs), bands, rows).astype(U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        nodes, first = np.unique(np.asarray(batch.column(0)), return_index=True)
        lines = batch.column(1).take(pa.array(first)).to_pylist()
        for i, j in slices([len(x) for x in lines], 1 << 18):
            keys = band_keys(signatures(lines[i:j]))
            yield keys.ravel(), np.repeat(nodes[i:j], keys.shape[1])


def sketch(lines: list[str]) -> np.ndarray:
    """Sketches of the lines' shingle sets."""
    out = [np.zeros((0, HEAD + CELLS // 2), np.uint8)]
    for at in range(0, len(lines), 1024):
        for i, j in slices([len(x) for x in lines[at : at + 1024]], TOGETHER):
            key = distinct(lines[at + i : at + j])
            out.append(sketches(key, (key >> U64(53)).astype(np.int64), None, j - i, CELLS))
    return np.concatenate(out)


def distinct(lines: list[str]) -> np.ndarray:
    """Each line's different shingles: 11 bits for the line (of at most 2,048) and 53 of the hash, in order."""
    if len(lines) == 1 and len(lines[0]) > LONG:
        out = np.zeros(0, U64)
        for at in range(0, len(lines[0]) - K + 1, LONG - K + 1):
            out = np.union1d(out, distinct([lines[0][at : at + LONG]]))
        return out
    hashes, line = shingles(lines)
    key = np.sort((line.astype(U64) << U64(53)) | (hashes >> U64(11)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new]


def compare(lines: list[str], threshold: float = THRESHOLD):
    """Exact Jaccard similarities of pairs in two blocks, until all that is connected is known to be."""
    sets: list[set] = []
    for at in range(0, len(lines), 1024):
        for i, j in slices([len(x) for x in lines[at : at + 1024]], TOGETHER):
            key = distinct(lines[at + i : at + j])
            cut = np.searchsorted(key >> U64(53), np.arange(j - i + 1)) if j - i > 1 else [0, len(key)]
            values = (key & U64((1 << 53) - 1)).tolist() if j - i > 1 else key.tolist()
            sets += [set(values[cut[k] : cut[k + 1]]) for k in range(j - i)]

    def block(x: np.ndarray, y: np.ndarray, mask: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros(mask.shape, bool)
        rows_of, columns_of = (labels.copy() for labels in own)  # of the parts that are connected so far
        for p, q in np.argwhere(mask).tolist():
            if rows_of[p] != columns_of[q]:
                a, b = sets[x[p]], sets[y[q]]
                both = len(a & b)
                if both >= threshold * (len(a) + len(b) - both) - 1e-9:
                    out[p, q] = True
                    new, old = rows_of[p], columns_of[q]
                    rows_of[rows_of == old] = new
                    columns_of[columns_of == old] = new
        return out

    return block


def jaccard(a: list[str], b: list[str], threshold: float = THRESHOLD) -> np.ndarray:
    """Whether the exact Jaccard similarity of the shingle sets reaches the threshold, pair by pair."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 2048):
        sizes = [len(x) + len(y) for x, y in zip(a[at : at + 2048], b[at : at + 2048])]
        for i, j in slices(sizes, TOGETHER):
            sets = [distinct(side[at + i : at + j]) for side in (a, b)]
            n = [np.bincount((x >> U64(53)).astype(np.int64), minlength=j - i) for x in sets]
            every = np.sort(np.concatenate(sets))
            both = np.bincount((every[1:][every[1:] == every[:-1]] >> U64(53)).astype(np.int64), minlength=j - i)
            out[at + i : at + j] = both >= threshold * (n[0] + n[1] - both) - 1e-9
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df, with text_col without the lines that go, and n_lines, n_removed (long).

    If df has a column of one of these names, the new one gets underscores after its name (see free_name).
    """
    # (id, hash of the text) names a row; rows equal in both are alike in everything that matters here.
    row = F.xxhash64(F.col(id_col).cast("string"), F.lit("\0"), F.col(text_col)).alias("row")
    # An outer explode, as the optimizer would let a plain one split all texts once more to filter them; no text is without a line.
    lines = (
        df.where(F.col(text_col).isNotNull())
        .select(row, F.col(id_col).alias("id"), F.split(F.col(text_col), "\n").alias("parts"))
        .select("row", "id", F.posexplode_outer("parts").alias("at", "line"))
        .where(F.trim("line") != "")
        .withColumn("line", folded(F.col("line")))
        .select(F.xxhash64("line").alias("node"), "line", "id", "row", "at")
    )
    edges = bucket_edges(lines.select("node", "line"), _sign)
    nodes = saved(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = lines.select("node", F.col("line").alias("text")).join(small(nodes), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    comps = saved(linked(edges, saved(sketched(texts, sketch)), jaccard, compare, THRESHOLD))
    places = saved(lines.select("node", F.struct(F.col("id").isNull().alias("none"), "id", "row", "at").alias("place")))
    # Of each line that occurs twice or has a link: its occurrences, its first one and its component.
    counted = places.groupBy("node").agg(F.count("*").alias("n"))
    wanted = saved(counted.join(small(comps), "node", "left").where("n > 1 or comp is not null"))
    places = saved(lookup(places, wanted, "node", "n"))
    copies = saved(places.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.first("comp").alias("comp")))
    leads = saved(copies.where("comp is not null").groupBy("comp").agg(F.min("first").alias("lead"), F.count("*").alias("m")))
    of_comp = lookup(copies.where("comp is not null"), leads, "comp", "m").select("node", "n", "lead")
    stays = saved(of_comp.union(copies.where("comp is null").select("node", "n", F.col("first").alias("lead"))))
    gone = lookup(places.select("node", "place"), stays, "node", "n").where("place != lead").groupBy(F.col("place.row").alias("row")).agg(F.collect_set("place.at").alias("gone"))
    out = df.select(row, F.struct(*(f"`{x}`" for x in df.columns)).alias("doc")).join(small(saved(gone)), "row", "left")
    parts, text = F.split(F.col("doc")[text_col], "\n"), F.col("doc")[text_col]
    out = out.withColumn("parts", parts).withColumn("kept", F.when(F.col("gone").isNull(), F.lit(None)).otherwise(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone")))
    stay = F.array_join(F.transform("kept", lambda i: F.element_at("parts", i + 1)), "\n")
    columns = [F.when(F.col("gone").isNull(), text).otherwise(stay).alias(x) if x == text_col else F.col("doc")[x].alias(x) for x in df.columns]
    n_lines = F.coalesce(F.when(text.isNotNull(), F.size("parts")), F.lit(0)).cast("bigint")
    n_removed = F.coalesce(F.size("parts") - F.when(F.col("gone").isNotNull(), F.size("kept")), F.lit(0)).cast("bigint")
    return out.select(*columns, n_lines.alias(free_name("n_lines", df.columns)), n_removed.alias(free_name("n_removed", df.columns)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars kept and the digest of the kept text."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
