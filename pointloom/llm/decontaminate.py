"""Operator 2: benchmark decontamination by winnowing.

Words are hashed, every five consecutive words make a k-gram, and of each sliding window of
six k-grams the minimum is kept (all equal minima, on both sides alike). A span of ten shared
words covers six shared k-grams, so both sides keep the same minimum inside it: no shared
window of ten words can be missed. The test fingerprints are sorted once, sent to the
executors, and each document's fingerprints are looked up in them. A hit is extended to the
at most six windows of ten words that contain its k-gram; each is compared with the item
windows by hash and then word by word. A document word inside any item window is hit.

Items of one to nine words are one window each; for every such length that occurs, documents
keep all their grams of that length.

The benchmark is read in blocks of at most `block_bytes` of text, and one block at a time is
broadcast; the usual benchmark is a single block and the plan is then a map over the
documents' scan. With several blocks, the hits so far travel with the rows and are
checkpointed after each block.

Null or empty texts have no words, and are clean; a null item has no windows. Repeated
document rows are reported once each, repeated items count once per id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import ALNUM, U64, arrow_map, found, grams, joined, mix, released, slices, split_words, texts
from pointloom.session import shared_dir, table

WINDOW, K, BLOCK_BYTES = 10, 5, 8 << 20
#: Hashes whose windows a task remembers.
KNOWN = 100_000


def sorted_once(x: np.ndarray) -> np.ndarray:
    """The different values in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def kept(g: np.ndarray, w: int) -> np.ndarray:
    """Which k-grams are the minimum of a window of w consecutive ones."""
    n = len(g) - w + 1
    if n <= 0:
        return np.ones(len(g), bool)
    low = g[:n].copy()
    for j in range(1, w):
        np.minimum(low, g[j : j + n], out=low)
    high = np.zeros(len(g), U64)
    for j in range(w):
        np.maximum(high[j : j + n], low, out=high[j : j + n])
    return high == g


class Fingerprints:
    """One block of test items in flat arrays: fingerprints, the items' words, and their windows by length.

    About six times as large as the items' text, whatever they hold.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k = window, k
        self.names = [name for name, _ in items]
        data, begins = joined([text for _, text in items])
        data = ALNUM.lower[data]
        s, e, h = split_words(data, ALNUM)
        self.raw, self.starts, self.ends = data.tobytes(), s.astype(np.int32), e.astype(np.int32)
        self.first = np.searchsorted(s, begins)  # the first word of each item
        sizes = np.diff(self.first)
        prints = [np.zeros(0, U64)]
        for i in np.flatnonzero(sizes >= window).tolist():
            g = grams(h[self.first[i] : self.first[i + 1]], k)
            prints.append(g[kept(g, window - k + 1)])
        self.prints = sorted_once(np.concatenate(prints))
        #: By length: the windows' hashes in order, and the first word of each.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted_once(np.minimum(sizes[sizes > 0], window)).tolist():
            some = np.flatnonzero(sizes >= window if n == window else sizes == n)
            counts = sizes[some] - n + 1
            at = np.arange(counts.sum()) + np.repeat(self.first[some] - (np.cumsum(counts) - counts), counts)
            keys = grams(h, n, seed=n)[at]
            order = np.argsort(keys, kind="stable")
            self.windows[n] = keys[order], at[order].astype(np.int32)
        self.coarse = np.zeros(1 << 16, bool)
        self.coarse[(self.prints >> U64(48)).astype(np.int64)] = True
        self.known: dict[tuple[int, int], dict[bytes, list[str]]] = {}

    def spelled(self, n: int, key: int) -> dict[bytes, list[str]]:
        """The windows of a hash, word by word, and the items that hold them; kept for the next hit."""
        out = self.known.get((n, key))
        if out is None:
            keys, at = self.windows[n]
            lo, hi = np.searchsorted(keys, np.array([key], U64), "left")[0], np.searchsorted(keys, np.array([key], U64), "right")[0]
            found_in: dict[bytes, set[str]] = {}
            for i, item in zip(at[lo:hi].tolist(), (np.searchsorted(self.first, at[lo:hi], "right") - 1).tolist()):
                words = b" ".join([self.raw[a:b] for a, b in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist())])
                found_in.setdefault(words, set()).add(self.names[item])
            out = {words: sorted(names) for words, names in found_in.items()}
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[n, key] = out
        return out

    def candidates(self, h: np.ndarray, n: int) -> np.ndarray:
        """Starts of the windows of n words that may be item windows, rising."""
        if len(h) < n:
            return np.zeros(0, np.int64)
        if n < self.window:
            return np.arange(len(h) - n + 1)
        g = grams(h, self.k)
        own = np.flatnonzero(kept(g, n - self.k + 1))
        own = own[self.coarse[(g[own] >> U64(48)).astype(np.int64)]]
        own = own[found(self.prints, g[own]) >= 0]
        if not len(own):
            return own
        near = sorted_once((own[:, None] - np.arange(n - self.k + 1)[None, :]).ravel())
        return near[(near >= 0) & (near + n <= len(h))]

    def hits(self, raw: bytes, s: np.ndarray, e: np.ndarray, h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, item ids) of each item window that occurs inside one document."""
        for n, (keys, _) in self.windows.items():
            at = self.candidates(h, n)
            at = at[doc[at] == doc[at + n - 1]] if len(at) else at
            if not len(at):
                continue
            x = np.full(len(at), n, U64)
            for j in range(n):
                x = x * U64(0xD6E8FEB86659FD93) + h[at + j]
            x = mix(x)
            ok = found(keys, x) >= 0
            for i, key in zip(at[ok].tolist(), x[ok].tolist()):
                names = self.spelled(n, key).get(b" ".join([raw[a:b] for a, b in zip(s[i : i + n].tolist(), e[i : i + n].tolist())]))
                if names:
                    yield i, n, names


def _scan(block, cumulative: bool):
    """Batches of (id, text[, hit words, items so far]) -> the same with this block's hits added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: Fingerprints = block.value
        for batch in batches:
            rows = texts(batch.column(1))
            words, hit, names = [0] * len(rows), [[] for _ in rows], [[] for _ in rows]
            for i, j in slices([len(x) for x in rows]):
                data, begins = joined(rows[i:j])
                data = ALNUM.lower[data]
                s, e, h = split_words(data, ALNUM)
                first = np.searchsorted(s, begins)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                marks, own = np.zeros(len(h) + 1, np.int32), {}
                for at, n, found_names in prints.hits(data.tobytes(), s, e, h, doc):
                    marks[at] += 1
                    marks[at + n] -= 1
                    own.setdefault(int(doc[at]), set()).update(found_names)
                inside = np.cumsum(marks[:-1]) > 0
                for k in range(j - i):
                    words[i + k] = int(first[k + 1] - first[k])
                    if k in own:
                        hit[i + k] = np.flatnonzero(inside[first[k] : first[k + 1]]).tolist()
                        names[i + k] = sorted(own[k])
            if cumulative:
                hit = [sorted({*a, *b}) for a, b in zip(hit, batch.column(2).to_pylist())]
                names = [sorted({*a, *b}) for a, b in zip(names, batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=["id", "text", "hit", "items"])
            else:
                digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(words, pa.int64()), pa.array([len(x) for x in hit], pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digest), pa.array([bool(x) for x in hit], pa.bool_())],
                    names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return run


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in lists of at most `block_bytes` of text each (an item longer than that is alone)."""
    rows, total = [], 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        data = text.encode()
        if rows and total + len(data) > block_bytes:
            yield rows
            rows, total = [], 0
        rows.append((name or "", data))
        total += len(data)
    yield rows


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    todo, many = None, False
    for rows in blocks(benchmark, item_col, item_text, block_bytes):
        if todo is not None:
            if not many:
                shared_dir(spark)
                df, many = df.withColumns({"hit": F.expr("cast(array() as array<bigint>)"), "items": F.expr("cast(array() as array<string>)")}), True
            df = df.mapInArrow(_scan(todo, True), f"id {kind}, text string, hit array<bigint>, items array<string>").checkpoint()
        todo = spark.sparkContext.broadcast(Fingerprints(rows))
    if not many:
        return arrow_map(df, ["id", "text"], _scan(todo, False), f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean").withColumnRenamed("id", id_col)
    df = df.mapInArrow(_scan(todo, True), f"id {kind}, text string, hit array<bigint>, items array<string>")
    return df.mapInArrow(_summary, f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean").withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents, all columns, in which no item window occurs; one pass for each block."""
    spark, df, at, n = documents.sparkSession, documents, documents.columns.index(text_col), 0
    for rows in blocks(benchmark, item_col, item_text, block_bytes):
        if n:
            shared_dir(spark)
            df = df.checkpoint()
        df, n = df.mapInArrow(released(_clean(spark.sparkContext.broadcast(Fingerprints(rows)), at)), documents.schema), n + 1
    return df


def _clean(block, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["id", "text"])
            for found_rows in _scan(block, False)(iter([rows])):
                yield batch.filter(pc.invert(found_rows.column(5)))

    return run


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digests of the hits that all blocks have left in a row."""
    for batch in batches:
        words = [len(split_words(ALNUM.lower[np.frombuffer(x, np.uint8)], ALNUM)[0]) for x in texts(batch.column(1))]
        hit, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words, pa.int64()), pa.array([len(x) for x in hit], pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digest), pa.array([bool(x) for x in hit], pa.bool_())],
            names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
